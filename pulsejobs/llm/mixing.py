"""Source mixing: rake token weights to marginal targets, then sample documents by calibrated probabilities."""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, with_others_aside

log = logging.getLogger(__name__)

ROUNDS = 25
#: Rounds at most of the bounded fit, and the error, as a share of the sample, at which it ends.
BOUNDED_ROUNDS, CLOSE = 2000, 1e-6
#: Cells (combinations of source, language and topic that occur) at most, since they reach the driver, some 50 bytes each.
MAX_CELLS = 4_000_000
#: Values of a dimension that are looked up in a literal, and in a broadcast table; more are joined by a shuffle.
MAX_LITERAL, MAX_BROADCAST = 200, 200_000
#: How often as common as in the corpus a category without a target of its own may become (about: shares are normalised after it).
MOST = 1.25
SEED = "mix-1"
#: The largest factor: products of three and sums of them stay finite.
HIGH = 1e80
DIMENSIONS = ("source", "lang", "topic")
NONE = "(none)"


#: Signs of code, tables and other markup.
MARKS = "{}[]<>=;|#$%&*@\\^~_+/"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def topic_of(text: Column) -> Column:
    """A register used as topic: what the characters of the whole text say, by shares that hold for any corpus.

    ``numbers`` (15 digits and more in a hundred characters), ``markup`` (4
    signs of MARKS), ``capitals`` (25 capitals A-Z), ``lines`` (lines of under 40
    characters on average), ``brief`` (under 600 characters, null and empty
    texts too) or ``prose``, the first that fits. A fixed rule, so that a document has
    the same topic in every corpus; a corpus with topics of its own has them in a column and needs none.
    """
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    share = lambda of: F.regexp_count(text, F.lit(f"[{re.escape(of)}]")) * 100
    some = n > 0
    return (
        F.when(some & (share("0123456789") >= 15 * n), "numbers")
        .when(some & (share(MARKS) >= 4 * n), "markup")
        .when(some & (share(CAPITALS) >= 25 * n), "capitals")
        .when(some & (share("\n") * 40 >= 100 * n), "lines")
        .when(n < 600, "brief")
        .otherwise("prose")
    )


def tempered(share: dict[str, float], power: float, most: float = MOST) -> dict[str, float]:
    """Shares to the power ``power``, normalised: below 1, small categories gain, up to about ``most`` times their share.

    Without that bound a category of a few documents sets how small the sample must be.
    """
    raised = {k: v**power for k, v in share.items() if v > 0}
    total = sum(raised.values())
    cut = {k: min(v / total, most * share[k]) for k, v in raised.items()}
    left = sum(cut.values())
    return {k: v / left for k, v in cut.items()}


@dataclass(frozen=True)
class Cells:
    """The cells of a table that occur: their places in each dimension and their token counts."""

    places: tuple[np.ndarray, ...]
    n: np.ndarray
    sizes: tuple[int, ...]

    @classmethod
    def of(cls, table: np.ndarray | Cells) -> Cells:
        if isinstance(table, Cells):
            return table
        places = np.nonzero(np.ones(table.shape, bool))
        return cls(places, table[places].astype(float), table.shape)

    def product(self, factors: list[np.ndarray]) -> np.ndarray:
        out = np.ones(len(self.n))
        for f, at in zip(factors, self.places, strict=True):
            out *= f[at]
        return out

    def sums(self, axis: int, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.places[axis], x, self.sizes[axis])


def rake(table: np.ndarray | Cells, targets: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """Factors for each dimension by iterative proportional fitting of a table of token counts.

    Each round scales each dimension in turn to its target sums; the fitted
    table is the counts times the product of the factors. Categories
    without tokens keep the factor they have.
    """
    cells = Cells.of(table)
    factors = [np.ones(n) for n in cells.sizes]
    for _ in range(rounds):
        for axis, target in enumerate(targets):
            sums = cells.sums(axis, cells.n * cells.product(factors))
            step = np.divide(target, sums, out=np.ones_like(sums), where=sums > 0)
            factors[axis] = np.minimum(factors[axis] * step, HIGH)  # where targets contradict each other factors would grow for ever
        for axis in range(1, len(factors)):  # scale is free to move between the dimensions: all of it is kept in the first
            top = factors[axis].max()
            if top > 0:
                factors[axis] /= top
                factors[0] = np.minimum(factors[0] * top, HIGH)
    return factors


def _bounded(cells: Cells, targets: list[np.ndarray], rounds: int) -> tuple[list[np.ndarray], float]:
    """Factors for which the counts times ``min(1, product)`` have the target sums, and the largest error left, as a share of all targets."""
    factors = [np.ones(n) for n in cells.sizes]
    error = np.inf
    for _ in range(rounds):
        for axis, target in enumerate(targets):
            sums = cells.sums(axis, cells.n * np.minimum(1, cells.product(factors)))
            step = np.divide(target, sums, out=np.ones_like(sums), where=sums > 0)
            factors[axis] = np.minimum(factors[axis] * step, 1e30)
        kept = cells.n * np.minimum(1, cells.product(factors))
        error = max(np.abs(cells.sums(axis, kept) - target).max() for axis, target in enumerate(targets)) / targets[0].sum()
        if error < CLOSE:
            break
    return factors, error


def calibrate(table: np.ndarray | Cells, targets: list[np.ndarray], keep_share: float, rounds: int = BOUNDED_ROUNDS, steps: int = 0) -> tuple[list[np.ndarray], float, float]:
    """Factors whose product, cut at 1, is the sampling probability of a cell; the share of all tokens that is kept, and the error left.

    The sums of the expected sample are ``targets`` (sums over all tokens) times
    the kept share. That is ``keep_share`` if the cells have enough tokens for
    it, else the largest share for which they have, to a thousandth; with
    ``steps`` the largest of that many equal parts of ``keep_share``.
    """
    cells = Cells.of(table)
    at = lambda b: _bounded(cells, [t * b for t in targets], rounds)
    factors, error = at(keep_share)
    if error < CLOSE:
        return factors, keep_share, error
    for k in range(1, steps):
        factors, error = at(keep_share * (steps - k) / steps)
        if error < CLOSE:
            return factors, keep_share * (steps - k) / steps, error
    # no cell is cut at this share, so raking alone decides
    whole = rake(cells, targets, rounds)
    low = min(keep_share, 1.0 / max(cells.product(whole)[cells.n > 0].max(), 1e-12))
    high, (factors, error) = keep_share, at(low)
    kept = low
    while high - low > 1e-3 * high:
        middle = (low + high) / 2
        found = at(middle)
        if found[1] < max(CLOSE, error):
            low, kept, (factors, _) = middle, middle, found
        else:
            high = middle
    return factors, kept, error


def with_dimensions(docs: DataFrame, prefix: str = "mix") -> DataFrame:
    """doc columns and, after ``prefix``, _source, _lang, _topic, _tokens (white-space words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns(
        {
            f"{prefix}_source": F.coalesce(F.col("source"), F.lit(NONE)),
            f"{prefix}_lang": F.coalesce(F.col("lang"), F.lit(NONE)),
            f"{prefix}_topic": topic_of(F.col("text")),
            f"{prefix}_tokens": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"),
        }
    )


def _with_factors(df: DataFrame, values: list[str], factors: np.ndarray, c: str, new: str) -> DataFrame:
    """Adds the factor of each row's value: by a literal for few values, else by a join with a table of them, which is broadcast up to a size."""
    if len(values) <= MAX_LITERAL:
        return df.withColumn(new, F.create_map(*chain.from_iterable((F.lit(v), F.lit(float(x))) for v, x in zip(values, factors, strict=True)))[F.col(c)])
    held = df.sparkSession.createDataFrame(pa.table({f"{new}_of": values, new: factors.astype(float)}))
    return df.join(F.broadcast(held) if len(values) <= MAX_BROADCAST else held, df[c] == held[f"{new}_of"]).drop(f"{new}_of")


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = 0.7, keep_share: float = 0.5, rounds: int = ROUNDS, seed: str = SEED, bounded: bool = False, most: float = MOST, steps: int = 0) -> DataFrame:
    """All columns of ``docs`` and: topic, tokens, weight, probability, kept.

    ``targets`` maps source, lang or topic to the wanted shares of tokens;
    shares are normalised over the categories that have tokens, categories
    without a target keep the share they have. A dimension without targets gets
    its shares tempered by ``power`` and ``most`` (see ``tempered``). The token counts of the category cells
    (those that occur, ``MAX_CELLS`` at most, which is checked) are the only
    figures that reach the driver. ``weight`` is the raked weight of a
    token in the cell: 1 means as common as in the corpus. The sampling
    probability is ``min(1, k * weight)``, with k calibrated so that
    ``keep_share`` of all tokens is expected; where a cell would need more than
    1, k is lowered until none does, so the expected sample has the targets and
    fewer tokens. With ``bounded`` probabilities may reach 1 and the cells are
    fitted as they are cut, which also meets the targets and keeps as many
    tokens as they leave (``steps`` as in ``calibrate``). A document is kept if a fixed hash of its doc_id and
    ``seed`` lies below its probability. Both what is kept and the error left
    by the fit are logged.

    Null sources and languages are categories of their own. Documents without
    words have weight by their cell (1 if the cell has no tokens). Repeated
    ids are kept or dropped together, a null id hashes as an empty text. An
    empty table gives an empty result.
    """
    prefix = "mix"
    while any(c.startswith(f"{prefix}_") for c in docs.columns):
        prefix += "_"
    held = with_dimensions(docs, prefix)
    dims = [f"{prefix}_{d}" for d in DIMENSIONS]
    topic, tokens = F.col(f"{prefix}_topic").alias("topic"), F.col(f"{prefix}_tokens").alias("tokens")
    found = held.groupBy(*dims).agg(F.sum(f"{prefix}_tokens").alias("n")).limit(MAX_CELLS + 1).toArrow()
    if found.num_rows > MAX_CELLS:
        raise ValueError(f"over {MAX_CELLS} cells of source, language and topic; fold rare sources first")
    coded = [found.column(d).combine_chunks().dictionary_encode() for d in dims]
    values, places = [], []
    for column in coded:
        names = column.dictionary.to_pylist()
        rank = np.argsort(np.argsort(np.array(names, object))) if names else np.zeros(0, int)
        values.append(sorted(names))
        places.append(rank[column.indices.to_numpy()].astype(np.int64))
    cells = Cells(tuple(places), found.column("n").to_numpy().astype(float), tuple(max(1, len(v)) for v in values))
    total = cells.n.sum()
    if not total:
        return held.select(*[c for c in docs.columns if c not in ("topic", "tokens", "weight", "probability", "kept")], topic, tokens, F.lit(1.0).alias("weight"), F.lit(1.0).alias("probability"), F.lit(True).alias("kept"))
    wanted = []
    for axis, (dim, names) in enumerate(zip(DIMENSIONS, values, strict=True)):
        sums = cells.sums(axis, cells.n)
        share = dict(zip(names, sums / total, strict=True))
        given = (targets or {}).get(dim) or tempered(share, power, most)
        left = sum(share[v] for v in names if v not in given)
        inside = sum(x for v, x in given.items() if share.get(v, 0) > 0)
        wanted.append(np.array([0 if share[v] <= 0 else share[v] if v not in given else given[v] / inside * (1 - left) for v in names]) * total)
    if bounded:
        factors, high, error = calibrate(cells, wanted, keep_share, steps=steps)
        factors = [factors[0] / high, *factors[1:]]
    else:
        factors = rake(cells, wanted, rounds)
        weight = cells.product(factors)
        high = min(keep_share, 1.0 / weight[cells.n > 0].max())
        error = max(np.abs(cells.sums(axis, cells.n * weight) - t).max() for axis, t in enumerate(wanted)) / total
    say = log.warning if high < keep_share or error > CLOSE else log.info
    say("mix: %.4f of the tokens are kept, %.4f were asked for; largest error of a share %.1e", high, keep_share, error)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / float(2**32)
    for k, d in enumerate(dims):
        held = _with_factors(held, values[k], factors[k], d, f"{prefix}_factor{k}")
    raw = F.col(f"{prefix}_factor0") * F.col(f"{prefix}_factor1") * F.col(f"{prefix}_factor2")
    names = ("topic", "tokens", "weight", "probability", "kept")
    return (
        held.withColumn(f"{prefix}_weight", raw)
        .withColumn(f"{prefix}_probability", F.least(F.lit(1.0), F.lit(float(high)) * F.col(f"{prefix}_weight")))
        .select(*[F.col(f"`{c}`") for c in docs.columns if c not in names], topic, tokens, F.col(f"{prefix}_weight").alias("weight"), F.col(f"{prefix}_probability").alias("probability"), (draw < F.col(f"{prefix}_probability")).alias("kept"))
    )


#: What the query asks for: half of the tokens, or the largest fortieth below that; small sources and topics may become twice as common.
KEEP, STEPS, GAIN = 0.5, 20, 2.0
#: The mixture that the query and the pipeline ask for: flatter sources and topics, fixed language shares.
TARGETS = {"lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}}


def op1_rake_and_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample that meets the target shares, of half of the tokens or the largest fortieth below that the targets leave."""
    mixed = mix(table(spark, sf_dir, "documents"), TARGETS, keep_share=KEEP, bounded=True, most=GAIN, steps=STEPS)
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "kept")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: a sample that meets the target shares, of nine tenths of the tokens or as many as the targets leave."""
    sample = lambda d: mix(d, TARGETS, power=0.9, keep_share=0.9, bounded=True).where("kept")
    return with_others_aside(docs, ("doc_id", "text", "lang", "source"), sample)


def _round_sql(d: str, of: str) -> str:
    """One update of the bounded fit: the factors of one dimension, for each share b."""
    step = f"coalesce(x{d} * b / nullif(sum(n * least(1, fs * fl * ft)) OVER (PARTITION BY b, {d}), 0), 1)"
    return "SELECT b, s, l, t, n, xs, xl, xt, " + ", ".join(f"least(f{d} * {step}, 1e30) AS f{d}" if c == d else f"f{c}" for c in "slt") + f", k FROM ({of})"


def _fitted_sql() -> str:
    """The same fit by recursion over the table of cells, three updates a round, to the same error, for all shares at once; the largest that is met counts."""
    rounds = _round_sql("t", _round_sql("l", _round_sql("s", f"SELECT * FROM walk WHERE k < {BOUNDED_ROUNDS} AND err >= {CLOSE}")))
    errors = ", ".join(f"abs(sum(n * least(1, fs * fl * ft)) OVER (PARTITION BY b, {d}) - x{d} * b)" for d in "slt")
    return f"""walk AS (
  SELECT {KEEP} * ({STEPS} - j)::DOUBLE / {STEPS} AS b, s, l, t, n, ts.x AS xs, tl.x AS xl, tt.x AS xt, 1.0::DOUBLE AS fs, 1.0::DOUBLE AS fl, 1.0::DOUBLE AS ft, 0 AS k, 1e300::DOUBLE AS err
  FROM cells0 JOIN ts USING (s) JOIN tl USING (l) JOIN tt USING (t), range({STEPS}) r(j)
  UNION ALL
  SELECT b, s, l, t, n, xs, xl, xt, fs, fl, ft, k + 1, max(e) OVER (PARTITION BY b) / (sum(n) OVER (PARTITION BY b) * b)
  FROM (SELECT *, greatest({errors}) AS e FROM ({rounds}))),
met AS (SELECT max(b) AS b FROM walk WHERE err < {CLOSE}),
fitted AS MATERIALIZED (SELECT b, s, l, t, fs * fl * ft AS f FROM walk JOIN met USING (b) WHERE err < {CLOSE})"""


OP1_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, source, lang, coalesce(source, '{NONE}') AS s, coalesce(lang, '{NONE}') AS l,
    CASE WHEN length(text) > 0 AND (length(text) - length(translate(text, '0123456789', ''))) * 100 >= 15 * length(text) THEN 'numbers'
      WHEN length(text) > 0 AND (length(text) - length(translate(text, '{MARKS}', ''))) * 100 >= 4 * length(text) THEN 'markup'
      WHEN length(text) > 0 AND (length(text) - length(translate(text, '{CAPITALS}', ''))) * 100 >= 25 * length(text) THEN 'capitals'
      WHEN length(text) > 0 AND (length(text) - length(replace(text, chr(10), ''))) * 4000 >= 100 * length(text) THEN 'lines'
      WHEN length(coalesce(text, '')) < 600 THEN 'brief' ELSE 'prose' END AS t,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n
  FROM documents),
cells0 AS MATERIALIZED (SELECT s, l, t, sum(n)::DOUBLE AS n FROM d GROUP BY ALL),
tot AS (SELECT sum(n) AS total FROM cells0),
ts AS MATERIALIZED (SELECT s, c / sum(c) OVER () * total AS x FROM (SELECT s, least(n ** 0.7 / sum(n ** 0.7) OVER (), {GAIN} * n / sum(n) OVER ()) AS c FROM (SELECT s, sum(n) AS n FROM cells0 GROUP BY s)), tot),
tt AS MATERIALIZED (SELECT t, c / sum(c) OVER () * total AS x FROM (SELECT t, least(n ** 0.7 / sum(n ** 0.7) OVER (), {GAIN} * n / sum(n) OVER ()) AS c FROM (SELECT t, sum(n) AS n FROM cells0 GROUP BY t)), tot),
given(l, g) AS (VALUES ('en', 0.5), ('de', 0.2), ('fr', 0.2), ('es', 0.1)),
langs AS (SELECT l, sum(n) AS n FROM cells0 GROUP BY l),
tl AS MATERIALIZED (
  SELECT l, CASE WHEN n = 0 THEN 0 WHEN g IS NULL THEN n ELSE g / sum(CASE WHEN n > 0 THEN g END) OVER () * (total - coalesce(sum(CASE WHEN g IS NULL THEN n END) OVER (), 0)) END AS x
  FROM langs LEFT JOIN given USING (l), tot),
{_fitted_sql()}
SELECT doc_id, source, lang, t AS topic, d.n AS tokens, round(f / b, 6) AS weight, round(least(1.0, f), 6) AS probability,
  ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < least(1.0, f) AS kept
FROM d JOIN fitted USING (s, l, t)
"""
