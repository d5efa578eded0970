"""Language identification with a byte convolutional network, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import flat, slices, stage, table, text_crc

#: Bytes of a window, and how many of them two neighbouring windows share (the widest filter less one).
WINDOW = 256
WIDTHS = (2, 3, 4)
OVERLAP = max(WIDTHS) - 1
FILTERS = 12
EMBED = 8
#: The fit takes at most so many labelled documents of each language, whole, and of those as many as have so many windows together.
FIT_DOCS = 700
FIT_WINDOWS = 4000
EPOCHS = 6
UNKNOWN = "und"


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed-length windows over whole texts: bytes (n, WINDOW; short texts padded with 0), text number, bytes covered."""
    sizes = np.diff(offsets)
    step = WINDOW - OVERLAP
    counts = np.maximum(1, -(-np.maximum(0, sizes - OVERLAP) // step))
    owner = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[owner] + number * step
    length = np.clip(offsets[owner + 1] - start, 0, WINDOW)
    at = start[:, None] + np.arange(WINDOW)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    out = padded[np.minimum(at, len(padded) - 1)]
    out[np.arange(WINDOW) >= length[:, None]] = 0
    return out, owner, length


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class ByteCnn:
    """Embedding, filters of several widths in one matrix, max over positions, softmax."""

    labels: list[str]
    embed: np.ndarray  # (256, EMBED); byte 0 is padding
    filters: np.ndarray  # (widest * EMBED, filters); narrow filters have zero rows
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def mask() -> np.ndarray:
        rows = np.arange(max(WIDTHS) * EMBED) // EMBED
        return np.concatenate([np.repeat((rows < w)[:, None], FILTERS, axis=1) for w in WIDTHS], axis=1).astype(np.float32)

    @classmethod
    def fresh(cls, labels: list[str], seed: int = 7) -> ByteCnn:
        r = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        draw = lambda *s, x: (r.standard_normal(s) * x).astype(np.float32)
        embed = draw(256, EMBED, x=0.5)
        embed[0] = 0
        return cls(labels, embed, draw(max(WIDTHS) * EMBED, n, x=0.2) * cls.mask(), np.zeros(n, np.float32), draw(n, len(labels), x=0.2), np.zeros(len(labels), np.float32))

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """x: (n, WINDOW) bytes. Probabilities, pooled values, their positions, unfolded embeddings."""
        e = self.embed[x]
        widest = max(WIDTHS)
        n = x.shape[1] - widest + 1
        unfolded = np.concatenate([e[:, j : j + n] for j in range(widest)], axis=2)
        act = unfolded.reshape(-1, widest * EMBED) @ self.filters
        act = act.reshape(len(x), n, -1)
        where = act.argmax(axis=1)
        pooled = np.maximum(0, np.take_along_axis(act, where[:, None], axis=1)[:, 0] + self.bias)
        return _softmax(pooled @ self.out + self.out_bias), pooled, where, unfolded

    def predict(self, x: np.ndarray, rows: int = 128) -> np.ndarray:
        """Probabilities of windows, in blocks that stay in the cache."""
        widest = max(WIDTHS)
        n = x.shape[1] - widest + 1
        out = np.empty((len(x), len(self.labels)), np.float32)
        for i in range(0, len(x), rows):
            e = self.embed[x[i : i + rows]]
            unfolded = np.concatenate([e[:, j : j + n] for j in range(widest)], axis=2).reshape(-1, widest * EMBED)
            act = (unfolded @ self.filters).reshape(len(e), n, -1).max(axis=1)
            out[i : i + rows] = _softmax(np.maximum(0, act + self.bias) @ self.out + self.out_bias)
        return out


def fit(windows: np.ndarray, labels: np.ndarray, names: list[str], epochs: int = EPOCHS, seed: int = 7, rate: float = 0.01, batch: int = 64) -> ByteCnn:
    """Adam on the cross entropy, classes weighted by the inverse root of their frequency."""
    net, r = ByteCnn.fresh(names, seed), np.random.default_rng(seed)
    keep = ByteCnn.mask()
    names_ = ("embed", "filters", "bias", "out", "out_bias")
    m = {k: np.zeros_like(getattr(net, k)) for k in names_}
    v = {k: np.zeros_like(getattr(net, k)) for k in names_}
    frequency = np.bincount(labels, minlength=len(names)) / max(1, len(labels))
    weight = 1 / np.sqrt(np.maximum(frequency, 1e-6))
    weight = (weight / (weight * frequency).sum()).astype(np.float32)
    t = 0
    for epoch in range(epochs):
        order = r.permutation(len(windows))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            x, y = windows[pick], labels[pick]
            p, pooled, where, unfolded = net.forward(x)
            d = p.copy()
            d[np.arange(len(y)), y] -= 1
            d *= weight[y][:, None] / len(y)
            g = {"out": pooled.T @ d, "out_bias": d.sum(axis=0)}
            dp = (d @ net.out.T) * (pooled > 0)
            g["bias"] = dp.sum(axis=0)
            hit = unfolded[np.arange(len(x))[:, None], where]  # (n, filters, widest * EMBED)
            g["filters"] = np.einsum("nf,nfk->kf", dp, hit) * keep
            de = np.einsum("nf,kf->nfk", dp, net.filters).reshape(len(x), -1, max(WIDTHS), EMBED)
            g["embed"] = np.zeros_like(net.embed)
            for j in range(max(WIDTHS)):
                np.add.at(g["embed"], x[np.arange(len(x))[:, None], where + j], de[:, :, j])
            g["embed"][0] = 0
            t += 1
            step = rate * (0.5 if epoch >= epochs // 2 else 1) * (1 - 0.999**t) ** 0.5 / (1 - 0.9**t)
            for k in names_:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                setattr(net, k, (getattr(net, k) - step * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32))
    return net


def _lowered(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` by number (c0, c1, ...), and lower, letters: so that no name can clash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], F.encode(F.lower(text), "UTF-8").alias("lower"), text.rlike(r"\p{L}").alias("letters"))


def train(docs: DataFrame, n_docs: int = FIT_DOCS, n_windows: int = FIT_WINDOWS) -> ByteCnn:
    """Fit on at most ``n_docs`` documents of each language: those with the smallest hashes, so a fixed sample.

    The classes are all values of lang that a text with a letter has. Documents
    are learned from whole: of the picked ones of a language those are taken, in
    the order of their hashes, that have ``n_windows`` windows together; one that
    does not fit in is passed over; of a language without any that does, the smallest is taken. Equal
    rows count once. What is picked are hashes and sizes; only then are the picked texts read.
    """
    hash_ = F.xxhash64("doc_id", "text", F.lit("lang"))
    able = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", hash_.alias("h"))
    size = F.greatest(F.lit(1), F.ceil((F.octet_length("text") - OVERLAP) / (WINDOW - OVERLAP))).cast("long")
    # equal rows are one from here on, so a language of repeats has as many candidates as it has different rows
    slim = stage(able.select("lang", "h", size.alias("n")).groupBy("lang", "h").agg(F.max("n").alias("n")), "labelled")
    counts = slim.groupBy("lang").agg(F.count("*").alias("rows"))
    names = sorted(r.lang for r in counts.collect())
    if not names:
        return ByteCnn.fresh([UNKNOWN])
    # about four times as many as needed of each language, so that no task ranks a whole language
    few = F.col("rows") <= 16 * n_docs  # so few are all ranked
    near = slim.join(F.broadcast(counts), "lang").where(few | (F.pmod("h", F.lit(2**30)) / 2.0**30 < F.lit(4.0 * n_docs) / F.col("rows")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(2**30)), "h"))
    ranked = near.withColumn("place", place).where(F.col("place") <= n_docs).collect()
    left, taken = dict.fromkeys(names, n_windows), []
    smallest = {r.lang: (r.lang, r.h) for r in sorted(ranked, key=lambda r: (-r.n, -r.place))}
    for r in sorted(ranked, key=lambda r: (r.lang, r.place)):
        if r.n <= left[r.lang]:
            left[r.lang] -= r.n
            taken.append((r.lang, r.h))
    taken += [smallest[k] for k, n in left.items() if n == n_windows and k in smallest]
    chosen = docs.sparkSession.createDataFrame(taken, "lang string, h long")
    rows = able.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "h", F.encode(F.lower("text"), "UTF-8").alias("bytes")).collect()
    rows.sort(key=lambda r: (r.lang, r.h))  # the same order, whatever the partitions
    data = np.frombuffer(b"".join(bytes(r.bytes) for r in rows), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r.bytes) for r in rows])])
    windows, owner, _ = windows_of(data, offsets)
    y = np.array([names.index(r.lang) for r in rows])[owner]
    return fit(windows, y, names)


def _predict(held, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for batch in slices(batches, "lower", 500_000):
            data, offsets = flat(batch.column("lower"))
            total = np.zeros((batch.num_rows, len(net.labels)))
            # a long text is worked through in pieces of whole windows
            for first, at in _pieces(offsets):
                windows, owner, covered = windows_of(data[at[0] : at[-1]], at - at[0])
                p = net.predict(windows).astype(np.float64) * (covered[:, None] + 1e-3)
                for k in range(p.shape[1]):
                    total[first : first + len(at) - 1, k] += np.bincount(owner, p[:, k], len(at) - 1)
            total /= total.sum(axis=1, keepdims=True)
            best = total.argmax(axis=1)
            letters = np.array(batch.column("letters").to_pylist(), bool)
            lang = [net.labels[b] if x else UNKNOWN for b, x in zip(best, letters, strict=True)]
            score = np.where(letters, np.round(total[np.arange(len(best)), best], 6), 0.0)  # sums of floats differ in their last digits with the batch
            yield pa.RecordBatch.from_arrays([*[batch.column(f"c{i}") for i in range(len(names))], pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], names=[*names, "lang_pred", "score"])

    return run


def _pieces(offsets: np.ndarray, most: int = 500_000) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first text, offsets): all texts at once, or a single one longer than ``most`` in pieces that end where a window does."""
    if len(offsets) != 2 or offsets[-1] - offsets[0] <= most:
        yield 0, offsets
        return
    step = (WINDOW - OVERLAP) * (most // (WINDOW - OVERLAP))
    for a in range(int(offsets[0]), max(int(offsets[0]) + 1, int(offsets[1]) - OVERLAP), step):
        yield 0, np.array([a, min(a + step + OVERLAP, int(offsets[1]))])


def predict(docs: DataFrame, net: ByteCnn) -> DataFrame:
    """All columns of ``docs`` and lang_pred, score.

    Every text is cut, whole, into windows of 256 bytes that share three; a
    text's probabilities are the mean over its windows, weighted by the bytes
    they cover. A null text or one without any letter is ``und`` with score 0.
    Scores have six decimals. Extra columns stay, whatever their names; older
    lang_pred and score are replaced. Rows are on their own: no shuffle.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = _lowered(docs.select(*[F.col(f"`{c}`") for c in names]))
    columns = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(net), names), f"{columns}, lang_pred string, score double")


def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(text_crc(F.col("doc_id")) % 4 == 2, F.lit(True))
    net = train(docs.where(~held_out))
    found = predict(docs.select("doc_id", "text"), net)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
