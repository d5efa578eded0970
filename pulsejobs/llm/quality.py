"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import flat, slices, span_hashes, spans, table, text_crc, with_others_aside

#: The fit takes at most so many labelled documents of each label, whole, and of those as many as have so many lines together.
FIT_DOCS = 1500
FIT_LINES = 200_000
ITERATIONS = 150

_CLASS = np.zeros(256, np.uint8)  # 0 other
_CLASS[[*range(97, 123)]] = 1  # lower-case letter
_CLASS[[*range(65, 91)]] = 2  # capital
_CLASS[[*range(128, 256)]] = 3  # part of a longer character
_CLASS[[*range(48, 58)]] = 4  # digit
_CLASS[[9, 11, 12, 13, 32]] = 5  # blank
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 6  # common marks
_CLASS[[ord(c) for c in "!"]] = 7
_CLASS[[ord(c) for c in "#$%&*|<>=@^~_{}[]\\/+`"]] = 8  # signs
_CLASS[10] = 9  # line end
#: Per line: 9 shares of byte classes, then the seven named in line_features().
OWN = 16
#: Own features, those of the line before and after, two edge flags and a constant.
FEATURES = 3 * OWN + 3


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of every text: (lines, FEATURES) float32; first line of each text (n+1); line weights (bytes).

    A text has one line more than it has line ends, so an empty text has one
    empty line. Everything is summed over the whole batch at once.
    """
    data, offsets = flat(texts)
    n = len(data)
    ends = np.flatnonzero(data == 10)
    # a line starts at each text and after each line end
    start = np.concatenate([offsets[:-1], ends + 1])
    order = np.argsort(start, kind="stable")
    # of equal starts (empty text, or a line end that closes a text) the line of the earlier text comes first
    owner = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, ends, "right") - 1])
    order = np.lexsort((start, owner))
    start, owner = start[order], owner[order]
    first = np.searchsorted(owner, np.arange(len(offsets)))
    stop = np.empty_like(start)
    stop[:-1] = np.where(owner[1:] == owner[:-1], start[1:] - 1, offsets[owner[:-1] + 1])
    stop[-1:] = offsets[owner[-1:] + 1]
    size = np.maximum(stop - start, 0)
    lines = len(start)
    own = np.zeros((lines, OWN), np.float32)
    kind = _CLASS[data]
    for k in range(9):
        total = np.concatenate([[0], np.cumsum(kind == k)])
        own[:, k] = (total[stop] - total[start]) / np.maximum(size, 1)
    # words: each belongs to the line in which it starts (line ends part words)
    ws, we, _ = spans(data, offsets)
    of = np.repeat(np.arange(lines), np.searchsorted(ws, stop) - np.searchsorted(ws, start)) if n else np.zeros(0, np.int64)
    hashes = span_hashes(data, ws, we)
    words = np.bincount(of, minlength=lines)
    some = np.maximum(words, 1)
    same = np.zeros(len(ws), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    by = np.lexsort((hashes, of))
    fresh = np.ones(len(by), bool)
    fresh[1:] = (hashes[by][1:] != hashes[by][:-1]) | (of[by][1:] != of[by][:-1])
    own[:, 9] = np.bincount(of, same, lines) / some  # words that repeat the one before
    own[:, 10] = np.bincount(of[by], fresh, lines) / some  # distinct words
    own[:, 11] = np.bincount(of, we - ws, lines) / some / 10  # mean length
    own[:, 12] = np.log1p(words) / 5
    own[:, 13] = words == 0
    last = np.minimum(np.maximum(stop - 1, 0), max(n - 1, 0))
    closing = np.isin(data[last], [46, 33, 63]) if n else np.zeros(lines, bool)
    own[:, 14] = closing & (size > 0)  # ends a sentence
    # words that end in a sign or exclamation mark, of all words
    odd = (kind[we - 1] == 8) | (kind[we - 1] == 7) if len(we) else np.zeros(0, bool)
    own[:, 15] = np.bincount(of, odd, lines) / some
    head = np.zeros(lines, bool)
    head[first[:-1]] = True
    tail = np.zeros(lines, bool)
    tail[first[1:] - 1] = True
    out = np.zeros((lines, FEATURES), np.float32)
    out[:, :OWN] = own
    out[1:, OWN : 2 * OWN] = np.where(head[1:, None], 0, own[:-1])
    out[:-1, 2 * OWN : 3 * OWN] = np.where(tail[:-1, None], 0, own[1:])
    out[:, -3], out[:, -2], out[:, -1] = head, tail, 1
    return out, first, size + 1


@dataclass
class Crf:
    """Two states (0 bad, 1 good): a weight vector for good against bad, transition scores, and a logistic last step."""

    weights: np.ndarray
    transitions: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def marginals(self, score: np.ndarray, first: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """P(good) of each line, and on request the joint (n, 2, 2) of the line before and it; all texts step by step together."""
        counts = np.diff(first)
        order = np.argsort(-counts, kind="stable")
        lines = first[:-1][order]
        active = np.searchsorted(-counts[order], -np.arange(counts.max(initial=0)) - 1, "right")  # texts that have a line k
        n, t, add = len(score), self.transitions, np.logaddexp
        node = np.zeros((n, 2))
        node[:, 1] = score
        forward, backward = node.copy(), np.zeros((n, 2))
        for k in range(1, len(active)):
            now = lines[: active[k]] + k
            before = forward[now - 1]
            for b in range(2):
                forward[now, b] += add(before[:, 0] + t[0, b], before[:, 1] + t[1, b])
        for k in range(len(active) - 1, 0, -1):
            now = lines[: active[k]] + k
            after = backward[now] + node[now]
            for a in range(2):
                backward[now - 1, a] = add(after[:, 0] + t[a, 0], after[:, 1] + t[a, 1])
        both = forward + backward
        z = add(both[:, 0], both[:, 1])
        good = np.exp(both[:, 1] - z)
        if not pairs:
            return good, None
        joint = np.zeros((n, 2, 2))
        joint[1:] = np.exp(np.minimum(0, forward[:-1, :, None] + t + (node + backward)[1:, None, :] - z[1:, None, None]))  # lines of two texts give more; they are set to 0 next
        joint[first[:-1]] = 0
        return good, joint

    def mean_good(self, x: np.ndarray, first: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' P(good), by text."""
        good, _ = self.marginals(x @ self.weights, first)
        return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight.astype(float), first[:-1])

    def scores(self, x: np.ndarray, first: np.ndarray, weight: np.ndarray) -> np.ndarray:
        if len(first) < 2:
            return np.zeros(0)
        mean = np.clip(self.mean_good(x, first, weight), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log(mean / (1 - mean)) + self.shift, -30, 30)))


def fit(x: np.ndarray, first: np.ndarray, weight: np.ndarray, labels: np.ndarray, iterations: int = ITERATIONS, passes: int = 2) -> Crf:
    """Learn from labels of whole texts.

    Lines begin with their text's label. After each pass, lines of bad texts
    whose marginal is good turn good (a bad text keeps its worst line), and the
    field is fitted again. A logistic step on the weighted mean then sets where
    a text counts as good. Adam on the conditional likelihood; classes weigh
    the same in sum.
    """
    owner = np.repeat(np.arange(len(labels)), np.diff(first))
    y = labels[owner].astype(float)
    text_weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    field = Crf(np.zeros(x.shape[1]), np.zeros((2, 2)))
    # one weight a text: a text with many lines must not outweigh the others
    w = text_weight[owner] / np.diff(first)[owner]
    inner = np.ones(len(x), bool)
    inner[first[:-1]] = False
    i = np.flatnonzero(inner)
    for _ in range(passes):
        seen = np.zeros((2, 2))
        yi = y.astype(int)
        np.add.at(seen, (yi[i - 1], yi[i]), w[i])
        m = [np.zeros_like(field.weights), np.zeros((2, 2))]
        v = [np.zeros_like(field.weights), np.zeros((2, 2))]
        for t in range(1, iterations + 1):
            good, joint = field.marginals(x @ field.weights, first, pairs=True)
            g = [x.T @ (w * (y - good)) - 1e-4 * field.weights, seen - np.einsum("n,nab->ab", w, joint) - 1e-3 * field.transitions]
            for k, p in enumerate((field.weights, field.transitions)):
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                p += 0.1 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        good, _ = field.marginals(x @ field.weights, first)
        y = np.where(labels[owner] == 1, 1.0, (good > 0.5).astype(float))
        worst = np.minimum.reduceat(good, first[:-1])
        y[(labels[owner] == 0) & (good <= worst[owner])] = 0.0
    mean = np.clip(field.mean_good(x, first, weight), 1e-6, 1 - 1e-6)
    s = np.log(mean / (1 - mean))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        h = text_weight * p * (1 - p) + 1e-9
        ga, gb = (text_weight * (labels - p) * s).sum() - 1e-3 * (a - 1), (text_weight * (labels - p)).sum()
        haa, hab, hbb = (h * s * s).sum() + 1e-3, (h * s).sum(), h.sum() + 1e-6
        det = haa * hbb - hab * hab
        a, b = a + np.clip((hbb * ga - hab * gb) / det, -1, 1), b + np.clip((haa * gb - hab * ga) / det, -1, 1)
    field.slope, field.shift = float(max(a, 1e-3)), float(b)
    return field


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a document: the features and weights of all its lines as bytes."""
    for batch in slices(batches, "text", 500_000):
        x, first, weight = line_features(batch.column("text"))
        cut = [slice(a, b) for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("quality"), pa.array([x[c].tobytes() for c in cut], pa.binary()), pa.array([weight[c].astype(np.int64).tobytes() for c in cut], pa.binary())],
            names=["quality", "x", "weight"],
        )


def train(docs: DataFrame, labels: DataFrame, n_docs: int = FIT_DOCS, n_lines: int = FIT_LINES) -> Crf:
    """Fit on at most ``n_docs`` documents of either label (0, 1): those with the smallest hashes, so a fixed sample.

    Documents are learned from whole. Of the picked ones those are taken, in
    the order of their hashes, that have ``n_lines`` lines of either label
    together; one that does not fit in is passed over. So at most
    ``2 * n_lines`` lines of 51 figures (4 bytes each, 8 while fitting) come to
    the driver. Of different texts under one id one is learned from. Without
    documents of both labels all texts score a half.
    """
    rank = F.xxhash64("doc_id", F.lit("quality"))
    picked = None
    for q in (0, 1):
        some = labels.where(F.col("quality") == q).select("doc_id", F.lit(q).alias("quality")).distinct().orderBy(rank, "doc_id").limit(n_docs)
        picked = some if picked is None else picked.union(some)
    found = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(F.broadcast(picked), "doc_id")
    lines = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    sizes = found.groupBy("quality", "doc_id", rank.alias("rank")).agg(F.min(F.struct("text_hash", F.coalesce(lines, F.lit(1)).alias("lines"))).alias("one")).collect()
    taken, left = [], {0: n_lines, 1: n_lines}
    for r in sorted(sizes, key=lambda r: (r["rank"], r.doc_id)):
        if r.one.lines <= left[r.quality]:
            left[r.quality] -= r.one.lines
            taken.append((r.doc_id, r.one.text_hash, r.quality))
    chosen = docs.sparkSession.createDataFrame(taken, "doc_id long, text_hash long, quality int")
    one = found.drop("quality").join(F.broadcast(chosen), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "quality"])
    rows = one.select("quality", "text").mapInArrow(_features, "quality int, x binary, weight binary").collect()
    rows.sort(key=lambda r: (r.quality, bytes(r.x)))  # sums in the same order, whatever the partitions
    y = np.array([r.quality for r in rows])
    if len(set(y)) < 2:
        return Crf(np.zeros(FEATURES), np.zeros((2, 2)))
    x = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in rows]
    weight = np.concatenate([np.frombuffer(r.weight, np.int64) for r in rows])
    return fit(np.concatenate(x).astype(np.float64), np.concatenate([[0], np.cumsum([len(v) for v in x])]), weight, y)


def _score(held, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = held.value
        for batch in slices(batches, "text", 1_000_000):
            score = np.round(field.scores(*line_features(batch.column("text"))), 12)  # a half is a half, whatever the order of sums
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(score, pa.float64()), pa.array(score >= 0.5, pa.int32())], names=[*names, "score", "predicted"])

    return run


def score_quality(docs: DataFrame, field: Crf) -> DataFrame:
    """All columns of ``docs`` and score (0 to 1), predicted (1 from a half on).

    Every line of the whole text gets its marginal probability to be good;
    their mean by length, through the fitted logistic step, is the score. Null
    and empty texts are one empty line. Older score and predicted columns are
    replaced, other columns stay. Rows are on their own: no shuffle.
    """
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    columns = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names).mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(field), names), f"{columns}, score double, predicted int")


def held_out(doc_id: str = "doc_id"):
    """Rows that no fit sees; ids that are null too."""
    return F.coalesce(text_crc(F.col(doc_id)) % 3 == 1, F.lit(True))


def trained_on(docs: DataFrame, labels: DataFrame) -> Crf:
    return train(docs.where(~held_out()), labels.where(~held_out()))


def op8_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = trained_on(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, field).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted to be bad go."""
    field = trained_on(docs, table(spark, sf_dir, "labels"))
    return with_others_aside(docs, ("doc_id", "text"), lambda d: score_quality(d, field).where("predicted = 1"))
