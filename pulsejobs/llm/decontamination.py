"""Benchmark decontamination: one Aho-Corasick automaton over the normalised texts of all test items.

The automaton holds, for every item, seeds of five words at every ninth word:
any 13 words that follow one another have a whole seed among them. Words are
spelt with two letters of 6 bits of their hash, so the automaton has about one
node for each word of the items. A text is scanned once; the windows around a
found seed are looked up among the distinct windows of the items, by one hash
each, and then compared word by word. The words that are hit are marked before
items are looked at, so a text costs what its words are, however many items
share a passage.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import flat, mix, slices, span_hashes, spans, stage, table, with_others_aside

WINDOW, SEED = 13, 5
#: Bytes of item texts for one automaton (README gives its size); more items are scanned in further passes of as many bytes each.
BLOCK_BYTES = 20_000_000

_NORMAL = np.full(256, 32, np.uint8)
_NORMAL[48:58] = np.arange(48, 58)
_NORMAL[65:91] = np.arange(97, 123)
_NORMAL[97:123] = np.arange(97, 123)
_NORMAL[128:] = np.arange(128, 256)
_TABLE = _NORMAL.tobytes()
_APART = _NORMAL == 32


def normal_words(text: bytes) -> list[bytes]:
    """Words of lower-cased letters A-Z, digits and bytes from 0x80."""
    return text.translate(_TABLE).split()


class Items:
    """The distinct windows of all items, each with the items that have it, and the automaton over their seeds.

    Items of the same words are one text with several ids, and equal windows
    of different items are one window; what a text is compared with
    is windows, so many items with a common passage cost no more than one.
    """

    def __init__(self, items: list[tuple[str, bytes]], length: int = WINDOW):
        self.length = length
        same: dict[bytes, list[str]] = {}
        for name, text in items:
            same.setdefault(b" ".join(normal_words(text)), []).append(name)
        same.pop(b"", None)
        self.ids = list(same.values())
        texts = list(same)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
        parts, k = [], 0
        while k < len(texts):  # about a megabyte at once: hashing takes some forty times that
            to = max(k + 1, int(np.searchsorted(offsets, offsets[k] + 1_000_000, "right")) - 1)
            data = self.data[offsets[k] : offsets[to]]
            starts, ends, at = spans(data, offsets[k : to + 1] - offsets[k], _APART)
            parts.append((starts + offsets[k], ends + offsets[k], np.diff(at), span_hashes(data, starts, ends)))
            k = to
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        self.starts, self.ends, words, hashes = (np.concatenate(x) for x in zip(*(parts or [none]), strict=True))
        first = np.append(0, np.cumsum(words)).astype(np.int64)
        self._windows(hashes, first, words)
        self._seeds(hashes, first, words)

    def _windows(self, hashes: np.ndarray, first: np.ndarray, words: np.ndarray) -> None:
        size = np.minimum(self.length, words)
        count = words - size + 1
        text = np.repeat(np.arange(len(words)), count)
        at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + first[text]
        value = rolled(prefixes(hashes), at, size[text])
        order = np.argsort(value, kind="stable")
        value = value[order]
        new = np.append(True, value[1:] != value[:-1])[: len(order)]
        #: by distinct window: its hash, first word in the items, number of words, and where its texts begin in ``texts``
        self.value, self.at, self.size = value[new], at[order][new], size[text[order]][new]
        self.group = np.append(np.flatnonzero(new), len(order))
        self.texts = text[order].astype(np.int32)

    def _seeds(self, hashes: np.ndarray, first: np.ndarray, words: np.ndarray) -> None:
        seed = min(SEED, self.length)
        self.stride = self.length - seed + 1
        letters = spelt(hashes)
        found: dict[str, int] = {}  # a seed, as it is spelt, and the lengths of windows (a bit each) that it stands for
        for begin, n in zip(first[:-1].tolist(), words.tolist(), strict=True):
            if n <= self.length:
                key = letters[begin : begin + min(seed, n)].tobytes().decode("latin-1")
                found[key] = found.get(key, 0) | 1 << n
            else:
                for k in range(begin, begin + n - seed + 1, self.stride):
                    key = letters[k : k + seed].tobytes().decode("latin-1")
                    found[key] = found.get(key, 0) | 1 << (self.length + 1)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for key, lengths in found.items():
            self.automaton.add_word(key, (lengths, len(key) // 2))
        if len(self.automaton):
            self.automaton.make_automaton()

    def windows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, number of the window) of all places in a batch of texts that hold a window of an item."""
        none = np.zeros(0, np.int64)
        if not len(self.automaton) or not len(starts):
            return none, none
        hashes = span_hashes(data, starts, ends)
        hits = [(end // 2 + 1 - size, lengths) for end, (lengths, size) in self.automaton.iter(spelt(hashes).tobytes().decode("latin-1"))]
        if not hits:
            return none, none
        begin, lengths = np.array(hits, np.int64).T
        sums = prefixes(hashes)
        places, numbers = [], []
        for n in range(1, self.length + 2):
            chosen = begin[lengths >> n & 1 == 1]
            if not len(chosen):
                continue
            if n > self.length:  # a seed of a longer item: every window around it
                edges = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edges, np.maximum(chosen - self.stride + 1, 0), 1)
                np.add.at(edges, chosen + 1, -1)
                place, size = np.flatnonzero(np.cumsum(edges[:-1]) > 0), self.length
            else:
                place, size = np.unique(chosen), n
            place = place[place + size <= at[np.searchsorted(at, place, "right").clip(max=len(at) - 1)]]
            value = rolled(sums, place, np.full(len(place), size))
            number = np.minimum(np.searchsorted(self.value, value), len(self.value) - 1)
            keep = (self.value[number] == value) & (self.size[number] == size)
            place, number = place[keep], number[keep]
            # equal hashes so far: now the words themselves
            same = self._same(data, starts, ends, place, number, size)
            places.append(place[same])
            numbers.append(number[same])
        return np.concatenate([none, *places]), np.concatenate([none, *numbers])

    def _same(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, place: np.ndarray, number: np.ndarray, size: int) -> np.ndarray:
        """Whether the ``size`` words from each place of the texts on are those of a window."""
        out = np.zeros(len(place), bool)
        for k in range(0, len(place), 20_000):
            word = (place[k : k + 20_000, None] + np.arange(size)).ravel()
            own = (self.at[number[k : k + 20_000], None] + np.arange(size)).ravel()
            n = ends[word] - starts[word]
            equal = n == self.ends[own] - self.starts[own]
            n = np.where(equal, n, 0)
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            letters = _NORMAL[data[np.repeat(starts[word], n) + inside]] == self.data[np.repeat(self.starts[own], n) + inside]
            wrong = np.bincount(np.repeat(np.arange(len(word)), n), ~letters, len(word)) > 0
            out[k : k + 20_000] = (equal & ~wrong).reshape(-1, size).all(axis=1)
        return out

    def items_in(self, text: np.ndarray, number: np.ndarray) -> np.ndarray:
        """(text, item text) pairs in rising order for the windows that were found in texts; an item text stands for ``ids[item text]``.

        A window counts once in a text, however often it occurs there.
        """
        text, number = np.unique(np.stack([text, number]), axis=1)
        count = self.group[number + 1] - self.group[number]
        k = np.repeat(self.group[number], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        return np.unique(np.stack([np.repeat(text, count), self.texts[k]]), axis=1)


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def prefixes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the word hashes times powers of an odd factor, up to each word, and the powers of its inverse."""
    n = len(hashes) + 1
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _FACTOR)]).astype(np.uint64))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, np.uint64(pow(int(_FACTOR), -1, 2**64)))]).astype(np.uint64))
    sums = np.zeros(n, np.uint64)
    np.cumsum(hashes * power[:-1], out=sums[1:])
    return sums, back


def rolled(sums: tuple[np.ndarray, np.ndarray], at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One hash for the ``size`` words from ``at`` on."""
    total, back = sums
    return mix((total[at + size] - total[at]) * back[at] + size.astype(np.uint64))


def spelt(hashes: np.ndarray) -> np.ndarray:
    """(words, 2) letters: 6 bits of the hash each; the first letter is from another alphabet than the second."""
    return np.stack([64 + (hashes & np.uint64(63)), hashes >> np.uint64(6) & np.uint64(63)], axis=1).astype(np.uint8)


_RUN = pa.struct([("word", pa.int64()), ("until", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_RUN_SQL = "array<struct<word:bigint,until:bigint,start:bigint,end:bigint>>"
_built: dict[str, Items] = {}


def _items(held, length: int) -> Items:
    """The automaton of a broadcast, built once in a worker process; an older one is let go."""
    name, items = held.value
    if name not in _built:
        _built.clear()
        _built[name] = Items(items, length)
    return _built[name]


def _scan(held, length: int, schema: list[str]):
    """One pass over the texts with one automaton; adds to the runs and items of the passes before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _items(held, length)
        for batch in slices(batches, "text"):
            data, offsets = flat(batch.column("text"))
            starts, ends, at = spans(data, offsets, _APART)
            counts = np.diff(at)
            runs, items = batch.column("matches").to_pylist(), batch.column("items").to_pylist()
            begin, number = found.windows(data, starts, ends, at)
            edges = np.zeros(len(starts) + 1, np.int64)
            np.add.at(edges, begin, 1)
            np.add.at(edges, begin + found.size[number], -1)
            hits = np.cumsum(edges[:-1]) > 0
            # the items come in after the words are marked
            text = np.searchsorted(at, begin, "right") - 1
            by_text = found.items_in(text, number)
            for k in np.unique(text).tolist():
                hit = hits[at[k] : at[k + 1]].copy()
                for r in runs[k]:
                    hit[r["word"] : r["until"]] = True
                edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                first, until = edge[::2], edge[1::2]
                begins, stops = starts[at[k] + first] - offsets[k], ends[at[k] + until - 1] - offsets[k]
                runs[k] = [dict(zip(("word", "until", "start", "end"), x, strict=True)) for x in zip(first.tolist(), until.tolist(), begins.tolist(), stops.tolist(), strict=True)]
                lo, hi = np.searchsorted(by_text[0], [k, k + 1])
                items[k] = sorted({name for i in by_text[1, lo:hi].tolist() for name in found.ids[i]}.union(items[k]))
            new = {"n_words": pa.array(counts, pa.int64()), "matches": pa.array(runs, pa.list_(_RUN)), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c) if c in batch.schema.names else None) for c in schema], names=schema)

    return run


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of at most ``block_bytes`` (one longer item goes alone), fetched partition by partition."""
    block, size = [], 0
    rows = benchmark.where("text IS NOT NULL").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.encode("text", "UTF-8").alias("text"))
    for row in rows.distinct().toLocalIterator():
        if block and size + len(row.text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row.item, bytes(row.text)))
        size += len(row.text)
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` and: n_words, n_hit, n_items, items (sorted as text), matches, contaminated.

    ``matches`` holds the runs of hit words: first word, the word after the
    last, and the byte offsets ``start`` and ``end`` in the original UTF-8
    text. A word in any occurrence of a window is hit; a document is
    contaminated if words are hit and they are a twentieth of its words at
    least.

    Items are read in blocks of ``block_bytes``, so the automaton that each
    worker process builds once has a fixed size bound; a text is scanned once, or
    once for each block beyond 20 MB of items, with a written table between the passes.
    There is no join and no shuffle. Null and wordless texts and items have no
    words; a null item_id is written as an empty string; repeated rows give
    repeated rows; without items nothing is hit. Extra columns stay, those
    that have the names of results are replaced.
    """
    names = ["n_words", "n_hit", "n_items", "items", "matches", "contaminated"]
    kept = [c for c in docs.columns if c not in names]
    out = docs.select(*kept, F.lit(0).cast("long").alias("n_words"), F.array().cast(_RUN_SQL).alias("matches"), F.array().cast("array<string>").alias("items"))
    for k, block in enumerate(item_blocks(benchmark, block_bytes)):
        if k:
            out = stage(out, "scanned")
        out = out.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block)), length, out.columns), out.schema)
    hit = F.aggregate("matches", F.lit(0).cast("long"), lambda n, m: n + m["until"] - m["word"])
    return (
        out.withColumn("n_hit", hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
        .select(*kept, *names)
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go."""
    items = table(spark, sf_dir, "benchmark")
    return with_others_aside(docs, ("doc_id", "text"), lambda d: contamination(d, items).where("NOT contaminated"))


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item_windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i + 1 : i + least(13, len(w))], ' ') AS win
  FROM (SELECT item, w, unnest(range(greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT r, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT r, i, n, item FROM doc_windows JOIN item_windows USING (n, win)),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
