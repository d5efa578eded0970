"""Grouping of spelling variants by a variable-length gram index (edit distance 1).

Words are padded on both sides and decomposed into grams of 2 to 5
characters: at each place the gram grows while it is frequent among the
words, so common grams become longer ones; a gram inside another is left out.
Only the frequent grams form the dictionary that tasks need.

What an edit at a place can change in this decomposition is bounded: grams
that start up to a full gram before it, and later ones that end within a
full gram after it. The largest number of grams that one edit of a word can
affect is its bound. A near word shares all other grams, at the same place
or, behind an inserted character, one further on; with the paddings at least
one is left. So two near words share one among the ``bound + 1`` rarest grams
of each, and only those lists are merged; what meets there is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import mix, stage, table

SHORTEST, LONGEST = 2, 5
#: A gram of more words than this is frequent, and no more than DICTIONARY grams are (12 bytes each).
FREQUENT, DICTIONARY = 100, 400_000
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: Characters of a long text that are searched at a time, up to the end of a run.
STRETCH = 4_000_000
_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}")
_END = re.compile("[^A-Za-zÀ-ÿ]")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- words


def _runs(text: str) -> Counter:
    """The maximal runs of letters that are long enough, with their numbers."""
    if len(text) <= STRETCH:
        return Counter(_RUN.findall(text))
    found, at = Counter(), 0
    while at < len(text):
        end = _END.search(text, min(at + STRETCH, len(text)))
        stop = end.start() if end else len(text)
        found.update(_RUN.findall(text, at, stop))
        at = stop
    return found


def words_of(doc_id: int | None, text: str) -> Iterator[tuple[str, int]]:
    """Lower-cased words of a text and how often each occurs, some without one character, as the crc32 of id and word decides. A null id is empty text."""
    prefix = b"%s:" % (b"" if doc_id is None else str(doc_id).encode())
    lowered: Counter = Counter()
    for run, n in _runs(text).items():
        lowered[run.encode().lower()] += n
    for raw, n in lowered.items():
        h = zlib.crc32(prefix + raw)
        word = raw.decode()
        if h % 31 == 0:
            k = h % len(word)
            word = word[:k] + word[k + 1 :]
        if len(word) >= LEAST_LENGTH:
            yield word, n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return made

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            if text.is_valid:
                for word, n in words_of(doc_id, text.as_py()):
                    counts[word] += n
                if len(counts) > 200_000:
                    yield out()
    if counts:
        yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: words of at least 7 characters that occur twice or more, of whole texts. Counted in the tasks first, so a frequent word is no hot key."""
    counted = docs.select("doc_id", "text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


# ---------------------------------------------------------------- grams


def padded(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length as rows, between paddings that no letter equals."""
    pad = LONGEST - 1
    out = np.empty((len(words), length + 2 * pad), np.uint64)
    out[:, :pad], out[:, pad + length :] = 1, 2
    out[:, pad : pad + length] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, length)
    return out


def gram_hashes(codes: np.ndarray) -> dict[int, np.ndarray]:
    """By gram length: a 64-bit number for the gram at each place. Numbers that collide make candidates, never losses."""
    n = codes.shape[1]
    h = mix(codes + np.uint64(77))
    found = {}
    for k in range(2, LONGEST + 1):
        h = mix(h[:, : n - k + 1] * _FACTOR + codes[:, k - 1 :])
        if k >= SHORTEST:
            found[k] = h
    return found


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    lengths = np.array([len(w) for w in words], np.int64)
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        yield length, at, [words[i] for i in at]


def decompose(codes: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kept, end, gram, count) by row and place: the variable-length grams of padded words; ``counts`` are those of the sorted ``frequent`` grams."""
    hashes = gram_hashes(codes)
    rows, n = codes.shape
    places = n - SHORTEST + 1
    size, count, gram = np.zeros((rows, places), np.int64), np.zeros((rows, places), np.int64), np.zeros((rows, places), np.uint64)
    grows = np.ones((rows, places), bool)
    for k in range(SHORTEST, LONGEST + 1):
        width = n - k + 1
        now = hashes[k]
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, now), len(frequent) - 1)
            known = np.where(frequent[at] == now, counts[at], 0)
        else:
            known = np.zeros(now.shape, np.int64)
        taken = grows[:, :width]
        size[:, :width][taken], count[:, :width][taken], gram[:, :width][taken] = k, known[taken], now[taken]
        longer = np.zeros_like(grows)
        longer[:, :width] = taken & (known > 0)
        grows = longer
    end = np.arange(places) + size
    kept = np.ones((rows, places), bool)
    kept[:, 1:] = end[:, 1:] > np.maximum.accumulate(end, axis=1)[:, :-1]
    return kept, end, gram, count


def affected_bound(kept: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """By row: how many of its grams one inserted, deleted or replaced character can affect at most."""
    place = np.arange(kept.shape[1])
    most = np.zeros(len(kept), np.int64)
    for i in range(LONGEST - 1, LONGEST + length):
        near = (place > i - LONGEST) & (place <= i) | (place > i) & (end <= i + LONGEST)
        most = np.maximum(most, (kept & near).sum(axis=1))
    return most


def rare_grams(words: list[str], length: int, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, gram) of the bound + 1 rarest grams of each word; ties by gram, then place, alike for all words."""
    kept, end, gram, count = decompose(padded(words, length), frequent, counts)
    place = np.broadcast_to(np.arange(kept.shape[1]), kept.shape)
    order = np.lexsort((place, gram, count, ~kept), axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, place, axis=1)
    row, at = np.nonzero(kept & (rank <= affected_bound(kept, end, length)[:, None]))
    return row, at, gram[row, at]


def _list_key(gram: np.ndarray, length: int, place: np.ndarray) -> np.ndarray:
    """The number of the list of a gram at a place of words of a length."""
    by_length = np.uint64(length * int(_FACTOR) % 2**64)
    return mix(gram + np.uint64(1_000_003) * place.astype(np.uint64) + by_length).view(np.int64)


def _letters(words: list[str]) -> np.ndarray:
    """64 bits: which characters a word has (by their code modulo 64). One edit changes two bits at most."""
    return np.array([_mask(w) for w in words], np.uint64).view(np.int64)


def _mask(word: str) -> int:
    m = 0
    for c in set(word):
        m |= 1 << (ord(c) & 63)
    return m


def _gram_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        gram, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])

    for batch in batches:
        for length, _, words in _by_length(batch.column("word").to_pylist()):
            held += [h.ravel() for h in gram_hashes(padded(words, length)).values()]
        if sum(map(len, held)) > 4_000_000:
            yield out()
    if held:
        yield out()


def gram_dictionary(words: DataFrame, frequent: int = FREQUENT, most: int = DICTIONARY) -> tuple[np.ndarray, np.ndarray]:
    """Frequent grams, sorted, and their numbers of occurrences.

    A gram is frequent when it occurs more than ``frequent`` times, or more
    than 1 / ``most`` of all occurrences if that is more: so there are
    never more than ``most`` of them, however large the vocabulary.
    """
    counted = stage(words.select("word").mapInArrow(_gram_counter, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = counted.where(F.col("n") > max(frequent, total // most)).toPandas()
    gram, n = found["gram"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(gram)
    return gram[order], n[order]


def _lister(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = shared.value
        for batch in batches:
            for length, at, words in _by_length(batch.column("word").to_pylist()):
                n, letters = batch.column("n").to_numpy()[at], _letters(words)
                row, place, gram = rare_grams(words, length, frequent, counts)
                keys = [_list_key(gram, length, place), _list_key(gram, length + 1, place), _list_key(gram, length + 1, place + 1)]
                rows = np.concatenate([row] * 3)
                seeks = np.repeat([False, True, True], len(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(seeks), pa.array(words, pa.string()).take(pa.array(rows)), pa.array(n[rows]), pa.array(letters[rows])], names=["key", "seeks", "word", "n", "letters"]
                )

    return run


def near_pairs(words: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """a, b, a_n, b_n: each pair of words (word, n; distinct words) at edit distance 1, once, in no order.

    A word stands in the lists of its rare grams and seeks, in those and in
    the lists of words that are one longer, its near words. Lists are join
    keys of Spark, so a long one is split by adaptive execution.
    """
    shared = words.sparkSession.sparkContext.broadcast(gram_dictionary(words, frequent))
    lists = stage(words.mapInArrow(_lister(shared), "key long, seeks boolean, word string, n long, letters long"), "gram-lists")
    a = lists.where("NOT seeks").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("letters").alias("a_letters"))
    b = lists.select("key", "seeks", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("letters").alias("b_letters"))
    same = a.join(
        b,
        (a["key"] == b["key"])
        & (b["seeks"] | (a["a"] < b["b"]))
        & (F.bit_count(a["a_letters"].bitwiseXOR(b["b_letters"])) <= 2)
        & (F.levenshtein(a["a"], b["b"], 1) == 1),
    )
    return same.select("a", "b", "a_n", "b_n").distinct()


def variant_forms(words: DataFrame, frequent: int = FREQUENT, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n, root of distinct words (word, n).

    ``form`` is the near word of largest n (of equals the first in code-point
    order) if its n is at least ``times`` the word's; ``root`` follows the
    forms to the last. Forms grow tenfold each, so a chain is short; it is
    followed by doubling. Words without a near word keep their row.
    """
    words = stage(words.select("word", "n"), "words")
    pairs = near_pairs(words, frequent)
    ends = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m")))).alias("e")
    best = pairs.select(ends).select("e.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("form"))).alias("best"))
    joined = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best.form", (-F.col("best.m")).alias("form_n"))
    rare = F.col("form_n") >= F.col("n") * times
    rows = stage(joined.withColumns({"form": F.when(rare, F.col("form")), "form_n": F.when(rare, F.col("form_n"))}), "forms")
    links = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = stage(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        links = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their variant groups. Null texts have no words; a null doc_id counts as an empty one; repeated rows count each; an empty table gives an empty one."""
    return variant_forms(vocabulary(table(spark, sf_dir, "documents")))


OP12_SQL = """
WITH RECURSIVE steps AS (
  SELECT n, list_reduce(list_concat([n::BIGINT], range(8)),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) r(n)),
crc_table AS (SELECT list(v ORDER BY n) AS t FROM steps),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
lowered AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(
      list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda p: ('0x' || p)::BIGINT)),
      lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295)::BIGINT AS h
  FROM lowered, crc_table),
made AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min_by(other, (-m, encode(other))) AS form, max(m) AS m FROM pairs GROUP BY word),
forms AS MATERIALIZED (
  SELECT words.word, words.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 10 * words.n THEN form END AS form, CASE WHEN m >= 10 * words.n THEN m END AS form_n
  FROM words LEFT JOIN best ON best.word = words.word),
walk AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT walk.word, forms.word, forms.form FROM walk JOIN forms ON forms.word = walk.next)
SELECT forms.word, forms.form, walk.root, forms.n, forms.n_near, forms.form_n
FROM forms JOIN walk ON walk.word = forms.word AND walk.next IS NULL
"""
