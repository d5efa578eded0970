"""Encoding texts to the ids of a SentencePiece BPE model and back, by vectorised merge rounds.

The model file is read on the driver only; its tables (at most a few MB,
bounded by the size of the vocabulary) go to the tasks as a broadcast. A text
is cut where no piece of the vocabulary holds the two characters side by side,
so no merge can ever cross a cut. The distinct words of a slice of texts are
then merged together, all in flat numpy arrays: in each round every word finds
the smallest rank among its pairs, all leftmost occurrences of it are merged
at once, the arrays are compacted, and words without a pair leave.

A round gives what the library's queue gives, which takes the best pair, the
leftmost of equals: merging a piece at one place can only disturb its other
places if the merge makes a pair that is at least as good. Pieces with which
that can happen (``once`` in the tables) are merged one place a round.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import slices, table, widened

SPACE = "▁"
#: Words of more symbols (text without any cut, such as a page of blanks) are merged by a queue, in n log n steps.
LONG_WORD = 1024
#: Characters of a text that are in arrays at a time; a longer text goes in stretches that end at a cut.
STRETCH = 2_000_000
_NONE = np.int32(2**31 - 1)
_KEY = np.int64(1 << 22)


@dataclass(frozen=True)
class Tables:
    """What encoding and decoding need of a model. Symbols are ids of pieces; characters that only occur inside pieces, or in none, come after them."""

    chars: np.ndarray  # sorted code points that occur in pieces
    char_ids: np.ndarray  # the symbol of each
    kinds: np.ndarray  # by code point: its place in chars, or their number
    beside: np.ndarray  # bool (chars + 1, chars + 1): the two stand side by side in some piece; the last is any other character
    keys: np.ndarray  # sorted left * 2**22 + right of the pairs that merge
    made: np.ndarray  # the piece of each
    ranks: np.ndarray  # 0 is the best score; equal scores are equal
    once: np.ndarray  # bool by id: one place a round
    size: int  # ids of the vocabulary
    byte_ids: np.ndarray  # ids of the 256 byte pieces
    surfaces: list[bytes]  # UTF-8 by id, blanks for the space mark
    bytes_of: np.ndarray  # by id: the byte of a byte piece, else -1
    spaced: np.ndarray  # bool by id: the piece begins with the space mark


def read_tables(model: bytes) -> Tables:
    """Tables of a serialized model; ValueError for what this module does not do."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.ParseFromString(model)
    n, t = m.normalizer_spec, m.trainer_spec
    kinds = {p.type for p in m.pieces}
    if t.model_type != t.BPE or not t.byte_fallback or t.treat_whitespace_as_suffix or kinds - {1, 2, 3, 6}:
        raise ValueError("only BPE models with byte fallback, leading space marks and no user-defined pieces")
    if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not n.escape_whitespaces:
        raise ValueError("only the identity normalization with a dummy prefix, blanks kept and escaped")
    normal = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 1}
    score = {x: m.pieces[i].score for x, i in normal.items()}
    best_first = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
    alphabet = sorted(set("".join(normal)) | {SPACE})
    symbol = dict(normal)
    for c in alphabet:
        symbol.setdefault(c, len(m.pieces) + alphabet.index(c))
    place = {c: k for k, c in enumerate(alphabet)}
    beside = np.zeros((len(alphabet) + 1,) * 2, bool)
    pairs, once = {}, np.zeros(len(m.pieces) + len(alphabet), bool)
    for piece, i in normal.items():
        for left, right in zip(piece, piece[1:]):
            beside[place[left], place[right]] = True
        for k in range(1, len(piece)):
            left, right = piece[:k], piece[k:]
            if left in symbol and right in symbol:
                pairs[symbol[left] * int(_KEY) + symbol[right]] = (i, best_first[score[piece]])
                for part in (left, right):
                    once[symbol[part]] |= len(part) > 1 and score[piece] >= score[part]
    keys = np.array(sorted(pairs), np.int64)
    kinds = np.full(0x110000, len(alphabet), np.int32)
    kinds[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
    byte_ids = np.zeros(256, np.int32)
    bytes_of = np.full(len(m.pieces), -1, np.int16)
    surfaces = []
    for i, p in enumerate(m.pieces):
        if p.type == 6:
            bytes_of[i] = int(p.piece[3:5], 16)
            byte_ids[bytes_of[i]] = i
        surfaces.append((t.unk_surface if p.type == 2 else "" if p.type in (3, 6) else p.piece.replace(SPACE, " ")).encode())
    return Tables(
        np.array([ord(c) for c in alphabet], np.uint32), np.array([symbol[c] for c in alphabet], np.int32), kinds, beside,
        keys, np.array([pairs[k][0] for k in keys.tolist()], np.int32), np.array([pairs[k][1] for k in keys.tolist()], np.int32), once,
        len(m.pieces), byte_ids, surfaces, bytes_of, np.array([p.type == 1 and p.piece.startswith(SPACE) for p in m.pieces]),
    )


# ---------------------------------------------------------------- merging


def _look_up(t: Tables, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and piece of each pair; rank _NONE where the two do not merge."""
    key = left.astype(np.int64) * _KEY + right
    at = np.minimum(np.searchsorted(t.keys, key), len(t.keys) - 1)
    good = t.keys[at] == key
    return np.where(good, t.ranks[at], _NONE).astype(np.int32), t.made[at]


def _queue(t: Tables, symbols: list[int]) -> list[int]:
    """One long word by a queue of pairs: best score first, the leftmost of equals."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = {k: (r, p) for k, r, p in zip(t.keys.tolist(), t.ranks.tolist(), t.made.tolist(), strict=True)}
    pair = lambda i, j: symbols[i] * int(_KEY) + symbols[j]
    queue = [(rank[k][0], i, k) for i in range(n - 1) if (k := pair(i, i + 1)) in rank]
    heapq.heapify(queue)
    gone = bytearray(n)
    while queue:
        _, i, k = heapq.heappop(queue)
        if gone[i] or after[i] == n or pair(i, after[i]) != k:
            continue
        j = after[i]
        symbols[i], gone[j], after[i] = rank[k][1], 1, after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (q := pair(a, b)) in rank:
                heapq.heappush(queue, (rank[q][0], a, q))
    return [s for i, s in enumerate(symbols) if not gone[i]]


def merge_words(t: Tables, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of words end to end, and their lengths, after all merges."""
    words = len(lengths)
    done: list[tuple[np.ndarray, np.ndarray]] = []  # word numbers, one for each symbol, and the symbols
    word = np.repeat(np.arange(words), lengths)
    for w in np.flatnonzero(lengths > LONG_WORD):
        at = slice(int(np.searchsorted(word, w)), int(np.searchsorted(word, w, "right")))
        merged = np.array(_queue(t, symbols[at].tolist()), np.int32)
        done.append((np.full(len(merged), w), merged))
    short = np.repeat(lengths <= LONG_WORD, lengths)
    symbols, word = symbols[short], word[short]
    rank, made = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int32)
    if len(symbols) > 1:
        rank[:-1], made[:-1] = _look_up(t, symbols[:-1], symbols[1:])
        rank[:-1][word[:-1] != word[1:]] = _NONE
    while len(symbols):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        size = np.diff(np.append(first, len(word)))
        best = np.minimum.reduceat(rank, first)
        if (best == _NONE).any():  # words without a pair leave
            out = np.repeat(best == _NONE, size)
            done.append((word[out], symbols[out]))
            symbols, word, rank, made = symbols[~out], word[~out], rank[~out], made[~out]
            first, size, best = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else word, size[best < _NONE], best[best < _NONE]
            if not len(word):
                break
        hit = np.flatnonzero(rank == np.repeat(best, size))
        lone = np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])  # the leftmost of its word
        number = np.arange(len(hit))
        # of hits in a row every second one overlaps its predecessor; from the first careful piece of a word on, hits wait
        row = np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(hit) > 1]), number, 0))
        careful = np.concatenate([[0], np.cumsum(t.once[made[hit]])])
        head = np.maximum.accumulate(np.where(lone, number, 0))
        at = hit[lone | ((number - row) % 2 == 0) & (careful[1:] == careful[head])]
        symbols[at] = made[at]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        place = np.cumsum(stay) - 1
        symbols, word, rank, made = symbols[stay], word[stay], rank[stay], made[stay]
        at = place[at]
        changed = np.zeros(len(word), bool)
        changed[at] = changed[at[at > 0] - 1] = True
        rank[changed] = _NONE
        new = np.flatnonzero(changed[:-1])
        new = new[word[new] == word[new + 1]]
        rank[new], made[new] = _look_up(t, symbols[new], symbols[new + 1])
    if not done:
        return symbols, lengths
    every, tokens = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
    order = np.argsort(every, kind="stable")
    return tokens[order], np.bincount(every, minlength=words)


# ---------------------------------------------------------------- texts to ids


def _hashes(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit number for each stretch: sums of odd factors by place times values."""
    inside = np.arange(len(values)) - np.repeat(starts, lengths)
    factor = (inside.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    factor ^= factor >> np.uint64(29)
    term = (values.astype(np.uint64) + np.uint64(0x5851F42D)) * factor
    term ^= term >> np.uint64(31)
    return np.add.reduceat(term * np.uint64(0xD6E8FEB86659FD93), starts)


def encode_codes(t: Tables, codes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts (code points end to end, with the space mark in place of blanks), and how many each has. ``edges`` are their n + 1 limits."""
    texts = len(edges) - 1
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(texts, np.int64)
    kind = t.kinds[codes]
    known = kind < len(t.chars)
    cut = np.concatenate([[True], ~t.beside[kind[:-1], kind[1:]]])
    cut[edges[:-1][edges[:-1] < len(codes)]] = True
    starts = np.flatnonzero(cut)
    lengths = np.diff(np.append(starts, len(codes)))
    # characters of no piece: symbols past all others, which merge with nothing
    symbols = np.where(known, t.char_ids[np.minimum(kind, len(t.chars) - 1)], np.int32(len(t.once)) + codes.astype(np.int32))
    _, some, which = np.unique(_hashes(codes, starts, lengths), return_index=True, return_inverse=True)
    # equal hashes are looked at: a word that differs from its representative stands for itself
    like = lengths[some][which] == lengths
    inside = np.arange(len(codes)) - np.repeat(starts, lengths)
    twin = np.minimum(np.repeat(starts[some][which], lengths) + inside, len(codes) - 1)
    like &= np.logical_and.reduceat(codes[twin] == codes, starts)
    odd = np.flatnonzero(~like)
    which[odd] = len(some) + np.arange(len(odd))
    some = np.concatenate([some, odd])
    size = lengths[some]
    merged, n = merge_words(t, symbols[np.repeat(starts[some] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())].astype(np.int32), size)
    # characters that are no ids become their UTF-8 bytes
    lost = np.flatnonzero(merged >= t.size)
    if len(lost):
        raw = [chr(int(s) - len(t.once) if s >= len(t.once) else int(t.chars[s - t.size])).encode() for s in merged[lost].tolist()]
        wide = np.ones(len(merged), np.int64)
        wide[lost] = [len(x) for x in raw]
        owner = np.repeat(np.repeat(np.arange(len(n)), n), wide)
        is_byte = np.repeat(merged >= t.size, wide)
        merged = np.repeat(merged, wide)
        merged[is_byte] = t.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        n = np.bincount(owner, minlength=len(n))
    base = np.concatenate([[0], np.cumsum(n)])
    count = n[which]
    total = np.concatenate([[0], np.cumsum(count)])
    ids = merged[np.repeat(base[which] - total[:-1], count) + np.arange(total[-1])]
    limits = np.searchsorted(starts, edges)
    return ids.astype(np.int32), total[limits[1:]] - total[limits[:-1]]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def encode_texts(t: Tables, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids end to end and their number by text. An empty text has none; any other gets the dummy prefix."""
    marked = [SPACE + x.replace(" ", SPACE) if x else "" for x in texts]
    if sum(map(len, marked)) <= STRETCH:
        return encode_codes(t, _codes("".join(marked)), np.concatenate([[0], np.cumsum([len(x) for x in marked])]))
    ids, counts = [], []
    for text in marked:
        at, n = 0, 0
        while at < len(text):
            stop = at + STRETCH
            while (end := _cut_before(t, text, at, stop)) is None:
                stop += STRETCH
            found, k = encode_codes(t, _codes(text[at:end]), np.array([0, end - at]))
            ids.append(found)
            at, n = end, n + int(k[0])
        counts.append(n)
    return np.concatenate([*ids, np.zeros(0, np.int32)]), np.array(counts, np.int64)


def _cut_before(t: Tables, text: str, at: int, stop: int) -> int | None:
    """The last cut in (at, stop], or the end of the text if that is not beyond; None without a cut."""
    if stop >= len(text):
        return len(text)
    kind = t.kinds[_codes(text[at : stop + 1])]
    cuts = np.flatnonzero(~t.beside[kind[:-1], kind[1:]])
    return at + int(cuts[-1]) + 1 if len(cuts) else None


# ---------------------------------------------------------------- ids to texts


def _utf8(raw: bytes) -> str:
    """Bytes as text; each byte that is in no valid character gives one replacement character."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as x:
            out.append(raw[at : at + x.start].decode())
            out.append("�")
            at += x.start + 1
    return "".join(out)


def decode_ids(t: Tables, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """Texts of id lists that lie end to end: surfaces of the pieces, byte pieces as UTF-8, without the dummy prefix. IndexError for ids outside the vocabulary."""
    if len(ids) and (ids.min() < 0 or ids.max() >= t.size):
        raise IndexError("id outside the vocabulary")
    sizes = np.array([len(x) for x in t.surfaces], np.int64)
    pool = np.frombuffer(b"".join(t.surfaces), np.uint8)
    base = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    is_byte = t.bytes_of[ids] >= 0
    wide = np.where(is_byte, 1, sizes[ids])
    limits = np.concatenate([[0], np.cumsum(wide)])
    flat = np.zeros(limits[-1], np.uint8)
    source = np.repeat(np.where(is_byte, 0, base[ids]) - limits[:-1], wide) + np.arange(limits[-1])
    flat[:] = pool[np.minimum(source, max(len(pool) - 1, 0))] if len(pool) else 0
    flat[limits[:-1][is_byte]] = t.bytes_of[ids[is_byte]].astype(np.uint8)
    ends = np.concatenate([[0], np.cumsum(counts)])
    out, raw = [], flat.tobytes()
    for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        a, b = int(limits[lo]), int(limits[hi])
        begun = lo
        while begun < hi and not wide[begun]:  # begin and end marks
            begun += 1
        if begun < hi and t.spaced[ids[begun]]:
            a += 1
        try:
            if wide[lo:hi].all():
                out.append(raw[a:b].decode())
                continue
        except UnicodeDecodeError:
            pass
        out.append(_with_bytes(t, ids[lo:hi], raw, limits[lo : hi + 1], a))
    return out


def _with_bytes(t: Tables, ids: np.ndarray, raw: bytes, limits: np.ndarray, start: int) -> str:
    """A text with broken byte pieces, or with marks that part them: each run of them is read on its own."""
    is_byte = t.bytes_of[ids] >= 0
    turn = np.flatnonzero(np.diff(is_byte)) + 1
    stops = [0, *turn.tolist(), len(ids)]
    return "".join(_utf8(raw[max(int(limits[i]), start) : int(limits[j])]) for i, j in zip(stops[:-1], stops[1:], strict=True) if limits[j] > start)


# ---------------------------------------------------------------- tables


def _encoder(shared, column: str, ids: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in slices(batches, column, 1_000_000):
            found, counts = encode_texts(t, [x or "" for x in batch.column(column).to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(found, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, ids])

    return run


def _decoder(shared, ids: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for whole in batches:
            at = 0
            sizes = np.cumsum(whole.column(ids).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            while at < whole.num_rows:
                before = int(sizes[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, before + 1_000_000, "right")))
                batch, at = whole.slice(at, to - at), to
                lists = batch.column(ids)
                counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                found = decode_ids(t, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
                none = lists.is_null().to_pylist()
                texts = pa.array([None if m else x for x, m in zip(found, none, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, text])

    return run


def share_tables(spark: SparkSession, model: str):
    """The tables of a model file that the driver can read, as a broadcast: their size is bounded by the vocabulary."""
    return spark.sparkContext.broadcast(read_tables(Path(model).read_bytes()))


def encode(df: DataFrame, shared, column: str = "text", ids: str = "ids") -> DataFrame:
    """All rows and columns of ``df`` and ``ids``, array<int>: the ids of the whole text, without begin and end marks.

    A null or empty text has no ids. A column that is named like ``ids`` is
    replaced. Rows are on their own: no shuffle; repeated rows stay; an empty
    table gives an empty table. Texts of any length are taken in stretches.
    ``shared`` comes from :func:`share_tables`.
    """
    return widened(df, lambda c: _encoder(shared, c, "made"), column, ids, "array<int>")


def decode(df: DataFrame, shared, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All rows and columns of ``df`` and ``text``, what the ids stand for; null for null, empty for none. A column named like ``text`` is replaced."""
    return widened(df, lambda c: _decoder(shared, c, "made"), ids, text, "string")


def op13_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Digests of the ids of every whole text and of what they decode to. ``model`` is a path; by default the public 32k BPE vocabulary."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    shared = share_tables(spark, model)
    coded = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), shared).drop("text"), shared)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
