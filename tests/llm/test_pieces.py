"""Ids and texts of the SentencePiece operator against the library itself."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

spm = pytest.importorskip("sentencepiece")
vocabularies = pytest.importorskip("public_tokenizers")

from pulsejobs.llm import pieces  # noqa: E402

MODEL = vocabularies.path("piece_bpe_32k.model")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return spm.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def tables():
    with open(MODEL, "rb") as f:
        return pieces.read_tables(f.read())


def texts_at_random(n: int) -> list[str]:
    rng = random.Random(7)
    parts = [*"aeinorst hl \n\té日本語한ß01239.,;-=▁\x00\U0001f600", "the ", " and", "  ", "     ", "----", "====", "aaaa", "\n\n\n", "<s>", "<0x0A>", "�", "</s>"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(80))) for _ in range(n)]


def lists(ids, counts):
    ends = np.cumsum(counts)
    return [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)]


def test_ids_are_those_of_the_library(library, tables):
    texts = [*texts_at_random(1500), "", " ", "x" * 3000, " " * 3000, "a" + " " * 40 + "b", "-" * 1500 + "=" * 1500, *[" " * k for k in range(40)]]
    ids, counts = pieces.encode_texts(tables, texts)
    assert lists(ids, counts) == library.encode(texts)
    assert pieces.decode_ids(tables, ids, counts) == [library.decode(x) for x in library.encode(texts)]


def test_rounds_and_queue_agree(tables, monkeypatch):
    texts = [*texts_at_random(200), " " * 700, "ab" * 400]
    by_rounds = pieces.encode_texts(tables, texts)
    monkeypatch.setattr(pieces, "LONG_WORD", 3)
    by_queue = pieces.encode_texts(tables, texts)
    assert all((a == b).all() for a, b in zip(by_rounds, by_queue, strict=True))


def test_stretches_change_nothing(tables, monkeypatch):
    texts = [" ".join(texts_at_random(60)), "日本" * 900, "x" * 2000]
    whole = pieces.encode_texts(tables, texts)
    monkeypatch.setattr(pieces, "STRETCH", 100)
    cut = pieces.encode_texts(tables, texts)
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))


def test_any_ids_decode_as_the_library_does(library, tables):
    rng = random.Random(3)
    every = [[rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3)]) for _ in range(rng.randrange(14))] for _ in range(1500)]
    found = pieces.decode_ids(tables, np.array([i for x in every for i in x]), np.array([len(x) for x in every]))
    assert found == [library.decode(x) for x in every]


def test_equal_hashes_are_looked_at(library, tables, monkeypatch):
    monkeypatch.setattr(pieces, "_hashes", lambda values, starts, lengths: np.zeros(len(starts), np.uint64))
    texts = ["one two three", "four five"]
    assert lists(*pieces.encode_texts(tables, texts)) == library.encode(texts)


def test_ids_outside_the_vocabulary_are_an_error(tables):
    with pytest.raises(IndexError):
        pieces.decode_ids(tables, np.array([40000]), np.array([1]))


def test_tables_with_nulls_repeats_and_clashing_names(spark, library):
    rows = [(1, "some words", 5, "x"), (1, "some words", 5, "x"), (2, None, None, None), (None, "", 7, "y"), (3, "long " * 300_000, 0, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long, `odd.name` string")
    shared = pieces.share_tables(spark, MODEL)
    out = pieces.decode(pieces.encode(df, shared), shared).collect()
    assert sorted(r["doc_id"] or 0 for r in out) == [0, 1, 1, 2, 3]
    for r in out:
        assert r["ids"] == (library.encode(r["text"]) if r["text"] else [])
        assert r["decoded"] == (r["text"] or "")
        assert r["odd.name"] in ("x", "y", "z", None)
    assert pieces.encode(df.limit(0), shared).collect() == []
    assert pieces.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), shared).where("decoded IS NULL").count() == 1


def test_query_on_its_table(spark, library):
    found = {r["doc_id"]: r for r in pieces.op13_sentencepiece(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(found) == len(docs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for d in docs:
        ids = library.encode(d["text"])
        assert tuple(found[d["doc_id"]])[1:] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
