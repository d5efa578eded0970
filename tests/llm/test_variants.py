"""Spelling variants against all pairs, and the affected-gram bound against every edit."""

import random
import zlib

import duckdb
import numpy as np
import pytest

from pulsejobs.llm import variants

DATA = "/root/testdata/sf0.001"


def near(a: str, b: str) -> bool:
    """Edit distance exactly 1."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def family(seed: int, n: int, letters: str = "abée") -> list[str]:
    """Words with many near words among them: edits of edits."""
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(7, 12))) for _ in range(n // 4)}
    pool = sorted(words)
    while len(words) < n:
        w = rng.choice(pool)
        i = rng.randrange(len(w) + 1)
        w = rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :]])
        if len(w) >= 7 and w not in words:
            words.add(w)
            pool.append(w)
    return sorted(words)


def grams(word: str, frequent, counts):
    codes = variants.padded([word], len(word))
    kept, end, gram, _ = variants.decompose(codes, frequent, counts)
    bound = variants.affected_bound(kept, end, len(word))[0]
    return {(int(p), int(gram[0, p])) for p in np.flatnonzero(kept[0])}, int(bound)


@pytest.mark.parametrize("limit", [0, 2, 20])
def test_an_edit_affects_no_more_than_the_bound(limit):
    words = family(1, 150)
    every = np.concatenate([h.ravel() for w in words for h in variants.gram_hashes(variants.padded([w], len(w))).values()])
    found, n = np.unique(every, return_counts=True)
    frequent, counts = found[n > limit], n[n > limit]
    rng = random.Random(2)
    for w in words:
        own, bound = grams(w, frequent, counts)
        assert len(own) > bound  # at least one gram is left
        for _ in range(12):
            i = rng.randrange(len(w) + 1)
            for edited, shift in ((w[:i] + "z" + w[i:], 1), (w[:i] + w[i + 1 :], -1), (w[:i] + "z" + w[i + 1 :], 0)):
                if len(edited) >= 7 and edited != w:
                    other, _ = grams(edited, frequent, counts)
                    assert sum((p, g) in other or (p + shift, g) in other for p, g in own) >= len(own) - bound


def test_every_near_pair_is_found_once(spark):
    words = family(4, 700)
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    want = {frozenset((a, b)) for i, a in enumerate(words) for b in words[:i] if near(a, b)}
    for frequent in (0, 5, 100):
        got = [frozenset((r["a"], r["b"])) for r in variants.near_pairs(df, frequent).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_forms_and_roots(spark):
    rows = [("letters", 1000), ("lettres", 2), ("letterz", 100), ("lettarz", 10), ("lettarx", 9), ("aetters", 1000), ("alone-ish".replace("-", ""), 5), ("xletters", 3), ("letter", 99999)]
    out = {r["word"]: r for r in variants.variant_forms(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert (out["lettarz"]["form"], out["lettarz"]["root"]) == ("letterz", "letter")  # lettarz - letterz - letters - letter
    assert (out["letters"]["form"], out["letters"]["form_n"], out["letters"]["root"]) == ("letter", 99999, "letter")
    assert (out["lettarx"]["form"], out["lettarx"]["n_near"], out["lettarx"]["root"]) == (None, 1, "lettarx")  # 10 < 10 * 9
    assert (out["aloneish"]["n_near"], out["aloneish"]["form"], out["aloneish"]["root"]) == (0, None, "aloneish")
    assert out["xletters"]["form"] == "letters"
    tie = [("abcdefgh", 50), ("zbcdefgh", 50), ("ebcdefgh", 5), ("ébcdefgh", 50)]
    assert {r["word"]: r["form"] for r in variants.variant_forms(spark.createDataFrame(tie, "word string, n long")).collect()}["ebcdefgh"] == "abcdefgh"


def test_words_of_texts(monkeypatch):
    text = "Straße ÉCHELLE échelle Weltwunder weltwunder short×short÷xx 0123456 " * 3
    whole = dict(variants.words_of(12, text))
    monkeypatch.setattr(variants, "STRETCH", 5)
    assert dict(variants.words_of(12, text)) == whole
    want: dict[str, int] = {}
    for run, n in (("Échelle", 3), ("échelle", 3), ("weltwunder", 6), ("short\u00d7short\u00f7xx", 3)):
        h = zlib.crc32(f"12:{run}".encode())
        word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
        if len(word) >= 7:
            want[word] = want.get(word, 0) + n
    assert whole == want


def test_small_tables(spark):
    rows = [(1, "abcdefg abcdefg abcdefh", 9), (1, "abcdefg abcdefg abcdefh", 9), (2, None, 1), (3, "", 2), (None, "abcdefg", None), (4, "qwertyu " * 200_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word long")
    out = {r["word"]: r["n"] for r in variants.variant_forms(variants.vocabulary(docs)).collect()}
    want: dict[str, int] = {}
    for i, text, _ in rows:
        for word, n in variants.words_of(i, text or ""):
            want[word] = want.get(word, 0) + n
    assert out == {w: n for w, n in want.items() if n >= 2}
    assert variants.variant_forms(variants.vocabulary(docs.limit(0))).collect() == []


def test_query_gives_the_rows_of_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    theirs = con.execute(variants.OP12_SQL).fetchall()
    ours = [tuple(r) for r in variants.op12_spelling_variants(spark, DATA).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert sorted(ours, key=str) == sorted(theirs, key=str) and len(ours) > 100
