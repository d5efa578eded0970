"""Near-duplicates against all pairs in plain Python."""

import random
import re

import pytest

from pulsejobs.llm.neardup import near_duplicate_stage, near_duplicates


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(docs, words, least):
    sets = {i: shingles(t, words) for i, t in docs}
    comp = {i: i for i in sets}
    ids = sorted(sets)

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= least * len(a | b):
                p, q = sorted((top(i), top(j)))
                comp[q] = p
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def corpus(seed, crowd):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(3))
    docs = [[word() for _ in range(r.randint(1, 60))] for _ in range(40)]
    shared = [word() for _ in range(30)]
    docs += [[*shared, *(word() for _ in range(r.randint(5, 60)))] for _ in range(40)]  # a common passage
    base = [word() for _ in range(60)]
    for _ in range(crowd):  # a crowd: each copy changes a few words, some too many
        d = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 2, 3, 4])):
            d[r.randrange(60)] = word()
        docs.append(d)
    chain = [word() for _ in range(80)]
    for _ in range(12):  # each version changes the one before
        chain = list(chain)
        chain[r.randrange(80)] = word()
        chain[r.randrange(80)] = word()
        docs.append(chain)
    texts = [" ".join(d) for d in docs]
    texts += [texts[0].upper(), texts[1].replace(" ", "\t\n"), "", "   ", None, "one", "ONE", "one two", "É é", "é É", "z " * 20000, "z " * 30000]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("words", "small", "crowd"), [(4, 64, 30), (5, 6, 90)])
def test_against_all_pairs(spark, words, small, crowd):
    docs = corpus(words, crowd)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as kept", "1 as component_id").repartition(5)
    out = near_duplicates(df, words, 80, small=small)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out.collect()}
    assert got == brute(docs, words, 80)


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "lonely text"), (3, None), (None, None)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 1, None, True), (3, 0, 3, True), (None, 0, None, True)], key=str)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stage_keeps_unrelated_texts_under_one_id_or_none(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdef"}
    rows = [(1, text["a"]), (1, text["b"]), (1, text["a"]), (2, text["a"]), (3, text["c"]), (None, text["d"]), (None, text["e"]), (None, text["e"]), (None, text["c"])]
    rows += [(1, None), (1, ""), (None, None), (4, text["f"] + " x"), (4, text["f"] + " y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = [(r.doc_id, r.text) for r in near_duplicate_stage(spark, df, "").collect()]
    want = [(1, text["a"]), (1, text["b"]), (3, text["c"]), (None, text["d"]), (None, text["e"]), (1, None), (1, ""), (None, None)]
    four = [x for x in out if x[0] == 4]
    assert len(four) == 1 and four[0] in rows  # two near copies under one id: one row stays
    assert sorted(map(repr, out)) == sorted(map(repr, want + four))
