"""Inputs in which one passage, row or name is everywhere."""

import resource
import time

import numpy as np
from pyspark.sql import functions as F

from pulsejobs.llm import langid, mixing
from pulsejobs.llm import pseudonyms as pii
from pulsejobs.llm.decontamination import _APART, Items, contamination, normal_words
from pulsejobs.llm.shared import flat, spans


def plain_windows(words, items, length=13):
    """Which words are in a window of an item, and which items have one, by looking at every place."""
    hit, found = [False] * len(words), set()
    for name, text in items:
        own = normal_words(text)
        n = min(length, len(own))
        for k in range(len(own) - n + 1 if own else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == own[k : k + n]:
                    hit[i : i + n] = [True] * n
                    found.add(name)
    return hit, found


def scan(items, texts):
    import pyarrow as pa

    found = Items(items)
    data, offsets = flat(pa.array(texts, pa.binary()))
    starts, ends, at = spans(data, offsets, _APART)
    begin, number = found.windows(data, starts, ends, at)
    hit = np.zeros(len(starts), bool)
    for b, n in zip(begin, found.size[number], strict=True):
        hit[b : b + n] = True
    place, item = found.items_in(np.searchsorted(at, begin, "right") - 1, number)
    names = [{x for t in item[place == k].tolist() for x in found.ids[t]} for k in range(len(texts))]
    return [hit[at[k] : at[k + 1]].tolist() for k in range(len(texts))], names


def test_windows_of_items_that_overlap_in_many_ways():
    rng = np.random.default_rng(8)
    word = lambda: f"w{rng.integers(0, 4)}"
    base = [word() for _ in range(60)]
    items = [(f"i{k}", " ".join(base[(a := int(rng.integers(0, 40))) : a + int(rng.integers(1, 30))] + [word() for _ in range(int(rng.integers(0, 4)))]).encode()) for k in range(40)]
    items += [("same", items[0][1]), ("Same", items[0][1].upper()), ("none", b" . ,"), ("long", b"w1 " * 40)]
    texts = [" ".join(base[5:50] + [word() for _ in range(30)]).encode(), b"", b"w1; W1! " * 30, " ".join(word() for _ in range(200)).encode(), b"w2"]
    hits, names = scan(items, texts)
    for text, hit, found in zip(texts, hits, names, strict=True):
        assert (hit, found) == plain_windows(normal_words(text), items)


def test_many_items_with_one_beginning():
    stem = [f"stem{i}" for i in range(14)]
    items = [(f"item{k}", " ".join([*stem, f"end{k}", f"more{k}"]).encode()) for k in range(2000)]
    text = (" ".join(stem) + " apart. ").encode() * 2000
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    hits, names = scan(items, [text])
    assert time.time() - began < 5 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000
    assert hits[0] == ([True] * 14 + [False]) * 2000 and len(names[0]) == 2000


def test_repeated_items_and_rows(spark):
    item = " ".join(f"x{i}" for i in range(30))
    bench = spark.createDataFrame([(f"q{k}", item) for k in range(300)] + [(None, item), ("q1", item)], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"before {item} after " * 50)] * 3, "doc_id long, text string")
    for r in contamination(docs, bench).collect():
        assert (r.n_items, r.n_hit, r.n_words, r.contaminated) == (301, 1500, 1600, True)


def test_a_language_of_repeated_rows_is_learned(spark, monkeypatch):
    seen = {}
    fit = langid.fit
    monkeypatch.setattr(langid, "fit", lambda windows, labels, names: seen.update(zip(names, np.bincount(labels, minlength=len(names)).tolist(), strict=True)) or fit(windows, labels, names))
    rows = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("der schnelle braune fuchs läuft weiter").alias("text"), F.lit("de").alias("lang"))
    assert langid.train(rows, n_docs=50, n_windows=60).labels == ["de"] and seen == {"de": 1}
    other = spark.createDataFrame([(i, f"the quick fox number {i} went on and on with words", "en") for i in range(400)], "doc_id long, text string, lang string")
    for few in (20, 700):
        assert langid.train(rows.union(other), n_docs=few, n_windows=1000).labels == ["de", "en"]
        assert seen == {"de": 1, "en": min(few, 400)}


def test_pseudonyms_leave_all_other_columns(spark):
    df = spark.createDataFrame([(1, "call 212-555-0100", 2, 3, 4, 5, "old", 6), (1, "call 212-555-0100", 2, 3, 4, 5, "old", 6), (None, None, None, None, None, None, None, None)], "doc_id long, text string, _values int, _made int, _items int, _mixed int, found string, `_pii.x` int")
    out = pii.pseudonymise(df, "k").collect()
    assert len(out) == 3
    for r in out:
        if r.doc_id:
            assert (r._values, r._made, r._items, r._mixed, r["_pii.x"]) == (2, 3, 4, 5, 6) and len(r.found) == 1 and r.text != "call 212-555-0100"
        else:
            assert r.text is None and r.found == []


def test_five_thousand_sources_meet_their_targets(spark):
    names = ["en", "en", "en", "de", "fr", "es", None]
    rows = spark.range(60_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot.example")).otherwise(F.concat(F.lit("site"), (F.col("id") % 5003).cast("string"))).alias("source"),
        F.element_at(F.array(*[F.lit(x) for x in names]), (F.xxhash64("id") % 7 + 7).cast("int") % 7 + 1).alias("lang"), F.expr("repeat('word ', 3 + CAST(id % 11 AS INT) * 40)").alias("text"), F.lit(1).alias("mix_factor0"),
    )
    out = mixing.mix(rows, mixing.TARGETS, keep_share=0.5, bounded=True, most=2.0, steps=20).persist()
    assert out.count() == 60_000 and out.where("mix_factor0 <> 1").count() == 0
    expected = {r.lang: r.n for r in out.groupBy("lang").agg(F.sum(F.col("tokens") * F.col("probability")).alias("n")).collect()}
    whole, all_tokens = sum(expected.values()), out.agg(F.sum("tokens")).first()[0]
    assert abs(whole / all_tokens / (0.5 / 20) - round(whole / all_tokens / (0.5 / 20))) < 1e-3 and whole > 0.2 * all_tokens
    rest = sum(r.n for r in out.where("lang IS NULL").agg(F.sum("tokens").alias("n")).collect()) / all_tokens
    for k, x in mixing.TARGETS["lang"].items():
        assert abs(expected[k] / whole - x * (1 - rest)) < 1e-4
    hot = out.groupBy(F.col("source") == "hot.example").agg(F.sum(F.col("tokens") * F.col("probability")).alias("n"), F.sum("tokens").alias("all")).collect()
    share = {r[0]: (r.n / whole, r["all"] / all_tokens) for r in hot}
    assert share[True][0] < 0.5 * share[True][1]  # tempering takes much from a source with a third of all
    kept = out.where("kept").agg(F.sum("tokens")).first()[0]
    assert abs(kept - whole) < 0.05 * whole
