"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for the row-wise operators."""

import random
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsejobs.llm import decontamination as D
from pulsejobs.llm import langid, media, mixing, quality, sharding, warc

TEXTS = ["Plain words in a line.", "", None, "   \n\n ", "x" * 70000, "MANY!! WORDS!! OF!! NOISE!!", "Plain words in a line.", "12345 | 67 | 89", "ünï cödé, ñ", "\n" * 50]


def docs(spark, n=None):
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else "s", 1.0) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], None, "s", 1.0), (None, "no id", "en", None, 1.0)]
    return spark.createDataFrame(rows[:n], "doc_id long, text string, lang string, source string, score double")


def test_shards(spark):
    out = sharding.shard_documents(docs(spark), 3).collect()
    assert len(out) == 12
    sizes = [sum(r["size"] for r in out if r.shard == s) for s in range(3)]
    assert sum(sizes) == sum(len((r.text or "").encode()) + 1 for r in docs(spark).collect())
    for s in range(3):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    assert {r.text_crc32 for r in out} == {zlib.crc32((r.text or "").encode()) for r in docs(spark).collect()}
    assert sharding.shard_documents(docs(spark, 1).limit(0)).count() == 0


def test_shards_are_contiguous_and_balanced(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a"), (F.col("id") % 90).cast("int")).alias("text"))
    rows = sharding.shard_documents(df, 8).orderBy("doc_id").collect()
    assert [r.shard for r in rows] == sorted(r.shard for r in rows)
    sums = [sum(r["size"] for r in rows if r.shard == s) for s in range(8)]
    assert max(sums) - min(sums) <= 2 * 91


def test_rake():
    cells = np.random.default_rng(1).integers(1, 50, (3, 4, 2)).astype(float)
    targets = [np.array([1, 2, 3.0]) * cells.sum() / 6, np.ones(4) * cells.sum() / 4, np.array([0.3, 0.7]) * cells.sum()]
    f = mixing.rake(cells, targets, 60)
    fitted = cells * np.einsum("i,j,k->ijk", *f)
    for axis, t in enumerate(targets):
        assert np.allclose(fitted.sum(axis=tuple(i for i in range(3) if i != axis)), t, rtol=1e-6)


def test_mix_small(spark):
    out = mixing.mix(docs(spark), keep_share=0.9).collect()
    assert len(out) == 12 and all(0 <= r.probability <= 1 for r in out)
    assert len({r.kept for r in out if r.doc_id == 0}) == 1
    assert mixing.mix(docs(spark).limit(0)).count() == 0
    assert mixing.mix(docs(spark).where("text IS NULL")).first().kept


@pytest.mark.parametrize("keep_share", [0.3, 0.6, 0.95])
def test_bounded_fit_meets_the_targets(keep_share):
    cells = np.random.default_rng(0).integers(1, 100, (3, 4, 5)).astype(float)
    cells[0, 1, 2] = 0
    others = [tuple(i for i in range(3) if i != axis) for axis in range(3)]
    targets = [(lambda x: x / x.sum() * cells.sum())(cells.sum(axis=o) ** 0.5) for o in others]
    factors, kept, error = mixing.calibrate(cells, targets, keep_share)
    sample = cells * np.minimum(1, np.einsum("i,j,k->ijk", *factors))
    assert sample.sum() == pytest.approx(kept * cells.sum(), rel=1e-4) and error < 1e-5
    for o, t in zip(others, targets, strict=True):
        assert sample.sum(axis=o) / sample.sum() == pytest.approx(t / t.sum(), abs=1e-5)
    assert kept == keep_share if keep_share == 0.3 else 0.3 < kept <= keep_share


def test_mixing_stage_meets_the_targets(spark):
    rows = [(i, "ab"[i % 5 == 0], ["en", "en", "en", "de", "fr", "es"][i % 6], "word " * (3 + i % 7 * 60)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    out = mixing.mix(df, mixing.TARGETS, power=0.9, keep_share=0.9, bounded=True)
    got = {r.lang: r.n for r in out.groupBy("lang").agg(F.sum(F.col("tokens") * F.col("probability")).alias("n")).collect()}
    for k, x in mixing.TARGETS["lang"].items():
        assert got[k] / sum(got.values()) == pytest.approx(x, abs=1e-4)
    want = {r.doc_id for r in out.where("kept").collect()}
    assert {r.doc_id for r in mixing.mixing_stage(spark, df, "").collect()} == want


def test_warc_round_trip(spark):
    long = "päge " * 40000
    rows = [(3, "http://a\r\nX: y", long), (1, "http://b", long), (2, None, None), (5, "u", "short"), (6, "u", "short"), (None, "u", long), (7, "u", "z" * 65536), (7, "u", "z" * 65536)]
    archive = warc.write_chunks(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("header", F.lit(1)), 1 << 14)
    out = warc.read_records(archive).collect()
    assert len(out) == len(rows) and all(r.intact for r in out)
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in out}
    sha = lambda t: (len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest())
    assert got == {(1, "response", None, *sha(long)), (3, "revisit", 1, *sha(long)), (None, "revisit", 1, *sha(long)), (2, "response", None, *sha(None)), (5, "response", None, *sha("short")), (6, "response", None, *sha("short")), (7, "response", None, *sha("z" * 65536))}
    assert archive.agg(F.max(F.octet_length("data"))).first()[0] <= 1 << 14


def test_warc_damage_is_seen(spark):
    archive = warc.write_chunks(spark.createDataFrame([(1, "u", "abc" * 30000)], "page_id long, url string, html string"), 1 << 14)
    assert [r.intact for r in warc.read_records(archive.where("chunk_no <> 2")).collect()] == [False]
    changed = archive.withColumn("data", F.when(F.col("chunk_no") == 1, F.lit(b"x")).otherwise(F.col("data")))
    assert [r.intact for r in warc.read_records(changed).collect()] == [False]


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    rows = np.random.default_rng(kind).integers(0, 256, (7, 12), dtype=np.uint8)
    coded = np.zeros_like(rows)
    for y in range(7):
        for x in range(12):
            a = int(rows[y, x - 3]) if x >= 3 else 0
            b = int(rows[y - 1, x]) if y else 0
            c = int(rows[y - 1, x - 3]) if y and x >= 3 else 0
            p = a + b - c
            paeth = min(((abs(p - v), k, v) for k, v in enumerate((a, b, c))))[2]
            coded[y, x] = (int(rows[y, x]) - (0, a, b, (a + b) // 2, paeth)[kind]) % 256
    assert (media.unfilter(coded, np.full(7, kind), 3) == rows).all()


def test_png_damage(spark):
    png = media.encode_png(media.text_payload(b"hello"))
    bad = [None, b"", png[:-5], png[:50] + b"?" + png[51:], png]
    out = media.image_features(spark.createDataFrame(list(enumerate(bad)), "doc_id int, media binary")).orderBy("doc_id").collect()
    assert [r.error is None for r in out] == [False] * 4 + [True]
    assert media.decode_png(png).tobytes() == b"hello" + b" " * 187


def test_quality_and_language_small(spark):
    field = quality.Crf(np.zeros(quality.FEATURES), np.zeros((2, 2)))
    out = quality.score_quality(docs(spark), field).collect()
    assert len(out) == 12 and all(r.score == pytest.approx(0.5) and r.predicted == 1 for r in out)
    assert quality.score_quality(docs(spark).limit(0), field).count() == 0
    net = langid.ByteCnn.fresh(["de", "en"])
    found = {r.doc_id: r for r in langid.predict(docs(spark), net).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (1, 2, 3, 9))
    assert all(0 <= r.score <= 1 for r in found.values())


def test_crf_marginals_against_all_labellings():
    r = np.random.default_rng(0)
    field = quality.Crf(np.zeros(1), r.standard_normal((2, 2)))
    score, first = r.standard_normal(9), np.array([0, 4, 5, 9])
    good, joint = field.marginals(score, first, pairs=True)
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = b - a
        weights = []
        for bits in range(2**n):
            y = [(bits >> i) & 1 for i in range(n)]
            weights.append((y, np.exp(sum(score[a + i] * y[i] for i in range(n)) + sum(field.transitions[y[i - 1], y[i]] for i in range(1, n)))))
        z = sum(w for _, w in weights)
        for i in range(n):
            assert good[a + i] == pytest.approx(sum(w for y, w in weights if y[i]) / z)
            if i:
                assert joint[a + i, 1, 0] == pytest.approx(sum(w for y, w in weights if y[i - 1] and not y[i]) / z)


def test_contamination_small(spark):
    item = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (2, "Short one"), (None, None), (3, "...")], "item_id long, text string")
    rows = [(0, f"Before. {item.upper()}! after"), (1, "a short, ONE b"), (2, "shortone"), (3, None), (4, ""), (5, " ".join(f"w{i}" for i in range(12))), (6, "q " * 2000 + item)]
    out = {r.doc_id: r for r in D.contamination(spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", F.lit(9)), bench).collect()}
    assert (out[0].n_words, out[0].n_hit, out[0]["items"], out[0].contaminated) == (22, 20, ["1"], True)
    m = out[0].matches[0]
    assert rows[0][1].encode()[m.start : m.end].decode() == item.upper()
    assert (out[1].n_hit, out[1]["items"]) == (2, ["2"])
    assert [out[i].n_hit for i in (2, 3, 4, 5)] == [0, 0, 0, 0]
    assert out[6].n_hit == 20 and not out[6].contaminated
    several = D.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench, block_bytes=10)
    assert {r.doc_id: (r.n_hit, r["items"]) for r in several.collect()} == {k: (r.n_hit, r["items"]) for k, r in out.items()}


def test_contamination_against_plain_search(spark):
    r = random.Random(11)
    word = lambda: r.choice("one two three four Five SIX seven é eight. nine-ten ü".split())
    say = lambda n: [word() for _ in range(n)]
    items = [(str(i), " ".join(say(r.choice([1, 2, 4, 5, 6, 9, 12, 13, 14, 22, 23, 40])))) for i in range(60)] + [("", None), ("e", ""), ("61", " ".join(say(30)))]
    items.append(("62", items[-1][1] + " tail"))
    docs = []
    for i in range(80):
        words = say(r.randint(0, 30))
        for _ in range(r.randint(0, 3)):
            inner = (r.choice(items)[1] or "").split()
            a = r.randint(0, max(0, len(inner) - 13))
            words += inner[a : a + r.randint(1, 30)] + say(r.randint(0, 10))
        docs.append((i, r.choice([" ", ", ", "\n"]).join(words)))
    docs += [(90, None), (91, ""), (92, "?!"), (93, items[62][1] + " " + items[62][1])]
    norm = lambda t: D.normal_words((t or "").encode())
    want = []
    for i, t in docs:
        w, hit, held = norm(t), set(), set()
        for item, text in items:
            v = norm(text)
            n = min(13, len(v))
            wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    held.add(item)
        want.append((i, len(w), len(hit), sorted(held)))
    schema = "doc_id long, text string"
    bench = spark.createDataFrame(items, "item_id string, text string").repartition(3)
    for size in (10**7, 300):
        out = D.contamination(spark.createDataFrame(docs, schema).repartition(3), bench, block_bytes=size).collect()
        assert sorted((x.doc_id, x.n_words, x.n_hit, x["items"]) for x in out) == want
        assert all(sum(m["until"] - m["word"] for m in x.matches) == x.n_hit for x in out)
    assert D.contamination(spark.createDataFrame([], schema), bench).count() == 0
    assert {x.n_items for x in D.contamination(spark.createDataFrame(docs, schema), bench.limit(0)).collect()} == {0}


def test_sample_meets_its_targets_and_keeps_clashing_columns(spark):
    r = random.Random(4)
    langs = ["en"] * 60 + ["de"] * 20 + ["fr"] * 15 + ["es"] * 5
    rows = [(i, "word " * r.randint(5, 300), r.choice(langs), f"s{r.randint(0, 3)}", i) for i in range(1500)] + [(5000, None, None, None, 1), (None, "", "en", "s0", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, mix_topic int")
    out = mixing.mix(df, mixing.TARGETS).collect()
    assert len(out) == len(rows) and sorted(x.mix_topic for x in out) == sorted(x[4] for x in rows)
    expected = sum(x.tokens * x.probability for x in out)
    for k, share in mixing.TARGETS["lang"].items():
        assert abs(sum(x.tokens * x.probability for x in out if x.lang == k) / expected - share) < 1e-3
    assert max(x.probability for x in out) <= 1
