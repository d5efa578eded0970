"""Held-out accuracy of the fitted operators, and the network's forward pass against plain loops."""

import numpy as np
from pyspark.sql import functions as F

from pulsejobs.llm import langid, quality

DATA = "/root/testdata/sf0.01"


def test_quality_on_rows_that_no_fit_saw(spark):
    scored = quality.op8_quality_crf(spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = scored.where("held_out").join(labels, "doc_id").where("quality IS NOT NULL").select("quality", "predicted", "score").collect()
    assert len(rows) > 50 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.quality == r.predicted for r in rows]) > 0.95


def test_language_on_rows_that_no_fit_saw(spark):
    found = langid.op10_byte_cnn(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    rows = found.where("held_out").join(docs, "doc_id").where("lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95


def test_a_rare_language_is_a_class(spark):
    rows = [(i, f"the quick brown fox number {i} runs over the lazy dog", "en") for i in range(300)] + [(1000, "zażółć gęślą jaźń", "pl"), (1001, "12345", "xx"), (1002, None, "yy")]
    net = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), n_docs=20, n_windows=30)
    assert net.labels == ["en", "pl"]


def test_forward_pass_against_loops():
    net = langid.ByteCnn.fresh(["a", "b", "c"], seed=3)
    net.bias[:] = np.linspace(-0.2, 0.2, len(net.bias))
    x = np.random.default_rng(2).integers(0, 256, (3, langid.WINDOW), dtype=np.uint8)
    for row, got, other in zip(x, net.predict(x), net.forward(x)[0], strict=True):
        pooled = []
        for f in range(net.filters.shape[1]):
            values = [sum(float(net.embed[row[i + j], e]) * float(net.filters[j * langid.EMBED + e, f]) for j in range(max(langid.WIDTHS)) for e in range(langid.EMBED)) for i in range(0, langid.WINDOW - max(langid.WIDTHS) + 1)]
            pooled.append(max(0.0, max(values) + float(net.bias[f])))
        z = np.array(pooled) @ net.out.astype(float) + net.out_bias
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert np.allclose(got, p, atol=1e-4) and np.allclose(other, p, atol=1e-4)


def test_long_text_in_pieces_and_clashing_columns(spark):
    net = langid.ByteCnn.fresh(["a", "b"], seed=5)
    long = "Some words of a long text, over and over. " * 30_000
    rows = [(1, long, 1, "x"), (2, "short", 2, "y"), (3, None, 3, None), (4, "123", 4, "z"), (4, "", 4, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lower int, letters string")
    out = {(r.doc_id, r.text): r for r in langid.predict(df, net).collect()}
    assert len(out) == 5 and out[1, long]["lower"] == 1 and out[2, "short"].letters == "y" and out[3, None].lang_pred == out[4, "123"].lang_pred == out[4, ""].lang_pred == "und"
    raw = np.frombuffer(long.lower().encode(), np.uint8)
    windows, _, covered = langid.windows_of(raw, np.array([0, len(raw)]))
    p = (net.predict(windows).astype(float) * (covered[:, None] + 1e-3)).sum(axis=0)
    assert abs(out[1, long].score - (p / p.sum()).max()) < 1e-5
    assert langid.predict(df.limit(0), net).count() == 0


def test_quality_learns_from_whole_texts(spark):
    good, bad = "Plain sentences follow one another here.\n" * 250, "Plain sentences follow one another here.\n" * 250 + "$$$ %%% ### @@@ !!!\n" * 400
    docs = spark.createDataFrame([(i, bad if i % 2 else good) for i in range(40)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.lit(1) - F.col("doc_id") % 2).cast("int").alias("quality"))
    field = quality.train(docs, labels)
    got = {r.doc_id: r.predicted for r in quality.score_quality(docs, field).collect()}
    assert got == {i: 1 - i % 2 for i in range(40)}
    few = quality.train(docs, labels, n_lines=700)
    assert isinstance(few, quality.Crf)
