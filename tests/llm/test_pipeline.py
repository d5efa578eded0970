"""The corpus pipeline on small tables: what each stage must let through and what it must not."""

import random

import corpus_pipeline


def test_stages_by_name():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near-duplicates", "decontamination", "mixing", "sharding"]


def test_small_corpus(spark, tmp_path):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    say = lambda n: " ".join(word() for _ in range(n))
    item = say(40)
    rows = [(i, say(60), "en", "web") for i in range(12)]
    rows += [(20, rows[0][1], "en", "web"), (21, rows[1][1] + " end", "en", "web"), (3, rows[3][1], "en", "web")]  # copy, near copy, repeated row
    rows += [(30, say(5) + " " + item, "en", "web"), (31, None, None, None), (None, say(50), "en", "web")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "length(text) AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # without labels every text scores a half and stays
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept, seen = docs, {}
    for name, step in corpus_pipeline.STAGES[:4]:
        kept = corpus_pipeline.stage(step(spark, kept, str(tmp_path)), name)
        assert kept.columns == docs.columns
        seen[name] = sorted(((x.doc_id, x.text) for x in kept.collect()), key=repr)
    once = sorted({x[:2] for x in rows} - {(20, rows[0][1]), (21, rows[1][1] + " end")}, key=repr)
    assert len(seen["quality"]) == len(rows)
    assert seen["near-duplicates"] == once
    assert seen["decontamination"] == [x for x in once if x[0] != 30]
    assert set(seen["mixing"]) <= set(seen["decontamination"])
    shards = corpus_pipeline.STAGES[4][1](spark, kept, str(tmp_path)).collect()
    assert sorted(repr(x.doc_id) for x in shards) == sorted(repr(x[0]) for x in seen["mixing"])
