"""op5, op8 and the pipeline against versions written in plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from pulsejobs.llm import media, mixing, quality, sharding

# ------------------------------------------------------------------ op5


def plain_hash(payload: bytes) -> str:
    """64 low cosine coefficients of the grey image at 32 x 32 against their median."""
    wide = 192
    rows = [payload[i : i + wide] for i in range(0, len(payload), wide)]
    grey = np.array([[r[3 * k] + r[3 * k + 1] + r[3 * k + 2] for k in range(wide // 3)] for r in rows], float)

    def shrunk(x):
        n = len(x)
        return np.array([x[k * n // 32 : max(k * n // 32 + 1, (k + 1) * n // 32)].mean(axis=0) for k in range(32)])

    small = shrunk(shrunk(grey).T).T
    low = np.array([[sum(small[y, x] * np.cos(np.pi * (2 * y + 1) * u / 64) * np.cos(np.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]).ravel()
    return low


def test_png_table(spark, tmp_path):
    rows = [(1, "short"), (1, "short"), (2, None), (3, ""), (4, "x" * 192), (5, "é" * 97), (6, "words and more words, " * 40_000), (None, "short"), (7, "x" * 193)]
    spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, media int").write.parquet(f"{tmp_path}/documents.parquet")
    out = media.op5_text_png(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _ in rows)
    for r in out:
        options = {}
        for i, text in rows:
            if i == r.doc_id:
                raw = (text or "").encode()
                payload = raw + b" " * (-len(raw) % 192 if raw else 192)
                options[hashlib.sha256(payload).hexdigest()] = (len(raw), len(payload), zlib.crc32(payload[-16:]), payload)
        size, padded, tail, payload = options[r.payload_sha256]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.error) == (size, padded, tail, None)
        stored = media.encode_png(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert media.decode_png(stored).tobytes() == payload
    by_text = {}
    for r in out:
        by_text.setdefault(r.payload_sha256, set()).add((r.feature, r.media_sha256))
    assert all(len(x) == 1 for x in by_text.values())
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert media.image_features(media.text_images(empty)).collect() == []


def test_cosine_hash_against_sums():
    rng = np.random.default_rng(1)
    for rows in (1, 40, 100):
        payload = rng.integers(0, 256, rows * 192, dtype=np.uint8).tobytes()
        low = plain_hash(payload)
        bits = np.unpackbits(np.frombuffer(bytes.fromhex(media.cosine_hash(media.decode_png(media.encode_png(payload)))), np.uint8))
        low[0] = 0.0
        # coefficients are scaled alike up to the first row and column, which the definition scales by the root of a half
        scale = np.ones((8, 8))
        scale[0] *= 2**-0.5
        scale[:, 0] *= 2**-0.5
        for scaled in (low, low * scale.ravel()):
            middle = np.median(scaled)
            clear = np.abs(scaled - middle) > 1e-6 * np.abs(scaled).max()
            if (bits[clear] == (scaled > middle)[clear]).all():
                break
        else:
            raise AssertionError("the bits are not those of the coefficients")


# ------------------------------------------------------------------ op8


def plain_line(line: bytes) -> list[float]:
    kinds = [sum(c in group for c in line) for group in (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes(range(128, 256)), b"0123456789", b"\t\x0b\x0c\r ", b".,;:?'\"()-", b"!", b"#$%&*|<>=@^~_{}[]\\/+`", b"\n")]
    size = max(1, len(line))
    other = len(line) - sum(kinds)
    shares = [other / size, *[k / size for k in kinds[:8]]]
    words = line.replace(b"\t", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ")
    words = [w for w in words if w]
    some = max(1, len(words))
    low = [w.lower() for w in words]
    return shares + [
        sum(a == b for a, b in zip(low, low[1:], strict=False)) / some, len(set(low)) / some, sum(map(len, words)) / some / 10, float(np.log1p(len(words)) / 5), float(not words),
        float(line[-1:] in (b".", b"?", b"!") and bool(line)), sum(w[-1:] in [bytes([c]) for c in b"#$%&*|<>=@^~_{}[]\\/+`!"] for w in words) / some,
    ]


TEXTS = ["", "\n", "One line.", "Two lines here\nand and more!\n", "Ünï cödé 123 $$$ ###!\r\n\n\tTAB tab Tab\x0bx\n" * 3, "a", "\n\n\n", "A long line " * 300 + "\nend?", "No end"]


def test_line_features_against_loops():
    x, first, weight = quality.line_features(pa.array(TEXTS))
    k = 0
    for t, text in enumerate(TEXTS):
        lines = text.encode().split(b"\n")
        assert first[t + 1] - first[t] == len(lines)
        own = [plain_line(line) for line in lines]
        for i, line in enumerate(lines):
            before = own[i - 1] if i else [0.0] * 16
            after = own[i + 1] if i + 1 < len(lines) else [0.0] * 16
            assert np.allclose(x[k], [*own[i], *before, *after, i == 0, i + 1 == len(lines), 1], atol=1e-5), (text, i)
            assert weight[k] == len(line) + 1
            k += 1


def test_scores_against_all_labellings(spark):
    rng = np.random.default_rng(4)
    field = quality.Crf(rng.normal(0, 0.5, quality.FEATURES), rng.normal(0, 0.7, (2, 2)), slope=1.3, shift=-0.2)
    df = spark.createDataFrame([(i, t, i, "a") for i, t in enumerate([*TEXTS, None])], "doc_id int, text string, score int, line string")
    found = {r.doc_id: r for r in quality.score_quality(df, field).collect()}
    assert len(found) == len(TEXTS) + 1 and {r.line for r in found.values()} == {"a"}
    for i, text in enumerate([*TEXTS, None]):
        x, _, weight = quality.line_features(pa.array([text or ""]))
        score = x.astype(float) @ field.weights
        n = len(score)
        if n > 12:
            continue
        total, good = 0.0, np.zeros(n)
        for bits in range(2**n):
            y = [bits >> k & 1 for k in range(n)]
            w = np.exp(sum(score[k] * y[k] for k in range(n)) + sum(field.transitions[y[k - 1], y[k]] for k in range(1, n)))
            total += w
            good += w * np.array(y)
        mean = float((good / total * weight).sum() / weight.sum())
        want = 1 / (1 + np.exp(-(field.slope * np.log(mean / (1 - mean)) + field.shift)))
        assert found[i].score == pytest.approx(want, abs=1e-5) and found[i].predicted == (found[i].score >= 0.5)


# ------------------------------------------------------------------ pipeline


def shingles(text: str) -> set:
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def one_of_each_group(rows):
    """Rows (doc_id, text, ...) without the near-duplicates of a smaller id, and without repeats."""
    sets = [shingles(r[1] or "") for r in rows]
    head = list(range(len(rows)))

    def top(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                head[max(a, b)] = min(a, b)
    best: dict[int, tuple] = {}
    for i, r in enumerate(rows):
        if sets[i]:
            key = (r[0] is None, r[0] if r[0] is not None else 0, r[1])
            best[top(i)] = min(best.get(top(i), (key, r)), (key, r), key=lambda x: x[0])
    alone = {(r[0], r[1]): r for i, r in enumerate(rows) if not sets[i]}
    return [r for _, r in best.values()] + list(alone.values())


def corpus(seed: int):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    say = lambda n: " ".join(word() for _ in range(n))
    item = say(30)
    rows, labels = [], []
    for i in range(120):
        bad = i % 3 == 0
        text = "\n".join("$$$ ### !!! " + say(2).upper() + " @@@" for _ in range(8)) if bad else "\n".join(say(12).capitalize() + "." for _ in range(6))
        rows.append((i, text, ["en", "de", "fr", None][i % 4], ["web", "web", "web", "books"][i % 4]))
        if i % 2 == 0:
            labels.append((i, int(not bad), 0))
    rows += [(200, rows[1][1], "en", "web"), (201, rows[2][1] + " end", "en", "web"), (4, rows[4][1], rows[4][2], rows[4][3]), (202, say(6).capitalize() + ". " + item, "en", "web"), (203, None, None, None), (204, "", "en", "web"), (None, "\n".join(say(12).capitalize() + "." for _ in range(6)), "en", None), (205, "\n".join(say(12).capitalize() + "." for _ in range(2000)), "de", "books")]
    return rows, labels, [("a", item), ("b", None), (None, item)]


def test_pipeline_against_plain_stages(spark, tmp_path):
    rows, labels, items = corpus(9)
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 7, 8, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars int, score int, shard int, near_gone string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = {}
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, step in corpus_pipeline.STAGES:
        given = kept
        kept = corpus_pipeline.stage(step(spark, given, str(tmp_path)), name)
        if name != "sharding":
            assert kept.columns == docs.columns and {(r.score, r.shard, r.near_gone) for r in kept.collect()} == {(7, 8, "x")}
            seen[name] = sorted(((r.doc_id, r.text, r.lang, r.source) for r in kept.collect()), key=repr)
    plain = lambda found: sorted(found, key=repr)

    # quality: what the model rejects goes; bad documents are rejected, good ones stay
    model = quality.trained_on(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scored = quality.score_quality(docs, model).where("predicted = 1").select("doc_id", "text", "lang", "source").collect()
    assert seen["quality"] == plain(tuple(r) for r in scored)
    ids = {r[0] for r in seen["quality"]}
    assert all(i in ids for i in range(120) if i % 3) and sum(i in ids for i in range(0, 120, 3)) <= 2

    assert seen["near-duplicates"] == plain(one_of_each_group(seen["quality"]))
    assert {200, 201} & {r[0] for r in seen["near-duplicates"]} == set() and len(seen["near-duplicates"]) < len(seen["quality"])

    def clean(text):
        words, item = (text or "").lower().split(), items[0][1].split()
        hit = set()
        for k in range(len(item) - 12):
            for i in range(len(words) - 12):
                if words[i : i + 13] == item[k : k + 13]:
                    hit |= set(range(i, i + 13))
        return not (hit and 20 * len(hit) >= len(words))

    # words here are letters and blanks; marks part them
    apart = lambda text: "".join(c if c.isalnum() else " " for c in text or "")
    assert seen["decontamination"] == [r for r in seen["near-duplicates"] if clean(apart(r[1]))]
    assert 202 not in {r[0] for r in seen["decontamination"]}

    mixed = mixing.mix(spark.createDataFrame(seen["decontamination"], "doc_id long, text string, lang string, source string"), mixing.TARGETS, power=0.9, keep_share=0.9, bounded=True).collect()
    draw = lambda i: int(hashlib.md5(f"{mixing.SEED}:{'' if i is None else i}".encode()).hexdigest()[:8], 16) / 2**32
    assert seen["mixing"] == plain((r.doc_id, r.text, r.lang, r.source) for r in mixed if draw(r.doc_id) < r.probability)
    assert len(seen["mixing"]) > 20

    order = sorted(((r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 1) for r in seen["mixing"]))
    whole, before, slots = sum(x[3] for x in order), 0, {}
    want = []
    for some, i, crc, size in order:
        shard = min(7, before * sharding.SHARDS // whole)
        want.append((i if some else None, size, crc, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    assert sorted((tuple(r) for r in kept.select("doc_id", "size", "text_crc32", "shard", "slot").collect()), key=repr) == sorted(want, key=repr)
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, kept.collect()), key=repr)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars int"), ("benchmark", "item_id string, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "size", "text_crc32", "shard", "slot"] and out.collect() == []
