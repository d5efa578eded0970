"""Segmentation, alignment, resampling, duplicates."""

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import dedupe, joins, segment
from ..operators.ranking import with_place
from ..operators.segment import WindowSpec
from ..plans import segmenting
from ..sources import adapters
from . import SAMPLES, WIDE, long_form, query, r6, r6s


def _cut(spark, sf_dir, size, stride):
    return segment.windows_of_samples(adapters.samples(spark, sf_dir), WindowSpec(size, stride), ["signal", "abp_signal"])


def _window_sql(size, stride):
    return f"""WITH {SAMPLES}
SELECT patient, patient || '_' || (idx // {stride}) AS trial, idx // {stride} AS j, count(*) AS n, {r6s("sum(ppg)")} AS ppg_sum, {r6s("sum(abp)")} AS abp_sum,
  {r6s("arg_min(ppg, idx)")} AS first, {r6s("arg_max(ppg, idx)")} AS last
FROM s JOIN len USING (patient) WHERE idx // {stride} < len // {stride} AND idx % {stride} < {size}
GROUP BY ALL"""


def _window_report(df):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return df.select(
        "patient", "trial", F.col("j").cast("long").alias("j"), F.size("signal").cast("long").alias("n"), r6(total("signal")).alias("ppg_sum"), r6(total("abp_signal")).alias("abp_sum"),
        r6(F.get("signal", F.lit(0))).alias("first"), r6(F.element_at("signal", -1)).alias("last"),
    )


@query("seg1_fixed_windows", _window_sql(16, 16))
def seg1(spark, sf_dir):
    return _window_report(_cut(spark, sf_dir, 16, 16))


@query("seg2_gapped_windows", _window_sql(16, 20))
def seg2(spark, sf_dir):
    return _window_report(segment.windows_of_samples(adapters.samples(spark, sf_dir), WindowSpec.of(8, win_sec=2, wait_sec=2.5), ["signal", "abp_signal"]))


@query("seg3_centre_window", f"""WITH {SAMPLES}
SELECT patient, idx - (len - 32) // 2 AS i, {r6s("ppg")} AS signal FROM s JOIN len USING (patient)
WHERE len >= 32 AND idx >= (len - 32) // 2 AND idx < (len - 32) // 2 + 32""")
def seg3(spark, sf_dir):
    rows = segment.centre_of_samples(adapters.samples(spark, sf_dir).where("channel = 'signal'"), WindowSpec.of(16, win_sam=32).size)
    return rows.select("patient", F.col("idx").cast("long").alias("i"), r6("x").alias("signal"))


@query("seg5_trim_and_scale", f"""WITH {SAMPLES}
SELECT patient, idx - 3 AS i, {r6s("ppg")} AS signal, {r6s("abp * 100")} AS abp_signal FROM s JOIN len USING (patient)
WHERE idx >= 3 AND idx < len - 10 - 3""")
def seg5(spark, sf_dir):
    rows = segment.trimmed_samples(adapters.samples(spark, sf_dir), 10, 3)
    x = F.when(F.col("channel") == "abp_signal", F.col("x") * 100.0).otherwise(F.col("x"))
    both = rows.groupBy("patient", "idx").agg(*[F.max(F.when(F.col("channel") == c, x)).alias(c) for c in ("signal", "abp_signal")])
    return both.select("patient", F.col("idx").cast("long").alias("i"), r6("signal").alias("signal"), r6("abp_signal").alias("abp_signal"))


@query("seg7_ids_and_order", f"""WITH {SAMPLES}, t AS (SELECT DISTINCT 'Part_' || (1 + patient % 4) || '_' || patient || '_' || (idx // 16) AS trial FROM s JOIN len USING (patient) WHERE idx // 16 < len // 16)
SELECT trial, regexp_replace(trial, '_[^_]*$', '') AS record, split_part(trial, '_', 1) || '_' || split_part(trial, '_', 2) AS part, split_part(trial, '_', 3)::INT AS patient,
  row_number() OVER (ORDER BY trial) AS place FROM t""")
def seg7(spark, sf_dir):
    """Ids of windows, the ids taken from them, and the place in the sorted order."""
    ids = adapters.records(spark, sf_dir).withColumn("record", F.concat_ws("_", F.lit("Part"), (1 + F.col("patient") % 4).cast("string"), F.col("patient").cast("string")))
    cut = segment.windows(ids, WindowSpec(16, 16), ["signal"], "record").select("trial")
    return with_place(cut, ["trial"]).select(
        "trial", F.regexp_replace("trial", "_[^_]*$", "").alias("record"), F.substring_index("trial", "_", 2).alias("part"), F.split_part("trial", F.lit("_"), F.lit(3)).cast("int").alias("patient"),
        "place",
    )


@query("seg12_listed_order", """SELECT p.pos AS pos, c_custkey AS patient, c_name AS name FROM customer
JOIN (SELECT generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS name FROM (SELECT list(c_name ORDER BY md5(c_name)) AS l FROM customer)) p ON p.name = c_name""")
def seg12(spark, sf_dir):
    people = adapters.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("patient"), F.col("c_name").alias("name"))
    listed = with_place(people.select(F.md5(F.col("name").cast("binary")).alias("h"), "name"), ["h"], "pos").select((F.col("pos") - 1).alias("pos"), "name")
    return segment.in_listed_order(people, listed, "name").select("pos", "patient", "name")


_RESAMPLE = """weights AS (
  SELECT m, n, (1 + 2 * list_sum(list_transform(range(1, 16), lambda k: cos(2 * pi() * k * (m / 32.0 - n / 64.0)))) + 2 * cos(2 * pi() * 16 * (m / 32.0)) * cos(2 * pi() * 16 * n / 64.0)) / 64 AS v
  FROM range(32) a(m), range(64) b(n))"""


@query("seg10_fourier_resample", f"WITH {WIDE}, {_RESAMPLE} SELECT trial, m AS i, {r6s('sum(x * v)')} AS signal FROM e JOIN weights ON i = n GROUP BY trial, m")
def seg10(spark, sf_dir):
    return long_form(segment.resampled(adapters.wide_windows(spark, sf_dir), "signal", 64, 32), ["trial"], ["signal"])


def _align_sql(mode: str) -> str:
    start = "len - 1 - k" if mode == "exact" else "size - k"
    return f"""WITH {SAMPLES}, z AS (SELECT patient, len, len // 8 * 8 AS size FROM len),
pairs AS (SELECT a.patient, a.idx + len - 1 - b.idx AS k, sum(a.abp * b.ppg) AS c
  FROM s a JOIN s b USING (patient) JOIN z USING (patient)
  WHERE a.idx + len - 1 - b.idx >= size - 8 AND a.idx + len - 1 - b.idx < size GROUP BY ALL),
best AS (SELECT patient, min(k) AS k FROM (SELECT *, max(c) OVER (PARTITION BY patient) AS top FROM pairs) WHERE c >= top - 1e-9 GROUP BY patient),
b AS (SELECT patient, k - size AS shift, {start} AS start, size - 8 AS keep FROM best JOIN z USING (patient))
SELECT b.patient AS patient, shift, a.idx AS i, {r6s("p.ppg")} AS signal, {r6s("a.abp")} AS abp_signal
FROM b JOIN s a ON a.patient = b.patient AND a.idx < keep LEFT JOIN s p ON p.patient = b.patient AND p.idx = a.idx + start"""


@query("seg11_align", _align_sql("literal"))
def seg11(spark, sf_dir):
    """From sample rows: a record is several blocks of 64 samples."""
    out = segment.aligned_samples(adapters.samples(spark, sf_dir), 8, block=64)
    both = out.groupBy("patient", "shift", "idx").agg(*[F.max(F.when(F.col("channel") == c, F.col("x"))).alias(c) for c in ("signal", "abp_signal")])
    return both.select("patient", F.col("shift").cast("long").alias("shift"), F.col("idx").cast("long").alias("i"), r6("signal").alias("signal"), r6("abp_signal").alias("abp_signal"))


@query("seg11_align_exact", _align_sql("exact"))
def seg11_exact(spark, sf_dir):
    out = segment.aligned(adapters.records(spark, sf_dir), 8, "exact")
    return long_form(out.withColumn("shift", F.col("shift").cast("long")), ["patient", "shift"], ["signal", "abp_signal"])


#: Records as seg8 cuts them: without their last 10 samples and one second at both ends, pressure times 100.
_TRIMMED = SAMPLES.replace("s AS (", "s0 AS (", 1).replace("len AS (SELECT patient, count(*) AS len FROM s GROUP BY patient)", """len0 AS (SELECT patient, count(*) AS len FROM s0 GROUP BY patient),
s AS (SELECT patient, idx - 8 AS idx, ppg, abp * 100 AS abp FROM s0 JOIN len0 USING (patient) WHERE idx >= 8 AND idx < len - 10 - 8),
len AS (SELECT patient, count(*) AS len FROM s GROUP BY patient)""")
_BED = f"""{_align_sql("literal").replace(SAMPLES, _TRIMMED).replace("SELECT b.patient AS patient, shift, a.idx AS i", "SELECT b.patient AS patient, keep, a.idx AS i")}""".replace("FROM best JOIN z USING (patient))\nSELECT", "FROM best JOIN z USING (patient)),\nal AS (SELECT") + """),
wi AS (SELECT patient, i // 20 AS j, list(signal ORDER BY i) AS ppg, list(abp_signal ORDER BY i) AS abp FROM al WHERE i // 20 < keep // 20 AND i % 20 < 16 GROUP BY ALL),
d1 AS (SELECT *, row_number() OVER (PARTITION BY ppg ORDER BY patient, j) AS r1 FROM wi),
d2 AS (SELECT *, row_number() OVER (PARTITION BY abp ORDER BY patient, j) AS r2 FROM d1 WHERE r1 = 1)
SELECT patient, patient || '_' || j AS trial, n_name AS nation, """ + f"{r6s('list_sum(ppg)')} AS ppg_sum, {r6s('list_sum(abp)')} AS abp_sum, {r6s('ppg[1]')} AS first FROM d2 JOIN customer ON c_custkey = patient JOIN nation ON n_nationkey = c_nationkey WHERE r2 = 1"


@query("seg8_long_records", _BED)
def seg8(spark, sf_dir):
    """A whole collection of long recordings to windows with a gap, with what is known of the subjects."""
    people = adapters.read(spark, sf_dir, "customer").join(adapters.read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    people = people.select(F.col("c_custkey").alias("patient"), F.col("n_name").alias("nation"))
    records = joins.with_subjects(adapters.records(spark, sf_dir), people)
    out = segmenting.long_records(records, 8, win_sec=2, wait_sec=2.5, dropped=10, edge_sec=1)
    return out.select("patient", "trial", "nation", r6(A.total("signal")).alias("ppg_sum"), r6(A.total("abp_signal")).alias("abp_sum"), r6(A.at("signal", 0)).alias("first"))


def _ledger(spark, sf_dir):
    """Short windows with many exact repeats: measures of line items."""
    return adapters.read(spark, sf_dir, "lineitem").select(
        *["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], F.array("l_quantity", "l_discount").alias("signal"), F.array("l_tax", "l_quantity").alias("abp_signal")
    )


_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_DUPES = """o AS (SELECT *, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem),
a AS (SELECT *, row_number() OVER (PARTITION BY l_quantity, l_discount ORDER BY k) AS r1 FROM o),
b AS (SELECT *, row_number() OVER (PARTITION BY l_tax, l_quantity ORDER BY k) AS r2 FROM a WHERE r1 = 1)"""


@query("dup1_drop_duplicates", f"WITH {_DUPES} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_tax FROM b WHERE r2 = 1")
def dup1(spark, sf_dir):
    kept = dedupe.drop_duplicate_windows(_ledger(spark, sf_dir), _ORDER)
    return kept.select(*_ORDER, F.get("signal", F.lit(0)).alias("l_quantity"), F.get("abp_signal", F.lit(0)).alias("l_tax"))


@query("dup2_duplicate_counts", f"WITH {_DUPES} SELECT (SELECT count(*) FROM lineitem) AS rows, (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM b WHERE r2 = 1) AS removed")
def dup2(spark, sf_dir):
    return dedupe.duplicate_counts(_ledger(spark, sf_dir), _ORDER)


@query("jon1_demographics", """SELECT o_orderkey AS trial, o_custkey AS patient, n_name AS nation, c_acctbal AS balance
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def jon1(spark, sf_dir):
    info = adapters.read(spark, sf_dir, "customer").join(adapters.read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    info = info.select(F.col("c_custkey").alias("patient"), F.col("n_name").alias("nation"), F.col("c_acctbal").alias("balance"))
    rows = adapters.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trial"), F.col("o_custkey").alias("patient"))
    return joins.with_subjects(rows, info)


@query("jon2_first_match_lookup", """WITH m AS (SELECT c_nationkey AS file, c_custkey AS subject, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer)
SELECT s_suppkey, file, subject FROM supplier JOIN m ON file = s_nationkey AND r = 1""")
def jon2(spark, sf_dir):
    people = adapters.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("file"), F.col("c_custkey").alias("subject"))
    rows = adapters.read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("file"))
    return joins.with_subjects(rows, joins.first_match(people, "file", ["subject"]), "file").select("s_suppkey", "file", "subject")


@query("jon6_keep_in_step", """SELECT o_orderkey AS trial, o_custkey AS patient, o_totalprice AS price FROM orders
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.09) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A' AND l_quantity > 45)""")
def jon6(spark, sf_dir):
    """Rows whose feature rows are kept, without those on a deny list."""
    lines = adapters.read(spark, sf_dir, "lineitem")
    rows = adapters.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trial"), F.col("o_custkey").alias("patient"), F.col("o_totalprice").alias("price"))
    kept = lines.where("l_discount > 0.09").select(F.col("l_orderkey").alias("trial"))
    deny = lines.where("l_returnflag = 'A' AND l_quantity > 45").select(F.col("l_orderkey").alias("trial"))
    return joins.without(joins.keep_in_step(rows, kept, ("trial",)), deny, ["trial"])


@query("set1_stack_parts", """SELECT 'c' AS part, c_custkey AS id, c_acctbal AS balance, NULL::VARCHAR AS name FROM customer
UNION ALL SELECT 's', s_suppkey, NULL, s_name FROM supplier""")
def set1(spark, sf_dir):
    a = adapters.read(spark, sf_dir, "customer").select(F.lit("c").alias("part"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.lit(1).alias("label_class"))
    b = adapters.read(spark, sf_dir, "supplier").select(F.lit("s").alias("part"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return joins.without_helpers(joins.stacked(a, b))
