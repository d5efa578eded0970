"""Features of windows and cycles, mean pressure cycles."""

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.vec import resample_each
from ..operators import extrema, features, mabp, signals
from ..sources import adapters
from . import WIDE, long_form, query, r6, r6s
from .beats import beats_sql
from .windows import _E, _extrema


def _waves(spark, sf_dir):
    df = adapters.wide_windows(spark, sf_dir).withColumnRenamed("signal", "ppg").withColumn("pks", A.maxima("ppg"))
    return df.withColumns(signals.derivatives("ppg"))


def _scalars(df):
    """Keys and all doubles rounded, ints as long."""
    out = []
    for f in df.schema:
        kind = f.dataType.typeName()
        out.append(r6(f.name).alias(f.name) if kind == "double" else F.col(f.name).cast("long").alias(f.name) if kind == "integer" else F.col(f.name))
    return df.select(*out)


@query("fea1_spectrum_peaks")
def fea1(spark, sf_dir):
    df = features.spectrum_peaks(_waves(spark, sf_dir), "ppg", distance=2, around=3)
    return long_form(df, ["trial"], ["ppg_fft_peaks", "ppg_fft_peaks_heights", "ppg_fft_peaks_neighbor_avgs"])


@query("fea2_rate", f"{_E} SELECT trial, {r6s('median(gap)')} AS p2p, {r6s('60 * 8 / median(gap)')} AS hr FROM (SELECT trial, p - lag(p) OVER (PARTITION BY trial ORDER BY p) AS gap FROM pk) GROUP BY trial")
def fea2(spark, sf_dir):
    df = _waves(spark, sf_dir).withColumn("p2p", features.beat_distance("pks"))
    return df.select("trial", r6("p2p").alias("p2p"), r6(60.0 * 8 / F.col("p2p")).alias("hr"))


@query("fea3_aligned_cycles", f"""{_E}, o AS (SELECT trial, round_even(median(gap), 0)::INT AS o FROM (SELECT trial, p - lag(p) OVER (PARTITION BY trial ORDER BY p) AS gap FROM pk) GROUP BY trial),
k AS (SELECT trial, p, row_number() OVER (PARTITION BY trial ORDER BY p) AS r, count(*) OVER (PARTITION BY trial) AS n FROM pk),
b AS (SELECT trial, p, round_even(p - o * 0.25, 0)::INT AS lo, round_even(p + o * 0.75, 0)::INT AS hi FROM k JOIN o USING (trial) WHERE r > 1 AND r < n)
SELECT trial, row_number() OVER (PARTITION BY trial ORDER BY p) - 1 AS cyc, lo AS first_sample, {r6s('s')} AS total FROM (
  SELECT b.trial, p, lo, sum(x) AS s FROM b JOIN e ON e.trial = b.trial AND i >= lo AND i < hi WHERE lo >= 0 AND hi <= 64 GROUP BY ALL)""".replace("lo AS first_sample, ", ""))
def fea3(spark, sf_dir):
    df = _waves(spark, sf_dir)
    df = df.withColumn("z", features.aligned_cycles("ppg", ["ppg"], "pks", "sys_peak"))
    return df.select("trial", F.posexplode(F.col("z")["ppg"]).alias("cyc", "c")).select("trial", F.col("cyc").cast("long").alias("cyc"), r6(A.total("c")).alias("total"))


@query("fea_window_features")
def fea_window(spark, sf_dir):
    """Spectrum, rate, aligned-cycle, histogram and slope features of all five waves, each value of their lists a column (rows only)."""
    w = features.window_features(_waves(spark, sf_dir), 8, distance=2, around=3)
    peaks = {f"{x}_fft_{n}": 5 for x in features.WAVES for n in ("peaks", "peaks_heights", "peaks_neighbor_avgs")}
    w = features.spread(w, features.template_lists() | peaks)
    return _scalars(w.select("patient", "trial", *[f.name for f in w.schema if f.dataType.typeName() in ("double", "integer", "boolean")]))


_WN = f"WITH {WIDE}, m AS (SELECT trial, min(x) AS lo, max(x) AS hi FROM e GROUP BY trial), n AS (SELECT trial, i, (x - lo) / (hi - lo + 1e-6) AS x FROM e JOIN m USING (trial)), t AS (SELECT trial, arg_max(i, x) AS top, arg_min(i, x) AS low FROM n GROUP BY trial)"


@query("fea5_near_max_and_places", f"""{_WN} SELECT trial, top, low, {r6s('avg(x) FILTER (WHERE i >= greatest(0, top - 5) AND i < least(64, top + 5))')} AS near_max, {r6s('max(x) FILTER (WHERE i = 59)')} AS x_59 FROM n JOIN t USING (trial) GROUP BY ALL""")
def fea5(spark, sf_dir):
    df = adapters.wide_windows(spark, sf_dir).withColumn("x", A.min_max("signal", 1e-6))
    return df.select("trial", A.argmax("x").cast("long").alias("top"), A.argmin("x").cast("long").alias("low"), r6(features.mean_near_max("x")).alias("near_max"), r6(F.get("x", F.lit(59))).alias("x_59"))


def _hist(part, bins, where):
    return f"""SELECT trial, '{part}' AS part, b AS i, {r6s(f'count(*) FILTER (WHERE least(floor(x * {bins}), {bins - 1}) = b) * {bins}.0::DOUBLE / count(*)')} AS density
FROM n JOIN t USING (trial), range({bins}) r(b) WHERE {where} GROUP BY trial, b"""


@query("fea7_histograms", f"{_WN} {_hist('up', 5, 'i < top')} UNION ALL {_hist('down', 10, 'i >= top')}")
def fea7(spark, sf_dir):
    df = adapters.wide_windows(spark, sf_dir).withColumn("x", A.min_max("signal", 1e-6)).withColumn("top", A.argmax("x"))
    up, down = features.density(A.cut("x", 0, F.col("top")), 5), features.density(A.cut("x", F.col("top"), 64), 10)
    one = lambda c, k: df.select("trial", F.lit(k).alias("part"), F.posexplode(c).alias("i", "density"))
    return one(up, "up").union(one(down, "down")).where("density IS NOT NULL").select("trial", "part", F.col("i").cast("long").alias("i"), r6("density").alias("density"))


@query("fea4_median_cycle")
def fea4(spark, sf_dir):
    df = _waves(spark, sf_dir).withColumn("z", features.aligned_cycles("ppg", ["ppg"], "pks", "dia_notches"))
    return long_form(df.withColumn("m", features.median_cycle(F.col("z")["ppg"], raw=True)).where("m IS NOT NULL"), ["trial"], ["m"])


@query("fea8_slope_deviation")
def fea8(spark, sf_dir):
    df = _waves(spark, sf_dir).withColumn("c", features.aligned_cycles("ppg", ["ppg"], "pks", "dia_notches")["ppg"])
    df = features.slope_deviation(df, "c", raw=True).where("usdc IS NOT NULL")
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("curve"), F.col(c).alias("x")) for c in ("usdc", "dsdc")])).alias("z")
    return df.select("trial", both).select("trial", "z.curve", F.posexplode("z.x").alias("i", "x")).select("trial", "curve", F.col("i").cast("long").alias("i"), r6("x").alias("x"))


def _smooth_cycles(spark, sf_dir):
    """Cycles of whole windows at 100 samples: enough of them to have all points."""
    df = adapters.wide_windows(spark, sf_dir).withColumn("cs", resample_each(F.array("signal"), F.lit(100)))
    return df.withColumn("pks_norm", F.transform("cs", lambda c: F.greatest(A.argmax(c), F.lit(4))))


@query("fea13_cycle_features")
def fea13(spark, sf_dir):
    """The 97 features of each cycle, averaged over the cycles of a window (rows only)."""
    rows = features.cycle_rows(_smooth_cycles(spark, sf_dir), ["patient", "trial"], "cs", "pks_norm")
    return _scalars(features.mean_over_cycles(features.cycle_features(rows, 125.0), ["patient", "trial"]))


_CW = f"""WITH {WIDE}, k AS (SELECT trial, arg_max(i, x) AS peak, max(x) AS top FROM e GROUP BY trial),
c AS (SELECT e.trial, i, x, peak, top FROM e JOIN k USING (trial))"""


def _width_sql(s):
    h = f"top * {s / 100}"
    return f"peak - least(coalesce(min(i) FILTER (WHERE x >= {h}), peak), peak) AS SW{s}, coalesce(min(i) FILTER (WHERE i >= peak AND x <= {h}), 64) - 1 - peak AS DW{s}"


@query("fea16_widths", f"{_CW} SELECT trial, {', '.join(_width_sql(s) for s in (25, 50, 75))} FROM c GROUP BY trial, peak")
def fea16(spark, sf_dir):
    df = adapters.wide_windows(spark, sf_dir).withColumn("peak", A.argmax("signal"))
    found = features.widths(F.col("signal"), F.col("peak"), 1.0)
    return df.select("trial", *[F.round(found[f"{k}{s}"]).cast("long").alias(f"{k}{s}") for s in (25, 50, 75) for k in ("SW", "DW")])


@query("fea17_areas", f"""WITH {WIDE}, m AS (SELECT trial, min(x) AS lo FROM e GROUP BY trial),
t AS (SELECT e.trial, i, x - lo AS x, lead(x - lo) OVER (PARTITION BY e.trial ORDER BY i) AS nx FROM e JOIN m ON m.trial = e.trial),
a AS (SELECT trial, sum((x + nx) / 2) FILTER (WHERE i + 1 < 10) AS s1, sum((x + nx) / 2) FILTER (WHERE i >= 10 AND i + 1 < 20) AS s2, sum((x + nx) / 2) FILTER (WHERE i >= 20 AND i + 1 < 40) AS s3, sum((x + nx) / 2) FILTER (WHERE i >= 40) AS s4 FROM t GROUP BY trial)
SELECT trial, {r6s('s1')} AS S1, {r6s('s2')} AS S2, {r6s('s3')} AS S3, {r6s('s4')} AS S4, {r6s('s1 + s2')} AS AUCsys, {r6s('s3 + s4')} AS AUCdia, {r6s('s1 / (s1 + s2)')} AS S1_norm, {r6s('(s3 + s4) / (s1 + s2 + s3 + s4)')} AS AUCdia_norm FROM a""")
def fea17(spark, sf_dir):
    found = features.areas(F.col("signal"), F.lit(20), F.struct(F.lit(10).alias("w"), F.lit(40).alias("z")))
    return adapters.wide_windows(spark, sf_dir).select("trial", *[r6(found[k]).alias(k) for k in ("S1", "S2", "S3", "S4", "AUCsys", "AUCdia", "S1_norm", "AUCdia_norm")])


def _safe_sql(x, y):
    return f"CASE WHEN ({y}) <> 0 THEN ({x})::DOUBLE / ({y}) WHEN ({x}) <> 0 THEN 0 END"


#: Windows as lists with their first and second differences; places of the points that go from window to window.
_LISTS = f"""WITH {WIDE}, c AS (SELECT trial, list(x ORDER BY i) AS c FROM e GROUP BY trial),
d AS (SELECT trial, c, list_transform(range(1, 64), lambda i: c[i + 1] - c[i]) AS v FROM c),
q AS (SELECT *, list_transform(range(1, 63), lambda i: v[i + 1] - v[i]) AS q FROM d)"""
_SHIFTS = {"peak": (16, 7), "w": (5, 5), "y": (25, 6), "z": (33, 9), "a": (4, 4), "b": (9, 6), "c": (19, 3), "d": (27, 8), "e": (36, 5)}


def _place(n):
    return F.lit(_SHIFTS[n][0]) + (F.col("trial") % _SHIFTS[n][1]).cast("int")


_PLACES = ", ".join(f"{k} + trial % {m} AS {n}" for n, (k, m) in _SHIFTS.items())


def _duration_columns():
    times = {"Ts": "peak", "Td": "64 - peak", "Tsteepest": "w", "TNegSteepest": "y", "TdiaRise": "z", "TSystoDiaRise": "z - peak", "TdiaToEnd": "64 - z"}
    out = {"Tc": "64 / 125.0"} | {k: f"({x}) / 125.0" for k, x in times.items()} | {f"{k}_norm": f"({x}) / 64.0" for k, x in times.items()}
    return out | {"Steepest": "v[w + 1]", "NegSteepest": "v[y + 1]", "DiaRise": "c[z + 1]", "SteepDiaRise": "v[z + 1]", "Ratio": _safe_sql("c[peak + 1]", "c[z + 1]")}


@query("fea15_durations", f"{_LISTS}, p AS (SELECT *, {_PLACES} FROM q) SELECT trial, {', '.join(f'{r6s(x)} AS {n}' for n, x in _duration_columns().items())} FROM p")
def fea15(spark, sf_dir):
    """Durations, slopes and ratio of a cycle, all twenty of them, with points that go from window to window."""
    p = F.struct(*[_place(n).alias(n) for n in "wyz"])
    found = features.durations(F.col("signal"), _place("peak"), p, 125.0)
    return adapters.wide_windows(spark, sf_dir).select("trial", *[r6(found[k].cast("double")).alias(k) for k in _duration_columns()])


def _acceleration_columns():
    out = {}
    before = dict(zip("bcde", "abcd", strict=True))
    for k in "abcde":
        step, to_peak = f"{k} - {before[k]}" if k in before else "a", f"peak - {k}" if k in "ab" else f"{k} - peak"
        out |= {f"apg_{k}": f"q[{k} + 1]", f"ppg_{k}": f"c[{k} + 3]", f"T_{k}": f"({step}) / 125.0", f"T_{k}_norm": f"({step}) / 64.0", f"T_peak_{k}": f"({to_peak}) / 125.0", f"T_peak_{k}_norm": f"({to_peak}) / 64.0"}
        if k != "a":
            out |= {f"ratio_apg_{k}": _safe_sql(f"q[{k} + 1]", "q[a + 1]"), f"ratio_ppg_{k}": _safe_sql(f"c[{k} + 3]", "c[a + 3]")}
    squares = "list_sum(list_transform({}, lambda x: x * x))"
    return out | {
        "AI": _safe_sql("q[b + 1] - q[c_ + 1] - q[d + 1] - q[e + 1]", "q[a + 1]"),
        "bd": _safe_sql("v[d + 2] - v[b + 2]", "d - b"),
        "bcda": _safe_sql("q[b + 1] - q[c_ + 1] - q[d + 1]", "q[a + 1]"),
        "sdoo": _safe_sql(squares.format("v[peak + 1 : d + 1]"), squares.format("v")),
    }


def _acceleration_sql():
    # the point c is c_ here: c is the list of the samples
    point = lambda x: x.replace("q[c + 1]", "q[c_ + 1]").replace("c[c + 3]", "c[c_ + 3]").replace("(c - ", "(c_ - ").replace("- c)", "- c_)")
    places = _PLACES.replace(" AS c,", " AS c_,")
    return f"{_LISTS}, p AS (SELECT *, {places} FROM q) SELECT trial, {', '.join(f'{r6s(point(x))} AS {n}' for n, x in _acceleration_columns().items())} FROM p"


@query("fea18_acceleration", _acceleration_sql())
def fea18(spark, sf_dir):
    """All forty-two features of the points a to e, with points that go from window to window."""
    p = F.struct(*[_place(n).alias(n) for n in "abcde"])
    found = features.acceleration_features(F.col("signal"), _place("peak"), p, 125.0)
    return adapters.wide_windows(spark, sf_dir).select("trial", *[r6(found[k].cast("double")).alias(k) for k in _acceleration_columns()])


_CY = """c AS (SELECT l_suppkey AS win, date_trunc('month', l_shipdate)::TIMESTAMP AS cyc, l_quantity AS x,
  row_number() OVER (PARTITION BY l_suppkey, date_trunc('month', l_shipdate) ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS pos FROM lineitem)"""


@query("fea21_mean_over_cycles", f"""WITH {_CY}, g AS (SELECT win, cyc, sum(x) AS total, CASE WHEN count(*) > 2 THEN max(x) - min(x) END AS span FROM c GROUP BY ALL)
SELECT win, {r6s('avg(total)')} AS total, {r6s('CASE WHEN count(span) = count(*) THEN avg(span) END')} AS span FROM g GROUP BY win""")
def fea21(spark, sf_dir):
    g = adapters.cycles(spark, sf_dir).groupBy("win", "cyc").agg(F.sum("x").alias("total"), F.when(F.count("*") > 2, F.max("x") - F.min("x")).alias("span"))
    return _scalars(features.mean_over_cycles(g, ["win"]))


@query("mab2_position_stats", f"WITH {_CY} SELECT win, pos, {r6s('avg(x)')} AS mu, {r6s('stddev_pop(x)')} AS sigma, count(*) AS n FROM c GROUP BY ALL")
def mab2(spark, sf_dir):
    out = mabp.position_stats(adapters.cycles(spark, sf_dir), ["win"])
    return out.select("win", F.col("pos").cast("long").alias("pos"), r6("mu").alias("mu"), r6("sigma").alias("sigma"), "n")


_TRIM = f"""{_CY}, st AS (SELECT *, avg(x) OVER p AS mu, stddev_pop(x) OVER p AS sd FROM c WINDOW p AS (PARTITION BY win, pos)),
tm AS (SELECT win, pos, avg(x) AS x FROM st WHERE x >= mu - 1.25 * sd AND x <= mu + 1.25 * sd GROUP BY ALL)"""


@query("mab3_trimmed_mean", f"WITH {_TRIM} SELECT win, pos, {r6s('x')} AS x FROM tm")
def mab3(spark, sf_dir):
    return mabp.trimmed_mean(adapters.cycles(spark, sf_dir), ["win"]).select("win", F.col("pos").cast("long").alias("pos"), r6("x").alias("x"))


_GRAD = f"""WITH {WIDE}, g AS (SELECT *, CASE WHEN i = 0 THEN lead(x) OVER o - x WHEN i = 63 THEN x - lag(x) OVER o ELSE (lead(x) OVER o - lag(x) OVER o) / 2 END AS g FROM e WINDOW o AS (PARTITION BY trial ORDER BY i)),
a AS (SELECT trial, arg_max(i, x) FILTER (WHERE i < 28) AS peak, max(x) AS SP, min(x) AS DP FROM e GROUP BY trial),
b AS (SELECT *, (64 - peak) // 2 + peak AS stop FROM a),
y AS (SELECT b.trial, arg_min(i, g) AS y FROM b JOIN g ON g.trial = b.trial AND i >= peak AND i < stop GROUP BY b.trial),
z AS (SELECT b.trial, arg_max(i, g) AS z FROM b JOIN y ON y.trial = b.trial JOIN g ON g.trial = b.trial AND i >= y AND i < stop + 1 GROUP BY b.trial)"""


@query("mab4_landmarks", f"{_GRAD} SELECT b.trial AS trial, peak AS sys_peak, z AS dia_notch, {r6s('SP')} AS SP, {r6s('DP')} AS DP, 79::BIGINT AS limit_end FROM b JOIN z ON z.trial = b.trial")
def mab4(spark, sf_dir):
    out = mabp.landmarks(adapters.wide_windows(spark, sf_dir), "signal")
    return out.select("trial", F.col("sys_peak").cast("long").alias("sys_peak"), F.col("dia_notch").cast("long").alias("dia_notch"), r6("SP").alias("SP"), r6("DP").alias("DP"), F.get("class_limits", F.lit(3)).cast("long").alias("limit_end"))


@query("mab6_wrapped", f"WITH {WIDE} SELECT trial, r AS i, {r6s('x')} AS w FROM e JOIN range(164) t(r) ON r % 64 = i")
def mab6(spark, sf_dir):
    return long_form(adapters.wide_windows(spark, sf_dir).withColumn("w", mabp.wrapped("signal")), ["trial"], ["w"])


@query("mab7_flag_shares", f"""{beats_sql(False)} SELECT {', '.join(f"sum({k}::INT)::BIGINT AS {k}, {r6s(f'avg({k}::INT) * 100')} AS {k}_pct" for k in ('f1', 'f2', 'nocy'))}
FROM (SELECT flag1 AS f1, flag2 AS f2, len(vlys) < 2 AS nocy FROM bt)""")
def mab7(spark, sf_dir):
    df = extrema.beats(_extrema(adapters.wide_windows(spark, sf_dir)), "signal", "pks", "vlys", remove_ends=False)
    return _scalars(mabp.flag_shares(df.withColumn("cs", extrema.cycles("signal", "vlys"))))


@query("mab8_phase_masks", f"""{_GRAD} SELECT b.trial AS trial, r AS i, (r >= 64)::BIGINT AS beyond, (r < peak)::BIGINT AS rise, (r >= peak AND r < z)::BIGINT AS fall, (r >= z AND r < 64)::BIGINT AS rest, (r < 79)::BIGINT AS valid
FROM b JOIN z ON z.trial = b.trial, range(164) t(r)""")
def mab8(spark, sf_dir):
    df = mabp.landmarks(adapters.wide_windows(spark, sf_dir), "signal").withColumns({"m": mabp.phase_masks(), "v": mabp.valid_mask()})
    rows = df.select("trial", F.posexplode(F.arrays_zip(*[F.get("m", F.lit(k)).alias(n) for k, n in enumerate(("beyond", "rise", "fall", "rest"))], F.col("v").alias("valid"))).alias("i", "z"))
    return rows.select("trial", F.col("i").cast("long").alias("i"), *[F.col(f"z.{n}").cast("long").alias(n) for n in ("beyond", "rise", "fall", "rest", "valid")])
