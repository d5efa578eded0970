"""Labels, rules, quality figures and transforms of windows."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import quality, signals
from ..operators.segment import WindowSpec, windows
from ..sources import adapters
from . import FEATURES, WIDE, WINDOWS, long_form, maxima_sql, query, r6, r6s


def short(spark, sf_dir):
    return windows(adapters.records(spark, sf_dir), WindowSpec(16, 16), ["signal", "abp_signal"])


_LABELS = f"WITH {WINDOWS}, l AS (SELECT patient, j, max(abp) AS SP, min(abp) AS DP FROM w GROUP BY ALL)"


@query("flt1_naive_labels", f"{_LABELS} SELECT patient, j, SP, DP FROM l")
def flt1(spark, sf_dir):
    return short(spark, sf_dir).withColumns(quality.naive_labels()).select("patient", F.col("j").cast("long").alias("j"), "SP", "DP")


@query("flt2_abnormal_pressure", f"WITH {FEATURES} SELECT patient, trial, {r6s('SP')} AS SP, {r6s('DP')} AS DP FROM f WHERE SP <= 190 AND DP >= 45 AND SP - DP >= 10")
def flt2(spark, sf_dir):
    return quality.keep(adapters.feature_rows(spark, sf_dir), quality.pressure_rules(sp_max=190, dp_min=45)).select("patient", "trial", r6("SP").alias("SP"), r6("DP").alias("DP"))


@query("agg2_rule_audit", f"""WITH {FEATURES} SELECT 'pressure' AS step, rule, count(*) FILTER (WHERE bad) AS removed FROM (
  SELECT unnest(['sp_high', 'dp_low', 'pulse_low']) AS rule, unnest([NOT SP <= 190, NOT DP >= 45, NOT SP - DP >= 10]) AS bad FROM f) GROUP BY rule""")
def agg2(spark, sf_dir):
    return quality.audit(adapters.feature_rows(spark, sf_dir), "pressure", quality.pressure_rules(sp_max=190, dp_min=45))


@query("agg1_sizes", f"WITH {WINDOWS} SELECT 'windows' AS step, count(DISTINCT patient) AS patients, count(DISTINCT regexp_replace(patient || '_' || j, '_[^_]*$', '')) AS records, count(*) AS rows FROM (SELECT DISTINCT patient, j FROM w)")
def agg1(spark, sf_dir):
    return quality.sizes(short(spark, sf_dir), "windows")


def _extrema(df, signal="signal"):
    return df.withColumns({"pks": A.maxima(signal), "vlys": A.minima(signal)})


_E = f"WITH {WIDE}, {maxima_sql('e', 'pk', 'trial')}, {maxima_sql('e', 'vl', 'trial', sign='-')}".replace("lag(-x)", "lag(x)")
_STATS = f"""{_E},
d AS (SELECT trial, 'p' AS kind, p, p - lag(p) OVER (PARTITION BY trial ORDER BY p) AS gap FROM pk UNION ALL SELECT trial, 'v', p, p - lag(p) OVER (PARTITION BY trial ORDER BY p) FROM vl),
a AS (SELECT d.*, x, x - lag(x) OVER (PARTITION BY d.trial, kind ORDER BY p) AS step FROM d JOIN e ON e.trial = d.trial AND e.i = p),
q AS (SELECT trial, kind, count(*) AS n, median(gap) AS med, stddev_pop(gap) AS gap_std, 60 * 8 / median(gap) AS bpm, stddev_pop(x) AS amp_std, stddev_pop(step) AS amp_dif_std FROM a GROUP BY ALL),
z AS (SELECT p.trial, p.n AS n_pks, v.n AS n_vlys, p.med AS p2p, p.gap_std AS p2p_std, p.bpm AS pks_bpm, v.med AS v2v, v.gap_std AS v2v_std, v.bpm AS vlys_bpm,
  p.amp_std AS pks_amp_std, p.amp_dif_std AS pks_amp_dif_std, v.amp_std AS vlys_amp_std, v.amp_dif_std AS vlys_amp_dif_std FROM q p JOIN q v ON p.trial = v.trial AND p.kind = 'p' AND v.kind = 'v')"""
_NAMES = ["p2p", "p2p_std", "pks_bpm", "v2v", "v2v_std", "vlys_bpm", "pks_amp_std", "pks_amp_dif_std", "vlys_amp_std", "vlys_amp_dif_std"]


def _stats(spark, sf_dir):
    df = _extrema(adapters.wide_windows(spark, sf_dir))
    return df.withColumns(quality.interval_stats("pks", 8, "p2p", "pks_bpm") | quality.interval_stats("vlys", 8, "v2v", "vlys_bpm") | quality.amplitude_stats("signal", "pks", "pks") | quality.amplitude_stats("signal", "vlys", "vlys"))


@query("qlt1_interval_and_amplitude_stats", f"{_STATS} SELECT trial, n_pks, n_vlys, {', '.join(f'{r6s(c)} AS {c}' for c in _NAMES)} FROM z")
def qlt1(spark, sf_dir):
    return _stats(spark, sf_dir).select("trial", F.size("pks").cast("long").alias("n_pks"), F.size("vlys").cast("long").alias("n_vlys"), *[r6(c).alias(c) for c in _NAMES])


@query("flt3_beat_rules", f"""{_STATS} SELECT trial, n_pks, n_vlys FROM z
WHERE n_pks > 15 AND n_pks < 25 AND n_vlys > 15 AND n_vlys < 25 AND pks_bpm BETWEEN 140 AND 250 AND vlys_bpm BETWEEN 140 AND 250""")
def flt3(spark, sf_dir):
    """Counts and rates of beats, with limits that fit these windows."""
    df = _stats(spark, sf_dir)
    counted = df.where(F.size("pks").between(16, 24) & F.size("vlys").between(16, 24))
    return quality.keep(counted, quality.rate_rules(140, 250)).select("trial", F.size("pks").cast("long").alias("n_pks"), F.size("vlys").cast("long").alias("n_vlys"))


_W = WINDOWS.replace("s AS (", "s AS MATERIALIZED (", 1)
_SHORT = f"WITH {_W}, {maxima_sql('w', 'pk', 'patient, j', 'ppg')}, {maxima_sql('w', 'vl', 'patient, j', 'ppg', sign='-')}"
_RATES = f"""{_SHORT}, k AS (SELECT DISTINCT patient, j FROM w),
pr AS (SELECT patient, j, count(*) AS n, 480 / median(gap) AS bpm FROM (SELECT *, p - lag(p) OVER (PARTITION BY patient, j ORDER BY p) AS gap FROM pk) GROUP BY ALL),
vr AS (SELECT patient, j, count(*) AS n, 480 / median(gap) AS bpm FROM (SELECT *, p - lag(p) OVER (PARTITION BY patient, j ORDER BY p) AS gap FROM vl) GROUP BY ALL),
r AS (SELECT k.patient, k.j, coalesce(pr.n, 0) AS np, coalesce(vr.n, 0) AS nv, pr.bpm AS pb, vr.bpm AS vb FROM k LEFT JOIN pr USING (patient, j) LEFT JOIN vr USING (patient, j))"""


@query("flt4_flt5_rate_rules", f"""{_RATES} SELECT patient, j, coalesce(pb BETWEEN 100 AND 170 AND vb BETWEEN 100 AND 170, false) AS strict, coalesce(coalesce(pb BETWEEN 100 AND 170, true) AND vb BETWEEN 100 AND 170, false) AS lenient,
  np > 1 AND nv < 13 AND np < 12 AND nv > 2 AS counted, np > 1 AND nv > 2 AS enough FROM r""")
def flt4(spark, sf_dir):
    """Each rule of beats as a column: rates with and without single beats, counts, the least number."""
    df = _extrema(short(spark, sf_dir)).withColumns(quality.interval_stats("pks", 8, "p2p", "pks_bpm") | quality.interval_stats("vlys", 8, "v2v", "vlys_bpm"))

    def all_of(rules):
        out = F.lit(True)
        for r in rules.values():
            out = out & r
        return out

    return df.select(
        "patient", F.col("j").cast("long").alias("j"), all_of(quality.rate_rules(100, 170)).alias("strict"), all_of(quality.rate_rules(100, 170, keep_single=True)).alias("lenient"),
        all_of(quality.beat_count_rules()).alias("counted"), all_of(quality.enough_extrema_rule()).alias("enough"),
    )


_P2V = f"""{_SHORT},
p AS (SELECT pk.patient, pk.j, ppg AS h, row_number() OVER (PARTITION BY pk.patient, pk.j ORDER BY p DESC) AS r FROM pk JOIN w ON w.patient = pk.patient AND w.j = pk.j AND w.i = p),
v AS (SELECT vl.patient, vl.j, ppg AS h, row_number() OVER (PARTITION BY vl.patient, vl.j ORDER BY p DESC) AS r FROM vl JOIN w ON w.patient = vl.patient AND w.j = vl.j AND w.i = p),
m AS (SELECT patient, j, avg(p.h - v.h) AS p2v FROM p JOIN v USING (patient, j, r) GROUP BY ALL)"""


@query("flt7_peak_to_valley", f"{_P2V} SELECT patient, j, {r6s('p2v')} AS p2v FROM (SELECT DISTINCT patient, j FROM w) LEFT JOIN m USING (patient, j)")
def flt7(spark, sf_dir):
    df = _extrema(short(spark, sf_dir))
    return df.select("patient", F.col("j").cast("long").alias("j"), r6(quality.peak_to_valley("signal", "pks", "vlys")).alias("p2v"))


@query("flt6_pulse_pressure", f"{_P2V}, l AS (SELECT patient, j, max(abp) AS SP, min(abp) AS DP FROM w GROUP BY ALL) SELECT patient, j, SP, DP FROM l JOIN m USING (patient, j) WHERE SP - DP > 10 AND p2v > 10")
def flt6(spark, sf_dir):
    df = _extrema(short(spark, sf_dir)).withColumns(quality.naive_labels()).withColumn("p2v", quality.peak_to_valley("signal", "pks", "vlys"))
    return quality.keep(df, quality.pulse_rules()).select("patient", F.col("j").cast("long").alias("j"), "SP", "DP")


_STEPS = f"""{_P2V}, l AS (SELECT patient, j, max(abp) AS SP, min(abp) AS DP FROM w GROUP BY ALL),
{_RATES[len(_SHORT) + 2:]},
x AS (SELECT r.*, SP, DP, p2v FROM r JOIN l USING (patient, j) LEFT JOIN m USING (patient, j)),
a AS (SELECT *, SP <= 220 AND DP >= 1 AND SP - DP >= 10 AS a_ok FROM x),
b AS (SELECT *, a_ok AND np BETWEEN 2 AND 11 AND nv BETWEEN 3 AND 12 AS b_ok FROM a),
c AS (SELECT *, b_ok AND coalesce(pb BETWEEN 100 AND 170, false) AND coalesce(vb BETWEEN 100 AND 170, false) AS c_ok FROM b),
d AS (SELECT *, c_ok AND coalesce(SP - DP > 90, false) AND coalesce(p2v > 45, false) AS d_ok FROM c),
t AS (
  SELECT true AS seen, ['pressure', 'pressure', 'pressure'] AS steps, ['sp_high', 'dp_low', 'pulse_low'] AS rules, [SP <= 220, DP >= 1, SP - DP >= 10] AS ok FROM d
  UNION ALL SELECT a_ok, ['beats', 'beats'], ['peaks', 'valleys'], [np BETWEEN 2 AND 11, nv BETWEEN 3 AND 12] FROM d
  UNION ALL SELECT b_ok, ['rate', 'rate'], ['peak_rate', 'valley_rate'], [coalesce(pb BETWEEN 100 AND 170, false), coalesce(vb BETWEEN 100 AND 170, false)] FROM d
  UNION ALL SELECT c_ok, ['pulse', 'pulse'], ['pulse', 'height'], [coalesce(SP - DP > 90, false), coalesce(p2v > 45, false)] FROM d
  UNION ALL SELECT true, ['end'], ['removed'], [d_ok] FROM d)
SELECT step, rule, count(*) FILTER (WHERE seen AND NOT ok) AS removed FROM (SELECT seen, unnest(steps) AS step, unnest(rules) AS rule, unnest(ok) AS ok FROM t) GROUP BY ALL"""


@query("pip1_cleaning_steps", _STEPS)
def pip1(spark, sf_dir):
    """Four rule sets one after the other in one pass, with what each rule removes; the last row counts all windows that are gone."""
    audit, all_windows = quality.Audit(), Observation()
    df = short(spark, sf_dir).withColumns(quality.naive_labels()).observe(all_windows, F.count("*").alias("n"))
    df = _extrema(audit.step(df, "pressure", quality.pressure_rules(dp_min=1)))
    df = audit.step(df, "beats", quality.beat_count_rules())
    df = df.withColumns(quality.interval_stats("pks", 8, "p2p", "pks_bpm") | quality.interval_stats("vlys", 8, "v2v", "vlys_bpm"))
    df = audit.step(df, "rate", quality.rate_rules(100, 170)).withColumn("p2v", quality.peak_to_valley("signal", "pks", "vlys"))
    kept = Observation()
    df = audit.step(df, "pulse", {"pulse": quality.pulse_rules(least=90)["pulse"], "height": quality.pulse_rules(least=45)["height"]}).observe(kept, F.count("*").alias("n"))
    df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([*audit.rows(), ("end", "removed", all_windows.get["n"] - kept.get["n"])], quality.AUDIT)


@query("flt10_distorted", f"{_STATS} SELECT trial FROM z WHERE p2p_std <= 1.2 AND v2v_std <= 1.2 AND pks_amp_std <= 0.09 AND vlys_amp_std <= 0.09")
def flt10(spark, sf_dir):
    return quality.keep(_stats(spark, sf_dir), quality.distortion_rules(1.2, 0.09)).select("trial")


@query("flt11_clean_features", f"""WITH {FEATURES} SELECT patient, trial, CASE WHEN f4 = 1 THEN 0 ELSE f1 / (f4 - 1) END AS f1, f3 FROM f WHERE f3 > 0.03""")
def flt11(spark, sf_dir):
    """Features that are infinite or missing, made from the feature rows."""
    df = adapters.feature_rows(spark, sf_dir)
    one = F.col("f4") == 1
    df = df.withColumns({"bd": F.when(F.col("f3") > 0.03, F.col("f3")).when(F.col("f3") > 0.01, F.lit(float("nan"))), "f1": F.when(one, float("inf")).otherwise(F.col("f1") / F.when(one, 1.0).otherwise(F.col("f4") - 1))})
    return quality.clean_features(df, ["f1", "bd"]).select("patient", "trial", r6("f1").alias("f1"), r6("bd").alias("f3"))


from . import ORACLE  # noqa: E402

ORACLE["flt11_clean_features"] = ORACLE["flt11_clean_features"].replace("CASE WHEN f4 = 1 THEN 0 ELSE f1 / (f4 - 1) END AS f1, f3", f"{r6s('CASE WHEN f4 = 1 THEN 0 ELSE f1 / (f4 - 1) END')} AS f1, {r6s('f3')} AS f3")

_SQI = f"""WITH {WINDOWS}, m AS (SELECT patient, j, avg(ppg) AS mu, stddev_pop(ppg) AS sd FROM w GROUP BY ALL),
fl AS (SELECT patient, j, count(*) FILTER (WHERE abs(step) < 0.5) / 16 AS flat FROM (SELECT *, ppg - lag(ppg) OVER (PARTITION BY patient, j ORDER BY i) AS step FROM w) GROUP BY ALL),
q AS (SELECT patient, j, flat, avg(((ppg - mu) / (sd + 1e-6)) ** 3) AS sk, 1 / (sum(((ppg - mu) / (sd + 1e-6)) ** 4) / (16 + 1e-6) + 1e-6) AS ku FROM w JOIN m USING (patient, j) JOIN fl USING (patient, j) GROUP BY ALL)"""


@query("sqi_flat_skew_kurtosis", f"{_SQI} SELECT patient, j, {r6s('flat')} AS flat, {r6s('CASE WHEN flat > 0.05 THEN 0 ELSE sk END')} AS skew, {r6s('ku')} AS kurtosis FROM q")
def sqi(spark, sf_dir):
    flat = A.flat_share("signal", 0.5)
    skew = F.when(flat > 0.05, 0.0).otherwise(A.skewness("signal", 2.0))
    return short(spark, sf_dir).select("patient", F.col("j").cast("long").alias("j"), r6(flat).alias("flat"), r6(skew).alias("skew"), r6(quality.kurtosis_index("signal")).alias("kurtosis"))


@query("flt12_skewed_windows", f"{_SQI} SELECT patient, j FROM q WHERE sk > 0.5")
def flt12(spark, sf_dir):
    return short(spark, sf_dir).where(A.skewness("signal", 2.0) > 0.5).select("patient", F.col("j").cast("long").alias("j"))


@query("flt13_deny_list", f"WITH {WINDOWS} SELECT DISTINCT patient, patient || '_' || j AS trial FROM w WHERE NOT (patient % 5 = 0 AND j = 1)")
def flt13(spark, sf_dir):
    from ..operators.joins import without

    rows = short(spark, sf_dir).select("patient", "trial")
    deny = adapters.records(spark, sf_dir).where("patient % 5 = 0").select(F.concat_ws("_", F.col("patient").cast("string"), F.lit("1")).alias("trial"))
    return without(rows, deny, ["trial"]).select("patient", "trial")


@query("flt14_truncate", """WITH r AS (SELECT user_id AS patient, count(*) AS n FROM events GROUP BY user_id) SELECT patient, least(n, (SELECT n FROM r ORDER BY patient LIMIT 1)) AS n FROM r""")
def flt14(spark, sf_dir):
    return quality.truncated(adapters.records(spark, sf_dir), "signal", ["patient"]).select("patient", F.size("signal").cast("long").alias("n"))


@query("flt15_outliers", f"""{_E}, p AS (SELECT pk.trial, p, x FROM pk JOIN e ON e.trial = pk.trial AND i = p), v AS (SELECT vl.trial, p, x FROM vl JOIN e ON e.trial = vl.trial AND i = p),
o AS (SELECT trial, 'valley' AS kind, arg_min(p, x) AS i FROM v GROUP BY trial HAVING min(x) < avg(x) - 2 * stddev_pop(x) UNION ALL SELECT trial, 'peak', arg_max(p, x) FROM p GROUP BY trial HAVING max(x) > avg(x) + 2 * stddev_pop(x))
SELECT trial, i FROM o""")
def flt15(spark, sf_dir):
    df = _extrema(adapters.wide_windows(spark, sf_dir))
    return df.select("trial", F.explode(F.transform(quality.outliers("signal", "pks", "vlys", 2.0), lambda x: x.cast("long"))).alias("i"))


# ---------------------------------------------------------------- transforms

_N = f"{WINDOWS}, m AS (SELECT patient, j, min(ppg) AS lo, max(ppg) AS hi, avg(ppg) AS mu, stddev_pop(ppg) AS sd FROM w GROUP BY ALL)"


@query("sig1_scale_centre", f"""WITH {_N} SELECT patient, j, i, {r6s('(ppg - lo) / (hi - lo + 1e-10)')} AS mm, {r6s('(ppg - lo) / (hi - lo + 1e-6)')} AS norm, {r6s('(ppg - mu) / (sd + 1e-6)')} AS z, {r6s('ppg - mu')} AS centred
FROM w JOIN m USING (patient, j)""")
def sig1(spark, sf_dir):
    df = short(spark, sf_dir).withColumn("j", F.col("j").cast("long"))
    return long_form(df.withColumns({"mm": A.min_max("signal", 1e-10), "norm": A.min_max("signal", 1e-6), "z": A.z_score("signal"), "centred": A.centred("signal")}), ["patient", "j"], ["mm", "norm", "z", "centred"])


_D = "coalesce(CASE WHEN i >= {k} THEN {f} END, 0)"


def _lag(k):
    return f"lag(ppg, {k}) OVER o"


@query("sig8_derivatives", f"""WITH {WINDOWS} SELECT patient, j, i, {r6s(_D.format(k=1, f='ppg - ' + _lag(1)))} AS vpg, {r6s(_D.format(k=2, f=f'ppg - 2 * {_lag(1)} + {_lag(2)}'))} AS apg,
  {r6s(_D.format(k=3, f=f'ppg - 3 * {_lag(1)} + 3 * {_lag(2)} - {_lag(3)}'))} AS ppg3, {r6s(_D.format(k=4, f=f'ppg - 4 * {_lag(1)} + 6 * {_lag(2)} - 4 * {_lag(3)} + {_lag(4)}'))} AS ppg4
FROM w WINDOW o AS (PARTITION BY patient, j ORDER BY i)""")
def sig8(spark, sf_dir):
    df = short(spark, sf_dir).withColumn("j", F.col("j").cast("long")).withColumns(signals.derivatives("signal"))
    return long_form(df, ["patient", "j"], ["vpg", "apg", "ppg3", "ppg4"])


@query("sig9_differences", f"WITH {WINDOWS} SELECT patient, j, i - 1 AS i, {r6s('d')} AS d FROM (SELECT *, ppg - lag(ppg) OVER (PARTITION BY patient, j ORDER BY i) AS d FROM w) WHERE i > 0")
def sig9(spark, sf_dir):
    return long_form(short(spark, sf_dir).withColumns({"j": F.col("j").cast("long"), "d": A.diff("signal")}), ["patient", "j"], ["d"])


@query("sig10_smoothed_derivative", f"""WITH {WINDOWS}, k(o, c) AS (VALUES (-3, 22), (-2, -67), (-1, -58), (1, 58), (2, 67), (3, -22)),
t AS (SELECT patient, j, w.i AS i, sum(c * b.ppg) / 252 AS d FROM w, k JOIN w b ON b.patient = w.patient AND b.j = w.j AND b.i = CASE WHEN w.i + o < 0 THEN -(w.i + o) WHEN w.i + o > 15 THEN 30 - (w.i + o) ELSE w.i + o END GROUP BY ALL)
SELECT patient, j, i, {r6s('d')} AS d FROM t""".replace("SELECT patient, j, w.i AS i, sum", "SELECT w.patient, w.j, w.i AS i, sum").replace("FROM w, k JOIN", "FROM w CROSS JOIN k JOIN"))
def sig10(spark, sf_dir):
    return long_form(short(spark, sf_dir).withColumns({"j": F.col("j").cast("long"), "d": signals.smoothed_derivative("signal")}), ["patient", "j"], ["d"])


@query("sig11_channels", f"""WITH {WINDOWS} SELECT patient, j, i, {r6s('ppg')} AS c0, {r6s('coalesce(ppg - lag(ppg) OVER (PARTITION BY patient, j ORDER BY i), 0)')} AS c1, 1.0 AS c2, {r6s('ppg')} AS abp FROM w""".replace("1.0 AS c2", "1.0::DOUBLE AS c2"))
def sig11(spark, sf_dir):
    df = signals.with_pressure(short(spark, sf_dir).drop("abp_signal").withColumn("vpg", A.padded_diff("signal")))
    df = df.withColumn("x", signals.channels("signal", "vpg", 1.0, like="signal"))
    return long_form(df.select("patient", F.col("j").cast("long").alias("j"), *[F.get("x", F.lit(i)).alias(f"c{i}") for i in range(3)], F.col("abp_signal").alias("abp")), ["patient", "j"], ["c0", "c1", "c2", "abp"])


@query("sig13_spectrum", f"""WITH {WIDE}, f AS (SELECT trial, k, sum(x * cos(2 * pi() * k * i / 64)) AS re, sum(x * sin(2 * pi() * k * i / 64)) AS im FROM e, range(1, 32) t(k) GROUP BY ALL),
m AS (SELECT trial, k, sqrt(re * re + im * im) AS a FROM f)
SELECT trial, k - 1 AS i, {r6s('a / sqrt(sum(a * a) OVER (PARTITION BY trial))')} AS s FROM m""")
def sig13(spark, sf_dir):
    from ..functions.vec import spectrum

    return long_form(adapters.wide_windows(spark, sf_dir).withColumn("s", spectrum("signal")), ["trial"], ["s"])


@query("sig6_filtered")
def sig6(spark, sf_dir):
    """Band-passed, scaled windows (rows only: SQL has no zero-phase filter)."""
    return long_form(adapters.wide_windows(spark, sf_dir).withColumn("f", signals.filtered("signal", 0.5, 3.0, 8)), ["trial"], ["f"])


@query("sig7_baseline")
def sig7(spark, sf_dir):
    """Windows without their baseline, a spline through the valleys (rows only)."""
    df = signals.without_baseline(_extrema(adapters.wide_windows(spark, sf_dir)), "signal", "vlys").where("baseline IS NOT NULL")
    return long_form(df, ["trial"], ["signal", "baseline"])
