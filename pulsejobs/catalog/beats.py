"""Peaks, valleys, cycles."""

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import extrema
from ..sources import adapters
from . import WIDE, query, r6, r6s
from .windows import _E, _extrema


@query("pks2_local_maxima", f"{_E} SELECT trial, 'peak' AS kind, p AS i FROM pk UNION ALL SELECT trial, 'valley', p FROM vl")
def pks2(spark, sf_dir):
    df = _extrema(adapters.wide_windows(spark, sf_dir))
    one = lambda c, k: df.select("trial", F.lit(k).alias("kind"), F.explode(F.transform(c, lambda x: x.cast("long"))).alias("i"))
    return one("pks", "peak").union(one("vlys", "valley"))


@query("pks1_multi_scale_peaks", f"""WITH {WIDE}, r AS (SELECT trial, regr_slope(x, i) AS b, regr_intercept(x, i) AS a FROM e GROUP BY trial),
d AS MATERIALIZED (SELECT trial, i, x - a - b * i AS y FROM e JOIN r USING (trial)),
m AS MATERIALIZED (SELECT d.trial, k, d.i FROM d CROSS JOIN range(1, 9) t(k) LEFT JOIN d l ON l.trial = d.trial AND l.i = d.i - k LEFT JOIN d h ON h.trial = d.trial AND h.i = d.i + k
  WHERE coalesce(d.y > l.y, true) AND coalesce(d.y > h.y, true)),
c AS (SELECT trial, k, count(*) * (33 - k) AS weight FROM m GROUP BY trial, k),
best AS (SELECT trial, min(k) AS k FROM (SELECT *, max(weight) OVER (PARTITION BY trial) AS top FROM c) WHERE weight = top GROUP BY trial)
SELECT m.trial AS trial, m.i AS i FROM m JOIN best ON best.trial = m.trial AND m.k <= best.k WHERE m.i > 0 AND m.i < 63 GROUP BY m.trial, m.i HAVING count(*) = max(best.k)""")
def pks1(spark, sf_dir):
    return adapters.wide_windows(spark, sf_dir).select("trial", F.explode(F.transform(extrema.find_peaks("signal", 8), lambda x: x.cast("long"))).alias("i"))


def _beats(spark, sf_dir, remove_ends=True):
    return extrema.beats(_extrema(adapters.wide_windows(spark, sf_dir)), "signal", "pks", "vlys", remove_ends=remove_ends)


def beats_sql(remove_ends: bool) -> str:
    """CTEs up to bt (trial, flag1, flag2, pks, vlys): the beats of each window, by lists."""
    ends = """b1 AS (SELECT trial, sig, CASE WHEN p[1] < v[1] THEN list_slice(p, 2, len(p)) ELSE p END AS p, CASE WHEN p[1] < v[1] THEN v ELSE list_slice(v, 2, len(v)) END AS v FROM b0),
b2 AS (SELECT trial, sig, CASE WHEN p[len(p)] > v[len(v)] THEN list_slice(p, 1, len(p) - 1) ELSE p END AS p, CASE WHEN p[len(p)] > v[len(v)] THEN v ELSE list_slice(v, 1, len(v) - 1) END AS v FROM b1 WHERE len(p) > 0 AND len(v) > 0)"""
    return f"""{_E}, sg AS (SELECT trial, list(x ORDER BY i) AS sig FROM e GROUP BY trial),
b0 AS (SELECT sg.trial AS trial, sig, p, v FROM sg JOIN (SELECT trial, list(p ORDER BY p) AS p FROM pk GROUP BY trial) a ON a.trial = sg.trial JOIN (SELECT trial, list(p ORDER BY p) AS v FROM vl GROUP BY trial) b ON b.trial = sg.trial),
{ends if remove_ends else 'b2 AS (SELECT * FROM b0)'},
b3 AS (SELECT trial, sig, v, list_filter(p, lambda x: x >= v[1] AND x <= v[len(v)]) AS p, list_avg(list_transform(v, lambda x: sig[x + 1])) AS base FROM b2 WHERE len(v) > 0),
b4 AS (SELECT trial, v, p, list_transform(p, lambda x: {{'k': [x], 'h': sig[x + 1] - base}}) AS h FROM b3 WHERE len(p) > 0),
b5 AS (SELECT *, CASE WHEN len(p) = 1 THEN 1 ELSE list_filter(range(1, len(p)), lambda i: h[i].h > h[i + 1].h * 0.6)[1] END AS first FROM b4),
b6 AS (SELECT trial, p, v, list_reduce(list_slice(h, first, len(h)), lambda s, x: CASE WHEN x.h > s.h * 0.6 THEN {{'k': list_concat(s.k, x.k), 'h': x.h}} ELSE s END).k AS new FROM b5 WHERE first IS NOT NULL),
bt AS (SELECT sg.trial AS trial, coalesce(new <> p, true) AS flag1, coalesce(len(v) - 1 <> len(new) OR len(list_filter(range(1, len(new) + 1), lambda i: v[i] < new[i] AND new[i] < v[i + 1])) < len(new), true) AS flag2,
  coalesce(new, []) AS pks, CASE WHEN new IS NULL THEN [] ELSE v END AS vlys FROM sg LEFT JOIN b6 ON b6.trial = sg.trial)"""


@query("pks3_beats", f"{beats_sql(True)} SELECT trial, flag1, flag2, array_to_string(pks, ',') AS pks, array_to_string(vlys, ',') AS vlys FROM bt")
def pks3(spark, sf_dir):
    """Beat-structured peaks and valleys with their flags."""
    return _beats(spark, sf_dir).select("trial", "flag1", "flag2", F.array_join(F.transform("pks", lambda x: x.cast("string")), ",").alias("pks"), F.array_join(F.transform("vlys", lambda x: x.cast("string")), ",").alias("vlys"))


@query("pks4_valleys_before_peaks", f"""{_E}, b AS (SELECT pk.trial, max(vl.p) AS i FROM pk JOIN vl ON vl.trial = pk.trial AND vl.p < pk.p GROUP BY pk.trial, pk.p UNION SELECT trial, max(p) FROM vl GROUP BY trial)
SELECT DISTINCT trial, i FROM b""")
def pks4(spark, sf_dir):
    df = _extrema(adapters.wide_windows(spark, sf_dir))
    return df.select("trial", F.explode(F.transform(extrema.valleys_before_peaks("pks", "vlys"), lambda x: x.cast("long"))).alias("i"))


@query("pks5_cycles", f"""{_E}, b AS (SELECT trial, row_number() OVER o - 1 AS cyc, p AS lo, lead(p) OVER o AS hi FROM vl WINDOW o AS (PARTITION BY trial ORDER BY p))
SELECT trial, cyc, i - lo AS pos, {r6s('x')} AS x FROM b JOIN e USING (trial) WHERE i >= lo AND i < hi""")
def pks5(spark, sf_dir):
    df = _extrema(adapters.wide_windows(spark, sf_dir))
    each = df.select("trial", F.posexplode(extrema.cycles("signal", "vlys")).alias("cyc", "c"))
    return each.select("trial", F.col("cyc").cast("long").alias("cyc"), F.posexplode("c").alias("pos", "x")).select("trial", "cyc", F.col("pos").cast("long").alias("pos"), r6("x").alias("x"))


@query("pks6_pressure_from_wave", f"""{_E} SELECT t.trial AS trial, {r6s('coalesce(sp, -1)')} AS SP, {r6s('coalesce(dp, -1)')} AS DP FROM (SELECT DISTINCT trial FROM e) t
LEFT JOIN (SELECT pk.trial, median(x) AS sp FROM pk JOIN e ON e.trial = pk.trial AND i = p GROUP BY pk.trial) a ON a.trial = t.trial LEFT JOIN (SELECT vl.trial, median(x) AS dp FROM vl JOIN e ON e.trial = vl.trial AND i = p GROUP BY vl.trial) b ON b.trial = t.trial""")
def pks6(spark, sf_dir):
    found = extrema.pressure_from_wave("signal", "pks", "vlys")
    return _extrema(adapters.wide_windows(spark, sf_dir)).select("trial", *[r6(v).alias(k) for k, v in found.items()])


@query("pks7_masks", f"""{_E} SELECT e.trial AS trial, i, pk.p IS NOT NULL AS peak, vl.p IS NOT NULL AS valley FROM e LEFT JOIN pk ON pk.trial = e.trial AND pk.p = i LEFT JOIN vl ON vl.trial = e.trial AND vl.p = i""")
def pks7(spark, sf_dir):
    df = _extrema(adapters.wide_windows(spark, sf_dir))
    zipped = F.posexplode(F.arrays_zip(extrema.mask("signal", "pks").alias("p"), extrema.mask("signal", "vlys").alias("v"))).alias("i", "z")
    return df.select("trial", zipped).select("trial", F.col("i").cast("long").alias("i"), F.col("z.p").alias("peak"), F.col("z.v").alias("valley"))
