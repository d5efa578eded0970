"""Window statistics, labels and filter rules. Every rule is a boolean column, so one aggregation audits them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A

AUDIT = "step string, rule string, removed long"


def naive_labels(abp: str = "abp_signal") -> dict[str, Column]:
    return {"SP": F.array_max(abp), "DP": F.array_min(abp)}


def pressure_rules(sp: str = "SP", dp: str = "DP", sp_max: float = 220, dp_min: float = 30, diff_min: float = 10) -> dict[str, Column]:
    """Keep when SP <= 220, DP >= 30 and SP - DP >= 10; limits included."""
    return {"sp_high": F.col(sp) <= sp_max, "dp_low": F.col(dp) >= dp_min, "pulse_low": F.col(sp) - F.col(dp) >= diff_min}


def beat_count_rules(pks: str = "pks", vlys: str = "vlys") -> dict[str, Column]:
    """Keep more than 1 and fewer than 12 peaks, more than 2 and fewer than 13 valleys."""
    return {"peaks": F.size(pks).between(2, 11), "valleys": F.size(vlys).between(3, 12)}


def rate_rules(lo: float = 35, hi: float = 140, pks_bpm: str = "pks_bpm", vlys_bpm: str = "vlys_bpm", keep_single: bool = False) -> dict[str, Column]:
    """Keep heart rates in [lo, hi]. A missing rate fails, except that ``keep_single`` keeps a missing peak rate."""
    return {"peak_rate": F.coalesce(F.col(pks_bpm).between(lo, hi), F.lit(keep_single)), "valley_rate": F.coalesce(F.col(vlys_bpm).between(lo, hi), F.lit(False))}


def enough_extrema_rule(pks: str = "pks", vlys: str = "vlys") -> dict[str, Column]:
    return {"few_extrema": (F.size(pks) > 1) & (F.size(vlys) > 2)}


def pulse_rules(sp: str = "SP", dp: str = "DP", p2v: str = "p2v", least: float = 10) -> dict[str, Column]:
    """Drop when SP - DP <= 10 or the mean peak-to-valley height <= 10."""
    return {"pulse": F.coalesce(F.col(sp) - F.col(dp) > least, F.lit(False)), "height": F.coalesce(F.col(p2v) > least, F.lit(False))}


def distortion_rules(interval: float = 30, amplitude: float = 0.5, first: bool = True) -> dict[str, Column]:
    """Keep interval deviations <= 30 and amplitude deviations <= 0.5, of peaks and, in the first pass, valleys. Missing fails."""
    rules = {"p2p_std": F.col("p2p_std") <= interval, "pks_amp_std": F.col("pks_amp_std") <= amplitude}
    if first:
        rules |= {"v2v_std": F.col("v2v_std") <= interval, "vlys_amp_std": F.col("vlys_amp_std") <= amplitude}
    return {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}


def keep(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    out = F.lit(True)
    for r in rules.values():
        out = out & r
    return df.where(out)


def audit(df: DataFrame, step: str, rules: dict[str, Column]) -> DataFrame:
    """(step, rule, removed): how many rows each rule on its own removes; rules overlap. One pass."""
    names = list(rules)
    counted = df.agg(*[F.sum(F.when(rules[n], 0).otherwise(1)).alias(n) for n in names])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("removed")) for n in names]))
    return counted.select(pairs.alias("r")).select(F.lit(step).alias("step"), "r.rule", "r.removed")


class Audit:
    """Rules in steps over one pass of the rows; what each rule removes is counted while the rows go by.

    ``step`` notes a rule set and gives the rows that pass it. The counts are
    observed metrics of the query that the rows end in: one write of the last
    table fills them all, and nothing is read twice. They are sums of the
    tasks that count for the result, so they hold when executors are lost,
    as long as no shuffle follows the steps (a stage that is run again
    before a shuffle may count its rows again).
    """

    def __init__(self) -> None:
        self._steps: list[tuple[str, list[str], Observation]] = []

    def step(self, df: DataFrame, name: str, rules: dict[str, Column]) -> DataFrame:
        seen = Observation()
        self._steps.append((name, list(rules), seen))
        return keep(df.observe(seen, *[F.sum(F.when(r, 0).otherwise(1)).alias(n) for n, r in rules.items()]), rules)

    def rows(self) -> list[tuple[str, str, int]]:
        """(step, rule, removed) in order, the rules of a step overlapping; only after the rows have been written (it waits for that)."""
        return [(name, rule, int(seen.get[rule] or 0)) for name, rules, seen in self._steps for rule in rules]

    def tables(self, spark: SparkSession) -> list[DataFrame]:
        """The counts as a table a step."""
        found = self.rows()
        return [spark.createDataFrame([r for r in found if r[0] == name], AUDIT) for name, _, _ in self._steps]


def sizes(df: DataFrame, step: str, patient: str = "patient", trial: str = "trial") -> DataFrame:
    """(step, patients, records, rows): a record is a trial up to its last underscore."""
    return df.agg(F.count_distinct(patient).alias("patients"), F.count_distinct(F.regexp_replace(F.col(trial).cast("string"), "_[^_]*$", "")).alias("records"), F.count("*").alias("rows")).select(
        F.lit(step).alias("step"), "patients", "records", "rows"
    )


def interval_stats(idx: str, fs: float, prefix: str, bpm: str) -> dict[str, Column]:
    """Median and population deviation of the distances of extrema, and the rate in beats a minute. Fewer than two extrema: null."""
    d = F.transform(A.diff(idx), lambda x: x.cast("double"))
    return {prefix: A.median(d), f"{prefix}_std": A.std(d), bpm: F.try_divide(F.lit(60.0 * fs), A.median(d))}


def amplitude_stats(signal: str, idx: str, prefix: str) -> dict[str, Column]:
    """Population deviation of the values at extrema, and of their successive differences."""
    v = A.pick(signal, idx)
    return {f"{prefix}_amp_std": A.std(v), f"{prefix}_amp_dif_std": A.std(A.diff(v))}


def peak_to_valley(signal: str, pks: str, vlys: str) -> Column:
    """Mean height of peaks over valleys; of unequal numbers the last of each are paired."""
    n = F.least(F.size(pks), F.size(vlys))
    tail = lambda c: F.slice(F.col(c), F.size(c) - n + 1, n)
    return F.when(n > 0, A.mean(F.zip_with(tail(pks), tail(vlys), lambda p, v: A.at(signal, p) - A.at(signal, v))))


def outliers(signal: str, pks: str, vlys: str, th: float = 3.0) -> Column:
    """Index of the lowest valley if it is below mean - th deviations of the valleys, then of the highest peak if above."""
    pv, vv = A.pick(signal, pks), A.pick(signal, vlys)
    low = F.when(F.array_min(vv) < A.mean(vv) - A.std(vv) * th, A.at(vlys, A.argmin(vv)))
    high = F.when(F.array_max(pv) > A.mean(pv) + A.std(pv) * th, A.at(pks, A.argmax(pv)))
    return F.array_compact(F.array(low, high))


def kurtosis_index(a: str) -> Column:
    """1 / (sum of fourth powers of the z-scores / (n + 1e-6) + 1e-6); 0 where undefined."""
    z = A.z_score(a)
    fourth = F.aggregate(z, F.lit(0.0), lambda s, x: s + x * x * x * x)
    v = 1.0 / (fourth / (F.size(a) + 1e-6) + 1e-6)
    return F.when(v.isNull() | F.isnan(v), 0.0).otherwise(v)


def clean_features(df: DataFrame, features: list[str], needed: str = "bd") -> DataFrame:
    """Rows with a real ``needed`` feature; infinite features become 0, NaN becomes null."""
    real = df.where(F.col(needed).isNotNull() & ~F.isnan(needed))
    return real.withColumns({c: F.when(F.abs(c) == float("inf"), 0.0).when(F.isnan(c), F.lit(None)).otherwise(F.col(c)) for c in features})


def truncated(df: DataFrame, c: str, order: list[str]) -> DataFrame:
    """Windows cut to the length of the first one in the order of the keys."""
    first = df.orderBy(*order).limit(1).select(F.size(c).alias("_n"))
    return df.crossJoin(F.broadcast(first)).withColumn(c, F.slice(c, F.lit(1), F.col("_n"))).drop("_n")
