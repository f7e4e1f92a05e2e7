"""Paired statistics of the conditions against RAW, over seeds and document clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.python_udfs import student_t_two_sided
from spanloom.operators import statistics as ops
from spanloom.sources.files import saved
from spanloom.plans.scoring import PER_SEED, SENTENCES, document_counts, per_seed

REPLICATES = 10_000
SEED = 20260717


def deltas(spark: SparkSession, sf_dir: str, metrics: DataFrame | None = None) -> DataFrame:
    """Differences of each condition to RAW, seed by seed; the metrics are computed once (or at hand) and RAW found beside them."""
    metrics = per_seed(spark, sf_dir) if metrics is None else metrics
    raw = F.max(F.when(F.col("condition") == "RAW", F.col("f1"))).over(Window.partitionBy("seed"))
    f1 = metrics.select("condition", "seed", "f1").withColumn("raw", raw)
    return f1.where("condition <> 'RAW' AND raw IS NOT NULL").select("condition", "seed", F.round(F.col("f1") - F.col("raw"), 9).alias("delta"))


DELTAS = f"""{PER_SEED},
deltas AS (SELECT a.condition, a.seed, round(a.f1 - r.f1, 9) AS delta FROM per_seed a JOIN per_seed r ON a.seed = r.seed AND r.condition = 'RAW' WHERE a.condition <> 'RAW'),
ranked AS (SELECT *, 2 * rank() OVER (PARTITION BY condition ORDER BY abs(delta)) + count(*) OVER (PARTITION BY condition, abs(delta)) - 1 AS rank2 FROM deltas WHERE delta <> 0),
tests AS (
  SELECT d.condition, coalesce(n, 0) AS n_nonzero, coalesce(plus, 0) / 2::double AS w_plus, coalesce(minus, 0) / 2::double AS w_minus,
    CASE WHEN n IS NULL THEN 1.0::double ELSE len(list_filter(list_transform(range(0, (2 ** n)::bigint), lambda m: list_sum(list_transform(range(0, n), lambda i: ranks[i + 1] * ((m >> i) & 1)))),
        lambda s: least(s, plus + minus - s) <= least(plus, minus))) / (2 ** n) END AS p_value
  FROM (SELECT DISTINCT condition FROM deltas WHERE delta IS NOT NULL) d LEFT JOIN (
    SELECT condition, count(*) AS n, list(rank2) AS ranks, coalesce(sum(rank2) FILTER (WHERE delta > 0), 0)::bigint AS plus,
      coalesce(sum(rank2) FILTER (WHERE delta < 0), 0)::bigint AS minus FROM ranked GROUP BY condition) g ON d.condition = g.condition)
"""


def wilcoxon_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.wilcoxon(deltas(spark, sf_dir), ["condition"])


def holm_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw and adjusted p, and the flags of significance and of a meaningful mean difference."""
    found = deltas(spark, sf_dir)
    mean = F.round(F.avg("delta").over(Window.partitionBy("condition")), 9)
    tests = ops.holm(ops.wilcoxon(found.withColumn("mean_delta", mean), ["condition", "mean_delta"]), "condition")
    return tests.select("condition", "p_value", "holm_p", "mean_delta", (F.col("holm_p") < 0.05).alias("significant"), (F.abs("mean_delta") >= 0.01).alias("meaningful"))


def rank_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.average_ranks(deltas(spark, sf_dir), ["condition"]).select("condition", "seed", "delta", (F.col("rank2") / 2).alias("rank"))


def paired_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.paired_t(deltas(spark, sf_dir), ["condition"])
    return found.select("condition", "n", "df", F.round("mean", 8).alias("mean"), F.round("sd", 8).alias("sd"), F.round("t", 5).alias("t"), "status")


def paired_t_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided p of the paired t test."""
    found = ops.paired_t(deltas(spark, sf_dir), ["condition"]).withColumn("p_value", student_t_two_sided(F.col("t"), F.col("df").cast("double")))
    return found.select("condition", "n", "df", F.round("t", 5).alias("t"), F.round("p_value", 9).alias("p_value"), "status")


def percentile_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linearly interpolated percentiles of the documents' F1 per condition."""
    docs = document_counts(spark, sf_dir).groupBy("condition", "doc").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    f1 = docs.select("condition", F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))
    return f1.groupBy("condition").agg(*[F.round(F.percentile("f1", F.lit(q)), 9).alias(n) for n, q in (("low", 0.025), ("median", 0.5), ("high", 0.975))])


def family_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every declared condition has every seed: an incomplete one withholds the whole family's contrasts."""
    declared = spark.sql("SELECT explode(array('RAW', 'VER-CONFIDENCE', 'VER-SIMPLE', 'VER-CORRECTIVE', 'VER-UNRUN')) AS condition")
    held = per_seed(spark, sf_dir).where("f1 IS NOT NULL").groupBy("condition").agg(F.count(F.lit(1)).alias("n_seeds"))
    state = F.when(F.col("n_seeds").isNull(), "absent").when(F.col("n_seeds") < 7, "incomplete").otherwise("complete")
    return declared.join(held, "condition", "left").select("condition", F.coalesce("n_seeds", F.lit(0)).alias("n_seeds"), state.alias("state"))


def hierarchical_bootstrap(spark: SparkSession, sf_dir: str, counts: DataFrame | None = None) -> DataFrame:
    counts = saved(document_counts(spark, sf_dir)) if counts is None else counts
    return ops.hierarchical_bootstrap(counts.drop("duplicates"), "RAW", REPLICATES, SEED)


def replayed_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same intervals under the one sequential stream of draws of a seeded generator, with point estimates."""
    return ops.replayed_bootstrap(document_counts(spark, sf_dir).drop("duplicates"), "RAW", REPLICATES, SEED)


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_seed(spark, sf_dir).select(F.col("condition").alias("arm"), "seed", F.col("f1").alias("value"))


def seed_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.seed_bootstrap(arms(spark, sf_dir), REPLICATES, SEED)


def contrast_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of each condition's difference to RAW from the replicates that the arms share."""
    pairs = spark.sql("SELECT explode(array('VER-CONFIDENCE', 'VER-SIMPLE', 'VER-CORRECTIVE')) AS arm, 'RAW' AS reference")
    return ops.contrast_bootstrap(arms(spark, sf_dir), pairs, REPLICATES, SEED)


QUERIES = {f.__name__: f for f in (wilcoxon_exact, holm_adjust, rank_table, paired_t, paired_t_pvalue, percentile_ci, family_coverage, hierarchical_bootstrap, replayed_bootstrap, seed_bootstrap, contrast_bootstrap)}

ORACLES = {
    "wilcoxon_exact": f"WITH {DELTAS} SELECT * FROM tests",
    "rank_table": f"WITH {DELTAS} SELECT condition, seed, delta, rank2 / 2::double AS rank FROM ranked",
    "holm_adjust": f"""WITH {DELTAS}, s AS (SELECT *, least(1.0::double, (count(*) OVER () - row_number() OVER (ORDER BY p_value, condition) + 1) * p_value) AS step FROM tests),
h AS (SELECT condition, p_value, max(step) OVER (ORDER BY p_value, condition ROWS UNBOUNDED PRECEDING) AS holm_p FROM s),
m AS (SELECT condition, round(avg(delta), 9) AS mean_delta FROM deltas GROUP BY condition)
SELECT condition, p_value, holm_p, mean_delta, holm_p < 0.05::double AS significant, abs(mean_delta) >= 0.01::double AS meaningful FROM h JOIN m USING (condition)""",
    "paired_t": f"""WITH {DELTAS}, s AS (SELECT condition, count(delta) AS n, avg(delta) AS mean, stddev_samp(delta) AS sd FROM deltas GROUP BY condition)
SELECT condition, n, n - 1 AS df, round(mean, 8) AS mean, round(sd, 8) AS sd, CASE WHEN n >= 2 AND sd <> 0 THEN round(mean / (sd / sqrt(n)), 5) END AS t,
 CASE WHEN n < 2 THEN 'too_few' WHEN sd = 0 THEN CASE WHEN mean = 0 THEN 'all_zero' ELSE 'zero_variance' END ELSE 'defined' END AS status FROM s""",
    # six degrees of freedom have a closed form: 1 - sin u (1 + cos^2 u / 2 + 3 cos^4 u / 8), tan u = |t| / sqrt(df)
    "paired_t_pvalue": f"""WITH {DELTAS}, s AS (SELECT condition, count(delta) AS n, avg(delta) AS mean, stddev_samp(delta) AS sd FROM deltas GROUP BY condition),
t AS (SELECT condition, n, n - 1 AS df, CASE WHEN n >= 2 AND sd <> 0 THEN mean / (sd / sqrt(n)) END AS t, CASE WHEN n < 2 THEN 'too_few' WHEN sd = 0 THEN CASE WHEN mean = 0 THEN 'all_zero' ELSE 'zero_variance' END ELSE 'defined' END AS status FROM s)
SELECT condition, n, df, round(t, 5) AS t, CASE WHEN df = 6 THEN round(1 - sin(atan(abs(t) / sqrt(6))) * (1 + cos(atan(abs(t) / sqrt(6))) ** 2 / 2 + 3 * cos(atan(abs(t) / sqrt(6))) ** 4 / 8), 9) END AS p_value, status FROM t""",
    "percentile_ci": f"""WITH {SENTENCES}, d AS (SELECT condition, doc, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM sentences GROUP BY ALL),
f AS (SELECT condition, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp::double / (2 * tp + fp + fn) END AS f1 FROM d)
SELECT condition, round(quantile_cont(f1, 0.025), 9) AS low, round(quantile_cont(f1, 0.5), 9) AS median, round(quantile_cont(f1, 0.975), 9) AS high FROM f GROUP BY condition""",
    "family_coverage": f"""WITH {PER_SEED}, h AS (SELECT condition, count(*) AS n_seeds FROM per_seed WHERE f1 IS NOT NULL GROUP BY condition)
SELECT condition, coalesce(n_seeds, 0) AS n_seeds, CASE WHEN n_seeds IS NULL THEN 'absent' WHEN n_seeds < 7 THEN 'incomplete' ELSE 'complete' END AS state
FROM (VALUES ('RAW'), ('VER-CONFIDENCE'), ('VER-SIMPLE'), ('VER-CORRECTIVE'), ('VER-UNRUN')) AS k(condition) LEFT JOIN h USING (condition)""",
}
