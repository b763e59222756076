"""How noisy the judge is: variances, flip rates, agreement. Sums and counts only, so everything pre-aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cells import CELL


def cell_variance(records: DataFrame) -> DataFrame:
    """Unbiased variance of every cell, null below two scores."""
    return records.groupBy(*CELL).agg(F.count("score").alias("n"), F.avg("score").alias("mean_score"), F.when(F.count("score") > 1, F.var_samp("score")).alias("variance"))


def pooled(records: DataFrame, *keys: str) -> DataFrame:
    """Pooled variance and sigma over the cells of each group ``keys``: squared deviations over degrees of freedom."""
    by_cell = records.groupBy(*CELL).agg(F.count("score").alias("n"), F.sum("score").alias("s"), F.sum(F.col("score") * F.col("score")).alias("q"))
    ss = F.when(F.col("n") > 1, F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0)))
    out = by_cell.groupBy(*keys).agg(F.sum(ss).alias("ss"), F.sum(F.when(F.col("n") > 1, F.col("n") - 1)).alias("df"), F.count("*").alias("n_cells"), F.sum("n").alias("n_scores"), F.sum("s").alias("total"))
    variance = F.try_divide("ss", "df")
    return out.select(*keys, variance.alias("variance"), F.sqrt(variance).alias("sigma"), "n_cells", "n_scores", (F.col("total") / F.col("n_scores")).alias("mean_score"))


def flip_rates(records: DataFrame) -> DataFrame:
    """Per cell: the share of unequal pairs of repeats, from value counts instead of pairs."""
    values = records.groupBy(*CELL, "score").agg(F.count("*").alias("c"))
    out = values.groupBy(*CELL).agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"), F.sum(F.col("c") * F.col("score")).alias("s"), F.sum(F.col("c") * F.col("score") * F.col("score")).alias("q"))
    n = F.col("n")
    sd = F.sqrt(F.greatest((F.col("q") - F.col("s") * F.col("s") / n) / (n - 1), F.lit(0.0)))
    return out.where("n > 1").select(*CELL, n, (1 - F.col("same") / (n * (n - 1))).alias("flip_rate"), sd.alias("sd"))


def pairs(systems: DataFrame) -> DataFrame:
    """Ordered pairs a < b of the systems of each environment."""
    a = systems.select("env_id", F.col("system_id").alias("system_a"))
    return a.join(systems.select("env_id", F.col("system_id").alias("system_b")), "env_id").where("system_a < system_b")


def rank_flips(records: DataFrame) -> DataFrame:
    """Share of single comparisons that contradict the sign of the mean difference; ties count as flips.

    Per item the repeats' comparisons are counted from the value counts of both systems.
    """
    values = records.groupBy(*CELL, "score").agg(F.count("*").alias("c"))
    by = values.groupBy(*CELL).agg(F.collect_list(F.struct("score", "c")).alias("vc"), F.sum("c").alias("n"), (F.sum(F.col("c") * F.col("score")) / F.sum("c")).alias("mean"))
    a = by.select("env_id", "item_id", F.col("system_id").alias("system_a"), F.col("vc").alias("va"), F.col("n").alias("na"), F.col("mean").alias("ma"))
    b = by.select("env_id", "item_id", F.col("system_id").alias("system_b"), F.col("vc").alias("vb"), F.col("n").alias("nb"), F.col("mean").alias("mb"))

    def beats(x: str, y: str) -> Column:
        return F.aggregate(x, F.lit(0).cast("long"), lambda t, p: t + p["c"] * F.aggregate(y, F.lit(0).cast("long"), lambda u, r: u + F.when(p["score"] > r["score"], r["c"]).otherwise(F.lit(0))))

    items = a.join(b, ["env_id", "item_id"]).where("system_a < system_b").select("env_id", "system_a", "system_b", (F.col("ma") - F.col("mb")).alias("d"), (F.col("na") * F.col("nb")).alias("n"), beats("va", "vb").alias("up"), beats("vb", "va").alias("down"))
    out = items.groupBy("env_id", "system_a", "system_b").agg(F.count("*").alias("n_items"), F.sum("n").alias("n_comparisons"), F.avg("d").alias("mean_delta"), F.sum("up").alias("up"), F.sum("down").alias("down"))
    sign = F.when(F.abs("mean_delta") < 1e-12, 0).when(F.col("mean_delta") > 0, 1).otherwise(-1)
    agree = F.when(sign == 1, F.col("up")).when(sign == -1, F.col("down")).otherwise(0)
    return out.select("env_id", "system_a", "system_b", "n_items", "n_comparisons", "mean_delta", sign.alias("reference_sign"), ((F.col("n_comparisons") - agree) / F.col("n_comparisons")).alias("rank_flip_rate"))


def alpha(records: DataFrame, level: str) -> DataFrame:
    """Krippendorff's alpha per environment over its cells of two scores or more; null where it is undefined.

    Interval: closed form from sums. Nominal: from value counts. Ordinal: pairs of distinct values only.
    """
    values = records.groupBy(*CELL, "score").agg(F.count("*").alias("c"))
    size = Window.partitionBy(*CELL)
    values = values.withColumn("m", F.sum("c").over(size)).where("m > 1")
    pool = values.groupBy("env_id", "score").agg(F.sum("c").alias("c"))
    if level == "ordinal":
        by = Window.partitionBy("env_id").orderBy("score")
        ranks = pool.withColumn("up", F.sum("c").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        low = ranks.select("env_id", F.col("score").alias("v"), F.col("c").alias("c1"), F.col("up").alias("up1"))
        high = ranks.select("env_id", F.col("score").alias("w"), F.col("c").alias("c2"), F.col("up").alias("up2"))
        span = F.col("up2") - F.col("up1") + F.col("c1") - (F.col("c1") + F.col("c2")) / 2.0
        gaps = low.join(high, "env_id").where("v < w").select("env_id", "v", "w", "c1", "c2", (span * span).alias("gap"))
        left = values.select(*CELL, F.col("score").alias("v"), F.col("c").alias("a"), "m")
        right = values.select(*CELL, F.col("score").alias("w"), F.col("c").alias("b"))
        seen = left.join(right, list(CELL)).where("v < w").join(F.broadcast(gaps.select("env_id", "v", "w", "gap")), ["env_id", "v", "w"])  # scale points squared
        observed = seen.groupBy("env_id").agg(F.sum(2 * F.col("a") * F.col("b") * F.col("gap") / (F.col("m") - 1)).alias("o"))
        expected = gaps.groupBy("env_id").agg(F.sum(2 * F.col("c1") * F.col("c2") * F.col("gap")).alias("e"))
        total = pool.groupBy("env_id").agg(F.sum("c").alias("n"))
        both = total.join(observed, "env_id", "left").join(expected, "env_id", "left").na.fill(0.0, ["o", "e"])
    else:
        c, v = F.col("c"), F.col("score")
        if level == "interval":
            parts = [F.sum(c).alias("n"), F.sum(c * v).alias("s"), F.sum(c * v * v).alias("q")]
            total = 2.0 * F.col("n") * F.col("q") - 2.0 * F.col("s") * F.col("s")
        elif level == "nominal":
            parts = [F.sum(c).alias("n"), F.sum(c * c).alias("q")]
            total = (F.col("n") * F.col("n") - F.col("q")).cast("double")
        else:
            raise ValueError(f"unknown level {level!r}")
        units = values.groupBy(*CELL).agg(*parts).select("env_id", "n", (total / (F.col("n") - 1)).alias("d"))
        observed = units.groupBy("env_id").agg(F.sum("d").alias("o"))
        both = pool.groupBy("env_id").agg(*parts).select("env_id", "n", total.alias("e")).join(observed, "env_id")
    n = F.col("n")
    return both.select("env_id", (1 - F.try_divide(F.col("o") / n, F.col("e") / (n * (n - 1)))).alias("alpha"), n.alias("n_values"))


def report(records: DataFrame) -> DataFrame:
    """The summary row of every environment."""
    flips = flip_rates(records).groupBy("env_id").agg(F.avg("flip_rate").alias("flip_rate"))
    return pooled(records, "env_id").join(flips, "env_id", "left").join(alpha(records, "interval").select("env_id", "alpha"), "env_id", "left")
