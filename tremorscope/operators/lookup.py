"""Tables to read thresholds and repeats from: crossings, consistency, needed repeats, margins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ALPHAS, LEAST_BIN_DRAWS, TARGETS, from_pp


def crossings(bins: DataFrame, *, alphas: Sequence[float] = ALPHAS, least: int = LEAST_BIN_DRAWS, readoff: str = "interpolate") -> DataFrame:
    """Per environment, N and alpha: the difference from which on every larger bin's rate is at most alpha."""
    usable = bins.where((F.col("n_draws") >= least) & F.col("fip").isNotNull() & F.col("mean_delta").isNotNull())
    rows = usable.select("env_id", "n_repeats", "mean_delta", "fip", "hi", F.explode(F.array(*(F.lit(a) for a in alphas))).alias("alpha"))
    keys = ["env_id", "n_repeats", "alpha"]
    by = Window.partitionBy(*keys).orderBy("mean_delta")
    later = Window.partitionBy(*keys).orderBy("mean_delta").rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("worst", F.max("fip").over(later)).withColumn("pd", F.lag("mean_delta").over(by)).withColumn("pf", F.lag("fip").over(by)).withColumn("r", F.row_number().over(by))
    first = rows.where("worst <= alpha").groupBy(*keys).agg(F.min_by(F.struct("mean_delta", "fip", "hi", "pd", "pf", "r"), "r").alias("x"))
    between = F.when(F.col("x.pf") - F.col("x.fip") <= 0, F.col("x.mean_delta")).otherwise(F.col("x.pd") + (F.col("x.pf") - F.col("alpha")) / (F.col("x.pf") - F.col("x.fip")) * (F.col("x.mean_delta") - F.col("x.pd")))
    if readoff == "bin_upper":
        between = F.coalesce("x.hi", "x.mean_delta")
    elif readoff != "interpolate":
        raise ValueError(f"unknown rule {readoff!r}")
    found = first.select(*keys, F.when(F.col("x.r") == 1, F.col("x.mean_delta")).otherwise(between).alias("mdi_fip"), (F.col("x.r") == 1).alias("below_measured_range"))
    grid = bins.groupBy("env_id", "n_repeats").agg(F.max("sigma").alias("sigma")).select("env_id", "n_repeats", "sigma", F.explode(F.array(*(F.lit(a) for a in alphas))).alias("alpha"))
    out = grid.join(found, keys, "left")
    return out.select(*keys, "mdi_fip", F.col("mdi_fip").isNotNull().alias("attained"), F.coalesce("below_measured_range", F.lit(False)).alias("below_measured_range"), F.try_divide("mdi_fip", "sigma").alias("mdi_in_sigma"))


def consistency(null_entries: DataFrame, fip_entries: DataFrame) -> DataFrame:
    """Both paths side by side, also where one of them has no entry."""
    both = null_entries.select("env_id", "n_repeats", "alpha", "mdi_null").join(fip_entries.select("env_id", "n_repeats", "alpha", "mdi_fip"), ["env_id", "n_repeats", "alpha"], "full_outer")
    return both.withColumn("ratio", F.try_divide("mdi_fip", "mdi_null")).withColumn("abs_diff", F.abs(F.col("mdi_null") - F.col("mdi_fip")))


def needed_repeats(entries: DataFrame, value: str, *, targets: Sequence[float] = TARGETS, alpha: float = 0.05) -> DataFrame:
    """Per environment and target: the fewest repeats whose value (in percent of the width) is at most the target."""
    own = entries.where(F.abs(F.col("alpha") - alpha) < 1e-12)
    rows = own.select("env_id", "n_repeats", "scale", F.col(value).alias("v"), F.explode(F.array(*(F.lit(float(t)) for t in sorted(set(targets))))).alias("target_pp"))
    fits = F.col("v") <= F.col("target_pp")
    out = rows.groupBy("env_id", "scale", "target_pp").agg(F.min(F.when(fits, F.col("n_repeats"))).alias("recommended_n"), F.min_by("v", F.when(fits, F.col("n_repeats"))).alias("at"))
    return out.select("env_id", "target_pp", from_pp(F.col("target_pp"), F.col("scale")).alias("target_raw"), "recommended_n", F.when(F.col("recommended_n").isNotNull(), F.col("at")).alias("mdi_at_recommended_pp"), F.col("recommended_n").isNotNull().alias("reachable"))


def margins(entries: DataFrame, value: str, *, alpha: float = 0.10, columns: Sequence[int] = (1, 3, 5, 8)) -> DataFrame:
    """Margins by N, a row per environment."""
    own = entries.where(F.abs(F.col("alpha") - alpha) < 1e-12)
    return own.groupBy("env_id").pivot("n_repeats", list(columns)).agg(F.first(value)).withColumnsRenamed({str(n): f"n_{n}" for n in columns})


def thresholds(entries: DataFrame, value: str, *, alpha: float = 0.05) -> DataFrame:
    """(env, N, threshold) at an alpha."""
    return entries.where(F.abs(F.col("alpha") - alpha) < 1e-12).select("env_id", "n_repeats", F.col(value).alias("threshold"))
