"""The smallest detectable improvement from the judge's own noise: a system against itself."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import PairSums, dealt, joined, split_sums, table_of
from ..schema import ALPHAS, CI_LEVEL, NULL_DRAWS, POWER, POWER_MOST, POWER_STEP, RESAMPLES, SEED, SWEEP
from .cells import cells, supported
from .resample import half_width, multiplicities, percentile
from .variance import pooled


def draws(records: DataFrame, estimation: Iterable[int], *, sweep: Sequence[int] = SWEEP, draws_per_system: int = NULL_DRAWS, seed: int = SEED) -> DataFrame:
    """Per environment, supported N, system and draw: the difference of two disjoint scorings of the same cells."""
    estimation = list(estimation)
    own = cells(records, estimation).where("n >= 2").select("env_id", "item_id", "system_id", "n", "scores")
    few = F.broadcast(supported(records, estimation, sweep).select("env_id", "n_repeats"))  # environments times the sweep
    rows = own.join(few, "env_id").repartition("env_id", "item_id", "system_id", "n_repeats")
    group = ["env_id", "system_id"]

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = PairSums(group, draws_per_system)
        for batch in batches:
            sizes, scores = table_of(batch.column("scores"))
            terms = 1 / (sizes // 2) + 1 / (sizes - sizes // 2)
            repeats = batch.column("n_repeats").to_numpy()
            for n in np.unique(repeats).tolist():
                own = np.flatnonzero(repeats == n)
                for some, of_draw in dealt(len(own), draws_per_system):
                    rows = own[some]
                    at = pa.array(rows)
                    heads = joined("null", seed, batch.column("env_id").take(at), n, batch.column("system_id").take(at), pa.array(of_draw), batch.column("item_id").take(at), "")
                    small, large = split_sums(heads, sizes[rows], scores[rows], b"", (b"a|", b"b|"), n)
                    sums.add(batch, n, rows, of_draw, small - large, terms[rows])
        yield from sums.batches(("d", "terms"))

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in group) + ", n_repeats int, draw int, d double, terms double, n_items long"
    n = F.col("n_repeats")
    out = rows.mapInArrow(drawn, schema).groupBy("env_id", "n_repeats", "system_id", "draw").agg(F.sum("d").alias("d"), F.sum("n_items").alias("n_items"), (F.sum("terms") / F.sum("n_items")).alias("pool_term"))
    return out.select("env_id", "n_repeats", "system_id", "draw", (F.col("d") / (n * F.col("n_items"))).alias("delta"), "pool_term", "n_items")


def inflation(pool_term: Column, n: Column) -> Column:
    """By how much the split of finite pools widens the differences; none without a pool."""
    return F.when(pool_term <= 0, 1.0).otherwise(F.sqrt(((2 - pool_term) / n + pool_term) / (2 / n)))


def detectable(drawn: DataFrame, *, alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """Per environment, N and alpha: half-width, quantile of the absolute difference, corrected half-width."""
    terms = drawn.groupBy("env_id", "n_repeats", "system_id").agg(F.avg("pool_term").alias("t")).groupBy("env_id", "n_repeats").agg(F.avg("t").alias("pool_term"), F.count("*").alias("n_systems"))
    values = [F.struct(F.lit(a).alias("alpha"), half_width("delta", a).alias("mdi_null"), percentile(F.abs("delta"), 1 - a).alias("abs_delta_quantile")) for a in sorted(set(alphas), reverse=True)]
    out = drawn.groupBy("env_id", "n_repeats").agg(F.array(*values).alias("rows"), F.count("*").alias("n_draws")).join(terms, ["env_id", "n_repeats"])
    out = out.select("env_id", "n_repeats", "n_draws", "n_systems", "pool_term", F.explode("rows").alias("r")).select("env_id", "n_repeats", "r.*", "n_draws", "n_systems", "pool_term")
    factor = inflation(F.col("pool_term"), F.col("n_repeats"))
    return out.withColumn("pool_inflation", factor).withColumn("mdi_null_corrected", F.col("mdi_null") / factor)


def intervals(drawn: DataFrame, *, alphas: Sequence[float] = ALPHAS, seed: int = SEED, resamples: int = RESAMPLES, level: float = CI_LEVEL) -> DataFrame:
    """Per environment, N and alpha: the half-width's interval over systems; none where there is one system alone.

    A resample weighs each system's draws by how often it was picked, so no draw is copied.
    """
    keys = ["env_id", "n_repeats"]
    named = drawn.withColumn("group", F.concat_ws("|", *keys))
    systems = named.select("group", *keys, "system_id").distinct()
    placed = systems.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy("system_id")) - 1)  # a row for each system
    weights = multiplicities(placed, "group", "null_boot", seed=seed, resamples=resamples).join(placed, ["group", "place"])
    rows = weights.join(named.select("group", "system_id", "delta"), ["group", "system_id"])

    def at(q: float) -> Column:
        return F.percentile("delta", F.lit(q), F.col("times"))

    values = F.array(*(F.struct(F.lit(a).alias("alpha"), ((at(1 - a / 2) - at(a / 2)) / 2).alias("v")) for a in sorted(set(alphas), reverse=True)))
    each = rows.groupBy(*keys, "replicate").agg(values.alias("r")).select(*keys, F.explode("r").alias("r")).select(*keys, "r.*")
    tail, count = (1 - level) / 2, placed.groupBy(*keys).agg(F.count("*").alias("n_systems"))
    out = each.groupBy(*keys, "alpha").agg(percentile("v", tail).alias("ci_lo"), percentile("v", 1 - tail).alias("ci_hi")).join(count, keys)
    return out.select(*keys, "alpha", *(F.when(F.col("n_systems") > 1, F.col(c)).alias(c) for c in ("ci_lo", "ci_hi")))


def at_power(drawn: DataFrame, entries: DataFrame, *, power: float = POWER, step: float = POWER_STEP, most: float = POWER_MOST) -> DataFrame:
    """``entries`` with the smallest gain, on a grid of steps, that is detected with the power; null beyond the grid.

    A shift by delta detects the draws above threshold - delta, so the k-th largest draw, k = ceil(power * n),
    decides: the gain is the first grid point that lifts it strictly above the threshold.
    """
    order = Window.partitionBy("env_id", "n_repeats").orderBy(F.col("delta").desc())
    n = F.count("*").over(Window.partitionBy("env_id", "n_repeats"))
    kth = drawn.withColumn("r", F.row_number().over(order)).withColumn("k", F.ceil(F.lit(power) * n - 1e-9)).where("r = k").select("env_id", "n_repeats", F.col("delta").alias("kth"))
    out = entries.join(kth, ["env_id", "n_repeats"])
    unit = F.col("mdi_null") * step
    first = F.greatest(F.lit(0), F.floor(F.round((F.col("mdi_null") - F.col("kth")) / unit, 9)) + 1)
    steps = F.when(F.col("mdi_null") > 0, first)
    return out.withColumn("mdi_power", F.when(steps <= round(most / step), steps * unit)).drop("kth")


def isotonic(entries: DataFrame, value: str, out: str) -> DataFrame:
    """``entries`` with the values made non-increasing in N by pooling; null values are passed over.

    The pooled value at i is the least over starts j <= i of the greatest over ends k >= i of the mean of j..k.
    The sweep is a handful of N, so a group is an array and no join is needed.
    """
    keys = ["env_id", "alpha"]
    groups = entries.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n_repeats", F.col(value).alias("v")))).alias("s"))  # one entry for each N of the sweep

    def mean(j: Column, k: Column) -> Column:
        part = F.slice("s", j, k - j + 1)
        return F.aggregate(part, F.lit(0.0), lambda a, x: a + x["v"]) / F.size(part)

    size = F.size("s")
    at = F.sequence(F.lit(1), size)
    fitted = F.transform(at, lambda i: F.struct(F.get("s", i - 1)["n_repeats"].alias("n_repeats"), F.array_min(F.transform(F.sequence(F.lit(1), i), lambda j: F.array_max(F.transform(F.sequence(i, size), lambda k: mean(j, k))))).alias(out)))
    smooth = groups.select(*keys, F.explode(fitted).alias("f")).select(*keys, "f.*")
    return entries.join(smooth, [*keys, "n_repeats"], "left")


def in_sigma(entries: DataFrame, records: DataFrame, estimation: Iterable[int]) -> DataFrame:
    """``entries`` with the environment's sigma and the half-width in it."""
    sigma = pooled(records.where(F.col("repeat_idx").isin(list(estimation))), "env_id").select("env_id", "sigma")
    return entries.join(F.broadcast(sigma), "env_id", "left").withColumn("mdi_null_in_sigma", F.try_divide("mdi_null", "sigma"))  # a row for each environment
