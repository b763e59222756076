"""How often an observed improvement reverses on re-measurement, by its size.

Cells are arrays; a draw shuffles a cell's repeats by hash, splits them into two disjoint pools and draws from each,
many cells and draws at once (``functions/draws.py``).
Differences are sums of integers times a fixed step, so exact zeros stay exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import PairSums, dealt, joined, split_sums, table_of
from ..schema import BIN_MULTIPLES, FIP_DRAWS, SEED, SWEEP
from .cells import cells
from .variance import pooled


def draws(records: DataFrame, estimation: Iterable[int], *, sweep: Sequence[int] = SWEEP, draws_per_pair: int = FIP_DRAWS, seed: int = SEED) -> DataFrame:
    """Per environment, N, pair and draw: the observed and the re-measured difference."""
    own = cells(records, estimation).where("n >= 2").select("env_id", "item_id", "system_id", "scores")
    a = own.select("env_id", "item_id", F.col("system_id").alias("system_a"), F.col("scores").alias("scores_a"))
    b = own.select("env_id", "item_id", F.col("system_id").alias("system_b"), F.col("scores").alias("scores_b"))
    rows = a.join(b, ["env_id", "item_id"]).where("system_a < system_b")
    # few cells, many draws: they are spread before the draws are made
    rows = rows.repartition("env_id", "item_id", "system_a", "system_b")
    pair, ns = ["env_id", "system_a", "system_b"], sorted(set(sweep))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = PairSums(pair, draws_per_pair)
        for batch in batches:
            (sizes_a, a), (sizes_b, b) = table_of(batch.column("scores_a")), table_of(batch.column("scores_b"))
            env, item = batch.column("env_id"), batch.column("item_id")
            names = pc.binary_join_element_wise(batch.column("system_a"), batch.column("system_b"), "~")
            for n in ns:
                for rows, of_draw in dealt(len(batch), draws_per_pair):
                    at = pa.array(rows)
                    heads = joined("fip", seed, env.take(at), n, names.take(at), pa.array(of_draw), item.take(at), "")
                    obs_a, re_a = split_sums(heads, sizes_a[rows], a[rows], b"a|", (b"a|obs|", b"a|re|"), n)
                    obs_b, re_b = split_sums(heads, sizes_b[rows], b[rows], b"b|", (b"b|obs|", b"b|re|"), n)
                    sums.add(batch, n, rows, of_draw, obs_a - obs_b, re_a - re_b)
        yield from sums.batches(("obs", "re"))

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in pair) + ", n_repeats int, draw int, obs double, re double, n_items long"
    sums = rows.mapInArrow(drawn, schema).groupBy("env_id", "n_repeats", "system_a", "system_b", "draw").agg(F.sum("obs").alias("obs"), F.sum("re").alias("re"), F.sum("n_items").alias("n_items"))
    size = F.col("n_repeats") * F.col("n_items")
    return sums.where("obs <> 0").select("env_id", "n_repeats", "system_a", "system_b", "draw", (F.abs("obs") / size).alias("delta"), (F.when(F.col("obs") > 0, F.col("re")).otherwise(-F.col("re")) <= 0).alias("reversed"))


def curve(drawn: DataFrame, records: DataFrame, estimation: Iterable[int], *, multiples: Sequence[float] = BIN_MULTIPLES) -> DataFrame:
    """Reversal rates by the observed difference in multiples of sigma; every bin has a row."""
    sigma = pooled(records.where(F.col("repeat_idx").isin(list(estimation))), "env_id").where("sigma > 0").select("env_id", "sigma")
    edges = sorted({0.0, *multiples})
    at = sum((F.when(F.col("delta") >= F.lit(e) * F.col("sigma"), 1).otherwise(0) for e in edges[1:]), F.lit(0))
    binned = drawn.join(sigma, "env_id").withColumn("bin", at)
    # one pass counts every bin, so bins without a draw have a row as well
    each = []
    for k, (low, high) in enumerate(zip(edges, [*edges[1:], None], strict=True)):
        own = F.col("bin") == k
        each.append(F.struct(F.lit(k).alias("bin"), F.lit(low).alias("low"), F.lit(high).cast("double").alias("high"), F.count_if(own).alias("n_draws"), F.count_if(own & F.col("reversed")).alias("n_reversals"), F.avg(F.when(own, F.col("delta"))).alias("mean_delta")))
    out = binned.groupBy("env_id", "n_repeats", "sigma").agg(F.array(*each).alias("bins")).select("env_id", "n_repeats", "sigma", F.explode("bins").alias("b"))
    return out.select("env_id", "n_repeats", "b.bin", (F.col("b.low") * F.col("sigma")).alias("lo"), (F.col("b.high") * F.col("sigma")).alias("hi"), "sigma", "b.mean_delta", "b.n_draws", "b.n_reversals", F.try_divide("b.n_reversals", "b.n_draws").alias("fip"))


def curve_intervals(drawn: DataFrame, records: DataFrame, estimation: Iterable[int], *, multiples: Sequence[float] = BIN_MULTIPLES, seed: int = SEED, resamples: int = 2000, level: float = 0.95) -> DataFrame:
    """The bins' intervals over pairs: a resample is a weighted sum of the pairs' counts."""
    from pyspark.sql import Window

    from .resample import multiplicities, percentile

    sigma = pooled(records.where(F.col("repeat_idx").isin(list(estimation))), "env_id").select("env_id", "sigma")
    edges = sorted({0.0, *multiples})
    at = sum((F.when(F.col("delta") >= F.lit(e) * F.col("sigma"), 1).otherwise(0) for e in edges[1:]), F.lit(0))
    group = F.concat_ws("|", "env_id", "n_repeats")
    per_pair = drawn.join(sigma, "env_id").withColumn("bin", at).withColumn("group", group).groupBy("group", "env_id", "n_repeats", "system_a", "system_b", "bin").agg(F.count("*").alias("n"), F.count_if("reversed").alias("r"))
    named = per_pair.select("group", "system_a", "system_b").distinct()
    named = named.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy("system_a", "system_b")) - 1)
    weights = multiplicities(named, "group", "fip_boot", seed=seed, resamples=resamples)
    rates = weights.join(named, ["group", "place"]).join(per_pair, ["group", "system_a", "system_b"]).groupBy("group", "env_id", "n_repeats", "bin", "replicate").agg((F.sum(F.col("times") * F.col("r")) / F.sum(F.col("times") * F.col("n"))).alias("fip"))
    tail = (1 - level) / 2
    some = named.groupBy("group").agg(F.count("*").alias("n_pairs"))
    out = rates.groupBy("group", "env_id", "n_repeats", "bin").agg(percentile("fip", tail).alias("ci_lo"), percentile("fip", 1 - tail).alias("ci_hi")).join(some, "group")
    return out.select("env_id", "n_repeats", "bin", *(F.when(F.col("n_pairs") > 1, F.col(c)).alias(c) for c in ("ci_lo", "ci_hi")))


def statements(bins: DataFrame) -> DataFrame:
    """A sentence for every bin that has draws."""
    told = F.format_string("With N=%d, an observed gain of %.4f reverses in %.1f%% of re-measurements.", F.col("n_repeats").cast("int"), F.round("mean_delta", 4), F.round(F.col("fip") * 100, 1))
    return bins.where("n_draws > 0").select("env_id", "n_repeats", "bin", told.alias("statement"))
