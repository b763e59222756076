"""Synthetic scores: a system's mean, an item's effect, a group's offset and normal noise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import u32


def _normal(*key):  # noqa: ANN002, ANN202
    """A standard normal by Box and Muller from two numbers of the counter source."""
    a, b = (u32(*key, "u") + 1) / float(2**32 + 1), u32(*key, "v") / float(2**32)
    return F.sqrt(-2 * F.log(a)) * F.cos(2 * F.pi() * b)


def scores(spark: SparkSession, means: Mapping[str, float], *, items: int, repeats: int, sigma: float, seed: int = 1, env: str = "e_synthetic", offsets: Sequence[float] = (0.0,), item_sd: float = 0.0, failing: Sequence[int] = (), digits: int | None = None) -> DataFrame:
    """Records of every (item, system, repeat); ``failing`` repeats have no score."""
    systems = spark.createDataFrame([(s, float(m)) for s, m in means.items()], "system_id string, mean double")
    rows = systems.select("*", F.explode(F.sequence(F.lit(0), F.lit(items - 1))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("r"))
    group = F.pmod("r", F.lit(len(offsets)))
    value = F.col("mean") + item_sd * _normal("item", seed, F.col("i")) + F.get(F.array(*(F.lit(float(x)) for x in offsets)), group) + sigma * _normal("noise", seed, F.col("system_id"), F.col("i"), F.col("r"))
    value = F.round(value, digits) if digits is not None else value
    ok = ~F.col("r").isin(list(failing)) if failing else F.lit(True)
    return rows.select(F.lit(env).alias("env_id"), F.format_string("i_%04d", "i").alias("item_id"), "system_id", F.col("r").cast("long").alias("repeat_idx"), F.concat(F.lit("pp_"), group).alias("paraphrase_id"), ok.alias("parse_ok"), F.when(ok, value).alias("parsed_score"), F.when(ok, value).alias("score"))
