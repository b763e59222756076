"""Planned judge calls, what is left of them, and their execution in waves."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import GateError
from ..functions.scalars import call_seed, env_id, paraphrase_of, rendered
from ..schema import CALL_KEY
from .cells import CELL


def grid(spark: SparkSession, axes: Mapping[str, Sequence[object]]) -> DataFrame:
    """Every combination of the axes' values, with its environment's identifier."""
    rows: list[dict] = [{}]
    for name, values in axes.items():
        rows = [r | {name: v} for r in rows for v in values]
    return spark.createDataFrame([(env_id(r), *map(str, r.values())) for r in rows], ["env_id", *axes])


def planned(envs: DataFrame, items: DataFrame, systems: DataFrame, *, repeats: int, paraphrases: int = 1, base_seed: int = 0) -> DataFrame:
    """A row per call; environments and systems are a handful, so items are exploded over them."""
    few = envs.select("env_id").distinct().join(systems.select("system_id").distinct(), F.lit(True))
    small = few.agg(F.collect_list(F.struct("env_id", "system_id")).alias("cells"))  # environments times systems
    rows = items.select("item_id").distinct().join(F.broadcast(small), F.lit(True)).select("item_id", F.explode("cells").alias("c"))
    rows = rows.select("c.env_id", "item_id", "c.system_id", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat_idx"))
    return rows.select("env_id", "item_id", "system_id", F.col("repeat_idx").cast("long").alias("repeat_idx"), paraphrase_of(F.col("repeat_idx"), paraphrases).alias("paraphrase"), call_seed(base_seed, F.col("repeat_idx")).cast("long").alias("seed"))


def prompts(calls: DataFrame, texts: DataFrame, template: str) -> DataFrame:
    """Calls with their prompt and its digest; ``texts``: item_id, system_id, source, output."""
    prompt = rendered(F.lit(template), F.col("source"), F.col("output"))
    return calls.join(texts, ["item_id", "system_id"]).withColumn("prompt", prompt).withColumn("request_payload_hash", F.sha2("prompt", 256)).drop("source", "output")


def call_counts(cells: int, repeats: int, factor: int = 2) -> tuple[int, int]:
    """Expected calls, and the most that retries may make of them."""
    return cells * repeats, cells * repeats * factor


def remaining(plan: DataFrame, done: DataFrame) -> DataFrame:
    """Planned calls that have no record."""
    return plan.join(done.select(*CALL_KEY).distinct(), list(CALL_KEY), "left_anti")


def wave(records: DataFrame, wanted: DataFrame, *, repeats: int, factor: int = 2) -> DataFrame:
    """The next calls of every cell: as many as valid scores are missing, on fresh repeats, within the attempt cap."""
    state = records.groupBy(*CELL).agg(F.count("*").alias("attempts"), F.count_if("parse_ok").alias("valid"), (F.max("repeat_idx") + 1).alias("next"))
    rows = wanted.select(*CELL).distinct().join(state, list(CELL), "left").na.fill(0, ["attempts", "valid", "next"])
    left = F.least(F.lit(repeats) - F.col("valid"), F.lit(repeats * factor) - F.col("attempts"))
    return rows.where(left > 0).select(*CELL, F.explode(F.sequence(F.col("next"), F.col("next") + left - 1)).alias("repeat_idx"))


def judge(calls: DataFrame, complete: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Calls with ``raw_response``: the judge sees Arrow batches of calls on the executors."""
    from pyspark.sql import types as T

    schema = T.StructType([*calls.schema.fields, T.StructField("raw_response", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield frame.assign(raw_response=complete(frame))

    return calls.mapInPandas(run, schema)


def gates(*, receipt: str | None, config_hash: str, pilot: bool, piloted: bool, projected: float, spent: float, cap: float) -> None:
    """Lets a run through only with its own estimate, after a pilot, within the cap."""
    if receipt != config_hash:
        raise GateError("no cost estimate of this configuration")
    if not pilot and not piloted:
        raise GateError("no pilot of this configuration")
    if spent + projected > cap:
        raise GateError("over the cumulative cap")


def execute(spark: SparkSession, plan: DataFrame, records_path: str, complete: Callable[[pd.DataFrame], pd.Series], scale: str, *, repeats: int, factor: int = 2, most_waves: int | None = None) -> DataFrame:
    """Runs waves until every cell has its valid scores or its attempts are used up; records are appended as Parquet.

    Every wave reads what is stored, so a run that broke off goes on where it stopped.
    A wave makes at least one attempt for each open cell, so ``repeats * factor + 1`` waves, the default, are enough.
    """
    from ..functions.parsing import parsed_score

    empty = spark.createDataFrame([], "env_id string, item_id string, system_id string, repeat_idx long, raw_response string, parsed_score double, parse_ok boolean")
    empty.write.mode("append").parquet(records_path)
    for _ in range(repeats * factor + 1 if most_waves is None else most_waves):
        stored = spark.read.schema(empty.schema).parquet(records_path)
        todo = wave(stored, plan, repeats=repeats, factor=factor)
        if not todo.head(1):
            break
        answered = judge(todo, complete).withColumn("parsed_score", parsed_score(F.col("raw_response"), scale))
        answered.withColumn("parse_ok", F.col("parsed_score").isNotNull()).select(empty.columns).write.mode("append").parquet(records_path)
    return spark.read.schema(empty.schema).parquet(records_path)
