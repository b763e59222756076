"""Records to cells: filters, guards, grouping, environment metadata.

Records have env_id, item_id, system_id, repeat_idx and score; a cell is one (env, item, system).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DuplicateScoreError, OverlappingRepeatsError, SchemaMixError, UnknownEnvironmentError
from ..schema import CALL_KEY, SCHEMA_VERSION, SWEEP

CELL = ("env_id", "item_id", "system_id")


def scored(records: DataFrame) -> DataFrame:
    """Raw records that hold a parsed score, with it as ``score``."""
    return records.where("parse_ok and parsed_score is not null").withColumn("score", F.col("parsed_score"))


def filtered(records: DataFrame, *, envs: Iterable[str] | None = None, tasks: Iterable[str] | None = None, scales: Iterable[str] | None = None, systems: Iterable[str] | None = None, repeats: Iterable[int] | None = None) -> DataFrame:
    """Records that meet all the conditions given."""
    for column, wanted in (("env_id", envs), ("task", tasks), ("scale", scales), ("system_id", systems), ("repeat_idx", repeats)):
        if wanted is not None:
            records = records.where(F.col(column).isin(list(wanted)))
    return records


def require_envs(records: DataFrame, envs: Sequence[str]) -> DataFrame:
    """The records of the named environments, all of which must have some."""
    found = {r[0] for r in records.where(F.col("env_id").isin(list(envs))).select("env_id").distinct().collect()}  # at most as many as named
    if missing := sorted(set(envs) - found):
        raise UnknownEnvironmentError(f"no records for {missing}")
    return filtered(records, envs=envs)


def require_version(records: DataFrame) -> DataFrame:
    if records.where(~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION))).head(1):
        raise SchemaMixError(f"records of another schema version than {SCHEMA_VERSION}")
    return records


def split(screening: Iterable[int], estimation: Iterable[int]) -> tuple[list[int], list[int]]:
    """Screening and estimation repeats, checked to be disjoint."""
    a, b = sorted(set(screening)), sorted(set(estimation))
    if set(a) & set(b):
        raise OverlappingRepeatsError(f"screening and estimation share repeats {sorted(set(a) & set(b))}")
    if len(b) < 2:
        raise ValueError("at least two estimation repeats are needed for disjoint pools")
    return a, b


def repeats_of(text: str) -> list[int]:
    """Repeats from text like "0-4,7"."""
    out: set[int] = set()
    for part in text.split(","):
        low, _, high = part.strip().partition("-")
        if high and int(high) < int(low):
            raise ValueError(f"reversed range {part!r}")
        out |= set(range(int(low), int(high or low) + 1))
    return sorted(out)


def numbers_of(text: str) -> list[float]:
    """Numbers from text like "0.10,0.05"; there must be one."""
    out = [float(part) for part in text.split(",") if part.strip()]
    if not out:
        raise ValueError(f"no number in {text!r}")
    return out


def distinct_values(records: DataFrame, column: str) -> DataFrame:
    """The column's values in order: environments, runs, systems or repeats."""
    return records.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def items_of(records: DataFrame) -> DataFrame:
    """The items of every environment's systems."""
    return records.select("env_id", "system_id", "item_id").distinct()


def published(rows: DataFrame, experiments: Iterable[str]) -> DataFrame:
    """The rows whose experiment is listed for publication."""
    return rows.where(F.col("experiment").isin(list(experiments)))


def mixed_order(value: Column) -> list[Column]:
    """Sort keys of a JSON scalar in text: nothing first, then truth values, numbers by value, and text."""
    number = value.try_cast("double")
    kind = F.when(value.isNull() | (value == "null"), 0).when(value.isin("true", "false"), 1).when(number.isNotNull(), 2).otherwise(3)
    return [kind, F.when(kind == 1, (value == "true").cast("double")).when(kind == 2, number), F.when(kind == 3, value)]


def conflicts(records: DataFrame) -> DataFrame:
    """Call keys with more than one score."""
    return records.groupBy(*CALL_KEY).agg(F.count_distinct("score").alias("n_scores"), F.count("*").alias("n_records")).where("n_scores > 1")


def require_no_conflict(records: DataFrame) -> DataFrame:
    if bad := conflicts(records).head(3):
        raise DuplicateScoreError(f"conflicting scores: {bad}")
    return records


def unique(records: DataFrame) -> DataFrame:
    """One record for each call key; equal repetitions collapse."""
    return records.groupBy(*CALL_KEY).agg(F.min("score").alias("score"))


def cells(records: DataFrame, repeats: Iterable[int] | None = None) -> DataFrame:
    """One row per cell: ``n`` and the scores as an array in the order of repeats."""
    own = filtered(records, repeats=repeats)
    pairs = F.array_sort(F.collect_list(F.struct("repeat_idx", "score")))
    return own.groupBy(*CELL).agg(pairs.alias("pairs")).select(*CELL, F.size("pairs").alias("n"), F.transform("pairs", lambda x: x["score"]).alias("scores"), "pairs")


def attempts(records: DataFrame) -> DataFrame:
    """Attempts, failures and their rate per environment."""
    return records.groupBy("env_id").agg(F.count("*").alias("attempts"), F.count_if(~F.col("parse_ok")).alias("failures")).withColumn("rate", F.col("failures") / F.col("attempts"))


def env_metadata(records: DataFrame) -> DataFrame:
    """Counts per environment and whether its constants are constant."""
    return records.groupBy("env_id").agg(F.count("*").alias("n_records"), F.count_distinct("item_id").alias("n_items"), F.count_distinct("system_id").alias("n_systems"), F.count_distinct("repeat_idx").alias("n_repeats"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))


def supported(records: DataFrame, estimation: Iterable[int], sweep: Sequence[int] = SWEEP) -> DataFrame:
    """(env, N) for every N of the sweep that all the environment's cells have repeats for."""
    counts = filtered(records, repeats=estimation).groupBy(*CELL).agg(F.count("*").alias("n"))
    least = counts.groupBy("env_id").agg(F.min("n").alias("min_repeats"))
    return least.select("env_id", "min_repeats", F.explode(F.array(*(F.lit(n) for n in sorted(set(sweep))))).alias("n_repeats")).where("n_repeats >= 1 and n_repeats <= min_repeats")
