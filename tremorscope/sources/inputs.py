"""Items, snapshots, annotations, promotions and the ledger as DataFrames; small sinks for reports."""

from __future__ import annotations

import csv
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import digest
from ..schema import FACETS, ITEM, LEDGER


def items(spark: SparkSession, path: str) -> DataFrame:
    """Items of JSON lines; all must have every field and the same systems."""
    out = spark.read.schema(ITEM).option("mode", "FAILFAST").json(path)
    if out.where("item_id is null or source is null or outputs is null").head(1):
        raise ValueError("an item lacks a field")
    if out.select(F.array_sort(F.map_keys("outputs")).alias("k")).distinct().limit(2).count() > 1:
        raise ValueError("items have different systems")
    return out.orderBy("item_id")


def materialized(item_rows: DataFrame) -> DataFrame:
    """item_id, part (source or a system), digest, text: what snapshots hold."""
    parts = F.concat(F.array(F.struct(F.lit("source").alias("part"), F.col("source").alias("text"))), F.transform(F.map_entries("outputs"), lambda e: F.struct(F.concat(F.lit("output:"), e["key"]).alias("part"), e["value"].alias("text"))))
    return item_rows.select("item_id", F.explode(parts).alias("p")).select("item_id", "p.part", digest(F.col("p.text")).alias("digest"), "p.text")


def write_snapshots(texts: DataFrame, path: str) -> None:
    """Adds texts that the store lacks, by content; ``texts``: digest, text."""
    spark, new = texts.sparkSession, texts.select("digest", "text").dropDuplicates(["digest"])
    spark.createDataFrame([], new.schema).write.mode("append").parquet(path)
    new.join(spark.read.schema(new.schema).parquet(path).select("digest"), "digest", "left_anti").write.mode("append").parquet(path)


def read_snapshot(spark: SparkSession, path: str, wanted: str) -> str:
    """The text of a digest."""
    if not (found := spark.read.parquet(path).where(F.col("digest") == wanted).select("text").head(1)):
        raise KeyError(f"no snapshot {wanted}")
    return found[0][0]


def annotations(payload: DataFrame) -> DataFrame:
    """item_id, system_id, facet, value of a payload whose rows hold a list of values for each facet."""
    row = F.explode("rows").alias("r")
    one = payload.select(row).select(F.col("r.row.id").alias("item_id"), *(F.col(f"r.row.{f}").alias(f) for f in FACETS))
    if one.where(" or ".join(f"{f} is null" for f in FACETS)).head(1):
        raise ValueError("a facet is missing")
    long = one.select("item_id", F.posexplode(F.arrays_zip(*FACETS)).alias("k", "v"))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f"v.{f}").alias("value")) for f in FACETS)))
    return long.select("item_id", F.format_string("s_%02d", "k").alias("system_id"), each.alias("x")).select("item_id", "system_id", "x.*")


def instructions(answers: DataFrame, systems: Sequence[str], most: int) -> DataFrame:
    """Items from answers (system_id, instruction, output): content identifiers, texts cut to ``most`` characters.

    An instruction that a system lacks or answers twice fails, and so do two instructions of one identifier.
    """
    if most < 1 or not systems:
        raise ValueError("at least one character and one system are needed")
    own = answers.where(F.col("system_id").isin(list(systems)))
    if own.groupBy("system_id", "instruction").count().where("count > 1").head(1):
        raise ValueError("an instruction is answered twice")
    out = own.groupBy("instruction").agg(F.map_from_entries(F.collect_list(F.struct("system_id", F.left("output", F.lit(most))))).alias("outputs"))
    if out.where(F.size("outputs") != len(systems)).head(1):
        raise ValueError("systems answered different instructions")
    out = out.select(F.concat(F.lit("ae2_"), F.left(F.sha2("instruction", 256), F.lit(12))).alias("item_id"), F.left("instruction", F.lit(most)).alias("source"), "outputs")
    if out.groupBy("item_id").count().where("count > 1").head(1):
        raise ValueError("two instructions have one identifier")
    return out


def promotions(reports: DataFrame) -> DataFrame:
    """A row per seed, promotion and question of reports that hold paired outcome lists; unequal lists fail."""
    from ..operators.promotion import require_paired

    p = reports.select("seed", F.posexplode("promotions").alias("promo_idx", "p"))

    def side(column: str, name: str) -> DataFrame:
        return p.select("seed", "promo_idx", F.explode(f"p.{column}").alias("o")).select("seed", "promo_idx", F.col("o.question_id").alias("question_id"), F.col("o.correct").alias(name))

    return require_paired(side("confirm_baseline_outcomes", "base"), side("confirm_transform_outcomes", "transform"))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's entries; a broken last line is skipped."""
    return spark.read.text(path).where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", LEDGER).alias("r")).select("r.*")


def append_ledger(entries: DataFrame, path: str) -> None:
    """Appends entries to the ledger as JSON lines; every entry has a cost."""
    if "cost_usd" not in entries.columns or entries.where("cost_usd is null").head(1):
        raise ValueError("an entry lacks its cost")
    entries.select(F.to_json(F.struct(*sorted(entries.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    """A small result as canonical JSON: sorted keys, two blanks, ASCII."""
    Path(path).write_text(json.dumps([r.asDict(recursive=True) for r in rows.collect()], sort_keys=True, indent=2, ensure_ascii=True) + "\n", newline="\n")


def _cell(x: object) -> str:
    return "" if x is None else str(x).lower() if isinstance(x, bool) else f"{x:.6g}" if isinstance(x, float) else str(x)


def write_csv(rows: DataFrame, path: str, order: Sequence[str | Column]) -> None:
    """A small result as CSV in the given order: floats to six digits, nulls empty."""
    with open(path, "w", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(rows.columns)
        out.writerows([_cell(x) for x in r] for r in rows.orderBy(*order).collect())


def tex_table(rows: DataFrame, order: Sequence[str | Column]) -> str:
    """A small result as the body of a TeX table."""
    return "\n".join(" & ".join(_cell(x) or "--" for x in r) + r" \\" for r in rows.orderBy(*order).collect())
