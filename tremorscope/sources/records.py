"""Score records: JSON lines in, a quarantine beside them, Parquet or JSON lines out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import CorruptShardError
from ..schema import SCHEMA_VERSION, SCORE_RECORD


def _valid(line: Column, record: Column) -> Column:
    """A JSON object with exactly the schema's fields, its version, and exactly the usage's fields."""
    def same(keys: Column, names: list[str]) -> Column:
        return F.coalesce(F.array_sort(keys) == F.array(*(F.lit(n) for n in sorted(names))), F.lit(False))

    usage = SCORE_RECORD["usage"].dataType.names
    return F.try_parse_json(line).isNotNull() & same(F.json_object_keys(line), SCORE_RECORD.names) & F.coalesce(record["schema_version"] == SCHEMA_VERSION, F.lit(False)) & same(F.json_object_keys(F.get_json_object(line, "$.usage")), usage)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Every non-empty line of the shards under ``path``: file, byte order, text, record, whether it is valid."""
    raw = spark.read.option("pathGlobFilter", "*.jsonl").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    raw = raw.where(~F.col("file").endswith(".quarantine.jsonl") & (F.trim("value") != ""))
    record = F.from_json("value", SCORE_RECORD)
    return raw.withColumn("record", record).withColumn("valid", _valid(F.col("value"), record))


def read(spark: SparkSession, path: str, *, quarantine: bool = True) -> tuple[DataFrame, DataFrame]:
    """The valid records, and the broken last lines of shards. A broken line elsewhere fails unless it is quarantined."""
    all_lines = lines(spark, path)
    last = all_lines.groupBy("file").agg(F.max(F.struct("block", "at")).alias("last"))
    broken = all_lines.where(~F.col("valid")).join(last, "file").withColumn("is_last", (F.col("last.block") == F.col("block")) & (F.col("last.at") == F.col("at")))
    inner = broken.where(~F.col("is_last"))
    known = quarantined(spark, path)
    if known is not None:
        inner = inner.join(known, F.col("value") == F.col("raw_line"), "left_anti")
    if inner.head(1) or (not quarantine and broken.head(1)):
        raise CorruptShardError(f"a broken line inside a shard of {path}")
    return all_lines.where("valid").select("record.*"), broken.select("file", F.col("value").alias("raw_line")).dropDuplicates(["raw_line"])


def quarantined(spark: SparkSession, path: str) -> DataFrame | None:
    """The raw lines set aside beside the shards of a folder, if there are any."""
    side = spark.read.option("pathGlobFilter", "*.quarantine.jsonl").text(path).select(F.get_json_object("value", "$.raw_line").alias("raw_line")).where("raw_line is not null").distinct()
    return side if side.head(1) else None


def shard_path(folder: str, experiment: str, env_id: str) -> str:
    """Where the shard of an environment lies."""
    return f"{folder}/{experiment}/{env_id}.jsonl"


def set_aside(broken: DataFrame, folder: str) -> None:
    """Keeps broken lines (file, raw_line) beside the shards of a folder, each line once; later reads pass over them."""
    spark, side = broken.sparkSession, f"{folder}/broken.quarantine.jsonl"
    new = broken.select("raw_line").distinct()
    known = quarantined(spark, folder)
    new = new.join(known, "raw_line", "left_anti") if known is not None else new
    lines_ = [r[0] for r in new.select(F.to_json(F.struct("raw_line"))).collect()]  # at most one for each shard
    if lines_:
        with open(side, "a", encoding="utf-8", newline="\n") as f:
            f.writelines(x + "\n" for x in lines_)


def append(records: DataFrame, path: str) -> None:
    """Appends records, by environment; Spark's commit keeps a broken write out."""
    records.write.mode("append").partitionBy("env_id").parquet(path)


def append_lines(records: DataFrame, path: str) -> None:
    """Appends records as JSON lines with every field, nulls too."""
    records.select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def ordered(records: DataFrame) -> DataFrame:
    """The canonical order of records."""
    return records.orderBy("env_id", "item_id", "system_id", "repeat_idx", "run_id")


def by_cell(records: DataFrame) -> DataFrame:
    """A row per cell with its records in the order of repeats."""
    return records.groupBy("env_id", "item_id", "system_id").agg(F.array_sort(F.collect_list(F.struct("repeat_idx", "parsed_score", "parse_ok"))).alias("records"))


def latest(records: DataFrame) -> DataFrame:
    """One record per call key: the first run's."""
    by = Window.partitionBy("env_id", "item_id", "system_id", "repeat_idx").orderBy("run_id")
    return records.withColumn("r", F.row_number().over(by)).where("r = 1").drop("r")
