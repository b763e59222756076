"""Records as they arrive: validated, one per call key, appended exactly once for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import CALL_KEY, SCORE_RECORD
from ..sources.records import _valid


def incoming(spark: SparkSession, folder: str, *, late: str = "1 hour") -> DataFrame:
    """Valid records of new JSON-line files, the first of each call key within the watermark."""
    raw = spark.readStream.option("pathGlobFilter", "*.jsonl").text(folder)
    record = F.from_json("value", SCORE_RECORD)
    rows = raw.where(_valid(F.col("value"), record)).select(record.alias("r")).select("r.*").withColumn("at", F.to_timestamp("ts"))
    return rows.withWatermark("at", late).dropDuplicatesWithinWatermark(list(CALL_KEY))


def store(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived so far and stops."""
    return records.drop("at").writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("env_id").trigger(availableNow=True).start()


def running_failures(records: DataFrame, window: str = "10 minutes") -> DataFrame:
    """Attempts and failures by environment and time window."""
    return records.groupBy("env_id", F.window("at", window)).agg(F.count("*").alias("attempts"), F.count_if(~F.col("parse_ok")).alias("failures"))
