"""Row schemas and the fixed constants of the score model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 2

# A record's fields, in the record's order.
#: One judge call and its outcome.
SCORE_RECORD = (
    T.StructType()
    .add("schema_version", T.LongType())
    .add("run_id", T.StringType())
    .add("env_id", T.StringType())
    .add("judge_model", T.StringType())
    .add("judge_model_version", T.StringType())
    .add("judge_tier", T.StringType())
    .add("serving_engine", T.StringType())
    .add("quantization", T.StringType())
    .add("seed", T.LongType())
    .add("prompt_id", T.StringType())
    .add("paraphrase_id", T.StringType())
    .add("temperature", T.DoubleType())
    .add("scale", T.StringType())
    .add("task", T.StringType())
    .add("benchmark", T.StringType())
    .add("item_id", T.StringType())
    .add("system_id", T.StringType())
    .add("repeat_idx", T.LongType())
    .add("request_payload_hash", T.StringType())
    .add("raw_response", T.StringType())
    .add("parsed_score", T.DoubleType())
    .add("parse_ok", T.BooleanType())
    .add("usage", T.StructType().add("in_tokens", T.LongType()).add("out_tokens", T.LongType()))
    .add("cost_usd", T.DoubleType())
    .add("ts", T.StringType())
)
#: What identifies a call.
CALL_KEY = ("env_id", "item_id", "system_id", "repeat_idx")
ITEM = T.StructType().add("item_id", T.StringType()).add("source", T.StringType()).add("outputs", T.MapType(T.StringType(), T.StringType()))
#: One run's entry of the cost ledger.
LEDGER = (
    T.StructType()
    .add("run_id", T.StringType())
    .add("experiment", T.StringType())
    .add("pilot", T.BooleanType())
    .add("calls", T.LongType())
    .add("parse_failures", T.LongType())
    .add("in_tokens", T.LongType())
    .add("out_tokens", T.LongType())
    .add("cost_usd", T.DoubleType())
    .add("config_hash", T.StringType())
    .add("inputs_digest", T.StringType())
    .add("ts", T.StringType())
)

# A scale's lowest and highest score, its width, and the defaults of every resampling operator.
SCALES = {"likert5": (1.0, 5.0), "likert10": (1.0, 10.0), "score100": (0.0, 100.0)}
SEED = 20260731
RESAMPLES = 2000
CI_LEVEL = 0.95
SWEEP = (1, 3, 5, 8, 10)
ALPHAS = (0.10, 0.05, 0.01)
FIP_DRAWS = 200
NULL_DRAWS = 400
DECAY_DRAWS = 400
POWER = 0.80
POWER_STEP = 0.005
POWER_MOST = 4.0
BIN_MULTIPLES = (0.0, 0.5, 1.0, 2.0, 4.0)
LEAST_BIN_DRAWS = 30
TARGETS = (0.5, 1.0, 2.0, 5.0)
BOUNDARY = 2.0
SCREENING = (0,)
EXTERNAL_WIDTH = 4.0
FACETS = ("coherence", "consistency", "fluency", "relevance")


def width(scale: Column) -> Column:
    """A scale's width; an unknown scale fails."""
    out = F.raise_error(F.concat(F.lit("unknown scale: "), F.coalesce(scale, F.lit("null")))).cast("double")
    for name, (low, high) in SCALES.items():
        out = F.when(scale == name, F.lit(high - low)).otherwise(out)
    return out


def to_pp(value: Column, scale: Column) -> Column:
    """A score difference in percent of the scale's width; null stays null."""
    return F.when(value.isNotNull(), value / width(scale) * 100.0)


def from_pp(value: Column, scale: Column) -> Column:
    """The score difference of so many percent of the width."""
    return F.when(value.isNotNull(), value / 100.0 * width(scale))
