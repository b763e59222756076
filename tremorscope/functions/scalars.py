"""Scalar helpers: prompts, tokens, prices, identifiers, statements."""

from __future__ import annotations

import hashlib
import json
import random
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(text: Column) -> Column:
    """The content digest of a text."""
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def estimated_tokens(text: Column, per_token: float = 4.0, overhead: int = 8) -> Column:
    if per_token <= 0:
        raise ValueError("characters per token must be positive")
    return F.floor(F.char_length(text) / F.lit(per_token)).cast("long") + overhead


def rendered(template: Column, source: Column, output: Column) -> Column:
    """A prompt with its two placeholders filled in, the source first."""
    return F.replace(F.replace(template, F.lit("{source}"), source), F.lit("{output}"), output)


def call_price(in_tokens: Column, out_tokens: Column, in_price: Column, out_price: Column) -> Column:
    """US dollars of a call, at prices for a million tokens."""
    return (in_tokens * in_price + out_tokens * out_price) / 1e6


def paraphrase_of(repeat: Column, count: int) -> Column:
    return F.pmod(repeat, F.lit(count))


def call_seed(base: int, repeat: Column) -> Column:
    return F.lit(base) + repeat


def canonical_json(value: Any) -> str:
    """Sorted keys, no blanks, ASCII."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def env_id(fields: Mapping[str, Any]) -> str:
    """An environment's identifier: 12 hexadecimal digits of its canonical JSON's digest."""
    return "e_" + hashlib.sha256(canonical_json(dict(fields)).encode("utf-8")).hexdigest()[:12]


def backoff(attempt: int, base: float, rng: random.Random, most: float = 30.0) -> float:
    """Seconds to wait before a retry: uniform up to a doubling bound."""
    return rng.uniform(0.0, min(most, base * 2 ** (attempt - 1)))


def input_digest(records: DataFrame) -> str:
    """A digest of the scores that an analysis read, whatever their order and partitions.

    Each row's digest is cut into four numbers; their sums and the count of rows are digested again. So rows are
    hashed where they are, sums pre-aggregate, and repeated rows count.
    """
    line = F.to_json(F.struct("env_id", "item_id", "system_id", "repeat_idx", F.col("score").cast("string").alias("score")), {"ignoreNullFields": "false"})
    hashed = records.select(F.sha2(line, 256).alias("h"))
    sums = [F.sum(F.conv(F.substring("h", 1 + 16 * k, 15), 16, 10).cast("decimal(20,0)")).alias(f"s{k}") for k in range(4)]
    found = hashed.agg(F.count("*").alias("n"), *sums).first()
    return "sha256:" + hashlib.sha256("|".join(str(x or 0) for x in found).encode()).hexdigest()
