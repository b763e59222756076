"""Scores from a judge's free text: JSON, then a label, then a fraction of the scale, then a sole number."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SCALES

# Fixed patterns of numbers, labels and fractions.
NUMBER = r"[-+]?\d+(?:\.\d+)?"
LABEL = r"(?i)\b(?:score|rating|rate|grade|점수)\b\s*(?:is|=|:)?\s*(" + NUMBER + ")"
FRACTION = r"(?i)(" + NUMBER + r")\s*(?:/|\bout\s+of\b)\s*(" + NUMBER + ")"
JSON_KEYS = ("score", "rating", "value")


def _inside(value: Column, scale: str) -> Column:
    low, high = SCALES[scale]
    return value.between(low, high)


def _first(values: Column, scale: str) -> Column:
    return F.get(F.filter(F.transform(values, lambda x: x.cast("double")), lambda x: _inside(x, scale)), F.lit(0))


def from_json(text: Column, scale: str) -> Column:
    block = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    found = []
    for key in JSON_KEYS:
        raw = F.get_json_object(block, f"$.{key}")
        number = F.coalesce(raw.try_cast("double"), F.regexp_extract(raw, NUMBER, 0).try_cast("double"))
        found.append(F.when(~raw.rlike(r"^[\[{]") & _inside(number, scale), number))
    return F.when((block != "") & F.try_parse_json(block).isNotNull(), F.coalesce(*found))


def from_label(text: Column, scale: str) -> Column:
    return _first(F.regexp_extract_all(text, F.lit(LABEL), F.lit(1)), scale)


def from_fraction(text: Column, scale: str) -> Column:
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(FRACTION), F.lit(1)), F.regexp_extract_all(text, F.lit(FRACTION), F.lit(2)), lambda a, b: F.when(b.cast("double") == SCALES[scale][1], a))
    return _first(F.filter(pairs, lambda x: x.isNotNull()), scale)


def from_sole_number(text: Column, scale: str) -> Column:
    numbers = F.regexp_extract_all(text, F.lit("(" + NUMBER + ")"), F.lit(1))
    return F.when(F.size(numbers) == 1, _first(numbers, scale))


def parsed_score(response: Column, scale: str) -> Column:
    """The score of a response, null if none in range is found."""
    text = F.regexp_replace(response, r"(?U)^\s+|\s+$", "")
    return F.coalesce(from_json(text, scale), from_label(text, scale), from_fraction(text, scale), from_sole_number(text, scale))


def reason(response: Column, score: Column) -> Column:
    return F.when(score.isNotNull(), "ok").when(F.regexp_replace(response, r"(?U)\s", "") == "", "empty_response").otherwise("no_score_in_range")


def strict_parsed_score(response: Column, scale: str) -> Column:
    """The same with Python's JSON and digit rules, by Arrow batches: for data in which leniency matters."""
    low, high = SCALES[scale]

    def one(text: str) -> float | None:
        text = (text or "").strip()
        inside = lambda x: low <= x <= high
        if block := re.search(r"\{.*\}", text, re.S):
            try:
                obj = json.loads(block[0])
            except ValueError:
                obj = None
            for key in JSON_KEYS if isinstance(obj, dict) else ():
                raw = obj.get(key)
                if isinstance(raw, str):
                    raw = float(m[0]) if (m := re.search(NUMBER, raw)) else None
                if isinstance(raw, int | float) and not isinstance(raw, bool) and inside(raw):
                    return float(raw)
        candidates = [float(x) for x in re.findall(LABEL[4:], text, re.I)]
        candidates += [float(a) for a, b in re.findall(FRACTION[4:], text, re.I) if float(b) == high]
        sole = re.findall(NUMBER, text)
        candidates += [float(sole[0])] if len(sole) == 1 else []
        return next((x for x in candidates if inside(x)), None)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one).astype("float64")

    return run(response)
