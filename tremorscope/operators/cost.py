"""What judge calls cost: prices, roll-ups, caps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UnknownPriceError
from ..functions.scalars import call_price

#: US dollars are rounded to so many digits.
DIGITS = 6


def price_table(spark: SparkSession, prices: Mapping[str, tuple[float, float]]) -> DataFrame:
    """model, in_price, out_price: US dollars for a million tokens."""
    return spark.createDataFrame([(m, float(a), float(b)) for m, (a, b) in prices.items()], "model string, in_price double, out_price double")


def roll_up(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Per model: calls, tokens and cost. A model without a price fails."""
    totals = calls.groupBy("model").agg(F.count("*").alias("calls"), F.sum("in_tokens").alias("in_tokens"), F.sum("out_tokens").alias("out_tokens"))
    out = totals.join(F.broadcast(prices), "model", "left")  # a row for each declared model
    cost = F.round(call_price(F.col("in_tokens"), F.col("out_tokens"), F.col("in_price"), F.col("out_price")), DIGITS)
    checked = F.when(F.col("in_price").isNull(), F.raise_error(F.concat(F.lit("no price declared for "), F.col("model"))).cast("double")).otherwise(cost)
    return out.select("model", "calls", "in_tokens", "out_tokens", checked.alias("cost_usd"))


def require_prices(calls: DataFrame, prices: DataFrame) -> None:
    if missing := calls.select("model").distinct().join(prices, "model", "left_anti").head(3):
        raise UnknownPriceError(f"no price declared for {[r[0] for r in missing]}")


def total(by_model: DataFrame) -> DataFrame:
    """The sum of the rounded parts."""
    return by_model.agg(F.sum("calls").alias("calls"), F.sum("in_tokens").alias("in_tokens"), F.sum("out_tokens").alias("out_tokens"), F.round(F.sum("cost_usd"), DIGITS).alias("cost_usd"))


def ledger_total(ledger: DataFrame) -> DataFrame:
    """Per experiment: entries, calls and cost."""
    return ledger.groupBy("experiment").agg(F.count("*").alias("entries"), F.sum("calls").alias("calls"), F.round(F.sum("cost_usd"), DIGITS).alias("cost_usd"))


def per_hundred_cells(ledger: DataFrame, tiers: DataFrame, repeats: tuple[int, ...] = (1, 3, 8, 20)) -> DataFrame:
    """Per tier and N: the cost of 100 cells scored N times."""
    sums = ledger.join(F.broadcast(tiers), "experiment", "left").groupBy("tier").agg(F.sum("cost_usd").alias("cost"), F.sum("calls").alias("calls"))  # a row for each experiment
    return sums.select("tier", "calls", F.explode(F.array(*(F.lit(n) for n in repeats))).alias("n_repeats"), "cost").select("tier", "calls", "n_repeats", (F.try_divide("cost", "calls") * F.col("n_repeats") * 100).alias("usd_per_100_cells"))


def verdict(slices: DataFrame, *, pilot_cap: float, cumulative_cap: float) -> DataFrame:
    """Per slice (name, pilot, projected_usd, spent_usd): its own cap first, then the cumulative cap."""
    projected, spent = F.round("projected_usd", DIGITS), F.round("spent_usd", DIGITS)
    cap = F.when(F.col("pilot"), F.lit(pilot_cap)).otherwise(F.lit(cumulative_cap))
    reason = F.when(projected > cap, F.when(F.col("pilot"), "over the pilot cap").otherwise("over the run cap")).when(spent + projected > cumulative_cap, "over the cumulative cap").otherwise("within caps")
    return slices.select("slice", "pilot", projected.alias("projected_usd"), spent.alias("spent_usd"), cap.alias("slice_cap_usd"), F.when(reason == "within caps", "ok").otherwise("block").alias("verdict"), reason.alias("reason"))
