"""Sequential promotions: discordant answers, exact tests, and when to have stopped."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def discordant(answers: DataFrame) -> DataFrame:
    """Per seed and promotion: b (wrong to right), c (right to wrong), questions, accuracy before."""
    return answers.groupBy("seed", "promo_idx").agg(F.count_if(~F.col("base") & F.col("transform")).alias("b"), F.count_if(F.col("base") & ~F.col("transform")).alias("c"), F.count("*").alias("n_questions"), F.avg(F.col("base").cast("int")).alias("baseline_accuracy"))


def require_paired(base: DataFrame, transform: DataFrame) -> DataFrame:
    """Both outcomes by question; a question that only one side has fails."""
    keys = ["seed", "promo_idx", "question_id"]
    both = base.join(transform, keys, "full_outer")
    if both.where(F.col("base").isNull() | F.col("transform").isNull()).head(1):
        raise ValueError("the two outcome vectors hold different questions")
    return both


def lower_tail(n: Column, k: Column) -> Column:
    """P(X <= k) of a fair binomial, by the recurrence of its terms."""
    start = F.struct(F.pow(F.lit(0.5), n).alias("term"), F.pow(F.lit(0.5), n).alias("sum"))
    steps = F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] * (n - i + 1) / i
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    return F.when(k < 0, 0.0).otherwise(F.aggregate(steps, start, step, lambda a: a["sum"]))


def reversal(b: Column, c: Column) -> Column:
    """The probability that the majority is luck; 1 without a discordant pair."""
    return F.when(b + c == 0, 1.0).otherwise(lower_tail(b + c, F.least(b, c)))


def mcnemar(b: Column, c: Column) -> Column:
    """The exact two-sided test."""
    return F.when(b + c == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * lower_tail(b + c, F.least(b, c))))


def report(counts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per promotion: both tests, whether it clears the noise, and whether it is the seed's last that does."""
    out = counts.withColumn("confirm_delta", (F.col("b") - F.col("c")) / F.col("n_questions")).withColumn("mcnemar_p", mcnemar(F.col("b"), F.col("c"))).withColumn("reversal_prob", reversal(F.col("b"), F.col("c")))
    out = out.withColumn("clears", F.col("reversal_prob") <= alpha)
    last = F.max(F.when(F.col("clears"), F.col("promo_idx"))).over(Window.partitionBy("seed"))
    return out.withColumn("would_halt", F.coalesce(F.col("promo_idx") == last, F.lit(False)))


def stopping(rows: DataFrame) -> DataFrame:
    """Per seed: the last promotion that clears, its gain, the final gain and the drift between."""
    clear = F.when(F.col("clears"), F.col("promo_idx"))
    out = rows.groupBy("seed").agg(F.count("*").alias("n_promotions"), F.max(clear).alias("halt_promo_idx"), F.max_by("confirm_delta", clear).alias("peak"), F.max_by("confirm_delta", "promo_idx").alias("final_confirm_delta"), F.max_by(F.struct("b", "c"), clear).alias("bc"))
    some = F.col("halt_promo_idx").isNotNull()
    after = rows.join(out.select("seed", "halt_promo_idx"), "seed").groupBy("seed").agg(F.count_if(F.col("halt_promo_idx").isNull() | (F.col("promo_idx") > F.col("halt_promo_idx"))).alias("n_promotions_after_halt"))
    return out.join(after, "seed").select("seed", "n_promotions", "halt_promo_idx", F.when(some, F.col("bc.b")).alias("halt_b"), F.when(some, F.col("bc.c")).alias("halt_c"), F.when(some, F.col("peak")).alias("peak_confirm_delta"), "final_confirm_delta", "n_promotions_after_halt", F.when(some, F.col("final_confirm_delta") - F.col("peak")).alias("drift_confirm_delta"))


def bar(counts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per number of discordant pairs ``n``: the smallest majority b whose upper tail is at most alpha, null if none."""
    rows = counts.select("n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("b")).where("b > n / 2")
    tail = 1 - lower_tail(F.col("n"), F.col("b") - 1)
    least = rows.where(tail <= alpha + 1e-12).groupBy("n").agg(F.min("b").alias("min_majority"))
    return counts.join(least, "n", "left")


def exact_lower_tail(n: int, k: int) -> float:
    """The same in exact integers, for the driver."""
    return sum(comb(n, i) for i in range(k + 1)) / (1 << n) if k >= 0 else 0.0
