"""The engine's registered queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing
from ..functions.scalars import digest, estimated_tokens
from ..operators import cells, cost, decay, external, fip, lookup, null, planning, promotion, resample, variance
from ..schema import to_pp, width
from . import views
from .views import ESTIMATION, SCALE

#: Monte-Carlo sizes of the registered queries; the library's defaults are larger.
DRAWS, SWEEP, BOOTS = 40, (1, 3), 100

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}


def query(f: Query) -> Query:
    _queries[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from .sql import SQL

    return dict(SQL)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, no negative zero."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def scale_width() -> Column:
    return width(F.lit(SCALE))


@query
def score_records_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.score_records(spark, sf_dir)


@query
def duplicate_key_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = views.score_records(spark, sf_dir).withColumn("repeat_idx", F.col("repeat_idx") % 5)
    return cells.conflicts(folded)


@query
def env_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.env_metadata(views.score_records(spark, sf_dir))


@query
def repeat_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.supported(views.score_records(spark, sf_dir), ESTIMATION)


@query
def cell_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(variance.cell_variance(views.score_records(spark, sf_dir)))


@query
def pooled_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(variance.pooled(views.score_records(spark, sf_dir), "env_id"))


@query
def system_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(variance.pooled(views.score_records(spark, sf_dir), "env_id", "system_id"))


@query
def item_flip_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(variance.flip_rates(views.score_records(spark, sf_dir)))


@query
def rank_flip_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(variance.rank_flips(views.score_records(spark, sf_dir)))


@query
def alpha_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(variance.alpha(views.score_records(spark, sf_dir), "interval"))


@query
def alpha_nominal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(variance.alpha(views.score_records(spark, sf_dir), "nominal"))


@query
def alpha_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(variance.alpha(views.score_records(spark, sf_dir), "ordinal"))


@query
def env_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(variance.report(views.score_records(spark, sf_dir)))


@query
def to_percent_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = views.score_records(spark, sf_dir).groupBy("env_id", "system_id").agg(F.avg("score").alias("mean_score"))
    return rounded(means.select("env_id", "system_id", to_pp(F.col("mean_score") - 1, F.lit(SCALE)).alias("mean_pp")))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.responses(spark, sf_dir).withColumn("parsed_score", parsing.parsed_score(F.col("response"), SCALE))
    return rows.withColumn("parse_ok", F.col("parsed_score").isNotNull())


@query
def parse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("env_id", "l_orderkey", "l_linenumber", "response", "parsed_score", parsing.reason(F.col("response"), F.col("parsed_score")).alias("reason"))


@query
def parse_failure_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cells.attempts(_parsed(spark, sf_dir)))


@query
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", digest(F.col("text")).alias("digest"))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("model_"), "lang").alias("model"), estimated_tokens(F.col("text")).alias("in_tokens"), F.lit(8).cast("long").alias("out_tokens"))


@query
def estimate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).select("doc_id", "in_tokens")


#: US dollars for a million tokens of the made-up models.
PRICES = {"model_en": (0.15, 0.6), "model_de": (2.0, 8.0), "model_fr": (1.0, 4.0), "model_es": (0.5, 1.5)}


@query
def price_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cost.roll_up(_calls(spark, sf_dir), cost.price_table(spark, PRICES)))


@query
def plan_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.score_records(spark, sf_dir)
    return planning.planned(r.select("env_id"), r.select("item_id"), r.select("system_id"), repeats=20, paraphrases=4, base_seed=7)


@query
def grid_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_calls(spark, sf_dir).groupBy("env_id").agg(F.count_distinct("item_id", "system_id").alias("cells"), F.count("*").alias("expected_calls"), (F.count("*") * 2).alias("worst_case_calls"))


@query
def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.score_records(spark, sf_dir)
    plan = planning.planned(r.select("env_id"), r.select("item_id"), r.select("system_id"), repeats=24)
    return planning.remaining(plan, r).select("env_id", "item_id", "system_id", "repeat_idx")


@query
def ledger_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cost.ledger_total(views.ledger(spark, sf_dir)), 2)


@query
def cost_per_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = views.ledger(spark, sf_dir)
    tiers = led.select("experiment").distinct().withColumn("tier", F.when(F.left("experiment", F.lit(1)) <= "2", "anchor").otherwise("dense"))
    return rounded(cost.per_hundred_cells(led, tiers), 4)


@query
def budget_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = views.ledger(spark, sf_dir).groupBy("experiment").agg(F.round(F.sum("cost_usd"), 2).alias("projected_usd"))
    slices = sums.select(F.col("experiment").alias("slice"), (F.left("experiment", F.lit(1)) == "1").alias("pilot"), "projected_usd", F.lit(100000.0).alias("spent_usd"))
    return rounded(cost.verdict(slices, pilot_cap=50000.0, cumulative_cap=5000000.0), 2)


def _annotated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The outside reference and the judge's means."""
    judge = views.signal_records(spark, sf_dir).where(F.col("repeat_idx").isin(ESTIMATION)).groupBy("env_id", "item_id", "system_id").agg(F.avg("score").alias("mean_score"))
    return external.facet_means(views.annotations(spark, sf_dir)), judge


@query
def annotation_facet_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(external.facet_means(views.annotations(spark, sf_dir)))


def _system_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return external.facet_means(views.annotations(spark, sf_dir)).groupBy("system_id").agg(F.avg("value").alias("mean"))


@query
def closest_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(external.closest_pair(_system_means(spark, sf_dir)))


@query
def tightest_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(external.tightest_cluster(_system_means(spark, sf_dir), 3))


@query
def gap_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(external.gap_ladder(_system_means(spark, sf_dir), (5.0, 15.0, 30.0)))


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return external.gaps(external.differences(*_annotated(spark, sf_dir)), scale_width())


@query
def external_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_gaps(spark, sf_dir))


@query
def external_gap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(external.gap_intervals(external.differences(*_annotated(spark, sf_dir)), resamples=BOOTS))


@query
def bias_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(external.bias(_gaps(spark, sf_dir)))


@query
def rank_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(external.concordance(_gaps(spark, sf_dir)))


@query
def system_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(external.system_ranks(*_annotated(spark, sf_dir), scale_width()))


@query
def facet_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, judge = _annotated(spark, sf_dir)
    diffs = external.differences(views.annotations(spark, sf_dir), judge, ["facet"])
    return rounded(external.gaps(diffs, scale_width(), ["facet"]))


@query
def discordant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(promotion.discordant(views.answers(spark, sf_dir)))


@query
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = promotion.discordant(views.answers(spark, sf_dir))
    return rounded(counts.select("seed", "promo_idx", promotion.mcnemar(F.col("b"), F.col("c")).alias("mcnemar_p"), promotion.reversal(F.col("b"), F.col("c")).alias("reversal_prob")))


@query
def promotion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(promotion.report(promotion.discordant(views.answers(spark, sf_dir))))


@query
def stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(promotion.stopping(promotion.report(promotion.discordant(views.answers(spark, sf_dir)))))


@query
def prospective_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promotion.bar(spark.range(0, 41).select(F.col("id").alias("n")))


@query
def omega_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(decay.components(decay.usable(decay.group_means(views.signal_records(spark, sf_dir)))))


@query
def pair_gap_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(decay.pair_gap_shift(decay.group_means(views.signal_records(spark, sf_dir))))


def _variances(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    groups = decay.grouped(views.signal_records(spark, sf_dir))
    return decay.draw_variances(groups, sweep=(1, 2, 4), draws=DRAWS), groups


@query
def decay_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(decay.fit(*_variances(spark, sf_dir)))


@query
def decay_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(decay.deviation(_variances(spark, sf_dir)[0]))


@query
def omega_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(decay.omega_interval(_variances(spark, sf_dir)[0], resamples=BOOTS))


@query
def label_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    # many values end in a 5 at the seventh digit: what the order of a sum leaves beyond the tenth goes first
    return rounded(rounded(decay.label_interval(decay.group_means(views.signal_records(spark, sf_dir)), resamples=BOOTS), 10))


@query
def component_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(decay.item_interval(decay.group_means(views.signal_records(spark, sf_dir)), resamples=BOOTS), 10))


@query
def gap_shift_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(decay.shift_interval(decay.group_means(views.signal_records(spark, sf_dir)), resamples=BOOTS), 10))


@query
def sigma_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resample.sigma_interval(views.score_records(spark, sf_dir), resamples=BOOTS))


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = views.signal_records(spark, sf_dir)
    return fip.curve(fip.draws(records, ESTIMATION, sweep=SWEEP, draws_per_pair=DRAWS), records, ESTIMATION, multiples=(0.0, 0.1, 0.2, 0.4, 0.6, 0.8))


@query
def fip_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_bins(spark, sf_dir))


@query
def fip_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fip.statements(_bins(spark, sf_dir))


def _null_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return null.draws(views.score_records(spark, sf_dir), ESTIMATION, sweep=SWEEP, draws_per_system=DRAWS)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return null.detectable(_null_draws(spark, sf_dir), alphas=(0.10, 0.05)).withColumn("scale", F.lit(SCALE))


@query
def null_mdi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(null.in_sigma(_entries(spark, sf_dir), views.score_records(spark, sf_dir), ESTIMATION).drop("scale"))


@query
def null_mdi_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(null.intervals(_null_draws(spark, sf_dir), alphas=(0.10, 0.05), resamples=BOOTS))


def _powered(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = _null_draws(spark, sf_dir)
    return null.at_power(drawn, null.detectable(drawn, alphas=(0.10, 0.05)).withColumn("scale", F.lit(SCALE)))


@query
def mdi_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_powered(spark, sf_dir).select("env_id", "n_repeats", "alpha", "mdi_null", "mdi_power"))


@query
def mdi_isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = null.isotonic(null.isotonic(_powered(spark, sf_dir), "mdi_null", "mdi_null_smoothed"), "mdi_power", "mdi_power_smoothed")
    return rounded(both.select("env_id", "n_repeats", "alpha", "mdi_null_smoothed", "mdi_power_smoothed"))


@query
def mdi_fip_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lookup.crossings(_bins(spark, sf_dir), alphas=(0.10, 0.05), least=10))


@query
def mdi_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lookup.consistency(_entries(spark, sf_dir), lookup.crossings(_bins(spark, sf_dir), alphas=(0.10, 0.05), least=10)))


@query
def recommended_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    smooth = null.isotonic(_entries(spark, sf_dir), "mdi_null", "v").withColumn("pp", to_pp(F.col("v"), F.col("scale")))
    return rounded(lookup.needed_repeats(smooth, "pp", targets=(2.0, 5.0, 10.0, 20.0)))


@query
def sla_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lookup.margins(_entries(spark, sf_dir), "abs_delta_quantile", columns=SWEEP))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = views.signal_records(spark, sf_dir)
    systems = records.select("env_id", "system_id").distinct()
    own = systems.select("env_id", F.col("system_id").alias("system_a"), F.col("system_id").alias("system_b"))
    grid = systems.select("env_id").distinct().select("env_id", F.explode(F.array(*(F.struct(F.lit(n).alias("n_repeats"), F.lit(t).alias("threshold")) for n, t in ((1, 0.5), (3, 0.3))))).alias("g")).select("env_id", "g.*")
    return external.claims(records, ESTIMATION, variance.pairs(systems).unionByName(own), grid, draws=DRAWS)


@query
def claim_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(external.claim_rates(_claims(spark, sf_dir)))


@query
def detection_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(external.detection(_claims(spark, sf_dir), _gaps(spark, sf_dir)))


@query
def detection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(external.detection_summary(external.detection(_claims(spark, sf_dir), _gaps(spark, sf_dir)), scale_width(), boundary=15.0))
