"""Literal expectations, parameter recovery, guards, storage, execution and streaming."""

from __future__ import annotations

import json
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F
from tremorscope import errors, schema
from tremorscope.functions import parsing, rng, scalars
from tremorscope.operators import cells, cost, decay, external, fip, lookup, null, planning, promotion, resample, variance
from tremorscope.sources import inputs, records, synthetic

LIKERT5 = [('{"score": 4}', 4), ("Score: 3", 3), ("rating = 5", 5), ("4/5", 4), ("2 out of 5", 2), ("I say 4", 4), ('{"rating": "3"}', 3), ("점수: 4", 4), ('{"score": true, "value": 2}', 2), ("", None), ("no idea", None), ("7", None), ("3 or 4", None), ("8/10", None)]


def scores_frame(spark, cells_, env="e"):
    rows = [(env, i, s, k, float(v)) for (i, s), values in cells_.items() for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "env_id string, item_id string, system_id string, repeat_idx long, score double")


@pytest.mark.parametrize("parse", [parsing.parsed_score, parsing.strict_parsed_score])
def test_parse(spark, parse):
    df = spark.createDataFrame(LIKERT5, "response string, want int")
    got = df.select("response", "want", parse(F.col("response"), "likert5").alias("got")).collect()
    assert [(r.response, r.got) for r in got] == [(r.response, r.want) for r in got]


def test_json_keys_fall_through_and_ranges(spark):
    df = spark.createDataFrame([('{"score": 9, "rating": 4}',), ('x {"score": "4 of 5"} y',), ("-3",)], "r string")
    assert [r[0] for r in df.select(parsing.parsed_score(F.col("r"), "likert5")).collect()] == [4, 4, None]
    assert [r[0] for r in df.select(parsing.parsed_score(F.col("r"), "score100")).collect()] == [9, 4, None]


def test_percent_points(spark):
    row = spark.range(1).select(schema.to_pp(F.lit(0.294), F.lit("likert5")), schema.to_pp(F.lit(0.9), F.lit("likert10")), schema.to_pp(F.lit(None).cast("double"), F.lit("likert5"))).first()
    assert row[0] == pytest.approx(7.35) and row[1] == pytest.approx(10) and row[2] is None
    with pytest.raises(Exception, match="unknown scale"):
        spark.range(1).select(schema.width(F.concat(F.lit("stars"), F.col("id").cast("string")))).collect()


def test_flip_rate_alpha_percentile(spark):
    assert variance.flip_rates(scores_frame(spark, {("i", "a"): [4, 4, 5]})).first()["flip_rate"] == pytest.approx(2 / 3)
    two = scores_frame(spark, {("i", "a"): [1, 3], ("j", "a"): [3, 1]})
    assert variance.alpha(two, "interval").first()["alpha"] == pytest.approx(-0.5)
    one = scores_frame(spark, {("i", "a"): [3, 3], ("j", "a"): [3, 3]})
    assert variance.alpha(one, "nominal").first()["alpha"] is None
    assert spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "x double").select(resample.percentile("x", 0.25)).first()[0] == 1.75


def test_rank_flip_with_equal_means_counts_everything(spark):
    assert variance.rank_flips(scores_frame(spark, {("i", "a"): [1, 3], ("i", "b"): [2, 2]})).first()["rank_flip_rate"] == 1.0


def test_isotonic_and_inflation(spark):
    rows = [("e", n, 0.05, v) for n, v in zip((1, 3, 5, 8), (3.0, 1.0, 2.0, 0.5), strict=True)] + [("f", 1, 0.05, None), ("f", 3, 0.05, 2.0)]
    df = spark.createDataFrame(rows, "env_id string, n_repeats int, alpha double, v double")
    got = {(r.env_id, r.n_repeats): r.s for r in null.isotonic(df, "v", "s").collect()}
    assert [got["e", n] for n in (1, 3, 5, 8)] == [3, 1.5, 1.5, 0.5] and got["f", 1] is None and got["f", 3] == 2
    f = [spark.range(1).select(null.inflation(F.lit(1 / 9 + 1 / 10), F.lit(n))).first()[0] for n in (1, 10)]
    assert f[0] == pytest.approx(1) and f[1] == pytest.approx(1.396, abs=1e-3)


def test_readoff_and_needed_repeats(spark):
    bins = spark.createDataFrame([("e", 1, 1.0, 0.20, 1.5, 40, 1.0), ("e", 1, 2.0, 0.0, None, 40, 1.0)], "env_id string, n_repeats int, mean_delta double, fip double, hi double, n_draws int, sigma double")
    assert lookup.crossings(bins, alphas=(0.05,)).first()["mdi_fip"] == pytest.approx(1.75)
    assert lookup.crossings(bins, alphas=(0.05,), readoff="bin_upper").first()["mdi_fip"] == 2.0
    rows = spark.createDataFrame([("e", n, 0.05, "likert5", v) for n, v in ((1, 2.0), (5, 1.0), (10, 0.5))], "env_id string, n_repeats int, alpha double, scale string, v double")
    got = {r.target_pp: r.recommended_n for r in lookup.needed_repeats(rows, "v", targets=(1.5, 0.8, 0.3)).collect()}
    assert got == {1.5: 5, 0.8: 10, 0.3: None}


def test_power_against_the_grid(spark):
    values = [-1.0, -0.401, 0.0, 0.3, 0.9, 1.2, -0.2, 0.5, -0.8, 0.1]
    drawn = spark.createDataFrame([("e", 1, v) for v in values], "env_id string, n_repeats int, delta double")
    entries = spark.createDataFrame([("e", 1, 0.05, 1.0)], "env_id string, n_repeats int, alpha double, mdi_null double")
    want = next(s * 0.005 for s in range(801) if sum(v > 1.0 - s * 0.005 for v in values) / len(values) >= 0.8)
    assert null.at_power(drawn, entries, power=0.8).first()["mdi_power"] == pytest.approx(want)


@pytest.mark.parametrize(("b", "c", "p", "r"), [(11, 1, 0.00634766, 0.00317383), (10, 0, 0.00195313, 0.00097656), (7, 6, 1.0, 0.5), (0, 0, 1.0, 1.0)])
def test_mcnemar(spark, b, c, p, r):
    row = spark.range(1).select(promotion.mcnemar(F.lit(b), F.lit(c)), promotion.reversal(F.lit(b), F.lit(c))).first()
    assert row[0] == pytest.approx(p, abs=1e-7) and row[1] == pytest.approx(r, abs=1e-7)
    assert b + c == 0 or row[1] == pytest.approx(promotion.exact_lower_tail(b + c, min(b, c)))


def test_majority(spark):
    got = {r.n: r.min_majority for r in promotion.bar(spark.createDataFrame([(n,) for n in (13, 8, 5, 4)], "n long")).collect()}
    assert got == {13: 10, 8: 7, 5: 5, 4: None}


def test_stopping(spark):
    rows = [(101, k, b, c, 100, 0.5) for k, (b, c) in enumerate([(7, 6), (6, 1), (11, 1), (13, 4), (5, 5), (7, 6)])]
    rep = promotion.report(spark.createDataFrame(rows, "seed long, promo_idx long, b long, c long, n_questions long, baseline_accuracy double"))
    row = promotion.stopping(rep).first()
    assert (row["halt_promo_idx"], row["halt_b"], row["n_promotions_after_halt"]) == (3, 13, 2) and row["drift_confirm_delta"] == pytest.approx(0.01 - 0.09)
    assert [r.promo_idx for r in rep.where("would_halt").collect()] == [3]


def test_tokens_and_ladder(spark):
    assert spark.range(1).select(scalars.estimated_tokens(F.lit("x" * 400))).first()[0] == 108
    means = spark.createDataFrame([(f"s{k}", float(k + 1)) for k in range(5)], "system_id string, mean double")
    got = {r.target: (r.system_a, r.system_b) for r in external.gap_ladder(means, (25, 100)).collect()}
    assert got == {25.0: ("s0", "s1"), 100.0: ("s0", "s4")}
    assert external.closest_pair(means).first()["system_b"] == "s1"
    assert sorted(r.system_id for r in external.tightest_cluster(means, 3).collect()) == ["s0", "s1", "s2"]


def test_random_source_is_keyed(spark):
    import hashlib

    got = spark.range(50).select(rng.u32("p", 7, F.col("id"))).collect()
    assert [r[0] for r in got] == [int(hashlib.md5(f"p|7|{k}".encode()).hexdigest()[:8], 16) for k in range(50)]
    row = spark.range(1).select(rng.shuffled(F.array(*map(F.lit, range(20))), "x")).first()[0]
    assert sorted(row) == list(range(20)) and row != list(range(20))


def test_sigma_recovery(spark):
    df = synthetic.scores(spark, {"s_A": 3.0}, items=20, repeats=40, sigma=0.8, seed=3)
    row = resample.sigma_interval(df.select("env_id", "item_id", "system_id", "repeat_idx", "score"), resamples=50).first()
    assert row["sigma"] == pytest.approx(0.8, abs=0.06) and row["ci_lo"] < row["sigma"] < row["ci_hi"]


def test_null_width_recovery(spark):
    df = synthetic.scores(spark, {"a": 0.0, "b": 1.0, "c": 2.0}, items=8, repeats=40, sigma=1.0, seed=5)
    got = null.detectable(null.draws(df, range(1, 40), sweep=(1,), draws_per_system=150), alphas=(0.05,)).first()
    assert got["mdi_null"] == pytest.approx(1.96 * math.sqrt(2 / 8), rel=0.2)
    assert got["pool_inflation"] == pytest.approx(1.0)


def test_fip_recovery(spark):
    df = synthetic.scores(spark, {"a": 0.5, "b": 0.0}, items=8, repeats=60, sigma=1.0, seed=9)
    d = fip.draws(df, range(1, 60), sweep=(1,), draws_per_pair=300)
    p = 0.5 * math.erfc(0.5 / math.sqrt(2 / 8) / math.sqrt(2))
    assert d.agg(F.avg(F.col("reversed").cast("int"))).first()[0] == pytest.approx(2 * p * (1 - p), abs=0.1)


def test_decay_recovery(spark):
    df = synthetic.scores(spark, {"a": 3.0, "b": 3.5}, items=12, repeats=40, sigma=0.5, seed=11, offsets=(-0.5, 0.5))
    groups = decay.grouped(df)
    got = decay.fit(decay.draw_variances(groups, sweep=(1, 2, 4, 8), draws=150), groups).first()
    assert got["sigma_sq"] == pytest.approx(0.25, abs=0.06) and got["omega_sq"] == pytest.approx(0.25, abs=0.06)
    parts = decay.components(decay.usable(decay.group_means(df))).first()
    assert parts["omega_sq_between"] == pytest.approx(parts["omega_sq_main"] + parts["omega_sq_int"])


def test_guards(spark):
    df = scores_frame(spark, {("i", "a"): [1, 2]})
    with pytest.raises(errors.DuplicateScoreError):
        cells.require_no_conflict(df.unionByName(df.withColumn("score", F.col("score") + 1)))
    assert cells.unique(cells.require_no_conflict(df.unionByName(df))).count() == 2
    with pytest.raises(errors.OverlappingRepeatsError):
        cells.split([0, 1], [1, 2, 3])
    with pytest.raises(errors.UnknownEnvironmentError):
        cells.require_envs(df, ["e", "other"])
    assert cells.repeats_of("0-2,7") == [0, 1, 2, 7]
    with pytest.raises(ValueError):
        cells.repeats_of("4-1")
    with pytest.raises(errors.UnknownPriceError):
        cost.require_prices(spark.createDataFrame([("m",)], "model string"), cost.price_table(spark, {"n": (1, 1)}))
    with pytest.raises(errors.GateError):
        planning.gates(receipt="x", config_hash="y", pilot=True, piloted=True, projected=1, spent=0, cap=9)


def record(k, **more):
    row = {"schema_version": 2, "run_id": "r", "env_id": "e", "judge_model": "m", "judge_model_version": "v", "judge_tier": "t", "serving_engine": None, "quantization": None, "seed": k, "prompt_id": "p", "paraphrase_id": "pp", "temperature": 1.0, "scale": "likert5", "task": "s", "benchmark": "b", "item_id": "i", "system_id": "a", "repeat_idx": k, "request_payload_hash": "h", "raw_response": "4", "parsed_score": 4.0, "parse_ok": True, "usage": {"in_tokens": 1, "out_tokens": 2}, "cost_usd": 0.1, "ts": f"2026-01-01T00:00:0{k}Z"}
    return json.dumps(row | more)


def test_shards_and_quarantine(spark, tmp_path):
    (tmp_path / "one.jsonl").write_text("\n".join([record(0), "", record(1), '{"torn": '[:8]]))
    (tmp_path / "two.jsonl").write_text(record(2, env_id="f") + "\n")
    good, broken = records.read(spark, str(tmp_path))
    assert good.count() == 3 and [r.raw_line for r in broken.collect()] == ['{"torn":']
    (tmp_path / "two.jsonl").write_text(record(2, extra=1) + "\n" + record(3) + "\n")
    with pytest.raises(errors.CorruptShardError):
        records.read(spark, str(tmp_path))
    (tmp_path / "two.quarantine.jsonl").write_text(json.dumps({"raw_line": record(2, extra=1)}) + "\n")
    good, _ = records.read(spark, str(tmp_path))
    assert good.count() == 3
    records.append(good, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 3
    records.append_lines(good, str(tmp_path / "lines"))
    assert records.by_cell(good).count() == good.select("env_id", "item_id", "system_id").distinct().count()


def test_streaming_ingest(spark, tmp_path):
    from tremorscope.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join([record(0), record(1), record(1), "broken"]))
    q = ingest.store(ingest.incoming(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_execute_redraws_failures_up_to_the_cap(spark, tmp_path):
    plan = spark.createDataFrame([("e", f"i{k}", "a") for k in range(4)], "env_id string, item_id string, system_id string")

    def judge(frame: pd.DataFrame) -> pd.Series:
        return pd.Series(["none" if i == "i0" or (i == "i1" and r == 0) else f"Score: {1 + r % 5}" for i, r in zip(frame["item_id"], frame["repeat_idx"], strict=True)])

    out = planning.execute(spark, plan, str(tmp_path / "r"), judge, "likert5", repeats=3)
    got = {r.item_id: (r.n, r.ok) for r in out.groupBy("item_id").agg(F.count("*").alias("n"), F.count_if("parse_ok").alias("ok")).collect()}
    assert got == {"i0": (6, 0), "i1": (4, 3), "i2": (3, 3), "i3": (3, 3)}
    assert planning.execute(spark, plan, str(tmp_path / "r"), judge, "likert5", repeats=3).count() == 16


def test_execute_goes_on_until_all_attempts_are_used_up(spark, tmp_path):
    plan = spark.createDataFrame([("e", "i", "a")], "env_id string, item_id string, system_id string")

    def judge(frame: pd.DataFrame) -> pd.Series:
        return pd.Series([f"Score: {1 + r % 5}" if r < 11 else "none" for r in frame["repeat_idx"]])

    assert planning.execute(spark, plan, str(tmp_path / "r"), judge, "likert5", repeats=12).count() == 24


def test_inputs(spark, tmp_path):
    (tmp_path / "items.jsonl").write_text("\n".join(json.dumps({"item_id": f"i{k}", "source": "s", "outputs": {"a": "x", "b": "y"}}) for k in (2, 1)))
    items = inputs.items(spark, str(tmp_path / "items.jsonl"))
    assert [r.item_id for r in items.collect()] == ["i1", "i2"]
    parts = inputs.materialized(items)
    inputs.write_snapshots(parts, str(tmp_path / "snap"))
    inputs.write_snapshots(parts, str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 3
    payload = spark.createDataFrame([([{"row": {"id": "d", "coherence": [1.0, 2.0], "consistency": [1.0, 2.0], "fluency": [3.0, 2.0], "relevance": [5.0, 2.0]}}],)], "rows array<struct<row: struct<id: string, coherence: array<double>, consistency: array<double>, fluency: array<double>, relevance: array<double>>>>")
    assert {r.system_id: r.value for r in external.facet_means(inputs.annotations(payload)).collect()} == {"s_00": 2.5, "s_01": 2.0}
    (tmp_path / "ledger.jsonl").write_text('{"experiment": "x", "calls": 2, "cost_usd": 0.5}\n{"exper')
    assert cost.ledger_total(inputs.ledger(spark, str(tmp_path / "ledger.jsonl"))).first()["cost_usd"] == 0.5
    inputs.write_csv(spark.createDataFrame([(2, None, True), (1, 0.123456789, False)], "k int, x double, b boolean"), str(tmp_path / "o.csv"), ["k"])
    assert (tmp_path / "o.csv").read_text() == "k,x,b\n1,0.123457,false\n2,,true\n"
    assert scalars.input_digest(scores_frame(spark, {("i", "a"): [1, 2]})) == scalars.input_digest(scores_frame(spark, {("i", "a"): [1, 2]}))
