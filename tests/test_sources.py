"""Configurations, pinned sources, sinks, display texts and the command line."""

from __future__ import annotations

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F
from tremorscope import __main__ as line
from tremorscope.functions import display, scalars
from tremorscope.operators import cells
from tremorscope.sources import config, inputs, records

FACETS = ("coherence", "consistency", "fluency", "relevance")


def _record(k, **more):
    row = {"schema_version": 2, "run_id": "r", "env_id": "e", "judge_model": "m", "judge_model_version": "v", "judge_tier": "t", "serving_engine": None, "quantization": None, "seed": k, "prompt_id": "p", "paraphrase_id": "pp", "temperature": 1.0, "scale": "likert5", "task": "s", "benchmark": "b", "item_id": "i", "system_id": "a", "repeat_idx": k, "request_payload_hash": "h", "raw_response": "4", "parsed_score": 4.0, "parse_ok": True, "usage": {"in_tokens": 1, "out_tokens": 2}, "cost_usd": 0.1, "ts": f"2026-01-01T00:00:0{k}Z"}
    return json.dumps(row | more)


def _payload():
    means = (1.0, 4.0, 2.0, 4.1)
    return {"rows": [{"row": {"id": i, "text": f"text {i}", "machine_summaries": [f"{i}-{k}" for k in range(4)], **{f: list(means) for f in FACETS}}} for i in ("b", "a", "c")]}


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("a: 1\nb: [x]\n")
    conf = config.load(str(tmp_path / "c.yaml"))
    assert conf == {"a": 1, "b": ["x"]} and config.config_hash(conf) == config.config_hash({"b": ["x"], "a": 1}) and len(config.config_hash(conf)) == 16
    (tmp_path / "d.yaml").write_text("- 1\n")
    with pytest.raises(ValueError, match="mapping"):
        config.load(str(tmp_path / "d.yaml"))
    one, two = (config.run_id("h", datetime(2026, 1, 2, 3, 4, 5, k, UTC)) for k in (1, 2))
    assert one.startswith("r_20260102_") and len(one) == 17 and one != two


def test_summary_source(spark, tmp_path):
    spec = {"kind": "hf_datasets_server", "dataset": "d", "n_items": 2, "n_systems": 2}
    with pytest.raises(FileNotFoundError, match="doesn't fetch"):
        config.items(spark, spec, str(tmp_path))
    config.pin(str(tmp_path), spec, _payload())
    rows = config.items(spark, spec, str(tmp_path)).collect()
    assert [(r.item_id, r.source, r.outputs) for r in rows] == [(i, f"text {i}", {"s_01": f"{i}-1", "s_03": f"{i}-3"}) for i in ("a", "b")]
    ladder = config.items(spark, spec | {"builder": "summeval_gap_ladder", "ladder_targets": [25, 77]}, str(tmp_path)).collect()
    assert set(ladder[0].outputs) == {"s_00", "s_02", "s_03"}
    with pytest.raises(ValueError, match="are needed"):
        config.items(spark, spec | {"n_items": 9}, str(tmp_path))
    with pytest.raises(ValueError, match="unknown builder"):
        config.items(spark, {"kind": "hf_datasets_server", "builder": "x"}, str(tmp_path))
    with pytest.raises(ValueError, match="ladder_targets"):
        config.items(spark, {"kind": "hf_datasets_server", "builder": "summeval_gap_ladder"}, str(tmp_path))


def test_answer_source(spark, tmp_path):
    spec = {"kind": "alpaca_eval_github", "systems": ["y", "x-1.5"], "n_items": 2, "max_chars": 3}
    answers = [{"instruction": f"ask {k}", "output": f"answer {k}"} for k in range(3)]
    config.pin(str(tmp_path), spec, {"x-1.5": answers, "y": answers[::-1]})
    rows = config.items(spark, spec, str(tmp_path)).collect()
    assert len(rows) == 2 and rows[0].item_id < rows[1].item_id and all(r.source == "ask" and r.outputs == {"y": "ans", "x-1.5": "ans"} for r in rows)
    assert config.chosen_systems({"candidate_systems": ["a", "b", "c"], "lc_win_rates": {"a": 1, "b": 5, "c": 5.5}, "n_systems": 2}) == ["b", "c"]
    for bad in ({"systems": ["a", "a"]}, {"systems": ["a"], "n_systems": 2}, {"candidate_systems": ["a"]}, {"candidate_systems": ["a", "b"], "lc_win_rates": {"a": 1}}):
        with pytest.raises(ValueError):
            config.chosen_systems(bad)
    with pytest.raises(ValueError, match="unknown kind"):
        config.items(spark, {"kind": "x"}, str(tmp_path))


def test_quarantine_is_kept_once(spark, tmp_path):
    shard = records.shard_path(str(tmp_path), "exp", "e")
    (tmp_path / "exp").mkdir()
    (tmp_path / "exp" / "e.jsonl").write_text(_record(0) + "\n" + '{"torn"')
    assert shard.endswith("exp/e.jsonl")
    folder = str(tmp_path / "exp")
    for _ in range(2):
        good, broken = records.read(spark, folder)
        assert good.count() == 1 and broken.count() == 1
        records.set_aside(broken, folder)
    assert (tmp_path / "exp" / "broken.quarantine.jsonl").read_text() == '{"raw_line":"{\\"torn\\""}\n'
    (tmp_path / "exp" / "e.jsonl").write_text(_record(0) + "\n" + '{"torn"' + "\n" + _record(1) + "\n")
    assert records.read(spark, folder)[0].count() == 2


def test_ledger_and_snapshots(spark, tmp_path):
    path = str(tmp_path / "ledger")
    inputs.append_ledger(spark.createDataFrame([("x", 2, 0.5)], "experiment string, calls long, cost_usd double"), path)
    inputs.append_ledger(spark.createDataFrame([("x", 1, 0.25)], "experiment string, calls long, cost_usd double"), path)
    assert sorted(r.cost_usd for r in inputs.ledger(spark, path).collect()) == [0.25, 0.5]
    with pytest.raises(ValueError, match="cost"):
        inputs.append_ledger(spark.createDataFrame([("x",)], "experiment string"), path)
    texts = spark.createDataFrame([("sha256:1", "one"), ("sha256:1", "one")], "digest string, text string")
    inputs.write_snapshots(texts, str(tmp_path / "snap"))
    assert inputs.read_snapshot(spark, str(tmp_path / "snap"), "sha256:1") == "one"
    with pytest.raises(KeyError):
        inputs.read_snapshot(spark, str(tmp_path / "snap"), "sha256:2")
    inputs.write_json(spark.range(1), str(tmp_path / "x.json"))
    assert config.read_json(str(tmp_path / "x.json")) == [{"id": 0}]


def test_cell_helpers(spark):
    df = spark.createDataFrame([("e", "s", "i1", 2), ("e", "s", "i1", 1), ("e", "t", "i2", None)], "env_id string, system_id string, item_id string, repeat_idx long")
    assert [r[0] for r in cells.distinct_values(df, "repeat_idx").collect()] == [1, 2] and cells.items_of(df).count() == 2
    assert cells.published(df.withColumn("experiment", F.lit("x")), ["y"]).count() == 0
    assert cells.numbers_of("0.1, 0.05,") == [0.1, 0.05]
    with pytest.raises(ValueError):
        cells.numbers_of(" ,")
    mixed = spark.createDataFrame([("b",), ("10",), ("9.5",), ("true",), (None,), ("false",), ("a",)], "v string")
    assert [r.v for r in mixed.orderBy(*cells.mixed_order(F.col("v"))).collect()] == [None, "false", "true", "9.5", "10", "a", "b"]


def test_display(spark):
    rows = [(0.0, 0.0, None, None), (0.04, 0.2, -0.1, 0.4), (0.04, 0.2, 0.01, 0.4), (0.0001, 0.01235, 0.00001, 0.4), (0.0, 0.0, 0.0, 0.3)]
    df = spark.createDataFrame(rows, "q double, o double, lo double, hi double")
    got = [r[0] for r in df.select(display.noise_floor(F.col("q"), F.col("o"), F.col("lo"), F.col("hi"), F.lit("likert5"))).collect()]
    assert got == ["noise floor: below detection at this scale", "noise floor: below detection at this scale (≤ 10.00 %p)", "noise floor ω = 5 %p", "noise floor ω = 0.309 %p", "noise floor: below detection at this scale (≤ 7.50 %p)"]
    wide = spark.createDataFrame([(0.0,), (12.345,), (0.0123456,), (99.96,)], "v double").select(display.three_digits(F.col("v")))
    assert [r[0] for r in wide.collect()] == ["0", "12.3", "0.0123", "100"]
    captions = spark.createDataFrame([(1.0,), (3.0,)], "g double").select(display.decay_caption(F.col("g"), "paraphrase_id")).collect()
    assert captions[0][0] == display.INTRINSIC and captions[1][0] == "Procedural axis included: 3.0 prompt-paraphrase groups per cell enter the floor estimate."
    assert display.stopping_title(7, [True, False, False]) == "Seed 7: 2 of 3 accepted promotions sit inside the noise band"
    assert spark.range(1).select(display.sigma_reference(F.lit(-1.0)), display.sigma_reference(F.lit(4.0))).first()[:] == (0.0, 2.0)


def test_command_line(spark, tmp_path, capsys):
    store = tmp_path / "store"
    store.mkdir()
    (store / "e.jsonl").write_text("".join(_record(k % 6, item_id=f"i{k // 12}", system_id="ab"[k // 6 % 2], parsed_score=float(1 + (k * 7) % 5)) + "\n" for k in range(36)))
    assert line.main(["validate", "--store", str(store)], spark) == 0
    assert "36 records, 0 broken" in capsys.readouterr().out
    line.main(["analyze", "variance", "--store", str(store), "--out", str(tmp_path / "out"), "--resamples", "5"], spark)
    assert spark.read.parquet(str(tmp_path / "out" / "variance" / "envs")).count() == 1
    line.main(["analyze", "mdi-table", "--store", str(store), "--out", str(tmp_path / "out"), "--resamples", "3", "--sweep", "1,2", "--alphas", "0.05"], spark)
    assert spark.read.parquet(str(tmp_path / "out" / "mdi-table" / "null_entries")).count() == 2
    (tmp_path / "items.jsonl").write_text("".join(json.dumps({"item_id": f"i{k}", "source": "s", "outputs": {"a": "x", "b": "y"}}) + "\n" for k in range(3)))
    (tmp_path / "c.yaml").write_text(f"grid:\n  scale: [likert5, likert10]\nrepeats:\n  n: 5\n  max_attempts_factor: 2\ninputs:\n  kind: jsonl\n  path: {tmp_path}/items.jsonl\n  n_items: 2\n")
    line.main(["calls", "--config", str(tmp_path / "c.yaml"), "--inputs", str(tmp_path)], spark)
    assert "40 to 80 calls" in capsys.readouterr().out
    (tmp_path / "ledger.jsonl").write_text('{"experiment": "x", "calls": 2, "cost_usd": 0.5}\n')
    line.main(["ledger", "--ledger", str(tmp_path / "ledger.jsonl")], spark)
    assert capsys.readouterr().out == "x\t1\t2\t0.5\n"
    with pytest.raises(SystemExit):
        line.main(["analyze", "oracle", "--store", str(store), "--out", "x"], spark)


def test_input_digest_by_rows_alone(spark):
    rows = [("e", f"i{k % 7}", "s", k, None if k == 3 else k / 4) for k in range(50)]
    shape = "env_id string, item_id string, system_id string, repeat_idx long, score double"
    one = scalars.input_digest(spark.createDataFrame(rows, shape).repartition(7))
    assert one == scalars.input_digest(spark.createDataFrame(rows[::-1], shape).coalesce(1)) and one.startswith("sha256:")
    assert len({one, *(scalars.input_digest(spark.createDataFrame(x, shape)) for x in (rows[1:], rows + rows[:1], [("e", "i0", "s", 0, 9.0), *rows[1:]], []))}) == 5
