"""The array-wise random source and the resamples and draws made with it, against plain Python."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tremorscope.functions import draws, rng
from tremorscope.operators import decay, external, resample


def u32(*key):
    return int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:8], 16)


def made_rows_of_picks(df):
    """Whether a plan makes a row for each pick of a resample: 100 and more for each cluster."""
    return "slot#" in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("size", [1, 3, 4, 5, 39, 40, 41, 52, 55, 60])
def test_numbers_equal_the_keyed_source(size):
    heads = np.random.default_rng(size).integers(33, 127, (7, size)).astype(np.uint8)
    own = draws.Heads(heads)
    for tail in ("", "a", "|a|12", "|obs|10"):
        assert own.u32(tail.encode()).tolist() == [u32(row.tobytes().decode() + tail) for row in heads]
    head = "é" + "x" * size + "|"
    for low, high in ((0, 120), (9_995, 10_005), (99_990, 100_020)):
        assert draws.counted(head.encode(), low, high).tolist() == [u32(f"{head}{k}") for k in range(low, high)]


def test_numbers_equal_those_of_expressions(spark):
    got = [r[0] for r in spark.range(300).select(rng.u32("p", 7, "e", 12, F.col("id"))).collect()]
    assert draws.counted(b"p|7|e|12|", 0, 300).tolist() == got


def interval_of(values, level=0.95):
    return np.percentile(values, [100 * (1 - level) / 2, 100 * (1 + level) / 2]).tolist()


def test_gap_intervals_make_no_row_for_a_pick(spark):
    rng_ = np.random.default_rng(4)
    rows = [(f, f"i{k:03d}", float(rng_.normal(3))) for f in ("x", "y") for k in range(150) if (f, k) not in {("y", 3), ("y", 77)}]
    diffs = spark.createDataFrame([("e", f, i, "s_0", "s_1", d) for f, i, d in rows], "env_id string, facet string, item_id string, system_a string, system_b string, d double")
    out = external.gap_intervals(diffs, ["facet"], resamples=30)
    assert not made_rows_of_picks(out)
    items = sorted({i for _, i, _ in rows})
    by = {(f, i): d for f, i, d in rows}
    want = {"x": [], "y": []}
    for replicate in range(30):
        picks = [items[u32("gap_boot", 20260731, "e|s_0|s_1", replicate, slot) % len(items)] for slot in range(len(items))]
        for f in want:
            want[f].append(np.mean([by[f, i] for i in picks if (f, i) in by]))
    got = {r.facet: [r.oracle_ci_lo_pp, r.oracle_ci_hi_pp] for r in out.collect()}
    assert set(got) == set(want)
    for f in want:
        assert got[f] == pytest.approx(interval_of(want[f]))


def test_weighted_sums_of_nulls(spark):
    rows = spark.createDataFrame([("e", 0, 1.0, None), ("e", 1, float("inf"), None), ("f", 0, None, 2.0), ("f", 1, 5.0, 3.0)], "g string, place int, x double, y double")
    got = {(r.g, r.replicate): r for r in resample.weighted_sums(rows, ["g"], ["x", "y"], "p", seed=1, resamples=9).collect()}
    assert len(got) == 18
    values = {"e": ([1.0, float("inf")], [None, None]), "f": ([None, 5.0], [2.0, 3.0])}
    for (g, replicate), r in got.items():
        picks = [u32("p", 1, g, replicate, slot) % 2 for slot in range(2)]
        want = [[v[k] for k in picks if v[k] is not None] for v in values[g]]
        assert r.times == 2 and [r.x, r.y] == [sum(w) if w else None for w in want]


def test_omega_interval_makes_no_row_for_a_pick(spark):
    rng_ = np.random.default_rng(6)
    rows = [("e", f"i{k:02d}", s, n, float(rng_.random())) for k in range(60) for s in ("a", "b") for n in (1, 2, 4)]
    out = decay.omega_interval(spark.createDataFrame(rows, "env_id string, item_id string, system_id string, n_repeats int, variance double"), resamples=20)
    assert not made_rows_of_picks(out)
    by = {}
    for _, i, s, n, v in rows:
        by.setdefault((i, s), {})[n] = v
    cells, floors = sorted(by), []
    for replicate in range(20):
        picks = [by[cells[u32("omega_boot", 20260731, "e", replicate, slot) % len(cells)]] for slot in range(len(cells))]
        floors.append(max(np.polyfit([1 / n for n in (1, 2, 4)], [np.mean([p[n] for p in picks]) for n in (1, 2, 4)], 1)[1], 0.0))
    row = out.first()
    assert [row.ci_lo, row.ci_hi] == pytest.approx(interval_of(floors)) and row.n_effective == 20


def test_decay_draws_equal_plain_draws(spark):
    rng_ = np.random.default_rng(8)
    cells = {(f"i{k}" + "x" * (30 * (k % 3)), s): [rng_.integers(1, 6, m).astype(float).tolist() for m in (2, 3 + k % 2)] for k in range(6) for s in ("a", "b")}
    rows = [("e", i, s, 100 * g + j, f"pp_{g}", v) for (i, s), groups in cells.items() for g, scores in enumerate(groups) for j, v in enumerate(scores)]
    records = spark.createDataFrame(rows, "env_id string, item_id string, system_id string, repeat_idx long, paraphrase_id string, score double")
    got = {(r.item_id, r.system_id, r.n_repeats): r.variance for r in decay.draw_variances(decay.grouped(records), sweep=(1, 2, 4, 9), draws=12).collect()}
    want = {}
    for (i, s), groups in cells.items():
        for n in (1, 2, 4):
            means = []
            for d in range(12):
                own = groups[u32("decay", 20260731, "e", n, i, s, d, "group") % len(groups)]
                means.append(sum(own[u32("decay", 20260731, "e", n, i, s, d, j) % len(own)] for j in range(1, n + 1)) / n)
            want[i, s, n] = float(np.var(means))
    assert set(got) == set(want) and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_item_interval_makes_no_row_for_a_pick(spark):
    rng_ = np.random.default_rng(10)
    rows = [("e", f"i{k:02d}", s, f"pp_{g}", float(rng_.random())) for k in range(50) for s in ("a", "b", "c") for g in range(3)]
    means = spark.createDataFrame(rows, "env_id string, item_id string, system_id string, label string, mean double")
    out = decay.item_interval(means, resamples=20)
    assert not made_rows_of_picks(out)
    items = sorted(decay.item_parts(decay.usable(means)).collect(), key=lambda r: r.item_id)
    main, inner = [], []
    for replicate in range(20):
        picks = [items[u32("item_boot", 20260731, "e", replicate, slot) % len(items)] for slot in range(len(items))]
        main.append(np.mean([p.main for p in picks]))
        inner.append(sum(p.rest for p in picks) / sum(p.n for p in picks))
    row = out.first()
    assert [row.omega_sq_main_lo, row.omega_sq_main_hi] == pytest.approx(interval_of(main))
    assert [row.omega_sq_int_lo, row.omega_sq_int_hi] == pytest.approx(interval_of(inner))


def test_sigma_interval_makes_no_row_for_a_pick(spark):
    rng_ = np.random.default_rng(12)
    scores = {(f"i{k:02d}", s): rng_.integers(1, 6, 2 + k % 3).astype(float) for k in range(40) for s in ("a", "b")}
    records = spark.createDataFrame([("e", i, s, k, float(v)) for (i, s), own in scores.items() for k, v in enumerate(own)], "env_id string, item_id string, system_id string, repeat_idx long, score double")
    out = resample.sigma_interval(records, resamples=20)
    assert not made_rows_of_picks(out)
    items, sigmas = sorted({i for i, _ in scores}), []
    for replicate in range(20):
        picks = [items[u32("sigma_boot", 20260731, "e", replicate, slot) % len(items)] for slot in range(len(items))]
        own = [scores[i, s] for i in picks for s in ("a", "b")]
        sigmas.append(np.sqrt(sum(len(x) * np.var(x) for x in own) / sum(len(x) - 1 for x in own)))
    row = out.first()
    assert [row.ci_lo, row.ci_hi] == pytest.approx(interval_of(sigmas)) and row.n_items == 40
