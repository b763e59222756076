"""The draws of both paths, made in arrays, against plain Python."""

from __future__ import annotations

import numpy as np
import pytest
from test_resamples import u32
from tremorscope.operators import fip, null

SCORES = {(f"i{k}", s): np.random.default_rng(k + 10 * j).integers(1, 6, 4 + (k + j) % 3).astype(float).tolist() for k in range(4) for j, s in enumerate(("a", "b", "c"))}


@pytest.fixture
def records(spark):
    return spark.createDataFrame([("e", i, s, k, v) for (i, s), own in SCORES.items() for k, v in enumerate(own)], "env_id string, item_id string, system_id string, repeat_idx long, score double")


def made_rows_of_draws(df):
    return "explode(sequence(0" in df._jdf.queryExecution().optimizedPlan().toString()


def halves(scores, key, tags, n):
    order = [scores[k] for k in sorted(range(len(scores)), key=lambda k: (u32(*key, k), k))]
    half = len(order) // 2
    return [sum(pool[u32(*key, *tag, j) % len(pool)] for j in range(1, n + 1)) for pool, tag in zip((order[:half], order[half:]), tags, strict=True)]


def test_pairs_draws_make_no_row_for_a_draw(spark, records):
    out = fip.draws(records, range(9), sweep=(1, 3), draws_per_pair=12)
    assert not made_rows_of_draws(out)
    want = {}
    for n in (1, 3):
        for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
            for d in range(12):
                obs = re = 0.0
                for i in sorted({i for i, _ in SCORES}):
                    key = ("fip", 20260731, "e", n, f"{a}~{b}", d, i)
                    for s, side, sign in ((a, "a", 1), (b, "b", -1)):
                        x, y = halves(SCORES[i, s], (*key, side), [("obs",), ("re",)], n)
                        obs, re = obs + sign * x, re + sign * y
                if obs:
                    want[n, a, b, d] = (abs(obs) / (4 * n), (re if obs > 0 else -re) <= 0)
    assert {(r.n_repeats, r.system_a, r.system_b, r.draw): (r.delta, r.reversed) for r in out.collect()} == want


def test_null_draws_make_no_row_for_a_draw(spark, records):
    out = null.draws(records, range(9), sweep=(1, 3), draws_per_system=12)
    assert not made_rows_of_draws(out)
    want = {}
    for n in (1, 3):
        for s in ("a", "b", "c"):
            for d in range(12):
                parts = [halves(SCORES[i, s], ("null", 20260731, "e", n, s, d, i), [("a",), ("b",)], n) for i in sorted({i for i, _ in SCORES})]
                want[n, s, d] = pytest.approx(sum(x - y for x, y in parts) / (4 * n))
    assert {(r.n_repeats, r.system_id, r.draw): r.delta for r in out.collect()} == want
