"""Whole analyses over small stores."""

from __future__ import annotations

import hashlib
from itertools import pairwise

import pytest
from pyspark.sql import functions as F
from tremorscope import errors
from tremorscope.operators import external, fip, null, reports


def _noise(*key: object) -> int:
    return int(hashlib.sha256("|".join(map(str, key)).encode()).hexdigest()[:8], 16)


@pytest.fixture(scope="module")
def store(spark):
    rows = []
    for env, scale, step in (("e1", "likert10", 1), ("e2", "score100", 10)):
        for i in range(6):
            for s in range(4):
                for r in range(9):
                    rows.append((env, scale, f"i{i}", f"s_{s:02d}", r, f"p{r % 3}", float(step * (2 + s // 2 * 4 + _noise(env, i, s, r) % 3))))
    return spark.createDataFrame(rows, "env_id string, scale string, item_id string, system_id string, repeat_idx long, paraphrase_id string, score double").persist()


@pytest.fixture(scope="module")
def annotated(spark):
    rows = [(f"i{i}", f"s_{s:02d}", facet, 1.0 + s // 2 * 3 + _noise(i, s, facet) % 2 * 0.25) for i in range(6) for s in range(4) for facet in ("fluency", "relevance")]
    return spark.createDataFrame(rows, "item_id string, system_id string, facet string, value double")


def test_mdi_table(store):
    out = reports.analyze("mdi-table", store, sweep=(1, 2, 4), draws_per_pair=20, draws_per_system=30, resamples=30, least=1)
    rows = out["null_entries"].collect()
    assert len(rows) == 2 * 3 * 3 and len({(r.env_id, r.n_repeats, r.alpha) for r in rows}) == 18
    for r in rows:
        assert r.ci_lo <= r.ci_hi and r.n_systems == 4
        assert r.mdi_null_smoothed_pp == pytest.approx(r.mdi_null_smoothed / (9 if r.scale == "likert10" else 100) * 100)
    by = {(r.env_id, r.alpha, r.n_repeats): r.mdi_null_smoothed for r in rows}
    assert all(by[e, a, m] >= by[e, a, n] for e in ("e1", "e2") for a in (0.1, 0.05, 0.01) for m, n in pairwise((1, 2, 4)))
    assert out["consistency"].count() == 18 and out["entries"].count() == 18
    needed = {(r.env_id, r.target_pp): r.recommended_n for r in out["reverse_entries"].collect()}
    pp = {(r.env_id, r.n_repeats): r.mdi_null_smoothed_pp for r in rows if r.alpha == 0.05}
    for (env, target), n in needed.items():
        fits = [k for k in (1, 2, 4) if pp[env, k] <= target]
        assert n == (min(fits) if fits else None)
    assert out["reverse_entries_at_power"].count() == len(needed) == 8


def test_null_interval_by_brute_force(spark, store):
    drawn = null.draws(store, range(1, 9), sweep=(2,), draws_per_system=12)
    deltas: dict = {}
    for r in drawn.collect():
        deltas.setdefault(r.env_id, {}).setdefault(r.system_id, []).append(r.delta)

    def quantile(values, q):
        at = q * (len(values) - 1)
        low = int(at)
        return values[low] + (at - low) * (values[min(low + 1, len(values) - 1)] - values[low])

    got = {r.env_id: (r.ci_lo, r.ci_hi) for r in null.intervals(drawn, alphas=(0.1,), seed=5, resamples=25).collect()}
    for env, by in deltas.items():
        names, widths = sorted(by), []
        for b in range(25):
            picks = [int(hashlib.md5(f"null_boot|5|{env}|2|{b}|{k}".encode()).hexdigest()[:8], 16) % len(names) for k in range(len(names))]
            pool = sorted(d for p in picks for d in by[names[p]])
            widths.append((quantile(pool, 0.95) - quantile(pool, 0.05)) / 2)
        assert got[env] == pytest.approx((quantile(sorted(widths), 0.025), quantile(sorted(widths), 0.975)))
    one = null.intervals(drawn.where("system_id = 's_00'"), alphas=(0.1,), resamples=5).collect()
    assert len(one) == 2 and all(r.ci_lo is None and r.ci_hi is None for r in one)


def test_flip_intervals_by_brute_force(store):
    drawn = fip.draws(store, range(1, 9), sweep=(1,), draws_per_pair=10)
    bins = {(r.env_id, r.bin): r for r in fip.curve(drawn, store, range(1, 9)).collect()}
    per: dict = {}
    for r in drawn.collect():
        lows = [b.lo for (e, _), b in sorted(bins.items()) if e == r.env_id]
        k = max(i for i, low in enumerate(lows) if r.delta >= low)
        pair = per.setdefault(r.env_id, {}).setdefault((r.system_a, r.system_b), {})
        n, x = pair.get(k, (0, 0))
        pair[k] = (n + 1, x + r.reversed)

    def quantile(values, q):
        at = q * (len(values) - 1)
        low = int(at)
        return values[low] + (at - low) * (values[min(low + 1, len(values) - 1)] - values[low])

    got = {(r.env_id, r.bin): (r.ci_lo, r.ci_hi) for r in fip.curve_intervals(drawn, store, range(1, 9), seed=3, resamples=20).collect()}
    checked = 0
    for env, by in per.items():
        names, rates = sorted(by), {}
        for b in range(20):
            picks = [int(hashlib.md5(f"fip_boot|3|{env}|1|{b}|{k}".encode()).hexdigest()[:8], 16) % len(names) for k in range(len(names))]
            for k in range(5):
                n, x = (sum(by[names[p]].get(k, (0, 0))[j] for p in picks) for j in (0, 1))
                if n:
                    rates.setdefault(k, []).append(x / n)
        for k, values in rates.items():
            checked += 1
            assert got[env, k] == pytest.approx((quantile(sorted(values), 0.025), quantile(sorted(values), 0.975)))
    assert checked > 2


def test_external_report(spark, store, annotated):
    limits = spark.createDataFrame([("e1", 2, 0.5), ("e2", 2, 5.0)], "env_id string, n_repeats int, threshold double")
    out = reports.analyze("oracle", store, annotations=annotated, thresholds=limits, draws=20, resamples=40)
    gaps = {(r.env_id, r.system_a, r.system_b): r for r in out["gaps"].collect()}
    assert len(gaps) == 12 and gaps["e1", "s_00", "s_02"].separated and not gaps["e1", "s_00", "s_01"].oracle_gap_pp > 20
    assert gaps["e2", "s_00", "s_02"].judge_gap_pp == pytest.approx(-40, abs=12)
    ranks = {(r.env_id, r.system_id): r for r in out["systems"].collect()}
    assert ranks["e1", "s_00"].judge_rank >= 3 and ranks["e1", "s_03"].oracle_rank <= 2
    assert {r.env_id for r in out["claim_rates"].collect()} <= {"e1", "e2"} and all(0 <= r.internal_rate <= 1 for r in out["claim_rates"].collect())
    assert out["detection"].count() == 12 and out["detection_summary"].count() == 4
    assert out["facets"].count() == 24 and out["facet_concordance"].count() == 4
    assert out["bias"].count() == out["concordance"].count() == 2
    single = reports.analyze("oracle", store, annotations=annotated.where("facet = 'fluency'"), thresholds=limits, draws=5, resamples=5)
    assert "facets" not in single
    with pytest.raises(ValueError, match="no annotation"):
        reports.analyze("oracle", store, annotations=annotated.where("item_id <> 'i0'"), thresholds=limits)


def test_other_analyses(store):
    out = reports.analyze("variance", store, envs=["e1"], resamples=10)
    assert out["envs"].count() == 1 and out["systems"].count() == 4 and out["sigma"].count() == 1
    bins = reports.analyze("fip", store, sweep=(1,), draws=5, resamples=5)["bins"]
    assert {"ci_lo", "ci_hi", "fip"} <= set(bins.columns) and bins.count() == 10
    fits = reports.analyze("decay", store, sweep=(1, 2), draws=10, resamples=5)
    assert fits["fits"].count() == 2 and fits["labels"].count() >= 1


def test_guards(spark, store):
    with pytest.raises(errors.AnalysisError, match="unknown analysis"):
        reports.analyze("kappa", store)
    with pytest.raises(errors.UnknownEnvironmentError):
        reports.analyze("variance", store, envs=["e9"])
    with pytest.raises(errors.OverlappingRepeatsError):
        reports.analyze("fip", store, screening=[0], estimation=[0, 1, 2])
    with pytest.raises(Exception, match="several scales"):
        reports.scales(store.withColumn("env_id", F.lit("e"))).collect()
    assert external.facet_means(spark.createDataFrame([], "item_id string, system_id string, facet string, value double")).count() == 0
