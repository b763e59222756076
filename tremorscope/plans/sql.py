"""The registered queries in SQL, written for themselves against the same tables."""

from __future__ import annotations

from .views import ANNOTATIONS, ANSWERS, LEDGER, LINES, RECORDS, RESPONSES, SIGNAL

SEED, DRAWS, BOOTS = 20260731, 40, 100
EST = "repeat_idx BETWEEN 1 AND 19"


def r6(x: str, name: str = "", digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name or x}"


def u32(*key: str) -> str:
    """Random bits of a key: the counter source in SQL."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(key)})), 1, 8) AS BIGINT)"


def cells(view: str) -> str:
    return f"cells AS (SELECT env_id, item_id, system_id, count(*) AS n, array_agg(score ORDER BY repeat_idx) AS scores FROM {view} WHERE {EST} GROUP BY ALL)"


def order(scores: str, *key: str) -> str:
    """The scores shuffled by their keys' bits."""
    bits = u32(*key, "CAST(i - 1 AS VARCHAR)")
    return f"list_transform(list_sort(list_transform(range(1, len({scores}) + 1), lambda i: {{'u': {bits}, 'i': i}})), lambda x: {scores}[x.i])"


def drawn(pool: str, n: str, *key: str) -> str:
    return f"list_sum(list_transform(range(1, {n} + 1), lambda j: {pool}[1 + {u32(*key, 'CAST(j AS VARCHAR)')} % len({pool})]))"


MOMENTS = "m AS (SELECT env_id, item_id, system_id, count(score) AS n, sum(score) AS s, sum(score * score) AS q FROM score_records GROUP BY ALL)"


def pooled(keys: str) -> str:
    return f"""WITH {RECORDS}, {MOMENTS}, p AS (
  SELECT {keys}, sum(CASE WHEN n > 1 THEN greatest(q - s * s / n, 0) END) / nullif(sum(CASE WHEN n > 1 THEN n - 1 END), 0) AS variance, count(*) AS n_cells, CAST(sum(n) AS BIGINT) AS n_scores, sum(s) / sum(n) AS mean_score
  FROM m GROUP BY {keys})
SELECT {keys}, {r6('variance')}, {r6('sqrt(variance)', 'sigma')}, n_cells, n_scores, {r6('mean_score')} FROM p"""


FLIPS = """flips AS (
  SELECT env_id, item_id, system_id, CAST(sum(c) AS BIGINT) AS n, 1 - sum(c * (c - 1)) / (sum(c) * (sum(c) - 1)) AS flip_rate
  FROM (SELECT env_id, item_id, system_id, score, count(*) AS c FROM score_records GROUP BY ALL) GROUP BY ALL HAVING sum(c) > 1)"""

#: Agreement by its definition, from pairs of repeats.
ALPHA_UNITS = """units AS (SELECT * FROM (SELECT env_id, item_id, system_id, repeat_idx, score, count(*) OVER (PARTITION BY env_id, item_id, system_id) AS m FROM score_records) WHERE m > 1),
pool AS (SELECT env_id, score, count(*) AS c, sum(count(*)) OVER (PARTITION BY env_id ORDER BY score) AS up FROM units GROUP BY env_id, score),
total AS (SELECT env_id, CAST(sum(c) AS BIGINT) AS n FROM pool GROUP BY env_id)"""


def alpha(level: str) -> str:
    gap = {"interval": "(a.score - b.score) * (a.score - b.score)", "nominal": "CASE WHEN a.score <> b.score THEN 1.0 ELSE 0.0 END", "ordinal": "g.gap"}[level]
    join = "JOIN gaps g ON g.env_id = a.env_id AND g.v = a.score AND g.w = b.score" if level == "ordinal" else ""
    gaps = ", gaps AS (SELECT a.env_id, a.score AS v, b.score AS w, (greatest(a.up, b.up) - least(a.up, b.up) + CASE WHEN a.score <= b.score THEN a.c ELSE b.c END - (a.c + b.c) / 2.0) ^ 2 AS gap FROM pool a JOIN pool b ON a.env_id = b.env_id)" if level == "ordinal" else ""
    return f"""WITH {RECORDS}, {ALPHA_UNITS}{gaps},
seen AS (SELECT a.env_id, sum({gap} / (a.m - 1)) AS o FROM units a JOIN units b ON a.env_id = b.env_id AND a.item_id = b.item_id AND a.system_id = b.system_id {join} GROUP BY a.env_id),
due AS (SELECT a.env_id, sum(a.c * b.c * {gap}) AS e FROM pool a JOIN pool b ON a.env_id = b.env_id {join} GROUP BY a.env_id)
SELECT env_id, {r6('1 - (o / n) / nullif(e / (n * (n - 1)), 0)', 'alpha')}, n AS n_values FROM total JOIN seen USING (env_id) JOIN due USING (env_id)"""


JUDGE = f"judge AS (SELECT env_id, item_id, system_id, avg(score) AS mean_score FROM signal_records WHERE {EST} GROUP BY ALL), reference AS (SELECT item_id, system_id, avg(value) AS value FROM annotations GROUP BY ALL)"
EXTERNAL = f"WITH {SIGNAL}, {ANNOTATIONS}, {JUDGE}"


def diffs(source: str = "reference", facet: str = "") -> str:
    extra = f"{facet}, " if facet else ""
    return f"""both_ AS (SELECT * FROM judge JOIN {source} USING (item_id, system_id)),
diffs AS (SELECT a.env_id, a.item_id, {'a.' + extra if facet else ''}a.system_id AS system_a, b.system_id AS system_b, (a.value - b.value) / 4 * 100 AS d, a.mean_score - b.mean_score AS j
  FROM both_ a JOIN both_ b ON a.env_id = b.env_id AND a.item_id = b.item_id AND a.system_id < b.system_id {'AND a.' + facet + ' = b.' + facet if facet else ''}),
gaps AS (SELECT env_id, {extra}system_a, system_b, count(*) AS n_items, avg(d) AS oracle_gap_pp, CASE WHEN stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) END AS oracle_t, avg(j) / 4 * 100 AS judge_gap_pp, avg(j) / 4 * 100 - avg(d) AS residual_pp FROM diffs GROUP BY ALL)"""


GAP_COLUMNS = f"n_items, {r6('oracle_gap_pp')}, {r6('oracle_t')}, {r6('judge_gap_pp')}, {r6('residual_pp')}"
SYSTEM_MEANS = f"WITH {LINES}, {ANNOTATIONS}, reference AS (SELECT item_id, system_id, avg(value) AS value FROM annotations GROUP BY ALL), means AS (SELECT system_id, avg(value) AS mean FROM reference GROUP BY ALL), pairs AS (SELECT a.system_id AS system_a, b.system_id AS system_b, abs(a.mean - b.mean) AS gap FROM means a JOIN means b ON a.system_id < b.system_id)"

#: P(X <= k) of a fair binomial for n up to 100 by Pascal's triangle in doubles.
BINOMIAL = """RECURSIVE tri AS (
  SELECT 0 AS n, [1.0::DOUBLE] AS row UNION ALL
  SELECT n + 1, list_transform(range(1, n + 3), lambda i: (coalesce(row[i], 0) + CASE WHEN i > 1 THEN row[i - 1] ELSE 0 END) / 2) FROM tri WHERE n < 100
)"""
TESTED = f"""WITH {BINOMIAL}, {ANSWERS}, tested AS (
  SELECT c1.*, CASE WHEN b + c = 0 THEN 1.0 ELSE list_sum(row[1:CAST(least(b, c) AS INTEGER) + 1]) END AS reversal FROM counts c1 JOIN tri ON n = b + c
), report AS (
  SELECT seed, promo_idx, b, c, n_questions, baseline_accuracy, (b - c) / n_questions AS confirm_delta, least(1.0, 2 * reversal) AS mcnemar_p, reversal AS reversal_prob, reversal <= 0.05 AS clears FROM tested
), halted AS (SELECT *, coalesce(promo_idx = max(promo_idx) FILTER (WHERE clears) OVER (PARTITION BY seed), FALSE) AS would_halt FROM report)"""

GROUPS = """gm AS (SELECT env_id, item_id, system_id, paraphrase_id AS label, avg(score) AS mean, array_agg(score ORDER BY repeat_idx) AS scores FROM signal_records GROUP BY ALL HAVING count(*) >= 2),
u1 AS (SELECT *, count(*) OVER (PARTITION BY env_id, item_id, system_id) AS nl FROM gm),
u2 AS (SELECT * FROM u1 WHERE nl >= 2),
u3 AS (SELECT u2.*, s.systems, count(*) OVER (PARTITION BY u2.env_id, u2.item_id, label) AS seen FROM u2 JOIN (SELECT env_id, item_id, count(DISTINCT system_id) AS systems FROM u2 GROUP BY ALL) s ON s.env_id = u2.env_id AND s.item_id = u2.item_id WHERE s.systems >= 2),
u4 AS (SELECT *, count(*) OVER (PARTITION BY env_id, item_id, system_id) AS k FROM u3 WHERE seen = systems),
usable AS (SELECT env_id, item_id, system_id, label, mean FROM u4 WHERE k >= 2),
shared AS (SELECT u.* FROM usable u JOIN (SELECT env_id, label FROM (SELECT env_id, label, count(DISTINCT item_id) AS i FROM usable GROUP BY ALL) JOIN (SELECT env_id, count(DISTINCT item_id) AS a FROM usable GROUP BY ALL) USING (env_id) WHERE i = a) l USING (env_id, label))"""


def parts(source: str, extra: str = "") -> str:
    """Shared and own parts with label weights ``w``."""
    e = f"{extra}, " if extra else ""
    return f"""d1 AS (SELECT *, mean - sum(w * mean) OVER (PARTITION BY env_id, {e}item_id, system_id) / sum(w) OVER (PARTITION BY env_id, {e}item_id, system_id) AS dev FROM {source}),
d2 AS (SELECT *, avg(dev) OVER (PARTITION BY env_id, {e}item_id, label) AS alpha FROM d1),
d3 AS (SELECT env_id, {e}item_id, system_id, sum(w * alpha * alpha) / sum(w) - (sum(w * alpha) / sum(w)) ^ 2 AS main, sum(w * (dev - alpha) ^ 2) / sum(w) - (sum(w * (dev - alpha)) / sum(w)) ^ 2 AS rest FROM d2 GROUP BY ALL),
d4 AS (SELECT env_id, {e}item_id, any_value(main) AS main, sum(rest) AS rest, count(*) AS n FROM d3 GROUP BY ALL),
split AS (SELECT env_id, {e}avg(main) AS omega_sq_main, sum(rest) / sum(n) AS omega_sq_int, avg(main) + sum(rest) / sum(n) AS omega_sq_between FROM d4 GROUP BY ALL)"""


def boots(purpose: str, group: str, placed: str) -> str:
    """Multiplicities of a bootstrap over ``placed`` (group columns, place)."""
    return f"""sizes AS (SELECT {group} AS g, count(*) AS size FROM {placed} GROUP BY ALL),
picks AS (SELECT g, replicate, {u32(f"'{purpose}'", f"'{SEED}'", 'CAST(g AS VARCHAR)', 'CAST(replicate AS VARCHAR)', 'CAST(slot AS VARCHAR)')} % size AS place
  FROM sizes, range({BOOTS}) t(replicate), LATERAL (SELECT unnest(range(size)) AS slot)),
weights AS (SELECT g, replicate, place, count(*) AS times FROM picks GROUP BY ALL)"""


VARIANCES = f"""{GROUPS.split(',' + chr(10) + 'u1')[0]},
cl AS (SELECT env_id, item_id, system_id, array_agg(scores ORDER BY label) AS labels FROM gm GROUP BY ALL),
cn AS (SELECT cl.*, nn AS n_repeats FROM cl JOIN (SELECT env_id, max(len(scores)) AS most FROM gm GROUP BY ALL) USING (env_id), (VALUES (1), (2), (4)) t(nn) WHERE nn <= most),
pk AS (SELECT env_id, item_id, system_id, n_repeats, draw, labels[1 + {u32("'decay'", f"'{SEED}'", 'env_id', 'CAST(n_repeats AS VARCHAR)', 'item_id', 'system_id', 'CAST(draw AS VARCHAR)', "'group'")} % len(labels)] AS own FROM cn, range({DRAWS}) t(draw)),
dm AS (SELECT env_id, item_id, system_id, n_repeats, {drawn('own', 'n_repeats', "'decay'", f"'{SEED}'", 'env_id', 'CAST(n_repeats AS VARCHAR)', 'item_id', 'system_id', 'CAST(draw AS VARCHAR)')} / n_repeats AS mean FROM pk),
variances AS (SELECT env_id, item_id, system_id, n_repeats, var_pop(mean) AS variance FROM dm GROUP BY ALL),
points AS (SELECT env_id, n_repeats, avg(variance) AS v, count(*) AS n_cells FROM variances GROUP BY ALL)"""

FIP_KEY = ("'fip'", f"'{SEED}'", "env_id", "CAST(n_repeats AS VARCHAR)", "system_a || '~' || system_b", "CAST(draw AS VARCHAR)", "item_id")
HALF = "[:CAST(floor(len({0}) / 2) AS BIGINT)]"
REST = "[CAST(floor(len({0}) / 2) AS BIGINT) + 1:]"
SIGMA_EST = "sig AS (SELECT env_id, sqrt(sum(greatest(q - s * s / n, 0)) / sum(n - 1)) AS sigma FROM (SELECT env_id, item_id, system_id, count(*) AS n, sum(score) AS s, sum(score * score) AS q FROM {0} WHERE " + EST + " GROUP BY ALL) WHERE n > 1 GROUP BY ALL)"
FIP = f"""WITH {SIGNAL}, {cells('signal_records')}, {SIGMA_EST.format('signal_records')},
rows_ AS (SELECT a.env_id, a.item_id, a.system_id AS system_a, b.system_id AS system_b, a.scores AS sa, b.scores AS sb, n_repeats, draw
  FROM cells a JOIN cells b ON a.env_id = b.env_id AND a.item_id = b.item_id AND a.system_id < b.system_id AND a.n >= 2 AND b.n >= 2, (VALUES (1), (3)) t(n_repeats), range({DRAWS}) d(draw)),
ordered_ AS (SELECT *, {order('sa', *FIP_KEY, "'a'")} AS oa, {order('sb', *FIP_KEY, "'b'")} AS ob FROM rows_),
pools AS (SELECT *, oa{HALF.format('oa')} AS a1, oa{REST.format('oa')} AS a2, ob{HALF.format('ob')} AS b1, ob{REST.format('ob')} AS b2 FROM ordered_),
summed AS (SELECT env_id, n_repeats, system_a, system_b, draw, sum({drawn('a1', 'n_repeats', *FIP_KEY, "'a'", "'obs'")} - {drawn('b1', 'n_repeats', *FIP_KEY, "'b'", "'obs'")}) AS obs,
  sum({drawn('a2', 'n_repeats', *FIP_KEY, "'a'", "'re'")} - {drawn('b2', 'n_repeats', *FIP_KEY, "'b'", "'re'")}) AS re, count(*) AS items FROM pools GROUP BY ALL),
fd AS (SELECT env_id, n_repeats, abs(obs) / (n_repeats * items) AS delta, (CASE WHEN obs > 0 THEN re ELSE -re END) <= 0 AS reversed FROM summed WHERE obs <> 0),
edges AS (SELECT * FROM (VALUES (0, 0.0, 0.1), (1, 0.1, 0.2), (2, 0.2, 0.4), (3, 0.4, 0.6), (4, 0.6, 0.8), (5, 0.8, NULL)) t(bin, elo, ehi)),
grid AS (SELECT DISTINCT fd.env_id, n_repeats, bin, CAST(elo AS DOUBLE) * sigma AS lo, CAST(ehi AS DOUBLE) * sigma AS hi, sigma FROM fd JOIN sig USING (env_id), edges),
bins AS (SELECT g.env_id, g.n_repeats, g.bin, g.lo, g.hi, g.sigma, avg(delta) AS mean_delta, count(delta) AS n_draws, count(*) FILTER (WHERE reversed) AS n_reversals, count(*) FILTER (WHERE reversed) / nullif(count(delta), 0) AS fip
  FROM grid g LEFT JOIN fd ON fd.env_id = g.env_id AND fd.n_repeats = g.n_repeats AND delta >= lo AND (hi IS NULL OR delta < hi) GROUP BY ALL)"""
CROSSED = """, usable_bins AS (SELECT b.*, CAST(a.alpha AS DOUBLE) AS alpha FROM bins b, (VALUES (0.10), (0.05)) a(alpha) WHERE n_draws >= 10),
ranked AS (SELECT *, max(fip) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS worst, lag(mean_delta) OVER w AS pd, lag(fip) OVER w AS pf, row_number() OVER w AS r FROM usable_bins WINDOW w AS (PARTITION BY env_id, n_repeats, alpha ORDER BY mean_delta)),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY env_id, n_repeats, alpha ORDER BY r) AS f FROM ranked WHERE worst <= alpha) WHERE f = 1),
crossing AS (SELECT e.env_id, e.n_repeats, e.alpha, e.sigma, CASE WHEN r = 1 OR pf - fip <= 0 THEN mean_delta ELSE pd + (pf - e.alpha) / (pf - fip) * (mean_delta - pd) END AS mdi_fip, coalesce(r = 1, FALSE) AS below_measured_range
  FROM (SELECT DISTINCT env_id, n_repeats, sigma, CAST(a.alpha AS DOUBLE) AS alpha FROM bins, (VALUES (0.10), (0.05)) a(alpha)) e LEFT JOIN firsts f ON f.env_id = e.env_id AND f.n_repeats = e.n_repeats AND f.alpha = e.alpha)"""

NULL_KEY = ("'null'", f"'{SEED}'", "env_id", "CAST(n_repeats AS VARCHAR)", "system_id", "CAST(draw AS VARCHAR)", "item_id")
NULLS = f"""n0 AS (SELECT * FROM null_cells WHERE n >= 2),
few AS (SELECT env_id, n_repeats FROM (SELECT env_id, min(n) AS least FROM null_cells GROUP BY ALL), (VALUES (1), (3)) t(n_repeats) WHERE n_repeats <= least),
n1 AS (SELECT n0.*, n_repeats, draw FROM n0 JOIN few USING (env_id), range({DRAWS}) d(draw)),
n2 AS (SELECT *, {order('scores', *NULL_KEY)} AS o FROM n1),
n3 AS (SELECT *, o{HALF.format('o')} AS p1, o{REST.format('o')} AS p2 FROM n2),
n4 AS (SELECT env_id, n_repeats, system_id, draw, sum({drawn('p1', 'n_repeats', *NULL_KEY, "'a'")} - {drawn('p2', 'n_repeats', *NULL_KEY, "'b'")}) AS d, count(*) AS items, avg(1 / floor(n / 2) + 1 / (n - floor(n / 2))) AS term FROM n3 GROUP BY ALL),
nd AS (SELECT env_id, n_repeats, system_id, d / (n_repeats * items) AS delta, term FROM n4),
nt AS (SELECT env_id, n_repeats, avg(t) AS pool_term, count(*) AS n_systems FROM (SELECT env_id, n_repeats, system_id, avg(term) AS t FROM nd GROUP BY ALL) GROUP BY ALL),
n5 AS (SELECT env_id, n_repeats, CAST(alpha AS DOUBLE) AS alpha, (quantile_cont(delta, CASE WHEN alpha > 0.07 THEN 0.95 ELSE 0.975 END) - quantile_cont(delta, CASE WHEN alpha > 0.07 THEN 0.05 ELSE 0.025 END)) / 2 AS mdi_null, quantile_cont(abs(delta), CASE WHEN alpha > 0.07 THEN 0.9 ELSE 0.95 END) AS abs_delta_quantile, count(*) AS n_draws
  FROM nd, (VALUES (0.10)) a(alpha) GROUP BY ALL
  UNION ALL SELECT env_id, n_repeats, 0.05, (quantile_cont(delta, 0.975) - quantile_cont(delta, 0.025)) / 2, quantile_cont(abs(delta), 0.95), count(*) FROM nd GROUP BY ALL),
entries AS (SELECT n5.*, n_systems, pool_term, CASE WHEN pool_term <= 0 THEN 1 ELSE sqrt(((2 - pool_term) / n_repeats + pool_term) / (2 / n_repeats)) END AS pool_inflation FROM n5 JOIN nt USING (env_id, n_repeats))""".replace("CASE WHEN alpha > 0.07 THEN 0.95 ELSE 0.975 END", "0.95").replace("CASE WHEN alpha > 0.07 THEN 0.05 ELSE 0.025 END", "0.05").replace("CASE WHEN alpha > 0.07 THEN 0.9 ELSE 0.95 END", "0.9")
NULL = f"WITH {RECORDS}, {cells('score_records').replace('cells AS', 'null_cells AS')}, {NULLS}"
POWERED = """, kd AS (SELECT env_id, n_repeats, delta, row_number() OVER (PARTITION BY env_id, n_repeats ORDER BY delta DESC) AS r, count(*) OVER (PARTITION BY env_id, n_repeats) AS n FROM nd),
kth AS (SELECT env_id, n_repeats, delta AS kth FROM kd WHERE r = ceil(0.8 * n - 1e-9)),
steps AS (SELECT e.*, mdi_null * 0.005 AS unit, CASE WHEN mdi_null > 0 THEN greatest(0, floor(round((mdi_null - kth) / (mdi_null * 0.005), 9)) + 1) END AS k FROM entries e JOIN kth USING (env_id, n_repeats)),
powered AS (SELECT *, CASE WHEN k <= 800 THEN k * unit END AS mdi_power FROM steps)"""


def smooth(source: str, value: str) -> str:
    """Non-increasing in N: least over starts of the greatest over ends of means."""
    return f"""sm_{value} AS (
  SELECT env_id, alpha, i AS n_repeats, min(m) AS fitted FROM (
    SELECT x.env_id, x.alpha, x.n_repeats AS i, j.n_repeats AS j, max(avg_) AS m FROM {source} x
    JOIN (SELECT a.env_id, a.alpha, a.n_repeats, b.n_repeats AS k, avg(c.{value}) AS avg_ FROM {source} a JOIN {source} b ON a.env_id = b.env_id AND a.alpha = b.alpha AND a.n_repeats <= b.n_repeats
          JOIN {source} c ON c.env_id = a.env_id AND c.alpha = a.alpha AND c.n_repeats BETWEEN a.n_repeats AND b.n_repeats AND c.{value} IS NOT NULL WHERE a.{value} IS NOT NULL AND b.{value} IS NOT NULL GROUP BY ALL) j
      ON j.env_id = x.env_id AND j.alpha = x.alpha AND j.n_repeats <= x.n_repeats AND j.k >= x.n_repeats
    WHERE x.{value} IS NOT NULL GROUP BY ALL) GROUP BY ALL)"""


CLAIM_KEY = ("'claim'", f"'{SEED}'", "env_id", "CAST(n_repeats AS VARCHAR)", "system_a || '~' || system_b", "CAST(draw AS VARCHAR)", "item_id")
CLAIMS = f"""WITH {SIGNAL}, {ANNOTATIONS}, {JUDGE}, {diffs()}, {cells('signal_records')},
cr AS (SELECT a.env_id, a.item_id, a.system_id AS system_a, b.system_id AS system_b, a.scores AS sa, b.scores AS sb, n_repeats, CAST(threshold AS DOUBLE) AS threshold, draw
  FROM cells a JOIN cells b ON a.env_id = b.env_id AND a.item_id = b.item_id AND a.system_id <= b.system_id, (VALUES (1, 0.5), (3, 0.3)) t(n_repeats, threshold), range({DRAWS}) d(draw)),
cs AS (SELECT env_id, n_repeats, threshold, system_a, system_b, draw, abs(sum({drawn('sa', 'n_repeats', *CLAIM_KEY, "'a'")} - {drawn('sb', 'n_repeats', *CLAIM_KEY, "'b'")})) / (n_repeats * count(*)) > threshold + 1e-12 AS claim FROM cr GROUP BY env_id, n_repeats, threshold, system_a, system_b, draw),
claimed AS (SELECT env_id, n_repeats, threshold, system_a, system_b, count(*) FILTER (WHERE claim) AS claims, count(*) AS draws FROM cs GROUP BY ALL),
seen AS (SELECT c.env_id, n_repeats, threshold, c.system_a, c.system_b, oracle_gap_pp, judge_gap_pp, claims / draws AS detect_rate FROM claimed c JOIN gaps g ON g.env_id = c.env_id AND g.system_a = c.system_a AND g.system_b = c.system_b WHERE c.system_a <> c.system_b)"""

MODEL = "SELECT doc_id, 'model_' || lang AS model, CAST(floor(length(text) / 4.0) AS BIGINT) + 8 AS in_tokens, CAST(8 AS BIGINT) AS out_tokens FROM documents"

SQL = {
    "score_records_scan": f"WITH {RECORDS} SELECT * FROM score_records",
    "duplicate_key_guard": f"WITH {RECORDS} SELECT env_id, item_id, system_id, repeat_idx % 5 AS repeat_idx, count(DISTINCT score) AS n_scores, count(*) AS n_records FROM score_records GROUP BY ALL HAVING count(DISTINCT score) > 1",
    "env_metadata": f"WITH {RECORDS} SELECT env_id, count(*) AS n_records, count(DISTINCT item_id) AS n_items, count(DISTINCT system_id) AS n_systems, count(DISTINCT repeat_idx) AS n_repeats, min(score) AS min_score, max(score) AS max_score FROM score_records GROUP BY env_id",
    "repeat_split": f"WITH {RECORDS} SELECT env_id, min_repeats, n_repeats FROM (SELECT env_id, min(n) AS min_repeats FROM (SELECT env_id, item_id, system_id, count(*) AS n FROM score_records WHERE {EST} GROUP BY ALL) GROUP BY ALL), (VALUES (1), (3), (5), (8), (10)) t(n_repeats) WHERE n_repeats <= min_repeats",
    "cell_variance": f"WITH {RECORDS} SELECT env_id, item_id, system_id, count(*) AS n, {r6('avg(score)', 'mean_score')}, {r6('var_samp(score)', 'variance')} FROM score_records GROUP BY ALL",
    "pooled_sigma": pooled("env_id"),
    "system_variance": pooled("env_id, system_id"),
    "item_flip_rates": f"WITH {RECORDS} SELECT a.env_id, a.item_id, a.system_id, any_value(n) AS n, {r6('avg(CASE WHEN a.score <> b.score THEN 1.0 ELSE 0.0 END)', 'flip_rate')}, {r6('any_value(sd)', 'sd')} FROM score_records a JOIN score_records b ON a.env_id = b.env_id AND a.item_id = b.item_id AND a.system_id = b.system_id AND a.repeat_idx < b.repeat_idx JOIN (SELECT env_id, item_id, system_id, count(*) AS n, stddev_samp(score) AS sd FROM score_records GROUP BY ALL) c ON c.env_id = a.env_id AND c.item_id = a.item_id AND c.system_id = a.system_id GROUP BY a.env_id, a.item_id, a.system_id",
    "rank_flip_rate": f"""WITH {RECORDS}, means AS (SELECT env_id, item_id, system_id, avg(score) AS m FROM score_records GROUP BY ALL),
ref AS (SELECT a.env_id, a.system_id AS system_a, b.system_id AS system_b, count(*) AS n_items, avg(a.m - b.m) AS mean_delta FROM means a JOIN means b ON a.env_id = b.env_id AND a.item_id = b.item_id AND a.system_id < b.system_id GROUP BY ALL),
signed AS (SELECT *, CASE WHEN abs(mean_delta) < 1e-12 THEN 0 WHEN mean_delta > 0 THEN 1 ELSE -1 END AS reference_sign FROM ref)
SELECT s.env_id, s.system_a, s.system_b, n_items, count(*) AS n_comparisons, {r6('mean_delta')}, reference_sign, {r6('avg(CASE WHEN sign(a.score - b.score) <> reference_sign OR a.score = b.score THEN 1.0 ELSE 0.0 END)', 'rank_flip_rate')}
FROM signed s JOIN score_records a ON a.env_id = s.env_id AND a.system_id = s.system_a JOIN score_records b ON b.env_id = s.env_id AND b.system_id = s.system_b AND a.item_id = b.item_id GROUP BY s.env_id, s.system_a, s.system_b, n_items, mean_delta, reference_sign""",
    "alpha_interval": alpha("interval"),
    "alpha_nominal": alpha("nominal"),
    "alpha_ordinal": alpha("ordinal"),
    "env_variance": f"SELECT * FROM ({pooled('env_id')}) JOIN (WITH {RECORDS}, {FLIPS} SELECT env_id, {r6('avg(flip_rate)', 'flip_rate')} FROM flips GROUP BY env_id) USING (env_id) JOIN (SELECT env_id, alpha FROM ({alpha('interval')})) USING (env_id)",
    "to_percent_points": f"WITH {RECORDS} SELECT env_id, system_id, {r6('(avg(score) - 1) / 4 * 100', 'mean_pp')} FROM score_records GROUP BY ALL",
    "parse_responses": f"WITH {RESPONSES} SELECT env_id, l_orderkey, l_linenumber, response, parsed_score, CASE WHEN parsed_score IS NULL THEN 'no_score_in_range' ELSE 'ok' END AS reason FROM parsed",
    "parse_failure_rate": f"WITH {RESPONSES} SELECT env_id, count(*) AS attempts, count(*) - count(parsed_score) AS failures, {r6('(count(*) - count(parsed_score)) / count(*)', 'rate')} FROM parsed GROUP BY env_id",
    "content_digest": "SELECT doc_id, 'sha256:' || sha256(text) AS digest FROM documents",
    "estimate_tokens": f"SELECT doc_id, in_tokens FROM ({MODEL})",
    "price_calls": f"SELECT model, count(*) AS calls, CAST(sum(in_tokens) AS BIGINT) AS in_tokens, CAST(sum(out_tokens) AS BIGINT) AS out_tokens, {r6('(sum(in_tokens) * any_value(CAST(a AS DOUBLE)) + sum(out_tokens) * any_value(CAST(b AS DOUBLE))) / 1e6', 'cost_usd')} FROM ({MODEL}) JOIN (VALUES ('model_en', 0.15, 0.6), ('model_de', 2.0, 8.0), ('model_fr', 1.0, 4.0), ('model_es', 0.5, 1.5)) p(model, a, b) USING (model) GROUP BY model",
    "plan_calls": f"WITH {RECORDS} SELECT env_id, item_id, system_id, r AS repeat_idx, CAST(r % 4 AS BIGINT) AS paraphrase, r + 7 AS seed FROM (SELECT DISTINCT env_id FROM score_records), (SELECT DISTINCT item_id FROM score_records), (SELECT DISTINCT system_id FROM score_records), range(20) t(r)",
    "grid_expand": f"WITH {RECORDS} SELECT env_id, c AS cells, c * 20 AS expected_calls, c * 40 AS worst_case_calls FROM (SELECT DISTINCT env_id FROM score_records), (SELECT count(DISTINCT item_id) * count(DISTINCT system_id) AS c FROM score_records)",
    "resume_remaining": f"WITH {RECORDS} SELECT env_id, item_id, system_id, r AS repeat_idx FROM (SELECT DISTINCT env_id FROM score_records), (SELECT DISTINCT item_id FROM score_records), (SELECT DISTINCT system_id FROM score_records), range(24) t(r) EXCEPT SELECT env_id, item_id, system_id, repeat_idx FROM score_records",
    "ledger_total": f"WITH {LEDGER} SELECT experiment, count(*) AS entries, CAST(sum(calls) AS BIGINT) AS calls, {r6('sum(cost_usd)', 'cost_usd', 2)} FROM ledger GROUP BY experiment",
    "cost_per_100": f"WITH {LEDGER} SELECT tier, calls, n_repeats, {r6('cost / calls * n_repeats * 100', 'usd_per_100_cells', 4)} FROM (SELECT CASE WHEN left(experiment, 1) <= '2' THEN 'anchor' ELSE 'dense' END AS tier, CAST(sum(calls) AS BIGINT) AS calls, sum(cost_usd) AS cost FROM ledger GROUP BY ALL), (VALUES (1), (3), (8), (20)) t(n_repeats)",
    "budget_verdict": f"""WITH {LEDGER}, s AS (SELECT experiment AS slice, left(experiment, 1) = '1' AS pilot, round(sum(cost_usd), 2) AS projected FROM ledger GROUP BY ALL),
v AS (SELECT slice, pilot, projected, CASE WHEN pilot THEN 50000.0 ELSE 5000000.0 END AS cap, CASE WHEN projected > CASE WHEN pilot THEN 50000.0 ELSE 5000000.0 END THEN CASE WHEN pilot THEN 'over the pilot cap' ELSE 'over the run cap' END WHEN projected + 100000 > 5000000 THEN 'over the cumulative cap' ELSE 'within caps' END AS reason FROM s)
SELECT slice, pilot, projected + 0.0 AS projected_usd, CAST(100000 AS DOUBLE) AS spent_usd, CAST(cap AS DOUBLE) AS slice_cap_usd, CASE WHEN reason = 'within caps' THEN 'ok' ELSE 'block' END AS verdict, reason FROM v""",
    "annotation_facet_mean": f"WITH {LINES}, {ANNOTATIONS} SELECT item_id, system_id, {r6('avg(value)', 'value')} FROM annotations GROUP BY ALL",
    "closest_pair": f"{SYSTEM_MEANS} SELECT system_a, system_b, {r6('round(gap, 9)', 'gap')} FROM pairs ORDER BY round(gap, 9), system_a, system_b LIMIT 1",
    "tightest_cluster": f"{SYSTEM_MEANS}, w AS (SELECT *, row_number() OVER (ORDER BY mean, system_id) AS r, lead(mean, 2) OVER (ORDER BY mean, system_id) AS top FROM means), b AS (SELECT r AS start, round(top - mean, 9) AS spread FROM w WHERE top IS NOT NULL ORDER BY spread, start LIMIT 1) SELECT system_id, {r6('mean')}, {r6('spread')} FROM w, b WHERE r BETWEEN start AND start + 2",
    "gap_ladder": f"{SYSTEM_MEANS} SELECT system_a, system_b, target, {r6('gap_pp')} FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(abs(gap_pp - target), 9), system_a, system_b) AS r FROM (SELECT system_a, system_b, CAST(target AS DOUBLE) AS target, gap / 4 * 100 AS gap_pp FROM pairs, (VALUES (5), (15), (30)) t(target))) WHERE r = 1",
    "external_gaps": f"{EXTERNAL}, {diffs()} SELECT env_id, system_a, system_b, {GAP_COLUMNS} FROM gaps",
    "external_gap_intervals": f"""{EXTERNAL}, {diffs()}, placed AS (SELECT env_id || '|' || system_a || '|' || system_b AS g, env_id, system_a, system_b, item_id, d, row_number() OVER (PARTITION BY env_id, system_a, system_b ORDER BY item_id) - 1 AS place FROM diffs),
{boots('gap_boot', 'g', 'placed')}, reps AS (SELECT env_id, system_a, system_b, replicate, sum(times * d) / sum(times) AS gap FROM weights JOIN placed USING (g, place) GROUP BY ALL),
ci AS (SELECT env_id, system_a, system_b, quantile_cont(gap, 0.025) AS lo, quantile_cont(gap, 0.975) AS hi FROM reps GROUP BY ALL)
SELECT env_id, system_a, system_b, {r6('lo', 'oracle_ci_lo_pp')}, {r6('hi', 'oracle_ci_hi_pp')}, lo > 0 OR hi < 0 AS separated FROM ci""",
    "bias_decomposition": f"{EXTERNAL}, {diffs()} SELECT env_id, {r6('avg(abs(oracle_gap_pp))', 'mean_abs_oracle_gap_pp')}, {r6('avg(abs(judge_gap_pp))', 'mean_abs_judge_gap_pp')}, {r6('avg(abs(residual_pp))', 'mean_abs_residual_pp')}, {r6('max(abs(oracle_gap_pp))', 'max_abs_oracle_gap_pp')}, {r6('max(abs(judge_gap_pp))', 'max_abs_judge_gap_pp')}, {r6('CASE WHEN avg(abs(judge_gap_pp)) > 0 THEN avg(abs(residual_pp)) / avg(abs(judge_gap_pp)) ELSE 0 END', 'residual_share')} FROM gaps GROUP BY env_id",
    "rank_concordance": f"{EXTERNAL}, {diffs()} SELECT env_id, {r6('avg(CASE WHEN oracle_gap_pp <> 0 THEN CAST(sign(oracle_gap_pp) = sign(judge_gap_pp) AS INTEGER) END)', 'rank_concordance')} FROM gaps GROUP BY env_id",
    "system_ranks": f"""{EXTERNAL}, sm AS (SELECT env_id, system_id, round(avg(mean_score), 12) AS jm, round(avg(value), 12) AS om FROM judge JOIN reference USING (item_id, system_id) GROUP BY ALL)
SELECT env_id, system_id, {r6('jm', 'judge_mean')}, {r6('om', 'oracle_mean')}, CAST(rank() OVER (PARTITION BY env_id ORDER BY jm DESC) AS INTEGER) AS judge_rank, CAST(rank() OVER (PARTITION BY env_id ORDER BY om DESC) AS INTEGER) AS oracle_rank,
{r6('(max(jm) OVER (PARTITION BY env_id) - min(jm) OVER (PARTITION BY env_id)) / 4 * 100', 'judge_spread_pp')}, {r6('(max(om) OVER (PARTITION BY env_id) - min(om) OVER (PARTITION BY env_id)) / 4 * 100', 'oracle_spread_pp')} FROM sm""",
    "facet_breakdown": f"{EXTERNAL}, {diffs('annotations', 'facet')} SELECT env_id, facet, system_a, system_b, {GAP_COLUMNS} FROM gaps",
    "discordant_counts": f"WITH {ANSWERS} SELECT seed, promo_idx, b, c, n_questions, {r6('baseline_accuracy')} FROM counts",
    "mcnemar": f"{TESTED} SELECT seed, promo_idx, {r6('mcnemar_p')}, {r6('reversal_prob')} FROM report",
    "promotion_report": f"{TESTED} SELECT seed, promo_idx, b, c, n_questions, {r6('baseline_accuracy')}, {r6('confirm_delta')}, {r6('mcnemar_p')}, {r6('reversal_prob')}, clears, would_halt FROM halted",
    "stopping": f"""{TESTED}, s AS (SELECT seed, count(*) AS n_promotions, max(promo_idx) FILTER (WHERE clears) AS halt, max_by(confirm_delta, promo_idx) AS final FROM report GROUP BY seed)
SELECT s.seed, n_promotions, halt AS halt_promo_idx, h.b AS halt_b, h.c AS halt_c, {r6('h.confirm_delta', 'peak_confirm_delta')}, {r6('final', 'final_confirm_delta')}, (SELECT count(*) FROM report r WHERE r.seed = s.seed AND (halt IS NULL OR r.promo_idx > halt)) AS n_promotions_after_halt, {r6('final - h.confirm_delta', 'drift_confirm_delta')}
FROM s LEFT JOIN report h ON h.seed = s.seed AND h.promo_idx = s.halt""",
    "prospective_bar": f"WITH {BINOMIAL} SELECT CAST(n AS BIGINT) AS n, min(b) FILTER (WHERE b > n / 2 AND list_sum(row[CAST(b AS INTEGER) + 1:]) <= 0.05 + 1e-12) AS min_majority FROM tri, range(41) t(b) WHERE n <= 40 AND b <= n GROUP BY n",
    "omega_components": f"WITH {SIGNAL}, {GROUPS}, weighted AS (SELECT *, 1 AS w FROM usable), {parts('weighted')} SELECT env_id, {r6('omega_sq_main')}, {r6('omega_sq_int')}, {r6('omega_sq_between')} FROM split",
    "pair_gap_shift": f"""WITH {SIGNAL}, {GROUPS}, l AS (SELECT env_id, system_id, label, avg(mean) AS m FROM shared GROUP BY ALL),
p AS (SELECT a.env_id, a.system_id AS x, b.system_id AS y, stddev_pop(a.m - b.m) AS sd, min(a.m - b.m) AS low, max(a.m - b.m) AS high FROM l a JOIN l b ON a.env_id = b.env_id AND a.label = b.label AND a.system_id < b.system_id GROUP BY ALL)
SELECT env_id, {r6('quantile_cont(sd, 0.5)', 'median_sd')}, {r6('max(sd)', 'max_sd')}, count(*) AS n_pairs, count(*) FILTER (WHERE low < 0 AND high > 0) AS sign_flips FROM p GROUP BY env_id""",
    "decay_fit": f"""WITH {SIGNAL}, {VARIANCES}, line AS (SELECT env_id, regr_slope(v, 1 / n_repeats) AS slope, regr_intercept(v, 1 / n_repeats) AS raw, CASE WHEN regr_syy(v, 1 / n_repeats) > 0 THEN regr_r2(v, 1 / n_repeats) END AS r_squared FROM points GROUP BY env_id HAVING count(*) >= 2),
sizes AS (SELECT env_id, avg(len(labels)) AS g, sum(list_sum(list_transform(labels, lambda x: len(x)))) / sum(len(labels)) AS reps FROM cl GROUP BY env_id),
f AS (SELECT *, greatest(slope, 0) AS sigma_sq, greatest(raw, 0) AS omega_sq FROM line JOIN sizes USING (env_id))
SELECT env_id, {r6('sigma_sq')}, {r6('omega_sq')}, {r6('raw', 'omega_sq_raw')}, {r6('greatest(omega_sq - CASE WHEN g > 1 THEN (g - 1) / g * sigma_sq / reps ELSE 0 END, 0)', 'omega_sq_debiased')}, {r6('omega_sq / nullif(omega_sq + sigma_sq, 0)', 'icc')}, {r6('r_squared')} FROM f""",
    "decay_points": f"""WITH {SIGNAL}, {VARIANCES}, d AS (SELECT env_id, n_repeats, v AS var_mean, n_cells, sqrt(v) AS sd_mean, sqrt(first_value(v) OVER w) * sqrt(first_value(n_repeats) OVER w) / sqrt(n_repeats) AS sd_theoretical FROM points WINDOW w AS (PARTITION BY env_id ORDER BY n_repeats))
SELECT env_id, n_repeats, {r6('var_mean')}, n_cells, {r6('sd_mean')}, {r6('sd_theoretical')}, {r6('sd_mean - sd_theoretical', 'deviation')}, {r6('(sd_mean - sd_theoretical) / nullif(sd_theoretical, 0)', 'relative_deviation')} FROM d""",
    "omega_ci": f"""WITH {SIGNAL}, {VARIANCES}, placed AS (SELECT env_id, item_id, system_id, row_number() OVER (PARTITION BY env_id ORDER BY item_id, system_id) - 1 AS place FROM (SELECT DISTINCT env_id, item_id, system_id FROM variances)),
{boots('omega_boot', 'env_id', 'placed')}, reps AS (SELECT env_id, replicate, n_repeats, sum(times * variance) / sum(times) AS v FROM weights w JOIN placed p ON p.env_id = w.g AND p.place = w.place JOIN variances USING (env_id, item_id, system_id) GROUP BY ALL),
fl AS (SELECT env_id, replicate, greatest(regr_intercept(v, 1 / n_repeats), 0) AS o FROM reps GROUP BY ALL)
SELECT env_id, {r6('quantile_cont(o, 0.025)', 'ci_lo')}, {r6('quantile_cont(o, 0.975)', 'ci_hi')}, count(o) AS n_effective FROM fl GROUP BY env_id""",
    "label_ci": f"""WITH {SIGNAL}, {GROUPS}, placed AS (SELECT env_id, label, row_number() OVER (PARTITION BY env_id ORDER BY label) - 1 AS place FROM (SELECT DISTINCT env_id, label FROM shared)),
{boots('label_boot', 'env_id', 'placed')}, weighted AS (SELECT s.*, replicate, times AS w FROM weights x JOIN placed p ON p.env_id = x.g AND p.place = x.place JOIN shared s ON s.env_id = p.env_id AND s.label = p.label), {parts('weighted', 'replicate')}
SELECT env_id, {', '.join(r6(f'round(quantile_cont({c}, {q}), 10)', f'{c}_{n}') for c in ('omega_sq_main', 'omega_sq_int', 'omega_sq_between') for n, q in (('lo', 0.025), ('hi', 0.975)))} FROM split GROUP BY env_id""",
    "component_ci": f"""WITH {SIGNAL}, {GROUPS}, weighted AS (SELECT *, 1 AS w FROM usable), {parts('weighted')}, placed AS (SELECT *, row_number() OVER (PARTITION BY env_id ORDER BY item_id) - 1 AS place FROM d4),
{boots('item_boot', 'env_id', 'placed')}, reps AS (SELECT env_id, replicate, sum(times * main) / sum(times) AS omega_sq_main, sum(times * rest) / sum(times * n) AS omega_sq_int FROM weights x JOIN placed p ON p.env_id = x.g AND p.place = x.place GROUP BY ALL)
SELECT env_id, {', '.join(r6(f'round(quantile_cont({c}, {q}), 10)', f'{c}_{n}') for c in ('omega_sq_main', 'omega_sq_int') for n, q in (('lo', 0.025), ('hi', 0.975)))}, any_value(n_items) AS n_items FROM reps JOIN (SELECT env_id, count(*) AS n_items FROM d4 GROUP BY ALL) USING (env_id) GROUP BY env_id""",
    "gap_shift_ci": f"""WITH {SIGNAL}, {GROUPS}, l AS (SELECT env_id, system_id, label, avg(mean) AS m FROM shared GROUP BY ALL), placed AS (SELECT env_id, label, row_number() OVER (PARTITION BY env_id ORDER BY label) - 1 AS place FROM (SELECT DISTINCT env_id, label FROM shared)),
{boots('shift_boot', 'env_id', 'placed')}, copies AS (SELECT p.env_id, p.label, replicate, unnest(range(times)) AS c FROM weights x JOIN placed p ON p.env_id = x.g AND p.place = x.place),
gaps AS (SELECT a.env_id, a.label, a.system_id AS x, b.system_id AS y, a.m - b.m AS gap FROM l a JOIN l b ON a.env_id = b.env_id AND a.label = b.label AND a.system_id < b.system_id),
sds AS (SELECT env_id, replicate, x, y, stddev_pop(gap) AS sd FROM gaps JOIN copies USING (env_id, label) GROUP BY ALL),
medians AS (SELECT env_id, replicate, quantile_cont(sd, 0.5) AS v FROM sds GROUP BY ALL)
SELECT env_id, {r6('round(quantile_cont(v, 0.025), 10)', 'median_sd_lo')}, {r6('round(quantile_cont(v, 0.975), 10)', 'median_sd_hi')}, any_value(n_labels) AS n_labels FROM medians JOIN (SELECT env_id, count(*) AS n_labels FROM placed GROUP BY ALL) USING (env_id) GROUP BY env_id""",
    "sigma_ci": f"""WITH {RECORDS}, {MOMENTS}, items AS (SELECT env_id, item_id, sum(q - s * s / n) AS ss, sum(n - 1) AS df FROM m WHERE n > 1 GROUP BY ALL), placed AS (SELECT *, row_number() OVER (PARTITION BY env_id ORDER BY item_id) - 1 AS place FROM items),
{boots('sigma_boot', 'env_id', 'placed')}, reps AS (SELECT env_id, replicate, sqrt(sum(times * ss) / sum(times * df)) AS sigma FROM weights w JOIN placed p ON p.env_id = w.g AND p.place = w.place GROUP BY ALL),
ci AS (SELECT env_id, quantile_cont(sigma, 0.025) AS lo, quantile_cont(sigma, 0.975) AS hi, count(sigma) AS n_effective FROM reps GROUP BY ALL)
SELECT env_id, {r6('sqrt(sum(ss) / sum(df))', 'sigma')}, {r6('any_value(lo)', 'ci_lo')}, {r6('any_value(hi)', 'ci_hi')}, count(*) AS n_items, any_value(n_effective) AS n_effective FROM items JOIN ci USING (env_id) GROUP BY env_id""",
    "fip_curve": f"{FIP} SELECT env_id, n_repeats, bin, {r6('lo')}, {r6('hi')}, {r6('sigma')}, {r6('mean_delta')}, n_draws, n_reversals, {r6('fip')} FROM bins",
    "fip_conversion": f"{FIP} SELECT env_id, n_repeats, bin, printf('With N=%d, an observed gain of %.4f reverses in %.1f%% of re-measurements.', n_repeats, round(mean_delta, 4), round(fip * 100, 1)) AS statement FROM bins WHERE n_draws > 0",
    "null_mdi": f"{NULL}, {SIGMA_EST.format('score_records')} SELECT env_id, n_repeats, alpha, {r6('mdi_null')}, {r6('abs_delta_quantile')}, n_draws, n_systems, {r6('pool_term')}, {r6('pool_inflation')}, {r6('mdi_null / pool_inflation', 'mdi_null_corrected')}, {r6('sigma')}, {r6('mdi_null / nullif(sigma, 0)', 'mdi_null_in_sigma')} FROM entries JOIN sig USING (env_id)",
    "null_mdi_ci": f"""{NULL}, placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY system_id) - 1 AS place FROM (SELECT DISTINCT env_id || '|' || n_repeats AS grp, env_id, n_repeats, system_id FROM nd)),
{boots('null_boot', 'grp', 'placed')}, copies AS (SELECT p.env_id, p.n_repeats, replicate, system_id, unnest(range(times)) AS c FROM weights w JOIN placed p ON p.grp = w.g AND p.place = w.place),
reps AS (SELECT env_id, n_repeats, alpha, replicate, (quantile_cont(delta, 0.95) - quantile_cont(delta, 0.05)) / 2 AS v10, (quantile_cont(delta, 0.975) - quantile_cont(delta, 0.025)) / 2 AS v05 FROM copies JOIN nd USING (env_id, n_repeats, system_id), (VALUES (0.10), (0.05)) a(alpha) GROUP BY ALL),
chosen AS (SELECT env_id, n_repeats, CAST(alpha AS DOUBLE) AS alpha, CASE WHEN alpha = 0.10 THEN v10 ELSE v05 END AS v FROM reps)
SELECT env_id, n_repeats, alpha, {r6('quantile_cont(v, 0.025)', 'ci_lo')}, {r6('quantile_cont(v, 0.975)', 'ci_hi')} FROM chosen GROUP BY ALL""",
    "mdi_power": f"{NULL}{POWERED} SELECT env_id, n_repeats, alpha, {r6('mdi_null')}, {r6('mdi_power')} FROM powered",
    "mdi_isotonic": f"{NULL}{POWERED}, {smooth('powered', 'mdi_null')}, {smooth('powered', 'mdi_power')} SELECT p.env_id, p.n_repeats, p.alpha, {r6('a.fitted', 'mdi_null_smoothed')}, {r6('b.fitted', 'mdi_power_smoothed')} FROM powered p LEFT JOIN sm_mdi_null a USING (env_id, alpha, n_repeats) LEFT JOIN sm_mdi_power b USING (env_id, alpha, n_repeats)",
    "mdi_fip_crossing": f"{FIP}{CROSSED} SELECT env_id, n_repeats, alpha, {r6('mdi_fip')}, mdi_fip IS NOT NULL AS attained, below_measured_range, {r6('mdi_fip / nullif(sigma, 0)', 'mdi_in_sigma')} FROM crossing",
    "mdi_consistency": f"{FIP}{CROSSED}, {cells('score_records').replace('cells AS', 'null_cells AS')}, {NULLS} SELECT env_id, n_repeats, alpha, {r6('mdi_null')}, {r6('mdi_fip')}, {r6('mdi_fip / nullif(mdi_null, 0)', 'ratio')}, {r6('abs(mdi_null - mdi_fip)', 'abs_diff')} FROM entries FULL JOIN crossing USING (env_id, n_repeats, alpha)",
    "recommended_repeats": f"""{NULL}, {smooth('entries', 'mdi_null')}, o AS (SELECT env_id, n_repeats, fitted / 4 * 100 AS pp FROM sm_mdi_null WHERE abs(alpha - 0.05) < 1e-12), t AS (SELECT env_id, CAST(target AS DOUBLE) AS target_pp, min(n_repeats) FILTER (WHERE pp <= target) AS recommended_n FROM o, (VALUES (2), (5), (10), (20)) v(target) GROUP BY ALL)
SELECT t.env_id, target_pp, {r6('target_pp / 100 * 4', 'target_raw')}, recommended_n, {r6('pp', 'mdi_at_recommended_pp')}, recommended_n IS NOT NULL AS reachable FROM t LEFT JOIN o ON o.env_id = t.env_id AND o.n_repeats = t.recommended_n""",
    "sla_margin": f"{NULL} SELECT env_id, {r6('max(abs_delta_quantile) FILTER (WHERE n_repeats = 1)', 'n_1')}, {r6('max(abs_delta_quantile) FILTER (WHERE n_repeats = 3)', 'n_3')} FROM entries WHERE alpha > 0.07 GROUP BY env_id",
    "claim_rates": f"{CLAIMS} SELECT env_id, n_repeats, threshold, CAST(sum(draws) FILTER (WHERE system_a <> system_b) AS BIGINT) AS n_draws, {r6('sum(claims) FILTER (WHERE system_a = system_b) / sum(draws) FILTER (WHERE system_a = system_b)', 'internal_rate')}, {r6('sum(claims) FILTER (WHERE system_a <> system_b) / sum(draws) FILTER (WHERE system_a <> system_b)', 'external_rate')} FROM claimed GROUP BY ALL",
    "detection_curve": f"{CLAIMS} SELECT env_id, n_repeats, threshold, system_a, system_b, {r6('oracle_gap_pp')}, {r6('judge_gap_pp')}, {r6('detect_rate')} FROM seen",
    "detection_summary": f"""{CLAIMS}, k AS (SELECT env_id, n_repeats, detect_rate, 'judge_gap_vs_mdi' AS boundary, threshold / 4 * 100 AS at_, abs(judge_gap_pp) AS x FROM seen UNION ALL SELECT env_id, n_repeats, detect_rate, 'oracle_gap_pp', 15.0, abs(oracle_gap_pp) FROM seen)
SELECT env_id, n_repeats, boundary, {r6('max(at_)', 'boundary_value_pp')}, count(*) FILTER (WHERE x < at_) AS n_below, count(*) FILTER (WHERE x >= at_) AS n_above, {r6('avg(detect_rate) FILTER (WHERE x < at_)', 'mean_detect_below')}, {r6('avg(detect_rate) FILTER (WHERE x >= at_)', 'mean_detect_above')} FROM k GROUP BY ALL""",
}
