"""What the catalogue's queries compute, as SQL over the same tables."""

from __future__ import annotations

from lacuna.operators.metrics import FEATURES, NUMERATORS

_BASE = """WITH RECURSIVE obs AS (SELECT event_type AS series_id, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS slot, avg(value) AS value FROM events GROUP BY 1, 2),
span AS (SELECT series_id, min(slot) AS a, max(slot) AS b FROM obs GROUP BY 1),
grid AS (SELECT series_id, a, unnest(range(a, b + 1)) AS slot FROM span),
s AS (SELECT series_id, slot - a AS pos, CAST(slot * 3600000 AS DOUBLE) AS t_ms, value, value IS NOT NULL AND ((slot - a) * 7919 + length(series_id) * 104729) % 37 >= 2 AS valid FROM grid LEFT JOIN obs USING (series_id, slot))
"""
_W = "PARTITION BY series_id ORDER BY pos"


def _cand(n: int, least: int = 2) -> str:
    c = max(least, n)
    return f"""(SELECT series_id, CAST({n} AS BIGINT) AS length, pos AS gap_start, pos + {n} AS gap_end, pos - {c} AS ctx_start, pos + {n + c} AS ctx_end, b / {c}.0::DOUBLE AS left_share, a / {c}.0::DOUBLE AS right_share, series_id || '_{n}_' || pos AS gap_id FROM (
  SELECT *, sum(valid::INT) OVER ({_W} ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS i, sum(valid::INT) OVER ({_W} ROWS BETWEEN {c} PRECEDING AND 1 PRECEDING) AS b,
    sum(valid::INT) OVER ({_W} ROWS BETWEEN {n} FOLLOWING AND {n + c - 1} FOLLOWING) AS a, lag(valid) OVER ({_W}) AS l, lead(valid, {n}) OVER ({_W}) AS r, max(pos) OVER (PARTITION BY series_id) AS last FROM s)
  WHERE pos >= {c} AND pos + {n + c} - 1 <= last AND i = {n} AND l AND r AND b >= 0.8 * {c} AND a >= 0.8 * {c})"""


_ISLANDS = f", isl AS (SELECT series_id, min(pos) AS gap_start, max(pos) + 1 AS gap_end, count(*) AS n FROM (SELECT series_id, pos, pos - row_number() OVER ({_W}) AS run FROM s WHERE NOT valid) GROUP BY series_id, run)\n"
_GAPS = f""", g AS (SELECT * FROM {_cand(2)} UNION ALL SELECT * FROM {_cand(5)}),
m AS (SELECT gap_id, s.series_id, length, gap_start, gap_end, left_share, right_share, pos, t_ms, CASE WHEN pos >= gap_start AND pos < gap_end THEN 'G' WHEN pos < gap_start THEN 'L' ELSE 'R' END AS side,
  CASE WHEN valid AND NOT (pos >= gap_start AND pos < gap_end) THEN value END AS value, CASE WHEN pos >= gap_start AND pos < gap_end THEN value END AS truth, valid
  FROM s JOIN g ON s.series_id = g.series_id AND pos >= ctx_start AND pos < ctx_end)
"""
_SIMPLE = """, bd AS (SELECT *, max(CASE WHEN pos = gap_start - 1 THEN value END) OVER (PARTITION BY gap_id) AS xl, max(CASE WHEN pos = gap_end THEN value END) OVER (PARTITION BY gap_id) AS xr FROM m),
p AS (SELECT gap_id, series_id, pos, truth, 'forward_fill' AS method, 0 AS method_ord, xl AS pred FROM bd WHERE side = 'G'
  UNION ALL SELECT gap_id, series_id, pos, truth, 'nearest_boundary', 1, CASE WHEN pos - gap_start + 1 <= gap_end - pos THEN xl ELSE xr END FROM bd WHERE side = 'G'
  UNION ALL SELECT gap_id, series_id, pos, truth, 'linear', 2, xl + (xr - xl) * (pos - gap_start + 1) / (length + 1) FROM bd WHERE side = 'G')
"""
_LOCAL = "SELECT gap_id, series_id, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS local_iqr FROM m WHERE side <> 'G' GROUP BY 1, 2"
_SCALE = f""", sc AS (SELECT gap_id, local_iqr, series_iqr, greatest(local_iqr, 0.05::DOUBLE * series_iqr) AS scale FROM ({_LOCAL}) JOIN
  (SELECT gap_id, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS series_iqr FROM s JOIN g ON s.series_id = g.series_id AND (pos < gap_start OR pos >= gap_end) WHERE valid GROUP BY 1) USING (gap_id))
"""
_ERR = """, e AS (SELECT gap_id, series_id, method, method_ord, rmse, mae, CASE WHEN scale > 0 THEN rmse / scale END AS nrmse FROM
  (SELECT gap_id, series_id, method, method_ord, sqrt(avg((truth - pred) * (truth - pred))) AS rmse, avg(abs(truth - pred)) AS mae FROM p GROUP BY ALL) JOIN sc USING (gap_id)),
b AS (SELECT gap_id, series_id, arg_min(method, row(nrmse, method_ord)) AS best_method, round(min(nrmse), 8) AS best_error, count(nrmse) AS n_applicable FROM e GROUP BY 1, 2)
"""
_FULL = _BASE + _GAPS + _SIMPLE + _SCALE + _ERR
_RAW = """, v AS (SELECT *, abs((value - lag(value) OVER w) / (t_ms / 1000 - lag(t_ms / 1000) OVER w)) AS speed FROM m WHERE value IS NOT NULL WINDOW w AS (PARTITION BY gap_id, side ORDER BY pos)),
a AS (SELECT gap_id, series_id, length, left_share, right_share, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS i, stddev_pop(value) AS sd, max(value) - min(value) AS rg,
  avg(value) FILTER (side = 'L') AS ml, avg(value) FILTER (side = 'R') AS mr, regr_slope(value, pos * 3600) FILTER (side = 'L') AS sl, regr_slope(value, pos * 3600) FILTER (side = 'R') AS sr,
  regr_r2(value, pos * 3600) FILTER (side = 'L') AS r2l, regr_r2(value, pos * 3600) FILTER (side = 'R') AS r2r, median(speed) FILTER (side = 'L') AS vl, median(speed) FILTER (side = 'R') AS vr,
  quantile_cont(speed, 0.9) FILTER (side = 'L') AS pl, quantile_cont(speed, 0.9) FILTER (side = 'R') AS pr, max(value) FILTER (pos = gap_start - 1) AS xl, max(value) FILTER (pos = gap_end) AS xr,
  count(*) FILTER (side = 'L') AS nl, count(*) FILTER (side = 'R') AS nr FROM v GROUP BY ALL),
f AS (SELECT gap_id, series_id, i AS local_iqr, length * 3600000.0::DOUBLE AS realized_gap_duration_ms, left_share AS left_context_valid_fraction, right_share AS right_context_valid_fraction, r2l AS trend_before_r2, r2r AS trend_after_r2,
  abs(xr - xl) AS raw_absolute_boundary_difference, mr - ml AS raw_mean_difference_right_minus_left, sd AS raw_local_std, rg AS raw_local_range, sl AS raw_trend_before, sr AS raw_trend_after, sr - sl AS raw_trend_difference,
  vl AS raw_median_absolute_velocity_left, vr AS raw_median_absolute_velocity_right, pl AS raw_p90_absolute_velocity_left, pr AS raw_p90_absolute_velocity_right FROM a WHERE nl > 1 AND nr > 1 AND xl IS NOT NULL AND xr IS NOT NULL)
"""
_DEC = """, x AS (SELECT e.*, y.nrmse AS predicted FROM e JOIN g USING (gap_id) JOIN (SELECT e.method, e.nrmse, g.series_id, g.length, g.gap_start FROM e JOIN g USING (gap_id)) y ON y.series_id = g.series_id AND y.length = g.length AND y.gap_start = g.gap_start - 1 AND y.method = e.method),
d AS (SELECT gap_id, series_id, arg_min(method, row(predicted, method_ord)) AS selected_method, arg_min(method, row(nrmse, method_ord)) AS oracle_method, arg_min(nrmse, row(predicted, method_ord)) AS selected_nrmse, max(nrmse) FILTER (method = 'linear') AS baseline_nrmse, min(nrmse) AS oracle_nrmse FROM x GROUP BY 1, 2)
"""


def _seasonal(fold: str, offsets: int, ways: str, per: int, least: int) -> str:
    return _BASE + _GAPS + f""", h AS (SELECT gap_id, length, dir, off, g.gap_start + k AS pos, value FROM g, (VALUES {ways}) d(dir), range(1, {offsets + 1}) o(off), range(5) x(k), s
  WHERE k < length AND s.series_id = g.series_id AND s.valid AND s.pos = g.gap_start + k + dir * off * 24 AND (s.pos < gap_start OR s.pos >= gap_end)),
w AS (SELECT gap_id, dir, off FROM h GROUP BY gap_id, dir, off, length HAVING count(*) = length),
k AS (SELECT *, count(*) OVER (PARTITION BY gap_id) AS n FROM (SELECT *, row_number() OVER (PARTITION BY gap_id, dir ORDER BY off) AS r FROM w) WHERE r <= {per})
SELECT gap_id, pos, round({fold}(value), 8) AS pred, count(*) AS "references" FROM h JOIN k USING (gap_id, dir, off) WHERE n >= {least} GROUP BY 1, 2"""


def _scaled(c: str, w: str) -> str:
    return _BASE + f", q AS (SELECT series_id, {c} AS c, {w} AS w FROM s WHERE valid GROUP BY 1) SELECT series_id, pos, CASE WHEN valid THEN round(CASE WHEN w > 0 THEN (value - c) / w ELSE value END, 8) END AS scaled FROM s JOIN q USING (series_id)"


def _first_free(n: int) -> str:
    """Earliest windows that overlap none before them, one after the other."""
    return f""", c AS (SELECT * FROM {_cand(n)}), pick AS (SELECT series_id, min(ctx_start) AS a FROM c GROUP BY 1 UNION ALL
  SELECT p.series_id, (SELECT min(c.ctx_start) FROM c WHERE c.series_id = p.series_id AND c.ctx_start >= p.a + {3 * n}) FROM pick p WHERE p.a IS NOT NULL),
free AS (SELECT c.* FROM c JOIN pick ON c.series_id = pick.series_id AND c.ctx_start = pick.a)
"""


def _rounded(*columns: str) -> str:
    return ", ".join(f"round({c}, 8) AS {c}" for c in columns)


_IQR = "quantile_cont(value, 0.75) - quantile_cont(value, 0.25)"
_PCHIP = """, a AS (SELECT gap_id, gap_start, (gap_end - gap_start + 1)::DOUBLE AS h, max(value) FILTER (pos = gap_start - 1) AS y1, max(value) FILTER (pos = gap_end) AS y2,
  gap_start - 1 - max(pos) FILTER (value IS NOT NULL AND pos < gap_start - 1) AS h0, arg_max(value, pos) FILTER (value IS NOT NULL AND pos < gap_start - 1) AS y0,
  min(pos) FILTER (value IS NOT NULL AND pos > gap_end) - gap_end AS h3, arg_min(value, pos) FILTER (value IS NOT NULL AND pos > gap_end) AS y3, gap_end FROM m GROUP BY gap_id, gap_start, gap_end),
k AS (SELECT *, (y2 - y1) / h AS s, (y1 - y0) / h0 AS s0, (y3 - y2) / h3 AS s3 FROM a),
d AS (SELECT *, CASE WHEN s * s0 > 0 THEN 3 * (h + h0) / ((2 * h + h0) / s0 + (h + 2 * h0) / s) ELSE 0 END AS d1, CASE WHEN s * s3 > 0 THEN 3 * (h + h3) / ((2 * h3 + h) / s + (h3 + 2 * h) / s3) ELSE 0 END AS d2 FROM k),
x AS (SELECT d.*, m.pos, (m.pos - d.gap_start + 1) / h AS t FROM d JOIN m USING (gap_id) WHERE side = 'G')
SELECT gap_id, pos, round(y1 + h * d1 * t + (3 * (y2 - y1) - h * (2 * d1 + d2)) * t * t + (2 * (y1 - y2) + h * (d1 + d2)) * t * t * t, 8) AS pred FROM x"""
_TEMPLATE = """, seg AS (SELECT gap_id, side, pos - min(pos) OVER (PARTITION BY gap_id, side) AS k, value, length, count(value) OVER (PARTITION BY gap_id, side) AS ok FROM m WHERE side <> 'G'),
tpl AS (SELECT gap_id, k, length, avg(value) AS v FROM seg WHERE ok = length GROUP BY 1, 2, 3),
en AS (SELECT gap_id, max(v) FILTER (k = 0) AS v0, max(v) FILTER (k = length - 1) AS v1 FROM tpl GROUP BY 1)
SELECT gap_id, pos, round(xl + (xr - xl) * (tpl.k + 1) / (tpl.length + 1) + power(sin(pi() * tpl.k / (tpl.length - 1)), 2) * (v - (v0 + (v1 - v0) * tpl.k / (tpl.length - 1))), 8) AS pred
FROM bd JOIN tpl USING (gap_id) JOIN en USING (gap_id) WHERE side = 'G' AND pos - gap_start = tpl.k"""
_Z = ", q AS (SELECT series_id, avg(value) AS a, stddev_pop(value) AS w FROM s WHERE valid GROUP BY 1), z AS (SELECT s.*, coalesce(valid AND w > 0 AND abs(value - a) / w > 2, false) AS outlier FROM s JOIN q USING (series_id))\n"
_KEYS = "WITH r AS (SELECT DISTINCT o_orderpriority AS dataset, CAST(o_custkey AS VARCHAR) AS participant, CAST(o_orderkey AS VARCHAR) AS recording FROM orders)\n"

SQL = {
    "densify_hourly": _BASE + "SELECT series_id, pos, t_ms, round(value, 8) AS value, valid FROM s",
    "recording_summary": _BASE + "SELECT series_id, count(*) AS n_samples, max(t_ms) - min(t_ms) AS duration_ms, count(*) FILTER (valid) AS n_valid, count(*) FILTER (NOT valid) AS n_invalid, round(avg(valid::INT), 8) AS valid_fraction FROM s GROUP BY 1",
    "gap_islands": _BASE + _ISLANDS + "SELECT * FROM isl",
    "gap_count": _BASE + _ISLANDS + "SELECT series_id, count(*) AS n_gaps FROM isl GROUP BY 1",
    "gap_audit": _BASE + _ISLANDS + "SELECT series_id, round(avg(valid::INT), 8) AS coverage, round(avg((value = 0)::INT) FILTER (valid), 8) AS zero_share, round(min(value) FILTER (valid), 8) AS low, round(max(value) FILTER (valid), 8) AS high, any_value(n_gaps) AS n_gaps, any_value(shortest) AS shortest, any_value(longest) AS longest FROM s LEFT JOIN (SELECT series_id, count(*) AS n_gaps, min(n) AS shortest, max(n) AS longest FROM isl GROUP BY 1) USING (series_id) GROUP BY 1",
    "gap_candidates": _BASE + f"SELECT series_id, gap_start, gap_end, ctx_start, ctx_end, {_rounded('left_share', 'right_share')} FROM {_cand(5)}",
    "hourly_candidates": _BASE + " UNION ALL ".join(f"SELECT series_id, length, gap_start, gap_end, ctx_start, ctx_end, {_rounded('left_share', 'right_share')} FROM {_cand(n, 4)}" for n in (1, 3, 8)),
    "duration_samples": "SELECT event_id, greatest(1, CAST(round_even(value / 1000 * 250, 0) AS BIGINT)) AS samples FROM events",
    "non_overlapping_first": _BASE + _first_free(5) + "SELECT series_id, gap_start, gap_end FROM free",
    "overlap_antijoin": _BASE + _first_free(12) + f"SELECT series_id, gap_start, gap_end FROM {_cand(3)} x WHERE NOT EXISTS (SELECT 1 FROM free WHERE free.series_id = x.series_id AND x.ctx_start < free.ctx_end AND x.ctx_end > free.ctx_start)",
    "runtime_context": _BASE + _ISLANDS + """, c AS (SELECT isl.*, greatest(2, n) AS c, size FROM isl JOIN (SELECT series_id, max(pos) + 1 AS size FROM s GROUP BY 1) USING (series_id)),
a AS (SELECT c.series_id, gap_start, gap_end, c.c, size, count(*) FILTER (pos < gap_start AND valid) AS lv, count(*) FILTER (pos >= gap_end AND valid) AS rv, count(*) FILTER (pos < gap_start) AS nl, count(*) FILTER (pos >= gap_end) AS nr,
  max(t_ms) FILTER (pos = gap_end) - max(t_ms) FILTER (pos = gap_start) AS duration_ms FROM c JOIN s ON s.series_id = c.series_id AND pos >= gap_start - c.c AND pos < gap_end + c.c GROUP BY ALL)
SELECT series_id, gap_start, gap_end, c AS context, lv AS left_valid, rv AS right_valid, round(lv / nullif(nl, 0), 8) AS left_share, round(rv / nullif(nr, 0), 8) AS right_share, duration_ms,
  CASE WHEN gap_start < c OR gap_end + c > size THEN 'insufficient_edge_context' WHEN lv / nl < 0.8 OR rv / nr < 0.8 THEN 'insufficient_valid_context' END AS reason FROM a""",
    "compact_windows": _BASE + f""", g AS (SELECT * FROM {_cand(5)}), k AS (SELECT g.gap_id, s.pos, s.value FROM s JOIN g ON s.series_id = g.series_id AND ((pos >= ctx_start AND pos < ctx_end)
  OR (pos - 24 >= gap_start AND pos - 24 < gap_end) OR (pos + 24 >= gap_start AND pos + 24 < gap_end) OR (pos - 48 >= gap_start AND pos - 48 < gap_end) OR (pos + 48 >= gap_start AND pos + 48 < gap_end)))
SELECT gap_id, pos, row_number() OVER (PARTITION BY gap_id ORDER BY pos) - 1 AS "at", round(value, 8) AS value FROM k""",
    "mask_artificial_gap": _BASE + _GAPS + "SELECT gap_id, series_id, pos, side, round(value, 8) AS value, round(truth, 8) AS truth, valid AS original_is_valid, side = 'G' AS is_artificial_gap FROM m",
    "impute_simple": _BASE + _GAPS + _SIMPLE + "SELECT gap_id, pos, method, round(pred, 8) AS pred FROM p",
    "impute_seasonal_median": _seasonal("median", 4, "(-1), (1)", 2, 3),
    "impute_seasonal_past_days": _seasonal("avg", 4, "(-1)", 3, 2),
    "impute_template": _BASE + _GAPS + _SIMPLE + _TEMPLATE,
    "impute_pchip": _BASE + _GAPS + _PCHIP,
    "gap_features_raw": _BASE + _GAPS + _RAW + f"SELECT gap_id, series_id, {_rounded('local_iqr', 'realized_gap_duration_ms', 'left_context_valid_fraction', 'right_context_valid_fraction', 'trend_before_r2', 'trend_after_r2', *NUMERATORS.values())} FROM f",
    "gap_features": _BASE + _GAPS + _RAW + "SELECT gap_id, " + ", ".join(f"round({NUMERATORS[n]} / greatest(local_iqr, 0.001::DOUBLE), 8) AS {n}" if n in NUMERATORS else f"round({n}, 8) AS {n}" for n in FEATURES) + " FROM f",
    "leave_gap_out_scale": _BASE + _GAPS + _SCALE + f"SELECT gap_id, {_rounded('local_iqr', 'series_iqr', 'scale')} FROM sc",
    "recording_floor": _BASE + f"SELECT series_id, CASE WHEN f > 0 THEN round(f, 8) END AS floor FROM (SELECT series_id, 0.05::DOUBLE * ({_IQR}) AS f FROM s WHERE valid GROUP BY 1)",
    "method_errors": _FULL + f"SELECT gap_id, method, {_rounded('rmse', 'mae', 'nrmse')} FROM e",
    "benchmark_record": _FULL + "SELECT gap_id, series_id, " + ", ".join(f"max(rmse) FILTER (method = '{m}') IS NOT NULL AS {m}_applicable, " + ", ".join(f"round(max({e}) FILTER (method = '{m}'), 8) AS {m}_{e}" for e in ("rmse", "mae", "nrmse")) for m in ("forward_fill", "nearest_boundary", "linear"))
    + ", " + ", ".join(f"arg_min(method, row({e}, method_ord)) FILTER ({e} IS NOT NULL) AS best_method_by_{e}" for e in ("rmse", "nrmse")) + ", count(rmse) AS n_applicable FROM e GROUP BY 1, 2",
    "best_method": _FULL + "SELECT * FROM b",
    "general_oracle": _FULL + "SELECT method, round(x, 8) AS mean_nrmse FROM (SELECT method, method_ord, avg(nrmse) AS x FROM e GROUP BY 1, 2) ORDER BY x, method_ord LIMIT 1",
    "general_oracle_macro": _FULL + "SELECT method, round(x, 8) AS mean_nrmse FROM (SELECT method, method_ord, avg(y) AS x FROM (SELECT method, method_ord, avg(nrmse) AS y FROM e GROUP BY 1, 2, series_id) GROUP BY 1, 2) ORDER BY x, method_ord LIMIT 1",
    "oracle_vs_fixed_macro": _FULL + ", o AS (SELECT series_id, method, nrmse FROM e UNION ALL SELECT series_id, 'oracle', min(nrmse) FROM e GROUP BY gap_id, series_id), y AS (SELECT series_id, method, avg(nrmse) AS x, count(nrmse) AS n FROM o GROUP BY 1, 2) SELECT series_id, method, round(x, 8) AS mean_nrmse, n FROM y UNION ALL SELECT 'macro', method, round(avg(x), 8), sum(n)::BIGINT FROM y GROUP BY method",
    "method_shares_zero_filled": _FULL + "SELECT series_id, best_method, coalesce(n, 0) AS n, round(coalesce(n, 0) / total, 8) AS share FROM (SELECT series_id, count(*) AS total FROM b GROUP BY 1) CROSS JOIN (VALUES ('forward_fill'), ('nearest_boundary'), ('linear')) v(best_method) LEFT JOIN (SELECT series_id, best_method, count(*) AS n FROM b GROUP BY 1, 2) USING (series_id, best_method)",
    "oracle_crosstab": _FULL + "SELECT series_id, " + ", ".join(f"round(avg((best_method = '{m}')::INT), 8) AS {m}" for m in ("forward_fill", "nearest_boundary", "linear")) + " FROM b GROUP BY 1",
    "rank_candidates": _FULL + "SELECT gap_id, method, row_number() OVER (PARTITION BY gap_id ORDER BY nrmse, method_ord) AS rank FROM e WHERE nrmse IS NOT NULL",
    "select_challenger": _FULL + ", q AS (SELECT e.gap_id, e.method, l.nrmse - e.nrmse AS gain, l.nrmse - e.nrmse - 0.1::DOUBLE * e.nrmse AS bound FROM e JOIN e l ON l.gap_id = e.gap_id AND l.method = 'linear'), o AS (SELECT *, row_number() OVER (PARTITION BY gap_id ORDER BY bound DESC, method DESC) AS r FROM q WHERE method <> 'linear' AND gain >= 0 AND bound > 0) SELECT g.gap_id, coalesce(method, 'linear') AS method, CASE WHEN method IS NULL THEN 'retain_pchip_no_challenger_passed' ELSE 'switch_highest_lcb' END AS reason, round(bound, 8) AS score FROM g LEFT JOIN (SELECT * FROM o WHERE r = 1) o USING (gap_id)",
    "fold_scale_floors": _BASE + _GAPS + f", y AS ({_LOCAL}) SELECT held_out, round(quantile_cont(local_iqr, 0.01), 8) AS floor, count(*) AS n FROM y JOIN (SELECT DISTINCT series_id AS held_out FROM y) ON series_id <> held_out WHERE local_iqr > 0 GROUP BY 1",
    "decisions": _FULL + _DEC + f"SELECT gap_id, series_id, selected_method, oracle_method, {_rounded('selected_nrmse', 'baseline_nrmse', 'oracle_nrmse')}, round(baseline_nrmse - selected_nrmse, 8) AS improvement, round(selected_nrmse - oracle_nrmse, 8) AS regret, selected_method = oracle_method AS oracle_match, CASE WHEN selected_nrmse < baseline_nrmse - 1e-12 THEN 'better' WHEN selected_nrmse > baseline_nrmse + 1e-12 THEN 'worse' ELSE 'equal' END AS outcome FROM d",
    "decision_summary": _FULL + _DEC + ", y AS (SELECT series_id, count(*) AS n, avg(selected_nrmse) AS selected_nrmse, avg(baseline_nrmse) AS baseline_nrmse, avg(oracle_nrmse) AS oracle_nrmse, avg(selected_nrmse - oracle_nrmse) AS regret, avg((selected_method = oracle_method)::INT) AS match_rate FROM d GROUP BY 1), z AS (SELECT *, 100 * (baseline_nrmse - selected_nrmse) / baseline_nrmse AS improvement_percent FROM y), u AS (SELECT * FROM z UNION ALL SELECT 'macro', sum(n)::BIGINT, avg(selected_nrmse), avg(baseline_nrmse), avg(oracle_nrmse), avg(regret), avg(match_rate), avg(improvement_percent) FROM z) SELECT series_id, n, " + _rounded("selected_nrmse", "baseline_nrmse", "oracle_nrmse", "regret", "match_rate", "improvement_percent") + " FROM u",
    "selection_metrics": _FULL + _DEC + """, t AS (SELECT *, baseline_nrmse - selected_nrmse AS gain, selected_method <> 'linear' AS sw, baseline_nrmse - oracle_nrmse > 0 AS mean FROM d)
SELECT count(*) AS n_gaps, round(avg(selected_nrmse), 8) AS mean_nrmse, round(avg(gain), 8) AS mean_improvement_vs_default, round((avg(baseline_nrmse) - avg(selected_nrmse)) / avg(baseline_nrmse), 8) AS relative_improvement_vs_default, round(avg(selected_nrmse - oracle_nrmse), 8) AS mean_regret_vs_oracle,
  round(avg(sw::INT), 8) AS switch_rate, round(1 - avg(sw::INT), 8) AS retain_default_rate, round(avg((gain > 0)::INT) FILTER (sw), 8) AS switch_precision, round(avg(sw::INT) FILTER (mean), 8) AS switch_recall, round(avg((sw AND gain <= 0)::INT), 8) AS false_switch_rate, round(avg((NOT sw AND mean)::INT), 8) AS missed_opportunity_rate,
  round(coalesce(avg(-gain) FILTER (sw AND gain <= 0), 0), 8) AS mean_false_switch_damage, round(coalesce(median(-gain) FILTER (sw AND gain <= 0), 0), 8) AS median_false_switch_damage, round(coalesce(quantile_cont(-gain, 0.9) FILTER (sw AND gain <= 0), 0), 8) AS p90_false_switch_damage,
  round(coalesce(max(-gain) FILTER (sw AND gain <= 0), 0), 8) AS max_false_switch_damage, round(coalesce(avg(gain) FILTER (sw AND gain > 0), 0), 8) AS mean_successful_switch_benefit, round(coalesce(sum(gain) FILTER (sw), 0) / count(*), 8) AS net_benefit_per_gap FROM t""",
    "outlier_iqr": _BASE + ", q AS (SELECT series_id, quantile_cont(value, 0.25) AS lo, quantile_cont(value, 0.75) AS hi FROM s WHERE valid GROUP BY 1) SELECT series_id, pos FROM s JOIN q USING (series_id) WHERE valid AND hi > lo AND (value < lo - 1.5::DOUBLE * (hi - lo) OR value > hi + 1.5::DOUBLE * (hi - lo))",
    "outlier_zscore": _BASE + _Z + "SELECT series_id, pos FROM z WHERE outlier",
    "outlier_regions": _BASE + _Z + f"SELECT series_id, min(pos) AS gap_start, max(pos) + 1 AS gap_end, count(*) AS n, row_number() OVER (PARTITION BY series_id ORDER BY min(pos)) AS region FROM (SELECT series_id, pos, pos - row_number() OVER ({_W}) AS run FROM z WHERE outlier) GROUP BY series_id, run",
    "standardize_zscore": _scaled("avg(value)", "stddev_pop(value)"),
    "standardize_robust": _scaled("median(value)", _IQR),
    "standardize_minmax": _scaled("min(value)", "max(value) - min(value)"),
    "participant_splits": _KEYS + """, k AS (SELECT dataset, participant, row_number() OVER (ORDER BY sha256('42|' || dataset || '|' || participant), dataset, participant) AS k FROM (SELECT DISTINCT dataset, participant FROM r)),
n AS (SELECT count(*) AS n FROM k), p AS (SELECT i, n, n * share AS raw, floor(n * share) AS b FROM n, (VALUES (0, 0.7::DOUBLE), (1, 0.15::DOUBLE), (2, 0.15::DOUBLE)) v(i, share)),
c AS (SELECT i, b + (row_number() OVER (ORDER BY raw - b DESC, i) <= n - sum(b) OVER ())::INT AS c FROM p)
SELECT dataset, participant, CASE WHEN k <= (SELECT c FROM c WHERE i = 0) THEN 'train' WHEN k <= (SELECT sum(c) FROM c WHERE i < 2) THEN 'validation' ELSE 'test' END AS split FROM k""",
    "balanced_recordings": _KEYS + """, e AS (SELECT dataset, participant FROM r GROUP BY 1, 2 HAVING count(*) >= 2),
w AS (SELECT dataset, participant FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY sha256('42|' || dataset || '|' || participant), participant) AS k, count(*) OVER (PARTITION BY dataset) AS n FROM e) WHERE k <= 20 AND n >= 20)
SELECT dataset, participant, recording FROM (SELECT r.*, row_number() OVER (PARTITION BY dataset, participant ORDER BY sha256('43|' || dataset || '|' || participant || '|' || recording), recording) AS k FROM r JOIN w USING (dataset, participant)) WHERE k <= 2""",
    "identity_seeds": """SELECT o_orderkey, substr(sha256('["42","' || o_orderkey || '","' || o_orderpriority || '"]'), 1, 16) AS seed FROM orders""",
}
