"""DuckDB SQL for the panel, feature and evaluation queries."""

import re

from gapseries.operators.features import OPTICAL

_OPT = " AND ".join(f"{b} IS NOT NULL" for b in OPTICAL)
_E = "l_suppkey * 10000 + year(l_shipdate)"
_F = "FILTER (WHERE l_returnflag = 'N')"
_OBS = f"""obs AS (SELECT {_E} AS entity_id, month(l_shipdate)::INT AS month, -avg(l_extendedprice) / 1000 AS VH, avg(l_quantity) AS VV,
 avg(l_discount) {_F} * 100 + 1 AS blue, avg(l_tax) {_F} * 100 + 1 AS green, avg(l_quantity) {_F} AS nir, max(l_quantity) {_F} AS nira, min(l_quantity) {_F} + 1 AS re1,
 avg(l_linenumber) {_F} AS re2, sum(l_quantity) {_F} / 10 AS re3, avg(l_extendedprice) {_F} / 1000 AS red, max(l_extendedprice) {_F} / 1000 AS swir1, min(l_extendedprice) {_F} / 1000 AS swir2
 FROM lineitem GROUP BY ALL)"""
_LAB = f"lab AS (SELECT {_E} AS entity_id, (round(avg(l_tax), 9) > 0.04)::INT AS label FROM lineitem GROUP BY 1)"
_PANEL = f"""{_OBS}, panel AS (SELECT * FROM (SELECT DISTINCT entity_id FROM obs) CROSS JOIN (SELECT unnest(range(1, 13))::INT AS month) LEFT JOIN obs USING (entity_id, month))"""
_WIN = """win AS (SELECT (row_number() OVER (ORDER BY n, s) - 1)::INT AS window_index, n::INT AS window_length, s::INT AS window_start, (s + n - 1)::INT AS window_end FROM (SELECT unnest([4, 5, 6]) AS n), LATERAL (SELECT unnest(range(1, 14 - n)) AS s))"""
_VIEWS = f"""{_PANEL}, {_WIN}, views AS (SELECT *, month - window_start + 1 AS pos, entity_id || ':' || window_length || ':' || window_start AS window_id FROM panel JOIN win ON month BETWEEN window_start AND window_end)"""


def _u(*parts: str) -> str:
    return "(('0x' || substr(md5(" + " || '|' || ".join(f"({p})::VARCHAR" for p in parts) + "), 1, 8))::UBIGINT / 4294967296.0)"


def _div(a: str, b: str) -> str:
    return f"CASE WHEN abs({b}) > 1e-6 THEN ({a}) / ({b}) END"


def _nd(a: str, b: str) -> str:
    return _div(f"{a} - {b}", f"{a} + {b}")


_ROLE = {"nira": "narrow_nir", "re1": "red_edge_1", "re2": "red_edge_2", "re3": "red_edge_3"}
_CH = {
    "radar__vv": "VV", "radar__vh": "VH", "radar__vv_minus_vh": "VV - VH", "radar__vv_plus_vh": "VV + VH", "radar__vv_over_abs_vh": _div("VV", "abs(VH)"), "radar__vh_over_abs_vv": _div("VH", "abs(VV)"),
    **{f"optical__{_ROLE.get(b, b)}": b for b in OPTICAL},
    "optical__ndvi": _nd("nir", "red"), "optical__ndwi": _nd("green", "nir"), "optical__mndwi": _nd("green", "swir1"), "optical__ndmi": _nd("nir", "swir1"), "optical__nbr": _nd("nir", "swir2"),
    "optical__ndre1": _nd("nira", "re1"), "optical__ndre2": _nd("nira", "re2"), "optical__chlorophyll_red_edge": f"({_div('nira', 're1')}) - 1", "optical__nir_over_swir1": _div("nir", "swir1"), "optical__nir_over_swir2": _div("nir", "swir2"),
    "optical__green_over_swir1": _div("green", "swir1"), "optical__green_over_swir2": _div("green", "swir2"), "optical__green_red_contrast": _nd("green", "red"), "optical__blue_green_contrast": _nd("blue", "green"),
}


def _channels(source: str, key: str, pos: str) -> str:
    w = f"OVER (PARTITION BY {key} ORDER BY {pos})"
    return f"ch AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _CH.items())}, VV - lag(VV) {w} AS radar__vv_first_difference, VH - lag(VH) {w} AS radar__vh_first_difference FROM {source})"


_NAMES = [*_CH, "radar__vv_first_difference", "radar__vh_first_difference"]


def _stats(pos: str) -> str:
    q = lambda f: f"quantile_cont(x, {f})"
    two = lambda e: f"CASE WHEN count(x) >= 2 THEN {e} END"
    first, last = (f"{f}(x, {pos}) FILTER (WHERE x IS NOT NULL)" for f in ("arg_min", "arg_max"))
    cols = {"mean": "avg(x)", "median": q(0.5), "std": two("stddev_pop(x)"), "min": "min(x)", "max": "max(x)", "amplitude": two("max(x) - min(x)"), "p25": q(0.25), "p75": q(0.75), "iqr": two(f"{q(0.75)} - {q(0.25)}"), "first": first, "last": last, "first_to_last": two(f"({last}) - ({first})"), "slope": two(f"regr_slope(x, {pos})")}
    return "count(x) AS valid_count, " + ", ".join(f'round({e}, 6) + 0.0 AS "{n}"' for n, e in cols.items())


def _long(names: list[str], keys: str, pos: str) -> str:
    return "long AS (" + " UNION ALL ".join(f"SELECT {keys}, {pos} AS pos, '{n}' AS channel, {n} AS x FROM ch" for n in names) + ")"


def _wide(f: str) -> str:
    return ", ".join(f.format(b=b, m=m, c=f"{b}_{m:02d}") for m in range(1, 13) for b in ("VH", "VV", *OPTICAL))


_WIDE = f"""{_OBS}, wide AS (SELECT entity_id, {_wide("coalesce(max({b}) FILTER (WHERE month = {m}), -9999.0) AS {c}")} FROM obs GROUP BY 1)"""
_BITS = f"""{_PANEL}, b AS (SELECT entity_id, string_agg(CASE WHEN VV IS NOT NULL AND VH IS NOT NULL THEN '1' ELSE '0' END, '' ORDER BY month) AS radar_bits, string_agg(CASE WHEN {_OPT} THEN '1' ELSE '0' END, '' ORDER BY month) AS optical_bits FROM panel GROUP BY 1),
f AS (SELECT *, instr(radar_bits, '1')::INT AS first_month, (13 - instr(reverse(radar_bits), '1'))::INT AS last_month FROM b WHERE contains(radar_bits, '1')),
ow AS (SELECT *, last_month - first_month + 1 AS window_length, length(replace(radar_bits, '0', ''))::INT = last_month - first_month + 1 AS consecutive,
  length(replace(substr(optical_bits, first_month, last_month - first_month + 1), '0', ''))::INT AS optical_inside,
  (length(replace(optical_bits, '0', '')) - length(replace(substr(optical_bits, first_month, last_month - first_month + 1), '0', '')))::INT AS optical_outside,
  len(list_filter(range(1, 13), lambda i: substr(radar_bits, i, 1) = '1' AND substr(optical_bits, i, 1) = '0'))::INT AS gaps FROM f)"""
_LIB = f"{_BITS}, lib AS (SELECT sha256(radar_bits || '|' || optical_bits) AS mask_id, radar_bits, optical_bits, count(*) AS frequency FROM ow GROUP BY 2, 3)"
_FOLDS = f"""fr AS (SELECT entity_id, label, r::INT AS repeat, {_u("42 + 10007 * r", "entity_id")} AS u FROM lab, (SELECT unnest(range(3)) AS r)),
fo AS (SELECT entity_id, label, repeat, ((row_number() OVER (PARTITION BY repeat, label ORDER BY u, entity_id) - 1) % 5)::INT AS fold FROM fr)"""
_SIG = lambda x: f"1 / (1 + exp(-({x})))"
_PRED = f"""{_VIEWS}, {_LAB}, {_FOLDS}, pw AS (SELECT entity_id, window_length, window_start, avg(VV) AS a, avg(VH) AS b, count(VV) AS radar_months, count(*) FILTER (WHERE {_OPT}) AS optical_months,
  CASE WHEN entity_id % 7 < 4 THEN 0.3::DOUBLE ELSE -0.3::DOUBLE END AS s FROM views GROUP BY ALL HAVING avg(VV) IS NOT NULL),
pred AS (SELECT entity_id, repeat, fold, label, window_length, window_start, radar_months, optical_months, radar_months - optical_months AS gaps,
  round({_SIG("(2 * label - 1) * (s + 0.2::DOUBLE) + (a - 25) / 8")}, 6) AS p1, round({_SIG("(2 * label - 1) * 0.4::DOUBLE + (b + 38) / 9")}, 6) AS p2 FROM pw JOIN fo USING (entity_id) WHERE repeat < 2),
orig AS (SELECT entity_id, repeat, fold, label, round(avg(p1) + 1e-12, 9) AS p1, round(avg(p2) + 1e-12, 9) AS p2 FROM pred GROUP BY ALL),
o0 AS (SELECT * FROM orig WHERE repeat = 0)"""


def _metrics(source: str, keys: str, p: str, digits: int = 6, only: str = "*") -> str:
    """Metrics of source by keys as SELECT; the AUC by midranks."""
    q = f"least(greatest({p}, 2.220446049250313e-16), 1 - 2.220446049250313e-16)"
    return f"""SELECT {only} FROM (SELECT {keys}, n, positives, tp, fp, fn, tn, round(f1, {digits}) AS f1, round(auc, {digits}) AS auc, round(0.6 * f1 + 0.4 * auc, {digits}) AS combined, round(log_loss, {digits}) AS log_loss, round(brier, {digits}) AS brier, round((tp + tn) / n, {digits}) AS accuracy, round((tp + fp) / n, {digits}) AS positive_prediction_rate FROM (
  SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1, CASE WHEN positives > 0 AND positives < n THEN (rs - positives * (positives + 1) / 2.0) / (positives * (n - positives)) END AS auc FROM (
  SELECT {keys}, count(*) AS n, count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 1 AND {p} >= 0.5) AS tp, count(*) FILTER (WHERE label = 0 AND {p} >= 0.5) AS fp,
    count(*) FILTER (WHERE label = 1 AND {p} < 0.5) AS fn, count(*) FILTER (WHERE label = 0 AND {p} < 0.5) AS tn, sum(mr) FILTER (WHERE label = 1) AS rs,
    avg(-CASE WHEN label = 1 THEN ln({q}) ELSE ln(1 - {q}) END) AS log_loss, avg(({p} - label) ** 2) AS brier
  FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY {p}) + (count(*) OVER (PARTITION BY {keys}, {p}) - 1) / 2.0 AS mr FROM {source}) GROUP BY {keys})))"""


def _pairwise(source: str, keys: str) -> str:
    n = lambda c: f"count(*) FILTER (WHERE {c})"
    rank = lambda p: f"rank() OVER (PARTITION BY {keys} ORDER BY {p}) + (count(*) OVER (PARTITION BY {keys}, {p}) - 1) / 2.0"
    return f"""SELECT {keys}, count(*) AS n, round(corr(p1, p2), 6) AS pearson, round(corr(r1, r2), 6) AS spearman, round(corr(label - p1, label - p2), 6) AS residual_corr, round(avg((u <> v)::INT), 6) AS disagreement,
  round(avg((u <> v)::INT) FILTER (WHERE label = 1), 6) AS disagreement_positives, {n('NOT ea AND eb')} AS only_first_correct, {n('ea AND NOT eb')} AS only_second_correct, {n('label = 1 AND u AND NOT v')} AS unique_tp_first, {n('label = 1 AND v AND NOT u')} AS unique_tp_second,
  {n('label = 0 AND u AND NOT v')} AS unique_fp_first, {n('label = 0 AND v AND NOT u')} AS unique_fp_second, {n('ea AND eb')} AS shared_errors, {n('ea OR eb')} AS any_error, round(CASE WHEN {n('ea OR eb')} = 0 THEN 1.0 ELSE {n('ea AND eb')} / {n('ea OR eb')} END, 6) AS error_jaccard
  FROM (SELECT *, p1 >= 0.5 AS u, p2 >= 0.5 AS v, ((p1 >= 0.5)::INT <> label) AS ea, ((p2 >= 0.5)::INT <> label) AS eb, {rank('p1')} AS r1, {rank('p2')} AS r2 FROM {source}) GROUP BY {keys}"""


_DOM = f"""{_PANEL}, dom AS (SELECT (entity_id % 10000 >= 2001)::INT AS domain, f.feature, round(f.x, 6) AS x FROM panel, LATERAL (SELECT unnest([{{'feature': 'VH', 'x': VH}}, {{'feature': 'VV', 'x': VV}}, {{'feature': 'blue', 'x': blue}}, {{'feature': 'green', 'x': green}}, {{'feature': 'nir', 'x': nir}}, {{'feature': 'nira', 'x': nira}}, {{'feature': 're1', 'x': re1}}, {{'feature': 're2', 'x': re2}}, {{'feature': 're3', 'x': re3}}, {{'feature': 'red', 'x': red}}, {{'feature': 'swir1', 'x': swir1}}, {{'feature': 'swir2', 'x': swir2}}]) AS f)), dv AS (SELECT * FROM dom WHERE x IS NOT NULL)"""
_SLICED = """sl AS (SELECT repeat, entity_id, label, p1, unnest(list_filter([
  {'g': 'window_length', 'v': window_length::VARCHAR}, {'g': 'start_month', 'v': window_start::VARCHAR}, {'g': 'season', 'v': CASE WHEN window_start <= 3 THEN '01-03' WHEN window_start <= 6 THEN '04-06' ELSE '07-09' END},
  {'g': 'optical_gaps', 'v': CASE WHEN gaps = 0 THEN '0' WHEN gaps = 1 THEN '1' ELSE '2+' END},
  {'g': 'optical_proportion', 'v': CASE WHEN 2 * optical_months < window_length THEN 'lt50' WHEN 10 * optical_months < 8 * window_length THEN '50to80' WHEN optical_months < window_length THEN '80to100' ELSE '100' END},
  {'g': CASE WHEN radar_months = window_length THEN 'availability' END, 'v': 'radar_complete'}, {'g': CASE WHEN optical_months = window_length THEN 'availability' END, 'v': 'optical_complete'},
  {'g': CASE WHEN optical_months = 0 THEN 'availability' END, 'v': 'radar_only'}, {'g': CASE WHEN 2 * optical_months < window_length THEN 'availability' END, 'v': 'severely_limited'}], lambda x: x.g IS NOT NULL)) AS s FROM pred),
so AS (SELECT repeat, s.g AS slice_group, s.v AS slice_value, entity_id, label, round(avg(p1) + 1e-12, 9) AS p FROM sl GROUP BY ALL)"""
_META = ", ".join([f"sum(r)::BIGINT AS {b}_valid_count" for b in ("vh", "vv")] + [f"count({b}) AS {_ROLE.get(b, b)}_valid_count" for b in OPTICAL])
_POS = ", ".join(f"coalesce(max(CASE WHEN pos = {k} THEN r END), 0) AS position_{k:02d}_radar_valid, coalesce(max(CASE WHEN pos = {k} THEN o END), 0) AS position_{k:02d}_optical_valid, (window_length < {k})::INT AS position_{k:02d}_padding" for k in range(1, 7))


def _run(flag: str, name: str) -> str:
    return f"{name} AS (SELECT window_id, max(c) AS {name} FROM (SELECT window_id, count(*) FILTER (WHERE {flag}) AS c FROM (SELECT *, sum((NOT ({flag}))::INT) OVER (PARTITION BY window_id ORDER BY pos) AS g FROM mv) GROUP BY window_id, g) GROUP BY 1)"


ORACLES: dict[str, str] = {
    "panel_aggregates_14": f"WITH {_PANEL}, {_channels('panel', 'entity_id', 'month')}, {_long(['optical__ndvi'], 'entity_id', 'month')} SELECT entity_id, {_stats('pos')} FROM long GROUP BY 1",
    "panel_long": f"WITH {_OBS} SELECT entity_id, month, {', '.join(f'round({b}, 6) + 0.0 AS {b}' for b in ('VH', 'VV', *OPTICAL))} FROM obs",
    "panel_wide": f"WITH {_WIDE} SELECT entity_id, {_wide('round({c}, 6) + 0.0 AS {c}')} FROM wide",
    "panel_unpivot": f"WITH {_PANEL} SELECT entity_id, month, {', '.join(f'round({b}, 6) + 0.0 AS {b}' for b in ('VH', 'VV', *OPTICAL))} FROM panel",
    "sentinel_counts": f"WITH {_PANEL}, m AS (SELECT entity_id, sum({' + '.join(f'({b} IS NULL)::INT' for b in ('VH', 'VV', *OPTICAL))}) AS k FROM panel GROUP BY 1) SELECT count(*) AS rows, count(*) * 144 AS cells, sum(k)::BIGINT AS missing_cells, count(*) FILTER (WHERE k > 0) AS rows_with_missing FROM m",
    "schema_checks": "SELECT count(*) AS rows, 0::BIGINT AS null_ids, 0::BIGINT AS repeated_ids, 0::BIGINT AS bad_rows, 0::BIGINT AS bad_labels FROM (SELECT DISTINCT l_suppkey, year(l_shipdate) FROM lineitem)",
    "availability_by_month": f"WITH {_PANEL} SELECT month, count(*) AS rows, count(*) FILTER (WHERE VV IS NOT NULL AND VH IS NOT NULL) AS radar_all, count(*) FILTER (WHERE {_OPT}) AS optical_all, count(*) FILTER (WHERE coalesce({', '.join(OPTICAL)}) IS NOT NULL) AS optical_any, count(*) FILTER (WHERE coalesce({', '.join(OPTICAL)}) IS NOT NULL AND NOT ({_OPT})) AS optical_partial FROM panel GROUP BY 1",
    "missingness_sets": f"WITH {_PANEL}, c AS ({' UNION ALL '.join(f'''SELECT month, '{b}' AS band, '{'radar' if b in ('VH', 'VV') else 'optical'}' AS sensor, {b} IS NULL AS missing FROM panel''' for b in ('VH', 'VV', *OPTICAL))}) SELECT CASE WHEN band IS NOT NULL THEN 'band' WHEN month IS NOT NULL THEN 'month' WHEN sensor IS NOT NULL THEN 'sensor' ELSE 'all' END AS level, coalesce(band, month::VARCHAR, sensor, 'all') AS key, count(*) AS observations, count(*) FILTER (WHERE missing) AS missing, round(count(*) FILTER (WHERE missing) / count(*), 6) AS rate FROM c GROUP BY GROUPING SETS ((band), (month), (sensor), ())",
    "observed_windows": f"WITH {_BITS} SELECT entity_id, radar_bits, optical_bits, first_month, last_month, window_length, consecutive, optical_inside, optical_outside, gaps FROM ow",
    "window_distributions": f"WITH {_BITS} SELECT window_length, first_month, gaps, n, round(n / sum(n) OVER (PARTITION BY g), 6) AS share FROM (SELECT window_length, first_month, gaps, count(*) AS n, grouping(window_length, first_month, gaps) AS g FROM ow GROUP BY GROUPING SETS ((window_length), (window_length, first_month), (window_length, gaps)))",
    "mask_library": f"WITH {_LIB} SELECT * FROM lib",
    "windows_24": f"WITH {_WIN} SELECT * FROM win",
    "views_exhaustive": f"WITH {_VIEWS} SELECT entity_id, window_id, window_length, window_start, count(VV) AS radar_months, count(*) FILTER (WHERE {_OPT}) AS optical_months, count(*) FILTER (WHERE VV IS NOT NULL AND NOT ({_OPT})) AS gaps FROM views GROUP BY ALL",
    "views_sampled": f"WITH {_LIB}, {_LAB}, cum AS (SELECT mask_id, sum(frequency) OVER w / sum(frequency) OVER () AS hi, (sum(frequency) OVER w - frequency) / sum(frequency) OVER () AS lo FROM lib WINDOW w AS (ORDER BY mask_id ROWS UNBOUNDED PRECEDING)), dr AS (SELECT entity_id, i::INT AS view_index, {_u('42', 'entity_id', 'i')} AS u FROM lab, (SELECT unnest(range(8)) AS i)) SELECT entity_id, view_index, mask_id FROM dr JOIN cum ON u >= lo AND u < hi",
    "views_dropout": f"WITH {_VIEWS} SELECT window_id, count(*) AS kept_months, count(VV) AS radar_months FROM views WHERE {_u(chr(39) + 'drop' + chr(39), 'window_id', 'month')} >= 0.1 GROUP BY 1",
    "channels_32": f"WITH {_PANEL}, {_channels('panel', 'entity_id', 'month')} SELECT entity_id, month, {', '.join(f'round({n}, 6) + 0.0 AS {n}' for n in _NAMES)} FROM ch",
    "safe_divide_edges": "SELECT * FROM (VALUES (0, NULL::DOUBLE), (1, NULL), (2, -0.5), (3, NULL), (4, NULL), (5, -2.0)) t(i, q)",
    "window_aggregates": f"WITH {_VIEWS}, {_channels('views', 'window_id', 'pos')}, {_long(_NAMES, 'window_id', 'pos')} SELECT window_id, channel, {_stats('pos')} FROM long GROUP BY 1, 2",
    "aggregates_all_channels": f"WITH {_PANEL}, {_channels('panel', 'entity_id', 'month')}, {_long(_NAMES, 'entity_id', 'month')} SELECT entity_id, channel, {_stats('pos')} FROM long GROUP BY 1, 2",
    "mean_abs_difference": f"WITH {_VIEWS}, {_channels('views', 'window_id', 'pos')} SELECT window_id, round(avg(abs(radar__vv_first_difference)), 6) AS vv_mean_abs_first_difference, round(avg(abs(radar__vh_first_difference)), 6) AS vh_mean_abs_first_difference FROM ch GROUP BY 1",
    "metadata_46": f"""WITH {_VIEWS}, mv AS (SELECT *, (VV IS NOT NULL AND VH IS NOT NULL)::INT AS r, ({_OPT})::INT AS o FROM views), {_run("o = 1", "ov")}, {_run("r = 1 AND o = 0", "om")},
g AS (SELECT entity_id, window_id, window_length, window_start, window_end, {_META}, count(*)::INT AS relative_position_count, sum(r)::INT AS radar_valid_count, sum(o)::INT AS optical_valid_count,
  (2 * sum(r) + {" + ".join(f"count({b})" for b in OPTICAL)})::BIGINT AS total_valid_band_count, count(*) FILTER (WHERE r = 1 AND o = 0)::INT AS optical_gap_count, round(sum(r) / window_length, 6) AS radar_valid_proportion,
  round(({" + ".join(f"count({b})" for b in OPTICAL)}) / (window_length * 10), 6) AS optical_valid_proportion, {_POS} FROM mv GROUP BY entity_id, window_id, window_length, window_start, window_end)
SELECT g.*, ov AS longest_optical_valid_run, om AS longest_optical_missing_run, {", ".join(f"round({f}((window_{w} - 1) * (2 * pi() / 12)), 6) + 0.0 AS {w}_month_{f}" for w in ("start", "end") for f in ("sin", "cos"))} FROM g JOIN ov USING (window_id) JOIN om USING (window_id)""",
    "relative_positions_wide": f"WITH {_VIEWS}, {_channels('views', 'window_id', 'pos')} SELECT window_id, {', '.join(f'round(max(CASE WHEN pos = {k} THEN {n} END), 6) + 0.0 AS relative__position_{k:02d}__{n}' for k in range(1, 7) for n in _NAMES)} FROM ch GROUP BY 1",
    "sequence_arrays": f"WITH {_VIEWS}, {_channels('views', 'window_id', 'pos')}, {_long(_NAMES, 'window_id', 'pos')} SELECT window_id, channel, [{', '.join(f'round(max(CASE WHEN pos = {k} THEN x END), 6) + 0.0' for k in range(1, 7))}] AS values, [{', '.join(f'count(CASE WHEN pos = {k} THEN x END) > 0' for k in range(1, 7))}] AS mask, [{', '.join(f'count(CASE WHEN pos = {k} THEN 1 END) = 0' for k in range(1, 7))}] AS padding FROM long GROUP BY 1, 2",
    "folds_repeated": f"WITH {_LAB}, {_FOLDS} SELECT * FROM fo",
    "fold_balance": f"WITH {_LAB}, {_FOLDS}, g AS (SELECT repeat, fold, count(*) AS validation_n, sum(label)::BIGINT AS validation_positives FROM fo GROUP BY 1, 2) SELECT *, (sum(validation_n) OVER (PARTITION BY repeat) - validation_n)::BIGINT AS train_n, (sum(validation_positives) OVER (PARTITION BY repeat) - validation_positives)::BIGINT AS train_positives FROM g",
    "fold_leaks": f"WITH {_LAB}, {_FOLDS} SELECT repeat, entity_id, count(DISTINCT fold) AS folds FROM fo GROUP BY 1, 2 HAVING count(DISTINCT fold) > 1",
    "sample_weights": f"WITH {_PRED}, c AS (SELECT label, count(DISTINCT entity_id) AS n, sum(count(DISTINCT entity_id)) OVER () AS t FROM pred WHERE repeat = 0 GROUP BY 1) SELECT entity_id, window_length, window_start, round(1.0 / count(*) OVER (PARTITION BY entity_id), 6) AS equal_weight, round(t / (2 * n), 6) AS class_weight FROM pred JOIN c USING (label) WHERE repeat = 0",
    "oof_aggregation": f"WITH {_PRED}, l AS (SELECT *, least(greatest(p1, 1e-6), 1 - 1e-6) AS q, row_number() OVER (PARTITION BY repeat, entity_id ORDER BY p1) AS i, count(*) OVER (PARTITION BY repeat, entity_id) AS n FROM pred) SELECT repeat, entity_id, round(avg(p1), 5) AS mean, round(quantile_cont(p1, 0.5), 5) AS median, round(1 / (1 + exp(-avg(ln(q / (1 - q))))), 5) AS logit_mean, round(avg(p1) FILTER (WHERE i > floor(n * 0.25) AND i <= n - floor(n * 0.25)), 5) AS trimmed_mean FROM l GROUP BY 1, 2",
    "stability": f"WITH {_PRED}, g AS (SELECT repeat, entity_id, label, count(*) AS n, avg(p1) AS m, stddev_pop(p1) AS sd, min(p1) AS lo, max(p1) AS hi, avg((p1 >= 0.5)::INT) AS sp FROM pred GROUP BY 1, 2, 3) SELECT repeat, entity_id, label, n, round(m, 5) AS p_mean, round(sd, 5) AS p_std, round(lo, 5) AS p_min, round(hi, 5) AS p_max, round(sp, 5) AS share_positive, round(hi - lo, 5) AS p_range, round(least(sp, 1 - sp), 5) AS instability, ((m >= 0.5)::INT <> label)::INT AS is_error FROM g",
    "metrics_repeat": f"WITH {_PRED} {_metrics('orig', 'repeat', 'p1')}",
    "metrics_repeat_fold": f"WITH {_PRED} {_metrics('orig', 'repeat, fold', 'p1')}",
    "slice_metrics": f"WITH {_PRED}, {_SLICED} {_metrics('so', 'repeat, slice_group, slice_value', 'p')}",
    "level_metrics": f"WITH {_PRED}, {_SLICED}, lm AS (SELECT repeat, 'repeat' AS level, 'all' AS value, entity_id, label, p1 AS p FROM orig UNION ALL SELECT repeat, 'fold', fold::VARCHAR, entity_id, label, p1 FROM orig UNION ALL SELECT repeat, slice_group, slice_value, entity_id, label, p FROM so) {_metrics('lm', 'repeat, level, value', 'p')}",
    "robust_score": f"WITH {_PRED}, {_SLICED}, mr AS ({_metrics('orig', 'repeat', 'p1', 12)}), mf AS ({_metrics('orig', 'repeat, fold', 'p1', 12)}), ms AS ({_metrics('so', 'repeat, slice_group, slice_value', 'p', 12)}), sm AS (SELECT slice_group, slice_value, avg(combined) AS m FROM ms GROUP BY 1, 2), v AS (SELECT (SELECT avg(combined) FROM mr) AS a, (SELECT min(combined) FROM mf) AS b, (SELECT min(m) FROM sm WHERE slice_group = 'window_length') AS c, (SELECT min(m) FROM sm WHERE slice_group = 'season') AS d) SELECT round(a, 6) AS repeat_mean, round(b, 6) AS worst_fold, round(c, 6) AS worst_length, round(d, 6) AS worst_season, round(0.5 * a + 0.2 * b + 0.15 * c + 0.15 * d, 6) AS robust FROM v",
    "pairwise_diversity": f"WITH {_PRED} {_pairwise('orig', 'repeat')}",
    "blend_grid": f"WITH {_PRED}, bw AS (SELECT *, round((100 - wi)::DOUBLE / 100 * p1 + wi::DOUBLE / 100 * p2, 12) AS p FROM orig, (SELECT unnest(range(101))::INT AS wi)) SELECT *, wi::DOUBLE / 100 AS weight FROM ({_metrics('bw', 'repeat, wi', 'p')})",
    "nested_weights": f"WITH {_PRED}, fs AS (SELECT DISTINCT repeat, fold AS held FROM orig), bw AS (SELECT orig.repeat, held, wi, label, round((100 - wi)::DOUBLE / 100 * p1 + wi::DOUBLE / 100 * p2, 12) AS p FROM orig JOIN fs ON fold <> held AND orig.repeat = fs.repeat, (SELECT unnest(range(101))::INT AS wi)), m AS ({_metrics('bw', 'repeat, held, wi', 'p', 12)}) SELECT repeat, held AS fold, wi::DOUBLE / 100 AS weight, round(f1, 6) AS f1, round(brier, 6) AS brier FROM m QUALIFY row_number() OVER (PARTITION BY repeat, held ORDER BY round(combined, 9) DESC, round(brier, 9), abs(wi::DOUBLE / 100 - 0.5), round(log_loss, 9), wi) = 1",
    "calibration_apply": f"WITH {_PRED}, q AS (SELECT entity_id, repeat, least(greatest(p1, 1e-6), 1 - 1e-6) AS q FROM orig) SELECT entity_id, repeat, round({_SIG('1.2::DOUBLE * ln(q / (1 - q)) - 0.1')}, 6) AS p_sigmoid, round({_SIG('1.1::DOUBLE * ln(q) - 0.9::DOUBLE * ln(1 - q) + 0.05')}, 6) AS p_beta FROM q",
    "expected_calibration_error": f"WITH {_PRED}, g AS (SELECT least(floor(p1 * 15), 14) AS b, count(*) AS n, avg(p1) AS m, avg(label) AS r FROM orig GROUP BY 1) SELECT round(sum(n * abs(m - r)) / sum(n), 6) AS ece FROM g",
    "ks_wasserstein": f"WITH {_DOM}, v AS (SELECT feature, x, count(*) FILTER (WHERE domain = 0) AS a, count(*) FILTER (WHERE domain = 1) AS b FROM dv GROUP BY 1, 2), c AS (SELECT feature, abs(sum(a) OVER r / sum(a) OVER w - sum(b) OVER r / sum(b) OVER w) AS d, lead(x) OVER (PARTITION BY feature ORDER BY x) - x AS gap FROM v WINDOW w AS (PARTITION BY feature), r AS (PARTITION BY feature ORDER BY x ROWS UNBOUNDED PRECEDING)) SELECT feature, round(max(d), 5) AS ks, round(sum(d * coalesce(gap, 0)), 5) AS wasserstein FROM c GROUP BY 1",
    "psi": f"WITH {_DOM}, e AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS edges FROM dv GROUP BY 1), b AS (SELECT dv.*, len(edges) AS k, len(list_filter(edges[2:len(edges) - 1], lambda q: q <= x)) AS bin FROM dv JOIN e USING (feature)), g AS (SELECT feature, bin, max(k) AS k, count(*) FILTER (WHERE domain = 0) AS a, count(*) FILTER (WHERE domain = 1) AS b FROM b GROUP BY 1, 2), s AS (SELECT feature, k, greatest(a / sum(a) OVER (PARTITION BY feature), 1e-6) AS pa, greatest(b / sum(b) OVER (PARTITION BY feature), 1e-6) AS pb FROM g) SELECT feature, round(CASE WHEN max(k) < 3 THEN 0 ELSE sum((pb - pa) * ln(pb / pa)) END, 5) AS psi FROM s GROUP BY 1",
    "density_weights": f"WITH {_PRED}, r AS (SELECT entity_id, repeat, least(greatest(p1, 1e-6), 1 - 1e-6) / (1 - least(greatest(p1, 1e-6), 1 - 1e-6)) AS r FROM orig), m AS (SELECT median(r) AS m FROM r) SELECT entity_id, repeat, round(least(greatest(r / m, 0.5), 2.0), 4) AS weight, r / m < 0.5 AS clipped_low, r / m > 2 AS clipped_high FROM r, m",
    "similarity_holdout": f"WITH {_PRED}, c AS (SELECT label, count(*) AS c, sum(count(*)) OVER () AS t FROM o0 GROUP BY 1), w AS (SELECT *, greatest(2, ceil(round(t * 0.2, 9)))::BIGINT AS want FROM c), q AS (SELECT *, round_even(want * c / t, 0)::BIGINT AS part, label = max(label) OVER () AS last FROM w), z AS (SELECT label, CASE WHEN last THEN want - sum(CASE WHEN last THEN 0 ELSE part END) OVER () ELSE part END AS quota FROM q) SELECT entity_id, label, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY p2 DESC, entity_id) AS rank FROM o0) JOIN z USING (label) WHERE rank <= quota",
    "prior_shift": f"WITH RECURSIVE {_PRED}, em AS (SELECT 0 AS i, avg(p1) AS rate, 1.0::DOUBLE AS gap FROM orig UNION ALL SELECT i + 1, nx, abs(nx - rate) FROM (SELECT em.i, em.rate, (SELECT avg((em.rate / 0.5) * p1 / ((em.rate / 0.5) * p1 + ((1 - em.rate) / 0.5) * (1 - p1))) FROM orig) AS nx FROM em WHERE i < 100 AND gap >= 1e-8)) SELECT round(max_by(rate, i), 6) AS positive_rate FROM em",
    "submission": f'WITH {_PRED} SELECT entity_id AS "ID", (p1 >= 0.5)::INT AS "TargetF1", round(p1, 6) AS "TargetRAUC" FROM o0',
    "uncertainty": f"WITH {_PRED} SELECT entity_id || ':' || repeat AS run, round((p1 + p2) / 2, 5) AS p_mean, round(abs(p1 - p2) / 2, 5) AS p_std, round(least(p1, p2), 5) AS p_min, round(greatest(p1, p2), 5) AS p_max, ((p1 >= 0.5) <> (p2 >= 0.5))::INT AS disagree FROM orig",
    "event_windows": "WITH e AS (SELECT epoch(ts) AS t, event_type, value FROM events), w AS (SELECT (floor(t / 7200) - k)::BIGINT * 7200 AS s, event_type, value FROM e, (SELECT unnest(range(3)) AS k)) SELECT s AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean FROM w GROUP BY 1, 2",
    "fold_labels_documents": f"WITH fr AS (SELECT doc_id, quality, r::INT AS repeat, {_u('42 + 10007 * r', 'doc_id')} AS u FROM (SELECT DISTINCT doc_id, quality FROM labels), (SELECT unnest(range(2)) AS r)), fo AS (SELECT *, ((row_number() OVER (PARTITION BY repeat, quality ORDER BY u, doc_id) - 1) % 5)::INT AS fold FROM fr), g AS (SELECT repeat, fold, count(*) AS validation_n, sum(quality)::BIGINT AS validation_positives FROM fo GROUP BY 1, 2) SELECT *, (sum(validation_n) OVER (PARTITION BY repeat) - validation_n)::BIGINT AS train_n, (sum(validation_positives) OVER (PARTITION BY repeat) - validation_positives)::BIGINT AS train_positives FROM g",
}

# As the queries do: halves that sums bring out a last bit apart round alike.
ORACLES = {name: re.sub(r", ([456])\)", r" + 3e-10, \1)", sql) for name, sql in ORACLES.items()}
