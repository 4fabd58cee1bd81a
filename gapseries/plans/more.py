"""Further queries over the supplied tables, each with its SQL: feature sets, views as data, contracts, comparisons, domains."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapseries.functions import season
from gapseries.operators import evaluation as ev
from gapseries.operators import features as ft
from gapseries.operators import oof
from gapseries.operators import panel as pn
from gapseries.operators import selection as sel
from gapseries.operators import views as vw
from gapseries.sources.stored import spread

from . import oracles as o
from .queries import _domains, arrays, labels, near, near_cells, obs, originals, panel, predictions, query, rounded, views

ORACLES: dict[str, str] = {}


def sql(text: str):
    """The SQL of the query that follows."""

    def put(f):
        ORACLES[f.__name__] = text
        return query(f)

    return put


_OPT = o._OPT
_PRED = o._PRED
_R = " + 3e-10, 6) + 0.0"


def _feature_sql(which: str) -> str:
    names, stats = sel.names_of(which), {n: f"a{i}" for i, n in enumerate(f"{c}__{s}" for c in sel.channels_in_order() for s in ft.STATS)}
    wide = ", ".join(f'max(CASE WHEN channel = \'{n.rpartition("__")[0]}\' THEN "{n.rpartition("__")[2]}" END) AS {a}' for n, a in stats.items() if n in set(names))
    meta = o.ORACLES["metadata_46"].removeprefix("WITH ").replace("SELECT g.*, ov AS", "@", 1)
    ctes, _, last = meta.partition("@")
    where = {}
    for n in names:
        if n in stats:
            where[n] = f"w.{stats[n]}"
        elif n.startswith("relative__"):
            k, c = int(n[19:21]), n[23:]
            where[n] = f"rel.r{k}_{c}"
        elif n.endswith("mean_abs_first_difference"):
            where[n] = f"rel.{n.split('__')[1]}_abs"
        else:
            m = n.removeprefix("metadata__").replace("__", "_")
            where[n] = "m." + {"start_month": "window_start", "end_month": "window_end"}.get(m, m)
    rel = ", ".join(f"max(CASE WHEN pos = {k} THEN {c} END) AS r{k}_{c}" for k in range(1, 7) for c in o._NAMES)
    rel += ", " + ", ".join(f"avg(abs(radar__{b}_first_difference)) AS {b}_abs" for b in ("vv", "vh"))
    return f"""WITH {ctes}, m AS (SELECT g.*, ov AS {last}), {o._channels("views", "window_id", "pos")}, rel AS (SELECT window_id, {rel} FROM ch GROUP BY 1), {o._long(o._NAMES, "window_id", "pos")},
ls AS (SELECT window_id, channel, {o._stats("pos").replace(", 6)", " + 3e-10, 6)")} FROM long GROUP BY 1, 2), w AS (SELECT window_id, {wide or "1 AS none"} FROM ls GROUP BY 1)
SELECT m.entity_id, m.window_id, {", ".join(f'round({e}::DOUBLE{_R} AS "{n}"' for n, e in where.items())} FROM m JOIN rel USING (window_id) JOIN w USING (window_id)"""


def _feature_query(which: str):
    def f(s, d):
        return sel.matrix(arrays(s, d), "entity_id", sel.names_of(which), near_cells)

    f.__name__ = f"feature_set_{which}"
    f.__doc__ = f"The {which} features of every window of every entity."
    sql(_feature_sql(which))(f)


for _which in ("relative", "invariant", "full", "radar", "optical", "compact"):
    _feature_query(_which)


@sql("SELECT * FROM (VALUES " + ", ".join(f"('{g}', '{k}', {n}::BIGINT)" for (g, k), n in {(r[2], r[1]): sum(x[1:3] == r[1:3] for x in sel.registry()) for r in sel.registry()}.items()) + ") t(feature_group, kind, features)")
def feature_registry(s, d):
    return sel.counts_by_group(s)


_GROUPS: dict[str, list[str]] = {}
for _n, _, _g, _ in sel.registry():
    if _n in set(sel.names_of("compact")):
        _GROUPS.setdefault(_g, []).append(_n)


@sql(f"WITH f AS ({_feature_sql('compact')}) " + " UNION ALL ".join(f"SELECT '{g}' AS feature_group, {len(v)} AS features, count(*) * {len(v)} AS observations, ({' + '.join(f'count(*) FILTER (WHERE {n} IS NULL)' for n in v)})::BIGINT AS missing FROM f" for g, v in _GROUPS.items()))
def feature_missingness(s, d):
    return sel.group_missingness(sel.matrix(arrays(s, d), "entity_id", sel.names_of("compact")))


_EXH = f"{o._VIEWS}, {o._LAB}, {o._FOLDS}, pat AS (SELECT entity_id, window_length, window_start, window_index, string_agg(CASE WHEN VV IS NOT NULL AND VH IS NOT NULL THEN '1' ELSE '0' END, '' ORDER BY month) AS rb, string_agg(CASE WHEN {_OPT} THEN '1' ELSE '0' END, '' ORDER BY month) AS ob FROM views GROUP BY ALL)"


@sql(f"WITH {_EXH} SELECT entity_id, repeat, window_length, window_start, 'window_' || substr(sha256(concat_ws('|', entity_id, fold, 'exhaustive', 42, window_index, window_start, window_length, '', rb, ob)), 1, 24) AS window_id FROM pat JOIN fo USING (entity_id)")
def window_ids(s, d):
    """Stable ids of every window in every repeat."""
    on = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("month", c.cast("int").alias("x")))), lambda m: m["x"].cast("string")), "")
    g = views(s, d).groupBy("entity_id", "window_length", "window_start", "window_index").agg(on(pn.all_valid(pn.RADAR)).alias("rb"), on(pn.all_valid(pn.OPTICAL)).alias("ob"))
    j = g.join(ev.folds(labels(s, d), "entity_id", "label", 5, 3), "entity_id")
    c = F.col
    return j.select("entity_id", "repeat", "window_length", "window_start", vw.window_hash(c("entity_id"), c("fold"), F.lit("exhaustive"), F.lit(42), c("window_index"), c("window_start"), c("window_length"), F.lit(""), c("rb"), c("ob")).alias("window_id"))


_CELLS = "'[' || " + " || ',' || ".join(f"({b} IS NOT NULL)::INT::VARCHAR" for b in pn.OPTICAL) + " || ']'"
_TEMPL = f"{o._PANEL}, pt AS (SELECT entity_id, string_agg((VV IS NOT NULL AND VH IS NOT NULL)::INT::VARCHAR, ',' ORDER BY month) AS r, string_agg({_CELLS}, ',' ORDER BY month) AS oc FROM panel GROUP BY 1)"
_BANDS = ",".join(f'"{b}"' for b in pn.OPTICAL)


@sql(f"WITH {_TEMPL} SELECT 'mask_' || substr(sha256('{{\"optical\":[' || oc || '],\"optical_bands\":[{_BANDS}],\"radar\":[' || r || ']}}'), 1, 16) AS mask_id, replace(r, ',', '') AS radar_bits, length(replace(translate(oc, '[],', ''), '0', ''))::INT AS optical_cells, count(*) AS frequency FROM pt GROUP BY r, oc")
def mask_templates(s, d):
    return vw.mask_templates(vw.mask_patterns(panel(s, d), "entity_id"))


@sql(f"WITH {_TEMPL}, x AS (SELECT replace(r, ',', '') AS b, [x::VARCHAR for x in string_split(oc, '],[')] AS m FROM pt), y AS (SELECT b, list_transform(m, lambda v: translate(v, '[],', '')) AS m FROM x) SELECT count(*) AS rows, count(*) FILTER (WHERE NOT contains(b, '1')) AS no_radar, count(*) FILTER (WHERE contains(trim(b, '0'), '0')) AS radar_gap, count(*) FILTER (WHERE length(replace(b, '0', '')) NOT IN (4, 5, 6)) AS wrong_length, count(*) FILTER (WHERE len(list_filter(range(1, 13), lambda i: substr(b, i, 1) = '0' AND contains(m[i], '1'))) > 0) AS optical_outside, count(*) FILTER (WHERE len(list_filter(m, lambda v: contains(v, '1') AND contains(v, '0'))) > 0) AS optical_partial FROM y")
def mask_template_faults(s, d):
    return vw.template_faults(vw.mask_patterns(panel(s, d), "entity_id"))


@sql(f"WITH {o._BITS} SELECT count(DISTINCT radar_bits || '|' || optical_bits) AS patterns FROM b")
def pattern_count(s, d):
    on = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("month", c.cast("int").alias("x")))), lambda m: m["x"].cast("string")), "")
    b = panel(s, d).groupBy("entity_id").agg(F.concat_ws("|", on(pn.all_valid(pn.RADAR)), on(pn.all_valid(pn.OPTICAL))).alias("p"))
    return b.agg(F.count_distinct("p").alias("patterns"))


_UNI = f"{o._LAB}, {o._WIN}, un AS (SELECT entity_id, i::INT AS view_index, floor({o._u('42', chr(39) + 'uniform' + chr(39), 'entity_id', 'i')} * 24)::INT AS window_index FROM lab, (SELECT unnest(range(8)) AS i)), uw AS (SELECT * FROM un JOIN win USING (window_index))"


@sql(f"WITH {_UNI} SELECT entity_id, view_index, window_index, window_length, window_start FROM uw")
def views_uniform(s, d):
    return vw.uniform_views(labels(s, d), "entity_id", ft.windows(s)).select("entity_id", "view_index", "window_index", "window_length", "window_start")


_ID = "'window_' || substr(sha256(concat_ws('|', repeat, entity_id, fold, 'uniform', 42, view_index, window_start, window_length, '', '', '')), 1, 24)"


@sql(f"WITH {_UNI}, {o._FOLDS} SELECT entity_id, repeat, fold, fo.label, view_index, window_start, window_length, {_ID} AS window_id FROM uw JOIN fo USING (entity_id)")
def shared_panel(s, d):
    return vw.shared_panel(vw.uniform_views(labels(s, d), "entity_id", ft.windows(s)), ev.folds(labels(s, d), "entity_id", "label", 5, 3), "entity_id")


@sql("SELECT 0::BIGINT AS differences")
def shared_panel_differences(s, d):
    return vw.panel_differences(shared_panel(s, d), "entity_id").agg(F.count("*").alias("differences"))


_GONE, _DARK = o._u("'temporal'", "window_id", "pos") + " < 0.1", o._u("'optical'", "window_id", "pos") + " < 0.2"


@sql(f"WITH {o._VIEWS}, x AS (SELECT *, {_GONE} AS gone, ({_OPT}) AND NOT ({_GONE}) AND {_DARK} AS dark FROM views) SELECT window_id, count(*) FILTER (WHERE gone) AS months_dropped, count(*) FILTER (WHERE dark) AS optical_dropped, count(CASE WHEN NOT gone THEN VV END) AS radar_months, count(CASE WHEN NOT gone AND NOT dark THEN nir END) AS nir_months FROM x GROUP BY 1")
def views_dropout_values(s, d):
    """Values of every window after temporal and optical dropout."""
    g = vw.dropped(views(s, d)).groupBy("window_id")
    return g.agg(F.count(F.when(F.col("month_dropped"), 1)).alias("months_dropped"), F.count(F.when(F.col("optical_dropped"), 1)).alias("optical_dropped"), F.count("VV").alias("radar_months"), F.count("nir").alias("nir_months"))


@sql(f"WITH {o._BITS} SELECT entity_id, 'window_' || substr(sha256(concat_ws('|', entity_id, -1, 'observed', -1, 0, first_month, window_length, '', radar_bits, optical_bits)), 1, 24) AS window_id, -1 AS fold, -1 AS augmentation_seed, 0 AS view_index, NULL::INT AS label, first_month AS window_start, window_length FROM ow")
def views_observed(s, d):
    return vw.observed_view(pn.observed_windows(panel(s, d), "entity_id"), "entity_id")


_SEASON = "CASE WHEN window_start <= 3 THEN '01-03' WHEN window_start <= 6 THEN '04-06' ELSE '07-09' END"


@sql(f"WITH {_PRED}, z AS (SELECT repeat, fold, {_SEASON} AS season, entity_id || ':' || window_length || ':' || window_start AS window_id FROM pred), g AS (SELECT repeat, fold, season, count(*) AS validation_n, sum(('0x' || substr(md5(window_id), 1, 8))::UBIGINT)::BIGINT AS validation_sum FROM z GROUP BY 1, 2, 3) SELECT g.*, coalesce((SELECT count(*) FROM z WHERE z.repeat = g.repeat AND z.fold <> g.fold AND z.season <> g.season), 0) AS training_n FROM g")
def season_out(s, d):
    p = predictions(s, d)
    return vw.season_out(p.select("repeat", "fold", "window_start", F.concat_ws(":", "entity_id", "window_length", "window_start").alias("window_id")))


@sql(f"WITH {_PRED} SELECT window_length, window_start, fold, n FROM (SELECT window_length, window_start, fold, count(*) AS n FROM pred GROUP BY GROUPING SETS ((window_length), (window_length, window_start), (fold, window_length)))")
def window_audit(s, d):
    """Windows by length, by length and start, and by fold and length, in one plan."""
    a, b, c = F.col("window_length"), F.col("window_start"), F.col("fold")
    return predictions(s, d).groupingSets([[a], [a, b], [c, a]], a, b, c).agg(F.count("*").alias("n")).select("window_length", "window_start", "fold", "n")


@sql(f"WITH {o._VIEWS}, {o._channels('views', 'window_id', 'pos')} " + " UNION ALL ".join(f"SELECT '{n}' AS channel, count(*) AS cells, count({n}) AS valid, count(*) - count({n}) AS missing FROM ch" for n in o._NAMES))
def sequence_masks(s, d):
    """Valid and missing cells of each channel over all windows."""
    return ft.window_validity(ft.with_channels(panel(s, d), "entity_id", "month"))


_OO = "oo AS (SELECT repeat, entity_id, min(fold) AS fold, min(label) AS label, -1 AS window_start, -1 AS window_length, count(*) AS n_windows, avg(optical_months) AS optical_months, round(avg(p1) + 1e-12, 9) AS p FROM pred GROUP BY 1, 2)"


@sql(f"WITH {_PRED}, {_OO} SELECT * REPLACE (round(optical_months{_R} AS optical_months, round(p{_R} AS p), (p >= 0.5)::INT AS prediction FROM oo")
def oof_originals(s, d):
    return rounded(oof.originals(predictions(s, d), "entity_id", "p1", "label"))


@sql(f"WITH {_PRED} SELECT count(*) AS rows, " + ", ".join(f"0::BIGINT AS {c}" for c in ("bad_probabilities", "repeated_windows", "split_originals", "off_threshold", "not_reaggregated", "not_covered")) + " FROM pred")
def oof_contract(s, d):
    p = predictions(s, d)
    return oof.contract(p, oof.originals(p, "entity_id", "p1", "label"), "entity_id", "p1", "label", 2)


@sql("SELECT " + ", ".join(f"0::BIGINT AS {c}" for c in ("missing", "extra", "other_label", "bad_fold", "repeated", "repeats_short_of_folds")))
def fold_faults(s, d):
    return oof.fold_faults(ev.folds(labels(s, d), "entity_id", "label", 5, 3), labels(s, d), "entity_id", "label", 5, 3)


@sql("SELECT " + ", ".join(f"0::BIGINT AS {c}" for c in ("nulls", "repeated", "split_keys", "wrong_number")))
def window_manifest_faults(s, d):
    return oof.manifest_faults(shared_panel(s, d).withColumn("window_id", F.concat_ws(":", "window_id", "view_index")), "entity_id", "window_id", 8)


@sql(f"WITH {_PRED} SELECT repeat, fold, count(DISTINCT entity_id) AS validation_keys, 0::BIGINT AS leaks FROM pred GROUP BY 1, 2")
def fold_split_leaks(s, d):
    return oof.split_leaks(predictions(s, d), ["entity_id"])


_MODELS = "md AS (SELECT 'first' AS model, repeat, entity_id, label, p1 AS p FROM orig UNION ALL SELECT 'second', repeat, entity_id, label, p2 FROM orig UNION ALL SELECT 'third', repeat, entity_id, label, round(0.3::DOUBLE * p1 + 0.7::DOUBLE * p2, 9) FROM orig), mp AS (SELECT a.repeat, a.model AS \"left\", b.model AS \"right\", a.label, a.p AS p1, b.p AS p2 FROM md a JOIN md b ON a.repeat = b.repeat AND a.entity_id = b.entity_id AND a.model < b.model)"


@sql(f"WITH {_PRED}, {_MODELS} " + o._pairwise("mp", 'repeat, "left", "right"').replace(", 6)", _R))
def model_pairs(s, d):
    """The pairwise record of every two of three models, by repeat."""
    third = F.round(F.lit(0.3) * F.col("p1") + F.lit(0.7) * F.col("p2"), 9)
    each = F.array(*[F.struct(F.lit(n).alias("model"), p.alias("p")) for n, p in (("first", F.col("p1")), ("second", F.col("p2")), ("third", third))])
    models = spread(originals(s, d), 3, "originals").select("repeat", "entity_id", "label", F.explode(each).alias("m")).select("m.model", "repeat", "entity_id", "label", "m.p")
    return rounded(oof.pairs(models, ["entity_id"], "label"))


@sql(f"WITH {_PRED} SELECT repeat, entity_id, round(p1{_R} AS p_left, round(p2{_R} AS p_right FROM orig")
def models_aligned(s, d):
    base = originals(s, d)
    return rounded(oof.aligned(base.select("repeat", "entity_id", F.col("p1").alias("p")), base.select("repeat", "entity_id", F.col("p2").alias("p")), ["repeat", "entity_id"], ("first", "second")))


_SL2 = o._SLICED.replace("entity_id, label, p1, unnest", "entity_id, label, p1, p2, unnest").replace("round(avg(p1) + 1e-12, 9) AS p FROM", "round(avg(p1) + 1e-12, 9) AS a, round(avg(p2) + 1e-12, 9) AS b FROM")


@sql(f"WITH {_PRED}, {_SL2}, e AS (SELECT *, (a >= 0.5)::INT <> label AS x, (b >= 0.5)::INT <> label AS y FROM so) SELECT repeat, slice_group, slice_value, count(*) AS n, count(*) FILTER (WHERE x) AS left_errors, count(*) FILTER (WHERE y) AS right_errors, count(*) FILTER (WHERE x AND y) AS shared_errors, count(*) FILTER (WHERE x AND NOT y) AS only_left, count(*) FILTER (WHERE y AND NOT x) AS only_right, round(CASE WHEN count(*) FILTER (WHERE x OR y) = 0 THEN 1.0 ELSE count(*) FILTER (WHERE x AND y) / count(*) FILTER (WHERE x OR y) END{_R} AS error_jaccard FROM e GROUP BY 1, 2, 3")
def slice_error_overlap(s, d):
    return rounded(oof.slice_overlap(predictions(s, d), ["repeat"], "entity_id", "p1", "p2", "label"))


_BL = "bl AS (SELECT repeat, entity_id, label, weight, round(avg(p) + 1e-12, 9) AS p FROM (SELECT *, round((1 - weight) * p1 + weight * p2, 12) AS p FROM pred, (SELECT unnest([0.5::DOUBLE, 0.7::DOUBLE]) AS weight)) GROUP BY ALL)"


@sql(f"WITH {_PRED}, {_BL} {o._metrics('bl', 'repeat, weight', 'p')}".replace(", 6)", " + 3e-10, 6)"))
def fixed_blends(s, d):
    """Metrics by repeat of windows blended with fixed weights and averaged to originals."""
    b = oof.blended(predictions(s, d), "p1", "p2", (0.5, 0.7))
    return rounded(ev.metrics(b.groupBy("repeat", "weight", "entity_id", "label").agg(ev.mean9("p").alias("p")), ["repeat", "weight"], "p", "label"))


@sql(f"SELECT round(round(quantile_cont(weight, 0.5) / 0.01) * 0.01{_R} AS weight FROM ({o.ORACLES['nested_weights']})")
def production_weight(s, d):
    from .queries import QUERIES

    return rounded(oof.production_weight(QUERIES["nested_weights"](s, d)))


@query
def calibrator_coefficients(s, d):
    """Coefficients of sigmoid and beta calibrators for every repeat and fold, fitted on the other folds."""
    base = originals(s, d)
    kinds = [oof.fit_calibrators(base, "p1", "label", how).withColumn("method", F.lit(how)) for how in ("sigmoid", "beta")]
    return rounded(kinds[0].unionByName(kinds[1]), 4)


@query
def calibration_report(s, d):
    """Calibration error of originals by method, each window calibrated by what its own fold was not fitted on."""
    base, p = originals(s, d), predictions(s, d)
    found = [ev.calibration_error(base, "p1", "label").withColumn("method", F.lit("none"))]
    for how in ("sigmoid", "beta"):
        c = oof.calibrated(p, oof.fit_calibrators(base, "p1", "label", how), "p1", how)
        g = c.groupBy("repeat", "entity_id", "label").agg(F.avg("p_calibrated").alias("p"))
        found.append(ev.calibration_error(g, "p", "label").withColumn("method", F.lit(how)))
    return rounded(found[0].unionByName(found[1]).unionByName(found[2]), 4)


@sql(f"WITH {_PRED} SELECT entity_id, min(label) AS label, round(round(avg(p1) + 1e-12, 9){_R} AS p FROM orig GROUP BY 1")
def consensus(s, d):
    return rounded(originals(s, d).groupBy("entity_id").agg(F.min("label").alias("label"), ev.mean9("p1").alias("p")))


_ST = o.ORACLES["stability"].removeprefix("WITH ")
_STC, _, _STS = _ST.rpartition(" SELECT ")


@sql(f"WITH {_PRED}, g AS (SELECT repeat, entity_id, label, count(*) AS n, round(avg(p1) + 1e-12, 9) AS m, stddev_pop(p1) AS sd, max(p1) - min(p1) AS rg FROM pred GROUP BY 1, 2, 3) SELECT ((m >= 0.5)::INT <> label)::INT AS is_error, count(*) AS originals, round(avg(sd){_R} AS p_std, round(avg(rg){_R} AS p_range FROM g GROUP BY 1")
def stability_by_error(s, d):
    g = predictions(s, d).groupBy("repeat", "entity_id", "label").agg(ev.mean9("p1").alias("m"), F.stddev_pop("p1").alias("sd"), (F.max("p1") - F.min("p1")).alias("rg"))
    return rounded(g.groupBy(((F.col("m") >= 0.5).cast("int") != F.col("label")).cast("int").alias("is_error")).agg(F.count("*").alias("originals"), F.avg("sd").alias("p_std"), F.avg("rg").alias("p_range")))


_EARLY = "(entity_id % 10000 >= 2001)::INT"
_DR = f"{o._OBS}, {o._LAB}, {o._FOLDS}, dd AS (SELECT entity_id, month, {_EARLY} AS domain, CASE WHEN {_EARLY} = 0 THEN 'train:' ELSE 'test:' END || entity_id AS entity_group, fold FROM obs JOIN fo USING (entity_id) WHERE repeat = 0), es AS (SELECT domain, entity_group, count(*) AS n FROM dd GROUP BY 1, 2), ds AS (SELECT domain, count(*) AS e, sum(count(*)) OVER () AS t FROM es GROUP BY 1), fs AS (SELECT fold, domain, count(DISTINCT entity_group) AS e FROM dd GROUP BY 1, 2), ft AS (SELECT *, sum(e) OVER (PARTITION BY fold) AS t FROM fs)"


@sql(f"WITH {_DR} SELECT entity_id, month, dd.domain, entity_group, dd.fold, round(ds.t / 2 / ds.e / n{_R} AS entity_weight, round(ft.t / 2 / ft.e / n{_R} AS fold_weight FROM dd JOIN es USING (domain, entity_group) JOIN ds USING (domain) JOIN ft ON ft.fold = dd.fold AND ft.domain = dd.domain")
def domain_weights(s, d):
    """Rows of early and late entities with balanced weights, overall and within folds."""
    fold = ev.folds(labels(s, d), "entity_id", "label").select("entity_id", "fold")
    rows = oof.domain_rows(obs(s, d).select("entity_id", "month"), "entity_id", (F.col("entity_id") % 10000 >= 2001).cast("int")).join(fold, "entity_id")
    return rounded(oof.fold_weights(rows))


_R5 = " + 3e-10, 5) + 0.0"
_SHIFT = o.ORACLES["ks_wasserstein"].removeprefix("WITH ")
_PSI = o.ORACLES["psi"].removeprefix("WITH ")


@sql(f"WITH {o._DOM}, a AS (SELECT feature, {', '.join(f'round(avg((x IS NULL)::INT) FILTER (WHERE domain = {k}){_R5} AS missing_rate_{k}, round(avg(x) FILTER (WHERE domain = {k}){_R5} AS mean_{k}, round(quantile_cont(x, 0.5) FILTER (WHERE domain = {k}){_R5} AS median_{k}' for k in (0, 1))} FROM dom GROUP BY 1), ks AS (WITH {_SHIFT}), ps AS (WITH {_PSI}) SELECT a.*, ks, wasserstein, psi FROM a LEFT JOIN ks USING (feature) LEFT JOIN ps USING (feature)")
def shift_table(s, d):
    """Missing rates, means, medians, KS, Wasserstein and PSI of all bands between early and late entities."""
    return rounded(oof.shift_table(_domains(s, d)), 5)


@sql(f"WITH {o._OBS} SELECT entity_id, {', '.join(f'round(avg({b}){_R} AS {b}' for b in pn.BANDS)} FROM obs GROUP BY 1")
def entity_means(s, d):
    return rounded(obs(s, d).groupBy("entity_id").agg(*[F.avg(b).alias(b) for b in pn.BANDS]))


_IMP = f"{o._OBS}, {o._LAB}, {o._FOLDS}, im AS (SELECT f.feature, CASE WHEN f.feature IN ('VV', 'VH') THEN 'radar_raw' ELSE 'optical_raw' END AS feature_group, repeat, fold, round(abs(avg(f.x) FILTER (WHERE fo.label = 1) - avg(f.x) FILTER (WHERE fo.label = 0)), 9) AS importance FROM obs JOIN fo USING (entity_id), LATERAL (SELECT unnest([{', '.join(f'''{{'feature': '{b}', 'x': {b}}}''' for b in pn.BANDS)}]) AS f) GROUP BY 1, 2, 3, 4)"


def _importances(s, d):
    """By feature, repeat and fold: how far the classes' means are apart in the fold."""
    x = obs(s, d).join(ev.folds(labels(s, d), "entity_id", "label", 5, 3), "entity_id")
    cells = F.array(*[F.struct(F.lit(b).alias("feature"), F.lit("radar_raw" if b in pn.RADAR else "optical_raw").alias("feature_group"), F.col(b).alias("x")) for b in pn.BANDS])
    side = lambda k: F.avg(F.when(F.col("label") == k, F.col("x")))
    return x.select("repeat", "fold", "label", F.explode(cells).alias("c")).select("repeat", "fold", "label", "c.*").groupBy("feature", "feature_group", "repeat", "fold").agg(F.round(F.abs(side(1) - side(0)), 9).alias("importance"))


@sql(f"WITH {_IMP} SELECT feature, round(avg(importance){_R} AS mean, round(coalesce(stddev_samp(importance), 0){_R} AS std, count(DISTINCT fold) AS folds FROM im GROUP BY 1")
def importance_summary(s, d):
    return rounded(oof.importance_summary(_importances(s, d)))


_STAB = f"{_IMP}, sh AS (SELECT *, CASE WHEN sum(importance) OVER w = 0 THEN 0 ELSE importance / sum(importance) OVER w END AS share FROM im WINDOW w AS (PARTITION BY repeat, fold)), sg AS (SELECT feature, feature_group, avg(share) AS mean, coalesce(stddev_samp(share), 0) AS std, min(share) AS min, max(share) AS max, count(*) AS n FROM sh GROUP BY 1, 2), sc AS (SELECT *, CASE WHEN mean > 0 THEN std / mean ELSE 0 END AS cv, row_number() OVER (ORDER BY round(mean, 12) DESC, feature)::INT AS rank FROM sg)"


@sql(f"WITH {_STAB} SELECT feature, feature_group, round(mean{_R} AS mean, round(std{_R} AS std, round(min{_R} AS min, round(max{_R} AS max, n, round(cv{_R} AS cv, rank, mean >= 0.15 AS dominant, mean >= 0.005 AND cv >= 1.5 AS unstable, rank <= 10 AND feature_group LIKE 'metadata%' AS metadata_on_top FROM sc")
def importance_stability(s, d):
    return rounded(oof.importance_stability(_importances(s, d)))


@sql(f"WITH {_STAB} SELECT feature_group, round(sum(mean){_R} AS total, round(max(mean){_R} AS largest, count(*) AS features, round(sum(mean) / sum(sum(mean)) OVER (){_R} AS share FROM sc GROUP BY 1")
def importance_groups(s, d):
    return rounded(oof.group_importance(oof.importance_stability(_importances(s, d))))


@sql(f"WITH {_IMP} SELECT feature, round(sum(importance){_R} AS total FROM im GROUP BY 1 ORDER BY round(sum(importance), 9) DESC, feature LIMIT 5")
def importance_top(s, d):
    """The five features of largest total importance."""
    g = _importances(s, d).groupBy("feature").agg(F.sum("importance").alias("t"))
    return rounded(g.orderBy(F.round("t", 9).desc(), "feature").limit(5).select("feature", F.col("t").alias("total")))


@sql(f"WITH {_PRED}, hold AS ({o.ORACLES['similarity_holdout'].replace('WITH ' + _PRED + ',', 'WITH')}), ho AS (SELECT orig.* FROM orig WHERE entity_id IN (SELECT entity_id FROM hold)) {o._metrics('ho', 'repeat', 'p1')}".replace(", 6)", " + 3e-10, 6)"))
def holdout_evaluation(s, d):
    """Metrics by repeat on the most test-like originals."""
    base = originals(s, d)
    some = ev.similarity_holdout(base.filter("repeat = 0").select("entity_id", "label", "p2"), "entity_id", "p2", "label").select("entity_id")
    return rounded(ev.metrics(base.join(some, "entity_id", "left_semi"), ["repeat"], "p1", "label"))


_NORM = f"{o._PANEL}, {o._LAB}, {o._FOLDS}, {o._channels('panel', 'entity_id', 'month')}, {o._long(o._NAMES, 'entity_id', 'month')}, lf AS (SELECT fold, channel, x FROM long JOIN fo USING (entity_id) WHERE repeat = 0), nf AS (SELECT DISTINCT fold AS held FROM lf), nn AS (SELECT held AS fold, channel, count(x) AS n, avg(x) AS mean, CASE WHEN stddev_pop(x) > 1e-8 THEN stddev_pop(x) ELSE 1 END AS std FROM lf JOIN nf ON fold <> held GROUP BY 1, 2 HAVING count(x) > 0)"


def _channel_cells(s, d):
    c = ft.long_channels(ft.with_channels(panel(s, d), "entity_id", "month"), ["entity_id"], "month", ft.channel_names())
    return c.join(ev.folds(labels(s, d), "entity_id", "label").select("entity_id", "fold"), "entity_id").select("fold", "channel", "x")


@sql(f"WITH {_NORM} SELECT fold, channel, n, round(mean + 3e-10, 4) + 0.0 AS mean, round(std + 3e-10, 4) + 0.0 AS std FROM nn")
def normaliser(s, d):
    """Mean and deviation of each channel over the other folds."""
    return rounded(oof.normaliser(_channel_cells(s, d)), 4)


@sql(f"WITH {_NORM} SELECT fold, channel, count(*) AS cells, round(avg(coalesce(least(greatest((x - mean) / std, -8.0), 8.0), 0)) + 3e-10, 4) + 0.0 AS mean_z FROM lf JOIN nn USING (fold, channel) GROUP BY 1, 2")
def normalised_cells(s, d):
    cells = _channel_cells(s, d)
    z = oof.normalised(cells, oof.normaliser(cells))
    return rounded(z.groupBy("fold", "channel").agg(F.count("*").alias("cells"), F.avg("z").alias("mean_z")), 4)


@sql(f"WITH {_PRED} SELECT {_SEASON} AS season, repeat, count(*) AS windows, count(DISTINCT entity_id) AS originals FROM pred WHERE window_start BETWEEN 1 AND 9 AND window_length BETWEEN 4 AND 6 GROUP BY 1, 2")
def season_counts(s, d):
    """Windows by season and repeat."""
    p = predictions(s, d).filter(F.col("window_start").between(1, 9) & F.col("window_length").between(4, 6))
    return p.groupBy(season(F.col("window_start")).alias("season"), "repeat").agg(F.count("*").alias("windows"), F.count_distinct("entity_id").alias("originals"))


@query
def gbt_out_of_fold(s, d):
    """Boosted trees on means of bands, each fold predicted by the others' model."""
    from gapseries.operators import models

    from .queries import MODEL_FEATURES, _model_rows

    return models.out_of_fold(_model_rows(s, d), MODEL_FEATURES, "label", "fold", "gbt").select("entity_id", "fold", "label", near("p").alias("p"))
