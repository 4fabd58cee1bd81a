"""Queries over masks by band, each with its SQL: test-like observations with band gaps, their library, views, manifests, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapseries.operators import evaluation as ev
from gapseries.operators import features as ft
from gapseries.operators import masks as mk
from gapseries.operators import panel as pn

from . import oracles as o
from .more import sql
from .queries import labels, panel, rounded

_YEAR = "year(l_shipdate)"
#: Months that a supplier and year is observed in: 3 to 7 of them, so some are too few or too many.
_FIRST, _N = f"(1 + (l_suppkey * 10000 + {_YEAR}) % 6)", "(3 + l_suppkey % 5)"
_IN = f"(month(l_shipdate) BETWEEN {_FIRST} AND {_FIRST} + {_N} - 1)"


def _bands() -> dict[str, tuple[str, str]]:
    """band: (value, condition) of its lines. Each optical band has other lines, so gaps differ from band to band; some suppliers have
    optical values outside their months, and some lack one radar band in their first month."""
    found = {"VH": ("-l_extendedprice / 1000", _IN), "VV": ("l_quantity", f"{_IN} AND NOT (l_suppkey % 13 = 5 AND month(l_shipdate) = {_FIRST})")}
    for i, b in enumerate(pn.OPTICAL):
        found[b] = ("l_quantity" if i % 2 else "l_extendedprice / 1000", f"(l_orderkey * {i + 1}) % 11 < 3 AND ({_IN} OR l_suppkey % 7 = 3)")
    return found


def test_observations(s, d):
    """entity_id, month and the bands of what was observed, with gaps by band."""
    li = s.read.parquet(f"{d}/lineitem.parquet")
    return li.groupBy((F.col("l_suppkey") * 10000 + F.year("l_shipdate")).alias("entity_id"), F.month("l_shipdate").alias("month")).agg(*[F.expr(f"avg(CASE WHEN {when} THEN {x} END)").alias(b) for b, (x, when) in _bands().items()])


_TOBS = f"tobs AS (SELECT {o._E} AS entity_id, month(l_shipdate)::INT AS month, {', '.join(f'avg({x}) FILTER (WHERE {when}) AS {b}' for b, (x, when) in _bands().items())} FROM lineitem GROUP BY ALL)"
_CELL = " || ".join(f"({b} IS NOT NULL)::INT::VARCHAR" for b in pn.OPTICAL)
_TB = f"""{_TOBS}, tgrid AS (SELECT * FROM (SELECT DISTINCT entity_id FROM tobs) CROSS JOIN (SELECT unnest(range(1, 13))::INT AS month) LEFT JOIN tobs USING (entity_id, month)),
tb AS (SELECT entity_id, string_agg((VV IS NOT NULL AND VH IS NOT NULL)::INT::VARCHAR, '' ORDER BY month) AS r, string_agg({_CELL}, ';' ORDER BY month) AS oc, count(*) FILTER (WHERE (VV IS NULL) <> (VH IS NULL)) AS partial FROM tgrid GROUP BY 1),
tm AS (SELECT *, array_to_string([contains(m, '0')::INT = 0 FOR m IN string_split(oc, ';')]::INT[], '') AS om, trim(r, '0') AS held,
  len(list_filter(range(1, 13), lambda i: r[i] = '0' AND contains(string_split(oc, ';')[i], '1'))) > 0 AS outside FROM tb)"""
_OK = "contains(r, '1') AND NOT contains(held, '0') AND length(held) IN (4, 5, 6) AND NOT outside AND partial = 0"
_JSON = "'{\"optical\":[' || array_to_string(['[' || array_to_string(string_split(m, ''), ',') || ']' FOR m IN string_split(oc, ';')], ',') || '],\"optical_bands\":[" + ",".join(f'"{b}"' for b in pn.OPTICAL) + "],\"radar\":[' || array_to_string(string_split(r, ''), ',') || ']}'"
_TLIB = f"""{_TB}, tl AS (SELECT 'mask_' || substr(sha256({_JSON}), 1, 16) AS mask_id, count(*) AS frequency, instr(r, '1')::INT AS window_start, length(held)::INT AS window_length, r, om, oc,
  len(list_filter(range(1, 13), lambda i: r[i] = '1' AND om[i] = '0'))::INT AS gaps FROM tm WHERE {_OK} GROUP BY r, om, oc, held)"""


def _sound(s, d):
    return mk.observed_masks(test_observations(s, d), "entity_id").filter(mk.sound(F.col("mask"), F.col("partial_radar")))


@sql(f"WITH {_TB} SELECT entity_id, r AS radar_availability, om AS optical_month_availability, oc AS optical_band_availability, partial AS partial_radar FROM tm")
def band_masks(s, d):
    """Availability of every test entity, band by band, out of packed bits."""
    m = F.col("mask")
    own = mk.observed_masks(test_observations(s, d), "entity_id")
    return own.select("entity_id", mk.text(m["radar"], 12).alias("radar_availability"), mk.text(mk.optical_months(m), 12).alias("optical_month_availability"), F.concat_ws(";", mk.band_text(m["early"]), mk.band_text(m["late"])).alias("optical_band_availability"), "partial_radar")


@sql(f"WITH {_TB} SELECT count(*) AS rows, count(*) FILTER (WHERE NOT contains(r, '1')) AS no_radar, count(*) FILTER (WHERE contains(held, '0')) AS radar_gap, count(*) FILTER (WHERE length(replace(r, '0', '')) NOT IN (4, 5, 6)) AS wrong_length, count(*) FILTER (WHERE outside) AS optical_outside, count(*) FILTER (WHERE partial > 0) AS partial_radar FROM tm")
def band_mask_faults(s, d):
    """How many of the test entities' masks break each rule; many do, on purpose."""
    return mk.mask_faults(mk.observed_masks(test_observations(s, d), "entity_id"))


@sql(f"WITH {_TLIB} SELECT mask_id, frequency, window_start, window_start + window_length - 1 AS window_end, window_length, r AS radar_availability, om AS optical_month_availability, oc AS optical_band_availability, gaps AS internal_optical_gap_count FROM tl")
def band_mask_library(s, d):
    return mk.library_texts(mk.library(_sound(s, d)))


_TDRAW = f"""{_TLIB}, {o._PANEL}, {o._LAB}, {o._FOLDS}, cum AS (SELECT *, sum(frequency) OVER w / sum(frequency) OVER () AS hi, (sum(frequency) OVER w - frequency) / sum(frequency) OVER () AS lo FROM tl WINDOW w AS (ORDER BY mask_id ROWS UNBOUNDED PRECEDING)),
dr AS (SELECT entity_id, i::INT AS view_index, {o._u('42', 'entity_id', 'i')} AS u FROM lab, (SELECT unnest(range(8)) AS i)), dm AS (SELECT * FROM dr JOIN cum ON u >= lo AND u < hi)"""


def _drawn(s, d):
    """Eight masks for each entity, drawn by frequency, with its fold and label."""
    lib = mk.library(_sound(s, d))
    draws = pn.sampled_masks(labels(s, d), "entity_id", lib.select("mask_id", "frequency"))
    fold = ev.folds(labels(s, d), "entity_id", "label").select("entity_id", "label", "fold")
    return draws.join(lib, "mask_id").join(fold, "entity_id")


_ON = {b: "r[month]" if b in pn.RADAR else f"string_split(oc, ';')[month][{pn.OPTICAL.index(b) + 1}]" for b in pn.BANDS}


@sql(f"WITH {_TDRAW} SELECT entity_id, view_index, mask_id, {', '.join(f'''count(CASE WHEN {w} = '1' THEN {b} END) AS n_{b}, round(sum(CASE WHEN {w} = '1' THEN {b} END) + 3e-10, 6) + 0.0 AS {b}_total''' for b, w in _ON.items())} FROM dm JOIN panel USING (entity_id) GROUP BY 1, 2, 3")
def views_test_like(s, d):
    """Eight views of each entity with the values that drawn masks leave, band by band."""
    views = mk.masked_views(_drawn(s, d), "entity_id", "test_like")
    values = mk.view_values(views, panel(s, d), "entity_id").join(views.select("window_id", "view_index", "mask_id"), "window_id")
    return rounded(values.groupBy("entity_id", "view_index", "mask_id").agg(*[e for b in pn.BANDS for e in (F.count(b).alias(f"n_{b}"), F.sum(b).alias(f"{b}_total"))]))


def _manifest_sql(mode: str, rows: str, temporal: float, optical: float) -> str:
    """rows: CTEs that end in ch: entity_id, fold, label, view_index, window_start, window_length, mask_id, r, oc, frequency, gaps; r null for a full window."""
    gone = f"{o._u(chr(39) + 'temporal' + chr(39), '42', 'entity_id', 'view_index', 'p')} < {temporal}" if temporal else "false"
    dark = f"{o._u(chr(39) + 'optical' + chr(39), '42', 'entity_id', 'view_index', 'p')} < {optical}" if optical else "false"
    bits = lambda x: f"string_agg(({x})::INT::VARCHAR, '' ORDER BY p)"
    return f"""WITH {rows}, ps AS (SELECT ch.*, p, p < window_length AS inside, p < window_length AND {gone} AS gone, {dark} AS dim FROM ch, (SELECT unnest(range(6)) AS p)),
ra AS (SELECT *, inside AND NOT gone AND coalesce(r[window_start + p], '1') = '1' AS ron, CASE WHEN inside AND NOT gone THEN coalesce(string_split(oc, ';')[window_start + p], '1111111111') ELSE '0000000000' END AS cells FROM ps),
rb AS (SELECT *, dim AND contains(cells, '1') AS dark, CASE WHEN dim THEN '0000000000' ELSE cells END AS cc FROM ra),
rm AS (SELECT entity_id, fold, label, view_index, window_start, window_length, mask_id, r IS NOT NULL AS used, frequency, gaps, {bits('inside')} AS position_mask, {bits('ron')} AS radar_availability, {bits("NOT contains(cc, '0')")} AS optical_month_availability,
  string_agg(cc, ';' ORDER BY p) AS optical_band_availability, {bits('gone')} AS temporal_dropout_mask, {bits('dark')} AS optical_dropout_mask, count(*) FILTER (WHERE ron)::INT AS radar_months, count(*) FILTER (WHERE NOT contains(cc, '0'))::INT AS optical_months,
  count(*) FILTER (WHERE ron AND contains(cc, '0'))::INT AS internal_optical_gap_count FROM rb GROUP BY ALL)
SELECT entity_id, 'window_' || substr(sha256(concat_ws('|', entity_id, fold, '{mode}', 42, view_index, window_start, window_length, coalesce(mask_id, 'full_window'), radar_availability, optical_band_availability)), 1, 24) AS window_id, fold, label, '{mode}' AS generation_mode,
  view_index, 42 AS augmentation_seed, window_start, window_start + window_length - 1 AS window_end, window_length, position_mask, radar_availability, optical_month_availability, optical_band_availability, temporal_dropout_mask, optical_dropout_mask,
  radar_months, optical_months, internal_optical_gap_count, coalesce(gaps, 0) AS test_mask_optical_gap_count, used AS test_mask_used, coalesce(mask_id, 'full_window') AS mask_id, coalesce(frequency, 0)::BIGINT AS source_mask_frequency FROM rm"""


_CHOSEN = f"{_TDRAW}, ch AS (SELECT dm.entity_id, fold, label, view_index, window_start, window_length, mask_id, r, oc, frequency, gaps FROM dm JOIN fo USING (entity_id) WHERE repeat = 0)"
_WHOLE = f"{o._LAB}, {o._FOLDS}, {o._WIN}, ch AS (SELECT entity_id, fold, label, window_index AS view_index, window_start, window_length, NULL::VARCHAR AS mask_id, NULL::VARCHAR AS r, NULL::VARCHAR AS oc, NULL::BIGINT AS frequency, NULL::INT AS gaps FROM fo, win WHERE repeat = 0)"


@sql(_manifest_sql("test_like", _CHOSEN, 0, 0))
def manifest_test_like(s, d):
    """The manifest of test-like views."""
    return mk.masked_views(_drawn(s, d), "entity_id", "test_like").drop("radar_bits", "optical_bits")


@sql(_manifest_sql("test_like", _CHOSEN, 0.1, 0.2))
def manifest_test_like_dropout(s, d):
    """The same with months dropped, and of what is left optical months."""
    return mk.masked_views(_drawn(s, d), "entity_id", "test_like", temporal=0.1, optical=0.2).drop("radar_bits", "optical_bits")


def _exhaustive(s, d):
    fold = ev.folds(labels(s, d), "entity_id", "label").select("entity_id", "label", "fold")
    w = F.explode(F.array(*[F.struct(F.lit(i).alias("view_index"), F.lit(a).alias("window_start"), F.lit(n).alias("window_length")) for i, (n, a) in enumerate((n, a) for n in ft.LENGTHS for a in range(1, 14 - n))]))
    none = {"mask_id": F.lit(None).cast("string"), "mask": F.lit(None).cast("struct<radar:int,early:bigint,late:bigint>"), "frequency": F.lit(None).cast("long"), "internal_optical_gap_count": F.lit(None).cast("int")}
    return fold.select("*", w.alias("w")).select("entity_id", "label", "fold", "w.*").withColumns(none)


@sql(_manifest_sql("exhaustive", _WHOLE, 0.1, 0.2))
def manifest_exhaustive(s, d):
    """The manifest of all 24 full windows of every entity, with dropout."""
    return mk.masked_views(_exhaustive(s, d), "entity_id", "exhaustive", temporal=0.1, optical=0.2).drop("radar_bits", "optical_bits")


def _spoilt(s, d):
    """Views and values in which some rows were changed: each rule is broken somewhere."""
    views = mk.masked_views(_drawn(s, d), "entity_id", "test_like").withColumn("_h", F.pmod("entity_id", F.lit(17)) * 8 + F.col("view_index"))
    values = mk.view_values(views, panel(s, d), "entity_id")
    h, c = F.col("_h"), F.col
    bad = views.withColumns({
        "radar_bits": F.when(h == 1, c("radar_bits").bitwiseOR(F.lit(64))).otherwise(c("radar_bits")), "optical_bits": F.when(h == 9, c("optical_bits") - c("optical_bits") % 2 + 1 - c("optical_bits") % 2).otherwise(c("optical_bits")),
        "window_end": F.when(h == 17, 13).otherwise(c("window_end")), "window_length": F.when(h == 25, 3).otherwise(c("window_length")), "fold": F.when(h == 33, (c("fold") + 1) % 5).otherwise(c("fold")),
        "window_id": F.when(h == 41, F.lit("window_0")).otherwise(c("window_id")), "label": F.when(h == 49, 2).otherwise(c("label")),
    })
    return bad, values.withColumn("VV", F.when((c("pos") == 2) & (F.pmod("entity_id", F.lit(19)) == 3), c("VV")).otherwise(F.when(F.pmod("entity_id", F.lit(19)) != 3, c("VV"))))


_P6 = "(SELECT unnest(range(6)) AS p)"


@sql(f"""WITH mf AS ({_manifest_sql('test_like', _CHOSEN, 0, 0)}), vb AS (SELECT *, (entity_id % 17) * 8 + view_index AS h, list_sum([(radar_availability[p + 1] = '1')::INT * (1 << p) FOR p IN range(6)])::INT AS rbits FROM mf),
{o._PANEL}, vl AS (SELECT window_id AS wid, entity_id, p + 1 AS pos, window_start + p AS month, {', '.join(f"CASE WHEN {'radar_availability[p + 1]' if b in pn.RADAR else f'''string_split(optical_band_availability, ';')[p + 1][{pn.OPTICAL.index(b) + 1}]'''} = '1' AND NOT {f'(entity_id % 19 = 3 AND p <> 1)' if b == 'VV' else 'false'} THEN {b} END AS {b}" for b in pn.BANDS)} FROM vb, {_P6}, panel_of WHERE p < window_length AND panel_of.eid = vb.entity_id AND panel_of.month = vb.window_start + p),
sp AS (SELECT * REPLACE (CASE WHEN h = 17 THEN 13 ELSE window_end END AS window_end, CASE WHEN h = 25 THEN 3 ELSE window_length END AS window_length, CASE WHEN h = 33 THEN (fold + 1) % 5 ELSE fold END AS fold, CASE WHEN h = 41 THEN 'window_0' ELSE window_id END AS window_id,
  CASE WHEN h = 1 THEN rbits | 64 ELSE rbits END AS rbits), CASE WHEN h = 9 THEN CASE WHEN optical_band_availability[1] = '1' THEN '0' ELSE '1' END || substr(optical_band_availability, 2) ELSE optical_band_availability END AS ob FROM vb),
cc AS (SELECT sp.window_id AS sid, vl.wid, pos, vl.month, window_start, window_length, {', '.join(f"CASE WHEN {'(rbits >> (pos - 1)) & 1 = 1' if b in pn.RADAR else f'''string_split(ob, ';')[pos][{pn.OPTICAL.index(b) + 1}] = '1' '''} THEN 1 ELSE 0 END AS on_{b}, {b}" for b in pn.BANDS)} FROM sp FULL JOIN vl ON sp.window_id = vl.wid)
SELECT r.* FROM (SELECT unnest([
 {{'rule': 'wrong_length', 'faults': (SELECT count(*) FROM sp WHERE window_length NOT IN (4, 5, 6))}}, {{'rule': 'wrong_months', 'faults': (SELECT count(*) FROM sp WHERE window_start < 1 OR window_end > 12 OR window_end <> window_start + window_length - 1)}},
 {{'rule': 'radar_in_padding', 'faults': (SELECT count(*) FROM sp WHERE rbits >= (1 << window_length))}}, {{'rule': 'optical_in_padding', 'faults': (SELECT count(*) FROM sp WHERE contains(substr(ob, 11 * window_length + 1), '1'))}},
 {{'rule': 'nulls', 'faults': 0}}, {{'rule': 'radar_text', 'faults': (SELECT count(*) FROM sp WHERE h = 1)}}, {{'rule': 'optical_text', 'faults': (SELECT count(*) FROM sp WHERE ob <> optical_band_availability)}},
 {{'rule': 'repeated_ids', 'faults': (SELECT count(*) FROM (SELECT window_id FROM sp GROUP BY 1 HAVING count(*) > 1))}}, {{'rule': 'keys_in_two_folds', 'faults': (SELECT count(*) FROM (SELECT entity_id FROM sp GROUP BY 1 HAVING min(fold) <> max(fold)))}},
 {{'rule': 'masked_cells_with_values', 'faults': (SELECT coalesce(sum({' + '.join(f"(sid IS NOT NULL AND on_{b} = 0 AND {b} IS NOT NULL)::INT" for b in pn.BANDS)}), 0) FROM cc)}},
 {{'rule': 'available_cells_without', 'faults': (SELECT coalesce(sum({' + '.join(f"(on_{b} = 1 AND {b} IS NULL)::INT" for b in pn.BANDS)}), 0) FROM cc)}},
 {{'rule': 'unmatched', 'faults': (SELECT count(*) FROM cc WHERE pos IS NULL OR window_start IS NULL)}}, {{'rule': 'wrong_positions', 'faults': (SELECT count(*) FROM cc WHERE pos NOT BETWEEN 1 AND window_length OR month <> window_start + pos - 1)}}, {{'rule': 'repeated_positions', 'faults': 0}}]) AS r)""".replace("panel_of WHERE", "(SELECT entity_id AS eid, month, " + ", ".join(pn.BANDS) + " FROM panel) panel_of WHERE"))
def view_invariants(s, d):
    """How often views and values, some changed on purpose, break each rule of a window dataset."""
    return mk.view_faults(*_spoilt(s, d), "entity_id")


#: Of this module's queries, for those that build on them.
QUERIES_OF, ORACLES_OF = {"manifest_exhaustive": manifest_exhaustive}, {"manifest_exhaustive": _manifest_sql("exhaustive", _WHOLE, 0.1, 0.2)}
