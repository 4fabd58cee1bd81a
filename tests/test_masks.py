"""Masks by band: packed bits against flags kept apart, partial months, dropout, and a faulty table for every rule."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from gapseries.operators import masks as mk
from gapseries.operators import panel as pn

SCHEMA = "k long, month int, " + ", ".join(f"{b} double" for b in pn.BANDS)


def observed(spark, cells):
    """cells: key -> month -> bands that are there."""
    return spark.createDataFrame([(k, m, *[float(m) if b in on else None for b in pn.BANDS]) for k, months in cells.items() for m, on in months.items()], SCHEMA)


def draw(seed, first, n):
    r = random.Random(seed)
    return {m: set(pn.RADAR) | {b for b in pn.OPTICAL if r.random() < 0.7} for m in range(first, first + n)}


def flags(months):
    radar = [int(set(pn.RADAR) <= months.get(m, set())) for m in range(1, 13)]
    return radar, [[int(b in months.get(m, set())) for b in pn.OPTICAL] for m in range(1, 13)]


CELLS = {k: draw(k, 1 + k % 7, 4 + k % 3) for k in range(20)} | {20: draw(3, 4, 4)}  # key 20 has the pattern of key 3


def test_library_of_packed_masks(spark):
    lib = mk.library(mk.observed_masks(observed(spark, CELLS), "k"))
    got = {r["mask_id"]: r for r in mk.library_texts(lib).collect()}
    want = {}
    for months in CELLS.values():
        radar, optical = flags(months)
        said = json.dumps({"radar": radar, "optical": optical, "optical_bands": list(pn.OPTICAL)}, sort_keys=True, separators=(",", ":"))
        want.setdefault("mask_" + hashlib.sha256(said.encode()).hexdigest()[:16], []).append((radar, optical))
    assert set(got) == set(want)
    for i, rows in want.items():
        radar, optical = rows[0]
        r, whole = got[i], [int(all(m)) for m in optical]
        join = lambda x: "".join(map(str, x))
        first = radar.index(1) + 1
        assert (r["frequency"], r["window_start"], r["window_end"], r["window_length"]) == (len(rows), first, first + sum(radar) - 1, sum(radar))
        assert (r["radar_availability"], r["optical_month_availability"], r["optical_band_availability"]) == (join(radar), join(whole), ";".join(map(join, optical)))
        assert r["internal_optical_gap_count"] == sum(a and not b for a, b in zip(radar, whole))


ALL = set(pn.BANDS)
FAULTY = {
    1: ("no_radar", {m: {"blue"} for m in range(3, 7)}), 2: ("radar_gap", {m: ALL for m in (3, 4, 6, 7)}), 3: ("wrong_length", {m: ALL for m in (3, 4, 5)}), 4: ("wrong_length", {m: ALL for m in range(1, 8)}),
    5: ("optical_outside", {m: ALL for m in range(1, 5)} | {9: {"red"}}), 6: ("partial_radar", {m: ALL for m in range(5, 10)} | {2: {"VV"}}), 7: (None, {m: ALL for m in range(7, 13)}), 8: ("optical_outside", {m: ALL for m in range(7, 11)} | {6: {"swir2"}}),
}


@pytest.mark.parametrize("k", sorted(FAULTY))
def test_each_rule_of_masks(spark, k):
    rule, months = FAULTY[k]
    masks = mk.observed_masks(observed(spark, {k: months}), "k")
    found = {n for n, v in mk.mask_faults(masks).first().asDict().items() if v and n != "rows"}
    assert (rule in found if rule else not found) and found <= {rule, "wrong_length", "optical_outside"}
    if rule:
        with pytest.raises(Exception, match="breaks a rule"):
            mk.library(masks).collect()
    else:
        assert mk.library(masks).count() == 1


def views_of(spark, cells, **how):
    lib = mk.library(mk.observed_masks(observed(spark, cells), "k"))
    chosen = lib.withColumns({"k": F.lit(100).cast("long"), "fold": F.lit(2), "label": F.lit(1), "view_index": F.row_number().over(mk_order()) - 1})
    return mk.masked_views(chosen, "k", "test_like", **how)


def mk_order():
    from pyspark.sql import Window

    return Window.orderBy("mask_id")


def whole_panel(spark):
    return spark.createDataFrame([(100, m, *[10.0 * m + i for i in range(12)]) for m in range(1, 13)], SCHEMA)


def test_a_month_that_lacks_one_band_loses_only_that(spark):
    months = {m: ALL for m in range(7, 13)} | {9: ALL - {"blue"}}
    v = views_of(spark, {1: months})
    r = v.first()
    assert r["radar_availability"] == "111111" and r["optical_month_availability"] == "110111" and r["optical_months"] == 5 and r["internal_optical_gap_count"] == 1 == r["test_mask_optical_gap_count"]
    assert r["optical_band_availability"].split(";") == ["1" * 10] * 2 + ["0" + "1" * 9] + ["1" * 10] * 3
    panel = whole_panel(spark)
    values = {x["month"]: x for x in mk.view_values(v, panel, "k").collect()}
    assert sorted(values) == list(range(7, 13)) and [x["pos"] for _, x in sorted(values.items())] == list(range(1, 7))
    assert values[9]["blue"] is None and all(values[9][b] == 90.0 + i for i, b in enumerate(pn.BANDS) if b != "blue") and all(values[m][b] is not None for m in (7, 8, 10) for b in pn.BANDS)
    assert all(x["faults"] == 0 for x in mk.view_faults(v, mk.view_values(v, panel, "k"), "k").collect())


@pytest.mark.parametrize("first", range(1, 9))
def test_windows_across_the_two_halves(spark, first):
    n = min(6, 13 - first)
    months = draw(first, first, n)
    r = views_of(spark, {1: months}).first()
    assert (r["window_start"], r["window_length"]) == (first, n)
    want = ["".join(str(int(b in months[first + p])) for b in pn.OPTICAL) if p < n else "0" * 10 for p in range(6)]
    assert r["optical_band_availability"] == ";".join(want) and r["position_mask"] == "1" * n + "0" * (6 - n) == r["radar_availability"]


def test_dropout_and_padding_are_told_apart(spark):
    months = {m: ALL for m in range(2, 6)} | {3: {"VV", "VH", "red"}}
    every = views_of(spark, {1: months}, temporal=1.0).first()
    assert every["temporal_dropout_mask"] == "111100" == every["position_mask"] and every["radar_months"] == 0 == every["optical_months"] and every["optical_dropout_mask"] == "000000"
    dark = views_of(spark, {1: months}, optical=1.0).first()
    assert dark["optical_dropout_mask"] == "111100" and dark["radar_months"] == 4 and dark["optical_band_availability"] == ";".join(["0" * 10] * 6) and dark["internal_optical_gap_count"] == 4
    assert every["window_id"] != dark["window_id"] != views_of(spark, {1: months}).first()["window_id"]


def test_every_rule_of_views_is_counted(spark):
    v = views_of(spark, {1: {m: ALL for m in range(2, 6)}, 2: {m: ALL - {"nir"} for m in range(3, 9)}})
    panel, c = whole_panel(spark), F.col
    first, flat = c("view_index") == 0, mk.view_values(v, panel, "k")

    def faults(views, values=flat):
        return {r["rule"]: r["faults"] for r in mk.view_faults(views, values, "k").collect() if r["faults"]}

    def change(name, value):
        return v.withColumn(name, F.when(first, value).otherwise(c(name)))

    assert faults(v) == {}
    assert faults(change("radar_bits", c("radar_bits").bitwiseOR(F.lit(64)))) == {"radar_in_padding": 1, "radar_text": 1}
    assert faults(change("optical_bits", F.lit((1 << 60) - 1)))["optical_text"] == 1
    assert faults(change("window_end", F.lit(13))) == {"wrong_months": 1}
    assert faults(change("window_id", F.lit(None).cast("string")))["nulls"] == 1
    assert faults(change("fold", F.lit(4))) == {"keys_in_two_folds": 1}
    assert faults(v.withColumn("window_id", F.lit("w")), flat.withColumn("window_id", F.lit("w")))["repeated_ids"] == 1
    assert faults(v, flat.withColumn("nir", F.lit(1.0)))["masked_cells_with_values"] == 6
    for bad in (None, float("nan"), float("inf")):
        assert faults(v, flat.withColumn("VV", F.when(c("pos") == 4, F.lit(bad)).otherwise(c("VV")))) == {"available_cells_without": 2}
    assert faults(v, flat.filter("pos > 0 and month > 1").union(flat.filter("pos = 1"))) == {"repeated_positions": 2}
    assert faults(v.filter(first), flat)["unmatched"] in (4, 6)
    assert faults(v, flat.withColumn("month", c("month") + 1)) == {"wrong_positions": 10}
    assert faults(v.filter("false"), flat.filter("false")) == {}
