"""Operators that SQL does not hold: fits against plain Newton steps, errors that must be raised, and cases the tables never have."""

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gapseries.operators import evaluation as ev
from gapseries.operators import features as ft
from gapseries.operators import models, oof
from gapseries.operators import panel as pn
from gapseries.operators import selection as sel
from gapseries.sources import fingerprint


def test_feature_sets_have_their_sizes():
    sizes = {"relative": 238, "invariant": 496, "full": 688, "radar": 186, "optical": 515, "compact": 101}
    assert {k: len(sel.names_of(k)) for k in sizes} == sizes
    for k in sizes:
        sel.check_names(sel.names_of(k))
    with pytest.raises(ValueError):
        sel.check_names(["radar__vv", "metadata__fold"])
    with pytest.raises(ValueError):
        sel.names_of("other")


def test_radar_counts_are_shared(spark):
    rows = [(1, m, 1.0 if m != 2 else None, 2.0, *[1.0] * 10) for m in range(1, 13)]
    panel = spark.createDataFrame(rows, "entity_id int, month int, VH double, VV double, " + ", ".join(f"{b} double" for b in pn.OPTICAL))
    got = {r["window_id"]: r for r in ft.metadata(ft.sliding_views(panel, "entity_id"), "entity_id").collect()}
    assert got["1:4:1"]["vh_valid_count"] == got["1:4:1"]["vv_valid_count"] == 3 and got["1:4:3"]["vv_valid_count"] == 4
    full = {r["window_id"]: r for r in sel.matrix(ft.channel_arrays(panel, "entity_id"), "entity_id").collect()}
    assert len(full) == 24 and full["1:4:1"]["metadata__vv_valid_count"] == 3 and full["1:4:1"]["relative__position_05__radar__vv"] is None


def test_calibrators_are_those_of_plain_newton_steps(spark):
    r = random.Random(5)
    rows = [(0, i % 3, int(r.random() < 0.5 + 0.4 * (p - 0.5)), p) for i, p in enumerate(r.uniform(0.02, 0.98) for _ in range(240))]
    df = spark.createDataFrame(rows, "repeat int, fold int, label int, p double")
    for how in ("sigmoid", "beta"):
        got = {x["fold"]: x for x in oof.fit_calibrators(df, "p", "label", how).collect()}
        for held in range(3):
            p = np.array([x[3] for x in rows if x[1] != held])
            y = np.array([x[2] for x in rows if x[1] != held], float)
            x = np.stack([np.log(p / (1 - p)), np.ones(len(p))] if how == "sigmoid" else [np.log(p), -np.log(1 - p), np.ones(len(p))], axis=1)
            t, ridge = np.zeros(x.shape[1]), np.diag([0.1] * (x.shape[1] - 1) + [0.0])
            for _ in range(60):
                m = 1 / (1 + np.exp(-x @ t))
                t -= np.linalg.solve(x.T @ (x * (m * (1 - m))[:, None]) + ridge, x.T @ (m - y) + ridge @ t)
            want = [t[0], 0.0 if how == "sigmoid" else t[1], t[-1]]
            assert np.allclose([got[held]["a"], got[held]["b"], got[held]["c"]], want, atol=1e-6)


def test_undefined_scores_are_errors(spark):
    one = spark.createDataFrame([(0, 0, 0.5), (1, 0, None)], "repeat int, fold int, combined double")
    slices = spark.createDataFrame([("window_length", str(n), 0.5) for n in (4, 5, 6)] + [("season", "01-03", 0.5)], "slice_group string, slice_value string, combined double")
    whole = one.filter("repeat = 0")
    assert ev.robust(whole, whole, slices).first()["robust"] == pytest.approx(0.5)
    for bad in ((one, whole, slices), (whole, one, slices), (whole, whole, slices.filter("slice_value <> '5'"))):
        with pytest.raises(PySparkException):
            ev.robust(*bad).collect()


def test_models_that_are_not_one_to_one_are_errors(spark):
    a = spark.createDataFrame([(1, 0.1), (2, 0.2)], "id int, p double")
    assert oof.aligned(a, a, ["id"], ("a", "b")).count() == 2
    for b in (a.filter("id = 1"), a.union(a)):
        with pytest.raises(PySparkException):
            oof.aligned(a, b, ["id"], ("a", "b")).collect()
    w = spark.createDataFrame([(0, 1, 0, 1, 0.4, 3), (0, 1, 1, 1, 0.4, 3)], "repeat int, entity_id int, fold int, label int, p double, optical_months int")
    with pytest.raises(PySparkException):
        oof.originals(w, "entity_id", "p", "label").collect()


def test_constant_scores_have_no_correlation(spark):
    rows = spark.createDataFrame([(0.5, 0.1, 1), (0.5, 0.9, 0), (0.5, 0.4, 1)], "a double, b double, label int")
    got = ev.pairwise(rows, "a", "b", "label").first()
    assert got["pearson"] is None and got["spearman"] is None and got["n"] == 3 and got["shared_errors"] == 1


def test_fingerprints_count_repeated_rows(spark):
    of = lambda *x: fingerprint(spark.createDataFrame([(i,) for i in x], "a int")).first()["fingerprint"]
    assert of(1, 2, 3, 3) != of(1, 2, 4, 4) and of(1, 2, 3) == of(3, 1, 2) and of(1) != of(1, 1)


def test_holdout_gives_the_last_class_what_is_left(spark):
    rows = spark.createDataFrame([(i, int(i % 5 < 2), (i * 37 % 100) / 100) for i in range(98)], "id int, label int, p double")
    got = ev.similarity_holdout(rows, "id", "p", "label").collect()
    assert len(got) == 20 and sum(r["label"] == 0 for r in got) == round(20 * rows.filter("label = 0").count() / 98)
    for label in (0, 1):
        best = [r["id"] for r in rows.filter(F.col("label") == label).orderBy(F.desc("p"), "id").collect()]
        assert {r["id"] for r in got if r["label"] == label} == set(best[: sum(r["label"] == label for r in got)])


def test_curves_over_ranges_are_those_of_the_whole(spark):
    r = random.Random(9)
    rows = [(int(r.random() < 0.4), round(r.gauss(0, 1), 2)) for _ in range(3000)]
    got = ev.ecdf_shift(spark.createDataFrame([("f", d, x) for d, x in rows], "feature string, domain int, x double"), ["feature"], "x", "domain").first()
    at = sorted({x for _, x in rows})
    a, b = (np.sort([x for d, x in rows if d == k]) for k in (0, 1))
    d = np.abs(np.searchsorted(a, at, side="right") / len(a) - np.searchsorted(b, at, side="right") / len(b))
    assert got["ks"] == pytest.approx(d.max()) and got["wasserstein"] == pytest.approx(float((d[:-1] * np.diff(at)).sum()))


def test_permutation_deals_each_value_once(spark):
    r = random.Random(2)
    rows = spark.createDataFrame([(i, i % 2, int(r.random() < 0.5), r.random(), r.random()) for i in range(200)], "id int, fold int, label int, x double, y double").repartition(7)
    rows = rows.withColumn("x", F.col("label") + F.col("x") / 10)
    got = models.permutation_importance(rows, ["x", "y"], "label", "fold", "id").collect()
    assert [(g["feature"], g["fold"], g["n"]) for g in got] == [("x", 0, 100), ("y", 0, 100), ("x", 1, 100), ("y", 1, 100)]
    assert all(g["delta"] > 0.1 for g in got if g["feature"] == "x") and all(abs(g["delta"]) < 0.1 for g in got if g["feature"] == "y")


def test_sentinels_become_nulls(spark):
    wide = spark.createDataFrame([(1, -9999.0, 3.0)], "id int, VV_01 double, nir_01 double")
    assert pn.sentinel_to_null(wide, ["VV_01", "nir_01"]).first().asDict() == {"id": 1, "VV_01": None, "nir_01": 3.0}
