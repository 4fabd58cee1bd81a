"""Ranges, running sums, exact quantiles and guarded statistics: spread, crowded and degenerate values against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapseries.operators import evaluation as ev
from gapseries.operators import features as ft
from gapseries.operators import oof, ordered
from gapseries.operators import panel as pn


def values():
    r = random.Random(4)
    made = {"even": [r.random() for _ in range(700)], "ties": [float(r.randrange(5)) for _ in range(300)], "wide": [s * 10.0 ** r.randrange(-300, 300) for s in (1, -1) for _ in range(150)], "crowded": [1.0 + r.random() * 1e-9 for _ in range(400)] + [-1e12, 1e12]}
    return made | {"one": [3.5], "zero": [0.0, -0.0, 0.0], "huge": [1.7e308, -1.7e308, 0.0], "two": [1.0, 2.0]}


@pytest.fixture(scope="module")
def long(spark):
    rows = [(k, float(x), i % 2) for k, v in values().items() for i, x in enumerate(v)] + [("even", None, 0), ("none", None, 1)]
    return spark.createDataFrame(rows, "k string, x double, domain int").repartition(5).persist()


@pytest.mark.parametrize("crowded", [1 << 16, 3])
def test_quantiles_are_exact(spark, long, monkeypatch, crowded):
    monkeypatch.setattr(ordered, "CROWDED", crowded)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["k"]: r["quantiles"] for r in ordered.quantiles(long, ["k"], "x", probs).collect()}
    assert set(got) == set(values())
    for k, v in values().items():
        if k != "huge":
            assert np.allclose(got[k], np.quantile(v, probs), rtol=1e-12, atol=0)
    plan = ordered.quantiles(long, ["k"], "x", probs)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_set" not in plan


def test_quantiles_of_all_and_of_none(spark, long):
    assert ordered.quantiles(long.filter("k = 'two'"), [], "x", [0.5]).first()["quantiles"] == [1.5]
    assert ordered.quantiles(long.filter("k = 'none'"), ["k"], "x", [0.5]).count() == 0


def test_cells_never_fall(spark):
    xs = sorted({s * (b + d * math.ulp(b)) for s in (1, -1) for b in [2.0**e for e in range(-1070, 1020, 7)] + [8.0, 1000.0, 1e-300] for d in (-1, 0, 1)} | {0.0})
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", ordered.cell(F.col("x")).alias("c")).orderBy("x").collect()
    assert all(a["c"] <= b["c"] for a, b in zip(rows, rows[1:]))
    ps = sorted({min(max(c + d, 0.0), 1.0) for c in (0.0, 0.25, 0.5, 1.0) for d in [s * 2.0**-e for s in (1, -1) for e in range(1, 54)] + [0.0]})
    rows = spark.createDataFrame([(x,) for x in ps], "x double").select("x", ordered.score_cell(F.col("x")).alias("c")).orderBy("x").collect()
    assert all(a["c"] <= b["c"] for a, b in zip(rows, rows[1:])) and len({r["c"] for r in rows}) > 0.4 * len(ps)


@pytest.mark.parametrize("crowded", [1 << 16, 3])
def test_running_sums(spark, long, monkeypatch, crowded):
    monkeypatch.setattr(ordered, "CROWDED", crowded)
    by = long.filter("x is not null").groupBy("k", "x").agg(F.count("*").alias("c"))
    for r in ordered.running(by, ["k"], "x", ["c"]).collect():
        assert r["before_c"] == sum(v < r["x"] for v in values()[r["k"]]) and r["all_c"] == len(values()[r["k"]])


def test_shift_of_features_of_one_domain(spark):
    rows = [("both", float(i % 7), i % 2) for i in range(60)] + [("first", float(i), 0) for i in range(9)] + [("first", None, 1)] + [("second", 1.0, 1)] + [("same", 4.0, i % 2) for i in range(6)] + [("none", None, 0)]
    d = spark.createDataFrame(rows, "feature string, x double, domain int")
    got = {r["feature"]: r.asDict() for r in oof.shift_table(d).collect()}
    for f in ("first", "second", "none"):
        assert got[f]["ks"] is None and got[f]["wasserstein"] is None and got[f]["psi"] is None
    assert got["first"]["median_0"] == 4.0 and got["first"]["median_1"] is None and got["second"]["mean_0"] is None and got["first"]["missing_rate_1"] == 1.0
    assert got["both"]["ks"] is not None and got["both"]["psi"] > 0 and (got["same"]["ks"], got["same"]["wasserstein"], got["same"]["psi"]) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize(("p", "y", "said"), [(None, 1, "scores"), (float("nan"), 1, "scores"), (1.5, 0, "scores"), (-0.1, 0, "scores"), (0.5, 2, "labels"), (0.5, None, "labels")])
def test_metrics_refuse_bad_input(spark, p, y, said):
    d = spark.createDataFrame([("a", 0.2, 0), ("a", 0.7, 1), ("a", p, y)], "g string, p double, y int")
    with pytest.raises(Exception, match=said):
        ev.metrics(d, ["g"], "p", "y").collect()


def test_metrics_of_crowded_scores(spark):
    r = random.Random(1)
    rows = [(1 - 2.0 ** -r.randrange(1, 53), int(r.random() < 0.6)) for _ in range(300)] + [(2.0 ** -r.randrange(1, 300), int(r.random() < 0.3)) for _ in range(300)]
    got = ev.metrics(spark.createDataFrame([("a", *x) for x in rows], "g string, p double, y int"), ["g"], "p", "y").first()
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    assert abs(got["auc"] - sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)) < 1e-12


def test_folds_refuse_keys_with_two_labels(spark):
    d = spark.createDataFrame([(1, 0), (1, 0), (2, 1)], "k long, y int")
    assert ev.folds(d, "k", "y").count() == 2
    for bad in ((1, 1), (3, None)):
        with pytest.raises(Exception, match="not one value"):
            ev.folds(d.union(spark.createDataFrame([bad], "k long, y int")), "k", "y").collect()


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), -float("inf")])
def test_cells_that_are_no_number_are_missing(spark, bad):
    rows = [(1, m, *[float(m + i) if m != 3 else bad for i in range(12)]) for m in range(1, 7)]
    p = pn.dense(spark.createDataFrame(rows, "k long, month int, " + ", ".join(f"{b} double" for b in pn.BANDS)), ["k"])
    c = {r["month"]: r for r in ft.with_channels(p, "k", "month").collect()}
    assert all(c[3][n] is None for n in ft.channel_names()) and c[4]["radar__vv_first_difference"] is None and c[2]["radar__vv"] == 3.0
    for x in ft.aggregates(ft.long_channels(p, ["k"], "month", list(pn.BANDS)), ["k", "channel"]).collect():
        assert x["valid_count"] == 5 and all(x[s] is not None and math.isfinite(x[s]) for s in ft.STATS)
    for x in ft.window_statistics(ft.channel_arrays(p, "k"), "k").filter("window_id = '1:4:1' and channel = 'radar__vv'").collect():
        assert x["valid_count"] == 3 and x["first_to_last"] == 3.0


def test_deviation_of_large_means(spark):
    r = random.Random(9)
    rows = [(f, "c", 1e9 + f + r.random()) for f in range(3) for _ in range(50)]
    got = {x["fold"]: x for x in oof.normaliser(spark.createDataFrame(rows, "fold int, channel string, x double")).collect()}
    for f in range(3):
        v = np.array([x for k, _, x in rows if k != f]) - 1e9
        assert abs(got[f]["std"] / v.std() - 1) < 1e-6 and abs(got[f]["mean"] - 1e9 - v.mean()) < 1e-6


def test_keys_without_radar_are_an_error(spark):
    rows = [(1, 1, *[1.0] * 12), (2, 1, None, *[1.0] * 11)]
    p = pn.dense(spark.createDataFrame(rows, "k long, month int, " + ", ".join(f"{b} double" for b in pn.BANDS)), ["k"])
    with pytest.raises(Exception, match="no radar month"):
        pn.observed_windows(p, "k").collect()


def test_robust_score_of_one_pass(spark):
    """All levels from one scan: the same figures as level by level, and errors where a component is undefined."""
    r = random.Random(3)
    rows = [(k, rep, k % 5, k % 2, n, a, n, r.randrange(n + 1), r.random()) for k in range(60) for rep in range(2) for n in (4, 5, 6) for a in range(1, 14 - n, 2)]
    w = spark.createDataFrame(rows, "k long, repeat int, fold int, y int, window_length int, window_start int, radar_months int, optical_months int, p double").withColumn("gaps", F.col("radar_months") - F.col("optical_months"))
    levels = ev.level_metrics(w, ["repeat"], "k", "p", "y")
    o = w.groupBy("repeat", "k", "fold", "y").agg(ev.mean9("p").alias("p"))
    apart = ev.robust(ev.metrics(o, ["repeat"], "p", "y"), ev.metrics(o, ["repeat", "fold"], "p", "y"), ev.slice_metrics(w, ["repeat"], "k", "p", "y")).first().asDict()
    got = ev.robust_of_levels(levels).first().asDict()
    assert set(got) == set(apart) and all(abs(got[c] - apart[c]) < 1e-12 for c in got)
    plan = ev.robust_of_levels(levels)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ExistingRDD") + plan.count("LocalTableScan") == 1 and "Join" not in plan
    with pytest.raises(Exception, match="undefined"):
        ev.robust_of_levels(ev.level_metrics(w.filter("fold <> 1 or y = 1"), ["repeat"], "k", "p", "y")).collect()
    with pytest.raises(Exception, match="4, 5 and 6"):
        ev.robust_of_levels(ev.level_metrics(w.filter("window_length < 6"), ["repeat"], "k", "p", "y")).collect()
    with pytest.raises(Exception, match="in two folds"):
        ev.level_metrics(w.withColumn("fold", F.when(F.col("window_length") == 5, 4).otherwise(F.col("fold"))), ["repeat"], "k", "p", "y").collect()
