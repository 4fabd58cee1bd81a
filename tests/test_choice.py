import random

import pytest
from pyspark.sql import functions as F

from gapseries.operators import adapt, choice
from gapseries.operators import evaluation as ev


def scored(spark, n, seed, repeats=2, folds=3):
    """Scores of all kinds: on the threshold, equal to each other, at the ends, crossing it."""
    r = random.Random(seed)
    def p():
        return r.choice([0.0, 0.5, 1.0, 0.499999999999, round(r.random(), 2), round(r.random(), 9)])
    rows = [(k, i, int(r.random() < 0.4), i % folds, a := p(), a if r.random() < 0.1 else p()) for k in range(repeats) for i in range(n)]
    return spark.createDataFrame(rows, "repeat int, id int, label int, fold int, p1 double, p2 double")


def table(df, *cols):
    return {tuple(r[c] for c in cols[:-1]): r[cols[-1]] for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_sweep_counts_what_the_grid_counts(spark, seed):
    rows = scored(spark, 60, seed)
    grid, swept = (f(rows, ["repeat"], "p1", "p2", "label") for f in (ev.blend_grid, choice.sweep))
    for c in ("n", "positives", "tp", "fp", "fn", "tn"):
        assert table(grid, "repeat", "wi", c) == table(swept, "repeat", "wi", c)
    for c in ("f1", "brier"):
        want = table(grid, "repeat", "wi", c)
        assert len(want) == 202
        assert table(swept, "repeat", "wi", c) == pytest.approx(want, abs=1e-9)


def test_sweep_refuses_what_the_grid_refuses(spark):
    for bad in ((None, 0.5), (float("nan"), 0.5), (0.5, 1.5)):
        rows = spark.createDataFrame([(0, 1, *bad)], "repeat int, label int, p1 double, p2 double")
        with pytest.raises(Exception, match="scores must be"):
            choice.sweep(rows, ["repeat"], "p1", "p2", "label").collect()


def test_sweep_of_nothing(spark):
    assert choice.sweep(scored(spark, 0, 1), ["repeat"], "p1", "p2", "label").count() == 0


@pytest.mark.parametrize(("seed", "label"), [(0, "label"), (1, "label"), (2, "one")])
def test_nested_weights_are_those_of_the_whole_grid(spark, seed, label):
    rows = scored(spark, 45, seed).withColumn("one", F.lit(1)).cache()
    held = rows.select("repeat", F.col("fold").alias("held")).distinct()
    others = rows.join(held, "repeat").filter("fold <> held")
    grid = ev.best_weight(ev.blend_grid(others, ["repeat", "held"], "p1", "p2", label), ["repeat", "held"])
    got = choice.nested(rows, "repeat", "fold", "p1", "p2", label).cache()
    for c in ("weight", "combined", "brier", "log_loss"):
        want = table(grid, "repeat", "held", c)
        mine = table(got, "repeat", "fold", c if c == "weight" else f"training_{c}")
        assert {k for k, v in want.items() if v is None} == {k for k, v in mine.items() if v is None}
        assert {k: v for k, v in mine.items() if v is not None} == pytest.approx({k: v for k, v in want.items() if v is not None}, abs=1e-9)
    w = {(r["repeat"], r["fold"]): r for r in got.collect()}
    for (k, f), r in w.items():
        mine = rows.filter((F.col("repeat") == k) & (F.col("fold") == f)).withColumn("p", F.round((1 - r["weight"]) * F.col("p1") + r["weight"] * F.col("p2"), 12))
        m = ev.metrics(mine, ["repeat"], "p", label).first()
        assert (r["heldout_f1"], r["heldout_brier"]) == pytest.approx((m["f1"], m["brier"]))


def test_few_weights_need_their_ranks(spark):
    r = random.Random(5)
    rows = spark.createDataFrame([(0, y := i % 2, min(1.0, max(0.0, r.gauss(0.3 + 0.4 * y, 0.2))), r.random()) for i in range(400)], "repeat int, label int, p1 double, p2 double")
    t = choice.sweep(rows, ["repeat"], "p1", "p2", "label")
    kept = choice.can_win(t, choice.auc_bounds(choice.score_cells(rows, ["repeat"], "p1", "p2", "label"), ["repeat"]), ["repeat"])
    best = ev.best_weight(ev.blend_grid(rows, ["repeat"], "p1", "p2", "label"), ["repeat"]).first()["wi"]
    found = {r["wi"] for r in kept.collect()}
    assert best in found
    assert len(found) < 30


def test_nearly_best_blend_nearest_to_one_half(spark):
    rows = [("fixed", 0.7, 0.80, 0.9000), ("fixed", 0.5, 0.81, 0.8999), ("fixed", 0.4, 0.9, 0.8990), ("nested", 0.6, 0.99, 0.99)]
    got = choice._marked(spark.createDataFrame(rows, "candidate string, weight double, repeat_mean double, robust double"))
    assert [(r["candidate"], r["weight"]) for r in got.filter("chosen").collect()] == [("fixed", 0.5)]


@pytest.mark.parametrize(("sigmoid", "beta", "chosen"), [
    ((0.80005, 0.7), (0.8, 0.7), "none"),  # gains too little
    ((0.81, 0.69), (0.8, 0.7), "none"),  # loses too much
    ((0.81, 0.69997), (0.805, 0.7), "sigmoid"),
    ((0.81, 0.7), (0.82, 0.75), "beta"),
    ((0.7, 0.6), (0.6, 0.6), "none"),
])
def test_calibrators_must_earn_their_place(spark, sigmoid, beta, chosen):
    rows = [("none", 0.8, 0.7), ("sigmoid", *sigmoid), ("beta", *beta)]
    reports = spark.createDataFrame(rows, "method string, robust double, repeat_mean double")
    assert [r["method"] for r in choice.adopted(reports).filter("chosen").collect()] == [chosen]
    with pytest.raises(Exception, match="one report of method none"):
        choice.adopted(reports.filter("method <> 'none'")).collect()


def windows(spark, n=80, noise=False):
    """Whether x is missing tells the label; z is noise. Two folds, one repeat."""
    r = random.Random(3)
    rows = [(i, 0, i % 2, y := int(r.random() < 0.5), None if y and not noise else r.random(), r.choice([float("nan"), float("inf"), r.random()]), m + 4, 1 + m, m + 4, 4, 0) for i in range(n) for m in range(3)]
    return spark.createDataFrame(rows, "id int, repeat int, fold int, label int, x double, z double, window_length int, window_start int, radar_months int, optical_months int, gaps int") if noise else _one_label(spark, rows)


def _one_label(spark, rows):
    r = random.Random(4)
    label = {i: int(r.random() < 0.5) for i in {x[0] for x in rows}}
    return spark.createDataFrame([(*x[:3], label[x[0]], None if label[x[0]] else 0.5, *x[5:]) for x in rows], "id int, repeat int, fold int, label int, x double, z double, window_length int, window_start int, radar_months int, optical_months int, gaps int")


def test_gaps_are_features_and_fits_repeat(spark):
    rows = windows(spark)
    runs = [adapt.sweep(rows, ["x", "z"], "id", "label", {"all": adapt.Method(), "less": adapt.Method(removed=("x",))}, iterations=4) for _ in range(2)]
    one, two = (sorted(map(tuple, scored.select("method", "id", "window_length", "p").collect())) for scored, _ in runs)
    assert one == two
    assert len(one) == 2 * rows.count()
    assert sorted(map(tuple, runs[0][1].collect())) == sorted(map(tuple, runs[1][1].collect()))
    gains = {(r["method"], r["fold"], r["feature"]): r for r in runs[0][1].collect()}
    assert gains["all", 0, "x"]["importance"] > 0.9
    assert gains["all", 0, "x"]["splits"] >= 1
    assert ("less", 0, "x") not in gains
    rep = {(r["method"], r["fold"]): r for r in adapt.report(*runs[0], "id", "label").collect()}
    assert {k for k in rep} == {(m, f) for m in ("all", "less") for f in (0, 1)}
    assert rep["all", 0]["auc"] == 1.0
    assert rep["less", 0]["auc"] < 0.8
    assert rep["all", 1]["features"] == 2
    assert rep["all", 0]["robust"] > rep["less", 0]["robust"]


def test_fits_stop_early_on_noise(spark):
    data = adapt.stopped(adapt.with_gaps(windows(spark, noise=True), ["z"]), "id").withColumn("w", F.lit(1.0))
    assert data.groupBy("id").agg(F.count_distinct("_stop").alias("n")).filter("n > 1").count() == 0
    assert adapt.boosted(data, ["z"], "label", "w", iterations=12).stages[-1].getNumTrees < 12


def test_sweep_refuses(spark):
    rows = windows(spark, 20)
    some = rows.select("id").distinct()
    for methods, said in [
        ({"a": adapt.Method(removed=("y",))}, "cannot remove"),
        ({"a": adapt.Method(removed=("x", "z"))}, "cannot remove"),
        ({"a": adapt.Method(weights=some.filter("id > 0").withColumn("importance_weight", F.lit(1.0)))}, "importance weight for 0"),
        ({"a": adapt.Method(weights=some.union(some).withColumn("importance_weight", F.lit(1.0)))}, "importance weight"),
        ({"a": adapt.Method(weights=some.withColumn("importance_weight", F.lit(0.0)))}, "importance weight"),
        ({"a": adapt.Method(weights=some.withColumn("importance_weight", F.lit(float("inf"))))}, "importance weight"),
    ]:
        with pytest.raises(Exception, match=said):
            adapt.sweep(rows, ["x", "z"], "id", "label", methods)
    with pytest.raises(ValueError, match="in two folds"):
        adapt.sweep(rows.withColumn("fold", F.col("window_start") % 2), ["x", "z"], "id", "label", {"a": adapt.Method()})
