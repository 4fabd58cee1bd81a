"""Work that must not grow with partitions, copies of columns or passes: the same results from less."""

import random

import pytest
from pyspark.sql import functions as F

from gapseries.operators import adapt, choice, domains, models
from gapseries.operators import evaluation as ev
from gapseries.sources import stored


def test_fits_need_one_column_of_gaps_for_features_missing_together(spark):
    r = random.Random(7)
    rows = []
    for i in range(200):
        gone, y = r.random() < 0.4, int(r.random() < 0.5)
        x = lambda: r.random() + 0.3 * y  # noqa: B023, E731
        rows.append((i, y, None if gone else x(), float("nan") if gone else x(), None if r.random() < 0.3 else x(), x(), None))
    data = spark.createDataFrame(rows, "id int, label int, a double, b double, c double, d double, e double")
    features = list("abcde")
    data = adapt.stopped(adapt.with_gaps(data, features), "id").withColumn("w", F.lit(1.0)).coalesce(1)
    assert adapt.gap_classes(data, features) == [["a", "b"], ["c"]]
    assert adapt.gap_classes(data, ["b", "d"]) == [["b"]]
    assert adapt.gap_classes(data, ["d"]) == []
    every = adapt.boosted(data, features, "label", "w")
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    few = Pipeline(stages=[VectorAssembler(inputCols=[f"{c}__filled" for c in features] + ["a__missing", "c__missing"], outputCol="_features"), adapt.grown("label", "w")]).fit(data)
    assert adapt.importances(few, features, ["a", "c"]) == adapt.importances(every, features)
    p = [sorted((x["id"], x["probability"][1]) for x in m.transform(data).collect()) for m in (every, few)]
    assert p[0] == p[1]


def test_a_feature_left_out_leaves_the_gaps_of_its_like(spark):
    r = random.Random(3)
    rows = [(i, 0, i % 2, y := int(r.random() < 0.5), None if y else r.random(), None if y else r.random()) for i in range(120)]
    rows = spark.createDataFrame(rows, "id int, repeat int, fold int, label int, x double, z double")
    scored, gains = adapt.sweep(rows, ["x", "z"], "id", "label", {"less": adapt.Method(removed=("x",))}, iterations=2, keep=["id", "label"])
    assert scored.columns == ["id", "label", "method", "p"]
    assert scored.filter((F.col("p") > 0.5).cast("int") != F.col("label")).count() == 0
    assert [x["importance"] for x in gains.collect()] == pytest.approx([1.0, 1.0])


def test_slices_by_number_are_those_by_name(spark):
    r = random.Random(4)
    rows = [(i, r.choice([None, 3, 4, 5, 6]), r.choice([None, *range(1, 10)]), r.choice([None, 0, 1, 2, 5]), r.randint(0, 6), r.randint(0, 6)) for i in range(400)]
    w = spark.createDataFrame(rows, "i int, window_length int, window_start int, gaps int, radar_months int, optical_months int")
    named = w.select("i", F.explode(ev.slices()).alias("s")).select("i", "s.*")
    level, value = ev.slice_names(F.col("code"))
    coded = w.select("i", F.explode(ev.slice_codes()).alias("code")).filter("code is not null").select("i", level, value)
    assert sorted(map(repr, map(tuple, named.collect()))) == sorted(map(repr, map(tuple, coded.collect())))
    plan = ev.level_metrics(w.withColumns({"p": F.lit(0.5), "y": F.lit(1), "fold": F.lit(0)}), ["i"], "i", "p", "y")._jdf.queryExecution().executedPlan().toString()
    assert "slice_group" not in plan and "lambda" not in plan


def test_scores_side_by_side_are_those_one_by_one(spark):
    r = random.Random(6)
    rows = [(k, t, k % 2, k // 2 % 2, n, s, n, r.randint(0, n), r.random(), r.random()) for k in range(30) for t in range(2) for n in (4, 5, 6) for s in (1, 4, 7)]
    w = spark.createDataFrame(rows, "k int, repeat int, y int, fold int, window_length int, window_start int, radar_months int, optical_months int, a double, b double")
    w = w.withColumn("gaps", F.col("radar_months") - F.col("optical_months"))
    both = ev.level_metrics_of(w, ["repeat"], "k", "y", [((F.lit(c).alias("name"), F.lit(i).alias("i")), c) for i, c in enumerate("ab")])
    assert both.columns[:5] == ["name", "i", "repeat", "level", "value"]
    for c in "ab":
        alone = {(x["repeat"], x["level"], x["value"]): x for x in ev.level_metrics(w, ["repeat"], "k", c, "y").collect()}
        own = {(x["repeat"], x["level"], x["value"]): x for x in both.filter(F.col("name") == c).collect()}
        assert set(own) == set(alone) and len(own) > 30
        for at, x in alone.items():
            assert [own[at][f] for f in alone[at].asDict()] == pytest.approx(list(x), abs=1e-12)


def test_blends_are_sliced_once(spark):
    rows = [(k, t, k % 2, k // 2 % 5, n, s, n, n, 0, k % 7 / 7, k % 5 / 5) for k in range(20) for t in range(2) for n in (4, 5, 6) for s in (1, 4, 7)]
    w = spark.createDataFrame(rows, "k int, repeat int, y int, fold int, window_length int, window_start int, radar_months int, optical_months int, gaps int, a double, b double")
    learned = spark.createDataFrame([(t, f, 0.3) for t in range(2) for f in range(5)], "repeat int, fold int, weight double")
    plan = choice.blend_reports(w, learned, "k", "a", "b", "y")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    sliced = max(i for i, x in enumerate(lines) if "Generate explode" in x)  # the lowest: slices, straight from the windows
    assert not [x for x in lines[sliced + 1 :] if "candidate" in x]


def test_tasks_of_a_fit_follow_rows_and_cores():
    assert [adapt.tasks(n, 12) for n in (0, 33_600, 336_000, 2_016_000, 12_096_000)] == [1, 1, 3, 4, 24]
    assert adapt.tasks(336_000, 4) == 1


def test_a_fold_is_read_once_for_all_methods_and_gaps_are_not_written(spark, monkeypatch):
    written, r = {}, random.Random(8)
    monkeypatch.setattr(adapt, "materialize", lambda df, name, *by: written.setdefault(name, df) and stored.materialize(df, name, *by))
    rows = spark.createDataFrame([(i, 0, i % 2, int(r.random() < 0.5), r.random(), r.random(), "x") for i in range(120)], "id int, repeat int, fold int, label int, x double, z double, other string")
    methods = {"all": adapt.Method(), "less": adapt.Method(removed=("x",)), "again": adapt.Method()}
    scored, gains = adapt.sweep(rows, ["x", "z"], "id", "label", methods, iterations=2, keep=["id", "label"])
    assert not [c for c in written["adapt"].columns if c.endswith(("__filled", "__missing"))]
    assert written["adapted"]._jdf.queryExecution().analyzed().toString().count("Relation [") == 2  # one for each fold
    assert scored.groupBy("method").count().filter("count = 120").count() == 3
    p = {m: sorted(map(tuple, scored.filter(F.col("method") == m).select("id", "p").collect())) for m in methods}
    assert p["all"] == p["again"] != p["less"]
    alone = adapt.sweep(rows, ["x", "z"], "id", "label", {"less": methods["less"]}, iterations=2, keep=["id", "label"])[0]
    assert p["less"] == sorted(map(tuple, alone.select("id", "p").collect()))
    written.clear()
    assert adapt.sweep(rows, ["x", "z"], "id", "label", {"all": adapt.Method()}, iterations=2, score=False)[0] is None
    assert "other" not in written["adapt"].columns


def test_clusters_do_not_depend_on_how_rows_were_cut(spark):
    r = random.Random(11)
    rows = spark.createDataFrame([(i, i % 3, r.gauss(i % 4, 0.7), r.random()) for i in range(400)], "id int, fold int, x double, z double")
    one, two = (sorted(map(tuple, models.cluster_holdout(rows.repartition(n, F.rand(n)), "id", ["x", "z"], "fold", 0).select("id", "cluster").collect())) for n in (1, 13))
    assert one == two
    made = models.packed(rows.repartition(13), "id")
    assert made.rdd.getNumPartitions() == 1
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, rows.collect()))


def test_cluster_balance_makes_its_rows_once(spark, monkeypatch):
    from gapseries.plans import queries as plans

    seen, clusters = [], models.clusters
    monkeypatch.setattr(models, "clusters", lambda rows, features: (seen.append(rows.storageLevel.useMemory), clusters(rows, features))[1])
    plans.QUERIES["cluster_balance"](spark, "/root/testdata/sf0.001")
    assert seen == [True]


def test_domain_fits_do_not_depend_on_how_rows_were_cut(spark):
    r = random.Random(2)
    rows = spark.createDataFrame([(f"g{i}", i % 2, i % 2 + (i // 2) % 2 * 2, r.gauss(i % 2, 1), r.random()) for i in range(80) for _ in range(2)], "group_id string, domain int, f int, a double, b double")
    rows = rows.select("group_id", "domain", (F.col("f") >= 2).cast("int").alias("fold"), "a", "b")
    found = [domains.out_of_fold(rows.repartition(n, F.rand(n)), ["a", "b"], "group_id", "domain") for n in (1, 11)]
    one, two = (sorted(map(tuple, scored.collect())) for scored, _ in found)
    assert one == two
    assert sorted(map(tuple, found[0][1].collect())) == sorted(map(tuple, found[1][1].collect()))
    assert found[1][0].rdd.getNumPartitions() <= 2


def test_fits_read_what_was_written(spark):
    rows = spark.createDataFrame([(f"g{i}", i % 2, i // 2 % 2, i % 7 / 7) for i in range(60)], "group_id string, domain int, fold int, a double")
    assert "parquet" in models.packed(rows, "group_id")._jdf.queryExecution().analyzed().toString()
    scored, gains = domains.out_of_fold(rows, ["a"], "group_id", "domain", score=False)
    assert scored is None
    assert sorted(map(tuple, gains.collect())) == sorted(map(tuple, domains.out_of_fold(rows, ["a"], "group_id", "domain")[1].collect()))


def test_windows_are_not_dealt_out_again(spark):
    from gapseries.plans import queries as plans

    plan = plans.originals(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(entity_id" in plan
    assert not [x for x in plan.splitlines() if "Exchange" in x and "window_length" in x]


def test_model_pairs_makes_its_rows_once(spark, monkeypatch):
    from gapseries.plans import more
    from gapseries.plans import queries as plans

    monkeypatch.setattr(stored, "SPREAD", 10)
    df = more.model_pairs(spark, "/root/testdata/sf0.001")
    assert "l_suppkey" not in df._jdf.queryExecution().analyzed().toString()
    n = plans.originals(spark, "/root/testdata/sf0.001").count()
    rows = stored.spread(plans.originals(spark, "/root/testdata/sf0.001"), 3, "rows")
    assert rows.rdd.getNumPartitions() == n * 3 // 10 + 1
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, plans.originals(spark, "/root/testdata/sf0.001").collect()))


def test_blends_are_made_in_tasks_of_few_rows(spark, monkeypatch):
    r = random.Random(5)
    rows = spark.createDataFrame([(0, i % 2, int(r.random() < 0.5), round(r.random(), 3), round(r.random(), 3)) for i in range(60)], "repeat int, fold int, label int, p1 double, p2 double").coalesce(1)
    grid, nested = (lambda: ev.blend_grid(rows, ["repeat"], "p1", "p2", "label")), (lambda: choice.nested(rows, "repeat", "fold", "p1", "p2", "label"))
    whole = [{tuple(x)[:2]: x.asDict() for x in f().collect()} for f in (grid, nested)]
    monkeypatch.setattr(stored, "SPREAD", 500)
    for f, want in zip((grid, nested), whole, strict=True):
        df = f()
        assert f"Repartition {60 * 101 // 500 + 1}, true" in df._jdf.queryExecution().analyzed().toString()
        got = {tuple(x)[:2]: x.asDict() for x in df.collect()}
        assert set(got) == set(want)
        assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_fingerprints_hash_each_row_once(spark):
    made = spark.sparkContext.accumulator(0)
    said = F.udf(lambda x: made.add(1) or x, "long")
    want = stored.stretch_of(spark.range(0, 2000, 1, 4).select("id", F.col("id").alias("x")), ["id"])
    assert stored.stretch_of(spark.range(0, 2000, 1, 7).select("id", said("id").alias("x")), ["id"]) == want
    assert want[0] == made.value == 2000
