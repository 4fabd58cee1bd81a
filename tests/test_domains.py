"""Grouped domain validation, partner views, and stored tables that refuse what was changed."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gapseries.operators import domains as dm
from gapseries.operators import evaluation as ev
from gapseries.operators import oof
from gapseries.sources import stored as st


@pytest.fixture(scope="module")
def grouped(spark):
    """Groups of one to forty rows, most of one label, some of both."""
    r = random.Random(6)
    rows = []
    for g in range(300):
        n = r.choice([1, 1, 2, 8, 8, 8, 40])
        rows += [(f"g{g}", int(g % 3 == 0) if r.random() < 0.95 else r.randrange(2), float(r.gauss(g % 3 == 0, 1)), None if r.random() < 0.2 else 1.0) for _ in range(n)]
    return spark.createDataFrame(rows, "g string, y int, a double, b double").persist()


def test_folds_of_whole_groups(spark, grouped):
    folds = dm.group_folds(grouped, "g", "y")
    assert folds.count() == folds.select("g").distinct().count() == 300 and {r["fold"] for r in folds.collect()} == set(range(5))
    by = grouped.join(folds, "g").groupBy("fold").agg(F.avg("y").alias("rate"), F.count("*").alias("n")).collect()
    rate = grouped.agg(F.avg("y")).first()[0]
    assert all(abs(r["rate"] - rate) < 0.08 for r in by) and max(r["n"] for r in by) < 1.35 * min(r["n"] for r in by)
    assert sorted(folds.collect()) == sorted(dm.group_folds(grouped.repartition(7), "g", "y").collect())


def test_leftovers_keep_labels_even():
    classes = [((8.0, 0.0), 7), ((0.0, 1.0), 13), ((3.0, 3.0), 2)]
    got = dm.leftovers(classes, 5)
    assert [len(x) for x in got] == [2, 3, 2] and got[0] == [0, 1] and got[1] == [2, 3, 4] and all(len(set(x)) == len(x) for x in got)


def test_weights_of_each_fit(spark, grouped):
    one = grouped.groupBy("g").agg(F.max("y").alias("y"), F.count("*").alias("n"))
    rows = one.join(dm.group_folds(one, "g", "y"), "g").withColumn("k", F.explode(F.sequence(F.lit(1), "n"))).persist()
    for h in range(5):
        w = dm.weighted(rows, "g", "y").filter(F.col("fold") != h).groupBy("y").agg(F.sum(F.try_element_at("train_weights", F.lit(h))).alias("s")).collect()
        groups = one.join(dm.group_folds(one, "g", "y"), "g").filter(F.col("fold") != h).count()
        assert all(abs(r["s"] - groups / 2) < 1e-6 for r in w) and len(w) == 2
    v = dm.weighted(rows, "g", "y").groupBy("fold", "y").agg(F.sum("validation_weight").alias("s")).collect()
    by = defaultdict(set)
    for r in v:
        by[r["fold"]].add(round(r["s"], 6))
    assert all(len(x) == 1 for x in by.values())
    assert all(r["fold"] not in r["train_weights"] and len(r["train_weights"]) == 4 for r in dm.weighted(rows, "g", "y").collect())


def test_validation_by_entity(spark):
    r = random.Random(2)
    side = lambda lo, n, k, shift: [(i, f"{i}:{j}", r.gauss(shift, 1), None if r.random() < 0.1 else r.random()) for i in range(lo, lo + n) for j in range(k)]
    schema = "k long, window_id string, a double, b double"
    train, test = spark.createDataFrame(side(0, 40, 8, 0.0), schema), spark.createDataFrame(side(0, 30, 1, 2.5), schema)
    rows = dm.panel(train, test, "k", ["a", "b"])
    assert rows.count() == 350 and rows.select("group_id").distinct().count() == 70  # the same ids on both sides are other groups
    rows = rows.join(dm.group_folds(rows, "group_id", "domain"), "group_id")
    assert rows.groupBy("group_id").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    scored, _ = dm.out_of_fold(rows, ["a", "b"], "group_id", "domain", "logistic")
    e = dm.entity_means(scored)
    assert e.count() == 70 and e.filter("source = 'train'").agg(F.min("n_windows")).first()[0] == 8
    report = {x["level"]: x for x in dm.validation_report(scored).collect()}
    assert set(report) == {"all", *[f"fold {f}" for f in range(5)]} and report["all"]["n"] == 70 and report["all"]["auc"] > 0.9
    again, _ = dm.out_of_fold(rows.repartition(3), ["a", "b"], "group_id", "domain", "logistic")
    p = {x["window_id"] + x["source"]: x["p"] for x in scored.collect()}
    assert all(abs(p[x["window_id"] + x["source"]] - x["p"]) < 1e-3 for x in again.collect())
    with pytest.raises(Exception, match="several observed"):
        dm.panel(train, train, "k", ["a"]).collect()
    with pytest.raises(Exception, match="in two folds"):
        dm.entity_means(scored.withColumn("fold", F.when(F.col("window_id") == "3:1", 9).otherwise(F.col("fold")))).collect()


def test_left_join_one_to_one(spark):
    left, right = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int"), spark.createDataFrame([("a", 5), ("b", None), ("c", 7)], "k string, y int")
    assert sorted(dm.left_one_to_one(left, right, ["k"], ("l", "r")).collect()) == [("a", 1, 5), ("b", 2, None)]
    for x, y in ((left.union(left), right), (left, right.union(right)), (left, right.filter("k <> 'a'")), (left.union(spark.createDataFrame([(None, 1)], "k string, x int")), right)):
        with pytest.raises(Exception, match="not one to one"):
            dm.left_one_to_one(x, y, ["k"], ("l", "r")).collect()


def test_partners_by_epoch(spark):
    rows = [(1, x) for x in "abcd"] + [(2, "e")] + [(3, "f"), (3, "g"), (3, "g")]
    got = dm.partner_views(spark.createDataFrame(rows, "k long, v string"), "k", "v", 4).collect()
    by = {(r["epoch"], r["v"]): r["partner"] for r in got}
    assert [by[e, "a"] for e in range(4)] == ["b", "c", "d", "b"] and by[2, "c"] == "b" and not any(r["k"] == 2 for r in got)
    assert all(by[e, "f"] == "g" and by[e, "g"] == "f" for e in range(4)) and len(got) == 4 * 6 and all(r["v"] != r["partner"] for r in got)


def fp(df, order=None):
    return st.fingerprint(df, order).first()["fingerprint"]


def test_fingerprints(spark):
    d = spark.createDataFrame([(i, f"t{i % 7}", None if i % 5 == 0 else i / 3) for i in range(500)], "i long, t string, x double")
    base = fp(d, ["i"])
    assert all(fp(d.repartition(n), ["i"]) == base for n in (1, 3, 11)) and fp(d.orderBy(F.desc("i")), ["i"]) == base
    swapped = d.withColumn("i", F.when(F.col("i") == 3, 4).when(F.col("i") == 4, 3).otherwise(F.col("i")))
    assert fp(swapped, ["i"]) != base and fp(swapped.select("t", "x")) == fp(d.select("t", "x")) and fp(d.limit(499), ["i"]) != base
    moved = d.withColumn("at", F.when(F.col("i") == 3, 4).when(F.col("i") == 4, 3).otherwise(F.col("i")))
    assert fp(moved.select("t", "x", F.lit(0).alias("z"), "at").drop("at").withColumn("o", F.lit(1)), []) is not None
    two = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "\\N"), ("\\N", None), ("", None), (None, ""), ("1:a", "-")], "a string, b string")
    one = [fp(two.filter(F.monotonically_increasing_id() >= 0).limit(7).filter(F.col("a").eqNullSafe(r["a"]) & F.col("b").eqNullSafe(r["b"]))) for r in two.collect()]
    assert len(set(one)) == 7
    assert fp(d.withColumnRenamed("t", "u"), ["i"]) != base != fp(d.withColumn("i", F.col("i").cast("int")), ["i"])
    assert fp(d.filter("false")) == fp(d.filter("i < 0").repartition(5)) and fp(d.union(d), ["i"]) != base


def test_stretches_merge_anyhow():
    r = random.Random(1)
    h = [[r.randrange(st.PRIME) for _ in range(4)] for _ in range(37)]

    def plain(rows):
        n, sums = len(rows), [0] * 4
        for x in rows:
            sums = [(s * b + v) % st.PRIME for s, b, v in zip(sums, st.BASES, x)]
        return n, [pow(b, n, st.PRIME) for b in st.BASES], sums

    for _ in range(20):
        a, b = sorted(r.randrange(38) for _ in range(2))
        x, y, z = plain(h[:a]), plain(h[a:b]), plain(h[b:])
        assert st.merge(st.merge(x, y), z) == st.merge(x, st.merge(y, z)) == plain(h)
    assert st._powers(37)[:, 37].tolist() == plain(h)[1]


def test_committed_tables(spark, tmp_path):
    d = spark.createDataFrame([(i, i % 3, i / 7) for i in range(50)], "i long, f int, x double")
    base = str(tmp_path)
    m = st.write_committed(d, f"{base}/a", ["i"], seed=42)
    assert m["rows"] == 50 and Counter(st.read_committed(spark, f"{base}/a", seed=42).collect()) == Counter(d.collect())
    assert st.read_committed(spark, f"{base}/a", ["x"]).columns == ["x"]
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        st.write_committed(d, f"{base}/a", ["i"])
    with pytest.raises(st.StoredTableError, match="seed"):
        st.read_committed(spark, f"{base}/a", seed=7)
    d.write.parquet(f"{base}/unfinished/data")
    with pytest.raises(st.StoredTableError, match="never finished"):
        st.read_committed(spark, f"{base}/unfinished")
    changes = {"content": d.withColumn("x", F.when(F.col("i") == 9, -1.0).otherwise(F.col("x"))), "rows": d.filter("i < 49"), "schema": d.withColumn("f", F.col("f").cast("long"))}
    for said, bad in changes.items():
        bad.write.parquet(f"{base}/{said}/data")
        st.commit(spark, f"{base}/{said}", m)
        with pytest.raises(st.StoredTableError, match=said):
            st.read_committed(spark, f"{base}/{said}")


def test_stored_folds_windows_and_predictions(spark, tmp_path):
    base = str(tmp_path)
    lab = spark.createDataFrame([(i, i % 2) for i in range(40)], "k long, y int")
    folds = ev.folds(lab, "k", "y", 5, 2)
    m = st.write_committed(folds, f"{base}/folds", ["repeat", "k"], seed=42)
    assert st.read_folds(spark, f"{base}/folds", lab, "k", "y", 5, 2, 42).count() == 80
    for other in (lab.filter("k < 39"), lab.union(spark.createDataFrame([(99, 0)], "k long, y int")), lab.withColumn("y", 1 - F.col("y"))):
        with pytest.raises(st.StoredTableError, match="folds"):
            st.read_folds(spark, f"{base}/folds", other, "k", "y", 5, 2, 42)
    w = folds.withColumn("view_index", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("window_id", F.concat_ws(":", "k", "view_index"))
    st.write_committed(w, f"{base}/windows", ["repeat", "k", "view_index"], folds=m["fingerprint"], mode="uniform", seed=42)
    assert st.read_windows(spark, f"{base}/windows", "k", m["fingerprint"], "uniform", 42, 3, ["k", "fold"]).columns == ["k", "fold"]
    for args, said in (((m["fingerprint"], "uniform", 42, 8), "wrong_number"), (("0", "uniform", 42, 3), "folds"), ((m["fingerprint"], "test_like", 42, 3), "mode")):
        with pytest.raises(st.StoredTableError, match=said):
            st.read_windows(spark, f"{base}/windows", "k", *args)
    p = w.select("k", "repeat", "fold", "y", F.lit(4).alias("window_length"), F.col("view_index").alias("window_start"), F.lit(2).alias("optical_months"), ((F.col("k") * 7 + F.col("view_index") * 3) % 11 / 11).alias("p"))
    st.write_committed(p, f"{base}/p", ["repeat", "k", "window_start"])
    o = oof.originals(p, "k", "p", "y")
    st.write_committed(o, f"{base}/o", ["repeat", "k"])
    assert [x.count() for x in st.read_predictions(spark, f"{base}/p", f"{base}/o", "k", "p", "y", 2)] == [240, 80]
    st.write_committed(o.withColumn("optical_months", F.when(F.col("k") == 3, 9.0).otherwise(F.col("optical_months"))), f"{base}/bad", ["repeat", "k"])
    with pytest.raises(st.StoredTableError, match="not what the windows give"):
        st.read_predictions(spark, f"{base}/p", f"{base}/bad", "k", "p", "y", 2)


def test_every_checker_finds_its_fault(spark):
    """Tables with one fault each, for the checkers whose counts are 0 on good ones."""
    lab = spark.createDataFrame([(i, i % 2) for i in range(20)], "k long, y int")
    folds = ev.folds(lab, "k", "y", 5, 2)
    c, first = F.col, (F.col("k") == 3) & (F.col("repeat") == 1)

    def faults(df):
        return {k: v for k, v in oof.fold_faults(df, lab, "k", "y", 5, 2).first().asDict().items() if v}

    change = lambda df, name, v: df.withColumn(name, F.when(first, v).otherwise(c(name)))
    assert faults(folds) == {} and faults(folds.filter(~first)) == {"missing": 1} and faults(folds.union(folds.filter(first))) == {"repeated": 1}
    assert faults(change(folds, "fold", F.lit(5))).get("bad_fold") == 1 and faults(change(folds, "y", 1 - c("y"))) == {"other_label": 1} and faults(change(folds, "k", F.lit(77).cast("long"))) == {"missing": 1, "extra": 1}
    assert faults(folds.withColumn("fold", F.when(c("fold") == 4, 0).otherwise(c("fold")))) == {"repeats_short_of_folds": 2}
    w = folds.withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(1)))).withColumns({"w": F.concat_ws(":", "k", "view"), "window_start": c("view"), "window_length": F.lit(4), "optical_months": F.lit(1), "p": (c("k") + c("view")) / 25})

    def windows(df):
        return {k: v for k, v in oof.manifest_faults(df, "k", "w", 2).first().asDict().items() if v}

    one = first & (c("view") == 0)
    assert windows(w) == {} and windows(w.filter(~one)) == {"wrong_number": 1} and windows(w.withColumn("w", F.when(one, None).otherwise(c("w")))) == {"nulls": 1}
    assert windows(w.withColumn("fold", F.when(one, (c("fold") + 1) % 5).otherwise(c("fold")))) == {"split_keys": 1} and windows(w.withColumn("w", F.when(one, F.lit("3:1")).otherwise(c("w")))) == {"repeated": 1}
    o = oof.originals(w, "k", "p", "y")

    def contract(a, b):
        return {k: v for k, v in oof.contract(a, b, "k", "p", "y", 2).first().asDict().items() if v and k != "rows"}

    assert contract(w, o) == {} and contract(w.withColumn("p", F.when(one, float("nan")).otherwise(c("p"))), o)["bad_probabilities"] == 1 and contract(w.union(w.filter(one)), o)["repeated_windows"] == 1
    assert contract(w.withColumn("fold", F.when(one, 9).otherwise(c("fold"))), o) == {"split_originals": 1} and contract(w, change(o, "prediction", 1 - c("prediction"))) == {"off_threshold": 1}
    assert contract(w, change(o, "p", F.lit(0.123)))["not_reaggregated"] == 1 and contract(w, o.filter(~first)) == {"not_reaggregated": 1, "not_covered": 1}
    leaks = oof.split_leaks(w.withColumn("fold", F.when(one, (c("fold") + 1) % 5).otherwise(c("fold"))), ["k"]).agg(F.sum("leaks")).first()[0]
    assert leaks == 2 and ev.leaks(w.withColumn("fold", F.when(one, 9).otherwise(c("fold"))), "k").count() == 1


def test_clusters_of_every_fold(spark):
    """Blobs of unlike size, far from each other: none stays under the minimum, scaling is the scope's own, labels play no part."""
    from gapseries.operators import models

    r = random.Random(5)
    at = [(0, 0, 30), (50, 0, 25), (0, 80, 25), (51, 3, 4)]
    rows = [(i, i % 5, r.randrange(2), x + r.gauss(0, 1), (y + r.gauss(0, 1)) * 1e6) for i, (x, y) in enumerate((x, y) for x, y, n in at for _ in range(n))]
    d = spark.createDataFrame(rows, "k long, fold int, y int, a double, b double").persist()
    for f in range(5):
        got = models.cluster_holdout(d, "k", ["a", "b"], "fold", f, k=4, least=8).collect()
        sizes = Counter(x["cluster"] for x in got)
        assert len(got) == d.filter(F.col("fold") != f).count() and min(sizes.values()) >= 8 and all(x["fold"] != f == x["outer_fold"] for x in got)
        assert len({(x["a"] > 25, x["b"] > 4e7, x["cluster"]) for x in got}) >= len(sizes) >= 2
    other = models.cluster_holdout(d.withColumn("y", 1 - F.col("y")), "k", ["a", "b"], "fold", 4, k=4, least=8).collect()
    assert {x["k"]: x["cluster"] for x in other} == {x["k"]: x["cluster"] for x in got}
    with pytest.raises(ValueError, match="too few"):
        models.cluster_holdout(d, "k", ["a", "b"], "fold", 0, k=4, least=40)
    with pytest.raises(ValueError, match="repeated or null"):
        models.cluster_holdout(d.union(d), "k", ["a", "b"], "fold", 0)
    assert models.merged([[0.0], [1.0], [10.0], [11.0]], [5, 1, 9, 2], 4) == [0, 0, 2, 2] and models.merged([[0.0], [5.0]], [1, 1], 9) in ([0, 0], [1, 1])


def test_robust_scaling_of_gaps(spark):
    from gapseries.operators import models

    d = spark.createDataFrame([(float(i), 7.0, None) for i in range(5)] + [(None, float("nan"), None)], "a double, b double, c double")
    got = [tuple(r) for r in models.scaled_robustly(d, ["a", "b", "c"]).collect()]
    assert got == [((i - 2) / 2, 0.0, 0.0) for i in range(5)] + [(0.0, 0.0, 0.0)]
