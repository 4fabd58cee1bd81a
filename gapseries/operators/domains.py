"""Domain validation: training windows against observed test windows, in grouped folds, with balanced weights and entity means."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapseries.functions import uniform

from . import evaluation as ev
from . import models, ordered

#: Fits of folds that run side by side; each is a sequence of Spark jobs.
FITS = 4


def panel(train: DataFrame, test: DataFrame, key: str, features: list[str]) -> DataFrame:
    """source, entity_id, group_id, window_id, domain (0 train, 1 test) and the features of both sides' windows. An entity of the test
    side with several windows is an error when its row is computed."""
    def side(rows: DataFrame, name: str, domain: int) -> DataFrame:
        ident = F.col(key).cast("string")
        return rows.select(F.lit(name).alias("source"), ident.alias("entity_id"), F.concat_ws(":", F.lit(name), ident).alias("group_id"), "window_id", F.lit(domain).alias("domain"), *[F.col(c).cast("double") for c in features])

    n = F.count("*").over(Window.partitionBy(key))
    said = F.raise_error(F.concat(F.lit("several observed windows of "), F.col(key).cast("string"))).cast("string")
    once = test.withColumn("window_id", F.when(n == 1, F.col("window_id")).otherwise(said))
    return side(train, "train", 0).unionByName(side(once, "test", 1))


def _class(n: Column) -> Column:
    """A count, rounded down to three leading binary digits from 16 on, so that there are few classes of any counts."""
    e = F.greatest(F.floor(F.log2(F.greatest(n, F.lit(1)) + 0.5)) - 3, F.lit(0)).cast("int")
    return F.when(n < 16, n).otherwise(F.call_function("shiftleft", F.call_function("shiftright", n, e), e))


def leftovers(classes: list[tuple[tuple[float, ...], int]], k: int) -> list[list[int]]:
    """For each class of groups (mean rows by label, number of groups) the folds that get one group more than the others.

    Greedy, class by class (unlike labels first): each group left over goes to the fold that keeps the labels' shares closest to equal,
    then to the one with fewer rows, then to the first; a fold gets one of a class at most."""
    width = len(classes[0][0]) if classes else 0
    totals = [max(sum(h[j] * n for h, n in classes), 1e-12) for j in range(width)]
    held = [[0.0] * width for _ in range(k)]
    out: list[list[int]] = []
    for h, n in classes:
        for f in range(k):
            held[f] = [x + y * (n // k) for x, y in zip(held[f], h, strict=True)]
        chosen: list[int] = []
        for _ in range(n % k):
            def cost(f: int) -> tuple:
                shares = [[(held[g][j] + (h[j] if g == f else 0.0)) / totals[j] for g in range(k)] for j in range(width)]
                spread = sum(sum((x - sum(s) / k) ** 2 for x in s) ** 0.5 for s in shares)
                return round(spread, 12), round(sum(held[f]), 6), f

            f = min((f for f in range(k) if f not in chosen), key=cost)
            held[f] = [x + y for x, y in zip(held[f], h, strict=True)]
            chosen.append(f)
        out.append(chosen)
    return out


def group_folds(rows: DataFrame, group: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """group, fold: whole groups, labels (0, 1) spread evenly over the folds.

    Groups with like label histograms are one class; its groups are dealt out in turn by hash, and only what does not divide by k is
    placed greedily. What the driver sees is a row for each class, of which there are some thousands at most for any data."""
    counts = rows.groupBy(group).agg(*[F.count(F.when(F.col(label) == y, 1)).alias(f"n{y}") for y in (0, 1)])
    own = counts.withColumns({"c0": _class(F.col("n0")), "c1": _class(F.col("n1"))})
    known = own.groupBy("c0", "c1").agg(F.count("*").alias("n"), F.avg("n0").alias("m0"), F.avg("n1").alias("m1")).collect()
    known = sorted(known, key=lambda r: (-abs(r["m0"] - r["m1"]), r["c0"], r["c1"]))
    extra = leftovers([((r["m0"], r["m1"]), r["n"]) for r in known], k)
    table = rows.sparkSession.createDataFrame([(r["c0"], r["c1"], r["n"], x) for r, x in zip(known, extra, strict=True)], "c0 long, c1 long, n long, extra array<int>")
    at = ordered.ranked(own.withColumn("_u", uniform(F.lit(seed), group)), ["c0", "c1"], "_u", group, "_i", F.floor(F.col("_u") * 4096)).withColumn("_i", F.col("_i") - 1)
    j = at.join(F.broadcast(table), ["c0", "c1"])
    even = F.col("n") - F.col("n") % k
    fold = F.when(F.col("_i") < even, (F.col("_i") % k).cast("int")).otherwise(F.get("extra", (F.col("_i") - even).cast("int")))
    return j.select(group, fold.alias("fold"))


def fold_scales(rows: DataFrame, group: str, domain: str) -> DataFrame:
    """held, domain, train_scale, validation_scale: what makes the groups of a domain weigh half of all groups, among the folds other
    than held and in it. From one count of groups by fold and domain."""
    e = rows.groupBy("fold", domain).agg(F.count_distinct(group).alias("e"))
    folds = e.select(F.col("fold").alias("held")).distinct()
    def scale(when: Column, name: str) -> DataFrame:
        s = F.broadcast(folds).join(e, when).groupBy("held", domain).agg(F.sum("e").alias("e"))
        return s.select("held", domain, (F.sum("e").over(Window.partitionBy("held")) / 2 / F.col("e")).alias(name))

    return scale(F.col("held") != F.col("fold"), "train_scale").join(scale(F.col("held") == F.col("fold"), "validation_scale"), ["held", domain], "full")


def weighted(rows: DataFrame, group: str, domain: str) -> DataFrame:
    """rows (with fold) with validation_weight and train_weights, a map from held fold to the weight in that fold's fit."""
    size = rows.groupBy(group).agg(F.count("*").alias("_n"))
    scales = fold_scales(rows, group, domain)
    per = scales.groupBy(domain).agg(F.map_from_entries(F.collect_list(F.struct("held", "train_scale"))).alias("_t"), F.map_from_entries(F.collect_list(F.struct("held", "validation_scale"))).alias("_v"))
    j = rows.join(size, group).join(F.broadcast(per), domain)
    others = F.map_filter("_t", lambda h, _: h != F.col("fold"))
    return j.withColumns({"validation_weight": F.try_element_at("_v", F.col("fold")) / F.col("_n"), "train_weights": F.transform_values(others, lambda _, s: s / F.col("_n"))}).drop("_n", "_t", "_v")


def out_of_fold(rows: DataFrame, features: list[str], group: str, domain: str, kind: str = "gbt", score: bool = True) -> tuple[DataFrame | None, DataFrame]:
    """(rows with p, importances by fold): each fold is predicted by a model fitted with weights on the groups of the others; without score,
    nothing is predicted and the first is None.

    The folds' fits run side by side, FITS at a time, over one cached matrix in tasks by its number of rows."""
    data = models.packed(weighted(rows, group, domain).withColumn(domain, F.col(domain).cast("double")), group, *features)
    folds = sorted(r[0] for r in data.select("fold").distinct().collect())

    def fit(h: int):
        train = data.filter(F.col("fold") != h).withColumn("_w", F.try_element_at("train_weights", F.lit(h)))
        return Pipeline(stages=[*models.prepared(features, scale=kind == "logistic"), models.classifier(kind, domain, "_w")]).fit(train)

    with ThreadPoolExecutor(FITS) as pool:
        fitted = dict(zip(folds, pool.map(fit, folds), strict=True))
    gains = [(c, int(h), float(x)) for h, m in fitted.items() if hasattr(m.stages[-1], "featureImportances") for c, x in zip(features, m.stages[-1].featureImportances.toArray(), strict=True)]
    scored = None
    if score:
        parts = [m.transform(data.filter(F.col("fold") == h)).withColumn("p", vector_to_array("probability")[1]).select(*rows.columns, "p") for h, m in fitted.items()]
        scored = reduce(DataFrame.unionByName, parts).withColumn(domain, F.col(domain).cast("int")).persist()
        scored.count()
    data.unpersist()
    return scored, rows.sparkSession.createDataFrame(gains, "feature string, fold int, importance double")


def entity_means(oof: DataFrame, p: str = "p") -> DataFrame:
    """source, entity_id, group_id, domain, fold, p (mean of the entity's windows), n_windows. An entity in two folds is an error when its row is
    computed."""
    said = F.raise_error(F.concat(F.lit("in two folds: "), F.min("group_id"))).cast("int")
    g = oof.groupBy("source", "entity_id", "group_id", "domain").agg(F.when(F.min("fold") == F.max("fold"), F.min("fold")).otherwise(said).alias("fold"), ev.mean9(p).alias("p"), F.count("*").alias("n_windows"))
    return g


def validation_report(oof: DataFrame) -> DataFrame:
    """level (all or a fold) and the metrics of entity means: auc, accuracy, log_loss, brier, positive_prediction_rate, n."""
    e = entity_means(oof).withColumn("level", F.explode(F.array(F.lit("all"), F.concat(F.lit("fold "), F.col("fold").cast("string")))))
    m = ev.metrics(e, ["level"], "p", "domain")
    return m.select("level", "n", "auc", "accuracy", "log_loss", "brier", F.col("positive_prediction_rate").alias("predicted_test_rate"))


def left_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], names: tuple[str, str]) -> DataFrame:
    """left with right's columns, a row for each of left: a key that right lacks, or that either has twice, is an error in its row."""
    extra = [c for c in right.columns if c not in keys]
    r = right.groupBy(*keys).agg(F.count("*").alias("_m"), *[F.first(c).alias(c) for c in extra])
    rows = left.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    said = F.raise_error(F.concat(F.lit(f"{names[0]} and {names[1]} are not one to one at "), F.concat_ws(",", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])))
    j = rows.join(r, keys, "left")
    return j.withColumn(keys[0], F.when((F.col("_n") == 1) & (F.coalesce("_m", F.lit(0)) == 1), F.col(keys[0])).otherwise(said.cast(left.schema[keys[0]].dataType))).drop("_n", "_m")


def partner_views(views: DataFrame, original: str, view: str, epochs: int) -> DataFrame:
    """epoch, original, view, partner: for every view another of the same original, a different distance ahead in each epoch (in the
    circle of the original's views by id). Originals of one view have none; no pair of rows is formed but the one asked for."""
    w = Window.partitionBy(original)
    at = views.select(original, view).distinct().withColumns({"_at": F.row_number().over(w.orderBy(view)) - 1, "_k": F.count("*").over(w)}).filter("_k > 1")
    ahead = at.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("_to", (F.col("_at") + 1 + F.col("epoch") % (F.col("_k") - 1)) % F.col("_k"))
    other = at.select(original, F.col("_at").alias("_to"), F.col(view).alias("partner"))
    return ahead.join(other, [original, "_to"]).select("epoch", original, view, "partner")
