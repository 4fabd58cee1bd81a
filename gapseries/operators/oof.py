"""Out-of-fold contracts, aligned models, error overlap, blends, calibrators, domain data and importances."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapseries.functions import clip

from . import evaluation as ev
from . import ordered

#: Flags of the importance report.
DOMINANT, UNSTABLE_MEAN, UNSTABLE_CV = 0.15, 0.005, 1.5


def _n(when: Column) -> Column:
    return F.count(F.when(when, 1))


def originals(windows: DataFrame, key: str, p: str, label: str) -> DataFrame:
    """repeat, key, fold, label, window_start and window_length (-1), n_windows, optical_months (mean), p (mean), prediction.

    A fold or label that is not constant within a repeat and key is an error when the row is computed."""
    same = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.raise_error(F.concat(F.lit(f"{c} is not constant for "), F.min(F.col(key)).cast("string"))).cast("int"))
    g = windows.groupBy("repeat", key).agg(same("fold").alias("fold"), same(label).alias("label"), F.count("*").alias("n_windows"), F.avg("optical_months").alias("optical_months"), ev.mean9(p).alias("p"))
    return g.select("repeat", key, "fold", "label", F.lit(-1).alias("window_start"), F.lit(-1).alias("window_length"), "n_windows", "optical_months", "p", (F.col("p") >= 0.5).cast("int").alias("prediction"))


def contract(windows: DataFrame, originals: DataFrame, key: str, p: str, label: str, repeats: int) -> DataFrame:
    """Counts of what breaks the out-of-fold contract; all but rows must be 0: probabilities missing or out of [0, 1], repeated windows,
    originals in two folds, predictions off the threshold, originals that re-aggregation does not give, keys missing in a repeat."""
    bad = F.col(p).isNull() | F.isnan(p) | ~F.col(p).between(0, 1)
    a = windows.agg(F.count("*").alias("rows"), _n(bad).alias("bad_probabilities"))
    same = windows.groupBy("repeat", key, "window_length", "window_start").agg(F.count("*").alias("c")).agg(_n(F.col("c") > 1).alias("repeated_windows"))
    folds = windows.groupBy("repeat", key).agg(F.min("fold").alias("a"), F.max("fold").alias("b")).agg(_n(F.col("a") != F.col("b")).alias("split_originals"))
    threshold = originals.agg(_n(F.col("prediction") != (F.col("p") >= 0.5).cast("int")).alias("off_threshold"))
    again = windows.groupBy("repeat", key).agg(ev.mean9(p).alias("q")).join(originals.select("repeat", key, "p"), ["repeat", key], "full")
    again = again.agg(_n(F.col("p").isNull() | F.col("q").isNull() | (F.col("p") != F.col("q"))).alias("not_reaggregated"))
    cover = originals.groupBy(key).agg(F.count_distinct("repeat").alias("c")).agg(_n(F.col("c") != repeats).alias("not_covered"))
    for x in (same, folds, threshold, again, cover):  # one row each
        a = a.crossJoin(x)
    return a


def fold_faults(assigned: DataFrame, entities: DataFrame, key: str, label: str, n_folds: int, repeats: int) -> DataFrame:
    """Counts of faults of a fold manifest against its entities; all must be 0."""
    e = entities.select(key, F.col(label).alias("_y")).distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    j = assigned.withColumn("_in", F.lit(1)).join(e.withColumn("_known", F.lit(1)), ["repeat", key], "full")
    a = j.agg(_n(F.col("_in").isNull()).alias("missing"), _n(F.col("_known").isNull()).alias("extra"), _n(F.col(label) != F.col("_y")).alias("other_label"), _n(~F.col("fold").between(0, n_folds - 1)).alias("bad_fold"))
    again = assigned.groupBy("repeat", key).count().agg(_n(F.col("count") > 1).alias("repeated"))
    found = assigned.groupBy("repeat").agg(F.count_distinct("fold").alias("c")).agg(_n(F.col("c") != n_folds).alias("repeats_short_of_folds"))
    return a.crossJoin(again).crossJoin(found)


def manifest_faults(windows: DataFrame, key: str, window: str, per_key: int) -> DataFrame:
    """Counts of faults of a window manifest; all must be 0: nulls, repeated windows in a repeat, keys in two folds, keys with another
    number of windows than per_key."""
    a = windows.agg(_n(F.col(window).isNull() | F.col("fold").isNull() | F.col(key).isNull()).alias("nulls"))
    same = windows.groupBy("repeat", window).count().agg(_n(F.col("count") > 1).alias("repeated"))
    own = windows.groupBy("repeat", key).agg(F.min("fold").alias("a"), F.max("fold").alias("b"), F.count("*").alias("c")).agg(_n(F.col("a") != F.col("b")).alias("split_keys"), _n(F.col("c") != per_key).alias("wrong_number"))
    return a.crossJoin(same).crossJoin(own)


def split_leaks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """By repeat and held-out fold: keys on both sides of the split; all must be 0. No pair of rows is formed: a key leaks from every
    fold that it has, if it has more than one."""
    per = rows.groupBy("repeat", *keys).agg(F.collect_set("fold").alias("folds")).select("repeat", F.explode("folds").alias("fold"), (F.size("folds") > 1).cast("int").alias("x"))
    return per.groupBy("repeat", "fold").agg(F.count("*").alias("validation_keys"), F.sum("x").alias("leaks"))


def aligned(left: DataFrame, right: DataFrame, keys: list[str], names: tuple[str, str]) -> DataFrame:
    """keys, p_left, p_right of two models' tables (keys, p), one to one: a key that one lacks or has twice is an error in its row."""
    a, b = (x.groupBy(*keys).agg(F.count("*").alias(f"_n{i}"), F.first("p").alias(f"p_{side}")) for i, (x, side) in enumerate(((left, "left"), (right, "right"))))
    bad = ~((F.coalesce("_n0", F.lit(0)) == 1) & (F.coalesce("_n1", F.lit(0)) == 1))
    said = F.raise_error(F.concat(F.lit(f"{names[0]} and {names[1]} are not one to one at "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys])))
    j = a.join(b, keys, "full")
    return j.select(*keys, F.when(bad, said.cast("double")).otherwise(F.col("p_left")).alias("p_left"), "p_right")


def pairs(models: DataFrame, keys: list[str], label: str) -> DataFrame:
    """All unordered pairs of models (a few): repeat, left, right and the pairwise record. models: model, repeat, keys, label, p."""
    a = models.select("repeat", *keys, label, F.col("model").alias("left"), F.col("p").alias("p1"))
    b = models.select("repeat", *keys, F.col("model").alias("right"), F.col("p").alias("p2"))
    return ev.pairwise(a.join(b, ["repeat", *keys]).filter(F.col("left") < F.col("right")), "p1", "p2", label, ["repeat", "left", "right"])


def slice_overlap(windows: DataFrame, keys: list[str], original: str, p1: str, p2: str, label: str) -> DataFrame:
    """By slice: each model's errors among originals, those of one alone, shared ones and their Jaccard index (1 without errors)."""
    s = windows.select(*keys, original, label, p1, p2, F.explode(ev.slices()).alias("s")).select(*keys, original, label, p1, p2, "s.*")
    g = s.groupBy(*keys, "slice_group", "slice_value", original, label).agg(ev.mean9(p1).alias("a"), ev.mean9(p2).alias("b"))
    x, y = ((F.col(c) >= 0.5).cast("int") != F.col(label) for c in ("a", "b"))
    g = g.groupBy(*keys, "slice_group", "slice_value").agg(F.count("*").alias("n"), _n(x).alias("left_errors"), _n(y).alias("right_errors"), _n(x & y).alias("shared_errors"), _n(x & ~y).alias("only_left"), _n(~x & y).alias("only_right"))
    either = F.col("shared_errors") + F.col("only_left") + F.col("only_right")
    return g.withColumn("error_jaccard", F.when(either == 0, F.lit(1.0)).otherwise(F.col("shared_errors") / either))


def blended(windows: DataFrame, p1: str, p2: str, weights: tuple[float, ...]) -> DataFrame:
    """windows once for each weight, with weight and p: (1 - weight) p1 + weight p2."""
    w = F.explode(F.array(*[F.lit(float(x)) for x in weights]))
    return windows.withColumn("weight", w).withColumn("p", F.round((1 - F.col("weight")) * F.col(p1) + F.col("weight") * F.col(p2), 12))


def production_weight(nested: DataFrame, step: float = 0.01) -> DataFrame:
    """The median of the nested weights (a row for each repeat and fold) on the grid."""
    return nested.agg((F.round(F.percentile("weight", F.lit(0.5)) / step) * step).alias("weight"))


def fit_calibrators(rows: DataFrame, p: str, label: str, how: str, c: float = 10.0, steps: int = 25, held: list[tuple[int, int]] | None = None) -> DataFrame:
    """repeat, fold and the coefficients a, b, c of a calibrator fitted on the originals of the repeat's other folds; held: only for these.

    Penalised logistic regression (inverse strength c, intercept free) of logit p (sigmoid: b is 0) or of ln p and -ln(1 - p) (beta) by
    Newton steps: each step is one aggregation of gradients and curvatures by repeat and fold, whatever the number of rows."""
    q = clip(F.col(p), 1e-6, 1 - 1e-6)
    xs = [F.log(q / (1 - q))] if how == "sigmoid" else [F.log(q), -F.log(1 - q)]
    data = rows.select("repeat", "fold", F.col(label).cast("double").alias("y"), *[x.alias(f"x{i}") for i, x in enumerate(xs)]).persist()
    k = len(xs)
    held = held or sorted((r["repeat"], r["fold"]) for r in data.select("repeat", "fold").distinct().collect())  # folds: a few
    theta = {h: np.zeros(k + 1) for h in held}
    x = [F.col(f"x{i}") for i in range(k)] + [F.lit(1.0)]
    for _ in range(steps):
        known = rows.sparkSession.createDataFrame([(*h, *map(float, t)) for h, t in theta.items()], "repeat int, held int, " + ", ".join(f"t{i} double" for i in range(k + 1)))
        fitted = data.join(F.broadcast(known), "repeat").filter(F.col("fold") != F.col("held"))
        z = clip(sum((F.col(f"t{i}") * x[i] for i in range(k + 1)), F.lit(0.0)), -40.0, 40.0)
        m = 1 / (1 + F.exp(-z))
        sums = [F.sum((m - F.col("y")) * x[i]).alias(f"g{i}") for i in range(k + 1)]
        sums += [F.sum(m * (1 - m) * x[i] * x[j]).alias(f"h{i}{j}") for i in range(k + 1) for j in range(i, k + 1)]
        moved = 0.0
        for r in fitted.groupBy("repeat", "held").agg(*sums).collect():
            t = theta[r["repeat"], r["held"]]
            g = np.array([r[f"g{i}"] for i in range(k + 1)]) + np.append(t[:k], 0) / c
            h = np.array([[r[f"h{min(i, j)}{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)]) + np.diag([1 / c] * k + [1e-9])
            step = np.linalg.solve(h, g)
            t -= step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-9:
            break
    data.unpersist()
    made = [(*h, float(t[0]), float(t[1]) if k == 2 else 0.0, float(t[k])) for h, t in theta.items()]
    return rows.sparkSession.createDataFrame(made, "repeat int, fold int, a double, b double, c double")


def calibrated(windows: DataFrame, coefficients: DataFrame, p: str, how: str) -> DataFrame:
    """windows with p_calibrated, by the coefficients of their own repeat and fold (which were fitted on the others)."""
    j = windows.join(F.broadcast(coefficients), ["repeat", "fold"])
    q = clip(F.col(p), 1e-6, 1 - 1e-6)
    z = F.col("a") * F.log(q / (1 - q)) if how == "sigmoid" else F.col("a") * F.log(q) - F.col("b") * F.log(1 - q)
    return j.withColumn("p_calibrated", 1 / (1 + F.exp(-clip(z + F.col("c"), -40.0, 40.0)))).drop("a", "b", "c")


def domain_rows(rows: DataFrame, key: str, domain: Column) -> DataFrame:
    """rows with domain (0, 1), entity_group (train:<id> or test:<id>) and entity_weight: 1 / rows of the entity, each domain scaled
    to half the number of entities."""
    r = rows.withColumn("domain", domain)
    r = r.withColumn("entity_group", F.concat_ws(":", F.when(F.col("domain") == 0, "train").otherwise("test"), F.col(key).cast("string")))
    size = r.groupBy("domain", "entity_group").agg(F.count("*").alias("_n"))
    scale = size.groupBy("domain").agg(F.count("*").alias("_e"))
    scale = scale.crossJoin(F.broadcast(scale.agg(F.sum("_e").alias("_all")))).select("domain", (F.col("_all") / 2 / F.col("_e")).alias("_s"))
    return r.join(size, ["domain", "entity_group"]).join(F.broadcast(scale), "domain").withColumn("entity_weight", F.col("_s") / F.col("_n")).drop("_n", "_s")


def fold_weights(rows: DataFrame, fold: str = "fold") -> DataFrame:
    """rows of domain_rows with fold_weight: the same weights among the rows of the fold."""
    size = rows.groupBy(fold, "domain", "entity_group").agg(F.count("*").alias("_n"))
    scale = size.groupBy(fold, "domain").agg(F.count("*").alias("_e")).withColumn("_all", F.sum("_e").over(Window.partitionBy(fold)))
    return rows.join(size, [fold, "domain", "entity_group"]).join(F.broadcast(scale), [fold, "domain"]).withColumn("fold_weight", F.col("_all") / 2 / F.col("_e") / F.col("_n")).drop("_n", "_e", "_all")


def shift_table(long: DataFrame, x: str = "x", domain: str = "domain") -> DataFrame:
    """feature: missing rates, means and medians of both domains, KS, Wasserstein, PSI; all features in one plan. What a feature does
    not have in a domain is null."""
    side = lambda k, c: F.when(F.col(domain) == k, c)
    stats = [e.alias(f"{n}_{k}") for k in (0, 1) for n, e in (("missing_rate", F.avg(side(k, F.col(x).isNull().cast("double")))), ("mean", F.avg(side(k, F.col(x)))))]
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias(domain), F.col(c).alias("c")) for k, c in enumerate("ab")]))
    counts = ev.value_counts(long, ["feature"], x, domain).select("feature", x, sides.alias("s")).select("feature", x, "s.*")
    middle = ordered.quantiles_of_counts(counts, ["feature", domain], x, "c", [0.5]).groupBy("feature").agg(*[F.max(side(k, F.get("quantiles", F.lit(0)))).alias(f"median_{k}") for k in (0, 1)])
    base = long.groupBy("feature").agg(*stats).join(middle, "feature", "left")
    return base.join(ev.ecdf_shift(long, ["feature"], x, domain), "feature", "left").join(ev.psi(long, ["feature"], x, domain), "feature", "left")


def importance_summary(rows: DataFrame) -> DataFrame:
    """feature: mean, std (ddof 1; 0 for one), folds; of importances (feature, repeat, fold, importance)."""
    return rows.groupBy("feature").agg(F.avg("importance").alias("mean"), F.coalesce(F.stddev_samp("importance"), F.lit(0.0)).alias("std"), F.count_distinct("fold").alias("folds"))


def importance_stability(rows: DataFrame) -> DataFrame:
    """feature, group: share of the fold's total (0 if that is 0), its mean, std, min, max, n, cv, rank (by mean, then name) and flags."""
    total = F.sum("importance").over(Window.partitionBy("repeat", "fold"))
    share = rows.withColumn("share", F.when(total == 0, F.lit(0.0)).otherwise(F.col("importance") / total))
    g = share.groupBy("feature", "feature_group").agg(F.avg("share").alias("mean"), F.coalesce(F.stddev_samp("share"), F.lit(0.0)).alias("std"), F.min("share").alias("min"), F.max("share").alias("max"), F.count("*").alias("n"))
    cv = F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(F.lit(0.0))
    rank = F.row_number().over(Window.orderBy(F.round("mean", 12).desc(), "feature"))  # a row for each feature: hundreds
    g = g.withColumn("cv", cv).withColumn("rank", rank)
    return g.withColumns({"dominant": F.col("mean") >= DOMINANT, "unstable": (F.col("mean") >= UNSTABLE_MEAN) & (F.col("cv") >= UNSTABLE_CV), "metadata_on_top": (F.col("rank") <= 10) & F.col("feature_group").startswith("metadata")})


def group_importance(stability: DataFrame) -> DataFrame:
    """feature_group: sum, max, features and share of all."""
    g = stability.groupBy("feature_group").agg(F.sum("mean").alias("total"), F.max("mean").alias("largest"), F.count("*").alias("features"))
    return g.withColumn("share", F.try_divide(F.col("total"), F.sum("total").over(Window.partitionBy(F.lit(0)))))


def normaliser(long: DataFrame, fold: str = "fold") -> DataFrame:
    """fold, channel, mean, std (population; 1 where 1e-8 or less) of valid cells of the other folds: counts, means and variances by
    fold and channel once, then the others' together from that small table. long: fold, channel, x."""
    v = long.filter(F.col("x").isNotNull()).groupBy(fold, "channel").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    held = v.select(F.col(fold).alias("held"), "channel")
    w = Window.partitionBy("held", "channel")
    g = held.join(v, "channel").filter(F.col(fold) != F.col("held")).withColumn("mean", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    # Squares of distances from the common mean, so nothing cancels.
    g = g.groupBy("held", "channel").agg(F.sum("n").alias("n"), F.max("mean").alias("mean"), F.sum(F.col("n") * (F.col("v") + (F.col("m") - F.col("mean")) ** 2)).alias("q"))
    std = F.sqrt(F.col("q") / F.col("n"))
    return g.select(F.col("held").alias(fold), "channel", "n", "mean", F.when(std > 1e-8, std).otherwise(F.lit(1.0)).alias("std"))


def normalised(long: DataFrame, known: DataFrame, fold: str = "fold") -> DataFrame:
    """long with z: (x - mean) / std of its fold's normaliser within 8, 0 where x is missing."""
    z = clip((F.col("x") - F.col("mean")) / F.col("std"), -8.0, 8.0)
    return long.join(F.broadcast(known), [fold, "channel"]).withColumn("z", F.coalesce(z, F.lit(0.0)))
