"""Choosing a blend's weight and a calibrator: weights swept from counts, exact scores only for weights that can win, rules of adoption.

A weight w runs over the grid 0, 1/k .. 1; a blend's score is (1 - w) p1 + w p2, to 12 digits, as in evaluation.blend_grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapseries.sources.stored import spread

from . import evaluation as ev
from . import oof, ordered

#: Cells of a score for the bounds of an AUC; they decide how many weights are scored exactly, never the result.
CELLS = 512
#: What two scores may differ by and still tie (best_weight compares nine digits), with room for sums in another order.
TIE = 2e-9
#: A blend this near to the best is as good; a calibrator must gain so much robust score and may lose so much combined.
NEAR_BEST, ROBUST_GAIN, COMBINED_LOSS = 0.0002, 0.0001, 0.00005


def _score(p1: str, p2: str, wi: Column, k: int) -> Column:
    return F.round((k - wi) / k * F.col(p1) + wi / k * F.col(p2), 12)


def flips(rows: DataFrame, keys: list[str], p1: str, p2: str, label: str, k: int = 100) -> DataFrame:
    """keys, at, up, y with n and the sums a, b, c: how many rows are on side up at w = 0 and change it at the grid's place at (k + 1: never).

    A blend is a line in w, so each row changes its class once at most; the place is found by halving. (Where
    two scores differ by less than a double holds of 0.5 - 5e-13, the rounded blend itself wobbles there; it then counts as one change.) At most 4 (k + 2) rows a group
    whatever the rows; a, b, c are the parts of the squared error (a + 2 w b + w^2 c)."""
    r = ordered.checked(ordered.checked(rows, p1, label), p2, label)
    at0 = lambda wi: _score(p1, p2, wi, k) >= 0.5
    up = at0(F.lit(0))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(k.bit_length()))])
    last = F.aggregate(steps, F.lit(0), lambda acc, s: F.when((acc + s <= k) & (at0(acc + s) == up), acc + s).otherwise(acc))
    y, d = F.col(label), F.col(p2) - F.col(p1)
    r = r.select(*keys, (last + 1).alias("at"), up.alias("up"), y.cast("int").alias("y"), ((F.col(p1) - y) ** 2).alias("a"), ((F.col(p1) - y) * d).alias("b"), (d * d).alias("c"))
    return r.groupBy(*keys, "at", "up", "y").agg(F.count("*").alias("n"), *[F.sum(x).alias(x) for x in "abc"])


def swept(cells: DataFrame, keys: list[str], k: int = 100) -> DataFrame:
    """keys, wi, weight, n, positives, tp, fp, fn, tn, f1 and brier for every weight, by running sums of the cells' changes."""
    sums = {"n": "long", "positives": "long", "tp": "long", "fp": "long", "a": "double", "b": "double", "c": "double"}
    event = lambda wi, *of: F.struct(wi.alias("wi"), *[x.cast(t).alias(c) for (c, t), x in zip(sums.items(), of, strict=True)])
    zero, n, y, up = F.lit(0), F.col("n"), F.col("y"), F.col("up")
    here, side = F.when(up, n).otherwise(0), F.when(up, -n).otherwise(n)
    first = event(zero, n, n * y, here * y, here * (1 - y), F.col("a"), F.col("b"), F.col("c"))
    change = event(F.col("at"), zero, zero, side * y, side * (1 - y), zero, zero, zero)
    changes = cells.select(*keys, F.explode(F.array(first, change)).alias("e"))
    grid = cells.select(*keys).distinct().select(*keys, F.explode(F.sequence(zero, F.lit(k))).alias("wi")).select(*keys, event(F.col("wi"), *[zero] * 7).alias("e"))
    g = changes.unionByName(grid).select(*keys, "e.*").groupBy(*keys, "wi").agg(*[F.sum(c).alias(c) for c in sums])
    upto = Window.partitionBy(*keys).orderBy("wi").rowsBetween(Window.unboundedPreceding, 0)
    g = g.select(*keys, "wi", *[F.sum(c).over(upto).alias(c) for c in sums]).filter(F.col("wi") <= k)
    w = F.col("wi") / k
    g = g.withColumns({"weight": w, "fn": F.col("positives") - F.col("tp"), "tn": F.col("n") - F.col("positives") - F.col("fp"), "brier": (F.col("a") + 2 * w * F.col("b") + w * w * F.col("c")) / F.col("n")})
    down = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return g.withColumn("f1", F.when(down > 0, 2 * F.col("tp") / down).otherwise(F.lit(0.0))).select(*keys, "wi", "weight", "n", "positives", "tp", "fp", "fn", "tn", "f1", "brier")


def sweep(rows: DataFrame, keys: list[str], p1: str, p2: str, label: str, k: int = 100) -> DataFrame:
    return swept(flips(rows, keys, p1, p2, label, k), keys, k)


def score_cells(rows: DataFrame, keys: list[str], p1: str, p2: str, label: str, k: int = 100) -> DataFrame:
    """keys, wi, cell, pos, neg: rows by cell of each weight's score. Counted before the shuffle: at most (k + 1) CELLS rows a group."""
    w = rows.select(*keys, label, p1, p2, F.explode(F.sequence(F.lit(0), F.lit(k))).alias("wi"))
    w = w.select(*keys, "wi", F.floor(_score(p1, p2, F.col("wi"), k) * CELLS).cast("int").alias("cell"), F.col(label).alias("y"))
    return w.groupBy(*keys, "wi", "cell").agg(F.count(F.when(F.col("y") == 1, 1)).alias("pos"), F.count(F.when(F.col("y") == 0, 1)).alias("neg"))


def auc_bounds(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, wi, auc_lo, auc_hi: pairs in different cells count as they are, pairs within one at worst and at best; null for one class."""
    before = Window.partitionBy(*keys, "wi").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    r = cells.withColumn("below", F.coalesce(F.sum("neg").over(before), F.lit(0)))
    pairs = F.sum("pos") * F.sum("neg")
    return r.groupBy(*keys, "wi").agg(F.try_divide(F.sum(F.col("pos") * F.col("below")), pairs).alias("auc_lo"), F.try_divide(F.sum(F.col("pos") * (F.col("below") + F.col("neg"))), pairs).alias("auc_hi"))


def can_win(table: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """keys, wi: the weights whose best possible combined score is not below another's worst; all of them where it is undefined."""
    c = table.join(bounds, [*keys, "wi"]).withColumns({e: 0.6 * F.col("f1") + 0.4 * F.col(f"auc_{e}") for e in ("lo", "hi")})
    c = c.withColumn("_most", F.max("lo").over(Window.partitionBy(*keys)))
    return c.filter(F.coalesce(F.col("hi") >= F.col("_most") - TIE, F.lit(True))).select(*keys, "wi")


def _but_one(cells: DataFrame, keys: list[str], fold: str, place: list[str], sums: list[str]) -> DataFrame:
    """Cells by fold become cells of the other folds together, by held-out fold."""
    held = cells.select(*keys, fold).distinct()
    others = cells.withColumnRenamed(fold, "_own").join(held, keys).filter(F.col("_own") != F.col(fold))
    return others.groupBy(*keys, fold, *place).agg(*[F.sum(c).alias(c) for c in sums])


def nested(rows: DataFrame, repeat: str, fold: str, p1: str, p2: str, label: str, k: int = 100) -> DataFrame:
    """repeat, fold and the weight that is best (as evaluation.best_weight says) on the repeat's other folds, with training_ and heldout_ f1,
    auc, combined, brier and log_loss.

    Rows are counted once, by their own fold; the counts of the others are sums of counts. Only weights that can win are ranked. Weights are
    broadcast (k + 1 rows at most for each repeat and fold), as a join by repeat would put all rows into a task for each repeat. Rows are
    spread first, as in evaluation.blend_grid."""
    keys = [repeat, fold]
    rows = spread(rows.select(*keys, label, p1, p2), k + 1, "blended")
    own = flips(rows, keys, p1, p2, label, k)
    table = swept(_but_one(own, [repeat], fold, ["at", "up", "y"], ["n", "a", "b", "c"]), keys, k)
    bounds = auc_bounds(_but_one(score_cells(rows, keys, p1, p2, label, k), [repeat], fold, ["wi", "cell"], ["pos", "neg"]), keys)
    some = can_win(table, bounds, keys)
    base = rows.select(repeat, F.col(fold).alias("_own"), label, p1, p2)
    exact = ev.metrics(base.join(F.broadcast(some), repeat).filter(F.col("_own") != F.col(fold)).withColumn("p", _score(p1, p2, F.col("wi"), k)), [*keys, "wi"], "p", label)
    best = ev.best_weight(exact.withColumn("weight", F.col("wi") / k), keys)
    names = ("f1", "auc", "combined", "brier", "log_loss")
    best = best.select(*keys, "wi", "weight", *[F.col(c).alias(f"training_{c}") for c in names])
    held = ev.metrics(rows.join(F.broadcast(best.select(*keys, "wi")), keys).withColumn("p", _score(p1, p2, F.col("wi"), k)), keys, "p", label)
    return best.drop("wi").join(held.select(*keys, *[F.col(c).alias(f"heldout_{c}") for c in names]), keys)


def blend_reports(windows: DataFrame, learned: DataFrame, original: str, p1: str, p2: str, label: str, fixed: tuple[float, ...] = (0.5, 0.7), k: int = 100) -> DataFrame:
    """candidate (fixed or nested), weight, the robust score's parts, robust and chosen, from windows with repeat and fold.

    Candidates are the fixed weights and the median of the learned ones on the grid. Of those within NEAR_BEST of the best robust score
    the one nearest to one half is chosen, then that of the higher mean combined score. nested is every window at its own fold's learned
    weight: how the rule of learning does, not a candidate. All are scored in one pass over the windows, side by side."""
    median = oof.production_weight(learned, 1 / k).first()["weight"]
    weights = sorted({round(float(w), 10) for w in (*fixed, median)})
    own = windows.join(F.broadcast(learned.select("repeat", "fold", F.col("weight").alias("_w"))), ["repeat", "fold"])
    tried = [("fixed", w, F.lit(w)) for w in weights] + [("nested", median, F.col("_w"))]
    b = own.withColumns({f"_b{i}": F.round((1 - at) * F.col(p1) + at * F.col(p2), 12) for i, (_, _, at) in enumerate(tried)})
    scores = [((F.lit(how).alias("candidate"), F.lit(float(w)).alias("weight")), f"_b{i}") for i, (how, w, _) in enumerate(tried)]
    r = ev.robust_of_levels(ev.level_metrics_of(b, ["repeat"], original, label, scores), ["candidate", "weight"])
    return _marked(r)


def _marked(reports: DataFrame) -> DataFrame:
    """reports (a handful of rows) with chosen."""
    one = Window.partitionBy("candidate")
    fixed = F.col("candidate") == "fixed"
    good = reports.withColumn("_near", fixed & (F.col("robust") >= F.max("robust").over(one) - NEAR_BEST))
    place = F.row_number().over(Window.partitionBy("candidate", "_near").orderBy(F.round(F.abs(F.col("weight") - 0.5), 9), F.col("repeat_mean").desc(), "weight"))
    return good.withColumn("chosen", F.col("_near") & (place == 1)).drop("_near")


def adopted(reports: DataFrame) -> DataFrame:
    """reports (method, repeat_mean, robust) with eligible and chosen: a calibrator is eligible if its robust score gains at least
    ROBUST_GAIN over none and its mean combined score loses at most COMBINED_LOSS; the most robust of them is chosen, none if there is
    none. Reports without exactly one row for none are an error when computed."""
    every = Window.partitionBy(F.lit(0))  # a row for each method
    base = lambda c: F.max(F.when(F.col("method") == "none", F.col(c))).over(every)
    sole = F.count(F.when(F.col("method") == "none", 1)).over(every) == 1
    passes = (F.col("robust") >= base("robust") + ROBUST_GAIN) & (F.col("repeat_mean") >= base("repeat_mean") - COMBINED_LOSS)
    r = reports.withColumn("eligible", F.when(sole, (F.col("method") == "none") | passes).otherwise(F.raise_error(F.lit("there must be one report of method none")).cast("boolean")))
    place = F.row_number().over(Window.partitionBy("eligible").orderBy(F.col("robust").desc(), F.col("method") != "none", "method"))
    return r.withColumn("chosen", F.col("eligible") & (place == 1))


def calibrator_reports(windows: DataFrame, key: str, p: str, label: str, methods: tuple[str, ...] = ("sigmoid", "beta")) -> DataFrame:
    """method, the robust score's parts, robust, ece, eligible, chosen, and a, b, c: the production calibrator.

    Windows are calibrated by coefficients fitted on the originals of the other folds of their repeat; the production calibrator is fitted
    on the consensus of each original over the repeats."""
    base = windows.groupBy("repeat", "fold", key, label).agg(ev.mean9(p).alias(p))
    agreed = base.groupBy(key, label).agg(ev.mean9(p).alias(p)).withColumns({"repeat": F.lit(0), "fold": F.lit(0)})
    parts = [windows.withColumns({"method": F.lit("none"), "p_calibrated": F.col(p)})]
    final = [("none", None, None, None)]
    for how in methods:
        parts.append(oof.calibrated(windows, oof.fit_calibrators(base, p, label, how), p, how).withColumn("method", F.lit(how)))
        r = oof.fit_calibrators(agreed, p, label, how, held=[(0, -1)]).first()
        final.append((how, r["a"], r["b"], r["c"]))
    every = reduce(DataFrame.unionByName, parts)
    scores = ev.robust_of_levels(ev.level_metrics(every, ["method", "repeat"], key, "p_calibrated", label), ["method"])
    means = every.groupBy("method", "repeat", key, label).agg(ev.mean9("p_calibrated").alias("p"))
    made = windows.sparkSession.createDataFrame(final, "method string, a double, b double, c double")
    return adopted(scores.join(ev.calibration_error(means, "p", label, keys=["method"]), "method")).join(F.broadcast(made), "method")
