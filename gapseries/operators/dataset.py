"""A data set as a whole: names, agreement of its three tables, loading, summaries; windows of two models brought together; splits."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapseries.functions import season

from . import panel as pn


def parsed(columns: list[str]) -> list[tuple[str, int, str]]:
    """(band, month, sensor) of each wide column; a name that is not a known band and a month of 01 to 12 is an error."""
    out = []
    for c in columns:
        m = re.fullmatch(r"(.+)_(\d\d)", c)
        if not m or m[1] not in pn.BANDS or int(m[2]) not in pn.MONTHS:
            raise ValueError(f"no band and month: {c}")
        out.append((m[1], int(m[2]), "radar" if m[1] in pn.RADAR else "optical"))
    return out


def grid_faults(columns: list[str]) -> dict[str, list[str]]:
    """absent and repeated cells of the grid of all bands and months, as names."""
    found = Counter((b, m) for b, m, _ in parsed(columns))
    name = lambda cell: f"{cell[0]}_{cell[1]:02d}"
    return {"absent": [name((b, m)) for b in pn.BANDS for m in pn.MONTHS if (b, m) not in found], "repeated": [name(c) for c, n in found.items() if n > 1]}


def agreement(train: DataFrame, test: DataFrame, sample: DataFrame, key: str, label: str, targets: list[str], pos: str = "pos") -> DataFrame:
    """rule, faults: a row for each rule that train, test and sample must keep together; all faults must be 0.

    Rules of names: train has the label and test has not, the features stand in the same order, the sample has the key and the targets.
    Rules of rows: labels are 0 or 1 and both occur, keys are neither null nor repeated in a table nor in both, test and sample hold the
    same keys in the same places (pos, from 0). Each is counted by one aggregation of a table or of one join by key."""
    names = lambda df: [c for c in df.columns if c not in (key, label, pos)]
    schema = {
        "label_absent_in_train": int(label not in train.columns), "label_present_in_test": int(label in test.columns),
        "feature_order": sum(a != b for a, b in zip(names(train), names(test), strict=False)) + abs(len(names(train)) - len(names(test))),
        "sample_columns": int([c for c in sample.columns if c != pos] != [key, *targets]),
    }
    spark = train.sparkSession
    out = spark.createDataFrame(list(schema.items()), "rule string, faults long")
    add = lambda row: row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).cast("long").alias("faults")) for c in row.columns])).alias("e")).select("e.*")
    if label in train.columns:
        y = F.col(label)
        out = out.unionByName(add(train.agg(F.count(F.when(y.isNull() | ~y.isin(0, 1), 1)).alias("label_values"), (2 - F.count_distinct(F.when(y.isin(0, 1), y))).alias("label_classes"))))
    for name, df in (("train", train), ("test", test), ("sample", sample)):
        out = out.unionByName(add(df.agg(F.count(F.when(F.col(key).isNull(), 1)).alias(f"{name}_null_keys"), (F.count(key) - F.count_distinct(key)).alias(f"{name}_repeated_keys"))))
    known = test.groupBy(key).agg(F.min(pos).alias("_t"))
    shared = known.join(train.select(key).distinct(), key).agg(F.count("*").alias("keys_in_train_and_test"))
    both = known.filter(F.col(key).isNotNull()).join(sample.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(pos).alias("_s")), key, "full")
    n = lambda when: F.count(F.when(when, 1))
    places = both.agg(n(F.col("_s").isNull()).alias("absent_in_sample"), n(F.col("_t").isNull()).alias("unknown_in_sample"), n(F.col("_t") != F.col("_s")).alias("sample_places"))
    return out.unionByName(add(shared)).unionByName(add(places))


def summary(wide: DataFrame, columns: list[str], label: str | None = None) -> DataFrame:
    """rows, cells, missing_cells, rows_with_missing, and with a label positives, negatives and positive_rate (null without rows)."""
    missing = pn.sentinel_counts(wide, columns)
    if label is None:
        return missing
    y = F.col(label)
    labels = wide.agg(F.count(F.when(y == 1, 1)).alias("positives"), F.count(F.when(y == 0, 1)).alias("negatives"), F.avg(y.cast("double")).alias("positive_rate"))
    return missing.crossJoin(labels)  # a row each


@dataclass(frozen=True)
class Loaded:
    """Tables with null for the sentinel, and what was counted before."""

    train: DataFrame
    test: DataFrame
    sample: DataFrame
    train_summary: DataFrame
    test_summary: DataFrame


def load(train: DataFrame, test: DataFrame, sample: DataFrame, key: str, label: str, targets: list[str]) -> Loaded:
    """The three tables checked together, counted and cleaned; every broken rule is named in one error. The inputs are not changed."""
    columns = [c for c in test.columns if c not in (key, label, "pos")]
    grid = grid_faults(columns)
    broken = {f"grid_{k}": v for k, v in grid.items() if v}
    broken |= {r["rule"]: r["faults"] for r in agreement(train, test, sample, key, label, targets).filter("faults <> 0").collect()}  # a row for each rule
    for name, df in (("train", train), ("test", test)):
        if set(columns) <= set(df.columns):
            bad = pn.check(df.withColumns({c: F.col(c).cast("double") for c in columns}), key, None, columns).first()["bad_rows"]
            broken |= {f"{name}_bad_rows": bad} if bad else {}
    if broken:
        raise ValueError("the tables break rules: " + ", ".join(f"{k}: {v}" for k, v in sorted(broken.items())))
    return Loaded(pn.sentinel_to_null(train, columns), pn.sentinel_to_null(test, columns), sample, summary(train, columns, label), summary(test, columns))


def missing_by_row(panel: DataFrame, key: str) -> DataFrame:
    """key, observations, missing, rate, radar_missing, optical_missing, partial_months: of every entity of a dense panel; a month is partial
    if some of its optical bands are there and some not."""
    n = lambda bands: sum((F.col(b).isNull().cast("long") for b in bands), F.lit(0).cast("long"))
    partial = pn.any_valid(pn.OPTICAL) & ~pn.all_valid(pn.OPTICAL)
    g = panel.groupBy(key).agg((F.count("*") * len(pn.BANDS)).alias("observations"), F.sum(n(pn.RADAR)).alias("radar_missing"), F.sum(n(pn.OPTICAL)).alias("optical_missing"), F.count(F.when(partial, 1)).alias("partial_months"))
    missing = F.col("radar_missing") + F.col("optical_missing")
    return g.withColumns({"missing": missing, "rate": missing / F.col("observations")})


def aligned_windows(left: DataFrame, right: DataFrame, on: list[str], same: list[str], values: tuple[str, str]) -> DataFrame:
    """on, same and both models' values: windows one to one by on. A window that one side lacks or has twice, or whose columns of same
    differ between the sides (nulls are equal), is an error when its row is computed."""
    def side(df: DataFrame, value: str, mark: str) -> DataFrame:
        return df.groupBy(*on).agg(F.count("*").alias(f"_n{mark}"), F.first(F.struct(*same)).alias(f"_s{mark}"), F.first(value).alias(f"_v{mark}"))

    # Either side's null keys make rows of their own, which then lack a partner.
    j = side(left, values[0], "l").join(side(right, values[1], "r"), on, "full")
    at = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in on])
    said = lambda what: F.raise_error(F.concat(F.lit(f"{what}: "), at)).cast("boolean")
    one = F.when((F.coalesce("_nl", F.lit(0)) != 1) | (F.coalesce("_nr", F.lit(0)) != 1), said("windows are not one to one")).when(~F.col("_sl").eqNullSafe(F.col("_sr")), said("windows differ in their columns")).otherwise(F.lit(True))
    return j.filter(one).select(*on, *[F.col(f"_sl.{c}").alias(c) for c in same], F.col("_vl").alias(values[0]), F.col("_vr").alias(values[1]))


def season_split(rows: DataFrame, repeat: int, fold: int, held: str) -> tuple[DataFrame, DataFrame]:
    """(training, validation) of a repeat: windows in neither the fold nor the season, and windows in both. What is in one of them only is
    in none. rows: repeat, fold, window_start."""
    mine = rows.filter(F.col("repeat") == repeat)
    in_fold, in_season = F.col("fold") == fold, season(F.col("window_start")) == held
    return mine.filter(~in_fold & ~in_season), mine.filter(in_fold & in_season)


def subset(rows: DataFrame, chosen: DataFrame, key: str = "window_id") -> DataFrame:
    """rows whose key is among chosen; nothing chosen, or a key that rows lack, is an error."""
    wanted = chosen.select(key).distinct()
    absent = wanted.join(rows.select(key), key, "left_anti").agg(F.count("*").alias("absent"), F.min(F.col(key).cast("string")).alias("one"))
    seen = wanted.agg(F.count("*").alias("n")).crossJoin(absent).first()
    if not seen["n"]:
        raise ValueError("nothing is chosen")
    if seen["absent"]:
        raise ValueError(f"{seen['absent']} chosen are absent, such as {seen['one']}")
    return rows.join(wanted, key, "left_semi")
