"""The feature matrix of a window: its registry, its named sets, and the checks on them."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import ROLES, STATS, channel_names, nullable, statistics, window_id, window_values
from .panel import OPTICAL, RADAR

POSITIONS = 6
FORBIDDEN = {"id", "original_id", "window_id", "fold", "label", "target"}
#: Channels, statistics and metadata of the compact set.
COMPACT_CHANNELS = (
    "radar__vv", "radar__vh", "radar__vv_minus_vh", "radar__vv_plus_vh", "optical__ndwi", "optical__mndwi", "optical__ndmi", "optical__nbr",
    "optical__ndvi", "optical__ndre1", "optical__ndre2", "optical__chlorophyll_red_edge",
)
COMPACT_STATS = ("valid_count", "median", "std", "amplitude", "iqr", "first_to_last", "slope")
#: Metadata of windows, then of what is missing in them.
WINDOW_METADATA = (
    "window_length", "start_month", "end_month", "start_month_sin", "start_month_cos", "end_month_sin", "end_month_cos", "relative_position_count",
)
MISSING_METADATA = (
    "radar_valid_count", "optical_valid_count", "total_valid_band_count", "optical_gap_count", "longest_optical_valid_run", "longest_optical_missing_run",
    "radar_valid_proportion", "optical_valid_proportion",
)


def channels_in_order() -> list[str]:
    """Radar with its differences, then optical bands and indices."""
    radar = [c for c in channel_names() if c.startswith("radar__")]
    return radar + [c for c in channel_names() if not c.startswith("radar__")]


def _group(channel: str) -> str:
    if channel.endswith("_first_difference"):
        return "radar_temporal"
    if channel in ("radar__vv", "radar__vh"):
        return "radar_raw"
    if channel.startswith("radar__"):
        return "radar_derived"
    return "optical_raw" if channel.removeprefix("optical__") in ROLES.values() else "optical_index"


def registry() -> list[tuple[str, str, str, str]]:
    """(name, kind, group, sensor) of all 688 features in order; sensor is radar, optical, window (either) or both (neither alone)."""
    order = channels_in_order()
    sensor = lambda c: c.split("__")[0]
    out = [(f"relative__position_{k:02d}__{c}", "monthly", f"relative_{_group(c)}", sensor(c)) for k in range(1, POSITIONS + 1) for c in order]
    out += [(f"{c}__{s}", "aggregate", _group(c), sensor(c)) for c in order for s in STATS]
    out += [(f"radar__{b}__mean_abs_first_difference", "aggregate", "radar_stability", "radar") for b in ("vv", "vh")]
    out += [(f"metadata__{m}", "metadata", "metadata_window", "window") for m in WINDOW_METADATA]
    of = lambda m: "both" if m.startswith("total") else "radar" if m.startswith("radar") else "optical"
    out += [(f"metadata__{m}", "metadata", "metadata_missingness", of(m)) for m in MISSING_METADATA]
    out += [(f"metadata__{ROLES.get(b, b.lower())}_valid_count", "metadata", "metadata_band_validity", "radar" if b in RADAR else "optical") for b in (*RADAR, *OPTICAL)]
    for k in range(1, POSITIONS + 1):
        flags = (("radar_valid", "radar"), ("optical_valid", "optical"), ("padding", "window"))
        out += [(f"metadata__position_{k:02d}__{f}", "metadata", "metadata_position", s) for f, s in flags]
    return out


def names_of(which: str) -> list[str]:
    """Names of a set in registry order: relative, invariant, full, radar, optical or compact."""
    rows = registry()
    if which == "compact":
        want = {f"{c}__{s}" for c in COMPACT_CHANNELS for s in COMPACT_STATS} | {f"radar__{b}__mean_abs_first_difference" for b in ("vv", "vh")}
        want |= {f"metadata__{m}" for m in (*WINDOW_METADATA, *MISSING_METADATA) if not m.startswith("total")}
        found = [n for n, *_ in rows if n in want]
        if len(found) != len(want):
            raise ValueError(f"not in the registry: {sorted(want - set(found))}")
        return found
    keep = {
        "full": lambda kind, sensor: True,
        "relative": lambda kind, sensor: kind in ("monthly", "metadata"),
        "invariant": lambda kind, sensor: kind in ("aggregate", "metadata"),
        "radar": lambda kind, sensor: sensor in ("radar", "window"),
        "optical": lambda kind, sensor: sensor in ("optical", "window"),
    }
    if which not in keep:
        raise ValueError(f"no feature set {which}")
    return [name for name, kind, _, sensor in rows if keep[which](kind, sensor)]


def check_names(names: list[str]) -> None:
    """Feature names are unique and none holds a token that names an identity, a fold or a label."""
    bad = [n for n in names if FORBIDDEN & {t.casefold() for t in n.split("__")}]
    if bad or len(set(names)) < len(names):
        raise ValueError(f"not feature names: {bad or 'repeated names'}")


def without(frame: DataFrame, drop: list[str], least: int = 10) -> DataFrame:
    """frame without the named features; at least so many must remain."""
    left = [c for c in frame.columns if "__" in c and c not in set(drop)]
    if missing := sorted(set(drop) - set(frame.columns)):
        raise ValueError(f"no such features: {missing}")
    if len(left) < least:
        raise ValueError(f"{len(left)} features would remain, {least} must")
    return frame.drop(*drop)


def _longest(flags: np.ndarray) -> np.ndarray:
    """Length of the longest run of true along the first axis."""
    run = best = np.zeros(flags.shape[1:])
    for f in flags:
        run = np.where(f, run + 1, 0)
        best = np.maximum(best, run)
    return best


def _features(x: np.ndarray, start: int, names: list[str]) -> np.ndarray:
    """A row of the named features for each key, of one window, from the values by position, channel and key."""
    have, (length, _, keys) = {n: i for i, n in enumerate(channel_names())}, x.shape
    known = ~np.isnan(x)
    radar = known[:, have["radar__vv"]] & known[:, have["radar__vh"]]
    bands = {b: known[:, have[f"optical__{ROLES[b]}"]] for b in OPTICAL}
    optical = np.logical_and.reduce(list(bands.values()))
    gap, count = radar & ~optical, {b: v.sum(axis=0) for b, v in bands.items()}
    all_bands, radars, end = sum(count.values()), radar.sum(axis=0), start + length - 1
    angle = lambda month: (month - 1) * (2 * math.pi / 12)
    made = {
        "window_length": length, "start_month": start, "end_month": end, "start_month_sin": math.sin(angle(start)), "start_month_cos": math.cos(angle(start)), "end_month_sin": math.sin(angle(end)),
        "end_month_cos": math.cos(angle(end)), "relative_position_count": length, "radar_valid_count": radars, "optical_valid_count": optical.sum(axis=0),
        "total_valid_band_count": 2 * radars + all_bands, "optical_gap_count": gap.sum(axis=0), "longest_optical_valid_run": _longest(optical), "longest_optical_missing_run": _longest(gap),
        "radar_valid_proportion": radars / length, "optical_valid_proportion": all_bands / (length * len(OPTICAL)),
    } | {f"{b.lower()}_valid_count": radars for b in RADAR} | {f"{ROLES[b]}_valid_count": count[b] for b in OPTICAL}
    for k in range(1, POSITIONS + 1):
        made |= {f"position_{k:02d}__{n}_valid": f[k - 1] if k <= length else 0 for n, f in (("radar", radar), ("optical", optical))} | {f"position_{k:02d}__padding": int(length < k)}
    stats = statistics(x) if any(n.split("__")[-1] in STATS for n in names) else None

    def of(name: str):
        kind, _, rest = name.partition("__")
        if kind == "metadata":
            return made[rest]
        if kind == "relative":
            k, channel = int(rest[9:11]), rest[13:]
            return x[k - 1, have[channel]] if k <= length else np.nan
        channel, _, stat = name.rpartition("__")
        if stat == "mean_abs_first_difference":
            step = have[f"{channel}_first_difference"]
            with np.errstate(all="ignore"):
                return np.where(known[:, step], np.abs(x[:, step]), 0.0).sum(axis=0) / known[:, step].sum(axis=0)
        return stats[STATS.index(stat), have[channel]]

    out = np.empty((keys, len(names)))
    for j, n in enumerate(names):
        out[:, j] = of(n)
    return out


def matrix(arrays: DataFrame, key: str, names: list[str] | None = None, shown: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> DataFrame:
    """key, window_id and the named features (all, without names; as shown gives them) of every window: one row each, all doubles, no shuffle.

    A row of arrays becomes one for each window within its task, where numpy works on a channel of a block of keys at a time."""
    names = names or names_of("full")
    check_names(names)
    if unknown := sorted({*names} - {r[0] for r in registry()}):
        raise ValueError(f"not in the registry: {unknown}")

    def rows(batches):
        for keys, length, start, x in window_values(batches):
            at = [pa.array(np.full(len(keys), v, np.int32)) for v in (length, start)]
            cells = nullable(shown(_features(x, start, names)))
            ends = np.arange(0, len(cells) + 1, len(names), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([keys, *at, pa.ListArray.from_arrays(ends, cells)], names=[key, "window_length", "window_start", "cells"])

    kinds = [T.StructField(c, T.IntegerType()) for c in ("window_length", "window_start")] + [T.StructField("cells", T.ArrayType(T.DoubleType()))]
    made = arrays.select(key, "months").mapInArrow(rows, T.StructType([T.StructField(key, arrays.schema[key].dataType), *kinds]))
    return made.select(key, window_id(key).alias("window_id"), *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


def group_missingness(frame: DataFrame) -> DataFrame:
    """feature_group, features, observations, missing over the feature columns of a matrix: one pass, then a few rows unpivoted."""
    groups: dict[str, list[str]] = {}
    for name, _, group, _ in registry():
        if name in frame.columns:
            groups.setdefault(group, []).append(name)
    counts = frame.agg(F.count("*").alias("rows"), *[sum((F.count(F.when(F.col(n).isNull(), 1)) for n in own), F.lit(0)).alias(g) for g, own in groups.items()])
    cells = F.array(*[F.struct(F.lit(g).alias("feature_group"), F.lit(len(own)).alias("features"), (F.col("rows") * len(own)).alias("observations"), F.col(g).alias("missing")) for g, own in groups.items()])
    return counts.select(F.explode(cells).alias("x")).select("x.*")


def counts_by_group(spark: SparkSession) -> DataFrame:
    """feature_group, kind, features of the registry (688 rows on the driver)."""
    rows = spark.createDataFrame(registry(), "name string, kind string, feature_group string, sensor string")
    return rows.groupBy("feature_group", "kind").agg(F.count("*").alias("features"))
