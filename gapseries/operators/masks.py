"""Availability masks as packed bits, band by band: observed masks, their library, masked views, manifests and checks.

A mask is a struct of whole numbers: radar has a bit for each month, early and late have ten for each of the first and last six
months, one for each optical band. A view's mask counts from the window's first month instead: radar 6 bits, optical 60."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapseries.functions import uniform

from .panel import BANDS, OPTICAL, RADAR, all_valid, any_valid
from .views import window_hash

WIDTH = len(OPTICAL)
FULL = (1 << WIDTH) - 1
POSITIONS = 6
ALL = (1 << (POSITIONS * WIDTH)) - 1
LENGTHS = (4, 5, 6)


def _up(x: Column, by: Column) -> Column:
    return F.call_function("shiftleft", x, by)


def _down(x: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, by)


def _or(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def observed_masks(panel: DataFrame, key: str) -> DataFrame:
    """key, mask, partial_radar (months with some radar bands but not all): bits of a key's rows, or-ed. Absent months need no rows."""
    m = F.col("month").cast("int")
    bands = _or([F.when(F.col(b).isNotNull(), F.lit(1 << i)).otherwise(0) for i, b in enumerate(OPTICAL)]).cast("long")
    at = lambda first: _up(bands, (m - first) * WIDTH)
    g = panel.groupBy(key).agg(
        F.bit_or(F.when(all_valid(RADAR), _up(F.lit(1), m - 1)).otherwise(0)).alias("radar"), F.bit_or(F.when(m <= 6, at(1)).otherwise(F.lit(0).cast("long"))).alias("early"),
        F.bit_or(F.when(m > 6, at(7)).otherwise(F.lit(0).cast("long"))).alias("late"), F.count(F.when(any_valid(RADAR) & ~all_valid(RADAR), 1)).alias("partial_radar"),
    )
    return g.select(key, F.struct("radar", "early", "late").alias("mask"), "partial_radar")


def cell(mask: Column, month: Column) -> Column:
    """The ten band bits of a month."""
    m = month.cast("int")
    x = F.when(m <= 6, _down(mask["early"], (m - 1) * WIDTH)).otherwise(_down(mask["late"], (m - 7) * WIDTH))
    return x.bitwiseAND(F.lit(FULL).cast("long"))


def spread(months: Column) -> Column:
    """Six month bits as sixty: all ten bands of each month that is on."""
    table = [sum(FULL << (i * WIDTH) for i in range(POSITIONS) if x >> i & 1) for x in range(1 << POSITIONS)]
    return F.get(F.array(*[F.lit(x).cast("long") for x in table]), months)


def whole_months(optical: Column) -> Column:
    """Of sixty band bits the six month bits: on where all ten bands are."""
    one = lambda i: (_down(optical, F.lit(i * WIDTH)).bitwiseAND(F.lit(FULL).cast("long")) == FULL).cast("int") * F.lit(1 << i)
    return _or([one(i) for i in range(POSITIONS)])


def some_months(optical: Column) -> Column:
    """Of sixty band bits the six month bits: on where any band is."""
    one = lambda i: (_down(optical, F.lit(i * WIDTH)).bitwiseAND(F.lit(FULL).cast("long")) != 0).cast("int") * F.lit(1 << i)
    return _or([one(i) for i in range(POSITIONS)])


def optical_months(mask: Column) -> Column:
    """Twelve month bits: on where all optical bands are."""
    return whole_months(mask["early"]).bitwiseOR(_up(whole_months(mask["late"]), F.lit(6)))


def text(bits: Column, n: int) -> Column:
    """n bits as 0 and 1, the lowest first; more where higher ones are on."""
    return F.reverse(F.substring(F.bin(bits.cast("long") + F.lit(1 << n).cast("long")), 2, 64))


def band_text(optical: Column) -> Column:
    """Sixty bits as six groups of ten, split by semicolons."""
    return F.regexp_replace(text(optical, POSITIONS * WIDTH), f"(.{{{WIDTH}}})(?=.)", "$1;")


def start(radar: Column) -> Column:
    """The first month that is on, 1 to 12; null where none is."""
    return F.nullif(F.locate("1", text(radar, 12)), F.lit(0))


def length(radar: Column) -> Column:
    return F.bit_count(radar)


def flaws(mask: Column, partial_radar: Column) -> dict[str, Column]:
    """What no template may be, each as a condition."""
    r = mask["radar"]
    low = r.bitwiseAND(-r)
    outside = mask["early"].bitwiseAND(F.bitwise_not(spread(r.bitwiseAND(F.lit(63))))) != 0
    outside_late = mask["late"].bitwiseAND(F.bitwise_not(spread(_down(r, F.lit(6))))) != 0
    return {
        "no_radar": r == 0, "radar_gap": (r + low).bitwiseAND(r) != 0, "wrong_length": ~length(r).isin(*LENGTHS), "optical_outside": outside | outside_late, "partial_radar": partial_radar > 0,
    }


def sound(mask: Column, partial_radar: Column) -> Column:
    return ~reduce(lambda a, b: a | b, flaws(mask, partial_radar).values())


def mask_faults(masks: DataFrame) -> DataFrame:
    """How many of the masks of observed_masks break each rule, in one pass."""
    return masks.agg(F.count("*").alias("rows"), *[F.count(F.when(c, 1)).alias(n) for n, c in flaws(F.col("mask"), F.col("partial_radar")).items()])


def mask_id(mask: Column) -> Column:
    """mask_ and 16 hex digits of the SHA-256 of the pattern as canonical JSON."""
    listed = lambda bits: F.concat(F.lit("["), F.regexp_replace(bits, "(.)(?=.)", "$1,"), F.lit("]"))
    months = F.concat_ws(";", band_text(mask["early"]), band_text(mask["late"]))
    optical = F.array_join(F.transform(F.split(months, ";"), listed), ",")
    names = "[" + ",".join(f'"{b}"' for b in OPTICAL) + "]"
    whole = F.concat(F.lit('{"optical":['), optical, F.lit(f'],"optical_bands":{names},"radar":'), listed(text(mask["radar"], 12)), F.lit("}"))
    return F.concat(F.lit("mask_"), F.substring(F.sha2(whole, 256), 1, 16))


def library(masks: DataFrame) -> DataFrame:
    """mask_id, frequency, mask, window_start, window_length and internal_optical_gap_count of each distinct mask. A mask that breaks a
    rule is an error when its row is computed."""
    said = F.raise_error(F.lit("a mask breaks a rule; mask_faults tells which")).cast("int")
    radar = F.when(sound(F.col("mask"), F.col("partial_radar")), F.col("mask.radar")).otherwise(said)
    fine = masks.select(F.struct(radar.alias("radar"), "mask.early", "mask.late").alias("mask"))
    m = F.col("mask")
    gaps = F.bit_count(m["radar"].bitwiseAND(F.bitwise_not(optical_months(m))))
    g = fine.groupBy("mask").agg(F.count("*").alias("frequency"))
    return g.select(mask_id(m).alias("mask_id"), "frequency", "mask", start(m["radar"]).alias("window_start"), length(m["radar"]).alias("window_length"), gaps.alias("internal_optical_gap_count"))


def library_texts(lib: DataFrame) -> DataFrame:
    """The library as it is stored: patterns as text, and nothing of the rows that they come from."""
    m = F.col("mask")
    return lib.select(
        "mask_id", "frequency", "window_start", (F.col("window_start") + F.col("window_length") - 1).alias("window_end"), "window_length", text(m["radar"], 12).alias("radar_availability"),
        text(optical_months(m), 12).alias("optical_month_availability"), F.concat_ws(";", band_text(m["early"]), band_text(m["late"])).alias("optical_band_availability"), "internal_optical_gap_count",
    )


def _relative(mask: Column, first: Column, n: Column) -> tuple[Column, Column, Column]:
    """Position, radar and optical bits of a window of n months from `first` on; a null mask leaves all on."""
    by = first.cast("int") - 1
    positions = _up(F.lit(1), n.cast("int")) - 1
    early = _down(mask["early"], by * WIDTH).bitwiseOR(_up(mask["late"], F.lit(POSITIONS * WIDTH) - by * WIDTH))
    optical = F.when(by < 6, early).otherwise(_down(mask["late"], (by - 6) * WIDTH))
    inside = spread(positions)
    return positions, F.coalesce(_down(mask["radar"], by), positions).bitwiseAND(positions), F.coalesce(optical, inside).bitwiseAND(inside)


def masked_views(chosen: DataFrame, key: str, mode: str, seed: int = 42, temporal: float = 0.0, optical: float = 0.0) -> DataFrame:
    """The manifest of views, a row each, with the view's bits beside their texts.

    chosen: key, fold, label, view_index, window_start, window_length, and the mask drawn (mask_id, mask, frequency and
    internal_optical_gap_count of a library; null for a full window). Months are dropped with probability temporal, then optical months
    that have any band left with probability optical, by hash of seed, key, view and position."""
    c = F.col
    drop = lambda what, p: _or([F.when(uniform(F.lit(what), F.lit(seed), key, "view_index", F.lit(i)) < p, F.lit(1 << i)).otherwise(0) for i in range(POSITIONS)]) if p else F.lit(0)
    positions, radar, bands = _relative(c("mask"), c("window_start"), c("window_length"))
    v = chosen.withColumns({"_positions": positions, "_radar": radar, "_optical": bands})
    v = v.withColumn("_gone", drop("temporal", temporal).bitwiseAND(c("_positions")))
    left = F.bitwise_not(c("_gone"))
    v = v.withColumns({"_radar": c("_radar").bitwiseAND(left), "_optical": c("_optical").bitwiseAND(F.bitwise_not(spread(c("_gone"))))})
    v = v.withColumn("_dark", drop("optical", optical).bitwiseAND(some_months(c("_optical"))))
    v = v.withColumn("_optical", c("_optical").bitwiseAND(F.bitwise_not(spread(c("_dark")))))
    v = v.withColumns({"_whole": whole_months(c("_optical")), "mask_id": F.coalesce("mask_id", F.lit("full_window"))})
    v = v.withColumns({"radar_availability": text(c("_radar"), POSITIONS), "optical_band_availability": band_text(c("_optical"))})
    ident = window_hash(c(key), c("fold"), F.lit(mode), F.lit(seed), c("view_index"), c("window_start"), c("window_length"), c("mask_id"), c("radar_availability"), c("optical_band_availability"))
    return v.select(
        key, ident.alias("window_id"), "fold", "label", F.lit(mode).alias("generation_mode"), "view_index", F.lit(seed).alias("augmentation_seed"), "window_start", (c("window_start") + c("window_length") - 1).alias("window_end"), "window_length",
        text(c("_positions"), POSITIONS).alias("position_mask"), "radar_availability", text(c("_whole"), POSITIONS).alias("optical_month_availability"), "optical_band_availability",
        text(c("_gone"), POSITIONS).alias("temporal_dropout_mask"), text(c("_dark"), POSITIONS).alias("optical_dropout_mask"), F.bit_count("_radar").alias("radar_months"), F.bit_count("_whole").alias("optical_months"),
        F.bit_count(c("_radar").bitwiseAND(F.bitwise_not(c("_whole")))).alias("internal_optical_gap_count"), F.coalesce("internal_optical_gap_count", F.lit(0)).alias("test_mask_optical_gap_count"),
        c("mask").isNotNull().alias("test_mask_used"), "mask_id", F.coalesce("frequency", F.lit(0)).cast("long").alias("source_mask_frequency"), c("_radar").alias("radar_bits"), c("_optical").alias("optical_bits"),
    )


def view_values(views: DataFrame, panel: DataFrame, key: str) -> DataFrame:
    """window_id, key, month, pos and the bands: a row for each position of each view, null where the view's bits are off. Other bands
    of a month keep their values where one is off."""
    v = views.select("window_id", key, "radar_bits", "optical_bits", "window_start", F.explode(F.sequence(F.lit(1), "window_length")).alias("pos"))
    v = v.withColumn("month", F.col("window_start") + F.col("pos") - 1).join(panel, [key, "month"], "left")
    at = F.col("pos").cast("int") - 1
    radar = _down(F.col("radar_bits"), at).bitwiseAND(F.lit(1)) == 1
    band = lambda i: _down(F.col("optical_bits"), at * WIDTH + i).bitwiseAND(F.lit(1).cast("long")) == 1
    on = {b: radar if b in RADAR else band(OPTICAL.index(b)) for b in BANDS}
    return v.select("window_id", key, "month", "pos", *[F.when(on[b], F.col(b)).alias(b) for b in BANDS])


def view_faults(views: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """rule, faults: how often views and their values break each rule of a window dataset; all must be 0.

    One pass over each table and one join by view; keys in several folds and repeated ids are counted by aggregation."""
    c = F.col
    n = lambda x: F.count(F.when(x, 1))
    inside = _up(F.lit(1), c("window_length").cast("int")) - 1
    own = views.agg(
        n(~c("window_length").isin(*LENGTHS)).alias("wrong_length"), n((c("window_start") < 1) | (c("window_end") > 12) | (c("window_end") != c("window_start") + c("window_length") - 1)).alias("wrong_months"),
        n(c("radar_bits").bitwiseAND(F.bitwise_not(inside)) != 0).alias("radar_in_padding"), n(c("optical_bits").bitwiseAND(F.bitwise_not(spread(inside))) != 0).alias("optical_in_padding"),
        n(c("window_id").isNull() | c(key).isNull() | c("fold").isNull()).alias("nulls"), n(c("radar_availability") != text(c("radar_bits"), POSITIONS)).alias("radar_text"),
        n(c("optical_band_availability") != band_text(c("optical_bits"))).alias("optical_text"),
    )
    repeated = views.groupBy("window_id").count().agg(n(c("count") > 1).alias("repeated_ids"))
    split = views.groupBy(key).agg(F.min("fold").alias("a"), F.max("fold").alias("b")).agg(n(c("a") != c("b")).alias("keys_in_two_folds"))
    at = c("pos").cast("int") - 1
    bit = lambda b: (_down(c("radar_bits"), at).bitwiseAND(F.lit(1)) if b in RADAR else _down(c("optical_bits"), at * WIDTH + OPTICAL.index(b)).bitwiseAND(F.lit(1).cast("long"))) == 1
    bad = lambda b: c(b).isNull() | F.isnan(b) | (F.abs(b) == float("inf"))
    count = lambda x: sum((F.when(x(b), 1).otherwise(0) for b in BANDS), F.lit(0))
    v = values.select("window_id", "pos", "month", *BANDS).join(views.select("window_id", "radar_bits", "optical_bits", "window_start", "window_length"), "window_id", "full")
    cells = v.agg(
        F.coalesce(F.sum(count(lambda b: ~bit(b) & c(b).isNotNull())), F.lit(0)).alias("masked_cells_with_values"), F.coalesce(F.sum(count(lambda b: bit(b) & bad(b))), F.lit(0)).alias("available_cells_without"),
        n(c("pos").isNull() | c("window_start").isNull()).alias("unmatched"), n(~c("pos").between(1, c("window_length")) | (c("month") != c("window_start") + c("pos") - 1)).alias("wrong_positions"),
    )
    places = values.groupBy("window_id", "pos").count().agg(n(c("count") > 1).alias("repeated_positions"))
    one = own.crossJoin(repeated).crossJoin(split).crossJoin(cells).crossJoin(places)  # a row each
    return one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("rule"), c(x).cast("long").alias("faults")) for x in one.columns])).alias("r")).select("r.*")
