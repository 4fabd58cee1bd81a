"""Fill-in-middle transformation: texts cut at two ranks of their units and put together anew for infilling."""

from __future__ import annotations

import hashlib
import re
from collections import deque
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A word with the space before it, or space that no word follows. They tile the text.
UNIT = re.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")
#: Before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")


def draws(seed: int, doc_id) -> list[int]:
    """Four numbers under 2^32 that depend on seed and id alone; a null id counts as an empty one."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def count_units(text: str) -> int:
    """First pass: a lazy run over the matches; none is kept."""
    return sum(1 for _ in UNIT.finditer(text))


def ends(text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: the code points up to which low and high units (low <= high) reach; the iterator stops at the second."""
    units = UNIT.finditer(text)
    first = deque(islice(units, low), 1)
    a = first[0].end() if first else 0
    second = deque(islice(units, high - low), 1)
    return a, second[0].end() if second else a


def form_text(text: str | None, doc_id, seed: int, rate: int, spm: int, markers: tuple[str, str, str]) -> tuple:
    """(output, n, form, prefix_chars, middle_chars)."""
    text = text or ""
    n, (h1, h2, h3, h4) = count_units(text), draws(seed, doc_id)
    if not text or any(m in text for m in markers) or h3 % 100 >= rate:
        return text, n, "plain", None, None
    a, b = ends(text, *sorted((h1 % (n + 1), h2 % (n + 1))))
    p, s, m = markers
    if h4 % 100 < spm:
        return f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}", n, "spm", a, b - a
    return f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}", n, "psm", a, b - a


def check_markers(markers: tuple[str, str, str]) -> None:
    """Markers must be told apart wherever they stand: none may begin with what one ends with, or hold another."""
    for a in markers:
        for b in markers:
            if not a or (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b))):
                raise ValueError(f"markers {a!r} and {b!r} can overlap")
    if len(set(markers)) < 3:
        raise ValueError("markers must differ")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """docs as _row with output, n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points, null if plain).

    rate of 100 texts are cut, spm of 100 of those with the suffix first. Units are counted in a first pass over the matches; a second
    one advances to the two ranks. Besides text and output, memory does not grow with the text. Null texts count as empty; these, and
    texts that hold a marker, stay plain. Draws depend on seed and id only, so repeated rows are treated alike, as are all rows with a
    null id and the same text. An empty table gives no rows; extra columns pass through in _row. Nothing is shuffled.
    """
    check_markers(markers)

    @F.pandas_udf("output string, n long, form string, prefix_chars long, middle_chars long")
    def form(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        made = [form_text(t, i, seed, rate, spm, markers) for i, t in zip(ids, texts, strict=True)]
        out = pd.DataFrame(made, columns=["output", "n", "form", "prefix_chars", "middle_chars"])
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    common.bound_batches(docs.sparkSession)
    made = common.packed(docs).withColumn("_made", form(F.col(f"_row.`{id_col}`").cast("string"), F.col(f"_row.`{text_col}`")))
    return made.select("_row", "_made.*")


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that transform has made output from. Only texts without markers are cut, so output splits at the three put in."""
    check_markers(markers)
    parts = F.split(output, "|".join(re.escape(m) for m in markers), -1)
    first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)
