"""Chat formatting: logged conversations that only begin longer ones are collapsed before rendering; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Turns of one conversation that are ordered and rendered together; longer conversations are spread over tasks.
BLOCK_TURNS = 256


def _turns(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, block: int) -> DataFrame:
    """_c, _b (block), _o (place in the conversation from 1), _role, _text; repeated rows once, equal turns by role and text."""
    t = conversations.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(common.NO_ID)).alias("_c"), F.col(turn_col).cast("long").alias("_t"),
        F.col(role_col).cast("string").alias("_role"), F.col(text_col).cast("string").alias("_text"),
    )
    t = t.withColumn("_b", F.coalesce(F.floor(F.col("_t") / block), F.lit(-1)).cast("long"))
    # Repeated rows meet in their block: no shuffle beside the window's.
    own = Window.partitionBy("_c", "_b").orderBy(F.col("_t").asc_nulls_first(), F.col("_role").asc_nulls_first(), F.col("_text").asc_nulls_first())
    here = F.struct("_t", "_role", "_text")
    t = t.withColumn("_new", F.lag(here).over(own).isNull() | ~F.lag(here).over(own).eqNullSafe(here)).filter("_new").drop("_new")
    t = t.withColumn("_i", F.row_number().over(own))
    sizes = t.groupBy("_c", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_c", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return t.join(sizes, ["_c", "_b"]).select("_c", "_b", (F.col("_before") + F.col("_i")).alias("_o"), "_role", "_text")


def prefixes(turns: DataFrame) -> DataFrame:
    """_c, _b, _o, _p1, _p2: hash of the conversation's first _o turns, rolled on turn by turn within and across blocks."""
    h = [F.xxhash64(F.lit(s), "_o", F.col("_role").isNull(), "_role", F.col("_text").isNull(), "_text") for s in (1, 2)]
    t = turns.select("_c", "_b", "_o", h[0].alias("_h1"), h[1].alias("_h2"))
    own = Window.partitionBy("_c", "_b").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = t.groupBy("_c", "_b").agg(F.expr("bit_xor(_h1)").alias("_x1"), F.expr("bit_xor(_h2)").alias("_x2"))
    blocks = blocks.select("_c", "_b", *[F.coalesce(F.bit_xor(f"_x{i}").over(before), F.lit(0)).alias(f"_x{i}") for i in (1, 2)])
    t = t.select("_c", "_b", "_o", *[F.bit_xor(f"_h{i}").over(own).alias(f"_r{i}") for i in (1, 2)])
    return t.join(blocks, ["_c", "_b"]).select("_c", "_b", "_o", *[F.col(f"_r{i}").bitwiseXOR(F.col(f"_x{i}")).alias(f"_p{i}") for i in (1, 2)])


def collapse(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK_TURNS) -> tuple[DataFrame, DataFrame]:
    """(turns, kept): all turns in order, and _c, n_turns, n_same of the conversations that begin no longer one.

    Conversations count by their turns (role, text) in order of turn; turn numbers may differ. Of equal conversations the
    smallest id stays; n_same says how many there are. Rows with null id are one conversation; null roles and texts are values
    of their own; turns with null number come first; a repeated row counts once. An empty table gives empty results.
    """
    turns = _turns(conversations, id_col, turn_col, role_col, text_col, block)
    p = common.materialize(prefixes(turns), "prefixes")
    whole = p.groupBy("_c").agg(F.max(F.struct("_o", "_p1", "_p2")).alias("_w")).select("_c", "_w.*")
    same = whole.groupBy("_o", "_p1", "_p2").agg(F.min("_c").alias("_c"), F.count("*").alias("n_same"))
    longer = p.join(whole.select("_c", F.col("_o").alias("_n")), "_c").filter("_o < _n").select("_o", "_p1", "_p2").distinct()
    kept = same.join(longer, ["_o", "_p1", "_p2"], "left_anti").select("_c", F.col("_o").alias("n_turns"), "n_same")
    blocks = p.select("_c", "_b").distinct()
    return turns, kept.join(blocks, "_c")


def render(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK_TURNS) -> DataFrame:
    """id, part, n_turns (of the whole), n_same, rendered: the kept conversations as role-marked text.

    A part holds the turns numbered from part * block on, so that nothing grows with the length of a conversation; nearly all
    conversations have part 0 only (turns with null number: part -1). Parts in order make the whole text.
    """
    turns, kept = collapse(conversations, id_col, turn_col, role_col, text_col, block)
    line = F.concat(F.lit("<|im_start|>"), F.coalesce("_role", F.lit("")), F.lit("\n"), F.coalesce("_text", F.lit("")), F.lit("<|im_end|>\n"))
    shown = turns.join(kept, ["_c", "_b"]).groupBy("_c", "_b", "n_turns", "n_same").agg(F.array_sort(F.collect_list(F.struct("_o", line.alias("s")))).alias("s"))
    return shown.select(F.when(F.col("_c") != common.NO_ID, F.col("_c")).alias(id_col), F.col("_b").alias("part"), "n_turns", "n_same", F.array_join(F.transform("s", lambda x: x["s"]), "").alias("rendered"))
