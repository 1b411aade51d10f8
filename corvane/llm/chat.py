"""Chat formatting: cumulative snapshots collapse to their longest conversation, which is then rendered.

A log often holds a conversation after each of its turns. Two 64-bit hashes roll over a conversation's turns, each turn
hashed with its place, so every prefix has a 128-bit name. A conversation whose name is that of a shorter prefix of
another goes (an anti-join); of equal conversations the one with the least conv_id stays. Only what is left is rendered.

DataFrame functions only. Prefix names become distinct before they are shuffled for the join, so a first turn that a
third of all conversations share is one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import written

# The markers of a rendered turn, and what stands for their opening in a text.
OPEN, CLOSE, CUT, SAFE = "<|im_start|>", "<|im_end|>", "<|", "< |"
NO_ROLE = "unknown"


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1, by turn, then role and text), role, text, and the prefix name (one, two) up to each turn."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("place", F.row_number().over(order))
    # A null adds nothing to the hash, so flags tell it from any text.
    parts = (F.col("place"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))
    rows = rows.withColumns({"_one": F.xxhash64(F.lit(1), *parts), "_two": F.xxhash64(F.lit(2), *parts)})
    # Exclusive or over the places so far: rolling, and each place enters with its number.
    return rows.withColumns({"one": F.bit_xor("_one").over(upto), "two": F.bit_xor("_two").over(upto), "_n": F.max("place").over(Window.partitionBy("conv_id"))})


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that are a prefix of no longer one; of equal ones the least conv_id.

    A null conv_id is a conversation like any other; repeated rows are turns of their own.
    """
    named = written(_turns(conversations).select("conv_id", "place", "one", "two", "_n"), "prefixes")
    whole = named.where("place = _n").select("conv_id", F.col("_n").cast("long").alias("n_turns"), "one", "two")
    inner = named.where("place < _n").select(F.col("place").cast("long").alias("n_turns"), "one", "two").distinct()
    # Equal conversations become one row before the join: a minimum that combines before the shuffle.
    first = F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id"))
    whole = whole.groupBy("n_turns", "one", "two").agg(first.alias("f"))
    return whole.join(inner, ["n_turns", "one", "two"], "left_anti").select("f.conv_id", "n_turns")


def rendered_turn(role: Column, text: Column) -> Column:
    """One turn as text; markers within it can't be taken for real ones."""
    safe = lambda c: F.replace(c, F.lit(CUT), F.lit(SAFE))
    return F.concat(F.lit(OPEN), safe(F.coalesce(role, F.lit(NO_ROLE))), F.lit("\n"), safe(F.coalesce(text, F.lit(""))), F.lit(CLOSE + "\n"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, rendered of each maximal conversation; an empty table gives an empty result."""
    kept = maximal(conversations).withColumnRenamed("conv_id", "_id")
    turns = conversations.join(kept, F.col("conv_id").eqNullSafe(F.col("_id"))).select("conv_id", "n_turns", "turn", "role", "text")
    # One conversation is one text, as long as its turns are.
    found = turns.groupBy("conv_id", "n_turns").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return found.select("conv_id", "n_turns", F.array_join(F.transform("t", lambda x: rendered_turn(x["role"], x["text"])), "").alias("rendered"))


ORACLE = """
WITH placed AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
  FROM conversations
), named AS (
  SELECT conv_id, place, role, text,
         string_agg(coalesce(role, chr(1)) || chr(2) || coalesce(text, chr(1)), chr(3))
           OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS name,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM placed
), prefixes AS (
  SELECT DISTINCT name, place FROM named WHERE place < n
), kept AS (
  SELECT min(conv_id) AS conv_id FROM named
  WHERE place = n AND NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.name = named.name AND p.place = named.place)
  GROUP BY name, n
)
SELECT conv_id, max(n) AS n_turns,
       string_agg('<|im_start|>' || replace(coalesce(role, 'unknown'), '<|', '< |') || chr(10)
                  || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY place) AS rendered
FROM named JOIN kept USING (conv_id) GROUP BY conv_id
"""
