"""Chat formatting by cumulative-snapshot collapse, in DataFrame functions only.

Logs often hold a conversation again after each turn. Rolling hashes of the turns so far find conversations whose whole
is a proper beginning of a longer one; an anti-join drops them, equal ones are kept once, and the rest are rendered.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm.common import write_table


def _turn_hashes(turns: DataFrame) -> DataFrame:
    part = lambda seed: F.xxhash64(F.lit(seed), F.col("pos"), F.coalesce(F.concat(F.lit("="), F.col("role")), F.lit("-")), F.coalesce(F.col("m"), F.lit("-")))
    return turns.withColumns({"h1": part(1), "h2": part(2)})


def _turns(turns: DataFrame) -> DataFrame:
    """Turns without texts: position in the conversation, and two rolling 64-bit hashes of all up to it.

    A hash of (position, role, text) is folded into the ones before by exclusive or over a running window; the position
    in the hash makes the order count. Ties of turn are ordered by role and the text's MD5; null counts as a value.
    """
    turns = turns.select("conv_id", "turn", "role", F.md5("text").alias("m"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "m")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("pos", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    turns = _turn_hashes(turns)
    return turns.select("conv_id", "pos", "n", F.bit_xor("h1").over(upto).alias("p1"), F.bit_xor("h2").over(upto).alias("p2"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that are not a proper beginning of another; of equal ones the smallest id.
    Turns without a conv_id take no part."""
    return _maximal(write_table(_turns(turns.filter("conv_id IS NOT NULL")), "turns"))


def _maximal(rolled: DataFrame) -> DataFrame:
    ends = rolled.filter("pos = n").groupBy("pos", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    begun = rolled.filter("pos < n").select("pos", "p1", "p2").distinct()  # a first turn that many share is one row
    return ends.join(begun, ["pos", "p1", "p2"], "left_anti").select("conv_id", F.col("pos").cast("long").alias("n_turns"))


def _lone(turns: DataFrame, rolled: DataFrame) -> DataFrame:
    """role and text of the turns without a conv_id, each content once, that no conversation begins with."""
    lone = turns.filter("conv_id IS NULL").select("role", "text").distinct()
    firsts = rolled.filter("pos = 1").select("p1", "p2").distinct()
    own = _turn_hashes(lone.withColumns({"pos": F.lit(1), "m": F.md5("text")}))
    return own.join(firsts, (own["h1"] == firsts["p1"]) & (own["h2"] == firsts["p2"]), "left_anti").select("role", "text")


def chatml(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def format_chats(turns: DataFrame, render=chatml) -> DataFrame:
    """conv_id, n_turns, rendered for every maximal conversation.

    A row with a null conv_id is a conversation of one turn: of equal ones, and of those that a known conversation begins
    with, none is kept beside it; conv_id stays null. Null roles and texts render as empty. Texts are rendered as they are,
    control markers in them too: give another `render` to escape them. Ties of turn are ordered by role and text's MD5;
    repeated rows are turns of their own. An empty table gives an empty result; other columns are ignored. The turns of one
    conversation are ordered and rendered in one task, as they become one row.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    rolled = write_table(_turns(turns.filter("conv_id IS NOT NULL")), "turns")
    kept = turns.join(_maximal(rolled), "conv_id")  # the partitions by conv_id also serve the next step
    line = F.struct("turn", "role", F.md5("text").alias("m"), render(F.col("role"), F.col("text")).alias("line"))
    lines = F.sort_array(F.collect_list(line))
    known = kept.groupBy("conv_id", "n_turns").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("rendered"))
    lone = _lone(turns, rolled).select(F.lit(None).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.lit(1).cast("long").alias("n_turns"), render(F.col("role"), F.col("text")).alias("rendered"))
    return known.unionByName(lone)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every maximal conversation of the table, rendered; cases as in format_chats."""
    return format_chats(spark.read.parquet(os.path.join(sf_dir, "conversations.parquet")))


OP8_SQL = """
WITH t AS (SELECT conv_id, turn, role, text, md5(text) AS m, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
                  string_agg(coalesce(role, '-') || ':' || coalesce(md5(text), '-'), ' ') OVER (w ROWS UNBOUNDED PRECEDING) AS prefix
           FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, md5(text))),
ends AS (SELECT min(conv_id) AS conv_id, prefix, any_value(n) AS n_turns FROM t WHERE pos = n GROUP BY prefix),
keep AS (SELECT conv_id, n_turns FROM ends WHERE prefix NOT IN (SELECT prefix FROM t WHERE pos < n))
SELECT t.conv_id, any_value(k.n_turns) AS n_turns,
       string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM t JOIN keep k ON t.conv_id = k.conv_id GROUP BY t.conv_id
"""
