"""Chat formatting after collapsing cumulative snapshots of conversations.

A chat log often holds a conversation again after each turn. Turns are numbered, and each prefix of a
conversation has a rolling hash: the exclusive-or, so far, of hashes that bind a turn's place, role and
text. A conversation whose whole hash is a shorter prefix of another one is a snapshot of it; an
anti-join leaves the maximal ones, of equal ones that with the smallest id, and those are rendered.
Expressions of Spark alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import need

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turns_with_prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` with ``place`` (from 1), the two halves ``h1``, ``h2`` of the prefix's hash, and ``n_turns`` in all."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.withColumn("place", F.row_number().over(order))
    bound = [F.col("place"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    return (
        placed.withColumn("t1", F.xxhash64(*bound)).withColumn("t2", F.xxhash64(F.lit("second"), *bound))
        .withColumn("h1", F.bit_xor("t1").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("h2", F.bit_xor("t2").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("n_turns", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
        .drop("t1", "t2")
    )


def maximal(prefixes: DataFrame) -> DataFrame:
    """``conv_id``, ``n_turns`` of the conversations that no longer one begins with, one of equal ones."""
    whole = prefixes.where("place = n_turns")
    one = whole.groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    # prefixes that go on: a first turn that many conversations share is one row after combining
    begun = prefixes.where("place < n_turns").select("place", "h1", "h2").distinct()
    return one.join(begun, ["place", "h1", "h2"], "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def render(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv_id``, ``n_turns``, ``rendered`` of every maximal conversation.

    A turn is ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed; ``<|`` inside
    roles and texts becomes ``< |``, so that text can't close a turn. Turns are ordered by ``turn``, role
    and text, nulls first; repeated rows are turns of their own. A null role is rendered as ``unknown``
    and a null text as empty, but neither equals the string. Rows with a null id are in no conversation.
    A rendered conversation is one row, so its turns are gathered in one task; nothing else is.
    """
    rows = need(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv_id IS NOT NULL")
    prefixes = turns_with_prefixes(rows)
    kept = maximal(prefixes)
    plain = lambda c, instead: F.replace(F.coalesce(F.col(c), F.lit(instead)), F.lit("<|"), F.lit("< |"))
    turn = F.concat(F.lit(OPEN), plain("role", "unknown"), F.lit("\n"), plain("text", ""), F.lit(CLOSE + "\n"))
    return (
        prefixes.select("conv_id", "place", turn.alias("turn")).join(kept, "conv_id").groupBy("conv_id", "n_turns")
        .agg(F.sort_array(F.collect_list(F.struct("place", "turn"))).alias("turns"))
        .select("conv_id", "n_turns", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("rendered"))
    )


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
         coalesce(length(role) || ':' || role, 'N') || ',' || coalesce(length(text) || ':' || text, 'N') || ';' AS part
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT conv_id, place, string_agg(part, '') OVER (PARTITION BY conv_id ORDER BY place) AS prefix,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM t),
w AS (SELECT min(conv_id) AS conv_id, prefix, n FROM p WHERE place = n GROUP BY prefix, n),
kept AS (SELECT conv_id, n FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.prefix = w.prefix AND p.place < p.n))
SELECT conv_id, n::INT AS n_turns,
       string_agg('<|im_start|>' || replace(coalesce(role, 'unknown'), '<|', '< |') || chr(10)
                  || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY place) AS rendered
FROM t JOIN kept USING (conv_id) GROUP BY conv_id, n
"""
