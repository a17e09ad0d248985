"""Chat formatting: cumulative snapshots of one conversation are collapsed to the longest, then rendered.

A turn is hashed together with its position, and the hash of a prefix is the running exclusive-or of its turns'
hashes, so a prefix's hash follows from that of the prefix before it. Of conversations with one whole hash the least
id stands for all; an anti-join then drops those whose whole hash is that of a shorter prefix of any conversation.
Both sides of it have each hash once, so a first turn or a conversation that most logs share is no load. Two hashes
of 64 bits each are kept. Runs of turns are blocks of ``BLOCK`` turn numbers, whose counts and hashes are summed up
before they are carried on, so that a conversation of any length is spread over many tasks and rendered in parts of
bounded size. Turns and their hashes are written once and read from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import Scratch

BLOCK = 256
#: Tasks that the blocks of one conversation are dealt over when they meet what is known of it.
SPREAD = 16
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _carried(turns: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """``turns`` with, by name, the running exclusive total of the blocks before each turn's own."""
    blocks = turns.groupBy("conv_id", "block").agg(*[c.alias(f"__{n}") for n, c in totals.items()])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    run = {n: (F.sum if n == "base" else F.bit_xor)(f"__{n}").over(before) for n in totals}
    blocks = blocks.select("conv_id", "block", *[F.coalesce(c, F.lit(0).cast("long")).alias(n) for n, c in run.items()])
    return turns.join(blocks.hint("merge"), ["conv_id", "block"])


def prefixes(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct turns (conv_id, block, turn, role, text) with ``n``, the turns up to here, and the hashes ``h1``, ``h2`` of these."""
    turns = conversations.where("conv_id is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").dropDuplicates()
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / F.lit(block)), F.lit(-(1 << 62))).cast("long"))
    order = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    turns = _carried(turns, {"base": F.count("*")})
    turns = turns.withColumn("n", F.col("base") + F.row_number().over(order)).drop("base")
    parts = ["n", F.isnull("role"), "role", F.isnull("text"), "text"]
    turns = turns.withColumn("t1", F.xxhash64(*parts)).withColumn("t2", F.xxhash64(F.lit(17), *parts))
    turns = _carried(turns, {"b1": F.bit_xor("t1"), "b2": F.bit_xor("t2")})
    up_to = Window.partitionBy("conv_id", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    for k in "12":
        turns = turns.withColumn(f"h{k}", F.col(f"b{k}").bitwiseXOR(F.bit_xor(f"t{k}").over(up_to)))
    return turns.drop("t1", "t2", "b1", "b2")


def _of_conversation(turns: DataFrame, about: DataFrame) -> DataFrame:
    """``turns`` with what ``about`` has of their conversation, which has a row there."""
    turns = turns.withColumn("part", F.pmod(F.col("block"), F.lit(SPREAD)).cast("int"))
    about = about.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return turns.join(about.hint("merge"), ["conv_id", "part"]).drop("part")


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of conversations that prefix no other; of equal ones the least conv_id stays."""
    length = turns.groupBy("conv_id").agg(F.max("n").alias("n_turns"))
    marked = _of_conversation(turns.select("conv_id", "block", "n", "h1", "h2"), length)
    whole = marked.where("n = n_turns").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    shorter = marked.where("n < n_turns").select(F.col("n").alias("__n"), F.col("h1").alias("__h1"), F.col("h2").alias("__h2")).distinct()
    same = (F.col("n") == F.col("__n")) & (F.col("h1") == F.col("__h1")) & (F.col("h2") == F.col("__h2"))
    return whole.join(shorter.hint("merge"), same, "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def render(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Maximal conversations as text: conv_id, n_turns, part, text; the parts of one, in order, make up the whole.

    A conversation is its distinct rows by turn, then role, then text, null first. Rows without conv_id take no
    part; null roles and texts are rendered as empty but differ from empty ones when prefixes are compared. Columns
    other than conv_id, turn, role and text are ignored; an empty table gives no rows. ``part`` counts from 1; only
    conversations that span more than ``block`` turn numbers have several.
    """
    turns = Scratch(conversations.sparkSession).table(prefixes(conversations, block), "turns")
    kept = _of_conversation(turns, maximal(turns))
    said = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE + "\n"))
    parts = kept.groupBy("conv_id", "n_turns", "block").agg(F.sort_array(F.collect_list(F.struct("n", said.alias("s")))).alias("said"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("block")).cast("long")
    return parts.select("conv_id", "n_turns", number.alias("part"), F.array_join("said.s", "").alias("text"))
