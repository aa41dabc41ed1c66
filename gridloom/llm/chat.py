"""Chat formatting: logged snapshots that prefix a longer conversation go; what is left is rendered.

A conversation is logged again and again as it grows. Each turn gets a rolling hash of all turns up to it, of 128
bits: the running exclusive or of hashes of (position, role, text). A conversation whose last hash is the hash of an
earlier turn of another one is a prefix of it, and an anti-join drops it. Of equal conversations the smallest conv_id
stays; they are brought to one row by a grouping that sums up before it shuffles, so a hot conversation is cheap.

A conversation of any length is handled in blocks of turn numbers: running values are made within a block, and over
the few rows of block totals. Rendered text comes in parts of at most ``PART`` turns, so no group grows without
bound.

Defined results: order is by turn (null first), then role and text; rows repeated with conv_id, turn, role and text
count once; null role and text differ from empty ones in hashes and render as empty; a null conv_id is a conversation
of its own; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import cut, table

BLOCK = 1024  # turn numbers of a block
PART = 64  # turns of a rendered part


def _hash(seed: int, *values: Column) -> Column:
    return F.xxhash64(F.lit(seed), *[x for v in values for x in (v.isNull(), v)])


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, role, text, position, h1, h2): position from 0, and the hashes of turns 0 to position."""
    own = turns.select(F.col("`conv_id`").cast("long").alias("conv_id"), F.col("`turn`").cast("long").alias("turn"), F.col("`role`").cast("string").alias("role"), F.col("`text`").cast("string").alias("text")).distinct()
    own = own.withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(0)) / BLOCK))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    block = Window.partitionBy("conv_id", "block").orderBy(*order)
    numbered = own.withColumn("n", F.row_number().over(block) - 1)
    # Where a block begins: turns of the blocks before it.
    sizes = numbered.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("size"))
    blocks = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("size").over(blocks), F.lit(0))).select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "start")
    placed = numbered.join(starts, numbered["conv_id"].eqNullSafe(starts["_c"]) & (F.col("block") == F.col("_b"))).drop("_c", "_b")
    placed = placed.withColumn("position", F.col("start") + F.col("n"))
    hashed = placed.withColumns({f"t{s}": _hash(s, F.col("position"), F.col("role"), F.col("text")) for s in (1, 2)})
    totals = hashed.groupBy("conv_id", "block").agg(*[F.bit_xor(f"t{s}").alias(f"x{s}") for s in (1, 2)])
    carried = totals.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), *[F.coalesce(F.bit_xor(f"x{s}").over(blocks), F.lit(0)).alias(f"c{s}") for s in (1, 2)])
    rolling = Window.partitionBy("conv_id", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed.withColumns({f"r{s}": F.bit_xor(f"t{s}").over(rolling) for s in (1, 2)})
    rolled = rolled.join(carried, rolled["conv_id"].eqNullSafe(carried["_c"]) & (F.col("block") == F.col("_b")))
    return rolled.select("conv_id", "role", "text", "position", *[F.col(f"r{s}").bitwiseXOR(F.col(f"c{s}")).alias(f"h{s}") for s in (1, 2)])


def maximal(rolled: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal): conversations that are no prefix of another; of equal ones the first."""
    ends = rolled.groupBy("conv_id").agg((F.max("position") + 1).alias("n_turns"), F.max_by(F.struct("h1", "h2"), "position").alias("last"))
    # A null conv_id sorts before all others and so is the first of its equals.
    first = ends.groupBy("n_turns", "last").agg(F.min(F.struct(F.col("conv_id").isNotNull().alias("known"), "conv_id")).alias("first"), F.count(F.lit(1)).alias("n_equal"))
    inner = rolled.join(ends.select(F.col("conv_id").alias("_c"), F.col("n_turns").alias("_n")), rolled["conv_id"].eqNullSafe(F.col("_c"))).where(F.col("position") + 1 < F.col("_n"))
    seen = inner.select((F.col("position") + 1).alias("n_turns"), F.struct("h1", "h2").alias("last")).distinct()
    return first.join(seen, ["n_turns", "last"], "left_anti").select(F.col("first")["conv_id"].alias("conv_id"), "n_turns", "n_equal")


def render(rolled: DataFrame, kept: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, n_equal, rendered): ChatML text of the conversations kept, in parts of PART turns."""
    keep = kept.select(F.col("conv_id").alias("_c"), "n_turns", "n_equal")
    turns = rolled.join(keep, rolled["conv_id"].eqNullSafe(F.col("_c")))
    said = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    parts = turns.groupBy("conv_id", F.floor(F.col("position") / PART).alias("part"), "n_turns", "n_equal").agg(F.collect_list(F.struct("position", said.alias("said"))).alias("all"))
    return parts.select("conv_id", "part", "n_turns", "n_equal", F.array_join(F.transform(F.array_sort("all"), lambda x: x["said"]), "").alias("rendered"))


def collapse(turns: DataFrame) -> DataFrame:
    """Maximal conversations, rendered."""
    rolled = cut(prefixes(turns))
    return render(rolled, cut(maximal(rolled)))


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations collapsed and rendered."""
    return collapse(table(spark, sf_dir, "conversations"))


SQL = """
with t as (select distinct conv_id, turn, role, text from conversations),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) - 1 as position from t),
c as (select conv_id, count(*) as n_turns, list({'r': role, 't': text} order by position) as turns from n group by conv_id),
f as (select turns, n_turns, min(conv_id) as conv_id, count(*) as n_equal from c group by turns, n_turns),
p as (select distinct list({'r': role, 't': text}) over (partition by conv_id order by position) as turns from n
      qualify position + 1 < count(*) over (partition by conv_id)),
k as (select * from f where not exists (select 1 from p where p.turns = f.turns))
select k.conv_id, cast(position // 64 as bigint) as part, k.n_turns, k.n_equal,
  string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' order by position) as rendered
from k join n using (conv_id) group by all
"""
