"""Chat formatting with cumulative-snapshot collapse. DataFrame functions only.

A log often holds a conversation once after every turn, each record the last one and a turn
more. Each turn is hashed with its place, and the exclusive-or of all up to a turn is the hash
of that prefix (128 bits from two hashes). The hash of a whole conversation that is also the
hash of a proper prefix of another marks a snapshot: an anti-join keeps maximal ones. Of equal
conversations the one with the smallest conv_id stays. What is left is rendered.

Places and prefixes come from windows over stretches of 256 turns and one row for each stretch,
so a conversation with a third of all rows is spread over tasks; only its rendered text, one
value of the result, is put together in one row. Equal prefixes are counted with partial
aggregation before any join, so a first turn that a third of all conversations share is one row.

Nulls, ties and odd inputs: turns go by turn, role, text with nulls first; rows that repeat all
of these count once; a null conv_id is a conversation of its own, a null role or text is empty
(and equal to an empty one only in what is rendered). An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 256


def _neutral(x: Column) -> Column:
    """Text in which no control mark of the template can stand."""
    return F.replace(x, F.lit("<|"), F.lit("< |"))


def render(role: Column, text: Column) -> Column:
    empty = F.lit("")
    return F.concat(F.lit("<|im_start|>"), _neutral(F.coalesce(role, empty)), F.lit("\n"), _neutral(F.coalesce(text, empty)), F.lit("<|im_end|>\n"))


def _running(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Running aggregates within each conversation: within stretches, then over the stretches before."""
    inside = Window.partitionBy("c", "stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("c").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("c", "stretch").agg(*[x.alias(f"_{k}") for k, x in sums.items()])
    again = {"n": lambda x: F.sum(x), "x1": lambda x: F.bit_xor(x), "x2": lambda x: F.bit_xor(x)}
    starts = totals.select("c", "stretch", *[F.coalesce(again[k](f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums])
    joined = rows.withColumns({k: x.over(inside) for k, x in sums.items()}).join(starts, ["c", "stretch"])
    return joined.withColumns({k: F.col(k) + F.col(f"_{k}") if k == "n" else F.col(k).bitwiseXOR(F.col(f"_{k}")) for k in sums}).drop(*[f"_{k}" for k in sums])


def turns(conversations: DataFrame) -> DataFrame:
    """Each different turn with its place n from 1, its hashes and those of the prefix that it ends."""
    rows = conversations.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("c"),
        "conv_id", "turn", F.lower(F.trim("role")).alias("role"), "text", F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(1 << 60))).alias("stretch"),
    )
    order = ["turn", "role", "text"]
    last = Window.partitionBy("c", "stretch").orderBy(*order)
    again = F.lit(True)
    for x in order:
        again = again & F.lag(x).over(last).eqNullSafe(F.col(x))
    first = F.row_number().over(last) == 1
    fresh = rows.withColumn("fresh", first | ~again).where("fresh").drop("fresh")
    placed = _running(fresh, order, {"n": F.count(F.lit(1))})
    nulls = F.concat(F.col("role").isNull().cast("string"), F.col("text").isNull().cast("string"))
    hashed = placed.withColumns({"h1": F.xxhash64("n", "role", "text", nulls), "h2": F.xxhash64(nulls, "text", F.lit("|"), "role", "n")})
    return _running(hashed, ["n"], {"x1": F.bit_xor("h1"), "x2": F.bit_xor("h2")})


def maximal(turned: DataFrame) -> DataFrame:
    """(c, conv_id, n_turns, n_copies) of conversations that no longer one begins with."""
    whole = turned.groupBy("c").agg(F.max(F.struct("n", "x1", "x2")).alias("w"), F.max("conv_id").alias("conv_id"))
    ends = whole.groupBy("w.n", "w.x1", "w.x2").agg(F.min(F.struct("conv_id", "c")).alias("keep"), F.count("*").alias("n_copies"))
    proper = turned.where("n > 1").select((F.col("n") - 1).alias("n"), F.col("x1").bitwiseXOR(F.col("h1")).alias("x1"), F.col("x2").bitwiseXOR(F.col("h2")).alias("x2")).distinct()
    return ends.join(proper, ["n", "x1", "x2"], "left_anti").select("keep.c", "keep.conv_id", F.col("n").alias("n_turns"), "n_copies")


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and rendered text of each maximal conversation."""
    turned = turns(conversations)
    kept = maximal(turned)
    pieces = turned.select("c", "n", render(F.col("role"), F.col("text")).alias("piece")).join(kept, "c")
    whole = pieces.groupBy("c", "conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("n", "piece"))).alias("p"))
    return whole.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("rendered"))


#: DuckDB: the same by comparing whole lists of turns.
ORACLE = r"""
with rows as (
  select distinct conv_id, turn, lower(trim(role)) as role, text from conversations),
prefixes as (
  select conv_id, row_number() over w as n, list({'r': role, 't': text}) over w as p,
         lead(1) over (partition by conv_id order by turn, role, text) as more
  from rows window w as (partition by conv_id order by turn, role, text rows between unbounded preceding and current row)),
ends as (
  select min(conv_id) as conv_id, n, p, count(*) as n_copies from prefixes where more is null group by n, p)
select conv_id, n as n_turns, n_copies,
  array_to_string(list_transform(p, lambda x: '<|im_start|>' || replace(coalesce(x.r, ''), '<|', '< |') || chr(10) || replace(coalesce(x.t, ''), '<|', '< |') || '<|im_end|>' || chr(10)), '') as rendered
from ends where not exists (select 1 from prefixes q where q.more = 1 and q.n = ends.n and q.p = ends.p)
"""
