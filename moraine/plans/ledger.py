"""Ledger queries: latest rows, overlap, coverage matrix, dangling references, staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.operators import ledger
from moraine.plans.base import DAY_US, micros, query
from moraine.tables import table


def _days(column: str):
    return F.floor(micros(column) / DAY_US).cast("long")


def _latest(rule: str) -> str:
    order = {"first": "day desc, entry_id", "last": "day desc, entry_id desc", "file": "entry_id desc"}[rule]
    return f"""
with ledger as (select o_orderkey as entry_id, o_orderpriority as source, o_custkey as product, (epoch_us(o_orderdate) // 86400000000)::bigint as day, o_orderstatus as status from orders)
select source, product, entry_id, day, status from (select *, row_number() over (partition by source, product order by {order}) as r from ledger) where r = 1"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("entry_id"), F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("product"), _days("o_orderdate").alias("day"), F.col("o_orderstatus").alias("status")
    )


KEYS = ["source", "product"]


@query(_latest("first"))
def ledger_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest(entries(spark, sf_dir), KEYS, F.col("day"), "entry_id", "first")


@query(_latest("last"))
def ledger_latest_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest(entries(spark, sf_dir), KEYS, F.col("day"), "entry_id", "last")


@query(_latest("file"))
def ledger_latest_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest(entries(spark, sf_dir), KEYS, None, "entry_id")


@query(
    """
select o_orderkey as entry_id, o_orderpriority as source, l_linenumber as part, count(*) as n
from orders join lineitem on o_orderkey = l_orderkey
where o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH')
  and l_shipdate >= timestamp '1997-03-01' and o_orderdate <= timestamp '1997-04-01' group by all"""
)
def ledger_query_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional equality filters and a closed window; rows with a null end don't meet it."""
    low, high = F.lit("1997-03-01").cast("timestamp_ntz"), F.lit("1997-04-01").cast("timestamp_ntz")
    orders = table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderdate") <= high))
    items = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= low)
    rows = orders.join(items, orders["o_orderkey"] == items["l_orderkey"]).where(ledger.overlaps(F.col("o_orderdate"), F.col("l_shipdate"), low, high))
    return rows.groupBy(F.col("o_orderkey").alias("entry_id"), F.col("o_orderpriority").alias("source"), F.col("l_linenumber").alias("part")).agg(F.count("*").alias("n"))


@query(
    """
select l_returnflag as status, count(*) as n from lineitem
where (case when l_quantity > 48 then null else l_shipdate + to_days(l_quantity::int) end is null or l_shipdate + to_days(l_quantity::int) >= timestamp '1999-06-01')
  and (case when l_discount = 0 then null else l_shipdate end is null or l_shipdate <= timestamp '1999-06-10') group by 1"""
)
def instrument_gap_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap where a null end is unbounded."""
    start = F.when(F.col("l_discount") != 0, _days("l_shipdate"))
    end = F.when(F.col("l_quantity") <= 48, _days("l_shipdate") + F.col("l_quantity").cast("long"))
    low, high = (F.datediff(F.lit(d).cast("date"), F.lit("1970-01-01").cast("date")) for d in ("1999-06-01", "1999-06-10"))
    rows = table(spark, sf_dir, "lineitem").where(ledger.overlaps(start, end, low, high, unbounded=True))
    return rows.groupBy(F.col("l_returnflag").alias("status")).agg(F.count("*").alias("n"))


@query(
    """
with entries as (
  select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) as entry_id, l_suppkey as event_id, l_partkey % 25 as aoi_id,
    l_linestatus as col, l_returnflag as status, case when l_quantity <= 48 then (epoch_us(l_shipdate) // 86400000000)::bigint end as a,
    case when l_quantity <= 48 then (epoch_us(l_shipdate) // 86400000000)::bigint + l_quantity::bigint end as b from lineitem),
records as (select s_suppkey as record_id, s_suppkey as event_id, s_nationkey as aoi_id, 10000 + s_suppkey % 1000 as d from supplier),
wins(win, lo, hi, lc, rc) as (values ('pre', -90, 0, true, false), ('event', -1, 1, true, true), ('post', 0, 90, false, true)),
cols(col, since) as (values ('O', 0), ('F', 10050)),
hits as (
  select record_id, col, win, status, case status when 'A' then 0 when 'R' then 1 else 2 end as rk
  from records r join entries e on r.event_id = e.event_id or r.aoi_id = e.aoi_id cross join wins w
  where case when a is null then r.event_id = e.event_id
    else (case when lc then b >= d + lo else b > d + lo end) and (case when rc then a <= d + hi else a < d + hi end) end)
select r.record_id, c.col as "column", w.win as "window", case when d + hi < since then 'n/a' else coalesce(arg_min(h.status, h.rk), 'none') end as status, count(h.rk) as n
from records r cross join cols c cross join wins w left join hits h on h.record_id = r.record_id and h.col = c.col and h.win = w.win
group by r.record_id, c.col, w.win, d, hi, since"""
)
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best status and count of each record, column and window."""
    dated = F.col("l_quantity") <= 48
    first = F.when(dated, _days("l_shipdate"))
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("event_id"), (F.col("l_partkey") % 25).cast("int").alias("aoi_id"), F.col("l_linestatus").alias("column"), F.col("l_returnflag").alias("status"),
        first.alias("first_day"), (first + F.col("l_quantity").cast("long")).alias("last_day"),
    )
    records = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("record_id"), F.col("s_suppkey").alias("event_id"), F.col("s_nationkey").alias("aoi_id"), (10000 + F.col("s_suppkey") % 1000).alias("day"))
    return ledger.coverage(records, rows, ["O", "F"], {"O": 0, "F": 10050}, {"A": 0, "R": 1, "N": 2})


@query(
    """
select source, count(*) as n_docs, count(*) filter (where not exists (select 1 from labels l where l.doc_id = d.doc_id)) as n_unlabelled,
  (select count(*) from labels l where not exists (select 1 from documents d2 where d2.doc_id = l.doc_id)) as n_orphans from documents d group by source"""
)
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without their row, both ways, by anti-joins."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id")
    missing = docs.join(labels, "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("n_unlabelled"))
    orphans = labels.join(docs, "doc_id", "left_anti").agg(F.count("*").alias("n_orphans"))
    totals = docs.groupBy("source").agg(F.count("*").alias("n_docs")).join(missing, "source", "left").crossJoin(orphans)
    return totals.select("source", "n_docs", F.coalesce("n_unlabelled", F.lit(0)).cast("long").alias("n_unlabelled"), "n_orphans")


@query(
    """
with a as (select doc_id, md5(coalesce(text, '')) as h from documents),
b as (select case when doc_id % 5 = 2 then -doc_id else doc_id end as doc_id, case when doc_id % 11 = 5 then 'stale' else md5(coalesce(text, '')) end as h from documents)
select coalesce(a.doc_id, b.doc_id) as doc_id, case when b.doc_id is null then 'removed' when a.doc_id is null then 'added' else 'changed' end as kind
from a full join b on a.doc_id = b.doc_id where a.h is distinct from b.h"""
)
def index_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by which two hash indexes differ."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    a = docs
    b = docs.withColumn("doc_id", F.when(F.col("doc_id") % 5 == 2, -F.col("doc_id")).otherwise(F.col("doc_id"))).withColumn("h", F.when(F.abs("doc_id") % 11 == 5, "stale").otherwise(F.col("h")))
    return ledger.key_diff(a, b, "doc_id", "h")


@query(
    """
with e as (select user_id as pass_id, event_type as burst from events)
select pass_id, count(*) as n_granules, count(distinct burst) as n_bursts from e group by pass_id having count(distinct burst) filter (where burst in ('click', 'error', 'purchase', 'signup', 'view')) = 5"""
)
def complete_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relational division: passes that hold every required burst."""
    need = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("pass_id")).agg(F.count("*").alias("n_granules"), F.collect_set("event_type").alias("held"))
    return rows.where(F.size(F.array_except(need, "held")) == 0).select("pass_id", "n_granules", F.size("held").cast("long").alias("n_bursts"))
