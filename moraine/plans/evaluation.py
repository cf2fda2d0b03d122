"""Evaluation of scored predictions, splits, balance, bootstrap and conformal calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moraine.functions import quantiles as Q
from moraine.operators import evaluate
from moraine.plans.base import query, rounded
from moraine.tables import table

SCORED = """
scored as (
  select doc_id, lang, source, l.quality as truth, l.toxic, (n_chars % 101) / 100.0::double as p, (n_chars % 89) / 88.0::double as q, n_chars
  from labels l join documents d using (doc_id))"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and two deterministic scores of each labelled document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return rows.select("doc_id", "lang", "source", F.col("quality").alias("truth"), "toxic", ((F.col("n_chars") % 101) / 100.0).alias("p"), ((F.col("n_chars") % 89) / 88.0).alias("q"), "n_chars")


AUC = """
with {scored},
c as (select lang, p, count(*) filter (where truth = 1) as pos, count(*) filter (where truth <> 1) as neg from scored group by all),
w as (select *, coalesce(sum(neg) over (partition by lang order by p rows between unbounded preceding and 1 preceding), 0) as below from c)
select lang, round(case when sum(pos) * sum(neg) > 0 then sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) else 0.5 end, 9)::double as auc, sum(pos)::bigint as n_positive, sum(neg)::bigint as n_negative from w group by lang"""


@query(AUC.format(scored=SCORED))
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.roc_auc(scored(spark, sf_dir), ["lang"], "p", F.col("truth") == 1).withColumn("auc", rounded("auc", 9))


@query(
    f"""
with {SCORED}, c as (
  select count(*) filter (where truth = 1 and p >= 0.5) as tp, count(*) filter (where truth = 0 and p >= 0.5) as fp, count(*) filter (where truth = 1 and p < 0.5) as fn, count(*) filter (where truth = 0 and p < 0.5) as tn, lang from scored group by lang)
select lang, tp, fp, fn, tn, round(case when tp + fp > 0 then tp / (tp + fp)::double else 0 end, 9) as precision, round(case when tp + fn > 0 then tp / (tp + fn)::double else 0 end, 9) as recall,
  round(case when tp > 0 then 2 * tp / (2 * tp + fp + fn)::double else 0 end, 9) as f1 from c"""
)
def prf_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit, true = F.col("p") >= 0.5, F.col("truth") == 1
    counts = scored(spark, sf_dir).groupBy("lang").agg(F.count_if(true & hit).alias("tp"), F.count_if(~true & hit).alias("fp"), F.count_if(true & ~hit).alias("fn"), F.count_if(~true & ~hit).alias("tn"))
    return evaluate.precision_recall(counts).withColumns({c: rounded(c, 9) for c in ("precision", "recall", "f1")})


@query(
    f"""
with {SCORED}, b as (
  select case when p >= 9 * 0.1::double then 9 when p >= 8 * 0.1::double then 8 when p >= 7 * 0.1::double then 7 when p >= 6 * 0.1::double then 6 when p >= 5 * 0.1::double then 5 when p >= 4 * 0.1::double then 4
    when p >= 3 * 0.1::double then 3 when p >= 2 * 0.1::double then 2 when p >= 1 * 0.1::double then 1 else 0 end as bin, p, truth from scored)
select r.bin::int as bin, count(p) as n, round(coalesce(avg(p), 0), 9) as confidence, round(coalesce(avg(truth), 0), 9) as accuracy, round(coalesce(sum((p - truth) ** 2), 0), 6) as squares
from (select unnest(range(10)) as bin) r left join b on b.bin = r.bin group by r.bin"""
)
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.reliability(scored(spark, sf_dir), "p", F.col("truth") == 1)
    return out.withColumns({"confidence": rounded("confidence", 9), "accuracy": rounded("accuracy", 9), "squares": rounded("squares")})


BOOT = f"""
with {SCORED},
counts as (
  select source, count(*) filter (where truth = 1 and p >= 0.5) as atp, count(*) filter (where truth = 0 and p >= 0.5) as afp, count(*) filter (where truth = 1 and p < 0.5) as afn,
    count(*) filter (where truth = 1 and q >= 0.5) as btp, count(*) filter (where truth = 0 and q >= 0.5) as bfp, count(*) filter (where truth = 1 and q < 0.5) as bfn from scored group by source),
numbered as (select *, row_number() over (order by source) - 1 as g from counts),
draws as (
  select draw, ('0x' || substr(md5(draw || ':' || slot), 1, 8))::bigint % (select count(*) from counts) as g
  from (select unnest(range(500)) as draw) cross join (select g as slot from numbered)),
sums as (select draw, sum(atp) as atp, sum(afp) as afp, sum(afn) as afn, sum(btp) as btp, sum(bfp) as bfp, sum(bfn) as bfn from draws join numbered using (g) group by draw),
f as (select draw, case when atp > 0 then 2 * atp / (2 * atp + afp + afn)::double else 0 end as a, case when btp > 0 then 2 * btp / (2 * btp + bfp + bfn)::double else 0 end as b from sums)"""


def _draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    true = F.col("truth") == 1
    counts = scored(spark, sf_dir).groupBy("source").agg(*[F.count_if(c).alias(n + k) for n, x in (("a", "p"), ("b", "q")) for k, c in (("tp", true & (F.col(x) >= 0.5)), ("fp", ~true & (F.col(x) >= 0.5)), ("fn", true & (F.col(x) < 0.5)))])
    numbered = counts.withColumn("g", F.row_number().over(Window.orderBy("source")).cast("long") - 1)  # one row a group of the evaluation
    return evaluate.bootstrap_f1(numbered, 500, {"a": ("atp", "afp", "afn"), "b": ("btp", "bfp", "bfn")})


@query(BOOT + " select round(quantile_cont(a, 0.025), 9) as low, round(quantile_cont(a, 0.975), 9) as high, count(*) as n from f")
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of F1 under resampling of whole groups."""
    return _draws(spark, sf_dir).where("name = 'a'").agg(rounded(Q.linear("f1", 0.025), 9).alias("low"), rounded(Q.linear("f1", 0.975), 9).alias("high"), F.count("*").alias("n"))


@query(BOOT + " select round(quantile_cont(b - a, 0.025), 9) as low, round(quantile_cont(b - a, 0.975), 9) as high, quantile_cont(b - a, 0.025) > 0 as promoted from f")
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same draws for both models; the second is promoted if the lower end is above 0."""
    d = _draws(spark, sf_dir).groupBy("draw").agg((F.max(F.when(F.col("name") == "b", F.col("f1"))) - F.max(F.when(F.col("name") == "a", F.col("f1")))).alias("d"))
    return d.agg(rounded(Q.linear("d", 0.025), 9).alias("low"), rounded(Q.linear("d", 0.975), 9).alias("high"), (Q.linear("d", 0.025) > 0).alias("promoted"))


@query(
    f"""
with {SCORED}, g as (select source, 2000 + min(doc_id) % 30 as year from scored group by source),
s as (select s.*, case when g.year < 2020 then 'train' when g.year < 2024 then 'val' else 'test' end as split from scored s join g using (source))
select split, truth, count(*) as n, count(distinct source) as n_groups from s group by all"""
)
def split_time_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole groups by year: the past trains, the future tests."""
    rows = scored(spark, sf_dir)
    year = rows.groupBy("source").agg((2000 + F.min("doc_id") % 30).alias("year"))
    split = F.when(F.col("year") < 2020, "train").when(F.col("year") < 2024, "val").otherwise("test")
    return rows.join(year, "source").withColumn("split", split).groupBy("split", "truth").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_groups"))


@query(
    f"""
with {SCORED}, g as (select lang as region, source, min(doc_id) as year, count(*) as n from scored group by all),
r as (select *, row_number() over (order by year desc, source desc, region desc) as k, count(*) over () as total from g where region <> 'fr')
select region, source, n, case when k <= greatest(1, round_even(0.2 * total, 0)) then 'val' else 'train' end as split from r
union all select region, source, n, 'test' from g where region = 'fr'"""
)
def split_leave_region_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One region is held out; the latest fifth of the other groups validates (half to even, one at least)."""
    groups = scored(spark, sf_dir).groupBy(F.col("lang").alias("region"), "source").agg(F.min("doc_id").alias("year"), F.count("*").alias("n"))
    rest = groups.where("region <> 'fr'")
    n_val = rest.agg(F.greatest(F.lit(1.0), F.bround(F.count("*") * F.lit(0.2), 0)).alias("n_val"))
    ranked = rest.withColumn("k", F.row_number().over(Window.orderBy(F.desc("year"), F.desc("source"), F.desc("region")))).crossJoin(F.broadcast(n_val))
    held = groups.where("region = 'fr'").withColumn("split", F.lit("test"))
    return ranked.withColumn("split", F.when(F.col("k") <= F.col("n_val"), "val").otherwise("train")).select("region", "source", "n", "split").unionByName(held.select("region", "source", "n", "split"))


@query(
    f"""
with {SCORED}, w as (select source as grp, doc_id, truth, n_chars // 500 as stations from scored),
quota as (select grp, min(stations) as quota, count(*) filter (where truth = 1) as n_pos from w group by grp),
orphan as (select count(*) as n from w join quota using (grp) where truth = 0 and n_pos = 0)
select w.grp, quota, count(*) as n, sum(least(stations, quota))::bigint as kept_stations, sum(stations)::bigint as stations, (select n from orphan) as n_orphans from w join quota using (grp) group by all"""
)
def group_quota_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every member of a group is cut to the fewest stations that any member has."""
    rows = scored(spark, sf_dir).select(F.col("source").alias("grp"), "doc_id", "truth", F.floor(F.col("n_chars") / 500).alias("stations"))
    quota = rows.groupBy("grp").agg(F.min("stations").alias("quota"), F.count_if(F.col("truth") == 1).alias("n_pos"))
    orphans = rows.where("truth = 0").join(quota.where("n_pos = 0"), "grp", "left_semi").agg(F.count("*").alias("n_orphans"))
    out = rows.join(quota, "grp").groupBy("grp", "quota").agg(F.count("*").alias("n"), F.sum(F.least("stations", "quota")).alias("kept_stations"), F.sum("stations").alias("stations"))
    return out.crossJoin(F.broadcast(orphans))


@query(f"with {SCORED} select truth, count(*) as n, round(sum(count(*)) over () / (2.0 * count(*)), 9)::double as weight from scored group by truth")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = scored(spark, sf_dir).groupBy("truth").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("truth", "n", rounded(F.col("total") / (2.0 * F.col("n")), 9).alias("weight"))


@query(f"with {SCORED} select lang, count(*) filter (where truth = 0) as n0, count(*) filter (where truth = 1) as n1, sha256(string_agg(distinct source, chr(10) order by source)) as group_hash from scored group by lang")
def cross_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moraine.functions.text import set_hash

    rows = scored(spark, sf_dir)
    tab = rows.groupBy("lang").pivot("truth", [0, 1]).count().na.fill(0).select("lang", F.col("0").alias("n0"), F.col("1").alias("n1"))
    return tab.join(rows.groupBy("lang").agg(set_hash(F.col("source")).alias("group_hash")), "lang")


@query(
    """
with r as (select l_returnflag as grp, l_extendedprice * 0.9 as low, l_extendedprice * 1.1 as high, l_extendedprice * (0.8 + l_discount * 4) as truth from lineitem),
s as (select *, greatest(low - truth, truth - high) as s from r),
k as (select grp, s, row_number() over (partition by grp order by s) as k, count(*) over (partition by grp) as n from s),
c as (select grp, n, s as c from k where k = least(n, ceil((n + 1) * 0.9::double)::bigint)),
a as (select s.grp, n, c, truth, low, high, low - c as l1, high + c as h1 from s join c using (grp)),
b as (select *, greatest(0, case when l1 > h1 then (l1 + h1) / 2 else l1 end) as l2, greatest(0, case when l1 > h1 then (l1 + h1) / 2 else h1 end) as h2 from a)
select grp, n, round(c, 4) as correction, round(avg((truth between low and high)::int), 6) as before, round(avg((truth between l2 and h2)::int), 6) as after, round(avg(h2 - l2), 3) as mean_width from b group by grp, n, c"""
)
def conformal_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval correction at level 0.9 for each class, with coverage before and after."""
    x = F.col("l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), (x * 0.9).alias("low"), (x * 1.1).alias("high"), (x * (0.8 + F.col("l_discount") * 4)).alias("truth"))
    out = evaluate.conformal(rows, ["grp"], 0.9)
    return out.select("grp", "n", rounded("correction", 4).alias("correction"), rounded("before").alias("before"), rounded("after").alias("after"), rounded("mean_width", 3).alias("mean_width"))


@query(
    f"""
with {SCORED}, s as (select *, case when toxic = 1 then 3 when truth = 0 then 1 else 0 end as severity from scored)
select source as suite, max(severity) as worst, case max(severity) when 0 then 0 when 3 then 3 else 1 end as exit_code,
  concat_ws(',', case when count(*) filter (where toxic = 1) > 0 then 'criterion unmet' end, case when count(*) filter (where truth = 0) > 0 then 'errors' end, case when count(*) < 20 then 'too few' end) as blockers
from s group by source"""
)
def suite_exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0, 1 for errors, 3 for an unmet criterion; all blockers are listed."""
    rows = scored(spark, sf_dir).withColumn("severity", F.when(F.col("toxic") == 1, 3).when(F.col("truth") == 0, 1).otherwise(0))
    worst = F.max("severity")
    blockers = F.concat_ws(",", F.when(F.count_if(F.col("toxic") == 1) > 0, "criterion unmet"), F.when(F.count_if(F.col("truth") == 0) > 0, "errors"), F.when(F.count("*") < 20, "too few"))
    return rows.groupBy(F.col("source").alias("suite")).agg(worst.alias("worst"), F.when(worst == 0, 0).when(worst == 3, 3).otherwise(1).alias("exit_code"), blockers.alias("blockers"))
