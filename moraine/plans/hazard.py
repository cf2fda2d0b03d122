"""Ensembles, corridors, losses, breaches and terrain geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions import geo, hazard
from moraine.functions import quantiles as Q
from moraine.operators import ensemble
from moraine.plans.base import query, rounded
from moraine.tables import table

CELLS = """
cells as (
  select l_orderkey % 230 as run, (l_partkey % 200) * 50.0::double as chainage, case when l_quantity > 10 then l_quantity - 10 else 0 end::double as depth, l_discount * 100 as speed,
    (l_partkey % 200) * 1.5::double + l_quantity as arrival, 3000 - (l_partkey % 200) * 4.0::double + l_suppkey % 60 as bed, l_suppkey % 7 as transect, l_extendedprice as price from lineitem),
profile as (
  select run, least(39, floor(chainage / 250.0))::int as bin, max(depth) as max_depth, max(speed) as max_speed, min(arrival) filter (where depth > 0) as arrival, count(*) filter (where depth > 0) as n_wet, min(bed) as min_bed from cells group by all)"""
TRANSECTS = [(1, 1000.0), (2, 4100.0), (3, 9990.0)]


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, q = F.col("l_partkey") % 200, F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 230).alias("run"), (k * F.lit(50.0)).alias("chainage"), F.when(q > 10, q - 10).otherwise(0.0).alias("depth"), (F.col("l_discount") * 100).alias("speed"),
        (k * F.lit(1.5) + q).alias("arrival"), (3000 - k * F.lit(4.0) + F.col("l_suppkey") % 60).alias("bed"), (F.col("l_suppkey") % 7).alias("transect"),
    )


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.corridor(cells(spark, sf_dir), ["run"], "chainage", 10_000.0, 40)


@query(f"with {CELLS} select r.run, b.bin::int as bin, max_depth, round(max_speed, 6) as max_speed, arrival, coalesce(n_wet, 0) as n_wet, min_bed from (select distinct run from cells) r cross join (select unnest(range(40)) as bin) b left join profile p on p.run = r.run and p.bin = b.bin")
def corridor_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = cells(spark, sf_dir)
    out = ensemble.every_bin(profile(spark, sf_dir), source, ["run"], 40)
    return out.select("run", "bin", "max_depth", rounded("max_speed").alias("max_speed"), "arrival", "n_wet", "min_bed")


NEAREST = f"""
with {CELLS}, t(transect, place) as (values (1, 1000.0::double), (2, 4100.0::double), (3, 9990.0::double)),
hit as (select run, transect, arg_min(coalesce(arrival, -1), (abs((bin + 0.5) * 250.0 - place), bin)) as a from profile cross join t group by all),
arr as (select run, transect, case when a >= 0 then a end as arrival from hit)"""


@query(NEAREST + " select run, transect, arrival from arr")
def transect_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.nearest_bin(profile(spark, sf_dir), TRANSECTS, ["run"], 10_000.0, 40).select("run", "transect", "arrival")


@query(NEAREST + " select transect, count(*) as n, count(arrival) as n_reach, round(count(arrival) / count(*)::double, 6) as reach, round(quantile_cont(arrival, 0.05), 6) as p5, round(quantile_cont(arrival, 0.5), 6) as p50, round(quantile_cont(arrival, 0.95), 6) as p95 from arr group by transect")
def ensemble_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    arr = transect_nearest(spark, sf_dir)
    return arr.groupBy("transect").agg(F.count("*").alias("n"), F.count("arrival").alias("n_reach"), rounded(F.count("arrival") / F.count("*")).alias("reach"), *[rounded(Q.linear("arrival", q)).alias(n) for n, q in (("p5", 0.05), ("p50", 0.5), ("p95", 0.95))])


GAPS = NEAREST + """,
t2 as (select r_regionkey as transect, 40.0::double + 20 * r_regionkey as low, case when r_regionkey % 2 = 0 then 70.0::double + 20 * r_regionkey else 40.0::double + 20 * r_regionkey end as high from region where r_regionkey in (1, 2)),
g as (select run, transect, round(case when arrival < low then arrival - low when arrival > high then arrival - high when arrival >= low then 0 end, 2) as gap from arr left join t2 using (transect))"""


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes between each member's arrival and the recorded interval, where one is recorded."""
    k = F.col("r_regionkey")
    low = 40 + 20 * k.cast("double")
    targets = table(spark, sf_dir, "region").where(k.isin(1, 2)).select(k.alias("transect"), low.alias("low"), F.when(k % 2 == 0, low + 30).otherwise(low).alias("high"))
    return ensemble.mismatches(transect_nearest(spark, sf_dir), targets)


@query(GAPS + ", p as (select run, count(gap) as reached, round(avg(abs(gap)), 3) as mean_gap from g group by run) select run, reached, mean_gap from p where reached > 0 order by reached desc, mean_gap, run limit 1")
def closest_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.closest_member(_gaps(spark, sf_dir), "run")


@query(GAPS + " select transect, count(gap) as n, min(gap) as least, round(quantile_cont(gap, 0.25), 2) as p25, round(quantile_cont(gap, 0.5), 2) as median, round(quantile_cont(gap, 0.75), 2) as p75, max(gap) as most, min(abs(gap)) as closest from g where gap is not null group by transect")
def mismatch_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of the gaps at each transect with a recorded arrival."""
    part = [rounded(Q.linear("gap", q), 2).alias(n) for n, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))]
    rows = _gaps(spark, sf_dir).where("gap is not null").groupBy("transect")
    return rows.agg(F.count("gap").alias("n"), F.min("gap").alias("least"), *part, F.max("gap").alias("most"), F.min(F.abs("gap")).alias("closest"))


@query(
    """
with i as (select l_orderkey % 500 as member, l_orderkey * 10 + l_linenumber as place, l_partkey as part, l_suppkey as supp, l_extendedprice as price, l_discount * 1e-5::double as balance, l_quantity / 20000 as repaired, l_extendedprice / 1000 as release, l_tax / 50 as shortfall, case when l_partkey % 40 = 0 then 1 else 0 end as floor_steps, l_suppkey * 100.0::double as reach, l_quantity as wall,
    case when l_shipdate is not null and l_partkey % 5 = 0 then ['time limit ' || l_linenumber || ' s reached (moving)', 'mass 3.5 short'] when l_partkey % 7 = 0 then ['time limit 9 s reached (moving)'] else [] end as reasons, 30 * (1 + l_partkey % 3) as resolution from lineitem),
l as (select *, abs(balance) <= 1e-6 and repaired <= 1e-3 * greatest(release, 1) and shortfall <= 1e-3 and floor_steps = 0 as valid from (select *, row_number() over (partition by member order by place desc, part desc, supp desc, price desc) as r from i) where r = 1)
select count(*) as n_members, count(*) filter (where valid) as n_valid, count(*) filter (where not valid) as n_invalid, count(*) filter (where valid and len(reasons) > 0) as n_flagged_kept,
  round(quantile_cont(reach, 0.05) filter (where valid), 2) as reach_p5, round(quantile_cont(reach, 0.25) filter (where valid), 2) as reach_p25, round(quantile_cont(reach, 0.5) filter (where valid), 2) as reach_p50, round(quantile_cont(reach, 0.75) filter (where valid), 2) as reach_p75, round(quantile_cont(reach, 0.95) filter (where valid), 2) as reach_p95,
  max(reach) filter (where valid) as reach_max, min(reach) filter (where valid) as reach_min, round(sum(wall), 1) as wall_total from l"""
)
def ensemble_index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each member, which members are valid or flagged and kept, and how far the valid ones reach."""
    return ensemble.index_summary(ensemble.latest_members(_member_index(spark, sf_dir), "member", "place"))


@query(
    """
with i as (select l_orderkey % 500 as member, l_orderkey * 10 + l_linenumber as place, l_partkey as part, l_suppkey as supp, l_extendedprice as price, case when l_partkey % 5 = 0 then ['time limit ' || l_linenumber || ' s reached (moving)', 'mass 3.5 short'] when l_partkey % 7 = 0 then ['time limit 9 s reached (moving)'] else [] end as reasons from lineitem),
l as (select unnest(reasons) as reason from (select *, row_number() over (partition by member order by place desc, part desc, supp desc, price desc) as r from i) where r = 1)
select trim(split_part(regexp_replace(reason, '-?\\d+(?:\\.\\d+)?', 'N', 'g'), '(', 1)) as reason, count(*) as n from l group by 1"""
)
def ensemble_flag_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    from moraine.functions.text import normalised_reason

    latest = ensemble.latest_members(_member_index(spark, sf_dir), "member", "place")
    return latest.select(F.explode("reasons").alias("reason")).groupBy(normalised_reason(F.col("reason")).alias("reason")).agg(F.count("*").alias("n"))


def _member_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    reasons = F.when(k % 5 == 0, F.array(F.concat(F.lit("time limit "), F.col("l_linenumber"), F.lit(" s reached (moving)")), F.lit("mass 3.5 short"))).when(k % 7 == 0, F.array(F.lit("time limit 9 s reached (moving)"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 500).alias("member"), F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_partkey", "l_suppkey", "l_extendedprice").alias("place"), (F.col("l_discount") * 1e-5).alias("balance_error"), (F.col("l_quantity") / 20000).alias("repaired"), (F.col("l_extendedprice") / 1000).alias("release"),
        (F.col("l_tax") / 50).alias("shortfall"), F.when(k % 40 == 0, 1).otherwise(0).alias("floor_steps"), (F.col("l_suppkey") * F.lit(100.0)).alias("reach"), F.col("l_quantity").alias("wall"), reasons.alias("reasons"), F.lit(1.0).alias("max_depth"),
    )


@query(f"with {CELLS}, s as (select run, case when max(depth) >= 40 then 'depth 40 reached (run)' when sum(depth) < 4000 then 'mass 3.5 short' else null end as reason, sum(depth) as volume from cells group by run) select coalesce(trim(regexp_replace(split_part(reason, '(', 1), '-?\\d+(?:\\.\\d+)?', 'N', 'g')), 'valid') as reason, count(*) as n, round(sum(volume), 3) as volume, round(quantile_cont(volume, 0.5), 6) as median_volume from s group by 1")
def ensemble_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members by normalised reason, with sums and medians."""
    from moraine.functions.text import normalised_reason

    per = cells(spark, sf_dir).groupBy("run").agg(F.max("depth").alias("deep"), F.sum("depth").alias("volume"))
    reason = F.when(F.col("deep") >= 40, "depth 40 reached (run)").when(F.col("volume") < 4000, "mass 3.5 short")
    return per.groupBy(F.coalesce(normalised_reason(reason), F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"), rounded(F.sum("volume"), 3).alias("volume"), rounded(Q.linear("volume", 0.5)).alias("median_volume"))


@query(f"with {CELLS}, a as (select bin, max_depth from profile where run = 3), b as (select bin, max_depth from profile where run = 4), j as (select coalesce(a.max_depth, 0) as a, coalesce(b.max_depth, 0) as b from a full join b using (bin)) select round(sum(abs(a - b)), 6) as l1, round(sum(abs(a - b)) / sum(a), 6) as relative_l1, round(count(*) filter (where a > 0 and b > 0) / count(*) filter (where a > 0 or b > 0)::double, 6) as iou from j")
def profile_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile(spark, sf_dir)
    out = ensemble.profile_gap(p.where("run = 3"), p.where("run = 4"), "max_depth")
    return out.select(*[rounded(c).alias(c) for c in ("l1", "relative_l1", "iou")])


LOSS = """
with x as (
  select l_orderkey % 50 as scenario, case when l_suppkey % 11 > 0 then s_nationkey end as transect, p_type as asset, case when l_tax > 0 then l_extendedprice end as price, case when l_linenumber < 7 then l_quantity / 10 end as depth, case when l_suppkey % 9 > 0 then l_partkey % 120 end::double as lead,
    case p_type when 'ECONOMY' then 1.5 when 'SMALL' then 2.5 else 4.0 end::double as d0
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey),
f as (
  select *, case when transect is null then 'no_transect' when lead is null then 'no_arrival' when depth is null then 'no_flow_depth' when price is null then 'no_replacement_value' end as reason, price * least(1, 1 - exp(-((depth / (d0 * 1.2)) ** 2))) as lo, price * least(1, 1 - exp(-((depth / (d0 * 0.8)) ** 2))) as hi,
    least(1, greatest(0, (lead - 10) / 50)) * 0.3 as s0, least(1, greatest(0, (lead - 10) / 50)) * 0.6 as s1 from x),
g as (select *, lo * (1 - s1) as loss_low, hi * (1 - s0) as loss_high from f)"""


def _losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax")
    part, supplier = table(spark, sf_dir, "part").select("p_partkey", "p_type"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = items.join(part, items["l_partkey"] == part["p_partkey"]).join(supplier, items["l_suppkey"] == supplier["s_suppkey"])
    depth, lead = F.when(F.col("l_linenumber") < 7, F.col("l_quantity") / 10), F.when(F.col("l_suppkey") % 9 > 0, F.col("l_partkey") % 120).cast("double")
    d0 = F.when(F.col("p_type") == "ECONOMY", 1.5).when(F.col("p_type") == "SMALL", 2.5).otherwise(4.0)
    rows = rows.select((F.col("l_orderkey") % 50).alias("scenario"), F.when(F.col("l_suppkey") % 11 > 0, F.col("s_nationkey")).alias("transect"), F.col("p_type").alias("asset"), F.when(F.col("l_tax") > 0, F.col("l_extendedprice")).alias("price"), depth.alias("depth"), lead.alias("lead"), d0.alias("d0"))
    damage = tuple(hazard.damage_fraction(F.col("depth"), F.col("d0") * k, F.lit(2.0)) for k in (1.2, 0.8))
    share = tuple(hazard.avoidable_share(F.col("lead"), 10.0, 60.0, most) for most in (0.3, 0.6))
    low, high, a, b = ensemble.loss_interval(F.col("price"), damage, share)
    reason = ensemble.block_reason(transect=F.col("transect"), arrival=F.col("lead"), flow_depth=F.col("depth"), replacement_value=F.col("price"))
    return rows.select("scenario", "transect", "asset", reason.alias("reason"), low.alias("loss_low"), high.alias("loss_high"), a.alias("avoided_low"), b.alias("avoided_high"))


@query(LOSS + " select asset, coalesce(reason, 'computed') as reason, count(*) as n, round(sum(case when reason is null then loss_low end), 1) as loss_low, round(sum(case when reason is null then loss_high end), 1) as loss_high from g group by all")
def avoided_loss_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What blocks each asset class's loss, and the interval sums of what is determined."""
    rows = _losses(spark, sf_dir)
    free = F.col("reason").isNull()
    return rows.groupBy("asset", F.coalesce("reason", F.lit("computed")).alias("reason")).agg(F.count("*").alias("n"), rounded(F.sum(F.when(free, F.col("loss_low"))), 1).alias("loss_low"), rounded(F.sum(F.when(free, F.col("loss_high"))), 1).alias("loss_high"))


@query(LOSS + ", h as (select *, lo - loss_high as a, hi - loss_low as b from g) select scenario, count(*) filter (where reason is null) as n_determined, count(*) filter (where reason is not null) as n_undetermined, round(sum(greatest(0, least(a, b))) filter (where reason is null), 1) as avoided_low, round(sum(greatest(0, greatest(a, b))) filter (where reason is null), 1) as avoided_high from h group by scenario")
def avoided_loss_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    free = F.col("reason").isNull()
    return _losses(spark, sf_dir).groupBy("scenario").agg(F.count_if(free).alias("n_determined"), F.count_if(~free).alias("n_undetermined"), *[rounded(F.sum(F.when(free, F.col(c))), 1).alias(c) for c in ("avoided_low", "avoided_high")])


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beds that narrow in places, with the deposit left in each bin; a bin in ten is unknown."""
    bed = F.when(F.col("bin") % 10 != 3, F.col("min_bed") - F.when(F.col("bin") % 7 == 0, 40.0).otherwise(0.0))
    return profile(spark, sf_dir).select("run", "bin", bed.alias("min_bed"), (F.col("max_depth") - F.col("bin") % 9 * 5).alias("deposit"))


@query()
def damming_breach_surge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrows of each member's corridor, and the breach of a dam there. Greedy suppression isn't SQL."""
    return ensemble.dam_break_chain(ensemble.constrictions(_sites(spark, sf_dir), ["run"], 250.0), F.lit(60.0), F.lit(9_000.0))


@query(
    f"""
with {CELLS}, p as (select run, bin, case when bin % 10 <> 3 then min_bed - case when bin % 7 = 0 then 40 else 0 end end as bed, max_depth - bin % 9 * 5 as deposit from profile),
z as (select *, coalesce(bed, max(bed) over (partition by run)) as z, count(bed) over (partition by run) as known from p),
d as (select *, (bin + 0.5) * 250.0::double as chainage, max(z) over (partition by run order by bin rows between 6 preceding and 6 following) - z as channel from z where known >= 5),
s as (select *, deposit / greatest(channel, 1e-6) as index, least(deposit, channel) as height from d where channel >= 5 and bed is not null and deposit > 0),
v as (select *, 0.5::double * height * height * 60 / 0.01::double as volume from s), q as (select *, 0.0026::double * (greatest(volume, 1) * greatest(height, 0.1)) ** 0.79::double as peak from v)
select run, bin, round(channel, 6) as channel_depth, round(index, 6) as index, round(index * 0.5, 6) as index_low, round(index * 1.5, 6) as index_high, height as dam_height, round(1 / (1 + exp(-(index - 1) / 0.4::double)), 6) as probability, round(volume, 3) as volume, round(peak, 4) as peak,
  round(2 * greatest(volume, 1) / greatest(peak, 1e-6) / 3, 4) as rise_s, round(2 * greatest(volume, 1) / greatest(peak, 1e-6), 4) as duration_s, round(case when 9000 - chainage > 0 then (9000 - chainage) / (1.5::double * sqrt(9.80665::double * greatest(height, 1))) end, 4) as surge_s from q"""
)
def dam_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same quantities of every bin that is deep enough, before any suppression."""
    sites = ensemble.constrictions(_sites(spark, sf_dir), ["run"], 250.0, sites=40, apart=0.0)
    out = ensemble.dam_break_chain(sites, F.lit(60.0), F.lit(9_000.0))
    return out.select("run", "bin", "dam_height", *[rounded(c).alias(c) for c in ("channel_depth", "index", "index_low", "index_high", "probability")], rounded("volume", 3).alias("volume"), *[rounded(c, 4).alias(c) for c in ("peak", "rise_s", "duration_s", "surge_s")])


@query(
    """
with p as (select p_partkey as id, 5 + p_size::double as slope, (p_partkey * 7 % 360)::double as aspect, 30 + (p_partkey % 15)::double as inc, case when p_partkey % 2 = 0 then 348.0 else 192.0 end::double as head from part),
u as (select *, sin(radians(inc)) * sin(radians(head - 90)) as e, sin(radians(inc)) * cos(radians(head - 90)) as n, cos(radians(inc)) as z from p)
select id, round(abs(e * cos(radians(slope)) * sin(radians(aspect)) + n * cos(radians(slope)) * cos(radians(aspect)) - z * sin(radians(slope))), 6) as sensitivity,
  round(degrees(acos(greatest(-1, least(1, e * sin(radians(slope)) * sin(radians(aspect)) + n * sin(radians(slope)) * cos(radians(aspect)) + z * cos(radians(slope)))))), 6) as incidence,
  degrees(atan(tan(radians(slope)) * cos(radians(aspect - (head - 90))))) >= inc as layover, degrees(atan(tan(radians(slope)) * cos(radians(aspect - (head - 90))))) <= inc - 90 as shadow from u"""
)
def los_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k.alias("id"), (5 + F.col("p_size").cast("double")).alias("slope"), (k * 7 % 360).cast("double").alias("aspect"), (30 + (k % 15).cast("double")).alias("inc"), F.when(k % 2 == 0, 348.0).otherwise(192.0).alias("head"))
    args = [F.col(c) for c in ("slope", "aspect", "inc", "head")]
    layover, shadow = geo.layover_shadow(*args)
    return p.select("id", rounded(geo.los_sensitivity(*args)).alias("sensitivity"), rounded(geo.local_incidence_deg(*args)).alias("incidence"), layover.alias("layover"), shadow.alias("shadow"))


GRID = "g as (select (p_partkey // 40)::int as r, (p_partkey % 40)::int as c, p_retailprice + (p_partkey * 31 % 97) as z from part)"


@query(
    f"""
with {GRID}, m as (select max(r) as mr from g),
n as (select a.r, a.c, d.dr, d.dc, b.z from g a cross join m cross join (select unnest([-1, 0, 1]) as dr) x(dr) cross join (select unnest([-1, 0, 1]) as dc) y(dc), lateral (select dr, dc) d, g b
  where b.r = greatest(0, least(mr, a.r + d.dr)) and b.c = greatest(0, least(39, a.c + d.dc))),
s as (select r, c, sum(dc * z * (2 - abs(dr))) / 80.0 as zx, sum(dr * z * (2 - abs(dc))) / 80.0 as zy from n group by all)
select r, c, round(degrees(atan(sqrt(zx * zx + zy * zy))), 5) as slope, round((degrees(atan2(-zx, zy)) + 360) % 360, 4) as aspect from s"""
)
def slope_aspect_stencil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope and aspect from the eight neighbours, edges repeated. Each cell is sent to its neighbours; nothing is looked up."""
    k = F.col("p_partkey")
    g = table(spark, sf_dir, "part").select(F.floor(k / 40).cast("int").alias("r"), (k % 40).cast("int").alias("c"), (F.col("p_retailprice") + k * 31 % 97).alias("z"))
    size = g.agg(F.max("r").alias("mr"))
    shifts = F.explode(F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    asked = g.select("r", "c").crossJoin(F.broadcast(size)).withColumn("d", shifts).select("r", "c", "d.*", F.greatest(F.lit(0), F.least("mr", F.col("r") + F.col("d.dr"))).alias("nr"), F.greatest(F.lit(0), F.least(F.lit(39), F.col("c") + F.col("d.dc"))).alias("nc"))
    held = asked.join(g.select(F.col("r").alias("nr"), F.col("c").alias("nc"), "z"), ["nr", "nc"])
    s = held.groupBy("r", "c").agg((F.sum(F.col("dc") * F.col("z") * (2 - F.abs("dr"))) / 80.0).alias("zx"), (F.sum(F.col("dr") * F.col("z") * (2 - F.abs("dc"))) / 80.0).alias("zy"))
    slope = F.degrees(F.atan(F.sqrt(F.col("zx") * F.col("zx") + F.col("zy") * F.col("zy"))))
    return s.select("r", "c", rounded(slope, 5).alias("slope"), rounded(F.pmod(F.degrees(F.atan2(-F.col("zx"), F.col("zy"))), F.lit(360.0)), 4).alias("aspect"))
