"""Series, fields, scores and catalogues made from the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, x): the embeddings as a series of vectors."""
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("t"), F.col("embedding").cast("array<double>").alias("x"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("t"), F.col("label").cast("int").alias("label"))


def axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, time): all days from the first order to the last."""
    ends = _read(spark, sf_dir, "orders").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    days = ends.select(F.col("a"), F.explode(F.expr("sequence(a, b)")).alias("day"))
    return days.select(F.datediff("day", "a").cast("long").alias("t"), F.col("day").cast("timestamp_ntz").alias("time"))


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, time, cell, lat, lon, value): the orders' sums by day and nation, 0 where there are none."""
    orders, customer, nation = (_read(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    daily = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("time"), F.col("c_nationkey").alias("cell")).agg(F.sum("o_totalprice").alias("v"))
    cells = nation.select(F.col("n_nationkey").alias("cell"), (F.lit(-60.0) + 5 * F.col("n_nationkey")).alias("lat"), (F.lit(10.0) * F.col("n_regionkey")).alias("lon"))
    dense = axis(spark, sf_dir).join(F.broadcast(cells))  # the 25 nations
    return dense.join(daily, ["time", "cell"], "left").select("t", "time", "cell", "lat", "lon", F.coalesce("v", F.lit(0.0)).alias("value"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, time, score): the orders' sum of each day."""
    return field(spark, sf_dir).groupBy("t", "time").agg(F.round(F.sum("value"), 2).alias("score"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subtype, start, end, place): every order as an event of its customer, of one to five days."""
    start = F.col("o_orderdate").cast("date")
    return _read(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("subtype"), start.alias("start"), F.expr("date_add(cast(o_orderdate as date), cast(o_orderkey % 5 as int))").alias("end"), F.col("o_orderkey").alias("place"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date): the days on which returned goods were shipped, repeated as they are."""
    return _read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_shipdate").cast("date").alias("date"))


V = "v as (select vec_id::bigint t, list_transform(embedding, lambda z: z::double) x from embeddings)"
AXIS = """ends as (select min(o_orderdate)::date a, max(o_orderdate)::date b from orders),
axis as (select date_diff('day', a, day::date)::bigint t, day::timestamp as time from (select a, unnest(generate_series(a::timestamp, b::timestamp, interval 1 day)) as day from ends))"""
G = (
    AXIS
    + """,
daily as (select date_trunc('day', o_orderdate)::timestamp as time, c_nationkey cell, sum(o_totalprice) v from orders join customer on o_custkey = c_custkey group by all),
g as (select t, axis.time, n_nationkey cell, (-60.0 + 5 * n_nationkey)::double lat, (10.0 * n_regionkey)::double lon, coalesce(v, 0)::double as value
      from axis cross join nation left join daily on daily.time = axis.time and daily.cell = n_nationkey)"""
)
S = G + ", s as (select t, time, round(sum(value), 2)::double score from g group by all)"
C = "c as (select 'c' || o_custkey as subtype, o_orderdate::date as start, o_orderdate::date + (o_orderkey % 5)::int as \"end\" from orders)"
M = C + """,
c1 as (select *, max("end") over (partition by subtype order by start, "end" rows between unbounded preceding and 1 preceding) b from c),
c2 as (select *, sum(case when b is null or start > b then 1 else 0 end) over (partition by subtype order by start, "end" rows unbounded preceding) island from c1),
m as (select subtype, min(start) as start, max("end") as "end", count(*)::bigint n from c2 group by subtype, island)"""
P = "p as (select l_shipdate::date as date from lineitem where l_returnflag = 'R')"
#: Differences of the vectors a.x and b.x, squared and summed.
D2 = "list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def tr(length: int, apart: int) -> str:
    """CTEs pr, tr (i < j) and sym (both ways): trajectory distances of v."""
    return f"""{V},
pr as (select a.t i, b.t j, b.t - a.t delta, {D2} d2 from v a join v b on b.t >= a.t + {apart}),
tr as (select i, j, d from (select i, j, sum(d2) over (partition by delta order by i rows between current row and {length - 1} following) d from pr) where j <= (select max(t) from v) - {length - 1}),
sym as (select i, j, d from tr union all select j, i, d from tr)"""
