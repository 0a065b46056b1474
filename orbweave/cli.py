"""Command line: ``python -m orbweave.cli`` with ``score FIELD OUT``, ``matrix VECTORS OUT``, ``match SCORES CATALOGUE OUT``,
``cluster FIELD SCORES OUT``, ``analogue FIELD DATE OUT`` or ``storms CATALOGUE OUT LENGTH=SCORES...``, each with its options."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.calendar import parse_date
from orbweave.operators import analogue, cluster, events, postscore, scoring
from orbweave.operators import preprocess as P
from orbweave.session import session
from orbweave.sources import tables


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="orbweave")
    sub = parser.add_subparsers(dest="command", required=True)
    s = sub.add_parser("score", help="score a Parquet field; writes scores, top and relative tables")
    s.add_argument("field")
    s.add_argument("out")
    s.add_argument("--algorithm", choices=sorted(scoring.VARIANTS), default="base")
    s.add_argument("--variable", default="value")
    s.add_argument("--traj-length", type=int, default=5)
    s.add_argument("--k", type=int, default=10)
    s.add_argument("--top", type=int, default=100)
    for name in ("lat-min", "lat-max", "lon-min", "lon-max"):
        s.add_argument(f"--{name}", type=float)
    for name in ("start-year", "end-year"):
        s.add_argument(f"--{name}", type=int)
    for name in ("remove-leap", "remove-seasonal-cycle", "coslat", "standardize", "detrend"):
        s.add_argument(f"--{name}", action="store_true")
    b = sub.add_parser("matrix", help="all trajectory distances of Parquet vectors (t, x), by row blocks")
    b.add_argument("vectors")
    b.add_argument("out")
    b.add_argument("--traj-length", type=int, default=5)
    m = sub.add_parser("match", help="match top scores with a CSV of event dates")
    m.add_argument("scores")
    m.add_argument("catalogue")
    m.add_argument("out")
    m.add_argument("--column", default="Dates")
    m.add_argument("--style", choices=("yyyymmdd", "dayfirst"), default="yyyymmdd")
    m.add_argument("--traj-length", type=int, default=5)
    m.add_argument("--top", type=int, default=100)
    c = sub.add_parser("cluster", help="cluster the fields of the highest scores; writes labels, silhouettes and composites")
    c.add_argument("field")
    c.add_argument("scores")
    c.add_argument("out")
    c.add_argument("--variable", default="value")
    c.add_argument("--top", type=int, default=100)
    c.add_argument("--share", type=float, default=0.95)
    c.add_argument("--starts", type=int, default=50)
    n = sub.add_parser("analogue", help="the periods nearest to the one that begins on a date")
    n.add_argument("field")
    n.add_argument("date")
    n.add_argument("out")
    n.add_argument("--variable", default="value")
    n.add_argument("--traj-length", type=int, default=5)
    n.add_argument("--k", type=int, default=10)
    n.add_argument("--apart", type=int, default=5)
    r = sub.add_parser("storms", help="ranks of a catalogue's storms in the scores of several trajectory lengths")
    r.add_argument("catalogue")
    r.add_argument("out")
    r.add_argument("scores", nargs="+", metavar="LENGTH=SCORES")
    r.add_argument("--column", default="Date")
    r.add_argument("--style", choices=("yyyymmdd", "dayfirst"), default="dayfirst")
    return parser.parse_args(argv)


def run_cluster(spark: SparkSession, a: argparse.Namespace) -> None:
    field = tables.read_field(spark, a.field, a.variable)
    top = postscore.top_n(tables.read_scores(spark, a.scores), a.top)
    chosen = cluster.select_events(field, top)
    vec, _ = cluster.pca_project(dense_vectors(P.column_centre(P.drop_nan_cells(chosen))), a.share, least=3)
    tables.write_table(cluster.kmeans_sweep(vec, seeds=a.starts), f"{a.out}/sweep")
    labels = spark.read.parquet(f"{a.out}/sweep")
    tables.write_table(cluster.silhouette(vec, labels), f"{a.out}/silhouettes")
    k = cluster.best_k(spark.read.parquet(f"{a.out}/silhouettes")).first()["k"]
    # steps were numbered anew among the chosen ones
    times = dense_vectors(chosen).select("t", "time")
    best = labels.where(F.col("k") == k).join(times, "t").select("time", "label")
    tables.write_csv(best.orderBy("time"), f"{a.out}/labels")
    real = best.join(chosen.select("time", "t").distinct(), "time").select("t", "label")
    tables.write_table(cluster.composites(chosen, real), f"{a.out}/composites")


def dense_vectors(field: DataFrame) -> DataFrame:
    """Vectors of the field's steps, numbered from 0 by their time."""
    return P.to_vectors(P.dense_steps(field))


def run_analogue(spark: SparkSession, a: argparse.Namespace) -> None:
    vec = P.to_vectors(tables.read_field(spark, a.field, a.variable))
    tables.write_csv(analogue.find_analogues(vec.select("t", "time"), vec, a.date, a.traj_length, a.k, a.apart).orderBy("d", "j"), a.out)


def run_storms(spark: SparkSession, a: argparse.Namespace) -> None:
    days = tables.read_csv(spark, a.catalogue).select(parse_date(a.column, a.style).alias("date")).where("date is not null").distinct()
    parts, means = None, None
    for given in a.scores:
        length, path = given.split("=", 1)
        scores = tables.read_scores(spark, path)
        storms = scores.select("t", F.to_date("time").alias("date")).join(days, "date").select("t")
        ranked = postscore.storm_rank(scores, storms, int(length)).withColumn("length", F.lit(int(length)))
        mean = postscore.storm_summary(ranked).withColumn("length", F.lit(int(length)))
        parts, means = (ranked, mean) if parts is None else (parts.unionByName(ranked), means.unionByName(mean))
    tables.write_csv(parts, f"{a.out}/ranks")
    tables.write_csv(means, f"{a.out}/summary")


def main(argv: list[str] | None = None) -> None:
    a, spark = arguments(argv), session()
    other = {"cluster": run_cluster, "analogue": run_analogue, "storms": run_storms}
    if a.command in other:
        other[a.command](spark, a)
        return
    if a.command == "matrix":
        tables.build_matrix(spark, a.vectors, a.out, a.traj_length)
        return
    if a.command == "match":
        top = postscore.top_n(tables.read_scores(spark, a.scores), a.top)
        days = events.expand_dates(top.select(F.to_date("time").alias("date")), a.traj_length)
        catalogue = tables.read_csv(spark, a.catalogue).select(parse_date(a.column, a.style).alias("date")).where("date is not null")
        tables.write_csv(events.match_points(days, catalogue), a.out)
        return
    field = tables.read_field(spark, a.field, a.variable)
    if a.start_year is not None and a.end_year is not None:
        field = P.dense_steps(P.slice_time(field, f"{a.start_year}-01-01", f"{a.end_year}-12-31"))
    lat = (a.lat_min, a.lat_max) if a.lat_min is not None and a.lat_max is not None else None
    lon = (a.lon_min, a.lon_max) if a.lon_min is not None and a.lon_max is not None else None
    field = P.crop_space(field, lat, lon)
    field = P.preprocess(field, a.remove_leap, a.remove_seasonal_cycle, a.coslat, a.standardize, a.detrend)
    vec = P.to_vectors(field)
    scores = scoring.score(vec, a.algorithm, length=a.traj_length, k=a.k).join(vec.select("t", "time"), "t").select("t", "time", "score")
    tables.write_table(scores, f"{a.out}/scores")
    scores = tables.read_scores(spark, f"{a.out}/scores")
    tables.write_csv(postscore.top_n(scores, a.top), f"{a.out}/top")
    tables.write_csv(postscore.relative(scores, "month", a.top), f"{a.out}/relative")


if __name__ == "__main__":
    main()
