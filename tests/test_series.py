"""Operators of the series engine against numpy, their properties and edge cases."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.operators import analogue, cluster, events, intrinsic, pairwise, postscore, scoring
from orbweave.operators import preprocess as P
from orbweave.sources import tables


def series(spark, n=60, d=3, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x, spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "t long, x array<double>")


def distances(x, length):
    n = len(x) - length + 1
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    return sum(d[o : o + n, o : o + n] for o in range(length))


@pytest.mark.parametrize("length", [1, 4])
def test_both_plans_equal_numpy(spark, length, monkeypatch):
    monkeypatch.setattr(pairwise, "LEAST_ROWS", 7)
    x, vec = series(spark)
    want = distances(x, length)
    for df in (pairwise.traj_distance(vec, length), pairwise.traj_distance_by_window(vec, length)):
        rows = df.collect()
        assert len(rows) == len(want) * (len(want) - 1) // 2
        assert max(abs(r["d"] - want[r["i"], r["j"]]) for r in rows) < 1e-9


def test_embedding_distance_is_trajectory_distance(spark):
    x, vec = series(spark, 20)
    e = np.array([r["x"] for r in pairwise.traj_embed(vec, 4).orderBy("t").collect()])
    assert np.allclose(((e[:, None] - e[None]) ** 2).sum(-1), distances(x, 4))


def brute_scores(x, length, k, apart, season=None, greedy=False):
    d, out = distances(x, length), []
    for i in range(len(d)):
        ok = [j for j in np.argsort(d[i], kind="stable") if abs(i - j) >= apart and (season is None or min(abs(i % 365 - j % 365), 365 - abs(i % 365 - j % 365)) <= season)]
        if greedy:
            got = []
            for j in ok[: k * apart]:
                if len(got) < k and all(abs(j - g) >= apart for g in got):
                    got.append(j)
            ok = got
        out.append(np.mean([d[i, j] for j in ok[:k]]) if ok else None)
    return out


@pytest.mark.parametrize("apart", [1, 3, -1])
def test_scores_equal_brute_force(spark, apart, monkeypatch):
    monkeypatch.setattr(pairwise, "LEAST_ROWS", 9)
    x, vec = series(spark, 50)
    real = 4 if apart == -1 else apart
    for name, options in (("base", {}), ("exclusion", {"greedy": True}), ("interval", {"season": 15})):
        got = [r["score"] for r in scoring.score(vec, name, length=4, k=3, apart=apart).orderBy("t").collect()]
        assert got == pytest.approx(brute_scores(x, 4, 3, real, **options))


def test_compat_row_zero_and_few_candidates(spark):
    x, vec = series(spark, 12)
    d = distances(x, 2)
    row = scoring.score_exclusion(vec, 2, 3, 2, compat=True).where("t = 0").first()
    assert row["score"] == pytest.approx(np.sort(d[0])[1:4].mean())
    assert {r["n"] for r in scoring.score_exclusion(vec, 2, 50, 2).collect()} <= set(range(1, 50))
    assert scoring.score_interval(vec, 2, 3, 100).where("score is null").count() == 11
    with pytest.raises(ValueError):
        scoring.score_exclusion(vec, 2, 3, 0)


def test_season_wraps_around_the_year(spark):
    x, vec = series(spark, 420, 2)
    got = [r["score"] for r in scoring.score_interval(vec, 2, 5, 3).orderBy("t").collect()]
    assert got == pytest.approx(brute_scores(x, 2, 5, 3, season=15))


def test_cross_similarity_and_analogues(spark):
    x, vec = series(spark, 40)
    q = np.random.default_rng(1).normal(size=(5, 3))
    qdf = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(q)], "t long, x array<double>")
    got = {r["j"]: r["d"] for r in pairwise.cross_similarity(vec, qdf).collect()}
    assert got == pytest.approx({j: ((x[j : j + 5] - q) ** 2).sum() for j in range(36)})
    with pytest.raises(ValueError):
        pairwise.cross_similarity(qdf, vec)
    d = np.sqrt(distances(x, 4)[10])
    want = sorted((d[j], j) for j in range(37) if abs(j - 10) >= 6)[:5]
    got = [(r["d"], r["j"]) for r in analogue.analogue_search(vec, 10, 4, 5, 2).collect()]
    assert [j for _, j in got] == [j for _, j in want] and [v for v, _ in got] == pytest.approx([v for v, _ in want])
    with pytest.raises(ValueError):
        analogue.analogue_search(vec, 38, 4)


def field(spark, start="2000-02-26", days=8, cells=2):
    first = dt.datetime.fromisoformat(start)
    rows = [(t, first + dt.timedelta(days=t), c, 10.0 * c, 0.0, float(t * (c + 1) + c)) for t in range(days) for c in range(cells)]
    return spark.createDataFrame(rows, "t long, time timestamp_ntz, cell long, lat double, lon double, value double")


def test_leap_days(spark):
    f = P.remove_leap_days(field(spark))
    assert f.select("time").distinct().count() == 7
    assert [r["t"] for r in f.where("cell = 0").orderBy("time").collect()] == list(range(7))
    assert P.deseasonalize(f).agg(F.max(F.abs("value"))).first()[0] == 0


def test_standardize_constant_cell_and_detrend(spark):
    f = field(spark).withColumn("value", F.when(F.col("cell") == 0, 5.0).otherwise(F.col("value")))
    assert {r["value"] for r in P.standardize(f).where("cell = 0").collect()} == {0.0}
    assert P.detrend(f).agg(F.max(F.abs("value"))).first()[0] < 1e-9
    assert P.crop_space(f, lat=(0, 0)).select("cell").distinct().count() == 1
    assert P.slice_time(f, "2000-02-28", "2000-02-29").select("time").distinct().count() == 2


def test_ecdf_and_ranks_agree_with_sorting(spark):
    values = [3.0, 1.0, 2.0, 2.0, 5.0, 5.0, 5.0]
    s = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "t long, score double")
    got = {r["t"]: r["percentile"] for r in postscore.ecdf(s).collect()}
    assert got == pytest.approx({i: np.mean(np.array(values) <= v) for i, v in enumerate(values)})
    ranked = {r["t"]: (r["percentile"], r["rank"]) for r in postscore.storm_rank(s, s.select("t"), 1).collect()}
    assert ranked == {i: (pytest.approx(100 * np.mean(np.array(values) < v)), 1 + sum(u > v for u in values)) for i, v in enumerate(values)}


def test_intervals_touch_but_do_not_skip(spark):
    d = dt.date
    c = spark.createDataFrame([("a", d(2000, 1, 1), d(2000, 1, 3)), ("a", d(2000, 1, 3), d(2000, 1, 4)), ("a", d(2000, 1, 5), d(2000, 3, 5)), ("b", d(2000, 1, 2), d(2000, 1, 2))], "subtype string, start date, end date")
    m = events.merge_intervals(c)
    assert sorted((r["subtype"], r["start"].day, r["n"]) for r in m.collect()) == [("a", 1, 2), ("a", 5, 1), ("b", 2, 1)]
    days = spark.createDataFrame([(d(2000, 1, 2),), (d(2000, 2, 2),), (d(2001, 1, 1),)], "date date")
    got = events.match_intervals(days, m)
    assert sorted((r["date"].month, r["subtype"]) for r in got.collect()) == [(1, "a"), (2, "a")]
    assert {r["subtype"]: r["n"] for r in events.match_counts(got, m).collect()} == {"a": 2, "b": 0}
    assert events.match_random(spark, "2000-01-01", "2000-12-31", m, 3, 366).agg(F.sum("n")).first()[0] == 3 * (4 + 61 + 1)


def test_pca_keeps_distances_and_kmeans_separates(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.1, (20, 3)), rng.normal(5, 0.1, (20, 3))])
    vec = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "t long, x array<double>")
    full, shares = cluster.pca_project(vec, share=1.1)
    p = np.array([r["x"] for r in full.orderBy("t").collect()])
    assert np.allclose(distances(p, 1), distances(x, 1)) and sum(shares) == pytest.approx(1)
    labels = cluster.kmeans_sweep(vec, range(2, 4), 2)
    two = {r["t"]: r["label"] for r in labels.where("k = 2").collect()}
    assert len({two[i] for i in range(20)}) == len({two[i] for i in range(20, 40)}) == 1
    assert cluster.best_k(cluster.silhouette(vec, labels.select("k", "t", "label"))).first()["k"] == 2


def test_dimension_of_a_line(spark):
    x = np.sort(np.random.default_rng(5).random(300))[:, None] * np.ones((1, 3))
    x = x[np.random.default_rng(6).permutation(300)]
    vec = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "t long, x array<double>")
    m = pairwise.traj_matrix(vec, 1)
    assert intrinsic.mle_dimension(m, 20, compat=False).first()["mean"] == pytest.approx(1, abs=0.3)
    assert intrinsic.two_nn_dimension(m).first()["dimension"] == pytest.approx(2, abs=0.7)  # roots are taken twice


def test_sources_round_trip(spark, tmp_path):
    f = field(spark)
    f.drop("t", "cell").withColumnRenamed("lat", "latitude").withColumnRenamed("value", "msl").write.parquet(f"{tmp_path}/f")
    back = tables.read_field(spark, f"{tmp_path}/f", "msl")
    assert sorted((r["t"], r["lat"], r["value"]) for r in back.collect()) == sorted((r["t"], r["lat"], r["value"]) for r in f.collect())
    tables.write_csv(f.select("t", "value"), f"{tmp_path}/c")
    assert tables.read_csv(spark, f"{tmp_path}/c").count() == 16
    tables.write_by_type(f.select("t", F.col("cell").alias("type")), f"{tmp_path}/b")
    tables.append_new(f.select("t", "cell"), f"{tmp_path}/a", ["t", "cell"])
    tables.append_new(f.select("t", "cell"), f"{tmp_path}/a", ["t", "cell"])
    assert spark.read.parquet(f"{tmp_path}/a").count() == 16
    _, vec = series(spark, 20)
    tables.write_matrix(pairwise.traj_matrix(vec, 2), f"{tmp_path}/m", 8)
    assert spark.read.parquet(f"{tmp_path}/m").count() == 19 * 19
    scored = scoring.knn_scores(field(spark, days=40), length=2, k=3, lat=(0, 10), years=(2000, 2000))
    assert scored.count() == 39 and set(scored.columns) == {"t", "score", "time"}


def test_gaps_repeats_and_ragged_vectors_raise(spark):
    rows = [(t, [float(t), 1.0]) for t in range(40)]
    frame = lambda r: spark.createDataFrame(r, "t long, x array<double>")
    for bad in ([r for r in rows if r[0] != 7], [*rows, rows[3]], [*rows[:-1], (39, [1.0])], [*rows[:-1], (39, None)], [(t + 1, x) for t, x in rows]):
        with pytest.raises(ValueError):
            pairwise.pairwise_l2(frame(bad)).count()
    assert pairwise.pairwise_l2(frame(rows[:0])).count() == 0


def test_starts_without_a_distance_keep_a_row(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3))
    x[20, 1] = np.nan
    vec = spark.createDataFrame([(t, v.tolist()) for t, v in enumerate(x)], "t long, x array<double>")
    for made in (scoring.score_base(vec, 2, 3), scoring.score_exclusion(vec, 2, 3)):
        got = {r["t"]: r["score"] for r in made.collect()}
        assert sorted(got) == list(range(39)) and [t for t, v in got.items() if v is None] == [19, 20] or sorted(t for t, v in got.items() if v is None) == [19, 20]


def test_super_blocks_give_every_pair_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(203, 4))
    vec = spark.createDataFrame([(t, v.tolist()) for t, v in enumerate(x)], "t long, x array<double>")
    step = ((x[:, None] - x[None]) ** 2).sum(-1)
    for length, size in ((1, 128 << 20), (5, 128 << 20), (5, 700), (40, 700), (203, 700), (300, 700)):
        monkeypatch.setattr(pairwise, "SUPER_BYTES", size)
        n = max(0, 203 - length + 1)
        want = {(i, j): sum(step[i + o, j + o] for o in range(length)) for i in range(n) for j in range(i + 1, n)}
        got = [tuple(r) for r in pairwise.traj_distance(vec, length).collect()]
        assert len(got) == len(want) and all(abs(want[i, j] - d) < 1e-6 for i, j, d in got)


def test_p_values_of_a_rank_correlation(spark):
    # Student's t: known two-sided probabilities
    for t, df, p in ((1.0, 1, 0.5), (12.706204736, 1, 0.05), (2.228138852, 10, 0.05), (0.0, 7, 1.0), (-3.169272673, 10, 0.01), (1.959963985, 10**7, 0.05)):
        assert abs(events.two_sided(t, df) - p) < 1e-6
    rows = lambda v: spark.createDataFrame([(dt.date(2000, 1, k + 1), float(x)) for k, x in enumerate(v)], "date date, score double")
    r = events.spearman(rows([1, 2, 3, 4, 5, 6]), rows([2, 1, 4, 3, 6, 5])).first()
    assert r["n"] == 6 and abs(r["rho"] - 0.8285714) < 1e-6 and abs(r["p"] - 0.0415627) < 1e-6


def test_subtypes_match_in_the_catalogues_order(spark):
    rows = [("b", dt.date(2000, 1, 1), dt.date(2000, 1, 9), 1), ("a", dt.date(2000, 1, 2), dt.date(2000, 1, 9), 2), ("b", dt.date(2000, 3, 1), dt.date(2000, 3, 2), 3)]
    merged = events.merge_intervals(spark.createDataFrame(rows, "subtype string, start date, end date, place long"))
    days = spark.createDataFrame([(dt.date(2000, 1, 5),)], "date date")
    assert events.match_intervals(days, merged).first()["subtype"] == "b"
    assert events.match_intervals(days, merged.drop("place")).first()["subtype"] == "a"


def test_kmeans_small_and_large_ways(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(30, 3)) + 20 * c for c in range(3)])
    vec = spark.createDataFrame([(7 * t, v.tolist()) for t, v in enumerate(x)], "t long, x array<double>")
    want = sum(((x[30 * c : 30 * c + 30] - x[30 * c : 30 * c + 30].mean(0)) ** 2).sum() for c in range(3))
    for size, seeds in ((cluster.SMALL_BYTES, 20), (0, 3)):
        monkeypatch.setattr(cluster, "SMALL_BYTES", size)
        got = cluster.kmeans_sweep(vec, range(2, 4), seeds).where("k = 3").collect()
        assert len(got) == 90 and abs(got[0]["inertia"] - want) < 1e-6 * want
        assert all(len({r["label"] for r in got if r["t"] // 210 == c}) == 1 for c in range(3))


def made(df) -> int:
    """Rows that a query's kernels gave, read from its plan once it has run."""
    df.collect()
    spent, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if kind == "MapInArrowExec":
                spent += node.metrics().apply("pythonNumRowsReceived").value()
            todo += [node.children().apply(k) for k in range(node.children().size())]
    return spent


def test_dimensions_are_told_the_few_nearest_only(spark, monkeypatch):
    monkeypatch.setattr(pairwise, "LEAST_ROWS", 16)
    monkeypatch.setattr(pairwise, "MOST_ROWS", 16)
    _, vec = series(spark, 400, 3)
    whole = pairwise.traj_matrix(vec, 3)
    for got, want, most in (
        (intrinsic.mle_dimension(intrinsic.near_matrix(vec, 3, 20, 16), 20), intrinsic.mle_dimension(whole, 20), 20),
        (intrinsic.two_nn_dimension(intrinsic.near_matrix(vec, 3, 2)), intrinsic.two_nn_dimension(whole), 2),
    ):
        assert tuple(got.first()) == pytest.approx(tuple(want.first()))
        assert 400 * most <= made(got) < 400 * 10 * most < made(want)


def test_copies_have_distance_zero(spark):
    x = np.random.default_rng(8).normal(size=(40, 64)) * 100
    x[20:] = x[:20]
    vec = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "t long, x array<double>")
    assert {r["d"] for r in pairwise.pairwise_l2(vec).where("j = i + 20").collect()} == {0.0}


@pytest.mark.parametrize("apart", [1, 3])
def test_totals_are_sums_over_later_starts(spark, apart, monkeypatch):
    monkeypatch.setattr(pairwise, "LEAST_ROWS", 7)
    x, vec = series(spark, 60)
    got = pairwise.traj_totals(vec, 4, apart)
    want = {r["i"]: r["total"] for r in pairwise.traj_distance_by_window(vec, 4, apart).groupBy("i").agg(F.sum("d").alias("total")).collect()}
    assert {r["i"]: r["total"] for r in got.collect()} == pytest.approx(want)
    assert 57 <= made(got) < 600


def test_equal_intervals_are_one_and_join_no_earlier_one(spark):
    d = dt.date
    rows = [(f"c{k}", d(2000, 1, 1), d(2000, 1, 1)) for k in range(50)] + [(f"c{k}", d(2000, 1, 9), d(2000, 1, 11)) for k in range(50) for _ in range(3)]
    m = events.merge_intervals(spark.createDataFrame(rows, "subtype string, start date, end date").repartition(7))
    assert sorted((r["start"].day, r["end"].day, r["n"]) for r in m.collect()) == [(1, 1, 1)] * 50 + [(9, 11, 3)] * 50


def test_unknown_dates_merge_as_in_sql(spark, tmp_path):
    import duckdb

    from orbweave import catalogue

    con = duckdb.connect()
    con.execute("""create table orders as select k::bigint o_orderkey, c::bigint o_custkey, t::timestamp o_orderdate from (values
    (1, 1, '2000-01-01'), (2, 1, '2000-01-10'), (3, 1, null), (5, 1, '2000-02-01'), (null, 1, '2000-02-01'), (4, 2, null), (6, 2, null),
    (7, null, '2000-03-01'), (8, null, '2000-03-02'), (null, 3, '2000-01-01'), (10, 3, '2000-01-01'), (null, 3, '2000-01-05')) v(k, c, t)""")
    con.execute(f"copy orders to '{tmp_path}/orders.parquet' (format parquet)")
    got = catalogue.queries()["merge_intervals"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.execute(catalogue.oracle_sql()["merge_intervals"]).fetchall()))


def test_a_start_of_kmeans_is_that_of_plain_rounds_and_measures_less(monkeypatch):
    import time

    def plain(x, k, rng):
        distance = lambda c: np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0)
        centre, label = x[rng.integers(len(x))][None], None
        while len(centre) < k:
            near = distance(centre).min(1)
            centre = np.concatenate([centre, x[rng.choice(len(x), p=near / near.sum())][None]])
        while label is None or (distance(centre).argmin(1) != label).any():
            label = distance(centre).argmin(1)
            sums = np.zeros_like(centre)
            np.add.at(sums, label, x)
            centre = sums / np.bincount(label, minlength=k)[:, None]
        return float(distance(centre)[np.arange(len(x)), label].sum()), label

    x = np.random.default_rng(9).normal(size=(10000, 32))
    times = []
    for start in (lambda: plain(x, 6, np.random.default_rng(4)), lambda: cluster._lloyd(x, 6, np.random.default_rng(4), 1000)):
        at = time.process_time()
        cost, label = start()
        times.append((time.process_time() - at, cost, label))
    (before, cost, label), (after, got, mine) = times
    assert got == pytest.approx(cost, rel=1e-9) and (mine == label).all()
    assert after < 0.5 * before, (before, after)


def test_a_built_matrix_is_whole_and_stored_by_half(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pairwise, "LEAST_ROWS", 16)
    monkeypatch.setattr(pairwise, "MOST_ROWS", 16)
    x, vec = series(spark, 203)
    vec.write.parquet(f"{tmp_path}/v")
    tables.build_matrix(spark, f"{tmp_path}/v", f"{tmp_path}/m", 4)
    kept = spark.read.parquet(f"{tmp_path}/m")
    assert kept.agg(F.sum(F.size("d"))).first()[0] < 0.6 * 200 * 200
    rows = tables.read_matrix(spark, f"{tmp_path}/m").collect()
    want = np.sqrt(distances(x, 4))
    assert len(rows) == len({(r["i"], r["j"]) for r in rows}) == 200 * 200
    assert max(abs(r["d"] - want[r["i"], r["j"]]) for r in rows) < 1e-7 and all(r["d"] == 0 for r in rows if r["i"] == r["j"])
