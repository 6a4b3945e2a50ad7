"""The shared orderings of conditional permutation, against brute force and against independent draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealis.operators import autocorr, weights
from arealis.operators.permute import _means, _own_streams, conditional_p, independent_p, place


@pytest.mark.parametrize("n", [1, 2, 5, 25, 1000, 4097])
def test_an_ordering_holds_each_place_once(n):
    at = place(np.arange(n), np.full(n, n), np.full(n, 12345))
    assert sorted(at) == list(range(n))


def test_places_are_uniform_and_pairs_too():
    n, streams = 25, 40_000
    s = np.random.default_rng(7).integers(0, 1 << 62, streams)
    first, second = (place(np.full(streams, j), np.full(streams, n), s) for j in (0, 1))
    for seen, cells in ((first, n), (second, n), (first * n + second, n * n)):
        counts = np.bincount(seen, minlength=cells)
        counts = counts[counts > 0] if cells > n else counts
        expected = streams / (n if cells == n else n * (n - 1))
        chi, df = ((counts - expected) ** 2 / expected).sum(), len(counts) - 1
        assert abs(chi - df) < 5 * np.sqrt(2 * df)


def _brute(rows, edges, permutations, streams):
    """p by group: rows (t, key, v or None), edges src -> list of dst; means as the definition gives them from the same orderings."""
    out = {}
    for t in {r[0] for r in rows}:
        pool = [(k, v) for g, k, v in sorted(rows) if g == t and v is not None]
        values = dict(pool)
        for g, key, v in rows:
            k = len(edges.get(key, []))
            if g != t or not k or v is None:
                continue
            stat, c = v * np.mean([values.get(d, 0.0) for d in edges[key]]), 0
            for p in range(1, permutations + 1):
                at = [ORDER[t][i] for i in place(np.arange(len(pool)), np.full(len(pool), len(pool)), np.full(len(pool), streams[t, p]))]
                picks = [values[i] for i in at if i != key][:k]
                c += v * np.mean(picks) >= stat
            out[t, key] = (min(c, permutations - c) + 1) / (permutations + 1)
    return out


ORDER: dict = {}


def test_conditional_p_against_brute_force(spark):
    random, permutations = np.random.default_rng(3), 49
    rows = [(t, int(k), float(random.integers(-9, 10)) if (t, k) != (1, 4) else None) for t in (1, 2) for k in range(12)]
    edges = {k: [int(d) for d in random.choice([x for x in range(12) if x not in (k, 4)], size=min(k, 9), replace=False)] for k in range(1, 12)}
    df = spark.createDataFrame(rows, "t int, id long, v double")
    near = spark.createDataFrame([(s, d) for s, ds in edges.items() for d in ds], "src long, dst long")
    lag = near.join(df.select("t", F.col("id").alias("dst"), F.col("v").alias("n")), "dst").groupBy("t", F.col("src").alias("id")).agg(F.avg("n").alias("m"), F.count(F.lit(1)).alias("k"))
    found = df.join(lag, ["t", "id"], "left").withColumn("k", F.coalesce("k", F.lit(0))).withColumn("stat", F.col("v") * F.col("m"))
    got = conditional_p(found, "id", "v", {"p": (F.lit(0.0), F.col("v"), F.col("stat"))}, permutations, 5, ["t"]).collect()
    perms = spark.range(1, permutations + 1).crossJoin(df.select("t").distinct()).select("t", "id", F.xxhash64(F.lit(5), "id", "t").alias("h")).collect()
    ranks = spark.createDataFrame([(t, k) for t, k, v in rows if v is not None], "t int, id long").withColumn("b", F.pmod(F.xxhash64("id"), F.lit(4096))).orderBy("t", "b", "id").collect()
    for r in ranks:
        ORDER.setdefault(r["t"], []).append(r["id"])
    want = _brute(rows, edges, permutations, {(r["t"], r["id"]): r["h"] for r in perms})
    assert len(got) == len(rows)
    assert {(r["t"], r["id"]): r["p"] for r in got if r["p"] is not None} == pytest.approx(want)


def test_lisa_and_g_against_independent_draws(spark):
    random, n, k, permutations = np.random.default_rng(11), 200, 4, 999
    pts = [(i, float(x), float(y), float(v)) for i, (x, y, v) in enumerate(zip(random.random(n), random.random(n), random.random(n) + 1, strict=True))]
    df = spark.createDataFrame(pts, "obs_id long, x double, y double, v double")
    w = weights.knn(df, k).cache()
    lisa = autocorr.lisa_pseudo_p_sampled(autocorr.lisa(df, w, "obs_id", "v"), "obs_id", permutations).toPandas().set_index("obs_id").sort_index()
    g = autocorr.g_pseudo_p_sampled(autocorr.getis_ord(df, w, "obs_id", "v"), "obs_id", "v", permutations).toPandas().set_index("obs_id").sort_index()
    v, z = lisa["v"].to_numpy(), lisa["z"].to_numpy()
    for i in range(n):
        others = np.array([j for j in range(n) if j != i])
        picks = np.array([random.choice(others, k, replace=False) for _ in range(permutations)])
        for p, c in (
            (lisa["p"][i], (z[i] * z[picks].mean(axis=1) >= lisa["lisa"][i]).sum()),
            (g["pp_g"][i], (v[picks].mean(axis=1) / (v.sum() - v[i]) >= g["g"][i]).sum()),
            (g["pp_star"][i], ((k * v[picks].mean(axis=1) + v[i]) / (k + 1) / v.sum() >= g["g_star"][i]).sum()),
        ):
            want = (min(c, permutations - c) + 1) / (permutations + 1)
            assert abs(p - want) < 6 * np.sqrt(2 * max(want * (1 - want), 0.002) / permutations)


def test_no_neighbours_no_rows_and_hubs(spark):
    schema = "id long, v double, k long, stat double"
    test = {"p": (F.lit(0.0), F.col("v"), F.col("stat"))}
    assert conditional_p(spark.createDataFrame([], schema), "id", "v", test, 9).count() == 0
    alone = spark.createDataFrame([(1, 1.0, 0, None), (2, 2.0, 0, None)], schema)
    assert [r["p"] for r in conditional_p(alone, "id", "v", test, 9).collect()] == [None, None]
    # A hub with all others as neighbours always draws the same set; one neighbour more than there are others gives NULL.
    hub = spark.createDataFrame([(1, 1.0, 2, 5.0), (2, 4.0, 3, 1.0), (3, 2.0, 1, 99.0)], schema)
    got = {r["id"]: r["p"] for r in conditional_p(hub, "id", "v", test, 9).collect()}
    assert got == {1: 0.1, 2: None, 3: 0.1}


def test_knn_of_clusters_and_coincident_points(spark):
    random = np.random.default_rng(2)
    pts = np.concatenate([random.random((150, 2)) * 1000, 500 + random.random((150, 2)) * 1e-3, np.full((120, 2), 250.0)])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "obs_id long, x double, y double")
    got = {(r["src"], r["dst"]) for r in weights.knn(df, 3).collect()}
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(axis=2))
    want = {(i, j) for i in range(len(pts)) for j in [j for j in np.lexsort((np.arange(len(pts)), d[i])) if j != i][:3]}
    assert got == want


def test_own_draws_are_independent_and_leave_the_observation_out():
    """The pairs of draws of two observations fill their cells evenly, which shared orderings can't; each draw is uniform over the others."""
    n, perms = 6, np.arange(1, 20_001)
    values = np.arange(n, dtype="f8")
    one, two = (np.array([_means(values, 1, own, _own_streams(np.array([h]), perms)[0][i : i + 1])[0] for i in range(len(perms))]).astype(int) for own, h in ((0, 111), (3, 222)))
    assert 0 not in one and 3 not in two
    cells = np.bincount(one * n + two, minlength=n * n)
    cells = cells[cells > 0]
    expected = len(perms) / (n - 1) ** 2
    chi, df = ((cells - expected) ** 2 / expected).sum(), (n - 1) ** 2 - 1
    assert len(cells) == (n - 1) ** 2 and abs(chi - df) < 5 * np.sqrt(2 * df)
    three = np.array([_means(values, 3, -1, s[None])[0] for s in _own_streams(np.array([5]), perms[:3000])[0]])
    assert abs(three.mean() - values.mean()) < 5 * values.std() / np.sqrt(3 * 3000)


def test_own_draws_by_both_plans(spark):
    """Values in every task or joined: the same p; isolates, missing values, one group too small, a hub, and ties."""
    rng = np.random.default_rng(4)
    rows = [(t, i, None if i == 5 else float(rng.integers(0, 4)), 0 if i == 7 else (25 if i == 1 else 4)) for t in (1, 2) for i in range(30)] + [(3, 1, 2.0, 1)]
    found = spark.createDataFrame(rows, "t int, id long, z double, k long").withColumn("stat", F.col("z") * 1.5)
    tests = {"p": (F.lit(0.0), F.col("z"), F.col("stat")), "q": (F.col("z"), F.lit(1.0), F.lit(3.0))}
    got = [{(r.t, r.id): (r.p, r.q) for r in independent_p(found, "id", "z", tests, 99, by=["t"], most_bytes=b).collect()} for b in (1 << 20, 0)]
    assert got[0].keys() == got[1].keys() and len(got[0]) == 61
    for at in got[0]:
        assert got[0][at] == pytest.approx(got[1][at], nan_ok=True) if None not in got[0][at] else got[0][at] == got[1][at]
    assert got[0][1, 7] == (None, None) and got[0][3, 1] == (None, None) and got[0][1, 5][0] is None and got[0][1, 5][1] is not None
    assert got[0][1, 2] != got[0][2, 2] or got[0][1, 3] != got[0][2, 3]


def test_own_draws_agree_with_all_orderings(spark):
    """On a line of observations, p values come near those of the shared orderings."""
    rng = np.random.default_rng(8)
    obs = spark.createDataFrame([(i, float(np.sin(i / 6) + rng.normal() / 3)) for i in range(120)], "obs_id long, v double")
    w = spark.createDataFrame([(i, j) for i in range(120) for j in (i - 1, i + 1) if 0 <= j < 120], "src long, dst long")
    found = autocorr.lisa(obs, w, "obs_id", "v")
    shared, own = ({r.obs_id: r.p for r in autocorr.lisa_pseudo_p_sampled(found, "obs_id", 999, independent=x).collect()} for x in (False, True))
    assert max(abs(shared[i] - own[i]) for i in shared) < 0.09
