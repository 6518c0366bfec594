"""Properties of the forest: outliers stand out, results do not depend on partitioning or slicing."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from sievelog.operators import forest as FO

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", i, *map(float, rng.normal(size=3))) for i in range(2500)]
    rows += [("hot", 10_000 + i, 9.0 + i, -9.0, 9.0) for i in range(10)]
    rows += [("small", i, *map(float, rng.normal(size=3))) for i in range(300)]
    rows += [("tiny", i, 0.0, 0.0, 0.0) for i in range(10)]
    held = spark.createDataFrame(rows, "host string, log_id bigint, a double, b double, c double").cache()
    yield held
    held.unpersist()


@pytest.fixture(scope="module")
def nodes(matrix):
    held = FO.fit(matrix, FEATURES, trees=40, samples=128).cache()
    yield held
    held.unpersist()


def scores(df):
    return {(r["host"], r["log_id"]): r["anomaly_score"] for r in df.collect()}


def test_outliers_lead(matrix, nodes):
    got = scores(FO.score(matrix, nodes, FEATURES))
    hot = sorted((s, i) for (h, i), s in got.items() if h == "hot")
    assert {i for _, i in hot[:10]} == {10_000 + i for i in range(10)}
    assert all(-1 <= s <= 0 for s, _ in hot)


def test_host_below_the_minimum_has_no_model(matrix, nodes):
    assert {r["host"] for r in nodes.select("host").distinct().collect()} == {"hot", "small"}
    got = scores(FO.score(matrix, nodes, FEATURES))
    assert all(s is None for (h, _), s in got.items() if h == "tiny")
    assert len(got) == matrix.count()


def test_global_model_serves_the_rest(matrix, nodes):
    both = nodes.unionByName(FO.fit_global(matrix, FEATURES, trees=10, samples=64))
    assert all(s is not None for s in scores(FO.score(matrix, both, FEATURES)).values())


def test_partitioning_and_slicing_do_not_matter(matrix, nodes):
    again = FO.fit(matrix.repartition(13, "a"), FEATURES, trees=40, samples=128)
    key = ["host", "tree", "node", "feature", "threshold", "left", "right", "path", "samples"]
    assert nodes.select(key).exceptAll(again.select(key)).count() == 0
    one, many = scores(FO.score(matrix, nodes, FEATURES)), scores(FO.score(matrix.repartition(7), nodes, FEATURES, slice_rows=100))
    assert one == many


def test_samples_are_bounded(matrix):
    plan = FO.plan(matrix, 40, 128)
    drawn = FO.tree_samples(matrix, plan, 40, 42).groupBy("host", "tree").count().agg(F.max("count")).first()[0]
    assert drawn <= 256
    status = {r["host"]: (r["status"], r["sample_size"]) for r in plan.collect()}
    assert status["tiny"][0] == "SKIPPED" and status["small"] == ("SUCCESS", 256) and status["hot"] == ("SUCCESS", 128)


def test_contamination(matrix, nodes):
    scored = FO.score(matrix, nodes, FEATURES).cache()
    out = FO.predict(scored, FO.thresholds(scored, FO.plan(matrix)))
    share = {r["host"]: r["p"] for r in out.groupBy("host").agg(F.avg((F.col("prediction") == -1).cast("int")).alias("p")).collect()}
    scored.unpersist()
    assert abs(share["hot"] - 0.05) < 0.01 and abs(share["small"] - 0.10) < 0.02


def test_importance_finds_the_informative_feature(spark):
    rng = np.random.default_rng(1)
    rows = [("h", i, float(rng.normal() + (25 if i % 50 == 0 else 0)), 1.0, 1.0) for i in range(600)]
    m = spark.createDataFrame(rows, "host string, log_id bigint, a double, b double, c double")
    out = {r["feature"]: r["grade"] for r in FO.permutation_importance(m, FO.fit(m, FEATURES, 20, 128), FEATURES, 400, 3).collect()}
    assert set(out) == set(FEATURES) and out["b"] == out["c"]


def test_importance_reads_all_rows(spark):
    """A feature that varies only outside of the 5000 rows with the smallest hashes."""
    ids = spark.range(6000).select(F.lit("h").alias("host"), F.col("id").alias("log_id")).withColumn("o", F.xxhash64("host", "log_id", F.lit(42)))
    late = {r["log_id"] for r in ids.orderBy(F.desc("o")).limit(1000).collect()}
    rng = np.random.default_rng(2)
    rows = [("h", i, float(rng.normal()), float(rng.normal()) if i in late else 0.0, 1.0) for i in range(6000)]
    m = spark.createDataFrame(rows, "host string, log_id bigint, a double, b double, c double")
    nodes = FO.fit(m, FEATURES, 20, 256).cache()
    for more in ({}, {"slice_rows": 1000}):
        raw = {r["feature"]: r["raw"] for r in FO.permutation_importance(m, nodes, FEATURES, repeats=3, **more).collect()}
        assert set(raw) == set(FEATURES) and abs(raw["b"]) > 1e-6 and raw["c"] == 0
    nodes.unpersist()


def test_queries_use_whole_forests_and_all_rows(spark, monkeypatch):
    grown, asked = [], []
    fit = FO.fit
    monkeypatch.setattr(FO, "fit", lambda m, f, *a, **k: grown.append((*a, *[k[x] for x in ("trees", "samples") if x in k])) or fit(m, f, 2, 64))
    real = FO.permutation_importance
    monkeypatch.setattr(FO, "permutation_importance", lambda m, n, f, *a, **k: asked.append((a, k)) or real(m, n, f, 100, 1))
    for name in ("e02_forest_nodes", "e04_forest_predictions", "e06_global_fallback", "e07_e08_ensemble", "e23_e24_importance", "e25_feature_selection"):
        queries()[name](spark, "/root/testdata/sf0.001")
    assert set(grown) == {(300, 512)} and asked == [((), {})]


def test_ensemble_vote(spark):
    votes = spark.createDataFrame([("h", 1, m, p, s) for m, p, s in ((0, -1, -0.9), (1, 1, -0.3), (2, 1, -0.3))], "host string, log_id int, member int, prediction int, anomaly_score double")
    weights = spark.createDataFrame([("h", 0, 0.6), ("h", 1, 0.2), ("h", 2, 0.2)], "host string, member int, weight double")
    row = FO.ensemble(votes, weights).first()
    assert row["prediction"] == -1 and abs(row["anomaly_score"] + 0.66) < 1e-9


def test_copies_of_a_forest_do_not_grow_with_the_rows(matrix, nodes):
    """A host's forest went to one slice per `slice_rows` rows: 24 GB of copies over 36 million rows."""
    packed = FO.pack(nodes)
    keyed, copies = FO._sliced(matrix, packed, 1)
    most = FO.SLICES * matrix.sparkSession.sparkContext.defaultParallelism
    assert {r["model"]: r["count"] for r in copies.groupBy("model").count().collect()} == {"hot": most, "small": most}
    assert keyed.count() == matrix.count()
    assert scores(FO.score(matrix, packed, FEATURES, 1)) == scores(FO.score(matrix, nodes, FEATURES))


def test_rows_are_not_shuffled_for_values_of_their_host(matrix):
    for df in (FO.scale(matrix, FO.fit_scaler(matrix, FEATURES), FEATURES), FO.tree_samples(matrix, FO.plan(matrix), 40, 42)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_scores_equal_a_plain_walk(matrix, nodes):
    """Also for missing values, which are above every cut, and values that are a cut."""
    rows = [r for r in nodes.filter("host = 'hot'").orderBy("tree", "node").collect()]
    trees = {}
    for r in rows:
        trees.setdefault(r["tree"], []).append(r)
    cut = next(r for r in rows if r["feature"] == 0)["threshold"]
    asked = [(i, a, b, c) for i, (a, b, c) in enumerate([(cut, 0.1, 0.2), (None, 0.5, -1.0), (3.0, None, None), (-9.0, 9.0, 0.0)])]
    m = matrix.sparkSession.createDataFrame([("hot", *a) for a in asked], "host string, log_id bigint, a double, b double, c double")

    def path(tree, x):
        at = tree[0]
        while at["feature"] >= 0:
            v = x[at["feature"]]
            at = tree[at["left"] if v is not None and v <= at["threshold"] else at["right"]]
        return at["path"]

    expected = np.mean([FO._average_path(t[0]["samples"]) for t in trees.values()])
    got = scores(FO.score(m, nodes, FEATURES))
    for i, *x in asked:
        assert abs(got["hot", i] + 2 ** (-np.mean([path(t, x) for t in trees.values()]) / expected)) < 1e-12


def test_importance_does_not_depend_on_partitioning(matrix, nodes):
    out = FO.permutation_importance(matrix.filter("host = 'hot'"), nodes, FEATURES, repeats=2, slice_rows=700).collect()
    again = FO.permutation_importance(matrix.filter("host = 'hot'").repartition(5), nodes, FEATURES, repeats=2, slice_rows=700).collect()
    assert {r["feature"]: round(r["raw"], 9) for r in out} == {r["feature"]: round(r["raw"], 9) for r in again}


def test_shuffled_features_are_looked_up_not_walked(nodes, monkeypatch):
    """Every tree was walked again for each feature and repeat, 10 times over all rows. Path lengths must be those of the walk,
    also of missing values and of values that are a cut, and where lookups would be too many."""
    walk = FO._Walk(FO.pack(nodes.filter("host = 'hot'")).toPandas().iloc[0], len(FEATURES))
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 3))
    x[::7, 0], x[::5, 1], x[1::9, 2] = walk.cuts[0][3], np.nan, walk.cuts[2][-1]
    ranks, parts = walk.ranks(x), [slice(0, 1000), slice(1000, 3000)]
    orders = [[rng.permutation(p.stop - p.start) for _ in range(4)] for p in parts]
    whole = walk.total(walk.placed(ranks))
    for cells in (FO.CELLS, 40):
        monkeypatch.setattr(FO, "CELLS", cells)
        monkeypatch.setattr(FO, "FEW", 0)
        for j in range(3):
            with monkeypatch.context() as m:
                if cells > 40:
                    m.setattr(walk, "paths", lambda *a: pytest.fail("a tree is walked"))
                trees, own, moved = walk.shuffled(ranks, j, parts, orders)
            assert 0 < len(trees) <= walk.uses[:, j].sum()
            for r, total in enumerate(moved):
                swapped = x.copy()
                swapped[:, j] = np.concatenate([x[p, j][o[r]] for p, o in zip(parts, orders)])
                assert np.allclose(whole - own + total, walk.total(walk.placed(walk.ranks(swapped))), rtol=0, atol=1e-9)
                assert total.std() > 0


def test_importance_equals_plain_walks(spark, matrix, nodes):
    """By its definition, slice by slice, with enough rows for lookups and with too few."""
    many = matrix.filter("host = 'hot'").unionByName(matrix.filter("host = 'hot'").withColumn("log_id", F.col("log_id") + 50_000).withColumn("b", F.col("b") * 2))
    out = FO.permutation_importance(many.unionByName(matrix.filter("host = 'small'")), nodes, FEATURES, repeats=12, slice_rows=1500)
    got = {(r["host"], r["feature"]): r["raw"] for r in out.collect()}
    assert len(got) == 6
    for host, df in (("hot", many), ("small", matrix.filter("host = 'small'"))):
        walk = FO._Walk(FO.pack(nodes.filter(F.col("host") == host)).toPandas().iloc[0], len(FEATURES))
        slices = -(-df.count() // 1500)
        pdf = df.withColumn("slice", F.pmod(F.xxhash64("log_id", F.lit(42)), F.lit(slices))).toPandas()
        for name in FEATURES:
            falls = 0.0
            for number, part in pdf.groupby("slice"):
                x = part.sort_values("log_id")[FEATURES].to_numpy(dtype=float)
                rng = np.random.default_rng([42, zlib.crc32(host.encode()), zlib.crc32(name.encode()), number])
                for _ in range(12):
                    y = x.copy()
                    y[:, FEATURES.index(name)] = rng.permutation(x[:, FEATURES.index(name)])
                    falls += (walk.score(x).sum() - walk.score(y).sum()) / 12
            assert abs(got[host, name] - falls / len(pdf)) < 1e-9
