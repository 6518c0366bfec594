"""Isolation forests, one per host, as a table of tree nodes (Liu, Ting and Zhou, 2008).

Sampling, grouping, thresholds and ensembles are Spark jobs. Python sees one tree's sample (512 rows) when it
grows, or one batch of a slice of a host's rows beside that host's forest when it scores. Samples follow a hash of the
row id, so the forest is the same whatever the partitioning. For scoring a host's nodes are packed once into one row of
arrays; that row goes to at most a few slices a core, whatever the host's size, and the rows of a slice stream past it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sievelog.operators.lookup import attach, null_safe
from sievelog.operators.sequence import top_n
from sievelog.sources.store import materialise

NODES = "host string, tree int, node int, feature int, threshold double, left int, right int, path double, samples int"
GLOBAL = "__global__"


def _dealt(df: DataFrame, *keys: str, tasks: int = 4) -> DataFrame:
    """Dealt by key over several tasks a core. Growing and scoring cost far more than the bytes they read, by which
    adaptive execution would merge them into a few tasks."""
    spark = df.sparkSession
    return df.repartition(max(tasks * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


# ---- growing ----

def plan(matrix: DataFrame, trees: int = 300, samples: int = 512, contamination: float = 0.05, min_rows: int = 50) -> DataFrame:
    """Rows, sample size and contamination per host; small hosts get fewer samples and a higher share. Hosts under
    the minimum are reported as SKIPPED."""
    n = F.col("rows")
    size = F.when(n < 500, F.least(n, F.lit(256))).when(
        n < 2000, F.greatest(F.least(F.floor(n * 0.8), F.lit(samples)), F.lit(64))).otherwise(F.lit(samples))
    share = F.when(n < 500, F.least(F.lit(0.10), F.lit(contamination * 2))).when(
        n < 2000, F.least(F.lit(0.08), F.lit(contamination * 1.5))).otherwise(F.lit(contamination))
    return matrix.groupBy("host").agg(F.count(F.lit(1)).alias("rows")).select(
        "host", "rows", size.cast("int").alias("sample_size"), share.alias("contamination"),
        F.when(n >= min_rows, "SUCCESS").otherwise("SKIPPED").alias("status"))


def tree_samples(matrix: DataFrame, planned: DataFrame, trees: int, seed: int) -> DataFrame:
    """Rows of every (host, tree): seeded draws by hash. Large hosts are thinned before anything is shuffled, small
    ones are drawn repeatedly (a bootstrap); a host never ships more than about 1.3 samples per tree."""
    rows = attach(matrix, materialise(planned.filter("status = 'SUCCESS'").select("host", "rows", "sample_size"), "plan"), ["host"], "inner")
    wanted = F.lit(1.3 * trees) * F.col("sample_size")
    uniform = F.pmod(F.xxhash64("host", "log_id", F.lit(seed)), F.lit(2**31)) / F.lit(float(2**31))
    draws = F.sequence(F.lit(1), F.ceil(wanted / F.col("rows")).cast("int"))
    drawn = (rows.filter(uniform < wanted / F.col("rows")).withColumn("_draw", F.explode(draws))
             .withColumn("tree", F.pmod(F.xxhash64("host", "log_id", "_draw", F.lit(seed + 1)), F.lit(trees)).cast("int"))
             .withColumn("_order", F.xxhash64("host", "log_id", "_draw", F.lit(seed + 2))))
    rank = F.row_number().over(Window.partitionBy("host", "tree").orderBy("_order", "log_id", "_draw"))
    return _dealt(drawn, "host", "tree").withColumn("_rank", rank).filter(F.col("_rank") <= F.col("sample_size")).drop("rows", "_rank", "_draw")


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean path of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3)
    out = 2 * (np.log(big - 1) + 0.5772156649015329) - 2 * (big - 1) / big
    return np.where(n > 2, out, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, allowed: np.ndarray) -> list[tuple]:
    """Nodes of one tree: random feature with a spread, random cut between its ends, until the height limit."""
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[tuple] = []
    stack = [(np.arange(len(x)), 0, -1, False)]
    while stack:
        rows, depth, parent, is_right = stack.pop()
        me = len(nodes)
        if parent >= 0:
            f, t, left, right, path = nodes[parent]
            nodes[parent] = (f, t, left, me, path) if is_right else (f, t, me, right, path)
        part = x[np.ix_(rows, allowed)]
        spread = allowed[part.max(axis=0) > part.min(axis=0)] if len(rows) > 1 and depth < limit else allowed[:0]
        if len(spread) == 0:
            nodes.append((-1, 0.0, -1, -1, depth + float(_average_path(len(rows)))))
            continue
        f = int(rng.choice(spread))
        values = x[rows, f]
        cut = float(rng.uniform(values.min(), values.max()))
        nodes.append((f, cut, -1, -1, 0.0))
        below = values <= cut
        stack.append((rows[~below], depth + 1, me, True))
        stack.append((rows[below], depth + 1, me, False))
    return nodes


def fit(matrix: DataFrame, features: list[str], trees: int = 300, samples: int = 512, feature_share: float = 0.9, seed: int = 42,
        min_rows: int = 50) -> DataFrame:
    """Node table of one forest per host with enough rows."""

    def grow(key, pdf: pd.DataFrame) -> pd.DataFrame:
        host, tree = key
        pdf = pdf.sort_values(["_order", "log_id"])
        rng = np.random.default_rng([seed, zlib.crc32(str(host).encode()), int(tree)])
        k = max(1, int(round(feature_share * len(features))))
        allowed = np.sort(rng.choice(len(features), size=k, replace=False))
        nodes = _grow(pdf[features].to_numpy(dtype=float), rng, allowed)
        out = pd.DataFrame(nodes, columns=["feature", "threshold", "left", "right", "path"])
        return out.assign(host=host, tree=tree, node=np.arange(len(out)), samples=len(pdf))[
            ["host", "tree", "node", "feature", "threshold", "left", "right", "path", "samples"]]

    drawn = tree_samples(matrix, plan(matrix, trees, samples, min_rows=min_rows), trees, seed)
    return drawn.groupBy("host", "tree").applyInPandas(grow, NODES)


def fit_global(matrix: DataFrame, features: list[str], **options) -> DataFrame:
    """One forest over all hosts, for hosts without their own; ids stay unique through the hash of (host, id)."""
    pooled = matrix.withColumn("log_id", F.xxhash64("host", "log_id")).withColumn("host", F.lit(GLOBAL))
    return fit(pooled, features, **options)


# ---- scoring ----

#: Rows that walk together: their places stay in the processor's cache.
WALKING = 16384
#: While features are shuffled: rows a task gets at least, rows that go through the trees together, lookups of one tree at most,
#: path lengths asked of a tree below which it is walked, and trees that a slice goes through while it is in the cache.
DEALT, TOGETHER, CELLS, FEW, ABREAST = 100_000, 400_000, 1 << 18, 60_000, 8
#: Slices a core that a host's rows are dealt over at most; each gets one copy of the host's forest.
SLICES = 8
PACKED = "trees int, expected double, starts binary, feature binary, threshold binary, right binary, path binary"
_KINDS = {"starts": np.int64, "feature": np.int32, "threshold": np.float64, "right": np.int32, "path": np.float64}


def pack(nodes: DataFrame) -> DataFrame:
    """One row per host: its trees, the mean expected path, and the nodes of all trees as arrays; children are numbered
    inside their tree, which starts at `starts`, and a left child follows its parent. 24 bytes a node."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tree", "node"])
        first = pdf["node"].to_numpy() == 0
        arrays = {k: pdf[k].to_numpy().astype(t).tobytes() for k, t in _KINDS.items() if k != "starts"}
        expected = float(_average_path(pdf["samples"].to_numpy()[first]).mean())
        starts = np.append(np.flatnonzero(first), len(pdf)).astype(np.int64)
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "trees": [int(first.sum())], "expected": [expected], "starts": [starts.tobytes()],
                             **{k: [v] for k, v in arrays.items()}})

    return nodes.groupBy("host").applyInPandas(run, f"host string, {PACKED}")


class _Tree:
    """One tree as lookups for rows of which one feature changes. A node whose leaves have one path length counts as a leaf.
    `below` gives, by the forest's cuts below a value, the tree's cuts below it; `words`, by the latter, a bit for every leaf
    on the value's side of all cuts of its feature. The leaf of a row is the only one that all its values leave."""

    def __init__(self, feature: np.ndarray, rank: np.ndarray, right: np.ndarray, path: np.ndarray, places: list[int]) -> None:
        feature, path, right = feature.tolist(), path.tolist(), right.tolist()
        f = feature.copy()
        for n in range(len(f) - 1, -1, -1):
            if f[n] >= 0 and f[n + 1] < 0 and f[right[n]] < 0 and path[n + 1] == path[right[n]]:
                f[n], path[n] = -1, path[n + 1]
        after = list(range(1, len(f) + 1))  # the first node after the subtree
        for n in range(len(f) - 1, -1, -1):
            if feature[n] >= 0:
                after[n] = after[right[n]]
        inner, ends, first, n = [], [], [0] * (len(f) + 1), 0  # leaves before a node
        while n < len(f):
            first[n] = len(ends)
            if f[n] < 0:
                ends.append(path[n])
                n = after[n]
            else:
                inner.append(n)
                n += 1
        first[n] = len(ends)
        self.ends = np.array(ends)
        self.words, self.below = {}, {}
        for j in sorted({f[n] for n in inner}):
            own = [n for n in inner if f[n] == j]
            cuts, at = np.unique(rank[own], return_inverse=True)
            side = np.ones((len(cuts) + 1, len(ends)), dtype=bool)
            for k, n in zip(at.tolist(), own):
                side[:k + 1, first[right[n]]:first[after[n]]] = False
                side[k + 1:, first[n]:first[right[n]]] = False
            packed = np.packbits(np.pad(side, ((0, 0), (0, -len(ends) % 64))), axis=1, bitorder="little")
            self.words[j] = np.ascontiguousarray(packed.view("<u8").T.astype(np.uint64))
            self.below[j] = np.repeat(np.arange(len(cuts) + 1), np.diff(cuts, prepend=-1, append=places[j] - 1))

    def swap(self, j: int, most: int) -> _Swap | None:
        """Lookups for rows of which feature `j` changes; none if they would take more than `most` cells. Feature by feature,
        leaves that are left for rows so far meet those that a value leaves, and what is equal becomes one."""
        state, steps = np.full((-(-len(self.ends) // 64), 1), ~np.uint64(0)), []
        for f in [*(f for f in self.words if f != j), j]:
            if state.shape[1] * self.words[f].shape[1] > most:
                return None
            cells = state[:, :, None] & self.words[f][:, None, :]
            new = np.ones(cells.shape[1:], dtype=bool)
            new[:, 1:] = (cells[:, :, 1:] != cells[:, :, :-1]).any(axis=0)
            runs, run = cells.reshape(len(cells), -1).take(np.flatnonzero(new), axis=1), np.cumsum(new) - 1
            if f == j:  # one leaf is left, so one bit: the exponent of its word is its place there
                bit = np.frexp(np.bitwise_or.reduce(runs, axis=0).astype(float))[1] - 1
                leaf = bit + 64 * (runs != 0).argmax(axis=0)
                after = [self.words[g].shape[1] for g, _ in [*steps[1:], (j, None)]]
                scaled = [(f, self.below[f], step * n) for (f, step), n in zip(steps, after)]
                scaled[:1] = [(f, step.take(below), None) for f, below, step in scaled[:1]]
                return _Swap(scaled, self.below[j], self.ends[leaf][run])
            first, same = _distinct(runs)
            steps.append((f, same[run]))
            state = runs[:, first]
        raise ValueError(f"the tree does not ask for feature {j}")


def _distinct(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of different columns, and for every column the one it equals; found by hash and compared in full."""
    hashed = np.zeros(columns.shape[1], dtype=np.uint64)
    for row in columns:
        hashed = (hashed ^ row) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(29)
    order = hashed.argsort()
    new = np.diff(hashed[order], prepend=~hashed[order[:1]]) != 0
    first, same = order[new], np.empty(len(order), dtype=np.int64)
    same[order] = np.cumsum(new) - 1
    if not np.array_equal(columns[:, first][:, same], columns):
        return np.arange(len(order)), np.arange(len(order))
    return first, same


class _Swap(NamedTuple):
    """`steps`: for every other feature its places and what is left of the tree after it, in one for the first; `below`: places
    of the feature; `paths`: path lengths by what is left and that place."""

    steps: list[tuple[int, np.ndarray, np.ndarray | None]]
    below: np.ndarray
    paths: np.ndarray

    def left(self, ranks: list[np.ndarray]) -> np.ndarray:
        """What the other features of a row leave, as the start of its row in `paths`."""
        at = None
        for f, below, step in self.steps:
            here = below.take(ranks[f], mode="wrap")
            if step is not None:
                here += at
                step.take(here, out=here, mode="wrap")
            at = here
        return np.zeros(len(ranks[0]), dtype=np.int64) if at is None else at


class _Walk:
    """A packed forest made ready for rows. Values become their places among the cuts of their feature, and every tree is
    laid out level by level with all places filled (a leaf stands for all below it): a step needs the node, the row's place
    and one subtraction. A tree has 2^(height + 1) places, about 1000 for a sample of 512 rows."""

    def __init__(self, forest: pd.Series, width: int) -> None:
        part = {k: np.frombuffer(forest[k], dtype=t) for k, t in _KINDS.items()}
        feature, root = part["feature"], part["starts"][:-1]
        right = part["right"] + np.repeat(root, np.diff(part["starts"]))
        self.trees, self.expected, self.width = forest["trees"], forest["expected"], width
        self.bits = max(width - 1, 1).bit_length()
        self.cuts = [np.unique(part["threshold"][feature == j]) for j in range(width)]
        word = np.zeros(len(feature), dtype=np.int64)
        for j, cuts in enumerate(self.cuts):
            word[feature == j] = (np.searchsorted(cuts, part["threshold"][feature == j]) << self.bits) + j
        tree = np.repeat(np.arange(len(root)), np.diff(part["starts"]))
        self.uses = np.zeros((len(root), width), dtype=bool)
        self.uses[tree[feature >= 0], feature[feature >= 0]] = True
        self._nodes = [(feature[a:b], np.where(feature[a:b] >= 0, word[a:b] >> self.bits, 0), part["right"][a:b], part["path"][a:b])
                       for a, b in zip(root, part["starts"][1:])]
        self._trees: list[_Tree | None] = [None] * len(root)
        self.levels, here = [], root[:, None]
        while (inner := feature[here] >= 0).any():
            self.levels.append(word[here])
            below, above = np.where(inner, here + 1, here), np.where(inner, right[here], here)
            here = np.stack([above, below], axis=2).reshape(len(root), -1)
        self.ends = part["path"][here]

    def tree(self, t: int) -> _Tree:
        if self._trees[t] is None:
            self._trees[t] = _Tree(*self._nodes[t], [len(c) + 1 for c in self.cuts])
        return self._trees[t]

    def ranks(self, x: np.ndarray) -> list[np.ndarray]:
        """For every feature the number of its cuts below each value; a missing one is above all."""
        return [np.searchsorted(cuts, x[:, j]) for j, cuts in enumerate(self.cuts)]

    def shuffled(self, ranks: list[np.ndarray], j: int, parts: list[slice], orders: list[list[np.ndarray]]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The trees that ask for feature `j` and their path lengths, as it is and for each order of it; `orders` has the
        orders of every part of the rows. A tree that would need more lookups than they spare is walked."""
        asked = len(ranks[j]) * len(orders[0])
        own, moved = np.zeros(len(ranks[j])), np.zeros((len(orders[0]), len(ranks[j])))
        trees = [int(t) for t in np.flatnonzero(self.uses[:, j]) if asked < FEW or j in self.tree(t).words]
        plain, swaps = [], []
        for t in trees:
            swap = self.tree(t).swap(j, min(CELLS, asked // 2)) if asked >= FEW else None
            plain, swaps = (plain, [*swaps, swap]) if swap else ([*plain, t], swaps)
            if len(swaps) < ABREAST and t != trees[-1]:
                continue
            for part, order in zip(parts, orders) if swaps else ():
                mine = [rank[part] for rank in ranks]
                at, path = np.empty(len(mine[j]), dtype=np.int64), np.empty(len(mine[j]))
                for swap in swaps:
                    left, below = swap.left(mine), swap.below.take(mine[j])
                    own[part] += swap.paths.take(left + below)
                    for total, moves in zip(moved, order):
                        below.take(moves, out=at, mode="wrap")
                        at += left
                        swap.paths.take(at, out=path, mode="wrap")
                        total[part] += path
            swaps = []
        if plain:
            own += self.total(self.placed(ranks), plain)
            for r, total in enumerate(moved):
                mine = np.concatenate([ranks[j][part][order[r]] for part, order in zip(parts, orders)])
                total += self.total(self.placed([*ranks[:j], mine, *ranks[j + 1:]]), plain)
        return trees, own, moved

    def placed(self, ranks: list[np.ndarray]) -> np.ndarray:
        """Ranks side by side, ready to be compared."""
        return (np.stack(ranks, axis=1) << self.bits) - 1

    def paths(self, places: np.ndarray, trees: Iterable[int] | None = None) -> Iterator[tuple[slice, int, np.ndarray]]:
        """(rows, tree, path length): blocks of rows, and for each the trees in their order."""
        for i in range(0, len(places), WALKING):
            block = np.ascontiguousarray(places[i:i + WALKING])
            flat, first = block.ravel(), np.arange(len(block)) * self.width
            here, node, at, path = (np.empty(len(block), dtype=t) for t in (np.int64, np.int64, np.int64, float))
            for t in range(len(self.ends)) if trees is None else trees:
                here[:] = 0
                for level in self.levels:
                    level[t].take(here, out=node, mode="wrap")
                    np.bitwise_and(node, (1 << self.bits) - 1, out=at)
                    at += first
                    flat.take(at, out=at, mode="wrap")
                    at -= node
                    at >>= 63  # -1 where the value is not above the cut
                    here += here
                    here -= at
                self.ends[t].take(here, out=path, mode="wrap")
                yield slice(i, i + WALKING), t, path

    def scores(self, total: np.ndarray) -> np.ndarray:
        """-2^(-mean path / c(sample))."""
        return -np.power(2.0, -(total / self.trees) / max(self.expected, 1e-12))

    def total(self, places: np.ndarray, trees: Iterable[int] | None = None) -> np.ndarray:
        out = np.zeros(len(places))
        for rows, _, path in self.paths(places, trees):
            out[rows] += path
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.scores(self.total(self.placed(self.ranks(x))))


def _most_slices(df: DataFrame) -> int:
    return SLICES * df.sparkSession.sparkContext.defaultParallelism


def _sliced(matrix: DataFrame, models: DataFrame, slice_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows and models, both with `model` and `slice`: rows of a host without a model of its own go to the global one. Counts
    are per host and stored first, so that Spark knows their size and does not shuffle the rows to look them up."""
    hosts = models.select("host").distinct().withColumn("_has", F.lit(True))
    counts = null_safe(matrix.groupBy("host").agg(F.count(F.lit(1)).alias("_n")), hosts, ["host"], "left").withColumn(
        "model", F.when(F.col("_has"), F.col("host")).otherwise(F.lit(GLOBAL)))
    slices = F.least(F.ceil(F.sum("_n").over(Window.partitionBy("model")) / F.lit(slice_rows)), F.lit(_most_slices(matrix))).cast("int")
    sizes = materialise(counts.select("host", "model", slices.alias("slices")), "slices")
    keyed = null_safe(matrix, sizes, ["host"], "left").withColumn("slice", F.pmod(F.xxhash64("log_id"), F.col("slices")).cast("int"))
    copies = attach(models.withColumnRenamed("host", "model"), sizes.select("model", "slices").distinct(), ["model"], "inner").withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    return keyed.drop("slices"), copies


def _streamed(rows: DataFrame, copies: DataFrame, keys: list[str], order: list[str], run, schema: str, tasks: int = 4) -> DataFrame:
    """`run(key, models, batches)` for each group of `keys`: its models, which come first, and its rows as they stream past."""

    def each(key, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models: list = []

        def rest() -> Iterator[pd.DataFrame]:
            for batch in batches:
                here = batch["_model"].notna()
                models.extend(batch.loc[here, "_model"])
                if not here.all():
                    yield batch.loc[~here].drop(columns="_model")

        stream = rest()
        for first in stream:
            yield from run(key, models, chain([first], stream))

    each.__annotations__ = {"key": tuple[Any, ...], "batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    packed = copies.select(*keys, F.struct(*[c for c in copies.columns if c not in keys]).alias("_model"))
    both = _dealt(rows.unionByName(packed, allowMissingColumns=True), *keys, tasks=tasks)
    return both.sortWithinPartitions(*keys, F.col("_model").isNull(), *order).groupBy(*keys).applyInPandas(each, schema)


def score(matrix: DataFrame, nodes: DataFrame, features: list[str], slice_rows: int = 200_000) -> DataFrame:
    """(host, log_id, anomaly_score): slices of a host's rows meet that host's packed forest, one row. A host's rows are
    split by id hash into slices of about `slice_rows`, at most SLICES a core; larger slices stream in batches. Hosts without
    a forest use the global one when the table has it; else their score is null. `nodes` is a node table or a packed one."""
    packed = nodes if "starts" in nodes.columns else materialise(pack(nodes), "packed")
    keyed, copies = _sliced(matrix, packed, slice_rows)
    id_type = dict(matrix.dtypes)["log_id"]

    def run(key, models: list, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk = _Walk(models[0], len(features)) if models else None
        for rows in batches:
            out = rows[["host", "log_id"]].copy()
            out["anomaly_score"] = walk.score(rows[features].to_numpy(dtype=float)) if walk else np.nan
            yield out

    scored = _streamed(keyed.select("model", "slice", "host", "log_id", *features), copies, ["model", "slice"], [], run,
                       f"host string, log_id {id_type}, anomaly_score double")
    return scored.withColumn("anomaly_score", F.nanvl("anomaly_score", F.lit(None).cast("double")))


def thresholds(scored: DataFrame, planned: DataFrame, contamination: float = 0.05, accuracy: int = 10000) -> DataFrame:
    """Score below which a host's row is an anomaly: its contamination quantile over all training rows. The plan
    gives a host one of three shares, so one quantile sketch per host holds all that can be asked."""
    levels = [contamination, min(0.08, contamination * 1.5), min(0.10, contamination * 2)]
    cuts = scored.groupBy("host").agg(F.percentile_approx("anomaly_score", levels, accuracy).alias("cuts"))
    n = F.col("rows")
    which = F.when(n < 500, 3).when(n < 2000, 2).otherwise(1)
    return cuts.join(planned, "host").select("host", "contamination", F.element_at("cuts", which).alias("threshold"))


def predict(scored: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds prediction -1 / 1 by the host's threshold."""
    out = attach(scored, materialise(limits.select("host", "threshold"), "limits"), ["host"])
    return out.withColumn("prediction", F.when(F.col("anomaly_score") < F.col("threshold"), -1).otherwise(1)).drop("threshold")


# ---- ensembles of batch models ----

def ensemble(member_scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted vote and weighted mean score of a row over the members; columns member, prediction, anomaly_score."""
    rows = attach(member_scores, weights.select("host", "member", "weight"), ["host", "member"], "inner")
    w = F.col("weight")
    return rows.groupBy("host", "log_id").agg(
        F.when(F.sum(F.col("prediction") * w) < 0, -1).otherwise(1).alias("prediction"),
        (F.sum(F.col("anomaly_score") * w) / F.sum(w)).alias("anomaly_score"))


def member(batch: DataFrame, features: list[str], number: int, trees: int = 100, samples: int = 256) -> DataFrame:
    """One row per host with enough rows: a small forest grown on the batch, with the batch's own scaler and threshold."""
    scaler = materialise(fit_scaler(batch, features), "scaler")
    scaled = materialise(scale(batch, scaler, features), "scaled")
    forest = materialise(pack(fit(scaled, features, trees, samples, seed=42 + number)), "member")
    limits = thresholds(score(scaled, forest, features), plan(scaled, trees, samples))
    sides = [F.array(*[F.col(f"{k}_{f}") for f in features]).alias(k) for k in ("mean", "std")]
    return (forest.join(limits.select("host", F.col("threshold").alias("limit")), "host")
            .join(scaler.select("host", *sides), "host").withColumn("member", F.lit(number)))


def score_members(matrix: DataFrame, members: DataFrame, features: list[str], slice_rows: int = 200_000) -> DataFrame:
    """(host, log_id, anomaly_score, prediction) by the weighted vote of a host's members, each with its own scaler and
    threshold; `members` are rows of `member` with their `weight`. A host without members has null scores and prediction 1."""
    keyed, copies = _sliced(matrix, members, slice_rows)
    id_type = dict(matrix.dtypes)["log_id"]

    def run(key, models: list, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walks = [(_Walk(m, len(features)), np.array(m["mean"]), np.array(m["std"]), m) for m in models]
        for rows in batches:
            out = rows[["host", "log_id"]].copy()
            x, total, vote = rows[features].to_numpy(dtype=float), np.zeros(len(rows)), np.zeros(len(rows))
            for walk, mean, spread, m in walks:
                s = walk.score((x - mean) / np.where(spread > 0, spread, 1.0))
                total += m["weight"] * s
                vote += m["weight"] * np.where(s < m["limit"], -1, 1)
            out["anomaly_score"] = total / sum(m["weight"] for m in models) if models else np.nan
            out["prediction"] = np.where(vote < 0, -1, 1)
            yield out

    scored = _streamed(keyed.select("model", "slice", "host", "log_id", *features), copies, ["model", "slice"], [], run,
                       f"host string, log_id {id_type}, anomaly_score double, prediction int")
    return scored.withColumn("anomaly_score", F.nanvl("anomaly_score", F.lit(None).cast("double")))


# ---- scaling and drift ----

def fit_scaler(matrix: DataFrame, features: list[str]) -> DataFrame:
    """Mean and population deviation per host and feature, as one row per host."""
    return matrix.groupBy("host").agg(*[F.avg(f).alias(f"mean_{f}") for f in features],
                                      *[F.stddev_pop(f).alias(f"std_{f}") for f in features])


def scale(matrix: DataFrame, scaler: DataFrame, features: list[str]) -> DataFrame:
    """Standardised features; a constant feature is only centred."""
    out = attach(matrix, materialise(scaler, "scaler"), ["host"])
    safe = lambda f: F.when(F.col(f"std_{f}") > 0, F.col(f"std_{f}")).otherwise(F.lit(1.0))
    return out.select("host", "log_id", *[((F.col(f) - F.col(f"mean_{f}")) / safe(f)).alias(f) for f in features])


def feature_drift(matrix: DataFrame, scaler: DataFrame, features: list[str], limit: float = 2.0) -> DataFrame:
    """Features whose new mean lies more than `limit` training deviations off, per host."""
    new = matrix.groupBy("host").agg(*[F.avg(f).alias(f"new_{f}") for f in features])
    rows = new.join(scaler, "host")
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"new_{f}").alias("new_mean"), F.col(f"mean_{f}").alias("train_mean"), (
        F.abs(F.col(f"new_{f}") - F.col(f"mean_{f}")) / F.sqrt(F.col(f"std_{f}") * F.col(f"std_{f}") + F.lit(1e-10))).alias("z")) for f in features])
    return rows.select("host", F.inline(cells)).withColumn("drifted", F.col("z") > limit)


def drift_report(predicted: DataFrame, trained_ratio: Column, drifted: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Change of the anomaly share against training, drifted features, and what to do: above 0.5 a full retrain, on
    drift an incremental model, else keep."""
    ratio = predicted.groupBy("host").agg(F.abs(F.avg((F.col("prediction") == -1).cast("int")) - trained_ratio).alias("average_drift"))
    features = drifted.groupBy("host").agg(F.count_if("drifted").alias("drifted_features"))
    out = ratio.join(features, "host", "left").withColumn("drifted_features", F.coalesce("drifted_features", F.lit(0).cast("bigint")))
    found = (F.col("average_drift") > threshold) | (F.col("drifted_features") >= 3)
    return out.withColumns({"drift_detected": found, "action": F.when(found & (F.col("average_drift") > 0.5), "retrain").when(found, "incremental").otherwise("keep")})


# ---- importance ----

def permutation_importance(matrix: DataFrame, nodes: DataFrame, features: list[str], rows: int | None = None, repeats: int = 10, seed: int = 42,
                           slice_rows: int = 20_000) -> DataFrame:
    """Mean fall of the score when one feature is shuffled, over all rows of each host (or a fixed sample of `rows`, if
    asked), against the largest. A host's rows are split by id hash into slices of about `slice_rows`, as in `score`;
    features are shuffled inside a slice, and the falls of all rows of the host are averaged."""
    if rows:
        order = F.xxhash64("host", "log_id", F.lit(seed))
        matrix = top_n(matrix.withColumn("_o", order), ["host"], [F.col("_o"), F.col("log_id")], rows).drop("_o")
    most = F.lit(_most_slices(matrix))
    slices = F.ceil(F.count(F.lit(1)) / F.lit(slice_rows)).cast("int")
    packs = F.least(F.ceil(F.col("slices") * F.lit(slice_rows) / F.lit(DEALT)).cast("int"), F.col("slices"), most)
    sizes = materialise(matrix.groupBy("host").agg(slices.alias("slices")).withColumn("packs", packs), "slices")
    dealt = attach(matrix, sizes, ["host"], "inner").withColumn("slice", F.pmod(F.xxhash64("log_id", F.lit(seed)), F.col("slices")).cast("int"))
    packed = nodes if "starts" in nodes.columns else pack(nodes)
    copies = attach(packed, sizes, ["host"], "inner").withColumn("pack", F.explode(F.sequence(F.lit(0), F.col("packs") - 1))).drop("slices", "packs")

    def falls_of(key, held: list[tuple[int, np.ndarray]], walk: _Walk) -> pd.DataFrame:
        """Slices are shuffled on their own and go through the trees together. Trees that do not ask for a feature give the
        same path however it is shuffled; in the others what the other features leave is looked up once a row."""
        starts = np.cumsum([0, *[len(x) for _, x in held]])
        parts = [slice(a, b) for a, b in zip(starts, starts[1:])]
        ranks, whole = walk.ranks(np.concatenate([x for _, x in held])), None
        out: dict[str, list] = {"host": [], "feature": [], "fall": [], "n": []}
        for j, name in enumerate(features):
            orders = []
            for number, x in held:
                rng = np.random.default_rng([seed, zlib.crc32(str(key[0]).encode()), zlib.crc32(name.encode()), number])
                orders.append([rng.permutation(len(x)) for _ in range(repeats)])
            trees, own, moved = walk.shuffled(ranks, j, parts, orders)
            if whole is None:
                whole = own + walk.total(walk.placed(ranks), sorted({*range(len(walk.uses))} - {*trees}))
            rest = whole - own
            base = walk.scores(rest + own)
            falls = np.zeros(len(parts))
            for total in moved:
                after = walk.scores(rest + total)
                falls += [base[part].sum() - after[part].sum() for part in parts]
            for part, fall in zip(parts, falls / repeats):
                for column, value in zip(out.values(), (key[0], name, float(fall), part.stop - part.start)):
                    column.append(value)
        return pd.DataFrame(out)

    def run(key, models: list, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk = _Walk(models[0], len(features)) if models else None
        held: list[tuple[int, np.ndarray]] = []
        pieces, number = [], None

        def close() -> None:
            held.append((number, pd.concat(pieces).sort_values("log_id")[features].to_numpy(dtype=float)))
            pieces.clear()

        for batch in batches:
            for at, part in batch.groupby("slice") if walk else ():
                if pieces and at != number:
                    close()
                    if sum(len(x) for _, x in held) >= TOGETHER:
                        yield falls_of(key, held, walk)
                        held.clear()
                number = int(at)
                pieces.append(part)
        if pieces:
            close()
            yield falls_of(key, held, walk)

    rows_ = dealt.withColumn("pack", F.pmod(F.col("slice"), F.col("packs"))).select("host", "pack", "slice", "log_id", *features)
    falls = _streamed(rows_, copies, ["host", "pack"], ["slice"], run, "host string, feature string, fall double, n long", tasks=32)
    raw = falls.groupBy("host", "feature").agg((F.sum("fall") / F.sum("n")).alias("raw"))
    best = F.max("raw").over(Window.partitionBy("host"))
    return raw.withColumn("importance", F.when(best > 0, F.col("raw") / best).otherwise(F.col("raw"))).withColumn(
        "grade", F.when(F.col("importance") < 0.01, "dead").when(F.col("importance") < 0.05, "low").otherwise("useful"))
