"""N-gram Jaccard join by chosen paths.

A set of n tokens continues a path with the tokens whose hash, seeded by the path, is below 1 / (SPLIT * n): one token in
expectation for SPLIT = 1, the same tokens for all sets of a size. Sets on the same path have sampled the same tokens, and
a path that too many sets share goes on to split. Each run starts from a seed of its own; as many runs are made as the
target recall needs. Small buckets are compared outright, with exact set sizes.

Equal sets are one class from the start, so copies cost nothing. A pair of classes that meets in several buckets counts in
the smallest of them only, which both can tell from their own lists of buckets: so pairs are counted without ever being
written down.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from sievelog.llm.common import Words, mix, numbered, per_batch, salted_groups, shards, shingles, text_of
from sievelog.sources.store import materialise

#: Words of a shingle; least similarity as a fraction; target recall of a pair at that similarity. At the longest paths and
#: with one set inside the other, the worst case, less than one of 10 ** 9 linked pairs is expected to be lost.
WORDS, ABOVE, BELOW, RECALL = 5, 4, 5, 1 - 1e-9
#: Tokens a path takes is 1 / SPLIT on average; lengths of the shortest and of the longest path.
SPLIT, FIRST, LAST = 0.65, 2, 4
#: Sets in a bucket before its path goes on. A bucket that is still larger at the end is dealt into blocks: of so many sets
#: where their tokens are compared, and of WIDE times as many where only paths, sizes and counts decide what to compare.
BUCKET, BLOCK, WIDE = 200, 256, 4
#: Parts of the hash range in which a set's tokens are counted: the smaller counts bound what two sets share.
PARTS = 64
#: Sets whose ids are broadcast to the texts (about 100 bytes each); more meet their texts by a shuffle.
BROADCAST_SETS = 200_000
#: Pairs of a path and a token that are hashed at once.
STEP = 1 << 18
_SEED = np.uint64(0x5851F42D4C957F2D)


def runs_for(recall: float = RECALL, depth: int = LAST) -> int:
    """Runs after which two sets at the least similarity have met at `depth` with probability `recall`. Sets whose shared
    part is s of the larger one go on together to s / SPLIT tokens on average; s is at least the Jaccard similarity."""
    mean, meet = ABOVE / BELOW / SPLIT, 1.0
    for _ in range(depth):
        meet = 1 - math.exp(-mean * meet)
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def extend(paths: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, path) of all paths one token longer."""
    if not len(paths) or not len(tokens):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    below = np.uint64(min(2 ** 64 - 1, int(2 ** 64 / (SPLIT * len(tokens)))))
    parents, found, step = [], [], max(1, STEP // len(tokens))
    for at in range(0, len(paths), step):
        here = paths[at:at + step]
        x = (tokens[None, :] ^ here[:, None]) * np.uint64(0x9FB21C651E98DF25)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xD1342543DE82EF95)
        parent, token = np.nonzero(x <= below)
        parents.append(parent + at)
        found.append(mix(here[parent] * np.uint64(0x2545F4914F6CDD1D) + tokens[token]))
    return np.concatenate(parents), np.concatenate(found)


def first_paths(tokens: np.ndarray, runs: int) -> np.ndarray:
    paths = mix(np.arange(1, runs + 1, dtype=np.uint64) * _SEED)
    for _ in range(FIRST):
        paths = extend(paths, tokens)[1]
    return np.unique(paths)


def _token_sets(texts: list) -> Iterator[np.ndarray]:
    for _, part in shards(t.encode() for t in texts):
        words = Words(part)
        for i in range(len(part)):
            yield shingles(words.of(i), WORDS)


def _signature(tokens: np.ndarray) -> str:
    return hashlib.md5(tokens.tobytes(), usedforsecurity=False).hexdigest()


def _counts(tokens: np.ndarray) -> bytes:
    """Tokens in each part of the hash range; 255 stands for 255 and more."""
    return np.minimum(np.bincount((tokens >> np.uint64(58)).astype(np.int64), minlength=PARTS), 255).astype(np.uint8).tobytes()


def _signed(a: np.ndarray) -> list[int]:
    return a.view(np.int64).tolist()


def class_of_sets(df: DataFrame, doc_id: str, text: str, runs: int, row: str | None) -> tuple[DataFrame, DataFrame]:
    """Stored: doc_id, _row, set, size, counts, paths; and doc_id, _row, set, with for the set: rep (row of the smallest id), rep_id, copies."""
    import pyarrow as pa

    def run(texts: list) -> list[tuple]:
        return [(_signature(t), len(t), _counts(t), _signed(first_paths(t, runs))) for t in _token_sets(texts)]

    udf = per_batch(run, "set string, size int, counts binary, paths array<bigint>", [pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int64())])
    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = df.select(F.col(doc_id).alias("doc_id"), number.alias("_row"), udf(text_of(text)).alias("_s")).select("doc_id", "_row", "_s.*")
    # a text without words is like no other
    rows = materialise(rows.withColumn("set", F.when(F.col("size") > 0, F.col("set")).otherwise(F.concat(F.lit("-"), F.col("_row")))), "sets")
    order = F.struct(F.col("doc_id").isNull().alias("void"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    narrow = rows.select("doc_id", "_row", "set").withColumn("_order", order)
    groups = salted_groups(narrow, ["set"], F.col("_row"), {"_first": ("min", "_order"), "copies": ("count", "*")})
    return rows, materialise(groups.select("doc_id", "_row", "set", "copies", F.col("_first.row").alias("rep"), F.col("_first.id").alias("rep_id")), "classes")


def shared(buckets: DataFrame) -> DataFrame:
    """(path, rep, n) of the paths that n >= 2 sets are on."""
    many = materialise(buckets.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "paths")
    return materialise(buckets.join(many, "path"), "buckets")


def deeper(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """(path, rep) of the children of buckets (path, rep)."""
    def run(batches) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            reps, paths = [], []
            for r in batch.to_pylist():
                found = np.unique(extend(np.array(r["paths"], dtype=np.int64).view(np.uint64), np.frombuffer(r["tokens"], dtype=np.uint64))[1])
                paths += _signed(found)
                reps += [r["rep"]] * len(found)
            yield pa.record_batch([pa.array(paths, pa.int64()), pa.array(reps, pa.int64())], ["path", "rep"])

    by_set = buckets.groupBy("rep").agg(F.collect_list("path").alias("paths"))
    return by_set.join(sets.select("rep", "tokens"), "rep").select("rep", "paths", "tokens").mapInArrow(run, "path long, rep long")


def token_table(df: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """rep, tokens, copies of the sets wanted (rep, rep_id, set, copies), from one text of each, dealt out by rep. Few sets go
    to the texts; beyond BROADCAST_SETS texts and ids are shuffled to meet."""
    import pyarrow as pa
    udf = per_batch(lambda texts: [(_signature(t), t.tobytes()) for t in _token_sets(texts)], "found string, tokens binary", [pa.string(), pa.binary()], once=True)
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias("_key")
    texts = df.select(key(doc_id), text_of(text).alias("_text"))
    few = wanted.select(key("rep_id"), "rep", "set", "copies")
    few = F.broadcast(few) if wanted.count() <= BROADCAST_SETS else few
    met = texts.join(few, "_key").withColumn("_s", udf(F.col("_text"))).filter(F.col("_s.found") == F.col("set"))
    return met.select("rep", F.col("_s.tokens").alias("tokens"), "copies").dropDuplicates(["rep"])


_MEMBER = ["rep", "block", "size", "counts", "below"]


def in_blocks(buckets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, rep, block, wide, parts), for buckets of one wide block and for larger ones: sets are dealt into blocks by
    hash, and WIDE blocks form a wide one."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = buckets.withColumn("parts", F.ceil(blocks / WIDE).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    rows = rows.withColumn("wide", F.floor(F.col("block") / WIDE).cast("int")).drop("n")
    return rows.filter("parts = 1"), rows.filter("parts > 1")


def packed_groups(rows: DataFrame) -> DataFrame:
    """(path, low, high, members) of large buckets: a wide block of sets is one row, and each pair of wide blocks meets in
    one group (low, high), sorted. So a group holds about 2 * WIDE * BLOCK sets at most, in two rows."""
    block = rows.groupBy("path", "wide").agg(F.collect_list(F.struct(*_MEMBER)).alias("members"), F.first("parts").alias("parts"))
    pairs = block.select("path", "wide", "members", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    key = ["path", "low", "high"]
    dealt = pairs.select("path", F.least("wide", "other").alias("low"), F.greatest("wide", "other").alias("high"), "members")
    return dealt.repartition(*key).sortWithinPartitions(*key)


def smaller_paths(rows: DataFrame) -> DataFrame:
    """`below`, the set's paths that are smaller than the row's, in place of all of them: nothing else of the sorted list
    decides whether a pair has met before."""
    return rows.withColumn("below", F.slice("all_paths", F.lit(1), (F.array_position("all_paths", F.col("path")) - 1).cast("int"))).drop("all_paths")


def _groups(batches) -> Iterator[list[dict]]:
    """Rows of one (path, low, high) at a time, from sorted batches; a packed row stands for its members. Rows without
    (low, high) are of a bucket that is one group."""
    key, held = None, []
    for batch in batches:
        packed = "members" in batch.schema.names
        for r in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()) if packed else batch.to_pylist():
            here = (r["path"], r.get("low", 0), r.get("high", 0))
            if here != key and held:
                yield held
                held = []
            key = here
            held += [{**m, "path": here[0], "low": here[1], "high": here[2]} for m in r["members"]] if packed else [{"low": 0, "high": 0, **r}]
    if held:
        yield held


def _common(rows: np.ndarray, values: np.ndarray, n: int, kind: type = np.float32, columns: int = 4096) -> np.ndarray:
    """How many values each two of n rows have in common, by products of 0/1 matrices over the values that several rows
    have; (rows[i], values[i]) are distinct."""
    total = np.zeros((n, n), dtype=kind)
    if not len(values):
        return total
    _, inverse, count = np.unique(values, return_inverse=True, return_counts=True)
    number = np.full(len(count), -1, dtype=np.int64)
    several = np.flatnonzero(count > 1)
    number[several] = np.arange(len(several))
    place = number[inverse]
    rows, place = rows[place >= 0], place[place >= 0]
    order = np.argsort(place, kind="stable")
    rows, place = rows[order], place[order]
    for at in range(0, len(several), columns):
        a, b = np.searchsorted(place, [at, at + columns])
        part = np.zeros((n, min(columns, len(several) - at)), dtype=np.float32)
        part[rows[a:b], place[a:b] - at] = 1
        total += part @ part.T
    return total


def _first_meeting(group: list[dict], width: int = 1) -> np.ndarray:
    """Which pairs of a group share no smaller bucket and stand in the blocks, `width` blocks wide, that the group is for."""
    n = len(group)
    block = np.array([r["block"] for r in group]) // width
    wanted = np.ones((n, n), dtype=bool) if group[0]["low"] == group[0]["high"] else block[:, None] != block[None, :]
    np.fill_diagonal(wanted, False)
    held = [len(r["below"]) for r in group]
    paths = np.fromiter((p for r in group for p in r["below"]), dtype=np.int64, count=sum(held))
    return wanted & (_common(np.repeat(np.arange(n), held), paths, n) == 0)


def _may_link(group: list[dict]) -> np.ndarray:
    """Which pairs can be similar enough by their sizes and by what they hold in each part of the hash range."""
    size = np.array([r["size"] for r in group])
    counts = np.array([np.frombuffer(r["counts"], dtype=np.uint8) for r in group]).astype(np.int32)
    counts[counts == 255] = 1 << 24
    low = np.minimum(size[:, None], size[None, :])
    may = (ABOVE + BELOW) * low >= ABOVE * (size[:, None] + size[None, :])
    for i in range(len(group)):
        at = np.flatnonzero(may[i])
        most = np.minimum(low[i, at], np.minimum(counts[i], counts[at]).sum(axis=1))
        may[i, at] = (ABOVE + BELOW) * most >= ABOVE * (size[i] + size[at])
    return may


def _pairs_of_blocks(group: list[dict], wanted: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(path, low, high, block, rep) of the sets that have a wanted pair, for each pair of blocks on its own."""
    block = np.array([r["block"] for r in group])
    for low in np.unique(block):
        ours = np.flatnonzero(block == low)
        for high in np.unique(block[wanted[ours].any(axis=0)]):
            if high < low:
                continue
            theirs = np.flatnonzero(block == high)
            here = wanted[np.ix_(ours, theirs)]
            sets = {*ours[here.any(axis=1)].tolist(), *theirs[here.any(axis=0)].tolist()}
            for i in sorted(sets):
                yield group[i]["path"], int(low), int(high), int(block[i]), group[i]["rep"]


def _needed(batches) -> Iterator:
    """(path, low, high, block, rep) of the sets that have a pair to compare in a pair of blocks (low, high)."""
    import pyarrow as pa
    names = ["path", "low", "high", "block", "rep"]
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in out], pa.int64()) for i in range(len(names))], names)

    for group in _groups(batches):
        if len(group) == 2:  # the usual case, without arrays
            a, b = group
            low, high = sorted((a["size"], b["size"]))
            if (ABOVE + BELOW) * low < ABOVE * (low + high) or (a["low"] != a["high"] and a["block"] // WIDE == b["block"] // WIDE):
                continue
            if not set(a["below"]).isdisjoint(b["below"]) or not _may_link(group)[0, 1]:
                continue
            wanted = ~np.eye(2, dtype=bool)
        else:
            wanted = _first_meeting(group, WIDE)
            some = np.flatnonzero(wanted.any(axis=1))  # sets that have met all others before are compared no more
            if not len(some):
                continue
            group, wanted = [group[i] for i in some], wanted[np.ix_(some, some)]
            wanted &= _may_link(group)
        out += _pairs_of_blocks(group, wanted)
        if len(out) > 20_000:
            yield batch()
            out.clear()
    yield batch()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections."""
    return _common(np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets), len(sets), np.float64)


def _compare(batches) -> Iterator:
    """(rep, links, root): documents linked to the set in its group, and the smallest set of its linked part there."""
    import pyarrow as pa
    out: list[list[int]] = [[], [], []]
    for group in _groups(batches):
        sets = [np.frombuffer(r["tokens"], dtype=np.uint64) for r in group]
        size = np.array([len(s) for s in sets])
        if len(group) == 2:
            both = len(np.intersect1d(*sets, assume_unique=True))
            linked = np.array([[False, True], [True, False]]) & ((ABOVE + BELOW) * both >= ABOVE * size.sum())
        else:
            linked = _first_meeting(group)
            linked &= (ABOVE + BELOW) * overlaps(sets) >= ABOVE * (size[:, None] + size[None, :])
        if not linked.any():
            continue
        links = linked @ np.array([r["copies"] for r in group])
        reps = np.array([r["rep"] for r in group])
        root = reps.copy()
        while True:  # the smallest of the linked part spreads
            low = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (low == root).all():
                break
            root = low
        for i in np.flatnonzero(linked.any(axis=1)):
            for column, value in zip(out, (reps[i], links[i], root[i])):
                column.append(int(value))
        if len(out[0]) > 20_000:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], ["rep", "links", "root"])
            out = [[], [], []]
    yield pa.record_batch([pa.array(c, pa.int64()) for c in out], ["rep", "links", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges (a, b): root is the smallest node of the connected part.

    Each round every label hooks onto the smallest label next to it, hooks are followed twice, and edges move to the new
    labels; edges inside one label vanish. Labels and edges are stored each round, so plans don't grow.
    """
    edges = materialise(edges.filter("a <> b").distinct(), "edges")
    labels = materialise(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("b"))
        for _ in range(2):
            hook = materialise(hook, "hooks")
            again = hook.select(F.col("a").alias("b"), F.col("b").alias("_b"))
            hook = hook.join(again, "b", "left").select("a", F.coalesce("_b", "b").alias("b"))
        hook = materialise(hook, "hooks")
        labels = materialise(labels.join(hook, F.col("root") == F.col("a"), "left").select("node", F.coalesce("b", "root").alias("root")), "labels")
        to = hook.select(F.col("a").alias("_from"), F.col("b").alias("_to"))
        for side in ("a", "b"):
            edges = edges.join(to, edges[side] == F.col("_from"), "left").withColumn(side, F.coalesce("_to", side)).select("a", "b")
        edges = materialise(edges.filter("a <> b").distinct(), "edges")
    return labels


def links(df: DataFrame, doc_id: str = "doc_id", text: str = "text", recall: float = RECALL, row: str | None = None) -> DataFrame:
    """One row per input row: doc_id, class_id, set_id, n_links, kept.

    Two texts are linked when the Jaccard similarity of their sets of five-word shingles is at least 0.8 (a text with
    fewer words, but some, is one shingle; one without words, null and empty ones too, is linked to none). n_links counts
    the linked rows, copies included; class_id is the smallest id of all rows that links connect, set_id that of the rows
    with the same set; kept marks one row of a class, that of the smallest id. A null id is larger than any. Rows that
    repeat are copies of each other. Only the id and the text are read. An empty table gives no rows. With `row`, the name
    of a column of distinct longs, that column is returned too.
    """
    rows, classes = class_of_sets(df, doc_id, text, runs_for(recall), row)
    firsts = classes.filter("_row = rep").select("rep", "rep_id", "set", "copies")
    start = rows.select(F.col("_row").alias("rep"), "paths").join(firsts.select("rep"), "rep")
    level = shared(start.select(F.explode("paths").alias("path"), "rep"))
    final = level.filter(F.col("n") <= BUCKET)
    for depth in range(FIRST, LAST):
        hot = level.filter(F.col("n") > BUCKET)
        if hot.isEmpty():
            break
        if depth == FIRST:
            wanted = materialise(firsts.join(hot.select("rep").distinct(), "rep"), "hot")
            sets = materialise(token_table(df, doc_id, text, wanted), "tokens")
        level = shared(deeper(hot, sets))
        final = final.union(level.filter(F.col("n") <= BUCKET))
    final = materialise(final.union(level.filter(F.col("n") > BUCKET)), "final")

    lists = materialise(final.groupBy("rep").agg(F.sort_array(F.collect_list("path")).alias("all_paths")), "lists")
    key = ["path", "low", "high"]
    seen = lists.join(rows.select(F.col("_row").alias("rep"), "size", "counts"), "rep")
    one, large = (smaller_paths(b.join(seen, "rep")) for b in in_blocks(final))
    one = one.select("path", *_MEMBER).repartition("path").sortWithinPartitions("path", "rep")
    pairs = "path long, low long, high long, block long, rep long"
    needed = materialise(one.mapInArrow(_needed, pairs).union(packed_groups(large).mapInArrow(_needed, pairs)), "needed")
    sets = token_table(df, doc_id, text, materialise(firsts.join(needed.select("rep").distinct(), "rep"), "wanted"))
    full = smaller_paths(needed.join(sets.join(lists, "rep"), "rep")).repartition(*key).sortWithinPartitions(*key, "rep")
    found = materialise(full.mapInArrow(_compare, "rep long, links long, root long"), "links")

    part = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    ids = classes.filter("_row = rep").select(F.col("rep").alias("node"), F.struct(F.col("rep_id").isNull().alias("void"), F.col("rep_id").alias("id"), F.col("rep").alias("row")).alias("_first"))
    lowest = part.join(ids, "node").groupBy("root").agg(F.min("_first").alias("_first"))
    linked = part.join(materialise(lowest, "lowest"), "root").select(F.col("node").alias("rep"), "_first")
    total = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of_rep = materialise(linked.join(total, "rep"), "linked")
    out = classes.join(of_rep, "rep", "left")
    first = F.coalesce(F.col("_first.row"), F.col("rep"))
    return out.select(F.col("doc_id").alias(doc_id), F.when(F.col("_first").isNotNull(), F.col("_first.id")).otherwise(F.col("rep_id")).alias("class_id"),
                      F.col("rep_id").alias("set_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), (first == F.col("_row")).alias("kept"), *([F.col("_row").alias(row)] if row else []))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, with all columns of the input, which is stored once with a number for each row."""
    stored = numbered(df)
    rows = stored.select(F.col(f"_all.{doc_id}").alias("doc_id"), F.col(f"_all.{text}").alias("text"), "_place")
    gone = links(rows, row="_place").filter(~F.col("kept")).select("_place")
    return stored.join(materialise(gone, "gone"), "_place", "left_anti").select("_all.*")
