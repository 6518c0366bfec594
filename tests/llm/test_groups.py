"""Operators that bring texts together: copies, near copies, archives and the pipeline."""

import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievelog.llm import chosen_path, exact_dedup, warc
from sievelog.llm.common import salted_groups
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def words(pick, n):
    return [f"w{pick.randint(0, 5000)}" for _ in range(n)]


def test_hashes_combine_in_any_way():
    pick = random.Random(1)
    raw = bytes(pick.randrange(256) for _ in range(200_000))
    for p in exact_dedup.PRIMES:
        whole = exact_dedup.fingerprint(raw, p)
        value, at = (0, 1), 0
        while at < len(raw):
            n = pick.randint(1, exact_dedup.CHUNK)
            value, at = exact_dedup.combine(value, exact_dedup.chunk_value(raw[at:at + n], p), p), at + n
        slow = 0
        for b in raw[:5000]:
            slow = (slow * exact_dedup.BASE + b + 1) % p
        assert value[0] == whole and exact_dedup.fingerprint(raw[:5000], p) == slow


def test_chunks_as_rows(spark):
    raw, p = b"some bytes of a huge document" * 50, exact_dedup.PRIMES[0]
    rows = [(1, i, *exact_dedup.chunk_value(raw[i * 100:i * 100 + 100], p)) for i in range(len(raw) // 100 + 1)]
    got = exact_dedup.combine_chunks(spark.createDataFrame(rows[::-1], "d long, number long, hash long, shift long"), ["d"]).first()
    assert got["hash"] == exact_dedup.fingerprint(raw, p)


def check_copies(spark, rows, **more):
    got = exact_dedup.dedup(spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit(1)).repartition(3), **more).collect()
    by = {}
    for i, t in rows:
        by.setdefault(exact_dedup.normal((t or "").encode()), []).append(i)
    want = sorted(((i is None, i), min((x for x in v if x is not None), default=None), len(v)) for v in by.values() for i in v)
    assert sorted(((r["doc_id"] is None, r["doc_id"]), r["keep_id"], r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(by)


def test_copies(spark):
    big = "x y " * 60_000
    rows = [(5, "a  b"), (2, "a b"), (2, "a b"), (None, "a\tb"), (1, None), (9, ""), (7, " "), (8, "é"), (3, big), (4, big.replace("y", "\n y")), (6, big + "z")]
    check_copies(spark, rows + [(100 + i, "hot copy") for i in range(300)])
    check_copies(spark, [])
    check_copies(spark, [(None, None), (None, None)])


def test_colliding_fingerprints_are_told_apart(spark):
    check_copies(spark, [(i, f"t{i % 40:02d}") for i in range(120)], primes=(3, 3))


def test_first_copies_keep_other_columns(spark, tmp_path):
    rows = [(1, "a", 1), (1, "a", 2), (1, "b", 3), (None, "a", 4)]
    spark.createDataFrame(rows, "doc_id long, text string, _place long").write.parquet(str(tmp_path / "d"))
    df = exact_dedup.keep_first(spark.read.parquet(str(tmp_path / "d")))
    assert df.columns == ["doc_id", "text", "_place"] and sorted((r[0], r[1]) for r in df.collect()) == [(1, "a"), (1, "b")]


@pytest.mark.parametrize("keep", [exact_dedup.keep_first, chosen_path.keep_one])
def test_kept_rows_hold_when_splits_move(spark, tmp_path, keep):
    """The splits of the input are others when the result is read than when it was decided."""
    rows = [(i, f"some words of text number {i % 30} and more") for i in range(60)]
    spark.createDataFrame(rows, SCHEMA).repartition(12, "doc_id").write.parquet(str(tmp_path / "d"))
    name, before = "spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.openCostInBytes")
    least = spark.conf.get("spark.sql.files.minPartitionNum", None)
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        df = keep(spark.read.parquet(str(tmp_path / "d")))
        spark.conf.set("spark.sql.files.minPartitionNum", "12")
        spark.conf.set(name, "1g")
        assert sorted(r["doc_id"] for r in df.collect()) == list(range(30))
    finally:
        spark.conf.set(name, before)
        spark.conf.set("spark.sql.files.minPartitionNum", least) if least else spark.conf.unset("spark.sql.files.minPartitionNum")


def check_links(spark, rows):
    got = chosen_path.links(spark.createDataFrame(rows, SCHEMA).withColumn("links", F.lit(1)).repartition(3)).collect()
    pairs = brute.links([t for _, t in rows])
    ids = [i for i, _ in rows]
    part = brute.groups(ids, [(ids[a], ids[b]) for a, b in pairs])
    count = {i: 0 for i in ids}
    for a, b in pairs:
        count[ids[a]] += 1
        count[ids[b]] += 1
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == {i: (part[i], count[i]) for i in ids}
    assert {r["doc_id"] for r in got if r["kept"]} == set(part.values())
    return got


def test_near_copies_equal_brute_force(spark):
    pick, rows = random.Random(2), []
    for _ in range(25):
        base = words(pick, pick.choice([4, 5, 9, 60, 300]))
        for _ in range(pick.randint(1, 5)):
            here = list(base)
            for _ in range(pick.randint(0, 4)):
                here[pick.randrange(len(here))] = f"n{pick.randint(0, 99999)}"
            rows.append(" ".join(here))
    rows += [None, "", "...", "one", "one", "One!"]
    check_links(spark, [(1000 - i, t) for i, t in enumerate(rows)])
    assert chosen_path.links(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_hot_group_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "BUCKET", 20)
    monkeypatch.setattr(chosen_path, "BLOCK", 16)
    pick = random.Random(3)
    base, line = words(pick, 200), words(pick, 12)
    rows = []
    for i in range(120):
        here = list(base)
        for k in pick.sample(range(200), pick.randint(0, 6)):
            here[k] = f"n{pick.randint(0, 99999)}"
        rows.append(" ".join(here))
    rows += [" ".join(words(pick, 20) + line + words(pick, 5)) for _ in range(80)]  # one common line
    rows += [" ".join(base)] * 50
    got = check_links(spark, list(enumerate(rows)))
    assert max(r["n_links"] for r in got) > 49


def test_runs_reach_the_recall():
    """Two sets of a similarity of 0.8 meet in a run as often as the number of runs assumes."""
    pick, met = np.random.default_rng(4), 0
    runs = chosen_path.runs_for()
    for _ in range(300):
        x = pick.integers(1, 2 ** 63, 100).astype(np.uint64)
        y = np.unique(np.concatenate([x[:89], pick.integers(1, 2 ** 63, 11).astype(np.uint64)]))
        a, b = (chosen_path.first_paths(np.unique(s), runs) for s in (x, y))
        met += bool(len(np.intersect1d(a, b)))
    assert met >= 298


def test_no_pair_is_lost_on_the_longest_paths():
    """Sets of a similarity of 0.8, one inside the other, whose common paths all go on to the end."""
    pick, runs, lost = np.random.default_rng(7), chosen_path.runs_for(), 0
    for _ in range(6000):
        big = np.unique(pick.integers(1, 2 ** 63, 40).astype(np.uint64))
        shared = np.intersect1d(chosen_path.first_paths(big, runs), chosen_path.first_paths(big[:32], runs))
        for _ in range(chosen_path.FIRST, chosen_path.LAST):
            shared = np.intersect1d(chosen_path.extend(shared, big)[1], chosen_path.extend(shared, big[:32])[1])
        lost += not len(shared)
    assert lost == 0
    meet = 1.0
    for _ in range(chosen_path.LAST):
        meet = 1 - np.exp(-0.8 / chosen_path.SPLIT * meet)
    assert 5000 * 4999 / 2 * (1 - meet) ** runs < 1  # all pairs of a group of 5000


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in chosen_path.components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert chosen_path.components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("run", [exact_dedup.keep_first, chosen_path.keep_one])
def test_a_stage_calls_python_once_a_text(spark, monkeypatch, run):
    plans = {}

    def stored(module):
        def keep(df, name, store=module.materialise):
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
            return store(df, name)
        monkeypatch.setattr(module, "materialise", keep)

    for module in (exact_dedup, chosen_path):
        stored(module)
    monkeypatch.setattr(chosen_path, "BUCKET", 2)
    pick = random.Random(7)
    texts = [" ".join(words(pick, 40)) for _ in range(3)]
    rows = [(i, f"{texts[i % 3]} end{i // 6}") for i in range(30)]
    got = run(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == (15 if run is exact_dedup.keep_first else 3)
    seen = {name: plan.count("ArrowEvalPython") for name, plan in plans.items() if "ArrowEvalPython" in plan}
    assert seen == ({"fingerprints": 1, "collisions": 1} if run is exact_dedup.keep_first else {"sets": 1, "tokens": 1, "links": 1})


def test_salted_groups(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(900)], "id long, k string")
    got = salted_groups(rows, ["k"], F.col("id"), {"low": ("min", "id"), "n": ("count", "*")}).collect()
    assert len(got) == 900 and {(r["low"], r["n"]) for r in got if r["k"] == "hot"} == {(1, 600)}


PAGES = "page_id long, url string, html string"


def test_archives_round_trip(spark):
    big = "".join(chr(random.Random(5).randrange(32, 0x2FFF)) for _ in range(50_000))
    rows = [(1, "u", "a"), (2, None, "a"), (3, "v\r\nX: y", None), (4, "w", ""), (5, "z", big), (6, "z", big), (7, "q", "é" * 40), (8, "gz", "\x1f\x8b\x08 WARC/1.1\r\n\r\n")]
    got = {r["page_id"]: r for r in warc.round_trip(spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit(1)).repartition(3)).collect()}
    for i, _, t in rows:
        raw = (t or "").encode()
        same = max(j for j, _, x in rows if (x or "") == (t or ""))
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), warc.base32_sha1(raw))
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if same == i else ("revisit", same))
    again = warc.round_trip(spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (None, "u", "a")], PAGES)).collect()
    assert sorted(r["record_type"] for r in again) == ["response", "revisit", "revisit"]
    small = warc.round_trip(spark.createDataFrame(rows, PAGES), min_bytes=10).filter("record_type = 'revisit'").collect()
    assert [r["page_id"] for r in small] == [5]
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_records_belong_to_one_range():
    noise = random.Random(6)
    payloads = [bytes(noise.randrange(256) for _ in range(noise.randint(0, 3000))) + warc.MAGIC * 3 for _ in range(40)]
    raw = b"".join(warc.member(i, "u", p, warc.base32_sha1(p), None, False) for i, p in enumerate(payloads))
    for step in (1, 97, 1000, 10 ** 9)[1:]:
        for read in (64, 4096):
            got = [int(h["WARC-Page-ID"]) for at in range(0, len(raw), step) for _, h, _ in warc.records(Source(raw), at, at + step, read)]
            assert got == list(range(40))
    plain = zlib.decompress(raw, 31)
    assert plain.startswith(b"WARC/1.1\r\n")


def test_pipeline_equals_its_parts(spark, tmp_path):
    """What the stages keep, against brute force on their own input."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = sorted(docs.collect())
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = sorted(docs.collect(), key=lambda r: r["doc_id"])
        if k == 4:
            assert [r["doc_id"] for r in after] == [r["doc_id"] for r in before]
            continue
        assert docs.columns == corpus_pipeline_columns and set(after) <= set(before)
        if k == 0:
            assert len(after) >= 0.97 * len(before)
        if k == 1:
            first = {}
            for r in before:
                first.setdefault(exact_dedup.normal((r["text"] or "").encode()), r)
            assert after == sorted(first.values())
        if k == 2:
            ids = [r["doc_id"] for r in before]
            part = brute.groups(ids, [(ids[a], ids[b]) for a, b in brute.links([r["text"] for r in before])])
            assert [r["doc_id"] for r in after] == sorted(set(part.values()))
        if k == 3:
            found = brute.windows(bench)
            clean = [r for r in before if not (lambda n, h, _: h and 20 * h >= n)(*brute.hits(r["text"], found))]
            assert after == clean


corpus_pipeline_columns = ["doc_id", "text", "lang", "source", "n_chars"]


def test_blocks_hold_every_pair_once(spark):
    """Of a bucket of several wide blocks each pair of sets meets in one group, of two packed rows; others are not copied."""
    n = 3 * chosen_path.WIDE * chosen_path.BLOCK
    buckets = spark.range(n).selectExpr("7L AS path", "id AS rep", f"{n}L AS n").union(spark.range(300).selectExpr("8L AS path", "id AS rep", "300L AS n"))
    one, large = chosen_path.in_blocks(buckets)
    assert one.count() == 300 == one.filter("path = 8").count() and large.count() == n
    packed = chosen_path.packed_groups(large.selectExpr("*", "1 AS size", "X'00' AS counts", "array(1L) AS below"))
    assert packed.count() == 9
    groups = list(chosen_path._groups(packed.toArrow().to_batches()))
    sizes = {(g[0]["low"], g[0]["high"]): len(g) for g in groups}
    assert len(groups) == len(sizes) == 6 and max(sizes.values()) < 2.2 * chosen_path.WIDE * chosen_path.BLOCK
    assert all(len({r["rep"] for r in g}) == len(g) and {r["block"] // chosen_path.WIDE for r in g} == {g[0]["low"], g[0]["high"]} for g in groups)
    inside = {i: sizes[i, i] for i in range(3)}
    pairs = sum(m * (m - 1) // 2 if a == b else inside[a] * inside[b] for (a, b), m in sizes.items())
    assert pairs == n * (n - 1) // 2


def test_pairs_of_blocks_name_every_wanted_pair():
    pick = np.random.default_rng(5)
    group = [{"path": 1, "rep": int(i), "block": int(pick.integers(0, 5))} for i in range(60)]
    wanted = pick.random((60, 60)) < 0.01
    wanted |= wanted.T
    np.fill_diagonal(wanted, False)
    named = {}
    for path, low, high, block, rep in chosen_path._pairs_of_blocks(group, wanted):
        assert low <= high and block in (low, high) and group[rep]["block"] == block
        assert rep not in named.setdefault((low, high), set())
        named[low, high].add(rep)
    for i, j in zip(*np.nonzero(wanted)):
        low, high = sorted((group[i]["block"], group[j]["block"]))
        assert {i, j} <= named[low, high]
    assert not list(chosen_path._pairs_of_blocks(group, np.zeros((60, 60), dtype=bool)))
