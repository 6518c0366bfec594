"""Repeated passages, aligned ids and ranked search against plain versions."""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelog.llm import alignment, lexical_search, phrase_automata


# ---- repeated passages ----

def passages(rows, window=20):
    """{row number: (words, removed words, kept text)}: each window of each row against all earlier ones."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    order = lambda i: math.inf if rows[i][0] is None else rows[i][0]
    held = defaultdict(set)
    for i, w in enumerate(split):
        for p in range(len(w) - window + 1):
            held[tuple(w[p:p + window])].add(order(i))
    out = {}
    for i, w in enumerate(split):
        gone, own = set(), set()
        for p in range(len(w) - window + 1):
            key = tuple(w[p:p + window])
            if min(held[key]) < order(i) or key in own:
                gone.update(range(p, p + window))
            own.add(key)
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def stripped(spark, rows, parts=3, **more):
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(rows)], "doc_id long, text string, n_words int").repartition(parts)
    got = phrase_automata.strip(df.drop("n_words") if not more else df, **more).collect()
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got), got


def same_passages(spark, rows, **more):
    got, full = stripped(spark, rows, **more)
    assert got == Counter((rows[i][0], *v) for i, v in passages(rows).items())
    for r in full:
        assert r["kept_sha256"] == hashlib.sha256(r["kept_text"].encode()).hexdigest()
        assert r["n_removed"] == sum(s["after"] - s["first"] for s in r["removed"])


@pytest.mark.parametrize("seed", range(4))
def test_passages_of_random_texts(spark, seed):
    rnd = random.Random(seed)
    base = [[rnd.choice("abcdefghijklmnop") * rnd.randint(1, 3) for _ in range(rnd.randint(15, 90))] for _ in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rnd.randint(0, 4)):
            own = rnd.choice(base)
            a = rnd.randrange(len(own))
            words += own[a:a + rnd.randint(1, 60)] if rnd.random() < 0.8 else [str(rnd.random())] * rnd.randint(1, 45)
        if words and rnd.random() < 0.3:
            words[rnd.randrange(len(words))] = "other"
        rows.append((i, rnd.choice([" ", "\n", "\t \r"]).join(words)))
    same_passages(spark, rows)


def test_passages_in_odd_tables(spark):
    line = " ".join(f"w{i}" for i in range(25))
    loop = " ".join(["x y z"] * 30)
    same_passages(spark, [(5, line), (5, line), (3, None), (None, line), (None, "a " + line), (1, ""), (2, " \n"), (7, "k " + line + " k"), (4, "w1 w2"),
                          (8, loop), (9, "q " + loop + " x"), (-2, "x " * 50), (10, "\xa0 é" * 30), (11, "\xa0 é" * 31)])
    assert stripped(spark, [])[0] == Counter()


def test_passages_of_a_long_text_cross_shards(spark):
    rnd = random.Random(9)
    long = [str(rnd.randrange(10 ** 6)) for _ in range(110_000)]
    half = long[35_000:45_000]
    same_passages(spark, [(2, " ".join(long)), (1, " ".join(half)), (3, " ".join(long[79_990:80_030])), (4, " ".join(long[:50] + long))])


def test_a_passage_of_most_rows_is_one_row_a_batch(spark):
    line = " ".join(f"w{i}" for i in range(40))
    docs = spark.range(4000, numPartitions=2).select(F.col("id").alias("doc_id"), F.concat(F.lit(line + " "), F.col("id")).alias("text"))
    asks = phrase_automata._asks(docs.select(F.col("doc_id").alias("_id"), "text"), ["_id", "text"], lambda r, _: (r.anchor[r.first], r.run, r.doc))
    met = asks.filter(F.col("known") == int(phrase_automata.LAST)).groupBy("key", "sub").count().agg(F.max("count")).first()[0]
    assert met <= 8
    rows = phrase_automata.strip(docs).groupBy("n_removed").count().collect()
    assert {r["n_removed"]: r["count"] for r in rows} == {0: 1, 40: 3999}


# ---- aligned ids ----

def aligned(docs):
    """Rows of the alignment from whole encodings by the libraries, every pair of tokens compared."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer
    left = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte_of, per = alignment._byte_of(), []
    for doc, text in docs:
        a, b = (left.encode(" " + text, add_special_tokens=False).ids, right.encode(text)) if text else ([], [])
        raw = [[bytes(byte_of[c] for c in left.id_to_token(i)) for i in a],
               [bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode() for i in b]]
        if not text or any(b"".join(x) != (" " + text).encode() for x in raw):
            per.append((doc, 0, 0, 0, [], ""))
            continue
        ends = [np.cumsum([len(t) for t in x]).tolist() for x in raw]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for k, ids in enumerate((a, b)):
            for i, end, t in zip(ids, ends[k], raw[k]):
                groups[bisect.bisect_left(cuts, end)][k].append((i, end - len(t), end))
        links = [(x[0], y[0]) for g in groups for x in g[0] for y in g[1] if x[1] < y[2] and y[1] < x[2]]
        shown = ";".join(",".join(str(x[0]) for x in g[0]) + "|" + ",".join(str(x[0]) for x in g[1]) for g in groups)
        per.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(shown.encode()).hexdigest()))
    count = Counter(x for p in per for x in set(p[4]))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return Counter((*p[:4], len(p[4]), sum(count[x] == best[x[0]] for x in p[4]), sum(count[x] for x in p[4]), p[5]) for p in per)


PARTS = [" ", "  ", "\t", "\n", "\x1c", "\x85", "\xa0", "▁", "　", "<s>", "<unk>", "<0x41>", "<|endoftext|>", "'s", "1", "23", "é", "ß", "Hello",
         "world", "ing", "aa", "a", "😀", "́", "\x00", "...", "_", "中文", "²", "﻿", "\U0010ffff"]


def ids_of(spark, docs):
    df = spark.createDataFrame([(a, b, 0) for a, b in docs], "doc_id long, text string, n_a int").repartition(3)
    return Counter(tuple(r) for r in alignment.align(df).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def test_alignment_of_odd_texts(spark):
    rnd = random.Random(4)
    docs = [(i, "".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 16)))) for i in range(1500)]
    docs += [(None, None), (1, ""), (1, "Hello world"), (1, "Hello world"), (2, "a" * 30_000), (3, " " * 3000 + "x"), (4, "word " * 60_000)]
    assert ids_of(spark, docs) == aligned(docs)


def test_alignment_of_an_empty_table(spark):
    assert not ids_of(spark, [])


def test_identity_links_do_not_enter_the_pairs(spark):
    both = alignment.pair("byte_bpe_50k.json", "piece_bpe_32k.model")
    df = spark.createDataFrame([(i, "The house stands near a river, and the word houseboat too") for i in range(20)], "doc_id long, text string")
    rows = alignment.encode(df, "byte_bpe_50k.json", "piece_bpe_32k.model")
    pairs = [tuple(r) for r in alignment.pair_counts(rows).collect()]
    assert all(both.same[a] != b and n == 20 for a, b, n in pairs)
    counts = alignment.identity_counts(rows, len(both.left_bytes))
    assert set(counts[counts > 0]) == {20} and (both.same[counts > 0] >= 0).all()


# ---- ranked search ----

def searched(docs, items, top=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    tf = [Counter(terms(t)) for _, t in docs]
    size = sum(1 for c in tf if c)
    length = sum(sum(c.values()) for c in tf)
    df = Counter(t for c in tf for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, _), c in zip(docs, tf):
            n = sum(c.values())
            m = 100 - 90 + (90 * n * size) // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scores.append((-score, math.inf if doc is None else doc))
        out += [(item, k, None if doc == math.inf else doc, -score) for k, (score, doc) in enumerate(sorted(scores)[:top], 1)]
    return Counter(out)


def found(spark, docs, items, **more):
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, rank string").repartition(3)
    q = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, score int")
    return Counter(tuple(r) for r in lexical_search.search(d, q, **more).select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("block", [40, 1 << 20])
def test_search_against_all_scores(spark, block):
    rnd = random.Random(7)
    words = ["the", "The", "a", "é", "É", "foo-bar", "x1", "naïve", "中文", "don't", "tail", "mid\x00dle", "ab", "abc"] + [f"t{i}" for i in range(40)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(rnd.randint(0, n)))
    docs = [(rnd.choice([i, i, i - 1]), text(40)) for i in range(120)] + [(None, "the t1 t2"), (None, None), (500, ""), (501, "-- ,"), (502, "tail " * 4000)]
    items = [(i, text(12)) for i in range(9)] + [(3, "the tail"), (None, "TAIL tail"), (77, None), (78, "absentword"), (79, "")]
    assert found(spark, docs, items, block_bytes=block) == searched(docs, items)


def test_search_in_empty_tables(spark):
    assert not found(spark, [], [(1, "a")]) and not found(spark, [(1, "a")], []) and not found(spark, [(1, None)], [(1, None)])


def test_ties_go_by_document(spark):
    docs = [(i, "same words here") for i in range(50, 0, -1)]
    assert sorted(k[2] for k in found(spark, docs, [(1, "same"), ])) == list(range(1, 11))


# ---- texts without letters ----

def test_signs_and_numbers_are_no_letters():
    from sievelog.llm import language
    for text in ("²", "½ ⅓", "①②", "Ⅷ", "12 _ 3", "\u0301\u0308", "٣", "😀", ""):
        assert language.letters(text) == "", text
    assert language.letters("E\u0301té 2²") == "e\u0301té" and language.letters("नमस्ते!") == "नमस्ते" and language.letters("ªº") == "ªº"
