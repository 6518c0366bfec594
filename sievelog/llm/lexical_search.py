"""Ranked lexical search without an index: one automaton holds the terms of all items, each between two guards, and is sent
to every task; a document's term frequencies come from streaming its text through the automaton, and each term found
leads to the items that ask for it.

A first pass counts documents, their lengths and in how many documents each term stands; a second pass scores. A task keeps
the best documents of each item as it goes, so it sends at most `top` rows an item whatever it reads.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sievelog.llm.common import text_of
from sievelog.sources.store import materialise

#: Bytes of item text whose terms share an automaton. More items make more blocks, each with passes of its own.
BLOCK_BYTES = 4 << 20
#: Cells (document, item), and rows (document, term, item), that a scoring step holds.
CELLS = 4_000_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Characters that stand in no term.
_APART = "\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F"
#: What the automaton reads: A-Z in lower case, and a guard for each byte outside a term.
_GUARDED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).translate(bytes.maketrans(_UPPER.encode(), _UPPER.lower().encode()))
LAST = 2**63 - 1


def guarded(text: str) -> bytes:
    return b" " + text.encode().translate(_GUARDED) + b" "


def terms_of(text: Column) -> Column:
    """Distinct terms of a text column."""
    return F.array_distinct(F.regexp_extract_all(F.translate(text, _UPPER, _UPPER.lower()), F.lit(f"[^{_APART}]+"), F.lit(0)))


def weight(n_docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


class Questions:
    """Items of one block: their terms as an automaton, and for each term the items that ask for it
    (`asked[first[t]:first[t + 1]]`)."""

    def __init__(self, rows: list[tuple[object, list[str]]]):
        import ahocorasick
        self.items = [item for item, _ in rows]
        number: dict[str, int] = {}
        pairs = [(number.setdefault(t, len(number)), i) for i, (_, terms) in enumerate(rows) for t in terms]
        self.terms = list(number)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for term, t in number.items():
            self.automaton.add_word(f" {term} ", t)
        self.automaton.make_automaton()
        both = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
        self.asked = both[:, 1]
        self.first = np.searchsorted(both[:, 0], np.arange(len(self.terms) + 1))

    def frequencies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(terms of each text with repeats, then text, term and frequency of each term found)."""
        size, n, keys = len(self.terms), np.zeros(len(texts), dtype=np.int64), []
        for i, text in enumerate(texts):
            raw = guarded(text)
            n[i] = len(raw.split())
            if n[i] and size:
                keys.append(np.fromiter((t for _, t in self.automaton.iter(raw.decode())), dtype=np.int64) + i * size)
        key, tf = np.unique(np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64), return_counts=True)
        return n, key // max(size, 1), key % max(size, 1), tf


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, list]:
    """Items with their terms, stored, in blocks of at most `block_bytes` bytes and one item; and the blocks' numbers."""
    items = benchmark.select(F.col(item_id).alias("item"), text_of(text).alias("_text"))
    total = items.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    dealt = items.repartition(max(1, math.ceil(total / block_bytes))).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    before = F.sum(F.octet_length("_text")).over(Window.partitionBy("_part").orderBy("_row")) - F.octet_length("_text")
    cut = dealt.withColumn("block", F.floor(F.coalesce(before, F.lit(0)) / block_bytes)).select("item", "_part", "block", terms_of(F.col("_text")).alias("terms"))
    stored = materialise(cut, "questions")
    return stored, [tuple(r) for r in stored.select("_part", "block").distinct().collect()]


def statistics(docs: DataFrame, held, size: int) -> tuple[int, int, np.ndarray]:
    """(documents with a term, their terms with repeats, documents that hold each of the block's terms). Each task counts in
    a vector of the block's terms, and at most one sum a term comes back."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions, total = held.value, np.zeros(size + 2, dtype=np.int64)
        for batch in batches:
            n, _, term, _ = questions.frequencies(batch.column(1).to_pylist())
            total[:size] += np.bincount(term, minlength=size)[:size]
            total[size:] += (np.count_nonzero(n), n.sum())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["t", "n"])

    out = np.zeros(size + 2, dtype=np.int64)
    for t, n in docs.mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n")).collect():
        out[t] = n
    return int(out[size]), int(out[size + 1]), out[:size]


class Best:
    """The `top` best (item, score, document) of each item among those seen; equal scores by ascending document."""

    def __init__(self, items: int, top: int):
        self.top, self.rows, self.size = top, [], 0
        self.least = np.zeros(items, dtype=np.int64)  # a score below is out

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        doc, item = np.nonzero((scores > 0) & (scores >= self.least))
        self.rows.append((item, scores[doc, item], ids[doc]))
        self.size += len(doc)
        if self.size > 2 * self.top * len(self.least) + 100_000:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        item, score, doc = (np.concatenate(c) for c in zip(*self.rows)) if self.rows else (np.zeros(0, dtype=np.int64),) * 3
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = rank < self.top
        full = rank == self.top - 1
        self.least[item[full]] = score[full]
        self.rows, self.size = [(item[keep], score[keep], doc[keep])], int(keep.sum())
        return self.rows[0]


def _score(docs: DataFrame, held, weights: np.ndarray, n_docs: int, length: int, top: int) -> DataFrame:
    """Rows (number of the item in its block, score, document): the best of each task."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions = held.value
        items = len(questions.items)
        best, fan = Best(items, top), np.diff(questions.first)
        step = max(1, CELLS // max(items, 1))
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for lo in range(0, len(texts), step):
                n, doc, term, tf = questions.frequencies(texts[lo:lo + step])
                scores = np.zeros(len(n) * items, dtype=np.int64)
                m = 10 + 90 * n * n_docs // max(length, 1)
                part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                spread = np.cumsum(fan[term])
                for a, b in _steps(spread):
                    count = fan[term[a:b]]
                    where = np.repeat(questions.first[term[a:b]] - np.cumsum(count) + count, count) + np.arange(count.sum())
                    np.add.at(scores, np.repeat(doc[a:b] * items, count) + questions.asked[where], np.repeat(part[a:b], count))
                best.add(scores.reshape(len(n), items), ids[lo:lo + step])
        item, score, doc = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(score), pa.array(doc)], ["item", "score", "doc"])

    return docs.mapInArrow(run, "item long, score long, doc long")


def _steps(spread: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of runs of terms that fan out to about CELLS rows each."""
    a, done = 0, 0
    while a < len(spread):
        b = max(a + 1, int(np.searchsorted(spread, done + CELLS, side="right")))
        yield a, b
        a, done = b, int(spread[b - 1])


def search(docs: DataFrame, benchmark: DataFrame, top: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the `top` documents of each item with a score above 0.

    Null and empty texts have no terms: such documents are never found and such items find nothing. Equal scores go by
    ascending id, a null id being larger than any; rows that repeat an id are documents of their own, and so are items.
    Empty tables give no rows. Only the ids and texts are read, so other columns can't clash. Document ids are integers.

    The items travel in blocks of `block_bytes`; a block's automaton and the counts of its terms are all that is sent.
    """
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("_id"), text_of(text).alias("_text"))
    stored, numbers = blocks(benchmark, item_id, text, block_bytes)
    kind = stored.schema["item"].dataType.simpleString()
    found = []
    for part, block in numbers:
        questions = Questions([(r["item"], r["terms"]) for r in stored.filter((F.col("_part") == part) & (F.col("block") == block)).collect()])
        held = spark.sparkContext.broadcast(questions)
        n_docs, length, holding = statistics(texts, held, len(questions.terms))
        weights = np.array([weight(n_docs, int(h)) for h in holding], dtype=np.int64)
        rows = _score(texts, held, weights, n_docs, length, top)
        names = spark.createDataFrame(list(enumerate(questions.items)), f"item long, name {kind}")
        order = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
        best = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        found.append(best.join(F.broadcast(names), "item").select(
            F.col("name").alias(item_id), "rank", F.when(F.col("doc") < LAST, F.col("doc")).alias(doc_id), "score"))
    if not found:
        return spark.createDataFrame([], f"{item_id} {kind}, rank int, {doc_id} long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
