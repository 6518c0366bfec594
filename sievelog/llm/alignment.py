"""Alignment of two tokenizers' ids over a corpus.

Tokens of both sides are byte ranges of one text; where tokens of both end at one byte, a group ends. A token that is alone
in its group on both sides has the same bytes on both, so an identity map, made once from the vocabularies, gives the other
side's id: such links are counted in vectors of the vocabulary's length, one a task. Only links that the identity map does
not give are shuffled as pairs.

Texts are encoded whole; their tokens are aligned a batch at a time, with array operations over the ends of tokens.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from sievelog.llm.common import shards, text_of
from sievelog.llm.sentencepiece import MARK, tokenizer_path
from sievelog.sources.store import materialise

#: Pairs that a task counts before it sends what it has.
PAIRS = 200_000


def _byte_of() -> dict[str, int]:
    """Characters that a byte-level vocabulary writes bytes as: printable ones stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers with the bytes of their ids. `same[a]` is the id of the other side with the bytes of `a`, or -1.

    The left file is a byte-level BPE whose ids follow its merges, so that ids are ranks and any encoder by ranks gives the
    file's own result; strings of its special tokens are plain text. The right file is a sentencepiece model."""

    def __init__(self, left: str, right: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        byte_of = _byte_of()
        with open(tokenizer_path(left), encoding="utf-8") as f:
            model = json.load(f)
        vocab, special = model["model"]["vocab"], {t["content"] for t in model["added_tokens"]}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
        made = [vocab[a + b] for a, b in merges]
        if model["pre_tokenizer"]["type"] != "ByteLevel" or made != sorted(made):
            raise ValueError("a byte-level vocabulary numbered by its merges is needed")
        self.left = tiktoken.Encoding(left, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.left_bytes = [b""] * (max(vocab.values()) + 1)
        for raw, i in ranks.items():
            self.left_bytes[i] = raw
        self.right = r = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(right))
        pieces = [r.id_to_piece(i) for i in range(r.get_piece_size())]
        self.right_bytes = [b"" if r.is_control(i) else bytes([int(p[3:5], 16)]) if r.is_byte(i) else p.replace(MARK, " ").encode()
                            for i, p in enumerate(pieces)]
        # a byte piece gives way to the plain piece with the same bytes
        by_bytes = {b: i for i, b in enumerate(self.right_bytes) if b and r.is_byte(i)}
        by_bytes |= {b: i for i, b in enumerate(self.right_bytes) if b and not r.is_byte(i) and not r.is_unknown(i)}
        self.same = np.array([by_bytes.get(b, -1) for b in self.left_bytes], dtype=np.int64)
        self._size = [np.array([len(b) for b in side], dtype=np.int64) for side in (self.left_bytes, self.right_bytes)]
        # ids as text after each mark that can stand before them
        most = max(len(self.left_bytes), len(self.right_bytes))
        self._shown = [mark + str(i) for mark in ("", ",", "|", ";") for i in range(most)]
        self._most = most

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids on both sides; None for a text without tokens."""
        if not text:
            return None
        a, b = self.left.encode_ordinary(" " + text), self.right.encode(text)
        raw, left, right = (" " + text).encode(), self.left_bytes, self.right_bytes
        if b"".join([left[i] for i in a]) != raw or b"".join([right[i] for i in b]) != raw:
            return None
        return a, b

    def align(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], tuple[np.ndarray, ...]]:
        """For each text ids on the left, on the right, groups, and the digest of its groups; and the distinct links of each
        text as arrays (text, left id, right id, how often)."""
        both = [self.encode(t) for t in texts]
        sides = [[x[k] if x else [] for x in both] for k in (0, 1)]
        count = [np.array([len(x) for x in side], dtype=np.int64) for side in sides]
        ids = [np.array([i for x in side for i in x], dtype=np.int64) for side in sides]
        end = [np.cumsum(size[i]) for size, i in zip(self._size, ids)]
        text = [np.repeat(np.arange(len(texts)), n) for n in count]
        if not len(ids[0]):
            none = np.zeros(0, dtype=np.int64)
            return *count, np.zeros(len(texts), dtype=np.int64), [""] * len(texts), (none,) * 4
        ends = np.zeros((2, end[0][-1] + 1), dtype=bool)  # by side: whether a token ends at a byte
        ends[0, end[0]] = ends[1, end[1]] = True
        closes = [ends[1, end[0]], ends[0, end[1]]]  # whether a group ends with a token
        group = [np.cumsum(c) - c for c in closes]
        groups = np.bincount(text[0][closes[0]], minlength=len(texts))

        # a link for each place where a token of either side ends
        at = np.flatnonzero(ends[0] | ends[1])
        place = [np.searchsorted(e, at) for e in end]
        key = (text[0][place[0]] * self._most + ids[0][place[0]]) * self._most + ids[1][place[1]]
        key, n = np.unique(key, return_counts=True)
        links = key // self._most ** 2, key // self._most % self._most, key % self._most, n

        # left ids of a group stand before its right ones, each with its mark
        total = int(group[0][-1]) + 1
        before = [np.concatenate(([0], np.cumsum(np.bincount(g, minlength=total)))) for g in group]
        slot = [np.arange(len(ids[0])) + before[1][group[0]], np.arange(len(ids[1])) + before[0][group[1] + 1]]
        new = [np.diff(g, prepend=-1) > 0 for g in group]
        mark = [np.where(new[0], 3, 1), np.where(new[1], 2, 1)]
        mark[0][(np.cumsum(count[0]) - count[0])[count[0] > 0]] = 0  # no mark before a text's first id
        shown = np.empty(len(ids[0]) + len(ids[1]), dtype=np.int64)
        for k in (0, 1):
            shown[slot[k]] = mark[k] * self._most + ids[k]
        parts = [self._shown[i] for i in shown.tolist()]
        digests, done = [], 0
        for n in (count[0] + count[1]).tolist():
            digests.append(hashlib.sha256("".join(parts[done:done + n]).encode()).hexdigest() if n else "")
            done += n
        return *count, groups, digests, links


_pairs: dict[tuple[str, str], Pair] = {}


def pair(left: str, right: str) -> Pair:
    """Both tokenizers, loaded once in a process."""
    if (left, right) not in _pairs:
        _pairs[left, right] = Pair(left, right)
    return _pairs[left, right]


_LINKS = "array<struct<a:int,b:int,n:bigint>>"


def encode(df: DataFrame, left: str, right: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the id, n_a, n_b, n_groups, groups_sha256, ids that the identity map links (with how often), and
    all other links. A link of the identity map's pair inside a larger group counts as one of its links."""
    import pyarrow as pa

    def lists(text: np.ndarray, rows: int, *columns: np.ndarray) -> pa.ListArray:
        """The entries of each text, which are sorted by text, as one list a text."""
        offsets = pa.array(np.searchsorted(text, np.arange(rows + 1)), pa.int32())
        fields = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64())[-len(columns):])]
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["a", "b", "n"][:len(columns) - 1] + ["n"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(left, right)
        for batch in batches:
            texts, done = batch.column(1).to_pylist(), []
            for start, part in shards([t.encode() for t in texts]):
                *counts, digests, (text, a, b, n) = both.align(texts[start:start + len(part)])
                same = both.same[a] == b
                done.append([*map(pa.array, counts), pa.array(digests, pa.string()), lists(text[same], len(part), a[same], n[same]),
                             lists(text[~same], len(part), a[~same], b[~same], n[~same])])
            if done:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.concat_arrays(c) for c in zip(*done)]],
                                                 ["_id", "n_a", "n_b", "n_groups", "groups_sha256", "same", "other"])

    docs = df.select(F.col(doc_id).alias("_id"), text_of(text).alias("_text"))
    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, same array<struct<a:int,n:bigint>>, other {_LINKS}")


def identity_counts(encoded: DataFrame, size: int) -> np.ndarray:
    """For each id on the left, how many documents link it to its identity partner. A task counts in one vector of the
    vocabulary's length; the vectors' entries are summed by id, and at most `size` sums come back."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().field("a").to_numpy(), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["a", "n"])

    out = np.zeros(size, dtype=np.int64)
    for a, n in encoded.select("same").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n")).collect():
        out[a] = n
    return out


def pair_counts(encoded: DataFrame) -> DataFrame:
    """Rows (a, b, count): how many documents hold each link that the identity map does not give. Tasks count first."""
    import pyarrow as pa

    def sent(counts: Counter) -> pa.RecordBatch:
        a, b = (pa.array(c, pa.int32()) for c in (zip(*counts) if counts else ((), ())))
        return pa.RecordBatch.from_arrays([a, b, pa.array(counts.values(), pa.int64())], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            links = batch.column(0).flatten()
            counts.update(zip(links.field("a").to_pylist(), links.field("b").to_pylist()))
            if len(counts) >= PAIRS:
                yield sent(counts)
                counts = Counter()
        yield sent(counts)

    return encoded.select("other").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("count"))


def _vector(spark, values: np.ndarray):
    """A vector of the vocabulary's length for all executors: 8 bytes an id."""
    return spark.sparkContext.broadcast(values)


def align(df: DataFrame, left: str = "byte_bpe_50k.json", right: str = "piece_bpe_32k.model", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and texts whose tokens' bytes differ from a space and the text, have no tokens: zeros, and the
    empty string as digest. The count of a pair of ids is the number of rows that link it; of equal highest counts of an
    id, each is a best one. Rows that repeat an id are separate documents. An empty table gives no rows. Only the id and
    the text are read, so other columns can't clash. Ids of rows may be of any type.

    The vectors of the identity map (one number an id of the left vocabulary) go through the driver and to every executor:
    their size is that of the vocabulary, whatever the corpus.
    """
    import pyarrow as pa
    spark, both = df.sparkSession, pair(left, right)
    size = len(both.left_bytes)
    encoded = materialise(encode(df, left, right, doc_id, text).withColumn("_row", F.monotonically_increasing_id()), "aligned")
    pairs = materialise(pair_counts(encoded), "pairs")
    counts = identity_counts(encoded, size)
    best = counts.copy()
    for a, n in pairs.groupBy("a").agg(F.max("count")).collect():  # at most one row an id
        best[a] = max(best[a], n)
    held, top = _vector(spark, counts), _vector(spark, best)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, most = held.value, top.value
        for batch in batches:
            lists = batch.column(1)
            ids, weights = (lists.flatten().field(c).to_numpy() for c in ("a", "n"))
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            sums = [np.zeros(len(lists), dtype=np.int64) for _ in range(3)]
            for total, each in zip(sums, (weights, weights * (count[ids] == most[ids]), weights * count[ids])):
                np.add.at(total, row, each)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums)], ["_row", "n_links", "n_best", "count_sum"])

    tops = spark.createDataFrame(list(enumerate(best.tolist())), "a int, most long")
    same = encoded.select("_row", "same").mapInArrow(totals, "_row long, n_links long, n_best long, count_sum long")
    links = encoded.select("_row", F.explode("other").alias("_l")).select("_row", "_l.*")
    met = links.join(pairs, ["a", "b"]).join(F.broadcast(tops), "a")
    other = met.select("_row", F.col("n").alias("n_links"), F.when(F.col("count") == F.col("most"), F.col("n")).otherwise(0).alias("n_best"),
                       (F.col("n") * F.col("count")).alias("count_sum"))
    sums = same.unionByName(other).groupBy("_row").agg(*[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])
    rows = encoded.select("_row", "_id", "n_a", "n_b", "n_groups", "groups_sha256").join(sums, "_row")
    return rows.select(F.col("_id").alias(doc_id), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
