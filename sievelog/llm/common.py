"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sievelog.sources.store import materialise

#: Bytes of text that one vectorised step takes; a longer text is a step of its own.
SHARD_BYTES = 1 << 19


#: Rows that go to a Python worker at once: with texts of some kilobytes a batch stays at a few megabytes.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def text_of(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def numbered(df: DataFrame) -> DataFrame:
    """Stored: _all, the row as a struct, and _place, a number of its own. Numbers of a scan that is planned again may name
    other rows, since file splits follow the cores registered then; stored ones don't."""
    return materialise(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_all"),
                                 F.monotonically_increasing_id().alias("_place")), "numbered")


def add_fields(df: DataFrame, value: Column, names: list[str]) -> DataFrame:
    """Appends the fields of a struct column. Columns of the input with one of these names are replaced, whatever
    their case, so that a clash can't make the result ambiguous."""
    taken = {n.lower() for n in names} | {"_fields"}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.withColumn("_fields", value).select(*kept, *[F.col("_fields")[n].alias(n) for n in names])


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """The fold that no classifier learns from: crc32 of the id as text is divisible by `folds`."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def bounded_sample(df: DataFrame, key: Column, rows: int, of: int) -> DataFrame:
    """About `rows` of the `of` rows of a table, all if there are fewer: those with the smallest hashes of `key`, whatever
    the partitioning. The bound holds in expectation, give or take a few times its square root."""
    if of <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * rows / of))


def salted_groups(df: DataFrame, keys: list[str], row: Column, aggs: dict[str, tuple[str, str]], salts: int = 32) -> DataFrame:
    """Every row with aggregates of its group, `aggs` maps a new name to (min | max | sum | count, column).

    Rows of a group are spread over `salts` by a hash of `row`; groups are aggregated per salt, then over salts, and the
    totals return to the rows by (keys, salt). No task holds a group: a group of n rows puts n / salts rows in one task.
    """
    df = df.withColumn("_salt", F.pmod(F.xxhash64(row), F.lit(salts)))
    fold = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count}
    part = df.groupBy(*keys, "_salt").agg(*[fold[how](F.col(c) if c != "*" else F.lit(1)).alias(n) for n, (how, c) in aggs.items()])
    total = part.groupBy(*keys).agg(
        *[fold["sum" if how == "count" else how](n).alias(n) for n, (how, _) in aggs.items()],
        F.collect_list("_salt").alias("_salts"))
    back = total.withColumn("_salt", F.explode("_salts")).drop("_salts")
    return df.join(back, [*keys, "_salt"]).drop("_salt")


def shards(texts: Iterable[bytes], limit: int = SHARD_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts) with at most `limit` bytes, or one longer text."""
    first, size, run = 0, 0, []
    for i, t in enumerate(texts):
        if run and size + len(t) > limit:
            yield first, run
            first, size, run = i, 0, []
        run.append(t)
        size += len(t)
    if run:
        yield first, run


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=np.int8)
_WORD[48:58] = _WORD[97:123] = 1
_WORD[128:] = 1
#: Byte tables for `Words`: no case folding, and words that lie between white space.
BYTES = np.arange(256, dtype=np.uint8)
SPACED = np.ones(256, dtype=np.int8)
SPACED[[9, 10, 11, 12, 13, 32]] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, SHARD_BYTES + 4096), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= SHARD_BYTES + 4096:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (one-to-one)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def polynomial(values: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Hashes of slices of 64-bit values, mixed with their lengths."""
    run = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _power(_BASE, len(values)), out=run[1:])
    return mix((run[after] - run[first]) * _power(_BACK, len(values) + 1)[first] + (after - first).astype(np.uint64))


class Words:
    """Words of a run of texts, found and hashed with array operations.

    A word is a maximal run of digits, letters a-z (A-Z are lower-cased) and characters beyond ASCII, or what the byte
    tables `fold` and `word` say. `hash` holds one 64-bit polynomial hash a word, `bounds[i]:bounds[i + 1]` are the words of
    text i, `start` and `end` their bytes.
    """

    def __init__(self, texts: list[bytes], fold: np.ndarray = _LOWER, word: np.ndarray = _WORD):
        blob = fold[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
        edge = np.diff(word[blob], prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        run = np.zeros(len(blob) + 1, dtype=np.uint64)
        np.cumsum((blob.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(blob)), out=run[1:])
        self.hash = mix((run[self.end] - run[self.start]) * _power(_BACK, len(blob))[self.start])
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        self.first = np.concatenate(([0], np.cumsum(size)))
        self.bounds = np.searchsorted(self.start, self.first)
        self.blob = blob

    def word(self, i: int) -> bytes:
        return self.blob[self.start[i]:self.end[i]].tobytes()

    def of(self, i: int) -> np.ndarray:
        return self.hash[self.bounds[i]:self.bounds[i + 1]]


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Distinct hashes of `size` consecutive words, sorted; a text with fewer words, but some, is one shingle."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k:k + n]
    return np.unique(mix(out ^ np.uint64(size)))


def per_batch(fn: Callable[[list], list[tuple]], fields: str, types: list, once: bool = False):
    """An Arrow UDF of one text column that returns a struct: `fn` gets the texts of a batch and returns a tuple a text.

    With `once`, filters and joins on its fields stay above it. Else Spark may push a filter below the fields, which calls
    `fn` twice a text, the second time in one more Python worker a core; idle workers stay with the memory they have.
    """
    import pyarrow as pa
    names = [f.split()[0] for f in fields.split(", ")]

    def run(texts: pa.Array) -> pa.Array:
        rows = fn(texts.to_pylist())
        cols = list(zip(*rows)) if rows else [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(run, f"struct<{', '.join(f.replace(' ', ':', 1) for f in fields.split(', '))}>")
    return udf.asNondeterministic() if once else udf
