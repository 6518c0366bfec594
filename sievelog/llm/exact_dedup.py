"""Exact deduplication by composable polynomial fingerprints.

A text is hashed in chunks; a chunk's value is (hash, shift) with shift = base ** length, both modulo a prime, and two
neighbours combine to (left.hash * right.shift + right.hash, left.shift * right.shift). Combining is associative, so
chunks of a huge document may be hashed anywhere, in any order. Equal fingerprints only propose a group: its texts are
then compared chunk by chunk, and a group whose texts differ is split by a digest of the text.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from sievelog.llm.common import add_fields, numbered, per_batch, salted_groups, text_of
from sievelog.sources.store import materialise

#: Two primes below 2**31; a fingerprint is both remainders and the length.
PRIMES = (2147483647, 2147483629)
BASE = 911_382_323
#: Bytes hashed at once, and characters compared at once.
CHUNK = 1 << 16
_GAP = re.compile(rb"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+")


def normal(raw: bytes) -> bytes:
    """Every run of white space becomes one space."""
    return _GAP.sub(b" ", raw)


def powers(prime: int, n: int = CHUNK) -> np.ndarray:
    """base ** (n - 1), ..., base, 1 modulo the prime."""
    out = np.ones(n, dtype=np.uint64)
    have = 1
    while have < n:
        step = np.uint64(pow(BASE, have, prime))
        out[have:2 * have] = out[:min(have, n - have)] * step % np.uint64(prime)
        have *= 2
    return out[::-1].copy()


_tables: dict[int, np.ndarray] = {}


def chunk_value(raw: bytes, prime: int) -> tuple[int, int]:
    """(hash, shift) of at most CHUNK bytes."""
    if prime not in _tables:
        _tables[prime] = powers(prime)
    data = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    # factors below 2**31 and 2**9, 2**16 of them: the sum stays below 2**56
    return int(data @ _tables[prime][CHUNK - len(raw):]) % prime, pow(BASE, len(raw), prime)


def combine(left: tuple[int, int], right: tuple[int, int], prime: int) -> tuple[int, int]:
    """Value of two neighbouring pieces from the values of each."""
    return (left[0] * right[1] + right[0]) % prime, left[1] * right[1] % prime


def fingerprint(raw: bytes, prime: int) -> int:
    value = (0, 1)
    for at in range(0, len(raw), CHUNK):
        value = combine(value, chunk_value(raw[at:at + CHUNK], prime), prime)
    return value[0]


def combine_chunks(chunks: DataFrame, keys: list[str], number: str = "number", prime: int = PRIMES[0]) -> DataFrame:
    """Hash of documents whose chunks are rows (keys, number, hash, shift): chunks are hashed where they lie and only
    their values meet, 24 bytes for each CHUNK of text."""
    step = lambda a, x: F.struct(((a["hash"] * x["shift"] + x["hash"]) % prime).alias("hash"),
                                 (a["shift"] * x["shift"] % prime).alias("shift"))
    zero = F.struct(F.lit(0).cast("long").alias("hash"), F.lit(1).cast("long").alias("shift"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(number).alias("number"), F.col("hash").cast("long").alias("hash"), F.col("shift").cast("long").alias("shift"))))
    return chunks.groupBy(*keys).agg(F.aggregate(parts, zero, step).alias("value")).select(*keys, "value.hash", "value.shift")


def normal_text(name: str = "text") -> Column:
    return F.regexp_replace(text_of(name), "[\\x20\\x09-\\x0D]+", " ")


def digests(df: DataFrame, text: str = "text", primes: tuple[int, int] = PRIMES) -> DataFrame:
    """Adds fp_a, fp_b, fp_bytes and text_sha256 of the normalised text."""
    import pyarrow as pa

    def run(texts: list) -> list[tuple]:
        out = []
        for t in texts:
            raw = normal(t.encode())
            out.append((fingerprint(raw, primes[0]), fingerprint(raw, primes[1]), len(raw), hashlib.sha256(raw).hexdigest()))
        return out

    udf = per_batch(run, "fp_a bigint, fp_b bigint, fp_bytes bigint, text_sha256 string", [pa.int64()] * 3 + [pa.string()], once=True)
    return add_fields(df, udf(text_of(text)), ["fp_a", "fp_b", "fp_bytes", "text_sha256"])


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", primes: tuple[int, int] = PRIMES, row: str | None = None) -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after every run of white space is one space; null counts as empty, and empty texts
    are equal to each other. Of equal texts the row with the smallest id is kept, a null id being larger than any; of
    rows that repeat an id, one is kept. Only the id and the text are read, so other columns can't clash. An empty table
    gives no rows.

    Texts leave the scan only for groups of two rows and more; such a group is compared by the smallest and largest text
    of each chunk number, which every task reduces before anything is shuffled, so a group may be of any size.
    """
    key = ["fp_a", "fp_b", "fp_bytes"]
    number = F.col(row) if row else F.monotonically_increasing_id()
    one = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), number.alias("_row"))
    rows = materialise(digests(one, primes=primes).drop("text"), "fingerprints")
    twice = materialise(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key), "repeated")

    chunk = lambda i: F.substring("_normal", i * CHUNK + 1, F.lit(CHUNK))
    last = F.floor((F.greatest(F.length("_normal"), F.lit(1)) - 1) / CHUNK).cast("int")
    texts = digests(one, primes=primes).join(twice, key, "left_semi").select(*key, normal_text().alias("_normal"))
    parts = texts.select(*key, F.posexplode(F.transform(F.sequence(F.lit(0), last), chunk)).alias("_number", "_part"))
    differ = materialise(parts.groupBy(*key, "_number").agg(F.min("_part").alias("a"), F.max("_part").alias("b"))
                         .filter("a <> b").select(*key).distinct().withColumn("_split", F.lit(True)), "collisions")

    order = F.struct(F.col("doc_id").isNull().alias("void"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    marked = rows.join(differ, key, "left").withColumns({"_sub": F.when(F.col("_split"), F.col("text_sha256")).otherwise(""), "_order": order})
    groups = salted_groups(marked, [*key, "_sub"], F.col("_row"), {"_first": ("min", "_order"), "group_size": ("count", "*")})
    return groups.select(F.col("doc_id").alias(doc_id), F.col("_first.id").alias("keep_id"), "group_size",
                         (F.col("_first.row") == F.col("_row")).alias("kept"), "text_sha256", *([F.col("_row").alias(row)] if row else []))


def keep_first(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all columns of the input. The input is stored once with a number for each row, which the
    decision and the last join both read: ids may repeat, and how files are split may change in between."""
    stored = numbered(df)
    rows = stored.select(F.col(f"_all.{doc_id}").alias("doc_id"), F.col(f"_all.{text}").alias("text"), "_place")
    gone = dedup(rows, row="_place").filter(~F.col("kept")).select("_place")
    return stored.join(materialise(gone, "gone"), "_place", "left_anti").select("_all.*")
