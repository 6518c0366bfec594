"""Which of many known texts a line holds, in one pass whose cost does not grow with their number.

Every window of a line is looked up by hash in a bounded filter. Known texts go by the power of two in their size: a window
of 2^k bytes that begins no known text of 2^k to 2^(k+1)-1 bytes is done, the others are looked up whole, by the sizes that
occur. What passes is a candidate only and must be joined with the known texts, which makes the result exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

if TYPE_CHECKING:
    import pyarrow as pa

#: Most words of a filter, 32 MB in all. It takes about 8 million texts; with more, more windows pass that are not known.
MAX_WORDS = 1 << 22
#: Bytes of text that one vectorised step takes; a longer text is a step of its own.
SHARD_BYTES = 1 << 17

_BASE = 0x9E3779B97F4A7C15
_PREFIX, _SIZE = 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _salt(of: int, n: int | np.ndarray) -> np.ndarray:
    return np.asarray(n).astype(np.uint64).reshape(-1) * np.uint64(of)


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))


class _Shard:
    """Texts side by side, with the hash of any window from sums of the bytes times powers."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.starts, self.sizes = data, offsets[:-1], np.diff(offsets)
        room = 1 << max(16, len(data).bit_length())
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * _powers(_BASE, room)[:len(data)], out=self.sums[1:])
        self.back = _powers(pow(_BASE, -1, 1 << 64), room)

    def hashes(self, at: np.ndarray, size) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.back[at]

    def prefixes(self, width: int) -> np.ndarray:
        """Of the windows of `width` bytes from every place on."""
        n = len(self.data) - width + 1
        return _mix((self.sums[width:] - self.sums[:n]) * self.back[:n] + _salt(_PREFIX, width))

    def texts(self, at: np.ndarray, size: np.ndarray) -> pa.Array:
        import pyarrow as pa
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        taken = self.data[np.arange(ends[-1]) + np.repeat(at - ends[:-1], size)]
        return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(taken)])


def _shards(texts: pa.Array) -> Iterator[tuple[slice, _Shard]]:
    import pyarrow as pa
    if not len(texts):
        return
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SHARD_BYTES, "right")) - 1)
        yield slice(first, last), _Shard(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
        first = last


def _component(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    named = values.is_valid().to_numpy(zero_copy_only=False)
    return values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), named


def _keys(texts: pa.Array, components: pa.Array) -> pa.Array:
    """(prefix, whole) hashes of known texts."""
    import pyarrow as pa
    component, _ = _component(components)
    prefix, whole = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
    for rows, shard in _shards(texts):
        at, size = shard.starts, shard.sizes
        width = np.where(size > 0, 1 << np.maximum(np.frexp(size.astype(float))[1] - 1, 0), 0)
        prefix[rows] = _mix(shard.hashes(at, width) + _salt(_PREFIX, width))
        whole[rows] = _mix(shard.hashes(at, size) + _salt(_SIZE, size) + component[rows])
    return pa.StructArray.from_arrays([pa.array(prefix.view(np.int64)), pa.array(whole.view(np.int64))], ["prefix", "whole"])


def _passes(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    one, low = np.uint64(1), np.uint64(63)
    want = (one << (h & low)) | (one << ((h >> np.uint64(6)) & low)) | (one << ((h >> np.uint64(12)) & low))
    return words[(h >> np.uint64(65 - len(words).bit_length())).astype(np.int64)] & want == want


def _windows(shard: _Shard, component: np.ndarray, named: np.ndarray, words: np.ndarray, sizes: list[int]):
    """(row, place, size, own) of the windows that pass: `own` with the component of the row, else without one."""
    row = np.repeat(np.arange(len(shard.sizes)), shard.sizes)
    left = (shard.starts + shard.sizes)[row] - np.arange(len(row))  # bytes from a place to the end of its text
    wide = {}
    for size in sizes:
        wide.setdefault(size.bit_length(), []).append(size)
    for k, some in wide.items():
        width = 1 << k >> 1
        if width == 0:
            begins, rows, rest = shard.starts, np.arange(len(shard.sizes)), shard.sizes
        elif width > len(row):
            continue
        else:
            begins = np.flatnonzero(_passes(words, shard.prefixes(width)) & (left[:len(row) - width + 1] >= width))
            rows, rest = row[begins], left[begins]
        for size in some:
            fits = rest >= size
            at, of = begins[fits], rows[fits]
            h = shard.hashes(at, size) + _salt(_SIZE, size)
            for own, hit in ((False, _passes(words, _mix(h))), (True, named[of] & _passes(words, _mix(h + component[of])))):
                yield of[hit], at[hit], np.full(np.count_nonzero(hit), size), np.full(np.count_nonzero(hit), own)


def _held(texts: pa.Array, components: pa.Array, words: np.ndarray, sizes: list[int]) -> pa.Array:
    """Distinct (text, own) candidates of every line."""
    import pyarrow as pa
    component, named = _component(components)
    counts, found = np.zeros(len(texts), np.int64), [pa.table({"text": pa.array([], pa.binary()), "own": pa.array([], pa.bool_())})]
    for rows, shard in _shards(texts):
        hits = [*_windows(shard, component[rows], named[rows], words, sizes)]
        if hits:
            row, at, size, own = map(np.concatenate, zip(*hits))
            distinct = pa.table({"row": row, "text": shard.texts(at, size), "own": own}).group_by(["row", "text", "own"]).aggregate([])
            distinct = distinct.sort_by("row")
            counts[rows] = np.bincount(distinct["row"].to_numpy(), minlength=rows.stop - rows.start)
            found.append(distinct.select(["text", "own"]).set_column(0, "text", distinct["text"].cast(pa.binary())))
    flat = pa.concat_tables(found).combine_chunks()
    fields = [pa.concat_arrays(flat[c].chunks) if flat[c].num_chunks else pa.array([], flat.schema.field(c).type) for c in ("text", "own")]
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["text", "own"]))


def _arrow(fn, kind: str):
    import pyarrow as pa
    fn.__annotations__ = {"texts": pa.Array, "components": pa.Array, "return": pa.Array}
    return F.arrow_udf(fn, kind)


def _id(component: Column) -> Column:
    return F.when(component.isNotNull(), F.xxhash64(component.cast("string")))


def candidates(known: DataFrame, text: Column, component: Column) -> Column:
    """For a line with a text and a component: array of (text, own), each once, text as bytes. It holds every `_pattern` of `known` (distinct
    rows of _pattern, _component) in the text, with own for those of the line's component and without for those of none, and
    a few more that the filter lets through. Patterns of another component are not in it.

    `known` is read twice here, for the sizes and the bits of the filter, which is sent to all executors: at most 32 MB."""
    count, sizes = known.agg(F.count(F.lit(1)), F.collect_set(F.octet_length("_pattern"))).first()
    bits = max(10, min(MAX_WORDS.bit_length() - 1, (count // 2).bit_length()))
    both = known.select(_arrow(lambda texts, components: _keys(texts, components), "struct<prefix:bigint,whole:bigint>")(
        F.col("_pattern"), _id(F.col("_component"))).alias("_both"))
    masks = both.select(F.explode(F.array("_both.prefix", "_both.whole")).alias("_h")).groupBy(
        F.shiftrightunsigned("_h", 64 - bits).alias("word")).agg(F.expr(
            f"bit_or({' | '.join(f'shiftleft(1L, cast(shiftright(_h, {k}) & 63 AS int))' for k in (0, 6, 12))})").alias("mask")).toArrow()
    words = np.zeros(1 << bits, np.uint64)
    words[masks["word"].to_numpy()] = masks["mask"].to_numpy().view(np.uint64)
    sent = known.sparkSession.sparkContext.broadcast((words, sorted(sizes)))
    return _arrow(lambda texts, components: _held(texts, components, *sent.value), "array<struct<text:binary,own:boolean>>")(
        text, _id(component))
