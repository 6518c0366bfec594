"""Benchmark decontamination with suffix arrays over the training words.

Every task turns its documents into shards of words and sorts each shard's suffixes (by prefix doubling on word
hashes). Every suffix of the benchmark is searched in every shard by bisection, one word deeper at a time: the depth at
which it is lost is its longest verbatim match there, and the range of the suffix array that is left gives the places.
Shards never meet, so nothing is shuffled; the benchmark goes to the tasks in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from sievelog.llm.common import Words, per_batch, shards, text_of

#: Words of a window; words that a shard's suffixes are sorted by; bytes of benchmark text in a block.
WINDOW, SORTED, BLOCK_BYTES = 13, 16, 16 << 20
#: Of a document's words, one in SHARE must be hit for it to be contaminated.
SHARE = 20
_NONE = np.uint64(0)


def suffix_array(words: np.ndarray, depth: int = SORTED) -> np.ndarray:
    """Starts of all suffixes, ordered by their first `depth` words (rounded up to a power of two)."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    ranked = words[order]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = _first_of(ranked[1:] != ranked[:-1], n)
    known = 1
    while known < depth:
        # only ranks that several suffixes share need to be sorted again
        sorted_rank = rank[order]
        tied = np.zeros(n, dtype=bool)
        same = sorted_rank[1:] == sorted_rank[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        some = order[slots]
        after = some + known
        follow = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = sorted_rank[slots] * np.int64(n + 2) + follow
        by = np.argsort(key, kind="stable")
        order[slots] = some[by]
        key = key[by]
        # a suffix's rank is the slot where its group starts
        start = np.concatenate(([True], key[1:] != key[:-1]))
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(start, np.arange(len(slots)), 0))]
        known *= 2
    return order


def _first_of(change: np.ndarray, n: int) -> np.ndarray:
    """For each slot the slot where its run of equal values starts."""
    at = np.zeros(n, dtype=np.int64)
    at[1:] = np.where(change, np.arange(1, n), 0)
    return np.maximum.accumulate(at)


def search(words: np.ndarray, order: np.ndarray, tests: np.ndarray, size: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(depth, low, high) of each test suffix: row i of `tests` holds its first words, size[i] of them. The suffixes in
    order[low:high] share its first `depth` words, and none shares more, up to `limit` words and its size."""
    count, n = len(tests), len(words)
    low, high = np.zeros(count, dtype=np.int64), np.full(count, n, dtype=np.int64)
    depth, alive = np.zeros(count, dtype=np.int64), np.arange(count)
    for k in range(limit):
        alive = alive[size[alive] > k]
        if not len(alive):
            break
        want, a, b = tests[alive, k], low[alive], high[alive]
        left = _bisect(words, order, want, a, b, k, False)
        right = _bisect(words, order, want, left, b, k, True)
        found = right > left
        alive = alive[found]
        low[alive], high[alive], depth[alive] = left[found], right[found], k + 1
    return depth, low, high


def _bisect(words, order, want, low, high, k, beyond) -> np.ndarray:
    low, high = low.copy(), high.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) // 2
        at = order[mid] + k
        here = np.where(at < len(words), words[np.minimum(at, len(words) - 1)], _NONE)
        less = here <= want[open_] if beyond else here < want[open_]
        low[open_] = np.where(less, mid + 1, low[open_])
        high[open_] = np.where(less, high[open_], mid)


class Block:
    """Test suffixes of a block of items (id, text)."""

    def __init__(self, items: list[tuple[str, str]]):
        self.ids = [i for i, _ in items]
        raw = [t.encode() for _, t in items]
        w = Words(raw)
        self.item, self.at, self.need, rows = [], [], [], []
        #: Spelling of each hash; None for a hash of several words.
        self.spelt: dict[int, bytes | None] = {}
        self.text: list[list[bytes]] = []
        for i in range(len(raw)):
            hashes = w.of(i)
            self.text.append([w.word(k) for k in range(w.bounds[i], w.bounds[i + 1])])
            for x, word in zip(hashes.tolist(), self.text[i]):
                if self.spelt.setdefault(x, word) != word:
                    self.spelt[x] = None
            for j in range(len(hashes)):
                rows.append(hashes[j:j + SORTED])
                self.item.append(i)
                self.at.append(j)
                self.need.append(min(WINDOW, len(hashes)))
        self.size = np.array([len(r) for r in rows], dtype=np.int64)
        self.tests = np.zeros((len(rows), SORTED), dtype=np.uint64)
        for i, r in enumerate(rows):
            self.tests[i, :len(r)] = r
        self.item, self.at, self.need = (np.array(x, dtype=np.int64) for x in (self.item, self.at, self.need))

    def hits(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
        """Per text: number of words and matches (first word, end word, item, longest match in words). A match covers a
        window of an item; matches of one item that overlap or touch are joined."""
        w = Words(texts)
        counts = np.diff(w.bounds)
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        if len(w.hash) and len(self.tests):
            # a word that equals nothing between documents, so that no match crosses them
            doc_of = np.searchsorted(w.bounds[1:], np.arange(len(w.hash)), side="right")
            words = np.zeros(len(w.hash) + len(texts), dtype=np.uint64)
            words[np.arange(len(w.hash)) + doc_of] = np.where(w.hash == _NONE, np.uint64(1), w.hash)
            first = w.bounds[:-1] + np.arange(len(texts))
            order = suffix_array(words)
            depth, low, high = search(words, order, self.tests, np.minimum(self.size, self.need), WINDOW)
            for item, need, best in self._items(np.flatnonzero(depth >= self.need), order, low, high, w, first):
                starts = np.flatnonzero(best)
                doc = np.searchsorted(first, starts, side="right") - 1
                new = np.concatenate(([True], (np.diff(doc) > 0) | (np.diff(starts) > need)))
                heads, tails = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(starts)) - 1
                longest = np.maximum.reduceat(best[starts], heads)
                for a, b, most in zip(heads, tails, longest):
                    d = int(doc[a])
                    out[d].append((int(starts[a] - first[d]), int(starts[b] - first[d]) + need, item, int(most)))
        return [(int(n), found) for n, found in zip(counts, out)]

    def _items(self, tests: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, w: Words, first: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """For each item with a window in the shard: item, words of a window, and for each place the length of the verbatim
        match that ends with the window there, 0 where none is.

        A window at a place goes on from the item's window before it at the place before it, so a match is as long as its
        run along the diagonal: words are never compared again for each place of a long or repetitive match.
        """
        doubtful = self._doubtful(tests, order, low, high, w, first)
        best, last, before, run = np.zeros(0, dtype=np.int64), (-1, -1, 0), None, None
        for s in tests:
            item, at, need = int(self.item[s]), int(self.at[s]), int(self.need[s])
            if item != last[0]:
                if best.any():
                    yield last[0], last[2], best
                best, before = np.zeros(len(order), dtype=np.int64), None
            here = np.sort(order[low[s]:high[s]])
            unsure = doubtful[here + need] > doubtful[here]
            if unsure.any():
                here = here[[not u or self._same(w, p - int(np.searchsorted(first, p, side="right")) + 1, item, at, need) for p, u in zip(here.tolist(), unsure)]]
            length = np.ones(len(here), dtype=np.int64)
            if before is not None and len(before) and at == last[1] + 1:
                k = np.minimum(np.searchsorted(before, here - 1), len(before) - 1)
                length = np.where(before[k] == here - 1, run[k] + 1, 1)
            best[here] = np.maximum(best[here], length + (need - 1))
            last, before, run = (item, at, need), here, length
        if best.any():
            yield last[0], last[2], best

    def _doubtful(self, tests: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, w: Words, first: np.ndarray) -> np.ndarray:
        """Running count of the places within windows whose word isn't the one that its hash stands for in the block; each
        word is spelt once, however many windows cover it."""
        cover = np.zeros(len(order) + 1, dtype=np.int64)
        for s in tests:
            here = order[low[s]:high[s]]
            cover[here] += 1
            cover[here + self.need[s]] -= 1
        wrong = np.zeros(len(order) + 1, dtype=np.int64)
        inside = np.flatnonzero(np.cumsum(cover) > 0)
        for p, at in zip(inside.tolist(), (inside - np.searchsorted(first, inside, side="right") + 1).tolist()):
            word = self.spelt.get(int(w.hash[at]))
            wrong[p + 1] = word is None or word != w.word(at)
        return np.cumsum(wrong)

    def _same(self, w: Words, word: int, item: int, at: int, need: int) -> bool:
        return all(w.word(word + x) == self.text[item][at + x] for x in range(need))


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = BLOCK_BYTES) -> list[list[tuple[str, str]]]:
    """The items in blocks of about `size` bytes each, cut by a hash of the id; only one block is held at a time by the
    caller's loop when it iterates. An item without words matches nothing; one without an id is dealt by its text."""
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), text_of(text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(total // size) + 1
    for part in range(parts):
        rows = items.filter(F.pmod(F.xxhash64(F.coalesce("id", "text")), F.lit(parts)) == part).collect()
        yield sorted(((r["id"], r["text"]) for r in rows), key=lambda x: (x[0] is None, x[0] or "", x[1]))


def matches(df: DataFrame, benchmark: DataFrame, text: str = "text", **columns) -> DataFrame:
    """Adds n_words and matches, an array of (start, end, item_id, longest): the words [start, end) of the document lie
    in windows of the item, and the longest verbatim match from there has `longest` words.

    Null and empty texts have no words and no matches. Texts and items may be long and repeat themselves: a shard's places
    of a window are handled as one array, so time grows with the places of all windows. Repeated rows and ties stay as they are; columns of the input with
    these names are replaced. Every block of the benchmark is one more pass over the text inside the same task.
    """
    import pyarrow as pa
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("item_id", pa.string()), ("longest", pa.int64())]))
    found: list[Column] = []
    out = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("n_words", "matches")])
    for items in blocks(benchmark, **columns):
        out = out.withColumn(f"_block{len(found)}", _udf(items, kind)(text_of(text)))
        found.append(F.col(f"_block{len(found)}"))
    return out.withColumns({"n_words": found[0]["n_words"], "matches": F.flatten(F.array(*[f["matches"] for f in found]))}).drop(
        *[f"_block{i}" for i in range(len(found))])


def _udf(items: list[tuple[str, str]], kind):
    import pyarrow as pa
    block: list[Block] = []

    def run(texts: list) -> list[tuple]:
        if not block:
            block.append(Block(items))
        ids, out = block[0].ids, []
        for _, part in shards(t.encode() for t in texts):
            for n, found in block[0].hits(part):
                out.append((n, [{"start": a, "end": b, "item_id": ids[i], "longest": k} for a, b, i, k in found]))
        return out

    return per_batch(run, "n_words bigint, matches array<struct<start:bigint,end:bigint,item_id:string,longest:bigint>>", [pa.int64(), kind])


def covered(spans: Column) -> Column:
    """Number of words in the union of (start, end) spans."""
    step = lambda a, s: F.struct(
        F.greatest(a["end"], s["end"]).alias("end"),
        (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["end"]), F.lit(0).cast("long"))).alias("n"))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda a: a["n"])


def judge(df: DataFrame, benchmark: DataFrame, text: str = "text", **columns) -> DataFrame:
    """`matches` with n_hit (words inside any window's occurrence), items (sorted ids with occurring windows; a null id counts in
    n_hit only) and contaminated (n_hit > 0 and SHARE * n_hit >= n_words)."""
    rows = matches(df, benchmark, text, **columns)
    rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("n_hit", "items", "contaminated")])
    rows = rows.withColumns({"n_hit": covered(F.col("matches")), "items": F.array_sort(F.array_distinct(F.array_compact(F.transform("matches", lambda m: m["item_id"]))))})
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def remove(df: DataFrame, benchmark: DataFrame, text: str = "text", **columns) -> DataFrame:
    """The documents that aren't contaminated, with the columns of the input."""
    named = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(text).alias("_text"))
    return judge(named, benchmark, "_text", **columns).filter(~F.col("contaminated")).select("_row.*")
