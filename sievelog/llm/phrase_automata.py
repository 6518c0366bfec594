"""Removal of repeated passages: recurring windows are confirmed by hash, compiled into Aho-Corasick automata, and every
document is streamed through the automaton of its shard, which locates each occurrence word by word.

A window is `WINDOW` consecutive words. Each window has an anchor, the smallest hash of its `GRAM`-word grams; windows in a
row with one anchor form a run. Equal windows have equal anchors, so a window can recur only where its anchor recurs:

1. One row a run (anchor, hash of the run's words, document) is dealt by anchor. A run that a smaller id also holds
   recurs as a whole. Where an anchor's runs differ, the first holder of each run is asked for its single windows.
2. Those windows, few, are dealt by their hash in the same way.
3. The documents meet what was confirmed for them. Texts are cut into shards of `SHARD_WORDS` words; the confirmed windows
   of a shard become one automaton over words, and the shard's words run through it.

Rows of one batch with the same run are reduced to their first holder before they are dealt, so a passage that a third of
all documents share puts one row a batch into the task of its anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from sievelog.llm.common import BYTES, SPACED, Words, mix, polynomial, shards
from sievelog.sources.store import materialise

#: Words of a window, and of the grams whose smallest hash is its anchor.
WINDOW, GRAM = 20, 8
#: Words whose windows share one automaton; at most WINDOW trie nodes a word.
SHARD_WORDS = 40_000
#: Stands for a null id, which is larger than any, and for "no earlier holder".
LAST = np.int64(2**63 - 1)


class Runs:
    """Windows and runs of a list of texts. `at` are the first words of windows, `anchor` their anchors, `first` and `last`
    the bounds of runs within `at`, `run` the hashes of all words of a run, `doc` the text of each run."""

    def __init__(self, texts: list[bytes], window: int = WINDOW):
        self.words = words = Words(texts, BYTES, SPACED)
        self.window, gram = window, min(GRAM, window)
        n = len(words.hash)
        self.of = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
        if n < window:
            self.at = self.first = self.last = self.doc = np.zeros(0, dtype=np.int64)
            self.anchor = self.run = np.zeros(0, dtype=np.uint64)
            self.loops = np.zeros(0, dtype=bool)
            return
        grams, wide = self._horner(np.arange(n - gram + 1), gram, np.uint64(0xD6E8FEB86659FD93)), 1
        twice = np.zeros(len(grams) + 1, dtype=np.int64)  # before each gram: how many stand again soon after
        for step in range(1, window - gram + 1):
            twice[1:-step] += grams[:-step] == grams[step:]
        least = grams
        while 2 * wide <= window - gram + 1:
            least, wide = np.minimum(least[:len(least) - wide], least[wide:]), 2 * wide
        rest = window - gram + 1 - wide
        least = np.minimum(least[:len(least) - rest], least[rest:])
        self.at = np.flatnonzero(self.of[:n - window + 1] == self.of[window - 1:])
        self.anchor = least[self.at]
        new = np.ones(len(self.at), dtype=bool)
        new[1:] = (np.diff(self.at) > 1) | (np.diff(self.of[self.at]) > 0) | (self.anchor[1:] != self.anchor[:-1])
        self.first = np.flatnonzero(new)
        self.last = np.append(self.first[1:], len(self.at)) - 1
        self.doc = self.of[self.at[self.first]]
        self.run = polynomial(words.hash, self.at[self.first], self.at[self.last] + window)
        # runs in which a window may stand again: a gram does so, or they are longer than one gram can be the smallest of
        twice = np.cumsum(twice)
        near = twice[self.at[self.last] + window - gram + 1] > twice[self.at[self.first]]
        self.loops = near | (self.last - self.first > window - gram)

    def _horner(self, at: np.ndarray, size: int, factor: np.uint64) -> np.ndarray:
        out = np.zeros(len(at), dtype=np.uint64)
        for k in range(size):
            out = out * factor + self.words.hash[at + k]
        return mix(out)

    def hashes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of windows, given as numbers into `at`."""
        at = self.at[which]
        return (self._horner(at, self.window, np.uint64(0x9FB21C651E98DF25)), self._horner(at, self.window, np.uint64(0xA0761D6478BD642F)))

    def repeats(self) -> np.ndarray:
        """Whether a window stands earlier in its own text too. Equal windows have equal anchors, so they lie in runs of one
        anchor, or in one run that loops."""
        out = np.zeros(len(self.at), dtype=bool)
        if not len(out):
            return out
        anchor, some = self.anchor[self.first], self.loops.copy()
        order = np.lexsort((anchor, self.doc))
        twin = (np.diff(anchor[order]) == 0) & (np.diff(self.doc[order]) == 0)
        some[order[1:][twin]] = some[order[:-1][twin]] = True
        which = np.flatnonzero(np.repeat(some, self.last - self.first + 1))
        key, doc = self._horner(self.at[which], self.window, np.uint64(0x9FB21C651E98DF25)), self.of[self.at[which]]
        order = np.lexsort((key, doc))  # stable: equal windows stay in the order of the text
        out[which[order[1:]]] = (np.diff(key[order]) == 0) & (np.diff(doc[order]) == 0)
        return out


def _ask(key: np.ndarray, sub: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (key, sub, doc) with the first holder inside the batch: rows of the first holder itself have LAST."""
    order = np.lexsort((doc, sub, key))
    key, sub, doc = key[order], sub[order], doc[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0)) if len(key) else np.zeros(0, dtype=np.int64)
    keep = new.copy()
    keep[1:] |= doc[1:] != doc[:-1]
    known = np.where(doc == doc[first], LAST, doc[first]) if len(key) else doc
    return key[keep], sub[keep], doc[keep], known[keep]


def _asks(rows: DataFrame, columns: list[str], pick) -> DataFrame:
    """Rows (key, sub, doc, known) of all batches; `pick(runs, lists)` gives the (key, sub, text number) of a shard."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = [batch.column(c) for c in range(2, len(columns))]
            found = []
            for start, part in shards([t.encode() for t in batch.column(1).to_pylist()]):
                key, sub, text = pick(Runs(part), [c.slice(start, len(part)) for c in lists])
                found.append((key, sub, ids[start + text]))
            key, sub, doc, known = _ask(*[np.concatenate(c) for c in zip(*found)]) if found else [np.zeros(0, dtype=np.int64)] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in (key, sub, doc, known)], ["key", "sub", "doc", "known"])

    return rows.select(*columns).mapInArrow(run, "key long, sub long, doc long, known long")


def _confirmed(asks: DataFrame) -> DataFrame:
    """Rows (doc, sub, known, mixed): what each document holds of things that a smaller id holds too, `known`, and what the
    first holder has to compare, `mixed`. Rows whose earlier holder is in their own batch need no meeting; they are
    spread by document and pass through."""
    met = F.col("known") == F.lit(int(LAST))
    # one exchange serves both windows; what the batches reduced bounds each group by the number of batches
    dealt = asks.withColumn("_at", F.when(met, F.col("key")).otherwise(F.xxhash64("doc", "sub"))).withColumn("_met", met)
    dealt = dealt.repartition("_at", "_met")
    thing, key = Window.partitionBy("_at", "_met", "key", "sub"), Window.partitionBy("_at", "_met", "key")
    held = dealt.withColumns({"_first": F.min("doc").over(thing), "mixed": F.col("_met") & (F.min("sub").over(key) < F.max("sub").over(key))})
    earlier = F.when(~F.col("_met"), F.col("known")).when(F.col("_first") < F.col("doc"), F.col("_first"))
    held = held.select("doc", "sub", earlier.alias("known"), "mixed").filter(F.col("known").isNotNull() | F.col("mixed"))
    return held.select("doc", "sub", "known", (F.col("mixed") & F.col("known").isNull()).alias("mixed"))


def _listed(confirmed: DataFrame, name: str) -> DataFrame:
    """What a document is told: (sub, known) pairs, known null where it has to compare. At most a pair a run."""
    return confirmed.groupBy(F.col("doc").alias("_id")).agg(F.collect_list(F.struct("sub", "known")).alias(name))


def _lengths(lists) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


def _first_holders(lists, size: int, things: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The earlier holder of each thing by what its text was told; LAST: none, -1 marks "compare"."""
    out = np.full(len(things), LAST)
    if not size or not len(things):
        return out
    flat, text = lists.flatten(), np.repeat(np.arange(size), _lengths(lists))
    if not len(flat):
        return out
    sub = flat.field("sub").to_numpy(zero_copy_only=False).view(np.uint64)
    known = flat.field("known")
    told = np.where(known.is_null().to_numpy(zero_copy_only=False), LAST - 1, known.fill_null(0).to_numpy(zero_copy_only=False))
    order = np.lexsort((told, sub, text))
    text, sub, told = text[order], sub[order], told[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (sub[1:] != sub[:-1])
    text, sub, told = text[new], sub[new], told[new]
    salt = mix(text.astype(np.uint64) + np.uint64(1))
    key, seek = sub ^ salt, things ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    place = np.minimum(np.searchsorted(key[order], seek), len(key) - 1)
    hit = order[place]
    good = (sub[hit] == things) & (text[hit] == doc)
    out[good] = told[hit[good]]
    return out


def _occurrences(words: list[bytes], flagged: np.ndarray, known: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Every place in a shard's words where a confirmed window stands, with the smallest id known to hold the window.

    `flagged` are the first words of confirmed windows and `known` such ids (the document's own id for a window that stands
    earlier in the same text); equal windows are one phrase of the automaton."""
    import ahocorasick
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(covered, flagged, 1)
    np.add.at(covered, flagged + window, -1)
    # words of confirmed windows as characters from 1 on, without surrogates; any other word is the character 0
    known_words = dict.fromkeys(compress(words, np.cumsum(covered[:-1]) > 0))
    letter = {w: chr(i if i < 0xD800 else i + 0x800) for i, w in enumerate(known_words, 1)}.get
    text = "".join([letter(w, "\0") for w in words])
    holder: dict[str, int] = {}
    for at, first in zip(flagged.tolist(), known.tolist()):
        phrase = text[at:at + window]
        if holder.get(phrase, first + 1) > first:
            holder[phrase] = first
    automaton = ahocorasick.Automaton()
    for phrase, first in holder.items():
        automaton.add_word(phrase, first)
    automaton.make_automaton()
    ends, firsts = [], []
    for end, first in automaton.iter(text):
        ends.append(end)
        firsts.append(first)
    at = np.array(ends, dtype=np.int64) - (window - 1)
    return at, np.array(firsts, dtype=np.int64)


def _strip(texts: list[bytes], ids: np.ndarray, told, compared, ready: np.ndarray, window: int, keep_text: bool) -> list[tuple]:
    """Result rows of a list of texts: (words, removed words, digest of what stays, removed spans, kept text)."""
    runs = Runs(texts, window)
    bounds, size = runs.words.bounds, len(texts)
    run_known = _first_holders(told, size, runs.run, runs.doc)
    known = np.repeat(run_known, runs.last - runs.first + 1)
    doc = runs.of[runs.at] if len(runs.at) else runs.at
    if compared is not None:
        asked = np.flatnonzero(known == LAST - 1)
        key, sub = runs.hashes(asked)
        known[asked] = _first_holders(compared, size, sub, doc[asked])
    known[known == LAST - 1] = LAST
    repeated = runs.repeats()
    flagged = np.flatnonzero(((known < LAST) | repeated) & ready[doc])
    gone = np.zeros(len(runs.words.hash), dtype=np.int64)
    split = [t.split() for t in texts]
    if len(flagged):
        words = [w for s in split for w in s]
        marks = np.zeros(len(words) + 1, dtype=np.int64)
        place = runs.at[flagged]
        holder = np.where(known[flagged] < LAST, known[flagged], ids[doc[flagged]])
        for lo in range(0, len(words), SHARD_WORDS):
            # a shard's windows start inside it and may reach window - 1 words further
            a, b = np.searchsorted(place, [lo, lo + SHARD_WORDS])
            if a == b:
                continue
            part = words[lo:lo + SHARD_WORDS + window - 1]
            at, first = _occurrences(part, place[a:b] - lo, holder[a:b], window)
            at += lo
            inside = (at < lo + SHARD_WORDS) & (runs.of[at] == runs.of[at + window - 1]) & ready[runs.of[at]]
            at, first = at[inside], first[inside]
            number = np.searchsorted(runs.at, at)
            out = (first < ids[runs.of[at]]) | repeated[number]
            np.add.at(marks, at[out], 1)
            np.add.at(marks, at[out] + window, -1)
        gone = np.cumsum(marks[:-1]) > 0
    rows = []
    for i, own in enumerate(split):
        cut = gone[bounds[i]:bounds[i + 1]].astype(bool)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], cut.astype(np.int8), [0])))).tolist()
        left = b" ".join(compress(own, ~cut) if edge else own)
        rows.append((len(own), int(cut.sum()), hashlib.sha256(left).hexdigest(),
                     [{"first": a, "after": b} for a, b in zip(edge[::2], edge[1::2])], left.decode() if keep_text else None))
    return rows


_SPANS = "array<struct<first:bigint,after:bigint>>"


def _finish(rows: DataFrame, columns: list[str], keep_text: bool, window: int) -> DataFrame:
    """Streams texts through the automata. Columns: _id, text, _runs and perhaps _windows. Without _windows, a text that
    still has to compare comes back with its text and its lists for a second meeting."""
    import pyarrow as pa
    import pyarrow.compute as pc
    spans = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))
    again = "_windows" not in columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts, lists = batch.column(1), batch.column(2)
            rows: list[tuple] = []
            raw = [t.encode() for t in texts.to_pylist()]
            waits = np.zeros(len(raw), dtype=bool)
            if again:
                waits[np.repeat(np.arange(len(raw)), _lengths(lists))[lists.flatten().field("known").is_null().to_numpy(zero_copy_only=False)]] = True
            for start, part in shards(raw):
                cut = [c.slice(start, len(part)) for c in batch.columns[2:]]
                ready = ~waits[start:start + len(part)]
                rows += _strip([t if r else b"" for t, r in zip(part, ready)], ids[start:], cut[0], None if again else cut[1], ready, window, keep_text)
            out = [pa.array(ids)] + [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.int64(), pa.int64(), pa.string(), spans, pa.string()))]
            if again:
                wait = pa.array(waits)
                out += [wait, pc.if_else(wait, texts, pa.scalar(None, pa.string())), lists]
            yield pa.RecordBatch.from_arrays(out, [f"c{i}" for i in range(len(out))])

    kinds = f"c0 long, c1 long, c2 long, c3 string, c4 {_SPANS}, c5 string" + (
        ", c6 boolean, c7 string, c8 array<struct<sub:bigint,known:bigint>>" if again else "")
    names = ["_id", "n_words", "n_removed", "kept_sha256", "removed", "kept_text", "_waits", "text", "_runs"]
    done = rows.select(*columns).mapInArrow(run, kinds)
    return done.toDF(*names[:len(done.columns)])


def _place(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(int(LAST)))


def strip(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """One row per input row: the id, n_words, n_removed, kept_sha256, removed (spans of words, first to before `after`) and
    kept_text (null with keep_text=False; kept_sha256 is its digest).

    Words lie between runs of white space. A word goes if a window that covers it starts earlier too: in a smaller id, or
    before in the same row. Null texts have no words; a text of fewer than WINDOW words keeps all. A null id is larger
    than any id. Of rows that repeat an id none is earlier than the other: each is judged against smaller ids and itself.
    An empty table gives no rows. Only the id and the text are read, so other columns can't clash. Ids are integers.
    """
    docs = df.select(_place(doc_id).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def runs_of(runs: Runs, _) -> tuple:
        return runs.anchor[runs.first], runs.run, runs.doc

    def windows_of(runs: Runs, lists: list) -> tuple:
        known = _first_holders(lists[0], len(lists[0]), runs.run, runs.doc)
        which = np.flatnonzero(np.repeat(known, runs.last - runs.first + 1) == LAST - 1)
        key, sub = runs.hashes(which)
        return key, sub, runs.of[runs.at[which]]

    told = _listed(_confirmed(_asks(docs, ["_id", "text"], runs_of)), "_runs")
    first = materialise(_finish(docs.join(told, "_id", "left"), ["_id", "text", "_runs"], keep_text, WINDOW), "phrases")
    result = ["_id", "n_words", "n_removed", "kept_sha256", "removed", "kept_text"]
    waiting = first.filter("_waits").select("_id", "text", "_runs")
    compared = _listed(_confirmed(_asks(waiting, ["_id", "text", "_runs"], windows_of)), "_windows")
    second = _finish(waiting.join(compared, "_id", "left"), ["_id", "text", "_runs", "_windows"], keep_text, WINDOW)
    both = first.filter("NOT _waits").select(result).unionByName(second.select(result))
    return both.withColumn("_id", F.when(F.col("_id") < int(LAST), F.col("_id"))).withColumnRenamed("_id", doc_id)
