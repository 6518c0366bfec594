"""Toxicity by a factorization machine over hashed terms.

Terms are words and their first characters, hashed into buckets. A document's score is
sigmoid(w0 + sum of w_i + sum over pairs of v_i . v_j) over the buckets it holds, so two terms may mean together what
neither means alone. The pair sum costs one pass: half of |sum of v_i|^2 - sum of |v_i|^2.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from sievelog.llm.common import add_fields, bounded_sample, per_batch, text_of

#: Bound of the labelled rows a model learns from.
TRAIN_ROWS = 16_000
#: Buckets of hashed terms, buckets kept, lengths of first characters.
BUCKETS, KEPT, STARTS = 1 << 20, 3000, (3, 4, 5, 6)
#: Factors of a bucket, passes over the sample, rows of a step, step size, and pull towards zero.
FACTORS, PASSES, STEP_ROWS, RATE, DECAY = 8, 30, 256, 0.05, 1e-4
#: A text counts to be toxic from here on.
THRESHOLD = 0.5
_WORD = re.compile(r"\w+")
#: Words whose features a Python worker remembers.
REMEMBER = 100_000


def buckets(word: str) -> list[int]:
    """Hash buckets of a word: the whole word and its first characters."""
    terms = [f"={word}"] + [f"^{word[:n]}" for n in STARTS if len(word) >= n]
    return [zlib.crc32(t.encode()) % BUCKETS for t in terms]


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


@dataclass(frozen=True)
class Model:
    """Buckets in use, their weights and factors as bytes, and the constant weight."""

    kept: tuple[int, ...]
    weights: bytes
    factors: bytes
    constant: float

    def scorer(self) -> Scorer:
        return Scorer(self)


class Features:
    """Numbers of the kept buckets in a text."""

    def __init__(self, kept: tuple[int, ...]):
        self.place = {b: i for i, b in enumerate(kept)}
        self._seen: dict[str, tuple[int, ...]] = {}

    def of(self, text: str) -> list[int]:
        seen, out = self._seen, set()
        for w in words(text):
            found = seen.get(w)
            if found is None:
                if len(seen) >= REMEMBER:
                    seen.clear()
                found = seen[w] = tuple(self.place[b] for b in buckets(w) if b in self.place)
            if found:
                out.update(found)
        return sorted(out)


class Scorer:
    def __init__(self, model: Model):
        self.features = Features(model.kept)
        self.constant = model.constant
        self.weights = np.frombuffer(model.weights)
        self.factors = np.frombuffer(model.factors).reshape(-1, FACTORS)

    def raw(self, active: list[int]) -> float:
        v = self.factors[active]
        pair = v.sum(axis=0)
        return float(self.constant + self.weights[active].sum() + 0.5 * (pair @ pair - (v * v).sum()))

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(self.features.of(text)), -50, 50))))


def train(rows: list[tuple[list[int], int]], size: int, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Constant, weights and factors by gradient steps whose size is adapted per parameter, on (active, label) rows."""
    rng = np.random.default_rng(seed)
    w, v = np.zeros(size), rng.normal(0, 0.02, (size, FACTORS))
    share = min(max(np.mean([y for _, y in rows]), 1e-3), 1 - 1e-3) if rows else 0.5
    w0 = float(np.log(share / (1 - share)))
    gw, gv, g0 = np.full(size, 1e-8), np.full((size, FACTORS), 1e-8), 1e-8
    for _ in range(PASSES if rows else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), STEP_ROWS):
            part = [rows[i] for i in order[at:at + STEP_ROWS]]
            flat = np.array([f for a, _ in part for f in a], dtype=np.int64)
            owner = np.repeat(np.arange(len(part)), [len(a) for a, _ in part])
            y = np.array([t for _, t in part], dtype=float)
            total = np.zeros((len(part), FACTORS))
            np.add.at(total, owner, v[flat])
            square = np.bincount(owner, (v[flat] ** 2).sum(axis=1), len(part))
            z = w0 + np.bincount(owner, w[flat], len(part)) + 0.5 * ((total ** 2).sum(axis=1) - square)
            miss = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(part)
            used, inverse = np.unique(flat, return_inverse=True)
            dw = np.bincount(inverse, miss[owner], len(used)) + DECAY * w[used]
            dv = np.zeros((len(used), FACTORS))
            np.add.at(dv, inverse, miss[owner][:, None] * (total[owner] - v[flat]))
            dv += DECAY * v[used]
            gw[used] += dw ** 2
            gv[used] += dv ** 2
            g0 += miss.sum() ** 2
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= 0.3 * RATE * dv / np.sqrt(gv[used])
            w0 -= RATE * miss.sum() / np.sqrt(g0)
    return w0, w, v


def learn(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from documents and their labels. About TRAIN_ROWS labelled ids are chosen by a hash; rows without a label
    are left out, and of several labels of an id the largest counts. The KEPT buckets whose share differs most between
    the labels (in standard errors) are used. Without labelled rows every text scores 0.5.

    The chosen ids (16 bytes each, TRAIN_ROWS of them) are broadcast, so the documents stay where they lie; only counts
    of buckets and the numbers of kept buckets leave the tasks.
    """
    import pyarrow as pa
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).cast("int").alias("_label"))
    chosen = bounded_sample(known, F.col(doc_id), TRAIN_ROWS, known.count())
    rows = df.select(doc_id, text_of(text).alias("_text")).join(F.broadcast(chosen), doc_id)
    all_buckets = per_batch(lambda texts: [(sorted({b for w in words(t) for b in buckets(w)}),) for t in texts], "b array<int>", [pa.list_(pa.int32())])
    split = rows.groupBy("_label").count().collect()
    positive = sum(r["count"] for r in split if r["_label"] > 0)
    negative = sum(r["count"] for r in split) - positive
    if not positive or not negative:
        return Model((), b"", b"", 0.0 if not positive and not negative else 4.0 if positive else -4.0)
    counts = rows.select(F.explode(all_buckets(F.col("_text"))["b"]).alias("b"), "_label").groupBy("b").agg(
        F.sum("_label").alias("p"), F.count(F.lit(1)).alias("n"))
    share = F.col("n") / (positive + negative)
    gap = F.col("p") / positive - (F.col("n") - F.col("p")) / negative
    error = F.sqrt(share * (1 - share) * (1 / positive + 1 / negative)) + 1e-9
    best = counts.filter("n >= 3").select("b", F.abs(gap / error).alias("z")).orderBy(F.desc("z"), "b").limit(KEPT).collect()
    kept = tuple(sorted(r["b"] for r in best))
    active = per_batch(_active(kept), "a array<int>", [pa.list_(pa.int32())])
    data = rows.select(active(F.col("_text"))["a"].alias("a"), F.least("_label", F.lit(1)).alias("y"), doc_id).toArrow().sort_by(doc_id)
    w0, w, v = train([*zip(data["a"].to_pylist(), data["y"].to_pylist())], len(kept))
    return Model(kept, w.tobytes(), v.tobytes(), w0)


def _active(kept: tuple[int, ...]):
    made: list[Features] = []

    def run(texts: list) -> list[tuple]:
        if not made:
            made.append(Features(kept))
        return [(made[0].of(t),) for t in texts]

    return run


_scorers: dict[Model, Scorer] = {}


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from THRESHOLD on) to every row. Null and empty texts score as texts without
    any term. Whole texts count. Columns of the input with these names are replaced."""
    import pyarrow as pa

    def run(texts: list) -> list[tuple]:
        if model not in _scorers:
            _scorers.clear()
            _scorers[model] = model.scorer()
        out = [_scorers[model].score(t) for t in texts]
        return [(s, int(s >= THRESHOLD)) for s in out]

    udf = per_batch(run, "score double, predicted int", [pa.float64(), pa.int32()])
    return add_fields(df, udf(text_of(text)), ["score", "predicted"])
