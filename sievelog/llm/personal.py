"""Personal data: rules find the base kinds, and boosted trees judge the candidates of high-recall generators.

Everything a row goes through is a column expression. Two generators propose spans that may overlap the base spans and
each other; gradient-boosted trees, trained on the candidates of half the documents, whose weak label is overlap with a
base span, see only a candidate's format and context, not the rules' checks; a threshold per generator, calibrated on the
other half, selects the candidates that are added. The trained trees become CASE expressions, so scoring needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sievelog.llm.common import text_of
from sievelog.sources.store import materialise

_LOCAL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: The base kinds in their order. Runs are taken whole and start where a run starts or the last match ended,
#: which finds the same matches as the plain patterns and keeps long runs linear.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_HOST}]++(?:\.[{_HOST}]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_OUT = r"""\s@<>"'()\[\],;:"""
GENERATORS = {
    "email_like": rf"(?:\G|(?<![^{_OUT}]))[^{_OUT}]++@[^{_OUT}]++",
    "number_like": r"(?<![0-9])\(?[0-9](?:[ ().-]{0,2}+[0-9]){6,}+",
}
#: What a text must hold for a kind to be looked for at all: a sign, or a pattern that each match has inside.
SIGN = {"email": "@", "phone": "+", "email_like": "@"}
INSIDE = {"ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": "[0-9](?:[ -]?[0-9]){11}", "number_like": "[0-9](?:[ ().-]{0,2}[0-9]){6}"}
#: Trees, their depth, least precision of an added span's threshold.
TREES, DEPTH, PRECISION = 12, 3, 0.98
#: Characters of context before a candidate.
CONTEXT = 24
THRESHOLDS = [0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.93, 0.96, 0.98, 0.99]
FEATURES = ["length", "digits", "letters", "dots", "dashes", "spaces", "parens", "longest", "word_before", "letter_before", "sign_after", "letter_after"]


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """The check that a match must pass."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _with_matches(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """_m_kind: the matches in `_text`; _b_kind: the texts between them, one more; _a_kind: where the matches start, in
    characters. Each regex runs twice; nothing is computed again by what refers to it."""
    df = df.withColumn("_seven", F.col("_text").rlike(INSIDE["number_like"]))  # a card holds seven digits so, too
    there = {k: F.instr("_text", SIGN[k]) > 0 if k in SIGN else F.col("_text").rlike(INSIDE[k]) for k in patterns if k != "number_like"}
    there |= {"number_like": F.col("_seven"), "card": F.col("_seven") & there["card"]}
    none = F.array().cast("array<string>")
    rows = df.withColumns({f"_m_{k}": F.when(there[k], F.regexp_extract_all("_text", F.lit(p), F.lit(0))).otherwise(none) for k, p in patterns.items()})
    rows = rows.withColumns({f"_b_{k}": F.when(F.size(f"_m_{k}") > 0, F.split("_text", p, -1)).otherwise(none) for k, p in patterns.items()})
    starts = {}
    for k in patterns:
        gaps = F.slice(F.transform(f"_b_{k}", F.length), F.lit(1), F.size(f"_m_{k}"))
        steps = F.zip_with(gaps, F.transform(f"_m_{k}", F.length), lambda gap, long: F.struct(gap.alias("gap"), long.alias("long")))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda a, s: F.struct((a["at"] + s["gap"] + s["long"]).alias("at"), F.concat(a["out"], F.array(a["at"] + s["gap"])).alias("out"))
        starts[f"_a_{k}"] = F.when(F.size(f"_m_{k}") > 0, F.aggregate(steps, zero, step, lambda a: a["out"])).otherwise(F.array().cast("array<int>"))
    return rows.withColumns(starts).drop("_seven")


def _spans(kind: str, order: int, check=None) -> Column:
    """(start, order, end, kind, value) of the matches of a kind that pass the check, in characters; without a check also
    the CONTEXT characters before them and the one after, as far as the next match."""
    fields = lambda v, a: [a.cast("long").alias("start"), F.lit(order).alias("order"), (a + F.length(v)).cast("long").alias("end"), F.lit(kind).alias("kind"), v.alias("value")]
    if check is not None:
        return F.filter(F.zip_with(f"_m_{kind}", f"_a_{kind}", lambda v, a: F.struct(*fields(v, a))), lambda s: check(s["value"]))
    ends = F.transform(f"_b_{kind}", lambda t: F.struct(F.right(t, F.lit(CONTEXT)).alias("last"), F.left(t, F.lit(1)).alias("first")))
    around = F.zip_with(F.slice(ends, F.lit(1), F.size(f"_m_{kind}")), F.slice(ends, F.lit(2), F.size(f"_m_{kind}")), lambda a, b: F.struct(a["last"].alias("before"), b["first"].alias("after")))
    return F.zip_with(F.zip_with(f"_m_{kind}", f"_a_{kind}", lambda v, a: F.struct(*fields(v, a))), around, lambda s, c: F.struct(
        *[s[n].alias(n) for n in ("start", "order", "end", "kind", "value")], F.lower(c["before"]).alias("before"), c["after"].alias("after")))


def _yes(c: Column) -> Column:
    return c.cast("double")


def _format(s: Column) -> Column:
    """Features of a candidate, in the order of FEATURES."""
    v = s["value"]
    many = lambda rest: F.length(F.regexp_replace(v, rest, "")).cast("double")
    before, after = s["before"], s["after"]
    longest = F.array_max(F.transform(F.split(v, r"[^\p{L}0-9]+"), F.length)).cast("double")
    return F.array(F.length(v).cast("double"), many("[^0-9]"), many(r"[^\p{L}]"), many("[^.]"), many("[^-]"), many("[^ ]"), many("[^()]"), longest,
                   _yes(before.rlike(r"(?:tel|phone|call|fax|mobile|mail|contact|card|visa|ip|host|addr)[a-z]*[ :.]*[+(]?$")),
                   _yes(before.rlike(r"\p{L}$")), _yes(after.rlike("[%#$&*@_/]")), _yes(after.rlike(r"\p{L}")))


@dataclass(frozen=True)
class Model:
    """Trees as texts, their weights, and a threshold per generator (above 1: nothing is added)."""

    trees: tuple[str, ...]
    weights: tuple[float, ...]
    thresholds: tuple[float, ...]


def _tree(text: str, x: Column) -> Column:
    """A trained tree, printed as nested If / Else / Predict lines, as nested CASE expressions over an array of features."""
    lines = iter([line.strip() for line in text.splitlines()[1:] if line.strip()])

    def node() -> Column:
        line = next(lines)
        if line.startswith("Predict:"):
            return F.lit(float(line.split(":")[1]))
        feature, bound = line[line.index("feature") + 8:line.rindex(")")].split(" <= ")
        low = node()
        next(lines)  # Else
        return F.when(x[int(feature)] <= float(bound), low).otherwise(node())

    return node()


def probability(model: Model, x: Column) -> Column:
    if not model.trees:
        return F.lit(0.0)
    margin = reduce(lambda a, b: a + b, [F.lit(w) * _tree(t, x) for t, w in zip(model.trees, model.weights)])
    return 1 / (1 + F.exp(-2 * margin))


def candidates(df: DataFrame) -> DataFrame:
    """Adds _base, the base spans, and _proposed, the generators' spans with features and whether they overlap a base one."""
    rows = _with_matches(df, BASE | GENERATORS)
    base = F.concat(*[_spans(k, i, lambda v, k=k: _holds(k, v)) for i, k in enumerate(BASE)])
    rows = rows.withColumn("_base", F.array_sort(base))
    rows = rows.withColumn("_found", F.concat(*[_spans(k, len(BASE) + i) for i, k in enumerate(GENERATORS)]))
    rows = rows.drop(*[f"_{c}_{k}" for c in "mab" for k in BASE | GENERATORS])
    return rows.withColumn("_proposed", F.transform("_found", lambda s: F.struct(
        s["start"], s["order"], s["end"], s["kind"], _format(s).alias("x"),
        F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])).alias("known")))).drop("_found")


def learn(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Trees and thresholds from all documents: a hash of the id tells which half trains and which calibrates. Where either
    label is missing no span is added."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector
    spans = candidates(df.select(F.col(doc_id).alias("_id"), text_of(text).alias("_text"))).select("_id", F.explode("_proposed").alias("s")).select("_id", "s.kind", "s.x", F.col("s.known").cast("double").alias("label"))
    spans = materialise(spans, "candidates")  # both halves read it again and again
    half = F.pmod(F.xxhash64("_id", F.lit("half")), F.lit(2))
    train = spans.filter(half == 0).select(array_to_vector("x").alias("features"), "label")
    seen = train.groupBy("label").count().collect()
    nothing = Model((), (), (2.0,) * len(GENERATORS))
    if len(seen) < 2:
        return nothing
    fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, cacheNodeIds=False).fit(train)
    model = Model(tuple(t.toDebugString for t in fitted.trees), tuple(fitted.treeWeights), nothing.thresholds)
    judged = spans.filter(half == 1).withColumn("p", probability(model, F.col("x")))
    right = [F.avg(F.when(F.col("p") >= t, F.col("label"))).alias(f"t{i}") for i, t in enumerate(THRESHOLDS)]
    found = {r["kind"]: r for r in judged.groupBy("kind").agg(*right).collect()}
    least = lambda r: next((t for i, t in enumerate(THRESHOLDS) if (r[f"t{i}"] or 0) >= PRECISION), 2.0)
    return Model(model.trees, model.weights, tuple(least(found[k]) if k in found else 2.0 for k in GENERATORS))


def find(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds base_spans and all_spans, arrays of (start, order, end, kind) by start and then kind, in characters.

    Base spans always stay; a generator's span is added where it overlaps no base span and its probability reaches the
    threshold of its generator. Null and empty texts have no spans. Whole texts are searched. Columns of the input with
    these names are replaced.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = candidates(df.select(own.alias("_row"), text_of(text).alias("_text")))
    narrow = lambda s: F.struct(s["start"], s["order"], s["end"], s["kind"])
    limits = F.array(*[F.lit(t) for t in model.thresholds])
    chosen = F.filter("_proposed", lambda s: ~s["known"] & (probability(model, s["x"]) >= limits[s["order"] - len(BASE)]))
    kept = [F.col("_row")[c].alias(c) for c in df.columns if c.lower() not in ("base_spans", "all_spans")]
    base = F.transform("_base", narrow)
    return rows.select(*kept, base.alias("base_spans"), F.array_sort(F.concat(base, F.transform(chosen, narrow))).alias("all_spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping or not, replaced by its kind in brackets; spans are sorted by start."""
    step = lambda a, s: F.when(s["start"] < a["at"], F.struct(a["out"], F.greatest(a["at"], s["end"]).alias("at"))).otherwise(F.struct(
        F.concat(a["out"], F.substring(text, a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at")))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"].cast("int") + 1, F.length(text))))
