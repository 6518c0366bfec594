"""Language identification by compression: per language one zstandard raw-content dictionary of training text; a text
belongs to the language whose dictionary makes it smallest."""

from __future__ import annotations

import re
from dataclasses import dataclass

import regex
from pyspark.sql import Column, DataFrame, functions as F

from sievelog.llm.common import add_fields, bounded_sample, per_batch, text_of

#: Bound of what the dictionaries learn from: documents of a language, characters of each, bytes of a dictionary.
TRAIN_DOCUMENTS, TRAIN_CHARACTERS, DICTIONARY_BYTES = 400, 2000, 96 << 10
#: Characters compressed on their own, so that a long text is measured against the dictionary and not against itself.
WINDOW = 1500
#: Compression level, and the least margin of the best over the second, as a share of the second's bytes.
LEVEL, MARGIN = 6, 0.005
#: What stands between words: anything but letters and the marks beside them (Unicode categories L and M).
_REST, _ASCII_REST, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), re.compile("[^A-Za-z]+"), regex.compile(r"\p{L}")


def letters(text: str) -> str:
    """Lower-case words; digits and signs say nothing about a language. Empty without a letter."""
    if text.isascii():
        return _ASCII_REST.sub(" ", text).strip().lower()
    return _REST.sub(" ", text).strip().lower() if _LETTER.search(text) else ""


@dataclass(frozen=True)
class Model:
    """Raw dictionary content by language, in order of the names."""

    contents: tuple[tuple[str, bytes], ...]


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Dictionaries from labelled rows: of each language about TRAIN_DOCUMENTS rows chosen by a hash of the key and the
    first TRAIN_CHARACTERS characters of each, DICTIONARY_BYTES together. Rows without a label or text teach nothing;
    without any row every text is undetermined."""
    rows = labelled.filter(F.col(lang).isNotNull() & (F.length(text_of(text)) > 0)).select(
        F.col(lang).cast("string").alias("lang"), F.substring(text_of(text), 1, TRAIN_CHARACTERS).alias("text"), F.col(key).alias("key"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    contents = []
    for name in sorted(counts):
        sample = bounded_sample(rows.filter(F.col("lang") == name), F.col("key"), TRAIN_DOCUMENTS, counts[name])
        sample = sorted(sample.select(F.xxhash64("key").alias("key"), "text").collect())
        raw = b""
        for piece in (letters(r["text"]).encode() for r in sample):
            if len(raw) + len(piece) < DICTIONARY_BYTES:
                raw += piece + b" "
        if raw.strip():
            contents.append((name, raw))
    return Model(tuple(contents))


class Judge:
    """Compressors of a model, one a process."""

    def __init__(self, model: Model):
        import zstandard as z
        self.names = [n for n, _ in model.contents]
        self.packers = []
        for _, raw in model.contents:
            known = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            self.packers.append(z.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))

    def bytes_of(self, text: str) -> list[int]:
        """Compressed bytes of the text's letters under every dictionary, summed over windows."""
        raw = letters(text).encode()
        parts = [raw[i:i + WINDOW] for i in range(0, len(raw), WINDOW)]
        if len(parts) > 1 and len(parts[-1]) < WINDOW // 2:  # a short rest joins its neighbour
            parts[-2:] = [parts[-2] + parts[-1]]
        return [sum(len(p.compress(x)) for x in parts) for p in self.packers] if raw else []

    def judge(self, text: str) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        sizes = self.bytes_of(text)
        if not sizes:
            return "und", 0.0, True
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        if len(order) == 1:
            return self.names[0], 1.0, False
        best, second = sizes[order[0]], sizes[order[1]]
        margin = (second - best) / second
        # bytes saved against the second, as odds: 1/2 at a tie
        return self.names[order[0]], 1 / (1 + 2.0 ** -min(second - best, 50)), margin < MARGIN


_judges: dict[Model, Judge] = {}


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and rejected. A text without letters, null and empty ones too, is `und` with score 0 and
    rejected; a tie goes to the first name and is rejected. The whole text counts. Columns of the input with these names
    are replaced; the dictionaries (DICTIONARY_BYTES a language) travel with the function."""
    import pyarrow as pa

    def run(texts: list) -> list[tuple]:
        if model not in _judges:
            _judges.clear()
            _judges[model] = Judge(model)
        return [*map(_judges[model].judge, texts)]

    udf = per_batch(run, "lang_pred string, score double, rejected boolean", [pa.string(), pa.float64(), pa.bool_()])
    return add_fields(df, udf(text_of(text)), ["lang_pred", "score", "rejected"])
