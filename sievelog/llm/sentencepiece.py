"""SentencePiece BPE by a merge-type prefix table, exact with the library's own result.

For merge-type vocabularies the encoding of a prefix of a text has one last token, and it is the only token ending there
that (a) encodes to itself and (b) may follow the last token of the shorter prefix, that is, merging the two tokens'
joined text gives back the two tokens. An Aho-Corasick automaton over the pieces yields every token ending at a position,
pair tests (remembered) pick the one that fits, and ids are read backwards from the end. Work grows linearly with the
text, also for a text without any space.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame

from sievelog.llm.common import add_fields, per_batch, text_of

#: The white-space mark of the piece vocabulary.
MARK = "▁"
#: Segments and pair tests that a Python worker remembers before it starts anew; results don't depend on them.
REMEMBER = 150_000
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
#: A pair of tokens as one key: left * _SPREAD + right, whose low bits depend on both.
_SPREAD = 1_000_003
#: Ways to cut a text, finest first: letters with the spaces before them, other marks with theirs, digits one by one;
#: words with the spaces before them; not at all.
_CUTS = [re.compile(r" *[^\W\d_²³¹]+| *(?:[^\w ]|[_²³¹])+|\d| +"), re.compile(" *[^ ]+| +"), re.compile("(?s:.+)")]


class PrefixTable:
    """Encoder and decoder for one model file."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a BPE model without normalisation is needed")
        self.prefix = norm.add_dummy_prefix
        self.pieces = [p.piece for p in model.pieces]
        self.kind = [p.type for p in model.pieces]
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kind[i] == _NORMAL}
        self.score = {p: model.pieces[i].score for p, i in self.ids.items()}
        self.unknown = self.kind.index(_UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kind[i] == _BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.whole = {p for p in self.ids if self._merge(p) == [p]}
        # tokens are numbered: pieces by id, characters without a piece by ~code point
        self.automaton = ahocorasick.Automaton()
        for p in self.whole:
            self.automaton.add_word(p, (len(p), self.ids[p]))
        self.automaton.make_automaton()
        self.decimal = [str(i) for i in range(len(self.pieces))]
        self.shown = [{_NORMAL: p.replace(MARK, " "), _UNKNOWN: " ⁇ "}.get(k, "") for p, k in zip(self.pieces, self.kind)]
        # a text may be cut between two characters that stand side by side in no piece
        self.parts = next(c for c in _CUTS if all(len(c.findall(p.replace(MARK, " "))) == 1 for p in self.ids)) if self.bytes else _CUTS[-1]
        self.chars = {p for p in self.whole if len(p) == 1}
        self._alone = {self.ids[p]: True for p in self.whole}  # nothing before them
        self._fits: dict[int, bool] = dict(self._alone)
        self._seen: dict[str, tuple[list[int], str]] = {}

    def _merge(self, text: str) -> list[str]:
        """Plain merging, best score first, leftmost of equals; only for the few characters of two tokens."""
        parts = list(text)
        while True:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    def _piece(self, token: int) -> str:
        return self.pieces[token] if token >= 0 else chr(~token)

    def _test(self, left: int, right: int) -> bool:
        """Whether two tokens may stand side by side."""
        if len(self._fits) >= 2 * REMEMBER:
            self._fits.clear()
            self._fits |= self._alone
        a, b = self._piece(left), self._piece(right)
        found = self._fits[left * _SPREAD + right] = self._merge(a + b) == [a, b]
        return found

    def tokens(self, text: str) -> list[int]:
        """Ids of a marked text; ~code point for a character without a piece."""
        n, fits, last_at = len(text), self._fits.get, -1
        last: list[int | None] = [None] * n + [0]  # last[i]: the last token of text[:i + 1] times _SPREAD; last[-1]: nothing before
        size = [1] * n
        plain = self.chars.issuperset(text)
        for end, (long, piece) in self.automaton.iter(text):
            if last[end] is None:
                if not plain:
                    for i in range(last_at + 1, end):  # characters where no piece ends
                        if last[i] is None:
                            last[i] = ~ord(text[i]) * _SPREAD
                    last_at = end
                before = last[end - long]
                fit = fits(before + piece)
                if fit is None:
                    fit = self._test(before // _SPREAD, piece)
                if fit:
                    last[end] = piece * _SPREAD
                    size[end] = long
        for i in range(last_at + 1, n) if not plain else ():
            if last[i] is None:
                last[i] = ~ord(text[i]) * _SPREAD
        out, i = [], n - 1
        while i >= 0:
            out.append(last[i] // _SPREAD)
            i -= size[i]
        out.reverse()
        return out

    def _ids(self, tokens: list[int]) -> list[int]:
        if min(tokens) >= 0:
            return tokens
        out: list[int] = []
        for t in tokens:
            if t >= 0:
                out.append(t)
            elif self.bytes:
                out.extend(self.bytes[b] for b in chr(~t).encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def segments(self, text: str) -> list[str]:
        """Parts of a text that are encoded on their own. A space and the mark are the same character to the model."""
        if not text:
            return []
        text = (" " if self.prefix else "") + text.replace(MARK, " ")
        return self.parts.findall(text)

    def _segment(self, part: str) -> tuple[str, str]:
        """(ids joined by commas, decoded text) of a part."""
        ids = self._ids(self.tokens(part.replace(" ", MARK)))
        text = self._text(ids)
        found = (",".join([self.decimal[i] for i in ids]), part if text == part else text)
        if len(part) <= 64:
            if len(self._seen) >= REMEMBER:
                self._seen.clear()
            self._seen[part] = found
        return found

    def encode(self, text: str) -> list[int]:
        ids = self.both(text)[0]
        return [*map(int, ids.split(","))] if ids else []

    def _text(self, ids: list[int]) -> str:
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.shown[i] for i in ids])
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            out.append(self.shown[i])
        return "".join(out) + _utf8(bytes(run))

    def decode(self, ids: list[int]) -> str:
        """Text of ids. The space put before the text goes; bytes that are no UTF-8 become U+FFFD each."""
        text = self._text(ids)
        first = next((self.pieces[i] for i in ids if self.kind[i] != _CONTROL), "")
        return text[1:] if self.prefix and first.startswith(MARK) else text

    def both(self, text: str) -> tuple[str, str]:
        """(ids joined by commas, the text that decoding them gives)."""
        seen, segment = self._seen.get, self._segment
        parts = [seen(p) or segment(p) for p in self.segments(text)]
        # parts hold whole characters, so bytes that stand for one are in one part
        text = "".join([p[1] for p in parts])
        return ",".join([p[0] for p in parts]), text[1:] if self.prefix else text


def _utf8(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out = []
        while raw:
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[:n].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                n = 1
            raw = raw[n:]
        return "".join(out)


_tables: dict[str, PrefixTable] = {}


def table(path: str) -> PrefixTable:
    """The table of a model file, built once in a process."""
    if path not in _tables:
        _tables[path] = PrefixTable(path)
    return _tables[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def with_ids(df: DataFrame, model: str, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Adds token_ids (comma-joined decimal ids), decoded, n_tokens, ids_sha256 and decoded_sha256 to every row.

    `model` is a name among the public tokenizer files; each executor opens its own installed copy. Null and empty texts
    have no ids and decode to the empty text. Rows, ties and repeated rows stay as they are; columns of the input with
    these names are replaced. With keep_ids=False the two texts are left out.
    """
    import pyarrow as pa

    def run(texts: list) -> list[tuple]:
        both = table(tokenizer_path(model)).both
        out = []
        for t in texts:
            ids, back = both(t)
            n = ids.count(",") + 1 if ids else 0
            sums = (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
            out.append((*sums, ids, back) if keep_ids else sums)
        return out

    fields = ["n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"] + ["token_ids string", "decoded string"] * keep_ids
    types = [pa.int64()] + [pa.string()] * (len(fields) - 1)
    udf = per_batch(run, ", ".join(fields), types)
    return add_fields(df, udf(text_of(text)), [f.split()[0] for f in fields])
