"""Secret scans with one deterministic automaton for all rules.

Rules are regular expressions over bytes. Their syntax trees become one nondeterministic automaton, subset construction
and partition refinement make it deterministic and minimal, and its transitions are one flat array. A scan reads each
byte once for all rules; a rule's match ends where its acceptance ends, and the rule's reversed automaton, run back from
there, finds where the leftmost match starts.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from sievelog.llm.common import add_fields, per_batch, text_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Lengths belong in `least` rather than in the pattern where a match can start inside another's
    run: counting in the pattern multiplies states. `least` is the smallest length of the match, or of its tail of `tail` characters if given;
    shorter matches are dropped, and what they cover is not searched again."""

    kind: str
    pattern: str
    least: int = 1
    tail: str = ""


#: The three base kinds, in their order, then formats of well-known providers.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?[A-Za-z0-9+/_.=-]+""", 6, "value"),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{4,}", 24),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 36),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[0-9A-Za-z_-]+", 39),
)
RULES = BASE + ADDED


class _Parser:
    """Syntax: literals, escapes, classes with ranges, groups, | * + ? {m} {m,} {m,n}. Trees: (op, ...)."""

    def __init__(self, pattern: str):
        self.text, self.at = pattern.encode(), 0

    def more(self) -> str:
        return chr(self.text[self.at]) if self.at < len(self.text) else ""

    def take(self) -> int:
        self.at += 1
        return self.text[self.at - 1]

    def either(self):
        parts = [self.run()]
        while self.more() == "|":
            self.at += 1
            parts.append(self.run())
        return ("or", parts) if len(parts) > 1 else parts[0]

    def run(self):
        parts = []
        while self.more() and self.more() not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("and", parts)

    def atom(self):
        c = self.take()
        if c == ord("("):
            inside = self.either()
            if self.more() != ")":
                raise ValueError("a group isn't closed")
            self.at += 1
            return inside
        if c == ord("["):
            return ("set", self.members())
        return ("set", frozenset([self.take() if c == ord("\\") else c]))

    def members(self) -> frozenset[int]:
        out: set[int] = set()
        while self.more() != "]":
            low = self.take()
            low = self.take() if low == ord("\\") else low
            if self.more() == "-" and self.text[self.at + 1:self.at + 2] != b"]":
                self.at += 1
                out.update(range(low, self.take() + 1))
            else:
                out.add(low)
        self.at += 1
        return frozenset(out)

    def repeated(self, tree):
        c = self.more()
        if c in ("*", "+", "?") and c:
            self.at += 1
            return {"*": ("repeat", tree, 0, None), "+": ("repeat", tree, 1, None), "?": ("repeat", tree, 0, 1)}[c]
        if c == "{":
            end = self.text.index(b"}", self.at)
            low, comma, high = self.text[self.at + 1:end].decode().partition(",")
            self.at = end + 1
            return ("repeat", tree, int(low), int(high) if high else None if comma else int(low))
        return tree


def parse(pattern: str):
    p = _Parser(pattern)
    tree = p.either()
    if p.at < len(p.text):
        raise ValueError(f"can't read {pattern!r} from {p.at}")
    return tree


class Machine:
    """Nondeterministic automaton: per state the empty moves and the moves (bytes, to)."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree, start: int, backwards: bool = False) -> int:
        """Adds a tree behind a state and returns its end state."""
        if tree[0] == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if tree[0] == "and":
            for part in reversed(tree[1]) if backwards else tree[1]:
                start = self.add(part, start, backwards)
            return start
        if tree[0] == "or":
            end = self.state()
            for part in tree[1]:
                self.empty[self.add(part, start, backwards)].append(end)
            return end
        _, part, low, high = tree
        for _ in range(low):
            start = self.add(part, start, backwards)
        if high is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(part, loop, backwards)].append(loop)
            return loop
        end = self.state()
        self.empty[start].append(end)
        for _ in range(high - low):
            start = self.add(part, start, backwards)
            self.empty[start].append(end)
        return end

    def closed(self, states: Iterable[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Automaton:
    """Minimal deterministic automaton. Bytes that no rule tells apart share a class: `classes` maps bytes to classes,
    `step[state + class]` is the next state. States are multiples of `width`, the number of classes; the start is
    `first`, states from `accepting` on accept the rules in `accepts[state]`, `dead` has no way to a match."""

    def __init__(self, machine: Machine, start: Iterable[int], final: dict[int, int]):
        sets = list({chars for moves in machine.moves for chars, _ in moves})
        known: dict[tuple[bool, ...], int] = {}
        self.classes = bytes(known.setdefault(tuple(c in s for s in sets), len(known)) for c in range(256))
        self.width = len(known)
        some = [self.classes.index(c) for c in range(self.width)]
        inside = {chars: [c for c in range(self.width) if some[c] in chars] for chars in sets}
        first = machine.closed(start)
        ids, todo, rows, accepts = {first: 0}, [first], [], []
        while len(rows) < len(todo):
            here = todo[len(rows)]
            to: list[set[int]] = [set() for _ in range(self.width)]
            for s in here:
                for chars, t in machine.moves[s]:
                    for c in inside[chars]:
                        to[c].add(t)
            row, seen = [], {}
            for targets in map(frozenset, to):
                if targets not in seen:
                    there = machine.closed(targets)
                    if there not in ids:
                        ids[there] = len(todo)
                        todo.append(there)
                    seen[targets] = ids[there]
                row.append(seen[targets])
            rows.append(row)
            accepts.append(frozenset(final[s] for s in here if s in final))
        self._minimise(rows, accepts)

    def _minimise(self, rows: list[list[int]], accepts: list[frozenset[int]]) -> None:
        """Parts the states by what they accept, then by where their bytes lead, until no part splits."""
        import numpy as np
        table = np.array(rows)
        kinds = {a: i for i, a in enumerate(dict.fromkeys(accepts))}
        part = np.array([kinds[a] for a in accepts])
        while True:
            finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].reshape(-1)
            if finer.max() == part.max():
                break
            part = finer
        some = {int(p): i for i, p in reversed(list(enumerate(part)))}
        order = sorted(some, key=lambda p: (bool(accepts[some[p]]), some[p]))
        place = {p: n * self.width for n, p in enumerate(order)}  # one object a state
        self.step = [place[int(part[t])] for p in order for t in rows[some[p]]]
        self.accepts = {place[p]: accepts[some[p]] for p in order}
        self.first = place[int(part[0])]
        self.accepting = min((place[p] for p in order if accepts[some[p]]), default=len(self.step))
        self.dead = next((s for s, a in self.accepts.items() if not a and all(t == s for t in self.step[s:s + self.width])), -1)


class Scanner:
    """All rules in one automaton for the scan, and one reversed automaton a rule for the starts."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        trees = [parse(r.pattern) for r in rules]
        both = Machine()
        start = both.state()
        both.moves[start].append((frozenset(range(256)), start))  # a match may start at any byte
        self.whole = Automaton(both, [start], {both.add(t, start): k for k, t in enumerate(trees)})
        self.back = []
        for rule, tree in zip(rules, trees):
            one = Machine()
            root = one.state()
            self._ends_once(rule, Automaton(one, [root], {one.add(tree, root): 0}))
            one = Machine()
            root = one.state()
            self.back.append(Automaton(one, [root], {one.add(tree, root, backwards=True): 0}))

    @staticmethod
    def _ends_once(rule: Rule, alone: Automaton) -> None:
        """A match that has begun to be accepted must stay so for as long as it can go on: then the end of acceptance is
        the end of the longest match."""
        for s, a in alone.accepts.items():
            for t in alone.step[s:s + alone.width] if a else ():
                if t != alone.dead and not alone.accepts[t]:
                    raise ValueError(f"rule {rule.kind}: a match can pause")

    def spans(self, raw: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, leftmost and not overlapping within a rule, by start and rule."""
        step, accepts, accepting, state = self.whole.step, self.whole.accepts, self.whole.accepting, self.whole.first
        ends: list[list[int]] = [[] for _ in self.rules]
        live: frozenset[int] = frozenset()
        for i, c in enumerate(raw.translate(self.whole.classes)):
            state = step[state + c]
            if state >= accepting:
                now = accepts[state]
                if live is not now:
                    for k in live - now:
                        ends[k].append(i)
                    live = now
            elif live:
                for k in live:
                    ends[k].append(i)
                live = frozenset()
        for k in live:
            ends[k].append(len(raw))
        out = []
        for k, rule in enumerate(self.rules):
            free = 0
            for end in ends[k]:
                start = self._start(k, raw, free, end)
                if start < 0:
                    continue
                free = end
                if (self._tail(raw, start, end) if rule.tail else end - start) >= rule.least:
                    out.append((start, k, end))
        return sorted(out)

    def _start(self, k: int, raw: bytes, free: int, end: int) -> int:
        """Smallest start from `free` on of a match that ends at `end`, or -1."""
        back, found = self.back[k], -1
        state = back.first
        for i in range(end - 1, free - 1, -1):
            state = back.step[state + back.classes[raw[i]]]
            if state == back.dead:
                break
            if state >= back.accepting:
                found = i
        return found

    @staticmethod
    def _tail(raw: bytes, start: int, end: int) -> int:
        """Length of the value behind the first sign of an assignment, its spaces and its quote."""
        at = min(x for x in (raw.find(b":", start, end), raw.find(b"=", start, end)) if x >= 0) + 1
        while at < end and raw[at] == 32:
            at += 1
        if at < end and raw[at] in b"\"'":
            at += 1
        return end - at


_scanners: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


def find(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, rule, end) in characters."""
    raw = text.encode()
    found = scanner(rules).spans(raw)
    if len(raw) == len(text):
        return found
    at = lambda i: len(raw[:i].decode("utf-8", "ignore"))  # noqa: E731  rules are ASCII, so spans cut no character
    return [(at(a), k, at(b)) for a, k, b in found]


def scan(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    """Adds secrets, an array of (kind, start, end) in characters by start and then kind, and is_base for the first
    `base` rules. Null and empty texts have none. Columns of the input with this name are replaced."""
    import pyarrow as pa
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("is_base", pa.bool_())]))

    def run(texts: list) -> list[tuple]:
        return [([{"kind": rules[k].kind, "start": a, "end": b, "is_base": k < base} for a, k, b in find(t, rules)],) for t in texts]

    udf = per_batch(run, "secrets array<struct<kind:string,start:bigint,end:bigint,is_base:boolean>>", [kind])
    return add_fields(df, udf(text_of(text)), ["secrets"])
