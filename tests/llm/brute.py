"""Plain versions of the corpus operators, for small inputs."""

import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def groups(ids, same):
    """Smallest id of the connected part of each id."""
    up = {i: i for i in ids}

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in same:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def links(texts):
    """Pairs of places whose shingle sets have a Jaccard similarity of 0.8 and more."""
    sets, where, out = [shingles(t) for t in texts], defaultdict(list), []
    for i, s in enumerate(sets):
        both = Counter(j for x in s for j in where[x])
        out += [(j, i) for j, n in both.items() if 5 * n >= 4 * len(s | sets[j])]
        for x in s:
            where[x].append(i)
    return out


def windows(items, size=13):
    found = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            found[tuple(w[j:j + n])].add(i)
    return found


def hits(text, found):
    """(words, words inside windows, items)."""
    w, hit, items = words(text), set(), set()
    for n in {len(k) for k in found}:
        for j in range(len(w) - n + 1):
            here = found.get(tuple(w[j:j + n]))
            if here:
                hit.update(range(j, j + n))
                items |= here
    return len(w), len(hit), sorted(items)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


PERSONAL = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def personal(text):
    out = []
    for k, (kind, pattern) in enumerate(PERSONAL):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


SECRET = [("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
          ("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)]


def secrets(text):
    out = []
    for k, (kind, pattern, least) in enumerate(SECRET):
        for m in re.finditer(pattern, text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)
