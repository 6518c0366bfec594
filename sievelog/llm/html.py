"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Pass 1 labels a block from its length, its share of stop words and its
share of linked text; blocks of menus, forms, notices and the like are bad at once. Pass 2 gives an undecided short block
the label of its nearest decided neighbours. Inside an article a block is bad for its links or its container only: what
stop words leave open there is undecided, and neighbours are looked up inside the article.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

from pyspark.sql import DataFrame

from sievelog.llm.common import add_fields, per_batch, text_of

#: Thresholds: characters of a short and of a long block, shares of stop words, share of linked characters.
SHORT, LONG, STOPS_LOW, STOPS_HIGH, LINKED = 70, 200, 0.30, 0.32, 0.2

#: Frequent words of English, German, French and Spanish.
STOPS = frozenset("""
the of and to in a is that for it as was with be by on not he his this are or at from an which but have
der die das und in den von zu mit ist des im für auf dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
le la les de des du et un une en est que qui dans pour par sur au pas ce il ne se avec son plus
el la los las de y en un una que es por con para del se no lo su al como más
""".split())

#: Tags by what they do to a page's text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template textarea title iframe object svg math select button canvas audio video".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre
section summary table tbody td tfoot th thead tr ul""".split())
CONTAINERS = frozenset("article aside blockquote body dialog div fieldset footer form header main menu nav section table td ul ol".split())
BOILER_TAGS = frozenset("aside dialog fieldset footer form menu nav".split())
ZONE_TAGS = frozenset("article main".split())
#: Words in class, id and role attributes that name what isn't the article.
BOILER_NAMES = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent
cookie cookies disclaimer disqus footer footnav header login masthead menu modal nav navbar navigation newsletter notice
pagination pager popup promo promoted promotion related reply replies search share sharing sidebar signup skip social sponsor
sponsored subscribe subscription tags teaser toolbar widget complementary contentinfo alert dialog form""".split())
ZONE_NAMES = frozenset("article articlebody content entry main maincontent post story".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_UNCLOSED = re.compile("<[a-zA-Z/!?]")
_WORDS = re.compile(r"\w+")
GOOD, BAD, OPEN = 1, -1, 0


class _Block:
    __slots__ = ("text", "linked", "boiler", "zone")

    def __init__(self, text: str, linked: int, boiler: bool, zone: int):
        self.text, self.linked, self.boiler, self.zone = text, linked, boiler, zone


def _marks(tag: str, attributes: str, in_zone: bool) -> tuple[bool, bool]:
    """Whether a tag starts something other than the article, and whether it starts the article."""
    boiler, zone = tag in BOILER_TAGS, tag in ZONE_TAGS
    if tag == "header":
        boiler = not in_zone
    if attributes:
        for m in _NAMED.finditer(attributes):
            for name in (m[1] or m[2] or m[3] or "").lower().split():
                parts = {name, *re.split(r"[-_]", name)}
                boiler = boiler or bool(parts & BOILER_NAMES)
                zone = zone or name.replace("-", "").replace("_", "") in ZONE_NAMES
        boiler = boiler or bool(_HIDDEN.search(attributes))
    return boiler, zone and not boiler


def blocks(html: str) -> list[_Block]:
    """Text blocks of a page in order."""
    out: list[_Block] = []
    stack: list[tuple[str, bool, int]] = []  # open containers: tag, inside boiler, zone number
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    linked: list[str] = []
    links, at, zones, own = 0, 0, 0, False

    def flush() -> None:
        nonlocal own
        text = " ".join(unescape("".join(pieces)).split()) if pieces else ""
        if text:
            _, boiler, zone = stack[-1] if stack else ("", False, 0)
            out.append(_Block(text, len(" ".join(unescape("".join(linked)).split())), boiler or own, zone))
        pieces.clear()
        linked.clear()
        own = False

    def add(text: str) -> None:
        pieces.append(text)
        if links:
            linked.append(text)

    closed = html.rfind(">") + 1  # no tag ends beyond; so a search never runs to the end in vain
    while True:
        m = _TOKEN.search(html, at, closed)
        if m is None:
            add(html[at:closed] if at < closed else "")
            add(_UNCLOSED.split(html[max(at, closed):], maxsplit=1)[0])
            break
        if m.start() > at:
            add(html[at:m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                break
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>").replace("&", "&amp;").replace("<", "&lt;"))
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in SKIPPED:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*+>", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in BLOCKS:
            continue
        flush()
        links = 0
        if tag not in CONTAINERS:
            if not closing:
                own = _marks(tag, attributes, bool(stack and stack[-1][2]))[0]
            continue
        if closing:
            while opened[tag]:
                top = stack.pop()[0]
                opened[top] -= 1
                if top == tag:
                    break
            continue
        _, boiler, zone = stack[-1] if stack else ("", False, 0)
        starts_boiler, starts_zone = _marks(tag, attributes, bool(zone)) if tag != "body" else (False, False)
        if starts_zone and not zone and not boiler:
            zones += 1
            zone = zones
        stack.append((tag, boiler or starts_boiler, zone))
        opened[tag] += 1
    flush()
    return out


def first_pass(block: _Block, stops: frozenset[str] = STOPS) -> int:
    """GOOD, BAD or OPEN from the block alone."""
    size = len(block.text)
    if block.boiler or block.linked > LINKED * size:
        return BAD
    words = _WORDS.findall(block.text.lower())
    share = sum(w in stops for w in words) / len(words) if words else 0.0
    if size < SHORT:
        return BAD if block.linked and not block.zone else OPEN
    if share >= STOPS_HIGH:
        return GOOD if size > LONG or block.zone else OPEN
    if share >= STOPS_LOW or block.zone:
        return OPEN
    return BAD


def second_pass(found: list[_Block], labels: list[int]) -> list[bool]:
    """Open blocks take the label of their nearest decided neighbours. Where these differ, one of at least SHORT
    characters is good and a shorter one bad; inside an article only blocks of the same article are neighbours, what isn't
    one of its own boiler blocks counts, and good wins."""
    out = []
    before = _nearest(found, labels, range(len(labels)))
    after = _nearest(found, labels, range(len(labels) - 1, -1, -1))
    for i, (block, label) in enumerate(zip(found, labels)):
        if label == OPEN:
            a, b = before[i], after[i]
            if block.zone:
                label = BAD if a == b == BAD else GOOD
            elif a == b:
                label = a
            else:
                label = GOOD if len(block.text) >= SHORT else BAD
        out.append(label == GOOD)
    return out


def _nearest(found: list[_Block], labels: list[int], order) -> list[int]:
    """For each block the last decided label met before it, by article; at an edge BAD outside and OPEN inside one."""
    last: dict[int, int] = {}
    out = [BAD] * len(labels)
    for i in order:
        zone = found[i].zone
        out[i] = last.get(zone, OPEN if zone else BAD)
        if labels[i] != OPEN and not (zone and found[i].boiler):
            last[zone] = labels[i]
    return out


def main_text(html: str, stops: frozenset[str] = STOPS) -> str:
    found = blocks(html)
    keep = second_pass(found, [first_pass(b, stops) for b in found])
    if not any(keep):  # nothing decided for the page: what isn't boiler stays
        keep = [first_pass(b, stops) == OPEN for b in found]
    return " ".join(b.text for b, k in zip(found, keep) if k)


def extract(df: DataFrame, html: str = "html", stops: frozenset[str] = STOPS) -> DataFrame:
    """Adds text, the main text of the whole page, and n_chars, its characters, to every row. Null and empty pages, and
    pages without an article, have the empty text. Columns of the input with these names are replaced; repeated rows stay
    as they are."""
    import pyarrow as pa

    def run(pages: list) -> list[tuple]:
        out = [main_text(p, stops) for p in pages]
        return [(t, len(t)) for t in out]

    udf = per_batch(run, "text string, n_chars bigint", [pa.string(), pa.int64()])
    return add_fields(df, udf(text_of(html)), ["text", "n_chars"])
