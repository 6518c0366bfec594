"""Message parsing as column expressions: fingerprints, extraction, classification, pattern search."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from sievelog.functions import patterns as P


def _replace_all(text: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, text)


def _squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fingerprint_mongodb(msg: Column) -> Column:
    return _squeeze(_replace_all(F.coalesce(msg, F.lit("")), [(r"[0-9a-fA-F]{24}", "<ID>"), (r"\d+", "<NUM>")]))


def fingerprint_mssql(msg: Column) -> Column:
    return _replace_all(F.coalesce(msg, F.lit("")), [
        (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "<IP>"),
        (r"for user '[^']+'", "for user '<USER>'"),
        (r"database '[^']+'", "database '<DB>'"),
        (r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+", "<TS>"),
        (r"\b\d+\b", "<NUM>"),
    ])


def fingerprint_es(msg: Column) -> Column:
    return _squeeze(_replace_all(F.coalesce(msg, F.lit("")), [
        (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "<IP>"),
        (r"[0-9a-fA-F]{8,}", "<ID>"),
        (r"\b[\w-]+-\d{4}\.\d{2}\.\d{2}\b", "<INDEX>"),
        (r"\b\d+\b", "<NUM>"),
    ]))


def _alternatives(pattern: str) -> list[str]:
    """The top-level alternatives of a regex."""
    parts, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 1
        elif ch in "([{":
            depth += 1
        elif ch in ")]}":
            depth -= 1
        elif ch == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    return parts + [pattern[start:]]


def _words(alternative: str) -> list[str] | None:
    """The literal words around `.*` when the alternative has nothing else in it, else None."""
    words = [re.sub(r"\\([^\w\s])", r"\1", w) for w in alternative.split(".*")]
    plain = all(not re.search(r"(?<!\\)[\^$.|?*+()\[\]{}]|\\\w", w) for w in alternative.split(".*"))
    return words if plain and all(words) else None


def search(text: Column, pattern: str, case_sensitive: bool = False, lowered: Column | None = None) -> Column:
    """True where the pattern occurs; null text counts as no match.

    Substring tests are many times cheaper than a case-insensitive regex, so literal alternatives become
    `contains`, and `a.*b` runs its regex only on text that holds both words. Callers with many patterns pass
    the lower-cased text as a column, so that it is computed once per line.
    """
    body = text if case_sensitive else F.lower(text) if lowered is None else lowered
    tests, rest = [], []
    for alt in _alternatives(pattern):
        words = _words(alt)
        if words is None:
            rest.append(alt)
            continue
        held = reduce(lambda a, b: a & b, [body.contains(w if case_sensitive else w.lower()) for w in words])
        tests.append(held if len(words) == 1 else held & text.rlike(("" if case_sensitive else "(?i)") + alt))
    if rest:
        tests.append(text.rlike(("" if case_sensitive else "(?i)") + "|".join(rest)))
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def extract(text: Column, pattern: str, group: int = 1, default: str | None = None) -> Column:
    """First match of a group; no match gives the default (null unless one is named)."""
    found = F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
    return found if default is None else F.coalesce(found, F.lit(default))


def extract_int(text: Column, pattern: str, group: int = 1, default: int | None = 0) -> Column:
    found = extract(text, pattern, group).try_cast("bigint")
    return found if default is None else F.coalesce(found, F.lit(default).cast("bigint"))


def message_pairs(msg: Column) -> Column:
    """key="value" pairs of a text message as a map; the last value of a repeated key wins."""
    pat = F.lit(r'(\w+)="([^"]+)"')
    pairs = F.arrays_zip(F.regexp_extract_all(msg, pat, F.lit(1)).alias("k"),
                         F.regexp_extract_all(msg, pat, F.lit(2)).alias("v"))
    return F.aggregate(
        pairs, F.create_map().cast("map<string,string>"),
        lambda acc, p: F.map_concat(F.map_filter(acc, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])))


# ---- relational-database messages ----

def mssql_client_ip(msg: Column) -> Column:
    return F.trim(extract(msg, P.MSSQL_CLIENT_IP, default="unknown"))


def mssql_failure_reason(msg: Column) -> Column:
    return F.when(msg.contains("Login failed"), F.trim(extract(msg, P.MSSQL_REASON)))


def mssql_class(msg: Column) -> Column:
    return first_match([(name, search(msg, pat, cs)) for name, pat, cs in P.MSSQL_CLASSES], "Unknown")


def mssql_level(severity: Column, source_level: Column) -> Column:
    return (F.when(severity >= 20, "fatal").when(severity >= 17, "error").when(severity >= 11, "warning")
            .when(severity > 0, "info").otherwise(F.coalesce(source_level, F.lit("unknown"))))


# ---- search-engine messages ----

def es_line(msg: Column) -> dict[str, Column]:
    """The five bracketed fields of a log line; a line of another shape is all message text."""
    text = F.trim(msg)
    hit = text.rlike(P.ES_LINE)
    part = lambda i: F.trim(F.regexp_extract(text, P.ES_LINE, i))
    return {
        "parsed_timestamp": F.when(hit, part(1)).otherwise(""),
        "log_level": F.when(hit, F.upper(part(2))).otherwise("UNKNOWN"),
        "logger_name": F.when(hit, part(3)).otherwise(""),
        "node_name": F.when(hit, part(4)).otherwise(""),
        "message_text": F.when(hit, part(5)).otherwise(F.coalesce(text, F.lit(""))),
    }


def es_deprecation(msg: Column) -> Column:
    """Struct of a JSON deprecation line (keys hold dots), null when it is not one."""
    m = F.from_json(F.trim(msg), "map<string,string>")
    get = lambda k, d="": F.coalesce(m[k], F.lit(d))
    return F.when(
        F.trim(msg).startswith("{") & (m["log.level"].isNotNull() | m["message"].isNotNull()),
        F.struct(
            get("@timestamp").alias("parsed_timestamp"), F.upper(F.trim(get("log.level", "UNKNOWN"))).alias("log_level"),
            get("log.logger").alias("logger_name"), get("elasticsearch.node.name").alias("node_name"),
            get("message").alias("message_text"), get("event.code").alias("event_code"),
            get("elasticsearch.event.category").alias("event_category"),
            get("elasticsearch.cluster.name").alias("cluster_name"),
            get("elasticsearch.cluster.uuid").alias("cluster_uuid")))


def es_logger_class(logger: Column) -> Column:
    name = F.lower(logger)
    test = lambda words, how: reduce(
        lambda a, b: a | b, [name.contains(w) if how == "contains" else name.startswith(w) for w in words])
    chain = first_match([(cls, test(words, how)) for cls, words, how in P.ES_LOGGER_CLASSES], "other")
    return F.when(F.coalesce(logger, F.lit("")) == "", "unknown").otherwise(chain)


def es_host_role(host: Column) -> Column:
    return first_match([(role, F.upper(host).contains(code)) for role, code in P.ES_HOST_ROLES], "unknown")


# ---- classification shared by the sources ----

def first_match(rules: list[tuple[str, Column]], default) -> Column:
    """Ordered CASE: the first true condition names the result."""
    out = None
    for name, cond in rules:
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(default) if not isinstance(default, Column) else default)


def word_rule(alternatives: list[list[str]], msg: Column, component: Column | None = None,
              severity: Column | None = None) -> Column:
    lowered = F.lower(msg)

    def test(word: str) -> Column:
        if word.startswith("c:"):
            return F.coalesce(F.lower(component) == word[2:], F.lit(False))
        if word.startswith("s:"):
            return F.coalesce(severity == word[2:], F.lit(False))
        return lowered.contains(word)

    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [test(w) for w in alt]) for alt in alternatives])


def anomaly_type(msg: Column, component: Column, severity: Column) -> Column:
    chain = first_match([(n, word_rule(r, msg, component, severity)) for n, r in P.ANOMALY_TYPES], "unknown")
    return F.when(F.coalesce(msg, F.lit("")) == "", "unknown").otherwise(chain)


def mssql_category(msg: Column, component: Column, error_severity: Column) -> Column:
    rest = F.when(error_severity >= 17, "high_severity_error").otherwise(
        F.lower(F.coalesce(F.nullif(component, F.lit("")), F.lit("general"))))
    return first_match([(n, word_rule(r, msg)) for n, r in P.MSSQL_CATEGORIES], rest)


def is_critical_message(msg: Column, source: str) -> Column:
    return F.coalesce(word_rule(P.CRITICAL_MESSAGES[source], msg), F.lit(False))


def first_word(msg: Column) -> Column:
    return F.element_at(F.split(F.trim(msg), r"\s+"), 1)


def approx_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / F.lit(3)).cast("bigint")


def pattern_hits(text: Column, library: dict[str, str] = P.PATTERN_LIBRARY) -> Column:
    """Names of the library patterns that occur in the text."""
    return F.array_compact(F.array(*[F.when(search(text, pat), F.lit(name)) for name, pat in library.items()]))


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit("(?i)" + pattern))


def highlight(text: Column, pattern: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    return F.regexp_replace(text, "(?i)(" + pattern + ")", before + "$1" + after)


def normalize_host(host: Column) -> Column:
    return F.upper(F.regexp_replace(host, P.HOST_SUFFIXES, ""))


def server_from_name(name: Column) -> Column:
    """Server name inside a file or host name, by ordered naming patterns; null when none fits."""
    lowered = F.lower(name)
    return F.coalesce(*[extract(lowered, pat) for pat in P.SERVER_NAME_PATTERNS])
