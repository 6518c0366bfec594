"""Queries of the corpus operators, named op<number>_<name>, and the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from sievelog.llm import alignment as op12, automaton as op10, chosen_path as op8, exact_dedup as op5, html as op3, language as op2, lexical_search as op13, personal as op4, phrase_automata as op11, sentencepiece as op1, suffix_arrays as op6, toxicity as op7, warc as op9
from sievelog.llm.common import held_out, small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def _sql_words(text: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op1_sentencepiece")
def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document as digests."""
    rows = op1.with_ids(read(spark, sf_dir, "documents"), "piece_bpe_32k.model", keep_ids=False)
    return rows.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op5_exact_dedup", r"""
    SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    WINDOW same AS (PARTITION BY t)""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and survivor of every document whose text repeats but for white space."""
    return op5.dedup(read(spark, sf_dir, "documents"))


@query("op9_warc", """
    SELECT page_id, octet_length(encode(h)) AS payload_bytes,
           list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(
               list_transform(range(5), lambda k: CAST(substr(b, CAST(5 * i + k + 1 AS INT), 1) AS INT) << CAST(4 - k AS INT)))::INT, 1)), 'string_agg', '') AS payload_digest,
           CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> last THEN last END AS refers_to
    FROM (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS last, CAST(CAST(unhex(sha1(h)) AS BIT) AS VARCHAR) AS b
          FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))""")
def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives as a record and read back."""
    return op9.round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_language")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by the smallest compressed size; learns from the rows that aren't held out."""
    docs = read(spark, sf_dir, "documents")
    model = op2.learn(docs.filter(~held_out()))
    rows = op2.identify(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def joined_spans(spans, kept=None):
    """kind:start:end of an array of spans, comma-joined."""
    rows = spans if kept is None else F.filter(spans, kept)
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


#: The kinds of secrets, their patterns, the group whose length counts, and its least length.
_SECRETS = [
    ("assign", """(?i:(password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24), ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 36), ("github", "gh[opsur]_[A-Za-z0-9]+", 0, 40),
    ("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 15), ("google", "AIza[0-9A-Za-z_-]+", 0, 39),
]


def _sql_secrets(k: int) -> str:
    """Rows (doc_id, k, kind, a, b) of one kind: matches lie between the pieces that the pattern splits the text into."""
    kind, pattern, group, least = _SECRETS[k]
    return f"""SELECT doc_id, {k} AS k, '{kind}' AS kind, a, a + length(m[i]) AS b FROM (
        SELECT doc_id, m, g, i, list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a
        FROM (SELECT doc_id, m, g, parts, unnest(range(1, len(m) + 1)) AS i FROM (
            SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS g, string_split_regex(t, '{pattern}') AS parts FROM d)))
        WHERE length(g[i]) >= {least}"""


@query("op10_secrets", f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    s AS ({" UNION ALL ".join(_sql_secrets(k) for k in range(len(_SECRETS)))}),
    r AS (SELECT *, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT) AS span FROM s)
    SELECT d.doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
           sha256(coalesce(string_agg(span, ',' ORDER BY a, k) FILTER (WHERE k < 3), '')) AS base_sha256,
           coalesce(string_agg(span, ',' ORDER BY a, k), '') AS spans
    FROM d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id""")
def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with a digest of the base kinds."""
    rows = op10.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", count("assign"), count("access"), count("hex"),
                       F.sha2(joined_spans(F.col("secrets"), lambda s: s["is_base"]), 256).alias("base_sha256"),
                       joined_spans(F.col("secrets")).alias("spans"))


@query("op6_decontamination", f"""
    WITH d AS (SELECT doc_id, {_sql_words("text")} AS w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_sql_words("text")} AS w FROM benchmark),
    bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (
        SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
    dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (
        SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) ks WHERE len(w) >= k)),
    h AS (SELECT DISTINCT dw.doc_id, dw.i, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
    p AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM h) GROUP BY 1),
    t AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY 1)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(p.n, 0) > 0 AND 20 * coalesce(p.n, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark windows."""
    rows = op6.judge(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", F.col("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op7_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learns from the labelled rows that aren't held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = op7.learn(docs, read(spark, sf_dir, "labels").filter(~held_out()))
    return op7.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op3_html_text")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return op3.extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op8_jaccard_join", f"""
    WITH RECURSIVE d AS (SELECT doc_id, {_sql_words("text")} AS w FROM documents),
    g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS g FROM (
        SELECT doc_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
    c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT x, y, c = p.n AND c = q.n AS same FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 9 * c >= 4 * (p.n + q.n)),
    r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
    low AS (SELECT x, min(y) AS y FROM r GROUP BY 1),
    own AS (SELECT x, count(*) AS n, min(y) FILTER (WHERE same) AS y FROM l GROUP BY 1)
    SELECT d.doc_id, least(d.doc_id, coalesce(low.y, d.doc_id)) AS class_id, least(d.doc_id, coalesce(own.y, d.doc_id)) AS set_id,
           coalesce(own.n, 0) AS n_links, least(d.doc_id, coalesce(low.y, d.doc_id)) = d.doc_id AS kept
    FROM d LEFT JOIN low ON low.x = d.doc_id LEFT JOIN own ON own.x = d.doc_id""")
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document at a similarity of 0.8 of five-word shingles."""
    return op8.links(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op4_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, with a digest of the base kinds."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = op4.find(docs, op4.learn(docs))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *[count(k) for k in op4.BASE], F.sha2(joined_spans(F.col("base_spans")), 256).alias("base_sha256"),
                       joined_spans(F.col("all_spans")).alias("spans"))


@query("op11_repeated_passages", r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    g AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 19], ' ')) AS a, md5(array_to_string(w[i:i + 19], ' ')) AS g FROM (
        SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
    r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY a, g ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
    c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r),
    l AS (SELECT doc_id, list(i) AS cut FROM c GROUP BY 1)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(cut), 0) AS BIGINT) AS n_removed,
           sha256(coalesce(array_to_string(CASE WHEN cut IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(cut, i)) END, ' '), '')) AS kept_sha256
    FROM d LEFT JOIN l ON l.doc_id = d.doc_id""")
def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document when windows of 20 words stay only where they come first."""
    rows = op11.strip(read(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op12_alignment")
def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the ids of two tokenizers over all documents."""
    return op12.align(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op13_lexical_search", f"""
    WITH d AS (SELECT doc_id, {_sql_words("text")} AS w FROM documents),
    s AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
    b AS (SELECT item_id, unnest(list_distinct({_sql_words("text")})) AS t FROM benchmark),
    f AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
    g AS (SELECT t, count(*) AS df FROM f GROUP BY t),
    p AS (SELECT doc_id, f.t, CAST(floor(1000 * ln(CAST(2 * s.n + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT)
                 * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * f.n * s.n) // s.l)))) AS part
          FROM f JOIN g ON g.t = f.t, s WHERE f.t IN (SELECT t FROM b)),
    r AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM b JOIN p ON p.t = b.t GROUP BY item_id, doc_id)
    SELECT item_id, CAST(row_number() OVER best AS INT) AS rank, doc_id, score FROM r WHERE score > 0
    WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= 10""")
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return op13.search(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
