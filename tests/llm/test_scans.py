"""Operators that look at one text at a time, against plain versions and the tokenizer library."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sievelog.llm import automaton, html, language, personal, sentencepiece, suffix_arrays, toxicity
from tests.llm import brute

ODD = [None, "", " ", "\n", "é😀", "a" * 50_000, "same", "same"]


def frame(spark, texts, **more):
    """doc_id, text, and a column whose name clashes with an output."""
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in more.items()}).repartition(3)


def mixed(seed, tokens, count, longest=12):
    pick = random.Random(seed)
    return ["".join(pick.choice(tokens) for _ in range(pick.randint(0, longest))) for _ in range(count)]


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece as library
    path = sentencepiece.tokenizer_path("piece_bpe_32k.model")
    return library.SentencePieceProcessor(model_file=path), sentencepiece.table(path)


def test_pieces_equal_the_library(pieces):
    library, table = pieces
    tokens = [" ", "  ", "a", "th", "ing", "▁", "\n", "\t", "é", "中", "😀", "́", "1", "<s>", "<0x41>", " " * 17, "\x00", "²", ".", "한", "xxxxx"]
    for text in mixed(1, tokens, 3000, 25) + [t or "" for t in ODD]:
        ids = library.encode(text)
        assert table.encode(text) == ids
        assert table.both(text) == (",".join(map(str, ids)), library.decode(ids))


def test_decoding_any_ids(pieces):
    library, table = pieces
    pick = random.Random(2)
    for _ in range(3000):
        ids = [pick.randrange(32_000) if pick.random() < 0.6 else pick.randrange(259) for _ in range(8)]
        ids = [i for i in ids if i]
        assert table.decode(ids) == library.decode(ids)


def test_ids_of_a_table(spark, pieces):
    library, _ = pieces
    texts = ODD + ["The cat sat."]
    got = {r["doc_id"]: r for r in sentencepiece.with_ids(frame(spark, texts, n_tokens="x"), "piece_bpe_32k.model").collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "")
        assert got[i]["n_tokens"] == len(ids) and got[i]["decoded"] == library.decode(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert sentencepiece.with_ids(frame(spark, []), "piece_bpe_32k.model").count() == 0


def test_automaton_equals_regexes():
    tokens = ["password", "token", "Secret", "api_key", "API", "_", "passwd", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGH12345678",
              "0123456789abcdef", "deadbeef", "é", "x", "aaaaaa", "\n", "toktoken", "pass"]
    for text in mixed(3, tokens, 4000, 14) + ODD:
        base = [(a, k, b, automaton.RULES[k].kind) for a, k, b in automaton.find(text or "") if k < 3]
        assert base == brute.secrets(text)


def test_added_rules_and_rules_that_pause():
    text = "x -----BEGIN RSA PRIVATE KEY----- ghp_" + "g7" * 18 + " xoxb-1234567890"
    assert [automaton.RULES[k].kind for _, k, _ in automaton.find(text)] == ["private_key", "github", "slack"]
    with pytest.raises(ValueError):
        automaton.Scanner((automaton.Rule("pausing", "ab?(cd)?"),) + (automaton.Rule("p2", "a(bc)*"),))


def test_secrets_of_a_table(spark):
    texts = ODD + ["é token=abcdefg", "é token=abcdefg"]
    got = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["secrets"]] for r in automaton.scan(frame(spark, texts, secrets=1)).collect()}
    assert got == {i: [(a, b, k) for a, _, b, k in brute.secrets(t)] for i, t in enumerate(texts)}
    assert automaton.scan(frame(spark, [])).count() == 0


def test_personal_data_equals_regexes(spark):
    tokens = ["a@b.c", "_d@e.f", "x", "@", ".", "1.2.3.4", "256.1.1.1", "0001.2.3.255", ".5.6", "4111111111111111", "4111 1111 1111 1111",
              "-", "+1 (269) 555-3296", "+49 30 1234567", "é😀", " ", "5", "12", "+", "(", ")", "\n", "a.b-c", "9" * 25]
    texts = mixed(4, tokens, 500, 10) + ODD + ["1" * 50_000, "a@" * 500, "1." * 500]
    none = personal.Model((), (), (2.0, 2.0))
    got = personal.find(frame(spark, texts, base_spans=1), none).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["doc_id"]]
        if t != "1" * 50_000:  # the plain version is quadratic there
            assert [tuple(s) for s in r["base_spans"]] == brute.personal(t) == [tuple(s) for s in r["all_spans"]]
    assert personal.find(frame(spark, []), none).count() == 0


def test_trees_add_spans_and_keep_base_ones(spark):
    pick = random.Random(5)
    number = lambda: f"({pick.randint(200, 999)}) {pick.randint(200, 999)}-{pick.randint(1000, 9999)}"
    known = [f"call tel: +1 {number()} now" for _ in range(400)]
    noise = [f"lot {pick.randint(10 ** 7, 10 ** 9)}% done" for _ in range(400)]
    odd = [f"call tel: 1 {number()} now" for _ in range(5)]
    docs = frame(spark, known + noise + odd)
    rows = {r["doc_id"]: r for r in personal.find(docs, personal.learn(docs)).collect()}
    assert all(len(rows[i]["base_spans"]) == 1 for i in range(400))
    assert not any(rows[i]["all_spans"] for i in range(400, 800))
    assert all([s["kind"] for s in rows[i]["all_spans"]] == ["number_like"] for i in range(800, 805))
    none = personal.learn(frame(spark, []))
    assert none.trees == () and min(none.thresholds) > 1


def test_trees_learn_from_every_document(spark, monkeypatch):
    """About 4000 documents were chosen by a hash; the rest was not looked at."""
    seen, real = [], personal.candidates
    monkeypatch.setattr(personal, "candidates", lambda df: seen.append(df.count()) or real(df))
    personal.learn(spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("lot 12345678% done").alias("text")))
    assert seen == [9000]


def test_redaction_joins_overlapping_spans(spark):
    row = spark.sql("SELECT 'é a@b.c or 1' AS t, array(named_struct('start', 2L, 'end', 7L, 'kind', 'email'), named_struct('start', 4L, 'end', 8L, 'kind', 'x')) AS s")
    assert row.select(personal.redact(F.col("t"), F.col("s"))).first()[0] == "é [email]or 1"


def test_languages(spark):
    english = "the quick brown fox and the lazy dog went to the market with an old friend of theirs "
    german = "der schnelle braune fuchs und der faule hund gingen mit einem alten freund zum markt "
    pick = random.Random(6)
    shuffled = lambda t: " ".join(pick.choices(t.split(), k=60))
    train = spark.createDataFrame([(i, shuffled(t), lang) for i, (t, lang) in enumerate([(english, "en"), (german, "de")] * 40)] +
                                  [(900, "x", None), (901, None, "en")], "doc_id long, text string, lang string")
    model = language.learn(train)
    got = {r["doc_id"]: r for r in language.identify(frame(spark, [shuffled(english), shuffled(german), *ODD, "123 !"], score="x"), model).collect()}
    assert (got[0]["lang_pred"], got[1]["lang_pred"]) == ("en", "de") and not got[0]["rejected"] and got[0]["score"] > 0.9
    assert [got[i]["lang_pred"] for i in (2, 3, 4, 5, 10)] == ["und"] * 5 and got[3]["rejected"] and got[3]["score"] == 0
    assert {r["lang_pred"] for r in language.identify(frame(spark, ["some text"]), language.learn(train.limit(0))).collect()} == {"und"}


def test_pages():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>Home</a></li>
      </ul></nav><div class="cookie-notice">We use cookies on the site and it is for you.</div><article><h1>A &amp; B</h1><p><b>Some&nbsp;text of the<br>
      day<p>Short.</p><aside>More of the same</aside><p>Shop <a href=y>now and here, all of it</a></p><section class=comments><p>I am of the view that it is so</p></section>
      </article><footer>All of it is by us</footer><!-- c <p>no</p> --></body></html>"""
    assert html.main_text(page) == "A & B Some text of the day Short."
    for broken in ["", "<", "<p", "<a '" * 50_000, "<" * 50_000, "<div>" * 20_000 + "</ul>" * 20_000, "<!--" * 20_000, "<script>x"]:
        html.main_text(broken)
    long = "the cat is in the house and it was for that " * 8
    assert html.main_text(f"<div><p>{long}</p><p>Yes.</p><p>{long}</p></div><div><a href=a>link</a> <a href=b>link</a></div>").endswith("that")
    assert "Yes." in html.main_text(f"<p>{long}</p><p>Yes.</p><p>{long}</p>")


def test_pages_of_a_table(spark):
    rows = spark.createDataFrame([(1, "u", "<article><p>a</p></article>"), (2, None, None), (3, "v", "")], "page_id long, url string, html string").withColumn("TEXT", F.lit(1))
    assert {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(rows).collect()} == {1: ("a", 1), 2: ("", 0), 3: ("", 0)}


def test_interactions_are_learnt(spark):
    pick = random.Random(7)
    filler = [f"w{i}" for i in range(40)]
    docs, labels = [], []
    for i in range(1200):
        some = pick.sample(filler, 5)
        kind = i % 4
        some += [["insult"], ["group"], ["insult", "group"], []][kind]
        docs.append((i, " ".join(some)))
        labels.append((i, int(kind == 2)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(5000, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs.union(frame(spark, [None, ""]).withColumn("doc_id", F.col("doc_id") + 9000)), model).join(labels, "doc_id", "left").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got if r["doc_id"] < 1200) >= 1180
    assert all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in got if r["doc_id"] >= 9000)
    assert {r["score"] for r in toxicity.score(docs.limit(3), toxicity.learn(docs, labels.limit(0))).collect()} == {0.5}


def test_windows_equal_brute_force(spark):
    pick = random.Random(8)
    for size in (2, 3, 30):
        names = [pick.choice("abcé") + str(k) for k in range(size)]
        some = lambda n: " ".join(pick.choice(names) for _ in range(n))
        items = [(str(i), some(n)) for i, n in enumerate((0, 3, 5, 13, 14, 20, 40))]
        texts = [some(pick.randint(0, 30)) + " " + pick.choice(items)[1].upper() + ", " + some(4) for _ in range(60)] + ODD
        bench = spark.createDataFrame(items + [("n", None)], "item_id string, text string")
        for bound in (suffix_arrays.BLOCK_BYTES, 100):  # one block, several blocks
            suffix_arrays.BLOCK_BYTES, kept = bound, suffix_arrays.BLOCK_BYTES
            got = suffix_arrays.judge(frame(spark, texts, n_hit="x", Matches=0), bench).collect()
            suffix_arrays.BLOCK_BYTES = kept
            found = brute.windows(items)
            for r in got:
                n, hit, ids = brute.hits(texts[r["doc_id"]], found)
                assert (r["n_words"], r["n_hit"], list(r["items"])) == (n, hit, ids)
                assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
    assert suffix_arrays.judge(frame(spark, []), bench).count() == 0
    assert suffix_arrays.remove(frame(spark, ["a b"]), bench.limit(0)).columns == ["doc_id", "text"]


def test_longest_match_goes_beyond_a_window(spark):
    item = " ".join(f"w{i}" for i in range(40))
    bench = spark.createDataFrame([("7", item)], "item_id string, text string")
    row = suffix_arrays.matches(frame(spark, ["x " + item + " y"]), bench).first()
    assert [(m["start"], m["end"], m["longest"]) for m in row["matches"]] == [(1, 41, 40)]


def test_items_without_an_id_count_and_blocks_are_several(spark):
    item = [" ".join(f"{x}{i}" for i in range(20)) for x in "abc"]
    bench = spark.createDataFrame([("7", item[0]), (None, item[1]), (None, item[2])], "item_id string, text string")
    assert len(list(suffix_arrays.blocks(bench, size=50))) > 1
    texts = ["x " + item[0], item[1] + " y", item[2] + " " + item[0], "z"]
    for more in ({}, {"size": 50}):
        got = {r["doc_id"]: (r["n_hit"], list(r["items"]), r["contaminated"]) for r in suffix_arrays.judge(frame(spark, texts), bench, **more).collect()}
        assert got == {0: (20, ["7"], True), 1: (20, [], True), 2: (40, ["7"], True), 3: (0, [], False)}
        assert [r["doc_id"] for r in suffix_arrays.remove(frame(spark, texts), bench, **more).collect()] == [3]


def test_repetitive_items_and_texts(spark):
    texts = ["a " * 5000, "b " + "a b c " * 800, ("a " * 30 + "x ") * 40, "a " * 12, "a b c a b c a b c a b c a", "a b c"]
    bench = spark.createDataFrame([("i1", "a " * 400), ("i2", "a b c " * 200), ("i3", "a b c")], "item_id string, text string")
    got = {r["doc_id"]: (r["n_hit"], list(r["items"]), {m["item_id"]: m["longest"] for m in r["matches"]}) for r in suffix_arrays.judge(frame(spark, texts), bench).collect()}
    assert got[0] == (5000, ["i1"], {"i1": 400})
    assert got[1] == (2400, ["i2", "i3"], {"i2": 600, "i3": 3})
    assert got[2] == (1200, ["i1"], {"i1": 30})
    assert got[3] == (0, [], {})
    assert got[4] == (13, ["i2", "i3"], {"i2": 13, "i3": 3})
    assert got[5] == (3, ["i3"], {"i3": 3})


def test_words_of_one_hash_are_told_apart():
    class Colliding(suffix_arrays.Words):
        def __init__(self, texts):
            super().__init__(texts)
            self.hash = self.hash % 3 + 1  # many words share a hash

    real, suffix_arrays.Words = suffix_arrays.Words, Colliding
    try:
        items = [("p", "one two three"), ("q", "four five"), ("r", " ".join("abcdefghijklmnop"))]
        texts = ["x one two three y four five", "five four three two one", "z " + " ".join("abcdefghijklmnop"), "p o n m l k j i h g f e d c b a"]
        got = suffix_arrays.Block(items).hits([t.encode() for t in texts])
    finally:
        suffix_arrays.Words = real
    assert got == [(7, [(1, 4, 0, 3), (5, 7, 1, 2)]), (5, []), (17, [(1, 17, 2, 16)]), (16, [])]
