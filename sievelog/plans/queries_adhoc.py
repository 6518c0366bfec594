"""Ad-hoc document filters over orders with their lines as nested documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelog.functions import predicates as PD
from sievelog.plans.registry import query
from sievelog.sources.views import table


def documents(spark, d):
    """(o_orderkey, doc): one document an order. `code` is a number, a string of digits, a stored null, a boolean or not
    there; `tax` stands only in lines that have one; `modes` are flag and status of the lines in their order."""
    line = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct(
        "l_linenumber", F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag"), F.concat("l_returnflag", "l_linestatus").alias("mode"),
        F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("tax")))).alias("lines"))
    o = table(spark, d, "orders").join(line, "o_orderkey", "left")
    rest = F.to_json(F.struct(
        F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"),
        F.struct(F.col("o_orderpriority").alias("priority")).alias("plan"), "lines", F.transform("lines", lambda x: x["mode"]).alias("modes")))
    key = F.col("o_orderkey")
    code = (F.when(key % 5 == 0, key.cast("string")).when(key % 5 == 1, F.concat(F.lit('"'), key.cast("string"), F.lit('"')))
            .when(key % 5 == 2, "null").when(key % 5 == 3, "true"))
    text = F.when(code.isNull(), rest).otherwise(F.concat(F.lit('{"code":'), code, F.lit(","), F.substr(rest, F.lit(2))))
    # a row of a generator: filters on `doc` stay above it, so that a text is put together and parsed once and not per condition
    return o.select("o_orderkey", F.explode(F.array(F.try_parse_json(text))).alias("doc"))


def counted(spark, d, filters: dict[str, dict]):
    """Per named filter the number of documents that pass and the sum of their keys, in one pass."""
    rows = documents(spark, d).select("o_orderkey", F.explode(PD.passing(F.col("doc"), filters)).alias("test"))
    return rows.groupBy("test").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


def _line(test: str) -> str:
    return f"EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND {test})"


def _tests(tests: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS test, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE {t} HAVING count(*) > 0"
                              for n, t in tests.items())


_K = "o_orderkey % 5"
_MODE = "(l_returnflag || l_linestatus)"


@query("p19_comparison", _tests({
    "eq": "o_orderstatus = 'O'", "ne": "o_orderpriority <> '5-LOW'", "gt": _line("l_quantity > 49"), "range": "o_totalprice >= 1000 AND o_totalprice < 150000",
    "lte": _line("l_tax > 0 AND l_tax <= 0.01"), "in": f"({_K} = 0 AND o_orderkey IN (5, 10, 25)) OR ({_K} = 1 AND o_orderkey IN (11, 21))",
    "nin": "o_orderstatus NOT IN ('F', 'P')", "number only": f"{_K} = 0 AND o_orderkey > 100", "string only": f"{_K} = 1 AND CAST(o_orderkey AS VARCHAR) > '5'",
    "ne over lines": f"NOT {_line('l_returnflag = ' + repr('R'))}"}))
def comparison(spark, d):
    return counted(spark, d, {
        "eq": {"status": "O"}, "ne": {"plan.priority": {"$ne": "5-LOW"}}, "gt": {"lines.qty": {"$gt": 49}}, "range": {"price": {"$gte": 1000, "$lt": 150000.0}},
        "lte": {"lines.tax": {"$lte": 0.01}}, "in": {"code": {"$in": [5, 10, 25, "11", "21"]}}, "nin": {"status": {"$nin": ["F", "P"]}},
        "number only": {"code": {"$gt": 100}}, "string only": {"code": {"$gt": "5"}}, "ne over lines": {"lines.flag": {"$ne": "R"}}})


@query("p19_logical", _tests({
    "or": f"o_orderstatus = 'P' OR (o_totalprice <= 50000 AND {_line('l_returnflag = ' + repr('R'))})",
    "nor": f"NOT (o_orderpriority = '1-URGENT') AND {_K} <> 3", "not": f"NOT ({_K} = 0 AND o_orderkey < 1000)",
    "nested": f"(o_orderstatus = 'F' OR NOT (o_totalprice > 1000 OR {_K} = 4)) AND o_orderpriority <> '2-HIGH'"}))
def logical(spark, d):
    return counted(spark, d, {
        "or": {"$or": [{"status": "P"}, {"$and": [{"price": {"$lte": 50000}}, {"lines.flag": "R"}]}]},
        "nor": {"$nor": [{"plan.priority": "1-URGENT"}, {"code": {"$type": "bool"}}]}, "not": {"code": {"$not": {"$lt": 1000}}},
        "nested": {"$or": [{"status": "F"}, {"$nor": [{"price": {"$gt": 1000}}, {"code": {"$exists": False}}]}], "plan.priority": {"$ne": "2-HIGH"}}})


@query("p19_existence_type", _tests({
    "there": f"{_K} <> 4", "not there": f"{_K} = 4", "null or not there": f"{_K} IN (2, 4)", "not null": f"{_K} NOT IN (2, 4)", "type null": f"{_K} = 2",
    "type number": f"{_K} = 0", "type string": f"{_K} = 1", "type bool": f"{_K} = 3", "is true": f"{_K} = 3", "type object": "TRUE",
    "in with null": f"{_K} IN (2, 4) OR o_orderkey = 5", "type array": _line("TRUE"), "field of a line": _line("l_tax > 0"), "in no line": f"NOT {_line('l_tax > 0')}"}))
def existence_type(spark, d):
    return counted(spark, d, {
        "there": {"code": {"$exists": True}}, "not there": {"code": {"$exists": False}}, "null or not there": {"code": None}, "not null": {"code": {"$ne": None}},
        "type null": {"code": {"$type": "null"}}, "type number": {"code": {"$type": "number"}}, "type string": {"code": {"$type": "string"}},
        "type bool": {"code": {"$type": "bool"}}, "is true": {"code": True}, "type object": {"plan": {"$type": "object"}}, "in with null": {"code": {"$in": [None, 5]}},
        "type array": {"lines": {"$type": "array"}}, "field of a line": {"lines.tax": {"$exists": True}}, "in no line": {"lines.tax": {"$exists": False}}})


_SAME = _line("l_quantity > 45 AND l_returnflag = 'R' AND NOT (l_tax > 0 AND l_tax <= 0.04)")


@query("p19_arrays", _tests({
    "all": f"{_line(f"{_MODE} = 'AF'")} AND {_line(f"{_MODE} = 'RF'")}", "size": "(SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) = 4",
    "elemMatch": _SAME, "not elemMatch": f"NOT {_SAME}", "in different lines": f"{_line('l_quantity > 45')} AND {_line('l_returnflag = ' + repr('R'))}",
    "elemMatch of values": _line(f"{_MODE} >= 'M' AND {_MODE} < 'NZ'"),
    "by index": "(SELECT min_by(l_quantity, (l_linenumber, l_quantity)) FROM lineitem WHERE l_orderkey = o_orderkey) > 30"}))
def arrays(spark, d):
    same = {"qty": {"$gt": 45}, "flag": "R", "tax": {"$not": {"$lte": 0.04}}}
    return counted(spark, d, {
        "all": {"modes": {"$all": ["AF", "RF"]}}, "size": {"lines": {"$size": 4}}, "elemMatch": {"lines": {"$elemMatch": same}},
        "not elemMatch": {"lines": {"$not": {"$elemMatch": same}}}, "in different lines": {"lines.qty": {"$gt": 45}, "lines.flag": "R"},
        "elemMatch of values": {"modes": {"$elemMatch": {"$gte": "M", "$lt": "NZ"}}}, "by index": {"lines.0.qty": {"$gt": 30}}})


@query("p19_regex", _tests({
    "anchored": "regexp_matches(o_orderpriority, '^[12]')", "any case": "regexp_matches(o_orderpriority, 'urgent|low', 'i')", "in an array": _line(f"regexp_matches({_MODE}, '^R')"),
    "strings only": f"{_K} = 1 AND regexp_matches(CAST(o_orderkey AS VARCHAR), '6$')", "not": "NOT regexp_matches(o_orderpriority, '[a-z]')"}))
def regexes(spark, d):
    return counted(spark, d, {
        "anchored": {"plan.priority": {"$regex": "^[12]"}}, "any case": {"plan.priority": {"$regex": "urgent|low", "$options": "i"}}, "in an array": {"modes": {"$regex": "^R"}},
        "strings only": {"code": {"$regex": "6$"}}, "not": {"plan.priority": {"$not": {"$regex": "[a-z]"}}}})


@query("p18_find", f"""SELECT o_orderkey, o_orderpriority AS priority, CASE {_K} WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN CAST(o_orderkey AS VARCHAR)
 WHEN 2 THEN 'null' WHEN 3 THEN 'true' END AS code FROM orders
WHERE o_totalprice >= 1000 AND o_orderstatus IN ('O', 'F') AND {_line("l_quantity > 40 AND l_returnflag = 'N'")} ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 20""")
def find(spark, d):
    wanted = {"price": {"$gte": 1000}, "status": {"$in": ["O", "F"]}, "lines": {"$elemMatch": {"qty": {"$gt": 40}, "flag": "N"}}}
    price = F.try_variant_get("doc", "$.price", "double")
    rows = PD.find(documents(spark, d), "doc", wanted, [price.desc(), F.col("o_orderkey")], skip=20)
    priority, code = PD.project(F.col("doc"), ["plan.priority", "code"])
    return rows.select("o_orderkey", priority.alias("priority"), code.alias("code"))
