"""The driver's queries for the library's own operators, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import parse as P
from .functions import text as T
from .functions.order import with_rid
from .operators import cleaning, explore, joins, outliers, profile, quality
from .operators.recipe import Recipe
from .plans import dialect
from .sources import files, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, source: str, sql: str | None = None):
    """Registers f(table) under name."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(table(spark, sf_dir, source))
        if sql:
            ORACLE[name] = sql
        return f

    return add


def query2(name: str, first: str, second: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(table(spark, sf_dir, first), table(spark, sf_dir, second))
        if sql:
            ORACLE[name] = sql
        return f

    return add


def recipe(name: str, source: str, steps: dict, sql: str, order: str | list[str] | None = None, columns: list[str] | None = None):
    def run(df: DataFrame) -> DataFrame:
        return Recipe.from_dict(steps).apply(df.select(*columns) if columns else df, order)

    query(name, source, sql)(run)


# The SELECT dialect

SQL_GROUP = "SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS q, AVG(l_discount) AS d, MIN(l_shipdate) AS first_day, MAX(l_linenumber) AS last_line FROM dataset WHERE l_discount >= 0.05 AND l_returnflag <> 'N' GROUP BY l_returnflag LIMIT 200"
query("sql_filter_group", "lineitem", "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q, round(avg(l_discount), 9) AS d, min(l_shipdate) AS first_day, max(l_linenumber) AS last_line FROM lineitem WHERE l_discount >= 0.05 AND l_returnflag <> 'N' GROUP BY l_returnflag")(
    lambda df: dialect.run(SQL_GROUP, df, order=["l_orderkey", "l_linenumber"]).withColumn("d", F.round("d", 9))
)
query("sql_agg_global", "orders", "SELECT count(*) AS n, count(o_custkey) AS c, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_orderpriority) AS lo, max(o_orderpriority) AS hi FROM orders WHERE o_orderstatus = 'F'")(
    lambda df: dialect.run("SELECT COUNT(*) AS n, COUNT(o_custkey) AS c, SUM(o_totalprice) AS total, AVG(o_totalprice) AS mean, MIN(o_orderpriority) AS lo, MAX(o_orderpriority) AS hi FROM dataset WHERE o_orderstatus = 'F'", df, order="o_orderkey").withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})
)
query("sql_limit_offset", "orders", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_orderpriority IS NOT NULL ORDER BY o_orderkey LIMIT 20 OFFSET 30")(
    lambda df: dialect.run("SELECT o_orderkey, o_orderstatus, o_totalprice FROM dataset WHERE o_totalprice > 1000 AND o_orderpriority IS NOT NULL LIMIT 20 OFFSET 30", df, order="o_orderkey")
)
query2("sql_join_group", "orders", "customer", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY c_mktsegment")(
    lambda o, c: dialect.run("SELECT c_mktsegment, COUNT(*) AS n, SUM(o_totalprice) AS total FROM dataset JOIN compared ON dataset.o_custkey = compared.c_custkey WHERE o_orderstatus = 'O' GROUP BY c_mktsegment LIMIT 200", o, c, order="o_orderkey").withColumn("total", F.round("total", 2))
)

# Recipes

recipe("recipe_rename_cast", "orders", {"renames": [{"from": "o_orderkey", "to": "o_custkey"}, {"from": "o_custkey", "to": "o_orderkey"}], "casts": [{"column": "o_totalprice", "target": "string"}, {"column": "o_orderkey", "target": "decimal"}], "keepColumns": ["o_orderkey", "o_custkey", "o_orderstatus"]}, "SELECT o_custkey AS o_orderkey, CAST(o_orderkey AS DOUBLE) AS o_custkey, o_orderstatus FROM orders")
recipe("recipe_filters_eq", "orders", {"filters": [{"column": "o_orderstatus", "op": "eq", "value": "F"}]}, "SELECT * FROM orders WHERE o_orderstatus = 'F'")
recipe("recipe_filters_neq", "orders", {"filters": [{"column": "o_orderpriority", "op": "neq", "value": "1-URGENT"}, {"column": "o_orderstatus", "op": "neq", "value": "O"}]}, "SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderstatus <> 'O'")
recipe("recipe_filters_range", "lineitem", {"filters": [{"column": "l_quantity", "op": "gte", "value": "10"}, {"column": "l_quantity", "op": "lt", "value": 25}, {"column": "l_discount", "op": "gt", "value": 0.03}]}, "SELECT * FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 25 AND l_discount > 0.03")
recipe("recipe_filters_contains", "part", {"filters": [{"column": "p_type", "op": "contains", "value": "eco"}, {"column": "p_name", "op": "not_contains", "value": "RED"}]}, "SELECT * FROM part WHERE contains(lower(p_type), 'eco') AND NOT contains(lower(p_name), 'red')")
recipe("recipe_filters_temporal", "orders", {"filters": [{"column": "o_orderdate", "op": "gte", "value": "1995-03-01"}, {"column": "o_orderdate", "op": "lt", "value": "1996-01-01T12:00:00"}]}, "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1996-01-01 12:00:00'")
query2("recipe_filters_null", "documents", "labels", "SELECT d.doc_id, lang FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality IS NULL")(
    lambda d, la: Recipe.from_dict({"filters": [{"column": "quality", "op": "is_null"}], "keepColumns": ["doc_id", "lang"]}).apply(joins.key_join(d, la, [("doc_id", "doc_id")], "left"), "doc_id")
)


def calculated(op: str, left: dict, right: dict | None = None, name: str = "result") -> dict:
    return {"calculatedColumn": {"name": name, "op": op, "left": left, "right": right}}


LINE = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
for _op, _sign in (("add", "+"), ("subtract", "-"), ("multiply", "*"), ("divide", "/")):
    recipe(f"recipe_calc_{_op}", "lineitem", calculated(_op, {"column": "l_extendedprice"}, {"column": "l_quantity"}), f"SELECT {', '.join(LINE)}, l_extendedprice {_sign} l_quantity AS result FROM lineitem", columns=LINE)
recipe("recipe_calc_concat", "part", calculated("concat", {"column": "p_brand"}, {"literal": "/x"}), "SELECT *, p_brand || '/x' AS result FROM part")
for _op in ("year", "month", "day"):
    recipe(f"recipe_calc_{_op}", "orders", calculated(_op, {"column": "o_orderdate"}), f"SELECT *, CAST({_op}(o_orderdate) AS INTEGER) AS result FROM orders")
recipe("recipe_split", "part", {"splitColumn": {"column": "p_name", "delimiter": "r", "targets": ["a", "b"], "dropSource": True}, "keepColumns": ["p_partkey", "p_name"]}, "SELECT p_partkey, split_part(p_name, 'r', 1) AS a, CASE WHEN contains(p_name, 'r') THEN substr(p_name, instr(p_name, 'r') + 1) END AS b FROM part")
recipe("recipe_merge_whole", "part", {"mergeColumns": {"columns": ["p_brand", "p_type"], "target": "both", "separator": " - "}, "keepColumns": ["p_partkey", "p_brand", "p_type"]}, "SELECT p_partkey, p_brand, p_type, p_brand || ' - ' || p_type AS both FROM part")
query("recipe_merge", "part", "WITH g AS (SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS p_brand, CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS p_type FROM part) SELECT *, CASE WHEN coalesce(p_brand, p_type) IS NOT NULL THEN concat_ws(' - ', p_brand, p_type) END AS both FROM g")(
    lambda p: Recipe.from_dict({"mergeColumns": {"columns": ["p_brand", "p_type"], "target": "both", "separator": " - "}}).apply(p.select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("p_brand"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")).alias("p_type")))
)
recipe("recipe_find_replace_literal", "documents", {"findReplace": [{"column": "text", "find": "the", "replace": "[$1]"}], "keepColumns": ["doc_id", "text"]}, "SELECT doc_id, replace(text, 'the', '[$1]') AS text FROM documents")
recipe("recipe_find_replace_regex", "customer", {"findReplace": [{"column": "c_name", "find": r"([A-Za-z]+)#0*(\d+)", "replace": "${2}_${1}$$", "regex": True}], "keepColumns": ["c_custkey", "c_name"]}, r"SELECT c_custkey, regexp_replace(c_name, '([A-Za-z]+)#0*([0-9]+)', '\2_\1$', 'g') AS c_name FROM customer")


def extraction(kind: str, delimiter: str | None = None) -> dict:
    return {"textExtractions": [{"column": "c_name", "target": "found", "kind": kind, "delimiter": delimiter}], "keepColumns": ["c_custkey", "c_name"]}


recipe("recipe_extract_first", "documents", {"textExtractions": [{"column": "text", "target": "found", "kind": "first"}], "keepColumns": ["doc_id", "text"]}, r"SELECT doc_id, text, nullif(regexp_extract(text, '[^\s\x{0B}\x{85}\p{Z}]+'), '') AS found FROM documents")
recipe("recipe_extract_last", "documents", {"textExtractions": [{"column": "text", "target": "found", "kind": "last"}], "keepColumns": ["doc_id", "text"]}, r"SELECT doc_id, text, nullif(regexp_extract(text, '([^\s\x{0B}\x{85}\p{Z}]+)[\s\x{0B}\x{85}\p{Z}]*$', 1), '') AS found FROM documents")
recipe("recipe_extract_digits", "customer", extraction("digits"), "SELECT c_custkey, c_name, nullif(regexp_extract(c_name, '[0-9]+'), '') AS found FROM customer")
recipe("recipe_extract_letters", "customer", extraction("letters"), r"SELECT c_custkey, c_name, nullif(regexp_extract(c_name, '\p{L}+'), '') AS found FROM customer")
recipe("recipe_extract_before", "customer", extraction("before", "#"), "SELECT c_custkey, c_name, CASE WHEN contains(c_name, '#') THEN split_part(c_name, '#', 1) END AS found FROM customer")
recipe("recipe_extract_after", "customer", extraction("after", "#"), "SELECT c_custkey, c_name, CASE WHEN contains(c_name, '#') THEN substr(c_name, instr(c_name, '#') + 1) END AS found FROM customer")
_SAID = lambda c: c.select("c_custkey", F.concat(F.lit("  "), F.when(F.col("c_custkey") % 2 == 0, "+").otherwise("("), "c_name", F.lit(") ")).alias("said"))
_SAID_SQL = "WITH g AS (SELECT c_custkey, '  ' || CASE WHEN c_custkey % 2 = 0 THEN '+' ELSE '(' END || c_name || ') ' AS said FROM customer) "
query("recipe_contact_email", "customer", _SAID_SQL + "SELECT c_custkey, lower(trim(said)) AS said FROM g")(lambda c: Recipe.from_dict({"contactNormalizations": [{"column": "said", "kind": "email"}]}).apply(_SAID(c)))
query("recipe_contact_phone", "customer", _SAID_SQL + "SELECT c_custkey, CASE WHEN starts_with(trim(said), '+') THEN '+' ELSE '' END || regexp_replace(said, '[^0-9]', '', 'g') AS said FROM g")(lambda c: Recipe.from_dict({"contactNormalizations": [{"column": "said", "kind": "phone"}]}).apply(_SAID(c)))
recipe("recipe_contact_address", "documents", {"contactNormalizations": [{"column": "text", "kind": "address"}]}, r"SELECT doc_id, regexp_replace(regexp_replace(text, '[\s\x{0B}\x{85}\p{Z}]+', ' ', 'g'), '^ | $', '', 'g') AS text FROM documents", columns=["doc_id", "text"])
recipe("recipe_date_parse", "orders", {"casts": [{"column": "o_totalprice", "target": "string"}], "dateParses": [{"column": "o_orderdate", "order": "iso8601", "target": "date", "policy": "nullify"}], "keepColumns": ["o_orderkey", "o_orderdate"]}, "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
query("recipe_cast_nullify", "events", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(user_id AS BIGINT) END AS u FROM events")(
    lambda e: Recipe.from_dict({"casts": [{"column": "u", "target": "integer", "policy": "nullify"}]}).apply(e.select("event_id", F.when(F.col("event_id") % 4 == 0, F.concat(F.col("user_id").cast("string"), F.lit(".5"))).otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"))).alias("u")))
)
recipe("recipe_group_summary", "lineitem", {"groupSummary": {"keys": ["l_returnflag", "l_linestatus"], "aggregations": [{"column": "l_quantity", "function": "sum"}, {"column": "l_quantity", "function": "mean"}, {"column": "l_shipdate", "function": "min"}, {"column": "l_shipdate", "function": "max"}, {"column": "l_orderkey", "function": "count"}, {"column": "l_suppkey", "function": "count_unique"}]}}, "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity_sum, avg(l_quantity) AS l_quantity_mean, min(l_shipdate) AS l_shipdate_min, max(l_shipdate) AS l_shipdate_max, count(*) AS l_orderkey_count, count(DISTINCT l_suppkey) AS l_suppkey_count_unique FROM lineitem GROUP BY ALL")
#: A column with values far out on both sides: every 50th is multiplied, every 70th turned negative.
_FAR = lambda d: d.select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 50 == 0, F.col("l_extendedprice") * 40).when(F.col("l_orderkey") % 70 == 1, -3 * F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("price"))
_FAR_SQL = "WITH g AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 50 = 0 THEN l_extendedprice * 40 WHEN l_orderkey % 70 = 1 THEN -3 * l_extendedprice ELSE l_extendedprice END AS price FROM lineitem), q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b, quantile_cont(price, 0.5) AS m FROM g), f AS (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi, m FROM q) "
_TREATED = {"cap": ("least(greatest(price, lo), hi)", ""), "drop": ("price", " WHERE price BETWEEN lo AND hi"), "impute": ("CASE WHEN price BETWEEN lo AND hi THEN price ELSE m END", "")}
for _how, (_cell, _where) in _TREATED.items():
    _sql = _FAR_SQL + f"SELECT l_orderkey, l_linenumber, round({_cell}, 6) AS price FROM g, f{_where}"
    query(f"recipe_outlier_{_how}", "lineitem", _sql)(lambda d, how=_how: Recipe.from_dict({"outlierTreatments": [{"column": "price", "action": how}]}).apply(_FAR(d)).withColumn("price", F.round("price", 6)))
    query(f"outlier_{_how}_all", "lineitem", _sql)(lambda d, how=_how: outliers.treat_all(_FAR(d), how, ["price"]).withColumn("price", F.round("price", 6)))
_FAR_INT = lambda p: p.select("p_partkey", F.when(F.col("p_partkey") % 50 == 0, F.col("p_size") + 500).when(F.col("p_partkey") % 70 == 1, F.col("p_size") - 400).otherwise(F.col("p_size")).alias("size"))
_FAR_INT_SQL = "WITH g AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN p_size + 500 WHEN p_partkey % 70 = 1 THEN p_size - 400 ELSE p_size END AS size FROM part), q AS (SELECT quantile_cont(size, 0.25) AS a, quantile_cont(size, 0.75) AS b FROM g), f AS (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM q) "

# Joins and comparison

query2("join_inner", "orders", "customer", "SELECT o.*, c_name, c_nationkey, c_acctbal, c_mktsegment FROM orders o JOIN customer ON o_custkey = c_custkey")(lambda o, c: joins.key_join(o, c, [("o_custkey", "c_custkey")]))
query2("join_left", "customer", "nation", "SELECT c.*, n_name, n_regionkey FROM customer c LEFT JOIN nation ON c_nationkey = n_nationkey")(lambda c, n: joins.key_join(c, n, [("c_nationkey", "n_nationkey")], "left"))
query2("join_full", "documents", "labels", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, lang, source, quality, toxic FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")(
    lambda d, la: joins.key_join(d.select("doc_id", "lang", "source"), la, [("doc_id", "doc_id")], "full")
)


def halves(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two overlapping versions of orders, each with some keys twice, the second with other prices in places."""
    a = orders.filter(F.col("o_orderkey") % 10 < 7)
    b = orders.filter(F.col("o_orderkey") % 10 > 2).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return a.unionAll(a.filter(F.col("o_orderkey") % 89 == 0)), b.unionAll(b.filter(F.col("o_orderkey") % 97 == 0))


_HALVES = "WITH a0 AS (SELECT * FROM orders WHERE o_orderkey % 10 < 7), a AS (SELECT * FROM a0 UNION ALL SELECT * FROM a0 WHERE o_orderkey % 89 = 0), b0 AS (SELECT * REPLACE (CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice) FROM orders WHERE o_orderkey % 10 > 2), b AS (SELECT * FROM b0 UNION ALL SELECT * FROM b0 WHERE o_orderkey % 97 = 0) "
query("compare_rows", "orders", _HALVES + ", i AS (SELECT * FROM a INTERSECT ALL SELECT * FROM b), x AS (SELECT * FROM a EXCEPT ALL SELECT * FROM b), y AS (SELECT * FROM b EXCEPT ALL SELECT * FROM a) SELECT (SELECT count(*) FROM i) AS common, (SELECT count(*) FROM x) AS current_only, (SELECT count(*) FROM y) AS compared_only")(lambda o: joins.compare_rows(*halves(o)))
_KEYED = _HALVES + ", ka AS (SELECT o_orderkey, count(*) AS na, any_value(o_totalprice) AS pa FROM a GROUP BY 1), kb AS (SELECT o_orderkey, count(*) AS nb, any_value(o_totalprice) AS pb FROM b GROUP BY 1), k AS (SELECT coalesce(na, 0) AS na, coalesce(nb, 0) AS nb, pa, pb, coalesce(ka.o_orderkey, kb.o_orderkey) AS o_orderkey FROM ka FULL JOIN kb ON ka.o_orderkey = kb.o_orderkey) "
query("compare_keys", "orders", _KEYED + "SELECT count(*) FILTER (na > 0 AND nb > 0) AS matched, count(*) FILTER (na = 1 AND nb = 1 AND pa <> pb) AS conflicting, count(*) FILTER (na > 0 AND nb = 0) AS current_only, count(*) FILTER (nb > 0 AND na = 0) AS compared_only, count(*) FILTER (na > 1 OR nb > 1) AS duplicate_keys, CAST(coalesce(sum(na + nb) FILTER (na > 1 OR nb > 1), 0) AS BIGINT) AS duplicate_rows FROM k")(lambda o: joins.compare_keys(*halves(o), ["o_orderkey"]))
query("conflicts", "orders", _KEYED + "SELECT o_orderkey, 'o_totalprice' AS column_name, round(pa, 2) AS current_value, round(pb, 2) AS compared_value FROM k WHERE na = 1 AND nb = 1 AND pa <> pb")(
    lambda o: joins.conflicts(*halves(o), ["o_orderkey"]).withColumns({c: F.round(F.col(c).cast("double"), 2) for c in ("current_value", "compared_value")})
)
_decided = lambda: F.when(F.col("o_orderkey") % 3 == 0, "exclude").when(F.col("o_orderkey") % 2 == 0, "compared").otherwise("current")
query("resolve_conflicts", "orders", _KEYED + ", r AS (SELECT o_orderkey, pb FROM k WHERE na = 1 AND nb = 1 AND pa <> pb) SELECT a.* REPLACE (CASE WHEN r.pb IS NOT NULL AND a.o_orderkey % 2 = 0 THEN r.pb ELSE a.o_totalprice END AS o_totalprice) FROM a LEFT JOIN r ON a.o_orderkey = r.o_orderkey WHERE r.o_orderkey IS NULL OR a.o_orderkey % 3 <> 0")(
    lambda o: joins.resolve_conflicts(*halves(o), ["o_orderkey"], joins.conflicts(*halves(o), ["o_orderkey"]).select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("column_name")).alias("column_name"), _decided().alias("choice")))
)
query("conflict_page", "orders", _KEYED + "SELECT o_orderkey, 'o_totalprice' AS column_name, round(pa, 2) AS current_value, round(pb, 2) AS compared_value FROM k WHERE na = 1 AND nb = 1 AND pa <> pb ORDER BY k.o_orderkey LIMIT 40 OFFSET 25")(
    lambda o: joins.conflict_page(*halves(o), ["o_orderkey"], 25, 40).withColumns({c: F.round(F.col(c).cast("double"), 2) for c in ("current_value", "compared_value")})
)
query("consolidate", "orders", "SELECT * FROM orders WHERE o_orderkey % 10 < 7 UNION ALL SELECT * FROM orders WHERE o_orderkey % 10 >= 7")(lambda o: joins.consolidate(o.filter(F.col("o_orderkey") % 10 < 7), o.filter(F.col("o_orderkey") % 10 > 2), ["o_orderkey"]))
query2("join_bound", "orders", "customer", "SELECT CAST(sum(a.n * b.n) AS BIGINT) AS n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a JOIN (SELECT c_custkey AS k, count(*) AS n FROM customer GROUP BY 1) b USING (k)")(lambda o, c: o.sparkSession.range(1).select(F.lit(joins.join_bound(o, c, [("o_custkey", "c_custkey")])).cast("long").alias("n")))

# Cleaning

query("dedup_exact", "documents", "SELECT text, lang, min(doc_id) AS first_id FROM documents GROUP BY text, lang")(lambda d: cleaning.remove_duplicates(with_rid(d, "doc_id").select("text", "lang", "_rid")).withColumnRenamed("_rid", "first_id"))
_NORMAL = r"lower(regexp_replace(regexp_replace({c}, '[\s\x{{0B}}\x{{85}}\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g'))"
_LOOSE = lambda d: d.select(F.when(F.col("doc_id") % 3 == 0, F.translate("text", "abcdefgh", "ABCDEFGH")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("  "), "text")).otherwise(F.col("text")).alias("text"), "lang", F.col("doc_id").alias("_rid"))
_LOOSE_SQL = "WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN translate(text, 'abcdefgh', 'ABCDEFGH') WHEN 1 THEN '  ' || text ELSE text END AS text, lang FROM documents), k AS (SELECT doc_id, text, strip_accents(" + _NORMAL.format(c="text") + ") AS k, lang FROM d) "
query("dedup_near", "documents", _LOOSE_SQL + ", f AS (SELECT *, first_value(text) OVER (PARTITION BY k, lang ORDER BY doc_id) AS t FROM k) SELECT doc_id, text, lang FROM f WHERE text = t")(
    lambda d: cleaning.remove_near_duplicates(_LOOSE(d)).withColumnRenamed("_rid", "doc_id")
)
query("drop_empty_rows", "documents", r"SELECT doc_id, t FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE lang END AS t FROM documents) WHERE trim(t) <> ''")(
    lambda d: cleaning.remove_empty_rows(d.select(F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("lang")).alias("t"), F.col("doc_id").alias("_rid"))).withColumnRenamed("_rid", "doc_id")
)
query("trim_text", "documents", r"SELECT doc_id, regexp_replace(text, '^[\s\x{0B}\x{85}\p{Z}]+|[\s\x{0B}\x{85}\p{Z}]+$', '', 'g') AS text FROM documents")(lambda d: cleaning.trim_text_values(d.select("doc_id", "text")))
query("normalize_text", "documents", "SELECT doc_id, strip_accents(" + _NORMAL.format(c="text") + ") AS text FROM documents")(lambda d: cleaning.normalize_text_values(d.select("doc_id", "text"), True))
_GAPPY = lambda e: e.select("event_id", F.when(F.col("event_id") % 5 == 0, " N/A ").when(F.col("event_id") % 7 == 0, "Null").otherwise(F.col("event_type")).alias("kind"), F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("user"), F.when(F.col("event_id") % 2 == 0, "Sí").otherwise("NO").alias("flag"))
_GAPS = "WITH g AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN ' N/A ' WHEN event_id % 7 = 0 THEN 'Null' ELSE event_type END AS kind, CASE WHEN event_id % 4 <> 0 THEN value END AS value, CASE WHEN event_id % 3 <> 0 THEN user_id END AS \"user\", CASE WHEN event_id % 2 = 0 THEN 'Sí' ELSE 'NO' END AS flag FROM events) "
query("sentinels_to_null", "events", _GAPS + "SELECT event_id, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN kind END AS kind, value, \"user\", flag FROM g")(lambda e: cleaning.normalize_sentinels(_GAPPY(e)))
query("booleans", "events", _GAPS + "SELECT event_id, kind, CASE flag WHEN 'Sí' THEN 'true' ELSE 'false' END AS flag FROM g")(lambda e: cleaning.normalize_booleans(_GAPPY(e).select("event_id", "kind", "flag")))
query("impute_numeric", "events", _GAPS + "SELECT event_id, coalesce(value, (SELECT quantile_disc(value, 0.5) FROM g)) AS value, coalesce(\"user\", (SELECT quantile_disc(\"user\", 0.5) FROM g)) AS \"user\" FROM g")(
    lambda e: outliers.impute_missing(with_rid(_GAPPY(e).select("event_id", "value", "user"), "event_id"), ["value", "user"]).drop("_rid")
)
query("impute_text", "events", "WITH g AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN event_type END AS kind FROM events), m AS (SELECT kind FROM g WHERE kind IS NOT NULL GROUP BY kind HAVING count(*) >= 2 ORDER BY count(*) DESC, min(event_id) LIMIT 1) SELECT event_id, coalesce(kind, (SELECT kind FROM m)) AS kind FROM g")(
    lambda e: outliers.impute_missing(with_rid(e.select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("kind")), "event_id"), ["kind"]).drop("_rid")
)
query("impute_categorical", "events", "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN event_type ELSE 'Desconocido' END AS kind FROM events")(lambda e: outliers.impute_categories(e.select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("kind"))))
query("nullify_invalid", "events", "SELECT event_id, CASE WHEN event_id % 20 <> 0 THEN CAST(user_id AS VARCHAR) END AS u FROM events")(lambda e: cleaning.nullify_invalid(e.select("event_id", F.when(F.col("event_id") % 20 == 0, "x1").otherwise(F.col("user_id").cast("string")).alias("u"))))
query("cast_numbers", "events", "SELECT event_id, user_id AS u, CASE WHEN event_id % 20 <> 0 THEN value END AS v FROM events")(lambda e: cleaning.cast_numbers(e.select("event_id", F.col("user_id").cast("string").alias("u"), F.when(F.col("event_id") % 20 == 0, "n.d.").otherwise(F.col("value").cast("decimal(30,12)").cast("string")).alias("v"))).withColumn("v", F.col("v").cast("double")))
query("cast_dates", "orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS d FROM orders")(lambda o: cleaning.cast_dates(with_rid(o.select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("d")), "o_orderkey")).drop("_rid"))
query("fix_encoding", "customer", "SELECT c_custkey, c_name || ' Ñandú – café' AS t FROM customer")(lambda c: cleaning.fix_encoding(c.select("c_custkey", F.concat("c_name", F.lit(" Ã‘andÃº â€“ cafÃ©")).alias("t"))))
query("remove_columns", "orders", "SELECT o_orderkey, o_totalprice FROM orders")(lambda o: cleaning.remove_high_null_columns(cleaning.remove_constant_columns(cleaning.remove_empty_columns(o.select("o_orderkey", "o_totalprice", F.lit("x").alias("same"), F.lit(None).cast("string").alias("none"), F.when(F.col("o_orderkey") % 10 == 0, 1).alias("few"))))))
query("normalize_names", "region", "SELECT r_regionkey AS region_numero, r_name AS region_numero_2 FROM region")(lambda r: cleaning.normalize_column_names(r.toDF("Región-Número", "región número")))
query("audit_trail", "customer", "SELECT c_custkey, c_name, upper(c_mktsegment) AS seg, nullif(concat_ws('; ', CASE WHEN c_custkey % 3 = 0 THEN 'trim: c_name' END, CASE WHEN c_custkey % 5 = 0 THEN 'sentinels: seg' END), '') AS _cambios FROM (SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer)")(
    lambda c: cleaning.normalize_sentinels(cleaning.trim_text_values(cleaning.enable_audit(c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit(" "))).otherwise(F.col("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 5 == 0, "N/A").otherwise(F.upper("c_mktsegment")).alias("seg")))))
)
query("outlier_cap_int", "part", _FAR_INT_SQL + "SELECT p_partkey, CAST(CASE WHEN size < lo THEN ceil(lo) WHEN size > hi THEN floor(hi) ELSE size END AS INTEGER) AS size FROM g, f")(lambda p: outliers.treat_all(_FAR_INT(p), "cap", ["size"]).withColumn("size", F.col("size").cast("int")))
query("outlier_impute_int", "part", _FAR_INT_SQL + "SELECT p_partkey, CAST(CASE WHEN size < lo OR size > hi THEN (SELECT quantile_disc(size, 0.5) FROM g) ELSE size END AS INTEGER) AS size FROM g, f")(lambda p: outliers.treat_all(_FAR_INT(p), "impute", ["size"]).withColumn("size", F.col("size").cast("int")))
query("privacy_mask", "customer", "SELECT c_custkey, '[REDACTED]' AS customer_email FROM customer")(lambda c: cleaning.mask_personal_values(c.select("c_custkey", F.col("c_name").alias("customer_email"))))
query("privacy_hash", "customer", "SELECT c_custkey, sha256('salt' || c_name) AS email FROM customer")(lambda c: sinks.with_privacy(c.select("c_custkey", F.col("c_name").alias("email")), "hash", ["email"], b"salt"))
query("formula_safe", "customer", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '''=' || c_name ELSE '-1,5' END AS t FROM customer")(lambda c: sinks.formula_safe(c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("="), "c_name")).otherwise("-1,5").alias("t"))))

# Profiles

query("profile_dataset", "documents", _LOOSE_SQL + ", r AS (SELECT text, k, lang, count(*) AS n FROM k GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n) - count(*) AS BIGINT) AS duplicates, count(*) - count(DISTINCT (k, lang)) AS near_duplicates FROM r")(lambda d: profile.dataset_summary(_LOOSE(d).drop("_rid")))
_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]
query("profile_numeric", "lineitem", " UNION ALL ".join(f"(WITH q AS (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.5) AS m, quantile_cont({c}, 0.75) AS b FROM lineitem) SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 6) AS std, round(any_value(a), 6) AS q1, round(any_value(m), 6) AS median, round(any_value(b), 6) AS q3, count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outlier_count FROM lineitem, q)" for c in _NUMBERS))(
    lambda d: profile.column_profile(d, _NUMBERS).select("column_name", "row_count", "null_count", "unique_count", F.round("mean", 4).alias("mean"), *[F.round(c, 6).alias(c) for c in ("std", "q1", "median", "q3")], "outlier_count")
)
query("profile_text", "documents", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS row_count, count(DISTINCT {c}) AS unique_count, min(length({c})) AS min_length, max(length({c})) AS max_length, round(avg(length({c})), 6) AS avg_length, min({c}) AS min_text FROM documents" for c in ("text", "lang", "source")))(
    lambda d: profile.column_profile(d, ["text", "lang", "source"]).select("column_name", "row_count", "unique_count", F.col("min_length").cast("long").alias("min_length"), F.col("max_length").cast("long").alias("max_length"), F.round("avg_length", 6).alias("avg_length"), "min_text")
)
query2("profile_nulls", "documents", "labels", "SELECT c AS column_name, n AS null_count FROM (SELECT count(*) - count(quality) AS q, count(*) - count(lang) AS l FROM documents LEFT JOIN labels USING (doc_id)) t, LATERAL (SELECT unnest(['quality', 'lang']) AS c, unnest([q, l]) AS n)")(
    lambda d, la: profile.column_profile(d.join(la, "doc_id", "left"), ["quality", "lang"]).select("column_name", "null_count")
)
query("profile_histogram", "lineitem", "WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), c AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 12)), 11) AS INTEGER) AS bin, count(*) AS n FROM lineitem, r GROUP BY 1) SELECT CAST(g AS INTEGER) AS bin, round(lo + (hi - lo) / 12 * g, 4) AS lower, round(CASE WHEN g = 11 THEN hi ELSE lo + (hi - lo) / 12 * (g + 1) END, 4) AS upper, coalesce(n, 0) AS n FROM r, generate_series(0, 11) s(g) LEFT JOIN c ON c.bin = g")(
    lambda d: profile.histogram(d, "l_extendedprice").withColumns({"lower": F.round("lower", 4), "upper": F.round("upper", 4)})
)
query("profile_corr", "lineitem", "SELECT 'l_quantity' AS left_column, 'l_extendedprice' AS right_column, count(*) AS pairs, round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', count(*), round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', count(*), round(corr(l_extendedprice, l_discount), 6) FROM lineitem")(
    lambda d: profile.correlations(d, _NUMBERS).withColumn("correlation", F.round("correlation", 6))
)
query("profile_categorical", "part", "WITH c AS (SELECT p_type AS label, count(*) AS n FROM part GROUP BY 1), t AS (SELECT * FROM c WHERE n >= 3 ORDER BY n DESC, label LIMIT 8), a AS (SELECT count(*) AS total FROM part) SELECT label, n, round(n / total * 100, 6) AS percentage, false AS is_other FROM t, a UNION ALL SELECT 'Resto', CAST(total - coalesce((SELECT sum(n) FROM t), 0) AS BIGINT), round((total - coalesce((SELECT sum(n) FROM t), 0)) / total * 100, 6), true FROM a WHERE total > coalesce((SELECT sum(n) FROM t), 0)")(
    lambda d: profile.category_groups(d, "p_type").withColumn("percentage", F.round("percentage", 6))
)
_PERIODS = "SELECT strftime(o_orderdate, '{f}') AS period, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM {t} GROUP BY 1"
_YEARS = _PERIODS.format(f="%Y", t="orders")
#: The same orders within 30 months and within 70 days, so that the finer granularities are tried on all rows too.
_near = lambda o, days: o.withColumn("o_orderdate", F.expr(f"date_add(date'2020-01-01', cast(datediff(o_orderdate, date'1995-01-01') % {days} as int))"))
_near_sql = lambda f, days: _PERIODS.format(f=f, t=f"(SELECT * REPLACE (DATE '2020-01-01' + CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % {days} AS INTEGER) AS o_orderdate) FROM orders)")
query("profile_temporal", "orders", f"SELECT period, 'year' AS granularity, n FROM ({_YEARS})")(lambda o: profile.temporal_series(o, "o_orderdate").drop("value"))
query("profile_temporal_months", "orders", f"SELECT period, 'month' AS granularity, n FROM ({_near_sql('%Y-%m', 900)})")(lambda o: profile.temporal_series(_near(o, 900), "o_orderdate").drop("value"))
query("profile_temporal_days", "orders", f"WITH d AS ({_near_sql('%Y-%m-%d', 70)}) SELECT CASE WHEN CAST(period AS DATE) < (SELECT max(CAST(period AS DATE)) FROM d) - 47 THEN 'previous' ELSE period END AS period, 'day' AS granularity, CAST(sum(n) AS BIGINT) AS n FROM d GROUP BY 1")(lambda o: profile.temporal_series(_near(o, 70), "o_orderdate").drop("value"))
query("temporal_sum", "orders", f"SELECT period, 'year' AS granularity, n, total AS value FROM ({_YEARS})")(lambda o: profile.temporal_series(o, "o_orderdate", "o_totalprice", "sum").withColumn("value", F.round("value", 2)))
query("temporal_mean", "orders", f"SELECT period, 'year' AS granularity, n, mean AS value FROM ({_YEARS})")(lambda o: profile.temporal_series(o, "o_orderdate", "o_totalprice", "mean").withColumn("value", F.round("value", 4)))

# Quality: each rule's checked and invalid


def rule(name: str, source: str, r: dict, invalid: str, checked: str = "count(*)", order: str | list[str] | None = None, prepare=None):
    query(f"quality_{name}", source, f"SELECT '{r['kind']}' AS kind, CAST({checked} AS BIGINT) AS checked, CAST({invalid} AS BIGINT) AS invalid FROM {source}")(
        lambda df: quality.evaluate(prepare(df) if prepare else df, [r], order).select("kind", "checked", "invalid")
    )


_HOLES = lambda e: e.select("event_id", F.when(F.col("event_id") % 6 != 0, F.col("user_id")).alias("user"), F.when(F.col("event_id") % 9 == 0, " \u00a0").when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("kind"), "value", F.when(F.col("event_id") % 8 == 0, F.col("value") + 0.5).otherwise(F.col("value")).alias("other"))
rule("not_null", "events", {"kind": "not_null", "column": "user"}, "count(*) FILTER (event_id % 6 = 0)", prepare=_HOLES)
rule("non_empty", "events", {"kind": "non_empty", "column": "kind"}, "count(*) FILTER (event_id % 9 = 0 OR event_id % 4 = 0)", prepare=_HOLES)
rule("unique", "orders", {"kind": "unique", "column": "o_custkey"}, "count(*) - count(DISTINCT o_custkey)")
rule("numeric_range", "lineitem", {"kind": "numeric_range", "column": "l_quantity", "min": 5, "max": 40.5}, "count(*) FILTER (NOT coalesce(l_quantity BETWEEN 5 AND 40.5, false))")
rule("allowed_values", "orders", {"kind": "allowed_values", "column": "o_orderstatus", "values": ["F", "O"]}, "count(*) FILTER (NOT coalesce(o_orderstatus IN ('F', 'O'), false))")
rule("regex", "customer", {"kind": "regex", "column": "c_name", "pattern": r"#\d*5"}, "count(*) FILTER (NOT regexp_matches(c_name, '#[0-9]*5'))")
rule("dtype", "orders", {"kind": "dtype", "column": "o_totalprice", "dtype": "integer"}, "1", "1")
ORACLE["quality_dtype"] = "SELECT 'dtype' AS kind, CAST(1 AS BIGINT) AS checked, CAST(1 AS BIGINT) AS invalid"
rule("unique_together", "lineitem", {"kind": "unique_together", "columns": ["l_partkey", "l_suppkey"]}, "count(*) - count(DISTINCT (l_partkey, l_suppkey))")
rule("column_compare", "lineitem", {"kind": "column_compare", "column": "l_tax", "other": "l_discount", "operator": "lte"}, "count(*) FILTER (NOT l_tax <= l_discount)")
query2("quality_referential_integrity", "orders", "customer", "SELECT 'referential_integrity' AS kind, (SELECT count(*) FROM orders) AS checked, count(*) AS invalid FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")(
    lambda o, c: quality.evaluate(o, [{"kind": "referential_integrity", "column": "o_custkey", "reference": c.filter("c_mktsegment <> 'BUILDING'"), "referenceColumns": ["c_custkey"]}]).select("kind", "checked", "invalid")
)
rule("monotonic", "orders", {"kind": "monotonic", "column": "o_totalprice", "direction": "increasing"}, "0", order="o_orderkey")
ORACLE["quality_monotonic"] = "SELECT 'monotonic' AS kind, count(*) AS checked, count(*) FILTER (o_totalprice < b) AS invalid FROM (SELECT o_totalprice, lag(o_totalprice) OVER (ORDER BY o_orderkey) AS b FROM orders)"
rule("aggregate_check", "lineitem", {"kind": "aggregate_check", "column": "l_quantity", "aggregate": "sum", "expected": 0, "toleranceAbs": 1}, "1")
rule("aggregate_check_mean", "lineitem", {"kind": "aggregate_check", "column": "l_quantity", "aggregate": "mean", "expected": 25, "toleranceAbs": 3}, "CASE WHEN abs(avg(l_quantity) - 25) <= 3 THEN 0 ELSE 1 END")
rule("aggregate_reconciliation", "events", {"kind": "aggregate_reconciliation", "column": "value", "other": "other"}, "CASE WHEN abs(sum(CASE WHEN event_id % 8 = 0 THEN 0.5 ELSE 0 END)) > 1e-6 THEN 1 ELSE 0 END", prepare=_HOLES)
rule("distribution_drift", "lineitem", {"kind": "distribution_drift", "column": "l_discount", "baseline": 0.05, "threshold": 0.5}, "0")
rule("distribution_drift_found", "lineitem", {"kind": "distribution_drift", "column": "l_quantity", "baseline": 5, "threshold": 2}, "CASE WHEN abs(avg(l_quantity) - 5) > 2 THEN 1 ELSE 0 END")
rule("date_range", "orders", {"kind": "date_range", "column": "o_orderdate", "min": "1993-01-01", "max": "1997-06-30"}, "count(*) FILTER (NOT o_orderdate BETWEEN TIMESTAMP '1993-01-01' AND TIMESTAMP '1997-06-30')")
rule("conditional", "orders", {"kind": "conditional", "when": {"column": "o_orderstatus", "operator": "eq", "value": "F"}, "then": {"kind": "numeric_range", "column": "o_totalprice", "max": 100000}}, "count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 100000)", "count(*) FILTER (o_orderstatus = 'F')")
rule("schema_contract", "region", {"kind": "schema_contract", "columns": ["r_name", "r_regionkey", "r_comment"], "ordered": True}, "2", "1")
ORACLE["quality_schema_contract"] = "SELECT 'schema_contract' AS kind, CAST(1 AS BIGINT) AS checked, CAST(2 AS BIGINT) AS invalid"
rule("row_count", "nation", {"kind": "row_count", "min": 1, "max": 20}, "CASE WHEN count(*) BETWEEN 1 AND 20 THEN 0 ELSE 1 END", "1")

# The panel

_FILTERS = [explore.Filter("o_orderstatus", values=("F", "O")), explore.Filter("o_totalprice", low=1000, high=200000, closed=False), explore.Filter("o_orderdate", period="1995")]
_ALL = {"o_orderstatus": "o_orderstatus IN ('F', 'O')", "o_totalprice": "o_totalprice >= 1000 AND o_totalprice < 200000", "o_orderdate": "year(o_orderdate) = 1995"}
_but = lambda c: " AND ".join(v for k, v in _ALL.items() if k != c)
query("explore_kpi", "orders", f"SELECT count(*) AS rows, round(median(o_totalprice), 4) AS median, round(avg(o_custkey), 4) AS mean FROM orders WHERE {_but(None)}")(lambda o: explore.kpis(o, _FILTERS, "o_totalprice", "o_custkey").withColumns({"median": F.round("median", 4), "mean": F.round("mean", 4)}))
query("explore_bars", "orders", f"WITH c AS (SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE {_but(None)} GROUP BY 1), t AS (SELECT * FROM c ORDER BY n DESC, value NULLS FIRST LIMIT 3) SELECT value, n, false AS is_other FROM t UNION ALL SELECT NULL, CAST(sum(n) - (SELECT sum(n) FROM t) AS BIGINT), true FROM c")(lambda o: explore.bars(o, _FILTERS, "o_orderpriority", 3))
query("explore_bars_own", "orders", f"SELECT o_orderstatus AS value, count(*) AS n, false AS is_other FROM orders WHERE {_but('o_orderstatus')} GROUP BY 1")(lambda o: explore.bars(o, _FILTERS, "o_orderstatus"))
query("explore_histogram", "lineitem", "WITH r AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), w AS (SELECT lo, hi, greatest(1, ceil((hi - lo + 1) / 20)) AS w FROM r), k AS (SELECT *, CAST(ceil((hi - lo + 1) / w) AS INTEGER) AS k FROM w), c AS (SELECT CAST(least(floor((l_quantity - lo) / w), k - 1) AS INTEGER) AS bin, count(*) AS n FROM lineitem, k WHERE l_returnflag = 'R' GROUP BY 1) SELECT CAST(g AS INTEGER) AS bin, lo + w * g AS lower, CASE WHEN g = k - 1 THEN hi ELSE lo + w * (g + 1) END AS upper, coalesce(n, 0) AS n FROM k, LATERAL (SELECT unnest(generate_series(0, k - 1)) AS g) LEFT JOIN c ON c.bin = g")(
    lambda d: explore.histogram(d, [explore.Filter("l_returnflag", values=("R",))], "l_quantity")
)
query("explore_trend", "orders", f"SELECT strftime(o_orderdate, '%Y') AS period, count(*) AS n FROM orders WHERE {_but('o_orderdate')} GROUP BY 1")(lambda o: explore.trend(o, _FILTERS, "o_orderdate"))

# Readers of text

query("parse_strict", "events", "SELECT event_id, CAST(user_id AS BIGINT) AS whole, CAST(NULL AS DOUBLE) AS nan_text, CAST(event_id AS DOUBLE) / 4 AS comma, CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS flag FROM events")(
    lambda e: e.select(
        "event_id", P.strict_long(F.concat(F.lit(" +"), F.col("user_id").cast("string"))).alias("whole"), P.strict_double(F.lit("nan")).alias("nan_text"),
        P.strict_double(P.comma_decimal(F.replace((F.col("event_id") / 4).cast("decimal(20,2)").cast("string"), F.lit("."), F.lit(",")))).alias("comma"), P.strict_boolean(F.when(F.col("event_id") % 3 == 0, " TRUE").when(F.col("event_id") % 3 == 1, "False").otherwise("yes")).cast("string").alias("flag"),
    )
)
query("render_numbers", "lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = floor(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.0' ELSE CAST(l_quantity AS VARCHAR) END AS t FROM lineitem")(lambda d: d.select("l_orderkey", "l_linenumber", T.render_text(F.col("l_quantity"), "double").alias("t")))

# Import

_WRITTEN = lambda o: o.select("o_orderkey", F.format_string("%,.2f", "o_totalprice").alias("price"), F.date_format("o_orderdate", "d/M/yyyy").alias("day"), F.when(F.col("o_orderkey") % 50 == 0, "?").otherwise(F.col("o_custkey").cast("string")).alias("customer"))
query("import_conventions", "orders", "SELECT o_orderkey, round(o_totalprice, 2) AS price, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 50 = 0 THEN '?' ELSE CAST(o_custkey AS VARCHAR) END AS customer FROM orders")(
    lambda o: files.apply_conventions(_WRITTEN(o), {"price": "comma_dot", "day": "dmy", "customer": "integer"})[0]
)
query("import_report", "orders", "SELECT 'price' AS column_name, 0 AS invalid, true AS applied UNION ALL SELECT 'day', 0, true UNION ALL SELECT 'customer', count(*) FILTER (o_orderkey % 50 = 0), false FROM orders")(
    lambda o: o.sparkSession.createDataFrame([(r["column"], r["invalid"], r["applied"]) for r in files.apply_conventions(_WRITTEN(o), {"price": "comma_dot", "day": "dmy", "customer": "integer"})[1]], "column_name string, invalid long, applied boolean")
)
query("date_order", "orders", "SELECT 'dmy' AS day, 'mdy' AS us, 'iso' AS iso, 'ambiguous' AS low")(
    lambda o: o.sparkSession.createDataFrame([tuple(profile.date_order(d, c) for c in ("day", "us", "iso", "low")) for d in [o.select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"), F.date_format("o_orderdate", "M/d/yy").alias("us"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"), F.concat(F.lit("3/"), (F.col("o_orderkey") % 12 + 1).cast("string"), F.lit("/2020")).alias("low"))]], "day string, us string, iso string, low string")
)
query("suggested_types", "events", "SELECT 'integer' AS user_id, 'decimal' AS value, 'date' AS ts, 'boolean' AS flag, NULL AS event_type")(
    lambda e: e.sparkSession.createDataFrame([tuple(profile.suggested_types(e.select(F.col("user_id").cast("string").alias("user_id"), (F.col("value") + 0.001).cast("decimal(20,4)").cast("string").alias("value"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.when(F.col("event_id") % 2 == 0, "Yes").otherwise("no").alias("flag"), "event_type"), ["user_id", "value", "ts", "flag", "event_type"]).values())], "user_id string, value string, ts string, flag string, event_type string")
)
query("page_rows", "lineitem", "SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, l_returnflag FROM lineitem ORDER BY lineitem.l_orderkey, lineitem.l_linenumber LIMIT 50 OFFSET 100")(
    lambda d: files.page(with_rid(d.select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_orderkey", "l_linenumber"]), 100, 50)
)
query("compare_tolerant", "customer", "SELECT count(*) AS matched, count(*) FILTER (c_custkey % 11 = 0) AS conflicting FROM customer")(
    lambda c: joins.compare_keys(c, c.withColumns({"c_name": F.concat(F.lit(" "), F.upper("c_name"), F.when(F.col("c_custkey") % 11 == 0, "x").otherwise("")), "c_acctbal": F.col("c_acctbal") * (1 + 1e-15)}), ["c_custkey"], joins.CompareOptions(True, True, True)).select("matched", "conflicting")
)
query("cast_exclude_rows", "events", "SELECT event_id, CAST(user_id AS BIGINT) AS u FROM events WHERE event_id % 9 <> 0")(
    lambda e: Recipe.from_dict({"casts": [{"column": "u", "target": "integer", "policy": "excludeRow"}]}).apply(e.select("event_id", F.when(F.col("event_id") % 9 == 0, "1d").otherwise(F.col("user_id").cast("string")).alias("u")))
)
query("recipe_full", "orders", "SELECT yr, count(*) AS total_count, CAST(sum(total) AS DOUBLE) AS total_sum FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(floor(o_totalprice) AS DOUBLE) AS total FROM orders WHERE o_orderstatus = 'F') GROUP BY yr")(
    lambda o: Recipe.from_dict({
        "renames": [{"from": "o_totalprice", "to": "total"}], "filters": [{"column": "o_orderstatus", "op": "eq", "value": "F"}], "calculatedColumn": {"name": "yr", "op": "year", "left": {"column": "o_orderdate"}},
        "groupSummary": {"keys": ["yr"], "aggregations": [{"column": "o_totalprice", "function": "count"}, {"column": "o_totalprice", "function": "sum"}]},
    }).apply(o.withColumn("o_totalprice", F.floor("o_totalprice").cast("double")), "o_orderkey")
)

from . import source_queries  # noqa: E402, F401  registers the rest
