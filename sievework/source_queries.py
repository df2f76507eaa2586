"""Queries for readers and writers, by round trip: a table is written and read again, and the SQL is the table. And for what else is said of whole tables: schemas, names, plans, histories.

Folders go to the place that all executors share. Files of formats that are one file are written and read by the driver, as their operators do, from the small tables."""

from __future__ import annotations

import json
import os
import re
import shutil
import sqlite3
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli
from .functions import parse as P
from .functions import text as T
from .functions.names import privacy_signal, readable_headers
from .functions.order import with_rid
from .functions.quantiles import order_statistics
from .operators import cleaning, explore, joins, profile, quality
from .operators.recipe import Recipe
from .plans import dialect, documents, history
from .queries import ORACLE, QUERIES, query, query2, table
from .sources import delimited, files, samples, sinks


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share, deleted when the application ends; in a local session without one, in the temporary folder."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set")
        top = "file://" + os.path.join(tempfile.gettempdir(), "sievework")
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


class Local:
    """A folder of the driver's own, for formats that are one file; gone afterwards."""

    def __enter__(self) -> str:
        self.path = tempfile.mkdtemp()
        return self.path

    def __exit__(self, *_) -> None:
        shutil.rmtree(self.path)


def rows(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """A small table taken to the driver, so that its file may go."""
    held = df.select(*names) if names else df
    return held.sparkSession.createDataFrame([tuple(r) for r in held.collect()], held.schema)


def small(name: str, source: str, sql: str | None = None):
    """Registers f(table, folder) under name: what f returns is held before the folder goes."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with Local() as folder:
                return rows(f(table(spark, sf_dir, source), folder))

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql

    return add


def texts(columns: list[str], source: str) -> str:
    return "SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in columns) + f" FROM {source}"


# Folders, in parallel


def there_and_back(name: str, source: str, columns: list[str], write, read, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = shared_path(spark, name)
        write(table(spark, sf_dir, source).select(*columns), path)
        return read(spark, path)

    QUERIES[name], ORACLE[name] = run, sql


_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
there_and_back("sink_parquet", "orders", _ORDERS, sinks.write_parquet, files.read_parquet, "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
there_and_back("sink_json", "orders", _ORDERS, sinks.write_json, files.read_json, "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
there_and_back("sink_csv_parts", "orders", ["o_orderkey", "o_orderstatus", "o_orderpriority"], lambda d, p: sinks.write_csv_parts(d, p, ";"), delimited.read_delimited, texts(["o_orderkey", "o_orderstatus", "o_orderpriority"], "orders"))
there_and_back("scan_delimited_long", "documents", ["doc_id", "text"], sinks.write_csv_parts, lambda s, p: delimited.read_delimited(s, p, ",", multiline=True), "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN regexp_matches(text, '^[=+@\\-\\t\\r]') THEN '''' || text ELSE text END AS text FROM documents")

# One file

_CELLS = ["n_nationkey", "n_name", "n_regionkey"]
_NATION = texts(_CELLS, "nation")


def _quoted_nations(d: DataFrame) -> DataFrame:
    """Names with separators, quotes, line ends and gaps."""
    return d.select("n_nationkey", F.when(F.col("n_nationkey") % 5 == 0, F.concat("n_name", F.lit(' "a, b;c'), F.lit("\n"), F.lit("é"))).when(F.col("n_nationkey") % 5 == 1, F.lit("")).when(F.col("n_nationkey") % 5 != 2, F.col("n_name")).alias("n_name"))


_QUOTED_SQL = "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN n_name || ' \"a, b;c' || chr(10) || 'é' WHEN 1 THEN '' WHEN 2 THEN {gap} ELSE n_name END AS n_name FROM nation"


@small("sink_csv", "nation", _QUOTED_SQL.format(gap="NULL"))
def _(d, folder):
    sinks.write_csv(_quoted_nations(d), f"{folder}/a.csv")
    return delimited.read_delimited(d.sparkSession, f"file://{folder}/a.csv").withColumn("n_name", F.when((F.col("n_nationkey") % 5 == 1) & F.col("n_name").isNull(), "").otherwise(F.col("n_name")))


@small("sink_csv_excel", "nation", _NATION)
def _(d, folder):
    sinks.write_csv(d.select(*_CELLS), f"{folder}/a.csv", excel=True)
    with open(f"{folder}/a.csv", "rb") as f:
        if f.read(3) != b"\xef\xbb\xbf":
            raise ValueError("no byte order mark")
    return delimited.read_delimited(d.sparkSession, f"file://{folder}/a.csv")


def _foreign(d: DataFrame, folder: str, separator: str, end: str, encoding: str) -> DataFrame:
    lines = [separator.join(_CELLS)] + [separator.join(f"{v} ñ€" if isinstance(v, str) else str(v) for v in r) for r in d.select(*_CELLS).collect()]
    with open(f"{folder}/a.txt", "wb") as f:
        f.write((end.join(lines) + end).encode(encoding))
    return delimited.read_delimited(d.sparkSession, f"file://{folder}/a.txt")


_FOREIGN = "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name || ' ñ€' AS n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation"
for _name, _separator, _end, _encoding in (("scan_semicolons", ";", "\n", "utf-8"), ("scan_tabs", "\t", "\r\n", "utf-8"), ("scan_pipes_1252", "|", "\n", "cp1252"), ("scan_mac_line_ends", ",", "\r", "utf-8"), ("scan_byte_order_mark", ",", "\r\n", "utf-8-sig")):
    small(_name, "nation", _FOREIGN)(lambda d, folder, s=_separator, e=_end, c=_encoding: _foreign(d, folder, s, e, c))


@small("scan_headers", "nation", "SELECT 'with' AS kind, 0 AS place, 'name' AS name UNION ALL SELECT 'with', 1, 'name_2' UNION ALL SELECT 'with', 2, 'column_3' UNION ALL SELECT 'without', 0, 'column_1' UNION ALL SELECT 'without', 1, 'column_2' UNION ALL SELECT 'without', 2, 'column_3'")
def _(d, folder):
    with open(f"{folder}/a.csv", "w") as f:
        f.write("name,name,\n" + "".join(f"{r[0]},{r[1]},x\n" for r in d.select("n_nationkey", "n_name").collect()))
    found = delimited.preview_headers(d.sparkSession, f"file://{folder}/a.csv")
    return d.sparkSession.createDataFrame([(k, i, n) for k, names in zip(("with", "without"), found.values(), strict=True) for i, n in enumerate(names)], "kind string, place int, name string")


@small("sink_json_array", "nation", "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 2 THEN NULL WHEN n_nationkey % 5 = 1 THEN '' WHEN n_nationkey % 5 = 0 THEN n_name || ' \"a, b;c' || chr(10) || 'é' ELSE n_name END AS n_name FROM nation")
def _(d, folder):
    sinks.write_json_array(_quoted_nations(d), f"{folder}/a.json")
    return files.read_json(d.sparkSession, f"file://{folder}/a.json")


@small("sink_workbook", "nation", "SELECT n_nationkey, CASE WHEN n_nationkey % 5 <> 0 THEN n_name END AS n_name, n_nationkey % 2 = 0 AS even, n_nationkey / 4 AS quarter FROM nation")
def _(d, folder):
    sinks.write_workbook(d.select("n_nationkey", F.when(F.col("n_nationkey") % 5 != 0, F.col("n_name")).alias("n_name"), (F.col("n_nationkey") % 2 == 0).alias("even"), (F.col("n_nationkey") / 4).alias("quarter")), f"{folder}/a.xlsx")
    return files.read_workbook(d.sparkSession, f"file://{folder}/a.xlsx")


def _database(folder: str, d: DataFrame, script: str | None = None) -> DataFrame:
    with sqlite3.connect(f"{folder}/a.db") as db:
        if script:
            db.executescript(script)
        found = db.execute("SELECT n_nationkey, n_name FROM dataset").fetchall()
    return d.sparkSession.createDataFrame(found, "n_nationkey long, n_name string")


_KEPT = _QUOTED_SQL.format(gap="NULL").replace("CAST(n_nationkey AS VARCHAR)", "n_nationkey")


@small("sink_sqlite", "nation", _KEPT)
def _(d, folder):
    sinks.write_sqlite(_quoted_nations(d), f"{folder}/a.db")
    return _database(folder, d)


@small("sink_sql_script", "nation", _KEPT)
def _(d, folder):
    sinks.write_sql(_quoted_nations(d), f"{folder}/a.sql")
    with open(f"{folder}/a.sql", encoding="utf-8") as f:
        return _database(folder, d, f.read())


@small("sink_tsql_script", "nation", "SELECT n_nationkey, n_name FROM nation")
def _(d, folder):
    """The script's rows, read back from its INSERT."""
    sinks.write_tsql(d.select("n_nationkey", "n_name"), f"{folder}/a.sql", mode="upsert", keys=["n_nationkey"])
    with open(f"{folder}/a.sql", encoding="utf-8") as f:
        script = f.read()
    if "MERGE [dataset] AS t USING #incoming AS s ON t.[n_nationkey] = s.[n_nationkey]" not in script:
        raise ValueError("no merge")
    return d.sparkSession.createDataFrame([(int(a), b) for a, b in re.findall(r"\((\d+), N'([^']*)'\)", script)], "n_nationkey long, n_name string")


@small("sink_bulk_package", "nation", _NATION)
def _(d, folder):
    sinks.write_bulk(d.select(*_CELLS), f"{folder}/a.zip")
    with zipfile.ZipFile(f"{folder}/a.zip") as z:
        if b"BULK INSERT [dataset]" not in z.read("load.sql"):
            raise ValueError("no load script")
        z.extract("data.csv", folder)
    return delimited.read_delimited(d.sparkSession, f"file://{folder}/data.csv")


@small("sink_bundle", "nation", _NATION)
def _(d, folder):
    """The dataset of a bundle whose hashes hold."""
    import hashlib

    sinks.write_bundle(d.select(*_CELLS), f"{folder}/a.zip", Recipe.from_dict({"keepColumns": _CELLS}).to_json(), [{"kind": "not_null", "column": "n_name"}])
    with zipfile.ZipFile(f"{folder}/a.zip") as z:
        for name, digest in json.loads(z.read("manifest.json"))["files"].items():
            if hashlib.sha256(z.read(name)).hexdigest() != digest:
                raise ValueError(f"{name} doesn't match its hash")
        z.extract("dataset.csv", folder)
    return delimited.read_delimited(d.sparkSession, f"file://{folder}/dataset.csv")


query("sink_gate", "orders", "SELECT 'o_orderstatus' AS refused, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) > 0 AS closed FROM orders")(
    lambda o: o.sparkSession.createDataFrame([("o_orderstatus", _refused(lambda: sinks.gated(o, [{"kind": "allowed_values", "column": "o_orderstatus", "values": ["F", "O"]}])))], "refused string, closed boolean")
)


def _refused(f) -> bool:
    try:
        f()
    except ValueError:
        return True
    return False


@small("cli_transform", "nation", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name AS nation FROM nation WHERE n_regionkey = 1")
def _(d, folder):
    sinks.write_csv(d.select(*_CELLS), f"{folder}/a.csv")
    with open(f"{folder}/r.json", "w") as f:
        f.write(Recipe.from_dict({"filters": [{"column": "n_regionkey", "op": "eq", "value": "1"}], "renames": [{"from": "n_name", "to": "nation"}], "keepColumns": ["n_nationkey", "n_name"]}).to_json("few"))
    cli.transform(d.sparkSession, f"{folder}/a.csv", f"{folder}/r.json", f"{folder}/b.csv", "csv")
    return delimited.read_delimited(d.sparkSession, f"file://{folder}/b.csv")


# Columns by name

_PRIVATE = lambda c: c.select("c_custkey", F.col("c_name").alias("email"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("full_name"))
query("remove_personal_columns", "customer", "SELECT c_custkey, c_acctbal AS balance FROM customer")(lambda c: cleaning.remove_personal_columns(_PRIVATE(c)))
query("remove_identifier_columns", "customer", "SELECT c_name, c_mktsegment FROM customer")(lambda c: cleaning.remove_identifier_columns(c.select(F.col("c_custkey").alias("customer_id"), "c_name", "c_mktsegment")))
query("privacy_signals", "customer", "SELECT * FROM (VALUES ('email', 'email'), ('customer_id', 'identifier'), ('balance', NULL), ('phone', 'phone')) t(name, signal)")(
    lambda c: c.sparkSession.createDataFrame([(n, privacy_signal(n)) for n in ("email", "customer_id", "balance", "phone")], "name string, signal string")
)
query2("schema_diff", "customer", "supplier", "SELECT 's_nationkey' AS shared, 'c_custkey,c_name,c_acctbal,c_mktsegment' AS current_only, 's_suppkey,s_name,s_acctbal' AS compared_only, true AS same_types")(
    lambda c, s: c.sparkSession.createDataFrame([(",".join(x["shared"]), ",".join(x["current_only"]), ",".join(x["compared_only"]), x["same_types"]) for x in [joins.schema_diff(c.withColumnRenamed("c_nationkey", "s_nationkey"), s)]], "shared string, current_only string, compared_only string, same_types boolean")
)

# Order and counts

query2("join_full_order", "documents", "labels", "WITH j AS (SELECT d.doc_id AS a, l.doc_id AS b, coalesce(d.doc_id, l.doc_id) AS doc_id FROM (SELECT * FROM documents WHERE doc_id % 2 = 0) d FULL JOIN labels l ON d.doc_id = l.doc_id) SELECT doc_id, row_number() OVER (ORDER BY a NULLS LAST, b NULLS FIRST) AS place FROM j")(
    lambda d, la: _places(joins.key_join(d.filter("doc_id % 2 = 0").select("doc_id", "lang"), la.select("doc_id", "quality"), [("doc_id", "doc_id")], "full", "doc_id", "doc_id"))
)


def _places(joined: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return joined.select("doc_id", F.row_number().over(Window.orderBy("_rid")).cast("long").alias("place"))


query("sql_unlimited_count", "orders", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000")(lambda o: o.sparkSession.createDataFrame([(dialect.count("SELECT o_orderkey FROM dataset WHERE o_totalprice > 100000 LIMIT 10", o),)], "n long"))
query("quantiles_by_ranges", "lineitem", "SELECT place, l_extendedprice AS value FROM (SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice) - 1 AS place FROM lineitem) WHERE place IN (0, 10, 999, 5000)")(
    lambda d: d.sparkSession.createDataFrame([(p, float(v)) for p, v in zip((0, 10, 999, 5000), order_statistics(d, F.col("l_extendedprice"), [0, 10, 999, 5000], few=50), strict=True)], "place long, value double")
)

# Readers of text

_SAID = lambda e: e.select("event_id", F.element_at(F.array(*map(F.lit, ("1.234,5", "1 234,50", "12,5", "1,234.5", "007", "+08", "70", "0", "9007199254740993", "1e3", " 4 "))), (F.col("event_id") % 11 + 1).cast("int")).alias("t"))
_SAID_SQL = "WITH g AS (SELECT event_id, ['1.234,5', '1 234,50', '12,5', '1,234.5', '007', '+08', '70', '0', '9007199254740993', '1e3', ' 4 '][event_id % 11 + 1] AS t FROM events) "
query("parse_tests", "events", _SAID_SQL + "SELECT event_id, event_id % 11 IN (0, 1, 2) AS comma, event_id % 11 IN (4, 5) AS code, CASE event_id % 11 WHEN 4 THEN 7.0 WHEN 5 THEN 8.0 WHEN 6 THEN 70.0 WHEN 7 THEN 0.0 WHEN 9 THEN 1000.0 WHEN 10 THEN 4.0 END AS exact, CASE event_id % 11 WHEN 4 THEN 7 WHEN 5 THEN 8 WHEN 6 THEN 70 WHEN 7 THEN 0 WHEN 8 THEN 9007199254740993 WHEN 10 THEN 4 END::VARCHAR AS whole FROM g")(
    lambda e: _SAID(e).select("event_id", P.is_comma_decimal(T.trim(F.col("t"))).alias("comma"), P.leading_zero_code(F.col("t")).alias("code"), P.exact_number(F.col("t")).alias("exact"), P.strict_long(F.col("t")).cast("string").alias("whole"))
)
query("parse_month_first", "orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE WHEN day(o_orderdate) <= 12 THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) END AS other FROM orders")(
    lambda o: o.select("o_orderkey", P.strict_date(F.date_format("o_orderdate", "M/d/yyyy"), "mdy").alias("d"), P.strict_date(F.date_format("o_orderdate", "M/d/yyyy"), "dmy").alias("other"))
)
query("profile_text_signals", "customer", "SELECT count(*) AS row_count, count(*) FILTER (c_custkey % 7 IN (0, 4)) AS sentinel_count, count(*) FILTER (c_custkey % 7 = 1) AS mojibake_count, count(*) FILTER (c_custkey % 7 = 2) AS untrimmed_count, count(*) FILTER (c_custkey % 7 = 3) AS comma_decimal_count, count(*) FILTER (c_custkey % 7 = 4) AS empty_count FROM customer")(
    lambda c: profile.column_profile(c.select(F.element_at(F.array(F.lit("n/a"), F.lit("cafÃ©"), F.concat("c_name", F.lit(" ")), F.lit("1.234,5"), F.lit(""), F.col("c_name"), F.col("c_mktsegment")), (F.col("c_custkey") % 7 + 1).cast("int")).alias("t"))).select("row_count", "sentinel_count", "mojibake_count", "untrimmed_count", "comma_decimal_count", "empty_count")
)
query("render_cells", "events", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'true' WHEN event_id % 3 = 1 THEN 'false' END AS flag, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(user_id AS VARCHAR) AS whole FROM events")(
    lambda e: e.select("event_id", T.render_text(F.when(F.col("event_id") % 3 != 2, F.col("event_id") % 3 == 0), "boolean").alias("flag"), T.render_text(F.col("ts").cast("date"), "date").alias("day"), T.render_text(F.col("user_id"), "bigint").alias("whole"))
)

# Proposals

_RAW = lambda c: c.select(F.concat(F.lit(" "), F.col("c_custkey").cast("string")).alias("Número"), F.when(F.col("c_custkey") % 5 == 0, "N/A").otherwise(F.col("c_mktsegment")).alias("Segmento"), F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")), "yyyy-MM-dd").alias("día"))
_RAW_SQL = "WITH g AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS seg, DATE '2020-01-01' + CAST(c_custkey % 300 AS INTEGER) AS dia FROM customer), m AS (SELECT seg FROM g WHERE seg IS NOT NULL GROUP BY seg ORDER BY count(*) DESC, min(c_custkey) LIMIT 1) "
query("apply_safe_corrections", "customer", _RAW_SQL + "SELECT c_custkey AS numero, coalesce(seg, (SELECT seg FROM m)) AS segmento, CAST(dia AS TIMESTAMP) AS dia FROM g")(lambda c: cleaning.safe_corrections(with_rid(_RAW(c).withColumn("_rid", F.trim("Número").cast("long")))).drop("_rid"))
query("preview_safe_corrections", "customer", "SELECT step, column_name, CAST(cells AS BIGINT) AS cells FROM (SELECT count(*) AS n, count(*) FILTER (c_custkey % 5 = 0) AS gaps FROM customer), LATERAL (VALUES ('trim', 'Número', n), ('sentinels', 'Segmento', gaps), ('rename', 'Número', 1), ('rename', 'Segmento', 1), ('rename', 'día', 1), ('cast to bigint', 'numero', n), ('cast to timestamp_ntz', 'dia', n), ('gaps', 'segmento', gaps)) t(step, column_name, cells)")(
    lambda c: cleaning.preview_safe_corrections(_RAW(c))
)
query("panel_plan", "orders", "SELECT * FROM (VALUES ('bars', 'o_orderstatus'), ('bars', 'o_orderpriority'), ('measure', 'o_totalprice'), ('date', 'o_orderdate')) t(chart, column_name)")(
    lambda o: o.sparkSession.createDataFrame([*(("bars", c) for c in p.bars), *(("measure", c) for c in p.measures), ("date", p.date)], "chart string, column_name string") if (p := explore.plan_panel(o.select("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))) else None
)
query2("mirrored_columns", "customer", "nation", "SELECT true AS same, false AS other")(
    lambda c, n: c.sparkSession.createDataFrame([(explore.mirrors(j, "n_nationkey", "n_name"), explore.mirrors(j, "n_nationkey", "c_mktsegment")) for j in [c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))]], "same boolean, other boolean")
)

# Documents and histories

query("contract_migration", "lineitem", "SELECT 'numeric_range' AS kind, count(*) AS checked, count(*) FILTER (l_quantity > 40) AS invalid FROM lineitem")(
    lambda d: quality.evaluate(d, documents.migrate_contract({"schema_version": 2, "rules": [{"type": "Range", "column": "l_quantity", "max": 40}, {"kind": "unheard of"}]})[0]).select("kind", "checked", "invalid")
)
query("recipe_document", "orders", "SELECT o_orderkey AS id, round(o_totalprice * 2, 2) AS twice FROM orders WHERE o_orderstatus = 'F'")(
    lambda o: Recipe.from_json(Recipe.from_dict({"renames": [{"from": "o_orderkey", "to": "id"}], "filters": [{"column": "o_orderstatus", "op": "eq", "value": "F"}], "calculatedColumn": {"name": "twice", "op": "multiply", "left": {"column": "o_totalprice"}, "right": {"literal": 2}}, "keepColumns": ["o_orderkey", "o_totalprice"]}).to_json("two")).apply(o).select("id", F.round("twice", 2).alias("twice"))
)


def _remembered(o: DataFrame) -> DataFrame:
    """Two steps, both undone, one done again."""
    h = history.History(o.select("o_orderkey", "o_orderstatus"))
    h.record("filter", h.current.filter("o_orderstatus = 'F'"))
    h.record("fewer", h.current.filter("o_orderkey % 2 = 0"))
    h.undo()
    h.undo()
    return h.redo()


query("history", "orders", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")(_remembered)


def _compared(o: DataFrame) -> DataFrame:
    h = history.History(o.select("o_orderkey", "o_totalprice"))
    h.record("filter", h.current.filter("o_orderkey % 3 = 0"))
    found = h.compare(0, 1)["columns"]
    return o.sparkSession.createDataFrame([(c, *(int(found[c][k][side]) for k in ("row_count", "null_count", "unique_count") for side in (0, 1))) for c in found], "column_name string, rows_before long, rows_after long, nulls_before long, nulls_after long, unique_before long, unique_after long")


query("snapshot_comparison", "orders", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS rows_before, count(*) FILTER (o_orderkey % 3 = 0) AS rows_after, 0 AS nulls_before, 0 AS nulls_after, count(DISTINCT {c}) AS unique_before, count(DISTINCT {c}) FILTER (o_orderkey % 3 = 0) AS unique_after FROM orders" for c in ("o_orderkey", "o_totalprice")))(_compared)
query("sample_datasets", "region", "SELECT 'gaps' AS name, 200 AS n UNION ALL SELECT 'series', 400")(lambda r: r.sparkSession.createDataFrame([("gaps", samples.gaps(r.sparkSession).count()), ("series", samples.series(r.sparkSession).count())], "name string, n int"))
query("readable_headers", "region", "SELECT * FROM (VALUES (0, 'name'), (1, 'name_2'), (2, 'column_3')) t(place, name)")(lambda r: r.sparkSession.createDataFrame(list(enumerate(readable_headers(["name", "name", None]))), "place int, name string"))
