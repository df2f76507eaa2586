import json
import sqlite3
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sievework import cli
from sievework.functions.order import with_rid
from sievework.operators import cleaning, explore, joins, outliers, profile, quality
from sievework.operators.recipe import Recipe, RecipeError
from sievework.plans import dialect
from sievework.plans.history import History
from sievework.sources import files, sinks
from sievework.sources.delimited import detect_separator, preview_headers, read_delimited
from sievework.streaming.recipes import apply_to_stream


def rows(df, *by):
    return [tuple(r) for r in (df.orderBy(*by) if by else df).collect()]


def people(spark):
    return spark.createDataFrame([(1, "Ana", "10", 1.5), (2, "Bo", None, None), (3, "ana ", "x", 2.5), (4, None, "7", -1.0)], "id long, name string, amount string, score double")


def test_recipe_order_and_policies(spark):
    df = people(spark)
    steps = {"renames": [{"from": "amount", "to": "total"}], "casts": [{"column": "amount", "target": "integer", "policy": "excludeRow"}], "filters": [{"column": "amount", "op": "gte", "value": 8}], "keepColumns": ["id", "amount"]}
    assert rows(Recipe.from_dict(steps).apply(df)) == [(1, 10)]
    steps["casts"][0]["policy"] = "review"
    with pytest.raises(RecipeError, match="'x'"):
        Recipe.from_dict(steps).apply(df)
    steps["casts"][0]["policy"], steps["filters"] = "nullify", []
    assert rows(Recipe.from_dict(steps).apply(df), "id") == [(1, 10), (2, None), (3, None), (4, 7)]
    again = Recipe.from_json(Recipe.from_dict(steps).to_json("r"))
    assert rows(again.apply(df), "id") == [(1, 10), (2, None), (3, None), (4, 7)]
    changed = Recipe.from_dict({"findReplace": [{"find": "a", "replace": "b"}]}).changes(df)
    assert changed["changed_cells"] == 2 and changed["rows_out"] == 4


def test_recipe_errors(spark):
    df = people(spark)
    bad = [
        {"renames": [{"from": "id", "to": "name"}]}, {"filters": [{"column": "amount", "op": "gt", "value": 1}]}, {"keepColumns": ["nope"]},
        {"calculatedColumn": {"name": "x", "op": "year", "left": {"column": "id"}}}, {"splitColumn": {"column": "name", "delimiter": "", "targets": ["a", "b"]}}, {"what": 1},
        {"outlierTreatments": [{"column": "score", "action": "cap"}]}, {"casts": [{"column": "id", "target": "string"}], "dateParses": [{"column": "id"}]},
    ]
    for steps in bad:
        with pytest.raises(RecipeError if "outlierTreatments" not in steps else ValueError):
            Recipe.from_dict(steps).apply(df)
    with pytest.raises(PySparkException):
        Recipe.from_dict({"calculatedColumn": {"name": "x", "op": "divide", "left": {"column": "id"}, "right": {"literal": 0}}}).apply(df).collect()


def test_saved_spellings(spark):
    df = people(spark)
    saved = {"version": 2, "name": "n", "savedAt": "2026-01-01T00:00:00Z", "recipe": {
        "renames": [], "casts": [{"column": "amount", "target": "decimal", "decimalSeparator": "comma", "policy": "nullify"}], "dateParses": [], "filters": [{"column": "id", "operator": "lte", "value": "3"}],
        "calculatedColumn": {"name": "c", "source": "score", "operation": "add", "operand": {"kind": "literal", "value": "1"}}, "findReplace": {"scope": "all_text_columns", "column": None, "find": "a", "replace": "o", "regex": False},
        "keepColumns": None, "splitColumn": {"source": "name", "delimiter": "n", "names": ["l", "r"], "dropSource": False}, "mergeColumns": {"sources": ["l", "r"], "name": "m", "separator": "+", "dropSources": True},
        "outlierTreatments": [], "groupSummary": None, "contactNormalizations": [], "textExtractions": [{"source": "m", "kind": "first_token", "name": "t", "delimiter": None}],
    }}
    assert rows(Recipe.from_json(json.dumps(saved)).apply(df).select("id", "amount", "c", "m", "t"), "id") == [(1, 10.0, 2.5, "A+o", "A+o"), (2, None, None, "Bo", "Bo"), (3, None, 3.5, "o+o ", "o+o")]
    summary = {"groupSummary": {"groupBy": ["name"], "aggregations": [{"column": "id", "operation": "count"}]}}
    assert Recipe.from_dict(summary).apply(df).columns == ["name", "id_count"]
    one = lambda **r: quality.evaluate(df, [r]).first()["invalid"]
    assert one(column="id", kind="column_compare", columns=["id", "score"], operator="gt") == 2
    assert one(column="id", kind="referential_integrity", columns=["id"], referenceValues=["1", "2"]) == 2
    assert one(column="id", kind="referential_integrity", columns=["id", "name"], referenceValues=['[1, "Ana"]', '[2, "x"]']) == 3
    assert one(column="id", kind="schema_contract", columns=["id", "name"]) == 0 and one(column="id", kind="schema_contract", columns=["id"], allowAdditional=False, requiredOrder=["id"]) == 4
    assert one(column="id", kind="dtype", dtype="int64") == 0 and one(column="id", kind="date_range", minDate="2020-01-01") == 4


def test_group_summary_order(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("b", None), ("a", 5)], "k string, v long")
    out = Recipe.from_dict({"groupSummary": {"keys": ["k"], "aggregations": [{"column": "v", "function": f} for f in ("sum", "mean", "min", "max", "count", "count_unique")]}}).apply_ordered(df)
    assert rows(out.orderBy("_rid").drop("_rid")) == [("b", 1, 1.0, 1, 1, 2, 1), ("a", 7, 3.5, 2, 5, 2, 2), (None, 3, 3.0, 3, 3, 1, 1)]


def test_stream(spark, tmp_path):
    people(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(people(spark).schema).parquet(str(tmp_path / "in"))
    out = apply_to_stream(Recipe.from_dict({"renames": [{"from": "name", "to": "n"}], "filters": [{"column": "amount", "op": "not_null"}], "contactNormalizations": [{"column": "name", "kind": "email"}]}), stream)
    q = out.writeStream.format("memory").queryName("recipe_stream").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("recipe_stream").select("id", "n"), "id") == [(1, "ana"), (3, "ana"), (4, None)]
    with pytest.raises(RecipeError):
        apply_to_stream(Recipe.from_dict({"groupSummary": {"keys": ["id"], "aggregations": [{"column": "id", "function": "count"}]}}), stream)


def test_duplicates(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["Año", "ano", "Año", "x", "AÑO ", "x"])], "i long, t string").withColumnRenamed("i", "_rid")
    assert rows(cleaning.remove_duplicates(df).select("_rid"), "_rid") == [(0,), (1,), (3,), (4,)]
    assert rows(cleaning.remove_near_duplicates(df).select("_rid"), "_rid") == [(0,), (2,), (3,), (5,)]
    assert profile.dataset_summary(df.drop("_rid")).first().asDict() == {"rows": 6, "duplicates": 2, "near_duplicates": 2}


def test_cleaning_values(spark):
    df = spark.createDataFrame([(i, v, "  x") for i, v in enumerate(["unknown", "N/A", "a", "none", "none", " b "])], "i long, v string, w string")
    assert [r[0] for r in rows(cleaning.normalize_sentinels(df).orderBy("i").select("v"))] == ["unknown", None, "a", None, None, " b "]
    noted = cleaning.trim_text_values(cleaning.enable_audit(df)).orderBy("i").collect()
    assert noted[5]["v"] == "b" and noted[5]["_cambios"] == "trim: v, w" and noted[0]["_cambios"] == "trim: w"
    before = with_rid(df, "i")
    r = cleaning.report(before, cleaning.trim_text_values(before))
    assert (r.rows_removed, r.changed_cells, r.by_column["v"]) == (0, 7, 1)
    fixed = cleaning.safe_corrections(spark.createDataFrame([("1 ", "a", "2024-01-02"), ("1", "a", "2024-01-02"), ("2", "N/A", "2024-05-02"), ("3", "a", "2024-05-03")], "`My Num` string, kind string, day string"))
    assert dict(fixed.dtypes)["my_num"] == "bigint" and dict(fixed.dtypes)["day"] == "timestamp_ntz"
    assert [r["kind"] for r in fixed.orderBy("my_num").collect()] == ["a", "a", "a"] or fixed.count() == 3


def test_cleaning_columns(spark):
    df = spark.createDataFrame([(1, "a", None, "k", "x@y"), (2, "a", None, "k", None)], "user_id long, same string, none string, code string, email string")
    assert cleaning.remove_constant_columns(df).columns == ["user_id", "none", "email"]
    assert cleaning.remove_empty_columns(df).columns == ["user_id", "same", "code", "email"]
    assert cleaning.remove_identifier_columns(df).columns == ["same", "none", "email"]
    assert cleaning.remove_personal_columns(df).columns == ["user_id", "same", "none", "code"]
    assert rows(cleaning.mask_personal_values(df).select("email"), "user_id" if False else "email") == [(None,), ("[REDACTED]",)]


def test_medians(spark):
    big = 1 << 60
    df = with_rid(spark.createDataFrame([(big + 1,), (big + 3,), (big + 3,), (None,), (big + 5,), (1,)], "v long"))
    assert outliers.exact_lower_median(df, "v") == big + 3
    assert sorted(r[0] for r in rows(outliers.impute_missing(df, ["v"]).select("v"))) == [1, big + 1, big + 3, big + 3, big + 3, big + 5]
    ints = spark.createDataFrame([(x,) for x in (1, 2, 3, 4, 100)], "v long")
    assert sorted(r[0] for r in rows(outliers.treat_all(ints, "cap"))) == [1, 2, 3, 4, 7]
    assert sorted(r[0] for r in rows(outliers.treat_recipe(ints, [("v", "impute")]))) == [1, 2, 3, 3, 4]
    assert outliers.treat_all(ints, "drop").count() == 4


def test_joins_order_and_names(spark):
    a = spark.createDataFrame([(0, 1, "x"), (1, None, "y"), (2, 3, "z")], "o long, k long, v string")
    b = spark.createDataFrame([(0, 3, "p"), (1, 1, "q"), (2, None, "r"), (3, 1, "s")], "o long, k long, v string")
    out = joins.key_join(a.withColumnRenamed("o", "_rid"), b.withColumnRenamed("o", "_rid"), [("k", "k")], "full")
    assert rows(out.orderBy("_rid").drop("_rid")) == [(1, "x", "q"), (1, "x", "s"), (None, "y", None), (3, "z", "p"), (None, None, "r")]
    assert out.columns[:3] == ["k", "v", "v_right"]
    assert joins.join_bound(a, b, [("k", "k")]) == 3


def test_compare_options(spark):
    a = spark.createDataFrame([(1, "A ", 1.0), (2, "b", 0.1 + 0.2), (None, "n", 1.0)], "k long, t string, n double")
    b = spark.createDataFrame([(1, "a", 1.0), (2, "b", 0.3), (None, "n", 1.0)], "k long, t string, n double")
    assert joins.compare_keys(a, b, ["k"]).first()["conflicting"] == 2
    loose = joins.CompareOptions(True, True, True)
    assert joins.compare_keys(a, b, ["k"], loose).first()["matched"] == 3
    assert joins.compare_rows(a, b, loose).first()["common"] == 3
    assert {(r["k"], r["column_name"]) for r in joins.conflicts(a, b, ["k"]).collect()} == {(1, "t"), (2, "n")}
    with pytest.raises(ValueError):
        joins.consolidate(a, b, ["k"])


def test_monotonic_across_partitions(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 3 else (i if i % 10 else -i)) for i in range(100)], "i long, v long").repartition(7)
    want, last = 0, None
    for i in range(100):
        v = None if i % 7 == 3 else (i if i % 10 else -i)
        if v is not None:
            want += last is not None and v < last
            last = v
    for parts in (1, 5):
        assert quality.monotonic_breaks(df, "v", order="i", parts=parts).first()["n"] == want


def test_contract(spark):
    contract = quality.Contract.from_json(json.dumps({"format": "x", "version": 1, "rules": [{"kind": "not_null", "column": "name", "maxInvalid": 1}, {"kind": "numeric_range", "column": "amount", "min": 0, "maxInvalidPct": 25}]}))
    got = quality.evaluate(people(spark), contract).collect()
    assert [(r["invalid"], r["passed"]) for r in got] == [(1, True), (2, False)]
    with pytest.raises(ValueError):
        sinks.gated(people(spark), contract.rules)
    assert quality.Contract.from_json(contract.to_json()).rules == contract.rules


def test_rules_by_hand(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, 1.0, "b", True), (1, nan, "a", False), (2, 2.0, "9", None), (3, None, "10", True)], "i long, n double, t string, f boolean")
    assert quality.monotonic_breaks(df, "n", order="i").first()["n"] == 2
    assert quality.monotonic_breaks(df, "t", order="i").first()["n"] == 3 and quality.monotonic_breaks(df, "t", False, order="i").first()["n"] == 0
    one = lambda **r: quality.evaluate(df, [r]).first()["invalid"]
    assert one(kind="aggregate_check", column="f", aggregate="sum", expected=2) == 0
    assert one(kind="aggregate_check", column="n", aggregate="count", expected=2) == 1  # NaN can't be read
    assert one(kind="aggregate_check", column="t", aggregate="sum", referenceValues=["9", "10"]) == 2
    assert one(kind="aggregate_reconciliation", column="f", other="f") == 0
    assert one(kind="distribution_drift", column="f", baseline=[1, 0, 1], threshold=0.01) == 0
    assert one(kind="conditional", when={"column": "t", "operator": "lt", "value": "9"}, then={"kind": "not_null", "column": "n"}) == 1
    assert one(kind="conditional", when={"column": "f", "operator": "eq", "value": "true"}, then={"kind": "numeric_range", "column": "n", "min": 0}) == 1


def test_dialect(spark):
    df = people(spark)
    assert rows(dialect.run("""SELECT "name" AS n, id FROM dataset WHERE amount > 8 OFFSET 0""", df)) == [("Ana", 1), ("ana ", 3)]  # x > 8 as text
    assert rows(dialect.run("select count(*), count(amount) as c, max(score) from dataset;", df)) == [(4, 3, 2.5)]
    assert rows(dialect.run("SELECT * FROM dataset WHERE name IS NULL", df)) == [(4, None, "7", -1.0)]
    assert rows(dialect.run("SELECT MIN(amount) AS m FROM dataset WHERE amount <> 'x'", df)) == [("7",)]
    assert dialect.count("SELECT id FROM dataset LIMIT 1", df) == 4
    for bad in ("SELECT id FROM other", "SELECT id FROM dataset ORDER BY id", "SELECT id, COUNT(*) FROM dataset", "SELECT id FROM dataset WHERE id = 1 OR id = 2", "SELECT nope FROM dataset", "DROP TABLE x", "SELECT id FROM dataset LIMIT 500", "SELECT id FROM dataset GROUP BY id"):
        with pytest.raises(dialect.QueryError):
            dialect.run(bad, df)


def test_comparisons_reach_the_scan(spark, data):
    lines = spark.read.parquet(f"{data}/lineitem.parquet")
    for df in (Recipe.from_dict({"filters": [{"column": "l_linenumber", "op": "gt", "value": "2.5"}], "keepColumns": ["l_orderkey"]}).apply(lines), dialect.run("SELECT l_orderkey FROM dataset WHERE l_linenumber >= 2.5", lines)):
        plan = df._jdf.queryExecution().toString()
        assert "GreaterThan" in plan.split("PushedFilters:")[1][:200] and "l_comment" not in plan.split("ReadSchema:")[1][:200]
    whole = spark.createDataFrame([(1,), (2,), (None,)], "v long")
    for op, bound, n in (("eq", 1.5, 0), ("neq", 1.5, 2), ("eq", 2, 1), ("gt", 1.5, 1), ("lte", 1.5, 1), ("gte", 1, 2), ("lt", 1, 0)):
        from sievework.functions.order import against

        assert whole.filter(against(F.col("v"), "bigint", op, float(bound))).count() == n


def test_delimited(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes('name;note;;name\n"a;1";"";x;\n"l1\nl2";;y;é\n'.encode())
    df = read_delimited(spark, str(p))
    assert df.columns == ["name", "note", "column_3", "name_2"]
    assert rows(df) == [("a;1", "", "x", None), ("l1\nl2", None, "y", "é")]
    assert preview_headers(spark, str(p))["generated"] == ["column_1", "column_2", "column_3", "column_4"]
    q = tmp_path / "b.csv"
    q.write_bytes("a,b\rñ,1\r".encode("cp1252"))
    assert rows(read_delimited(spark, str(q))) == [("ñ", "1")]
    assert detect_separator("a\tb", "x.tsv") == "\t" and detect_separator("a|b\nc|d\n") == "|" and detect_separator("abc") == ","
    (tmp_path / "c.csv").write_bytes(b"")
    with pytest.raises(ValueError):
        read_delimited(spark, str(tmp_path / "c.csv"))


def test_json_and_conventions(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text('[{"z": 1, "a": "x", "m": 1.5, "big": 9007199254740993, "n": {"k": [1]}}, {"z": 2, "a": 3, "m": 2, "big": 1.5, "b": true}]')
    df = files.read_json(spark, str(p))
    assert df.columns == ["z", "a", "m", "big", "n", "b"]
    assert dict(df.dtypes) == {"z": "bigint", "a": "string", "m": "double", "big": "string", "n": "string", "b": "boolean"}
    assert json.loads(df.first()["n"]) == {"k": [1]}
    text = spark.createDataFrame([("1.234,5", "3/4/2024", "007"), ("2,5", "x", "8")], "a string, b string, c string")
    out, report = files.apply_conventions(text, {"a": "dot_comma", "b": "dmy", "c": "integer"})
    assert dict(out.dtypes) == {"a": "double", "b": "string", "c": "string"} and [r["invalid"] for r in report] == [0, 1, 1]
    assert rows(out.select("a")) == [(1234.5,), (2.5,)]
    assert files.schema_drift(out, {"a": "string", "z": "long"}) == {"missing": ["z"], "additional": ["b", "c"], "changed": ["a"]}
    assert files.merged_kind([1, 2.0, None]) == "bigint" and files.merged_kind([1, 2.5]) == "double" and files.merged_kind([1, "a"]) == "string"
    assert rows(files.page(with_rid(people(spark), "id"), 1, 2).select("id", "score")) == [("2", None), ("3", "2.5")]


def test_sinks(spark, tmp_path):
    df = with_rid(spark.createDataFrame([(1, "=x", 1.5, True), (2, "it's", None, False)], "id long, t string, n double, b boolean"), "id")
    at = lambda n: str(tmp_path / n)
    sinks.write_csv(df, at("a.csv"))
    assert open(at("a.csv")).read() == "id,t,n,b\n1,'=x,1.5,true\n2,it's,,false\n"
    sinks.write_csv(df, at("e.csv"), excel=True)
    assert open(at("e.csv"), "rb").read().startswith(b"\xef\xbb\xbfid;t")
    sinks.write_sql(df, at("a.sql"))
    assert "(2, 'it''s', NULL, FALSE)" in open(at("a.sql")).read()
    sinks.write_tsql(df, at("t.sql"), mode="upsert", keys=["id"])
    script = open(at("t.sql")).read()
    assert "[t] NVARCHAR(4)" in script and "N'it''s'" in script and "MERGE" in script
    sinks.write_sqlite(df, at("a.db"))
    assert sqlite3.connect(at("a.db")).execute("SELECT id, t, n, b FROM dataset").fetchall() == [(1, "=x", 1.5, 1), (2, "it's", None, 0)]
    sinks.write_workbook(df, at("a.xlsx"))
    back = files.read_workbook(spark, at("a.xlsx"))
    assert dict(back.dtypes) == {"id": "bigint", "t": "string", "n": "double", "b": "boolean"} and rows(back) == [(1, "=x", 1.5, True), (2, "it's", None, False)]
    assert "<v>1.5</v>" in zipfile.ZipFile(at("a.xlsx")).read("xl/worksheets/sheet1.xml").decode()
    sinks.write_bundle(df, at("a.zip"), recipe="{}", rules=[{"kind": "not_null", "column": "id"}])
    assert set(zipfile.ZipFile(at("a.zip")).namelist()) == {"dataset.csv", "dictionary.json", "quality.json", "recipe.json", "manifest.json"}
    for kind in ("parquet", "json", "csv_parts"):
        getattr(sinks, f"write_{kind}")(df, at(kind))
    assert files.read_parquet(spark, at("parquet")).count() == 2
    with pytest.raises(ValueError):
        sinks.write_sql(spark.createDataFrame([(float("nan"),)], "x double"), at("n.sql"))
    import os

    assert not os.path.exists(at("n.sql")) and not os.path.exists(at("n.sql.part"))


def test_history_and_cli(spark, tmp_path):
    h = History(people(spark), folder=str(tmp_path / "h"))
    h.record("filtered", h.current.filter("id > 1"))
    assert h.undo().count() == 4 and h.redo().count() == 3 and h.state()["can_undo"]
    assert h.compare(0, 1)["columns"]["id"]["row_count"] == (4, 3)
    (tmp_path / "in.csv").write_text("name,amount\n=a,1\nb,2\n")
    (tmp_path / "r.json").write_text(Recipe.from_dict({"renames": [{"from": "amount", "to": "total"}]}).to_json())
    job = {"input": str(tmp_path / "in.csv"), "recipe": str(tmp_path / "r.json"), "output": str(tmp_path / "out.csv"), "format": "csv"}
    (tmp_path / "m.json").write_text(json.dumps({"version": 1, "jobs": [job, job | {"input": "/nowhere", "output": str(tmp_path / "x.csv")}]}))
    out = cli.batch(spark, str(tmp_path / "m.json"))
    assert [j["ok"] for j in out["jobs"]] == [True, False]
    assert (tmp_path / "out.csv").read_text() == "name,total\n'=a,1\nb,2\n"
    assert cli.inspect(spark, job["input"])["summary"]["rows"] == 2


def test_panel(spark, data):
    orders = spark.read.parquet(f"{data}/orders.parquet")
    charts = explore.panel(orders, [explore.Filter("o_orderstatus", values=("F",))])
    assert charts["kpi"].first()["rows"] == orders.filter("o_orderstatus = 'F'").count()
    assert "bars:o_orderstatus" in charts and charts["bars:o_orderstatus"].count() == orders.select("o_orderstatus").distinct().count()
    gaps = spark.createDataFrame([("a",), (None,), (" ",)], "v string")
    assert explore.filtered(gaps, [explore.Filter("v", values=(None,))]).count() == 2
    assert explore.mirrors(orders.select("o_orderkey", (F.col("o_orderkey") + 1).alias("x")), "o_orderkey", "x")


def test_compare_keys_with_repeats(spark):
    """Matched keys are all that both sides have; repeated ones count in every place but conflicts."""
    a = spark.createDataFrame([(k, "x") for k in (1, 2, 3, 3, 4, 4)], "k long, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "k long, v string")
    row = joins.compare_keys(a, b, ["k"]).first().asDict()
    assert row == {"matched": 3, "conflicting": 1, "current_only": 1, "compared_only": 0, "duplicate_keys": 2, "duplicate_rows": 5}


def test_resolve_conflicts_checks_decisions(spark):
    a = spark.createDataFrame([(1, "x", "p"), (2, "y", "q"), (3, "z", "r"), (4, "w", "s")], "k long, v string, w string")
    b = spark.createDataFrame([(1, "X", "P"), (2, "Y", "q"), (3, "z", "r"), (4, "W", "s"), (4, "V", "s")], "k long, v string, w string")

    def resolved(*rows):
        return sorted(tuple(r) for r in joins.resolve_conflicts(a, b, ["k"], spark.createDataFrame(list(rows), "k long, column_name string, choice string")).collect())

    rest = [(3, "z", "r"), (4, "w", "s")]
    assert resolved((1, None, "compared"), (2, "v", "compared")) == [(1, "X", "P"), (2, "Y", "q"), *rest]
    assert resolved((1, "v", "compared"), (1, "w", "current"), (2, None, "exclude")) == [(1, "X", "p"), *rest]
    for wrong in ([(3, None, "compared")], [(4, None, "compared")], [(1, "k2", "compared")], [(1, None, "other")], [(1, "v", "compared")], [(1, None, "compared"), (1, None, "current")], [(1, None, "compared"), (1, "v", "current"), (1, "w", "current")], [(2, "v", "exclude"), (2, None, "current")]):
        with pytest.raises(ValueError, match="don't fit"):
            resolved(*wrong)


def test_conflict_page(spark):
    a = spark.createDataFrame([(k, "x", "y") for k in range(9)], "k long, v string, w string")
    b = spark.createDataFrame([(k, "X", "Y") for k in range(9)], "k long, v string, w string")
    assert [r["k"] for r in joins.conflict_page(a, b, ["k"], 3, 2).collect()] == [3, 3, 4, 4]


def test_near_duplicates_keep_exact_copies(spark):
    rows = [(0, "a  b", None), (1, "A b", None), (2, "a  b", None), (3, None, "x"), (4, None, "x"), (5, "", "x"), (6, "a", "bx"), (7, "ab", "x")]
    df = spark.createDataFrame(rows, "_rid long, s string, t string")
    assert sorted(r["_rid"] for r in cleaning.remove_near_duplicates(df).collect()) == [0, 2, 3, 4, 5, 6, 7]


def test_preview_says_what_is_applied(spark):
    from sievework.sources import samples

    df = samples.gaps(spark, 60)
    steps = {(r["step"], r["column_name"]): r["cells"] for r in cleaning.preview_safe_corrections(df).collect()}
    assert steps["sentinels", "segment"] == 5 and steps["rename", "full name"] == 1 and ("trim", "segment") not in steps
    assert any(s.startswith("cast to") and c == "since" for s, c in steps)


def test_leading_zeros_keep_numbers_and_not_dates(spark):
    """A code stays text, of eight digits too if one isn't a date; a column of which every value is a date is cast, whatever its days begin with."""
    df = spark.createDataFrame([("02/01/2024", "0012", "02012024"), ("15/01/2024", "12", "20240115")], "since string, code string, eight string")
    fixed = cleaning.safe_corrections(df)
    assert {c: t for c, t in fixed.dtypes if c != "_rid"} == {"since": "timestamp_ntz", "code": "string", "eight": "string"}
    assert sorted((r["since"].date().isoformat(), r["code"]) for r in fixed.collect()) == [("2024-01-02", "0012"), ("2024-01-15", "12")]
