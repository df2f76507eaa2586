"""python -m sievework.cli inspect | transform | validate | batch. See --help."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .functions.order import with_rid
from .operators.profile import column_profile, dataset_summary
from .operators.quality import Contract, evaluate
from .operators.recipe import Recipe
from .sources import sinks
from .sources.delimited import read_delimited
from .sources.files import read_json, read_parquet, read_workbook

MAX_JOBS = 64
WRITERS = {
    "csv": sinks.write_csv, "csv-excel": lambda d, p: sinks.write_csv(d, p, excel=True), "csv-parts": sinks.write_csv_parts, "json": sinks.write_json, "parquet": sinks.write_parquet,
    "sql": sinks.write_sql, "tsql": sinks.write_tsql, "sqlite": sinks.write_sqlite, "xlsx": sinks.write_workbook, "bulk": sinks.write_bulk, "bundle": sinks.write_bundle,
}


def load(spark: SparkSession, path: str) -> DataFrame:
    end = path.rsplit(".", 1)[-1].lower()
    if end in ("json", "jsonl", "ndjson"):
        return read_json(spark, path)
    if end == "parquet":
        return read_parquet(spark, path)
    if end in ("xlsx", "xls", "xlsb", "ods"):
        return read_workbook(spark, path)
    return read_delimited(spark, path)


def inspect(spark: SparkSession, path: str) -> dict:
    df = load(spark, path)
    return {"summary": dataset_summary(df).first().asDict(), "columns": [r.asDict() for r in column_profile(df).collect()]}


def transform(spark: SparkSession, source: str, recipe: str, target: str, kind: str, privacy: str = "none", rules: list[dict] | None = None) -> dict:
    with open(recipe, encoding="utf-8") as f:
        steps = Recipe.from_json(f.read())
    df = steps.apply_ordered(with_rid(load(spark, source)))
    df = sinks.with_privacy(sinks.gated(df, rules), privacy)
    WRITERS[kind](df, target)
    return {"input": source, "output": target, "columns": df.drop("_rid").columns}


def validate(spark: SparkSession, source: str, contract: str) -> dict:
    with open(contract, encoding="utf-8") as f:
        found = [r.asDict() for r in evaluate(with_rid(load(spark, source)), Contract.from_json(f.read())).collect()]
    return {"passed": all(r["passed"] for r in found), "rules": found}


def batch(spark: SparkSession, manifest: str) -> dict:
    """1 to 64 jobs: all recipes and formats are looked at before the first runs; a job that fails doesn't stop the others."""
    with open(manifest, encoding="utf-8") as f:
        data = json.load(f)
    jobs = data["jobs"]
    if data.get("version") != 1 or not 1 <= len(jobs) <= MAX_JOBS:
        raise ValueError("a manifest of version 1 has 1 to 64 jobs")
    for j in jobs:
        if j["format"] not in WRITERS:
            raise ValueError(f"no format {j['format']!r}")
        with open(j["recipe"], encoding="utf-8") as f:
            Recipe.from_json(f.read())
    out = []
    for j in jobs:
        try:
            out.append(transform(spark, j["input"], j["recipe"], j["output"], j["format"]) | {"ok": True})
        except Exception as e:  # reported for the job
            out.append({"input": j["input"], "ok": False, "error": str(e)[:500]})
    return {"passed": all(j["ok"] for j in out), "jobs": out}


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sievework")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("inspect").add_argument("input")
    t = sub.add_parser("transform")
    for name in ("input", "recipe", "output"):
        t.add_argument(name)
    t.add_argument("--format", default="csv", choices=sorted(WRITERS))
    t.add_argument("--privacy", default="none", choices=["none", "mask", "hash"])
    v = sub.add_parser("validate")
    v.add_argument("input")
    v.add_argument("contract")
    sub.add_parser("batch").add_argument("manifest")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("sievework").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "inspect":
        out = inspect(spark, a.input)
    elif a.command == "transform":
        out = transform(spark, a.input, a.recipe, a.output, a.format, a.privacy)
    elif a.command == "validate":
        out = validate(spark, a.input, a.contract)
    else:
        out = batch(spark, a.manifest)
    print(json.dumps(out, default=str, ensure_ascii=False))
    return 0 if out.get("passed", True) else 1


if __name__ == "__main__":
    sys.exit(main())
