"""Recipe and contract documents beyond their own parsing: drift of a recipe's source, and older spellings of contracts."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame

from ..operators.quality import KINDS, Contract, ContractError

#: Older names of rules.
ALIASES = {
    "range": "numeric_range", "column_comparison": "column_compare", "referential": "referential_integrity", "aggregate": "aggregate_check", "aggregate_reconcile": "aggregate_reconciliation",
    "reconciliation": "aggregate_reconciliation", "drift": "distribution_drift", "schema": "schema_contract",
}
VERSIONS = (1, 2)


def recipe_drift(text: str, df: DataFrame) -> dict[str, list[str]]:
    """What a recipe of version 2 expects of its source and the data don't have."""
    wanted = json.loads(text).get("sourceSchema") or {}
    have = dict(df.dtypes)
    return {"missing": [c for c in wanted if c not in have], "changed": [c for c in wanted if c in have and have[c] != wanted[c]], "additional": [c for c in have if wanted and c not in wanted]}


def migrate_contract(data: Any) -> tuple[Contract, list[dict]]:
    """A contract from a list of rules or an object with rules, in present or older spelling, and a report with a line for each rule: its place, the kind as written, the kind meant, and whether it could be taken."""
    if isinstance(data, str):
        data = json.loads(data)
    if isinstance(data, dict):
        version = data.get("version", data.get("schema_version", 1))
        if int(version) not in VERSIONS:
            raise ContractError(f"unknown version {version!r}")
        data = data.get("rules")
    if not isinstance(data, list):
        raise ContractError("a contract is a list of rules or an object with one")
    rules, report = [], []
    for i, rule in enumerate(data):
        written = str(rule.get("kind", rule.get("type", ""))).strip().lower()
        kind = ALIASES.get(written, written)
        taken = kind in KINDS
        report.append({"rule": i, "written": written, "kind": kind if taken else None, "taken": taken})
        if taken:
            out = {k: v for k, v in rule.items() if k not in ("kind", "type")} | {"kind": kind}
            for old, new in (("max_invalid", "maxInvalid"), ("max_invalid_pct", "maxInvalidPct")):
                if old in out:
                    out[new] = out.pop(old)
            rules.append(out)
    return Contract(rules), report
