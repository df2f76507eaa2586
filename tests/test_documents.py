import zipfile

import pytest

from sievework.operators.quality import ContractError, evaluate
from sievework.operators.recipe import Recipe
from sievework.plans.documents import migrate_contract, recipe_drift
from sievework.sources import samples, sinks


def test_migration(spark):
    contract, report = migrate_contract({"schema_version": "2", "rules": [{"type": "Range", "column": "units", "min": 0, "max_invalid": 2}, {"kind": "odd"}]})
    assert [r["taken"] for r in report] == [True, False] and contract.rules[0]["kind"] == "numeric_range" and contract.rules[0]["maxInvalid"] == 2
    assert evaluate(samples.series(spark), contract).first()["passed"]
    with pytest.raises(ContractError):
        migrate_contract({"version": 9, "rules": []})


def test_drift(spark):
    text = Recipe.from_dict({"keepColumns": ["day"]}).to_json(schema={"day": "string", "gone": "string"})
    assert recipe_drift(text, samples.series(spark)) == {"missing": ["gone"], "changed": ["day"], "additional": ["region", "units", "revenue"]}


def test_bulk(spark, tmp_path):
    path = str(tmp_path / "b.zip")
    sinks.write_bulk(samples.gaps(spark, 20), path)
    z = zipfile.ZipFile(path)
    assert z.read("data.csv").decode().startswith("customer_id,full name,segment") and len(z.read("data.csv").splitlines()) == 21
    assert "BULK INSERT [dataset] FROM N'C:" in z.read("load.sql").decode()
