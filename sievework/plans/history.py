"""Undo and redo over revisions of a dataset: immutable plans, written to Parquet where a folder is given."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..operators.joins import schema_diff
from ..operators.profile import column_profile

MAX_REVISIONS = 12


class History:
    def __init__(self, df: DataFrame, label: str = "loaded", folder: str | None = None, limit: int = MAX_REVISIONS):
        self.folder, self.limit = folder, limit
        self.revisions: list[tuple[str, DataFrame]] = []
        self.cursor = -1
        self.record(label, df)

    def record(self, label: str, df: DataFrame) -> DataFrame:
        """A new revision after the present one; undone ones and, beyond the limit, the oldest are forgotten."""
        if self.folder:
            path = f"{self.folder}/{uuid.uuid4().hex}"
            df.write.parquet(path)
            df = df.sparkSession.read.schema(df.schema).parquet(path)
        self.revisions = [*self.revisions[: self.cursor + 1], (label, df)][-self.limit :]
        self.cursor = len(self.revisions) - 1
        return df

    @property
    def current(self) -> DataFrame:
        return self.revisions[self.cursor][1]

    def undo(self) -> DataFrame:
        if not self.cursor:
            raise IndexError("nothing to undo")
        self.cursor -= 1
        return self.current

    def redo(self) -> DataFrame:
        if self.cursor == len(self.revisions) - 1:
            raise IndexError("nothing to redo")
        self.cursor += 1
        return self.current

    def state(self) -> dict:
        return {"labels": [label for label, _ in self.revisions], "cursor": self.cursor, "can_undo": self.cursor > 0, "can_redo": self.cursor < len(self.revisions) - 1}

    def compare(self, a: int, b: int) -> dict:
        """Schema difference and, for shared columns, both profiles' counts."""
        x, y = self.revisions[a][1], self.revisions[b][1]
        left, right = ({r["column_name"]: r for r in column_profile(d).collect()} for d in (x, y))
        shared = [c for c in left if c in right]
        keys = ("row_count", "null_count", "unique_count", "mean")
        return {"schema": schema_diff(x, y), "columns": {c: {k: (left[c][k], right[c][k]) for k in keys} for c in shared}}
