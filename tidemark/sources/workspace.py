"""Workspaces: the files, query and range of lines of an analysis, saved as JSON and opened again as one frame."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import opened
from .lines import open_log


@dataclass
class Workspace:
    """``files`` are paths, each with its encoding or null; an empty query shows all lines."""

    files: dict[str, str | None] = field(default_factory=dict)
    query: str = ""
    regex: bool = False
    sensitive: bool = False
    first: int | None = None
    last: int | None = None

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, ensure_ascii=False, indent=2)

    @classmethod
    def load(cls, path: str) -> Workspace:
        """ValueError if the file is no workspace; unknown entries are ignored."""
        with opened(path) as f:
            data = json.loads(f.read())
        if not isinstance(data, dict) or not isinstance(data.get("files"), dict):
            raise ValueError(f"no workspace: {path}")
        return cls(**{k: v for k, v in data.items() if k in cls.__dataclass_fields__})

    def lines(self, spark: SparkSession) -> DataFrame:
        """The lines in the range that match the query, of all files."""
        from ..operators import search

        out = None
        for encoding in dict.fromkeys(self.files.values()):
            some = open_log(spark, [p for p, e in self.files.items() if e == encoding], encoding)
            out = some if out is None else out.unionByName(some)
        if out is None:
            return spark.createDataFrame([], "file string, line long, byte long, text string")
        out = search.scoped(out, self.first, self.last)
        return out.where(search.condition(F.col("text"), self.query, self.regex, self.sensitive)) if self.query else out
