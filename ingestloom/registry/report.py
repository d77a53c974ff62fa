"""Findings of a validation and how they are told."""

from __future__ import annotations

import enum
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession


class Level(str, enum.Enum):
    ERROR = "ERROR"
    WARN = "WARN"
    INFO = "INFO"


@dataclass(frozen=True)
class Issue:
    """One finding about a table, and a field of it if it is about one."""

    table: str
    level: Level
    code: str
    message: str
    field: str | None = None
    expected: str | None = None
    actual: str | None = None
    hint: str | None = None


ISSUE_SCHEMA = "table string, level string, code string, message string, field string, expected string, actual string, hint string"


@dataclass
class ValidationReport:
    """All findings of a run."""

    model_name: str = "MODEL"
    issues: list[Issue] = field(default_factory=list)

    def add(self, *issues: Issue) -> None:
        self.issues += issues

    @property
    def is_valid(self) -> bool:
        """Whether there are no findings at all, not even informative ones."""
        return not self.issues

    @property
    def exit_code(self) -> int:
        return int(any(i.level is Level.ERROR for i in self.issues))

    def counts(self) -> dict[str, int]:
        return {level.value: sum(i.level is level for i in self.issues) for level in Level}

    def summary(self) -> str:
        if self.is_valid:
            return f"{self.model_name}: no findings"
        return f"{self.model_name}: " + ", ".join(f"{n} {level}" for level, n in self.counts().items() if n)

    def text(self) -> str:
        """The summary, then the findings of each table in order of its name."""
        lines = [self.summary()]
        for table in sorted({i.table for i in self.issues}):
            lines.append(f"{table}:")
            for i in (i for i in self.issues if i.table == table):
                place = f" [{i.field}]" if i.field else ""
                lines.append(f"  {i.level.value} {i.code}{place}: {i.message}" + (f" (hint: {i.hint})" if i.hint else ""))
        return "\n".join(lines)

    def to_dict(self) -> dict:
        rows = [asdict(i) | {"level": i.level.value} for i in self.issues]
        return {"model": self.model_name, "valid": self.is_valid, "summary": self.counts(), "issues": rows}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2)

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple((asdict(i) | {"level": i.level.value}).values()) for i in self.issues], ISSUE_SCHEMA)
