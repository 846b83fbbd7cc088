"""Steps: a user's Python, run once a group or a batch, on declared columns, if its digest is trusted.

What a step returns is rows of a declared schema; each is named ``<step>#<key>``, and keys must be unique within a step.
Findings a step reports are rows too: severity, code, subject, message.
"""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINDINGS = "severity string, code string, subject string, message string"
SEVERITIES = ("error", "warning", "info")


def digest(function: Callable) -> str:
    """Of a step's source text, which trust is given to."""
    return hashlib.sha256(inspect.getsource(function).encode()).hexdigest()


class Untrusted(PermissionError):
    pass


@dataclass
class Step:
    """``function`` takes a frame of ``columns`` and returns one of ``schema``, which has a string column ``key``."""

    name: str
    function: Callable[[pd.DataFrame], pd.DataFrame]
    columns: list[str]
    schema: str
    trusted: set[str] = field(default_factory=set)

    def _checked(self) -> Callable[[pd.DataFrame], pd.DataFrame]:
        if digest(self.function) not in self.trusted:
            raise Untrusted(f"step.untrusted: {self.name}; trust {digest(self.function)}")
        return self.function

    def for_each(self, rows: DataFrame, by: list[str]) -> DataFrame:
        """One call a group. Only the declared columns leave the JVM."""
        function = self._checked()
        own = rows.select(*dict.fromkeys([*by, *self.columns]))
        return self._named(own.groupBy(*by).applyInPandas(lambda frame: function(frame), self.schema))

    def batch(self, rows: DataFrame) -> DataFrame:
        """A call a batch, for steps that look at one row at a time."""
        function = self._checked()
        return self._named(rows.select(*self.columns).mapInPandas(lambda frames: map(function, frames), self.schema))

    def _named(self, out: DataFrame) -> DataFrame:
        return out.withColumn("name", F.concat(F.lit(f"{self.name}#"), F.col("key")))


def clashes(returned: DataFrame) -> DataFrame:
    """Names that a step returned more than once."""
    return returned.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def findings(reported: DataFrame) -> DataFrame:
    """Each finding once, counted by severity, code and subject, errors first."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return reported.groupBy("severity", "code", "subject").agg(F.count("*").alias("n"), F.min("message").alias("message")).orderBy(rank, "code", "subject")
