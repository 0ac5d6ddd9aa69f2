"""What an operator gives besides its table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Refused(ValueError):
    """A strict operator found problems; nothing is written."""


@dataclass
class Result:
    """A table, the problems found on the way (line or order columns, column, message), counters that are queries of their own, and where there is one a row of all of them."""

    df: DataFrame
    problems: DataFrame | None = None
    counters: dict[str, DataFrame] = field(default_factory=dict)
    tally: DataFrame | None = None

    def count(self, name: str) -> int:
        return int(self.counters[name].first()[0] or 0)

    def strict(self) -> DataFrame:
        """The table, if there are no problems."""
        if self.problems is not None and (first := self.problems.first()) is not None:
            raise Refused(f"{self.problems.count()} problem(s); first: {first.asDict()}")
        return self.df


def counted(df: DataFrame, what: Column) -> DataFrame:
    """A query of one row: how many rows are so."""
    return df.agg(F.count_if(what).alias("n"))
