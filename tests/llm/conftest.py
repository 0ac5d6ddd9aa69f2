"""Small inputs of all kinds: real rows, edge cases, clashing extra columns."""

from __future__ import annotations

import pytest
from llm_rows import rows_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHES = ("d", "th", "row", "key", "h1", "count", "a", "b", "start", "n", "runs", "text_", "pos", "level")


@pytest.fixture(scope="session")
def documents() -> list[tuple]:
    """(doc_id, text) of the smallest table and edge cases: null, empty, blank, repeated rows, ties of ids, a null id, a very long text."""
    rows = [(r[0], r[1]) for r in rows_of("documents")]
    long = " ".join(r[1] for r in rows[:40] if r[1]) + "\n" + " ".join(f"w{i % 977}" for i in range(40_000))
    some = next(t for _, t in rows if len(t.split()) > 120)
    edge = [(900001, None), (900002, ""), (900003, " \n\t\n "), (900004, long), (900005, some), (900005, some), (900006, "été " * 200), (900006, "other words " * 60), (None, some), (None, None), (900007, "one"), (900008, "  x\u0085y"), (900009, some[: len(some) // 2])]
    return rows + edge


@pytest.fixture(scope="session")
def docs(spark, documents):
    """The same as a table with extra columns whose names clash with inner ones."""
    extra = ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(i, t, *("x" * len(CLASHES))) for i, t in documents], f"doc_id long, text string, {extra}").repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
