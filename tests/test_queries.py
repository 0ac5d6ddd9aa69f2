"""All registered table queries against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import difference

import tabloom.source_queries  # noqa: F401  (registers its queries)
from tabloom.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE_SQL])
def test_against_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), SF, ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_sort_gives_all_rows(spark):
    """Every customer has a place, the blank ones the last."""
    rows = sorted(QUERIES["sort_text_numbers_all"](spark, SF).collect(), key=lambda r: r["place"])
    assert [r["place"] for r in rows] == list(range(1, spark.read.parquet(f"{SF}/customer.parquet").count() + 1))
    blank = [not r["b"].strip() for r in rows]
    assert any(blank) and blank == sorted(blank)


def test_line_ends_of_all_pages(spark, tmp_path):
    pages = [(1, "a\r\nb\r\n"), (2, "a\nb"), (3, "a\rb\r"), (4, "a\r\nb\nc\r\rd"), (5, "none"), (6, "")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = QUERIES["line_ends_all"](spark, str(tmp_path))
    assert {r["page_id"]: (r["crlf"], r["lf"], r["cr"], r["style"]) for r in rows.collect()} == {
        1: (2, 0, 0, "crlf"), 2: (0, 1, 0, "lf"), 3: (0, 0, 2, "cr"), 4: (1, 1, 2, "mixed"), 5: (0, 0, 0, "none"), 6: (0, 0, 0, "none"),
    }
    assert difference(rows, str(tmp_path), ORACLE_SQL["line_ends_all"]) == ""


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 6
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["rounding", "round_modes"])
def test_long_work_on_rows_is_dealt_to_all_cores(spark, name):
    """The tables have one row group, so that their scan is one task with rows."""
    sizes = QUERIES[name](spark, SF).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    cores = spark.sparkContext.defaultParallelism
    assert len(sizes) >= cores and max(sizes) <= 2 * sum(sizes) / len(sizes) + 10
