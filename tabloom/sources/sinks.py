"""Sinks: tables as files, one or many, with guards."""

from __future__ import annotations

import csv
import itertools
import os
from collections.abc import Iterable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions import text
from tabloom.operators import chunks
from tabloom.plans import specs
from tabloom.plans.names import col
from tabloom.plans.ordered import ORDINAL


class SinkProblem(ValueError):
    """An output that must not be written."""


def guarded(path: str, inputs: Iterable[str] = (), force: bool = False) -> Path:
    """The path, if it is no input and, unless forced, not there yet."""
    target = Path(path)
    if any(os.path.realpath(path) == os.path.realpath(i) for i in inputs):
        raise SinkProblem(f"{path} is an input")
    if target.exists() and not force:
        raise SinkProblem(f"{path} exists; use force to overwrite it")
    return target


def _own(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


def one_csv(df: DataFrame, path: str, delimiter: str = ",", line_end: str = "\n", bom: bool = False, encoding: str = "utf-8", inputs: Iterable[str] = (), force: bool = False) -> int:
    """One file on the driver, in _ord's order if there is one; rows stream through, they are not held.  Returns their number."""
    target = guarded(path, inputs, force)
    rows = df.orderBy(ORDINAL) if ORDINAL in df.columns else df
    own = _own(df)
    between = target.with_name(target.name + ".tmp")
    n = 0
    with between.open("w", encoding="utf-8-sig" if bom else encoding, newline="") as file:
        out = csv.writer(file, delimiter=specs.delimiter(delimiter), lineterminator=line_end)
        out.writerow(own)
        for row in rows.select(*[text.cell(col(c)) for c in own]).toLocalIterator(prefetchPartitions=True):
            out.writerow(row)
            n += 1
    between.replace(target)
    return n


def csv_folder(df: DataFrame, path: str, delimiter: str = ",", force: bool = False, by: Sequence[str] = ()) -> None:
    """A folder of files, written by all tasks; with ``by`` a folder for each value."""
    out = df.select(*[col(c) for c in _own(df)]).write.mode("overwrite" if force else "errorifexists").options(header=True, sep=specs.delimiter(delimiter), quote='"', escape='"', emptyValue="", nullValue="")
    (out.partitionBy(*by) if by else out).csv(path)


def json_lines(rows: DataFrame, path: str, force: bool = False) -> None:
    """A folder of JSON Lines files of a table with the column value, as :func:`tabloom.operators.records.as_json` makes it."""
    rows.select("value").write.mode("overwrite" if force else "errorifexists").text(path)


def one_json(rows: DataFrame, path: str, lines: bool = False, inputs: Iterable[str] = (), force: bool = False) -> int:
    """One file on the driver: a list of objects, or one a line."""
    target = guarded(path, inputs, force)
    n = 0
    with target.open("w", encoding="utf-8") as file:
        for row in rows.select("value").toLocalIterator():
            file.write(row[0] + "\n" if lines else (",\n" if n else "[\n") + "  " + row[0])
            n += 1
        if not lines:
            file.write("\n]\n" if n else "[]\n")
    return n


def split_by_rows(df: DataFrame, folder: str, stem: str, rows: int, force: bool = False) -> list[str]:
    """Files stem_001.csv, stem_002.csv ... of so many rows each."""
    parts = chunks.by_rows(df, rows, "__part")
    numbers = [r[0] for r in parts.select("__part").distinct().orderBy("__part").collect()]
    width = max(3, len(str(len(numbers))))
    return _split(parts, folder, {n: f"{stem}_{n:0{width}d}.csv" for n in numbers}, df.columns, force)


def split_by_value(df: DataFrame, folder: str, stem: str, column: str, force: bool = False) -> list[str]:
    """A file for each value of the column, named stem_value.csv."""
    parts = chunks.by_value(df, column, "__part")
    values = [r[0] for r in parts.select("__part").distinct().orderBy("__part").collect()]
    return _split(parts, folder, {v: f"{stem}_{v}.csv" for v in values}, df.columns, force)


def _split(parts: DataFrame, folder: str, names: dict, columns: Sequence[str], force: bool) -> list[str]:
    """One pass: rows come sorted by their part, and the file changes with it."""
    targets = {v: guarded(str(Path(folder, n)), (), force) for v, n in names.items()}
    Path(folder).mkdir(parents=True, exist_ok=True)
    own = [c for c in columns if not c.startswith("_")]
    order = [ORDINAL] if ORDINAL in columns else []
    rows = parts.orderBy("__part", *order).select(*[text.cell(col(c)) for c in own], "__part").toLocalIterator(prefetchPartitions=True)
    for value, part in itertools.groupby(rows, lambda r: r["__part"]):
        between = targets[value].with_name(targets[value].name + ".tmp")
        with between.open("w", encoding="utf-8", newline="") as file:
            out = csv.writer(file, lineterminator="\n")
            out.writerow(own)
            out.writerows(r[:-1] for r in part)
        between.replace(targets[value])
    return [str(t) for t in targets.values()]
