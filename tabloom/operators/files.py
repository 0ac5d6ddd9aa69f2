"""Files: equal contents, line ends, and new names.

Tables of files have path, length and content, as Spark's binaryFile source gives them.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions import text


def duplicates(files: DataFrame, least: int = 1) -> DataFrame:
    """(size, sha256, paths, reclaimable) of equal files of at least ``least`` bytes, largest first.

    Only files whose size is there twice are read; sizes come from the listing alone.
    """
    sizes = files.where(F.col("length") >= least).groupBy("length").count().where("count > 1").select("length")
    hashed = files.where(F.col("length") >= least).join(sizes, "length", "left_semi").select("path", "length", F.sha2("content", 256).alias("sha256"))
    groups = hashed.groupBy(F.col("length").alias("size"), "sha256").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return groups.where(F.size("paths") > 1).withColumn("reclaimable", F.col("size") * (F.size("paths") - 1)).orderBy(F.desc("size"), "paths")


SNIFF = 8192


def line_ends(files: DataFrame) -> DataFrame:
    """(path, binary, crlf, lf, cr, bom, style): counts of line ends; style is none, lf, crlf, cr or mixed. Binary files, with a NUL in the first 8 kB, are not counted."""
    latin = F.decode(F.col("content"), "ISO-8859-1")
    binary = F.instr(F.decode(F.substring("content", 1, SNIFF), "ISO-8859-1"), "\0") > 0
    rows = files.select("path", binary.alias("binary"), F.regexp_count(latin, F.lit("\r\n")).alias("crlf"), F.regexp_count(latin, F.lit("(?<!\r)\n")).alias("lf"), F.regexp_count(latin, F.lit("\r(?!\n)")).alias("cr"), (F.hex(F.substring("content", 1, 3)) == "EFBBBF").alias("bom"))
    kinds = F.array_compact(F.array(*[F.when(F.col(k) > 0, F.lit(k)) for k in ("crlf", "lf", "cr")]))
    style = F.when(F.size(kinds) > 1, "mixed").when(F.size(kinds) == 1, kinds[0]).otherwise("none")
    counts = [F.when(~F.col("binary"), F.col(k)).cast("long").alias(k) for k in ("crlf", "lf", "cr")]
    return rows.select("path", "binary", *counts, "bom", F.when(~F.col("binary"), style).alias("style"))


def with_line_ends(files: DataFrame, style: str = "lf", strip_bom: bool = False) -> DataFrame:
    """(path, content, changed): all line ends as one style; binary files as they are."""
    to = {"lf": "\n", "crlf": "\r\n", "cr": "\r"}[style]
    latin = F.decode(F.col("content"), "ISO-8859-1")
    new = F.regexp_replace(F.regexp_replace(latin, "\r\n|\r", "\n"), "\n", to) if style != "lf" else F.regexp_replace(latin, "\r\n|\r", "\n")
    new = F.regexp_replace(new, "\\A\u00ef\u00bb\u00bf", "") if strip_bom else new
    binary = F.instr(F.decode(F.substring("content", 1, SNIFF), "ISO-8859-1"), "\0") > 0
    content = F.when(binary, F.col("content")).otherwise(F.encode(new, "ISO-8859-1"))
    return files.select("path", content.alias("content"), (content != F.col("content")).alias("changed"))


def rename_plan(files: DataFrame, pattern: str, replacement: str, ignore_case: bool = False, exact_case: bool = True) -> DataFrame:
    """(folder, old, new, problem) of files (folder, name) whose name the replacement changes.

    A problem is a name that is not valid, that two files would get (but for case), or
    that a file has which is not renamed itself.
    """
    fold = lambda c: text.folded(c, exact_case)
    plan = files.select("folder", F.col("name").alias("old"), text.replaced(F.col("name"), pattern, replacement, ignore_case=ignore_case).alias("new")).where("old <> new")
    plan = plan.withColumn("__to", fold(F.col("new")))
    twice = plan.groupBy("folder", "__to").count().where("count > 1").select("folder", "__to", F.lit(True).alias("__twice"))
    stay = files.select("folder", F.col("name").alias("old")).join(plan.select("folder", "old"), ["folder", "old"], "left_anti")
    stay = stay.select("folder", fold(F.col("old")).alias("__to"), F.lit(True).alias("__taken")).distinct()
    out = plan.join(twice, ["folder", "__to"], "left").join(stay, ["folder", "__to"], "left")
    problem = F.coalesce(text.name_problem(F.col("new")), F.when(F.col("__twice"), "more than one file would get this name"), F.when(F.col("__taken"), "exists already"))
    return out.select("folder", "old", "new", problem.alias("problem")).orderBy("folder", "old")


class RenameProblem(ValueError):
    """A plan that cannot be carried out."""


def apply_renames(plan: Sequence[tuple[str, str, str]]) -> int:
    """Rename files (folder, old, new) on the driver's file system, over temporary names so that names can be swapped."""
    steps = []
    for i, (folder, old, new) in enumerate(plan):
        source = Path(folder, old)
        if not source.exists():
            raise RenameProblem(f"{source} is not there")
        steps.append((source, Path(folder, f".{os.getpid()}-{i}.tmp"), Path(folder, new)))
    for source, between, _ in steps:
        source.rename(between)
    for _, between, target in steps:
        between.rename(target)
    return len(steps)


def apply_contents(changed: DataFrame) -> int:
    """Write the content of files that changed, one at a time, to the driver's file system."""
    n = 0
    for row in changed.where("changed").select("path", "content").toLocalIterator():
        path = Path(row["path"].removeprefix("file:"))
        between = path.with_name(path.name + ".tmp")
        between.write_bytes(bytes(row["content"]))
        between.replace(path)
        n += 1
    return n
