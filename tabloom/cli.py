"""Commands for single files: ``python -m tabloom COMMAND ...``; a command is a thin layer over an operator.

Exit codes: 0 done; 1 a file is missing, a strict run found problems, or a check or
comparison found something; 2 the command, a column or a specification is wrong.
"""

from __future__ import annotations

import argparse
import csv
import json
import os
import sys
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import text
from tabloom.operators import aggregates, cells, checks, dedup, files, fill, filters, joins, lines, projection, records, reshape, sampling, sorting
from tabloom.plans import render, specs
from tabloom.plans.names import col
from tabloom.plans.ordered import ORDINAL
from tabloom.plans.result import Refused, Result
from tabloom.session import session
from tabloom.sources import delimited, sinks

COMMANDS: dict[str, tuple[Callable, Callable]] = {}


def command(name: str, *arguments: tuple) -> Callable:
    """Register a command; an argument is (names..., settings of argparse)."""

    def add(run: Callable) -> Callable:
        def declare(parser: argparse.ArgumentParser) -> None:
            for *flags, settings in arguments:
                parser.add_argument(*flags, **settings)

        COMMANDS[name] = declare, run
        return run

    return add


FLAG = {"action": "store_true"}
MANY = {"action": "append", "default": []}
FILE, FILES = ("file", {}), ("files", {"nargs": "+"})
IGNORE = ("-i", "--ignore-case", FLAG)
STRICT = ("--strict", FLAG)


class Run:
    """A command's session, inputs and output."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace):
        self.spark, self.args = spark, args

    def path(self, name: str) -> str:
        """A file's path; standard input is kept in a temporary file of this machine, where the session runs too."""
        if name == "-":
            with tempfile.NamedTemporaryFile("wb", suffix=".txt", delete=False) as file:
                file.write(sys.stdin.buffer.read())
            return file.name
        if not Path(name).exists():
            raise FileNotFoundError(f"{name} is not there")
        return os.path.abspath(name)

    def table(self, name: str | None = None, lines: bool = False) -> DataFrame:
        ragged = delimited.read_ragged(self.spark, self.path(name or self.args.file), self.args.delimiter, self.args.encoding)
        return delimited.tabular(ragged, lines=lines)

    def texts(self, names: list[str]) -> DataFrame:
        return delimited.read_text(self.spark, [self.path(n) for n in names], self.args.encoding)

    def lines(self, names: list[str]) -> DataFrame:
        return delimited.read_lines(self.spark, [self.path(n) for n in names], self.args.encoding)

    def write(self, df: DataFrame, inputs: list[str] = ()) -> int:
        if self.args.output:
            sinks.one_csv(df, self.args.output, line_end="\r\n" if getattr(self.args, "crlf", False) else "\n", bom=getattr(self.args, "bom", False), inputs=list(inputs) or [getattr(self.args, "file", "")], force=self.args.force)
            return 0
        own = [c for c in df.columns if not c.startswith("_")]
        rows = df.orderBy(ORDINAL) if ORDINAL in df.columns else df
        out = csv.writer(sys.stdout, lineterminator="\n")
        out.writerow(own)
        for row in rows.select(*[text.cell(col(c)) for c in own]).toLocalIterator():
            out.writerow(row)
        return 0

    def result(self, found: Result) -> int:
        """Write a result; its problems go to standard error, and with --strict nothing is written."""
        bad = found.problems.limit(20).collect() if found.problems is not None else []
        for row in bad:
            print(" ".join(f"{k.strip('_')} {v!r}" for k, v in row.asDict().items()), file=sys.stderr)
        if bad and getattr(self.args, "strict", False):
            return 1
        return self.write(found.df)


@command("cut", FILE, ("-c", "--columns", {}), ("-x", "--drop", {}), ("-r", "--rename", MANY))
def _cut(run: Run) -> int:
    a, df = run.args, run.table()
    keep = f"{ORDINAL},{a.columns}" if a.columns else None
    return run.write(projection.cut(df, keep, a.drop, a.rename))


@command("filter", FILE, ("-w", "--where", MANY | {"required": True}), ("--any", FLAG), IGNORE, ("--count", FLAG))
def _filter(run: Run) -> int:
    a = run.args
    found = filters.where(run.table(), a.where, a.any, a.ignore_case)
    return print(found.count()) or 0 if a.count else run.write(found)


@command("sort", FILE, ("-k", "--key", MANY | {"required": True}), ("-r", "--reverse", FLAG))
def _sort(run: Run) -> int:
    return run.write(sorting.sort(run.table(), run.args.key, reverse=run.args.reverse).drop(ORDINAL))


@command("join", ("file", {}), ("right", {}), ("-k", "--key", {"required": True}), ("--right-key", {}), ("--how", {"choices": ["inner", "left"], "default": "inner"}), IGNORE)
def _join(run: Run) -> int:
    a = run.args
    found = joins.join(run.table(), run.table(a.right).withColumnRenamed(ORDINAL, "_right"), a.key, a.right_key, a.how, a.ignore_case, order=[ORDINAL], right_order=["_right"])
    print(f"{found.count('unmatched')} row(s) without a partner", file=sys.stderr)
    return run.write(found.df.drop(ORDINAL), [a.file, a.right])


@command("diff", ("file", {}), ("new", {}), ("-k", "--key", {"required": True}))
def _diff(run: Run) -> int:
    old, new = run.table(), run.table(run.args.new)
    found, (added, removed) = joins.diff(old, new, run.args.key), joins.column_changes(old, new)
    differs = False
    for line in render.diff_report(found.df, added, removed):
        differs = True
        print(line)
    if not differs:
        print("no differences")
    print(", ".join(f"{name} {n}" for name, n in found.tally.first().asDict().items()))
    return int(differs)


@command("stack", FILES, ("--union", FLAG), ("--source", {}))
def _stack(run: Run) -> int:
    a = run.args
    tables = [(Path(f).name, run.table(f).withColumn("_file", F.lit(i))) for i, f in enumerate(a.files)]
    return run.write(projection.stack(tables, a.union, a.source).orderBy("_file", ORDINAL).drop(ORDINAL), a.files)


@command("group", FILE, ("-k", "--key", {"required": True}), ("-a", "--agg", MANY), ("-p", "--precision", {"type": int, "default": 2}))
def _group(run: Run) -> int:
    return run.write(aggregates.group(run.table(), run.args.key, run.args.agg or ["count"], run.args.precision))


@command("freq", FILE, ("-c", "--columns", {"required": True}), IGNORE, ("--no-blank", FLAG), ("-n", "--top", {"type": int}), ("--by-value", FLAG))
def _freq(run: Run) -> int:
    a = run.args
    return run.write(aggregates.freq(run.table(), a.columns, a.ignore_case, not a.no_blank, a.top, a.by_value))


@command("profile", FILE, ("-c", "--columns", {}), ("--decimal-comma", FLAG))
def _profile(run: Run) -> int:
    a = run.args
    return run.write(aggregates.profile(run.table(), a.columns.split(",") if a.columns else None, a.decimal_comma).drop("position"))


@command("unique", FILE, ("-k", "--key", {}), ("--keep", {"choices": ["first", "last"], "default": "first"}), IGNORE, ("--dupes", FLAG), ("--count", {}))
def _unique(run: Run) -> int:
    a, df = run.args, run.table()
    own = a.key or [c for c in df.columns if c != ORDINAL]
    return run.write(dedup.repeated(df, own, a.ignore_case, count=a.count) if a.dupes else dedup.unique(df, own, a.keep, a.ignore_case, a.count))


@command("fill", FILE, ("-c", "--columns", {}), ("--within", {}), ("--up", FLAG), ("--value", {}))
def _fill(run: Run) -> int:
    a = run.args
    return run.result(fill.fill(run.table(), a.columns, a.within, a.up, a.value))


@command("melt", FILE, ("--id", {"required": True}), ("--value", {}), ("--var-name", {"default": "variable"}), ("--value-name", {"default": "value"}), ("--skip-blank", FLAG))
def _melt(run: Run) -> int:
    a = run.args
    return run.write(reshape.melt(run.table(), a.id, a.value, a.var_name, a.value_name, a.skip_blank))


@command("pivot", FILE, ("-c", "--column", {"required": True}), ("-v", "--value", {"required": True}), ("--id", {}), ("--fill", {"default": ""}), ("--keep", {"choices": ["first", "last"]}))
def _pivot(run: Run) -> int:
    a = run.args
    return run.write(reshape.pivot(run.table(), a.column, a.value, a.id, a.fill, a.keep))


@command("transpose", FILE, ("--keep-trailing", FLAG), ("--max-cells", {"type": int, "default": 5_000_000}))
def _transpose(run: Run) -> int:
    rows = delimited.read_ragged(run.spark, run.path(run.args.file), run.args.delimiter, run.args.encoding)
    out = csv.writer(sys.stdout, lineterminator="\n")
    out.writerows(r["cells"] for r in reshape.transpose_cells(rows.select(ORDINAL, "cells"), run.args.keep_trailing, run.args.max_cells).toLocalIterator())
    return 0


@command("sample", FILE, ("-n", {"type": int}), ("--fraction", {"type": float}), ("--seed", {"type": int, "default": 0}), ("--shuffle", FLAG))
def _sample(run: Run) -> int:
    a = run.args
    found = sampling.sample(run.table(), a.n, a.fraction, a.seed, a.shuffle)
    return run.write(found.drop(ORDINAL) if a.shuffle else found)


@command("split", FILE, ("--folder", {"default": "."}), ("--rows", {"type": int}), ("--by", {}))
def _split(run: Run) -> int:
    a, stem = run.args, Path(run.args.file).stem
    if (a.rows is None) == (a.by is None):
        raise specs.SpecProblem("give --rows or --by")
    print(*(sinks.split_by_rows(run.table(), a.folder, stem, a.rows, a.force) if a.rows else sinks.split_by_value(run.table(), a.folder, stem, a.by, a.force)), sep="\n")
    return 0


@command("clean", FILE, ("--dedupe", FLAG))
def _clean(run: Run) -> int:
    return run.write(projection.clean(run.table(), run.args.dedupe))


@command("mask", FILE, ("-c", "--column", MANY | {"required": True}), ("--salt", {"default": ""}), ("--keep", {"type": int, "default": 4}), IGNORE)
def _mask(run: Run) -> int:
    a = run.args
    return run.write(cells.masked(run.table(), a.column, a.salt, a.keep, a.ignore_case))


@command("replace", FILE, ("pattern", {}), ("replacement", {}), ("-c", "--columns", {}), ("--literal", FLAG), ("--whole", FLAG), IGNORE)
def _replace(run: Run) -> int:
    a = run.args
    return run.result(cells.replaced(run.table(), a.pattern, a.replacement, a.columns, a.literal, a.ignore_case, a.whole))


@command("numbers", FILE, ("-c", "--columns", {"required": True}), ("--decimal", {"choices": ["auto", "dot", "comma"], "default": "auto"}), STRICT)
def _numbers(run: Run) -> int:
    return run.result(cells.numbers_of(run.table(lines=True), run.args.columns, run.args.decimal))


@command("round", FILE, ("-c", "--columns", {"required": True}), ("-p", "--places", {"type": int, "default": 2}), ("--mode", {"default": "half-up"}), STRICT)
def _round(run: Run) -> int:
    return run.result(cells.rounded(run.table(lines=True), run.args.columns, run.args.places, run.args.mode))


@command("bin", FILE, ("-c", "--column", {"required": True}), ("-e", "--edges", {"required": True}), ("--name", {}), ("--labels", {}), ("--right", FLAG), ("--open", FLAG), ("--stats", FLAG), STRICT)
def _bin(run: Run) -> int:
    a = run.args
    found = cells.binned(run.table(lines=True), a.column, a.edges, a.name, a.labels.split(",") if a.labels else None, a.right, a.open)
    return run.write(found.counters["bins"]) if a.stats else run.result(found)


@command("dates", FILE, ("-c", "--columns", {"required": True}), ("--monthfirst", FLAG), STRICT)
def _dates(run: Run) -> int:
    return run.result(cells.dated(run.table(lines=True), run.args.columns, run.args.monthfirst))


@command("split-column", FILE, ("-c", "--column", {"required": True}), ("--into", {"required": True}), ("--sep", {}), ("--from-right", FLAG), ("--keep", FLAG))
def _split_column(run: Run) -> int:
    a = run.args
    return run.result(projection.split_column(run.table(), a.column, a.into.split(","), a.sep, a.from_right, a.keep))


@command("merge-columns", FILE, ("-c", "--columns", {"required": True}), ("--into", {"required": True}), ("--sep", {"default": " "}), ("--keep-blank", FLAG), ("--keep", FLAG))
def _merge_columns(run: Run) -> int:
    a = run.args
    return run.write(projection.merge_columns(run.table(), a.columns, a.into, a.sep, a.keep_blank, a.keep))


@command("check", FILE, ("-r", "--rule", MANY | {"required": True}), ("--max-errors", {"type": int, "default": 100}))
def _check(run: Run) -> int:
    found = checks.check(run.table(lines=True), run.args.rule, ["_line"])
    for r in found.limit(run.args.max_errors).collect():
        print(f"line {r['_line']}: {r['column']}: {r['message']}" + (f" (first in line {r['first']})" if r["first"] is not None else ""))
    n = found.count()
    print(f"{n} problem(s)", file=sys.stderr)
    return int(n > 0)


@command("convert", FILE, ("--to", {"default": ","}), ("--crlf", FLAG), ("--bom", FLAG), ("--sniff", FLAG))
def _convert(run: Run) -> int:
    a = run.args
    path = run.path(a.file)
    ragged = delimited.read_ragged(run.spark, path, delimited.sniff(run.spark, path, a.encoding) if a.sniff else a.delimiter, a.encoding)
    for r in delimited.ragged_report(ragged).limit(20).collect():
        print(f"line {r['_line']}: {r['cells']} cells", file=sys.stderr)
    target = sinks.guarded(a.output, [path], a.force) if a.output else None
    with target.open("w", encoding="utf-8-sig" if a.bom else "utf-8", newline="") if target else os.fdopen(os.dup(1), "w", newline="") as file:
        out = csv.writer(file, delimiter=specs.delimiter(a.to), lineterminator="\r\n" if a.crlf else "\n")
        out.writerows(r["cells"] for r in ragged.orderBy(ORDINAL).toLocalIterator())
    return 0


@command("to-json", FILE, ("--lines", FLAG), ("--strings", FLAG), ("--nest", FLAG))
def _to_json(run: Run) -> int:
    a = run.args
    rows = records.as_json(run.table(), not a.strings, a.nest)
    if a.output:
        sinks.one_json(rows, a.output, a.lines, [a.file], a.force)
    elif a.lines:
        print(*(r[0] for r in rows.toLocalIterator()), sep="\n")
    else:
        print("[\n  " + ",\n  ".join(r[0] for r in rows.toLocalIterator()) + "\n]")
    return 0


@command("from-json", FILE, ("--path", {}), ("--lines", FLAG), ("--join", {}))
def _from_json(run: Run) -> int:
    a = run.args
    by_line = a.lines or a.file.endswith((".jsonl", ".ndjson"))
    found = records.records_of(run.lines([a.file]) if by_line else run.texts([a.file]), path=a.path, lines=by_line)
    return run.write(records.flat_table(found, a.join))


@command("json", FILE, ("--compact", FLAG), ("--sort-keys", FLAG), ("--ascii", FLAG), ("--strict-keys", FLAG), ("--lines", FLAG), ("--check", FLAG))
def _json(run: Run) -> int:
    a = run.args
    found = records.reformatted(run.lines([a.file]) if a.lines else run.texts([a.file]), lines=a.lines, indent=None if a.compact else 2, sort_keys=a.sort_keys, ascii_only=a.ascii, strict_keys=a.strict_keys)
    found = (found.orderBy(ORDINAL) if a.lines else found).collect()
    for r in found:
        print(r["formatted"] if r["error"] is None else f"{a.file}:{r['error']}", file=sys.stdout if r["error"] is None else sys.stderr)
    changed = a.check and not a.lines and any(r["text"].rstrip("\n") != r["formatted"] for r in found if r["error"] is None)
    return int(any(r["error"] is not None for r in found) or changed)


@command("fixed-width", FILE, ("--widths", {}), ("--names", {}), ("--gap", {"type": int, "default": 1}), ("--skip", {"type": int, "default": 0}))
def _fixed_width(run: Run) -> int:
    a = run.args
    return run.write(delimited.fixed_width(lines.lines_of(run.texts([a.file])), widths=a.widths, header=a.names.split(",") if a.names else None, gap=a.gap, skip=a.skip))


@command("lines", FILE, ("--keep", {"choices": ["first", "last"], "default": "first"}), IGNORE, ("-s", "--ignore-space", FLAG), ("--skip-blank", FLAG), ("--count", FLAG), ("--dupes", FLAG))
def _lines(run: Run) -> int:
    a, rows = run.args, lines.lines_of(run.texts([run.args.file]))
    if a.dupes:
        found = lines.count_prefixed(lines.repeated(rows, "line", a.ignore_case, a.ignore_space, a.skip_blank, ["_line"]))
    else:
        found = lines.dedupe(rows, "line", a.keep, a.ignore_case, a.ignore_space, a.skip_blank, a.count, ["_line"])
        found = lines.count_prefixed(found) if a.count else found
    print(*(r["line"] for r in found.toLocalIterator()), sep="\n")
    return 0


@command("words", FILES, ("-n", "--top", {"type": int, "default": 20}), ("--min-length", {"type": int, "default": 1}), ("--min-count", {"type": int, "default": 1}), ("--stop", {}))
def _words(run: Run) -> int:
    a, texts = run.args, run.texts(run.args.files)
    totals = lines.word_totals(texts).first().asDict()
    print(", ".join(f"{v} {k}" for k, v in totals.items()), file=sys.stderr)
    stops = run.texts([a.stop]) if a.stop else None
    for r in lines.word_counts(texts, top=a.top or None, min_length=a.min_length, min_count=a.min_count, stop_words=stops).collect():
        print(r["count"], r["word"])
    return 0


@command("duplicates", ("folder", {}), ("--pattern", {"default": "*"}), ("--min-size", {"default": "1"}))
def _duplicates(run: Run) -> int:
    a = run.args
    found = files.duplicates(delimited.read_files(run.spark, run.path(a.folder), a.pattern), specs.byte_size(a.min_size)).collect()
    for r in found:
        print(f"{specs.human_size(r['size'])}, {len(r['paths'])} files", *r["paths"], sep="\n  ")
    print(f"{specs.human_size(sum(r['reclaimable'] for r in found))} reclaimable", file=sys.stderr)
    return int(bool(found))


@command("line-ends", ("folder", {}), ("--pattern", {"default": "*"}), ("--to", {"choices": ["lf", "crlf", "cr"]}), ("--strip-bom", FLAG), ("--write", FLAG), ("--check", {"choices": ["lf", "crlf", "cr"]}))
def _line_ends(run: Run) -> int:
    a, table = run.args, delimited.read_files(run.spark, run.path(run.args.folder), run.args.pattern)
    if a.to:
        changed = files.with_line_ends(table, a.to, a.strip_bom).where("changed")
        print(*(r["path"] for r in changed.select("path").orderBy("path").collect()), sep="\n")
        return files.apply_contents(changed) * 0 if a.write else 0
    found = files.line_ends(table).orderBy("path").collect()
    for r in found:
        print(r["path"], "binary" if r["binary"] else f"{r['style']} ({r['crlf']} crlf, {r['lf']} lf, {r['cr']} cr)" + " with BOM" * r["bom"])
    return int(bool(a.check) and any(r["style"] not in (None, "none", a.check) for r in found))


@command("rename", ("folder", {}), ("pattern", {}), ("replacement", {}), IGNORE, ("--apply", FLAG))
def _rename(run: Run) -> int:
    a = run.args
    here = sorted(p.name for p in Path(run.path(a.folder)).iterdir() if p.is_file())
    table = run.spark.createDataFrame([(a.folder, n) for n in here], "folder string, name string")
    plan = files.rename_plan(table, a.pattern, a.replacement, a.ignore_case).collect()
    for r in plan:
        print(f"{r['old']} -> {r['new']}" + (f"  ({r['problem']})" if r["problem"] else ""))
    if any(r["problem"] for r in plan):
        return 1
    if a.apply:
        files.apply_renames([(r["folder"], r["old"], r["new"]) for r in plan])
    return 0


@command("look", FILE, ("-n", {"type": int, "default": 20}), ("-c", "--columns", {}), ("--markdown", FLAG), ("--width", {"type": int, "default": 40}))
def _look(run: Run) -> int:
    a = run.args
    print(render.look(run.table(), a.n, a.columns, a.markdown, a.width))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tabloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)
    for name, (declare, _) in COMMANDS.items():
        own = commands.add_parser(name)
        declare(own)
        own.add_argument("-d", "--delimiter", default=",")
        own.add_argument("--encoding", default="utf-8")
        own.add_argument("-o", "--output")
        own.add_argument("--force", **FLAG)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.getActiveSession() or session("local[*]", "tabloom", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    try:
        return COMMANDS[args.command][1](Run(spark, args))
    except (FileNotFoundError, Refused) as bad:
        print(f"tabloom {args.command}: {bad}", file=sys.stderr)
        return 1
    except (ValueError, json.JSONDecodeError) as bad:
        print(f"tabloom {args.command}: {bad}", file=sys.stderr)
        return 2
