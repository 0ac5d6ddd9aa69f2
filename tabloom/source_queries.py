"""Registered queries of sources, sinks, reports and problem tables, with DuckDB SQL for the same rows.

What is read is first written by the library's own sinks, into a new folder of the
place that ``spark.checkpoint.dir`` names, or a local one where that is unset.
"""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import dates, numbers, text
from tabloom.operators import aggregates, cells, checks, files, fill, filters, joins, lines, projection, records, reshape, sorting
from tabloom.plans import render, specs
from tabloom.plans.result import Refused
from tabloom.queries import query, spread, table
from tabloom.sources import delimited, sinks


def scratch(spark: SparkSession) -> str:
    """A path that is not there yet."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared or tempfile.mkdtemp(prefix='tabloom-')}/{uuid.uuid4().hex}"


def local(spark: SparkSession, name: str) -> str:
    """The path of a file, for the sinks that write one on the driver."""
    folder = Path(scratch(spark).removeprefix("file://").removeprefix("file:"))
    folder.mkdir(parents=True)
    return str(folder / name)


def written_lines(rows: DataFrame, order: str) -> str:
    """One file of the column line, in order."""
    path = scratch(rows.sparkSession)
    rows.orderBy(order).select("line").coalesce(1).write.text(path)
    return path


def refused(action) -> bool:
    try:
        action()
    except (ValueError, Refused):
        return True
    return False


# Delimited text


@query("""select cast(c_custkey as varchar) as c_custkey, c_name, 'a "' || c_name || '",' || chr(10) || c_mktsegment as note from customer""")
def csv_round_trip(spark, sf):
    """Quotes, delimiters and line ends in cells, written by all tasks and read back."""
    path = scratch(spark)
    note = F.concat(F.lit('a "'), "c_name", F.lit('",\n'), "c_mktsegment")
    sinks.csv_folder(table(spark, sf, "customer").select("c_custkey", "c_name", note.alias("note")), path)
    return delimited.read_table(spark, path)


_RAGGED = """
    with r as (select c_custkey as k, c_name as name, c_mktsegment as seg, cast(c_custkey % 5 = 0 as int) as two from customer),
    p as (select *, 1 + row_number() over (order by k) + sum(two) over (order by k) - two as line from r)"""


def _ragged(spark, sf):
    """Rows of two to four cells, some over two lines, as they are in a file."""
    c = table(spark, sf, "customer")
    name = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit('"x\n'), "c_name", F.lit('"'))).otherwise(F.col("c_name"))
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(","), name, F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit(", "), "c_mktsegment")).otherwise(""), F.when(F.col("c_custkey") % 3 == 2, ",more").otherwise(""))
    rows = c.select("c_custkey", line.alias("line")).unionByName(spark.createDataFrame([(-1, "id,name, segment ")], "c_custkey long, line string"))
    return delimited.read_ragged(spark, written_lines(rows, "c_custkey"))


@query(_RAGGED + """
    select line, line + two as line_end, cast(k as varchar) as id, case when two = 1 then 'x' || chr(10) || name else name end as name, case when k % 3 > 0 then ' ' || seg else '' end as segment from p""")
def csv_ragged(spark, sf):
    """Rows with the lines that they begin and end on; short rows are padded, long ones cut, headers trimmed."""
    rows = delimited.tabular(_ragged(spark, sf), lines=True)
    return rows.select(F.col("_line").alias("line"), F.col("_line_end").alias("line_end"), "id", "name", "segment")


@query(_RAGGED + " select line, case when k % 3 = 0 then 2 else 4 end as cells from p where k % 3 <> 1")
def csv_wrong_widths(spark, sf):
    """The lines whose number of cells is not the header's."""
    return delimited.ragged_report(_ragged(spark, sf)).select(F.col("_line").alias("line"), "cells")


@query("select cast(c_custkey as varchar) as id, 'é ' || c_name as name, ';' as delimiter from customer")
def csv_encoded(spark, sf):
    """Written in another encoding with semicolons; the delimiter is found, and the file read in its encoding."""
    path = local(spark, "rows.csv")
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("é "), "c_name").alias("name"))
    sinks.one_csv(rows, path, delimiter="semicolon", encoding="cp1252")
    found = delimited.sniff(spark, path, "cp1252")
    return delimited.tabular(delimited.read_ragged(spark, path, found, "cp1252")).select("id", "name", F.lit(found).alias("delimiter"))


@query("""
    select * from (values ('bytes of another encoding', true), ('delimiter that is not clear', true), ('repeated header', true), ('unknown encoding', true), ('short row', true)) t(what, refused)""")
def csv_refusals(spark, sf):
    """What a reader refuses."""
    path = local(spark, "rows.csv")
    sinks.one_csv(table(spark, sf, "region").select(F.lit("é").alias("a"), F.lit("x").alias("b")), path, encoding="cp1252")
    one = local(spark, "one.csv")
    sinks.one_csv(table(spark, sf, "region").select("r_name"), one)
    twice = written_lines(spark.createDataFrame([(1, "a,a"), (2, "1,2")], "i int, line string"), "i")
    short = written_lines(spark.createDataFrame([(1, "a,b"), (2, "1")], "i int, line string"), "i")
    tries = {
        "bytes of another encoding": lambda: delimited.read_ragged(spark, path).collect(), "delimiter that is not clear": lambda: delimited.sniff(spark, one),
        "repeated header": lambda: delimited.tabular(delimited.read_ragged(spark, twice)), "unknown encoding": lambda: delimited.read_ragged(spark, path, encoding="none-such"),
        "short row": lambda: delimited.tabular(delimited.read_ragged(spark, short), short="error"),
    }

    def failed(action) -> bool:
        try:
            action()
        except Exception:  # a reader's error comes wrapped in Spark's
            return True
        return False

    return spark.createDataFrame([(k, failed(v)) for k, v in tries.items()], "what string, refused boolean")


@query("""
    select cast(n_nationkey as varchar) as k, 'tab' as delimiter, n_name as v from nation union all select cast(n_nationkey as varchar), 'pipe', n_name from nation
    union all select cast(n_nationkey as varchar), 'semicolon', n_name from nation union all select cast(n_nationkey as varchar), 'comma', n_name from nation""")
def delimiter_names(spark, sf):
    found = None
    for name in ("tab", "pipe", "semicolon", "comma"):
        path = scratch(spark)
        sinks.csv_folder(table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")), path, delimiter=name)
        rows = delimited.read_table(spark, path, name).select("k", "v", F.lit(name).alias("delimiter"))
        found = rows if found is None else found.unionByName(rows)
    return found


# Fixed width and texts


def _fixed(spark, sf):
    row = F.concat(F.rpad(F.col("c_custkey").cast("string"), 9, " "), F.rpad("c_name", 22, " "), "c_mktsegment")
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("_line"), row.alias("line"))
    return rows.unionByName(spark.createDataFrame([(-1, "id       name                  segment")], "_line long, line string"))


@query("select cast(c_custkey as varchar) as id, c_name as name, c_mktsegment as segment from customer")
def fixed_width_found(spark, sf):
    """Columns found from the places that are blank in all lines."""
    return delimited.fixed_width(_fixed(spark, sf)).select("id", "name", "segment")


@query("select cast(c_custkey as varchar) as k, c_name as n, c_mktsegment as s from customer")
def fixed_width_given(spark, sf):
    """Columns by widths and names, title lines skipped, tabs as spaces."""
    row = F.concat(F.col("c_custkey").cast("string"), F.lit("\t"), F.rpad("c_name", 23, " "), "c_mktsegment")
    rows = table(spark, sf, "customer").select((F.col("c_custkey") + 2).alias("_line"), row.alias("line"))
    titles = spark.createDataFrame([(0, "Customers"), (1, "as of today")], "_line long, line string")
    return delimited.fixed_width(titles.unionByName(rows), widths="8,23,20", header=["k", "n", "s"], skip=1).select("k", "n", "s")


@query("select n_regionkey as region, count(*) + 1 as lines, sum(length(n_name) + 1) + 7 as chars from nation group by 1")
def folder_texts(spark, sf):
    """A file for each value, found again under its folder and read as whole texts."""
    path = scratch(spark)
    sinks.csv_folder(table(spark, sf, "nation").select("n_name", F.col("n_regionkey").alias("r")).coalesce(1), path, by=["r"])
    listed = delimited.read_files(spark, path, "*.csv").select("path", "length")
    texts = delimited.read_text(spark, f"{path}/*/*.csv").join(listed, F.col("_file") == F.col("path"))
    region = F.regexp_extract("_file", "r=([0-9]+)", 1).cast("int")
    return texts.select(region.alias("region"), F.size(text.lines(F.col("text"))).cast("long").alias("lines"), F.col("length").alias("chars"))


@query(r"""
    select word, count(*) as "count" from (select lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*'))) as word from documents)
    where length(word) >= 4 and word not in ('that', 'with', 'have') group by word having count(*) >= 3""")
def words_without_stops(spark, sf):
    stops = spark.createDataFrame([("That with",), ("HAVE",)], "text string")
    return lines.word_counts(table(spark, sf, "documents").select("text"), min_length=4, min_count=3, stop_words=stops, exact_case=False)


@query("select lpad(cast(count(*) as varchar), cast((select max(length(cast(n as varchar))) from (select count(*) as n from customer group by c_mktsegment)) as int), ' ') || ' ' || c_mktsegment as line from customer group by c_mktsegment")
def counted_lines(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("_ord"), F.col("c_mktsegment").alias("line"))
    return lines.count_prefixed(lines.dedupe(rows, counts=True)).select("line")


# Sinks


@query("select true as bom, count(*) + 1 as crlf, cast(0 as bigint) as lf, 'crlf' as style from nation")
def csv_crlf(spark, sf):
    """A file with a byte order mark and CRLF line ends."""
    path = local(spark, "rows.csv")
    sinks.one_csv(table(spark, sf, "nation").select("n_nationkey", "n_name"), path, line_end="\r\n", bom=True)
    return files.line_ends(delimited.read_files(spark, path)).select("bom", "crlf", "lf", "style")


@query("select * from (values ('exists', true), ('is an input', true), ('forced', false), ('strict with problems', true), ('strict without', false)) t(what, refused)")
def sink_guards(spark, sf):
    path, rows = local(spark, "rows.csv"), table(spark, sf, "nation").select("n_nationkey", "n_name")
    sinks.one_csv(rows, path)
    tries = {
        "exists": lambda: sinks.one_csv(rows, path), "is an input": lambda: sinks.one_csv(rows, path, inputs=[path], force=True), "forced": lambda: sinks.one_csv(rows, path, force=True),
        "strict with problems": lambda: cells.rounded(rows, "n_name").strict(), "strict without": lambda: cells.rounded(rows, "n_nationkey").strict(),
    }
    return spark.createDataFrame([(k, refused(v)) for k, v in tries.items()], "what string, refused boolean")


@query("""
    select 'rows_' || lpad(cast((row_number() over (order by n_nationkey) - 1) // 10 + 1 as varchar), 3, '0') || '.csv' as file, cast(n_nationkey as varchar) as n_nationkey, n_name from nation
    union all select 'rows_' || cast(n_regionkey as varchar) || '.csv', cast(n_nationkey as varchar), n_name from nation""")
def split_files(spark, sf):
    """Files of ten rows each, and a file for each value."""
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("_ord"), "n_nationkey", "n_name", "n_regionkey")
    folder = str(Path(local(spark, "x")).parent)
    made = [*sinks.split_by_rows(rows.drop("n_regionkey"), folder, "rows", 10), *sinks.split_by_value(rows, folder, "rows", "n_regionkey")]
    found = [delimited.tabular(delimited.read_ragged(spark, p)).select(F.lit(Path(p).name).alias("file"), "n_nationkey", "n_name") for p in made]
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


# JSON


@query("""select cast(c_custkey as varchar) as "id", c_name as "name.full", 'x' || chr(9) || '"' as "name.mark", cast(c_custkey % 2 = 0 as varchar) as even, '' as nothing from customer""")
def json_lines_round_trip(spark, sf):
    """Nested by dotted names, written as JSON Lines, read back and flattened."""
    c = table(spark, sf, "customer")
    rows = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name.full"), F.lit('x\t"').alias("name.mark"), (F.col("c_custkey") % 2 == 0).alias("even"), F.lit(" ").alias("nothing"))
    path = scratch(spark)
    sinks.json_lines(records.as_json(rows, nest=True), path)
    return records.flat_table(records.records_of(delimited.read_lines(spark, f"{path}/*.txt"), lines=True))


@query("select cast(o_orderkey as varchar) as k, o_orderstatus as \"s.t\", cast(o_orderkey as bigint) as doc from orders union all select 'last', '', o_orderkey from orders")
def json_at_path(spark, sf):
    """The objects at a path of keys and places of each document."""
    doc = F.concat(F.lit('{"n": 1, "data": [0, {"rows": [{"k": '), F.col("o_orderkey").cast("string"), F.lit(', "s": {"t": "'), "o_orderstatus", F.lit('"}}, {"k": "last", "s": {}}]}]}'))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("_ord"), doc.alias("text"))
    found = records.records_of(rows, path="data.1.rows")
    return records.flat_table(found.withColumn("record", F.concat(F.expr("left(record, length(record) - 1)"), F.lit(', "doc": '), F.col("_doc").cast("string"), F.lit("}")))).select("k", "`s.t`", F.col("doc").cast("long").alias("doc"))


@query("""select 'x;y' as t, '["a;b", "c"]' as u, '[1, {"z": null}]' as v, 'true' as w, '' as n, cast(r_regionkey as varchar) as k from region""")
def json_list_cells(spark, sf):
    doc = F.concat(F.lit('[{"t": ["x", "y"], "u": ["a;b", "c"], "v": [1, {"z": null}], "w": true, "n": null, "k": '), F.col("r_regionkey").cast("string"), F.lit("}]"))
    rows = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("_ord"), doc.alias("text"))
    return records.flat_table(records.records_of(rows), sep=";")


@query("""
    select r_regionkey, '{' || chr(10) || '  "a": [' || chr(10) || '    1,' || chr(10) || '    ' || r_regionkey || chr(10) || '  ],' || chr(10) || '  "b": "' || r_name || '"' || chr(10) || '}' as formatted, cast(null as varchar) as error from region""")
def json_pretty_sorted(spark, sf):
    doc = F.concat(F.lit('{"b":"'), "r_name", F.lit('" , "a":[1,'), F.col("r_regionkey").cast("string"), F.lit("]}"))
    return records.reformatted(table(spark, sf, "region").select("r_regionkey", doc.alias("text")), sort_keys=True).drop("text")


@query("""
    select r_regionkey, l as line, case l when 1 then '{"k":' || r_regionkey || '}' when 3 then '[1,2]' end as formatted,
      case l when 4 then '4: duplicate key ''a''' when 5 then '5: NaN is not valid JSON' when 6 then '6:6: Expecting value' end as error from region, (select unnest([1, 3, 4, 5, 6]) as l)""")
def json_lines_checked(spark, sf):
    """JSON Lines with blank lines, repeated keys, NaN and an error with its place."""
    doc = F.concat(F.lit('{"k": '), F.col("r_regionkey").cast("string"), F.lit('}\n\n[1, 2]\n{"a": 1, "a": 2}\n[NaN]\n[1 , ]'))
    found = records.reformatted(table(spark, sf, "region").select("r_regionkey", doc.alias("text")), lines=True, strict_keys=True)
    # newer and older readers of Python name a comma before a bracket by different words and places
    error = F.when(F.col("_line") == 6, F.when(F.col("error").startswith("6:"), "6:6: Expecting value")).otherwise(F.col("error"))
    return found.select("r_regionkey", F.col("_line").alias("line"), "formatted", error.alias("error"))


# Problem tables, counters and order


@query(r"""
    select o_orderkey, 'o_orderpriority' as "column", 'int' as "rule", o_orderpriority as value, '''' || o_orderpriority || ''' is not a valid int' as message, cast(null as bigint) as first from orders where not regexp_matches(o_orderpriority, '^[+-]?[0-9]+$')
    union all select o_orderkey, 'o_custkey', 'unique', cast(o_custkey as varchar), 'repeats ''' || o_custkey || '''', min(o_orderkey) over (partition by o_custkey) from orders qualify row_number() over (partition by o_custkey order by o_orderkey) > 1
    union all select o_orderkey, 'mail', 'email', mail, '''' || mail || ''' is not a valid email', null from (select o_orderkey, case o_orderkey % 3 when 0 then 'a@b..com' when 1 then 'a b@c.d' else 'a@b.c' end as mail from orders) where mail = 'a b@c.d'
    union all select o_orderkey, 'amount', 'number', '1_0', '''1_0'' is not a valid number', null from orders where o_orderkey % 2 = 0""")
def check_rules_whole(spark, sf):
    """All that a check says: value, message, and where a repeated value stands first."""
    mail = F.when(F.col("o_orderkey") % 3 == 0, "a@b..com").when(F.col("o_orderkey") % 3 == 1, "a b@c.d").otherwise("a@b.c")
    amount = F.when(F.col("o_orderkey") % 2 == 0, "1_0").otherwise("1e3")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_custkey", mail.alias("mail"), amount.alias("amount"))
    found = checks.check(rows, ["o_orderpriority:int", "o_custkey:unique", "mail:email", "amount:number"], order="o_orderkey")
    return found.select("o_orderkey", "column", "rule", "value", "message", F.col("first").cast("long").alias("first"))


@query("select c_custkey, 'c_name' as \"column\", c_name as value from customer")
def not_numbers(spark, sf):
    return aggregates.not_numbers(table(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("string").alias("n")), ["c_name", "n"], ["c_custkey"]).drop("number")


@query("""
    select row_number() over (order by case when k = '(blank)' then 2 when try_cast(k as double) is null then 1 else 0 end, try_cast(k as double), lower(k)) as place, k as g, n as "count" from (
      select case when c_custkey % 7 = 0 then '(blank)' when c_custkey % 2 = 0 then c_mktsegment else cast(c_nationkey as varchar) end as k, count(*) as n from customer group by 1)""")
def group_order(spark, sf):
    """Groups in order: numbers by size, then text, then blanks."""
    key = F.when(F.col("c_custkey") % 7 == 0, " ").when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.col("c_nationkey").cast("string"))
    found = aggregates.group(table(spark, sf, "customer").select(key.alias("g")), "g", ["count"]).collect()  # a row for each of a few groups
    return spark.createDataFrame([(i, *r) for i, r in enumerate(found, 1)], "place long, g string, count long")


@query("""select count(*) filter (contains(c_name, '#0')) as c_name, cast(0 as bigint) as c_mktsegment from customer""")
def replaced_counts(spark, sf):
    return cells.replaced(table(spark, sf, "customer").select("c_name", "c_mktsegment"), "#0", "-", literal=True).counters["changed"]


@query("""select c_custkey, replace(c_name, '#0', '(.)') as c_name, case when c_mktsegment = 'BUILDING' then 'B' else c_mktsegment end as c_mktsegment from customer""")
def replace_literal_whole(spark, sf):
    rows = cells.replaced(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), "#0", "(.)", "c_name", literal=True).df
    return cells.replaced(rows, "build.*", "B", "c_mktsegment", ignore_case=True, whole=True).df


@query("""
    select c_custkey, 'acct' as "column", acct as value, case when acct = 'n/a' then 'not a plain number' else 'outside the edges' end as message
    from (select c_custkey, case when c_custkey % 4 = 0 then 'n/a' else cast(cast(c_acctbal as decimal(18,2)) as varchar) end as acct from customer) where acct = 'n/a' or cast(acct as decimal(18,2)) >= 1000 or cast(acct as decimal(18,2)) < 0""")
def bin_problems(spark, sf):
    acct = F.when(F.col("c_custkey") % 4 == 0, "n/a").otherwise(F.col("c_acctbal").cast("decimal(18,2)").cast("string"))
    return cells.binned(table(spark, sf, "customer").select("c_custkey", acct.alias("acct")), "acct", "0,500,1000", order=["c_custkey"]).problems


@query("""select c_custkey, m, case m when 'floor' then floor(b * 10) / 10 when 'ceiling' then ceil(b * 10) / 10 when 'down' then trunc(b * 10) / 10 when 'half-up' then round(b, 1) else round_even(b, 1) end as v
    from (select c_custkey, cast(c_acctbal as decimal(18,2)) as b from customer), (select unnest(['floor', 'ceiling', 'down', 'half-up', 'half-even']) as m)""")
def rounding(spark, sf):
    """All ways of rounding to a decimal."""
    rows = spread(table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("b")))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), numbers.rounded(F.col("b"), 1, m).cast("double").alias("v")) for m in numbers.MODES])).alias("x")
    return rows.select("c_custkey", each).select("c_custkey", "x.m", "x.v")


@query("""select '123456789012345678901234567890.5' as t, '123456789012345678901234567891' as up, '123456789012345678901234567890' as even, '123456789012345678901234567900' as tens from region""")
def rounding_long(spark, sf):
    """Numbers of over twenty whole digits."""
    t = F.lit("123456789012345678901234567890.5")
    return table(spark, sf, "region").select(t.alias("t"), numbers.rounded(t, 0).alias("up"), numbers.rounded(t, 0, "half-even").alias("even"), numbers.rounded(t, -2, "ceiling").alias("tens"))


@query("""select c_custkey, cast(c_acctbal as decimal(18,2)) as amount from customer""")
def decimal_commas(spark, sf):
    shown = F.translate(F.format_number("c_acctbal", 2), ",.", ".,")
    return table(spark, sf, "customer").select("c_custkey", numbers.comma_floating(shown).cast("decimal(18,2)").alias("amount"))


@query("""select c_custkey, v as variable, w as value from (select c_custkey, 'a' as v, case when c_custkey % 2 = 0 then c_name else '' end as w from customer union all select c_custkey, 'b', c_mktsegment from customer) where w <> ''""")
def melt_filled(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(" ").alias("a"), F.col("c_mktsegment").alias("b"))
    return reshape.melt(rows, "c_custkey", skip_blank=True)


@query("""select c_mktsegment as s, count(*) as "count" from customer where c_custkey % 2 = 0 group by 1""")
def freq_filled(spark, sf):
    rows = table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(" ").alias("s"))
    return aggregates.freq(rows, "s", blanks=False, share=None)


@query("""select cast(o_custkey as varchar) as o_custkey, coalesce(max_by(cast(o_orderkey as varchar), o_orderkey) filter (o_orderstatus = 'F'), '-') as "F", coalesce(max_by(cast(o_orderkey as varchar), o_orderkey) filter (o_orderstatus = 'O'), '-') as "O",
    coalesce(max_by(cast(o_orderkey as varchar), o_orderkey) filter (o_orderstatus = 'P'), '-') as "P" from orders group by o_custkey""")
def pivot_last(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", F.col("o_orderkey").alias("_ord"))
    return reshape.pivot(rows, "o_orderstatus", "o_orderkey", "o_custkey", fill="-", keep="last", headers=["F", "O", "P"])


@query("select * from (values ('repeats', true), ('value clashes with an id', true), ('first of repeats', false)) t(what, refused)")
def pivot_guards(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", F.col("o_orderkey").alias("_ord"))
    tries = {"repeats": lambda: reshape.pivot(rows, "o_orderstatus", "o_orderkey", "o_custkey"), "value clashes with an id": lambda: reshape.pivot(rows, "o_orderstatus", "o_custkey", "o_custkey"), "first of repeats": lambda: reshape.pivot(rows, "o_orderstatus", "o_orderkey", "o_custkey", keep="first")}
    return spark.createDataFrame([(k, refused(v)) for k, v in tries.items()], "what string, refused boolean")


@query("select c_custkey, c_name from customer order by c_custkey limit 25")
def head_rows(spark, sf):
    return sorting.head(table(spark, sf, "customer").select("c_custkey", "c_name"), 25, order="c_custkey")


@query("select * from (values ('added', 'segment'), ('removed', 'c_mktsegment')) t(what, name)")
def column_difference(spark, sf):
    old = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    added, removed = joins.column_changes(old, old.withColumnRenamed("c_mktsegment", "segment"))
    return spark.createDataFrame([*[("added", c) for c in added], *[("removed", c) for c in removed]], "what string, name string")


@query("""
    select cast(c_custkey as bigint) as c_custkey, 'n' || c_nationkey as nation, case when c_custkey % 3 = 0 then 'filled' else c_mktsegment end as seg, (select count(*) from customer where c_custkey % 3 = 0) as n from customer""")
def filled_counter(spark, sf):
    """Blank cells filled by a value, and their number."""
    seg = F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_mktsegment"))
    found = fill.fill(table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), F.concat(F.lit("n"), "c_nationkey").alias("nation"), seg.alias("seg")), "seg", value="filled", order="c_custkey")
    return found.df.withColumn("n", F.lit(found.count("filled")).cast("long"))


# Files and reports


@query("""select page_id, replace(replace(html, chr(13) || chr(10), chr(10)), chr(10), chr(13) || chr(10)) as html, contains(html, chr(10)) as changed, false as "binary" from pages
    union all select -page_id - 1, 'a' || chr(10) || html, false, true from pages""")
def line_ends_written(spark, sf):
    """Line ends rewritten; contents with a NUL are binary and stay."""
    pages = table(spark, sf, "pages")
    rows = pages.select(F.col("page_id").alias("path"), F.encode("html", "UTF-8").alias("content")).unionByName(pages.select((-F.col("page_id") - 1).alias("path"), F.concat(F.encode(F.lit("a\n\0"), "UTF-8"), F.encode("html", "UTF-8")).alias("content")))
    out = files.with_line_ends(rows, "crlf").join(files.line_ends(rows).select("path", "binary"), "path")
    return out.select(F.col("path").alias("page_id"), F.replace(F.decode("content", "UTF-8"), F.lit("\0"), F.lit("")).alias("html"), "changed", "binary")


@query(r"""
    with p as (select 'f' || c_nationkey as folder, c_name || '.txt' as old, regexp_replace(c_name, '^Customer#0*(\d)\d*$', '\1') || case when c_custkey % 5 = 0 then ' .' else '.txt' end as new from customer where c_custkey % 2 = 0 or c_custkey % 5 = 0),
    q as (select folder, case when new like '% .' then replace(old, '.txt', '. x') else old end as old, new from p)
    select folder, old, new, case when new like '% .' then 'ends with a space or dot' when count(*) over (partition by folder, new) > 1 then 'more than one file would get this name' end as problem from q""")
def rename_problems(spark, sf):
    """New names by a pattern, and what is wrong with them."""
    c = table(spark, sf, "customer").where("c_custkey % 2 = 0 or c_custkey % 5 = 0")
    name = F.concat("c_name", F.when(F.col("c_custkey") % 5 == 0, ". x").otherwise(".txt"))
    rows = c.select(F.concat(F.lit("f"), "c_nationkey").alias("folder"), name.alias("name"))
    plan = files.rename_plan(rows, r"^Customer#0*(\d)\d*\.(?: (x)|(txt))$", r"\1.\3", exact_case=False)
    # a name that ends with a dot: a space before it, as Windows allows neither
    return plan.select("folder", "old", F.regexp_replace("new", r"\.$", " .").alias("new"), "problem")


@query(r"""
    select 'r_regionkey  r_name' || chr(10) || '-----------  -----------' || chr(10) || string_agg(lpad(cast(r_regionkey as varchar), 11, ' ') || '  ' || r_name, chr(10) order by r_regionkey) as t, 'text' as kind from region
    union all select '| r_regionkey | r_name      |' || chr(10) || '| ----------: | ----------- |' || chr(10) || string_agg('| ' || lpad(cast(r_regionkey as varchar), 11, ' ') || ' | ' || rpad(r_name, 11, ' ') || ' |', chr(10) order by r_regionkey), 'markdown' from region""")
def shown_tables(spark, sf):
    """Tables as text and Markdown, numbers at the right."""
    rows = table(spark, sf, "region").select(F.col("r_regionkey").alias("_ord"), "r_regionkey", F.rpad("r_name", 11, " ").alias("r_name"))
    rows = rows.withColumn("r_name", F.rtrim("r_name"))
    return spark.createDataFrame([("text", render.look(rows)), ("markdown", render.look(rows, markdown=True))], "kind string, t string")


@query("""
    select 'columns added: x' as line union all select 'columns removed: y' union all select '+ ' || r_regionkey from region where r_regionkey = 4 union all select '- 0'
    union all select '~ ' || r_regionkey from region where r_regionkey between 1 and 3 union all select '    r_name: ''' || r_name || ''' -> ''' || lower(r_name) || '''' from region where r_regionkey between 1 and 3""")
def diff_lines(spark, sf):
    """The report of a difference, line by line."""
    rows = table(spark, sf, "region").select("r_regionkey", "r_name")
    old, new = rows.where("r_regionkey < 4"), rows.where("r_regionkey > 0").withColumn("r_name", F.lower("r_name"))
    found = joins.diff(old, new, "r_regionkey").df
    return spark.createDataFrame([(x,) for x in render.diff_report(found, ["x"], ["y"])], "line string")


@query("""
    select case when n < 1024 then n || 'B' when n < 1048576 then printf('%.1fK', n / 1024) when n < 1073741824 then printf('%.1fM', n / 1048576) else printf('%.1fG', n / 1073741824) end as shown, n from (
      select distinct r_regionkey * k + r_regionkey as n from region, (select unnest([1, 1023, 1536, 1048576, 5000000000]::bigint[]) as k))""")
def human_sizes(spark, sf):
    """Sizes as people read them; the five regions make the numbers."""
    n = [r[0] for r in table(spark, sf, "region").select(F.col("r_regionkey").cast("long")).collect()]
    sizes = sorted({i * k + i for i in n for k in (1, 1023, 1536, 1048576, 5000000000)})
    return spark.createDataFrame([(specs.human_size(x), x) for x in sizes], "shown string, n long")


@query("""select o_orderkey, cast(o_orderdate as date) as day, f from orders, (select unnest(['iso', 'stamp', 'slash', 'solid', 'named', 'month']) as f)""")
def date_forms(spark, sf):
    """The forms of dates that are read."""
    d = F.col("o_orderdate").cast("timestamp")
    forms = {"iso": "yyyy-M-d", "stamp": "yyyy-MM-dd'T'HH:mm:ss'Z'", "slash": "d/M/yyyy", "solid": "yyyyMMdd", "named": "d MMM yyyy", "month": "MMMM d, yyyy"}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), dates.parsed(F.date_format(d, v)).alias("day")) for k, v in forms.items()])).alias("x")
    return table(spark, sf, "orders").select("o_orderkey", each).select("o_orderkey", "x.day", "x.f")


@query("""select l_orderkey, l_linenumber from lineitem where l_quantity >= 49 and l_returnflag = 'R'""")
def filter_chain(spark, sf):
    rows = filters.where(table(spark, sf, "lineitem"), ["l_quantity >= 49", "l_returnflag = R"])
    return projection.cut(rows, keep="l_orderkey,l_linenumber")
