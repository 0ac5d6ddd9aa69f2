"""Registered queries of the table operators on the driver's tables, with DuckDB SQL for the same rows.

Texts that the tables do not hold (locale numbers, day-first dates, padded keys, blanks)
are made from typed columns by the same rule on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom import streaming
from tabloom.functions import dates, numbers, text
from tabloom.operators import aggregates, cells, checks, chunks, dedup, files, fill, filters, joins, lines, projection, records, reshape, sampling, sorting

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly to four tasks a core, ahead of long work on each row: a row group of its file, a million rows or more, is a task otherwise."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)").alias(c)


# Projection


@query("select l_orderkey as order_key, l_linenumber as line, l_quantity from lineitem")
def cut_rename(spark, sf):
    return projection.cut(table(spark, sf, "lineitem"), keep="l_orderkey,l_linenumber,l_quantity", rename=["l_orderkey=order_key", "l_linenumber=line"])


@query("select * exclude (c_acctbal, c_mktsegment) from customer")
def cut_drop(spark, sf):
    return projection.cut(table(spark, sf, "customer"), drop=["c_acctbal", "c_mktsegment"])


@query("select distinct trim(o_orderstatus) as order_status, trim(o_orderpriority) as order_priority, '' as column_3 from orders")
def clean_rows(spark, sf):
    rows = table(spark, sf, "orders").select(F.concat(F.lit(" \t"), F.col("o_orderstatus")).alias("Order-Status"), F.concat("o_orderpriority", F.lit("  ")).alias(" orderPriority "), F.lit(" ").alias("--"), F.col("o_orderkey").alias("_ord"))
    return projection.clean(rows, drop_repeats=True).drop("_ord")


@query("""
    select 'customer' as source, c_custkey as key, c_name as name, c_mktsegment as segment, '' as balance from customer
    union all select 'supplier', s_suppkey, s_name, '', cast(cast(s_acctbal as decimal(18,2)) as varchar) from supplier""")
def stack_union(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").cast("decimal(18,2)").cast("string").alias("balance"))
    return projection.stack([("customer", a), ("supplier", b)], union=True, source="source")


@query("""
    select c_custkey as key, c_name as name from customer union all select s_suppkey, s_name from supplier""")
def stack_strict(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    b = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"))
    return projection.stack([("customer", a), ("supplier", b)])


@query("""
    select o_orderkey, split_part(o_orderpriority, '-', 1) as rank,
           case when contains(o_orderpriority, '-') then trim(substr(o_orderpriority, instr(o_orderpriority, '-') + 1)) else '' end as word
    from orders""")
def split_column(spark, sf):
    return projection.split_column(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["rank", "word"], sep="-").df


@query("""
    select p_partkey, case when length(p_type) - length(replace(p_type, ' ', '')) >= 1 then regexp_replace(p_type, ' [^ ]*$', '') else '' end as front, regexp_extract(p_type, '[^ ]*$') as back from part""")
def split_column_right(spark, sf):
    return projection.split_column(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type", ["front", "back"], from_right=True).df


@query("select c_custkey, concat_ws(' / ', c_name, nullif(c_mktsegment, 'BUILDING')) as label from customer")
def merge_columns(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", F.when(F.col("c_mktsegment") == "BUILDING", "  ").otherwise(F.col("c_mktsegment")).alias("seg"))
    return projection.merge_columns(rows, ["c_name", "seg"], "label", " / ")


# Filters


@query("select l_orderkey, l_linenumber, l_discount, l_shipdate from lineitem where l_discount >= 0.05 and l_returnflag = 'R'")
def filter_all(spark, sf):
    rows = filters.where(table(spark, sf, "lineitem"), ["l_discount >= 0.05", "l_returnflag = R"])
    return rows.select("l_orderkey", "l_linenumber", "l_discount", "l_shipdate")


@query("select o_orderkey, o_orderpriority from orders where regexp_matches(o_orderpriority, '^[12]-') or lower(o_orderstatus) = 'p' or o_totalprice < 20000")
def filter_any(spark, sf):
    rows = filters.where(table(spark, sf, "orders"), ["o_orderpriority ~ ^[12]-", "o_orderstatus = p", "o_totalprice < 20000"], any_match=True, ignore_case=True)
    return rows.select("o_orderkey", "o_orderpriority")


@query("select event_id, cast(cast(value as decimal(18,2)) as varchar) as v from events where not (cast(value as decimal(18,2)) = 5) and cast(value as decimal(18,2)) > 99.5")
def filter_text_numbers(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("value").cast("decimal(18,2)").cast("string").alias("v"))
    return filters.where(rows, ["v != 5.0", "v > 99.5"])


@query("select count(*) as n from part where p_size >= 10 and not regexp_matches(p_type, 'BRASS')")
def filter_count(spark, sf):
    return filters.where(table(spark, sf, "part"), ["p_size >= 10", "p_type !~ BRASS"]).agg(F.count(F.lit(1)).alias("n"))


# Sort, top, sample, chunks


@query("select o_orderkey, o_orderpriority, cast(o_totalprice as decimal(18,2)) as o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def sort_top(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", _money("o_totalprice"))
    return sorting.sort(rows, "o_totalprice:desc", order="o_orderkey").limit(25)


@query("""
    select c_custkey, b, row_number() over (order by try_cast(nullif(trim(b), '') as double) desc nulls last, c_custkey) as place
    from (select c_custkey, case when c_mktsegment = 'MACHINERY' then '  ' else cast(cast(c_acctbal as decimal(18,2)) as varchar) end as b from customer)
    order by place limit 200""")
def sort_text_numbers(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_mktsegment") == "MACHINERY", "  ").otherwise(F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("b"))
    out = sorting.sort(rows, "b:desc", order="c_custkey").limit(200)
    # a row for each of 200 rows
    return out.withColumn("place", F.row_number().over(Window.orderBy(numbers.floating(F.col("b")).desc_nulls_last(), "c_custkey")).cast("long"))


@query("""
    select c_custkey, b, row_number() over (order by try_cast(nullif(trim(b), '') as double) desc nulls last, c_custkey) as place
    from (select c_custkey, case when c_mktsegment = 'MACHINERY' then '  ' else cast(cast(c_acctbal as decimal(18,2)) as varchar) end as b from customer)""")
def sort_text_numbers_all(spark, sf):
    """All rows, blanks at the end, each with its place in the sorted table."""
    rows = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_mktsegment") == "MACHINERY", "  ").otherwise(F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("b"))
    # counts of each sorted part give its first place: no one task for all rows
    places = sorting.sort(rows, "b:desc", order="c_custkey").rdd.zipWithIndex().map(lambda r: (*r[0], r[1] + 1))
    return spark.createDataFrame(places, "c_custkey long, b string, place long")


@query("select o_orderkey, md5('42:' || o_orderkey) as draw from orders order by md5('42:' || o_orderkey), o_orderkey limit 100")
def sample_rows(spark, sf):
    out = sampling.sample(table(spark, sf, "orders").select("o_orderkey"), n=100, seed=42, order="o_orderkey")
    return out.withColumn("draw", F.md5(F.concat(F.lit("42:"), F.col("o_orderkey").cast("string"))))


@query("""
    select o_orderkey from (select o_orderkey, row_number() over (order by md5('7:' || o_orderkey), o_orderkey) as rn, count(*) over () as n from orders)
    where rn <= round_even(n * 0.013, 0)""")
def sample_fraction(spark, sf):
    return sampling.sample(table(spark, sf, "orders").select("o_orderkey"), fraction=0.013, seed=7, order="o_orderkey")


@query("select part, count(*) as n, min(o_orderkey) as first, max(o_orderkey) as last from (select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 700 + 1 as part from orders) group by part")
def chunk_rows(spark, sf):
    parts = chunks.by_rows(table(spark, sf, "orders").select("o_orderkey"), 700, order="o_orderkey")
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("select regexp_replace(o_orderpriority, '[^A-Za-z0-9_.-]+', '_', 'g') as part, count(*) as n from orders group by 1")
def chunk_values(spark, sf):
    parts = chunks.by_value(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", order="o_orderkey")
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


# Joins and differences


@query("""
    select c_custkey, c_name, n_name, n_regionkey from customer join nation on c_nationkey = n_nationkey""")
def join_inner(spark, sf):
    found = joins.join(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), table(spark, sf, "nation"), "c_nationkey", "n_nationkey").df
    return found.drop("c_nationkey")


@query("""
    select c.c_custkey, coalesce(cast(o_orderkey as varchar), '') as o_orderkey, coalesce(o_orderstatus, '') as o_orderstatus
    from customer c left join (select * from orders where o_orderpriority = '1-URGENT') on c_custkey = o_custkey""")
def join_left_blank(spark, sf):
    urgent = filters.where(table(spark, sf, "orders"), "o_orderpriority = 1-URGENT").select("o_custkey", F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_orderstatus")
    return joins.join(table(spark, sf, "customer").select("c_custkey"), urgent, "c_custkey", "o_custkey", how="left").df


@query("""
    select a.n_nationkey, b.s_suppkey, b.key as key_right from (select n_nationkey, upper(n_name) as name, 'n' as key from nation) a
    join (select s_suppkey, n_name as name, 's' as key from supplier join nation on s_nationkey = n_nationkey) b on lower(trim(a.name)) = lower(trim(b.name))""")
def join_folded(spark, sf):
    nation = table(spark, sf, "nation")
    left = nation.select("n_nationkey", F.concat(F.lit(" "), F.upper("n_name")).alias("name"), F.lit("n").alias("key"))
    right = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat("n_name", F.lit("\t")).alias("name"), F.lit("s").alias("key"))
    return joins.join(left, right, "name", ignore_case=True).df.select("n_nationkey", "s_suppkey", "key_right")


@query("select count(*) as n from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def join_unmatched(spark, sf):
    return joins.join(table(spark, sf, "customer"), table(spark, sf, "orders").select("o_custkey"), "c_custkey", "o_custkey", how="left").counters["unmatched"]


_DIFF_OLD = "select o_orderkey as id, o_orderstatus as status, o_orderpriority as priority from orders where o_orderkey % 10 <> 3"
_DIFF_NEW = "select o_orderkey as id, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as status, o_orderpriority as priority from orders where o_orderkey % 10 <> 4"


def _versions(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    new = orders.where("id % 10 <> 4").withColumn("status", F.when(F.col("id") % 7 == 0, "X").otherwise(F.col("status")))
    return orders.where("id % 10 <> 3"), new


@query(f"""
    select op, count(*) as n from (select case when a.id is null then '+' when b.id is null then '-' when a.status <> b.status or a.priority <> b.priority then '~' else '=' end as op
    from ({_DIFF_OLD}) a full join ({_DIFF_NEW}) b on a.id = b.id) group by op""")
def diff_counts(spark, sf):
    return joins.diff(*_versions(spark, sf), "id").df.groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
    select cast(a.id as varchar) as id, 'status' as "column", a.status as old, b.status as new from ({_DIFF_OLD}) a join ({_DIFF_NEW}) b on a.id = b.id where a.status <> b.status""")
def diff_cells(spark, sf):
    changed = joins.diff(*_versions(spark, sf), "id", check=False).df
    return changed.where("op = '~'").select("id", F.explode("changes").alias("c")).select("id", "c.column", "c.old", "c.new")


# Aggregates


@query("""
    select l_returnflag, l_linestatus, count(*) as "count", cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(38,6)) as l_extendedprice_sum,
           cast(round(cast(sum(cast(l_quantity as decimal(18,2))) as double) / count(*), 2) as decimal(38,2)) as l_quantity_mean,
           cast(min(cast(l_discount as decimal(18,2))) as decimal(38,6)) as l_discount_min, cast(max(cast(l_tax as decimal(18,2))) as decimal(38,6)) as l_tax_max, count(distinct l_suppkey) as l_suppkey_distinct
    from lineitem where l_discount >= 0.05 group by l_returnflag, l_linestatus""")
def group_exact(spark, sf):
    rows = filters.where(table(spark, sf, "lineitem"), "l_discount >= 0.05")
    rows = rows.select("l_returnflag", "l_linestatus", "l_suppkey", *[_money(c) for c in ("l_extendedprice", "l_quantity", "l_discount", "l_tax")])
    return aggregates.group(rows, "l_returnflag,l_linestatus", ["count", "l_extendedprice:sum", "l_quantity:mean", "l_discount:min", "l_tax:max", "l_suppkey:distinct"], exact_case=False)


@query("""
    with r as (select case when o_orderpriority = '5-LOW' then '(blank)' else o_orderpriority end as p, cast(o_totalprice as decimal(18,2)) as v from orders),
    n as (select p, v, row_number() over (partition by p order by v) as rn, count(*) over (partition by p) as n from r)
    select p as priority, n.n as "count", cast(sum(v) * case when count(*) = 1 then 1.0 else 0.5 end as decimal(38,7)) as price_median
    from n where rn in ((n.n + 1) // 2, n.n // 2 + 1) group by p, n.n""")
def group_median(spark, sf):
    rows = table(spark, sf, "orders").select(F.when(F.col("o_orderpriority") == "5-LOW", " ").otherwise(F.col("o_orderpriority")).alias("priority"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"))
    return aggregates.group(rows, "priority", ["count", "price:median"], exact_case=False)


@query("""select o_orderstatus, o_orderpriority, count(*) as "count", round(count(*) * 100.0 / (select count(*) from orders), 1) as share from orders group by 1, 2""")
def freq_pairs(spark, sf):
    return aggregates.freq(table(spark, sf, "orders"), "o_orderstatus,o_orderpriority")


@query("""select o_orderpriority as word, count(*) as "count" from orders group by 1""")
def freq_folded(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("_ord"), F.when(F.col("o_orderkey") % 3 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("word"))
    return aggregates.freq(rows, "word", ignore_case=True, share=None)


@query("""
    select p_size, "count" from (select cast(p_size as varchar) as p_size, count(*) as "count" from part group by 1 order by 2 desc, 1 limit 10) order by cast(p_size as int)""")
def freq_top_by_value(spark, sf):
    return aggregates.freq(table(spark, sf, "part"), "p_size", top=10, by_value=True, share=None, exact_case=False)


@query("""
    select 'c_acctbal' as "column", count(c_acctbal) as filled, cast(0 as bigint) as "empty", count(distinct c_acctbal) as "distinct", true as "numeric", min(c_acctbal) as "min", max(c_acctbal) as "max", round(avg(c_acctbal), 4) as mean from customer
    union all select 'c_mktsegment', count(c_mktsegment), 0, count(distinct c_mktsegment), false, null, null, null from customer
    union all select 'c_custkey', count(*), 0, count(distinct c_custkey), true, min(c_custkey), max(c_custkey), round(avg(c_custkey), 4) from customer""")
def profile(spark, sf):
    return aggregates.profile(table(spark, sf, "customer"), ["c_acctbal", "c_mktsegment", "c_custkey"]).drop("position")


# One row of each key, fills


@query("select event_id, user_id, event_type from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def unique_last(spark, sf):
    return dedup.unique(table(spark, sf, "events").select("event_id", "user_id", "event_type"), "user_id", keep="last", order="event_id")


@query("""select event_id, event_type, n from (select event_id, event_type, count(*) over (partition by event_type, user_id % 10) as n, row_number() over (partition by event_type, user_id % 10 order by event_id) as rn from events) where rn = 1""")
def unique_counted(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", (F.col("user_id") % 10).alias("u"))
    return dedup.unique(rows, ["event_type", "u"], count="n", order="event_id").drop("u")


@query("select event_id, user_id, event_type from events qualify count(*) over (partition by user_id, event_type) > 1")
def repeated_keys(spark, sf):
    return dedup.repeated(table(spark, sf, "events").select("event_id", "user_id", "event_type"), "user_id,event_type")


_FILL = "select event_id, user_id, case when event_type = 'error' or event_id % 5 = 0 then '' else event_type end as kind from events"


def _gaps(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", F.when((F.col("event_type") == "error") | (F.col("event_id") % 5 == 0), "").otherwise(F.col("event_type")).alias("kind"))


@query(f"select event_id, user_id, coalesce(last_value(nullif(kind, '') ignore nulls) over (order by event_id rows unbounded preceding), '') as kind from ({_FILL})")
def fill_down(spark, sf):
    return fill.fill(_gaps(spark, sf), "kind", order="event_id").df


@query(f"select event_id, user_id, coalesce(first_value(nullif(kind, '') ignore nulls) over (order by event_id rows between current row and unbounded following), '') as kind from ({_FILL})")
def fill_up(spark, sf):
    return fill.fill(_gaps(spark, sf), "kind", up=True, order="event_id").df


@query(f"""
    with g as (select *, event_id // 7 as grp from ({_FILL}))
    select event_id, cast(grp as varchar) as grp, coalesce(last_value(nullif(kind, '') ignore nulls) over (partition by grp order by event_id rows unbounded preceding), '') as kind from g""")
def fill_within(spark, sf):
    rows = _gaps(spark, sf).select("event_id", F.floor(F.col("event_id") / 7).cast("string").alias("grp"), "kind")
    return fill.fill(rows, "kind", within="grp", order="event_id").df


@query(f"select event_id, user_id, case when kind = '' then 'none' else kind end as kind from ({_FILL})")
def fill_constant(spark, sf):
    return fill.fill(_gaps(spark, sf), "kind", value="none").df


# Reshape


@query("""
    select l_orderkey, l_linenumber, 'l_discount' as variable, l_discount as value from lineitem
    union all select l_orderkey, l_linenumber, 'l_tax', l_tax from lineitem""")
def melt(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return reshape.melt(rows, "l_orderkey,l_linenumber", "l_*")


@query("""
    select o_orderpriority as priority, coalesce(cast(count(*) filter (where o_orderstatus = 'F') as varchar), '0') as F, cast(count(*) filter (where o_orderstatus = 'O') as varchar) as O, cast(count(*) filter (where o_orderstatus = 'P') as varchar) as P
    from orders group by 1""")
def pivot(spark, sf):
    counts = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).cast("string").alias("n"), F.min("o_orderkey").alias("_ord"))
    return reshape.pivot(counts, "status", "n", "priority", fill="0").select("priority", "F", "O", "P")


@query("""
    select 'r_name' as r_regionkey, max(r_name) filter (where r_regionkey = 0) as "0", max(r_name) filter (where r_regionkey = 1) as "1", max(r_name) filter (where r_regionkey = 2) as "2",
    max(r_name) filter (where r_regionkey = 3) as "3", max(r_name) filter (where r_regionkey = 4) as "4" from region""")
def transpose(spark, sf):
    return reshape.transpose(table(spark, sf, "region"), order="r_regionkey")


# Cells


@query("select p_partkey, cast(cast(p_retailprice as decimal(18,2)) as varchar) as price from part")
def locale_numbers(spark, sf):
    european = F.concat(F.lit("€ "), F.translate(F.format_number(F.col("p_retailprice").cast("decimal(18,2)"), 2), ",.", ".,"))
    rows = table(spark, sf, "part").select("p_partkey", european.alias("price"))
    return cells.numbers_of(rows, "price").df


@query("""
    select p_partkey, cast(cast(round(p, 1) as decimal(18,1)) as varchar) as half_up, cast(cast(floor(p * 10) / 10 as decimal(18,1)) as varchar) as down, cast(cast(round(p / 10) * 10 as decimal(18,0)) as varchar) as tens
    from (select p_partkey, cast(p_retailprice as decimal(18,2)) as p from part)""")
def round_modes(spark, sf):
    price = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    rows = spread(table(spark, sf, "part").select("p_partkey", price.alias("price"))).select("p_partkey", *[F.col("price").alias(c) for c in ("half_up", "down", "tens")])
    rows = cells.rounded(rows, "half_up", 1).df
    return cells.rounded(cells.rounded(rows, "down", 1, "down").df, "tens", -1).df


@query("""
    select p_partkey, case when p_size < 10 then '< 10' when p_size < 25 then '[10, 25)' when p_size < 40 then '[25, 40)' else '>= 40' end as p_size_bin from part""")
def bins(spark, sf):
    return cells.binned(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", "10,25,40", open_ends=True).df.drop("p_size")


@query("""
    select x.label, count(p_size) as "count" from (values ('(0, 10]'), ('(10, 20]'), ('(20, 60]'), ('(60, 99]')) x(label)
    left join (select p_size, case when p_size <= 10 then '(0, 10]' when p_size <= 20 then '(10, 20]' when p_size <= 60 then '(20, 60]' else '(60, 99]' end as label from part) p on p.label = x.label group by x.label""")
def bin_counts(spark, sf):
    return cells.binned(table(spark, sf, "part").select("p_size"), "p_size", "0,10,20,60,99", right=True).counters["bins"]


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as d1, strftime(o_orderdate, '%Y-%m-%d') as d2, strftime(o_orderdate, '%Y-%m-%d') as d3, 'soon' as d4 from orders")
def dates_normalised(spark, sf):
    day = F.col("o_orderdate")
    rows = table(spark, sf, "orders").select("o_orderkey", F.date_format(day, "d/M/yyyy").alias("d1"), F.date_format(day, "MMMM d, yyyy").alias("d2"), F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("d3"), F.lit("soon").alias("d4"))
    return cells.dated(rows, "d1,d2,d3,d4").df


@query("""
    select c_custkey, repeat('*', length(c_name) - 4) || right(c_name, 4) as c_name, '' as c_mktsegment from customer""")
def mask_cells(spark, sf):
    return cells.masked(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_name:mask", "c_mktsegment:blank"])


def _hmac_sql(value: str, salt: str) -> str:
    """The first 12 digits of HMAC-SHA-256 in DuckDB: the padded key is known here."""
    inner, outer = (bytes(k ^ pad for k in salt.encode().ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
    return f"left(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({value})))), 12)"


@query(f"select c_custkey, {_hmac_sql('c_name', 'pepper')} as c_name, {_hmac_sql('c_name', 'pepper')} || '@example.com' as mail from customer")
def mask_tokens(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", F.concat("c_name", F.lit("@Example.COM")).alias("mail"))
    return cells.masked(rows, ["c_name:hash", "mail:email"], salt="pepper")


@query(r"""select c_custkey, regexp_replace(c_name, '^(\w+)#0*(\d+)$', '\2-\1') as c_name from customer""")
def replace_cells(spark, sf):
    return cells.replaced(table(spark, sf, "customer").select("c_custkey", "c_name"), r"^(\w+)#0*(\d+)$", r"\2-\1", "c_name").df


@query("""
    select o_orderkey, 'o_orderpriority' as "column", 'int' as "rule" from orders where not regexp_matches(o_orderpriority, '^[+-]?[0-9]+$')
    union all select o_orderkey, 'o_custkey', 'unique' from orders qualify row_number() over (partition by o_custkey order by o_orderkey) > 1""")
def check_rules(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_custkey", F.col("o_orderdate").cast("date").cast("string").alias("day"))
    return checks.check(rows, ["o_orderpriority:int", "o_custkey:unique", "day:date", "day:required"], order="o_orderkey").select("o_orderkey", "column", "rule")


# Lines, words, JSON, equal contents


@query("""
    select line, n from (select line, count(*) as n from (select unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) as line from documents) where trim(line) <> '' group by line) where n > 1""")
def repeated_lines(spark, sf):
    return lines.repeated(lines.lines_of(table(spark, sf, "documents").withColumnRenamed("doc_id", "_ord"), order=["_ord"]), skip_blank=True, order=["_ord", "_line"]).select("line", "n")


@query("""
    select doc_id, line_no, line from (select *, row_number() over (partition by line order by doc_id, line_no) as rn from (
      select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents)) where rn = 1 and trim(line) <> ''""")
def unique_lines(spark, sf):
    rows = lines.lines_of(table(spark, sf, "documents"), order=["doc_id"])
    return lines.dedupe(rows, skip_blank=True, order=["doc_id", "_line"]).select("doc_id", F.col("_line").alias("line_no"), "line")


@query(r"""
    select word, count(*) as "count" from (select lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*'))) as word from documents) group by word order by 2 desc, word limit 60""")
def top_words(spark, sf):
    return lines.word_counts(table(spark, sf, "documents").select("text"), top=60, exact_case=False)


@query(r"""
    select count(*) as texts, cast(sum(len(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*'))) as bigint) as words, cast(sum(length(text)) as bigint) as chars,
      (select count(distinct lower(w)) from (select unnest(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*')) as w from documents)) as "unique" from documents""")
def word_totals(spark, sf):
    found = lines.word_totals(table(spark, sf, "documents").select("text"), exact_case=False)
    return found.select("texts", "words", "chars", "unique")


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def json_to_table(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("_ord"), F.col("props").alias("text"))
    found = records.records_of(rows)
    named = found.withColumn("record", F.concat(F.lit('{"event_id": '), F.col("_doc").cast("string"), F.lit(', "props": '), "record", F.lit("}")))
    return records.flat_table(named).select(F.col("event_id").cast("long").alias("event_id"), F.col("`props.k`").alias("k"))


@query("""
    select '{"c_custkey": ' || c_custkey || ', "c_name": "' || c_name || '", "c_mktsegment": "' || c_mktsegment || '"}' as value from customer""")
def table_to_json(spark, sf):
    return records.as_json(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"))


@query("""select event_id, '{"k":' || json_extract_string(props, '$.k') || '}' as formatted, cast(null as varchar) as error from events""")
def json_formatted(spark, sf):
    return records.reformatted(table(spark, sf, "events").select("event_id", "props"), "props", indent=None).drop("props")


@query("""
    select strlen(text) as size, sha256(text) as sha256, cast(count(*) as bigint) as n, strlen(text) * (count(*) - 1) as reclaimable from documents where strlen(text) > 0 group by 1, 2 having count(*) > 1""")
def equal_contents(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.octet_length("text").cast("long").alias("length"), F.encode("text", "UTF-8").alias("content"))
    return files.duplicates(rows).select("size", "sha256", F.size("paths").cast("long").alias("n"), "reclaimable")


@query("""
    select page_id, crlf, lf - crlf as lf, cr - crlf as cr,
        case when (crlf > 0)::int + (lf > crlf)::int + (cr > crlf)::int > 1 then 'mixed' when crlf > 0 then 'crlf' when lf > 0 then 'lf' when cr > 0 then 'cr' else 'none' end as style
    from (select page_id, length(html) - length(replace(html, chr(10), '')) as lf, length(html) - length(replace(html, chr(13), '')) as cr, (length(html) - length(replace(html, chr(13) || chr(10), ''))) // 2 as crlf from pages)""")
def line_ends_all(spark, sf):
    """All pages, with all kinds of line ends."""
    rows = table(spark, sf, "pages").select(F.col("page_id").alias("path"), F.encode("html", "UTF-8").alias("content"))
    return files.line_ends(rows).select(F.col("path").alias("page_id"), "crlf", "lf", "cr", "style")


@query("""
    select date_trunc('hour', ts) as window_start, event_type, count(*) as "count" from events group by 1, 2""")
def event_windows(spark, sf):
    return streaming.windowed_counts(table(spark, sf, "events"), "ts", ["event_type"])


@query("select o_orderkey, cast(o_orderdate as date) as day, lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '_', 'g')) as priority from orders")
def parsed_dates_month_first(spark, sf):
    day = F.date_format("o_orderdate", "M/d/yyyy")
    return table(spark, sf, "orders").select("o_orderkey", dates.parsed(day, month_first=True).alias("day"), text.snake(F.col("o_orderpriority")).alias("priority"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """A filter on the scan, exact sums and means of groups."""
    return group_exact(spark, sf)
