"""The registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import decontamination, licenses, line_dedup, packing, quality, shared, simhash, substring_dedup, suffix_dedup, toxicity, warc

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.size("items").cast("long").alias("n_items"), F.col("items.item_id").alias("item_ids"), F.col("items.n_windows").alias("n_windows"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = shared.table(quality.rule_statistics(_table(spark, sf_dir, "documents")))
    return quality.judge(stats, quality.fit_statistics(stats, _table(spark, sf_dir, "labels")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archived(_table(spark, sf_dir, "pages"))
    return records.select(F.col("source_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_source_id").alias("refers_to"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "n_sentences", F.size("hits").cast("long").alias("n_hits"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_packing": op2_packing,
    "op3_decontamination": op3_decontamination,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_simhash": op6_simhash,
    "op7_warc": op7_warc,
    "op8_toxicity": op8_toxicity,
    "op9_license_scan": op9_license_scan,
    "op10_suffix_dedup": op10_suffix_dedup,
}

#: By whole windows, lines, payloads and strings; the pairs of op4 are narrowed by counts of letters first, which an edit changes by two at most.
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
starts as (select doc_id, unnest(range(1, len(w) - 48)) as s, w from docs where len(w) >= 50),
windows as (select doc_id, s, md5_number(array_to_string(w[s:s + 49], ' ')) as h from starts),
firsts as (select h, min(doc_id) as m from windows group by h having count(*) > 1),
gone as (select distinct doc_id, unnest(range(s, s + 50)) as pos from windows join firsts using (h) where doc_id > m),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from docs),
kept as (select doc_id, string_agg(word, ' ' order by pos) as text from words anti join gone using (doc_id, pos) group by doc_id),
removed as (select doc_id, count(*) as n from gone group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(text, '')) as kept_sha256
from docs left join kept using (doc_id) left join removed using (doc_id)""",
    "op4_line_dedup": r"""
with recursive docs as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
lines as (select * from (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as pos from docs) where regexp_matches(line, '[^\x20\x09-\x0D]')),
firsts as (select line, length(line) as n, min(row(doc_id, pos)) as first,
  [len(string_split(line, c)) for c in ['e', 't', 'n', 'a', 'i', 'h', 'o', 'r', 's', ' ']] as counts from lines group by line),
pairs as (select a.line as a, b.line as b from (select *, unnest([n - 2, n - 1, n, n + 1, n + 2]) as other from firsts where n >= 20) a join firsts b on b.n = a.other and b.n >= 20
  where a.line <> b.line and list_sum(list_transform(range(1, 11), lambda k: abs(a.counts[k] - b.counts[k]))) <= 4 and levenshtein(a.line, b.line) <= 2),
reach(line, other) as (select a, b from pairs union select line, b from reach join pairs on other = a),
roots as (select line, min(first) as root from (select line, first from firsts union all select r.line, f.first from reach r join firsts f on r.other = f.line) group by line),
gone as (select doc_id, pos from lines join roots using (line) where row(doc_id, pos) <> root),
every as (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as pos from docs),
kept as (select doc_id, string_agg(line, chr(10) order by pos) as text from every anti join gone using (doc_id, pos) group by doc_id),
removed as (select doc_id, count(*) as n from gone group by doc_id)
select doc_id, cast(len(l) as bigint) as n_lines, coalesce(n, 0) as n_removed, sha256(coalesce(text, '')) as kept_sha256 from docs left join kept using (doc_id) left join removed using (doc_id)""",
    "op7_warc": r"""
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
q as (select page_id, cast(octet_length(payload) as bigint) as payload_bytes, sha1(payload) as payload_digest, max(page_id) over (partition by sha256(payload)) as leader from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id <> leader then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> leader then leader end as refers_to from q""",
    "op10_suffix_dedup": r"""
with docs as (select doc_id, encode(coalesce(text, '')) as b from documents),
starts as (select doc_id, unnest(range(1, octet_length(b) - 398)) as s, b from docs where octet_length(b) >= 400),
windows as (select doc_id, s, md5_number(b[s:s + 399]) as h from starts),
twice as (select h from windows group by h having count(*) > 1),
hits as (select doc_id, s, lag(s) over (partition by doc_id order by s) as before from windows semi join twice using (h)),
runs as (select doc_id, s, sum(case when before is null or s - before > 400 then 1 else 0 end) over (partition by doc_id order by s) as run from hits),
spans as (select doc_id, run, min(s) as a, max(s) + 400 as z from runs group by doc_id, run),
edges as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 1) as since from spans),
parts as (select doc_id, since as a, a as z from edges union all select doc_id, max(z), null from spans group by doc_id),
kept as (select doc_id, string_agg(hex(case when p.z is null then b[p.a:] when p.z > p.a then b[p.a:p.z - 1] else ''::blob end), '' order by p.a) as t from parts p join docs using (doc_id) group by doc_id),
removed as (select doc_id, sum(z - a) as n, count(*) as spans from spans group by doc_id)
select doc_id, cast(octet_length(b) as bigint) as n_bytes, cast(coalesce(n, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans, sha256(case when t is null then b else unhex(t) end) as kept_sha256
from docs left join kept using (doc_id) left join removed using (doc_id)""",
}
