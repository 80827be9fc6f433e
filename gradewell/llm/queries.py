"""The registered queries of the training-data operators and their SQL forms."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm import (
    class_lm, context_hash, cross_tokens, decontamination, packing, paragraphs, periodic_runs, permutation_index, quality,
    repeated_bytes, simhash, token_counts, url_lists,
)

CAPACITY = 2048
PACKING_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"
# No unigram model is at hand: the pieces and scores of this one serve as unigram vocabulary.
UNIGRAM_MODEL = PIECE_TOKENIZER


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def grade() -> Column:
    """0 toxic, 1 clean but poor, 2 clean and good; null if a rating is missing."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("toxic") == 0, F.col("quality") + 1)


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_bytes.repeated_bytes(_table(spark, folder, "documents")).drop("spans")


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), tokenizer_path(PACKING_TOKENIZER), CAPACITY)


def op3_class_lm(spark: SparkSession, folder: str) -> DataFrame:
    return class_lm.class_lm_scores(_table(spark, folder, "documents"))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contained_items(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def _words_sql(table: str, key: str) -> str:
    """(key, w): the words of every text, A-Z lower-cased."""
    lower = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"select {key}, list_filter(regexp_split_to_array({lower}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from {table}"


OP4_SQL = f"""
with docs as ({_words_sql("documents", "doc_id")}),
items as (
  select array_to_string(w, ' ') as t, any_value(w) as w, min(item_id) as item_id, count(*) as item_copies
  from ({_words_sql("benchmark", "item_id")}) where len(w) > 0 group by 1),
doc_shingles as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from docs where len(w) > 0)),
item_shingles as (
  select distinct item_id, item_copies, array_to_string(list_slice(w, i, i + 4), ' ') as s
  from (select item_id, item_copies, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from items)),
sizes as (select item_id, item_copies, count(*) as shingles from item_shingles group by all)
select d.doc_id, z.item_id, z.item_copies, count(*) as shared, z.shingles, cast(count(*) as double) / z.shingles as containment
from doc_shingles d join item_shingles i using (s) join sizes z using (item_id)
group by d.doc_id, z.item_id, z.item_copies, z.shingles having count(*) >= 0.8 * z.shingles
"""


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = quality.fit_quality(docs, _table(spark, folder, "labels"), grade(), 3)
    return quality.grade_documents(docs, model)


def op6_permutation_index(spark: SparkSession, folder: str) -> DataFrame:
    return permutation_index.nearest(_table(spark, folder, "embeddings"), 20, query=F.expr("pmod(vec_id, 20) = 0"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = token_counts.load_vocabulary(tokenizer_path(UNIGRAM_MODEL))
    return token_counts.count_tokens(_table(spark, folder, "documents"), vocabulary)


FIRST_DAY = "date'2023-01-01'"


def _number(key: str) -> str:
    """The first 32 bits of the md5 of a string, in Spark SQL."""
    return f"cast(conv(substr(md5({key}), 1, 8), 16, 10) as bigint)"


def block_list(pages: DataFrame) -> DataFrame:
    """A dated list derived from the hosts that the pages come from: hosts listed, taken off
    and listed again, their parent domains, and first folders listed for sixty days."""
    hosts = pages.select(url_lists.url_host(F.col("url")).alias("host"), url_lists.url_path(F.col("url")).alias("path"))
    hosts = hosts.where("host != ''").withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1))
    hosts = hosts.withColumn("folder", F.regexp_extract("path", "^(/[^/]+/)", 1))
    by_host = hosts.select("host").distinct().withColumn("h", F.expr(_number("host")))
    by_domain = hosts.where("domain != ''").select("domain").distinct().withColumn("h", F.expr(_number("domain")))
    by_folder = hosts.where("folder != ''").select(F.concat("host", "folder").alias("folder")).distinct().withColumn("h", F.expr(_number("folder")))

    def entries(rows: DataFrame, kind: str, key: str, when: str, days: str, listed: bool) -> DataFrame:
        return rows.where(when).select(
            F.lit(kind).alias("kind"), F.col(key).alias("key"), F.expr(f"date_add({FIRST_DAY}, cast({days} as int))").alias("since"),
            F.lit(listed).alias("listed"),
        )

    return (
        entries(by_host, "host", "host", "h % 3 = 0", "h % 400", True)
        .unionByName(entries(by_host, "host", "host", "h % 2 = 0", "h % 400 + 30 + (h div 7) % 200", False))
        .unionByName(entries(by_host, "host", "host", "h % 5 = 0", "h % 400 + 300 + (h div 11) % 100", True))
        .unionByName(entries(by_domain, "domain", "domain", "h % 5 = 0", "h % 500", True))
        .unionByName(entries(by_folder, "prefix", "folder", "h % 4 = 0", "h % 600", True))
        .unionByName(entries(by_folder, "prefix", "folder", "h % 4 = 0", "h % 600 + 60", False))
    )


def op8_url_lists(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    captures = pages.withColumn("fetched", F.expr(f"date_add({FIRST_DAY}, cast((page_id * 7919) % 730 as int))"))
    found = url_lists.as_of_blocks(captures, block_list(pages), "page_id", "url", "fetched")
    return found.select(
        F.col("id").alias("page_id"), F.col("fetched_on").cast("string").alias("fetched_on"), "host", "blocked", "kind",
        F.col("key").alias("listed_key"), F.col("listed_from").cast("string").alias("listed_from"),
    )


OP8_SQL = r"""
with captures as (
  select page_id, url, date '2023-01-01' + cast((page_id * 7919) % 730 as integer) as fetched_on,
         lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#]*@)?([^/?#:@]+)', 1)) as host,
         regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1) as found_path
  from pages),
paths as (select *, case when found_path = '' then '/' else found_path end as path from captures),
hosts as (select host, cast('0x' || substr(md5(host), 1, 8) as bigint) as h from (select distinct host from paths where host <> '')),
domains as (
  select domain, cast('0x' || substr(md5(domain), 1, 8) as bigint) as h
  from (select distinct regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) as domain from hosts) where domain <> ''),
folders as (
  select folder, cast('0x' || substr(md5(folder), 1, 8) as bigint) as h
  from (select distinct host || regexp_extract(path, '^(/[^/]+/)', 1) as folder from paths
        where host <> '' and regexp_extract(path, '^(/[^/]+/)', 1) <> '')),
entries as (
  select 'host' as kind, host as key, h % 400 as days, true as listed from hosts where h % 3 = 0
  union all select 'host', host, h % 400 + 30 + (h // 7) % 200, false from hosts where h % 2 = 0
  union all select 'host', host, h % 400 + 300 + (h // 11) % 100, true from hosts where h % 5 = 0
  union all select 'domain', domain, h % 500, true from domains where h % 5 = 0
  union all select 'prefix', folder, h % 600, true from folders where h % 4 = 0
  union all select 'prefix', folder, h % 600 + 60, false from folders where h % 4 = 0),
days as (
  select kind, key, date '2023-01-01' + cast(days as integer) as valid_from, bool_or(listed) as listed
  from entries group by all),
spans as (select *, lead(valid_from) over (partition by kind, key order by valid_from) as valid_to from days),
matches as (
  select p.page_id, s.kind, s.key, s.valid_from,
         row_number() over (partition by p.page_id
           order by case s.kind when 'prefix' then 3 when 'host' then 2 else 1 end desc, length(s.key) desc,
                    s.valid_from desc, s.key desc) as n
  from paths p join spans s on s.listed and s.valid_from <= p.fetched_on and (s.valid_to is null or p.fetched_on < s.valid_to)
   and ((s.kind = 'host' and s.key = p.host)
     or (s.kind = 'domain' and (s.key = p.host or ends_with(p.host, '.' || s.key)))
     or (s.kind = 'prefix' and starts_with(p.host || p.path, s.key) and (ends_with(s.key, '/') or s.key = p.host || p.path))))
select p.page_id, cast(p.fetched_on as varchar) as fetched_on, nullif(p.host, '') as host, m.key is not null as blocked,
       m.kind, m.key as listed_key, cast(m.valid_from as varchar) as listed_from
from paths p left join matches m on p.page_id = m.page_id and m.n = 1
"""


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op10_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return paragraphs.repeated_spans(_table(spark, folder, "documents")).drop("text_hash", "more")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """A tenth of the documents, by a hash of their ids, repeats a stretch of its words from some place to its end.
    A document without an id stays as it is."""
    words = F.expr(r"case when h % 10 = 0 then filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w != '') end")
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h")).withColumn("words", words)
    rows = rows.withColumn("n", F.size("words")).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("a", F.expr("if(n > 0, cast(g % greatest(n, 1) as int), 0)"))
    rows = rows.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    tail = F.expr("slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)")
    edited = F.concat_ws(" ", F.expr("slice(words, 1, a)"), tail)
    return rows.select("doc_id", F.when(F.expr("n > 0"), edited).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = with_periodic_tails(_table(spark, folder, "documents"))
    found = periodic_runs.periodic_runs(docs, 12)
    longest = F.expr("array_min(transform(runs, r -> struct(-r.length as length, r.start as start, r.period as period)))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    found = found.withColumn("top", longest)
    length = -F.col("top.length")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("top.start").alias("start"), length.alias("length"),
        F.col("top.period").alias("period"), F.expr("(1000 * -top.length) div top.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_cross_tokens(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    placed = cross_tokens.aligned(docs, tokenizer_path(BYTE_TOKENIZER), tokenizer_path(PIECE_TOKENIZER))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    found = cross_tokens.with_counts(placed.withColumn("groups_sha256", digest).drop("groups"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_context_hash(spark: SparkSession, folder: str) -> DataFrame:
    found = context_hash.compare_with_next(_table(spark, folder, "documents"))
    return found.withColumn("edited", F.sha2(F.col("edited").cast("binary"), 256)).withColumnRenamed("edited", "edited_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_suffix_dedup, op2_best_fit_packing, op3_class_lm, op4_decontamination, op5_quality_classifier, op6_permutation_index,
        op7_token_counts, op8_url_lists, op9_simhash, op10_paragraphs, op11_periodic_runs, op12_cross_tokens, op13_context_hash,
    )
}
ORACLES: dict[str, str] = {"op4_decontamination": OP4_SQL, "op8_url_lists": OP8_SQL}
