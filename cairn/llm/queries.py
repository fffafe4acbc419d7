"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import ann, exactdup, langid, mixing, neardup, packing, quality, sharding, tokenfile, toxicity
from cairn.llm.common import crc_mod, table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    model = langid.train(docs.where(~held_out))
    found = langid.predict(docs, model, spans=False)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard(table(spark, sf_dir, "documents"), 16)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ratios = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.resample(docs, ratios).select("doc_id", "log_weight", "n_grams", "kept")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = tokenfile.roundtrip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_groups(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = toxicity.train(docs, labels.where(~held_out))
    return toxicity.score(docs, model, locate=False).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language, op2_mixing, op3_neighbours, op4_sharding, op5_quality, op6_near_duplicates, op7_packing, op8_token_file, op9_exact_duplicates, op10_toxicity)
}

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

ORACLE: dict[str, str] = {
    "op2_mixing": f"""
with r as (
  select doc_id, source, {_WORDS}::bigint as size, count(*) over (partition by doc_id) as same_id,
         md5(coalesce(doc_id::varchar, '') || ':17:' || coalesce(source, '') || ':' || md5(coalesce(text, ''))) as k
  from documents
), n as (
  select *, row_number() over (partition by k) as j from r
), d as (
  select doc_id, source, size,
         ('0x' || substr(case when doc_id is not null and same_id = 1 then md5(doc_id::varchar || ':17') else md5(k || ':' || j::varchar) end, 1, 13))::bigint as h
  from n
), s0 as (
  select source, sum(size)::bigint as source_size from d group by source
), s1 as (
  select source, source_size, [3.0, 1.0, 2.0][((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1)::int]::double as w,
         (2.0 * source_size)::double as cap
  from s0
), s2 as (select *, cap / w as cap_ratio from s1
), s3 as (
  select *, coalesce(sum(cap) over o, 0.0) as before, sum(w) over () - coalesce(sum(w) over o, 0.0) as w_left,
         1.5 * sum(source_size) over () as budget
  from s2 window o as (order by cap_ratio, encode(source) nulls last rows between unbounded preceding and 1 preceding)
), s4 as (select *, (budget - before) / w_left as level from s3
), s5 as (select *, (select arg_min(level, cap_ratio) from s4 where level <= cap_ratio) as lv from s4
), s as (
  select source, source_size, least(cap, coalesce(lv * w, cap))::double as target,
         case when source_size > 0 then floor(least(cap, coalesce(lv * w, cap)) / source_size) else 0 end::bigint as whole
  from s5
), t as (select *, target - whole * source_size as rest from s
), e as (
  select d.*, t.source_size, t.target, t.whole, t.rest,
         sum(size) over (partition by d.source order by h) as run, sum(size) over (partition by d.source, h) as here
  from d join t on d.source is not distinct from t.source
), f as (
  select *, case when rest <= 0 then false when run < rest then true
                 when run - here >= rest then false else rest - (run - here) >= here - (rest - (run - here)) end as extra
  from e
)
select doc_id, size, source_size, target, ((whole + extra::int) * size)::bigint as taken from f
""",
    "op9_exact_duplicates": r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents
)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
       row_number() over w = 1 as kept, text_sha256
from d window w as (partition by text_sha256 order by n desc, doc_id nulls last)
""",
}
