"""The registered queries of the operators: whole tables, production parameters, digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm import (
    decontamination,
    divergence,
    hilbert,
    langid,
    licenses,
    mixing,
    phrases,
    pii,
    quality,
    repeats,
    simhash,
    superminhash,
    toxicity,
)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(function):
    QUERIES[function.__name__] = function
    return function


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_query
def op1_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


@_query
def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_spans(documents(spark, sf_dir)))


@_query
def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.find_repeats(documents(spark, sf_dir)).drop("runs")


@_query
def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text", "lang")
    model = langid.train(rows.where("not held_out and lang is not null"))
    return langid.predict(rows.drop("lang"), model, ["doc_id", "held_out"])


@_query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(documents(spark, sf_dir)))


@_query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    model = toxicity.train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    scored = toxicity.score(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@_query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir).select("doc_id", "lang", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "class_distance", "word_distance",
    )


@_query
def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hilbert.placed(documents(spark, sf_dir), shards=8)
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return rows.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown, "curve")


@_query
def op10_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(documents(spark, sf_dir))


@_query
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@_query
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


SQL["op12_phrases"] = r"""
with pieces as (
  select coalesce(lang, 'und') lang, doc_id, row_number() over () as row_id,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) piece
  from documents),
numbered as (select lang, row_number() over () as piece_id, regexp_extract_all(piece, '[^\x20\x09]+') ws from pieces),
words as (select lang, piece_id, unnest(ws) w, generate_subscripts(ws, 1) i from numbered),
grams as (
  select lang, w w1, lead(w) over p w2, lead(w, 2) over p w3 from words window p as (partition by piece_id order by i)),
f1 as (select lang, w1, count(*) f from grams group by all),
f2 as (select lang, w1, w2, count(*) f from grams where w2 is not null group by all),
f3 as (select lang, w1, w2, w3, count(*) f from grams where w3 is not null group by all),
n as (select lang, count(*) n from words group by lang),
c3 as (
  select f3.lang, f3.w1, f3.w2, f3.w3, f3.f a, a1.f l1, b1.f r1, a2.f l2, b2.f r2,
         (1000000::hugeint * f3.f * f3.f) // (a1.f::hugeint * b1.f) s1,
         (1000000::hugeint * f3.f * f3.f) // (a2.f::hugeint * b2.f) s2
  from f3 join f1 a1 on f3.lang = a1.lang and f3.w1 = a1.w1
  join f2 b1 on f3.lang = b1.lang and f3.w2 = b1.w1 and f3.w3 = b1.w2
  join f2 a2 on f3.lang = a2.lang and f3.w1 = a2.w1 and f3.w2 = a2.w2
  join f1 b2 on f3.lang = b2.lang and f3.w3 = b2.w1
  where f3.f >= 10),
covers as (
  select lang, w1, w2, max(a) longer
  from (select lang, w1, w2, a from c3 union all select lang, w2, w3, a from c3) group by all),
scored as (
  select f2.lang, f2.w1 || ' ' || f2.w2 phrase, f2.f a, x.f l, y.f r,
         ((1000000::hugeint * f2.f * f2.f) // (x.f::hugeint * y.f))::bigint score
  from f2 join f1 x on f2.lang = x.lang and f2.w1 = x.w1 join f1 y on f2.lang = y.lang and f2.w2 = y.w1
  left join covers on f2.lang = covers.lang and f2.w1 = covers.w1 and f2.w2 = covers.w2
  where f2.f >= 10 and (longer is null or 100 * longer < 50 * f2.f)
  union all
  select lang, w1 || ' ' || w2 || ' ' || w3, a, case when s1 <= s2 then l1 else l2 end, case when s1 <= s2 then r1 else r2 end,
         least(s1, s2)::bigint
  from c3),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from scored)
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000
"""


@_query
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


SQL["op13_divergence"] = r"""
with docs as (
  select coalesce(lang, '') lang, coalesce(source, '') source, row_number() over () as row_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') ws
  from documents),
terms as (select lang, source, row_id, unnest(ws) term from docs),
kept as (select lang, term, count(*) c from terms group by all having count(distinct row_id) >= 30),
v as (select lang, count(*) v, sum(c) n from kept group by lang),
counts as (select lang, source, term, count(*) c from terms join kept using (lang, term) group by all),
sizes as (select lang, source, sum(c) n from counts group by all),
groups as (
  select lang, source, coalesce(sizes.n, 0)::hugeint n, coalesce(v.v, 0)::hugeint v
  from (select distinct lang, source from docs) left join sizes using (lang, source) left join v using (lang)),
p as (
  select lang, source, term, coalesce(counts.c, 0) c, 1 + 1000000000::hugeint * (coalesce(counts.c, 0) + 5) // (n + 5 * v) p
  from groups join kept using (lang) left join counts using (lang, source, term)),
pairs as (
  select a.lang, a.source, b.source item, coalesce(sum(abs(x.p - y.p)), 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join p x on x.lang = a.lang and x.source = a.source
  left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term
  group by all),
over as (
  select p.lang, p.source, p.term item, (p - (1 + 1000000000::hugeint * (kept.c + 5) // (v.n + 5 * v.v)))::bigint as value
  from p join kept using (lang, term) join v using (lang) where p.c > 0),
parts as (
  select *, 'pair' part from pairs union all select *, 'term' from over where value > 0),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item)::integer as rank from parts)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50
"""
