"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import embeddings, importance, jaccard, langid, leaks, licenses, mixing, negatives, packing, toxicity, urls, warc, whitening
from flowloom.llm.common import table
from flowloom.llm.langid import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    rows = docs.select("doc_id", "text", held_out("doc_id", 3, 1).alias("held_out"))
    return langid.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


@query
def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def file_tree(docs: DataFrame) -> DataFrame:
    """`documents` as files: source/language/group/id.txt, with licence files by hash at each of the three levels."""
    kind = F.crc32(F.col("doc_id").cast("string")) % 32
    group = F.concat(F.lit("d"), F.floor(F.col("doc_id") / 64).cast("string"))
    name = F.when(kind < 3, F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    source, lang = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none"))
    path = F.when(kind == 0, F.concat_ws("/", source, name)).when(kind == 1, F.concat_ws("/", source, lang, name)).otherwise(F.concat_ws("/", source, lang, group, name))
    return docs.select("doc_id", "text", path.alias("path"))


@query
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(file_tree(table(spark, sf_dir, "documents")))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return importance.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), target)


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = leaks.flag(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "items", "best_share")


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.rule_entries(spark)).select("page_id", "host", "path", "rule", "verdict")


@query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "rate", "text")


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    model = toxicity.fit(docs, labels)
    rows = docs.select("doc_id", "text", held_out("doc_id", 5, 0).alias("held_out"))
    scored = toxicity.score(rows, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", turned), F.col("vec_id") % 50 == 0)


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.long_form(whitening.whiten(table(spark, sf_dir, "embeddings")))


@query
def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


_REST = "case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end"
_RULES = ", ".join(f"('{r}', '{v}')" for r, v in urls.RULES)
_HOSTS = ", ".join(f"('{h}')" for h in urls.BLOCKED_HOSTS)
ORACLES["op6_url_filter"] = f"""
with split as (
  select page_id,
    translate(coalesce(regexp_extract({_REST}, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1), '') as path
  from pages),
rules(rule, verdict) as (values {_RULES}), blocked(b) as (values {_HOSTS}),
parts as (select rule, verdict, split_part(rule, '/', 1) as rule_host, substr(rule, strpos(rule, '/')) as rule_path from rules),
best as (
  select s.*, (select max(struct_pack(n := length(r.rule), rule := r.rule, verdict := r.verdict)) from parts r
    where (s.host = r.rule_host or ends_with(s.host, '.' || r.rule_host)) and starts_with(s.path, r.rule_path)) as b,
    exists (select 1 from blocked where (s.host = b or ends_with(s.host, '.' || b)) and starts_with(s.path, '/')) as listed
  from split s)
select page_id, host, path, b.rule as rule, coalesce(b.verdict, case when listed then 'block' else 'allow' end) as verdict
from best"""

ORACLES["op8_mixing"] = f"""
with sizes as (select source, count(*)::double as n, pow(count(*)::double, {mixing.FLATTEN}) as w from documents group by source),
rates as (select source, w / sum(w) over () * sum(n) over () / n as rate from sizes),
parts as (
  select d.doc_id, d.source, d.text, r.rate, greatest(ceil(r.rate / {mixing.CHUNK}), 1)::bigint as parts
  from documents d join rates r on d.source is not distinct from r.source),
chunks as (select *, unnest(range(1, parts + 1)) as part from parts),
numbers as (
  select *, ('0x' || substr(md5(concat_ws('|', '{mixing.SEED}', coalesce(doc_id::varchar, ''), part::varchar, coalesce(source, ''), coalesce(md5(text), ''))), 1, 12))::bigint::double / {1 << 48} as u
  from chunks),
steps as (
  select *, list_reduce([{{'p': exp(-rate / parts), 'c': exp(-rate / parts), 'k': case when u < exp(-rate / parts) then 0 else 1 end, 'l': rate / parts, 'u': u}}]
      || list_transform(range(1, 95), lambda i: {{'p': i::double, 'c': 0.0::double, 'k': 0, 'l': 0.0::double, 'u': 0.0::double}}),
    lambda s, i: {{'p': s.p * s.l / i.p, 'c': s.c + s.p * s.l / i.p, 'k': s.k + case when s.u >= s.c + s.p * s.l / i.p then 1 else 0 end, 'l': s.l, 'u': s.u}}).k as n
  from numbers)
select doc_id, source, unnest(range(1, n + 1)) + (part - 1) * 1000 as copy, rate, text from steps where n > 0"""

ORACLES["op10_warc"] = """
with sized as (select page_id, coalesce(strlen(html), 0)::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
first as (select payload_digest, max(page_id) as first from sized where payload_bytes >= 1000 group by 1)
select page_id, payload_bytes, s.payload_digest,
  case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
  case when first is not null and page_id is distinct from first then first end as refers_to
from sized s left join first f on s.payload_digest = f.payload_digest and payload_bytes >= 1000"""

_COMPONENTS = """
walk as (
  select id as node, id as reached from nodes
  union
  select w.node, l.b from walk w join links l on w.reached = l.a)
"""

ORACLES["op2_embedding_near_dedup"] = f"""
with recursive valid as (
  select vec_id as id, label, embedding::double[] as v from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.id as a, b.id as b from valid a join valid b on a.label = b.label and a.id <> b.id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= {embeddings.THRESHOLD}),
nodes as (select distinct a as id from links),
{_COMPONENTS},
components as (select node, min(reached) as component_id from walk group by node),
counts as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(component_id, vec_id) as component_id, vec_id = coalesce(component_id, vec_id) as kept
from embeddings left join counts on a = vec_id left join components on node = vec_id"""

ORACLES["op11_hard_negatives"] = """
with valid as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding::double[], lambda x: floor(256 * x)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding::double[], lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.id as anchor_id, b.id as other, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from valid a join valid b on a.id <> b.id and len(a.v) = len(b.v) where a.id % 50 = 0),
positives as (
  select anchor_id, other as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, other)::int as rank,
  other as negative_id, positive_score, score as negative_score
from positives p join scored s on p.anchor_id = s.anchor_id and not same
  and 100 * score >= 50 * positive_score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, other) <= 3"""

#: Sets of shingles of five words as the join takes them, for SQL.
_SETS = r"""
words as (select doc_id as id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where doc_id is not null),
sets as (
  select id, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words)"""

ORACLES["op7_jaccard_join"] = f"""
with recursive {_SETS},
tokens as (select id, len(s) as n, unnest(s) as t from sets),
common as (select a.id as a, b.id as b, a.n + b.n - count(*) as u, count(*) as c from tokens a join tokens b on a.t = b.t and a.id <> b.id group by a.id, b.id, a.n, b.n),
links as (select a, b from common where c / u >= {jaccard.THRESHOLD}),
nodes as (select distinct a as id from links),
{_COMPONENTS},
components as (select node, min(reached) as component_id from walk group by node),
counts as (select a, count(*) as n from links group by a)
select doc_id, coalesce(component_id, doc_id) as component_id, coalesce(n, 0)::bigint as n_links, doc_id = coalesce(component_id, doc_id) as kept
from documents left join counts on a = doc_id left join components on node = doc_id"""
