"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from tallyframe.llm import bpe, dac, divergence, jaccard, negatives, oracles, packing, quality, rules, search, secrets, toxicity, urls, warc
from tallyframe.llm._common import scratch, table

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op2_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(warc.read_archives(spark, path))
    rows = captures.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(
        F.col("metadata.page_id").alias("page_id"),
        F.coalesce("response.payload_bytes", "metadata.payload_length").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        warc.referred_page(F.col("response.refers_to")).alias("refers_to"),
    )


def op3_bpe_codec(spark: SparkSession, sf_dir: str, tokenizer_path: str = public_tokenizers.path(WORD_BPE)) -> DataFrame:
    docs = bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path)
    return docs.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_retrieval_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str = public_tokenizers.path(WORD_BPE)) -> DataFrame:
    found = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path, end_id=2)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.components(table(spark, sf_dir, "documents"), k=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


#: The least score of a document that is taken to be good.
GOOD = 0.3


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, net)
    return scored.select(
        "doc_id", F.coalesce(quality.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= GOOD, 1).otherwise(0).alias("predicted")
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_documents(table(spark, sf_dir, "documents"))
    base = [kind for kind, *_ in secrets.BASE_RULES]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, base),
        F.sha2(joined(F.filter("spans", lambda s: s.kind.isin(base))).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.measure_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *rules.BASE, "base_failed", "kept")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge_urls(pages, urls.flagged_hosts(pages))


def op10_token_files(spark: SparkSession, sf_dir: str, tokenizer_path: str = public_tokenizers.path(BYTE_BPE)) -> DataFrame:
    path = scratch(spark, "token-files")
    dac.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path, end_id=0)
    return dac.read_token_files(spark, path)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=10, ranks=10)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label, positives=5, negatives=10, low=30, high=90, scale=256)


#: The least score of a document that is taken to be toxic.
TOXIC = 0.7


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(toxicity.fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", F.when(F.col("score") >= TOXIC, 1).otherwise(0).alias("predicted"), "threshold", "flagged")


QUERIES = {
    "op1_topk_search": op1_topk_search,
    "op2_warc_captures": op2_warc_captures,
    "op3_bpe_codec": op3_bpe_codec,
    "op4_retrieval_packing": op4_retrieval_packing,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality_rules": op8_quality_rules,
    "op9_url_filters": op9_url_filters,
    "op10_token_files": op10_token_files,
    "op11_source_divergence": op11_source_divergence,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_toxicity": op13_toxicity,
}

_RULES_SQL = ", ".join(f"('{k}', '{k.split('/', 1)[0]}', '/{k.split('/', 1)[1]}', '{v}')" for k, v in urls.RULES.items())
_WORDS_SQL = ", ".join(f"'{w}'" for w in urls.FLAGGED_WORDS)

#: What SQL can express; the others are tested against brute force in ``tests/llm``.
ORACLE_SQL: dict[str, str] = {
    "op1_topk_search": """with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, d.vec_id, list_inner_product(q.e, d.e)::bigint as score from v q join v d on q.vec_id % 20 = 0 and q.vec_id <> d.vec_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s) select * from r where rank <= 20""",
    "op2_warc_captures": """with p as (select page_id, coalesce(html, '') as h from pages), g as (select *, sha1(h) as x, max(page_id) over (partition by h) as m from p)
select page_id, strlen(h) as payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
 ((('0x' || substr(x, (i // 4 * 5 + 1)::int, 5))::bigint >> ((3 - i % 4) * 5)::int) & 31)::int + 1, 1)), 'string_agg', '') as payload_digest,
case when page_id = m then 'response' else 'revisit' end as record_type, case when page_id <> m then m end as refers_to from g""",
    "op5_jaccard_join": oracles.jaccard_sql(k=3, percent=90),
    "op7_secret_scan": oracles.secrets_sql(),
    "op8_quality_rules": oracles.rules_sql(),
    "op12_hard_negatives": """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as anchor_id, d.vec_id, q.label = d.label as same, list_inner_product(q.e, d.e)::bigint as score from v q join v d on q.vec_id % 100 = 0 and q.vec_id <> d.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score qualify rank <= 10""",
    "op11_source_divergence": oracles.divergence_sql(),
    "op9_url_filters": f"""with p as (select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
r as (select * from (values {_RULES_SQL}) t(rule, rhost, rpath, says)),
w as (select page_id, string_split(host, '.') as labels, list_position(list_transform(string_split(host, '.'), lambda x: list_has_any(string_split(x, '-'), [{_WORDS_SQL}])), true) as k from p),
f as (select page_id, arg_max(rule, length(rule)) as rule, arg_max(says, length(rule)) as says from p join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by 1),
l as (select page_id, array_to_string(labels[k:], '.') as listed from w where k > 0)
select page_id, host, path, rule, listed, coalesce(says, case when listed is not null then 'block' else 'allow' end) as verdict from p left join f using (page_id) left join l using (page_id)""",
}
