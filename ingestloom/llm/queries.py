"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ingestloom.llm.importance import select_documents

    return select_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ingestloom.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_cover_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ingestloom.llm.covertree import top_inner_products

    return top_inner_products(_table(spark, sf_dir, "embeddings"))


OP3_SQL = """
with usable as (
    select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as v
    from embeddings
    where vec_id is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), scored as (
    select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
    from usable q join usable c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id
), ranked as (
    select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ingestloom.llm.lines_crf import apply_rules, train_on_labels

    docs = _table(spark, sf_dir, "documents")
    return apply_rules(docs, train_on_labels(docs, _table(spark, sf_dir, "labels")))


def op5_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ingestloom.llm.secrets import scan_secrets

    return scan_secrets(_table(spark, sf_dir, "documents"), vocabulary=public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ingestloom.llm.pii import scan_pii

    return scan_pii(_table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ingestloom.llm.mixing import mix_documents

    return mix_documents(_table(spark, sf_dir, "documents"))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ingestloom.llm.substrings import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ingestloom.llm.fuzzy_lines import line_digests

    return line_digests(_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ingestloom.llm.bpe import round_trip_digests

    return round_trip_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ingestloom.llm import scratch
    from ingestloom.llm.tokenfile import token_digests, write_tokens

    folder = scratch.folder(spark)
    write_tokens(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_digests(spark, folder)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ingestloom.llm.lexical import rank_documents

    return rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
with d as (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from documents
), c as (select doc_id, term, count(*) as tf from d group by all),
n as (select doc_id, cast(sum(tf) as bigint) as n from c group by doc_id),
s as (select count(*) as docs, cast(sum(n) as bigint) as terms from n),
q as (
    select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark
), w as (
    select term, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / (2 * df + 1))) as bigint) as w
    from (select term, count(*) as df from c where term in (select term from q) group by term), s
), scored as (
    select q.item_id, c.doc_id, cast(sum(w.w * ((1000000000 * c.tf) // (1000 * c.tf + 20 * (50 + ((50 * n.n * s.docs) // s.terms))))) as bigint) as score
    from q join w using (term) join c using (term) join n using (doc_id), s group by all
)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
from scored where score > 0 qualify rank <= 50
"""


def op13_prefix_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ingestloom.llm.tries import prefix_nodes

    return prefix_nodes(_table(spark, sf_dir, "conversations"))


OP13_SQL = """
with crc_table as (
    select list(v order by i) as crcs
    from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1))) as v from (select unnest(range(0, 256)) as i))
), t as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
        row_number() over (partition by conv_id order by turn nulls first, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as nth
    from conversations where conv_id is not null
), c as (
    select conv_id, conv_id - conv_id % 5 as base,
        xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ord(x) as bigint))), lambda a, x: xor(a >> 8, crcs[(xor(a, x) & 255) + 1]))) % 9 as h
    from (select distinct conv_id from t), crc_table
), turns as (
    select c.conv_id, t.nth, role, text from c join t on t.conv_id = c.base and t.nth <= c.h
    union all
    select c.conv_id, t.nth, role, text from c join t on t.conv_id = c.conv_id and t.nth > c.h
), rebuilt as (
    select c.conv_id, coalesce(list({'role': role, 'text': text} order by nth) filter (nth is not null), []) as turns from c left join turns using (conv_id) group by c.conv_id
), steps as (
    select conv_id, d as depth, turns[1:d] as prefix, len(turns) = d as is_end, coalesce(octet_length(encode(turns[d].text)), 0) as n_bytes
    from (select conv_id, turns, unnest(range(0, len(turns) + 1)) as d from rebuilt)
), nodes as (
    select prefix, depth, min(conv_id) as conv_id, count(*) as n_convs, max(n_bytes) as n_bytes, coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (is_end), '') as ends
    from steps group by prefix, depth
), children as (select prefix[1:depth - 1] as prefix, depth - 1 as depth, count(*) as n_children from nodes where depth > 0 group by all),
below as (
    select a.prefix, a.depth, sum(case when c.n_children is null then 1 else 0 end) as n_leaves, sum((b.n_convs - 1) * b.n_bytes) as saved
    from nodes a join nodes b on b.depth >= a.depth and b.prefix[1:a.depth] = a.prefix left join children c on c.prefix = b.prefix and c.depth = b.depth group by a.prefix, a.depth
)
select n.conv_id, cast(n.depth as bigint) as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n_children, 0) as n_children, cast(b.n_leaves as bigint) as n_leaves, cast(b.saved as bigint) as saved_tokens, sha256(n.ends) as ends_sha256
from nodes n join below b on b.prefix = n.prefix and b.depth = n.depth left join children c on c.prefix = n.prefix and c.depth = n.depth
left join nodes p on p.depth = n.depth - 1 and p.prefix = n.prefix[1:n.depth - 1]
"""


QUERIES = {f.__name__: f for f in (op1_importance_resampling, op2_simhash_near_dedup, op3_cover_tree_top_k, op4_line_crf, op5_guess_cost_secrets, op6_pii, op7_mix_sources, op8_repeated_passages, op9_fuzzy_lines, op10_byte_bpe, op11_rans_token_files, op12_ranked_search, op13_prefix_tries)}
ORACLE_SQL: dict[str, str] = {"op3_cover_tree_top_k": OP3_SQL, "op12_ranked_search": OP12_SQL, "op13_prefix_tries": OP13_SQL}
