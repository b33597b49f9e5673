"""The numbered queries, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberline.llm import conversation, decontaminate, fingerprint, html, neardup, pii, quality, sharding, simhash, tokenfile, treebpe, viterbi, whitening
from emberline.llm.common import table


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85, width=5)


def op2_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op3_lstm_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages"))


def op4_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op5_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenfile.new_folder(spark, "op6")
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), folder, end_id=1)
    return tokenfile.read_tokens(spark, folder)


def op7_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treebpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op10_improbable_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op11_earley_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.repair_damaged(table(spark, sf_dir, "conversations"))


def op12_welford_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_minhash_groups, op2_bootstrapped_pii, op3_lstm_main_text, op4_rendezvous_sharding, op5_viterbi_counts, op6_token_files, op7_qgram_decontamination, op8_attention_quality, op9_tree_bpe, op10_improbable_digest, op11_earley_repair, op12_welford_whitening, op13_simhash_groups)}

_UPPER, _LOWER = (bytes(range(a, a + 26)).decode() for a in (65, 97))
#: The links of operator 1 by counting the shingles that two documents share, and the least document that links lead to.
ORACLE_SQL: dict[str, str] = {
    "op1_minhash_groups": f"""with recursive words as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text,''),'{_UPPER}','{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
    sets as (select doc_id, case when len(w)=0 then [] when len(w)<5 then [array_to_string(w,' ')] else list_distinct(list_transform(range(1, len(w)-3), lambda i: array_to_string(w[i:i+4],' '))) end as s from words),
    held as (select doc_id, unnest(s) as h from sets),
    common as (select x.doc_id as a, y.doc_id as b, count(*) as k from held x join held y on x.h=y.h and x.doc_id<y.doc_id group by 1,2),
    links as (select a, b from common join sets x on x.doc_id=a join sets y on y.doc_id=b where 100*k >= 85*(len(x.s)+len(y.s)-k)),
    edges as (select a, b from links union select b, a from links),
    reach as (select a, b from edges union select reach.a, edges.b from reach join edges on edges.a=reach.b)
    select doc_id, cast(len(s) as bigint) as n_shingles, least(doc_id, coalesce(low, doc_id)) as component_id, least(doc_id, coalesce(low, doc_id))=doc_id as kept from sets left join (select a, min(b) as low from reach group by a) on a=doc_id""",
}
