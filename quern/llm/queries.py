"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quern.llm import codes_sql
from quern.llm.common import read_table
from quern.llm.exact_dedup import exact_dedup
from quern.llm.interpolation import interpolated_scores
from quern.llm.language import identify
from quern.llm.lexicon import encode_decode
from quern.llm.media import wav_fingerprints
from quern.llm.mixing import mix
from quern.llm.packing import pack
from quern.llm.quality import classify
from quern.llm.simhash import near_duplicates
from quern.llm.spelling import variants
from quern.llm.surrogates import replace_entities
from quern.llm.token_files import round_trip
from quern.llm.vector_codes import compress


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_scores(read_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(read_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wav_fingerprints(read_table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(read_table(spark, sf_dir, "embeddings")).drop("label")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_token_files, op3_interpolation, op4_quality, op5_simhash, op6_surrogates, op7_bpe, op8_media, op9_language, op10_mixing, op11_vector_codes, op12_packing, op13_spelling)}

ORACLE_SQL = {
    "op1_exact_dedup": r"""
        with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as text from documents),
        g as (select text, min(doc_id) as keep_id, count(*) as group_size from t group by text)
        select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.text) as text_sha256
        from t join g on t.text = g.text
    """,
    "op11_vector_codes": codes_sql.sql(),
}
