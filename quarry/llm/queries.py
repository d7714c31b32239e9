"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import oracle
from quarry.llm.common import table


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _remainder(n: int):
    """crc32 of doc_id as text, mod n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), _path("byte_bpe_50k.json"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.lm import score

    return score(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.quality import judged

    return judged(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.near_dups import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.html_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), _path("byte_bpe_50k.json"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.token_files import digests, read_tokens, write_tokens

    return digests(read_tokens(spark, write_tokens(table(spark, sf_dir, "documents"), _path("word_bpe_49k.json"))))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.langid import fit, identify

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs, _remainder(4) != 2))
    return found.select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_sharding, op3_decontamination, op4_lm_scoring, op5_quality_rules, op6_near_dedup, op7_html_text, op8_packing, op9_token_files, op10_language_id)}
ORACLE_SQL: dict[str, str] = {"op2_sharding": oracle.SHARDING, "op6_near_dedup": oracle.NEAR_DEDUP}
