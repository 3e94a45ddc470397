"""The registered queries of the operators, each over a whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginflow.llm import (
    decontaminate,
    jaccard,
    language,
    lines,
    middle,
    mixing,
    paragraphs,
    sharding,
    simhash,
    sql,
    tokens,
    urls,
    whitening,
)
from marginflow.llm.frames import saved, stored
from marginflow.llm.quality import quality_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_quality_rules", sql.QUALITY_RULES)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, with_text=False, keep=["doc_id"])


@query("op6_sharding")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near-equal bytes for all documents."""
    return sharding.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op8_source_mix", sql.SOURCE_MIX)
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document, and the output shard of each copy."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    shards = F.concat_ws(",", F.col("shards").cast("array<string>"))
    return mixing.mix(docs, carry=["doc_id"]).select(
        "doc_id", "size", "source_size", "target", "taken", shards.alias("shards")
    )


@query("op9_url_filters", sql.URL_FILTERS)
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the list entries that held on its fetch day."""
    pages = table(spark, sf_dir, "pages")
    captures, entries = urls.derived_captures(pages), urls.derived_entries(pages)
    return urls.filter_urls(captures, entries).drop("url")


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query("op1_token_counts")
def op1_token_counts(
    spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY
) -> DataFrame:
    """What every text length of the corpus answers as a context limit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = tokens.token_counts(docs, vocabulary, keep=["doc_id"])
    # Written once, as the sums read it twice and the texts behind it should be read once.
    return tokens.context_limits(saved(tokens.length_histogram(counts)))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.language_id(docs).select("doc_id", "held_out", "lang_pred", "score")


@query("op4_ngram_jaccard_join")
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op10_line_dedup")
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat an earlier line."""
    return lines.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op2_benchmark_decontamination")
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.benchmark_hits(docs, table(spark, sf_dir, "benchmark"))


@query("op3_substring_dedup")
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages that are repeated, and which of them go."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return paragraphs.substring_dedup(docs)


@query("op11_fill_middle", sql.FILL_MIDDLE)
def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut and rearranged form of every document, by the digests of output and restored text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # The frames are compressed already.
    framed = stored(middle.frame_texts(docs, keep=["doc_id"]), "none")
    return middle.digests(middle.fill_middle(framed))


@query("op12_simhash")
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding along the first 32 components, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
