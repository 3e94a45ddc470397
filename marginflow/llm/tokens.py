"""Token counts: an exact length histogram whose suffix sums answer every context limit."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marginflow.llm.frames import append_columns, slices

# Word split of the byte-level vocabularies; a fixed value that belongs to them.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_VOCABULARY_BYTES = 32 * 1024 * 1024
BATCH_BYTES = 4 * 1024 * 1024
STEP = 4096  # lengths summed up together before the running sums

_ENCODERS: dict[str, Callable[[Sequence[str]], list[int]]] = {}


def read_vocabulary(spark: SparkSession, path: str) -> bytes:
    """Contents of a tokenizer file, of at most MAX_VOCABULARY_BYTES."""
    if "://" in path:
        files = spark.read.format("binaryFile").load(path)
        if files.select("length").first()[0] > MAX_VOCABULARY_BYTES:
            raise ValueError(f"{path} is too large for a vocabulary")
        return bytes(files.select("content").first()[0])
    with open(path, "rb") as file:
        content = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is too large for a vocabulary")
    return content


def encoder(content: bytes, kind: str, split: str = SPLIT) -> Callable[[Sequence[str]], list[int]]:
    """Function from texts to their numbers of tokens, without special tokens.

    `kind` is the file's suffix: `tiktoken` (ranks), `json` (tokenizers), `model`
    (sentencepiece). It is made once per worker process.
    """
    key = hashlib.sha256(content + kind.encode() + split.encode()).hexdigest()
    if key in _ENCODERS:
        return _ENCODERS[key]
    if kind == "tiktoken":
        import tiktoken

        pairs = (line.split() for line in content.splitlines() if line)
        ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        coder = tiktoken.Encoding(key, pat_str=split, mergeable_ranks=ranks, special_tokens={})

        def count(texts):
            return [len(coder.encode_ordinary(t)) for t in texts]

    elif kind == "json":
        from tokenizers import Tokenizer

        model = Tokenizer.from_str(content.decode())
        model.encode_special_tokens = True

        def count(texts):
            return [len(model.encode(t, add_special_tokens=False).ids) for t in texts]

    elif kind == "model":
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=content)

        def count(texts):
            return [len(ids) for ids in pieces.encode(list(texts), num_threads=1)]

    else:
        raise ValueError(f"unknown kind of vocabulary: {kind}")
    _ENCODERS[key] = count
    return count


def token_counts(
    docs: DataFrame, vocabulary: str, text: str = "text", keep: Sequence[str] | None = None
) -> DataFrame:
    """Every document with `n_tokens`, the length of its whole text in tokens of `vocabulary`.

    A null or empty text has 0 tokens. Rows stay where they are; repeated rows count alike. An
    input column `n_tokens` is replaced. The vocabulary file is broadcast; its size is bounded.
    """
    content = docs.sparkSession.sparkContext.broadcast(
        read_vocabulary(docs.sparkSession, vocabulary)
    )
    kind = vocabulary.rsplit(".", 1)[-1]

    def compute(batch: pa.RecordBatch) -> dict:
        count = encoder(content.value, kind)
        texts = batch.column(batch.schema.get_field_index(text))
        found: list[int] = []
        for start, end in slices(texts, BATCH_BYTES):
            found += count([t or "" for t in texts[start:end].to_pylist()])
        return {"n_tokens": found}

    columns = list(docs.columns if keep is None else keep)
    source = docs.select(*dict.fromkeys([*columns, text]))
    return append_columns(
        source, T.StructType([T.StructField("n_tokens", T.LongType())]), compute, columns
    )


def length_histogram(counts: DataFrame, length: str = "n_tokens") -> DataFrame:
    """(`n_tokens`, `n_docs`): documents by length. Tasks combine their rows before the shuffle."""
    return (
        counts.filter(F.col(length).isNotNull())
        .groupBy(F.col(length).alias("n_tokens"))
        .agg(F.count(F.lit(1)).alias("n_docs"))
    )


def context_limits(histogram: DataFrame) -> DataFrame:
    """The histogram with what each length answers as a context limit.

    `tokens`: in documents of this length. `docs_longer`, `tokens_longer`: suffix sums beyond
    it. `docs_upto`: documents that fit. `truncated_tokens`: tokens left if every document is
    cut at the limit. `total_docs`, `total_tokens`: of all lengths.

    The sums run in two steps, over runs of STEP lengths and inside a run, so that one task
    has one row per run of lengths, whatever the number of documents. An empty histogram gives
    no rows.
    """
    rows = histogram.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn(
        "_run", F.floor(F.col("n_tokens") / STEP)
    )
    runs = rows.groupBy("_run").agg(
        F.sum("n_docs").alias("_docs"), F.sum("tokens").alias("_tokens")
    )
    beyond = Window.orderBy("_run").rowsBetween(1, Window.unboundedFollowing)
    every = Window.orderBy("_run").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    zero = F.lit(0)
    runs = runs.select(
        "_run",
        F.coalesce(F.sum("_docs").over(beyond), zero).alias("_docs_beyond"),
        F.coalesce(F.sum("_tokens").over(beyond), zero).alias("_tokens_beyond"),
        F.sum("_docs").over(every).alias("total_docs"),
        F.sum("_tokens").over(every).alias("total_tokens"),
    )
    after = Window.partitionBy("_run").orderBy("n_tokens").rowsBetween(1, Window.unboundedFollowing)
    return (
        rows.withColumn("_docs_after", F.coalesce(F.sum("n_docs").over(after), zero))
        .withColumn("_tokens_after", F.coalesce(F.sum("tokens").over(after), zero))
        .join(runs, "_run")
        .withColumn("docs_longer", F.col("_docs_after") + F.col("_docs_beyond"))
        .withColumn("tokens_longer", F.col("_tokens_after") + F.col("_tokens_beyond"))
        .select(
            "n_tokens",
            "n_docs",
            "tokens",
            "docs_longer",
            "tokens_longer",
            (F.col("total_docs") - F.col("docs_longer")).alias("docs_upto"),
            (
                F.col("total_tokens")
                - F.col("tokens_longer")
                + F.col("n_tokens") * F.col("docs_longer")
            ).alias("truncated_tokens"),
            "total_docs",
            "total_tokens",
        )
    )


def truncated_total(limits: DataFrame, limit: int) -> DataFrame:
    """(`limit`, `truncated_tokens`, `docs_longer`) for any limit, a length of some text or not."""
    longer = F.col("n_tokens") > limit
    return limits.agg(
        F.lit(limit).alias("limit"),
        F.coalesce(
            F.sum(F.when(longer, F.col("n_docs") * limit).otherwise(F.col("tokens"))), F.lit(0)
        ).alias("truncated_tokens"),
        F.coalesce(F.sum(F.when(longer, F.col("n_docs"))), F.lit(0)).alias("docs_longer"),
    )


def quantile(limits: DataFrame, share: float) -> DataFrame:
    """(`share`, `n_tokens`): the smallest length that at least `share` of the documents fit."""
    enough = F.col("docs_upto") >= F.ceil(F.col("total_docs") * F.lit(share))
    return limits.agg(F.lit(share).alias("share"), F.min(F.when(enough, F.col("n_tokens"))).alias("n_tokens"))
