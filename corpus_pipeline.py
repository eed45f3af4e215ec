"""A training corpus from ``documents``, end to end.

Each stage calls one operator of ``tessera.llm`` on everything its predecessor
kept. All but the last return the columns of ``documents``:

1. quality rules: rejected documents go;
2. n-gram Jaccard join: one document of each group of near copies stays;
3. benchmark decontamination: documents with a benchmark window go;
4. mixing: each document's row as often as the mixture takes it;
5. token files: the mixture is written as flat token files and read back, one
   row per written document (doc_id, start, n_tokens, ids_crc32).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, jaccard, mixing, quality, tokenfiles
from tessera.llm.shared import cut, read_table, release


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_per_group(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenfiles.read_tokens(spark, tokenfiles.write_tokens(docs, tokenfiles.default_tokenizer()))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing", source_mix),
    ("token files", token_output),
]

#: The mixture draws at random and token ids come from a tokenizer library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table goes once the next one's is written."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, f"pipeline-{i}")
        if i:
            release(before)
    return docs
