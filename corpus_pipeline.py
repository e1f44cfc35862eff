"""The training-data pipeline over ``documents``.

STAGES lists (name, function) in order. A function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sendscope.llm import language, mixing, packing, simhash, substring
from sendscope.llm.common import fold
from sendscope.session import scratch_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told (no text, or no letter), and
    give those without a ``lang`` the predicted one."""
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language.fit(docs.select(F.col("doc_id").cast("long"), "text", "lang"), F.col("doc_id").isNotNull() & ~held_out)
    plain = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text"))
    found = language.identify(plain, model, ["row"]).where(F.col("lang_pred") != language.UNDETERMINED)
    lang = F.coalesce(F.col("row.lang").cast("string"), F.col("lang_pred"))
    return found.select(F.col("row").withField("lang", lang).alias("row")).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: the one with the
    smallest id, null ids last, ties by the text's hash. Null and empty texts are
    one group."""
    return simhash.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut windows of words out of texts that a document with a smaller id has (a
    null id is the largest); rows stay, a null text becomes an empty one."""
    return substring.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents as often as the rates that meet the domains' target weights
    say: those of the largest domain once, of a scarce one more often. Repeated
    rows and rows without an id are dealt each by itself; null texts have no tokens."""
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents that are left into sequences of 1024 tokens; a null text
    is an empty one, repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Learned models, hash functions and a tokenizer: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
