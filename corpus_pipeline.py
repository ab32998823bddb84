"""A corpus pipeline: language ID, exact dedup, near-dedup, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. In every stage a null text
is an empty one, texts may be of any length, decisions are made by row, so rows of one id are documents of
their own, a null id is an id like any other and the last in order, columns besides those of documents are
left out, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linework.llm.bpe import bpe_decode, bpe_encode
from linework.llm.decontaminate import decontaminate
from linework.llm.exact_dedup import exact_dedup
from linework.llm.langid import UNKNOWN, held_out, identify
from linework.llm.simhash import near_duplicates
from linework.plans.tables import new_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is recognised; those without letters go, empty ones among them.
    Repeated rows stay repeated; of equally good languages the first by name is taken."""
    docs = docs.select(*COLUMNS)
    return identify(docs, docs.where(~held_out("doc_id"))).where(F.col("lang_pred") != UNKNOWN).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside: the longest original, then the smallest id; of rows
    that agree in all that, one."""
    return exact_dedup(docs, carry=COLUMNS[1:]).where("kept").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate component, of equal ids the one with the
    smaller hash of its text; the others go, row by row."""
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("id"), F.xxhash64("text").alias("h"))
    keyed = docs.select(*COLUMNS, key.alias("key"))
    dropped = near_duplicates(keyed, "key").where("key != component_id").select("key").distinct()
    return keyed.join(dropped, "key", "left_anti").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words fewer than one in twenty come from the benchmark; those without words stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(docs, items, carry=COLUMNS[1:])
    return found.where("not (n_hit > 0 and 20 * n_hit >= n_words)").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and a digest of the bytes they decode to; an empty text has no ids."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe_encode(docs.select("doc_id", "text"), vocabulary, public_tokenizers.PATTERN)
    return bpe_decode(ids, vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("bytes", 256).alias("decoded_sha256")
    )


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("decontaminate", benchmark),
    ("byte_bpe", encode),
]

#: Stages 1, 3, 4 and 5 are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
