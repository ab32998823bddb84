"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Only the last level hashes whole content, and only for rows whose (length, prefix hash) is shared.
What a level passes on is a bitmap of fixed size, so it can be broadcast whatever the input; a bit
that two keys share lets a row through to the next level, which decides exactly. Only lengths and
hashes move, pre-aggregated, so a group holding a third of all rows arrives as one row per task; what the
caller has carried (a text too) moves once, and only with rows that may have copies.

Defined results: a null text counts as empty; empty texts are copies of each other; of rows that
agree in everything, including the id, one stays; a null id comes after all others; texts may be of any
length; an empty table gives an empty result; names of
the operator's own columns may also occur in the input, as input columns are carried under their
own names only when asked for with ``carry`` (a clash there is an error of the caller).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linework.plans.tables import materialise

#: Bits of a level's bitmap: 4 MB to broadcast.
BITMAP_BITS = 1 << 25
#: Code points of normalised text in the prefix hash.
PREFIX = 64


def without_space(text: Column) -> Column:
    """``text`` without ASCII white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _slot(*key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BITMAP_BITS)) + 1


def _shared(rows: DataFrame, *key: str) -> DataFrame:
    """A bitmap of the keys that more than one row has: at most BITMAP_BITS / 32768 rows of 4 KB."""
    keys = rows.groupBy(*key).count().where("count > 1").select(_slot(*key).alias("_slot"))
    return keys.groupBy(F.bitmap_bucket_number("_slot").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits")
    )


def _mark(rows: DataFrame, bitmap: DataFrame, name: str, *key: str) -> DataFrame:
    """Add a boolean column: the key's bit is set."""
    at = F.bitmap_bit_position(_slot(*key))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.expr("shiftright(_byte, cast(_at % 8 as int)) & 1") == 1, F.lit(False))
    return (
        rows.withColumn("_bucket", F.bitmap_bucket_number(_slot(*key)))
        .join(F.broadcast(bitmap), "_bucket", "left")
        .withColumn("_at", at)
        .withColumn("_byte", byte)
        .withColumn(name, hit)
        .drop("_bucket", "_bits", "_at", "_byte")
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
    hash_unique: bool = False,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 and the carried columns.

    Rows are equal when their texts without ASCII white space are; the row with the most code points,
    then the smallest id, stays. ``text_sha256`` is null for rows found unique before their content
    was hashed, unless ``hash_unique``.
    """
    text = F.col(text_col)
    sized = docs.select(
        F.col(id_col).alias("_id"),
        *[F.col(c).alias(f"_c_{c}") for c in carry],
        F.length(F.coalesce(text, F.lit(""))).alias("_points"),
        without_space(text).alias("_norm"),
    ).withColumns({"_len": F.length("_norm"), "_prefix": F.xxhash64(F.substring("_norm", 1, PREFIX))})
    keys = materialise(sized.select("_len", "_prefix"), "dedup-keys")
    by_length = _shared(keys, "_len")
    by_prefix = _shared(_mark(keys, by_length, "_more", "_len").where("_more"), "_len", "_prefix")

    sha = F.sha2(F.col("_norm"), 256)
    content = materialise(
        _mark(sized, by_prefix, "_more", "_len", "_prefix")
        .withColumn("_sha", sha if hash_unique else F.when(F.col("_more"), sha))
        .withColumn("_row", F.monotonically_increasing_id())
        .drop("_norm"),
        "dedup-content",
    )
    group = ["_len", "_prefix", "_sha"]
    groups = (
        content.where("_more")
        .groupBy(*group)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(-F.col("_points"), F.col("_id").isNull(), "_id", "_row")).alias("_keep"))
    )
    groups = materialise(groups, "dedup-groups")  # so that Spark can split the partition of a large group in the join
    out = lambda keep, n, kept: [
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        n.cast("long").alias("group_size"),
        kept.alias("kept"),
        F.col("_sha").alias("text_sha256"),
        *[F.col(f"_c_{c}").alias(c) for c in carry],
    ]
    copies = content.where("_more").join(groups, group)
    return copies.select(*out(F.col("_keep._id"), F.col("_n"), F.col("_keep._row") == F.col("_row"))).unionByName(
        content.where("not _more").select(*out(F.col("_id"), F.lit(1), F.lit(True)))
    )


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """All of documents, with the row that stays for each text."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), hash_unique=True)


OP1_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents),
h AS (SELECT doc_id, points, sha256(norm) AS text_sha256 FROM n),
r AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS rn,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM h)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM r
"""
