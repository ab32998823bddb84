"""Token counts as delta-maintained rollups.

A change feed says, per document, that its count under a tokenizer version is inserted, deleted or
revised. Each becomes signed numbers: +n, -n, or the new count less the old one. A batch is summed to
deltas per (source, lang, version) and committed under its batch id. Totals are the sum of all deltas;
``compact`` folds deltas into one snapshot.

A rollup is two folders: ``data`` with a folder of deltas for every write, and ``commits`` with the
(batch id, folder) of every committed batch. Deltas count only if a commit names their folder. A commit is
one rename, so a batch is whole or absent for readers, and a crash before it leaves nothing
that counts. A batch id that is committed already, in a snapshot too, is skipped, so a batch counts once
however often it is replayed. Should two writers commit one id at once, one of the two folders counts.

A tokenizer is an expression or a byte-level BPE vocabulary. Only pre-aggregated deltas move, and what the
BPE encoder moves; a source with a third of all rows is one row per task.

Defined results: null source or lang is a group of its own; a null text or count is zero; null and repeated
document ids are documents of their own; a group whose documents are all gone stays with zeros; an empty
batch commits nothing but its id; texts may be of any length; other columns are left out, whatever their
names; without documents there are no totals.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linework.llm.bpe import bpe_encode
from linework.plans.tables import materialise, new_path

#: A tokenizer: an expression of the text, or the path and the pattern of a byte-level BPE vocabulary.
Tokenizer = Callable[[Column], Column] | tuple[str, str]
#: Tokenizer versions that are expressions.
PATTERNS: dict[str, Tokenizer] = {
    "space-1": lambda text: F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")),
    "class-1": lambda text: F.regexp_count(text, F.lit(r"[a-zA-Z]+|[0-9]|[^\x00-\x7F]+|[^\sa-zA-Z0-9\x7F]")),
}
KEYS = ["source", "lang", "version"]
SUMS = ("docs", "tokens", "chars")
DELTA = "folder string, source string, lang string, version string, docs long, tokens long, chars long"


def ledger(docs: DataFrame, versions: dict[str, Tokenizer], new_text: Column | None = None) -> DataFrame:
    """(doc_id, source, lang, changes, is_new, chars, counts) of every document: counts is
    array<struct<version, tokens>>. Documents that ``new_text`` changes have a second row, of the new text.

    Texts are read once; deletions and revisions are made from these narrow rows.
    """
    old = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", "lang", old.alias("old"), (old if new_text is None else F.coalesce(new_text, F.lit(""))).alias("new"))
    changes = F.col("old") != F.col("new")
    rows = rows.select("doc_id", "source", "lang", changes.alias("changes"), F.posexplode(F.when(changes, F.array("old", "new")).otherwise(F.array("old"))).alias("is_new", "text"))
    count = lambda version, n: F.struct(F.lit(version).alias("version"), n.cast("long").alias("tokens"))
    counts = [count(v, t(F.col("text"))) for v, t in versions.items() if callable(t)]
    rows = rows.withColumns({"chars": F.length("text").cast("long"), "counts": F.array(*counts) if counts else F.array().cast("array<struct<version:string,tokens:bigint>>")})
    trained = {v: t for v, t in versions.items() if not callable(t)}
    for i, (version, (vocabulary, pattern)) in enumerate(trained.items()):
        kept = rows.withColumn("kept", F.col("text")) if i + 1 < len(trained) else rows
        rows = bpe_encode(kept, vocabulary, pattern).withColumn("counts", F.array_append("counts", count(version, F.size("ids")))).drop("ids").withColumnsRenamed({"kept": "text"})
    return rows.select("doc_id", "source", "lang", "changes", F.col("is_new") == 1, "chars", "counts").toDF("doc_id", "source", "lang", "changes", "is_new", "chars", "counts")


def _each(rows: DataFrame, versions: list[str]) -> DataFrame:
    return rows.select("source", "lang", "is_new", "chars", F.inline("counts")).where(F.col("version").isin(versions))


def whole(rows: DataFrame, op: str, versions: list[str]) -> DataFrame:
    """Changes that insert or delete documents of a ledger with all their tokens."""
    none = F.lit(None).cast("long")
    each = _each(rows.where("not is_new"), versions)
    return each.select(F.lit(op).alias("op"), *KEYS, "tokens", "chars", none.alias("old_tokens"), none.alias("old_chars"))


def revised(rows: DataFrame, versions: list[str]) -> DataFrame:
    """Changes that replace the counts of the changed documents of a ledger by the new ones."""
    each = _each(rows.where("changes"), versions)
    of = lambda c, new: F.when(F.col("is_new") == new, F.col(c))
    return each.select(
        F.lit("revise").alias("op"), *KEYS, of("tokens", True).alias("tokens"), of("chars", True).alias("chars"), of("tokens", False).alias("old_tokens"), of("chars", False).alias("old_chars")
    )


def signed(changes: DataFrame) -> DataFrame:
    """Signed numbers of (op, source, lang, version, tokens, chars, old_tokens, old_chars) rows."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    by_op = lambda new, old: F.when(F.col("op") == "insert", new).when(F.col("op") == "delete", -new).otherwise(new - old)
    return changes.select(
        *KEYS,
        F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0).cast("long").alias("docs"),
        by_op(zero("tokens"), zero("old_tokens")).alias("tokens"),
        by_op(zero("chars"), zero("old_chars")).alias("chars"),
    )


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])


class Rollup:
    """Totals in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, path: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def commits(self) -> DataFrame:
        """(batch_id, folder) of all committed batches; those of a snapshot share its folder."""
        fs, path = self._fs(f"{self.path}/commits")
        if not fs.exists(path):
            return self.spark.sql("SELECT '' AS batch_id, '' AS folder LIMIT 0")
        lines = self.spark.read.schema("value string").option("recursiveFileLookup", True).text(f"{self.path}/commits")
        return lines.select(F.from_json("value", "batch_id string, folder string").alias("c")).select("c.*").groupBy("batch_id").agg(F.min("folder").alias("folder"))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit a batch, unless its id is committed: then nothing happens and the result is False."""
        if not self.commits().where(F.col("batch_id") == batch_id).isEmpty():
            return False
        folder = uuid.uuid4().hex
        _summed(signed(changes)).write.parquet(f"{self.path}/data/folder={folder}")
        line = self.spark.createDataFrame([(batch_id, folder)], "batch_id string, folder string")
        self._publish(line, hashlib.sha256(batch_id.encode()).hexdigest())
        return True

    def _publish(self, commits: DataFrame, name: str) -> None:
        """Write commits aside and rename them into place: one step where the file system renames folders in one (local, HDFS); on an
        object store, where it doesn't, the commits need a folder on such a file system."""
        aside = f"{self.path}/aside/{uuid.uuid4().hex}"
        commits.select(F.to_json(F.struct("batch_id", "folder")).alias("value")).write.text(aside)
        fs, source = self._fs(aside)
        _, target = self._fs(f"{self.path}/commits/{name}")
        fs.mkdirs(target.getParent())
        if not fs.exists(target):
            fs.rename(source, target)

    def deltas(self, commits: DataFrame | None = None) -> DataFrame:
        """The signed numbers of the committed batches, or of those given."""
        fs, path = self._fs(f"{self.path}/data")
        if not fs.exists(path):
            return self.spark.range(0).select(*[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in DELTA.split(", ")])
        return self.spark.read.schema(DELTA).parquet(f"{self.path}/data").join((self.commits() if commits is None else commits).select("folder").distinct(), "folder", "left_semi")

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens, chars over all batches."""
        return _summed(self.deltas())

    def compact(self, path: str) -> Rollup:
        """The totals of the batches committed by now as the single snapshot of a new rollup, which knows just these. The
        list of commits is read once; a batch that comes later can be committed to the new rollup."""
        new = Rollup(self.spark, path)
        folder = uuid.uuid4().hex
        known = materialise(self.commits(), "commits")
        _summed(self.deltas(known)).write.parquet(f"{path}/data/folder={folder}")
        new._publish(known.select("batch_id", F.lit(folder).alias("folder")), "snapshot")
        return new


def _four_batches(spark: SparkSession, sf_dir: str, versions: dict[str, Tokenizer]) -> DataFrame:
    """Totals of documents after four batches: two versions inserted, texts labelled toxic deleted, and
    texts labelled low in quality recounted without symbols; one batch arrives twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    names = list(versions)
    rows = materialise(ledger(docs, versions, F.translate("text", "#$%&*|!", "")), "token-ledger")
    marked = lambda condition: rows.join(labels.where(condition).select("doc_id"), "doc_id", "left_semi")
    rollup = Rollup(spark, new_path(spark, "token-counts"))
    rollup.commit("1", whole(rows, "insert", names[:1]))
    rollup.commit("2", whole(rows, "insert", names[1:]))
    rollup.commit("3", whole(marked("toxic = 1"), "delete", names))
    rollup.commit("4", revised(marked("quality = 0 and coalesce(toxic, 0) != 1"), names))
    rollup.commit("2", whole(rows, "insert", names[1:]))
    return rollup.totals()


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """Totals of documents by a pattern and by byte-level BPE."""
    import public_tokenizers

    bpe = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return _four_batches(spark, sf_dir, {"space-1": PATTERNS["space-1"], "bpe-50k-1": bpe})


def token_counts_patterns(spark, sf_dir: str) -> DataFrame:
    """Totals of documents by two patterns."""
    return _four_batches(spark, sf_dir, PATTERNS)


PATTERNS_SQL = r"""
WITH l AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
d AS (
  SELECT source, lang, coalesce(toxic, 0) = 1 AS gone,
         CASE WHEN quality = 0 THEN translate(coalesce(text, ''), '#$%&*|!', '') ELSE coalesce(text, '') END AS t
  FROM documents LEFT JOIN l USING (doc_id)),
v AS (
  SELECT source, lang, gone, t, 'space-1' AS version, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n FROM d
  UNION ALL
  SELECT source, lang, gone, t, 'class-1', len(regexp_extract_all(t, '[a-zA-Z]+|[0-9]|[^\x00-\x7F]+|[^\sa-zA-Z0-9\x7F]')) FROM d)
SELECT source, lang, version, count(*) FILTER (WHERE NOT gone) AS docs,
       coalesce(sum(n) FILTER (WHERE NOT gone), 0)::BIGINT AS tokens, coalesce(sum(length(t)) FILTER (WHERE NOT gone), 0)::BIGINT AS chars
FROM v GROUP BY ALL
"""
