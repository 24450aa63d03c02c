"""Exact deduplication against a persistent digest index: a Spark table bucketed and sorted by SHA-256.

``DigestIndex.ingest`` reduces new rows to one row per digest, finds the digests that the index lacks by a sort-merge anti join
on the buckets, and appends those. Only ids, lengths and digests move; texts stay where they are.

The caller names each batch and the index keeps that name with every digest, so a job that starts again and ingests the same
batch once more appends nothing and gets the same answer. The index lies in generations, folders ``generation-<g>-<buckets>``:
appends add files to the newest finished one, ``rebuild`` writes the next with one file for each bucket, and with more buckets if
asked. Opening finds the newest finished generation and its buckets, so other sessions can go on with it.

Defined results: a NULL text counts as empty; texts are equal when they are the same without white space. Of equal texts the
one with the most code points stays, then the smallest doc_id; a NULL id loses against any id. A row that occurs more than once
with id, text and all counts each time, and its first occurrence may stay. A text that the index already has from another batch
is dropped in favour of the indexed row. Texts of any length are read whole. Extra columns are ignored, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epilimnia.llm.common import SPACE, read_table, remove, settle, shared_folder

BUCKETS = 32
#: Digests for which a new or rebuilt index has one bucket, about 1 GB.
PER_BUCKET = 8_000_000
GENERATION = re.compile(r"generation-(\d+)-(\d+)")


def buckets_for(digests: int) -> int:
    """Buckets for so many digests: doubled until each holds at most ``PER_BUCKET``."""
    buckets = BUCKETS
    while digests > buckets * PER_BUCKET:
        buckets *= 2
    return buckets


def digest(text: Column) -> Column:
    """SHA-256 of the text without white space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, ""), 256)


def code_points(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit("")))


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_points, text_sha256, copies``: one row for each distinct (id, length, digest)."""
    return (
        docs.select("doc_id", code_points(F.col("text")).alias("n_points"), digest(F.col("text")).alias("text_sha256"))
        .groupBy("doc_id", "n_points", "text_sha256")
        .agg(F.count("*").alias("copies"))
    )


class DigestIndex:
    """The index: ``text_sha256, keep_id, keep_points, group_size, batch``, in sorted buckets below ``path``.

    ``buckets`` counts for a new index only; one that exists keeps its own until ``rebuild``.
    """

    COLUMNS = "text_sha256 string, keep_id long, keep_points int, group_size long, batch string"

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root = spark, path.rstrip("/")
        finished = self._generations()
        self._open(*(finished[-1] if finished else (0, buckets)))

    def _generations(self) -> list[tuple[int, int]]:
        """Number and buckets of each finished generation."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        folders = [status.getPath() for status in files.listStatus(root)]
        done = [f.getName() for f in folders if files.exists(f.suffix("/_SUCCESS"))]
        return sorted((int(m[1]), int(m[2])) for name in done if (m := GENERATION.fullmatch(name)))

    def _open(self, generation: int, buckets: int) -> None:
        self.generation, self.buckets = generation, buckets
        self.path = f"{self.root}/generation-{generation}-{buckets}"
        self.name = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}"
        if self.spark.catalog.tableExists(self.name):
            self.spark.catalog.refreshTable(self.name)
        else:
            self.spark.sql(
                f"CREATE TABLE {self.name} ({self.COLUMNS}) USING parquet LOCATION '{self.path}' "
                f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS"
            )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def fresh(self, rows: DataFrame, batch: str) -> DataFrame:
        """One row for each digest of ``rows`` (as of ``digests``) that the index lacks."""
        winner = F.struct("n_points", (-F.col("doc_id")).alias("minus"))
        batch_rows = rows.groupBy("text_sha256").agg(F.max(winner).alias("w"), F.sum("copies").alias("group_size"))
        return (
            batch_rows.join(self.table().hint("merge"), "text_sha256", "left_anti")
            .select("text_sha256", (-F.col("w.minus")).alias("keep_id"), F.col("w.n_points").alias("keep_points"), "group_size", F.lit(batch).alias("batch"))
        )

    def ingest(self, rows: DataFrame, batch: str | None = None) -> str:
        """Append what is new under the batch's name, a new one if none is given, and return the name.

        A batch that is ingested again adds only what its first run did not write.
        """
        batch = batch or uuid.uuid4().hex
        new = self.fresh(rows, batch).repartition(self.buckets, "text_sha256")
        new.write.mode("append").insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        return batch

    def rebuild(self, buckets: int | None = None) -> None:
        """Write the next generation: one sorted file for each of ``buckets``, by the number of digests if not given.

        Run it when appends have left many files or buckets have outgrown ``PER_BUCKET``, with no ingest beside it. The old
        generation goes when the new one is finished; ended before that, the index stays as it was.
        """
        old, old_name, buckets = self.path, self.name, buckets or buckets_for(self.table().count())
        rows = self.table().repartition(buckets, "text_sha256")
        self._open(self.generation + 1, buckets)
        rows.write.mode("overwrite").insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        self.spark.sql(f"DROP TABLE {old_name}")
        remove(self.spark, old)

    def decide(self, rows: DataFrame, batch: str) -> DataFrame:
        """``doc_id, keep_id, group_size, kept, text_sha256, n_points``: one row per input row.

        The index is read as plain files here: both sides are then shuffled by the join, which lets Spark split the digest of a
        huge group.
        """
        index = self.spark.read.schema(self.COLUMNS).parquet(self.path)
        joined = rows.join(index.hint("merge"), "text_sha256")
        stays = (
            (F.col("batch") == batch) & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
        )
        return joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
            "doc_id", "keep_id", "group_size", (stays & (F.col("copy") == 1)).alias("kept"), "text_sha256", "n_points"
        )


def _decided(docs: DataFrame) -> DataFrame:
    """``docs`` as the first batch of an index of its own."""
    spark = docs.sparkSession
    rows = settle(digests(docs), "digest-rows")
    index = DigestIndex(spark, shared_folder(spark, "digests"), buckets_for(rows.count()))
    return index.decide(rows, index.ingest(rows, "documents"))


def op4_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(read_table(spark, sf_dir, "documents")).drop("n_points")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the row of each group that stays, in its own columns, whatever their names.

    The join key holds the id, so that no group of copies meets in one task.
    """
    key = ["id", "sha", "points"]
    stay = _decided(docs).where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), F.col("n_points").alias("points"))
    marked = docs.select(
        F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), digest(F.col("text")).alias("sha"), code_points(F.col("text")).alias("points")
    )
    same = [marked[k].eqNullSafe(stay[k]) for k in key]
    return marked.join(stay, same, "left_semi").dropDuplicates(key).select("row.*")


ORACLE = {
    "op4_digest_index": r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
groups AS (
  SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM rows GROUP BY text_sha256)
SELECT r.doc_id, g.keep_id, g.group_size, r.doc_id = g.keep_id AS kept, r.text_sha256
FROM rows r JOIN groups g USING (text_sha256)
"""
}
