"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

A document longer than a bin is cut into full bins and a rest; every piece is packed. Bins are ordered by what they have left.
Each carries a bitmap of the sources and one of the duplicate clusters that it holds: two documents of one source, or of one
cluster, never share a bin (pieces of one document have bins of their own anyway). For each piece, longest first, the search
starts at the bins that have just enough left and goes on to the next larger rest until a compatible bin is found, so it ends at
the tightest one; without any, a bin is opened.

Documents are dealt into shards by a hash of their id, length and cluster, and equal ones also by their number among themselves;
a shard is packed by itself, so the number of shards follows the number of documents and no task ever holds more than about
``SHARD`` of them, whatever a source's share and however often a row is repeated. Documents come to a shard as four numbers, not
as texts, however long they are.

Clusters are texts that are equal without white space (``sizes``); ``with_classes`` puts the classes of a near-duplicate search in
their place.

Defined results: a NULL source or cluster conflicts with nothing. NULL, empty and wordless texts have length 0: they are put into
bins like all others, by the rules of conflict. Ties go by doc_id (NULL first), then by cluster. Repeated rows are packed each.
Extra columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epilimnia.llm.common import per_text, read_table, settle

CAPACITY = 2_048
SHARD = 20_000
#: Copies of one row that are numbered at a time.
BLOCK = 4_096


class Bins:
    """Open bins of one shard, by rest and then by what they hold."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.at: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(capacity + 1)]
        self.filled = 0  # bit r: some bin has a rest of r
        self.rests: list[int] = []

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin that takes a piece, and the offset in it. ``source`` and ``cluster`` are bitmaps of at most one bit."""
        later = self.filled >> size << size
        while later:
            lowest = later & -later
            rest = lowest.bit_length() - 1
            groups = self.at[rest]
            held = next((h for h in groups if not (h[0] & source or h[1] & cluster)), None)
            if held is not None:
                stack = groups[held]
                number = stack.pop()
                if not stack:
                    del groups[held]
                    if not groups:
                        self.filled ^= lowest
                self._open(number, rest - size, held[0] | source, held[1] | cluster)
                return number, self.capacity - rest
            later ^= lowest
        number = len(self.rests)
        self.rests.append(self.capacity)
        self._open(number, self.capacity - size, source, cluster)
        return number, 0

    def _open(self, number: int, rest: int, sources: int, clusters: int) -> None:
        self.rests[number] = rest
        self.at[rest].setdefault((sources, clusters), []).append(number)
        self.filled |= 1 << rest


def pack_shard(pieces: pd.DataFrame, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece; ``pieces`` (n_words, source, cluster) come longest first."""
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for s in pieces["source"] if not pd.isna(s)))}
    # Only clusters with several members in the shard need a bit.
    seen = pieces["cluster"].dropna().value_counts()
    cluster_bit = {c: 1 << i for i, c in enumerate(sorted(seen[seen > 1].index))}
    bins = Bins(capacity)
    placed = [
        bins.put(int(n), 0 if pd.isna(s) else source_bit[s], 0 if pd.isna(c) else cluster_bit.get(c, 0))
        for n, s, c in zip(pieces["n_words"], pieces["source"], pieces["cluster"], strict=True)
    ]
    return [b for b, _ in placed], [o for _, o in placed]


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """``docs``: doc_id, source, cluster, n_words. One row for each piece, with its bin and offset."""
    whose = ["doc_id", "source", "cluster", "n_words"]
    counted = settle(docs.groupBy(*whose).agg(F.count("*").alias("copies")), "sizes")
    total = counted.agg(F.sum("copies")).first()[0] or 0
    shards = max(1, -(-total // shard))
    # Equal rows come one by one out of blocks of their count, so that they spread over all shards.
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {BLOCK}"))))
    last = F.least(F.col("copies"), (F.col("block") + 1) * BLOCK) - 1
    each = blocks.select(*whose, F.explode(F.sequence(F.col("block") * BLOCK, last)).alias("copy"))
    whole = F.floor(F.greatest(F.col("n_words") - 1, F.lit(0)) / capacity).cast("int")
    pieces = each.select(
        F.pmod(F.xxhash64("doc_id", "n_words", "cluster", "copy"), F.lit(shards)).cast("int").alias("shard"),
        "doc_id",
        "source",
        "cluster",
        F.explode(F.sequence(F.lit(0), whole)).alias("piece"),
        "n_words",
    ).withColumn("n_words", F.least(F.col("n_words") - F.col("piece") * capacity, F.lit(capacity)).cast("int"))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n_words", "doc_id", "cluster", "piece"], ascending=[False, True, True, True], na_position="first", ignore_index=True, kind="stable")
        part["bin"], part["offset"] = pack_shard(part, capacity)
        return part

    columns = "shard int, doc_id long, source string, cluster long, piece int, n_words int, bin long, offset int"
    packed = pieces.groupBy("shard").applyInPandas(one, columns)
    bin_id = F.col("shard").cast("long") * (1 << 32) + F.col("bin")
    return packed.select("doc_id", "piece", "n_words", "source", "cluster", bin_id.alias("bin_id"), "offset")


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, n_words, cluster`` of each row; the cluster is the text's name without white space."""

    def maker() -> Callable[[list[str | None]], list[pa.Array]]:
        def work(texts: list[str | None]) -> list[pa.Array]:
            counts, joined = [], []
            for text in texts:  # the words of one text at a time are in memory
                words = (text or "").encode("utf-8", "surrogatepass").split()
                counts.append(len(words))
                joined.append(xxhash.xxh3_64_intdigest(b"".join(words)) - (1 << 63) if words else None)
            return [pa.array(counts, type=pa.int64()), pa.array(joined, type=pa.int64())]

        return work

    return per_text(docs, maker, "n_words long, cluster long", carry=("doc_id", "source"))


def with_classes(sized: DataFrame, classes: DataFrame) -> DataFrame:
    """``sized`` with the near-duplicate class of each document as its cluster; documents without one keep theirs.

    ``classes`` has doc_id and class_id; of several classes of one id the smallest counts. Ids are joined, not classes, so a large
    class meets in no task.
    """
    named = classes.where("doc_id IS NOT NULL AND class_id IS NOT NULL").groupBy("doc_id").agg(F.min("class_id").alias("class"))
    return sized.join(named, "doc_id", "left").withColumn("cluster", F.when(F.col("class").isNull(), F.col("cluster")).otherwise(F.xxhash64("class"))).drop("class")


def op3_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(sizes(read_table(spark, sf_dir, "documents")))


def pack_rest(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the bins of what is left."""
    return pack(sizes(docs))
