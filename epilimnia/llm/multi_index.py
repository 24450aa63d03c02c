"""Nearest neighbours by largest inner product with an inverted multi-index.

Each vector is cut into two halves, which are quantised separately: a pair of centroids names a cell. To make distances follow
inner products, each half gets one more component, the root of what its squared length lacks to the largest one of the corpus
(0 for queries); then nearer means a larger inner product. A query visits centroid pairs by the sum of its two distances, with
a heap, until the visited cells hold enough entries, and the entries of those cells are ranked by their exact inner product.

What is fitted: the codebooks on at most ``SAMPLE`` vectors, chosen by a hash (fewer if they exceed ``SAMPLE_BYTES``), and the number of
entries to visit on at most ``PROBES`` of the queries, for which all entries are searched: it is the least number with which ``RECALL`` of
their true neighbours would have been met. Everything else covers all rows. The centroids grow with the root of the number of
entries up to ``CODES`` a half, so the counts of cells that tasks receive have a proven bound.

Entries lie in blocks of neighbouring cells, of about ``BLOCK`` entries; a larger cell is dealt to several blocks by a hash. A query
goes to the blocks of its cells with a bit for each of the block's cells, and each block ranks its queries, ``QUERIES`` at a
time, by itself: pairs of query and entry are never rows. Of equal vectors, the ``TOP + 1`` smallest ids are entries, as no others can
be among a query's nearest.

Defined results: vectors that are NULL, zero, or hold NULL or non-finite components, and rows without id take no part, nor do
vectors whose length is not the most frequent one (of equally frequent ones the longest). Rows that repeat id and vector count once;
an id with several vectors is a candidate with each and is searched with the least. A query's candidates are all rows of other ids.
Equal products go to the smaller id. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epilimnia.llm.common import read_table, settle

TOP, EVERY = 20, 20
SAMPLE, SAMPLE_BYTES = 32_768, 1 << 26
PROBES, RECALL = 256, 0.97
#: Entries that a cell holds on average, until there are CODES centroids a half.
CELL, CODES = 8, 1_024
BLOCK, QUERIES = 8_192, 4_096
ROUNDS = 12


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector`` (doubles) of the rows that take part, each once."""
    parts = F.col("embedding").cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), parts.alias("vector"))
    rows = rows.where(finite & F.exists("vector", lambda x: x != 0))
    common = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).select("size").first()
    return rows.where(F.size("vector") == (common[0] if common else 0)).dropDuplicates(["vec_id", "vector"])


def _grid(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Codebooks:
    """Centroids of both halves, the largest squared lengths of halves, and the entries of each cell."""

    def __init__(self, sample: np.ndarray, longest: tuple[float, float], codes: int) -> None:
        self.cut = (sample.shape[1] + 1) // 2
        self.longest = longest
        self.centroids = [fitted(half, codes) for half in self.halves(sample)]

    def halves(self, vectors: np.ndarray, query: bool = False) -> list[np.ndarray]:
        out = []
        for half, longest in zip((vectors[:, : self.cut], vectors[:, self.cut :]), self.longest, strict=True):
            lacks = np.zeros(len(half)) if query else np.sqrt(np.maximum(longest - (half * half).sum(axis=1), 0))
            out.append(np.column_stack([half, lacks]))
        return out

    def distances(self, vectors: np.ndarray, query: bool = False) -> list[np.ndarray]:
        """Squared distances to the centroids of each half, less what is the same for all of them."""
        return [(c * c).sum(axis=1) - 2 * h @ c.T for h, c in zip(self.halves(vectors, query), self.centroids, strict=True)]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        one, two = self.distances(vectors)
        return one.argmin(axis=1) * len(self.centroids[1]) + two.argmin(axis=1)


def fitted(points: np.ndarray, codes: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from distinct points; an emptied one keeps its place."""
    rng = np.random.default_rng(0)
    distinct = np.unique(points, axis=0)
    centroids = distinct[rng.choice(len(distinct), min(codes, len(distinct)), replace=False)]
    for _ in range(ROUNDS):
        nearest = np.concatenate([((centroids**2).sum(axis=1) - 2 * p @ centroids.T).argmin(axis=1) for p in np.array_split(points, 1 + len(points) // 4096)])
        n = np.bincount(nearest, minlength=len(centroids))
        sums = np.stack([np.bincount(nearest, weights=c, minlength=len(centroids)) for c in points.T], axis=1)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def visit(one: np.ndarray, two: np.ndarray, held: list[int], enough: int) -> list[int]:
    """Cells by the sum of their distances, nearest first, until they hold ``enough`` entries."""
    order_one, order_two = np.argsort(one, kind="stable").tolist(), np.argsort(two, kind="stable").tolist()
    near_one, near_two = one[order_one].tolist(), two[order_two].tolist()
    width, out, seen = len(order_two), [], 0
    heap = [(near_one[0] + near_two[0], 0, 0)]
    while heap and seen < enough:
        _, i, j = heapq.heappop(heap)
        cell = order_one[i] * width + order_two[j]
        if held[cell]:
            out.append(cell)
            seen += held[cell]
        if j + 1 < width:
            heapq.heappush(heap, (near_one[i] + near_two[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(order_one):
            heapq.heappush(heap, (near_one[i + 1] + near_two[0], i + 1, 0))
    return out


def nearest(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, top: int, allowed: np.ndarray | None = None):
    """``query, entry, score`` (places, exact product) of each query's ``top`` entries of other ids, where ``allowed``."""
    product = queries @ vectors.T
    out = query_ids[:, None] == ids[None, :]
    if allowed is not None:
        out |= ~allowed
    product[out] = -np.inf
    if len(ids) > top:
        # Products of a matrix may differ in the last bits from those that are reported: all within reach are ranked anew.
        slack = 1e-9 * np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * queries.shape[1]
        least = np.partition(product, len(ids) - top, axis=1)[:, len(ids) - top]
        q, e = np.nonzero((product >= (least - slack)[:, None]) & ~out)
    else:
        q, e = np.nonzero(~out)
    score = np.zeros(len(q))
    for d in range(queries.shape[1]):
        score += queries[q, d] * vectors[e, d]
    order = np.lexsort((ids[e], -score, q))
    q, e, score = q[order], e[order], score[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, dtype=int)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    first = rank < top
    return q[first], e[first], score[first]


def blocks_of(held: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell; cells in order fill blocks of about ``size`` entries."""
    first, number = np.zeros(len(held), dtype=np.int64), np.ones(len(held), dtype=np.int64)
    block = filled = 0
    for cell, n in enumerate(held.tolist()):
        if filled and filled + n > size:
            block, filled = block + 1, 0
        first[cell] = block
        if n > size:
            number[cell] = -(-n // size)
            block, filled = block + int(number[cell]), 0
        else:
            filled += n
    return first, number


def _top(rows: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _probed(entries: DataFrame, probes: list, top: int) -> list:
    """``query_id, cell`` of the true neighbours of a few queries, by a pass over all entries."""
    ids, vectors = np.array([p[0] for p in probes]), np.array([p[1] for p in probes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, cells = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                q, e, score = nearest(vectors, ids, _grid(batch.column(1)), own, top)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(own[e]), pa.array(cells[e]), pa.array(score)], names=["query_id", "vec_id", "cell", "score"])

    found = entries.mapInArrow(run, "query_id long, vec_id long, cell long, score double")
    return _top(found, top).select("query_id", "cell").collect()


def search(vectors: DataFrame, is_query, top: int = TOP, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest rows found for each row that ``is_query`` (a condition on vec_id) chooses."""
    rows = settle(usable(vectors), "vectors")
    same = Window.partitionBy("vector").orderBy("vec_id")
    entries = settle(rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= top + 1).drop("place"), "entries")
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumnRenamed("vec_id", "query_id")
    squares = lambda part: F.aggregate(part, F.lit(0.0), lambda s, x: s + x * x)
    cut = F.ceil(F.size("vector") / 2).cast("int")
    halves = (F.slice("vector", F.lit(1), cut), F.slice("vector", cut + 1, F.size("vector") - cut))
    size, dims, *longest = entries.agg(F.count("*"), F.max(F.size("vector")), *[F.coalesce(F.max(squares(h)), F.lit(0.0)) for h in halves]).first()
    if not size:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))

    by_hash = lambda df, c, n: df.orderBy(F.xxhash64(c), c).limit(n)
    sample = by_hash(entries, "vec_id", max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dims)))).select("vector").collect()
    books = Codebooks(np.array([r[0] for r in sample]), tuple(longest), max(1, min(CODES, round((size / CELL) ** 0.5))))
    width = len(books.centroids[1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = books.cells(_grid(batch.column(1))) if batch.num_rows else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int64())], names=["vec_id", "vector", "cell"])

    index = settle(entries.mapInArrow(place, "vec_id long, vector array<double>, cell long"), "index")
    held = np.zeros(len(books.centroids[0]) * width, dtype=np.int64)
    for cell, n in index.groupBy("cell").count().collect():
        held[cell] = n

    probes = by_hash(queries, "query_id", PROBES).collect()
    enough = 0
    if probes:
        one, two = books.distances(np.array([p[1] for p in probes]), query=True)
        cells: dict[int, list[int]] = {}
        for query, cell in _probed(index, probes, top):
            cells.setdefault(query, []).append(cell)
        needed = []  # entries that a visit has met with each true neighbour's cell
        for i, (query, _) in enumerate(probes):
            order = np.argsort((one[i][:, None] + two[i][None, :]).ravel(), kind="stable")
            met = np.empty(len(held), dtype=np.int64)
            met[order] = np.cumsum(held[order])
            needed += met[cells.get(query, [])].tolist()
        if needed:
            enough = sorted(needed)[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]
    enough = min(size, max(enough, 4 * (top + 1)))
    return _ranked(index, queries, books, held, enough, top)


def _ranked(index: DataFrame, queries: DataFrame, books: Codebooks, held: np.ndarray, enough: int, top: int) -> DataFrame:
    width, counts = len(books.centroids[1]), held.tolist()
    first, number = blocks_of(held, BLOCK)
    last = first + number - 1
    start = np.searchsorted(last, np.arange(int(last.max()) + 1))  # a block's first cell
    end = np.searchsorted(first, np.arange(int(last.max()) + 1), side="right")

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, made = batch.column(0).to_numpy(), []
            one, two = books.distances(_grid(batch.column(1)), query=True) if len(ids) else ([], [])
            for i in range(len(ids)):
                mask = np.zeros(len(held), dtype=bool)
                mask[visit(one[i], two[i], counts, enough)] = True
                cells = np.flatnonzero(mask)
                for b in np.unique(np.concatenate([first[cells], *[np.arange(first[c], last[c] + 1) for c in cells[number[cells] > 1]]])).tolist():
                    made.append((i, b, np.packbits(mask[start[b] : end[b]]).tobytes()))
            rows, blocks, bits = zip(*made) if made else ([], [], [])
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int64()), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(bits, pa.binary())], names=["block", "query_id", "vector", "bits"]
            )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cells = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first[cells] + salt % number[cells], pa.int64())], names=["vec_id", "vector", "cell", "block"])

    visits = settle(queries.mapInArrow(traverse, "block long, query_id long, vector array<double>, bits binary"), "visits")
    parts = settle(visits.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).alias("parts")), "parts")
    asked = visits.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("query_id"), "parts")).drop("parts")
    dealt = index.mapInArrow(deal, "vec_id long, vector array<double>, cell long, block long").join(parts, "block")
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")

    def rank(key: tuple, asks: pa.Table, block: pa.Table) -> pa.Table:
        number = key[0].as_py()
        ids, query_ids = block["vec_id"].to_numpy(), asks["query_id"].to_numpy()
        out = [[], [], []]
        if len(ids) and len(query_ids):
            vectors, asked = _grid(block["vector"].combine_chunks()), _grid(asks["vector"].combine_chunks())
            at = block["cell"].to_numpy() - start[number]
            bits = np.unpackbits(np.frombuffer(b"".join(asks["bits"].to_pylist()), dtype=np.uint8).reshape(len(query_ids), -1), axis=1)
            for lo in range(0, len(query_ids), 256):
                hi = lo + 256
                q, e, score = nearest(asked[lo:hi], query_ids[lo:hi], vectors, ids, top, bits[lo:hi][:, at].astype(bool))
                for column, values in zip(out, (query_ids[lo:hi][q], ids[e], score), strict=True):
                    column.append(values)
        arrays = [pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)]
        return pa.Table.from_arrays(arrays, names=["query_id", "vec_id", "score"])

    found = asked.groupBy("block", "part").cogroup(dealt.groupBy("block", "part")).applyInArrow(rank, "query_id long, vec_id long, score double")
    return _top(found, top).select("query_id", "rank", "vec_id", "score")


def op12_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
