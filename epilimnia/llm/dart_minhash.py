"""Near duplicates by DartMinHash: weighted signatures from darts, banded joining, exact verification.

An element is a run of five words (a shorter text is one element), its weight how often the text holds it. Every unit of an
element's weight is a strip of a dart board; hashed darts hit a strip as a Poisson process in rank, one per unit of rank on
average, and each dart has a hashed coordinate. A text keeps the darts that fall into its strips, and of each coordinate the
earliest. So only about ``k log k`` darts of low rank matter, however long the text, and two texts agree in a coordinate with the
probability of their weighted Jaccard similarity.

``BANDS`` bands of ``ROWS`` coordinates make the candidate buckets. First the member of a bucket that meets most others in all its
buckets, as an original meets its copies, is compared with all members by the exact weighted Jaccard similarity of the texts. The
distance 1 - similarity is a metric, so these distances bound all others of the bucket from below: two members
whose distances from that centre differ by more than 0.2 can't be near duplicates of each other, and need no comparison. Only
members that may still have a link to another component go on.

They are compared in up to ``ROUNDS`` rounds, the same for buckets of every size; a round that links few is the last. In each round the members of a bucket are sorted by
lengthened keys, further coordinates of their signatures in another order each time; sorted ranges split a large bucket over
tasks. A member looks at the ``WINDOW`` members before and behind it that share the most further coordinates with it and are in other
components, and the one whose signature agrees with its own in most coordinates is compared by text, if the agreement is
within four deviations of the similarity. So a round compares no more pairs than it has rows.

The rounds only spare work. In every bucket that is still not one component, all members then meet those of other components: a
bucket is dealt over blocks of about ``BLOCK`` members, a task holds two blocks with their texts, and a pair that
no bound excludes is compared by text in the first bucket that its texts share; how far signatures agree decides on the order there, on no pair. Only links leave a task, so rows grow with a
bucket's members times its blocks; the comparing grows with the square of a bucket whose members lie just outside the similarity.

Classes are the connected components. Two texts of similarity 0.8 share a bucket with a probability of 0.988, of 0.85 with 0.9995,
and no pair that shares one is missed; ``tests/llm`` measures the classes against all pairs.

Defined results: a text without words is a class of its own row and stays, repeated or not. Texts with equal words are exact copies: they share a node, named
by a 64-bit hash (two different texts share one with a chance of one in 10 at two billion texts), and are not listed as pairs.
Repeated ids and NULL ids each count as rows; the class takes the least id among its rows (NULL if no row has one). Extra columns
are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from epilimnia.llm.common import discard, per_text, read_table, settle

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 8
K = BANDS * ROWS
#: Expected darts per coordinate beyond log(K) in the first throw; texts with an empty coordinate throw further.
SPARE = 3.0
#: Members of a bucket and units of weight that a block has, as expected by hash.
BLOCK, BLOCK_UNITS = 1024, 1_000_000
#: Bits of a bin's number at most, and cells of bins that are compared at once.
BIN_BITS, BIN_CELLS = 14, 1 << 20
#: Rounds of sorting by lengthened keys, coordinates of such a key, and the neighbours on each side that a member looks at.
ROUNDS, LENGTH, WINDOW = 4, 16, 64
#: Links that a round must find for each of its rows, else it is the last: all members meet afterwards anyway.
GAIN = 0.01
#: Coordinates in which signatures of near duplicates agree at least: four deviations below the mean.
AGREE = int(K * SIMILARITY - 4 * (K * SIMILARITY * (1 - SIMILARITY)) ** 0.5)
#: Bits of a rank: whole units, and parts of a unit. What is left of 64 bits numbers the coordinates of one throw.
UNIT_BITS, PART_BITS = 15, 30
RANK_BITS = UNIT_BITS + PART_BITS
#: Words that a task remembers, and units of weight whose darts are thrown at once.
CACHE_WORDS, THROW = 150_000, 250_000

_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _poisson_steps() -> np.ndarray:
    """Cumulative probabilities of a Poisson variable of mean 1, on the scale of 64-bit hashes."""
    p, total, out = np.exp(-1.0), 0.0, []
    for n in range(1, 20):
        total += p
        out.append(min(total, 1 - 2.0**-53))
        p /= n
    return (np.array(out) * 2.0**64).astype(np.uint64)


STEPS = _poisson_steps()


class Shingler:
    """Word lists to hashed elements with weights; remembers words."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def codes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE_WORDS:
            known = self.known = {}
        for w in {*words}.difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))

    def elements(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct elements and their weights."""
        if not words:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        codes = self.codes(words)
        size = min(WORDS, len(words))
        runs = np.full(len(codes) - size + 1, size, dtype=np.uint64)
        for i in range(size):
            runs = mix(runs * _A + codes[i : i + len(runs)])
        return np.unique(runs, return_counts=True)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def name(bag: list[bytes]) -> int | None:
    """A 64-bit name of a word sequence; None without words."""
    return xxhash.xxh3_64_intdigest(b" ".join(bag)) - (1 << 63) if bag else None


def signatures(elements: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    """One row of ``K`` earliest ranks for each weighted set; no set may be empty."""
    totals = np.array([w.sum() for w in weights], dtype=float)
    out = np.full((len(elements), K), np.iinfo(np.uint64).max, dtype=np.uint64)
    todo, reach = np.arange(len(elements)), K * (np.log(K) + SPARE) / totals
    while len(todo):
        _throw([elements[i] for i in todo], [weights[i] for i in todo], reach[todo], out, todo)
        todo = todo[(out[todo] == np.iinfo(np.uint64).max).any(axis=1)]
        reach[todo] *= 2
    return out


def _throw(elements: list[np.ndarray], weights: list[np.ndarray], reach: np.ndarray, out: np.ndarray, rows: np.ndarray) -> None:
    """Throw the darts of rank below ``reach`` and note the earliest of each coordinate."""
    sizes = np.array([len(e) for e in elements])
    owner = np.repeat(np.arange(len(elements)), sizes)
    seed, weight = mix(np.concatenate(elements)), np.concatenate(weights)
    # A strip for each unit of weight, a cell for each started unit of rank.
    strip = _counting(weight)
    owner, seed = np.repeat(owner, weight), mix(np.repeat(seed, weight) + strip.astype(np.uint64) * _D)
    cells = np.ceil(reach).astype(np.int64)[owner]
    cell = _counting(cells)
    owner, seed = np.repeat(owner, cells), mix(np.repeat(seed, cells) + cell.astype(np.uint64) * _A)
    darts = np.searchsorted(STEPS, seed, side="right")
    hit = darts > 0
    owner, seed, cell, darts = owner[hit], seed[hit], cell[hit], darts[hit]
    number = _counting(darts)
    owner, cell = np.repeat(owner, darts), np.repeat(cell, darts)
    dart = mix(np.repeat(seed, darts) + (number + 1).astype(np.uint64) * _C)
    rank = (cell.astype(np.uint64) << np.uint64(PART_BITS)) | (dart & np.uint64((1 << PART_BITS) - 1))
    near = rank < (reach * 2.0**PART_BITS).astype(np.uint64)[owner]
    coordinate = ((dart >> np.uint64(32)) * np.uint64(K)) >> np.uint64(32)
    place = owner[near].astype(np.uint64) * np.uint64(K) + coordinate[near]
    packed = np.sort((place << np.uint64(RANK_BITS)) | rank[near])
    place = packed >> np.uint64(RANK_BITS)
    first = np.ones(len(place), dtype=bool)
    first[1:] = place[1:] != place[:-1]
    place = place[first].astype(np.int64)
    out[rows[place // K], place % K] = packed[first] & np.uint64((1 << RANK_BITS) - 1)


def _counting(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def bands(signature: np.ndarray) -> np.ndarray:
    keys = np.full((len(signature), BANDS), 1, dtype=np.uint64) * np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        keys = mix(keys * _A + signature[:, r::ROWS])
    return keys.view(np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """``doc_id, node, total, bands, marks`` of each row: the name of its word sequence, its weight, its band keys, a byte of each
    coordinate. Texts do not move."""

    def maker() -> Callable[[list[str | None]], list[pa.Array]]:
        shingler = Shingler()

        def work(texts: list[str | None]) -> list[pa.Array]:
            n = len(texts)
            named, totals, keys, marks = [None] * n, np.zeros(n, dtype=np.int64), [None] * n, [None] * n
            held, sets, units = [], [], 0
            # The words of one text at a time are in memory, and the darts of about ``THROW`` units.
            for i, text in enumerate(texts):
                if bag := words_of(text):
                    named[i] = name(bag)
                    held.append(i)
                    sets.append(shingler.elements(bag))
                    totals[i] = sets[-1][1].sum()
                    units += int(totals[i]) + 8 * K
                if sets and (units > THROW or i == n - 1):
                    made = signatures([e for e, _ in sets], [w for _, w in sets])
                    for j, row, ranks in zip(held, bands(made), mix(made * _C).view(np.int8)[:, ::8].copy(), strict=True):
                        keys[j], marks[j] = row, ranks
                    held, sets, units = [], [], 0
            return [pa.array(named, type=pa.int64()), pa.array(totals), pa.array(keys, type=pa.list_(pa.int64())), pa.array(marks, type=pa.list_(pa.int8()))]

        return work

    return per_text(docs, maker, "node long, total long, bands array<long>, marks array<tinyint>")


def similarity(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (elements, weights)."""
    _, i, j = np.intersect1d(left[0], right[0], assume_unique=True, return_indices=True)
    shared = np.minimum(left[1][i], right[1][j]).sum()
    return float(shared / (left[1].sum() + right[1].sum() - shared))


def compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` with the ``similarity`` of their texts. ``texts``: node, text."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    # Pairs of one pivot come together; skewed pivots are split by the join.
    both = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        last: tuple[int, tuple] | None = None
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, 256):  # few texts at a time are Python's
                for b, x, y in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns[1:]], strict=True):
                    if last is None or last[0] != b:
                        last = (b, shingler.elements(words_of(y)))
                    found.append(similarity(shingler.elements(words_of(x)), last[1]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, type=pa.float64())], names=["a", "b", "similarity"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose texts reach the similarity."""
    return compare(pairs, texts).where(F.col("similarity") >= SIMILARITY).select("a", "b")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node, comp``: each node's least connected node. ``links``: a, b. Links are contracted until none is left.

    Every pass joins each node to its least neighbour, follows the chain by doubling, and renames the links' ends; a pass at
    least halves the nodes that still have links.
    """
    state = nodes.select("node", F.col("node").alias("comp"))
    while not links.isEmpty():
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p"))
        parent = settle(least, "parents")
        while True:
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            longer = settle(parent.join(up, "p").select("a", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "parents")
            parent = longer.drop("moved")
            if longer.where("moved").isEmpty():
                break
        moved = parent.select(F.col("a").alias("comp"), F.col("p").alias("to"))
        state = settle(
            state.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "components"
        )
        ends = links.join(parent.withColumnRenamed("p", "pa"), "a").join(parent.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
        links = settle(ends.where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "links")
    return state


def classes(docs: DataFrame, exact: bool = False) -> DataFrame:
    """``doc_id, node, class_id, class_size, kept``: one row for each input row; ``kept`` marks one row of each class.

    All members of a bucket that may have a link meet, whatever its size; ``exact`` leaves out the rounds that spare comparisons.
    """
    signed = settle(sign(docs), "signatures")
    worded = signed.where("node IS NOT NULL")
    firsts = [F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("total", "bands", "marks")]]
    nodes = settle(worded.groupBy("node").agg(*firsts), "nodes")
    flat = nodes.select("node", "doc_id", "total", F.explode("bands").alias("key"))
    shared = settle(flat.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    placed = settle(flat.join(shared, "key"), "placed")
    # How many texts a node meets in all its buckets: the text that others are copies of meets the most.
    inside = placed.groupBy("node").agg(F.first("doc_id").alias("doc_id"), F.first("total").alias("total"), F.sum("n").alias("meets"))
    inside = settle(inside, "inside")
    texts = settle(_texts(docs, inside), "texts")
    members = settle(placed.select("key", "node", "total").join(inside.select("node", "meets"), "node"), "members")
    discard(placed, shared)
    pivots = settle(members.groupBy("key").agg(F.max(F.struct("meets", "node")).alias("most")).select("key", F.col("most.node").alias("b")), "pivots")

    # First round: every member with the most central member of its bucket.
    starred = members.join(pivots, "key")
    pairs = starred.where("node <> b").select(F.col("node").alias("a"), "total", "b").distinct()
    pairs = pairs.join(inside.select(F.col("node").alias("b"), F.col("total").alias("total_b")), "b")
    compared = settle(compare(pairs.where(_sized("total", "total_b")).select("a", "b"), texts), "compared")
    links = compared.where(F.col("similarity") >= SIMILARITY).select("a", "b")
    state = components(inside, links)
    rest = settle(_unsettled(starred, compared, inside).join(nodes.select("node", "marks"), "node"), "rest")
    discard(members, pivots)
    if not exact:
        state = _neighbours_met(rest, state, texts)
    state = _all_met(rest, state, nodes, texts)
    discard(nodes, texts, rest)
    return _rows(signed, state)


def _open(rest: DataFrame, state: DataFrame) -> DataFrame:
    """The members, with their components, of the buckets that are not one component."""
    joined = rest.join(state, "node")
    apart = rest.select("key", "node").join(state, "node").groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return joined.join(apart.where("lo <> hi").select("key"), "key", "left_semi")


def _linked(links: DataFrame, state: DataFrame) -> DataFrame:
    """The components with links ``a, b`` between nodes added."""
    for end in ("a", "b"):
        links = links.join(state.select(F.col("node").alias(end), F.col("comp").alias(f"comp_{end}")), end)
    links = settle(links.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).distinct(), "links")
    over = components(state.select(F.col("comp").alias("node")).distinct(), links)
    return settle(state.join(over.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp").select("node", F.col("to").alias("comp")), "components")


def _neighbours_met(rest: DataFrame, state: DataFrame, texts: DataFrame) -> DataFrame:
    """Components after the rounds of sorting by lengthened keys."""
    rng = np.random.default_rng(8)
    tried = None
    for _ in range(ROUNDS):
        further = F.array(*[F.element_at("marks", int(i) + 1) for i in rng.permutation(K)[:LENGTH]])
        # Settled, since sorting by ranges reads its rows twice.
        rows = settle(_open(rest, state).select("key", "node", "comp", "total", "near", "far", "marks", further.alias("further")), "open")
        ranges = rows.repartitionByRange("key", "further", "node").sortWithinPartitions("key", "further", "node").drop("further")
        found = ranges.mapInArrow(_closest, "a long, b long").distinct()
        pairs = settle(found if tried is None else found.join(tried, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            break
        tried = pairs if tried is None else tried.unionAll(pairs)
        links = settle(verify(pairs, texts), "near")
        size, found = rows.count(), links.count()
        state = _linked(links, state) if found else state
        discard(rows, links)
        if found < GAIN * size:
            break
    return state


def _closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted members, each one's most agreeing neighbour of another component that can be a near duplicate."""
    tail: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        columns.append(batch.column(6).flatten().to_numpy().reshape(batch.num_rows, K))
        if tail is not None:
            columns = [np.concatenate([t, c]) for t, c in zip(tail, columns, strict=True)]
        tail = [c[-WINDOW:] for c in columns]
        key, node, comp, total, near, far, marks = columns
        best, partner = np.full(len(key), AGREE - 1), np.full(len(key), -1)
        for lag in range(1, min(WINDOW, len(key) - 1) + 1):
            one, two = slice(None, -lag), slice(lag, None)
            able = (key[one] == key[two]) & (comp[one] != comp[two]) & (near[one] - far[two] <= REACH) & (near[two] - far[one] <= REACH)
            able &= np.minimum(total[one], total[two]) >= SIMILARITY * np.maximum(total[one], total[two]) - 1e-9
            i = np.flatnonzero(able)
            j = i + lag
            agree = (marks[i] == marks[j]).sum(axis=1)
            for own, other in ((i, j), (j, i)):
                more = agree > best[own]
                best[own[more]], partner[own[more]] = agree[more], other[more]
        own = np.flatnonzero(partner >= 0)
        ends = node[own], node[partner[own]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(*ends)), pa.array(np.maximum(*ends))], names=["a", "b"])


def _all_met(rest: DataFrame, state: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Components after all members of each bucket that is not one component have met those of other components."""
    left = settle(_open(rest, state).select("key", "node", "comp", "total", "near", "far"), "left")
    if left.isEmpty():
        return state
    sizes = left.groupBy("key").agg(F.greatest(F.count("*") / BLOCK, F.sum("total") / BLOCK_UNITS).alias("blocks"))
    dealt = left.join(sizes.select("key", F.ceil("blocks").alias("blocks")), "key")
    own, other = F.pmod(F.xxhash64("key", "node"), "blocks"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    # A row for each pair of blocks that a member's block is in.
    placed = dealt.withColumn("own", own).withColumn("other", other)
    placed = placed.select(
        "key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"),
        (F.col("own") > F.col("other")).alias("second"), "node", "comp", "total", "near", "far",
    )
    held = placed.join(nodes.select("node", "marks", "bands"), "node").join(texts.hint("merge"), "node").select(*placed.columns, "marks", "bands", "text")
    groups = held.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "node")
    links = settle(groups.mapInArrow(_links, "a long, b long").distinct(), "found")
    discard(left)
    return state if links.isEmpty() else _linked(links, state)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links ``a, b`` between components in each pair of blocks of a bucket; the rows come sorted by bucket and blocks."""
    shingler = Shingler()

    def found(group: pa.Table) -> Iterator[pa.RecordBatch]:
        ends = _group_links(group, shingler)
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in zip(*ends, strict=True)], names=["a", "b"])

    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        place = [batch.column(i).to_numpy() for i in range(3)]
        new = np.logical_or.reduce([p[1:] != p[:-1] for p in place])
        starts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        if kept and [c[0].as_py() for c in kept[0].columns[:3]] != [int(p[0]) for p in place]:
            yield from found(pa.Table.from_batches(kept))
            kept = []
        for start, stop in zip(starts, starts[1:], strict=False):
            kept.append(batch.slice(start, stop - start))
            if stop < batch.num_rows:
                yield from found(pa.Table.from_batches(kept))
                kept = []
    if kept:
        yield from found(pa.Table.from_batches(kept))


def _group_links(group: pa.Table, shingler: Shingler) -> list[tuple[int, int]]:
    """Links that join the components of two blocks (or one) as far as texts reach the similarity.

    A pair is left out if a bound excludes it, if an earlier bucket has it too, or if links found before join its components.
    """
    group = group.combine_chunks()
    key, one, two = (group.column(i)[0].as_py() for i in range(3))
    second, node, comp, total, near, far = (group.column(i).to_numpy() for i in range(3, 9))
    comp = comp.copy()
    if (comp == comp[0]).all():
        return []
    marks, bands = (group.column(i).combine_chunks().flatten().to_numpy().reshape(len(node), -1) for i in (9, 10))
    texts, sets, out = group.column(11), {}, []

    def elements(i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in sets:
            sets[i] = shingler.elements(words_of(texts[i].as_py()))
        return sets[i]

    # Weights in bins by hash, about one unit in a bin: what two texts have in common is at most the sum of the bins' lesser weights.
    bits = min(BIN_BITS, int(total.mean()).bit_length())
    binned, table = np.zeros(len(node), dtype=bool), np.zeros((len(node), 1 << bits), dtype=np.int32)

    def bins(of: np.ndarray) -> np.ndarray:
        for k in of[~binned[of]]:
            codes, weights = elements(k)
            table[k] = np.bincount((codes >> np.uint64(64 - bits)).astype(np.int64), weights, 1 << bits)
        binned[of] = True
        return table[of]

    def meet(i: int, j: np.ndarray) -> None:
        while len(j):
            # The candidates of as much weight as a block may have at once.
            some = j[: max(1, int(np.searchsorted(np.cumsum(total[j]), BLOCK_UNITS)))]
            near_i = some[_similarities(elements(i), [elements(k) for k in some]) >= SIMILARITY]
            for k in near_i:
                if comp[k] != comp[i]:
                    out.append((int(min(node[i], node[k])), int(max(node[i], node[k]))))
                    comp[comp == comp[k]] = comp[i]
            j = j[len(some) :]
            j = j[comp[j] != comp[i]]

    rows = np.flatnonzero(~second) if one != two else np.arange(len(node))
    others = np.flatnonzero(second) if one != two else rows
    for i in rows:
        j = others if one != two else others[others > i]
        j = j[comp[j] != comp[i]]
        j = j[(near[i] - far[j] <= REACH) & (near[j] - far[i] <= REACH)]
        j = j[np.minimum(total[i], total[j]) >= SIMILARITY * np.maximum(total[i], total[j]) - 1e-9]
        if len(j):
            j = j[bands[i][(bands[j] == bands[i]).argmax(axis=1)] == key]
        # Likely pairs come first: what they join need not meet any more. The others are left out only if their bins exclude them.
        likely = np.count_nonzero(marks[j] == marks[i], axis=1) >= AGREE
        meet(i, j[likely])
        j = j[~likely]
        j = j[comp[j] != comp[i]]
        while len(j):
            some = j[: max(1, BIN_CELLS >> bits)]
            most = np.minimum(bins(some), bins(np.array([i]))).sum(axis=1)
            meet(i, some[most >= SIMILARITY * (total[i] + total[some] - most) - 1e-9])
            j = j[len(some) :]
            j = j[comp[j] != comp[i]]
    return out


def _similarities(own: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted Jaccard similarities of one (elements, weights) with others."""
    found, weights = (np.concatenate([o[n] for o in others]) for n in (0, 1))
    starts = np.cumsum([0, *[len(o[0]) for o in others]])[:-1]
    at = np.minimum(np.searchsorted(own[0], found), len(own[0]) - 1)
    shared = np.add.reduceat(np.where(own[0][at] == found, np.minimum(own[1][at], weights), 0), starts)
    return shared / (own[1].sum() + np.add.reduceat(weights, starts) - shared)


#: Largest distance of near duplicates, with room for the last bits of quotients.
REACH = 1 - SIMILARITY + 1e-9


def _unsettled(starred: DataFrame, compared: DataFrame, inside: DataFrame) -> DataFrame:
    """``key, node, total, n, near, far``: the members that may have a link beside those to the centre of their bucket.

    ``near`` and ``far`` bound a member's distance from the centre: it is known where texts were compared, else at least what the
    weights differ by. Members within reach of the centre are in its component; one of the others can reach
    them only if it is within twice that reach of the centre.
    """
    sizes = inside.select(F.col("node").alias("b"), F.col("total").alias("total_b"))
    known = compared.select(F.col("a").alias("node"), "b", (1 - F.col("similarity")).alias("distance"))
    rows = starred.join(sizes, "b").join(known, ["node", "b"], "left")
    apart = 1 - F.least("total", "total_b") / F.greatest("total", "total_b")
    centre = F.col("node") == F.col("b")
    rows = rows.select(
        "key", "node", "total",
        F.when(centre, 0.0).otherwise(F.coalesce("distance", apart)).alias("near"),
        F.when(centre, 0.0).otherwise(F.coalesce("distance", F.lit(1.0))).alias("far"),
    )
    outside = rows.where(F.col("far") > REACH)
    closest = settle(outside.groupBy("key").agg(F.min("near").alias("closest"), F.count("*").alias("others")), "outside")
    held = rows.join(closest, "key").where((F.col("far") > REACH) | (F.col("closest") <= 2 * REACH))
    held = settle(held.drop("closest", "others"), "held")
    sizes = held.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return held.join(sizes, "key")


def _sized(one: str, two: str) -> Column:
    """Sets of too different weight can't reach the similarity."""
    return F.least(one, two) >= SIMILARITY * F.greatest(one, two) - 1e-9


def _rows(signed: DataFrame, state: DataFrame) -> DataFrame:
    """Classes of all rows from the components of the nodes that share a bucket."""
    counted = signed.groupBy("doc_id", "node").agg(F.count("*").alias("copies"))
    rows = settle(counted.join(state, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.col("node").alias("head"))).alias("first")
    named = settle(rows.where("comp IS NOT NULL").groupBy("comp").agg(first, F.sum("copies").alias("class_size")), "classes")
    placed = rows.join(named, "comp", "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("node") == F.col("first.head")) & (F.col("copy") == 1)
    return placed.select(
        "doc_id",
        "node",
        F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        F.when(F.col("comp").isNull(), F.lit(True)).otherwise(stays).alias("kept"),
    )


def _with_node(docs: DataFrame) -> DataFrame:
    """``row`` with all columns, and beside it ``doc_id`` and ``node``, the name of the word sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            row = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
            yield pa.RecordBatch.from_arrays([row, batch.column(at), pa.array([name(words_of(t)) for t in texts], type=pa.int64())], names=["row", "doc_id", "node"])

    at = docs.columns.index("doc_id")
    fields = [StructField("row", docs.schema), docs.schema["doc_id"], StructField("node", LongType())]
    return docs.mapInArrow(run, StructType(fields))


def _chosen(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` with words that ``doc_id, node`` of ``rows`` name, each once, as ``row, doc_id, node``.

    No group of copies has a common key.
    """
    named, one = _with_node(docs).where("node IS NOT NULL"), rows.where("node IS NOT NULL").select(F.col("doc_id").alias("one_id"), F.col("node").alias("one_node"))
    same = named["doc_id"].eqNullSafe(one["one_id"]) & named["node"].eqNullSafe(one["one_node"])
    return named.join(one.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", "node"])


def _texts(docs: DataFrame, inside: DataFrame) -> DataFrame:
    """``node, text``: one text of each node."""
    return _chosen(docs.select("doc_id", "text"), inside).select("node", "row.text")


def op8_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class, in its own columns. Rows without words are classes of their own and all stay."""
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return _chosen(docs, classes(docs).where("kept")).select("row.*").unionAll(docs.where(wordless))
