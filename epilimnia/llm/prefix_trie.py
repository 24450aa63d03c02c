"""Prefix trie of conversations: ternary search trees over dictionary-encoded turns, one for each range of conversations.

Turns (role and text) are named by their SHA-256 and numbered by a distributed dictionary, so texts stay where they are read.
A conversation becomes a row of numbers. Equal rows are counted before they move; the distinct ones are dealt to shards by ranges of
their order, about ``SHARD`` turns in each. A shard puts its rows into a ternary search tree, middle rows first, which keeps it
balanced. One walk over the tree, children before their parents, adds up members, leaves and savings.

Only the prefixes of a shard's first and last row, its boundary nodes, may occur in other shards. They leave a shard with what lies
below them beside other boundary nodes. The boundary nodes of ``FAN`` neighbouring shards are merged in one task, and so on until one
task has those of all: each round leaves one task in ``FAN``.

Defined results: turns are ordered by turn number, NULL first, and those of one number by their SHA-256; repeated rows are turns of
their own. NULL roles and texts are empty. Rows without a conv_id belong to no conversation and are left out. Texts of any length are
read whole, extra columns are ignored, and an empty table gives an empty result. The numbers of one conversation's turns (16
bytes a turn) are held in one task, their texts nowhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epilimnia.llm.common import read_table, settle

#: Turns that a shard holds, about.
SHARD = 500_000
#: Shards whose boundary nodes meet in one task.
FAN = 64
#: Decimal ids of a node's members that are joined before they meet in one task.
IDS = 8_192
#: Conversations of a family share its first one's head, of fewer turns than HEAD.
FAMILY, HEAD = 100, 6

EMPTY = hashlib.sha256().hexdigest()
_COLUMNS = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: Besides a node's columns: its name and its parent's, where another task needs them; whether it is an unmerged boundary node, and then
#: the code points of its last text, its shard, and whether the shard's first or last row ends there.
_SCHEMA = f"{_COLUMNS}, key binary, parent binary, open boolean, chars long, shard long, first boolean, last boolean"
_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
_ARROW = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in _SCHEMA.split(", ")])


class TernaryTree:
    """Rows of numbers in a ternary search tree; every node stands for a prefix, node 0 for the empty one."""

    def __init__(self) -> None:
        self.symbol, self.chars, self.low, self.high, self.down, self.up, self.depth = [0], [0], [-1], [-1], [-1], [-1], [0]

    def insert(self, row: list[int], chars: list[int]) -> int:
        """The node of the row."""
        symbol, low, high, down = self.symbol, self.low, self.high, self.down
        at = 0
        for s, c in zip(row, chars, strict=True):
            links, here, node = down, at, down[at]
            while node >= 0 and symbol[node] != s:
                links, here = (low, node) if s < symbol[node] else (high, node)
                node = links[here]
            if node < 0:
                node = links[here] = len(symbol)
                symbol.append(s)
                self.chars.append(c)
                self.up.append(at)
                self.depth.append(self.depth[at] + 1)
                for made in (low, high, down):
                    made.append(-1)
            at = node
        return at

    def insert_balanced(self, rows: list[list[int]], chars: list[list[int]]) -> list[int]:
        """Nodes of sorted rows, which go in from the middle outwards."""
        places, todo = [0] * len(rows), [(0, len(rows))]
        while todo:
            a, b = todo.pop()
            if a < b:
                m = (a + b) // 2
                places[m] = self.insert(rows[m], chars[m])
                todo += [(m + 1, b), (a, m)]
        return places

    def walk(self) -> list[int]:
        """All nodes, parents before their children."""
        out, todo = [], [0]
        while todo:
            node = todo.pop()
            out.append(node)
            todo += [x for x in (self.high[node], self.down[node], self.low[node]) if x >= 0]
        return out

    def path(self, node: int) -> list[int]:
        """Nodes from the root to this one."""
        out = [node]
        while self.up[out[-1]] >= 0:
            out.append(self.up[out[-1]])
        return out[::-1]


def total(order: list[int], up: list[int], depth: list[int], boundary: set[int], sums: dict[str, list]) -> None:
    """Add up the sums of all nodes below each node, without what lies below boundary nodes; ``order`` has parents first."""
    n, low, children, leaves, saved, chars = (sums[c] for c in ("n", "low", "children", "leaves", "saved", "chars"))
    for node in reversed(order):
        if node in boundary:
            continue
        leaves[node] = leaves[node] if children[node] else 1
        saved[node] += (n[node] - 1) * chars[node] if depth[node] else 0
        above = up[node]
        if above >= 0:
            n[above] += n[node]
            low[above] = low[node] if low[above] is None else min(low[above], low[node])
            children[above] += 1
            leaves[above] += leaves[node]
            saved[above] += saved[node]


def shard(rows: dict[str, list], number: int) -> pa.RecordBatch:
    """Nodes of the sorted rows ``ids, chars, n, low, sha`` of a shard."""
    tree = TernaryTree()
    places = tree.insert_balanced(rows["ids"], rows["chars"])
    count = len(tree.symbol)
    sums = {"n": [0] * count, "low": [None] * count, "children": [0] * count, "leaves": [0] * count, "saved": [0] * count, "chars": tree.chars}
    sha = [EMPTY] * count
    for at, n, low, ends in zip(places, rows["n"], rows["low"], rows["sha"], strict=True):
        sums["n"][at], sums["low"][at], sha[at] = n, low, ends
    first, last = places[0], places[-1]
    boundary, names = {0}, {0: hashlib.sha256()}
    for node in (*tree.path(first)[1:], *tree.path(last)[1:]):
        if node not in names:
            boundary.add(node)
            names[node] = names[tree.up[node]].copy()
            names[node].update(tree.symbol[node].to_bytes(8, "little"))
    order = tree.walk()
    total(order, tree.up, tree.depth, boundary, sums)
    return _nodes(order, tree.up, tree.depth, boundary, sums, sha, {k: v.digest() for k, v in names.items()}, boundary, number, first, last)


def merge(rows: dict[str, list], number: int, last_round: bool) -> pa.RecordBatch:
    """Nodes of the boundary nodes of neighbouring shards."""
    keys_of = rows["key"]
    keys = list(dict.fromkeys(keys_of))
    place = {k: i for i, k in enumerate(keys)}
    count = len(keys)
    sums = {"n": [0] * count, "low": [None] * count, "children": [0] * count, "leaves": [0] * count, "saved": [0] * count, "chars": [0] * count}
    up, depth, sha = [-1] * count, [0] * count, [EMPTY] * count
    given = ("key", "parent", "depth", "chars", "n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    for key, parent, d, c, n, low, ch, le, sa, ends in zip(*[rows[g] for g in given], strict=True):
        at = place[key]
        up[at] = -1 if parent is None else place[parent]
        depth[at], sums["chars"][at] = d, c
        for k, v in (("n", n), ("children", ch), ("leaves", le), ("saved", sa)):
            sums[k][at] += v
        if low is not None:
            sums["low"][at] = low if sums["low"][at] is None else min(sums["low"][at], low)
        if ends != EMPTY:
            sha[at] = ends
    first = place[min((s, k) for s, k, edge in zip(rows["shard"], keys_of, rows["first"], strict=True) if edge)[1]]
    last = place[max((s, k) for s, k, edge in zip(rows["shard"], keys_of, rows["last"], strict=True) if edge)[1]]
    boundary: set[int] = set()
    for node in () if last_round else (first, last):
        while node >= 0:
            boundary.add(node)
            node = up[node]
    order = sorted(range(count), key=depth.__getitem__)
    total(order, up, depth, boundary, sums)
    return _nodes(order, up, depth, boundary, sums, sha, dict(enumerate(keys)), boundary, number, first, last)


def _nodes(order, up, depth, boundary, sums, sha, names, parents, number, first, last) -> pa.RecordBatch:
    """All nodes as rows. Parents that are still open are named, and looked up when they are merged."""
    n, low, chars = sums["n"], sums["low"], sums["chars"]
    above = [up[i] for i in order]
    columns = {
        "conv_id": [low[i] for i in order],
        "depth": [depth[i] for i in order],
        "parent_conv_id": [None if a < 0 or a in parents else low[a] for a in above],
        "n_convs": [n[i] for i in order],
        "n_children": [sums["children"][i] for i in order],
        "n_leaves": [sums["leaves"][i] for i in order],
        "saved_tokens": [sums["saved"][i] for i in order],
        "ends_sha256": [sha[i] for i in order],
        "key": [names.get(i) for i in order],
        "parent": [names[a] if a in parents else None for a in above],
        "open": [i in boundary for i in order],
        "chars": [chars[i] for i in order],
        "shard": [number] * len(order),
        "first": [i == first for i in order],
        "last": [i == last for i in order],
    }
    return pa.RecordBatch.from_pydict(columns, schema=_ARROW)


def encode(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order, as array of (number in the dictionary, code points of the text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sha = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", sha.alias("sha"), F.length(text).cast("long").alias("chars"))
    rows = settle(rows, "turns")
    numbered = settle(rows.groupBy("sha").agg(F.max("chars").alias("chars")).withColumn("id", F.monotonically_increasing_id()), "dictionary")
    coded = rows.drop("chars").join(numbered, "sha")
    turn = F.struct("turn", "sha", "id", "chars")
    ordered = coded.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("all"))
    return ordered.select("conv_id", F.transform("all", lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars"))).alias("turns"))


def rebuild(own: DataFrame, family: int = FAMILY, head: int = HEAD) -> DataFrame:
    """Each conversation with its first turns replaced by those of the first conversation of its family."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % head).cast("int")
    heads = own.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, head - 1).alias("head"))
    rows = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(heads, "base", "left")
    none = F.slice("turns", 1, 0)
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    return rows.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), rest).alias("turns"))


def end_hashes(members: DataFrame) -> DataFrame:
    """``row, sha``: SHA-256 of the comma-joined ids of the conversations that are equal to a row. ``members``: row, conv_id.

    A row's ids are sorted by range, so a large group lies in several tasks, and are joined there; what meets in one task to
    be hashed in order are the joined pieces.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, first, ids = None, None, []
        for batch in batches:
            made = []
            for r, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if r != row or len(ids) == IDS:
                    if ids:
                        made.append((row, first, ",".join(ids)))
                    row, first, ids = r, c, []
                ids.append(str(c))
            yield _batch(made, pieces)
        yield _batch([(row, first, ",".join(ids))] if ids else [], pieces)

    def hash_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, digest = None, None
        for batch in batches:
            made = []
            for r, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if r != row:
                    if digest:
                        made.append((row, digest.hexdigest()))
                    row, digest = r, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            yield _batch(made, hashes)
        yield _batch([(row, digest.hexdigest())] if digest else [], hashes)

    pieces, hashes = pa.schema([("row", pa.string()), ("first", pa.int64()), ("ids", pa.string())]), pa.schema([("row", pa.string()), ("sha", pa.string())])
    ranges = members.repartitionByRange("row", "conv_id").sortWithinPartitions("row", "conv_id")
    joined = ranges.mapInArrow(join, "row string, first long, ids string")
    return joined.repartition("row").sortWithinPartitions("row", "first").mapInArrow(hash_in_order, "row string, sha string")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def trie(conversations: DataFrame, shard_turns: int = SHARD, fan: int = FAN) -> DataFrame:
    """All nodes of the trie of rows ``conv_id, turns``."""
    row = F.sha2(F.array_join(F.col("turns.id").cast("array<string>"), ","), 256)
    rows = settle(conversations.select("conv_id", row.alias("row"), F.col("turns.id").alias("ids"), F.col("turns.chars").alias("chars")), "rows")
    hashes = settle(end_hashes(rows.select("row", "conv_id")), "ends")
    distinct = rows.groupBy("row", "ids", "chars").agg(F.count("*").alias("n"), F.min("conv_id").alias("low"))
    distinct = settle(distinct.join(hashes, "row").drop("row"), "distinct")
    turns = distinct.select(F.sum(F.size("ids"))).first()[0] or 0
    shards = 1 + turns // shard_turns

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            yield shard(pa.Table.from_batches(held).to_pydict(), TaskContext.get().partitionId())

    ranges = distinct.select("ids", "chars", "n", "low", "sha").repartitionByRange(shards, "ids").sortWithinPartitions("ids")
    made = [settle(ranges.mapInArrow(build, _SCHEMA), "nodes")]
    left = 1 + made[0].agg(F.coalesce(F.max("shard"), F.lit(0))).first()[0]
    while len(made) == 1 or left > 1:
        left = -(-left // fan)
        made.append(settle(_merged(made[-1].where("open"), fan, left == 1), "nodes"))
    return named_parents(made)


def _merged(nodes: DataFrame, fan: int, last_round: bool) -> DataFrame:
    def step(key: tuple, part: pa.Table) -> pa.Table:
        return pa.Table.from_batches([merge(part.to_pydict(), key[0].as_py(), last_round)])

    return nodes.withColumn("group", F.expr(f"shard div {fan}")).groupBy("group").applyInArrow(step, _SCHEMA)


def named_parents(made: list[DataFrame]) -> DataFrame:
    """The finished nodes of all rounds; parents that were open then are found among the merged ones."""
    finished = [nodes.where("NOT open") for nodes in made]
    merged = reduce(DataFrame.unionAll, finished[1:])
    done = finished[0].unionAll(merged)
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    above = merged.select(F.col("key").alias("parent"), F.col("conv_id").alias("found"))
    near = done.where("parent IS NULL")
    far = done.where("parent IS NOT NULL").join(above, "parent").withColumn("parent_conv_id", F.col("found"))
    return near.select(names).unionAll(far.select(names))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = settle(encode(read_table(spark, sf_dir, "conversations")), "conversations")
    return trie(rebuild(own))


ORACLE = {
    "op11_prefix_trie": """
WITH turns AS (
  SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t, length(coalesce(text, '')) AS c,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, t) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda crc, b: list_reduce([xor(crc, b)] || [CAST(i AS BIGINT) FOR i IN range(8)],
        lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 6 AS h
  FROM turns),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, pos, t, c FROM convs c JOIN turns s ON s.conv_id = c.base AND s.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, pos, t, c FROM convs c JOIN turns s ON s.conv_id = c.conv_id AND s.pos > c.h),
rows AS (
  SELECT conv_id, coalesce(path, []) AS path, coalesce(chars, []) AS chars FROM (SELECT conv_id FROM convs) LEFT JOIN (
    SELECT conv_id, list(t ORDER BY part, pos) AS path, list(c ORDER BY part, pos) AS chars FROM rebuilt GROUP BY conv_id) USING (conv_id)),
prefixes AS (SELECT conv_id, d, path[1:d] AS p, coalesce(chars[d], 0) AS c, len(path) = d AS ends FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM rows)),
nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(c) AS c,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (p)),
below AS (
  SELECT p, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM (
    SELECT p[1:unnest(range(0, d + 1))] AS p, CAST(n_children = 0 AS INT) AS leaf, (n_convs - 1) * c AS saved FROM whole) GROUP BY p)
SELECT w.conv_id, w.d AS depth, up.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM whole w JOIN below USING (p) LEFT JOIN nodes up ON w.d > 0 AND up.p = w.p[1:w.d - 1]
"""
}
