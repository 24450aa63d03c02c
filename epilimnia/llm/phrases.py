"""Phrase collocations by top-order marginalisation: only the longest windows are counted, ROLLUP sums their prefixes.

Every word starts one window: the word and, in lead columns, the words that follow it in its piece, padded with NULL behind the
piece's end. Windows are the only n-grams that are made. The sum of the windows over their last columns, Spark's ROLLUP, is the
number of times that each shorter phrase starts somewhere, which is its frequency; so single words, pairs and so on need no
explosion of their own.

Windows are counted where the text is read, in chunks of ``CHUNK`` words, and go as compressed blocks to buckets named by
the hash of language and first two words. A bucket holds all windows of its pairs, so it knows a prefix of two or more words that
is rarer than ``min_count``: such windows are cut to the longest prefix that is frequent enough (the rest is padding), which
leaves every sum that the result needs as it is. The number of buckets follows the size of the corpus.

Defined results: NULL and empty texts have no words, NULL languages count as ``und``; repeated rows and repeated ids count
each; texts of any length are read whole; extra columns are ignored; an empty table gives an empty result. Equal scores are
ordered by frequency, then by the phrase's bytes.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epilimnia.llm.common import read_table, settle

MAX_WORDS, MIN_COUNT, COVERED_PERCENT, TOP = 3, 10, 50, 2000
#: Windows that a task counts before it sends them on.
CHUNK = 2_000_000
#: Bytes of text for which a bucket is made: it holds its share of the windows in one task.
BUCKET_BYTES = 8_000_000
#: Bytes of text that are split into words at once.
SLICE = 1 << 20

_CUT = 0xFF  # a byte that no UTF-8 text has
#: Characters that end a piece, and the spaces between words.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_BYTES = bytes(_CUT if b in PIECE_ENDS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens(text: str | None) -> Iterator[list[bytes]]:
    """Lower-cased words of a text, slice after slice; ``b"\\xff"`` stands where a piece ends."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_BYTES)
    at = 0
    while at < len(data):
        end = at + SLICE
        if end < len(data):
            space = data.find(b" ", end)
            end = len(data) if space < 0 else space
        yield data[at:end].replace(b"\xff", b" \xff ").split()
        at = end


class Counter:
    """Windows of one language in one task."""

    def __init__(self, size: int, buckets: int) -> None:
        self.size, self.buckets = size, buckets
        self.clear()

    def clear(self) -> None:
        self.codes: dict[bytes, int] = defaultdict(count().__next__)
        self.codes[b"\xff"]  # noqa: B018  code 0
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, text: str | None) -> int:
        before = self.held
        for words in tokens(text):
            self.parts.append(np.fromiter(map(self.codes.__getitem__, words), dtype=np.int32, count=len(words)))
            self.held += len(words)
        self.parts.append(np.zeros(1, dtype=np.int32))
        return self.held - before

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """``bucket, block`` of the counted windows; starts anew."""
        codes = np.concatenate([*self.parts, np.zeros(self.size, dtype=np.int32)])
        words = list(self.codes)
        self.clear()
        columns = [codes[: len(codes) - self.size]]
        for i in range(1, self.size):
            lead = codes[i : len(codes) - self.size + i]
            columns.append(np.where(columns[-1] == 0, 0, lead))
        grid = np.stack([c[columns[0] != 0] for c in columns], axis=1)
        if not len(grid):
            return
        grid, n = counted(grid, np.ones(len(grid), dtype=np.int64))
        names = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
        names[0] = 0
        mixed = names[grid[:, 0]] * np.uint64(0x9E3779B97F4A7C15) + (names[grid[:, 1]] if self.size > 1 else np.uint64(0))
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        bucket = ((mixed >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        grid, n, bucket = grid[order], n[order], bucket[order]
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            yield int(bucket[lo]), packed(grid[lo:hi], n[lo:hi], words)


def counted(grid: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and the sums of ``n``."""
    order = np.lexsort(grid.T[::-1])
    grid, n = grid[order], n[order]
    first = np.flatnonzero(np.r_[True, (grid[1:] != grid[:-1]).any(axis=1)])
    return grid[first], np.add.reduceat(n, first)


def packed(grid: np.ndarray, n: np.ndarray, words: list[bytes]) -> bytes:
    """One block: the words that occur, and columns of their places."""
    used, local = np.unique(grid, return_inverse=True)
    text = b"\n".join(words[i] for i in used)
    columns = [*local.reshape(grid.shape).T.astype(np.uint32), n.astype(np.int64)]
    body = struct.pack("<4I", len(used), len(text), len(n), grid.shape[1]) + text + b"".join(c.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpacked(block: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(block)
    used, length, rows, size = struct.unpack_from("<4I", body)
    at = struct.calcsize("<4I")
    words = body[at : at + length].split(b"\n") if used else []
    at += length
    columns = [np.frombuffer(body, dtype=np.uint32, count=rows, offset=at + 4 * rows * i) for i in range(size)]
    return words, np.stack(columns, axis=1).astype(np.int64), np.frombuffer(body, dtype=np.int64, count=rows, offset=at + 4 * rows * size)


def merged(blocks: list[bytes], min_count: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words, windows and counts of a bucket; windows cut behind their longest frequent prefix."""
    codes: dict[bytes, int] = defaultdict(count().__next__)
    codes[b"\xff"]  # noqa: B018
    grids, sums = [], []
    for block in blocks:
        words, grid, n = unpacked(block)
        grids.append(np.fromiter(map(codes.__getitem__, words), dtype=np.int64, count=len(words))[grid])
        sums.append(n)
    grid, n = counted(np.concatenate(grids), np.concatenate(sums))
    for size in range(grid.shape[1], 1, -1):
        first = np.flatnonzero(np.r_[True, (grid[1:, :size] != grid[:-1, :size]).any(axis=1)])
        total = np.add.reduceat(n, first)
        rare = np.repeat(total < min_count, np.diff(np.r_[first, len(grid)]))
        grid[rare, size - 1] = 0
    grid, n = counted(grid, n)
    return list(codes), grid, n


def windows(docs: DataFrame, size: int, min_count: int, buckets: int) -> DataFrame:
    """``lang, w1 .. w<size>, n``: counted windows, NULL as padding."""
    lang = F.coalesce("lang", F.lit("und")).alias("lang")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, Counter] = {}
        held = 0

        def sent(lang: str) -> Iterator[pa.RecordBatch]:
            for bucket, block in counters[lang].blocks():
                yield pa.RecordBatch.from_pydict({"lang": [lang], "bucket": pa.array([bucket], pa.int32()), "block": [block]})

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in counters:
                    counters[lang] = Counter(size, buckets)
                held += counters[lang].add(text)
                if held >= CHUNK:
                    most = max(counters, key=lambda k: counters[k].held)
                    held -= counters[most].held
                    yield from sent(most)
        for lang in counters:
            yield from sent(lang)

    columns = [f"w{i + 1}" for i in range(size)]

    def merge(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        words, grid, n = merged(list(blocks["block"]), min_count)
        texts = np.array([None, *[w.decode("utf-8", "surrogatepass") for w in words[1:]]], dtype=object)
        return pd.DataFrame({"lang": key[0], **{c: texts[grid[:, i]] for i, c in enumerate(columns)}, "n": n})

    blocks = docs.select(lang, "text").mapInArrow(read, "lang string, bucket int, block binary")
    schema = f"lang string, {', '.join(f'{c} string' for c in columns)}, n long"
    return blocks.repartition(buckets, "lang", "bucket").groupBy("lang", "bucket").applyInPandas(merge, schema)


def frequencies(docs: DataFrame, size: int = MAX_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """``lang, words, w1 .. w<size>, f``: phrases of ``words`` words that occur ``min_count`` times; with 0 words, all words."""
    volume = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    columns = [f"w{i + 1}" for i in range(size)]
    rolled = windows(docs, size, min_count, 1 + volume // BUCKET_BYTES).rollup("lang", *columns)
    sums = rolled.agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))
    # Columns that were summed over are set bits at the end of the grouping number.
    words = (size - F.length(F.regexp_replace(F.bin("g"), "0", ""))).cast("int")
    padded = F.element_at(F.array(*[F.col(c).isNull() for c in columns]), F.greatest("words", F.lit(1))) & (F.col("words") > 0)
    kept = sums.withColumn("words", words).where((F.col("words") >= 0) & ~padded)
    return kept.where((F.col("words") == 0) | (F.col("f") >= min_count)).select("lang", "words", *columns, "f")


def candidates(docs: DataFrame, size: int = MAX_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """``lang, words, phrase, a, l, r, n, score``: all phrases of 2 to ``size`` words with their worst cut."""
    grams = settle(frequencies(docs, size, min_count), "phrases")
    phrase = lambda i, j: F.concat_ws(" ", *[F.col(f"w{k}") for k in range(i, j + 1)])
    named = grams.where("words > 0").withColumn("phrase", F.concat_ws(" ", *[f"w{i + 1}" for i in range(size)])).select("lang", "phrase", "f")
    totals = grams.where("words = 0").select("lang", F.col("f").alias("n"))
    out = None
    for m in range(2, size + 1):
        rows = grams.where(F.col("words") == m).select("lang", *[f"w{i + 1}" for i in range(m)], F.col("f").alias("a"), phrase(1, m).alias("phrase"))
        cuts = []
        for k in range(1, m):
            for side, part in (("l", phrase(1, k)), ("r", phrase(k + 1, m))):
                name = f"{side}{k}"
                rows = rows.withColumn(f"{name}_phrase", part)
                other = named.select(F.col("lang").alias("lang2"), F.col("phrase").alias("phrase2"), F.col("f").alias(name))
                rows = rows.join(other, (F.col("lang") == F.col("lang2")) & (F.col(f"{name}_phrase") == F.col("phrase2"))).drop("lang2", "phrase2", f"{name}_phrase")
            whole = lambda c: F.col(c).cast("decimal(19,0)")
            rows = rows.withColumns({f"over{k}": whole("a") * whole("a") * F.lit(1_000_000).cast("decimal(7,0)"), f"under{k}": whole(f"l{k}") * whole(f"r{k}")})
            score = F.expr(f"over{k} div under{k}").cast("long")
            cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        worst = F.least(*cuts) if len(cuts) > 1 else cuts[0]
        rows = rows.withColumn("worst", worst).select("lang", F.lit(m).alias("words"), "phrase", "a", "worst.l", "worst.r", "worst.score")
        out = rows if out is None else out.unionAll(rows)
    return out.join(totals, "lang").select("lang", "words", "phrase", "a", "l", "r", "n", "score")


def collocations(
    docs: DataFrame, size: int = MAX_WORDS, min_count: int = MIN_COUNT, covered_percent: int = COVERED_PERCENT, top: int = TOP
) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase that lies in a longer candidate with at least ``covered_percent`` of its occurrences is left out.
    """
    found = settle(candidates(docs, size, min_count), "candidates")
    left = found
    if size > 2:
        words, m = F.split("phrase", " "), F.col("words")
        spans = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(k).alias("size")) for k in range(2, size) for i in range(1, size - k + 2)])
        inside = found.where(m > 2).withColumn("span", F.explode(spans)).where((F.col("span.size") < m) & (F.col("span.at") + F.col("span.size") - 1 <= m))
        part = F.concat_ws(" ", F.slice(words, F.col("span.at"), F.col("span.size")))
        longest = inside.select("lang", part.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        left = found.join(longest, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered_percent * F.col("a")))
    ranked = left.selectExpr("*", "row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank")
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


ORACLE = {
    "op13_phrases": f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0b\\x0c\\r]')) AS piece FROM documents),
ordered AS (SELECT row_number() OVER () AS p, lang, piece FROM pieces),
split AS (SELECT p, lang, unnest(string_split_regex(piece, '[ \\t]+')) AS w, generate_subscripts(string_split_regex(piece, '[ \\t]+'), 1) AS i FROM ordered),
words AS (SELECT p, lang, i, w AS w1, lead(w, 1) OVER s AS w2, lead(w, 2) OVER s AS w3 FROM split WHERE w <> '' WINDOW s AS (PARTITION BY p ORDER BY i)),
total AS (SELECT lang, count(*) AS n FROM words GROUP BY ALL),
grams AS (
  SELECT lang, 1 AS m, w1 AS phrase, w1, NULL AS w2, NULL AS w3, count(*) AS f FROM words GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, w1, w2, NULL, count(*) FROM words WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, w1, w2, w3, count(*) FROM words WHERE w3 IS NOT NULL GROUP BY ALL),
cuts AS (
  SELECT lang, m, phrase, f AS a, 1 AS k, w1 AS x, CASE m WHEN 2 THEN w2 ELSE w2 || ' ' || w3 END AS y FROM grams WHERE m > 1 AND f >= {MIN_COUNT}
  UNION ALL SELECT lang, m, phrase, f, 2, w1 || ' ' || w2, w3 FROM grams WHERE m = 3 AND f >= {MIN_COUNT}),
scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.k, l.f AS l, r.f AS r,
    CAST((1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cuts c JOIN grams l ON l.lang = c.lang AND l.phrase = c.x JOIN grams r ON r.lang = c.lang AND r.phrase = c.y),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
covered AS (
  SELECT lang, w1 || ' ' || w2 AS phrase, f FROM grams WHERE m = 3 AND f >= {MIN_COUNT}
  UNION ALL SELECT lang, w2 || ' ' || w3, f FROM grams WHERE m = 3 AND f >= {MIN_COUNT}),
remaining AS (
  SELECT * FROM worst w WHERE NOT EXISTS (
    SELECT 1 FROM covered c WHERE c.lang = w.lang AND c.phrase = w.phrase AND w.m = 2 AND 100 * c.f >= {COVERED_PERCENT} * w.a))
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS INT) AS rank, phrase, a, l, r, n, score
FROM remaining JOIN total USING (lang) QUALIFY rank <= {TOP}
"""
}
