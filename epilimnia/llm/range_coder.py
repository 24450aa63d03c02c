"""Token ids on disk: static range asymmetric numeral system (rANS) in independent interleaved blocks.

All blocks share one table of frequencies, counted over the whole corpus. A block holds whole documents in ascending doc_id order
and is coded in ``LANES`` interleaved states, so that one step codes as many ids at once. Every ``SEGMENT`` steps the states and
the place in the words are noted: decoding starts at all these checkpoints at the same time, or at any one alone. The checksum of
a block's ids is verified when it is read.

Files below a folder: ``blocks`` (Parquet, a row for each block: ``shard``, ``block``, ``start``, ``doc_ids``, ``lengths``, ``ids_crc32``
per document, ``words``, ``states``, ``offsets``, ``crc32``), ``table`` (``token, frequency``). A shard is one task's range of ids;
``start`` counts the ids before the block in its shard.

Defined results: a NULL text counts as empty and has only the end id. Documents with the same id stand next to each other, ordered
by their ids' bytes; a NULL doc_id comes first. A document longer than ``BLOCK`` is a block of its own. An empty table writes
no block. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from epilimnia.llm.common import read_table, settle, shared_folder
from epilimnia.llm.trie_bpe import byte_letters

END = 2
SCALE = 18  # bits of the frequencies' sum
LOW = 31  # a state stays in [2^LOW, 2^(LOW+32))
LANES = 1024
SEGMENT = 64
BLOCK = 131_072
#: Ids in a shard, on average; each shard is sorted and coded by one task.
SHARD = 8_000_000
#: Words and pieces that a task remembers, those that the library gets at once, and bytes of text that are encoded at once.
CACHE, SLICE, PART_BYTES = 400_000, 2_000, 16 << 20

#: The library's steps before its merges, as the vocabulary's file states them (fixed values).
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Printable ASCII, Latin-1 and Latin Extended-A without the one letter that becomes two in lower case: the first step leaves these
#: as they are, the next ones take each alone. Words hold no line ends, which part them here.
_LATIN = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x180)) if c != 0x130]
_LETTER, _NUMBER = ("".join(c for c in _LATIN if unicodedata.category(c)[0] == kind) for kind in "LN")
PLAIN = re.compile(f"[\n{re.escape(''.join(_LATIN))}]*")
#: ``PATTERN`` for plain words, and the ends of words.
CUT = re.compile(f"[{_LETTER}]+|[{_NUMBER}]|'(?:s|t|re|ve|m|ll|d)|[^\\n{_LETTER}{_NUMBER}]+|\\n")
#: The letter of each byte in the vocabulary but that of a blank, which parts pieces.
LETTERS = {byte: letter for letter, byte in byte_letters().items() if byte != 32}

BLOCKS = (
    "shard int, block int, start long, doc_ids array<long>, lengths array<int>, ids_crc32 array<long>, "
    "words binary, states binary, offsets array<int>, crc32 long"
)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2^SCALE, at least 1 for every id that occurs."""
    total, whole = counts.sum(), 1 << SCALE
    if not total:
        return np.zeros(len(counts), dtype=np.int64)
    if np.count_nonzero(counts) > whole:
        raise ValueError("more different ids than the table has places")
    out = np.where(counts > 0, np.maximum(1, counts * (whole / total)), 0).astype(np.int64)
    while (gap := int(out.sum()) - whole) != 0:  # taken from, or given to, the most frequent ids
        top = np.argsort(-out, kind="stable")[: max(1, min(len(out), abs(gap)))]
        if gap > 0:
            top = top[out[top] > 1]
            share = np.minimum(out[top] - 1, -(-gap // len(top)))
            share = np.minimum(share, np.maximum(0, gap - (np.cumsum(share) - share)))
            out[top] -= share
        else:
            out[top[0]] -= gap
    return out


class Coder:
    def __init__(self, frequency: np.ndarray) -> None:
        self.f = frequency.astype(np.uint64)
        ends = np.cumsum(frequency)
        self.c = (ends - frequency).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(frequency), dtype=np.uint32), frequency)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Words, the states at each checkpoint (a row each), and the checkpoints' offsets in the words."""
        lanes = min(LANES, max(1, len(ids)))
        steps = -(-len(ids) // lanes)
        state = np.full(lanes, 1 << LOW, dtype=np.uint64)
        f, c = self.f[ids], self.c[ids]
        limit = f << np.uint64(LOW + 32 - SCALE)
        written: list[np.ndarray] = []
        count, kept = 0, []
        for step in range(steps - 1, -1, -1):
            at = slice(step * lanes, min(len(ids), (step + 1) * lanes))
            x = state[: at.stop - at.start]
            full = x >= limit[at]
            if full.any():
                written.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
                count += len(written[-1])
                x[full] >>= np.uint64(32)
            q, r = np.divmod(x, f[at])
            x[:] = (q << np.uint64(SCALE)) + r + c[at]
            if step % SEGMENT == 0:
                kept.append((state.copy(), count))
        words = np.concatenate(written[::-1]) if written else np.zeros(0, dtype="<u4")
        kept.reverse()
        return words, np.array([s for s, _ in kept], dtype="<u8"), [count - n for _, n in kept]

    def decode(self, words: np.ndarray, states: np.ndarray, offsets: list[int], n: int) -> np.ndarray:
        """All ids; every segment advances by one step at a time."""
        lanes = states.shape[1]
        steps = -(-n // lanes)
        x, place = states.astype(np.uint64), np.array(offsets, dtype=np.int64)
        out = np.zeros((len(states), SEGMENT, lanes), dtype=np.uint32)
        first = np.arange(len(states)) * SEGMENT * lanes
        padded = np.append(words.astype(np.uint64), np.zeros(1, dtype=np.uint64))
        mask = np.uint64((1 << SCALE) - 1)
        lane = np.arange(lanes)
        for step in range(min(SEGMENT, steps)):
            live = (first + step * lanes)[:, None] + lane < n
            slot = x & mask
            symbol = self.symbol[slot]
            new = self.f[symbol] * (x >> np.uint64(SCALE)) + slot - self.c[symbol]
            x = np.where(live, new, x)
            short = live & (x < np.uint64(1 << LOW))
            order = np.cumsum(short, axis=1)
            take = np.minimum(place[:, None] + order - 1, len(words))
            x = np.where(short, (x << np.uint64(32)) | padded[take], x)
            place += order[:, -1]
            out[:, step] = symbol
        return out.reshape(-1)[:n] if len(states) == 1 else np.concatenate([o.reshape(-1) for o in out])[:n]


class Sequences:
    """Sequences of ids by number, one after another in an array."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray) -> None:
        self.data, self.sizes = data, sizes.astype(np.int32)
        self.starts = (np.cumsum(sizes) - sizes).astype(np.int32)

    def add(self, other: Sequences) -> None:
        self.starts = np.concatenate([self.starts, other.starts + np.int32(len(self.data))])
        self.data, self.sizes = np.concatenate([self.data, other.data]), np.concatenate([self.sizes, other.sizes])

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered sequences in their order, and how many each has."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes, dtype=np.int64)
        if not len(ends) or ends[-1] < 1 << 31:
            ends = ends.astype(np.int32)
        places = np.repeat(self.starts[numbers] - (ends - sizes), sizes)
        places += np.arange(len(places), dtype=places.dtype)
        return self.data[places], sizes


class WordEncoder:
    """Ids of white-space words, by the library; remembers pieces of words, and words that it does not cut.

    Words of ``PLAIN`` characters are cut by the vocabulary's own pattern here, and the library merges each different piece once,
    many at a time, without its normaliser and pattern; the ids at which a piece may end part the result. All other words are
    encoded as they are, joined by a word that none of them holds, whose id parts the result. ``last`` is that of ``piece_ends``.
    """

    MARK = "\x00"

    def __init__(self, tokenizer: str, width: str, last: np.ndarray | None) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.width, self.last = Tokenizer.from_str(tokenizer), width, last
        self.library.no_truncation()
        self.library.no_padding()
        mark = self._ids(self.MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        self.merger = Tokenizer(self.library.model)
        self.merger.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        # The end of a word counts as a piece without ids.
        self.numbers = {"\n": 0}
        self.pieces = Sequences(np.zeros(0, dtype=self.width), np.zeros(1, dtype=np.int64))

    def _ids(self, text: str, merge: bool = False) -> np.ndarray:
        encoder = self.merger if merge else self.library
        return np.array(encoder.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.width)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        if len(self.numbers) + len(self.known) > CACHE:
            self.forget()
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        cut, place = self._cut(words), coded.indices.to_numpy()
        if cut.all():
            found = self._plain(words)
        else:
            found = self._plain([w for w, c in zip(words, cut, strict=True) if c])
            found.add(self._whole([w for w, c in zip(words, cut, strict=True) if not c]))
            place = np.argsort(np.argsort(~cut, kind="stable"))[place]  # words that are cut come first
        ids, sizes = found.gather(place)
        # A text is split into one word at least, be it empty.
        return ids, np.add.reduceat(sizes, split.offsets.to_numpy()[:-1] - split.offsets[0].as_py(), dtype=np.int64)

    def _cut(self, words: list[str]) -> np.ndarray:
        """Which words are cut into pieces here: plain ones that hold no token added to the vocabulary."""
        if self.last is None:
            return np.zeros(len(words), dtype=bool)
        joined = "\n".join(words)
        if PLAIN.fullmatch(joined) and not any(a in joined for a in self.added):
            return np.ones(len(words), dtype=bool)
        return np.array([PLAIN.fullmatch(w) is not None and not any(a in w for a in self.added) for w in words], dtype=bool)

    def _plain(self, words: list[str]) -> Sequences:
        found = pa.array(CUT.findall("\n".join(words).lower() + "\n") if words else [], type=pa.string()).dictionary_encode()
        pieces = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [x for x in pieces if x not in self.numbers]
        for kind in ([x for x in new if x.isascii()], [x for x in new if not x.isascii()]):
            for at in range(0, len(kind), SLICE):
                self._merge(kind[at : at + SLICE])
        numbers = np.fromiter(map(self.numbers.__getitem__, pieces), dtype=np.int64, count=len(pieces))[found.indices.to_numpy()]
        ids, sizes = self.pieces.gather(numbers)
        return Sequences(ids, np.diff(np.cumsum(sizes)[numbers == 0], prepend=0))

    def _merge(self, pieces: list[str]) -> None:
        text = " ".join(pieces)
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(LETTERS)
        ids = self._ids(text, merge=True)
        ends = np.flatnonzero(self.last[ids])
        if len(ends) == len(pieces) and ends[-1] == len(ids) - 1:
            sizes = np.diff(ends, prepend=-1)
        else:  # the vocabulary lacks a letter
            alone = [self._ids(x, merge=True) for x in text.split(" ")]
            ids, sizes = np.concatenate(alone), np.array([len(x) for x in alone])
        self.numbers.update(zip(pieces, range(len(self.numbers), len(self.numbers) + len(pieces)), strict=True))
        self.pieces.add(Sequences(ids, sizes))

    def _whole(self, words: list[str]) -> Sequences:
        size = np.dtype(self.width).itemsize
        new = [w for w in words if w not in self.known]
        unmarked = [w for w in new if self.MARK not in w] if self.mark is not None else []
        for at in range(0, len(unmarked), SLICE):
            part = unmarked[at : at + SLICE]
            ids = self._ids(f" {self.MARK} ".join(part))
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) == len(part) - 1:
                data, starts, ends = ids.tobytes(), [0, *((cuts + 1) * size).tolist()], [*(cuts * size).tolist(), len(ids) * size]
                self.known.update((w, data[a:b]) for w, a, b in zip(part, starts, ends, strict=True))
        for w in new:
            if w not in self.known:
                self.known[w] = self._ids(w).tobytes()
        found = list(map(self.known.__getitem__, words))
        return Sequences(np.frombuffer(b"".join(found), dtype=self.width), np.array([len(x) // size for x in found], dtype=np.int64))


def piece_ends(tokenizer: str) -> np.ndarray | None:
    """Whether each id ends a piece, if the library's normaliser, pattern and merges are those that ``WordEncoder`` knows; else None."""
    file = json.loads(tokenizer)
    model, added = file["model"], file["added_tokens"]
    fixed = {"type": "BPE", "dropout": None, "unk_token": None, "byte_fallback": False, "ignore_merges": False}
    alike = file["normalizer"] == NORMALIZER and file["pre_tokenizer"] == PRE_TOKENIZER and all(model.get(k) == v for k, v in fixed.items())
    suffix = model.get("end_of_word_suffix")
    if not alike or not suffix or model.get("continuing_subword_prefix") or any(t[k] for t in added for k in ("normalized", "single_word", "lstrip", "rstrip")):
        return None
    last = np.zeros(max([*model["vocab"].values(), *(t["id"] for t in added)]) + 1, dtype=bool)
    last[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
    return last


def tokenize(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian unsigned 16-bit or 32-bit) with the end id, and a row of ``counts`` (64-bit, one for each
    id) for each task, whose other columns are NULL. ``tokenizer``: the file's content.

    The vocabulary's pattern drops white space, so texts are encoded word by word, and the library sees each piece of a word once.
    """
    width, last = _width(tokenizer), piece_ends(tokenizer)
    kind = docs.schema["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, size = WordEncoder(tokenizer, width, last), np.dtype(width).itemsize
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for part in _parts(batch):
                ids, sizes = encoder.encode(part.column(1))
                ids, sizes = np.insert(ids, np.cumsum(sizes), end), sizes + 1
                found = np.bincount(ids, minlength=len(total))
                found[: len(total)] += total
                total = found
                offsets = np.concatenate([[0], np.cumsum(sizes) * size]).astype(np.int32)
                out = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                yield _batch(part.column(0), pa.array(sizes, pa.int64()), out, pa.nulls(len(sizes), pa.binary()))
        yield _batch(pa.nulls(1, _arrow(kind)), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary()))

    return docs.select("doc_id", "text").mapInArrow(run, StructType([kind, *_parse_datatype_string("n_tokens long, ids binary, counts binary")]))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows in parts of about ``PART_BYTES`` of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)
    starts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // PART_BYTES, prepend=-1))
    for start, stop in zip(starts, [*starts[1:], len(sizes)], strict=False):
        yield batch.slice(start, stop - start)


def _arrow(field: StructField) -> pa.DataType:
    return {"long": pa.int64(), "integer": pa.int32(), "string": pa.string()}[field.dataType.typeName()]


def _batch(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=["doc_id", "n_tokens", "ids", "counts"])


def _width(tokenizer: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_str(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


def count_ids(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents: the sum of the tasks' counts, one number for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                n = np.frombuffer(data, dtype=np.int64)
                token = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n[token])], names=["token", "n"])

    rows = tokens.where("counts IS NOT NULL").select("counts").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([r["token"] for r in rows], default=-1) + 1, dtype=np.int64)
    for r in rows:
        counts[r["token"]] = r["n"]
    return counts


def write(tokens: DataFrame, folder: str, width: str) -> None:
    """Write the rows of ``tokenize`` in ascending doc_id order. They are read several times, so they should be settled."""
    spark = tokens.sparkSession
    frequency = frequencies(count_ids(tokens))
    tokens = tokens.where("counts IS NULL")
    table = [(i, int(n)) for i, n in enumerate(frequency) if n]
    spark.createDataFrame(table, "token int, frequency int").coalesce(1).write.parquet(f"{folder}/table")
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    ordered = (
        tokens.withColumn("mix", F.xxhash64("ids"))
        .repartitionByRange(max(1, -(-total // SHARD)), "doc_id", "mix")
        .sortWithinPartitions("doc_id", "ids")
        .select("doc_id", "ids")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = Coder(frequency), TaskContext.get().partitionId()
        held: list[tuple[int | None, np.ndarray]] = []
        size = number = start = 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = np.frombuffer(ids, dtype=width)
                if held and size + len(tokens) > BLOCK:
                    yield _block(coder, shard, number, start, held)
                    start, number, held, size = start + size, number + 1, [], 0
                held.append((doc_id, tokens))
                size += len(tokens)
        if held:
            yield _block(coder, shard, number, start, held)

    ordered.mapInArrow(run, BLOCKS).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def _block(coder: Coder, shard: int, number: int, start: int, held: list[tuple[int | None, np.ndarray]]) -> pa.RecordBatch:
    ids = np.concatenate([t for _, t in held])
    words, states, offsets = coder.encode(ids)
    row = {
        "shard": shard,
        "block": number,
        "start": start,
        "doc_ids": [d for d, _ in held],
        "lengths": [len(t) for _, t in held],
        "ids_crc32": [zlib.crc32(t.astype("<u4").tobytes()) for _, t in held],
        "words": words.tobytes(),
        "states": states.tobytes(),
        "offsets": offsets,
        "crc32": zlib.crc32(ids.astype("<u4").tobytes()),
    }
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` from the files; raises where a block's checksum is wrong."""
    table = spark.read.parquet(f"{folder}/table").collect()
    frequency = np.zeros(max([r["token"] for r in table], default=-1) + 1, dtype=np.int64)
    for r in table:
        frequency[r["token"]] = r["frequency"]
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    # One number for each shard, as many as there were tasks.
    totals = blocks.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)).alias("n")).collect()
    before, at = {}, 0
    for r in sorted(totals):
        before[r["shard"]], at = at, at + r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(frequency)
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], dtype=np.int64)
                ids = decode_block(coder, row)
                ends = np.cumsum(lengths)
                parts = [ids[e - n : e].astype("<u4").tobytes() for e, n in zip(ends, lengths, strict=True)]
                starts = before[row["shard"]] + row["start"] + ends - lengths
                columns = [
                    pa.array(row["doc_ids"], type=pa.int64()),
                    pa.array(starts),
                    pa.array(lengths),
                    pa.array([zlib.crc32(p) for p in parts], type=pa.int64()),
                    pa.array(parts, type=pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def decode_block(coder: Coder, row: dict) -> np.ndarray:
    n, segments = sum(row["lengths"]), max(1, len(row["offsets"]))
    states = np.frombuffer(row["states"], dtype="<u8").reshape(segments, -1)
    ids = coder.decode(np.frombuffer(row["words"], dtype="<u4"), states, row["offsets"], n)
    if zlib.crc32(ids.astype("<u4").tobytes()) != row["crc32"]:
        raise ValueError(f"block {row['block']} of shard {row['shard']} is damaged")
    return ids


def op10_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        tokenizer = file.read()
    tokens = settle(tokenize(read_table(spark, sf_dir, "documents"), tokenizer), "ids")
    folder = shared_folder(spark, "token-files")
    write(tokens, folder, _width(tokenizer))
    return read(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
