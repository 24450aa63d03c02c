"""Byte-level BPE by a trie of distinct words, with decoding.

Every distinct word goes into a trie of bytes. Each node keeps the last token of the encoding of its path, and the node where
that token begins; a new node takes both from its ancestors: its last token is the one token that ends there and may follow the
last token of what is left before it. So a prefix that many words share is encoded once, and a word's tokens are read off by
following the beginnings back. Two tokens may stand side by side if no merge across their border comes before the merges that
made them; that is looked up once for each pair.

Defined results: a NULL text counts as empty and has no ids. The special token of the vocabulary is found in plain text, as the
tokenizers library does. Repeated rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from epilimnia.llm.common import per_text, read_table

#: Word pattern of the byte-level vocabulary (fixed value).
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Nodes and words that a worker remembers before it starts anew.
TRIE_NODES = 600_000
CACHE_WORDS = 400_000
SHORT = (2, 1)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file (fixed rule of the format)."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    return letters | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*printable}))}


@dataclass
class Vocabulary:
    token_of: dict[bytes, int]
    bytes_of: list[bytes]
    halves: dict[int, tuple[int, int]]  # the two tokens that a token was merged from
    rank: dict[tuple[int, int], int]  # order of a merge
    special: dict[str, int]

    @staticmethod
    def from_json(text: str) -> Vocabulary:
        file = json.loads(text)
        letters = byte_letters()
        plain = {t: bytes(map(letters.__getitem__, t)) for t in file["model"]["vocab"]}
        ids = file["model"]["vocab"]
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        bytes_of = [b""] * (max([*ids.values(), *special.values()]) + 1)
        for t, i in ids.items():
            bytes_of[i] = plain[t]
        for t, i in special.items():
            bytes_of[i] = t.encode()
        return Vocabulary(
            {plain[t]: i for t, i in ids.items()},
            bytes_of,
            {ids[a + b]: (ids[a], ids[b]) for a, b in reversed(merges)},
            {(ids[a], ids[b]): n for n, (a, b) in enumerate(merges)},
            special,
        )


class TrieEncoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        # Lengths of the tokens that end in given three bytes, longest first.
        lengths: dict[bytes, set[int]] = {}
        for token in vocabulary.token_of:
            if len(token) > 2:
                lengths.setdefault(token[-3:], set()).add(len(token))
        self.lengths = {end: (*sorted(found, reverse=True), 2, 1) for end, found in lengths.items()}
        self.beside: dict[tuple[int, int], bool] = {}
        self.edges: dict[int, dict[bool, list[tuple[int, int, float]]]] = {}
        self.word = regex.compile(WORD)
        self.split = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self.forget()

    def forget(self) -> None:
        self.child: dict[int, int] = {}
        self.last, self.start = [-1], [0]
        self.known: dict[str, bytes] = {}

    def edge(self, token: int, right: bool) -> list[tuple[int, int, float]]:
        """The tokens that were at a token's right (or left) end while it was merged: (token, made at, used up at)."""
        found = self.edges.setdefault(token, {}).get(right)
        if found is None:
            found, used, at = [], float("inf"), token
            while True:
                made = self.v.rank[self.v.halves[at]] if at in self.v.halves else -1
                found.append((at, made, used))
                if made < 0:
                    break
                used, at = made, self.v.halves[at][1 if right else 0]
            self.edges[token][right] = found
        return found

    def may_follow(self, first: int, second: int) -> bool:
        """No merge across the border is due before one of its tokens is used up; of equal merges the left one comes first."""
        answer = self.beside.get((first, second))
        if answer is None:
            rank, answer = self.v.rank, True
            for a, made_a, used_a in self.edge(first, True):
                for b, made_b, used_b in self.edge(second, False):
                    r = rank.get((a, b))
                    if r is not None and made_a < r < used_a and made_b < r <= used_b:
                        answer = False
            self.beside[first, second] = answer
        return answer

    def insert(self, word: bytes) -> int:
        """The word's node; nodes on the way that are new get their last token."""
        child, last, start, token_of, beside = self.child, self.last, self.start, self.v.token_of, self.beside
        path, node = [0], 0
        for depth, byte in enumerate(word, 1):
            key = node << 8 | byte
            below = child.get(key)
            if below is None:
                below = child[key] = len(last)
                for length in self.lengths.get(word[max(0, depth - 3) : depth], SHORT):
                    if (begin := depth - length) < 0 or (token := token_of.get(word[begin:depth])) is None:
                        continue
                    before = path[begin]
                    if begin == 0 or beside.get((last[before], token)) or self.may_follow(last[before], token):
                        last.append(token)
                        start.append(before)
                        break
                else:
                    raise ValueError(f"the vocabulary has no token for {word!r}")
            node = below
            path.append(node)
        return node

    def encode_word(self, word: bytes) -> list[int]:
        node, out = self.insert(word), []
        while node:
            out.append(self.last[node])
            node = self.start[node]
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.last) > TRIE_NODES or len(self.known) > CACHE_WORDS:
            self.forget()
        known, out = self.known, []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.v.special:
                out.append(np.uint32(self.v.special[part]).tobytes())
                continue
            words = self.word.findall(part)
            for w in {*words}.difference(known):
                known[w] = np.array(self.encode_word(w.encode()), dtype="<u4").tobytes()
            out.extend(map(known.__getitem__, words))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text; bytes that are no text become replacement characters."""
        raw = b"".join(map(self.v.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return raw.decode("utf-8", "replace").encode()


def read_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        return Vocabulary.from_json(file.read())


def encode_and_decode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, ids, decoded`` digests of each whole text. The vocabulary, a few MB, goes with the task."""

    def maker() -> Callable[[list[str | None]], list[pa.Array]]:
        encoder = TrieEncoder(vocabulary)

        def work(texts: list[str | None]) -> list[pa.Array]:
            counts, ids_sha, text_sha = [], [], []
            for text in texts:
                ids = encoder.encode(text or "")
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            return [pa.array(counts, type=pa.int64()), pa.array(ids_sha, type=pa.string()), pa.array(text_sha, type=pa.string())]

        return work

    return per_text(docs, maker, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, ids`` (array of int) of each whole text."""

    def maker() -> Callable[[list[str | None]], list[pa.Array]]:
        encoder = TrieEncoder(vocabulary)
        return lambda texts: [pa.array([np.frombuffer(encoder.encode(t or ""), dtype="<u4").astype(np.int32) for t in texts], type=pa.list_(pa.int32()))]

    return per_text(docs, maker, "ids array<int>")


def op7_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    return encode_and_decode(read_table(spark, sf_dir, "documents"), vocabulary)
