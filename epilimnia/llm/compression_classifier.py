"""Quality from compression: zstandard dictionaries of good and of bad text, and how much better one fits than the other.

Each text is cut into blocks of ``BLOCK`` bytes, all of which are compressed with both dictionaries; blocks are short so that
the dictionary, not the text's own past, decides. The score's only input is

    (bytes with the good dictionary - bytes with the bad one) / bytes of the text

summed over the whole text and put through a logistic curve. Dictionaries come from one part of a bounded labelled sample, the
curve from the other part.

Defined results: a NULL or empty text has difference 0 and gets the curve's value there; without usable labels of both
classes every score is 0.5. Repeated rows get equal scores. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epilimnia.llm.common import fit_logistic, fold, keep_rows, labelled_sample, per_text, read_table, sigmoid

BLOCK = 256
DICTIONARY_BYTES = 112_640
LEVEL = 3
#: Bounds of the training sample: documents of each class, and their length (longer ones are scored, but not learnt from).
SAMPLE_DOCS = 4_000
SAMPLE_CHARS = 20_000
THRESHOLD = 0.3


@dataclass
class CompressionModel:
    """Two dictionaries and the curve; ``weights`` is (slope, intercept) on the scaled difference."""

    good: bytes
    bad: bytes
    weights: tuple[float, float]
    scale: float

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: CompressionModel) -> None:
        self.model = model
        self.good, self.bad = _compressor(model.good), _compressor(model.bad)

    def difference(self, text: str | None) -> float:
        data = (text or "").encode("utf-8", "replace")
        if not data or not self.model.good:
            return 0.0
        gap = 0
        for at in range(0, len(data), BLOCK):
            block = data[at : at + BLOCK]
            gap += len(self.good.compress(block)) - len(self.bad.compress(block))
        return gap / len(data)

    def scores(self, differences: np.ndarray) -> np.ndarray:
        slope, intercept = self.model.weights
        return sigmoid(np.clip(differences / self.model.scale, -6, 6) * slope + intercept)


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    own = {"write_checksum": False, "write_content_size": False, "write_dict_id": False, "level": LEVEL}
    if not dictionary:
        return zstandard.ZstdCompressor(**own)
    loaded = zstandard.ZstdCompressionDict(dictionary)
    loaded.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=loaded, **own)


def _dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; text itself where zstandard finds too little to train on."""
    blocks = [b[at : at + BLOCK] for b in (t.encode("utf-8", "replace") for t in texts) for at in range(0, len(b), BLOCK)]
    step = max(1, len(blocks) * BLOCK // (40 * DICTIONARY_BYTES))
    blocks = blocks[::step]
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, blocks)) // 4))
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[:DICTIONARY_BYTES].ljust(8, b" ")


def fit(sample: pd.DataFrame) -> CompressionModel:
    """``sample``: label, text, mix. Two of three documents build the dictionaries, the rest fit the curve."""
    calibration = sample["mix"] % 3 == 0
    build, rest = sample[~calibration], sample[calibration]
    good, bad = (build.loc[build["label"] == v, "text"].tolist() for v in (1, 0))
    if not good or not bad:
        return CompressionModel(b"", b"", (0.0, 0.0), 1.0)
    model = CompressionModel(_dictionary(good), _dictionary(bad), (-1.0, 0.0), 1.0)
    if rest["label"].nunique() < 2:
        rest = sample
    scorer = model.scorer()
    x = np.array([scorer.difference(t) for t in rest["text"]])
    model.scale = float(max(np.std(x), 1e-6))
    w = fit_logistic(np.clip(x / model.scale, -6, 6)[:, None], rest["label"].to_numpy(float))
    model.weights = (float(w[0]), float(w[1]))
    return model


def score(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """``doc_id, difference, score`` of each row, from its whole text."""

    def maker() -> Callable[[list[str | None]], list[pa.Array]]:
        scorer = model.scorer()

        def work(texts: list[str | None]) -> list[pa.Array]:
            d = np.array([scorer.difference(t) for t in texts], dtype=float)
            return [pa.array(d), pa.array(scorer.scores(d))]

        return work

    return per_text(docs, maker, "difference double, score double")


def train(docs: DataFrame, labels: DataFrame) -> CompressionModel:
    """The contract's split: rows with crc32(doc_id) mod 5 = 0 are held out."""
    usable = fold(F.col("doc_id"), 5) != 0
    return fit(labelled_sample(docs, labels, "quality", usable, {1: SAMPLE_DOCS, 0: SAMPLE_DOCS}, SAMPLE_CHARS))


def op2_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "difference",
    )


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents whose score reaches the threshold, in their own columns."""
    model = train(docs, read_table(spark, sf_dir, "labels"))

    def decider() -> Callable[[list[str | None]], np.ndarray]:
        scorer = model.scorer()
        return lambda texts: scorer.scores(np.array([scorer.difference(t) for t in texts], dtype=float)) >= THRESHOLD

    return keep_rows(docs, decider)
