"""Quality rules by robust multivariate outliers: a minimum covariance determinant estimate for each language and source.

Each text's statistics become a vector of four: log mean word length, and logs of the shares of symbols, repeated lines and
repeated words. For each group (language, source) concentration steps look for the half of the documents, (n + p + 1) / 2 of n in p
parts, whose covariance has the least determinant, so that any outliers short of that half can't shape it. A pass over all rows
adds up, for each group, start and small range of distance, counts, sums and products; the ranges up to the half, the last one in
part, give the next centre and covariance. Each group has ``STARTS``: the median with the median deviation, the shortest half
of each part, and about the median the correlations of squashed parts and of directions. A start goes on until its determinant
stops falling; the least determinant of all starts and steps wins. The last step weighs in all documents within the 97.5 %
quantile of the winner. A document goes if its squared Mahalanobis distance exceeds the ``CUT`` quantile of chi squared.

Vectors are whole numbers (``STEP`` parts of one), so all sums are exact and the result does not depend on the order of rows. Rows
are added up before they are shuffled, and a group's estimate comes from at most ``BINS`` sums, so a hot group costs no task more.
Groups of fewer than ``MIN_ROWS`` documents are pooled by language; what is left of languages whose pool is still too small is judged
by an estimate over all rows of the corpus, those of the other groups included.

Defined results: a NULL text counts as empty and fails the base rule, a NULL language or source counts as empty text. In a corpus
of fewer than ``MIN_ROWS`` documents there is no estimate: the distance is NULL and only the base rule decides. Repeated rows count
each. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce
from math import exp

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epilimnia.llm.common import SPACE_CHARS, per_text, read_table, settle

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
CUT = 0.9999
MIN_ROWS = 100
#: Steps of each start before its determinant is watched, and the fall of its logarithm that counts as one.
CONCENTRATIONS = 4
FALL = 1e-4
STARTS = ("median", "shortest half", "squashed", "directions")
#: Parts of one of squashed values and directions.
FINE = 1000
STEP = 1000
BINS = 512
#: Least standard deviation of each part: most texts have no symbol and no repeat at all, which must not make one a crime.
LEAST = (0.08, 0.15, 0.3, 0.3)
PARTS = ("z0", "z1", "z2", "z3")
PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]
SALTS = 8
#: The group of all rows.
WHOLE = "*"


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
    chars = len(text) - sum(map(text.count, SPACE_CHARS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE_CHARS)] if "\n" in text else ()
    runs = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    repeated = end = 0
    if len({*runs}) < len(runs):
        often = Counter(runs)
        for i, run in enumerate(runs):
            if often[run] > 1:
                repeated += i + WINDOW - max(i, end)
                end = i + WINDOW
    return len(words), chars, symbols, len(lines) - len({*lines}), repeated


def vectors(s: np.ndarray) -> np.ndarray:
    """Statistics (a row each) to whole numbers; a few words are added to each text, so that short ones don't scatter."""
    words, chars, symbols, lines, repeats = s.astype(float).T
    z = np.column_stack(
        [
            np.log((chars + 5 * 20) / (words + 20)),
            np.log1p(100 * symbols / (chars + 100)),
            np.log1p(100 * lines / (words + 100)),
            np.log1p(10 * repeats / (words + 50)),
        ]
    )
    return np.rint(z * STEP).astype(np.int64)


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source``, the statistics and the vector of each row."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *PARTS]

    def maker() -> Callable[[list[str | None]], list[pa.Array]]:
        def work(texts: list[str | None]) -> list[pa.Array]:
            s = np.array([statistics(t) for t in texts], dtype=np.int64).reshape(-1, 5)
            return [pa.array(c) for c in (*s.T, *vectors(s).T)]

        return work

    return per_text(docs, maker, ", ".join(f"{n} long" for n in names), carry=("doc_id", "lang", "source"))


def chi2_quantile(p: float, half: int) -> float:
    """Quantile of chi squared with ``2 * half`` degrees of freedom."""
    low, high = 0.0, 1e3
    for _ in range(200):
        x = (low + high) / 2
        low, high = (x, high) if _chi2(x, half) < p else (low, x)
    return (low + high) / 2


def _chi2(x: float, half: int) -> float:
    term = total = 1.0
    for k in range(1, half):
        term *= x / 2 / k
        total += term
    return 1 - exp(-x / 2) * total


def widened(share: float) -> float:
    """What the covariance of the nearest ``share`` of normal data has to be multiplied by."""
    return share / _chi2(chi2_quantile(share, 2), 3)


def groups(measured: DataFrame) -> DataFrame:
    """``lang, source, gid``: the group of each language and source, ``WHOLE`` for those judged by the corpus; NULL if that is too small."""
    sizes = measured.groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = sizes.where(F.col("n") < MIN_ROWS).groupBy("lang").agg(F.sum("n").alias("pool"))
    corpus = sizes.agg(F.sum("n")).first()[0] or 0
    whole = F.lit(WHOLE if corpus >= MIN_ROWS else None).cast("string")
    gid = (
        F.when(F.col("n") >= MIN_ROWS, F.concat_ws("\n", F.lit("source"), "lang", "source"))
        .when(F.col("pool") >= MIN_ROWS, F.concat_ws("\n", F.lit("lang"), "lang"))
        .otherwise(whole)
    )
    return sizes.join(by_lang, "lang", "left").select("lang", "source", gid.alias("gid"))


def _solved(centre: np.ndarray, spread: np.ndarray) -> tuple[list[float], float]:
    """Centre and inverse covariance as four plus ten numbers, parts never below their least deviation; the log determinant."""
    spread = spread.copy()
    np.fill_diagonal(spread, np.maximum(np.diag(spread), (np.array(LEAST) * STEP) ** 2))
    inverse = np.linalg.inv(spread)
    return [*centre, *(inverse[i, j] * (1 if i == j else 2) for i, j in PAIRS)], float(np.linalg.slogdet(spread)[1])


ESTIMATE = [*(f"c{i}" for i in range(4)), *(f"p{i}{j}" for i, j in PAIRS)]
ESTIMATE_SCHEMA = "gid string, start int, logdet double, before double, " + ", ".join(f"{n} double" for n in ESTIMATE)
ESTIMATE_NAMES = ["gid", "start", "logdet", "before", *ESTIMATE]


def first_estimate(rows: DataFrame) -> DataFrame:
    """The ``STARTS`` of each group; none has a determinant yet."""
    value = F.explode(F.array(*(F.struct(F.lit(i).alias("part"), F.round(F.col(z) / 10).cast("int").alias("v")) for i, z in enumerate(PARTS))))
    counts = rows.select("gid", value.alias("x")).groupBy("gid", "x.part", "x.v").agg(F.count("*").alias("n"))

    def plain(group: pd.DataFrame) -> pd.DataFrame:
        """Median and median deviation, and the shortest half, of each part, from counts of values in hundredths."""
        centre, width, middle, half = np.zeros((4, 4))
        for part, values in group.groupby("part"):
            v, n = values["v"].to_numpy(float), values["n"].to_numpy()
            centre[part] = _median(v, n)
            width[part] = 1.4826 * _median(np.abs(v - centre[part]), n)
            middle[part], half[part] = _shortest_half(v, n)
        found = [(0, centre, width), (1, middle, half / (2 * 0.6745))]
        return _estimates(group["gid"].iloc[0], [(k, c * 10, np.diag((w * 10) ** 2)) for k, c, w in found])

    first = settle(counts.groupBy("gid").applyInPandas(plain, ESTIMATE_SCHEMA), "estimate")
    # Standardised by median and median deviation, squashed or put on a sphere, as whole numbers: sums are exact.
    u = [(F.col(z) - F.col(f"c{i}")) * F.sqrt(F.col(f"p{i}{i}")) for i, z in enumerate(PARTS)]
    norm = F.greatest(F.sqrt(sum((x * x for x in u), F.lit(0.0))), F.lit(1e-9))
    whole = {f"t{i}": F.round(F.tanh(x / 2) * FINE).cast("long") for i, x in enumerate(u)}
    whole |= {f"r{i}": F.round(x / norm * FINE).cast("long") for i, x in enumerate(u)}
    sums = [F.sum(F.col(f"{k}{i}") * F.col(f"{k}{j}")).alias(f"{k}{i}{j}") for k in "tr" for i, j in PAIRS]
    median = with_estimate(rows, first.where("start = 0"))
    added = median.withColumns(whole).groupBy("gid", *(f"c{i}" for i in range(4)), *(f"p{i}{i}" for i in range(4))).agg(*sums)

    def turned(group: pd.DataFrame) -> pd.DataFrame:
        one, found = group.iloc[0], []
        for start, kind in ((2, "t"), (3, "r")):
            m = np.zeros((4, 4))
            for i, j in PAIRS:
                m[i, j] = m[j, i] = one[f"{kind}{i}{j}"]
            size = np.sqrt(np.maximum(np.diag(m), 1.0))
            width = np.array([one[f"p{i}{i}"] ** -0.5 for i in range(4)])
            # Parts that always agree must leave the matrix with an inverse.
            alike = 0.99 * m / np.outer(size, size)
            np.fill_diagonal(alike, 1.0)
            found.append((start, np.array([one[f"c{i}"] for i in range(4)]), alike * np.outer(width, width)))
        return _estimates(one["gid"], found)

    return first.unionAll(added.groupBy("gid").applyInPandas(turned, ESTIMATE_SCHEMA))


def _estimates(gid: str, starts: list[tuple[int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    rows = [[gid, start, np.inf, np.inf, *_solved(centre, spread)[0]] for start, centre, spread in starts]
    return pd.DataFrame(rows, columns=ESTIMATE_NAMES)


def _shortest_half(values: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Middle and width of the shortest range that holds half of the values; the first of equally short ones."""
    order = np.argsort(values, kind="stable")
    v, ends = values[order], np.cumsum(counts[order])
    last = np.searchsorted(ends, ends - counts[order] + (ends[-1] + 1) // 2)
    first = np.flatnonzero(last < len(v))
    width = v[last[first]] - v[first]
    k = int(np.argmin(width))
    return float(v[last[first[k]]] + v[first[k]]) / 2, float(width[k])


def _median(values: np.ndarray, counts: np.ndarray) -> float:
    order = np.argsort(values, kind="stable")
    ends = np.cumsum(counts[order])
    return float(values[order][np.searchsorted(ends, (ends[-1] + 1) // 2)])


def squared_distance() -> Column:
    d = [F.col(z) - F.col(f"c{i}") for i, z in enumerate(PARTS)]
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + F.col(f"p{i}{j}") * d[i] * d[j]
    return F.greatest(total, F.lit(0.0))


def with_estimate(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Rows with their group's numbers. Each estimate stands once for each salt, so a hot group is spread over tasks."""
    salted = estimate.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return rows.join(salted, ["gid", "salt"])


def best(estimates: DataFrame) -> DataFrame:
    """The estimate of least determinant of each group; ties go by start, then by the numbers."""
    least = F.min(F.struct("logdet", "start", "before", *ESTIMATE)).alias("best")
    return estimates.groupBy("gid").agg(least).select("gid", "best.start", "best.logdet", "best.before", *(f"best.{n}" for n in ESTIMATE))


def concentrate(rows: DataFrame, estimate: DataFrame, reweigh: bool = False) -> DataFrame:
    """The next estimate of each start: of the nearest half of its group. Or one of the best start: of all within the 97.5 % quantile."""
    bin_ = F.least(F.floor(F.log2(1 + squared_distance() * 64) * 32).cast("int"), F.lit(BINS - 1))
    sums = [F.sum(z).alias(f"s{i}") for i, z in enumerate(PARTS)]
    sums += [F.sum(F.col(PARTS[i]) * F.col(PARTS[j])).alias(f"q{i}{j}") for i, j in PAIRS]
    placed = with_estimate(rows, best(estimate) if reweigh else estimate)
    added = placed.groupBy("gid", "start", "logdet", bin_.alias("bin")).agg(F.count("*").alias("n"), *sums)
    last = int(np.log2(1 + chi2_quantile(0.975, 2) * 64) * 32)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bin", ignore_index=True)
        n = group["n"].to_numpy(float)
        total = n.sum()
        if reweigh:
            weight, share = (group["bin"] <= last).to_numpy(float), 0.975
        else:
            half = (total + len(PARTS) + 1) // 2
            weight = np.clip((half - (np.cumsum(n) - n)) / n, 0, 1)
            share = min(half / total, 0.999)
        if not weight.any():
            weight = np.ones(len(n))
        inside = float((weight * n).sum())
        centre = np.array([(weight * group[f"s{i}"]).sum() for i in range(4)]) / inside
        spread = np.zeros((4, 4))
        for i, j in PAIRS:
            spread[i, j] = spread[j, i] = (weight * group[f"q{i}{j}"]).sum() / inside - centre[i] * centre[j]
        numbers, logdet = _solved(centre, spread * widened(share))
        return pd.DataFrame([[group["gid"].iloc[0], group["start"].iloc[0], logdet, group["logdet"].iloc[0], *numbers]], columns=ESTIMATE_NAMES)

    return added.groupBy("gid", "start").applyInPandas(one, ESTIMATE_SCHEMA)


def least_determinant(rows: DataFrame) -> DataFrame:
    """Each group's estimate of least determinant over all steps of all starts. Every further step lowers one, so they end."""
    step, found = settle(first_estimate(rows), "estimate"), []
    while True:
        step = settle(concentrate(rows, step), "estimate")
        found.append(step)
        if len(found) >= CONCENTRATIONS:
            step = step.where(F.col("logdet") < F.col("before") - FALL)
            if step.isEmpty():
                return settle(best(reduce(DataFrame.unionAll, found)), "estimate")


def judge(docs: DataFrame) -> DataFrame:
    """``doc_id``, the statistics, ``base_failed``, ``distance2`` and ``kept`` of each row."""
    measured = measure(docs.withColumns({c: F.coalesce(c, F.lit("")) for c in ("lang", "source")}))
    measured = settle(measured.withColumn("salt", F.pmod(F.xxhash64("doc_id", "word_chars"), F.lit(SALTS)).cast("int")), "statistics")
    gids = groups(measured).withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    rows = settle(measured.join(gids, ["lang", "source", "salt"]), "grouped")
    usable = rows.where("gid IS NOT NULL").select("gid", "salt", *PARTS)
    if not rows.where(F.col("gid") == WHOLE).isEmpty():
        usable = usable.where(F.col("gid") != WHOLE).unionAll(usable.withColumn("gid", F.lit(WHOLE)))
    estimate = settle(concentrate(usable, least_determinant(usable), reweigh=True), "estimate")
    salted = estimate.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    judged = rows.join(salted, ["gid", "salt"], "left").withColumn("distance2", F.when(F.col("c0").isNotNull(), squared_distance()))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    near = F.coalesce(F.col("distance2") <= chi2_quantile(CUT, 2), F.lit(True))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & near).alias("kept"), "distance2",
    )


def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"))
