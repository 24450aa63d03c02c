"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks.

A sentence's strings are its lower-cased words, with digits read as the letters they stand for, other signs dropped and runs of
single letters joined, and each two neighbouring words joined, which shows insults that a space splits (``mo ron``) and those of two
words. A joined pair counts where it decides higher than either of its words. Two strings compare by the subsequences of three and of four characters that they share (``^`` and ``$``
mark the ends); one that spans ``g`` extra characters weighs ``DECAY ** g``, with at most ``MAX_GAP`` of them, so an insult with
characters put in or left apart stays near its plain form. The kernel is divided by both strings' norms.

Landmark strings give the Nyström map ``k(s, Z) K(Z, Z)^-1/2``; a squared-hinge support vector machine is linear in that map. A
sentence decides by its highest strings, a document by the ``TOP`` highest different ones of all its sentences: one lookalike
weighs less than several. Labels are per document, so training repeats: take each toxic document's highest string as the witness,
fit, look again. Joined pairs that ``PAIR_DOCS`` toxic documents share can be witnesses too. As the map is linear in a string's subsequences, the fitted
machine is kept as one weight for each hashed subsequence, and scoring needs no landmark: what a joined pair has beyond its words
are the subsequences across the joint. These give a bound for each pair; pairs whose bound can count are decided in full.

Defined results: NULL, empty and wordless texts get the curve's value at the lowest decision seen in training; without labels of
both classes every score is 0.5. Repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epilimnia.llm.common import fit_logistic, fold, keep_rows, labelled_sample, per_text, read_table, sigmoid

DECAY = 0.6
#: Extra characters that a subsequence of so many characters may span.
MAX_GAP = {3: 2, 4: 1}
MAX_LENGTH = 24
TABLE_BITS = 20
THRESHOLD = 0.7
#: Decisions that count for a document; of all but the highest, the part above ``FLOOR``.
TOP = 5
FLOOR = -0.5
#: Bounds of the training sample: documents of each class and their length; strings that stand for the clean class; landmarks.
SAMPLE_DOCS = {1: 2_000, 0: 4_000}
SAMPLE_CHARS = 20_000
CLEAN_POOL = 60_000
CLEAN_STRINGS = 5_000
LANDMARKS = 192
#: Toxic documents that share a joined pair which may be a witness; joined pairs taken from each clean document.
PAIR_DOCS = 3
CLEAN_PAIRS = 5
ROUNDS = 3
#: Log-likelihood ratio from which a string counts as leaning to toxic documents; spoilt copies of a witness in training.
SURPRISE = 12.0
INSERTED = 4
#: Lengths of the beginnings that count as stems when first looking for witnesses.
STEMS = (4, 5, 6, 7)
PENALTY = 0.02
#: Words a worker remembers before it starts anew.
CACHE_WORDS = 400_000
#: Digits and signs read as letters (fixed values).
LOOKALIKES = str.maketrans("013457@", "oieastA".lower())

PART = re.compile(r"[^\W\d_]{3,}")

SENTENCE_END = (".", "!", "?")
#: Letters on either side of a joint that a subsequence across it can reach, an end mark included.
REACH = 4

#: (positions, weight) of each kept subsequence shape, relative to its first character.
SHAPES = [
    (np.cumsum((0, *(g + 1 for g in gaps))), DECAY ** sum(gaps))
    for order, most in MAX_GAP.items()
    for gaps in product(range(most + 1), repeat=order - 1)
    if sum(gaps) <= most
]


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def runs_of(words: list[str]) -> list[str]:
    """Each run of three or more single characters as one string."""
    singles = [i for i, w in enumerate(words) if len(w) == 1]
    out: list[str] = []
    if len(singles) >= 3:
        run: list[int] = []
        for i in [*singles, -9]:
            if run and i != run[-1] + 1:
                if len(run) >= 3:
                    out.append("".join(words[j] for j in run))
                run = []
            run.append(i)
    return out


def strings_of(text: str | None) -> list[str]:
    """Distinct raw strings of a text: words, and runs of single characters."""
    words = words_of(text)
    return list({*words, *runs_of(words)})


def joined(text: str | None) -> set[str]:
    """Letters of each two neighbouring words of a sentence, joined."""
    words = words_of(text)
    plain = [p[0] if len(p := pieces(w)) == 1 else "" for w in words]
    return {
        a + b
        for w, a, b in zip(words, plain, plain[1:])
        if a and b and len(a) + len(b) <= MAX_LENGTH and not w.endswith(SENTENCE_END)
    }


def pieces(word: str) -> list[str]:
    """A string's letters, lookalike digits replaced.

    A long string stands as its parts between signs and as windows of ``MAX_LENGTH`` letters that overlap by half.
    """
    letters = word if word.isalpha() else "".join(c for c in word.translate(LOOKALIKES) if c.isalpha())
    if len(letters) <= MAX_LENGTH:
        return [letters] if letters else []
    windows = [letters[i : i + MAX_LENGTH] for i in range(0, len(letters) - MAX_LENGTH // 2, MAX_LENGTH // 2)]
    return windows + [x for x in PART.findall(word.translate(LOOKALIKES)) if len(x) <= MAX_LENGTH]


def characters(strings: list[str]) -> np.ndarray:
    """Code points of strings of one common length, a row for each."""
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(strings), -1)


def mix(state: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hash state after one more character."""
    mixed = (state ^ codes) * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    return mixed


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed subsequences of words of one common length: ids (a row per word), the weight of each place, each row's norm."""
    length = len(words[0]) + 2
    codes = characters([f"^{w}$" for w in words])
    ids, weights = [], []
    for at, weight in SHAPES:
        if (starts := length - int(at[-1])) <= 0:
            continue
        mixed = np.full((len(words), starts), len(at), dtype=np.uint32)
        for offset in at:
            mixed = mix(mixed, codes[:, offset : offset + starts])
        ids.append((mixed >> np.uint32(32 - TABLE_BITS)).astype(np.int32))
        weights.append(np.full(starts, weight, dtype=np.float32))
    if not ids:
        return np.zeros((len(words), 1), dtype=np.int32), np.zeros(1, dtype=np.float32), np.ones(len(words), dtype=np.float32)
    found, value = np.concatenate(ids, axis=1), np.concatenate(weights)
    norms = np.full(len(words), np.sqrt((value**2).sum()), dtype=np.float32)
    ordered = np.sort(found, axis=1)
    # A subsequence that occurs more than once adds up.
    twice = np.flatnonzero((ordered[:, 1:] == ordered[:, :-1]).any(axis=1))
    if len(twice):
        order = np.argsort(found[twice], axis=1)
        ids_in_order = np.take_along_axis(found[twice], order, 1)
        first = np.ones(order.shape, dtype=bool)
        first[:, 1:] = ids_in_order[:, 1:] != ids_in_order[:, :-1]
        edges = np.flatnonzero(first)
        sums = np.add.reduceat(value[order].ravel(), edges) ** 2
        norms[twice] = np.sqrt(np.bincount(edges // order.shape[1], weights=sums, minlength=len(twice)))
    return found, value, norms


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """Normalised subsequence kernel between two lists of strings."""
    columns = [features([w]) for w in right]
    used = np.unique(np.concatenate([f[0] for f, _, _ in columns])) if columns else np.zeros(0, dtype=np.int32)
    row = np.full(1 << TABLE_BITS, len(used), dtype=np.int32)
    row[used] = np.arange(len(used))
    spread = np.zeros((len(used) + 1, len(right)), dtype=np.float32)
    for j, (f, v, norm) in enumerate(columns):
        np.add.at(spread[:, j], row[f[0]], v / norm[0])
    return by_length(left, lambda f, v, norm: np.stack([v @ spread[row[x]] for x in f]) / norm[:, None], len(right))


def by_length(words: list[str], reduce: Callable[..., np.ndarray], width: int) -> np.ndarray:
    """Apply ``reduce`` to the features of equally long words at a time."""
    out = np.zeros((len(words), width), dtype=np.float32)
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        for at in range(0, len(rows), 2048):
            chunk = rows[at : at + 2048]
            out[chunk] = reduce(*features([words[i] for i in chunk])).reshape(len(chunk), width)
    return out


def plain_norm(length: int) -> float:
    """Norm of a string of so many letters none of whose subsequences repeats; any other has a larger one."""
    return sum(max(0, length + 2 - int(at[-1])) * weight**2 for at, weight in SHAPES) ** 0.5


#: Where the places of each shape begin and end among the columns of ``features``, by the number of columns.
STOPS: dict[int, np.ndarray] = {}
for _length in range(1, MAX_LENGTH + 1):
    _stops = np.cumsum([0, *(_length + 2 - int(at[-1]) for at, _ in SHAPES if _length + 2 > int(at[-1]))])
    STOPS[int(_stops[-1])] = _stops

NORMS = np.array([max(plain_norm(n), 1e-6) for n in range(MAX_LENGTH + 1)], dtype=np.float32)


def across(left: np.ndarray, right: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Summed weights of the subsequences across a joint, from the characters beside it (zeros where there are none)."""
    out = np.zeros(len(left), dtype=np.float32)
    for at in range(0, len(left), 8_192):
        codes = np.concatenate([left[at : at + 8_192].T, right[at : at + 8_192].T])
        first = (codes == 0)[:REACH].sum(axis=0)
        last = 2 * REACH - 1 - (codes == 0)[REACH:].sum(axis=0)
        inside = {(i, j): (i >= first) & (j <= last) for i in range(REACH) for j in range(REACH, 2 * REACH)}
        states: dict[tuple[int, ...], np.ndarray] = {}

        def state(order: int, places: tuple[int, ...]) -> np.ndarray:
            if not places:
                return np.uint32(order)
            key = (order, *places)
            if key not in states:
                states[key] = mix(state(order, places[:-1]), codes[places[-1]])
            return states[key]

        total = out[at : at + 8_192]
        for offsets, weight in SHAPES:
            span = int(offsets[-1])
            for start in range(max(0, REACH - span), min(REACH, 2 * REACH - span)):
                found = table[state(len(offsets), tuple(int(start + o) for o in offsets)) >> np.uint32(32 - TABLE_BITS)]
                found *= inside[start, start + span]
                found *= np.float32(weight)
                total += found
    return out


@dataclass
class KernelModel:
    table: np.ndarray  # weight of each hashed subsequence
    bias: float
    curve: tuple[float, ...]  # weights of a document's evidence, then the intercept
    lowest: float

    def decide(self, words: list[str]) -> np.ndarray:
        """Decision of each plain string."""
        return by_length(words, lambda f, v, norm: self.table[f] @ v / norm, 1)[:, 0] + np.float32(self.bias)

    def parts(self, words: list[str]) -> np.ndarray:
        """Of each plain string: its decision, and the summed weights of its subsequences without those at its end, or its start."""

        def sums(f: np.ndarray, v: np.ndarray, norm: np.ndarray) -> np.ndarray:
            weighed = self.table[f] * v
            whole, stops = weighed.sum(axis=1), STOPS[f.shape[1]]
            return np.stack([whole / norm + np.float32(self.bias), whole - weighed[:, stops[1:] - 1].sum(axis=1), whole - weighed[:, stops[:-1]].sum(axis=1)], axis=1)

        return by_length(words, sums, 3)

    def scores(self, decisions: np.ndarray) -> np.ndarray:
        return sigmoid(evidence(decisions) @ np.array(self.curve[:-1]) + self.curve[-1])


class Scorer:
    """The ``TOP`` highest decisions of documents; remembers words by number."""

    def __init__(self, model: KernelModel) -> None:
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.plain: list[str] = []
        self.facts = {"decision": np.zeros(0, np.float32), "ends": np.zeros((0, 2), np.float32), "letters": np.zeros(0, np.int8), "closes": np.zeros(0, bool), "single": np.zeros(0, bool)}
        self.facts |= {side: np.zeros((0, REACH), np.uint32) for side in ("left", "right")}

    def decisions(self, texts: list[str | None]) -> np.ndarray:
        out = np.full((len(texts), TOP), self.model.lowest)
        for at in range(0, len(texts), 256):
            if len(self.known) > CACHE_WORDS:
                self.forget()
            words = [words_of(t) for t in texts[at : at + 256]]
            self.learn(set().union(*words) - self.known.keys())
            numbers = [np.fromiter(map(self.known.__getitem__, w), dtype=np.int64, count=len(w)) for w in words]
            runs = [runs_of(w) if self.facts["single"][n].sum() >= 3 else [] for w, n in zip(words, numbers, strict=True)]
            self.learn(set().union(*runs) - self.known.keys())
            beside = self.pairs(numbers)
            for i, (found, run) in enumerate(zip(numbers, runs, strict=True)):
                values = self.facts["decision"][[*found, *(self.known[r] for r in run)] if run else found]
                highest = np.unique(np.concatenate([values, beside[i]]) if i in beside else values)[: -TOP - 1 : -1]
                out[at + i, : len(highest)] = highest
        return out

    def pairs(self, documents: list[np.ndarray]) -> dict[int, np.ndarray]:
        """By place of the document: decisions of joined neighbours that are above ``FLOOR`` and above each of their words."""
        facts, words = self.facts, np.concatenate(documents)
        if len(words) < 2:
            return {}
        place = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
        letters = facts["letters"][words].astype(np.int64)
        usable = (place[1:] == place[:-1]) & (letters[1:] > 0) & (letters[:-1] > 0) & (letters[1:] + letters[:-1] <= MAX_LENGTH)
        rows = np.flatnonzero(usable & ~facts["closes"][words[:-1]])
        one, two = words[rows], words[rows + 1]
        least = np.maximum(np.maximum(facts["decision"][one], facts["decision"][two]), np.float32(FLOOR))
        raw = facts["ends"][one, 0] + facts["ends"][two, 1] + across(facts["left"][one], facts["right"][two], self.model.table)
        bound = np.maximum(raw, 0) / NORMS[letters[rows] + letters[rows + 1]] + np.float32(self.model.bias)
        open_ = np.flatnonzero(bound > least - 1e-4)
        strings = [self.plain[a] + self.plain[b] for a, b in zip(one[open_].tolist(), two[open_].tolist(), strict=True)]
        different = sorted(set(strings))
        decided = dict(zip(different, self.model.decide(different), strict=True))
        found = np.array([decided[x] for x in strings], dtype=np.float32)
        counts = found > least[open_]
        found, where = found[counts], place[rows[open_[counts]]]
        return {int(i): found[where == i] for i in np.unique(where)}

    def learn(self, new_words: set[str]) -> None:
        if not new_words:
            return
        words = list(new_words)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        parts = [pieces(w) for w in words]
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        found = self.model.parts([x for p in parts for x in p])
        starts, usable = np.cumsum(sizes) - sizes, np.flatnonzero(sizes)
        decision = np.full(len(words), self.model.lowest, dtype=np.float32)
        if len(usable):
            decision[usable] = np.maximum.reduceat(found[:, 0], starts[usable])
        # Only strings of one piece are joined.
        ends, one = np.zeros((len(words), 2), dtype=np.float32), sizes == 1
        ends[one] = found[starts[one], 1:]
        plain = [p[0] if len(p) == 1 else "" for p in parts]
        self.plain += plain
        new = {
            "decision": decision,
            "ends": ends,
            "letters": np.fromiter(map(len, plain), dtype=np.int8, count=len(plain)),
            "single": np.fromiter(map(len, words), dtype=np.int64, count=len(words)) == 1,
            "closes": np.fromiter((w.endswith(SENTENCE_END) for w in words), dtype=bool, count=len(words)),
            "left": characters([("\0\0\0^" + x)[-REACH:] for x in plain]),
            "right": characters([(x + "$\0\0\0")[:REACH] for x in plain]),
        }
        self.facts = {k: np.concatenate([v, new[k]]) for k, v in self.facts.items()}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.model.scores(self.decisions(texts))


def shared_pairs(texts: list[str]) -> set[int]:
    """Names of the joined pairs that occur in ``PAIR_DOCS`` texts or more."""
    seen = [xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace")) for t in texts for x in joined(t)]
    names, counts = np.unique(np.array(seen, dtype=np.uint64), return_counts=True)
    return set(names[counts >= PAIR_DOCS].tolist())


def stem_surprise(
    strings: list[str], toxic: list[list[str]], clean: list[list[str]], surprise: Callable[[np.ndarray, np.ndarray], np.ndarray]
) -> np.ndarray:
    """How much each string, or the best of its beginnings, leans to toxic documents."""
    cut = lambda w: [w, *(w[:n] + "-" for n in STEMS if n < len(w))]
    in_toxic = Counter(x for bag in toxic for x in {x for w in bag for x in cut(w)})
    in_clean = Counter(x for bag in clean for x in {x for w in bag for x in cut(w)} if x in in_toxic)
    stems = list(in_toxic)
    value = surprise(np.array([in_toxic[x] for x in stems], dtype=float), np.array([in_clean[x] for x in stems], dtype=float))
    lean = dict(zip(stems, value.tolist(), strict=True))
    return np.array([max(map(lean.__getitem__, cut(w))) + 1e-3 * lean[w] for w in strings])


def inserted(word: str, rng: np.random.Generator) -> list[str]:
    """Copies of a word with one letter put in between."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    cuts = rng.integers(1, len(word), INSERTED) if len(word) > 3 else []
    return [word[:i] + letters[rng.integers(26)] + word[i:] for i in cuts]


def evidence(decisions: np.ndarray) -> np.ndarray:
    """A document's evidence: its highest decision, and what the next ones have above ``FLOOR``.

    One clear insult is enough, lookalikes have to be several.
    """
    return np.column_stack([decisions[:, 0], np.clip(decisions[:, 1:] - FLOOR, 0, 2).sum(axis=1)])


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 25) -> np.ndarray:
    """Primal support vector machine with squared hinge loss, by Newton steps; the last weight is the bias."""
    design = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    w = np.zeros(design.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        margin = 1 - y * (design @ w)
        active = margin > 0
        a, c = design[active], weight[active]
        hess = (a * c[:, None]).T @ a + np.diag(ridge)
        new = np.linalg.solve(hess, a.T @ (c * y[active]))
        if np.abs(new - w).max() < 1e-7:
            return new
        w = new
    return w


def without_copies(sample: pd.DataFrame) -> pd.DataFrame:
    """The sample's documents without later near copies of earlier ones, whose plain words would look like evidence.

    Two documents count as copies if they have the same least value of one of three hashes over their five-word runs.
    """
    seen: set[tuple[int, int, int]] = set()
    keep = []
    for text, label in zip(sample["text"], sample["label"], strict=True):
        words = (text or "").split()
        runs = np.array([zlib.crc32(" ".join(words[i : i + 5]).encode("utf-8", "replace")) for i in range(max(1, len(words) - 4))], dtype=np.uint32)
        marks = {(k, int(label), int((runs * np.uint32(m)).min())) for k, m in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))}
        keep.append(not marks & seen)
        seen |= marks
    return sample[np.array(keep, dtype=bool)].reset_index(drop=True)


def fit(sample: pd.DataFrame) -> KernelModel:
    """Three of four sampled documents teach the machine, the rest the curve."""
    sample = without_copies(sample.sort_values(["label", "mix", "text"], ignore_index=True))
    bags = [sorted({p for w in strings_of(t) for p in pieces(w)}) for t in sample["text"]]
    label = sample["label"].to_numpy()
    calibration = (sample["mix"].to_numpy() % 4) == 0
    teach = [i for i in range(len(bags)) if not calibration[i] and bags[i]]
    toxic, clean = [bags[i] for i in teach if label[i] == 1], [bags[i] for i in teach if label[i] == 0]
    if not toxic or not clean:
        return KernelModel(np.zeros(1 << TABLE_BITS, dtype=np.float32), 0.0, (0.0, 0.0, 0.0), 0.0)
    text, name = sample["text"].tolist(), lambda x: xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace"))
    shared = shared_pairs([text[i] for i in teach if label[i] == 1])
    beside: set[str] = set()
    for i in teach:
        pairs = joined(text[i]) - set(bags[i])
        bags[i] = sorted({*bags[i], *(x for x in pairs if name(x) in shared)})
        if label[i] == 0:
            beside.update(sorted(pairs, key=name)[:CLEAN_PAIRS])
    toxic, clean = [bags[i] for i in teach if label[i] == 1], [bags[i] for i in teach if label[i] == 0]
    # Which string made a document toxic is not known: first those that lean most to toxic documents.
    in_toxic, in_clean = Counter(w for b in toxic for w in b), Counter(w for b in clean for w in b)
    strings = sorted(in_toxic)
    place = {w: i for i, w in enumerate(strings)}
    held = [np.array([place[w] for w in b]) for b in toxic]
    a, c = (np.array([n[w] for w in strings], dtype=float) for n in (in_toxic, in_clean))
    share = len(toxic) / (len(toxic) + len(clean))

    def surprise(a: np.ndarray, c: np.ndarray) -> np.ndarray:
        ratio = a * np.log(np.maximum(a, 1e-9) / ((a + c) * share)) + c * np.log(np.maximum(c, 1e-9) / ((a + c) * (1 - share)))
        return np.where(a >= 4 * c * share / (1 - share), ratio, 0.0)

    leaning = surprise(a, c) > SURPRISE
    decision = stem_surprise(strings, toxic, clean, surprise)
    rng = np.random.default_rng(7)
    pool = sorted(in_clean)
    pool = [pool[i] for i in np.sort(rng.choice(len(pool), min(CLEAN_POOL, len(pool)), replace=False))]
    ground = pool[:: max(1, len(pool) // CLEAN_STRINGS)]
    pool = sorted({*pool, *beside})
    hardest: list[str] = []
    for _ in range(ROUNDS):
        witness = Counter(int(b[np.argmax(decision[b])]) for b in held)
        # Strings that clean documents hold as often are no evidence; those that lean clearly count besides the highest ones.
        weight = {w: n for w, n in witness.items() if c[w] * len(toxic) <= n * len(clean)} or dict(witness)
        weight |= {int(w): int(a[w]) for w in np.flatnonzero(leaning)}
        by_weight = sorted(weight, key=lambda w: (-weight[w], strings[w]))
        chosen = [strings[w] for w in by_weight]
        loose = [(v, weight[w] / INSERTED) for w in by_weight[:LANDMARKS] for v in inserted(strings[w], rng)]
        against = sorted({*ground, *hardest} - {*chosen} - {v for v, _ in loose})
        landmarks = chosen[: LANDMARKS // 2] + [against[i] for i in rng.permutation(len(against))[: LANDMARKS // 2]]
        values, vectors = np.linalg.eigh(kernel(landmarks, landmarks).astype(np.float64) + 1e-6 * np.eye(len(landmarks)))
        whiten = vectors / np.sqrt(np.maximum(values, 1e-4))
        rows = chosen + [v for v, _ in loose] + against
        y = np.concatenate([np.ones(len(chosen) + len(loose)), -np.ones(len(against))])
        up = np.sqrt([weight[w] for w in by_weight] + [n for _, n in loose])
        cost = np.concatenate([up / up.sum(), np.full(len(against), 1 / max(1, len(against)))]) * len(rows) / 2
        w = squared_hinge(kernel(rows, landmarks) @ whiten, y, cost, penalty=PENALTY)
        table = np.zeros(1 << TABLE_BITS, dtype=np.float64)
        for z, beta in zip(landmarks, whiten @ w[:-1], strict=True):
            f, v, norm = features([z])
            np.add.at(table, f[0], v * (beta / norm[0]))
        model = KernelModel(table.astype(np.float32), float(w[-1]), (0.0, 0.0, 0.0), 0.0)
        decision = model.decide(strings)
        hard = model.decide(pool)
        hardest = [pool[i] for i in np.argsort(-hard, kind="stable")[:CLEAN_STRINGS]]
    model.lowest = float(min(decision.min(), hard.min()))
    rest = np.flatnonzero(calibration)
    if len(np.unique(label[rest])) < 2:
        rest = np.arange(len(bags))
    top = Scorer(model).decisions([sample["text"][i] for i in rest])
    model.curve = tuple(fit_logistic(evidence(top), label[rest].astype(float), ridge=1e-5).tolist())
    return model


def train(docs: DataFrame, labels: DataFrame) -> KernelModel:
    """The contract's split: rows with crc32(doc_id) mod 3 = 1 are held out."""
    usable = fold(F.col("doc_id"), 3) != 1
    return fit(labelled_sample(docs, labels, "toxic", usable, SAMPLE_DOCS, SAMPLE_CHARS))


def score(docs: DataFrame, model: KernelModel) -> DataFrame:
    """``doc_id, score`` of each row, from its whole text."""

    def maker() -> Callable[[list[str | None]], list[pa.Array]]:
        scorer = Scorer(model)
        return lambda texts: [pa.array(scorer.scores(texts))]

    return per_text(docs, maker, "score double")


def op6_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        (fold(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents whose score stays below the threshold, in their own columns."""
    model = train(docs, read_table(spark, sf_dir, "labels"))
    def decider() -> Callable[[list[str | None]], np.ndarray]:
        scorer = Scorer(model)
        return lambda texts: scorer.scores(texts) < THRESHOLD

    return keep_rows(docs, decider)
