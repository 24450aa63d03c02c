"""Near duplicates of a large group: what the rounds leave out meets in blocks, and no link depends on the rounds."""

import random

import pytest

from epilimnia.llm import dart_minhash
from tests.llm.test_near_groups import merges, together


def edits(rng, n, size, most):
    """Edits of one text, 0.1 to 0.4 from each other."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(size)]
    out = []
    for _ in range(n):
        words = list(base)
        for at in rng.sample(range(size), rng.randint(1, most)):
            words[at] = word()
        out.append(" ".join(words))
    return out


def linked(spark, texts, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = sorted((r["doc_id"], r["class_id"]) for r in dart_minhash.classes(docs, **how).collect())
    return together([c for _, c in rows])


def test_links_beside_centre_and_rounds_are_found(spark, monkeypatch):
    rng = random.Random(12)
    # Twins far from the text that all others are edits of: linked to each other alone.
    group = edits(rng, 60, 200, 3)
    far = edits(random.Random(12), 40, 200, 14)
    twins = [t + " " + " ".join(f"only{i}" for i in range(3)) for t in far]
    texts = group + far + twins
    want = merges(texts)
    monkeypatch.setattr(dart_minhash, "ROUNDS", 0)
    monkeypatch.setattr(dart_minhash, "BLOCK", 16)
    got = linked(spark, texts)
    assert got <= want
    assert len(got) >= 0.995 * len(want)


def test_rounds_change_nothing(spark):
    texts = edits(random.Random(3), 150, 150, 7)
    assert linked(spark, texts) == linked(spark, texts, exact=True)


@pytest.mark.parametrize("split", [False, True])
def test_links_of_one_group(split):
    import numpy as np
    import pyarrow as pa

    texts = edits(random.Random(2), 40, 150, 6)
    shingler = dart_minhash.Shingler()
    sets = [shingler.elements(dart_minhash.words_of(t)) for t in texts]
    made = dart_minhash.signatures([e for e, _ in sets], [w for _, w in sets])
    n = len(texts)
    keys = np.tile(np.arange(dart_minhash.BANDS), (n, 1))  # all in one bucket, the first one
    marks = dart_minhash.mix(made * dart_minhash._C).view(np.int8)[:, ::8]
    second = np.arange(n) % 2 == 1 if split else np.zeros(n, dtype=bool)
    columns = [
        np.zeros(n, dtype=int), np.zeros(n, dtype=int), np.full(n, int(split)), second, np.arange(n), np.arange(n),
        np.array([w.sum() for _, w in sets]), np.zeros(n), np.ones(n), list(marks), list(keys), texts,
    ]
    group = pa.table([pa.array(c) for c in columns], names=[f"c{i}" for i in range(len(columns))])
    links = dart_minhash._group_links(group, shingler)
    near = {(i, j) for i in range(n) for j in range(i + 1, n) if dart_minhash.similarity(sets[i], sets[j]) >= dart_minhash.SIMILARITY}
    assert near and set(links) <= near
    able = {(i, j) for i, j in near if not split or second[i] != second[j]}

    def parts(pairs):
        of = list(range(n))
        for i, j in pairs:
            of = [of[i] if c == of[j] else c for c in of]
        return together(of)

    assert parts(links) == parts(able)
    assert len(links) < n


def test_pipeline_stage_keeps_one_of_each_class(spark, monkeypatch):
    # Texts far from the centre and their twins: without blocks a twin stays where no round has met it.
    rng = random.Random(12)
    texts = edits(rng, 60, 200, 3) + edits(random.Random(12), 40, 200, 14)
    texts += [t + " only0 only1 only2" for t in texts[60:]]
    wanted = merges(texts)
    classes = {i: min([i, *[a for a, b in wanted if b == i]]) for i in range(len(texts))}
    monkeypatch.setattr(dart_minhash, "ROUNDS", 0)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = sorted(r["doc_id"] for r in dart_minhash.keep_one_of_each(spark, docs, "").collect())
    assert kept == sorted(set(classes.values()))


@pytest.mark.parametrize("split", [False, True])
def test_no_link_depends_on_the_agreement_of_signatures(monkeypatch, split):
    import numpy as np
    import pyarrow as pa

    # No signatures agree: what can be near duplicates is compared all the same, texts of any weight.
    monkeypatch.setattr(dart_minhash, "AGREE", dart_minhash.K + 1)
    monkeypatch.setattr(dart_minhash, "BIN_CELLS", 64, raising=False)
    texts = edits(random.Random(4), 30, 150, 6) + edits(random.Random(5), 10, 12, 1) + ["one", "two words", "la " * 400, "la " * 420]
    shingler = dart_minhash.Shingler()
    sets = [shingler.elements(dart_minhash.words_of(t)) for t in texts]
    n = len(texts)
    second = np.arange(n) % 2 == 1 if split else np.zeros(n, dtype=bool)
    columns = [
        np.zeros(n, dtype=int), np.zeros(n, dtype=int), np.full(n, int(split)), second, np.arange(n), np.arange(n),
        np.array([w.sum() for _, w in sets]), np.zeros(n), np.ones(n), list(np.zeros((n, dart_minhash.K), dtype=np.int8)),
        list(np.tile(np.arange(dart_minhash.BANDS), (n, 1))), texts,
    ]
    links = dart_minhash._group_links(pa.table([pa.array(c) for c in columns], names=[f"c{i}" for i in range(len(columns))]), shingler)
    near = {(i, j) for i in range(n) for j in range(i + 1, n) if dart_minhash.similarity(sets[i], sets[j]) >= dart_minhash.SIMILARITY}
    able = {(i, j) for i, j in near if not split or second[i] != second[j]}
    assert able and set(links) <= able
    of = list(range(n))
    for i, j in links:
        of = [of[i] if c == of[j] else c for c in of]
    assert all(of[i] == of[j] for i, j in able)


def test_pipeline_stage_compares_pairs_whose_signatures_agree_too_little(spark, monkeypatch):
    texts = edits(random.Random(12), 40, 200, 3) + edits(random.Random(12), 30, 200, 14)
    texts += [t + " only0 only1 only2" for t in texts[40:]]
    wanted = merges(texts)
    monkeypatch.setattr(dart_minhash, "ROUNDS", 0)
    monkeypatch.setattr(dart_minhash, "AGREE", dart_minhash.K + 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = sorted(r["doc_id"] for r in dart_minhash.keep_one_of_each(spark, docs, "").collect())
    assert kept == sorted({min([i, *[a for a, b in wanted if b == i]]) for i in range(len(texts))})


def test_rounds_end_when_they_link_nothing(spark, monkeypatch):
    # Texts that share buckets and are all more than 0.2 from each other.
    words = edits(random.Random(7), 1, 200, 1)[0].split()
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("xyz") for _ in range(9)) if at % 67 == n or at % 71 == n else w for at, w in enumerate(words)) for n in range(60)]
    rounds, opened = [], dart_minhash._open
    monkeypatch.setattr(dart_minhash, "_open", lambda *how: rounds.append(1) or opened(*how))
    assert linked(spark, texts) == merges(texts)
    assert len(rounds) == 2
