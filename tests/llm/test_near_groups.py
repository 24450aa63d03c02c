"""Near duplicates of a large group that lies around the similarity: all pairs by brute force, the exact way, the rounds."""

import random
from collections import Counter

from epilimnia.llm import dart_minhash


def shingles(text):
    words = text.split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def merges(texts):
    """Pairs of documents in one class, by comparing all pairs."""
    bags, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(bags):
        for j in range(i):
            both = sum((a & bags[j]).values())
            if both / (sum(a.values()) + sum(bags[j].values()) - both) >= 0.8:
                parent[root(i)] = root(j)
    return together([root(i) for i in range(len(texts))])


def together(classes):
    members = {}
    for i, c in enumerate(classes):
        members.setdefault(c, []).append(i)
    return {(i, j) for m in members.values() for i in m for j in m if i < j}


def test_recall_around_the_similarity(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(200)]
    texts = []
    for _ in range(160):  # edits of one text: from well inside to well outside the similarity of each other
        words = list(base)
        for at in rng.sample(range(200), rng.choice([1, 2, 4, 5, 6, 8])):
            words[at] = word()
        texts.append(" ".join(words))
    chain = list(base[:120])  # each step is near the one before, the ends are not near each other
    for k in range(40):
        chain = [*chain]
        chain[(k * 3) % 120] = word()
        texts.append(" ".join(chain))
    texts += [" ".join(base[:100] + [word() for _ in range(100)]) for _ in range(40)]  # a shared passage below the similarity
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = merges(texts)
    for exact, recall in ((True, 0.995), (False, 0.98)):
        rows = sorted((r["doc_id"], r["class_id"]) for r in dart_minhash.classes(docs, exact).collect())
        got = together([c for _, c in rows])
        assert got <= want  # every link is checked by text
        assert len(got) >= recall * len(want), (exact, len(got), len(want))
