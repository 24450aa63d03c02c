"""Phrases, conversation trie and nearest neighbours against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from epilimnia.llm import multi_index, phrases, prefix_trie


def gram_counts(texts, size):
    """Occurrences of all phrases within pieces, by plain Python."""
    f, n = Counter(), 0
    for text in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n += len(words)
            for k in range(1, size + 1):
                f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return f, n


def brute_phrases(texts, size, min_count, covered, top):
    f, n = gram_counts(texts, size)
    candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
    rows = []
    for p, a in candidates.items():
        cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
        inside = any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items())
        if not inside:
            score, _, left, right = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), left, right))
    return [(i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]


@pytest.mark.parametrize(("size", "chunk", "top"), [(3, 50, 2000), (4, 10_000, 25), (2, 500, 10)])
def test_phrases_equal_brute_force(spark, monkeypatch, size, chunk, top):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    monkeypatch.setattr(phrases, "BUCKET_BYTES", 2_000)
    monkeypatch.setattr(phrases, "SLICE", 64)
    rng = random.Random(size)
    word = lambda: rng.choice(["the", "New", "YORK", "city", "of", "a", "É", "x\u00a0y", "日本", "b"])
    docs = [("en", " ".join(word() + rng.choice(["", "", "", ".", "\n", "\t", "!?", "  "]) for _ in range(rng.randrange(60)))) for _ in range(120)]
    docs += [("fr", t.replace("the", "le")) for _, t in docs[:40]] + [(None, "no no no no no no no no no no no no"), ("en", None), ("de", ""), ("en", "New York " * 300)]
    df = spark.createDataFrame([(i, la, t, 1) for i, (la, t) in enumerate(docs)], "doc_id long, lang string, text string, words int").repartition(3)
    got = defaultdict(list)
    for r in sorted(phrases.collocations(df, size, 5, 50, top).collect(), key=lambda r: r["rank"]):
        got[r["lang"]].append((r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]))
    want = {la: brute_phrases([t for k, t in docs if (k or "und") == la], size, 5, 50, top) for la in ("en", "fr", "und", "de")}
    assert dict(got) == {la: rows for la, rows in want.items() if rows}


def test_phrase_scores_are_exact_beyond_64_bits(spark):
    big = 3_000_000_000
    rows = [("en", 0, None, None, None, 3 * big), ("en", 1, "a", None, None, big), ("en", 1, "b", None, None, big + 1), ("en", 2, "a", "b", None, big - 1)]
    frame = spark.createDataFrame(rows, "lang string, words int, w1 string, w2 string, w3 string, f long")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(phrases, "frequencies", lambda *_: frame)
        r = phrases.candidates(None).collect()
    assert [(x["phrase"], x["score"]) for x in r] == [("a b", 1_000_000 * (big - 1) ** 2 // (big * (big + 1)))]


def brute_trie(rows):
    """All nodes of the rebuilt conversations, by plain Python. ``rows``: conv_id, turn, role, text."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), sha, (role, text)))
    turns = {c: [t for *_, t in sorted(v)] for c, v in own.items()}
    made = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        made[c] = tuple(turns.get(base, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, path in made.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaf = lambda q: not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in members)
        ends = ",".join(map(str, sorted(c for c in m if len(made[c]) == len(p))))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        up = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), up, len(m), len(children), sum(map(leaf, below)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize(("shard", "fan", "ids"), [(500_000, 64, 8192), (6, 2, 1), (1, 3, 2)])
def test_trie_equals_brute_force(spark, monkeypatch, shard, fan, ids):
    monkeypatch.setattr(prefix_trie, "IDS", ids)
    rng = random.Random(shard)
    rows = []
    for c in [*range(0, 60), *range(100, 130), 250, *range(-120, -90)]:
        rows += [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "bot", None]), rng.choice(["a", "bb", "", None, "éé"])) for t in range(rng.randrange(1, 6))]
    rows += [(c, t, "user", f"same {t}") for c in range(300, 340) for t in range(7)]  # a group of equal conversations
    rows += [(None, 1, "user", "nobody")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    got = prefix_trie.trie(prefix_trie.rebuild(prefix_trie.settle(prefix_trie.encode(df), "own")), shard, fan)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got.columns == columns
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_trie(rows)


def test_ternary_tree_is_balanced():
    tree = prefix_trie.TernaryTree()
    rows = [[i, j] for i in range(64) for j in range(4)]
    places = tree.insert_balanced(rows, [[1, 1]] * len(rows))
    assert [[tree.symbol[x] for x in tree.path(p)[1:]] for p in places] == rows
    depth, todo = 0, [(tree.down[0], 1)]
    while todo:
        node, d = todo.pop()
        if node >= 0:
            depth = max(depth, d)
            todo += [(tree.low[node], d + 1), (tree.high[node], d + 1)]
    assert depth <= 9  # 64 first turns


def brute_nearest(rows, top=20, every=20):
    ok = {}
    size = 3
    for i, v in rows:
        if i is not None and v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, set()).add(tuple(map(float, v)))
    out = []
    for q in ok:
        if q % every == 0:
            a = min(ok[q])
            near = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, vs in ok.items() if i != q for v in vs)[:top]
            out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near)]
    return sorted(out)


def test_nearest_on_odd_vectors(spark, odd):
    from .conftest import VECTORS

    got = sorted(map(tuple, multi_index.op12_multi_index(spark, odd).collect()))
    assert got == brute_nearest(VECTORS)


def test_nearest_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 100)
    monkeypatch.setattr(multi_index, "QUERIES", 7)
    rng = np.random.default_rng(3)
    grid = rng.normal(size=(1500, 16)) * rng.uniform(0.2, 3, size=(1500, 1))  # lengths differ
    grid[:500] = grid[0] + rng.normal(size=(500, 16)) * 1e-3  # a third of all rows lies in one place
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(grid)], "vec_id long, embedding array<double>").repartition(4)
    rows = multi_index.search(df, multi_index.F.col("vec_id") % 20 == 0).collect()
    found = defaultdict(dict)
    for r in rows:
        found[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
        assert r["score"] == pytest.approx(float(grid[r["query_id"]] @ grid[r["vec_id"]]), rel=1e-12, abs=1e-12)
    hits = 0
    for q in range(0, 1500, 20):
        order = sorted((-float(grid[q] @ grid[j]), j) for j in range(1500) if j != q)[:20]
        assert sorted(found[q]) == list(range(1, 21))
        hits += len({j for _, j in order} & {v for v, _ in found[q].values()})
        assert [found[q][k][1] for k in range(1, 21)] == sorted((s for _, s in found[q].values()), reverse=True)
    assert hits / (75 * 20) >= 0.9


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_nearest_recall_on_given_tables(spark, folder):
    path = f"/root/testdata/{folder}"
    rows = multi_index.op12_multi_index(spark, path).collect()
    table = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    ids, grid = np.array([r["vec_id"] for r in table]), np.array([r["embedding"] for r in table], dtype=float)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = grid @ grid[q]
        s[q] = -np.inf
        true = set(ids[np.argsort(-s)[:20]].tolist())
        hits += len(true & {r["vec_id"] for r in rows if r["query_id"] == ids[q]})
        total += len(true)
    assert hits >= 0.9 * total


def test_visits_go_by_summed_distance():
    rng = np.random.default_rng(1)
    one, two, held = rng.random(9), rng.random(7), rng.integers(0, 4, 63).tolist()
    sums = (one[:, None] + two[None, :]).ravel()
    want, seen = [], 0
    for cell in np.argsort(sums, kind="stable").tolist():
        if seen >= 40:
            break
        if held[cell]:
            want.append(cell)
            seen += held[cell]
    assert multi_index.visit(one, two, held, 40) == want
