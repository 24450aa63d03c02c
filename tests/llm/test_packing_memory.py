"""Memory of a packing task."""

import tracemalloc

from epilimnia.llm import best_fit


def test_packing_holds_the_words_of_one_text(monkeypatch):
    monkeypatch.setattr(best_fit, "per_text", lambda docs, maker, *columns, **carry: maker)
    work = best_fit.sizes(None)()
    texts = [" ".join(f"w{i}x{j}" for j in range(2_000)) for i in range(200)]
    tracemalloc.start()
    counts, clusters = work([*texts, None, " \n", texts[0].replace(" ", "\t\t")])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts.to_pylist() == [2_000] * 200 + [0, 0, 2_000]
    assert clusters.null_count == 2 and clusters[202] == clusters[0] and len(set(clusters.to_pylist())) == 201
    assert peak < 2_000_000  # 400 000 words at once are 20 MB and more
