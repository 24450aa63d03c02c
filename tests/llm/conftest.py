"""Small tables with every odd case: NULLs, empty and long texts, ties, repeated rows, clashing extra columns; and empty ones."""

import pytest

PROSE = "the erin of onha thst was reand to the inble and hean for thou"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
CLASHES = "label int, mix long, score double, node long, copies long, bin long, kept boolean, hit boolean"

DOCS = [
    (1, PROSE, "en", "a"),
    (2, PROSE.replace(" ", "  ") + "\n", "en", "a"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, " \t\n\x0b\x0c\r ", "de", "b"),
    (6, LONG, "de", "b"),
    (6, LONG, "de", "b"),
    (None, "no id here but a text of some words that nobody else has at all", "fr", None),
    (None, None, None, None),
    (7, PROSE + " end", None, "a"),
    (8, PROSE + "\r\n" + PROSE + "\n" + PROSE, "en", "c"),
    (9, "é", "fr", "c"),
    (10, "日本語 テスト 😀 <|endoftext|> x y", "ja", "c"),
]
LABELS = [(1, 1, 0), (2, 1, 0), (3, 0, 0), (7, 0, 1), (8, 1, 1), (9, None, None), (None, 1, 1), (1, 0, 1)]
PAGES = [
    (1, "https://m.Casino-win.example.org/en/5?x#y", "<p>a&amp;lt;<script>x</script>b</p>\r\n\r\nc"),
    (2, "https://www.example.com/en/a", ""),
    (2, "https://www.example.com/en/a", ""),
    (3, None, None),
    (4, "no scheme", "<!-- x --> plain"),
    (5, "http://a.net", "é"),
    (6, "http://sub.x.net/fr/q", "WARC/1.1\r\n\r\nWARC/1.1"),
    (None, "ftp://files.org/setup.EXE", "<style>p</style>"),
    (7, "http://notexample.com/en/", "<br>" * 3),
    (8, "http://example.com?/en/", "x" * 200_000),
]
CONVERSATIONS = [
    (0, 1, "user", "hello there"),
    (0, None, "system", None),
    (0, 2, None, "and so on"),
    (0, 2, None, "and so on"),
    (3, 1, "user", "hello there"),
    (3, 2, "assistant", "x" * 100_000),
    (7, 1, "user", ""),
    (105, None, None, None),
    (203, 1, "user", "\x00 é 😀"),
    (203, 2, "user", "b"),
    (203, 2, "user", "a"),
    (-5, 1, "user", "hello there"),
    (-5, 2, "user", "more"),
    (None, 1, "user", "nobody"),
    (2_000_000_000_000, 1, "user", "hello there"),
]
VECTORS = [
    (0, [1.0, 0.0, 2.0]),
    (0, [1.0, 0.0, 2.0]),
    (1, [1.0, 0.0, 2.0]),
    (20, [0.5, -1.0, 0.0]),
    (20, [0.25, -1.0, 0.0]),
    (40, None),
    (60, [0.0, 0.0, 0.0]),
    (80, [1.0, None, 2.0]),
    (100, [float("nan"), 1.0, 1.0]),
    (120, [float("inf"), 1.0, 1.0]),
    (None, [1.0, 1.0, 1.0]),
    (140, [1.0, 2.0]),
    (160, []),
    (-20, [-1.0, 0.0, -2.0]),
    *[(1000 + i, [3.0, 0.0, 0.0]) for i in range(30)],
]


def write(spark, folder, docs, labels, pages, conversations, vectors):
    spark.createDataFrame(
        [(i, t, la, s, len(t or ""), 1, 2, 0.5, 3, 4, 5, True, None) for i, t, la, s in docs],
        f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}",
    ).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, block int").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(*c, 1, "x") for c in conversations], "conv_id long, turn long, role string, text string, id int, row string").write.parquet(
        f"{folder}/conversations.parquet"
    )
    spark.createDataFrame([(*v, 1, 2, 0.5) for v in vectors], "vec_id long, embedding array<float>, label int, cell int, score double").write.parquet(
        f"{folder}/embeddings.parquet"
    )
    return folder


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    return write(spark, str(tmp_path_factory.mktemp("odd")), DOCS, LABELS, PAGES, CONVERSATIONS, VECTORS)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return write(spark, str(tmp_path_factory.mktemp("empty")), [], [], [], [], [])
