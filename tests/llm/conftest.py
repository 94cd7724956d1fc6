import pytest

LONG = " ".join(f"word{i * 7919 % 5003}" for i in range(6000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog again and again today", "en"),
    (2, "The quick brown fox jumps over the lazy dog again and again TODAY", "en"),
    (3, None, None),
    (4, "", "en"),
    (5, " \n\t ", None),
    (6, "one two", "en"),
    (7, "ONE  two", "de"),
    (8, LONG, "en"),
    (9, LONG + " tail", "en"),
    (10, "12 34 !! ##", "fr"),
    (11, "éàü ñandú größe — 漢字 \U0001f600 x", "fr"),
    (12, "lead in words " + PASSAGE + " and the end", "en"),
    (13, PASSAGE + " other end", "en"),
    (13, PASSAGE + " other end", "en"),  # a repeated row
    (14, "loop loop " * 60, "en"),
    (15, "same key, first text of the two", "en"),
    (15, "same key, second text, not like it at all", "en"),
    (None, "a row without a key but with some words", "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward documents, with columns named like the operators' own."""
    rows = [(i, t, lang, "s", len(t or ""), 0.5, "x", 7, 1) for i, t, lang in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, _whole string, spans int, n_words int").repartition(3).cache()


@pytest.fixture(scope="session")
def odd_dir(spark, odd, tmp_path_factory):
    """The documents and the other tables as a folder."""
    d = tmp_path_factory.mktemp("odd")
    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"file://{d}/documents.parquet")
    spark.createDataFrame([(1, "shared1 shared2 shared3 shared4 shared5 shared6 shared7 shared8 shared9 shared10 shared11"), (2, "One, two"), (3, None), (None, "lazy dog"), (4, "..."), (5, "absent")], "item_id long, text string").write.parquet(f"file://{d}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (8, None, 0), (None, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"file://{d}/labels.parquet")
    urls = ["http://A.example.com/en/71?x#y", "https://example.com/en/", "no scheme", None, "http://com/en/1", "://net/de/8", "http://b.example.net/de/8#z", "http://notexample.net/de/8", "http://x.org", "http://x.org/es/a://b", "http://x.org/es/a://b", "http://example.com./en/7", ""]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"file://{d}/pages.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty_dir(spark, odd_dir, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for t in ("documents", "benchmark", "labels", "pages"):
        spark.read.parquet(f"file://{odd_dir}/{t}.parquet").limit(0).coalesce(1).write.parquet(f"file://{d}/{t}.parquet")
    return str(d)
