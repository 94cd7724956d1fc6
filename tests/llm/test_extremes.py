"""Hot keys, cut chunks, clashing names and very long values give the same results."""

import hashlib
import random

import brute
import numpy as np
import pandas as pd
import pytest

from histoloom.llm import components, fingerprints, idfilter, jaccard, storage, suffixes, token_files, url_filter


def repeated_rows():
    r = random.Random(11)
    passage = [f"p{i}" for i in range(70)]
    rows = []
    for i in range(80):
        a = r.randint(0, 25)
        left, right = [f"l{r.randint(0, 3)}" for _ in range(r.randint(0, 20))], [f"r{i % 4}x{j}" for j in range(r.randint(0, 30))]
        rows.append((i, " ".join(left + passage[a : a + r.randint(30, 60)] + right)))
    return rows + [(200, " ".join(["loop"] * 130)), (201, " ".join(passage * 3)), (202, " ".join(passage))]


@pytest.mark.parametrize("heavy, chunk", [(suffixes.HEAVY, suffixes.CHUNK), (5, 1 << 15), (10**9, 7), (3, 4)])
def test_repeats_whatever_the_parts(spark, heavy, chunk):
    rows = repeated_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc: {q for s in x.spans for q in range(s["start"], s["end"])} for x in suffixes.repeated_spans(docs, heavy=heavy, chunk=chunk).collect()}
    expected = {i: gone for (i, _), (_, gone, _) in zip(rows, brute.repeats(rows), strict=True) if gone}
    assert got == expected


def test_sources_hold_the_passage_earlier(spark):
    rows = repeated_rows()
    words = {i: t.split() for i, t in rows}
    for x in suffixes.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        for s in x.spans:
            first = tuple(words[x.doc][s["start"] : s["start"] + 50])
            assert any(any(tuple(words[d][j : j + 50]) == first for j in range(len(words[d]) - 49)) for d in range(x.doc + 1) if d in words)
        assert all(d <= x.doc for d in x.sources)


def test_null_keys_and_repeated_rows_stay_apart(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    docs = spark.createDataFrame([(None, "a " + passage), (None, "b " + passage), (5, passage), (5, passage), (4, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_repeated) for r in suffixes.without_repeats(docs, report=True).collect())
    assert got == [("4", 0, 0), ("5", 55, 0), ("5", 55, 0), ("None", 56, 55), ("None", 56, 55)]


def test_next_of_hot_and_clashing_rows(spark):
    rows = [(7, f"text {i}", 1, 2, 3, 4) for i in range(400)] + [(7, "same", 1, 2, 3, 4)] * 300 + [(i, f"own {i}", 0, 0, 0, 0) for i in range(20)] + [(None, None, 0, 0, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, _text string, _part int, _guest int, _order int, _tie int").repartition(3)
    dealt, name = fingerprints.with_next(docs, "doc_id", "_text", 12)
    got = dealt.toPandas()
    assert set(docs.columns) < set(got.columns) and len(set(got.columns)) == len(got.columns) == 10
    own, guests = got[~got[name["guest"]]], got[got[name["guest"]]]
    assert len(own) == len(rows) and own[name["part"]].value_counts().max() < 250  # hot key and equal rows span parts
    # Walk the parts: every row has a next one, each text is next as often as it occurs, and the order is that of key and tie.
    following, pairs = [], []
    for p, rest in own.groupby(name["part"]):
        rest = rest.sort_values([name["order"], name["tie"]], ascending=False)
        ends = guests[guests[name["part"]] == p].sort_values([name["order"], name["tie"]], ascending=False)
        chain = [*rest["_text"].fillna("").tolist(), ends["_text"].fillna("").iloc[0]]
        following += chain[1:]
        pairs += list(zip(chain, chain[1:], strict=False))
    assert sorted(following) == sorted(t or "" for _, t, *_ in rows)
    tie = {t: x for t, x in zip(got["_text"].fillna(""), got[name["tie"]], strict=True)}
    place = {t: (-(1 << 63) if k is None else k, tie[t or ""]) for k, t, *_ in rows}
    order = sorted(((*place[t], t or "") for _, t, *_ in rows), reverse=True)
    assert sorted(pairs) == sorted(zip([t for *_, t in order], [*[t for *_, t in order[1:]], order[0][2]], strict=True))


def test_cuts_between_pairs():
    r = np.random.default_rng(1)
    for _ in range(50):
        cuts = np.array(sorted(r.integers(0, 4, (r.integers(0, 9), 2)).tolist()), dtype=np.int64).reshape(-1, 2)
        key, tie = r.integers(-1, 5, 40), r.integers(-1, 5, 40)
        less, least = fingerprints._before(cuts, key, tie)
        both = list(zip(key.tolist(), tie.tolist(), strict=True))
        assert less.tolist() == [sum(tuple(c) < p for c in cuts.tolist()) for p in both] and least.tolist() == [sum(tuple(c) <= p for c in cuts.tolist()) for p in both]


def test_fingerprints_of_a_very_long_text(spark):
    text = " ".join(f"w{i % 50021}" for i in range(1_200_000))
    docs = spark.createDataFrame([(1, text), (2, text.upper()), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: bytes(r.fingerprint) for r in fingerprints.fingerprint(docs).collect()}
    assert got[1] == got[2] != got[3] and len(got[1]) == 256


def test_urls_with_clashing_names_hot_and_long(spark):
    long_host = "http://" + "a." * 3000 + "example.com/en/x"
    rows = [(i, "http://example.com/en/1", i, i, i) for i in range(300)] + [(1000, long_host, 1, 1, 1), (1001, None, 1, 1, 1), (1002, "http://x.net/de/", 1, 1, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, _key int, _best int, n int")
    listed = spark.createDataFrame(url_filter.RULES, "host string, path string, action string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, listed).collect()}
    assert len(got) == 303 and all(got[i].rule == "com/en/" and got[i]._key == i for i in range(300))
    assert (got[1000].rule, got[1000].verdict, got[1001].verdict, got[1002].rule) == ("com/en/", "block", "allow", "net/de/")
    assert url_filter.judge_urls(pages.withColumnRenamed("url", "host"), listed.limit(0), "host").columns == ["page_id", "_key", "_best", "n", "host", "path", "rule", "verdict"]


@pytest.mark.parametrize("blocks", [None, 1])
def test_urls_of_a_long_list(spark, blocks):
    r = random.Random(3)
    hosts = [f"h{i}.{t}" for i in range(150) for t in ("com", "co.uk")]
    listed = list({(r.choice(hosts), "/" + "ab/"[: r.randint(0, 3)] * r.randint(0, 4)): r.choice(["block", "allow"]) for _ in range(6000)}.items())
    pages = [(i, f"HTTP://{r.choice(['', 'www.', 'x.y.'])}{r.choice([*hosts, 'h9.org', 'oh9.com'])}/{'ab/' * r.randint(0, 5)}?q#f") for i in range(2000)]
    rules = spark.createDataFrame([(h, p, a) for (h, p), a in listed], "host string, path string, action string")
    got = url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), rules, blocks=blocks).collect()
    assert len(got) == len(pages)
    for x in got:
        fits = [(len(h + p), len(h), h + p, a) for (h, p), a in listed if (x.host == h or x.host.endswith("." + h)) and x.path.startswith(p)]
        assert (x.rule, x.verdict) == (max(fits)[2:] if fits else (None, "allow"))


def test_filter_rows_follow_the_list():
    assert [url_filter.blocks_for(n) for n in (0, 4096, 4097, 500_000, 10**9)] == [1024, 1024, 2048, 131072, 1 << 20]


@pytest.mark.parametrize("run", [1, 2, 5])
def test_prefix_scan_in_runs(spark, run):
    r = random.Random(run)
    ids = [50256 if r.random() < 0.15 else r.randint(0, 9) for _ in range(300)] + [1, 2]
    blocks = [(f, b, np.array(ids[i : i + n], "<u2").tobytes()) for f, n in (("a", 4), ("b", 31), ("c", 1000)) for b, i in enumerate(range(0, len(ids), n))]
    got = token_files.count_tokens(spark.createDataFrame(blocks, "file string, block long, ids binary"), run=run).toPandas()
    parts = " ".join(map(str, ids)).split("50256")
    for _, g in got.groupby("file"):
        g = g.sort_values("ordinal")
        assert g.n_tokens.tolist() == [len(p.split()) for p in parts] and g.ended.tolist() == [True] * (len(parts) - 1) + [False]


def test_components_in_small_chunks(spark, monkeypatch):
    r = np.random.default_rng(4)
    u, v = r.integers(0, 300, 260), r.integers(0, 300, 260)
    nodes, root = components.rooted(u, v)
    parent = {int(n): int(n) for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert root.tolist() == [find(int(n)) for n in nodes]
    monkeypatch.setattr(components, "CHUNK_EDGES", 10)
    edges = spark.createDataFrame(list(zip(u.tolist(), v.tolist(), strict=True)), "u long, v long").repartition(5)
    got = {x.node: x.component for x in components.components(edges).collect()}
    assert got == {int(n): find(int(n)) for n in nodes if sum(find(int(m)) == find(int(n)) for m in nodes) > 1}
    more = components.extended(components.components(edges), spark.createDataFrame([(0, 900), (900, 901)], "u long, v long"))
    assert {x.node: x.component for x in more.collect()}[901] == min(find(0) if 0 in parent else 0, 0)


def test_joins_without_filters_and_with_heavy_classes(spark, monkeypatch):
    base = [f"b{i}" for i in range(30)]
    rows = [(i, " ".join(base)) for i in range(60)] + [(100 + i, " ".join([*base[:i], "x", *base[i + 1 :]])) for i in range(0, 30, 3)] + [(300, "other text"), (None, " ".join(base)), (301, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = {i: c for i, (_, c) in brute.components([x for x in rows if x[0] is not None]).items()}
    for bits, heavy, small in ((idfilter.FILTER_BITS, jaccard.HEAVY, jaccard.BROADCAST_ROWS), (0, 2, 0)):
        monkeypatch.setattr(idfilter, "FILTER_BITS", bits)
        monkeypatch.setattr(jaccard, "HEAVY", heavy)
        monkeypatch.setattr(jaccard, "BROADCAST_ROWS", small)
        got = jaccard.similar_documents(docs).collect()
        assert {x.doc_id: x.component_id for x in got if x.doc_id is not None} == expected and len(got) == len(rows)
        assert jaccard.one_of_each(docs).count() == sum(expected[i] == i for i in expected) + 1
    monkeypatch.setattr(idfilter, "FILTER_BITS", 0)
    again = repeated_rows()
    cut = {r.doc_id: r.text for r in suffixes.without_repeats(spark.createDataFrame(again, "doc_id long, text string")).collect()}
    assert cut == {i: t for (i, _), (_, _, t) in zip(again, brute.repeats(again), strict=True)}


def test_written_tables_go_with_their_block(spark):
    with storage.scratch():
        gone = storage.written(spark.range(3), "a")
        stays = storage.kept(storage.written(spark.range(4), "b"))
    assert stays.count() == 4
    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.parquet(gone._written_path).count()


def test_limits_of_batches(spark):
    storage.small_batches(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= storage.BATCH_BYTES


def test_edited_digest_is_of_the_edited_text(spark, odd_dir):
    got = fingerprints.op1_one_permutation(spark, odd_dir).toPandas()
    docs = pd.read_parquet(f"{odd_dir}/documents.parquet")
    known = docs.dropna(subset=["doc_id"]).sort_values("doc_id", ascending=False)
    by = {r.doc_id: r.edited_sha256 for r in got.itertuples() if not pd.isna(r.doc_id)}
    unique = [i for i, n in known.doc_id.value_counts().items() if n == 1]
    texts = known.text.fillna("").tolist()
    for at, i in enumerate(known.doc_id.tolist()[:-1]):
        if i in unique and known.doc_id.iloc[at + 1] in unique:
            k = len(texts[at]) // 3
            assert by[i] == hashlib.sha256((texts[at][: len(texts[at]) - k] + texts[at + 1][:k]).encode()).hexdigest()
    assert len(got) == len(docs)


def test_densification_takes_the_first_filled_donor():
    r = np.random.default_rng(7)
    bins = 64
    least = np.full((40, bins), fingerprints._EMPTY)
    for i, row in enumerate(least):
        some = r.choice(bins, min(i, bins), replace=False)
        row[some] = r.integers(0, 1 << 60, len(some))
    got = fingerprints._densified(least, bins)
    assert (got[0] == fingerprints._EMPTY).all()
    for row, out in zip(least[1:], got[1:], strict=True):
        for b in range(bins):
            at, attempt = b, 0
            while row[at] == fingerprints._EMPTY:
                attempt += 1
                at = int(fingerprints._donors.__wrapped__(bins, attempt)[b])
            assert out[b] == row[at]
