"""The corpus operators against plain versions, on the small tables and on awkward rows."""

import hashlib
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from histoloom.llm import catalog, components, decontaminate, fingerprints, jaccard, kernels, language, packing, quality, sampling, sharding, suffixes, token_files, tokens

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SMALL}/documents.parquet")


def table(spark, rows, ddl="doc_id long, text string"):
    return spark.createDataFrame(rows, ddl)


# ---- kernels


def test_words_and_shingles_agree_with_plain_ones():
    r = random.Random(4)
    texts = ["".join(r.choice("aB c\n\té\x00.9") for _ in range(r.randint(0, 60))) for _ in range(300)]
    for rule, pattern in (("space", brute.SPACED), ("alnum", brute.ALNUM)):
        seen = {}
        got = [(w, d) for w in kernels.words(pa.array(texts), rule) for d in range(w.n)]
        for text, (w, d) in zip(texts, got, strict=True):
            plain = pattern.findall(text.translate(brute.LOWER))
            own = w.hashes[w.bounds[d] : w.bounds[d + 1]].tolist()
            assert len(own) == len(plain)
            for a, b in zip(plain, own, strict=True):
                assert seen.setdefault(a, b) == b
        assert len(set(seen.values())) == len(seen)
    for w in kernels.words(pa.array(texts), "space"):
        h, doc = kernels.shingles(w)
        n = Counter(doc.tolist())
        assert [len({x for x, d in zip(h.tolist(), doc.tolist(), strict=True) if d == i}) for i in range(w.n)] == [len(brute.shingles(t)) for t in texts]
        assert sum(n.values()) == len(h)


def test_chunks_don_t_change_words(monkeypatch):
    texts = ["alpha beta " * 50, "", "x" * 300 + " y", "gamma"]
    whole = np.concatenate([w.hashes for w in kernels.words(pa.array(texts), "space")])
    monkeypatch.setattr(kernels, "CHUNK_BYTES", 64)
    kernels._powers.cache_clear()
    parts = np.concatenate([w.hashes for w in kernels.words(pa.array(texts), "space")])
    kernels._powers.cache_clear()
    assert whole.tolist() == parts.tolist()


# ---- 1 fingerprints


def test_fingerprints(spark, docs):
    got = fingerprints.op1_one_permutation(spark, SMALL).toPandas().set_index("doc_id")
    order = docs.sort_values("doc_id", ascending=False).reset_index(drop=True)
    off = []
    for i, text in enumerate(order.text):
        after = order.text[(i + 1) % len(order)]
        k = len(text) // 3
        edited, row = text[: len(text) - k] + after[:k], got.loc[order.doc_id[i]]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for near, other in ((row.near_edited, edited), (row.near_next, after)):
            a, b = brute.shingles(text), brute.shingles(other)
            off.append(near - (len(a & b) / len(a | b) if a | b else 1))
    assert len(got) == len(order) and abs(np.mean(off)) < 0.01 and np.abs(off).max() < 0.2


def test_fingerprints_of_odd_rows(spark, odd_dir, odd):
    got = fingerprints.op1_one_permutation(spark, odd_dir).toPandas()
    assert len(got) == odd.count() and got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    first = {r.doc_id: r for r in got.itertuples()}
    assert first[4].fingerprint == first[3].fingerprint == first[5].fingerprint == "" and first[3].n_chars == 0
    assert first[1].fingerprint == first[2].fingerprint  # they differ in case only
    assert fingerprints.fingerprint(odd, into="spans").columns == odd.drop("spans").columns + ["spans"]


def test_densification_fills_from_filled_bins():
    texts = pa.array(["a b c d e", "a b c d e f", ""])
    a, b, c = fingerprints.fingerprints_of(texts)
    assert len(a) == len(b) == fingerprints.BINS * fingerprints.BITS // 8 and c == b""
    assert abs(fingerprints.likeness(a, b) - 0.5) < 0.15


# ---- 2 Jaccard join


@pytest.mark.parametrize("tile", [jaccard.TILE_TOKENS, 2000])
def test_components(spark, docs, tile):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(df, tile_tokens=tile).collect()}
    assert got == brute.components(list(zip(docs.doc_id, docs.text, strict=True)))


def chained(n=60, size=40):
    """Sets that slide: each links with its neighbours only; and unlinked ones that share a lot."""
    rows = [(i, " ".join(f"t{j}" for j in range(i * 3, i * 3 + size))) for i in range(n)]
    rows += [(1000 + i, " ".join([*(f"t{j}" for j in range(25)), *(f"own{i}x{j}" for j in range(20))])) for i in range(30)]
    return rows


@pytest.mark.parametrize("tile", [1 << 20, 300, 60])
def test_chains_across_tiles(spark, tile):
    rows = chained()
    got = {r.doc_id: r.component_id for r in jaccard.similar_documents(table(spark, rows), tile_tokens=tile).collect()}
    assert got == {i: c for i, (_, c) in brute.components(rows).items()}


def test_random_near_copies(spark):
    r = random.Random(9)
    rows = []
    for g in range(12):
        base = [f"w{r.randint(0, 300)}" for _ in range(r.randint(3, 60))]
        for _ in range(8):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(own) // 12))):
                own[r.randrange(len(own))] = f"w{r.randint(0, 300)}"
            rows.append((len(rows), " ".join(own)))
    expected = {i: c for i, (_, c) in brute.components(rows).items()}
    for tile in (1 << 20, 200):
        assert {x.doc_id: x.component_id for x in jaccard.similar_documents(table(spark, rows), tile_tokens=tile).collect()} == expected


def test_blocks_of_a_group_cover_all_pairs():
    rows = chained(20, 30)
    sets = [np.sort(np.array([hash(x) & (1 << 64) - 1 for x in brute.shingles(t)], dtype=np.uint64)) for _, t in rows]
    whole = jaccard.link_group(sets, list(range(len(sets))), [False] * len(sets))
    block = [i % 2 == 0 for i in range(len(sets))]
    across = jaccard.link_group(sets, list(range(len(sets))), block)
    assert whole[:20] == [0] * 20 and across[:20] == [0] * 20 and whole[20:] == across[20:]


@pytest.mark.parametrize("tile", [1 << 20, 300])
def test_number_of_links(spark, tile):
    r = random.Random(4)
    base = [f"b{i}" for i in range(50)]
    near = [[*base[:i], f"x{r.randint(0, 3)}", *base[i + 1 :]] for i in range(0, 50, 2)]
    rows = chained(30) + [(2000 + i, " ".join(w)) for i, w in enumerate([*near, base, base, base])] + [(2000, " ".join(base)), (2001, "other words"), (3000, None), (None, " ".join(base))]
    sets = [(i, brute.shingles(t)) for i, t in rows]
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)
    expected = sorted(repr((i, len(s), sum(j is not None and x != y and linked(s, t) for y, (j, t) in enumerate(sets)) if i is not None else 0)) for x, (i, s) in enumerate(sets))
    got = jaccard.similar_documents(table(spark, rows), tile_tokens=tile, count_links=True).collect()
    assert sorted(repr((x.doc_id, x.n_shingles, x.n_links)) for x in got) == expected


def test_join_of_odd_rows(spark, odd):
    got = jaccard.similar_documents(odd).toPandas()
    by = {r.doc_id: r for r in got.itertuples() if not pd.isna(r.doc_id)}
    assert len(got) == odd.count()
    assert by[2].component_id == 1 and by[7].component_id == 6 and by[9].component_id == 8
    assert [by[i].component_id for i in (3, 4, 5)] == [3, 4, 5] and by[3].n_shingles == 0
    assert pd.isna(got[got.doc_id.isna()].component_id.iloc[0])
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 3, 4, 5, 6, 8, 10, 11, 12, 14, 15, 15]  # 13 goes with 12


def test_components_of_a_long_path(spark):
    edges = spark.range(1, 300).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    got = components.components(edges.unionByName(table(spark, [(500, 501), (7, 7), (None, 3)], "u long, v long")))
    assert {(r.node, r.component) for r in got.collect()} == {(i, 0) for i in range(300)} | {(500, 500), (501, 500)}


# ---- 3 language


def test_language_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = language.op3_subword_softmax(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in zip(got.doc_id, got.held_out, strict=True))


def test_language_of_odd_rows(spark, odd, odd_dir):
    got = language.op3_subword_softmax(spark, odd_dir).toPandas()
    und = got[got.doc_id.isin([3, 4, 5, 10])]
    assert (und.lang_pred == "und").all() and (und.score == 0).all() and len(got) == odd.count()
    blank = language.fit([], [])
    assert {r.lang_pred for r in language.predict(odd, blank).collect()} == {"und"}
    one = language.predict(odd, language.fit([(np.array([1, 2]), np.array([1.0, 1.0]))] * 3, ["en"] * 3))
    assert one.columns == [c for c in odd.columns if c != "score"] + ["lang_pred", "score", "accepted"]


# ---- 4 suffixes


def test_repeats(spark, docs):
    got = suffixes.op4_sparse_suffixes(spark, SMALL).toPandas().set_index("doc_id")
    order = docs.sort_values("doc_id")
    for i, (n, gone, text) in zip(order.doc_id, brute.repeats(list(zip(order.doc_id, order.text, strict=True))), strict=True):
        row = got.loc[i]
        assert (row.n_words, row.n_repeated, row.text) == (n, len(gone), text)
        assert {q for s in row.spans for q in range(s["start"], s["end"])} == gone


def test_repeats_at_every_offset(spark):
    r = random.Random(2)
    base = [f"p{i}" for i in range(140)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        a = r.randint(0, 80)
        rows.append((i, " ".join([f"l{i}x{j}" for j in range(r.randint(0, 30))] + base[a : a + r.randint(44, 58)] + [f"r{i}x{j}" for j in range(r.randint(0, 30))])))
    got = {x.doc_id: x for x in suffixes.without_repeats(table(spark, rows), report=True).collect()}
    for (i, _), (n, gone, text) in zip(rows, brute.repeats(rows), strict=True):
        assert (got[i].n_words, got[i].n_repeated, got[i].text) == (n, len(gone), text)


def test_repeats_of_odd_rows(spark, odd):
    rows = sorted({(r.doc_id if r.doc_id is not None else 1 << 62, r.text) for r in odd.collect()}, key=lambda x: (x[0], x[1] or ""))
    expected = {k: text for k, (_, _, text) in zip(rows, brute.repeats(rows), strict=True)}
    before = odd.withColumnRenamed("source", "old").withColumn("old", F.col("text"))
    got = suffixes.without_repeats(before)
    assert got.columns == before.columns and got.count() == odd.count()
    for r in got.collect():
        assert r.text == expected[r.doc_id if r.doc_id is not None else 1 << 62, r.old]


# ---- 5 URLs


def test_urls_of_odd_rows(spark, odd_dir):
    from histoloom.llm.url_filter import op5_url_filters

    got = {r.page_id: r for r in op5_url_filters(spark, odd_dir).collect()}
    assert len(got) == 13
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.com", "/en/71", "example.com/en/7", "allow")
    assert (got[1].rule, got[1].verdict) == ("com/en/", "block")
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in (2, 3, 12)] == [("", "", None, "allow")] * 3
    assert got[4].verdict == "block" and (got[5].host, got[5].rule) == ("net", "net/de/")
    assert (got[6].rule, got[6].verdict, got[7].rule) == ("example.net/de/8", "block", "net/de/")
    assert (got[8].path, got[8].verdict, got[9].path, got[9].rule) == ("", "allow", "/es/a://b", "org/es/")
    assert got[11].rule is None


# ---- 6 sharding


def test_shards(spark, docs):
    got = sharding.op6_byte_shards(spark, SMALL).toPandas()
    size = {i: len(t.encode()) + 16 for i, t in zip(docs.doc_id, docs.text, strict=True)}
    assert got.set_index("doc_id")["size"].to_dict() == size and got.grown_shard.isna().all()
    assert got.set_index("doc_id").text_crc32.to_dict() == {i: zlib.crc32(t.encode()) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    before, total = 0, sum(size.values())
    for r in got.sort_values("doc_id").itertuples():
        assert r.shard == min(39, (2 * before + r.size) * 40 // (2 * total))
        before += r.size
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_shards_of_odd_rows(spark, odd):
    many = odd.unionByName(table(spark, [(77, "same")] * 50).withColumns({c: F.lit(None).cast(t) for c, t in odd.dtypes if c not in ("doc_id", "text")}))
    got = sharding.shard_by_bytes(many, 5, partitions=4).toPandas()
    assert len(got) == many.count() and set(got.shard) <= set(range(5))
    assert got[got.doc_id == 3]["size"].tolist() == [16] and got[got.doc_id == 3].text_crc32.isna().all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


# ---- 7, 8 tokens


def hf(text):
    return tokens.encoder(tokens.default_vocabulary())._tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_equals_the_defining_library():
    r = random.Random(7)
    parts = ["a", "'s", "'S", " ", "  ", "\n", "\t", "B9", "é", "!", "<|endoftext|>", "\u3000", "²", "漢", "\U0001f600", "\u0301", "don't", "\x00", "\x1c", "\u00a0"]
    e = tokens.encoder(tokens.default_vocabulary())
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert e.encode(text).tolist() == hf(text)


def test_token_counts(spark, docs):
    got = token_files.op7_separator_scan(spark, SMALL).toPandas()
    assert dict(zip(got.doc_id, got.n_tokens, strict=True)) == {i: len(hf(t)) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    assert len(got) == len(docs) and not got.duplicated(["file", "ordinal"]).any()


@pytest.mark.parametrize("size", [1, 3, 50])
def test_counts_across_blocks(spark, odd, size):
    rows = odd.where("doc_id IS NULL OR doc_id NOT IN (8, 9)")
    files = token_files.token_files(rows, block_tokens=size).cache()
    got = token_files.count_tokens(files.where("block IS NOT NULL")).toPandas()
    assert sorted(got.n_tokens) == sorted(len(hf(r.text or "")) for r in rows.collect()) and got.ended.all()
    assert sum(len(r["keys"]) for r in files.where("first IS NOT NULL").collect()) == rows.count()


def test_raw_files_and_a_loose_end(spark, tmp_path):
    ids = np.array([5, 6, 50256, 50256, 1, 2, 3, 50256, 9, 9], dtype="<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    for size in (1, 2, 3, 100):
        got = token_files.count_tokens(token_files.binary_blocks(spark, f"file://{tmp_path}/a.bin", block_tokens=size)).orderBy("ordinal").collect()
        assert [(r.n_tokens, r.ended) for r in got] == [(2, True), (0, True), (3, True), (2, False)]


def check_packing(got, texts, capacity=1024):
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()] and g.length.sum() <= capacity
    for i, g in got.groupby("doc_id"):
        ids = [*hf(texts[i] or ""), 2]
        g = g.sort_values("piece")
        assert g.piece.tolist() == list(range(len(g))) and g.start.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()] and g.length.sum() == len(ids)
        assert (g.length.iloc[1:] == capacity).all() and (len(g) == 1) == (len(ids) <= capacity)
        for r in g.itertuples():
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32


def test_packing(spark, docs):
    got = packing.op8_bound_certified(spark, SMALL).toPandas()
    check_packing(got, dict(zip(docs.doc_id, docs.text, strict=True)))
    assert got.sequence_id.nunique() <= packing.lower_bound(got.length.to_numpy(), 1024) * 1.02 + 1


def test_exchange_between_parts_saves_bins(spark):
    lengths = [600] * 50 + [424] * 50 + [300] * 30
    rows = [(i, 0, n, (0 if n == 600 else 1) << 32) for i, n in enumerate(lengths)]
    pieces = table(spark, rows, "doc_id long, piece int, length long, part long")
    got = packing.pack(pieces).toPandas()
    assert len(got) == len(rows) and got.sequence_id.nunique() == packing.lower_bound(np.array(lengths), 1024) == 60
    assert (got.groupby("sequence_id").length.sum() <= 1024).all()


def test_bounds_hold_for_any_lengths():
    r = np.random.default_rng(3)
    for _ in range(40):
        lengths = r.integers(1, 1025, r.integers(1, 60))
        bins, offsets, free = packing.best_fit_decreasing(lengths, 1024)
        used = np.bincount(bins, weights=lengths)
        assert (used <= 1024).all() and (1024 - used == free).all() and packing.lower_bound(lengths, 1024) <= len(free)


def test_packing_of_odd_rows(spark, odd):
    rows = odd.where("doc_id IS NOT NULL AND doc_id NOT IN (13, 15)")
    check_packing(packing.pack_documents(rows).toPandas(), {r.doc_id: r.text for r in rows.collect()})
    assert packing.pack_documents(odd).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()


# ---- 9 quality


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    got = quality.op9_nb_svm(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(got) > 500 and (got.predicted == got.quality).mean() > 0.97 and got.score.between(0, 1).all()
    assert ((got.score >= 0.7) == (got.predicted == 1)).all()
    clean = got[got.quality == 1]
    assert (clean.predicted == 1).mean() > 0.98


def test_quality_of_odd_rows(spark, odd, odd_dir):
    got = quality.op9_nb_svm(spark, odd_dir).toPandas()
    assert len(got) == odd.count() and got.score.between(0, 1).all() and got.predicted.isin([0, 1]).all()
    model = quality.fit([quality.packed(np.array([1, 2]))] * 10 + [quality.packed(np.array([3]))] * 10, np.array([1] * 10 + [0] * 10))
    assert model.score(np.array([1, 2])) > 0.6 > 0.4 > model.score(np.array([3]))
    assert quality.score(odd, model).columns == [c for c in odd.columns if c != "score"] + ["score"]


def test_samples_are_bounded(spark):
    rows = spark.range(10_000).withColumnRenamed("id", "k")
    assert 800 <= sampling.bounded(rows, "k", 1000).count() <= 1200
    assert sampling.bounded(rows.withColumn("k", F.lit(3)), "k", 1000).count() <= 1200
    assert sampling.bounded(rows.limit(10), "k", 1000).count() == 10


# ---- 10 decontamination


def test_leaks(spark, docs):
    got = decontaminate.op10_suffix_automaton(spark, SMALL).toPandas().set_index("doc_id")
    items = pd.read_parquet(f"{SMALL}/benchmark.parquet")
    for i, (n, hit, which) in zip(docs.doc_id, brute.leaks(docs.text, list(zip(items.item_id, items.text, strict=True))), strict=True):
        row = got.loc[i]
        assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (n, len(hit), len(which), bool(hit))
        assert row.items_sha256 == hashlib.sha256(",".join(sorted(which)).encode()).hexdigest()


def test_random_leaks_in_one_and_many_blocks(spark):
    r = random.Random(5)
    word = lambda: r.choice("abc")
    items = [(i, " ".join(word() for _ in range(r.randint(0, 14)))) for i in range(12)]
    texts = [" ".join(word() for _ in range(r.randint(0, 60))) for _ in range(60)]
    expected = brute.leaks(texts, items)
    docs, bench = table(spark, list(enumerate(texts))), table(spark, items, "item_id long, text string")
    for block in (1 << 20, 60):
        got = {x.doc_id: x for x in decontaminate.find_leaks(docs, bench, ["doc_id"], block_bytes=block).collect()}
        for i, (n, hit, which) in enumerate(expected):
            assert got[i].n_words == n and {q for s in got[i].spans for q in range(s.start, s.end)} == hit and got[i]["items"] == sorted(which)


def test_leaks_of_odd_rows(spark, odd, odd_dir):
    bench = spark.read.parquet(f"{odd_dir}/benchmark.parquet")
    cut = decontaminate.decontaminate(odd, bench)
    assert cut.columns == odd.columns
    left = {r.doc_id: r.text for r in cut.collect()}
    assert 6 not in left and 7 not in left  # nothing but an item
    assert left[3] is None and left[4] == "" and left[1].startswith("The quick") and not left[13].startswith("shared1 ")
    assert decontaminate.decontaminate(odd, bench.limit(0)).count() == odd.count()
    assert decontaminate.find_leaks(cut, bench, ["doc_id"]).where("size(spans) > 0").count() == 0


def items_of_documents(seed):
    """Documents, and items that overlap in them, so that the blocks of small ``block_bytes`` hit the same words."""
    r = random.Random(seed)
    texts = [" ".join(f"w{r.randint(0, 400)}" for _ in range(r.randint(20, 60))) for _ in range(40)]
    items = []
    for t in texts[:25]:
        w = t.split()
        for _ in range(r.randint(1, 5)):
            n, a = r.randint(10, 18), r.randrange(len(w) - 9)
            items.append((len(items), " ".join(w[a : a + n])))
    return texts, items


def test_cuts_don_t_depend_on_blocks(spark):
    texts, items = items_of_documents(3)
    expected = {}
    for i, (n, hit, _) in enumerate(brute.leaks(texts, items)):
        if len(hit) <= 0.8 * n:
            expected[i] = [w for q, w in enumerate(texts[i].split()) if q not in hit]
    bench = table(spark, items, "item_id long, text string")
    for block in (1 << 20, 1500):
        cut = decontaminate.decontaminate(table(spark, list(enumerate(texts))), bench, block_bytes=block)
        assert {x.doc_id: x.text.split() for x in cut.collect()} == expected


def test_cuts_of_odd_rows_in_many_blocks(spark, odd, odd_dir):
    bench = spark.read.parquet(f"file://{odd_dir}/benchmark.parquet")
    one, many = (decontaminate.decontaminate(odd, bench, block_bytes=n) for n in (1 << 20, 40))
    assert one.schema == many.schema and sorted(map(repr, one.collect())) == sorted(map(repr, many.collect()))


def test_leaks_of_null_repeated_and_shared_keys_in_many_blocks(spark):
    texts, items = items_of_documents(8)
    keys = [None, None, 1, 1, 1, *range(2, len(texts) - 3)]
    rows = [*zip(keys, texts, strict=True), (1, texts[2]), (None, texts[0]), (None, None)]
    expected = sorted(repr((i, n, sorted(hit), sorted(which))) for (i, _), (n, hit, which) in zip(rows, brute.leaks([t for _, t in rows], items), strict=True))
    bench = table(spark, items, "item_id long, text string")
    for block in (1 << 20, 1500):
        got = decontaminate.find_leaks(table(spark, rows).repartition(3), bench, ["doc_id"], block_bytes=block).collect()
        assert sorted(repr((x.doc_id, x.n_words, [q for s in x.spans for q in range(s.start, s.end)], x["items"])) for x in got) == expected


# ---- all


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_empty_tables(spark, empty_dir, name):
    assert catalog.queries()[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, odd_dir, name):
    from compare import duck, rows

    connection = duck(SMALL)
    ours = catalog.queries()[name](spark, SMALL).toPandas()
    assert rows(ours) == rows(connection.execute(catalog.oracle_sql()[name]).df())
