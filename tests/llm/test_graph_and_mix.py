"""Mixing, components, URL filter and the Jaccard join against plain Python."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard, mixing, urlfilter
from tessera.llm.components import components
from tests.conftest import SF


def fill(sizes, weights, share=1.5, cap=2.0):
    """Targets by repeated resharing, in exact fractions."""
    total = Fraction(share) * sum(sizes.values())
    full, target = {}, {}
    while True:
        rest = {s: w for s, w in weights.items() if s not in full}
        left = total - sum(full.values())
        target = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = [s for s in rest if target[s] > cap * sizes[s]]
        if not over:
            return {**target, **full}
        full |= {s: Fraction(cap) * sizes[s] for s in over}


def test_targets_match_resharing(spark):
    rng = random.Random(4)
    sizes = {f"s{i:02d}": rng.choice([3, 50, 400, 9000]) for i in range(9)} | {None: 77}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: Fraction((3, 1, 2)[i % 3]) for i, s in enumerate(order)}
    table = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    want = fill(sizes, weights)
    for r in mixing.source_targets(table).collect():
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]))


def words(n):
    return " ".join(["w"] * n)


def test_mix_takes_near_targets_and_agrees(spark):
    rng = random.Random(6)
    rows = [(i, words(rng.choice([0, 1, 5, 40, 200])), rng.choice(["a", "b", "c", None]), "x") for i in range(1500)] + [(None, words(9), "a", "x")] * 7 + [(5000, None, "b", "y")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, p string")
    size = {(r[0], r[2]): len((r[1] or "").split()) for r in rows}
    got = mixing.mix(table)
    assert got.columns == table.columns
    first, second = (sorted((r.doc_id or -1, r.source or "", len((r.text or "").split())) for r in got.collect()) for _ in range(2))
    assert first == second
    taken, copies = defaultdict(int), Counter()
    for r in got.collect():
        taken[r.source] += len((r.text or "").split())
        copies[(r.doc_id, r.source)] += 1
    assert max(v for (i, _), v in copies.items() if i is not None) <= 2 and copies[(None, "a")] <= 14
    sizes = mixing.source_targets(table.select("source", mixing.words(F.col("text")).alias("size")))
    for r in sizes.collect():
        assert abs(taken[r.source] - r.target) <= 200
    assert set(size) >= set(copies)
    assert mixing.mix(table.limit(0)).count() == 0


def test_expected_copies_are_equal(spark):
    """Over many sources with the same documents each position is taken about as often."""
    rows = [(s * 100 + i, f"s{s:03d}", [10, 20, 30, 40][i % 4]) for s in range(300) for i in range(8)]
    units = mixing.plan(spark.createDataFrame(rows, "doc_id long, source string, size long"), weights=(1,), share=0.5)
    mean = defaultdict(list)
    for r in units.collect():
        mean[r["size"]].append(r.whole + r.extra)
    for values in mean.values():
        assert abs(np.mean(values) - 0.5) < 0.1


def test_op2_covers_all_documents(spark):
    got = mixing.op2_mixing(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.where("taken > 2 * size or taken < 0").count() == 0
    nodes = got._jdf.queryExecution().toString()
    assert "Python" not in nodes and "Pandas" not in nodes


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_components_match_union_find(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(200)]
    table = spark.createDataFrame(edges + [(None, 1), (5, None), (9, 9)] + edges[:20], "a long, b long")
    want = union_find([e for e in edges if e[0] != e[1]])
    assert {r.node: r.label for r in components(table).collect()} == want
    assert components(table.limit(0)).count() == 0


PAGES = [
    (1, "http://a.net/x", None), (2, "https://EXAMPLE.net/en/y?q", ""), (3, "http://good.org/fr/1", '<link rel="canonical" href="http://a.net/x">'),
    (4, "http://plain.io/1#frag", '<html><LINK href="//bad.example.com/de/1" rel=canonical>'), (5, "http://plain.io/2", '<meta http-equiv="refresh" content="0; url=/1">'),
    (6, "http://plain.io/3", '<meta http-equiv="refresh" content="0; url=4?a=1&amp;b=2">'), (7, None, None), (8, "no scheme", '<link rel="canonical" href="http://a.net/x">'),
    (9, "http://net", None), (10, "http://xnet/", None), (11, "http://plain.io/4?a=1&b=2", ""), (11, "http://plain.io/4?a=1&b=2", ""), (12, "http://example.com:80/de/", None),
    (20, "HTTP://Plain.IO/20", '<link rel="nofollow Canonical" href="HTTP://Bad.NET">'), (21, "http://plain.io/20", None), (22, "http://plain.io/a/b?p=1", '<meta http-equiv=refresh content="0;url=?p=2">'),
    (23, "http://plain.io/a/b?p=2", '<link rel=canonical href="../x/./y/../z">'), (24, "http://plain.io/x/z#top", "<link rel='canonical' href='//bad.net/'>"), (25, "http://free.io", '<link rel="canonical-ish" href="http://a.net/x">'),
    (26, "http://free.io/", '<link rel=canonical href="#top">'), (27, "http://moved.io/old", None), (28, "http://free.io/c?u=http://x.net/", None),
]


@pytest.mark.parametrize("literal", [500, 0])
def test_url_filter(spark, monkeypatch, literal):
    monkeypatch.setattr(urlfilter, "MAX_LITERAL_RULES", literal)
    table = spark.createDataFrame([(*p, "host", 7) for p in PAGES], "page_id long, url string, html string, rule string, __r int")
    moved = spark.createDataFrame([("http://moved.io/old", "HTTP://Moved.io/./new"), ("http://moved.io/new", "/x/../newer"), ("http://moved.io/newer", "http://a.net/x"), (None, "x"), ("x", None)], "source string, target string")
    with_table = {r.page_id: r.verdict for r in urlfilter.filter_urls(table, redirects=moved).collect()}
    assert with_table[27] == "block" and with_table[26] == "allow" and {r["__r"] for r in urlfilter.filter_urls(table).collect()} == {7}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(table).collect()}
    assert urlfilter.filter_urls(table).count() == len(PAGES)
    assert got[1] == ("a.net", "/x", "net/", "block")
    assert got[2] == ("example.net", "/en/y", "example.net/en/", "allow")
    assert got[3] == ("good.org", "/fr/1", "org/fr/", "allow")
    assert got[4] == ("plain.io", "/1", None, "block")
    assert got[5] == ("plain.io", "/2", None, "block")
    assert got[6][3] == got[11][3] == "allow"
    assert got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow")
    assert got[9] == ("net", "", None, "allow") and got[10] == ("xnet", "/", None, "allow")
    assert got[12][2:] == (None, "allow")
    assert [got[i][3] for i in range(20, 29)] == ["block"] * 5 + ["allow"] * 4
    assert urlfilter.filter_urls(table.limit(0)).count() == 0


def test_url_sql_agrees_on_links(spark):
    """The given pages hold no links, so the SQL is held against the operator on those of this test."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("pages", pd.DataFrame(PAGES, columns=["page_id", "url", "html"]))
    want = sorted(map(str, con.sql(urlfilter.ORACLE).fetchall()))
    frame = urlfilter.filter_urls(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    assert sorted(str(tuple(r)) for r in frame.select("page_id", "host", "path", "rule", "verdict").collect()) == want


def test_mix_keeps_clashing_columns(spark):
    table = spark.createDataFrame([(i % 5, words(9), "a", 3, "u", 4) for i in range(20)], "doc_id long, text string, source string, __k int, __mix_u string, __n int")
    got = mixing.mix(table)
    assert got.columns == table.columns and {(r["__k"], r["__mix_u"], r["__n"]) for r in got.collect()} == {(3, "u", 4)}


def test_bands_reach_the_recall():
    bands, rows = jaccard.choose_bands(0.8, 0.9999, 200)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 200
    with pytest.raises(ValueError):
        jaccard.choose_bands(0.1, 0.9999, 10)


def brute_groups(texts, n=5):
    sets = {i: frozenset(jaccard.grams((t or "").encode(), n).tolist()) for i, t in texts.items()}
    links, edges = Counter(), []
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                edges.append((a, b))
    label = union_find(edges)
    return {i: (label.get(i, i), links[i]) for i in ids}


def near_texts(seed=11):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(500)]
    texts = {}
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([4, 30, 120]))]
        for _ in range(rng.choice([1, 2, 9, 40])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts[len(texts) * 3 + 1] = " ".join(copy)
    return texts | {0: None, 2: "", 5: "..."}


def test_a_chain_costs_what_its_links_do(spark):
    """Texts that each share half with the next are one chain of buckets; compared are neighbours only."""
    n, words = 400, [f"u{i}" for i in range(400 * 10 + 40)]
    texts = {i: " ".join(words[i * 10 : i * 10 + 40]) for i in range(n)}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    signed = jaccard.signatures(table, recall=0.9999)
    classes = jaccard.cut(signed.select(F.monotonically_increasing_id().alias("cls"), "bands", "n_grams"), "test")
    met = jaccard._met(classes)
    low = met.groupBy(F.col("cls").alias("c")).agg(F.min("hub").alias("low"))
    rows = met.join(low, F.col("cls") == F.col("c")).drop("c").join(classes.select("cls", "n_grams"), "cls")
    assert met.where("hub <> cls").count() > n / 4
    sizes = [r["count"] for r in jaccard._tiles(rows).groupBy(*jaccard._TILE).count().collect()]
    assert sum(k * k for k in sizes) < 30 * n and max(sizes) < 12
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_join(table).collect()}
    assert got == brute_groups(texts)


def test_a_crowd_is_compared_about_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 16)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    texts = {}
    for i in range(400):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            copy[rng.randrange(150)] = f"x{rng.randrange(40)}"
        texts[i] = " ".join(copy)
    table = spark.createDataFrame([(i, t, 5, 6, "s") for i, t in texts.items()], "doc_id long, text string, __t int, __n int, __stay string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_join(table).collect()} == brute_groups(texts)
    kept = jaccard.one_per_group(table).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for c, _ in brute_groups(texts).values()}) and all((r["__t"], r["__n"], r["__stay"]) == (5, 6, "s") for r in kept)
    tiles = []
    monkeypatch.setattr(jaccard, "_tiles", lambda rows, real=jaccard._tiles: (tiles.append(jaccard.cut(real(rows), "test")), tiles[0])[1])
    jaccard.jaccard_join(table).count()
    sizes = [r["count"] for r in tiles[0].groupBy(*jaccard._TILE).count().collect()]
    assert sum(k * k for k in sizes) < 4 * 400 * 400 and max(sizes) < 100


def test_pairs_are_counted_at_their_smallest_hub():
    hubs = [[1, 5, 9], [5, 9], [1, 9], [9]]
    want = lambda a, b, h: not any(x < h for x in set(hubs[a]) & set(hubs[b]))
    for h in (1, 5, 9):
        got = jaccard.counted_here(h, hubs)
        assert all(got[a, b] == want(a, b, h) for a in range(4) for b in range(4))


@pytest.mark.parametrize("block", [256, 8])
def test_jaccard_join_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", block)
    texts = near_texts()
    table = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, digest string")
    want = brute_groups(texts)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_join(table).collect()}
    assert got == want
    kept = jaccard.one_per_group(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _ in want.values()})


def test_jaccard_join_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    table = spark.createDataFrame([(None, text), (4, text), (4, text), (None, None), (9, "x y")], "doc_id long, text string")
    got = jaccard.jaccard_join(table).collect()
    assert sorted((r.doc_id or -1, r.class_id or -1, r.n_links, r.n_copies) for r in got) == [(-1, -1, 0, 1), (-1, 4, 2, 3), (4, 4, 2, 3), (4, 4, 2, 3), (9, 9, 0, 1)]
    assert jaccard.one_per_group(table).count() == 3
    assert jaccard.jaccard_join(table.limit(0)).count() == 0


def test_links_between_in_column_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(30)]
    monkeypatch.setattr(jaccard, "_COLUMNS", 7)
    got = jaccard.links_between(sets, Fraction(1, 2))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert got[i, j] == (i != j and 2 * len(set(a) & set(b)) >= len(set(a) | set(b)))


def test_sizes_are_counts_of_words(spark):
    texts = [None, "", " ", "a", " a ", "a b\x0bc\x0cd\r\ne", "\x00", "\x00 \x00a", "\t\t x", "\U0001f600 y", "$1 \\ x", "w w", "\x85 \x1c\xa0", "ab " * 200_000]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", mixing.words(F.col("text")).alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
