"""Decontamination, quality rules, token counts and textscan against plain Python."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, quality, textscan, tokencounts
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_words string, kept int, __metrics int"


def docs(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i if i != 3 else None, t, None if i % 5 == 0 else "en", "s" if i % 2 else None, "clash", 7, 1) for i, t in enumerate(texts)], schema)


def random_texts(seed=1, n=60):
    rng = random.Random(seed)
    words = ["the", "Of", "café", "x1", "ab", "zq", "#$", "日本", "a.b"]
    out = [rng.choice([" ", "\n", "\t", "  "]).join(rng.choice(words) for _ in range(rng.randint(0, 90))) for _ in range(n)]
    return [None, "", "   \n\t", "one", *out, " ".join(["word"] * 3000), "x" * 5000, out[0], out[0]]


def test_scan_splits_like_the_rules():
    for text in filter(None, random_texts()):
        raw = text.encode()
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        got, starts, ends, _ = textscan.scan(raw, textscan.ALNUM)
        assert [got[a:b].decode() for a, b in zip(starts, ends)] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        got, starts, ends, hashes = textscan.scan(raw, textscan.SPACED)
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        assert [got[a:b].decode() for a, b in zip(starts, ends)] == words
        assert len(set(hashes.tolist())) == len(set(words))


def test_scan_in_pieces(monkeypatch):
    raw = ("abc de  f\n" * 500 + "long" * 100).encode()
    whole = textscan.scan(raw, textscan.SPACED)
    monkeypatch.setattr(textscan, "_PIECE", 64)
    cut = textscan.scan(raw, textscan.SPACED)
    assert all((a == b).all() for a, b in zip(whole[1:], cut[1:]))


def brute_hits(text, items, n=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    w, hit, found = words(text), set(), set()
    for item_id, item in items:
        v = words(item)
        k = min(n, len(v))
        if not k:
            continue
        grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)}
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                found.add(item_id)
    return len(w), len(hit), found - {None}


@pytest.mark.parametrize("block_bytes", [64 << 20, 2000])
def test_contamination_matches_brute_force(spark, block_bytes):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 10, 14])))) for i in range(25)] + [(7, "w1 w2 w3"), (99, None), (None, "w0 w1")]
    texts = [None, "", "!!"] + [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 80))) for _ in range(40)] + [items[4][1].upper() or "w"] * 2
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(table, bench, block_bytes=block_bytes).collect()
    assert len(got) == len(texts)
    for r in got:
        n, hit, found = brute_hits(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, set(r["items"]), r.contaminated) == (n, hit, found, hit > 0)
    clean = decontaminate.decontaminate(table, bench)
    assert clean.columns == table.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in got if not r.contaminated}
    spans = decontaminate.decontaminate(table, bench, mode="spans").collect()
    assert len(spans) == len(texts)
    left = {r.doc_id: r.text for r in spans}
    for r in got:
        assert left[r.doc_id] == texts[r.doc_id] or r.contaminated
        assert r.contaminated is False or len(left[r.doc_id]) < len(texts[r.doc_id])


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    table = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontaminate.find_contamination(table, none).first().contaminated is False
    assert decontaminate.find_contamination(table.limit(0), none).count() == 0


def test_blocks_hold_any_benchmark(spark):
    """Many copies of one item, ids of text, items beyond a block, and one window beyond a block."""
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    long, copied, wide = " ".join(rng.choice(vocab) for _ in range(300)), " ".join(rng.choice(vocab) for _ in range(20)), "y" * 9000 + " z"
    items = [("long-1", long), ("wide", wide), ("mmlu-1", "the first ten words of an item that is quite long"), *[("copy", copied)] * 100, *[(f"c{i}", copied) for i in range(5)]]
    words = long.split()
    texts = [" ".join(words[k : k + 12]) for k in range(0, 280, 20)] + [" ".join(words[k : k + 9]) for k in (0, 100)] + [copied, wide.upper(), "x " + items[2][1], None]
    table = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, __scan string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for block_bytes in (64 << 20, 8000):
        pieces = decontaminate._pieces(bench, "item_id", "text", decontaminate.N, block_bytes)
        blocks = list(decontaminate._blocks(pieces, block_bytes))
        assert sum(map(len, blocks)) == pieces.count() and (len(blocks) > 2) == (block_bytes == 8000)
        for block in blocks:
            cost = sum(len(t) - t.count(b" ") + decontaminate._PER_WORD * len(t.split()) + decontaminate._PER_PIECE for _, t in block)
            assert cost <= block_bytes or len(block) == 1
        got = decontaminate.find_contamination(table, bench, block_bytes=block_bytes).collect()
        assert len(got) == len(texts)
        for r in got:
            n, hit, found = brute_hits(texts[r.doc_id], items)
            assert (r.n_words, r.n_hit, set(r["items"]), r["items"], r["__scan"]) == (n, hit, found, sorted(found), "mine")


def test_window_set_stays_within_its_cost():
    rng = random.Random(8)
    pieces = [(i, " ".join(rng.choice(["alpha", "be", "gamma", "x"]) + str(rng.randrange(5000)) for _ in range(400)).encode()) for i in range(200)]
    built = decontaminate.WindowSet(pieces, 10)
    size = len(built.text) + sum(a.nbytes for arrays in built.by_length.values() for a in arrays)
    cost = sum(len(t) - t.count(b" ") + decontaminate._PER_WORD * 400 + decontaminate._PER_PIECE for _, t in pieces)
    assert size <= 1.3 * cost


def test_windows_that_share_a_hash_are_told_apart(monkeypatch):
    windows = textscan.windows
    monkeypatch.setattr(textscan, "windows", lambda h, n: windows(h, n) * 0)
    built = decontaminate.WindowSet([(1, b"a b"), (2, b"c d"), (3, b"a b"), (3, b"e f g")], 2)
    assert [built.ids[i] for i in built.probe(b"x A, b y")[2]] == [1, 3] and built.probe(b"c d")[1] == [(0, 2)]
    assert built.probe(b"a d")[1] == [] and [built.ids[i] for i in built.probe(b"f g")[2]] == [3]


def test_regular_words_do_not_meet():
    """Thue-Morse words and their complements meet under any power-of-two polynomial hash."""
    word = b"a"
    while len(word) < 8192:
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
        other = word.translate(bytes.maketrans(b"ab", b"ba"))
        assert textscan.scan(word + b" " + other, textscan.SPACED)[3].tolist()[0] != textscan.scan(other, textscan.SPACED)[3].tolist()[0]


def brute_metrics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(grams)
    hit = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(lines), len(hit)


def test_metrics_match_brute_force():
    for text in random_texts(7):
        assert quality.measure((text or "").encode()) == brute_metrics(text)
    rng = random.Random(1)
    long = " ".join(rng.choice("abcdefg") + str(rng.randrange(9)) + rng.choice(["", "", "\n"]) for _ in range(60_000))
    assert quality.measure(long.encode()) == brute_metrics(long)


def test_quality_verdicts(spark):
    rng = random.Random(5)
    vocab = ["some", "ordinary", "words", "that", "make", "clean", "prose", "without", "noise", "here", "and", "there", "more", "of", "them"]
    good = [" ".join(rng.choice(vocab) for _ in range(120)) for _ in range(150)]
    noisy = [" ".join(rng.choice(vocab) + "###$$" for _ in range(120)) for _ in range(3)]
    table = docs(spark, [None, "", "few words"] + good + noisy)
    got = quality.judge(table).collect()
    assert len(got) == len(good) + 6
    kept = [r for r in got if r.kept]
    assert len(kept) == len(good)
    again = quality.keep(table)
    assert again.columns == table.columns and sorted(r.text for r in again.collect()) == sorted(good)
    assert quality.keep(table.limit(0)).count() == 0 and quality.judge(table.limit(0)).count() == 0


def brute_fences(rows):
    """(lang, source) to fences, from rows (lang, source, metrics in the order of ``_FIELDS``)."""
    ratios = {}
    for lang, source, (n, chars, symbols, dups, lines, rep) in rows:
        if n >= 20 and 100 * rep <= 30 * n:
            ratios.setdefault((lang, source), []).append((symbols / max(chars, 1), dups / max(lines, 1), rep / max(n, 1), chars / max(n, 1)))

    def quartiles(values):
        return [[sorted(v[k] for v in values)[max(0, -(-len(values) * q // 4) - 1)] for q in (1, 3)] for k in range(4)]

    out, every = {}, [v for vs in ratios.values() for v in vs]
    for (lang, source), own in ratios.items():
        near = [v for (x, _), vs in ratios.items() if x == lang for v in vs]
        of, q, r, e = lambda n, a, b: (n * a + 100 * b) / (n + 100), quartiles(own), quartiles(near), quartiles(every)
        fence = []
        for k, slack in enumerate(quality.RATIOS.values()):
            low, high = (of(len(own), q[k][i], of(len(near), r[k][i], e[k][i])) for i in (0, 1))
            fence.append(high + 6 * max(high - low, slack))
        out[(lang, source)] = fence
    return out


def test_fences_move_without_a_jump(spark):
    """A group's fences go from its language's to its own as it grows, a little with every document."""
    def fence(n):
        rows = [("en", "a", 100, 500, 0, 0, 10, 0)] * 900 + [("en", "tiny", 100, 900, 5, 0, 10, 0)] * n + [(None, None, 100, 500, 0, 0, 10, 0)]
        measured = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{f} long" for f in quality._FIELDS))
        got = {(r.lang, r.source): [r[f"max_{k}"] for k in quality.RATIOS] for r in quality.fences(measured).collect()}
        want = brute_fences([(r[0], r[1], r[2:]) for r in rows])
        assert set(got) == set(want) and all(got[g] == pytest.approx(want[g]) for g in got)
        return got[("en", "tiny")][3]

    near = [fence(n) for n in (1, 98, 99, 100, 101)]
    assert near == sorted(near) and near[0] < 8.1 < 9.9 < near[1] and near[4] - near[1] < 0.1


def test_clashing_names_keep_their_values(spark):
    good = " ".join(f"plain{i} words" for i in range(40))
    table = spark.createDataFrame([(i, good, "en", "s", 7, "f", False) for i in range(30)], "doc_id long, text string, lang string, source string, __metrics int, __fence_l string, kept boolean")
    kept = quality.keep(table)
    assert kept.columns == table.columns and {(r["__metrics"], r["__fence_l"], r["kept"]) for r in kept.collect()} == {(7, "f", False)} and kept.count() == 30
    judged = quality.judge(table).collect()
    assert {(r["__metrics"], r["__fence_l"], r["kept"]) for r in judged} == {(7, "f", True)}


@pytest.fixture(scope="module")
def counter():
    pytest.importorskip("public_tokenizers")
    return tokencounts.PrefixCounter(tokencounts.default_model())


def test_prefix_tables_match_the_library(counter):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokencounts.default_model())
    rng = random.Random(2)
    texts = ["", " ", "  a  b ", "<s> </s> <0x0A>", "x▁y ▁", "日本語 ½", "a" * 400, "ab\n\ncd\t e"] + ["".join(rng.choice(" abehlost.,\n▁é日!1") for _ in range(rng.randint(1, 50))) for _ in range(150)]
    for text in texts:
        assert [len(model.encode(text[:k])) for k in range(len(text) + 1)] == counter.table(text).tolist()


def test_token_counts_and_budgets(spark, counter):
    texts = [None, "", "Hello wide world", "Hello wide world", "é日本"]
    table = docs(spark, texts)
    got = tokencounts.prefix_counts(table, tokencounts.default_model())
    t = F.col("prefix_counts")
    rows = got.select("doc_id", "n_bytes", tokencounts.count_at(t, tokencounts.n_chars(t)).alias("n"), tokencounts.count_at(t, 5).alias("five"), tokencounts.longest_within(t, 2).alias("k")).collect()
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokencounts.default_model())
    for r, text in zip(rows, texts, strict=True):
        text = text or ""
        counts = [len(model.encode(text[:k])) for k in range(len(text) + 1)]
        assert (r.n, r.five, r.n_bytes) == (counts[-1], counts[min(5, len(text))], len(text.encode()))
        assert r.k == max(k for k, c in enumerate(counts) if c <= 2)
    assert tokencounts.prefix_counts(table.limit(0), tokencounts.default_model()).count() == 0


def test_op4_matches_the_library_on_the_table(spark, counter):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokencounts.default_model())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in tokencounts.op4_tokencounts(spark, SF).collect():
        n = len(model.encode(texts[r.doc_id] or ""))
        assert (r.n_tokens, r.over_limit, r.n_bytes) == (n, n > 4096, len((texts[r.doc_id] or "").encode()))


def test_op1_digest(spark):
    row = decontaminate.op1_decontaminate(spark, SF).where("n_items = 0").first()
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest()
