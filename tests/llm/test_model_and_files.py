"""LM scoring, chat formatting, sharding, token files and the pipeline."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, lmscore, registry, shards, tokenfiles
from tessera.llm.shared import work_dir
from tests.conftest import SF


def lm_tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), ""]


@pytest.mark.parametrize("segment_bytes", [320 << 20, 2000])
def test_scores_match_exact_counts(spark, segment_bytes):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(40)]
    rows = [(i, None if i == 3 else " ".join(rng.choice(vocab[: rng.randint(1, 40)]) for _ in range(rng.randint(0, 60))), 0.5) for i in range(120)] + [(None, "W1 w2", 0.1), (7, "unseen words", 0.2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, score double").withColumn("held", lmscore.held_out()).withColumn("__lm", F.lit(0.5))
    model = lmscore.train(table.where("not held"))
    got = lmscore.score(table, model, segment_bytes=segment_bytes).collect()
    assert len(got) == len(rows)
    uni, pair = Counter(), Counter()
    for r in got:
        assert r.held == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 7 == 2)
        if not r.held:
            t = lm_tokens(r.text)
            uni.update(t)
            pair.update(zip(["<s>", *t], t))
    n, v = sum(uni.values()), len(uni)
    least = lambda c: 2 ** (c.bit_length() - 1) if c else 0
    off = 0
    for r in got:
        t = lm_tokens(r.text)
        assert (r.n_tokens, r.n_known, r.train_tokens, r["__lm"]) == (len(t), sum(uni[w] > 0 for w in t), n, 0.5)
        assert r.base_score == pytest.approx(sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t))
        total = 0.0
        for a, w in zip(["<s>", *t], t):
            before = uni[""] if a == "<s>" else uni[a]
            total += math.log10((least(pair[(a, w)]) + lmscore.MU * (uni[w] + 1) / (n + v + 1)) / (before + lmscore.MU))
        # A filter's false positives raise counts, never lower them.
        assert r.score >= total - 1e-6
        off += r.score > total + 1e-6
        assert r.score <= total + 0.02 * abs(total) + 1
    assert off <= 0.5 * len(got)


def test_probabilities_after_a_history_sum_to_one_at_most(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choice(vocab[: rng.choice([3, 10, 50])]) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    model = lmscore.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    _, segment = next(lmscore.segments(model))
    counts = Counter(w for t in texts for w in lm_tokens(t))
    n, v = sum(counts.values()), len(counts)
    pairs = Counter(p for t in texts for p in zip(lm_tokens(t), lm_tokens(t)[1:]))
    names = [w for w in vocab if counts[w]] + [""]
    words = [lmscore.tokens(w.encode())[0] for w in names[:-1]] + [lmscore._END]
    assert len(words) == v
    for name, h in zip(names[:-1], words):
        after = np.array([[h, w] for w in words])
        levels = segment.levels(np.array([lmscore.bigrams(p)[1] for p in after]))
        known = segment.exact(after.reshape(-1))
        logs = lmscore.log10_probabilities(known, np.repeat(levels, 2), np.zeros(1, np.int64), n, v)[1::2]
        # What the filter's false positives add is a fraction of a word's count.
        assert 0.5 < (10**logs).sum() <= 1 + 2 / (counts[name] + lmscore.MU) and logs.max() < 0
        exact = np.array([pairs[(name, w)].bit_length() for w in names])
        logs = lmscore.log10_probabilities(known, np.repeat(exact, 2), np.zeros(1, np.int64), n, v)[1::2]
        assert 0.5 < (10**logs).sum() <= 1 + 1e-12


def test_packed_counts_round_trip():
    rng = np.random.default_rng(3)
    for top in (1, 300, 1 << 62):
        low = np.unique(rng.integers(0, top, 500)).astype(np.uint64)
        counts = rng.integers(1, 1 << rng.integers(1, 40), len(low))
        a, b = lmscore.unpack(lmscore.pack(low, counts))
        assert (a == low).all() and (b == counts).all()


def test_scores_without_training_or_rows(spark):
    table = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lmscore.score(table, lmscore.train(table.limit(0))).collect()
    assert [(r.n_tokens, r.n_known, r.base_score) for r in got] == [(3, 0, 0.0), (1, 0, 0.0)]
    assert lmscore.score(table.limit(0), lmscore.train(table)).count() == 0


def test_model_of_one_segment_writes_no_files_and_rows_go_to_few(spark, tmp_path):
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before, size = set(root.iterdir()), spark.conf.get("spark.sql.files.maxPartitionBytes")
    kept = set(spark.sparkContext._jsc.getPersistentRDDs())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert spark.read.parquet(f"{SF}/documents.parquet").rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
        lmscore.op5_lmscore(spark, SF).write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert set(root.iterdir()) == before
    assert len(list((tmp_path / "out").glob("part-*"))) <= spark.sparkContext.defaultParallelism
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= kept
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_model_of_several_segments_is_written_once_and_not_kept_twice(spark):
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    model = lmscore.train(spark.read.parquet(f"{SF}/documents.parquet"))
    before = set(root.glob("lm-*"))
    found = list(lmscore.segments(model, 1 << 16))
    assert len(found) > 1 and len(set(root.glob("lm-*")) - before) == 1 and not model.is_cached
    _, whole = next(lmscore.segments(model))
    assert b"".join(s.data.tobytes() for _, s in found) == whole.data.tobytes()


def test_scoring_holds_one_run_of_texts_at_a_time(monkeypatch):
    monkeypatch.setattr(lmscore, "_CHUNK", 1000)
    monkeypatch.setattr(lmscore.F, "arrow_udf", lambda f, _: f)
    score = lmscore._score(SimpleNamespace(value=lmscore.Segment(0, 16, 4, [])), 10, 5, lmscore.MU)

    def peak(n):
        texts = pa.array([" ".join(f"w{i * j % 97}" for j in range(100)) for i in range(n)])
        tracemalloc.start()
        got = score(texts)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(got) == n and got.field("n_tokens").to_pylist() == [101] * n
        return most

    assert len(score(pa.array([], pa.string()))) == 0
    # Tokens of 2000 texts take 9 bytes each where they are kept until the last text: 1.8 MB.
    assert peak(2000) < peak(20) + 1_000_000


def test_held_out_texts_score_above_the_base(spark):
    row = lmscore.op5_lmscore(spark, SF).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert row[0] > row[1]


def test_filter_levels_never_fall_short():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2))
    counts = np.random.default_rng(2).integers(1, 5000, len(keys))
    row = {"bucket": 0, "bits": lmscore._filter(keys, counts), "hashes": b"", "counts": b""}
    segment = lmscore.Segment(0, 1, 0, [row])
    segment._bucket = lambda keys: np.zeros(len(keys), np.int64)
    found, want = segment.levels(keys).astype(int), lmscore.level_of(counts)
    assert (found >= want).all() and (found > want).mean() < 0.05


def test_escape_is_reversible():
    rng = random.Random(3)
    parts = ["[INST]", "[/INST]", "</s>", "<s>", "[:]", "\\", "[", "<", "x", "\n", "é", "INST]", "/s>"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(text)) == text and not chat.CONTROL.search(chat.escape(text))
        assert chat.parse_turns(chat.render(text, text) + chat.render("assistant", text)) == [(text, text), ("assistant", text)]


TURNS = [
    (1, 0, "system", "be [INST] nice"), (1, 1, "user", "hi\\"), (1, 2, "assistant", "yo </s>"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "assistant", "more"),
    (2, 0, "user", "no reply"), (None, 1, "assistant", "b"), (None, 0, None, "a"), (3, 7, "user", "x"), (3, 7, "user", "x"), (3, None, "assistant", "y" * 3000),
]


def test_chat_round_trip_and_examples(spark):
    table = spark.createDataFrame([(*t, 1) for t in TURNS], "conv_id long, turn long, role string, text string, seq int")
    found = chat.examples(table)
    got = {r.conv_id: r for r in chat.digests(found).collect()}
    by = {}
    for t in sorted(TURNS, key=lambda t: (t[0] or -1, t[1] if t[1] is not None else -1)):
        by.setdefault(t[0], []).append((t[2] or "", t[3] or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        loss = "".join(text for role, text in turns if role == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].loss_chars == len(loss)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[conv].formatted_chars == sum(len(chat.render(r, t)) for r, t in turns)
    rows = found.collect()
    whole = {(r.conv_id, r.example): (r.context, r.target) for r in rows if r.example is not None}
    want = {}
    for conv, turns in by.items():
        replies = [i for i, t in enumerate(turns) if t[0] == "assistant"]
        want |= {(conv, k): ("".join(chat.render(*t) for t in turns[:i]) + chat.REPLY, chat.escape(turns[i][1])) for k, i in enumerate(replies)}
    assert whole == want and len(whole) == sum(t[2] == "assistant" for t in TURNS)
    assert whole[(1, 1)][0] == "[INST]system[:]be [\\INST] nice[INST]user[:]hi\\\\[/INST]yo <\\/s></s>[INST]user[:][/INST]"
    assert sorted(r.conv_id for r in rows if r.example is None) == [2, 3] and all(r.target is None for r in rows if r.example is None)
    assert all((r.target_start, r.target_end) == (len(r.context), len(r.context) + len(r.target)) for r in rows if r.example is not None)
    assert chat.digests(chat.examples(table.limit(0))).count() == 0


def test_a_wrong_context_is_seen(spark):
    found = chat.examples(spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string"))
    broken = found.withColumn("context", F.when(F.col("example") == 1, F.concat(F.lit("[INST]"), F.col("context"))).otherwise(F.col("context")))
    with pytest.raises(Exception, match="does not begin with"):
        chat.digests(broken).collect()


def test_op6_expands_every_reply(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    found = chat.examples(turns)
    assert found.where("target is not null").count() == turns.where("role = 'assistant'").count()


def test_shards_merge_by_tiers_and_keep_all_rows(spark):
    table = spark.range(3000).withColumn("text", F.repeat(F.sha2(F.col("id").cast("string"), 256), 3)).withColumn("none", F.lit(None).cast("int"))
    store = shards.ShardStore(spark, work_dir(spark, "shards"), target=300_000, smallest=20_000, fanout=3)
    for k in range(4):
        store.append(table.where(f"id % 4 = {k}"), rows_per_shard=150)
    before = store.manifest()
    store.append(table.limit(0))
    after = store.compact()
    assert len(after["shards"]) < len(before["shards"]) / 2 and after["version"] > before["version"]
    assert sum(s["rows"] for s in after["shards"]) == 3000 and max(s["bytes"] for s in after["shards"]) < 450_000
    tiers = Counter(store.tier(s["bytes"]) for s in after["shards"] if s["bytes"] <= store.target // 2)
    assert all(n < 2 * store.fanout for n in tiers.values())
    assert store.read().exceptAll(table).count() == 0 and store.read().count() == 3000 and store.read().columns == table.columns
    assert store.read(before["version"]).count() == 3000 and store.versions()[0] == 1
    assert store.vacuum() > 0 and store.read().count() == 3000 and len(store.versions()) == 1


def test_a_lost_race_is_seen(spark):
    store = shards.ShardStore(spark, work_dir(spark, "shards"))
    store.append(spark.range(5))
    with pytest.raises(shards.Conflict):
        store._commit({"version": 0, "schema": None, "shards": []}, None, [], [])
    assert store.read().count() == 5 and store.append(spark.range(2))["version"] == 2
    with pytest.raises(ValueError):
        shards.ShardStore(spark, work_dir(spark, "shards")).read()


def test_an_arrival_of_another_schema_is_refused(spark):
    store = shards.ShardStore(spark, work_dir(spark, "shards"))
    store.append(spark.createDataFrame([(1, "x")], "id long, a string"))
    for other in ("id long, a string, extra int", "id int, a string", "a string, id long", "id long"):
        with pytest.raises(shards.SchemaMismatch):
            store.append(spark.createDataFrame([], other))
    assert store.append(spark.createDataFrame([(None, None)], "id long, a string"))["version"] == 2 and store.read().count() == 2


def test_snapshots_and_changes_give_every_version(spark, monkeypatch):
    monkeypatch.setattr(shards, "SNAPSHOT_EVERY", 3)
    store = shards.ShardStore(spark, work_dir(spark, "shards"), target=10_000, smallest=500, fanout=3)
    for k in range(7):
        store.append(spark.range(k * 10, k * 10 + 10).coalesce(1))
    assert store._manifests(".snapshot") == [3, 6] and all(len(store._load(f"{v:010d}.json")["add"]) == 1 for v in range(1, 8))
    assert [store.read(v).count() for v in (1, 2, 3, 5, 7)] == [10, 20, 30, 50, 70]
    last = store.compact()["version"]
    spark.range(3).coalesce(1).write.parquet(f"{store.root}/data/lost")
    assert store.vacuum(keep=2) == 0 and store.vacuum(keep=2, orphan_seconds=-60) == 1 and store.versions() == [last - 1, last]
    assert store.read().count() == store.read(last - 1).count() == 70 and store.vacuum() >= 7 and store.versions() == [last]
    assert store.read().count() == 70 and store.append(spark.range(5))["version"] == last + 1
    with pytest.raises(ValueError):
        store.read(1)


@pytest.fixture(scope="module")
def encoder():
    pytest.importorskip("public_tokenizers")
    return tokenfiles.ChunkEncoder(tokenfiles.default_tokenizer(), cache=200)


def test_chunks_encode_as_the_library(encoder):
    rng = random.Random(5)
    texts = ["", " ", "  a  b", "a <|endoftext|> b<|endoftext|>", "it's 'll  x", "\n a\tb \x85c", "x 　 y", "w " * 300, *["".join(rng.choice(" abé1.'\n  \tZ日") for _ in range(rng.randint(1, 40))) for _ in range(300)]]
    assert encoder.apart
    for text in texts:
        assert np.frombuffer(encoder.encode(text), encoder.kind).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark, encoder):
    rows = [(5, "five five"), (None, "no id"), (2, None), (2, "two"), (2, "two"), (9, "<|endoftext|>"), (-4, "x " * 2000)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    root = tokenfiles.write_tokens(table, tokenfiles.default_tokenizer())
    got = sorted(tokenfiles.read_tokens(spark, root, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, -4, 2, 2, 2, 5, 9]
    at, texts = 0, {(i, tuple(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t in rows}
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids)) and (r.doc_id, tuple(r.ids)) in texts
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    none = tokenfiles.write_tokens(table.limit(0), tokenfiles.default_tokenizer())
    assert tokenfiles.read_tokens(spark, none).count() == 0


def test_op10_in_order(spark, encoder):
    rows = sorted(tokenfiles.op10_tokenfiles(spark, SF).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))


def test_sql_agrees(spark):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    for name, sql in registry.ORACLE_SQL.items():
        want = con.sql(sql)
        columns = sorted(want.columns)
        rows = lambda table, at: sorted(repr(tuple(r[at.index(c)] for c in columns)) for r in table)
        frame = registry.QUERIES[name](spark, SF)
        assert sorted(frame.columns) == columns, name
        assert rows(frame.collect(), frame.columns) == rows(want.fetchall(), want.columns), name


def test_pipeline_stages_match_brute_force(spark, encoder):
    import corpus_pipeline as p
    from tests.llm.test_graph_and_mix import brute_groups
    from tests.llm.test_text_ops import brute_fences, brute_hits, brute_metrics

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for _, stage in p.STAGES:
        out = stage(spark, frames[-1], SF)
        path = work_dir(spark, "stage")
        out.write.parquet(path)
        frames.append(spark.read.parquet(path))
    assert all(f.columns == columns for f in frames[:-1])
    texts = [{r.doc_id: r.text for r in f.collect()} for f in frames[:-1]]
    rows = {r.doc_id: (r.lang, r.source, brute_metrics(r.text)) for r in docs.collect()}
    limits = brute_fences(rows.values())

    def passes(lang, source, m):
        n, chars, symbols, dups, lines, rep = m
        ratios = (symbols / max(chars, 1), dups / max(lines, 1), rep / max(n, 1), chars / max(n, 1))
        return n >= 20 and 100 * rep <= 30 * n and all(a <= b for a, b in zip(ratios, limits[(lang, source)]))

    want = {i for i, row in rows.items() if passes(*row)}
    assert set(texts[1]) == want and len(want) < len([r for r in rows.values() if r[2][0] >= 20])
    groups = brute_groups(texts[1])
    assert set(texts[2]) == {c for c, _ in groups.values()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(texts[3]) == {i for i, t in texts[2].items() if not brute_hits(t, bench)[1]}
    copies = Counter(r.doc_id for r in frames[4].collect())
    assert set(copies) <= set(texts[3]) and max(copies.values()) <= 2
    assert Counter(r.doc_id for r in frames[5].collect()) == copies
    ids = {i: encoder.tokenizer.encode(t, add_special_tokens=False).ids + [0] for i, t in texts[4].items()}
    assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes()) for r in frames[5].collect())
    assert p.run(spark, SF).count() == sum(copies.values())
