"""The pipeline on rows that real tables hold: nulls, repeats, empty and very long texts, extra columns."""

import random

import pytest

import corpus_pipeline as p

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, digest string, size long, `node` string"


def prose(rng, n=60):
    return " ".join(rng.choice(["clean", "plain", "words", "that", "nobody", "minds", "reading", "twice", "over"]) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    texts = [prose(rng) for _ in range(40)]
    leak = prose(rng, 14)
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(100, None, None, None), (101, "", "en", "s0"), (None, prose(rng), None, "s1"), (103, prose(rng), "de", None), (104, texts[0], "en", "s0"), (0, texts[0], "en", "s0")]
    rows += [(105, prose(rng, 30) + " " + leak.upper() + " " + prose(rng, 30), "en", "s1"), (106, " ".join(prose(rng, 50) for _ in range(400)), "en", "s2"), (107, "###$$$ " * 60, "en", "s2")]
    root = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(*r, None, 3, None, "d", 9, "n") for r in rows], COLUMNS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages_on_odd_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    frame, seen = docs, []
    for _, stage in p.STAGES[:-1]:
        frame = stage(spark, frame, folder)
        assert frame.columns == docs.columns
        seen.append({r.doc_id for r in frame.collect()})
        assert frame.where("digest <> 'd' or node <> 'n' or size <> 9 or n_words <> 3").count() == 0
    assert {100, 101, 107}.isdisjoint(seen[0]) and {None, 103, 106, *range(40)} <= seen[0]
    assert 104 not in seen[1] and 0 in seen[1]
    assert 105 in seen[1] and 105 not in seen[2] and {None, 103, 106} <= seen[2]
    out = p.run(spark, folder)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 40


def test_stages_on_an_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
