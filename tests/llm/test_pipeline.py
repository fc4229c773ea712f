"""Each stage of the pipeline, on what its predecessor kept, against brute force."""

from collections import Counter

import pyarrow as pa
import pytest
from conftest import SF_DIR
from test_llm import near, texts_of

import corpus_pipeline
from cartulary.llm import mixing, piece_codec, quality, secret_scan

SMALL = SF_DIR.replace("sf0.01", "sf0.001")


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    frames = [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, frames[-1], SMALL).write.parquet(out)
        frames.append(spark.read.parquet(out))
    return frames


def test_quality(spark, kept):
    model = quality.train(kept[0], spark.read.parquet(f"{SMALL}/labels.parquet"))
    want = {i for i, t in texts_of(kept[0]) if model.score(quality.features(pa.array([t])))[0] >= 0.3}
    assert {i for i, _ in texts_of(kept[1])} == want and kept[1].columns == kept[0].columns
    assert 0.7 < len(want) / kept[0].count() < 1


def test_near_duplicates(kept):
    want = sorted(i for i in (eval(r)[0] for r in near(texts_of(kept[1]), 5) if r.endswith("True)")))
    assert sorted(i for i, _ in texts_of(kept[2])) == want and len(want) < kept[1].count()


def test_near_duplicates_of_repeated_ids(spark):
    words = [f"word{k}" for k in range(200)]
    one, near_one, two, three = " ".join(words[:90]), " ".join(words[:89]), " ".join(words[90:140]), " ".join(words[140:])
    rows = [(5, one), (5, one), (6, two), (7, near_one), (7, three), (8, ""), (8, ""), (8, None), (None, two), (None, two)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(5, one), (6, two), (7, three), (8, ""), (8, None), (None, two), (None, two)])


def test_secrets(kept):
    model = secret_scan.train(kept[2])
    clean = dict(texts_of(kept[3]))
    for i, text in texts_of(kept[2]):
        spans = secret_scan.find_spans(text, model)
        assert all(text[a:b] not in clean[i] for a, _, b in spans)
        assert (clean[i] == text) == (not spans)
    assert all(r.n_chars == len(r.text) for r in kept[3].collect())


def test_mix(kept):
    want = Counter()
    for r in mixing.mix(kept[3], depth=6).collect():
        want[r.doc_id] = round(r.taken / r.size + 1e-9) if r.size else 0
    assert Counter(i for i, _ in texts_of(kept[4])) == +want and kept[4].columns == kept[0].columns


def test_encoding(kept):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_codec.MODEL)
    texts = dict(texts_of(kept[4]))
    rows = kept[5].collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts_of(kept[4]))
    assert all(r.token_ids == model.encode(texts[r.doc_id]) for r in rows)


def test_run(spark, kept):
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()) == sorted(r.doc_id for r in kept[5].collect())
