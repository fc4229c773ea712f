"""Scores, fingerprints, spans and samples recomputed by plain loops, and the stages of the pipeline on hard tables."""

import math
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from cartulary.llm import embedding_dedup, fingerprints, labelled, language_id, mixing, quality, rows, secret_scan, toxicity
from cartulary.llm.rows import documents

SMALL = SF_DIR.replace("sf0.01", "sf0.001")
WHOLE = (1 << 64) - 1


def mixed(x):
    x ^= x >> 32
    x = x * 0xD6E8FEB86659FD93 & WHOLE
    x ^= x >> 29
    x = x * 0xA0761D6478BD642F & WHOLE
    return x ^ (x >> 32)


def span_hash(data):
    return mixed((sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(data)) + len(data)) & WHOLE)


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    some = [r.text for r in documents(spark, SMALL).orderBy("doc_id").limit(40).collect()]
    return [*some, None, "", " ", "é", "!!! ..\n\n a", "漢字 かな!", "token=abcdefgh " * 3, "".join(rng.choices("abcdefgh0123456789", k=3000)), "word " * 2000, "a\x00b\tc\x0bd\r\n|#"]


@pytest.fixture(scope="module")
def table(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# --- samples --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("ids", ["null", "7", "8", "id", "id % 3"])
@pytest.mark.parametrize("count", [None, 10**11])
def test_samples_are_never_empty_or_large(spark, monkeypatch, ids, count):
    docs = spark.range(5000).selectExpr(f"cast({ids} as long) as doc_id", "concat('text ', id % 900) as text", "id as other")
    if count:
        monkeypatch.setattr(type(docs), "count", lambda self: count)
    for _ in range(2):
        sample = rows.bounded_sample(docs, "doc_id", "text", 200, 1 << 20).collect()
        assert 1 <= len(sample) <= 200 and sample[0].asDict().keys() == {"doc_id", "text", "other"}
    if not count:
        assert len(sample) >= 100


def test_samples_of_copies_bytes_and_nothing(spark):
    docs = lambda *r: spark.createDataFrame(list(r), "doc_id long, text string")
    assert rows.bounded_sample(docs(*[(3, "same")] * 50), "doc_id", "text", 10, 100).count() == 1
    assert rows.bounded_sample(docs(), "doc_id", "text", 10, 100).count() == 0
    sample = rows.bounded_sample(docs(*[(k, "x" * 30) for k in range(50)], (99, "y" * 101), (100, None)), "doc_id", "text", 40, 100).collect()
    assert 3 <= len(sample) <= 4 and all(len(r.text or "") <= 30 for r in sample)


def test_training_rows_of_one_id_and_many(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("if(id < 1500, 11, id) as doc_id", "concat('text ', id) as text")
    labels = spark.range(3000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic").union(spark.createDataFrame([(None, 1), (11, 1)], "doc_id long, toxic int"))
    found = labelled.training_rows(docs, labels, "toxic", 300)
    assert 100 < len(found[0]) == len(found[1]) <= 300 and set(found[0].tolist()) == {0, 1}
    monkeypatch.setattr(type(docs), "count", lambda self: 10**11)
    assert 1 <= len(labelled.training_rows(docs, labels, "toxic", 300)[0]) <= 300
    assert [len(x) for x in labelled.training_rows(docs.limit(0), labels, "toxic", 300)] == [0, 0]


def test_slices_are_bounded_in_rows_and_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 10] * 10_000 + ["y" * 3_000_000, "z"])], names=["text"])
    parts = list(rows.slices(batch, "text"))
    assert sum(p.num_rows for p in parts) == 10_002 and max(p.num_rows for p in parts) <= rows.SLICE_ROWS
    assert all(p.num_rows == 1 for p in parts if any(len(t) > rows.SLICE_BYTES for t in p.column(0).to_pylist()))


# --- 1 --------------------------------------------------------------------------------------------------------------


def test_op1_spans(spark, table, texts):
    model = secret_scan.train(documents(spark, SMALL))
    got = by_id(secret_scan.scan(table, model))
    allowed = set(secret_scan.ALPHABET)
    flagged = 0
    for k, text in enumerate(texts):
        text = text or ""
        base = secret_scan.base_spans(text)
        free = [c in allowed and not any(a <= i < b for a, _, b in base) for i, c in enumerate(text)]
        spans, start = list(base), 0
        for i in range(len(text) + 1):
            if i == len(text) or not free[i]:
                piece = text[start:i]
                if len(piece) >= secret_scan.LEAST_RUN:
                    codes = [0, *(secret_scan.ALPHABET.index(c) + 1 for c in piece)]
                    if sum(model.table[a, b] for a, b in zip(codes, codes[1:])) / len(piece) > model.threshold:
                        spans.append((start, 3, i))
                        flagged += 1
                start = i + 1
        assert got[k].spans == ",".join(f"{secret_scan.KINDS[kind]}:{a}:{b}" for a, kind, b in sorted(spans))
    assert flagged


def test_op1_walks_a_long_text_once(spark):
    import time

    model = secret_scan.train(documents(spark, SMALL))
    rng = random.Random(1)
    part = lambda: f"token={''.join(rng.choices('abcdef0123456789', k=30))} identifier_of_some_length "
    seconds = []
    for n in (4000, 16000):
        text = "".join(part() for _ in range(n))
        began = time.perf_counter()
        assert len(secret_scan.find_spans(text, model)) >= n
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 8 * seconds[0] + 0.2


# --- 3 --------------------------------------------------------------------------------------------------------------


def span_points(text):
    both = [sum((ord(c) + 1) * pow(b, k, fingerprints.PRIME) for k, c in enumerate(text)) % fingerprints.PRIME for b in fingerprints.BASES]
    return both[0] << 31 | both[1]


def smallest(text, size):
    seen, out = Counter(), []
    for k in range(len(text) - size + 1):
        h = mixed(span_points(text[k : k + size]))
        out.append(mixed(h + seen[h] & WHOLE) >> 32)
        seen[h] += 1
    return sorted(out)[: fingerprints.KEPT]


def fingerprint(text):
    return len(text), span_points(text), *(smallest(text, size) if least <= len(text) < most else [] for size, least, most in fingerprints.SCALES)


def alike(a, b):
    one, two = fingerprint(a), fingerprint(b)
    if one[:2] == two[:2]:
        return 1.0
    if not a or not b:
        return 0.0
    pair = next(((x, y) for x, y in zip(one[2:], two[2:]) if x and y), None)
    if pair is None:
        shorter = min(one, two, key=lambda x: x[0])
        size = next(s[0] for s, x in zip(fingerprints.SCALES, shorter[2:]) if x)
        pair = smallest(a, size), smallest(b, size)
    x, y = map(set, pair)
    least = sorted(x | y)[: fingerprints.KEPT]
    j = sum(h in x and h in y for h in least) / len(least)
    return 2 * j / (1 + j)


def test_op3_fingerprints_and_likeness(spark):
    rng = random.Random(3)
    texts = ["", "a", "ab" * 20, "ab" * 40, "x" * 15, "x" * 63, "x" * 64, "x" * 130]
    base = "".join(rng.choices("abcdé 漢", k=300))
    texts += [base[:n] for n in (3, 15, 16, 31, 32, 63, 64, 70, 127, 128, 130, 300)] + [base[:200] + "!" * 40, base, base]
    rows_ = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = by_id(fingerprints.op3(rows_))
    for k, text in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q] if q else text
        print_ = fingerprint(text)
        assert got[k].fingerprint == f"{print_[0]:x}.{print_[1]:016x}." + ".".join(np.array(s, ">u4").tobytes().hex() for s in print_[2:])
        assert got[k].near_next == pytest.approx(alike(text, after)) and got[k].near_edited == pytest.approx(alike(text, edited))


# --- 4 --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("depth", [6, 9])
def test_op4_recall_in_deep_cells(spark, monkeypatch, depth):
    rng = np.random.default_rng(depth)
    base = rng.standard_normal((300, 24))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.standard_normal(base.shape)
    noise -= (noise * base).sum(1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    x = np.concatenate([base, *(base * c + noise * math.sqrt(1 - c * c) for c in (0.9801, 0.99))])
    monkeypatch.setattr(embedding_dedup, "FULL_CELL", next(f for f in np.geomspace(900, 0.01, 400) if embedding_dedup.layout(900, 0.98)[0] == depth or not monkeypatch.setattr(embedding_dedup, "FULL_CELL", f) and embedding_dedup.layout(900, 0.98)[0] == depth))
    assert embedding_dedup.layout(900, 0.98)[0] == depth
    got = {r.vec_id: r.n_links for r in embedding_dedup.op4(spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()}
    want = (x @ x.T >= 0.98).sum(1) - 1
    assert sum(got.values()) >= 0.99 * want.sum() and all(got[k] <= want[k] for k in got)


def test_op4_any_ids_labels_and_clashing_columns(spark):
    rows_ = [("a", [1.0, 0.0], "x", 1), ("b", [2.0, 0.001], "x", 2), ("c", [1.0, 0.0], "y", 3), ("d", [0.0, 1.0], "x", 4), ("a", [1.0, 0.0], "x", 5)]
    df = spark.createDataFrame(rows_, "vec_id string, embedding array<double>, label string, n_links int")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {("a", 1, "a", True), ("b", 1, "a", False), ("c", 0, "c", True), ("d", 0, "d", True)}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_op4_tiles_count_each_pair_once(spark, monkeypatch):
    from cartulary.llm import tiles

    monkeypatch.setattr(tiles, "TILE", 7)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4, 16)).repeat(30, 0) + 0.05 * rng.standard_normal((120, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.98).sum(1) - 1
    for full in (2000, 3):
        monkeypatch.setattr(embedding_dedup, "FULL_CELL", full)
        got = {r.vec_id: r.n_links for r in embedding_dedup.op4(spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()}
        assert got == dict(enumerate(want.tolist()))


# --- 5 --------------------------------------------------------------------------------------------------------------


def test_op5_mixed_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(k, "one two three " * (k % 4 + 1), f"s{k % 3}", 99, 77, k, "x") for k in range(60)], "doc_id long, text string, source string, size int, target int, __key int, shards string")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    found = out.collect()
    assert found and all((r["size"], r.target, r["__key"], r.shards) == (99, 77, r.doc_id, "x") for r in found)
    assert mixing.mix(docs).columns == ["doc_id", "text", "source", "__key", *mixing.NEW]


def test_op5_shards_in_several_tasks(spark, monkeypatch):
    docs = spark.range(400).selectExpr("id as doc_id", "concat('w ', id) as text", "concat('s', id % 2) as source")
    whole = [tuple(r) for r in mixing.mixed(docs, depth=2).collect()]
    monkeypatch.setattr(mixing, "ROWS_A_TASK", 10)
    parts = mixing.mixed(docs, depth=2)
    assert parts.rdd.getNumPartitions() == 40 and [tuple(r) for r in parts.collect()] == whole


def test_op5_sums_before(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKETS_A_STRETCH", 4)
    rng = random.Random(9)
    groups = [(key, b, rng.randint(0, 9)) for key in "ab" for b in range(30) if rng.random() < 0.7]
    got = {(r.key, r.bucket): r.before for r in mixing.sums_before(spark.createDataFrame(groups, "key string, bucket long, words long"), "key", "bucket", "words").collect()}
    assert got == {(k, b): sum(w for x, c, w in groups if x == k and c < b) for k, b, _ in groups}


# --- 7 --------------------------------------------------------------------------------------------------------------


def test_op7_scores(spark, table, texts, monkeypatch):
    names, matrix = language_id.train(documents(spark, SMALL))
    letters, symbols = language_id.letters().astype(float), language_id.symbols()

    def profile(text):
        codes = [0, *(int(symbols[ord(c)]) for c in text), 0]
        counts = Counter(t for t in zip(codes, codes[1:], codes[2:]) if t[1])
        return sum((math.sqrt(n) * np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for (a, b, c), n in counts.items()), np.zeros(language_id.DIMENSION)), counts

    def check(got):
        for k, text in enumerate(texts):
            vector, counts = profile(text or "")
            if not counts:
                assert (got[k][0], got[k][1]) == ("und", 0.0)
                continue
            cosines = matrix @ vector / np.linalg.norm(vector)
            assert got[k][1] == pytest.approx(min(1, max(0, cosines.max())), abs=1e-4) and cosines[names.index(got[k][0])] >= cosines.max() - 1e-4

    check({r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(table, (names, matrix)).collect()})
    monkeypatch.setattr(language_id, "ROWS", 3)
    monkeypatch.setattr(language_id, "CODES", 50)
    vectors, some = language_id.profiles(texts)
    for vector, ok, text in zip(vectors, some, texts):
        want, counts = profile(text or "")
        assert ok == bool(counts) and np.allclose(vector, want / max(np.linalg.norm(want), 1e-9), atol=1e-4)


def test_op7_counts_long_texts_piece_by_piece():
    text = "uma árvore, duas árvores! " * 400
    for piece in (7, 1000):
        codes, n = language_id.trigrams(text, piece)
        want = language_id.trigrams(text)
        assert codes.tolist() == want[0].tolist() and n.tolist() == want[1].tolist()


def test_op7_learns_from_repeated_ids(spark):
    docs = spark.createDataFrame([(6, "the house of the tree" if k % 2 else "la casa del árbol", "en" if k % 2 else "es") for k in range(100)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.op7(docs).collect()} == {"en", "es"}


def test_op7_needs_little_memory_for_many_short_texts():
    import tracemalloc

    rng = random.Random(1)
    short = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=100)) for _ in range(rows.SLICE_ROWS)]
    language_id.profiles(short[:10])
    tracemalloc.start()
    language_id.profiles(short)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


# --- 8 --------------------------------------------------------------------------------------------------------------


def test_op8_scores(spark, table, texts):
    docs = documents(spark, SF_DIR)
    model = toxicity.train(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    got = by_id(toxicity.score(table, model))
    for k, text in enumerate(texts):
        data, none, number, worst = (text or "").encode(), 1.0, 0, (-1.0, None)
        for m in re.finditer(rb"[^.!?\n]+", data):
            words = list(re.finditer(rb"[0-9A-Za-z\x80-\xff]+", m[0]))
            if not words:
                continue
            z = model.bias
            for w in words:
                low = bytes(b + 32 if 65 <= b <= 90 else b for b in w[0])
                z += model.weights[span_hash(low) % toxicity.BUCKETS]
                z += sum(model.weights[(span_hash(low[:n]) ^ n) % toxicity.BUCKETS] for n in toxicity.PREFIXES if len(low) >= n)
            p = 1 / (1 + math.exp(-min(30, max(-30, z))))
            none, number = none * (1 - min(p, 1 - 1e-12)), number + 1
            if p > worst[0] + 1e-15:
                worst = p, f"{m.start() + words[0].start()}:{m.start() + words[-1].end()}"
        assert got[k].n_sentences == number and got[k].score == pytest.approx(1 - none, abs=1e-9)
        if number == 1:
            assert got[k].worst_sentence == worst[1]


def test_op8_finds_the_toxic_and_leaves_the_others(spark):
    folder = SF_DIR.replace("sf0.01", "sf0.1")  # the smaller tables hold out six toxic documents only
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    found = toxicity.query(spark, folder).where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = defaultdict(int, {(r.toxic, r.predicted): r["count"] for r in found})
    assert n[1, 1] + n[1, 0] >= 50
    assert n[1, 1] / (n[1, 1] + n[1, 0]) >= 0.8 and n[1, 1] / (n[1, 1] + n[0, 1]) >= 0.9


# --- 10 -------------------------------------------------------------------------------------------------------------


def plain_features(text):
    data = text.encode()
    words, lines = re.findall(rb"[^\x20\x09-\x0D]+", data), [x for x in data.split(b"\n") if x]
    per, many, n_lines = max(1, len(data)), max(1, len(words)), max(1, len(lines))
    pairs = list(zip(words, words[1:]))
    kinds = [set(range(65, 91)), set(range(97, 123)), set(range(48, 58)), set(b".?;:,"), set(b"!"), set(b"|"), set(b"#$%&*@~^_=+<>{}[]\\/"), set(b" \t"), set(b"\n"), set(range(128, 256))]
    return [
        math.log1p(len(data)), math.log1p(len(words)), sum(map(len, words)) / many, sum(len(w) <= 3 for w in words) / many, sum(len(w) >= 12 for w in words) / many,
        *(sum(b in kind for b in data) / per for kind in kinds),
        len(set(words)) / many, len(set(pairs)) / max(1, len(words) - 1), len(set(lines)) / n_lines, math.log1p(len(data) / n_lines),
        sum(a == b for a, b in pairs) / many, sum(65 <= w[0] <= 90 for w in words) / many,
    ]


def test_op10_features_and_scores(spark, table, texts):
    docs = documents(spark, SF_DIR)
    model = quality.train(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    want = np.array([plain_features(t or "") for t in texts])
    assert np.allclose(quality.features(pa.array(texts)), want, atol=1e-9)
    got = by_id(quality.score(table, model))
    for k, x in enumerate(want):
        b = [sum(c <= v + 1e-12 for c in cut) for cut, v in zip(model.cuts, x)]
        near_cut = any(abs(c - v) < 1e-9 for cut, v in zip(model.cuts, x) for c in cut)
        z = model.intercept + sum(t[i] for t, i in zip(model.singles, b)) + sum(t[b[i] // model.coarse, b[j] // model.coarse] for i, j, t in model.pairs)
        if not near_cut:
            assert got[k].score == pytest.approx(1 / (1 + math.exp(-z)))


# --- the pipeline's stages ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def rough(spark):
    """Nulls in every column, repeated rows and ids, empty and long texts, extra columns with clashing names."""
    base = documents(spark, SMALL).limit(60)
    rows_ = [(None, "um texto sem id, com segredo token=abcdef123456", None, None, None), (None, None, None, None, None), (5000, None, "pt", "s", 0), (5001, "", None, "s", 0), (5002, "long words here " * 20_000, "en", None, 1), (5002, "long words here " * 20_000, "en", None, 1), (5003, "um texto repetido", "pt", "s", 1), (5003, "outro texto, com o mesmo id", "pt", "s", 1)]
    extra = spark.createDataFrame(rows_, base.schema)
    return base.union(extra).union(extra.limit(2)).selectExpr("*", "99 as size", "0.5D as score", "'x' as key", "7 as component_id", "1 as number", "array(1) as token_ids")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_rough_and_empty_tables(spark, rough, name, stage):
    last = name == corpus_pipeline.STAGES[-1][0]
    for docs in (rough, rough.limit(0), documents(spark, SMALL).limit(0)):
        out = stage(spark, docs, SMALL)
        assert last or out.columns == corpus_pipeline.COLUMNS
        found = out.collect()
        assert bool(found) == (docs is rough)
    out = stage(spark, rough, SMALL)
    ids = Counter(r.doc_id for r in out.collect())
    given = Counter(r.doc_id for r in rough.collect())
    assert set(ids) <= set(given)
    if name in ("secret scans", "SentencePiece encoding and decoding"):
        assert ids == given
    if name == "MinHash near-dedup":
        assert ids[None] == given[None] and ids[5002] == 1 and ids[5003] == 2
    if name == "secret scans":
        texts = [r.text for r in out.where("doc_id is null").collect()]
        assert None in texts and any("[SECRET]" in t for t in texts if t)


def test_quality_stage_keeps_what_it_scores_high(spark, rough):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    scored = quality.score(rough.select("doc_id", "text"), quality.train(rough, labels)).where(F.col("score") >= 0.3)
    kept = corpus_pipeline.keep_quality(spark, rough, SMALL)
    assert sorted(map(repr, kept.select("doc_id", "text").collect())) == sorted(map(repr, scored.select("doc_id", "text").collect()))
