"""The fitted operators: accuracy on rows that they haven't seen, exact counts, odd tables."""

import collections
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusweave.llm import byte_cnn, language, maxent
from tests.llm.conftest import SCHEMA

FOLDER = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.01")
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no benchmark tables")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


def remainder(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


@needs_tables
def test_quality_on_rows_held_out(documents, labels):
    rows = byte_cnn.predictions(documents, labels).join(labels, "doc_id", "left").collect()
    assert len(rows) == documents.count()
    assert all(r.held_out == (remainder(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.quality is not None]
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)


def test_quality_of_odd_tables(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(3, 1), (5, 0), (None, 1), (6, None), (99, 0), (4, 1), (7, 0)], "doc_id long, quality int")
    found = byte_cnn.predictions(odd_documents, labels).collect()
    assert len(found) == odd_documents.count() and not any(math.isnan(r.score) for r in found)
    assert byte_cnn.accepted(odd_documents, labels).columns == odd_documents.columns
    assert byte_cnn.predictions(no_documents, labels).count() == 0
    assert {r.score for r in byte_cnn.predictions(odd_documents, labels.limit(0)).collect()} == {0.5}


def test_repeat_channel():
    draw = random.Random(1)
    for _ in range(40):
        raw = bytes(draw.choices(b"ab", k=draw.randint(0, 90))) + bytes(draw.choices(b"xyz", k=20)) * draw.randint(0, 4)
        n = byte_cnn.REPEAT
        want = [int(i + n <= len(raw) and raw[i:i + n] in {raw[j:j + n] for j in range(i)}) for i in range(len(raw))]
        assert byte_cnn.repeats(raw).tolist() == want


def test_pooling_in_spans_is_that_of_every_position(monkeypatch):
    rng = np.random.default_rng(0)
    net = byte_cnn.Network(rng.normal(size=(256, 6)), rng.normal(size=(6, 7, 8)), rng.normal(size=8), rng.normal(size=16), 0.1)
    text = "".join(random.Random(2).choices("abc déf", k=3000))
    monkeypatch.setattr(byte_cnn, "SPAN", 4 * byte_cnn.CHUNK)
    raw = text.encode()
    flags = np.concatenate([r[:n] for _, r, n in byte_cnn.spans(text)] + [np.zeros(5, np.uint8)])
    tails = {at + n: r[n:n + 5] for at, (_, r, n) in zip(range(0, 10**6, byte_cnn.SPAN), byte_cnn.spans(text))}
    z = np.zeros((len(raw), 8))
    for i in range(len(raw)):
        edge = (i // byte_cnn.SPAN + 1) * byte_cnn.SPAN
        for w in range(6):
            byte = raw[i + w] if i + w < len(raw) else 0
            flag = flags[i + w] if i + w < edge or edge not in tails else tails[edge][i + w - edge]
            z[i] += net.embed[byte] @ net.filters[w, :-1] + flag * net.filters[w, -1]
    z = np.maximum(z + net.bias, 0)
    chunks = [z[i:i + byte_cnn.CHUNK] for i in range(0, len(raw), byte_cnn.CHUNK)]
    pooled = np.mean([np.concatenate([c.max(axis=0), c.mean(axis=0)]) for c in chunks], axis=0)
    assert net.score(text) == pytest.approx(1 / (1 + math.exp(-(pooled @ net.weights + 0.1))), rel=1e-4)


@needs_tables
def test_language_on_rows_held_out(documents):
    rows = language.predictions(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == documents.count() and all(r.held_out == (remainder(r.doc_id, 5) == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)


def test_language_of_odd_tables(odd_documents, no_documents):
    rows = language.predictions(odd_documents).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 6, 8)} == {"und"}
    assert language.predictions(no_documents).count() == 0
    assert {r.lang_pred for r in language.identified(odd_documents, language.fit(no_documents, F.lit(True))).collect()} == {"und"}


def test_unseen_words_go_by_the_longest_known_grams(spark):
    rows = [(i, t, lang, "s", 1) for i, (t, lang) in enumerate([("straße strauß strähne", "de"), ("strange strength straight", "en")] * 5)]
    predict = language.Predictor(language.fit(spark.createDataFrame(rows, SCHEMA), F.lit(True)))
    assert [predict(t)[0] for t in ("straße", "strange", "strauße", "strengths")] == ["de", "en", "de", "en"]
    assert predict("12 !?") == ("und", 0.0)


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w] + [""]


def check_base(rows, documents):
    counts = collections.Counter()
    for doc_id, text in documents:
        if doc_id is None or remainder(doc_id, 5) != 1:
            counts.update(words_of(text))
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((str(d), len(w := words_of(t)), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w))
                  for d, t in documents)
    found = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score) for r in rows)
    assert [w[:3] for w in want] == [f[:3] for f in found] and {r.train_tokens for r in rows} == {total}
    assert np.allclose([w[3] for w in want], [f[3] for f in found], rtol=1e-9)


@needs_tables
def test_scores_hold_exact_counts_and_beat_the_base_on_rows_held_out(documents):
    rows = maxent.held_out_scores(documents).collect()
    check_base(rows, [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (remainder(r.doc_id, 5) == 1) for r in rows)
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)


def test_rare_words_are_looked_up_like_head_words(spark, monkeypatch, odd_documents):
    monkeypatch.setattr(maxent, "HEAD", 3)
    check_base(maxent.held_out_scores(odd_documents).collect(), [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()])


def test_scores_of_odd_tables(spark, odd_documents, no_documents):
    check_base(maxent.held_out_scores(odd_documents).collect(), [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()])
    assert maxent.held_out_scores(no_documents).count() == 0
    only_held_out = spark.createDataFrame([(i, "a b") for i in range(40) if remainder(i, 5) == 1], "doc_id long, text string")
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in maxent.held_out_scores(only_held_out).collect())


def test_class_probabilities_add_up():
    rng = np.random.default_rng(3)
    prior = rng.dirichlet(np.ones(maxent.CLASSES)).astype(np.float32)
    p = maxent.softmax(rng.normal(size=(maxent.ROWS, maxent.CLASSES)).astype(np.float32), np.log(prior), rng.integers(0, maxent.ROWS, (maxent.FEATURES, 50)))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)


def test_gradient_is_taken_at_every_token():
    texts = ["a b c d " * 50, "", "a", "b c " * maxent.BATCH]
    words = ["", "a", "b", "c", "d"]
    vocabulary = maxent.Vocabulary(words, np.arange(5, 0, -1, dtype=float), 15, 5).finish(np.zeros((5, maxent.CONTEXTS)))
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    found = list(maxent.batches_of(maxent.Reader(vocabulary), [batch]))
    assert sum(len(kind) for kind, _ in found) == sum(rows.shape[1] for _, rows in found) == sum(len(words_of(t)) for t in texts)


def test_the_word_factor_goes_by_history_and_adds_up(spark):
    docs = spark.createDataFrame([(i, ("red cat " if i % 2 else "blue dog ") * 100) for i in range(400)], "doc_id long, text string")
    model = maxent.fit(docs)
    assert len(set(model.vocabulary.classes.tolist())) == 1, "all of one class, so that the class factor tells nothing"
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(["red cat", "red dog", "blue cat", "blue dog"])], "doc_id long, text string")
    found = {r.doc_id: r for r in maxent.scores(asked, model).collect()}
    assert np.ptp([r.base_score for r in found.values()]) < 1e-9
    assert found[0].score > found[1].score + 0.1 and found[3].score > found[2].score + 0.1
    # over all words and one unseen word in each shared slot of rare words
    reader = maxent.Reader(model.vocabulary)
    unseen = {maxent.slot_of_rare(w): w for w in map(str, range(1000))}
    total = 0.0
    for word in [*model.vocabulary.words, *unseen.values()]:
        cells, rows = reader.features([reader.ids([b"red", word.encode()])])
        count = dict(zip(model.vocabulary.words, model.vocabulary.counts)).get(word, 0)
        total += (count + 0.5) / model.vocabulary.mass * 10 ** maxent.gains(model.priors, model.weights, cells, rows)[1]
    absent = maxent.CLASSES // maxent.BANDS - 1  # other classes of rare words hold unseen words alone
    assert 1 - 0.5 * (absent + 1) * len(unseen) / model.vocabulary.mass < total <= 1 + 1e-5


def test_letters_of_many_words_say_what_those_of_each_say():
    draw = random.Random(7)
    seeds = ["the", "of", "", "<", "a>b", "\u00e9t\u00e9", "\U0001f600\U0001f600", "nation", "ration"] * 3
    vocabulary = maxent.Vocabulary(seeds, np.arange(len(seeds), 0, -1, dtype=float), 99, 9)
    grams = vocabulary.finish(np.abs(np.random.default_rng(1).normal(size=(len(seeds), maxent.CONTEXTS))) * 9).grams
    words = [*seeds, "x", "\uffff", "nation" * 500, *("".join(draw.choices("thenatior<>\u00e9\U0001f600z", k=draw.randrange(12))) for _ in range(2000))]

    def of_one(word):
        edged, score = f"<{word}>", np.zeros(maxent.TOPICS)
        for i in range(len(edged) - 1):
            score += next((grams[edged[i:i + n]] for n in (4, 3, 2) if edged[i:i + n] in grams), 0)
        return score.argmax()

    found = maxent.Letters(grams).topics(words)
    assert found.tolist() == [of_one(w) for w in words] and len(set(found.tolist())) > 2
    assert len(maxent.Letters({}).topics(words)) == len(words) and len(maxent.Letters(grams).topics([])) == 0


@pytest.mark.parametrize("kinds", [1, 3, 40, 3000])
def test_gradients_of_equal_features_are_summed(kinds):
    rng = np.random.default_rng(kinds)
    values, row = rng.normal(size=(4000, 5)).astype(np.float32), rng.integers(0, kinds, 4000)
    order = np.argsort(row, kind="stable")
    which, first, sizes = np.unique(row[order], return_index=True, return_counts=True)
    expected = np.zeros((kinds, 5))
    np.add.at(expected, row, values)
    assert np.allclose(maxent.sum_runs(values, order, first, sizes), expected[which], atol=1e-4)


def test_coded_texts_train_like_texts():
    texts = ["a b c d " * 50, "", "a", "never met " * 9, "b c " * maxent.BATCH]
    words = ["", "a", "b", "c", "d"]
    reader = maxent.Reader(maxent.Vocabulary(words, np.arange(5, 0, -1, dtype=float), 15, 5).finish(np.zeros((5, maxent.CONTEXTS))))
    coded = [reader.ids(maxent.tokens(t)).tobytes() for t in texts]
    plain, read = (list(maxent.batches_of(reader, [pa.RecordBatch.from_arrays([pa.array(t)], names=["text"])])) for t in (texts, coded))
    assert all(np.array_equal(a, b) for one, two in zip(plain, read, strict=True) for a, b in zip(one, two, strict=True))


def test_documents_are_read_for_counts_neighbours_and_codes_only(spark):
    passed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame([(i, f"some words {i % 7}") for i in range(300)], "doc_id long, text string").mapInArrow(count, "doc_id long, text string")
    assert len(maxent.held_out_scores(docs).collect()) == 300
    assert passed.value == 3 * 300
