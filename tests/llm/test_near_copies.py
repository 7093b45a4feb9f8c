import random
import re

import corpus_pipeline
from corpusweave.llm import near_copies


def shingle_set(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def groups_of(texts):
    """The smallest index of the group of each text, by comparing all pairs."""
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return [find(i) for i in range(len(texts))]


def texts_at_all_distances():
    """Copies with a few words changed, chains of them, and a base whose copies are like it but not like one another."""
    draw = random.Random(5)
    words = [f"w{i}" for i in range(900)]
    texts = []
    for size in (4, 5, 30, 120, 120, 600):
        base = draw.choices(words, k=size)
        for changes in [0, 0, 1, 2, 2, 2, 3, 4, 5, 8] * 2:
            changed = list(base)
            for _ in range(min(changes * max(1, size // 100), size)):
                changed[draw.randrange(size)] = draw.choice(words)
            texts.append(" ".join(changed).upper() if draw.random() < 0.2 else " \n".join(changed))
        for _ in range(8):  # each one like the one before
            base = list(base)
            base[draw.randrange(size)] = draw.choice(words)
            texts.append(" ".join(base))
    draw.shuffle(texts)
    return texts


def test_stage_keeps_one_of_each_group_of_all_pairs(spark):
    texts = texts_at_all_distances()
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    (stage,) = [f for name, f in corpus_pipeline.STAGES if "near-dedup" in name]
    kept = stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups_of(texts)))


def test_odd_tables(odd_documents, no_documents):
    kept = near_copies.one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["None", "1", "3", "5", "7", "8", "9"])
    assert near_copies.one_of_each(no_documents).count() == 0


def test_rows_without_an_id_or_with_one_id_are_told_apart_by_their_texts(spark):
    texts = [f"{n} quite different words stand in each of these {n} texts {n}" for n in ("one", "two", "three")]
    docs = spark.createDataFrame([(i, t) for t in texts for i in (None, None)] + [(7, t[::-1]) for t in texts], "doc_id long, text string")
    assert sorted(map(str, near_copies.one_of_each(docs).collect())) == sorted(map(str, docs.distinct().collect()))
