import random
import re

from corpusweave.llm import bottom_k
from tests.llm.test_near_copies import texts_at_all_distances


def shingle_set(text, width):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def brute_force(rows, width=4):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    sets, root = [shingle_set(t, width) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least.setdefault(find(i), []).append(doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = least[find(i)] if sets[i] else [doc_id]
        component = None if None in ids else min(ids)
        out.append(str((doc_id, len(sets[i]), component, doc_id == component)))
    return sorted(out)


def found(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_groups_are_those_of_all_pairs(spark):
    rows = [(1000 - i, t) for i, t in enumerate(texts_at_all_distances())]
    assert found(bottom_k.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute_force(rows)


def with_a_common_passage(n, common, own, seed=3):
    draw = random.Random(seed)
    passage = [f"c{i}" for i in range(common)]
    return [" ".join([f"o{draw.random()}" for _ in range(own)] + passage) for _ in range(n)]


def test_sets_that_share_a_long_passage_are_not_compared_in_all_pairs(spark):
    """Similarity 0.71 within 150 texts: below the border, but far above chance. Two of them have a true near copy."""
    texts = with_a_common_passage(150, 300, 60)
    texts += [texts[5].replace("c7 ", "d7 "), "x " + texts[77]]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = bottom_k.distinct_sets(bottom_k.mark(docs, ["doc_id"]))
    asked = []
    verified = bottom_k.verified

    def counting(pairs, full):
        asked.append(pairs.count())
        return verified(pairs, full)

    bottom_k.verified = counting
    try:
        links = bottom_k.links(sets, docs).collect()
    finally:
        bottom_k.verified = verified
    assert len(links) >= 2 and sum(asked) < 4 * len(texts)
    assert found(bottom_k.groups(docs)) == brute_force(rows)


def test_families_of_changed_copies(spark):
    """Copies of one text with 0 to 40 changed words, many of them beyond the border from the first one, but near one another."""
    draw = random.Random(12)
    base = [f"w{draw.randrange(3000)}" for _ in range(150)]
    texts = []
    for _ in range(25):
        changed = list(base)
        for at in draw.sample(range(150), draw.randrange(12)):
            changed[at] = f"n{draw.random()}"
        for _ in range(6):
            again = list(changed)
            again[draw.randrange(150)] = "again"
            texts.append(" ".join(again))
    rows = list(enumerate(texts))
    assert found(bottom_k.groups(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_force(rows)


def test_odd_tables(odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    got = [r.replace("None, None, None", "None, None, False") for r in found(bottom_k.groups(odd_documents))]
    assert got == brute_force(rows) or got == [r.replace("None, False", "None, True") for r in brute_force(rows)]
    assert bottom_k.groups(no_documents).count() == 0
