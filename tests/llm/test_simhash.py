import random
import re

import pytest
import xxhash

from corpusweave.llm import simhash
from corpusweave.llm.components import components


def print_of(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_force(rows):
    """(doc_id, fingerprint, component_id) by comparing all pairs."""
    prints, root = [print_of(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least.setdefault(find(i), []).append(doc_id)
    return sorted(str((rows[i][0], f"{prints[i]:016x}", None if None in least[find(i)] else min(least[find(i)]))) for i in range(len(rows)))


def near_copies():
    draw = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(12):
        text = draw.choices(words, k=draw.choice([5, 60, 700]))
        for _ in range(8):
            changed = list(text)
            for _ in range(draw.randint(0, 3)):
                changed[draw.randrange(len(changed))] = draw.choice(words)
            rows.append((1000 - len(rows), " ".join(changed).upper() if draw.random() < 0.2 else " \n".join(changed)))
    return rows


def test_groups_are_those_of_all_pairs(spark):
    rows = near_copies()
    found = simhash.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(str(tuple(r)) for r in found.collect()) == brute_force(rows)


def test_odd_tables(odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    assert sorted(str(tuple(r)) for r in simhash.groups(odd_documents).collect()) == brute_force(rows)
    assert simhash.groups(no_documents).count() == 0


def test_ball_links_find_every_pair_within_the_radius(spark):
    draw = random.Random(4)
    centres = [draw.getrandbits(64) for _ in range(6)]
    values = {c ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 3))) for c in centres for _ in range(60)}
    signed = [v - (v >> 63 << 64) for v in values]
    found = components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")), "fp", "other")
    root = {r.node: r.root for r in found.collect()}
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                assert root[a] == root[b]
    assert all(r == min(n for n, x in root.items() if x == r) for r in root.values())
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([], "fp long"), 3)


def test_components_of_chains_stars_and_noise(spark):
    draw = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)] + [(draw.randrange(1000, 1100), draw.randrange(1000, 1100)) for _ in range(60)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    found = {(r.node, r.root) for r in components(spark.createDataFrame([*edges, (None, 3)], "a long, b long"), "a", "b").collect()}
    assert found == {(x, find(x)) for x in parent}
