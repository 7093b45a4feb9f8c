import random
import re
import zlib
from collections import Counter

from corpusweave.llm import spelling

LONG = 14


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute_force(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if one_edit(v, w)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words}


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def texts_with_variants():
    draw = random.Random(9)
    stems = ["".join(draw.choice("abé") for _ in range(draw.choice([6, 7, 7, 8]))) for _ in range(40)] + ["x" * (LONG - 1) + "a", "x" * LONG + "a", "x" * LONG + "b", "x" * (LONG + 1), "y" + "x" * (LONG + 1)]
    stems += ["é" * 3000, "é" * 3001, "é" * 1500 + "ü" + "é" * 1499, "abcdef", "abcdefg", "bcdefg", "aaaaaa", "aaaaaaa", "aaaaaaaa"]
    words = []
    for stem in stems:
        words += [stem] * draw.choice([5, 6, 30, 160, 900] if len(stem) < 100 else [5, 25])
        for _ in range(6):
            at = draw.randrange(len(stem))
            changed = draw.choice([stem[:at] + stem[at + 1:], stem[:at] + draw.choice("abéz") + stem[at:], stem[:at] + draw.choice("abéz") + stem[at + 1:]])
            words += [changed] * (draw.choice([4, 5, 7]) if len(stem) < 100 else 5)
    draw.shuffle(words)
    return [(i if i % 50 else None, draw.choice([" ", "1", ", "]).join(w.upper() if draw.random() < 0.1 else w for w in words[i::120])) for i in range(120)]


def test_variants_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LONG", LONG)
    rows = texts_with_variants()
    expected = brute_force(rows)
    assert sum(e[0] is not None for e in expected.values()) > 20 and any(len(w) > LONG and e[3] for w, e in expected.items())
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    assert found(got) == expected


def test_odd_tables(spark, odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    assert found(spelling.variants(odd_documents)) == brute_force(rows)
    assert spelling.variants(no_documents).count() == 0
    one = spark.createDataFrame([(1, "single " * 5)], "doc_id long, text string")
    assert found(spelling.variants(one)) == brute_force([(1, "single " * 5)])


def test_chains_of_forms_are_followed_to_the_end(spark):
    pairs = [(f"w{i}", f"w{i + 1}") for i in range(13)]
    got = {r.word: r.root for r in spelling.last_forms(spark.createDataFrame(pairs, "word string, form string")).collect()}
    assert got == {w: "w13" for w, _ in pairs}
