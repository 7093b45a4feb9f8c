import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from corpusweave.llm import order_minhash as om

WORD = 1 << 64


def chained(values, seed=42):
    """Spark's xxhash64 of several values: each hashed with the hash before as seed; null leaves it as it is."""
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q" if v.bit_length() > 31 or isinstance(v, Long) else "<i", v), seed % WORD)
    return seed


class Long(int):
    pass


def signed(v):
    return Long(v - WORD if v >> 63 else v)


def brute_force(text):
    """The definition, written out: all numbered k-mers, the smallest of each bucket by sorting."""
    words = re.findall("[^\x20\x09-\x0d]{1,16}", text)
    hashes = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
    places = range(max(1, len(words) - om.K + 1)) if words else []
    kmers = [(chained([hashes[i + j] if i + j < len(hashes) else None for j in range(om.K)]) >> om.PLACE, i) for i in places]
    seen, numbered = {}, []
    for mark, i in sorted(kmers):
        n = seen[mark] = seen.get(mark, -1) + 1
        numbered.append((mark if n == 0 else chained([Long(mark), n]) >> om.PLACE, i))
    out = []
    for bucket in range(om.BUCKETS):
        few = sorted((m, i) for m, i in numbered if m >> om.BUCKET - om.PLACE == bucket)
        # longs are compared with their sign, which is the same for all of a bucket
        few = sorted(few[:om.SELECT], key=lambda x: (x[1], x[0] >> 1))
        if few:
            out.append(bucket << om.BUCKET | chained([Long(m >> 1) for m, _ in few]) >> 64 - om.BUCKET)
    return sorted(signed(v) for v in out)


def samples():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(90)]
    yield from ("", " ", "one", "one two", "one two three", "x" * 100, "same " * 50, "a b a b a b a b", "é ß \U0001f600 日本")
    for n in (10, 100, 400, 2000):
        yield " ".join(draw.choices(words, k=n))


def test_fingerprints_are_the_definition(spark):
    texts = list(samples())
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", om.fingerprint(F.col("text")).alias("f")).collect()
    for r in rows:
        assert sorted(r.f) == brute_force(texts[r.i]), texts[r.i][:40]


def test_likeness_falls_with_edits_and_with_order(spark):
    draw = random.Random(1)
    base = draw.choices([f"w{i}" for i in range(5000)], k=600)
    turned = base[300:] + base[:300]
    few = [w if i % 50 else "edited" for i, w in enumerate(base)]
    many = [w if i % 5 else "edited" for i, w in enumerate(base)]
    other = draw.choices([f"v{i}" for i in range(5000)], k=600)
    rows = [(i, " ".join(base), " ".join(t)) for i, t in enumerate([base, few, many, turned, other])] + [(5, "", ""), (6, "", "a b c d")]
    got = [r[0] for r in spark.createDataFrame(rows, "i int, a string, b string").orderBy("i").select(om.likeness(om.fingerprint(F.col("a")), om.fingerprint(F.col("b")))).collect()]
    assert got[0] == 1.0 and got[0] > got[1] > got[2] > got[4] and got[3] < 0.85 and got[4] == 0 and got[5] == 1.0 and got[6] == 0


def check(rows, docs):
    docs = sorted(((om.NO_ID if d is None else d, t or "") for d, t in docs))
    want = []
    for i, (d, t) in enumerate(docs):
        half = len(t) // 2
        edited = t[:len(t) - half] + docs[(i + 1) % len(docs)][1][:half]
        want.append((None if d == om.NO_ID else d, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in rows)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_edits_take_the_next_document(spark, parts):
    draw = random.Random(parts)
    docs = [(draw.randrange(-10**6, 10**6), " ".join(draw.choices(["é", "ab", "cde"], k=draw.randrange(30)))) for _ in range(200)]
    rows = om.edits(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), parts).collect()
    check(rows, docs)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


def test_odd_tables(spark, odd_documents, no_documents):
    check(om.edits(odd_documents).collect(), [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()])
    assert om.edits(no_documents).count() == 0
    one = om.edits(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a b c a b c"[:6] + b"a b c").hexdigest()


def test_plan_stays_in_the_jvm(spark, odd_documents):
    plan = om.edits(odd_documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
