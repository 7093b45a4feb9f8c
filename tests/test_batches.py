"""Responses merged at any depth, against a merge in Python."""

import json
import random

from pyspark.sql import functions as F

from corpusweave.session import new_table_path
from corpusweave.sources import batches


def merged(old, new):
    """Objects field by field, arrays appended, anything else replaced."""
    if isinstance(old, dict) and isinstance(new, dict):
        return {k: merged(old[k], new[k]) if k in old and k in new else old.get(k, new.get(k)) if k not in new else new[k] for k in {**old, **new}}
    if isinstance(old, list) and isinstance(new, list):
        return old + new
    return new


def some_document(draw, depth=0):
    kind = draw.random()
    if depth == 0 or kind < 0.4 and depth < 4:
        return {draw.choice(["a", "b", 'c "d"', "e.f", "é"]): some_document(draw, depth + 1) for _ in range(draw.randrange(4))}
    if kind < 0.6:
        return [draw.choice([1, "x", None, {"y": [1]}, [2], 1.5]) for _ in range(draw.randrange(3))]
    return draw.choice([1, "text\n\"q\"", None, True, 2.5, {}])


def frame(spark, rows):
    return spark.createDataFrame(rows, "page long, seq long, doc string").select("page", "seq", F.parse_json("doc").alias("doc"))


def test_nested_merge_against_python(spark):
    draw = random.Random(6)
    rows, want = [], {}
    for page in range(40):
        for seq in range(draw.randrange(1, 6)):
            doc = some_document(draw)
            rows.append((page, seq, json.dumps(doc)))
            want[page] = merged(want[page], doc) if page in want else doc
    draw.shuffle(rows)
    leaves = batches.merge_nested(frame(spark, rows), "page", "seq", "doc")
    got = {r.page: json.loads(r.document) for r in batches.rebuild(leaves, "page").collect()}

    def without_empty_arrays(x):
        return {k: without_empty_arrays(v) for k, v in x.items() if v != []} if isinstance(x, dict) else x

    def bare(x):  # a field that only had an empty array has no leaf, and an object that held nothing else none either
        return {k: v for k, v in ((k, bare(v)) for k, v in x.items()) if v not in ([], "gone")} or ("gone" if x else {}) if isinstance(x, dict) else x

    assert {p: d for p, d in ((p, bare(d)) for p, d in got.items()) if d != "gone"} == {p: d for p, d in ((p, bare(d)) for p, d in want.items()) if d != "gone"}


def test_kinds_that_change_and_records_without_fields(spark):
    rows = [(1, 1, '{"a":{"x":1},"b":[1]}'), (1, 2, '{"a":[1],"b":{"k":2}}'), (1, 3, '{"a":[2],"b":{"l":[3]}}'), (1, 4, '{"b":{"l":[4]}}'), (2, 1, "{}"), (3, 1, None), (4, 1, '{"n":null}')]
    got = {(r.page, ".".join(r.path), r.kind, r.ordinal): r.value for r in batches.merge_nested(frame(spark, rows), "page", "seq", "doc").collect()}
    assert got == {(1, "a", "array", 1): "1", (1, "a", "array", 2): "2", (1, "b.k", "scalar", 1): "2", (1, "b.l", "array", 1): "3", (1, "b.l", "array", 2): "4",
                   (2, "", "object", 1): "{}", (4, "n", "scalar", 1): "null"}
    assert batches.merge_nested(frame(spark, []), "page", "seq", "doc").count() == 0


def test_malformed_responses_are_kept_apart(spark):
    lines = ['{"seq":1,"query":{"pages":[{"title":"A"}]}}', '{"seq":2,"query":{"pa', '{"seq":"x","query":{"pages":[]}}', '{"seq":3}', '{"seq":4,"error":{"code":"maxlag"}}', "[1,2]", "", "null"]
    path = new_table_path(spark, "landed")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    good, malformed = batches.read_quarantined(spark, path)
    assert sorted(r.seq for r in good.collect()) == [1, 4] and good.columns == batches.read_responses(spark, path).columns
    got = {r.line: r.reason for r in malformed.collect()}
    assert got[lines[1]] == "not json" and got[lines[2]] == "other shape" and got['{"seq":3}'] == "empty"
    assert all(r.file.startswith("file:") and r.bytes == len(r.line.encode()) for r in malformed.collect())
