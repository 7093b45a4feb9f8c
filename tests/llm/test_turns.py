import hashlib
import random
import re
import zlib
from heapq import heappop, heappush
from itertools import count

import pytest

from corpusweave.llm import turns


def damage(conv_id, turn, role, text):
    name = [" " if x is None else str(x) for x in (conv_id, turn)]
    role, text = (" " if x is None else x for x in (role, text))
    fate = zlib.crc32(":".join(name).encode()) % 20
    if fate == 0:
        return []
    text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
    row = (turn, "user" if fate == 4 else role, text)
    return [row, row] if fate == 3 else [row]


def cheapest(rows, fault):
    """Uniform-cost search over (rows done, roles so far in the pattern); the audit breaks ties, so the first to arrive is the answer."""
    tie, seen = count(), set()
    heap = [(0, "", next(tie), 0, "", ())]
    while heap:
        cost, audit, _, i, last, out = heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, out
        if (i, last) in seen:
            continue
        seen.add((i, last))
        fits = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        give = "assistant" if last == "u" else "user"
        heappush(heap, (cost + 2, audit + "I", next(tie), i, give[0], (*out, (give, ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heappush(heap, (cost + 3, audit + "D", next(tie), i + 1, last, out))
            more = fault[i] == "truncated"
            if fault[i] not in ("blank", "duplicate"):
                heappush(heap, (cost + 2 + more, audit + "R", next(tie), i + 1, give[0], (*out, (give, text))))
                if role[:1] and role[:1] in fits:
                    heappush(heap, (cost + more, audit + "K", next(tie), i + 1, role[0], (*out, (role, text))))
    raise AssertionError


def brute_force(given):
    result = {}
    for conv in {r[0] for r in given}:
        rows = [d for r in given if r[0] == conv for d in damage(*r)]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        fault, seen = [], set()
        for _, role, text in rows:
            words = re.sub("[\x20\x09-\x0d]", "", text)
            fault.append("blank" if not words else "duplicate" if (role, text) in seen else None if words[-1] in ".!?" else "truncated")
            seen.add((role, text))
        cost, audit, out = cheapest(rows, fault)
        known = [r[0] for r in rows if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        repaired = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        result[conv] = (gaps, fault.count("blank"), fault.count("duplicate"), fault.count("truncated"), illegal, cost, audit, repaired)
    return result


def conversations():
    draw = random.Random(11)
    texts = ["yes.", "no!", "why?", "because", "", " \t", "so it is.", "é.", "a?\n", "the end"]
    roles = ["user", "assistant", "system", "tool", "", None, "ü"]
    rows = []
    for conv in [None, *range(-3, 60)]:
        for turn in range(draw.choice([0, 1, 2, 3, 5, 9, 30])):
            turn = draw.choice([turn, turn, turn, 2 * turn, None, 0])
            role = draw.choice(roles) if draw.random() < 0.4 else ("user", "assistant")[len(rows) % 2]
            rows.append((conv, turn, role, draw.choice(texts) if draw.random() < 0.9 else None))
    return rows + [(7, None, None, None)] * 3


SCHEMA = "conv_id long, turn long, role string, text string"


def found(df):
    return {r.conv_id: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def test_repairs_against_a_search_over_all_edits(spark):
    rows = conversations()
    got = turns.repairs(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert dict(got.dtypes) == dict.fromkeys(["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"], "bigint") | {"audit": "string", "repaired_sha256": "string"}
    assert found(got) == brute_force(rows)


def test_one_conversation_of_many_rows(spark):
    draw = random.Random(3)
    rows = [(1, i, draw.choice(["user", "assistant", "assistant", "system"]), f"text {i % 700}{draw.choice(['.', '.', ''])}") for i in range(2500)] + [(2, 0, "user", "hello.")]
    rows += [(3, 4, "user", "x" * 200_000 + ".")]
    assert found(turns.repairs(spark.createDataFrame(rows, SCHEMA))) == brute_force(rows)


def test_empty_table_and_extra_columns(spark):
    assert turns.repairs(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = conversations()[:80]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ["rank", "total", "letter", "block", "conv", "fault", "kind", "edits", "copy", "fate", "state", "first"]:
        df = df.selectExpr("*", f"'x' AS {name}")
    assert found(turns.repairs(df)) == brute_force(rows)


@pytest.mark.parametrize(("letters", "audit"), [("", ""), ("ua", "KK"), ("s", "D"), ("su", "KKI"), ("uu", "KR"), ("aa", "RK"), ("-ua", "DKK"), ("x", "D"), ("Ua", "KK"), ("sua", "KKK")])
def test_walks_of_short_conversations(letters, audit):
    edits, states = turns.walk(letters, list(turns.AT_END), True)
    assert "".join(edits[turns.NOTHING]) == audit
    assert states[turns.NOTHING] in (turns.NOTHING, turns.ASSISTANT)
