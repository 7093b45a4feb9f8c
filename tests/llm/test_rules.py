import random
import re

from corpusweave.llm import rules


def brute_force(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines),
            sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text), text.count("!"), sum(a == b for a, b in zip(words, words[1:])))


def samples():
    draw = random.Random(6)
    yield from ("", " ", "\n\n", "one", "a b c d e f g h", "a b c d e f g h " * 2, "é É ß | <x> &\n" * 5, "x\x1cy z")
    for _ in range(60):
        yield "".join(draw.choice("a b c d\n!|") + draw.choice(" \n\t") for _ in range(draw.randint(1, 120)))


def test_measurements():
    for text in samples():
        assert rules.measure(text) == brute_force(text), repr(text)


def test_ledger_policies_and_ablations(spark):
    good = " ".join(f"word{i}" for i in range(40))
    texts = [good, good.upper(), "short", "a b " * 30, "| " * 40, good + "\n" + good, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in rules.judged(docs).collect()}
    assert [rows[i].kept for i in range(7)] == [True, False, False, False, False, False, False]
    assert [rows[i].base_failed for i in range(7)] == [False, False, True, True, True, True, True]
    assert rows[2].failed & rules.mask(("few_words",)) and not rows[0].failed
    ledger = rules.ledger(docs)
    assert ledger.filter(rules.passes("2026-01")).count() == 2
    for r in rules.ablations(ledger).collect():
        bit = rules.mask((r.rule,))
        masks = [x.failed & rules.mask(rules.POLICIES[rules.CURRENT]) for x in rows.values()]
        assert (r.failed, r.only, r.kept_without) == (sum(bool(m & bit) for m in masks), sum(m == bit for m in masks), sum(not m & ~bit for m in masks))


def test_stage_keeps_rows_whole(odd_documents, no_documents):
    kept = rules.without_failures(odd_documents)
    want = [r for r in odd_documents.collect() if not any(eval(q.replace(" AND ", " and "), {}, dict(zip(rules.MEASURES, brute_force_fast(r.text or "")))) for q in rules.RULES.values())]
    assert kept.columns == odd_documents.columns and sorted(map(str, kept.collect())) == sorted(map(str, want))
    assert rules.without_failures(no_documents).count() == 0 and rules.judged(no_documents).count() == 0
    assert rules.judged(odd_documents).count() == odd_documents.count()


def brute_force_fast(text):
    return brute_force(text) if len(text) < 20_000 else rules.measure(text)


def test_stage_and_ledger_agree_for_every_policy(odd_documents):
    ledger = rules.with_ledger(odd_documents)
    assert sorted(map(str, ledger.select("doc_id", "__failed").collect())) == sorted(
        str(r).replace("failed", "__failed") for r in rules.ledger(odd_documents).select("doc_id", "failed").collect())
    for policy in rules.POLICIES:
        assert ledger.filter(rules.passes(policy, "__failed")).count() == rules.without_failures(odd_documents, policy).count()
