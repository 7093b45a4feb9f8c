import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusweave.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    draw = random.Random(3)
    words = ["the", "tiontion", "éêre***", "'s", "don't", "ΑΣ", "ΣΑΣ", "12345", "<|endoftext|>", "<|startoftext|>", "<|endof", "é", " ", " x", "\x1c", "\x1dy", "İ", "ß",
             "\U0001f600", "你好", "a_b", "...", "q" * 300, "straße", "̈́", "ẋ̣"]
    return ["", " ", *words, *("".join(draw.choice(words) + draw.choice(["", " ", "\n", "\t"]) for _ in range(draw.randint(1, 12))) for _ in range(400))]


def test_ids_and_decoding_are_those_of_the_library(library):
    model = bpe.encoder(PATH)
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert model.encode(text) == ids, repr(text)
        assert model.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_vocabulary_entries_and_random_joins(library):
    model, draw = bpe.encoder(PATH), random.Random(5)
    letters = bpe.byte_letters()
    whole = [bytes(letters[c] for c in t.removesuffix("</w>") if c in letters).decode("utf-8", "ignore") for t in library.get_vocab()]
    for text in ["".join(draw.choices(whole, k=draw.randint(1, 4))) for _ in range(4000)]:
        assert model.encode(text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_very_long_word_takes_linear_time(library):
    text = "".join(random.Random(1).choices("abcdefghetaoin", k=100_000))
    assert bpe.encoder(PATH).encode(text) == library.encode(text, add_special_tokens=False).ids


def test_documents(odd_documents, no_documents, library):
    want = []
    for row in odd_documents.select("doc_id", "text").collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((row.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in bpe.round_trip(odd_documents, PATH).collect())
    assert bpe.round_trip(no_documents, PATH).count() == 0
    back = bpe.decode_ids(bpe.encode_documents(odd_documents, PATH), PATH)
    assert back.count() == odd_documents.count()


def pieces_are_whole(rows, tokens):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert {d: sum(r.length for r in rs) for d, rs in by_doc.items()} == tokens
    padding = 0
    for rs in by_sequence.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == [sum(x.length for x in rs[:i]) for i in range(len(rs))]
        total = sum(r.length for r in rs)
        assert total <= packing.CAPACITY
        padding += 0 if total & (total - 1) == 0 else packing.CAPACITY - total
    return padding


def test_packing_keeps_every_id_once_with_little_padding(spark, library):
    import zlib
    from array import array

    draw = random.Random(9)
    docs = {i: " ".join(draw.choices(["the", "of", "straße", "tiontion"], k=draw.choice([0, 1, 5, 63, 64, 500, 3000, 9000]))) for i in range(300)}
    rows = packing.pack(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3), PATH).collect()
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, packing.END] for i, t in docs.items()}
    padding = pieces_are_whole(rows, {i: len(v) for i, v in ids.items()})
    assert padding < 0.005 * sum(map(len, ids.values()))
    at = dict.fromkeys(ids, 0)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(array("I", ids[r.doc_id][r.start:r.start + r.length]).tobytes())
        at[r.doc_id] += r.length


def test_packing_of_odd_tables(odd_documents, no_documents):
    rows = packing.pack(odd_documents, PATH).collect()
    assert sum(r.length for r in rows) == sum(r.n_tokens + 1 for r in bpe.round_trip(odd_documents, PATH).collect())
    assert packing.pack(no_documents, PATH).count() == 0


def test_cuts_are_powers_of_two_but_for_the_last():
    for n in range(1, 9000, 7):
        found = packing.cuts(n)
        assert sum(found) == n and all(x & (x - 1) == 0 for x in found[:-1]) and (found[-1] < 2 * packing.GRAIN or n % 4096 == 0 or found[-1] & (found[-1] - 1) == 0)


def test_a_small_memory_gives_the_same_ids():
    text = "Words of a text, und noch ein paar Wörter; words again, 123 of them. " * 3
    assert bpe.Encoder(PATH, 2).encode_bytes(text) == bpe.Encoder(PATH).encode_bytes(text)
