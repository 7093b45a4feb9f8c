"""BPE encoding by dynamic programming over prefixes, and decoding.

A BPE segmentation is the only one whose neighbouring tokens are all compatible, that is, the merges of their joined text
give just these two tokens. So each prefix of a word has exactly one possible last token: among the vocabulary
entries that end there (all found by one run of a suffix automaton) it is the one compatible with the last token of the prefix
before it. The ids follow from the stored last tokens, backwards. Cost is linear in the text, for words of any length.

Null texts count as empty and give no ids; words are remembered in tables of bounded size; texts are encoded whole.
Letters and numbers are those of the Unicode tables of this Python environment; code points that Unicode assigned after the tables
of the tokenizers library were made may be split differently.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corpusweave.llm.rows import Memo, map_documents, text_or_empty

#: Remembered words, as many pieces between spaces, and pairs of tokens per Python worker.
WORDS, PAIRS = 700_000, 500_000
#: Python's str.split takes these for spaces, the tokenizer doesn't.
SEPARATORS = regex.compile(r"[\x1C-\x1F]")
SPACE = regex.compile(r"\s+")


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable character: itself if printable, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Encoder:
    """A tokenizers file of the kind BPE with word ends. A word's letters are its bytes; the last one has 256 added to mark the end."""

    def __init__(self, path: str, remembered: int = WORDS):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocabulary, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.special.items()}
        # tokens in the order in which merges may make them: letters first, then by rank
        names = [c for c in letters] + [c + suffix for c in letters]
        texts = [chr(b) for b in letters.values()] + [chr(256 + b) for b in letters.values()]
        order = {name: i for i, name in enumerate(names)}
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(len(names))]
        self.made: dict[tuple[int, int], int] = {}
        for left, right in merges:
            name = left + right.removeprefix(model["continuing_subword_prefix"] or "")
            pair = (order[left], order[right])
            if name in order:
                raise ValueError(f"two merges make {name!r}: the last token of a prefix would not be unique")
            order[name] = self.made[pair] = len(texts)
            self.parts.append(pair)
            texts.append(texts[pair[0]] + texts[pair[1]])
        self.ids = [vocabulary[name] for name in order]
        self.length = [len(t) for t in texts]
        self.automaton = ahocorasick.Automaton()
        for i, text in enumerate(texts):
            self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.fits = Memo(self._compatible, min(remembered, PAIRS))
        self.words = Memo(self._word, remembered)
        self.pieces = Memo(self._piece, remembered)
        self.packed = Memo(lambda piece: array("I", self._piece(piece)).tobytes(), remembered)

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Would merging the joined text of two tokens end in these two? Undo their merges, the latest first, down to the letters at
        the seam, and look for a merge across it that would have come before the one undone."""
        left, right = pair
        first = len(self.parts)  # merges across the seam count if made before this one
        while True:
            across = self.made.get((left, right))
            if across is not None and across < first:
                return False
            if left > right:
                first = left
                left = self.parts[left][1]
                if left != first:
                    continue
                first, right = right + 1, self.parts[right][0]
                if right + 1 == first:
                    return True
            else:
                # of equal merges the leftmost comes first, so one across the seam precedes an equal one on the right
                first = right + 1
                right = self.parts[right][0]
                if right + 1 != first:
                    continue
                first, left = left, self.parts[left][1]
                if left == first:
                    return True

    def _word(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "surrogatepass")
        letters = raw[:-1].decode("latin-1") + chr(256 + raw[-1])
        last, fits = [-1] * (len(letters) + 1), self.fits
        for end, (token, length) in self.automaton.iter(letters):
            if last[end + 1] < 0:
                before = end + 1 - length
                if before == 0 or last[before] >= 0 and fits[last[before], token]:
                    last[end + 1] = token
        found, at = [], len(letters)
        while at:
            found.append(self.ids[last[at]])
            at -= self.length[last[at]]
        return tuple(reversed(found))

    def _piece(self, piece: str) -> tuple[int, ...]:
        # letters are lower-cased one by one, without the rule for a final sigma
        plain = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
        return tuple(chain.from_iterable(map(self.words.__getitem__, self.split.findall(plain))))

    def _plain(self, text: str) -> Iterator[int]:
        # neither words nor normal forms reach over a space, so the text may be cut there first
        cut = filter(None, SPACE.split(text)) if SEPARATORS.search(text) else text.split()
        return chain.from_iterable(map(self.pieces.__getitem__, cut))

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.specials is not None and self.specials.search(text) or SEPARATORS.search(text):
            return array("I", self.encode(text)).tobytes()
        return b"".join(map(self.packed.__getitem__, text.split()))

    def encode(self, text: str) -> list[int]:
        if self.specials is None or not self.specials.search(text):
            return list(self._plain(text))
        found: list[int] = []
        for i, part in enumerate(self.specials.split(text)):
            found.extend([self.special[part]] if i % 2 else self._plain(part))
        return found

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, tokens are joined by a space, as they are."""
        return " ".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str, remembered: int = WORDS) -> Encoder:
    """One per Python worker and file."""
    return Encoder(path, remembered)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) of every whole text. Repeated rows give repeated results, null texts no ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def start():
        encode = encoder(path).encode
        return lambda doc_id, text: [(doc_id, encode(text))]

    return map_documents(docs, ["doc_id", text_or_empty()], schema, start)


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows with doc_id and ids; null ids decode to the empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def start():
        decode = encoder(path).decode
        return lambda doc_id, ids: [(doc_id, decode(ids or []))]

    return map_documents(rows, ["doc_id", "ids"], schema, start)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; ids are encoded and decoded within the task."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def start():
        model = encoder(path)
        decimal = [str(i) for i in range(max(model.token) + 1)]

        def each(doc_id, text):
            ids = model.encode(text)
            written = " ".join(map(decimal.__getitem__, ids))
            yield doc_id, len(ids), hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()

        return each

    return map_documents(docs, ["doc_id", text_or_empty()], schema, start)
