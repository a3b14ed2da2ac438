"""Token ids of texts by the tokenizers library, with the ids of frequent words kept per task.

Both public vocabularies cut a text into words before they merge, so the ids of a text are those of its
words one after another. The words are found here, the library encodes each word that is not known yet, and
texts for which the cutting here is not certain to be the library's (special tokens, characters outside
the Latin blocks) go to the library whole. Words are kept in two generations of at most ``limit``; those in
use move to the newer one, so frequent words stay while memory is bounded.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
from tokenizers import Tokenizer

from skytally.llm.common import kept

#: How the byte-level pre-tokenizer cuts text. Fixed value.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters, numbers and white space among the usual characters. Fixed values.
L, N, S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\t-\r \xa0"
#: The same cuts for texts of usual characters only, most frequent case first; the second is the lower-case word pattern.
USUAL_BYTE_LEVEL = re.compile(f" ?[{L}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{S}{L}{N}]+| ?[{N}]+|[{S}]+(?![^{S}])|[{S}]+")
USUAL_WORDS = re.compile(f"[{L}]+|'(?:s|t|re|ve|m|ll|d)|[{N}]|[^{S}{L}{N}]+")
#: How the lower-case word pre-tokenizer cuts text. Fixed value.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters on which the normalizers and character classes of both sides agree: no control characters, no dotted I.
UNUSUAL = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e -įı-ɏ‐-‧‰-⁞€]")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def read_vocabulary(path: str) -> str:
    """The tokenizer file as text, to be shipped to the tasks (a few megabytes whatever the corpus)."""
    with open(path, encoding="utf-8") as file:
        return file.read()


class Words(dict):
    """Ids of each word, found when first asked for; ``limit`` bounds each of the two generations."""

    def __init__(self, ids_of, limit: int):
        super().__init__()
        self.ids_of, self.limit, self.older = ids_of, limit, {}

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.older.get(word) or self.ids_of(word)
        return ids

    def trim(self) -> None:
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()


class WordEncoder:
    def __init__(self, vocabulary: str, limit: int = 350_000):
        self.library = Tokenizer.from_str(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        parts = json.loads(vocabulary)
        self.special = [t["content"] for t in parts["added_tokens"]]
        self.lower, self.words = False, None
        if parts["normalizer"] is None and parts["pre_tokenizer"].get("use_regex") and not parts["pre_tokenizer"]["add_prefix_space"]:
            self.words = USUAL_BYTE_LEVEL.findall
        elif parts["normalizer"] and [n["type"] for n in parts["normalizer"].get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            if parts["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == WORDS:
                self.lower, self.words = True, USUAL_WORDS.findall
        self.model, self.letters = self.library.model, byte_letters()
        self.known = Words(self.word, limit)

    def whole(self, texts) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def word(self, word: str) -> bytes:
        """Ids of one word as the pre-tokenizer cuts it: the library's merges on its byte letters."""
        letters = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def plain(self, text: str) -> bool:
        return self.words is not None and not UNUSUAL.search(text) and not any(t in text for t in self.special)

    def encode(self, texts) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; null counts as empty."""
        self.known.trim()
        out: list[bytes | None] = []
        for text in texts:
            text = text or ""
            if self.plain(text):
                out.append(b"".join(map(self.known.__getitem__, self.words(text.lower() if self.lower else text))))
            else:
                out.append(None)
        rest = iter(self.whole([t for t, ids in zip(texts, out, strict=True) if ids is None]) if None in out else ())
        return [next(rest) if ids is None else ids for ids in out]


def encoder_of(vocabulary: str) -> WordEncoder:
    """Encoder with the words it knows, for all tasks of a Python worker that use the same vocabulary."""
    return kept(("words", vocabulary), lambda: WordEncoder(vocabulary))
