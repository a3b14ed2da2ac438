"""Byte-level BPE with forced-boundary splitting, encoding and decoding.

Two neighbouring bytes that occur inside no token of the vocabulary can never be joined by a merge. Every word
is cut between such bytes, the fragments are merged on their own and concatenated; fragments and words already
seen are looked up, frequent ones being kept in two bounded generations. Special tokens in a text become their ids, as the public library does.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from skytally.llm.common import kept, pieces, texts_of
from skytally.llm.tokens import BYTE_LEVEL, UNUSUAL, USUAL_BYTE_LEVEL, Words, byte_letters

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long"


#: Rank of a pair that is not merged.
NEVER = (1 << 60, -1)


class Vocabulary:
    """Merge table, forced cuts and byte strings of a byte-level BPE file of the tokenizers library."""

    def __init__(self, vocabulary: str):
        parts = json.loads(vocabulary)
        letters = {c: b for b, c in byte_letters().items()}
        ids = parts["model"]["vocab"]
        spelled = {t: bytes(letters[c] for c in t) for t in ids if all(c in letters for c in t)}
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.bytes_of = [b""] * (1 + max(*ids.values(), *self.special.values()))
        for token, i in ids.items():
            self.bytes_of[i] = spelled.get(token, token.encode())
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.first = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(parts["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[ids[a], ids[b]] = (rank, ids[a + b])
        joined = np.zeros(65536, bool)
        for text in spelled.values():
            if len(text) > 1:
                x = np.frombuffer(text, np.uint8).astype(np.int64)
                joined[x[:-1] * 256 + x[1:]] = True
        #: Indexed by first byte * 256 + second byte: 1 where no token has the two side by side.
        self.cut = bytes((~joined).astype(np.uint8))


class Encoder:
    """``limit`` bounds each of the two generations of words kept."""

    def __init__(self, vocabulary: Vocabulary, limit: int = 300_000):
        self.vocabulary = vocabulary
        self.find_words = regex.compile(BYTE_LEVEL).findall
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else None
        self.known = Words(self.word, limit)

    def fragments_of(self, word: bytes) -> list[bytes]:
        cut = self.vocabulary.cut
        ends = [i + 1 for i, (a, b) in enumerate(zip(word, word[1:])) if cut[a * 256 + b]]
        return [word[a:b] for a, b in zip([0, *ends], [*ends, len(word)])] if ends else [word]

    def merged(self, fragment: bytes) -> list[int]:
        """Ids of one fragment: the merge of lowest rank first, leftmost among equals."""
        merge, ids = self.vocabulary.merge, [self.vocabulary.first[b] for b in fragment]
        if len(ids) > 48:
            return self.merged_long(ids)
        ranks = [merge.get(p, NEVER) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) is not NEVER:
            i = ranks.index(best)
            ids[i:i + 2] = [best[1]]
            del ranks[i]
            if i:
                ranks[i - 1] = merge.get((ids[i - 1], best[1]), NEVER)
            if i < len(ranks):
                ranks[i] = merge.get((best[1], ids[i + 1]), NEVER)
        return ids

    def merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and linked places, for fragments where repeated search would be quadratic."""
        merge, n = self.vocabulary.merge, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(merge[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in merge]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j], after[i] = merge[pair][1], None, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n and (p := (ids[left], ids[right])) in merge:
                    heapq.heappush(heap, (merge[p][0], left, p))
        return [x for x in ids if x is not None]

    def word(self, word: str) -> bytes:
        return array("I", [i for f in self.fragments_of(word.encode()) for i in self.merged(f)]).tobytes()

    def encode(self, texts) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        self.known.trim()
        ids_of, out = self.known.__getitem__, []
        for text in texts:
            parts = []
            for i, part in enumerate(self.split_special(text or "") if self.split_special else [text or ""]):
                if i % 2:
                    parts.append(array("I", [self.vocabulary.special[part]]).tobytes())
                else:
                    parts.append(b"".join(map(ids_of, self.find_words(part) if UNUSUAL.search(part) else USUAL_BYTE_LEVEL.findall(part))))
            out.append(b"".join(parts))
        return out

    def decode(self, ids: bytes) -> str:
        """Text of the ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encoder_of(vocabulary: str) -> Encoder:
    """Encoder with the words it knows, for all tasks of a Python worker that use the same vocabulary."""
    return kept(("bpe", vocabulary), lambda: Encoder(Vocabulary(vocabulary)))


def encode_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Token count and digests of the ids and of the text decoded from them, one row per document.

    A null text counts as empty: no ids, digests of nothing. A null ``doc_id`` stays null, repeated rows stay,
    other columns of ``docs`` are left behind, an empty table gives no rows. Texts are encoded whole.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        encoder = encoder_of(shipped.value)
        for batch in pieces(batches):
            rows = []
            for ids in encoder.encode(batch.column("text").to_pylist()):
                decoded = encoder.decode(ids).encode()
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), len(decoded)))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1]), pa.array(columns[2]), pa.array(columns[3], pa.int64())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

    return texts_of(docs).mapInArrow(run, SCHEMA)


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id`` and ``ids`` of every document, for use as training data."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        encoder = encoder_of(shipped.value)
        for batch in pieces(batches):
            ids = [np.frombuffer(x, "<i4") for x in encoder.encode(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return texts_of(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id`` and ``text`` from the output of ``encoded``."""
    shipped = tokens.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        encoder = encoder_of(shipped.value)
        for batch in batches:
            texts = [encoder.decode(np.array(ids or [], "<u4").tobytes()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
