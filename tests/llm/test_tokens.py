"""Token files, BPE and packing against the public tokenizers library."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from skytally.llm import bpe, packing, queries, token_files
from skytally.llm.tokens import WordEncoder

ODD = [
    None, "", " ", "\n\n", "a", "Hello  world", "it's I'LL we've  x\t\ty z ", "<|endoftext|>", "a<|endoftext|> b <|startoftext|>c", "ÄÖÜ ß İstanbul",
    "été ½ ² 12345", "\x1c\x1d a\x85b c", "日本語 テキスト 🙂🙂 ไทย", "x" * 3000, "ab" * 1500 + "!?" * 400, "!!!''s're", " ​﻿",
    "ΣΑΣ ς", "a\x00b", "­İ", "tail   ", "123456 7 88", "“quoted” – dash… €5",
]


def library(name):
    out = Tokenizer.from_str(queries.vocabulary_file(name))
    out.no_truncation()
    out.no_padding()
    return out


def frame(spark, texts):
    rows = [(i if i else None, t, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(3)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_give_the_library_ids(name):
    mine, theirs = WordEncoder(queries.vocabulary_file(name)), library(name)
    for text, ids in zip(ODD, mine.encode(ODD), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_own_bpe_on_odd_texts(spark):
    theirs = library("byte_bpe_50k.json")
    got = {r["doc_id"]: r for r in bpe.encode_decode(frame(spark, ODD), queries.vocabulary_file("byte_bpe_50k.json")).collect()}
    assert len(got) == len(ODD)
    for i, text in enumerate(ODD):
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        row = got[i if i else None]
        assert row["n_tokens"] == len(ids), repr(text)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), repr(text)
        assert row["decoded_sha256"] == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest(), repr(text)


def test_bpe_round_trip(spark):
    vocabulary = queries.vocabulary_file("byte_bpe_50k.json")
    back = bpe.decoded(bpe.encoded(frame(spark, ODD), vocabulary), vocabulary)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {(i or None): (t or "") for i, t in enumerate(ODD)}


def test_long_fragments_merge_alike():
    vocabulary = bpe.Vocabulary(queries.vocabulary_file("byte_bpe_50k.json"))
    encoder = bpe.Encoder(vocabulary)
    for text in ["the" * 15, "aaaaaaaabbaaaa" * 3, "ionationing" * 4]:
        ids = [vocabulary.first[b] for b in text.encode()]
        assert encoder.merged_long(ids) == encoder.merged(text.encode())


def expected_files(rows):
    theirs, start, out = library("word_bpe_49k.json"), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = theirs.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, folder):
    docs = queries.documents(spark, folder)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = queries.op1_token_files(spark, folder)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, out.collect())) == sorted(expected_files(rows))


def test_token_files_odd_rows(spark, tmp_path):
    docs = frame(spark, [*ODD, *ODD[:3]])
    out = token_files.token_files(docs, str(tmp_path / "a"), queries.vocabulary_file("word_bpe_49k.json"), 1)
    key = lambda r: (r[1], r[0] or -1)
    got = sorted((tuple(r) for r in out.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=key)
    assert got == sorted(expected_files([(r["doc_id"], r["text"]) for r in docs.collect()]), key=key)
    empty = token_files.token_files(docs.limit(0), str(tmp_path / "b"), queries.vocabulary_file("word_bpe_49k.json"), 1)
    assert empty.collect() == []


def test_files_can_be_read_in_parts(spark, tmp_path):
    import pyarrow.parquet as pq

    docs = spark.range(4000).selectExpr("id as doc_id", "concat('some words of document ', id) as text").coalesce(1)
    options = token_files.file_options(row_group_bytes=64 << 10, page_bytes=8 << 10, page_rows=200)
    token_files.write_tokens(docs, str(tmp_path / "t"), queries.vocabulary_file("word_bpe_49k.json"), 1, options)
    for file in (tmp_path / "t").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
        ids = next(v for k, v in columns.items() if k.startswith("ids"))
        assert any("DICTIONARY" in e for e in ids.encodings) and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
        assert ids.has_column_index or ids.has_offset_index
    one = token_files.read_tokens(spark, str(tmp_path / "t")).where("doc_id = 77").select("n_tokens")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)]" in one._jdf.queryExecution().toString()
    assert one.count() == 1


def check_packing(rows, texts, capacity):
    theirs, sequences, per_doc = library("byte_bpe_50k.json"), defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        per_doc[r["doc_id"]].append(r)
    for parts in sequences.values():
        place = 0
        for offset, length in sorted(parts):
            assert offset == place and length > 0
            place += length
        assert place <= capacity
    for doc, text in texts.items():
        ids = np.array(theirs.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        parts = sorted(per_doc[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts))) == list(range(-(-len(ids) // capacity)))
        place = 0
        for r in parts:
            assert r["start"] == place and r["ids_crc32"] == zlib.crc32(ids[place:place + r["length"]].tobytes())
            assert r["length"] == capacity or r["piece"] == 0
            place += r["length"]
        assert place == len(ids)
    return len(sequences), sum(r["length"] for r in rows)


def test_packing_query(spark, folder):
    texts = {r["doc_id"]: r["text"] for r in queries.documents(spark, folder).collect()}
    used, tokens = check_packing(queries.op4_packing(spark, folder).collect(), texts, 2048)
    assert used <= -(-tokens // 2048) + 1


def test_packing_odd_rows(spark):
    vocabulary = queries.vocabulary_file("byte_bpe_50k.json")
    docs = frame(spark, ODD)
    check_packing(packing.pack(docs, vocabulary, 64, 0).collect(), {(i or None): t for i, t in enumerate(ODD)}, 64)
    assert packing.pack(docs.limit(0), vocabulary, 64, 0).collect() == []
    again = packing.pack(docs.union(docs), vocabulary, 64, 0).collect()
    assert sum(r["length"] for r in again) == 2 * sum(r["length"] for r in packing.pack(docs, vocabulary, 64, 0).collect())


def test_patterns_are_the_fullest():
    import itertools
    import random

    draw = random.Random(7)
    for _ in range(200):
        lengths = [draw.randint(1, 12) for _ in range(draw.randint(1, 9))]
        room = draw.randint(1, 30)
        best = max(s for k in range(len(lengths) + 1) for c in itertools.combinations(lengths, k) if (s := sum(c)) <= room)
        chosen = packing.fullest({x: lengths.count(x) for x in lengths}, room)
        assert sum(x * n for x, n in chosen.items()) == best
        assert all(lengths.count(x) >= n for x, n in chosen.items())
