"""Token ids, packing and token files against the library itself."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanloom.llm import packing, token_store, tokens
from spanloom.llm.queries import QUERIES

WORD, BYTE = tokens.vocabulary_path(packing.VOCABULARY), tokens.vocabulary_path(token_store.VOCABULARY)
ODD = ["", " ", "\n", "  ", "a ", "a\n", "\na", " a", "a.\nb", "it's we'll. don't,", "a  b", "xİ, y", "ΣΣ. é", "!!! a", "<|endoftext|>", "\r\n\tz", "日本 語.",
       "x<|endoftext|>", "a <|startoftext|> b", "<|endoftext|", "a©b © c. ©", "w" * 70 + ". " + "w" * 70, "\n", "a \n", "\n.", "q. r, s.. t.,"]


def library(path, texts, end):
    own = Tokenizer.from_file(path)
    return [own.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def texts_for(seed, n):
    rng = random.Random(seed)
    letters = list("ab,.'!é ß\n\t  12  \x1c\x85ÉİΣ日<|>́\r\x0b×÷ÿ\u2003\u2028\u3000\u1680\u202f\u205f’")
    plain = [" ".join(rng.choice(["é.", "ß,", "×.", "a.", "÷,", "ç", "b’,", "nö..", "\nz"]) for _ in range(rng.randrange(9))).replace(" \n", "\n") for _ in range(n)]
    return ODD + plain + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("memory", [5, 400_000])
def test_ids_are_the_librarys(monkeypatch, memory):
    monkeypatch.setattr(tokens, "MEMORY_WORDS", memory)
    texts = texts_for(1, 3000)
    for _ in range(2):
        for kind, path, given in ((tokens.ByteWords, BYTE, texts), (tokens.SpacedWords, WORD, [t.encode() for t in texts])):
            own = kind(path)
            got = [i.tolist() for a in range(0, len(given), 100) for i in own.ids(given[a : a + 100])]
            assert got == [i[:-1] for i in library(path, texts, 0)]


def test_words_that_share_a_hash_keep_their_ids(monkeypatch):
    """With few first hashes the second one tells words apart."""
    whole = tokens.hash_spans
    monkeypatch.setattr(tokens, "hash_spans", lambda *given: (whole(*given)[0] % np.uint64(7), whole(*given)[1]))
    texts = texts_for(5, 500)
    own = tokens.SpacedWords(WORD)
    for _ in range(2):
        got = [i.tolist() for a in range(0, len(texts), 50) for i in own.ids([t.encode() for t in texts[a : a + 50]])]
        assert got == [i[:-1] for i in library(WORD, texts, 0)]


def check_packing(rows, room):
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    filled = {}
    for sequence, offset, length in places:
        assert offset == filled.get(sequence, 0)
        filled[sequence] = offset + length
        assert filled[sequence] <= room
    assert sorted(filled) == list(range(len(filled)))
    return filled


def test_patterns_place_everything():
    rng = random.Random(4)
    for room in (1, 7, 64, 2048):
        for _ in range(20):
            histogram = {rng.randrange(1, room + 1): rng.randrange(1, 500) for _ in range(rng.randrange(1, 40))}
            patterns = packing.patterns_for(histogram, room)
            placed = {}
            for p in patterns:
                assert p.count > 0 and 0 < sum(p.lengths) <= room
                for n in p.lengths:
                    placed[n] = placed.get(n, 0) + p.count
            assert placed == histogram
    assert [(p.count, p.lengths) for p in packing.patterns_for({3: 7}, 10)] in (
        [(1, [3]), (2, [3, 3, 3])], [(2, [3, 3, 3]), (1, [3])],
    )
    with pytest.raises(ValueError):
        packing.patterns_for({11: 1}, 10)


def test_packing_of_odd_rows(spark, documents):
    texts = [*texts_for(2, 200), None, "word " * 9000, "same", "same"]
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(None, "no id")]
    got = packing.pack(documents(rows, clashing=True), WORD, room=64, bucket_rows=10).collect()
    filled = check_packing(got, 64)
    want = [(d, ids) for (d, _), ids in zip(rows, library(WORD, [t for _, t in rows], 1))]
    assert sum(filled.values()) == sum(len(ids) for _, ids in want)
    pieces = sorted(((d, s, len(ids[s : s + 64]), crc(ids[s : s + 64]), len(ids)) for d, ids in want for s in range(0, len(ids), 64)), key=str)
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got), key=str) == pieces
    assert packing.pack(documents(rows).filter(F.lit(False)), WORD).count() == 0


def test_packing_query(spark, small_dir):
    rows = QUERIES["op5_pack"](spark, small_dir).collect()
    filled = check_packing(rows, 2048)
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").orderBy("doc_id").collect()
    want = library(WORD, [d.text for d in docs], 1)
    assert {(r.doc_id, r.start): (r.length, r.ids_crc32, r.doc_tokens) for r in rows} == {
        (d.doc_id, s): (len(ids[s : s + 2048]), crc(ids[s : s + 2048]), len(ids)) for d, ids in zip(docs, want) for s in range(0, len(ids), 2048)
    }
    total = sum(filled.values())
    assert 1 - total / (2048 * len(filled)) < 0.02


def test_grammar_round_trip():
    rng = np.random.default_rng(6)
    phrase = rng.integers(0, 50_257, 30)
    for n_docs in (1, 5, 60):
        docs = [np.concatenate([*(phrase[: rng.integers(1, 30)] for _ in range(rng.integers(0, 40))), rng.integers(0, 50_257, 3), [0]]) for _ in range(n_docs)]
        docs = [d.astype(np.uint16) for d in docs]
        ids = [None if i == 0 else i * 7 for i in range(n_docs)]
        data = token_store.write_block(ids, docs)
        block = token_store.Block(data)
        assert block.doc_ids == ids
        assert all((a == b).all() for a, b in zip(block.documents(), docs, strict=True))
        for n, doc in enumerate(docs):
            a, b = sorted(rng.integers(0, len(doc) + 1, 2))
            assert (block.tokens(n, a, b) == doc[a:b]).all() and (block.tokens(n) == doc).all()
        if n_docs == 60:
            assert len(block.rules) and len(data) < sum(map(len, docs))
    with pytest.raises(ValueError):
        token_store.Block(b"x" * 64)


def check_files(got, docs, end=0):
    """``docs``: (id, text) in file order."""
    start, want = 0, []
    for (name, _), ids in zip(docs, library(BYTE, [t for _, t in docs], end)):
        want.append((name, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_files_of_odd_rows(spark, documents, tmp_path):
    texts = [*texts_for(3, 100), None, "many words " * 3000]
    rows = [(1000 - i // 3, t) for i, t in enumerate(texts)] + [(None, "b"), (None, None)]
    folder = str(tmp_path / "files")
    docs = documents(rows, clashing=True)
    token_store.write_tokens(docs, BYTE, folder, block_ids=500, shard_bytes=2000)
    got = token_store.read_tokens(spark, folder).collect()
    def place(r):
        return (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())

    check_files(got, sorted(rows, key=place))
    empty = token_store.encode_corpus(docs.filter(F.lit(False)), BYTE, str(tmp_path / "empty"))
    assert empty.count() == 0


def test_files_query(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").orderBy("doc_id").collect()
    check_files(QUERIES["op7_token_files"](spark, small_dir).collect(), [(d.doc_id, d.text) for d in docs])
