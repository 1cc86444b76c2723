"""Encoding against the tokenizers library, and token files against a plain loop."""

import hashlib
import random
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textrill.llm import bpe_automaton, token_files, units
from textrill.session import scratch_path

PARTS = (
    "a A the ing aaaa !! ... _ 's 'LL don't é É Σ ς İ ß 1 ² Ⅷ 日本 한 힣 ǅ × à, ' <|endoftext|> <|startoftext|> <|".split()
    + ["\n", "  ", " ", " ", " ", "\t", "\x1c", "\x85", "\xa0", "\n\n", " ,", "́", "​", " ", "💖"]
)
ODD = [None, "", " ", "\n", "a", "word " * 3000, "x" * 5000, "<|endoftext|>", "same text", "same text"]


def texts(n=1500):
    rng = random.Random(5)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 25))) for _ in range(n)] + [t or "" for t in ODD]


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def test_automaton_equals_the_library():
    ours, theirs, found = bpe_automaton.Codec(bpe_automaton.vocabulary_text()), library(bpe_automaton.VOCABULARY), texts()
    ids, at = ours.encode([t.encode() for t in found])
    for i, text in enumerate(found):
        want = theirs.encode(text, add_special_tokens=False).ids
        got = ids[at[i] : at[i + 1]]
        assert got.tolist() == want, text
        assert ours.decode(got) == theirs.decode(want, skip_special_tokens=False)


def test_merges_of_equal_signs_go_from_the_left():
    found = bpe_automaton.Automaton({"a": 0, "b": 1, "aa": 2, "aab": 3}, [("a", "a"), ("aa", "b")])
    assert [found.encode("a" * n) for n in range(1, 5)] == [[0], [2], [2, 0], [2, 2]]
    assert found.encode("aaab") == [2, 0, 1] and found.encode("aab") == [3]
    with pytest.raises(ValueError):
        found.encode("ac")


def test_encoder_by_units_equals_the_library():
    with open(public_tokenizers.path(token_files.VOCABULARY), encoding="utf-8") as file:
        ours = token_files.Encoder(file.read())
    theirs, found = library(token_files.VOCABULARY), texts()
    ours.units.limit = 1  # empties the table before every run
    for begin in range(0, len(found), 100):
        some = found[begin : begin + 100]
        ids, at = ours.encode([t.encode() for t in some])
        for i, text in enumerate(some):
            assert ids[at[i] : at[i + 1]].tolist() == theirs.encode(text, add_special_tokens=False).ids, text


def both():
    with open(public_tokenizers.path(token_files.VOCABULARY), encoding="utf-8") as file:
        yield token_files.Encoder(file.read()), library(token_files.VOCABULARY)
    yield bpe_automaton.Codec(bpe_automaton.vocabulary_text()), library(bpe_automaton.VOCABULARY)


def same_ids(ours, theirs, found):
    ids, at = ours.encode([t.encode() for t in found])
    for i, text in enumerate(found):
        assert ids[at[i] : at[i + 1]].tolist() == theirs.encode(text, add_special_tokens=False).ids, text[:80]


def test_words_that_share_a_digest_keep_their_own_ids():
    word = "a"
    pairs = []
    for _ in range(12):  # a Thue-Morse word and its complement share the sum whatever the base
        word += word.translate(str.maketrans("ab", "ba"))
        pairs += [word, word.translate(str.maketrans("ab", "ba"))]
    for ours, theirs in both():
        same_ids(ours, theirs, pairs)
        same_ids(ours, theirs, [" ".join(pairs[:20])] * 2)


@pytest.mark.parametrize("kinds", [1, 3])
def test_a_table_in_which_all_digests_collide(monkeypatch, kinds):
    monkeypatch.setattr(units, "hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(kinds) + np.uint64(1))
    for ours, theirs in both():
        same_ids(ours, theirs, texts(200))


def test_pieces_end_where_units_do(monkeypatch):
    monkeypatch.setattr(units, "RUN", 64)
    monkeypatch.setattr(units, "LONG_UNIT", 20)
    found = ["".join(texts(400)), "日本 한국 " * 50, "x" * 300 + " y", "é" * 200]
    for text in found:
        cut = list(units.pieces(text.encode(), 64))
        assert b"".join(cut) == text.encode()
    for ours, theirs in both():
        same_ids(ours, theirs, found)


LONG_TEXT = """
import resource, sys, public_tokenizers, pyarrow as pa
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
from textrill.llm import bpe_automaton, token_files
part = " ".join(f"Words of, the {'abcdefghij'[i % 10] * 3}{'klmnop'[i % 6]} {i % 7} texts" for i in range(40_000)) + " "
data = bytearray()
while len(data) < 50 << 20:
    data += part.encode()
text = pa.Array.from_buffers(pa.string(), 1, [None, pa.array([0, len(data)], pa.int32()).buffers()[1], pa.py_buffer(data)])
batch = pa.RecordBatch.from_arrays([pa.array([1]), text], ["doc_id", "text"])
if sys.argv[1] == "op2":
    (got,) = bpe_automaton.coded_batches(bpe_automaton.Codec(bpe_automaton.vocabulary_text()), iter([batch]))
else:
    encoder = token_files.Encoder(open(public_tokenizers.path(token_files.VOCABULARY), encoding="utf-8").read())
    (got,) = token_files.encoded_batches(encoder, iter([batch]), 2)
print(batch.nbytes >> 20, got.num_rows, peak())
"""


@pytest.mark.parametrize("name", ["op2", "op10"])
def test_a_text_of_50_mb_takes_bounded_memory(name):
    told = subprocess.run([sys.executable, "-c", LONG_TEXT, name], capture_output=True, text=True, check=True, timeout=600)
    size, count, peak = map(int, told.stdout.split())
    assert size >= 49 and count == 1 and peak < 500


def test_all_documents_equal_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tokens = token_files.encoded(docs, open(public_tokenizers.path(token_files.VOCABULARY), encoding="utf-8").read(), None)
    found = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    coded = bpe_automaton.encode_decode(docs).select("doc_id", "ids").collect()
    words, bytes_ = library(bpe_automaton.VOCABULARY), library(token_files.VOCABULARY)
    assert len(coded) == len(found)
    for r in coded:
        assert np.frombuffer(r["ids"], "<u4").tolist() == words.encode(found[r["doc_id"]], add_special_tokens=False).ids
    for r in tokens.select("doc_id", "ids").collect():
        assert r["ids"] == bytes_.encode(found[r["doc_id"]], add_special_tokens=False).ids


def rows(spark):
    found = [(i if i != 4 else None, t, "x") for i, t in enumerate(ODD)] + [(9, "same text", "x")]
    return spark.createDataFrame(found, "doc_id long, text string, ids string")


def test_digests_of_odd_rows(spark):
    got = bpe_automaton.digests(bpe_automaton.encode_decode(rows(spark))).collect()
    theirs = library(bpe_automaton.VOCABULARY)
    want = []
    for r in rows(spark).collect():
        ids = theirs.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((
            r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest(),
        ))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe_automaton.encode_decode(rows(spark).limit(0)).count() == 0


def test_token_files_round_trip(spark):
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(rows(spark), path)
    read = token_files.read_tokens(spark, path)
    got = token_files.starts(token_files.id_checksums(read)).orderBy("start").collect()
    theirs, at = library(token_files.VOCABULARY), 0
    texts_of = {}
    for r in rows(spark).collect():
        texts_of.setdefault(r["doc_id"], set()).add(r["text"] or "")
    assert [r["doc_id"] for r in got] == sorted([r["doc_id"] for r in got], key=lambda x: (x is not None, x))
    for r in got:
        sums = {zlib.crc32(np.array([*theirs.encode(t, add_special_tokens=False).ids, 2], "<u4")) for t in texts_of[r["doc_id"]]}
        assert r["start"] == at and r["ids_crc32"] in sums
        at += r["n_tokens"]
    assert len(got) == rows(spark).count()
    empty = scratch_path(spark, "tokens")
    token_files.write_tokens(rows(spark).limit(0), empty)
    assert token_files.starts(token_files.id_checksums(token_files.read_tokens(spark, empty))).count() == 0
