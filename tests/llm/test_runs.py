"""Periodic runs against a search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from textrill.llm import periodic_runs as pr
from textrill.llm.common import table


def plain_runs(words):
    """Per period the maximal stretches of words that equal the one a period behind; the smallest period of each counts."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                best.setdefault((i, j + q - i), q)
            i = j
    # a multiple of a smaller period isn't the smallest period of its stretch
    return sorted((s, length, q) for (s, length), q in best.items() if not any(words[s : s + length - r] == words[s + r : s + length] for r in range(1, q)))


def plain_kept(words, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def sequences():
    rng = random.Random(11)
    for _ in range(400):
        yield [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 60))]
    for _ in range(200):  # repeated stretches at all distances, some broken
        unit = [rng.randrange(4) for _ in range(rng.randint(1, 9))]
        yield [rng.randrange(6) for _ in range(9)] + (unit * 9)[: rng.randint(1, 70)] + unit[::-1] * 2 + (unit * 9)[3 : rng.randint(4, 60)]
    a, b = "a", "b"
    for _ in range(8):  # Fibonacci words are rich in runs
        a, b = a + b, a
        yield [ord(c) for c in a]


def test_runs_equal_all_periods():
    some = list(sequences())
    got = pr.runs_of([np.array(w, np.int64) for w in some])
    total = 0
    for words, runs in zip(some, got, strict=True):
        assert list(map(tuple, runs.tolist())) == plain_runs(words), words
        total += len(runs)
    assert total > 500


def test_large_sets_of_positions(monkeypatch):
    monkeypatch.setattr(pr, "CHUNK", 3)
    for words in ([0] * 500, [0, 1] * 300, [0, 0, 1] * 100 + [0] * 90):
        (got,) = pr.runs_of([np.array(words, np.int64)])
        assert list(map(tuple, got.tolist())) == plain_runs(words)
    assert pr.runs_of([np.zeros(200_000, np.int64)])[0].tolist() == [[0, 200_000, 1]]


def expected(doc_id, text, planted):
    words = [w for w in (text or "").encode().split()]
    digest = zlib.crc32(str(doc_id).encode())
    n, g = len(words), digest // 10
    if planted and doc_id is not None and digest % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    top = min(((-length, s, q) for s, length, q in runs), default=None)
    told = (None,) * 4 if top is None else (top[1], -top[0], top[2], 1000 * -top[0] // top[2])
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(plain_kept(words, runs))
    return (doc_id, len(runs), *told, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_equals_all_periods(spark, small):
    rows = table(spark, small, "documents").where("length(text) < 6000").select("doc_id", "text").collect()
    got = {tuple(r) for r in pr.op12_descending_lcp_runs(spark, small).collect()}
    want = {expected(r["doc_id"], r["text"], True) for r in rows}
    assert len(rows) > 150 and want <= got and len(got) == table(spark, small, "documents").count()


def test_words_of_a_text_in_pieces(monkeypatch):
    text = "é ü\tword\n" * 50 + "x" * 40 + " end"
    whole = pr.Words().of(text.encode())
    monkeypatch.setattr(pr, "PIECE", 7)
    cut = pr.Words()
    assert cut.of(text.encode()).tolist() == whole.tolist() and cut.texts([whole]) == [b" ".join(text.encode().split())]


def test_odd_rows(spark):
    texts = [None, "", " \n", "a", "x " * 12, "x\ty\n" * 6, "é ü " * 7 + "é", "same same " * 9, "same same " * 9, "a b c d e f g " * 300 + "z"]
    rows = [(i if i != 3 else None, t, i) for i, t in enumerate(texts)] + [(4, "x " * 11, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs long")
    got = pr.digest_columns(pr.periodic_runs(docs)).collect()
    want = [expected(r[0], r[1], False) for r in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert pr.periodic_runs(docs.limit(0)).count() == 0
