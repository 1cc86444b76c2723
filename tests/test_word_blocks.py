"""Words of blocks of texts met with tables of words, against plain sums over rows made here."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from textrill.config import JoinPolicy
from textrill.operators import mutual_info, tfidf, wordvec

ROWS = [
    (0, 1, "a", ["x", "y", "x"]), (0, 1, "a", ["x"]), (0, 2, "b", []), (0, 3, "b", None), (0, None, "a", ["z", "z"]),
    (0, None, "a", ["z", "x"]), (1, 1, "a", ["x", ""]), (1, 4, "b", ["q"] * 300), (1, 5, "b", ["y", "unknown"]),
]


def docs(spark):
    return spark.createDataFrame(ROWS, "batch INT, id BIGINT, y STRING, tokens ARRAY<STRING>").repartition(3)


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("buckets", [None, 1 << 20])
def test_tfidf_by_batch_without_a_row_per_word_and_join(spark, buckets):
    found = tfidf.tfidf_by_batch(docs(spark), buckets)
    assert "Generate" not in plan(found)
    got = {(r["batch"], r["id"], r["idx"]): r["v"] for r in found.collect()}
    counts, texts, sizes = defaultdict(Counter), Counter(), Counter()
    for batch, i, _, tokens in ROWS:
        sizes[batch] += 1
        counts[batch, i].update(tokens or ())
        texts.update((batch, t) for t in set(tokens or ()))
    want = {(*k, t): n * math.log((sizes[k[0]] + 1) / (texts[k[0], t] + 1)) for k, c in counts.items() for t, n in c.items()}
    empty = {k: v for k, v in got.items() if k[2] is None}
    assert empty == {(0, 2, None): 0.0, (0, 3, None): 0.0}
    if buckets is None:
        assert {k: v for k, v in got.items() if k[2] is not None} == pytest.approx(want)
    else:
        assert sorted(v for k, v in got.items() if k[2] is not None) == pytest.approx(sorted(want.values()))


def test_vectors_beyond_the_bound_meet_the_words_of_blocks(spark):
    words = spark.createDataFrame(
        [("x", [1.0, 2.0], "b"), ("y", [0.5], "b"), ("q", [3.0, None], "b"), ("z", None, "b"), (None, [9.0, 9.0], "b")],
        "word STRING, vec ARRAY<FLOAT>, origin STRING",
    )
    none = wordvec.document_vectors(docs(spark).where("id = 3"), words, 2, policy=JoinPolicy(broadcast_bytes=0))
    assert [list(r["features"]) for r in none.collect()] == [[0.0, 0.0]]
    found = wordvec.document_vectors(docs(spark), words, 2, ["batch"], JoinPolicy(broadcast_bytes=0))
    assert "posexplode" not in plan(found)
    got = sorted((r["batch"], r["id"] or 0, *r["features"]) for r in found.collect())
    # rows that share keys and size are one text, the others stay apart
    want = sorted([
        (0, 1, 2.5 / 3, 4 / 3), (0, 1, 1.0, 2.0), (0, 2, 0.0, 0.0), (0, 3, 0.0, 0.0), (0, 0, 0.5, 1.0),
        (1, 1, 0.5, 1.0), (1, 4, 3.0, 0.0), (1, 5, 0.25, 0.0),
    ])
    assert np.allclose(got, want)


def test_weights_and_weighted_vectors_read_the_texts_in_blocks(spark):
    weights = mutual_info.word_weights(docs(spark))
    got = {(r["y"], r["word"]): r["mi"] for r in weights.collect()}
    tokens = [(y, t) for _, _, y, ts in ROWS for t in ts or ()]
    texts = Counter((y, t) for _, _, y, ts in ROWS for t in set(ts or ()))
    of_word, of_class = Counter(t for _, t in tokens), Counter(y for _, _, y, _ in ROWS)
    want = {
        (y, t): of_class[y] / 9 * math.log2(n / 9 / (of_word[t] / len(tokens) * of_class[y] / 9)) for (y, t), n in texts.items()
    }
    assert got == pytest.approx(want)
    vectors = spark.createDataFrame([("x", [1.0]), ("z", [2.0])], "word STRING, vec ARRAY<FLOAT>")
    rows = mutual_info.weighted_vectors(docs(spark), vectors, weights, 1)
    assert "posexplode" not in plan(rows) and "explode" not in plan(rows)
    found = sorted((r["id"] or 0, r["y"], round(r["features"][0], 9)) for r in rows.collect())
    x, y, z, empty = (want["a", t] for t in ("x", "y", "z", ""))
    expected = [
        (1, "a", 2 * x / (2 * x + y) / 3), (1, "a", 1.0), (2, "b", 0.0), (3, "b", 0.0), (0, "a", (6 * z + x) / (3 * z + x) / 2),
        (1, "a", x / (x + empty) / 2), (4, "b", 0.0), (5, "b", 0.0),
    ]
    assert np.allclose([r[2] for r in found], [r[2] for r in sorted((i, y, round(v, 9)) for i, y, v in expected)])
