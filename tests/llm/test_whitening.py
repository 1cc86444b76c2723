"""Whitening against a plain eigendecomposition."""

import numpy as np
import pytest

from textrill.llm import whitening
from textrill.llm.common import table


def plain(vectors):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], np.int64)
    n, sums = len(x), x.sum(axis=0)
    y = (n * x - sums) / n
    values, found = np.linalg.eigh(y.T @ y / n)
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return n, deviation, y, values[::-1], found[:, ::-1]


def compare(rows, vectors, ids, k):
    n, deviation, y, values, found = plain(vectors)
    by_row = {}
    for r in rows:
        by_row.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(rows) == len(ids) * k and len(by_row) == len(set(ids))
    got = np.array([[by_row[i][c]["whitened"] for c in range(1, k + 1)] for i in ids])
    want = y @ found[:, :k] / np.sqrt(values[:k])
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got * sign - want).max() < 1e-8
    for i, want_deviation in zip(ids, deviation, strict=True):
        r = by_row[i][1]
        assert r["n"] == n and r["deviation"] == want_deviation and r["identity_error"] < 1e-10
    assert np.allclose([by_row[ids[0]][c]["explained"] for c in range(1, k + 1)], values[:k] / values.sum(), rtol=1e-10)


def test_all_vectors_of_a_table_equal_the_plain_components(spark, small):
    rows = table(spark, small, "embeddings").collect()
    got = whitening.op13_lanczos_whitening(spark, small).collect()
    compare(got, [r["embedding"] for r in rows], [r["vec_id"] for r in rows], 32)


@pytest.mark.parametrize("kind", ["repeated", "thin", "steep"])
def test_spectra_that_end_a_recurrence(spark, kind):
    rng = np.random.default_rng(3)
    if kind == "repeated":  # every deviation twice or more: one start vector meets each only once
        half = np.vstack([np.eye(6), -np.eye(6)]) * np.array([4, 4, 2, 2, 2, 1])
        vectors = np.vstack([half, half])
        k = 6
    elif kind == "thin":  # fewer rows than dimensions
        vectors, k = rng.standard_normal((5, 9)), 4
    else:
        vectors, k = rng.standard_normal((400, 12)) * 10.0 ** -np.linspace(0, 2.5, 12) * 50, 12
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = whitening.whiten_table(docs).collect()
    n, deviation, y, values, _ = plain(vectors)
    assert len(got) == len(vectors) * k
    w = np.zeros((len(vectors), k))
    for r in got:
        w[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviation[r["vec_id"]]
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-9
    explained = {r["component"]: r["explained"] for r in got}
    assert np.allclose([explained[c] for c in range(1, k + 1)], values[:k] / values.sum(), rtol=1e-9)
    # components span what the plain ones span, also where deviations repeat
    assert np.allclose(w @ np.diag(values[:k]) @ w.T, y @ y.T, atol=1e-7 * values[0] * n)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 3), float(i % 5), 1.0], "x") for i in range(40)]
    rows += [(40, None, "x"), (41, [1.0, None, 2.0], "x"), (42, [1.0, nan, 2.0], "x"), (43, [inf, 1.0, 2.0], "x")]
    rows += [(44, [], "x"), (45, [1.0], "x"), (46, [0.0, 0.0, 0.0], "x"), (None, [1.0, 2.0, 1.0], "x"), (3, [0.0, 3.0, 1.0], "x")]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string")
    got = whitening.whiten_table(docs).collect()
    assert len(got) == 43 * 3 and got[0]["n"] == 43
    assert sorted({r["vec_id"] for r in got if r["vec_id"] is not None}) == [*range(40), 46]
    assert sum(r["vec_id"] is None for r in got) == 3 and sum(r["vec_id"] == 3 for r in got) == 6
    assert whitening.whiten_table(docs.limit(0)).count() == 0
    same = docs.where("vec_id = 5").unionAll(docs.where("vec_id = 20"))
    assert whitening.whiten_table(same).count() == 0  # equal rows have no component


def test_entries_beyond_long(spark):
    docs = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten_table(docs).collect()
    assert {r["vec_id"] for r in got} == {1, 2, 3} and all(np.isfinite(r["whitened"]) for r in got)
    assert {r["vec_id"]: r["deviation"] is None for r in got} == {1: True, 2: True, 3: False} or all(r["n"] == 3 for r in got)
