"""Near duplicates, components and search against brute force."""

import re

import numpy as np
from pyspark.sql import functions as F

from textrill.llm import embedding_dedup, onebit_search, shingle_dedup
from textrill.llm.common import blocks, components, extended, table


def least(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components_of_a_chain_a_star_and_a_pair(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and len({got[i] for i in range(100, 160)}) == 1
    assert got[200] == got[201] and len(set(got.values())) == 3 and 300 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_extended_by_edges(spark):
    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    first = [(i, i + 1) for i in range(0, 40, 2)] + [(50, 51)]
    more = [(i, i + 2) for i in range(0, 20, 2)] + [(51, 60), (70, 71), (70, 70), (0, 1)]
    got = {r["node"]: r["root"] for r in extended(components(frame(first)), frame(more)).collect()}
    want = {r["node"]: r["root"] for r in components(frame(first + more)).collect()}
    groups = lambda found: {frozenset(n for n in found if found[n] == r) for r in found.values()}
    assert got.keys() == want.keys() and groups(got) == groups(want)
    for old, new in (([], more), (first, [])):
        got = {r["node"]: r["root"] for r in extended(components(frame(old)), frame(new)).collect()}
        assert groups(got) == groups({r["node"]: r["root"] for r in components(frame(old + new)).collect()})


def test_blocks_bring_every_pair_together_once(spark):
    members = spark.createDataFrame([("x", i) for i in range(50)] + [("y", 1), ("z", 7), ("z", 8)], "bucket string, key long")
    met = {}
    groups = {}
    for r in blocks(members, ["bucket"], "key", 10).collect():
        groups.setdefault((r["bucket"], r["lo"], r["hi"]), []).append((r["key"], r["part"]))
    for (bucket, lo, hi), rows in groups.items():
        for a, p in rows:
            for b, q in rows:
                if a < b and sorted((p, q)) == [lo, hi]:
                    met[bucket, a, b] = met.get((bucket, a, b), 0) + 1
    assert met == {("x", a, b): 1 for a in range(50) for b in range(a + 1, 50)} | {("z", 7, 8): 1}


def shingled(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def test_shingle_groups_equal_brute_force(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    base = " ".join(f"w{i}" for i in range(200))
    edited = [base.replace(f"w{i} ", f"v{i} ") for i in range(5, 190, 6)]
    odd = [None, "", " \n", "one", "ONE", "two words", "a\x0bb", base, base, *edited, "z " * 20000]
    docs += [(10_000 + i, t) for i, t in enumerate(odd)]
    sets = [shingled(t) for _, t in docs]
    edges = [
        (i, j) for i, a in enumerate(sets) for j in range(i)
        if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j])
    ]
    want = {docs[i][0]: (len(sets[i]), docs[c][0], c == i) for i, c in enumerate(least(len(docs), edges))}
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, key int")
    got = {r["doc_id"]: tuple(r)[1:] for r in shingle_dedup.near_duplicates(frame).collect()}
    assert got == want and sum(not v[2] for v in want.values()) > 30
    no_id = frame.limit(2).unionAll(spark.createDataFrame([(None, base, 1)], frame.schema))
    kept = shingle_dedup.deduplicate(no_id.unionAll(no_id.where("doc_id IS NOT NULL")))
    assert kept.columns == frame.columns and kept.where("doc_id IS NULL").count() == 1
    assert shingle_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_one_document_of_each_group_where_ids_repeat(spark):
    said = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcd"}
    near = said["a"].replace("a59", "z")
    rows = [
        (7, said["a"], "x"), (7, said["b"], "x"),  # two unlike texts of one id, both first of their groups
        (3, said["c"], "x"), (7, said["c"], "y"),  # id 7 is also on a text that is rejected for 3
        (7, near, "x"), (9, said["a"], "x"),  # near copies, one with the same id
        (7, said["b"], "w"), (7, said["b"], "w"),  # rows that repeat
        (5, None, "x"), (5, said["d"], "x"), (5, "", "x"), (None, said["a"], "x"), (None, said["a"], "x"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, `so.urce` string")
    again = spark.createDataFrame(rows[::-1], frame.schema).repartition(5)
    one, two = (sorted(map(tuple, shingle_dedup.deduplicate(f).collect()), key=str) for f in (frame, again))
    of_a = [r for r in one if r[0] == 7 and r[1] in (said["a"], near)]
    assert one == two and len(of_a) == 1 and not [r for r in one if r[0] == 9]
    assert sorted((r for r in one if r not in of_a), key=str) == sorted(
        [(7, said["b"], "w"), (3, said["c"], "x"), (5, "", "x"), (5, said["d"], "x"), (None, said["a"], "x"), (None, said["a"], "x")], key=str
    )


def test_pruning_bound_is_the_posterior():
    need = shingle_dedup.least_agreements()
    assert need[0] == 0 and need[96] < 72 and all(a <= b for a, b in zip(need, need[1:], strict=False))
    same = np.ones((1, shingle_dedup.HASHES), np.int32)
    assert list(shingle_dedup.surviving(same, same)) == [0] and not len(shingle_dedup.surviving(same, same + 1))


def vectors(spark, small):
    rows = table(spark, small, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    near = rows.where("id < 30").select((F.col("id") + 5000).alias("id"), F.transform("vec", lambda x, i: F.when(i == 3, x + 0.05).otherwise(x)).cast("array<float>").alias("vec"))
    copies = rows.where("id < 10").withColumn("id", F.col("id") + 7000)
    odd = spark.createDataFrame(
        [(9000, None), (9020, []), (9040, [0.0] * 64), (9060, [float("nan")] * 64), (9080, [None] * 64), (None, [1.0] * 64), (9100, [1.0, 2.0]), (9120, [2.0, 4.0])],
        "id long, vec array<float>",
    )
    return rows.unionAll(near).unionAll(copies).unionAll(odd)


def test_vector_groups_equal_brute_force(spark, small):
    frame = vectors(spark, small)
    rows = sorted(((r["id"], r["vec"]) for r in frame.collect()), key=lambda r: (r[0] is None, r[0]))
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v) for _, v in rows]
    edges = []
    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if ok[i] and ok[j] and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                if x @ y >= 0.9 * np.sqrt(x @ x) * np.sqrt(y @ y) - 1e-15:
                    edges.append((i, j))
    comp = least(len(rows), edges)
    links = [sum(i in e for e in edges) for i in range(len(rows))]
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(frame).collect()}
    assert len(got) == len(rows) and got.pop(None)[1:] == (None, True)
    assert got == {rows[i][0]: (links[i], rows[comp[i]][0], comp[i] == i) for i in range(len(rows)) if rows[i][0] is not None}
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_error_bound_of_the_codes_holds():
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((20000, 64)), rng.standard_normal((50, 64))
    q /= np.sqrt((q * q).sum(axis=1))[:, None]
    bits, length, fit = onebit_search.codes(x)
    code = np.unpackbits(bits, axis=1, count=64) * 2.0 - 1.0
    estimate = q @ onebit_search.rotation(64).T @ code.T * (length / (fit * np.sqrt(64)))
    error = onebit_search.WIDTH * np.sqrt(1 - fit * fit) / fit / np.sqrt(63) * length
    assert (np.abs(q @ x.T - estimate) > error).mean() < 0.001


def test_nearest_equal_brute_force(spark, small):
    frame = vectors(spark, small)
    found = onebit_search.index(frame)
    got = {}
    for r in onebit_search.nearest(found.where("id % 20 = 0"), found, 20, "<f4").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    rows = [(r["id"], np.array(r["vec"], float)) for r in frame.collect() if r["id"] is not None and r["vec"] and None not in r["vec"] and np.isfinite(r["vec"]).all() and any(r["vec"])]
    hits = total = 0
    for i, q in rows:
        if i % 20 == 0:
            near = sorted((-(q * v).sum(), j) for j, v in rows if j != i and len(v) == len(q))[:20]
            hits += len({j for _, j in near} & set(got.get(i, [])))
            total += len(near)
            assert len(got.get(i, [])) == len(near)
    assert hits >= 0.99 * total
    assert onebit_search.nearest(found.limit(0), found, 20, "<f4").count() == 0
