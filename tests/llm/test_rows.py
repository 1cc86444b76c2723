"""Operators that judge, place or repeat rows, and the pipeline."""

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import check
import corpus_pipeline
from tests.llm.test_groups import least, shingled
from textrill.llm import bpe_automaton, licences, mixing, quality, slots, url_filter
from textrill.llm.common import table
from textrill.session import scratch_path


@pytest.mark.parametrize("name", ["op6_systematic_mix", "op7_licence_digests", "op9_url_vocabulary"])
def test_query_equals_its_sql(spark, small, name):
    got = entry.queries()[name](spark, small).toPandas()
    want = check.connect(small).execute(entry.oracle_sql()[name]).df()
    assert check.difference(got, want) == ""


def odd_docs(spark):
    rows = [(i, f"w{i} " * (i % 40), "a" if i % 3 else None, i) for i in range(300)]
    rows += [(500, None, "b", 1), (501, "", "b", 1), (None, "x y", "c", 1), (7, "w7 " * 7, "a", 7), (502, "z " * 30000, "d", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")


def test_slots_balance_bytes_and_keep_a_slot_per_id(spark):
    docs = odd_docs(spark).where("doc_id IS NULL OR doc_id <> 502")
    got = slots.assign(docs, 5).collect()
    assert len(got) == docs.count()
    loads, places = {}, {}
    for r in got:
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    assert max(loads.values()) - min(loads.values()) <= 16 and len(loads) == 5
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert {r["text_crc32"] for r in got if r["doc_id"] == 500} == {0}
    assert {r["text_crc32"] for r in got if r["doc_id"] == 3} == {zlib.crc32(b"w3 w3 w3 ")}
    assert slots.assign(docs.limit(0), 5).count() == 0


def test_slot_map_versions(spark):
    size = {s: (s * 37) % 101 for s in range(64)}
    first = slots.SlotMap.first(64, 4)
    second = first.rebalanced(size)
    third = second.rebalanced(size, 5)
    assert second.version == 1 and third.version == 2 and set(third.shards) == set(range(5))
    path = scratch_path(spark, "map")
    second.save(spark, path)
    third.save(spark, path)
    assert slots.SlotMap.load(spark, path, 1) == second and slots.SlotMap.load(spark, path, 2) == third
    out = scratch_path(spark, "shards")
    slots.write_shards(odd_docs(spark), slots.SlotMap.first(64, 4), out)
    assert spark.read.parquet(out).count() == odd_docs(spark).count()


def water(sizes):
    weights, total = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sizes)}, sum(sizes.values())
    target, full = {}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        w = sum(weights[s] for s in sizes if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else left * weights[s] / w for s in sizes}
        over = {s for s in sizes if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def test_mix_shares_out_the_targets(spark):
    sizes = {"a": 10, "b": 0, "c": 1000, "d": 500, "e": 3, "f": 700}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
    assert got == pytest.approx(water(sizes))


def test_mix_repeats_whole_rows(spark):
    docs = odd_docs(spark)
    one, two = (sorted(map(str, mixing.mix(docs).collect())) for _ in range(2))
    assert one == two and mixing.mix(docs).columns == docs.columns
    counts = mixing.mix(docs).groupBy("doc_id", "text").count().agg(F.max("count")).first()[0]
    assert counts <= 6 and mixing.mix(docs.limit(0)).count() == 0  # the repeated row may come twice three times


def test_mix_takes_the_same_rows_in_any_order(spark):
    rows = [(i // 3, "w " * (1 + i // 9) + f"t{i % 3}", "a", i) for i in range(60)] + [(1, "same size", "a", k) for k in range(5)]
    frames = [spark.createDataFrame(some, "doc_id long, text string, source string, size long") for some in (rows, rows[::-1], rows[7:] + rows[:7])]
    one, *others = (sorted(map(str, mixing.mix(f.repartition(k + 1)).collect())) for k, f in enumerate(frames))
    assert others == [one, one] and 0 < len(one)


def test_mix_comes_within_half_of_the_longest_document(spark):
    rng = np.random.default_rng(6)
    rows = [(1000 * k + i, f"s{k:02}", 1 + int(x)) for k in range(30) for i, x in enumerate(rng.pareto(1.0, 50) * 20)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long")
    taken = mixing.copies_taken(frame, "source", ["doc_id"], "size", "copies")
    words, longest = F.sum(F.col("copies") * F.col("size")), F.max("size")
    sums = taken.groupBy("source", "target").agg(words.alias("words"), longest.alias("longest")).collect()
    assert len(sums) == 30 and all(2 * abs(r["words"] - r["target"]) <= r["longest"] for r in sums)


def test_a_mix_of_many_sources_shares_out_the_targets(spark):
    rng = np.random.default_rng(4)
    sizes = {f"s{i:04}": int(s) for i, s in enumerate(rng.pareto(0.7, 3000) * 10)}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
    assert got == pytest.approx(water(sizes))


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("no scheme/porn", "", "", None, "block"),
    ("http://A.Example.ORG/es/x?q", "a.example.org", "/es/x", "example.org/es/", "block"),
    ("http://example.org/en/1", "example.org", "/en/1", "example.org/en/1", "block"),
    ("http://notexample.org/en/1", "notexample.org", "/en/1", "org/", "allow"),
    ("http://x.com/de/xxx", "x.com", "/de/xxx", "com/de/", "block"), ("http://x.com/fr/xxx", "x.com", "/fr/xxx", "com/fr/", "allow"),
    ("http://x.net/poker-poker", "x.net", "/poker-poker", None, "allow"), ("http://x.net/Poker/free", "x.net", "/Poker/free", None, "block"),
    ("http://sussex.net/unxxx", "sussex.net", "/unxxx", None, "allow"), ("http://x.org", "x.org", "", None, "allow"),
])
def test_urls(spark, url, host, path, rule, verdict):
    r = url_filter.judge(spark.createDataFrame([(1, url, "h")], "page_id long, url string, host string")).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_licences_match_in_other_dress(spark):
    mit = licences.KNOWN["MIT"]
    texts = [
        mit, "Copyright (c) 2019 Someone\n\n# " + mit.upper().replace(" ", "\n  "), mit.replace("sublicense", "sub-licence").replace('"', "'"),
        mit + " And more.", None, "", "...", "Copyright 2020 X\nAll rights reserved.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("licence", F.lit(1))
    got = {r["doc_id"]: r["licence"] for r in licences.scan(docs, licences.known_licences(spark)).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: None, 7: None}
    assert licences.scan(docs.limit(0), licences.known_licences(spark)).count() == 0


def test_whole_licences_match_with_title_and_copyright_line(spark):
    whole = {p.stem: p.read_text(encoding="utf-8") for p in licences.TEXTS.glob("*.txt")}
    owner = "Copyright (c) 2021 Some One\nAll rights reserved.\n\n"
    files = [(name, owner + text) for name, text in whole.items()]
    files += [(name, f"{title}\n\n{owner}{(licences.KNOWN | whole)[name]}") for name, titles in licences.TITLES.items() for title in titles]
    apache, gpl = whole["Apache-2.0"], whole["GPL-3.0"]
    files += [("Apache-2.0", apache.replace(licences.UNFILLED, "Copyright 2021 Some One")), ("Apache-2.0", apache[: apache.index("APPENDIX")])]
    files += [("GPL-3.0", gpl[: gpl.index("How to Apply These Terms")]), (None, gpl[: len(gpl) // 2]), (None, apache + "\nAnd more.")]
    files += [("MIT", "The MIT License (MIT)\n\n" + licences.KNOWN["MIT"]), (None, "MIT License")]
    files += [(name, owner + whole[name].replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")) for name in ("BSD-2-Clause", "BSD-3-Clause")]
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(files)], "doc_id long, text string")
    got = {r["doc_id"]: r["licence"] for r in licences.scan(docs, licences.known_licences(spark)).collect()}
    assert got == {i: name for i, (name, _) in enumerate(files)}
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "Unlicense"} <= set(whole)


def test_quality_on_the_held_out_fold(spark, small):
    got = quality.op3_pu_quality(spark, small).join(table(spark, small, "labels"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.85


def plain_risk(w, x, trusted, prior, ridge):
    g = x @ w
    negative = np.logaddexp(0, g).mean() - prior * np.logaddexp(0, g[trusted]).mean()
    return prior * np.logaddexp(0, -g[trusted]).mean() + max(0.0, negative) + 0.5 * ridge * (w[1:] ** 2).sum()


def test_quality_minimises_the_risk_where_the_bound_does_not_hold(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    rows = quality.with_features(docs.select("doc_id", "text"), "_x").drop("text")
    told = quality.training_rows(rows, labels).cache()
    prior = 0.2  # far below the share of positives: the part on negatives stays above 0, and the risk is convex
    model = quality.fit(told, prior)
    found = told.toPandas()
    trusted, x = found["trusted"].to_numpy(bool), np.array([np.frombuffer(b, "<f8") for b in found["x"]])
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    assert trusted.sum() == len(good) and len(x) == docs.count()
    z = quality.scaled(x, x.mean(axis=0), np.where(x.std(axis=0) < 1e-6, 1.0, x.std(axis=0)))
    least = plain_risk(np.array(model.weights), z, trusted, prior, quality.RIDGE)
    v = np.zeros(z.shape[1])
    for step in range(4000):
        g = z @ v
        s = 1 / (1 + np.exp(-g))
        negative = np.logaddexp(0, g).mean() - prior * np.logaddexp(0, g[trusted]).mean()
        up = z.T @ s / len(z) - prior * z[trusted].T @ s[trusted] / trusted.sum()
        slope = (up if negative > 0 else 0) - prior * z[trusted].T @ (1 - s[trusted]) / trusted.sum() + quality.RIDGE * np.append(0, v[1:])
        v = v - 0.5 / (1 + step / 400) * slope
    assert negative > 0 and least < plain_risk(v, z, trusted, prior, quality.RIDGE) + 1e-3


def test_prior_from_positives_and_unlabelled_rows():
    rng = np.random.default_rng(2)
    for prior in (0.2, 0.5, 0.9):
        positive = np.clip(rng.normal(0.7, 0.12, 20_000), 0, 0.999)
        mixed = np.append(np.clip(rng.normal(0.7, 0.12, int(60_000 * prior)), 0, 0.999), np.clip(rng.normal(0.25, 0.12, 60_000 - int(60_000 * prior)), 0, 0.999))
        counts = [np.bincount((v * 500).astype(int), minlength=500) for v in (positive, mixed)]
        assert quality.best_bin(*counts) == pytest.approx(prior, abs=0.03)


def test_quality_of_long_and_repeated_texts(spark, small):
    labels = table(spark, small, "labels")
    docs = table(spark, small, "documents").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "Word of text. " * 200_000), (None, ""), (None, None), (3, "x" * 300_000), (3, "x" * 300_000)], docs.schema)
    model, rows = quality.learn(docs.unionAll(odd), labels)
    got = quality.scored(rows, model, "_x", "score").collect()
    assert len(got) == docs.count() + 5 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 3}) <= 2 and sum(r["doc_id"] is None for r in got) == 3


def test_quality_of_odd_rows(spark, small):
    labels = table(spark, small, "labels")
    docs = table(spark, small, "documents").withColumn("score", F.lit("mine"))
    more = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), *docs.columns[2:])
    kept = quality.keep_good(docs.unionAll(more), labels)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count() + 1
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()
    assert quality.keep_good(docs.limit(0), labels).count() == 0


def test_pipeline_stages_take_effect(spark, small):
    docs = table(spark, small, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "mix", "encode"]
    good = corpus_pipeline.keep_good(spark, docs, small).cache()
    bad = docs.join(good.select("doc_id"), "doc_id", "left_anti").join(table(spark, small, "labels"), "doc_id")
    assert good.count() < docs.count() and bad.where("quality = 1").count() == 0
    one = corpus_pipeline.keep_one(spark, good, small).cache()
    assert one.columns == docs.columns and one.count() == one.select("text").distinct().count() < good.count()
    out = corpus_pipeline.run(spark, small)
    assert out.select("doc_id").distinct().join(one, "doc_id", "left_anti").count() == 0
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_pipeline_hands_texts_to_python_in_small_batches(spark, small):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 700).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    try:
        for stage in (corpus_pipeline.keep_good, corpus_pipeline.keep_one, corpus_pipeline.encode):
            spark.conf.unset(setting)
            stage(spark, docs.limit(0), small)
            got = docs.mapInArrow(sizes, "n long, size long").collect()
            assert sum(r["n"] for r in got) == 4000 and max(r["size"] for r in got) < 5 << 20
        spark.conf.set(setting, "1m")
        corpus_pipeline.encode(spark, docs, "")
        assert spark.conf.get(setting) == "1m"
    finally:
        spark.conf.unset(setting)


def test_pipeline_equals_brute_force(spark, small):
    docs = table(spark, small, "documents")
    model, _ = quality.learn(docs, table(spark, small, "labels"))  # only the scores are worked out again, not the training
    rows = docs.toPandas().sort_values("doc_id", ignore_index=True)
    scores = model.score(np.array([quality.features(t) for t in rows["text"]]))
    rows = rows[scores >= quality.CUT].reset_index(drop=True)
    sets = [shingled(t) for t in rows["text"]]
    edges = [(i, j) for i, a in enumerate(sets) for j in range(i) if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j])]
    documents = rows[[r == i for i, r in enumerate(least(len(sets), edges))]]
    texts = dict(zip(documents["doc_id"], documents["text"], strict=True))
    with duckdb.connect() as con:
        con.register("documents", documents)
        copies = {r[0]: r[4] // r[1] for r in con.execute(mixing.OP6_SQL).fetchall()}
    library = Tokenizer.from_file(public_tokenizers.path(bpe_automaton.VOCABULARY))
    want = []
    for doc_id, n in copies.items():
        ids = library.encode(texts[doc_id], add_special_tokens=False).ids
        coded = np.array(ids, "<i4").tobytes()
        back = library.decode(ids, skip_special_tokens=False).encode()
        want += [(doc_id, coded, len(ids), hashlib.sha256(coded).hexdigest(), hashlib.sha256(back).hexdigest())] * n
    got = [(r[0], bytes(r[1]), *r[2:]) for r in corpus_pipeline.run(spark, small).collect()]
    assert sorted(got) == sorted(want) and len(documents) < len(sets) < docs.count()
