"""Near-duplicate texts by MinHash and sequential Bayesian verification (operator 5).

A text is the set of its distinct shingles of five words. Its signature holds the least value of the set under
each of ``HASHES`` hash functions; two signatures agree at a place with the probability of the sets'
similarity s. Texts that agree in a whole band of ``ROWS`` places share a bucket, so a pair at the threshold is missed with
probability (1 - s^ROWS)^(HASHES / ROWS).

Candidates from the buckets are compared batch by batch of places. After n places with m agreements, and a flat prior, the posterior
probability that s reaches the threshold is P(Binomial(n + 1, threshold) <= m); a pair is pruned as soon as that
falls below ``PRUNE``. What remains is verified exactly on the full sets.

Equal sets are one class. Within a bucket every class meets a pivot first, which joins groups of near copies at
a cost in proportion to their size: the class that shares most buckets with others, as an original does
with its edited copies; then the like of it outside the first pivot's component. After that only pairs of one bucket that are
still in different components are compared, block by block where the full sets are at hand; pairs inside a component can't change it. So no link
between components is left out, and a group never leaves a task as all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrill.llm.bpe_automaton import text_batches
from textrill.llm.common import (
    blocks,
    bucket_join,
    components,
    extended,
    fresh,
    give_back,
    hot_buckets,
    release_shuffles,
    table,
)
from textrill.session import materialise

WORDS = 5
HASHES, ROWS = 96, 4
BATCH = 16
PERCENT = 75
PRUNE = 1e-5
BLOCK = 512
TEXT_RUN = 1 << 20
SEED = 53


@lru_cache(maxsize=1)
def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    odd = lambda n: rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    return odd(WORDS), odd(HASHES)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit digests: A-Z lower-cased, words between ASCII blanks.

    A text with fewer words is one shingle, with none it has the empty set.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    places, _ = _constants()
    k = min(WORDS, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = _mix(h + w[i : len(w) - k + 1 + i] * places[i])
    return np.unique(h)


def signature(found: np.ndarray) -> np.ndarray:
    """The upper halves of the least products with each constant, as int32."""
    _, factors = _constants()
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 2048):
        least = np.minimum(least, (found[i : i + 2048, None] * factors).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


@lru_cache(maxsize=4)
def least_agreements(percent: int = PERCENT, prune: float = PRUNE) -> tuple[int, ...]:
    """For each number of places seen, the agreements below which a pair is pruned."""
    t, out = percent / 100, []
    for n in range(HASHES + 1):
        total, m = 0.0, -1
        while total < prune:
            m += 1
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def surviving(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of the pairs of signatures (rows of ``a`` and ``b``) that no batch prunes."""
    need = least_agreements()
    left, agreed = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i in range(0, HASHES, BATCH):
        agreed = agreed + (a[left, i : i + BATCH] == b[left, i : i + BATCH]).sum(axis=1)
        kept = agreed >= need[i + BATCH]
        left, agreed = left[kept], agreed[kept]
    return left


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 times the common shingles reach PERCENT times all of them."""
    if min(len(a), len(b)) * 100 < PERCENT * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (len(both) - common)


def sketches(docs: DataFrame, mark: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, *mark, n_shingles, key, sig)``: ``key`` is a digest of the set, null for the empty one."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in text_batches(batch, 1, TEXT_RUN):
                counts, keys, sigs = [], [], []
                for text in texts:
                    found = shingles(text)
                    counts.append(len(found))
                    keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    sigs.append(signature(found).tolist() if len(found) else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, len(texts)),
                        *(c.slice(begin, len(texts)) for c in batch.columns[2:]),
                        pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int32())),
                    ],
                    ["doc_id", *mark, "n_shingles", "key", "sig"],
                )
        give_back()

    marks = "".join(f", `{m}` {docs.schema[m].dataType.simpleString()}" for m in mark)
    return docs.select("doc_id", "text", *mark).mapInArrow(
        run, f"doc_id {id_type}{marks}, n_shingles long, key binary, sig array<int>"
    )


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(a, b, sig_a, sig_b)`` to the pairs that aren't pruned."""
    for batch in batches:
        if batch.num_rows:
            left = surviving(_matrix(batch.column(2)), _matrix(batch.column(3)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(left), batch.column(1).take(left)], ["a", "b"])


def _across(group: pa.Table) -> pa.Table:
    """Links between the components of a block pair of one bucket, found on signatures and verified on full sets.

    A pair is looked at in the first band that it shares, and only while its components differ: at most
    one link per member leaves the task.
    """
    group = group.combine_chunks()
    part, lo, hi, band = (group[c].to_numpy() for c in ("part", "lo", "hi", "t"))
    keys, sigs, sets = group["key"].to_pylist(), _matrix(group["sig"].combine_chunks()), group["set"]
    size = np.array([len(x.as_buffer()) for x in sets])
    _, comp = np.unique(np.array(group["comp"].to_pylist(), dtype=object), return_inverse=True)
    right = np.flatnonzero(part == hi[0])
    out: list[tuple[bytes, bytes]] = []
    for i in np.flatnonzero(part == lo[0]):
        others = right[(comp[right] != comp[i]) & (100 * np.minimum(size[right], size[i]) >= PERCENT * np.maximum(size[right], size[i]))]
        if lo[0] == hi[0]:
            others = others[others > i]
        for j in others[surviving(np.broadcast_to(sigs[i], (len(others), HASHES)), sigs[others])]:
            if comp[j] == comp[i] or (sigs[i] == sigs[j]).reshape(-1, ROWS).all(axis=1).argmax() != band[0]:
                continue
            if similar(np.frombuffer(sets[int(i)].as_buffer(), "<u8"), np.frombuffer(sets[int(j)].as_buffer(), "<u8")):
                out.append((keys[i], keys[j]))
                comp[comp == comp[j]] = comp[i]
    return pa.table({c: pa.array([x[n] for x in out], pa.binary()) for n, c in enumerate("ab")})


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(a, b, set_a, set_b)`` to the pairs whose full sets are similar."""
    for batch in batches:
        left = []
        for i in range(batch.num_rows):
            a, b = (np.frombuffer(batch.column(c)[i].as_buffer(), "<u8") for c in (2, 3))
            if similar(a, b):
                left.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(left, pa.int64())), batch.column(1).take(pa.array(left, pa.int64()))], ["a", "b"])


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(key, set)`` of the wanted classes: full sets from the text of one document each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in text_batches(batch, 1, TEXT_RUN):
                sets = [shingles(t).tobytes() for t in texts]
                keys = [xxhash.xxh3_128_digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(texts)), pa.array(keys, pa.binary()), pa.array(sets, pa.binary())],
                    ["doc_id", "key", "set"],
                )
        give_back()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    found = texts.mapInArrow(run, f"doc_id {id_type}, key binary, set binary")
    # an id that repeats may bring other texts along
    return found.join(wanted.select("key", "doc_id"), ["key", "doc_id"], "left_semi").drop("doc_id").dropDuplicates(["key"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. Each set is sent to the pairs it is in."""
    one = sets.select(F.col("key").alias("a"), F.col("set").alias("set_a"))
    two = sets.select(F.col("key").alias("b"), F.col("set").alias("set_b"))
    both = pairs.join(two, "b").join(one, "a").select("a", "b", "set_a", "set_b")
    return both.mapInArrow(_verify, "a binary, b binary")


def _pivots(members: DataFrame, name: str) -> DataFrame:
    """Per band the class that shares most buckets with others, and its component, if there is one yet."""
    named = members if "comp" in members.columns else members.withColumn("comp", F.col("key"))
    most = named.groupBy("band").agg(F.max(F.struct("_met", "key", "comp")).alias("p"))
    return most.select("band", F.col("p.key").alias(name), F.col("p.comp").alias("_at"))


def _pairs(rows: DataFrame, pivot: str) -> DataFrame:
    """The distinct pairs of a class and its pivot."""
    a, b = F.least("key", pivot), F.greatest("key", pivot)
    return rows.where(F.col("key") != F.col(pivot)).select(a.alias("a"), b.alias("b")).distinct()


def _candidates(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs that their signatures don't prune."""
    with_sigs = (
        pairs.join(sigs.select(F.col("key").alias("b"), F.col("sig").alias("sig_b")), "b")
        .join(sigs.select(F.col("key").alias("a"), F.col("sig").alias("sig_a")), "a")
        .select("a", "b", "sig_a", "sig_b")
    )
    return with_sigs.mapInArrow(_prune, "a binary, b binary")


def _open(members: DataFrame, comps: DataFrame, hot: DataFrame) -> DataFrame:
    """The members of the buckets that still hold several components, with ``comp``."""
    told = members.join(comps.select(F.col("node").alias("key"), "root"), "key", "left").select(
        *members.columns, F.coalesce("root", "key").alias("comp")
    )
    mixed = told.groupBy("band").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo < _hi")
    return materialise(bucket_join(told, mixed.select("band"), "band", hot, "key", "left_semi"), "open")


def _grouped(docs: DataFrame, mark: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The sketches of ``docs``, and ``(key, root, doc_id, *mark)``: per class its component and its first document."""
    known = docs.where("doc_id IS NOT NULL")
    sketched = materialise(sketches(docs, mark), "sketches")
    worded = sketched.where("key IS NOT NULL AND doc_id IS NOT NULL")
    classes = materialise(
        worded.groupBy("key")
        .agg(F.min(F.struct("doc_id", *mark)).alias("_first"), F.first("sig").alias("sig"))
        .select("key", "_first.*", "sig"),
        "classes",
    )
    bands = [F.xxhash64(F.lit(i), F.slice("sig", i * ROWS + 1, ROWS)) for i in range(HASHES // ROWS)]
    banded = classes.select("key", F.posexplode(F.array(*bands)).alias("t", "band"))
    shared = banded.groupBy("band").agg(F.min("key").alias("_lo"), F.max("key").alias("_hi"), F.count("*").alias("n"))
    shared = materialise(shared.where("_lo < _hi").select("band", "n"), "bands")
    hot = hot_buckets(shared, "band", "n")
    met = materialise(bucket_join(banded, shared, "band", hot, "key"), "met")
    known_by = met.groupBy("key").agg(F.sum("n").alias("_met"))
    members = materialise(met.join(known_by, "key").select("t", "band", "key", "_met"), "members")
    sets = materialise(_sets(known, known_by.select("key").join(classes.select("key", "doc_id"), "key")), "sets")
    sigs = classes.select("key", "sig")

    first = _pivots(members, "pivot")
    pairs = _pairs(bucket_join(members, first, "band", hot, "key"), "pivot")
    links = materialise(_confirmed(_candidates(pairs, sigs), sets), "links")
    comps = components(links)
    release_shuffles(docs.sparkSession)
    told = _open(members, comps, hot)
    met_first = bucket_join(told, first, "band", hot, "key")
    pivots = met_first.where("key = pivot").select("band", F.col("comp").alias("_settled"))
    outside = bucket_join(told, pivots, "band", hot, "key").where("comp <> _settled")
    second = bucket_join(told, _pivots(outside, "pivot"), "band", hot, "key").where("comp <> _at")
    comps = extended(comps, materialise(_confirmed(_candidates(_pairs(second, "pivot"), sigs), sets), "links"))
    across = (
        blocks(_open(told.drop("comp"), comps, hot), ["t", "band"], "key", BLOCK, hot)
        .join(sigs, "key")
        .join(sets, "key")
        .groupBy("t", "band", "lo", "hi")
        .applyInArrow(_across, "a binary, b binary")
    )
    release_shuffles(docs.sparkSession)
    comps = extended(comps, materialise(across, "links"))

    named = classes.drop("sig").join(comps.withColumnRenamed("node", "key"), "key", "left")
    return sketched, named.withColumn("root", F.coalesce("root", "key"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, a row per row of ``docs``.

    Texts without words (null, empty, blanks) have no shingles and link with nothing. Rows that
    repeat have equal sets and are linked. Rows without an id have n_shingles, link with nothing, have no
    component (null) and are kept. An empty table gives no rows; other columns aren't read.
    """
    sketched, named = _grouped(docs)
    least = materialise(named.groupBy("root").agg(F.min("doc_id").alias("_least"), F.count("*").alias("n")), "least")
    hot = hot_buckets(least, "root", "n")
    ids = bucket_join(named, least.drop("n"), "root", hot, "key").select("key", "_least")
    return sketched.join(ids, "key", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("_least", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept: one document of each group, and all rows without an id.

    A document is known by its id and the digest of its text, as an id may repeat with another text: of each group the
    least of them stays, and of texts without words each. Of rows that repeat in both, the least of
    the other columns as JSON stays.
    """
    digest = fresh(docs, "_digest")
    marked = docs.withColumn(digest, F.sha2(F.coalesce("text", F.lit("")), 256))
    sketched, named = _grouped(marked, (digest,))
    first = named.groupBy("root").agg(F.min(F.struct("doc_id", digest)).alias("_first")).select("_first.*")
    wordless = sketched.where("key IS NULL AND doc_id IS NOT NULL").select("doc_id", digest)
    rows = marked.where("doc_id IS NOT NULL").join(first.unionAll(wordless).distinct(), ["doc_id", digest], "left_semi")
    columns = {c: F.col("`{}`".format(c.replace("`", "``"))) for c in docs.columns}
    others = F.to_json(F.struct(*(col for c, col in columns.items() if c != "text")))
    one = F.min_by(F.struct(*columns.values()), F.struct(F.isnull("text"), others))
    kept = rows.groupBy("doc_id", digest).agg(one.alias("_row")).select("_row.*")
    return kept.unionAll(docs.where("doc_id IS NULL"))


def op5_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates among all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
