"""Periodic runs of words by Kruskal over descending common prefixes (operator 12).

A run is a stretch of words with smallest period q, at least max(12, 2 q) long, that no neighbouring word extends. The suffixes of a
text that begin with the same words form a class. The pairs of suffixes that are neighbours in sorted order are taken by decreasing
length of their common prefix, and each unites two classes, kept by union-find with their positions in order; the smaller
is put into the larger. Two positions of the classes that become neighbours, i < j, share exactly the l words of
that prefix. If their distance is l at most, the l + j - i words from i on have the period j - i, which no word behind them continues:
a seed. The period is the smallest, as a smaller one would have put a position of the class between them; so
what a union makes neighbours counts only if it still is when all unions of that length are done. Every run is seeded at its very first
word, so of the seeds with one period and one end the first is the run.

A run of 12 words has seeds with a common prefix of 6, so shorter ones are left out. Suffixes are sorted by prefix doubling in
arrays, several texts at once; only classes with positions close enough for a seed are united one by one.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textrill.llm.common import table
from textrill.llm.units import byte_batches

LEAST, POWER = 12, 2
SHARED = LEAST // POWER
RUN = 1 << 20
PIECE = 1 << 20
CHUNK = 512

Runs = list[tuple[int, int, int]]  # start, length, period

_BLANK = re.compile(rb"[\x20\x09-\x0D]")


class Positions:
    """A set of whole numbers in order, in chunks, so that a large one takes a new member as fast as a small one."""

    def __init__(self, first: int):
        self.chunks, self.lows, self.size = [[first]], [first], 1

    def _chunk(self, x: int) -> int:
        return max(0, bisect_right(self.lows, x) - 1)

    def add(self, x: int) -> None:
        k = self._chunk(x)
        chunk = self.chunks[k]
        insort(chunk, x)
        self.lows[k] = chunk[0]
        self.size += 1
        if len(chunk) > 2 * CHUNK:
            self.chunks[k : k + 1] = [chunk[:CHUNK], chunk[CHUNK:]]
            self.lows[k : k + 1] = [chunk[0], chunk[CHUNK]]

    def around(self, x: int) -> tuple[int, int]:
        """The members before and after the member ``x``; -1 where there is none."""
        k = self._chunk(x)
        chunk = self.chunks[k]
        at = bisect_left(chunk, x)
        before = chunk[at - 1] if at else self.chunks[k - 1][-1] if k else -1
        after = chunk[at + 1] if at + 1 < len(chunk) else self.chunks[k + 1][0] if k + 1 < len(self.chunks) else -1
        return before, after

    def __iter__(self) -> Iterator[int]:
        for chunk in self.chunks:
            yield from chunk


def seeds(positions: list[int], shared: list[int]) -> Iterator[tuple[int, int, int]]:
    """``(position, period, end)`` of one class: positions in the order of their suffixes, and what each shares with the next."""
    parent = list(range(len(positions)))
    held = [Positions(p) for p in positions]
    place = {p: k for k, p in enumerate(positions)}

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    order = sorted(range(len(shared)), key=shared.__getitem__, reverse=True)
    begin = 0
    while begin < len(order):
        length, end = shared[order[begin]], begin
        met: list[tuple[int, int]] = []
        while end < len(order) and shared[order[end]] == length:
            small, large = find(order[end]), find(order[end] + 1)
            if held[small].size > held[large].size:
                small, large = large, small
            mine, into = list(held[small]), held[large]
            for x in mine:
                into.add(x)
            for k, x in enumerate(mine):
                before, after = into.around(x)
                if 0 <= x - before <= length and before >= 0 and (k == 0 or before != mine[k - 1]):
                    met.append((before, x))
                if 0 < after - x <= length and (k + 1 == len(mine) or after != mine[k + 1]):
                    met.append((x, after))
            parent[small], held[small] = large, None
            end += 1
        for i, j in met:
            if length + j - i >= LEAST and held[find(place[i])].around(i)[1] == j:
                yield i, j - i, j + length
        begin = end


def sorted_suffixes(codes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The suffixes in order, and per power of two the class of each position by that many words."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    at = np.arange(n)
    first = np.ones(n, bool)
    first[1:] = codes[order[1:]] != codes[order[:-1]]
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, at, 0))
    levels, length = [(1, rank.astype(np.int32))], 1
    open_ = order[~(first & np.append(first[1:], True))]
    while len(open_):
        key = rank[open_] * (n + 2) + rank[np.minimum(open_ + length, n)] + 1
        turn = np.argsort(key, kind="stable")
        open_, key = open_[turn], key[turn]
        old, at = rank[open_], np.arange(len(open_))
        first, begins = np.ones(len(open_), bool), np.ones(len(open_), bool)
        first[1:], begins[1:] = key[1:] != key[:-1], old[1:] != old[:-1]
        places = old + at - np.maximum.accumulate(np.where(begins, at, 0))
        order[places] = open_
        rank[open_] = places[np.maximum.accumulate(np.where(first, at, 0))]
        length *= 2
        levels.append((length, rank.astype(np.int32)))
        open_ = open_[~(first & np.append(first[1:], True))]
    return order, levels


def common_prefix(i: np.ndarray, j: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """How many words the suffixes at i and at j share, for unlike i and j."""
    shared = np.zeros(len(i), np.int64)
    for length, rank in reversed(levels):
        same = rank[i + shared] == rank[j + shared]
        shared[same] += length
    return shared


def find_runs(codes: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and then period. Unlike texts have no code in common."""
    none = np.zeros((0, 3), np.int64)
    if len(codes) < LEAST:
        return none
    order, levels = sorted_suffixes(codes)
    usual = [rank for length, rank in levels if length * 2 > SHARED >= length]
    if not usual:
        return none
    near = np.flatnonzero(usual[0][order[:-1]] == usual[0][order[1:]])
    shared = common_prefix(order[near], order[near + 1], levels)
    near, shared = near[shared >= SHARED], shared[shared >= SHARED]
    if not len(near):
        return none
    # classes of neighbours; a class whose positions are all further apart than its longest prefix has no seed
    begins = np.flatnonzero(np.append(True, near[1:] != near[:-1] + 1))
    ends = np.append(begins[1:], len(near))
    longest = np.maximum.reduceat(shared, begins)
    sizes = ends - begins + 1
    members = order[np.repeat(near[begins], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
    of = np.repeat(np.arange(len(begins)), sizes)
    turn = np.lexsort((members, of))
    gaps = np.diff(members[turn])
    gaps[of[turn][1:] != of[turn][:-1]] = len(codes)
    starts = np.cumsum(sizes) - sizes
    least = np.minimum.reduceat(np.append(gaps, len(codes)), starts)
    found: dict[tuple[int, int], int] = {}
    for k in np.flatnonzero(least <= longest).tolist():
        inside = members[starts[k] : starts[k] + sizes[k]].tolist()
        for start, period, end in seeds(inside, shared[begins[k] : ends[k]].tolist()):
            found[end, period] = min(start, found.get((end, period), start))
    runs = np.array([(start, end - start, period) for (end, period), start in found.items()], np.int64).reshape(-1, 3)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


class Words:
    """The words of some texts as numbers. A text of any length is split in pieces between blanks."""

    def __init__(self):
        self.number: dict[bytes, int] = {}

    def of(self, text: bytes) -> np.ndarray:
        out, begin, number = [], 0, self.number
        while begin < len(text):
            cut = _BLANK.search(text, begin + PIECE)
            end = cut.start() if cut else len(text)
            words = text[begin:end].split()
            out.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
            begin = end
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def texts(self, ids: list[np.ndarray]) -> list[bytes]:
        names = list(self.number)
        return [b" ".join([names[i] for i in one.tolist()]) for one in ids]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words no run contains behind its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps[:-1]) == 0


def runs_of(words: list[np.ndarray]) -> list[np.ndarray]:
    """The runs of each text, its words given as numbers; all texts are sorted together."""
    counts = np.array([len(w) for w in words], np.int64)
    begins = np.cumsum(counts) - counts
    joined = np.concatenate(words) if len(words) else np.zeros(0, np.int64)
    codes = joined + np.repeat(np.arange(len(words)), counts) * (int(joined.max(initial=0)) + 1)
    found = find_runs(codes)
    cut = np.searchsorted(found[:, 0], np.append(begins, len(codes)))
    return [found[a:b] - np.array([begin, 0, 0]) for a, b, begin in zip(cut[:-1], cut[1:], begins, strict=True)]


def periodic_runs(docs: DataFrame, change: Callable[[object, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` of every row of ``docs(doc_id, text)``, where it stands.

    ``runs`` is an array of (start, length, period) by start and then period; ``collapsed`` is the text without the words that any run
    contains behind its first period, the rest joined by one space. ``change`` may give other words for a document:
    it gets the id and the words as numbers. A null or empty text has no words and no runs, repeated rows stay, an empty
    table gives none, other columns aren't read. A text is one task's work however long it is, in arrays of a few numbers per word.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in byte_batches(batch, 1, RUN):
                vocabulary = Words()
                ids = batch.column(0).slice(begin, len(texts))
                words = [vocabulary.of(text) for text in texts]
                texts.clear()
                if change is not None:
                    words = [change(i, w) for i, w in zip(ids.to_pylist(), words, strict=True)]
                found = runs_of(words)
                kept = [w[kept_words(len(w), r)] for w, r in zip(words, found, strict=True)]
                flat = np.concatenate(found)
                parts = [pa.array(flat[:, k]) for k in range(3)]
                ends = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
                collapsed = pa.array(vocabulary.texts(kept), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([len(w) for w in words], pa.int64()), lists, collapsed], ["doc_id", "n_words", "runs", "collapsed"]
                )

    kind = "array<struct<start:bigint,length:bigint,period:bigint>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_words long, runs {kind}, collapsed string")


def made_periodic(doc_id: int | None, words: np.ndarray) -> np.ndarray:
    """One in ten documents, by the digest of its id, gets a periodic end; one without an id stays as it is."""
    digest = zlib.crc32(str(doc_id).encode())
    n, g = len(words), digest // 10
    if doc_id is None or digest % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([words[:a], words[a + np.arange(n - a) % p]])


def longest(runs: Column) -> Column:
    """The longest run; of equally long ones the first to start, then that of the least period. Null without runs."""
    return F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))


def digest_columns(found: DataFrame) -> DataFrame:
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    top = found.withColumn("_top", longest(F.col("runs"))).withColumn("_length", -F.col("_top.less"))
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_top.start").alias("start"), F.col("_length").alias("length"),
        F.col("_top.period").alias("period"), F.expr("1000 * _length div _top.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_descending_lcp_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document's words, and the documents without their repeats, as digests."""
    return digest_columns(periodic_runs(table(spark, sf_dir, "documents"), made_periodic))
