"""FTRL over blocks of texts and parts of the terms, for batches with more coordinates than the caller should hold.

Texts are cut into blocks as they are read, and terms are dealt over parts by a digest. A row is what one block has of one
part. The state of a part's terms stays in its task: a pass turns it and the texts' errors (p - y) into the next state
and into one partial margin per block, and the margins of a block are summed where its texts are. What is shuffled
in a pass are texts times labels from every task; no entry, term or state moves. The caller holds at most ``OFF_BYTES`` of the errors, a group
of blocks after the other, and nothing that grows with the coordinates.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textrill.config import FtrlConfig
from textrill.operators import ftrl, ftrl_rows
from textrill.operators.blocks import distinct_entries, pack, pieces, unpack

# bytes of texts from which a batch goes by blocks
LARGE_TEXT = 8 << 20
# bytes of texts that a part has the terms of, and that are worth a task
PART_BYTES = 48 << 20
TASK_BYTES = 1 << 20
# entries that are worked on at once, bytes of margins that a task holds
ENTRIES = 1 << 20
HELD_BYTES = 64 << 20
# bytes of errors that go to the tasks at once
OFF_BYTES = 32 << 20

# kinds of rows: of a block and part the entries, and the terms; of a block its texts and their margins;
# of a part the terms, the places of the blocks' terms, and the state
ENTRY, VOCABULARY, TEXTS, MARGINS, TERMS, PLACES, STATE = range(7)
FRAME = "p INT, kind INT, r BIGINT, n BIGINT, payload BINARY"
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
_NAMES = ["p", "kind", "r", "n", "payload"]

Row = tuple[int, int, int, int, bytes]


def sizes(batch: DataFrame) -> dict[str | None, tuple[int, int]]:
    """Texts and their bytes, by label."""
    counted = batch.groupBy("y").agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
    return {row["y"]: (row["rows"], row["bytes"] or 0) for row in counted.collect()}


def _batch(rows: Sequence[Row]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)


def _table(rows: Iterable[Row]) -> pa.Table:
    """A batch per row, so that no column of payloads gets long."""
    return pa.Table.from_batches([_batch([row]) for row in rows], _batch([]).schema)


def _rows(table: pa.Table) -> Iterator[Row]:
    for batch in table.to_batches():
        yield from zip(*(column.to_pylist() for column in batch.columns))


@dataclass(frozen=True)
class Deal:
    """The names of the parts, and the tasks that they are dealt over: the part ``names[k]`` goes to one of its own until each has one."""

    names: list[int]
    tasks: int

    @classmethod
    def of(cls, spark: SparkSession, text_bytes: int) -> "Deal":
        tasks = min(2 * spark.sparkContext.defaultParallelism, 1 + text_bytes // TASK_BYTES)
        each = max(1, -(-text_bytes // (PART_BYTES * tasks)))
        ids = spark.range(0, 16 * each * tasks, 1, 1).select(F.col("id").cast("int").alias("id"))
        of_task: dict[int, list[int]] = {}
        for name, task in ids.select("id", F.pmod(F.hash("id"), F.lit(tasks))).collect():
            of_task.setdefault(task, []).append(name)
        names = [name for found in of_task.values() for name in found[:each]]
        return cls(names, tasks)

    def spread(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.tasks, "p")

    def part(self, idx: Column, kind: str) -> Column:
        """The part of a term, as ``_parts`` has it."""
        digest = F.crc32(idx) if kind == "string" else idx
        return F.get(F.lit(self.names), F.pmod(digest, F.lit(len(self.names))).cast("int"))


def _parts(terms: pa.Array, parts: int) -> np.ndarray:
    """The number of each term's part."""
    if not pa.types.is_string(terms.type):
        return (terms.to_numpy() % parts).astype(np.uint16)
    digests = (zlib.crc32(t) for t in terms.cast(pa.binary()).to_pylist())
    return (np.fromiter(digests, np.int64, len(terms)) % parts).astype(np.uint16)


def _cut(piece: pa.RecordBatch, names: list[int], place: bytes) -> list[Row]:
    """The rows of one block; its number is a digest of what it holds and where it was cut."""
    size = piece.num_rows
    terms, row, code, count, codes = distinct_entries(piece)
    digest = hashlib.blake2b(place, digest_size=7)
    digest.update(codes)
    digest.update(row)
    r = int.from_bytes(digest.digest(), "little")

    of_term = _parts(terms, len(names))
    order = np.argsort(of_term, kind="stable")
    ends = np.cumsum(np.bincount(of_term, minlength=len(names)))
    local = np.empty(len(terms), np.int32)
    local[order] = np.arange(len(terms)) - np.repeat(np.append(0, ends[:-1]), np.diff(ends, prepend=0))
    texts = np.bincount(code, minlength=len(terms))  # of each term
    of_entry = of_term[code]
    at = np.argsort(of_entry, kind="stable")
    entry_ends = np.cumsum(np.bincount(of_entry, minlength=len(names)))
    row, code, count = row[at].astype(np.int32), local[code[at]], count[at]

    rows = [(names[r % len(names)], TEXTS, r, size, pack(piece.column(0), piece.column(1)))]
    for k, name in enumerate(names):
        here = slice(entry_ends[k - 1] if k else 0, entry_ends[k])
        if here.start == here.stop:
            continue
        own = order[ends[k - 1] if k else 0 : ends[k]]
        rows.append((name, VOCABULARY, r, size, pack(terms.take(pa.array(own)), texts[own])))
        rows.append((name, ENTRY, r, size, pack(row[here], code[here], count[here])))
    return rows


def cut(docs: DataFrame, deal: Deal, buckets: int | None = None) -> DataFrame:
    """F1 in blocks: rows of ``docs(id, y, tokens)`` as ``FRAME``, dealt by part."""
    tokens = F.col("tokens")
    if buckets is not None:
        tokens = F.transform("tokens", lambda t: F.pmod(F.hash(t), F.lit(buckets)))
    names = deal.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in pieces(batch):
                yield _batch(_cut(piece, names, f"{task} {k}".encode()))
                k += 1

    return deal.spread(docs.select("id", "y", tokens.alias("tokens")).mapInArrow(run, FRAME))


def _vocabulary(blocks: Sequence[Row]) -> tuple[pa.Array, np.ndarray, dict[int, np.ndarray]]:
    """The terms of a part, in how many texts each is, and the place of each block's terms among them."""
    found = [(row[2], *unpack(row[4])) for row in blocks if row[1] == VOCABULARY]
    if not found:
        return pa.array([], pa.string()), np.zeros(0, np.int64), {}
    met = pa.concat_arrays([terms for _, terms, _ in found]).dictionary_encode()
    at = met.indices.to_numpy()
    texts = np.bincount(at, weights=np.concatenate([t for _, _, t in found]), minlength=len(met.dictionary))
    places, start = {}, 0
    for r, terms, _ in found:
        places[r] = at[start : start + len(terms)]
        start += len(terms)
    return met.dictionary, texts, places


def _looked_up(known: pa.Table, terms: pa.Array, labels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """z and n of the terms as (label x term) matrices, the places of those that are known, and their rows."""
    z, n = np.zeros((len(terms), labels)), np.zeros((len(terms), labels))
    at = pc.index_in(known["idx"].combine_chunks().cast(terms.type), value_set=terms)
    met = known.filter(at.is_valid())
    at = at.drop_null().to_numpy()
    ftrl_rows.fill(z, n, at, met)
    return np.ascontiguousarray(z.T), np.ascontiguousarray(n.T), at, met


def _weights(z: np.ndarray, n: np.ndarray, cfg: FtrlConfig) -> np.ndarray:
    return ftrl_rows.State(None, z, n).weights(cfg)


def _several(blocks: Sequence[Row], places: dict[int, np.ndarray], idf: np.ndarray):
    """The entries of some blocks at a time: the blocks ``(r, rows)``, and row, place and value of each entry."""
    met, entries = [], []

    def joined():
        starts = np.cumsum([0, *(size for _, size in met)])
        row, pos, v = (np.concatenate(x) for x in zip(*((row + starts[k], pos, v) for k, (row, pos, v) in enumerate(entries))))
        return met, row, pos, v

    for _, kind, r, size, payload in blocks:
        if kind != ENTRY:
            continue
        row, code, count = unpack(payload)
        pos = places[r][code]
        met.append((r, size))
        entries.append((row, pos, count * idf[pos]))
        if sum(len(e[0]) for e in entries) >= ENTRIES:
            yield joined()
            met, entries = [], []
    if met:
        yield joined()


def _margin_rows(p: int, blocks: Sequence[Row], places: dict[int, np.ndarray], idf: np.ndarray, w: np.ndarray) -> Iterator[Row]:
    if not w.any():
        return
    for met, row, pos, v in _several(blocks, places, idf):
        total = sum(size for _, size in met)
        margin = np.stack([np.bincount(row, weights=v * one[pos], minlength=total) for one in w], axis=1)
        start = 0
        for r, size in met:
            yield p, MARGINS, r, size, margin[start : start + size].tobytes()
            start += size


def _summed(df: DataFrame) -> DataFrame:
    """The margins of a block as one row from each task; other rows as they are."""

    def rows(held: dict) -> pa.RecordBatch:
        return _batch([(p, MARGINS, r, n, m.tobytes()) for r, (p, n, m) in held.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            of_margin = pc.equal(batch.column(1), MARGINS)
            if not pc.any(of_margin).as_py():
                yield batch
                continue
            yield batch.filter(pc.invert(of_margin))
            for p, _, r, n, payload in zip(*(c.to_pylist() for c in batch.filter(of_margin).columns)):
                m = np.frombuffer(payload)
                if r in held:
                    held[r][2][:] += m
                else:
                    held[r] = p, n, m.copy()
                    size += m.nbytes
            if size > HELD_BYTES:
                yield rows(held)
                held, size = {}, 0
        yield rows(held)

    return df.mapInArrow(run, FRAME)


def _cogroup(deal: Deal, left: DataFrame, right: DataFrame, work, schema: str = FRAME) -> DataFrame:
    return left.groupBy("p").cogroup(deal.spread(right).groupBy("p")).applyInArrow(work, schema)


def _state_by_part(state: DataFrame, deal: Deal, *more: str) -> DataFrame:
    kind = state.schema["idx"].dataType.simpleString()
    return state.select(deal.part(F.col("idx"), kind).alias("p"), "idx", "z", "n", *more)


def start(blocks: DataFrame, deal: Deal, state: DataFrame, size: int, labels: int) -> DataFrame:
    """F2, L6, L9. Of each part its terms with their IDF over ``size`` texts, the places of the blocks' terms, and the state."""

    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        p = key[0].as_py()
        terms, texts, places = _vocabulary(list(_rows(left)))
        if not len(terms):
            return _table([])
        idf = np.log((size + 1.0) / (texts + 1.0))
        z, n, at, _ = _looked_up(right, terms, labels)
        return _table([
            (p, TERMS, len(terms), len(at), pack(terms, idf)),
            (p, PLACES, 0, 0, pack(idf, places)),
            (p, STATE, 0, 0, pack(z, n, None, None)),
        ])

    return _cogroup(deal, blocks.where(F.col("kind") == VOCABULARY), _state_by_part(state, deal), work)


def _advance(
    blocks: DataFrame, deal: Deal, begun: DataFrame, state: DataFrame, cfg: FtrlConfig,
    shared=None, whole: bool = True, margins: bool = True,
) -> DataFrame:
    """L2-L4. Of each part the state after the errors ``shared`` of some blocks, and the margins by it.

    The sums of a pass are added to the state when they are ``whole``.
    """

    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        p, rows, own = key[0].as_py(), list(_rows(left)), {row[1]: row for row in _rows(right)}
        if STATE not in own:
            return _table([])
        idf, places = unpack(own[PLACES][4])
        z, n, dz, dn = unpack(own[STATE][4])
        out = []
        if shared is not None:
            off = shared.value
            w, root = _weights(z, n, cfg), np.sqrt(n)
            dz, dn = (np.zeros(z.shape) if x is None else x for x in (dz, dn))
            for met, row, pos, v in _several([x for x in rows if x[2] in off], places, idf):
                errors = np.concatenate([off[r] for r, _ in met])
                for k in range(len(z)):
                    g = errors[row, k] * v
                    square = g * g
                    change = (np.sqrt(n[k, pos] + square) - root[k, pos]) / cfg.alpha * w[k, pos]
                    dz[k] += np.bincount(pos, weights=g - change, minlength=z.shape[1])
                    dn[k] += np.bincount(pos, weights=square, minlength=z.shape[1])
            if whole:
                z, n, dz, dn = z + dz, n + dn, None, None
            out.append((p, STATE, 0, 0, pack(z, n, dz, dn)))
        if margins:
            out += _margin_rows(p, rows, places, idf, _weights(z, n, cfg))
        return _table(out)

    places = begun.where(F.col("kind") == PLACES)
    wanted = blocks.where(F.col("kind") == ENTRY)
    return _summed(_cogroup(deal, wanted, places.unionAll(state.where(F.col("kind") == STATE)), work))


def _settled(table: pa.Table, labels: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Ids, labels and margins of a block's texts."""
    texts, sums = None, None
    for _, kind, _, n, payload in _rows(table):
        if kind == TEXTS:
            texts = unpack(payload)
        else:
            m = np.frombuffer(payload).reshape(n, labels)
            sums = m if sums is None else sums + m
    if texts is None:
        raise ValueError("a block of texts was cut otherwise when it was read again; run the batch again")
    return *texts, np.zeros((len(texts[0]), labels)) if sums is None else sums


def _by_block(blocks: DataFrame, margins: DataFrame | None) -> DataFrame:
    texts = blocks.where(F.col("kind") == TEXTS)
    return texts if margins is None else texts.unionAll(margins.where(F.col("kind") == MARGINS))


def _errors(blocks: DataFrame, margins: DataFrame | None, labels: Sequence[str], group: int, groups: int) -> dict[int, np.ndarray]:
    """p - y of the texts of a group of blocks, 0 where a text has no label."""
    size, names = len(labels), list(labels)

    def work(key: tuple, table: pa.Table) -> pa.Table:
        _, y, margin = _settled(table, size)
        truth = pc.index_in(y, value_set=pa.array(names, pa.string())).fill_null(-1).to_numpy()
        off = ftrl_rows.logistic(margin) - (truth[:, None] == np.arange(size))
        off[truth < 0] = 0.0
        return pa.table({"r": pa.array([key[0].as_py()], pa.int64()), "off": pa.array([off.tobytes()], pa.binary())})

    rows = _by_block(blocks, margins).where(F.pmod(F.xxhash64("r"), F.lit(groups)) == group)
    found = rows.groupBy("r").applyInArrow(work, "r BIGINT, off BINARY").toArrow()
    return {r: np.frombuffer(off).reshape(-1, size) for r, off in zip(found["r"].to_pylist(), found["off"].to_pylist())}


def predictions(blocks: DataFrame, margins: DataFrame, columns: int, labels: Sequence[str], id_type: str) -> DataFrame:
    """L10. ``(id, y, pred, prob)`` by the first margins of the texts: the label of highest margin, the earliest on ties."""
    names = list(labels)

    def work(table: pa.Table) -> pa.Table:
        ids, y, margin = _settled(table, columns)
        margin = margin[:, : len(names)]
        pred = pa.array(names, pa.string()).take(pa.array(margin.argmax(axis=1)))
        prob = pa.array(ftrl_rows.logistic(margin.max(axis=1)))
        return pa.table([ids, y, pred, prob], names=["id", "y", "pred", "prob"])

    return _by_block(blocks, margins).groupBy("r").applyInArrow(work, f"id {id_type}, y string, pred string, prob double")


class Training:
    """One batch in blocks: its terms, the margins before it, and the state after it."""

    def __init__(
        self, docs: DataFrame, buckets: int | None, size: int, text_bytes: int,
        state: DataFrame | None, labels: Sequence[str], cfg: FtrlConfig,
    ):
        self.spark, self.size, self.labels, self.cfg = docs.sparkSession, size, list(labels), cfg
        self.kind = "string" if buckets is None else "int"
        self.id_type = docs.schema["id"].dataType.simpleString()
        self.deal = Deal.of(self.spark, text_bytes)
        self.kept: list[DataFrame] = []
        self.blocks = self._keep(cut(docs, self.deal, buckets).sortWithinPartitions("p"))
        self.first = state is None
        if state is None:
            state = ftrl.empty_state(self.spark, docs.selectExpr(f"CAST(NULL AS {self.kind}) AS idx").schema["idx"].dataType)
        self.begun = self._keep(start(self.blocks, self.deal, state, size, len(labels)))
        self.before: DataFrame | None = None

    def _keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(df.persist())
        return df

    def close(self) -> None:
        for df in self.kept:
            df.unpersist()

    def coordinates(self) -> tuple[int, int]:
        """Coordinates of the batch, and how many of them the state had."""
        terms = self.begun.where(F.col("kind") == TERMS)
        return tuple(x or 0 for x in terms.agg(F.sum("r"), F.sum("n")).first())

    def _terms(self, work, schema: str) -> DataFrame:
        return self.begun.where(F.col("kind") == TERMS).select("payload").mapInArrow(work, schema)

    def idf(self) -> DataFrame:
        """F2. ``(idx, idf)``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for payload in batch.column(0).to_pylist():
                    terms, idf = unpack(payload)
                    yield pa.RecordBatch.from_arrays([terms, pa.array(idf)], ["idx", "idf"])

        return self._terms(run, f"idx {self.kind}, idf double")

    def _margins(self) -> DataFrame | None:
        """Of the state before the batch; without one all are 0."""
        if self.before is None and not self.first:
            self.before = self._keep(_advance(self.blocks, self.deal, self.begun, self.begun, self.cfg))
        return self.before

    def scored(self, labels: Sequence[str]) -> DataFrame:
        return predictions(self.blocks, self._margins(), len(self.labels), labels, self.id_type)

    def train(self, passes: int) -> DataFrame:
        """L5, L7-L9. ``(idx, z, n)`` of the batch's coordinates after training every label."""
        groups = max(1, -(-self.size * len(self.labels) * 8 // OFF_BYTES))
        state, margins = self.begun, self._margins()
        for k in range(passes):
            for group in range(groups):
                shared = self.spark.sparkContext.broadcast(_errors(self.blocks, margins, self.labels, group, groups))
                whole = group == groups - 1
                more = whole and k < passes - 1
                state = self._keep(_advance(self.blocks, self.deal, self.begun, state, self.cfg, shared, whole, more))
            margins = state
        labels = len(self.labels)

        def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            (own,), (last,) = list(_rows(left)) or [None], list(_rows(right)) or [None]
            terms, (z, n) = unpack(own[4])[0], unpack(last[4])[:2]
            ends = np.arange(len(terms) + 1, dtype=np.int32) * labels
            lists = (pa.ListArray.from_arrays(ends, np.ascontiguousarray(m.T).ravel()) for m in (z, n))
            return pa.table([terms, *lists], names=["idx", "z", "n"])

        terms = self.deal.spread(self.begun.where(F.col("kind") == TERMS))
        last = state.where(F.col("kind") == STATE)
        return _cogroup(self.deal, terms, last, work, f"idx {self.kind}, z array<double>, n array<double>")


def margins(
    docs: DataFrame, buckets: int | None, text_bytes: int, state: DataFrame, idf: DataFrame, unknown: Column,
    labels: int, cfg: FtrlConfig,
) -> DataFrame:
    """Margins of all labels per text, ``(id, y, margin ARRAY)``, of ``docs(id, y, tokens)`` under a given IDF.

    Rows that share id and label count as one text, as in ``ftrl.margins``. A term that ``idf(idx, idf)`` lacks has ``unknown``.
    """
    deal = Deal.of(docs.sparkSession, text_bytes)
    table = state.join(idf, "idx", "left").withColumn("idf", F.coalesce("idf", unknown))
    id_type = docs.schema["id"].dataType.simpleString()

    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        p, rows = key[0].as_py(), list(_rows(left))
        out = [row for row in rows if row[1] == TEXTS]
        terms, _, places = _vocabulary(rows)
        if len(terms):
            z, n, at, met = _looked_up(right, terms, labels)
            of_term = np.zeros(len(terms))
            of_term[at] = met["idf"].to_numpy()
            out += _margin_rows(p, rows, places, of_term, _weights(z, n, cfg))
        return _table(out)

    def settle(table: pa.Table) -> pa.Table:
        ids, y, margin = _settled(table, labels)
        columns = {f"m{k}": pa.array(margin[:, k]) for k in range(labels)}
        return pa.table({"id": ids, "y": y, **columns})

    met = _summed(_cogroup(deal, cut(docs, deal, buckets), _state_by_part(table, deal, "idf"), work))
    names = [f"m{k}" for k in range(labels)]
    found = met.groupBy("r").applyInArrow(settle, ", ".join([f"id {id_type}", "y string", *(f"{m} double" for m in names)]))
    summed = found.groupBy("id", "y").agg(*(F.sum(m).alias(m) for m in names))
    return summed.select("id", "y", F.array(*names).alias("margin"))
