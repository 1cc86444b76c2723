"""Language identification by interpolated Kneser-Ney models of characters (operator 11).

A text is its letters, lower-cased, with one blank for everything between them. For each language, Spark counts the runs of four
characters of all its training texts. The highest order keeps those counts, a lower order counts in how many different characters
its run is preceded; each order takes a discount D = n1 / (n1 + 2 n2) off its counts and passes that mass to the order below, the lowest to
an even share of the alphabet:

    P(c | h) = (count(hc) - D) / count(h) + D * kinds(h) / count(h) * P(c | h without its first)

The first terms and the shares passed on are kept per language in one array of sorted hashes and one of values. A text
takes the language of the least mean of -ln P per character; of equal ones the first by name.

Training texts of one fold calibrate: a first model that has not seen them gives the factor that turns differences of
entropy into the score, and for each language the entropy beyond which a text is rejected as unlike it. The final model
then learns from all training texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textrill.llm.common import table
from textrill.session import materialise

ORDER = 4
FOLDS, HELD_OUT, CALIBRATING = 4, 2, 3
MODEL_BYTES = 128 << 20  # of the models in one broadcast; languages beyond it go to a further pass
ENTRY_BYTES = 16
ACCEPTED = 0.999
FACTORS = tuple(float(2**k) for k in range(13))
RUN = 1 << 20  # characters handled at once
PIECE = 1 << 19
UNKNOWN = "und"

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_CONTEXT = " " * (ORDER - 1)


def letters(text: str) -> Iterator[str]:
    """The words of a text, lower-cased, a blank behind each, in pieces; a longer word than a piece is cut."""
    begin = 0
    while begin < len(text):
        end = begin + PIECE
        if end < len(text):
            blank = text.find(" ", end, end + PIECE)
            end = blank if blank >= 0 else end + PIECE
        found = _WORD.findall(text[begin:end].lower())
        if found:
            yield " ".join(found) + " "
        begin = end


@dataclass
class Run:
    """The distinct runs of ``ORDER`` characters of some pieces: their characters, and which stands at each place."""

    grams: np.ndarray
    at: np.ndarray
    counts: np.ndarray
    ends: np.ndarray


def distinct(pieces: list[str]) -> list[Run]:
    """The runs of characters of pieces that each begin with their context."""
    seen = np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4")
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    present = np.flatnonzero(np.bincount(seen))
    n = len(present)
    if n**ORDER >= 1 << 62:  # more characters than numbers have room for: a part has fewer, in the end
        return [*distinct(pieces[: len(pieces) // 2]), *distinct(pieces[len(pieces) // 2 :])] if len(pieces) > 1 else _halves(pieces[0])
    ids = np.zeros(int(present[-1]) + 1, np.int64 if n**ORDER >= 1 << 31 else np.int32)
    ids[present] = np.arange(n)
    code = ids[seen]
    whole = code[: 1 - ORDER].copy()
    for k in range(1, ORDER):
        whole = whole * n + code[k : len(code) - ORDER + 1 + k]
    begins = np.cumsum(sizes) - sizes
    inside = np.ones(len(whole), bool)
    for k in range(1, ORDER):
        inside[begins[1:] - k] = False
    found, at, counts = np.unique(whole[inside], return_inverse=True, return_counts=True)
    places = [(found // n ** (ORDER - 1 - k)) % n for k in range(ORDER)]
    return [Run(present[np.stack(places, axis=1)], at, counts, np.cumsum(sizes - ORDER + 1))]


def _halves(piece: str) -> list[Run]:
    middle = len(piece) // 2
    first, second = distinct([piece[: middle + ORDER - 1]])[0], distinct([piece[middle:]])[0]
    grams = np.concatenate([first.grams, second.grams])
    at = np.concatenate([first.at, second.at + len(first.grams)])
    return [Run(grams, at, np.concatenate([first.counts, second.counts]), np.array([len(at)]))]


def hashes(chars: np.ndarray, context: bool) -> np.ndarray:
    """A hash of each row of characters, its length, and whether it is a context or a whole run."""
    # the start is far from any character, so that runs and contexts can't take each other's place
    h = np.full(len(chars), (2 * chars.shape[1] + context + 1) * 0xD6E8FEB86659FD93 % (1 << 64), np.uint64)
    for k in range(chars.shape[1]):
        h = (h ^ chars[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9) ^ (h >> np.uint64(32))


@dataclass(frozen=True)
class Model:
    """One language: sorted hashes of runs and contexts, and what each adds or passes on."""

    lang: str
    keys: np.ndarray
    values: np.ndarray
    even: float

    def value(self, h: np.ndarray, missing: float) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.values[at], missing)

    def surprise(self, grams: np.ndarray, hashed: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """-ln P of each run's last character after the others."""
        p = np.full(len(grams), self.even)
        for own, context in hashed:
            p = self.value(own, 0.0) + self.value(context, 1.0) * p
        return -np.log(p)


def _hashed(grams: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """By order, from the lowest: hashes of the run and of its context."""
    return [(hashes(grams[:, ORDER - k :], False), hashes(grams[:, ORDER - k : -1], True)) for k in range(1, ORDER + 1)]


def mean_surprise(texts: list[str | None], models: list[Model]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of each text, and the mean of -ln P per language; a text of any length is taken in pieces."""
    sizes, sums = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(models)))
    pieces: list[str] = []
    owner: list[int] = []

    def close() -> None:
        done = 0
        for run in distinct(pieces):
            hashed = _hashed(run.grams)
            of = np.array(owner[done : done + len(run.ends)])
            done += len(run.ends)
            begins = np.concatenate([[0], run.ends[:-1]])
            np.add.at(sizes, of, run.ends - begins)
            for k, model in enumerate(models):
                each = model.surprise(run.grams, hashed)[run.at]
                np.add.at(sums[:, k], of, np.add.reduceat(each, begins))
        pieces.clear()
        owner.clear()

    held = 0
    for i, text in enumerate(texts):
        before = _CONTEXT
        for piece in letters(text or ""):
            pieces.append(before + piece)
            owner.append(i)
            before = pieces[-1][1 - ORDER :]
            held += len(piece)
            if held >= RUN:
                close()
                held = 0
    if pieces:
        close()
    return sizes, sums / np.maximum(sizes, 1)[:, None]


def text_runs(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a batch in runs of about ``RUN`` characters, with the row each begins at."""
    texts, held, begun = [], 0, 0
    for i, text in enumerate(batch.column(column)):
        texts.append(text.as_py())
        held += len(texts[-1] or "")
        if held >= RUN or i + 1 == batch.num_rows:
            yield begun, texts
            texts, held, begun = [], 0, i + 1


def gram_counts(rows: DataFrame) -> DataFrame:
    """``(lang, part, gram, n)`` of ``rows(lang, part, text)``: counted per run in the tasks, then by Spark."""

    def flush(held: dict[tuple[str, int], list[str]]) -> Iterator[pa.RecordBatch]:
        for (lang, part), pieces in held.items():
            for run in distinct(pieces):
                m = len(run.grams)
                joined = run.grams.astype("<u4").tobytes().decode("utf-32-le")
                grams = [joined[i : i + ORDER] for i in range(0, ORDER * m, ORDER)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * m, pa.string()), pa.array(np.full(m, part, np.int32)), pa.array(grams, pa.string()), pa.array(run.counts.astype(np.int64))],
                    ["lang", "part", "gram", "n"],
                )
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[str]] = {}
        size = 0
        for batch in batches:
            for lang, part, text in zip(*batch.columns):
                before = _CONTEXT
                for piece in letters(text.as_py() or ""):
                    held.setdefault((lang.as_py(), part.as_py()), []).append(before + piece)
                    before = (before + piece)[1 - ORDER :]
                    size += len(piece)
                    if size >= 4 * RUN:
                        yield from flush(held)
                        size = 0
        yield from flush(held)

    counted = rows.select("lang", "part", "text").mapInArrow(run, "lang string, part int, gram string, n long")
    return counted.groupBy("lang", "part", "gram").agg(F.sum("n").alias("n"))


def entries(counts: DataFrame) -> DataFrame:
    """``(model, lang, gram, context, value)`` of ``counts(model, lang, gram, n)``: all orders' terms and shares.

    Every order is a few sums that combine before they are shuffled; discounts are a row per language and order.
    """
    orders = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        last = F.substring("gram", 2, k).alias("gram")
        orders[k] = orders[k + 1].groupBy("model", "lang", last).agg(F.count("*").alias("n"))
    found = []
    for k, order in orders.items():
        ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        cut = F.when((ones > 0) & (twos > 0), ones / (ones + 2 * twos)).otherwise(0.5)
        cuts = order.groupBy("model", "lang").agg(cut.alias("cut"))
        head = order.withColumn("head", F.substring("gram", 1, k - 1))
        contexts = head.groupBy("model", "lang", "head").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        contexts = contexts.join(cuts, ["model", "lang"])
        terms = head.join(contexts, ["model", "lang", "head"])
        found.append(terms.select("model", "lang", "gram", F.lit(False).alias("context"), ((F.col("n") - F.col("cut")) / F.col("total")).alias("value")))
        found.append(contexts.select("model", "lang", F.col("head").alias("gram"), F.lit(True), F.col("cut") * F.col("kinds") / F.col("total")))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def sorted_arrays(lang: str, rows: pa.Table, even: float) -> Model:
    keys, values = [], []
    grams = np.array(rows["gram"].to_pylist(), object)
    context, value = rows["context"].to_numpy(), rows["value"].to_numpy()
    lengths = np.fromiter(map(len, grams), np.int64, len(grams))
    for k in range(ORDER + 1):
        for kind in (False, True):
            at = np.flatnonzero((lengths == k) & (context == kind))
            if len(at):
                chars = np.frombuffer("".join(grams[at]).encode("utf-32-le"), "<u4").reshape(len(at), k)
                keys.append(hashes(chars, kind))
                values.append(value[at])
    h = np.concatenate(keys)
    order = np.argsort(h)
    return Model(lang, h[order], np.concatenate(values)[order], even)


class Models:
    """The languages of one model in groups, none of which holds more than ``MODEL_BYTES`` in its arrays.

    Sizes are counted by Spark before anything is read. A single language beyond the bound is an error: it would have
    over eight million runs and contexts of up to four characters.
    """

    def __init__(self, found: DataFrame, model: int, most: int = MODEL_BYTES):
        mine = found.where(F.col("model") == model)
        sizes = mine.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()  # a row per language
        alphabet = mine.where((F.length("gram") == 1) & ~F.col("context")).select("gram").distinct().count()
        self.found, self.even = mine, 1.0 / (alphabet + 1)
        self.groups: list[list[str]] = []
        held = most
        for lang, n in sizes:
            size = n * ENTRY_BYTES
            if size > most:
                raise ValueError(f"the model of {lang!r} has {n} entries, more than {most} bytes")
            if held + size > most:
                self.groups.append([])
                held = 0
            self.groups[-1].append(lang)
            held += size
        self.langs = [lang for group in self.groups for lang in group]

    def read(self, group: list[str]) -> list[Model]:
        rows = self.found.where(F.col("lang").isin(group)).select("lang", "gram", "context", "value").toArrow()
        names = rows["lang"].combine_chunks()
        return [sorted_arrays(lang, rows.filter(pa.compute.equal(names, lang)), self.even) for lang in group]

    def entropies(self, docs: DataFrame) -> DataFrame:
        """Add ``size`` (characters) and ``h`` (mean of -ln P by language) and drop the column ``text``, the last of ``docs``.

        One pass without a shuffle per group of languages.
        """
        kept = docs.columns[:-1]
        types = {c: docs.schema[c].dataType.simpleString() for c in kept}
        out = docs.select(*kept, F.lit(0).cast("long").alias("size"), F.array().cast("array<double>").alias("h"), "text")
        for i, group in enumerate(self.groups):
            last = i + 1 == len(self.groups)
            shared = docs.sparkSession.sparkContext.broadcast(self.read(group))
            names = [*kept, "size", "h", *([] if last else ["text"])]
            m = len(kept)

            def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last, names=names) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for begin, texts in text_runs(batch, m + 2):
                        sizes, means = mean_surprise(texts, shared.value)
                        part = batch.slice(begin, len(texts))
                        before = np.array(part.column(m + 1).to_pylist(), np.float64).reshape(len(texts), -1)
                        both = np.hstack([before, means])
                        ends = np.arange(len(texts) + 1, dtype=np.int32) * both.shape[1]
                        lists = pa.ListArray.from_arrays(ends, both.ravel())
                        yield pa.RecordBatch.from_arrays(
                            [*part.columns[:m], pa.array(sizes), lists, *([] if last else [part.column(m + 2)])], names
                        )

            fields = [*(f"`{c}` {t}" for c, t in types.items()), "size long", "h array<double>", *([] if last else ["text string"])]
            out = out.mapInArrow(run, ", ".join(fields))
        return out


def weights(h: np.ndarray, factor: float) -> np.ndarray:
    """Shares of the languages: exp(-factor * entropy), of sum 1."""
    e = np.exp(-factor * (h - h.min(axis=1, keepdims=True)))
    return e / e.sum(axis=1, keepdims=True)


def calibrated(judged: DataFrame, langs: list[str]) -> tuple[float, dict[str, float]]:
    """The factor of the score with the least log loss, and per language the entropy that nearly all its texts stay below.

    ``judged(lang, size, h)`` comes from a model that hasn't seen these texts.
    """
    place = {lang: k for k, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss = np.zeros(len(FACTORS))
        for batch in batches:
            if batch.num_rows:
                own = np.array([place[x] for x in batch.column(0).to_pylist()])
                h = batch.column(1).flatten().to_numpy().reshape(len(own), -1)
                for k, factor in enumerate(FACTORS):
                    loss[k] -= np.log(np.maximum(weights(h, factor)[np.arange(len(own)), own], 1e-300)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(loss)), pa.int32()), pa.array(loss)], ["k", "loss"])

    known = judged.where(F.col("lang").isin(langs) & (F.col("size") > 0)).select("lang", "h")
    found = known.mapInArrow(run, "k int, loss double").groupBy("k").agg(F.sum("loss").alias("loss")).orderBy("loss", "k").first()
    own = F.element_at(F.map_from_arrays(F.array(*map(F.lit, langs)), F.col("h")), F.col("lang"))
    limits = known.groupBy("lang").agg(F.percentile_approx(own, F.lit(ACCEPTED), F.lit(10_000)).alias("limit"))
    return FACTORS[found["k"] if found else 0], {r["lang"]: r["limit"] for r in limits.collect()}


@dataclass(frozen=True)
class Identifier:
    """A trained set of languages with its calibration."""

    models: Models | None
    factor: float = 1.0
    limits: tuple[tuple[str, float], ...] = ()

    def predict(self, docs: DataFrame, *keys: str) -> DataFrame:
        """``(*keys, lang_pred, score, rejected, entropy)`` of every row of ``docs(*keys, text)``.

        A null text and one without a letter are ``und`` with score 0, and so is everything where nothing was
        learned. ``rejected`` marks texts whose best entropy exceeds what nearly all calibrating texts of that language had.
        """
        if self.models is None or not self.models.langs:
            return docs.select(
                *keys, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"),
                F.lit(None).cast("double").alias("entropy"),
            )
        judged = self.models.entropies(docs.select(*keys, "text"))
        langs, factor, limits = self.models.langs, self.factor, dict(self.limits)
        limit = np.array([limits.get(lang, np.inf) for lang in langs])
        types = [f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys]
        m = len(keys)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = np.array([*langs, UNKNOWN], object)
            for batch in batches:
                h = batch.column(m + 1).flatten().to_numpy().reshape(batch.num_rows, len(langs))
                some = batch.column(m).to_numpy() > 0
                best = h.argmin(axis=1)
                least = h.min(axis=1)
                score = np.where(some, weights(h, factor).max(axis=1), 0.0) if len(h) else np.zeros(0)
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[:m], pa.array(names[np.where(some, best, len(langs))], pa.string()), pa.array(score),
                        pa.array(~some | (least > limit[best])), pa.array(least, mask=~some),
                    ],
                    [*keys, "lang_pred", "score", "rejected", "entropy"],
                )

        return judged.mapInArrow(run, ", ".join([*types, "lang_pred string, score double, rejected boolean, entropy double"]))


def fold(doc_id: Column) -> Column:
    """The fold of a row by its id; one without an id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS, F.lit(HELD_OUT))


def train(rows: DataFrame, most: int = MODEL_BYTES) -> Identifier:
    """Learn from all ``rows(lang, text, part)``; those of part 1 also calibrate.

    Rows without a language or text teach nothing. Every text counts whole; equal texts count each time. A
    language is a value of ``lang`` with a letter in one of its texts.
    """
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = materialise(gram_counts(rows), "gram-counts")
    # model 0 hasn't seen the calibrating texts, model 1 has learned from all
    both = counts.withColumn("model", F.explode(F.when(F.col("part") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    summed = materialise(both.groupBy("model", "lang", "gram").agg(F.sum("n").alias("n")), "gram-sums")
    found = materialise(entries(summed), "language-models")
    first, last = Models(found, 0, most), Models(found, 1, most)
    if not last.langs:
        return Identifier(None)
    if not first.langs:
        return Identifier(last)
    judged = materialise(first.entropies(rows.where("part = 1").select("lang", "text")), "calibration")
    factor, limits = calibrated(judged, first.langs)
    return Identifier(last, factor, tuple(sorted(limits.items())))


def op11_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = (fold(F.col("doc_id")) == CALIBRATING).cast("int")
    known = docs.where(fold(F.col("doc_id")) != HELD_OUT).select("lang", "text", part.alias("part"))
    found = train(known).predict(docs, "doc_id")
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(True))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected", "entropy")
