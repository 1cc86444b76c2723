"""Mutual-information weights of words for classes, and vectors weighted by them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textrill.config import JoinPolicy
from textrill.operators import word_blocks
from textrill.operators.joins import fits_broadcast, measure
from textrill.session import materialise, shared_dir


def word_weights(docs: DataFrame) -> DataFrame:
    """``(y, word, mi)`` with mi = P(c) * log2(P(w, c) / (P(w) P(c))).

    P(w) is the share of tokens, P(c) the share of texts, P(w, c) the share of texts that
    are of class c and hold w. Both counts come from one reading of the texts, as sums of blocks.
    """
    sizes = docs.groupBy("y").agg(F.count("*").alias("n")).collect()
    texts = sum(row["n"] for row in sizes)
    shares = F.create_map(*(F.lit(v) for row in sizes for v in (row["y"], row["n"] / texts)))
    y_type = docs.schema["y"].dataType.simpleString()
    met = word_blocks.words(word_blocks.cut(docs, ["y"], "y", texts=False), by=y_type)
    shared_dir(docs.sparkSession)
    counted = met.groupBy(F.col("of").alias("y"), "word").agg(F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens")).checkpoint()
    total = counted.agg(F.sum("tokens").alias("n")).first()["n"]
    # a row per class of the word
    joined = counted.withColumn("word_tokens", F.sum("tokens").over(Window.partitionBy("word")))
    p_c = shares[F.col("y")]
    p_w = F.col("word_tokens") / F.lit(float(total))
    p_wc = F.col("texts") / F.lit(float(texts))
    return joined.select("y", "word", (p_c * F.log2(p_wc / (p_w * p_c))).alias("mi"))


def weighted_vectors(
    docs: DataFrame,
    word_vec: DataFrame,
    weights: DataFrame,
    size: int,
    policy: JoinPolicy = JoinPolicy(),
) -> DataFrame:
    """``(id, y, features)``: known words' vectors times the word's share of the text's weights,
    summed, over the count of all tokens."""
    keys = ["id", "y", "_n"]
    kept = docs.withColumn("_n", F.size("tokens"))
    types = kept.schema
    blocks = materialise(word_blocks.cut(kept, keys, "y"), "blocks")
    asked = word_blocks.words(blocks, by=types["y"].dataType.simpleString())
    # a row per block, class and word: no word has more of them than there are blocks and classes
    weighed = asked.select("r", "code", "word", F.struct(F.col("of").alias("y"), "word").alias("_key")).join(
        weights.select(F.struct("y", "word").alias("_key"), "mi").hint("merge"), "_key"
    )
    known = word_vec.select("word", F.col("vec").cast("array<double>").alias("vec"))
    words, width = measure(word_vec, "word", 64 + 4 * size)
    known = F.broadcast(known) if fits_broadcast(words, width, policy) else known.hint("merge")
    met = weighed.drop("_key").where("mi IS NOT NULL").join(known, "word", "left").select("r", "code", "mi", "vec")

    def sums(kept: list, row: np.ndarray, code: np.ndarray, count: np.ndarray, found: pa.Table) -> pa.Table:
        texts, places = len(kept[0]), word_blocks.codes(code)
        at = found["code"].to_numpy()
        mi, place = np.zeros(places), np.zeros((places, size))
        mi[at] = found["mi"].to_numpy()
        place[at] = word_blocks.vectors_of(found["vec"], size)
        weight = count * mi[code]
        total = np.bincount(row, weights=weight, minlength=texts)
        has = place.any(axis=1)[code]
        row, code, weight = row[has], code[has], weight[has]
        columns = [total, *(np.bincount(row, weights=weight * place[code, p], minlength=texts) for p in range(size))]
        return pa.table([*kept, *(pa.array(c, pa.float64()) for c in columns)], names=[*keys, *names])

    names = ["_total", *(f"s{p}" for p in range(size))]
    columns = [*(f"{k} {types[k].dataType.simpleString()}" for k in keys), *(f"{name} DOUBLE" for name in names)]
    found = word_blocks.meet(blocks, met, sums, ", ".join(columns))
    summed = found.groupBy(*keys).agg(*(F.sum(name).alias(name) for name in names))
    shares = ", ".join(
        f"coalesce(try_divide(try_divide(s{p}, _total), CAST(_n AS DOUBLE)), 0.0D)"
        for p in range(size)
    )
    return summed.selectExpr("id", "y", f"array({shares}) AS features")
