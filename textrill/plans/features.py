"""From raw text to the features of the learners (F14), as one function per choice.

A featuriser gives long features. One that can also give a row per text says so by an attribute: ``vectors`` for rows
``(id, y, v)``, ``terms`` for rows ``(id, y, idx, v)`` whose values still take the batch's IDF.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from textrill.config import JoinPolicy, TextConfig
from textrill.operators import cleaning, ftrl, ftrl_rows, tfidf, wordvec
from textrill.operators.joins import fits_broadcast

Featurise = Callable[[DataFrame, int], DataFrame]


def tokens_of(cfg: TextConfig) -> Callable[[DataFrame], DataFrame]:
    """``(id, y, text)`` to ``(id, y, tokens)``: clean, then split."""
    separator = " " if cfg.cleaners else cfg.separator

    def run(docs: DataFrame) -> DataFrame:
        cleaned = docs.select("id", "y", "text").transform(cleaning.cleaner(cfg))
        return cleaning.tokenise(cleaned, separator)

    return run


def featuriser(
    cfg: TextConfig, word_vec: DataFrame | None = None, policy: JoinPolicy = JoinPolicy()
) -> Featurise:
    """F14. The featuriser named in the settings; TF-IDF is refitted on every batch."""
    split = tokens_of(cfg)

    def terms(batch: DataFrame, batch_id: int) -> DataFrame:
        return tfidf.tfidf(split(batch), cfg.hash_buckets, ["y"], policy)

    seen: dict[str, object] = {}  # the table is counted once, and sent to the tasks once where it is small enough

    def means(batch: DataFrame) -> DataFrame:
        if word_vec is None:
            raise ValueError("the word_vectors featuriser needs a word-vector table")
        if "words" not in seen:
            seen["words"] = wordvec.vector_sizes(word_vec, cfg.vector_size)
            if fits_broadcast(*seen["words"], policy):
                seen["table"] = wordvec.VectorTable.of(word_vec)
        if "table" in seen:
            return wordvec.row_vectors(split(batch), seen["table"], cfg.vector_size, ["y"])
        return wordvec.document_vectors(split(batch), word_vec, cfg.vector_size, ["y"], policy, seen["words"])

    def vectors(batch: DataFrame, batch_id: int) -> DataFrame:
        return ftrl.dense_features(means(batch))

    terms.tokens, terms.buckets = split, cfg.hash_buckets
    terms.terms = lambda batch, batch_id: ftrl_rows.term_rows(split(batch), cfg.hash_buckets)
    vectors.vectors = lambda batch, batch_id: ftrl_rows.vector_rows(means(batch))

    choices: dict[str, Featurise] = {"tfidf": terms, "word_vectors": vectors}
    if cfg.featuriser not in choices:
        raise ValueError(f"unknown featuriser {cfg.featuriser!r}; known are {sorted(choices)}")
    return choices[cfg.featuriser]


def fitted(
    cfg: TextConfig, idf: DataFrame, texts: int, policy: JoinPolicy = JoinPolicy()
) -> Featurise:
    """F14, S11. TF-IDF with the IDF of an earlier batch, ``idf(idx, idf)`` fitted on ``texts`` texts.

    A text has the same features alone as among others. A term that the batch lacked counts as in no text.
    """
    split = tokens_of(cfg)

    def run(batch: DataFrame, batch_id: int) -> DataFrame:
        return tfidf.weighted(split(batch), idf, texts, cfg.hash_buckets, ["y"], policy)

    return run


def dense(batch: DataFrame, batch_id: int) -> DataFrame:
    """Featuriser of rows that already are vectors, ``(id, y, features)``."""
    return ftrl.dense_features(batch)


dense.vectors = lambda batch, batch_id: ftrl_rows.vector_rows(batch)
