"""The registered queries: one per operator, over whole tables, with the SQL that must agree.

``@query(name, sql)`` registers a function ``(spark, sf_dir) -> DataFrame``. Results that
several queries read, such as a model trained on a table, are made once per session and
folder, as written tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textrill.checks import sql
from textrill.config import FtrlConfig, JoinPolicy, SgdConfig, TextConfig
from textrill.functions import linear
from textrill.functions import text as tx
from textrill.operators import (
    cleaning,
    ftrl,
    ftrl_rows,
    labelled,
    metrics,
    multiclass,
    mutual_info,
    naive_bayes,
    sgd,
    tfidf,
    wordvec,
)
from textrill.plans import classifier, compare, features, learners, prequential
from textrill.session import materialise, scratch_path
from textrill.sources import lines as line_io
from textrill.sources import records
from textrill.sources.model_store import ModelStore
from textrill.streaming import learning

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_made: dict[tuple, object] = {}

BATCHES = 5
SIZE = 50
CFG = FtrlConfig()
TEXT = TextConfig(separator="[ \n]", cleaners=("clear", "characters"))
r6 = linear.rounded


def query(name: str, statement: str | None = None):
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if statement is not None:
            SQL[name] = statement
        return run

    return register


def once(name: str):
    """Make the result of ``f(spark, sf_dir)`` once per session and folder."""

    def wrap(make):
        def get(spark: SparkSession, sf: str):
            key = (name, spark.sparkContext.applicationId, sf)
            if key not in _made:
                _made[key] = make(spark, sf)
            return _made[key]

        get.fresh = make
        return get

    return wrap


def forget() -> None:
    """Drop the shared results, so that the next query makes its own."""
    _made.clear()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("y"), "text"
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, y, tokens)``: cleaned documents."""
    return raw_documents(spark, sf).transform(features.tokens_of(TEXT))


def batched(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    return prequential.with_batch(docs, batches)


def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Short texts: the lines of the documents, ``(doc_id, lang, line_no, line)``."""
    return table(spark, sf, "documents").select(
        "doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("label").cast("string").alias("y"),
        F.transform("embedding", lambda v: v.cast("double")).alias("features"),
    )


def long(features_table: DataFrame, *keys: str) -> DataFrame:
    return features_table.select(*keys, F.posexplode_outer("features").alias("pos", "x"))


# --- sources and sinks ------------------------------------------------------------------

LINE_COUNTS = sql.with_(sql.LINES) + (
    "\nSELECT line AS value, count(*)::BIGINT AS copies FROM lines GROUP BY line"
)


def _line_file(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "lines")
    table(spark, sf, "documents").select("text").write.text(path)
    return path


@query("s1_read_lines", LINE_COUNTS)
def s1(spark, sf):
    read = line_io.read_lines(spark, _line_file(spark, sf))
    return read.groupBy("value").agg(F.count("*").alias("copies"))


@query("s2_stream_lines", LINE_COUNTS)
def s2(spark, sf):
    source, sink = _line_file(spark, sf), scratch_path(spark, "streamed")
    stream = line_io.stream_lines(spark, source)

    def append(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    run = learning.each_batch(stream, append, scratch_path(spark, "progress"), available_now=True)
    run.awaitTermination()
    read = spark.read.parquet(sink)
    return read.groupBy("value").agg(F.count("*").alias("copies"))


LABELLED_LINES = (
    "SELECT replace(line, chr(9), ' ') AS line, quality::VARCHAR AS quality FROM lines "
    "LEFT JOIN labels USING (doc_id)"
)


@query(
    "s3_parse_labelled",
    sql.with_(sql.LINES, ("l", LABELLED_LINES))
    + "\nSELECT line AS text, coalesce(quality, 'reject') AS y, count(*)::BIGINT AS copies "
    "FROM l GROUP BY ALL",
)
def s3(spark, sf):
    path = scratch_path(spark, "labelled")
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("y"))
    named = document_lines(spark, sf).join(labels, "doc_id", "left")
    named = named.withColumn("text", F.translate("line", "\t", " "))
    line_io.write_labelled(named, path)
    rows, rejects = line_io.parse_labelled(line_io.read_lines(spark, path))
    every = rows.unionByName(rejects.select(F.col("value").alias("text"), F.lit("reject").alias("y")))
    return every.groupBy("text", "y").agg(F.count("*").alias("copies"))


@query(
    "s4_parse_wide",
    sql.with_(sql.LINES)
    + "\nSELECT doc_id::VARCHAR AS id, replace(line, chr(9), ' ') AS text, lang AS y, "
    "count(*)::BIGINT AS copies FROM lines GROUP BY ALL",
)
def s4(spark, sf):
    path = scratch_path(spark, "wide")
    wide = document_lines(spark, sf).select(
        F.concat_ws("\t", "doc_id", "line_no", F.translate("line", "\t", " "), "lang")
    )
    wide.write.text(path)
    rows, _ = line_io.parse_labelled(line_io.read_lines(spark, path), 2, 3, id_field=0)
    return rows.groupBy("id", "text", "y").agg(F.count("*").alias("copies"))


@query(
    "s5_attach_labels",
    "SELECT doc_id AS id, quality::VARCHAR AS y, n_chars FROM documents JOIN labels USING (doc_id)",
)
def s5(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("y")
    )
    return labelled.attach_labels(docs, labels).select("id", "y", "n_chars")


@query(
    "s5_unlabelled",
    "SELECT doc_id AS id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def s5_unlabelled(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    return labelled.unlabelled(docs, table(spark, sf, "labels").select(F.col("doc_id").alias("id")))


@query(
    "s5_labels_by_position",
    "WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS o FROM documents), "
    "l AS (SELECT doc_id AS label_id, quality, row_number() OVER (ORDER BY doc_id) - 1 AS o FROM labels) "
    "SELECT o::BIGINT AS ordinal, doc_id, label_id, quality FROM d JOIN l USING (o)",
)
def s5_position(spark, sf):
    docs = labelled.with_ordinal(table(spark, sf, "documents").select("doc_id"), ["doc_id"])
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("label_id"), "quality")
    return docs.join(labelled.with_ordinal(labels, ["label_id"]), "ordinal").select(
        F.col("ordinal").cast("long").alias("ordinal"), "doc_id", "label_id", "quality"
    )


@query(
    "s5_positions_without_label",
    "SELECT * FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, doc_id FROM documents) "
    "WHERE ordinal >= (SELECT count(*) FROM labels)",
)
def s5_positions(spark, sf):
    docs = labelled.with_ordinal(table(spark, sf, "documents").select("doc_id"), ["doc_id"])
    labels = labelled.with_ordinal(table(spark, sf, "labels").select("doc_id"), ["doc_id"])
    return labelled.unlabelled(docs, labels, "ordinal").select(F.col("ordinal").cast("long").alias("ordinal"), "doc_id")


# stop words: cleaned words that occur in more than a tenth of the benchmark texts
STOP_SQL = (
    "stop",
    f"SELECT word FROM (SELECT item_id, unnest(list_distinct({sql.java_split('c')})) AS word FROM "
    f"(SELECT item_id, {sql.CLEANED} AS c FROM benchmark)) GROUP BY word "
    "HAVING count(*) * 10 > (SELECT count(*) FROM benchmark)",
)


@once("stop_words")
def stop_file(spark, sf) -> str:
    path = scratch_path(spark, "stop-words")
    items = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("id"), F.lit("").alias("y"), "text"
    )
    items = items.transform(features.tokens_of(TEXT))
    common = tfidf.document_frequency(items).where(F.col("df") * 10 > items.count())
    common.select("idx").write.text(path)
    return path


@query("s6_stop_word_list", sql.with_(STOP_SQL) + "\nSELECT word FROM stop")
def s6(spark, sf):
    return line_io.read_stop_words(spark, stop_file(spark, sf)).select("word")


@query(
    "s7_read_corpus",
    "WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark), "
    f"t AS (SELECT {sql.java_split('line')} AS tokens FROM l) "
    "SELECT array_to_string(tokens, '|') AS tokens, len(tokens)::INTEGER AS n, "
    "count(*)::BIGINT AS copies FROM t GROUP BY ALL",
)
def s7(spark, sf):
    path = scratch_path(spark, "corpus")
    table(spark, sf, "benchmark").select("text").write.text(path)
    corpus = line_io.read_corpus(spark, path)
    return corpus.groupBy(
        F.array_join("tokens", "|").alias("tokens"), F.size("tokens").alias("n")
    ).agg(F.count("*").alias("copies"))


def hashed_vector(word: Column, size: int) -> Column:
    """Check vectors: numbers from the digits of a digest of the word, the same in any engine."""

    def value(pos: int) -> Column:
        digest = F.md5(F.concat(word, F.lit(f"#{pos // 16}")))
        byte = F.conv(F.substring(digest, 2 * (pos % 16) + 1, 2), 16, 10).cast("double")
        return ((byte - 127.5) / 1275.0).cast("float")

    return F.array(*(value(pos) for pos in range(size)))


@once("base_vectors")
def base_vectors(spark, sf) -> DataFrame:
    items = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("id"), F.lit("").alias("y"), "text"
    )
    words = tfidf.vocabulary(items.transform(features.tokens_of(TEXT)))
    vectors = words.select(
        F.col("term").alias("word"),
        hashed_vector(F.col("term"), SIZE).alias("vec"),
        F.lit("base").alias("origin"),
    )
    return materialise(vectors, "word-vectors")


@query(
    "s8_word_vectors",
    sql.with_(sql.BASE_WORDS, ("wv", sql.hashed_vectors("base", SIZE)))
    + f"\nSELECT word, pos::INTEGER AS pos, {sql.r6('x')} AS x FROM wv",
)
def s8(spark, sf):
    path = scratch_path(spark, "saved-vectors")
    base_vectors(spark, sf).write.parquet(path)
    loaded = wordvec.load_word_vectors(spark, path)
    values = loaded.select("word", F.posexplode("vec").alias("pos", "x"))
    return values.withColumn("x", r6(F.col("x").cast("double")))


@query(
    "s9_records",
    "SELECT NULL::VARCHAR AS key, role || ': ' || text AS value, count(*)::BIGINT AS copies "
    "FROM conversations GROUP BY ALL",
)
def s9(spark, sf):
    path = scratch_path(spark, "records")
    turns = table(spark, sf, "conversations").select(F.concat("role", F.lit(": "), "text").alias("value"))
    records.write_records(turns, format="parquet", path=path)
    read = spark.read.parquet(path)
    return read.groupBy("key", "value").agg(F.count("*").alias("copies"))


@query("s10_stream_restart", LINE_COUNTS)
def s10(spark, sf):
    """A stream stopped and started again goes on after the files it has read."""
    source, sink = scratch_path(spark, "arriving"), scratch_path(spark, "streamed")
    progress = scratch_path(spark, "progress")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")

    def append(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    for _, part in prequential.split_batches(docs, 2):
        part.select("text").write.mode("append").text(source)
        learning.each_batch(
            line_io.stream_lines(spark, source), append, progress, available_now=True
        ).awaitTermination()
    read = spark.read.parquet(sink)
    return read.groupBy("value").agg(F.count("*").alias("copies"))


# --- text cleaning ----------------------------------------------------------------------


@query(
    "t0_tokens",
    f"SELECT doc_id AS id, len({sql.java_split('text')})::INTEGER AS n, "
    f"array_to_string({sql.java_split('text')}, '|') AS tokens FROM documents",
)
def t0(spark, sf):
    split = cleaning.tokenise(raw_documents(spark, sf))
    return split.select("id", F.size("tokens").alias("n"), F.array_join("tokens", "|").alias("tokens"))


@query("t1_clear", f"SELECT doc_id AS id, {sql.clear('text')} AS text FROM documents")
def t1(spark, sf):
    return cleaning.clear_text(raw_documents(spark, sf)).select("id", "text")


@query(
    "t1_clear_line_ends", f"SELECT doc_id AS id, {sql.clear(sql.spaced('text'))} AS text FROM documents"
)
def t1_lines(spark, sf):
    return cleaning.clear_text(raw_documents(spark, sf), "[ \n]").select("id", "text")


@query(
    "t2_filter_characters",
    f"SELECT page_id AS id, {sql.plain('html')} AS text FROM pages",
)
def t2(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    return cleaning.filter_characters(pages)


STOPPED = sql.with_(STOP_SQL, ("stops", "SELECT list(word) AS ws FROM stop")) + (
    f"\nSELECT doc_id AS id, array_to_string(list_filter({sql.java_split(sql.spaced('text'))}, "
    "lambda w: NOT list_contains(ws, w)), ' ') AS text FROM documents, stops"
)


@query("t3_stop_words", STOPPED)
def t3(spark, sf):
    words = line_io.read_stop_words(spark, stop_file(spark, sf))
    return cleaning.remove_stop_words(raw_documents(spark, sf), words, "[ \n]").select("id", "text")


@query("t3_stop_words_joined", STOPPED)
def t3_joined(spark, sf):
    words = line_io.read_stop_words(spark, stop_file(spark, sf))
    return cleaning.remove_stop_words(
        raw_documents(spark, sf), words, "[ \n]", policy=JoinPolicy(broadcast_bytes=0)
    ).select("id", "text")


@query("t3_stream_of_long_list", STOPPED)
def t3_stream(spark, sf):
    """A stream, and a list of over 10,000 words that takes several steps."""
    words = line_io.read_stop_words(spark, stop_file(spark, sf)).select("word")
    more = spark.range(10_001).select(F.concat(F.lit("absent"), F.col("id").cast("string")).alias("word"))
    source, progress, out = (scratch_path(spark, name) for name in ("arriving", "progress", "stopped"))
    raw_documents(spark, sf).write.parquet(source)
    stream = line_io.stream_table(spark, source, "id BIGINT, y STRING, text STRING")
    kept = cleaning.remove_stop_words(stream, words.unionAll(more), "[ \n]", policy=JoinPolicy(broadcast_bytes=1 << 18))
    writer = kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select("id", "text")


@query("t4_cleaner_chain", f"SELECT doc_id AS id, {sql.CLEANED} AS text FROM documents")
def t4(spark, sf):
    return raw_documents(spark, sf).transform(cleaning.cleaner(TEXT)).select("id", "text")


# --- features ---------------------------------------------------------------------------


@query("f1_hashed_term_counts")
def f1_hashed(spark, sf):
    return tfidf.term_counts(documents(spark, sf), 1 << 20)


@query(
    "f1_term_counts",
    sql.with_(sql.documents(), *sql.TFIDF[:2]) + "\nSELECT id, idx, tf FROM tf",
)
def f1(spark, sf):
    return tfidf.term_counts(documents(spark, sf)).where(F.col("idx").isNotNull())


@query(
    "f2_idf",
    sql.with_(sql.documents(), *sql.TFIDF[:4])
    + f"\nSELECT idx, df::BIGINT AS df, {sql.r6('ln((m + 1)::DOUBLE / (df + 1)::DOUBLE)')} AS idf "
    "FROM df JOIN m USING (batch)",
)
def f2(spark, sf):
    idf = tfidf.inverse_document_frequency(documents(spark, sf))
    return idf.withColumn("idf", r6("idf"))


@query(
    "f3_tfidf",
    sql.with_(sql.documents(), *sql.TFIDF) + f"\nSELECT id, idx, {sql.r6('v')} AS v FROM feats",
)
def f3(spark, sf):
    feats = tfidf.tfidf(documents(spark, sf)).where(F.col("idx").isNotNull())
    return feats.withColumn("v", r6("v"))


@query(
    "f4_tfidf_by_batch",
    sql.with_(sql.documents(BATCHES), *sql.TFIDF)
    + f"\nSELECT batch, id, idx, {sql.r6('v')} AS v FROM feats",
)
def f4(spark, sf):
    feats = tfidf.tfidf_by_batch(batched(documents(spark, sf))).where(F.col("idx").isNotNull())
    return feats.withColumn("v", r6("v"))


@query("f5_term_bucket")
def f5(spark, sf):
    words = tfidf.vocabulary(documents(spark, sf))
    return words.withColumn("bucket", tx.hash_bucket(F.col("term")))


@query("f6_train_word_vectors")
def f6(spark, sf):
    corpus = table(spark, sf, "benchmark").select(
        F.lit(0).alias("id"), F.lit("").alias("y"), "text"
    ).transform(features.tokens_of(TEXT))
    return wordvec.train_word_vectors(corpus, SIZE)


VECTORS = sql.with_(sql.documents(), *sql.document_vectors(SIZE)) + (
    f"\nSELECT id, pos::INTEGER AS pos, {sql.r6('x')} AS x FROM vecs"
)


@query("f7_document_vectors", VECTORS)
def f7(spark, sf):
    vecs = wordvec.document_vectors(documents(spark, sf), base_vectors(spark, sf), SIZE)
    return long(vecs, "id").withColumn("x", r6("x"))


@query("f7_document_vectors_shuffled", VECTORS)
def f7_shuffled(spark, sf):
    """The same with a vector table beyond the broadcast bound."""
    vecs = wordvec.document_vectors(
        documents(spark, sf), base_vectors(spark, sf), SIZE, policy=JoinPolicy(broadcast_bytes=0)
    )
    return long(vecs, "id").withColumn("x", r6("x"))


@query("f7s_train_then_embed")
def f7s(spark, sf):
    vectors = materialise(f6(spark, sf), "trained-vectors")
    return long(wordvec.document_vectors(documents(spark, sf), vectors, SIZE), "id")


def _short_texts(spark, sf) -> DataFrame:
    short = document_lines(spark, sf).select(
        F.concat_ws(":", "doc_id", "line_no").alias("id"),
        F.col("lang").alias("y"),
        F.col("line").alias("text"),
    )
    return short.transform(features.tokens_of(TEXT))


SHORT_SQL = [
    sql.LINES,
    (
        "short",
        f"SELECT 0 AS batch, doc_id || ':' || line_no AS id, lang AS y, {sql.java_split('c')} AS tokens "
        f"FROM (SELECT doc_id, line_no, lang, {sql.plain(sql.spaced('line'))} AS c FROM lines)",
    ),
    sql.BASE_WORDS,
    (
        "unfamiliar",
        "SELECT * FROM short WHERE id NOT IN (SELECT id FROM (SELECT id, unnest(tokens) AS word "
        "FROM short) WHERE word IN (SELECT word FROM base))",
    ),
    (
        "vocab",
        "SELECT word, count(*)::BIGINT AS cn FROM (SELECT unnest(tokens) AS word FROM unfamiliar) "
        "GROUP BY word",
    ),
]


@query(
    "f8_unfamiliar_texts",
    sql.with_(*SHORT_SQL[:4]) + "\nSELECT id, array_to_string(tokens, ' ') AS text FROM unfamiliar",
)
def f8(spark, sf):
    texts = wordvec.unfamiliar_texts(_short_texts(spark, sf), base_vectors(spark, sf))
    return texts.select("id", F.array_join("tokens", " ").alias("text"))


@query(
    "f9_new_vocabulary",
    sql.with_(*SHORT_SQL)
    + "\nSELECT word, cn, (row_number() OVER (ORDER BY cn DESC, word) - 1)::BIGINT AS position FROM vocab",
)
def f9(spark, sf):
    texts = wordvec.unfamiliar_texts(_short_texts(spark, sf), base_vectors(spark, sf))
    return wordvec.indexed_vocabulary(texts).select(
        "word", "cn", F.col("position").cast("long").alias("position")
    )


@query("f10_train_new_words")
def f10(spark, sf):
    return wordvec.train_new_words(_short_texts(spark, sf), base_vectors(spark, sf), SIZE)


@query(
    "f11_merge_vectors",
    sql.with_(
        sql.documents(),
        sql.BASE_WORDS,
        ("words", "SELECT DISTINCT unnest(tokens) AS word FROM docs"),
        ("merged", "SELECT word, 'base' AS origin FROM base UNION ALL "
         "SELECT word, 'added' FROM words WHERE word NOT IN (SELECT word FROM base)"),
        ("wv", sql.hashed_vectors("(SELECT DISTINCT word FROM merged)", SIZE)),
    )
    + f"\nSELECT word, origin, count(*)::INT AS size, {sql.r6('sum(x)')} AS total, "
    f"{sql.r6('sum(x * (pos + 1))')} AS by_place FROM merged JOIN wv USING (word) "
    "GROUP BY ALL",
)
def f11(spark, sf):
    new = tfidf.vocabulary(documents(spark, sf)).select(
        F.col("term").alias("word"),
        hashed_vector(F.col("term"), SIZE).alias("vec"),
        F.lit("added").alias("origin"),
    )
    placed = F.transform("vec", lambda x, i: x.cast("double") * (i + 1))
    total = F.aggregate("vec", F.lit(0.0), lambda a, b: a + b.cast("double"))
    by_place = F.aggregate(placed, F.lit(0.0), lambda a, b: a + b)
    return wordvec.merge_vectors(base_vectors(spark, sf), new).select(
        "word", "origin", F.size("vec").alias("size"), r6(total).alias("total"), r6(by_place).alias("by_place")
    )


@query(
    "f12_vocabulary",
    sql.with_(sql.documents()) + "\nSELECT DISTINCT unnest(tokens) AS term FROM docs",
)
def f12(spark, sf):
    return tfidf.vocabulary(documents(spark, sf))


@query(
    "f13_word_set",
    sql.with_(sql.documents(), *sql.TFIDF[:2])
    + "\nSELECT id, idx AS term, 1.0::DOUBLE AS v FROM tf",
)
def f13(spark, sf):
    return tfidf.word_set(documents(spark, sf))


@query(
    "f14_chosen_featuriser",
    sql.with_(sql.documents(), *sql.document_vectors(SIZE))
    + f"\nSELECT id, y, pos::INTEGER AS idx, {sql.r6('x')} AS v FROM vecs",
)
def f14(spark, sf):
    run = features.featuriser(replace(TEXT, featuriser="word_vectors"), base_vectors(spark, sf))
    return run(raw_documents(spark, sf), 0).withColumn("v", r6("v"))


# --- batch shaping ----------------------------------------------------------------------


@query(
    "d1_pair_with_labels",
    sql.with_(*sql.embeddings()) + f"\nSELECT id, y, {sql.r6('sum(v)')} AS total FROM rows "
    "JOIN (SELECT id, v FROM feats) USING (id) GROUP BY ALL",
)
def d1(spark, sf):
    rows = embeddings(spark, sf)
    paired = labelled.pair_with_labels(rows.select("id", "features"), rows.select("id", "y"))
    total = F.aggregate("features", F.lit(0.0), lambda a, b: a + b)
    return paired.select("id", "y", r6(total).alias("total"))


@query(
    "d2_labelled_rows",
    sql.with_(*sql.embeddings())
    + f"\nSELECT 'labelled' AS kind, id, y, idx::INTEGER AS pos, {sql.r6('v')} AS x FROM feats "
    "JOIN (SELECT id, y FROM rows) USING (id) UNION ALL "
    f"SELECT 'bare', id, '0.0', idx::INTEGER, {sql.r6('v')} FROM feats",
)
def d2(spark, sf):
    source = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")
    parts = (
        long(labelled.labelled_rows(source, "embedding", "label"), "id", "y").select(
            F.lit("labelled").alias("kind"), "*"
        ),
        long(labelled.labelled_rows(source, "embedding"), "id", "y").select(
            F.lit("bare").alias("kind"), "*"
        ),
    )
    return parts[0].unionByName(parts[1]).withColumn("x", r6("x"))


@query(
    "d3_one_vs_rest",
    "SELECT doc_id AS id, l.label, (lang = l.label)::INT::DOUBLE AS target FROM documents, "
    "(SELECT DISTINCT lang AS label FROM documents) l",
)
def d3(spark, sf):
    rows = raw_documents(spark, sf).select("id", "y")
    labels = sorted(r["y"] for r in labelled.distinct_labels(rows).collect())
    return labelled.one_vs_rest(rows, labels).select("id", "label", "target")


@query(
    "d4_batch_size",
    sql.with_(*sql.embeddings(BATCHES))
    + "\nSELECT batch, count(DISTINCT id)::BIGINT AS rows, max(idx)::INTEGER AS max_index FROM feats GROUP BY batch",
)
def d4(spark, sf):
    rows = batched(embeddings(spark, sf))
    feats = rows.select("batch", "id", F.posexplode("features").alias("idx", "v"))
    return labelled.batch_size(feats, ["batch"])


@query(
    "d5_labels_by_batch",
    sql.with_(sql.documents(BATCHES)) + "\nSELECT DISTINCT batch, y FROM docs",
)
def d5(spark, sf):
    rows = batched(raw_documents(spark, sf).select("id", "y"))
    return labelled.distinct_labels(rows, ["batch"])


@query("d6_random_split")
def d6(spark, sf):
    parts = labelled.random_parts(raw_documents(spark, sf).select("id"))
    named = [part.withColumn("part", F.lit(name)) for part, name in zip(parts, ("train", "test"))]
    return named[0].unionByName(named[1])


@query(
    "d6_keyed_split",
    "SELECT doc_id AS id, CASE WHEN doc_id % 10 < 7 THEN 'train' ELSE 'test' END AS part FROM documents",
)
def d6_keyed(spark, sf):
    return raw_documents(spark, sf).select("id", labelled.keyed_part().alias("part"))


@query(
    "d7_recode_labels",
    "SELECT vec_id AS id, (label - 1)::VARCHAR AS less, (label + 1)::VARCHAR AS more, "
    "CASE WHEN label = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS binary_label FROM embeddings",
)
def d7(spark, sf):
    y = F.col("y")
    return embeddings(spark, sf).select(
        "id",
        labelled.shifted_label(y, -1).alias("less"),
        labelled.shifted_label(y, 1).alias("more"),
        labelled.binary_label(y).alias("binary_label"),
    )


# --- FTRL -------------------------------------------------------------------------------


def _feats(rows: DataFrame) -> DataFrame:
    return ftrl.by_text(ftrl.dense_features(rows), rows.count())


def _empty(feats: DataFrame) -> DataFrame:
    return ftrl.empty_state(feats.sparkSession, feats.schema["idx"].dataType)


def _trained(spark, sf, passes: int, cfg: FtrlConfig = CFG):
    """Features, labels and the written state after some passes over the embeddings."""
    feats = _feats(embeddings(spark, sf)).persist()
    by_label = ftrl.label_rows(feats)
    labels = ftrl.known_labels([], by_label)
    state = ftrl.train(
        feats, _empty(feats), 0, labels, cfg, passes, sum(by_label.values())
    )
    state = materialise(state, "state")
    feats.unpersist()
    return feats, labels, state


@once("trained_rows")
def trained_rows(spark, sf):
    """The labels, the written state and the losses after three passes over the embeddings, a row per vector."""
    rows = ftrl_rows.vector_rows(embeddings(spark, sf)).persist()
    found = rows.groupBy("y").agg(F.max(F.size("v")).alias("width")).collect()
    labels = ftrl.known_labels([], (r["y"] for r in found))
    keys = pa.array(range(max(r["width"] for r in found)), pa.int32())
    start = ftrl_rows.state_of(None, keys, len(labels), spark)
    state, losses = ftrl_rows.train(rows, start, labels, CFG)
    rows.unpersist()
    return labels, materialise(state.frame(spark), "state"), ftrl_rows.losses_frame(spark, labels, losses)


@once("one_pass")
def one_pass(spark, sf):
    return _trained(spark, sf, 1)


@once("three_passes")
def three_passes(spark, sf):
    return _trained(spark, sf, CFG.passes)


def _state(state: DataFrame, labels: list[str]) -> DataFrame:
    rows = ftrl.state_by_label(state, labels)
    return rows.select("label", F.col("idx").cast("long").alias("idx"), *(r6(c).alias(c) for c in "znw"))


ONE_PASS = sql.trained(sql.embeddings(), 1)
THREE_PASSES = sql.trained(sql.embeddings(), 3)


@query(
    "l1_weights",
    sql.with_(*THREE_PASSES) + f"\nSELECT label, idx, {sql.r6(sql.weight('z', 'n'), 9)} AS w FROM state",
)
def l1(spark, sf):
    _, labels, state = three_passes(spark, sf)
    rows = ftrl.state_by_label(state, labels)
    return rows.select("label", F.col("idx").cast("long").alias("idx"), r6("w", 9).alias("w"))


@query(
    "l2_gradient_loss",
    sql.with_(*ONE_PASS, *sql.margins())
    + f"\nSELECT label, count(*)::BIGINT AS rows, {sql.r6('avg(CASE WHEN y = label THEN ln(1 + exp(-m)) ELSE ln(1 + exp(-m)) + m END)')} "
    "AS loss FROM margins GROUP BY label",
)
def l2(spark, sf):
    feats, labels, state = one_pass(spark, sf)
    margin = ftrl.margins(feats, state, state.count(), labels)
    return ftrl.batch_loss(margin, labels).withColumn("loss", r6("loss"))


@query(
    "l3_row_updates",
    sql.with_(*sql.trained(sql.embeddings(), 2))
    + "\nSELECT id, q.label, q.idx, "
    + sql.r6(
        f"g - (sqrt(coalesce(n, 0) + g * g) - sqrt(coalesce(n, 0))) / {CFG.alpha}::DOUBLE "
        "* coalesce(w, 0)"
    )
    + f" AS dz, {sql.r6('g * g', 9)} AS dn FROM t2_g q LEFT JOIN t2_w p ON p.label = q.label AND p.idx = q.idx",
)
def l3(spark, sf):
    feats, labels, state = one_pass(spark, sf)
    rows = ftrl.row_updates(feats, state, state.count(), labels)
    return rows.select(
        "id", "label", F.col("idx").cast("long").alias("idx"), r6("dz").alias("dz"), r6("dn", 9).alias("dn")
    )


@query("l4_batch_sums", sql.with_(*ONE_PASS) + sql.STATE)
def l4(spark, sf):
    _, labels, state = one_pass(spark, sf)
    return _state(state, labels)


@query("l5_train_batch", sql.with_(*THREE_PASSES) + sql.STATE)
def l5(spark, sf):
    labels, state, _ = trained_rows(spark, sf)
    return _state(state, labels)


@query("l5_train_batch_joined", sql.with_(*THREE_PASSES) + sql.STATE)
def l5_joined(spark, sf):
    """The same with long features that meet the state in joins."""
    _, labels, state = three_passes(spark, sf)
    return _state(state, labels)


@query("l5_pass_losses", sql.with_(*THREE_PASSES) + sql.PASS_LOSSES)
def l5_losses(spark, sf):
    _, _, losses = trained_rows(spark, sf)
    return losses.withColumn("loss", r6("loss"))


@query("l5_train_batch_shuffled", sql.with_(*THREE_PASSES) + sql.STATE)
def l5_shuffled(spark, sf):
    """The same with a state beyond the broadcast bound and labels in several groups."""
    cfg = replace(CFG, join=JoinPolicy(broadcast_bytes=0), label_chunk=4)
    _, labels, state = _trained(spark, sf, CFG.passes, cfg)
    return _state(state, labels)


@query(
    "l6_initial_state",
    sql.with_(
        *sql.trained(
            sql.embeddings(),
            1,
            start="SELECT l.label, f.idx, sum(f.v) AS z, sum(f.v * f.v) AS n FROM feats f, l_all l GROUP BY ALL",
        )
    )
    + sql.STATE,
)
def l6(spark, sf):
    feats = _feats(embeddings(spark, sf)).persist()
    labels = ftrl.known_labels([], ftrl.label_rows(feats))
    sums = feats.groupBy("idx").agg(F.sum("v").alias("_z"), F.sum(F.col("v") * F.col("v")).alias("_n"))
    start = materialise(
        sums.select(
            "idx",
            F.array_repeat("_z", len(labels)).alias("z"),
            F.array_repeat("_n", len(labels)).alias("n"),
        ),
        "start",
    )
    state = materialise(ftrl.train(feats, start, start.count(), labels, passes=1), "state")
    feats.unpersist()
    return _state(state, labels)


def _run_embeddings(spark, parts) -> ModelStore:
    store = ModelStore(spark, scratch_path(spark, "model"))
    return prequential.run(store, parts, features.dense)


BINARY = "CASE WHEN label = 0 THEN 'yes' ELSE 'no' END"
_binary_sql, _ = sql.prequential("rows", "feats", 2, "BIGINT", before=sql.embeddings(2, y=BINARY))


@once("binary_model")
def binary_model(spark, sf):
    rows = embeddings(spark, sf).withColumn("y", F.when(F.col("y") == "0", "yes").otherwise("no"))
    return _run_embeddings(spark, prequential.split_batches(rows, 2)), rows


@query("l7_warm_start", _binary_sql + sql.STATE)
def l7(spark, sf):
    store, _ = binary_model(spark, sf)
    model = store.latest()
    return _state(model.state, model.labels)


_binary_margins = ", ".join(
    f"{name} AS MATERIALIZED ({body})" for name, body in sql.margins("state", "l1")
)


@query(
    "l7b_hard_predictions",
    _binary_sql + ",\n" + _binary_margins
    + "\nSELECT id, label, CASE WHEN m > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hard FROM margins",
)
def l7b(spark, sf):
    store, rows = binary_model(spark, sf)
    model = store.latest()
    margin = ftrl.margins(_feats(rows), model.state, model.state_rows, model.labels)
    pairs = margin.selectExpr(
        "id", f"inline(arrays_zip({_names(model.labels)}, margin)) AS (label, m)"
    )
    return pairs.selectExpr("id", "label", linear.hard_label(linear.logistic("m")) + " AS hard")


def _names(labels: list[str]) -> str:
    return "array(" + ", ".join(linear.text(label) for label in labels) + ")"


# two batches with different labels: new ones come, old ones are absent but go on learning
_BY_LABEL = "(label >= 5)::INT"
_two_sql, _ = sql.prequential(
    "rows", "feats", 2, "BIGINT", before=sql.embeddings(batch=_BY_LABEL)
)


@query("l8_l9_new_and_absent_labels", _two_sql + sql.STATE)
def l8(spark, sf):
    rows = embeddings(spark, sf).withColumn("batch", (F.col("y").cast("int") >= 5).cast("int"))
    model = _run_embeddings(spark, prequential.given_batches(rows, 2)).latest()
    return _state(model.state, model.labels)


BEST = sql.with_(*THREE_PASSES, *sql.margins())


@once("scored_embeddings")
def scored_embeddings(spark, sf) -> DataFrame:
    feats, labels, state = three_passes(spark, sf)
    margin = ftrl.margins(feats, state, state.count(), labels)
    return materialise(ftrl.best_label(margin, labels), "scored")


@query("l10_predict", BEST + f"\nSELECT id, y, pred, {sql.r6('prob')} AS prob FROM best")
def l10(spark, sf):
    return scored_embeddings(spark, sf).withColumn("prob", r6("prob"))


@query(
    "l11_probabilities",
    BEST
    + "\nSELECT id, label, "
    + sql.r6("(1 / (1 + exp(-m))) / sum(1 / (1 + exp(-m))) OVER (PARTITION BY id)")
    + " AS prob FROM margins",
)
def l11(spark, sf):
    feats, labels, state = three_passes(spark, sf)
    margin = ftrl.margins(feats, state, state.count(), labels)
    return ftrl.label_probabilities(margin, labels).withColumn("prob", r6("prob"))


@query(
    "l11_two_labels",
    _binary_sql + ",\n" + _binary_margins
    + "\nSELECT id, label, "
    + sql.r6(
        "CASE WHEN ord = 0 THEN 1 / (1 + exp(-m)) ELSE 1 - "
        "max(CASE WHEN ord = 0 THEN 1 / (1 + exp(-m)) END) OVER (PARTITION BY id) END"
    )
    + " AS prob FROM margins",
)
def l11_two(spark, sf):
    store, rows = binary_model(spark, sf)
    model = store.latest()
    margin = ftrl.margins(_feats(rows), model.state, model.state_rows, model.labels)
    return ftrl.label_probabilities(margin, model.labels).withColumn("prob", r6("prob"))


@query(
    "l12_is_empty",
    "SELECT true AS before, count(*) = 0 AS after FROM embeddings",
)
def l12(spark, sf):
    store = ModelStore(spark, scratch_path(spark, "model"))
    before = store.is_empty()
    prequential.step(store, embeddings(spark, sf), 0, features.dense)
    return spark.range(1).select(F.lit(before).alias("before"), F.lit(store.is_empty()).alias("after"))


@query("s11_s12_save_load", sql.with_(*THREE_PASSES) + sql.STATE)
def s11(spark, sf):
    trained = classifier.OnlineClassifier(spark)
    trained.train(embeddings(spark, sf))
    path = scratch_path(spark, "saved")
    trained.save_model(path)
    model = classifier.OnlineClassifier.load_model(spark, path).model()
    return _state(model.state, model.labels)


@query(
    "s12_one_submodel",
    sql.with_(*THREE_PASSES)
    + f"\nSELECT idx, {sql.r6('z')} AS z, {sql.r6('n')} AS n FROM state WHERE label = '3'",
)
def s12(spark, sf):
    store = ModelStore(spark, scratch_path(spark, "model"))
    prequential.step(store, embeddings(spark, sf), 0, features.dense)
    return store.submodel("3").select(
        F.col("idx").cast("long").alias("idx"), r6("z").alias("z"), r6("n").alias("n")
    )


# --- prequential ------------------------------------------------------------------------

_vectors_sql, _ = sql.prequential("rows", "feats", BATCHES, "BIGINT", before=sql.embeddings(BATCHES))
_text_sql, _ = sql.prequential(
    "rows", "feats", BATCHES, "VARCHAR", before=[sql.documents(BATCHES), *sql.TFIDF]
)


@once("prequential_vectors")
def prequential_vectors(spark, sf) -> ModelStore:
    return _run_embeddings(spark, prequential.split_batches(embeddings(spark, sf), BATCHES))


@once("prequential_text")
def prequential_text(spark, sf) -> ModelStore:
    store = ModelStore(spark, scratch_path(spark, "model"))
    parts = prequential.split_batches(raw_documents(spark, sf), BATCHES)
    return prequential.run(store, parts, features.featuriser(TEXT))


def _metrics(store: ModelStore) -> DataFrame:
    return store.metrics().withColumn("accuracy", r6("accuracy"))


def _topics(store: ModelStore) -> DataFrame:
    return prequential.topics(store).select(
        "batch", "topic", "rows", r6("max_prob").alias("max_prob"), r6("strength").alias("strength")
    )


def _predictions(store: ModelStore) -> DataFrame:
    return store.read("predictions").select("batch", "id", "y", "pred", r6("prob").alias("prob"))


@query("p3_prequential_metrics", _vectors_sql + sql.METRICS)
def p3_metrics(spark, sf):
    return _metrics(prequential_vectors(spark, sf))


@query("p3_prequential_predictions", _vectors_sql + sql.PREDICTIONS)
def p3_predictions(spark, sf):
    return _predictions(prequential_vectors(spark, sf))


@query("s14_topic_report", _vectors_sql + sql.TOPICS)
def s14(spark, sf):
    return _topics(prequential_vectors(spark, sf))


@query("p3_text_metrics", _text_sql + sql.METRICS)
def p3_text(spark, sf):
    return _metrics(prequential_text(spark, sf))


@query("p3_text_predictions", _text_sql + sql.PREDICTIONS)
def p3_text_predictions(spark, sf):
    return _predictions(prequential_text(spark, sf))


@query("p3_text_topics", _text_sql + sql.TOPICS)
def p3_text_topics(spark, sf):
    return _topics(prequential_text(spark, sf))


@query(
    "s13_metrics_log",
    _vectors_sql + sql.METRICS.replace("accuracy, drift", "accuracy"),
)
def s13(spark, sf):
    """Metrics appended to a log, read back."""
    path = scratch_path(spark, "metrics-log")
    found = _metrics(prequential_vectors(spark, sf)).drop("drift")
    found.write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("p3_stream_metrics", _text_sql + sql.METRICS)
def p3_stream(spark, sf):
    """Text batches arrive as files of a stream that is stopped and started in between."""
    return _metrics(_streamed(spark, sf))


@query("p3_stream_topics", _text_sql + sql.TOPICS)
def p3_stream_topics(spark, sf):
    return _topics(_streamed(spark, sf))


@once("streamed")
def _streamed(spark, sf) -> ModelStore:
    store = ModelStore(spark, scratch_path(spark, "model"))
    source, progress = scratch_path(spark, "arriving"), scratch_path(spark, "progress")
    for _, part in prequential.split_batches(raw_documents(spark, sf), BATCHES):
        part.write.mode("append").parquet(source)
        stream = line_io.stream_table(spark, source, "id BIGINT, y STRING, text STRING")
        learning.prequential_stream(
            stream, store, features.featuriser(TEXT), progress, available_now=True
        ).awaitTermination()
    return store


_lines_docs = sql.documents(BATCHES)[1].removesuffix("FROM documents)") + (
    "FROM (SELECT doc_id, lang, replace(replace(replace(text, chr(9), ' '), chr(10), ' '), chr(13), ' ') "
    "AS text FROM documents))"
)
_lines_sql, _ = sql.prequential(
    "rows", "feats", BATCHES, "VARCHAR", before=[("docs", _lines_docs), *sql.TFIDF]
)


@query("p3_line_stream_metrics", _lines_sql + sql.METRICS)
def p3_lines(spark, sf):
    """Labelled lines without ids: stopped and started between files, the last batch run again."""
    store = ModelStore(spark, scratch_path(spark, "model"))
    source, progress = scratch_path(spark, "arriving"), scratch_path(spark, "progress")
    featurise = features.featuriser(TEXT)
    for batch_id, part in prequential.split_batches(raw_documents(spark, sf), BATCHES):
        flat = part.withColumn("text", F.regexp_replace("text", "[\t\n\r]", " "))
        folder = f"{source}/part={batch_id}"
        line_io.write_labelled(flat, folder)
        stream = line_io.stream_named_lines(spark, f"{source}/*")
        learning.line_stream(stream, store, featurise, progress, available_now=True).awaitTermination()
    named = line_io.read_lines(spark, folder).select("value", F.col("_metadata.file_path").alias("file"))
    learning.line_step(store, named, batch_id, featurise)
    return _metrics(store)


@query("p3_growing_vectors")
def p3_growing(spark, sf):
    """Short texts with word vectors that grow from batch to batch."""
    store = ModelStore(spark, scratch_path(spark, "model"))
    base = materialise(f6(spark, sf), "base")
    run = learning.growing_vectors(store, base, replace(TEXT, vector_size=SIZE))
    parts = prequential.split_batches(raw_documents(spark, sf), 3)
    return _metrics(prequential.run(store, parts, run))


_side_docs = (
    "docs",
    "SELECT batch, id, l.quality::VARCHAR AS y, tokens FROM all_docs JOIN labels l ON l.doc_id = id",
)
_p4_sql, _ = sql.prequential(
    "rows",
    "feats",
    BATCHES,
    "BIGINT",
    before=[
        ("all_docs", sql.documents(BATCHES)[1]),
        _side_docs,
        *sql.document_vectors(SIZE),
        ("rows", "SELECT batch, id, y FROM docs"),
        ("feats", "SELECT batch, id, pos AS idx, x AS v FROM vecs"),
    ],
)


@once("side_labels")
def side_labels(spark, sf) -> ModelStore:
    docs = raw_documents(spark, sf).drop("y")
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("y")
    )
    parts = (
        (batch_id, labelled.attach_labels(part, labels))
        for batch_id, part in prequential.split_batches(docs, BATCHES)
    )
    run = features.featuriser(replace(TEXT, featuriser="word_vectors"), base_vectors(spark, sf))
    store = ModelStore(spark, scratch_path(spark, "model"))
    return prequential.run(store, parts, run)


@query("p4_side_labels", _p4_sql + sql.METRICS)
def p4(spark, sf):
    return _metrics(side_labels(spark, sf))


@query("p4_side_label_topics", _p4_sql + sql.TOPICS)
def p4_topics(spark, sf):
    return _topics(side_labels(spark, sf))


_p1 = sql.with_(*sql.trained([sql.documents(), *sql.TFIDF], 3, "VARCHAR"), *sql.margins())


@query("p1_batch_job", _p1 + f"\nSELECT id, y, pred, {sql.r6('prob')} AS prob FROM best")
def p1(spark, sf):
    docs = raw_documents(spark, sf)
    return classifier.train_batch(docs, TEXT).predict(docs).withColumn("prob", r6("prob"))


@query("p1_batch_job_hashed")
def p1_hashed(spark, sf):
    docs = raw_documents(spark, sf)
    return classifier.train_batch(docs, replace(TEXT, hash_buckets=1 << 20)).predict(docs)


# the IDF of the training part, applied to texts it has not seen
_saved = [
    ("every", sql.documents()[1]),
    ("docs", "SELECT * FROM every WHERE id % 10 < 7"),
    *sql.TFIDF,
]


@query(
    "f14_saved_featuriser",
    sql.with_(
        *sql.trained(_saved, 3, "VARCHAR"),
        ("others", "SELECT id, y, tokens FROM every WHERE id % 10 >= 7"),
        ("met", "SELECT id, idx, count(*)::DOUBLE AS tf FROM (SELECT id, unnest(tokens) AS idx FROM others) GROUP BY ALL"),
        ("scores", f"SELECT e.id, s.label, sum(e.tf * ln((m.m + 1)::DOUBLE / (df.df + 1)::DOUBLE) * {sql.weight('s.z', 's.n')}) AS m "
         "FROM met e JOIN df USING (idx) JOIN state s ON s.idx = e.idx, m GROUP BY e.id, s.label"),
        ("told", "SELECT o.id, o.y, l.label, l.ord, coalesce(s.m, 0.0) AS m FROM others o CROSS JOIN l_all l "
         "LEFT JOIN scores s ON s.id = o.id AND s.label = l.label"),
    )
    + f"\nSELECT id, y, label AS pred, {sql.r6('1 / (1 + exp(-m))')} AS prob FROM told "
    "QUALIFY row_number() OVER (PARTITION BY id ORDER BY m DESC, ord) = 1",
)
def f14_saved(spark, sf):
    """A model saved with its TF-IDF and loaded without naming it."""
    docs = raw_documents(spark, sf)
    path = scratch_path(spark, "saved")
    classifier.train_batch(docs.where("id % 10 < 7"), TEXT).save_model(path)
    found = classifier.OnlineClassifier.load_model(spark, path)
    return found.predict(docs.where("id % 10 >= 7")).withColumn("prob", r6("prob"))


_p2_sql, _ = sql.prequential("rows", "feats", 2, "BIGINT", before=sql.embeddings(2))
_p2_margins = ", ".join(f"{name} AS MATERIALIZED ({body})" for name, body in sql.margins("state", "l1"))


@query(
    "p2_online_classifier",
    _p2_sql + ",\n" + _p2_margins
    + "\nSELECT id, label, "
    + sql.r6("(1 / (1 + exp(-m))) / sum(1 / (1 + exp(-m))) OVER (PARTITION BY id)")
    + " AS prob FROM margins",
)
def p2(spark, sf):
    online = classifier.OnlineClassifier(spark)
    rows = embeddings(spark, sf)
    for _, part in prequential.split_batches(rows, 2):
        online.test_then_train(part)
    return online.predict_probability(rows).withColumn("prob", r6("prob"))


# --- offline learners -------------------------------------------------------------------

_nb = [
    sql.documents(),
    ("parts", "SELECT id, y, CASE WHEN id % 10 < 7 THEN 'train' ELSE 'test' END AS part FROM docs"),
    ("words", "SELECT DISTINCT id, unnest(tokens) AS term FROM docs"),
    ("vocab", "SELECT DISTINCT term FROM words"),
    ("classes", "SELECT y, count(*) AS n FROM parts WHERE part = 'train' GROUP BY y"),
    (
        "cells",
        "SELECT c.y, v.term, count(p.id) AS n FROM classes c CROSS JOIN vocab v LEFT JOIN "
        "(SELECT w.id, w.term, p.y FROM words w JOIN parts p USING (id) WHERE part = 'train') p "
        "ON p.y = c.y AND p.term = v.term GROUP BY ALL",
    ),
    (
        "theta",
        "SELECT y AS label, term, ln((n + 1.0::DOUBLE) / (sum(n) OVER (PARTITION BY y) + "
        "(SELECT count(*) FROM vocab))) AS theta FROM cells",
    ),
    (
        "pi",
        "SELECT y AS label, ln((n + 1.0::DOUBLE) / (sum(n) OVER () + count(*) OVER ())) AS pi FROM classes",
    ),
]


def _parted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("part", labelled.keyed_part())


@query(
    "l13_naive_bayes_model",
    sql.with_(*_nb)
    + f"\nSELECT label, term, {sql.r6('theta')} AS theta FROM theta UNION ALL "
    f"SELECT label, NULL, {sql.r6('pi')} FROM pi",
)
def l13_model(spark, sf):
    docs = _parted(documents(spark, sf))
    model = naive_bayes.fit(tfidf.word_set(docs, ["y", "part"]), docs.select("id", "y", "part"))
    priors = ", ".join(
        f"named_struct('label', {linear.text(label)}, 'theta', {linear.number(p)})"
        for label, p in zip(model.labels, model.prior)
    )
    prior = spark.range(1).selectExpr(f"inline(array({priors}))")
    prior = prior.withColumn("term", F.lit(None).cast("string"))
    every = naive_bayes.theta_by_label(model).unionByName(prior)
    return every.select("label", "term", r6("theta").alias("theta"))


@query(
    "l13_naive_bayes_predictions",
    sql.with_(
        *_nb,
        (
            "joint",
            "SELECT w.id, t.label, sum(t.theta) AS s FROM parts p JOIN words w USING (id) "
            "JOIN theta t USING (term) WHERE part = 'test' GROUP BY ALL",
        ),
    )
    + "\nSELECT p.id, p.y, pi.label AS pred FROM parts p CROSS JOIN pi "
    "LEFT JOIN joint j ON j.id = p.id AND j.label = pi.label WHERE part = 'test' "
    "QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY coalesce(s, 0) + pi DESC, pi.label) = 1",
)
def l13(spark, sf):
    return compare.naive_bayes_predictions(_parted(documents(spark, sf)))


_l14 = sql.with_(
    sql.DENSE_X,
    ("all_rows", "SELECT vec_id AS id, 0 AS m, CASE WHEN label = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS t, "
     "vec_id % 10 < 7 AS train FROM embeddings"),
    ("targets", "SELECT id, m, t FROM all_rows WHERE train"),
    *sql.sgd(10, 0.1),
)


@query(
    "l14_logistic_sgd",
    _l14
    + f"\nSELECT a.id, a.t AS target, {sql.r6('1 / (1 + exp(-sum(x.x * w.w)))')} AS prob FROM all_rows a "
    "JOIN x USING (id) JOIN w10 w ON w.pos = x.pos WHERE NOT a.train GROUP BY a.id, a.t",
)
def l14(spark, sf):
    found = compare.logistic_probabilities(_parted(embeddings(spark, sf)))
    return found.withColumn("prob", r6("prob"))


@query(
    "l15_cascade_levels",
    "SELECT (l.label + 1)::INTEGER AS level, l.label::VARCHAR AS label, count(*)::BIGINT AS rows "
    "FROM embeddings e, (SELECT DISTINCT label FROM embeddings) l WHERE e.label >= l.label "
    "AND l.label < (SELECT max(label) FROM embeddings) GROUP BY ALL",
)
def l15_levels(spark, sf):
    rows = embeddings(spark, sf)
    labels = sorted(r["y"] for r in labelled.distinct_labels(rows).collect())
    return multiclass.level_sizes(rows, labels)


_L15_ITERATIONS = 100
_l15 = sql.with_(
    sql.DENSE_X,
    (
        "targets",
        "SELECT vec_id AS id, l.label AS m, (e.label = l.label)::INT::DOUBLE AS t FROM embeddings e, "
        "(SELECT DISTINCT label FROM embeddings) l WHERE e.label >= l.label "
        "AND l.label < (SELECT max(label) FROM embeddings) AND vec_id % 10 < 7",
    ),
    *sql.sgd(_L15_ITERATIONS, 1.0, loss="hinge"),
    (
        "answers",
        f"SELECT x.id, w.m, sum(x.x * w.w) AS mg FROM x JOIN w{_L15_ITERATIONS} w ON w.pos = x.pos "
        "WHERE x.id % 10 >= 7 GROUP BY ALL",
    ),
)


@query(
    "l15_svm_cascade",
    _l15
    + "\nSELECT vec_id AS id, label::VARCHAR AS y, coalesce((SELECT min(m) FROM answers a "
    "WHERE a.id = vec_id AND mg > 0), (SELECT max(label) FROM embeddings))::VARCHAR AS pred "
    "FROM embeddings WHERE vec_id % 10 >= 7",
)
def l15(spark, sf):
    rows = _parted(embeddings(spark, sf))
    train = rows.where(F.col("part") == "train")
    labels = sorted(r["y"] for r in labelled.distinct_labels(train).collect())
    model = multiclass.fit_cascade(train, labels)
    return multiclass.predict_cascade(model, rows.where(F.col("part") == "test"))


_l16 = [
    sql.DENSE_X,
    ("pairs", "SELECT a.label * 100 + b.label AS m, a.label AS a, b.label AS b FROM "
     "(SELECT DISTINCT label FROM embeddings) a JOIN (SELECT DISTINCT label FROM embeddings) b ON a.label < b.label"),
    ("targets", "SELECT vec_id AS id, m, (label = a)::INT::DOUBLE AS t FROM embeddings JOIN pairs ON label IN (a, b)"),
    *sql.sgd(10, 0.1),
    ("votes", "SELECT id, CASE WHEN mg > 0 THEN a ELSE b END AS vote FROM (SELECT x.id, w.m, sum(x.x * w.w) AS mg "
     "FROM x JOIN w10 w ON w.pos = x.pos GROUP BY ALL) JOIN pairs USING (m)"),
    ("voted", "SELECT id, vote AS pred FROM (SELECT id, vote, count(*) AS n FROM votes GROUP BY ALL) "
     "QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, vote) = 1"),
]


@once("pair_models")
def pair_models(spark, sf):
    rows = embeddings(spark, sf)
    labels = sorted(r["y"] for r in labelled.distinct_labels(rows).collect())
    return multiclass.fit_pairs(rows, labels), rows


@query(
    "l16_pair_votes",
    sql.with_(*_l16) + "\nSELECT id, vote::VARCHAR AS vote, count(*)::BIGINT AS votes FROM votes GROUP BY ALL",
)
def l16(spark, sf):
    model, rows = pair_models(spark, sf)
    votes = multiclass.pair_votes(model, rows)
    return votes.groupBy("id", "vote").agg(F.count("*").alias("votes"))


@query(
    "e8_majority_vote",
    sql.with_(*_l16)
    + "\nSELECT id, label::VARCHAR AS y, pred::VARCHAR AS pred FROM voted JOIN embeddings ON vec_id = id",
)
def e8(spark, sf):
    return multiclass.predict_pairs(*pair_models(spark, sf))


@query(
    "e9_vote_accuracy",
    sql.with_(*_l16)
    + "\nSELECT count(*)::BIGINT AS rows, sum((label = pred)::INT)::BIGINT AS correct, "
    + sql.r6("sum((label = pred)::INT)::DOUBLE / count(*)")
    + " AS accuracy FROM voted JOIN embeddings ON vec_id = id",
)
def e9(spark, sf):
    scored = multiclass.predict_pairs(*pair_models(spark, sf))
    return metrics.accuracy(scored).withColumn("accuracy", r6("accuracy"))


STREAM_SGD = SgdConfig(step=1.0, iterations=4)
_l17 = [
    sql.DENSE_X,
    ("batches", f"SELECT vec_id AS id, {sql.batch_of('vec_id', 'embeddings', 3)} AS batch, "
     "CASE WHEN label = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS t FROM embeddings"),
]
for _b in range(3):
    _l17.append((f"targets{_b}", f"SELECT id, 0 AS m, t FROM batches WHERE batch = {_b}"))
    _start = (
        "SELECT DISTINCT 0 AS m, pos, 0.0::DOUBLE AS w, false AS done FROM x"
        if _b == 0
        else f"SELECT m, pos, w, false AS done FROM v{_b - 1}_4"
    )
    _l17 += sql.sgd(4, 1.0, rows=f"targets{_b}", start=_start, name=f"v{_b}_")


@once("streaming_logistic")
def streaming_logistic(spark, sf):
    """Three files arrive one after the other; the model goes on from each to the next."""
    rows = embeddings(spark, sf).withColumn("y", labelled.binary_label(F.col("y")))
    width = sgd.width_of(rows)
    model = learning.StreamingLogistic(spark, scratch_path(spark, "model"), STREAM_SGD)
    model.set_initial_weights([0.0] * width)
    source, progress = scratch_path(spark, "arriving"), scratch_path(spark, "progress")
    for _, part in prequential.split_batches(rows, 3):
        part.write.mode("append").parquet(source)
        stream = line_io.stream_table(spark, source, "id BIGINT, y DOUBLE, features ARRAY<DOUBLE>")
        model.train_on(stream, progress, available_now=True).awaitTermination()
    return model


@query(
    "l17_l21_streaming_sgd",
    sql.with_(*_l17) + f"\nSELECT pos::INTEGER AS pos, {sql.r6('w')} AS w FROM v2_4",
)
def l17(spark, sf):
    model = streaming_logistic(spark, sf)
    weights = ", ".join(linear.number(w) for w in model.latest_model())
    latest = spark.range(1).selectExpr(f"posexplode(array({weights})) AS (pos, w)")
    return latest.withColumn("w", r6("w"))


_L18 = sql.with_(*_l17) + (
    f"\nSELECT x.id, {sql.r6('1 / (1 + exp(-sum(x.x * w.w)))')} AS prob FROM x JOIN v2_4 w "
    "ON w.pos = x.pos GROUP BY x.id"
)


@query("l18_predict_on_stream", _L18)
def l18(spark, sf):
    model = streaming_logistic(spark, sf)
    source, sink = scratch_path(spark, "arriving"), scratch_path(spark, "scored")
    embeddings(spark, sf).write.parquet(source)
    stream = line_io.stream_table(spark, source, "id BIGINT, y STRING, features ARRAY<DOUBLE>")
    scored = model.predict_on(stream).select("id", "prob")
    (
        scored.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", scratch_path(spark, "progress"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(sink).withColumn("prob", r6("prob"))


@query(
    "l18_live_model",
    sql.with_(*_l17)
    + "\n"
    + " UNION ALL ".join(
        f"SELECT {b} AS batch, x.id, {sql.r6('1 / (1 + exp(-sum(x.x * w.w)))')} AS prob FROM x "
        f"JOIN targets{b} t ON t.id = x.id JOIN v{b}_4 w ON w.pos = x.pos GROUP BY x.id"
        for b in range(3)
    ),
)
def l18_live(spark, sf):
    """Train and predict streams take turns; each file is scored with the weights it has just changed."""
    rows = embeddings(spark, sf).withColumn("y", labelled.binary_label(F.col("y")))
    model = learning.StreamingLogistic(spark, scratch_path(spark, "model"), STREAM_SGD)
    model.set_initial_weights([0.0] * sgd.width_of(rows))
    source, sink = scratch_path(spark, "arriving"), scratch_path(spark, "scored")
    learnt, told = scratch_path(spark, "progress"), scratch_path(spark, "progress")
    for _, part in prequential.split_batches(rows, 3):
        part.write.mode("append").parquet(source)
        stream = line_io.stream_table(spark, source, "id BIGINT, y DOUBLE, features ARRAY<DOUBLE>")
        model.train_on(stream, learnt, available_now=True).awaitTermination()
        model.predict_stream(stream, told, sink, available_now=True).awaitTermination()
    return spark.read.parquet(sink).select("batch", "id", r6("prob").alias("prob"))


@query(
    "l19_predict_one",
    sql.with_(*_l17)
    + f"\nSELECT {sql.r6('1 / (1 + exp(-sum(c.x * w.w)))')} AS prob FROM "
    "(SELECT pos, avg(x) AS x FROM x GROUP BY pos) c JOIN v2_4 w ON w.pos = c.pos",
)
def l19(spark, sf):
    """One vector, the mean of all, as a one-row table."""
    model = streaming_logistic(spark, sf)
    every = embeddings(spark, sf).withColumn("y", F.lit("all"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "v")))
    one = labelled.centroids(every).agg(F.transform(ordered, lambda p: p["v"]).alias("features"))
    return model.predict_on(one).select(r6("prob").alias("prob"))


@query(
    "l20_predict_with_key",
    sql.with_(*_l17)
    + f"\nSELECT 'vec-' || x.id AS key, {sql.r6('1 / (1 + exp(-sum(x.x * w.w)))')} AS prob FROM x "
    "JOIN v2_4 w ON w.pos = x.pos GROUP BY x.id",
)
def l20(spark, sf):
    model = streaming_logistic(spark, sf)
    keyed = embeddings(spark, sf).select(F.concat(F.lit("vec-"), "id").alias("key"), "features")
    return model.predict_on(keyed).select("key", r6("prob").alias("prob"))


@query(
    "l22_sampled_steps",
    sql.with_(
        sql.DENSE_X,
        ("targets", "SELECT vec_id AS id, 0 AS m, CASE WHEN label = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS t FROM embeddings"),
        *sql.sgd(5, 0.5, reg=0.1, fraction=0.5),
    )
    + f"\nSELECT x.id, {sql.r6('1 / (1 + exp(-sum(x.x * w.w)))')} AS prob FROM x JOIN w5 w ON w.pos = x.pos GROUP BY x.id",
)
def l22(spark, sf):
    """All settings set, steps on a sample of the rows."""
    rows = embeddings(spark, sf).select(
        "id", sgd.binary_targets(labelled.binary_label(F.col("y"))).alias("targets"), "features"
    ).persist()
    cfg = SgdConfig(step=0.5, iterations=5, reg=0.1, batch_fraction=0.5)
    w = sgd.train(rows, np.zeros((1, sgd.width_of(rows))), cfg)[0]
    rows.unpersist()
    return rows.select("id", r6(sgd.probability("features", w)).alias("prob"))


def _learned(name: str, rows: DataFrame) -> DataFrame:
    """Predictions of the test part by a learner that was trained on the other, saved and loaded."""
    parted = _parted(rows)
    found = learners.trained_and_reloaded(name, parted.where("part = 'train'").drop("part"))
    return found.predict(parted.where("part = 'test'"))


_train_part = [(n, b + " WHERE vec_id % 10 < 7" if n == "vectors" else b) for n, b in sql.embeddings()]


@query(
    "l23_ftrl",
    sql.with_(
        *sql.trained(_train_part, 3),
        ("test", "SELECT vec_id AS id, label::VARCHAR AS y, unnest(range(len(embedding))) AS idx, "
         "unnest(embedding)::DOUBLE AS v FROM embeddings WHERE vec_id % 10 >= 7"),
        ("told", f"SELECT t.id, t.y, s.label, any_value(l.ord) AS ord, sum(t.v * {sql.weight('s.z', 's.n')}) AS m FROM test t "
         "JOIN state s ON s.idx = t.idx JOIN l_all l ON l.label = s.label GROUP BY t.id, t.y, s.label"),
    )
    + "\nSELECT id, y, label AS pred FROM told QUALIFY row_number() OVER (PARTITION BY id ORDER BY m DESC, ord) = 1",
)
def l23_ftrl(spark, sf):
    return _learned("ftrl", embeddings(spark, sf))


@query(
    "l23_sgd",
    sql.with_(
        sql.DENSE_X,
        ("targets", "SELECT vec_id AS id, l.label AS m, (e.label = l.label)::INT::DOUBLE AS t FROM embeddings e, "
         "(SELECT DISTINCT label FROM embeddings) l WHERE vec_id % 10 < 7"),
        *sql.sgd(10, 0.1),
        ("told", "SELECT x.id, w.m, sum(x.x * w.w) AS mg FROM x JOIN w10 w ON w.pos = x.pos WHERE x.id % 10 >= 7 GROUP BY ALL"),
    )
    + "\nSELECT id, label::VARCHAR AS y, m::VARCHAR AS pred FROM told JOIN embeddings ON vec_id = id "
    "QUALIFY row_number() OVER (PARTITION BY id ORDER BY mg DESC, m) = 1",
)
def l23_sgd(spark, sf):
    return _learned("sgd", embeddings(spark, sf))


_nb_train = [
    ("vocab", "SELECT DISTINCT term FROM words JOIN parts USING (id) WHERE part = 'train'") if n == "vocab" else (n, b) for n, b in _nb
]


@query(
    "l23_naive_bayes",
    sql.with_(
        *_nb_train,
        (
            "joint",
            "SELECT w.id, t.label, sum(t.theta) AS s FROM parts p JOIN words w USING (id) "
            "JOIN theta t USING (term) WHERE part = 'test' GROUP BY ALL",
        ),
    )
    + "\nSELECT p.id, p.y, pi.label AS pred FROM parts p CROSS JOIN pi "
    "LEFT JOIN joint j ON j.id = p.id AND j.label = pi.label WHERE part = 'test' "
    "QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY coalesce(s, 0) + pi DESC, pi.label) = 1",
)
def l23_naive_bayes(spark, sf):
    return _learned("naive_bayes", documents(spark, sf))


@query("l23_cascade", SQL["l15_svm_cascade"])
def l23_cascade(spark, sf):
    return _learned("cascade", embeddings(spark, sf))


_l23_pairs = [(n, b + " WHERE vec_id % 10 < 7" if n == "targets" else b) for n, b in _l16]


@query(
    "l23_pair_votes",
    sql.with_(*_l23_pairs)
    + "\nSELECT id, label::VARCHAR AS y, pred::VARCHAR AS pred FROM voted JOIN embeddings ON vec_id = id WHERE id % 10 >= 7",
)
def l23_pair_votes(spark, sf):
    return _learned("pair_votes", embeddings(spark, sf))


# --- evaluation -------------------------------------------------------------------------

_per_label = (
    "SELECT y AS label, count(*) AS t, 0 AS p, 0 AS h FROM best GROUP BY y UNION ALL "
    "SELECT pred, 0, count(*), sum((y = pred)::INT) FROM best GROUP BY pred"
)


@query(
    "e1_weighted_scores",
    BEST
    + f"""
, labels_ AS (SELECT label, sum(t)::DOUBLE AS t, sum(p)::DOUBLE AS p, sum(h)::DOUBLE AS h FROM ({_per_label}) GROUP BY label),
scores AS (SELECT t, h, CASE WHEN p > 0 THEN h / p ELSE 0 END AS pr, CASE WHEN t > 0 THEN h / t ELSE 0 END AS re FROM labels_)
SELECT sum(t)::BIGINT AS rows, {sql.r6('sum(h) / sum(t)')} AS accuracy, {sql.r6('sum(pr * t) / sum(t)')} AS weighted_precision,
{sql.r6('sum(re * t) / sum(t)')} AS weighted_recall,
{sql.r6('sum(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END * t) / sum(t)')} AS weighted_f1 FROM scores""",
)
def e1(spark, sf):
    scores = metrics.weighted_scores(scored_embeddings(spark, sf))
    return scores.select("rows", *(r6(c).alias(c) for c in scores.columns if c != "rows"))


@query(
    "e2_label_counts",
    BEST
    + "\nSELECT 'truth' AS kind, y AS label, count(*)::BIGINT AS rows FROM best GROUP BY y UNION ALL "
    "SELECT 'prediction', pred, count(*)::BIGINT FROM best GROUP BY pred",
)
def e2(spark, sf):
    return metrics.label_counts(scored_embeddings(spark, sf))


@query(
    "e3_batch_accuracy",
    _text_sql
    + "\nSELECT batch::INTEGER AS batch, rows, correct, " + sql.r6("accuracy") + " AS accuracy FROM accuracies",
)
def e3(spark, sf):
    scored = prequential_text(spark, sf).read("predictions")
    return metrics.accuracy(scored, ["batch"]).withColumn("accuracy", r6("accuracy"))


@query(
    "e4_e5_e6_topics",
    BEST
    + "\nSELECT pred AS topic, count(*)::BIGINT AS rows, " + sql.r6("max(prob)") + " AS max_prob, "
    + sql.r6("max(prob) * (count(*)::DOUBLE / sum(count(*)) OVER ())") + " AS strength FROM best GROUP BY pred",
)
def e456(spark, sf):
    one = scored_embeddings(spark, sf).withColumn("batch", F.lit(0))
    return metrics.topics(one).select(
        "topic", "rows", r6("max_prob").alias("max_prob"), r6("strength").alias("strength")
    )


@query(
    "e7_drift",
    "WITH b AS (SELECT (((vec_id - (SELECT min(vec_id) FROM embeddings)) * 50) // ((SELECT max(vec_id) "
    "FROM embeddings) - (SELECT min(vec_id) FROM embeddings) + 1))::INTEGER AS batch, "
    "sum((label < 5)::INT)::DOUBLE / count(*) AS accuracy FROM embeddings GROUP BY 1) "
    f"SELECT batch, {sql.r6('accuracy')} AS accuracy, "
    "coalesce(lag(accuracy) OVER (ORDER BY batch) - accuracy > 0.2::DOUBLE, false) AS drift FROM b",
)
def e7(spark, sf):
    """Drift over many small batches, of a score that varies from batch to batch."""
    rows = batched(embeddings(spark, sf), 50).withColumn(
        "pred", F.when(F.col("y").cast("int") < 5, F.col("y"))
    )
    found = metrics.accuracy(rows, ["batch"]).select("batch", "accuracy")
    return metrics.drift(found).withColumn("accuracy", r6("accuracy"))


@query("p5_compare_classifiers")
def p5(spark, sf):
    docs = _parted(documents(spark, sf))
    means = wordvec.document_vectors(docs, base_vectors(spark, sf), SIZE, ["y", "part"])
    return compare.compare_classifiers(docs, materialise(means, "vectors"))


# --- centroids and mutual information ---------------------------------------------------


@query(
    "x1_centroids",
    sql.with_(*sql.embeddings())
    + f"\nSELECT y AS label, idx::INTEGER AS pos, {sql.r6('avg(v)')} AS v FROM feats JOIN (SELECT id, y FROM rows) USING (id) GROUP BY ALL",
)
def x1(spark, sf):
    return labelled.centroids(embeddings(spark, sf)).withColumn("v", r6("v"))


_mi = [
    sql.documents(),
    ("tokens", "SELECT id, y, unnest(tokens) AS word FROM docs"),
    ("c", "SELECT y, count(*)::DOUBLE / sum(count(*)) OVER () AS pc FROM docs GROUP BY y"),
    ("w", "SELECT word, count(*)::DOUBLE / sum(count(*)) OVER () AS pw FROM tokens GROUP BY word"),
    ("wc", "SELECT y, word, count(DISTINCT id)::DOUBLE / (SELECT count(*) FROM docs) AS pwc FROM tokens GROUP BY ALL"),
    ("mi", "SELECT y, word, pc * log2(pwc / (pw * pc)) AS mi FROM wc JOIN w USING (word) JOIN c USING (y)"),
]


@query("x2_mutual_information", sql.with_(*_mi) + f"\nSELECT y, word, {sql.r6('mi')} AS mi FROM mi")
def x2(spark, sf):
    return mutual_info.word_weights(documents(spark, sf)).withColumn("mi", r6("mi"))


@query(
    "x2_weighted_vectors",
    sql.with_(
        *_mi,
        sql.BASE_WORDS,
        ("wv", sql.hashed_vectors("base", SIZE)),
        ("tm", "SELECT id, word, count(*) * any_value(mi) AS m FROM tokens JOIN mi USING (y, word) GROUP BY ALL"),
        ("tt", "SELECT id, sum(m) AS total FROM tm GROUP BY id"),
        ("ts", "SELECT id, pos, sum(m * x) AS s FROM tm JOIN wv USING (word) GROUP BY ALL"),
    )
    + "\nSELECT d.id, d.y, p.pos::INTEGER AS pos, "
    + sql.r6("coalesce(s / nullif(total, 0) / nullif(len(d.tokens), 0), 0.0::DOUBLE)")
    + f" AS x FROM docs d CROSS JOIN (SELECT unnest(range({SIZE})) AS pos) p LEFT JOIN tt ON tt.id = d.id "
    "LEFT JOIN ts ON ts.id = d.id AND ts.pos = p.pos",
)
def x2_vectors(spark, sf):
    docs = documents(spark, sf)
    vecs = mutual_info.weighted_vectors(
        docs, base_vectors(spark, sf), mutual_info.word_weights(docs), SIZE
    )
    return long(vecs, "id", "y").withColumn("x", r6("x"))
