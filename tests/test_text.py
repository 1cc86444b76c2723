import pytest
from pyspark.sql import functions as F

from textrill.config import JoinPolicy, TextConfig
from textrill.functions import text as tx
from textrill.operators import cleaning, tfidf
from textrill.operators.joins import fits_broadcast, measure
from textrill.session import scratch_path

from .brute import murmur3

SPLITS = {
    "a b  ": ["a", "b"],
    "": [""],
    " ": [],
    "   ": [],
    " a": ["", "a"],
    "a  b": ["a", "", "b"],
    "a": ["a"],
    "a !!": ["a", "!!"],
}


def apply(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")
    rows = df.select("id", column(F.col("text")).alias("out")).orderBy("id").collect()
    return [row["out"] for row in rows]


@pytest.mark.parametrize("separator", [" ", "[ ]", "[ ]{1}", "( )"])
def test_split_drops_only_trailing_empties(spark, separator):
    got = apply(spark, SPLITS, lambda c: tx.java_split(c, separator))
    assert got == list(SPLITS.values())


def test_split_with_other_separators(spark):
    texts = ["a\tb\t\t", "\t", "\ta", "a\nb c\n ", "a1b22c"]
    assert apply(spark, texts[:3], lambda c: tx.java_split(c, "\t")) == [["a", "b"], [], ["", "a"]]
    assert apply(spark, texts[3:4], lambda c: tx.java_split(c, "[ \n]")) == [["a", "b", "c"]]
    assert apply(spark, texts[4:], lambda c: tx.java_split(c, "[0-9]+")) == [["a", "b", "c"]]


@pytest.mark.parametrize("separator", [" ", "[ ]{1}"])
def test_clear_joins_by_one_space(spark, separator):
    got = apply(spark, SPLITS, lambda c: tx.clear(c, separator))
    assert got == [" ".join(tokens) for tokens in SPLITS.values()]
    assert apply(spark, ["a,b ,c,,"], lambda c: tx.clear(c, ",")) == ["a b  c"]


@pytest.mark.parametrize("separator", [" ", "[ ]{1}"])
def test_bar_stays_and_accents_go(spark, separator):
    texts = ["a|b é!", "Ünder score_9", "日本 x"]
    got = apply(spark, texts, lambda c: tx.keep_plain_characters(c, separator))
    assert got == ["a|b ", "nder score9", " x"]


def test_stop_words(spark):
    texts = ["the cat  the", "The dog ", "the"]
    assert apply(spark, texts, lambda c: tx.drop_words(c, ["the"])) == ["cat ", "The dog", ""]
    assert apply(spark, ["a  "], lambda c: tx.drop_words(c, [])) == ["a  "]


def test_long_stop_list_gives_the_same(spark):
    texts = ["the cat  the", "The dog ", "the", "", " ", "x the y"]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")
    words = spark.createDataFrame([("the",), ("y",), ("the",)], "word STRING")
    joined = JoinPolicy(broadcast_bytes=0)
    assert sorted(cleaning.remove_stop_words(df, words).collect()) == sorted(cleaning.remove_stop_words(df, words, policy=joined).collect())
    odd = spark.createDataFrame([(1, None), (2, "the x"), (2, "z the"), (2, "z the"), (None, "y a")], df.schema)
    key = lambda r: (r["id"] or 0, r["text"] or "")
    one, other = (cleaning.remove_stop_words(odd, words, policy=p).collect() for p in (JoinPolicy(), joined))
    assert sorted(one, key=key) == sorted(other, key=key)
    nothing = words.where("false")
    assert sorted(cleaning.remove_stop_words(df, nothing).collect()) == sorted(df.collect())


def test_stop_words_on_a_stream_in_several_sets(spark):
    source, out, progress = (scratch_path(spark, n) for n in ("texts", "kept", "progress"))
    rows = [(1, "the cat  the x"), (2, "y x  "), (3, None), (3, "x"), (4, "a  b ")]
    spark.createDataFrame(rows, "id INT, text STRING").write.parquet(source)
    words = spark.createDataFrame([("the",), ("x",), ("b",)], "word STRING")
    stream = spark.readStream.schema("id INT, text STRING").parquet(source)
    kept = cleaning.remove_stop_words(stream, words, policy=JoinPolicy(broadcast_bytes=120))
    kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["id"], r["text"] or "") for r in spark.read.parquet(out).collect())
    assert got == [(1, "cat "), (2, "y"), (3, ""), (3, ""), (4, "a ")]


def test_several_sets_on_a_stream_are_one_step(spark):
    source = scratch_path(spark, "texts")
    spark.createDataFrame([(1, "the cat")], "id INT, text STRING").write.parquet(source)
    words = spark.createDataFrame([(f"w{i}",) for i in range(50)], "word STRING")
    stream = spark.readStream.schema("id INT, text STRING").parquet(source)
    kept = cleaning.remove_stop_words(stream, words, policy=JoinPolicy(broadcast_bytes=1000))
    assert kept._jdf.queryExecution().logical().toString().count("MapInArrow") == 1


def test_long_tokens_are_measured_not_guessed(spark):
    words = spark.createDataFrame([(f"{i}" * 2000,) for i in range(10, 60)], "word STRING")
    rows, width = measure(words, "word", 64)
    assert rows == 50 and width >= 4064 and not fits_broadcast(rows, width, JoinPolicy(broadcast_bytes=50 * 2000))
    docs = spark.createDataFrame([(i, [f"{i}" * 2000, "b"]) for i in range(10, 60)], "id INT, tokens ARRAY<STRING>")
    small, large = (tfidf.tfidf(docs, policy=JoinPolicy(broadcast_bytes=b)) for b in (50 * 2000, 1 << 30))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan(small) and "SortMergeJoin" not in plan(large)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def test_cleaners_are_chained_by_name(spark):
    cfg = TextConfig(separator="[ \n]", cleaners=("clear", "characters", "stop_words"), stop_words=("of",))
    df = spark.createDataFrame([(1, "out\nof it! ")], "id INT, text STRING")
    assert df.transform(cleaning.cleaner(cfg)).first()["text"] == "out it"
    with pytest.raises(ValueError):
        cleaning.cleaner(TextConfig(cleaners=("nothing",)))


def test_bucket_is_the_jvm_one(spark):
    terms = ["", "a", "the", "naïve", "日本語", "word", "longer-term-9"]
    got = apply(spark, terms, tx.hash_bucket)
    assert got == [murmur3(term.encode()) % (1 << 20) for term in terms]
