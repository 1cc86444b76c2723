"""Mixing sources to target weights by systematic sampling (operator 6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textrill.llm.common import WORD, fresh, numbered, table
from textrill.session import materialise

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
STARTS = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size)`` to ``(source, source_size, target, offset)``.

    The sources by code point, null last, weigh ``weights`` in turn and share the sum of all
    sizes; a target stops at ``most`` times its source's size, and the excess is shared again by weight
    until none is above. Each round is one sum over the sources that are full at the level of the round before, so that any
    number of sources is spread over the tasks; the level rises, and only two numbers a round reach the driver.
    ``offset`` is the source's random start in [0, 1), from a digest of the seed and its name.
    """
    place = (F.col("_place") % len(weights) + 1).cast("int")
    placed = numbered(sizes, [], [F.col("source").asc_nulls_last()], "_place").select(
        "source", "source_size", F.element_at(F.array(*map(F.lit, weights)), place).cast("long").alias("_w"),
        (F.col("source_size") * most).alias("_cap"),
    )
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    level, full_before = 0.0, None
    while True:
        full = F.lit(False) if full_before is None else F.col("_cap") / F.col("_w") <= level
        held = placed.agg(F.count_if(full), F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_w")))).first()
        if held[0] == full_before or not held[2]:
            break
        full_before, level = held[0], (total - (held[1] or 0)) / held[2]
    digest = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce("source", F.lit(""))))
    return placed.select(
        "source", "source_size", F.least(F.col("_cap").cast("double"), F.col("_w") * F.lit(level)).alias("target"),
        (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)).alias("offset"),
    )


def copies_taken(sized: DataFrame, group: str, order: list[str], size: str, into: str, most: int = MOST) -> DataFrame:
    """Add ``source_size``, ``target`` and ``into`` (copies to emit) to sized rows.

    Within its source each document expects target / source_size copies. In the order of size, then of ``order``,
    the expected copies are summed up, the source's offset is added, and a document is
    emitted once per whole number that its stretch of the sum crosses. So every document
    gets the expected copies rounded down or up, and as neighbours are alike in size, the words taken come
    within about one of the longest documents of the target. Where a few long documents hold much of
    a source, that is still much: so the offset is drawn as ``STARTS`` equally spaced ones from a random first, and the one
    whose words come nearest to the target is used (the first of equals). Rows equal in size and ``order`` should be equal
    altogether, so that it doesn't matter which of them is taken.
    """
    placed = numbered(sized, [group], [F.col(c) for c in (size, *order)], "_i")
    sums = placed.groupBy(F.col(group).alias("source")).agg(F.sum(size).alias("source_size"))
    plan = materialise(targets(sums), "targets").withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))

    def copies(start: Column) -> Column:
        stretch = lambda i: F.floor(i * rate + start)
        return F.least(stretch(F.col("_i") + 1) - stretch(F.col("_i")), F.lit(most))

    rows = placed.join(plan, placed[group].eqNullSafe(F.col("_source")), "left")
    words = F.array(*(F.sum(copies(F.col("offset") + k / STARTS) * F.col(size)) for k in range(STARTS)))
    tried = rows.groupBy("_source").agg(words.alias("_words"), F.first("target").alias("_target"))
    off = F.transform("_words", lambda w, k: F.struct(F.abs(w - F.col("_target")).alias("off"), k.alias("k")))
    chosen = tried.select(F.col("_source").alias("_chosen"), F.array_min(off)["k"].alias("_k"))
    return rows.join(chosen, F.col("_source").eqNullSafe(F.col("_chosen")), "left").select(
        *(placed[c] for c in sized.columns), "source_size", "target",
        copies(F.col("offset") + F.col("_k") / STARTS).cast("long").alias(into),
    )


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken.

    Null text counts no words; null is a source of its own, the last; a source without words has
    target 0 and gives none; repeated rows are documents of their own; an empty table stays empty. Documents of one size and
    id are taken in the order of their text's digest and then of their other columns as JSON, so that the order of the rows doesn't matter.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(
        F.col("doc_id"), F.col("source").alias("_group"), word_count(F.col("text")).alias("_size"),
        F.md5(F.coalesce("text", F.lit(""))).alias("_digest"),
        F.to_json(F.struct(*(F.col(c).alias(n) for c, n in names.items() if c != "text"))).alias("_others"),
        F.struct(*(F.col(c).alias(n) for c, n in names.items())).alias("_row"),
    )
    taken = copies_taken(rows, "_group", ["doc_id", "_digest", "_others"], "_size", "_copies")
    return taken.where("_copies > 0").select(
        "_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))
    ).select(*(F.col(f"_row.{n}").alias(c) for c, n in names.items()))


def op6_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all documents takes of each."""
    sized = materialise(
        table(spark, sf_dir, "documents").select(
            "doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("digest")
        ),
        "sized",
    )
    taken = copies_taken(sized, "source", ["doc_id", "digest"], "size", fresh(sized, "copies"))
    return taken.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


OP6_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    md5(coalesce(text, '')) AS digest FROM documents),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 3 AS cap FROM named),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER ahead, 0))::BIGINT
    / (sum(w) OVER () - coalesce(sum(w) OVER ahead, 0))::BIGINT AS level
  FROM weighed
  WINDOW ahead AS (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
plan AS (
  SELECT source, source_size,
    least(cap::DOUBLE, coalesce(max(CASE WHEN cap / w > level THEN level END) OVER () * w, cap::DOUBLE)) AS target,
    ('0x' || substr(md5('{SEED}:' || coalesce(source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM levels),
placed AS (
  SELECT s.doc_id, s.size, s.source, p.source_size, p.target, p.u,
    CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0.0::DOUBLE END AS rate,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id NULLS FIRST, s.digest) - 1 AS i
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
tried AS (
  SELECT *, least(floor((i + 1) * rate + (u + k / {STARTS})) - floor(i * rate + (u + k / {STARTS})), 3) * size AS taken
  FROM placed, (SELECT range AS k FROM range({STARTS}))),
chosen AS (
  SELECT source, k FROM tried GROUP BY source, k
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(sum(taken) - any_value(target)), k) = 1)
SELECT t.doc_id, t.size, t.source_size, t.target, t.taken::BIGINT AS taken
FROM tried t JOIN chosen c ON t.source IS NOT DISTINCT FROM c.source AND t.k = c.k
"""
