"""URL filter by a weighted vocabulary (operator 9).

Strict and soft terms are found in one pass of an Aho-Corasick automaton over the url. A hit counts
only between boundaries: what stands before and behind it is no ASCII letter or digit. One
strict term, or several distinct soft ones, block a url. Rules for hosts and paths come first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textrill.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Vocabulary:
    """Lower-case terms. ``soft_hits``: so many distinct soft terms block."""

    strict: tuple[str, ...] = ("porn", "porno", "xxx", "hentai", "camgirls", "nsfw", "onlinecasino", "warez", "escorts")
    soft: tuple[str, ...] = (
        "adult", "sex", "sexy", "nude", "casino", "poker", "bet", "bets", "betting", "gambling", "slots",
        "viagra", "pills", "torrent", "crack", "keygen", "dating", "hot", "free", "bonus",
    )
    soft_hits: int = 2


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, where the path begins with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty without ``://`` and for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null; a few rules, as one CASE."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host))):  # the longest stands outermost
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def automaton(words: Vocabulary) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in words.soft:
        found.add_word(term, (term, False))
    for term in words.strict:
        found.add_word(term, (term, True))
    found.make_automaton()
    return found


def _plain(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def hits(url: str, terms: ahocorasick.Automaton) -> tuple[int, int]:
    """Distinct strict and distinct soft terms of a url, between boundaries."""
    low = url.translate(_TO_LOWER)
    found: tuple[set, set] = (set(), set())
    for end, (term, strict) in terms.iter(low):
        start = end + 1 - len(term)
        if (start == 0 or not _plain(low[start - 1])) and (end + 1 == len(low) or not _plain(low[end + 1])):
            found[not strict].add(term)
    return len(found[0]), len(found[1])


_TO_LOWER = str.maketrans(UPPER, LOWER)


def judge(pages: DataFrame, words: Vocabulary = Vocabulary(), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(page_id, url, host, path, rule, strict_hits, soft_hits, verdict)`` of every row.

    Null and empty urls hit nothing and are allowed. Rows are judged one by one: repeated
    rows get equal verdicts, an empty table gives none, other columns aren't read.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = automaton(words)
        for batch in batches:
            counts = [hits(u, terms) if u else (0, 0) for u in batch.column(1).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array([c[0] for c in counts], pa.int32()), pa.array([c[1] for c in counts], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "strict_hits", "soft_hits"])

    id_type = pages.schema["page_id"].dataType.simpleString()
    found = pages.select("page_id", "url").mapInArrow(
        scan, f"page_id {id_type}, url string, strict_hits int, soft_hits int"
    )
    host, path = host_and_path(F.col("url"))
    found = found.withColumn("host", host).withColumn("path", path)
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    blocked = (F.col("strict_hits") >= 1) | (F.col("soft_hits") >= words.soft_hits)
    return found.select(
        "page_id", "url", "host", "path", name.alias("rule"), "strict_hits", "soft_hits",
        F.coalesce(verdict, F.when(blocked, "block").otherwise("allow")).alias("verdict"),
    )


def op9_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the url of every page."""
    return judge(table(spark, sf_dir, "pages")).select(
        "page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits"
    )


def _op9_sql(words: Vocabulary = Vocabulary(), rules: tuple[Rule, ...] = RULES) -> str:
    def counted(terms: tuple[str, ...]) -> str:
        return " + ".join(
            f"regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])', 's')::INT" for t in terms
        )

    longest = sorted(rules, key=lambda r: (-len(r.name), -len(r.host)))
    fits = [(r, f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')") for r in longest]
    name = " ".join(f"WHEN {f} THEN '{r.name}'" for r, f in fits)
    verdict = " ".join(f"WHEN {f} THEN '{r.verdict}'" for r, f in fits)
    return f"""
WITH parts AS (
  SELECT page_id, coalesce(translate(url, '{UPPER}', '{LOWER}'), '') AS low,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
hit AS (SELECT *, ({counted(words.strict)})::INT AS strict_hits, ({counted(words.soft)})::INT AS soft_hits FROM named)
SELECT page_id, host, path, CASE {name} END AS rule,
  CASE {verdict} WHEN strict_hits >= 1 OR soft_hits >= {words.soft_hits} THEN 'block' ELSE 'allow' END AS verdict,
  strict_hits, soft_hits FROM hit
"""


OP9_SQL = _op9_sql()
