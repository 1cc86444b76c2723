"""Column functions for tokens and text cleaning."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: characters a cleaned token keeps; the bar is inside the class on purpose
KEPT_CHARACTERS = "a-z|A-Z|0-9"

DEFAULT_SEPARATOR = " "


def separator_characters(separator: str) -> str | None:
    """The characters a separator stands for, if it is one character or a plain set of them."""
    inner = separator[1:-1] if separator[:1] == "[" and separator[-1:] == "]" else separator
    plain = inner and not any(c in "\\[](){}.*+?^$|-&" for c in inner)
    return inner if plain and (inner != separator or len(inner) == 1) else None


def java_split(text: Column, separator: str = DEFAULT_SEPARATOR) -> Column:
    """T0. Split on a regular expression and drop trailing empty strings.

    Inner and leading empties stay. A text without any separator comes back as its only
    token, also the empty text; a text of separators alone gives no tokens.
    """
    characters = separator_characters(separator)
    if characters is not None:
        # dropping trailing empty strings is dropping trailing separators
        kept = F.rtrim(text, F.lit(characters))
        return (
            F.when(text == "", F.array(F.lit("")))
            .when(kept == "", F.array().cast("array<string>"))
            .otherwise(F.split(kept, separator, -1))
        )

    def without_trailing_empties(parts: Column) -> Column:
        filled = F.transform(F.reverse(parts), lambda part: part != "")
        first_filled = F.array_position(filled, True)
        keep = F.when(first_filled == 0, 0).otherwise(F.size(parts) - first_filled + 1)
        return F.when(F.size(parts) == 1, parts).otherwise(
            F.slice(parts, F.lit(1), keep.cast("int"))
        )

    # the one-element array binds the split once, so that it is not evaluated per use
    return F.transform(F.array(F.split(text, separator, -1)), without_trailing_empties)[0]


def clear(text: Column, separator: str = DEFAULT_SEPARATOR) -> Column:
    """T1. Separators become single spaces; trailing empty tokens vanish."""
    characters = separator_characters(separator)
    if characters is not None:
        kept = F.rtrim(text, F.lit(characters))
        for character in characters.replace(" ", ""):
            kept = F.replace(kept, F.lit(character), F.lit(" "))
        return kept
    return F.array_join(java_split(text, separator), " ")


def keep_plain_characters(text: Column, separator: str = DEFAULT_SEPARATOR) -> Column:
    """T2. Delete, inside every token, all characters but ASCII letters, digits and the bar.

    A token left empty stays as an empty token.
    """
    if separator_characters(separator) is not None and " " in separator:
        # no token holds a space, so one replacement over the joined text does the same
        return F.regexp_replace(clear(text, separator), f"[^{KEPT_CHARACTERS} ]+", "")
    tokens = F.transform(
        java_split(text, separator),
        lambda token: F.regexp_replace(token, f"[^{KEPT_CHARACTERS}]+", ""),
    )
    return F.array_join(tokens, " ")


def drop_words(text: Column, words: Iterable[str], separator: str = DEFAULT_SEPARATOR) -> Column:
    """T3 for a short list. An empty list leaves the text exactly as it is."""
    words = sorted(set(words))
    if not words:
        return text
    kept = F.filter(java_split(text, separator), lambda token: ~token.isin(words))
    return F.array_join(kept, " ")


def hash_bucket(term: Column, buckets: int = 1 << 20) -> Column:
    """F5. Bucket of a term, equal to the JVM hashing term-frequency transformer."""
    return F.pmod(F.hash(term), F.lit(buckets))
