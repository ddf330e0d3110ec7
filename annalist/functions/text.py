"""Column expressions on text. All are built-in functions and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A Han character is a token by itself, as Chinese is written without spaces.
TOKEN = r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"


def tokens(text: Column) -> Column:
    """Lower-cased maximal runs of letters and numbers, and single Han characters, in order; null stays null."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """How often a pattern occurs in a text."""
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def html_text(html: Column) -> Column:
    """Markup to text: script and style blocks, comments and tags go, white space collapses."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>", " ")
    bare = F.regexp_replace(bare, r"(?is)<style\b.*?</style>", " ")
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))


def removals(word: Column) -> Column:
    """(at, rest) for each character left out of a word, by position from 1."""
    return F.transform(
        F.sequence(F.lit(1), F.length(word)),
        lambda i: F.struct(
            i.alias("at"),
            F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))).alias("rest"),
        ),
    )
