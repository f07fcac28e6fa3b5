"""Text cleaning and word statistics."""

from __future__ import annotations

import html
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Characters whose presence may make entity decoding or canonical composition change a text.
UNSETTLED = r"[&\p{M}ʹ;·ᄀ-ᇿἀ-῿  ΩKÅ〈〉豈-﫿]|[^\u0000-￿]"
BLANKS = r"(?U)\s+"


@pandas_udf(StringType())
def _settle(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", html.unescape(s)))


@pandas_udf(StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else html.unescape(s))


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_data(self, data: str) -> None:
        if stripped := data.strip():
            self.found.append(stripped)


def _markup_free(text: str | None) -> str:
    if text is None:
        return ""
    parser = _Visible()
    parser.feed(text)
    parser.close()
    return " ".join(parser.found)


@pandas_udf(StringType())
def _strip_markup(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else _markup_free(s))


def settled(text: Column) -> Column:
    """Entities decoded and canonically composed; texts that both leave alone stay in the JVM."""
    needs = text.rlike(UNSETTLED)
    return F.when(needs, _settle(F.when(needs, text))).otherwise(text)


def unescaped(text: Column) -> Column:
    """Entities decoded."""
    needs = F.contains(text, F.lit("&"))
    return F.when(needs, _unescape(F.when(needs, text))).otherwise(text)


def clean_html(text: Column) -> Column:
    """Text of a markup fragment: pieces between tags, trimmed and joined by one blank; script and style
    text counts as text.  Null gives the empty text."""
    needs = text.rlike("[<&]")
    return F.coalesce(F.when(needs, _strip_markup(F.when(needs, text))).otherwise(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")), F.lit(""))


def normalized(text: Column) -> Column:
    """Comparison form: entities decoded, composed, lower case, tags and punctuation to blanks, blanks
    collapsed.  Accents stay.  Null gives the empty text."""
    low = F.lower(settled(F.coalesce(text, F.lit(""))))
    bare = F.regexp_replace(F.regexp_replace(low, "<[^>]+>", " "), r"(?U)[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(bare, BLANKS, " "))


def embedding_text(title: Column, description: Column) -> Column:
    """``title. description``, the title alone without a description; blanks collapsed."""
    tidy = lambda c: F.trim(F.regexp_replace(settled(F.coalesce(c, F.lit(""))), BLANKS, " "))
    t, d = tidy(title), tidy(description)
    return F.when(F.length(d) > 0, F.concat(t, F.lit(". "), d)).otherwise(t)


def tokens(normal: Column) -> Column:
    """Words of a normalized text; none for the empty text."""
    return F.when(normal == "", F.array().cast("array<string>")).otherwise(F.split(normal, " "))


def word_pairs(words: Column) -> Column:
    """Distinct neighbouring word pairs; a lone word is its own pair."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.when(n < 2, words).otherwise(pairs))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def digit_tokens(*texts: Column) -> Column:
    """Distinct runs of digits over the texts."""
    return F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", *texts), F.lit(r"(\d+)"), F.lit(1)))


def first_filled(*columns: Column) -> Column:
    """First column that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def filled(column: Column) -> Column:
    """Whether a text is more than blanks."""
    return F.coalesce(F.trim(column) != "", F.lit(False))


