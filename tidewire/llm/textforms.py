"""Problem 1: one stored form for text that looks the same.

A compiled longest-match transducer walks over grapheme clusters and replaces each cluster by
its canonical spelling in a single pass.  The mapping is computed once from Unicode properties
(widths, canonical composition, spaces, invisible characters) and a short list of look-alike
letters, and it is checked for conflicts before use.

Defined results
---------------
* null stays null; the empty text stays empty; a text of only spaces or invisibles becomes empty
* runs of any white space become one blank, outer blanks go
* letter case, dashes, quotes and raised or lowered digits are kept: they look different
* a zero-width joiner inside an emoji sequence is kept: without it the sequence looks different
* the result is a fixed point: applying the transducer again changes nothing
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .scratch import Scratch

# Letters of other alphabets (and two Latin ones) whose usual glyph is that of a Latin letter,
# by alphabet: Cyrillic, Greek, Armenian, Cherokee, Lisu, Latin.  Left looks like right.
LOOK_ALIKES = dict(
    pair.split(">")
    for pair in (
        "А>A В>B Е>E Ѕ>S І>I Ј>J К>K М>M Н>H О>O Р>P С>C Т>T Х>X Ү>Y Ѵ>V Ԛ>Q Ԝ>W Ӏ>I Ԍ>G"
        " а>a е>e ѕ>s і>i ј>j о>o р>p с>c у>y х>x һ>h ԛ>q ԝ>w ӏ>l ѵ>v ԁ>d ү>y"
        " Α>A Β>B Ε>E Ζ>Z Η>H Ι>I Κ>K Μ>M Ν>N Ο>O Ρ>P Τ>T Υ>Y Χ>X Ϲ>C Ϳ>J ο>o ν>v ϲ>c ϳ>j ρ>p"
        " Օ>O Ս>U օ>o ս>u հ>h ց>g ո>n"
        " Ꭺ>A Ᏼ>B Ꮯ>C Ꭰ>D Ꭼ>E Ꮐ>G Ꮋ>H Ꭻ>J Ꮶ>K Ꮮ>L Ꮇ>M Ꮲ>P Ꮢ>R Ꮪ>S Ꭲ>T Ꮩ>V Ꮃ>W Ꮓ>Z"
        " ꓮ>A ꓐ>B ꓚ>C ꓓ>D ꓰ>E ꓝ>F ꓖ>G ꓧ>H ꓲ>I ꓙ>J ꓗ>K ꓡ>L ꓟ>M ꓠ>N ꓳ>O ꓑ>P ꓣ>R ꓢ>S ꓔ>T ꓴ>U ꓦ>V ꓪ>W ꓫ>X ꓬ>Y ꓜ>Z"
        " Ð>Đ Ɖ>Đ"
    ).split()
)
# Hyphens that look like the plain one; longer dashes and minus signs look different.
LOOK_ALIKES |= {"\u2010": "-", "\u2011": "-"}
# A letter with an overlaid stroke that looks like a letter of its own.
STROKED = {"d\u0335": "\u0111", "D\u0335": "\u0110", "d\u0336": "\u0111", "D\u0336": "\u0110"}
# Accents that occur on Latin letters in Vietnamese and the European languages.
ACCENTS = "\u0300\u0301\u0302\u0303\u0306\u0308\u0309\u030a\u030c\u031b\u0323\u0327\u0328\u0335\u0336"
# Compatibility forms that look like their plain letters; raised, lowered, circled, squared,
# fraction and font forms look different and stay.
SAME_LOOK_TAGS = ("<wide>", "<narrow>", "<noBreak>")
SAME_LOOK_COMPAT = ((0xFB00, 0xFB06), (0x2160, 0x217F), (0x2024, 0x2026), (0x0132, 0x0133), (0x01C4, 0x01CC))
ZWJ = "\u200d"


def _class(chars: Iterable[str]) -> str:
    """A regular-expression class body, with runs folded into ranges."""
    points = sorted({ord(c) for c in chars})
    parts, start = [], None
    for k, p in enumerate(points):
        if start is None:
            start = p
        if k + 1 == len(points) or points[k + 1] != p + 1:
            parts.append(re.escape(chr(start)) if start == p else f"{re.escape(chr(start))}-{re.escape(chr(p))}")
            start = None
    return "".join(parts)


def is_invisible(ch: str) -> bool:
    """Format characters, variation selectors and fillers that draw nothing."""
    o = ord(ch)
    return (
        unicodedata.category(ch) == "Cf" and not 0x600 <= o <= 0x605 and o not in (0x6DD, 0x70F, 0x8E2, 0x110BD, 0x110CD)
        or 0xFE00 <= o <= 0xFE0F
        or 0xE0100 <= o <= 0xE01EF
        or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0)
        or unicodedata.category(ch) == "Cc" and not ch.isspace()
    )


def is_blank(ch: str) -> bool:
    return ch.isspace() or unicodedata.category(ch) == "Zs"


def _plain(ch: str) -> str:
    """One decomposed code point in its plain width, ligatures opened, look-alikes replaced."""
    tag = unicodedata.decomposition(ch)
    opened = tag.startswith("<compat>") and any(a <= ord(ch) <= b for a, b in SAME_LOOK_COMPAT)
    if tag.startswith(SAME_LOOK_TAGS) or opened:
        ch = unicodedata.normalize("NFKD", ch)
    return "".join(LOOK_ALIKES.get(c, c) for c in ch)


def cluster_rule(cluster: str) -> str:
    """The rule behind the table: canonical spelling of one grapheme cluster."""
    kept = "".join(c for c in cluster if not is_invisible(c))
    plain = "".join(_plain(c) for c in unicodedata.normalize("NFD", kept))
    plain = unicodedata.normalize("NFD", plain)
    for k, v in STROKED.items():
        plain = plain.replace(k, v)
    # An eth that was part of the input decomposes to itself, so one composition suffices.
    return "".join(LOOK_ALIKES.get(c, c) for c in unicodedata.normalize("NFC", plain))


class MappingConflict(ValueError):
    """Two entries of the mapping contradict each other."""


class ClusterTransducer:
    """Trie over cluster spellings; at each place of a cluster the longest entry wins.

    ``entries`` are (spelling, output).  Spellings are compared in canonical decomposition without invisible
    characters, so one entry serves every order of independent marks.  Construction fails with ``MappingConflict``
    when two spellings of one cluster have different outputs, when an output is itself changed, or when plain ASCII text
    would be.  What no entry starts with is kept in its decomposed spelling, which is one form too.
    """

    def __init__(self, entries: Iterable[tuple[str, str]], marks: str, invisible: str, blanks: str, pictographs: str):
        self._root: dict = {}
        self._blanks, self._hidden = frozenset(blanks), dict.fromkeys(map(ord, invisible))
        firsts, outputs = set(), []
        for key, out in entries:
            spelt = self._spelt(key)
            if key.isascii():
                raise MappingConflict(f"plain text {key!r} may not be changed")
            node = self._root
            for ch in spelt:
                node = node.setdefault(ch, {})
            if node.setdefault("", out) != out:
                raise MappingConflict(f"{key!r} has two outputs, {node['']!r} and {out!r}")
            if len(key) == 1 and key != out:
                firsts.add(key)
            outputs.append((key, out))
        odd = _class(b for b in blanks if b != " ")
        marks, invisible, blanks, firsts = _class(marks), _class(invisible), _class(blanks), _class(firsts)
        hang = marks + invisible
        self._finder = re.compile(
            f"[{pictographs}][\ufe0f\U0001f3fb-\U0001f3ff]*(?:{ZWJ}[{pictographs}][\ufe0f\U0001f3fb-\U0001f3ff]*)+"
            f"|(?:[{invisible}]*(?:[{odd}]|[ ](?=[{blanks}{invisible}])))[{blanks}{invisible}]*"
            "|[\u1100-\u1112][\u1161-\u1175][\u11a8-\u11c2]?|[\uac00-\ud7a3][\u11a8-\u11c2]"  # syllables in parts
            f"|[^{hang}{blanks}]?[{hang}]+"
            f"|[{firsts}]"
        )
        # most texts hold nothing to rewrite: one class search tells
        self._any = re.compile(f"[{hang}{odd}{firsts}\u1100-\u11ff]|[ ](?=[ {invisible}])")
        self._pictographs = re.compile(f"[{pictographs}]")
        self._memo: dict[str, str] = {}
        for key, out in outputs:
            if self.apply(out, trim=False) != out:
                raise MappingConflict(f"{key!r} gives {out!r}, which is changed again")

    def _spelt(self, cluster: str) -> str:
        return unicodedata.normalize("NFD", cluster.translate(self._hidden))

    def longest(self, text: str, at: int) -> tuple[int, str | None]:
        """End and output of the longest entry that starts at ``at``; (at, None) if there is none."""
        node, end, out = self._root, at, None
        for k in range(at, len(text)):
            node = node.get(text[k])
            if node is None:
                break
            if "" in node:
                end, out = k + 1, node[""]
        return end, out

    def _walk(self, cluster: str) -> str:
        text, at, parts = self._spelt(cluster), 0, []
        while at < len(text):
            end, out = self.longest(text, at)
            parts.append(text[at] if out is None else out)
            at = max(end, at + 1)
        return "".join(parts)

    def _rewrite(self, cluster: str) -> str:
        done = self._memo.get(cluster)
        if done is None:
            if any(c in self._blanks for c in cluster):
                done = " "
            elif ZWJ in cluster and len(self._pictographs.findall(cluster)) > 1:
                done = cluster
            elif "\u1100" <= cluster[0] <= "\u1112" or "\uac00" <= cluster[0] <= "\ud7a3":
                done = unicodedata.normalize("NFC", cluster.translate(self._hidden))  # eleven thousand syllables, by their own rule
            else:
                done = self._walk(cluster)
            if len(self._memo) < 200_000:  # spellings, not rows: bounds a worker's memory
                self._memo[cluster] = done
        return done

    def apply(self, text: str, trim: bool = True) -> str:
        if text.isascii():
            if not trim:
                return text
            return " ".join(_ASCII_INVISIBLE.sub("", text).split())
        out = self._finder.sub(lambda m: self._rewrite(m.group()), text) if self._any.search(text) else text
        return out.strip(" ") if trim else out


_ASCII_INVISIBLE = re.compile("[\x00-\x08\x0e-\x1b\x7f]")


@lru_cache(maxsize=1)
def transducer() -> ClusterTransducer:
    """The compiled transducer of this process; the table comes from ``cluster_rule``."""
    points = [chr(p) for p in (*range(0x80, 0xD800), *range(0xE000, 0x10000), *range(0x1F000, 0x1FB00), *range(0xE0000, 0xE0200))]
    assigned = [c for c in points if unicodedata.category(c) not in ("Cn", "Co", "Cs")]
    controls = [chr(p) for p in range(0x20) if not chr(p).isspace()] + ["\x7f"]
    marks = "".join(c for c in assigned if unicodedata.category(c) in ("Mn", "Mc", "Me") and not is_invisible(c))
    invisible = "".join(c for c in (*assigned, *controls) if is_invisible(c))
    blanks = "".join(c for c in (*map(chr, range(0x21)), *assigned) if is_blank(c))
    pictographs = "\u203c\u2049\u2122\u2139\u2190-\u21ff\u2300-\u23ff\u2600-\u27bf\u2900-\u297f\u2b00-\u2bff\U0001f000-\U0001f3fa\U0001f400-\U0001faff"
    return ClusterTransducer(table_entries(assigned, set(marks) | set(invisible) | set(blanks)), marks, invisible, blanks, pictographs)


def table_entries(assigned: list[str], skip: set[str]) -> Iterator[tuple[str, str]]:
    """(spelling, output) of every character that changes or has a composed form, and of plain, wide and look-alike
    letters under one or two accents, all by ``cluster_rule``."""
    like: dict[str, list[str]] = {}
    for c in assigned:
        if c not in skip and not "\uac00" <= c <= "\ud7a3":
            out, parts = cluster_rule(c), unicodedata.normalize("NFD", c)
            if out != c or parts != c:
                yield c, out
                if parts == c:
                    like.setdefault(out, []).append(c)
    hung = dict.fromkeys(unicodedata.normalize("NFD", a + b) for a in ACCENTS for b in ("", *ACCENTS) if a != b)
    for base in (*map(chr, range(0x41, 0x5B)), *map(chr, range(0x61, 0x7B)), "\u0110", "\u0111"):
        for marks in hung:
            out = cluster_rule(base + marks)
            yield base + marks, out
            for c in like.get(base, ()):
                yield c + marks, out


def same_form(text: str | None) -> str | None:
    """The canonical form of one text; null stays null."""
    return None if text is None else transducer().apply(text)


@pandas_udf(StringType())
def _same_form(texts: pd.Series) -> pd.Series:
    t = transducer()
    return texts.map(lambda s: None if s is None else t.apply(s))


def canonical_form(column: Column | str) -> Column:
    """Canonical form of a string column (Arrow batches; the text is not expressible in Catalyst,
    which has neither canonical composition nor grapheme clusters)."""
    return _same_form(F.col(column) if isinstance(column, str) else column)


def canonical_fields(articles: DataFrame, fields: tuple[str, ...] = ("title", "description")) -> DataFrame:
    """``articles`` with each of ``fields`` in its one form; other columns and all rows unchanged."""
    return articles.withColumns({f: canonical_form(f) for f in fields})


def lookalike_pairs(articles: DataFrame, fields: tuple[str, ...] = ("title", "description")) -> tuple[DataFrame, Scratch]:
    """Pairs of articles whose field looks the same but is stored differently.

    Rows with a null id or a null field make no pair; repeated rows count once; an article is
    never paired with itself.  Copies that are stored alike are no result, so the pairing is done
    between the few spellings of a form and only then widened to their articles: a form held by a
    third of all rows in one spelling costs nothing.
    """
    stack = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("stored")) for f in fields)))
    scratch = Scratch(articles.sparkSession, "forms")
    held = scratch.table(
        articles.select(F.col("article_id").alias("id"), stack.alias("f"))
        .select("id", "f.*")
        .filter("id is not null and stored is not null")
        .withColumn("form", canonical_form("stored"))
        .select("field_name", "id", F.xxhash64("form").alias("form_key"), F.md5("form").alias("form"), F.md5("stored").alias("spelling"))
    )
    spellings = (
        held.groupBy("field_name", "form_key", "form")
        .agg(F.min("spelling").alias("lo"), F.max("spelling").alias("hi"))
        .filter("lo <> hi")
        .select("field_name", "form_key", "form")
    )
    several = scratch.table(held.join(spellings, ["field_name", "form_key", "form"], "left_semi").distinct())
    scratch.drop(held)
    a = several.select("field_name", "form", F.col("spelling").alias("sa"), F.col("id").alias("a"))
    b = several.select("field_name", "form", F.col("spelling").alias("sb"), F.col("id").alias("b"))
    kinds = several.select("field_name", "form", "spelling").distinct()
    met = (
        kinds.withColumnRenamed("spelling", "sa")
        .join(kinds.withColumnRenamed("spelling", "sb"), ["field_name", "form"])
        .filter("sa < sb")
    )
    pairs = (
        met.join(a, ["field_name", "form", "sa"])
        .join(b, ["field_name", "form", "sb"])
        .filter("a <> b")
        .select("field_name", F.least("a", "b").alias("left_article_id"), F.greatest("a", "b").alias("right_article_id"))
        .distinct()
    )
    return pairs, scratch
