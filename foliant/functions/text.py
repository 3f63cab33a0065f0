"""Text functions: native expressions where Spark has them, Arrow UDFs for
Unicode normal forms and sentence rules."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

WORD = r"(?U)\w+"
#: Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = frozenset("v.v ts ths pgs gs tp tt đh e.g i.e etc vs fig no pp tr".split())
_CLOSERS, _MARKS = "\"')]»", ".!?…"
_SECTION_NUMBER = re.compile(r"\b\d+(?:\.\d+)+$")


def fold_text(s: str | None) -> str | None:
    """Case, marks and runs of blanks make no difference."""
    if s is None:
        return None
    bare = "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")
    return " ".join(bare.replace("đ", "d").replace("Đ", "D").casefold().split())


@F.pandas_udf(StringType())
def fold(s: pd.Series) -> pd.Series:
    return s.map(fold_text, na_action="ignore")


def unmark(s: str) -> str:
    """Lower case without marks; blanks stay."""
    low = s.lower()
    if low.isascii():
        return low
    return "".join(c for c in unicodedata.normalize("NFD", low) if unicodedata.category(c) != "Mn").replace("đ", "d")


@F.pandas_udf(StringType())
def unmarked(s: pd.Series) -> pd.Series:
    return s.map(unmark, na_action="ignore")


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def concept_key(c: Column) -> Column:
    """Folded text without punctuation, at most 120 characters."""
    bare = F.regexp_replace(fold(c), r"(?U)[^\w\s]", " ")
    return F.substring(F.btrim(F.regexp_replace(bare, r"\s+", " ")), 1, 120)


def squeeze(c: Column) -> Column:
    """Lower case with single blanks."""
    return F.btrim(F.regexp_replace(F.lower(c), r"\s+", " "))


def quote_is_verbatim(quote: Column, source: Column, least: int = 12) -> Column:
    """Is the quote, of enough characters, found in the source?"""
    q = squeeze(quote)
    return F.coalesce((F.length(q) >= least) & F.contains(squeeze(source), q), F.lit(False))


def dehyphenate(c: Column) -> Column:
    """Words cut at line ends joined, other line ends turned into blanks."""
    joined = F.regexp_replace(c, r"(\p{Ll})-\r?\n(\p{Ll})", "$1$2")
    return F.btrim(F.regexp_replace(joined, r"\s+", " "))


def word_count(c: Column) -> Column:
    """Number of words; the token counter where no tokenizer is configured."""
    return F.regexp_count(c, F.lit(WORD))


def margin_key(c: Column) -> Column:
    """Key of a line in which numbers make no difference."""
    return F.regexp_replace(F.lower(F.btrim(c)), r"\d+", "#")


def breadcrumb(path: Column) -> Column:
    return F.array_join(path, " > ")


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix of two arrays."""
    n = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.transform(F.sequence(F.lit(1), n), lambda i: ~F.element_at(a, i.cast("int")).eqNullSafe(F.element_at(b, i.cast("int")))), True)
    return F.when(n == 0, F.slice(a, 1, 0)).otherwise(F.slice(a, 1, F.when(differs == 0, n).otherwise(differs - 1).cast("int")))


def parent_code(code: Column) -> Column:
    """``L.O.2.1`` -> ``L.O.2``; null for codes of the first level."""
    return F.when(F.size(F.split(code, r"\.")) > 3, F.regexp_replace(code, r"\.[^.]+$", ""))


def outcome_code(c: Column) -> Column:
    """``course:L.O.2.1``, ``l.o.2.1`` and ``2.1`` all give ``L.O.2.1``."""
    bare = F.upper(F.btrim(F.regexp_replace(c, r"^.*:", "")))
    return F.when(bare.rlike(r"^\d+(\.\d+)*$"), F.concat(F.lit("L.O."), bare)).otherwise(bare)


def json_block(c: Column) -> Column:
    """The fenced block of an answer, or all of it."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.btrim(F.when(fenced != "", fenced).otherwise(c), F.lit(" \n\r\t"))


def doc_type(mime: Column, path: Column) -> Column:
    """Type of a file from its media type, else from its name."""
    m = F.lower(F.coalesce(mime, F.lit("")))
    end = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(F.contains(m, F.lit("pdf")) | (end == "pdf"), "pdf")
        .when(F.contains(m, F.lit("wordprocessingml")) | end.isin("docx", "doc"), "docx")
        .when(F.contains(m, F.lit("presentationml")) | end.isin("pptx", "ppt"), "pptx")
        .when(F.contains(m, F.lit("markdown")) | end.isin("md", "markdown"), "markdown")
        .otherwise("unknown")
    )


# Names of the six levels, in order.
BLOOM = ["remember", "understand", "apply", "analyze", "evaluate", "create"]


def bloom_name(level: Column) -> Column:
    return F.when(level.between(1, 6), F.element_at(F.array(*(F.lit(x) for x in BLOOM)), F.coalesce(level, F.lit(1)).cast("int")))


def bloom_level(name: Column) -> Column:
    """Level of a name or of digits; null for anything else."""
    key = F.lower(F.btrim(name))
    given = F.expr("NULL").cast("int")
    for i, x in enumerate(BLOOM, 1):
        given = F.when(key.isin(x, str(i), x[:-1] + "ing" if x.endswith("e") else x + "ing"), i).otherwise(given)
    return given


def _closes(word: str) -> bool:
    """May a sentence end with this word?  It must end with a mark, closing
    signs aside, and be no abbreviation, dotted number or ellipsis."""
    core = word.rstrip(_CLOSERS)
    if not core or core[-1] not in _MARKS:
        return False
    core = core[:-1]
    return not core.endswith(".") and core.casefold() not in ABBREVIATIONS and not _SECTION_NUMBER.search(core)


def split_sentences(text: str | None) -> list[str]:
    """Sentences of a text: one ends with a word that may close it, if the
    next letter or digit after it is a capital or a digit."""
    if not text or not text.strip():
        return []
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    # from the end: does the text after each word begin with a capital or digit?
    opens, ahead = [False] * len(words), False
    for i in range(len(words) - 1, -1, -1):
        opens[i] = ahead
        first = next((c for c in text[words[i][0] : words[i][1]] if c.isalnum()), None)
        if first is not None:
            ahead = first.isupper() or first.isdigit()
    out, begin = [], words[0][0]
    for i, (a, b) in enumerate(words):
        if i + 1 == len(words) or opens[i] and _closes(text[a:b]):
            out.append(text[begin:b])
            begin = words[i + 1][0] if i + 1 < len(words) else b
    return out


@F.pandas_udf(ArrayType(StringType()))
def sentences(s: pd.Series) -> pd.Series:
    return s.map(split_sentences)
