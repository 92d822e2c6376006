"""Text normalisation as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.functions.binding import let

#: Whitespace as Unicode defines it, spelled out because engines disagree on ``\s``.
WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
# Fixed value: texts of a missing label.
MISSING = ("", "none", "null", "nan")
# Fixed value: punctuation that normalised text keeps.
KEPT = r"[^\p{L}\p{N}_\s.,\-+()/#:%;']"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, rf"{WS}+", " ")


def normalize_text(c: Column) -> Column:
    """Lower case, blanks collapsed, odd punctuation to blanks, free-standing numbers to ``<NUM>``; null stays null.

    A number stands free if no letter, digit or underscore is next to it.
    """
    c = F.regexp_replace(collapse(F.lower(c)), KEPT, " ")
    return F.regexp_replace(F.trim(collapse(c)), r"(?<![\p{L}\p{N}_])[0-9]+(?:\.[0-9]+)?(?![\p{L}\p{N}_])", "<NUM>")


def char_ngrams(c: Column, n: int = 13, wrap: bool = True) -> Column:
    """All windows of ``n`` characters of ``^text$``; shorter texts have none."""
    none = F.array().cast("array<string>")
    cut = lambda s: F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, n))).otherwise(none)
    return let(F.concat(F.lit("^"), c, F.lit("$")) if wrap else c, cut)


@F.pandas_udf(T.StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()).casefold())


def folded(c: Column) -> Column:
    """NFKC, blanks collapsed, case folded. There is no built-in for NFKC, so this one is an Arrow function."""
    return _folded(c)


def question_key(c: Column) -> Column:
    return F.lower(strip(collapse(c)))


def alnum_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def label_key(c: Column) -> Column:
    """Label compared without case and without any blanks."""
    return F.lower(F.regexp_replace(c, rf"{WS}+", ""))


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), 0)


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9_\-#.]+", "_")


def is_missing(c: Column) -> Column:
    return F.lower(F.coalesce(strip(c), F.lit(""))).isin(*MISSING)


def caption_or_null(c: Column) -> Column:
    """Blank captions and those that say there is none become null."""
    s = strip(c)
    return F.when((s != "") & (F.lower(s) != "no caption found"), s)


def kept_tokens(c: Column, stopwords: tuple[str, ...]) -> Column:
    """Word tokens of more than one letter that are no stopwords, repeats kept."""
    stop = F.array(*(F.lit(w) for w in stopwords)) if stopwords else F.array().cast("array<string>")
    return F.filter(word_tokens(c), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def levenshtein_similarity(a: Column, b: Column, least: float | None = None) -> Column:
    """1 - distance / longer length; two empty texts are equal. With ``least`` the distance is computed only as far as
    needed to tell whether that similarity is reached, and pairs below it give null."""
    longer = F.greatest(F.length(a), F.length(b))
    if least is None:
        return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)
    # Spark takes a constant limit only, so the limit of the longest texts serves all; the length bound cuts the rest.
    near = F.abs(F.length(a) - F.length(b)) <= (1 - least) * longer
    similarity = 1 - F.levenshtein(a, b) / longer
    return F.when(longer == 0, F.lit(1.0)).when(near, F.when(similarity >= least, similarity))
