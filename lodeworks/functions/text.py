"""Cleaning, normalising and measuring text as column functions.

Java's regular expressions are the ones that run here. White space follows the wider rule of Unicode with the four
separators 1C to 1F; case and word boundaries follow Unicode.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns whose exact form decides results.
SPACE = r"(?U)[\s\x1c-\x1f]"
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
URL = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"
PHONE_PARENS = r"\(\d{3}\)\s*\d{3}[-.]?\d{4}"
PHONE_PLUS = r"\+\d{1,3}\s*\d{3}\s*\d{3}\s*\d{4}"
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))
BOILERPLATE = (
    r"copyright\s*©?\s*\d{4}.*",
    r"all rights reserved.*",
    r"privacy policy.*",
    r"terms of service.*",
    r"cookie policy.*",
    r"subscribe to newsletter.*",
    r"follow us on.*",
    r"share this.*",
    r"like us on facebook.*",
    r"connect with us.*",
    r"home\s*\|\s*about\s*\|\s*services.*",
    r"skip to main content.*",
    r"back to top.*",
    r"breadcrumb.*",
    r"advertisement.*",
    r"sponsored.*",
    r"ads by.*",
    r"tweet\s*share\s*like.*",
    r"facebook\s*twitter\s*linkedin.*",
)
DASHES = ("–", "—", "―")
BULLETS = ("•", "◦", "‣")
# End of fixed values.


def sub(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def strip(c: Column) -> Column:
    """Both ends without white space."""
    return F.btrim(c, F.lit(BLANKS))


def fence(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are evaluated once a row: no later filter or projection repeats what makes them."""
    made = F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))).alias("__made")
    return df.select("*", made).select(*(F.col(f"`{c}`") for c in df.columns if c not in columns), *(F.col(f"__made.{k}").alias(k) for k in columns))


def words(c: Column) -> Column:
    """The text's runs of non-space characters."""
    return F.filter(F.split(c, SPACE + "+"), lambda w: w != "")


def unnested(df: DataFrame, made: Column, place: str, value: str) -> DataFrame:
    """df with a row for each value of a list, and its place.

    A plain generator would let the optimiser ask first whether the list is empty, and so make it twice.
    """
    return df.select("*", F.posexplode_outer(made).alias(place, value)).where(F.col(place).isNotNull())


def word_count(c: Column) -> Column:
    inside = strip(c)
    return F.when(inside == "", 0).otherwise(F.size(F.split(inside, SPACE + "+")))


def squeeze(c: Column) -> Column:
    return sub(c, SPACE + "+", " ")


def _normal(form: str):
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return run


def _runs(c: Column, exclamations: bool = True) -> Column:
    c = sub(sub(c, r"[.]{3,}", "..."), r"[-]{3,}", "---")
    return sub(sub(c, r"[!]{2,}", "!"), r"[?]{2,}", "?") if exclamations else c


def clean(c: Column) -> Column:
    """Tags and entities to blanks, compatibility decomposition, placeholders for addresses, runs and spaces squeezed."""
    c = sub(sub(F.coalesce(c, F.lit("")), r"<[^>]+>", " "), r"&[a-zA-Z0-9#]+;", " ")
    c = _normal("NFKD")(c)
    for pattern, name in ((URL, " [URL] "), (EMAIL, " [EMAIL] "), (PHONE, " [PHONE] ")):
        c = sub(c, pattern, name)
    return strip(squeeze(_runs(c)))


def normalise(c: Column) -> Column:
    """Single blanks, none around line ends or before punctuation, one between punctuation and a letter."""
    c = sub(F.coalesce(c, F.lit("")), r" {2,}", " ")
    c = sub(sub(c, r"\n +", "\n"), r" +\n", "\n")
    c = sub(sub(c, r" +([,.!?;:])", "$1"), r"([,.!?;:])([a-zA-Z])", "$1 $2")
    return strip(c)


NORMAL = ((" {2,}", " "), ("\n +", "\n"), (" +\n", "\n"), (" +([,.!?;:])", r"\1"), ("([,.!?;:])([a-zA-Z])", r"\1 \2"))


def normalised(t: str) -> str:
    """normalise of a string in a worker."""
    for pattern, by in NORMAL:
        t = re.sub(pattern, by, t)
    return t.strip()


def clean_extracted(c: Column) -> Column:
    """The cleaning of extracted pages: spaces squeezed, entities decoded, addresses deleted, runs shortened."""
    c = squeeze(F.coalesce(c, F.lit("")))
    for entity, by in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(by))
    for pattern in (URL, EMAIL, PHONE):
        c = sub(c, pattern, "")
    return strip(_runs(c, exclamations=False))


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


def clean_markup(c: Column) -> Column:
    """Tags removed, entities decoded, comments, style and script blocks and stray attributes removed."""
    c = _unescape(sub(F.coalesce(c, F.lit("")), r"<[^>]+>", ""))
    for pattern in (r"(?s)<!--.*?-->", r"(?is)<style[^>]*>.*?</style>", r"(?is)<script[^>]*>.*?</script>"):
        c = sub(c, pattern, "")
    return sub(c, r"""(?U)\s+(class|id|style|href|src|alt|title)=["'][^"']*["']""", "")


def normalise_space(c: Column) -> Column:
    """Blanks squeezed, two line ends at most, lines stripped, one blank after sentence ends and commas."""
    c = sub(sub(F.coalesce(c, F.lit("")), r"[ \t]+", " "), r"(?U)\n\s*\n\s*\n+", "\n\n")
    c = F.array_join(F.transform(F.split(c, "\n"), strip), "\n")
    return sub(sub(strip(c), r"(?U)([.!?])\s*([A-Z])", "$1 $2"), r"(?U)([,;:])\s*([A-Za-z])", "$1 $2")


@F.pandas_udf(T.StringType())
def _printable(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(ch for ch in x if ch.isprintable() or ch in "\n\t"))


def normalise_unicode(c: Column) -> Column:
    """Composed form, plain dashes, ellipses and bullets, printable characters, tabs and line ends."""
    c = _normal("NFC")(F.coalesce(c, F.lit("")))
    c = F.translate(c, "".join(("´", "`", "\t", *DASHES, *BULLETS)), "'' ---***")
    return _printable(F.replace(c, F.lit("…"), F.lit("...")))


def remove_noise(c: Column) -> Column:
    """Boilerplate to the end of its line, addresses, long runs and lines of punctuation removed."""
    c = F.coalesce(c, F.lit(""))
    for pattern in BOILERPLATE:
        c = sub(c, "(?imU)" + pattern, "")
    for pattern in (URL, EMAIL, PHONE, PHONE_PARENS, PHONE_PLUS):
        c = sub(c, pattern, "")
    return sub(_runs(c), r"\n[.!?*-]+\n", "\n")


def remove_punctuation(c: Column) -> Column:
    """Spacing of punctuation put right, repeats and line starts removed."""
    c = sub(F.coalesce(c, F.lit("")), r"(?U)\s+([,.!?;:])", "$1")
    c = sub(sub(c, r"(?U)([,.!?;:])\s*([^\s])", "$1 $2"), r"([,.!?;:])\1+", "$1")
    c = sub(sub(c, r"(?U)\s*,\s*", ", "), r"(?U)\s*\.\s*", ". ")
    return sub(c, r"(?U)\n[,.!?;:]+\s*", "\n")


def clean_fully(c: Column) -> Column:
    """Markup, Unicode, noise, white space and punctuation, in this order."""
    return strip(remove_punctuation(normalise_space(remove_noise(normalise_unicode(clean_markup(c))))))


def cleaning_stats(before: Column, after: Column) -> Column:
    """Lengths, share removed, lines and words of a text before and after cleaning."""
    b, a = F.length(before), F.length(after)
    lines = lambda c: F.size(F.split(c, "\n"))
    return F.struct(
        b.alias("original_length"), a.alias("cleaned_length"), F.when(b > 0, (b - a) / b).otherwise(F.lit(0.0)).alias("reduction_ratio"),
        lines(before).alias("lines_before"), lines(after).alias("lines_after"), word_count(before).alias("words_before"), word_count(after).alias("words_after"),
    )


def last_index(c: Column, mark: str) -> Column:
    """Zero-based place of the last mark; -1 without."""
    at = F.instr(F.reverse(c), mark)
    return F.when(at > 0, F.length(c) - at).otherwise(F.lit(-1))


def preview(c: Column, most: int = 500) -> Column:
    """The first characters, cut behind a late sentence end or before a late blank, with an ellipsis."""
    head = F.substring(c, 1, most)
    stop, blank = F.greatest(*(last_index(head, m) for m in ".!?")), last_index(head, " ")
    cut = F.when(stop > most * 0.7, head.substr(F.lit(1), stop + 1)).when(blank > most * 0.8, head.substr(F.lit(1), blank)).otherwise(head)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(cut, F.lit("...")))


def content_hash(c: Column) -> Column:
    """MD5 of the lower-cased, stripped text with squeezed spaces."""
    return F.md5(squeeze(strip(F.lower(c))).cast("binary"))


def raw_hash(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def record_id(text: Column, place: Column, prefix: str = "kb_") -> Column:
    """The prefix with twelve hex digits of the text's MD5, or with the row's place where there is no text."""
    return F.when(F.length(F.coalesce(text, F.lit(""))) > 0, F.concat(F.lit(prefix), F.substring(raw_hash(text), 1, 12))).otherwise(F.concat(F.lit(prefix), place.cast("string")))


def sentences(c: Column) -> Column:
    """Sentences end at a full stop, exclamation or question mark with white space behind it."""
    return F.filter(F.split(strip(c), r"(?U)(?<=[.!?])\s+"), lambda s: s != "")


def content_metrics(c: Column) -> Column:
    """Characters, words, paragraphs, sentences, words a sentence and minutes to read."""
    n = word_count(c)
    stops = F.size(F.filter(F.split(c, r"[.!?]+"), lambda s: strip(s) != ""))
    return F.struct(
        F.length(c).alias("character_count"), n.alias("word_count"), F.size(F.filter(F.split(c, "\n\n"), lambda p: strip(p) != "")).alias("paragraph_count"),
        stops.alias("sentence_count"), F.when(stops > 0, n / stops).otherwise(F.lit(0.0)).alias("avg_sentence_length"), (n / 200).alias("reading_minutes"),
    )


def fold_printable(c: Column) -> Column:
    """The reading of last resort: printable ASCII, line ends and tabs alone."""
    return sub(c, r"[^\x20-\x7E\n\r\t]", "")
