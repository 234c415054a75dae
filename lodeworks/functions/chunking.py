"""Texts to overlapping chunks: greedy packing of paragraphs, sentences and words."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.functions.text import clean, content_metrics, normalised, sentences, strip, unnested, word_count
from lodeworks.functions.quality import sanity_of
from lodeworks.functions.urls import page_id

SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def split_sentences(text: str) -> list[str]:
    return [s for s in SENTENCE_END.split(text.strip()) if s]


@dataclass(frozen=True)
class Sizes:
    most: int = 800
    least: int = 50
    overlap: int = 100


def stretches(sizes: list[int], room: int, head: Callable[[int, int], int], begun: int) -> Iterator[tuple[int, int]]:
    """Cuts a list of sizes into stretches (first, end) that fit a room, each with the unit that didn't fit the last one.

    Sizes include what joins a unit to the one before. head says, for a stretch that ends, how much of the room the next
    one has taken before its first unit: a negative number makes up for the joint of a first unit behind nothing. The first
    stretch has begun with so much.
    """
    upto, i = [0, *accumulate(sizes)], 0
    least = begun < 0
    while i < len(sizes):
        j = max(i + least, bisect_right(upto, upto[i] + room - begun) - 1)
        yield i, j
        begun, i, least = head(i, j), j, True


class Packer:
    """Chunks of texts by their paragraphs, sentences and words: cut points from sums of lengths, texts joined at the end."""

    def __init__(self, sizes: Sizes, split: Callable[[str], list[str]] = split_sentences):
        self.sizes, self.split = sizes, split

    def overlap(self, chunk: str) -> str:
        """The end of a chunk that the next one repeats: whole, its last sentences, or its last words, as the room allows."""
        room = self.sizes.overlap
        if len(chunk) <= room:
            return chunk
        ending = self.split(chunk)[::-1]
        joined = list(accumulate((len(s) + 1 for s in ending), initial=-1))
        if ending and joined[1] < room:
            return " ".join(ending[: bisect_right(joined, room) - 1][::-1])
        last = chunk[len(chunk) - room :]
        head, gap, rest = last.partition(" ")
        return rest if head and gap else last

    def _joined(self, units: list[str], gap: str, begin: str | None = None) -> Iterator[str]:
        """Units joined by a gap within the limit, each chunk behind its predecessor's overlap; one may begin already."""
        made: list[str] = []

        def head(i: int, j: int) -> int:
            nonlocal begin
            begin = self.overlap(made[-1]) if self.sizes.overlap > 0 else None
            return -len(gap) if begin is None else len(begin)

        for i, j in stretches([len(u) + len(gap) for u in units], self.sizes.most, head, -len(gap) if begin is None else len(begin)):
            made.append(gap.join([*([] if begin is None else [begin]), *units[i:j]]))
            yield made[-1]
        if not made and begin:
            yield begin

    def of_words(self, text: str) -> list[str]:
        """Chunks of words, each with the last ten of its predecessor; words that are too long are cut while they come first."""
        units, most, last = text.split(), self.sizes.most, 10 if self.sizes.overlap > 0 else 0
        first = next((k for k, w in enumerate(units) if len(w) < most), len(units))
        upto = [0, *accumulate(len(w) + 1 for w in units)]
        starts = {first: first}

        def head(i: int, j: int) -> int:
            begin = max(starts[first + i], first + j - last)
            starts[first + j] = begin
            return upto[first + j] - upto[begin] - 1

        whole = [(starts[first + i], first + j) for i, j in stretches([len(w) + 1 for w in units[first:]], most, head, -1)]
        return [*(w[:most] for w in units[:first]), *(" ".join(units[i:j]) for i, j in whole)]

    def of_sentences(self, text: str) -> list[str]:
        """Chunks of sentences; a first one that is too long goes by words, a later one makes a long chunk."""
        units = self.split(text)
        words = self.of_words(units.pop(0)) if units and len(units[0]) >= self.sizes.most else []
        begin = words.pop() if words else None
        return [*words, *(c.strip() for c in self._joined(units, " ", begin))]

    def chunks(self, text: str | None) -> list[str]:
        """Paragraphs packed up to the limit; longer ones by sentences; what remains counts from the least size on."""
        if not text or len(text) < self.sizes.least:
            return []
        paragraphs = [p for p in map(str.strip, text.split("\n\n")) if p]
        out: list[str] = []
        long = False
        for long, some in groupby(paragraphs, lambda p: len(p) > self.sizes.most):
            out += (c for p in some for c in self.of_sentences(p)) if long else self._joined(list(some), "\n\n")
        return out[:-1] if out and not long and len(out[-1]) < self.sizes.least else out


CHUNK = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("clean_text", T.StringType()), T.StructField("word_count", T.IntegerType()), T.StructField("sentence_count", T.IntegerType())]
    + [T.StructField(k, T.DoubleType()) for k in ("score", "unique_ratio", "alpha_ratio", "avg_sentence_length")]
)


def chunk_rows(c: Column, sizes: Sizes = Sizes(), split: Callable[[str], list[str]] = split_sentences) -> Column:
    """A text's chunks with their normal form and measures, in one vectorised call for a batch of texts."""

    def row(chunk: str) -> dict:
        tidy = normalised(chunk)
        found = split_sentences(tidy)
        return {"text": chunk, "clean_text": tidy, "word_count": len(tidy.split()), "sentence_count": len(found)} | sanity_of(tidy, len(found), sizes.least)

    @F.pandas_udf(T.ArrayType(CHUNK))
    def run(texts: pd.Series) -> pd.Series:
        packer = Packer(sizes, split)
        return texts.map(lambda t: [row(x) for x in packer.chunks(t)])

    return run(c)


def chunk_pages(pages: DataFrame, url_col: str = "url", text_col: str = "text", sizes: Sizes = Sizes(), least_score: float = 0.3) -> DataFrame:
    """Pages to their valid chunks: cleaned, packed, normalised, measured, and kept from the least sanity score on.

    A chunk comes out of one call with all its measures, so that no filter on them works anything out again.
    """
    rows = unnested(pages, chunk_rows(clean(F.col(text_col)), sizes), "chunk_index", "__chunk")
    valid = (F.length("__chunk.clean_text") >= sizes.least) & (F.col("__chunk.score") >= least_score)
    rows = rows.where(valid).select(*[c for c in pages.columns if c != text_col], "chunk_index", *(F.col(f"__chunk.{k}").alias(k) for k in ("text", "clean_text", "word_count", "sentence_count")), F.struct(F.lit(True).alias("is_valid"), *(F.col(f"__chunk.{k}").alias(k) for k in CHUNK.names[4:])).alias("sanity"))
    return rows.withColumns({"chunk_id": F.concat(page_id(F.col(url_col)), F.lit("_"), F.col("chunk_index").cast("string")), "char_count": F.length("clean_text")})


def _fold(parts: Column, glue: str, most: int, least: int) -> Column:
    """Packs strings in order while they fit; what remains counts from the least size on. One fold, in the JVM."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, part: Column) -> Column:
        longer = F.when(acc["now"] == "", part).otherwise(F.concat(acc["now"], F.lit(glue), part))
        fits = (F.length(longer) <= most) | (acc["now"] == "")
        return F.struct(F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])).alias("done"), F.when(fits, longer).otherwise(part).alias("now"))

    return F.aggregate(parts, zero, step, lambda acc: F.when((F.length(acc["now"]) > 0) & (F.length(acc["now"]) >= least), F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]))


def by_paragraphs(c: Column, most: int = 800, least: int = 100) -> Column:
    return _fold(F.filter(F.transform(F.split(c, "\n\n"), strip), lambda p: p != ""), "\n\n", most, least)


def by_sentences(c: Column, most: int = 800, least: int = 100) -> Column:
    return _fold(sentences(c), " ", most, least)


def smart(c: Column, most: int = 800, least: int = 100) -> Column:
    """By paragraphs, and what is still too long by sentences."""
    return F.flatten(F.transform(by_paragraphs(c, most, least), lambda p: F.when(F.length(p) > most, by_sentences(p, most, least)).otherwise(F.array(p))))


def positioned(chunks: Column) -> Column:
    """Chunks with places that count the chunks' own characters, but not what parted them: sums that run along the list."""
    zero = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("upto"))
    starts = F.aggregate(F.transform(chunks, F.length), zero, lambda a, n: F.struct(F.array_append(a["starts"], a["upto"]).alias("starts"), (a["upto"] + n).alias("upto")), lambda a: a["starts"])
    return F.transform(F.arrays_zip(chunks.alias("text"), starts.alias("start")), lambda x, i: F.struct(i.alias("chunk_index"), x["text"].alias("text"), x["start"].alias("start_char"), (x["start"] + F.length(x["text"])).alias("end_char"), word_count(x["text"]).alias("word_count"), F.length(x["text"]).alias("char_count")))


def simple(c: Column, most: int = 500, least_line: int = 50) -> Column:
    """Lines of more than the least length, split at full stops and packed below the limit."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, part: Column) -> Column:
        fits = F.length(acc["now"]) + F.length(part) < most
        emit = ~fits & (acc["now"] != "")
        added = F.concat(part, F.lit(". "))
        return F.struct(F.when(emit, F.array_append(acc["done"], strip(acc["now"]))).otherwise(acc["done"]).alias("done"), F.when(fits, F.concat(acc["now"], added)).otherwise(added).alias("now"))

    def line(p: Column) -> Column:
        parts = F.filter(F.transform(F.split(p, r"\."), strip), lambda s: s != "")
        return F.aggregate(parts, zero, step, lambda acc: F.when(acc["now"] != "", F.array_append(acc["done"], strip(acc["now"]))).otherwise(acc["done"]))

    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda p: F.length(p) > least_line)
    return F.flatten(F.transform(lines, line))


__all__ = ["Packer", "Sizes", "by_paragraphs", "by_sentences", "chunk_pages", "chunk_rows", "content_metrics", "positioned", "simple", "smart", "split_sentences", "stretches"]
