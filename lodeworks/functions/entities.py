"""Named entities by casing statistics of a corpus and the likeliest path over words outside, at the head of and within a span.

How often a word is capitalised where no sentence begins tells whether its capital means anything at a beginning; what stands
beside a word anywhere in the corpus (a title, a legal form, a preposition of place) tells its kind everywhere.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words a model holds: those most often capitalised within sentences, and connectors as often between capitals.
HELD = 50_000
#: Occurrences between two capitals from which a word can join a span, and the share of its occurrences that must be such.
JOINS, JOIN_SHARE = 3, 0.2
#: Log odds that a span's first word needs to stand for a name; all odds of words are held within MOST.
NEED, MOST = 1.0, 6.0
#: The share of capitals within a text's sentences at which one says nothing, and beyond which (German, headlines) a word's own
#: odds speak against a name only; what a title before a word or a place's preposition adds.
NORMAL, TITLED, PLACED = 0.125, 4.0, 1.0
#: What speaks against a name right behind another one, and for a connector between two words of one.
PARTED, JOINED = 2.0, 1.0

#: Words before or behind a span that tell its kind.
TITLES = "mr mrs ms dr prof herr frau monsieur madame mme señor señora sir lady president ceo".split()
FORMS = "inc ltd llc corp corporation company gmbh ag group university institute bank".split()
PLACES = "in at near from nach aus bei à en desde".split()
CUES = frozenset(TITLES + FORMS)
KINDS = ("PERSON", "ORGANIZATION", "GPE")

TOKEN = re.compile(r"[^\W_][\w'’-]*|[.!?:\n]")


def tokens_of(text: str | None) -> Iterator[tuple[str, bool]]:
    """Words of a text and whether a sentence or a line begins with them. A point behind a title or a single letter ends nothing."""
    begins, last = True, ""
    for t in TOKEN.findall(text or ""):
        if t in ".!?:\n":
            begins = begins or t != "." or not (last in TITLES or len(last) == 1)
        else:
            yield t, begins
            begins, last = False, t.lower()


COUNTS = ("capital", "small", "between", "followed", "person", "organization", "place")


def count_words(text: str | None, counts: dict[str, list[int]]) -> None:
    """Adds a text's words: within sentences capitalised or not, between two capitals, capitals that another one follows, cues."""
    words = list(tokens_of(text))
    for k, (w, begins) in enumerate(words):
        if begins or not w[0].isalpha():
            continue
        low = w.lower()
        own = counts.get(low)
        if own is None:
            own = counts[low] = [0] * len(COUNTS)
        before = words[k - 1][0]
        after = words[k + 1][0] if k + 1 < len(words) and not words[k + 1][1] else ""
        if w[0].isupper():
            own[0] += 1
            own[3] += after[:1].isupper()
            own[4] += before.lower() in TITLES
            own[5] += after.lower() in FORMS
            own[6] += before in PLACES
        else:
            own[1] += 1
            own[2] += before[0].isupper() and not words[k - 1][1] and after[:1].isupper()


@dataclass
class EntityModel:
    """Log odds of words for a name, kinds' counts, connectors, the chance that a name's word is followed by another, and the
    log odds of words that the corpus lacks."""

    odds: dict[str, float]
    kinds: dict[str, tuple[int, ...]]
    joins: frozenset[str]
    follow: float
    unknown: float

    def scores(self, words: list[tuple[str, bool]]) -> list[float]:
        """Log odds of each word for being part of a name, as it stands."""
        within = [w for w, begins in words if not begins and w[0].isalpha() and w.lower() not in CUES]
        usual = min(0.95, (sum(w[0].isupper() for w in within) + 1) / (len(within) + 20))
        out, before = [], ""
        for w, begins in words:
            if not w[0].isupper() or (low := w.lower()) in TITLES:
                out.append(-math.inf)
            else:
                own = self.odds.get(low, self.unknown)
                own = own if usual <= NORMAL else min(own, 0.0)
                shown = 0.0 if begins else math.log(NORMAL / usual) + (TITLED if before.lower() in TITLES else PLACED if before in PLACES else 0.0)
                out.append(own + shown)
            before = w
        return out

    def spans(self, text: str | None, words: list[tuple[str, bool]] | None = None) -> list[tuple[int, int, str]]:
        """First word, word behind the last, and kind of each span, in order; words are the text's, if they are known."""
        words = list(tokens_of(text)) if words is None else words
        if not words:
            return []
        emit = self.scores(words)
        go, end = math.log(self.follow), math.log(1 - self.follow)
        # Scores of the best path that is outside, in a span's head, within a span, or at a connector within a span.
        best, back = [0.0, -math.inf, -math.inf, -math.inf], []
        for (w, begins), e in zip(words, emit, strict=True):
            out, head, inner, join = best
            if e == head == inner == join == -math.inf:  # nothing begins or goes on
                back.append((0, 0, 0, 0))
                continue
            leave = max(((out, 0), (head + end, 1), (inner + end, 2)), key=lambda p: p[0])
            anew = leave if begins else max(((out, 0), (head + end - PARTED, 1), (inner + end - PARTED, 2)), key=lambda p: p[0])
            enter = -math.inf, 0
            if e > -math.inf:
                enter = anew[0] + e - NEED, anew[1]
            more = (-math.inf, 0) if e == -math.inf or begins else max(((head + go + max(e, -1.0), 1), (inner + go + max(e, -1.0), 2), (join + max(e, -1.0), 3)), key=lambda p: p[0])
            link = (-math.inf, 0) if w not in self.joins or begins else max(((head + go + JOINED, 1), (inner + go + JOINED, 2)), key=lambda p: p[0])
            back.append((leave[1], enter[1], more[1], link[1]))
            best = [leave[0], enter[0], more[0], link[0]]
        state = max(((best[0], 0), (best[1] + end, 1), (best[2] + end, 2)), key=lambda p: p[0])[1]
        path = []
        for b in reversed(back):
            path.append(state)
            state = b[state]
        path.reverse()
        found, k = [], 0
        while k < len(path):
            if path[k] == 1:
                n = k + 1
                while n < len(path) and path[n] in (2, 3):
                    n += 1
                found.append((k, n, self.kind(words, k, n)))
                k = n
            else:
                k += 1
        return found

    def kind(self, words: list[tuple[str, bool]], k: int, n: int) -> str:
        """A cue beside the span decides; then what its words stood beside anywhere; then its shape."""
        before = words[k - 1][0] if k and not words[k][1] else ""
        if before.lower() in TITLES:
            return "PERSON"
        if any(w.lower() in FORMS for w, _ in words[k : n + 1]):
            return "ORGANIZATION"
        seen = np.sum([self.kinds.get(w.lower(), (0, 0, 0)) for w, _ in words[k:n]], axis=0)
        if before in PLACES:
            seen[2] += 1
        if seen.any():
            return KINDS[int(seen.argmax())]
        return "PERSON" if n - k == 2 else "ORGANIZATION" if all(w.isupper() and len(w) > 1 for w, _ in words[k:n]) else "GPE" if n - k == 1 else "ORGANIZATION"

    def entities_of(self, text: str | None, most: int | None = None) -> list[dict[str, str]]:
        """Each entity of a text, or of its first characters, once, in order; fits metadata.named_entities."""
        text = (text or "")[:most]
        words = list(tokens_of(text))
        found = dict.fromkeys((" ".join(w for w, _ in words[k:n]), kind) for k, n, kind in self.spans(text, words))
        return [{"text": t, "type": kind} for t, kind in found]


def fit(docs: DataFrame, text_col: str = "text", stage=lambda df: df) -> EntityModel:
    """A model of all texts' words. Each batch of texts sends a row for each of its words, with sums that meet by word; the
    HELD words that are most often capitalised, and as many connectors, come to the driver. stage writes the sums as a table,
    so that texts are read once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[str, list[int]] = {}
            for t in batch.column(0):
                count_words(t.as_py(), own)
            table = np.array(list(own.values()), np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), *(pa.array(table[:, k]) for k in range(len(COUNTS)))], ["word", *COUNTS])

    sums = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")).mapInArrow(count, "word string, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS))
    sums = stage(sums)
    once = (F.col("capital") + F.col("small")) == 1
    whole = sums.agg(F.sum("capital").alias("capital"), F.sum("followed").alias("followed"), F.count_if(once & (F.col("capital") == 1)).alias("rare_capital"), F.count_if(once).alias("rare")).first()
    held = sums.where("capital > 0").orderBy(F.desc("capital"), "word").limit(HELD).toPandas()
    joins = sums.where((F.col("between") >= JOINS) & (F.col("between") >= JOIN_SHARE * F.col("small"))).orderBy(F.desc("between"), "word").limit(HELD).select("word").collect()
    share = (held["capital"] + 0.5) / (held["capital"] + held["small"] + 1)
    rare = (whole["rare_capital"] + 0.5) / (whole["rare"] + 1)
    kinds = {w: tuple(map(int, k)) for w, *k in zip(held["word"], held["person"], held["organization"], held["place"], strict=True) if any(k)}
    follow = ((whole["followed"] or 0) + 1) / ((whole["capital"] or 0) + 3)
    odds = dict(zip(held["word"], np.clip(np.log(share / (1 - share)), -MOST, MOST).tolist(), strict=True))
    return EntityModel(odds, kinds, frozenset(r["word"] for r in joins), follow, float(np.clip(math.log(rare / (1 - rare)), -MOST, 0.0)))


def entities(c: Column, model: EntityModel) -> Column:
    """The entities of whole texts, each once a text, in order."""

    @F.pandas_udf("array<struct<text: string, type: string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(model.entities_of)

    return run(c)
