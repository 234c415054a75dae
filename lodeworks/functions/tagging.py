"""Part-of-speech tags by a hidden Markov model that is fitted on untagged texts: expectations are a Spark aggregation.

Closed classes, numbers and endings say where the model begins and which tags a word may have; rounds of expectation and
maximisation over all sentences of the corpus learn the rest from what stands beside what.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.metadata import CLOSED, ENDINGS

#: Words with a symbol of their own: the most frequent ones, if they occur so often. All others share those of their shapes,
#: so that rare words teach what unknown ones are like.
HELD, LEAST = 20_000, 3
#: Tasks of a round at most: each sends one sum for every symbol.
TASKS = 4_096
#: Expectations are summed in integers of this unit.
SCALE = float(1 << 20)
#: Cells (words with padding) of the sentences that are worked on side by side.
AREA = 1 << 14
#: Texts whose sentences are held and decoded together.
GROUP = 128
#: What each possible event counts for beside what is seen, and how much likelier a word's ending makes its tag at first.
SMOOTH, LEAN = 0.01, 10.0

TAGS = (*CLOSED, "CD", "RB", "VBG", "VBD", "NN", "NNS", "JJ", "VB")
OPEN = TAGS[len(CLOSED) + 1 :]
TOKEN = re.compile(r"\w+|[.!?]")


def shape(word: str) -> str:
    """The symbol that rare words of a kind share."""
    if word.isdigit():
        return "#"
    low = word.lower()
    return "-" + next((end for end, _ in ENDINGS if low.endswith(end)), "")


#: Symbols that every model has: of shapes, and of closed classes' words, seen or not.
SHAPES = ("#", "-", *("-" + end for end, _ in ENDINGS))
ALWAYS = (*SHAPES, *(w for own in CLOSED.values() for w in own))


def start_weights(symbol: str) -> np.ndarray:
    """How likely each tag makes a symbol at first; zero for tags that it can't have."""
    out = np.zeros(len(TAGS))
    own = [k for k, tag in enumerate(TAGS) if symbol in CLOSED.get(tag, ())]
    if own:
        out[own] = 1
    elif symbol == "#" or symbol.isdigit():
        out[TAGS.index("CD")] = 1
    else:
        out[[TAGS.index(t) for t in OPEN]] = 1
        lean = next((tag for end, tag in ENDINGS if symbol.endswith(end)), None)
        if lean:
            out[TAGS.index(lean)] = LEAN
    return out


@dataclass
class TagModel:
    """Probabilities of first tags, of a tag behind another, and of symbols by tag; the log likelihood of each round."""

    symbols: dict[str, int]
    first: np.ndarray
    moves: np.ndarray
    emits: np.ndarray
    history: list[float] = field(default_factory=list)

    def sentences(self, text: str | None) -> tuple[list[str], list[np.ndarray]]:
        """A text's words, and its sentences as symbols."""
        words, out, own = [], [], []
        for t in TOKEN.findall(text or ""):
            if t in ".!?":
                if own:
                    out.append(np.array(own, np.int32))
                own = []
            else:
                at = self.symbols.get(t.lower())
                words.append(t)
                own.append(self.symbols[shape(t)] if at is None else at)
        if own:
            out.append(np.array(own, np.int32))
        return words, out

    def tags_of(self, text: str | None, most: int | None = None) -> list[dict[str, str]]:
        """Words of a text, or of its first characters, with the tags of each sentence's likeliest path; fits metadata.pos_tags."""
        words, some = self.sentences((text or "")[:most])
        paths = best_paths(some, self.first, self.moves, self.emits)
        return [{"token": w, "tag": TAGS[k]} for w, k in zip(words, (k for p in paths for k in p), strict=True)]


def side_by_side(sentences: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Sentences of like lengths together: their places, symbols with padding, and lengths."""
    order = sorted(range(len(sentences)), key=lambda k: len(sentences[k]))
    while order:
        n = 1
        while n < len(order) and (n + 1) * len(sentences[order[n]]) <= AREA:
            n += 1
        own, order = order[:n], order[n:]
        lengths = np.array([len(sentences[k]) for k in own])
        held = np.zeros((n, lengths[-1]), np.int32)
        for row, k in zip(held, own, strict=True):
            row[: len(sentences[k])] = sentences[k]
        yield own, held, lengths


def expectations(sentences: list[np.ndarray], first: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]]:
    """By group of sentences: expected first tags and moves, symbols, the chance of each tag at each of them, log likelihood."""
    by_symbol, ones = np.ascontiguousarray(emits.T), np.ones(len(first))
    for _, held, lengths in side_by_side(sentences):
        rows, size = held.shape
        on = np.searchsorted(lengths, np.arange(size), "right")  # sentences from here on have a word at this place
        # Places first, so that all sentences' numbers of a place lie together.
        symbols = np.ascontiguousarray(held.T)
        e = by_symbol[symbols]
        a, c = np.empty(e.shape), np.ones((size, rows))
        for t in range(size):
            k = on[t]
            step = e[t, k:] * (first if t == 0 else a[t - 1, k:] @ moves)
            np.maximum(step @ ones, 1e-300, out=c[t, k:])
            np.divide(step, c[t, k:, None], out=a[t, k:])
        b, moved = np.ones((rows, len(first))), np.zeros_like(moves)
        for t in range(size - 1, -1, -1):
            k = on[t]
            a[t, k:] *= b[k:]  # from here on the chance of each tag
            if t:
                ahead = e[t, k:]
                ahead *= b[k:]
                ahead /= c[t, k:, None]
                moved += a[t - 1, k:].T @ ahead
                np.matmul(ahead, moves.T, out=b[k:])
        real = np.arange(size)[:, None] < lengths
        yield a[0].sum(axis=0), moves * moved, symbols[real], a[real], float(np.log(c).sum())


def best_paths(sentences: list[np.ndarray], first: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> list[np.ndarray]:
    """The likeliest tags of each sentence; of equal paths the one with the first tag."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(sentences)
    with np.errstate(divide="ignore"):
        lf, lm, le = np.log(first), np.log(moves), np.log(emits).T
    for own, held, lengths in side_by_side(sentences):
        rows, size = held.shape
        back = np.zeros((rows, size, len(first)), np.int8)
        score = lf + le[held[:, 0]]
        last = score.copy()
        for t in range(1, size):
            ways = score[:, :, None] + lm
            back[:, t] = ways.argmax(axis=1)
            score = ways.max(axis=1) + le[held[:, t]]
            on = t < lengths
            last[on] = score[on]
        at = last.argmax(axis=1)
        path = np.zeros((rows, size), np.int64)
        for t in range(size - 1, -1, -1):
            path[:, t] = at
            if t:
                at = np.where(t < lengths, back[np.arange(rows), t, at], at)
        for k, p, n in zip(own, path, lengths, strict=True):
            out[k] = p[:n]
    return out


def begin(docs: DataFrame, text_col: str = "text") -> TagModel:
    """The model before any round: symbols of the most frequent words, and what closed classes, numbers and endings say."""
    tokens = F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"(?U)\w+"), F.lit(0)))
    top = docs.select(tokens.alias("w")).groupBy("w").count().where(F.col("count") >= LEAST).orderBy(F.desc("count"), "w").limit(HELD).collect()
    seen = {r["w"]: float(r["count"]) for r in top}
    symbols = {s: k for k, s in enumerate((*ALWAYS, *(w for w in seen if w not in ALWAYS)))}
    often = np.array([1.0 if s in SHAPES else seen.get(s, 1.0) for s in symbols])
    emits = np.stack([start_weights(s) for s in symbols], axis=1) * often
    emits[:, : len(SHAPES)] *= max(1.0, 0.001 * often.sum())
    emits /= np.maximum(emits.sum(axis=1, keepdims=True), 1e-300)
    k = len(TAGS)
    return TagModel(symbols, np.full(k, 1 / k), np.full((k, k), 1 / k), emits)


def symbols_of(c: Column, model: TagModel) -> Column:
    """A text's symbols, each sentence with -1 behind it."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        mark = np.array([-1], np.int32)
        return texts.map(lambda t: np.concatenate([x for own in model.sentences(t)[1] for x in (own, mark)] or [mark[:0]]))

    return run(c)


def fit(docs: DataFrame, text_col: str = "text", rounds: int = 4, stage=lambda df: df) -> TagModel:
    """A model of all sentences of all texts. Every round reads their symbols once; stage writes these as a table, so that
    texts are read twice. Sums of a task are by symbol; they meet in a shuffle and come to the driver, at most HELD rows.
    """
    model = begin(docs, text_col)
    given = stage(docs.select(symbols_of(F.col(text_col), model).alias("symbols"))).coalesce(TASKS)
    allowed = model.emits > 0
    k, n = len(TAGS), len(model.symbols)

    for _ in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast((model.first, model.moves, model.emits))

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            first, moves, emits = sent.value
            # Rows: one for each symbol, one for each tag that is left, one for the first tags, one for the log likelihood.
            total = np.zeros((n + k + 2, k), np.int64)
            for part in (batch.slice(k, GROUP) for batch in batches for k in range(0, batch.num_rows, GROUP)):
                flat = part.column(0).flatten().to_numpy()
                sentences = np.split(flat, np.flatnonzero(flat == -1) + 1)[:-1]
                seen = []
                for begun, moved, symbols, chance, likely in expectations([s[:-1] for s in sentences], first, moves, emits):
                    seen.append((symbols, np.rint(chance * SCALE)))
                    total[n : n + k] += np.rint(moved * SCALE).astype(np.int64)
                    total[n + k] += np.rint(begun * SCALE).astype(np.int64)
                    total[n + k + 1, 0] += int(round(likely * SCALE))
                if seen:
                    at, chances = (np.concatenate(v) for v in zip(*seen, strict=True))
                    for j in range(k):
                        total[:n, j] += np.bincount(at, chances[:, j], n).astype(np.int64)
            found = np.flatnonzero(total.any(axis=1))
            sums = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * k, pa.int32()), pa.array(total[found].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), sums], ["at", "sums"])

        whole = F.array(*(F.sum(F.col("sums")[j].cast("decimal(28,0)")).cast("double") for j in range(k))).alias("sums")
        got = given.mapInArrow(expect, "at long, sums array<long>").groupBy("at").agg(whole).toArrow()
        sent.destroy()
        total = np.zeros((n + k + 2, k))
        if got.num_rows:
            total[got.column("at").to_numpy()] = np.asarray(got.column("sums").combine_chunks().flatten()).reshape(-1, k) / SCALE
        emits = (total[:n].T + SMOOTH) * allowed
        first, moves = total[n + k] + SMOOTH, total[n : n + k] + SMOOTH
        history = [*model.history, float(total[n + k + 1, 0])]
        model = TagModel(model.symbols, first / first.sum(), moves / moves.sum(axis=1, keepdims=True), emits / np.maximum(emits.sum(axis=1, keepdims=True), 1e-300), history)
    return model


def tags(c: Column, model: TagModel) -> Column:
    """Tags of a whole text's words, parted by blanks; sentences of some texts are decoded side by side."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for k in range(0, len(texts), GROUP):
            own = [model.sentences(t)[1] for t in texts.iloc[k : k + GROUP]]
            paths = iter(best_paths([s for some in own for s in some], model.first, model.moves, model.emits))
            out += [" ".join(TAGS[k] for _ in some for k in next(paths)) for some in own]
        return pd.Series(out, dtype=object)

    return run(c)
