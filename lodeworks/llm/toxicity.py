"""Toxicity by a weighted finite-state pattern grammar over clauses."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.llm.common import annotate, drop_path, prefixed, release, staged

#: Bound of the labelled sample the grammar's weights are fitted on, by label. Rows are taken in the order of a hash.
SAMPLE_TOXIC, SAMPLE_CLEAN = 3000, 9000
THRESHOLD = 0.7
ADDED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_matches", T.LongType())])

# The alphabets of the transducers.
INSULTS = "idiot idiots moron morons imbecile scum vermin loser losers worthless pathetic disgusting stupid dumbass bastard scumbag".split()
THREATS = "kill hurt destroy stab shoot strangle murder beat burn crush".split()
INTENT = "will gonna shall must should would going wanna ll".split()
TARGETS = "you your yours yourself u he him his she her they them their those these this that everyone people".split()
NEGATION = "not no never neither nor without isn aren wasn weren don doesn didn ain cannot nicht kein keine ne pas jamais nunca".split()
REPORTING = "said says say saying called calls calling claimed claims wrote writes quoted quotes reported reports alleged tweeted according".split()
TAGS = {w: tag for tag, words in (("R", REPORTING), ("N", NEGATION), ("Y", TARGETS), ("M", INTENT)) for w in words}
WORD = re.compile(r"[^\W_]+")
CLAUSE = re.compile(r"[.!?;:\n\r]+")
#: Labels move a pattern's weight away from its path's as if that were worth so many documents.
PRIOR_DOCS = 4


class Transducer(NamedTuple):
    """A deterministic weighted transducer: for each state and symbol read the next state, the symbol written and a weight.

    Symbols are o, Y (target), N (negation), M (intent), R (reporting), I (insult) and T (threat), the last two with the
    flags that transducers have given them.
    """

    start: object
    arcs: dict[tuple[object, str], tuple[object, str, float]]

    def run(self, symbols: Iterable[str]) -> Iterator[tuple[str, float]]:
        state, arcs = self.start, self.arcs
        for x in symbols:
            state, y, weight = arcs[state, x]
            yield y, weight

    def written(self) -> list[str]:
        return sorted({y for _, y, _ in self.arcs.values()})


def reach(mark: str, words: int | None, kinds: str, flag: str, symbols: list[str], weight: float = 1.0) -> Transducer:
    """Flags the symbols of some kinds that stand within so many words behind a mark, or anywhere behind it."""
    arcs = {}
    for left in range((words or 1) + 1):
        for x in symbols:
            hit = left > 0 and x[0] in kinds
            then = (words or 1) if x == mark else left if words is None else max(0, left - 1)
            arcs[left, x] = then, x + flag * hit, weight if hit else 1.0
    return Transducer(0, arcs)


def verdicts(symbols: list[str]) -> Transducer:
    """Writes the pattern of each insult, and of each threat with an intent or a target before it: kind and the flags
    a (aimed), n (negated), r (reported). All else becomes o."""
    arcs = {}
    for x in symbols:
        aimed = "b" in x or "f" in x
        if x[0] == "I" or x[0] == "T" and ("m" in x or "b" in x):
            weight = {"I": (0.92, 0.96), "T": (0.45, 0.85)}[x[0]][aimed]
            arcs[0, x] = 0, x[0] + "a" * aimed + "n" * ("n" in x) + "r" * ("r" in x), weight
        else:
            arcs[0, x] = 0, "o", 1.0
    return Transducer(0, arcs)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that writes what second makes of first's output; weights multiply along its arcs."""
    start, arcs = (first.start, second.start), {}
    todo, seen = [start], {start}
    read = sorted({x for _, x in first.arcs})
    while todo:
        a, b = state = todo.pop()
        for x in read:
            na, y, wa = first.arcs[a, x]
            nb, z, wb = second.arcs[b, y]
            arcs[state, x] = (na, nb), z, wa * wb
            if (na, nb) not in seen:
                seen.add((na, nb))
                todo.append((na, nb))
    return Transducer(start, arcs)


def cascade() -> tuple[Transducer, list[Transducer]]:
    """What the grammar is composed of: a transducer of targets that reads a clause from its end, and those that read on
    from its beginning, in order: targets, negation, intent, reported speech, verdicts."""
    ahead = reach("Y", 4, "IT", "f", ["o", "Y", "N", "M", "R", "I", "T"])
    steps: list[Transducer] = []
    symbols = ahead.written()
    for mark, words, kinds, flag, weight in (("Y", 4, "IT", "b", 1.0), ("N", 3, "IT", "n", 0.4), ("M", 3, "T", "m", 1.0), ("R", None, "IT", "r", 0.5)):
        steps.append(reach(mark, words, kinds, flag, symbols, weight))
        symbols = steps[-1].written()
    return ahead, [*steps, verdicts(symbols)]


class Composed:
    """The grammar's transducers, composed: run over a clause's tags, it gives the patterns of the matches."""

    def __init__(self):
        self.ahead, (whole, *rest) = cascade()
        for step in rest:
            whole = compose(whole, step)
        self.whole = whole
        #: Each pattern's weight, as it multiplies along its path.
        self.priors = {y: w for _, y, w in whole.arcs.values() if y != "o"}

    def matches(self, tags: list[tuple[str, float]]) -> list[tuple[str, float]]:
        """(pattern, term weight) of each match in a clause's tags."""
        seen = [y for y, _ in self.ahead.run(x for x, _ in reversed(tags))]
        return [(y, term) for (y, _), (_, term) in zip(self.whole.run(reversed(seen)), tags, strict=True) if y != "o"]


class Lexicon:
    """The insult and threat acceptors: whole words, and stems that end in a *."""

    def __init__(self, insults: dict[str, float], threats: dict[str, float]):
        import ahocorasick

        self.weights = {("I", t): w for t, w in insults.items()} | {("T", t): w for t, w in threats.items()}
        trie: dict[str, list] = defaultdict(list)
        for kind, term in self.weights:
            trie[term.rstrip("*")].append((kind, term))
        self.automaton = ahocorasick.Automaton()
        for text, terms in trie.items():
            self.automaton.add_word(text, (len(text), terms))
        if trie:
            self.automaton.make_automaton()
        self.any = bool(trie)

    def hits(self, low: str) -> dict[int, tuple[str, str, float]]:
        """Kind, term and weight of the weightiest term at each word start that begins one."""
        found: dict[int, tuple[str, str, float]] = {}
        if not self.any:
            return found
        for end, (n, terms) in self.automaton.iter(low):
            start = end - n + 1
            if start and low[start - 1].isalnum():
                continue
            whole = end + 1 == len(low) or not low[end + 1].isalnum()
            for kind, term in terms:
                w = self.weights[kind, term]
                if (whole or term[-1] == "*") and (start not in found or w > found[start][2]):
                    found[start] = (kind, term, w)
        return found


def text_matches(text: str | None, lexicon: Lexicon, grammar: Composed) -> list[tuple[str, float]]:
    """The matches of a whole text, clause by clause."""
    low = (text or "").lower()
    hits = lexicon.hits(low)
    if not hits:
        return []
    out, at = [], 0
    starts = sorted(hits)
    k = 0
    for stop in [*CLAUSE.finditer(low), None]:
        end = stop.start() if stop else len(low)
        if k < len(starts) and starts[k] < end:
            tags = []
            for m in WORD.finditer(low, at, end):
                hit = hits.get(m.start())
                tags.append((hit[0], hit[2]) if hit else (TAGS.get(m.group(), "o"), 0.0))
            out += grammar.matches(tags)
            while k < len(starts) and starts[k] < end:
                k += 1
        at = stop.end() if stop else end
    return out


def score(matches: list[tuple[str, float]], arcs: dict[str, float], floor: float) -> float:
    """Noisy-or of the matched clauses' weights over the floor."""
    clean = 1 - floor
    for pattern, weight in matches:
        clean *= 1 - weight * arcs[pattern]
    return 1 - clean


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _terms(text: str | None, contexts: bool) -> Iterator[tuple[str, int]]:
    """Words and stems of 4 to 6 letters, with a hash of the words around."""
    words = WORD.findall((text or "").lower())
    for i, w in enumerate(words):
        if len(w) < 3 or not w.isalpha():
            continue
        around = zlib.crc32(f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}".encode()) if contexts else 0
        yield w, around
        for n in (4, 5, 6):
            if len(w) > n:
                yield w[:n] + "*", around


def learn_insults(sample: DataFrame) -> dict[str, float]:
    """Terms that the toxic sample has in many different contexts and the clean one hardly ever, with their precision.

    Contexts, not occurrences, are counted, so that rare words of a much copied document prove nothing. A stem counts
    only where it covers more than the longer terms below it.
    """
    spark = sample.sparkSession

    def toxic_terms(batches):
        for batch in batches:
            found = {x for t in batch.column(0) for x in _terms(t.as_py(), True)}
            terms, around = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(around, pa.int64())], ["term", "around"])

    toxic = sample.where("toxic = 1").select("text").mapInArrow(toxic_terms, "term string, around long")
    # At least 6 contexts: a bound on the answer, as the sample is bounded.
    common = {r.term: r.n for r in toxic.distinct().groupBy("term").agg(F.count("*").alias("n")).where("n >= 6").collect()}
    if not common:
        return {}
    known = spark.sparkContext.broadcast(set(common))

    def clean_terms(batches):
        names = known.value
        for batch in batches:
            n: dict[str, int] = defaultdict(int)
            for t in batch.column(0):
                for term, _ in _terms(t.as_py(), False):
                    if term in names:
                        n[term] += 1
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["term", "n"])

    clean = {r.term: r.n for r in sample.where("toxic = 0").select("text").mapInArrow(clean_terms, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    known.destroy()
    volume = {r.toxic: r.n or 0 for r in sample.groupBy("toxic").agg(F.sum(F.length("text")).alias("n")).collect()}
    share = volume.get(1, 0) / max(1, volume.get(1, 0) + volume.get(0, 0))
    # With no clean occurrence, so many toxic contexts have a chance of 1e-7 if the term were neutral.
    need, n = 1, 1.0
    while (n := n * max(share, 1e-3)) > 1e-7 and need < 60:
        need += 1
    picked = {t: c for t, c in common.items() if c >= need and clean.get(t, 0) * share <= 0.01 * c * (1 - share)}
    longer: dict[str, int] = defaultdict(int)
    for t, c in picked.items():
        for k in (4, 5, 6):
            if len(t.rstrip("*")) >= k and t != t[:k] + "*":
                longer[t[:k] + "*"] = max(longer[t[:k] + "*"], c)
    return {t: (c + 1) / (c + 1.1 + clean.get(t, 0)) for t, c in picked.items() if c * 0.98 > longer.get(t, 0)}


class Grammar:
    """The fitted weights; plain data, so that it travels with the worker function."""

    def __init__(self, insults: dict[str, float], arcs: dict, floor: float):
        self.insults, self.arcs, self.floor = insults, arcs, floor


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Grammar:
    """Fits the grammar on labelled rows that aren't held out, SAMPLE_TOXIC toxic and SAMPLE_CLEAN clean ones at most.

    Only the ids and the label are read from labels. Rows with a null id or label don't count, labels that repeat count
    once; without labels, or with labels of one kind, the priors remain. Documents that repeat an id count for its label.
    """
    own = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col(id_col))).select(F.col(id_col).alias("__id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    dealt = [own.where(F.col("toxic") == y).orderBy(F.xxhash64("__id"), "__id").limit(n) for y, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    ids = dealt[0].union(dealt[1])
    # The sample's ids have a fixed bound of 12,000 rows.
    sample, sample_at = staged(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "__id").select("text", "toxic"), "labelled")
    learned = learn_insults(sample)
    insults = {t: 0.85 for t in INSULTS} | learned
    threats = {t: 0.9 for t in THREATS}

    def patterns(batches):
        lexicon, composed = Lexicon(insults, threats), Composed()
        for batch in batches:
            rows = [(p, y) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p in ({m[0] for m in text_matches(t, lexicon, composed)} or {"-"})]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int32()))], ["pattern", "toxic"])
        release()

    counts: dict = defaultdict(lambda: [0, 0])
    # One row per pattern and label.
    for r in sample.mapInArrow(patterns, "pattern string, toxic int").groupBy("pattern", "toxic").count().collect():
        counts[r.pattern][r.toxic] += r["count"]
    arcs = {}
    for pattern, weight in Composed().priors.items():
        clean, toxic = counts.get(pattern, (0, 0))
        arcs[pattern] = (toxic + PRIOR_DOCS * weight) / (toxic + clean + PRIOR_DOCS)
    clean, toxic = counts.get("-", (0, 0))
    drop_path(docs.sparkSession, sample_at)
    return Grammar(insults, arcs, min(0.3, (toxic + 0.02) / (toxic + clean + 1)))


def score_toxicity(docs: DataFrame, grammar: Grammar, text_col: str = "text", threshold: float = THRESHOLD, prefix: str = "") -> DataFrame:
    """docs with score (0 to 1), predicted (1 from the threshold on) and n_matches, by whole texts alone.

    The transducers for insults, threats, targets, negation and reported speech run composed over each clause that has a
    term of the lexicon; a text's score is the noisy-or of its matches' weights. One pass, no shuffle.

    Null and empty texts score the floor, long ones are read to their end; equal texts have equal scores, whatever their
    ids, so that repeated rows and ties need no rule. An empty table gives no rows; a column of docs named as an added one
    gives way.
    """
    insults, arcs, floor = grammar.insults, grammar.arcs, grammar.floor
    threats = {t: 0.9 for t in THREATS}

    def make_worker():
        lexicon, composed = Lexicon(insults, threats), Composed()

        def worker(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [text_matches(t.as_py(), lexicon, composed) for t in batch.column(0)]
            scores = [score(m, arcs, floor) for m in found]
            return [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array([len(m) for m in found], pa.int64())]

        return worker

    return annotate(docs, [text_col], make_worker, prefixed(ADDED, prefix))


def without_toxic(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """The documents that the grammar, fitted on labels, doesn't call toxic, with their own columns.

    Null and empty texts stay, as do repeated rows of clean texts; rows without an id are judged as all others. An empty
    table stays empty, and without labels the grammar's own weights decide.
    """
    grammar = fit(docs if corpus is None else corpus, labels)
    judged = score_toxicity(docs, grammar, prefix="__verdict_")
    return judged.where(F.col("__verdict_predicted") == 0).select(*(F.col(f"`{c}`") for c in docs.columns))
