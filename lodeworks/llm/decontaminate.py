"""Benchmark decontamination with suffix arrays over shards of the training text."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.llm.common import LEXICAL, annotate, drop_path, partitions, positional, prefixed, release, staged

WINDOW = 13
#: Benchmark text is cut into blocks of about so many bytes. So many blocks are broadcast for one pass over the documents;
#: a worker holds one of them at a time.
BLOCK_BYTES, PASS_BLOCKS = 8_000_000, 8
#: Words of a longer item that stand together; what follows repeats a window's words but one.
ITEM_WORDS = 500_000
#: Words of a shard whose suffixes are sorted at once; a longer document is a shard of its own.
SHARD_WORDS = 1_000_000
ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("longest_match", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.LongType())),
    ]
)


def lexical_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LEXICAL).split()


class Items:
    """The suffixes of a block of benchmark items, as far as windows go, ready for binary search."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary, self.names = window, {}, []
        ids, starts, lengths, item, at = [], [], [], [], 0
        for name, words in items:
            if not words:
                continue
            ids += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            ids.append(0)
            length = min(window, len(words))
            n = len(words) - length + 1
            starts.append(np.arange(at, at + n, dtype=np.int64))
            lengths.append(np.full(n, length, np.int32))
            item.append(np.full(n, len(self.names), np.int32))
            at += len(words) + 1
            self.names.append(name)
        none = np.empty(0, np.int64)
        place, length, item = (np.concatenate([none, *x]).astype(np.int64) for x in (starts, lengths, item))
        keys = _keys(np.array(ids, np.int64), place, window)
        order = np.argsort(keys, kind="stable")
        keys, self.item, self.place = keys[order], item[order].astype(np.int32), place[order].astype(np.int32)
        self.first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else none
        self.count = np.diff(np.concatenate([self.first, [len(keys)]]))
        self.length, self.low = length[order][self.first], keys[self.first]
        self.least = int(self.length.min()) if len(keys) else window

    @classmethod
    def load(cls, built: bytes) -> Items:
        """From the pickled fields, which need no class that workers can import."""
        out = cls.__new__(cls)
        vars(out).update(pickle.loads(built))
        return out

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start positions in ids (0: word outside the vocabulary) and the number of the distinct window that occurs there.

        The suffix array holds the suffixes that can reach the shortest window: those with so many known words ahead.
        """
        n, width = len(ids), 4 * self.window
        ahead = np.zeros(n + 1, np.int64)
        known = ids > 0
        stops = np.flatnonzero(~known)
        nearest = np.searchsorted(stops, np.arange(n))
        ahead = np.where(nearest < len(stops), stops[np.minimum(nearest, max(len(stops) - 1, 0))] if len(stops) else n, n) - np.arange(n)
        starts = np.flatnonzero(ahead >= self.least)
        if not len(starts) or not len(self.low):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keys = _keys(ids, starts, self.window)
        array = np.argsort(keys, kind="stable")
        keys = keys[array]
        # A window of fewer words than its key has is the beginning of all keys up to the one that follows it at once.
        words = self.low.view(">u4").reshape(-1, self.window)
        high = np.ascontiguousarray(np.where(words == 0, np.array(0xFFFFFFFF, ">u4"), words).astype(">u4")).view(f"S{4 * self.window}").ravel()
        left, right = np.searchsorted(keys, self.low), np.searchsorted(keys, high, side="right")
        hits = right - left
        which = np.repeat(np.arange(len(hits)), hits)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(hits) - hits, hits)
        return starts[array[left[which] + inside]], which


def _keys(ids: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """The suffixes at some places as byte strings in their order: so many words, nothing behind the first unknown one."""
    padded = np.concatenate([ids, np.zeros(window, ids.dtype)]).astype(">u4")
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, window)[starts])
    rows[np.maximum.accumulate(rows == 0, axis=1)] = 0
    return rows.view(f"S{4 * window}").ravel()


#: What a block of the benchmark, or some of them, finds in a document.
FOUND = T.StructType([T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("names", T.ArrayType(T.StringType())), T.StructField("longest", T.LongType())])
FOUND_KINDS = (pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64())


def _scan(texts: list[str | None], blocks: Callable[[], Iterable[Items]]) -> list[tuple[int, list[int], list[str | None], int]]:
    """Of each document its words, the begins and ends of the covered stretches, the items found and the longest match.

    The documents' suffixes are sorted shard by shard.
    """
    out, i = [], 0
    while i < len(texts):
        words, ends = [], []
        while i < len(texts) and (not ends or len(words) < SHARD_WORDS):
            words += lexical_words(texts[i])
            words.append(b"")  # ends every match
            ends.append(len(words))
            i += 1
        ends = np.array(ends)
        begins = np.concatenate([[0], ends[:-1]])
        cover, names, longest = np.zeros(len(words) + 1, np.int64), [set() for _ in ends], np.zeros(len(ends), np.int64)
        for items in blocks():
            ids = np.fromiter(map(items.vocabulary.get, words, repeat(0)), np.int64, len(words))
            at, which = items.search(ids)
            if not len(at):
                continue
            np.add.at(cover, at, 1)
            np.add.at(cover, at + items.length[which], -1)
            doc = np.searchsorted(ends, at, side="right")
            for d, w in set(zip(doc.tolist(), which.tolist(), strict=True)):
                names[d].update(items.names[x] for x in items.item[items.first[w] : items.first[w] + items.count[w]].tolist())
            # A longer match is a run of windows that keep in step with the item.
            times = items.count[which]
            p = np.repeat(at, times)
            k = np.repeat(items.first[which], times) + np.arange(len(p)) - np.repeat(np.cumsum(times) - times, times)
            lag, size = items.place[k] - p, np.repeat(items.length[which], times)
            order = np.lexsort((p, lag))
            p, lag, size = p[order], lag[order], size[order]
            fresh = np.concatenate([[True], (np.diff(lag) != 0) | (np.diff(p) != 1)])
            head = np.flatnonzero(fresh)
            run = np.diff(np.concatenate([head, [len(p)]])) - 1 + size[head]
            np.maximum.at(longest, np.searchsorted(ends, p[head], side="right"), run)
        hit = (np.cumsum(cover)[:-1] > 0).astype(np.int8)
        for d, (b, e) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
            spans = np.flatnonzero(np.diff(np.concatenate([[0], hit[b : e - 1], [0]]))).tolist() if names[d] else []
            out.append((e - 1 - b, spans, list(names[d]), int(longest[d])))
    return out


def _verdict(n: int, spans: list[int], names: Iterable[str | None], longest: int) -> tuple:
    n_hit = sum(spans[1::2]) - sum(spans[::2])
    sha = hashlib.sha256(",".join(sorted(x for x in names if x is not None)).encode()).hexdigest()
    return n, n_hit, len(names), sha, n_hit > 0 and 20 * n_hit >= n, longest, spans


def _united(parts: list[list[int]]) -> list[int]:
    """The stretches that some lists of stretches cover together."""
    out: list[int] = []
    for b, e in sorted(pair for spans in parts for pair in zip(spans[::2], spans[1::2], strict=True)):
        if out and b <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [b, e]
    return out


def _pieces(window: int):
    """Items as stretches of words, so that a long one spreads over blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = lexical_words(text)
                rows += [(name, b" ".join(words[i : i + ITEM_WORDS])) for i in range(0, max(1, len(words) - window + 1), ITEM_WORDS - window + 1) if words]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.binary()))], ["item", "words"])

    return run


def _built(window: int):
    """Rows sorted by block; one row per block with its sorted suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True) for b in batches)
        for block, own in groupby(rows, key=lambda r: r[0]):
            built = pickle.dumps(vars(Items(((name, words.split()) for _, name, words in own), window)))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([built], pa.binary())], ["block", "built"])
        release()

    return run


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> tuple[DataFrame, int, str]:
    """The benchmark's blocks of sorted suffixes, made by tasks, as a staged table (block, built); their number; the path."""
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    pieces, pieces_at = staged(rows.mapInArrow(_pieces(window), "item string, words binary"), "items")
    n = 1 + (pieces.agg(F.sum(F.octet_length("words"))).first()[0] or 0) // BLOCK_BYTES
    parts = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(n))).select("block", "item", "words")
    parts = parts.repartition(int(min(n, partitions(benchmark.sparkSession))), "block").sortWithinPartitions("block")
    blocks, path = staged(parts.mapInArrow(_built(window), "block long, built binary"), "blocks")
    drop_path(benchmark.sparkSession, pieces_at)
    return blocks, n, path


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, prefix: str = "") -> DataFrame:
    """docs with the verdict columns of ADDED: how many of a document's words stand in a benchmark passage.

    Words are folded to lower case and lexical. A passage is a window of consecutive item words, or a whole shorter item.
    Each shard of the documents gets a suffix array over its words; every test suffix is looked up there by binary
    search, which finds all its occurrences. The benchmark's blocks are built by tasks and broadcast PASS_BLOCKS at a time:
    one pass over the documents without a shuffle if that is all of them, else one pass each, whose finds meet by the
    text's hash. hit_spans has the begins and ends (exclusive) of the covered word ranges by turns, longest_match the words
    of the longest verbatim match of a window or more (of a whole shorter item; within ITEM_WORDS of a longer item).

    Null and empty texts have no words and are clean; items without words match nothing, one without an id counts but
    isn't named; repeated documents or items change nothing in each other's verdicts; a text of any length is judged whole;
    empty tables give empty results, an empty benchmark leaves all clean. A column of docs named as one of ADDED gives way.
    """
    spark = docs.sparkSession
    blocks, n, path = item_blocks(benchmark, item_col, item_text_col, window)

    def load(first: int) -> list:
        """Broadcasts of the blocks of one pass."""
        numbers = [r.block for r in blocks.where((F.col("block") >= first) & (F.col("block") < first + PASS_BLOCKS)).select("block").collect()]
        return [spark.sparkContext.broadcast(blocks.where(F.col("block") == k).select("built").first()[0]) for k in numbers]

    def opener(sent: list) -> Callable[[], Iterable[Items]]:
        only = [Items.load(sent[0].value)] if len(sent) == 1 else None
        return lambda: only or (Items.load(b.value) for b in sent)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.int64())]
    columns = lambda rows, types: [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
    if n <= PASS_BLOCKS:
        sent = load(0)
        drop_path(spark, path)

        def make_worker():
            open_ = opener(sent)
            return lambda batch: columns([_verdict(*r) for r in _scan(batch.column(0).to_pylist(), open_)], kinds)

        return annotate(docs, [text_col], make_worker, prefixed(ADDED, prefix))

    rows = docs.select(F.md5(text_col).alias("key"), F.col(text_col).alias("text")).where("text is not null")
    found = []
    for first in range(0, n, PASS_BLOCKS):
        sent = load(first)

        def make_finder(sent=sent):
            open_ = opener(sent)
            return lambda batch: columns([r[1:] for r in _scan(batch.column(0).to_pylist(), open_)], FOUND_KINDS)

        own, _ = staged(annotate(rows, ["text"], make_finder, FOUND).where("size(names) > 0").drop("text").dropDuplicates(["key"]), "found")
        found.append(own)
        for b in sent:
            b.destroy()
    drop_path(spark, path)
    whole = found[0]
    for own in found[1:]:
        whole = whole.unionAll(own)
    # A document's finds: stretches and names, no more than its words allow.
    whole = whole.groupBy("key").agg(F.collect_list("spans").alias("spans"), F.collect_list("names").alias("names"), F.max("longest").alias("longest"))
    names = [*docs.columns, "__spans", "__names", "__longest"]
    wide = positional(docs).withColumn("__key", F.md5(f"c{[c.lower() for c in docs.columns].index(text_col.lower())}"))
    wide = wide.join(whole, F.col("__key") == F.col("key"), "left").select(*(f"c{i}" for i in range(len(docs.columns))), "spans", "names", "longest").toDF(*names)

    def make_judge():
        def judge(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
            return columns([_verdict(len(lexical_words(t)), _united(spans or []), set(chain.from_iterable(found or [])), longest or 0) for t, spans, found, longest in rows], kinds)

        return judge

    return annotate(wide, [text_col, "__spans", "__names", "__longest"], make_judge, prefixed(ADDED, prefix)).drop("__spans", "__names", "__longest")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that find_contamination leaves clean, with their own columns; odd input as there."""
    judged = find_contamination(docs, benchmark, prefix="__verdict_")
    return judged.where(~F.col("__verdict_contaminated")).select(*(F.col(f"`{c}`") for c in docs.columns))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS p FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM i))),
h AS (SELECT x.doc_id, p, x.n, item_id FROM x JOIN (SELECT DISTINCT item_id, n, s FROM i) AS t ON x.s = t.s AND x.n = t.n),
c AS (SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM (SELECT doc_id, p, unnest(generate_series(0, n - 1)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
