"""Substring dedup by super-k-mer partitioning over words."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.llm.common import annotate, drop_path, partitions, positional, release, staged

WINDOW = 13
#: Words of a minimiser.
MINIMISER = 3
#: Words a worker takes together, windows a bucket holds about, and bytes that are hashed at once. A window comes to a
#: bucket once a chunk at most; one with a common minimiser only once for SALT_CHUNKS chunks, as it is judged there first.
CHUNK_WORDS, BUCKET_WINDOWS, STRETCH, SALT_CHUNKS = 400_000, 250_000, 1_000_000, 256
#: A minimiser is common if it is at least this share of all minimisers, of which there are 1 / COMMON at most.
COMMON = 1 / 20_000
BASE = 0x9E3779B97F4A7C15 | 1
M64 = (1 << 64) - 1


def _powers(n: int, held: dict) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE modulo 2**64 and their inverses, at least n of either."""
    if len(held.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            held[name] = np.multiply.accumulate(steps)
    return held["up"], held["down"]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Text:
    """Words joined by one separator byte, with hashes of word ranges from running sums over stretches of the bytes."""

    def __init__(self, blob: bytes, held: dict):
        self.blob, self.held = blob, held
        raw = np.frombuffer(blob, np.uint8)
        gaps = np.flatnonzero((raw == 32) | (raw == 10))
        self.starts = np.concatenate([[0], gaps + 1])
        self.ends = np.concatenate([gaps, [len(blob)]])

    def hashes(self, first: np.ndarray, words: int) -> np.ndarray:
        """Of so many words from each first one on, in ascending order. A range's hash doesn't depend on its place."""
        s, e = self.starts[first], self.ends[first + words - 1]
        raw, out, i = np.frombuffer(self.blob, np.uint8), np.empty(len(first), np.uint64), 0
        while i < len(first):
            base = int(s[i])
            j = int(np.searchsorted(s, base + STRETCH))
            n = int(e[i:j].max()) - base
            up, down = _powers(n + 1, self.held)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((raw[base : base + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
            out[i:j] = (sums[e[i:j] - base] - sums[s[i:j] - base]) * down[s[i:j] - base]
            i = j
        return _mix(out)


def first_owners(text: Text, at: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For the windows at some word positions: whether an equal one has a smaller owner, and whether their own owner is
    the smallest. Equality is that of bytes; hashes only bring equals together."""
    h = text.hashes(at, window)
    order = np.lexsort((at, owner, h))
    hs, ow = h[order], owner[order]
    head = np.concatenate([[True], hs[1:] != hs[:-1]]) if len(hs) else np.empty(0, bool)
    heads = np.flatnonzero(head)
    group = np.cumsum(head) - 1
    lead = heads[group]
    again, first = ow > ow[lead], ow == ow[lead]
    # Check the bytes of all that share a hash with their group's first.
    more = np.flatnonzero(~head)
    s, e, blob = text.starts[at[order]], text.ends[at[order] + window - 1], text.blob
    odd = set()
    for k, a, b, c, d in zip(more.tolist(), s[more].tolist(), e[more].tolist(), s[lead[more]].tolist(), e[lead[more]].tolist(), strict=True):
        if blob[a:b] != blob[c:d]:
            odd.add(int(group[k]))
    for g in odd:  # different windows with one hash
        lo, hi = heads[g], heads[g + 1] if g + 1 < len(heads) else len(hs)
        seen: dict[bytes, int] = {}
        for k in range(lo, hi):
            key = blob[s[k] : e[k]]
            again[k] = ow[k] > seen.setdefault(key, ow[k])
            first[k] = not again[k]
    dup, lone = np.empty(len(at), bool), np.empty(len(at), bool)
    dup[order], lone[order] = again, first
    return dup, lone


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], np.ndarray, bytes]]:
    """Some documents at a time: ids, text checksums, bounds in words, and all words joined."""
    ids, sums, sizes, blobs = [], [], [], []
    total = 0
    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1), strict=True):
            raw = (t.as_py() or "").encode()
            words = raw.split()
            if i.is_valid and len(words) >= WINDOW:
                ids.append(i.as_py())
                sums.append(zlib.crc32(raw))
                sizes.append(len(words))
                blobs.append(b" ".join(words))
                total += len(words)
            if total >= CHUNK_WORDS:
                yield ids, sums, np.cumsum([0, *sizes]), b" ".join(blobs)
                ids, sums, sizes, blobs, total = [], [], [], [], 0
    if ids:
        yield ids, sums, np.cumsum([0, *sizes]), b" ".join(blobs)


def _windows(bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions where a window starts, and the document of each."""
    n = np.diff(bounds) - window + 1
    doc = np.repeat(np.arange(len(n)), n)
    return np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + bounds[:-1][doc], doc


def _flag_runs(at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and lengths of runs of consecutive positions of one document."""
    begin = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(doc) != 0)]) if len(at) else np.empty(0, bool)
    heads = np.flatnonzero(begin)
    return heads, np.diff(np.concatenate([heads, [len(at)]]))


def _count_minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    for _, _, bounds, blob in _chunks(batches):
        text = Text(blob, held)
        h = text.hashes(np.arange(len(text.starts) - MINIMISER + 1), MINIMISER) & np.uint64((1 << 63) - 1)
        keys, n = np.unique(h, return_counts=True)
        often = n >= max(2, COMMON * len(h) / 2)
        keys, n = np.concatenate([keys[often], [np.uint64(0)]]), np.concatenate([n[often], [len(h)]])
        kind = np.concatenate([np.zeros(int(often.sum()), np.int32), [1]])
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], ["kind", "key", "n"])
    release()


class Buckets:
    """Where super-k-mers go. Those of common minimisers have buckets of their own, behind the others, and salts by chunk."""

    def __init__(self, number: int, common: np.ndarray, salts: int, window: int):
        self.number, self.common, self.salts, self.window = number, common, salts, window
        self.hot = max(1, min(number, len(common)))

    def pack(self, text: Text, at: np.ndarray, doc: np.ndarray, owner: np.ndarray, check: np.ndarray, begin: np.ndarray, salt: int) -> Iterator[tuple[int, int, int, bytes]]:
        """Rows (bucket, salt, number of windows, packed) of the windows at some word positions of a text.

        doc numbers each window's stretch of words, which has an owner, a checksum, and begins at a word of it.
        """
        packer = zstandard.ZstdCompressor(level=3)
        gram = text.hashes(np.arange(len(text.starts) - MINIMISER + 1), MINIMISER) & np.uint64((1 << 63) - 1)
        if len(self.common):  # common minimisers come last, so that no bucket gathers all that stands beside one
            spot = np.minimum(np.searchsorted(self.common, gram), len(self.common) - 1)
            gram = np.where(self.common[spot] == gram, gram | np.uint64(1 << 63), gram)
        span = self.window - MINIMISER + 1
        least = at + np.lib.stride_tricks.sliding_window_view(gram, span)[at].argmin(axis=1)
        new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(doc) != 0) | (np.diff(least) != 0)])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.concatenate([heads, [len(at)]]))
        first, own, key = at[heads], doc[heads], gram[least[heads]]
        hot = key >= np.uint64(1 << 63)
        mixed = _mix(key)
        bucket = np.where(hot, np.uint64(self.number) + mixed % np.uint64(self.hot), mixed % np.uint64(self.number)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first, own, sizes, bucket, hot = first[order], own[order], sizes[order], bucket[order], hot[order]
        s, e = text.starts[first].tolist(), text.ends[first + sizes + self.window - 2].tolist()
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0, [True]])).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            meta = np.concatenate([[b - a], owner[own[a:b]], check[own[a:b]], begin[own[a:b]] + first[a:b], sizes[a:b]]).astype("<i8").tobytes()
            yield int(bucket[a]), salt if hot[a] else 0, int(sizes[a:b].sum()), packer.compress(meta + b"\n".join([text.blob[x:y] for x, y in zip(s[a:b], e[a:b], strict=True)]))


ROWS, NAMES = "bucket long, salt int, n long, packed binary", ["bucket", "salt", "n", "packed"]
KINDS = (pa.int64(), pa.int32(), pa.int64(), pa.binary())


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    some = []
    for r in rows:
        some.append(r)
        if len(some) == 500:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), KINDS, strict=True)], NAMES)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), KINDS, strict=True)], NAMES)


def _super_kmers(buckets: Buckets):
    """Map side. Rows: bucket and packed super-k-mers, or (bucket < 0) a chunk's own finds."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: dict = {}
        for ids, sums, bounds, blob in _chunks(batches):
            text = Text(blob, held)
            at, doc = _windows(bounds, buckets.window)
            owner, check = np.array(ids, np.int64), np.array(sums, np.int64)
            dup, first = first_owners(text, at, owner[doc], buckets.window)
            heads, sizes = _flag_runs(at[dup], doc[dup])
            own = doc[dup][heads]
            salt = zlib.crc32(np.array([ids[0], sums[0]], "<i8").tobytes())
            if len(heads):
                yield -1 - salt, 0, 0, zstandard.compress(b"".join(x.astype("<i8").tobytes() for x in (owner[own], check[own], at[dup][heads] - bounds[own], sizes)))
            # Of a chunk's equal windows, those of the smallest owner alone travel.
            if first.any():
                yield from buckets.pack(text, at[first], doc[first], owner, check, -bounds[:-1], salt % buckets.salts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(chunks(batches))
        release()

    return run


def _judge(packed: list[bytes], window: int, held: dict) -> tuple[tuple[np.ndarray, ...], tuple]:
    """Owners, checksums, begins and lengths of the runs of a bucket's windows that a smaller owner has too; and the
    windows of the smallest owners, as Buckets.pack takes them."""
    metas, texts = [], []
    for p in packed:
        raw = zstandard.decompress(p)
        n = int.from_bytes(raw[:8], "little")
        metas.append(np.frombuffer(raw, "<i8", 4 * n, 8).reshape(4, n))
        texts.append(raw[8 + 32 * n :])
    owner, check, begin, size = np.concatenate(metas, axis=1)
    text = Text(b"\n".join(texts), held)
    words = size + window - 1
    offset = np.cumsum(words) - words
    which = np.repeat(np.arange(len(size)), size)
    step = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    dup, first = first_owners(text, offset[which] + step, owner[which], window)
    heads, sizes = _flag_runs(step[dup], which[dup])
    of = which[dup][heads]
    return (owner[of], check[of], begin[of] + step[dup][heads], sizes), (text, (offset[which] + step)[first], which[first], owner, check, begin - offset)


def _judge_rows(buckets: Buckets, again: bool):
    """Reduce side: rows sorted by bucket and salt. Runs (kind 0), and what of hot buckets is to be judged again (kind 1)."""
    names = ["kind", "id", "checksum", "begin", "length", *NAMES]
    types = (pa.int32(), *(pa.int64(),) * 4, *KINDS)

    def runs(found) -> pa.RecordBatch:
        n = len(found[0])
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), *(pa.array(np.ascontiguousarray(x)) for x in found), *(pa.nulls(n, k) for k in KINDS)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def done(key: tuple, packed: list[bytes]) -> Iterator[pa.RecordBatch]:
            found, left = _judge(packed, buckets.window, held)
            if len(found[0]):
                yield runs(found)
            if again and key[0] >= buckets.number:
                for part in _batches(buckets.pack(*left, 0)):
                    yield pa.RecordBatch.from_arrays([pa.array([1] * len(part), pa.int32()), *(pa.nulls(len(part), k) for k in types[1:5]), *part.columns], names)

        now, packed = None, []
        for batch in batches:
            for bucket, salt, p in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if bucket < 0:
                    yield runs(np.frombuffer(zstandard.decompress(p), "<i8").reshape(4, -1))
                    continue
                if (bucket, salt) != now and packed:
                    yield from done(now, packed)
                    packed = []
                now = (bucket, salt)
                packed.append(p)
        if packed:
            yield from done(now, packed)
        release()

    return run


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, list[str]]:
    """Runs (id, checksum, begin, length) of windows that also start in a document with a smaller id; and where they are staged."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counted, counted_at = staged(rows.mapInArrow(_count_minimisers, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "minimisers")
    words = (counted.where("kind = 1").agg(F.sum("n")).first()[0]) or 0
    # No more than 1 / COMMON keys can have that share.
    often = counted.where((F.col("kind") == 0) & (F.col("n") >= COMMON * words)).select("key").collect()
    common = np.sort(np.array([r.key for r in often], np.int64).view(np.uint64))
    drop_path(spark, counted_at)
    parts = partitions(spark)
    buckets = Buckets(int(max(parts, 1 + words // BUCKET_WINDOWS)), common, int(1 + words // (CHUNK_WORDS * SALT_CHUNKS)), window)
    out = f"kind int, id long, checksum long, begin long, length long, {ROWS}"

    def judged(sent: DataFrame, again: bool) -> DataFrame:
        # Buckets go to partitions in turn, so that each partition has as many.
        part = F.pmod(F.when(F.col("bucket") < 0, F.col("bucket")).otherwise(F.col("bucket") + F.col("salt") * 7919), F.lit(parts)).cast("int")
        return sent.repartitionById(parts, part).sortWithinPartitions("bucket", "salt").mapInArrow(_judge_rows(buckets, again), out)

    found, path = staged(judged(rows.mapInArrow(_super_kmers(buckets), ROWS), buckets.salts > 1), "repeats")
    paths, runs = [path], found.where("kind = 0")
    if buckets.salts > 1:
        found, path = staged(judged(found.where("kind = 1").select(*NAMES), False), "repeats")
        paths, runs = [*paths, path], runs.unionAll(found)
    return runs.select("id", "checksum", "begin", "length"), paths


ADDED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 and kept_text: each word that a repeated window covers is removed.

    A window is so many consecutive white-space words; it is repeated if the same words also start in a document with a
    smaller id, in the input as it is. Consecutive windows with one minimiser (the least-hashed three words in them,
    common ones last) travel as one packed string to the minimiser's bucket; there, sorting brings equal windows together
    and their bytes are compared. Chunks keep only the first of equal windows before the shuffle and judge the others
    themselves, and buckets of common minimisers are judged by salts of chunks first and then once more, so that a window
    in a third of all documents is nowhere gathered as often as it occurs.

    Null and empty texts have no words; a null id neither loses words nor takes them from others; rows with one id don't
    take words from each other. An empty table gives no rows. A column of docs named as one of the added gives way.
    """
    runs, _ = repeated_windows(docs, id_col, text_col, window)
    # A document's runs are no more than its words.
    flags = runs.groupBy(F.col("id").alias("__id"), F.col("checksum").alias("__sum")).agg(F.collect_list(F.struct("begin", "length")).alias("__runs"))
    at = [c.lower() for c in docs.columns]
    i, t = f"c{at.index(id_col.lower())}", f"c{at.index(text_col.lower())}"
    body = F.coalesce(F.col(t), F.lit("")).cast("binary")
    marked = positional(docs).withColumn("__crc", F.crc32(body)).join(flags, (F.col(i) == F.col("__id")) & (F.col("__crc") == F.col("__sum")), "left")
    marked = marked.select(*(f"c{k}" for k in range(len(at))), F.col("__runs.begin"), F.col("__runs.length")).toDF(*docs.columns, "__begin", "__length")

    def make_worker():
        def worker(batch: pa.RecordBatch) -> list[pa.Array]:
            out = []
            for t, begin, length in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                words, begin = (t.as_py() or "").encode().split(), begin.as_py()
                if begin:
                    steps = np.zeros(len(words) + 1, np.int64)
                    np.add.at(steps, begin, 1)
                    np.add.at(steps, np.array(begin) + np.array(length.as_py()) + window - 1, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(steps)[:-1] == 0).tolist()]
                else:
                    kept = words
                text = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode() if with_text else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            return [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]

        return worker

    done = annotate(marked, [text_col, "__begin", "__length"], make_worker, ADDED).drop("__begin", "__length")
    return done if with_text else done.drop("kept_text")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS p FROM d)),
m AS (SELECT s, min(doc_id) AS first FROM x GROUP BY s),
r AS (SELECT DISTINCT doc_id, p + k AS i FROM (SELECT x.doc_id, p, unnest(generate_series(0, 12)) AS k FROM x JOIN m USING (s) WHERE x.doc_id > m.first)),
e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM e ANTI JOIN r USING (doc_id, i) GROUP BY e.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
