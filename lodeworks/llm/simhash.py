"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import drop_path, partitions, positional, release, staged
from lodeworks.llm.graph import components, forest, spread

RADIUS = 3
#: Each part of the 64 bits is left out once: 3 differing bits always have one in some part, and 2 remain elsewhere.
FREE = ((0, 22), (22, 43), (43, 64))


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64 majority bits over the XXH64 hashes of a text's word shingles; 0 without words. Unsigned."""
    joined = b" ".join((text or "").encode().lower().split())
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    n = len(gaps) + 1
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    starts, ends = [0, *(gaps[: n - shingle] + 1).tolist()], [*gaps[shingle - 1 :].tolist(), len(joined)]
    digest, total, m = xxhash.xxh64_intdigest, np.zeros(64, np.int64), n - shingle + 1
    for i in range(0, m, 8192):
        h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[i : i + 8192], ends[i : i + 8192], strict=True)], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > m, bitorder="little").tobytes(), "little")


def _print_rows(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints.view(np.int64))], ["id", "sum", "print"])
        release()

    return run


def variants(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and prints: for each free part, the print without it and every print that differs from that in one other bit."""
    keys = []
    for low, high in FREE:
        mask = np.uint64(~(((1 << high) - 1) ^ ((1 << low) - 1)) & (2**64 - 1))
        flips = np.array([0, *(1 << i for i in range(64) if not low <= i < high)], dtype=np.uint64)
        # Keys of different parts rarely meet by chance; if they do, the check of the pair rejects it.
        keys.append(((prints & mask)[:, None] ^ flips[None, :]).ravel() ^ np.uint64((low * 0x9E3779B97F4A7C15) & (2**64 - 1)))
    return np.concatenate(keys), np.concatenate([np.repeat(prints, 65 - (high - low)) for low, high in FREE])


def _variant_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(prints), 4096):
            k, p = variants(prints[i : i + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(p.view(np.int64))], ["key", "print"])


#: Prints of a bucket that are all compared; more are dealt by 16-bit quarters first.
BUCKET = 2048


def _close(prints: np.ndarray, labels: np.ndarray, spots: np.ndarray, radius: int) -> np.ndarray:
    """labels after all pairs of the prints at some spots are compared, strip by strip."""
    some = prints[spots]
    for i in range(0, len(some), 256):
        a, b = np.nonzero(np.bitwise_count(some[i : i + 256, None] ^ some[None, i:]) <= radius)
        labels = spread(labels, spots[a + i], spots[b + i])
    return labels


def bucket_links(prints: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Star links of one bucket's distinct prints: pairs are compared, and only a forest of those within the radius leaves.

    In a large bucket, prints are compared where one of their four 16-bit quarters agrees, as it does within three bits.
    """
    labels = np.arange(len(prints))
    if len(prints) <= BUCKET or radius > 3:
        labels = _close(prints, labels, labels.copy(), radius)
    else:
        for k in range(4):
            quarter = (prints >> np.uint64(16 * k)) & np.uint64(0xFFFF)
            order = np.argsort(quarter, kind="stable")
            for spots in np.split(order, np.flatnonzero(np.diff(quarter[order])) + 1):
                if len(spots) > 1:
                    labels = _close(prints, labels, spots, radius)
    far = np.flatnonzero(labels != np.arange(len(prints)))
    return list(zip(prints[far].view(np.int64).tolist(), prints[labels[far]].view(np.int64).tolist(), strict=True))


def _link_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a bucket that isn't complete at a batch's end waits for its next batches."""

    def links(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.diff(keys)) + 1
        starts, sizes = np.concatenate([[0], cut]), np.diff(np.concatenate([[0], cut, [len(keys)]]))
        two = starts[sizes == 2]
        two = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= RADIUS]
        pairs = list(zip(prints[two].view(np.int64).tolist(), prints[two + 1].view(np.int64).tolist(), strict=True))
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            pairs += bucket_links(prints[s : s + n])
        pairs = forest(set(pairs))
        a, b = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, prints = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        whole = int(np.searchsorted(keys, keys[-1]))
        if whole or (waiting and waiting[0][0][0] != keys[0]):
            done = [*waiting, (keys[:whole], prints[:whole])]
            yield links(*map(np.concatenate, zip(*done, strict=True)))
            waiting = []
        waiting.append((keys[whole:], prints[whole:]))
    if waiting:
        yield links(*map(np.concatenate, zip(*waiting, strict=True)))
    release()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable over links).

    Equal fingerprints collapse first. Each distinct one emits, for three choices of about 21 bits to leave out, all
    variants of the rest within one bit: half of the two bits that can still differ there when three differ in all, as
    one of the three lies in some left-out part. (Half of three isn't whole: balls of one and two bits over all 64 would
    take 2,146 variants against 131.) Variants are shuffled, each bucket's pairs are verified, and only a spanning forest
    of its links leaves it; components then follow. Exact: no pair within three bits is lost.

    Null or empty texts, and texts of white space, have fingerprint zero and link like any other. A null id gets its
    component from its group's other ids, or null. Repeated rows give repeated rows; an empty table gives none; columns
    other than the two named are ignored.
    """
    found = grouped(docs, id_col, text_col, shingle, seed)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, sum, print, component_id), sum a hash of the text that tells rows of one id, or without one, apart."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("sum"))
    prints, _ = staged(rows.mapInArrow(_print_rows(shingle, seed), f"id {kind}, sum long, print long"), "prints")
    distinct = prints.groupBy("print").agg(F.min("id").alias("first"))
    # Each print becomes 131 rows: they are dealt out anew, as adaptive execution sees few bytes and would merge them.
    balls = distinct.select("print").repartition(partitions(spark)).mapInArrow(_variant_rows, "key long, print long")
    dealt = balls.repartition(partitions(spark), "key").sortWithinPartitions("key")
    links, links_at = staged(dealt.mapInArrow(_link_rows, "a long, b long").distinct(), "links")
    stars, stars_at = components(links)
    drop_path(spark, links_at)
    member = distinct.join(stars.withColumnRenamed("a", "print"), "print", "left").select("print", "first", F.coalesce("b", "print").alias("root"))
    roots = member.groupBy("root").agg(F.min("first").alias("component_id"))
    member, member_at = staged(member.join(roots, "root").select(F.col("print").alias("p"), "component_id"), "members")
    drop_path(spark, stars_at)
    return prints.join(member, F.col("print") == F.col("p"), "left").select("id", "sum", "print", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near copies: of each component the row with the smallest id stays, with all its columns.

    Rows that repeat the kept id in its component all stay: nothing tells them apart. Rows with null ids stay if their
    component has no other id. Null and empty texts form one component. An empty table stays empty; other columns pass
    unchanged.
    """
    groups = grouped(docs, id_col, text_col).where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("__id"), F.col("sum").alias("__sum")).distinct()
    groups, _ = staged(groups, "kept")
    rows, at = positional(docs), [c.lower() for c in docs.columns]
    same = F.col(f"c{at.index(id_col.lower())}").eqNullSafe(F.col("__id")) & (F.xxhash64(f"c{at.index(text_col.lower())}") == F.col("__sum"))
    return rows.join(groups, same, "left_semi").toDF(*docs.columns)
