"""URL filters: rules, and a block list as a sorted array of digests that tasks map into memory."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.llm.common import annotate, drop_at_exit, drop_path, positional, release, shared_dir, staged


class Rule(NamedTuple):
    """A verdict for a host, its subdomains, and paths that begin with the rule's."""

    verdict: str
    host: str
    path: str


RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]
#: Words of host names that nobody wants in training data: adult, gambling, drugs, spam, advertising.
UNWANTED = "adult porn sex xxx casino poker bet bets gambling pill pills viagra pharmacy spam warez ads adserver track tracker".split()
#: A list up to so many bytes is mapped by each executor; a larger one is joined. About as many bytes go into one segment.
MAPPED_BYTES, SEGMENT_BYTES = 512_000_000, 8_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From behind the first :// to the next /, ? or # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct of rule and verdict; null if none does. The first of equally long ones."""
    fits = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: -len(r.host + r.path))[::-1]:
        inside = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        fits = F.when(inside, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(fits)
    return fits


def unwanted_hosts(pages: DataFrame, url_col: str = "url", words: list[str] | None = None) -> DataFrame:
    """(entry) block list of the hosts in a table that have an unwanted word in a label, from that label on.

    A word is what stands between the dots, hyphens and underscores of a host.
    """
    labels = F.split("host", r"\.")
    hosts = pages.select(host_of(F.col(url_col)).alias("host")).distinct().select(labels.alias("labels"))
    unwanted = F.array(*(F.lit(w) for w in (UNWANTED if words is None else words)))
    # One entry for each label with such a word, as its domain covers all that is in front of it.
    ends = F.transform("labels", lambda label, i: F.when(F.arrays_overlap(F.split(label, "[-_]"), unwanted), F.array_join(F.slice("labels", i + 1, F.size("labels")), ".")))
    return hosts.select(F.explode(F.filter(ends, lambda e: e.isNotNull())).alias("entry")).distinct()


def _segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition of entries in the order of their digests, as arrays: digests, ends of the texts, texts."""
    rows, size, number = [], 0, 0

    def done() -> pa.RecordBatch:
        keys = np.array([k for k, _ in rows], "<i8")
        ends = np.cumsum([len(t) for _, t in rows]).astype("<i8")
        place = [pa.array([n], pa.int32()) for n in (TaskContext.get().partitionId(), number)]
        return pa.RecordBatch.from_arrays([*place, *(pa.array([b], pa.binary()) for b in (keys.tobytes(), ends.tobytes(), b"".join(t for _, t in rows)))], ["part", "number", "keys", "ends", "texts"])

    for batch in batches:
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows.append((k, t))
            size += 16 + len(t)
            if size >= SEGMENT_BYTES:
                yield done()
                rows, size, number = [], 0, number + 1
    if rows:
        yield done()
    release()


def _ordered(digest: Column) -> Column:
    """A digest whose order as a signed number is that of its unsigned bits."""
    return digest.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


class BlockList:
    """A block list as a written table: digest, entry; and its measures.

    An entry without a slash is a host and covers its subdomains; one with a slash is a host with a path, and covers just
    that. Hosts are lower-cased as URLs' hosts are; empty and null entries cover nothing.
    """

    def __init__(self, entries: DataFrame, column: str = "entry"):
        e = F.col(column)
        host = F.translate(F.regexp_extract(e, "^[^/]*", 0), UPPER, LOWER)
        made = entries.where((e != "") & e.isNotNull()).select(F.concat(host, F.regexp_extract(e, "^[^/]*(.*)", 1)).alias("entry")).distinct()
        self.table, self.path = staged(made.withColumn("digest", F.xxhash64("entry")), "block-list")
        host_only = ~F.contains("entry", F.lit("/"))
        got = self.table.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("entry")), F.lit(0)), F.coalesce(F.max(F.when(host_only, F.size(F.split("entry", r"\.")))), F.lit(0)), F.coalesce(F.max(F.when(~host_only, F.lit(1))), F.lit(0))).first()
        self.count, self.bytes, self.labels, self.paths = got[0], got[1] + 16 * got[0], got[2], bool(got[3])

    def keys(self, host: Column, path: Column) -> Column:
        """The entries that would cover a URL: its host's last labels, as many as any entry has, and host with path."""
        most = F.least(F.size(F.split(host, r"\.")), F.lit(self.labels))
        ends = F.when(most > 0, F.transform(F.sequence(F.lit(1), most), lambda k: F.call_function("substring_index", host, F.lit("."), -k))).otherwise(F.array().cast("array<string>"))
        return F.concat(ends, F.array(F.concat(host, path))) if self.paths else ends

    def send(self, spark: SparkSession) -> str:
        """Writes the sorted arrays as one file in the shared folder, for executors to fetch; the name they know it by.

        Tasks sort and pack the segments; the driver holds one of them at a time.
        """
        parts = 1 + self.bytes // SEGMENT_BYTES
        ordered = self.table.select("digest", F.col("entry").cast("binary").alias("entry"), _ordered(F.col("digest")).alias("place"))
        ordered = ordered.repartitionByRange(parts, "place").sortWithinPartitions("place", "entry").select("digest", "entry")
        segments, at = staged(ordered.mapInArrow(_segment, "part int, number int, keys binary, ends binary, texts binary"), "segments")
        name = f"block-list-{uuid.uuid4().hex}"
        where = f"{shared_dir(spark)}/{name}"
        drop_at_exit(spark, where)
        sc = spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(where)
        out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write(bytearray(np.array([self.count], "<i8").tobytes()))
            before = 0
            for column in ("keys", "ends", "texts"):
                for r in segments.orderBy("part", "number").select("ends", column).toLocalIterator():
                    raw = bytes(r[column])
                    if column == "ends":
                        ends = np.frombuffer(raw, "<i8") + before
                        before, raw = int(ends[-1]), ends.tobytes()
                    for i in range(0, len(raw), 1 << 20):
                        out.write(bytearray(raw[i : i + (1 << 20)]))
        finally:
            out.close()
        sc.addFile(where)
        drop_path(spark, at)
        return name


class DigestArray:
    """The file of a block list, mapped into memory: pages of it are shared by an executor's workers and read as needed."""

    def __init__(self, file: str):
        raw = np.memmap(file, np.uint8, "r")
        n = int(raw[:8].view("<i8")[0])
        self.keys, self.ends, self.texts = raw[8 : 8 + 8 * n].view("<u8"), raw[8 + 8 * n : 8 + 16 * n].view("<i8"), raw[8 + 16 * n :]

    def entry(self, i: int) -> bytes:
        return self.texts[(int(self.ends[i - 1]) if i else 0) : int(self.ends[i])].tobytes()

    def candidates(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each digest's run of equal keys begins and ends, by binary search."""
        return np.searchsorted(self.keys, digests, "left"), np.searchsorted(self.keys, digests, "right")

    def has(self, text: bytes, begin: int, end: int) -> bool:
        """Whether one of a run's stored texts is this one; different texts may share a digest."""
        return any(self.entry(i) == text for i in range(begin, end))


def _prober(name: str):
    def make_worker():
        held = DigestArray(SparkFiles.get(name))

        def worker(batch: pa.RecordBatch) -> list[pa.Array]:
            digests, keys = batch.column(0), batch.column(1)
            begin, end = held.candidates(digests.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            row = np.repeat(np.arange(len(digests)), np.diff(digests.offsets.to_numpy()))
            listed: list[str | None] = [None] * len(digests)
            texts = keys.flatten()
            for i in np.flatnonzero(begin < end).tolist():  # the last is the longest
                text = texts[i].as_py()
                if held.has(text.encode(), int(begin[i]), int(end[i])):
                    listed[row[i]] = text
            return [pa.array(listed, pa.string())]

        return worker

    return make_worker


def _mapped(rows: DataFrame, blocked: BlockList) -> DataFrame:
    name = blocked.send(rows.sparkSession)
    probed = annotate(rows.withColumn("__digests", F.transform("__keys", lambda k: F.xxhash64(k))), ["__digests", "__keys"], _prober(name), T.StructType([T.StructField("__listed", T.StringType())]))
    return probed.drop("__digests")


def _joined(rows: DataFrame, blocked: BlockList) -> DataFrame:
    """The same by joins, for a list that executors aren't to hold: each different key meets the list once."""
    keys = rows.select(F.explode(F.array_distinct("__keys")).alias("key")).distinct()
    hits = keys.join(blocked.table, (F.xxhash64("key") == F.col("digest")) & (F.col("key") == F.col("entry"))).select("entry")
    hosts = rows.select("__keys").distinct()
    found = hosts.select("__keys", F.posexplode("__keys")).join(hits, F.col("col") == F.col("entry"))
    found = found.groupBy(F.col("__keys").alias("__of")).agg(F.max_by("entry", "pos").alias("__listed"))
    return rows.join(found, F.col("__keys") == F.col("__of"), "left").drop("__of")


ADDED = ["host", "path", "rule", "verdict", "listed"]


def filter_urls(pages: DataFrame, entries: DataFrame, url_col: str = "url", rules: list[Rule] | None = None, mapped_bytes: int = MAPPED_BYTES) -> DataFrame:
    """pages with host, path, rule, verdict (allow or block) and listed (the longest block-list entry that covers the URL).

    The longest rule that fits decides; where none does, a listed URL is blocked and any other allowed. The list is sorted
    by its 64-bit xxhash digests and written as one file; executors fetch it, tasks map it into memory, probe it for all
    keys of a batch by one binary search, and compare stored texts where digests are equal. A list of more than
    mapped_bytes is joined instead, with equal results.

    Null URLs and URLs without :// have an empty host and path and match neither rules nor list. Repeated rows each get
    their verdict. URLs and hosts of any length are judged whole. A column of pages named as an added one gives way; an
    empty table gives no rows, and an empty list blocks nothing.
    """
    rules = RULES if rules is None else rules
    blocked = BlockList(entries)
    names = {c.lower() for c in ADDED}
    kept = [i for i, c in enumerate(pages.columns) if c.lower() not in names]
    url = f"c{[c.lower() for c in pages.columns].index(url_col.lower())}"
    rows = positional(pages).withColumns({"__host": host_of(F.col(url)), "__path": path_of(F.col(url))})
    rows = rows.withColumn("__keys", F.when(F.col("__host") == "", F.array().cast("array<string>")).otherwise(blocked.keys(F.col("__host"), F.col("__path"))))
    rows = rows.select(*(f"c{i}" for i in kept), "__host", "__path", "__keys")
    rows = (_mapped if blocked.bytes <= mapped_bytes else _joined)(rows, blocked)
    fit = ruled(F.col("__host"), F.col("__path"), rules)
    rows = rows.withColumn("__fit", fit)
    verdict = F.coalesce(F.col("__fit.verdict"), F.when(F.col("__listed").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return rows.select(*(F.col(f"c{i}").alias(pages.columns[i]) for i in kept), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__fit.rule").alias("rule"), verdict.alias("verdict"), F.col("__listed").alias("listed"))


def _oracle() -> str:
    words = "|".join(UNWANTED)
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)
    return f"""
WITH u AS (SELECT page_id, row_number() OVER () AS row, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(verdict, host, path) AS (VALUES {rules}),
f AS (SELECT u.row, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.row)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host, '(^|[._-])({words})([._-]|$)') THEN 'block' ELSE 'allow' END) AS verdict FROM u LEFT JOIN f USING (row)
"""


ORACLE = _oracle()
