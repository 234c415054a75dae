"""Token-id output: canonical length-limited Huffman blocks with bit-offset checkpoints, decoded by table."""

from __future__ import annotations

import json
import os
import pickle
import re
import sys
import types
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.llm.common import drop_at_exit, drop_path, partitions, release, shared_dir, staged

#: A block ends with the document that brings it to so many ids; checkpoints stand at every STEP ids.
BLOCK_IDS, STEP = 65536, 128
#: Longest code in bits, if the vocabulary allows.
MAX_BITS = 18
END_ID = 1
#: Bytes of text that are encoded together, and bytes of pieces with ids that a worker remembers.
SLICE_BYTES, HELD_BYTES = 4_000_000, 20_000_000
#: In a text of these characters alone, the runs below are what the tokenizer's own splitting makes of its lower-case
#: form: no normal form changes, no contraction, no special token. Where no full stop or comma touches another sign, both
#: are runs of their own.
PLAIN = re.compile(r"[\t-\r !-&(-;=?-~À-ÖØ-öø-ÿ]*")
RUNS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
TOUCHING = re.compile(r"[.,](?:(?=[!-/:-@\[-`{-~])|(?<=[!-/:-@\[-`{-~].))")
#: The parts of a tokenizer file under which pieces between blanks are encoded apart from each other: white space is
#: dropped, case folded, and letters, single digits and runs of other signs are words.
PIECEWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "truncation": None,
    "padding": None,
}


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most max_bits for the ids with counts above 0 (package-merge); 0 for the others."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    max_bits = max(max_bits, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, items = [np.ones(len(leaves), bool)], leaves
    for _ in range(max_bits - 1):
        even = len(items) // 2 * 2
        merged = np.concatenate([leaves, items[0:even:2] + items[1:even:2]])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < len(leaves))
        items = merged[rank]
    take, depth = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id): the lengths alone give them back."""
    codes = np.zeros(len(lengths), np.uint64)
    code, last = 0, 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)).tolist():
        n = int(lengths[i])
        if n:
            code <<= n - last
            codes[i], last = code, n
            code += 1
    return codes


def encode(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, int]:
    """Payload of big-endian 32-bit words, the bit offsets of every STEP-th id, and the number of bits."""
    size = lengths[ids].astype(np.int64)
    at = np.cumsum(size) - size
    bits = int(at[-1] + size[-1]) if len(ids) else 0
    words = bits // 32 + 2
    placed = codes[ids] << (64 - size - (at & 31)).astype(np.uint64)
    # No two codes share a bit, so sums are unions; they stay below 2**32 and exact in a double.
    high = np.bincount(at >> 5, (placed >> np.uint64(32)).astype(np.float64), words)
    low = np.bincount((at >> 5) + 1, (placed & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    return (high + low).astype(">u4").tobytes(), at[::STEP].astype("<u4"), bits


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Id and code length by the next bits of the stream, as many as the longest code has."""
    width = max(1, int(lengths.max())) if len(lengths) else 1
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (width - lengths[order].astype(np.int64))
    ids, sizes = np.zeros(1 << width, np.uint32), np.ones(1 << width, np.uint8)
    n = int(spans.sum())
    ids[:n], sizes[:n] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return ids, sizes, width


def decode(blocks: list[tuple[bytes, np.ndarray, int]], table: tuple[np.ndarray, np.ndarray, int]) -> list[np.ndarray]:
    """The ids of some blocks (payload, checkpoints, number); all checkpoints' stretches are decoded side by side."""
    ids, sizes, width = table
    streams, ends, words = [], [], 0
    for payload, checkpoints, _ in blocks:
        streams.append(checkpoints.astype(np.int64) + 32 * words)
        words += len(payload) // 4
        ends.append(len(checkpoints))
    stored = np.frombuffer(b"".join(b[0] for b in blocks), ">u4").astype(np.uint64)
    pairs = (stored[:-1] << np.uint64(32)) | stored[1:]
    at = np.concatenate(streams)
    out, last, mask = np.empty((STEP, len(at)), np.uint32), len(pairs) - 1, (1 << width) - 1
    for k in range(STEP):
        seen = (pairs[np.minimum(at >> 5, last)] >> (64 - width - (at & 31)).astype(np.uint64)).astype(np.int64) & mask
        out[k] = ids[seen]
        at += sizes[seen]
    rows = np.split(out.T, np.cumsum(ends)[:-1])
    return [np.ascontiguousarray(r).ravel()[:n] for r, (_, _, n) in zip(rows, blocks, strict=True)]


def piecewise(spec: str) -> bool:
    """Whether a tokenizer file says that texts may be encoded piece by piece between blanks."""
    told = json.loads(spec)
    model = told["model"]
    plain = all(told.get(k) == v for k, v in PIECEWISE.items()) and model.get("type") == "BPE" and not model.get("dropout") and model.get("end_of_word_suffix") == "</w>" and not model.get("ignore_merges")
    return plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in told["added_tokens"])


def binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte strings that lie one behind the other and end at the given places."""
    offsets = np.concatenate([[0], ends]).astype("<i8")
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


class WholeTexts:
    """Ids of texts by the library alone, for tokenizers of any kind."""

    def __init__(self, spec: str, size: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.kind = Tokenizer.from_str(spec), f"<u{size}"

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn, and how many each text has."""
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.array([len(f) for f in found], np.int64)
        return np.fromiter(chain.from_iterable(found), self.kind, int(n.sum())), n


class Pieces(WholeTexts):
    """Ids of texts by those of their pieces, with the library meeting each piece once.

    A piecewise tokenizer drops white space and splits there, so that a text's ids are its pieces' ids in turn. Plain texts
    are lower-cased and parted before full stops and commas as well, since their pieces repeat more; such pieces fall into
    runs, and those of letters are encoded by the vocabulary's own model, without the normalisation that would leave them
    unchanged. Pieces and ids are held in flat arrays of HELD_BYTES at most; beyond, the pieces met least go.
    """

    def __init__(self, spec: str, size: int):
        super().__init__(spec, size)
        from tokenizers import Tokenizer

        self.bare = Tokenizer(self.library.model)
        vocabulary = self.bare.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte_chars = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in printable)}
        self.forget()

    def forget(self) -> None:
        self.held, self.flat, self.ends, self.met = pa.array([], pa.string()), np.empty(0, self.kind), np.empty(0, np.int64), np.empty(0, np.int64)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.array([bool(PLAIN.fullmatch(t)) and not TOUCHING.search(t) for t in texts], bool)
        easy = pa.array([t.lower().replace(".", " .").replace(",", " ,") for t, p in zip(texts, plain, strict=True) if p], pa.string())
        rest = pa.array([t for t, p in zip(texts, plain, strict=True) if not p], pa.string())
        lists = pa.concat_arrays([pc.ascii_split_whitespace(easy), pc.split_pattern_regex(rest, pattern="[ \t\n\r]+")])
        pieces = lists.flatten().dictionary_encode()
        spot = self._spots(pieces.dictionary)[pieces.indices.to_numpy()]
        sizes = np.diff(np.concatenate([[0], self.ends]))[spot]
        ids = self._gather(spot, sizes)
        upto = np.concatenate([[0], np.cumsum(sizes)])[lists.offsets.to_numpy()]
        order = np.argsort(np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)]), kind="stable")
        n = np.diff(upto)[order]
        if plain.all() or not plain.any():
            out = ids
        else:
            out = ids[np.repeat(upto[:-1][order] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        np.add.at(self.met, spot[: len(spot) // 8], 1)  # an eighth tells which pieces are frequent
        if self.held.nbytes + self.flat.nbytes + self.ends.nbytes * 2 > HELD_BYTES:
            self._thin()
        release()
        return out, n

    def _gather(self, spot: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids of the pieces held at some spots, in turn."""
        out, at = np.empty(int(sizes.sum()), self.kind), 0
        first = self.ends - np.diff(np.concatenate([[0], self.ends]))
        for i in range(0, len(spot), 200_000):
            n = sizes[i : i + 200_000]
            total = int(n.sum())
            out[at : at + total] = self.flat[np.repeat(first[spot[i : i + 200_000]] - (np.cumsum(n) - n), n) + np.arange(total)]
            at += total
        return out

    def _known(self, pieces: pa.Array) -> np.ndarray:
        """Where distinct pieces are held, -1 for those that aren't. The fewer pieces are hashed, the held ones pass by."""
        found = pc.index_in(self.held, value_set=pieces)
        at = np.flatnonzero(found.is_valid())
        out = np.full(len(pieces), -1, np.int64)
        out[found.drop_null().to_numpy()] = at
        return out

    def _spots(self, pieces: pa.Array) -> np.ndarray:
        """Where distinct pieces are held; those that aren't yet are encoded first."""
        spot = self._known(pieces)
        new = np.flatnonzero(spot < 0)
        if len(new):
            missing = pieces.take(pa.array(new)).to_pylist()
            made = self._learn(missing)
            spot[new] = [made[p] for p in missing]
        return spot

    def _hold(self, pieces: list[str], ids: np.ndarray, ends: np.ndarray) -> dict[str, int]:
        first = len(self.held)
        self.ends = np.concatenate([self.ends, ends + len(self.flat)])
        self.held = pa.concat_arrays([self.held, pa.array(pieces, pa.string())])
        self.flat = np.concatenate([self.flat, ids.astype(self.kind)])
        self.met = np.concatenate([self.met, np.zeros(len(pieces), np.int64)])
        return dict(zip(pieces, range(first, first + len(pieces)), strict=True))

    def _learn(self, pieces: list[str]) -> dict[str, int]:
        """Holds new pieces and the new runs of those that fall into some; where each of them is held."""
        words, mixed, others = {}, {}, {}
        for p in pieces:
            (words if LETTERS.fullmatch(p) else mixed if PLAIN.fullmatch(p) else others)[p] = None
        for p in mixed:
            mixed[p] = RUNS.findall(p.lower())
        runs = list(dict.fromkeys(chain.from_iterable(mixed.values())))
        held = dict(zip(runs, self._known(pa.array(runs, pa.string())).tolist(), strict=True))
        for r in runs:
            if held[r] < 0:
                (words if LETTERS.fullmatch(r) else others)[r] = None
        others |= dict.fromkeys(p for p, parts in mixed.items() if parts == [p])
        made = self._hold([*words], *self._words([*words]))
        found = [e.ids for e in self.library.encode_batch_fast([*others], add_special_tokens=False)]
        made |= self._hold([*others], np.fromiter(chain.from_iterable(found), self.kind), np.cumsum([len(f) for f in found], dtype=np.int64))
        rest = {p: parts for p, parts in mixed.items() if p not in others}
        spot = np.array([made[r] if r in made else held[r] for r in chain.from_iterable(rest.values())], np.int64)
        sizes = np.diff(np.concatenate([[0], self.ends]))[spot]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([len(parts) for parts in rest.values()], dtype=np.int64)]
        return made | self._hold([*rest], self._gather(spot, sizes), ends)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of letters, by the vocabulary's model, and their ends; a word's last token alone ends a word."""
        flat, ends, n = [np.empty(0, self.kind)], [np.empty(0, np.int64)], 0
        for i in range(0, len(words), 20_000):
            some = [w if w.isascii() else w.encode().decode("latin-1").translate(self.byte_chars) for w in words[i : i + 20_000]]
            ids = np.array(self.bare.encode_batch_fast([some], is_pretokenized=True, add_special_tokens=False)[0].ids, self.kind)
            stop = np.flatnonzero(self.last[ids]) + 1
            if len(stop) != len(some):  # the vocabulary lacks a sign
                found = [e.ids for e in self.bare.encode_batch_fast(some, add_special_tokens=False)]
                ids, stop = np.fromiter(chain.from_iterable(found), self.kind), np.cumsum([len(f) for f in found])
            flat.append(ids)
            ends.append(stop + n)
            n += len(ids)
        return np.concatenate(flat), np.concatenate(ends)

    def _thin(self) -> None:
        """Keeps the half of the pieces met most; older meetings count less."""
        keep = np.sort(np.argsort(-self.met, kind="stable")[: len(self.met) // 2])
        sizes = np.diff(np.concatenate([[0], self.ends]))[keep]
        flat = self._gather(keep, sizes)
        self.held, self.flat, self.ends, self.met = self.held.take(pa.array(keep)), flat, np.cumsum(sizes), self.met[keep] // 2


def encoder(spec: str, size: int) -> WholeTexts:
    """The encoder of a tokenizer file's text, with ids of size bytes: by pieces if the file allows it, else by whole texts.

    A worker keeps the last one over its tasks, under a module of its own: functions come to it by value, without theirs.
    """
    held = sys.modules.setdefault("_lodeworks_worker", types.ModuleType("_lodeworks_worker")).__dict__
    key = (spec, size)
    if held.get("encoder", (None,))[0] != key:
        held["encoder"] = key, (Pieces if piecewise(spec) else WholeTexts)(spec, size)
    return held["encoder"][1]


def slices(texts: pa.Array, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Begins and ends of stretches of about so many bytes; a longer text is one alone."""
    upto, i = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))]), 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + (most or SLICE_BYTES), side="right")) - 1)
        yield i, j
        i = j


def write_ids(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encodes every text, appends end_id, and writes the ids in the order of id to path.

    path/codebook has the code length of each id; path/blocks has rows (shard, block, n_docs, n_ids, n_bits, ids, sizes,
    checkpoints, payload): whole documents in order, each block decodable alone, from any checkpoint on. Shards are
    ranges of id, blocks count within a shard.

    Null texts encode as empty ones: the end id alone. Null ids come first; rows that repeat an id follow each other in
    the order of a hash of the text. An empty table writes an empty codebook and no blocks.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        spec = file.read()
    vocabulary = max(Tokenizer.from_str(spec).get_vocab_size(), end_id + 1)
    size = 2 if vocabulary <= 65536 else 4
    kind = f"<u{size}"
    told = spark.sparkContext.broadcast(spec)  # a few megabytes, so that no worker needs the file

    def tokenise(batches):
        """Documents with ids; a partition's last row has its counts instead, as pairs of id and number."""
        made, total, names = encoder(told.value, size), np.zeros(vocabulary, np.int64), ["id", "shard", "ids", "counts"]
        for batch in batches:
            for i, j in slices(batch.column(1)):
                ids, n = made.ids(batch.column(1).slice(i, j - i).to_pylist())
                ends = np.cumsum(n + 1)
                out = np.full(len(ids) + len(n), end_id, kind)
                own = np.ones(len(out), bool)
                own[ends - 1] = False
                out[own] = ids
                total += np.bincount(out, minlength=vocabulary)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), binary(out, ends * size), pa.nulls(j - i, pa.binary())], names)
        used = np.flatnonzero(total)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([np.stack([used, total[used]]).astype("<i8").tobytes()], pa.binary())], names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(partitions(spark), "id", "tie").sortWithinPartitions("id", "tie")
    rows = rows.select("id", "text", F.spark_partition_id().alias("shard"))
    # Ids are made once: counts and codes both read them from here.
    whole, whole_at = staged(rows.mapInArrow(tokenise, "id long, shard int, ids binary, counts binary").withColumn("place", F.monotonically_increasing_id()), "ids")
    told.destroy()

    def count(batches):
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                tokens, n = np.frombuffer(packed, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(n)], ["token", "n"])

    counts = np.zeros(vocabulary, np.int64)
    # One row per vocabulary entry at most.
    for r in whole.where("counts is not null").select("counts").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        counts[r.token] = r.n
    lengths = code_lengths(counts)
    book = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "token int, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    sent = spark.sparkContext.broadcast(cloudpickle.dumps((canonical_codes(lengths), lengths)))

    def blocks(batches):
        codes, sizes = pickle.loads(sent.value)
        held, shard, names = [], None, ["shard", "place", "n_docs", "n_ids", "n_bits", "ids", "sizes", "checkpoints", "payload"]

        def flush():
            ids = np.concatenate([np.frombuffer(x, kind) for _, _, x in held]).astype(np.int64)
            payload, checkpoints, bits = encode(ids, codes, sizes)
            docs_in = pa.array([i for i, _, _ in held], pa.int64())
            per = [len(x) // size for _, _, x in held]
            row = [[shard], [held[0][1]], [len(held)], [len(ids)], [bits], [docs_in.to_pylist()], [per], [checkpoints.tobytes()], [payload]]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names)

        n = 0
        for batch in batches:
            for i, s, place, x in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held and (s != shard or place != held[-1][1] + 1 or n >= BLOCK_IDS):
                    yield flush()
                    held, n = [], 0
                shard = s
                held.append((i, place, x))
                n += len(x) // size
        if held:
            yield flush()

    schema = "shard int, place long, n_docs int, n_ids long, n_bits long, ids array<long>, sizes array<long>, checkpoints binary, payload binary"
    # place grows with the order inside a shard, which is one partition; a file's splits keep it.
    whole.where("ids is not null").select("id", "shard", "place", "ids").mapInArrow(blocks, schema).write.option("compression", "zstd").parquet(f"{path}/blocks")
    sent.destroy()
    drop_path(spark, whole_at)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """From the files of write_ids, one row per document: doc_id, start, n_tokens, ids_crc32, and its ids on demand.

    start counts the ids of all documents before it. ids_crc32 is over the ids as little-endian unsigned 32-bit integers.
    Rows that repeat an id come as often as they were written, null ids as null; files without blocks give no rows.
    """
    book = spark.read.parquet(f"{path}/codebook").collect()
    lengths = np.zeros(max((r.token for r in book), default=0) + 1, np.uint8)
    for r in book:
        lengths[r.token] = r.bits
    stored = spark.read.parquet(f"{path}/blocks")
    shards = stored.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # One row per shard, which is a partition of the writer; then one per block of a shard.
    first = shards.select(F.col("shard").alias("s"), F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    begins = stored.select("shard", "place", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inner"))
    begins = begins.join(first, F.col("shard") == F.col("s")).select(F.col("shard").alias("s"), F.col("place").alias("p"), (F.col("shard_start") + F.col("inner")).alias("block_start"))

    names = ["shard", "place", "doc_id", "inner", "n_tokens", "ids_crc32", "token_ids"][: 6 + with_ids]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())][: 6 + with_ids]

    def unpacked(r: dict, ids: np.ndarray) -> pa.RecordBatch:
        ends = np.cumsum(r["sizes"])
        starts = ends - r["sizes"]
        parts = [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        columns = [[r["shard"]] * len(parts), [r["place"]] * len(parts), r["ids"], starts, r["sizes"], [zlib.crc32(x) for x in parts]]
        if with_ids:
            columns.append([x.astype(np.int64) for x in parts])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    def unpack(batches):
        table = decoding_table(lengths)
        for batch in batches:
            for k in range(0, batch.num_rows, 8):
                some = batch.slice(k, 8).to_pylist()
                found = decode([(r["payload"], np.frombuffer(r["checkpoints"], "<u4"), r["n_ids"]) for r in some], table)
                yield from map(unpacked, some, found)

    found = stored.select("shard", "place", "n_ids", "ids", "sizes", "checkpoints", "payload").mapInArrow(unpack, "shard int, place long, doc_id long, inner long, n_tokens long, ids_crc32 long" + ", token_ids array<long>" * with_ids)
    joined = found.join(begins, (F.col("shard") == F.col("s")) & (F.col("place") == F.col("p")))
    return joined.select("doc_id", (F.col("block_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", *(["token_ids"] if with_ids else []))


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the documents' ids into the shared folder and reads them back; the files go when Python ends.

    Nulls, repeated rows, ties and empty tables as in write_ids; columns other than doc_id and text are ignored. Long texts
    are encoded whole, in a slice of their own.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    drop_at_exit(spark, path)
    write_ids(docs, tokenizer, path)
    return read_ids(spark, path)
