"""The operators against brute force on small tables with nulls, empties, repeats, ties, long texts and odd columns."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.llm import chat, decontaminate, graph, licenses, mixing, multiindex, sharding, simhash, substrings, tokens, toxicity
from tests.llm import brute

rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 5))) for _ in range(60)] + ["The", "the,", "of", "Of", "IT'S", "x1", "2024", "–", "İ"]


def prose(n, r=rng):
    return r.choice(["", " ", "\n"]) + "".join(r.choice(VOCABULARY) + r.choice([" ", "  ", "\n", "\t", "\x0b", ". "]) for _ in range(n))


def corpus(n=60, seed=1):
    r = random.Random(seed)
    passage = prose(30, r)
    texts = [prose(r.choice([0, 1, 2, 3, 12, 13, 14, 40, 200]), r) for _ in range(n)]
    for k in range(0, n, 5):
        texts[k] += passage + prose(5, r)
    for k in range(0, n, 7):
        texts[k] = texts[(k + 3) % n]
    texts[1], texts[2], texts[3] = None, "", " \t\n "
    texts[4] = "the " * 3000
    near = texts[5].split(" ")
    texts[8] = " ".join(near[:-1] + ["other"])
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def frame(spark, rows, parts=3, clash=("size", "score", "n_words")):
    """Documents with extra columns whose names clash with those that operators add."""
    data = [(i, t, "en" if k % 2 else None, f"src{k % 4}" if k % 5 else None, k, float(k), "x") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, {clash[0]} int, {clash[1]} double, {clash[2]} string").repartition(parts)


EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_simhash_matches_brute_force(spark):
    rows = corpus()
    want = brute.simhash_groups(rows)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(frame(spark, rows)).collect()}
    assert got == want


def test_simhash_finds_every_pair_within_three_bits():
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(40)]
    for bits in (1, 2, 3):
        for f in base:
            other = f
            for b in r.sample(range(64), bits):
                other ^= 1 << b
            keys, prints = simhash.variants(np.array([f, other], np.uint64))
            own = [set(keys[prints == p].tolist()) for p in (f, other)]
            assert own[0] & own[1]
    far = np.array([0, 0b1111], np.uint64)
    assert simhash.bucket_links(far) == []


def test_simhash_empty_null_ids_and_repeats(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], EMPTY)).count() == 0
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (9, None), (7, ""), (None, "z")]
    got = rows_of(simhash.simhash_groups(frame(spark, rows)), "doc_id", "component_id")
    assert got == sorted([(5, 5), (5, 5), (None, 5), (9, 7), (7, 7), (None, None)], key=str)
    kept = simhash.keep_first(frame(spark, rows))
    assert rows_of(kept, "doc_id") == sorted([(5,), (5,), (7,), (None,)], key=str)
    assert kept.columns == frame(spark, rows).columns


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (7, None)]
    stars, _ = graph.components(spark.createDataFrame(edges, "a long, b long").repartition(7))
    got = {r.a: r.b for r in stars.collect()}
    assert got == {i: 0 for i in range(1, 101)} | {i: 1000 for i in range(1001, 1100)}


ITEMS = [(7, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"), (8, "short item here"), (9, None), (10, "!!"), (11, "short item here"), (None, "one two three four five six seven eight nine ten eleven twelve thirteen")]


def polluted():
    rows = corpus(30, 3)
    rows += [(500, "x " + ITEMS[0][1].upper() + " y"), (501, prose(400) + " short ITEM, here! " + prose(20)), (502, "alpha beta gamma"), (503, ITEMS[5][1] + " " + ITEMS[0][1]), (504, "short item here short item here"), (None, "short item here"), (504, "short item here short item here")]
    return rows


def test_contamination_matches_brute_force(spark, monkeypatch):
    rows = polluted()
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(brute.contamination(rows, ITEMS), key=str)
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows_of(decontaminate.find_contamination(frame(spark, rows), bench), *names) == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 20)  # many blocks, and many shards
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 50)
    monkeypatch.setattr(decontaminate, "ITEM_WORDS", 14)
    assert rows_of(decontaminate.find_contamination(frame(spark, rows), bench), *names) == want
    monkeypatch.setattr(decontaminate, "PASS_BLOCKS", 2)  # and many passes
    docs = frame(spark, rows, clash=("KEY", "n_hit", "Spans"))
    out = decontaminate.find_contamination(docs, bench)
    assert rows_of(out, *names) == want and {"KEY", "Spans"} <= set(out.columns)
    assert decontaminate.decontaminated(docs, bench).count() == sum(not w[-1] for w in want)


def test_contamination_longest_match_and_filter(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = frame(spark, polluted())
    longest = {r.doc_id: r.longest_match for r in decontaminate.find_contamination(docs, bench).collect()}
    assert longest[500] == 15 and longest[501] == 3 and longest[502] == 0
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns and 500 not in {r.doc_id for r in clean.collect()}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminated(docs, none).count() == docs.count()
    assert decontaminate.find_contamination(spark.createDataFrame([], EMPTY), bench).count() == 0


def test_removal_matches_brute_force(spark, monkeypatch):
    rows = [*corpus(80, 4), (None, corpus(80, 4)[0][1]), (1, corpus(80, 4)[0][1])]
    want = sorted(brute.removed(rows), key=str)
    names = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert rows_of(substrings.remove_repeats(frame(spark, rows)), *names) == want
    assert any(r[2] for r in want)
    monkeypatch.setattr(substrings, "CHUNK_WORDS", 30)
    monkeypatch.setattr(substrings, "BUCKET_WINDOWS", 40)
    monkeypatch.setattr(substrings, "STRETCH", 25)
    assert rows_of(substrings.remove_repeats(frame(spark, rows, 5)), *names) == want


def test_removal_from_hot_buckets(spark, monkeypatch):
    rows = corpus(80, 4)
    want = sorted(brute.removed(rows), key=str)
    monkeypatch.setattr(substrings, "CHUNK_WORDS", 30)
    monkeypatch.setattr(substrings, "SALT_CHUNKS", 4)
    monkeypatch.setattr(substrings, "COMMON", 1 / 2000)  # many minimisers are common, and judged twice
    assert rows_of(substrings.remove_repeats(frame(spark, rows, 5)), "doc_id", "n_words", "n_removed", "kept_sha256") == want


@pytest.mark.parametrize("clash", [("id", "checksum", "runs"), ("N_WORDS", "__begin_", "Kept_Sha256"), ("begin", "__times", "kind"), ("c0", "u0", "a0")])
def test_columns_of_any_name_pass(spark, clash):
    rows = corpus(20, 4)
    docs = frame(spark, rows, 2, clash)
    want = {(r[0], r[2]) for r in brute.removed(rows)}
    assert {(r.doc_id, r.n_removed) for r in substrings.remove_repeats(docs).collect()} == want
    out = substrings.remove_repeats(docs).columns
    assert len({c.lower() for c in out}) == len(out) and {"n_words", "kept_text"} <= set(out)
    bench, labels = spark.createDataFrame(ITEMS, "item_id long, text string"), spark.createDataFrame([(4, 0, 1)], "doc_id long, quality int, toxic int")
    for stage in (simhash.keep_first, mixing.mixed, lambda d: decontaminate.decontaminated(d, bench), lambda d: toxicity.without_toxic(d, labels)):
        assert stage(docs).columns == docs.columns and stage(docs).count() >= 0
    assert licenses.scan(docs).count() == len(rows)
    assert [c for c in docs.columns if c.lower() not in ("n_words", "kept_sha256")] == [c for c in out if c in docs.columns and c not in ("n_words", "kept_sha256")]


def test_removal_of_nothing(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], EMPTY)).count() == 0
    out = substrings.remove_repeats(frame(spark, [(1, None), (2, "a b")])).collect()
    assert [(r.n_words, r.n_removed, r.kept_text) for r in sorted(out, key=lambda r: r.doc_id)] == [(0, 0, ""), (2, 0, "a b")]


def test_windows_with_one_hash_are_told_apart(monkeypatch):
    text = substrings.Text(b" ".join(b"w%d" % (i % 7) for i in range(60)), {})
    at = np.arange(48)
    owner = at // 24
    want = substrings.first_owners(text, at, owner, 13)
    monkeypatch.setattr(substrings.Text, "hashes", lambda self, first, words: np.zeros(len(first), np.uint64))
    got = substrings.first_owners(text, at, owner, 13)
    assert (want[0] == got[0]).all() and (want[1] == got[1]).all()


def test_mixing_meets_budgets(spark):
    rows = corpus(90, 6)
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    size = {i: len(brute.blank_words(t)) for i, t in rows}
    assert {r.doc_id: r.size for r in got} == size
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, target, whole = {}, {}, {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        s = source[r.doc_id]
        taken[s] = taken.get(s, 0) + r.taken
        target[s], whole[s] = r.target, r.source_size
    assert all(taken[s] == int(target[s]) and target[s] <= 3 * whole[s] for s in target)
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_mixing_reshares_what_a_small_source_cannot_take(spark):
    data = [("a", 1000), ("b", 10), ("c", 400), (None, 90)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(data, "source string, source_size long")).collect()}
    assert got["b"] == 30 and got[None] == pytest.approx((1500 - 30) / 5) or got[None] <= 270
    assert sum(got.values()) == pytest.approx(1500)
    assert mixing.mix(spark.createDataFrame([], EMPTY)).count() == 0


def test_mixed_documents_repeat(spark):
    rows = [(i, "w " * 10) for i in range(10)] + [(50, None), (None, "w w")]
    docs = spark.createDataFrame([(i, t, "a" if i is None or i < 9 else "b") for i, t in rows], "doc_id long, text string, source string")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    n = {}
    for r in out.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    assert n[9] == 3 and n[50] == 1


def test_mixed_copies_match_the_plan(spark):
    rows = [*corpus(60, 6), *[(4000, "q r s t u")] * 9, *[(None, "one two three")] * 4, (4000, "u t s r q"), (4001, " ")]
    docs = frame(spark, rows, clash=("__times", "key", "cut"))
    plan = {}
    source = [r.source for r in docs.collect()]
    for r in mixing._mix(docs).collect():
        k = (r.doc_id, r["__source"], r.size)
        plan[k] = plan.get(k, 0) + (int(r.taken / r.size + 0.5) if r.size else 1)
    got = {}
    for r in mixing.mixed(docs).collect():
        k = (r.doc_id, r.source, len(brute.blank_words(r.text)))
        got[k] = got.get(k, 0) + 1
    assert got == {k: n for k, n in plan.items() if n} and len(set(source)) > 2


def test_shards_match_brute_force(spark):
    rows = [*corpus(50, 8), (1, "again"), (None, "none"), (None, None)]
    got = sharding.shard(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got), key=str) == sorted(brute.shards(rows), key=str)
    by = {}
    for r in got:
        assert r.grown_shard in (r.shard, 40) and r.law == "key"
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard(spark.createDataFrame([], EMPTY)).count() == 0


def test_shard_weights(spark):
    docs = spark.range(8000).selectExpr("id as doc_id", "'x' as text")
    n = {r.shard: r["count"] for r in sharding.shard(docs, 3, [1.0, 2.0, 5.0]).groupBy("shard").count().collect()}
    assert abs(n[0] - 1000) < 150 and abs(n[1] - 2000) < 200 and abs(n[2] - 5000) < 250


@pytest.fixture(scope="module")
def small_tokenizer(tmp_path_factory):
    """A byte-level vocabulary made by hand: all bytes with and without the word end, and a few merges."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, n = {}, 0
    for b in range(256):
        chars[b] = chr(b) if b in printable else chr(256 + n)
        n += b not in printable
    vocabulary = {}
    for b in range(256):
        vocabulary[chars[b]] = len(vocabulary)
    for b in range(256):
        vocabulary[chars[b] + "</w>"] = len(vocabulary)
    merges = [("t", "h"), ("th", "e</w>"), ("a", "b"), ("e", "d</w>"), ("o", "f</w>")]
    for a, b in merges:
        vocabulary[a + b] = len(vocabulary)
    spec = {
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "post_processor": None, "decoder": None,
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocabulary, "merges": [list(m) for m in merges]},
    }
    path = tmp_path_factory.mktemp("tokenizer") / "small.json"
    path.write_text(json.dumps(spec))
    return str(path)


def test_token_files_round_trip(spark, small_tokenizer, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "BLOCK_IDS", 700)
    t = Tokenizer.from_file(small_tokenizer)
    rows = corpus(40, 11)
    got = rows_of(tokens.round_trip(frame(spark, rows), small_tokenizer), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == sorted(brute.token_files(sorted(rows), lambda x: t.encode(x, add_special_tokens=False).ids), key=str)
    assert tokens.round_trip(spark.createDataFrame([], EMPTY), small_tokenizer).count() == 0
    twice = tokens.round_trip(frame(spark, [(3, "a"), (3, "a"), (None, "b"), (2, None)]), small_tokenizer).collect()
    assert sorted(r.start for r in twice) == [0, 2, 3, 5]


def odd_texts(n):
    r = random.Random(2)
    alphabet = "abtheTHEédÄßé .,!?'<>|()-_ \t\n\x0b\x0c\x1c\x85\xa0 123½²ΣςİǅﬁЖ中"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(n)]
    return [*texts, "<|endoftext|> a<|startoftext|>b", "Hello world The quick", "  two  blanks ", "12.5 a.b x..y", "the " * 30_000]


def encoded(made, texts):
    ids, n = made.ids(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_pieces_equal_whole_texts(small_tokenizer, monkeypatch):
    from tokenizers import Tokenizer

    files = [small_tokenizer]
    try:
        import public_tokenizers

        files += [public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")]
    except ImportError:
        pass
    texts = odd_texts(3000)
    for path, by_pieces in zip(files, (True, True, False), strict=False):
        spec = open(path, encoding="utf-8").read()
        assert tokens.piecewise(spec) == by_pieces
        t, made = Tokenizer.from_file(path), tokens.encoder(spec, 2)
        want = [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert encoded(made, texts) == want
        monkeypatch.setattr(tokens, "HELD_BYTES", 20_000)  # pieces are forgotten and learned again
        assert [x for i in range(0, len(texts), 97) for x in encoded(made, texts[i : i + 97])] == want
        assert not by_pieces or made.held.nbytes < 40_000


def test_slices_hold_whole_texts():
    import pyarrow as pa

    texts = pa.array(["a" * 10, "", "b" * 100, "c", "d" * 5, ""])
    assert list(tokens.slices(texts, 12)) == [(0, 2), (2, 3), (3, 6)]
    assert list(tokens.slices(pa.array([], pa.string()), 12)) == []


def test_huffman_codes_are_optimal_limited_and_decode():
    counts = np.zeros(300, np.int64)
    counts[:200] = np.random.default_rng(1).zipf(1.5, 200)
    lengths = tokens.code_lengths(counts, 12)
    assert lengths.max() <= 12 and (lengths[200:] == 0).all() and sum(2.0 ** -int(x) for x in lengths if x) <= 1
    assert tokens.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]
    codes = tokens.canonical_codes(lengths)
    ids = np.random.default_rng(2).integers(0, 200, 5000)
    parts = [ids[:1], ids[1:129], ids[129:4000], ids[4000:]]
    blocks = []
    for p in parts:
        payload, checkpoints, _ = tokens.encode(p, codes, lengths)
        blocks.append((payload, checkpoints, len(p)))
    for p, q in zip(parts, tokens.decode(blocks, tokens.decoding_table(lengths)), strict=True):
        assert (p == q).all()


def vectors(seed=3):
    r = np.random.default_rng(seed)
    rows = [(i, r.standard_normal(16).astype(np.float32).tolist()) for i in range(150)]
    for k in range(40):
        rows.append((200 + k, (np.array(rows[k % 7][1]) + r.standard_normal(16) * 0.08).tolist()))
    rows += [(300 + k, rows[3][1]) for k in range(5)] + [(400, (np.array(rows[4][1]) * 2.5).tolist())]
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [None] + [1.0] * 15), (504, [float("nan")] * 16), (505, [float("inf")] + [1.0] * 15), (506, [1.0, 2.0])]
    return rows


def test_near_vectors_match_brute_force(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame([(i, v, "k") for i, v in rows], "vec_id long, embedding array<double>, kept string").repartition(4)
    want = brute.near_vectors(rows)
    for cell, part in ((200, 4096), (5, 3)):
        monkeypatch.setattr(multiindex, "PER_CELL", cell)
        monkeypatch.setattr(multiindex, "PART", part)
        got = {r.vec_id: (r.n_links, r.component_id) for r in multiindex.near_vectors(df).collect()}
        assert got.keys() == want.keys()
        found, total = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
        assert found >= 0.98 * total and all(got[i][0] <= want[i][0] for i in want)
    assert got == want or found < total
    assert multiindex.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_near_vectors_of_any_size_and_length(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1.01e200]), (3, [1e-200, 1e-200]), (4, [1.0, 0.2]), (5, [1.0]), (6, [2.0]), (7, [-3.0]), (10, [1.0, 0.0]), (11, [2.0, 0.001]), (14, [5e-324, 5e-324])]
    rows += [(20 + k, [1.0, 2.0, 3.0 + k * 5]) for k in range(5)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in multiindex.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    plain = [(i, (np.array(v) / max(map(abs, v))).tolist()) for i, v in rows]
    assert got == brute.near_vectors(plain)


def test_traversal_visits_nearest_cells_first():
    x = multiindex.unit([multiindex.packed(np.random.default_rng(k).standard_normal(8)) for k in range(300)], 8)
    index = multiindex.MultiIndex(x, 20_000, 0.95, 0.99)
    d1, d2 = index.distances(x[:20])
    grid = (d1[:, :, None] + d2[:, None, :]).reshape(20, -1)
    assert (index.cells(x[:20], 7) == np.argsort(grid, axis=1, kind="stable")[:, :7]).all()


def test_license_scan(spark):
    notice = licenses.TEMPLATES["gpl-3.0"]
    rows = [*corpus(20, 2), (900, "x MIT License mit license, MIT-license"), (901, "Licensed under CC BY-NC 4.0. GNU General Public License"), (902, notice.upper()), (903, notice.replace("either", "or"))]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    for i, text in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.license_places(text)
        assert 0 <= r.score <= 1
    assert got[902].labels == "gpl,gpl-3.0" and got[902].score == 1.0 and "gpl-3.0" in got[903].labels
    assert licenses.scan(spark.createDataFrame([], EMPTY)).count() == 0


def test_license_labels_and_scores_match_brute_force(spark):
    templates = {"a": "one two three four five six seven eight", "b": "three four five six nine ten", "c": "alpha beta gamma delta epsilon"}
    r = random.Random(3)
    words = "one two three four five six seven eight nine ten alpha beta gamma delta epsilon other mit license".split()
    texts = [None, "", "mit license"]
    for _ in range(150):
        parts = []
        for _ in range(r.randint(1, 5)):
            t = r.choice([*templates.values(), "mit license", " ".join(r.choice(words) for _ in range(6))]).split()
            i = r.randrange(len(t))
            parts += t[i if r.random() < 0.4 else 0 : r.randint(i + 1, len(t)) if r.random() < 0.4 else len(t)]
            parts += ["other"] * r.choice([0, 0, 1, 3, 14])
        texts.append(" ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in licenses.scan(docs, templates=templates).collect()}
    for i, t in enumerate(texts):
        labels, score = brute.license_verdict(t, licenses.PHRASES, list(templates.items()))
        assert (got[i].labels, got[i].score) == (labels, pytest.approx(score)), t
        assert all(0 <= x.begin < x.end <= got[i].n_words and x.share >= licenses.SHARE for x in got[i].spans)


def test_license_scan_of_long_and_repeated_texts(spark):
    notice = licenses.TEMPLATES["isc"]
    long = "filler words here " * 40_000 + notice + " tail" * 50_000
    docs = frame(spark, [(1, long), (1, long), (None, notice), (2, None)], clash=("LABELS", "spans", "x"))
    got = licenses.scan(docs).collect()
    assert sorted((str(r.doc_id), r.labels) for r in got) == [("1", "isc"), ("1", "isc"), ("2", ""), ("None", "isc")]
    assert {r.spans[0].begin for r in got if r.doc_id == 1} == {120_000}


def test_long_texts_are_taken_whole(spark, small_tokenizer):
    from tokenizers import Tokenizer

    passage = " ".join(f"p{k}" for k in range(20))
    rows = [(1, passage), (2, "the ab " * 150_000 + passage), (3, "the ab " * 150_000 + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(substrings.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.removed(rows), key=str)
    bench = spark.createDataFrame([(5, passage)], "item_id long, text string")
    assert {r.doc_id: (r.n_hit, r.longest_match) for r in decontaminate.find_contamination(docs, bench).collect()} == {1: (20, 20), 2: (20, 20), 3: (20, 20)}
    t = Tokenizer.from_file(small_tokenizer)
    got = rows_of(tokens.round_trip(docs, small_tokenizer), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == sorted(brute.token_files(rows, lambda x: t.encode(x, add_special_tokens=False).ids), key=str)
    assert {r.doc_id: r.fingerprint for r in simhash.simhash_groups(docs).collect()} == {i: "%016x" % brute.simhash(x) for i, x in rows}


def test_large_buckets_lose_no_link():
    r = random.Random(12)
    base = r.getrandbits(64)
    prints = {base}
    while len(prints) < 3000:
        f = r.choice(list(prints)) if r.random() < 0.3 else base ^ r.getrandbits(22)
        prints.add(f ^ (1 << r.randrange(64)))
    prints = np.array(sorted(prints), np.uint64)
    whole = brute.Groups(range(len(prints)))
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 3).tolist():
            whole.join(i, i + 1 + j)
    place = {p: i for i, p in enumerate(prints.view(np.int64).tolist())}
    got = brute.Groups(range(len(prints)))
    for a, b in simhash.bucket_links(prints):
        got.join(place[a], place[b])
    assert [whole.find(i) for i in range(len(prints))] == [got.find(i) for i in range(len(prints))]


def test_long_conversations_spread_over_parts(spark):
    turns = [(1, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(400)]
    turns += [(2, *t[1:]) for t in turns[:399]] + [(3, *t[1:]) for t in turns[:200]] + [(4, *t[1:]) for t in turns[:199]] + [(4, 199, "user", "else")]
    df = spark.createDataFrame(turns, "CONV_ID long, turn long, role string, text string").withColumn("key", F.lit(1)).withColumn("part", F.lit("x")).repartition(6)
    got = {r.CONV_ID: (r.n_turns, r.n_equal, r.text.count("<|end|>")) for r in chat.format_chats(df, "CONV_ID").collect()}
    assert got == {1: (400, 1, 400), 4: (200, 1, 200)}


def test_automaton_knows_all_substrings():
    automaton = licenses.Automaton({"a b": "x"}, {"t": "a b c a b d", "u": "b c a"})
    ids = automaton.vocabulary
    for words in ("a b c", "b c a b", "c a", "b d"):
        state = 0
        for w in words.encode().split():
            state = automaton.next[state][ids[w]]
        assert automaton.length[state] >= len(words.split())
    assert ids[b"d"] not in automaton.next[automaton.next[0][ids[b"a"]]]


def chats():
    base = [("user", "hi"), ("assistant", "hello"), ("user", "more")]
    out = []
    for conv, turns in ((1, base), (2, base[:2]), (3, base), (4, base[:1]), (5, [("user", "hi"), ("assistant", "other")]), (6, [("user", None)]), (7, [("user", "")]), (None, [(None, "lone")])):
        out += [(conv, k, r, t) for k, (r, t) in enumerate(turns)]
    return [*out, out[0]]


def test_chats_collapse_to_maximal_conversations(spark):
    df = spark.createDataFrame(chats(), "conv_id long, turn long, role string, text string").repartition(5)
    got = rows_of(chat.format_chats(df), "conv_id", "n_turns", "n_equal")
    assert got == sorted([(1, 3, 2), (5, 2, 1), (6, 1, 1), (7, 1, 1), (None, 1, 1)], key=str)
    text = next(r.text for r in chat.format_chats(df).collect() if r.conv_id == 5)
    assert text == "<|user|>\nhi\n<|end|>\n<|assistant|>\nother\n<|end|>\n"
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def toxic_corpus(n=900):
    """Invented prose in which toxic documents hold a few made-up insults, one of them a stem with endings."""
    r, docs, labels = random.Random(4), [], []
    for i in range(n):
        words = [r.choice("lorem ipsum dolor sit amet elit sed do magna aliqua enim".split()) + r.choice(["", "", "s", "or"]) for _ in range(r.randint(8, 60))]
        bad = i % 6 == 0
        for _ in range(r.randint(1, 4) if bad else 0):
            words.insert(r.randint(0, len(words)), r.choice(["zurgle", "fnord", "blatz" + r.choice(["en", "ung", "ix", "o"])]))
        docs.append((i, " ".join(words) + "."))
        labels.append((i, 0, int(bad)))
    return docs, labels


def test_toxicity_is_learned_and_held_out(spark):
    docs, labels = toxic_corpus()
    df = frame(spark, [*docs, (5000, None), (5001, ""), (5002, "what a blatzheim")])
    grammar = toxicity.fit(df, spark.createDataFrame([*labels, (None, 0, 1), (7, 0, None)], "doc_id long, quality int, toxic int"))
    out = {r.doc_id: r for r in toxicity.score_toxicity(df, grammar).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()}
    wrong = [i for i, _, y in labels if out[i].held and out[i].predicted != y]
    assert len(wrong) <= 2 and sum(out[i].held for i, _, _ in labels) > 200
    assert out[5000].score < 0.3 and out[5001].predicted == 0 and out[5002].predicted == 1
    kept = toxicity.without_toxic(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == df.columns and {i for i, _, y in labels if y == 0} <= {r.doc_id for r in kept.collect()}


def test_toxicity_without_labels(spark):
    df = frame(spark, [(1, "you are a pathetic loser"), (2, "good day"), (3, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.predicted for r in toxicity.score_toxicity(df, toxicity.fit(df, none)).collect()}
    assert out == {1: 1, 2: 0, 3: 0}
    empty = spark.createDataFrame([], EMPTY)
    assert toxicity.score_toxicity(empty, toxicity.fit(empty, none)).count() == 0


def test_grammar_tells_forms_apart():
    grammar = toxicity.Composed()
    tag = lambda s: [("I", 1.0) if w in toxicity.INSULTS else ("T", 1.0) if w in toxicity.THREATS else (toxicity.TAGS.get(w, "o"), 0.0) for w in s.split()]
    pattern = lambda s: [m[0] for m in grammar.matches(tag(s))]
    assert pattern("you idiot") == ["Ia"]
    assert pattern("idiot that you are") == ["Ia"]
    assert pattern("not an idiot") == ["In"]
    assert pattern("he said some idiot fell") == ["Iar"]
    assert pattern("i will kill you") == ["Ta"]
    assert pattern("bugs kill time") == []


def test_composed_transducers_equal_the_cascade_and_the_rules():
    grammar, (ahead, steps), r = toxicity.Composed(), toxicity.cascade(), random.Random(8)
    assert grammar.priors["I"] == 0.92 and grammar.priors["Tanr"] == pytest.approx(0.85 * 0.4 * 0.5)
    for _ in range(3000):
        symbols = [r.choice("oooYNMRIT") for _ in range(r.randint(0, 14))]
        path = [y for y, _ in ahead.run(reversed(symbols))][::-1]
        weights = [1.0] * len(symbols)
        for step in steps:
            found = list(step.run(path))
            path, weights = [y for y, _ in found], [w * v for w, (_, v) in zip(weights, found, strict=True)]
        got = grammar.matches([(x, float(k)) for k, x in enumerate(symbols)])
        assert got == [(y, float(k)) for k, y in enumerate(path) if y != "o"] == [(p, float(k)) for k, p in brute.clause(symbols)]
        assert [w for y, w in zip(path, weights, strict=True) if y != "o"] == pytest.approx([grammar.priors[y] for y, _ in got])


def test_toxicity_matches_brute_force_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("needs the driver's tables")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    grammar = toxicity.fit(docs, labels)
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "calm words. " * 60_000 + "you will kill them, worthless scum!"), (-3, "you idiot"), (None, "you idiot")], "doc_id long, text string")
    got = toxicity.score_toxicity(docs.select("doc_id", "text").union(extra), grammar).collect()
    for row in got:
        score, n = brute.toxicity(row.text, grammar, toxicity)
        assert row.score == pytest.approx(score, abs=1e-12) and row.n_matches == n and row.predicted == int(row.score >= 0.7)
    assert sum(row.n_matches > 0 for row in got) > 5
    assert {row.predicted for row in got if row.text and row.text.endswith("scum!")} == {1}
