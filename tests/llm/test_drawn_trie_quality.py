"""Importance resampling, the prefix trie and the compression classifier against plain versions, and on odd input."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from drawstats.llm import compression, importance, prefix_trie, queries

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = "ab cd " * 30000 + "x" * 5000


def runs(text, longest=2):
    w = WORD.findall((text or "").translate(LOWER))
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)


def buffer(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw])


# ------------------------------------------------------------------ resampling


@given(st.lists(st.binary(max_size=40), min_size=2, max_size=2))
def test_sums_are_joined(two):
    a, b = two
    got = importance.joined(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))
    assert got[0] == zlib.crc32(a + b)


def test_sums_are_joined_over_long_strings():
    a, b = b"begin", b"q" * 3_000_001
    assert importance.joined(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))[0] == zlib.crc32(a + b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB1 é漢-z\x00\n", max_size=40), max_size=6), st.integers(1, 4))
def test_buckets_are_those_of_the_strings(texts, longest):
    texts = [*texts, "w" * 40 + " v"]
    row, bucket, n_words = importance.buckets(*buffer(texts), longest)
    got = collections.defaultdict(list)
    for i, b in zip(row.tolist(), bucket.tolist(), strict=True):
        got[i].append(b)
    for i, t in enumerate(texts):
        want, n = runs(t, longest)
        assert n_words[i] == n and sorted(got[i]) == sorted(zlib.crc32(f.encode()) % importance.BUCKETS for f in want)


def resampled(docs, target):
    """``(doc_id, n_features, weight, score, rank)`` as the contract has it."""
    count = lambda texts: collections.Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in runs(t)[0])
    s, t = count(x for _, x in docs), count(target)
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000)))) for b in range(10000)]
    out, fit = [], []
    for i, x in docs:
        f, n = runs(x)
        weight = sum(gain[zlib.crc32(y.encode()) % 10000] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n >= 20:
            fit.append(out[-1])
    for k, r in enumerate(sorted(fit, key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))[: 25 * len(fit) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


def some_docs(seed=5, n=120):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéß漢") for _ in range(r.randint(1, 6))) for _ in range(200)]
    rows = [(i, r.choice(["", " ", "\n", "A-"]).join(r.choice(words) + " " for _ in range(r.randint(0, 60)))) for i in range(n)]
    return rows + [(7, rows[3][1]), (7, rows[3][1]), (None, None), (None, " ".join(words[:50])), (n, ""), (n + 1, LONG)]


def test_resampling_is_the_plain_one(spark, tmp_path):
    rows = some_docs()
    target = [t for i, t in rows[:9]] + [None, "nowhere else"]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(target)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op11_importance(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == resampled(rows, target)


def test_resampling_on_odd_tables(spark):
    docs = spark.createDataFrame(some_docs(n=30), "doc_id long, text string").selectExpr("*", "'x' AS rank", "'x' AS weight", "'x' AS n_words", "'x' AS _row", "'x' AS id")
    target = docs.selectExpr("text")
    assert importance.resampled(docs.limit(0), target).count() == 0
    got = importance.resampled(docs, target.limit(0)).collect()
    assert len(got) == docs.count() and sorted(r.rank for r in got if r.rank) == list(range(1, 1 + sum(r.rank is not None for r in got)))
    same = spark.createDataFrame([(1, "one two " * 20)] * 40, "doc_id long, text string")  # equal rows are dealt out and ranked apart
    assert sorted(r["rank"] for r in importance.resampled(same, target).collect() if r["rank"]) == list(range(1, 11))


# ------------------------------------------------------------------------ trie


def trie(rows):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [y[1:] for y in sorted(v, key=lambda y: y[0])] for c, v in own.items()}
    path = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path[c] = own.get(c - c % 100, [])[:h] + v[h:]
    members, kids = collections.defaultdict(list), collections.defaultdict(list)
    for c, v in path.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
        ends = ",".join(map(str, sorted(c for c in members[k] if len(path[c]) == len(k))))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def some_conversations(seed):
    r = random.Random(seed)
    rows = []
    for c in {r.randrange(0, 500) for _ in range(140)} | {100, 200}:
        form = r.randrange(3)
        for t in range(r.choice([1, 1, 2, 3, 5, 9])):
            text = r.choice([f"t{form}", "", None, "é" * (t + 1)]) if r.random() < 0.4 else f"s{t}"
            rows.append((c, t if t else None, r.choice(["user", None, "a"]) if r.random() < 0.2 else "u", text))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_trie_is_the_plain_one(spark, tmp_path, seed):
    rows = some_conversations(seed) + [(None, 1, "user", "of nobody")]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(map(tuple, queries.op12_prefix_trie(spark, str(tmp_path)).collect()), key=str) == trie(rows)


def test_trie_of_copies_and_long_conversations(spark):
    """Copies of one long conversation fill several blocks; others leave it at every depth."""
    long = [(t, "user", "word" * (t % 7)) for t in range(150)]
    rows = [(c, *x) for c in range(1000, 1040, 10) for x in long]
    rows += [(2000 + d, *x) for d in range(1, 90) for x in [*long[:d], (d, "user", f"off {d}")]]
    rows += [(3000 + k, 0, "user", "hi") for k in range(300)] + [(5, 0, "u", LONG)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS id", "1 AS depth", "1 AS n", "1 AS path", "1 AS conv", "1 AS run")
    assert sorted(map(tuple, prefix_trie.prefix_trie(df).collect()), key=str) == trie(rows)


def test_trie_on_odd_tables(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "u", "x")], SCHEMA)).count() == 0
    rows = [(5, 0, "u", "x")]  # its head is replaced by that of 0, which is not there
    assert [tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()] == trie(rows)
    twice = [(100, 0, "u", "x")] * 2  # repeated rows are turns of their own
    got = prefix_trie.prefix_trie(spark.createDataFrame(twice, SCHEMA)).collect()
    assert sorted(r.depth for r in got) == [0, 1, 2]


def blocks_of(paths, sizes):
    """Points of the walk over given blocks, summed as the job sums them."""
    out, at = {}, 0
    blocks = []
    for k in sizes:
        blocks.append(paths[at : at + k])
        at += k
    blocks = [b for b in blocks if b]
    for i, block in enumerate(blocks):
        walk = prefix_trie.Walk()
        walk.before = blocks[i - 1][-1] if i else None
        after = blocks[i + 1][0] if i + 1 < len(blocks) else None
        for path, following in zip(block, [*block[1:], after], strict=True):
            walk.row(path, 1, paths.index(path), following)
        walk.end(after)
        for p in walk.out:
            if p[0] in out:
                old = out[p[0]]
                assert old[:3] == p[:3] and list(old[9]) == list(p[9])
                p = (*p[:3], old[3] + p[3], min(old[4], p[4]), *[x + y for x, y in zip(old[5:9], p[5:9], strict=True)], p[9])
            out[p[0]] = p
    return {k: (*v[:9], tuple(v[9])) for k, v in out.items()}


@settings(max_examples=80, deadline=None)
@given(st.sets(st.lists(st.integers(0, 2), max_size=6).map(tuple), min_size=1, max_size=25), st.lists(st.integers(0, 6), min_size=25, max_size=25))
def test_blocks_do_not_matter(paths, sizes):
    made = sorted(b"".join(hashlib.md5(str(x).encode()).digest() + (x + 1).to_bytes(4, "big") for x in p) for p in paths)
    whole = blocks_of(made, [len(made)])
    cut = blocks_of(made, [*sizes, len(made)])
    assert set(whole) <= set(cut)  # further points at borders may cut edges, but sums stay
    assert all(whole[k][3:9] == cut[k][3:9] for k in whole)


# --------------------------------------------------------------------- quality


def some_quality(n=500, seed=3):
    r = random.Random(seed)
    syllables = ["an", "the", "er", "tion", "le", "st", "ou", "re", "in", "ha"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        good = r.random() < 0.7
        w = [word() for _ in range(r.randint(30, 200))]
        text = " ".join(w) + "." if good else r.choice([" | ".join(w), " ".join(x.upper() + "!!" for x in w), " ".join(x + r.choice(["###", "***", "%%%"]) for x in w)])
        docs.append((i, text))
        labels.append((i, int(good), 0))
    return docs, labels


def test_quality_on_held_out_documents(spark, tmp_path):
    docs, labels = some_quality()
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in queries.op13_compression(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    truth = {i: q for i, q, _ in labels}
    held = [i for i in got if got[i].held_out]
    assert set(held) == {i for i in got if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert np.mean([got[i].predicted == truth[i] for i in held]) >= 0.95
    flipped = [(i, 1 - q if i in set(held) else q, t) for i, q, t in labels]  # labels of held-out rows are not looked at
    again = compression.scored(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")).collect()
    assert {r.doc_id: r.score for r in again} == {i: r.score for i, r in got.items()}


def test_sizes_are_those_of_single_pieces():
    import zstandard

    text = " ".join(str(i * i) for i in range(4000)).encode()
    dictionary = compression.trained_dictionary([text[k : k + 700] for k in range(0, len(text), 700)], 4096)
    compressor = zstandard.ZstdCompressor(level=compression.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=False, write_content_size=False, write_dict_id=False)
    want = sum(len(compressor.compress(text[k : k + compression.PIECE])) for k in range(0, len(text), compression.PIECE))
    assert compression.Sizes((dictionary, b""))(memoryview(text))[0] == want


def test_regression_finds_a_planted_rule():
    r = np.random.default_rng(1)
    size = r.integers(200, 20000, 4000).astype(float)
    d = r.normal(0, 0.1, 4000)
    total = size * 0.8
    good, bad = total * (1 - d) / 2, total * (1 + d) / 2
    label = (r.random(4000) < 1 / (1 + np.exp(-(30 * d + 1)))).astype(float)
    p = compression.calibrated((b"", b""), bad, good, size, label).score(bad, good, size)
    for low in np.arange(0, 1, 0.2):  # calibrated: of those with a score of about s, a share of s is good
        band = (p >= low) & (p < low + 0.2)
        assert abs(label[band].mean() - p[band].mean()) < 0.06


def test_quality_on_odd_tables(spark):
    docs, labels = some_quality(120)
    rows = [*docs, (5, docs[5][1]), (5, docs[5][1]), (None, None), (900, ""), (901, LONG), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS label", "'x' AS h", "'x' AS bad", "'x' AS size", "'x' AS score", "'x' AS quality", "'x' AS held_out")
    known = spark.createDataFrame([*labels, (None, 1, 0), (3, None, None), (4, 0, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    got = compression.scored(df, known).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 5}) == 1
    assert all(r.held_out for r in got if r.doc_id is None)
    assert compression.scored(df.limit(0), known).count() == 0
    assert {r.score for r in compression.scored(df, known.limit(0)).collect()} == {0.5}
    alone = {r.score for r in compression.scored(df, known.filter("quality = 1")).collect()}
    assert len(alone) == 1 and 0.5 < alone.pop() < 1
