"""Operators and queries against plain versions on small corpora."""

import collections
import hashlib
import html
import math
import os
import random
import re
import zlib
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from drawstats.llm import brown_lm, fm_dedup, html_text, media, mixing, pieces_codec, quality, queries, repeats, simhash, suffix_dedup, token_counts
from drawstats.llm.common import pieces, text_buffer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages and repeated lines."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6))) + r.choice(["", "", ",", "."]) for _ in range(400)]
    passage = " ".join(r.choice(words) for _ in range(60))
    out = []
    for i in range(n):
        kind = r.randint(0, 6)
        text = " ".join(r.choice(words) + (r.choice(["", "\n"]) if r.random() < 0.1 else "") for _ in range(r.randint(0, 150)))
        if kind == 1 and out:
            text = r.choice(out)
        elif kind == 2 and out:
            w = r.choice(out).split(" ")
            w[r.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind == 3:
            text = text[:80] + "\n" + passage + "\n" + text[80:]
        elif kind == 4:
            text = (text[:40] + "\n") * 12
        elif kind == 5:
            text = "aaaa " * r.randint(1, 80)
        out.append(text)
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs(spark, corpus()).write.parquet(f"{d}/documents.parquet")
    return d


def marks(seqs, size):
    seen, out = set(), {}
    for i, x in seqs:
        m = np.zeros(len(x), bool)
        for q in range(len(x) - size + 1):
            k = bytes(x[q : q + size]) if isinstance(x, bytes) else tuple(x[q : q + size])
            if k in seen:
                m[q : q + size] = True
            seen.add(k)
        out[i] = m
    return out


def test_suffix_dedup_query(spark, tables):
    want = marks([(i, t.encode()) for i, t in corpus()], 100)
    got = {r.doc_id: r for r in queries.op4_suffix_dedup(spark, tables).collect()}
    for i, t in corpus():
        m, raw = want[i], np.frombuffer(t.encode(), np.uint8)
        spans = int((m[1:] & ~m[:-1]).sum() + (m[:1].sum()))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(raw), int(m.sum()), spans)
        assert got[i].kept_sha256 == hashlib.sha256(raw[~m].tobytes()).hexdigest()


def test_fm_dedup_query(spark, tables):
    want = marks([(i, WORD.findall(t)) for i, t in corpus()], 20)
    got = {r.doc_id: r for r in queries.op6_fm_dedup(spark, tables).collect()}
    for i, t in corpus():
        kept = " ".join(w for w, gone in zip(WORD.findall(t), want[i], strict=True) if not gone)
        assert (got[i].n_words, got[i].n_removed) == (len(want[i]), int(want[i].sum()))
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


@pytest.mark.parametrize("hot", [2, 5])
def test_hot_anchors_and_small_shards(spark, hot):
    rows = corpus(4, 80)
    for scheme, split, size in ((suffix_dedup.scheme(12, 4), lambda t: t.encode(), 12), (fm_dedup.scheme(5, 2), WORD.findall, 5)):
        keyed = repeats.keyed(docs(spark, rows), "doc_id", "text")
        got = repeats.with_repeats(keyed, replace(scheme, hot=hot, shard_symbols=200)).collect()
        want = marks([(i, split(t)) for i, t in rows], size)
        for r in got:
            m = np.zeros(len(want[r.d]), bool)
            for s in r.spans or ():
                m[(s >> 32) : (s & 0xFFFFFFFF) + size] = True
            assert (m == want[r.d]).all()


def brute_simhash(text):
    w = WORD.findall(text.translate(LOWER))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_query(spark, tables):
    rows = corpus()
    fp = {i: brute_simhash(t) for i, t in rows}
    least = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 4 and least[b] < least[a]:
                    least[a], changed = least[b], True
    got = queries.op3_simhash(spark, tables).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fp[i]:016x}", least[i]) for i in fp}


def joined(pairs):
    """Every value of the pairs with the least one that a chain of pairs reaches."""
    least = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(least[a], least[b])
            for x in (a, b):
                if least[x] != low:
                    least[x], changed = low, True
    return least


def test_links_join_what_all_pairs_join(spark, monkeypatch):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(5)]
    values = {b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 6))) for b in base for _ in range(60)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    every = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    for hot in (1000, 3):
        monkeypatch.setattr(simhash, "HOT_KEY", hot)
        got = [tuple(x) for x in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()]
        assert set(got) <= every and len(got) == len(set(got))
        assert joined(got) == joined(every)


def test_a_dense_group_makes_a_star(spark):
    base = 0x0123456789ABCDEF
    near = {base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}
    values = [v - (1 << 64) if v >> 63 else v for v in near | {base}]
    got = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()
    assert set(joined([tuple(x) for x in got]).values()) == {min(values)} and len(got) < 130 * len(values)


def shuffled_rows(spark, after=-1):
    """Rows that stages with ids above ``after`` wrote for shuffles, and the last id."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    stages = [stages.apply(i) for i in range(stages.size())]
    return sum(s.shuffleWriteRecords() for s in stages if s.stageId() > after), max((s.stageId() for s in stages), default=-1)


def test_keys_are_not_shuffled(spark):
    """A fingerprint is shuffled once a part of a segment, not once a key (finding on op3's disk)."""
    r = random.Random(3)
    nodes = spark.createDataFrame([(r.getrandbits(64) - (1 << 63),) for _ in range(2000)], "fp long")
    _, last = shuffled_rows(spark)
    simhash.links(nodes).write.format("noop").mode("overwrite").save()
    assert 2000 < shuffled_rows(spark, last)[0] < 40 * 2000  # 64 keys, three times, before


def test_components_of_a_chain(spark):
    got = simhash.components(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")).collect()
    assert {(r.node, r.root) for r in got} == {(i, 0) for i in range(1, 41)} | {(101, 100)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab\0c", max_size=25), min_size=1, max_size=4), st.integers(2, 9))
def test_longest_previous_factors(texts, depth):
    data = [t.encode() for t in texts]
    off = np.concatenate(([0], np.cumsum([len(d) for d in data])))
    s = b"".join(data)
    got = suffix_dedup.longest_previous_factors(np.frombuffer(s, np.uint8), off, depth)
    end = np.repeat(off[1:], np.diff(off))
    for p in range(len(s)):
        best = 0
        for q in range(p):
            n = 0
            while n < depth and p + n < end[p] and q + n < end[q] and s[p + n] == s[q + n]:
                n += 1
            best = max(best, n)
        assert min(got[p], depth) == best


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60), st.integers(1, 6))
def test_wavelet_rank(values, bits):
    v = np.array([x % (1 << bits) for x in values], np.int64)
    tree = fm_dedup.WaveletMatrix(v, bits)
    for c in range(1 << bits):
        at = np.arange(len(v) + 1)
        assert tree.rank(np.full(len(at), c), at).tolist() == [int((v[:i] == c).sum()) for i in at]


def test_quality_query(spark, tables):
    query = {r.doc_id: r for r in queries.op9_quality(spark, tables).collect()}
    got = {r.doc_id: r for r in quality.quality_rules(spark.read.parquet(f"{tables}/documents.parquet")).collect()}
    for i, t in corpus():
        w = WORD.findall(t)
        n, seen, longest = len(w), collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7)), 0
        again, cover = np.zeros(n, bool), np.zeros(n, bool)
        for k in range(n - 7):
            if seen[tuple(w[k : k + 8])] > 1:
                again[k : k + 8] = True
        for a in range(n):  # longest repeat from each start
            best = 0
            for b in range(n):
                if a != b:
                    m = 0
                    while a + m < n and b + m < n and w[a + m] == w[b + m]:
                        m += 1
                    best = max(best, m)
            if best >= quality.MIN_REPEAT:
                cover[a : a + best] = True
                longest = max(longest, best)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words, r.covered_words, r.longest_repeat) == (len(lines) - len(set(lines)), again.sum(), cover.sum(), longest)
        failed = n < 20 or 100 * int(again.sum()) > 30 * n
        bad = 100 * int(cover.sum()) > quality.MAX_COVERED_PERCENT * n or longest > quality.MAX_LONGEST
        assert (r.base_failed, r.kept) == (failed, not failed and not bad)
        q = query[i]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert (q.covered_words, q.too_long, q.base_failed, q.kept) == (r.covered_words, longest > quality.MAX_LONGEST, r.base_failed, r.kept)


def plain_hash(payload):
    """The cosine hash by its sums."""
    rows = [payload[i : i + 64] for i in range(0, len(payload), 64)]
    n = len(rows)

    def spans(size):
        return [range(k * size // 32, max((k + 1) * size // 32, k * size // 32 + 1)) for k in range(32)] if size >= 32 else [range(k * size // 32, k * size // 32 + 1) for k in range(32)]

    down, across = spans(n), spans(64)
    small = [[sum(rows[y][x] for y in a for x in b) / len(a) / len(b) for b in across] for a in down]
    cosine = [[math.cos(math.pi / 32 * (k + 0.5) * u) for k in range(32)] for u in range(8)]
    half = [[sum(cosine[u][y] * small[y][x] for y in range(32)) for x in range(32)] for u in range(8)]
    low = [round(sum(half[u][x] * cosine[v][x] for x in range(32)), 6) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    return f"{sum(1 << (63 - k) for k, v in enumerate(low) if v > middle):016x}"


def test_media_query(spark, tables):
    got = {r.doc_id: r for r in queries.op10_media(spark, tables).collect()}
    for i, t in corpus():
        raw = t.encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        file = media.png_encode(payload)
        assert media.png_decode(file).tobytes() == payload and r.feature == plain_hash(payload)
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest()) and len(r.feature) == 16


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=700), st.sampled_from([None, 0, 1, 2, 3, 4]))
def test_png_round_trip(data, kind):
    payload = media.padded(data)
    file = media.png_encode(payload, filter_type=kind)
    assert media.png_decode(file).tobytes() == payload
    damaged = bytearray(file)
    damaged[len(file) // 2] ^= 1
    with pytest.raises(ValueError):
        media.png_decode(bytes(damaged))


def test_rows_choose_their_filter():
    flat = np.tile(np.arange(200, 264, dtype=np.int64) % 256, (8, 1)).astype(np.uint8)
    kinds = np.frombuffer(zlib.decompress(media.png_encode(flat.tobytes())[41:-16]), np.uint8).reshape(8, 65)[:, 0]
    assert kinds[0] == 1 and set(kinds[1:]) == {2}


def test_like_images_have_like_hashes():
    r = np.random.default_rng(1)
    image = r.integers(0, 256, (80, 64)).astype(np.uint8)
    other = image.copy()
    other[3, 5] ^= 1
    a, b = (int(media.cosine_hash(x), 16) for x in (image, other))
    assert (a ^ b).bit_count() <= 3


@pytest.fixture(scope="module")
def vocabulary():
    return pieces_codec.load()


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces_codec.MODEL)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(" aeinrst\n\t▁12.,é中-_", max_size=60)), max_size=6))
def test_pieces_equal_the_library(vocabulary, library, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, off = pieces_codec.Encoder(vocabulary)(texts)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:], strict=False)] == [library.encode(t) for t in texts]
    assert pieces_codec.decoded(vocabulary, ids, off) == [t.replace("▁", " ") for t in texts]


def test_sentencepiece_query(spark, tables, library):
    for r in queries.op1_sentencepiece(spark, tables).collect():
        text = dict(corpus())[r.doc_id]
        assert r.ids == library.encode(text) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_long_words_equal_the_library(vocabulary, library):
    r = random.Random(4)
    texts = ["a" * 900, "".join(r.choice("abeinrst") for _ in range(3000)), "中文字" * 400 + "é" * 300, "x" + "ing" * 500 + "▁" * 30 + "y" * 700]
    ids, off = pieces_codec.Encoder(vocabulary)(texts)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:], strict=False)] == [library.encode(t) for t in texts]


def test_merged_equals_lattice(vocabulary):
    r = random.Random(1)
    words = ["▁" + "".join(r.choice("abcdeinorst") for _ in range(r.randint(1, 30))) for _ in range(300)]
    ids, size = vocabulary.encoded(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [vocabulary.merged(w) for w in words]


@pytest.fixture(scope="module")
def tokens():
    return token_counts.Tokens(token_counts.read_ranks())


@settings(max_examples=150, deadline=None)
@given(st.text(" \n\tab's12.,é", max_size=120), st.lists(st.tuples(st.integers(0, 130), st.integers(0, 20), st.text(" \n\tab's1,", max_size=30)), max_size=4))
def test_edited_counts(tokens, text, edits):
    tree = token_counts.CountTree(text, tokens)
    for start, size, new in edits:
        tree.edit(start, start + size, new)
        a, b = min(start, len(text)), min(start + size, len(text))
        text = text[:a] + new + text[b:]
        assert tree.text == text and tree.n_tokens == len(tokens.encoding.encode_ordinary(text))
        tree = token_counts.CountTree(text, tokens, tree.kept())  # goes on from what is kept


def test_edits_recount_little(tokens):
    text = "some words, and more of them.\n" * 4000
    tree = token_counts.CountTree(text, tokens)
    tree.edit(60000, 60003, "new text")
    assert tree.encoded < 20


def test_counts_query(spark, tables, tokens):
    told = {r.doc_id: r.edits for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", token_counts.sample_edits().alias("edits")).collect()}
    for r in queries.op8_token_counts(spark, tables).collect():
        text = dict(corpus())[r.doc_id]
        assert r.n_tokens == len(tokens.encoding.encode_ordinary(text)) and r.n_edits == 3 and r.n_pretokens == len(tokens.split(text))
        for e in told[r.doc_id]:
            text = text[: e.start] + e.new + text[e.stop :]
        assert r.n_tokens_after == len(tokens.encoding.encode_ordinary(text)) and 0 < r.n_recounted <= 60


def test_kept_trees_take_a_table_of_edits(spark, tokens):
    rows = [(1, "one two three"), (2, ""), (None, "no id"), (3, "left as it is")]
    trees = token_counts.count_trees(docs(spark, rows))
    table = spark.createDataFrame([(1, 2, 0, 3, "1"), (1, 1, 4, 7, "2,"), (2, 1, 5, 9, "new text"), (9, 1, 0, 0, "x")], "doc_id long, seq int, start int, stop int, new string")
    once = token_counts.edited(token_counts.with_edits(trees, table), F.col("edits"))
    got = {r.doc_id: r for r in once.collect()}
    want = {1: "1 2, three", 2: "new text", None: "no id", 3: "left as it is"}
    assert {i: r.text for i, r in got.items()} == want and got[3].n_recounted == 0
    for i, r in got.items():
        assert r.n_tokens_after == len(tokens.encoding.encode_ordinary(want[i])) and token_counts.CountTree(r.text, tokens, bytes(r.tree)).n_tokens == r.n_tokens_after


def test_language_model_query(spark, tables):
    got = {r.doc_id: r for r in queries.op5_brown_lm(spark, tables).collect()}
    tok = {i: WORD.findall(t.translate(LOWER)) + [None] for i, t in corpus()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tok}
    c = collections.Counter(w for i in tok if not held[i] for w in tok[i])
    n, v = sum(c.values()), len(c)
    for i, words in tok.items():
        r = got[i]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(words), sum(c[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score < 0


@pytest.mark.parametrize("frequent", [3, 1000])
def test_rare_words_score_the_same(spark, frequent):
    rows = corpus(5)
    one = {r.doc_id: r.score for r in brown_lm.scored(docs(spark, rows), core_words=3, frequent=frequent).collect()}
    two = {r.doc_id: r.score for r in brown_lm.scored(docs(spark, rows), core_words=3, frequent=500).collect()}
    assert one == pytest.approx(two, abs=1e-6)


def test_class_model_is_a_distribution_and_scores_by_it(spark):
    rows = corpus(6, 80)
    text = docs(spark, rows).select("text")
    counts = brown_lm._counted(text)
    m = brown_lm.Model(counts, text, 20, 6, 1 << 20)
    lines = [[int(x) for x in brown_lm.word_hashes(*text_buffer(pa.array([t])))[0]] for _, t in rows]
    shape = {}
    for _, t in rows:
        h, kind, _ = brown_lm.word_hashes(*text_buffer(pa.array([t])))
        shape |= dict(zip(h.tolist(), kind.tolist(), strict=True))
    have = collections.Counter(w for x in lines for w in x)
    of = dict(zip(m.classes.words.tolist(), m.classes.of.tolist(), strict=True))
    assert set(of) == {w for w, k in have.items() if k >= brown_lm.CLASSED_FROM} and all(c < m.classes.n for c in of.values())
    of = {w: of.get(w, m.classes.n + shape[w]) for w in have}
    size = m.classes.end + 1
    tokens, kinds = collections.Counter(), collections.Counter()
    for w, k in have.items():
        tokens[of[w]] += k
        kinds[of[w]] += 1
    for s in range(brown_lm.N_SHAPES):
        kinds[m.classes.n + s] += 1
    emit = lambda c, k: (k + 0.1) / (tokens[c] + 0.1 * kinds[c])
    follow = collections.Counter()
    for x in lines:
        line = [m.classes.end, *[of[w] for w in x], m.classes.end]
        follow.update(zip(line, line[1:], strict=False))
    after = [sum(follow[a, b] for b in range(size)) for a in range(size)]
    step = lambda a, b: (follow[a, b] + 0.5) / (after[a] + 0.5 * size)
    for a in range(size):
        total = sum(step(a, of[w]) * emit(of[w], k) for w, k in have.items()) + step(a, m.classes.end)
        total += sum(step(a, m.classes.n + s) * emit(m.classes.n + s, 0) for s in range(brown_lm.N_SHAPES))
        empty = sum(step(a, c) for c in range(m.classes.n) if not kinds[c])
        assert total + empty == pytest.approx(1)
    train = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    got = {r.doc_id: r.score for r in brown_lm.scored(docs(spark, rows), core_words=20, classes=6).collect()}
    text = docs(spark, train).select("text")
    m = brown_lm.Model(brown_lm._counted(text), text, 20, 6, 1 << 20)
    have = collections.Counter(w for (i, _), x in zip(rows, lines, strict=True) if zlib.crc32(str(i).encode()) % 10 for w in x)
    of = dict(zip(m.classes.words.tolist(), m.classes.of.tolist(), strict=True))
    for (i, _), x in zip(rows, lines, strict=True):
        line = [m.classes.end, *[of.get(w, m.classes.n + shape[w]) for w in x], m.classes.end]
        want = sum(m.step[a, b] for a, b in zip(line, line[1:], strict=False)) + sum(math.log10(have[w] + 0.1) - m.emission[b] for w, b in zip(x, line[1:], strict=False))
        assert got[i] == pytest.approx(want, abs=1e-6)


def test_words_are_put_where_their_neighbours_say():
    """Two kinds of words alternate; a word between members of one kind goes to the other."""
    both = np.array([[0.0, 90, 0], [90, 0, 0], [0, 0, 0]])
    word, context = np.array([0, 0, 1, 1]), np.array([0, 3, 1, 4])
    assert brown_lm.inserted(word, context, np.array([5, 5, 4, 4]), np.array([2, 2]), both, 2).tolist() == [1, 0]


def test_exchange_finds_planted_classes():
    r = np.random.default_rng(3)
    group = np.arange(30) % 2
    count = np.zeros((31, 31))
    for a in range(30):
        for b in range(30):
            count[a, b] = r.poisson(40 if group[a] != group[b] else 2)
    of = brown_lm.exchange(count, 30, 2)
    assert len(set(zip(of[:30].tolist(), group.tolist(), strict=True))) == 2


def test_mixing_meets_targets(spark):
    r = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        kind = "good" if i % 10 < 6 else "low" if i % 10 < 9 else "toxic"
        mark = {"good": "", "low": "!!", "toxic": " scum"}[kind]
        text = " ".join("".join(r.choice("abcde") for _ in range(5)).upper() + mark if kind == "low" else "".join(r.choice("abcde") for _ in range(5)) for _ in range(30)) + mark
        rows.append((i, text))
        if i % 2:
            labels.append((i, 0 if kind == "low" else 1, 1 if kind == "toxic" else 0))
    table = spark.createDataFrame(labels, "doc_id long, quality long, toxic long")
    got = mixing.mixed_rates(docs(spark, rows), table, {"good": 0.8, "low": 0.2, "toxic": 0.0}).toPandas()
    mass = [float((got.rate * got.n_tokens * got[f"p_{d}"]).sum()) for d in mixing.DOMAINS]
    assert mass[1] / sum(mass) == pytest.approx(0.2, abs=0.02) and mass[2] / sum(mass) < 0.05
    assert (got.rate >= 0).all()
    kind = got.doc_id % 10
    assert (got[kind < 6].copies == 1).all() and (got[kind == 9].copies == 0).mean() > 0.95


@pytest.mark.parametrize("low", [7, 8, 9, 12])
def test_copies_meet_the_targets(spark, low):
    kind = F.when(F.col("id") % 100 < low, 1).when(F.col("id") % 100 < low + 3, 2).otherwise(0)
    p = [F.when(kind == k, 0.998).otherwise(0.001).alias(f"p_{d}") for k, d in enumerate(mixing.DOMAINS)]
    table = spark.range(40000).select("id", kind.alias("kind"), F.lit(50).cast("long").alias("n_tokens"), *p, kind.alias("domain"), F.xxhash64("id").alias("draw"))
    rate, fit = mixing.fitted_rates(table, mixing.TARGETS)
    copies = table.select("kind", mixing.drawn_copies(rate, F.col("draw")).alias("copies"))
    got = copies.groupBy("kind").agg(F.sum("copies").alias("n"), F.max("copies").alias("most")).toPandas().set_index("kind")
    assert fit.rests and abs(fit.residual["low"]) < 0.002
    assert got.n[1] / got.n.sum() == pytest.approx(0.05, abs=0.004) and got.n[2] <= 12
    assert got.n[0] == 400 * (97 - low) and got.most[0] == 1


def test_rates_are_the_least_squares_answer(spark):
    """Against a plain solver on the free documents: no nonnegative rates miss the targets by much less."""
    r = np.random.default_rng(5)
    p = r.dirichlet([0.6, 0.5, 0.2], 400)
    size, kind = r.integers(20, 200, 400), p.argmax(1)
    table = spark.createDataFrame([(i, int(size[i]), *map(float, p[i]), int(kind[i]), i) for i in range(400)], "id long, n_tokens long, p_good double, p_low double, p_toxic double, domain int, draw long")
    for targets in ({"good": 0.8, "low": 0.2, "toxic": 0.0}, {"good": 0.6, "low": 0.3, "toxic": 0.1}):
        share = np.array([targets[d] for d in mixing.DOMAINS])
        rate, fit = mixing.fitted_rates(table, targets)
        got = np.array([x.rate for x in table.select("id", rate.alias("rate")).orderBy("id").collect()])
        assert fit.rests and (got >= 0).all()
        a = (p * size[:, None]).T
        fixed = (kind == 0) | ((kind == 2) & (share[2] == 0))
        assert (got[kind == 0] == 1).all() and (got[(kind == 2) & (share[2] == 0)] == 0).all()
        miss = lambda x: ((a @ x - share * (a[0] @ x) / share[0])[1:] / a.sum(1)[1:])
        m = (a - np.outer(share, a[0]) / share[0])[1:] / a.sum(1)[1:, None]
        x = np.where(fixed, got, 1.0)
        step = 1 / np.linalg.norm(m[:, ~fixed], 2) ** 2
        for _ in range(20000):
            x[~fixed] = np.maximum(0, x[~fixed] - step * (m[:, ~fixed].T @ miss(x)))
        assert (miss(got) ** 2).sum() <= (miss(x) ** 2).sum() * 1.1 + 1e-6


def test_main_text():
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav>'
        '<!-- ad --><div class="ad">Buy, now, please.</div><aside><p>Side, bar, text of some length to be found.</p></aside><article><h1>Head &amp; line</h1><p><b>First  para,\n with &lt;tags&gt;.<br><p>Second'
        ' para&#33;</p><form><p>Name, please: <input></form><ul><li>one</li><li>two<li>three</ul><div class="comments"><p>I like, it, a lot, really, I do.</p></div></article><footer>&copy; x</footer></body></html>'
    )
    assert html_text.main_text(page) == "Head & line\n\nFirst para, with <tags>.\n\nSecond para!\n\none\n\ntwo\n\nthree"
    div = '<body><div id="menu"><a href="/">Home</a></div><div class="content"><p>' + "Words, and words. " * 20 + "</p><p>Short.</p></div><div class=sidebar><p>Other, text, that, has, commas, and, is, long.</p></div></body>"
    assert html_text.main_text(div) == " ".join(("Words, and words. " * 20).split()) + "\n\nShort."
    assert html_text.main_text("just text") == "just text" and html_text.main_text("<br><img>") == ""


def plain_article(page):
    """The text of a page with one article and nothing to leave out in it, by cutting at its tags."""
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|ul|li|div)>", body)
    runs = [[html.unescape(" " if x == "<br>" else "" if x.startswith("<") else x) for x in re.split(r"(<[^>]*>)", b)] for b in blocks]
    texts = [" ".join("".join(r).split()) for r in runs]
    return "\n\n".join(t for t in texts if t)


PAGES = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.exists(PAGES), reason="no test tables")
def test_html_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{PAGES}/pages.parquet").collect()}
    got = queries.op2_html(spark, PAGES).collect()
    assert len(got) == len(pages)
    for r in got:
        page = pages[r.page_id]
        assert (r.url, r.text, r.n_chars) == (page.url, plain_article(page.html), len(r.text))
    plain = [re.sub(r"<(/?)(?:nav|article|footer)\b", r"<\1div", p.html) for p in pages.values()]
    same = sum(html_text.main_text(a) == html_text.main_text(p.html) for a, p in zip(plain, pages.values(), strict=True))
    assert same >= 0.95 * len(plain)  # the score alone finds it where no tag tells


def test_references_end_at_markup_and_classes_do_not_hide_paragraphs():
    wrap = lambda x: "<body><article><p>" + "Some words, and others, to begin with. " * 5 + f"</p>{x}</article></body>"
    last = lambda x: html_text.main_text(wrap(x)).split("\n\n")[-1]
    assert last("<p>AT&<!-- x -->lt;b") == "AT&lt;b"
    assert last('<p class="legal notice">A paragraph on law.</p>') == "A paragraph on law."
    assert last("<p>where <math><mi>x</mi>+1</math> holds</p>") == "where x+1 holds"
    assert "like it" not in html_text.main_text(wrap('<div class="comments"><p>I like it.</p></div>'))
    holds = '<body><div class="page widget"><p>' + "Long text, with commas. " * 40 + "</p></div></body>"
    assert html_text.main_text(holds).startswith("Long text, with commas.")


def test_pieces_cover_all_rows():
    raw, off = text_buffer(pa.array(["a" * 10, None, "", "b" * 50, "c"]))
    got = list(pieces(off, 20))
    assert [x for a, b in got for x in range(a, b)] == list(range(5)) and raw.size == 61


@pytest.mark.parametrize("one_id", [None, 7])
def test_rows_of_one_id_are_told_apart(spark, one_id):
    r = random.Random(12)
    words = [f"{r.choice('abcdefgh')}{k}" for k in range(900)]
    passages = [" ".join(r.choice(words) for _ in range(40)) for _ in range(20)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(5, 30))) + " " + r.choice(passages) + " " + " ".join(r.choice(words) for _ in range(10)) for _ in range(1500)]
    texts += texts[:40]
    table = docs(spark, [(one_id, t) for t in texts])
    keyed = repeats.keyed(table, "doc_id", "text").collect()
    line = sorted({(x.d, x.v, x.u): x.text for x in keyed}.items())
    for run, split, size, join in (
        (suffix_dedup.remove_repeated_bytes, lambda t: t.encode(), 100, lambda x, m: np.frombuffer(x, np.uint8)[~m].tobytes()),
        (fm_dedup.remove_repeated_words, WORD.findall, 20, lambda x, m: " ".join(w for w, gone in zip(x, m, strict=True) if not gone).encode()),
    ):
        gone = marks([(who, split(t)) for who, t in line], size)
        want = {t: hashlib.sha256(join(split(t), gone[who])).hexdigest() for who, t in line}
        got = collections.Counter(x.kept_sha256 for x in run(table).collect())
        assert got == collections.Counter(want[t] for t in texts)
        left = b"\n".join(join(split(t), gone[who]) for who, t in line).decode()
        assert all(p in left for p in passages)
