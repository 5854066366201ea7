"""Language-model scores with Brown classes.

The most frequent words are assigned to classes by the exchange algorithm on the
counts of neighbouring symbols in all training documents.  All other words that
occur twice are then put, in distributed sweeps, into the class in which the
likelihood of the class sequence gains most, by the counts of the classes beside
them; words that occur once stand for unseen ones and have a class by their
shape, as those do.  A text's probability is the product over its tokens of class
transition and word emission, both smoothed.

Counts cover every training document and word.  Classes (of at most ``CLASSED``
words; rarer ones have one by their shape) and the counts of the most frequent
words (at most ``FREQUENT``) are sent to all executors, and scored where the text
is; what is left of a document are its rare words, which meet their counts in a
join.  A frequent word is therefore never in a shuffle of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, RangeHash, mixed, partitions, pieces, stored, text_buffer, trimmed, words_of

#: Added to counts of words, and of transitions.
DELTA, ALPHA = 0.1, 0.5
#: Words that the exchange begins with, classes, sweeps over these words, and sweeps that put in all other words.
CORE_WORDS, CLASSES, SWEEPS, INSERTIONS = 1024, 48, 8, 2
#: Occurrences from which a word has a class of its own choice.
CLASSED_FROM = 2
#: Words that choose a class, the most frequent first: at most so many, 10 bytes each on all executors.
CLASSED = 1 << 20
#: Words whose counts are sent to all executors: at most so many, 16 bytes each.  It has no part in the result.
FREQUENT = 1 << 20
#: Words that a task gathers before it hands them on, and numbered words that one step works on.
GATHERED, PASSED_WORDS = 1 << 20, 1 << 18
N_SHAPES = 16
END_HASH = 0


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, their shape classes and the row of each."""
    lower = LOWER[raw]
    starts, ends, row = words_of(lower, off)
    h = RangeHash(lower)(starts, ends)
    last = lower[ends - 1] if len(ends) else lower[:0]
    kind = np.where((last >= 97) & (last <= 122) | (last >= 128), 0, np.where(last == 0x2C, 1, np.where(last == 0x2E, 2, 3)))
    size = ends - starts
    return h, kind * 4 + np.minimum(np.searchsorted((4, 7, 11), size, "left"), 3), row


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the texts with their shapes and numbers, each once for a part of the task, and the ends."""
    held: list[tuple[np.ndarray, ...]] = []
    size = ends = 0

    def flush() -> pa.RecordBatch:
        h, shape, n = (np.concatenate(x) for x in zip(*held, strict=True))
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(inverse.reshape(-1), n, len(u)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(shape[first].astype(np.int8)), pa.array(total)], names=["h", "shape", "n"])

    for batch in batches:
        raw, off = text_buffer(batch.column(0))
        ends += len(off) - 1
        for i, j in pieces(off):
            h, shape, _ = word_hashes(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((u, shape[first], n))
            size += len(u)
            if size > GATHERED:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array([END_HASH], pa.int64()), pa.array([N_SHAPES], pa.int8()), pa.array([ends], pa.int64())], names=["h", "shape", "n"])


class Classes:
    """Classes of words: those of a sorted list of hashes have their own, all others one by shape, after ``n`` others."""

    def __init__(self, words: np.ndarray, of: np.ndarray, n: int):
        self.words, self.of, self.n, self.end = words, of, n, n + N_SHAPES

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words are in the list, and whether they are in it."""
        at = np.minimum(np.searchsorted(self.words, h), max(len(self.words) - 1, 0))
        return at, (self.words[at] == h) if len(self.words) else np.zeros(len(h), bool)

    def __call__(self, h: np.ndarray, shape: np.ndarray) -> np.ndarray:
        at, known = self.places(h)
        return np.where(known, self.of[at], self.n + shape) if len(self.words) else self.n + shape.astype(np.int64)


def _pairs(symbol: np.ndarray, row: np.ndarray, n_rows: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring symbols of each text with an end before and after it, and the row of each pair."""
    n = len(symbol)
    where = np.arange(n) + row  # one end follows each earlier text
    line = np.full(n + n_rows, end)
    line[where] = symbol
    owner = np.repeat(np.arange(n_rows), np.bincount(row, minlength=n_rows) + 1)
    before = np.empty(len(line), np.int64)
    before[1:] = line[:-1]
    before[:1] = end
    return before, line, owner


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(count: np.ndarray, movable: int, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of symbols by the exchange algorithm.

    ``count[a, b]`` says how often ``b`` follows ``a``.  The first ``movable``
    symbols go to the class, of ``classes``, in which the likelihood of the
    class sequence is largest, one symbol at a time, until a sweep moves none;
    each of the other symbols stays a class of its own.
    """
    n = len(count)
    total_classes = classes + n - movable
    of = np.concatenate((np.arange(movable) % max(classes, 1), classes + np.arange(n - movable)))
    member = np.zeros((n, total_classes))
    member[np.arange(n), of] = 1
    count = count.astype(float)
    both = member.T @ count @ member
    into, out_of = count.T @ member, count @ member  # by symbol: what comes before it, and after it, by class

    f = _xlogx
    size_in, size_out = count.sum(0), count.sum(1)
    some = np.arange(classes)
    for _ in range(sweeps):
        moved = False
        for w in range(movable):
            own, old = count[w, w], of[w]
            left, right = into[w].copy(), out_of[w].copy()
            left[old] -= own
            right[old] -= own
            both[:, old] -= left
            both[old, :] -= right
            both[old, old] -= own
            a, b = both[:, :classes].T, both[:classes]
            gain = (f(a + left) - f(a)).sum(1) + (f(b + right) - f(b)).sum(1)
            d, x, y = both[some, some], left[:classes], right[:classes]
            gain += f(d + x + y + own) - f(d + x) - f(d + y) + f(d)
            sums_out, sums_in = b.sum(1), a.sum(1)
            gain -= f(sums_out + size_out[w]) - f(sums_out) + f(sums_in + size_in[w]) - f(sums_in)
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9 * (1 + abs(gain[old])):
                new = int(old)
            both[:, new] += left
            both[new, :] += right
            both[new, new] += own
            if new != old:
                moved = True
                of[w] = new
                into[:, old] -= count[w]
                into[:, new] += count[w]
                out_of[:, old] -= count[:, w]
                out_of[:, new] += count[:, w]
        if not moved:
            break
    return of


def inserted(word: np.ndarray, context: np.ndarray, n: np.ndarray, own: np.ndarray, both: np.ndarray, classes: int) -> np.ndarray:
    """The class, of ``classes``, for each word in which the likelihood of the class sequence gains most.

    ``word`` is a number from 0 for each row, in order; ``context`` a class
    before the word, or ``len(both)`` and a class after it; ``own`` the class of
    each word now, whose counts in ``both`` (class by class) hold those of the
    word.  Words are looked at one by one, against the others as they are.
    """
    size, some = len(both), np.arange(classes)
    beside = np.concatenate((both, both.T))[:, :classes]
    gain = np.zeros((len(own), classes))
    for i in range(0, len(word), 1 << 15):
        w, c, k = word[i : i + (1 << 15)], context[i : i + (1 << 15)], n[i : i + (1 << 15), None].astype(float)
        rest = np.maximum(beside[c] - k * (own[w][:, None] == some), 0)
        np.add.at(gain, w, _xlogx(rest + k) - _xlogx(rest))
    before = context < size
    for mask, totals in ((before, both.sum(0)), (~before, both.sum(1))):
        k = np.bincount(word[mask], n[mask], len(own))[:, None]
        rest = np.maximum(totals[:classes] - k * (own[:, None] == some), 0)
        gain -= _xlogx(rest + k) - _xlogx(rest)
    return gain.argmax(1)


def _numbered(shared):  # noqa: ANN001, ANN202
    """From texts: the number of each word in the sorted list, or of its shape after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        number = Classes(words, np.arange(len(words)), len(words))
        for batch in batches:
            raw, off = text_buffer(batch.column(0))
            for i, j in pieces(off):
                h, shape, row = word_hashes(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                cut = np.searchsorted(row, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(number(h, shape).astype(np.int32)))], names=["words"])

    return run


def _contexts(shared, movable: bool):  # noqa: ANN001, ANN202
    """From numbered texts: how often each class (``context``) is before, or after, each word that may move (``place``), and
    with place -1 - a how often class b (``context``) follows class a.  ``shared`` holds the class of each number, the end's class, and which may move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, end, moves = shared.value
        size = end + 1
        pairs, held, gathered = np.zeros(size * size, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return key, np.bincount(inverse.reshape(-1), np.concatenate([n for _, n in held]), len(key)).astype(np.int64)

        def rows(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((key // (2 * size)).astype(np.int32)), pa.array((key % (2 * size)).astype(np.int32)), pa.array(n)], names=["place", "context", "n"])

        for batch in batches:
            lists = batch.column(0)
            off = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            flat = lists.flatten().to_numpy()
            for i, j in pieces(off, PASSED_WORDS):
                word, row = flat[off[i] : off[j]], np.repeat(np.arange(j - i), np.diff(off[i : j + 1]))
                before, line, _ = _pairs(of[word], row, j - i, end)
                pairs += np.bincount(before * size + line, minlength=len(pairs))
                if not movable:
                    continue
                which = moves[word]
                at = (np.arange(len(word)) + row)[which]  # where the word is in the line
                key = word[which].astype(np.int64) * (2 * size)
                key, n = np.unique(np.concatenate((key + before[at], key + size + line[at + 1])), return_counts=True)
                held.append((key, n))
                gathered += len(key)
                if gathered > GATHERED:
                    held = [merged()]
                    gathered = len(held[0][0])
                    if 2 * gathered > GATHERED:
                        yield rows(*held[0])
                        held, gathered = [], 0
        if gathered:
            yield rows(*merged())
        have = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array((-1 - have // size).astype(np.int32)), pa.array((have % size).astype(np.int32)), pa.array(pairs[have])], names=["place", "context", "n"])

    return run


def _insertion(shared, both: np.ndarray):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, end, _ = shared.value
        for batch in batches:
            place, lists = batch.column(0).to_numpy(), batch.column(1)
            size, told = lists.value_lengths().to_numpy(), lists.flatten()
            if len(place):
                new = inserted(np.repeat(np.arange(len(place)), size), told.field(0).to_numpy(), told.field(1).to_numpy(), of[place].astype(np.int64), both, end - N_SHAPES)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new.astype(np.int32))], names=["place", "class"])

    return run


def _matrix(rows: DataFrame, size: int) -> np.ndarray:
    """Class pairs (at most ``size`` squared) as a matrix."""
    got, out = rows.filter("place < 0").select("place", F.explode("told").alias("t")).select("place", "t.context", "t.n").toArrow(), np.zeros((size, size))
    out[-1 - got["place"].to_numpy(), got["context"].to_numpy()] = got["n"].to_numpy()
    return out


def _least_count(counts: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` words have it or more, as far as bins of counts tell."""
    band = F.when(F.col("n") < 1024, F.col("n")).otherwise(1024 + F.floor(F.log2(F.col("n").cast("double")) * 64)).cast("long")
    bins = counts.filter(F.col("h") != END_HASH).groupBy(band.alias("band")).agg(F.count("*").alias("k"), F.min("n").alias("least")).collect()  # a bounded number
    least, total = 1 << 62, 0
    for b in sorted(bins, key=lambda r: -r.band):
        total += b.k
        if total > most:
            break
        least = b.least
    return least


def _words_from(counts: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (sorted), counts and shapes of the words with a count of ``least`` or more."""
    got = counts.filter((F.col("n") >= least) & (F.col("h") != END_HASH)).select("h", "n", "shape").toArrow()
    h = got["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], got["n"].to_numpy()[order], got["shape"].to_numpy()[order].astype(np.int64)


class Model:
    """What scoring needs besides the counts of rare words; all of bounded size."""

    def __init__(self, counts: DataFrame, texts: DataFrame, core_words: int, classes: int, frequent: int, classed: int = CLASSED):
        context = texts.sparkSession.sparkContext
        self.n, self.v = (int(x or 0) for x in counts.agg(F.sum("n"), F.count("*")).first())
        self.least = _least_count(counts, frequent)
        self.frequent, self.count, _ = _words_from(counts, self.least)
        words, count, shape = _words_from(counts, max(_least_count(counts, classed), CLASSED_FROM))
        given = context.broadcast(words)  # at most CLASSED words
        texts = stored(texts.mapInArrow(trimmed(_numbered(given)), "words array<int>"))
        shapes_too = np.concatenate((shape, np.arange(N_SHAPES)))  # of each number

        def passed(of: np.ndarray, end: int, moves: np.ndarray | None = None) -> tuple:
            shared = context.broadcast((of, end, None if moves is None else np.append(moves, np.zeros(N_SHAPES, bool))))
            rows = texts.mapInArrow(trimmed(_contexts(shared, moves is not None)), "place int, context int, n long")
            # the tasks have added up what they can; one shuffle serves both steps, and a word has at most 2 * size contexts
            rows = rows.repartition(partitions(texts.sparkSession), "place").groupBy("place", "context").agg(F.sum("n").alias("n"))
            return shared, stored(rows.groupBy("place").agg(F.collect_list(F.struct("context", "n")).alias("told")))

        # the exchange: every core word is a symbol of its own, numbered by its count
        core = np.lexsort((words, -count))[:core_words]
        k = len(core)
        symbol = k + shapes_too
        symbol[core] = np.arange(k)
        n_classes = min(classes, max(k, 1))
        of = exchange(_matrix(passed(symbol, k + N_SHAPES)[1], k + N_SHAPES + 1), k, n_classes)
        own, size = n_classes + shapes_too, n_classes + N_SHAPES + 1
        own[core] = of[:k]
        for step in range(INSERTIONS):
            moves = own[: len(words)] >= n_classes if step == 0 else np.ones(len(words), bool)
            shared, rows = passed(own, size - 1, moves)
            got = rows.filter("place >= 0").mapInArrow(_insertion(shared, _matrix(rows, size)), "place int, class int").toArrow()
            own = own.copy()
            own[got["place"].to_numpy()] = got["class"].to_numpy()
        both = _matrix(passed(own, size - 1)[1], size)
        own = own[: len(words)]
        self.classes = Classes(words, own.astype(np.int16), n_classes)
        self.step = np.log10((both + ALPHA) / (both.sum(1, keepdims=True) + ALPHA * size))
        # tokens and words of each class; those of a shape are the words without a class of their own
        tokens, kinds = np.bincount(own, count, size).astype(float), np.bincount(own, minlength=size).astype(float)
        shapes = {r.shape: (r.n, r.v) for r in counts.groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
        for s in range(N_SHAPES):
            have, distinct = shapes.get(s, (0, 0))
            mine = (own < n_classes) & (shape == s)
            tokens[n_classes + s], kinds[n_classes + s] = have - count[mine].sum(), distinct - mine.sum() + 1  # and one for unknown words
        self.emission = np.log10(np.maximum(tokens + DELTA * kinds, 1e-300))  # of each class; what emission is divided by
        self.emission[self.classes.end] = 0.0
        self.base = float(np.log10(self.n + DELTA * (self.v + 1)))
        self.ends = int(shapes.get(N_SHAPES, (0, 0))[0])


_SCORED = [
    ("w1", T.LongType()), ("w2", T.LongType()), ("h", T.LongType()), ("tf", T.LongType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base", T.DoubleType()), ("score", T.DoubleType())
]


def _scoring(shared):  # noqa: ANN001, ANN202
    """A row for each text, and one for each rare word of it; both carry the hashes of the text's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        names = ["id", "held_out", *[n for n, _ in _SCORED]]
        value = np.log10(m.count + DELTA)
        end_value = float(np.log10(m.ends + DELTA))
        for batch in batches:
            raw, off = text_buffer(batch.column(2))
            w1, w2 = (batch.column(k).to_numpy() for k in (3, 4))
            for i, j in pieces(off):
                n_rows = j - i
                h, shape, row = word_hashes(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                before, line, owner = _pairs(m.classes(h, shape), row, n_rows, m.classes.end)
                score = np.bincount(owner, m.step[before, line] - m.emission[line], n_rows)
                u, inverse = np.unique(h, return_inverse=True)
                inverse = inverse.reshape(-1)
                place = np.minimum(np.searchsorted(m.frequent, u), max(len(m.frequent) - 1, 0))
                often = (m.frequent[place] == u) if len(value) else np.zeros(len(u), bool)
                worth = np.where(often, value[place] if len(value) else 0.0, 0.0)[inverse]
                words = np.bincount(row, minlength=n_rows)
                common = np.bincount(row, worth, n_rows)
                known = np.bincount(row[often[inverse]], minlength=n_rows) + (1 if m.ends else 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n_rows), batch.column(1).slice(i, n_rows), pa.array(w1[i:j]), pa.array(w2[i:j]), pa.array(mixed(w1[i:j].view(np.uint64)).view(np.int64)),
                     pa.array(np.zeros(n_rows, np.int64)), pa.array(words + 1), pa.array(known), pa.array(common + end_value - (words + 1) * m.base), pa.array(score + common)],
                    names=names,
                )
                rare = ~often[inverse]
                pair, tf = np.unique(row[rare] * len(u) + inverse[rare], return_counts=True)
                k = len(pair)
                at = i + pair // max(len(u), 1)
                none = [pa.nulls(k, t) for t in (batch.schema.field(0).type, pa.bool_())]
                yield pa.RecordBatch.from_arrays(
                    [*none, pa.array(w1[at]), pa.array(w2[at]), pa.array(u[pair % max(len(u), 1)].view(np.int64)), pa.array(tf.astype(np.int64)),
                     pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64())],
                    names=names,
                )

    return run


def _counted(texts: DataFrame) -> DataFrame:
    return stored(texts.mapInArrow(trimmed(_counts), "h long, shape byte, n long").groupBy("h").agg(F.min("shape").alias("shape"), F.sum("n").alias("n")))


def scored(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", core_words: int = CORE_WORDS, classes: int = CLASSES, frequent: int = FREQUENT
) -> DataFrame:
    """Per row: ``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` (log10).

    Documents whose crc32 of the id as text is a multiple of ten are held out,
    the rest train the model; a null id counts as the empty text (and so is
    held out).  Null text has its end as only token.  Repeated rows are kept and
    counted as often, with equal results; an empty table gives an empty table;
    other columns are not read.
    """
    spark = docs.sparkSession
    held = (F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % 10) == 0
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), held.alias("held_out"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # a row is known by 128 bits of its id and text, so that a task that runs again gives the same
    docs = docs.select("*", F.xxhash64("id", "text").alias("w1"), F.xxhash64(F.lit("row"), "id", "text").alias("w2"))
    texts = docs.filter(~F.col("held_out")).select("text")
    counts = _counted(texts)
    model = Model(counts, texts, core_words, classes, frequent)
    shared = spark.sparkContext.broadcast(model)  # at most FREQUENT and CLASSED words, and classes squared
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), T.StructField("held_out", T.BooleanType()), *[T.StructField(n, t) for n, t in _SCORED]])
    rows = docs.mapInArrow(trimmed(_scoring(shared)), schema)
    rare = counts.filter(F.col("n") < model.least).select("h", F.col("n").alias("have"))
    met = rows.join(rare, "h", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    times = F.count("n_tokens")  # rows that repeat id and text
    more = F.sum(F.col("tf") * F.log10(F.col("have") + F.lit(DELTA))) / times
    out = met.groupBy("w1", "w2").agg(
        F.max("id").alias("id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + (F.sum(F.when(F.col("have") > 0, F.col("tf")).otherwise(0)) / times).cast("long")).alias("n_known"),
        (F.max("base") + more).alias("base_score"), (F.max("score") + more).alias("score"), times.alias("times"),
    )
    out = out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy"))
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
