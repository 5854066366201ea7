"""Mixing documents to target weights with soft domain membership.

A classifier learnt from a bounded sample of the labelled table gives each
document a posterior over domains.  Document rates then come from least
squares: rates of at least zero under which the expected tokens of each domain,
the sum of rate x tokens x posterior, meet the targets.  Projected gradient
descent needs, for each step, only the domains' totals: one aggregation over
all documents.  A document's rate is a function of its posterior and of the
steps so far, so nothing but a few numbers a step is on the driver.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SPACE, RangeHash, pieces, stored, text_buffer, trimmed, words_of

DOMAINS = ("good", "low", "toxic")
TARGETS = {"good": 0.95, "low": 0.05, "toxic": 0.0}
#: The classifier learns from at most so many labelled documents, those whose ids have the smallest hashes.
MAX_TRAINING = 8000
#: Hashed features; the first few are bands of the shares below.
FEATURE_BITS = 16
N_SHARES, BANDS = 5, 10
#: Leading bytes of a word that are a feature of their own.
STEM = 4
#: The relative miss of the targets at which steps end, the share of the squared miss that a step must take off for
#: another to follow, and steps at most (an error: the rates still move).
CLOSE, WORTH, STEPS = 1e-4, 5e-3, 400
#: A share that misses its target by more is logged.
REPORTED = 0.005
log = logging.getLogger(__name__)
_TRAIL = np.zeros(256, bool)
_TRAIL[list(b",.;:!?")] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>!")] = True


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and features that are present (each pair once, in order), and words per row."""
    n_rows = len(off) - 1
    starts, ends, row = words_of(raw, off)
    n_words = np.bincount(row, minlength=n_rows)
    lower = LOWER[raw]
    inner = ends - ((ends - starts > 1) & _TRAIL[raw[ends - 1]]) if len(ends) else ends
    hashes = RangeHash(lower)
    dims, reserved = np.uint64((1 << FEATURE_BITS) - N_SHARES * BANDS), N_SHARES * BANDS
    word = hashes(starts, inner)
    stem = hashes(starts, np.minimum(starts + STEM, inner)) ^ np.uint64(0x9E3779B97F4A7C15)
    parts = [(row << FEATURE_BITS) + reserved + (h % dims).astype(np.int64) for h in (word, stem)]

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[off[1:]] - total[off[:-1]]

    solid = np.maximum(per_row(~SPACE[raw]), 1)
    distinct = np.bincount(np.unique((row << 48) | (word >> np.uint64(16)).astype(np.int64)) >> 48, minlength=n_rows) if len(row) else np.zeros(n_rows, np.int64)
    shares = [
        per_row(_SYMBOL[raw]) / solid, per_row((raw >= 65) & (raw <= 90)) / solid, distinct / np.maximum(n_words, 1),
        np.minimum(n_words / 200, 1), np.minimum(solid / np.maximum(n_words, 1) / 20, 1),
    ]
    at = np.arange(n_rows) << FEATURE_BITS
    parts += [at + k * BANDS + np.minimum((s * BANDS).astype(np.int64), BANDS - 1) for k, s in enumerate(shares)]
    pairs = np.unique(np.concatenate(parts))
    return pairs >> FEATURE_BITS, pairs & ((1 << FEATURE_BITS) - 1), n_words


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Classifier:
    """Weights (features x classes) for classes made more equal than they are, and what that adds to each class."""

    weights: np.ndarray
    added: np.ndarray


def fit(row: np.ndarray, feature: np.ndarray, label: np.ndarray, n_classes: int, rounds: int = 60, rate: float = 0.1, l2: float = 3e-3, balance: float = 0.7) -> Classifier:
    """A softmax regression on present features, by full-batch adaptive steps, with rare classes weighted up.

    Features are scaled by the log ratio of their shares inside and outside a
    class, so that the few words that tell a class apart outweigh the many that
    happen to; features of few documents are left out.
    """
    n, dims = len(label), 1 << FEATURE_BITS
    out = np.zeros((dims, n_classes))
    if not n:
        return Classifier(out, np.zeros(n_classes))
    used = np.flatnonzero(np.bincount(feature, minlength=dims) >= min(20, max(3, n // 200)))
    place = np.full(dims, -1)
    place[used] = np.arange(len(used))
    column = place[feature]
    row, column = row[column >= 0], column[column >= 0]
    truth = np.eye(n_classes)[label]
    count = truth.sum(0)
    inside = np.stack([np.bincount(column, truth[row, k], len(used)) for k in range(n_classes)], 1)
    outside = inside.sum(1, keepdims=True) - inside
    ratio = np.log((inside + 1) / (count + 2)) - np.log((outside + 1) / (n - count + 2))
    weight = (n / np.maximum(count, 1)) ** balance
    sample = weight[label] / weight[label].sum()
    w, bias = np.zeros((len(used), n_classes)), np.log((count + 0.1) / n)
    square, bias_square = np.full_like(w, 1e-8), np.full(n_classes, 1e-8)
    for _ in range(rounds):
        scaled = w * ratio
        z = bias + np.stack([np.bincount(row, scaled[column, k], n) for k in range(n_classes)], 1)
        error = (_softmax(z) - truth) * sample[:, None]
        grad = np.stack([np.bincount(column, error[row, k], len(used)) for k in range(n_classes)], 1) * ratio + l2 * w
        square += grad**2
        w -= rate * grad / np.sqrt(square)
        down = error.sum(0)
        bias_square += down**2
        bias -= rate * down / np.sqrt(bias_square)
    out[used] = w * ratio
    out[:BANDS] += bias  # each document has one band of the first share
    return Classifier(out, np.log(weight))


def posteriors(classifier: Classifier, row: np.ndarray, feature: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors under the true shares of the classes, and the class decided on with rare classes weighted up."""
    weights = classifier.weights
    z = np.clip(np.stack([np.bincount(row, weights[feature, k], n_rows) for k in range(weights.shape[1])], 1), -30, 30)
    return _softmax(z - classifier.added), z.argmax(1)


def domain_labels(labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``domain`` (its number) of the labelled table; rows without labels are left out, of several one is taken."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    return labels.select("doc_id", domain.alias("domain")).filter("domain IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("domain").alias("domain"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_training: int = MAX_TRAINING) -> Classifier:
    """The classifier, learnt from at most ``max_training`` labelled documents (a documented bound); of rows that
    repeat an id the text with the smallest hash is taken."""
    sample = domain_labels(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_training)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    # the sample has at most max_training rows of two numbers
    chosen = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "domain").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffer(batch.column(2))
            for i, j in pieces(off):
                row, feature, _ = features(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                cut = np.searchsorted(row, np.arange(j - i + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(feature, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), lists], names=["id", "domain", "features"])

    # at most max_training rows of at most 2 ** FEATURE_BITS numbers
    got = chosen.mapInArrow(trimmed(run), "id long, domain int, features array<int>").toArrow().sort_by("id")
    lists = got["features"].combine_chunks()
    size = lists.value_lengths().to_numpy()
    return fit(np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy(), got["domain"].to_numpy(), len(DOMAINS))


def classified(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``n_tokens`` (words), a posterior ``p_<domain>``, ``domain`` (the number of the one decided on) and ``draw`` (a hash of id and text) for each row, and ``rest`` with the columns ``k0``, ``k1``, .. to keep."""
    small = Classifier(classifier.weights.astype(np.float32), classifier.added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffer(batch.column(1))
            for i, j in pieces(off):
                row, feature, n_words = features(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                p, domain = posteriors(small, row, feature, j - i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n_words.astype(np.int64)), *(pa.array(p[:, k].astype(np.float64)) for k in range(len(DOMAINS))), pa.array(domain.astype(np.int32)),
                     *(batch.column(k).slice(i, j - i) for k in range(2, batch.num_columns))],
                    names=["id", "n_tokens", *DOMAINS, "domain", *batch.schema.names[2:]],
                )

    columns = [F.col(f"`{c}`") for c in (id_col, text_col)]
    draw = F.xxhash64(F.lit("mixing"), *columns).alias("draw")
    rest = [F.struct(*[F.col(f"`{c}`").alias(f"k{k}") for k, c in enumerate(keep)]).alias("rest")] if keep else []
    source = docs.select(*columns, draw, *rest)
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), *[T.StructField(f"p_{d}", T.DoubleType()) for d in DOMAINS], T.StructField("domain", T.IntegerType()), *source.schema.fields[2:]]
    )
    return source.mapInArrow(trimmed(run), schema)


def _sums(scored: DataFrame, columns: list[F.Column]) -> np.ndarray:
    got = scored.agg(*[F.coalesce(F.sum(c * F.col("n_tokens")), F.lit(0.0)) for c in columns]).first()
    return np.array(got, float)


@dataclass
class Fit:
    """How a fit ended: the domains' shares of the tokens, how far they are from the targets, steps, and whether it came to rest."""

    shares: dict[str, float]
    residual: dict[str, float]
    steps: int
    rests: bool


def fitted_rates(scored: DataFrame, targets: dict[str, float], steps: int = STEPS) -> tuple[F.Column, Fit]:
    """The rate of a document as a column over ``scored``, and how the fit ended.

    The domain with the largest target leads.  Documents decided to be of it
    have the rate 1, those of a domain with the target zero the rate 0, and the
    others' rates bring the other domains to their share beside the leading
    one.  Steps end when the targets are met or a step gains nothing: where
    targets cannot be met, that is the least-squares answer.  Raises if the
    rates do not come to rest.
    """
    share = np.array([targets[d] for d in DOMAINS], float)
    if (share < 0).any() or share.sum() <= 0:
        raise ValueError("targets must not be negative, and not all zero")
    share /= share.sum()
    p = [F.col(f"p_{d}") for d in DOMAINS]
    lead = int(np.argmax(share))
    other = [k for k in range(len(DOMAINS)) if k != lead]
    decided = F.col("domain")
    fixed = F.when(decided == lead, 1.0)
    for k in other:
        if share[k] == 0:
            fixed = fixed.when(decided == k, 0.0)
    taken: list[F.Column] = []

    def rated() -> F.Column:
        """The rate after the steps taken; they are data, so that plans do not grow with them."""
        if not taken:
            return F.coalesce(fixed, F.lit(1.0))
        moved = F.aggregate(F.array(*taken), F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - sum((p[k] * s[i] for i, k in enumerate(other)), F.lit(0.0))))
        return F.coalesce(fixed, moved)

    rate = rated()
    free = F.isnull(fixed).cast("double")
    sums = _sums(scored, [*[rate * c for c in p], F.lit(1.0), *p, *[free * p[i] * p[j] for i in other for j in other]])
    now, words, scale = sums[: len(p)], sums[len(p)], sums[len(p) + 1 :][: len(p)]

    def ended(n: int, rests: bool) -> Fit:
        have = now / now.sum() if now.sum() > 0 else share
        out = Fit(dict(zip(DOMAINS, have.tolist(), strict=True)), dict(zip(DOMAINS, (have - share).tolist(), strict=True)), n, rests)
        if not rests or np.abs(have - share).max() > REPORTED:
            log.warning("mixing: targets %s, shares %s after %d steps%s", targets, out.shares, n, "" if rests else ", not at rest")
        return out

    if words <= 0:
        return rate, ended(0, True)
    scale = np.maximum(scale, 1e-9 * words)[other]
    # the longest step that cannot overshoot
    bend = np.linalg.eigvalsh(sums[2 * len(p) + 1 :].reshape(len(other), -1) / np.sqrt(np.outer(scale, scale))).max()
    if bend <= 0:
        return rate, ended(0, True)
    last = np.inf
    for n in range(steps):
        off = now - share * now[lead] / share[lead]
        square = float(((off[other] / scale) ** 2).sum())
        if np.abs(off).max() <= CLOSE * now.sum() or square >= (1 - WORTH) * last:
            return rate, ended(n, True)
        last, miss = square, off[other] / scale / bend
        taken.append(F.array(*[F.lit(float(m)) for m in miss]))
        new = rated()
        rate, now = new, _sums(scored, [new * c for c in p])
    raise RuntimeError(f"mixing: rates do not rest after {steps} steps; shares {ended(steps, False).shares}")


def drawn_copies(rate: F.Column, draw: F.Column) -> F.Column:
    """The whole part of the rate, and one more with the rest as its chance, so that the expected copies are the rate."""
    chance = F.pmod(draw, F.lit(1 << 20)) / (1 << 20)
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("int")).cast("long")


def mixed_rates(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Per row: ``id_col``, ``n_tokens``, the posteriors, ``rate`` and ``copies`` (and ``rest`` with the columns to keep).

    ``copies`` is drawn by a hash of id and text so that its expectation is the
    rate.  A document decided to be of the leading domain has one copy, of one
    with the target zero none.
    Null text has no tokens (and a rate like any other); without labels all
    domains are equally likely.  Repeated rows and null ids are kept; an empty
    table gives an empty table; other columns are not read.
    """
    scored = stored(classified(docs, train(docs, labels, id_col, text_col), id_col, text_col, keep))
    rate, _ = fitted_rates(scored, targets)
    return scored.withColumn("rate", rate).withColumn("copies", drawn_copies(F.col("rate"), F.col("draw"))).drop("draw")
