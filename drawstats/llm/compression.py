"""Quality scores from how well texts compress with dictionaries of good and of bad text.

Two zstandard dictionaries are built from labelled texts, one a label.  A text
is compressed with both, piece by piece, so that each piece meets the dictionary
anew; the difference of the sizes over their sum says which label it is like.
A logistic regression on other labelled texts turns that, beside how far the text
compresses at all and its length, into a calibrated score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, text_buffer, trimmed, with_columns

#: Learnt from: at most so many labelled documents (those whose ids have the smallest hashes), half of them for the
#: dictionaries, from each label at most so many pieces of their texts (those with the smallest hashes).
MAX_TRAINING, MAX_PIECES = 12000, 2000
#: Bytes of a piece and of a dictionary; zstandard's level.
PIECE, DICTIONARY, LEVEL = 4096, 112 << 10, 3
HELD_OUT, FOLDS, THRESHOLD = 0, 5, 0.3
#: Bytes added to all sizes, so that short texts say little; the pull of weights to zero.
SMOOTHED, RIDGE = 20, 0.5


def trained_dictionary(samples: list[bytes], size: int = DICTIONARY, level: int = LEVEL) -> bytes:
    """A dictionary with entropy tables; of samples too few for one, their bytes themselves."""
    try:
        return zstandard.train_dictionary(size, samples, level=level).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


class Sizes:
    """Compressed sizes of texts under each of two dictionaries."""

    def __init__(self, dictionaries: tuple[bytes, bytes], level: int = LEVEL):
        self.compressors = []
        for data in dictionaries:
            held = zstandard.ZstdCompressionDict(data) if data else None
            if held:
                held.precompute_compress(level=level)
            self.compressors.append(zstandard.ZstdCompressor(level=level, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False))

    def __call__(self, text: memoryview) -> list[int]:
        return [sum(len(c.compress(text[k : k + PIECE])) for k in range(0, len(text), PIECE)) for c in self.compressors]


def evidence(bad: np.ndarray, good: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows of what the score rests on: the normalised difference, the rate, the length, and products."""
    difference = (bad - good) / (bad + good + SMOOTHED)
    rate = np.log((np.minimum(bad, good) + SMOOTHED) / (size + SMOOTHED))
    length = np.log(size + SMOOTHED)
    return np.stack([difference, rate, rate**2, length, difference * length, rate * length], 1)


@dataclass
class Model:
    """Dictionaries of label 0 and 1 and a logistic regression on ``evidence``; without ``weights`` all texts have the score ``share``."""

    dictionaries: tuple[bytes, bytes]
    share: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None

    def score(self, bad: np.ndarray, good: np.ndarray, size: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(size), self.share)
        z = self.weights[0] + ((evidence(bad, good, size) - self.mean) / self.scale) @ self.weights[1:]
        return np.where(size > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), self.share)  # an empty text says nothing


def calibrated(dictionaries: tuple[bytes, bytes], bad: np.ndarray, good: np.ndarray, size: np.ndarray, label: np.ndarray) -> Model:
    """The logistic regression, by Newton's steps; where one label is missing, its share alone."""
    share = float((label.sum() + 1) / (len(label) + 2))
    if not 0 < label.sum() < len(label):
        return Model(dictionaries, share)
    x = evidence(bad, good, size)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    x = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    pull = np.diag([0.0] + [RIDGE] * (x.shape[1] - 1))
    w = np.zeros(x.shape[1])
    w[0] = np.log(share / (1 - share))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + pull + 1e-9 * np.eye(len(w)), x.T @ (label - p) - pull @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return Model(dictionaries, share, mean, scale, w)


def fold(id_col: str) -> F.Column:
    """The id's remainder that decides who is held out (null as an empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), F.lit(FOLDS))


def sized(docs: DataFrame, dictionaries: tuple[bytes, bytes], text_col: str) -> DataFrame:
    """All columns but the text, with ``bad``, ``good`` and ``size``: the whole text's bytes under each dictionary, and as they are."""
    others = [f for f in docs.schema if f.name != text_col]
    ordered = with_columns(docs, *(f.name for f in others), text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(dictionaries)
        for batch in batches:
            raw, off = text_buffer(batch.column(len(others)))
            for i, j in pieces(off):
                both = [sizes(memoryview(raw[off[r] : off[r + 1]])) for r in range(i, j)]
                arrays = [pa.array([x[k] for x in both], pa.int64()) for k in (0, 1)] + [pa.array(off[i + 1 : j + 1] - off[i:j])]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(len(others))), *arrays], names=[*(f.name for f in others), "bad", "good", "size"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "bad long", "good long", "size long"])
    return ordered.mapInArrow(trimmed(run), schema)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_training: int) -> DataFrame:
    """``label``, ``h`` (a hash of the id) and ``text`` of at most ``max_training`` labelled ids that are not held out.

    Of several labels of an id the larger holds, of several texts the one with the smallest hash.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id") != HELD_OUT))
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").cast("int").alias("label"))
    sample = known.withColumn("h", F.xxhash64(F.lit("compression"), "id")).orderBy("h", "id").limit(max_training)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # at most max_training rows of three numbers
    return texts.join(F.broadcast(sample), "id").groupBy("id", "label", "h").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).drop("id")


def cut(texts: DataFrame) -> DataFrame:
    """``label``, ``h`` and ``piece`` of the texts, whole, in pieces of at most ``PIECE`` bytes; ``h`` is the piece's own hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffer(batch.column(1))
            for i, j in pieces(off):
                cuts = [(r, k) for r in range(i, j) for k in range(off[r], off[r + 1], PIECE)]
                label = batch.column(0).take(pa.array([r for r, _ in cuts], pa.int64()))
                yield pa.RecordBatch.from_arrays([label, pa.array([raw[k : min(k + PIECE, off[r + 1])].tobytes() for r, k in cuts], pa.binary())], names=["label", "piece"])

    return texts.select("label", "text").mapInArrow(trimmed(run), "label int, piece binary").withColumn("h", F.xxhash64("piece"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_training: int = MAX_TRAINING, max_pieces: int = MAX_PIECES) -> Model:
    """Dictionaries from one half of the sample, the regression from the other (documented bounds: ``max_training`` documents, ``max_pieces`` pieces a label)."""
    known = labelled(docs, labels, id_col, text_col, max_training)
    in_half = F.pmod(F.col("h"), F.lit(2))
    parts = cut(known.filter(in_half == 0))
    # at most max_pieces rows of PIECE bytes
    samples = [[r.piece for r in parts.filter(F.col("label") == k).dropDuplicates(["piece"]).orderBy("h", "piece").limit(max_pieces).select("piece").collect()] for k in (0, 1)]
    dictionaries = tuple(trained_dictionary([bytes(p) for p in s]) for s in samples)
    # at most max_training rows of five numbers
    got = sized(known.filter(in_half == 1), dictionaries, "text").toArrow().sort_by([("h", "ascending")])
    bad, good, size, label = (got[c].to_numpy().astype(float) for c in ("bad", "good", "size", "label"))
    return calibrated(dictionaries, bad, good, size, label)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, max_training: int = MAX_TRAINING) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``held_out``, ``score`` (0 to 1, higher where label 1 is likelier) and ``predicted``.

    Held out are ids whose CRC-32 leaves no rest by five; no label of theirs is
    learnt.  A score depends on the text alone, so equal texts have equal
    scores.  Null text is empty, and an empty text has the share of label 1; a
    null id is held out, as an empty id would be.  Without labels all scores are
    0.5, with one label alone they are its smoothed share.  Repeated rows are kept;
    an empty table gives an empty one; other columns are not read.
    """
    model = train(docs, labels, id_col, text_col, max_training)
    sizes = sized(with_columns(docs, id_col, text_col).withColumn("held_out", fold(id_col) == HELD_OUT), model.dictionaries, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.score(*(batch.column(k).to_numpy().astype(float) for k in (2, 3, 4)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    return sizes.mapInArrow(trimmed(run), f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
