"""Language identification by string-kernel classification.

The kernel of two texts is the number of letter n-grams of ORDERS that both have (presence, not counts), divided by the root
of the product of how many each has: a blended spectrum. Landmarks from the training sample span the Nyström features of the
kernel, on which one ridge regression for each language is fitted, one against the rest. Whole texts are scored in batches:
presence matrix times landmark matrix times coefficients.

n-grams are hashed to DIMS places. Every language that a row outside the held-out fold has is learned. The training sample is
drawn by a hash of doc_id from these rows: on average SAMPLE rows in all at most, shared evenly by the languages, but not
more than PER_CLASS nor less than LEAST_PER_CLASS of each (all rows of a language that has fewer).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import releasing

ORDERS = (1, 2, 3)
DIMS = 1 << 13
PER_CLASS, LEAST_PER_CLASS, SAMPLE = 300, 30, 6000
#: Landmarks: so many of each language, and so many in all at least.
LANDMARKS_PER_CLASS, LANDMARKS = 4, 128
RIDGE = 1e-2
#: How sharply the margins of the languages become a score.
SHARPNESS = 6.0
UNKNOWN = "und"
BATCH = 128

OUTPUT = ("held_out", "lang_pred", "score")


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def letters(text: str) -> np.ndarray:
    """Code points of the text in lower case, what is no letter as one space."""
    low = text.lower()
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = ((codes >= 97) & (codes <= 122)) | (codes >= 192)
    if codes.size and (other := np.flatnonzero((codes >= 128))).size:
        # beyond ASCII Python knows the letters; each code point is looked up once
        seen, back = np.unique(codes[other], return_inverse=True)
        is_letter[other] = np.fromiter((chr(c).isalpha() for c in seen), bool, len(seen))[back]
    codes = np.where(is_letter, codes, 32)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # one space after each word
    codes = codes[keep]
    return np.concatenate(([np.uint32(32)], codes)) if is_letter.any() else codes[:0]


def presence(text: str, out: np.ndarray) -> bool:
    """Set out (DIMS zeros) to 1 at the text's n-grams; false if it has no letter."""
    codes = letters(text).astype(np.uint64)
    if not len(codes):
        return False
    mix = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(codes) < n:
                break
            h = np.full(len(codes) - n + 1, np.uint64(n), np.uint64)
            for k in range(n):
                h = (h ^ codes[k : len(codes) - n + 1 + k]) * mix
                h ^= h >> np.uint64(29)
            out[(h >> np.uint64(51)).astype(np.int64) % DIMS] = 1
    return True


@dataclass
class Model:
    classes: list[str]
    landmarks: np.ndarray  # DIMS x m, each column divided by its norm
    coefficients: np.ndarray  # m x classes
    bias: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """rows: texts x DIMS of 0 and 1. Margins, texts x classes."""
        norms = np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
        kernel = (rows @ self.landmarks) / norms
        return kernel @ self.coefficients + self.bias


def dense(places: list[np.ndarray]) -> np.ndarray:
    """Texts x DIMS of 0 and 1 from the places of their n-grams."""
    rows = np.zeros((len(places), DIMS), np.float32)
    for row, own in zip(rows, places):
        row[own] = 1
    return rows


def fit(places: list[np.ndarray], labels: list[str], n_landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """One-versus-rest kernel ridge regression on Nyström features; None without rows. places: of each text's n-grams."""
    classes = sorted(set(labels))
    n_landmarks = max(n_landmarks, LANDMARKS_PER_CLASS * len(classes))
    if not classes:
        return None
    index = {c: i for i, c in enumerate(classes)}
    y = np.array([index[c] for c in labels])
    by_class = [np.flatnonzero(y == k) for k in range(len(classes))]
    # landmarks in turn from each language
    chosen = [own[i] for i in range(max(map(len, by_class))) for own in by_class if i < len(own)][:n_landmarks]
    norms = np.sqrt(np.maximum([len(own) for own in places], 1)).astype(np.float32)[:, None]
    landmarks = (dense([places[i] for i in chosen]) / norms[chosen]).T
    within = (landmarks.T @ landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh(within)
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    # a few texts at a time, so that the sample is never dense as a whole
    kernel = [dense(places[at : at + BATCH]) @ landmarks / norms[at : at + BATCH] for at in range(0, len(places), BATCH)]
    features = np.concatenate(kernel).astype(np.float64) @ root
    targets = np.where(y[:, None] == np.arange(len(classes)), 1.0, -1.0)
    # each language weighs the same
    weight = (len(y) / len(classes) / np.array([len(own) for own in by_class]))[y][:, None]
    total = weight.sum()
    mean_x, mean_t = (weight * features).sum(0) / total, (weight * targets).sum(0) / total
    x, t = features - mean_x, targets - mean_t
    beta = np.linalg.solve(x.T @ (weight * x) + ridge * len(y) * np.eye(x.shape[1]) / 100, x.T @ (weight * t))
    coefficients = root @ beta
    return Model(classes, landmarks.astype(np.float32), coefficients.astype(np.float32), (mean_t - mean_x @ beta).astype(np.float32))


def _rows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.zeros((len(texts), DIMS), np.float32)
    known = np.array([bool(t) and presence(t, rows[i]) for i, t in enumerate(texts)], bool)
    return rows, known


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on a bounded sample of the rows with a language outside the held-out fold."""
    usable = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    counts = usable.groupBy(F.col(lang_col).alias("lang")).count().collect()  # one row for each language
    if not counts:
        return None
    wanted = min(PER_CLASS, max(LEAST_PER_CLASS, SAMPLE / len(counts)))
    share = F.map_from_arrays(F.lit([lang for lang, _ in counts]), F.lit([min(1.0, wanted / n) for _, n in counts]))
    drawn = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("language sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = usable.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(drawn < F.coalesce(F.element_at(share, F.col("lang")), F.lit(0.0)))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for text in batch.column(1).to_pylist():
                row = np.zeros(DIMS, np.float32)
                presence(text, row)
                lists.append(np.flatnonzero(row).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2), pa.array(lists, pa.binary())], names=["id", "lang", "places"])

    found = sorted(tuple(r) for r in sample.mapInArrow(lambda batches: releasing(grams(batches)), "id string, lang string, places binary").collect())
    found = [r for r in found if len(r[2])]
    return fit([np.frombuffer(bytes(places), "<u2").astype(np.int64) for _, _, places in found], [lang for _, lang, _ in found])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with held_out, lang_pred and score (0 to 1: the softmax of the languages' margins).

    A text that is null or has no letter is `und` with score 0; so is every text if there was nothing to learn from. Texts
    are read whole; equal texts have equal predictions. Null ids aren't held out. Extra columns stay; one that has the name
    of an output column is replaced. Empty table: empty result.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in OUTPUT])
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                rows, known = _rows(part.column(part.schema.get_field_index(text_col)).to_pylist())
                if model is None:
                    langs, scores = [UNKNOWN] * len(rows), [0.0] * len(rows)
                else:
                    margins = SHARPNESS * model.scores(rows).astype(np.float64)
                    odds = np.exp(margins - margins.max(axis=1, keepdims=True))
                    odds /= odds.sum(axis=1, keepdims=True)
                    best = odds.argmax(axis=1)
                    langs = [model.classes[b] if k else UNKNOWN for b, k in zip(best, known)]
                    scores = [round(float(odds[i, b]), 6) if k else 0.0 for i, (b, k) in enumerate(zip(best, known))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[f.name for f in schema.fields])

    return docs.mapInArrow(lambda batches: releasing(predict(batches)), schema).withColumn("held_out", held_out(id_col))
