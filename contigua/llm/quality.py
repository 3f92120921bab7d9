"""Operator 5: a compression classifier: zstandard dictionaries of good and bad text, calibrated to a score."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, materialise

BLOCK = 1024
LEVEL = 3
DICT_BYTES = 112 * 1024
#: What is fitted on: so many documents and blocks of them for each dictionary, twice so many documents for calibration.
MAX_DOCUMENTS, MAX_BLOCKS = 4000, 6000
MAX_CALIBRATION = 3000


def blocks(raw: bytes) -> list[bytes]:
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


def dictionary(samples: list[bytes]) -> tuple[bytes, bool]:
    """A dictionary, and whether it is raw content: too few samples to train on are their own dictionary."""
    if sum(map(len, samples)) < 8 * DICT_BYTES:
        return b"".join(samples)[-DICT_BYTES:].rjust(8, b" "), True
    return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes(), False


class Sizes:
    """Compressed sizes of a text under either dictionary, block by block, so that all of it meets them."""

    def __init__(self, good: tuple[bytes, bool], bad: tuple[bytes, bool]) -> None:
        self.packers = [self._packer(*x) for x in (good, bad)]

    @staticmethod
    def _packer(raw: bytes, is_raw: bool):
        kind = zstandard.DICT_TYPE_RAWCONTENT if is_raw else zstandard.DICT_TYPE_FULLDICT
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind), write_content_size=False, write_dict_id=False).compress

    def features(self, raw: bytes) -> tuple[float, float, float]:
        """The size difference over the sum of sizes; the log of the sizes' share of the text; its square.

        A text's own repetition hides the difference, which is what the share is for. Empty: all 0.
        """
        if not raw:
            return 0.0, 0.0, 0.0
        good, bad = (sum(len(pack(b)) for b in blocks(raw)) for pack in self.packers)
        share = math.log((good + bad) / (2 * len(raw)))
        return (bad - good) / (bad + good), share, share * share


@dataclass(frozen=True)
class Model:
    good: tuple[bytes, bool]
    bad: tuple[bytes, bool]
    weights: tuple[float, ...]

    def score(self, features: tuple[float, ...]) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], features, strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression of labels by Newton's method, slightly ridged. Without both labels: their smoothed share."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return (math.log(share / (1 - share)), *[0.0] * x.shape[1])
    mean, std = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-12)
    a = np.column_stack((np.ones(len(y)), (x - mean) / std))
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(len(w)), a.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    slope = w[1:] / std
    return (float(w[0] - slope @ mean), *map(float, slope))


def sample(docs: DataFrame, labels: DataFrame, max_documents: int, max_calibration: int) -> DataFrame:
    """(raw, label, part, h) of a bounded sample of training rows; part 0 is for dictionaries, part 1 for calibration.

    The sample is that with the smallest hashes h: the same at every run, and spread over the whole table. It is drawn
    from the ids of the labels, so that texts aren't moved: the chosen ids, at most 2 * (max_documents +
    max_calibration), go to the texts. A document with several labels takes the smallest; null labels are none.
    """
    one = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label")).where(crc_mod("doc_id", 3) != 1)
    name = F.col("doc_id").cast("string")
    one = one.withColumns({"part": (F.crc32(F.concat(F.lit("part"), name).cast("binary")) % 2).cast("int"), "h": F.md5(name.cast("binary"))})
    drawn = [one.where((F.col("part") == 0) & (F.col("label") == y)).orderBy("h").limit(max_documents) for y in (0, 1)]
    # Labels are independent of the hash: the share of each label in the sample is that of the table.
    drawn.append(one.where("part = 1").orderBy("h").limit(2 * max_calibration))
    chosen = docs.sparkSession.createDataFrame([tuple(r) for d in drawn for r in d.collect()], "doc_id long, label int, part int, h string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    return materialise(texts.join(F.broadcast(chosen), "doc_id").select("raw", "label", "part", "h"), "quality-sample")


def fit(docs: DataFrame, labels: DataFrame, *, max_documents: int = MAX_DOCUMENTS, max_blocks: int = MAX_BLOCKS, max_calibration: int = MAX_CALIBRATION) -> Model:
    """Fits on a bounded sample of labelled rows: max_documents of each label, cut to max_blocks blocks, for the
    dictionaries; twice max_calibration for the calibration."""
    rows = sample(docs, labels, max_documents, max_calibration)

    def to_blocks(batches):
        for batch in batches:
            label, block = [], []
            for raw, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                cut = [b for b in blocks(raw.as_py()) if len(b) >= 8]
                block += cut
                label += [y] * len(cut)
            yield pa.RecordBatch.from_pydict({"label": pa.array(label, pa.int32()), "block": pa.array(block, pa.binary())})

    cut = rows.where("part = 0").select("raw", "label").mapInArrow(to_blocks, "label int, block binary").withColumn("h", F.md5("block"))
    drawn = [[bytes(r.block) for r in cut.where(F.col("label") == y).orderBy("h").limit(max_blocks).collect()] for y in (1, 0)]
    good, bad = map(dictionary, drawn)

    def to_features(batches):
        sizes = Sizes(good, bad)
        for batch in batches:
            found = [sizes.features(raw.as_py()) for raw in batch.column(0)]
            yield pa.RecordBatch.from_pydict({"label": batch.column(1)} | {f"x{k}": pa.array([f[k] for f in found], pa.float64()) for k in range(3)})

    got = rows.where("part = 1").select("raw", "label").mapInArrow(to_features, "label int, x0 double, x1 double, x2 double").collect()
    got.sort()
    x, y = np.array([[r.x0, r.x1, r.x2] for r in got]).reshape(-1, 3), np.array([r.label for r in got], float)
    return Model(good, bad, calibrate(x, y))


def score_of(model: Model):
    """The score of a column of texts, as a function on columns: texts go to Python, numbers come back."""

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sizes = Sizes(model.good, model.bad)
        for texts in parts:
            yield pa.array([model.score(sizes.features(t.as_buffer().to_pybytes() if t.is_valid else b"")) for t in texts], pa.float64())

    return score


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score, predicted: all their columns stay, a column of either name is replaced. Null text is empty."""
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*own, score_of(model)(F.col("text").cast("string")).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, by a model of labelled rows that are not held out.

    Repeated rows are scored alike; without labels every score is one half.
    """
    found = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels))
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the documents that the model predicts to be bad; all columns stay as they are, whatever their names.

    Null and empty texts have the model's score of an empty text; repeated rows stay or go together; an empty table stays
    empty. Texts of any length are compressed whole, block by block.
    """
    return docs.where(score_of(model)(F.col("text").cast("string")) >= 0.5)
