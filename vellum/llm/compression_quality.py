"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on texts labelled good and one on texts labelled bad. A text is compressed
once with each; the difference of the two sizes per byte says which kind of text it resembles, and a logistic curve
fitted on other labelled texts (Platt scaling, weighted to the classes' shares among the labels) turns it into the
probability of label 1.

A dictionary helps the start of a frame only, so the difference per byte shrinks with a frame's length. A longer text is
therefore compressed in consecutive chunks of the length that the curve was fitted on, a frame to each, and the chunks'
differences are combined by length.

Fitting uses a bounded, documented sample: at most `per_class` labelled rows of each class, the first by a hash of
doc_id, each by its first `fit_chars` code points. Half of them (by the same hash) make the dictionaries, the others the
curve. Scoring reads every row and its whole text. The model is two dictionaries of `dict_bytes` each and three numbers,
so what goes to the executors has a fixed size.
"""

from __future__ import annotations

import dataclasses
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import by_batch

PER_CLASS = 3000
FIT_CHARS = 4096
DICT_BYTES = 65536
LEVEL = 3
#: Added to the length in bytes, so that a few bytes of header don't decide about short texts.
SOFTEN = 16
#: A line that so many of the sampled texts have isn't learned from.
SHARED = 3


def _compressors(good: bytes, bad: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    out = []
    for raw in (good, bad):
        known = zstandard.ZstdCompressionDict(raw) if raw else None
        if known:
            known.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_checksum=False))
        else:
            out.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False))
    return out[0], out[1]


def difference(text: str, by_good: zstandard.ZstdCompressor, by_bad: zstandard.ZstdCompressor, chunk: int) -> float:
    """How many bytes per byte of text the good texts' dictionary saves against the bad texts', in frames of chunk code points."""
    frames = [text[at : at + chunk].encode("utf-8", "replace") for at in range(0, len(text), chunk)] or [b""]
    saved = sum(len(by_bad.compress(f)) - len(by_good.compress(f)) for f in frames)
    return saved / (sum(map(len, frames)) + SOFTEN * len(frames))


@dataclasses.dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float
    chunk: int = FIT_CHARS

    def score_all(self, texts: list[str | None]) -> np.ndarray:
        by_good, by_bad = _compressors(self.good, self.bad)
        z = np.array([difference(t or "", by_good, by_bad, self.chunk) for t in texts], dtype=float)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.intercept, -40, 40)))


def _logistic(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Newton's method with a little ridge; two numbers."""
    scale = float(z.std()) or 1.0
    x = np.stack([z / scale, np.ones_like(z)], 1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (w * (y - p)) - np.array([1e-3, 0]) * b
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-9])
        step = np.linalg.solve(h, g)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0] / scale), float(b[1])


def _dictionary(texts: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICT_BYTES, texts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few texts for the trainer: the texts themselves serve as the dictionary
        return b"\n".join(texts)[-DICT_BYTES:]


def fit_texts(rows: list[tuple[str, int]], share_good: float, fit_chars: int = FIT_CHARS) -> Model:
    """rows: (text of fit_chars at most, label 0 or 1) in a fixed order; without rows of both classes every text scores share_good. Lines that
    several of the sampled texts share (licences, mastheads) tell nothing about either class and are left out here."""
    seen = Counter(line for t in {t for t, _ in rows} for line in {*t.split("\n")})
    plain = lambda t: "\n".join(line for line in t.split("\n") if seen[line] < SHARED)
    own = {y: list(dict.fromkeys(s for t, k in rows if k == y and (s := plain(t)))) for y in (0, 1)}
    prior = min(max(share_good, 1e-6), 1 - 1e-6)
    if min(len(own[0]), len(own[1])) < 2:
        return Model(b"", b"", 0.0, math.log(prior / (1 - prior)), fit_chars)
    good, bad = (_dictionary([t.encode("utf-8", "replace") for t in own[y][::2]]) for y in (1, 0))
    by_good, by_bad = _compressors(good, bad)
    z = np.array([difference(t, by_good, by_bad, fit_chars) for y in (1, 0) for t in own[y][1::2]])
    y = np.array([y for y in (1, 0) for _ in own[y][1::2]], dtype=float)
    n1, n0 = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    w = np.where(y == 1, prior / n1, (1 - prior) / n0) * len(y)
    return Model(good, bad, *_logistic(z, y, w), fit_chars)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, fit_chars: int = FIT_CHARS) -> Model:
    """docs: doc_id, text; labels: doc_id, quality. Labels of rows that are held out, null or neither 0 nor 1 are unused."""
    known = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    shares = known.groupBy("quality").count().collect()
    count = {r["quality"]: r["count"] for r in shares}
    order = [F.xxhash64(F.col("doc_id")), F.col("doc_id"), F.col("quality")]
    parts = [known.where(F.col("quality") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    picked = F.broadcast(parts[0].unionByName(parts[1]).distinct())  # 2 * per_class rows at most
    texts = docs.select("doc_id", F.substring("text", 1, fit_chars).alias("text")).join(picked, "doc_id")
    rows = sorted((str(r["doc_id"]), r["text"] or "", r["quality"]) for r in texts.collect())
    return fit_texts([(t, y) for _, t, y in rows], count.get(1, 0) / max(1, sum(count.values())), fit_chars)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of docs (doc_id, text; other columns are left out): doc_id, score. Null and empty texts score by the curve
    at the difference of two empty frames; repeated rows score alike; an empty table gives an empty one."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), pa.array(sent.value.score_all(batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return by_batch(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, fit_chars: int = FIT_CHARS) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.5) of every row of docs (other columns are left out). A null doc_id isn't
    held out; null and empty texts have the score of an empty text; a doc_id with labels of both classes counts for both;
    without rows of both classes every text scores the share of label 1."""
    scored = score(docs, fit(docs, labels, per_class, fit_chars))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, reject_below: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score reject_below or more. The row itself goes through the scorer, so rows with
    the same doc_id are judged each by its own text and no join is needed."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(sent.value.score_all(batch.column(at).to_pylist()) >= reject_below))

    return by_batch(docs, run, docs.schema)
