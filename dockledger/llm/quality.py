"""Quality scores from how well texts compress with dictionaries of good and bad text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockledger.llm.ranges import fresh, saved, slices

# Bound of the fitting sample: labelled rows.
FIT_ROWS = 12_000
# Bytes of a chunk for a dictionary, and about how many chunks the driver takes of each class.
CHUNK = 512
CHUNKS = 98_304
# Most bytes compressed in one go; a longer text is all of its blocks, each as large as the others.
BLOCK = 4_096
DICTIONARY_BYTES = 200_000
LEVEL = 3
# Strength of the ridge for each calibration row, on features of unit variance.
RIDGE = 1e-4
_FEATURES = 5


@dataclass(frozen=True)
class CompressionModel:
    """Two dictionaries and the weights that turn compressed sizes into a probability."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def scorer(self):
        plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        good, bad = (
            zstandard.ZstdCompressor(
                level=LEVEL, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(d)
            )
            if d else plain
            for d in (self.good, self.bad)
        )

        def features(text: str) -> list[float]:
            raw = text.encode("utf-8", "replace")
            n = max(1, -(-len(raw) // BLOCK))
            step = max(1, -(-len(raw) // n))
            blocks = [raw[i : i + step] for i in range(0, len(raw), step)] or [b""]
            size = len(raw) + 16 * len(blocks)
            g, b, p = (sum(len(c.compress(x)) for x in blocks) for c in (good, bad, plain))
            return [(b - g) / (b + g), (b - g) / size, g / size, p / size, float(np.log(size / len(blocks)))]

        return features

    def score(self, features: list[list[float]]) -> np.ndarray:
        x = np.array(features, dtype=np.float64).reshape(-1, _FEATURES)
        z = x @ np.array(self.weights[:-1]) + self.weights[-1]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _dictionary(chunks: list[bytes]) -> bytes:
    """A trained dictionary, or the text itself where there is too little to train on."""
    size = min(DICTIONARY_BYTES, sum(map(len, chunks)) // 10)
    if size >= 4096 and len(chunks) >= 100:
        try:
            return zstandard.train_dictionary(size, chunks, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass  # samples too alike; use them as they are
    return b"".join(chunks)[:DICTIONARY_BYTES]


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps, each halved until the loss falls.

    Without the halving a step overshoots where the classes are nearly separable. The weights
    apply to raw features.
    """
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, ridge = np.zeros(z.shape[1]), RIDGE * len(x)

    def loss(w: np.ndarray) -> float:
        margin = z @ w
        return float(np.logaddexp(0, margin).sum() - y @ margin + ridge / 2 * (w @ w))

    now = loss(w)
    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -500, 500)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
        while (new := loss(w + step)) > now and np.abs(step).max() > 1e-9:
            step /= 2
        w, before, now = w + step, now, new
        if before - now <= 1e-9 * max(before, 1.0):
            break
    raw = w[:-1] / scale
    return tuple(float(v) for v in [*raw, w[-1] - raw @ mean])


def _chunks(sample: DataFrame, count: int) -> list[bytes]:
    """All chunks of the texts in the order of their ids, or about CHUNKS of the ``count``, from anywhere in the texts."""
    limit = int(min(1.0, CHUNKS / max(count, 1)) * 2**64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            of, at, chunks = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                raw, doc = text.encode("utf-8", "replace"), batch.column(0)[k].as_py()
                for i in range(0, len(raw), CHUNK):
                    if xxhash.xxh64_intdigest(f"{doc} {i}") < limit:
                        of.append(k)
                        at.append(i)
                        chunks.append(raw[i : i + CHUNK])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int64())), pa.array(at, pa.int64()), pa.array(chunks, pa.binary())],
                names=["doc_id", "at", "chunk"],
            )

    schema = T.StructType([
        T.StructField("doc_id", sample.schema["doc_id"].dataType), T.StructField("at", T.LongType()),
        T.StructField("chunk", T.BinaryType()),
    ])
    rows = sample.select("doc_id", "text").mapInArrow(cut, schema).collect()
    return [c for _, _, c in sorted((r["doc_id"], r["at"], bytes(r["chunk"])) for r in rows)]


def _features(sample: DataFrame, model: CompressionModel) -> list[tuple]:
    """(id, quality, features) of every row, by id."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = model.scorer()
        for batch in slices(batches):
            x = [features(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "good", "x"]
            )

    schema = T.StructType([
        T.StructField("doc_id", sample.schema["doc_id"].dataType), T.StructField("good", T.IntegerType()),
        T.StructField("x", T.ArrayType(T.DoubleType())),
    ])
    rows = sample.select("doc_id", "good", "text").mapInArrow(measured, schema).collect()
    return sorted((r["doc_id"], r["good"], list(r["x"])) for r in rows)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> CompressionModel:
    """Fit on at most ``rows`` labelled documents, the first by a hash of their id.

    ``labels`` has doc_id and quality (0 or 1); rows with a null in either are left out, and
    a document labelled twice is good only if all its labels say so. One half of the sample, by
    another hash, makes the two dictionaries; the other half calibrates, on the features of its whole texts
    as scoring has them. Dictionaries come from chunks of whole texts: of all, or of about CHUNKS of each class, by a
    hash. Only chunks and features come to the driver. Without
    any sampled row of one class the model gives every text the share of good labels
    (0.5 without labels).
    """
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
    )
    chosen = known.orderBy(F.xxhash64(F.col("doc_id"), F.lit("fit")), "doc_id").limit(rows)
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("half")), F.lit(2))
    # At most FIT_ROWS rows of two numbers are broadcast.
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = saved(
        sample.select("doc_id", (F.col("quality") > 0).cast("int").alias("good"), part.cast("int").alias("half"), "text"),
        "labelled",
    )
    counts = {
        (r["half"], r["good"]): r for r in sample.groupBy("half", "good").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.ceil(F.octet_length("text") / CHUNK)).alias("chunks")
        ).collect()
    }
    if len(counts) < 4:
        total = sum(r["n"] for r in counts.values())
        share = sum(r["n"] for (_, good), r in counts.items() if good) / total if total else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return CompressionModel(b"", b"", (*[0.0] * _FEATURES, float(np.log(share / (1 - share)))))
    good, bad = (
        _dictionary(_chunks(sample.where(f"half = 1 and good = {k}"), counts[1, k]["chunks"])) for k in (1, 0)
    )
    model = CompressionModel(good, bad, (0.0,) * (_FEATURES + 1))
    rest = _features(sample.where("half = 0"), model)
    x, y = np.array([r[2] for r in rest]), np.array([r[1] for r in rest], float)
    return CompressionModel(good, bad, _calibrate(x, y))


def score(docs: DataFrame, model: CompressionModel, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability, from 0 to 1, that a text is good.

    Whole texts are compressed, in blocks, so that a long text looks like its parts; a null text scores as an empty one. Equal texts get equal
    scores. A column called like ``out`` is replaced; all others stay.
    """
    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = model.scorer()
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            values = model.score([features(t or "") for t in texts])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=schema.names)

    return docs.mapInArrow(scored, schema)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from fitting: crc32 of its id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document with a model fitted on the labels that are not held out."""
    model = fit(docs, labels.where(~held_out()))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier predicts to be good, with their own columns."""
    model = fit(docs, labels.where(~held_out()))
    (name,) = fresh(docs.columns, "__score")
    return score(docs, model, out=name).where(F.col(name) >= 0.5).select(*docs.columns)
