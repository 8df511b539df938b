"""Online variational Bayes of topic models (the steps of Spark's online LDA) on blocks of documents.

Spark's own fit reads and cuts the texts again in every iteration and goes through each drawn document by itself. Here
the counts are written once, documents of like length move together, and one drawn several times is inferred once and
weighs as often. Start, convergence and updates are Spark's, and so is the fitted model.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlweave.functions.common import scratch_path

#: Documents inferred together, words of the model that travel as one row, mean change of a document's shares at its end.
GROUP, BLOCK, TOLERANCE = 64, 1024, 1e-3

#: With it, what a query shuffled goes when it is done, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _digamma(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """s and e with digamma(x) = ln(e) - s: four steps of the recurrence, then the series of exp(digamma); good to 3e-7."""
    q = x * (x + 3)
    s = (2 * x + 3) * (2 * q + 2) / (q * (q + 2))
    z = x + x.dtype.type(3.5)
    r = 1 / (z * z)
    return s, z * (1 + r * (1 / 24 + r * (-37 / 5760 + r * (10313 / 2903040))))


def exp_digamma(x: np.ndarray) -> np.ndarray:
    s, e = _digamma(x)
    return e * np.exp(-s)


def digamma(x: np.ndarray) -> np.ndarray:
    s, e = _digamma(x)
    return np.log(e) - s


def trigamma(x: np.ndarray) -> np.ndarray:
    r = 1 / (x + 8)
    return sum(1 / (x + i) ** 2 for i in range(8)) + r * (1 + r * (1 / 2 + r * (1 / 6 - r * r * (1 / 30 - r * r / 42))))


def word_weights(lam: np.ndarray) -> np.ndarray:
    """exp(E[ln beta]), a row a word, from lambda (a row a topic). Rows are scaled to a maximum of 1, which changes no document's shares."""
    total, out = exp_digamma(lam.sum(1)), np.empty((lam.shape[1], len(lam)), np.float32)
    for at in range(0, len(out), 4096):
        part = exp_digamma(lam[:, at : at + 4096]) / total[:, None]
        out[at : at + 4096] = (part / part.max(0)).T
    return out


def infer(beta: np.ndarray, alpha: np.ndarray, start: np.ndarray, words: np.ndarray, counts: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> Iterator[tuple]:
    """Shares of the given documents: (rows, gamma, exp(E[ln theta]) up to a factor, words, count / norm a word, number of words).

    A document ends when its own mean change is at most the tolerance, whatever the others beside it do; once a quarter
    have ended, the next take their places. The longest come first, so that all fit. Documents without words are left out.
    """
    length = np.diff(offsets)
    rows = rows[length[rows] > 0]
    rows = rows[np.argsort(-length[rows], kind="stable")]
    if not len(rows):
        return
    small, alpha, start, most = np.float32(1e-37), alpha.astype(np.float32), start.astype(np.float32), TOLERANCE * len(alpha)
    at = min(GROUP, len(rows))
    own, width = np.zeros(at, np.int64), length[rows[0]]
    ids, c, w = np.zeros((at, width), words.dtype), np.zeros((at, width), np.float32), np.empty((at, width, len(alpha)), np.float32)
    g, gamma, open_ = np.empty((at, len(alpha)), np.float32), np.empty((at, len(alpha)), np.float32), np.ones(at, bool)

    def enter(slots: np.ndarray, new: np.ndarray) -> None:
        place = np.arange(length[new[0]])
        there, first = place < length[new][:, None], offsets[new][:, None]
        where = np.where(there, first + place, first)
        ids[slots, : len(place)] = words[where]
        w[slots, : len(place)] = beta[words[where]]
        c[slots] = 0
        c[slots, : len(place)] = np.where(there, counts[where], np.float32(0))
        g[slots], own[slots], open_[slots] = start, new, True

    enter(np.arange(at), rows[:at])
    while True:
        theta = exp_digamma(g)
        ratio = c / (np.matmul(w, theta[:, :, None])[:, :, 0] + small)
        new = theta * np.matmul(ratio[:, None, :], w)[:, 0] + alpha
        ends = open_ & (np.abs(new - g).sum(1) <= most)
        g = new
        if not ends.any():
            continue
        gamma[ends] = g[ends]
        open_ &= ~ends
        if 4 * np.count_nonzero(open_) > 3 * len(open_):
            continue
        slots = np.flatnonzero(~open_)
        theta = exp_digamma(gamma[slots])
        yield own[slots], gamma[slots], theta, ids[slots], c[slots] / (np.matmul(w[slots], theta[:, :, None])[:, :, 0] + small), length[own[slots]]
        more = rows[at : at + len(slots)]
        at += len(more)
        if len(more):
            enter(slots[: len(more)], more)
        if not open_.any():
            return
        if not open_.all():
            ids, c, w, g, gamma, own, open_ = (x[open_] for x in (ids, c, w, g, gamma, own, open_))
        if 8 * (width := length[own].max()) <= 7 * c.shape[1]:
            ids, c, w = (np.ascontiguousarray(x[:, :width]) for x in (ids, c, w))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, counts and offsets of a batch with the columns `indices` and `values`."""
    words, values = batch.column("indices"), batch.column("values")
    offsets = words.offsets.to_numpy().astype(np.int64)
    return words.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False), offsets - offsets[0]


def _step(model, size: int, seed: int, iteration: int) -> Callable:
    """One task of an iteration: every document drawn so many times as a draw of all with replacement would have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beta, alpha, start = model.value
        stat, logs, n = np.zeros((size, len(alpha))), np.zeros(len(alpha)), 0
        rng = np.random.default_rng([seed, iteration, TaskContext.get().partitionId()])
        for batch in batches:
            words, counts, offsets = _arrays(batch)
            drawn = rng.poisson(1.0, batch.num_rows)
            for rows, gamma, theta, ids, ratio, length in infer(beta, alpha, start, words, counts, offsets, np.flatnonzero(drawn)):
                times = drawn[rows]
                gamma = gamma.astype(np.float64)
                logs += times @ (digamma(gamma) - digamma(gamma.sum(1))[:, None])
                n += times.sum()
                part = (ratio * times[:, None])[:, :, None] * theta[:, None, :]
                for k, m in enumerate(length):
                    stat[ids[k, :m]] += part[k, :m]
        if n:
            stat *= beta
            out = [(-1, np.append(logs, n).tobytes())] + [(k, stat[k * BLOCK : (k + 1) * BLOCK].astype(np.float32).tobytes()) for k in range(-(-size // BLOCK))]
            for k, part in out:
                yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "part": pa.array([part], pa.binary())})

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the parts of every block; the block -1 holds doubles."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, part in zip(batch.column("block").to_pylist(), batch.column("part"), strict=True):
            got = np.frombuffer(part.as_buffer(), np.float64 if k < 0 else np.float32)
            sums[k] = sums[k] + got if k in sums else got.astype(np.float64)
    for k, total in sums.items():
        yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "part": pa.array([(total if k < 0 else total.astype(np.float32)).tobytes()], pa.binary())})


def _new_alpha(alpha: np.ndarray, logs: np.ndarray, n: float, rho: float) -> np.ndarray:
    """A Newton step of the shares' prior, left out where it would go below 0."""
    gradient = n * (digamma(alpha.sum(keepdims=True)) - digamma(alpha) + logs / n)
    c, q = n * trigamma(alpha.sum()), -n * trigamma(alpha)
    step = -(gradient - (gradient / q).sum() / (1 / c + (1 / q).sum())) / q
    new = alpha + rho * step
    return new if (new > 0).all() else alpha


def fit(counted: DataFrame, lda, size: int):
    """The LocalLDAModel that an online `LDA` estimator describes, of a table with its vectors of `size` words.

    The table is written once; the model's `counted` reads it.
    """
    assert lda.getOptimizer() == "online" and lda.getSubsamplingRate() == 1.0 and not lda.isSet("docConcentration") and not lda.isSet("topicConcentration")
    spark, k, seed, counts = counted.sparkSession, lda.getK(), lda.getSeed() & (2**63 - 1), lda.getFeaturesCol()
    cores = spark.sparkContext.defaultParallelism
    path = scratch_path(spark, "counts")
    counted.repartition(8 * cores).write.parquet(path)
    table = spark.read.schema(T.StructType([T.StructField(f.name, f.dataType.sqlType()) if f.name == counts else f for f in counted.schema])).parquet(path)
    docs = table.select(f"{counts}.indices", F.col(f"{counts}.values").cast("array<float>").alias("values")).coalesce(cores)

    rng = np.random.default_rng([seed])
    lam, alpha, eta = rng.gamma(100.0, 0.01, (k, size)), np.full(k, 1 / k), 1 / k
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        for iteration in range(1, lda.getMaxIter() + 1):
            rho = (lda.getLearningOffset() + iteration) ** -lda.getLearningDecay()
            model = spark.sparkContext.broadcast((word_weights(lam), alpha, rng.gamma(100.0, 0.01, k)))
            parts = docs.mapInArrow(_step(model, size, seed, iteration), "block int, part binary")
            got = parts.repartition(cores, "block").mapInArrow(_sum, "block int, part binary").collect()
            model.destroy()
            if not got:
                continue  # no document with words was drawn
            lam *= 1 - rho
            lam += rho * eta
            for block, part in got:
                if block < 0:
                    *logs, n = np.frombuffer(part)
                else:
                    lam[:, block * BLOCK : (block + 1) * BLOCK] += rho * np.frombuffer(part, np.float32).reshape(-1, k).T
            got = part = None
            if lda.getOptimizeDocConcentration():
                alpha = _new_alpha(alpha, np.array(logs), n, rho)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    model = _spark_model(spark, lda, lam, alpha, eta)
    model.counted = table
    return model


def _spark_model(spark, lda, lam: np.ndarray, alpha: np.ndarray, eta: float):
    """Spark's own fitted model. Lambda goes through a file, as the gateway would hold it several times as text."""
    from pyspark.ml.clustering import LocalLDAModel

    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway

    def doubles(x: np.ndarray):
        out = gateway.new_array(jvm.double, x.size)
        fd, name = tempfile.mkstemp()
        try:
            with os.fdopen(fd, "wb") as f:
                for row in np.atleast_2d(x):
                    f.write(row.astype(">f8").tobytes())
            file = jvm.java.io.RandomAccessFile(name, "r")
            try:
                mode = getattr(jvm, "java.nio.channels.FileChannel$MapMode").READ_ONLY
                file.getChannel().map(mode, 0, 8 * x.size).asDoubleBuffer().get(out)
            finally:
                file.close()
        finally:
            os.unlink(name)
        return out

    k, size = lam.shape
    topics = jvm.org.apache.spark.mllib.linalg.DenseMatrix(size, k, doubles(lam))
    old = jvm.org.apache.spark.mllib.clustering.LocalLDAModel(topics, jvm.org.apache.spark.mllib.linalg.DenseVector(doubles(alpha)), eta, 100.0)
    java = jvm.org.apache.spark.ml.clustering.LocalLDAModel(lda.uid, size, old, spark._jsparkSession)
    model = lda._copyValues(LocalLDAModel(java))
    model.word_weights = word_weights(lam)
    return model


def shares(counted: DataFrame, counts: str, fitted, name: str) -> DataFrame:
    """A table with the vectors of `counts` replaced by topic shares, an array that sums to 1; zeros for documents without words, as Spark has them."""
    beta = getattr(fitted, "word_weights", None)
    if beta is None:
        beta = word_weights(fitted.topicsMatrix().toArray().T)
    start = np.random.default_rng([fitted.getSeed() & (2**63 - 1)]).gamma(100.0, 0.01, beta.shape[1])
    model = counted.sparkSession.sparkContext.broadcast((beta, fitted.estimatedDocConcentration().toArray(), start))
    keep = [c for c in counted.columns if c != counts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beta, alpha, start = model.value
        for batch in batches:
            vectors = batch.column(counts)
            out = np.zeros((batch.num_rows, len(alpha)))
            parts = pa.RecordBatch.from_arrays(vectors.flatten(), [f.name for f in vectors.type])
            for rows, gamma, *_ in infer(beta, alpha, start, *_arrays(parts), np.arange(batch.num_rows)):
                out[rows] = gamma / gamma.sum(1, dtype=np.float64, keepdims=True)
            lists = pa.ListArray.from_arrays(np.arange(0, out.size + 1, len(alpha), dtype=np.int32), out.ravel())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], [*keep, name])

    return counted.mapInArrow(run, T.StructType([*(counted.schema[c] for c in keep), T.StructField(name, T.ArrayType(T.DoubleType()))]))
