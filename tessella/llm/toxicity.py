"""Toxicity by a linear classifier of character n-grams, scaled by naive Bayes log-count ratios.

A text's features are the hashed buckets of its character n-grams, present or not, over the whole text in lower case.
Each feature is scaled by the log ratio of its smoothed frequency in toxic and in other texts, and a logistic regression
with an L2 penalty is fitted to the scaled features. It is fitted on a bounded sample of labelled rows: of each label
the `SAMPLE` rows whose doc_id has the least hash, among those that have a text; the intercept is moved to the labels'
true proportion. One task fits; it is given each text's buckets as a list or, where that is shorter, as bits (64 KB at
most), and unpacks a part of them at a time. The weights (one number for each bucket) are of a fixed size, and every
row is scored.

Defined cases: null and empty texts have no features and get the score of the intercept; without labelled rows of both
kinds every score is the smoothed proportion; repeated rows get equal scores; of several labels of one doc_id the greatest
counts, and of several texts the least; a label that is null, or of a doc_id that has no text, is not used; long texts
are featured whole; extra columns stay as they are, and where one is called score, the result is score_.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import _spark as S
from tessella.llm import _text as X

LENGTHS = (3, 4, 5)
BUCKETS = 1 << 19
#: Rows of each label that the model is fitted on at most.
SAMPLE = 1000
SMOOTHING, PENALTY, STEPS = 0.5, 0.02, 25
#: Buckets that fewer texts of the sample have get no weight.
LEAST_TEXTS = 3
#: Features of the sample that the fit takes at once, and holds unpacked at most.
PART, HELD = 400_000, 24_000_000
FOLDS = 5
CHUNK = 1 << 20
_PLACE = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def _points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case (ASCII and Latin-1), and where each text begins."""
    p = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    head = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=head[1:])
    upper = ((p >= 65) & (p <= 90)) | ((p >= 192) & (p <= 222) & (p != 215))
    return np.where(upper, p + np.uint32(32), p), head[off]


def features(data: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct buckets of each text."""
    bits = np.uint32(32 - (BUCKETS.bit_length() - 1))
    last = np.empty(BUCKETS, np.int32)
    for _, _, d, o in X.chunks(data, off, CHUNK):
        p, first = _points(d, o)
        hashed = []
        for n in LENGTHS:
            m = max(len(p) - n + 1, 0)
            h = np.full(m, n, np.uint32)
            for j in range(n):
                h += (p[j : j + m] + np.uint32(1)) * _PLACE[j]
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x2C1B3C6D)
            hashed.append(((h ^ (h >> np.uint32(13))) * np.uint32(0x9E3779B1) >> bits).astype(np.int32))
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            f = np.concatenate([h[a : max(b - n + 1, a)] for n, h in zip(LENGTHS, hashed, strict=True)])
            place = np.arange(len(f), dtype=np.int32)
            last[f] = place
            yield f[last[f] == place]


def packed(f: np.ndarray) -> bytes:
    """Buckets in order, as a list or as bits, whichever is shorter."""
    if 4 * len(f) < BUCKETS // 8:
        return np.sort(f).astype(np.int32).tobytes()
    bits = np.zeros(BUCKETS, np.uint8)
    bits[f] = 1
    return np.packbits(bits).tobytes()


def unpacked(b: bytes) -> np.ndarray:
    if len(b) == BUCKETS // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8))).astype(np.int32)
    return np.frombuffer(b, np.int32)


def fit(rows: list[bytes], label: np.ndarray, share: float) -> tuple[np.ndarray, float]:
    """(weight of each bucket, intercept) from the packed() buckets and labels of texts; share: of label 1 among all rows."""
    prior = float(np.log(share / (1 - share)))
    weight = np.zeros(BUCKETS, np.float64)
    if not len(rows) or label.min() == label.max():
        return weight, prior
    y = label.astype(bool)
    counts = {v: np.zeros(BUCKETS) for v in (True, False)}
    for r, v in zip(rows, y.tolist(), strict=True):
        counts[v][unpacked(r)] += 1
    common = counts[True] + counts[False] >= LEAST_TEXTS
    ratio = np.log((counts[True] + SMOOTHING) / (y.sum() + 1)) - np.log((counts[False] + SMOOTHING) / ((~y).sum() + 1))
    ratio[~common] = 0
    place = (np.cumsum(common) - 1).astype(np.int32)
    scale_of, n = ratio[common].astype(np.float32), int(common.sum())
    del counts

    def kept(r: bytes) -> np.ndarray:
        f = unpacked(r)
        return place[f[common[f]]]

    sizes = np.array([len(kept(r)) for r in rows])
    first = np.concatenate([[0], np.cumsum(sizes)])
    mean, sign = max(float(sizes.mean()), 1.0), np.where(y, 1.0, -1.0)
    cuts = np.unique(np.append(np.searchsorted(first, np.arange(0, first[-1] + 1, PART)), len(y))).tolist()
    parts = [(a, b) for a, b in zip([0, *cuts], cuts, strict=False) if b > a]
    held = [np.concatenate([kept(r) for r in rows[a:b]]) for a, b in parts] if first[-1] <= HELD else None

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        value, out = 0.0, 2 * PENALTY / mean * w
        out[-1] = 0
        for i, (a, b) in enumerate(parts):
            bucket = np.concatenate([kept(r) for r in rows[a:b]]) if held is None else held[i]
            scale = scale_of[bucket]
            total = np.concatenate([[0.0], np.cumsum(scale * w[bucket], dtype=np.float64)])
            at = first[a : b + 1] - first[a]
            z = sign[a:b] * (total[at[1:]] - total[at[:-1]] + w[-1])
            g = -sign[a:b] / (1 + np.exp(np.clip(z, -500, 500))) / len(y)
            value += float(np.logaddexp(0, -z).sum()) / len(y)
            out += np.bincount(bucket, np.repeat(g, sizes[a:b]) * scale, n + 1)
            out[-1] += g.sum()
        return value + PENALTY / mean * float((w[:-1] ** 2).sum()), out

    w = _least(loss, np.zeros(n + 1))
    balanced = float(np.log(y.sum() / (~y).sum()))
    weight[common] = w[:-1]
    return weight * ratio, float(w[-1]) - balanced + prior


def _least(loss, w: np.ndarray) -> np.ndarray:
    """L-BFGS with backtracking."""
    value, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(STEPS):
        q, used = grad.copy(), []
        for s, y, rho in reversed(past):
            a = rho * (s @ q)
            q -= a * y
            used.append(a)
        if past:
            s, y, _ = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(past, reversed(used), strict=True):
            q += s * (a - rho * (y @ q))
        step, slope = 1.0 if past else 1.0 / max(np.abs(grad).sum(), 1.0), -(grad @ q)
        while step > 1e-10:
            new, new_grad = loss(w - step * q)
            if new <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = -step * q, new_grad - grad
        done = value - new < 1e-7 * max(1.0, abs(value))
        w, value, grad = w + s, new, new_grad
        if s @ y > 1e-12:
            past = [*past[-7:], (s, y, 1 / (s @ y))]
        if done:
            break
    return w


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = X.utf8(batch.column("text"))
        found = [packed(f) for f in features(data, off)]
        yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("label"), pa.array(found, pa.binary())], names=["at", "label", "features"])


def _fitted(share: float):
    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("at", "ascending"), ("features", "ascending")])  # sums do not depend on who came first
        weight, intercept = fit(rows.column("features").to_pylist(), rows.column("label").to_numpy(), share)
        return pa.table({"weight": pa.array([weight.astype(np.float32).tobytes()], pa.binary()), "intercept": [intercept]})

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The weights and the intercept, from docs(doc_id, text) and labels(doc_id, label); one task reads at most 2 * sample rows."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = S.cut(known.join(docs.filter("text is not null").select("doc_id"), "doc_id", "left_semi"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    order = F.xxhash64(F.col("doc_id"))
    few = known.filter("label = 0").orderBy(order, "doc_id").limit(sample).unionByName(known.filter("label = 1").orderBy(order, "doc_id").limit(sample))
    own = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))  # at most 2 * sample rows, copies combined before the shuffle
    rows = own.select(order.alias("at"), "text", "label").mapInArrow(_featured, "at long, label int, features binary")
    found = rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_fitted(share), "weight binary, intercept double").first()
    if found is None:
        return fit([], np.zeros(0), share)
    return np.frombuffer(found.weight, np.float32).astype(np.float64), found.intercept


def _scored(weight, intercept: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weight.value
        for batch in batches:
            data, off = X.utf8(batch.column("text"))
            z = intercept + np.array([w[f].sum(dtype=np.float64) for f in features(data, off)])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=["row", "score"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """Every column of docs, and score: near 1 where label 1 is likely. The weights that are broadcast have a fixed size."""
    weight = docs.sparkSession.sparkContext.broadcast(model[0].astype(np.float32))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    out = rows.mapInArrow(_scored(weight, model[1]), T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.col("score").alias(S.free(docs.columns, "score")))


def fold(column="doc_id"):
    """The remainder by which rows are held out; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % FOLDS


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.filter(fold() != 0))
    found = score(docs, model)
    return found.select("doc_id", (fold() == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
