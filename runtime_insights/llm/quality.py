"""A co-trained quality classifier: the text and the page's metadata as two views.

The text view sees hashed character trigrams of the whole text (shares, so length does not
matter). The metadata view sees source, language, length, and the shares of line ends, capitals,
digits, signs and blanks. Both are logistic regressions.

Training: a bounded sample of labelled rows (``sample`` of them, those with the smallest
hash of doc_id; every fifth is held out). In each round both views score *all* documents without
a label; the ``exchange`` surest good and bad texts of each view (copies count once) become training rows of the other
view, and both are fitted again. Then each view is calibrated on the held-out rows (Platt),
and the calibrated log-odds of the two are combined by a regression on the same rows.

Scoring reads all documents once, in place; nothing but the chosen rows' features is moved.
A model has a fixed size (2^18 weights and the metadata weights) whatever the corpus; sources are hashed.

Rows of ``score``: one per input row, with ``quality`` in [0, 1]. Null or empty text: no
trigrams, the metadata view decides with length 0. Null source or language: a value of its own. Labels
that are null or disagree for one doc_id do not train. Without labels of both classes every
document scores 1, so a filter keeps all. Repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from runtime_insights.llm.arrays import chunks, mix, span_hashes, text_bytes
from runtime_insights.llm.tables import discard, store

TEXT_BITS, META_BITS = 18, 12
SAMPLE, EXCHANGE, ROUNDS = 4_000, 250, 2
_CLASSES = np.zeros((256, 5), np.float32)  # per byte: line end, capital, digit, other sign, blank
_CLASSES[10, 0] = 1
_CLASSES[ord("A") : ord("Z") + 1, 1] = 1
_CLASSES[ord("0") : ord("9") + 1, 2] = 1
_CLASSES[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,"], 3] = 1
_CLASSES[32, 4] = 1


def text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte trigram, and where each text's trigrams begin (n + 1)."""
    n = len(data) - 2
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    key = data[:-2].astype(np.uint32) << np.uint32(16) | data[1:-1].astype(np.uint32) << np.uint32(8) | data[2:]
    bucket = (key * np.uint32(2654435761)) >> np.uint32(32 - TEXT_BITS)
    inside = np.ones(n, bool)
    for back in (1, 2):  # trigrams that reach into the next text
        cut = offsets[1:-1] - back
        inside[cut[(cut >= 0) & (cut < n)]] = False
    at = np.concatenate(([0], np.cumsum(inside)))
    return bucket[inside], at[np.minimum(offsets, n)]


def meta_features(chunk: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Dense part (n, 7) and hashed source and language (n, 2) side by side."""
    size = np.diff(offsets)
    table = np.zeros((len(size), 9), np.float32)
    shares = np.zeros((len(size), 5), np.float32)
    full = np.flatnonzero(size)
    if len(full):
        for c in range(5):
            shares[full, c] = np.add.reduceat(_CLASSES[:, c][data], offsets[full])
        shares[full] /= size[full, None]
    table[:, :5] = 10 * shares
    table[:, 5] = np.log1p(size) / 10
    table[:, 6] = 1
    for j, name in enumerate(("source", "lang")):
        raw, at = text_bytes(chunk.column(name))
        h = span_hashes(raw, at[:-1], at[1:], 3 + j) if len(at) > 1 else np.zeros(0, np.uint64)
        table[:, 7 + j] = (mix(h) % np.uint64(1 << META_BITS)).astype(np.float32)
    return table


@dataclass
class Model:
    """Weights of both views, and what turns their sums into one log-odds."""

    text: np.ndarray
    text_bias: float
    meta: np.ndarray  # dense weights
    meta_hashed: np.ndarray  # (2, 2^META_BITS)
    combine: tuple[float, float, float] = (1.0, 1.0, 0.0)

    def text_scores(self, bucket, begin) -> np.ndarray:
        size = np.diff(begin)
        out = np.full(len(size), self.text_bias)
        full = np.flatnonzero(size)
        if len(full):
            out[full] += np.add.reduceat(self.text[bucket], begin[:-1][full]) / size[full]
        return out

    def meta_scores(self, table) -> np.ndarray:
        hashed = table[:, 7:].astype(np.int64)
        return table[:, :7] @ self.meta + self.meta_hashed[0][hashed[:, 0]] + self.meta_hashed[1][hashed[:, 1]]

    def odds(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        a, b, c = self.combine
        return a * text + b * meta + c


def _fit(value, add, size: int, y: np.ndarray, steps: int = 80, rate: float = 0.3, decay: float = 1e-4) -> np.ndarray:
    """Adam on the logistic loss, classes weighted alike. value(w): sums; add(g): gradient."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    for t in range(1, steps + 1):
        g = add((1 / (1 + np.exp(-np.clip(value(w), -30, 30))) - y) * weight) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


class _Rows:
    """Features of training rows: shares of trigrams, row after row, and metadata."""

    def __init__(self, rows: list[dict]):
        self.meta = np.array([r["meta"] for r in rows], np.float64).reshape(len(rows), 9)
        self.size = np.array([len(r["buckets"]) // 4 for r in rows], np.int64)
        self.bucket = np.frombuffer(b"".join(r["buckets"] for r in rows), np.uint32).astype(np.int64)
        self.share = np.frombuffer(b"".join(r["shares"] for r in rows), np.float32)
        self.full = np.flatnonzero(self.size)
        self.begin = (np.cumsum(self.size) - self.size)[self.full]

    def _sums(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.size))
        if len(self.full):
            out[self.full] = np.add.reduceat(self.share * w[self.bucket], self.begin)
        return out

    def fit_text(self, y):
        n = 1 << TEXT_BITS

        def add(e):
            spread = np.repeat(e.astype(np.float32), self.size) * self.share
            return np.append(np.bincount(self.bucket, spread, n), e.sum())

        w = _fit(lambda w: self._sums(w[:n]) + w[n], add, n + 1, y, rate=3.0, decay=1e-8)
        return w[:n], w[n]

    def fit_meta(self, y):
        dense, hashed = self.meta[:, :7], self.meta[:, 7:].astype(np.int64)
        size = 1 << META_BITS
        value = lambda w: dense @ w[:7] + w[7 + hashed[:, 0]] + w[7 + size + hashed[:, 1]]
        add = lambda e: np.concatenate(
            (e @ dense, np.bincount(hashed[:, 0], e, size), np.bincount(hashed[:, 1], e, size)))
        w = _fit(value, add, 7 + 2 * size, y, decay=1e-3)
        return w[:7], w[7:].reshape(2, size)

    def text_scores(self, model):
        return self._sums(model.text) + model.text_bias


def _row_features(batches):
    for chunk in chunks(batches, "text"):
        data, offsets = text_bytes(chunk.column("text"))
        bucket, begin = text_features(data, offsets)
        meta = meta_features(chunk, data, offsets)
        buckets, shares = [], []
        for a, b in zip(begin[:-1], begin[1:]):
            used, n = np.unique(bucket[a:b], return_counts=True)
            buckets.append(used.astype(np.uint32).tobytes())
            shares.append((n / max(1, b - a)).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(buckets, pa.binary()), pa.array(shares, pa.binary()),
             pa.array(meta.tolist(), pa.list_(pa.float32())), chunk.column("y"), chunk.column("fold")],
            ["buckets", "shares", "meta", "y", "fold"],
        )


def _features(chosen: DataFrame) -> list[dict]:
    """Training rows of a bounded number of documents, ``text`` ``source`` ``lang`` ``y`` ``fold``."""
    return chosen.mapInArrow(
        _row_features, "buckets binary, shares binary, meta array<float>, y int, fold int"
    ).toArrow().to_pylist()


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
    )


def _view_scores(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep`` columns and the sums of both views for all documents."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # fixed size, see the module's text

    def run(batches):
        model = held.value
        for chunk in chunks(batches, "text"):
            data, offsets = text_bytes(chunk.column("text"))
            bucket, begin = text_features(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [*[chunk.column(c) for c in keep], pa.array(model.text_scores(bucket, begin)),
                 pa.array(model.meta_scores(meta_features(chunk, data, offsets)), pa.float64())],
                [*keep, "text_score", "meta_score"],
            )

    kinds = ", ".join(f"{c} {dict(docs.dtypes)[c]}" for c in keep)
    return docs.select(*dict.fromkeys((*keep, "text", "source", "lang"))).mapInArrow(
        run, f"{kinds}, text_score double, meta_score double"
    )


def train(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exchange: int = EXCHANGE, rounds: int = ROUNDS
) -> Model | None:
    """The co-trained model; None if the labels do not hold both classes."""
    docs = _documents(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter(
        "doc_id IS NOT NULL AND y IN (0, 1)"
    ).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).filter("y = top").drop("top")
    known = store(known, "quality-labels")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumn(
        "fold", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)).cast("int")
    )
    # At most ``sample`` ids, whatever the corpus: the documents are not shuffled to meet them.
    rows = _features(docs.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("text", "source", "lang", "y", "fold"))
    fit_rows, held_rows = [r for r in rows if r["fold"]], [r for r in rows if not r["fold"]]
    if len({r["y"] for r in fit_rows}) < 2 or len({r["y"] for r in held_rows}) < 2:
        discard(known)
        return None
    base, held = _Rows(fit_rows), _Rows(held_rows)
    y, y_held = (np.array([r["y"] for r in x], np.float64) for x in (fit_rows, held_rows))

    def fit(text_rows, y_text, meta_rows, y_meta):
        return Model(*text_rows.fit_text(y_text), *meta_rows.fit_meta(y_meta))

    model = fit(base, y, base, y)
    more: dict[str, list[dict]] = {"text": [], "meta": []}
    taken: list[int] = []
    content = F.xxhash64("text")
    for _ in range(rounds):
        # Copies score alike: each text counts once, by its smallest doc_id.
        scores = store(
            _view_scores(docs.withColumn("content", content), model, "doc_id", "content").filter("doc_id IS NOT NULL")
            .join(known.select("doc_id"), "doc_id", "left_anti")
            .groupBy("content").agg(
                F.min("doc_id").alias("doc_id"),
                *[F.min_by(v, "doc_id").alias(v) for v in ("text_score", "meta_score")],
            ), "quality-pool",
        ).filter(~F.col("content").isin(taken) if taken else F.lit(True))
        picks = None
        for view, other in (("text", "meta"), ("meta", "text")):
            score = F.col(f"{view}_score")
            for y_new, order in ((1, score.desc()), (0, score.asc())):
                sure = scores.filter(score > 0 if y_new else score < 0).orderBy(order, "doc_id").limit(exchange).select(
                    "doc_id", "content", F.lit(y_new).alias("y"), F.lit(0 if other == "text" else 1).alias("fold")
                )
                picks = sure if picks is None else picks.union(sure)
        picks = store(picks, "quality-picks")
        # One row of each pick, however many rows share its doc_id and text.
        picked = docs.withColumn("content", content).join(F.broadcast(picks), ["doc_id", "content"]).dropDuplicates(
            ["doc_id", "content", "y", "fold"])
        new = _features(picked.select("text", "source", "lang", "y", "fold"))
        taken += [r[0] for r in picks.select("content").distinct().collect()]  # at most 4 x exchange a round
        more["text"] += [r for r in new if r["fold"] == 0]
        more["meta"] += [r for r in new if r["fold"] == 1]
        discard(scores, picks)
        sets = {v: fit_rows + more[v] for v in more}
        ys = {v: np.array([r["y"] for r in sets[v]], np.float64) for v in sets}
        model = fit(_Rows(sets["text"]), ys["text"], _Rows(sets["meta"]), ys["meta"])
    discard(known)

    # Platt scaling of each view on held-out rows, then one regression on the calibrated odds.
    def line(columns, target):
        x = np.column_stack((*columns, np.ones(len(target))))
        return _fit(lambda w: x @ w, lambda e: e @ x, x.shape[1], target, steps=400, rate=0.05, decay=1e-3)

    text, meta = held.text_scores(model), model.meta_scores(held.meta)
    (a_text, b_text), (a_meta, b_meta) = line([text], y_held), line([meta], y_held)
    w_text, w_meta, w_bias = line([a_text * text + b_text, a_meta * meta + b_meta], y_held)
    model.combine = (w_text * a_text, w_meta * a_meta, w_text * b_text + w_meta * b_meta + w_bias)
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id`` and ``quality`` (combined, calibrated chance to be good) of every row."""
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(1.0).alias("quality"))
    a, b, c = model.combine
    odds = F.col("text_score") * float(a) + F.col("meta_score") * float(b) + float(c)
    return _view_scores(_documents(docs), model, "doc_id").select(
        "doc_id", (F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))).alias("quality")
    )


def keep_good(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a quality of at least ``least``; all columns as they are."""
    if model is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        for chunk in chunks(batches, "text"):
            data, offsets = text_bytes(chunk.column("text"))
            odds = model.odds(
                model.text_scores(*text_features(data, offsets)), model.meta_scores(meta_features(chunk, data, offsets))
            )
            yield chunk.filter(pa.array(1 / (1 + np.exp(-odds)) >= least))

    return docs.mapInArrow(run, docs.schema)


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).withColumn(
        "good", F.col("quality") >= 0.5
    )
