"""Quality by co-training of two views.

The text view sees the words' form and repetition; the metadata view sees what a page states about itself: language,
source and length. A naive-Bayes-like linear classifier per view is fitted on labelled rows; over
``ROUNDS`` each view labels the unlabelled rows of which it is surest, and the other view learns from them. Each
view is calibrated (a logistic curve on held-back labels, so a view that knows nothing counts little), and the
calibrated log-odds are added.

Labels come from rows whose crc32(doc_id as text) mod 5 is not 0; the fit looks at a bounded sample, ``SAMPLE``
labelled and as many unlabelled rows (chosen by a hash of doc_id); all rows are scored.

Cases: null texts count as empty, null metadata as a value of its own; null doc_ids are scored, not held out, never
learnt from; without both classes all scores are the prior's; an empty table gives an empty result; whole texts are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare, stored
from .toxicity import held_out, logistic

SAMPLE, ROUNDS, SURE, BUCKETS = 6_000, 4, 0.95, 64
WORD = re.compile(r"[^\W\d_]+")


def text_view(text: str) -> list[float]:
    """Shares that tell prose from junk: length, repetition, shape of strings, lines."""
    s = text.split()
    n = len(s) or 1
    lines = [x for x in text.split("\n") if x.strip()]
    kinds = len(set(s))
    tail = sum(not x[-1].isalnum() for x in s)
    odd = sum(1 for x in s if x[-1] in "$%&*#!|~^=<>")
    upper = sum(1 for x in s if x.isupper() and len(x) > 1)
    alpha = sum(1 for x in s if x.isalpha())
    digits = sum(1 for x in s if any(c.isdigit() for c in x))
    pairs = len(set(zip(s, s[1:])))
    bars = sum(1 for x in s if x == "|")
    return [
        log1p(len(s)), kinds / n, pairs / n, tail / n, odd / n, upper / n, alpha / n, digits / n, bars / n,
        float(len(s) < 20), float(kinds < 0.3 * n), float(odd > 0.3 * n), float(upper > 0.3 * n), float(bars > 0.1 * n),
        len(set(lines)) / max(1, len(lines)), min(sum(map(len, s)) / n, 30) / 10,
    ]


def page_view(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    import xxhash

    out = [0.0] * (2 * BUCKETS + 12)
    out[xxhash.xxh32_intdigest(f"l{lang}") % BUCKETS] = 1
    out[BUCKETS + xxhash.xxh32_intdigest(f"s{source}") % BUCKETS] = 1
    out[2 * BUCKETS + min(11, (n_chars or 0).bit_length() // 2)] = 1
    return out


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text, lang, source, n = (b.column(k).to_pylist() for k in ("text", "lang", "source", "n_chars"))
        views = [pa.array([text_view(t or "") for t in text], pa.list_(pa.float64())), pa.array([page_view(*x) for x in zip(lang, source, n)], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), *views], ["doc_id", "label", "x", "y"])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def co_train(x: np.ndarray, y: np.ndarray, label: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of the views (last: constant), and (scale of x, scale of y, constant). label: 1, 0, or -1. After the last exchange the
    views are fitted once more."""
    hold = (np.arange(len(label)) % 4 == 0) & (label >= 0)  # for calibration
    views, known = (x, y), [np.where(hold, -1, label).astype(float) for _ in range(2)]
    prior = label[label >= 0].mean()

    def fitted() -> list[np.ndarray]:
        return [logistic(v[k >= 0], k[k >= 0], 1.0) for v, k in zip(views, known)]

    for _ in range(rounds):
        w = fitted()
        for k in (0, 1):
            p, free = sigmoid(views[k] @ w[k]), (known[1 - k] < 0) & ~hold
            quota = max(1, int(0.05 * free.sum()))
            for value, sure, share in ((1.0, p, prior), (0.0, 1 - p, 1 - prior)):  # in the classes' proportion
                order = np.argsort(-np.where(free, sure, -1), kind="stable")[: max(1, int(quota * share))]
                order = order[(sure[order] >= SURE) & free[order]]
                known[1 - k][order] = value
    w = fitted()
    logits = np.stack([x[hold] @ w[0], y[hold] @ w[1], np.ones(hold.sum())], 1)
    return w[0], w[1], logistic(logits, label[hold].astype(float), 0.1)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted for every row of docs(doc_id, text, lang, source, n_chars)."""
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    labels = labels.groupBy("doc_id").agg(F.max("quality").alias("label")).where("label in (0, 1)")
    mark = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1_000_000))
    learn = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    share = lambda n: F.lit(int(1e6 * min(1.0, SAMPLE / max(1, n))))
    some = docs.join(learn.where(mark < share(learn.count())), "doc_id")
    other = docs.where((mark < share(docs.count())) & ~held_out(F.col("doc_id"))).join(labels.select("doc_id"), "doc_id", "left_anti").withColumn("label", F.lit(-1))
    sample = some.withColumn("label", F.col("label").cast("int")).unionByName(other)
    rows = stored(sample.mapInArrow(_views, "doc_id long, label int, x array<double>, y array<double>"), "quality-sample").collect()
    rows.sort(key=lambda r: (r.doc_id, r.x, r.y))
    label = np.array([r.label for r in rows])
    if len({0, 1} & set(label.tolist())) < 2:
        p = ((label == 1).sum() + 1) / ((label >= 0).sum() + 2)
        wx, wy, mix, mean, sd = None, None, np.array([0, 0, np.log(p / (1 - p))]), 0.0, 1.0
    else:
        x = np.array([r.x for r in rows])
        mean, sd = x.mean(0), x.std(0) + 1e-9
        one = np.ones((len(rows), 1))
        wx, wy, mix = co_train(np.hstack([(x - mean) / sd, one]), np.hstack([np.array([r.y for r in rows]), one]), label)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            z = np.full(n, mix[2])
            if wx is not None and n:
                text, *page = (b.column(k).to_pylist() for k in ("text", "lang", "source", "n_chars"))
                x = (np.array([text_view(t or "") for t in text]) - mean) / sd
                y = np.array([page_view(*p) for p in zip(*page)])
                z = z + mix[0] * (x @ wx[:-1] + wx[-1]) + mix[1] * (y @ wy[:-1] + wy[-1])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sigmoid(z))], ["doc_id", "score"])

    out = docs.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
