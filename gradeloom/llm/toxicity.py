"""Toxicity by weak supervision.

Voters are lexicon entries mined from labelled training rows, and patterns. An entry is a word or a stem of 5 to 8
letters, that fires if the document has it, has it twice, or twice and in one of 250 words. A generative model with a class prior, the rate
at which each voter fires in each class, and the voters' correlations within the classes is fitted by EM to the votes on all
rows that are not held out, without their labels. Labels choose the voters, and their counts on labelled rows are prior
counts of the rates, against which all rows together weigh ``UNLABELLED``: without them, the model turns to other
classes that the votes show too. A voter's evidence is divided by how much correlated company it has. Rows with the same votes are counted together, and each step is
an aggregation over those counts. A linear classifier over the same votes is trained on the model's posterior labels (of the rows that the
voters were mined from) and scores all texts.

Labels are used only of rows whose crc32(doc_id as text) mod 5 is not 0, of at most about ``SAMPLE`` of those (chosen by a hash of
doc_id). Labels, lang, source and doc_id are never inputs of a score.

Cases: null and empty texts get the score of a text without words; doc_ids that are null are scored, not held
out and never learnt from; of several labels of a doc_id the largest counts, of several rows of a doc_id up to ``REPEATS`` are mined;
without both classes among the labels every score is the prior's; an empty table gives an empty result; whole texts are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .shared import prepare, scratch, stored

#: Documented bound of the fit: labelled rows that it looks at.
SAMPLE, REPEATS = 12_000, 2
VOTERS = 512
#: Steps of EM, and those before which correlations are measured.
STEPS, MEASURED = 10, (1, 5)
#: What all rows without labels weigh against those with, whatever their numbers; the least support and precision of an entry; correlations that count.
UNLABELLED, SUPPORT, PRECISION, STRONG = 1.0, 6, 0.8, 0.7
STEMS = range(5, 9)
WORD = re.compile(r"[^\W\d_]+")
MEMO = 300_000
PATTERNS = ("shouting", "symbols", "repeats")


def entries(word: str) -> Iterator[str]:
    yield word
    for n in STEMS:
        if len(word) >= n:
            yield word[:n] + "*"


def firing(found: Counter, n_strings: int) -> Iterator[str]:
    """The voters of entries found so often in a text of so many strings."""
    for f, n in found.items():
        yield f
        if n >= 2:
            yield f + "#2"
            if n * 250 >= n_strings:
                yield f + "#%"


def found_in(text: str) -> Counter:
    out: Counter[str] = Counter()
    for w, n in Counter(WORD.findall(text.lower())).items():
        for f in entries(w):
            out[f] += n
    return out


def patterns(strings: list[str]) -> list[bool]:
    n = len(strings) or 1
    return [
        sum(s.isupper() and len(s) > 1 for s in strings) > 0.3 * n,
        sum(not s[-1].isalnum() and s[-1] not in ".,;:" for s in strings) > 0.3 * n,
        len(set(strings)) < 0.3 * n,
    ]


@dataclass
class Model:
    voters: dict[str, int]
    weights: np.ndarray  # of voters, then patterns, then 1


class Votes:
    """The voters that fire on a text."""

    def __init__(self, voters: dict[str, int]):
        self.voters, self.memo = voters, {}
        self.known = {v.split("#")[0] for v in voters}

    def of(self, string: str) -> tuple[str, ...]:
        return tuple(f for w in WORD.findall(string.lower()) for f in entries(w) if f in self.known)

    def __call__(self, text: str) -> list[int]:
        strings, memo = text.split(), self.memo
        if len(memo) > MEMO:
            memo.clear()
        for s in set(strings):
            if s not in memo:
                memo[s] = self.of(s)
        found = Counter(chain.from_iterable(t for t in map(memo.__getitem__, strings) if t))
        v = self.voters
        return sorted(v[f] for f in firing(found, len(strings)) if f in v) + [len(v) + k for k, x in enumerate(patterns(strings)) if x]


@dataclass
class Rates:
    """The generative model: class prior, each voter's rates in class 0 and 1, and its discount for company."""

    prior: float
    rates: np.ndarray
    discount: np.ndarray

    def evidence(self) -> tuple[float, np.ndarray]:
        """Log-odds of a row without votes, and what each vote adds."""
        on, off = np.log(self.rates[1] / self.rates[0]), np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        return float(np.log(self.prior / (1 - self.prior)) + (self.discount * off).sum()), self.discount * (on - off)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Patterns:
    """Votes of rows (flat voters, offsets) and how many rows have each."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray, n: np.ndarray):
        self.flat, self.offsets, self.n = flat.astype(np.int64), offsets - offsets[0], n.astype(np.float64)

    def posterior(self, model: Rates) -> np.ndarray:
        base, weight = model.evidence()
        total = np.concatenate([[0.0], np.cumsum(weight[self.flat])])
        return sigmoid(base + total[self.offsets[1:]] - total[self.offsets[:-1]])

    def counts(self, model: Rates) -> np.ndarray:
        """(2, voters + 1): in both classes, rows in which each voter fires, and all rows."""
        p, size = self.posterior(model), len(model.discount)
        long = np.diff(self.offsets)
        out = [np.append(np.bincount(self.flat, np.repeat(m, long), size), m.sum()) for m in (self.n * (1 - p), self.n * p)]
        return np.stack(out)

    def company(self, model: Rates) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, (2, pairs)): in both classes, rows in which both of two voters fire."""
        size = len(model.discount)
        both = np.zeros((2, size, size))
        p = self.posterior(model)
        for lo in range(0, len(self.n), 4096):
            hi = min(len(self.n), lo + 4096)
            x = np.zeros((hi - lo, size), np.float32)
            long = np.diff(self.offsets[lo : hi + 1])
            x[np.repeat(np.arange(hi - lo), long), self.flat[self.offsets[lo] : self.offsets[hi]]] = 1
            for y, m in enumerate((self.n * (1 - p), self.n * p)):
                both[y] += (x * m[lo:hi, None]).T @ x
        i, j = np.nonzero(both.sum(0))
        return i, j, both[:, i, j]


def rates_of(counts: np.ndarray, discount: np.ndarray) -> Rates:
    total = counts[:, -1:]
    prior = float(np.clip(total[1, 0] / max(1e-9, total.sum()), 1e-4, 0.5))
    return Rates(prior, (counts[:, :-1] + 0.1) / (total + 1), discount)


def discounts(model: Rates, total: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """1 over the sum of a voter's correlations within a class with all voters, the mean of both classes. Below ``STRONG``, as of words
    that are used together, they don't count; those of a word and its stems do."""
    i, j, both = pairs
    company = np.zeros(len(model.discount))
    for y in (0, 1):
        r = model.rates[y]
        sd = np.sqrt(r * (1 - r))
        c = (both[y] / max(1e-9, total[y]) - r[i] * r[j]) / (sd[i] * sd[j])
        company += 0.5 * np.bincount(i, np.where(i == j, 1.0, np.where(c > STRONG, np.minimum(c, 1), 0)), len(company))
    return 1 / np.maximum(1, company)


def label_model(mined: np.ndarray, counts: Callable[[Rates], np.ndarray], company: Callable[[Rates], tuple], weight: float = UNLABELLED, steps: int = STEPS) -> Rates:
    """EM: counts() and company() are those of Patterns, over all rows, which together weigh so much times the rows of mined.

    mined are the voters' counts on labelled rows: where to start from, and prior counts of the rates, so that the model keeps to the
    classes that were asked for and not to others that the votes show as well. No posterior sees a row's label.
    """
    start = model = rates_of(mined, np.ones(mined.shape[1] - 1))
    for k in range(steps if weight else 0):
        found = counts(model)
        share = weight * mined[:, -1].sum() / max(1e-9, found[:, -1].sum())
        if k in MEASURED:
            alone = rates_of(found, start.discount)
            model = Rates(model.prior, model.rates, discounts(alone, found[:, -1], company(model)))
        model = rates_of(mined + share * found, model.discount)
    return model


def logistic(x: np.ndarray, target: np.ndarray, ridge: float = 0.5, steps: int = 15) -> np.ndarray:
    """Weights of a linear classifier for soft targets, by Newton steps; the last column is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (target - p) - penalty * w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w += step * min(1, 5 / max(1e-9, np.abs(step).max()))
    return w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def votes_of(docs: DataFrame, voters: dict[str, int], keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of keep, and v: the voters that fire on each text."""
    fields = docs.select(*keep).schema.fields
    names = [f.name for f in fields]

    def fired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = Votes(voters)
        for batch in batches:
            v = pa.array([votes(t or "") for t in batch.column(0).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], v], [*names, "v"])

    return docs.select(F.col("text").alias("__text"), *keep).mapInArrow(fired, StructType([*fields, StructField("v", ArrayType(IntegerType()))]))


def over(patterns: DataFrame, kind: str, model: Rates) -> list[Row]:
    """Sums of what Patterns finds in each part of patterns(v, n): rows (i, j, n0, n1); j is 0 for counts."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("v")
            part = Patterns(v.values.to_numpy(), v.offsets.to_numpy(), b.column("n").to_numpy())
            if kind == "counts":
                both = part.counts(model)
                i, j = np.arange(both.shape[1]), np.zeros(both.shape[1], np.int64)
            else:
                i, j, both = part.company(model)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(both[0]), pa.array(both[1])], ["i", "j", "n0", "n1"])

    return patterns.mapInArrow(find, "i int, j int, n0 double, n1 double").groupBy("i", "j").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect()


def fit(docs: DataFrame, labels: DataFrame, targets: str = "model") -> tuple[Model, DataFrame | None]:
    """The classifier; and doc_id and v of every row of docs, written, where there are voters. targets: what the classifier learns, the
    posteriors of the label model, or for comparison "votes" (whether any voter fires), or "gold"."""
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic in (0, 1)")
    mark = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000))
    learn = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    n = learn.count()
    known = learn.where(mark < F.lit(int(1e6 * min(1.0, SAMPLE / max(1, n))))).withColumn("gold", F.col("toxic").cast("int"))
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    sample = docs.join(known.select("doc_id", "gold"), "doc_id").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= REPEATS).select("text", "gold")
    sample = stored(sample, "toxicity-sample")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = (Counter(), Counter())
            for text, gold in zip(*(c.to_pylist() for c in batch.columns)):
                hits[gold].update(firing(found_in(text or ""), len((text or "").split())))
            words = list({**hits[0], **hits[1]})
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([h[w] for w in words], pa.int64()) for h in hits)], ["f", "n0", "n1"])

    size = {r.gold: r["count"] for r in sample.groupBy("gold").count().collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    if not n0 or not n1:
        p = (n1 + 1) / (n0 + n1 + 2)
        return Model({}, np.array([0.0] * len(PATTERNS) + [np.log(p / (1 - p))])), None
    found = sample.mapInArrow(counts, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    precise = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
    top = found.where((F.col("n1") >= SUPPORT) & (precise >= PRECISION)).orderBy(F.desc("n1"), F.desc(precise), "f").limit(VOTERS).collect()
    voters = {r.f: i for i, r in enumerate(sorted(top, key=lambda r: r.f))}
    all_voters = len(voters) + len(PATTERNS)

    votes = stored(votes_of(docs, voters, ("doc_id",)), "votes")
    mined = sorted((r.gold, r.v) for r in votes_of(sample, voters, ("gold",)).collect())
    x = np.zeros((len(mined), all_voters + 1), np.float32)
    for k, (_, v) in enumerate(mined):
        x[k, v] = 1
    x[:, -1] = 1
    gold = np.array([g for g, _ in mined], float)
    if targets != "model":
        return Model(voters, logistic(x, gold if targets == "gold" else np.minimum(1, x[:, : len(voters)].sum(1)))), votes

    patterns = stored(votes.where(~held_out(F.col("doc_id"))).groupBy("v").agg(F.count("*").alias("n")), "patterns")

    def summed(model: Rates) -> np.ndarray:
        out = np.zeros((2, all_voters + 1))
        for r in over(patterns, "counts", model):
            out[:, r.i] = r.n0, r.n1
        return out

    def together(model: Rates) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = over(patterns, "company", model)
        return np.array([r.i for r in rows], int), np.array([r.j for r in rows], int), np.array([[r.n0 for r in rows], [r.n1 for r in rows]])

    model = label_model(np.stack([(1 - gold) @ x, gold @ x]).astype(float), summed, together)
    base, weight = model.evidence()
    return Model(voters, logistic(x, sigmoid(base + x[:, :-1] @ weight))), votes


def linear(rows: DataFrame, model: Model) -> DataFrame:
    """rows(..., v) with score in place of v."""
    fields, w = [f for f in rows.schema.fields if f.name != "v"], model.weights

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            total = np.concatenate([[0.0], np.cumsum(w[v.values.to_numpy()])])
            at = v.offsets.to_numpy()
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in fields), pa.array(sigmoid(total[at[1:]] - total[at[:-1]] + w[-1]))], [*(f.name for f in fields), "score"])

    return rows.mapInArrow(scores, StructType([*fields, StructField("score", DoubleType())]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column score (0 to 1)."""
    prepare(docs.sparkSession)
    text_at, schema = docs.columns.index("text"), docs.schema

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = Votes(model.voters)
        w = model.weights
        for batch in batches:
            z = np.array([w[votes(t or "")].sum() + w[-1] for t in batch.column(text_at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigmoid(z))], [*batch.schema.names, "score"])

    return docs.mapInArrow(scores, StructType([*schema.fields, StructField("score", DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, targets: str = "model") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text)."""
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    with scratch() as keep:
        model, votes = fit(docs, labels, targets)
        keep(*filter(None, [votes]))
    out = score(docs, model).select("doc_id", "score") if votes is None else linear(votes, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
