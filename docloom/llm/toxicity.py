"""Toxicity by a classifier chain.

Method: the label categories form a chain of linear (logistic) models. Each later model also
reads the logits of the earlier categories' probabilities; in training these come from
out-of-fold predictions, so that a later link sees earlier outputs as they are on unseen
texts. Here the chain is low quality, then toxic.

Features of a text: presence of words (letters, digits and non-ASCII bytes, A-Z folded), the
FEATURES words a category tells apart best on its training rows by a two-proportion z score,
and four shape figures (shares of punctuation and capitals, word length, log length).

Training takes at most SAMPLE labelled rows (those of least xxhash64(doc_id)), joined to
their texts by a broadcast of that bounded sample. Scoring reads every whole text once
without a shuffle. The threshold is the one of best F1 on out-of-fold predictions.

Defined results: null text is empty; a text without words is never toxic, its probabilities
are those of a text without features; repeated labels count once (the larger value); without
labels of both classes a category's probability is its share of positive rows and nothing
is toxic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import configure, slices, table, text_bytes, without, words

SAMPLE = 4000
FEATURES = 192
FOLDS = 5
LEAST_DOCS = 4
RIDGE = 2.0

_LETTERS = np.zeros(256, bool)
_LETTERS[48:58] = _LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def features(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text column: word hashes, n + 1 offsets of the texts into them, shape figures."""
    data, off = text_bytes(column)
    h, begin, end, at = words(data, off, is_word=_LETTERS)
    size = np.maximum(np.diff(off), 1)
    share = lambda on: np.diff(np.append(0, np.cumsum(on[data]))[off]) / size
    n = np.diff(at)
    length = np.diff(np.append(0, np.cumsum(end - begin))[at]) / np.maximum(n, 1)
    return h, at, np.stack([share(_PUNCT), share(_UPPER), length, np.log1p(n)], axis=1)


class Link:
    """One category: selected words, scaling of the dense columns, weights."""

    def __init__(self, chosen: np.ndarray, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.chosen, self.mean, self.scale, self.weights = chosen, mean, scale, weights

    @classmethod
    def fit(cls, docs: list[np.ndarray], dense: np.ndarray, y: np.ndarray) -> Link:
        all_h = np.concatenate(docs) if docs else np.zeros(0, np.uint64)
        label = np.repeat(y, [len(d) for d in docs])
        uniq, inv = np.unique(all_h, return_inverse=True)
        n1, n0 = max(y.sum(), 1), max(len(y) - y.sum(), 1)
        c1 = np.bincount(inv, label, len(uniq))
        c0 = np.bincount(inv, 1 - label, len(uniq))
        p = (c1 + c0) / (n1 + n0)
        z = np.abs(c1 / n1 - c0 / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
        z[c1 + c0 < LEAST_DOCS] = 0
        chosen = np.sort(uniq[np.lexsort((uniq, -z))[:FEATURES]])
        mean, scale = dense.mean(axis=0), dense.std(axis=0) + 1e-6
        one = cls(chosen, mean, scale, np.zeros(len(chosen) + dense.shape[1] + 1))
        flat, at = (np.concatenate(docs), np.append(0, np.cumsum([len(d) for d in docs])))
        x = one.matrix(flat, at, dense)
        one.weights = _logistic(x, y)
        return one

    def matrix(self, h: np.ndarray, at: np.ndarray, dense: np.ndarray) -> np.ndarray:
        n, k = len(at) - 1, len(self.chosen)
        x = np.zeros((n, k + dense.shape[1] + 1))
        if k and len(h):
            pos = np.minimum(np.searchsorted(self.chosen, h), k - 1)
            hit = np.flatnonzero(self.chosen[pos] == h)
            x[np.searchsorted(at, hit, "right") - 1, pos[hit]] = 1
        x[:, k:-1] = np.clip((dense - self.mean) / self.scale, -4, 4)
        x[:, -1] = 1
        return x

    def logits(self, h, at, dense) -> np.ndarray:
        return self.matrix(h, at, dense) @ self.weights


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 15) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column is the intercept."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        g = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge), g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Chain:
    """Links in order; threshold of the last category."""

    def __init__(self, names: list[str], links: list, threshold: float):
        self.names, self.links, self.threshold = names, links, threshold

    @classmethod
    def fit(cls, names: list[str], docs: list[np.ndarray], dense: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> Chain:
        links, out_of_fold = [], None
        for k in range(len(names)):
            y = labels[:, k].astype(float)
            if not len(y) or y.min() == y.max():
                links.append(float(y.mean()) if len(y) else 0.0)
                out_of_fold = np.full(len(y), -30.0 if not len(y) or y.mean() < 0.5 else 30.0)
                dense = np.column_stack([dense, out_of_fold])
                continue
            out_of_fold = np.zeros(len(y))
            for f in range(FOLDS):
                train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                if not len(test) or not len(train) or y[train].min() == y[train].max():
                    continue
                link = Link.fit([docs[i] for i in train], dense[train], y[train])
                at = np.append(0, np.cumsum([len(docs[i]) for i in test]))
                out_of_fold[test] = link.logits(np.concatenate([docs[i] for i in test]), at, dense[test])
            links.append(Link.fit(docs, dense, y))
            dense = np.column_stack([dense, out_of_fold])
        threshold = 2.0
        if names and isinstance(links[-1], Link):
            threshold = _best(_sigmoid(out_of_fold), labels[:, -1])
        return cls(names, links, threshold)

    def probabilities(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(rows, categories), and whether a text has words."""
        h, at, dense = features(column)
        out = []
        for link in self.links:
            z = link.logits(h, at, dense) if isinstance(link, Link) else np.full(len(at) - 1, np.log(max(link, 1e-12) / max(1 - link, 1e-12)))
            out.append(_sigmoid(z))
            dense = np.column_stack([dense, z])
        return np.stack(out, axis=1), np.diff(at) > 0


def _best(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of best F1, midway between neighbouring scores."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    k = int(np.argmax(f1))
    lower = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + lower) / 2)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """categories: name -> SQL expression of 0/1 over the labels table, in chain order."""
    names = list(categories)
    rows = labels.where(f"{id_col} is not null").groupBy(F.col(id_col).cast("long").alias("id")).agg(*[F.max(F.expr(e)).cast("int").alias(n) for n, e in categories.items()])
    rows = rows.dropna().orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                h, at, dense = features(part.column("text"))
                blobs = [np.unique(h[at[i] : at[i + 1]]).tobytes() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *[part.column(n) for n in names], pa.array(blobs, pa.binary()), pa.array(list(dense), pa.list_(pa.float64()))], ["id", *names, "h", "dense"])

    schema = "id long, " + "".join(f"`{n}` int, " for n in names) + "h binary, dense array<double>"
    # rows with one id share a label: the first text by hash stands for them (combined in the tasks,
    # so at most SAMPLE rows come to the driver)
    one = texts.join(F.broadcast(rows), "id").groupBy("id", *names).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    got = sorted(one.select("id", *names, "text").mapInArrow(cut, schema).collect(), key=lambda r: r.id)
    hashes = [np.frombuffer(r.h, np.uint64) for r in got]
    dense = np.array([r.dense for r in got]).reshape(len(got), 4)
    y = np.array([[r[n] for n in names] for r in got]).reshape(len(got), len(names))
    return Chain.fit(names, hashes, dense, y, np.array([r.id % FOLDS for r in got]))


#: The labels table's columns as a chain.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def score(docs: DataFrame, chain: Chain, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with p_<category> for each category and `rejected` for the last (names after a
    prefix; they replace columns of the same names)."""
    configure(docs.sparkSession)
    more = [T.StructField(f"{prefix}p_{n}", T.DoubleType()) for n in chain.names] + [T.StructField(f"{prefix}rejected", T.BooleanType())]
    docs = without(docs, [f.name for f in more])
    names = docs.columns

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                p, has = chain.probabilities(part.column(text_col))
                bad = has & (p[:, -1] >= chain.threshold)
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(p[:, k]) for k in range(p.shape[1])], pa.array(bad)], [*names, *[f.name for f in more]])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = train(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    return score(docs, chain).select("doc_id", "p_low_quality", "p_toxic", F.col("rejected").alias("toxic"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chain = train(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    return score(docs, chain, prefix="_dl_").where(~F.col("_dl_rejected")).select(*docs.columns)
