"""Toxicity by weak supervision.

1. From at most TRAIN_TOXIC and TRAIN_CLEAN labelled rows (those of the smallest hashed ids) the words
   and word beginnings (4 and 5 bytes) that toxic texts have far more often are found; together with
   a fixed word list they make the lexicons.
2. VOTERS voters each hold a share of the words (lexicon voters) or of the beginnings (pattern voters)
   and vote on a text by whether it has any. A generative label model estimates by expectation
   maximisation each voter's rates of firing on toxic and clean texts, and the correlations of voters
   within a class; a voter counts the less the more it repeats others.
3. A logistic regression over the lexicons' features is trained on the model's posterior labels, and
   scores every whole text. Label, language, source and id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from txnclean.llm.shared import table, written
from txnclean.llm.words import alnum_table, word_batches

#: Bounds of the labelled sample the models are fitted on.
TRAIN_TOXIC = 4000
TRAIN_CLEAN = 8000
#: Most features, and the least likelihood-ratio statistic of one.
FEATURES = 1024
LEAST_G = 24.0
VOTERS = 24
BEGINNINGS = (4, 5)

# fixed word list of the first lexicon
INSULTS = ["idiot", "moron", "stupid", "loser", "trash", "scum", "worthless", "pathetic", "disgusting", "clown",
           "imbecile", "dumb", "fool", "filth", "vermin", "scumbag", "jerk", "bastard"]


@dataclass
class Model:
    features: np.ndarray      # sorted 64-bit hashes
    weights: np.ndarray
    bias: float


def fold(id_col: str) -> Column:
    """crc32 of the id as text, mod 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5


def _features(w) -> list[np.ndarray]:
    return [w.hashes, *[w.prefix(k) for k in BEGINNINGS]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) to numbers of toxic and clean texts by feature."""
    for b in batches:
        toxic = np.asarray(b.column(0)).astype(bool)
        for lo, hi, w in word_batches(b.column(1), alnum_table()):
            doc, y = w.doc(), toxic[lo:hi]
            for kind, f in enumerate(_features(w)):
                order = np.lexsort((doc, f))
                f, d = f[order], doc[order]
                new = (f != 0)
                new[1:] &= (f[1:] != f[:-1]) | (d[1:] != d[:-1])
                f, t = f[new], y[d[new]]
                head = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]])) if len(f) else np.zeros(0, int)
                if not len(head):
                    continue
                n1 = np.add.reduceat(t.astype(np.int64), head)
                n = np.diff(np.append(head, len(f)))
                yield pa.RecordBatch.from_arrays([pa.array(f[head].view(np.int64)), pa.array(np.full(len(head), kind, np.int32)),
                                                  pa.array(n1), pa.array(n - n1)], names=["f", "kind", "n1", "n0"])


def _present(features: np.ndarray):
    mask = np.uint64((1 << 18) - 1)
    table_ = np.zeros(1 << 18, bool)
    table_[(features & mask).astype(np.int64)] = True

    def find(w) -> tuple[np.ndarray, np.ndarray]:
        """Different (document, feature) places."""
        out = []
        for f in _features(w):
            hit = np.flatnonzero(table_[(f & mask).astype(np.int64)])
            at = np.minimum(np.searchsorted(features, f[hit]), max(0, len(features) - 1))
            right = features[at] == f[hit] if len(features) else np.zeros(0, bool)
            if right.any():
                doc = np.searchsorted(w.first, hit[right], "right") - 1
                out.append(doc * len(features) + at[right])
        both = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
        return both // max(1, len(features)), both % max(1, len(features))
    return find


def _label_model(votes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Posterior labels of texts from voters' votes (texts by voters, 0 or 1)."""
    y = start
    for _ in range(12):
        prior = np.clip(y.mean(), 1e-3, 0.999)
        fire = np.stack([((1 - y) @ votes + 0.1) / ((1 - y).sum() + 1), (y @ votes + 0.1) / (y.sum() + 1)])
        fire = np.clip(fire, 1e-4, 1 - 1e-4)
        # correlation of each two voters within the classes: what repeats other voters counts less
        centred = votes - (fire[0] + np.outer(y, fire[1] - fire[0]))
        cov = centred.T @ centred / len(votes)
        sd = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
        repeats = np.clip(cov / np.outer(sd, sd), 0, 1)
        share = 1 / (1 + np.clip(repeats.sum(1) - 1, 0, None))
        ratio = votes * np.log(fire[1] / fire[0]) + (1 - votes) * np.log((1 - fire[1]) / (1 - fire[0]))
        y = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + ratio @ share, -30, 30)))
    return y


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent with momentum on soft labels, ridge of 1 per weight."""
    n, m = x.shape
    w, b = np.zeros(m, np.float32), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    vw, vb = np.zeros(m, np.float32), 0.0
    step = 4.0 / (n * 0.25 * max(1.0, float(x.sum(1).max()) / 4) + 1)
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        e = (p - y).astype(np.float32)
        vw = 0.9 * vw - step * (x.T @ e + 0.05 * w)
        vb = 0.9 * vb - step * float(e.sum())
        w, b = w + vw, b + vb
    return w, b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from labelled rows outside the held-out fold. Without labels the fixed word list decides."""
    given = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where(
        (fold("doc_id") != 0) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    pick = lambda y, n: given.where(F.col("toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(n)
    sample = pick(1, TRAIN_TOXIC).union(pick(0, TRAIN_CLEAN))          # of bounded size: may be broadcast
    src = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    texts = written(src.join(F.broadcast(sample), "_id").select("toxic", "text"), "labelled")
    counts = texts.mapInArrow(_counted, "f long, kind int, n1 long, n0 long").groupBy("f").agg(
        F.min("kind").alias("kind"), F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    t1, t0 = sizes.get(1, 0), sizes.get(0, 0)
    base = next(w for _, _, w in word_batches(pa.array([" ".join(INSULTS)]), alnum_table())).hashes
    if not t1 or not t0:
        order = np.argsort(base)
        return Model(base[order], np.full(len(base), 5.0, np.float32), -3.0)
    share = F.lit(t1 / (t1 + t0))
    n = F.col("n1") + F.col("n0")
    part = lambda k, e: F.when(k > 0, k * F.log(k / (n * e))).otherwise(F.lit(0.0))
    g = 2 * (part(F.col("n1"), share) + part(F.col("n0"), 1 - share))
    top = (counts.where((F.col("n1") >= 3) & (F.col("n1") > 2 * share * n)).withColumn("g", g).where(F.col("g") >= LEAST_G)
           .orderBy(F.desc("g"), "f").limit(FEATURES - len(INSULTS)).collect())
    found = np.array([r["f"] for r in top], np.int64).view(np.uint64)
    kind = np.array([r["kind"] for r in top], np.int64)
    extra = base[~np.isin(base, found)]
    features, kind = np.concatenate([found, extra]), np.concatenate([kind, np.zeros(len(extra), np.int64)])
    rank = np.arange(len(features))
    order = np.argsort(features)
    features, kind, rank = features[order], kind[order], rank[order]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _present(features)
        for b in batches:
            for lo, hi, w in word_batches(b.column(1), alnum_table()):
                d, f = find(w)
                border = np.searchsorted(d, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array([f[a:z].astype("<u2").tobytes() for a, z in zip(border, border[1:])], pa.binary())],
                    names=["toxic", "f"])

    rows = texts.mapInArrow(places, "toxic int, f binary").collect()   # bounded by the sample and FEATURES
    x = np.zeros((len(rows), len(features)), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["f"], "<u2")] = 1
    label = np.array([r["toxic"] for r in rows], np.float64)
    # voters: words and beginnings apart, dealt by rank so that each has strong and weak ones
    voter = np.where(kind == 0, rank % (VOTERS // 2), VOTERS // 2 + rank % (VOTERS // 2))
    votes = np.stack([x[:, voter == v].any(1) for v in range(VOTERS) if (voter == v).any()], 1).astype(np.float64)
    y = _label_model(votes, np.where(label > 0, 0.9, 0.1))
    w, b = _logistic(x, y)
    return Model(features, w, b)


def with_score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """All columns of docs and a score from 0 to 1 per row.

    Null and empty texts get the score of a text without any feature. A column of that name is replaced.
    """
    docs = docs.drop(score_col)
    at = docs.columns.index(text_col)
    # columns go by place, whatever characters their names hold
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _present(model.features)
        for b in batches:
            score = np.full(b.num_rows, model.bias, np.float64)
            for lo, hi, w in word_batches(b.column(at), alnum_table()):
                d, f = find(w)
                score[lo:hi] += np.bincount(d, model.weights[f], hi - lo)
            out = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=schema.names)

    return plain.mapInArrow(run, schema).toDF(*docs.columns, score_col)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = with_score(docs, model, score_col="score")
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
