"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, all other text is unlabelled, not
clean. Linear numpy classifiers g minimise the class-prior-corrected risk

    prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])

with the logistic loss; where the bracket is negative its gradient is reversed,
which keeps the flexible model from fitting it below zero. Several classifiers
are fitted on bootstraps of the unlabelled sample and their scores averaged.

Inputs of a score are the words, and beginnings of words, of the whole text:
presence of each that stands out among positives. Words are matched without regard to
case or punctuation.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, pick, table
from .words import map_slices

TOKEN = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class PUModel:
    """words: feature words; weights: a row for each classifier; biases; prior: share of positives among the unlabelled."""

    words: tuple[str, ...]
    weights: np.ndarray
    biases: np.ndarray
    prior: float

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        """0 to 1 for each list of present features."""
        total = np.repeat(self.biases[None, :], len(rows), axis=0)
        for i, present in enumerate(rows):
            if present:
                total[i] += self.weights[:, present].sum(axis=1)
        return (1 / (1 + np.exp(-np.clip(total, -40, 40)))).mean(axis=1)


def words_of(text: str | None) -> set[str]:
    """Words of a text, and the first five letters of longer ones, which inflected forms share."""
    words = set(TOKEN.findall((text or "").lower()))
    return words | {"^" + w[:5] for w in words if len(w) > 5}


def nnpu_fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, classifiers: int = 3, steps: int = 400, rate: float = 0.1, l2: float = 1e-4, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of ``classifiers`` models over 0/1 rows, by Adam on the non-negative PU risk."""
    rng = np.random.default_rng(seed)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    weights, biases = [], []
    for _ in range(classifiers):
        u = unlabelled[rng.integers(0, len(unlabelled), len(unlabelled))]
        p = positive
        w = np.zeros(p.shape[1] + 1, np.float32)
        w[-1] = np.log(prior / (1 - prior))
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            gp, gu = sigmoid(p @ w[:-1] + w[-1]), sigmoid(u @ w[:-1] + w[-1])
            # l(g) = log(1 + exp(-g)): dl(g) = s - 1; dl(-g) = s
            push = lambda x, d: np.append(d @ x / len(x), d.mean())
            part_p, part_n = prior * push(p, gp - 1), push(u, gu) - prior * push(p, gp)
            negative = np.logaddexp(0, u @ w[:-1] + w[-1]).mean() - prior * np.logaddexp(0, p @ w[:-1] + w[-1]).mean()
            grad = (part_p + part_n if negative >= 0 else -part_n) + l2 * np.append(w[:-1], 0)
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        weights.append(w[:-1])
        biases.append(w[-1])
    return np.array(weights, np.float64), np.array(biases, np.float64)


def _distinct_words(docs: DataFrame) -> DataFrame:
    """(kind, words): distinct words of whole texts; what a sample of documents sends to the driver."""

    def words(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("kind"), pa.array([sorted(words_of(t.as_py())) for t in part.column("text")], pa.list_(pa.string()))], ["kind", "words"])

    return map_slices(docs.select("kind", "text"), words, "kind int, words array<string>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, features: int = 256, prior: float | None = None, classifiers: int = 3, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> PUModel:
    """A model from labelled rows; ``labels`` holds the rows to learn from and no others.

    At most ``sample`` positives and twice as many unlabelled documents, the
    least by a hash of their id, are used: that bound is the only one, and
    scoring is over everything. The unlabelled are documents whose id is in
    ``labels`` taken without their label, positives among them. The prior is
    the share of positives in ``labels`` unless given. Without any positive,
    or any other row, the model has no words and scores the prior (0 if none).
    Null labels count as unlabelled; repeated label rows count once, as positive if
    any of them is.
    """
    known = pick(labels, doc_id=id_col, label=label_col).where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    seen = known.agg(F.avg("label").alias("p"), F.count("*").alias("n")).first()
    prior = prior if prior is not None else float(seen["p"] or 0.0)
    prior = min(prior, 0.9)
    if not seen["n"] or prior <= 0:
        return PUModel((), np.zeros((1, 0)), np.array([-40.0]), prior)
    order = F.xxhash64("doc_id", F.lit(seed))
    chosen = known.where("label = 1").orderBy(order, "doc_id").limit(sample).select("doc_id", F.lit(1).alias("kind"))
    others = known.orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").limit(2 * sample).select("doc_id", F.lit(0).alias("kind"))
    ids = F.broadcast(chosen.unionByName(others))  # at most 3 * sample rows
    held = table(_distinct_words(pick(docs, doc_id=id_col, text=text_col).join(ids, "doc_id")))
    size = {r["kind"]: r["n"] for r in held.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    if set(size) != {0, 1}:
        return PUModel((), np.zeros((1, 0)), np.array([-40.0]), prior)
    words = standing_out(held, size[1], size[0], features)
    if not words:
        return PUModel((), np.zeros((1, 0)), np.array([float(np.log(prior / (1 - prior)))]), prior)
    at = {w: i for i, w in enumerate(words)}
    rows = held.select("kind", F.array_intersect("words", F.array(*map(F.lit, words))).alias("words")).toPandas()
    drop_table(held)

    def matrix(kind: int) -> np.ndarray:
        present = rows["words"][rows["kind"] == kind]
        x = np.zeros((len(present), len(words)), np.float32)
        for i, s in enumerate(present):
            x[i, [at[w] for w in s]] = 1
        # rows in an order of their own, so that the fit does not depend on how tasks ended
        return x[np.lexsort(x.T[::-1])]

    weights, biases = nnpu_fit(matrix(1), matrix(0), prior, classifiers, seed=seed)
    return PUModel(tuple(words), weights, biases, prior)


def standing_out(held: DataFrame, n: int, m: int, features: int, least: int = 3, score: float = 4.0, few: int = 8, few_score: float = 3.0) -> list[str]:
    """At most ``features`` words whose document share among the n positives is ``score`` standard errors over that among the m unlabelled: at 4, some 30,000 words give one by chance.

    Few positives can't lift a word that far, so the first ``few`` words stay from ``few_score`` standard errors on.
    """
    counts = held.select("kind", F.explode("words").alias("word")).groupBy("word").agg(F.sum("kind").alias("a"), F.count("*").alias("all")).where(F.col("all") >= least)
    share = F.col("all") / (n + m)
    z = (F.col("a") / n - (F.col("all") - F.col("a")) / m) / F.greatest(F.lit(1e-9), F.sqrt(share * (1 - share) * (1 / n + 1 / m)))
    best = counts.withColumn("z", z).where(F.col("z") >= min(score, few_score)).orderBy(F.desc("z"), "word").limit(features).collect()  # at most `features` rows
    return [r["word"] for i, r in enumerate(best) if r["z"] >= score or i < few]


def score(docs: DataFrame, model: PUModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, score, predicted, *keep) of every row of ``docs``, over whole texts.

    ``keep`` names further columns to carry. Null and empty texts have no word
    and get the score of that; repeated rows get equal scores; no shuffle.
    """
    keep = keep or []
    d = pick(docs, **{f"k{i}": c for i, c in enumerate(keep)}, doc_id=id_col, text=text_col)
    at, vocabulary = {w: i for i, w in enumerate(model.words)}, frozenset(model.words)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema if f.name != "text")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        s = model.scores([[at[w] for w in words_of(t.as_py()) & vocabulary] for t in part.column("text")])
        names = [n for n in part.schema.names if n != "text"]
        columns = [part.column(n) for n in names] + [pa.array(s), pa.array((s >= threshold).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, [*names, "score", "predicted"])

    out = map_slices(d, run, f"{kinds}, score double, predicted int")
    return out.select("doc_id", "score", "predicted", *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)])


def held_out(id_col: str, folds: int, fold: int):
    """Whether crc32 of the id as text, modulo ``folds``, is ``fold``."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold
