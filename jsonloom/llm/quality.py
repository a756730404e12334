"""Quality by a factorisation machine.

Inputs: hashed words (share of the text), structure statistics and length
metadata. The score is

    b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)

so that all pairwise interactions of rank ``rank`` cost linear time. Trained
with Adam on a bounded sample on the driver; scored on Arrow batches of whole
texts, where the rows are, without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

TOKEN = re.compile(r"[^\W_]+")
PIECE = re.compile(r"\S+")
#: Names of the dense inputs, in order.
DENSE = ("log_chars", "log_words", "log_lines", "word_length", "upper", "digits", "marks", "space", "distinct_words", "repeated_lines", "line_length", "ends_in_stop", "long_words", "doubled_marks")


@dataclass(frozen=True)
class FM:
    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    buckets: int

    def raw(self, starts: np.ndarray, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Scores of rows given as flat lists; ``starts`` has a last entry of len(ids). No row is empty: dense inputs are always there."""
        vx = self.v[ids] * values[:, None]
        at = starts[:-1]
        s, q = np.add.reduceat(vx, at, axis=0), np.add.reduceat(vx**2, at, axis=0)
        return self.bias + np.add.reduceat(self.w[ids] * values, at) + 0.5 * (s**2 - q).sum(axis=1)


def dense_of(text: str, pieces: list[str], words: Counter, n_words: int) -> list[float]:
    n = max(1, len(text))
    lines = text.split("\n")
    letters = sum(map(len, pieces))
    upper = sum(map(str.isupper, pieces)) / max(1, len(pieces))
    alnum = sum(len(w) * c for w, c in words.items())
    digits = sum(len(w) * c for w, c in words.items() if w.isdigit())
    stops = sum(p[-1] in ".,;:" for p in pieces)
    doubled = sum(len(p) > 2 and not p[-1].isalnum() and p[-1] == p[-2] for p in pieces)
    m = max(1, len(pieces))
    return [np.log1p(len(text)), np.log1p(n_words), np.log1p(len(lines)), letters / m / 10, upper, digits / n, (letters - alnum) / n, (n - letters) / n, len(words) / max(1, n_words), 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), stops / m, sum(len(p) > 20 for p in pieces) / m, doubled / m]


def inputs(text: str | None, buckets: int) -> tuple[list[int], list[float]]:
    """Ids and values of a text: dense inputs first (always all), then its hashed words by share."""
    text = text or ""
    words = Counter(TOKEN.findall(text.lower()))
    n = sum(words.values())
    hashed: dict[int, float] = {}
    for w, c in words.items():
        i = len(DENSE) + zlib.crc32(w.encode()) % buckets
        hashed[i] = hashed.get(i, 0.0) + c
    norm = sum(c * c for c in hashed.values()) ** 0.5 or 1.0
    return [*range(len(DENSE)), *hashed], [*dense_of(text, PIECE.findall(text), words, n), *[c / norm for c in hashed.values()]]


def _flat(rows: list[tuple[list[int], list[float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.cumsum([0, *[len(i) for i, _ in rows]])
    return starts, np.concatenate([np.asarray(i, np.int64) for i, _ in rows]), np.concatenate([np.asarray(v, np.float64) for _, v in rows])


def fm_fit(starts: np.ndarray, ids: np.ndarray, values: np.ndarray, y: np.ndarray, buckets: int, rank: int = 8, epochs: int = 12, batch: int = 256, rate: float = 0.02, l2: float = 1e-4, seed: int = 0) -> FM:
    """Adam on the logistic loss over rows in flat lists (as in ``FM.raw``), dense inputs first; those are standardised."""
    rng = np.random.default_rng(seed)
    k = len(DENSE)
    place = starts[:-1, None] + np.arange(k)
    mean, scale = values[place].mean(axis=0, dtype=np.float64), values[place].std(axis=0, dtype=np.float64) + 1e-6
    values = values.copy()
    values[place] = np.clip((values[place] - mean) / scale, -5, 5)
    rate_y = float(np.clip(y.mean(), 0.01, 0.99))
    w, v, b = np.zeros(k + buckets), rng.normal(0, 0.01, (k + buckets, rank)), np.log(rate_y / (1 - rate_y))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, v)] + [[0.0, 0.0]]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            part = order[at : at + batch]
            rows = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in part])
            size = starts[part + 1] - starts[part]
            first, i, x = np.cumsum(size) - size, ids[rows], values[rows].astype(np.float64)
            own = np.repeat(np.arange(len(part)), size)
            vx = v[i] * x[:, None]
            s = np.add.reduceat(vx, first, axis=0)
            z = b + np.add.reduceat(w[i] * x, first) + 0.5 * (s**2 - np.add.reduceat(vx**2, first, axis=0)).sum(axis=1)
            d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[part]) / len(part)
            some, back = np.unique(i, return_inverse=True)
            gw = np.bincount(back, d[own] * x, len(some)) + l2 * w[some]
            gv_rows = (d[own] * x)[:, None] * (s[own] - vx)
            gv = np.stack([np.bincount(back, gv_rows[:, f], len(some)) for f in range(rank)], axis=1) + l2 * v[some]
            t += 1
            for p, g, (m1, m2) in ((w, gw, state[0]), (v, gv, state[1])):
                m1[some] = 0.9 * m1[some] + 0.1 * g
                m2[some] = 0.999 * m2[some] + 0.001 * g**2
                p[some] -= rate * (m1[some] / (1 - 0.9**t)) / (np.sqrt(m2[some] / (1 - 0.999**t)) + 1e-8)
            g = d.sum()
            state[2] = [0.9 * state[2][0] + 0.1 * g, 0.999 * state[2][1] + 0.001 * g * g]
            b -= rate * (state[2][0] / (1 - 0.9**t)) / (state[2][1] ** 0.5 / (1 - 0.999**t) ** 0.5 + 1e-8)
    return FM(float(b), w.astype(np.float32), v.astype(np.float32), mean, scale, buckets)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, buckets: int = 1 << 15, rank: int = 8, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> FM:
    """A model from at most ``sample`` labelled rows of each label, the least by a hash of their id.

    ``labels`` holds the rows to learn from and no others. Null labels go;
    repeated rows of an id count once, with the largest label. Without rows of
    both labels the score is the share of label 1 (0.5 where nothing is known).
    """
    known = pick(labels, doc_id=id_col, label=label_col).where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    order = (F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    one, zero = [known.where(F.col("label") == k).orderBy(*order).limit(sample) for k in (1, 0)]
    share = known.agg(F.avg("label").alias("p")).first()["p"]
    chosen = F.broadcast(one.unionByName(zero))  # at most 2 * sample rows

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [inputs(t.as_py(), buckets) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([i for i, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float32()))], ["doc_id", "label", "ids", "vals"])

    d = pick(docs, doc_id=id_col, text=text_col)
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, label int, ids array<int>, vals array<float>"
    rows = d.join(chosen, "doc_id").select("doc_id", "label", "text").mapInArrow(parts, schema).toPandas().sort_values("doc_id", kind="stable")
    y = rows["label"].to_numpy(np.float64)
    if len(set(y)) < 2:
        p = float(np.clip(0.5 if share is None else share, 1e-6, 1 - 1e-6))
        k = len(DENSE) + buckets
        return FM(float(np.log(p / (1 - p))), np.zeros(k, np.float32), np.zeros((k, rank), np.float32), np.zeros(len(DENSE)), np.ones(len(DENSE)), buckets)
    starts = np.cumsum([0, *map(len, rows["ids"])])
    return fm_fit(starts, np.concatenate(rows["ids"].to_list()), np.concatenate(rows["vals"].to_list()), y, buckets, rank, seed=seed)


def score(docs: DataFrame, model: FM, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs`` over whole texts; null and empty texts have dense inputs only."""
    d = pick(docs, doc_id=id_col, text=text_col)
    k = len(DENSE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 256):
                starts, ids, values = _flat([inputs(t.as_py(), model.buckets) for t in batch.column("text").slice(at, 256)])
                place = starts[:-1, None] + np.arange(k)
                values[place] = np.clip((values[place] - model.mean) / model.scale, -5, 5)
                out.append(1 / (1 + np.exp(-np.clip(model.raw(starts, ids, values), -40, 40))))
            s = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
