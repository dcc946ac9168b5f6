"""Operator 10: toxicity by non-negative positive-unlabelled learning.

A linear classifier is trained in numpy on confirmed toxic documents (P) and on text whose
labels aren't looked at (U, toxic in part). With the class prior p the risk of calling U
clean is corrected for the toxic part of it: p E_P[l(+)] + max(0, E_U[l(-)] - p E_P[l(-)]).
Where a batch's corrected part is negative, the classifier has begun to learn U by heart, and
the step goes the other way for that part, as the non-negative estimator has it.

Features are hashed words and word beginnings (4 to 7 bytes), counted over the root of the
number of words, so a document's logit is a bias and a sum of word weights over that root:
scoring is one table look-up a feature for whole texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K

BITS = 22  # so many buckets that features of a corpus sample rarely share one
BEGINNINGS = (4, 5, 6, 7)
THRESHOLD = 0.7
SCALE = 5.0
#: The median toxic document's logit is so far above the threshold's.
MIDDLE = 2.2


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 by 3. A null id isn't held out, nor learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _features(words: K.Words) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each kind of feature: the words that have it (as numbers), and its hashed index."""
    s, e = words.starts, words.ends
    who, spans = [np.arange(len(s))], [(s, e)]
    for n in BEGINNINGS:
        long = np.flatnonzero(e - s > n)
        who.append(long)
        spans.append((s[long], s[long] + n))
    hashed = words.span_hashes(spans)
    kinds = [np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1) for i in range(len(spans))]
    return np.concatenate(who), [(K.mix(h ^ k) >> np.uint64(64 - BITS)).astype(np.int64) for h, k in zip(hashed, kinds)]


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return K.string_buffers(pc.utf8_lower(column))


def _matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (row, feature) entries and their values."""
    raw, offsets = _lowered(pa.array(texts, pa.string()))
    rows, cols, vals = [], [], []
    for a, b, part, off in K.chunks(raw, offsets):
        words = K.Words(part, off, K.NON_WORD)
        who, kinds = _features(words)
        doc = K.row_of(words.first)[who]
        key, count = np.unique(doc << BITS | np.concatenate(kinds), return_counts=True)
        doc = key >> BITS
        rows.append(doc + a)
        cols.append(key & (1 << BITS) - 1)
        vals.append(count / np.sqrt(np.maximum(1, np.diff(words.first)))[doc])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)


def risk_gradient(w: np.ndarray, bias: float, xp: np.ndarray, xu: np.ndarray, prior: float, decay: float) -> tuple[np.ndarray, float]:
    """The step's direction (weights, then bias) and the corrected risk of calling U clean.

    Where that is not negative, the direction is the gradient of the whole risk, else away
    from the gradient of that part alone, as the non-negative estimator has it.
    """
    zp, zu = xp @ w + bias, xu @ w + bias
    sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
    rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    g_pos, away_p, away_u = prior * (sp - 1) / len(xp), -prior * sp / len(xp), su / len(xu)
    g_p, g_u = (g_pos + away_p, away_u) if rest >= 0 else (-away_p, -away_u)
    return np.append(g_p @ xp + g_u @ xu + decay * w, g_p.sum() + g_u.sum()), rest


def _telling(row: np.ndarray, col: np.ndarray, n_p: int, n: int, most: int, least_z: float) -> np.ndarray:
    """The features that P has in more documents than U, beyond chance, the strongest first; of equally strong ones at the bound the lowest numbers."""
    seen, number = np.unique(col, return_inverse=True)
    in_p, in_u = (np.bincount(number[m], minlength=len(seen)) for m in (row < n_p, row >= n_p))
    share = (in_p + in_u) / n
    z = (in_p / n_p - in_u / (n - n_p)) / np.sqrt(share * (1 - share) * (1 / n_p + 1 / (n - n_p)) + 1e-12)
    best = np.argsort(-z, kind="stable")[:most]
    return seen[best[(z[best] >= least_z) & (in_p[best] >= 3)]]


def fit(toxic: list[str], unlabelled: list[str], prior: float, steps: int = 800, batch: int = 256, rate: float = 0.1, decay: float = 1e-4, most_features: int = 600, least_z: float = 3.5, precision: float = 0.98, seed: int = 7) -> Model:
    """A model by minibatch Adam on the non-negative risk; without toxic texts, one that scores 0.

    Then the logits are set so that THRESHOLD lies where the share of U that is called toxic
    is no more than the prior explains: prior * P's share / U's share, an estimate of the
    precision that needs no clean labels, is at least `precision`, and a little beyond.
    """
    none = Model(np.zeros(1 << BITS, np.float32), -np.inf)
    if not toxic or not unlabelled:
        return none
    n_p, n = len(toxic), len(toxic) + len(unlabelled)
    row, col, val = _matrix(toxic + unlabelled)
    used = _telling(row, col, n_p, n, most_features, least_z)
    if not len(used):
        return none
    order = np.argsort(used)
    at = np.minimum(np.searchsorted(used[order], col), len(used) - 1)
    mine = used[order][at] == col
    x = np.zeros((n, len(used)), np.float32)
    x[row[mine], order[at[mine]]] = val[mine] * SCALE
    w, bias = np.zeros(len(used)), np.log(prior / (1 - prior))
    m1, m2, t = np.zeros(len(used) + 1), np.zeros(len(used) + 1), 0
    rng = np.random.default_rng(seed)
    order_p, order_u = (np.concatenate([rng.permutation(m) for _ in range(-(-steps * batch // m))]) for m in (n_p, n - n_p))
    for k in range(steps):
        xp, xu = x[order_p[k * batch : (k + 1) * batch]], x[n_p + order_u[k * batch : (k + 1) * batch]]
        grad, _ = risk_gradient(w, bias, xp, xu, prior, decay)
        t += 1
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.999 * m2 + 0.001 * grad * grad
        move = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w -= move[:-1]
        bias -= move[-1]
    z = x @ w + bias
    zp, zu = np.sort(z[:n_p]), np.sort(z[n_p:])
    cuts = np.unique(z)
    share = lambda of: 1 - np.searchsorted(of, cuts, "left") / len(of)
    fine = cuts[prior * share(zp) >= precision * share(zu)]
    cut = fine.min() if len(fine) else zp.max()
    middle = max(np.median(zp), cut + 1e-3)
    cut += 0.15 * (middle - cut)
    slope = MIDDLE / (middle - cut)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w * SCALE * slope
    return Model(weights, float((bias - cut) * slope + np.log(THRESHOLD / (1 - THRESHOLD))))


def learn(docs: DataFrame, labels: DataFrame, most_toxic: int = 2_000, most_unlabelled: int = 4_000, most_chars: int = 20_000) -> Model:
    """A model of at most so many documents, the first by a hash of the id, each up to most_chars characters.

    Labels count only of rows that aren't held out, and text only of such documents. The
    class prior is the toxic share of the labels. An id with several labels is toxic if one
    says so; of ids with one hash the smaller goes first.
    """
    mine = lambda df: df.where("doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = mine(labels).where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    first = lambda df, n: sorted({r[0] for r in df.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()})
    toxic, other = set(first(known.where("toxic = 1"), most_toxic)), set(first(mine(docs), most_unlabelled))
    ids = sorted(toxic | other)
    rows = mine(docs).where(F.col("doc_id").isin(ids)).select("doc_id", F.left(F.col("text").cast("string"), F.lit(most_chars)).alias("text")).collect() if ids else []
    texts = sorted({(r.doc_id, r.text) for r in rows if r.text})
    prior = min(max(prior or 0.0, 1e-3), 0.5)
    return fit([t for i, t in texts if i in toxic], [t for i, t in texts if i in other], prior)


def scores(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns, score (0 to 1, higher: toxic likelier) and predicted (1 from THRESHOLD on), a row of docs each.

    A null or empty text has the score of a text without features, the bias alone. Texts are
    scored whole; repeated rows each give a row, and equal texts equal scores; clashing columns
    are replaced; empty tables stay empty.
    """
    keep = [c for c in keep if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            raw, offsets = _lowered(batch.column(len(keep)))
            z = np.zeros(len(batch))
            for a, b, part, off in K.chunks(raw, offsets):
                words = K.Words(part, off, K.NON_WORD)
                who, kinds = _features(words)
                each = np.bincount(who, m.weights[np.concatenate(kinds)], len(words))
                total = np.concatenate(([0.0], np.cumsum(each)))
                z[a:b] = (total[words.first[1:]] - total[words.first[:-1]]) / np.sqrt(np.maximum(1, np.diff(words.first)))
            score = np.round(1 / (1 + np.exp(-np.clip(z + m.bias, -700, 700))), 9)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], [*keep, "score", "predicted"])

    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add("score", "double").add("predicted", "integer")
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)
