"""Toxicity as an ordered severity: cumulative-link regression on sparse text features.

A document is the set of its words and of their first letters, which stand for a stem
with its endings. All thresholds share one weight per feature: the logit of ``severity > k`` is ``bias_k`` lower for each higher grade, and the expected severity
is the sum of those probabilities. The model is fitted on a bounded sample of labelled
documents; scoring looks at every word of every document.

Grades of the sample come from its labels: 0 is a document that is not labelled toxic;
toxic ones have grade 1 to 3 by how many stems of theirs mark toxic documents (one, two,
or more), where a stem marks them if it occurs in several, and hardly in others.

Defined cases: a null or empty text has no words and the severity of the thresholds
alone. Without labelled documents of both kinds the model is empty and every document
has severity 0. Labels without a document, null labels and repeated labels of a document
(the higher counts) do no harm. Other columns pass unchanged; columns named
``severity``, ``grade`` or ``toxic`` are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textguard.llm.store import in_arrow

#: Labelled documents the model is fitted on, of each kind about.
SAMPLE = 2000
GRADES = 3
#: Words and stems of fewer sampled documents are no features.
LEAST = 4
ROUNDS = 300
SPARSE = 3e-3
#: Letters of a stem.
STEM = 4
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Words in lower case, and their stems with a star."""
    words = set(_WORD.findall((text or "").lower()))
    words.update([w[:STEM] + "*" for w in words])
    return words


@dataclass
class Model:
    """Weights by feature, and one threshold per grade from 1 on."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=lambda: [50.0] * GRADES)

    def score(self, text: str | None) -> float:
        get = self.weights.get
        return sum([get(w, 0.0) for w in features(text)])

    def severity(self, scores: np.ndarray) -> np.ndarray:
        """Probability of each grade or more, one column per grade."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - np.array(self.thresholds), -50, 50)))


def sample(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", about: int = SAMPLE, part: int = 0) -> list:
    """About ``about`` labelled documents of each kind, as ``(text, toxic)``. Different
    ``part`` give samples without common documents while the labels last."""
    known = labels.where("toxic IS NOT NULL").groupBy(F.col(doc).alias("_id")).agg((F.max("toxic") > 0).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    step = lambda kind: max(1, counts.get(kind, 0) // about)
    every = F.when(F.col("toxic"), step(True)).otherwise(step(False))
    chosen = known.where(F.pmod(F.xxhash64("_id"), every) == F.pmod(F.lit(part), every))
    texts = docs.select(F.col(doc).alias("_id"), F.col(text).alias("text"))
    rows = texts.join(F.broadcast(chosen), "_id").select("text", "toxic").distinct().orderBy(F.xxhash64("text"), "text").limit(8 * about)
    return sorted(((r["text"] or "", r["toxic"]) for r in rows.toLocalIterator()), key=lambda r: (r[1], r[0]))


def fit(rows: list[tuple[str, bool]]) -> Model:
    """Fits weights and thresholds on ``(text, toxic)``."""
    toxic = np.array([t for _, t in rows], bool)
    if not toxic.any() or toxic.all():
        return Model()
    sets = [features(t) for t, _ in rows]
    seen: dict[str, list[int]] = {}
    for i, words in enumerate(sets):
        for w in words:
            seen.setdefault(w, []).append(i)
    vocabulary = sorted(w for w, at in seen.items() if len(at) >= LEAST)
    n, rate = len(rows), toxic.mean()
    share = np.array([toxic[seen[w]].mean() for w in vocabulary])
    often = np.array([len(seen[w]) for w in vocabulary])
    marks = {w for w, s, k in zip(vocabulary, share, often) if w[-1] == "*" and s >= 0.95 and k * (1 - rate) >= 10}
    grade = np.array([min(GRADES, max(1, len(s & marks))) if t else 0 for s, t in zip(sets, toxic)])
    row = np.concatenate([np.array(seen[w]) for w in vocabulary]) if vocabulary else np.zeros(0, int)
    col = np.repeat(np.arange(len(vocabulary)), often)
    above = np.stack([grade >= k for k in range(1, GRADES + 1)], axis=1).astype(float)
    # Accelerated proximal steps; thresholds start at the grades' shares.
    share = np.clip(above.mean(axis=0), 1e-3, 1 - 1e-3)
    theta, w = np.log((1 - share) / share), np.zeros(len(vocabulary))
    v, tv = w.copy(), theta.copy()
    rate = 4.0 / max(1.0, np.bincount(row, minlength=n).mean() * 0.25)
    for k in range(ROUNDS):
        score = np.bincount(row, v[col], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - tv, -50, 50)))
        error = (p - above) / n
        new = v - rate * np.bincount(col, error.sum(axis=1)[row], minlength=len(v))
        new = np.sign(new) * np.maximum(np.abs(new) - rate * SPARSE, 0)
        bias = np.sort(tv + rate * error.sum(axis=0))
        pace = k / (k + 3)
        v, tv = new + pace * (new - w), bias + pace * (bias - theta)
        w, theta = new, bias
    return Model({x: float(y) for x, y in zip(vocabulary, w) if y}, [float(t) for t in theta])


def grade_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``severity`` (expected grade), ``grade`` (the highest that is more
    likely than not) and ``toxic`` (grade 1 or more)."""
    own = [c for c in docs.columns if c not in ("severity", "grade", "toxic")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.names.index(text))
            p = model.severity(np.array([model.score(t) for t in column.to_pylist()], float))
            grade = (p >= 0.5).sum(axis=1).astype(np.int32)
            made = [pa.array(p.sum(axis=1)), pa.array(grade), pa.array(grade >= 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "severity", "grade", "toxic"])

    kinds = [("severity", T.DoubleType()), ("grade", T.IntegerType()), ("toxic", T.BooleanType())]
    schema = T.StructType([docs.schema[c] for c in own] + [T.StructField(*k) for k in kinds])
    return in_arrow(docs.select(*own), run, schema)
