"""Document quality by hierarchical empirical Bayes.

A document classifier gives the evidence of one text; two heads judge *quality* and
*toxic*.  Its inputs are shape figures (symbol tails, capitals, repeats and so on) and the
summed log-odds of words and word beginnings that a lexicon ties to a label.  The lexicon
comes from one half of the labelled rows and the logistic weights from the other half.

Sites correct the evidence.  For all documents of a host and of a path on it, the
classifier's probabilities are summed by grouped aggregation.  The spread between hosts
(between paths) beyond sampling noise gives the strength of the prior, so a sparse path
shrinks towards its host and a sparse host towards the whole.  A document's posterior
log-odds are its evidence, less the training prior, plus the prior of its path without
the document itself.

The fit uses at most ``MOST_LABELS`` labelled rows, taken by the hash of doc_id (a
documented bound); everything else covers all rows.  Without a label of either kind a head
is neutral and rejects nothing.  Null texts are empty; a null host or path is the empty
name; rows of a table without a path column share one path.  Empty tables give no rows,
repeated rows are judged each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import Scratch, join_checked, mix, prefix_hashes, slices, span_hashes, word_spans
from plumbline.llm.common import _FOLDED as CODES

MOST_LABELS = 20_000
MOST_TERMS = 4096
HEADS = ("bad", "toxic")
_TAIL = np.zeros(256, bool)
_TAIL[[ord(c) for c in ".,;:!?"]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER, _LOWER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _LOWER[97:123] = True
SHAPES = 8


def _terms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of each word without a last punctuation mark, and of its first 4 and 5 bytes."""
    prefix = prefix_hashes(data, CODES)
    bare = np.where((ends - starts > 1) & _TAIL[data[ends - 1]], ends - 1, ends) if len(starts) else ends
    out = [span_hashes(prefix, starts, bare)]
    for width in (4, 5):
        out.append(mix(span_hashes(prefix, starts, np.minimum(starts + width, bare)) + np.uint64(width)))
    return out


def _shapes(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Shape figures by row."""
    count = len(offsets) - 1
    per = lambda flag: np.bincount(rows[flag], minlength=count)
    words = np.bincount(rows, minlength=count)
    some = np.maximum(words, 1)
    sums = lambda flag: np.diff(np.r_[0, np.cumsum(flag, dtype=np.int64)][offsets])
    last = data[ends - 1] if len(ends) else data[:0]
    before = data[np.maximum(ends - 2, 0)] if len(ends) else data[:0]
    tails = (ends - starts > 1) & (last == before) & ~_ALNUM[last]
    solid = np.r_[0, np.cumsum(_ALNUM[data], dtype=np.int64)]
    marks = solid[ends] == solid[starts]
    hashes = span_hashes(prefix_hashes(data, CODES), starts, ends)
    repeats = np.zeros(len(starts), bool)
    if len(starts) > 1:
        repeats[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    upper, lower = sums(_UPPER[data]), sums(_LOWER[data])
    size = np.maximum(np.diff(offsets), 1)
    digits = sums((data >= 48) & (data < 58))
    return np.stack([
        np.log1p(words), per(tails) / some, per(marks) / some, per(repeats) / some,
        upper / np.maximum(upper + lower, 1), digits / size, size / some / 10,
        np.minimum(1, upper / np.maximum(upper + lower, 1) * 2) ** 2,
    ], axis=1)


@dataclass
class Model:
    """Sorted term hashes with their log-odds by head; standardised logistic weights by head."""

    terms: np.ndarray
    odds: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: np.ndarray

    def features(self, column: pa.Array) -> np.ndarray:
        seen = np.zeros(1 << 16, bool)
        seen[(self.terms >> np.uint64(48)).astype(np.int64)] = True
        parts = [np.zeros((0, SHAPES + 4))]
        for _, data, offsets in slices(column):
            starts, ends, rows = word_spans(data, offsets)
            count = len(offsets) - 1
            lexical = np.zeros((count, 4))
            if len(self.terms):
                for term in _terms(data, starts, ends):
                    maybe = np.flatnonzero(seen[(term >> np.uint64(48)).astype(np.int64)])
                    at = np.minimum(np.searchsorted(self.terms, term[maybe]), len(self.terms) - 1)
                    hit = self.terms[at] == term[maybe]
                    for head in range(2):
                        lexical[:, head] += np.bincount(rows[maybe[hit]], self.odds[at[hit], head], count)
            words = np.maximum(np.bincount(rows, minlength=count), 1)[:, None]
            lexical[:, 2:] = lexical[:, :2] / np.sqrt(words)
            lexical[:, :2] = np.sign(lexical[:, :2]) * np.log1p(np.abs(lexical[:, :2]))
            parts.append(np.hstack([_shapes(data, offsets, starts, ends, rows), lexical]))
        return np.vstack(parts)

    def logits(self, column: pa.Array) -> np.ndarray:
        x = (self.features(column) - self.center) / self.scale
        return np.clip(x @ self.weights[:, 1:].T + self.weights[:, 0], -30, 30)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps for ridge logistic regression; the intercept comes first."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag(np.r_[1e-6, np.full(x.shape[1] - 1, ridge)])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _lexicon(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Terms tied to a label: hashes in order and log-odds by head."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)], 1)
            for first, data, offsets in slices(batch.column(0), 2 << 20):
                starts, ends, rows = word_spans(data, offsets)
                terms = np.concatenate(_terms(data, starts, ends))
                order = np.lexsort((terms, np.tile(rows, 3)))
                terms, rows3 = terms[order], np.tile(rows, 3)[order]
                new = np.r_[True, (terms[1:] != terms[:-1]) | (rows3[1:] != rows3[:-1])] if len(terms) else np.zeros(0, bool)
                value, inverse = np.unique(terms[new], return_inverse=True)
                counts = [np.bincount(inverse, minlength=len(value))]
                counts += [np.bincount(inverse, labels[first + rows3[new], k], len(value)) for k in range(2)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), *[pa.array(c.astype(np.int64)) for c in counts]], names=["term", "n", "bad", "toxic"]
                )

    total = labelled.agg(F.count("*"), F.sum("bad"), F.sum("toxic")).first()
    sums = labelled.select("text", "bad", "toxic").mapInArrow(run, "term bigint, n bigint, bad bigint, toxic bigint")
    sums = sums.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "toxic")])

    def odds(head: str, whole: int) -> Column:
        inside, outside = F.col(head) + 0.1, F.col("n") - F.col(head) + 0.1
        return F.log(inside / outside) - F.log(F.lit((whole + 0.1) / (total[0] - whole + 0.1)))

    found: dict[int, list[float]] = {}
    for k, head in enumerate(HEADS):
        if total[0] and 0 < total[k + 1] < total[0]:
            strong = sums.filter((F.col(head) >= 3) & (odds(head, total[k + 1]) > 2.5))
            best = strong.select("term", odds(head, total[k + 1]).alias("odds"), (F.col(head) * odds(head, total[k + 1])).alias("gain"))
            for row in best.orderBy(F.desc("gain"), "term").limit(MOST_TERMS).collect():
                found.setdefault(row["term"], [0.0, 0.0])[k] = row["odds"]
    terms = np.array(list(found), np.int64).view(np.uint64)
    order = np.argsort(terms)
    return terms[order], np.array([found[t] for t in found], float).reshape(-1, 2)[order]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    """Fit on at most MOST_LABELS labelled rows."""
    scratch = Scratch(docs.sparkSession)
    chosen = labels.filter("quality is not null and toxic is not null").groupBy("doc_id").agg(
        (1 - F.min("quality")).alias("bad"), F.max("toxic").alias("toxic")
    ).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELS)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    labelled = scratch.keep(rows.join(F.broadcast(chosen), "doc_id").withColumn("half", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2))))
    terms, odds = _lexicon(labelled.filter("half = 0"))
    width = SHAPES + 4
    blank = Model(terms, odds, np.zeros(width), np.ones(width), np.zeros((2, width + 1)), np.full(2, 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = blank.features(batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "bad", "toxic"]
            )

    sample = labelled.filter("half = 1").select("text", F.col("bad").cast("int"), F.col("toxic").cast("int"))
    got = sample.mapInArrow(run, "x array<double>, bad int, toxic int").collect()
    x = np.array([r["x"] for r in got]).reshape(-1, width)
    if len(x):
        blank.center, blank.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        for k, head in enumerate(HEADS):
            y = np.array([r[head] for r in got], float)
            if 0 < y.mean() < 1:
                blank.weights[k] = _logistic((x - blank.center) / blank.scale, y)
                blank.prior[k] = y.mean()
            else:
                blank.weights[k, 0] = -30.0
                blank.prior[k] = 1e-6
    else:
        blank.weights[:, 0], blank.prior[:] = -30.0, 1e-6
    return blank


def with_evidence(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns plus ``__bad`` and ``__toxic``, the classifier's log-odds."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logits = model.logits(batch.column(at))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(logits[:, 0]), pa.array(logits[:, 1])], names=[*batch.schema.names, "__bad", "__toxic"]
            )

    extra = [T.StructField("__bad", T.DoubleType()), T.StructField("__toxic", T.DoubleType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *extra]))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(rows: DataFrame, head: str, center: Column) -> float:
    """Prior strength by moments: spread of the groups' rates around their parent beyond noise."""
    rate, n = F.col(head) / F.col("n"), F.col("n")
    got = rows.filter("n > 1").agg(
        F.sum(n * (rate - center) ** 2).alias("spread"), F.sum(rate * (1 - rate)).alias("noise"),
        F.sum(n).alias("n"), F.sum(n * center * (1 - center)).alias("within"),
    ).first()
    if not got["n"]:
        return 10.0
    between = (got["spread"] - got["noise"]) / got["n"]
    within = got["within"] / got["n"]
    return min(1e6, max(2.0, within / between - 1)) if between > 1e-12 else 1e6


def site_priors(evidence: DataFrame) -> DataFrame:
    """(host, path, n, and per head the sum, the host's shrunk rate and the path's strength).

    ``evidence`` has host, path, __bad and __toxic.
    """
    scratch = Scratch(evidence.sparkSession)
    paths = scratch.keep(evidence.groupBy("host", "path").agg(
        F.count("*").alias("n"), *[F.sum(_sigmoid(F.col(f"__{h}"))).alias(h) for h in HEADS]
    ))
    hosts = scratch.keep(paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", *HEADS)]))
    whole = hosts.agg(*[F.sum(c).alias(c) for c in ("n", *HEADS)]).first()
    out = hosts
    for head in HEADS:
        mean = whole[head] / whole["n"] if whole["n"] else 0.5
        strength = _strength(hosts, head, F.lit(mean))
        out = out.withColumn(f"host_{head}", (F.col(head) + strength * mean) / (F.col("n") + strength))
    joined = scratch.keep(paths.join(out.select("host", *[f"host_{h}" for h in HEADS]), "host"))
    for head in HEADS:
        joined = joined.withColumn(f"strength_{head}", F.lit(_strength(joined, head, F.col(f"host_{head}"))))
    return scratch.keep(joined)


def _posterior(model: Model, head: int) -> Column:
    name = HEADS[head]
    own = _sigmoid(F.col(f"__{name}"))
    prior = (F.col(f"__sum_{name}") - own + F.col(f"__strength_{name}") * F.col(f"__host_{name}")) / (
        F.col("__n") - 1 + F.col(f"__strength_{name}")
    )
    train = float(model.prior[head])
    return _sigmoid(F.col(f"__{name}") - math.log(train / (1 - train)) + _logit(prior))


def _host_path(docs: DataFrame, host: str, path: str | None) -> list[Column]:
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return [named(host).alias("__host"), (named(path) if path else F.lit("")).alias("__path")]


def _with_posteriors(rows: DataFrame, priors: DataFrame, model: Model) -> DataFrame:
    """``rows`` with __host, __path and evidence; adds __p_bad, __p_toxic and __keep."""
    site = priors.select(
        F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("n").alias("__n"),
        *[F.col(h).alias(f"__sum_{h}") for h in HEADS], *[F.col(f"host_{h}").alias(f"__host_{h}") for h in HEADS],
        *[F.col(f"strength_{h}").alias(f"__strength_{h}") for h in HEADS],
    )
    judged = join_checked(rows, site, ["__host", "__path"], "inner", 8 * priors.count())
    judged = judged.withColumns({f"__p_{h}": _posterior(model, k) for k, h in enumerate(HEADS)})
    return judged.withColumn("__keep", (F.col("__p_bad") < 0.5) & (F.col("__p_toxic") < 0.5))


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str | None = "lang", text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, p_quality, p_toxic, host_quality, keep) of each row."""
    model = fit(docs, labels, text, key)
    thin = with_evidence(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), *_host_path(docs, host, path)), model)
    evidence = Scratch(docs.sparkSession).keep(thin.drop("text"))
    priors = site_priors(evidence.withColumnsRenamed({"__host": "host", "__path": "path"}))
    return _with_posteriors(evidence, priors, model).select(
        "doc_id", (1 - F.col("__p_bad")).alias("p_quality"), F.col("__p_toxic").alias("p_toxic"),
        (1 - F.col("__host_bad")).alias("host_quality"), F.col("__keep").alias("keep"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str | None = "lang", text: str = "text") -> DataFrame:
    """The rows that are not rejected, with their columns."""
    model = fit(docs, labels, text)
    names = docs.columns
    thin = with_evidence(docs.select(F.col(text).alias("text"), *_host_path(docs, host, path)), model).drop("text")
    priors = site_priors(Scratch(docs.sparkSession).keep(thin).withColumnsRenamed({"__host": "host", "__path": "path"}))
    rows = with_evidence(docs.select("*", *_host_path(docs, host, path)), model, text)
    return _with_posteriors(rows, priors, model).filter("__keep").select(*names)
