"""Mixing sources to target weights by soft membership.

A classifier learnt from the labels table gives every document a posterior over domains. A
projected-gradient least-squares fit then finds nonnegative rates, one a document, whose
expected token totals by domain match the targets:

    min  sum_k (sum_d tokens_d p_dk rate_d - target_k)^2 / T + ridge sum_d tokens_d (rate_d - 1)^2,
    0 <= rate_d <= most_rate        (T: all tokens)

The ridge makes the best rates unique and keeps a document near one where the posteriors hardly tell
domains apart; the caller's most_rate bounds how often a scarce domain may be repeated. The gradient
moves a rate by its posteriors' share of one slope vector: rate_d = 1 - p_d . slope, projected on the
bounds. A round sums totals and the Gram matrix of posteriors of documents inside the bounds over all documents,
scales the gradient step of the slope by it, and halves the step until the objective comes down enough, so
that rounds never make things worse. The driver only ever holds vectors and matrices of domains. A rate
becomes copies by a draw from the hash of the document's id and text. What the bounds leave unmatched
is in the results of `mixture`, and logged.

Tokens are words here. Defined cases: a null or empty text has no tokens, the prior as its
posterior, and a rate like any other; a domain without tokens or without labelled documents cannot be matched and is left
out; without labels all documents are of the first domain, and stay; rows that repeat a doc_id are
documents of their own, with equal draws where their texts are equal; an empty table gives no rows; other columns are
ignored, or kept by `mix_documents`.
"""
from __future__ import annotations

import logging
import re
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catmatch.llm.common import materialize
from catmatch.llm.labelled import labelled_sample
from catmatch.llm.words import WordHashes

#: Domains and the weights wanted of them. The first one is wanted whole.
TARGETS = {"good": 0.97, "poor": 0.02, "toxic": 0.01}
SAMPLE = 20_000
BUCKET_BITS = 18
#: Terms per domain, the labelled documents a term must be in, and the descent of the regression on them.
TERMS, LEAST_DOCUMENTS = 128, 5
DESCENT_ROUNDS, DESCENT_STEP, RIDGE = 400, 0.5, 0.5
#: How often a document may be repeated, the pull of its rate towards one, and when the descent ends.
MOST_RATE, RIDGE_TO_ONE = 10.0, 2e-5
ROUNDS, TOLERANCE, LEAST_STEP = 50, 1e-9, 1e-6
#: Rows that are judged at once; only their texts are Python objects.
BATCH_ROWS = 512
#: A domain whose tokens stay this far (as a share of its target) from the target is reported.
REPORTED = 0.01
_LOG = logging.getLogger(__name__)


_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_NO_PUNCTUATION = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))
_RUNS = re.compile(b"[" + re.escape(_PUNCTUATION) + b"]+")


class Model(NamedTuple):
    prior: np.ndarray  # log-odds of a text without known terms, per domain
    lift: np.ndarray  # what a term adds, buckets x domains


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, 2).when(quality == 1, 0).otherwise(1)


def _terms(text: bytes) -> set[bytes]:
    """Distinct lower-cased words without punctuation, runs of punctuation, and marks of the text's shape."""
    lower = text.lower()
    terms = set(lower.translate(_NO_PUNCTUATION).split())
    terms.update(_RUNS.findall(lower))
    words = lower.split()
    if 2 * (len(text) - len(text.translate(None, _UPPER))) > sum(map(len, words)):
        terms.add(b" capitals")
    if 5 * sum(map(eq, words, words[1:])) > len(words):
        terms.add(b" doubled")
    return terms


def _buckets(text: bytes | None, hashes: WordHashes) -> tuple[np.ndarray, int]:
    """Distinct buckets of the text's terms, and how many words it has."""
    text = text or b""
    terms = _terms(text)
    found = np.fromiter(map(hashes.__getitem__, terms), np.uint64, len(terms))
    return np.unique(found >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), len(text.split())


def fit(docs: DataFrame, labels: DataFrame, domains: int, sample: int = SAMPLE) -> Model:
    """Softmax regression on the terms that tell domains apart best, from at most `sample` labelled documents."""
    chosen = labelled_sample(docs, labels, sample).select(
        "doc_id", F.col("text").cast("binary"), domain_of(F.col("quality"), F.col("toxic")).alias("domain"))

    def held(batches):
        hashes = WordHashes()
        for batch in batches:
            found = [_buckets(t, hashes)[0].astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32())), batch.column(2)],
                                             names=["doc_id", "buckets", "domain"])

    # At most `sample` rows: a labelled id that rows repeat is one document, the one with the smallest buckets.
    rows = materialize(chosen.mapInArrow(held, "doc_id long, buckets array<int>, domain int")
                       .groupBy("doc_id").agg(F.min("buckets").alias("buckets"), F.min("domain").alias("domain")))
    size = 1 << BUCKET_BITS
    documents = np.zeros(domains)
    for domain, n in rows.groupBy("domain").count().collect():
        documents[domain] = n
    documents = documents if documents.sum() else np.eye(domains)[0]
    model = Model(np.log(np.maximum(documents, 1e-30) / documents.sum()), np.zeros((size, domains), np.float32))
    if np.count_nonzero(documents) < 2:
        return model
    # At most domains x buckets counts of a bounded sample.
    counted = (rows.select("domain", F.explode("buckets").alias("bucket")).groupBy("bucket")
               .agg(*[F.sum((F.col("domain") == k).cast("long")).alias(f"n{k}") for k in range(domains)])
               .filter(" + ".join(f"n{k}" for k in range(domains)) + f" >= {LEAST_DOCUMENTS}").toArrow())
    terms = counted.column(0).to_numpy().astype(np.int64)
    order = np.argsort(terms)
    terms, counts = terms[order], np.stack([counted.column(1 + k).to_numpy() for k in range(domains)], 1)[order].astype(float)
    expected = counts.sum(1, keepdims=True) * documents / documents.sum()
    surprise = (counts - expected) ** 2 / np.maximum(expected, 1e-9) / documents.sum()
    best = np.unique(np.concatenate([np.argsort(-surprise[:, k], kind="stable")[:TERMS] for k in range(domains)]))
    terms = terms[best]
    known = rows.select("doc_id", "domain", F.array_intersect("buckets", F.lit(terms.tolist()).cast("array<int>")).alias("buckets")).toArrow()
    known = known.sort_by("doc_id").combine_chunks()
    held_terms = known.column("buckets").combine_chunks()
    x = np.zeros((len(known), len(terms)), np.float32)
    x[np.repeat(np.arange(len(known)), held_terms.value_lengths().to_numpy()), np.searchsorted(terms, held_terms.flatten().to_numpy())] = 1
    y = np.eye(domains, dtype=np.float32)[known.column("domain").to_numpy()]
    weights, bias = np.zeros((len(terms), domains), np.float32), model.prior.astype(np.float32)
    pull_w, pull_b = np.zeros_like(weights), np.zeros_like(bias)  # momentum
    for _ in range(DESCENT_ROUNDS):
        wrong = (_softmax(x @ weights + bias) - y) / len(x)
        pull_w = 0.9 * pull_w + x.T @ wrong + RIDGE / len(x) * weights
        pull_b = 0.9 * pull_b + wrong.sum(0)
        weights, bias = weights - DESCENT_STEP * pull_w, bias - DESCENT_STEP * pull_b
    model.lift[terms] = weights
    return Model(bias.astype(float), model.lift)


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def posteriors(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, p (a probability per domain) and draw (a hash of id and text, from 0 to 1) for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                piece, m = batch.slice(at, BATCH_ROWS), sent.value
                found = [_buckets(t, hashes) for t in piece.column(1).to_pylist()]
                scores = np.array([m.prior + m.lift[b].sum(0) for b, _ in found]).reshape(-1, len(m.prior))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([n for _, n in found], pa.int64()), pa.array(list(_softmax(scores)), pa.list_(pa.float64())), piece.column(2)],
                    names=["doc_id", "n_tokens", "p", "draw"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), draw_of(F.col("doc_id").cast("long"), F.col("text")).alias("draw"))
            .mapInArrow(judge, "doc_id long, n_tokens long, p array<double>, draw double"))


def draw_of(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key, F.lit("mixing")), F.lit(1_000_000)) / 1_000_000


def _rate(slope: list[float], most_rate: float) -> Column:
    """The rate of a document: from one down its share of the slope, put back between nothing and the most."""
    down = [F.get("p", F.lit(i)) * F.lit(float(x)) for i, x in enumerate(slope)]
    return F.greatest(F.lit(0.0), F.least(F.lit(float(most_rate)), F.lit(1.0) - sum(down[1:], down[0])))


class Fit(NamedTuple):
    """Rates as an expression of p, and the totals by domain that were wanted and reached."""
    rate: Column
    targets: list[float]
    reached: list[float]


def fit_rates(judged: DataFrame, weights: list[float], most_rate: float = MOST_RATE, ridge: float = RIDGE_TO_ONE, rounds: int = ROUNDS) -> Fit:
    """The rates of a materialised frame of n_tokens and p.

    The first domain is wanted whole, the others at their weights against it, be that more or less
    than there is of them, up to `most_rate` times as much. Steps are halved until they come down; where none does, or after all rounds, the
    best so far stands.
    """
    k = len(weights)
    share = [F.get("p", F.lit(i)) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def sums(slope: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Totals, the Gram matrix of posteriors whose rates can move, and what the rates cost."""
        rate = _rate(slope.tolist(), most_rate)
        down = [p * F.lit(float(x)) for p, x in zip(share, slope)]
        down = sum(down[1:], down[0])
        inside = (down <= 1) & (down >= 1 - most_rate)
        last = F.greatest(F.lit(1 - most_rate), F.least(F.lit(1.0), down))
        cost = last * last / 2 - last - rate * (down - last)
        row = judged.agg(*[F.sum(F.col("n_tokens") * p * rate) for p in share],
                         *[F.sum(F.when(inside, F.col("n_tokens") * share[i] * share[j]).otherwise(0.0)) for i, j in pairs],
                         F.sum(F.col("n_tokens") * cost)).first()
        values = np.array([x or 0.0 for x in row], float)
        gram = np.zeros((k, k))
        for (i, j), x in zip(pairs, values[k:-1]):
            gram[i, j] = gram[j, i] = x
        return values[:k], gram, values[-1]

    slope = np.zeros(k)
    reached, gram, cost = sums(slope)
    mass, total = reached, reached.sum()
    usable = mass > 1e-9 * total
    wanted = np.where(usable, np.array(weights) / weights[0] * mass[0], mass)
    targets = np.minimum(wanted, most_rate * mass)  # to ask for more than rates can give would only distort the others
    stiff = ridge * total
    height = lambda slope, cost: stiff * slope @ slope / 2 + targets @ slope + cost
    for _ in range(rounds):
        wrong = np.where(usable, stiff * slope - reached + targets, 0.0)
        if np.abs(wrong).max(initial=0) <= TOLERANCE * total:
            break
        step = np.zeros(k)
        step[usable] = np.linalg.solve((gram + stiff * np.eye(k))[np.ix_(usable, usable)], wrong[usable])
        size = 1.0
        while size > LEAST_STEP:
            there = slope - size * step
            found = sums(there)
            if height(there, found[2]) <= height(slope, cost) - 1e-4 * size * (wrong @ step):
                break
            size /= 2
        else:
            break
        slope, (reached, gram, cost) = there, found
    if (np.abs(reached - wanted) > REPORTED * wanted).any():
        _LOG.warning("mixing: targets %s, reached %s", wanted.tolist(), reached.tolist())
    return Fit(_rate(slope.tolist(), most_rate), wanted.tolist(), reached.tolist())


def copies_by(rate: Column, draw: Column) -> Column:
    """Whole copies: the rate, up or down by a draw, so that the mean of the copies is the rate."""
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("int")


def copies_of(rate: Column, *key: Column) -> Column:
    """Whole copies by a draw from the key's hash."""
    return copies_by(rate, draw_of(*key))


def mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, sample: int = SAMPLE, most_rate: float = MOST_RATE) -> DataFrame:
    """doc_id, n_tokens, a posterior per domain, rate and copies for every row of docs, and how far each domain's total is off, as a share of its target."""
    model = fit(docs, labels, len(targets), sample)
    judged = materialize(posteriors(docs, model))
    found = fit_rates(judged, list(targets.values()), most_rate)
    off = [reached / wanted - 1 if wanted else 0.0 for wanted, reached in zip(found.targets, found.reached)]
    return judged.select("doc_id", "n_tokens", *[F.get("p", F.lit(i)).alias(f"p_{name}") for i, name in enumerate(targets)],
                         found.rate.alias("rate"), copies_by(found.rate, F.col("draw")).alias("copies"),
                         *[F.lit(float(x)).alias(f"off_{name}") for name, x in zip(targets, off)])


def mix_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, sample: int = SAMPLE, most_rate: float = MOST_RATE) -> DataFrame:
    """The rows of docs as often as their copies say, unchanged.

    Posteriors are made twice, for the fit and for the rows, so that no text is shuffled.
    """
    model = fit(docs, labels, len(targets), sample)
    rate = fit_rates(materialize(posteriors(docs, model)), list(targets.values()), most_rate).rate
    sent = docs.sparkSession.sparkContext.broadcast(model)
    wrapped = docs.select(F.struct("*").alias("row"))

    def judge(batches):
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                piece, m = batch.slice(at, BATCH_ROWS), sent.value
                texts = pc.struct_field(piece.column(0), "text").cast(pa.binary()).to_pylist()  # of the row itself: no text travels twice
                scores = np.array([m.prior + m.lift[_buckets(t, hashes)[0]].sum(0) for t in texts]).reshape(-1, len(m.prior))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(list(_softmax(scores)), pa.list_(pa.float64()))], names=["row", "p"])

    out = T.StructType([wrapped.schema["row"], T.StructField("p", T.ArrayType(T.DoubleType()))])
    copies = copies_of(rate, F.col("row.doc_id").cast("long"), F.col("row.text"))
    kept = wrapped.mapInArrow(judge, out).withColumn("copies", copies).filter("copies > 0")
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
