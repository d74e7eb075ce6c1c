"""Mixing documents to target weights by soft domain membership.

Domains are the combinations of label columns in the labelled table. A multinomial classifier over hashed words and word pairs, fitted on at
most ``sample`` labelled rows of each domain, gives every document a posterior over the domains (its evidence counts as that of at most
``evidence`` features, so long texts keep soft posteriors). Nonnegative rates r, one per document, then minimise

    1/2 * sum_k (sum_d r_d n_d p_dk - T_k)^2 / (N S_k),

n_d: tokens of the document, p_dk: posteriors, T_k: target tokens of a domain, S_k: its expected tokens now, N = sum_k S_k. Projected
gradient steps (in the metric of the documents' tokens) start at r = 1. A step moves each rate along its own posteriors by K numbers, the weighted
residuals, so a rate is a function of the document and the short list of residuals so far: an iteration is one pass over the compact table
of posteriors that returns K sums, and no state per document is kept on the driver or rewritten.

Defined results: null and empty texts have no tokens and the prior as posteriors; a domain without expected tokens is left out of the fit; an
empty table gives no rows; without labelled rows there is one domain ``all``; repeated rows share their rate; other columns pass through
``mix_documents`` and are ignored elsewhere.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyops.llm.common import slices, small_batches, stage, texts, unused
from skyops.llm.features import class_counts, document_sums, hashed_features, sample_ids
from skyops.llm.words import mix


@dataclass
class DomainModel:
    """log probabilities of the feature buckets by domain, log priors, and the evidence bound."""

    names: list[str]
    log_p: np.ndarray
    log_prior: np.ndarray
    evidence: float
    bits: int

    def posteriors(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each document, and its posteriors (documents x domains)."""
        parts = hashed_features(data, off, self.bits)
        n = sum(np.diff(at) for _, at in parts)
        scale = np.minimum(1.0, self.evidence / np.maximum(n, 1))
        logit = self.log_prior + np.stack([document_sums(parts, row) for row in self.log_p], 1) * scale[:, None]
        p = np.exp(logit - logit.max(1, keepdims=True))
        return np.diff(parts[0][1]), p / p.sum(1, keepdims=True)


def fit_domains(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...] = ("quality", "toxic"), sample: int = 5_000,
                evidence: float = 64.0, bits: int = 13, smooth: float = 0.5) -> DomainModel:
    """Fit the classifier on the labelled rows of ``docs``; the priors are the domains' shares of these. At most 64 domains."""
    labels = labels.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    found = labels.dropna(subset=["doc_id", *columns]).groupBy(*columns).agg(F.count("*").alias("n")).orderBy(*columns).limit(65).collect()
    if len(found) > 64:
        raise ValueError("the label columns have more than 64 combinations")
    if not found:
        return DomainModel(["all"], np.zeros((1, 1 << bits)), np.zeros(1), evidence, bits)
    names = ["_".join(f"{c}{r[c]}" for c in columns) for r in found]
    samples = []
    for r in found:
        where = F.lit(True)
        for c in columns:
            where = where & (F.col(c) == F.lit(r[c]))
        samples.append(sample_ids(labels, where, sample))
    counts = class_counts(docs, samples, bits)
    # buckets are smoothed towards the shares of all texts, so what no domain has seen tells nothing
    base = (counts[0] + smooth) / (counts[0].sum() + smooth * counts.shape[1])
    strength = smooth * counts.shape[1]
    log_p = np.log((counts[1:] + strength * base) / (counts[1:].sum(1, keepdims=True) + strength))
    total = np.array([r.n for r in found], float)
    return DomainModel(names, log_p, np.log(total / total.sum()), evidence, bits)


def membership(docs: DataFrame, model: DomainModel) -> DataFrame:
    """Rows: doc_id, n_tokens, p_<domain> for each domain."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [f"p_{n}" for n in model.names]

    def run(batches):
        for batch in batches:
            for i, j, data, off in slices(batch.column("text")):
                n, p = shared.value.posteriors(data, off)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(n, pa.int64()), *(pa.array(c) for c in p.T.copy())],
                                                 names=["doc_id", "n_tokens", *columns])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, " + ", ".join(f"`{c}` double" for c in columns))


@dataclass
class Rates:
    """A fitted rate function: rates are replayed from the residuals of the steps."""

    names: list[str]
    now: np.ndarray
    target: np.ndarray
    size: float
    steps: list[np.ndarray] = field(default_factory=list)
    #: steps that start without momentum, because the one before went too far
    restarts: set[int] = field(default_factory=set)
    got: np.ndarray | None = None
    top: float = np.inf
    #: the largest distance of a domain from its target, in shares of all target tokens
    gap: float = 0.0

    def of(self, p: np.ndarray, ahead: bool = False) -> np.ndarray:
        """Rates of documents with posteriors ``p``; ``ahead``: the point of the next gradient instead."""
        rate = point = np.ones(len(p))
        t = 1.0
        for k, step in enumerate(self.steps):
            if k in self.restarts:
                point, t = rate, 1.0
            new, grown = np.clip(point - self.size * (p @ step), 0.0, self.top), (1 + np.sqrt(1 + 4 * t * t)) / 2
            point, rate, t = new + (t - 1) / grown * (new - rate), new, grown
        return point if ahead else rate


def fit_rates(members: DataFrame, names: list[str], targets: dict[str, float], tolerance: float = 1e-4, max_steps: int = 60, top: float = np.inf) -> Rates:
    """Rates from 0 to ``top`` whose expected domain tokens come to ``targets`` (domain -> tokens; others keep what they have). Ends when every domain is
    within ``tolerance`` of its target (in shares of all target tokens), or when no domain moves any more, by a twentieth of that in five steps
    running: then no rates come nearer. After ``max_steps`` it warns that they have not settled. ``gap`` says how far from the targets they are."""
    columns = [f"p_{n}" for n in names]
    k = len(names)

    def sums(rates: Rates | None):
        """Expected tokens by domain (at the rates, at the next gradient's point), or with ``None`` those at rate 1 and the Gram matrix."""
        def run(batches):
            total = np.zeros((k, k + 1))
            for batch in batches:
                n = np.asarray(batch.column("n_tokens")).astype(float)
                p = np.stack([np.asarray(batch.column(c)) for c in columns], 1)
                if rates is None:
                    total[:, 0] += n @ p
                    total[:, 1:] += (p * n[:, None]).T @ p
                else:
                    total[:, 0] += (n * rates.of(p)) @ p
                    total[:, 1] += (n * rates.of(p, True)) @ p
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(list(total))], names=["k", "v"])

        rows = members.select("n_tokens", *columns).mapInArrow(run, "k bigint, v array<double>")
        rows = rows.groupBy("k").agg(*(F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(k + 1))).collect()
        out = np.zeros((k, k + 1))
        for r in rows:
            out[r.k] = r[1:]
        return out

    first = sums(None)
    now, gram = first[:, 0], first[:, 1:]
    target = np.array([float(targets.get(n, now[i])) for i, n in enumerate(names)])
    held = now > 0
    weight = np.where(held, 1.0 / np.where(held, now, 1.0), 0.0)
    curve = np.linalg.eigvalsh(np.sqrt(weight)[:, None] * gram * np.sqrt(weight))[-1] if held.any() else 1.0
    rates = Rates(names, now, target, 1.0 / max(curve, 1e-12), got=now, top=top)
    point, still, whole, least = now, 0, max(target.sum(), 1e-12), np.inf
    while True:
        rates.gap = float(np.abs(rates.got - target)[held].max(initial=0.0) / whole)
        if rates.gap <= tolerance or still == 5:
            return rates
        if len(rates.steps) == max_steps:
            warnings.warn(f"the rates have not settled after {max_steps} steps; the targets are missed by {rates.gap:.2g} of all tokens", stacklevel=2)
            return rates
        loss = ((rates.got - target) ** 2 * weight).sum()
        if loss > least:
            rates.restarts.add(len(rates.steps))
            point = rates.got
        least = loss
        rates.steps.append((point - target) * weight)
        before = rates.got
        rates.got, point = sums(rates)[:, :2].T
        still = still + 1 if np.abs(rates.got - before).max() <= tolerance / 20 * whole else 0


def share_targets(members: DataFrame, names: list[str], shares: dict[str, float], total: float | None = None) -> dict[str, float]:
    """Token targets for weights of the domains; ``total``: tokens of the mixture (default: all tokens there are)."""
    total = float(members.agg(F.sum("n_tokens")).first()[0] or 0) if total is None else total
    weight = sum(shares.values())
    return {n: total * shares.get(n, 0.0) / weight for n in names}


def fit_mixture(docs: DataFrame, labels: DataFrame, shares: dict[str, float] | None = None, factors: dict[str, float] | None = None,
                top: float = np.inf, tolerance: float = 1e-4, **options) -> tuple[DataFrame, DomainModel, Rates]:
    """Classifier, posteriors (a written table) and rates. ``shares``: target weights of the domains; or ``factors``: what to multiply
    the expected tokens of some domains by. ``top``: the largest rate, 1 where documents are drawn at most once."""
    model = fit_domains(docs, labels, **options)
    members = stage(membership(docs, model), "membership")
    if shares is not None:
        targets = share_targets(members, model.names, shares)
    else:
        now = members.agg(*(F.sum(F.col("n_tokens") * F.col(f"p_{n}")).alias(n) for n in model.names)).first()
        targets = {n: (now[n] or 0.0) * (factors or {}).get(n, 1.0) for n in model.names}
    return members, model, fit_rates(members, model.names, targets, tolerance, top=top)


def with_rates(members: DataFrame, rates: Rates) -> DataFrame:
    """The posteriors with each document's ``rate``."""
    columns = [f"p_{n}" for n in rates.names]

    def run(batches):
        for batch in batches:
            p = np.stack([np.asarray(batch.column(c)) for c in columns], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates.of(p))], names=[*batch.schema.names, "rate"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in members.schema)
    return members.mapInArrow(run, schema + ", rate double")


def mix_documents(docs: DataFrame, model: DomainModel, rates: Rates, seed: int = 0, at_most_once: bool = False) -> DataFrame:
    """``docs`` drawn by their rates: floor(rate + u) copies, u from a hash of doc_id and seed; ``at_most_once`` caps that at one. The rates are
    replayed in place, so no text is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast((model, rates))
    schema, n, at = docs.schema, len(docs.columns), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            noise = np.asarray(batch.column(n)).view(np.uint64)
            u = (mix(noise + np.uint64(seed + 1)) >> np.uint64(11)).astype(float) / 2**53
            parts = [shared.value[1].of(shared.value[0].posteriors(data, off)[1]) for _, _, data, off in slices(batch.column(at).fill_null(""))]
            copies = np.floor(np.concatenate(parts) + u).astype(np.int64) if parts else np.zeros(0, np.int64)
            if at_most_once:
                copies = np.minimum(copies, 1)
            yield pa.RecordBatch.from_arrays(batch.columns[:n], names=schema.names).take(pa.array(np.repeat(np.arange(len(copies)), copies)))

    small_batches(docs.sparkSession)
    return docs.select("*", F.xxhash64("doc_id").alias(unused(docs, "_noise")[0])).mapInArrow(run, schema)
