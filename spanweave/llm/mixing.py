"""Mixing to target weights with soft memberships.

A document's tokens are those that packing makes of it: its ids by the tokenizer, and one that ends it.

A classifier learned from a labelled table gives each document a posterior over domains. With t_i tokens and posterior
p_i, rates r_i give domain k the expected tokens T_k = sum_i r_i t_i p_ik. Rates are fitted by projected gradient descent
on the weighted squares of T - T*, the targets: each step is r <- clip(r - p . d) with d = G^-1 (T - T*), where
G = sum t p p' over the rates that can still move. T and G are sums over partitions, and a rate follows from p and the
few vectors d so far, so nothing of the corpus's size is kept, shuffled or sent to the driver.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm import _support as S

#: Labelled documents a fit reads at most; rounds of descent at most; the residual, as a share of the target, to stop at.
MAX_LABELLED, MAX_ROUNDS, TOLERANCE = 8_000, 60, 1e-7
BINS, STEPS, RIDGE = 512, 150, 1e-3
#: Copies of a document at most, unless told. A target that this keeps from being met is reported.
MAX_COPIES = 16.0
#: Rates of the domains the production mix asks for.
TARGETS = {"en": 0.55, "de": 0.16, "fr": 0.16, "es": 0.13}


def bigrams(text: bytes) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < 2:
        return np.zeros(BINS, np.float32)
    counts = np.bincount((((b[:-1] << 8 | b[1:]) * np.uint32(2654435761)) >> np.uint32(23)).astype(np.int64), minlength=BINS)
    return np.sqrt(counts / (len(b) - 1)).astype(np.float32)


@dataclass(frozen=True)
class DomainModel:
    domains: tuple[str, ...]
    weights: np.ndarray  # BINS + 1 x domains

    def posterior(self, texts: list[bytes]) -> np.ndarray:
        x = np.stack([bigrams(t) for t in texts]) if texts else np.zeros((0, BINS))
        return _softmax(x @ self.weights[:-1] + self.weights[-1])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
    return e / e.sum(1, keepdims=True) if len(z) else z


def fit_domains(labelled: DataFrame, *, text: str = "text", domain: str = "lang", most: int = MAX_LABELLED) -> DomainModel:
    """Multinomial logistic regression on at most `most` labelled rows, the first by hash of their text.

    Rows without a domain are left out. No labelled rows give one domain "" of posterior 1.
    """
    rows = labelled.where(F.col(domain).isNotNull()).select(S.text_bytes(text).alias("b"), F.col(domain).cast("string").alias("d"))
    rows = rows.withColumn("o", F.xxhash64("b"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in S.slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([bigrams(b).tobytes() for b in S.byte_values(batch.column(0))], pa.binary()), batch.column(1), batch.column(2)], ["x", "d", "o"])

    got = rows.mapInArrow(look, "x binary, d string, o long").orderBy("o", "d").limit(most).collect()
    if not got:
        return DomainModel(("",), np.zeros((BINS + 1, 1)))
    domains = tuple(sorted({g.d for g in got}))
    x = np.stack([np.frombuffer(g.x, np.float32) for g in got])
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = np.eye(len(domains))[[domains.index(g.d) for g in got]]
    w, speed, square = np.zeros((BINS + 1, len(domains))), 0.5, np.full((BINS + 1, len(domains)), 1e-8)
    for _ in range(STEPS):
        grad = x.T @ (_softmax(x @ w) - y) / len(x) + RIDGE / len(x) * w
        square += grad * grad
        w -= speed * grad / np.sqrt(square)
    return DomainModel(domains, w)


@dataclass(frozen=True)
class Mix:
    """How a document's posterior gives its rate."""

    model: DomainModel
    start: float
    steps: tuple[tuple[float, ...], ...]
    low: float
    high: float
    #: The tokens of each domain: expected with these rates, and asked for.
    expected: tuple[float, ...] = ()
    goal: tuple[float, ...] = ()

    @property
    def missed(self) -> float:
        """The sum of the domains' differences, as a share of the tokens asked for."""
        return sum(abs(a - b) for a, b in zip(self.expected, self.goal)) / max(sum(self.goal), 1e-12)

    def rates(self, p: np.ndarray) -> np.ndarray:
        r = np.full(len(p), self.start)
        for d in self.steps:
            r = np.clip(r - p @ np.array(d), self.low, self.high)
        return r


def token_counts(texts: list[bytes], tokenizer: str) -> np.ndarray:
    """Tokens of each text as packing counts them, the end's included."""
    from spanweave.llm.packing import CHUNK, encoder
    from spanweave.llm.words import chunks

    counts = [encoder(tokenizer).encode(texts[a:b])[1] for a, b in chunks(texts, CHUNK)]
    return (np.concatenate(counts) if counts else np.zeros(0, np.int64)) + 1


def memberships(docs: DataFrame, model: DomainModel, *, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """_key, t, p of each row: its key, its tokens and its posterior. A null text is empty: one token."""
    from spanweave.llm.packing import default_tokenizer

    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(key).alias("_key"), S.text_bytes(text).alias("_b"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in S.slices(batches, 512):
            texts = S.byte_values(batch.column(1))
            p = pa.array(model.posterior(texts).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(token_counts(texts, path)), p], ["_key", "t", "p"])

    return rows.mapInArrow(look, f"_key {rows.schema['_key'].dataType.simpleString()}, t long, p array<double>")


def _sums(members: DataFrame, mix: Mix) -> tuple[np.ndarray, np.ndarray]:
    """T and G: each partition adds up its own, then Spark adds those K + K^2 numbers."""
    k = len(mix.model.domains)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gram = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            t = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            p = np.array(batch.column(1).to_pylist(), float).reshape(-1, k)
            r = mix.rates(p)
            free = (r > mix.low) & (r < mix.high)
            total += (r * t) @ p
            gram += (p * (t * free)[:, None]).T @ p
        yield pa.RecordBatch.from_arrays([pa.array(range(k + k * k), pa.int32()), pa.array(np.concatenate([total, gram.ravel()]))], ["i", "v"])

    found = {x.i: x.v for x in members.select("t", "p").mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    flat = np.array([found.get(i, 0.0) for i in range(k + k * k)])
    return flat[:k], flat[k:].reshape(k, k)


def fit(members: DataFrame, model: DomainModel, targets: dict[str, float], *, keep_all: bool = False, low: float = 0.0, high: float = MAX_COPIES) -> Mix:
    """The mix whose expected domain tokens are as the targets' weights, as near as rates from low to high can come.

    The sum is the corpus's tokens or, with keep_all, so large that the most over-represented domain keeps rate 1.
    Domains without a target get weight 0; targets of domains without any tokens are left out. members is read once a
    round. mix.missed tells what was not met; more than one in a hundred is warned of.
    """
    first = Mix(model, 1.0, (), -np.inf, np.inf)
    total, _ = _sums(members, first)
    w = np.array([max(targets.get(d, 0.0), 0.0) if t > 0 else 0.0 for d, t in zip(model.domains, total)])
    if not w.sum():
        return Mix(model, 1.0, (), low, high)
    w = w / w.sum()
    goal = w * (np.max(np.where(w > 0, total / np.maximum(w, 1e-12), 0.0)) if keep_all else total.sum())
    start = float(np.clip(goal.sum() / total.sum(), max(low, 1e-6), high))
    steps: tuple[tuple[float, ...], ...] = ()
    best, damp = None, 1.0
    for _ in range(MAX_ROUNDS):
        now, gram = _sums(members, Mix(model, start, steps, low, high))
        miss = now - goal
        size = float((miss**2).sum())
        if best is not None and size > best[0] * (1 - 1e-9):
            damp /= 2
            if damp < 1 / 64:
                break
        else:
            damp = 1.0 if best is None or size < 0.25 * best[0] else damp
            if not gram.any():
                gram = np.diag(np.maximum(now, 1.0))
            ridge = 1e-9 * max(np.trace(gram), 1.0) * np.eye(len(gram))
            best = (size, steps, np.linalg.solve(gram + ridge, miss), now)
            if np.abs(miss).sum() < TOLERANCE * goal.sum():
                break
        steps = (*best[1], tuple(damp * best[2]))
    mix = Mix(model, start, best[1], low, high, tuple(best[3].tolist()), tuple(goal.tolist()))
    if mix.missed > 0.01:
        warnings.warn(f"rates from {low} to {high} miss the target by {mix.missed:.1%} of its tokens", UserWarning, stacklevel=2)
    return mix


def _copies(rate: Column, key: Column) -> Column:
    """The rate rounded up or down so that its mean over keys is the rate; equal keys are rounded alike."""
    chance = F.shiftrightunsigned(F.xxhash64(key, F.lit(17)), 11) * F.lit(2.0**-53)
    return F.floor(rate + chance).cast("long")


def planned(members: DataFrame, mix: Mix, *, key: str = "doc_id") -> DataFrame:
    """key, domain (the likeliest), n_tokens, rate and n_copies for each row of memberships(); no text is read."""
    names = np.array(mix.model.domains, object)
    k = len(names)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.array(batch.column(2).to_pylist(), float).reshape(-1, k)
            top = names[p.argmax(1)].tolist() if len(p) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(top, pa.string()), batch.column(1), pa.array(mix.rates(p), pa.float64())], ["_key", "domain", "n_tokens", "rate"])

    rated = members.mapInArrow(look, f"_key {members.schema['_key'].dataType.simpleString()}, domain string, n_tokens long, rate double")
    return rated.select(F.col("_key").alias(key), "domain", "n_tokens", "rate", _copies(F.col("rate"), F.col("_key")).alias("n_copies"))


def labelled_documents(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", domain: str = "lang", most: int = MAX_LABELLED) -> DataFrame:
    """Text and domain of at most `most` documents of the labelled table, which bounds the broadcast; an id that repeats
    counts once."""
    sample = S.label_sample(labels, key, most, key).select(key)
    found = docs.select(key, text, domain).join(F.broadcast(sample), key)
    return found.groupBy(key).agg(F.min(F.struct(text, domain)).alias("_one")).select("_one.*")


def mix_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, *, key: str = "doc_id", text: str = "text", domain: str = "lang", **limits) -> DataFrame:
    """key, domain, n_tokens, rate, n_copies for every row of docs: the sampling plan of one mixed corpus.

    A null or empty text has one token and the posterior of an empty one. Rows that repeat a key each get their rate and
    are rounded alike; rows with a null key are, too. Equal texts get equal rates. Without labelled rows there is one
    domain "" and each rate is 1; an empty table gives no rows. Texts are read once, apart from the labelled sample.
    """
    model = fit_domains(labelled_documents(docs, labels, key=key, text=text, domain=domain), text=text, domain=domain)
    members = S.written(memberships(docs, model, key=key, text=text))
    return planned(members, fit(members, model, targets or TARGETS, **limits), key=key)


def resample(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, *, key: str = "doc_id", text: str = "text", domain: str = "lang", keep_all: bool = True, low: float = 1.0,
    high: float = MAX_COPIES,
) -> DataFrame:
    """docs with each row as often as its n_copies tells, all columns kept, whatever their names.

    By default no row is dropped (rates from 1) and none is there more than `high` times, even if the target is missed
    then; a warning tells. Nulls, repeats and empty tables are as in mix_rates(). Rows are repeated where they are read:
    nothing is shuffled.
    """
    model = fit_domains(labelled_documents(docs, labels, key=key, text=text, domain=domain), text=text, domain=domain)
    with S.scratch(docs.sparkSession):
        mix = fit(S.written(memberships(docs, model, key=key, text=text)), model, targets or TARGETS, keep_all=keep_all, low=low, high=high)
    rows = docs.select(S.text_bytes(text).alias("_b"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[1:])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in S.slices(batches):
            rates = pa.array(mix.rates(mix.model.posterior(S.byte_values(batch.column(0)))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], rates], [*batch.schema.names[1:], "_rate"])

    often = rows.mapInArrow(look, f"{schema}, _rate double").withColumn("_n", _copies(F.col("_rate"), F.col(f"_c{docs.columns.index(key)}"))).where("_n > 0")
    return often.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).drop("_rate", "_n", "_i").toDF(*docs.columns)
