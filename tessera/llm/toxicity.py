r"""Toxic spans by a linear-chain conditional random field.

Labels are given for documents, so the tokens of the training sample are labelled first: in a
document marked toxic, a token is toxic if its word is ``RATIO`` times as frequent in toxic
documents as in others and is in ``LEAST_DOCS`` of them, counting for a word only documents that
bring it in a new context (word before, word after); so copies of one document count once.
The field has two states, features on the word, its beginnings and its neighbours, and weights for
starts and transitions; all are fitted together to the tokens' conditional likelihood. Forward-
backward marginals give each token's probability; their sum, maximum and mean, through a logistic
curve fitted to the document labels, give the document's score, and runs of tokens at 0.5 or
more give the offending offsets. The sample holds as many documents of either label as fit, so the
curve weighs them by the labels' true shares, counted over all rows: 0.5 means the same at every size.

The two-state recursions are 2 x 2 matrix products. A batch of texts is one stream cut into
lanes of ``LANE`` tokens; products run over all lanes at once and a reset matrix starts each
text, so a very long text costs no more a token than short ones. Words are numbered, and
features hashed for all new words of a batch at once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Numbers, slices
from tessera.llm.folds import held_out, learnable, sample

#: Training bounds: documents and bytes a label.
TRAIN_DOCS, TRAIN_BYTES = 1500, 1_500_000
RATIO, LEAST_DOCS = 10.0, 8
LANE = 128
DIMS = 1 << 18
PENALTY = 0.02
#: Characters of the words a worker keeps the weights of; beyond them it starts afresh.
CACHE_CHARS = 1_000_000
#: Tokens scored at once.
BLOCK = 1 << 16
#: Beginnings of a word that are features (bytes), besides the whole of it.
BEGINNINGS = (5, 7, 8)
#: An odd multiplier; any would do.
ROOT = 0x9E3779B97F4A7C15
WORD = re.compile(r"\w+")


def features(words: list[str]) -> np.ndarray:
    """Hashed feature numbers, a row a word: itself, its beginnings, and itself as the word before and after another.

    A polynomial hash over the bytes, so that all beginnings of all words come from one cumulative sum.
    """
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) + np.uint64(1)
    place = np.arange(len(data)) - np.repeat(start, size)
    power = np.cumprod(np.full(int(size.max(initial=0)) + 1, ROOT, np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * power[place], dtype=np.uint64)])
    out = np.empty((len(raw), len(BEGINNINGS) + 3), np.int64)
    for n, most in enumerate((None, *BEGINNINGS, None, None)):
        end = start + (size if most is None else np.minimum(size, most))
        h = (total[end] - total[start] + np.uint64(n + 1)) * np.uint64(ROOT)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(ROOT)
        out[:, n] = (h >> np.uint64(40)).astype(np.int64) % DIMS
    return out


def _scan(m: np.ndarray) -> np.ndarray:
    """Row vectors (2, n), normalised: the products of [1, 1] with m[0], m[0] m[1], ...; m is (2, 2, n)."""
    n = m.shape[2]
    lanes = -(-n // LANE)
    padded = np.empty((2, 2, lanes * LANE))
    padded[:, :, :n] = m
    padded[:, :, n:] = np.eye(2)[:, :, None]
    # a step of a lane is one row, all lanes side by side
    (a, b), (c, d) = [[np.ascontiguousarray(x.reshape(lanes, LANE).T) for x in row] for row in padded]
    prefix = np.empty((LANE, 4, lanes))
    p, q, r, s = a[0], b[0], c[0], d[0]
    for t in range(LANE):
        if t:
            p, q, r, s = p * a[t] + q * c[t], p * b[t] + q * d[t], r * a[t] + s * c[t], r * b[t] + s * d[t]
        scale = 1 / (p + q + r + s)
        prefix[t] = p, q, r, s = p * scale, q * scale, r * scale, s * scale
    starts = np.empty((2, lanes))
    x, y = 1.0, 1.0
    for i, (e, f, g, h) in enumerate(prefix[-1].T.tolist()):
        starts[:, i] = x, y
        x, y = x * e + y * g, x * f + y * h
        x, y = x / (x + y), y / (x + y)
    out = np.empty((2, lanes * LANE))
    for i in (0, 1):
        out[i] = (starts[0] * prefix[:, i] + starts[1] * prefix[:, 2 + i]).T.reshape(-1)
    out = out[:, :n]
    return out / out.sum(0)


def marginals(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """P(toxic) of each token, and, if asked, pair probabilities (2, 2, n) of the one before and it (0 at a start).

    ``emit`` is the log-odds of the toxic state, ``first`` marks the first token of a text. The weights
    ``trans`` (from, to) and ``start`` are positive and need not sum to one.
    """
    e = np.stack([np.ones_like(emit), np.exp(np.clip(emit, -40, 40))])
    m = np.where(first, start[None, :, None], trans[:, :, None]) * e
    alpha = _scan(m)
    beta = np.full((2, len(emit)), 0.5)
    beta[:, :-1] = _scan(m[:, :, :0:-1].transpose(1, 0, 2))[:, ::-1] if len(emit) > 1 else 0
    joint = alpha * beta
    p = joint[1] / joint.sum(0)
    if not pairs:
        return p, None
    pair = np.zeros((2, 2, len(emit)))
    pair[:, :, 1:] = alpha[:, None, :-1] * m[:, :, 1:] * beta[None, :, 1:]
    pair[:, :, 1:] /= pair[:, :, 1:].sum((0, 1))
    pair[:, :, first] = 0
    return p, pair


@dataclass
class Model:
    """Feature weights, the chain's weights, and the curve from marginals to a document's score."""

    theta: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def __post_init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.number, self.weights, self.chars = Numbers(), np.empty((0, 3)), 0

    def __getstate__(self) -> dict:
        used = np.flatnonzero(self.theta)
        return {"used": used, "values": self.theta[used], "trans": self.trans, "start": self.start, "curve": self.curve}

    def __setstate__(self, s: dict) -> None:
        self.theta = np.zeros(DIMS)
        self.theta[s["used"]] = s["values"]
        self.trans, self.start, self.curve = s["trans"], s["start"], s["curve"]
        self.forget()

    def weighed(self, words: list[str]) -> np.ndarray:
        """A row a word, whatever its case: its own weight, and what it gives the word after and the word before."""
        if self.chars > CACHE_CHARS:
            self.forget()
        met = len(self.number)
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if len(self.number) > met:
            new = list(islice(self.number, met, None))
            t = self.theta[features([w.lower() for w in new])]
            self.weights = np.concatenate([self.weights, np.stack([t[:, :-2].sum(1), t[:, -2], t[:, -1]], 1)])
            self.chars += sum(map(len, new))
        return self.weights[at]

    def tokens(self, texts: list[list[str]]) -> np.ndarray:
        """P(toxic) of each token of all texts, end to end."""
        if not any(texts):
            return np.empty(0)
        w = self.weighed(list(chain.from_iterable(texts)))
        first = np.zeros(len(w), bool)
        ends = np.cumsum([len(t) for t in texts])
        first[[e - len(t) for e, t in zip(ends, texts, strict=True) if t]] = True
        return marginals(emissions(w[:, 0], w[:, 1], w[:, 2], first), first, self.trans, self.start)[0]

    def scores(self, p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The scores of texts of ``sizes`` tokens with marginals ``p``."""
        return 1 / (1 + np.exp(-np.clip(summaries(p, sizes) @ np.array(self.curve), -700, 700)))


def emissions(own: np.ndarray, after: np.ndarray, before: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each token's log-odds: its own weight and what its neighbours in the text give it."""
    emit = own.copy()
    emit[1:] += np.where(first[1:], 0, after[:-1])
    emit[:-1] += np.where(first[1:], 0, before[1:])
    return emit


def summaries(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What the document curve sees of the marginals, a row a text: 1, their sum, maximum and mean on bounded scales."""
    out = np.zeros((len(sizes), 4))
    out[:, 0] = 1
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        total = np.add.reduceat(p, starts)
        out[full, 1], out[full, 2], out[full, 3] = np.log1p(total), np.maximum.reduceat(p, starts), np.log1p(1000 * total / sizes[full])
    return out


def split(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def token_labels(docs: list[tuple[int, list[str]]]) -> set[str]:
    """The words taken as toxic: those that bring new contexts in many toxic and few other documents."""
    seen: set[tuple[str, str, str]] = set()
    per = (Counter(), Counter())
    for toxic, w in docs:
        new = set(zip(["", *w[:-1]], w, [*w[1:], ""], strict=True)) - seen
        seen |= new
        per[toxic].update({x for _, x, _ in new})
    n = [sum(y == side for y, _ in docs) + 1 for side in (0, 1)]
    return {w for w, c in per[1].items() if c >= LEAST_DOCS and c / n[1] > RATIO * (per[0][w] + 0.5) / n[0]}


def fit(pairs: list[tuple[int, str]], steps: int = 45, shares: dict[int, float] | None = None) -> Model:
    """The model of (label, text) pairs: penalised conditional likelihood by Adam, then the document curve.

    ``shares`` are the labels' true numbers; without them those of the pairs are taken.
    """
    docs = [(int(y), split((t or "").lower())) for y, t in pairs]
    lexicon = token_labels(docs)
    stream = [w for _, d in docs for w in d]
    numbers = Numbers()
    ids = np.fromiter(map(numbers.__getitem__, stream), np.int64, len(stream))
    vocabulary = list(numbers)
    found = features(vocabulary)
    own, after, before = found[:, :-2], found[:, -2], found[:, -1]
    toxic = np.repeat([y for y, _ in docs], [len(d) for _, d in docs]).astype(bool) if docs else np.empty(0, bool)
    y = (toxic & np.array([w in lexicon for w in vocabulary], bool)[ids]).astype(float)
    first = np.zeros(len(ids), bool)
    ends = np.cumsum([len(d) for _, d in docs])
    first[[e - len(d) for e, (_, d) in zip(ends, docs, strict=True) if d]] = True
    inner, now = ~first[1:], y.astype(int)
    seen = np.bincount((2 * now[:-1] + now[1:])[inner], minlength=4).reshape(2, 2).astype(float)
    begun = np.bincount(now[first], minlength=2).astype(float)
    # the last six weights are the chain's: start, then transitions
    w = np.zeros(DIMS + 6)
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, steps + 1 if len(ids) else 1):
        t, chain_ = w[:DIMS], np.exp(w[DIMS:])
        p, pair = marginals(emissions(t[own].sum(1)[ids], t[after][ids], t[before][ids], first), first, chain_[2:].reshape(2, 2), chain_[:2], pairs=True)
        error = y - p
        g = -PENALTY * w
        word = np.bincount(ids, error, len(vocabulary))
        np.add.at(g, own, np.repeat(word[:, None], own.shape[1], 1))
        np.add.at(g, after, np.bincount(ids[:-1], np.where(first[1:], 0, error[1:]), len(vocabulary)))
        np.add.at(g, before, np.bincount(ids[1:], np.where(first[1:], 0, error[:-1]), len(vocabulary)))
        g[DIMS : DIMS + 2] += begun - [(1 - p[first]).sum(), p[first].sum()]
        g[DIMS + 2 :] += (seen - pair.sum(2)).reshape(-1)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-3)
    chain_ = np.exp(w[DIMS:])
    model = Model(w[:DIMS].copy(), chain_[2:].reshape(2, 2), chain_[:2])
    model.curve = _curve(model, docs, shares)
    return model


def _curve(model: Model, docs: list[tuple[int, list[str]]], shares: dict[int, float] | None) -> tuple[float, ...]:
    """Logistic regression of the labels on the summaries of the marginals, each label with its true share."""
    if not docs:
        return model.curve
    texts = [d for _, d in docs]
    sizes = np.array([len(d) for d in texts])
    x = summaries(model.tokens(texts), sizes)
    y = np.array([t for t, _ in docs], float)
    had = Counter(t for t, _ in docs)
    shares = shares or had
    total = sum(shares.get(t, 0) for t in had)
    weight = np.array([shares.get(t, 0) / total / had[t] * len(docs) for t, _ in docs])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -700, 700)))
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (weight * (y - q)) - 0.1 * w)
    return tuple(w.tolist())


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", docs_per_label: int = TRAIN_DOCS, bytes_per_label: int = TRAIN_BYTES) -> Model:
    """A model from a bounded sample of labelled rows outside the held-out fold; without any it scores 0.5.

    Labels other than 0 and 1 take no part.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("toxic")).where("toxic in (0, 1)")
    shares = {r[0]: r[1] for r in learnable(rows, "toxic").groupBy("toxic").count().collect()}
    return fit(sample(rows, docs, "toxic", docs_per_label, bytes_per_label), shares=shares)


def tag(texts: list[str | None], model: Model) -> list[tuple[float, list[dict]]]:
    """(score, spans) of each text; a span has start, end (code points) and prob, its largest marginal."""
    out: list[tuple[float, list[dict]]] = []
    at = 0
    while at < len(texts):
        group, n = [], 0
        while at + len(group) < len(texts) and (not group or n < BLOCK):
            group.append(split(texts[at + len(group)]))
            n += len(group[-1])
        p = model.tokens(group)
        sizes = np.array([len(g) for g in group])
        ends = np.cumsum(sizes).tolist()
        scores = model.scores(p, sizes).tolist()
        found: dict[int, list[int]] = {}
        text_of = np.repeat(np.arange(len(group)), sizes)
        for i in np.flatnonzero(p >= 0.5).tolist():
            found.setdefault(int(text_of[i]), []).append(i)
        for k, value in enumerate(scores):
            begin = ends[k] - len(group[k])
            out.append((value, spans(texts[at + k], {i - begin: float(p[i]) for i in found[k]}) if k in found else []))
        at += len(group)
    return out


def spans(text: str, toxic: dict[int, float]) -> list[dict]:
    """Runs of toxic tokens (number to marginal) of a text by their offsets."""
    runs: list[dict] = []
    last, end = -2, max(toxic)
    for i, found in enumerate(WORD.finditer(text)):
        if i in toxic:
            if last == i - 1:
                runs[-1] |= {"end": found.end(), "prob": max(runs[-1]["prob"], toxic[i])}
            else:
                runs.append({"start": found.start(), "end": found.end(), "prob": toxic[i]})
            last = i
        if i == end:
            break
    return runs


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of each row of ``docs``.

    The whole text alone decides; null and empty texts score as texts without a toxic token. A null
    id is not held out. Repeated rows come as often as they are; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), F.col(text).alias("text"))
    kind = dict(slim.dtypes)["doc_id"]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("prob", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            found = tag(b.column(2).to_pylist(), shared.value)
            cols = [pa.array([x[0] for x in found], pa.float64()), pa.array([int(x[0] >= 0.5) for x in found], pa.int32()), pa.array([x[1] for x in found], span)]
            yield pa.record_batch([b.column(0), b.column(1), *cols], names=["doc_id", "held_out", "score", "predicted", "spans"])

    return slim.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int,prob:double>>")
