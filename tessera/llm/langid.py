"""Language identification by prediction by partial matching over the bytes of lower-cased texts.

For each language the statistics of a byte context tree of depth ``ORDER`` are frozen after
training: a context's counts of next bytes, with escape probabilities by method C. The
code length of a byte is that of its longest context known to the language, plus an escape
for every longer one. The language that codes a text in the fewest bits wins.

With frozen statistics a byte's code length depends on its n-gram alone, so the trees are
laid out as one hash table an order: n-gram to code lengths in all languages, and context
to escape lengths. A text is scored by array look-ups over its bytes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices
from tessera.llm.folds import held_out, sample

ORDER = 3
#: Training bounds: documents and bytes a language.
TRAIN_DOCS, TRAIN_BYTES = 400, 2_000_000
#: Bytes scored at once.
BLOCK = 1 << 18
UNKNOWN = "und"
#: Training texts of a language that tell what bits a byte its texts need.
SPREAD_DOCS = 100
#: A text of ``JUDGED_BYTES`` or more that needs ``EXCESS`` times the bits a byte of this quantile of its language's texts is not in it.
QUANTILE, EXCESS, JUDGED_BYTES = 0.95, 1.5, 100
_LETTER = re.compile(r"[^\W\d_]")
_PAD = b"\n" * ORDER


@dataclass(frozen=True)
class Table:
    """Open-addressing table of uint64 keys (plus one; 0 is empty) to row numbers."""

    slots: np.ndarray
    rows: np.ndarray
    probes: int

    @staticmethod
    def of(keys: np.ndarray) -> Table:
        size = 1 << max(4, int(len(keys) * 4).bit_length())
        slots, rows = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        left, probe = np.arange(len(keys)), 0
        while len(left):
            at = _slot(keys[left], probe, size)
            free = slots[at] == 0
            first = np.zeros(len(left), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            slots[at[put]], rows[at[put]] = keys[left[put]] + np.uint64(1), left[put]
            left, probe = left[~put], probe + 1
        return Table(slots, rows, probe)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers; -1 where absent."""
        out = np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        for probe in range(self.probes):
            at = _slot(keys[left], probe, len(self.slots))
            held = self.slots[at]
            hit = held == keys[left] + np.uint64(1)
            out[left[hit]] = self.rows[at[hit]]
            left = left[~hit & (held != 0)]
            if not len(left):
                break
        return out


def _slot(keys: np.ndarray, probe: int, size: int) -> np.ndarray:
    mixed = keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - (size.bit_length() - 1))
    return ((mixed + np.uint64(probe)) & np.uint64(size - 1)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """``grams[k]``/``costs[k]``: n-grams of k + 1 bytes; ``contexts[k]``/``escapes[k]``: contexts of k bytes. Bits."""

    languages: list[str]
    grams: list[Table]
    costs: list[np.ndarray]
    contexts: list[Table]
    escapes: list[np.ndarray]
    limits: tuple[float, ...] = ()

    def bits(self, data: np.ndarray) -> np.ndarray:
        """Code lengths (bytes x languages) of the bytes after the first ``ORDER``, which are context."""
        n = len(data) - ORDER
        wide = data.astype(np.uint64)
        out = np.zeros((n, len(self.languages)), np.float32)
        left = np.arange(n)
        for k in range(ORDER, -1, -1):
            gram = np.zeros(len(left), np.uint64)
            for j in range(k, -1, -1):
                gram = gram << np.uint64(8) | wide[left + ORDER - j]
            row = self.grams[k].find(gram)
            hit = row >= 0
            out[left[hit]] += self.costs[k][row[hit]]
            left, gram = left[~hit], gram[~hit]
            if not len(left):
                return out
            row = self.contexts[k].find(gram >> np.uint64(8))
            known = row >= 0
            out[left[known]] += self.escapes[k][row[known]]
        out[left] += 8.0
        return out

    def totals(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths (texts x languages)."""
        out = np.zeros((len(texts), len(self.languages)))
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK):
                size += len(texts[end])
                end += 1
            if end == at + 1:  # a long text goes in pieces, each with its own context before it
                data = np.frombuffer(_PAD + texts[at], np.uint8)
                for i in range(0, len(data) - ORDER, BLOCK):
                    out[at] += self.bits(data[i : i + BLOCK + ORDER]).sum(0, dtype=np.float64)
            else:
                data = np.frombuffer(_PAD + b"".join(t + _PAD for t in texts[at:end]), np.uint8)
                stops = np.cumsum([len(t) + ORDER for t in texts[at:end]])
                sums = np.cumsum(self.bits(data), 0, dtype=np.float64)
                sums = np.concatenate([np.zeros((1, sums.shape[1])), sums])
                starts = np.concatenate([[0], stops[:-1]])
                out[at:end] = sums[stops - ORDER] - sums[starts]
            at = end
        return out


def fit(pairs: list[tuple[str, str]]) -> Model:
    """The model of (language, text) pairs."""
    languages = sorted({lang for lang, _ in pairs})
    count = len(languages)
    grams, costs, contexts, escapes = [], [], [], []
    streams = [np.frombuffer(_PAD + b"".join(t.lower().encode("utf-8", "surrogatepass") + _PAD for l_, t in pairs if l_ == lang), np.uint8).astype(np.uint64) for lang in languages]
    lower = None
    for k in range(ORDER + 1):
        own = []
        for s in streams:
            gram = np.zeros(len(s) - k, np.uint64)
            for j in range(k + 1):
                gram = gram << np.uint64(8) | s[j : len(s) - k + j]
            own.append(np.unique(gram, return_counts=True))
        keys = np.unique(np.concatenate([g for g, _ in own]))
        ctx = np.unique(keys >> np.uint64(8))
        freq = np.zeros((len(keys), count))
        for i, (g, c) in enumerate(own):
            freq[np.searchsorted(keys, g), i] = c
        of = np.searchsorted(ctx, keys >> np.uint64(8))
        total, kinds = np.zeros((len(ctx), count)), np.zeros((len(ctx), count))
        np.add.at(total, of, freq)
        np.add.at(kinds, of, freq > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
            direct = np.log2((total + kinds)[of] / freq)
        below = np.full((len(keys), count), 8.0) if lower is None else lower[1][np.searchsorted(lower[0], keys & np.uint64((1 << 8 * k) - 1))]
        cost = np.where(freq > 0, direct, escape[of] + below)
        lower = (keys, cost)
        grams.append(Table.of(keys))
        costs.append(cost.astype(np.float32))
        contexts.append(Table.of(ctx))
        escapes.append(escape.astype(np.float32))
    model = Model(languages, grams, costs, contexts, escapes)
    limits = []
    for i, lang in enumerate(languages):
        raw = [r for r in (t.lower().encode("utf-8", "surrogatepass") for t in islice((t for l_, t in pairs if l_ == lang and len(t) >= JUDGED_BYTES), SPREAD_DOCS)) if r]
        own = np.array([r[i] for r in model.totals(raw)]) / [len(r) for r in raw] if raw else np.full(1, np.inf)
        limits.append(float(EXCESS * np.quantile(own, QUANTILE)) if raw else math.inf)
    return replace(model, limits=tuple(limits))


def train(docs: DataFrame, lang: str = "lang", docs_per_language: int = TRAIN_DOCS, bytes_per_language: int = TRAIN_BYTES) -> Model | None:
    """A model from a bounded sample of the rows outside the held-out fold; None if there are none."""
    pairs = sample(docs.select("doc_id", F.col(lang).alias("lang")), docs, "lang", docs_per_language, bytes_per_language)
    return fit(pairs) if pairs else None


def predict(texts: list[str | None], model: Model | None) -> list[tuple[str, float, float]]:
    """(language, posterior probability, bits a byte) of each text; null or letterless: ``und``, 0, 0."""
    out: list[tuple[str, float, float]] = [(UNKNOWN, 0.0, 0.0)] * len(texts)
    letters = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model else []
    for at in range(0, len(letters), 64):  # few encoded copies at a time
        some = letters[at : at + 64]
        raw = [texts[i].lower().encode("utf-8", "surrogatepass") for i in some]
        bits = model.totals(raw)
        best = bits.argmin(1)
        gap = bits - bits.min(1, keepdims=True)
        post = 1 / np.exp2(-np.minimum(gap, 1000)).sum(1)
        for n, i in enumerate(some):
            out[i] = (model.languages[best[n]], float(post[n]), float(bits[n, best[n]] / len(raw[n])))
    return out


def spoken(texts: list[str | None], model: Model | None, min_score: float = 0.5) -> list[bool]:
    """Which texts are in some language: ``predict`` names one with at least ``min_score``, and it codes the text as it does its own.

    Texts under ``JUDGED_BYTES`` are not judged by their code length, which varies too much.
    """
    limit = dict(zip(model.languages, model.limits, strict=True)) if model else {}
    return [
        lang != UNKNOWN and score >= min_score and (bits <= limit[lang] or len(text.lower().encode("utf-8", "surrogatepass")) < JUDGED_BYTES)
        for text, (lang, score, bits) in zip(texts, predict(texts, model), strict=True)
    ]


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_byte) of each row of ``docs``.

    The whole text alone decides. A null or letterless text, and every text if nothing was learnt, is
    ``und`` with score 0. A null id is not held out. Repeated rows come as often as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), F.col(text).alias("text"))
    kind = dict(slim.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            found = predict(b.column(2).to_pylist(), shared.value)
            cols = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.record_batch([b.column(0), b.column(1), *cols], names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    return slim.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, bits_per_byte double")
