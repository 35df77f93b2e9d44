"""SentencePiece encoding by unigram Viterbi over a double-array trie, and decoding.

The model file gives pieces with log scores. Texts are normalised as the model asks (it must
be the identity rule: blanks become the marker U+2581, with one put in front), every piece
that matches at a place is found by one walk through the trie, and the best-scored path of
pieces is taken. A character that no piece covers costs the least score less ``UNKNOWN_COST``
and is written as its UTF-8 bytes where the model has byte pieces.

No piece has a marker after another character, so every path breaks before a marker that
follows one: texts are encoded word by word, exactly. A worker numbers the words it has met;
the new words of a batch are searched together, in lockstep: all walks through the trie take
their steps at once, and so do the paths, by the place where a piece starts in its word. A
model with other pieces is encoded as one run of text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Numbers, slices

#: Where the public model lies; a parameter of every entry point.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
UNKNOWN_COST = 10.0
#: Characters of the words a worker remembers; beyond them it starts afresh.
CACHE_CHARS = 1_000_000
#: Longer words (characters) are searched one by one, shorter ones all at once.
LONG_WORD = 64
#: Longer texts (characters) are cut into words a part at a time.
PART = 1 << 18
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


#: Bases tried at once when the children of a state are placed.
WINDOW = 512


class DoubleArray:
    """A trie over bytes in two arrays: from state s by byte b to t = base[s] + b + 1 if check[t] == s.

    ``value[s]`` is the number of the key that ends in state s, or -1. State 0 is the root.
    """

    def __init__(self, keys: dict[bytes, int]):
        size = 1024
        base, check, value, free = (np.full(size, x, t) for x, t in ((0, np.int32), (-1, np.int32), (-1, np.int32), (True, bool)))
        free[0] = False
        todo = [(0, sorted(keys.items()), 0)]
        start = wide = 1
        while todo:
            state, group, depth = todo.pop()
            if group and len(group[0][0]) == depth:
                value[state] = group[0][1]
                group = group[1:]
            if not group:
                continue
            kids: dict[int, list] = {}
            for item in group:
                kids.setdefault(item[0][depth], []).append(item)
            codes = [k + 1 for k in kids]
            start += int(free[start:].argmax())
            at, tried = max((start if len(codes) == 1 else wide) - codes[0], 0), 0
            while True:  # the first base whose places are all free, a window of bases at a time
                while at + WINDOW + 257 > size:
                    base, check, value, free = (np.concatenate([x, np.full(size, f, x.dtype)]) for x, f in ((base, 0), (check, -1), (value, -1), (free, True)))
                    size *= 2
                if len(codes) == 1 and free[at + codes[0]]:
                    break
                fit = free[at + codes[0] : at + codes[0] + WINDOW].copy()
                for c in codes[1:]:
                    fit &= free[at + c : at + c + WINDOW]
                if fit.any():
                    at += int(fit.argmax())
                    break
                at, tried = at + WINDOW, tried + 1
            if tried > 2:  # the arrays are too full here for states with several children
                wide = at + codes[0]
            base[state] = at
            for k, items in kids.items():
                t = at + k + 1
                free[t], check[t] = False, state
                todo.append((t, items, depth + 1))
        end = int(np.flatnonzero(~free)[-1]) + 258  # a step from any state stays inside
        self.base, self.check, self.value = base[:end], check[:end], value[:end]


class Known:
    """The words met so far by number, and their ids end to end."""

    def __init__(self) -> None:
        self.number = Numbers()
        self.chars = 0
        self.flat, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)

    def add(self, words: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        """The ids of the words numbered last."""
        self.chars += sum(map(len, words))
        self.flat = np.concatenate([self.flat, flat])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each run, end to end."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


@dataclass
class Model:
    """Pieces by id, their scores and kinds, and the trie of those a text may be cut into."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    prefix: bool = True
    trie: DoubleArray | None = None
    by_word: bool = True
    known: Known | None = None

    def __post_init__(self) -> None:
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER)]
        self.trie = DoubleArray({self.pieces[i].encode(): i for i in usable})
        self.by_word = all(MARKER not in self.pieces[i].lstrip(MARKER) for i in usable)
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.unknown_score = min([self.scores[i] for i in usable if self.kinds[i] == NORMAL], default=0.0) - UNKNOWN_COST
        self.spelt = [self.spell(i) for i in range(len(self.pieces))]
        self.score_of = np.array(self.scores, float)
        self.byte_ids = np.array([self.bytes.get(b, self.unknown) for b in range(256)])
        self.chunk = re.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+") if self.by_word else re.compile(r"(?s).+")

    @staticmethod
    def load(path: str = MODEL_PATH) -> Model:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models with the identity normalisation are supported")
        return Model([p.piece for p in proto.pieces], [p.score for p in proto.pieces], [p.type for p in proto.pieces], spec.add_dummy_prefix)

    def spell(self, i: int) -> bytes:
        """The bytes a piece stands for."""
        kind = self.kinds[i]
        if kind == BYTE:
            return bytes([int(self.pieces[i][1:-1], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else self.pieces[i].replace(MARKER, " ").encode()

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": None}

    def path(self, chunk: str) -> tuple[int, ...]:
        """The ids of the best path through one chunk, place by place. Of equal paths the earlier start wins."""
        raw = chunk.encode("utf-8", "surrogatepass")
        n, low = len(raw), float("-inf")
        best, come, piece = [low] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        scores, item = self.scores, (self.trie.base.item, self.trie.check.item, self.trie.value.item)
        base, check, value = item
        for at in range(n):
            here = best[at]
            if here == low:
                continue
            lead = raw[at]
            after = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            single, state, end = False, 0, at
            while end < n:  # one walk through the trie finds every piece that starts here
                t = base(state) + raw[end] + 1
                if check(t) != state:
                    break
                state, end = t, end + 1
                i = value(t)
                if i >= 0:
                    if here + scores[i] > best[end]:
                        best[end], come[end], piece[end] = here + scores[i], at, i
                    if end == after:
                        single = True
            if not single and here + self.unknown_score > best[after]:
                best[after], come[after], piece[after] = here + self.unknown_score, at, -1
        ids: list[int] = []
        at = n
        while at:
            start = come[at]
            if piece[at] >= 0:
                ids.append(piece[at])
            elif self.bytes:
                ids += [self.bytes[b] for b in reversed(raw[start:at])]
            else:
                ids.append(self.unknown)
            at = start
        return tuple(reversed(ids))

    def paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the best path through each of many non-empty words, end to end, and how many each has.

        The same search as ``path``, for all words at once. Place b of word w has the number b + w, so
        that a word's end is no other word's start.
        """
        raw = np.frombuffer("".join(words).encode("utf-8", "surrogatepass") + b"\0", np.uint8)
        chars = np.fromiter(map(len, words), np.int64, len(words))
        edge = np.append(np.flatnonzero((raw[:-1] & 0xC0) != 0x80), len(raw) - 1)  # where characters start
        first = np.cumsum(chars) - chars
        word = np.repeat(np.arange(len(words)), chars)
        begin, end = edge[:-1], edge[first + chars]
        # every walk takes one step of the trie a round
        who, state, at, limit = np.arange(len(begin)), np.zeros(len(begin), np.int64), begin, end[word]
        starts, stops, found = [], [], []
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        while len(who):
            step = base[state] + raw[at] + 1
            on = (check[step] == state) & (at < limit)
            who, state, at, limit = who[on], step[on], at[on] + 1, limit[on]
            hit = value[state]
            some = hit >= 0
            starts.append(who[some])
            stops.append(at[some])
            found.append(hit[some])
        start, stop, piece = np.concatenate(starts), np.concatenate(stops), np.concatenate(found).astype(np.int64)
        bare = np.ones(len(begin), bool)
        bare[start[stop == edge[start + 1]]] = False
        bare = np.flatnonzero(bare)  # characters that no piece covers
        start, stop, piece = np.concatenate([start, bare]), np.concatenate([stop, edge[bare + 1]]), np.concatenate([piece, np.full(len(bare), -1)])
        gain = np.where(piece >= 0, self.score_of[piece], self.unknown_score)
        nth = (start - first[word[start]]).astype(np.int16)
        order = np.argsort(nth, kind="stable")
        rounds = np.append(np.searchsorted(nth[order], np.arange(int(nth.max(initial=-1)) + 1)), len(order)).tolist()
        src, dst, piece, gain = (begin[start] + word[start])[order], (stop + word[start])[order], piece[order], gain[order]
        top, last = np.full(len(raw) + len(words), -np.inf), end + np.arange(len(words))
        come, by = np.zeros(len(top), np.int64), np.full(len(top), -1)
        head = edge[first] + np.arange(len(words))
        top[head] = 0.0
        for a, b in zip(rounds, rounds[1:], strict=False):
            score = top[src[a:b]] + gain[a:b]
            to = dst[a:b]
            better = np.flatnonzero(score > top[to])
            to = to[better]
            top[to], come[to], by[to] = score[better], src[a:b][better], piece[a:b][better]
        own, now, parts = np.arange(len(words)), last, []
        while len(own):
            back = come[now]
            parts.append((own, by[now], back, now - back))
            more = back != head[own]
            own, now = own[more], back[more]
        own, ids, place, wide = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.argsort(place)
        own, ids, place, wide = own[order], ids[order], place[order], wide[order]
        count = np.where((ids < 0) & bool(self.bytes), wide, 1)
        flat = np.repeat(ids, count)
        lost = flat < 0
        if lost.any():
            flat[lost] = self.byte_ids[raw[ragged(place - own, count)[lost]]] if self.bytes else self.unknown
        return flat.astype(np.int32), np.bincount(own, count, len(words)).astype(np.int64)

    def _search(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``paths``, with long words one by one."""
        short = [w for w in words if len(w) <= LONG_WORD]
        if len(short) == len(words):
            return self.paths(words)
        flat, sizes = self.paths(short) if short else (np.empty(0, np.int32), np.empty(0, np.int64))
        parts = iter(np.split(flat, np.cumsum(sizes)[:-1]))
        parts = [next(parts) if len(w) <= LONG_WORD else np.array(self.path(w), np.int32) for w in words]
        return np.concatenate(parts), np.array([len(p) for p in parts])

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many texts, end to end, and how many each has; none for null and empty texts."""
        flat, sizes = [np.empty(0, np.int32)], np.zeros(len(texts), np.int64)
        held: list[str] = []
        owners: list[tuple[int, int]] = []
        chars = 0
        for n, text in enumerate(texts):
            for part in self._parts(text) if text else ():
                chunks = self.chunk.findall(part)
                held += chunks
                owners.append((n, len(chunks)))
                chars += len(part)
                if chars >= PART:
                    flat.append(self._gather(held, owners, sizes))
                    held, owners, chars = [], [], 0
        flat.append(self._gather(held, owners, sizes))
        return np.concatenate(flat), sizes

    def _gather(self, chunks: list[str], owners: list[tuple[int, int]], sizes: np.ndarray) -> np.ndarray:
        """The ids of chunks end to end; what each text has of them is added to ``sizes``."""
        if not chunks:
            return np.empty(0, np.int32)
        if self.known is None or self.known.chars > CACHE_CHARS:
            self.known = Known()
        known = self.known
        met = len(known.number)
        number = np.fromiter(map(known.number.__getitem__, chunks), np.int64, len(chunks))
        if len(known.number) > met:
            new = list(islice(known.number, met, None))
            known.add(new, *self._search(new))
        size = known.ends[number + 1] - known.ends[number]
        before = np.concatenate([[0], np.cumsum(size)])
        stops = np.cumsum([k for _, k in owners])
        np.add.at(sizes, [n for n, _ in owners], before[stops] - before[stops - [k for _, k in owners]])
        return known.flat[ragged(known.ends[number], size)]

    def _parts(self, text: str) -> Iterator[str]:
        """A text with markers, in parts of about ``PART`` characters that end where a word does."""
        at, n = 0, len(text)
        while at < n:
            end = at + PART
            if not self.by_word or end >= n:
                end = n
            else:
                while end < n and (text[end] not in " ▁" or text[end - 1] in " ▁"):
                    end += 1
            yield MARKER * (self.prefix and not at) + text[at:end].replace(" ", MARKER)
            at = end

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for null and empty texts."""
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: markers become blanks, byte pieces bytes; control pieces vanish.

        The marker put in front is taken off. Ids cut out of the middle of a character give U+FFFD.
        """
        text = b"".join([self.spelt[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def encode(docs: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens, n_byte_pieces, decoded) of each row of ``docs``.

    Null and empty texts have no ids and decode to the empty text. ``decoded`` is what the ids give
    back: the text itself, but for a U+2581 in it, which decodes to a blank. Repeated rows come as
    often as they are; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or Model.load())
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(slim.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        coded = np.array([k == BYTE for k in m.kinds])
        for b in slices(batches, 1):
            flat, counts = m.encode_all(b.column(1).to_pylist())
            starts = np.concatenate([[0], np.cumsum(counts)])
            bytes_before = np.concatenate([[0], np.cumsum(coded[flat])])
            ids, cuts = flat.tolist(), starts.tolist()
            decoded = [m.decode(ids[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
            yield pa.record_batch(
                [
                    b.column(0),
                    pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat)),
                    pa.array(counts, pa.int32()),
                    pa.array(np.diff(bytes_before[starts]), pa.int32()),
                    pa.array(decoded, pa.string()),
                ],
                names=["doc_id", "ids", "n_tokens", "n_byte_pieces", "decoded"],
            )

    return slim.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens int, n_byte_pieces int, decoded string")
