"""Encoding a corpus with a public byte-level BPE tokenizer: speculate and verify.

Texts are split into words by the tokenizer's pattern; each distinct word of a task is encoded once.
All new words of a block are encoded together: longest-match proposes tokens (rolling hashes of every
prefix, binary search over the vocabulary's prefix tree), then one vectorised pass checks every adjacent
pair of proposed tokens for compatibility.  A sequence of valid tokens whose adjacent pairs are all compatible
is exactly what the merges would give; words that fail the check (and very long ones) are merged exactly.

A null and an empty text have the empty list of ids.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the splitting pattern of the byte-level vocabularies (white space as the Unicode property).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
LONG = 64
BASE = np.uint64(0x9E3779B97F4A7C15)
CHARS_AT_ONCE = 1 << 20
CACHE_WORDS = 1 << 20


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tables of a byte-level BPE vocabulary; picklable, a few MB, to be broadcast."""

    def __init__(self, path: str = DEFAULT_VOCABULARY):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        vocab = model["vocab"]
        self.bytes: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for word, i in vocab.items():
            if all(c in letters for c in word):
                self.bytes[i] = bytes(letters[c] for c in word)
        n = len(self.bytes)
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        self.rank = np.full(n, -1)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pair, t = (vocab[a], vocab[b]), vocab[a + b]
            self.merges.setdefault(pair, (r, t))
            if self.rank[t] < 0 and len(self.bytes[t]) > 1:
                self.left[t], self.right[t], self.rank[t] = *pair, r
        self.single = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])])
        keys = np.array([(a << 32) | b for a, b in self.merges], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_rank = np.array([r for r, _ in self.merges.values()])[order]
        self._tree()
        made = np.flatnonzero(self.rank >= 0)
        self.valid = self.rank < 0
        self.valid[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for t in made[np.argsort(self.rank[made])]:  # a token is whole only if its halves are
            self.valid[t] &= self.valid[self.left[t]] & self.valid[self.right[t]]

    def _tree(self) -> None:
        nodes: dict[bytes, int] = {}
        for t, b in enumerate(self.bytes):
            if b and (len(b) == 1 or self.rank[t] >= 0):
                nodes[b] = t
        prefixes = {b[:i] for b in nodes for i in range(1, len(b) + 1)}
        best: dict[bytes, int] = {}
        for p in sorted(prefixes, key=len):
            best[p] = nodes.get(p, best.get(p[:-1], -1))
        h = np.array([int(_hash(p)) for p in best], dtype=np.uint64)
        bits = 20
        while (1 << bits) < 8 * len(h):
            bits += 1
        self.shift = np.uint64(64 - bits)
        order = np.argsort(self._slot(h), kind="stable")
        token = np.array(list(best.values()))[order]
        h = h[order]
        # Open addressing: probes run upwards from a mix of the hash.
        self.slot_hash = np.zeros((1 << bits) + 64, dtype=np.uint64)
        self.slot_token = np.full((1 << bits) + 64, -1, dtype=np.int32)
        at, last = self._slot(h), -1
        for i in range(len(h)):
            last = max(last + 1, int(at[i]))
            self.slot_hash[last], self.slot_token[last] = h[i], token[i]
        self.probes = int(max(np.flatnonzero(self.slot_token >= 0) - at)) + 1
        self.deepest = max(map(len, best))
        self.size = np.array([len(b) for b in self.bytes])

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> self.shift).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Longest token on the tree path with hash h, -1 where the tree has no such path."""
        at = self._slot(h)
        out = np.full(len(h), -1, dtype=np.int32)
        for p in range(self.probes):
            hit = self.slot_hash[at + p] == h
            out[hit] = self.slot_token[at[hit] + p]
        return out

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, a huge number for pairs that never merge."""
        key = (a.astype(np.int64) << 32) | b
        i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[i] == key, self.pair_rank[i], np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Whether merging would leave token a beside token b as they are.

        Undoes the later of the two merges step by step; at each stage a pair that meets at the border must
        not merge before the one that was undone last on either side (nor before ``below``).
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        never = np.iinfo(np.int64).max
        limit = np.full(len(a), never) if below is None else below.astype(np.int64)
        # A merge over the border of equal rank wins from the right token (it starts further left).
        strict = np.ones(len(a), dtype=bool)
        ok = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            r = self.pair(x, y)
            broken = np.where(strict[live], r < limit[live], r <= limit[live]) & (r != never)
            ok[live[broken]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~broken & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            take_left = rx > ry
            a[live] = np.where(take_left, self.right[x], x)
            b[live] = np.where(take_left, y, self.left[y])
            limit[live] = np.where(take_left, rx, ry)
            # Equal rank: the leftmost goes first.  A border merge lies left of the right token's, right of the left one's.
            strict[live] = take_left
        return ok

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: lowest rank first, leftmost of equals."""
        ids: list[int] = [int(self.single[b]) for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.merges[p][0], i) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.merges]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or (m := self.merges.get((ids[i], ids[j]))) is None or m[0] != r:
                continue
            ids[i], ids[j] = m[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := self.merges.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (m[0], i))
            h = before[i]
            if h >= 0 and (m := self.merges.get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (m[0], h))
        return [t for t in ids if t >= 0]


def _hash(b: bytes) -> np.uint64:
    h = 0
    for c in b:
        h = (h * int(BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF
    return np.uint64(h)


class Encoder:
    """Word cache of one task around a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.split = regex.compile(PATTERN).findall
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(LONG, BASE)]), dtype=np.uint64)
        self.exact = 0
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.flat: list[np.ndarray] = []
        self.lens: list[np.ndarray] = []
        self._ids = np.empty(0, dtype=np.int32)
        self._len = np.empty(0, dtype=np.int64)
        self._start = np.empty(0, dtype=np.int64)

    def learn(self, words: list[str]) -> None:
        """Encode words that are not in the cache."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        short = [i for i, b in enumerate(raw) if len(b) <= LONG]
        ids: list = [None] * len(raw)
        if short:
            for i, got in zip(short, self.speculate([raw[i] for i in short])):
                ids[i] = got
        for i, b in enumerate(raw):
            if ids[i] is None:
                self.exact += 1
                ids[i] = np.array(self.v.merge(b), dtype=np.int32)
        start = len(self.index)
        self.index.update(zip(words, range(start, start + len(words))))
        self._ids = np.concatenate([self._ids, *ids]).astype(np.int32)
        self._len = np.concatenate([self._len, [len(x) for x in ids]]).astype(np.int64)
        self._start = np.concatenate([[0], np.cumsum(self._len)[:-1]])

    def speculate(self, raw: list[bytes]) -> list[np.ndarray | None]:
        """Tokens of each word by longest match, None where an adjacent pair is not compatible."""
        v, n = self.v, len(raw)
        lens = np.array([len(b) for b in raw])
        text = np.zeros((n, LONG), dtype=np.uint8)
        text[np.arange(LONG) < lens[:, None]] = np.frombuffer(b"".join(raw), dtype=np.uint8)
        pre = np.zeros((n, LONG + 1), dtype=np.uint64)
        for i in range(int(lens.max())):
            pre[:, i + 1] = pre[:, i] * BASE + text[:, i].astype(np.uint64) + np.uint64(1)
        at = np.zeros(n, dtype=np.int64)
        rows_out, toks_out = [], []
        live = np.flatnonzero(lens > 0)
        while len(live):
            lo = np.ones(len(live), dtype=np.int64)
            hi = np.minimum(lens[live] - at[live], v.deepest)
            start = pre[live, at[live]]
            tok = v.single[text[live, at[live]]].astype(np.int32)
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_] + 1) // 2
                rows = live[open_]
                got = v.find(pre[rows, at[rows] + mid] - start[open_] * self.power[mid])
                hit = got >= 0
                lo[open_[hit]] = mid[hit]
                tok[open_[hit]] = got[hit]
                hi[open_[~hit]] = mid[~hit] - 1
            rows_out.append(live)
            toks_out.append(tok)
            at[live] += v.size[tok]
            live = live[at[live] < lens[live]]
        rows, toks = np.concatenate(rows_out), np.concatenate(toks_out)
        order = np.argsort(rows, kind="stable")
        rows, toks = rows[order], toks[order]
        good = np.ones(n, dtype=bool)
        good[rows[~v.valid[toks]]] = False
        inner = np.flatnonzero(rows[1:] == rows[:-1])
        if len(inner):
            pairs, back = np.unique((toks[inner].astype(np.int64) << 32) | toks[inner + 1], return_inverse=True)
            fits = v.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
            good[rows[inner[~fits[back]]]] = False
        cuts = np.searchsorted(rows, np.arange(n + 1))
        out: list[np.ndarray | None] = []
        for i, b in enumerate(raw):
            got = toks[cuts[i] : cuts[i + 1]]
            # The bytes are compared too, so that a hash collision could cost time but never the result.
            out.append(got if good[i] and b"".join([v.bytes[t] for t in got]) == b else None)
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ends of each text's ids, with a leading 0; ids of all texts)."""
        words = [self.split(t) if t else [] for t in texts]
        flat = [w for ws in words for w in ws]
        new = [w for w in dict.fromkeys(flat) if w not in self.index]
        if len(self.index) + len(new) > CACHE_WORDS:
            self.reset()
            new = list(dict.fromkeys(flat))
        if new:
            self.learn(new)
        at = np.fromiter(map(self.index.__getitem__, flat), dtype=np.int64, count=len(flat))
        n = self._len[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self._ids[np.repeat(self._start[at] - ends[:-1], n) + np.arange(ends[-1])]
        return ends[np.concatenate([[0], np.cumsum([len(ws) for ws in words])]).astype(np.int64)], ids


def blocks(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(offset, texts) of runs of bounded length; a single text is never divided."""
    held: list[str | None] = []
    size = start = 0
    for i in range(len(texts)):
        t = texts[i].as_py()
        held.append(t)
        size += len(t) if t else 0
        if size >= CHARS_AT_ONCE:
            yield start, held
            held, size, start = [], 0, i + 1
    if held:
        yield start, held


def encode_corpus(df: DataFrame, id_col: str, text_col: str, vocabulary: str = DEFAULT_VOCABULARY, out: str = "ids") -> DataFrame:
    """(id, ids array<int>) of every row, without special tokens; one pass, no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(shared.value)
        for b in batches:
            for at, texts in blocks(b.column(1)):
                ends, ids = enc.encode(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))], names=[id_col, out])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, {out} array<int>")


def count_tokens(df: DataFrame, keep: list[str], text_col: str, vocabulary: str = DEFAULT_VOCABULARY, out: str = "n_tokens") -> DataFrame:
    """``keep`` columns and the number of tokens of each row's text."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))
    small = df.select(*keep, F.col(text_col).alias("_text"))
    schema = ", ".join(f"{c} {small.schema[c].dataType.simpleString()}" for c in keep) + f", {out} bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(shared.value)
        for b in batches:
            for at, texts in blocks(b.column(len(keep))):
                ends, _ = enc.encode(texts)
                yield pa.RecordBatch.from_arrays([*[b.column(i).slice(at, len(texts)) for i in range(len(keep))], pa.array(np.diff(ends))], names=[*keep, out])

    return small.mapInArrow(run, schema)
