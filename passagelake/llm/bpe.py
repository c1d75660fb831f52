"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

One queue serves all merges of a pre-token. Each merge rank has a bucket: a heap of the positions
of the pre-token's linked list whose pair has that rank. A bitmap with 512 ranks a word marks the
buckets that are not empty, and an upper level marks the words that are not zero. Two
find-first-set steps give the lowest rank, so that a pre-token of n bytes costs about n log n, also
when it is megabytes long. Ranks are counted from the last one down, so that the first set bit is
an integer's highest one, which its length tells. A merge changes the pairs on both sides; their old
entries stay in their buckets and are skipped as stale when they come up.

Results: null texts are encoded like empty ones (no ids). Empty table: empty result. Equal rows
give equal results. Texts of any length are processed whole, in pieces of CHUNK pre-tokens.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from passagelake.llm.common import arrow_map

#: Pre-tokens whose ids a worker remembers (about 200 bytes each), up to that length, in each of two
#: generations: when the new one is full it becomes the old one, and what is met again moves on.
CACHE_ENTRIES = 250_000
CACHE_PIECE = 64
#: Bits of a rank that one level of the bitmap resolves.
WORD = 9
MASK = (1 << WORD) - 1
#: Pre-tokens held at once of a long text, and the length from which a text is taken in such pieces.
CHUNK = 50_000
LONG = 1 << 20


class ByteBPE:
    """Encoder and decoder for a rank table; encodes as the tiktoken library does without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        self.vocab = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            self.vocab[rank] = piece
        if len(self.vocab) > 1 << (2 * WORD):
            raise ValueError(f"at most {1 << (2 * WORD)} ranks")
        # In the queue's own numbers: the last rank is 0, so that lower ranks have higher numbers.
        self.last = len(self.vocab) - 1
        self.order = {piece: self.last - rank for piece, rank in ranks.items()}
        self.byte = [self.order.get(bytes((a,)), self.last + 1) for a in range(256)]
        self.two = [[self.order.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)]
        self.bit = [1 << b for b in range(1 << WORD)]
        self.low = [0] * (1 << WORD)  # empty between two pre-tokens
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token.

        The queue is written out in place, as calls would cost more than its steps: `buckets` has
        of each number q the position of its pair, or a heap of positions; bit q % 2**WORD of
        low[q >> WORD] says whether bucket q is there, bit w of top whether low[w] is not zero.
        """
        get, two, low, bit, last, top = self.order.get, self.two, self.low, self.bit, self.last, 0
        whole = get(piece)
        if whole is not None:
            return [last - whole]
        n = len(piece)
        buckets: dict[int, int | list[int]] = {}
        token = [self.byte[b] for b in piece]
        after = list(range(1, n + 2))  # start of the next part; n is the end
        before = list(range(-1, n))
        pair = [two[a][b] for a, b in zip(piece, piece[1:])]  # number of a part with the next one; -1: none, or the part is gone
        pair.append(-1)
        live = len(pair) - pair.count(-1)  # pairs that can merge; all entries left without one are stale
        for i, q in enumerate(pair):
            if q < 0:
                continue
            if q not in buckets:
                buckets[q] = i
                w = q >> WORD
                low[w] |= bit[q & MASK]
                top |= bit[w]
            elif type(bucket := buckets[q]) is int:
                buckets[q] = [bucket, i]
            else:
                bucket.append(i)
        while live:
            # Find-first-set on both levels: the lowest rank; of its positions the leftmost.
            w = top.bit_length() - 1
            bits = low[w]
            b = bits.bit_length() - 1
            q = (w << WORD) + b
            bucket = buckets[q]
            if type(bucket) is int:
                i = bucket
                del buckets[q]
                bits ^= bit[b]
                low[w] = bits
                if not bits:
                    top ^= bit[w]
            else:
                i = heapq.heappop(bucket)
                if len(bucket) == 1:
                    buckets[q] = bucket[0]
            if pair[i] != q:
                continue  # stale
            j = after[i]
            k = after[j]
            token[i] = q
            after[i] = k
            before[k] = i
            live -= 1 if pair[j] < 0 else 2
            pair[j] = pair[i] = -1
            if k < n and (q := get(piece[i : after[k]])) is not None:
                pair[i] = q
                live += 1
                if q not in buckets:
                    buckets[q] = i
                    w = q >> WORD
                    low[w] |= bit[q & MASK]
                    top |= bit[w]
                elif type(bucket := buckets[q]) is int:
                    buckets[q] = [bucket, i] if bucket < i else [i, bucket]
                else:
                    heapq.heappush(bucket, i)
            h = before[i]
            if h >= 0 and (q := get(piece[h:k], -1)) != pair[h]:
                if pair[h] >= 0:
                    live -= 1
                pair[h] = q
                if q >= 0:
                    live += 1
                    if q not in buckets:
                        buckets[q] = h
                        w = q >> WORD
                        low[w] |= bit[q & MASK]
                        top |= bit[w]
                    elif type(bucket := buckets[q]) is int:
                        buckets[q] = [bucket, h] if bucket < h else [h, bucket]
                    else:
                        heapq.heappush(bucket, h)
        while top:
            w = top.bit_length() - 1
            low[w] = 0
            top ^= bit[w]
        out, i = [], 0
        while i < n:
            out.append(last - token[i])
            i = after[i]
        return out

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def packed(self, piece: str) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers."""
        out = self.old.get(piece) or self.pack(self.merge(piece.encode()))
        if len(piece) <= CACHE_PIECE:
            self.cache[piece] = out
        return out

    def turn(self) -> None:
        """Between texts: a full generation becomes the old one."""
        if len(self.cache) >= CACHE_ENTRIES:
            self.old, self.cache = self.cache, {}

    def encode_packed(self, text: str):
        """Packed ids of a text, in parts of at most CHUNK pre-tokens."""
        self.turn()
        get, packed = self.cache.get, self.packed
        if len(text) < LONG:
            yield b"".join([get(p) or packed(p) for p in self.pattern.findall(text)])
            return
        pieces = (m.group() for m in self.pattern.finditer(text))
        while part := list(islice(pieces, CHUNK)):
            self.turn()
            get = self.cache.get
            yield b"".join([get(p) or packed(p) for p in part])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.encode_packed(text)), "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


_MODELS: dict[str, ByteBPE] = {}


def _model(raw: bytes, pattern: str) -> ByteBPE:
    """One model for each rank file in each worker."""
    key = hashlib.sha256(raw + pattern.encode()).hexdigest()
    if key not in _MODELS:
        _MODELS[key] = ByteBPE(parse_ranks(raw), pattern)
    return _MODELS[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """Columns `keep` (all but the text by default) and n_tokens, ids_sha256, decoded_sha256, with ids if asked for.

    ranks_path: rank file on the driver; its bytes (about 1 MB, bounded by the vocabulary) are broadcast.
    Columns of docs that are named like a result are left out of `keep`.
    """
    with open(ranks_path, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names and (keep is not None or c != text)]

    def run(x: dict[str, pa.Array]) -> dict[str, pa.Array]:
        model = _model(raw.value, pattern)
        out: dict[str, list] = {n: [] for n in names}
        for t in x[text].to_pylist():
            n, ids_hash, text_hash, ids = 0, hashlib.sha256(), hashlib.sha256(), []
            for part in model.encode_packed(t or ""):
                n += len(part) // 4
                ids_hash.update(part)
                numbers = np.frombuffer(part, "<u4")
                text_hash.update(model.decode(numbers.tolist()))
                if with_ids:
                    ids.append(numbers.astype(np.int32))
            out["n_tokens"].append(n)
            out["ids_sha256"].append(ids_hash.hexdigest())
            out["decoded_sha256"].append(text_hash.hexdigest())
            if with_ids:
                out["ids"].append(np.concatenate(ids) if ids else np.zeros(0, np.int32))
        kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.list_(pa.int32())}
        return {n: pa.array(v, kinds[n]) for n, v in out.items()}

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids]
    return arrow_map(docs, keep, [text], run, fields)


def decode(tokens: DataFrame, ranks_path: str, *, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` and decoded (bytes) from a column of ids; null ids give empty bytes."""
    with open(ranks_path, "rb") as f:
        raw = tokens.sparkSession.sparkContext.broadcast(f.read())
    keep = [c for c in (tokens.columns if keep is None else keep) if c not in (ids, "decoded")]

    def run(x: dict[str, pa.Array]) -> dict[str, pa.Array]:
        model = _model(raw.value, "")
        return {"decoded": pa.array([model.decode(i or []) for i in x[ids].to_pylist()], pa.binary())}

    return arrow_map(tokens, keep, [ids], run, [T.StructField("decoded", T.BinaryType())])
