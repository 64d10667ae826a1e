"""Byte-level BPE encoding by speculation and verification, and decoding.

Encoding a word: greedy longest match over the vocabulary's trie proposes tokens (all words of a batch at
once, in numpy). A sequence of tokens is the BPE result exactly if every adjacent pair would stay a pair when
its own text is merged. That check is vectorised too and cached by pair. Only words with a failing pair are
merged step by step. Texts are cut into words by the vocabulary's pattern. Each distinct chunk between single
spaces is cut and encoded once for a worker; its ids are kept in a cache of CACHE_ENTRIES and CACHE_BYTES at most; chunks over LONG_CHUNK
characters (texts without spaces are one chunk) leave it with their batch.

Ids equal those of the ``tokenizers`` library for the same file, special tokens included (as by default there,
their strings in a text become their ids), with padding and truncation unused.

Edge cases: null and empty texts have no ids and decode to an empty text. Texts of any length are encoded
whole; words over LONG_WORD bytes go straight to exact merging (a heap, n log n). Repeated rows are encoded
each, an empty table gives none. Extra columns are kept, but for one named as the result (``ids``, ``decoded``): it is replaced.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

from .shared import documents, map_batches

LONG_WORD = 512
CACHE_ENTRIES = 400_000
CACHE_BYTES = 96 << 20
LONG_CHUNK = 64
#: What a cache entry takes besides its key and value.
ENTRY_BYTES = 100
#: White space, in ASCII and beyond. At a space with none of it on either side, a word always starts.
_WHITE = " \t\n\v\f\r\x1c\x1d\x1e\x1f", "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD_ASCII, _ODD_OTHERS = ({x for w in ws for x in (w + " ", " " + w)} for ws in _WHITE)


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 bytes for
    themselves, the others for the characters from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tables of a tokenizer file whose merged tokens are numbered in the order of their merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max(max(vocab.values()), *self.special.values(), 0)
        self.bytes = [b""] * self.size
        for s, i in vocab.items():
            self.bytes[i] = bytes(map(alphabet.__getitem__, s))
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.base = np.zeros(256, np.int64)
        for i, b in enumerate(self.bytes):
            if len(b) == 1:
                self.base[b[0]] = i
        # left/right: the pair that made a token; never: a base token is not taken apart.
        self.left = np.full(self.size, -1, np.int64)
        self.right = np.full(self.size, -1, np.int64)
        rank = {}
        for pair in spec["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i, pair = vocab[a + b], (vocab[a], vocab[b])
            rank[pair] = i
            if self.left[i] < 0:
                self.left[i], self.right[i] = pair
        ids = list(rank.values())
        if ids != sorted(ids):
            raise ValueError("token ids do not follow the order of the merges")
        self.rank = rank
        keys = np.fromiter((a * self.size + b for a, b in rank), np.int64, len(rank))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ids = keys[order], np.array(ids, np.int64)[order]
        made = np.flatnonzero(self.left >= 0)
        sound = self.compatible(self.left[made], self.right[made], made)
        self.unsound = set(made[~sound].tolist())
        self._build_trie([i for s, i in vocab.items() if i not in self.unsound])
        self.verdicts: dict[int, bool] = {}

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that a and b merge into, or size."""
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ids[at], self.size)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge crosses from a to b while both are built up (and before the step ``before``).

        Going back in time, the later made of the two tokens at the border comes apart, and only its half at
        the border counts. While two tokens face each other, their own merge crosses the border if it is
        earlier than the step that ends the left one, or not later than the one that ends the right one.
        """
        a, b = a.copy(), b.copy()
        end_a = np.full(len(a), self.size, np.int64) if before is None else before.copy()
        end_b = end_a.copy()
        ok, open_ = np.ones(len(a), bool), np.arange(len(a))
        first = before is not None
        while len(open_):
            x, y, ex, ey = a[open_], b[open_], end_a[open_], end_b[open_]
            step = self.merged(x, y)
            crossing = (step < ex) & ((step < ey) if first else (step <= ey)) & (step < self.size)
            if first:
                first = False
            ok[open_[crossing]] = False
            later = x > y
            target = np.where(later, x, y)
            splits = self.left[target] >= 0
            swap = ~splits & (self.left[np.where(later, y, x)] >= 0)
            later ^= swap
            splits |= swap
            go = splits & ~crossing
            la, lb = go & later, go & ~later
            ia, ib = open_[la], open_[lb]
            end_a[ia], a[ia] = x[la], self.right[x[la]]
            end_b[ib], b[ib] = y[lb], self.left[y[lb]]
            open_ = open_[go]
        return ok

    def _build_trie(self, ids: list[int]) -> None:
        step: dict[int, int] = {}
        token = [-1]
        for i in sorted(ids):
            at = 0
            for byte in self.bytes[i]:
                key = at << 8 | byte
                at = step.get(key, 0)
                if not at:
                    at = step[key] = len(token)
                    token.append(-1)
            token[at] = i
        self.node_token = np.array(token, np.int64)
        # Open addressing: a power of two over four times the edges.
        bits = int(len(step) * 4).bit_length()
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key = np.full(1 << bits, -1, np.int64)
        self.slot_node = np.zeros(1 << bits, np.int64)
        keys = np.fromiter(step, np.int64, len(step))
        for key, at, node in zip(keys.tolist(), self._slot(keys).tolist(), step.values(), strict=True):
            while self.slot_key[at] >= 0:
                at = (at + 1) & self._mask
            self.slot_key[at], self.slot_node[at] = key, node

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def _step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The next trie nodes, 0 where there is none."""
        keys = nodes << 8 | chars
        at = self._slot(keys)
        out = np.zeros(len(keys), np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            there = self.slot_key[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.slot_node[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
            at[open_] = (at[open_] + 1) & self._mask
        return out

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match: the words' tokens in one array, and each token's word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        word = np.arange(len(words))[lengths > 0]
        pos, end = (ends - lengths)[word], ends[word]
        node, token, token_end = np.zeros(len(word), np.int64), np.full(len(word), -1, np.int64), pos.copy()
        out_word, out_pos, out_token = [], [], []
        while len(word):
            inside = pos < end
            nxt = np.zeros(len(word), np.int64)
            nxt[inside] = self._step(node[inside], text[pos[inside]])
            on = nxt > 0
            pos = pos + on
            here = np.where(on, self.node_token[nxt], -1)
            token = np.where(here >= 0, here, token)
            token_end = np.where(here >= 0, pos, token_end)
            node = nxt
            stop = ~on
            if stop.any():  # the longest match is known: start again behind it
                out_word.append(word[stop])
                out_pos.append(token_end[stop])
                out_token.append(token[stop])
                pos = np.where(stop, token_end, pos)
                keep = ~stop | (token_end < end)
                word, pos, end, node, token, token_end = word[keep], pos[keep], end[keep], node[keep], np.where(stop, -1, token)[keep], token_end[keep]
        if not out_word:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        w, p, t = map(np.concatenate, (out_word, out_pos, out_token))
        order = np.argsort(p, kind="stable")
        return t[order], w[order]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers."""
        out = [b""] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        for i in (i for i, w in enumerate(words) if len(w) > LONG_WORD):
            out[i] = np.array(self.merge(words[i]), "<u4").tobytes()
        tokens, owner = self.propose([words[i] for i in short])
        same = owner[1:] == owner[:-1]
        keys, where = np.unique(tokens[:-1][same] * self.size + tokens[1:][same], return_inverse=True)
        failing = np.zeros(len(short), bool)
        failing[owner[1:][same][~self._verified(keys)[where]]] = True
        starts = np.searchsorted(owner, np.arange(len(short) + 1)).tolist()
        raw = tokens.astype("<u4").tobytes()
        for k, i in enumerate(short):
            out[i] = raw[4 * starts[k] : 4 * starts[k + 1]]
        again = [short[k] for k in np.flatnonzero(failing).tolist()]
        for i, ids in zip(again, self.merge_all([words[i] for i in again]), strict=True):
            out[i] = ids
        return out

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Exact merging of many short words at once: in each round, each word's earliest, leftmost pair merges."""
        if not words:
            return []
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        ids = self.base[np.frombuffer(b"".join(words), np.uint8)]
        last = np.append(word[1:] != word[:-1], True)
        rank = np.full(len(ids), self.size, np.int64)  # of the pair that starts here
        at = np.flatnonzero(~last)
        rank[at] = self.merged(ids[at], ids[at + 1])
        done_word, done_pos, done_ids = [], [], []
        place = np.arange(len(ids))
        while len(ids):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            # rank and place in one number: its minimum is the earliest pair, the leftmost of equal ones
            best = np.minimum.reduceat(rank * len(ids) + np.arange(len(ids)), first)
            low, at = best // len(ids), best % len(ids)
            over = low >= self.size
            if over.any():
                gone = np.repeat(over, np.diff(np.append(first, len(ids))))
                done_word.append(word[gone])
                done_pos.append(place[gone])
                done_ids.append(ids[gone])
            else:
                gone = np.zeros(len(ids), bool)
            at, low = at[~over], low[~over]
            ids[at] = low
            last[at] |= last[at + 1]
            gone[at + 1] = True
            kept = ~gone
            moved = np.cumsum(kept) - 1
            at = moved[at]
            word, ids, last, rank, place = word[kept], ids[kept], last[kept], rank[kept], place[kept]
            rank[at] = self.size
            changed = np.concatenate([at, at[at > 0] - 1])
            changed = changed[~last[changed]]
            rank[changed] = self.merged(ids[changed], ids[changed + 1])
        order = np.argsort(np.concatenate(done_pos))
        owner, flat = np.concatenate(done_word)[order], np.concatenate(done_ids)[order].astype("<u4").tobytes()
        ends = (4 * np.searchsorted(owner, np.arange(len(words) + 1))).tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]

    def _verified(self, keys: np.ndarray) -> np.ndarray:
        listed = keys.tolist()
        new = np.array([k for k in listed if k not in self.verdicts], np.int64)
        if len(new):
            if len(self.verdicts) + len(new) > 1_000_000:
                self.verdicts.clear()
                new = keys
            self.verdicts.update(zip(new.tolist(), self.compatible(new // self.size, new % self.size).tolist(), strict=True))
        return np.fromiter((self.verdicts[k] for k in listed), bool, len(listed))

    def merge(self, word: bytes) -> list[int]:
        """Exact merging of one long word: the earliest merge first, the leftmost of equal ones."""
        ids = self.base[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        rank = self.rank
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, j = heapq.heappop(heap)
            if ids[i] < 0 or after[i] != j or rank.get((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                prior[k] = i
                if (x := rank.get((r, ids[k]))) is not None:
                    heapq.heappush(heap, (x, i, k))
            if (h := prior[i]) >= 0 and (x := rank.get((ids[h], r))) is not None:
                heapq.heappush(heap, (x, h, i))
        return [x for x in ids if x >= 0]


class Encoder:
    """Texts to ids and back, for one worker process."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.chunks: dict[str, bytes] = {}
        self.held = 0

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        cut = [list(self._chunks(t or "")) for t in texts]
        new = self._learn({c for parts in cut for kind, cs in parts if not kind for c in cs})
        known = self.chunks
        ids = [b"".join(cs if kind else b"".join(map(known.__getitem__, cs)) for kind, cs in parts) for parts in cut]
        self._forget(new)
        return ids

    def _chunks(self, text: str) -> Iterator[tuple[bool, bytes | list[str]]]:
        """Parts of the text: (True, ids of a special token) or (False, chunks)."""
        at = 0
        for m in self.special.finditer(text) if self.special and any(s in text for s in self.vocabulary.special) else ():
            yield False, self._split(text[at : m.start()])
            yield True, self.vocabulary.special[m[0]].to_bytes(4, "little")
            at = m.end()
        yield False, self._split(text[at:] if at else text)

    def _split(self, text: str) -> list[str]:
        """Chunks that start where a word surely starts."""
        if not text:
            return []
        if text[0] == " " or text[-1] == " " or any(x in text for x in _ODD_ASCII) or not text.isascii() and any(x in text for x in _ODD_OTHERS):
            return self.pattern.findall(text)
        first, *others = text.split(" ")
        return [first, *[" " + c for c in others]]

    def _learn(self, wanted: Iterable[str]) -> list[str]:
        """Put the ids of all wanted chunks into the cache; the chunks that it didn't know."""
        new = [c for c in wanted if c not in self.chunks]
        if new:
            words = [self.pattern.findall(c) for c in new]
            distinct = list({w: None for ws in words for w in ws})
            ids = dict(zip(distinct, self.vocabulary.encode_words([w.encode() for w in distinct]), strict=True))
            self.chunks.update((c, b"".join(map(ids.__getitem__, ws)) if len(ws) > 1 else ids[ws[0]]) for c, ws in zip(new, words, strict=True))
        return new

    def _forget(self, new: list[str]) -> None:
        """Long chunks leave the cache, and all once it holds too many or too many bytes."""
        for c in new:
            if len(c) > LONG_CHUNK:
                del self.chunks[c]
            else:
                self.held += sys.getsizeof(c) + sys.getsizeof(self.chunks[c]) + ENTRY_BYTES
        if len(self.chunks) > CACHE_ENTRIES or self.held > CACHE_BYTES:
            self.chunks.clear()
            self.held = 0

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _put(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with a column at its end, in place of one of that name."""
    keep = [n for n in batch.schema.names if n.lower() != name]
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(n)) for n in keep), values], names=[*keep, name])


def _encode(batch: pa.RecordBatch, path: str) -> pa.RecordBatch:
    raw = encoder(path).encode(batch.column(batch.schema.names.index("text")).to_pylist())
    offsets = np.cumsum([0, *(len(r) // 4 for r in raw)]).astype(np.int32)
    return _put(batch, "ids", pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int32))))


def _decode(batch: pa.RecordBatch, path: str) -> pa.RecordBatch:
    ids = batch.column(batch.schema.names.index("ids"))
    return _put(batch, "decoded", pa.array([encoder(path).decode(np.asarray(x.values)) if x.is_valid else None for x in ids], pa.string()))


def _with(df: DataFrame, name: str, kind: DataType) -> StructType:
    return StructType([f for f in df.schema if f.name.lower() != name] + [StructField(name, kind)])


def encode_texts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The rows with ``ids``, an array of int, from their ``text``; a column of that name is replaced."""
    return map_batches(docs, functools.partial(_encode, path=tokenizer), _with(docs, "ids", ArrayType(IntegerType())))


def decode_ids(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """The rows with ``decoded``, the text of their ``ids``; a column of that name is replaced."""
    return map_batches(tokens, functools.partial(_decode, path=tokenizer), _with(tokens, "decoded", StringType()))


def _digests(batch: pa.RecordBatch, path: str) -> dict:
    """Encoding, decoding and their digests in one pass, so that ids don't travel between processes."""
    e = encoder(path)
    raw = e.encode(batch.column(1).to_pylist())
    return {
        "doc_id": batch.column(0),
        "n_tokens": [len(r) // 4 for r in raw],
        "ids_sha256": [hashlib.sha256(r).hexdigest() for r in raw],
        "decoded_sha256": [hashlib.sha256(e.decode(np.frombuffer(r, "<u4")).encode()).hexdigest() for r in raw],
    }


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(docs, functools.partial(_digests, path=path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
