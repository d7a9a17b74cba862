"""Encoding of a corpus with a public byte-level BPE tokenizer.

The split into pieces is the tokenizer's own pattern; the merges of all pieces of a batch that are new to
the worker run together: pieces of about the same length form a padded numpy matrix, and in every round
each row merges its leftmost pair of minimum rank. Ranks come from a hash table of id pairs; rows that are
done leave the matrix.
"""

from __future__ import annotations

import base64
import heapq
import os
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The byte-level split of the vocabularies: contractions, words, numbers, other signs, white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer pieces are merged with a heap instead of a matrix (same result, less than quadratic time).
MATRIX_BYTES = 128
#: Pieces a worker remembers at most, and bytes of a piece that is remembered.
MEMORY, MEMORY_BYTES = 500_000, 64
_EMPTY, _NONE = np.int64(-1), np.int32(2**31 - 1)


class PairTable:
    """(left id, right id) -> id of the merged token, as an open hash table in numpy arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(len(keys) * 3 + 1))))
        self.keys = np.full(1 << self.bits, _EMPTY)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        left, slot, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(left):
            self.probes += 1
            place = (slot[left] + self.probes - 1) & ((1 << self.bits) - 1)
            free = self.keys[place] == _EMPTY
            _, first = np.unique(np.where(free, place, -1 - np.arange(len(place))), return_index=True)
            take = first[free[first]]
            self.keys[place[take]] = keys[left[take]]
            self.values[place[take]] = values[left[take]]
            left = np.delete(left, take)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(keys.shape, _NONE, np.int32)
        flat, res = keys.ravel(), out.ravel()
        live, slot = np.arange(len(flat)), self._slot(flat)
        for probe in range(self.probes):
            place = (slot[live] + probe) & ((1 << self.bits) - 1)
            seen = self.keys[place]
            hit = seen == flat[live]
            res[live[hit]] = self.values[place[hit]]
            live = live[~hit & (seen != _EMPTY)]
            if not len(live):
                break
        return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.stride = np.int64(max(ranks.values()) + 1)
        keys, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a * int(self.stride) + b)
                    values.append(rank)
        self.pairs = PairTable(np.array(keys, np.int64), np.array(values, np.int32))
        self.known: dict[str, array] = {}

    @classmethod
    def from_file(cls, path: str) -> Encoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def _matrix(self, pieces: list[bytes]) -> list[array]:
        """The ids of pieces of similar length, all rows at once."""
        n, width = len(pieces), max(map(len, pieces))
        ids = np.full((n, width + 1), -1, np.int64)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        inside = np.arange(width + 1)[None, :] < lengths[:, None]
        ids[inside] = self.byte_ids[flat]
        out: list[array] = [array("i")] * n
        rows = np.arange(n)

        def leave(done: np.ndarray) -> None:
            for r in np.flatnonzero(done):
                out[rows[r]] = array("i", ids[r, : lengths[r]].astype(np.int32).tobytes())

        while len(rows):
            left, right = ids[:, :-1], ids[:, 1:]
            ranks = np.where(right >= 0, self.pairs.get(np.where(right >= 0, left * self.stride + right, -2)), _NONE)
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            done = best == _NONE
            if done.any():
                leave(done)
                keep = ~done
                rows, ids, lengths, at, best = rows[keep], ids[keep], lengths[keep], at[keep], best[keep]
                if not len(rows):
                    break
            columns = np.arange(ids.shape[1])[None, :]
            moved = np.concatenate([ids[:, 1:], np.full((len(rows), 1), -1, np.int64)], axis=1)
            ids = np.where(columns > at[:, None], moved, ids)
            ids[np.arange(len(rows)), at] = best
            lengths = lengths - 1
            ids = ids[:, : int(lengths.max()) + 1]
        return out

    def _heap(self, piece: bytes) -> array:
        """The ids of one long piece: a heap of pairs by rank and place over a linked list."""
        ids = [int(self.byte_ids[b]) for b in piece]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(ids))) + [-1], [-1, *range(len(ids) - 1)]
        rank = lambda i: self.ranks.get(parts[i] + parts[after[i]]) if after[i] >= 0 else None
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(len(ids) - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], ids[i], parts[j] = a + b, r, b""
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (new := rank(k)) is not None:
                    heapq.heappush(heap, (new, k, parts[k], parts[after[k]]))
        return array("i", (ids[i] for i in range(len(ids)) if parts[i]))

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts; a null or empty text has no ids."""
        split = [self.split(t) if t else [] for t in texts]
        if len(self.known) > MEMORY:
            self.known.clear()
        fresh = {p for pieces in split for p in pieces if p not in self.known}
        now: dict[str, array] = {}
        buckets: dict[int, list[tuple[str, bytes]]] = defaultdict(list)
        for p in fresh:
            raw = p.encode("utf-8", "replace")
            if (whole := self.ranks.get(raw)) is not None:
                now[p] = array("i", [whole])
            elif len(raw) > MATRIX_BYTES:
                now[p] = self._heap(raw)
            else:
                buckets[len(raw).bit_length() * 4 + (len(raw) * 8 >> len(raw).bit_length()) % 4].append((p, raw))
        for group in buckets.values():
            for i in range(0, len(group), 4096):
                part = group[i : i + 4096]
                now.update(zip((p for p, _ in part), self._matrix([raw for _, raw in part])))
        memory = self.known
        memory.update((p, ids) for p, ids in now.items() if len(p) <= MEMORY_BYTES)
        flat, offsets = array("i"), [0]
        for pieces in split:
            for p in pieces:
                flat += memory.get(p) or now[p]
            offsets.append(len(flat))
        return np.array(offsets, np.int32), np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32)


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The place of a vocabulary file: $TRACEMILL_TOKENIZERS, the installed public_tokenizers, or /opt/tokenizers."""
    if folder := os.environ.get("TRACEMILL_TOKENIZERS"):
        return os.path.join(folder, name)
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


_ENCODERS: dict[str, Encoder] = {}


def encode_corpus(documents: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids): one row for every row of ``documents`` with the ids of its whole text, without special
    tokens; strings of special tokens in a text are ordinary text.

    A null or empty text has an empty list. Repeated rows stay repeated; other columns are ignored; a null
    id stays null; an empty table gives no rows. ``path`` names the vocabulary file on every worker (default:
    ``tokenizer_path()`` evaluated there). Narrow: no shuffle.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = path or tokenizer_path()
        if place not in _ENCODERS:
            _ENCODERS[place] = Encoder.from_file(place)
        encoder = _ENCODERS[place]
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                offsets, ids = encoder.encode_batch(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    kind = documents.schema[id_column].dataType.simpleString()
    return documents.select(id_column, text_column).mapInArrow(encode, f"doc_id {kind}, ids array<int>")
