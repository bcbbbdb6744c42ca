"""Problem 6: encoding of a whole corpus with a public byte-level BPE vocabulary.

Texts are cut by the vocabulary's pre-token pattern. The distinct pre-tokens a
worker has not met before are encoded together: they are bucketed by byte
length into padded id matrices, and in every round each row merges its leftmost
pair of minimum rank, found by one hashed lookup of all pairs of the matrix,
after which the rows are compacted. Rows that have no pair left leave the
matrix. The work of a batch is thus a few dozen numpy passes, not a Python loop
per token.

Defined cases: a null and an empty text both give an empty list; strings that
look like special tokens are ordinary text; a text is never normalised; one
output row per input row (repeated rows stay repeated); an empty table gives an
empty table.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import spread, table

#: Where the vocabulary file lies; a parameter of every function that needs it.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-token pattern that belongs to that vocabulary (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens of more bytes take the heap path: the matrix rounds would be quadratic in the length.
MATRIX_BYTES = 256
#: Distinct pre-tokens remembered per worker; the memory is cleared when full, results never change.
CACHE_TOKENS = 400_000

_NONE = np.int64(1 << 40)


class Vocabulary:
    """Ranks of a byte-level BPE and the hash table of its mergeable pairs."""

    def __init__(self, path: str = DEFAULT_VOCABULARY):
        ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    a, b = line.split()
                    ranks[base64.b64decode(a)] = int(b)
        self.ranks = ranks
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append((a << 20) | b)
                    values.append(rank)
        self.pairs = dict(zip(keys, values, strict=True))
        self._build(np.array(keys, dtype=np.int64), np.array(values, dtype=np.int64))
        self.pattern = regex.compile(PATTERN)
        self._cache: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self._cache.clear()
        self._ids: list[np.ndarray] = []
        self._n = np.zeros(0, dtype=np.int64)
        self._at = np.zeros(0, dtype=np.int64)
        self._flat = np.zeros(0, dtype=np.int32)

    # -- hashed pair lookup ------------------------------------------------
    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with linear probing, filled by whole-array rounds."""
        bits = max(10, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slot_key = np.full(1 << bits, -1, dtype=np.int64)
        self.slot_value = np.full(1 << bits, _NONE, dtype=np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = left[self.slot_key[at[left]] == -1]
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.slot_key[at[won]], self.slot_value[at[won]] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Rank of the merged pair of each key, _NONE where the pair does not merge."""
        flat = keys.ravel()
        out = np.full(flat.shape, _NONE, dtype=np.int64)
        at = self._slot(flat)
        live = np.flatnonzero(flat >= 0)
        while len(live):
            found = self.slot_key[at[live]]
            hit = found == flat[live]
            out[live[hit]] = self.slot_value[at[live[hit]]]
            live = live[~hit & (found != -1)]
            at[live] = (at[live] + 1) & self.mask
        return out.reshape(keys.shape)

    # -- encoding of pre-tokens --------------------------------------------
    def _matrix(self, words: list[bytes]) -> list[np.ndarray]:
        """All words have lengths of one bucket; one matrix, merged round by round."""
        width = max(map(len, words))
        ids = np.full((len(words), width), -1, dtype=np.int64)
        length = np.array([len(w) for w in words])
        filled = np.arange(width)[None, :] < length[:, None]
        ids[filled] = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        out: list[np.ndarray | None] = [None] * len(words)
        row = np.arange(len(words))
        while True:
            if ids.shape[1] > 1:
                a, b = ids[:, :-1], ids[:, 1:]
                rank = self.lookup(np.where(b >= 0, (a << 20) | b, -1))
                where = rank.argmin(axis=1)  # the first, so the leftmost
                best = rank[np.arange(len(row)), where]
            else:
                best, where = np.full(len(row), _NONE), np.zeros(len(row), dtype=np.int64)
            done = best == _NONE
            for k in np.flatnonzero(done):
                out[row[k]] = ids[k, : length[k]].astype(np.int32)
            if done.all():
                return out  # type: ignore[return-value]
            keep = ~done
            ids, row, length, where, best = ids[keep], row[keep], length[keep] - 1, where[keep], best[keep]
            # compaction: the merged id takes the place of the pair, the rest moves one to the left
            column = np.arange(ids.shape[1] - 1)[None, :]
            moved = np.where(column > where[:, None], ids[:, 1:], ids[:, :-1])
            moved[np.arange(len(row)), where] = best
            ids = moved[:, : length.max()]

    def _long(self, word: bytes) -> np.ndarray:
        """The same merges for one long pre-token, by a heap over a linked list."""
        ids = [int(self.byte_id[b]) for b in word]
        n, pairs = len(ids), self.pairs
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get((ids[i] << 20) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = r, False
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for p, q in ((prv[i], i), (i, nxt[i])):
                if p >= 0 and q < n and (m := pairs.get((ids[p] << 20) | ids[q])) is not None:
                    heapq.heappush(heap, (m, p, ids[p], ids[q]))
        return np.array([x for x, k in zip(ids, alive, strict=True) if k], dtype=np.int32)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        buckets: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if not w:
                out[k] = np.zeros(0, dtype=np.int32)
            elif len(w) > MATRIX_BYTES:
                out[k] = self._long(w)
            else:
                buckets.setdefault((len(w) - 1).bit_length() if len(w) > 8 else len(w) - 64, []).append(k)
        for members in buckets.values():
            step = max(1, 400_000 // max(len(words[k]) for k in members))
            for s in range(0, len(members), step):
                part = members[s : s + step]
                for k, ids in zip(part, self._matrix([words[k] for k in part]), strict=True):
                    out[k] = ids
        return out

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all texts: the layout of an Arrow list column."""
        if len(self._cache) > CACHE_TOKENS:
            self._reset()
        find, cache = self.pattern.findall, self._cache
        codes, counts, new = [], [], []
        for text in texts:
            pieces = find(text) if text else []
            counts.append(len(pieces))
            for p in pieces:
                c = cache.get(p)
                if c is None:
                    c = cache[p] = len(cache)
                    new.append(p)
                codes.append(c)
        if new:
            made = self.encode_words([p.encode("utf-8", "surrogatepass") for p in new])
            self._n = np.concatenate([self._n, [len(m) for m in made]]).astype(np.int64)
            self._at = np.cumsum(self._n) - self._n
            self._flat = np.concatenate([self._flat, *made])
        code = np.array(codes, dtype=np.int64)
        n = self._n[code] if len(code) else np.zeros(0, dtype=np.int64)
        ends = np.cumsum(n)
        take = np.repeat(self._at[code] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0) if len(code) else np.zeros(0, dtype=np.int64)
        bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        offsets = np.concatenate([[0], ends])[bounds].astype(np.int32)
        return offsets, self._flat[take]


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker process and path."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode(df: DataFrame, text: str = "text", key: str = "doc_id", vocabulary_path: str = DEFAULT_VOCABULARY, batch: int = 1000) -> DataFrame:
    """(key, ids ARRAY<INT>) of every row; see the module's text for the defined cases."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocabulary_path)
        for b in batches:
            for s in range(0, b.num_rows, batch):
                part = b.slice(s, batch)
                offsets, ids = v.encode_batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], names=[key, "ids"])

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {key_type}, ids array<int>")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def p6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and characters per source: what the corpus costs to train on."""
    from pyspark.sql import functions as F

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    ids = encode(docs).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"))
    return docs.select("doc_id", "source").join(ids, "doc_id").groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))


QUERIES = {"p6_ids": p6_ids, "p6_token_counts": p6_token_counts}
ORACLES: dict[str, str] = {}
