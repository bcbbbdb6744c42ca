"""Problem 7: evaluation texts leaking into training text.

Candidates come from a size-partitioned MinHash containment search. Each test
item is cut into short overlapping segments; each document is cut into windows
of at most `WINDOW` word shingles, partitioned by size, and the number of bands
of a partition follows from its upper size bound so that a contained segment is
met with the wanted probability. A document whose window agrees with an item's
segment in any band is verified by exact shingle containment: runs of shared
shingles are chained over single changed words and foreign lines, and the chain
must cover 20 words of the item's passage or more than half of the lines of its
solution.

Words are compared after folding letter case, accents, compatibility forms,
zero-width characters, markup, escapes and line prefixes.

Defined cases: null and blank texts match nothing; an item with null prompt or
solution is searched by the part it has; parts shorter than the wanted number
of words must be there whole; repeated rows give one pair; an empty table on
either side gives an empty result. Scale: documents are read in one pass. The
items, a stated query set, are handed to the executors up to `ITEM_BLOCK` of
them; more are joined with the documents' windows on their band values.
"""

from __future__ import annotations

import functools
import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialize, spread, table

#: Words of a shingle; items are short and may have single changed words, so shingles are too.
SHINGLE = 3
#: Shingles per document window, their step (a segment lies whole in a window), words per item segment, their step.
WINDOW, STEP, SEGMENT, SEGMENT_STEP = 36, 18, 20, 5
#: Shared shingles that the search must not miss, and the chance of missing a single segment that has them.
SHARED, MISS = 10, 1e-3
#: Upper size bounds of the partitions of windows.
PARTITIONS = (12, 24, WINDOW)
#: Words of a passage that make a case.
PASSAGE_WORDS = 20
#: Items whose index is handed to the executors; more are joined on their band values.
ITEM_BLOCK = 5000

#: Costs of chaining: a changed word or foreign line between two runs costs as much as so many words.
GAP_COST, GAP_ITEM, GAP_DOC = 4, 1, 60
#: At most one gap in so many words of a passage, and the exact shingles that a candidate for a solution must share.
GAP_EVERY, LEAST_SHARED = 10, 7

_PRIME = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@functools.cache
def bands(upper: int) -> int:
    """Bands of one row that find a segment with SHARED shingles in a window of `upper`, but for a chance of MISS."""
    jaccard = SHARED / (upper + SEGMENT - SHINGLE + 1 - SHARED)
    return math.ceil(math.log(MISS) / math.log(1 - jaccard))


N_BANDS = bands(WINDOW)
_MULTIPLIERS = np.array([xxhash.xxh32_intdigest(f"band {j}") | 1 for j in range(N_BANDS)], dtype=np.uint32)

_INVISIBLE = re.compile("[­᠎​-‏‪-‮⁠-⁤﻿]")
_INLINE = re.compile(r"</?(?:a|b|i|u|s|em|strong|span|code|tt|mark|small|sub|sup|kbd|font|abbr|wbr)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|[nrt\"'/\\])")
_HYPHEN = re.compile(r"([^\W\d_])-[ \t]*\r?\n[ \t>#/*|+-]*([^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Text with all differences of form removed that leave the words recognisable."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _INVISIBLE.sub("", text))
        text = "".join(c for c in text if not unicodedata.combining(c))
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m.group(1), 16)) if m.group(1) else " ", text)
    if "-\n" in text or "-\r\n" in text:
        text = _HYPHEN.sub(r"\1\2", text)
    return text.lower()


def words(text: str) -> list[str]:
    return _WORD.findall(fold(text))


_cache: dict[str, int] = {}


def shingles(tokens: list[str], k: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the k-word shingles in order; a text shorter than k has none."""
    if len(tokens) < k:
        return np.zeros(0, dtype=np.uint64)
    if len(_cache) > 1_000_000:
        _cache.clear()
    get, make = _cache.get, xxhash.xxh64_intdigest
    ids = []
    for t in tokens:
        h = get(t)
        if h is None:
            h = _cache[t] = make(t)
        ids.append(h)
    w = np.array(ids, dtype=np.uint64)
    n = len(w) - k + 1
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = (h ^ w[j : j + n]) * _PRIME[j % 3]
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Part:
    """One searchable part of an item: its passage or its solution."""

    item_id: int
    solution: bool
    tokens: list[str]
    line_of: list[int] = field(default_factory=list)
    n_lines: int = 0


def instruction(items: DataFrame) -> str:
    """The opening paragraph that more than half of the prompts share, else an empty text."""
    head = F.when(F.col("prompt").contains("\n\n"), F.split("prompt", "\n\n", 2)[0])
    found = items.where("prompt is not null").groupBy(head.alias("head")).agg(F.count("*").alias("n"))
    total = found.agg(F.sum("n")).first()[0] or 0
    top = found.where("head is not null").orderBy(F.desc("n"), "head").first()
    return top["head"] if top and top["n"] * 2 > total else ""


def parts_of(items: list[tuple], common: str) -> list[Part]:
    out = []
    for item_id, prompt, solution in items:
        if prompt:
            own = prompt[len(common) :] if common and prompt.startswith(common) else prompt
            t = words(own)
            if len(t) >= SHINGLE:
                out.append(Part(item_id, False, t))
        if solution:
            t, line_of, n = [], [], 0
            for line in solution.split("\n"):
                w = words(line)
                if w:
                    t += w
                    line_of += [n] * len(w)
                    n += 1
            if len(t) >= SHINGLE:
                out.append(Part(item_id, True, t, line_of, n))
    return out


def _runs(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... n[0] numbers, then those of begin[1] and so on."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())


def least_shared(part: Part, h: np.ndarray) -> int:
    """Distinct shingles that any text with a case of the part has in common with it.

    A passage of PASSAGE_WORDS with the gaps that GAP_EVERY allows lacks SHINGLE - 1 + GAP_ITEM shingles
    for each of them; what the passage repeats is one.
    """
    if part.solution:
        return min(LEAST_SHARED, len(np.unique(h)))
    n = min(PASSAGE_WORDS, len(part.tokens))
    windows = [len(set(h[s : s + n - SHINGLE + 1].tolist())) for s in range(len(part.tokens) - n + 1)]
    return max(min(windows) - n // GAP_EVERY * (SHINGLE - 1 + GAP_ITEM), 1)


class Index:
    """Band values of all segments of the items' parts, and the parts of every shingle."""

    def __init__(self, parts: list[Part]):
        self.parts = parts
        self.hashes = [shingles(p.tokens) for p in parts]
        own, segments = [], []
        for k, h in enumerate(self.hashes):
            size = SEGMENT - SHINGLE + 1
            for s in sorted({*range(0, max(len(h) - size, 0) + 1, SEGMENT_STEP), max(len(h) - size, 0)}):
                own.append(k)
                segments.append(h[s : s + size])
        self.owner = np.array(own, dtype=np.int64)
        low = np.concatenate(segments).astype(np.uint32) if own else np.zeros(0, dtype=np.uint32)
        begin = np.cumsum([0] + [len(x) for x in segments])[:-1]
        self.sorted, self.sorted_owner = [], []
        for m in _MULTIPLIERS if own else []:
            v = np.minimum.reduceat(low * m, begin)
            order = np.argsort(v, kind="stable")
            self.sorted.append(v[order])
            self.sorted_owner.append(self.owner[order])
        distinct = [np.unique(h) for h in self.hashes]
        self.least = np.array([least_shared(p, h) for p, h in zip(parts, self.hashes, strict=True)], dtype=np.int64)
        flat = np.concatenate(distinct) if parts else np.zeros(0, dtype=np.uint64)
        of = np.repeat(np.arange(len(parts)), [len(h) for h in distinct])
        order = np.argsort(flat, kind="stable")
        self.shingle, first = np.unique(flat[order], return_index=True)
        self.part_of, self.first = of[order], np.append(first, len(flat))

    def candidates(self, hashes: list[np.ndarray]) -> np.ndarray:
        """Sorted numbers document * parts + part of all documents of a batch with an agreeing band."""
        n = np.array([len(h) for h in hashes])
        live = np.flatnonzero(n)
        if not len(self.owner) or not len(live):
            return np.zeros(0, dtype=np.int64)
        flat = np.concatenate([hashes[d] for d in live]).astype(np.uint32)
        n = n[live]
        first = np.cumsum(n) - n
        blocks = -(-n // STEP)
        doc = np.repeat(live, blocks)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin, size = number * STEP, np.minimum(np.repeat(n, blocks) - number * STEP, STEP)
        # one column a block; a short one repeats its last shingle
        table = flat[np.repeat(first, blocks) + begin + np.minimum(np.arange(STEP)[:, None], size - 1)]
        # a window is a block and the next of the same document; the last block of a longer document has its window already
        paired = np.append(doc[1:] == doc[:-1], False)
        window = np.flatnonzero(paired | (number == 0))
        length = size[window] + np.where(paired[window], np.append(size[1:], 0)[window], 0)
        wanted = np.array([bands(u) for u in PARTITIONS])[np.searchsorted(PARTITIONS, length)]
        found = []
        for j in range(N_BANDS):
            at = window[wanted > j]
            m = (table * _MULTIPLIERS[j]).min(axis=0)
            v = np.where(paired[at], np.minimum(m[at], np.append(m[1:], 0)[at]), m[at])
            lo, hi = np.searchsorted(self.sorted[j], v, "left"), np.searchsorted(self.sorted[j], v, "right")
            hit = np.flatnonzero(hi > lo)
            if len(hit):
                many = hi[hit] - lo[hit]
                found.append(np.repeat(doc[at[hit]], many) * len(self.parts) + self.sorted_owner[j][_runs(lo[hit], many)])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)

    def contained(self, hashes: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
        """Those of `pairs` whose document has at least LEAST_SHARED distinct shingles of the part, or all of a shorter one."""
        if not len(pairs):
            return pairs
        docs = np.unique(pairs // len(self.parts))
        h = [np.unique(hashes[d]) for d in docs]
        flat, who = np.concatenate(h), np.repeat(docs, [len(x) for x in h])
        at = np.minimum(np.searchsorted(self.shingle, flat), len(self.shingle) - 1)
        hit = self.shingle[at] == flat
        at, who = at[hit], who[hit]
        many = self.first[at + 1] - self.first[at]
        key = np.repeat(who, many) * len(self.parts) + self.part_of[_runs(self.first[at], many)]
        key, count = np.unique(key, return_counts=True)
        enough = key[count >= self.least[key % len(self.parts)]]
        return pairs[np.isin(pairs, enough, assume_unique=True)]


def band_values(h: np.ndarray, size: int, step: int) -> set[tuple[int, int]]:
    """(band, value) of every window of `size` shingles each `step`, the last one whole; a window of more
    shingles has more bands, and those of a partition are the first of all."""
    out: set[tuple[int, int]] = set()
    if not len(h):
        return out
    low = h.astype(np.uint32)
    begin = sorted({*range(0, max(len(h) - size, 0) + 1, step), max(len(h) - size, 0)})
    n = bands(next(u for u in PARTITIONS if min(len(h), size) <= u)) if size == WINDOW else N_BANDS
    for j, m in enumerate(_MULTIPLIERS[:n]):
        v = low * m
        out |= {(j, int(v[s : s + size].min())) for s in begin}
    return out


def shared_runs(doc: list[str], hashes: np.ndarray, part: Part, own: np.ndarray) -> list[list[int]]:
    """Maximal runs [document begin, part begin, length] of words that both have, of at least a shingle."""
    order = np.argsort(own, kind="stable")
    lo, hi = np.searchsorted(own[order], hashes, "left"), np.searchsorted(own[order], hashes, "right")
    at = np.flatnonzero(hi > lo)
    many = hi[at] - lo[at]
    j = np.repeat(at, many)
    i = order[_runs(lo[at], many)] if len(at) else j
    runs = []
    order = np.lexsort((j, j - i))
    j, i = j[order].tolist(), i[order].tolist()
    for a, b in zip(j, i, strict=True):
        if doc[a : a + SHINGLE] != part.tokens[b : b + SHINGLE]:
            continue  # a hash in common only
        if runs and runs[-1][0] - runs[-1][1] == a - b and runs[-1][0] + runs[-1][2] - SHINGLE + 1 == a:
            runs[-1][2] += 1
        else:
            runs.append([a, b, SHINGLE])
    return sorted(runs)


def best_chain(runs: list[list[int]]) -> list[list[int]]:
    """The best chain of runs, in order."""
    best, score, back = -1, [0] * len(runs), [-1] * len(runs)
    longest = max((r[2] for r in runs), default=0)
    for b, (jb, ib, nb) in enumerate(runs):
        score[b] = nb
        for a in range(b - 1, -1, -1):
            ja, ia, na = runs[a]
            if jb - ja > GAP_DOC + longest:
                break
            gap_i, gap_j = ib - (ia + na), jb - (ja + na)
            over = max(-gap_i, -gap_j, 0)  # a repeated word may belong to both runs
            if gap_i <= GAP_ITEM and gap_j <= GAP_DOC and over < SHINGLE and ib > ia and jb > ja:
                s = score[a] + nb - over - GAP_COST
                if s > score[b]:
                    score[b], back[b] = s, a
        if best < 0 or score[b] > score[best]:
            best = b
    out = []
    while best >= 0:
        out.append(runs[best])
        best = back[best]
    return out[::-1]


def beyond(doc: list[str], words: list[str], j: int, i: int, step: int) -> int:
    """Words of the part behind a changed one at an end of a chain, the changed one included, where text and part agree again."""
    for gap_j, gap_i in ((1, 1), (1, 0), (0, 1)):  # changed, put in, left out
        n = 0
        while 0 <= (a := j + step * (gap_j + n)) < len(doc) and 0 <= (b := i + step * (gap_i + n)) < len(words) and doc[a] == words[b]:
            n += 1
        if n:
            return n + gap_i
    return 0


def leaked(doc: list[str], hashes: np.ndarray, part: Part, own: np.ndarray) -> bool:
    """Exact verification of one candidate."""
    chain = best_chain(shared_runs(doc, hashes, part, own))
    if not chain:
        return False
    begin, end = chain[0][1], chain[-1][1] + chain[-1][2]
    if not part.solution:
        gaps, least = len(chain) - 1, min(PASSAGE_WORDS, len(part.tokens))
        if end - begin < least:  # a changed word near an end hides the fewer than SHINGLE words behind it
            more = beyond(doc, part.tokens, chain[0][0] - 1, begin - 1, -1), beyond(doc, part.tokens, chain[-1][0] + chain[-1][2], end, 1)
            begin, end, gaps = begin - more[0], end + more[1], gaps + (more[0] > 0) + (more[1] > 0)
        return end - begin >= least and gaps * GAP_EVERY <= end - begin
    seen = Counter(part.line_of[i] for i in range(begin, end))
    size = Counter(part.line_of)
    whole = sum(2 * seen[line] > size[line] for line in seen)
    return 2 * whole > part.n_lines


def search(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", block: int = ITEM_BLOCK) -> DataFrame:
    """(key, item_id) of every document that contains passages of an item.

    Up to `block` items, the index of all segments is handed to the executors. More items are
    joined with the documents' windows on their band values. Documents are read in one pass
    either way, and the result is the same.
    """
    wanted = items.where("item_id is not null").select("item_id", "prompt", "solution")
    head = instruction(wanted)
    docs = spread(documents.select(key, text))
    few = wanted.take(block + 1)
    found = _searched(docs, [tuple(r) for r in few], head) if len(few) <= block else _joined(docs, wanted, head)
    return found.distinct()


def _searched(docs: DataFrame, items: list[tuple], head: str) -> DataFrame:
    """Candidates from an index in every task."""
    key, kind = docs.columns[0], docs.schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(parts_of(items, head))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        for b in batches:
            for s in range(0, b.num_rows, 2000):
                piece = b.slice(s, 2000)
                tokens = [words(t) if t else [] for t in piece.column(1).to_pylist()]
                hashes = [shingles(t) for t in tokens]
                d, p = np.divmod(index.contained(hashes, index.candidates(hashes)), max(len(index.parts), 1))
                hit = [(x, index.parts[y].item_id) for x, y in zip(d.tolist(), p.tolist(), strict=True) if leaked(tokens[x], hashes[x], index.parts[y], index.hashes[y])]
                if hit:
                    at, ids = zip(*sorted(set(hit)), strict=True)
                    yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(at)), pa.array(ids, pa.int64())], names=[key, "item_id"])

    return docs.mapInArrow(run, f"`{key}` {kind}, item_id bigint")


def _joined(docs: DataFrame, items: DataFrame, head: str) -> DataFrame:
    """Candidates from a join on the band values; only texts of candidates are shuffled."""
    key, kind = docs.columns[0], docs.schema[0].dataType.simpleString()

    def windows(cols: dict[str, list]) -> Iterator[tuple]:
        for k, t in zip(cols[key], cols["text"], strict=True):
            yield from ((k, j, v) for j, v in sorted(band_values(shingles(words(t)), WINDOW, STEP) if t else ()))

    def segments(cols: dict[str, list]) -> Iterator[tuple]:
        for row in zip(cols["item_id"], cols["prompt"], cols["solution"], strict=True):
            got = set()
            for p in parts_of([row], head):
                got |= band_values(shingles(p.tokens), SEGMENT - SHINGLE + 1, SEGMENT_STEP)
            yield from ((row[0], j, v) for j, v in sorted(got))

    texts = docs.toDF(key, "text")
    left = arrow_map(texts, windows, f"`{key}` {kind}, band int, value bigint")
    right = arrow_map(items, segments, "item_id bigint, band int, value bigint")
    pairs = materialize(left.join(right, ["band", "value"]).select(key, "item_id").distinct())

    def verified(cols: dict[str, list]) -> Iterator[tuple]:
        for k, t, *row in zip(cols[key], cols["text"], cols["item_id"], cols["prompt"], cols["solution"], strict=True):
            tokens = words(t)
            h = shingles(tokens)
            if any(leaked(tokens, h, p, shingles(p.tokens)) for p in parts_of([tuple(row)], head)):
                yield k, row[0]

    whole = texts.where("text is not null").join(pairs, key).join(items, "item_id").select(key, "text", "item_id", "prompt", "solution")
    return arrow_map(whole, verified, f"`{key}` {kind}, item_id bigint")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each leaked item is in."""
    return p7_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("docs"))


QUERIES = {"p7_found": p7_found, "p7_items": p7_items}
ORACLES: dict[str, str] = {}
