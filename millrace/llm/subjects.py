"""Problem 8: subject areas of documents by distributed latent Dirichlet topic models.

The own prose of each document (no code, logs, headings, quoted test passages)
is cut into sentences of words. A latent Dirichlet model of the words that tell
documents apart is fitted without labels over all documents by distributed
variational EM: each pass hands the topics to the executors, every document gets
its variational posterior there, and the expected counts are summed. Topics start
from anchor words, each the least alike in its company to those before. Topics are
then mapped to subjects through their top terms, inspected by the hand-given labels
of documents with these terms and by the subjects' descriptions. A document's
proportions are taken over its sentences, each of which speaks for the subject whose
topics hold most of it; it has the areas of AREA_SHARE or more.

Defined cases: null, empty and blank texts, and texts without prose, have no
area; labels that are null, of unknown documents, contradictory or repeated
only weaken a mapping; without labels the subjects' descriptions map the topics;
repeated documents get equal areas; an empty table gives an empty result. Scale:
texts are read once; word numbers are written once to the shared folder and read in
each pass; what returns to the driver is bounded by the square of START_WORDS or
by topics times vocabulary.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialize, spread, table

#: Topics that start from anchor words (at least, and for each subject), and from all informative words.
TOPICS, TOPICS_OF_SUBJECT, BACKGROUND = 64, 6, 3
#: EM passes, variational rounds within a pass, Dirichlet parameters of documents and topics.
PASSES, ROUNDS, ALPHA, ETA = 2, 4, 0.1, 0.01
#: A word is in the vocabulary if at least so many documents, and such a share of them, have it.
MIN_DOCS, MIN_SHARE = 3, 1 / 5000
#: A word tells documents apart if it is in a smaller share of those of each language; documents that a rare language is taken to have besides its own.
WIDE, LANGUAGE_DOCS = 0.25, 50
#: Most frequent informative words among which anchors are sought (the fit itself takes all of them).
START_WORDS = 3000
#: Top terms that a topic is inspected by, and how far its best subject must exceed that subject's share of all labels.
TOP_TERMS, SPEAKS = 20, 0.3
#: Share of a document's sentences from which it is about an area; words' posterior mass from which a sentence is.
AREA_SHARE, SENTENCE_MASS = 0.22, 0.55
#: Share of a sentence's word triples that are test items' from which it counts as a quoted test passage.
QUOTED = 0.25
#: Test items whose word triples are handed to the executors; those of more are joined with the sentences'.
ITEM_BLOCK = 5000

_FENCE = re.compile(r"^[ \t>]*(```|~~~).*?(?:^[ \t>]*\1[^\n]*$|\Z)", re.M | re.S)
_LOG = re.compile(r"^\W*(?:\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\[?\d\d:\d\d:\d\d|(?:DEBUG|INFO|WARN(?:ING)?|ERROR|TRACE|FATAL)\b|at [\w.$]+\(|Traceback|File \")")
_HEADING = re.compile(r"^\s{0,3}(?:#{1,6}(?:\s|$)|={3,}\s*$|-{3,}\s*$)")
_CODE_LINE = re.compile(r"^(?:\t| {4,})\S.*[;{}()=]\s*$|^\s*(?:[\w.]+\s*(?::=|=)\s*\S+.*[;)]|.*[{;]|[})\]]+[;,]?)\s*$")
_SPLIT = re.compile(r"(?<=[.!?])[\"')*_]*\s+|\n+")
_WORD = re.compile(r"[^\W\d_]{2,}(?:['’][^\W\d_]+)?")
_INLINE = re.compile(r"`[^`\n]*`|\b\w+://\S+|\b[\w.-]+(?:/[\w.-]+)+|\b\w+(?:::\w+)+|\b[\w.+-]+@[\w-]+\.\w+")
_PREFIX = re.compile(r"^\s*(?:>\s*)*(?:[-*+•]\s+|\d+[.)]\s+)?")


def prose(text: str | None) -> list[str]:
    """Sentences of a document's own prose."""
    if not text:
        return []
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    out: list[str] = []
    paragraph: list[str] = []

    def close() -> None:
        if paragraph:
            out.extend(s for s in _SPLIT.split(" ".join(paragraph)) if s.strip())
            paragraph.clear()

    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        s = _PREFIX.sub("", line)
        if not s.strip() or _HEADING.match(line) or _LOG.match(s) or _CODE_LINE.match(line):
            close()
            continue
        if s != line.lstrip() and not line.lstrip().startswith(">"):  # a list entry begins a sentence
            close()
        paragraph.append(s.strip())
    close()
    return out


def _tokens(sentence: str) -> list[str]:
    if "/" in sentence or "`" in sentence or "@" in sentence or "::" in sentence:  # nothing else is written inline
        sentence = _INLINE.sub(" ", sentence)
    return _WORD.findall(sentence.lower())


_cache: dict[str, int] = {}


def hashes(tokens: list[str]) -> np.ndarray:
    """Signed 64-bit hashes of words."""
    if len(_cache) > 1_000_000:
        _cache.clear()
    get, out = _cache.get, []
    for t in tokens:
        h = get(t)
        if h is None:
            h = _cache[t] = xxhash.xxh64_intdigest(t) - (1 << 63)
        out.append(h)
    return np.array(out, dtype=np.int64)


def triples(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word triples of texts of the given sizes in a row, and the text of each."""
    if len(words) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    whole = owner[:-2] == owner[2:]
    w = words.view(np.uint64)
    h = ((w[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ w[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) ^ w[2:]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    return h.view(np.int64)[whole], owner[:-2][whole]


def item_triples(items: list[tuple]) -> np.ndarray:
    """Sorted distinct word triples of test items (id, prompt, solution)."""
    texts = [_tokens(t) for _, a, b in items for t in (a, b) if t]
    return np.unique(triples(hashes([w for t in texts for w in t]), np.array([len(t) for t in texts], dtype=np.int64))[0])


def sentences(texts: list, test: np.ndarray) -> tuple[list[list[str]], np.ndarray]:
    """Words of each sentence of the texts' own prose that is no quoted test passage, and the text of each."""
    words, owner = [], []
    for i, text in enumerate(texts):
        for s in prose(text):
            if w := _tokens(s):
                words.append(w)
                owner.append(i)
    of = np.array(owner, dtype=np.int64)
    if not len(test) or not words:
        return words, of
    sizes = np.array([len(w) for w in words])
    h, who = triples(hashes([x for w in words for x in w]), sizes)
    known = test[np.minimum(np.searchsorted(test, h), len(test) - 1)] == h
    quoted = np.bincount(who, weights=known, minlength=len(words)) >= QUOTED * np.maximum(np.bincount(who, minlength=len(words)), 1)
    return [w for w, q in zip(words, quoted, strict=True) if not q], of[~quoted]


# -- the model ------------------------------------------------------------------


@dataclass
class Corpus:
    """Word occurrences of a batch: document, sentence and word of each, in order."""

    doc: np.ndarray
    sentence: np.ndarray
    word: np.ndarray
    n_docs: int
    sentence_doc: np.ndarray  # document of each sentence, also of those without a known word


def corpus(words: list[np.ndarray], at: list[np.ndarray], sizes: np.ndarray) -> Corpus:
    """Of each document the numbers of its words, the sentence of each, and how many sentences it has."""
    n = np.array([len(w) for w in words], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(words)), n)
    word = np.concatenate([*words, np.zeros(0, dtype=np.int64)]).astype(np.int64)
    sentence = np.concatenate([*at, np.zeros(0, dtype=np.int64)]).astype(np.int64) + first[doc]
    return Corpus(doc, sentence, word, len(words), np.repeat(np.arange(len(words)), sizes))


def posterior(c: Corpus, topics: np.ndarray, rounds: int = ROUNDS, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(topic posterior of each occurrence, expected topic counts of each document)."""
    k = topics.shape[0]
    like = topics.T.astype(np.float32)[c.word]
    theta = np.full((c.n_docs, k), 1.0, dtype=np.float32)
    if not len(c.word):
        return like, theta * 0
    begin = np.flatnonzero(np.append(True, c.doc[1:] != c.doc[:-1]))
    who = c.doc[begin]
    r = like
    for _ in range(rounds):
        r = like * theta[c.doc]
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-30)
        counts = np.add.reduceat(r, begin, axis=0)
        theta[:] = alpha
        theta[who] += counts
    out = np.zeros((c.n_docs, k))
    out[who] = counts
    return r, out


def start(pairs: np.ndarray, words: np.ndarray, counts: np.ndarray, n_docs: int, n_topics: int) -> np.ndarray:
    """Topics to start from, by vocabulary.

    `pairs` holds in how many documents two of the numbered `words` are, `counts` in how many each word of
    the vocabulary is. The company of a word is what is with it more often than chance. Anchors are taken
    one by one, the word of most company that is least like those before it; a topic starts from the company
    of its anchor as far as that is alike. Background topics start from all words.
    """
    v, n = len(counts), np.diag(pairs).copy()
    expected = np.outer(n, n) / max(n_docs, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        company = np.where((pairs > expected) & (pairs >= 2), pairs * np.log(pairs / expected), 0.0)
    np.fill_diagonal(company, 0.0)
    unit = company / np.maximum(np.linalg.norm(company, axis=1, keepdims=True), 1e-9)
    weight = np.log1p(company.sum(axis=1)) * (n >= 2 * MIN_DOCS)
    like = np.zeros(len(words))
    topics = []
    for _ in range(min(n_topics, len(words))):
        score = (1.0 - np.minimum(like, 1.0)) * weight
        anchor = int(np.argmax(score))
        if score[anchor] <= 1e-9:
            break
        near = unit @ unit[anchor]
        row = np.zeros(v)
        row[words] = company[anchor] * near
        row[words[anchor]] = row.max()
        topics.append(row / row.sum())
        like = np.maximum(like, near)
    back = counts * np.random.default_rng(7).uniform(0.5, 1.5, size=(BACKGROUND, v))
    topics = np.vstack([*topics, *(back / back.sum(axis=1, keepdims=True))]) + 1e-4 / v
    return topics / topics.sum(axis=1, keepdims=True)


def top_terms(topics: np.ndarray, top: int = TOP_TERMS) -> tuple[np.ndarray, np.ndarray]:
    """The words that each topic has most beyond the others, and their weights."""
    mean = topics.mean(axis=0)
    value = np.where(topics > mean, topics * np.log(topics / mean), 0.0)
    lead = np.argsort(-value, axis=1, kind="stable")[:, :top]
    weight = np.take_along_axis(value, lead, axis=1)
    return lead, weight / np.maximum(weight.sum(axis=1, keepdims=True), 1e-12)


def mapping(topics: np.ndarray, evidence: np.ndarray, share: np.ndarray) -> list[int]:
    """Subject (row of `evidence`, subject x word) of each topic through its top terms, -1 for none; `share` is each subject's of all labels."""
    out = []
    for lead, weight in zip(*top_terms(topics), strict=True):
        pooled = evidence[:, lead] @ weight
        beyond = (pooled + 0.5 * share) / (pooled.sum() + 0.5) - share
        best = int(np.argmax(beyond))
        out.append(best if beyond[best] >= SPEAKS * (1.0 - share[best]) and evidence[best, lead].sum() >= 2 else -1)
    return out


def shares(c: Corpus, topics: np.ndarray, subject_of_topic: list[int], n_subjects: int) -> np.ndarray:
    """Share of each document's sentences that each subject's topics hold."""
    r, _ = posterior(c, topics, rounds=ROUNDS + 2)
    n_sentences = len(c.sentence_doc)
    mass = np.zeros((n_sentences, n_subjects))
    for k, s in enumerate(subject_of_topic):
        if s >= 0 and len(c.word):
            np.add.at(mass[:, s], c.sentence, r[:, k])
    total = mass.sum(axis=1)
    best = mass.argmax(axis=1) if n_sentences else np.zeros(0, dtype=int)
    strong = (total > 0) & (mass.max(axis=1, initial=0) >= SENTENCE_MASS)
    out = np.zeros((c.n_docs, n_subjects))
    np.add.at(out, (c.sentence_doc[strong], best[strong]), 1.0)
    n = np.bincount(c.sentence_doc, minlength=c.n_docs)
    return out / np.maximum(n, 1)[:, None]


# -- distribution ------------------------------------------------------------------


@dataclass
class Fitted:
    vocabulary: np.ndarray  # sorted hashes of the informative words
    topics: np.ndarray
    subject_of_topic: list[int]
    subjects: list[int]
    encoded: DataFrame
    numbered: DataFrame


def _quoted(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, hidden): hashes of those sentences of each document that quote test items, for any number of items."""

    def of_docs(cols: dict[str, list]) -> Iterator[tuple]:
        words, owner = sentences(cols["text"], np.zeros(0, dtype=np.int64))
        h, who = triples(hashes([x for w in words for x in w]), np.array([len(w) for w in words], dtype=np.int64))
        whole = [_whole(w) for w in words]
        yield from ((cols["doc_id"][owner[j]], whole[j], x) for x, j in zip(h.tolist(), who.tolist(), strict=True))

    def of_items(cols: dict[str, list]) -> Iterator[tuple]:
        yield from ((x,) for x in item_triples(list(zip(cols["item_id"], cols["prompt"], cols["solution"], strict=True))).tolist())

    known = arrow_map(items, of_items, "triple bigint").distinct().withColumn("known", F.lit(1.0))
    mine = arrow_map(documents.where("text is not null").select("doc_id", "text"), of_docs, "doc_id bigint, sentence bigint, triple bigint")
    share = mine.join(known, "triple", "left").groupBy("doc_id", "sentence").agg(F.avg(F.coalesce("known", F.lit(0.0))).alias("share"))
    return share.where(F.col("share") >= QUOTED).groupBy("doc_id").agg(F.collect_set("sentence").alias("hidden"))


def _whole(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63)


def _encode(documents: DataFrame, items: DataFrame | None, block: int = ITEM_BLOCK) -> DataFrame:
    """(doc_id, language, word hashes, sentence sizes, words spelled) of every document, written to the shared folder.

    `spelled` is on the first row of a batch and lists the distinct words of the batch with their hashes.
    """
    lang = F.lower(F.substring(F.trim("lang"), 1, 2)) if "lang" in documents.columns else F.lit(None).cast("string")
    docs = documents.select("doc_id", "text", F.coalesce(lang, F.lit("")).alias("language"))
    test, hidden = np.zeros(0, dtype=np.int64), F.lit(None).cast("array<bigint>")
    if items is not None:
        wanted = items.select("item_id", "prompt", "solution")
        few = wanted.take(block + 1)
        if len(few) <= block:
            test = item_triples([tuple(r) for r in few])
        else:
            docs, hidden = docs.join(_quoted(docs, wanted), "doc_id", "left"), F.col("hidden")
    shared = documents.sparkSession.sparkContext.broadcast(test)

    def rows(cols: dict[str, list]) -> Iterator[tuple]:
        words, owner = sentences(cols["text"], shared.value)
        got: list[list[list[str]]] = [[] for _ in cols["text"]]
        for w, i in zip(words, owner.tolist(), strict=True):
            if not cols["hidden"][i] or _whole(w) not in cols["hidden"][i]:
                got[i].append(w)
        distinct = sorted({x for w in words for x in w})
        spelled = [{"hash": h, "word": w} for h, w in zip(hashes(distinct).tolist(), distinct, strict=True)]
        for i, (doc, language) in enumerate(zip(cols["doc_id"], cols["language"], strict=True)):
            yield doc, language, hashes([x for w in got[i] for x in w]).tolist(), [len(w) for w in got[i]], None if i else spelled

    schema = "doc_id bigint, language string, words array<bigint>, sizes array<int>, spelled array<struct<hash:bigint,word:string>>"
    return materialize(arrow_map(spread(docs.select("doc_id", "text", "language", hidden.alias("hidden"))), rows, schema))


def _informative(encoded: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and document counts of the words that are frequent enough and tell documents of a language apart."""
    own = encoded.groupBy("language").agg(F.count("*").alias("of_language"))  # two letters: some hundreds at most
    by = encoded.select("language", F.explode(F.array_distinct("words")).alias("word")).groupBy("word", "language").agg(F.count("*").alias("n"))
    widest = F.max(F.col("n") / (F.col("of_language") + LANGUAGE_DOCS))
    least = max(MIN_DOCS, int(np.ceil(n_docs * MIN_SHARE)))
    got = by.join(F.broadcast(own), "language").groupBy("word").agg(F.sum("n").alias("n"), widest.alias("widest")).where((F.col("n") >= least) & (F.col("widest") < WIDE))
    rows = sorted((r["word"], r["n"]) for r in got.select("word", "n").collect())  # at most the words of a document / MIN_SHARE
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=float)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column in a row, and the length of each list."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _number(encoded: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, word numbers, sentence of each, sentences) of every document, written to the shared folder."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for b in batches:
            w, n_words = _lists(b.column(1))
            size, n = _lists(b.column(2))
            sentence = np.repeat(np.arange(len(size)) - np.repeat(np.cumsum(n) - n, n), size)
            at = np.minimum(np.searchsorted(vocabulary, w), max(len(vocabulary) - 1, 0))
            kept = vocabulary[at] == w if len(vocabulary) else np.zeros(len(w), dtype=bool)
            left = np.bincount(np.repeat(np.arange(b.num_rows), n_words)[kept], minlength=b.num_rows)
            ends = pa.array(np.concatenate([[0], np.cumsum(left)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[kept], pa.int32())) for x in (at, sentence)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists, pa.array(n, pa.int32())], names=["doc_id", "words", "at", "n"])

    return materialize(encoded.select("doc_id", "words", "sizes").mapInArrow(run, "doc_id bigint, words array<int>, at array<int>, n int"))


def _pairs(numbered: DataFrame, words: np.ndarray, size: int) -> np.ndarray:
    """In how many documents two of `words` (numbers of the vocabulary) are; on the diagonal, one."""
    place = np.full(size, -1, dtype=np.int64)
    place[words] = np.arange(len(words))
    m = len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, n = _lists(b.column(0))
            p = place[w]
            key = np.unique(np.repeat(np.arange(len(n)), n)[p >= 0] * m + p[p >= 0])
            doc, p = key // m, key % m
            n = np.bincount(doc, minlength=len(n))
            first = np.cumsum(n) - n
            partners = n[doc]
            for s in range(0, len(doc), 20_000):  # a document has at most START_WORDS partners for each word
                part = slice(s, s + 20_000)
                many = partners[part]
                left = np.repeat(p[part], many)
                right = p[np.repeat(first[doc[part]] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
                pair, count = np.unique(left * m + right, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(count, pa.int64())], names=["pair", "n"])

    out = np.zeros(m * m)
    got = numbered.select("words").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out[got["pair"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=float)
    return out.reshape(m, m)


def fit(documents: DataFrame, labels: DataFrame, subjects: DataFrame, items: DataFrame | None = None, passes: int = PASSES, topics: int = TOPICS) -> Fitted:
    spark = documents.sparkSession
    encoded = _encode(documents, items)
    names = sorted((int(r[0]), f"{r[1] or ''} {r[2] or ''}") for r in subjects.where("subject_id is not null").select("subject_id", "subject_name", "description").collect())
    ids = [s for s, _ in names]
    n_docs = encoded.count()
    vocabulary, counts = _informative(encoded, n_docs)
    numbered = _number(encoded, vocabulary)
    v, s = len(vocabulary), len(ids)
    if not v:
        return Fitted(vocabulary, np.zeros((0, 0)), [], ids, encoded, numbered)
    words = np.sort(np.argsort(-counts, kind="stable")[:START_WORDS])
    found = start(_pairs(numbered, words, v), words, counts, n_docs, max(topics, TOPICS_OF_SUBJECT * s))
    for _ in range(passes):
        found = _pass(spark, numbered, found)
    at = {x: i for i, x in enumerate(ids)}
    known = labels.where(F.col("subject_id").isin(ids) & F.col("doc_id").isNotNull()).select("doc_id", "subject_id").distinct()
    evidence = np.zeros((s, v))
    used = numbered.select("doc_id", F.explode(F.array_distinct("words")).alias("word"))
    for r in known.join(used, "doc_id").groupBy("subject_id", "word").agg(F.count("*").alias("n")).collect():  # at most subjects times vocabulary
        evidence[at[r[0]], r[1]] = r[2]
    share = (evidence.sum(axis=1) + 1.0) / (evidence.sum() + max(s, 1))
    for i, (_, text) in enumerate(names):
        forms = {f for w in _WORD.findall(text.lower()) for f in (w, w.rstrip("s"), w[:-3] + "y" if w.endswith("ies") else w)}
        h = hashes(sorted(forms))
        place = np.minimum(np.searchsorted(vocabulary, h), v - 1)
        evidence[i, place[vocabulary[place] == h]] += 2.0
    return Fitted(vocabulary, found, mapping(found, evidence, share) if s else [-1] * len(found), ids, encoded, numbered)


def _corpus(b: pa.RecordBatch) -> Corpus:
    """Of a batch (words, at, n)."""
    w, size = _lists(b.column(0))
    at, _ = _lists(b.column(1))
    cut = np.cumsum(size)[:-1]
    return corpus(np.split(w, cut) if len(size) else [], np.split(at, cut) if len(size) else [], b.column(2).to_numpy(zero_copy_only=False).astype(np.int64))


def _pass(spark: SparkSession, numbered: DataFrame, topics: np.ndarray) -> np.ndarray:
    """One EM pass over all documents."""
    shared = spark.sparkContext.broadcast(topics)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topics = shared.value
        total = np.zeros_like(topics)
        for b in batches:
            for p in range(0, b.num_rows, 2000):
                c = _corpus(b.slice(p, 2000))
                if len(c.word):
                    r, _ = posterior(c, topics)
                    for k in range(len(topics)):
                        total[k] += np.bincount(c.word, weights=r[:, k], minlength=topics.shape[1])
        k, w = np.nonzero(total > 1e-6)
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(w, pa.int32()), pa.array(total[k, w])], names=["k", "w", "n"])

    got = numbered.select("words", "at", "n").mapInArrow(run, "k int, w int, n double").groupBy("k", "w").agg(F.sum("n").alias("n")).toPandas()
    shared.unpersist()
    out = np.full(topics.shape, ETA)
    out[got["k"].to_numpy(), got["w"].to_numpy()] += got["n"].to_numpy()
    return out / out.sum(axis=1, keepdims=True)


def proportions(fitted: Fitted) -> DataFrame:
    """(doc_id, subject_id, share) of every document and subject with a sentence about it."""
    shared = fitted.encoded.sparkSession.sparkContext.broadcast((fitted.topics, fitted.subject_of_topic, fitted.subjects))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topics, subject_of_topic, ids = shared.value
        for b in batches:
            for p in range(0, b.num_rows if len(ids) and len(topics) else 0, 2000):
                part = b.slice(p, 2000)
                sh = shares(_corpus(part.select(["words", "at", "n"])), topics, subject_of_topic, len(ids))
                d, s = np.nonzero(sh)
                if len(d):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d)), pa.array(np.array(ids)[s], pa.int32()), pa.array(sh[d, s], pa.float64())], names=["doc_id", "subject_id", "share"])

    return fitted.numbered.mapInArrow(run, "doc_id bigint, subject_id int, share double")


def areas(documents: DataFrame, labels: DataFrame, subjects: DataFrame, items: DataFrame | None = None, share: float = AREA_SHARE) -> DataFrame:
    """(doc_id, subject_id) of the areas that hold at least `share` of a document's prose."""
    return proportions(fit(documents, labels, subjects, items)).where(F.col("share") >= share).select("doc_id", "subject_id").distinct()


def _all(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    return tuple(table(spark, sf_dir, n) for n in ("documents", "doc_labels", "subject_areas", "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return areas(*_all(spark, sf_dir))


def p8_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic, subject_id, term_rank, term): the top terms that the mapping of topics is inspected by."""
    f = fit(*_all(spark, sf_dir))
    rows = []
    for k, (lead, weight) in enumerate(zip(*top_terms(f.topics), strict=True) if len(f.topics) else ()):
        s = f.subject_of_topic[k]
        rows += [(k, f.subjects[s] if s >= 0 else None, i + 1, int(f.vocabulary[w])) for i, (w, x) in enumerate(zip(lead, weight, strict=True)) if x > 0]
    terms = spark.createDataFrame(rows, "topic int, subject_id int, term_rank int, hash bigint")
    spelled = f.encoded.select(F.explode("spelled").alias("x")).select("x.hash", F.col("x.word").alias("term")).join(F.broadcast(terms.select("hash").distinct()), "hash").distinct()
    return terms.join(spelled, "hash").select("topic", "subject_id", "term_rank", "term")


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per area and source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return p8_found(spark, sf_dir).join(docs, "doc_id").groupBy("subject_id", "source").agg(F.count("*").alias("docs"))


QUERIES = {"p8_found": p8_found, "p8_topics": p8_topics, "p8_composition": p8_composition}
ORACLES: dict[str, str] = {}
