"""Lexical, dense and fused retrieval over documents with a name, signature, path and text.

The query side is a stated list, small by definition. Postings are filtered to
its terms before they are grouped; document frequencies and lengths are counted
over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.checkpoints import materialize

# Fields with their weight and length normalisation, and the constants of the term score.
FIELDS = (("name", 4.0, 0.5), ("sig", 2.0, 0.75), ("path", 1.5, 0.4), ("doc", 1.0, 0.8))
K1, DELTA, LEAST_IDF = 1.2, 0.5, 0.15
RRF_K = 60.0
HASH_DIMS, AXES = 104, 24


def documents(nodes: DataFrame) -> DataFrame:
    """Token arrays of the four fields of each node."""
    return nodes.select(
        "id", "name",
        T.tokenize_ident(F.col("name")).alias("name_tokens"), T.tokenize_ident(F.col("signature")).alias("sig_tokens"),
        T.tokenize_ident(F.col("file_path")).alias("path_tokens"), T.tokenize_ident(F.coalesce("docstring", F.lit(""))).alias("doc_tokens"),
    )


def query_table(spark, queries: list[tuple[int, str]]) -> DataFrame:  # noqa: ANN001
    q = spark.createDataFrame(queries, "query bigint, text string")
    return q.select("query", "text", T.query_terms(F.col("text")).alias("terms"))


def doc_freq(docs: DataFrame) -> DataFrame:
    """(term, df): documents with the term in any field."""
    every = F.array_distinct(F.concat(*[F.col(f"{f}_tokens") for f, _, _ in FIELDS]))
    return docs.select("id", F.explode(every).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, id, score) of every document with a positive fielded score, exact-name and n-gram bonuses included.

    The texts are read once: of each document its lengths, the tokens that the stated queries ask for and
    its bonuses are written to the shared folder, and everything else works on these.
    """
    rows = queries.select("query", "text", "terms").collect()  # the stated queries
    if not rows:
        return docs.select(F.lit(None).cast("bigint").alias("query"), "id", F.lit(0.0).alias("score")).limit(0)
    wanted = sorted({t for r in rows for t in r["terms"]})
    grams = {r["query"]: sorted(grams_of(r["text"])) for r in rows}

    def tag(field: str):  # noqa: ANN202
        asked = F.filter(f"{field}_tokens", lambda t: t.isin(wanted)) if wanted else F.array().cast("array<string>")
        return F.transform(asked, lambda t: F.struct(t.alias("term"), F.lit(field).alias("field")))

    name, own = F.array_join("name_tokens", ""), T.char_ngrams(F.array_join("name_tokens", ""))
    stated = F.array(*[F.struct(F.lit(r["query"]).alias("query"), F.lit(r["text"].strip().lower()).alias("q"), F.array(*[F.lit(g) for g in grams[r["query"]]]).alias("grams")) for r in rows])

    def bonus(x, g):  # noqa: ANN001, ANN202 - columns
        exact = F.when((name == x["q"]) | (F.array_join("name_tokens", "_") == x["q"]), 40.0).when(F.array_contains("name_tokens", x["q"]), 20.0).otherwise(0.0)
        common = F.size(F.array_intersect(x["grams"], g))
        sim = common / (F.size(x["grams"]) + F.size(g) - common)
        return F.struct(x["query"].alias("query"), (exact + F.when(sim > 0.35, sim * 15.0).otherwise(0.0)).alias("s"))

    # whatever shares a gram shares one of three characters, and only such names can have a bonus
    short = sorted({g for gs in grams.values() for g in gs if len(g) == min(3, len(g))} | {r["text"].strip().lower() for r in rows})
    near = F.concat(F.lit("<"), name, F.lit(">")).rlike("|".join(r"\Q" + g.replace(r"\E", "") + r"\E" for g in short if g))
    # the grams of a name are one element, so that they are made once and not for each query
    bonuses = F.when(near, F.element_at(F.transform(F.array(own), lambda g: F.filter(F.transform(stated, lambda x: bonus(x, g)), lambda y: y["s"] > 0)), 1))
    seen = materialize(docs.select("id", *[F.size(f"{f}_tokens").alias(f"len_{f}") for f, _, _ in FIELDS], F.concat(*[tag(f) for f, _, _ in FIELDS]).alias("hits"), bonuses.alias("bonuses")))
    stats = seen.agg(F.count("*").alias("n_docs"), *[F.avg(f"len_{f}").alias(f"avg_{f}") for f, _, _ in FIELDS])
    post = seen.where(F.size("hits") > 0).select("id", *[f"len_{f}" for f, _, _ in FIELDS], F.explode("hits").alias("x")).select("*", "x.term", "x.field").drop("x")
    per = post.groupBy("id", "term", *[f"len_{f}" for f, _, _ in FIELDS]).agg(*[F.sum((F.col("field") == f).cast("int")).alias(f"tf_{f}") for f, _, _ in FIELDS])
    df = per.groupBy("term").agg(F.count("*").alias("df"))
    x = per.join(F.broadcast(df), "term").join(F.broadcast(stats))  # as many rows as query terms, and one row
    idf = F.greatest(F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0), F.lit(LEAST_IDF))
    tf = F.lit(0.0)
    for f, w, b in FIELDS:
        norm = F.greatest(1.0 - b + b * (F.col(f"len_{f}") / F.greatest(F.col(f"avg_{f}"), F.lit(1.0))), F.lit(0.2))
        tf = tf + w * (F.col(f"tf_{f}") / norm)
    x = x.select("id", "term", (idf * (tf * (K1 + 1.0) / (tf + K1) + DELTA)).alias("s"))
    terms = queries.select("query", F.explode("terms").alias("term")).distinct()
    lexical = x.join(F.broadcast(terms), "term").groupBy("query", "id").agg(F.sum("s").alias("s"))
    extra = seen.where("bonuses is not null").select("id", F.explode("bonuses").alias("x")).select("x.query", "id", "x.s")
    return lexical.unionByName(extra).groupBy("query", "id").agg(F.sum("s").alias("score"))


def top_k(scores: DataFrame, k: int, by: str = "score", key: str = "query") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(by), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rrf(modalities: list[tuple[DataFrame, float]], k: float = RRF_K) -> DataFrame:
    """(query, id, score): sum of weight / (k + rank) over the ranked lists (query, id, score)."""
    parts = []
    for scores, weight in modalities:
        w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        parts.append(scores.select("query", "id", (F.lit(weight) / (k + F.row_number().over(w))).alias("s")))
    return reduce(DataFrame.unionByName, parts).groupBy("query", "id").agg(F.sum("s").alias("score"))


def rocchio(nodes: DataFrame, queries: DataFrame, scores: DataFrame, feedback: int = 3, terms: int = 4) -> DataFrame:
    """(query, term, weight): terms of the best documents, discounted by rank, that the query lacks."""
    best = top_k(scores, feedback)
    text = nodes.select("id", T.tokenize_ident(F.concat_ws(" ", "name", "signature", "docstring")).alias("tokens"))
    x = best.join(text, "id").join(F.broadcast(queries.select("query", "terms")), "query")  # the stated queries
    x = x.select("query", "rank", "terms", F.explode("tokens").alias("term")).where((F.octet_length("term") >= 3) & ~F.array_contains("terms", F.col("term")) & ~F.col("term").isin(T.STOPWORDS))
    w = x.groupBy("query", "term").agg(F.sum(1.0 / F.sqrt("rank")).alias("weight"))
    order = Window.partitionBy("query").orderBy(F.desc(F.round("weight", 9)), "term")
    return w.withColumn("n", F.row_number().over(order)).where(F.col("n") <= terms).drop("n")


def fnv1a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


@lru_cache(maxsize=1 << 18)
def _cell(gram: str) -> int:
    h = fnv1a(gram.encode())
    return h % HASH_DIMS + (0 if (h >> 32) & 1 else HASH_DIMS)


def embed_text(tokens: list[str], grams: set[str] | list[str], axes: list[list[str]] | None = None) -> np.ndarray:
    """Unit vector: signed hashing of the n-grams, and one axis per list of topic words; zeros for blank text."""
    v = np.zeros(HASH_DIMS + AXES)
    if not tokens and not any(g.strip("<> ") for g in grams):
        return v
    cells = [_cell(g) for g in grams]  # dimension, and HASH_DIMS more for a negative sign
    n = np.bincount(cells, minlength=2 * HASH_DIMS)
    v[:HASH_DIMS] = n[:HASH_DIMS] - n[HASH_DIMS:]
    have = set(tokens)
    for k, words in enumerate((axes or [])[:AXES]):
        score = 0.0
        for w in words:
            if w in have:
                score += 2.0
            elif len(w) >= 4:
                score += sum(len(t) >= 4 and (t.startswith(w) or w.startswith(t)) for t in have)
        v[HASH_DIMS + k] = 2.5 * score
    norm = float(np.linalg.norm(v))
    return v / norm if norm else v


def hash_embed(rows: DataFrame, text: str, axes: list[list[str]] | None = None) -> DataFrame:
    """`rows` with `embedding` ARRAY<FLOAT> of the text column; topic axes are a parameter."""

    @F.pandas_udf("array<float>")
    def embed(tokens: pd.Series, raw: pd.Series) -> pd.Series:
        return pd.Series([embed_text(list(t), grams_of(x), axes).astype(np.float32) if x is not None else None for t, x in zip(tokens, raw, strict=True)])

    return rows.withColumn("embedding", embed(T.tokenize_ident(F.col(text)), F.col(text)))


def grams_of(text: str) -> set[str]:
    """Distinct 3- to 5-grams as text.char_ngrams has them; linear in the text, for long ones."""
    x = f"<{text.strip().lower()}>"
    return {x[i : i + n] for n in (3, 4, 5) for i in range(len(x) - n + 1)} or {x}


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", column: str = "embedding", block: int = 2048) -> DataFrame:
    """(query, id, score): the k most similar vectors of each query vector, itself left out.

    Queries go to the executors in blocks; each task keeps its best k of a query,
    and only those are ranked over all tasks.
    """
    sc = vectors.sparkSession.sparkContext
    parts = []
    rows: list[tuple] = []

    def flush() -> None:
        nonlocal rows
        ids = np.array([r[0] for r in rows], dtype=np.int64)
        m = np.array([r[1] for r in rows], dtype=np.float64)
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        shared = sc.broadcast((ids, m))
        rows = []

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q_ids, q = shared.value
            for b in batches:
                b = b[b[column].notna()]
                if not len(b):
                    continue
                x = np.stack([np.asarray(v, dtype=np.float64) for v in b[column]])
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                own = b[key].to_numpy()
                s = np.round(q @ x.T, 9)
                s[q_ids[:, None] == own[None, :]] = -2.0
                for i in range(len(q_ids)):
                    best = np.lexsort((own, -s[i]))[:k]
                    best = best[s[i, best] > -2.0]
                    yield pd.DataFrame({"query": q_ids[i], "id": own[best], "score": s[i, best]})

        parts.append(vectors.select(key, column).mapInPandas(run, "query bigint, id bigint, score double"))

    for r in queries.select(key, column).where(F.col(column).isNotNull()).toLocalIterator():
        rows.append((r[0], r[1]))
        if len(rows) >= block:
            flush()
    if rows:
        flush()
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query bigint, id bigint, score double, rank int")
    return top_k(reduce(DataFrame.unionByName, parts), k)


def search(nodes: DataFrame, queries: DataFrame, k: int = 10, axes: list[list[str]] | None = None, mode: str = "hybrid", dense_k: int = 1000) -> DataFrame:
    """(query, id, score, rank): fused lexical and dense search with exact-name boost and test demotion; scores within (0.05, 1]."""
    docs = documents(nodes)
    parts = []
    if mode in ("hybrid", "lexical"):
        parts.append((bm25(docs, queries), 1.0))
    if mode in ("hybrid", "dense"):
        text = nodes.select("id", F.concat_ws(" ", "name", "file_path", "signature", "docstring").alias("t"))
        q = queries.sparkSession.createDataFrame([(r["query"], r["text"]) for r in queries.collect()], "id bigint, t string")
        # the texts of documents and queries share no ids: queries get negative ones
        q = q.select((-F.col("id") - 1).alias("vec_id"), "t")
        v = hash_embed(text.withColumnRenamed("id", "vec_id"), "t", axes)
        near = cosine_topk(v, hash_embed(q, "t", axes), k=dense_k)
        parts.append((near.where("score > 0.05").select((-F.col("query") - 1).alias("query"), "id", "score"), 1.0))
    fused = rrf(parts) if mode == "hybrid" else parts[0][0]
    x = fused.join(nodes.select("id", "name", "file_path"), "id").join(F.broadcast(queries.select("query", F.lower(F.trim("text")).alias("q"), "terms")), "query")  # the stated queries
    exact = (F.lower("name") == F.col("q")) | (F.lower("name") == F.replace(F.col("q"), F.lit("_"), F.lit("")))
    test = (F.col("name").startswith("test_") | F.col("file_path").contains("tests/")) & ~F.array_contains("terms", "test") & ~exact
    x = x.withColumn("score", F.col("score") * F.when(exact, 2.5).otherwise(1.0) * F.when(test, 0.7).otherwise(1.0))
    best = top_k(x.select("query", "id", "score"), k)
    top = F.max("score").over(Window.partitionBy("query"))
    return best.withColumn("score", F.greatest(F.least(F.col("score") / F.greatest(top, F.lit(1e-6)), F.lit(1.0)), F.lit(0.05)))
