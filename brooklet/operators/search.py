"""Keyword search (BM25 over phrases), vector search, and the two together."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..checkpoints import checkpointed
from ..functions import classify
from ..functions.text import accent_tables, search_tokens
from ..functions.vectors import hash_embedded
from ..schema import EN_STOP, RU_STOP, in_namespace

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
_STOP = {*EN_STOP, *RU_STOP}


@dataclass(frozen=True)
class Phrase:
    """Tokens that follow each other; prefix: the last one may go on; in_and: counts only where all such phrases of the query are found."""

    tokens: tuple[str, ...]
    prefix: bool = False
    in_and: bool = False


def phrases(query: str) -> list[Phrase]:
    """The phrases of a query, most specific first: all its words in a row, each two, all of them anywhere, each."""
    words = [w for w in re.sub(r"[^\w\s]", " ", query).split() if len(w) > 1 and w.lower() not in _STOP]
    fold = str.maketrans(*accent_tables())
    split = lambda w: tuple(t for t in re.split(r"[\W_]+", w.translate(fold).lower()) if t)
    rows: list[tuple[str, list[Phrase]]] = []
    joined = lambda ws: (" ".join(ws), [Phrase(tuple(t for w in ws for t in split(w)))])
    single = [Phrase(split(w), len(w) > 3) for w in words]
    if len(words) >= 2:
        rows.append(joined(words))
        if len(words) >= 3:
            rows += [joined(ws) for ws in zip(words, words[1:], strict=False)]
        rows.append(("&" + " ".join(words), [Phrase(p.tokens, p.prefix, True) for p in single]))
    rows += [("'" + w, [p]) for w, p in zip(words, single, strict=True)]
    first = {name: ps for name, ps in reversed(rows)}  # equal clauses count once
    return [p for name in dict.fromkeys(name for name, _ in rows) for p in first[name] if p.tokens]


@dataclass(frozen=True)
class Index:
    """postings (token, id, dl, column, place), a row for each token of a document, and lengths (id, dl)."""

    postings: DataFrame
    lengths: DataFrame


def indexed(memories: DataFrame) -> Index:
    """The index of memories (id, content, source, tags): tokens lie in one of the three columns, dl is how many there are in all."""
    every = F.array(*(search_tokens(F.coalesce(c, F.lit(""))) for c in (F.col("content"), F.col("source"), F.array_join("tags", " "))))
    documents = memories.select("id", every.alias("columns")).withColumn("dl", F.aggregate("columns", F.lit(0), lambda n, c: n + F.size(c)))
    by_column = documents.select("id", "dl", F.posexplode("columns").alias("column", "tokens"))
    return Index(by_column.select("id", "dl", "column", F.posexplode("tokens").alias("place", "token")).select("token", "id", "dl", "column", "place"), documents.select("id", "dl"))


def occurrences(postings: DataFrame, queries: dict[int, list[Phrase]]) -> DataFrame:
    """query, phrase, id, dl, f: how often each phrase is in each document, where it is.

    Only tokens that a query has are read (stored postings are sorted by token, so the rest is skipped in the scan); they
    meet the queries, a stated set, by a broadcast join.
    """
    spark = postings.sparkSession
    rows = [(q, k, j, len(p.tokens), ("^" if p.prefix and j == len(p.tokens) - 1 else "=") + t) for q, ps in queries.items() for k, p in enumerate(ps) for j, t in enumerate(p.tokens)]
    wanted = spark.createDataFrame(rows, "query long, phrase int, part int, parts int, key string")
    token, keys_asked = F.col("token"), sorted({k for *_, k in rows})
    lengths = sorted({len(k) - 1 for k in keys_asked if k[0] == "^"})
    keys = F.array(F.concat(F.lit("="), token), *(F.when(F.length(token) >= n, F.concat(F.lit("^"), F.substring(token, 1, n))) for n in lengths))
    exact = [k[1:] for k in keys_asked if k[0] == "="]
    asked = reduce(or_, [token.isin(exact) if exact else F.lit(False), *(token.startswith(k[1:]) for k in keys_asked if k[0] == "^")])
    met = postings.where(asked).select("id", "dl", "column", "place", F.explode(F.array_compact(keys)).alias("key")).join(F.broadcast(wanted), "key")
    starts = met.groupBy("query", "phrase", "id", "dl", "column", (F.col("place") - F.col("part")).alias("start")).agg(F.count("*").alias("n"), F.first("parts").alias("parts"))
    return starts.where("n = parts").groupBy("query", "phrase", "id", "dl").agg(F.count("*").alias("f"))


def bm25(memories: DataFrame, queries: dict[int, str], index: Index | None = None) -> DataFrame:
    """query, id, rank (negative, the least is the best) of every document with a phrase of a query. index: stored, or made of the memories."""
    spark, parsed = memories.sparkSession, {q: phrases(t) for q, t in queries.items()}
    index = index or indexed(memories)
    n, total = index.lengths.agg(F.count("*"), F.sum("dl")).first()
    info = spark.createDataFrame([(q, k, p.in_and, sum(x.in_and for x in ps)) for q, ps in parsed.items() for k, p in enumerate(ps)], "query long, phrase int, in_and boolean, n_and int")
    found = checkpointed(occurrences(index.postings, parsed))  # what the queries match, read twice
    count = found.groupBy("query", "phrase").agg(F.count("*").alias("n_p"))
    idf = F.log((F.lit(float(n)) - F.col("n_p") + 0.5) / (F.col("n_p") + 0.5))
    weights = info.join(count, ["query", "phrase"]).select("query", "phrase", "in_and", "n_and", F.when(idf <= 0, LEAST_IDF).otherwise(idf).alias("idf"))
    f, average = F.col("f").cast("double"), F.lit(float(total or 0) / max(n, 1))
    score = F.col("idf") * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / average))
    scored = found.join(F.broadcast(weights), ["query", "phrase"]).select("query", "id", "n_and", F.struct("phrase", "in_and", score.alias("s")).alias("p"))
    by_document = scored.groupBy("query", "id", "n_and").agg(F.array_sort(F.collect_list("p")).alias("ps"))  # as many as the query has phrases
    whole = F.size(F.filter("ps", lambda p: p["in_and"])) == F.col("n_and")
    rank = F.aggregate("ps", F.lit(0.0), lambda acc, p: acc + F.when(p["in_and"] & ~whole, 0.0).otherwise(p["s"]))
    return by_document.select("query", "id", (-rank).alias("rank"))


def top(rows: DataFrame, k: int, *order: Column, by: str = "query") -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def selected(memories: DataFrame, tier: str | None = None, namespace: str | None = None) -> DataFrame:
    return memories.where(~F.col("archived") & (F.lit(True) if tier is None else F.col("tier") == tier) & in_namespace(F.col("namespace"), namespace))


def keyword_hits(memories: DataFrame, queries: dict[int, str], limit: int, tier: str | None = None, namespace: str | None = None, index: Index | None = None) -> DataFrame:
    """query, id, fts_score: the best `limit` of each query; 1 for the best, 0 for the last of them, 0 if all are equal.

    Archived documents count in the statistics, as they stay in the index.
    """
    ranked = bm25(memories, queries, index).join(selected(memories, tier, namespace).select("id"), "id", "left_semi")
    best = top(ranked, limit, F.col("rank"), F.col("id"))
    w = Window.partitionBy("query")
    low, high = F.min("rank").over(w), F.max("rank").over(w)
    return best.select("query", "id", F.when(low == high, 0.0).otherwise((high - F.col("rank")) / (high - low)).alias("fts_score"))


#: Queries that are compared at once (their vectors are one matrix, sent to every task), and vectors that they are held against at once.
QUERY_BLOCK, SLICE = 1024, 2048
#: Decimals of a distance by which neighbours are ordered; equal vectors are then equally far, whatever the order of additions.
DIGITS = 12


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query, id, distance: for each query (query, vector; a stated set) the k nearest of vectors (id, embedding); a query of no length has none.

    Queries go block by block: a block is a matrix that is broadcast; each task multiplies it with its vectors, an Arrow
    batch at a time, and passes on its own k nearest. No pair leaves a task but these. Beyond one block, each block's
    result is stored and its matrix given back, so memory doesn't grow with the number of queries.
    """
    spark, schema = vectors.sparkSession, StructType([StructField("query", LongType()), vectors.schema["id"], StructField("distance", DoubleType())])
    some = queries.where(F.exists("vector", lambda x: x != 0)).select(F.col("query").cast("long").alias("query"), "vector")
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))

    def block_of(asked: DataFrame):
        rows = asked.collect()  # QUERY_BLOCK or so
        names = np.array([r["query"] for r in rows], np.int64)
        matrix = np.array([r["vector"] for r in rows], np.float64)
        return spark.sparkContext.broadcast((names, matrix / np.sqrt((matrix * matrix).sum(1, keepdims=True)) if len(rows) else None))

    def found(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix = shared.value
            best_d = np.full((len(names), 0), np.inf)
            best_i = np.zeros((len(names), 0), np.int64)
            if len(names):
                for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
                    own = np.asarray(batch.column("embedding").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1)
                    size = np.sqrt((own * own).sum(1))
                    distance = np.round(1 - (own / np.where(size > 0, size, 1)[:, None] @ matrix.T).T, DIGITS)
                    both_d = np.concatenate((best_d, distance), 1)
                    both_i = np.concatenate((best_i, np.broadcast_to(batch.column("id").to_numpy(), distance.shape)), 1)
                    order = np.lexsort((both_i, both_d), axis=1)[:, :k]
                    best_d, best_i = np.take_along_axis(both_d, order, 1), np.take_along_axis(both_i, order, 1)
            for at in range(0, len(names), 512):
                d, i = best_d[at : at + 512], best_i[at : at + 512]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[at : at + 512], d.shape[1])), pa.array(i.ravel()), pa.array(d.ravel())], ["query", "id", "distance"])

        return vectors.select("id", "embedding").where("embedding is not null and id is not null").mapInArrow(run, schema)

    if blocks == 1:
        return top(found(block_of(some)), k, F.col("distance"), F.col("id"))
    parts = []
    for block in range(blocks):
        shared = block_of(some.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block))
        parts.append(checkpointed(top(found(shared), k, F.col("distance"), F.col("id"))))
        shared.destroy()
    return reduce(DataFrame.union, parts)


def vector_hits(memories: DataFrame, vectors: DataFrame, queries: DataFrame, limit: int, tier: str | None = None, namespace: str | None = None, prefilter: bool = False) -> DataFrame:
    """query, id, vec_score. As in the original, filters come after twice `limit` neighbours are taken, so they may leave fewer; prefilter puts them first."""
    kept = selected(memories, tier, namespace).select("id")
    if prefilter:
        vectors = vectors.join(kept, "id", "left_semi")
    near = nearest(vectors, queries, 2 * limit).join(kept, "id", "left_semi")
    return top(near, limit, F.col("distance"), F.col("id")).select("query", "id", F.greatest(F.lit(0.0), 1 - F.col("distance")).alias("vec_score"))


def superseded(memories: DataFrame) -> DataFrame:
    """id of every memory that another one, archived or not, supersedes."""
    return memories.where("supersedes is not null").select(F.col("supersedes").alias("id")).distinct()


def translated(queries: dict[int, str], translate: Callable[[str], str] | None) -> dict[int, str]:
    """The queries, those that are mostly not ASCII translated."""
    foreign = lambda t: 2 * sum(c.isalpha() and ord(c) > 127 for c in t) >= sum(map(str.isalpha, t)) > 0
    return {q: translate(t) if translate is not None and foreign(t) else t for q, t in queries.items()}


def recall(
    memories: DataFrame, queries: dict[int, str], now: float, limit: int = 5, tier: str | None = None, namespace: str | None = None, recency_weight: float = 0.1,
    decay_rate: float = 0.01, current_only: bool = True, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, translate: Callable[[str], str] | None = None, keyword_only: bool = False,
    index: Index | None = None,
) -> DataFrame:
    """query, id, content, tier, source, score, method, importance: hybrid search for a stated set of queries, best first within a query.

    vectors (id, embedding) and index default to hash embeddings and tokens of the contents, made for this call; a store
    gives those that it keeps. With current_only, superseded versions are left out;
    without, the whole chains of versions of the hits come with them, at score 0. Reads change nothing: what was
    recalled can be written as access events. translate: an optional function on query strings that are mostly not ASCII.
    """
    spark: SparkSession = memories.sparkSession
    queries = translated(queries, translate)
    asked = spark.createDataFrame(sorted(queries.items()), "query long, text string")
    weighed = asked.select("query", classify.weights(F.col("text")).alias("w")).select("query", "w.*")
    hits = keyword_hits(memories, queries, 3 * limit, tier, namespace, index)
    if keyword_only:
        both = hits.withColumn("vec_score", F.lit(0.0))
    else:
        vectors = hash_embedded(memories) if vectors is None else vectors
        query_vectors = hash_embedded(asked.select(F.col("query").alias("id"), F.col("text").alias("content"))).select(F.col("id").alias("query"), F.col("embedding").alias("vector")) if query_vectors is None else query_vectors
        both = hits.join(vector_hits(memories, vectors, query_vectors, 3 * limit, tier, namespace), ["query", "id"], "full_outer")
    score = F.coalesce("fts_w", F.lit(0.0)) * F.coalesce("fts_score", F.lit(0.0)) + F.col("vec_w") * F.coalesce("vec_score", F.lit(0.0))
    if recency_weight > 0:
        age = F.greatest(F.lit(0.0), F.lit(float(now)) - F.col("created_at")) / 3600
        score = score * (1 - recency_weight) + F.exp(-age * decay_rate) * recency_weight
    score = score * (0.8 + 0.4 * F.coalesce("importance", F.lit(0.5)))
    method = F.when(F.col("fts_w") > 0.6, "keyword").when(F.col("vec_w") > 0.6, "semantic").otherwise("hybrid")
    both = F.broadcast(both.join(F.broadcast(weighed), "query"))  # 6 * limit rows a query at most
    joined = both.join(memories.select("id", "content", "tier", "source", "created_at", "importance"), "id")
    out = joined.select("query", "id", "content", "tier", "source", F.round(score, 4).alias("score"), method.alias("method"), F.round("importance", 4).alias("importance"))
    if current_only:
        out = out.join(superseded(memories), "id", "left_anti")
    else:
        from .history import chain_members

        more = chain_members(memories, out.select("query", "id")).join(out.select("query", "id"), ["query", "id"], "left_anti")
        extra = more.join(memories, "id").join(out.select("query", "method").distinct(), "query")
        out = out.unionByName(extra.select("query", "id", "content", "tier", "source", F.lit(0.0).alias("score"), "method", F.lit(None).cast("double").alias("importance")))
    return top(out, limit, F.desc("score"), F.col("id")).select("query", "id", "content", "tier", "source", "score", "method", "importance")
