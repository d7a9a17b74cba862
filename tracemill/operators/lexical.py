"""Lexical ranking: postings, document frequencies, scores and top-k, over one corpus or per pool."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.text import text, tokenize

#: Scores this close may be equal when rounded to six digits, whatever the order of their sums.
SLACK = 2e-6


def passage_text(title: Column, body: Column) -> Column:
    return F.concat_ws(" ", text(title), text(body))


def postings(corpus: DataFrame, key: Sequence[str], body: Column) -> DataFrame:
    """(*key, term, tf, doc_len): one row for each different term of a document. The counts are made inside
    the row, so the tokens themselves are never shuffled."""
    tokens = corpus.select(*key, tokenize(body).alias("tokens"))
    term = F.explode(F.array_distinct("tokens")).alias("term")
    rows = tokens.select(*key, "tokens", F.size("tokens").alias("doc_len"), term)
    return rows.select(*key, "term", F.size(F.filter("tokens", lambda t: t == F.col("term"))).alias("tf"), "doc_len")


def document_frequency(posts: DataFrame, pool: Sequence[str] = ()) -> DataFrame:
    """(*pool, term, df): in how many documents a term stands; partial counts meet, not documents."""
    return posts.groupBy(*pool, "term").agg(F.count("*").alias("df"))


class Block:
    """The postings of a batch of documents for the terms that are asked, in arrays.

    ``key`` (document * terms + term, ascending) and ``tf``, and ordered by term and falling ``impact`` (tf / length)
    the ``document`` of each posting; ``start`` is where each term begins there."""

    def __init__(self, tokens: pa.Array, terms: pa.Array) -> None:
        flat, self.n_terms = tokens.flatten(), len(terms)
        length = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        term = pc.fill_null(pc.index_in(flat, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        document = np.repeat(np.arange(len(length)), length)
        self.length = length
        self.key, self.tf = np.unique((document * self.n_terms + term)[term >= 0], return_counts=True)
        document, term = np.divmod(self.key, max(1, self.n_terms))
        impact = self.tf / length[document]
        by = np.lexsort((-impact, term))
        self.document, self.term, self.impact = document[by], term[by], impact[by]
        self.start = np.searchsorted(self.term, np.arange(self.n_terms + 1))

    def frequency(self, document: np.ndarray, term: np.ndarray) -> np.ndarray:
        """How often each term stands in the document beside it."""
        if not len(self.key):
            return np.zeros(len(document), np.int64)
        wanted = document * self.n_terms + term
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(self.key[at] == wanted, self.tf[at], 0)


class Asked:
    """Different queries with the weight qtf * idf of each of their terms, in the arrays ``query``, ``term``, ``weight``
    (by query; ``first`` is where each begins), and a lower bound of each query's k-th best score."""

    def __init__(self, bags: list[str], terms: list[str], idf: np.ndarray, df: np.ndarray, kth: np.ndarray, k: int) -> None:
        index = {t: i for i, t in enumerate(terms)}
        query, term, qtf = [], [], []
        for i, bag in enumerate(bags):
            own = bag.split(" ")
            for t in dict.fromkeys(own):
                query.append(i)
                term.append(index[t])
                qtf.append(own.count(t))
        self.query, self.term = np.array(query, np.int64), np.array(term, np.int64)
        self.weight = np.array(qtf, np.float64) * idf[self.term]
        self.first = np.searchsorted(self.query, np.arange(len(bags) + 1))
        self.share = self.weight * kth[self.term]
        self.bound = np.zeros(len(bags))
        # k documents have at least the k-th best impact of a term
        np.maximum.at(self.bound, self.query, np.where(df[self.term] >= k, self.share, 0.0))

    def candidates(self, block: Block, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, document) of all that may reach ``bound``, each once.

        Every term of a query is given a part of its bound: the terms of least weight all that they can give in this
        block, the others the rest among them. A document below all parts is below the bound."""
        filled = block.start[1:] > block.start[:-1]
        most = np.where(filled, block.impact[np.minimum(block.start[:-1], len(block.impact) - 1)], 0.0)[self.term] * self.weight
        by = np.lexsort((most, self.query))
        total = np.cumsum(most[by])
        before = np.concatenate([[0.0], total])[self.first[self.query[by]]]
        spent = np.empty(len(by))
        spent[by] = total - before
        goal = np.maximum(bound - SLACK, 0)
        idle = spent < goal[self.query] * (1 - 1e-9) - 1e-9
        used = np.bincount(self.query, np.where(idle, most, 0.0), len(bound))
        shares = np.bincount(self.query, np.where(idle, 0.0, self.share), len(bound))
        left = np.maximum(goal - used, 0) / np.where(shares > 0, shares, 1)
        pair = np.flatnonzero(~idle & filled[self.term])
        query, term = self.query[pair], self.term[pair]
        cut = left[query] * self.share[pair] / self.weight[pair]
        # postings by term and falling impact, as one ascending number
        place = 2.0 * block.term + 1 - block.impact
        end = np.searchsorted(place, 2.0 * term + 1 - cut + 1e-7, "right")
        n = np.minimum(end, block.start[term + 1]) - block.start[term]
        n = np.maximum(n, 0)
        posting = np.repeat(block.start[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
        size = max(1, len(block.length))
        return np.divmod(np.unique(np.repeat(query, n) * size + block.document[posting]), size)

    def scores(self, block: Block, query: np.ndarray, document: np.ndarray) -> np.ndarray:
        n = self.first[query + 1] - self.first[query]
        start = np.cumsum(n) - n
        pair = np.repeat(self.first[query] - start, n) + np.arange(n.sum())
        own = np.repeat(document, n)
        part = self.weight[pair] * block.frequency(own, self.term[pair]) / block.length[own]
        return np.add.reduceat(part, start) if len(start) else part


def _best(kept: np.ndarray, query: np.ndarray, score: np.ndarray) -> None:
    """Take the scores into ``kept``, the k best of each query."""
    k = kept.shape[1]
    by = np.lexsort((-score, query))
    query, score = query[by], score[by]
    seen, first = np.unique(query, return_index=True)
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    new = np.full((len(seen), k), 0.0)
    top = place < k
    new[np.searchsorted(seen, query[top]), place[top]] = score[top]
    kept[seen] = -np.sort(-np.hstack([kept[seen], new]), axis=1)[:, :k]


def _term_statistics(docs: DataFrame, terms: pa.Array, k: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(documents, df, k-th best impact) over the whole corpus; of a term in less than k documents the least impact
    among them, which only weighs the parts of a bound."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        n, df, top = 0, np.zeros(len(own), np.int64), np.zeros((len(own), k))
        for batch in batches:
            block = Block(batch.column("tokens"), own)
            n += batch.num_rows
            df += np.diff(block.start)
            _best(top, block.term, block.impact)
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": np.append(there, -1), "df": np.append(df[there], n), "top": pa.array([*top[there].tolist(), []], pa.list_(pa.float64()))})

    parts = docs.select("tokens").mapInArrow(count, "term long, df long, top array<double>")
    best = F.slice(F.sort_array(F.filter(F.flatten(F.collect_list("top")), lambda x: x > 0), asc=False), 1, k)
    rows = parts.groupBy("term").agg(F.sum("df").alias("df"), best.alias("top")).select("term", "df", F.try_element_at("top", F.lit(-1)).alias("kth")).toArrow()
    term, count_, kth = (rows.column(c).to_numpy() for c in ("term", "df", "kth"))
    df, least = np.zeros(len(terms), np.int64), np.zeros(len(terms))
    df[term[term >= 0]], least[term[term >= 0]] = count_[term >= 0], kth[term >= 0]
    return int(count_[term < 0].sum()), df, least


def _rank_corpus(queries: DataFrame, corpus: DataFrame, k: int, query_key: str, query: Column, doc_key: str, body: Column) -> DataFrame:
    """``rank`` without pools: the queries' terms are broadcast and the corpus is read in blocks. Equal queries are
    scored once; a document is scored if it may reach the k-th best score, of which the statistics of the terms give a
    lower bound that rises with the documents a task has seen."""
    spark = corpus.sparkSession
    asked = queries.groupBy(query_key).agg(F.array_join(F.sort_array(F.flatten(F.collect_list(tokenize(query)))), " ").alias("bag")).where("bag != ''")
    bags = asked.select("bag").distinct().orderBy("bag").toArrow().column("bag").to_pylist()
    terms = sorted({t for bag in bags for t in bag.split(" ")})
    docs = corpus.select(doc_key, tokenize(body).alias("tokens"))
    names = pa.array(terms, pa.string())
    n, df, kth = _term_statistics(docs, names, k) if terms else (0, np.zeros(0), np.zeros(0))
    made = Asked(bags, terms, np.log((n + 1.0) / (df + 1.0)) + 1.0, df, kth, k)
    shared = spark.sparkContext.broadcast((names, pa.array(bags, pa.string()), made))
    kind = docs.schema[doc_key].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, texts, ask = shared.value
        kept = np.zeros((len(texts), k))
        for batch in batches:
            block = Block(batch.column("tokens"), own)
            if not len(block.key):
                continue
            found, document = ask.candidates(block, np.maximum(ask.bound, kept[:, -1]))
            score = ask.scores(block, found, document)
            _best(kept, found, score)
            good = (score > 0) & (score >= np.maximum(ask.bound, kept[:, -1])[found] - SLACK)
            yield pa.RecordBatch.from_arrays([texts.take(pa.array(found[good])), batch.column(doc_key).take(pa.array(document[good])), pa.array(score[good])], ["bag", doc_key, "score"])

    hits = docs.mapInArrow(search, f"bag string, `{doc_key}` {kind}, score double").withColumn("score", F.round("score", 6))
    w = Window.partitionBy("bag").orderBy(F.desc("score"), doc_key)
    best = hits.where("score > 0").withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
    return asked.join(best, "bag").select(query_key, doc_key, "score", "rank")


def rank(queries: DataFrame, corpus: DataFrame, k: int, query_key: str, query: Column, doc_key: str, body: Column, pool: Sequence[str] = ()) -> DataFrame:
    """(*pool, query_key, doc_key, score, rank): the k best documents of each query.

    A score is the sum over the query's terms, with their repeats, of (ln((N + 1) / (df + 1)) + 1) * tf / length;
    ties go to the smaller ``doc_key`` (the position in the corpus). Documents that share no term have no row.
    ``doc_key`` is unique. With ``pool``, every pool of documents (a column both sides have) has its own statistics and ranks.

    Pools are small: their terms join by hash, adaptive execution splits hot ones, and scores are summed before the
    window. One corpus for all is read in blocks, where only documents are scored that may be among the k best.
    """
    if not pool:
        return _rank_corpus(queries, corpus, k, query_key, query, doc_key, body)
    asked = queries.select(*pool, query_key, F.explode(tokenize(query)).alias("term")).groupBy(*pool, query_key, "term").agg(F.count("*").alias("qtf"))
    posts = postings(corpus, [*pool, doc_key], body)
    df = document_frequency(posts, pool)
    size = corpus.groupBy(*pool).agg(F.count("*").alias("n_docs"))
    terms = asked.select(*pool, "term").distinct()
    weights = terms.join(df, [*pool, "term"])
    weights = weights.join(size, list(pool)).withColumn("idf", F.log((F.col("n_docs") + 1.0) / (F.col("df") + 1.0)) + 1.0).select(*pool, "term", "idf")
    hits = asked.join(weights, [*pool, "term"]).join(posts, [*pool, "term"])
    part = F.col("qtf") * F.col("idf") * F.col("tf") / F.col("doc_len")
    scores = hits.groupBy(*pool, query_key, doc_key).agg(F.round(F.sum(part), 6).alias("score"))
    w = Window.partitionBy(*pool, query_key).orderBy(F.desc("score"), doc_key)
    return scores.where("score > 0").withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def rank_reward(r: Column) -> Column:
    """1 for the first place, 0.8 to the third, 0.5 to the eighth, 0 beyond."""
    return F.when(r <= 1, 1.0).when(r <= 3, 0.8).when(r <= 8, 0.5).otherwise(0.0)
