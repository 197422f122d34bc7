"""Batched BM25: one job ranks many questions over one corpus.

Scores are those of Okapi BM25 with k1 = 1.5 and b = 0.75; an inverse document frequency below zero becomes a quarter
of the mean over all terms.  Ties keep the order of the documents' ids.  Statistics are those of the corpus given, so
filter it first where they should follow a filter.

Nothing that grows with the corpus's (document, term) pairs is shuffled.  Document frequencies are counted from each
document's distinct terms, combined in each task; `retrieve` scores within the documents' own tasks (`scoring`), and `bm25`
gives every pair that shares a term, counting occurrences only for the terms that questions ask.  `Index`
keeps both as plain tables; an index that follows upserts and deletes is in `segments`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions.text import index_tokens, run_lengths, tokens
from folioscan.operators.scoring import best_documents
from folioscan.operators.settle import settled

K1, B, FLOOR = 1.5, 0.75, 0.25


def document_terms(corpus: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, terms)."""
    return corpus.select(F.col(doc_id).alias("doc_id"), index_tokens(F.col(text)).alias("terms"))


def term_frequencies(corpus: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, term, tf, dl), counted within each row: no shuffle."""
    t = document_terms(corpus, doc_id, text)
    each = t.select("doc_id", F.size("terms").cast("long").alias("dl"), F.explode(run_lengths(F.col("terms"))).alias("x"))
    return each.select("doc_id", F.col("x.value").alias("term"), "dl", F.col("x.n").alias("tf"))


def vocabulary(corpus: DataFrame, text: str = "text") -> DataFrame:
    """(term, df, idf, n_docs, mean_length): one pass over the corpus, in which each task counts before the shuffle.

    The mean that floors negative values is over all terms, negative ones included.
    """
    t = corpus.select(index_tokens(F.col(text)).alias("terms"))
    # the first word of each document also carries the document and its length, so that no second pass is needed
    each = t.select(F.size("terms").alias("dl"), F.posexplode(F.array_distinct("terms")).alias("i", "term"))
    first = F.col("i") == 0
    # settled, as the corpus would be read again for each of the two rows of statistics and once more for the terms
    df = settled(each.groupBy("term").agg(F.count("*").alias("df"), F.count_if(first).alias("docs"), F.sum(F.when(first, F.col("dl")).otherwise(0)).alias("length")))
    every = df.agg(F.sum("docs").alias("n_docs"), (F.sum("length") / F.sum("docs")).alias("mean_length"))
    raw = df.crossJoin(F.broadcast(every)).select("term", "df", "n_docs", "mean_length", (F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))  # one row
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, FLOOR * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"), "n_docs", "mean_length")


def term_counts(corpus: DataFrame, text: str = "text") -> DataFrame:
    """(term, df, cf): documents with a term and its occurrences."""
    each = corpus.select(F.explode(run_lengths(index_tokens(F.col(text)))).alias("x"))
    return each.groupBy(F.col("x.value").alias("term")).agg(F.count("*").alias("df"), F.sum("x.n").alias("cf"))


def query_terms(queries: DataFrame, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, term, qf): a repeated word counts each time."""
    return queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))


def asked_frequencies(corpus: DataFrame, asked: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, term, tf, dl) of the terms in `asked` alone: other words go before anything is shuffled."""
    t = document_terms(corpus, doc_id, text)
    words = t.select("doc_id", F.size("terms").cast("long").alias("dl"), F.explode("terms").alias("term"))
    return words.join(asked.select("term").distinct(), "term", "left_semi").groupBy("doc_id", "term", "dl").agg(F.count("*").alias("tf"))


def scored(hits: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) from rows with qf, idf, tf, dl and mean_length; rounded to six digits."""
    part = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean_length")))
    return hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def bm25(corpus: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, doc_id, score) of the pairs that share a term."""
    asked = query_terms(queries)
    weights = vocabulary(corpus, text).join(asked, "term")
    return scored(asked_frequencies(corpus, asked, doc_id, text).join(weights, "term"))


@dataclass
class Index:
    """A corpus's postings (term, doc_id, tf, dl) and vocabulary as plain tables; `segments` has the index that follows changes."""

    postings: DataFrame
    terms: DataFrame

    @staticmethod
    def of(corpus: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
        """Postings sorted by term, so that readers of the stored table skip what a batch doesn't ask."""
        postings = term_frequencies(corpus, doc_id, text)
        return Index(postings.repartition("term").sortWithinPartitions("term"), vocabulary(corpus, text))

    def tables(self) -> dict[str, DataFrame]:
        return {"postings": self.postings, "terms": self.terms}

    def bm25(self, queries: DataFrame) -> DataFrame:
        weights = self.terms.join(query_terms(queries), "term")
        return scored(self.postings.join(weights, "term"))


def top_ranked(scored: DataFrame, k: int, score: str = "score", tie: str | Column = "doc_id") -> DataFrame:
    """Rank within each question, cut to k."""
    tie = F.col(tie) if isinstance(tie, str) else tie
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), tie)).cast("long")).where(F.col("rank") <= k)


def best(corpus: DataFrame, queries: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), scope: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score and the columns in `keep`) that hold each question's k best documents of more than zero; `scope` as
    in `scoring.best_documents`."""
    terms = corpus.select(F.col(doc_id).alias("doc_id"), *keep, index_tokens(F.col(text)).alias("terms"))
    weights = settled(vocabulary(corpus, text).join(query_terms(queries), "term").select("query_id", "term", (F.col("qf") * F.col("idf")).alias("w"), "mean_length"))
    any_ = weights.first()
    found = best_documents(terms, weights, any_["mean_length"], k, scope) if any_ else None
    out = found if found is not None else terms.crossJoin(queries.select("query_id")).where("false").withColumn("score", F.lit(0.0))
    return out.select("query_id", "doc_id", *keep, "score")


def retrieve(corpus: DataFrame, queries: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, doc_id, score, rank): cut to k first, then scores of zero or less go."""
    return top_ranked(best(corpus, queries, k, doc_id, text), k)


def retrieve_indexed(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """As retrieve, from a kept index."""
    return top_ranked(index.bm25(queries), k).where("score > 0")
