"""Lexical, dense and visual retrieval: for a stated set of queries the k best documents of a corpus.

A bounded set of queries is sent to the corpus, which is scanned and not shuffled: each task returns its k best, and
these are merged by a window whose limit runs before the shuffle. More queries meet the corpus in blocks of fixed size
(substrings, inner products, bit patterns) or by equi-joins on the term with partial aggregates (BM25). Ties go to the smaller document id, as a stable sort of the corpus would give.

Null texts have no terms; null vectors are left out; an empty side gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracequarry.functions.textnorm import ascii_tokens

QUERY_BLOCK = 2_000
CORPUS_BLOCK = 50_000
#: Scores held at once in a scan (8 bytes each).
SCORE_CELLS = 4_000_000
#: Queries, and bytes of them as text, that are sent to the corpus instead of being met in blocks.
SENT_QUERIES, SENT_BYTES = 10_000, 1 << 25


def top_k(scored: DataFrame, k: int, query: str = "q", doc: str = "doc", score: str = "score") -> DataFrame:
    """The k best of each query, with their rank from 1."""
    w = W.partitionBy(query).orderBy(F.desc(score), doc)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def may_be_sent(queries: DataFrame) -> bool:
    """Whether a set of queries is within SENT_QUERIES rows and SENT_BYTES."""
    size = queries.select(F.octet_length(F.to_json(F.struct("*"))).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes")).first()
    return size["n"] <= SENT_QUERIES and size["bytes"] <= SENT_BYTES


def in_blocks(queries: DataFrame, corpus: DataFrame, score: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The scores of every query against every corpus row; the first column of each side is its id.

    Up to ``SENT_QUERIES`` queries of ``SENT_BYTES`` are sent to the corpus, which is scanned once and not shuffled; each batch returns its k best.
    More are met in a cogroup of every (query block, corpus block).
    """
    q_id, c_id = queries.columns[0], corpus.columns[0]
    if may_be_sent(queries):
        few = queries.toPandas()
        shared = corpus.sparkSession.sparkContext.broadcast([few.iloc[at : at + QUERY_BLOCK] for at in range(0, len(few), QUERY_BLOCK)])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, n = [], 0
            for batch in batches:
                held.append(batch)
                n += len(batch)
                if n >= CORPUS_BLOCK:
                    yield from (score(q, pd.concat(held)) for q in shared.value)
                    held, n = [], 0
            if n:
                yield from (score(q, pd.concat(held)) for q in shared.value)

        return corpus.mapInPandas(run, schema)
    n, m = max(1, math.ceil(queries.count() / QUERY_BLOCK)), max(1, math.ceil(corpus.count() / CORPUS_BLOCK))
    q = queries.withColumn("qb", F.pmod(F.xxhash64(q_id), F.lit(n)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    c = corpus.withColumn("cb", F.pmod(F.xxhash64(c_id), F.lit(m)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    keys, spread = ["qb", "cb"], 2 * n * m
    return q.repartition(spread, *keys).groupBy(*keys).cogroup(c.repartition(spread, *keys).groupBy(*keys)).applyInPandas(lambda a, b: score(a, b) if len(a) and len(b) else _empty(schema), schema)


def _empty(schema: str) -> pd.DataFrame:
    kinds = {"bigint": np.int64, "double": np.float64, "int": np.int32, "string": object}
    return pd.DataFrame({n: np.zeros(0, kinds[t]) for n, t in (f.split() for f in schema.split(", "))})


def _best(q: np.ndarray, doc: np.ndarray, s: np.ndarray, k: int) -> pd.DataFrame:
    out = pd.DataFrame({"q": q, "doc": doc, "score": s}).sort_values(["q", "score", "doc"], ascending=[True, False, True])
    return out.groupby("q", sort=False).head(k)


def substring_search(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(q, doc, score, rank): number of distinct query tokens that occur anywhere in the document's lower-case
    text. Documents that match nothing fill up to k, in order of id. Queries (id, text), corpus (id, text).

    The tokens of a query block form one Aho-Corasick automaton; each text is read once.
    """

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        import re

        import ahocorasick

        holders: dict[str, list[int]] = {}
        for i, text in enumerate(a.iloc[:, 1]):
            for t in set(re.findall("[a-z0-9]+", (text or "").lower())):
                holders.setdefault(t, []).append(i)
        machine = ahocorasick.Automaton()
        for t in holders:
            machine.add_word(t, t)
        if holders:
            machine.make_automaton()
        ids = a.iloc[:, 0].to_numpy()
        b = b.sort_values(b.columns[0])
        rows: dict[int, dict[int, int]] = {i: {} for i in range(len(a))}
        docs = b.iloc[:, 0].to_numpy()
        for j, text in enumerate(b.iloc[:, 1]):
            if text and holders:
                for t in {t for _, t in machine.iter(text.lower())}:
                    for i in holders[t]:
                        rows[i][j] = rows[i].get(j, 0) + 1
        out = []
        for i, found in rows.items():
            best = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k]
            best += [(j, 0) for j in range(min(len(docs), k + len(best))) if j not in found][: k - len(best)]
            out += [(ids[i], docs[j], float(s)) for j, s in best]
        return pd.DataFrame(out, columns=["q", "doc", "score"]) if out else _empty("q bigint, doc bigint, score double")

    return top_k(in_blocks(queries, corpus, score, "q bigint, doc bigint, score double"), k)


def postings(corpus: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, term, tf, len): terms of every document with at least one term."""
    t = corpus.select(F.col(doc).alias("doc"), ascii_tokens(F.col(text)).alias("terms")).where("size(terms) > 0")
    return t.select("doc", F.size("terms").alias("len"), F.explode("terms").alias("term")).groupBy("doc", "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(queries: DataFrame, corpus: DataFrame, q_id: str, q_text: str, doc: str, text: str, k1: float, b: float, logged: bool) -> DataFrame:
    """(q, doc, score) of documents sharing a term. Repeated query terms count each time.

    ``logged``: idf = ln(1 + (N - df + .5) / (df + .5)); else max(0, (N - df + .5) / (df + .5)), without logarithm.
    """
    post = postings(corpus, doc, text)
    docs = corpus.select(ascii_tokens(F.col(text)).alias("t")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.greatest(F.size("t"), F.lit(0))), F.lit(1.0)).alias("avg"))  # one row
    asked = queries.select(F.col(q_id).alias("q"), F.explode(ascii_tokens(F.col(q_text))).alias("term")).groupBy("q", "term").agg(F.count(F.lit(1)).alias("qtf"))
    wanted = post.join(asked.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    x = wanted.join(df, "term").join(F.broadcast(docs))
    odds = (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)
    idf = F.log(1 + odds) if logged else F.greatest(F.lit(0.0), odds)
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    return x.select("doc", "term", weight.alias("w")).join(asked, "term").groupBy("q", "doc").agg(F.sum(F.col("w") * F.col("qtf")).alias("score")).where("score > 0")


class TermScores:
    """BM25 of a bounded set of queries, sent to the corpus: the queries by term, the terms' weights, the mean length."""

    def __init__(self, ids: list, by_term: dict[str, list[tuple[int, int]]], idf: dict[str, float], mean: float, k1: float, b: float):
        self.ids = np.asarray(ids, dtype=np.int64)
        self.holders = {t: (np.array([q for q, _ in own]), np.array([n for _, n in own], dtype=np.float64) * idf[t]) for t, own in by_term.items() if idf.get(t, 0.0) > 0}
        self.mean, self.k1, self.b = mean, k1, b

    @classmethod
    def of(cls, queries: DataFrame, corpus: DataFrame, q_id: str, q_text: str, text: str, k1: float, b: float, logged: bool) -> TermScores | None:
        """None if there are more queries than may be sent. Two aggregates of the corpus: its size and mean length, and the
        number of documents of each queried term."""
        if not may_be_sent(queries):
            return None
        few = queries.select(q_id, ascii_tokens(F.col(q_text)).alias("t")).collect()
        by_term: dict[str, dict[int, int]] = {}
        for i, (_, terms) in enumerate(few):
            for t in terms or ():
                own = by_term.setdefault(t, {})
                own[i] = own.get(i, 0) + 1
        spark = corpus.sparkSession
        terms = ascii_tokens(F.col(text))
        size = corpus.select(F.coalesce(F.greatest(F.size(terms), F.lit(0)), F.lit(0)).alias("n")).agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean")).first()
        asked = spark.createDataFrame([(t,) for t in sorted(by_term)], "term string")  # terms of at most SENT_QUERIES queries
        found = corpus.select(F.explode(F.array_distinct(terms)).alias("term")).join(F.broadcast(asked), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()
        odds = {r["term"]: (size["docs"] - r["df"] + 0.5) / (r["df"] + 0.5) for r in found}
        idf = {t: math.log(1 + x) if logged else max(0.0, x) for t, x in odds.items()}
        return cls([i for i, _ in few], {t: list(own.items()) for t, own in by_term.items()}, idf, size["mean"] or 1.0, k1, b)

    def blocks(self, batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(document ids, scores [document, query]) of a few documents at a time; columns id, terms."""
        most = max(1, SCORE_CELLS // max(1, self.ids.size))
        for batch in batches:
            ids, terms = batch.iloc[:, 0].to_numpy(), batch.iloc[:, 1].tolist()
            for at in range(0, len(ids), most):
                scores = np.zeros((min(most, len(ids) - at), self.ids.size))
                for row, own in enumerate(terms[at : at + most]):
                    if own is None:
                        continue
                    drag = self.k1 * (1 - self.b + self.b * len(own) / self.mean)
                    for term, tf in Counter(own).items():
                        if (held := self.holders.get(term)) is not None:
                            scores[row, held[0]] += held[1] * (tf * (self.k1 + 1) / (tf + drag))
                yield ids[at : at + most], np.round(scores, 6)


def bm25_search(queries: DataFrame, corpus: DataFrame, q_id: str, q_text: str, doc: str, text: str, k1: float, b: float, logged: bool, k: int) -> DataFrame:
    """(q, doc, score, rank): the k best documents of each query by ``bm25``, scores rounded to 6 decimals, above 0.

    The queries are sent to the corpus, whose scan returns k documents a query and task: a term in all documents and all queries
    costs no shuffle. More queries than ``SENT_QUERIES`` are joined by term.
    """
    model = TermScores.of(queries, corpus, q_id, q_text, text, k1, b, logged)
    if model is None:
        return top_k(bm25(queries, corpus, q_id, q_text, doc, text, k1, b, logged).withColumn("score", F.round("score", 6)), k)
    shared = corpus.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        least, held, size = np.zeros(own.ids.size), [], 0
        prune = lambda: _best(*(np.concatenate(x) for x in zip(*held)), k)
        for docs, scores in own.blocks(batches):
            row, col = np.nonzero((scores >= least) & (scores > 0))
            held.append((col, docs[row], scores[row, col]))
            size += row.size
            if size > 1_000_000:
                best = prune()
                worst = best.groupby("q")["score"].agg(["min", "size"])
                full = worst[worst["size"] == k]
                least[full.index.to_numpy()] = full["min"].to_numpy()  # equal ones may have a smaller id
                held, size = [(best["q"].to_numpy(), best["doc"].to_numpy(), best["score"].to_numpy())], len(best)
        if held:
            best = prune()
            yield best.assign(q=own.ids[best["q"].to_numpy()])

    found = corpus.select(F.col(doc).alias("doc"), ascii_tokens(F.col(text)).alias("t")).mapInPandas(run, "q bigint, doc bigint, score double")
    return top_k(found, k)


def bm25_ranks(relevant: DataFrame, queries: DataFrame, corpus: DataFrame, q_id: str, q_text: str, doc: str, text: str, k1: float, b: float, logged: bool) -> DataFrame:
    """(q, rank) of the best document of each query among its relevant ones (q, doc), for queries with one that scores.

    The relevant pairs are scored by a join on their documents; a scan of the corpus counts the documents that score
    higher, or equally with a smaller id.
    """
    model = TermScores.of(queries, corpus, q_id, q_text, text, k1, b, logged)
    if model is None:
        scored = bm25(queries, corpus, q_id, q_text, doc, text, k1, b, logged).withColumn("score", F.round("score", 6))
        return best_ranks(scored.join(relevant, ["q", "doc"]), scored)
    shared = corpus.sparkSession.sparkContext.broadcast(model)
    docs = corpus.select(F.col(doc).alias("doc"), ascii_tokens(F.col(text)).alias("t"))
    pairs = docs.join(relevant, "doc").select("doc", "t", "q")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        place = {int(i): n for n, i in enumerate(own.ids)}
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000].reset_index(drop=True)
                out = [scores[np.arange(ids.size), [place[int(q)] for q in part["q"].iloc[lo : lo + ids.size]]] for lo, ids, scores in _numbered(own.blocks(iter([part])))]
                yield pd.DataFrame({"q": part["q"], "doc": part["doc"], "score": np.concatenate(out)})

    best = pairs.mapInPandas(score, "q bigint, doc bigint, score double").where("score > 0").groupBy("q").agg(F.max(F.struct("score", (-F.col("doc")).alias("o"))).alias("b"))
    known = {r["q"]: (r["b"]["score"], -r["b"]["o"]) for r in best.collect()}  # one row a query that was sent

    def ahead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        least, first = (np.array([known.get(int(q), (np.inf, -1))[i] for q in own.ids], dtype=float) for i in (0, 1))
        count = np.zeros(own.ids.size, np.int64)
        for ids, scores in own.blocks(batches):
            count += ((scores > least) | ((scores == least) & (ids[:, None] < first))).sum(axis=0)
        yield pd.DataFrame({"q": own.ids, "n": count})

    counted = docs.mapInPandas(ahead, "q bigint, n bigint").groupBy("q").agg((F.sum("n") + 1).alias("rank"))
    return counted.join(corpus.sparkSession.createDataFrame([(q,) for q in known], "q bigint"), "q", "left_semi")


def _numbered(blocks):
    at = 0
    for ids, scores in blocks:
        yield at, ids, scores
        at += ids.size


def dense_search(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(q, doc, score, rank) by inner product of the normalised vectors; (id, vector) on both sides.

    A zero vector scores 0 with everything.
    """

    def unit(column: pd.Series) -> np.ndarray:
        v = np.array([np.asarray(x, dtype=np.float64) for x in column])
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(n == 0, 1, n)

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(b.columns[0])
        s = np.round(unit(a.iloc[:, 1]) @ unit(b.iloc[:, 1]).T, 9)
        keep = min(k, s.shape[1])
        top = np.argsort(-s, axis=1, kind="stable")[:, :keep]
        q = np.repeat(a.iloc[:, 0].to_numpy(), keep)
        return pd.DataFrame({"q": q, "doc": b.iloc[:, 0].to_numpy()[top.ravel()], "score": np.take_along_axis(s, top, axis=1).ravel()})

    whole = lambda x: x.where(F.col(x.columns[1]).isNotNull())
    return top_k(in_blocks(whole(queries), whole(corpus), score, "q bigint, doc bigint, score double"), k)


def visual_search(queries: DataFrame, corpus: DataFrame, k: int, bit_weight: float = 0.7) -> DataFrame:
    """(q, doc, score, rank): 0.7 * share of equal bits + 0.3 * histogram intersection; (id, bits, hist) on both
    sides. Vectors of another length score 0 in their part."""

    def by_length(column: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        places: dict[int, list[int]] = {}
        for i, v in enumerate(column):
            if v is not None and len(v):
                places.setdefault(len(v), []).append(i)
        return {n: (np.array(at), np.array([np.asarray(column.iloc[i], dtype=float) for i in at])) for n, at in places.items()}

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        bits_of, hist_of, docs = by_length(b.iloc[:, 1]), by_length(b.iloc[:, 2]), b.iloc[:, 0].to_numpy()
        out = []
        for qid, bits, hist in a.iloc[:, :3].itertuples(index=False):
            total = np.zeros(len(b))
            if bits is not None and len(bits) in bits_of:
                at, m = bits_of[len(bits)]
                total[at] += bit_weight * (m == np.asarray(bits, dtype=float)).mean(axis=1)
            if hist is not None and len(hist) in hist_of:
                at, m = hist_of[len(hist)]
                total[at] += (1 - bit_weight) * np.nansum(np.minimum(m, np.asarray(hist, dtype=float)), axis=1)
            out.append(_best(np.full(len(b), qid), docs, np.round(total, 9), k))
        return pd.concat(out) if out else _empty("q bigint, doc bigint, score double")

    return top_k(in_blocks(queries, corpus, score, "q bigint, doc bigint, score double"), k)


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, as a dictionary filled in order would keep it."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def align_runs(a: DataFrame, b: DataFrame, key: str, order: str) -> DataFrame:
    """Inner join of two runs on a derived key, the last row of each key on either side."""
    x = last_wins(a, key, order).select(key, *[F.col(c).alias(f"a_{c}") for c in a.columns if c != key])
    return x.join(last_wins(b, key, order).select(key, *[F.col(c).alias(f"b_{c}") for c in b.columns if c != key]), key)


def best_ranks(relevant: DataFrame, scored: DataFrame) -> DataFrame:
    """(q, rank) of the best relevant document of each query: 1 and the number of documents that score higher, or equally
    with a smaller id. Both sides are (q, doc, score); relevant documents are few, all others are only counted."""
    best = relevant.groupBy("q").agg(F.max(F.struct("score", (-F.col("doc")).alias("o"))).alias("b")).select("q", F.col("b.score").alias("_s"), (-F.col("b.o")).alias("_d"))
    ahead = (F.col("score") > F.col("_s")) | ((F.col("score") == F.col("_s")) & (F.col("doc") < F.col("_d")))
    return scored.join(best, "q").groupBy("q").agg((F.count_if(ahead) + 1).alias("rank"))


def rank_metrics(ranked: DataFrame, query: str = "q", rank: str = "rank", n_docs: int | None = None) -> DataFrame:
    """One row: top1, top3, top5, MRR, mean rank; a null rank is a miss (rank ``n_docs`` + 1, reciprocal 0)."""
    r = F.col(rank)
    hit = lambda k: F.avg(F.coalesce((r <= k).cast("double"), F.lit(0.0)))
    miss = F.lit((n_docs or 0) + 1)
    return ranked.agg(F.count(F.lit(1)).alias("n"), *[F.round(hit(k), 6).alias(f"top{k}") for k in (1, 3, 5)], F.round(F.avg(F.coalesce(1 / r, F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.coalesce(r, miss)), 6).alias("mean_rank"))
