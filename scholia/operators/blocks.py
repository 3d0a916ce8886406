"""Search of whole lists: each request meets all documents of an index inside one task.

Fusion by reciprocal ranks needs the rank of every document in every list of a
request, which as a plan of joins and windows shuffles all pairs. Here requests
are dealt out to as many blocks as there are cores and each block gets the
packed documents; the scores of a list are one vector over them. No pair leaves
a task: what is shuffled is the documents once per block and the requests once.
A task holds about 12 bytes per distinct term of a document and weighing, and
``DENSE`` numbers for frequent terms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from scholia.functions.tokens import token_rows
from scholia.operators.hybrid import Knobs
from scholia.operators.retrieval import K1, B, top_k

#: Scores are whole numbers of this part, which is their rounding to nine decimals.
UNIT = 1e9
#: Documents indexed at once, numbers in the matrix of frequent terms, and scores of the lists worked on together.
SEGMENT, DENSE, SCORES = 1 << 16, 1 << 24, 1 << 22


def half_up(x, decimals: int = 9):
    return np.floor(x * 10.0**decimals + 0.5) / 10.0**decimals


def counted(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, terms, counts): the distinct terms of a text, by their 64-bit hash, and how often each stands in it. Texts without terms have no row."""
    tf = token_rows(texts, keys, text).groupBy(*keys, "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    return tf.groupBy(*keys).agg(F.collect_list(F.xxhash64("term")).alias("terms"), F.collect_list("tf").alias("counts"))


@dataclass
class Listed:
    """One list of a request: its axis and weighing, the share of its weight that the index knows, whether any document has a term of it, and the score of each document in units."""

    axis: str
    weighing: str
    coverage: float
    met: bool
    units: np.ndarray


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists end to end, and their numbers; a null has none."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


class Index:
    """Documents, in the order of their ids, by term."""

    def __init__(self, weighings: tuple[str, ...]) -> None:
        self.weighings, self.ids, self.n, self._rows = weighings, [], 0, []

    def add(self, ids: pa.Array, terms: pa.Array, counts: pa.Array) -> None:
        (term, size), (count, _) = _lists(terms), _lists(counts)
        self.ids += [ids]
        self._rows.append((np.repeat(np.arange(self.n, self.n + len(ids), dtype=np.int32), size), term, count.astype(np.int32)))
        self.n += len(ids)

    def close(self, mean: float | None = None) -> None:
        """Sorts what was added by term, one segment of documents at a time. ``mean`` is the mean length where these are not all documents."""
        rows, self._rows = self._rows, []
        lengths, squares = np.zeros(self.n), np.zeros(self.n)
        for doc, _, count in rows:
            lengths += np.bincount(doc, count, self.n)
            squares += np.bincount(doc, count.astype(float) ** 2, self.n)
        mean = mean or (lengths.mean() if self.n else 1.0) or 1.0
        self.segments = []
        while rows:
            part, held = [rows.pop(0)], 0
            while rows and (held := held + len(np.unique(part[-1][0]))) < SEGMENT:
                part.append(rows.pop(0))
            doc, term, count = map(np.concatenate, zip(*part))
            order = np.argsort(term, kind="stable")
            doc, term, count = doc[order], term[order], count[order].astype(float)
            known, first = np.unique(term, return_index=True)
            weights = {}
            for w in self.weighings:
                weights[w] = count * (K1 + 1) / (count + K1 * (1 - B + B * lengths[doc] / mean)) if w == "bm25" else count / np.sqrt(squares[doc])
            a, b = (int(doc.min()), int(doc.max()) + 1) if len(doc) else (0, 0)
            self.segments.append([a, b, known, np.append(first, len(doc)), doc - np.int32(a), weights])
        self.terms, at = np.unique(np.concatenate([s[2] for s in self.segments] or [np.zeros(0, np.int64)]), return_inverse=True)
        self.df = np.bincount(at, np.concatenate([np.diff(s[3]) for s in self.segments] or [np.zeros(0)]), len(self.terms)).astype(np.int64)
        most = DENSE // max(1, self.n * len(self.weighings))
        frequent = np.flatnonzero(self.df * 64 >= self.n)
        self.frequent = frequent[np.argsort(-self.df[frequent], kind="stable")[:most]]
        self.row = np.full(len(self.terms), -1)
        self.row[self.frequent] = np.arange(len(self.frequent))
        for s in self.segments:
            a, b, known, first, doc, weights = s
            lo, hi = np.zeros(len(self.terms), np.int64), np.zeros(len(self.terms), np.int64)
            where = np.searchsorted(self.terms, known)
            lo[where], hi[where] = first[:-1], first[1:]
            dense = {w: np.zeros((len(self.frequent), b - a)) for w in self.weighings}
            for k, t in enumerate(self.frequent):
                for w in self.weighings:
                    dense[w][k, doc[lo[t] : hi[t]]] = weights[w][lo[t] : hi[t]]
            s[:] = a, b, lo, hi, doc, weights, dense
        self.ids = pa.concat_arrays(self.ids) if self.ids else pa.array([])

    def at(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each term stands among those of the index, and whether it does."""
        at = np.searchsorted(self.terms, terms)
        return at, (at < len(self.terms)) & (np.append(self.terms, 0)[at] == terms)

    def asked(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, dict, float]:
        """Of a query: its terms that the index knows, their weights by weighing, and the share of its weight that is known."""
        at, known = self.at(terms)
        df = np.where(known, np.append(self.df, 0)[at], 0)
        idf = np.log(1 + (self.n - df + 0.5) / (df + 0.5))
        most = idf.sum()
        weights = {"bm25": idf[known] / most if most > 0 else np.zeros(known.sum()), "cosine": counts[known] / np.sqrt((counts.astype(float) ** 2).sum())}
        return at[known], weights, float(half_up(idf[known].sum() / most, 6)) if most > 0 else 0.0

    def scores(self, queries: list[tuple[np.ndarray, np.ndarray]], weighing: str) -> np.ndarray:
        """A row of scores over all documents per query of (terms, weights).

        What frequent terms add is a matrix product for queries with many of
        them; the postings of all other terms are added one term at a time.
        """
        out = np.zeros((len(queries), self.n))
        many = np.array([self.df[t[self.row[t] >= 0]].sum() > 2 * self.n for t, _ in queries], bool)
        rows = np.flatnonzero(many)
        asked = np.zeros((len(rows), len(self.frequent)))
        rest = []
        for k, (t, w) in enumerate(queries):
            if many[k]:
                held = self.row[t] >= 0
                asked[np.searchsorted(rows, k), self.row[t[held]]] = w[held]
                t, w = t[~held], w[~held]
            rest.append((t, w))
        for a, b, lo, hi, doc, weights, dense in self.segments:
            if len(rows):
                out[rows, a:b] = asked @ dense[weighing]
            weight = weights[weighing]
            for row, (t, w) in zip(out, rest):
                part = row[a:b]
                for x, y, v in zip(lo[t], hi[t], w):
                    if x < y:
                        part[doc[x:y]] += v * weight[x:y]
        return out


@lru_cache(maxsize=2)
def _places(n: int) -> np.ndarray:
    return n - 1 - np.arange(n)


@lru_cache(maxsize=2)
def _reciprocals(n: int, k: float) -> np.ndarray:
    return 1 / (k + np.arange(1, n + 1))


def passing(found: Listed, least: int) -> np.ndarray:
    """The documents from ``least`` units on, and above 0, best first, ties to the smaller id."""
    n = len(found.units)
    bits, held = n.bit_length(), found.units >= max(1, least)
    many = int(np.count_nonzero(held))
    units, place = (found.units, _places(n)) if 2 * many > n else (found.units[held], _places(n)[held])
    key = np.sort((units.astype(np.int64) << bits) | place)[len(place) - many :][::-1]
    return n - 1 - (key & ((1 << bits) - 1))


def least_units(knobs: Knobs) -> int:
    """The floor of a search in units."""
    return round(knobs.floor * UNIT)


def _weight(axis: str, knobs: Knobs) -> float:
    return dict(knobs.weights).get(axis, 1.0)


def fused(lists: list[Listed], orders: list[np.ndarray], knobs: Knobs, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(fused, best): of each document by reciprocal ranks or greatest weighted score, and its best score in units; 0 where no list has it. ``orders`` are of ``passing`` and needed for ranks only."""
    score, best, least = np.zeros(n), np.zeros(n, np.int32), least_units(knobs)
    for x, order in zip(lists, orders):
        w, units = _weight(x.axis, knobs), x.units if least <= 1 else np.where(x.units >= least, x.units, 0)
        np.maximum(best, units, out=best)
        if knobs.fusion == "rrf":
            score[order] += w * _reciprocals(n, knobs.rrf_k)[: len(order)]
        else:
            np.maximum(score, w * (units / UNIT), out=score)
    return half_up(score), best


def top(score: np.ndarray, best: np.ndarray, k: int, ties: bool = True) -> np.ndarray:
    """The k first documents: fused, best if ``ties`` go by it, id."""
    held = np.flatnonzero(best > 0)
    if len(held) > k:
        held = held[score[held] >= np.partition(score[held], len(held) - k)[len(held) - k]]
    return held[np.lexsort((held, -best[held] if ties else held, -score[held]))[:k]]


def with_quota(lists: list[Listed], orders: list[np.ndarray], places: np.ndarray, knobs: Knobs) -> dict[int, bool]:
    """The documents of the k places, and whether each is reserved.

    Up to half of the places (rounded up) are given in turn to the lists, the
    heavier first, each ``quota`` times: its best document that has no place yet;
    the rest goes by fused order.
    """
    queues = [o.tolist() for _, _, o in sorted(((-_weight(x.axis, knobs), x.axis, o[: knobs.k * (knobs.quota + 1)]) for x, o in zip(lists, orders)), key=lambda x: x[:2])]
    chosen: dict[int, bool] = {}
    for _ in range(knobs.quota):
        for queue in queues:
            if len(chosen) < -(-knobs.k // 2) and (d := next((d for d in queue if d not in chosen), None)) is not None:
                chosen[d] = True
    for d in places.tolist():
        if len(chosen) < knobs.k:
            chosen.setdefault(d, False)
    return chosen


def best_units(lists: list[Listed]) -> np.ndarray:
    """The best score of each document over the lists of a request."""
    return np.maximum.reduce([x.units for x in lists])


Answer = Callable[[str, list[Listed], Index], Iterator[tuple]]


def _parts(requests: pa.RecordBatch, most: int) -> Iterator[list[dict]]:
    """Requests a few at a time, of at most ``most`` lists together or one request."""
    for at in range(0, requests.num_rows, 64):
        part: list[dict] = []
        for r in requests.slice(at, 64).to_pylist():
            if part and sum(len(x["asked"]) for x in part) + len(r["asked"]) > most:
                yield part
                part = []
            part.append(r)
        yield part


def search(documents: DataFrame, queries: DataFrame, answer: Answer, schema: str, weighings: tuple[str, ...] = ("bm25",)) -> DataFrame:
    """What ``answer`` gives of each request: rows of ``schema`` out of its id, its lists by axis and the index.

    ``documents`` has doc_id and text, ``queries`` request, axis and text; ids
    are unique, those without terms are left out. The score of a list is BM25
    over the greatest score that the query could have, at most 1, or the cosine
    of term counts.
    """
    spark = documents.sparkSession
    blocks = spark.sparkContext.defaultParallelism
    packed = counted(documents.repartition("doc_id"), ["doc_id"])
    asked = counted(queries.repartition("request"), ["request", "axis"]).groupBy("request").agg(F.collect_list(F.struct("axis", "terms", "counts")).alias("asked"))
    d = packed.select(F.lit(0).alias("kind"), "doc_id", "terms", "counts", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    q = asked.select(F.lit(1).alias("kind"), "request", "asked", F.pmod(F.xxhash64("request"), F.lit(blocks)).cast("int").alias("block"))
    dealt = d.unionByName(q, allowMissingColumns=True).repartitionById(blocks, "block").sortWithinPartitions("kind", "doc_id")
    kinds = StructType.fromDDL(schema)
    out = to_arrow_schema(kinds)

    def answers(index: Index, requests: list[dict]) -> Iterator[tuple]:
        lists = [(r, x["axis"], *index.asked(np.array(x["terms"], np.int64), np.array(x["counts"]))) for r in requests for x in sorted(r["asked"], key=lambda x: x["axis"])]
        found: dict[int, list[Listed]] = {}
        for w in weighings:
            scores = index.scores([(t, ws[w]) for _, _, t, ws, _ in lists], w)
            for (r, axis, t, _, coverage), row in zip(lists, scores):
                units = np.rint(np.minimum(row, 1.0) * UNIT).astype(np.int32)
                found.setdefault(id(r), []).append(Listed(axis, w, coverage, len(t) > 0, units))
        for r in requests:
            yield from answer(r["request"], found[id(r)], index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, open_ = Index(weighings), True
        for b in batches:
            n = int(np.count_nonzero(b.column("kind").to_numpy() == 0))
            if n:
                index.add(*(b.column(c).slice(0, n) for c in ("doc_id", "terms", "counts")))
            if n == b.num_rows:
                continue
            if open_:
                index.close()
                open_ = False
            most = max(1, SCORES // max(1, index.n * len(weighings)))
            for part in _parts(b.select(["request", "asked"]).slice(n), most):
                rows = list(answers(index, part))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return dealt.mapInArrow(run, kinds)


def blend_top_k(documents: DataFrame, vectors: DataFrame, asked: Column, k: int, alpha: float) -> DataFrame:
    """(request, doc_id, score): each document or vector for which ``asked``, a condition on doc_id, holds asks all but itself by words and vector; the k best of a relevance above 0.

    ``documents`` (doc_id, text) and ``vectors`` (doc_id, embedding), ids whole
    numbers and neither null nor repeated in ``vectors``. Scores are those of
    ``hybrid.combined`` with an adaptive share. Here the documents are dealt out
    and each block gets all requests: k rows per request and block are shuffled.
    """
    blocks = documents.sparkSession.sparkContext.defaultParallelism
    packed = counted(documents.repartition("doc_id"), ["doc_id"])
    # How many documents hold a term how often; each document also holds a mark, 0 times. All figures of the corpus
    # follow from this one small table, whose keys are never null, so that no filter sets its uses apart.
    marked = F.arrays_zip(F.array_append("terms", F.lit(0).cast("bigint")), F.array_append("counts", F.lit(0)))
    each = packed.select(F.inline(marked)).toDF("t", "tf").select(F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("tf", F.lit(0)).alias("tf"))
    held = each.groupBy("t", "tf").agg(F.count(F.lit(1)).alias("c"))
    n = F.sum(F.when(F.col("tf") == 0, F.col("c")))
    stats = held.agg(n.alias("n"), (F.sum(F.col("tf") * F.col("c")) / n).alias("mean"))
    df = held.groupBy("t").agg(F.sum(F.when(F.col("tf") > 0, F.col("c"))).alias("df"))
    # A request is a document, so the index knows all of its terms: its coverage is 1, and 0 where it has none.
    terms = packed.where(asked).select(F.col("doc_id").alias("request"), F.explode("terms").alias("t")).join(df, "t").crossJoin(F.broadcast(stats.select("n")))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    words = terms.groupBy("request").agg(F.collect_list("t").alias("terms"), F.collect_list(idf).alias("weights"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    own = vectors.where("embedding IS NOT NULL")
    q = words.join(own.where(asked).where("doc_id > 0").withColumnRenamed("doc_id", "request"), "request", "full_outer").select(F.lit(1).alias("kind"), "request", "terms", "weights", "embedding", every)
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block")
    d = packed.join(own, "doc_id", "full_outer").select(F.lit(0).alias("kind"), "doc_id", "terms", "counts", "embedding", block)
    d = d.crossJoin(F.broadcast(stats.select("mean")))
    dealt = d.unionByName(q, allowMissingColumns=True).repartitionById(blocks, "block").sortWithinPartitions("kind", "doc_id")
    kinds = StructType.fromDDL("request bigint, doc_id bigint, score double")
    out = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, open_, vectors_of, at = Index(("bm25",)), True, [], []
        mean = None
        for b in batches:
            n = int(np.count_nonzero(b.column("kind").to_numpy() == 0))
            if n:
                p = b.slice(0, n)
                mean, held = p.column("mean")[0].as_py(), np.flatnonzero(p.column("embedding").is_valid().to_numpy(zero_copy_only=False))
                at.append(held + index.n)
                vectors_of += [np.asarray(p.column("embedding")[i].values, np.float64) for i in held.tolist()]
                index.add(*(p.column(c) for c in ("doc_id", "terms", "counts")))
            if n == b.num_rows:
                continue
            if open_:
                index.close(mean)
                ids, at = index.ids.to_numpy(), np.concatenate(at) if at else np.zeros(0, int)
                near = np.stack(vectors_of) if vectors_of else None
                open_ = False
            step = max(1, min(64, SCORES // max(1, index.n)))
            for first in range(n, b.num_rows, step):
                part = b.slice(first, min(step, b.num_rows - first)).to_pylist()
                weighed = []
                for r in part:
                    t, w = np.array(r["terms"] or [], np.int64), np.array(r["weights"] or [])
                    where, known = index.at(t)
                    weighed.append((where[known], w[known] / w.sum() if len(w) else w))
                names, found, scores = [], [], []
                for r, row in zip(part, index.scores(weighed, "bm25")):
                    share = alpha if r["terms"] else 1.0
                    dense = np.zeros(index.n)
                    if r["embedding"] is not None and near is not None:
                        dense[at] = np.clip(near @ np.array(r["embedding"], np.float64), 0.0, 1.0)
                    score = half_up(share * dense + (1 - share) * (np.rint(np.minimum(row, 1.0) * UNIT) / UNIT))
                    relevant = (np.maximum(dense, score) > 0) & (ids != r["request"])
                    best = top(score, relevant.astype(np.int8), k, ties=False)
                    names += [r["request"]] * len(best)
                    found.append(ids[best])
                    scores.append(score[best])
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.concatenate(found), pa.int64()), pa.array(np.concatenate(scores))], schema=out)

    return top_k(dealt.mapInArrow(run, kinds), "request", "score", "doc_id", k)
