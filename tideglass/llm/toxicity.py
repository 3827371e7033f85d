"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

A bounded sample of labelled rows gives the examples, each with all its terms; a term's weight is its IDF over all
documents, raised where it is more frequent among examples labelled 1 than chance allows.  Whole texts are
searched against the examples' whole vectors in a block-max inverted index, exactly.
Distance-weighted votes of the neighbours, calibrated on the examples themselves (each one searched without itself), give
the score, and the neighbours are the evidence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, release, small_batches, tidy, written

#: Bounds of the fit: labelled rows in the sample, the terms that they hold together, and terms shown as marks of label 1.
MAX_EXAMPLES, MAX_POSTINGS, MAX_TERMS = 4_096, 4_000_000, 512
#: Likelihood ratio (2 ln) against chance from which on a term weighs more (by chance, about one in a million terms reaches it); above it, each so many more add the term's IDF once (of 8, 4 and 2 the best by leave-one-out loss on the learning rows of sf0.1).
LEAST_RATIO, RATIO_STEP = 25.0, 2.0
NEIGHBOURS, EVIDENCE = 25, 5
#: Examples in a block; the terms in over one of HEAD_SHARE examples, HEAD at most, are in the block-max part.
BLOCK, HEAD, HEAD_SHARE = 64, 256, 50
#: Queries that are searched at once, and blocks between two looks at what is best so far.
BATCH, LOOK = 64, 8
THRESHOLD = 0.7
NOT_TERM = r"[^\p{L}\p{N}]+"
#: Cosines are compared in so many digits, so that sums in another order give the same ties.
DIGITS = 9


def _terms(text: str = "text"):
    return F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), NOT_TERM)


def _hashes(terms):
    return F.transform(F.filter(terms, lambda t: t != ""), lambda t: F.xxhash64(t))


def term_counts(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of term hashes: the sorted distinct hashes, and (row, place among them, tf) of every term of every row, by row; a null list is empty."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    n = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False) if len(lists) else np.zeros(0, np.int64)
    if lists.null_count:
        n = np.where(lists.is_valid().to_numpy(zero_copy_only=False), n, 0)
    distinct, code = np.unique(values, return_inverse=True)
    key, tf = np.unique(np.repeat(np.arange(len(n)), n) * max(1, len(distinct)) + code, return_counts=True)
    return distinct, key // max(1, len(distinct)), key % max(1, len(distinct)), tf


class Space:
    """The terms of the examples by hash (sorted) and their weights; a term in no example weighs `other` and counts in a text's norm only."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, other: float):
        self.hashes, self.weights, self.other = hashes, weights, other

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each term, -1 for one that is in no example."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def unit(self, term: np.ndarray, row: np.ndarray, tf: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, terms and weights of unit vectors of (1 + ln tf) * weight, in the examples' terms."""
        w = (1 + np.log(tf)) * np.where(term >= 0, self.weights[np.maximum(term, 0)] if len(self.weights) else 0.0, self.other)
        norm = np.sqrt(np.bincount(row, w * w, rows))
        inside = term >= 0
        return row[inside], term[inside], w[inside] / norm[row[inside]]

    def vectors(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        distinct, row, code, tf = term_counts(lists)
        return self.unit(self.places(distinct)[code], row, tf, len(lists))


class BlockMaxIndex:
    """Whole unit vectors of the examples, (row, term, weight) in any order, with ids and labels (shares of label 1) of the rows.

    Examples that are alike lie together in blocks of BLOCK.  A query walks the postings of its rare terms; for the frequent
    ones (the head) a block has the greatest weight of each term, which bounds every cosine in it, and only blocks
    whose bound reaches the k-th best so far are multiplied.  So results are those of all cosines.
    """

    def __init__(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, ids: np.ndarray, labels: np.ndarray, terms: int):
        n = len(ids)
        many = np.bincount(term, minlength=terms)
        head = np.argsort(-many, kind="stable")[:HEAD]
        head = head[many[head] * HEAD_SHARE > n]
        self.head_at = np.full(terms, -1, np.int32)
        self.head_at[head] = np.arange(len(head))
        place = self.head_at[term]
        inside = place >= 0
        dense = np.zeros((n, len(head)))
        dense[row[inside], place[inside]] = weight[inside]
        order = self._alike(dense, labels)
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        self.ids, self.labels, self.blocks = ids[order], labels[order], -(-n // BLOCK)
        self.head = np.zeros((self.blocks * BLOCK, len(head)))
        self.head[:n] = dense[order]
        self.most = self.head.reshape(self.blocks, BLOCK, len(head)).max(1) if n else np.zeros((0, len(head)))
        term, row, weight = term[~inside], back[row[~inside]].astype(np.int32), weight[~inside]
        by = np.argsort(term, kind="stable")
        self.rows, self.weights = row[by], weight[by]
        self.start = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=terms))))

    @staticmethod
    def _alike(dense: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """An order in which rows near the same of a few far apart rows follow each other."""
        n = len(dense)
        if not n or not dense.shape[1]:
            return np.arange(n)
        near, group = np.full(n, -1.0), np.zeros(n, np.int64)
        far = 0
        for k in range(max(1, min(32, n // (2 * BLOCK)))):
            cosine = dense @ dense[far]
            closer = cosine > near
            near[closer], group[closer] = cosine[closer], k
            far = int(near.argmin())
        return np.lexsort((-near, labels, group))

    def search(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, queries: int, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k best examples of each query, (row, term, weight) in order of rows; -1 and 0 where fewer have a positive cosine.  Ties go to the smaller id."""
        found, cosines = np.full((queries, k), -1), np.zeros((queries, k))
        cut = np.searchsorted(row, np.arange(0, queries + BATCH, BATCH))
        for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            low = i * BATCH
            if b > a and len(self.ids):
                high = min(queries, low + BATCH)
                found[low:high], cosines[low:high] = self._batch(row[a:b] - low, term[a:b], weight[a:b], high - low, k)
        return found, cosines

    def _batch(self, row, term, weight, queries: int, k: int):
        n, size = len(self.ids), self.blocks * BLOCK
        place = self.head_at[term]
        inside = place >= 0
        q = np.zeros((queries, self.head.shape[1]))
        q[row[inside], place[inside]] = weight[inside]
        # rare terms: all postings
        t, begin = term[~inside], self.start[term[~inside]]
        count = self.start[t + 1] - begin
        at = np.arange(count.sum()) + np.repeat(begin - np.concatenate(([0], np.cumsum(count)))[: len(count)], count)
        cell = np.repeat(row[~inside], count) * size + self.rows[at]
        scores = np.bincount(cell, np.repeat(weight[~inside], count) * self.weights[at], queries * size).astype(np.float64).reshape(queries, size)
        # frequent terms: block by block, most promising first
        bound = q @ self.most.T + scores.reshape(queries, self.blocks, BLOCK).max(2)
        best = np.full((queries, k), -1.0)
        order = np.argsort(-bound.max(0), kind="stable")
        seen = np.zeros((queries, self.blocks), bool)
        for j in range(0, self.blocks, LOOK):
            new = []
            for b in order[j : j + LOOK].tolist():
                ask = np.flatnonzero(bound[:, b] >= best[:, -1] - 1e-8)
                if len(ask):
                    part = slice(b * BLOCK, min(n, (b + 1) * BLOCK))
                    scores[ask, part] += q[ask] @ self.head[part].T
                    seen[ask, b] = True
                    new.append(b)
            if new:
                rows = (np.array(new)[:, None] * BLOCK + np.arange(BLOCK)).ravel()
                fresh = np.where(np.repeat(seen[:, new], BLOCK, 1) & (rows < n), scores[:, rows], -1.0)
                best = -np.partition(-np.concatenate((best, fresh), 1), k - 1, 1)[:, :k]
                best.sort(1)
                best = best[:, ::-1]
        scores[~np.repeat(seen, BLOCK, 1)] = -1.0
        scores[:, n:] = -1.0
        found, cosines = np.full((queries, k), -1), np.zeros((queries, k))
        line, column = np.nonzero(scores >= np.maximum(best[:, -1:] - 2e-9, 1e-12))
        value = np.round(scores[line, column], DIGITS)
        by = np.lexsort((self.ids[column], -value, line))
        line, column, value = line[by], column[by], value[by]
        rank = np.arange(len(line)) - np.searchsorted(line, line)
        keep = (rank < k) & (value > 0)
        found[line[keep], rank[keep]], cosines[line[keep], rank[keep]] = column[keep], value[keep]
        return found, cosines


class Model:
    """Space, index, and the calibration of the votes: a logistic curve of the vote share's log odds, fitted on the examples."""

    def __init__(self, row, term, tf, ids: np.ndarray, labels: np.ndarray, space: Space):
        filled = np.bincount(row, minlength=len(ids)) > 0
        self.space, self.rate = space, float(labels.mean()) if len(labels) else 0.0
        #: of examples without any term: the score of texts without any
        self.empty_rate = float(labels[~filled].mean()) if (~filled).any() else self.rate
        back = np.cumsum(filled) - 1
        row, term, weight = space.unit(term, back[row], tf, int(filled.sum()))
        self.index = BlockMaxIndex(row, term, weight, ids[filled], labels[filled], len(space.hashes))
        self.curve = self._fit(row, term, weight, ids[filled], labels[filled])

    def votes(self, found: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        """Share of label 1 among the neighbours, each weighed by its distance, with the rate of all examples as one more vote."""
        there = found >= 0
        w = np.where(there, 1 / (1.05 - np.minimum(cosines, 1.0)) ** 2, 0.0)
        y = self.index.labels[np.maximum(found, 0)] if len(self.index.labels) else np.zeros(found.shape)
        share = ((w * y).sum(1) + self.rate) / (w.sum(1) + 1)
        return np.where(there.any(1), share, self.empty_rate)

    def _fit(self, row, term, weight, ids: np.ndarray, labels: np.ndarray) -> tuple[float, float] | None:
        """Slope and offset by Newton's method; none without both labels."""
        if not 0 < labels.sum() < len(labels):
            return None
        found, cosines = self.index.search(row, term, weight, len(ids), NEIGHBOURS + 1)
        own = self.index.ids[np.maximum(found, 0)] == ids[:, None]
        drop = np.where(own.any(1), own.argmax(1), NEIGHBOURS)  # itself
        keep = np.arange(NEIGHBOURS + 1) != drop[:, None]
        share = self.votes(found[keep].reshape(-1, NEIGHBOURS), cosines[keep].reshape(-1, NEIGHBOURS))
        x, a, b = self._odds(share), 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-(a * x + b)))
            g, h = p - labels, p * (1 - p)
            # a weak pull to the curve that changes nothing
            ga, gb, haa, hab, hbb = (g * x).sum() + (a - 1), g.sum() + b, (h * x * x).sum() + 1, (h * x).sum(), h.sum() + 1
            det = haa * hbb - hab * hab
            step = np.clip([(hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det], -1, 1)
            a, b = a - float(step[0]), b - float(step[1])
        return max(a, 0.0), b

    @staticmethod
    def _odds(share: np.ndarray) -> np.ndarray:
        share = np.clip(share, 1e-3, 1 - 1e-3)
        return np.log(share / (1 - share))

    def scores(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of each text, and places and cosines of its neighbours."""
        row, term, weight = self.space.vectors(lists)
        found, cosines = self.index.search(row, term, weight, len(lists))
        share = self.votes(found, cosines)
        if self.curve:
            share = np.where(found[:, 0] >= 0, 1 / (1 + np.exp(-(self.curve[0] * self._odds(share) + self.curve[1]))), share)
        return share, found, cosines


def _sample(docs: DataFrame, labels: DataFrame, max_examples: int, max_postings: int) -> DataFrame:
    """doc_id, toxic, text, hashes of the labelled rows of least hash outside the held-out third, as many as keep both bounds."""
    learn = labels.where("toxic is not null and doc_id is not null").where(crc_mod("doc_id", 3) != 1).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    learn = learn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    texts = docs.select("doc_id", "text").join(F.broadcast(learn), "doc_id")  # at most max_examples small rows
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text")]
    # rows of labelled ids only; an id that is there many times gives the first max_examples rows at most
    texts = texts.orderBy(*order).limit(max_examples).withColumn("hashes", _hashes(_terms()))
    texts = written(texts, "toxicity-texts")
    sizes = texts.select("doc_id", F.xxhash64("text").alias("key"), F.size(F.array_distinct("hashes")).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id"), "doc_id", "key").rowsBetween(Window.unboundedPreceding, 0))
    over = sizes.withColumn("upto", upto).where(F.col("upto") > max_postings).select("doc_id", "key").distinct()  # of at most max_examples rows
    return texts.withColumn("key", F.xxhash64("text")).join(F.broadcast(over), ["doc_id", "key"], "left_anti")


def term_ratios(row: np.ndarray, term: np.ndarray, labels: np.ndarray, terms: int) -> np.ndarray:
    """How much more frequent among examples labelled 1 each term is than chance allows (2 ln of the likelihood ratio; 0: not at all)."""
    n1, n = labels.sum(), len(labels)
    if not 0 < n1 < n:
        return np.zeros(terms)
    share = n1 / n
    m, a = np.bincount(term, minlength=terms), np.bincount(term, labels[row], terms)
    with np.errstate(divide="ignore", invalid="ignore"):
        rest = np.where(m > a, (m - a) * np.log((m - a) / (m * (1 - share))), 0.0)
        return np.where(a > m * share, 2 * (a * np.log(a / (m * share)) + rest), 0.0)


def _document_frequencies(docs: DataFrame, hashes: np.ndarray) -> np.ndarray:
    """In how many documents each of the terms is; a task sends one number for each term it has met."""
    terms = docs.sparkSession.sparkContext.broadcast(Space(hashes, np.zeros(0), 0.0))

    def count(batches):
        held = np.zeros(len(terms.value.hashes), np.int64)
        for batch in batches:
            distinct, _, code, _ = term_counts(batch.column(0))
            at = terms.value.places(distinct)[code]
            held += np.bincount(at[at >= 0], minlength=len(held))
        met = np.flatnonzero(held)
        for i in range(0, len(met), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(met[i : i + 100_000], pa.int32()), pa.array(held[met[i : i + 100_000]])], ["term", "n"])

    sums = docs.select(_hashes(_terms()).alias("hashes")).mapInArrow(tidy(count), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term of the sample at most
    out = np.zeros(len(hashes), np.int64)
    out[sums["term"].to_numpy()] = sums["n"].to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, max_postings: int = MAX_POSTINGS) -> tuple[Model, list[str]]:
    """The model, and the words that mark label 1 by themselves (MAX_TERMS at most, for evidence only)."""
    sample = _sample(docs, labels, max_examples, max_postings)
    table = sample.select("doc_id", "toxic", "hashes", F.xxhash64("text").alias("key")).toArrow().sort_by([("doc_id", "ascending"), ("key", "ascending")])  # within both bounds
    hashes, row, term, tf = term_counts(table["hashes"])
    ids, toxic = table["doc_id"].to_numpy(), table["toxic"].to_numpy().astype(np.float64)
    del table
    # rows of equal terms are one example, with the mean of their labels and the least id
    cut = np.searchsorted(row, np.arange(len(ids) + 1))
    pairs = np.stack((term, tf), 1)
    first, of = {}, np.empty(len(ids), np.int64)
    for i in range(len(ids)):
        of[i] = first.setdefault(pairs[cut[i] : cut[i + 1]].tobytes(), len(first))
    one = np.unique(of, return_index=True)[1]
    labels_ = np.bincount(of, toxic, len(one)) / np.maximum(np.bincount(of, minlength=len(one)), 1)
    keep = np.isin(row, one)
    row, term, tf = of[row[keep]], term[keep], tf[keep]
    by = np.argsort(row, kind="stable")
    row, term, tf = row[by], term[by], tf[by]
    n = docs.count()
    ratios = term_ratios(row, term, labels_, len(hashes))
    idf = np.log((1 + n) / (1 + _document_frequencies(docs, hashes))) + 1
    weights = idf * (1 + np.maximum(ratios - LEAST_RATIO, 0.0) / RATIO_STEP)
    model = Model(row, term, tf, ids[one], labels_, Space(hashes, weights, float(np.log((1 + n) / 2) + 1)))
    top = np.argsort(-ratios, kind="stable")[:MAX_TERMS]
    top = hashes[top[ratios[top] > LEAST_RATIO]].tolist()
    marks = sample.select(F.explode(_terms()).alias("term")).where(F.xxhash64("term").isin(top)).distinct().collect() if top else []  # at most MAX_TERMS
    return model, sorted(r.term for r in marks)


def score_documents(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, max_postings: int = MAX_POSTINGS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted, terms, neighbours, cosines (and the columns of docs in `keep`).

    score is the calibrated distance-weighted share of label 1 among the nearest examples by cosine of the whole texts; a text
    that shares no term with any (an empty or null one, too) scores the share among examples without any.  terms are the
    text's words that mark label 1 by themselves; the search does not depend on them.  Labels come
    only from labelled rows outside the held-out third; null labels and ids are not learned from,
    and of several labels for an id the greatest counts; every text of an id with several is an example.  Without labels of
    both kinds every score is the one rate there is (0 without labels).  Repeated rows and null ids each give a row; other
    columns are not read.  The same rows give the same scores in any order.
    """
    small_batches(docs)
    model, marks = fit(docs, labels, max_examples, max_postings)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    del model
    release(docs.sparkSession)
    names = ["doc_id", "held_out", "score", "predicted", "terms", "neighbours", "cosines", *(f"kept_{c}" for c in keep)]
    size = len(names) - len(keep)

    def run(batches):
        m = shared.value
        ids = np.append(m.index.ids, 0)
        for batch in batches:
            score, found, cosines = m.scores(batch.column(3))
            found, cosines = found[:, :EVIDENCE], cosines[:, :EVIDENCE]
            there = found >= 0
            offsets = pa.array(np.concatenate(([0], np.cumsum(there.sum(1)))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), batch.column(2),
                    pa.ListArray.from_arrays(offsets, pa.array(ids[found[there]], pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(cosines[there])), *batch.columns[4:],
                ],
                names,
            )

    marked = F.filter(_terms(), lambda w: w.isin(*marks)) if marks else F.array().cast("array<string>")
    table = docs.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), marked.alias("terms"), _hashes(_terms()).alias("hashes"), *(F.col(c).alias(f"kept_{c}") for c in keep))
    schema = T._parse_datatype_string("doc_id bigint, held_out boolean, score double, predicted int, terms array<string>, neighbours array<bigint>, cosines array<double>")
    schema = T.StructType([*schema.fields, *(T.StructField(f"kept_{c}", docs.schema[c].dataType) for c in keep)])
    out = table.mapInArrow(tidy(run), schema)
    return out.select(*names[:size], *(F.col(f"kept_{c}").alias(c) for c in keep if c not in names[:size]))
