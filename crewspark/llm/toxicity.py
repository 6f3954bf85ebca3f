"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are all words and word beginnings that lean towards the toxic class in a bounded sample of
labelled rows; their document frequencies are counted over all documents.  All other words of a text
together are one background term, so that the share of telling terms counts, not only which they are
(over all words alike, neighbours share topics and not insults; the README has the figures).  The
examples lie in an inverted index whose postings are cut into
blocks, each with the largest weight of a term in it; blocks are visited by their upper bound until
none can hold a nearer example, which keeps the search exact.  Votes weighted by distance become
calibrated scores by isotonic regression on the examples' own votes (each without itself).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewspark.llm.common import map_batches, pick, stage
from crewspark.llm.textscan import ALNUM, U, Scan, mix, scan
from crewspark.shipping import map_in_arrow, ship

#: The bound of the sample: different labelled rows (id and text) of either class, least hash of the
#: id first.
EXAMPLES = {1: 3_000, 0: 6_000}
#: What a term must show in the sample: toxic rows, and how much likelier it is in them.
LEAST_DOCS, LEAST_RATIO = 4, 8.0
#: Beginnings of words, in bytes, that are terms besides whole words.
PREFIXES = (5, 6, 7, 8, 9, 10)
#: Weight of the background term against an idf of 1, neighbours, examples of a block.
BACKGROUND, NEIGHBOURS, BLOCK = 2.0, 25, 64
#: 0 as this remainder of crc32(doc_id) is held out.
FOLDS = 5


def terms_of(s: Scan) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of all words (whole, then each beginning), and the place of their words."""
    whole = s.hashes()
    out, at = [whole], [np.arange(len(whole))]
    size = s.ends - s.starts
    for k in PREFIXES:
        long = np.flatnonzero(size > k)
        cut = Scan(s.data, s.doc_start, s.starts[long], s.starts[long] + k, s.first)
        out.append(mix(cut.hashes() + U(k)))
        at.append(long)
    return np.concatenate(out), np.concatenate(at)


def _background(n_words: np.ndarray) -> np.ndarray:
    return BACKGROUND * (1 + np.log1p(n_words / 20.0))


def vectors(batch: pa.RecordBatch, vocabulary: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (row, term, weight) of unit length for the texts of a batch, sorted by row, and
    the background weights; column 1 is the text."""
    s = scan(batch.column(1), ALNUM, lower=True)
    terms, word = terms_of(s)
    at = np.minimum(np.searchsorted(vocabulary, terms), max(len(vocabulary) - 1, 0))
    hit = np.flatnonzero(vocabulary[at] == terms) if len(vocabulary) and len(terms) else np.zeros(0, np.int64)
    rows = s.doc_of_words()[word[hit]]
    keys, tf = np.unique(rows * (len(vocabulary) + 1) + at[hit], return_counts=True)
    row, term = keys // (len(vocabulary) + 1), keys % (len(vocabulary) + 1)
    weight = (1 + np.log(tf)) * idf[term] if len(idf) else np.zeros(0)
    base = _background(s.n_words)
    norm = np.sqrt(base**2 + np.bincount(row, weights=weight**2, minlength=batch.num_rows))
    return row, term, weight / norm[row], base / norm


class Index:
    """Block-max inverted index of the examples.  Examples are ordered so that like ones share
    blocks; the background weight of every example is one more posting list."""

    def __init__(self, ids, labels, rows, terms, weights, base, n_terms):
        n = len(ids)
        lead = np.full(n, n_terms)
        for i in np.argsort(weights, kind="stable"):
            lead[rows[i]] = terms[i]  # the heaviest comes last
        order = np.lexsort((base, labels, lead))
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        self.ids, self.labels, self.n = np.asarray(ids)[order], np.asarray(labels)[order], n
        self.blocks = max(1, -(-n // BLOCK))
        self.base = np.zeros(self.blocks * BLOCK)
        self.base[: n] = np.asarray(base)[order]
        self.base_max = self.base.reshape(-1, BLOCK).max(axis=1)
        at = place[rows]
        by = np.lexsort((at, terms))
        self.at, self.weight = at[by], np.asarray(weights)[by]
        key = np.asarray(terms)[by] * self.blocks + self.at // BLOCK
        self.cut = np.searchsorted(key, np.arange(n_terms * self.blocks + 1))
        self.top = np.zeros(n_terms * self.blocks)
        np.maximum.at(self.top, key, self.weight)
        self.top = self.top.reshape(n_terms, self.blocks)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, base: float, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples (ties: least place first), exactly."""
        bound = base * self.base_max + weights @ self.top[terms]
        found_at, found = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bound, kind="stable"):
            if len(found) >= k and bound[b] < found[-1] - 1e-12:
                break
            lo = b * BLOCK
            score = base * self.base[lo : lo + BLOCK]
            for t, w in zip(terms, weights, strict=True):
                i, j = self.cut[t * self.blocks + b], self.cut[t * self.blocks + b + 1]
                if j > i:
                    score[self.at[i:j] - lo] += w * self.weight[i:j]
            end = min(self.n - lo, BLOCK)
            at = np.arange(lo, lo + end)
            if lo <= without < lo + end:
                at, score = np.delete(at, without - lo), np.delete(score[:end], without - lo)
            found_at, found = np.r_[found_at, at], np.r_[found, score[: len(at)]]
            keep = np.lexsort((found_at, -np.round(found, 12)))[:k]
            found_at, found = found_at[keep], found[keep]
        return found_at, found

    def vote(self, at: np.ndarray, cosine: np.ndarray) -> float:
        w = 1 / (0.02 + np.maximum(0, 1 - cosine))
        return float((w * self.labels[at]).sum() / w.sum()) if len(at) else 0.0


def isotonic(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (least vote, probability) of the best rising fit, by pooling adjacent violators."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []  # least vote, weighted sum, weight
    for v, y, w in zip(votes[order], labels[order], weights[order], strict=True):
        if pools and pools[-1][0] == v:
            pools[-1][1] += y * w
            pools[-1][2] += w
        else:
            pools.append([v, y * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, s, w_ = pools.pop()
            pools[-1][1] += s
            pools[-1][2] += w_
    return np.array([p[0] for p in pools]), np.array([(p[1] + 0.1) / (p[2] + 1) for p in pools])


def _id() -> Column:
    return F.coalesce("doc_id", F.lit(-(2**63)).cast("long"))


def sample(docs: DataFrame, labels: DataFrame, bounds: dict[int, int] | None = None) -> DataFrame:
    """id, txt, text, toxic of the different labelled rows to learn from (all, or those with the least
    hashes up to the bounds)."""
    own = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0)
    order = [F.xxhash64("doc_id"), "doc_id"]
    each = [own.where(F.col("toxic") == y).orderBy(*order).limit(n) for y, n in (bounds or EXAMPLES).items()]
    ids = stage(each[0].unionByName(each[1]))  # at most the sum of the bounds
    keyed = docs.select("doc_id", F.xxhash64("text").alias("txt"), "text")
    rows = stage(keyed.join(F.broadcast(ids), "doc_id").select("doc_id", "txt", "toxic").distinct())
    each = [rows.where(F.col("toxic") == y).orderBy(*order, "txt").limit(n) for y, n in (bounds or EXAMPLES).items()]
    chosen = stage(each[0].unionByName(each[1]))  # an id may have many texts: bounded as rows now
    return keyed.join(F.broadcast(chosen), ["doc_id", "txt"]).dropDuplicates(["doc_id", "txt"]).select(_id().alias("id"), "txt", "text", "toxic")


def telling_terms(examples: DataFrame, n: dict[int, int]) -> np.ndarray:
    """Hashes of the terms that lean towards the toxic class, ascending; n: examples by class."""

    def present(batch):
        s = scan(batch.column(1), ALNUM, lower=True)
        terms, word = terms_of(s)
        label = np.asarray(batch.column(2).to_numpy(zero_copy_only=False))
        doc = s.doc_of_words()[word]
        pairs = np.unique(np.stack([terms, doc.astype(U)]), axis=1) if len(terms) else np.zeros((2, 0), U)
        keys, at = np.unique(pairs[0], return_inverse=True)
        toxic = label[pairs[1].astype(np.int64)] == 1
        return [keys.view(np.int64), np.bincount(at, weights=toxic, minlength=len(keys)).astype(np.int64), np.bincount(at, weights=~toxic, minlength=len(keys)).astype(np.int64)]

    counted = map_batches(examples.select("id", "text", "toxic"), "term long, a long, b long", present).groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ratio = ((F.col("a") + 0.5) / (n.get(1, 0) + 1)) / ((F.col("b") + 0.5) / (n.get(0, 0) + 1))
    found = counted.where((F.col("a") >= LEAST_DOCS) & (ratio >= LEAST_RATIO)).select("term").toPandas()["term"]
    return np.sort(found.to_numpy(dtype=np.int64).view(U))


def idf_of(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """log((documents + 1) / (df + 1)) of the terms over all documents."""

    def count(batch):
        s = scan(batch.column(1), ALNUM, lower=True)
        terms, word = terms_of(s)
        at = np.minimum(np.searchsorted(vocabulary, terms), max(len(vocabulary) - 1, 0))
        hit = np.flatnonzero(vocabulary[at] == terms) if len(vocabulary) and len(terms) else np.zeros(0, np.int64)
        pairs = np.unique(s.doc_of_words()[word[hit]] * (len(vocabulary) + 1) + at[hit])
        term, n = np.unique(pairs % (len(vocabulary) + 1), return_counts=True)
        return [np.r_[term, -1], np.r_[n, batch.num_rows]]

    counted = map_batches(docs.select("doc_id", "text"), "term long, n long", count).groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(vocabulary) + 1)
    df[counted["term"].to_numpy(dtype=np.int64)] = counted["n"]  # the last one: all documents
    return np.log((df[-1] + 1) / (df[:-1] + 1))


def fit(docs: DataFrame, examples: DataFrame, sizes: dict[int, int]) -> dict:
    """Vocabulary, idf, examples and calibration; sizes: labelled rows by class.  What passes the
    driver is bounded by the sample."""
    n = {r[0]: r[1] for r in examples.groupBy("toxic").count().collect()}
    vocabulary = telling_terms(examples, n)
    idf = idf_of(docs, vocabulary)

    def placed(batch):
        row, term, weight, base = vectors(batch, vocabulary, idf)
        cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
        lists = lambda x: pa.array([x[i:j].tolist() for i, j in zip(cut, cut[1:])])
        return [batch.column(0), batch.column(2), batch.column(3), base, lists(term).cast(pa.list_(pa.int64())), lists(weight).cast(pa.list_(pa.float64()))]

    rows = examples.select("id", "text", "txt", "toxic")
    rows = stage(map_batches(rows, "id long, txt long, toxic int, base double, terms array<long>, weights array<double>", placed))
    model = {"vocabulary": vocabulary, "idf": idf, "rows": sorted(tuple(r) for r in rows.collect()), "steps": None}
    if not model["rows"]:
        return model | {"steps": (np.zeros(1), np.zeros(1))}
    ship(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def votes(batches):
        for batch in batches:
            m = _model(key, sent)
            index, place = m["index"], m["place"]
            out = [
                index.vote(*index.nearest(np.array(t, dtype=np.int64), np.array(w), b, without=place[i, x]))
                for i, x, b, t, w in zip(*(batch.column(c).to_pylist() for c in ("id", "txt", "base", "terms", "weights")), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(out, pa.float64())], names=["toxic", "vote"])

    spread = rows.repartition(-(-len(model["rows"]) // 250), "id", "txt")
    voted = map_in_arrow(spread, votes, "toxic int, vote double").toPandas()
    labels = voted["toxic"].to_numpy()
    share = {y: sizes.get(y, 0) / max(n.get(y, 0), 1) for y in (0, 1)}
    return model | {"steps": isotonic(voted["vote"].to_numpy(), labels, np.where(labels == 1, share[1], share[0]))}


_models: dict[str, dict] = {}


def _model(key: str, sent) -> dict:
    """The model, with its index, once in a worker process."""
    if key not in _models:
        _models.clear()
        m = sent.value
        rows = m["rows"]
        index = Index(
            np.arange(len(rows)),
            np.array([r[2] for r in rows], dtype=np.int64),
            np.repeat(np.arange(len(rows)), [len(r[4]) for r in rows]),
            np.array([t for r in rows for t in r[4]], dtype=np.int64),
            np.array([w for r in rows for w in r[5]], dtype=float),
            np.array([r[3] for r in rows], dtype=float),
            len(m["vocabulary"]),
        )
        place = {rows[k][:2]: p for p, k in enumerate(index.ids.tolist())}
        _models[key] = m | {"index": index, "place": place, "ids": [rows[k][0] for k in index.ids.tolist()], "plain": {}}
    return _models[key]


def score_toxicity(docs: DataFrame, labels: DataFrame, bounds: dict[int, int] | None = None) -> DataFrame:
    """doc_id, score, evidence (nearest examples as "doc_id:label:cosine") of every document.

    Labels of held-out ids are not read.  Null and empty texts have the background term only and are
    scored like any text; null ids take part; repeated rows are scored each; without usable labels
    every score is 0; an empty table gives an empty one; other columns are not read.  The index holds
    at most the sum of ``bounds`` examples and the terms that lean towards toxic in four of them at
    least, so that its size is bounded before it is broadcast.
    """
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    own = pick(labels, "doc_id", "toxic").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
    examples = stage(sample(rows, own, bounds))
    learnt = own.where((F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0) & F.col("toxic").isin(0, 1))
    sizes = {r[0]: r[1] for r in learnt.groupBy("toxic").count().collect()}
    sent = docs.sparkSession.sparkContext.broadcast(fit(rows, examples, sizes))
    key = uuid.uuid4().hex

    def scored(batch):
        m = _model(key, sent)
        index, steps, plain, ids = m["index"], m["steps"], m["plain"], m["ids"]
        row, term, weight, base = vectors(batch, m["vocabulary"], m["idf"])
        cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
        scores, evidence = [], []
        for i, b in enumerate(base):
            t, w = term[cut[i] : cut[i + 1]], weight[cut[i] : cut[i + 1]]
            if not len(t) and plain:
                s, e = plain["only"]  # all texts with the background term alone have one vector
            else:
                at, cosine = index.nearest(t, w, b)
                vote = index.vote(at, cosine)
                step = max(0, np.searchsorted(steps[0], vote, side="right") - 1)
                s = float(steps[1][step])
                e = ",".join(f"{ids[a]}:{index.labels[a]}:{c:.4f}" for a, c in zip(at[:3], cosine[:3], strict=True))
                if not len(t):
                    plain["only"] = (s, e)
            scores.append(s)
            evidence.append(e)
        return [batch.column(0), np.array(scores), evidence]

    return map_batches(rows, "doc_id long, score double, evidence string", scored)
