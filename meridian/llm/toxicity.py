"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The examples are a bounded sample of labelled documents, and the space is that
of all their words.  A word weighs (1 + ln tf) * idf * rf^2: document
frequencies come from the whole corpus, and rf = log2(2 + a / max(1, c)), the
relevance frequency of supervised term weighting, from the a toxic and c clean
examples that have the word.  No word is left out; without rf, a long text's
nearest examples are those that share its common words.

Examples lie in blocks of similar ones.  The short lists of postings are read
whole.  The long ones, of the words that many examples have, are cut by block,
with the highest weight of the word in each: what a query has from its short lists
and from these maxima is an upper bound for every block.  The blocks of the
highest bounds are scored in full first, and of the others only those whose bound
reaches the k-th best score so far; the rest of the long lists is skipped.  The
k nearest are therefore exact.  Their votes, weighted by squared similarity, pass
through an isotonic map fitted on the examples (each judged by the others) at the
labels' own toxic rate.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.isotonic import isotonic
from meridian.llm.text import texts_of, type_of, words
from meridian.plans.materialize import materialize

#: Labelled examples of each class in the index, at most: the bound of the fitted sample.
EXAMPLES = 2048
#: Bytes of the examples' texts of each class, at most, and of one example's text.
EXAMPLE_BYTES, LONGEST_EXAMPLE = 16 << 20, 1 << 20
NEIGHBOURS = 9
BLOCK = 32
#: Blocks that are scored in full before the k-th best score is looked at.
FIRST = 2
#: Lists cut by block: at most so many, of words that more than this share of the examples have.
LONG_LISTS, LONG = 512, 1 / 16
#: Queries that are searched at once, and postings of theirs.
AT_ONCE, WORK = 64, 400_000
CUTOFF = 0.5


def _expanded(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run of n, one run after the other."""
    return np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())


def similar_order(terms: np.ndarray, weights: np.ndarray, sizes: list[int]) -> np.ndarray:
    """An order in which similar vectors are near: halved again and again along the direction of their largest spread."""
    signs = np.random.default_rng(1).choice(np.array([-1, 1], np.float32), (8191, 64))
    sketch, ends = np.zeros((len(sizes), 64), np.float32), np.cumsum([0, *sizes])
    for k, (low, high) in enumerate(zip(ends, ends[1:])):
        sketch[k] = weights[low:high].astype(np.float32) @ signs[terms[low:high] % 8191]

    def halve(rows: np.ndarray) -> list[np.ndarray]:
        if rows.size <= BLOCK:
            return [rows]
        centred = sketch[rows] - sketch[rows].mean(axis=0)
        along = centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1]
        ranked = rows[np.argsort(along, kind="stable")]
        cut = -(-rows.size // BLOCK) // 2 * BLOCK
        return halve(ranked[:cut]) + halve(ranked[cut:])

    return np.concatenate(halve(np.arange(len(sizes))))


class Index:
    """Examples as a block-max inverted index; terms are places in the sorted vocabulary, those of one example after the other."""

    def __init__(self, vocabulary: pa.Array, ids: list, toxic: list[int], sizes: list[int], terms: np.ndarray, counts: np.ndarray):
        self.vocabulary, self.ids, self.toxic = vocabulary, ids, np.array(toxic, np.int8)
        self.place = {i: k for k, i in enumerate(ids)}
        self.bags = (sizes, terms, counts)
        bad = np.repeat(self.toxic == 1, sizes)
        a, c = (np.bincount(terms[some], minlength=len(vocabulary)) for some in (bad, ~bad))
        self.relevance = np.log2(2 + a / np.maximum(1, c))

    def known(self) -> dict[bytes, int]:
        return {w: k for k, w in enumerate(self.vocabulary.to_pylist())}

    def vector(self, text: str | None, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights of a text's words, of unit length; none for a text without words of the examples."""
        bag = {k: n for w, n in Counter(words(text)).items() if (k := known.get(w)) is not None}
        terms = np.fromiter(bag.keys(), np.int64, len(bag))
        weight = (1 + np.log(np.fromiter(bag.values(), float, len(bag)))) * self.worth[terms]
        return terms, weight / (np.sqrt((weight**2).sum()) or 1.0)

    def build(self, documents: int, having: np.ndarray) -> None:
        """Weigh the postings, given the number of documents and of those that have each word."""
        self.worth = (np.log((1 + documents) / (1 + having)) + 1) * self.relevance**2
        (sizes, term, counts), self.bags, self.relevance = self.bags, None, None
        example = np.repeat(np.arange(len(sizes)), sizes)
        weight = (1 + np.log(counts)) * self.worth[term]
        weight /= np.sqrt(np.bincount(example, weight**2, len(sizes)))[example]
        ends = np.cumsum(sizes)[:-1]
        self.vectors = list(zip(np.split(term, ends), np.split(weight, ends)))
        size, many = len(sizes), len(self.vocabulary)
        self.order = similar_order(term, weight, sizes)  # column to place
        self.column = np.empty(size, np.int64)
        self.column[self.order] = np.arange(size)
        self.blocks = max(1, -(-size // BLOCK))
        lists = np.bincount(term, minlength=many)
        long = np.argsort(-lists, kind="stable")[:LONG_LISTS]
        long = long[lists[long] > LONG * size]
        self.long = np.full(many, -1, np.int32)
        self.long[long] = np.arange(long.size)
        within = self.long[term] >= 0
        whole = np.zeros((self.blocks * BLOCK, long.size))
        whole[self.column[example[within]], self.long[term[within]]] = weight[within]
        self.cut = whole.reshape(self.blocks, BLOCK, long.size).transpose(0, 2, 1).copy()  # a matrix for each block
        self.most = self.cut.max(axis=2).T if self.cut.size else np.zeros((long.size, self.blocks))
        term, weight, example = term[~within], weight[~within], example[~within]
        sort = np.argsort(term, kind="stable")
        self.example, self.weight = self.column[example[sort]].astype(np.int32), weight[sort]
        self.start = np.searchsorted(term[sort], np.arange(many + 1)).astype(np.int32)

    def work(self, terms: np.ndarray) -> int:
        """How many postings the words' short lists have."""
        return int((self.start[terms + 1] - self.start[terms]).sum())

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and similarities of each vector's k nearest examples, without the one at its own place (-1: none).

        Equal similarities, to nine digits, go by place: clean examples first,
        then by id.  What is left without any similarity is filled with -1 and 0.
        """
        k = min(k, len(self.ids))
        best, value = np.full((len(vectors), k), -1), np.zeros((len(vectors), k))
        load = np.cumsum([0, *(self.work(t) for t, _ in vectors)])
        at = 0
        while at < len(vectors) and k:
            to = min(at + AT_ONCE, max(at + 1, int(np.searchsorted(load, load[at] + WORK, "right")) - 1))
            best[at:to], value[at:to] = self._nearest(vectors[at:to], own[at:to], k)
            at = to
        return best, value

    def _nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        many, width = len(vectors), self.blocks * BLOCK
        terms, weights = (np.concatenate([v[c] for v in vectors]) for c in (0, 1))
        query = np.repeat(np.arange(many), [t.size for t, _ in vectors])
        long = self.long[terms] >= 0
        of_long = np.zeros((many, self.most.shape[0]))
        of_long[query[long], self.long[terms[long]]] = weights[long]
        terms, weights, query = terms[~long], weights[~long], query[~long]
        first = self.start[terms]
        n = self.start[terms + 1] - first
        post = _expanded(first, n)
        scores = np.bincount(np.repeat(query * width, n) + self.example[post], self.weight[post] * np.repeat(weights, n), many * width).astype(float).reshape(many, width)
        owned = np.flatnonzero(own >= 0)
        mine = self.column[own[owned]]
        scores[owned, mine] = 0
        bound = (scores.reshape(many, self.blocks, BLOCK).max(axis=2) + of_long @ self.most) * (1 + 1e-9)
        seen = np.zeros((many, self.blocks), bool)

        def score(now: np.ndarray) -> None:
            for b in np.flatnonzero(now.any(axis=0)):
                some = np.flatnonzero(now[:, b])
                scores[some, b * BLOCK : (b + 1) * BLOCK] += of_long[some] @ self.cut[b]
            seen[now] = True
            scores[owned, mine] = 0

        begin = np.zeros_like(seen)
        np.put_along_axis(begin, np.argpartition(-bound, min(FIRST, self.blocks) - 1, axis=1)[:, :FIRST], True, axis=1)
        score(begin & (bound > 0))
        # scores that lack the long lists are too low, so the k-th best is no less than this; what is rounded away below may count
        reached = -np.partition(-scores, k - 1, axis=1)[:, k - 1] - 2e-9
        score(~seen & (bound > 0) & (bound >= reached[:, None]))
        scores.reshape(many, self.blocks, BLOCK)[~seen] = 0
        scores = np.round(scores, 9)
        edge = np.maximum(-np.partition(-scores, k - 1, axis=1)[:, k - 1], 1e-9)
        best, value = np.full((many, k), -1), np.zeros((many, k))
        for q in range(many):
            found = np.flatnonzero(scores[q] >= edge[q])
            places = self.order[found]
            found = np.lexsort((places, -scores[q, found]))[:k]
            best[q, : found.size], value[q, : found.size] = places[found], scores[q][self.column[places[found]]]
        return best, value

    def votes(self, best: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Share of the toxic among the neighbours, weighted by squared similarity; 0 where there are none."""
        weight = np.where(best >= 0, value, 0) ** 2
        return (weight * self.toxic[best]).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-300) if len(self.ids) else np.zeros(len(best))

    def calibrate(self, rate: float, k: int) -> None:
        """Fit the map from votes to probabilities on the examples, each without itself."""
        if not self.ids:
            self.points = (np.zeros(1), np.zeros(1))
            return
        votes = self.votes(*self.nearest(self.vectors, np.arange(len(self.ids)), k))
        ones, zeros = max(1, int(self.toxic.sum())), max(1, int((self.toxic == 0).sum()))
        self.points = isotonic(votes, self.toxic.astype(float), np.where(self.toxic == 1, rate / ones, (1 - rate) / zeros))
        self.vectors = None

    def score(self, votes: np.ndarray) -> np.ndarray:
        return np.interp(votes, *self.points)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", examples: int = EXAMPLES, neighbours: int = NEIGHBOURS, seed: int = 1) -> Index:
    """The calibrated index.  Document frequencies are counted over all documents; only the sample of examples is bounded."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = type_of(docs, id_col)
    marks = labels.select(F.col(label_id_col).cast(kind).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    sizes = named.where("length(text) > 0").groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("bytes"))
    marks = materialize(marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(sizes, "doc_id"), "marks")
    total = dict(marks.groupBy("toxic").count().collect())
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    # Spark keeps only so many rows of each partition before it shuffles them
    first = marks.where(F.col("bytes") <= LONGEST_EXAMPLE).withColumn("r", F.row_number().over(order)).where(F.col("r") <= examples)
    chosen = first.withColumn("upto", F.sum("bytes").over(order)).where(F.col("upto") <= EXAMPLE_BYTES).select("doc_id", "toxic")

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(words(t)) for t in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], ["doc_id", "toxic", "words", "n"])

    # 2 * examples rows at most; of several texts with one id, the least
    one = named.where("length(text) > 0").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = one.mapInArrow(bag, f"doc_id {kind}, toxic int, words array<binary>, n array<int>").toArrow()
    rows = rows.sort_by([("toxic", "ascending"), ("doc_id", "ascending")]).combine_chunks()
    found, counts = (rows.column(c).combine_chunks() if rows.num_rows else pa.array([], kind) for c, kind in (("words", pa.list_(pa.binary())), ("n", pa.list_(pa.int32()))))
    coded = found.flatten().dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    index = Index(coded.dictionary.take(order), rows.column("doc_id").to_pylist(), rows.column("toxic").to_pylist(), [len(x) for x in found], place[coded.indices.to_numpy()], counts.flatten().to_numpy().astype(float))
    del rows, found, counts, coded
    shared = docs.sparkSession.sparkContext.broadcast(index.vocabulary)  # bounded by the examples

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, documents = {w: k for k, w in enumerate(shared.value.to_pylist())}, 0
        having = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            for text in texts_of(batch.column(0)):
                documents += 1
                having[[k for w in set(words(text)) if (k := known.get(w)) is not None]] += 1
        having[-1] = documents
        some = np.flatnonzero(having)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(having[some])], ["term", "n"])

    counts = named.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    having = np.zeros(len(index.vocabulary) + 1, np.int64)
    having[counts["term"].to_numpy()] = counts["n"].to_numpy()
    index.build(int(having[-1]), having[:-1])
    index.calibrate(total.get(1, 0) / max(1, sum(total.values())), neighbours)
    return index


def _judged(index: Index, known: dict[bytes, int], ids: list, texts: list, neighbours: int):
    """Neighbours, similarities and calibrated scores of some texts; 0 for a text that shares no word with an example."""
    best, value = index.nearest([index.vector(t, known) for t in texts], np.array([index.place.get(i, -1) for i in ids], np.int64), neighbours)
    some = (best >= 0).any(axis=1)
    return best, value, np.where(some, index.score(index.votes(best, value)), 0.0)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", examples: int = EXAMPLES, neighbours: int = NEIGHBOURS, cutoff: float = CUTOFF, seed: int = 1) -> DataFrame:
    """One row for each row of ``docs``: (doc_id, score, toxic, evidence, similarity).

    score is the calibrated probability, toxic whether it reaches ``cutoff``,
    evidence the ids of the nearest examples and similarity their cosines, best
    first.  An example is never evidence for its own id.

    Ids can be of any type.  Nulls: labels with a null id or label are ignored;
    a null or empty text, or one that shares no word with an example, has score
    0, no evidence, and isn't toxic; a null id is kept.  Very long texts are
    judged whole, but aren't examples beyond ``LONGEST_EXAMPLE`` bytes.  Ties in
    similarity go to clean examples first, then by id.  Repeated rows are scored
    alike; contradictory labels count as toxic; of several texts of a labelled
    id, the least is the example.  Without labels every score is 0; an empty
    table gives no rows.  Other columns are not read.
    """
    index = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_id_col, label_col, examples, neighbours, seed))
    kind = type_of(docs, id_col)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value.known()
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                best, value, score = _judged(index.value, known, part.column(0).to_pylist(), part.column(1).to_pylist(), neighbours)
                ids = pa.array([[index.value.ids[k] for k in b if k >= 0] for b in best], pa.list_(part.schema.field(0).type))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(score >= cutoff), ids, pa.array([v[b >= 0].tolist() for b, v in zip(best, value)], pa.list_(pa.float64()))], ["doc_id", "score", "toxic", "evidence", "similarity"])

    return named.mapInArrow(judge, f"doc_id {kind}, score double, toxic boolean, evidence array<{kind}>, similarity array<double>")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", examples: int = EXAMPLES, neighbours: int = NEIGHBOURS, cutoff: float = CUTOFF, seed: int = 1) -> DataFrame:
    """``docs`` without the rows that toxicity() calls toxic; each row is judged by its own text, all columns are kept.

    Rows with a null or empty text, or without a word of the examples, stay, as
    do all rows where there are no labels; a null id stays or goes by its text.
    Very long texts are judged whole, ties as in toxicity(); of repeated rows
    all stay or none.  An empty table stays empty.
    """
    index = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_id_col, label_col, examples, neighbours, seed))
    at_id, at_text = docs.columns.index(id_col), docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value.known()
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                score = _judged(index.value, known, part.column(at_id).to_pylist(), part.column(at_text).to_pylist(), neighbours)[2]
                yield part.filter(pa.array(score < cutoff))

    return docs.mapInArrow(keep, docs.schema)
