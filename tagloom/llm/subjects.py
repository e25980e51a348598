"""Subject areas of each document, and the make-up of the corpus by area.

Method: normalised document vectors are clustered by bisecting k-means. A vector
sums what the terms of a document say about areas, by the labelled documents that
hold them, so documents of one subject are near in any language. The tree is
fitted on at most ``FIT`` labelled documents; then every document of the corpus,
labelled or not, is put into its leaf. A leaf has a mixture of areas, that of the labelled
documents in it. A term is discriminative when the mixtures of the leaves that
hold it agree on an area; such terms label the leaves and carry their area. Only
leaves give terms an area, also terms that no labelled document holds. The mixture
is then resolved per sentence: a sentence has the area its terms agree on, terms
are weighed again by the areas of the sentences that hold them, and a document has
every area of at least two of its sentences (or of the whole of a shorter text).

Counts, leaves and weights cover all documents; copies of a text count once, so a
text that is often reposted is no formula. Only the term list travels with the
tasks: terms must be frequent relative to the corpus, so its size is bounded
(``MAX_TERMS`` is checked).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import wordhash
from tagloom.session import cut, small_rows, stored

#: Terms must stand in so large a share of the documents, and in so many at least.
MIN_SHARE, MIN_DOCS = 1 / 2500, 4
#: Terms in a larger share say nothing.
MAX_SHARE = 0.2
MAX_TERMS = 400_000
#: Terms a task counts at once before it hands them on; terms of one row of sums.
HELD, BLOCK = 4_000_000, 512
#: A sentence, digits and marks aside, that stands in this share of the documents is a formula.
FORMULA = 0.012
#: Leaves of the tree, and passes per division.
LEAVES, PASSES = 64, 8
#: The tree is fitted on at most so many labelled documents.
FIT = 8_000
#: Least share of an area among the labelled documents of a term that counts in a document vector.
VOTED = 0.45
#: Least share of its leaves' mixtures that the area of a term has.
LEAF = 0.48
#: Rounds of weighing terms by sentences; the least share of a term's area in a round.
ROUNDS = (0.65, 0.8)
#: A text of so many sentences, formulas aside, may have its area from one of them.
SHORT = 3
#: A sentence pattern is a passing mention where its area is alone in the document in this share of cases.
PASSING = 0.6
#: Areas of the subject list; they are a dimension.
MAX_AREAS = 10_000


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def _text_votes(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, votes): votes of the labelled copies of a text; they share one vote. The id is the hash of the text."""
    given = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("area_id").cast("int").alias("area_id")).where("id IS NOT NULL AND area_id IS NOT NULL").distinct()
    votes = given.select("id", "area_id", (F.lit(1.0) / F.count("*").over(_by("id"))).alias("w"))
    copies = rows.select("id", F.xxhash64("text").alias("text")).distinct()
    of_text = copies.join(votes, "id").groupBy("text", "area_id").agg(F.sum("w").alias("w"))
    shared = of_text.select(F.col("text").alias("id"), "area_id", (F.col("w") / F.sum("w").over(_by("text"))).alias("w"))
    return shared.groupBy("id").agg(F.collect_list(F.struct("area_id", "w")).alias("votes"))


def _distinct_texts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, text, votes): each text once, whatever its copies, beside the votes it has; texts are shuffled this once."""
    hashed = rows.select(F.xxhash64("text").alias("id"), "text").repartition("id").sortWithinPartitions("id")
    return hashed.dropDuplicates(["id"]).join(_text_votes(rows, labels), "id", "left")


def _hash_counts(docs: DataFrame) -> DataFrame:
    """(sentence, h, n): documents with each sentence and with each term, by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[np.ndarray]] = {True: [], False: []}
        for b in batches:
            for texts, doc in wordhash.pieces(b.column(0).to_pylist()):
                t = wordhash.terms(texts)
                held[True].append(wordhash.once(doc[t.sent_doc], t.sent_hash))
                held[False].append(wordhash.once(doc[t.sent_doc[t.term_sent]], t.term_hash))
                if sum(map(len, held[False])) > HELD:
                    yield from flush(held)
        yield from flush(held)

    def flush(held: dict[bool, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for sentence, parts in held.items():
            if parts:
                h, n = wordhash.counted(np.concatenate(parts))
                parts.clear()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), sentence)), pa.array(h.view(np.int64)), pa.array(n)], ["sentence", "h", "n"])

    return docs.select("text").mapInArrow(run, "sentence boolean, h long, n long").groupBy("sentence", "h").agg(F.sum("n").alias("n"))


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)


def _joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _sentence_terms(docs: DataFrame, formulas: np.ndarray, known: np.ndarray) -> DataFrame:
    """(id, votes, sents): the numbers of the known terms of each sentence outside formulas, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, formula, m = wordhash.Lookup(known), wordhash.Lookup(formulas), max(1, len(known))
        for b in batches:
            sents, sizes, terms = np.zeros(b.num_rows, np.int64), [], []
            for texts, doc in wordhash.pieces(b.column(2).to_pylist()):
                t = wordhash.terms(texts)
                counts = np.ones(len(t.sent_doc), bool)
                counts[formula(t.sent_hash)[0]] = False
                number = np.cumsum(counts) - 1
                at, term = find(t.term_hash)
                at = t.term_sent[at]
                kept = counts[at]
                key, _ = wordhash.counted(number[at[kept]] * m + term[kept])
                sent = key // m
                sents += np.bincount(doc[t.sent_doc[counts]], minlength=len(sents))
                sizes.append(np.bincount(sent, minlength=counts.sum()))
                terms.append((key - sent * m).astype(np.int32))
            inner = _lists(_joined(sizes, np.int64), pa.array(_joined(terms, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(sents, inner)], ["id", "votes", "sents"])

    votes = docs.schema["votes"].dataType.simpleString()
    return docs.select("id", "votes", "text").mapInArrow(run, f"id long, votes {votes}, sents array<array<int>>")


class _Batch:
    """The lists of a batch as flat arrays: document of each sentence, sentence and term of each entry."""

    def __init__(self, column: pa.Array) -> None:
        sents = column.flatten()
        self.docs = len(column)
        self.size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.doc = np.repeat(np.arange(self.docs), self.size)
        self.term = sents.flatten().to_numpy(zero_copy_only=False)
        self.sent = np.repeat(np.arange(len(sents)), sents.value_lengths().to_numpy(zero_copy_only=False))


class _Scores:
    """Weights of terms as arrays by term number; area 0 of the list is none."""

    def __init__(self, weights: dict[int, tuple[int, float]], known: np.ndarray) -> None:
        self.areas = np.array([0, *sorted({a for a, _ in weights.values()})])
        place = {a: i for i, a in enumerate(self.areas.tolist())}
        self.area, self.score = np.zeros(len(known), np.int64), np.zeros(len(known))
        for t, (a, w) in weights.items():
            self.area[t], self.score[t] = place[a], w * w * (1 + (known[t] & 1))

    def tops(self, b: _Batch) -> np.ndarray:
        """The area each sentence's terms agree on, 0 for none."""
        k = len(self.areas)
        weighed = self.score[b.term] > 0
        term, sent = b.term[weighed], b.sent[weighed]
        by = np.bincount(sent * k + self.area[term], self.score[term], len(b.doc) * k).reshape(-1, k)
        if not len(by):
            return np.zeros(0, np.int64)
        top, best = by.argmax(1), by.max(1)
        np.put_along_axis(by, top[:, None], 0.0, 1)
        top[best <= 1.5 * by.max(1)] = 0
        return top


def _summed(sents: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray], finish: Callable[[int, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """Sums per term over the whole table: a task hands its sums on in blocks of ``BLOCK`` terms; ``finish`` sees the total of a block."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = partial(batches)
        at = [i for i in range(0, len(m), BLOCK) if m[i : i + BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([m[i : i + BLOCK].tobytes() for i in at], pa.binary()), pa.array([m.shape[1]] * len(at), pa.int32())], ["at", "sums", "k"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for at, data, k in zip(*[c.to_pylist() for c in b.columns]):
                m = np.frombuffer(data).reshape(-1, k)
                sums[at] = sums[at] + m if at in sums else m
        for at, m in sums.items():
            yield finish(at, m)

    return sents.mapInArrow(parts, "at int, sums binary, k int").repartition("at").mapInArrow(total, schema)


def _term_votes(sents: DataFrame, n_terms: int, least: float) -> tuple[dict[int, tuple[int, float]], list[int]]:
    """term -> (area, share) among the labelled documents, with a margin for chance; and the areas that have labels."""
    labelled = sents.where("votes IS NOT NULL")
    areas = sorted(r[0] for r in small_rows(labelled.select(F.inline("votes")).select("area_id").distinct(), MAX_AREAS))
    place = {a: i for i, a in enumerate(areas)}
    dense = F.transform(F.array(*[F.lit(a) for a in areas]), lambda a: F.aggregate("votes", F.lit(0.0), lambda s, v: s + F.when(v["area_id"] == a, v["w"]).otherwise(0.0)))

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        sums = np.zeros((n_terms, len(areas)))
        for b in batches:
            x, w = _Batch(b.column(0)), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(areas))
            key, _ = wordhash.counted(x.doc[x.sent] * n_terms + x.term)
            for i in range(len(areas)):
                sums[:, i] += np.bincount(key % n_terms, w[key // n_terms, i], n_terms)
        return sums

    def finish(at: int, m: np.ndarray) -> pa.RecordBatch:
        share = (m.max(1) - 1) / (m.sum(1) + 1)
        t = np.flatnonzero(share >= least)
        return pa.RecordBatch.from_arrays([pa.array(at + t, pa.int32()), pa.array(np.array(areas)[m[t].argmax(1)], pa.int32()), pa.array(share[t])], ["term", "area", "share"])

    rows = small_rows(_summed(labelled.select("sents", dense.alias("w")), partial, finish, "term int, area int, share double"), n_terms) if place else []
    return {r["term"]: (r["area"], r["share"]) for r in rows}, areas


class _Profiles:
    """Document vectors: the sum of the area shares of a document's terms, of length 1; documents of one subject are near in every language."""

    def __init__(self, votes: dict[int, tuple[int, float]], areas: list[int], n_terms: int) -> None:
        place = {a: i for i, a in enumerate(areas)}
        self.k, self.area, self.share = len(areas), np.zeros(n_terms, np.int64), np.zeros(n_terms)
        for t, (a, w) in votes.items():
            self.area[t], self.share[t] = place[a], w

    def __call__(self, x: _Batch) -> np.ndarray:
        counts = self.share[x.term] > 0
        term, doc = x.term[counts], x.doc[x.sent[counts]]
        v = np.bincount(doc * self.k + self.area[term], self.share[term], x.docs * self.k).reshape(-1, self.k)
        return v / np.linalg.norm(v, axis=1, keepdims=True).clip(1e-12)


def _vectors(sents: DataFrame, profiles: _Profiles) -> DataFrame:
    """(features) of the documents."""
    from pyspark.ml.functions import array_to_vector

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = profiles(_Batch(b.column(0)))
            yield pa.RecordBatch.from_arrays([_lists(np.full(len(v), profiles.k), pa.array(v.ravel()))], ["v"])

    return sents.select("sents").mapInArrow(run, "v array<double>").select(array_to_vector("v").alias("features"))


def _leaf_terms(sents: DataFrame, n_terms: int) -> dict[int, tuple[int, float]]:
    """term -> (area, share): the area that the leaves of the documents with a term have most of, by their mixtures."""
    from pyspark.ml.clustering import BisectingKMeans

    voted, areas = _term_votes(sents, n_terms, VOTED)
    if not voted:
        return {}
    # the order of the ids, which are hashes, is a random order
    chosen = sents.where("votes IS NOT NULL").select("id", "sents").orderBy("id").limit(FIT)
    profiles = _Profiles(voted, areas, n_terms)
    model = BisectingKMeans(k=LEAVES, maxIter=PASSES, seed=7, minDivisibleClusterSize=4.0).fit(cut(_vectors(chosen, profiles)))
    centers = np.array(model.clusterCenters())
    half = (centers**2).sum(1) / 2

    def leaf_of(x: _Batch) -> np.ndarray:
        """The leaf whose centre is nearest to each document."""
        return (profiles(x) @ centers.T - half).argmax(1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(leaf_of(_Batch(b.column(0))), pa.int32()), b.column(1)], ["leaf", "votes"])

    labelled = sents.where("votes IS NOT NULL").select("sents", "votes")
    leaves = labelled.mapInArrow(place, f"leaf int, votes {labelled.schema['votes'].dataType.simpleString()}").select("leaf", F.inline("votes"))
    rows = small_rows(leaves.groupBy("leaf", "area_id").agg(F.sum("w").alias("w")), LEAVES * MAX_AREAS)
    mix = np.zeros((LEAVES, len(areas)))
    for r in rows:
        mix[r["leaf"], areas.index(r["area_id"])] = r["w"]
    mix /= mix.sum(1, keepdims=True) + 0.5

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        counts = np.zeros(n_terms * LEAVES, np.int64)
        for b in batches:
            x = _Batch(b.column(0))
            key, _ = wordhash.counted(x.doc[x.sent] * n_terms + x.term)
            doc = key // n_terms
            counts += np.bincount((key - doc * n_terms) * LEAVES + leaf_of(x)[doc], minlength=len(counts))
        counts = counts.reshape(-1, LEAVES)
        return np.column_stack([counts.sum(1), counts @ mix])

    def finish(at: int, m: np.ndarray) -> pa.RecordBatch:
        share = m[:, 1:].max(1) / np.maximum(m[:, 0], 1)
        t = np.flatnonzero(share >= LEAF)
        return pa.RecordBatch.from_arrays([pa.array(at + t, pa.int32()), pa.array(np.array(areas)[m[t, 1:].argmax(1)], pa.int32()), pa.array(share[t])], ["term", "area", "share"])

    return {r["term"]: (r["area"], r["share"]) for r in small_rows(_summed(sents.select("sents"), partial, finish, "term int, area int, share double"), n_terms)}


def _weigh(sents: DataFrame, weights: dict[int, tuple[int, float]], known: np.ndarray, least_share: float, least: float) -> tuple[dict[int, tuple[int, float]], np.ndarray]:
    """Weights by the sentences that hold a term, and the terms of passing mentions.

    A sentence has the area its terms agree on where another sentence of the document bears it out. A term that
    stands mostly in sentences whose area is alone in the document is a passing mention.
    """
    scores = _Scores(weights, known)
    k, areas = len(scores.areas), scores.areas

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        n, alone = np.zeros(len(known) * k, np.int64), np.zeros(len(known), np.int64)
        for b in batches:
            x = _Batch(b.column(0))
            top = scores.tops(x)
            per = np.bincount(x.doc * k + top, minlength=x.docs * k)
            borne = np.where(per[x.doc * k + top] > 1, top, 0)
            # too short to bear out the area of a sentence by others
            counts = (x.size > SHORT)[x.doc]
            here = counts[x.sent]
            term, sent = x.term[here], x.sent[here]
            n += np.bincount(term.astype(np.int64) * k + borne[sent], minlength=len(n))
            alone += np.bincount(term[((top > 0) & (borne == 0))[sent]], minlength=len(alone))
        return np.column_stack([alone, n.reshape(-1, k)]).astype(float)

    def finish(at: int, m: np.ndarray) -> pa.RecordBatch:
        alone, n = m[:, 0], m[:, 1:]
        borne = n[:, 1:].sum(1) + alone
        top = n[:, 1:].max(1, initial=0.0)
        share = top / np.maximum(n.sum(1), 1)
        weighed = (share >= least_share) & (top >= max(3, least / 2))
        t = np.flatnonzero(weighed | (borne >= max(5, least)) & (alone >= PASSING * borne))
        area = areas[1 + n[t, 1:].argmax(1)] if k > 1 else np.zeros(len(t), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(at + t, pa.int32()), pa.array(area, pa.int32()), pa.array(share[t]), pa.array(weighed[t])], ["term", "area", "share", "weighed"])

    rows = small_rows(_summed(sents.select("sents"), partial, finish, "term int, area int, share double, weighed boolean"), len(known))
    return {r["term"]: (r["area"], r["share"]) for r in rows if r["weighed"]}, np.array([r["term"] for r in rows if not r["weighed"]], np.int64)


def _areas(sents: DataFrame, weights: dict[int, tuple[int, float]], passing: np.ndarray, known: np.ndarray) -> DataFrame:
    """(text, area_id): areas of two sentences or more, or of the one there is in a shorter text; passing mentions count for nothing."""
    scores = _Scores(weights, known)
    k, areas = len(scores.areas), scores.areas
    passed = np.zeros(len(known), bool)
    passed[passing] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _Batch(b.column(1))
            top = scores.tops(x)
            top[x.sent[passed[x.term]]] = 0
            per = np.bincount(x.doc * k + top, minlength=x.docs * k).reshape(-1, k)
            per[:, 0] = 0
            short = (x.size <= SHORT) & ((per > 0).sum(1) == 1)
            doc, area = ((per >= 2) | (per > 0) & short[:, None]).nonzero()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(areas[area], pa.int32())], ["text", "area_id"])

    return sents.select("id", "sents").mapInArrow(run, "text long, area_id int")


def document_areas(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, area_id): the areas each text is about.

    Null, empty and blank texts have none; repeated rows give their areas once;
    without labels or documents the result is empty; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").rlike(r"\w|[^\x00-\x7f]"))
    texts = stored(_distinct_texts(rows, labels))
    n = texts.count()
    if not n or not texts.where("votes IS NOT NULL").head(1):
        return docs.sparkSession.createDataFrame([], f"`{id_col}` long, area_id int")
    least = max(MIN_DOCS, MIN_SHARE * n)
    # no more than (terms of a document) / MIN_SHARE terms and (sentences of a document) / FORMULA sentences can pass
    frequent = F.when(F.col("sentence"), F.col("n") > max(8, FORMULA * n)).otherwise((F.col("n") >= least) & (F.col("n") <= max(MIN_DOCS, MAX_SHARE * n)))
    counted = small_rows(_hash_counts(texts).where(frequent), 2 * MAX_TERMS)
    formulas = np.array(sorted(r["h"] for r in counted if r["sentence"]), np.int64)
    known = np.array(sorted(r["h"] for r in counted if not r["sentence"]), np.int64)
    sents = stored(_sentence_terms(texts, formulas, known))
    weights, passing = _leaf_terms(sents, len(known)), np.zeros(0, np.int64)
    for least_share in ROUNDS:
        weights, passing = _weigh(sents, weights, known, least_share, least)
    by_text = _areas(sents, weights, passing, known)
    # a text may have many copies: its few areas are one row, and AQE splits a key that many rows share
    lists = by_text.groupBy("text").agg(F.collect_set("area_id").alias("areas"))
    return rows.select("id", F.xxhash64("text").alias("text")).join(lists, "text").select(F.col("id").alias(id_col), F.explode("areas").alias("area_id")).distinct()


def corpus_makeup(assigned: DataFrame, areas: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(area_id, area_name, n_docs, share): documents of each area of the list; a document with several counts for each."""
    total = assigned.agg(F.countDistinct(id_col).alias("docs"))
    counted = assigned.groupBy("area_id").agg(F.countDistinct(id_col).alias("n_docs"))
    listed = areas.select(F.col("area_id").cast("int").alias("area_id"), "area_name")
    joined = listed.join(counted, "area_id", "left").join(F.broadcast(total))  # one row
    return joined.select("area_id", "area_name", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.round(F.coalesce("n_docs", F.lit(0)) / F.greatest("docs", F.lit(1)), 4).alias("share"))
