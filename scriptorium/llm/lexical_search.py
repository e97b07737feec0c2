"""Ranked lexical search: posting lists in geometric blocks, skipped only where exact bounds fail.

Documents become sparse vectors of impacts over the terms that are asked for. Each task cuts its documents into shards of bounded
size, and each shard has an inverted index: the posting list of a term is clustered by the similarity of its documents
(nearest of some members of the list, in a random projection of the vectors), and a cluster is a block. A block's summary is the coordinatewise
maximum of its documents' vectors, so the question's product with it bounds the score of every document in the block.

A question walks the blocks of its terms' lists from the highest bound down, scores the documents of a block exactly, and stops where the bound
is below the score of its last place; a bound that equals it is followed, since a tie can go to a smaller key. The scores of the last places
are carried from shard to shard. A frequent term's list is spread over all shards, so there is no hot term.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import checkpointed, per_batch, text_list

#: (Term, item) pairs of the questions that one pass over the texts serves; more items take more passes.
VOCABULARY = 1_000_000
#: Documents and postings of a shard.
SHARD = 2048
SHARD_POSTINGS = 400_000
#: Documents that a block has on average. Lists of no more documents are one block.
BLOCK = 64
#: A document of more terms is a block of its own in all its lists; its summary is its vector.
LONG = 4096
#: Numbers of a projected vector, by which documents are compared.
PROJECTED = 16
#: Entries, and cells of a dense table, that summaries are made from at a time.
ENTRIES, CELLS = 2_000_000, 8_000_000
SEED = 42

#: Bytes of terms, with A-Z lower-cased; all others become blanks.
_TERM_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    # No byte of a term is white space to split().
    return (text or "").encode("utf-8", "replace").translate(_TERM_BYTES).split()


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What a term adds to a score per unit of weight, for documents of ``n`` terms among ``docs`` documents of ``terms`` terms."""
    m = 100 - 25 + (25 * n * docs) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def asked_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """``(item, term, times)`` of the questions. Repeated rows count once; several texts of one item are one question."""

    def work(batch):
        places, terms, times = [], [], []
        for i, body in enumerate(text_list(batch.column(1))):
            for term, count in Counter(terms_of(body)).items():
                places.append(i)
                terms.append(term)
                times.append(count)
        arrays = [batch.column(0).take(pa.array(places, pa.int32())), pa.array(terms, pa.binary()), pa.array(times, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["item", "term", "times"])

    rows = items.select(items[item].alias("item"), items[text].alias("text")).distinct()
    made = rows.mapInArrow(per_batch(work), f"item {rows.schema['item'].dataType.simpleString()}, term binary, times bigint")
    return made.groupBy("item", "term").agg(F.sum("times").alias("times"))


def document_vectors(docs: DataFrame, key: str, text: str, vocabulary) -> DataFrame:
    """``(key, n, terms, tfs)`` of every document with a term: the number of its terms, and those of the broadcast vocabulary with their counts."""

    def work(batch):
        number = vocabulary.value
        places, sizes, ends, terms, tfs = [], [], [0], [], []
        for i, body in enumerate(text_list(batch.column(1))):
            words = terms_of(body)
            if not words:
                continue
            found = Counter(map(number.get, words))
            found.pop(None, None)
            places.append(i)
            sizes.append(len(words))
            terms += found.keys()
            tfs += found.values()
            ends.append(len(terms))
        ends = pa.array(ends, pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(values, kind)) for values, kind in ((terms, pa.int32()), (tfs, pa.int64()))]
        arrays = [batch.column(0).take(pa.array(places, pa.int32())), pa.array(sizes, pa.int64()), *lists]
        return pa.RecordBatch.from_arrays(arrays, ["key", "n", "terms", "tfs"])

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(per_batch(work), f"key {rows.schema['key'].dataType.simpleString()}, n bigint, terms array<int>, tfs array<bigint>")


def statistics(vectors: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents, all their terms, and the documents of each term of the vocabulary; summed within tasks first."""

    def work(batches):
        df, docs, terms = np.zeros(size, "i8"), 0, 0
        for batch in batches:
            df += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
            docs += batch.num_rows
            terms += pc.sum(batch.column("n")).as_py() or 0
        seen = np.flatnonzero(df)
        numbers = np.concatenate([[-1, -2], seen])
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(np.concatenate([[docs, terms], df[seen]]), pa.int64())], ["term", "n"])

    summed = vectors.select("n", "terms").mapInArrow(work, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {row["term"]: row["n"] for row in summed}
    return found.get(-1, 0), found.get(-2, 0), np.array([found.get(i, 0) for i in range(size)], "i8")


class Shard:
    """An inverted index over some documents: rows of ``ptr``, ``term``, ``impact`` (a sparse matrix), and a weight per term for comparing documents."""

    def __init__(self, ptr: np.ndarray, term: np.ndarray, impact: np.ndarray, weights: np.ndarray):
        self.terms, coord = np.unique(term, return_inverse=True)
        self.ptr, self.coord, self.impact = ptr, coord, impact
        self.nnz = np.diff(ptr)
        self.long = np.flatnonzero(self.nnz > LONG)
        doc_of = np.repeat(np.arange(len(self.nnz)), self.nnz)
        listed = self.nnz[doc_of] <= LONG
        order = np.argsort(coord[listed], kind="stable")
        self.posting = doc_of[listed][order]
        self.list_ptr = np.r_[0, np.cumsum(np.bincount(coord[listed], minlength=len(self.terms)))]
        self._cluster(weights)
        self._summarise()

    def _sketch(self, weights: np.ndarray) -> np.ndarray:
        """Every document's vector, projected and scaled to unit length."""
        random = np.random.default_rng(SEED).standard_normal((len(self.terms), PROJECTED), dtype="f4")
        scaled = random[self.coord] * (self.impact * weights[self.terms[self.coord]]).astype("f4")[:, None]
        out = np.zeros((len(self.nnz), PROJECTED), "f4")
        filled = np.flatnonzero(self.nnz)
        if len(filled):
            out[filled] = np.add.reduceat(scaled, self.ptr[filled])
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def _cluster(self, weights: np.ndarray) -> None:
        """Cut every posting list into blocks of similar documents."""
        sketch, sizes = self._sketch(weights), np.diff(self.list_ptr)
        starts = [self.list_ptr[:-1][sizes > 0]]
        for t in np.flatnonzero(sizes > BLOCK):
            a, b = self.list_ptr[t], self.list_ptr[t + 1]
            members = self.posting[a:b]
            pivots = members[np.linspace(0, b - a - 1, -(-(b - a) // BLOCK)).astype(int)]
            nearest = (sketch[members] @ sketch[pivots].T).argmax(axis=1)
            order = np.argsort(nearest, kind="stable")
            self.posting[a:b] = members[order]
            starts.append(a + 1 + np.flatnonzero(np.diff(nearest[order])))
        self.block_start = np.sort(np.concatenate(starts))
        self.block_end = np.r_[self.block_start[1:], len(self.posting)]
        self.first_block = np.searchsorted(self.block_start, self.list_ptr)

    def _summarise(self) -> None:
        """The coordinatewise maxima of all blocks, by coordinate: ``(sum_ptr, sum_block, sum_max)``."""
        width, blocks = len(self.terms), len(self.block_start)
        entries = np.r_[0, np.cumsum(self.nnz[self.posting])]
        before = entries[np.r_[self.block_start, len(self.posting)]]
        found, a = [], 0
        while a < blocks:
            b = int(min(a + max(1, CELLS // max(width, 1)), max(a + 1, np.searchsorted(before, before[a] + ENTRIES, "right") - 1)))
            docs = self.posting[self.block_start[a] : self.block_end[b - 1]]
            times = self.nnz[docs]
            place = np.repeat(self.ptr[docs] - np.cumsum(times) + times, times) + np.arange(times.sum())
            block = np.repeat(np.repeat(np.arange(b - a), self.block_end[a:b] - self.block_start[a:b]), times)
            dense = np.zeros((b - a) * width, "i4")
            np.maximum.at(dense, block * width + self.coord[place], self.impact[place].astype("i4"))
            cells = np.flatnonzero(dense)
            found.append((cells % width, cells // width + a, dense[cells]))
            a = b
        coord, block, value = (np.concatenate(part) for part in zip(*found, strict=True)) if found else (np.empty(0, "i8"),) * 3
        order = np.argsort(coord, kind="stable")
        self.sum_ptr = np.r_[0, np.cumsum(np.bincount(coord, minlength=width))]
        self.sum_block, self.sum_max = block[order].astype("i4"), value[order].astype("i4")

    def bounds(self, coords: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Of every block, the question's product with its summary."""
        out = np.zeros(len(self.block_start), "i8")
        for t, w in zip(coords, weights, strict=True):
            a, b = self.sum_ptr[t], self.sum_ptr[t + 1]
            out[self.sum_block[a:b]] += w * self.sum_max[a:b]
        return out

    def scores(self, docs: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Exact scores of documents with at least one term each."""
        times = self.nnz[docs]
        ends = np.cumsum(times)
        place = np.repeat(self.ptr[docs] - ends + times, times) + np.arange(ends[-1])
        return np.add.reduceat(dense[self.coord[place]] * self.impact[place], ends - times)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Offer all documents that can be among the best of a question; returns the number of blocks that were read."""
        coords = np.searchsorted(self.terms, terms)
        known = coords < len(self.terms)
        known[known] = self.terms[coords[known]] == terms[known]
        coords, weights = coords[known], weights[known]
        if not len(coords):
            return 0
        dense = np.zeros(len(self.terms), "i8")
        dense[coords] = weights
        if len(self.long):
            best.offer(self.long, self.scores(self.long, dense))
        bound = self.bounds(coords, weights)
        blocks = np.concatenate([np.arange(self.first_block[t], self.first_block[t + 1]) for t in coords])
        blocks = blocks[bound[blocks] >= best.least]
        blocks = blocks[np.argsort(-bound[blocks], kind="stable")]
        fresh, read, step = np.ones(len(self.nnz), bool), 0, 4
        while read < len(blocks) and bound[blocks[read]] >= best.least:
            chosen = blocks[read : read + step]
            chosen = chosen[bound[chosen] >= best.least]
            read, step = read + len(chosen), min(step * 2, 64)
            docs = np.concatenate([self.posting[self.block_start[b] : self.block_end[b]] for b in chosen])
            docs = np.unique(docs[fresh[docs]])
            if len(docs):
                fresh[docs] = False
                best.offer(docs, self.scores(docs, dense))
        return read


class Best:
    """The first ``k`` of a question: higher scores first, equal ones by key, null first. Scores of 0 do not count."""

    def __init__(self, k: int):
        self.k, self.rows, self.keys, self.order = k, [], None, None

    @property
    def least(self) -> int:
        """A score below this cannot enter."""
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def at(self, keys: pa.Array, order: np.ndarray) -> Best:
        """The keys of the documents that are offered next, and their order."""
        self.keys, self.order = keys, order
        return self

    def offer(self, docs: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.least
        if good.any():
            docs, scores = docs[good], scores[good]
            first = np.lexsort((self.order[docs], -scores))[: self.k]
            keys = self.keys.take(pa.array(docs[first])).to_pylist()
            made = [(-int(s), key is not None, key) for s, key in zip(scores[first], keys, strict=True)]
            self.rows = sorted([*self.rows, *made])[: self.k]


def _searcher(questions, weights, docs: int, total: int, k: int):
    """For mapInArrow over vectors: shard by shard, the best documents of every question."""

    def run(batches):
        asked = questions.value
        best = [Best(k) for _ in asked]

        def search(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            keys, n = table.column("key").combine_chunks(), table.column("n").to_numpy()
            terms = table.column("terms").combine_chunks()
            sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype("i8")
            tf = table.column("tfs").combine_chunks().flatten().to_numpy()
            made = impacts(tf, np.repeat(n, sizes), docs, total)
            shard = Shard(np.r_[0, np.cumsum(sizes)], terms.flatten().to_numpy(), made, weights)
            order = np.empty(len(keys), "i8")
            order[pc.sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(len(keys))
            for (_, numbers, times), found in zip(asked, best, strict=True):
                shard.search(numbers, times * weights[numbers], found.at(keys, order))

        held, rows, postings, kind = [], 0, 0, None
        for batch in batches:
            kind = batch.schema.field("key").type
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("terms")), 0))
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, SHARD - rows)
                held.append(part)
                at, rows, postings = at + part.num_rows, rows + part.num_rows, postings + len(part.column("terms").flatten())
                if rows >= SHARD or postings >= SHARD_POSTINGS:
                    search(held)
                    held, rows, postings = [], 0, 0
        if held:
            search(held)
        places = [i for i, found in enumerate(best) for _ in found.rows]
        keys = [row[2] for found in best for row in found.rows]
        scores = [-row[0] for found in best for row in found.rows]
        if places:
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(keys, kind), pa.array(scores, pa.int64())], ["question", "key", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, key: str, item: str, text: str = "text", item_text: str = "text", k: int = 20, vocabulary: int = VOCABULARY) -> DataFrame:
    """``(item, rank, key, score)``: the ``k`` highest-scoring documents of every item, with a score above 0.

    Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, with A-Z lower-cased; null texts have none. Equal
    scores go by ascending key, null first. Repeated documents are documents of their own; repeated items count once, and the texts
    of one item make one question; the null item is one too. Statistics are those of all documents. No documents or no items give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    asked = checkpointed(asked_terms(items, item, item_text))
    passes = max(1, -(-asked.count() // vocabulary))
    found = []
    for number in range(passes):
        # About ``vocabulary`` pairs of the stated questions; their number of passes grows with the questions, not with the documents.
        pairs = asked.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == number).collect()
        names = {term: i for i, term in enumerate(sorted({bytes(p["term"]) for p in pairs}))}
        grouped: dict = {}
        for p in pairs:
            grouped.setdefault(p["item"], []).append((names[bytes(p["term"])], p["times"]))
        questions = [(name, *(np.array(column, "i8") for column in zip(*sorted(terms), strict=True))) for name, terms in grouped.items()]
        vectors = checkpointed(document_vectors(docs, key, text, spark.sparkContext.broadcast(names)))
        n_docs, n_terms, df = statistics(vectors, len(names))
        weights = np.array([weight(int(d), n_docs) for d in df], "i8")
        schema = f"question int, key {vectors.schema['key'].dataType.simpleString()}, score bigint"
        best = vectors.mapInArrow(_searcher(spark.sparkContext.broadcast(questions), weights, n_docs, n_terms, k), schema)
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "key"))).filter(F.col("rank") <= k)
        kind = items.schema[item].dataType.simpleString()
        labels = spark.createDataFrame([(i, q[0]) for i, q in enumerate(questions)], f"question int, item {kind}")
        found.append(ranked.join(labels, "question").select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score"))
    return reduce(DataFrame.unionByName, found)
