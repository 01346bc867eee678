"""Search: filters, exact top-k by cosine, approximate search, fusion, reranking, evidence gates."""

from __future__ import annotations

import bisect
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.functions import text as t
from larkspur.functions import vectors as v
from larkspur.functions.extents import Extents
from larkspur.functions.passages import UNEVEN, Passages, letters
from larkspur.operators import chunking

RRF_K = 60
MIN_SCORE = 0.45
BROADCAST_QUERIES = 10_000
LEXICAL_QUERIES = 2_000


def searchable(chunks: DataFrame, documents: DataFrame, *, file_type: str | None = None, model: str | None = None, corpus: str | None = None, classifications: Collection[str] | None = None, latest_only: bool = False) -> DataFrame:
    """Chunks of indexed documents that pass the filters, with their document's columns. NULL classifications never
    pass a classification filter. Filters come before ranking, so a search always sees every chunk that passes."""
    docs = documents.where(F.col("status") == "INDEXED")
    if file_type is not None:
        docs = docs.where(F.col("file_type") == file_type)
    if corpus is not None:
        docs = docs.where(F.col("corpus") == corpus)
    if classifications is not None:
        docs = docs.where(F.col("classification").isin(sorted(classifications)))
    if latest_only:
        docs = docs.where("is_latest")
    if model is not None:
        chunks = chunks.where(F.col("embedding_model") == model)
    keep = [c for c in docs.columns if c == "document_id" or c not in chunks.columns]
    return chunks.join(docs.select(*keep), "document_id")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors of a list column as rows; NaN for NULL vectors, those of another width and those without direction."""
    flat = column.flatten()
    if not column.null_count and len(flat) == width * len(column) and not flat.null_count and (pc.list_value_length(column).to_numpy() == width).all():
        out = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    else:
        out = np.array([x if x is not None and len(x) == width else [np.nan] * width for x in column.to_pylist()], dtype=np.float64).reshape(-1, width)
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(length > 0, length, np.nan)


def _first(found: pa.Table, k: int) -> pa.Table:
    """The k best rows (q, item, score) of each q: highest score first, NULLs last, then by item."""
    found = found.take(pc.sort_indices(found, sort_keys=[("q", "ascending"), ("score", "descending"), ("item", "ascending")], null_placement="at_end"))
    q = found.column("q").to_numpy()
    begins = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(q)) - np.repeat(begins, np.diff(np.append(begins, len(q))))
    return found.filter(pa.array(place < k))


_EXCLUDED, _NO_SCORE = -3.0, -2.0


def _scored_topk(items: DataFrame, block: pa.Table, types: tuple, k: int, *, item: str, query: str, embedding: str, same: tuple[str, str] | None, cells: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """query, item, score: each partition's k best items of each query, by one matrix product for each batch of items.
    ``cells``: centroids, and which of them each query probes."""
    ids = block.column(query).combine_chunks()
    first = next((x for x in block.column(embedding).to_pylist() if x is not None), [])
    width = len(first)
    vectors = _matrix(block.column(embedding).combine_chunks(), width) if width else np.full((len(ids), 1), np.nan)
    keys = block.column(same[1]).to_pylist() if same else None
    columns = [item, embedding, *([same[0]] if same else [])]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        floor = np.full(len(ids), _EXCLUDED + 0.5)
        for b in (whole.slice(x, 2048) for whole in batches for x in range(0, whole.num_rows, 2048)):
            e = _matrix(b.column(1), width) if width else np.full((b.num_rows, 1), np.nan)
            scores = np.nan_to_num(vectors @ e.T, nan=_NO_SCORE)
            if keys is not None:
                own = b.column(2).to_pylist()
                code = {x: n for n, x in enumerate(dict.fromkeys([*keys, *own])) if x is not None}
                left, right = (np.array([code.get(x, -1 - at) for x in side]) for at, side in enumerate((keys, own)))
                scores[left[:, None] != right[None]] = _EXCLUDED
            if cells is not None:
                scores[~cells[1][:, np.argmax(np.nan_to_num(e) @ cells[0].T, axis=1)]] = _EXCLUDED
            if b.num_rows > k:
                floor = np.maximum(floor, np.partition(scores, -k, axis=1)[:, -k])
            q, i = np.nonzero(scores >= floor[:, None])
            found = scores[q, i]
            held.append(pa.table({"q": pa.array(q), "item": b.column(0).take(pa.array(i)), "score": pa.array(found, mask=found == _NO_SCORE)}))
            if sum(t.num_rows for t in held) > 1 << 20:
                held = [_first(pa.concat_tables(held), k)]
        if held:
            out = _first(pa.concat_tables(held), k)
            yield from pa.table({"query": ids.take(out.column("q").combine_chunks()), "item": out.column("item"), "score": out.column("score")}).combine_chunks().to_batches()

    return items.select(*columns).mapInArrow(best, f"query {types[0]}, item {types[1]}, score double").select(F.col("query").alias(query), F.col("item").alias(item), "score")


def _ranked(scored: DataFrame, k: int, item: str, query: str) -> DataFrame:
    order = Window.partitionBy(query).orderBy(F.desc_nulls_last("score"), item)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cosine_topk(items: DataFrame, queries: DataFrame, k: int, *, item: str = "item_id", query: str = "query_id", embedding: str = "embedding", same: tuple[str, str] | None = None, cells=None) -> DataFrame:
    """The ``k`` best items of each query by cosine: query, item, score, rank; ties go to the smaller item id, items
    without a cosine come last. ``same``: a column of items and one of queries that must be equal.

    The queries are a stated set. Blocks of BROADCAST_QUERIES of them go to the items' partitions, whose every batch is
    multiplied with the block; a partition keeps its own top k, so nothing but that is shuffled.
    """
    asked = queries.select(query, embedding, *([same[1]] if same else []))
    types = asked.schema[query].dataType.simpleString(), items.schema[item].dataType.simpleString()
    n = max(1, -(-asked.count() // BROADCAST_QUERIES))
    parts = []
    for k_ in range(n):
        block = (asked.where(F.pmod(F.xxhash64(query), F.lit(n)) == k_) if n > 1 else asked).toArrow()
        parts.append(_scored_topk(items, block, types, k, item=item, query=query, embedding=embedding, same=same, cells=cells(block) if cells else None))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _ranked(out, k, item, query)


def fit_cells(sample: np.ndarray, k: int, recall: float, seed: int) -> tuple[np.ndarray, int]:
    """Centroids of unit vectors, about the root of their number, and how many of them a query has to probe so that
    ``recall`` of the sample's own nearest neighbours are met."""
    rng = np.random.default_rng(seed)
    n = max(1, min(256, int(len(sample) ** 0.5)))
    centroids = sample[rng.choice(len(sample), n, replace=False)]
    for _ in range(12):
        own = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 0, sums / np.where(length > 0, length, 1), centroids)
    own = np.argmax(sample @ centroids.T, axis=1)
    probe = sample[rng.choice(len(sample), min(256, len(sample)), replace=False)]
    near = np.argsort(-(probe @ sample.T), axis=1)[:, : k + 1]
    place = np.argsort(np.argsort(-(probe @ centroids.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).reshape(-1))
    return centroids, int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def cell_topk(items: DataFrame, queries: DataFrame, k: int, *, sample: int = 8192, recall: float = 0.96, seed: int = 5, item: str = "item_id", query: str = "query_id", embedding: str = "embedding") -> DataFrame:
    """Approximate top k: cells are fitted on at most ``sample`` items (those of smallest hash), every item falls into one,
    and a query sees the items of the cells nearest to it, as many as the sample needs for ``recall``. Without
    structure in the vectors that is most cells; in clustered ones it is few."""
    chosen = items.where(F.col(embedding).isNotNull()).orderBy(F.xxhash64(item)).limit(sample).select(embedding).toArrow()
    vectors = _matrix(chosen.column(0).combine_chunks(), len(chosen.column(0)[0])) if chosen.num_rows else np.zeros((0, 1))
    vectors = vectors[~np.isnan(vectors).any(axis=1)]
    if not len(vectors):
        return cosine_topk(items, queries, k, item=item, query=query, embedding=embedding)
    centroids, probes = fit_cells(vectors, k, recall, seed)

    def cells(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        q = np.nan_to_num(_matrix(block.column(embedding).combine_chunks(), centroids.shape[1]))
        near = np.argsort(np.argsort(-(q @ centroids.T), axis=1), axis=1)
        return centroids, near < probes

    return cosine_topk(items, queries, k, item=item, query=query, embedding=embedding, cells=cells)


def lexical_topk(items: DataFrame, questions: DataFrame, k: int, *, item: str = "item_id", query: str = "query_id") -> DataFrame:
    """The k best of all items by word similarity of question and text, then by cosine, then by id: query, item, lexical,
    score, rank. items: item, text, embedding; questions: query, question, embedding - a stated set, blocks of LEXICAL_QUERIES of
    which go to the items' partitions. A text is compared once for all items that hold it in a batch, and only where bounds let it
    come among a partition's best."""
    asked = questions.select(query, "question", "embedding")
    types = asked.schema[query].dataType.simpleString(), items.schema[item].dataType.simpleString()
    n = max(1, -(-asked.count() // LEXICAL_QUERIES))
    found = None
    for k_ in range(n):
        block = (asked.where(F.pmod(F.xxhash64(query), F.lit(n)) == k_) if n > 1 else asked).toArrow()
        part = _lexical_block(items, block, types, k, item)
        found = part if found is None else found.unionByName(part)
    return lexical_rank(found.select(F.col("query").alias(query), F.col("item").alias(item), "lexical", "score"), k, query=query, item=item)


def _lexical_block(items: DataFrame, block: pa.Table, types: tuple, k: int, item: str) -> DataFrame:
    ids, first = block.column(0).combine_chunks(), next((x for x in block.column("embedding").to_pylist() if x is not None), [0.0])
    vectors = _matrix(block.column("embedding").combine_chunks(), len(first)) if block.num_rows else np.zeros((0, len(first)))
    asks = [x or "" for x in block.column("question").to_pylist()]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extents = Extents(asks)
        kept: list[list[tuple]] = [[] for _ in asks]
        floor = np.full(len(asks), -1.0)  # similarity of the last of the k best, once there are k
        kind = pa.null()
        for b in (whole.slice(x, 2048) for whole in batches for x in range(0, whole.num_rows, 2048)):
            kind = b.column(0).type
            cosine = np.nan_to_num(vectors @ _matrix(b.column(2), len(first)).T, nan=_NO_SCORE)
            names, same = b.column(0).to_pylist(), {}
            for at, text in enumerate(b.column(1).to_pylist()):
                same.setdefault(text or "", []).append(at)
            for text, places in same.items():
                lexical = extents.best(text, np.maximum(floor, 0.0))
                for q in np.flatnonzero(lexical >= floor).tolist():
                    mine = kept[q]
                    for at in places:
                        row = (-float(lexical[q]), -float(cosine[q, at]), names[at])
                        if len(mine) < k or row < mine[-1]:
                            bisect.insort(mine, row)
                            del mine[k:]
                    if len(mine) >= k:
                        floor[q] = -mine[-1][0]
        rows = [(q, name, -lexical, None if -score == _NO_SCORE else -score) for q, mine in enumerate(kept) for lexical, score, name in mine]
        if rows:
            q, names, lexical, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), pa.array(names, kind), pa.array(lexical, pa.float64()), pa.array(score, pa.float64())], ["query", "item", "lexical", "score"])

    return items.select(item, "text", "embedding").mapInArrow(best, f"query {types[0]}, item {types[1]}, lexical double, score double")


def candidates(k: int, rerank: int | None = None) -> int:
    """How many rows each channel of a hybrid search yields, or how many are reranked."""
    return max(k, rerank) if rerank is not None else max(4 * k, 20)


def fuse(vector: DataFrame, lexical: DataFrame, k: int | None = None, *, query: str = "query_id", item: str = "item_id") -> DataFrame:
    """Reciprocal rank fusion of two rankings (query, item, rank): sums of 1 / (60 + rank); ties keep the vector
    ranking's order, then the lexical one's."""
    a = vector.select(query, item, F.col("rank").alias("vec_rank"))
    b = lexical.select(query, item, F.col("rank").alias("lex_rank"))
    part = lambda r: F.coalesce(1.0 / (RRF_K + F.col(r)), F.lit(0.0))
    fused = a.join(b, [query, item], "full_outer").withColumn("rrf", part("vec_rank") + part("lex_rank"))
    order = Window.partitionBy(query).orderBy(F.desc("rrf"), F.asc_nulls_last("vec_rank"), F.asc_nulls_last("lex_rank"))
    fused = fused.withColumn("rank", F.row_number().over(order))
    return fused.where(F.col("rank") <= k) if k else fused


def rerank(ranked: DataFrame, scores: DataFrame, k: int, *, query: str = "query_id", item: str = "item_id") -> DataFrame:
    """The k best by reranking score; ties keep the former order. Every row needs a score."""
    joined = ranked.withColumnRenamed("rank", "prior_rank").join(scores.select(query, item, "rerank_score"), [query, item], "left")
    joined = joined.withColumn("rerank_score", F.when(F.col("rerank_score").isNull(), F.raise_error(F.lit("a candidate has no reranking score"))).otherwise(F.col("rerank_score")))
    order = Window.partitionBy(query).orderBy(F.desc("rerank_score"), "prior_rank")
    return joined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def gate_by_score(ranked: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Without reranking: rows of at least ``min_score``."""
    return ranked.where(F.col("score") >= min_score)


def gate_by_rerank(ranked: DataFrame, candidates_: DataFrame, min_score: float, min_rerank: float, *, query: str = "query_id") -> DataFrame:
    """With reranking: all rows of a query or none, by its best cosine over all candidates and its top rerank score."""
    best = candidates_.groupBy(query).agg(F.max("score").alias("_best"))
    own = Window.partitionBy(query)
    return ranked.withColumn("_top", F.max("rerank_score").over(own)).join(best, query).where((F.col("_best") >= min_score) & (F.col("_top") >= min_rerank)).drop("_top", "_best")


def mean_top(scored: DataFrame, k: int, by: list[str], score: str = "score") -> DataFrame:
    """Mean of the k largest scores of each group, or of as many as there are."""
    order = Window.partitionBy(*by).orderBy(F.desc(score))
    return scored.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).groupBy(*by).agg(F.avg(score).alias("mean_top"))


def margins(queries: DataFrame, exemplars: DataFrame, k: int = 3, *, leave_out: bool = False) -> DataFrame:
    """query_id and margin: mean top-k cosine to exemplars of class true less that to class false; an empty class
    counts 0. ``leave_out`` skips an exemplar of the query's own id. Exemplars (item_id, embedding, positive) are a
    small stated list and are broadcast."""
    pairs = queries.select("query_id", F.col("embedding").alias("_q")).join(F.broadcast(exemplars.select("item_id", "embedding", "positive")), F.col("query_id") != F.col("item_id") if leave_out else F.lit(True))
    scored = pairs.select("query_id", "positive", v.cosine_or_zero(F.col("embedding"), F.col("_q")).alias("score"))
    means = mean_top(scored, k, ["query_id", "positive"])
    side = lambda p: F.coalesce(F.max(F.when(F.col("positive") == p, F.col("mean_top"))), F.lit(0.0))
    return means.groupBy("query_id").agg((side(True) - side(False)).alias("margin"))


def tune_margin(scored: DataFrame) -> DataFrame:
    """Threshold of largest Youden J among midpoints of neighbouring margins; the smallest of equals.

    ``scored``: margin, positive, of the exemplars - a list written by hand, so that one task takes its distinct margins.
    Running counts over them replace a threshold-by-row product.
    """
    by = scored.groupBy("margin").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("q"))
    up = Window.orderBy("margin")
    total = scored.agg(F.count_if("positive").alias("tp"), F.count_if(~F.col("positive")).alias("tn"))
    steps = by.withColumn("next", F.lead("margin").over(up)).withColumn("lp", F.sum("p").over(up)).withColumn("lq", F.sum("q").over(up)).where("next is not null")
    j = steps.join(F.broadcast(total)).select(((F.col("margin") + F.col("next")) / 2).alias("threshold"), ((F.col("tp") - F.col("lp")) / F.col("tp") + F.col("lq") / F.col("tn") - 1).alias("j"))
    return j.orderBy(F.desc(F.round("j", 9)), "threshold").limit(1)


def lexical_rank(scored: DataFrame, k: int, *, query: str = "query_id", item: str = "item_id") -> DataFrame:
    """The k best by lexical score, then by cosine, then by id. Columns: query, item, lexical, score."""
    order = Window.partitionBy(query).orderBy(F.desc("lexical"), F.desc("score"), item)
    return scored.select(query, item, "lexical", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Sizes and overlaps of the pieces that are compared beside whole texts, so that passages are met by extents of about their length.
PASSAGES = ((400, 200), (200, 100))
GROUP_CHARS, GROUP_PIECES = 1 << 17, 1000


def trigram_passages(texts: DataFrame, items: DataFrame, least: float, passages: tuple[tuple[int, int], ...] = PASSAGES) -> DataFrame:
    """doc_id, item_id and similarity (the largest of the whole text and its pieces of ``passages``) from ``least`` on. texts: doc_id,
    text; items: item_id, b (distinct trigrams), a question set written by hand. Texts with a character whose lower case isn't one
    fixed character go through Spark's expressions, piece by piece; the others are cut up in arrays, with the same result."""
    rows_ = items.where(F.size("b") > 0).select("item_id", "b").collect()
    if not rows_:
        return texts.select("doc_id", F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("double").alias("similarity")).where("false")
    known = sorted({g for r in rows_ for g in r.b})
    place = {g: k for k, g in enumerate(known)}
    ids, sizes = np.array([r.item_id for r in rows_], dtype=np.int64), np.array([len(r.b) for r in rows_], dtype=np.float64)
    held = np.zeros((len(known), len(rows_)), dtype=np.float32)
    for k, r in enumerate(rows_):
        held[[place[g] for g in r.b], k] = 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                found = [(i, p) for i, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if x is not None for p in dict.fromkeys([x, *(p for size, overlap in passages if len(x) > size for _, p in chunking.pieces(x, size, overlap))])]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([p for _, p in found], pa.string())], ["doc_id", "piece"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(known, pa.string())
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                n = pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
                at = pc.index_in(part.column(1).flatten(), value_set=vocabulary)
                row, here = np.repeat(np.arange(len(n)), n), at.is_valid().to_numpy(zero_copy_only=False)
                has = np.zeros((len(n), len(known)), dtype=np.float32)
                has[row[here], at.drop_null().to_numpy()] = 1
                both = (has @ held).astype(np.float64)
                similarity = both / (n[:, None] + sizes[None] - both)
                x, y = np.nonzero(similarity >= least)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(x)), pa.array(ids[y]), pa.array(similarity[x, y])], ["doc_id", "item_id", "similarity"])

    table = letters(texts.sparkSession)

    def quick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages_ = Passages(table, known, held, sizes, least)
        owners, pieces, chars = [], [], 0

        def done() -> pa.RecordBatch:
            at, item, similarity = passages_.compare(np.array(owners, dtype=np.int64), pieces)
            return pa.RecordBatch.from_arrays([pa.array(at), pa.array(ids[item]), pa.array(similarity)], ["doc_id", "item_id", "similarity"])

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for p in (x, *(x[a:e] for size, overlap in passages if len(x) > size for a, e in chunking.spans(x, size, overlap))):
                    owners.append(i)
                    pieces.append(p)
                    chars += len(p) + 1
                    if chars >= GROUP_CHARS or len(pieces) >= GROUP_PIECES:
                        yield done()
                        owners, pieces, chars = [], [], 0
        if pieces:
            yield done()

    ddl = "doc_id long, item_id long, similarity double"
    uneven = F.col("text").rlike(f"[{UNEVEN}]")
    pieces = texts.where(uneven).select("doc_id", "text").mapInArrow(cut, "doc_id long, piece string").select("doc_id", t.trigrams(F.col("piece")).alias("a"))
    found = pieces.mapInArrow(compare, ddl).unionByName(texts.where(~uneven).select("doc_id", "text").mapInArrow(quick, ddl))
    return found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))
