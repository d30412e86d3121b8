"""Vector arithmetic: JVM expressions for score columns, Arrow kernels for ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the guard added to the product of the norms.
COSINE_GUARD = 1e-8
# Scores are rounded before they are compared, so that equal vectors tie whatever the summation order.
SCORE_DIGITS = 9
_SCORES_AT_ONCE = 2_000_000


def parse_embedding(column: Column | str, is_text: bool = True) -> Column:
    """``"[0.1, 0.2]"`` or an array of any number type, as ``array<double>``; other text gives null."""
    column = F.col(column) if isinstance(column, str) else column
    if is_text:
        body = F.regexp_replace(column, r"^\s*\[|\]\s*$", "")
        parts = F.transform(F.split(body, ","), lambda x: F.trim(x).try_cast("double"))
        return F.when(~F.exists(parts, lambda x: x.isNull()), parts)
    return column.cast("array<double>")


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _fold(column: Column) -> Column:
    return F.aggregate(column, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(COSINE_GUARD))


def squared_l2(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))


def as_matrix(column: pa.ChunkedArray | pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as a float64 matrix, and the mask of rows that have a vector; other sizes are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    usable = lengths == width
    wrong = lengths[(lengths >= 0) & ~usable]
    if len(wrong):
        raise ValueError(f"vectors of size {wrong[0]} among those of size {width}")
    kept = column if usable.all() else column.filter(pa.array(usable))
    flat = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, width), usable


def score_block(matrix: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Scores, larger is nearer, of every matrix row (axis 0) against every query (axis 1)."""
    product = matrix @ queries.T
    if metric == "cosine":
        norms = np.linalg.norm(matrix, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None, :]
        scores = product / (norms + COSINE_GUARD)
    elif metric == "l2":
        squares = (matrix * matrix).sum(axis=1)[:, None] + (queries * queries).sum(axis=1)[None, :]
        scores = -np.maximum(squares - 2.0 * product, 0.0)
    else:
        raise ValueError(f"unknown metric: {metric}")
    return np.round(scores, SCORE_DIGITS)


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best scores; ties go to the smaller id, NaN never ranks."""
    pool = np.flatnonzero(~np.isnan(scores))
    if len(pool) > 8 * k:
        # Cut by value first, then settle ties at the cut.
        values = scores[pool]
        pool = pool[values >= np.partition(values, len(pool) - k)[len(pool) - k]]
    return pool[np.lexsort((ids[pool], -scores[pool]))[:k]]


def read_queries(files: Sequence[str], width: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and vectors of stored queries, read by a task from any file system that Arrow knows."""
    tables = []
    for file in files:
        system, path = pa.fs.FileSystem.from_uri(file)
        tables.append(pq.read_table(path, filesystem=system))
    found = pa.concat_tables(tables)
    return found.column("query_id").combine_chunks(), as_matrix(found.column("vector"), width)[0]


def ranking_task(id_column: str, vector_column: str, load: Callable[[], tuple[pa.Array, np.ndarray]], k: int, metric: str):
    """A ``mapInArrow`` function: per query keep the ``k`` best rows of the whole task.

    ``load`` gives the ids and vectors of the queries. Emits ``query_id, id, score``. Only k rows per query are held between batches
    and leave the task, however many rows it reads.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = load()
        scores_held: list[np.ndarray] = [np.empty(0) for _ in range(len(queries))]
        ids_held: list[np.ndarray] = []
        id_type = None
        for batch in batches:
            names = batch.schema.names
            matrix, usable = as_matrix(batch.column(names.index(vector_column)), queries.shape[1])
            id_array = batch.column(names.index(id_column)).filter(pa.array(usable))
            ids = id_array.to_numpy(zero_copy_only=False)
            if id_type is None:
                id_type = id_array.type
                ids_held = [ids[:0] for _ in range(len(queries))]
            step = max(1, _SCORES_AT_ONCE // max(1, len(matrix)))
            for start in range(0, len(queries), step):
                scores = score_block(matrix, queries[start : start + step], metric)
                for j in range(start, start + scores.shape[1]):
                    all_scores = np.concatenate([scores_held[j], scores[:, j - start]])
                    all_ids = np.concatenate([ids_held[j], ids])
                    best = best_rows(all_scores, all_ids, k)
                    scores_held[j], ids_held[j] = all_scores[best], all_ids[best]
        if id_type is None:
            return
        sizes = [len(s) for s in scores_held]
        yield pa.RecordBatch.from_arrays(
            [
                query_ids.take(pa.array(np.repeat(np.arange(len(sizes)), sizes))),
                pa.array(np.concatenate(ids_held), type=id_type),
                pa.array(np.concatenate(scores_held)),
            ],
            names=["query_id", "id", "score"],
        )

    return run
