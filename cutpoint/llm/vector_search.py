"""Exact top-k by inner product with a pivot-distance index.

Vectors are whole numbers. With one more coordinate, which lifts all of them to the same norm, the largest
inner products are the nearest neighbours. The index keys every vector by its nearest pivot and its
distance to it; range-partitioned and sorted by that key, the vectors form blocks that are thin annuli
around pivots. A query first searches the block it lies in, which bounds its k-th best score. It then
meets the annuli from the nearest outwards and stops at the first whose triangle-inequality bound is worse
than its k-th score. The pivots come from a bounded number of vectors; every vector is in the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cutpoint.llm.texts import quoted
from cutpoint.session import settle

PIVOTS = 64
#: Vectors of an index block, and queries that travel together.
BLOCK = 2048
QUERIES = 512
#: Vectors that one task holds while queries pass by.
HELD = 200_000

INDEX = "block long, pivot int, low double, high double, ids binary, vectors binary"


def whole_vectors(df: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """vec_id and floor(scale * x) of every component; vectors with a null or non-finite component drop out."""
    x = F.transform(F.col(quoted(vector)), lambda v: v.cast("double"))
    rows = df.select(F.col(quoted(key)).cast("long").alias("vec_id"), x.alias("x")).where(
        "vec_id IS NOT NULL AND x IS NOT NULL AND NOT exists(x, v -> v IS NULL OR isnan(v) OR abs(v) = double('Infinity'))"
    )
    return rows.select("vec_id", F.transform("x", lambda v: F.floor(v * F.lit(float(scale))).cast("long")).alias("q"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of ``width``; shorter vectors end in zeros."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)
    counts = np.diff(offsets)
    out = np.zeros((len(counts), width), np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], counts)
    out[row, place] = flat[offsets[0] : offsets[-1]]
    return out


def _norms(vectors: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", vectors, vectors)


def _lifted_distance(vectors: np.ndarray, points: np.ndarray, most: int, *, queries: bool = False) -> np.ndarray:
    """Distances of vectors to points after the lift (queries stay at height 0)."""
    own, theirs = _norms(vectors).astype(float), _norms(points).astype(float)
    height = np.zeros(len(vectors)) if queries else np.sqrt(np.maximum(most - own, 0))
    flat = own[:, None] + theirs[None, :] - 2.0 * (vectors.astype(float) @ points.T.astype(float))
    lift = height[:, None] - np.sqrt(np.maximum(most - theirs, 0))[None, :]
    return np.sqrt(np.maximum(flat + lift * lift, 0))


def _best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, query))
    query = query[order]
    begun = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, int)
    place = np.arange(len(query)) - np.repeat(begun, np.diff(np.append(begun, len(query))))
    return order[place < k]


def build_index(vectors: DataFrame, width: int, most: int, points: np.ndarray, n: int) -> DataFrame:
    """Blocks of at most BLOCK vectors of one pivot, sorted by distance."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                distance = _lifted_distance(_matrix(batch.column(1), width), points, most)
                near = distance.argmin(axis=1)
                far = distance[np.arange(len(near)), near]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(near.astype(np.int32)), pa.array(far)], names=["vec_id", "q", "pivot", "distance"]
                )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, pivots, far = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, float))
        rows = rows.reshape(0, width)

        def emit(end: int) -> pa.RecordBatch:
            values = [0], [int(pivots[0])], [float(far[0])], [float(far[end - 1])], [ids[:end].tobytes()], [rows[:end].tobytes()]
            kinds = pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary()
            names = ["block", "pivot", "low", "high", "ids", "vectors"]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], names=names)

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal ids, rows, pivots, far
            while len(ids):
                same = int(np.searchsorted(pivots, pivots[0], "right"))
                end = min(BLOCK, same)
                if end == len(ids) and end < BLOCK and not last:
                    return
                yield emit(end)
                ids, rows, pivots, far = ids[end:], rows[end:], pivots[end:], far[end:]

        for batch in batches:
            ids = np.concatenate((ids, batch.column(0).to_numpy()))
            rows = np.concatenate((rows, _matrix(batch.column(1), width)))
            pivots = np.concatenate((pivots, batch.column(2).to_numpy().astype(np.int64)))
            far = np.concatenate((far, batch.column(3).to_numpy()))
            yield from cut(False)
        yield from cut(True)

    located = vectors.mapInArrow(keyed, "vec_id long, q array<bigint>, pivot int, distance double")
    order = ("pivot", "distance", "vec_id")
    blocks = located.repartitionByRange(max(1, -(-n // (4 * BLOCK))), *order).sortWithinPartitions(*order).mapInArrow(packed, INDEX)
    return settle(blocks.withColumn("block", F.monotonically_increasing_id()))


def top_k(
    df: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: float = 64.0,
    every: int = 20,
    k: int = 20,
    pivots: int = PIVOTS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products with every row whose key ``every`` divides.

    A row isn't a candidate of its own; rows that repeat a key are (of each other). Ties go to the smaller
    key. Vectors of different lengths are compared as if zeros followed; empty ones score 0. Rows with a
    null key take no part. An empty table gives no rows. Squared norms must fit a long, else Spark raises.
    """
    spark = df.sparkSession
    vectors = settle(whole_vectors(df, key, vector, scale))
    n, width, most = vectors.agg(
        F.count("*"), F.max(F.size("q")), F.max(F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x * x))
    ).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], schema)
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("q").collect()
    width = max(width, 1)
    points = np.array([list(r["q"]) + [0] * (width - len(r["q"])) for r in chosen], np.int64)
    number = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object
    index = build_index(vectors, width, most, points, n)
    groups = max(spark.sparkContext.defaultParallelism, -(-n // HELD))

    def unpack(ids: bytes, rows: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64).reshape(-1, width)

    def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(number) @ b.T.astype(number)).astype(np.int64)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries in blocks, each with the k-th best score found in the block it lies in."""
        for batch in batches:
            for block, ids, rows in zip(*(batch.column(c).to_pylist() for c in ("block", "ids", "vectors"))):
                keys, values = unpack(ids, rows)
                at = np.flatnonzero(keys % every == 0)
                for begin in range(0, len(at), QUERIES):
                    own = at[begin : begin + QUERIES]
                    scores = product(values[own], values)
                    scores[np.arange(len(own)), own] = np.iinfo(np.int64).min
                    enough = len(keys) > k
                    bound = np.partition(scores, -k, axis=1)[:, -k] if enough else np.full(len(own), np.iinfo(np.int64).min)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "block": [block],
                            "first": [begin],
                            "places": [own.astype(np.int64).tobytes()],
                            "ids": [keys[own].tobytes()],
                            "vectors": [values[own].tobytes()],
                            "bounds": [bound.tobytes()],
                        }
                    )

    queries = settle(
        index.mapInArrow(asked, "block long, first long, places binary, ids binary, vectors binary, bounds binary")
    )
    columns = ["turn", "kind", "block", "first", "pivot", "low", "high", "places", "ids", "vectors", "bounds"]
    held = index.selectExpr(
        f"pmod(block, {groups}) AS turn", "0 AS kind", "block", "0L AS first", "pivot", "low", "high",
        "CAST(NULL AS BINARY) AS places", "ids", "vectors", "CAST(NULL AS BINARY) AS bounds",
    )
    passing = queries.selectExpr(
        f"explode(sequence(0L, {groups - 1}L)) AS turn", "1 AS kind", "block", "first", "0 AS pivot", "0D AS low",
        "0D AS high", "places", "ids", "vectors", "bounds",
    )
    met = held.unionByName(passing.select(*columns)).repartition(groups, "turn")
    met = met.sortWithinPartitions("turn", "kind", "block", "first")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, blocks = None, []
        for batch in batches:
            for row in (dict(zip(batch.schema.names, v)) for v in zip(*(c.to_pylist() for c in batch.columns))):
                if row["turn"] != turn:
                    turn, blocks = row["turn"], []
                if row["kind"] == 0:
                    blocks.append((row["block"], row["pivot"], row["low"], row["high"], *unpack(row["ids"], row["vectors"])))
                elif blocks:
                    yield _search(row, blocks)

    def _search(row: dict, blocks: list) -> pa.RecordBatch:
        ids, values = unpack(row["ids"], row["vectors"])
        places = np.frombuffer(row["places"], np.int64)
        bound = np.frombuffer(row["bounds"], np.int64).copy()
        to_pivot = _lifted_distance(values, points, most, queries=True)
        at, low, high = (np.array([b[i] for b in blocks]) for i in (1, 2, 3))
        distance = to_pivot[:, at]
        gap = np.maximum(np.maximum(low - distance, distance - high), 0)
        # Nearer than this no vector of the annulus can be, so no score is above that.
        reach = (_norms(values)[:, None] + float(most) - gap * gap) / 2 + 1e-6 * (1 + float(most))
        found = [np.zeros(0, np.int64) for _ in range(3)]
        for b in np.argsort(gap.min(axis=0), kind="stable"):
            open_queries = np.flatnonzero(reach[:, b] >= bound)
            if not len(open_queries):
                continue
            block, _, _, _, keys, vectors_of = blocks[b]
            scores = product(values[open_queries], vectors_of)
            near = scores >= bound[open_queries, None]
            if block == row["block"]:
                near[np.arange(len(open_queries)), places[open_queries]] = False
            q, v = np.nonzero(near)
            found = [np.concatenate(p) for p in zip(found, (open_queries[q], scores[q, v], keys[v]))]
            best = _best(*found, k)
            found = [f[best] for f in found]
            full = np.bincount(found[0], minlength=len(ids)) >= k
            last = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(last, found[0], found[1])
            bound = np.where(full, np.maximum(bound, last), bound)
        query, score, vec = found
        # Repeated rows of a key are different queries: told apart by block and place.
        number_of = row["first"] + np.arange(len(ids))
        return pa.RecordBatch.from_pydict(
            {
                "block": np.full(len(query), row["block"]),
                "place": number_of[query],
                "query_id": ids[query],
                "vec_id": vec,
                "score": score,
            }
        )

    partial = met.mapInArrow(searched, "block long, place long, query_id long, vec_id long, score long")
    ranked = partial.selectExpr(
        "query_id", "CAST(row_number() OVER (PARTITION BY block, place ORDER BY score DESC, vec_id) AS INT) AS rank", "vec_id", "score"
    )
    return ranked.where(f"rank <= {k}")
