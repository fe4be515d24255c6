"""Hard negatives of anchors, exactly, with an inverted multi-index.

Every vector is cut into two halves. Two codebooks, one per half, quantise it to a pair of codewords, its
*cell*. The inner product of an anchor with any vector of a cell is at most the sum of two half-score bounds:
half product with the codeword plus half norm times the codeword's radius (the largest distance of a half
to its codeword). A multi-sequence heap visits the cells of an anchor in falling order of that sum and stops
when it lies below everything that is still wanted: then the windows are certified.

The search runs in rounds. A round visits the cells whose vectors follow, in heap order, on those of the last
one, sixteen times as many; what it finds raises the bar of the next. Cells are stored in blocks; a block and the
anchors that visit it meet in one task, where the block is held while the anchors stream by.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cutpoint.llm.texts import quoted
from cutpoint.session import settle

#: Vectors that a cell should hold, most codewords of a half (their square bounds the cells), vectors of a block.
CELL, CODEWORDS, BLOCK = 512, 256, 2048
#: Numbers in the sample from which the codebooks are made (vectors × width).
SAMPLE = 1 << 20
#: Vectors that the first round visits, and by how much later rounds visit more.
FIRST, GROWTH = 4096, 16
#: Cells of a rare label that travel with its anchors; anchors compared with a block at a time.
FEW, AT_ONCE = 256, 256

NONE = np.iinfo(np.int64).min
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _valid(df: DataFrame, key: str, vector: str, label: str, scale: float) -> DataFrame:
    """id, label and q, floor(scale * x) of every component, of the rows that take part."""
    x = F.transform(F.col(quoted(vector)), lambda v: v.cast("double"))
    rows = df.select(F.col(quoted(key)).cast("long").alias("id"), F.col(quoted(label)).cast("long").alias("label"), x.alias("x"))
    rows = rows.where(
        "id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL"
        " AND NOT exists(x, v -> v IS NULL OR isnan(v) OR abs(v) = double('Infinity'))"
    )
    return rows.select("id", "label", F.transform("x", lambda v: F.floor(v * F.lit(float(scale))).cast("long")).alias("q"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows of ``width``; shorter ones end in zeros."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    counts = np.diff(offsets)
    out = np.zeros((len(counts), width), np.int64)
    inside = np.arange(width) < counts[:, None]
    out[inside] = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return out


def _codebook(points: np.ndarray, k: int, turns: int = 8) -> np.ndarray:
    """Codewords by k-means, begun at distinct points."""
    words = np.unique(points, axis=0)
    words = words[np.linspace(0, len(words) - 1, min(k, len(words))).astype(int)].astype(float)
    for _ in range(turns):
        near = _distances(points, words).argmin(axis=1)
        n = np.bincount(near, minlength=len(words))
        sums = np.stack([np.bincount(near, column, len(words)) for column in points.T], axis=1)
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
    return words


def _distances(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    p = points.astype(float)
    squares = (p * p).sum(axis=1)[:, None] + (words * words).sum(axis=1)[None, :] - 2 * (p @ words.T)
    return np.sqrt(np.maximum(squares, 0))


def best_of(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, query))
    query = query[order]
    new = np.ones(len(query), bool)
    new[1:] = query[1:] != query[:-1]
    begun = np.flatnonzero(new)
    place = np.arange(len(query)) - np.repeat(begun, np.diff(np.append(begun, len(query))))
    return order[place < k]


class Cells:
    """What a task needs of the index to order cells: codebooks, radii and counts, bounded by CODEWORDS²."""

    def __init__(self, words: list[np.ndarray], most: int):
        self.words, self.most = words, most
        self.shape = len(words[0]), len(words[1])
        self.count = np.zeros(self.shape, np.int64)
        self.radius = np.zeros((2, *self.shape))

    def walk(self, q: np.ndarray, cells: set | None, least: int, highest: int, begin: int, end: int, out: list) -> bool:
        """Cells of an anchor that follow on ``begin`` vectors in heap order, up to ``end`` of them; whether more follow.

        The order and the counts don't depend on ``least``, so that rounds fit together.
        """
        slack = 1e-6 * (1 + float(self.most))
        cut = self.words[0].shape[1]
        halves = [q[:cut].astype(float), q[cut:].astype(float)]
        norm = [float(np.sqrt(h @ h)) for h in halves]
        near = [w @ h for w, h in zip(self.words, halves)]
        middle = near[0][:, None] + near[1][None, :]
        reach = norm[0] * self.radius[0] + norm[1] * self.radius[1] + slack
        upper, lower = middle + reach, middle - reach
        bound = [near[0] + norm[0] * self.radius[0].max(axis=1), near[1] + norm[1] * self.radius[1].max(axis=0)]
        order = [np.argsort(-b, kind="stable").tolist() for b in bound]
        first, second = (b[o].tolist() for b, o in zip(bound, order))
        heap, passed = [(-(first[0] + second[0]), 0, 0)], 0
        while heap:
            low, a, b = heapq.heappop(heap)
            if -low + slack < least:
                return False
            i, j = order[0][a], order[1][b]
            n, cell = int(self.count[i, j]), i * self.shape[1] + j
            if n and lower[i, j] <= highest and (cells is None or cell in cells):
                if passed >= end:
                    return True
                if passed >= begin and upper[i, j] >= least:
                    out.append(cell)
                passed += n
            if b + 1 < len(second):
                heapq.heappush(heap, (-(first[a] + second[b + 1]), a, b + 1))
            if b == 0 and a + 1 < len(first):
                heapq.heappush(heap, (-(first[a + 1] + second[0]), a + 1, 0))
        return False


class MultiIndex:
    """Codebooks, radii and counts of the cells (bounded by CODEWORDS²), and the blocks of vectors as a table."""

    def __init__(self, vectors: DataFrame):
        """``vectors``: rid, id, label, q, settled."""
        n, width, most, top = vectors.agg(
            F.count("*"),
            F.max(F.size("q")),
            F.max(F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x * x)),
            F.max(F.array_max(F.transform("q", F.abs))),
        ).first()
        self.n, self.width, self.most = n, max(width or 0, 2), most or 0
        self.store = np.dtype(np.int16 if (top or 0) < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)
        if not n:
            return
        sample = vectors.orderBy(F.xxhash64("id", "rid"), "rid").limit(max(64, SAMPLE // self.width)).select("q").toArrow()
        points = _matrix(sample.column(0).combine_chunks(), self.width)
        k = int(np.clip((n / CELL) ** 0.5, 1, CODEWORDS))
        cut = self.width // 2
        self.cells = Cells([_codebook(p, k) for p in (points[:, :cut], points[:, cut:])], self.most)
        self.blocks = self._build(vectors)

    def _build(self, vectors: DataFrame) -> DataFrame:
        cells, width, store = self.cells, self.width, self.store
        words, columns, cut = cells.words, cells.shape[1], cells.words[0].shape[1]

        def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    q = _matrix(batch.column(3), width)
                    away = [_distances(p, w) for p, w in zip((q[:, :cut], q[:, cut:]), words)]
                    near = [d.argmin(axis=1) for d in away]
                    far = [d[np.arange(len(d)), i] for d, i in zip(away, near)]
                    cell = pa.array((near[0] * columns + near[1]).astype(np.int32))
                    packed = pa.array([r.tobytes() for r in q.astype(store)], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns[:3], packed, cell, pa.array(far[0]), pa.array(far[1])],
                        names=["rid", "id", "label", "q", "cell", "far1", "far2"],
                    )

        rows = settle(
            vectors.mapInArrow(located, "rid long, id long, label long, q binary, cell int, far1 double, far2 double")
        )
        self.rows = rows
        for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("far1").alias("a"), F.max("far2").alias("b")).collect():
            at = divmod(r["cell"], columns)
            cells.count[at], cells.radius[0][at], cells.radius[1][at] = r["n"], r["a"], r["b"]
        self.parts = -(-cells.count // BLOCK)

        def packed(group: pa.Table) -> pa.Table:
            group = group.combine_chunks()
            own = [[group[c][0].as_py()] for c in ("cell", "part")]
            held = [b"".join(group["q"].to_pylist()), *(group[c].to_numpy().tobytes() for c in ("id", "label", "rid"))]
            return pa.table([*own, *([h] for h in held)], schema=schema)

        schema = pa.schema([("cell", pa.int32()), ("part", pa.int64()), *((c, pa.binary()) for c in ("a", "b", "c", "d"))])
        # A cell of many vectors is dealt by a hash over as many parts as it fills blocks.
        parts = F.element_at(F.lit(self.parts.ravel().tolist()), F.col("cell") + 1)
        keyed = rows.withColumn("part", F.pmod(F.xxhash64("rid"), parts.cast("long")))
        return settle(
            keyed.groupBy("cell", "part").applyInArrow(packed, "cell int, part long, a binary, b binary, c binary, d binary")
        )

    def label_cells(self) -> DataFrame:
        """Per label the cells that hold it, null for a label of many cells."""
        cells = self.rows.select("label", "cell").distinct().groupBy("label").agg(F.collect_list("cell").alias("cells"))
        return cells.selectExpr("label", f"CASE WHEN size(cells) <= {FEW} THEN cells END AS cells")

    def search(self, asked: DataFrame, slots: int, k: int, *, same: bool) -> DataFrame:
        """(aid, slot, rank, id, score): the k best rows of each window of each anchor.

        ``asked``: aid, label, q (packed), lows, highs (the windows' bounds), cells (those that hold a wanted label,
        or null). Wanted are rows of the anchor's label (``same``) or of others, but the anchor's own.
        """
        spark = asked.sparkSession
        found = spark.createDataFrame([], "aid long, slot int, id long, score long")
        begin, end = 0, FIRST
        while True:
            full = found.groupBy("aid", "slot").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(f"n >= {k}")
            bars = full.groupBy("aid").agg(F.collect_list(F.struct("slot", "least")).alias("bars"))
            state = asked.join(bars.withColumnRenamed("aid", "of"), F.expr("aid = of"), "left").drop("of")
            if begin and not state.mapInArrow(self._visits(slots, begin, end, only_count=True), "n long").agg(F.sum("n")).first()[0]:
                break
            visits = state.mapInArrow(self._visits(slots, begin, end), VISIT)
            blocks = self.blocks.selectExpr("cell", "part", "0 AS kind", "0L AS aid", "0L AS label", "a", "b", "c", "d")
            met = blocks.unionByName(visits).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")
            new = met.mapInArrow(self._scores(slots, k, same), "aid long, slot int, id long, score long")
            ranked = found.unionByName(new).withColumn(
                "rank", F.expr("CAST(row_number() OVER (PARTITION BY aid, slot ORDER BY score DESC, id) AS INT)")
            )
            ranked = settle(ranked.where(f"rank <= {k}"))
            found = ranked.drop("rank")
            begin, end = end, end * GROWTH
        return ranked

    def _visits(self, slots: int, begin: int, end: int, *, only_count: bool = False):
        parts, store, walk = self.parts.ravel(), self.store, self.cells.walk

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: dict[str, list] = {c: [] for c in VISIT_COLUMNS}
                open_anchors = 0
                for row in batch.to_pylist():
                    lows, highs = np.full(slots, -NONE - 1), np.full(slots, NONE)
                    lows[: len(row["lows"])], highs[: len(row["highs"])] = row["lows"], row["highs"]
                    for bar in row["bars"] or ():
                        lows[bar["slot"]] = max(lows[bar["slot"]], bar["least"])
                    cells: list[int] = []
                    some = None if row["cells"] is None else set(row["cells"])
                    q = np.frombuffer(row["q"], store)
                    more = walk(q, some, int(lows.min()), int(highs.max()), begin, end, cells)
                    open_anchors += bool(cells) or more
                    if only_count:
                        continue
                    for cell in cells:
                        n = int(parts[cell])
                        out["cell"] += [cell] * n
                        out["part"] += range(n)
                        for c, v in (("aid", row["aid"]), ("label", row["label"]), ("a", row["q"])):
                            out[c] += [v] * n
                        out["b"] += [lows.tobytes()] * n
                        out["c"] += [highs.tobytes()] * n
                if only_count:
                    yield pa.RecordBatch.from_pydict({"n": pa.array([open_anchors], pa.int64())})
                elif out["cell"]:
                    n = len(out["cell"])
                    out["kind"], out["d"] = [1] * n, [None] * n
                    yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in VISIT_COLUMNS.items()], names=list(VISIT_COLUMNS))

        return run

    def _scores(self, slots: int, k: int, same: bool):
        width, store = self.width, self.store
        number = np.float32 if self.most < 1 << 24 else np.float64 if self.most < 1 << 53 else object

        def compared(block: list, part: pa.RecordBatch) -> pa.RecordBatch:
            vectors, ids, labels, rids = block
            aid, label = part.column(3).to_numpy(), part.column(4).to_numpy()
            q = np.frombuffer(b"".join(part.column(5).to_pylist()), store).reshape(-1, width).astype(number)
            low, high = (
                np.frombuffer(b"".join(part.column(c).to_pylist()), np.int64).reshape(-1, slots) for c in (6, 7)
            )
            score = (q @ vectors.T).astype(np.int64)
            wanted = (label[:, None] == labels[None, :]) == same
            wanted &= aid[:, None] != rids[None, :]
            found = []
            for s in range(slots):
                a, v = np.nonzero(wanted & (score >= low[:, s, None]) & (score <= high[:, s, None]))
                best = best_of(a, score[a, v], ids[v], k)
                a, v = a[best], v[best]
                found.append((aid[a], np.full(len(a), s, np.int32), ids[v], score[a, v]))
            columns = [np.concatenate(c) for c in zip(*found)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["aid", "slot", "id", "score"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, block = None, None
            for batch in batches:
                cell, part, kind = (batch.column(i).to_numpy() for i in range(3))
                new = np.ones(len(cell), bool)
                new[1:] = (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])
                edges = [*np.flatnonzero(new).tolist(), len(cell)]
                for begin, end in zip(edges[:-1], edges[1:]):
                    key = int(cell[begin]), int(part[begin])
                    if kind[begin] == 0:
                        held = [batch.column(c)[begin].as_py() for c in (5, 6, 7, 8)]
                        vectors = np.frombuffer(held[0], store).reshape(-1, width).astype(number)
                        at, block = key, [vectors, *(np.frombuffer(h, np.int64) for h in held[1:])]
                    elif key == at:
                        for i in range(begin, end, AT_ONCE):
                            yield compared(block, batch.slice(i, min(AT_ONCE, end - i)))

        return run


VISIT_COLUMNS = {
    "cell": pa.int32(),
    "part": pa.int64(),
    "kind": pa.int32(),
    "aid": pa.int64(),
    "label": pa.int64(),
    "a": pa.binary(),
    "b": pa.binary(),
    "c": pa.binary(),
    "d": pa.binary(),
}
VISIT = "cell int, part long, kind int, aid long, label long, a binary, b binary, c binary, d binary"


def hard_negatives(
    df: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: float = 256.0,
    every: int = 100,
    positives: int = 5,
    negatives: int = 5,
    at_least: int = 80,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose key ``every`` divides. Scores are inner products of floor(scale * x); higher ones
    come first, ties by smaller key. An anchor's positives are its first rows of the same label; the negatives of
    each are the first rows of another label that score at most as high and at least ``at_least`` per cent of it
    (none where the positive scores below 0). Labels and keys are whole numbers.

    Rows with a null key, label or vector, or a null or non-finite component, take no part. Rows that repeat a key
    are rows of their own: each is an anchor, and each can be another's positive. Vectors of different lengths are
    compared as if zeros followed; empty ones score 0. An empty table gives no rows. Other columns are ignored.
    Squared norms must fit a long, else Spark raises.
    """
    spark = df.sparkSession
    vectors = settle(_valid(df, key, vector, label, scale).select(F.monotonically_increasing_id().alias("rid"), "*"))
    index = MultiIndex(vectors)
    if not index.n:
        return spark.createDataFrame([], SCHEMA)
    everything = f"array({NONE + 1}L) AS lows", f"array({-NONE - 1}L) AS highs"
    anchors = settle(index.rows.where(f"id % {every} = 0").repartition("rid").selectExpr("rid AS aid", "id AS anchor_id", "label", "q"))
    asked = anchors.join(index.label_cells().withColumnRenamed("label", "of"), F.expr("label = of"))
    first = index.search(asked.selectExpr("aid", "label", "q", *everything, "cells"), 1, positives, same=True)
    first = first.selectExpr("aid", "rank - 1 AS slot", "id AS positive_id", "score AS positive_score").where("positive_score >= 0")
    windows = first.groupBy("aid").agg(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))).alias("w"))
    windows = windows.selectExpr(
        "aid AS of",
        f"transform(w, x -> {at_least} * (x.positive_score DIV 100) + ({at_least} * (x.positive_score % 100) + 99) DIV 100) AS lows",
        "transform(w, x -> x.positive_score) AS highs",
    )
    asked = settle(
        anchors.join(windows, F.expr("aid = of")).selectExpr("aid", "label", "q", "lows", "highs", "CAST(NULL AS ARRAY<INT>) AS cells")
    )
    second = index.search(asked, positives, negatives, same=False)
    return (
        second.join(first, ["aid", "slot"])
        .join(anchors.select("aid", "anchor_id"), "aid")
        .selectExpr("anchor_id", "positive_id", "rank", "id AS negative_id", "positive_score", "score AS negative_score")
    )
