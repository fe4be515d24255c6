"""Exact Jaccard join of word n-gram sets over R-trees of count vectors.

The n-grams (shingles) of a text are hashed into groups; how many fall into each is a point with one
coordinate per group. Two sets can't share more than the sum of the smaller coordinates of their points, nor
more than that sum for the upper corners of two boxes around them. That bound prunes pages, then boxes of a page,
then points; what survives is compared exactly.

The root of the tree is cut by finer groups, one per shingle: a text enters the subtrees of its rarest shingles, as
many as it can't do without if it is to share what a link needs. A partner then is in one of the same subtrees. How
rare a shingle is, a bounded sample of texts tells; it orders the shingles and decides nothing else.

In a subtree, points are first compared with one of them, so that groups of copies become one class and aren't
expanded into pairs. Subtrees that then hold more than one class are packed into pages and joined page by page.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cutpoint.llm.components import components
from cutpoint.llm.shingle_sets import WordHashes, scrambled, shingle_sets
from cutpoint.llm.texts import quoted, whole
from cutpoint.session import settle

#: Coordinates of a point.
GROUPS = 64
#: About how many texts tell which shingles are common, and how many of those are remembered.
SAMPLE, COMMON = 4096, 1 << 16
#: Points and shingles of a page, and points of a box.
PAGE, PAGE_SHINGLES, BOX = 1024, 1 << 20, 32
#: Survivors per point of a page pair from which its sets are compared where they lie.
DENSE = 8
#: Bits of the filter that tells which sets are needed.
BITS = 1 << 23
#: Shingles compared at a time.
COLUMNS = 4096


class Limit:
    """A link needs ``percent`` of the union to be shared."""

    def __init__(self, percent: int):
        self.percent = percent

    def sizes(self, n: str, m: str) -> str:
        return f"100 * least({n}, {m}) >= {self.percent} * greatest({n}, {m})"

    def reached(self, shared, total):
        """Whether sets of ``total`` shingles in all may be linked if they share ``shared``."""
        return (100 + self.percent) * shared >= self.percent * total

    def entries(self, n):
        """How many of the rarest of ``n`` shingles a partner can't all miss."""
        return n - -(-self.percent * n // 100) + 1

    def short_entries(self, n: str) -> str:
        """The same for a partner that isn't smaller."""
        return f"{n} - (2 * {self.percent} * {n} + {99 + self.percent}) DIV {100 + self.percent} + 1"


def packed_points(text: np.ndarray, shingle: np.ndarray, n: np.ndarray) -> pa.Array:
    """Counts by group of each text, GROUPS times a power of two of them, one for every four shingles at least.

    A shingle's group is its number modulo the number of groups, so points fold to fewer.
    """
    number = scrambled(shingle ^ np.uint64(0x5851F42D4C957F2D))
    doublings = np.ceil(np.log2(np.maximum(n / (4 * GROUPS), 1))).astype(np.int64)
    groups = GROUPS << doublings
    first = np.cumsum(groups) - groups
    place = first[text] + (number % groups[text].astype(np.uint64)).astype(np.int64)
    counts = np.bincount(place, minlength=int(groups.sum()))
    assert counts.max(initial=0) < 1 << 16, "the hash of shingles isn't even"
    offsets = (np.concatenate((first, [groups.sum()])) * 2).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(counts.astype(np.uint16))])


def folded(points: list[bytes]) -> np.ndarray:
    """Points folded to GROUPS coordinates."""
    out = np.zeros((len(points), GROUPS), np.int32)
    size = np.array([len(p) for p in points], np.int64)
    for each in np.unique(size):
        at = np.flatnonzero(size == each)
        held = np.frombuffer(b"".join([points[i] for i in at]), np.uint16)
        out[at] = held.reshape(len(at), -1, GROUPS).sum(axis=1)
    return out


def may_share(p: bytes, q: bytes) -> int:
    """The sum of the smaller coordinates of two points, folded alike."""
    a, b = np.frombuffer(p, np.uint16), np.frombuffer(q, np.uint16)
    least = min(len(a), len(b))
    if len(a) != len(b):
        a, b = (c.reshape(-1, least).sum(axis=0, dtype=np.int64) for c in (a, b))
    return int(np.minimum(a, b).sum(dtype=np.int64))


def _sets(batches: Iterator[pa.RecordBatch], column: int, words: int, made) -> Iterator[pa.RecordBatch]:
    """``made(batch slice, text, shingle)`` over runs of texts."""
    hashed = WordHashes()
    for batch in batches:
        for begin, end, hashes, counts in hashed.runs(batch.column(column)):
            text, shingle = shingle_sets(hashes, counts, words)
            yield made(batch.slice(begin, end - begin), text, shingle)


def common_shingles(df: DataFrame, text: str, words: int) -> np.ndarray:
    """Shingles of three or more texts of the sample, the most common last, at most COMMON."""
    body = df.select(whole(quoted(text)).alias("text"))
    nth = max(1, body.count() // SAMPLE)
    sample = body.where(f"pmod(xxhash64(text), {nth}) = 0").distinct()

    def made(part: pa.RecordBatch, text: np.ndarray, shingle: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64))], names=["g"])

    held = sample.mapInArrow(lambda batches: _sets(batches, 0, words, made), "g long")
    most = held.groupBy("g").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "g").limit(COMMON)
    return most.orderBy("n", "g").select("g").toArrow().column(0).to_numpy().view(np.uint64)


def described(df: DataFrame, words: int, limit: Limit, common: np.ndarray) -> DataFrame:
    """``df`` (last column: text) with n (shingles), da, db (digest of the set), point and entries (the rarest)."""
    order = np.argsort(common)
    known, rank_of = common[order], order + 1
    odd = np.uint64(0x2545F4914F6CDD1D)

    def made(part: pa.RecordBatch, text: np.ndarray, shingle: np.ndarray) -> pa.RecordBatch:
        n_texts = part.num_rows
        n = np.bincount(text, minlength=n_texts)
        digest = np.zeros((2, n_texts), np.uint64)
        for i, mix in enumerate((scrambled(shingle + odd), scrambled(shingle * odd))):
            np.add.at(digest[i], text, mix)
        at = np.minimum(np.searchsorted(known, shingle), max(len(known) - 1, 0))
        rank = np.where(known[at] == shingle, rank_of[at], 0) if len(known) else np.zeros(len(shingle), np.int64)
        place = np.lexsort((shingle, rank, text))
        within = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        first = within < np.repeat(limit.entries(n), n)
        rare = shingle[place][first].view(np.int64)
        lists = np.concatenate(([0], np.cumsum(np.bincount(text[first], minlength=n_texts)))).astype(np.int32)
        packed = packed_points(text, shingle, n)
        new = [pa.array(n), *(pa.array(d.view(np.int64)) for d in digest), packed, pa.ListArray.from_arrays(pa.array(lists), pa.array(rare))]
        names = [*part.schema.names, "n", "da", "db", "point", "entries"]
        return pa.RecordBatch.from_arrays([*part.columns, *new], names=names)

    schema = ", ".join(f"{quoted(c)} {t}" for c, t in df.dtypes) + ", n long, da long, db long, point binary, entries array<bigint>"
    last = len(df.columns) - 1
    return df.mapInArrow(lambda batches: _sets(batches, last, words, made), schema)


def fitting(limit: Limit, p: list[bytes], q: list[bytes], folded_p: np.ndarray, folded_q: np.ndarray) -> np.ndarray:
    """Which pairs of points may be linked: by few coordinates first, then by all."""
    total = folded_p.sum(axis=1, dtype=np.int64) + folded_q.sum(axis=1, dtype=np.int64)
    keep = limit.reached(np.minimum(folded_p, folded_q).sum(axis=1, dtype=np.int64), total)
    for i in np.flatnonzero(keep):
        keep[i] = limit.reached(may_share(p[i], q[i]), total[i])
    return keep


class Join:
    """The join of the sets of ``base`` (rid, text, n, da, db, point, entries, settled)."""

    def __init__(self, base: DataFrame, words: int, limit: Limit):
        self.base, self.words, self.limit = base, words, limit

    def links(self, texts: DataFrame) -> DataFrame:
        """(a, b): links that hold the classes together, among the sets named by ``tid``."""
        limit = self.limit
        entered = self.base.join(texts.select("tid"), F.expr("rid = tid"))
        # ``short`` are the entries that suffice if the partner is larger. A text stays in a subtree if it has a partner
        # of fitting size there: a larger one for its own short entry, or a smaller one with a short entry.
        entered = entered.selectExpr("tid", "n", f"{limit.short_entries('n')} AS short", "posexplode(entries) AS (place, g)")
        entered = entered.selectExpr("tid", "n", "place < short AS short", "g")
        in_order = "OVER (PARTITION BY g ORDER BY n, short DESC"
        entered = entered.selectExpr(
            "tid", "n", "short", "g", f"lead(n) {in_order}) AS larger",
            f"max(CASE WHEN short THEN n END) {in_order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS smaller",
        ).where(f"(short AND 100 * n >= {limit.percent} * larger) OR 100 * smaller >= {limit.percent} * n")
        ratio = max(100 / limit.percent, 1.05)
        # Subtrees of the same texts are one: they go by a hash of their members.
        entered = entered.selectExpr("tid", "n", "bit_xor(xxhash64(tid)) OVER (PARTITION BY g) AS g").distinct()
        shared = settle(
            entered.selectExpr("g", "tid", "n", f"CAST(floor(ln(n) / ln({ratio!r}D)) AS INT) AS size", "tid AS label")
        )
        near = None
        # One point of each subtree (and size) meets the others: the same one wherever it is first, then others.
        for order in ("xxhash64(tid)", "xxhash64(tid, g)"):
            pivots = shared.groupBy("g", "size").agg(F.min(F.expr(f"struct({order} AS o, tid, n, label)")).alias("p"))
            pivots = pivots.selectExpr("g AS pg", "size AS ps", "p.tid AS b", "p.n AS m", "p.label AS other")
            pairs = shared.join(pivots, F.expr("g = pg AND size = ps")).where(f"label <> other AND {limit.sizes('n', 'm')}")
            found = settle(self.checked(pairs.selectExpr("least(tid, b) AS a", "greatest(tid, b) AS b")))
            near = found if near is None else near.unionByName(found)
            shared = self.still_open(shared, components(near))
        more = self.paged(shared)
        return near.unionByName(more)

    def still_open(self, shared: DataFrame, labels: DataFrame) -> DataFrame:
        """The subtrees that hold several classes, settled."""
        now = settle(
            shared.drop("label").join(labels.withColumnRenamed("node", "tid"), "tid", "left").withColumn("label", F.coalesce("label", "tid"))
        )
        several = now.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
        return settle(now.join(several.select("g"), "g", "left_semi"))

    def checked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are linked: first by their points, then exactly."""
        limit = self.limit

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p, q = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                keep = fitting(limit, p, q, folded(p), folded(q))
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])

        at = self.base.select("rid", "point")
        left, right = at.toDF("x", "p"), at.toDF("y", "q")
        met = pairs.select("a", "b").distinct().join(left, F.expr("a = x")).join(right, F.expr("b = y")).select("a", "b", "p", "q")
        return self.exact(settle(met.mapInArrow(near, "a long, b long")))

    def exact(self, pairs: DataFrame) -> DataFrame:
        limit = self.limit

        def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.zeros(batch.num_rows, bool)
                for i, (p, q) in enumerate(zip(batch.column(2), batch.column(3))):
                    p, q = (np.frombuffer(s.as_py(), np.uint64) for s in (p, q))
                    at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                    keep[i] = limit.reached(int((q[at] == p).sum()), len(p) + len(q))
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])

        sets = self.sets(pairs.selectExpr("explode(array(a, b)) AS tid"))
        left, right = sets.toDF("x", "p"), sets.toDF("y", "q")
        met = pairs.join(left, F.expr("a = x")).join(right, F.expr("b = y")).select("a", "b", "p", "q")
        return met.mapInArrow(linked, "a long, b long")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(tid, shingles packed in order) of the ``tid`` wanted, and of a few more that a bounded filter lets by."""
        bits = wanted.selectExpr(f"pmod(xxhash64(tid), {BITS}) AS bit").groupBy(F.expr("bit DIV 64 AS word"))
        bits = bits.agg(F.expr("bit_or(shiftleft(1L, CAST(bit % 64 AS INT))) AS bits")).toArrow()
        table = np.zeros(BITS // 64, np.int64)
        table[bits.column(0).to_numpy()] = bits.column(1).to_numpy()
        words = self.words

        def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bit = batch.column(1).to_numpy()
                kept = (table[bit // 64].view(np.uint64) >> (bit % 64).astype(np.uint64)) & np.uint64(1)
                yield batch.filter(pa.array(kept.astype(bool)))

        def made(part: pa.RecordBatch, text: np.ndarray, shingle: np.ndarray) -> pa.RecordBatch:
            cuts = np.searchsorted(text, np.arange(part.num_rows + 1))
            packed = pa.array([shingle[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
            return pa.RecordBatch.from_arrays([part.column(0), packed], names=["tid", "shingles"])

        rows = self.base.selectExpr("rid AS tid", f"pmod(xxhash64(rid), {BITS}) AS bit", "text")
        return rows.mapInArrow(lambda batches: _sets(needed(batches), 2, words, made), "tid long, shingles binary")

    def paged(self, shared: DataFrame) -> DataFrame:
        """Links between different classes of the open subtrees (g, tid, n, size, label), page by page."""
        limit = self.limit
        in_order = "OVER (PARTITION BY g ORDER BY size, tid"
        placed = shared.selectExpr(
            "g", "tid", "label", "n", f"row_number() {in_order}) AS r",
            f"sum(n) {in_order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far",
        )
        placed = settle(
            placed.selectExpr("g", "tid", "label", "n", f"(r - 1) DIV {PAGE} + (so_far - n) DIV {PAGE_SHINGLES} AS page")
        )
        filled = placed.join(self.base.selectExpr("rid", "point"), F.expr("rid = tid")).select("g", "page", "tid", "label", "n", "point")
        one = filled.repartition("g", "page").sortWithinPartitions("g", "page").mapInArrow(_in_pages(limit), PAIRS)
        several = placed.where("page > 0").select("g").distinct()
        pages = settle(filled.join(several, "g", "left_semi").groupBy("g", "page").applyInArrow(_page, PAGE_COLUMNS))
        names = pages.columns
        left, right = (pages.toDF(*(f"{s}_{c}" for c in names)) for s in "ab")
        corner = "aggregate(zip_with(a_corner, b_corner, (x, y) -> CAST(least(x, y) AS BIGINT)), 0L, (s, x) -> s + x)"
        p = limit.percent
        met = left.join(
            right,
            F.expr(
                f"a_g = b_g AND a_page < b_page AND 100 * a_most >= {p} * b_least AND 100 * b_most >= {p} * a_least"
                " AND NOT (a_lo = a_hi AND b_lo = b_hi AND a_lo = b_lo)"
                f" AND {100 + p} * {corner} >= {p} * (a_least + b_least)"
            ),
        )
        found = settle(one.unionByName(met.mapInArrow(_page_pairs(limit), PAIRS)))
        sparse = self.exact(found.where("a IS NOT NULL").select("a", "b").distinct())
        crowded = found.where("a IS NULL")
        if not crowded.take(1):
            return settle(sparse)
        each = crowded.selectExpr("g AS og", "pa", "pb", "explode(array_distinct(array(pa, pb))) AS side")
        each = each.join(placed, F.expr("og = g AND side = page")).select("g", "pa", "pb", "page", "tid", "label")
        sets = self.sets(each.select("tid")).toDF("x", "shingles")
        held = each.join(sets, F.expr("tid = x")).select("g", "pa", "pb", "page", "tid", "label", "shingles")
        return settle(sparse.unionByName(held.groupBy("g", "pa", "pb").applyInArrow(_crowd(limit), "a long, b long")))


PAGE_COLUMNS = (
    "g long, page long, least long, most long, lo long, hi long, corner array<int>, tids binary, labels binary, points array<binary>"
)
PAIRS = "g long, pa long, pb long, a long, b long"


def packed_order(points: np.ndarray, box: int) -> np.ndarray:
    """Order in which every ``box`` points lie close: halves by the coordinate that varies most, again and again."""
    out, open_parts = [], [np.arange(len(points))]
    while open_parts:
        part = open_parts.pop()
        if len(part) <= box:
            out.append(part)
            continue
        widest = points[part].var(axis=0).argmax()
        part = part[np.argsort(points[part, widest], kind="stable")]
        half = -(-len(part) // (2 * box)) * box
        open_parts += [part[half:], part[:half]]
    return np.concatenate(out) if out else np.zeros(0, int)


class Points:
    """The points of a page, packed in boxes."""

    def __init__(self, tids: np.ndarray, labels: np.ndarray, points: list[bytes]):
        flat = folded(points)
        order = packed_order(flat, BOX)
        self.tids, self.labels, self.flat = tids[order], labels[order], flat[order]
        self.points = [points[i] for i in order]
        self.n = self.flat.sum(axis=1, dtype=np.int64)

    def pairs(self, other: Points, limit: Limit) -> tuple[np.ndarray, np.ndarray] | None:
        """Pairs that may be linked and differ in class; none at all if they are too many."""
        starts = np.arange(0, len(other.flat), BOX)
        corners, least = np.maximum.reduceat(other.flat, starts, axis=0), np.minimum.reduceat(other.n, starts)
        most = DENSE * (len(self.flat) + len(other.flat))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for i in range(0, len(self.flat), BOX):
            mine, total = self.flat[i : i + BOX], self.n[i : i + BOX]
            # The box of these points against all boxes, then its points against those of the boxes left.
            open_boxes = limit.reached(np.minimum(mine.max(axis=0), corners).sum(axis=1, dtype=np.int64), total.min() + least)
            for j in starts[np.flatnonzero(open_boxes)].tolist():
                if other is self and j < i:
                    continue
                at = slice(j, j + BOX)
                both = np.minimum(mine[:, None, :], other.flat[None, at, :]).sum(axis=2, dtype=np.int64)
                hit = limit.reached(both, total[:, None] + other.n[None, at])
                hit &= self.labels[i : i + BOX, None] != other.labels[None, at]
                if other is self and i == j:
                    hit = np.triu(hit, 1)
                for x, y in zip(*(c.tolist() for c in np.nonzero(hit))):
                    if limit.reached(may_share(self.points[i + x], other.points[j + y]), self.n[i + x] + other.n[j + y]):
                        found.append((self.tids[i + x], other.tids[j + y]))
                if len(found) > most:
                    return None
        x, y = np.array(found, np.int64).reshape(-1, 2).T
        return np.minimum(x, y), np.maximum(x, y)


def _page(group: pa.Table) -> pa.Table:
    """One page: its box and its points."""
    points = group["point"].to_pylist()
    n, labels = group["n"].to_numpy(), group["label"].to_numpy()
    values = {
        "g": [group["g"][0].as_py()],
        "page": [group["page"][0].as_py()],
        "least": [int(n.min())],
        "most": [int(n.max())],
        "lo": [int(labels.min())],
        "hi": [int(labels.max())],
        "corner": pa.array([folded(points).max(axis=0).tolist()], pa.list_(pa.int32())),
        "tids": pa.array([group["tid"].to_numpy().tobytes()], pa.binary()),
        "labels": pa.array([labels.tobytes()], pa.binary()),
        "points": pa.array([points], pa.list_(pa.binary())),
    }
    return pa.table(values)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((),) * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["g", "pa", "pb", "a", "b"])


def _page_pairs(limit: Limit):
    """Pairs of points of two pages that may be linked; (null, null) where they are too many."""

    def page(row: dict, side: str) -> Points:
        ids, labels = (np.frombuffer(row[f"{side}_{c}"], np.int64) for c in ("tids", "labels"))
        return Points(ids, labels, row[f"{side}_points"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                key = row["a_g"], row["a_page"], row["b_page"]
                pairs = page(row, "a").pairs(page(row, "b"), limit)
                yield _found([(*key, None, None)] if pairs is None else [(*key, *p) for p in zip(*(c.tolist() for c in pairs))])

    return run


def _in_pages(limit: Limit):
    """Pairs of points of the same page that may be linked; (null, null) where they are too many.

    Rows (g, page, tid, label, n, point) come page by page. Pages no larger than a box are handled many at a time.
    """

    def done(table: pa.Table) -> list[tuple]:
        g, page, tid, label, n = (table.column(i).to_numpy() for i in range(5))
        points = table.column(5).to_pylist()
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (page[1:] != page[:-1])
        begun = np.flatnonzero(new)
        size = np.diff(np.append(begun, len(g)))
        of = np.repeat(np.arange(len(begun)), size)
        small = size[of] <= BOX
        flat = folded(points)
        out: list[tuple] = []
        for d in range(1, int(size[size <= BOX].max(initial=0))):
            x = np.flatnonzero((of[d:] == of[:-d]) & small[d:] & (label[d:] != label[:-d]))
            x = x[limit.percent * np.maximum(n[x], n[x + d]) <= 100 * np.minimum(n[x], n[x + d])]
            y = x + d
            keep = fitting(limit, [points[i] for i in x], [points[i] for i in y], flat[x], flat[y])
            pairs = np.sort(np.stack((tid[x], tid[y]), axis=1)[keep], axis=1)
            out += [(None, None, None, a, b) for a, b in pairs.tolist()]
        for i in np.flatnonzero(size > BOX):
            at = slice(begun[i], begun[i] + size[i])
            held = Points(tid[at], label[at], points[at])
            pairs = held.pairs(held, limit)
            key = int(g[at.start]), int(page[at.start]), int(page[at.start])
            out += [(*key, None, None)] if pairs is None else [(*key, *p) for p in zip(*(c.tolist() for c in pairs))]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table]).combine_chunks()
            if not table.num_rows:
                continue
            # The last page may go on in the next batch.
            g, page = table.column(0).to_numpy(), table.column(1).to_numpy()
            last = np.flatnonzero((g != g[-1]) | (page != page[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield _found(done(table.slice(0, cut)))
            rest = table.slice(cut)
        if rest is not None and rest.num_rows:
            yield _found(done(rest))

    return run


def _crowd(limit: Limit):
    """Exact links between the sets of two pages, as few as hold their classes together."""

    def run(group: pa.Table) -> pa.Table:
        tids, labels, page = (group[c].to_numpy() for c in ("tid", "label", "page"))
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"].to_pylist()]
        sizes = np.array([len(s) for s in sets])
        flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, of = flat[order], of[order]
        column = np.cumsum(np.concatenate(([0], flat[1:] != flat[:-1])))
        several = np.bincount(column) > 1
        keep = several[column]
        of, column = of[keep], (np.cumsum(several) - 1)[column[keep]]
        both = np.zeros((len(tids), len(tids)), np.float32)
        cuts = np.searchsorted(column, np.arange(0, int(several.sum()) + COLUMNS, COLUMNS))
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            held = np.zeros((len(tids), COLUMNS), np.float32)
            held[of[a:b], column[a:b] - i * COLUMNS] = 1
            both += held @ held.T
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := root.get(x, x)) != x:
                x = up
            return x

        first, second = group["pa"][0].as_py(), group["pb"][0].as_py()
        out = []
        for i in np.flatnonzero(page == first):
            hit = limit.reached(both[i].astype(np.int64), sizes[i] + sizes) & (labels != labels[i]) & (page == second)
            for j in np.flatnonzero(hit):
                x, y = top(int(labels[i])), top(int(labels[j]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((int(tids[i]), int(tids[j])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def linked(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85
) -> DataFrame:
    """key, n_shingles and component_id of every row: the smallest key that links reach.

    A text's set holds its distinct shingles of ``words`` words (ASCII letters in lower case; fewer words are one
    shingle). Two texts link when they share ``percent`` per cent or more of the union of their sets; rows that
    repeat a text or its set are linked. Null and empty texts and texts of white space have no shingles and stay
    alone: their component is their own key. Null keys count as larger than all others: a component of null keys
    has a null id. An empty table gives no rows; other columns are ignored. Texts are read whole, of any length.
    """
    limit = Limit(percent)
    common = common_shingles(df, text, words)
    rows = df.select(
        F.monotonically_increasing_id().alias("rid"), F.col(quoted(key)).alias("doc"), whole(quoted(text)).alias("text")
    )
    # Written once: from here on the rid is fixed.
    base = settle(described(rows, words, limit, common))
    texts = settle(
        base.where("n > 0").groupBy("da", "db").agg(F.min("rid").alias("tid"), F.min("doc").alias("least"), F.count("*").alias("copies"))
    )
    labels = components(Join(base, words, limit).links(texts))
    named = texts.join(labels.withColumnRenamed("node", "tid"), "tid", "left").withColumn("label", F.coalesce("label", "tid"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    found = settle(named.select("da", "db", "label").join(least, "label").selectExpr("da AS xa", "db AS xb", "component_id"))
    met = base.select("doc", "n", "da", "db").join(found, F.expr("da = xa AND db = xb AND n > 0"), "left")
    return met.selectExpr(
        f"doc AS {quoted(key)}", "n AS n_shingles", "CASE WHEN n > 0 THEN component_id ELSE doc END AS component_id"
    )
