"""Near-duplicate classes by DartMinHash signatures of word 5-shingles and a banded join.

A text is the weighted set of its shingles (weight: how often). Every unit of weight of every shingle is a
strip on which darts land as a Poisson process along the rank axis, drawn from hashes, so that texts which
share the strip share its darts. A text looks at ranks up to a bound of about (ln t + 2) / weight, which
yields t (ln t + 2) darts whatever the text's length, and keeps the earliest dart of each of t coordinates:
two texts agree in a coordinate with the probability of their weighted Jaccard similarity.

Equal bands propose pairs. A bucket isn't expanded into its pairs: its members are compared with the one
that meets the most others. Buckets that then still hold more than one class are compared block against
block, each pair of blocks in a task of its own that hands back the links that join classes, no others.
Only the exact similarity makes a link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cutpoint.llm.components import components
from cutpoint.llm.texts import quoted, whole, word_hashes
from cutpoint.session import settle

SHINGLE = 5
#: Strips of the texts of one block of a bucket, and strips compared at a time.
BLOCK = 100_000
COLUMNS = 8192
#: Words whose darts are thrown at a time.
STRETCH = 1 << 19

_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64
)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def strips(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strips of texts given as word hashes end to end: (text, strip), ordered by text.

    The n-th time that a text holds a shingle is a strip of its own, so the weighted similarity of two
    texts is the plain one of their strips. A text of fewer than five words is one shingle.
    """
    text = np.repeat(np.arange(len(counts)), counts)
    stop = np.repeat(np.cumsum(counts), counts)
    at = np.arange(len(hashes))
    start = at[(at + SHINGLE <= stop) | (at == stop - np.repeat(counts, counts))]
    text, stop = text[start], stop[start]
    total = np.zeros(len(start), np.uint64)
    padded = np.concatenate((hashes.astype(np.uint64), np.zeros(SHINGLE, np.uint64)))
    for k in range(SHINGLE):
        total += np.where(start + k < stop, padded[start + k], np.uint64(0)) * _ODD[k]
    total = mixed(total)
    order = np.lexsort((total, text))
    total, text = total[order], text[order]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (text[1:] != text[:-1])
    begun = np.flatnonzero(new)
    turn = np.arange(len(total)) - np.repeat(begun, np.diff(np.append(begun, len(total))))
    return text, mixed(total + turn.astype(np.uint64) * _ODD[0])


def signatures(text: np.ndarray, strip: np.ndarray, n_texts: int, t: int) -> np.ndarray:
    """The earliest dart of each of ``t`` coordinates: n_texts × t. A text without strips has none (all ones)."""
    nothing = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full(n_texts * t, nothing)
    weight = np.bincount(text, minlength=n_texts)
    bound = (math.log(t) + 2) / np.maximum(weight, 1)
    todo = np.arange(len(strip))
    while len(todo):
        of, own = text[todo], strip[todo]
        rank, limit, throw = np.zeros(len(todo)), bound[of], 0
        while len(of):
            drawn = mixed(own + _ODD[1:2] * np.uint64(throw + 1))
            rank = rank - np.log((drawn >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / t
            near = rank <= limit
            of, own, rank, limit = of[near], own[near], rank[near], limit[near]
            dart = mixed(drawn[near] ^ _ODD[2])
            # The rank in the high bits, the dart's own number in the low ones: the least is the earliest.
            keyed = ((rank * 2.0**32 / 32).clip(0, 2**32 - 1).astype(np.uint64) << np.uint64(32)) | (dart >> np.uint64(32))
            np.minimum.at(best, of * t + (dart % np.uint64(t)).astype(np.int64), keyed)
            throw += 1
        # Coordinates without a dart: the same darts again, up to twice the rank.
        missing = np.flatnonzero((best.reshape(n_texts, t) == nothing).any(axis=1) & (weight > 0))
        bound[missing] *= 2
        open_text = np.zeros(n_texts, bool)
        open_text[missing] = True
        todo = np.flatnonzero(open_text[text])
    return best.reshape(n_texts, t)


def _runs(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about STRETCH words, at least one text each."""
    begin, total = 0, 0
    for i, n in enumerate(counts.tolist()):
        if total and total + n > STRETCH:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(counts):
        yield begin, len(counts)


def _over_texts(df: DataFrame, schema: str, made) -> DataFrame:
    """Replace the last column, word hashes, by what ``made(hashes, counts)`` has for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            offsets = column.offsets.to_numpy()
            flat, counts = column.values.to_numpy(zero_copy_only=False), np.diff(offsets)
            for begin, end in _runs(counts):
                new = made(flat[offsets[begin] : offsets[end]].view(np.uint64), counts[begin:end])
                same = [c.slice(begin, end - begin) for c in batch.columns[:-1]]
                names = [*batch.schema.names[:-1], "made"]
                yield pa.RecordBatch.from_arrays([*same, new], names=names)

    return df.mapInArrow(run, schema)


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def band_keys(df: DataFrame, bands: int, rows: int) -> DataFrame:
    """``df`` (last column: word hashes) with ``made``: one key per band; none for a text without words."""
    t = bands * rows

    def made(hashes: np.ndarray, counts: np.ndarray) -> pa.Array:
        text, strip = strips(hashes, counts)
        darts = signatures(text, strip, len(counts), t) & np.uint64(0xFFFFFFFF)
        keys = np.zeros((len(counts), bands), np.uint64)
        for r in range(rows):
            keys = mixed(keys + darts[:, r::rows] * _ODD[r % 5] + np.uint64(r + 1))
        keys = mixed(keys + np.arange(bands, dtype=np.uint64) * _ODD[3])
        some = counts > 0
        return _lists(keys[some].ravel(), np.where(some, bands, 0))

    schema = ", ".join(f"{quoted(n)} {t}" for n, t in df.dtypes[:-1]) + ", made array<bigint>"
    return _over_texts(df, schema, made)


def strip_lists(df: DataFrame) -> DataFrame:
    """``df`` (last column: word hashes) with ``made``: the text's strips."""

    def made(hashes: np.ndarray, counts: np.ndarray) -> pa.Array:
        text, strip = strips(hashes, counts)
        return _lists(strip, np.bincount(text, minlength=len(counts)))

    schema = ", ".join(f"{quoted(n)} {t}" for n, t in df.dtypes[:-1]) + ", made array<bigint>"
    return _over_texts(df, schema, made)


def classes(
    df: DataFrame, text: str = "text", *, carry: list[str], similarity: float = 0.8, bands: int = 20, rows: int = 6
) -> DataFrame:
    """The near-duplicate class of every row: ``row`` (struct of the columns in ``carry``), rid, class, first.

    ``class`` is the smallest rid (a number of the row, by place in the input) of the rows whose texts are
    linked to this one's, directly or over others; ``first`` tells whether it is the row's own. Texts are
    linked if they are equal or if bands propose them and the exact weighted Jaccard similarity of their
    5-shingles is ``similarity`` or more (bands of 20 × 6: 99.8 % of pairs at 0.8). Texts without words,
    null ones among them, are alone in their class unless their white space is equal to another's; null
    counts as empty, so rows with null or empty texts form one class.
    """
    source = df.select(
        F.struct(*[F.col(quoted(c)) for c in carry]).alias("row"),
        F.md5(whole(quoted(text)).cast("binary")).alias("digest"),
        word_hashes(whole(quoted(text))).alias("hashes"),
    )
    # Written once: from here on the rid is fixed.
    found = settle(
        band_keys(source, bands, rows).select(F.monotonically_increasing_id().alias("rid"), "row", "digest", "made")
    )
    texts = found.groupBy("digest").agg(F.min("rid").alias("tid"))
    of_row = settle(found.select("rid", "digest").join(texts, "digest").select("rid", "digest", "tid"))
    members = (
        found.select("rid", "made")
        .join(of_row.where("rid = tid").select("rid"), "rid")
        .select(F.col("rid").alias("tid"), F.explode("made").alias("key"))
    )
    # Buckets of a single text drop out before anything is joined.
    shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = settle(members.join(shared, "key"))
    degrees = members.groupBy("tid").agg(F.sum("n").alias("degree"))
    members = members.select("tid", "key").join(degrees, "tid")

    links = _links(df, text, of_row, members, similarity)
    named = of_row.join(links.withColumnRenamed("node", "tid"), "tid", "left").select(
        "rid", F.coalesce("label", "tid").alias("class")
    )
    return found.select("rid", "row").join(named, "rid").select(
        "rid", "row", "class", (F.col("rid") == F.col("class")).alias("first")
    )


def _links(df: DataFrame, text: str, of_row: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """(node, label) of all texts that are linked to another, given the members of buckets (tid, key, degree)."""
    whole_text = whole(quoted(text))
    wanted = members.select("tid").distinct().join(of_row.where("rid = tid"), "tid").select("tid", F.col("digest").alias("of"))
    texts = df.select(F.md5(whole_text.cast("binary")).alias("digest"), whole_text.alias("text"))
    picked = texts.join(wanted, F.expr("digest = of")).select("tid", "text").dropDuplicates(["tid"])
    sets = settle(strip_lists(picked.select("tid", word_hashes(F.col("text")).alias("hashes"))))
    sizes = sets.selectExpr("tid", "size(made) AS n")
    members = settle(members.join(sizes, "tid"))

    def checked(pairs: DataFrame) -> DataFrame:
        both = "size(array_intersect(sa, sb))"
        return (
            pairs.join(sets.selectExpr("tid AS a", "made AS sa"), "a")
            .join(sets.selectExpr("tid AS b", "made AS sb"), "b")
            .selectExpr("a", "b", f"{both} AS both", "size(sa) + size(sb) AS all")
            .where(f"both >= {similarity!r}D * (all - both)")
            .select("a", "b")
        )

    # First every member is compared with the one of its bucket that meets the most others.
    pivots = settle(
        members.groupBy("key")
        .agg(F.max(F.struct("degree", F.expr("-tid AS less"), F.col("n").alias("pn"))).alias("p"))
        .selectExpr("key", "-p.less AS p", "p.pn AS pn")
    )
    pairs = members.join(pivots, "key").where(f"tid <> p AND least(n, pn) >= {similarity!r}D * greatest(n, pn)")
    near = settle(checked(pairs.selectExpr("least(tid, p) AS a", "greatest(tid, p) AS b").distinct()))
    labels = components(near)
    # In buckets that still hold several classes, all members are compared, block by block.
    labelled = members.join(labels.withColumnRenamed("node", "tid"), "tid", "left").selectExpr(
        "key", "tid", "n", "coalesce(label, tid) AS label"
    )
    open_keys = (
        labelled.groupBy("key")
        .agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum("n").alias("total"))
        .where("lo < hi")
        .selectExpr("key", f"CAST(ceil(total / {BLOCK}) AS BIGINT) AS blocks")
    )
    placed = labelled.join(open_keys, "key").selectExpr("key", "tid", "label", "blocks", "pmod(xxhash64(tid), blocks) AS block")
    spread = placed.join(sets, "tid").selectExpr("*", "explode(sequence(0L, blocks - 1)) AS other")
    grid = spread.selectExpr("key", "least(block, other) AS lo", "greatest(block, other) AS hi", "block", "tid", "label", "made")
    more = grid.groupBy("key", "lo", "hi").applyInArrow(_block_links(similarity), "a long, b long")
    return components(settle(near.unionByName(more)))


def _block_links(similarity: float):
    """Links between the texts of two blocks of a bucket, as few as hold their classes together."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        tids, labels, block = (group[c].to_numpy() for c in ("tid", "label", "block"))
        lists = group["made"].chunk(0) if group["made"].num_chunks else pa.array([], pa.list_(pa.int64()))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        sizes = np.diff(offsets)
        of = np.repeat(np.arange(len(tids)), sizes)
        # Strips that one text alone holds are in no intersection.
        order = np.argsort(flat, kind="stable")
        flat, of = flat[order], of[order]
        column = np.cumsum(np.concatenate(([0], flat[1:] != flat[:-1]))) if len(flat) else flat
        shared = np.bincount(column) > 1 if len(flat) else np.zeros(0, bool)
        keep = shared[column] if len(flat) else np.zeros(0, bool)
        of, column = of[keep], (np.cumsum(shared) - 1)[column[keep]] if len(flat) else column
        both = np.zeros((len(tids), len(tids)), np.float32)
        wide = int(shared.sum())
        cuts = np.searchsorted(column, np.arange(0, wide + COLUMNS, COLUMNS))
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            held = np.zeros((len(tids), COLUMNS), np.float32)
            held[of[a:b], column[a:b] - i * COLUMNS] = 1
            both += held @ held.T
        union = sizes[:, None] + sizes[None, :] - both
        lo, hi = group["lo"][0].as_py(), group["hi"][0].as_py()
        link = (both >= similarity * union) & (labels[:, None] != labels[None, :])
        link &= (block == lo)[:, None] & (block == hi)[None, :]
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := root.get(x, x)) != x:
                x = up
            return x

        out = []
        for i, j in np.argwhere(link).tolist():
            x, y = top(int(labels[i])), top(int(labels[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((int(tids[i]), int(tids[j])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def deduplicated(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """One row of each class: the first. Rows whose text is null or empty count as copies of each other."""
    first = classes(df, text, carry=df.columns, **options).where("first")
    return first.select(*[F.col(f"row.{quoted(c)}").alias(c) for c in df.columns])
