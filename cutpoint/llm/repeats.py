"""Removal of byte strings that occur elsewhere, found in suffix arrays.

A string of LENGTH bytes counts if it also starts at any other place. Every such string has an anchor, the
place of its smallest 32-byte fingerprint, which only depends on the string; all its occurrences have the
same anchor in the same place. So only anchors whose fingerprint occurs twice matter, about one byte in
85 is an anchor, and strings that can be equal meet in one shard. An anchor's stretch (all strings that it
anchors) is settled by one hash where it occurs twice as a whole. Where stretches of a fingerprint differ,
their bytes go to shards; a shard's suffix array, built by induced sorting, puts equal strings next to each
other, and the common prefix of neighbours is compared byte for byte. A fingerprint with more different
stretches than a shard should hold is settled string by string, by counting hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cutpoint.llm.induced_sorting import common_words, suffix_array
from cutpoint.llm.near_copies import _ODD, mixed
from cutpoint.llm.texts import quoted, whole
from cutpoint.session import settle

#: Bytes of a string that may not repeat (a multiple of 8), and of a fingerprint.
LENGTH = 200
GRAM = 32
#: Texts are looked through in pieces of so many bytes.
PIECE = 1 << 21
#: Bytes of one shard, and different stretches of a fingerprint that one shard takes.
SHARD = 2 << 20
CROWD = 4096

_PLACES = np.uint64(2**31 - 1)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, base, np.uint64)
    down = np.full(n, pow(base, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _fingerprints(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place (zeros follow the end)."""
    padded = np.concatenate((data, np.zeros(GRAM + 8, np.uint8)))
    eight = np.ndarray((len(data) + GRAM,), "<u8", buffer=padded.data, strides=(1,))
    n, total = len(data), np.zeros(len(data), np.uint64)
    for k in range(0, GRAM, 8):
        total += mixed(eight[k : k + n] + _ODD[k // 8]) * _ODD[(k // 8 + 1) % 5]
    return mixed(total)


def _windows(prints: np.ndarray, first: np.ndarray, last: np.ndarray, base: int) -> np.ndarray:
    """A hash of all bytes of the strings from ``first`` to ``last`` (both included)."""
    up, down = _powers(base, 1 << max(4, (len(prints) + 1).bit_length()))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(prints * up[: len(prints)])))
    return mixed((sums[last + LENGTH - GRAM + 1] - sums[first]) * down[first] + (last - first).astype(np.uint64))


def stretches(data: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first start, last start, fingerprint, hash) of each anchor's stretch of strings.

    ``end``: for each byte the end of its text. Strings never cross it. Equal smallest fingerprints: the
    last one anchors.
    """
    n, width = len(data), LENGTH - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    prints = _fingerprints(data)
    keyed = (prints & ~_PLACES) | (_PLACES - np.arange(n, dtype=np.uint64))
    # Smallest of every ``width`` neighbours: from the left and from the right within blocks.
    blocks = -(-n // width) + 1
    padded = np.full(blocks * width, np.uint64(2**64 - 1))
    padded[:n] = keyed
    grid = padded.reshape(blocks, width)
    from_left = np.minimum.accumulate(grid, axis=1).ravel()
    from_right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.flatnonzero(np.arange(n) + LENGTH <= end)
    if not len(start):
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    smallest = np.minimum(from_right[start], from_left[start + width - 1])
    new = np.flatnonzero(np.concatenate(([True], smallest[1:] != smallest[:-1])))
    first, last = start[new], start[np.append(new[1:], len(start)) - 1]
    anchor = (_PLACES - (smallest[new] & _PLACES)).astype(np.int64)
    return first, last, prints[anchor], _windows(prints, first, last, 0x9E3779B97F4A7C15)


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, end of text, text, offset within the text) of PIECE bytes at a time; long texts overlap."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def made() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        counts = np.array([len(b) for _, _, b in held])
        data = np.frombuffer(b"".join(b for _, _, b in held), np.uint8)
        begun = np.cumsum(counts) - counts
        own = np.arange(len(data)) - np.repeat(begun, counts)
        offset = own + np.repeat(np.array([o for _, o, _ in held]), counts)
        return data, np.repeat(begun + counts, counts), np.repeat(np.array([i for i, _, _ in held]), counts), offset

    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), PIECE):
            part = text[at : at + PIECE + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if held and size + len(part) > PIECE:
                yield made()
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield made()


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """digest, first, last, key, hash, n of the stretches in texts (digest, text).

    A stretch that a text itself holds twice or more is known to repeat: its places come merged, with a
    null key, and once more with their number n to be found by other texts.
    """
    for batch in batches:
        digests = batch.column(0).to_pylist()
        texts = [t or b"" for t in batch.column(1).to_pylist()]
        for data, end, text, offset in _pieces(texts):
            first, last, key, hashed = stretches(data, end)
            if not len(first):
                continue
            of, begin, stop = text[first], offset[first], offset[first] + (last - first)
            order = np.lexsort((begin, hashed, key, of))
            of, begin, stop, key, hashed = (x[order] for x in (of, begin, stop, key, hashed))
            same = (of[1:] == of[:-1]) & (key[1:] == key[:-1]) & (hashed[1:] == hashed[:-1])
            heads = np.flatnonzero(np.concatenate(([True], ~same)))
            n = np.diff(np.append(heads, len(of)))
            yield _rows(digests, of[heads], begin[heads], stop[heads], key[heads], hashed[heads], n)
            if (n > 1).any():
                many = np.repeat(n > 1, n)
                of, begin, stop = of[many], begin[many], stop[many]
                order = np.lexsort((begin, of))
                of, begin, stop = of[order], begin[order], stop[order]
                reach = np.maximum.accumulate(stop + of * np.int64(1 << 32)) - of * np.int64(1 << 32)
                apart = np.concatenate(([True], (of[1:] != of[:-1]) | (begin[1:] > reach[:-1] + LENGTH)))
                heads = np.flatnonzero(apart)
                yield _rows(digests, of[heads], begin[heads], reach[np.append(heads[1:], len(of)) - 1])


def _rows(digests: list[bytes], of, first, last, key=None, hashed=None, n=None) -> pa.RecordBatch:
    nulls = pa.nulls(len(of), pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([digests[i] for i in of.tolist()], pa.binary()),
            pa.array(first.astype(np.int32)),
            pa.array(last.astype(np.int32)),
            nulls if key is None else pa.array(key.view(np.int64)),
            nulls if key is None else pa.array(hashed.view(np.int64)),
            pa.array(np.full(len(of), 2, np.int32) if n is None else n.astype(np.int32)),
        ],
        names=["digest", "first", "last", "key", "hash", "n"],
    )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the stretches that must be compared."""
    for batch in batches:
        for digest, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            rows = [(digest, w["first"], w["last"], w["key"], w["crowd"], text[w["first"] : w["last"] + LENGTH]) for w in wanted]
            if rows:
                names = ["digest", "first", "last", "key", "crowd", "bytes"]
                kinds = pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names)


FOUND = "digest binary, first int, last int"


def _found(digests: list[bytes], of: np.ndarray, start: np.ndarray) -> pa.Table:
    """Runs of neighbouring starts in one stretch as rows."""
    order = np.lexsort((start, of))
    of, start = of[order], start[order]
    heads = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (start[1:] != start[:-1] + 1)))) if len(of) else of
    stops = np.append(heads[1:], len(of)) - 1 if len(of) else of
    return pa.table(
        {
            "digest": pa.array([digests[i] for i in of[heads].tolist()], pa.binary()),
            "first": pa.array(start[heads].astype(np.int32)),
            "last": pa.array(start[stops].astype(np.int32)),
        }
    )


def _sorted_shard(shard: pa.Table) -> pa.Table:
    """Strings of a shard that start at another place of it too, by suffix array and common prefixes."""
    digests, first, last = (shard[c].to_pylist() for c in ("digest", "first", "last"))
    parts = shard["bytes"].to_pylist()
    counts = np.array([len(p) + 1 for p in parts])
    joined = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    # Bytes are moved up by one, so that the separators are smaller than all of them.
    text = joined.astype(np.int64) + 1
    begun = np.cumsum(counts) - counts
    text[begun + counts - 1] = 0
    of = np.repeat(np.arange(len(parts)), counts)
    own = np.arange(len(text)) - begun[of]
    starts = own <= (np.array(last) - np.array(first))[of]
    ordered = suffix_array(text, 257)
    ordered = ordered[starts[ordered]]
    equal = common_words(joined, ordered[:-1], ordered[1:], LENGTH)
    twice = np.zeros(len(ordered), bool)
    twice[1:] |= equal
    twice[:-1] |= equal
    hit = ordered[twice]
    return _found(digests, of[hit], own[hit] + np.array(first)[of[hit]])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of each single string of a stretch."""
    for batch in batches:
        for digest, first, last, data in zip(*(batch.column(c).to_pylist() for c in ("digest", "first", "last", "bytes"))):
            at = np.arange(last - first + 1)
            prints = _fingerprints(np.frombuffer(data, np.uint8))
            one, two = (_windows(prints, at, at, base) for base in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([digest] * len(at), pa.binary()),
                    pa.array((first + at).astype(np.int32)),
                    pa.array(one.view(np.int64)),
                    pa.array(two.view(np.int64)),
                ],
                names=["digest", "first", "one", "two"],
            )


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def marks(texts: DataFrame) -> DataFrame:
    """What is known of each text (digest, text) that may repeat: digest, marks (first, last, key, crowd, kind).

    Kind 0: all strings that start from first to last repeat. Kind 1: to be compared, kind 2: both.
    """
    schema = "digest binary, first int, last int, key long, hash long, n int"
    found = settle(texts.select("digest", "text").mapInArrow(_occurrences, schema))
    keys = found.where("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("total")).where("total > 1")
    shared = settle(found.join(keys.select("key"), "key"))
    by_hash = shared.groupBy("key", "hash").agg(F.sum("n").alias("m"), F.min(F.struct("digest", "first")).alias("one"))
    by_hash = settle(by_hash)
    by_key = by_hash.groupBy("key").agg(F.count("*").alias("crowd"), F.expr("count_if(m = 1) AS singles"))
    kind = "CASE WHEN m = 1 THEN 1 WHEN singles > 0 AND one = struct(digest, first) THEN 2 ELSE 0 END"
    known = shared.join(by_hash, ["key", "hash"]).join(by_key, "key")
    known = known.selectExpr("digest", "first", "last", "key", "crowd", f"{kind} AS kind")
    own = found.where("key IS NULL").selectExpr("digest", "first", "last", "key", "0L AS crowd", "0 AS kind")
    each = F.collect_set(F.struct("first", "last", "key", "crowd", "kind")).alias("marks")
    return known.unionByName(own).groupBy("digest").agg(each)


def compared(contexts: DataFrame) -> DataFrame:
    """Starts (digest, first, last) of the strings that repeat among stretches given with their bytes."""
    size = contexts.where(f"crowd <= {CROWD}").agg(F.sum(F.length("bytes"))).first()[0] or 0
    shards = max(1, -(-size // SHARD))
    few = contexts.where(f"crowd <= {CROWD}").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    by_sorting = few.groupBy("shard").applyInArrow(_sorted_shard, FOUND)
    strings = contexts.where(f"crowd > {CROWD}").mapInArrow(_strings, "digest binary, first int, one long, two long")
    twice = strings.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1").select("one", "two")
    by_hash = strings.join(twice, ["one", "two"]).selectExpr("digest", "first", "first AS last")
    return by_sorting.unionByName(by_hash)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns))
        spans, kept = [], []
        for text, known, more in zip(*(columns[c].to_pylist() for c in ("text", "known", "found"))):
            out = _merged([(s["first"], s["last"] + LENGTH) for s in [*(known or []), *(more or [])]])
            edges = [0, *[e for s in out for e in s], len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            spans.append([{"start": a, "end": b} for a, b in out])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [columns["row"], columns["text"], pa.array(kept, pa.binary()), pa.array(spans, kind)],
            names=["row", "text", "kept", "spans"],
        )


def without_repeats(df: DataFrame, text: str = "text", *, carry: list[str], derive: dict[str, str] | None = None) -> DataFrame:
    """Every row of ``df`` with its repeated bytes found and taken out.

    Result: the columns in ``carry`` and those in ``derive``, SQL over ``text`` and ``kept`` (binary: the
    UTF-8 bytes before and after) and ``spans`` (array of start, end: removed bytes, merged, in order); by
    default kept and spans themselves. A byte goes if any string of LENGTH bytes that covers it also starts
    elsewhere in the table, the same text included, judged on the input. Null texts count as empty; texts
    shorter than LENGTH lose nothing. Rows that are equal are different places: a text of LENGTH bytes or
    more that occurs twice goes whole, both times. Names in ``derive`` win over equal names in ``carry``.
    """
    derive = derive or {"kept": "kept", "spans": "spans"}
    taken = {n.lower() for n in derive}
    row = F.struct(F.lit(0).alias("_"), *[F.col(quoted(c)) for c in carry if c.lower() not in taken])
    texts = df.select(
        row.alias("row"),
        F.unhex(F.md5(whole(quoted(text)).cast("binary"))).alias("digest"),
        whole(quoted(text)).cast("binary").alias("text"),
    )
    known = marks(texts)
    results = [F.expr(sql).alias(n) for n, sql in derive.items()]
    no_spans = "CAST(array() AS array<struct<start: int, end: int>>)"
    joined = texts.join(known, "digest", "left")
    # Of texts that may lose something the bytes are kept; for the others the results are known here.
    clean = joined.select("*", F.col("text").alias("kept"), F.expr(no_spans).alias("spans"))
    outcome = F.when(F.col("marks").isNull(), F.struct(*results))
    step = settle(
        clean.select("row", "digest", "marks", F.expr("CASE WHEN marks IS NOT NULL THEN text END").alias("text"), outcome.alias("done"))
    )
    touched = step.where("marks IS NOT NULL")
    wanted = touched.selectExpr("digest", "text", "filter(marks, m -> m.kind > 0) AS wanted").where("size(wanted) > 0")
    schema = "digest binary, first int, last int, key long, crowd long, bytes binary"
    contexts = settle(wanted.mapInArrow(_contexts, schema).dropDuplicates(["digest", "first", "key"]))
    more = compared(contexts).groupBy("digest").agg(F.collect_set(F.struct("first", "last")).alias("found"))
    cut = touched.join(more, "digest", "left").selectExpr(
        "row", "text", "transform(filter(marks, m -> m.kind <> 1), m -> struct(m.first AS first, m.last AS last)) AS known", "found"
    )
    row_type = dict(step.dtypes)["row"]
    removed = cut.mapInArrow(_cut, f"row {row_type}, text binary, kept binary, spans array<struct<start: int, end: int>>")
    names = [c for c in carry if c.lower() not in taken]
    plain = step.where("marks IS NULL").select(*[f"row.{quoted(c)}" for c in names], *[f"done.{quoted(n)}" for n in derive])
    return removed.select(*[f"row.{quoted(c)}" for c in names], *results).unionByName(plain)

