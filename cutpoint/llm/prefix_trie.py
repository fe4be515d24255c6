"""The prefix trie of conversations, built as a z-fast trie.

A conversation is a string of turns. Every prefix has a 128-bit hash, so that two prefixes are equal if their
lengths and hashes are; turns are never compared again. The trie is kept compacted: a node stands at a branching
or at the end of a conversation, belongs to the conversation on whose path it was made (its *owner*) and is known
as (owner, depth); the edge above it covers the depths (low, depth]. A node's handle is its prefix at the
two-fattest depth of that edge, the number there that most powers of two divide.

Conversations are inserted in batches. Fat binary search finds the exit edge of each: it asks for the prefix at
the two-fattest depth of an interval that halves with every answer, so a conversation of n turns needs about
log n look-ups in the table of handles. One comparison with the owner's prefixes then gives the exit point.
All that leave at the same point by the same turn follow one of them, chosen by a hash, which becomes a new edge;
the others leave that edge further down, in the next round. Every step is a join or a grouping by prefix.

Tables hold one row per turn and are keyed by conversation and stretch of turns, so a conversation may hold any
part of all turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cutpoint.llm.texts import quoted
from cutpoint.session import settle

#: Turns of a conversation that are handled together.
STRETCH = 1024
#: Steps of the fat binary search that are planned as one job.
STEPS = 4
#: Of 16 parts of the conversations, those of the first batch; the rest are the second.
FIRST_BATCH = 2


def _fattest(low: str, high: str) -> str:
    """The two-fattest number of (low, high]."""
    bits = f"(length(bin({low} ^ {high})) - 1)"
    return f"shiftleft(shiftright({high}, {bits}), {bits})"


def numbered(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, place (from 1, by turn, null first, then role and a digest of the text), digest, bytes; settled.

    Rows are dealt by ranges of that order, so that the turns of a conversation may fill many tasks; places follow
    from the counts of conversations per task.
    """
    body = F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))
    who = F.coalesce(F.col(quoted(role)).cast("string"), F.lit(""))
    turns = df.select(
        F.col(quoted(conv)).cast("long").alias("conv"),
        F.col(quoted(turn)).alias("turn"),
        F.md5(who.cast("binary")).alias("who"),
        F.md5(body.cast("binary")).alias("what"),
        F.octet_length(body).cast("long").alias("bytes"),
        who.alias("role"),
    ).where("conv IS NOT NULL")
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "what", "tie"]
    ranged = turns.withColumn("tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*order)
    ranged = settle(
        ranged.sortWithinPartitions(*order).selectExpr(
            "conv", "unhex(md5(concat(who, what))) AS digest", "bytes", "monotonically_increasing_id() AS at"
        )
    )
    # The high bits of ``at`` are the task, the low ones the place in it.
    runs = ranged.groupBy("conv", F.expr("shiftright(at, 33) AS task")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    runs = runs.selectExpr(
        "conv AS of", "task", "first - coalesce(sum(n) OVER (PARTITION BY conv ORDER BY task"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS zero",
    )
    met = ranged.join(runs, F.expr("conv = of AND shiftright(at, 33) = task"))
    return settle(met.selectExpr("conv", "at - zero + 1 AS place", "digest", "bytes"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, length) and the turns (conv, depth, digest, bytes) of the rebuilt conversations, settled.

    Conversation c takes the first h turns of conversation c - c % 5, then its own after its first h, where
    h = crc32(c) % 9.
    """
    lengths = turns.groupBy("conv").agg(F.max("place").alias("own"))
    every = lengths.selectExpr("conv", "own", "conv - conv % 5 AS base", "crc32(CAST(CAST(conv AS STRING) AS BINARY)) % 9 AS h")
    bases = lengths.selectExpr("conv AS of", "own AS there")
    every = settle(
        every.join(bases, F.expr("base = of"), "left").selectExpr(
            "conv", "base", "h", "own", "least(h, coalesce(there, 0L)) AS taken"
        )
    )
    head = turns.where("place <= 8").selectExpr("conv AS of", "place", "digest", "bytes")
    head = every.select("conv", "base", "taken").join(head, F.expr("base = of AND place <= taken"))
    # Long conversations meet their own figures stretch by stretch.
    spread = every.where("own > h").selectExpr("conv AS of", "h", "taken", f"explode(sequence(0L, own DIV {STRETCH})) AS s")
    tail = turns.join(spread, F.expr(f"conv = of AND place DIV {STRETCH} = s")).where("place > h")
    steps = head.selectExpr("conv", "place AS depth", "digest", "bytes").unionByName(
        tail.selectExpr("conv", "taken + place - h AS depth", "digest", "bytes")
    )
    return every.selectExpr("conv", "taken + greatest(own - h, 0L) AS length"), steps


def prefixes(steps: DataFrame) -> DataFrame:
    """conv, depth, a, b (the prefix's hash), bytes (of the last text), total (bytes so far); settled.

    A prefix's hash is the exclusive or of hashes of (depth, turn): it can be carried on from stretch to stretch.
    """
    keyed = settle(
        steps.selectExpr(
            "conv", "depth", f"depth DIV {STRETCH} AS s", "xxhash64(depth, digest) AS a", "xxhash64(digest, depth) AS b", "bytes"
        )
    )
    sums = keyed.groupBy("conv", "s").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("bytes").alias("n"))
    before = "OVER (PARTITION BY conv ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    sums = sums.selectExpr(
        "conv AS of", "s AS piece", f"coalesce(bit_xor(a) {before}, 0L) AS a0", f"coalesce(bit_xor(b) {before}, 0L) AS b0",
        f"coalesce(sum(n) {before}, 0L) AS n0",
    )
    so_far = "OVER (PARTITION BY conv, s ORDER BY depth)"
    own = keyed.selectExpr("conv", "s", "depth", f"bit_xor(a) {so_far} AS a", f"bit_xor(b) {so_far} AS b", "bytes", f"sum(bytes) {so_far} AS n")
    met = own.join(sums, F.expr("conv = of AND s = piece"))
    return settle(met.selectExpr("conv", "depth", "a ^ a0 AS a", "b ^ b0 AS b", "bytes", "n + n0 AS total"))


class Trie:
    """Leaves (owner, low, parent, high), cuts (owner, depth) of their paths, and where conversations end.

    ``parent`` owns the node at depth ``low`` under which the owner's path begins; the root is (0, 0).
    """

    def __init__(self, paths: DataFrame):
        spark = paths.sparkSession
        self.paths = paths
        self.leaves = spark.createDataFrame([], "owner long, low long, parent long, high long")
        self.cuts = spark.createDataFrame([], "owner long, depth long")
        self.ends = spark.createDataFrame([], "conv long, owner long, depth long")

    def edges(self) -> DataFrame:
        """owner, low, high, parent of every compacted node but the root."""
        points = self.cuts.unionByName(self.leaves.selectExpr("owner", "high AS depth")).distinct()
        told = points.selectExpr("owner AS of", "depth AS high", "lag(depth) OVER (PARTITION BY owner ORDER BY depth) AS above")
        met = told.join(self.leaves.select("owner", "low", "parent"), F.expr("of = owner"))
        return met.selectExpr(
            "owner", "coalesce(above, low) AS low", "high", "CASE WHEN above IS NULL THEN parent ELSE owner END AS parent"
        )

    def insert(self, batch: DataFrame) -> None:
        """Insert conversations (conv, length) that the trie doesn't hold yet."""
        some = len(self.leaves.take(1)) > 0
        # An owner of null: at the root, whose turns nobody's path shares.
        start = batch.selectExpr("conv", "length", "0L AS owner", "0L AS known")
        active = settle(self._located(start)) if some else start
        leaves, cuts, ends = [], [], []
        while active.take(1):
            # The exit point: how far the path goes along with its owner's.
            mine = self.paths.join(active.where("known > 0").selectExpr("conv AS of", "owner", "known"), F.expr("conv = of AND depth > known"))
            theirs = self.paths.selectExpr("conv AS other", "depth AS d", "a AS x", "b AS y")
            shared = mine.join(theirs, F.expr("owner = other AND depth = d AND a = x AND b = y"))
            reach = shared.groupBy("of").agg(F.max("depth").alias("reached"))
            turns = self.paths.selectExpr("conv AS on", "depth", "a", "b")
            left = active.join(reach, F.expr("conv = of"), "left").selectExpr(
                "conv", "length", "owner", "coalesce(reached, known) AS exit"
            )
            left = settle(left.join(turns, F.expr("conv = on AND depth = exit + 1"), "left").drop("on", "depth"))
            ends.append(left.where("length = exit").selectExpr("conv", "owner", "exit AS depth"))
            cuts.append(left.where("exit > 0").selectExpr("owner", "exit AS depth"))
            # By which turn the others leave; one conversation per way out becomes the new path.
            ways = left.where("length > exit")
            chosen = ways.groupBy("owner", "exit", "a", "b").agg(
                F.min(F.expr("struct(xxhash64(conv) AS h, conv, length)")).alias("c")
            )
            chosen = chosen.selectExpr("owner AS parent", "exit AS low", "a AS x", "b AS y", "c.conv AS new", "c.length AS high")
            ways = settle(ways.join(chosen, F.expr("owner = parent AND exit = low AND a = x AND b = y")))
            made = ways.where("conv = new")
            leaves.append(made.selectExpr("new AS owner", "low", "parent", "high"))
            ends.append(made.selectExpr("new AS conv", "new AS owner", "high AS depth"))
            active = ways.where("conv <> new").selectExpr("conv", "length", "new AS owner", "exit + 1 AS known")
        self.leaves = settle(_all(self.leaves, leaves))
        self.cuts = settle(_all(self.cuts, cuts).distinct())
        self.ends = settle(_all(self.ends, ends))

    def _located(self, start: DataFrame) -> DataFrame:
        """The exit edge of every conversation by fat binary search: its owner and a depth known to be shared."""
        nodes = settle(self.edges())
        handles = nodes.selectExpr("owner", "low", "high", f"{_fattest('low', 'high')} AS f")
        named = self.paths.selectExpr("conv AS of", "depth AS d", "a AS x", "b AS y")
        handles = settle(handles.join(named, F.expr("owner = of AND d = f")).selectExpr("owner AS found", "high", "f", "x", "y"))
        ways = nodes.join(named, F.expr("owner = of AND d = low + 1")).selectExpr("owner AS below", "low", "x", "y")
        mine = self.paths.selectExpr("conv AS of", "depth AS d", "a", "b")
        now = start.selectExpr("conv", "length", "owner", "0L AS top", "known", "0L AS low", "length AS high")
        done = []
        while True:
            for _ in range(STEPS):
                asked = now.withColumn("g", F.expr(f"CASE WHEN low < high THEN {_fattest('low', 'high')} END"))
                asked = asked.join(mine, F.expr("conv = of AND d = g"), "left").drop("of", "d")
                met = asked.join(handles.withColumnRenamed("high", "stop"), F.expr("g = f AND a = x AND b = y"), "left")
                now = met.selectExpr(
                    "conv", "length", "coalesce(found, owner) AS owner", "coalesce(stop, top) AS top", "coalesce(f, known) AS known",
                    "CASE WHEN found IS NULL THEN low ELSE least(stop, high) END AS low",
                    "CASE WHEN found IS NULL AND g IS NOT NULL THEN g - 1 ELSE high END AS high",
                )
            now = settle(now)
            done.append(now.where("low >= high"))
            now = now.where("low < high")
            if not now.take(1):
                break
        # The edge found, or one below its node if the next turn leads on to it.
        last = _all(done[0], done[1:])
        turn = last.join(mine, F.expr("conv = of AND d = top + 1"), "left")
        on = turn.join(ways.withColumnRenamed("low", "under"), F.expr("d - 1 = under AND a = x AND b = y"), "left")
        return on.selectExpr(
            "conv", "length", "coalesce(below, owner) AS owner", "CASE WHEN below IS NULL THEN known ELSE top + 1 END AS known"
        )


def _all(first: DataFrame, more: list[DataFrame]) -> DataFrame:
    for df in more:
        first = first.unionByName(df)
    return first


def build(lengths: DataFrame, paths: DataFrame) -> Trie:
    """The trie of all conversations, in two batches."""
    trie = Trie(paths)
    part = "pmod(xxhash64(conv, 7), 16)"
    for where in (f"{part} < {FIRST_BATCH}", f"{part} >= {FIRST_BATCH}"):
        trie.insert(lengths.where(where))
    return trie


def _digests(ends: DataFrame) -> DataFrame:
    """owner, depth, ends_sha256 of nodes where conversations end: their numbers in order, joined by commas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, so_far = None, None
        for batch in batches:
            out = []
            for node in zip(*(c.to_pylist() for c in batch.columns)):
                if node[:2] != key:
                    if key:
                        out.append((*key, so_far.hexdigest()))
                    key, so_far = node[:2], hashlib.sha256(str(node[2]).encode())
                else:
                    so_far.update(b",%d" % node[2])
            yield _rows(out)
        if key:
            yield _rows([(*key, so_far.hexdigest())])

    def _rows(rows: list) -> pa.RecordBatch:
        owner, depth, digest = zip(*rows) if rows else ((), (), ())
        columns = [pa.array(owner, pa.int64()), pa.array(depth, pa.int64()), pa.array(digest, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["owner", "depth", "ends_sha256"])

    # A hash runs over its node's members one after the other; they stream by, whatever their number.
    dealt = ends.select("owner", "depth", "conv").repartition("owner", "depth").sortWithinPartitions("owner", "depth", "conv")
    return dealt.mapInArrow(run, "owner long, depth long, ends_sha256 string")


def summed(trie: Trie, lengths: DataFrame) -> DataFrame:
    """Every compacted node (owner, low, high, parent) with its children, and sums over its subtree; settled.

    Sums climb by doubling: after k rounds a node holds those of the 2^k levels from itself on.
    """
    paths = trie.paths
    points = paths.selectExpr("conv AS of", "depth AS d", "total")
    full = lengths.join(points, F.expr("conv = of AND length = d"), "left").selectExpr("conv AS name", "coalesce(total, 0L) AS total")
    ended = trie.ends.join(full, F.expr("conv = name")).groupBy("owner", "depth").agg(
        F.count("*").alias("n"), F.min("conv").alias("least"), F.sum("total").alias("full")
    )
    edges = settle(trie.edges())
    nodes = edges.unionByName(lengths.limit(1).selectExpr("0L AS owner", "0L AS low", "0L AS high", "CAST(NULL AS BIGINT) AS parent"))
    children = edges.groupBy("parent", "low").agg(F.count("*").alias("n_children")).selectExpr("parent AS p", "low AS pd", "n_children")
    below = points.selectExpr("of AS o1", "d AS d1", "total AS upper")
    nodes = nodes.join(ended.withColumnsRenamed({"owner": "o", "depth": "d0"}), F.expr("owner = o AND high = d0"), "left")
    nodes = nodes.join(children, F.expr("owner = p AND high = pd"), "left")
    nodes = nodes.join(points, F.expr("owner = of AND high = d"), "left").join(below, F.expr("owner = o1 AND low = d1"), "left")
    now = settle(
        nodes.selectExpr(
            "owner", "high", "low", "parent", "coalesce(n_children, 0L) AS n_children", "parent AS up", "low AS up_depth",
            "coalesce(n, 0L) AS n", "least", "coalesce(full, 0L) AS full", "CAST(n_children IS NULL AS BIGINT) AS n_leaves",
            "coalesce(upper, 0L) AS start", "coalesce(total, 0L) - coalesce(upper, 0L) AS width",
        )
    )
    while now.where("up IS NOT NULL").take(1):
        given = now.where("up IS NOT NULL").groupBy(F.expr("up AS o"), F.expr("up_depth AS d")).agg(
            F.sum("n").alias("n1"), F.min("least").alias("l1"), F.sum("full").alias("f1"), F.sum("n_leaves").alias("v1"), F.sum("width").alias("w1")
        )
        # The root has nobody above; those that have reached it needn't ask.
        jump = now.where("up IS NOT NULL").selectExpr("owner AS o2", "high AS d2", "up AS up2", "up_depth AS upd2")
        met = now.join(given, F.expr("owner = o AND high = d"), "left").join(jump, F.expr("up_depth > 0 AND up = o2 AND up_depth = d2"), "left")
        now = settle(
            met.selectExpr(
                "owner", "high", "low", "parent", "n_children", "up2 AS up", "upd2 AS up_depth", "n + coalesce(n1, 0L) AS n",
                "least(least, l1) AS least", "full + coalesce(f1, 0L) AS full", "n_leaves + coalesce(v1, 0L) AS n_leaves",
                "start", "width + coalesce(w1, 0L) AS width",
            )
        )
    return now


def prefix_trie(
    df: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256, and owner: with depth, owner names the node (a conversation whose path it was made on).

    Turns are ordered by number, null first; rows that share it by role, then by a digest of the text, so that the
    order never changes; equal rows are turns of their own. Null roles and texts count as empty. Rows without a
    conversation take no part. An empty table gives no rows, not even a root. Other columns are ignored.
    """
    lengths, steps = rebuilt(numbered(df, conv, turn, role, text))
    lengths, paths = settle(lengths), prefixes(steps)
    trie = build(lengths, paths)
    nodes = summed(trie, lengths)
    above = nodes.selectExpr("owner AS o", "high AS d", "least AS parent_least")
    nodes = nodes.join(above, F.expr("parent = o AND low = d"), "left").drop("o", "d")
    nodes = nodes.join(_digests(trie.ends).withColumnRenamed("owner", "o"), F.expr("o = owner AND depth = high"), "left").drop("o", "depth")
    # Edges are expanded stretch by stretch to the turns on them.
    spread = nodes.withColumn("s", F.expr(f"explode(sequence((low + 1) DIV {STRETCH}, greatest(low + 1, high) DIV {STRETCH}))"))
    each = spread.withColumn(
        "depth",
        F.expr(
            "explode(CASE WHEN high = 0 THEN array(0L) ELSE"
            f" sequence(greatest(low + 1, s * {STRETCH}), least(high, s * {STRETCH} + {STRETCH - 1})) END)"
        ),
    )
    turns = trie.paths.selectExpr("conv AS of", "depth AS d", "bytes", "total")
    each = each.join(turns, F.expr("owner = of AND depth = d"), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return each.selectExpr(
        "least AS conv_id",
        "depth",
        "CASE WHEN depth = low + 1 THEN parent_least WHEN depth > 0 THEN least END AS parent_conv_id",
        "n AS n_convs",
        "CASE WHEN depth = high THEN n_children ELSE 1L END AS n_children",
        "n_leaves",
        # Bytes of all members from here on, less those of one copy of every turn.
        "full - n * coalesce(total - bytes, 0L) - (width - coalesce(total - bytes - start, 0L)) AS saved_tokens",
        f"CASE WHEN depth = high THEN coalesce(ends_sha256, '{nothing}') ELSE '{nothing}' END AS ends_sha256",
        "owner",
    )
