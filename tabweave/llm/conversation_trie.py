"""Operator 11: the prefix trie of conversations, as a z-fast trie.

A turn is an entry of WIDE bytes: a 128-bit digest of the conversation up to and with it,
and the UTF-8 bytes of the texts so far. A conversation is one row, its path: the entries
of its turns, one after the other (texts don't travel). Equal paths are met once, with
their number.

The compacted trie is a table of nodes (lo, hi, up, edge): the node's depth hi, its
parent's depth lo and last entry up, and the entries of the edge. A node is hashed under
its handle, the prefix of two-fattest length in (lo, hi] (the length divisible by the
largest power of two). A path finds where it leaves the trie by fat binary search: it asks
the table for its prefix of two-fattest length in the interval that is left; a hit moves
the interval's lower end to the node's depth (or ends in its edge), a miss the upper end
below the prefix, so log2(depth) joins find the node, and one more its child.

Paths are inserted in batches, chosen by their digests: the first has about FIRST paths,
each later one GROW times as many. Of a batch all paths find their exits at once; edges
left inside are split there, and the paths that leave at one point with the same turn are
sorted and streamed into nodes of their own. A prefix that many paths share is thus in the
trie before most of them come, so that they go on to different exits.

Counts go up the compacted trie with a grouped sum over each path's nodes, in partial sums
first. Of a path only what it owns counts for the tokens that a trie holds once: the part
whose smallest member it is. At last edges are expanded into a row a turn.

Defined results: rows without a conv_id take no part; null roles and texts are empty; turns
of equal number go by the MD5 of role and text; repeated turns each count; conversations
without turns after rebuilding are members of the root; without any conversation there is
no node; texts of any length are digested whole; columns of other names are not read. A
conversation's entries, 24 bytes a turn, are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, text_batches
from .vector_blocks import renewed

WIDE, FIRST, GROW = 24, 4096, 64



def entry(path: Column | str, depth: Column | str | int) -> Column:
    """Entry `depth` (from 1) of a path or an edge."""
    depth = F.lit(depth) if isinstance(depth, int) else F.col(depth) if isinstance(depth, str) else depth
    return F.substring(F.col(path) if isinstance(path, str) else path, (depth - 1) * WIDE + 1, F.lit(WIDE))


def bytes_to(e: Column | str) -> Column:
    """UTF-8 bytes of all texts up to an entry; none for the root."""
    return F.coalesce(F.conv(F.hex(F.substring(e, 17, 8)), 16, 10).cast("long"), F.lit(0).cast("long"))


def fattest(lo: Column, hi: Column) -> Column:
    """The number in (lo, hi] that the largest power of two divides."""
    k = F.length(F.bin(lo.bitwiseXOR(hi))) - 1
    return F.expr("0") + F.call_function("shiftleft", F.call_function("shiftright", hi, k), k)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, each a struct (turn, digest, size)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(own: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, turns): the first h turns of conversation c - c % group, then c's own ones after h; h = crc32 of c's digits % most."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    base = renewed(own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("first")))
    both = own.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % group}).join(base, "base", "left")
    first = F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return both.select("conv_id", F.concat(first, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path) of conversations given as (conv_id, turns)."""

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for turns in b.column("turns").to_pylist():
                last, size, path = b"", 0, []
                for t in turns:
                    last, size = hashlib.blake2b(last + t["digest"], digest_size=16).digest(), size + t["size"]
                    path.append(last + size.to_bytes(8, "big"))
                out.append(b"".join(path))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(out, pa.binary())], names=["conv_id", "path"])

    return text_batches(conversations).mapInArrow(chained, "conv_id long, path binary")


def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of sorted paths (key, at, path): those of a key leave the trie at depth `at` with the same next entry."""

    def node(path: bytes, lo: int, hi: int) -> tuple:
        return lo, hi, path[max(0, lo - 1) * WIDE : lo * WIDE], path[lo * WIDE : hi * WIDE]

    key, base, last, stack, out = None, 0, b"", [], []
    for b in batches:
        for k, at, path in zip(*(b.column(c).to_pylist() for c in ("key", "at", "path")), strict=True):
            common = base
            if k == key:
                n = min(len(last), len(path)) // WIDE
                # entries are chained: equal at one depth means equal above it
                low, high = base, n
                while low < high:
                    mid = (low + high + 1) // 2
                    low, high = (mid, high) if last[(mid - 1) * WIDE : mid * WIDE] == path[(mid - 1) * WIDE : mid * WIDE] else (low, mid - 1)
                common = low
            while stack and stack[-1] > common:
                hi = stack.pop()
                lo = max(stack[-1] if stack else base, common if k == key else base)
                out.append(node(last, lo, hi))
            if k != key:
                key, base = k, at
            elif common > base and (not stack or stack[-1] < common):
                stack.append(common)
            stack.append(len(path) // WIDE)
            last = path
        yield _nodes(out)
        out = []
    while stack:
        hi = stack.pop()
        out.append(node(last, stack[-1] if stack else base, hi))
    yield _nodes(out)


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("lo", pa.int32()), ("hi", pa.int32()), ("up", pa.binary()), ("edge", pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[c for c, _ in kinds])


_NODE = "lo int, hi int, up binary, edge binary"


def located(sequences: DataFrame, nodes: DataFrame, deepest: int) -> DataFrame:
    """The sequences with `at`, the depth at which they leave the trie, and inside which node (node, lo, hi) that is."""
    table = nodes.withColumn("f", fattest(F.col("lo"), F.col("hi")))
    table = table.select("f", entry("edge", F.col("f") - F.col("lo")).alias("h"), *[F.col(c).alias(f"n_{c}") for c in ("lo", "hi", "edge")])
    here = sequences.withColumns({"a": F.lit(0), "b": F.col("n"), "at": F.lit(None).cast("int"), "node": F.lit(None).cast("binary"), "lo": F.lit(None).cast("int"), "hi": F.lit(None).cast("int")})
    own = [*sequences.columns, "a", "b", "at", "node", "lo", "hi"]
    same = F.size(F.filter(F.sequence(F.col("n_lo") + 1, F.least("n_hi", "n")), lambda d: entry("path", d) == entry("edge_", d - F.col("n_lo"))))

    def asked(step: DataFrame, other: DataFrame, f: Column, going: Column) -> DataFrame:
        other = renewed(other.withColumnRenamed("n_edge", "edge_"))
        # paths that are done ask for their own end at depth 0, which no node has
        step = step.withColumns({"f": F.when(going, f).otherwise(0), "h": F.when(going, entry("path", f)).otherwise(F.col("end"))})
        return step.join(other, ["f", "h"], "left").withColumn("to", F.when(F.col("n_lo").isNotNull(), F.col("n_lo") + same))

    for _ in range(deepest.bit_length()):
        going = F.col("a") < F.col("b")
        step = asked(here, table, fattest(F.col("a"), F.col("b")), going)
        hit, inside = F.col("to").isNotNull(), F.col("to") < F.col("n_hi")
        here = step.select(
            *sequences.columns,
            F.when(hit, F.col("to")).otherwise(F.col("a")).alias("a"),
            F.when(hit & inside, F.col("to")).when(going & ~hit, F.col("f") - 1).otherwise(F.col("b")).alias("b"),
            F.when(hit & inside, F.col("to")).otherwise(F.col("at")).alias("at"),
            *[F.when(hit & inside, v).otherwise(F.col(c)).alias(c) for c, v in (("node", F.substring("edge_", -WIDE, WIDE)), ("lo", F.col("n_lo")), ("hi", F.col("n_hi")))],
        )
    # the handle of the last node may be longer than what the path shares with it: the child by the next entry
    child = nodes.select((F.col("lo") + 1).alias("f"), entry("edge", 1).alias("h"), *[F.col(c).alias(f"n_{c}") for c in ("lo", "hi", "edge")])
    step = asked(here, child, F.col("a") + 1, F.col("at").isNull() & (F.col("a") < F.col("n")))
    hit = F.col("to").isNotNull()
    return step.select(
        *sequences.columns,
        F.coalesce("at", F.when(hit, F.col("to")).otherwise(F.col("a"))).alias("at"),
        *[F.when(hit, v).otherwise(F.col(c)).alias(c) for c, v in (("node", F.substring("edge_", -WIDE, WIDE)), ("lo", F.col("n_lo")), ("hi", F.col("n_hi")))],
    ).select(*own[: len(sequences.columns)], "at", "node", "lo", "hi")


def split(nodes: DataFrame, exits: DataFrame) -> DataFrame:
    """The nodes with those edges cut that paths leave inside."""
    cuts = exits.where("at > lo and at < hi").groupBy("node", "lo", "hi").agg(F.array_sort(F.collect_set("at")).alias("cuts")).select(F.col("node").alias("id"), "cuts")
    both = nodes.withColumn("id", F.substring("edge", -WIDE, WIDE)).join(renewed(cuts), "id", "left")
    ends = F.concat(F.coalesce("cuts", F.array().cast("array<int>")), F.array("hi"))
    both = both.withColumn("piece", F.explode(F.zip_with(F.concat(F.array("lo"), F.slice(ends, 1, F.size(ends) - 1)), ends, lambda x, y: F.struct(x.alias("x"), y.alias("y")))))
    x, y, lo = F.col("piece.x"), F.col("piece.y"), F.col("lo")
    return both.select(x.alias("lo"), y.alias("hi"), F.when(x == lo, F.col("up")).otherwise(entry("edge", x - lo)).alias("up"), F.substring(F.col("edge"), (x - lo) * WIDE + 1, (y - x) * WIDE).alias("edge"))


def trie(sequences: DataFrame, first: int = FIRST, grow: int = GROW) -> DataFrame:
    """The compacted nodes (lo, hi, up, edge) of distinct sequences (end, path, n)."""
    found = sequences.where("n > 0").agg(F.count("*"), F.max("n")).first()
    count, deepest = found[0], found[1] or 0
    share = [first * grow**i / max(count, 1) for i in range(64) if i == 0 or first * grow ** (i - 1) < count]
    # a path's batch comes from its digest, so copies of a table are dealt alike
    place = F.conv(F.hex(F.substring("end", 1, 4)), 16, 10).cast("double") / 2.0**32
    dealt = sequences.where("n > 0").select("end", "path", "n", place.alias("place"))
    nodes = sequences.sparkSession.createDataFrame([], _NODE)
    for i, high in enumerate(share):
        low = share[i - 1] if i else 0.0
        batch = dealt.where((F.col("place") >= low) & (F.col("place") < high)).drop("place")
        if i == 0:
            exits = batch.withColumn("at", F.lit(0))
        else:
            exits = keep(located(batch, nodes, deepest))
            nodes = split(nodes, exits)
        new = exits.where("at < n").select(entry("path", F.col("at") + 1).alias("key"), "at", "path")
        new = new.repartition("key").sortWithinPartitions("key", "path").mapInArrow(grown, _NODE)
        nodes = keep(nodes.unionByName(new) if i else new)
    return nodes


def ended(rows: DataFrame) -> DataFrame:
    """(id, ends_sha256): SHA-256 of the members that end at a node, in ascending order.

    Dealt by ranges, so many ids of one node are many tasks' work; pieces of at most a
    megabyte then pass through the hash, which goes from one to the next by its nature.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, ids, out, at = b.column("end").to_pylist(), b.column("conv_id").to_pylist(), [], 0
            while at < len(ends):
                to = at + 1
                while to < len(ends) and ends[to] == ends[at]:
                    to += 1
                out.append((ends[at], ids[at], ",".join(map(str, ids[at:to])).encode()))
                at = to
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.binary()))], names=["end", "first", "piece"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for b in batches:
            out = []
            for end, piece in zip(b.column("end").to_pylist(), b.column("piece").to_pylist(), strict=True):
                if end != now:
                    if now is not None:
                        out.append((now, h.hexdigest()))
                    now, h = end, hashlib.sha256(piece)
                else:
                    h.update(b"," + piece)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.string())], names=["id", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()])], names=["id", "ends_sha256"])

    parts = rows.repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id").mapInArrow(pieces, "end binary, first long, piece binary")
    return parts.repartition("end").sortWithinPartitions("end", "first").mapInArrow(hashed, "id binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, first: int = FIRST, grow: int = GROW) -> DataFrame:
    """A row for each distinct prefix of the given (conv_id, turns)."""
    members = keep(paths(conversations).withColumns({"n": (F.octet_length("path") / WIDE).cast("int"), "end": F.substring("path", -WIDE, WIDE)}))
    sequences = members.groupBy("end").agg(F.min("conv_id").alias("sid"), F.count("*").alias("copies"), F.first("path").alias("path"), F.first("n").alias("n"))
    sequences = keep(sequences.withColumn("total", bytes_to("end")))
    nodes = trie(sequences, first, grow)
    kids = renewed(nodes.groupBy("up").agg(F.count("*").alias("kids")).withColumnRenamed("up", "id"))
    root = sequences.limit(1).select(F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(None).cast("binary").alias("up"), F.lit(b"").alias("edge"), F.lit(b"").alias("id"))
    nodes = nodes.withColumn("id", F.substring("edge", -WIDE, WIDE)).unionByName(root)
    nodes = keep(nodes.join(kids, "id", "left").withColumns({"kids": F.coalesce("kids", F.lit(0).cast("long")), "before": bytes_to("up")}))
    # the nodes on each path, the root included
    on = sequences.select("sid", "copies", "total", F.explode(F.concat(F.array(F.lit(b"")), F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), lambda d: entry("path", d))).otherwise(F.array().cast("array<binary>")))).alias("id"))
    on = keep(on.join(renewed(nodes.select("id", "before")), "id"))
    counts = renewed(on.groupBy("id").agg(F.sum("copies").alias("n_convs"), F.min("sid").alias("conv_id"), F.sum(F.col("copies") * F.col("total")).alias("all")))
    known = keep(nodes.join(counts, "id"))
    owned = renewed(known.groupBy(F.col("conv_id").alias("sid")).agg(F.min("before").alias("from"), F.max((F.col("kids") == 0).cast("long")).alias("leaf")))
    sums = on.join(owned, "sid", "left").groupBy("id").agg(
        F.sum(F.col("total") - F.greatest("before", F.coalesce("from", "total"))).alias("held"), F.sum(F.coalesce("leaf", F.lit(0).cast("long"))).alias("n_leaves")
    )
    ends = ended(members.select("end", "conv_id"))
    parents = renewed(known.select(F.col("id").alias("up"), F.col("conv_id").alias("parent")))
    whole = known.join(renewed(sums), "id").join(renewed(ends), "id", "left").join(parents, "up", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    depth = F.explode(F.when(F.col("hi") > 0, F.sequence(F.col("lo") + 1, F.greatest("hi", F.col("lo") + 1))).otherwise(F.array(F.lit(0))))
    rows = whole.withColumn("depth", depth)
    d, lo, hi = F.col("depth"), F.col("lo"), F.col("hi")
    past = F.when(d - lo > 1, bytes_to(entry("edge", d - 1 - lo))).otherwise(F.col("before"))
    return rows.select(
        "conv_id",
        d.cast("long").alias("depth"),
        F.when(d > lo + 1, F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs",
        F.when(d < hi, F.lit(1).cast("long")).otherwise(F.col("kids")).alias("n_children"),
        "n_leaves",
        (F.col("all") - F.col("n_convs") * past - F.col("held") + past - F.col("before")).alias("saved_tokens"),
        F.when(d == hi, F.coalesce("ends_sha256", none)).otherwise(none).alias("ends_sha256"),
    )
