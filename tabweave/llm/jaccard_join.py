"""Operator 4: n-gram Jaccard join by parity sketches.

A text's set is its distinct five-word shingles. Two texts link when their sets'
Jaccard similarity is 0.8 or more; then their symmetric difference is at most a
quarter of the smaller set.

Sketches. In the band of sets of 2^L to 2^(L+1) - 1 shingles, each shingle belongs to
one of 2^(L+1) blocks, and a block is the XOR of its shingles' hashes: a shingle in
one set only changes one block, so the number of unequal blocks is at most the
symmetric difference. A set near a band's lower end also takes part in the band above.
The same parities of finer blocks, one bit each, are a bit sketch whose Hamming
distance is at most the symmetric difference.

Pigeonhole join. Blocks are put in an order that is the same for all sets (empty ones
last). If at most d blocks differ, the first common one is among the first d + 1 of
either set, so those are all the keys a set needs, d being a quarter of its size.

Candidates. Sets with a common key meet in a bucket. A small bucket gives all its
pairs; a large one gives pairs with its first member only, and its members are kept.
Candidates whose sizes and Hamming distance allow a link are verified on the whole
sets. Large buckets whose members have not all come together by then are cut into
tiles of bounded size and gone through in three steps: a part of the buckets gives
the nearest pairs that would join a tile's groups into one (a spanning forest by
Hamming distance); a part gives all pairs that are still apart; then all buckets give
what is still apart and hasn't failed. Texts that link share most of their buckets, so
the first steps find nearly all, and a group of near copies never gives all its pairs;
the last step leaves out no link that could join two groups.

Keys travel packed, some thousands a row. Equal sets within a task are one set from
the start, and later all equal sets (128-bit digest) are one class.

Defined results: null text counts as empty; texts without words have an empty set
and link with nothing; a row with a null key gets a null component and takes no
part; rows that repeat a key are one node, each with a row of its own in the result
(`deduplicated` keeps texts that share a key apart); texts of any length are read whole;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank_null, keep, slices, text_batches, tidy, tidy_group
from .graph import components
from .packing import KEY, joined, pack_ids, pack_keys, unpack_ids, unpack_keys
from .shingles import mix, sets

#: Keys that a task holds before it sends them on, and documents for each partition of the keys.
HELD, DOCS_A_PART = 600_000, 4000
#: Buckets up to here give all their pairs; runs above LOCAL within a task are cut to their first member.
PAIRS_UP_TO, LOCAL = 6, 64
#: Members of a tile of a large bucket.
TILE = 1024
#: Rows up to which an id table is broadcast (about 16 bytes a row).
BROADCAST_IDS = 2_000_000
#: Steps over the large buckets: spanning forests or all pairs, and one in how many buckets. The last one is whole.
STEPS = ((True, 8), (False, 8), (False, 1))


def bands(n: int) -> list[int]:
    level = n.bit_length() - 1
    return [level, level + 1] if 10 * n >= 8 << (level + 1) else [level]


def keys_of(s: np.ndarray) -> np.ndarray:
    """The pigeonhole keys of a set."""
    need, out = len(s) // 4 + 1, []
    for level in bands(len(s)):
        blocks = np.zeros(2 << level, np.uint64)
        np.bitwise_xor.at(blocks, (s >> np.uint64(63 - level)).astype(np.int64), s)
        full = np.flatnonzero(blocks)[:need]
        if len(full) < need:
            full = np.concatenate([full, np.flatnonzero(blocks == 0)[: need - len(full)]])
        out.append(mix(blocks[full] ^ mix(full.astype(np.uint64), 7), level + 11))
    return np.concatenate(out) & KEY


def bit_sketch(s: np.ndarray) -> bytes:
    """Parities of blocks, four to eight a shingle (half of that from 512 shingles on), by bits of the hash that the keys don't use.

    The more blocks, the nearer the Hamming distance comes to the symmetric difference.
    """
    level = len(s).bit_length() - 1
    bits = max(64, min(8 << level, max(2048, 4 << level)))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _fold(sketch: bytes, size: int) -> int:
    """The sketch with fewer bits: parities of blocks put together."""
    x = int.from_bytes(sketch, "little")
    n = len(sketch)
    while n > size:
        n //= 2
        x = (x >> (8 * n)) ^ (x & ((1 << (8 * n)) - 1))
    return x


def small(sketch: bytes, n: int) -> bytes:
    """The sketch folded to one or two bits a shingle (half of that from 1024 on): what pairs and large buckets are tested with first."""
    size = max(8, ((2 if n < 1024 else 1) << (n.bit_length() - 1)) // 8)
    return _fold(sketch, size).to_bytes(size, "little") if len(sketch) > size else sketch


def can_link(n1: int, s1: bytes, n2: int, s2: bytes) -> bool:
    if 10 * min(n1, n2) < 8 * max(n1, n2):
        return False
    size = min(len(s1), len(s2))
    return (_fold(s1, size) ^ _fold(s2, size)).bit_count() * 9 <= n1 + n2


def digest(s: np.ndarray) -> tuple[int, int]:
    return int(np.bitwise_xor.reduce(mix(s, 1)).view(np.int64)), int(np.add.reduce(mix(s, 2)).view(np.int64))


def _runs(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, id) in order, and start and length of each key's run."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    if len(keys):
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])
        keys, ids = keys[new], ids[new]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys, ids, start, np.diff(np.append(start, len(keys)))


def _pairs(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All pairs of the small runs, and pairs with the first member of the others."""
    out = [np.zeros((0, 2), np.int64)]
    for k in range(2, PAIRS_UP_TO + 1):
        at = start[size == k]
        for i in range(k):
            for j in range(i + 1, k):
                out.append(np.stack([ids[at + i], ids[at + j]], 1))
    for a, k in zip(start[size > PAIRS_UP_TO].tolist(), size[size > PAIRS_UP_TO].tolist(), strict=True):
        out.append(np.stack([np.full(k - 1, ids[a]), ids[a + 1 : a + k]], 1))
    found = np.concatenate(out)
    return np.unique(found, axis=0) if len(found) else found


_PACKED = "part long, keys binary, ids binary, cut binary, pairs binary, buckets binary, nodes binary, sketches array<binary>"


def _map(path_parts: int):
    """Batches of documents to packed keys, one row for each part of the key space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held_ids, nodes, sketches, first, held = [], [], [], [], {}, 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal held
            keys, ids, start, size = _runs(np.concatenate(held_keys or [np.zeros(0, np.uint64)]), np.concatenate(held_ids or [np.zeros(0, np.int64)]))
            big = np.flatnonzero(size > LOCAL)
            stay, cut, pairs, buckets = np.ones(len(keys), bool), [], [], []
            for a, k in zip(start[big].tolist(), size[big].tolist(), strict=True):
                stay[a + 1 : a + k] = False
                cut.append(keys[a])
                pairs.append(np.stack([np.full(k - 1, ids[a]), ids[a + 1 : a + k]], 1))
                buckets.append(np.stack([np.full(k, keys[a]).view(np.int64), ids[a : a + k]], 1))
            keys, ids, cut = keys[stay], ids[stay], np.array(cut, np.uint64)
            loose = np.unique(np.concatenate(pairs), axis=0).tobytes() if pairs else b""
            full = np.concatenate(buckets).tobytes() if buckets else b""
            part_of = lambda x: (x >> np.uint64(16)) % np.uint64(path_parts)
            part, cut_part = part_of(keys), part_of(cut)
            order = np.argsort(part, kind="stable")
            keys, ids = keys[order], ids[order]
            ends = np.searchsorted(part[order], np.arange(path_parts + 1, dtype=np.uint64))
            rows = {"part": [], "keys": [], "ids": [], "cut": [], "pairs": [], "buckets": [], "nodes": [], "sketches": []}
            for p in range(path_parts):
                a, b = ends[p], ends[p + 1]
                mine = cut[cut_part == p] if len(cut) else cut
                if b > a or p == 0:
                    for c, v in zip(rows, (p, pack_keys(keys[a:b]), pack_ids(ids[a:b]), mine.tobytes(), b"", b"", b"", []), strict=True):
                        rows[c].append(v)
            # what isn't keyed goes with a part drawn from the first node, to spread it
            at = int(nodes[0][0]) % len(rows["part"]) if nodes else 0
            rows["pairs"][at], rows["buckets"][at], rows["nodes"][at], rows["sketches"][at] = loose, full, np.array(nodes, np.int64).tobytes(), list(sketches)
            kinds = [pa.int64(), *[pa.binary()] * 6, pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], names=list(rows))
            held = 0
            for x in (held_keys, held_ids, nodes, sketches):
                x.clear()

        for batch in slices(batches, "text", 2 << 20):
            ids = batch.column(batch.schema.get_field_index("id")).to_pylist()
            for i, s in zip(ids, sets(batch.column(batch.schema.get_field_index("text")).to_pylist()), strict=True):
                if not len(s):
                    nodes.append((i, 0, 0, 0))
                    sketches.append(b"")
                    continue
                d = (len(s), *digest(s))
                nodes.append((i, *d))
                if d in first:
                    sketches.append(b"")
                    continue
                if len(first) < 100_000:
                    first[d] = i
                k = keys_of(s)
                sketches.append(bit_sketch(s))
                held_keys.append(k)
                held_ids.append(np.full(len(k), i, np.int64))
                held += len(k)
            if held > HELD:
                yield from out()
        if nodes:
            yield from out()

    return run


_FOUND = "kind int, a long, b long, n long, h1 long, h2 long, sketch binary, small binary"


def _meet(t: pa.Table) -> pa.Table:
    """One part of the key space: its buckets' pairs and large buckets, and the nodes that came along."""
    join = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
    keys, ids, start, size = _runs(unpack_keys(t.column("keys").to_pylist()), joined([unpack_ids(x) for x in t.column("ids").to_pylist()]))
    pairs = np.concatenate([_pairs(ids, start, size), join("pairs", np.int64).reshape(-1, 2)])
    cut = np.isin(keys[start], join("cut", np.uint64)) if len(start) else np.zeros(0, bool)
    large = np.repeat((size > PAIRS_UP_TO) | cut, size)
    buckets = np.concatenate([np.stack([keys[large].view(np.int64), ids[large]], 1), join("buckets", np.int64).reshape(-1, 2)])
    nodes = join("nodes", np.int64).reshape(-1, 4)
    sketches = [x for v in t.column("sketches").to_pylist() for x in v]
    n_p, n_b, n_n = len(pairs), len(buckets), len(nodes)
    col = lambda *x: pa.array(np.concatenate(x), pa.int64())
    none = np.zeros(n_p + n_b, np.int64)
    return pa.table(
        {
            "kind": pa.array(np.repeat([0, 1, 2], [n_n, n_p, n_b]).astype(np.int32)),
            "a": col(nodes[:, 0], pairs[:, 0], buckets[:, 0]),
            "b": col(np.zeros(n_n, np.int64), pairs[:, 1], buckets[:, 1]),
            "n": col(nodes[:, 1], none),
            "h1": col(nodes[:, 2], none),
            "h2": col(nodes[:, 3], none),
            "sketch": pa.array([x or None for x in sketches] + [None] * (n_p + n_b), pa.binary()),
            "small": pa.array([small(x, n) if x else None for x, n in zip(sketches, nodes[:, 1].tolist(), strict=True)] + [None] * (n_p + n_b), pa.binary()),
        }
    )


def _sketch_test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        nu, su, nv, sv = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("nu", "su", "nv", "sv"))
        yield b.select(["u", "v"]).filter(pa.array([can_link(*x) for x in zip(nu, su, nv, sv, strict=True)], pa.bool_()))


def _beside(small: DataFrame) -> DataFrame:
    """small, to be broadcast if its rows are few enough."""
    return F.broadcast(small) if small.count() <= BROADCAST_IDS else small


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (u, v) of class representatives whose whole sets link."""
    pairs = keep(pairs)
    right = keep(pairs.select(F.col("v").alias("rep")).distinct().join(classes.select("rep", "h1", "h2"), "rep"))
    left = keep(pairs.select(F.col("u").alias("rep")).distinct().join(classes.select("rep", "h1", "h2"), "rep"))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            found = sets(b.column(b.schema.get_field_index("text")).to_pylist())
            d = np.array([digest(s) for s in found], np.int64).reshape(-1, 2)
            same = (d[:, 0] == b.column(b.schema.get_field_index("h1")).to_numpy()) & (d[:, 1] == b.column(b.schema.get_field_index("h2")).to_numpy())
            ends = np.cumsum([0, *map(len, found)])
            flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            out = pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("id")), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))], names=["id", "s"])
            yield out.filter(pa.array(same))

    def sets_of(which: DataFrame) -> DataFrame:
        own = docs.join(_beside(which.withColumnRenamed("rep", "id")), "id").select("id", "h1", "h2", "text")
        return own.mapInArrow(tidy(shingled), "id long, s array<long>")

    # each right-hand set goes to its pair's left id once; left ids are few, and a hot one is split by the join
    few = _beside(pairs)
    moved = sets_of(right).withColumnRenamed("s", "sv").join(few, F.col("id") == F.col("v")).drop("id")
    both = moved.join(sets_of(left).withColumnsRenamed({"id": "u", "s": "su"}), "u")

    # row by row in the JVM: batches of such pairs would hold many whole sets at once
    common = F.size(F.array_intersect("su", "sv"))
    return keep(both.where(100 * common >= 80 * (F.size("su") + F.size("sv") - common)).select("u", "v").distinct())


def _far(n: np.ndarray, label: np.ndarray, one: np.ndarray, two: np.ndarray, at: int, bt: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows at, at + 1, ... with sketches `one` and later rows bt, bt + 1, ... with sketches `two`: what could link."""
    out = []
    step = max(1, (1 << 21) // (two.shape[1] * max(1, len(two))))
    for i in range(0, len(one), step):
        j = max(at + i + 1 - bt, 0)
        stop = int(np.searchsorted(n[bt : bt + len(two)], n[min(at + i + step, at + len(one)) - 1] * 5 // 4, side="right"))
        far = np.bitwise_count(one[i : i + step, None] ^ two[None, j:stop]).sum(2, dtype=np.int64)
        a, b = np.nonzero(far * 9 <= n[at + i : at + i + len(far), None] + n[None, bt + j : bt + stop])
        far, a, b = far[a, b], a + at + i, b + bt + j
        good = (a < b) & (label[a] != label[b]) & (10 * n[a] >= 8 * n[b])
        out.append((a[good], b[good], far[good]))
    return out


def _near(n: np.ndarray, label: np.ndarray, sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and Hamming distances of the pairs of two labels that could link; n is in order, so sketches grow in length."""
    size = np.array([len(x) for x in sketches])
    cuts = np.flatnonzero(np.concatenate([[True], size[1:] != size[:-1], [True]])).tolist()
    bits = [np.frombuffer(b"".join(sketches[a:b]), np.uint64).reshape(b - a, -1) for a, b in zip(cuts, cuts[1:], strict=False)]
    out = []
    for k, own in enumerate(bits):
        out += _far(n, label, own, own, cuts[k], cuts[k])
        if k + 1 < len(bits) and bits[k + 1].shape[1] == 2 * own.shape[1]:  # halves of a longer sketch put together
            out += _far(n, label, own, bits[k + 1][:, : own.shape[1]] ^ bits[k + 1][:, own.shape[1] :], cuts[k], cuts[k + 1])
    return tuple(np.concatenate([x[k] for x in out]) for k in range(3))


def _chosen(a: np.ndarray, b: np.ndarray, far: np.ndarray, label: np.ndarray, rep: np.ndarray, failed: set[tuple[int, int]], forest: bool) -> list[tuple[int, int]]:
    """The pairs as (smaller, larger) ids, without the failed; forest: nearest first, and only those that join two groups."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while x in above:
            if above[x] in above:
                above[x] = above[above[x]]
            x = above[x]
        return x

    out = []
    for k in np.argsort(far, kind="stable").tolist():
        u, v = sorted((int(rep[a[k]]), int(rep[b[k]])))
        if (u, v) in failed:
            continue
        if forest:
            x, y = root(int(label[a[k]])), root(int(label[b[k]]))
            if x == y:
                continue
            above[x] = y
        out.append((u, v))
    return out


def _apart(buckets: DataFrame, labels: DataFrame, classes: DataFrame, failed: DataFrame | None, forest: bool) -> DataFrame:
    """(u, v): pairs that share a large bucket, are not yet together, haven't failed, and pass the sketch test.

    forest: of each tile only the nearest ones that would join its groups.
    """
    b = buckets.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep")).select("bucket", "rep", "label").distinct()
    b = keep(b)
    # the label most likely to be a large group's is its smallest: its members needn't meet each other
    count = b.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    mixed = count.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum("n").alias("k"), F.min_by("n", "label").alias("km")).where("lo <> hi")
    b = b.join(_beside(keep(mixed.withColumn("kn", F.col("k") - F.col("km")))), "bucket").withColumn("main", F.col("label") == F.col("lo"))
    tiles = lambda c: F.ceil(F.col(c) / TILE).cast("long")
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("main"), tiles("km")).otherwise(tiles("kn")))
    b = b.withColumn("tm", tiles("km")).withColumn("tn", tiles("kn")).withColumn("own", own)
    # main tiles meet each other tile; other tiles meet main tiles and each other
    others = F.transform(F.sequence(F.lit(0), F.col("tn") - 1), lambda j: F.struct(F.lit("m").alias("k"), F.col("own").alias("i"), j.alias("j")))
    mains = F.transform(F.sequence(F.lit(0), F.col("tm") - 1), lambda i: F.struct(F.lit("m").alias("k"), i.alias("i"), F.col("own").alias("j")))
    among = F.transform(F.sequence(F.lit(0), F.col("tn") - 1), lambda j: F.struct(F.lit("n").alias("k"), F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    b = b.withColumn("tile", F.explode(F.when(F.col("main"), others).otherwise(F.concat(mains, among)))).select("bucket", "tile", "rep", "label")
    if failed is None:
        about = classes.select("rep", "n", "small", F.lit(None).cast("array<long>").alias("failed"))
    else:
        about = classes.select("rep", "n", "small").join(failed.groupBy(F.col("u").alias("rep")).agg(F.collect_list("v").alias("failed")), "rep", "left")
    # sketches come last, so that they travel once
    b = b.join(about, "rep")
    met = b.groupBy("bucket", "tile").agg(F.collect_list(F.struct("rep", "label", "n", "small", "failed")).alias("members"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(0)
            offsets, flat = members.offsets.to_numpy() - members.offsets[0].as_py(), members.flatten()
            n, rep, label = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("n", "rep", "label"))
            sketches, lost = flat.field("small").to_pylist(), flat.field("failed")
            lost = lost.to_pylist() if lost.null_count < len(lost) else None
            found: dict[tuple[int, int], None] = {}
            for k in range(batch.num_rows):
                at = offsets[k] + np.argsort(n[offsets[k] : offsets[k + 1]], kind="stable")
                a, b, far = _near(n[at], label[at], [sketches[i] for i in at])
                if len(a):
                    gone = {(int(rep[i]), y) for i in at for y in lost[i] or ()} if lost else set()
                    found.update(dict.fromkeys(_chosen(a, b, far, label[at], rep[at], gone, forest)))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return met.select("members").mapInArrow(tidy(test), "u long, v long").distinct()


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id of every row: the smallest key that links reach."""
    df = text_batches(docs).select(F.col(key).cast("long").alias("id"), blank_null(text).alias("text"))
    own = df.where("id is not null")
    parts = docs.count() // DOCS_A_PART + 1
    found = keep(own.mapInArrow(tidy(_map(parts)), _PACKED).groupBy("part").applyInArrow(tidy_group(_meet), _FOUND))
    nodes = found.where("kind = 0").select(F.col("a").alias("id"), "n", "h1", "h2", "sketch", "small")
    classes = keep(nodes.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.max("sketch").alias("sketch"), F.max("small").alias("small")))
    same = keep(nodes.where("n > 0").join(classes.drop("sketch", "small"), ["n", "h1", "h2"]).select("id", "rep").distinct())
    # only ids that have keys of their own come up in pairs and buckets
    reps = same.where("id <> rep")
    as_rep = lambda t, c: t.join(reps.select(F.col("id").alias(c), F.col("rep").alias("class_of")), c, "left").withColumn(c, F.coalesce("class_of", c)).drop("class_of")
    met = as_rep(as_rep(found.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "u"), "v")
    met = met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    with_sketch = lambda t, c, size: t.join(classes.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col(size).alias(f"s{c}")), c)
    tested = lambda t, size="sketch": with_sketch(with_sketch(t, "u", size), "v", size).mapInArrow(tidy(_sketch_test), "u long, v long")
    links = _verified(own, tested(keep(tested(met, "small"))), classes)
    buckets = keep(as_rep(found.where("kind = 2").select(F.col("a").alias("bucket"), F.col("b").alias("rep")), "rep").distinct())
    if not found.where("kind = 2").isEmpty():
        failed = labels = None
        for step, (forest, one_in) in enumerate(STEPS):
            if labels is None:
                labels = components(links.select(F.col("u").alias("a"), F.col("v").alias("b"))).select(F.col("id").alias("rep"), F.col("component").alias("label"))
            some = buckets.where(F.pmod(F.xxhash64("bucket", F.lit(step)), F.lit(one_in)) == 0) if one_in > 1 else buckets
            pairs = keep(_apart(some, labels, classes, failed, forest))
            if pairs.isEmpty():
                continue
            more = _verified(own, tested(pairs), classes)
            if not more.isEmpty():
                links, labels = keep(links.unionAll(more)), None
            lost = pairs.join(more, ["u", "v"], "left_anti")
            failed = keep(lost if failed is None else failed.unionAll(lost))
    edges = links.select(F.col("u").alias("a"), F.col("v").alias("b")).unionAll(reps.select(F.col("id").alias("a"), F.col("rep").alias("b")))
    smallest = components(edges)
    out = nodes.select("id", "n").join(smallest, "id", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in sets(b.column(0).to_pylist())], pa.int64())], names=["n_shingles"])

    lost = df.where("id is null").select("text").mapInArrow(tidy(sizes), "n_shingles long")
    none = F.lit(None).cast("long")
    return out.unionAll(lost.select(none.alias(key), "n_shingles", none.alias("component_id")))


def _named(docs: DataFrame, key: str, text: str) -> DataFrame | None:
    """If texts share keys: (_text_id, _text_key, _text_h1, _text_h2) of each text, ids in order of the keys."""
    t = blank_null(text)
    each = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_text_key"), F.xxhash64(t).alias("_text_h1"), F.xxhash64(F.lit(1), t).alias("_text_h2"))
    by_key = each.groupBy("_text_key").agg(F.min("_text_h1").alias("lo"), F.max("_text_h1").alias("hi"))
    if by_key.where("lo <> hi").isEmpty():
        return None
    order = ("_text_key", "_text_h1", "_text_h2")
    each = keep(each.distinct().repartitionByRange(*order).sortWithinPartitions(*order))
    return keep(each.select(F.monotonically_increasing_id().alias("_text_id"), *order))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, all columns: one row of each component, that of its smallest key; rows with a null key stay, and texts that share a key are apart."""
    names = _named(docs, key, text)
    if names is None:
        return _one_each(docs, key, text)
    t = F.coalesce(docs[text], F.lit(""))
    same = (docs[key].cast("long") == names["_text_key"]) & (F.xxhash64(t) == names["_text_h1"]) & (F.xxhash64(F.lit(1), t) == names["_text_h2"])
    numbered = docs.join(_beside(names), same, "left").select(*[docs[c] for c in docs.columns], "_text_id")
    return _one_each(numbered, "_text_id", text).drop("_text_id")


def _one_each(docs: DataFrame, key: str, text: str) -> DataFrame:
    found = keep(join(docs, key, text))
    gone = found.where(F.col("component_id") < F.col(key)).select(F.col(key).alias("_gone_key")).distinct()
    out = docs.join(_beside(keep(gone)), docs[key] == F.col("_gone_key"), "left_anti")
    twice = keep(found.where(F.col(key).isNotNull() & (F.col(key) == F.col("component_id"))).groupBy(F.col(key).alias("_twice_key")).count().where("count > 1").select("_twice_key"))
    if twice.isEmpty():
        return out
    again = out.join(_beside(twice), out[key] == F.col("_twice_key"), "left_semi").dropDuplicates([key])
    return out.join(_beside(twice), out[key] == F.col("_twice_key"), "left_anti").unionAll(again)
