"""SimHash near-duplicates by BK-trees over shards of fingerprints.

Two fingerprints within r bits are found inside shards that provably (blocks)
or almost surely (MinHash keys) hold every such pair together:

* ``link_blocks``: 64 bits in three blocks. Two fingerprints at most two bits
  apart agree on one of them, so the buckets of each block's values are shards,
  as many as give ``SHARD`` members on average. Shards above ``HOT`` members
  are dealt again by their block's whole value and three times a third of the
  bits that are left (of three parts two differing bits leave one alone), which
  leaves 13 bits open, so 2**13 members at most.
* ``near_groups``: a Jaccard similarity of 0.8 over five-word shingles is 15 %
  of the bits, too many for blocks, so shards are keyed by MinHash values (six,
  one of which such a pair shares with probability 0.9999). Hot shards are
  dealt by six further, independent values, which a pair misses as rarely, and
  salted; all pairs across salts meet later. Candidates are verified on the
  shingle sets in the shard's task, and only verified links join points there.

A shard's BK-tree keys children by their integer Hamming distance to the
parent and a search follows only edges within the radius. The tree is built in
the task that holds the shard. Trees are not broadcast: together they hold the
fingerprints of all documents, which have no size bound. A shard gives
spanning links, not pairs, so output is linear in its members.

Defined results: null and blank texts have the fingerprint zero, linked like
any other; equal texts and repeated rows share a fingerprint and a component;
null keys count as no row for a component's least key; keys may be of any type
that has an order; a key with several texts stands for each of them; an empty
table gives no rows; extra columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from loomspan.llm.common import BATCH_ROWS, content_key, cut, documents, map_batches, sized, whole_row
from loomspan.llm.graph import components

SEED = 42
#: Members of an average shard of blocks; members above which it is dealt again; points that a BK leaf holds.
SHARD, HOT_BLOCK, LEAF = 2_000, 10_000, 8
HOT = 2_000
FLUSH = 60_000


# ---- fingerprints -------------------------------------------------------


def shingle_digests(text: str | None, size: int, digest) -> bytes:
    """Digests of the lower-cased (A-Z) text's shingles, repeats included."""
    words = text.encode().lower().split() if text else []
    if not words:
        return b""
    whole = b" ".join(words)
    if len(words) <= size:
        return digest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -size] + 1])
    return b"".join([digest(whole[a:b], SEED) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist())])


class Majority:
    """Bit counts of many documents' digests, in bounded batches; least values of (digest word, multiplier) permutations."""

    def __init__(self, documents: int, width: int, multipliers=()):
        self.width, self.multipliers = width, multipliers
        self.counts = np.zeros((documents, 8 * width), np.int64)
        self.totals = np.zeros(documents, np.int64)
        self.least = np.full((documents, len(multipliers)), np.iinfo(np.uint64).max, np.uint64)
        self.parts, self.owners, self.held = [], [], 0

    def add(self, document: int, raw: bytes) -> None:
        step = FLUSH * self.width
        for at in range(0, len(raw), step):
            part = raw[at : at + step]
            self.parts.append(part)
            self.owners.append(document)
            self.held += len(part)
            if self.held >= step:
                self.flush()

    def flush(self) -> None:
        if not self.parts:
            return
        sizes = np.array([len(p) // self.width for p in self.parts])
        starts, owners = np.cumsum(sizes) - sizes, np.array(self.owners)
        raw = np.frombuffer(b"".join(self.parts), np.uint8).reshape(-1, self.width)
        np.add.at(self.totals, owners, sizes)
        np.add.at(self.counts, owners, np.add.reduceat(np.unpackbits(raw, axis=1), starts, axis=0, dtype=np.int64))
        if self.multipliers:
            words = np.ascontiguousarray(raw).view(">u8").astype(np.uint64)
            for k, (word, m) in enumerate(self.multipliers):
                mixed = words[:, word] * np.uint64(m)
                np.minimum.at(self.least[:, k], owners, np.minimum.reduceat(mixed ^ (mixed >> np.uint64(32)), starts))
        self.parts, self.owners, self.held = [], [], 0

    def fingerprints(self) -> np.ndarray:
        """Rows of ``width`` bytes: a bit is 1 if set in over half the digests."""
        self.flush()
        return np.packbits(2 * self.counts > self.totals[:, None], axis=1)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(key, fp) with the 64-bit fingerprint as a signed long."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            bits = Majority(batch.num_rows, 8)
            for i, value in enumerate(batch.column(1)):
                bits.add(i, shingle_digests(value.as_py(), size, xxhash.xxh64_digest))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.fingerprints().view(">i8").ravel().astype(np.int64))], names=["key", "fp"])

    kind = rows.schema["key"].dataType.simpleString()
    return map_batches(rows, run, f"key {kind}, fp long", BATCH_ROWS)


# ---- BK-trees -----------------------------------------------------------


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class BkTree:
    """A BK-tree over rows of 64-bit words; a subtree of ``leaf`` points or fewer is a list.

    ``compared`` counts the distances that searches computed.
    """

    def __init__(self, points: np.ndarray, members: np.ndarray | None = None, leaf: int = LEAF):
        self.points, self.compared = points, 0
        self.members = np.arange(len(points)) if members is None else members
        self.children: dict[int, BkTree] = {}
        if len(self.members) > leaf:
            far = hamming(points[self.members[1:]], points[self.members[0]])
            order = np.argsort(far, kind="stable")
            keys, first = np.unique(far[order], return_index=True)
            if int(keys[-1]) == 0:  # all points are one
                return
            groups = np.split(self.members[1:][order], first[1:])
            self.children = {int(k): BkTree(points, g, leaf) for k, g in zip(keys, groups)}
            self.members = self.members[:1]

    def search(self, queries: np.ndarray, radius: int, ids: np.ndarray | None = None):
        """Yield (query ids, member ids, distances) of all pairs within the radius."""
        ids = np.arange(len(queries)) if ids is None else ids
        if not len(ids):
            return
        step = max(1, 2_000_000 // max(1, len(self.members)))
        pivot = []
        for at in range(0, len(ids), step):
            some = ids[at : at + step]
            far = hamming(queries[some][:, None, :], self.points[self.members][None, :, :])
            self.compared += far.size
            q, m = np.nonzero(far <= radius)
            if len(q):
                yield some[q], self.members[m], far[q, m]
            if self.children:
                pivot.append(far[:, 0])
        if self.children:
            pivot = np.concatenate(pivot)
            for key, child in self.children.items():
                yield from child.search(queries, radius, ids[np.abs(pivot - key) <= radius])

    def comparisons(self) -> int:
        return self.compared + sum(child.comparisons() for child in self.children.values())


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = i = parent[parent[i]]
    return i


def spanning_links(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect whatever links within the radius connect: at most one less than the points."""
    parent, links = list(range(len(points))), []
    labels = np.arange(len(points))
    for a, b, _ in BkTree(points).search(points, radius):
        new = (a < b) & (labels[a] != labels[b])
        for x, y in zip(a[new].tolist(), b[new].tolist()):
            if (p := _root(parent, x)) != (q := _root(parent, y)):
                parent[max(p, q)] = min(p, q)
                links.append((x, y))
        if new.sum() > len(points) // 8:
            labels = np.array([_root(parent, i) for i in range(len(points))])
    return links


def by_shard(batches, columns: int, named: bool = False):
    """Groups of a key-sorted stream (key first, given only if ``named``) as lists of column arrays, of two rows or more."""
    held, first = None, 0 if named else 1
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            now = [np.concatenate([h, n]) for h, n in zip(held, now)]
        if not len(now[0]):
            continue
        cuts = np.flatnonzero(now[0][1:] != now[0][:-1]) + 1
        edges = np.concatenate([[0], cuts])
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a > 1:
                yield [c[a:b] for c in now[first:]]
        held = [c[edges[-1] :] for c in now]
    if held is not None and len(held[0]) > 1:
        yield held[first:]


# ---- links within two bits ----------------------------------------------


def _bits(value, at: int, width: int):
    return F.shiftrightunsigned(value, at).bitwiseAND((1 << width) - 1)


#: Three blocks of a fingerprint: first bit and width.
BLOCKS = ((0, 22), (22, 21), (43, 21))


def _spread(fp, bits: list[int]):
    mask = sum(1 << b for b in bits)
    return fp.bitwiseAND(mask - (1 << 64) if mask >> 63 else mask)


def _finer_keys(fp, fixed: list, left: list[int], depth: int = 3):
    """Keys of a whole block with a third of the bits left, and of these again, ``depth`` times."""
    if not depth:
        yield F.xxhash64(*fixed)
        return
    for part in range(3):
        third = left[part::3]
        yield from _finer_keys(fp, [*fixed, F.lit(part), _spread(fp, third)], [b for b in left if b not in third], depth - 1)


def link_blocks(distinct: DataFrame, radius: int = 2, hot: int = HOT_BLOCK, shard: int = SHARD) -> DataFrame:
    """(a, b) links that connect all distinct fingerprints ``fp`` (cut) within the radius (two at most)."""
    if radius > 2:
        raise ValueError("blocks hold pairs within two bits together; use near_groups")
    fp, buckets = F.col("fp"), max(1, distinct.count() // shard)
    coarse = F.array(*(F.struct(F.lit(k).alias("block"), F.pmod(F.xxhash64(_bits(fp, at, width)), F.lit(buckets)).alias("bucket")) for k, (at, width) in enumerate(BLOCKS)))
    keyed = distinct.select("fp", F.explode(coarse).alias("c")).select("fp", "c.block", F.xxhash64("c.block", "c.bucket").alias("key"))
    # cut, so that its count is at hand; a shard of SHARD members on average makes this table short
    large = cut(keyed.groupBy("key").count().filter(F.col("count") > hot).select("key"))
    dealt = keyed.select("key", "fp")
    if not large.isEmpty():
        few = sized(large, BROADCAST_KEYS)
        finer = F.lit(None).cast("array<long>")
        for k, (at, width) in enumerate(BLOCKS):
            open_bits = [b for b in range(64) if not at <= b < at + width]
            finer = F.when(F.col("block") == k, F.array(*_finer_keys(fp, [F.lit(k), _bits(fp, at, width)], open_bits))).otherwise(finer)
        dealt = keyed.join(few, "key", "left_anti").select("key", "fp").union(keyed.join(few, "key", "left_semi").select(F.explode(finer).alias("key"), "fp"))
    dealt = dealt.repartition("key").sortWithinPartitions("key", "fp")

    def run(batches):
        for (points,) in by_shard(batches, 1):
            words = points.astype(np.int64).view(np.uint64).reshape(-1, 1)
            if found := spanning_links(words, radius):
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(points[b]), pa.array(points[a])], names=["a", "b"])

    return map_batches(dealt, run, "a long, b long").distinct()


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, radius: int = 2) -> DataFrame:
    """(key, fp, component): the least key reachable over links of the radius."""
    marked = cut(fingerprints(docs, key, text, size))
    distinct = cut(marked.groupBy("fp").agg(F.min("key").alias("first")))
    roots = components(link_blocks(distinct.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    placed = cut(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = placed.groupBy("root").agg(F.min("first").alias("component"))
    names = cut(placed.select("fp", "root").join(least, "root").select("fp", "component"))
    return marked.join(names, "fp").select("key", "fp", "component")


def op6_simhash_groups(spark, sf_dir: str) -> DataFrame:
    out = simhash_components(documents(spark, sf_dir))
    return out.select(
        F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


# ---- near-duplicate texts -----------------------------------------------

NEAR_SHINGLE, NEAR_SIMILARITY = 5, 0.8
#: Bits of 128 within which a pair is verified: 0.8 gives 19 expected, so that few are missed.
NEAR_RADIUS = 34
#: Odd multipliers of the MinHash permutations (fixed values; any odd numbers serve), on the first word of
#: the digest for the shards and on the second for what hot shards are dealt by.
MULTIPLIERS = (
    0x9E3779B97F4A7C15,
    0xBF58476D1CE4E5B9,
    0x94D049BB133111EB,
    0xD6E8FEB86659FD93,
    0xA0761D6478BD642F,
    0xE7037ED1A0B428DB,
)
PERMUTATIONS = [(word, m) for word in range(2) for m in MULTIPLIERS]
#: Points that search a shard's tree at once; points of a leaf there, where the radius leaves little to prune.
BLOCK, NEAR_LEAF = 256, 64
#: Keys up to which a list of documents is broadcast to where the texts are.
BROADCAST_KEYS = 500_000


def _candidates(points: np.ndarray, radius: int, block: int = BLOCK):
    """Blocks of pairs (later, earlier, bits) within the radius; a block has all pairs of its later points."""
    tree = BkTree(points, leaf=NEAR_LEAF)
    for at in range(0, len(points), block):
        found = [(q[e], m[e], far[e]) for q, m, far in tree.search(points, radius, np.arange(at, min(len(points), at + block))) if (e := m < q).any()]
        if found:
            yield tuple(map(np.concatenate, zip(*found)))


def _words(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([a, b], axis=1).astype(np.int64).view(np.uint64)


def _met(batches, radius: int, block: int = BLOCK):
    """Rows (shard, key, a, b, component) of shard-sorted points that have a candidate of another component.

    A pair that shares the value of an earlier permutation is left to that
    one's shard, except in shards with ``all``.
    """
    for shard, n, key, a, b, least, whole, component in by_shard(batches, 8, True):
        met = np.zeros(len(key), bool)
        values = np.stack(least)[:, : n[0]]
        for q, m, _ in _candidates(_words(a, b), radius, block):
            own = component[q] != component[m]
            if not whole[0]:
                own &= ~(values[q] == values[m]).any(axis=1)
            met[q[own]] = met[m[own]] = True
        if met.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[met]) for c in (shard, key, a, b, component)], names=["shard", "key", "a", "b", "component"])


def verified_links(points: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, radius: int, similarity: float, block: int = BLOCK) -> list[tuple[int, int]]:
    """Links (later, earlier) of verified pairs that connect all such pairs of a shard.

    A pair is left out only where verified links, or equal labels at the
    start, join its ends; a pair that fails joins nothing.
    """
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark, labels, links = np.zeros(len(names), bool), np.unique(labels, return_inverse=True)[1], []

    def common(some: np.ndarray) -> np.ndarray:
        lengths = sizes[some]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[some] - (ends - lengths), lengths)
        total = np.concatenate([[0], np.cumsum(mark[ids[at]])])
        return total[ends] - total[ends - lengths]

    for q, m, far in _candidates(points, radius, block):
        apart = labels[q] != labels[m]
        q, m, far = q[apart], m[apart], far[apart]
        order = np.lexsort((m, far, q))
        q, m = q[order], m[order]
        for some in np.split(m, np.flatnonzero(q[1:] != q[:-1]) + 1) if len(q) else []:
            x = int(q[0])
            q = q[len(some) :]
            some, step = some[labels[some] != labels[x]], 1
            if not len(some):
                continue
            own = ids[starts[x] : starts[x] + sizes[x]]
            mark[own] = True
            while len(some):
                part, some = some[:step], some[step:]
                shared = common(part)
                for y in part[shared >= similarity * (sizes[x] + sizes[part] - shared)].tolist():
                    if labels[x] != labels[y]:
                        labels[labels == labels[y]] = labels[x]
                        links.append((x, y))
                some, step = some[labels[some] != labels[x]], min(4 * step, 1_024)
            mark[own] = False
    return links


def _shard_links(batches, radius: int, similarity: float, block: int = BLOCK):
    """Verified links (x later, y earlier) of shard-sorted rows (shard, key, a, b, shingles, component)."""
    for _, key, a, b, shingles, component in by_shard(batches, 6, True):
        found = verified_links(_words(a, b), [np.frombuffer(s, "<i8") for s in shingles], component, radius, similarity, block)
        if found:
            x, y = np.array(found).T
            yield pa.RecordBatch.from_arrays([pa.array(key[x]), pa.array(key[y])], names=["x", "y"])


def distinct(digests: bytes) -> bytes:
    """Each of the 16-byte digests once."""
    return np.unique(np.frombuffer(digests, "V16")).tobytes()


def content_of(text: str | None) -> str:
    return xxhash.xxh3_128_hexdigest(b" ".join((text or "").encode().lower().split()))


def signatures(docs: DataFrame, size: int = NEAR_SHINGLE) -> DataFrame:
    """key, content (hash of the words), 128-bit fingerprint of the distinct shingles (a, b) and two lists of MinHash values."""
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            bits = Majority(batch.num_rows, 16, PERMUTATIONS)
            content = []
            for i, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                bits.add(i, distinct(shingle_digests(text, size, xxhash.xxh3_128_digest)))
                content.append(content_of(text))
            prints = bits.fingerprints().view(">i8").astype(np.int64)
            least = np.where(bits.totals[:, None] > 0, bits.least, 0).astype(np.uint64).view(np.int64)
            n = len(MULTIPLIERS)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(part.ravel()), n).cast(pa.list_(pa.int64())) for part in (least[:, :n], least[:, n:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(content, pa.string()), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()), *lists],
                names=["key", "content", "a", "b", "least", "finer"],
            )

    return map_batches(docs, run, f"key {kind}, content string, a long, b long, least array<long>, finer array<long>", BATCH_ROWS)


def shingle_sets(ids: DataFrame, owners: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """id, shingles (sorted distinct hashes, packed) of the contents with these distinct ``ids`` (cut)."""
    named = ids.join(owners.select("id", "content", F.col("owner").alias("key")), "id")
    texts = docs.join(sized(cut(named), BROADCAST_KEYS), "key").select("id", "content", "text")

    def sets(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            own = [i for i, (c, t) in enumerate(zip(batch.column(1).to_pylist(), texts)) if content_of(t) == c]
            found = [np.unique(np.frombuffer(shingle_digests(texts[i], size, xxhash.xxh64_digest), "<i8")).tobytes() for i in own]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), pa.array(found, pa.binary())], names=["id", "shingles"])

    return cut(map_batches(texts, sets, "id long, shingles binary", BATCH_ROWS).dropDuplicates(["id"]))


def _across_salts(dealt: DataFrame, roots: DataFrame, hot: int) -> DataFrame:
    """The points of salted shards that are not one component yet, dealt so that all pairs between components meet.

    A shard's largest component is spread over salts, all other points go to each of them.
    """
    component = roots.select(F.col("node").alias("key"), "root")
    placed = cut(dealt.drop("salt").join(component, "key", "left").withColumn("component", F.coalesce("root", "key")).drop("root"))
    counts = placed.groupBy("shard", "component").agg(F.count("*").alias("points"))
    several = counts.groupBy("shard").agg(F.sum("points").alias("points"), F.max(F.struct("points", "component"))["component"].alias("most"), F.count("*").alias("kinds"))
    several = several.filter("kinds > 1").select("shard", "most", F.ceil(F.col("points") / hot).cast("long").alias("salts"))
    own, each = F.array(F.pmod(F.xxhash64("key", "shard"), F.col("salts"))), F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)
    rows = placed.join(sized(cut(several), BROADCAST_KEYS), "shard")
    return rows.withColumn("salt", F.explode(F.when(F.col("component") == F.col("most"), own).otherwise(each)))


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = NEAR_SHINGLE, similarity: float = NEAR_SIMILARITY, radius: int = NEAR_RADIUS, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(key, component) of all rows: the least key of texts linked by the similarity or equal words.

    Equal word sequences are one content under a number of its own. Contents
    meet in shards of equal MinHash values, those of hot shards in finer ones;
    a shard's BK-tree gives candidates within the radius. Contents that have
    one meet again with their shingle sets, and verified pairs link.
    """
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("key").isNotNull())
    marked = cut(signatures(texts, size))
    owners = cut(marked.groupBy("content").agg(F.min("key").alias("owner")).withColumn("id", F.monotonically_increasing_id()))
    one = marked.join(owners, "content").filter("key = owner").dropDuplicates(["id"])
    chosen = cut(one.select(F.col("id").alias("key"), "a", "b", "least", "finer"))
    # dealt once: the count, the cold and the hot shards, and what meets across salts all read these rows
    keyed = cut(chosen.select("key", "a", "b", "least", F.posexplode("least").alias("n", "value")).select(
        "key", "a", "b", "n", "least", F.xxhash64("n", "value").alias("shard")
    ))
    large = cut(keyed.groupBy("shard").count().filter(F.col("count") > hot).select("shard"))
    several = not large.isEmpty()
    cold, none = keyed, F.lit(0).cast("long")
    if several:
        few = sized(large, BROADCAST_KEYS)
        cold = keyed.join(few, "shard", "left_anti")
        finer = chosen.select(F.col("key").alias("_key"), "finer")
        parts = keyed.join(few, "shard", "left_semi").join(finer, F.col("key") == F.col("_key"))
        parts = parts.select("shard", "n", "key", "a", "b", "least", F.posexplode("finer").alias("m", "value"))
        parts = parts.withColumn("shard", F.xxhash64("shard", "m", "value"))
        # finer shards may be hot again (near-copies of one text), so they are salted, by their size
        sizes = parts.groupBy("shard").count().filter(F.col("count") > hot).select("shard", F.ceil(F.col("count") / hot).cast("long").alias("salts"))
        salted = parts.join(sized(cut(sizes), BROADCAST_KEYS), "shard", "left")
        salt = F.coalesce(F.pmod(F.xxhash64("key", "shard"), F.col("salts")), F.lit(0).cast("long")) + 1
        spread = salted.select("shard", salt.alias("salt"), "n", "key", "a", "b", "least", F.lit(True).alias("large"), "salts")
    dealt = cold.select("shard", none.alias("salt"), "n", "key", "a", "b", "least", F.lit(False).alias("large"))

    def linked(rows: DataFrame) -> DataFrame:
        """Verified links (x, y) between the components of each (shard, salt)."""
        rows = rows.select(F.xxhash64("shard", "salt").alias("shard"), "n", "key", "a", "b", "least", "large", "component")
        sorted_rows = rows.repartition("shard").sortWithinPartitions("shard", "key")
        met = cut(map_batches(sorted_rows, lambda batches: _met(batches, radius, block), "shard long, key long, a long, b long, component long"))
        held = shingle_sets(cut(met.select(F.col("key").alias("id")).distinct()), owners, texts, size)
        points = met.join(held, F.col("key") == F.col("id")).select("shard", "key", "a", "b", "shingles", "component")
        points = points.repartition("shard").sortWithinPartitions("shard", "key")
        return cut(map_batches(points, lambda batches: _shard_links(batches, radius, similarity, block), "x long, y long"))

    first = dealt.union(spread.drop("salts")) if several else dealt
    links = linked(first.withColumn("component", F.col("key")))
    roots = components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
    if several:
        links = links.union(linked(_across_salts(spread.filter("salts IS NOT NULL").drop("salts"), roots, hot)))
        roots = components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
    named = owners.join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    named = cut(named.select("content", "owner", "root"))
    least = named.groupBy("root").agg(F.min("owner").alias("component"))
    return marked.select("key", "content").join(named.join(least, "root").select("content", "component"), "content").select("key", "component")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near-duplicates stays, the one with the least key.

    Each row is judged by its key and its text, so unlike texts of one key, or
    without a key, do not share their fate. Rows without a key come after all
    others; of several texts with one key that are alike, one stays, and rows
    with the same key and text are one document.
    """
    rows = docs.select(whole_row(docs).alias("row"), content_key().alias("key"), "text")
    groups = near_groups(rows, "key")
    gone = sized(cut(groups.filter("key > component").select("key").distinct()), BROADCAST_KEYS)
    kept = rows.join(gone, "key", "left_anti")
    # without repeated rows no text needs to move
    twice = sized(cut(rows.groupBy("key").count().filter("count > 1").select("key")), BROADCAST_KEYS)
    if twice.isEmpty():
        return kept.select("row.*")
    return kept.join(twice, "key", "left_anti").unionByName(kept.join(twice, "key", "left_semi").dropDuplicates(["key"])).select("row.*")
