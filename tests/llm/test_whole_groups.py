"""Near-duplicate groups against all pairs: stars, repeated passages, hot shards."""

import itertools
import random

import numpy as np
import pytest

from loomspan.llm import simhash


def table(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def star(seed, copies, words=300, changed=6, middle=True):
    """Copies near a base (0.8 or more), mostly not near one another; the base stands in the middle or at the end."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    made = []
    for _ in range(copies):
        copy = list(base)
        for at in rng.sample(range(5, words - 5), changed):
            copy[at] = f"v{rng.randrange(10**6)}"
        made.append(" ".join(copy))
    made.insert(copies // 2 if middle else copies, " ".join(base))
    return made


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def like(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def brute(texts, radius=None, prints=None):
    """Least member of each text's group over all pairs, or over those within the radius."""
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if like(sets[i], sets[j]) and (radius is None or simhash.hamming(prints[i], prints[j]) <= radius):
            p, q = root(i), root(j)
            parent[max(p, q)] = min(p, q)
    return [root(i) for i in range(len(texts))]


def points_of(texts):
    bits = simhash.Majority(len(texts), 16)
    for i, t in enumerate(texts):
        bits.add(i, simhash.shingle_digests(t, 5, simhash.xxhash.xxh3_128_digest))
    return bits.fingerprints().view(">u8").astype(np.uint64)


@pytest.mark.parametrize("copies", [99, 600])
def test_failed_candidates_join_nothing(copies):
    texts = star(1, copies)
    points = points_of(texts)
    sets = [np.unique(np.frombuffer(simhash.shingle_digests(t, 5, simhash.xxhash.xxh64_digest), "<i8")) for t in texts]
    links = simhash.verified_links(points, sets, np.arange(len(texts)), simhash.NEAR_RADIUS, 0.8)
    known = [shingles(t) for t in texts]
    assert all(like(known[x], known[y]) for x, y in links)
    parent = list(range(len(texts)))
    for x, y in links:
        p, q = simhash._root(parent, x), simhash._root(parent, y)
        parent[max(p, q)] = min(p, q)
    assert [simhash._root(parent, i) for i in range(len(texts))] == brute(texts, simhash.NEAR_RADIUS, points)


def test_star_groups(spark):
    texts = star(2, 60)
    rows = sorted(simhash.near_groups(table(spark, texts)).collect())
    assert [r.component for r in rows] == brute(texts, simhash.NEAR_RADIUS, points_of(texts))


@pytest.mark.parametrize("middle", [True, False])
def test_salted_star(spark, middle):
    """With two members as the bound every shard is hot, and the base is in one salt of 32."""
    texts = star(3, 60, middle=middle)
    rows = sorted(simhash.near_groups(table(spark, texts), hot=2).collect())
    assert [r.component for r in rows] == brute(texts, simhash.NEAR_RADIUS, points_of(texts))


def test_shards_across_batches():
    """A shard that straddles batches is one shard."""
    import pyarrow as pa

    rows = [(1, 1), (2, 2), (2, 3), (2, 4), (3, 5)]
    batches = [pa.RecordBatch.from_pylist([{"s": s, "k": k}]) for s, k in rows]
    assert [k.tolist() for (k,) in simhash.by_shard(batches, 1)] == [[2, 3, 4]]


def test_repeated_passages(spark):
    """Texts that differ in how often a passage occurs are near by their sets, so their prints must be too."""
    texts, rng = [], random.Random(5)
    for _ in range(12):
        head = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))
        line = " ".join(f"r{rng.randrange(10**6)}" for _ in range(20))
        texts += [f"{head} {line}", f"{head} " + " ".join([line] * 8)]
    rows = sorted(simhash.near_groups(table(spark, texts)).collect())
    assert [r.component for r in rows] == brute(texts) == [i // 2 * 2 for i in range(len(texts))]


def dense(seed, families=6, members=50, words=200):
    """Texts around similarity 0.8: a member differs from an earlier one of its family in a few words."""
    rng, made = random.Random(seed), []
    for _ in range(families):
        family = [[f"w{rng.randrange(4000)}" for _ in range(words)]]
        while len(family) < members:
            copy = list(rng.choice(family))
            for at in rng.sample(range(words), rng.randint(2, 5)):
                copy[at] = f"v{rng.randrange(10**6)}"
            family.append(copy)
        made += [" ".join(f) for f in family]
    rng.shuffle(made)
    return made


@pytest.mark.parametrize("hot,block", [(2, 256), (2000, 256), (2000, 7)])
def test_recall_of_dense_texts(spark, hot, block):
    """Of all pairs of 0.8 or more at least 99 % are together, whatever a hot shard is and however trees are searched."""
    texts = dense(9)
    sets = [shingles(t) for t in texts]
    rows = sorted(simhash.near_groups(table(spark, texts), hot=hot, block=block).collect())
    found = [r.component for r in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if like(sets[i], sets[j])]
    kept = sum(found[i] == found[j] for i, j in links)
    assert kept >= 0.99 * len(links) and found == brute(texts)


def generated(spark, what):
    """Rows that ``Generate`` nodes with ``what`` in their description made, by execution."""
    store, found = spark._jsparkSession.sharedState().statusStore(), {}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList()
    for run in (runs.apply(i).executionId() for i in range(runs.size())):
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if node.name() == "Generate" and what in node.desc():
                metrics = node.metrics()
                ids = [m.accumulatorId() for m in (metrics.apply(i) for i in range(metrics.size())) if m.name() == "number of output rows"]
                found[run] = found.get(run, 0) + sum(int(values.apply(i).replace(",", "")) for i in ids if values.contains(i))
    return found


@pytest.mark.parametrize("hot", [2, 2000])
def test_shards_are_dealt_once(spark, hot):
    """Hot shards do not make the rows of all shards again."""
    texts = star(4, 40)
    before = generated(spark, "posexplode(least")
    simhash.near_groups(table(spark, texts), hot=hot).collect()
    after = generated(spark, "posexplode(least")
    assert sum(after.values()) - sum(before.values()) == len(simhash.MULTIPLIERS) * len(texts)
