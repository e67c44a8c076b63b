"""Substring dedup on prefix-partitioned suffix trees of words.

A repeat is a window of ``DEPTH`` words whose sequence also starts in a
document with a smaller key. The suffixes of all documents form one tree; only
its nodes of word depth ``DEPTH`` matter, so suffixes are cut there and the
tree is built in groups by prefix:

1. Pruning. Of each window's five-word prefixes of its suffixes the one with
   the least hash is its anchor; equal windows have equal anchors. Below an
   anchor that one content alone has there is no repeat, so its windows go.
2. Prefixes of variable length. Tasks count their frequent prefixes of 5, 8 and
   11 words on the way. A prefix with more than ``group_rows`` suffixes, and
   more than ``group_share`` of all, is lengthened, to the whole 13 words at
   last, so that the group of suffixes below a prefix fits a task's memory.
   What no task finds frequent has less than ``frequent`` suffixes a chunk.
3. Combining. Each task first builds the tree of its own chunk of suffixes: of
   a node only the suffixes of its least key leave the task, all others are
   known to be covered. So a passage in a third of all documents gives a row a
   chunk, not a row a document.
4. Subtrees. Suffixes are dealt by prefix and sorted by the branches below it,
   which visits a subtree depth first. ``Subtree`` lays its nodes out level by
   level; a node at ``DEPTH`` with several keys is a repeat, and all its
   suffixes but those of the least key are covered. Neighbouring covered
   windows unite to maximal repeats.

Nodes are told apart by 128 bits of hash, not by the words: 76 bits are of all
13 words, so that windows of a large group, which share a prefix, are told
apart by them; the others are of the prefix and of the branches below it. Of
10^8 different windows with one prefix, two agree by chance with probability
7e-8; of 10^13 windows of any kind, with 1e-13. Documents with equal word sequences are one content: the
least key stands for it and the others are covered whole if they have a window.

Defined results: null, empty and blank texts have no words; rows with a null
key neither cover nor are covered; repeated rows are equal, so neither covers
the other; a key with several texts has each of them judged against smaller
keys; keys may be of any type that has an order; an empty table gives no rows;
extra columns do not matter; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from loomspan.llm.common import BATCH_ROWS, cut, documents, map_batches

DEPTH, PREFIX = 13, 5
#: Words of the longer prefixes.
LONGER = (8, 11)


@dataclass(frozen=True)
class Limits:
    """What decides how work is dealt, never what is found."""

    #: Words of a chunk that a task works on at once; rows of the subtrees it holds at once.
    chunk_words: int = 400_000
    tree_rows: int = 200_000
    #: Suffixes, and share of all suffixes, above which a prefix is lengthened; the list of such prefixes has 1 / share entries a length at most.
    group_rows: int = 10_000
    group_share: float = 1e-5
    #: Suffixes in a chunk from which a task reports a prefix.
    frequent: int = 24


# Odd multipliers of the rolling hashes (any odd numbers serve) and their inverses.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Powers:
    """Powers of the bases, grown as longer chunks come."""

    def __init__(self):
        self.up = [np.ones(1, np.uint64)] * 2
        self.down = [np.ones(1, np.uint64)] * 2

    def upto(self, n: int) -> None:
        if len(self.up[0]) < n:
            n = max(n, 1 << 14, 2 * len(self.up[0]))
            for k in range(2):
                for table, base in ((self.up, BASES[k]), (self.down, INVERSES[k])):
                    steps = np.full(n, base, np.uint64)
                    steps[0] = 1
                    table[k] = np.cumprod(steps, dtype=np.uint64)


POWERS = Powers()


def words_of(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


class Chunk:
    """The suffixes of several documents, cut at ``DEPTH`` words, and hashes of their prefixes."""

    def __init__(self):
        self.parts, self.sizes, self.n = [], [], 0

    def add(self, words: list[bytes]) -> None:
        self.parts.append(b"".join([xxhash.xxh64_digest(w) for w in words]))
        self.sizes.append(len(words))
        self.n += len(words)

    def close(self) -> "Chunk":
        """Compute ``place`` (of every window in the chunk), ``doc`` and ``at`` (its document and word)."""
        sizes = np.array(self.sizes, np.int64)
        starts = np.cumsum(sizes) - sizes
        POWERS.upto(self.n + 1)
        word = np.frombuffer(b"".join(self.parts), "<u8")
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * POWERS.up[k][: self.n], dtype=np.uint64)]) for k in range(2)]
        windows = np.maximum(sizes - (DEPTH - 1), 0)
        self.doc = np.repeat(np.arange(len(sizes)), windows)
        first = np.cumsum(windows) - windows
        self.at = np.arange(len(self.doc)) - np.repeat(first, windows)
        self.place = self.at + np.repeat(starts, windows)
        self.first, self.windows = first, windows
        return self

    def prefix(self, size: int, k: int = 0, place: np.ndarray | None = None) -> np.ndarray:
        """Hash of the first ``size`` words of the windows."""
        place = self.place if place is None else place
        return mix((self.sums[k][place + size] - self.sums[k][place]) * POWERS.down[k][place]).view(np.int64)

    def anchors(self) -> np.ndarray:
        """The least hash among the five-word sequences of each window."""
        if not len(self.place):
            return self.place
        five = self.prefix(PREFIX, place=np.arange(self.n - PREFIX + 1)).view(np.uint64)
        least, span, width = five, 1, DEPTH - PREFIX + 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        return least[self.place].view(np.int64)


def chunks(batches, limits: Limits):
    """(batches of a chunk, their texts' words, the closed chunk) of batches whose second column is the text."""
    held, words, chunk = [], [], Chunk()
    for batch in batches:
        own = [words_of(v.as_py()) for v in batch.column(1)]
        for w in own:
            chunk.add(w)
        held.append(batch)
        words += own
        if chunk.n >= limits.chunk_words:
            yield pa.Table.from_batches(held).combine_chunks(), words, chunk.close()
            held, words, chunk = [], [], Chunk()
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), words, chunk.close()


def _content(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _changes(*columns) -> np.ndarray:
    """Where a sorted row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """``values`` as one list for each of ``n`` owners."""
    order = np.argsort(owner, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[order]))


def _anchor_lists(chunk: Chunk, content: np.ndarray):
    """(known, asked) anchors of each document: those that two contents of the chunk share, and those to be asked about.

    Known ones are bits over the document's sorted distinct anchors. Of a known
    anchor two contents ask, so that other chunks learn of it; of any other
    each content asks once.
    """
    anchor, doc, n = chunk.anchors(), chunk.doc, len(content)
    if not len(doc):
        return pa.array([b""] * n, pa.binary()), _lists(doc, anchor, n)
    keep = _changes(anchor, doc)
    anchor, doc = anchor[keep], doc[keep]
    rank = np.unique(content, return_inverse=True)[1][doc]
    order = np.lexsort((doc, rank, anchor))
    anchor, doc, rank = anchor[order], doc[order], rank[order]
    keep = _changes(anchor, doc)
    anchor, doc, rank = anchor[keep], doc[keep], rank[keep]
    run, kind = _changes(anchor), _changes(anchor, rank)
    group = np.cumsum(run) - 1
    count = np.cumsum(kind)
    ordinal = count - count[np.flatnonzero(run)][group]
    shared = np.maximum.reduceat(ordinal, np.flatnonzero(run))[group] > 0
    asks = kind & (ordinal < 2)
    edges = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])
    bits = shared[np.argsort(doc, kind="stable")]  # by document, and sorted by anchor there
    known = [np.packbits(bits[a:b]).tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
    return pa.array(known, pa.binary()), _lists(doc[asks], anchor[asks], n)


def _chosen(anchor: np.ndarray, known: bytes, shared: np.ndarray) -> np.ndarray:
    """Windows of a document whose anchor is known or shared."""
    names, back = np.unique(anchor, return_inverse=True)
    good = np.unpackbits(np.frombuffer(known, np.uint8), count=len(names)).astype(bool)
    return np.flatnonzero((good | among(names, np.sort(shared)))[back])


def _frequent(chunk: Chunk, least: int):
    """(length, prefix, count) of the chunk's frequent prefixes; longer ones only below frequent ones."""
    place = chunk.place
    for size in (PREFIX, *LONGER):
        if len(place) < least:
            return
        own = chunk.prefix(size, place=place)
        names, back, counts = np.unique(own, return_inverse=True, return_counts=True)
        often = counts >= least
        yield size, names[often], counts[often]
        place = place[often[back]]


SURVEYED = "content long, n_words long, sha binary, known binary, asked array<long>, length int, prefix long, suffixes long"


def survey(docs: DataFrame, limits: Limits) -> DataFrame:
    """Two kinds of rows: documents (key, content, n_words, sha, known and asked anchors), and frequent prefixes (length, prefix, suffixes)."""
    kind = docs.schema["key"].dataType.simpleString()
    names = ["key", *(c.split()[0] for c in SURVEYED.split(", "))]

    def run(batches):
        for table, words, chunk in chunks(batches, limits):
            digests = [hashlib.sha256(b" ".join(w)) for w in words]
            content = np.array([_content(d.digest()) for d in digests], np.int64)
            known, asked = _anchor_lists(chunk, content)
            key = table.column(0).combine_chunks() if table.column(0).num_chunks != 1 else table.column(0).chunk(0)
            n = len(words)
            own = [key, pa.array(content), pa.array(chunk.sizes, pa.int64()), pa.array([d.digest() for d in digests], pa.binary()), known, asked]
            yield pa.RecordBatch.from_arrays([*own, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)
            for size, prefix, counts in _frequent(chunk, limits.frequent):
                m = len(prefix)
                none = [pa.nulls(m, a.type) for a in own]
                yield pa.RecordBatch.from_arrays([*none, pa.array(np.full(m, size, np.int32)), pa.array(prefix), pa.array(counts.astype(np.int64))], names=names)

    return map_batches(docs, run, f"key {kind}, {SURVEYED}", BATCH_ROWS)


def long_prefixes(marked: DataFrame, limits: Limits) -> dict[int, np.ndarray]:
    """Prefixes with too many suffixes for a group, by length: at most ``1 / group_share`` a length."""
    total = marked.agg(F.sum("n_words")).first()[0] or 0
    counts = marked.filter("length is not null").groupBy("length", "prefix").agg(F.sum("suffixes").alias("n"))
    found = counts.filter(F.col("n") > max(limits.group_rows, limits.group_share * total)).select("length", "prefix").collect()
    return {size: np.sort(np.array([r["prefix"] for r in found if r["length"] == size], np.int64)) for size in (PREFIX, *LONGER)}


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether values are in a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _shared(batches):
    """Of a stream sorted by (anchor, content): distinct rows of anchors with two contents."""
    last, linked = None, False
    for batch in batches:
        a, c = (col.to_numpy() for col in batch.columns)
        if last is not None:
            a, c = np.concatenate([[last[0]], a]), np.concatenate([[last[1]], c])
        if not len(a):
            continue
        new = _changes(a, c)
        a, c = a[new], c[new]
        same = a[1:] == a[:-1]
        before = np.concatenate([[linked], same])
        good = before[:-1] | same
        last, linked = (a[-1], c[-1]), bool(before[-1])
        if good.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[:-1][good]), pa.array(a[:-1][good])], names=["content", "anchor"])
    if linked:
        yield pa.RecordBatch.from_arrays([pa.array([last[1]]), pa.array([last[0]])], names=["content", "anchor"])


#: Bits of a head for its group's prefix, and for the turn at each longer prefix; the rest are of all words.
GROUP, TURN = 32, 10
REST = 64 - GROUP - TURN * len(LONGER)


def _branches(chunk: Chunk, place: np.ndarray, longer: dict[int, np.ndarray]):
    """(head, tail) of suffixes.

    A head is the prefix of the length that its group needs, the turns taken
    below five words, and some bits of a hash of all words; a tail is 64 bits
    of another hash of all words. So windows that share whatever prefix are
    told apart by ``REST`` + 64 bits of all that they hold.
    """
    five, whole, tail = chunk.prefix(PREFIX, place=place), chunk.prefix(DEPTH, 0, place), chunk.prefix(DEPTH, 1, place)
    prefix, turns, open_ = five, np.zeros(len(place), np.uint64), among(five, longer[PREFIX])
    for size in LONGER:
        own = chunk.prefix(size, place=place)
        turns = turns << np.uint64(TURN) | own.view(np.uint64) >> np.uint64(64 - TURN)
        prefix = np.where(open_, own, prefix)
        open_ = open_ & among(own, longer[size])
    prefix = np.where(open_, whole, prefix).view(np.uint64)
    head = prefix >> np.uint64(64 - GROUP) << np.uint64(64 - GROUP) | turns << np.uint64(REST) | whole.view(np.uint64) >> np.uint64(64 - REST)
    return head.view(np.int64), tail


def branch_at(level: int, head: np.ndarray, tail: np.ndarray) -> list[np.ndarray]:
    """What nodes of a level are told apart by: 0 the group's prefix, then each longer prefix, at last all words."""
    return [head, tail] if level > len(LONGER) else [head.view(np.uint64) >> np.uint64(64 - GROUP - TURN * level)]


#: Mark of a window that its document repeats.
REPEATED = 1 << 31


def run_of(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A run of windows as one number; a single window's own number is its word."""
    return (last + 1) << 32 | first


def windows_of(spans: np.ndarray, words: list[bytes]):
    """(first, last) of the runs of covered windows, with all places of the repeated ones."""
    first, last = spans & (REPEATED - 1), (spans >> 32) - 1
    last = np.where(last < 0, first, last)
    marked = first[spans & REPEATED > 0]
    if len(marked):
        chunk = Chunk()
        chunk.add(words)
        names = chunk.close().prefix(PREFIX).view(np.uint64) + mix(chunk.prefix(DEPTH, 1).view(np.uint64))
        others = np.flatnonzero(np.isin(names, names[marked]))
        first, last = np.append(first, others), np.append(last, others)
    return first, last


def suffixes(candidates: DataFrame, longer, limits: Limits) -> DataFrame:
    """head, tail, key, part, span of the suffixes to be judged.

    ``span`` is the suffix's word, with a mark if the document repeats the
    window (then its other places share the fate of the first), or ``run_of``
    the first and the last one of a run of windows that the chunk's own tree
    covers; such a run has no branch and any task may hold it.
    """
    kind = candidates.schema["key"].dataType.simpleString()
    schema = f"head long, tail long, key {kind}, part long, span long"

    def run(batches):
        task = TaskContext.get().partitionId()
        for table, _, chunk in chunks(batches, limits):
            key, part, known, shared = (table.column(c).combine_chunks() for c in ("key", "part", "known", "shared"))
            anchor, chosen = chunk.anchors(), []
            for i, (a, n) in enumerate(zip(chunk.first.tolist(), chunk.windows.tolist())):
                if n:
                    asked = shared[i].values.to_numpy() if shared[i].is_valid else anchor[:0]
                    chosen.append(a + _chosen(anchor[a : a + n], known[i].as_py(), asked))
            at = np.concatenate(chosen) if chosen else np.empty(0, np.int64)
            if not len(at):
                continue
            doc, word = chunk.doc[at], chunk.at[at]
            head, tail = _branches(chunk, chunk.place[at], longer.value)
            names = np.unique(key.to_numpy(zero_copy_only=False), return_inverse=True)[1][doc]
            order = np.lexsort((names, tail, head))
            new = _changes(head[order], tail[order])
            least = names[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            late = np.zeros(len(at), bool)
            late[order[names[order] > least]] = True
            again = np.append(~_changes(head[order], tail[order], doc[order]), False)
            repeated, marked = np.zeros(len(at), bool), np.zeros(len(at), bool)
            repeated[order], marked[order] = again[:-1], again[1:]

            def rows(which, span, head, tail):
                owner = pa.array(doc[which])
                return pa.RecordBatch.from_arrays([pa.array(head), pa.array(tail), key.take(owner), part.take(owner), pa.array(span)], names=["head", "tail", "key", "part", "span"])

            kept, gone = np.flatnonzero(~late & ~repeated), np.flatnonzero(late)
            yield rows(kept, word[kept] | np.where(marked[kept], REPEATED, 0), head[kept], tail[kept])
            if len(gone):
                starts = _changes(doc[gone], word[gone] - np.arange(len(gone)))
                ends = np.concatenate([np.flatnonzero(starts)[1:], [len(gone)]]) - 1
                some = gone[starts]
                spread = mix(doc[some].astype(np.uint64) + np.uint64(task << 32 | 1)).view(np.int64)
                yield rows(some, run_of(word[some], word[gone[ends]]), spread, np.zeros(len(some), np.int64))

    return map_batches(candidates.select("key", "text", "part", "known", "shared"), run, schema, BATCH_ROWS)


class Subtree:
    """Nodes of sorted suffixes, level by level: below their prefix, at each longer prefix, and at ``DEPTH``.

    ``starts[level]`` are the first suffixes of the level's nodes, and
    ``parents[level]`` their parents' numbers in the level above.
    """

    def __init__(self, head, tail):
        self.starts, self.parents, self.size = [], [], len(head)
        for level in range(len(LONGER) + 2):
            new = _changes(*branch_at(level, head, tail))
            if self.starts:
                above = np.cumsum(self._marks(self.starts[-1], self.size)) - 1
                self.parents.append(above[np.flatnonzero(new)])
            self.starts.append(np.flatnonzero(new))

    @staticmethod
    def _marks(starts, n) -> np.ndarray:
        marks = np.zeros(n, np.int64)
        marks[starts] = 1
        return marks

    def deep_nodes(self) -> np.ndarray:
        """The number of each suffix's node at ``DEPTH``."""
        return np.cumsum(self._marks(self.starts[-1], self.size)) - 1

    def covered(self, key: np.ndarray) -> np.ndarray:
        """Suffixes of a deep node with several keys, but for those of its least key, which is the first."""
        return key > key[self.starts[-1]][self.deep_nodes()]


def covered(batches, rows: int):
    """(key, part, span) of the covered windows in a stream sorted by (head, tail, key).

    Subtrees are built in groups of about ``rows`` rows that end with a prefix;
    a larger one is cut at a longer prefix. A single node with more rows goes on
    with its least key.
    """
    names = ["key", "part", "span"]

    def judge(head, tail, key, part, span):
        late = span >> 32 > 0
        if not late.all():
            open_ = np.flatnonzero(~late)
            late[open_[Subtree(head[open_], tail[open_]).covered(key[open_])]] = True
        return pa.RecordBatch.from_arrays([pa.array(c[late]) for c in (key, part, span)], names=names)

    held, n = [], 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        n += batch.num_rows
        if n < rows:
            continue
        columns = [np.concatenate(c) for c in zip(*held)]
        for level in range(len(LONGER) + 2):
            ends = np.flatnonzero(_changes(*branch_at(level, *columns[:2])))
            if ends[-1]:
                yield judge(*(c[: ends[-1]] for c in columns))
                held = [[c[ends[-1] :] for c in columns]]
                break
        else:
            yield judge(*columns)
            held = [[c[:1] for c in columns]]
        n = len(held[0][0])
    if n:
        yield judge(*(np.concatenate(c) for c in zip(*held)))


def covered_windows(candidates: DataFrame, longer, limits: Limits) -> DataFrame:
    """(key, part, spans) of the windows that also start under a smaller key."""
    kind = candidates.schema["key"].dataType.simpleString()
    group = F.shiftrightunsigned("head", 64 - GROUP)
    dealt = suffixes(candidates, longer, limits).repartition(group).sortWithinPartitions("head", "tail", "key")
    found = map_batches(dealt, lambda batches: covered(batches, limits.tree_rows), f"key {kind}, part long, span long")
    return found.groupBy("key", "part").agg(F.collect_list("span").alias("spans"))  # at most a document's windows


def _mask(words: list[bytes], spans: np.ndarray) -> np.ndarray:
    n, (at, upto) = len(words), windows_of(spans, words)
    step = np.zeros(n + DEPTH + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, upto + DEPTH, -1)
    return np.cumsum(step)[:n] > 0


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False, limits: Limits = Limits()) -> DataFrame:
    """key, n_words, n_removed, kept_sha256, and (on wish) the kept words."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    marked = cut(survey(rows, limits))
    longer = docs.sparkSession.sparkContext.broadcast(long_prefixes(marked, limits))  # its bound: long_prefixes
    meta = marked.filter("length is null").drop("length", "prefix", "suffixes")
    keyed = meta.filter(F.col("key").isNotNull())
    pairs = keyed.select(F.explode("asked").alias("anchor"), "content")
    shared = map_batches(pairs.repartition("anchor").sortWithinPartitions("anchor", "content"), _shared, "content long, anchor long")
    shared = shared.groupBy("content").agg(F.collect_list("anchor").alias("shared"))  # at most a document's anchors
    owners = cut(keyed.groupBy("sha").agg(F.min("key").alias("least"), F.first("content").alias("content"), F.first("known").alias("known")))
    some = F.regexp_like(F.hex("known"), F.lit("[1-9A-F]"))
    chosen = owners.join(shared, "content", "left").filter(some | F.col("shared").isNotNull())
    chosen = chosen.select(F.col("least").alias("key"), "content", "known", "shared")
    texts = rows.filter(F.col("key").isNotNull())
    several = keyed.groupBy("key").agg(F.min("content").alias("a"), F.max("content").alias("b")).filter("a <> b")
    if several.isEmpty():
        texts, chosen = texts.withColumn("part", F.lit(0).cast("long")), chosen.withColumn("part", F.lit(0).cast("long"))
    else:  # a key with several contents has its texts told apart by the content
        texts, chosen = _with_content(texts).withColumnRenamed("content", "part"), chosen.withColumnRenamed("content", "part")
    candidates = texts.join(chosen.select("key", "part", "known", "shared"), ["key", "part"])
    spans = covered_windows(candidates, longer, limits)

    def run(batches):
        for batch in batches:
            whole, removed, sha, kept = [], [], [], []
            for value, spans in zip(batch.column(0), batch.column(1)):
                words = words_of(value.as_py())
                whole.append(hashlib.sha256(b" ".join(words)).digest())
                mask = _mask(words, spans.values.to_numpy())
                left = b" ".join([w for w, gone in zip(words, mask.tolist()) if not gone])
                removed.append(int(mask.sum()))
                sha.append(hashlib.sha256(left).digest())
                kept.append(left.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([pa.array(whole, pa.binary()), pa.array(removed, pa.int64()), pa.array(sha, pa.binary()), pa.array(kept, pa.string())], names=["sha", "n", "left", "kept"])

    changed = texts.join(spans, ["key", "part"]).select("text", "spans")
    changed = map_batches(changed, run, "sha binary, n long, left binary, kept string", BATCH_ROWS).dropDuplicates(["sha"])  # repeated rows
    fate = owners.select("sha", "least").join(changed, "sha", "left")
    out = meta.select("key", "sha", "n_words").join(fate, "sha", "left")
    own = F.coalesce(F.col("key") == F.col("least"), F.lit(False))
    copy = F.coalesce((F.col("key") > F.col("least")) & (F.col("n_words") >= DEPTH), F.lit(False))
    return out.select(
        F.col("key").alias(key),
        "n_words",
        F.when(copy, F.col("n_words")).when(own, F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex(F.when(own, F.coalesce("left", "sha")).otherwise(F.col("sha"))))).alias("kept_sha256"),
        *([F.when(copy, F.lit("")).when(own, F.col("kept")).alias("kept_text")] if with_text else []),
    )


def _with_content(rows: DataFrame) -> DataFrame:
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            content = [_content(hashlib.sha256(b" ".join(words_of(v.as_py()))).digest()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(content, pa.int64())], names=["key", "text", "content"])

    return map_batches(rows, run, f"key {kind}, text string, content long", BATCH_ROWS)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


OP5_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)),
low AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
cov AS (
  SELECT DISTINCT win.doc_id, win.i + k AS p
  FROM win JOIN low ON low.s = win.s AND win.doc_id > low.least, (SELECT unnest(range(0, 13)) AS k)),
pos AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
agg AS (
  SELECT pos.doc_id, count(cov.p)::BIGINT AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY pos.p) FILTER (cov.p IS NULL), '') AS kept
  FROM pos LEFT JOIN cov ON cov.doc_id = pos.doc_id AND cov.p = pos.p GROUP BY pos.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN agg ON agg.doc_id = w.doc_id
"""
