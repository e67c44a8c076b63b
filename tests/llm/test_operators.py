"""Operators against brute force, round trips and fixtures."""

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from loomspan.llm import bpe, chat, decontam, graph, hilbert, pii, quality, secret_scan, simhash, substring_dedup, token_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.lists(st.sampled_from(list("abAB1 \n\t'.é<|>　\x1c!?&ß漢") + ["'s", "<|endoftext|>", " the ", "  "]), max_size=30).map("".join)


def table(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def groups(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return [root(i) for i in range(n)]


def near_texts(seed=3, bases=6, copies=5, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    made = []
    for _ in range(bases):
        base = [rng.choice(words) for _ in range(n)]
        made.append(" ".join(base))
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(n)] = rng.choice(words)
            made.append(" ".join(copy))
    return made + [None, "", "a", made[0], made[0]]


# ---- quality ----


def test_quality_counts(spark):
    texts = [None, "", "a b c a b c", "x\ny\nx\n \nz", "# a | b <c> $", "a b c d a b", "the of " * 40]
    for row, text in zip(sorted(quality.judge(table(spark, texts)).collect(), key=lambda r: r.doc_id), texts):
        words = WORD.findall(text or "")
        tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        assert (row.n_words, row.word_chars, row.n_repeat_words, row.n_dup_lines) == (len(words), sum(map(len, words)), len(covered), len(lines) - len(set(lines)))
        assert row.base_failed == (len(words) < 50 or 2 * len(covered) > len(words))


def test_quality_filter_stays_above(spark):
    plan = quality.judge(table(spark, ["a"])).filter("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Filter") and len(plan) < 60_000


# ---- personal data ----


def brute_pii(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        found += [(m.start(), 1, m.end())] if all(int(p) <= 255 for p in m[0].split(".")) else []
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        found += [(m.start(), 2, m.end())] if 14 <= len(digits) <= 19 and pii.luhn(digits) else []
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        found += [(m.start(), 3, m.end())] if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15 else []
    return sorted(found)


@pytest.mark.parametrize("letters", ["a@.-b1 ", "12.5 +", "0123456789 -", "+12 ()-.3", "a@b.c+1 _%2é"])
def test_pii_matchers(letters):
    rng = random.Random(letters)
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 45)))
        assert pii.base_spans(text) == brute_pii(text)


def test_pii_bootstrap(spark):
    seeds = [f"call the number: +1 555 000 {1000 + i} now" for i in range(6)]
    unseen = [f"call the number: 55500{1000 + i} now" for i in range(3)]
    other = [f"order no {100000 + i} shipped" for i in range(9)]
    rows = {r.key: r for r in pii.find(table(spark, seeds + unseen + other)).collect()}
    assert all(len(rows[i].added) == 1 and rows[i].added[0].kind_no == 3 for i in range(6, 9))
    assert not any(rows[i].added for i in [*range(6), *range(9, 18)])
    hidden = {r.doc_id: r.text for r in pii.masked(table(spark, seeds + unseen + other)).collect()}
    assert hidden[0] == hidden[6] == "call the number: [PHONE] now" and hidden[9] == other[0]


# ---- secrets ----


def brute_secrets(text):
    found = []
    rules = (
        (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        (r"AKIA[A-Z0-9]+", 0, 20),
        (r"[0-9a-f]+", 0, 24),
    )
    for kind, (pattern, group, least) in enumerate(rules):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(found)


def test_secret_spans(spark):
    rng = random.Random(1)
    parts = ["token", "Secret", "=", ": ", "'", '"', "abc", "AKIA", "ABCDEFGH12345678", "0123456789abcdef01234567", " ", "é", "api_key", "xyz_12/+", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    for row in secret_scan.scan(table(spark, texts)).collect():
        assert [tuple(s) for s in row.spans] == brute_secrets(row.text)


def test_stored_ledger(spark, tmp_path):
    """A second version of the table scans its new blobs only; a new rule version scans all."""
    ledger = secret_scan.Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.rows().count() == 0
    first = secret_scan.address(table(spark, ["token=abcdefgh", "token=abcdefgh", "clean", None]))
    ledger.update(first)
    assert ledger.rows().count() == 3
    second = secret_scan.address(table(spark, ["token=abcdefgh", "secret=12345678", "clean", None]))
    assert [r.blob for r in secret_scan.new_entries(second, ledger.rows()).collect()] == [hashlib.sha256(b"secret=12345678").hexdigest()]
    ledger.update(second)
    ledger.update(second)
    assert ledger.rows().count() == 4
    found = {r.path: len(r.spans) for r in secret_scan.findings_by_path(second, ledger.rows()).collect()}
    assert found == {0: 1, 1: 1, 2: 0, 3: 0}
    ledger.update(second, secret_scan.RULES[:1])
    assert ledger.rows().count() == 8 and ledger.rows().select("rule_version").distinct().count() == 2


def test_ledger_scans_only_unseen(spark):
    docs = table(spark, ["token=abcdefgh", "token=abcdefgh", "clean", None])
    versions = secret_scan.address(docs)
    first = secret_scan.new_entries(versions, secret_scan.empty_ledger(spark))
    assert first.count() == 3
    ledger = spark.createDataFrame(first.collect(), first.schema)
    more = secret_scan.address(table(spark, ["token=abcdefgh", "clean", "new one"]))
    assert secret_scan.new_entries(more, ledger).count() == 1
    assert secret_scan.new_entries(more, ledger, secret_scan.RULES[:1]).count() == 3
    found = {r.path: r.spans for r in secret_scan.findings_by_path(versions, ledger).collect()}
    assert len(found[0]) == len(found[1]) == 1 and not found[2] and not found[3]


# ---- BPE ----


@pytest.fixture(scope="module")
def byte_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.byte_bpe_path()), bpe.Coder(bpe.Tables(bpe.byte_bpe_path()))


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_bpe_is_the_library(byte_bpe, text):
    library, coder = byte_bpe
    want = library.encode(text, add_special_tokens=False).ids
    raw = coder.encode(text)
    assert np.frombuffer(raw, "<u4").tolist() == want
    assert coder.decode(raw) == library.decode(want, skip_special_tokens=False)


def test_bpe_long_pieces(byte_bpe):
    library, coder = byte_bpe
    for text in ("x" * 3000, "ab" * 2000, " " * 900 + "a", "é" * 700, "".join(chr(97 + i * i % 26) for i in range(2000))):
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    ids = [coder.tables.first[b] for b in b"the quick brown fox jumps over the lazy dog"]
    assert coder.merge_short(list(ids)) == coder.merge_long(list(ids))


# ---- substring dedup ----


def brute_repeats(texts):
    words = [WORD.findall(t or "") for t in texts]
    first = {}
    for i, w in enumerate(words):
        for a in range(len(w) - 12):
            first.setdefault(tuple(w[a : a + 13]), i)
    made = []
    for i, w in enumerate(words):
        gone = {a + k for a in range(len(w) - 12) if first[tuple(w[a : a + 13])] < i for k in range(13)}
        left = " ".join(x for j, x in enumerate(w) if j not in gone)
        made.append((len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return made


def repeated_texts():
    shared = " ".join(f"license{i}" for i in range(30))
    texts = near_texts()
    return texts + [f"own{i} " * 3 + shared + f" tail{i}" for i in range(8)] + ["a a a a a a a a a a a a a a a a", "a " * 14, " ".join(f"u{i}" for i in range(13))]


@pytest.mark.parametrize("rows,frequent,chunk,tree", [(100_000, 24, 10**6, 300_000), (2, 2, 100, 10), (10, 3, 10**6, 40), (0, 1, 10**6, 2)])
def test_repeats(spark, rows, frequent, chunk, tree):
    """The same result whatever prefixes are lengthened and wherever chunks and subtrees end."""
    limits = substring_dedup.Limits(chunk, tree, rows, 0, frequent)
    texts = repeated_texts()
    found = sorted(substring_dedup.remove_repeats(table(spark, texts), limits=limits).collect())
    assert [tuple(r)[1:] for r in found] == brute_repeats(texts)


def test_prefixes_are_lengthened(spark):
    """Prefixes with many suffixes are found by exact counts, at each length."""
    limits = substring_dedup.Limits(group_rows=5, group_share=0, frequent=1)
    texts = [" ".join(f"c{i}" for i in range(9)) + " " + " ".join(f"x{d}.{i}" for i in range(9)) for d in range(7)]
    longer = substring_dedup.long_prefixes(substring_dedup.survey(table(spark, texts).toDF("key", "text"), limits), limits)
    assert [len(longer[n]) for n in (5, 8, 11)] == [5, 2, 0]


def test_subtrees():
    """Nodes of a subtree level by level: a prefix, its branches, and a deep node with two keys."""
    turn = lambda prefix, a, b, rest: prefix << 32 | a << 22 | b << 12 | rest
    head, tail = np.array([turn(1, 5, 1, 7), turn(1, 5, 1, 7), turn(1, 5, 2, 7), turn(1, 6, 0, 7), turn(2, 6, 0, 7)]), np.array([9, 9, 3, 4, 4])
    tree = substring_dedup.Subtree(head, tail)
    assert [s.tolist() for s in tree.starts] == [[0, 4], [0, 3, 4], [0, 2, 3, 4], [0, 2, 3, 4]]
    assert [p.tolist() for p in tree.parents] == [[0, 0, 1], [0, 0, 1, 2], [0, 1, 2, 3]]
    assert tree.covered(np.array([7, 8, 1, 1, 0])).tolist() == [False, True, False, False, False]


def test_repeats_come_through_subtrees(monkeypatch):
    """What a task judges is what its subtrees say."""
    columns = [[1, 1], [7, 7], [0, 1], [0, 0], [0, 0]]
    names = ["head", "tail", "key", "part", "span"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
    (out,) = substring_dedup.covered([batch], 10)
    assert out.column(0).to_pylist() == [1]
    monkeypatch.setattr(substring_dedup.Subtree, "covered", lambda self, key: np.zeros(self.size, bool))
    (out,) = substring_dedup.covered([batch], 10)
    assert out.num_rows == 0


@pytest.mark.parametrize("group_rows", [10, 100_000])
def test_windows_that_share_eleven_words(spark, group_rows):
    """Thousands of different windows below one prefix of eleven words; only those that repeat go."""
    shared = [f"s{i}" for i in range(11)]
    texts = [" ".join([*shared, f"x{d}", f"y{d % 7}", *(f"z{d}.{i}" for i in range(3))]) for d in range(4_000)]
    texts += [" ".join([*shared, "x17", "y3", "other"])]  # the first window of document 17 again
    limits = substring_dedup.Limits(group_rows=group_rows, group_share=0, frequent=4)
    gone = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(table(spark, texts), limits=limits).collect() if r.n_removed}
    assert gone == {4_000: 13}


@pytest.mark.parametrize("part", ["head", "tail"])
def test_few_bits_of_a_prefix_are_enough(spark, monkeypatch, part):
    """Nodes are told apart by what is left when all bits of prefix and turns, or of the tail, say nothing."""
    plain = substring_dedup._branches

    def blunt(chunk, place, longer):
        head, tail = plain(chunk, place, longer)
        rest = (1 << substring_dedup.REST) - 1
        return (head & rest, tail) if part == "head" else (head, tail & 0xFFFF)

    texts = repeated_texts()
    want = brute_repeats(texts)
    monkeypatch.setattr(substring_dedup, "_branches", blunt)
    words = [substring_dedup.words_of(t) for t in texts]
    chunk = substring_dedup.Chunk()
    for w in words:
        chunk.add(w)
    chunk.close()
    none = {n: np.empty(0, np.int64) for n in (5, 8, 11)}
    head, tail = substring_dedup._branches(chunk, chunk.place, none)
    names = {}
    for h, t, d, at in zip(head.tolist(), tail.tolist(), chunk.doc.tolist(), chunk.at.tolist()):
        names.setdefault((h, t), set()).add(tuple(words[d][at : at + 13]))
    assert all(len(v) == 1 for v in names.values())
    order = np.lexsort((chunk.doc, tail, head))
    tree = substring_dedup.Subtree(head[order], tail[order])
    covered = np.zeros(len(order), bool)
    covered[order] = tree.covered(chunk.doc[order])
    lost = [{i + k for i in chunk.at[covered & (chunk.doc == d)].tolist() for k in range(13)} for d in range(len(texts))]
    assert [len(x) for x in lost] == [n for _, n, _ in want]


def test_repeats_of_other_keys(spark):
    """String keys, a key with two texts, repeated rows and null keys."""
    words = " ".join(f"p{k}" for k in range(20))
    rows = [("b", f"x {words}"), ("a", words), ("c", words), ("c", f"y {words} z"), ("c", f"y {words} z"), (None, words), ("a", None)]
    found = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    got = sorted((r.doc_id or "", r.n_words, r.n_removed) for r in found)
    assert got == [("", 20, 0), ("a", 0, 0), ("a", 20, 0), ("b", 21, 20), ("c", 20, 20), ("c", 22, 20), ("c", 22, 20)]


def brute_print(text, size=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark):
    texts = near_texts()
    rows = sorted(simhash.simhash_components(table(spark, texts)).collect())
    prints = [brute_print(t) for t in texts]
    assert [r.fp % (1 << 64) for r in rows] == prints
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert [r.component for r in rows] == groups(len(texts), links)


@pytest.mark.parametrize("hot", [1, 10_000])
def test_block_links(spark, hot):
    rng = random.Random(hot)
    prints = {rng.getrandbits(64) for _ in range(20)}
    for p in list(prints):
        for _ in range(8):
            p ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
            prints.add(p)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.link_blocks(spark.createDataFrame([(s,) for s in signed], "fp long"), hot=hot).collect()
    where = {s: i for i, s in enumerate(signed)}
    want = [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert groups(len(prints), [(where[r.a], where[r.b]) for r in found]) == groups(len(prints), want)


def test_bk_tree():
    rng = np.random.default_rng(5)
    points = rng.integers(0, 1 << 12, (400, 1), dtype=np.uint64)
    found = {(int(a), int(b)) for q, m, _ in simhash.BkTree(points).search(points, 2) for a, b in zip(q, m)}
    assert found == {(i, j) for i in range(400) for j in range(400) if int(points[i, 0] ^ points[j, 0]).bit_count() <= 2}


def test_bk_edges_are_followed():
    """A shard of the usual size is a tree of several levels, and a search leaves most of it alone."""
    points = np.random.default_rng(6).integers(0, 1 << 63, (simhash.SHARD, 1), dtype=np.uint64)
    tree = simhash.BkTree(points)
    assert any(child.children for child in tree.children.values())
    list(tree.search(points, 2))
    assert tree.comparisons() < simhash.SHARD**2 / 4


def test_links_come_through_the_tree(spark, monkeypatch):
    def broken(*_):
        raise AssertionError("searched")

    monkeypatch.setattr(simhash.BkTree, "search", broken)
    with pytest.raises(AssertionError, match="searched"):
        simhash.spanning_links(np.zeros((3, 1), np.uint64), 2)


def test_string_keys(spark):
    docs = spark.createDataFrame([("b", "x y z"), ("a", "x  Y z"), ("c", None), ("a", "other words here now")], "doc_id string, text string")
    assert sorted(map(tuple, simhash.near_groups(docs).collect())) == [("a", "a"), ("a", "a"), ("b", "a"), ("c", "c")]
    assert {(r.key, r.component) for r in simhash.simhash_components(docs).collect()} >= {("b", "a"), ("c", "c")}


@pytest.mark.parametrize("hot", [2, 10_000])
def test_near_groups(spark, hot):
    texts = near_texts(seed=8, n=80)
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := WORD.findall((t or "").lower())) else set() for t in texts]
    like = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if like(sets[i], sets[j])]
    rows = sorted(simhash.near_groups(table(spark, texts), hot=hot).collect())
    assert [r.component for r in rows] == groups(len(texts), links)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(0, i) for i in range(1, 40)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = groups(200, links)
    assert all(found.get(i, i) == want[i] for i in range(200))
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- sharding ----


def test_hilbert_curve():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        index = hilbert.hilbert_index(cells, bits)
        assert sorted(index) == list(range(len(cells)))
        path = cells[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards(spark, folders, tmp_path):
    docs = spark.read.parquet(f"{folders[0]}/documents.parquet").drop("shard")
    placed = hilbert.shard_documents(docs, 4)
    rows = placed.collect()
    counts = [sum(r.shard == s for r in rows) for s in range(4)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s])) for s in range(4))
    keyed = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    hilbert.write_shards(keyed, f"file://{tmp_path}/out", 4)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == keyed.count()


def test_written_shards_keep_every_row(spark, tmp_path):
    """Repeated and null keys, and columns with the result's names, stay as many rows as they were."""
    rows = [(1, "a", "en", "s", 9), (1, "b", "en", "s", 9), (1, "a", "en", "s", 9), (None, "c", None, None, 9), (None, "c", None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, slot long")
    hilbert.write_shards(docs, f"file://{tmp_path}/out", 3)
    back = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((r[0] or 0, r[1]) for r in rows)
    assert sorted((r.shard, r.slot) for r in back) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]


def test_shard_rows_are_recomputed(spark, folders):
    """Size, checksum, shard and slot of every row, by Python."""
    docs = spark.read.parquet(f"{folders[0]}/documents.parquet")
    from loomspan.llm.queries import QUERIES

    rows = QUERIES["op7_hilbert_shards"](spark, folders[0]).collect()
    texts = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=key) == sorted(((d, len(t) + 16, zlib.crc32(t)) for d, t in texts), key=key)
    placed = hilbert.shard_documents(docs, 40).collect()
    order = sorted(placed, key=lambda r: (r.curve, r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32))
    n = len(order)
    shard = [i * 40 // n for i in range(n)]
    assert [(r.shard, r.slot) for r in order] == [(s, i - shard.index(s)) for i, s in enumerate(shard)]


def test_shards_prune(spark):
    """Rows of one language and size class lie in few shards of the curve, and in all shards of a hash."""
    rows = [(i, "x" * (4 ** (i % 7)), f"l{i % 4}", f"s{i // 4 % 5}") for i in range(2800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    placed = {r.doc_id: r.shard for r in hilbert.shard_documents(docs, 40).collect()}
    some = [i for i in range(2800) if i % 4 == 1 and i % 7 == 6]
    assert len({placed[i] for i in some}) <= 20 and len({hash(str(i)) % 40 for i in some}) > 30


# ---- chat ----


def test_preferences(spark):
    turn = "array<struct<role:string,text:string>>"
    rows = [
        (0, [("user", "q"), ("assistant", "good")], [("user", "q"), ("assistant", "bad"), ("user", "z")]),
        (1, [("user", "q")], [("user", "q")]),
        (2, None, [("user", None)]),
        (3, [("user", "<|end|>")], []),
    ]
    out = {r.id: r for r in chat.format_preferences(spark.createDataFrame(rows, f"id long, chosen {turn}, rejected {turn}")).collect()}
    assert out[0].prompt == "<|user|>\nq<|end|>\n" and out[0].n_prefix_turns == 1
    assert out[0].chosen_completion == "<|assistant|>\ngood<|end|>\n"
    (span,) = out[0].chosen_spans
    a, b = map(int, span.split(":"))
    assert out[0].chosen_completion[a:b] == "good<|end|>\n" and len(out[0].rejected_spans) == 1
    assert out[1].chosen_completion == out[1].rejected_completion == "" and out[1].n_prefix_turns == 1
    assert out[2].n_prefix_turns == 0 and out[3].chosen_completion == "<|user|>\n< |end|><|end|>\n"


def test_stale_replies(spark):
    """Completions of several turns, an only reply, no reply, against the query's own SQL in words."""
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (1, 4, "user", "e"), (1, 5, "assistant", "b"), (1, 6, "user", "f")]
    rows += [(2, 0, "user", "x"), (2, 1, "assistant", "y"), (3, 0, "user", "z")]
    pairs = chat.stale_reply_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {r.conv_id: r for r in chat.format_preferences(pairs).collect()}
    assert [out[i].n_prefix_turns for i in (1, 2, 3)] == [3, 1, 1]
    spans = lambda side, at: [side[a:b] for a, b in (map(int, x.split(":")) for x in at)]
    assert spans(out[1].chosen_completion, out[1].chosen_spans) == ["d<|end|>\n", "b<|end|>\n"]
    assert spans(out[1].rejected_completion, out[1].rejected_spans) == ["b<|end|>\n"] * 2
    assert out[1].chosen_completion.endswith("<|user|>\nf<|end|>\n")
    assert spans(out[2].rejected_completion, out[2].rejected_spans) == ["<|end|>\n"] and out[3].chosen_completion == ""


def test_many_turns_and_matches(spark):
    """Spans of very long rows take time about in proportion to them."""
    turns = [("assistant", "x")] * 32_000
    pairs = spark.createDataFrame([(turns, [])], "chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    began = time.perf_counter()
    (row,) = chat.format_preferences(pairs).collect()
    assert len(row.chosen_spans) == 32_000 and time.perf_counter() - began < 20
    began = time.perf_counter()
    (row,) = secret_scan.scan(table(spark, ["token=abcdefgh " * 32_000])).select("spans").collect()
    assert len(row.spans) == 32_000 and row.spans[-1].end == 15 * 32_000 - 1 and time.perf_counter() - began < 20


# ---- decontamination ----


@pytest.mark.parametrize("most", [0, 500_000])
def test_leaks(spark, most):
    rng = random.Random(4)
    words = [f"t{i}" for i in range(300)]
    items = [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 4, 5, 8, 17, 40, 90)] + [None, ""]
    docs = [None, ""]
    for _ in range(40):
        body = [rng.choice(words) for _ in range(rng.randint(0, 200))]
        leak = (rng.choice(items) or "").upper().split()
        for _ in range(rng.randint(0, 3)):
            leak.insert(rng.randint(0, len(leak)), "noise")
        docs.append(" ".join(body[:50] + leak + body[50:]) + ".")
    docs.append(items[0])

    def sets(text):
        w = re.findall(r"[a-z0-9]+", (text or "").lower())
        return {" ".join(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1)}

    def item_set(text):
        w = re.findall(r"[a-z0-9]+", (text or "").lower())
        return {x for x in sets(text) if len(x.split()) == min(5, len(w))}

    want = {(d, i) for d, text in enumerate(docs) for i, item in enumerate(items) if item_set(item) and len(item_set(item) & sets(text)) >= 0.8 * len(item_set(item))}
    items_df = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc, r.item) for r in decontam.leaks(table(spark, docs), items_df, broadcast_rows=most).collect()}
    assert found == want and len(want) > 10


def test_size_partitions(spark):
    """Items of unlike sizes are in partitions of their own, each with its own threshold."""
    items = spark.createDataFrame([(0, "what is the capital"), (1, "a b c d e f"), (2, " ".join(f"w{i}" for i in range(100)))], "item_id long, text string")
    held = {r.item: r for r in decontam.sketches(items).collect()}
    assert [held[i].part for i in range(3)] == [-1, 1, 6] and [len(held[i].sketch) for i in range(3)] == [1, 1, 20]
    docs = table(spark, ["so, What is the capital of it?", "what is the cost"])
    assert [(r.doc, r.item, r.n_shared) for r in decontam.leaks(docs, items).collect()] == [(0, 0, 1)]


# ---- token files ----


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as file:
        coder = token_files.ChunkCoder(file.read(), "<u4")
    texts = ["The the, THE.  don't", None, " a\n\nb <|endoftext|> x"]
    library = Tokenizer.from_file(path)
    assert [np.frombuffer(c, "<u4").tolist() for c in coder.encode(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_files.word_bpe_path())
    texts = ["", None, "The the, THE. don't <|endoftext|> é!", "a  b\n\nc", "x" * 3000, "q w e " * 500]
    folder = f"file://{tmp_path}/ids"
    token_files.write(table(spark, texts), folder, token_files.word_bpe_path(), end_id=2)
    want = [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert [ids for _, ids in token_files.documents_of(folder)] == want
    rows = sorted(token_files.read(spark, folder).collect())
    assert [r.start for r in rows] == [sum(map(len, want[:i])) for i in range(len(want))]
    assert [r.ids_crc32 for r in rows] == [zlib.crc32(np.array(w, "<u4").tobytes()) for w in want]


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_chunk_coder_is_the_library(texts):
    with open(token_files.word_bpe_path(), encoding="utf-8") as file:
        coder = token_files.coder_for(file.read(), "<u2")
    for raw, text in zip(coder.encode(texts), texts):
        assert np.frombuffer(raw, "<u2").tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
