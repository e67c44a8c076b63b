"""Queries and pipeline stages on the edge cases, value by value against brute force or the library."""

import hashlib
import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from loomspan.llm import bpe, decontam, pii, quality, simhash, token_files
from loomspan.llm.queries import QUERIES
from test_operators import WORD, brute_pii, brute_print, brute_secrets


def documents(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) if v is not None else (False, 0) for v in r))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def spans_of(found, kinds):
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in found)


@pytest.fixture(scope="module")
def edge(spark, folders):
    docs = documents(spark, folders[0])
    run = lambda name, *columns: ordered(tuple(r[c] for c in columns) for r in QUERIES[name](spark, folders[0]).collect())
    return docs, run


def test_personal_data(edge):
    docs, run = edge
    want = []
    for key, text in docs:
        found = brute_pii(text or "")
        label = spans_of(found, pii.KINDS)
        want.append((key, *(sum(k == i for _, k, _ in found) for i in range(4)), sha(label)))
    assert run("op2_pii_bootstrap", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == ordered(want)


def test_secrets(edge):
    docs, run = edge
    want = []
    for key, text in docs:
        found = brute_secrets(text or "")
        label = spans_of(found, ("assign", "access", "hex"))
        want.append((key, *(sum(k == i for _, k, _ in found) for i in range(3)), sha(label), label))
    assert run("op3_secret_ledger", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans") == ordered(want)


def test_byte_bpe(edge):
    docs, run = edge
    library, want = Tokenizer.from_file(bpe.byte_bpe_path()), []
    for key, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(library.decode(ids, skip_special_tokens=False))))
    assert run("op4_byte_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == ordered(want)


def test_repeats(edge):
    docs, run = edge
    words = [(k, WORD.findall(t or "")) for k, t in docs]
    first = {}
    for k, w in words:
        for i in range(len(w) - 12) if k is not None else ():
            first[tuple(w[i : i + 13])] = min(k, first.get(tuple(w[i : i + 13]), k))
    want = []
    for k, w in words:
        gone = {i + j for i in range(len(w) - 12) if k is not None and first[tuple(w[i : i + 13])] < k for j in range(13)}
        want.append((k, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert run("op5_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == ordered(want)


def test_fingerprints(edge):
    docs, run = edge
    prints = [brute_print(t) for _, t in docs]
    group = list(range(len(docs)))
    for _ in docs:
        group = [min(group[j] for j in range(len(docs)) if (prints[i] ^ prints[j]).bit_count() <= 2) for i in range(len(docs))]
    least = {g: min((k for (k, _), h in zip(docs, group) if h == g and k is not None), default=None) for g in group}
    want = [(k, f"{p:016x}", least[g]) for (k, _), p, g in zip(docs, prints, group)]
    assert run("op6_simhash_groups", "doc_id", "fingerprint", "component_id") == ordered(want)


def test_token_files(edge):
    docs, run = edge
    library, at, want = Tokenizer.from_file(token_files.word_bpe_path()), 0, []
    for key, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert run("op10_token_files", "doc_id", "start", "n_tokens", "ids_crc32") == ordered(want)


def shingles(text, size=5):
    words = [w.lower() for w in WORD.findall(text or "")]
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain_quality(rows):
    """The threshold table in plain Python."""

    def good(text):
        words = WORD.findall(text or "")
        tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = {w for w, n in Counter(tri).items() if n > 1}
        covered = {i + k for i, t in enumerate(tri) if t in often for k in range(3)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        chars, symbols = "".join(words), sum(c in "#*$%&|<>" for c in text or "")
        if len(words) < 50 or 2 * len(covered) > len(words):
            return False
        ratios = 1.5 <= len(chars) / len(words) <= 15 and symbols <= 0.1 * len(words) and sum(c.isalpha() for c in chars) >= 0.5 * len(chars)
        return ratios and len(set(words) & set(quality.STOP_WORDS)) >= 2 and len(lines) - len(set(lines)) <= 0.4 * len(lines)

    return [(k, t) for k, t in rows if good(t)]


def plain_near(rows):
    """One row of each group of texts with 0.8 of their shingles in common: that of the least key, missing keys last."""
    rows = list(dict.fromkeys((k, t) for k, t in rows))
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            group = [group[i] if g == group[j] else g for g in group]
    last = lambda r: (r[0] is None, r[0] or 0)
    return [min((r for r, h in zip(rows, group) if h == g), key=last) for g in set(group)]


def plain_decontamination(rows, items):
    """Rows without 0.8 of an item's shingles."""
    plain = lambda t: "".join(c.lower() if c.isalnum() else " " for c in t or "").split()
    cut = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    wanted = [(min(5, len(w)), cut(w, min(5, len(w)))) for w in map(plain, items) if w]
    return [(k, t) for k, t in rows if not any(len(own & cut(plain(t), n)) >= 0.8 * len(own) for n, own in wanted)]


def test_pipeline_stages(spark, folders):
    """Each stage on all documents, and the whole run, against what the rules say in plain Python."""
    folder = folders[0]
    docs, stages = spark.read.parquet(f"{folder}/documents.parquet"), dict(corpus_pipeline.STAGES)
    items = [t for (t,) in spark.read.parquet(f"{folder}/benchmark.parquet").select("text").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    key = lambda k: -1 if k is None else k
    shown = lambda some: sorted((key(k), t or "") for k, t in some)
    plain = {
        "quality_rules": plain_quality,
        "simhash_near_dedup": plain_near,
        "benchmark_decontamination": lambda some: plain_decontamination(some, items),
        "pii": lambda some: [(k, pii.mask(t, brute_pii(t)) if t else t) for k, t in some],
    }
    left = rows
    for name, rule in plain.items():
        want = rule(rows)
        assert shown((r.doc_id, r.text) for r in stages[name](spark, docs, folder).collect()) == shown(want), name
        assert name == "pii" or 0 < len(want) < len(rows)
        left = rule(left)
    library = Tokenizer.from_file(bpe.byte_bpe_path())
    coded = lambda some: sorted((key(k), library.encode(t or "", add_special_tokens=False).ids) for k, t in some)
    ids = lambda df: sorted((key(r.doc_id), np.frombuffer(r.token_ids, "<u4").tolist()) for r in df.collect())
    assert ids(stages["bpe"](spark, docs, folder)) == coded(rows)
    assert 0 < len(left) < len(plain_quality(rows)) and ids(corpus_pipeline.run(spark, folder)) == coded(left)


def test_empty_tables(spark, folders):
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.read.parquet(f"{folders[1]}/documents.parquet")
        assert stage(spark, docs, folders[1]).count() == 0


def test_decontamination_of_null_keys(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "other words"), (1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a b c d e f"), (7, None)], "item_id long, text string")
    assert ordered(map(tuple, decontam.leaks(docs, items).collect())) == [(None, None, 2, 2), (1, None, 2, 2)]


def test_near_groups_of_empty_table(spark):
    assert simhash.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
