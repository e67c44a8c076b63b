"""Toxicity, source divergence and periodic runs against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from loomspan.llm import divergence, periodic, toxicity

CLASH = "key string, runs string, best string, kept string, words string, g string, score string, slot int, block int, base int"


# --- periodic runs ---------------------------------------------------------


def plain_runs(w):
    """All runs by looking at every period."""
    found = {}
    for p in range(1, len(w) // periodic.TIMES + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(periodic.LEAST, periodic.TIMES * p) and j > i:
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, t - s, p) for (s, t), p in found.items())


piece = st.one_of(
    st.lists(st.integers(0, 2), min_size=1, max_size=12).map(lambda x: ("new", x, 1)),
    st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(2, 9)).map(lambda x: ("new", *x)),
    st.tuples(st.integers(0, 200), st.integers(5, 90)).map(lambda x: ("again", *x)),
)


@settings(max_examples=300, deadline=None)
@given(st.lists(piece, min_size=1, max_size=8))
def test_runs_are_all_runs(pieces):
    w = []
    for kind, a, b in pieces:
        w += a * b if kind == "new" else w[a % (len(w) or 1) :][:b]
    assert periodic.runs(w) == plain_runs(w)


def test_lz_factors_point_back():
    rng = random.Random(3)
    for _ in range(50):
        w = [rng.randrange(3) for _ in range(rng.randint(1, 60))]
        parts = periodic.factors(w)
        ends = [s for s, _ in parts[1:]] + [len(w)]
        for (start, earlier), end in zip(parts, ends):
            assert (w[start] not in w[:start]) if earlier < 0 else (earlier < start and w[earlier : earlier + end - start] == w[start:end])
            # the longest prefix that starts earlier
            assert end == len(w) or earlier < 0 or not any(w[s : s + end + 1 - start] == w[start : end + 1] for s in range(start))


def plain_periodic(doc_id, text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for s, size, p in found for i in range(s + p, s + size)}
    best = min(found, key=lambda r: (-r[1] * 10**9 // r[2], r[0], r[2])) if found else (None,) * 3
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{size},{p}\n" for s, size, p in found)
    return (doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], digest(lines), digest(kept))


def test_periodic_query_on_edge_texts(spark, tmp_path):
    rng = random.Random(5)
    some = lambda n, k=9: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    texts = [None, "", " \n\t ", "one", "x " * 23, "x " * 24, "x " * 20_000, "a b\tc\n" * 8, some(40) + " " + "p q " * 30, "é 漢 🎉 " * 12, some(3000, 400)]
    texts += [f"{some(30, 50)} {(some(7, 50) + ' ') * 5}{some(9, 50)} {(some(2, 50) + ' ') * 15}" for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, "again and again"), (0, None), (None, "u v " * 20), (None, None)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    made.selectExpr("*", *(f"'x' AS {c.split()[0]}" for c in CLASH.split(", "))).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.op13_periodic_runs(spark, f"file://{tmp_path}").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(plain_periodic(*r)) for r in rows)
    assert any(r["n_runs"] > 1 for r in got)


def test_periodic_query_on_the_smallest_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect() if r["text"] is None or len(r["text"]) < 9000]
    got = {r["doc_id"]: tuple(r) for r in periodic.op13_periodic_runs(spark, folder).collect()}
    assert all(got[doc_id] == plain_periodic(doc_id, text) for doc_id, text in rows)


# --- source divergence -----------------------------------------------------


def plain_audit(rows, least_docs, top):
    """The contract's rows from whole counters."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = "".join(c if "a" <= c <= "z" or ord(c) > 127 else " " for c in low).split(" ")
        terms = [t for t in terms if t]
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least_docs)
        own = [g for g in groups if g[0] == lang]
        whole = Counter()
        for g in own:
            whole.update(counts[g])

        def shares(c):
            below = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // below for t in kept}

        p, q = {g: shares(counts[g]) for g in own}, shares(whole)
        for g in own:
            pairs = sorted(((-sum(abs(p[g][t] - p[o][t]) for t in kept), o[1].encode(), o[1]) for o in own if o != g))
            out += [(*g, "pair", item, -v, i + 1) for i, (v, _, item) in enumerate(pairs)]
            ahead = sorted((q[t] - p[g][t], t.encode(), t) for t in kept if counts[g][t] and p[g][t] > q[t])[:top]
            out += [(*g, "term", item, -v, i + 1) for i, (v, _, item) in enumerate(ahead)]
    return sorted(out)


def audit_rows(seed=11, sources=7):
    rng = random.Random(seed)
    rows = []
    for i in range(260):
        source = "hot" if i % 3 == 0 else f"s{rng.randrange(sources)}"
        lang = rng.choice(["en", "en", "de", None])
        text = " ".join(rng.choice("Alpha beta,gamma d3lta É漢 zeta-eta THE the of é".split()) + rng.choice(["", ".", f"{rng.choice('xyz')}"]) for _ in range(rng.randrange(40)))
        rows.append((rng.choice([text, text, text, None, ""]), lang, rng.choice([source, source, None])))
    return rows + rows[:9] + [("only one", "xx", "alone"), (None, "yy", "a"), ("", "yy", "b"), ("long " * 30_000, "en", "s1")]


@pytest.mark.parametrize("block, wave, held", [(2048, 64, 4_000_000), (3, 2, 50), (1, 1, 1)])
def test_audit_against_plain_counters(spark, monkeypatch, block, wave, held):
    monkeypatch.setattr(divergence, "HELD", held)
    rows = audit_rows()
    made = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    made = made.selectExpr("*", *(f"'x' AS {c}" for c in ("term", "n", "docs", "slot", "block", "value", "rank")))
    got = sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(made, least_docs=5, top=4, block=block, wave=wave).collect())
    assert got == plain_audit(rows, 5, 4)
    assert {r[2] for r in got} == {"pair", "term"}


def test_audit_of_one_hot_group_and_of_nothing(spark):
    schema = "text string, lang string, source string"
    rows = [("same words here", "en", "hot")] * 400 + [("same", "en", "cold")]
    assert sorted(tuple(r) for r in divergence.audit(spark.createDataFrame(rows, schema)).collect()) == plain_audit(rows, 30, 50)
    assert divergence.audit(spark.createDataFrame([], schema)).count() == 0


# --- toxicity --------------------------------------------------------------


def toxic_rows(n=1500, seed=2):
    rng = random.Random(seed)
    bad = "foulone foultwo foulthree".split()
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice([5, 60, 400]))]
        toxic = i % 8 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad).upper() + ","
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic) if rng.random() > 0.03 else int(not toxic)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_rows()
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    weights = toxicity.train(docs, known.filter(toxicity.remainder(known.doc_id) != 2))
    assert 0 < weights.count() < 2000
    score = {r["key"]: r["score"] for r in toxicity.score(docs, weights).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((score[i] >= toxicity.CUT) == (i % 8 == 0) for i in held)


def test_toxicity_learns_from_the_open_folds_alone(spark, tmp_path):
    rows, labels = toxic_rows(400)
    outs = []
    for turn in range(2):  # other labels in the held-out fold change nothing
        folder = f"{tmp_path}/{turn}"
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
        known = [(i, 1 - y if turn and zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
        spark.createDataFrame(known, "doc_id long, toxic int").repartition(3).write.parquet(f"{folder}/labels.parquet")
        outs.append(sorted(tuple(r) for r in toxicity.op11_toxicity(spark, f"file://{folder}").collect()))
    assert outs[0] == outs[1]


def test_toxicity_sample_has_its_bound(spark):
    rows, labels = toxic_rows(600)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    few = toxicity.train(docs, known, sample=60, epochs=1).collect()
    base = [r["weight"] for r in few if r["feature"] == 1 << toxicity.BITS]
    assert len(few) < 600 and base and base[0] < 0


def test_toxicity_edges(spark, tmp_path):
    rows, labels = toxic_rows(300)
    rows += [(9001, None), (9002, ""), (9003, " \n"), (None, "foulone"), (None, None), (8, rows[8][1]), (9004, "w1 " * 100_000)]
    labels += [(None, 1), (9001, 1), (9002, None), (777_777, 1), (8, 1)]
    made = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *(f"'x' AS {c.split()[0]}" for c in CLASH.split(", ")), "1 AS label", "2 AS turn")
    made.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op11_toxicity(spark, f"file://{tmp_path}").collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (9001, 9002, 9003)}) == 1
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    none = spark.createDataFrame([], "doc_id long, text string")
    weights = toxicity.train(none, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert weights.count() == 0
    assert {r["score"] for r in toxicity.score(made, weights).collect()} == {0.5}
    assert toxicity.score(none, weights).count() == 0
