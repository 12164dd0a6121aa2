from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightmatch.llm import components as component_steps
from sightmatch.llm import ego, exact_dedup, minhash
from sightmatch.llm.components import components

DOCS = "doc_id long, text string, keep_id long, digest string, left string, key int"


def docs_of(spark, rows, schema=DOCS):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 7, "x", "y", 1) for i, t in rows], schema).repartition(3)


def plain_copies(rows):
    groups = {}
    for i, t in rows:
        clean = (t or "").translate({c: None for c in (32, *range(9, 14))})
        groups.setdefault(clean, []).append((-len(t or ""), float("inf") if i is None else i, i))
    out = []
    for clean, members in groups.items():
        keep = min(members, key=lambda m: m[:2])[2]
        sha, first = hashlib.sha256(clean.encode()).hexdigest(), True
        for _, _, i in sorted(members, key=lambda m: m[:2]):
            out.append((i, keep, len(members), i == keep and first, sha))
            first = first and i != keep
    return sorted(out, key=str)


ROWS = [
    (1, "a b c"), (2, "ab c"), (3, "abc"), (4, None), (5, ""), (6, " \t\x0b"), (7, "a bc"),
    (8, "x" * 100_000), (9, "x " * 100_000), (2, "ab c"), (None, "abc   "), (None, None), (10, "ab c  "),
    (11, "É"), (12, "É"), (12, "É"),
]


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda text: F.substring(text, 1, 1)])
def test_exact_copies(spark, digest):
    got = exact_dedup.group_copies(docs_of(spark, ROWS), digest=digest, salts=2)
    assert sorted(map(tuple, got.collect()), key=str) == plain_copies(ROWS)


def test_exact_copies_many_and_none(spark):
    many = [(i, "hot" if i % 3 else f"t {i % 50}") for i in range(600)]
    got = exact_dedup.group_copies(docs_of(spark, many))
    assert sorted(map(tuple, got.collect()), key=str) == plain_copies(many)
    assert exact_dedup.group_copies(docs_of(spark, [])).collect() == []


def test_drop_copies(spark):
    left = exact_dedup.drop_copies(docs_of(spark, ROWS))
    assert left.columns == [c.split()[0] for c in DOCS.split(", ")]
    got = sorted((r.doc_id, r.text) for r in left.collect())
    want = {}
    for i, keep, _, kept, sha in plain_copies(ROWS):
        if kept:
            want[sha] = keep
    assert sorted(i for i, _ in got) == sorted(want.values())


def test_copies_with_text_ids_and_odd_columns(spark):
    schema = "doc_id string, text string, copy_id int, copy_sha string, __id int"
    rows = [("b", "x y"), ("a", "xy"), ("a", "x y"), (None, "x  y"), ("c", "x  y"), ("d", None), ("d", "")]
    docs = spark.createDataFrame([(i, t, 1, "s", 2) for i, t in rows], schema).repartition(3)
    got = exact_dedup.group_copies(docs).select("doc_id", "keep_id", "group_size", "kept").collect()
    want = [("a", "c", 5, False)] * 2 + [("b", "c", 5, False), ("c", "c", 5, True), (None, "c", 5, False)]
    assert sorted(map(tuple, got), key=str) == sorted([*want, ("d", "d", 2, True), ("d", "d", 2, False)], key=str)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == ["c", "d"]


def shingles(text, k):
    words = [w for w in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
             .replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def roots(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def plain_near(rows, k, share):
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    links = [
        (a, b)
        for n, a in enumerate(ids)
        for b in ids[n + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b])
    ]
    named = roots(ids, links)
    return sorted((i, len(sets[i]), named[i], named[i] == i) for i in ids)


def plain_near_of_ids(rows, k, share):
    """As plain_near, for ids with several texts: links of any of them count."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    links = [
        (a, b)
        for n, (a, x) in enumerate(sets)
        for b, y in sets[n + 1 :]
        if x and y and 100 * len(x & y) >= share * len(x | y)
    ]
    named = roots({i for i, _ in rows}, links)
    out = [(i, len(s), named[i] if s else i, named[i] == i or not s) for i, s in sets]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_duplicates_of_repeated_ids(spark, seed):
    rng = random.Random(seed)
    texts = [" ".join(f"{c}{i}" for i in range(100)) for c in "ABCD"]
    near = [t.rsplit(" ", 2)[0] + " z" for t in texts]
    # 1-2 by A, 2-3 by B; 5 and 9 share nothing but are joined by the texts of 7.
    rows = [(1, near[0]), (2, texts[0]), (2, texts[1]), (3, near[1]), (2, None), (2, texts[0])]
    rows += [(7, texts[2]), (7, texts[3]), (5, near[2]), (9, near[3]), (11, "alone"), (12, None)]
    rng.shuffle(rows)
    want = plain_near_of_ids(rows, 3, 85)
    got = minhash.near_duplicates(docs_of(spark, rows), words=3, threshold=(85, 100))
    assert sorted(map(tuple, got.collect()), key=str) == want
    named = [(f"d{i:02}", t) for i, t in rows]
    docs = docs_of(spark, named, DOCS.replace("doc_id long", "doc_id string"))
    got = minhash.near_duplicates(docs, words=3, threshold=(85, 100))
    assert sorted(map(tuple, got.collect()), key=str) == plain_near_of_ids(named, 3, 85)
    odd = docs.withColumn("gone_id", F.lit(1)).withColumn("__id", F.lit("d01"))
    left = minhash.drop_near_duplicates(odd, words=3, threshold=(85, 100))
    assert left.columns == odd.columns
    assert {r.doc_id for r in left.collect()} == {"d01", "d05", "d11", "d12"}


def near_rows():
    rng, rows = random.Random(5), []
    vocabulary = [f"w{i}" for i in range(900)]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([12, 60, 150]))]
        for _ in range(8):  # drifts, so that there are chains of links
            rows.append(" ".join(base))
            base = list(base)
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
    rows += ["A b", "a B", "a b c", "a\tB  c", "lone", "É é", "é é", "", None, "   ", rows[0], rows[0].upper()]
    return list(enumerate(rows))


def test_near_duplicates(spark):
    rows = near_rows()
    got = minhash.near_duplicates(docs_of(spark, rows), words=3, threshold=(85, 100))
    assert sorted(map(tuple, got.collect())) == plain_near(rows, 3, 85)


def test_near_duplicates_edges(spark):
    rows = [(1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None)]
    got = sorted(map(tuple, minhash.near_duplicates(docs_of(spark, rows), words=5).collect()), key=str)
    assert got == sorted(
        [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True), (None, 2, None, True)], key=str
    )
    assert minhash.near_duplicates(docs_of(spark, [])).collect() == []
    left = minhash.drop_near_duplicates(docs_of(spark, rows))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == [(False, 1), (False, 3), (True, 0)]


def test_links_beyond_the_smallest_of_a_bucket(spark):
    # 0 is far enough from 2 and 3 to be no link, near enough to share buckets; 2 and 3 are one.
    base = [f"w{i}" for i in range(100)]
    near = base[:70] + [f"v{i}" for i in range(30)]
    rows = [(0, " ".join(base)), (2, " ".join(near)), (3, " ".join([*near[:-1], "z"]))]
    got = minhash.near_duplicates(docs_of(spark, rows), words=1, threshold=(85, 100), rows=1)
    assert sorted(map(tuple, got.collect())) == plain_near(rows, 1, 85)


@pytest.mark.parametrize("few", [100_000, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(component_steps, "FEW_LINKS", few)
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(500, 560)]
    links += [(5, 5), (7, None)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components(df, "a", "b").collect()}
    real = [(a, b) for a, b in links if b is not None and a != b]
    want = roots({x for p in real for x in p}, real)
    assert got == {n: c for n, c in want.items() if n != c}


def vectors_of(spark, rows):
    schema = "vec_id long, embedding array<float>, label int, n_links int, lo int, at string"
    return spark.createDataFrame([(i, v, k, 1, 2, "q") for i, v, k in rows], schema).repartition(4)


def plain_vectors(rows, threshold):
    def unit(v):
        if not v or any(x is None or not np.isfinite(np.float32(x)) for x in v) or not any(v):
            return None
        v = np.array(v, np.float32).astype(float)
        return v / np.linalg.norm(v)

    units = [unit(v) if i is not None and k is not None else None for i, v, k in rows]
    links, n = [], [0] * len(rows)
    for p, (i, v, k) in enumerate(rows):
        for q in range(p + 1, len(rows)):
            a, b = units[p], units[q]
            if a is not None and b is not None and k == rows[q][2] and len(a) == len(b) and a @ b >= threshold:
                links.append((i, rows[q][0]))
                n[p], n[q] = n[p] + 1, n[q] + 1
    named = roots({i for i, _, _ in rows if i is not None}, links)
    return sorted(((i, n[p], named.get(i), named.get(i) == i or i is None) for p, (i, _, _) in enumerate(rows)), key=str)


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(ego, "BLOCK_BYTES", 16 * 4 * 20)  # 20 vectors
    rng = np.random.default_rng(3)
    rows = []
    for c in range(6):
        centre = rng.normal(size=16)
        rows += [(centre + rng.normal(size=16) * 0.09, c % 2) for _ in range(40)]
    rows += [(rng.normal(size=16), int(k)) for k in rng.integers(0, 2, 150)]
    rows = [(i, [float(x) for x in v], k) for i, (v, k) in enumerate(rows)]
    rows += [(1000 + j, rows[0][1], 0) for j in range(5)] + [(1010, rows[0][1], None), (1011, rows[0][1], 0)] * 2
    rows += [(1020, None, 0), (1021, [], 0), (1022, [0.0] * 16, 0), (1023, [float("nan")] * 16, 0)]
    rows += [(1024, [None] * 16, 0), (1025, [1.0, 0.0], 0), (1026, [2.0, 0.0], 0), (None, rows[0][1], 0)]
    rows += [(1027, [float("inf")] + [0.0] * 15, 0)]
    got = ego.near_duplicates(vectors_of(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == plain_vectors(rows, 0.98)


@pytest.mark.parametrize("label", ["string", "double", "date"])
def test_vectors_with_text_ids_and_any_labels(spark, label):
    rng = np.random.default_rng(4)
    rows = [(f"v{i:02}", [float(x) for x in rng.normal(size=8)], i % 2) for i in range(30)]
    rows += [(f"w{i}", [x + 0.01 for x in rows[i][1]], i % 2) for i in range(8)] + [("x", rows[0][1], None)]
    of_label = F.when(F.col("k") == 0, F.lit("2020-01-01")).when(F.col("k") == 1, F.lit("2020-01-02"))
    if label == "double":
        of_label = F.col("k") / 4
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>, k int").repartition(3)
    got = ego.near_duplicates(df.withColumn("label", of_label.cast(label)))
    assert sorted(map(tuple, got.collect()), key=str) == plain_vectors(rows, 0.98)


def test_no_vectors(spark):
    assert ego.near_duplicates(vectors_of(spark, [])).collect() == []
    assert [tuple(r) for r in ego.near_duplicates(vectors_of(spark, [(1, None, 0)])).collect()] == [(1, 0, 1, True)]
