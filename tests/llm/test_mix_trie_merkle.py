from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightmatch.llm import merkle, mixing, prefix_trie, running, slots


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Row numbers of hot groups ---------------------------------------------------------------------


def test_numbers_of_a_hot_group(spark):
    rows = [(None if i % 3 else i % 5, i * 7919 % 4001, i % 4) for i in range(4000)]
    df = spark.createDataFrame(rows, "g int, o int, v int").repartition(5)
    got = running.number(df, ["g"], [F.col("o")], "n", {"total": "v"}).collect()
    want, seen = {}, defaultdict(lambda: [0, 0])
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        seen[g][0] += 1
        seen[g][1] += v
        want[o] = tuple(seen[g])
    assert {r.o: (r.n, r.total) for r in got} == want and len(got) == len(rows)


# Mixing ----------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, source string, size int, target string, level int, nth int"


def docs_of(spark, rows):
    """Documents with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, t, s, 9, "x", 1, 2) for i, t, s in rows], DOCS).repartition(3)


def plain_targets(sizes):
    """By the words of the contract: what is over three times a source's size is shared anew."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    capped, out = set(), {}
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        mass = sum(weight[s] for s in names if s not in capped) or 1
        out = {s: 3 * sizes[s] if s in capped else left * weight[s] / mass for s in names}
        over = {s for s in names if out[s] > 3 * sizes[s]}
        if not over:
            return out
        capped |= over


def many(n, sources, seed=1):
    rng = random.Random(seed)
    lengths = [int(rng.paretovariate(0.9)) % 3000 for _ in range(n)]
    return [
        (i, " ".join("w" * (k % 5 + 1) for k in range(size)), rng.choice(sources))
        for i, size in enumerate(lengths)
    ]


@pytest.mark.parametrize("sources", [["b", "a", None, "ä", "Z"], ["s"], ["x"] * 20 + ["y", "z"]])
def test_mix_near_targets(spark, sources):
    rows = many(900, sources)
    got = mixing.mix(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    source, size = {r[0]: r[2] for r in rows}, {r[0]: len(r[1].split()) for r in rows}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.size == size[r.doc_id] and r.taken == r.copies * r.size and 0 <= r.copies <= 3
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
    want = plain_targets(sizes)
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        # Certain copies and at most one more.
        assert 0 <= r.copies - int(r.target / r.source_size + 1e-9) <= 1
    for s, target in want.items():
        assert abs(taken[s] - target) <= 2 + 0.01 * target
    again = mixing.mix(docs_of(spark, rows).repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mix_takes_by_pareto_rank(spark):
    """In a class of a source, what is taken once more are the first of the order."""
    rows = [(i, "w " * 5, "a" if i < 400 else "b") for i in range(650)]
    got = mixing.mix(docs_of(spark, rows)).collect()
    for part in ([r for r in got if r.doc_id < 400], [r for r in got if r.doc_id >= 400]):
        draw = {r.doc_id: int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:13], 16) for r in part}
        part.sort(key=lambda r: draw[r.doc_id])
        copies = [r.copies for r in part]
        assert copies == sorted(copies, reverse=True) and len(set(copies)) == 2
        assert abs(sum(r.taken for r in part) - part[0].target) <= 5


def test_mix_boost(spark):
    rows = [(i, "w " * (1 + i % 40), "a" if i % 4 else "b") for i in range(4000)]
    docs = docs_of(spark, rows)
    got = mixing.mix(docs, boost=F.when(F.col("doc_id") % 2 == 0, 4.0).when(F.col("doc_id") % 3 == 0, 1.0)).collect()
    words = defaultdict(int)
    for r in got:
        words["a" if r.doc_id % 4 else "b"] += r.taken
        assert r.copies <= 3
    for r in got:
        assert abs(words["a" if r.doc_id % 4 else "b"] - r.target) < 0.01 * r.target
    rate = [sum(r.taken for r in got if r.doc_id % 4 == k) / sum(r.size for r in got if r.doc_id % 4 == k) for k in (1, 2)]
    assert 2 < rate[1] / rate[0] < 4.5


def test_mix_defined_cases(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0
    rows = [(1, None, "a"), (2, "", None), (None, " \t ", "b")]
    assert {(r.size, r.target, r.taken) for r in mixing.mix(docs_of(spark, rows)).collect()} == {(0, 0.0, 0)}
    rows = [(None, "a b", None)] * 3 + [(5, "x" * 300_000 + " y", "s")] * 2 + [(6, None, "s")]
    got = mixing.mix(docs_of(spark, rows)).collect()
    assert len(got) == 6 and sum(r.size for r in got) == 10
    assert sum(r.taken for r in got) == pytest.approx(10, abs=3)


# Slots -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 50, 30_000])
def test_slots_are_minimal_and_verified(n):
    keys = np.frombuffer(random.Random(n).randbytes(16 * (n + 200)), np.uint64).reshape(-1, 2)
    table = slots.SlotTable(keys[:n])
    assert sorted(table.find(keys[:n])) == list(range(n))
    assert (table.find(keys[n:]) == -1).all()


def test_slots_refuse_equal_keys():
    with pytest.raises(ValueError, match="equal"):
        slots.SlotTable(np.ones((2, 2), np.uint64))


# Prefix trie -----------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, node string, depth int, chunk int"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS).repartition(3)


def plain_paths(rows, rebuilt=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            place = (turn is not None, turn or 0, role[:64].encode(), text[:64].encode(), digest)
            convs[c].append((place, (role, text)))
    own = {c: [t for _, t in sorted(x, key=lambda y: y[0])] for c, x in convs.items()}
    if not rebuilt:
        return own
    out = {}
    for c, turns in own.items():
        h, donor = zlib.crc32(str(c).encode()) % 4, c - int(np.fmod(c, 20))
        out[c] = own.get(donor, [])[:h] + turns[h:]
    return out


def plain_nodes(paths):
    members = defaultdict(list)
    for c, turns in sorted(paths.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    saved, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[x] for x in children[node])
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
    return sorted(
        (
            min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]),
            leaves[node], saved[node], sha(",".join(str(c) for c in m if len(paths[c]) == len(node))),
        )
        for node, m in members.items()
    )


def nodes_of(spark, rows, limit, rebuilt=True):
    turns = prefix_trie.ordered_turns(turns_of(spark, rows))
    conv = F.col("conv_id")
    paths = (
        prefix_trie.spliced(turns, F.crc32(conv.cast("string")) % 4, conv - conv % 20, 3)
        if rebuilt
        else prefix_trie.own_paths(turns)
    )
    return sorted(map(tuple, prefix_trie.prefix_nodes(paths, limit).collect()))


def talk(n, seed=3):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice("ua"), " ".join(rng.choices("xyz", k=rng.randrange(3))))
            for c in range(-30, n) for t in range(rng.randrange(7))]
    rows += [(c, t, "s", "the same start" if t < 2 else "and the same end")
             for c in range(n, 2 * n) for t in range(3)]
    return rows


@pytest.mark.parametrize("limit", [1, 40, 100_000])
def test_trie_is_the_plain_one(spark, limit):
    rows = talk(150)
    rows += [(7, 2, "u", "tie"), (7, 2, "u", "tie"), (7, None, None, "first"), (8, 1, "u", None)]
    rows += [(None, 1, "u", "of no conversation"), (9, 3, "u", "long " * 50_000), (10, 0, "é" * 70, "x")]
    assert nodes_of(spark, rows, limit) == plain_nodes(plain_paths(rows))


def test_trie_of_long_conversations(spark):
    """Conversations over several pieces, one sharing a long prefix with the other."""
    rows = [(c, t, "u", str(t if c < 3 or t < 1500 else -t)) for c in (1, 2, 5) for t in range(1000 * min(c, 3))]
    rows += [(9, t, "u", str(t)) for t in range(prefix_trie.CHUNK)]
    paths = plain_paths(rows, rebuilt=False)
    got = nodes_of(spark, rows, 500, rebuilt=False)
    assert [r[:5] for r in got] == sorted(plain_shape(paths)) and len(got) == 1 + 3000 + 500


def plain_shape(paths):
    """plain_nodes without the sums, for paths too long to keep all prefixes."""
    keys = defaultdict(list)
    for c, turns in sorted(paths.items()):
        state, parent = hashlib.sha256(), None
        for d in range(len(turns) + 1):
            keys[(d, state.hexdigest())].append((c, parent))
            parent = (d, state.hexdigest())
            if d < len(turns):
                state.update(repr(turns[d]).encode())
    children = defaultdict(int)
    for m in keys.values():
        children[m[0][1]] += 1
    return [
        (m[0][0], k[0], keys[m[0][1]][0][0] if m[0][1] else None, len(m), children[k])
        for k, m in keys.items()
    ]


def test_trie_of_nothing(spark):
    assert nodes_of(spark, [], 10) == []
    assert nodes_of(spark, [(None, 1, "u", "x")], 10) == []


# Merkle manifest -------------------------------------------------------------------------------

LEAVES = "doc_id long, source string, lang string, n_chars long, text string, leaf string, id int, idx int"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    forest, out = plain_tree([trees[g][-1][0] for g in names]), []
    for k, g in enumerate(names):
        for i, (_, _, leaf, row) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            changed = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                changed = (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))
            digest, siblings = plain_leaf(changed), ""
            for levels, at in ((trees[g], i), (forest, k)):
                for level in levels[:-1]:
                    lo = at // 8 * 8
                    run, place = level[lo : lo + 8], at % 8
                    siblings += "".join(run[:place] + run[place + 1 :])
                    digest = sha("".join([*run[:place], digest, *run[place + 1 :]]))
                    at //= 8
            root = forest[-1][0]
            out.append((row[0], leaf, trees[g][-1][0], root, sha(siblings), digest, digest == root))
    return sorted(out, key=str)


def manifest_of(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], LEAVES).repartition(3)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    got = merkle.manifest(docs, FIELDS, changes={"text": lower}, suspect=third)
    return sorted(map(tuple, got.collect()), key=str)


def leaves_of(n, langs, seed=5):
    rng = random.Random(seed)
    ids = rng.sample(range(-5 * n, 40 * n), n)
    return [(i, rng.choice(["s", None]), rng.choice(langs), i % 9, rng.choice("AbÉ") * (i % 4)) for i in ids]


@pytest.mark.parametrize(("n", "langs"), [(1, ["x"]), (8, ["x"]), (9, ["x"]), (65, ["x", None]),
                                          (700, ["en", "Z", "é", "", None]), (90, [f"l{k}" for k in range(80)])])
def test_manifest_is_the_plain_one(spark, n, langs):
    rows = leaves_of(n, langs)
    assert manifest_of(spark, rows) == plain_manifest(rows)


def test_manifest_of_several_blocks(spark):
    rows = leaves_of(merkle.BLOCK + 70, ["x"] * 50 + ["y"])
    assert manifest_of(spark, rows) == plain_manifest(rows)


def test_manifest_defined_cases(spark):
    assert manifest_of(spark, []) == []
    rows = leaves_of(40, ["x", None]) + [(None, None, None, None, None)] * 3 + [(None, "s", "x", 1, "A")]
    rows += [(-(1 << 63), "s", "x", 1, "A"), ((1 << 63) - 1, "s", "x", 1, "B" * 300_000)]
    rows += [(77, "s", "x", 1, "A")] * 2 + [(77, "t", "x", 1, "A"), (77, "s", None, 1, ""), (78, "s", "x", 1, None)]
    assert manifest_of(spark, rows) == plain_manifest(rows)


def test_proof_and_fold():
    way = "aa|bb/|cc/"
    assert merkle.proof(way) == sha("aabbcc")
    assert merkle.fold("d", way) == sha(sha("aadbb") + "cc")
