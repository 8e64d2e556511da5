"""op11 to op13 against brute force: prefix trie, Merkle witnesses, MinHash links."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import manifest, minhash, prefix_trie
from codeloom.llm.queries import op11, op12, op13

TURNS = "conv_id long, turn long, role string, text string"


# ---- prefix trie --------------------------------------------------------------


def brute_trie(rows):
    """Rebuilt conversations as tuples of turns, every prefix by a dictionary."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, ids in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(ids) - 1) * len(p[-1][1].encode()) if p else 0
    out = set()
    for p, ids in members.items():
        ends = ",".join(map(str, sorted(c for c in ids if built[c] == p)))
        up = min(members[p[:-1]]) if p else None
        out.add((min(ids), len(p), up, len(ids), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    assert len(out) == len(members)
    return out


def trie_rows(spark, rows, block, tmp_path):
    path = str(tmp_path / f"turns{block}")
    spark.createDataFrame(rows, TURNS).repartition(3).write.parquet(path)
    lists = prefix_trie.turn_lists(spark.read.parquet(path).withColumn("seq", F.lit("x")).withColumn("key", F.lit(1)))
    return [tuple(r) for r in prefix_trie.prefix_trie(prefix_trie.regrafted(lists), block=block).collect()]


def conversations(seed):
    """Shared openings of every length, copies, one long conversation and odd values."""
    rng, rows = random.Random(seed), []
    for c in range(-12, 120):
        if c % 11 == 7:
            continue
        n = rng.choice([1, 2, 3, 5, 8, 12])
        rows += [(c, k, "user" if k % 2 else "assistant", rng.choice(["a", "b", "long é text"]) if k > 2 else "same") for k in range(n)]
    rows += [(200, k, "user", f"t{k % 3}") for k in range(150)] + [(201, k, "user", f"t{k % 3}") for k in range(149)]
    rows += [(300, None, None, None), (300, None, "user", "x"), (300, 4, "user", "x"), (300, 4, "user", "x"), (305, 0, "", ""), (None, 1, "user", "lost")]
    for c in range(1000, 1400):  # a hot conversation
        rows += [(c, 0, "user", "hot"), (c, 1, "assistant", "hot answer")]
    return rows


@pytest.mark.parametrize("block", [2, 7, 8192])
def test_trie_against_brute_force(spark, tmp_path, block):
    rows = conversations(block)
    got = trie_rows(spark, rows, block, tmp_path)
    assert len(got) == len(set(got))
    assert set(got) == brute_trie(rows)


def test_trie_of_few_conversations(spark, tmp_path):
    assert trie_rows(spark, [], 2, tmp_path) == []
    one = [(4, 0, "user", "hi")]
    assert set(trie_rows(spark, one, 3, tmp_path)) == brute_trie(one)  # its first turn is taken from conversation 0
    same = [(c, 0, "user", "hi") for c in range(7)]
    assert set(trie_rows(spark, same, 4, tmp_path)) == brute_trie(same)


def test_ids_of_a_hot_end_are_joined_in_chunks():
    import pyarrow as pa

    def batches(size):
        rows = [("a", 7)] + [("b", k) for k in range(5000)] + [("c", 1), ("c", 2)]
        for a in range(0, len(rows), size):
            yield pa.RecordBatch.from_pylist([{"key": k, "conv_id": c} for k, c in rows[a : a + size]])

    for size in (1, 1000, 100000):
        chunks = [r for b in prefix_trie._joined_ids(batches(size)) for r in b.to_pylist()]
        assert [r["first"] for r in chunks if r["key"] == "b"] == [0, 2048, 4096]
        hashed = {r["key"]: r["ends"] for b in prefix_trie._hashed_ids(iter([pa.RecordBatch.from_pylist(chunks)])) for r in b.to_pylist()}
        assert hashed == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in (("a", "7"), ("b", ",".join(map(str, range(5000)))), ("c", "1,2"))}


def test_range_minima():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 64, 100):
        values = rng.integers(0, 6, n)
        table = prefix_trie.RangeMinima(values)
        for a in range(n):
            for b in range(a + 1, n + 1):
                assert table.least(np.array([a]), np.array([b]))[0] == values[a:b].min()
        for depth in range(7):
            for a in range(n + 1):
                up = next((k for k in range(a, n) if values[k] < depth), n) - a
                down = a - next((k + 1 for k in range(a - 1, -1, -1) if values[k] < depth), 0)
                assert table.reach(np.array([a]), np.array([depth]), 1)[0] == up
                assert table.reach(np.array([a]), np.array([depth]), -1)[0] == down


# ---- manifest -----------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(leaves):
    """Root and, per leaf, (siblings before, siblings after) by level."""
    ways = [[] for _ in leaves]
    level, owner = list(leaves), [[k] for k in range(len(leaves))]
    while len(level) > 1:
        ups, owners = [], []
        for a in range(0, len(level), 8):
            run = level[a : a + 8]
            for k in range(len(run)):
                for leaf in owner[a + k]:
                    ways[leaf].append((run[:k], run[k + 1 :]))
            ups.append(sha("".join(run)))
            owners.append([x for o in owner[a : a + 8] for x in o])
        level, owner = ups, owners
    return level[0], ways


def brute_manifest(rows):
    """rows: (key, group, leaf, probe)."""
    groups = sorted({g for _, g, _, _ in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in groups:
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[g] = (own, *brute_tree([r[2] for r in own]))
    root, tops = brute_tree([trees[g][1] for g in groups])
    out = []
    for g, top in zip(groups, tops):
        own, subroot, ways = trees[g]
        for (key, _, leaf, probe), way in zip(own, ways):
            cur, proof = probe, ""
            for before, after in way + top:
                cur = sha("".join(before) + cur + "".join(after))
                proof += "".join(before) + "".join(after)
            out.append((key, leaf, subroot, root, sha(proof), cur, cur == root))
    return sorted(map(str, out))


def test_manifest_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for g, n in ((None, 9), ("", 1), ("de", 64), ("en", 700), ("zé", 8), *((f"g{k}", 1 + k % 3) for k in range(20))):
        for k in range(n):
            leaf = sha(f"{g}{k}")
            rows.append((rng.choice([k, None]) if k % 50 == 3 else k, g, leaf, leaf if k % 3 else sha("changed")))
    rows += [rows[10], rows[10], (5, "en", sha("another of five"), sha("x"))]
    frame = spark.createDataFrame(rows, "key long, lang string, leaf string, probe string").withColumn("place", F.lit(1)).withColumn("g", F.lit("x"))
    want = brute_manifest(rows)
    for levels in (1, 2, 4):  # blocks of 8, 64 and 4,096 leaves
        got = manifest.manifest(frame.repartition(5), group="lang", key="key", leaf="leaf", probe="probe", with_witness=True, levels=levels).collect()
        assert sorted(str(tuple(r)[:7]) for r in got) == want
        for r in got:
            assert manifest.fold(r["leaf"], manifest.steps(r["witness"])) == r["root"]


def test_manifest_of_few_rows(spark):
    shape = "key string, lang string, leaf string, probe string"
    assert manifest.manifest(spark.createDataFrame([], shape), group="lang", key="key", leaf="leaf", probe="probe").collect() == []
    lone = spark.createDataFrame([("a", None, sha("x"), sha("x"))], shape)  # a text as key
    (row,) = manifest.manifest(lone, group="lang", key="key", leaf="leaf", probe="probe").collect()
    assert tuple(row) == ("a", sha("x"), sha("x"), sha("x"), sha(""), sha("x"), True)


def test_leaf_hash_of_nulls_and_bytes(spark):
    frame = spark.createDataFrame([(7, None, "é"), (None, "", "a:b")], "n long, s string, t string")
    got = [r[0] for r in frame.select(manifest.leaf_hash([F.col("n"), F.col("s"), F.col("t")])).collect()]
    assert got == [sha("1:7-2:é"), sha("-0:3:a:b")]


# ---- MinHash --------------------------------------------------------------------


def brute_links(rows, percent=85):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset())
    up = list(range(len(rows)))

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and both:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    names = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[find(k)].append(i)
    return sorted(str((i, len(sets[k]), min(names[find(k)], default=None))) for k, (i, _) in enumerate(rows))


def near_rows():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    rows = []
    for k in range(260):  # a large group of near copies, some of them too far from most
        own = base[:]
        for _ in range(rng.choice([1, 2, 4, 6, 9, 12])):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rows.append((k, " ".join(own)))
    for k in range(300, 420):  # families of a few
        if k % 4 == 0:
            own = [rng.choice(vocabulary) for _ in range(rng.choice([2, 3, 5, 20, 60, 400]))]
        if k % 4 and len(own) > 8:
            own = own[: -(k % 4)]
        rows.append((k, " ".join(own)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "A b"), (504, "a B"), (505, "a"), (None, "a b"), (None, rows[0][1]), (None, "only here"),
             (506, "only here now"), (506, rows[300][1]), (506, rows[300][1]), (507, " ".join(vocabulary * 12))]
    return rows


def test_near_duplicates_against_brute_force(spark, tmp_path, monkeypatch):
    rows = near_rows()
    path = str(tmp_path / "near")
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x")).withColumn("sig", F.lit(0)).repartition(4).write.parquet(path)
    want = brute_links(rows)
    for small, block in ((minhash.SMALL, minhash.BLOCK), (4, 8)):
        monkeypatch.setattr(minhash, "SMALL", small)
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = minhash.near_duplicates(spark.read.parquet(path)).collect()
        assert sorted(str(tuple(r)) for r in got) == want


def test_near_duplicates_of_text_ids_and_of_nothing(spark):
    shape = "doc_id string, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], shape)).collect() == []
    got = minhash.near_duplicates(spark.createDataFrame([("b", "x y z"), ("a", "X  Y\tZ"), ("c", None)], shape)).collect()
    assert sorted(map(tuple, got)) == [("a", 1, "a"), ("b", 1, "a"), ("c", 0, "c")]


def test_sequential_verification():
    need = minhash.fewest_matches(0.85)
    assert len(need) == minhash.HASHES // minhash.BATCH and need == sorted(need)
    from math import comb

    # a pair at the limit is lost with about the miss probability
    lost = sum(comb(25, m) * 0.85**m * 0.15 ** (25 - m) for m in range(need[0]))
    assert lost < 10 * minhash.MISS
    rng = np.random.default_rng(3)
    left = rng.integers(0, 256, (200, minhash.HASHES)).astype(np.uint8)
    right = np.where(rng.random(left.shape) < np.linspace(0, 1, 200)[:, None], left, left + 1).astype(np.uint8)
    same = (left == right).reshape(200, -1, minhash.BATCH).sum(axis=2).cumsum(axis=1)
    assert set(minhash.survivors(left, right, need)) == set(np.flatnonzero((same >= np.array(need)).all(axis=1)))


# ---- registered queries -----------------------------------------------------------


@pytest.mark.parametrize("run, columns", [
    (op11, "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256"),
    (op12, "doc_id leaf subroot root proof_sha256 folded_root verified"),
    (op13, "doc_id n_shingles component_id kept"),
])
def test_queries_match_their_oracles(spark, run, columns):
    import os

    import duckdb

    from codeloom.llm.registry import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    frame = run(spark, sf)
    assert frame.columns[: len(columns.split())] == columns.split()
    connection = duckdb.connect()
    for name in os.listdir(sf):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    name = next(n for n, q in QUERIES.items() if q is run)
    cursor = connection.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(map(str, cursor.fetchall())) == sorted(str(tuple(r)) for r in frame.select(*names).collect())
