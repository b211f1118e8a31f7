"""Manifest, periodic runs and fingerprints against plain Python on small tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.test_operators import SCHEMA, SPACE, corpus, empty
from tideline.llm import fingerprints, merkle, periodic, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd_rows():
    """The corpus with rows without doc_id, of one doc_id, equal ones, no columns filled, and one long text."""
    rows = corpus(60)
    return rows + [(None, rows[3][1], "en", "s1", 4), (None, None, None, None, None), (7, "other text", "en", "s2", 1), *rows[10:13], rows[10], (5000, "wörd one two " * 20_000, "en", "s1", 9)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = odd_rows()
    clash = {c: F.lit("x") for c in ("grp", "pos", "node", "leaf", "bucket", "rn", "guest", "key", "x", "g", "runs", "h", "next_text")}
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns(clash).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))


# 11


def brute_leaf(row, text):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in (row[0], row[3], row[2], row[4], text)))


def brute_tree(nodes):
    """(root, proofs as pairs of left and right digests)."""
    at, proofs, level = list(range(len(nodes))), [[] for _ in nodes], nodes
    while len(level) > 1:
        for i, j in enumerate(at):
            run = j - j % 3
            proofs[i].append(("".join(level[run:j]), "".join(level[j + 1 : run + 3])))
        level = [sha("".join(level[k : k + 3])) for k in range(0, len(level), 3)]
        at = [j // 3 for j in at]
    return level[0], proofs


def brute_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, brute_leaf(r, r[1]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [(lambda g: (g, brute_tree([x[2] for x in g])))(sorted(groups[s], key=lambda x: x[:3])) for s in names]
    root, above = brute_tree([t[0] for _, t in trees])
    out = []
    for (g, (sub, proofs)), up in zip(trees, above):
        for (_, _, h, r), proof in zip(g, proofs):
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            at = brute_leaf(r, None if r[1] is None else r[1].replace("\n", "")) if even else h
            for left, right in proof + up:
                at = sha(left + at + right)
            out.append((r[0], h, sub, root, sha("".join(a + b for a, b in proof + up)), at, at == root))
    return sorted(out, key=str)


def write(df, path):
    df.write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("levels", [1, 5])
def test_manifest(spark, odd, tmp_path, monkeypatch, levels):
    """Blocks of 3 nodes take many rounds, blocks of 243 one or two."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", merkle.FAN**levels)
    rows, df = odd
    got = queries.op11_merkle_manifest(spark, write(df, tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == brute_manifest(rows)
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_small(spark, tmp_path):
    assert merkle.manifest(empty(spark)).count() == 0
    for n in (1, 2, 3, 4, 10, 28, 300):
        rows = [(i, f"t\n{i}", "en", None if n == 10 else "s", 1) for i in range(n)]
        got = queries.op11_merkle_manifest(spark, write(spark.createDataFrame(rows, SCHEMA).repartition(3), tmp_path / str(n))).collect()
        assert sorted(map(tuple, got), key=str) == brute_manifest(rows), n


def test_manifest_of_other_fields(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "a", "z")], "doc_id long, kind string, text string")
    got = merkle.manifest(df, "kind", ("doc_id", "text")).orderBy("doc_id").collect()
    leaves = [sha(f"1:{i}1:{t}") for i, t in ((1, "x"), (2, "y"), (3, "z"))]
    assert [r["leaf"] for r in got] == leaves and got[0]["subroot"] == sha(leaves[0] + leaves[2]) and got[0]["root"] == sha(sha(leaves[0] + leaves[2]) + leaves[1])


# 12


def brute_runs(w, least=12):
    """Every stretch in which words q apart agree, kept under its least period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def test_maximal_runs():
    r = random.Random(5)
    for _ in range(400):
        rows = []
        for _ in range(r.randint(1, 4)):
            n, k = r.randint(0, 60), r.choice([1, 2, 3, 8])
            w = [r.randrange(k) for _ in range(n)]
            if n and r.random() < 0.5:
                a = r.randrange(n)
                p = 1 + (n - a) // r.randint(2, 9)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            rows.append(w)
        at = np.cumsum([0, *map(len, rows)])
        symbols = np.array([x * 1000 + i for i, w in enumerate(rows) for x in w], np.uint64)
        end = np.repeat(at[1:], np.diff(at))
        least = r.choice([2, 4, 12])
        got = list(zip(*map(lambda x: x.tolist(), periodic.maximal_runs(symbols, end, max(map(len, rows)), least))))
        assert got == [(at[i] + s, at[i] + s + n, q) for i, w in enumerate(rows) for s, n, q in brute_runs(w, least)]


def fibonacci(n):
    a, b = "0", "01"
    while len(b) < n:
        a, b = b, b + a
    return np.frombuffer(b[:n].encode(), np.uint8).astype(np.uint64)


@pytest.mark.parametrize("make", [lambda n: np.zeros(n, np.uint64), fibonacci, lambda n: np.random.default_rng(1).zipf(1.3, n).astype(np.uint64)])
def test_long_texts_take_time_by_their_length(make):
    took = []
    for n in (50_000, 400_000):
        start = time.process_time()
        periodic.maximal_runs(make(n), np.full(n, n), n)
        took.append(time.process_time() - start)
    assert took[1] < 30 * max(took[0], 0.05)  # eight times the words; 64 times would be quadratic


def brute_periodic(doc_id, text):
    w = SPACE.findall(text or "")
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = [(0, 60_000, 3)] if len(w) == 60_000 else brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def test_periodic_query(spark, odd, tmp_path):
    rows, df = odd
    r = random.Random(3)
    more = [(i, " ".join(r.choice("ab c d".split()) + " " * (i % 2) for _ in range(r.randint(0, 120))), "en", "s", 0) for i in range(6000, 6120)]
    planted = [d for d, *_ in more if zlib.crc32(str(d).encode()) % 10 == 0]
    assert len(planted) > 5
    path = write(df.unionByName(spark.createDataFrame(more, SCHEMA), allowMissingColumns=True), tmp_path)
    got = queries.op12_periodic_runs(spark, path).collect()
    assert sorted(map(tuple, got), key=str) == sorted((brute_periodic(d, t) for d, t, *_ in rows + more), key=str)


def test_periodic_spans_and_texts(spark):
    df = spark.createDataFrame([(1, "x  a b a b\ta b a b a b a b y"), (2, None), (3, " \n"), (None, "a " * 12)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in periodic.find(df).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(1, 12, 2)] and got[1]["collapsed"] == "x a b y" and got[1]["n_words"] == 14
    assert got[2]["runs"] == got[3]["runs"] == [] and got[2]["collapsed"] == got[3]["collapsed"] == "" and got[None]["collapsed"] == "a"
    assert periodic.find(df.limit(0)).count() == 0


# 13


def hash64(*values):
    """Spark's xxhash64 of columns: each hash is the seed of the next."""
    h = 42
    for v in values:
        h = xxhash.xxh64(v, seed=h).intdigest()
    return h


def brute_print(text, cache={}):  # noqa: B006
    words = Counter(SPACE.findall(text or ""))
    if not words:
        return fingerprints.EMPTY
    best = [math.inf] * fingerprints.COORDINATES
    for word, n in words.items():
        x = hash64(word.encode())
        for k in range(fingerprints.COORDINATES):
            if (x, k) not in cache:
                a = hash64((x ^ k).to_bytes(8, "little"))
                b = hash64(a.to_bytes(8, "little"))
                u = lambda h, low, bits: ((h >> low & (1 << bits) - 1) + 0.5) * 2.0**-bits
                cache[x, k] = -math.log(u(a, 0, 32) * u(a, 32, 32)), math.log(-math.log(u(b, 0, 21) * u(b, 21, 21))), u(b, 42, 22)
            r, c, beta = cache[x, k]
            best[k] = min(best[k], c - r * (math.floor(math.log(n) / r + beta) - beta + 1))
    return best


def jaccard(a, b):
    a, b = Counter(SPACE.findall(a or "")), Counter(SPACE.findall(b or ""))
    return sum((a & b).values()) / (sum((a | b).values()) or 1) if a or b else 1.0


def brute_neighbours(rows):
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(hash64((r[1] or "").encode()))))
    out = []
    for r, s in zip(rows, rows[1:] + rows[:1]):
        t, nxt = r[1] or "", s[1] or ""
        m = len(t) // 4
        out.append((r[0], t, t[: len(t) - m] + nxt[:m], nxt))
    return out


def test_fingerprints(spark, odd, tmp_path):
    rows, df = odd
    got = sorted(queries.op13_document_fingerprints(spark, write(df, tmp_path)).collect(), key=lambda r: str((r["doc_id"], r["edited_sha256"])))
    want = sorted(brute_neighbours(rows), key=lambda r: str((r[0], sha(r[2]))))
    assert [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got] == [(d, len(t), sha(e)) for d, t, e, _ in want]
    prints, near, off = {}, [], []
    for r, (_, t, e, nxt) in zip(got, want):
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"] and prints.setdefault(e, r["edited_fingerprint"]) == r["edited_fingerprint"]
        assert len(r["fingerprint"]) == len(fingerprints.EMPTY) and re.fullmatch("[0-9a-f]+", r["fingerprint"])
        for other, value in ((e, r["near_edited"]), (nxt, r["near_next"])):
            near.append(value)
            off.append(value - jaccard(t, other))
            if not SPACE.search(t) or not SPACE.search(other):
                assert value == (1.0 if not SPACE.search(t + other) else 0.0)
    assert prints[""] == fingerprints.EMPTY
    # 64 coordinates: standard error 1/16 at most for each, far less for the mean
    assert max(map(abs, off)) < 0.3 and abs(float(np.mean(off))) < 0.02 and max(near) == 1.0
    # equal samples are equal codes: the likeness of two texts is that of their brute-force minima
    for r, (_, t, e, _) in list(zip(got, want))[:20]:
        a, b = brute_print(t), brute_print(e)
        if fingerprints.EMPTY not in (a, b):
            assert r["near_edited"] == sum(x == y for x, y in zip(a, b)) / fingerprints.COORDINATES


def test_fingerprints_estimate_generalised_jaccard(spark):
    """Weights matter: words that stand in both texts, but more often in one."""
    r, pairs = random.Random(1), []
    for i in range(150):
        base = Counter({f"w{i}.{k}": r.randint(1, 9) for k in range(30)})
        other = Counter({w: max(1, n + r.randint(-4, 4)) for w, n in base.items()})
        pairs.append(tuple(" ".join(c.elements()) for c in (base, other)))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id int, a string, b string")
    got = fingerprints.fingerprints(df, ["id"], ["a", "b"]).withColumn("near", fingerprints.likeness(F.col("a"), F.col("b"))).collect()
    off = [x["near"] - jaccard(*pairs[x["id"]]) for x in got]
    assert len(off) == 150 and abs(float(np.mean(off))) < 0.02 and float(np.std(off)) < 0.09


def test_fingerprint_cases(spark):
    assert fingerprints.compare(empty(spark)).count() == 0
    one = fingerprints.compare(spark.createDataFrame([(1, "a b c d", "en", "s", 7)], SCHEMA)).collect()[0]
    assert one["near_next"] == 1.0 and one["edited_sha256"] == sha("a b c " + "a")
    # a third of all rows are copies under one doc_id
    rows = [(5, "the same text again", "en", "s", 1)] * 300 + [(i, f"text {i} of many", "en", "s", 1) for i in range(600)]
    got = fingerprints.compare(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted((r["doc_id"], r["edited_sha256"]) for r in got) == sorted((d, sha(e)) for d, _, e, _ in brute_neighbours(rows))
