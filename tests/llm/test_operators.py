"""The ten operators against plain Python on small tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.llm import decontaminate, license_scan, lm_score, minhash, mixing, packed, phrases, quality, sharding, tokens, toxicity, url_filter
from tideline.llm.components import components

SPACE, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def corpus(n=120, seed=3, words=60):
    """Documents with copies, near copies, shared passages, repeats, odd blanks, nulls and empty texts."""
    r = random.Random(seed)
    vocab = [f"{a}{b}" for a in "ab cd éf gh ij kl mn".split() for b in "xyzuvwst"]
    sentence = lambda k: [r.choice(vocab) for _ in range(k)]
    shared = [sentence(r.randint(15, 60)) for _ in range(6)]
    out = []
    for i in range(n):
        w = sentence(r.randint(0, words * 2))
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(w))
            p = r.choice(shared)
            w[at:at] = p[: r.randint(5, len(p))]
        if i % 9 == 0:
            w = w + w[:30]
        t = "".join(x + r.choice([" ", " ", " ", "\n", "\t ", "  ", ". "]) for x in w)
        if i % 7 == 3 and out:
            t = out[r.randrange(len(out))][1]
        if i % 11 == 5 and out and out[-1][1]:
            old = out[-1][1].split(" ")
            old[r.randrange(len(old))] = "Edited"
            t = " ".join(old)
        out.append((i, t, r.choice(["en", "de", None]), r.choice(["s1", "s2", "é", None]), len(t or "")))
    out += [(n, None, None, None, None), (n + 1, "", "en", "s1", 0), (n + 2, " \n\t", "en", "s1", 3), (n + 3, "The ONE", "xx", "s9", 7)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words(docs):
    import pyarrow as pa

    for word, pattern, prepare in (("space", SPACE, str), ("alnum", ALNUM, lower), ("lower", SPACE, lower)):
        texts = [t for _, t, *_ in docs[0]]
        batch = pa.RecordBatch.from_pydict({"text": texts}).slice(1)
        seen, by_hash, i = [], {}, 1
        for _, w in tokens.slices(batch, "text", word, limit=500):
            for k in range(w.n_rows):
                mine = pattern.findall(prepare(texts[i] or ""))
                got = w.hash[w.first[k] : w.first[k + 1]].tolist()
                assert len(got) == len(mine)
                for x, h in zip(mine, got):
                    assert by_hash.setdefault(h, x) == x
                seen += got
                i += 1
        assert i == len(texts) and len(set(by_hash.values())) == len(by_hash)


def test_grams_and_minima():
    w = tokens.Words(np.frombuffer(b"a b c a b c d", np.uint8), np.array([0, 5, 13]), "space")
    g, ok = w.grams(3)
    assert ok.tolist() == [True, False, False, True, True, False, False] and g[0] == g[3] != g[4]
    x = np.array([5, 3, 9, 1, 7, 8, 2], np.uint64)
    assert tokens.sliding_min(x, 3)[:5].tolist() == [3, 1, 1, 1, 2]


# 1


def test_url_filter(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]
    urls = ["http://WWW.Example.com/en/1?x#y", "https://a.example.com/en/", "http://example.com", "ftp://x.net/es/q", "http://y.org/p/?utm_a=1&b=2", "https://www.y.org/p?b=2#f", "http://y.org/p?b=3", "none", None, "http://É.org/", "http://notexample.com/en/", "http://y.org/p?b=2", "http://y.org/p?b=2"]
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    listed = spark.createDataFrame([("https://y.org/p/?b=2",), (None,), ("http://y.org/p?b=2",)], "url string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, listed, rules).collect()}
    assert len(got) == len(urls)
    assert [got[i]["host"] for i in range(10)] == ["www.example.com", "a.example.com", "example.com", "x.net", "y.org", "www.y.org", "y.org", "", "", "É.org"]
    assert [got[i]["path"] for i in range(5)] == ["/en/1", "/en/", "", "/es/q", "/p/"]
    assert [got[i]["rule"] for i in range(11)] == ["www.example.com/en/", "example.com/en/", None, "net/es/", None, None, None, None, None, None, "com/"]
    assert [got[i]["verdict"] for i in range(13)] == ["allow", "block", "allow", "block", "block", "block", "allow", "allow", "allow", "allow", "allow", "block", "block"]
    assert url_filter.judge(pages.limit(0), listed, rules).count() == 0
    none = url_filter.judge(pages, listed.limit(0), [])
    assert none.where("verdict = 'block'").count() == 0 and none.count() == len(urls)


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h.org/"), "id").alias("url"))
    pages = keys.select(F.monotonically_increasing_id().alias("page_id"), F.concat(F.lit("http://"), "url").alias("url"))
    other = spark.range(3000, 6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.org/"), "id").alias("url"))
    listed = keys.select(F.concat(F.lit("https://"), "url").alias("url"))
    for blocks in (1, 64, 4096):
        got = url_filter.judge(pages.union(other), listed, n_blocks=blocks).groupBy("verdict").count().collect()
        assert {r["verdict"]: r["count"] for r in got} == {"block": 3000, "allow": 3000}
    assert url_filter.bloom(keys, "url", 64).count() <= 64


# 2


def brute_lm(rows, good, mu, kept):
    """Sorted (doc_id, n_tokens, target loss, background loss), by the formula of the docstring."""
    seqs = [(d, [None, *SPACE.findall(lower(t or ""))]) for d, t, *_ in rows]
    every = Counter(p for _, s in seqs for p in zip(s, s[1:]))
    target = Counter(p for d, s in seqs if d in good for p in zip(s, s[1:]))
    n, words = sum(every.values()), len({w for _, w in every})
    use = {p for p, c in every.items() if c >= max(2, n / kept)}
    total = sum(target.values()) or n
    loss = []
    for c in (target, every):
        f = total / sum(c.values()) if c else 0.0
        one, mass = Counter(), Counter()
        for (v, w), k in c.items():
            one[w] += k * f
            mass[v] += k * f if (v, w) in use else 0
        z = (total if c else 0) + words
        loss.append(lambda v, w, c=c, f=f, one=one, mass=mass, z=z: -np.log2((c[v, w] * f * ((v, w) in use) + mu * (one[w] + 1) / z) / (mass[v] + mu)))
    mean = lambda s, f: round(float(np.mean([f(v, w) for v, w in zip(s, s[1:])])), 6) if len(s) > 1 else None
    return sorted(((d, len(s) - 1, *(mean(s, f) for f in loss)) for d, s in seqs), key=str), words


@pytest.mark.parametrize("kept", [20, 1 << 20])
def test_lm_score(spark, docs, kept):
    rows, df = docs
    more = [(None, rows[5][1], "en", "s", 1), (None, None, "en", "s", 1), *rows[20:30], (7, rows[40][1], "en", "s", 1), (901, "zz " * 20_000, "en", "s", 1)]
    rows, df = rows + more, df.union(spark.createDataFrame(more, SCHEMA)).withColumns({"row": F.lit("x"), "t": F.lit(None)})
    good = {d for d, *_ in rows if d is not None and d % 3 == 0}
    labels = spark.createDataFrame([(g,) for g in [*good, *good, None, 12345]], "doc_id long")
    got = lm_score.cross_entropy_difference(df, labels, 5.0, kept).collect()
    shown = sorted(((r["doc_id"], r["n_tokens"], *(None if v is None else round(v, 6) for v in r[2:4])) for r in got), key=str)
    assert shown == brute_lm(rows, good, 5.0, kept)[0]
    assert all(r["difference"] == (None if r[2] is None else pytest.approx(r[2] - r[3])) for r in got)
    if kept > 20:
        assert lm_score.cross_entropy_difference(empty(spark), df).count() == 0
        assert lm_score.cross_entropy_difference(df, empty(spark)).count() == len(rows)


def test_lm_score_keeps_every_word(spark):
    """More words than any fixed vocabulary had: documents that differ in rare words only differ in their scores."""
    rows = [(i, " ".join(f"w{j}" for j in range(i * 50, i * 50 + 50)), "en", "s", 1) for i in range(40)]
    rows += [(100, "the rareone thing", "en", "s", 1), (101, "the raretwo thing", "en", "s", 1), (None, "the rareone thing", "en", "s", 1), (None, None, "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    good = {100, *range(0, 40, 2)}
    got = lm_score.cross_entropy_difference(df, spark.createDataFrame([(g,) for g in good], "doc_id long")).collect()
    want, words = brute_lm(rows, good, lm_score.MU, lm_score.KEPT)
    assert sorted(((x[0], x[1], *(None if v is None else round(v, 6) for v in x[2:4])) for x in got), key=str) == want and words > 2000
    by = {x["doc_id"]: x["difference"] for x in got}
    assert by[100] < by[101]


def test_lm_score_prunes_no_bigram_by_share(spark):
    """Over two million words a bigram seen twice had less than one in 2^20 places and was dropped, however rare its first word."""
    rows = [(i, " ".join(f"a{(i * 7 + j) % 90}" for j in range(70_000)), "en", "s", 1) for i in range(45)]
    rows += [(100, "only here", "en", "s", 1), (101, "only here", "en", "s", 1), (102, "here only", "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["doc_id"]: r["background_loss"] for r in lm_score.cross_entropy_difference(df, spark.createDataFrame([(100,)], "doc_id long")).collect()}
    want = {d: b for d, _, _, b in brute_lm(rows, {100}, lm_score.MU, 1 << 30)[0]}
    assert {d: round(b, 6) for d, b in got.items()} == want and got[100] < got[102]


@pytest.mark.parametrize("held", [0, 12])
def test_lm_score_joins_what_tasks_do_not_hold(spark, docs, held):
    rows, df = docs
    good = {d for d, *_ in rows if d is not None and d % 3 == 0}
    got = lm_score.cross_entropy_difference(df, spark.createDataFrame([(g,) for g in good], "doc_id long"), 5.0, held=held).collect()
    shown = sorted(((r["doc_id"], r["n_tokens"], *(None if v is None else round(v, 6) for v in r[2:4])) for r in got), key=str)
    assert shown == brute_lm(rows, good, 5.0, 1 << 30)[0]


def test_packed_pairs_are_what_they_were():
    """Bigrams of numbers and of hashes, with all counts, in blobs of any length; one of frequent words takes some seven bytes."""
    r = np.random.default_rng(3)
    v = np.r_[r.integers(0, 50, 2000), r.integers(0, 1 << 63, 700), 0, -1].astype(np.int64).view(np.uint64)
    w = np.r_[r.integers(0, 1 << 19, 2000), r.integers(-(1 << 63), 1 << 63, 700), 0, -1].astype(np.int64).view(np.uint64)
    ends = np.array([0, 1, 900, len(v)])
    order = np.concatenate([a + np.lexsort((w[a:b], v[a:b])) for a, b in zip(ends, ends[1:])])
    n, t = np.where(np.arange(len(v)) % 9, 0, r.integers(0, 1 << 40, len(v))).astype(np.uint64), r.integers(0, 3, len(v)).astype(np.uint64)
    table = pa.table(packed.pack_pairs(ends, v[order], w[order], n, t), ["lengths", "more", "data"])
    got_ends, got = packed.unpack_pairs(pa.concat_tables([table.slice(2), table.slice(0, 2)]))
    turned = np.r_[ends[2] : ends[3], 0 : ends[2]]
    assert got_ends.tolist() == [0, *np.cumsum(np.diff(ends)[[2, 0, 1]])]
    assert all((x == y[turned]).all() for x, y in zip(got, (v[order], w[order], n, t)))
    key = np.sort(r.integers(0, 1 << 38, 4000).astype(np.uint64))
    blobs = packed.pack_pairs(np.array([0, len(key)]), key >> np.uint64(19), key & np.uint64((1 << 19) - 1), *np.zeros((2, len(key)), np.uint64))
    assert sum(len(x[0].as_py()) for x in blobs) < 7 * len(key)


def test_lm_score_buckets():
    """Each bigram lies in one bucket, whoever sends it; matches are exact for numbers and for hashes."""
    r = np.random.default_rng(5)
    v, w = (np.r_[r.integers(0, 40, 3000), r.integers(0, 1 << 62, 500)].astype(np.uint64) for _ in range(2))
    v, w = np.unique(np.c_[v, w], axis=0).T
    x, y = np.arange(len(v)).astype(np.uint64), np.zeros(len(v), np.uint64)
    for n_buckets in (1, 7, 1 << 20):
        where = {}
        for part in (slice(0, 2000), slice(1000, None)):
            bucket, *blobs = lm_score.bucketed(v[part], w[part], x[part], y[part], n_buckets, 6)
            ends, got = packed.unpack_pairs(pa.table(blobs, packed.NAMES))
            assert len(set(bucket.to_pylist())) == len(bucket) and sorted(got[2].tolist()) == x[part].tolist()
            assert (v[got[2].view(np.int64)] == got[0]).all() and (w[got[2].view(np.int64)] == got[1]).all()
            for i, b in zip(got[2].tolist(), np.repeat(bucket.to_numpy(), np.diff(ends)).tolist()):
                assert where.setdefault(i, b) == b < n_buckets
    some = r.permutation(len(v))[: len(v) // 2]
    asked = r.integers(0, len(v), 4000)
    at = lm_score.matches(v[asked], w[asked], v[some], w[some], 6)
    place = {int(i): k for k, i in enumerate(some)}
    assert at.tolist() == [place.get(int(i), -1) for i in asked]
    assert lm_score.buckets(0) == 1 and lm_score.buckets(10**13) * (1 << 22) > 10**13


def test_lm_score_shuffles_few_bytes(spark):
    """Bigrams were rows of three or four long numbers in two shuffles: eleven bytes for each word of such texts in all shuffles."""
    r = np.random.default_rng(8)
    words = (r.random((1500, 200)) ** 2 * 6000).astype(int)
    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in x), "en", "s", 1) for i, x in enumerate(words.tolist())], SCHEMA).repartition(3)
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(True).apply(0).totalShuffleWrite()

    df = df.localCheckpoint()
    before = written()
    got = lm_score.cross_entropy_difference(df, df.select("doc_id").where("doc_id % 2 = 0"), held=12_000)
    assert got.where("background_loss > 0").count() == 1500
    assert 0 < (written() - before) / words.size < 7


# 3


def fill(sizes):
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, full = sum(sizes.values()), {}
    while True:
        rest = {s for s in sizes if s not in full}
        left, w = total - sum(full.values()), sum(weights[s] for s in rest)
        share = {s: left * weights[s] / w for s in rest} if w else {}
        over = {s for s in rest if share[s] > 3 * sizes[s]}
        if not over:
            return full | share
        full |= {s: 3.0 * sizes[s] for s in over}


def test_mixing(spark, docs):
    rows, df = docs
    got = mixing.mix(df).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, *_ in rows)
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(SPACE.findall(t or ""))
    want, taken = fill(sizes), Counter()
    by = {r["doc_id"]: r for r in got}
    for d, t, _, s, _ in rows:
        r = by[d]
        assert r["size"] == len(SPACE.findall(t or "")) and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] == 0 if not r["size"] else r["taken"] % r["size"] == 0
        taken[s] += r["taken"]
    longest = max(r["size"] for r in got)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest + 1
    assert sum(taken.values()) <= sum(sizes.values())
    again = mixing.mix(df.repartition(7)).collect()
    assert {r["doc_id"]: r["taken"] for r in again} == {d: r["taken"] for d, r in by.items()}
    copies = Counter(r["doc_id"] for r in mixing.apply(df).collect())
    assert all(copies[d] * r["size"] == r["taken"] for d, r in by.items())
    assert mixing.mix(empty(spark)).count() == 0 and mixing.apply(empty(spark)).count() == 0


def test_mixing_with_sources_that_fill_up(spark):
    rows = [(i, "w " * (1 + i % 5), "en", "a" if i < 4 else "b" if i < 40 else "c" if i < 50 else None, 1) for i in range(60)]
    df = spark.createDataFrame(rows + rows[:2], SCHEMA)
    sizes = Counter()
    for _, t, _, s, _ in rows + rows[:2]:
        sizes[s] += len(t.split())
    got = mixing.mix(df).collect()
    want = fill(sizes)
    assert len(got) == 62 and all(r["target"] == pytest.approx(want[r["source"]]) for r in got)
    for s in sizes:
        assert sum(r["taken"] for r in got if r["source"] == s) == pytest.approx(want[s], abs=6)
    assert mixing.apply(df).count() == sum(r["taken"] // r["size"] for r in got)


def test_mixing_keeps_every_row(spark):
    rows = [(None, None, "en", "a", 1)] * 3 + [(None, "", "en", "a", 0)] * 2 + [(4, "w w w", "en", "b", 3)] * 2 + [(4, "w w", "en", "b", 3), (5, "w " * 30_000, "en", None, 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"size": F.lit("x"), "taken": F.lit(None), "_n": F.lit(1)})
    got = mixing.mix(df).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter({(None, 0): 5, (4, 3): 2, (4, 2): 1, (5, 30_000): 1})
    out = mixing.apply(df)
    assert out.columns == df.columns and out.count() == sum(r["taken"] // r["size"] for r in got if r["size"])


# 4


def test_license_scan(spark):
    filler = [f"w{i % 13}" for i in range(60)]
    rows = []
    for i, (name, t) in enumerate(license_scan.TEMPLATES.items()):
        rows.append((i, " ".join(filler[:i * 4]) + "\n" + t + "\n" + " ".join(filler), name))
    n = len(rows)
    mit = license_scan.TEMPLATES["mit"].split()
    rows += [(n, " ".join(mit[:20] + ["really"] + mit[20:]), "mit"), (n + 1, " ".join(filler), None), (n + 2, None, None), (n + 3, "", None), (n + 4, " ".join(mit[: len(mit) // 2]), None)]
    rows += [(n + 5, "Released under the MIT License. Released under the MIT License.", "mit-notice"), (n + 6, "released UNDER the mit license", "mit-notice")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    assert {d: r["license"] for d, r in got.items()} == {d: x for d, _, x in rows}
    for d, r in got.items():
        if r["license"]:
            words = ALNUM.findall(lower(rows[d][1]))
            assert words[r["start"]] == ALNUM.findall(lower(license_scan.TEMPLATES[r["license"]]))[0]
    assert license_scan.scan(df.limit(0)).count() == 0


def common_run(a, b):
    """The length of the longest common subsequence."""
    best = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b):
            old, best[j + 1] = best[j + 1], old + 1 if x == y else max(best[j], best[j + 1])
    return best[-1]


def test_license_scan_finds_every_place(spark):
    """Licenses twice, two in one text, with foreign words inside and edited, against the longest common subsequence."""
    r = random.Random(12)
    words = {k: ALNUM.findall(lower(t)) for k, t in license_scan.TEMPLATES.items()}
    filler = [f"w{i}" for i in range(300)] + "the of software version rights license work this to in".split()
    fill = lambda n: [r.choice(filler) for _ in range(n)]
    rows, want = [], {}
    for i in range(60):
        t, places = fill(r.randint(0, 60)), []
        for name in r.sample(["mit", "gpl-3.0", "isc", "bsd-3-clause", "mpl-2.0"], r.randint(0, 2)):
            for _ in range(r.choice([1, 1, 2])):
                w = list(words[name])
                for _ in range(r.randint(0, 3)):
                    w[r.randrange(1, len(w) - 1)] = f"x{r.randrange(99)}"
                if r.random() < 0.3:
                    k = r.randrange(9, len(w) - 9)
                    w[k:k] = [r.choice(filler[:300]) for _ in range(100)]
                places.append((name, len(t), len(t) + len(w), common_run(words[name], w) / len(words[name])))
                t += w + [r.choice(filler[:300]) for _ in range(r.randint(40, 90))]
        rows.append((i, " ".join(t)))
        want[i] = places
    rows += [(None, license_scan.TEMPLATES["mit"]), (None, None), (70, license_scan.TEMPLATES["mit"]), (70, license_scan.TEMPLATES["mit"]), (71, "this work is under a 4 0"), (72, " ".join(fill(20_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit(1))
    out = license_scan.scan(df).collect()
    assert Counter(x["doc_id"] for x in out) == Counter(d for d, _ in rows)
    got = {x["doc_id"]: x for x in out if x["doc_id"] is not None}
    for d, places in want.items():
        near = lambda f, x: f["license"] == x[0] and abs(f["start"] - x[1]) <= 12 and abs(f["end"] - x[2]) <= 12 and x[3] - 0.2 <= f["coverage"] <= x[3] + 0.06
        assert all(any(near(f, x) for x in places) for f in got[d]["found"])
        # patience may miss a little of the longest: what is edited most may stay below the threshold
        assert all(any(near(f, x) for f in got[d]["found"]) for x in places if x[3] >= 0.93)
        assert (got[d]["license"] is None) == (not got[d]["found"])
    assert sorted(str(x["license"]) for x in out if x["doc_id"] is None) == ["None", "mit"] and got[70]["license"] == "mit"
    assert got[71]["license"] is None and got[71]["coverage"] is None and got[72]["license"] is None
    cut = " ".join(words["mit"][:30] + ["foreign"] * 200 + words["mit"][30:])
    x = license_scan.scan(spark.createDataFrame([(1, cut)], "doc_id long, text string")).first()
    assert x["license"] == "mit" and x["coverage"] == 1.0


def test_patience():
    r = random.Random(5)
    for _ in range(200):
        p = [(i, r.randrange(20)) for i in range(r.randrange(12))]
        got = license_scan.increasing(p)
        assert all(a < b and c < d for (a, c), (b, d) in zip(got, got[1:]))
        best = [1] * len(p)
        for i in range(len(p)):
            best[i] = 1 + max([best[j] for j in range(i) if p[j][1] < p[i][1]], default=0)
        assert len(got) == max(best, default=0)
        a, b = [r.randrange(6) for _ in range(10)], [r.randrange(6) for _ in range(14)]
        m = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in m) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:]))
    assert license_scan.align([1, 2, 3], [9, 1, 2, 3, 9]) == [(0, 1), (1, 2), (2, 3)]


# 5


def brute_quality(t):
    w = SPACE.findall(t or "")
    lines = [x for x in (t or "").split("\n") if SPACE.search(x)]
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    hit = {i + j for p in at.values() if len(p) > 1 for i in p for j in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


def test_quality(spark, docs):
    rows, df = docs
    more = [(900, "a b c d e f g h " * 5 + "x y z " * 20, "en", "s", 1), (901, "# | " * 100, "en", "s", 1), (902, "\n".join(["same line"] * 4 + ["  ", "  ", "other"]), None, "s", 1), (903, "é" * 5000 + " ü", "de", None, 1)]
    rows, df = rows + more, df.union(spark.createDataFrame(more, SCHEMA))
    got = {r["doc_id"]: r for r in quality.judge(df.withColumn("_l", F.lit(1)).withColumn("n_words", F.lit("x"))).collect()}
    assert len(got) == len(rows)
    for d, t, *_ in rows:
        n, chars, symbols, lines, rep = brute_quality(t)
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, rep), (d, t)
        assert r["base_failed"] == (n < 20 or 100 * rep > 30 * n) and not (r["base_failed"] and r["kept"])
    assert quality.judge(empty(spark)).count() == 0


def test_quality_keep(spark, docs):
    rows, df = docs
    odd = df.withColumn("kept", F.lit("x")).withColumn("_row", F.lit(-1))  # names that the operator itself uses
    kept = quality.keep(odd)
    want = Counter(x["doc_id"] for x in quality.judge(df).collect() if x["kept"])
    assert kept.columns == odd.columns and Counter(x["doc_id"] for x in kept.collect()) == want and 0 < len(want) < len(rows)
    assert quality.keep(empty(spark)).count() == 0


def test_quality_rejects_texts_without_common_words(spark):
    """Lists of keywords go, prose of each language stays, also of more languages than are broadcast."""
    r = random.Random(9)
    common = {"en": quality.COMMON[:25], "de": quality.COMMON[48:70]}
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(3, 9)))
    prose = lambda c, n: " ".join(r.choice(c) if r.random() < 0.3 else word() + ("." if r.random() < 0.1 else "") for _ in range(n)).capitalize() + "."
    rows = [(i, prose(common[lang], r.randint(120, 400)), lang, "s", 1) for i, lang in enumerate(["en", "de"] * 40)]
    rows += [(200 + i, " ".join(word() for _ in range(200)).capitalize() + ".", lang, "s", 1) for i, lang in enumerate(["en", "de", None])]
    rows += [(None, rows[0][1], "en", "s", 1), (400, prose(common["en"], 20_000), "en", "s", 1)]
    rare = [(1000 + i, prose(common["en"], 110), f"x{i}", "s", 1) for i in range(12)]
    kept = {x["doc_id"] for x in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect() if x["kept"]}
    assert kept == {x[0] for x in rows} - {200, 201, 202}
    got = [x for x in quality.judge(spark.createDataFrame(rows[:80] + [(500, " ".join(x[1] for x in rows[:80]) * 4, "en", "s", 1)] + rare, SCHEMA)).collect() if (x["doc_id"] or 0) >= 1000]
    assert len(got) == 12 and all(x["class_distance"] < 1e-6 and x["word_distance"] < 1e-6 for x in got)  # the only text of its language


def test_divergence(spark):
    p, q = [1.0, 3.0, 0.0], [2.0, 1.0, 1.0]
    a, b = np.array(p) / 4, np.array(q) / 4
    m = (a + b) / 2
    kl = lambda x: sum(u * np.log2(u / v) for u, v in zip(x, m) if u)
    arr = lambda x: F.array(*map(F.lit, x))
    row = spark.range(1).select(quality.distance(arr(p), arr(q)).alias("d"), quality.distance(arr(p), arr(p)).alias("z"), quality.distance(arr([0.0, 0.0, 0.0]), arr(p)).alias("n"), quality.distance(arr([1.0, 0.0]), arr([0.0, 1.0])).alias("one")).first()
    assert row["d"] == pytest.approx(np.sqrt((kl(a) + kl(b)) / 2)) and row["z"] == 0 and row["n"] is None and row["one"] == pytest.approx(1)


# 6


def sets_of(t, k=5):
    w = SPACE.findall(t or "")
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)]) if w else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def test_minhash_classes(spark, docs):
    rows, df = docs
    r = random.Random(8)
    base = [f"u{i}" for i in range(150)]
    more = []
    for i in range(40):  # a group about one text, larger than a small bucket
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(150)] = f"v{r.random()}"
        more.append((500 + i, " ".join(w), "en", "s", 1))
    more.append((490, " ".join(base), "en", "s", 1))
    rows, df = rows + more, df.union(spark.createDataFrame(more, SCHEMA))
    got = {x["doc_id"]: x for x in minhash.classes(df).collect()}
    assert len(got) == len(rows)
    sets, up = {d: sets_of(t) for d, t, *_ in rows}, {d: d for d, *_ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.8:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert {d: x["class_id"] for d, x in got.items()} == {d: root(d) for d in ids}
    kept = minhash.keep_one(df.union(df))
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted({root(d) for d in ids}) and kept.columns == df.columns
    assert minhash.classes(empty(spark)).count() == 0 and minhash.keep_one(empty(spark)).count() == 0


def test_minhash_null_and_repeated_ids(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(None, text("a"), "en", "s", 1), (None, text("b"), "en", "s", 1), (7, text("c"), "en", "s", 1), (7, text("d"), "en", "s", 1), (None, text("c") + " x", "en", "s", 1), (None, text("a"), "en", "t", 2)]
    rows += [(None, None, "en", "s", 1), (None, None, "en", "t", 1), (7, None, "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = minhash.classes(df).collect()
    assert Counter(x["doc_id"] for x in got) == Counter(x[0] for x in rows)
    assert len({x["class_key"] for x in got if x["class_id"] == 7}) == 3  # c with its near copy, d, the wordless row
    kept = Counter(map(tuple, minhash.keep_one(df.union(df)).collect()))
    # of the two copies of "a" without an id either may stay
    assert Counter(x[1] for x in kept.elements()) == {text("a"): 1, text("b"): 1, text("c"): 1, text("d"): 1, None: 3}
    assert set(kept) <= set(rows) and max(kept.values()) == 1


def classes_of(texts, threshold=0.8):
    """Brute force: the smallest id of each component of similar texts."""
    sets, up = {d: sets_of(t) for d, t in texts.items()}, {d: d for d in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and jaccard(sets[a], sets[b]) >= threshold:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d in texts}


def test_minhash_loses_no_link_of_large_buckets(spark):
    """Chains whose far ends aren't similar to any hub, and families below the threshold, with every bucket held for large."""
    r = random.Random(17)
    texts = {}
    for c in range(4):
        w = [f"c{c}w{i}" for i in range(150)]
        for i in range(25):
            texts[len(texts)] = " ".join(w)
            for _ in range(3 if i % 5 else 9):  # three changed words stay above the threshold, nine break the chain
                w[r.randrange(150)] = f"n{r.random()}"
    base = [f"t{i}" for i in range(120)]
    for i in range(40):
        texts[len(texts)] = " ".join(base + [f"o{i}x{j}" for j in range(r.choice([4, 16, 30]))])
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in texts.items()], SCHEMA)
    want = classes_of(texts)
    got = minhash.classes(df, bands=40, rows=2, small=1).collect()
    assert {x["doc_id"]: x["class_id"] for x in got} == want and 10 < len(set(want.values())) < len(texts)


def test_across_finds_every_pair_between_classes(spark):
    r = random.Random(4)
    sets = {i: set(r.sample(range(40), r.randint(3, 12))) for i in range(60)}
    for i in range(60, 150):
        s = set(sets[r.randrange(i)])
        s.symmetric_difference_update(r.sample(range(40), r.randint(0, 2)))
        sets[i] = s or {1}
    labels = {i: r.choice([0, 0, 0, 1, i]) for i in sets}
    table = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "node long, elems array<int>")
    members = spark.createDataFrame(list(labels.items()), "node long, label long")
    got = minhash.similar(minhash.across(members, table.union(table)), table)
    near = lambda a, b: 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
    want = {(a, b) for a in sets for b in sets if a < b and labels[a] != labels[b] and near(a, b)}
    assert {(x["a"], x["b"]) for x in got.collect()} == want and len(want) > 20


def test_dart_signatures_estimate_weighted_jaccard():
    r = random.Random(2)
    k = 256
    for n in (3, 40, 800):
        a = {i: r.randint(1, 4) for i in range(n)}
        b = {i: (w if r.random() < 0.8 else r.randint(1, 9)) for i, w in a.items() if r.random() < 0.9} | {n + 1: 2}
        rows, elems, weight = [], [], []
        for i, s in enumerate((a, b)):
            for e, w in s.items():
                rows.append(i), elems.append(e), weight.append(float(w))
        sign, live = minhash.signatures(2, np.array(rows), tokens.mix(np.array(elems, np.uint64)), np.array(weight), k)
        assert live.all()
        j = jaccard(Counter(a), Counter(b))
        assert abs((sign[0] == sign[1]).mean() - j) < 4.5 * np.sqrt(max(j * (1 - j), 0.02) / k)
        alone, _ = minhash.signatures(1, np.zeros(len(a), int), tokens.mix(np.array(list(a), np.uint64)), np.array(list(a.values()), float), k)
        assert (alone[0] == sign[0]).all()  # a row's signature doesn't depend on the other rows


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 103), (103, 101), (200, 200)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 7


def brute_removed(rows, width):
    seen, out = {}, {}
    for d, t, *_ in sorted(rows):
        w = SPACE.findall(t or "")
        gone = set()
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if key in seen:
                gone |= set(range(i, i + width))
            seen.setdefault(key, (d, i))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [1000, 2])
def test_phrases(spark, docs, hot):
    rows, df = docs
    more = [(700, "p q " * 40, "en", "s", 1), (701, "q p " * 33, "en", "s", 1), (702, " ".join(f"k{i % 21}" for i in range(90)), "en", "s", 1)]
    rows, df = rows + more, df.union(spark.createDataFrame(more, SCHEMA))
    for width, phrase in ((20, 8), (6, 3)):
        want = brute_removed(rows, width)
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in phrases.remove(df, width, phrase, hot).collect()}
        assert got == want
    assert phrases.remove(empty(spark)).count() == 0


@pytest.mark.parametrize("hot", [1000, 1])
def test_phrases_with_repeated_rows_and_ids(spark, docs, hot):
    """Equal rows, unlike texts under one id, null ids, a long text and clashing columns."""
    rows, df = docs
    long = " ".join(f"l{i % 977}x{i % 13}" for i in range(20_000))
    more = [(3, rows[12][1], "en", "s", 1), (3, rows[14][1] + " z", "en", "s", 1), (None, rows[9][1], "en", "s", 1), (None, rows[9][1], "en", "s", 1), (None, None, "en", "s", 1), (900, long, "en", "s", 1), (901, long[500:], "en", "s", 1)]
    every = df.union(df).union(spark.createDataFrame(more, SCHEMA)).withColumns({"id": F.lit(1), "tie": F.lit("x"), "words": F.lit(None)})
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in phrases.remove(every, hot=hot).collect())
    hashes = {r["text"]: r["h"] for r in every.select("text", F.xxhash64("text").bitwiseOR(F.lit(1)).alias("h")).collect()}
    plain = rows + rows + more
    order = sorted(((phrases.LAST if r[0] is None else r[0]), hashes[r[1]], n) for n, r in enumerate(plain))
    want = Counter()
    for i, r in brute_removed([(i, plain[n][1]) for i, (_, _, n) in enumerate(order)], 20).items():
        want[plain[order[i][2]][0], *r] += 1
    assert got == want
    texts = phrases.remove(every, text_out=True).where("doc_id = 901").first()
    assert hashlib.sha256(texts["kept_text"].encode()).hexdigest() == texts["kept_sha256"]


def test_automaton_decides():
    """A phrase that isn't compiled isn't found."""
    row = lambda p, at, t: {"route": 1, "print": p, "fid": at, "ftie": 0, "fat": 0, "windows": 3, "offset": 2, "copies": 1, "words": t}
    a, b = "a b c d e f g h", "a b c d e f g x"
    shard = [phrases.Stretch(row(i, i, t), 6, 3) for i, t in enumerate((a, a, b))]
    confirmed = phrases.confirm(shard)
    assert set(confirmed) == {"c d e"} and len(confirmed["c d e"]) == 3
    found = [[j for j, _ in phrases.occurrences(s, phrases.compiled(confirmed), confirmed, 6, 3)] for s in shard]
    assert found == [[0, 1, 2], [0, 1, 2], [0, 1]]
    assert phrases.occurrences(shard[0], phrases.compiled([]), confirmed, 6, 3) == []


# 8


def test_sharding(spark, docs):
    rows, df = docs
    got = sharding.shard(df, n_shards=5, slots=64).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    for d, t, *_ in rows:
        raw = (t or "").encode()
        assert by[d]["size"] == len(raw) + 16 and by[d]["text_crc32"] == zlib.crc32(raw) and by[d]["grown_shard"] is None and by[d]["law"] == "bytes"
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert set(load) == set(range(5)) and max(load.values()) < 1.1 * min(load.values())
    for s in load:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert {r["doc_id"]: r["slot"] for r in sharding.shard(df.repartition(6), 5, 64).collect()} == {d: r["slot"] for d, r in by.items()}
    assert sharding.shard(df.union(df), 5, 64).count() == 2 * len(rows) and sharding.shard(empty(spark)).count() == 0


def test_slot_maps_grow(spark):
    sizes = spark.range(1000).select(F.col("id").cast("int").alias("vslot"), (F.xxhash64("id") % 50 + 60).alias("bytes"), F.lit(1).cast("long").alias("rows"))
    old = sharding.first_map(sizes, 8, 1000)
    new = sharding.grow(old, 10)
    a, b = ({r["slot"]: r for r in x.collect()} for x in (old, new))
    assert {r["version"] for r in a.values()} == {0} and {r["version"] for r in b.values()} == {1}
    moved = [s for s in a if a[s]["shard"] != b[s]["shard"]]
    assert all(b[s]["shard"] in (8, 9) for s in moved) and 0.1 < len(moved) / 1000 < 0.3
    load = Counter()
    for r in b.values():
        load[r["shard"]] += r["bytes"]
    assert max(load.values()) < 1.15 * min(load.values())
    assert {s: r["shard"] for s, r in a.items()} == {r["slot"]: r["shard"] for r in sharding.grow(old, 8).collect()}


def test_stored_maps(spark, docs, tmp_path):
    """New data go where their slots live; growing and rebalancing move few slots; each edit is a version."""
    rows, df = docs
    path = str(tmp_path / "map")
    where = lambda x: {r["vslot"]: r["shard"] for r in x.collect()}
    one = where(sharding.shard(df, 5, 64, path))
    more = spark.createDataFrame([(1000 + i, "new " * (i % 50), "en", "s", 1) for i in range(300)] + [(None, f"null {i}", "en", "s", 1) for i in range(40)], SCHEMA)
    every = df.union(more)
    two = sharding.shard(every, 5, 64, path)
    assert all(where(two)[v] == s for v, s in one.items()) and {r["version"] for r in sharding.latest(spark, path).collect()} == {0}
    for s in range(5):
        assert sorted(r["slot"] for r in two.where(F.col("shard") == s).collect()) == list(range(two.where(F.col("shard") == s).count()))
    assert two.where("doc_id IS NULL").select("vslot").distinct().count() > 20
    old = where(two)
    three = where(sharding.shard(every, 6, 64, path))
    assert all(three[v] in (s, 5) for v, s in old.items()) and 5 in three.values()
    assert {r["version"] for r in sharding.latest(spark, path).collect()} == {1}
    now = sharding.measured(sharding.latest(spark, path), sharding.slot_sizes(sharding.records(every, 64)))
    sharding.store(sharding.rebalance(now, 6), path)
    end = {r["slot"]: r for r in sharding.latest(spark, path).collect()}
    assert len(end) == 64 and {r["version"] for r in end.values()} == {2}
    loads = lambda m: [sum(r["bytes"] for r in m if r["shard"] == s) for s in range(6)]
    before = now.collect()
    assert max(loads(end.values())) <= max(loads(before)) and sum(end[r["slot"]]["shard"] != r["shard"] for r in before) < 32
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        sharding.store(sharding.latest(spark, path), path)


# 9


def test_toxicity(spark):
    r = random.Random(4)
    clean, bad = [f"c{i}" for i in range(300)], [f"zzq{i}" for i in range(30)]
    rows, labels = [], []
    for i in range(900):
        w = [r.choice(clean) for _ in range(r.randint(10, 120))]
        toxic = i % 6 == 0
        if toxic:
            at = r.randrange(len(w))
            w[at:at] = [r.choice(bad) for _ in range(r.randint(2, 8))]
        rows.append((i, " ".join(w), "en", "s", 1))
        if i % 4:
            labels.append((i, 1, int(toxic)))
    rows += [(2000, None, None, None, None), (2001, "", "en", "s", 0), (2002, "zzq999 never zzq998 seen zzq997", "en", "s", 0)]
    df, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, lab)
    got = {x["doc_id"]: x for x in toxicity.score(df, model).collect()}
    assert len(got) == len(rows)
    for d in got:
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= got[d]["score"] <= 1 and got[d]["predicted"] == int(got[d]["score"] >= 0.7)
    held = [d for d in range(900) if got[d]["held_out"]]
    right = sum(got[d]["predicted"] == int(d % 6 == 0) for d in held)
    assert right / len(held) > 0.97
    assert got[2000]["score"] == got[2001]["score"] == min(x["score"] for x in got.values()) and got[2002]["score"] > 0.5
    for d in held[:40]:
        words = rows[d][1].split()
        for p in got[d]["passages"]:
            assert words[p["start"]].startswith("zzq") and words[p["end"] - 1].startswith("zzq")
    # labels of held-out rows change nothing
    other = spark.createDataFrame([(d, q, 1 - t if zlib.crc32(str(d).encode()) % 3 == 1 else t) for d, q, t in labels], "doc_id long, quality int, toxic int")
    again = {x["doc_id"]: x["score"] for x in toxicity.score(df.repartition(5), toxicity.fit(df, other)).collect()}
    assert again == {d: pytest.approx(x["score"]) for d, x in got.items()}
    none = toxicity.score(df, toxicity.fit(df, lab.limit(0)))
    assert none.where("score = 0").count() == len(rows) and toxicity.score(empty(spark), model).count() == 0


def test_toxicity_finds_each_passage_of_the_same_words(spark):
    bad = [f"zzqx{i}" for i in range(6)]
    n = 400
    text = ["c"] * n
    for at in (100, 300):
        text[at : at + 6] = bad
    text[200:206] = [bad[0]] * 6  # one word said again and again is no passage
    model = {"share": 0.1, "weights": (np.zeros(0, np.uint64), np.zeros(0), toxicity.beginnings(tokens.Words(np.frombuffer(b"zzqx", np.uint8), np.array([0, 4]), "alnum")), np.array([3.0])), "lambda": 0.8, "k": 0.2, "a": -3.0, "b": 2.0}
    df = spark.createDataFrame([(1, " ".join(text), "en", "s", 1), (2, " ".join(text[:200] + ["c"] * 200), "en", "s", 1)], SCHEMA)
    got = {x["doc_id"]: x for x in toxicity.score(df, model).collect()}
    assert [(p["start"], p["end"]) for p in got[1]["passages"]] == [(100, 106), (300, 306)]
    assert [(p["start"], p["end"]) for p in got[2]["passages"]] == [(100, 106)] and got[1]["score"] > got[2]["score"]


def test_maximal_segments():
    r = random.Random(1)

    def brute(s, lo, hi):
        """Ruzzo and Tompa's definition: the best segment, then those left and right of it."""
        best = None
        for i in range(lo, hi):
            for j in range(i + 1, hi + 1):
                v = sum(s[i:j])
                if v > 1e-9 and (best is None or v > best[2] + 1e-9 or abs(v - best[2]) <= 1e-9 and j - i < best[1] - best[0]):
                    best = (i, j, v)
        return [] if best is None else brute(s, lo, best[0]) + [best] + brute(s, best[1], hi)

    for _ in range(150):
        s = [r.choice([-3, -2, -1, 1, 2, 4]) + r.random() / 1000 for _ in range(r.randrange(14))]
        got = toxicity.maximal_segments(np.array(s))
        assert [x[:2] for x in got] == [x[:2] for x in brute(s, 0, len(s))]


def test_segments_take_time_by_length():
    """The drift makes every new segment start lower than all before it: walking back over them all would be quadratic."""
    took = []
    for n in (125_000, 1_000_000):
        s = np.random.default_rng(2).choice([-0.5, -0.4, 0.45], n)
        start = time.process_time()
        found = toxicity.maximal_segments(s)
        took.append(time.process_time() - start)
    assert len(found) > 100_000 and took[1] < 24 * max(took[0], 0.05)


def brute_toxicity(rows, labels):
    """Scores by the docstring's formulas, in plain Python: weights of words and beginnings from the training rows' halves,
    passages, their calibration and the curve."""
    crc = lambda d: zlib.crc32(str(d).encode()) % 3
    toxic = {}
    for d, t in labels:
        if d is not None and t is not None:
            toxic[d] = max(toxic.get(d, 0), t)
    train = [(ALNUM.findall(lower(t or "")), toxic[d], int(crc(d) == 2)) for d, t, *_ in rows if d in toxic and crc(d) != 1]
    share = {h: [t for d, t in toxic.items() if crc(d) != 1 and (h == "both" or int(crc(d) == 2) == h)] for h in (0, 1, "both")}
    share = {h: sum(x) / len(x) for h, x in share.items()}
    odds = lambda p: math.log(p / (1 - p))
    kind = lambda w: w.encode()[: toxicity.BEGINNING]

    def weights(h):
        n, t, kn, kt = Counter(), Counter(), Counter(), Counter()
        for words, label, half in train:
            for w in set(words) if h in ("both", half) else ():
                n[w] += 1
                t[w] += label
                kn[kind(w)] += 1
                kt[kind(w)] += label
        at, p = odds(share[h]), share[h]
        low = lambda x: max(odds(x) - at, -toxicity.FLOOR)
        of_kind = {b: (kt[b] + toxicity.BETA * p) / (kn[b] + toxicity.BETA) for b in kn}
        of_word = {w: low((t[w] + toxicity.ALPHA * of_kind[kind(w)]) / (n[w] + toxicity.ALPHA)) for w in n}
        kinds = {b: low(x) for b, x in of_kind.items()}
        return lambda w: of_word[w] if w in of_word and abs(of_word[w] - kinds[kind(w)]) > toxicity.SAME else kinds.get(kind(w), 0.0)

    def passages(words, weight):
        s, last = [], {}
        for i, w in enumerate(words):
            v = weight(w)
            if v > toxicity.DRIFT:
                if w in last and i - last[w] <= toxicity.REACH:
                    v = toxicity.DRIFT
                else:
                    last[w] = i
            s.append(v - toxicity.DRIFT)

        def best(lo, hi):
            at, top, run, start = None, 0.0, 0.0, lo
            for i in range(lo, hi):
                if run <= 0:
                    run, start = 0.0, i
                run += s[i]
                if run > top + 1e-12:
                    at, top = (start, i + 1), run
            return [] if at is None else [*best(lo, at[0]), top, *best(at[1], hi)]

        return s, best(0, len(s))

    halves = [weights(1), weights(0)]  # each row under the other half's weights
    scored = [(label, len(words), *passages(words, halves[half])) for words, label, half in train]
    seen = np.zeros(toxicity._BINS)
    for label, _, s, _ in scored:
        if not label:
            at = np.clip(np.rint((np.array(s) - toxicity._LEAST) / toxicity._BIN), 0, toxicity._BINS - 1).astype(int)
            seen += np.bincount(at, minlength=toxicity._BINS)
    lam = toxicity.decay(seen)
    clean = [(n, max(found, default=0.0)) for label, n, _, found in scored if not label]
    k = len(clean) / sum(n * math.exp(-lam * b) for n, b in clean)

    def evidence(found, n):
        x = sorted((lam * v - math.log(k * n) for v in found), reverse=True)
        return math.sqrt(max(0.0, x[0]) + sum(v for v in x[1:] if v > -math.log(toxicity.SIGNIFICANT))) if x else 0.0

    by = defaultdict(lambda: [0, 0])
    for label, n, _, found in scored:
        one = by[round(evidence(found, n) + 1e-12, 2)]
        one[0] += label
        one[1] += 1
    a, b = toxicity.curve(*(np.array(c, float) for c in zip(*((x, *v) for x, v in by.items()))))
    both, out = weights("both"), []
    for d, t, *_ in rows:
        words = ALNUM.findall(lower(t or ""))
        out.append((d, 1 / (1 + math.exp(-(a + b * evidence(passages(words, both)[1], len(words)))))))
    return sorted(out, key=str)


def test_toxicity_scores(spark):
    """All scores by brute force, with rows without doc_id, of one doc_id, equal ones and clashing columns."""
    r = random.Random(9)
    clean, bad = [f"c{i}" for i in range(120)], [f"zzq{i}" for i in range(20)]
    rows, labels = [], []
    for i in range(240):
        w = [r.choice(clean) for _ in range(r.randint(5, 80))]
        if i % 4 == 0:
            at = r.randrange(len(w))
            w[at:at] = [r.choice(bad) for _ in range(r.randint(2, 8))]
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, int(i % 4 == 0) if i % 17 else None))
    rows += [(None, rows[0][1], "en", "s", 1), (None, None, "en", "s", 1), (3, rows[8][1], "en", "s", 1), rows[5], (900, " ".join(["c1 zzq3 zzq4 c2"] * 9000), "en", "s", 1)]
    labels += [(8, 0), (None, 1), (4000, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in ("score", "toxic", "half", "held_out", "n")}).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("half", F.lit("x"))
    got = toxicity.score(df, toxicity.fit(df, lab)).collect()
    want = brute_toxicity(rows, labels)
    assert sorted((x["doc_id"] for x in got), key=str) == sorted((d for d, _ in want), key=str)
    for (d, s), x in zip(want, sorted(((x["doc_id"], x["score"]) for x in got), key=str)):
        assert x == (d, pytest.approx(s, abs=0.01))  # the curve's counts are rounded to the hundredth
    assert not any(x["held_out"] for x in got if x["doc_id"] is None)


# 10


def brute_hits(rows, items, width=10):
    windows = defaultdict(set)
    for item, t in items:
        w = ALNUM.findall(lower(t or ""))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i : i + width])].add(str(item))
    sizes = {len(x) for x in windows}
    out = {}
    for d, t, *_ in rows:
        w = ALNUM.findall(lower(t or ""))
        hit, of = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    of |= windows[tuple(w[i : i + n])]
        out[d] = (len(w), len(hit), sorted(of))
    return out


def test_decontaminate(spark, docs):
    rows, df = docs
    items = [(i, t and t[: 200 + i]) for i, t, *_ in rows if i % 10 == 3] + [(200, "Edited"), (201, "the one"), (202, "ABx. aby"), (203, "!!"), (204, None), (205, rows[8][1][:150]), (3, "abx abx abx")]
    it = spark.createDataFrame(items, "item_id long, text string")
    both = df.union(df.where("doc_id < 5"))
    got = decontaminate.find(both, it).collect()
    want = brute_hits(rows, items)
    assert len(got) == len(rows) + 5
    for r in got:
        assert (r["n_words"], r["n_hit"], r["items"]) == want[r["doc_id"]] and r["n_items"] == len(r["items"]) and r["contaminated"] == (r["n_hit"] > 0)
    clean = decontaminate.clean(df, it)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d in want if not want[d][1]) and clean.columns == df.columns
    assert decontaminate.find(df, it.limit(0)).where("contaminated").count() == 0 and decontaminate.find(empty(spark), it).count() == 0


def test_decontaminate_repeated_ids(spark):
    item = " ".join(f"b{i}" for i in range(12))
    rows = [(1, f"x {item} y", "en", "s", 1), (1, "a clean text", "en", "s", 1), (None, item, "en", "s", 1), (None, "another clean text", "en", "s", 1), (None, None, "en", "s", 1)]
    clean = decontaminate.clean(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert Counter(map(tuple, clean.collect())) == Counter([rows[1], rows[3], rows[4]])
