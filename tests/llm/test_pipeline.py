"""The pipeline stage by stage against plain Python, and the registered queries on a small folder."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.llm.test_operators import ALNUM, SCHEMA, SPACE, brute_hits, fill, jaccard, lower, sets_of
from tideline.llm import minhash, quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(6)
    common = "the of and to in is that for it as was with".split()
    word = lambda: r.choice(common) if r.random() < 0.4 else "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(3, 8)))
    text = lambda n: " ".join(word() + ("." if r.random() < 0.1 else "") for _ in range(n)).capitalize()
    items = [(i, text(25)) for i in range(4)]
    rows = []
    for i in range(150):
        t = text(r.randint(30, 200))
        if i % 15 == 4:
            t = rows[r.randrange(len(rows))][1]
        if i % 15 == 7:
            t = rows[-1][1].replace(" the ", " a ", 1)
        if i % 20 == 9:
            t += " " + " ".join(items[i % 4][1].split()[3:16])
        if i % 25 == 11:
            t = "### $$$ %%% " * 60
        rows.append((i, t, r.choice(["en", "de", None]), r.choice(["a", "b", "c", None]), len(t)))
    rows.append((150, None, None, None, None))
    out = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), int(i % 10 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(i, f"http://{'spam-farm' if i % 5 == 0 else 'x'}.example.org/en/{i % 7}", "") for i in range(30)], "page_id long, url string, html string").write.parquet(f"{out}/pages.parquet")
    return str(out), rows, items


def test_stages(spark, folder, tmp_path):
    sf, rows, items = folder
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert docs.dtypes == before.dtypes
        seen.append([tuple(r) for r in docs.collect()] if i < 4 else docs.collect())
    judged = {r["doc_id"] for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).where("kept").collect()}
    assert {r[0] for r in seen[0]} == judged and not any(r[1] and "###" in r[1] for r in seen[0])
    clean = [r for r in rows if r[1] and "###" not in r[1]]
    assert len(judged) >= 0.97 * len(clean)
    # near-dedup: the smallest id of each class of similar texts
    sets, up = {r[0]: sets_of(r[1]) for r in seen[0]}, {r[0]: r[0] for r in seen[0]}
    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and jaccard(sets[a], sets[b]) >= 0.8:
                x, y = a, b
                while up[x] != x:
                    x = up[x]
                while up[y] != y:
                    y = up[y]
                up[max(x, y)] = min(x, y)
    assert {r[0] for r in seen[1]} == {d for d in up if up[d] == d} and len(seen[1]) < len(seen[0])
    hits = brute_hits(seen[1], items)
    assert {r[0] for r in seen[2]} == {d for d, h in hits.items() if not h[1]} and len(seen[2]) < len(seen[1])
    assert not any(len(ALNUM.findall(lower(r[1]))) == 0 for r in seen[2])
    sizes, copies, taken = Counter(), Counter(r[0] for r in seen[3]), Counter()
    for r in seen[2]:
        sizes[r[3]] += len(SPACE.findall(r[1]))
    for r in seen[3]:
        taken[r[3]] += len(SPACE.findall(r[1]))
    want = fill(sizes)
    assert max(copies.values()) <= 3 and all(abs(taken[s] - want[s]) <= 201 for s in sizes)
    assert set(seen[3]) <= set(seen[2])
    assert len(seen[4]) == len(seen[3]) and Counter(r["doc_id"] for r in seen[4]) == copies
    assert all(0 <= r["shard"] < 40 for r in seen[4])
    got = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, seen[4]), key=str)


def test_stages_take_columns_of_any_type(spark, folder):
    """A map can be neither ordered nor grouped by; it stays with its row."""
    sf, rows, _ = folder
    docs = spark.createDataFrame(rows[:40], SCHEMA).withColumn("m", F.create_map(F.lit("id"), F.col("doc_id"))).withColumn("r", F.lit("x"))
    docs = docs.unionByName(docs.where("doc_id < 5")).unionByName(docs.where("doc_id = 6").withColumn("r", F.lit("y")))
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.count() and docs.where("m['id'] <> doc_id OR m IS NULL").count() == 0
    assert docs.columns[-2:] == ["m", "r"]
    twice = spark.createDataFrame([(1, "", "en", "s", 1)] * 3 + [(1, "", "en", "t", 1), (1, None, "en", "s", 1)], SCHEMA).withColumn("m", F.create_map(F.lit("id"), F.col("doc_id")))
    assert minhash.keep_one(twice).count() == 3  # wordless rows are one only where all columns are equal


def test_runs_keep_their_own_tables(spark, tmp_path):
    from tideline.llm.common import collecting, settle

    with collecting(spark):
        first = settle(spark.range(3), "a")
        with collecting(spark):
            inner = settle(spark.range(4), "b")
        assert first.count() == 3
        with pytest.raises(Exception):
            spark.read.parquet(inner.inputFiles()[0]).count()
    outside = settle(spark.range(5), "c")
    assert outside.count() == 5


@pytest.mark.parametrize("n", range(1, 14))
def test_queries_run(spark, folder, n):
    queries = __spark_entry__.queries()
    name = next(q for q in queries if q.startswith(f"op{n}_"))
    df = queries[name](spark, folder[0])
    assert df.count() == (30 if n == 1 else 151)
    assert df.columns[0] == ("page_id" if n == 1 else "doc_id") and df.select(F.countDistinct(df.columns[0])).first()[0] == df.count()
