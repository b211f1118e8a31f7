"""Near-duplicate documents by DartMinHash.

A document is a weighted set: its shingles of five words, weighted by how often
each occurs.  Darts fall on the plane (weight, rank) of each shingle as a Poisson
process whose places are hashes, the same in every document; those below the
shingle's weight count, and a document uses ranks up to a bound that gives it
about ``k ln k + 2 k`` darts whatever its length.  Each dart names a coordinate of
the signature, and the earliest dart of a coordinate is its value.  Two documents
agree in a coordinate with the probability of their weighted Jaccard similarity.

Texts of the same words collapse first, so copies are one node.  Signatures are
cut into bands; texts that share a band are candidates.  In buckets of more than
``SMALL`` texts each text is first held against two hubs: of the texts that share
most bands with others, one a bucket, the best of all its buckets and that of one
bucket by hash.  Then come all pairs of small buckets that aren't in one class yet.
Similarities are computed on whole shingle sets (of 64-bit hashes), and classes are
the connected components of pairs at ``threshold`` or more.  Hubs join most of a large
bucket to one class.  Where members of different classes are left in one, an exact
prefix-filtered join finds every similar pair across classes, so no class is
split that any shared band could join; pairs inside a class aren't listed.

Defined cases: a text of 1 to 4 words is one shingle; a null or wordless text is in
a class of its own; equal rows share a class; a row without doc_id is a document as
any other, and rows of one doc_id with different texts are different documents; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import tokens
from tideline.llm.common import bit_map, hidden, marked, settle
from tideline.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
#: 16 bands of 4 coordinates: a pair at 0.8 shares one with a chance of 0.9998.
BANDS, ROWS = 16, 4
SMALL = 16
#: Bits of the map by which a scan skips texts without candidates (4 MB).
MAP_BITS = 1 << 25
WORDS = "space"
#: Height of the lowest region of ranks; each next one is as high as all below it.
_LOWEST = 2.0**-8


def shingles(w: tokens.Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle with repeats, ordered by row and hash."""
    counts = w.counts
    h, ok = w.grams(k)
    rows, hashes = [w.row[ok]], [h[ok]]
    for short in range(1, k):
        g, at = w.grams(short)
        at &= np.repeat(counts == short, counts)
        rows.append(w.row[at])
        hashes.append(g[at])
    row, hash_ = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((hash_, row))
    return row[order], hash_[order]


def weighted(row: np.ndarray, hash_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct shingles with their counts."""
    if not len(row):
        return row, hash_, np.zeros(0)
    new = np.r_[True, (row[1:] != row[:-1]) | (hash_[1:] != hash_[:-1])]
    at = np.flatnonzero(new)
    return row[at], hash_[at], np.diff(np.r_[at, len(row)]).astype(float)


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _poisson(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Counts with these means from uniform numbers, by the inverse of the distribution."""
    p = np.exp(-mean)
    total, out, n = p.copy(), np.zeros(len(u), np.int64), 0
    while True:
        more = u >= total
        if not more.any() or n > 60:
            return out
        n += 1
        p = p * mean / n
        total = total + p
        out += more


def darts(row: np.ndarray, elem: np.ndarray, weight: np.ndarray, bound: np.ndarray, from_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, rank, hash) of the darts of weighted elements, with ranks in [from_, bound) of their rows.

    Regions double: weights [0,1), [1,2), [2,4) ...; ranks [0,b), [b,2b), [2b,4b) ...
    A region of larger area than one is cut into pieces of its own counts."""
    out_row, out_rank, out_hash = [], [], []
    salt = lambda *x: np.uint64(sum(v * m for v, m in zip(x, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))) & (2**64 - 1))
    nu = 0
    while True:
        w_lo, w_hi = (0.0, 1.0) if nu == 0 else (2.0 ** (nu - 1), 2.0**nu)
        tall = weight > w_lo
        if not tall.any():
            break
        rho = 0
        while True:
            r_lo, r_hi = (0.0, _LOWEST) if rho == 0 else (_LOWEST * 2.0 ** (rho - 1), _LOWEST * 2.0**rho)
            use = np.flatnonzero(tall & (bound[row] > r_lo) & (from_[row] < r_hi))
            if not len(use):
                if not (tall & (bound[row] > r_lo)).any():
                    break
                rho += 1
                continue
            area = (w_hi - w_lo) * (r_hi - r_lo)
            pieces = max(1, math.ceil(area / 4.0))
            for piece in range(pieces):
                p_lo, p_hi = r_lo + (r_hi - r_lo) * piece / pieces, r_lo + (r_hi - r_lo) * (piece + 1) / pieces
                h = tokens.mix(elem[use] ^ salt(nu + 1, rho + 1, piece + 1))
                n = _poisson(_uniform(h), np.full(len(use), area / pieces))
                some = n > 0
                rep = np.repeat(use[some], n[some])
                if not len(rep):
                    continue
                within = np.arange(len(rep)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
                d = tokens.mix(np.repeat(h[some], n[some]) + (within.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
                at_w = w_lo + (w_hi - w_lo) * _uniform(tokens.mix(d ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                at_r = p_lo + (p_hi - p_lo) * _uniform(tokens.mix(d ^ np.uint64(0x5A5A5A5A5A5A5A5A)))
                keep = (at_w < weight[rep]) & (at_r < bound[row[rep]]) & (at_r >= from_[row[rep]])
                out_row.append(row[rep][keep])
                out_rank.append(at_r[keep])
                out_hash.append(d[keep])
            rho += 1
        nu += 1
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
    return np.concatenate(out_row), np.concatenate(out_rank), np.concatenate(out_hash)


def signatures(n_rows: int, row: np.ndarray, elem: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(n_rows, k) hashes, and which rows have one.  Rows whose darts miss a coordinate throw more."""
    mass = np.bincount(row, weights=weight, minlength=n_rows)
    live = mass > 0
    bound = np.where(live, (k * math.log(k) + 2 * k) / np.maximum(mass, 1e-300), 0.0)
    done = np.zeros(n_rows)
    best, sign = np.full((n_rows, k), np.inf), np.zeros((n_rows, k), np.uint64)
    while True:
        r, rank, h = darts(row, elem, weight, bound, done)
        c = (tokens.mix(h + np.uint64(77)) % np.uint64(k)).astype(np.int64)
        order = np.lexsort((h, rank, c, r))
        r, rank, h, c = r[order], rank[order], h[order], c[order]
        first = np.r_[True, (r[1:] != r[:-1]) | (c[1:] != c[:-1])] if len(r) else np.zeros(0, bool)
        r, rank, h, c = r[first], rank[first], h[first], c[first]
        better = rank < best[r, c]
        best[r[better], c[better]], sign[r[better], c[better]] = rank[better], h[better]
        missing = live & np.isinf(best).any(axis=1)
        if not missing.any():
            return sign, live
        done, bound = np.where(missing, bound, 1.0), np.where(missing, bound * 2, 0.0)
        keep = missing[row]
        row, elem, weight = row[keep], elem[keep], weight[keep]


def row_key(doc_id: str, text: str) -> Column:
    """A hash of a row's id and text, both of which may be null."""
    return F.xxhash64(F.col(doc_id), F.col(doc_id).isNull(), F.col(text), F.col(text).isNull())


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE) -> DataFrame:
    """(doc_id, r, p1, p2, n, bands): a hash of id and text, two of the text's words, its words, its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, w in tokens.slices(batch, "text", WORDS):
                row, elem, weight = weighted(*shingles(w, k))
                sign, live = signatures(w.n_rows, row, elem, weight, bands * rows)
                keys = np.zeros((w.n_rows, bands), np.uint64)
                for b in range(bands):
                    x = np.full(w.n_rows, np.uint64(b + 1))
                    for c in range(rows):
                        x = tokens.mix(x * np.uint64(0xC2B2AE3D27D4EB4F) + sign[:, b * rows + c])
                    keys[:, b] = x
                place = (np.arange(len(w.hash)) - w.first[:-1][w.row]).astype(np.uint64)
                p1, p2 = np.zeros(w.n_rows, np.uint64), np.zeros(w.n_rows, np.uint64)
                np.add.at(p1, w.row, tokens.mix(w.hash + place * np.uint64(0x9E3779B97F4A7C15)))
                np.add.at(p2, w.row, tokens.mix((w.hash ^ np.uint64(0xD6E8FEB86659FD93)) + place * np.uint64(0xC2B2AE3D27D4EB4F)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(w.n_rows + 1, dtype=np.int32) * bands), tokens.long_column(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(c)).cast(pa.int64()) for c in ("doc_id", "r")), tokens.long_column(p1), tokens.long_column(p2), pa.array(w.counts, pa.int64()), lists],
                    ["doc_id", "r", "p1", "p2", "n", "bands"],
                )

    return docs.select("doc_id", "text", row_key("doc_id", "text").alias("r")).mapInArrow(run, "doc_id long, r long, p1 long, p2 long, n long, bands array<bigint>")


def buckets(members: DataFrame) -> DataFrame:
    """(key, node, m) of the (node, key) that share a key with others, with the bucket's size."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    return members.join(sizes, "key")


def hub_pairs(shared: DataFrame, small: int = SMALL) -> DataFrame:
    """Distinct pairs (a, b), a < b, of texts in large buckets of (key, node, m) with their hubs: at most two a text."""
    many = shared.where(F.col("m") > small).select("key", "node")
    # how many places of others a text meets: the middle of a group meets most
    met = shared.groupBy("node").agg(F.sum("m").alias("met"))
    top = many.join(met, "node").groupBy("key").agg(F.max(F.struct(F.col("met"), F.bitwise_not("node").alias("rev"))).alias("top"))
    own = many.join(top, "key").groupBy("node").agg(F.max("top").alias("best"), F.min(F.struct(F.xxhash64("node", "key").alias("h"), "top")).alias("other"))
    hub = F.explode(F.array(F.bitwise_not("best.rev"), F.bitwise_not("other.top.rev")))
    return own.select("node", hub.alias("hub")).where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def small_pairs(shared: DataFrame, small: int = SMALL) -> DataFrame:
    """Distinct pairs (a, b), a < b, of texts that share a bucket of (key, node, m) of at most ``small`` texts."""
    few = shared.where(F.col("m") <= small).select("key", "node")
    return few.withColumnRenamed("node", "a").join(few.withColumnRenamed("node", "b"), "key").where("a < b").select("a", "b").distinct()


def apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs whose ends aren't in one class of (node, label) yet."""
    of = lambda end: label.select(F.col("node").alias(end), F.col("label").alias(f"_{end}"))
    x = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return x.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def shingle_sets(docs: DataFrame, needed: DataFrame, k: int = SHINGLE, bits: int = MAP_BITS) -> DataFrame:
    """(node, elems) of the needed nodes, and of a few others that a map of fixed size lets through: a text's
    shingles; the n-th copy of one is an element of its own, so that the Jaccard similarity of these sets is
    the weighted one.  Texts aren't shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(needed, "node", bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(marked(batch.column(2).to_numpy(), shared.value)))
            for part, w in tokens.slices(batch, "text", WORDS):
                row, h = shingles(w, k)
                if len(row):
                    new = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])]
                    at = np.flatnonzero(new)
                    nth = np.arange(len(row)) - np.repeat(at, np.diff(np.r_[at, len(row)]))
                    h = np.where(nth > 0, tokens.mix(h + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), h)
                ends = np.searchsorted(row, np.arange(w.n_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("node")).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends), tokens.long_column(h))], ["node", "elems"])

    at = F.pmod(F.xxhash64("node"), F.lit(bits)).alias("at")
    return docs.select("node", "text", at).mapInArrow(run, "node long, elems array<bigint>")


def similar(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity) of the pairs at the threshold or more, computed on whole sets."""
    one = pairs.join(sets.withColumnRenamed("node", "a").withColumnRenamed("elems", "x"), "a")
    two = one.join(sets.withColumnRenamed("node", "b").withColumnRenamed("elems", "y"), "b")
    big, less = F.greatest(F.size("x"), F.size("y")), F.least(F.size("x"), F.size("y"))
    two = two.where(less >= threshold * big)
    both = F.size(F.array_intersect("x", "y"))
    return two.select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)


def mixed(shared: DataFrame, label: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, label): the members of large buckets that hold more than one class."""
    many = shared.where(F.col("m") > small).select("key", "node").join(label, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    several = many.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    return many.join(several, "key", "left_semi").select("node", "label").distinct()


def across(members: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct pairs (a, b), a < b, that hold every pair of (node, label) of different labels at the threshold or more.

    A set's elements are ordered by the number of classes that have them.  Two sets at the threshold share
    one of their first ``n - ceil(threshold * n) + 1`` elements, and what follows the first one they share must
    be enough for the overlap needed (length and positional bounds).  An element of one class joins nothing.
    One side leaves out the class that has an element most often, so a large class never meets itself."""
    whole = members.join(sets.dropDuplicates(["node"]), "node").withColumn("n", F.size("elems"))
    elems = whole.select("node", "label", "n", F.explode("elems").alias("e"))
    by_class = elems.groupBy("e", "label").agg(F.count(F.lit(1)).alias("c"))
    heard = by_class.groupBy("e").agg(F.count(F.lit(1)).alias("classes"), F.max(F.struct("c", "label"))["label"].alias("top"))
    ranked = elems.join(heard, "e").groupBy("node", "label", "n").agg(F.sort_array(F.collect_list(F.struct("classes", "e", "top"))).alias("s"))
    first = F.slice("s", F.lit(1), F.col("n") - F.ceil(threshold * F.col("n") - 1e-9).cast("int") + 1)
    prefix = ranked.select("node", "label", "n", F.posexplode(first).alias("i", "s")).where("s.classes > 1")
    prefix = settle(prefix.select("node", "label", "n", (F.col("n") - F.col("i")).alias("left"), "s.e", "s.top"), "prefix")
    few = prefix.where("label <> top").select("e", F.col("node").alias("x"), F.col("label").alias("lx"), F.col("n").alias("nx"), F.col("left").alias("leftx"))
    enough = F.least("leftx", "left") >= (F.col("nx") + F.col("n")) * (threshold / (1 + threshold)) - 1e-9
    met = few.join(prefix, "e").where((F.col("lx") != F.col("label")) & enough)
    return met.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def _labelled(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE, small: int = SMALL) -> DataFrame:
    """(doc_id, r, n, class_id, class_key, n_copies) of every row; a node is the least row key of a text's copies."""
    sketches = settle(sketch(docs, bands, rows, k), "sketch")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r")).alias("first")  # null ids last
    texts = settle(sketches.where("n > 0").groupBy("p1", "p2").agg(F.min("r").alias("node"), first, F.count(F.lit(1)).alias("n_copies"), F.first("bands").alias("bands")), "texts")
    shared = settle(buckets(texts.select("node", F.explode("bands").alias("key"))), "buckets")
    source = docs.select(row_key("doc_id", "text").alias("node"), "text")
    sets = settle(shingle_sets(source, shared.select("node").distinct(), k).dropDuplicates(["node"]), "sets")
    links = settle(similar(settle(hub_pairs(shared, small), "hubs"), sets, threshold).select("a", "b"), "links")
    label = components(links)
    links = settle(links.union(similar(apart(small_pairs(shared, small), label), sets, threshold).select("a", "b")), "links")
    label = components(links)
    rest = settle(mixed(shared, label, small), "mixed")
    if not rest.isEmpty():
        more = settle(similar(settle(across(rest, sets, threshold), "across"), sets, threshold).select("a", "b"), "links")
        label = components(links.union(more))
    found = texts.select("p1", "p2", "node", "n_copies", "first").join(label, "node", "left")
    found = settle(found.select("p1", "p2", F.coalesce("label", "node").alias("label"), "n_copies", "first"), "found")
    heads = found.groupBy("label").agg(F.min("first").alias("first"))
    found = found.drop("first").join(heads, "label").select("p1", "p2", "n_copies", F.col("first.doc_id").alias("class_id"), F.col("first.r").alias("class_key"))
    worded = sketches.where("n > 0").select("doc_id", "r", "n", "p1", "p2").join(found, ["p1", "p2"]).drop("p1", "p2")
    wordless = sketches.where("n = 0").select("doc_id", "r", "n", F.col("doc_id").alias("class_id"), F.col("r").alias("class_key"), F.lit(1).cast("long").alias("n_copies"))
    return worded.unionByName(wordless)


def classes(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, class_id, n_copies, class_key) of every row: the class's smallest doc_id, the rows with the same
    words, and the key of the class's first row, which tells classes apart where ids are null or repeat."""
    return _labelled(docs, **how).select("doc_id", "class_id", "n_copies", "class_key")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """One row of each class: that with the class's smallest doc_id, a null one last; of equal rows, one."""
    keep = _labelled(docs, **how).where("r = class_key").select(F.col("r").alias("_keep"), (F.col("n") == 0).alias("_wordless")).distinct()
    x, own = hidden(docs)
    rest, text = list(own.values()), own["text"]
    x = x.withColumn("_key", row_key(own["doc_id"], text)).join(keep, F.col("_key") == F.col("_keep"))
    # rows of one key have one id and text; a hash of the others puts them in order, whatever their types are
    x = x.withColumn("_o", F.xxhash64(F.to_json(F.struct(*(c for c in rest if c != text)))) if len(rest) > 1 else F.lit(0).cast("long"))
    # wordless ones are one document only where all columns are equal
    x = x.groupBy("_key", F.when(F.col("_wordless"), F.col("_o")).alias("_row")).agg(F.min_by(F.struct(*rest), F.col("_o")).alias("_r"))
    return x.select(*(F.col(f"_r.{h}").alias(c) for c, h in own.items()))
