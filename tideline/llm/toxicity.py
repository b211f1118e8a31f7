"""Toxic passages by maximum-scoring segments.

Every word has a log-odds weight between toxic and clean labelled documents, with
two Dirichlet priors: a word's share of toxic documents leans on that of words
with the same first letters, and theirs on the share overall, so a word never
seen still has the weight of its kind.  Weights stop at -``FLOOR``, so that one clean
word doesn't end a passage.  A linear scan (Ruzzo and Tompa's) finds
every maximal passage of positive score, where each word has its weight less
``DRIFT``, and a word heavier than that counts once within ``REACH`` words.  By extreme-value theory the best passage of a clean text of n words
has score S or more with expectation E = K n exp(-lambda S); -log E of the best
and of each further significant passage add up to a document's evidence, and a
logistic curve of its root gives the chance of label 1.

Weights are fitted in two halves of the training rows.  lambda, K and the curve
come from training rows scored with the other half's weights; all documents are
scored with both halves' weights together.  At most ``MAX_LABELLED`` labelled
rows are used, so the model that tasks receive, the words of these rows, is bounded;
scoring covers every document and its whole text.  The driver gets the weights and
sums, never rows of documents.

Defined cases: a null or wordless text has no passages and the lowest score;
repeated labels of a document count once, as toxic if one says so; null labels and
labels without doc_id are ignored; all rows of a labelled doc_id are labelled; rows
without doc_id aren't held out; without both labels every score is the share of label
1 (0 for no labels); equal rows stay; an empty table gives an empty result; extra
columns are ignored; a text of any length is scanned whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import tokens
from tideline.llm.common import settle

#: Labelled rows a fit uses (the first by a hash of doc_id).
MAX_LABELLED = 200_000
#: Pseudo-documents of the priors of a word and of a word beginning.
ALPHA, BETA = 4.0, 4.0
#: What is taken off each word's weight, the least weight (as -FLOOR), and bytes of a word's beginning.
DRIFT, FLOOR, BEGINNING = 0.5, 1.0, 4
#: A word whose weight is nearer than this to its kind's isn't listed.
SAME = 0.3
#: A word's repeat counts again if it stands more than so many words on.
REACH = 50
#: A further passage counts with E below this.
SIGNIFICANT = 0.05
WORDS = "alnum"
#: Scores are counted to multiples of _BIN, from _LEAST on.
_BIN, _BINS, _LEAST = 0.25, 64, -1.5


def remainder(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 3; 1 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def training(labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, toxic, half) of at most ``limit`` labelled rows that aren't held out."""
    rows = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(remainder(F.col("doc_id")) != 1)
    rows = rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return rows.select("doc_id", "toxic", (remainder(F.col("doc_id")) == 2).cast("int").alias("half")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def beginnings(w: tokens.Words) -> np.ndarray:
    """The first BEGINNING bytes of each word, lower-cased, as a number."""
    out = np.zeros(len(w.start), np.int64)
    for i in range(BEGINNING):
        at = w.start + i
        ok = at < w.end
        b = w.data[np.minimum(at, len(w.data) - 1)].astype(np.int64) if len(w.data) else out
        b = np.where((b >= 65) & (b <= 90), b + 32, b)
        out = out * 256 + np.where(ok, b, 0)
    return out


def document_counts(train: DataFrame) -> DataFrame:
    """(word, beginning, t0, n0, t1, n1): toxic and all documents with a word, by half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, w in tokens.slices(batch, "text", WORDS):
                toxic, half = (rows.column(rows.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("toxic", "half"))
                row = w.row
                _, first = np.unique(w.hash + tokens.mix(row.astype(np.uint64)), return_index=True)
                word, at, back = np.unique(w.hash[first], return_index=True, return_inverse=True)
                r = row[first]
                sums = [np.bincount(back, weights=x, minlength=len(word)).astype(np.int64) for h in (0, 1) for x in ((toxic * (half == h))[r], (half == h)[r].astype(float))]
                yield pa.RecordBatch.from_arrays([tokens.long_column(word), pa.array(beginnings(w)[first][at]), *map(pa.array, sums)], ["word", "beginning", "t0", "n0", "t1", "n1"])

    got = train.select("text", "toxic", "half").mapInArrow(run, "word long, beginning long, t0 long, n0 long, t1 long, n1 long")
    return got.groupBy("word", "beginning").agg(*(F.sum(c).alias(c) for c in ("t0", "n0", "t1", "n1")))


def weights(counts: DataFrame, base: dict[str, float]) -> dict[str, tuple[np.ndarray, ...]]:
    """Sorted (words, weights, beginnings, weights) for the halves ``0``, ``1`` and ``both``.

    ``base``: the share of toxic documents in each."""
    counts = counts.select("*", (F.col("t0") + F.col("t1")).alias("tboth"), (F.col("n0") + F.col("n1")).alias("nboth"))
    odds = lambda r: F.log(r / (1 - r))
    out = {}
    kinds = counts.groupBy("beginning").agg(*(F.sum(f"{c}{h}").alias(f"k{c}{h}") for c in "tn" for h in base))
    joined = counts.join(kinds, "beginning")
    for h, share in base.items():
        if not 0 < share < 1:
            out[h] = (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0))
            continue
        at = math.log(share / (1 - share))
        kind = (F.col(f"kt{h}") + BETA * share) / (F.col(f"kn{h}") + BETA)
        word = (F.col(f"t{h}") + ALPHA * kind) / (F.col(f"n{h}") + ALPHA)
        # a word of its kind's weight needs no entry
        floored = lambda r: F.greatest(odds(r) - at, F.lit(-FLOOR))
        x = joined.where(F.col(f"n{h}") > 0).select("word", floored(word).alias("w"), floored(kind).alias("k"))
        x = x.where(F.abs(F.col("w") - F.col("k")) > SAME).select("word", "w").toArrow()
        y = kinds.where(F.col(f"kn{h}") > 0).select("beginning", floored(kind).alias("k")).toArrow()
        a, b = x.column("word").to_numpy().view(np.uint64), y.column("beginning").to_numpy()
        i, j = np.argsort(a), np.argsort(b)
        out[h] = (a[i], x.column("w").to_numpy()[i], b[j], y.column("k").to_numpy()[j])
    return out


def word_scores(w: tokens.Words, model: tuple[np.ndarray, ...]) -> np.ndarray:
    """Each word's weight less the drift; zero for a weighty word that counted at most ``REACH`` words before."""
    known, weight, kinds, kind_weight = model
    out = np.zeros(len(w.hash))
    if len(kinds) and len(out):
        b = beginnings(w)
        at = np.minimum(np.searchsorted(kinds, b), len(kinds) - 1)
        out = np.where(kinds[at] == b, kind_weight[at], 0.0)
    if len(known) and len(out):
        at = np.minimum(np.searchsorted(known, w.hash), len(known) - 1)
        out = np.where(known[at] == w.hash, weight[at], out)
    # a word says it once a passage: its repeats nearby neither add nor cost, further on it counts again
    heavy = np.flatnonzero(out > DRIFT)
    key = w.hash[heavy] + tokens.mix(w.row[heavy].astype(np.uint64))
    last: dict[int, int] = {}  # where each word of each row last counted
    for at, k in zip(heavy.tolist(), key.tolist()):
        if k not in last or at - last[k] > REACH:
            last[k] = at
        else:
            out[at] = DRIFT
    return out - DRIFT


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring (start, end, score) of a sequence, in one scan over its positive places.

    Each segment knows the last one before it with a smaller sum on its left.  Looking for such a one for a
    new segment follows these links; what they pass over is never looked at again, so time is linear."""
    total = np.concatenate(([0.0], np.cumsum(scores)))
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, link
    places = np.flatnonzero(scores > 0)
    for k, left, right in zip(places.tolist(), total[places].tolist(), total[places + 1].tolist()):
        start, j = k, len(found) - 1
        while j >= 0 and found[j][2] >= left:
            j = found[j][4]
        while j >= 0 and found[j][3] < right:  # joined with that one and all between
            start, left, link = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = link
        found.append((start, k + 1, left, right, j))
    return [(s, e, r - x) for s, e, x, r, _ in found]


def passages(train: DataFrame, model: dict[str, tuple[np.ndarray, ...]]) -> DataFrame:
    """(toxic, n, found, seen): passage scores of training rows under the other half's weights,
    and how many of their words have each score."""
    shared = train.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, w in tokens.slices(batch, "text", WORDS):
                toxic, half = (rows.column(rows.schema.get_field_index(c)).to_numpy() for c in ("toxic", "half"))
                both = [word_scores(w, shared.value[h]) for h in ("1", "0")]
                found, seen = [], []
                for i in range(w.n_rows):
                    s = both[half[i]][w.first[i] : w.first[i + 1]]
                    found.append([x[2] for x in maximal_segments(s)])
                    at = np.clip(np.rint((s - _LEAST) / _BIN), 0, _BINS - 1).astype(int)
                    seen.append(np.bincount(at, minlength=_BINS).tolist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(toxic, pa.int32()), pa.array(w.counts, pa.int64()), pa.array(found, pa.list_(pa.float64())), pa.array(seen, pa.list_(pa.int64()))], ["toxic", "n", "found", "seen"]
                )

    return train.select("text", "toxic", "half").mapInArrow(run, "toxic int, n long, found array<double>, seen array<bigint>")


def decay(seen: np.ndarray) -> float:
    """lambda: the mean of exp(lambda * score) over words of clean texts is one."""
    at, p = np.arange(len(seen)) * _BIN + _LEAST, seen / max(seen.sum(), 1.0)
    lo, hi = 0.02, 3.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (p * np.exp(mid * at)).sum() > 1 else (mid, hi)
    return lo


def evidence(found: list[float], n: int, lam: float, k: float) -> float:
    """The root of -log E of the best passage plus that of each further significant one."""
    if not len(found) or n <= 0:
        return 0.0
    x = np.sort(lam * np.asarray(found) - math.log(max(k * n, 1e-12)))[::-1]
    # the root keeps texts with many passages from setting the curve's slope
    return math.sqrt(max(0.0, x[0]) + x[1:][x[1:] > -math.log(SIGNIFICANT)].sum())


def evidence_of(found: Column, n: Column, lam: float, k: float) -> Column:
    """``evidence`` of a column."""
    x = F.transform(found, lambda s: F.lit(lam) * s - F.log(F.greatest(F.lit(k) * n, F.lit(1e-12))))
    most, least = F.array_max(x), F.lit(-math.log(SIGNIFICANT))
    further = F.aggregate(F.filter(x, lambda v: v > least), F.lit(0.0), lambda a, v: a + v) - F.when(most > least, most).otherwise(0.0)
    return F.when((F.size(found) > 0) & (n > 0), F.sqrt(F.greatest(most, F.lit(0.0)) + F.greatest(further, F.lit(0.0)))).otherwise(0.0)


def curve(x: np.ndarray, ones: np.ndarray, all_: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-a - b x)), by Newton's steps, with a weak prior that keeps b finite."""
    p = (ones.sum() + 0.5) / (all_.sum() + 1)
    theta, prior = np.array([math.log(p / (1 - p)), 0.1]), np.array([1e-4, 1e-2])
    m = np.stack([np.ones_like(x), x], 1)
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(m @ theta, -30, 30)))
        g = m.T @ (ones - all_ * q) - prior * theta
        h = (m * (all_ * q * (1 - q))[:, None]).T @ m + np.diag(prior) + 1e-9 * np.eye(2)
        step = np.linalg.solve(h, g)
        theta = theta + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(max(theta[1], 0.0))


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> dict:
    """The whole model, bounded by the words of ``limit`` rows; from training rows only."""
    chosen = training(labels, limit)
    # at most ``limit`` rows of three numbers
    train = settle(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", "half"), "train")
    share = chosen.groupBy("half").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    t, n = {str(r["half"]): r["t"] for r in share}, {str(r["half"]): r["n"] for r in share}
    whole = (sum(t.values()), sum(n.values()))
    base = {h: t.get(h, 0) / n.get(h, 1) for h in ("0", "1")} | {"both": whole[0] / max(1, whole[1])}
    if not 0 < base["both"] < 1:
        return {"share": base["both"], "weights": None}
    w = weights(settle(document_counts(train), "counts"), base)
    rows = settle(passages(train, {h: w[h] for h in ("0", "1")}), "passages")
    clean = rows.where("toxic = 0")
    seen = clean.agg(*(F.sum(F.col("seen")[i]).alias(f"s{i}") for i in range(_BINS))).first()
    lam = decay(np.array([x or 0 for x in seen], float))
    best = F.coalesce(F.array_max("found"), F.lit(0.0))
    texts, mass = clean.agg(F.count(F.lit(1)), F.sum(F.col("n") * F.exp(-lam * best))).first()
    k = float(texts / max(1e-9, mass or 0.0))
    # to the hundredth: a few thousand rows at most
    x = rows.groupBy(F.round(evidence_of(F.col("found"), F.col("n"), lam, k), 2).alias("x")).agg(F.sum((F.col("toxic") == 1).cast("int")).alias("ones"), F.count(F.lit(1)).alias("n")).toArrow()
    a, b = curve(*(x.column(c).to_numpy().astype(float) for c in ("x", "ones", "n")))
    return {"share": base["both"], "weights": w["both"], "lambda": lam, "k": k, "a": a, "b": b}


def score(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages) of all documents; passages: struct of
    first word, word after the last, and E, of each significant passage."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("expected", pa.float64())]))
        for batch in batches:
            for rows, w in tokens.slices(batch, "text", WORDS):
                out, where = np.full(w.n_rows, float(m["share"])), [[] for _ in range(w.n_rows)]
                if m["weights"] is not None:
                    s = word_scores(w, m["weights"])
                    for i in range(w.n_rows):
                        n = int(w.counts[i])
                        found = maximal_segments(s[w.first[i] : w.first[i + 1]])
                        x = evidence([f[2] for f in found], n, m["lambda"], m["k"])
                        out[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, m["a"] + m["b"] * x))))
                        e = [(a, b, min(float(n), m["k"] * n * math.exp(-m["lambda"] * v))) for a, b, v in found]
                        where[i] = [{"start": a, "end": b, "expected": v} for a, b, v in e if v < SIGNIFICANT]
                yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array(out), pa.array(where, kind)], ["doc_id", "score", "passages"])

    got = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, passages array<struct<start:int,end:int,expected:double>>")
    return got.select("doc_id", (F.coalesce(remainder(F.col("doc_id")), F.lit(0)) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")
