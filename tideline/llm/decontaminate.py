"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of ``WINDOW`` consecutive words (a shorter
item is one window).  A window is the set of its shingles of three words (fewer
where it has fewer); a document holds it only if it holds all of them, so it is
enough to join on one: the shingle that is rarest over all documents.  A match
fixes where the window would have to begin; it must fit inside the document
(positional bound) and the document must be as long (length bound).  What is
left is compared word by word.

Texts are scanned twice, once to count benchmark shingles, once to note where the
rare ones stand with the words around them.  A scan receives a bit map of fixed
size; what it lets through falsely drops out of the exact join.

Defined cases: a null text has no words, and no windows as an item; equal rows
stay, each with the same result; items with one id are one item; an empty
benchmark contaminates nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import tokens
from tideline.llm.common import LOWER, UPPER, hidden, settle, shown

WINDOW, SHINGLE = 10, 3
#: Bits of the map a scan receives (2 MB), whatever the benchmark's size.
MAP_BITS = 1 << 24
WORDS = "alnum"
#: The same words for Spark's own functions, on text with A-Z lower-cased.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """(window array<string>, items array<string>): each text once, with its items."""
    words = F.array_remove(F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), NO_WORD), "")
    x = items.select(F.col("item_id").cast("string").alias("item"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    x = x.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, width))).alias("window"))
    return x.groupBy("window").agg(F.collect_set("item").alias("items"))


def shingles(found: DataFrame) -> DataFrame:
    """(window, shingle, at): the hashes, as in the scans, of a window's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, w in tokens.slices(batch, "line", WORDS):
                h, row, at = _grams(w, w.counts)
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row)), tokens.long_column(h), pa.array(at, pa.int32())], ["line", "shingle", "at"])

    lines = found.select(F.array_join("window", " ").alias("line"))
    return lines.mapInArrow(run, "line string, shingle long, at int")


def _grams(w: tokens.Words, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of rows: hashes, rows, places; of SHINGLE words, or all of a shorter row."""
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(row)) - w.first[:-1][row]
    out = []
    for k in range(1, SHINGLE + 1):
        h, ok = w.grams(k)
        ok &= (counts[row] >= SHINGLE) if k == SHINGLE else (counts[row] == k)
        out.append((h[ok], row[ok], at[ok]))
    return tuple(np.concatenate(x) for x in zip(*out))


def bit_map(hashes: DataFrame, column: str, bits: int = MAP_BITS) -> np.ndarray:
    """A map with a bit for each hash; only set places come to the driver, at most ``bits``."""
    at = hashes.select(F.pmod(F.col(column), F.lit(bits)).cast("int").alias("at")).distinct().toArrow().column("at").to_numpy()
    out = np.zeros(bits, bool)
    out[at] = True
    return np.packbits(out, bitorder="little")


def _let_through(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    # Spark's pmod of the signed hash by a power of two keeps the low bits
    at = (h & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _document_grams(w: tokens.Words, bits: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each size of shingle, those of the documents that the map lets through: size, hashes, word places."""
    out = []
    for k in range(1, SHINGLE + 1):
        h, ok = w.grams(k)
        at = np.flatnonzero(ok & _let_through(h, bits))
        out.append((k, h[at], at))
    return out


def counts(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(shingle, n) over all documents, of shingles that the map lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, w in tokens.slices(batch, "text", WORDS):
                h, n = np.unique(np.concatenate([x[1] for x in _document_grams(w, shared.value)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([tokens.long_column(h), pa.array(n, pa.int64())], ["shingle", "n"])

    return docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def scan(docs: DataFrame, bits: np.ndarray, width: int = WINDOW) -> DataFrame:
    """(doc_id, print, n_words, hits): a row a document, hits with the words around each rare shingle.

    ``print`` is a hash of the text's words, to tell equal doc_ids apart."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    reach = width - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("shingle", pa.int64()), ("at", pa.int32()), ("from", pa.int32()), ("around", pa.string())]))
        for batch in batches:
            for rows, w in tokens.slices(batch, "text", WORDS):
                hits: list[list[dict]] = [[] for _ in range(w.n_rows)]
                row = w.row
                for _, h, at in _document_grams(w, shared.value):
                    signed = h.view(np.int64).tolist()
                    for j, i in enumerate(at.tolist()):
                        r = int(row[i])
                        lo, hi = max(int(w.first[r]), i - reach), min(int(w.first[r + 1]), i + width)
                        around = w.bytes_of(lo, hi).decode("utf-8", "surrogatepass")
                        hits[r].append({"shingle": signed[j], "at": i - int(w.first[r]), "from": lo - int(w.first[r]), "around": around.translate(_LOWER)})
                whole = np.zeros(w.n_rows, np.uint64)
                np.add.at(whole, row, tokens.mix(w.hash + (np.arange(len(row)) - w.first[:-1][row]).astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(rows.schema.get_field_index("doc_id")).cast(pa.int64()), tokens.long_column(whole), pa.array(w.counts, pa.int64()), pa.array(hits, kind)], ["doc_id", "print", "n_words", "hits"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, print long, n_words long, hits array<struct<shingle:bigint,at:int,from:int,around:string>>")


_LOWER = str.maketrans(UPPER, LOWER)


def find(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, print, n_words, n_hit, n_items, items, contaminated) of every row."""
    found = settle(windows(items, width), "windows")
    grams = settle(shingles(found), "shingles")
    seen = counts(docs, bit_map(grams, "shingle"))
    # the prefix: a window's rarest shingle; a window with one that no document has can't occur
    rare = grams.join(seen, "shingle", "left").groupBy("line").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "at")).alias("r"))
    rare = settle(rare.where("r.n > 0").select("line", "r.shingle", "r.at"), "prefix")
    base = settle(scan(docs, bit_map(rare, "shingle"), width), "scan")
    prefix = found.withColumn("line", F.array_join("window", " ")).join(rare, "line").select("shingle", F.col("at").alias("offset"), "window", "line")
    hits = base.where(F.size("hits") > 0).select("doc_id", "print", "n_words", F.explode("hits").alias("h")).select("doc_id", "print", "n_words", "h.*")
    start, size = F.col("at") - F.col("offset"), F.size("window")
    hits = hits.join(prefix, "shingle").withColumn("start", start).withColumn("size", size)
    hits = hits.where((F.col("n_words") >= F.col("size")) & (F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words")))
    hits = hits.where(F.slice(F.split("around", " "), F.col("start") - F.col("from") + 1, F.col("size")) == F.col("window"))
    hits = hits.select("doc_id", "print", "start", "size", "line").distinct()
    hits = settle(hits, "hits")
    spans = hits.groupBy("doc_id", "print").agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("s"))
    # words under sorted spans: each adds what lies beyond the furthest end so far
    step = lambda acc, x: F.struct(
        F.greatest(acc["end"], x["start"] + x["size"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["start"] + x["size"] - F.greatest(acc["end"], x["start"]))).alias("n")
    )
    spans = spans.select("doc_id", "print", F.aggregate("s", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step)["n"].cast("long").alias("n_hit"))
    of = found.select(F.array_join("window", " ").alias("line"), F.explode("items").alias("item"))
    held = hits.select("doc_id", "print", "line").distinct().join(of, "line").groupBy("doc_id", "print").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = base.select("doc_id", "print", "n_words")
    for x in (spans, held):
        x = x.withColumnRenamed("doc_id", "_d").withColumnRenamed("print", "_p")
        out = out.join(x, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("print") == F.col("_p")), "left").drop("_d", "_p")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "print", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows whose own text isn't contaminated, whatever their doc_id: texts are judged by a hash of theirs."""
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    bad = find(texts, items, width).where("contaminated").select(F.col("doc_id").alias("_bad")).distinct()
    x, own = hidden(docs)
    return x.join(bad, F.xxhash64(own["text"]) == F.col("_bad"), "left_anti").select(*shown(own))
