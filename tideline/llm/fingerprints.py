"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its words, each with the number of times it stands there.
For every coordinate k, every word gets gamma-distributed r and c and a uniform b, all
hashed from (word, k), so they agree between texts.  With t = floor(ln(weight) / r + b)
a word's sample is ln(c) - r (t - b + 1), and the coordinate keeps the least sample.
Two texts keep the same one with a chance of their generalised Jaccard similarity,
sum(min) / sum(max) of the weights, for each coordinate.  A sample is one number that
stands for its word and t, so the least number is all that has to be carried: a
hash aggregate of minima, a fixed number of bytes for each document.

All of it is DataFrame functions.  ``fingerprints`` groups by what the caller names,
so a table that is already dealt by a part of those columns isn't shuffled again.

Defined cases: a null text is an empty one; a text without words has the fingerprint
``EMPTY`` (zeros), like another such text and unlike all others; texts of any length
are read whole; equal texts have equal fingerprints; rows without doc_id sort first,
rows of one doc_id by a hash of their texts, equal rows follow each other; an empty
table gives an empty one; one document is its own next document; extra columns
are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tideline.llm.common import let, settle, text_bytes

#: Coordinates of a fingerprint, and how many of them one row of a term works out.
COORDINATES, STEP = 64, 8
#: Hexadecimal digits of a coordinate in the printed fingerprint.
DIGITS = 4
EMPTY = "0" * (COORDINATES * DIGITS)
#: Bytes of text in a bucket of neighbouring documents, and the most buckets (their bounds are one array).
BUCKET_BYTES, MAX_BUCKETS = 64 << 20, 1 << 16


def _unit(h: Column, low: int, bits: int) -> Column:
    """In (0, 1): some bits of a hash."""
    part = F.shiftrightunsigned(h, low) if low else h
    return (part.bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + 0.5) * 2.0**-bits


def _samples(terms: DataFrame, keys: list[str], weights: list[str], first: Column) -> DataFrame:
    """Least samples of ``STEP`` coordinates from ``first`` on: columns m<weight index>_<step>."""
    at = range(STEP)
    # x is a hash: it and the few bits of the coordinate are hashed at once
    x = terms.withColumns({f"_a{j}": F.xxhash64(F.col("x").bitwiseXOR((first + j).cast("long"))) for j in at})
    x = x.withColumns({f"_b{j}": F.xxhash64(f"_a{j}") for j in at})
    two = lambda h, low, bits: -F.log(_unit(h, low, bits) * _unit(h, low + bits, bits))  # noqa: E731  a gamma of shape 2
    x = x.withColumns({f"_r{j}": two(F.col(f"_a{j}"), 0, 32) for j in at} | {f"_c{j}": F.log(two(F.col(f"_b{j}"), 0, 21)) for j in at} | {f"_u{j}": _unit(F.col(f"_b{j}"), 42, 22) for j in at})
    value = lambda w, j: F.col(f"_c{j}") - F.col(f"_r{j}") * (F.floor(F.col(w) / F.col(f"_r{j}") + F.col(f"_u{j}")) - F.col(f"_u{j}") + 1)
    return x.groupBy(*keys).agg(*(F.min(value(w, j)).alias(f"m{i}_{j}") for i, w in enumerate(weights) for j in at))


def fingerprints(texts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, and for each text column an array of the same name): the codes of its coordinates, 1 to 65535; null
    where it has no words.  ``keys`` tell the rows apart; few and short ones, as they go along with every word."""

    def words(text: Column) -> Column:
        found = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
        # a row without words goes on as one without a term
        return let(found, lambda w: F.when(F.size(w) > 0, w).otherwise(F.array(F.lit(None).cast("string"))))

    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).alias("t")) for i, c in enumerate(columns)))).alias("e")
    x = texts.select(*keys, each).select(*keys, F.col("e.i").alias("i"), F.col("e.t").alias("t"))
    x = x.select(*keys, "i", F.explode(words(F.col("t"))).alias("w"))
    x = x.select(*keys, F.when(F.col("w").isNotNull(), F.col("i")).alias("i"), F.when(F.col("w").isNotNull(), F.xxhash64("w")).alias("x"))
    logs = [f"_w{i}" for i in range(len(columns))]
    counts = x.groupBy(*keys, "x").agg(*(F.sum((F.col("i") == i).cast("long")).alias(w) for i, w in enumerate(logs)))
    # the logarithm of no occurrence is null, and its samples are null too
    counts = counts.select(*keys, "x", *(F.log(F.col(w).cast("double")).alias(w) for w in logs))
    counts = counts.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(COORDINATES // STEP - 1))))
    least = _samples(counts, [*keys, "g"], logs, F.col("g") * STEP)
    code = lambda v: (F.pmod(F.xxhash64(v), F.lit(16**DIGITS - 1)) + 1).cast("int")
    parts = [F.array(*(code(F.col(f"m{i}_{j}")) for j in range(STEP))).alias(f"c{i}") for i in range(len(columns))]
    seen = [F.col(f"m{i}_0").isNotNull().alias(f"s{i}") for i in range(len(columns))]
    whole = least.select(*keys, F.struct("g", *parts, *seen).alias("p")).groupBy(*keys).agg(F.array_sort(F.collect_list("p")).alias("p"))
    joined = [F.when(F.col("p")[0][f"s{i}"], F.flatten(F.col(f"p.c{i}"))).alias(c) for i, c in enumerate(columns)]
    return whole.select(*keys, *joined)


def printed(codes: Column) -> Column:
    """The fingerprint as text: ``DIGITS`` hexadecimal digits a coordinate."""
    each = F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), DIGITS, "0"))
    return F.coalesce(F.array_join(each, ""), F.lit(EMPTY))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal coordinates: an estimate of the generalised Jaccard similarity of the two texts."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / F.lit(float(COORDINATES)))


def neighbours(docs: DataFrame) -> DataFrame:
    """(bucket, rn, guest, doc_id, text, next_text): each document with the next one's text, by doc_id.

    Documents are dealt once, into buckets of neighbours; the first of each bucket goes also, as a
    guest, to the end of the bucket before (the first of all to the last bucket).  Guests are to be left out by who reads this."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = F.struct("doc_id", F.xxhash64("text").alias("h"))
    ids = settle(rows.select(key.alias("key"), text_bytes(F.col("text")).alias("n")), "ids")
    size = ids.agg(F.sum("n").alias("n")).first()["n"] or 0
    buckets = min(MAX_BUCKETS, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES))
    firsts = ids.select("key").repartitionByRange(buckets, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("key"))
    # at most MAX_BUCKETS keys, as one constant
    found = firsts.agg(F.size(F.collect_list("key")).alias("n"), F.to_json(F.array_sort(F.collect_list("key"))).alias("keys")).first()
    n = found["n"]
    bounds = F.from_json(F.lit(found["keys"]), ArrayType(ids.schema["key"].dataType))
    jumps = F.array(*(F.lit(1 << k) for k in reversed(range(max(n - 1, 1).bit_length()))))
    rows = rows.withColumn("key", key)
    hop = lambda at, s: F.when((at + s < n) & (F.get(bounds, at + s) <= F.col("key")), at + s).otherwise(at)
    rows = rows.withColumn("bucket", F.aggregate(jumps, F.lit(0), hop))
    own = F.struct(F.col("bucket").alias("b"), F.lit(False).alias("guest"))
    sent = F.struct(F.pmod(F.col("bucket") - 1, F.lit(max(n, 1))).cast("int").alias("b"), F.lit(True).alias("guest"))
    places = F.when(F.get(bounds, F.col("bucket")) == F.col("key"), F.array(own, sent)).otherwise(F.array(own))
    # a bucket that can't be null: a filter for that, pushed below the shuffle by a join, would keep it from being shared
    rows = rows.select("key", "text", F.explode(places).alias("at")).select(F.coalesce("at.b", F.lit(0)).alias("bucket"), F.col("at.guest").alias("guest"), "key", "text")
    # one row of a bucket after the other: no bucket holds more than its share, whatever repeats
    w = Window.partitionBy("bucket").orderBy("guest", "key")
    return rows.repartition("bucket").select("bucket", F.row_number().over(w).alias("rn"), "guest", F.col("key.doc_id").alias("doc_id"), "text", F.lead("text").over(w).alias("next_text"))


def compare(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document:
    its edited text has the last quarter replaced by the beginning of the next document."""
    x = neighbours(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    part = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - part), F.substring(F.col("next_text"), F.lit(1), part))
    x = x.withColumn("edited", F.when(~F.col("guest"), edited))
    about = x.select("bucket", "rn", "guest", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    # both sides come from one shuffle of the texts; only short rows go on to the join
    both = about.join(fingerprints(x, ["bucket", "rn"], ["text", "edited"]).hint("merge"), ["bucket", "rn"])
    w = Window.partitionBy("bucket").orderBy("rn")
    both = both.withColumn("next", F.lead("text").over(w)).where("NOT guest")
    return both.select(
        "doc_id", "n_chars", "edited_sha256", printed(F.col("text")).alias("fingerprint"), printed(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("text"), F.col("edited")).alias("near_edited"), likeness(F.col("text"), F.col("next")).alias("near_next"),
    )
