"""Quality rules by distribution divergence.

A document's character classes and common words are counted and held against
references of its language by Jensen-Shannon distance (base 2, between 0 and 1).
The references are the same counts over all documents of the language, and over
all documents together for a null one.  A distance counts only from a minimum length
on: short texts are too noisy.  The word distance is judged against that of a text
without any common word from the same reference: from ``MAX_WORD_SHARE`` of it on, a
text has no more of its language's common words than a list of keywords has.

One pass over the texts makes the references (a sum a language), a second one
judges; nothing but the sums is shuffled.  References of languages with a thousandth
of all characters or more (at most ``HOT`` of them) are broadcast; texts of other
languages, if there are any, meet theirs in a shuffle join.

Defined cases: a null or empty text has no words and fails the base rules; a text
under the minimum lengths has null distances and isn't rejected by them; rows without
doc_id and repeated rows stay, each judged alike; an empty table gives an empty
result; extra columns stay; a text of any length is counted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import hidden, let, settle, shown

# Frequent words of four languages, and the symbols of the contract.
COMMON = (
    "the of and to in is that for it as was with be by on at this are from or an "
    "le la les de des et en un une du que qui pour dans au sur est par ne pas "
    "der die und das den von zu mit sich auf für ist im dem nicht ein eine als auch es "
    "el los y del se las con no su lo más o pero sus"
).split()
SYMBOLS = r"[#*$%&|<>]"
#: Spark expressions of the counted classes; what is left over counts as lower-case letters and others.
CLASSES = {"upper": r"\p{Lu}", "digit": r"[0-9]", "mark": r"[.,;:!?'\"()-]"}

#: References of languages with a share of one in so many characters are broadcast.
HOT = 1000
MIN_CHARS, MIN_WORDS = 200, 100
#: Distances above these reject a document; that of words also from a share on of the distance of a text without common words.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, MAX_WORD_SHARE = 0.28, 0.5, 0.95
WINDOW = 8


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def repeated_words(words: Column, k: int = WINDOW) -> Column:
    """Words inside windows of k words that occur twice or more in the array."""
    n = F.size(words)
    hashes = F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        by_hash = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(z: Column) -> Column:
            twice = lambda e, i: (F.get(z, i - 1)["h"] == e["h"]) | (F.get(z, i + 1)["h"] == e["h"])
            return F.sort_array(F.transform(F.filter(z, lambda e, i: F.coalesce(twice(e, i), F.lit(False))), lambda e: e["i"]))

        # each window adds the words up to the next one's start
        span = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(k), F.coalesce(F.get(p, i + 1) - x, F.lit(k)))), F.lit(0), lambda a, x: a + x)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(by_hash, places), span))

    return let(hashes, covered).cast("long")


def _counted(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``_words``, then the base counts and both histograms."""
    t = F.coalesce(F.col(text), F.lit(""))
    x = docs.withColumn("_words", words_of(F.col(text)))
    x = x.withColumn("n_words", F.size("_words").cast("long")).withColumn("word_chars", F.char_length(F.array_join("_words", "")).cast("long"))
    x = x.withColumn("n_symbols", F.regexp_count(t, F.lit(SYMBOLS)).cast("long"))
    for name, pattern in CLASSES.items():
        x = x.withColumn(f"_{name}", F.regexp_count(t, F.lit(pattern)).cast("long"))
    x = x.withColumn("_chars", F.char_length(t).cast("long"))
    kinds = [F.col("_chars") - F.col("word_chars"), *(F.col(f"_{c}") for c in CLASSES), F.col("n_symbols")]
    x = x.withColumn("_kinds", F.array(*kinds, F.col("word_chars") - sum(map(F.col, (f"_{c}" for c in CLASSES)), F.col("n_symbols"))))
    found = F.filter("_words", lambda w: w.isin(COMMON))
    return x.withColumn("_common", let(found, lambda f: F.array(*(F.size(f) - F.size(F.array_remove(f, c)) for c in COMMON), F.size("_words") - F.size(f))))


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(_l, _all, _rk, _rc, _rd): each language's summed kinds and common words, and the distance of a text without
    common words; one row has the sums of all documents (``_all`` = 1)."""
    x = _counted(docs, text)
    n, m = 2 + len(CLASSES) + 1, len(COMMON) + 1
    sums = [F.sum(F.col("_kinds")[i]).alias(f"k{i}") for i in range(n)] + [F.sum(F.col("_common")[i]).cast("long").alias(f"c{i}") for i in range(m)]
    # of all documents: the rollup's total, from the same partial sums
    by = x.withColumn("_l", F.col(lang)).rollup("_l").agg(F.grouping("_l").alias("_all"), *sums)
    # a row a language; written once, as the judging reads it more than once
    shape = by.select("_l", "_all", F.array(*(f"k{i}" for i in range(n))).alias("_rk"), F.array(*(f"c{i}" for i in range(m))).alias("_rc"))
    none = F.array(*[F.lit(0.0)] * (m - 1), F.lit(1.0))
    return settle(shape.withColumn("_rd", distance(none, F.transform("_rc", lambda v: v.cast("double")))), "references")


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts; null if one is all zero."""

    def plogp(a: Column) -> Column:
        return F.when(a > 0, a * F.log2(a)).otherwise(0.0)

    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)

    def of(a: Column, b: Column) -> Column:
        # the mean's entropy less the mean of the entropies
        m = F.zip_with(a, b, lambda u, v: (plogp(u) + plogp(v)) / 2 - plogp((u + v) / 2))
        return F.sqrt(F.greatest(total(m), F.lit(0.0)))

    share = lambda a: let(total(a), lambda t: F.transform(a, lambda v: v / t))
    return F.when((total(p) > 0) & (total(q) > 0), let(F.struct(share(p).alias("p"), share(q).alias("q")), lambda s: of(s["p"], s["q"])))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Every row with the base counts, base_failed, class_distance, word_distance and kept."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")
    docs, own = hidden(docs)
    text, lang = own[text], own[lang]
    refs = references(docs, text, lang)
    x = _counted(docs, text)
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    x = x.withColumn("n_dup_lines", let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"))
    x = x.withColumn("n_repeat_words", repeated_words(F.col("_words"))).drop("_words")
    x = x.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return _with_distances(x, refs, lang).select(*shown(own, names), *names)


def _with_distances(x: DataFrame, refs: DataFrame, lang: str) -> DataFrame:
    as_double = lambda c: F.transform(c, lambda v: v.cast("double"))
    # one row, the sums of all documents, becomes constants
    every = refs.where("_all = 1").first()
    whole = {c: F.array(*(F.lit(v).cast("long") for v in every[c])) if every else F.lit(None).cast("array<bigint>") for c in ("_rk", "_rc")} | {"_rd": F.lit(every["_rd"] if every else None).cast("double")}
    share = F.aggregate("_rk", F.lit(0).cast("long"), lambda a, v: a + v) * HOT >= (sum(every["_rk"]) if every else 0)
    own = refs.where("_all = 0 AND _l IS NOT NULL").withColumn("_hot", share)
    # of shares of 1 / HOT or more: at most HOT rows of some 800 bytes
    x = x.join(F.broadcast(own.where("_hot").select("_l", *whole)), F.col(lang) == F.col("_l"), "left")
    if own.where("NOT _hot").isEmpty():
        ref = {c: F.coalesce(c, whole[c]) for c in whole}
    else:
        rest = own.where("NOT _hot").select(F.col("_l").alias("_l2"), *(F.col(c).alias(f"{c}2") for c in whole))
        # a text that has its reference goes anywhere
        key = F.when(F.col("_l").isNull() & F.col(lang).isNotNull(), F.col(lang)).otherwise(F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string")))
        x = x.withColumn("_key", key).join(rest, F.col("_key") == F.col("_l2"), "left")
        ref = {c: F.coalesce(c, f"{c}2", whole[c]) for c in whole}
    near = lambda mine, r: distance(as_double(F.col(mine)), as_double(r))
    x = x.withColumn("class_distance", F.when(F.col("_chars") >= MIN_CHARS, near("_kinds", ref["_rk"])))
    x = x.withColumn("word_distance", F.when(F.col("n_words") >= MIN_WORDS, near("_common", ref["_rc"])))
    most = F.least(F.lit(MAX_WORD_DISTANCE), F.when(ref["_rd"] > 0, MAX_WORD_SHARE * ref["_rd"]))
    fits = (F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASS_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= most)
    return x.withColumn("kept", ~F.col("base_failed") & fits)


def keep(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that pass every rule, with their own columns."""
    x, names = hidden(docs)
    # the row number keeps the filter above the counts; pushed below them it would cut a text into words once for each use
    judged = judge(x, names[text], names[lang]).select(*names.values(), "kept", F.monotonically_increasing_id().alias("_row"))
    return judged.where("kept AND _row >= 0").select(*shown(names))
