"""Documents scored by cross-entropy difference of two n-gram models.

A target model (documents labelled as good) and a background model (all
documents) share one vocabulary: every word of all documents, and one sign for a
text's start.  Both are bigram models pruned alike: a bigram is kept with at least
``MIN_COUNT`` places, in a corpus of any size; a single one backs off to its word.
The models are matched: background counts are scaled to as
many words as the target has, so both are smoothed alike.  With c the counts of kept
bigrams, P(w | v) = (c(v, w) + mu * p(w)) / (sum of c(v, .) + mu), which adds up
to one, and p(w) comes from add-one unigrams.  A document's score is its mean loss a
word under the target less that under the background; below zero it is nearer to
the target.

Counts are Spark tables and grow with the corpus: words and bigrams are counted in
each task and summed by a shuffle.  Bigrams are dealt into buckets by their hashes, as many as the corpus needs;
what a task has for a bucket is one row of bytes (``packed``).  A scan receives the ``HELD`` most frequent words and
bigrams of such words and sums what they lose.  All else is exact by joins: other words get their
losses from the word table, and for other bigrams a document gets from the bigram table, bucket by bucket, what they lose less
than their words alone.  A bit map of fixed size spares most bigrams that aren't kept that join.
Words are told apart by 64-bit hashes, those that tasks hold by their numbers among them.
Texts aren't shuffled, but for those that a map of fixed size takes for labelled.

Defined cases: a null or wordless text has n_tokens 0 and null losses; equal rows, and
rows of one doc_id or none, are documents of their own, and all rows of a labelled
doc_id are target documents; null and repeated labels are ignored; with no target
document, the target model is uniform; an empty table gives an empty result; extra
columns are ignored; a text of any length is scored whole, in one slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import packed, tokens
from tideline.llm.common import bit_map, marked, release, settle

#: At most so many words, and so many bigrams, are in the model of each task; all others are joined.
KEPT = HELD = 1 << 19
#: A bigram seen less often is pruned.
MIN_COUNT = 2
#: The sign of a text's start.
START = np.uint64(1)
#: Weight of the unigram model inside a bigram's probability.
MU = 20.0
WORDS = "lower"
COUNTS = ["n_target", "n_all"]
#: Tokens that a task counts at a time.
FLUSH = 500_000
#: The same for bigrams.
PAIR_FLUSH = 3 << 19
#: Bigrams to be joined that a task sends at a time.
COLD_FLUSH = 1 << 20
#: Rows that are picked at a time, so that a batch of texts isn't copied whole.
PICK = 256
#: Bits of the map of labelled doc_ids (8 MB); what it lets through falsely, a join tells.
MAP_BITS = 1 << 26
#: Bits of the map of bigrams that are kept and that tasks don't hold (8 MB); what it lets through falsely finds no partner.
PAIR_BITS = 1 << 26


def pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A bigram of two words' numbers."""
    return (v.astype(np.uint64) << np.uint64(32)) | w.astype(np.uint64)


def places(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``x`` stands in a sorted array, and whether it does."""
    if not len(sorted_):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return at, sorted_[at] == x


def sums(keys: list[np.ndarray], good: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The distinct keys, how often they stand where ``good`` is set, and how often in all."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    upto = np.r_[0, np.cumsum(good[order])]
    ends = np.r_[at[1:], len(order)]
    return [k[at] for k in keys], upto[ends] - upto[at], ends - at


class Texts:
    """All texts, each once, and whether it is the target's."""

    def __init__(self, docs: DataFrame, good: DataFrame):
        """A scan with a bit map tells most of the other texts; those it lets through are joined with the ids and written down."""
        ids = settle(good.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "ids")
        self.map = docs.sparkSession.sparkContext.broadcast(bit_map(ids, "doc_id", MAP_BITS))
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS)))
        maybe = self.docs.mapInArrow(self._let(True), "doc_id long, text string")
        self.maybe = settle(maybe.join(ids.withColumn("good", F.lit(True)), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good")), "labelled")

    def _let(self, through: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        shared = self.map

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = marked(batch.column(2).to_numpy(), shared.value) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
                for i in range(0, len(ok), PICK):
                    yield batch.slice(i, PICK).select(["doc_id", "text"]).filter(pa.array(ok[i : i + PICK] == through))

        return run

    def _each(self, count: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What ``count`` makes of batches of texts, and whether they are the target's (a second column ``good``; without it none is)."""
        let = self._let(False)
        rest = self.docs.mapInArrow(lambda batches: count(b.select(["text", "doc_id"]) for b in let(batches)), schema)
        return rest.union(self.maybe.mapInArrow(count, schema))

    def words(self) -> DataFrame:
        """(word, n_target, n_all): how often the words stand in the target's texts and in all; counted within a task first."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held in flushes(batches, lambda w: [w.hash], FLUSH):
                (x,), t, n = sums(held[:1], held[1])
                yield pa.RecordBatch.from_arrays([tokens.long_column(x), pa.array(t.astype(np.int64)), pa.array(n.astype(np.int64))], ["word", *COUNTS])

        return self._each(count, "word long, n_target long, n_all long").groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS))

    def pairs(self, shared, n_buckets: int, least: int) -> DataFrame:
        """(v, w, n_target, n_all) of the bigrams of ``codes`` with ``least`` places; tasks count ``PAIR_FLUSH`` words at a time and
        send what they counted packed, by buckets of bigrams."""
        bits = len(shared.value).bit_length()

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held in flushes(batches, lambda x: list(codes(shared.value, x)[:2]), PAIR_FLUSH):
                for (v, w), t, n in tally(*held, bits):
                    yield pa.RecordBatch.from_arrays(bucketed(v, w, (n - 1).astype(np.uint64), t.astype(np.uint64), n_buckets), ["bucket", *packed.NAMES])

        def merge(blobs: pa.Table) -> pa.Table:
            _, (v, w, more, good) = packed.unpack_pairs(blobs)
            done = []
            for keys, (n, t) in merged(v, w, [more.view(np.int64) + 1, good.view(np.int64)], bits):
                kept = n >= least
                done.append(pa.table([tokens.long_column(x[kept]) for x in keys] + [pa.array(t[kept]), pa.array(n[kept])], ["v", "w", *COUNTS]))
            return pa.concat_tables(done)

        return self._each(count, f"bucket int, {packed.SCHEMA}").groupBy("bucket").applyInArrow(merge, "v long, w long, n_target long, n_all long")


def flushes(batches: Iterator[pa.RecordBatch], keys: Callable[[tokens.Words], list[np.ndarray]], most: int) -> Iterator[list[np.ndarray]]:
    """The keys of the words of some ``most`` words' texts at a time, and whether each is the target's."""
    held: list[list[np.ndarray]] = []
    size = 0

    def flush() -> list[np.ndarray]:
        out = [np.concatenate(c) for c in zip(*held)]
        held.clear()
        return out

    for batch in batches:
        for rows, w in tokens.slices(batch, "text", WORDS):
            is_good = rows.column(1).to_numpy(zero_copy_only=False) if rows.schema.names[1] == "good" else np.zeros(w.n_rows, bool)
            held.append([*keys(w), is_good[w.row]])
            size += len(held[-1][0])
            if size > most:
                yield flush()
                size = 0
    if size:
        yield flush()


def tally(v: np.ndarray, w: np.ndarray, good: np.ndarray, bits: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """As ``sums``, of bigrams: first those of two codes under 2 ** ``bits``, which are sorted as one key, then the others."""
    one, top = np.uint64(1), np.uint64(1 << bits)
    small = (v < top) & (w < top)
    keys = (v[small] << np.uint64(bits + 1)) | (w[small] << one) | good[small]
    keys.sort()
    key = keys >> one
    if len(key):
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[at[1:], len(key)]
        upto = np.r_[0, np.cumsum((keys & one).astype(np.int64))]
        yield [key[at] >> np.uint64(bits), key[at] & (top - one)], upto[ends] - upto[at], ends - at
    if not small.all():
        yield sums([v[~small], w[~small]], good[~small])


def merged(v: np.ndarray, w: np.ndarray, weights: list[np.ndarray], bits: int) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """The distinct bigrams and the sums of their weights, in two parts as ``tally``."""
    top = np.uint64(1 << bits)
    small = (v < top) & (w < top)
    for part, one_key in ((small, True), (~small, False)):
        a, b = v[part], w[part]
        order = np.argsort((a << np.uint64(bits)) | b) if one_key else np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(new)
        yield [a[at], b[at]], [np.add.reduceat(x[part][order], at) if len(at) else x[:0] for x in weights]


def codes(words: np.ndarray, w: tokens.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each word and the one before it by their numbers among ``words``, or else their hashes, and which have numbers."""
    at, known = places(words, w.hash)
    code = np.where(known, at.astype(np.uint64), w.hash)
    start, start_known = places(words, np.array([START]))
    begins = w.first[:-1][w.counts > 0]
    v, head = np.empty_like(code), np.empty_like(known)
    v[1:], head[1:] = code[:-1], known[:-1]
    v[begins], head[begins] = start.astype(np.uint64) if start_known[0] else START, start_known[0]
    return v, code, head, known


def hashed(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A hash of a bigram of two codes."""
    return tokens.mix(tokens.mix(v) + w)


def buckets(n_tokens: int) -> int:
    """Into how many buckets bigrams are dealt: those of a bucket have 2^19 to 2^22 places."""
    return n_tokens // min(1 << 22, max(1 << 19, n_tokens >> 12)) + 1


def bucketed(v: np.ndarray, w: np.ndarray, x: np.ndarray, y: np.ndarray, n_buckets: int, bits: int = 0) -> list[pa.Array]:
    """The numbers and blobs of the buckets of some bigrams with two more columns each; with ``bits`` they are sorted first."""
    order = np.argsort((v << np.uint64(bits)) | w) if bits else np.arange(len(v))
    b = ((hashed(v, w) >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.uint16 if n_buckets <= 1 << 16 else np.uint32)
    order = order[np.argsort(b[order], kind="stable")]
    b = b[order]
    at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
    return [pa.array(b[at].astype(np.int32)), *packed.pack_pairs(np.r_[at, len(b)], *(c[order] for c in (v, w, x, y)))]


def matches(v: np.ndarray, w: np.ndarray, of_v: np.ndarray, of_w: np.ndarray, bits: int) -> np.ndarray:
    """Where each bigram (v, w) stands among distinct others, or -1."""
    out = np.full(len(v), -1)
    top = np.uint64(1 << bits)
    mine, other = (v < top) & (w < top), (of_v < top) & (of_w < top)
    for a, b in ((mine, other), (~mine, ~other)):
        a, b = np.flatnonzero(a), np.flatnonzero(b)
        if len(a) and len(b):
            x, y = [v[a], w[a]], [of_v[b], of_w[b]]
            shift = np.uint64(bits)
            if v[a[0]] >= top or w[a[0]] >= top:
                shift, values = np.uint64(32), [np.unique(c) for c in y]
                known = [places(u, c) for u, c in zip(values, x)]
                a = a[known[0][1] & known[1][1]]
                x, y = ([np.searchsorted(u, c).astype(np.uint64) for u, c in zip(values, z)] for z in ([v[a], w[a]], y))
            key = y[0] << shift | y[1]
            order = np.argsort(key)
            at, found = places(key[order], x[0] << shift | x[1])
            out[a[found]] = b[order][at[found]]
    return out


def spots(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The place of a bigram of two codes in the bit map."""
    return (hashed(v, w) & np.uint64(PAIR_BITS - 1)).astype(np.int64)


def spot_map(cold: DataFrame) -> np.ndarray:
    """The bit map of a table of bigrams (v, w); bits are set in the tasks, PAIR_BITS / 32 words at most come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(spots(*(batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))))
            yield pa.RecordBatch.from_arrays([pa.array((at >> 5).astype(np.int32)), pa.array(np.int64(1) << (at & 31))], ["i", "b"])

    got = cold.select("v", "w").mapInArrow(run, "i int, b long").groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(PAIR_BITS // 32, np.uint32)
    out[got.column("i").to_numpy()] = got.column("b").to_numpy().astype(np.uint32)
    return out


def top(counts: DataFrame, most: int) -> int:
    """The least count that no more than ``most`` rows reach."""
    by = sorted(counts.groupBy("n_all").agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True)
    least, rows = by[0]["n_all"] + 1 if by else 1, 0
    for n, k in by:
        rows += k
        if rows > most:
            break
        least = n
    return least


class Model:
    """What every task receives: counts of the frequent words and bigrams, by sorted hashes, and the map of other bigrams."""

    def __init__(self, words: pa.Table, totals: tuple[int, int, int], mu: float):
        self.good, self.every, self.n_words = totals
        self.mu, self.total, self.n_buckets = mu, self.good or self.every, buckets(self.every)
        self.words, *word_counts = self._sorted(words, "word")
        self.word_loss = [self.one(kind, n) for kind, n in enumerate(word_counts)]

    def take(self, bigrams: pa.Table, mass: pa.Table, cold: np.ndarray) -> None:
        """Bigrams of numbered words (pair), kept places by numbered first word (v), and the map of the kept bigrams not given."""
        self.pairs, *pair_counts = self._sorted(bigrams, "pair")
        self.pair_count = [n * self.scale(kind) for kind, n in enumerate(pair_counts)]
        self.head_loss = []
        for kind, c in enumerate(COUNTS):
            n = np.zeros(len(self.words))
            n[mass.column("v").to_numpy()] = mass.column(c).to_numpy() * self.scale(kind)
            self.head_loss.append(np.log2(n + self.mu))
        self.cold = cold

    @staticmethod
    def _sorted(table: pa.Table, key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = table.column(key).to_numpy().view(np.uint64)
        order = np.argsort(x)
        return x[order], *(table.column(c).to_numpy().astype(np.float64)[order] for c in COUNTS)

    def scale(self, kind: int) -> float:
        n = (self.good, self.every)[kind]
        return self.total / n if n else 0.0

    def one(self, kind: int, n):
        """p(w) of a word with n places, a number, an array or a Column."""
        mass = self.total if (self.good, self.every)[kind] else 0
        return (n * self.scale(kind) + 1.0) / float(mass + self.n_words or 1)

    def losses(self, v: np.ndarray, w: np.ndarray, head: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which bigrams the table may hold, and the losses of all: without log p(w) of words that have no number, without
        the kept places of first words that have none, and as if bigrams that aren't held were not kept."""
        both = head & known
        p_at, held = places(self.pairs, pair(v, w))
        held &= both
        out = []
        for kind in (0, 1):
            one = np.ones(len(v))
            one[known] = self.word_loss[kind][w[known].view(np.int64)]
            c = np.zeros(len(v))
            c[held] = self.pair_count[kind][p_at[held]]
            loss = -np.log2(c + self.mu * one)
            loss[head] += self.head_loss[kind][v[head].view(np.int64)]
            out.append(loss)
        maybe = ~held
        maybe[maybe] = marked(spots(v[maybe], w[maybe]), self.cold)
        return maybe, out


def numbered(column: str, n: int):
    """Is a code a number among ``n`` words?"""
    return F.col(column).between(0, n - 1)


def fit(docs: DataFrame, good: DataFrame, mu: float = MU, kept: int | None = None, held: int = HELD) -> tuple[Model, DataFrame, DataFrame]:
    """The model of each task; (word, n_target, n_all, m_target, m_all) of the words that tasks don't hold, with the kept places of
    bigrams they begin; and, packed by buckets, the kept bigrams that tasks don't hold, with their counts in the target and in all, or
    else (``less``) with the bits that they lose less.
    With ``kept``, bigrams with a share under 1 / ``kept`` are pruned as well."""
    spark = docs.sparkSession
    texts = Texts(docs, good)
    words = settle(texts.words(), "words")
    totals = tuple(x or 0 for x in words.agg(F.sum("n_target"), F.sum("n_all"), F.count(F.lit(1))).first())
    often = top(words, held)
    sign = spark.createDataFrame([(int(START), 0, 0)], "word long, n_target long, n_all long")
    model = Model(words.where(F.col("n_all") >= often).union(sign).toArrow(), totals, mu)
    n = len(model.words)
    shared = spark.sparkContext.broadcast(model.words)
    least = max(MIN_COUNT, -(-totals[1] // kept)) if kept else MIN_COUNT
    pairs = settle(texts.pairs(shared, model.n_buckets, least), "pairs")
    release(texts.maybe)

    inside = numbered("v", n) & numbered("w", n)
    hot = inside & (F.col("n_all") >= top(pairs.where(inside), held))
    cold = pairs.where(~hot)
    mass = pairs.groupBy("v").agg(*(F.sum(c).alias(c) for c in COUNTS))
    one_key = F.call_function("shiftleft", F.col("v"), F.lit(32)).bitwiseOR(F.col("w")).alias("pair")
    model.take(pairs.where(hot).select(one_key, *COUNTS).toArrow(), mass.where(numbered("v", n)).toArrow(), spot_map(cold))

    def box(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = bucketed(*(batch.column(i).to_numpy().view(np.uint64) for i in range(4)), n_buckets, bits)
            yield pa.RecordBatch.from_arrays([*out, pa.repeat(pa.types.is_floating(batch.column(2).type), len(out[0]))], ["bucket", *packed.NAMES, "less"])

    n_buckets, bits, schema = model.n_buckets, n.bit_length(), f"bucket int, {packed.SCHEMA}, less boolean"
    known = cold.where(numbered("w", n))
    own = words.where(F.col("n_all") < often)
    less = lambda kind, c: F.log2(1 + F.col(f"p.{c}") * model.scale(kind) / (mu * model.one(kind, F.col(f"o.{c}")))).alias(c)
    other = cold.where(~numbered("w", n)).alias("p").join(own.alias("o"), F.col("p.w") == F.col("o.word")).select("v", "w", less(0, "n_target"), less(1, "n_all"))
    heads = mass.where(~numbered("v", n)).select(F.col("v").alias("word"), F.col("n_target").alias("m_target"), F.col("n_all").alias("m_all"))
    return model, own.join(heads, "word", "left").fillna(0, ["m_target", "m_all"]), known.mapInArrow(box, schema).union(other.mapInArrow(box, schema))


def tallied(n_rows: int, row: np.ndarray, keys: list[np.ndarray], weights: list[np.ndarray]) -> tuple[pa.Array, ...]:
    """Keys grouped by row: lists of each row's distinct keys, and of the sums of their weights."""
    order = np.lexsort((*keys[::-1], row))
    row, keys = row[order], [k[order] for k in keys]
    new = np.zeros(len(row), bool)
    new[:1] = True
    for x in (row, *keys):
        new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)
    ends = pa.array(np.searchsorted(row[at], np.arange(n_rows + 1)).astype(np.int32))
    totals = [np.add.reduceat(x[order], at) if len(at) else np.zeros(0, np.int64) for x in weights]
    lists = [pa.ListArray.from_arrays(ends, tokens.long_column(k[at])) for k in keys]
    return *lists, *(pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in totals)


def score(docs: DataFrame, model: Model, words: DataFrame, bigrams: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, difference) in bits a word."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bits, n_buckets = len(model.words).bit_length(), model.n_buckets
    schema = "row long, doc_id long, n_tokens long, t double, b double, words array<bigint>, times array<int>, heads array<int>"
    names = [c.split()[0] for c in schema.split(", ")]

    def sent(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        v, w, row = (np.concatenate(c) for c in zip(*held))
        out = bucketed(v, w, (row - row.min()).view(np.uint64), np.zeros(len(v), np.uint64), n_buckets, bits)
        types = [pa.int64()] * 3 + [pa.float64()] * 2 + [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(out[0]), t) for t in types), *out, pa.repeat(pa.scalar(row.min(), pa.int64()), len(out[0]))], [*names, "bucket", *packed.NAMES, "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        held: list[list[np.ndarray]] = []
        for batch in batches:
            for rows, w in tokens.slices(batch, "text", WORDS):
                v, x, head, known = codes(m.words, w)
                maybe, losses = m.losses(v, x, head, known)
                row = w.row
                lost = [np.bincount(row, weights=y, minlength=w.n_rows) for y in losses]
                ends = np.repeat([1, 0], [(~known).sum(), (~head).sum()])
                rest = tallied(w.n_rows, np.r_[row[~known], row[~head]], [np.r_[x[~known], v[~head]]], [ends, 1 - ends])
                doc_id, number = (rows.column(rows.schema.get_field_index(c)).cast(pa.int64()) for c in ("doc_id", "row"))
                none = [pa.nulls(w.n_rows, t) for t in (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64())]
                yield pa.RecordBatch.from_arrays([number, doc_id, pa.array(w.counts, pa.int64()), *map(pa.array, lost), *rest, *none], [*names, "bucket", *packed.NAMES, "first"])
                if maybe.any():
                    held.append([v[maybe], x[maybe], number.to_numpy()[row[maybe]]])
                if sum(len(c[0]) for c in held) > COLD_FLUSH:
                    yield sent(held)
                    held.clear()
        if held:
            yield sent(held)

    def look(mine: pa.Table, table: pa.Table) -> pa.Table:
        """What the rows lose less by the bigrams of a bucket."""
        if not mine.num_rows or not table.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.float64(), pa.float64())], ["row", *COUNTS])
        m = shared.value
        at, (v, w, row, _) = packed.unpack_pairs(mine)
        row = row.view(np.int64) + np.repeat(mine.column("first").to_numpy(), np.diff(at))
        ends, (of_v, of_w, *c) = packed.unpack_pairs(table)
        less = np.repeat(table.column("less").to_numpy(), np.diff(ends))
        i = matches(v, w, of_v, of_w, bits)
        row, i = row[i >= 0], i[i >= 0]
        rows, of = np.unique(row, return_inverse=True)
        out = []
        for kind in (0, 1):
            saved = c[kind].view(np.float64).copy()
            saved[~less] = np.log2(1 + c[kind][~less] * m.scale(kind) / (m.mu * m.word_loss[kind][of_w[~less].view(np.int64)]))
            out.append(-np.bincount(of, weights=saved[i], minlength=len(rows)))
        return pa.table([pa.array(x) for x in (rows, *out)], ["row", *COUNTS])

    numbers = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    both = settle(numbers.mapInArrow(run, f"{schema}, bucket int, {packed.SCHEMA}, first long"), "scored")
    base = both.where("bucket IS NULL")
    zipped = lambda *c: base.select("row", F.inline(F.arrays_zip(*c)))
    # the words that tasks don't hold: each has its losses, as a word and as the one before, from the word table
    word = lambda kind, c, m: (F.log2(F.col(m) * model.scale(kind) + model.mu) * F.col("heads") - F.log2(model.one(kind, F.col(c))) * F.col("times")).alias(c)
    rest = zipped("words", "times", "heads").withColumnRenamed("words", "word").join(words, "word").select("row", word(0, "n_target", "m_target"), word(1, "n_all", "m_all"))
    # the bigrams that tasks don't hold
    mine = both.where("bucket IS NOT NULL").select("bucket", *packed.NAMES, "first")
    cold = mine.groupBy("bucket").cogroup(bigrams.groupBy("bucket")).applyInArrow(look, "row long, n_target double, n_all double")
    parts = rest.union(cold).groupBy("row").agg(F.sum("n_target").alias("rt"), F.sum("n_all").alias("rb"))
    x = base.select("row", "doc_id", "n_tokens", "t", "b").join(parts, "row", "left")
    mean = lambda a, b: F.when(F.col("n_tokens") > 0, (F.col(a) + F.coalesce(b, F.lit(0.0))) / F.col("n_tokens"))
    out = x.select("doc_id", "n_tokens", mean("t", "rt").alias("target_loss"), mean("b", "rb").alias("background_loss"))
    return out.withColumn("difference", F.col("target_loss") - F.col("background_loss"))


def cross_entropy_difference(docs: DataFrame, good: DataFrame, mu: float = MU, kept: int | None = None, held: int = HELD) -> DataFrame:
    """Scores of all documents; ``good`` holds the doc_ids of the target's documents."""
    return score(docs, *fit(docs, good, mu, kept, held))
