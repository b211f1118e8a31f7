"""Substring dedup with repeated-phrase automata.

Which windows of ``WINDOW`` words also start earlier in the corpus?

1. Each window is named by its anchor: the phrase of ``PHRASE`` words inside it
   with the least hash.  Equal windows have equal anchors, and neighbouring
   windows mostly share one, so a corpus has few anchors.  Anchors that stand
   only once can't lie in a repeated window and are dropped.
2. Around the others, the stretch of words whose windows share the anchor is cut
   out.  Equal stretches collapse to one text with its first place and its count.
3. Stretch texts go to shards by their anchor.  A shard confirms which windows
   recur and where each is first (``confirm``), compiles the phrases of confirmed
   windows into an Aho-Corasick automaton (``compiled``), and streams every text
   through it (``occurrences``): only where the automaton reports a phrase are the
   windows around it compared with the confirmed ones, word by word.
4. Every place of a stretch, the first and all later ones, gets what was found in
   its text, by a join.

Anchors with more than ``HOT`` distinct stretches are cut into single windows that
collapse in the same way and go to shards by the window's own words, so no shard
grows with one common phrase; and a shard has about ``SHARD_WINDOWS`` windows whatever the input.  A document passes
only the automata that may hold phrases of it, and equal stretches pass once:
streaming each text through every shard would cost the square of the input.

Defined cases: a null or wordless text has no words and an empty result; of equal
rows all but one lose every word that a window covers; different texts under one
doc_id are documents of their own, in the order of a hash; a null doc_id stands
after all others; an empty table gives an empty result; extra columns are ignored;
a text of any length is cut whole, in one slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import tokens
from tideline.llm.common import release, settle

WINDOW, PHRASE = 20, 8
#: Distinct stretches of an anchor beyond which its windows are dealt out one by one.
HOT = 1000
SHARD_WINDOWS = 200_000
#: Stretches a task remembers having given the words of.
MAX_TOLD = 300_000
WORDS = "space"
_NONE = np.uint64(2**64 - 1)
#: Stands for a null doc_id.
LAST = 2**63 - 1
#: Bits of the map of repeated doc_ids.
TIE_BITS = 1 << 16


def anchors(w: tokens.Words, width: int = WINDOW, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (first window's word, windows, anchor hash, anchor's word)."""
    g, ok = w.grams(phrase)
    whole = np.zeros(len(g), bool)
    if len(g) >= width:
        ends = np.repeat(w.first[1:], w.counts)
        whole = np.arange(len(g)) + width <= ends
    if not whole.any():
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), z
    x = np.where(ok, g, _NONE)
    least = tokens.sliding_min(x, width - phrase + 1)
    at = np.flatnonzero(whole)
    # the place of the leftmost least phrase: the next place where x equals the minimum
    place = _next_equal(x, least, at, width - phrase + 1)
    new = np.r_[True, (np.diff(at) != 1) | (np.diff(place) != 0)]
    begin = np.flatnonzero(new)
    return at[begin], np.diff(np.r_[begin, len(at)]), least[at[begin]], place[begin]


def _next_equal(x: np.ndarray, least: np.ndarray, at: np.ndarray, reach: int) -> np.ndarray:
    place = np.full(len(at), -1, np.int64)
    left = np.arange(len(at))
    for step in range(reach):
        hit = x[at[left] + step] == least[at[left]]
        place[left[hit]] = at[left[hit]] + step
        left = left[~hit]
        if not len(left):
            break
    return place


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id, id, tie, text), and whether any doc_id repeats.  (id, tie) orders documents and tells them apart: ``tie``
    is a hash of the text where the id may be one of several rows', else 0.  It is set by a map of fixed size; an id that
    the map takes for repeated only costs bytes."""
    x = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), "text")
    at = F.pmod(F.xxhash64("id"), F.lit(TIE_BITS))
    repeated = x.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # at most TIE_BITS / 32 rows
    words = repeated.select(F.shiftright(at, 5).cast("int").alias("w"), _bit(at).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    if not words:
        return x.withColumn("tie", F.lit(0).cast("long")), False
    bits = [0] * (TIE_BITS // 32)
    for r in words:
        bits[r["w"]] = r["b"]
    marked = F.get(F.array(*(F.lit(b).cast("long") for b in bits)), F.shiftright(at, 5).cast("int")).bitwiseAND(_bit(at)) != 0
    return x.withColumn("tie", F.when(marked, F.xxhash64("text").bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long"))), True


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(31)).cast("int"))


def _ids(rows: pa.RecordBatch, row: np.ndarray) -> list[pa.Array]:
    return [rows.column(rows.schema.get_field_index(c)).take(pa.array(row)) for c in ("id", "tie")]


def anchor_places(docs: DataFrame, width: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(anchor, id, tie, at): a row for each run of windows with one anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, w in tokens.slices(batch, "text", WORDS):
                begin, n, h, _ = anchors(w, width, phrase)
                row = np.searchsorted(w.first, begin, side="right") - 1
                yield pa.RecordBatch.from_arrays([tokens.long_column(h), *_ids(rows, row), pa.array(begin - w.first[row], pa.int32())], ["anchor", "id", "tie", "at"])

    return docs.select("id", "tie", "text").mapInArrow(run, "anchor long, id long, tie long, at int")


def anchor_only(docs: DataFrame, width: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(anchor, n): counted within a slice first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, w in tokens.slices(batch, "text", WORDS):
                h, n = np.unique(anchors(w, width, phrase)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([tokens.long_column(h), pa.array(n, pa.int64())], ["anchor", "n"])

    return docs.select("text").mapInArrow(run, "anchor long, n long")


def stretches(docs: DataFrame, width: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(route, print, id, tie, at, windows, offset, words) of ``keyed`` documents: the stretches around anchors that
    stand more than once.  ``offset``: the anchor's place in the words.  A task gives the words of equal stretches once."""
    repeated = anchor_only(docs, width, phrase).groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    repeated = settle(repeated, "anchors")  # read by a join of its own, so that hot anchors can be split
    places = anchor_places(docs, width, phrase).join(repeated, "anchor")
    marked = places.groupBy("id", "tie").agg(F.collect_set("at").alias("places"))
    joined = docs.select("id", "tie", "text").join(marked, ["id", "tie"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for batch in batches:
            for rows, w in tokens.slices(batch, "text", WORDS):
                begin, n, h, place = anchors(w, width, phrase)
                row = np.searchsorted(w.first, begin, side="right") - 1
                lists = rows.column(rows.schema.get_field_index("places"))
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                wanted = np.repeat(w.first[:-1], lists.value_lengths().to_numpy()) + flat
                use = np.isin(begin, wanted)
                yield _cut(rows, w, begin[use], n[use], h[use], place[use] - begin[use], row[use], told, width)

    return joined.mapInArrow(run, "route long, print long, id long, tie long, at int, windows int, offset int, words string")


def _cut(rows: pa.RecordBatch, w: tokens.Words, begin: np.ndarray, n: np.ndarray, route: np.ndarray, offset: np.ndarray, row: np.ndarray, told: set[int], width: int) -> pa.RecordBatch:
    if len(told) > MAX_TOLD:
        told.clear()  # words may be given twice, never left out
    size = n + width - 1
    prints = _sequence_prints(w, begin, size)
    words = []
    for p, i, m in zip(prints.tolist(), begin.tolist(), size.tolist()):
        words.append(None if p in told else w.bytes_of(i, i + m).decode("utf-8", "surrogatepass"))
        told.add(p)
    return pa.RecordBatch.from_arrays(
        [tokens.long_column(route), tokens.long_column(prints), *_ids(rows, row), pa.array(begin - w.first[row], pa.int32()), pa.array(n, pa.int32()), pa.array(offset, pa.int32()), pa.array(words, pa.string())],
        ["route", "print", "id", "tie", "at", "windows", "offset", "words"],
    )


def _sequence_prints(w: tokens.Words, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of words b to b + size - 1 for each entry."""
    up, down = tokens.powers(0xB492B66FBE98F273, len(w.hash) + 1)
    total = np.r_[np.uint64(0), np.cumsum(w.hash * up[: len(w.hash)])]
    return tokens.mix((total[b + size] - total[b]) * down[b] + size.astype(np.uint64))


#: The stretch texts of a shard: place of the first, its windows, the anchor's place, how often it stands.
TEXT = ["route", "print", "fid", "ftie", "fat", "windows", "offset", "copies", "words"]
#: What was found in a text: words lo to hi - 1; ``own``: at its first place, else at all later ones.
FOUND = "route long, print long, fid long, ftie long, fat int, lo int, hi int, own boolean"
Place = tuple[int, int, int]


class Stretch:
    """One stretch text of a shard."""

    def __init__(self, row: dict, width: int, phrase: int):
        self.key = (row["route"], row["print"])
        self.place: Place = (row["fid"], row["ftie"], row["fat"])
        self.copies = row["copies"]
        words = row["words"].split(" ")
        self.windows = [" ".join(words[j : j + width]) for j in range(row["windows"])]
        self.anchor = " ".join(words[row["offset"] : row["offset"] + phrase])
        # between blanks, so that phrases match whole words
        self.text = f" {row['words']} "


def confirm(shard: list[Stretch]) -> dict[str, dict[str, Place]]:
    """By phrase, the windows that recur in the corpus with the first place of each."""
    first: dict[str, tuple[Place, int]] = {}
    for s in shard:
        d, t, at = s.place
        for j, w in enumerate(s.windows):
            here, old = (d, t, at + j), first.get(w)
            first[w] = (here, s.copies) if old is None else (min(here, old[0]), old[1] + s.copies)
    out: dict[str, dict[str, Place]] = {}
    for s in shard:
        for w in s.windows:
            place, n = first[w]
            if n > 1:
                out.setdefault(s.anchor, {})[w] = place
    return out


def compiled(phrases: Iterable[str]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for p in phrases:
        automaton.add_word(f" {p} ", p)
    if len(automaton):
        automaton.make_automaton()
    return automaton


def occurrences(s: Stretch, automaton: ahocorasick.Automaton, confirmed: dict[str, dict[str, Place]], width: int, phrase: int) -> list[tuple[int, Place]]:
    """The windows of a text that the automaton finds, with the first place of each."""
    out: dict[int, Place] = {}
    for end, p in automaton.iter(s.text) if len(automaton) else ():
        at = s.text.count(" ", 0, end - len(p) - 1)  # the word that the phrase begins with
        for j in range(max(0, at - (width - phrase)), min(len(s.windows) - 1, at) + 1):
            place = confirmed[p].get(s.windows[j])
            if place is not None:
                out[j] = place
    return sorted(out.items())


def _ranges(starts: Iterable[int], width: int) -> list[list[int]]:
    out: list[list[int]] = []
    for j in starts:
        if out and out[-1][1] >= j:
            out[-1][1] = j + width
        else:
            out.append([j, j + width])
    return out


def locate(shard: pa.Table, width: int = WINDOW, phrase: int = PHRASE) -> pa.Table:
    """What the automaton of a shard finds in its texts (FOUND)."""
    texts = {}
    for batch in shard.select(TEXT).to_batches(max_chunksize=4096):
        for row in batch.to_pylist():
            if (row["route"], row["print"]) not in texts:  # several tasks may have given the words
                texts[row["route"], row["print"]] = Stretch(row, width, phrase)
    confirmed = confirm(list(texts.values()))
    automaton = compiled(confirmed)
    out = []
    for s in texts.values():
        got = occurrences(s, automaton, confirmed, width, phrase)
        d, t, at = s.place
        for own, starts in ((True, [j for j, p in got if p != (d, t, at + j)]), (False, [j for j, _ in got] if s.copies > 1 else [])):
            out += [(*s.key, *s.place, lo, hi, own) for lo, hi in _ranges(starts, width)]
    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.bool_()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * len(kinds), kinds)], names)


def single_windows(texts: DataFrame, width: int) -> DataFrame:
    """Stretch texts cut into their windows, each routed by its own words; ``of``, ``of_print``, ``k``: where it comes from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, w in tokens.slices(batch, "words", WORDS):
                n, offset, at = (rows.column(rows.schema.get_field_index(c)).to_numpy() for c in ("windows", "offset", "fat"))
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                begin = np.repeat(w.first[:-1], n) + k
                g, _ = w.grams(width)
                row = np.repeat(np.arange(len(n)), n)
                of, of_print, fid, ftie, copies = (rows.column(rows.schema.get_field_index(c)).take(pa.array(row)) for c in ("route", "print", "fid", "ftie", "copies"))
                words = [w.bytes_of(i, i + width).decode("utf-8", "surrogatepass") for i in begin.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [tokens.long_column(g[begin]), tokens.long_column(tokens.mix(g[begin])), fid, ftie, pa.array(at[row] + k, pa.int32()), pa.array(offset[row] - k, pa.int32()), copies, pa.array(words, pa.string()), of, of_print, pa.array(k, pa.int32())],
                    ["route", "print", "fid", "ftie", "fat", "offset", "copies", "words", "of", "of_print", "k"],
                )

    return texts.select(*TEXT).mapInArrow(run, "route long, print long, fid long, ftie long, fat int, offset int, copies long, words string, of long, of_print long, k int")


def located(texts: DataFrame, windows: int, width: int, phrase: int) -> DataFrame:
    """What is found in stretch texts (FOUND); ``windows``: how many they have."""
    shards = max(1, -(-int(windows) // SHARD_WINDOWS))
    return texts.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards))).groupBy("shard").applyInArrow(lambda part: locate(part, width, phrase), FOUND)


def by_single_windows(texts: DataFrame, width: int, phrase: int) -> DataFrame:
    """``located``, of texts whose anchors have too many others to be compared in one shard."""
    singles = settle(single_windows(texts.dropDuplicates(["route", "print"]), width), "singles")
    place = F.min(F.struct("fid", "ftie", "fat")).alias("p")
    alike = singles.groupBy("route", "print").agg(place, F.sum("copies").alias("copies"), F.first("offset").alias("offset"), F.first("words").alias("words")).where("copies > 1")
    alike = alike.select("route", "print", "p.*", F.lit(1).alias("windows"), "offset", "copies", "words")
    found = located(alike, alike.count(), width, phrase).where("NOT own").select("route", "print", *(F.col(c).alias(f"_{c}") for c in ("fid", "ftie", "fat")))
    x = singles.drop("words", "offset").join(found, ["route", "print"])
    first = (F.col("fid") == F.col("_fid")) & (F.col("ftie") == F.col("_ftie")) & (F.col("fat") == F.col("_fat"))
    x = x.withColumn("own", F.explode(F.array_compact(F.array(F.when(~first, F.lit(True)), F.when(F.col("copies") > 1, F.lit(False))))))
    return x.select(F.col("of").alias("route"), F.col("of_print").alias("print"), "fid", "ftie", (F.col("fat") - F.col("k")).alias("fat"), F.col("k").alias("lo"), (F.col("k") + width).alias("hi"), "own")


def repeated_ranges(docs: DataFrame, width: int = WINDOW, phrase: int = PHRASE, hot: int = HOT) -> DataFrame:
    """(id, tie, from, to) of ``keyed`` documents: word ranges under windows that also start earlier (they may overlap)."""
    every = settle(stretches(docs, width, phrase), "stretches")
    place = F.min(F.struct(F.col("id").alias("fid"), F.col("tie").alias("ftie"), F.col("at").alias("fat"))).alias("p")
    alike = settle(every.groupBy("route", "print").agg(place, F.count(F.lit(1)).alias("copies")), "alike")
    anchors_ = alike.groupBy("route").agg(F.count(F.lit(1)).alias("stretches"))
    # an anchor with one stretch at one place has nothing to compare
    firsts = settle(alike.join(anchors_, "route").where("stretches > 1 OR copies > 1").select("route", "print", "p.*", "copies", "stretches"), "firsts")
    release(alike)
    placed = settle(every.join(firsts, ["route", "print"]).where("copies > 1 OR words IS NOT NULL"), "placed")
    release(every)
    texts = placed.where("words IS NOT NULL")
    total, most = texts.agg(F.sum("windows"), F.max("stretches")).first()
    found = located(texts.where(F.col("stretches") <= hot).select(*TEXT), total or 0, width, phrase)
    if (most or 0) > hot:
        found = found.union(by_single_windows(texts.where(F.col("stretches") > hot).select(*TEXT), width, phrase))
    found = settle(found, "found")
    own = found.where("own").select(F.col("fid").alias("id"), F.col("ftie").alias("tie"), (F.col("fat") + F.col("lo")).alias("from"), (F.col("fat") + F.col("hi")).alias("to"))
    later = placed.where("copies > 1 AND NOT (id = fid AND tie = ftie AND at = fat)").select("route", "print", "id", "tie", "at")
    later = later.join(found.where("NOT own").select("route", "print", "lo", "hi"), ["route", "print"])
    return own.union(later.select("id", "tie", (F.col("at") + F.col("lo")).alias("from"), (F.col("at") + F.col("hi")).alias("to")))


def remove(docs: DataFrame, width: int = WINDOW, phrase: int = PHRASE, hot: int = HOT, text_out: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) of every row: without the words under
    windows that also start earlier, judged on the input."""
    key, repeats = keyed(docs)
    cut = repeated_ranges(key, width, phrase, hot).groupBy("id", "tie").agg(F.collect_set(F.struct("from", "to")).alias("cut"))
    joined = key.join(cut, ["id", "tie"], "left").select("doc_id", "id", "tie", "text", "cut")
    schema = "doc_id long, id long, tie long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * text_out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, w in tokens.slices(batch, "text", WORDS):
                gone = np.zeros(len(w.hash) + 1, np.int64)
                lists = rows.column(rows.schema.get_field_index("cut"))
                of = np.repeat(w.first[:-1], lists.value_lengths().fill_null(0).to_numpy())
                flat = lists.flatten()
                lo, hi = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                np.add.at(gone, of + lo, 1)
                np.add.at(gone, of + hi, -1)
                stay = np.cumsum(gone[:-1]) == 0
                kept, texts = [], []
                raw = w.data.tobytes()
                starts, ends = w.start, w.end
                for i in range(w.n_rows):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    s = stay[a:b]
                    if s.all():
                        t = b" ".join(raw[int(w.offsets[i]) : int(w.offsets[i + 1])].split())
                    else:
                        k = a + np.flatnonzero(s)
                        t = b" ".join([raw[x:y] for x, y in zip(starts[k].tolist(), ends[k].tolist())])
                    kept.append(hashlib.sha256(t).hexdigest())
                    if text_out:
                        texts.append(t.decode("utf-8", "surrogatepass"))
                c = np.r_[0, np.cumsum(~stay)]
                cols = [*(rows.column(rows.schema.get_field_index(k)).cast(pa.int64()) for k in ("doc_id", "id", "tie")), pa.array(w.counts, pa.int64()), pa.array(c[w.first[1:]] - c[w.first[:-1]], pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(texts, pa.string())] * text_out, [x.split()[0] for x in schema.split(", ")])

    out, names = joined.mapInArrow(run, schema), ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * text_out]
    if not repeats:
        return out.select(*names)
    # of equal rows the first loses what it would lose alone, the others all that windows cover
    out = settle(out.withColumn("_n", F.monotonically_increasing_id()), "removed")
    again = (F.col("tie") != 0) & (F.col("n_words") >= width)
    first = out.where(again).groupBy("id", "tie").agg(F.min("_n").alias("_n")).select("_n", F.lit(True).alias("_first"))
    out = out.join(first, "_n", "left").withColumn("_again", again & F.col("_first").isNull())
    lost = {"n_removed": F.col("n_words"), "kept_sha256": F.lit(hashlib.sha256(b"").hexdigest()), "kept_text": F.lit("")}
    return out.select(*(F.when(F.col("_again"), lost[c]).otherwise(F.col(c)).alias(c) if c in lost else F.col(c) for c in names))
