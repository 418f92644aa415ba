"""Line dedup by pairwise alignment.

Documents that can share a block are found by line hashes.  A block needs
``MIN_WORDS`` words, so the hashes looked up are those of the shortest runs of
lines that reach them - a line that is long enough by itself, or a short line
with those after it or those before it.  Every line with words of a common
block lies in such a run within that block.  A rare run (in at most ``RARE``
distinct texts) links each text with every earlier one that has it.  A frequent
run links each text with the earliest one; where that alignment leaves a line of
the run, with the earliest of the texts left; and where that one leaves it too,
with growing batches of all earlier texts that have the run, until the run is
deleted or no such text is left.  Lines with words are thus deleted as if all pairs
were aligned, while links grow with occurrences as long as the first texts align;
a run that never aligns (twice in every text, say) costs all its pairs.  Linked
texts are aligned by patience diff (common head and tail, then lines unique on both
sides, longest increasing subsequence, and the gaps between), and an aligned
common block of at least ``MIN_WORDS`` words is deleted from the later text (a line
without words at the edge of a block can stay if its neighbours went before).
The first text that has a line never loses it to a later one.  Exact copies are
one class: a later copy of a text is one common block with the first.

Texts travel as sequences of 64-bit line hashes joined with the line length.
Defined results: order is by id (null ids last, then by text hash); a null text
has no lines and stays null; an empty text has one empty line; repeated rows
lose their blocks but for one of them - the first row of a class can't be told
from its repetition by id, so rows that repeat id and text all count as one.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHasher, materialised, runs, same, text_key, utf8_chunks

RARE, MIN_WORDS, GROWTH = 8, 10, 8


def line_runs(words: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the shortest runs of lines with at least ``least`` words
    that start or end at each line with words; ``bounds`` are the texts' first lines."""
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    line = np.flatnonzero(words > 0)
    text = np.searchsorted(bounds, line, side="right") - 1
    after = np.searchsorted(total, total[line] + least, side="left")
    before = np.searchsorted(total, total[line + 1] - least, side="right") - 1
    fits, reaches = after <= bounds[text + 1], before >= bounds[text]
    both = np.concatenate([np.stack([line, after], 1)[fits], np.stack([before, line + 1], 1)[reaches]])
    both = np.unique(both, axis=0)
    return both[:, 0], both[:, 1]


def line_sequences(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, key, hashes, words, runs``: hash and word count of each line, and
    the hashes of the runs of lines by which texts are linked."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        hasher = SpanHasher()
        for b in batches:
            hashes, counts, sizes, marks, n_marks = [], [], [], [], []
            for _, data, bounds in utf8_chunks(b.column(2)):
                newline = np.flatnonzero(data == 10)
                row = np.searchsorted(bounds, newline, side="right") - 1
                starts = np.sort(np.concatenate([bounds[:-1], newline + 1]), kind="stable")
                ends = np.sort(np.concatenate([bounds[1:], newline]), kind="stable")
                line = hasher(data, starts, ends) if len(data) else np.zeros(len(starts), np.uint64)
                hashes.append(line.view(np.int64))
                word, _ = runs((data != 32) & ((data < 9) | (data > 13)), bounds)
                counts.append((np.searchsorted(word, ends) - np.searchsorted(word, starts)).astype(np.int32))
                sizes.append(np.bincount(row, minlength=len(bounds) - 1) + 1)
                first = np.concatenate([[0], np.cumsum(sizes[-1])])
                begin, end = line_runs(counts[-1], first, min_words)
                marks.append(hasher(line, begin, end).view(np.int64))
                n_marks.append(np.diff(np.searchsorted(begin, first)))
            if not sizes:
                continue
            off, mark_off = (pa.array(np.concatenate([[0], np.cumsum(np.concatenate(n))]).astype(np.int32)) for n in (sizes, n_marks))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.ListArray.from_arrays(off, pa.array(np.concatenate(hashes))),
                 pa.ListArray.from_arrays(off, pa.array(np.concatenate(counts))),
                 pa.ListArray.from_arrays(mark_off, pa.array(np.concatenate(marks)))], ["doc_id", "key", "hashes", "words", "runs"])

    return docs.where("text IS NOT NULL").select("doc_id", text_key().alias("key"), "text").mapInArrow(
        run, f"doc_id {id_type}, key struct<a:bigint,b:bigint>, hashes array<bigint>, words array<int>, runs array<bigint>")


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs (sorted by the first) that increases in the second."""
    tails, tail_at, back = [], [], []
    for n, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        if p == len(tails):
            tails.append(j), tail_at.append(n)
        else:
            tails[p], tail_at[p] = j, n
        back.append(tail_at[p - 1] if p else -1)
    out, n = [], tail_at[-1] if tail_at else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions of two sequences by patience diff."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i2, j, j2 = todo.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i == i2 or j == j2:
            continue
        once = {}
        for x, lo, hi, side in ((a, i, i2, 0), (b, j, j2, 1)):
            for n in range(lo, hi):
                at = once.setdefault(x[n], [[], []])[side]
                if len(at) < 2:
                    at.append(n)
        common = sorted((p[0], q[0]) for p, q in once.values() if len(p) == 1 and len(q) == 1)
        anchors = _increasing(common)
        if not anchors:
            continue
        out += anchors
        for (x, y), (x2, y2) in zip([(i - 1, j - 1)] + anchors, anchors + [(i2, j2)]):
            if x + 1 < x2 and y + 1 < y2:
                todo.append((x + 1, x2, y + 1, y2))
    return sorted(out)


def common_blocks(later: list, earlier: list, words: list[int], least: int = MIN_WORDS) -> list[int]:
    """Lines of ``later`` in aligned common blocks of at least ``least`` words."""
    out, block = [], []
    for p in patience(later, earlier) + [(-9, -9)]:
        if block and p != (block[-1][0] + 1, block[-1][1] + 1):
            if sum(words[i] for i, _ in block) >= least:
                out += [i for i, _ in block]
            block = []
        block.append(p)
    return out


def _keys(links: DataFrame) -> DataFrame:
    return links.distinct().select(F.col("later.key").alias("later"), F.col("earlier.key").alias("earlier"))


def _shared(classes: DataFrame) -> DataFrame:
    """``run, rank, df, first``: runs of lines of more than one distinct text."""
    seen = classes.select("rank", F.explode(F.array_distinct("runs")).alias("run"))
    lines = seen.groupBy("run").agg(F.count("*").alias("df"), F.min("rank").alias("first")).where("df > 1")
    return materialised(seen.join(lines, "run"))


def _links(shared: DataFrame, rare: int) -> DataFrame:
    """``later, earlier``: keys of distinct texts to align first."""
    frequent = shared.where((F.col("df") > rare) & (F.col("rank") != F.col("first"))).select(
        F.col("rank").alias("later"), F.col("first").alias("earlier"))
    few = shared.where(F.col("df") <= rare).groupBy("run").agg(F.collect_list("rank").alias("ranks"))   # at most `rare`
    few = few.select(F.explode("ranks").alias("later"), "ranks").select("later", F.explode("ranks").alias("earlier")).where(
        F.col("later") > F.col("earlier"))
    return _keys(frequent.union(few))


def _further(left: DataFrame, frequent: DataFrame, turn: int) -> DataFrame:
    """Links of the ``run, rank`` that are left: in turn 1 with the earliest of them,
    then with one batch of the texts that have the run; every text is in one batch."""
    if turn == 1:
        partners = left.groupBy("run").agg(F.min("rank").alias("earlier"))
    else:
        place = F.col("df") * (F.pmod(F.xxhash64("run", "rank.key"), F.lit(1 << 30)) + 1) / (1 << 30)
        batch = F.greatest(F.lit(2), F.floor(F.log(place) / F.log(F.lit(GROWTH))) + 1)
        partners = frequent.where(batch == turn).select("run", F.col("rank").alias("earlier"))
    return _keys(left.select("run", F.col("rank").alias("later")).join(partners, "run").where("later > earlier").select("later", "earlier"))


def _aligned(pairs: DataFrame, classes: DataFrame, min_words: int) -> DataFrame:
    """``key, lines``: lines that the later text of each pair loses, if any."""
    side = classes.select("key", "hashes", "words")
    both = pairs.join(side.select(F.col("key").alias("later"), F.col("hashes").alias("l"), "words"), "later").join(
        side.select(F.col("key").alias("earlier"), F.col("hashes").alias("e")), "earlier").select("later", "l", "words", "e")

    def run(batches):
        for b in batches:
            at, lines = [], []
            for n, (l, w, e) in enumerate(zip(b.column(1), b.column(2), b.column(3))):
                got = common_blocks(l.values.to_pylist(), e.values.to_pylist(), w.values.to_pylist(), min_words)
                if got:
                    at.append(n), lines.append(got)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(lines, pa.list_(pa.int32()))],
                                             ["key", "lines"])

    return both.mapInArrow(run, "key struct<a:bigint,b:bigint>, lines array<int>")


def _per_text(found: DataFrame) -> DataFrame:
    return found.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"))


def _left(open_: DataFrame, found: DataFrame, classes: DataFrame, min_words: int) -> DataFrame:
    """The ``run, rank`` of ``open_`` with a line that has words and isn't deleted."""

    @F.arrow_udf("array<bigint>")
    def kept(asked: pa.Array, runs_: pa.Array, words: pa.Array, lines: pa.Array) -> pa.Array:
        out = []
        for q, r, w, gone in zip(asked, runs_, words, lines):
            w = w.values.to_numpy(zero_copy_only=False)
            begin, end = line_runs(w, np.array([0, len(w)]), min_words)
            stay = w > 0
            stay[np.array(gone.as_py() or [], np.int64)] = False
            total = np.concatenate([[0], np.cumsum(stay)])
            keep = r.values.to_numpy(zero_copy_only=False)[total[end] > total[begin]]
            asked_ = q.values.to_numpy(zero_copy_only=False)
            out.append(asked_[np.isin(asked_, keep)])
        return pa.array(out, pa.list_(pa.int64()))

    asked = open_.groupBy("rank").agg(F.collect_list("run").alias("asked")).withColumn("key", F.col("rank.key"))   # of one text
    texts = asked.join(classes.select("key", "runs", "words"), "key").join(_per_text(found), "key", "left")
    return materialised(texts.select("rank", F.explode(kept("asked", "runs", "words", "lines")).alias("run")))


def deletions(docs: DataFrame, min_words: int = MIN_WORDS, rare: int = RARE) -> DataFrame:
    """``key, lines``: lines to delete of each distinct text that loses any, and
    ``copies_lose``: whether later exact copies lose everything; ``first`` is
    the id of the row that is not a later copy."""
    seqs = materialised(line_sequences(docs, min_words))
    classes = seqs.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id")).alias("first"),
                                      F.first("hashes").alias("hashes"), F.first("words").alias("words"),
                                      F.first("runs").alias("runs"))
    classes = materialised(classes.withColumn("rank", F.struct(F.col("first.n").alias("n"), F.col("first.doc_id").alias("id"), "key")))
    shared = _shared(classes)
    found = materialised(_aligned(_links(shared, rare), classes, min_words))
    frequent = shared.where(F.col("df") > rare)
    most = frequent.agg(F.max("df")).first()[0] or 0
    left, turn = frequent.where(F.col("rank") != F.col("first")).select("rank", "run"), 0
    while most:
        left, turn = _left(left, found, classes, min_words), turn + 1
        if left.isEmpty() or turn > 2 and GROWTH ** (turn - 1) > most:     # no batch is left
            break
        found = found.union(materialised(_aligned(_further(left, frequent, turn), classes, min_words)))
    copied = F.aggregate("words", F.lit(0).cast("bigint"), lambda s, w: s + w) >= min_words
    return classes.select("key", F.col("first.doc_id").alias("first"), copied.alias("copies_lose")).join(_per_text(found), "key", "left")


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, rare: int = RARE) -> DataFrame:
    """``doc_id, text`` (without the deleted lines), ``n_lines, n_deleted, deleted``
    (line numbers from 0, comma-joined) of every row."""
    gone = deletions(docs, min_words, rare).where("copies_lose OR lines IS NOT NULL").select(
        F.col("key").alias("_key"), F.col("first").alias("_first"), F.col("copies_lose").alias("_lose"), F.col("lines").alias("_lines"))
    own = docs.select("doc_id", "text", text_key().alias("_key")).join(gone, "_key", "left")
    whole = F.coalesce(F.col("_lose") & ~same(F.col("doc_id"), F.col("_first")), F.lit(False))
    partly = ~whole & F.col("_lines").isNotNull()
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit("\n")) + 1)
    every = F.when(whole, F.sequence(F.lit(0), n_lines - 1)).otherwise(F.coalesce("_lines", F.array().cast("array<int>")))

    @F.arrow_udf("string")
    def without(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        kept = []
        for t, c in zip(texts, cuts):
            out = set(c.as_py() or ())
            kept.append("\n".join(x for i, x in enumerate(t.as_py().split("\n")) if i not in out) if t.is_valid else None)
        return pa.array(kept, pa.string())

    # Only texts that lose some of their lines travel to Python.
    left = without(F.when(partly, F.col("text")), F.when(partly, F.col("_lines")))
    text = F.when(whole, "").when(partly, left).otherwise(F.col("text"))
    return own.select("doc_id", text.alias("text"), n_lines.cast("bigint").alias("n_lines"),
                      F.size(every).cast("bigint").alias("n_deleted"), F.array_join(every, ",").alias("deleted"))
