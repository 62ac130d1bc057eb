"""Repeated passages by a sparse suffix array.

Positions.  Each window of LENGTH words retains one of its first SPARSE positions: the one whose 5-word gram has the smallest hash.
The choice depends on the window's words alone, so equal passages retain equal positions.
Suffixes.  The suffixes at retained positions are sorted by their words, as hashes of CHUNKS of them one after another, and each is compared
with both neighbours.  Those whose common prefix with a neighbour holds all chunks (PREFIX words) are candidates; any
two occurrences of LENGTH words have such suffixes, and equal ones lie together.
Extension.  A candidate stands for the windows that retain it.  It is extended left to the first of them and right to the end of the
last, and these stretches are sorted and compared with their neighbours again, whole.  A stretch that an earlier one equals is settled
by it.  Only the first stretch of a kind is compared window by window with the others, in the same way.

So a window of LENGTH words is found if and only if it occurs twice, whatever other texts share of it.  Words are compared by 64-bit
hashes, chunks and stretches by two 64-bit hashes of all their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlog.llm.bitmap import bitmap_of, passes
from weftlog.llm.storage import numbered, stable, written
from weftlog.llm.text import SPACE, Words, mix, slices, sliding_minimum, span_hashes, spans, window_hashes, window_starts, words

LENGTH, GRAM, SPARSE = 50, 5, 20
#: Words of the chunks that suffixes are sorted by.
CHUNKS = (16, 15)
PREFIX = sum(CHUNKS)
#: Bits for a word's place in a slice, below the gram's hash.
PLACE_BITS = 28
#: Ranges of a sort at most, whatever the input's size; two rows of each reach the driver.
MOST_RANGES = 16384


def retained(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a slice (their first words), and the position that each retains; of equal grams the leftmost counts."""
    at = window_starts(w.first, LENGTH)
    if not len(at):
        return at, at
    if len(w.hashes) >> PLACE_BITS:
        raise ValueError("a text is too long")
    grams = window_hashes(w.hashes, GRAM)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_minimum((grams & ~mask) | np.arange(len(grams), dtype=np.uint64), SPARSE)
    return at, (least[at] & mask).astype(np.int64)


def _second(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same words."""
    return mix(hashes ^ np.uint64(0x5851F42D4C957F2D))


def _lists(values: np.ndarray, per: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per))), pa.int32()), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, kind))


def suffix_table(docs: DataFrame) -> DataFrame:
    """For each (row, id, text): the number of words, and the retained suffixes' chunk hashes and positions."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch.column(2)):
                w = words(piece, SPACE)
                chosen = np.unique(retained(w)[1])
                text = np.searchsorted(w.first, chosen, "right") - 1
                per, n = np.bincount(text, minlength=piece.hi - piece.lo), []
                begin = chosen
                for size in CHUNKS:
                    n.append(_lists(window_hashes(w.hashes, size)[begin] if len(begin) else np.zeros(0, np.uint64), per, pa.int64()))
                    begin = begin + size
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[piece.lo : piece.hi], batch.column(1)[piece.lo : piece.hi], pa.array(w.counts.astype(np.int64)), *n, _lists((chosen - w.first[text]).astype(np.int32), per, pa.int32())],
                    names=["row", "id", "n_words", "first", "second", "at"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"row long, id {kind}, n_words long, first array<long>, second array<long>, at array<int>")


def _ranges(df: DataFrame) -> int:
    return min(MOST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def candidates(table: DataFrame) -> DataFrame:
    """Suffixes that have all chunks in common with a neighbour in the sorted order: (row, at).

    The order goes on by row and position, so suffixes that many texts share are spread over ranges.  At a range's ends the
    neighbour lies in another range; those suffixes are taken for candidates, which the extension decides.
    """

    def run(batches):
        held, equal = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            keys = [batch.column(c).to_numpy() for c in (0, 1)]
            same = np.logical_and(*(k[1:] == k[:-1] for k in keys))
            # the first row of a batch is the last of the one before
            out = np.concatenate(([equal], same)) | np.concatenate((same, [False]))
            yield batch.slice(0, len(out) - 1).filter(pa.array(out[:-1])).select(["row", "at"])
            held, equal = batch.slice(len(out) - 1), bool(out[-1])
        if held is not None:
            yield held.select(["row", "at"])

    suffixes = table.select("row", F.inline(F.arrays_zip(F.col("first").alias("first"), F.col("second").alias("second"), F.col("at").alias("at")))).select("first", "second", "row", "at")
    ordered = suffixes.repartitionByRange(_ranges(table), "first", "second", "row", "at").sortWithinPartitions("first", "second", "row", "at")
    return ordered.mapInArrow(run, "row long, at int")


def stretches(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates extended to both sides: (key, check, id, row, at, windows), where windows holds two hashes for each window from ``at`` on."""
    by_row = written(found.groupBy("row").agg(F.collect_list("at").alias("found")), "candidates")  # a text's own positions
    involved = docs.sparkSession.sparkContext.broadcast(bitmap_of(by_row.select(F.xxhash64("row").alias("h")), "h"))  # 8 MB at most

    def only_involved(batches):
        for batch in batches:
            keep = passes(involved.value, batch.column(0).to_numpy().view(np.uint64))
            yield batch.filter(pa.array(keep)).select(["row", "id", "text"])

    kind = docs.schema["id"].dataType.simpleString()
    texts = docs.select(F.xxhash64("row").alias("h"), "row", "id", "text").mapInArrow(only_involved, f"row long, id {kind}, text string")

    def run(batches):
        for batch in batches:
            found = batch.column(3).combine_chunks() if isinstance(batch.column(3), pa.ChunkedArray) else batch.column(3)
            for piece in slices(batch.column(2)):
                w = words(piece, SPACE)
                own = found[piece.lo : piece.hi]
                hit = np.zeros(len(w.hashes) + 1, dtype=bool)
                hit[own.flatten().to_numpy() + np.repeat(w.first[:-1], own.value_lengths().to_numpy())] = True
                at, place = retained(w)
                at, place = at[hit[place]], place[hit[place]]
                # a position belongs to one text, and so do all windows that retain it
                new = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(at) else np.zeros(0, np.int64)
                per = np.diff(np.append(new, len(at)))
                begin, end = at[new], at[new + per - 1] + LENGTH
                text = np.searchsorted(w.first, begin, "right") - 1
                other = _second(w.hashes)
                both = [window_hashes(h, LENGTH)[at] if len(at) else np.zeros(0, np.uint64) for h in (w.hashes, other)]
                take = pa.array(piece.lo + text)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(span_hashes(h, begin, end).view(np.int64)) for h in (w.hashes, other)), batch.column(1).take(take), batch.column(0).take(take),
                        pa.array((begin - w.first[text]).astype(np.int32)), *(_lists(h, per, pa.int64()) for h in both),
                    ],
                    names=["key", "check", "id", "row", "at", "windows", "checks"],
                )

    return texts.join(by_row, "row").select("row", "id", "text", "found").mapInArrow(run, f"key long, check long, id {kind}, row long, at int, windows array<long>, checks array<long>")


#: Records of ``compared``: a row that begins a run, a row equal to the one before it, a run's first row and its second, a range's ends.
NEW, AGAIN, FIRST, EDGE = range(4)


def compared(df: DataFrame, name: str) -> DataFrame:
    """Sort rows (key, check, id, row, at, n, more columns) and compare neighbours; equal rows are those of equal key and check.

    Records are (kind, id, row, at, n, other, more): AGAIN for each row that equals the one before it, which is ``other`` (id, row, at);
    FIRST for the first row of several, with the second as ``other``; and, if there are more columns, NEW for rows that
    begin a run, with them.  The order goes on by id, row and place, so equal rows may fill several ranges; the ends of
    the ranges, one record of each, are compared on the driver.  A range's first row is NEW too if it equals the last of the range before.
    """
    spark, place = df.sparkSession, ["id", "row", "at"]
    more = [c for c in df.columns if c not in ("key", "check", *place, "n")]
    kinds = {c: df.schema[c].dataType.simpleString() for c in df.columns}
    where = f"id:{kinds['id']},row:bigint,at:int"

    def run(batches):
        from pyspark import TaskContext

        part, head, last, again = TaskContext.get().partitionId(), None, None, False  # of the last row: itself, and whether it equals the one before
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own = batch.select(["key", "check", *place, "n"])
            if last is None:
                head = last = own.slice(0, 1)
                fresh = True
            else:
                fresh = False
            rows = pa.Table.from_batches([last, own]).combine_chunks().to_batches()[0]
            keys = np.stack([rows.column(c).to_numpy() for c in ("key", "check")])
            same = (keys[:, 1:] == keys[:, :-1]).all(0)
            same[0] &= not fresh
            second = same & ~np.concatenate(([again], same[:-1]))
            if more and not same.all():
                new = pa.array(~same)
                yield records(NEW, own.filter(new), None, part, [batch.column(c).filter(new) for c in more])
            for kind, which in ((AGAIN, same), (FIRST, second)):
                if which.any():
                    at = np.flatnonzero(which)
                    one, before = rows.take(pa.array(at + 1)), rows.take(pa.array(at))
                    yield records(kind, one, before, part) if kind == AGAIN else records(kind, before, one, part)
            last, again = own.slice(n - 1), bool(same[-1])
        if head is not None:
            ends = [x.column(c)[0].as_py() for x in (head, last) for c in ("key", "check")]
            yield records(EDGE, head, last, part, ends=pa.array([[*ends, int(again)]], pa.list_(pa.int64())))

    def records(kind, rows, other, part, extra=None, ends=None):
        n = rows.num_rows
        none = lambda t: pa.nulls(n, t)
        struct = none(pa.struct([rows.schema.field(c) for c in place])) if other is None else pa.StructArray.from_arrays(other.select(place).columns, names=place)
        lists = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), *rows.select([*place, "n"]).columns, struct, pa.array(np.full(n, part, np.int32)), none(lists) if ends is None else ends, *(extra or [none(lists) for _ in more])],
            names=["kind", *place, "n", "other", "part", "ends", *more],
        )

    order = ["key", "check", *place]
    ordered = df.select(*order, "n", *more).repartitionByRange(_ranges(df), *order).sortWithinPartitions(*order)
    schema = f"kind int, id {kinds['id']}, row long, at int, n int, other struct<{where}>, part int, ends array<long>" + "".join(f", {c} {kinds[c]}" for c in more)
    out = written(ordered.mapInArrow(run, schema), name)
    # one row for each range, MOST_RANGES at most; ends are the first and the last row's keys, and whether the last equals one before it
    edges = out.where(F.col("kind") == EDGE).select("part", "ends", "n", F.struct(*place).alias("head"), "other").orderBy("part").collect()
    fixed, before, again = [], None, False
    for e in edges:
        equal = before is not None and before.ends[2:4] == e.ends[:2]
        if equal:
            fixed.append((AGAIN, *e.head, e.n, before.other))
            if not again:
                fixed.append((FIRST, *before.other, e.n, e.head))
        before, again = e, bool(e.ends[4]) or (equal and e.head == e.other)
    columns = ["kind", *place, "n", "other", *more]
    out = out.where(F.col("kind") != EDGE).select(*columns)
    if not fixed:
        return out
    handed = spark.createDataFrame(fixed, f"kind int, id {kinds['id']}, row long, at int, n int, other struct<{where}>")
    heads = handed.where(F.col("kind") == AGAIN).select(F.lit(FIRST).alias("kind"), "row", "at")  # they are the first of their range only
    return out.join(F.broadcast(heads), ["kind", "row", "at"], "left_anti").select(*columns).unionByName(handed, allowMissingColumns=True)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, spans) of a table.

    Texts are (row, id, n_words).  Spans are (row, id, begin, end, duplicate, other, other_begin): words [begin, end) of a text are the words
    of document ``other`` from ``other_begin`` on.  ``duplicate`` spans have the other place earlier in the table (by document id, row,
    place); the others have it later, and are the first of their kind.  The windows of LENGTH words in duplicate spans are exactly
    those that occur earlier too, and those in all spans are exactly those that occur twice or more.  A span is as long as the same
    other place goes on; where the other place changes, spans overlap.  Words are runs of bytes other than ASCII blanks.
    Null, empty and short texts have no spans.  Repeated rows and ids are texts of their own, and a null id comes first.
    An empty table gives no rows, and only the two columns are read.
    """
    read = numbered(stable(docs), id=F.col(id_col), text=F.col(text_col))
    table = written(suffix_table(read), "suffixes")
    found = stretches(read, candidates(table)).withColumn("n", F.size("windows"))
    whole = compared(found, "stretches")
    single = whole.where(F.col("kind") == NEW).select("id", "row", F.posexplode(F.arrays_zip(F.col("windows").alias("key"), F.col("checks").alias("check"))).alias("i", "w"), "at")
    single = compared(single.select("w.key", "w.check", "id", "row", (F.col("at") + F.col("i")).alias("at"), F.lit(1).alias("n")), "windows")
    columns = ["kind", "id", "row", "at", "n", "other"]
    matches = whole.where(F.col("kind") != NEW).select(columns).union(single.select(columns))
    matches = matches.select(
        "row", "id", F.col("at").alias("begin"), (F.col("at") + F.col("n") + (LENGTH - 1)).alias("end"), (F.col("kind") == AGAIN).alias("duplicate"),
        F.col("other.id").alias("other"), F.col("other.row").alias("other_row"), (F.col("other.at") - F.col("at")).alias("shift"),
    )

    # runs of overlapping matches with one other place, inside one text
    own = ["row", "duplicate", "other_row", "shift"]
    by = Window.partitionBy(*own).orderBy("begin", "end")
    upto = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    joined = matches.repartition("row").withColumn("new", F.when(F.col("begin") <= upto, 0).otherwise(1))
    joined = joined.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = joined.groupBy(*own, "run").agg(F.first("id").alias("id"), F.min("begin").alias("begin"), F.max("end").alias("end"), F.first("other").alias("other"))
    return table.select("row", F.col("id"), "n_words"), found.select("row", "id", "begin", "end", "duplicate", "other", (F.col("begin") + F.col("shift")).alias("other_begin"))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """Documents with each passage that occurs earlier cut out, n_chars anew, and without those of which no word is left.

    Texts without duplicate passages stay as they are, byte for byte.
    """
    docs = stable(docs)
    rows = numbered(docs, doc=F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    _, spans = repeats(docs)
    cuts = spans.where("duplicate").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("cuts"))  # of one text
    joined = rows.join(cuts, "row", "left")

    def run(batches):
        for batch in batches:
            texts, keep = batch.column(0).to_pylist(), []
            for i, cut in enumerate(batch.column(1).to_pylist()):
                if cut:
                    texts[i] = cut_words(texts[i], [(c["begin"], c["end"]) for c in cut])
                keep.append(not cut or bool(texts[i].strip()))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[2:]], names=["text", *others]).filter(pa.array(keep))

    others = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    out = joined.select(F.col("doc.text").alias("text"), F.col("cuts").alias("cuts"), *[F.col("doc")[c].alias(f"c{i}") for i, c in enumerate(others)]).mapInArrow(run, f"text string, {kinds}")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def cut_words(text: str, cuts: list[tuple[int, int]]) -> str:
    """The text without the words of ``cuts`` and without the blanks behind each of them."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, _ = spans(data, np.array([0, len(data)]), SPACE)
    edge = np.append(starts, len(data))
    keep = np.ones(len(data), dtype=bool)
    for begin, end in cuts:
        keep[edge[begin] : edge[end]] = False
    return data[keep].tobytes().decode()


def op1_sparse_suffixes(spark, sf_dir: str) -> DataFrame:
    """Every repeated passage of each document: words [begin_word, end_word), and where another document holds them."""
    _, found = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("begin").cast("long").alias("begin_word"), F.col("end").cast("long").alias("end_word"), "duplicate",
        F.col("other").alias("other_doc_id"), F.col("other_begin").cast("long").alias("other_begin_word"),
    )
