"""Near-duplicate documents by order MinHash, verified by banded alignment.

A text is the sequence of its five-word shingles, each labelled by its occurrence number in the text (a text of fewer words is one
shingle).  A sketch takes the TUPLE labelled shingles of smallest hash and keeps them in text order; texts whose
shingles stand in another order therefore differ in sketches too.  Two texts are linked if the longest common subsequence
of their shingles holds SIMILARITY of all that either has: common / (own + own - common).
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.llm.bitmap import bitmap_of, passes
from weftlog.llm.components import components
from weftlog.llm.storage import numbered, stable, written
from weftlog.llm.text import SPACE, Words, mix, slices, span_hashes, window_hashes, window_starts, words

SHINGLE, SIMILARITY = 5, 0.8
#: Sketches of a text; a pair of similarity 0.8 shares each with a chance of about 0.64. They bound the work only: what they leave is found by prefixes.
SKETCHES, TUPLE = 12, 2
#: Entries of a shingle from which its pairs are dealt to several tasks.
BLOCK = 500
#: Bits of a text's map of shingles.
BITS = 1024
#: Documents of the sample that tells common shingles, and common shingles told; both change the work only, never the pairs.
SAMPLE_DOCS, COMMON = 20_000, 200_000

_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def labelled_shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Labelled shingles of all texts, and the first of each text."""
    counts, n = w.counts, len(w.counts)
    per = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    first = np.concatenate(([0], np.cumsum(per)))
    out = np.zeros(first[-1], np.uint64)
    long, short = counts >= SHINGLE, (counts > 0) & (counts < SHINGLE)
    text = np.repeat(np.arange(n), per)
    out[long[text]] = window_hashes(w.hashes, SHINGLE)[window_starts(w.first, SHINGLE)] if long.any() else 0
    out[first[:-1][short]] = span_hashes(w.hashes, w.first[:-1][short], w.first[1:][short])
    # occurrence numbers: places in runs of equal (text, shingle)
    own = out ^ mix(text.astype(np.uint64))
    order = np.argsort(own, kind="stable")
    place = np.arange(len(own))
    begins = np.concatenate(([True], own[order][1:] != own[order][:-1])) if len(own) else np.zeros(0, bool)
    nth = np.zeros(len(own), np.int64)
    nth[order] = place - np.maximum.accumulate(np.where(begins, place, 0)) if len(own) else 0
    again = nth > 0
    out[again] = mix(out[again] + nth[again].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out, first


def sketches(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, SKETCHES) hashes of ordered tuples; texts without shingles get arbitrary values."""
    per = np.diff(first)
    full = np.flatnonzero(per)
    out = np.zeros((len(per), SKETCHES), np.int64)
    if not len(full):
        return out
    begins, sizes = first[:-1][full], per[full]
    for j in range(SKETCHES):
        seed = mix(np.array([j + 101], np.uint64))[0]
        value = (shingles ^ seed) * (seed | np.uint64(1))
        value ^= value >> np.uint64(32)
        value *= np.uint64(0x94D049BB133111EB)
        places = []
        for t in range(TUPLE):
            least = np.minimum.reduceat(value, begins)
            at = np.flatnonzero(value == np.repeat(least, sizes))
            at = at[np.unique(np.repeat(np.arange(len(full)), sizes)[at], return_index=True)[1]]  # the first of ties
            places.append(np.where(sizes > t, at, -1))  # a text with fewer shingles repeats none
            value[at] = _TOP
        places = np.sort(np.stack(places, axis=1), axis=1)
        key = np.full(len(full), np.uint64(j), np.uint64)
        for t in range(TUPLE):
            key = mix(key * np.uint64(31) + np.where(places[:, t] >= 0, shingles[places[:, t]], np.uint64(7)))
        out[full, j] = key.astype(np.int64)
    return out


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Similarity of two shingle sequences, or 0 where it is under ``similarity``.

    Labelled shingles are unique in a text, so a common subsequence is an increasing run of places in ``b``.  With ``most`` as the
    number of unmatched shingles that the threshold allows, no match of a good alignment lies outside the band |i - j| <= most.
    """
    total = len(a) + len(b)
    need = int(np.ceil(similarity * total / (1 + similarity) - 1e-9))
    if min(len(a), len(b)) < need:
        return 0.0
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    inside = np.abs(i - j) <= total - 2 * need
    i, j = i[inside], j[inside]
    if len(i) < need:
        return 0.0
    run = j[np.argsort(i)]
    if np.all(run[1:] > run[:-1]):
        matched = len(run)
    else:
        tails: list[int] = []
        for x in run.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        matched = len(tails)
    found = matched / (total - matched)
    return found if found >= similarity - 1e-12 else 0.0


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles of several texts of a hash sample, rarest first."""
    share = min(1.0, SAMPLE_DOCS / max(docs.count(), 1))
    drawn = docs.where(F.pmod(F.xxhash64("row", F.lit(17)), F.lit(1_000_000)) < int(1e6 * share)).select("text")

    def run(batches):
        for batch in batches:
            for piece in slices(batch.column(0)):
                found, n = np.unique(labelled_shingles(words(piece, SPACE))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    counted = drawn.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > 2)
    rows = counted.orderBy(F.desc("n"), "h").limit(COMMON).select("h").toArrow().column(0).to_numpy()  # 1.6 MB at most
    return rows.view(np.uint64)[::-1].copy()


def prefixes(shingles: np.ndarray, first: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each text that come first in one order of all shingles (rare ones first), and their numbers.

    A text of n shingles needs ceil(SIMILARITY * n) of them in common with any that it is linked to.  So two linked texts share
    one of the n - ceil(SIMILARITY * n) + 1 that come first in each, whatever the order is.
    """
    n = np.diff(first)
    rank = np.zeros(len(shingles), np.int64)
    if len(common):
        by_value = np.argsort(common)
        at = np.minimum(np.searchsorted(common[by_value], shingles), len(common) - 1)
        same = common[by_value][at] == shingles
        rank[same] = by_value[at[same]] + 1
    text = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((shingles, rank, text))
    take = np.where(n > 0, n - np.ceil(SIMILARITY * n - 1e-9).astype(np.int64) + 1, 0)
    return shingles[order][np.arange(len(shingles)) - first[:-1][text] < take[text]], take


def shingle_maps(shingles: np.ndarray, first: np.ndarray) -> list[bytes]:
    """A bitmap of BITS for each text."""
    n = len(first) - 1
    bits = np.zeros((n, BITS), bool)
    bits[np.repeat(np.arange(n), np.diff(first)), (mix(shingles) % np.uint64(BITS)).astype(np.int64)] = True
    return [row.tobytes() for row in np.packbits(bits, axis=1)]


def sketch_table(docs: DataFrame) -> DataFrame:
    """For each (row, id, text): a digest of the text, its shingles' number, its sketches (arbitrary without words), prefix and bitmap."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))

    def run(batches):
        for batch in batches:
            for piece in slices(batch.column(3)):
                shingles, first = labelled_shingles(words(piece, SPACE))
                n = np.diff(first)
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(n) + 1) * SKETCHES, SKETCHES), pa.int32()), pa.array(sketches(shingles, first).reshape(-1)))
                own, take = prefixes(shingles, first, common.value)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(take))), pa.int32()), pa.array(own.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c)[piece.lo : piece.hi] for c in range(3)), pa.array(n.astype(np.int64)), values, lists, pa.array(shingle_maps(shingles, first), pa.binary())],
                    names=["row", "id", "digest", "n", "sketches", "prefix", "bits"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("row", "id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "text").mapInArrow(
        run, f"row long, id {kind}, digest binary, n long, sketches array<long>, prefix array<long>, bits binary"
    )


def candidate_pairs(texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows to verify first, from (row, n, sketches); they make the units, and ``prefix_pairs`` gives the rest.

    Buckets are texts with an equal sketch, and those whose next sketch is equal too.  Each text is paired with the most central of
    its bucket, which shares buckets with the most texts, so the pairs grow with the rows and not with the squares of the buckets.
    """
    pair = lambda j: F.array(F.get("sketches", F.lit(j)), F.xxhash64(F.get("sketches", F.lit(j)), F.get("sketches", F.lit((j + 1) % SKETCHES))))
    level = texts.select("row", "n", F.explode(F.flatten(F.array(*[pair(j) for j in range(SKETCHES)]))).alias("key"))
    sizes = level.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    level = written(level.join(sizes, "key"), "buckets")
    centrality = level.groupBy("row").agg(F.sum("size").alias("score"))
    level = written(level.drop("size").join(centrality, "row"), "level")
    best = written(level.groupBy("key").agg(F.max(F.struct("score", (-F.col("row")).alias("minus"), "n")).alias("best")), "centres")
    led = level.join(best, "key").select("row", "n", (-F.col("best.minus")).alias("centre"), F.col("best.n").alias("m")).where(F.col("row") != F.col("centre"))
    led = led.where(F.least("n", "m") >= SIMILARITY * F.greatest("n", "m"))
    return led.select(F.least("row", "centre").alias("a"), F.greatest("row", "centre").alias("b")).distinct()


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that alignment finds to have SIMILARITY, and how much. ``texts`` is (row, text)."""
    pairs = written(pairs, "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("row")).select(F.xxhash64("row").alias("h"))
    involved = texts.sparkSession.sparkContext.broadcast(bitmap_of(ends, "h", 2 * pairs.count()))  # 8 MB at most; a row of several pairs counts each time

    def only_involved(batches):
        for batch in batches:
            yield batch.filter(pa.array(passes(involved.value, batch.column(0).to_numpy().view(np.uint64)))).select(["row", "text"])

    needed = texts.select(F.xxhash64("row").alias("h"), "row", "text").mapInArrow(only_involved, "row long, text string")

    def compare(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                if not part.num_rows:
                    continue
                both = []
                for c in (2, 3):
                    both.append([])
                    for piece in slices(part.column(c)):
                        shingles, first = labelled_shingles(words(piece, SPACE))
                        both[-1] += np.split(shingles, first[1:-1])
                found = np.array([aligned(x, y) for x, y in zip(*both, strict=True)])
                keep = pa.array(found > 0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found)], names=["a", "b", "similarity"]).filter(keep)

    left = pairs.join(needed.withColumnRenamed("row", "a").withColumnRenamed("text", "text_a"), "a")
    both = left.join(needed.withColumnRenamed("row", "b").withColumnRenamed("text", "text_b"), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(compare, "a long, b long, similarity double")


def _enough(n_x: str, at_x: str, n_y: str, at_y: str):
    """Whether texts that first share the shingles at these places of their prefixes may be linked."""
    left = F.least(F.col(n_x) - F.col(at_x), F.col(n_y) - F.col(at_y))
    return (left * (1 + SIMILARITY) >= SIMILARITY * (F.col(n_x) + F.col(n_y)) - 1e-6) & (F.least(n_x, n_y) >= SIMILARITY * F.greatest(n_x, n_y) - 1e-6)


def prefix_entries(texts: DataFrame, units: DataFrame) -> DataFrame:
    """Prefix shingles of texts as (key, row, n, at, unit, short, blocks), of keys that texts of several units share.

    ``texts`` is (row, n, prefix), ``units`` (row, unit); a text outside of units is one of its own (``-1 - row``).  ``short`` are
    the shingles of the prefix that suffices for texts of at least the own length, as such must share more with it.
    """
    unit = F.coalesce("unit", -1 - F.col("row"))
    entries = texts.join(units, "row", "left").select("row", "n", unit.alias("unit"), F.posexplode("prefix").alias("at", "key"))
    return shared_keys(entries.withColumn("short", F.col("at") <= F.col("n") - F.ceil(F.col("n") * (2 * SIMILARITY / (1 + SIMILARITY)) - 1e-9)))


def shared_keys(entries: DataFrame) -> DataFrame:
    keys = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("short").alias("any"), F.min("unit").alias("low"), F.max("unit").alias("high"))
    keys = keys.where("any and size > 1 and low < high").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    return written(entries.join(keys, "key"), "entries")


def star_pairs(entries: DataFrame) -> DataFrame:
    """(x, y, g, h): each text with one text of the unit that most entries of its key belong to, so no more pairs than entries."""
    one = entries.groupBy("key", "unit").agg(F.count(F.lit(1)).alias("members"), F.max(F.struct((-F.col("at")).alias("minus"), "row", "n")).alias("one"))
    centre = one.groupBy("key").agg(F.max(F.struct("members", "unit", "one")).alias("best"))
    centre = centre.select("key", F.col("best.unit").alias("h"), F.col("best.one.row").alias("y"), F.col("best.one.n").alias("n_y"), (-F.col("best.one.minus")).alias("at_y"))
    met = entries.join(centre, "key").where(F.col("unit") != F.col("h")).where(_enough("n", "at", "n_y", "at_y"))
    return met.select(F.col("row").alias("x"), "y", F.col("unit").alias("g"), "h").distinct()


def prefix_pairs(entries: DataFrame) -> DataFrame:
    """(x, y, g, h): all pairs of texts that may be linked and are not of one unit, x being the longer (by n, then row).

    Linked texts share a shingle of x's prefix and y's ``short`` one, and of the first one that they share on both have enough
    shingles left.  So texts with a ninth of rare shingles never meet by the frequent ones that they share.
    """
    left = entries.select("key", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"), F.col("row").alias("x"), F.col("n").alias("n_x"), F.col("at").alias("at_x"), F.col("unit").alias("g"))
    right = entries.where("short").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("row").alias("y"), F.col("n").alias("n_y"), F.col("at").alias("at_y"), F.col("unit").alias("h"))
    longer = (F.col("n_x") > F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("x") > F.col("y")))
    return left.join(right, ["key", "block"]).where(longer & (F.col("g") != F.col("h")) & _enough("n_x", "at_x", "n_y", "at_y")).select("x", "y", "g", "h").distinct()


def promising(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b, g, h, bound) whose bitmaps leave it open that they are linked; ``bound`` is the most that their similarity may be."""

    def bound(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (4, 5))
            n_x, n_y = batch.column(6).to_numpy(), batch.column(7).to_numpy()
            # a bit of one map only is a shingle of one text only
            most = np.minimum(n_x - np.bitwise_count(p & ~q).sum(1, dtype=np.int64), n_y - np.bitwise_count(q & ~p).sum(1, dtype=np.int64))
            keep = most * (1 + SIMILARITY) >= SIMILARITY * (n_x + n_y) - 1e-6
            share = most / (n_x + n_y - most)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), pa.array(share)], names=["x", "y", "g", "h", "bound"]).filter(pa.array(keep))

    maps = texts.select("row", "n", "bits")
    mapped = pairs.join(maps.select(F.col("row").alias("x"), F.col("n").alias("n_x"), F.col("bits").alias("p")), "x").join(maps.select(F.col("row").alias("y"), F.col("n").alias("n_y"), F.col("bits").alias("q")), "y")
    out = mapped.select("x", "y", "g", "h", "p", "q", "n_x", "n_y").mapInArrow(bound, "x long, y long, g long, h long, bound double")
    return out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h"), "bound")


def best_of_units(pairs: DataFrame) -> DataFrame:
    return written(pairs.groupBy("g", "h").agg(F.max(F.struct("bound", "a", "b")).alias("best")).select("best.a", "best.b"), "best")


def classes(read: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, root) of the texts that are linked, the components of all pairs of similarity SIMILARITY; and (a, b, similarity) of links that join them.

    Sketches come first; what they join is a unit.  Then each text is compared with one of the largest unit among those that share a
    prefix shingle with it, which joins most of what is left of large groups.  Last, all pairs of prefixes are compared:
    of two units the most promising pair, and, where that does not join them, all others.
    """
    text = read.select("row", "text")
    named = lambda roots: roots.select(F.col("node").alias("row"), F.col("root").alias("unit"))
    links = written(verified(text, candidate_pairs(texts)), "links")
    # what earlier links join is a star by now; only new ones are added to those
    more = lambda roots, found: written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found.select("a", "b"))), "units")
    roots = written(components(links.select("a", "b")), "units")
    entries = prefix_entries(texts, named(roots))
    stars = best_of_units(promising(star_pairs(entries), texts))
    found = written(verified(text, stars), "links")
    links, roots = links.union(found), more(roots, found)
    units = named(roots)
    entries = shared_keys(entries.drop("unit", "blocks").join(units, "row", "left").withColumn("unit", F.coalesce("unit", -1 - F.col("row"))))
    pairs = written(promising(prefix_pairs(entries), texts).join(stars, ["a", "b"], "left_anti"), "prefix-pairs")
    best = best_of_units(pairs)
    found = written(verified(text, best), "links")
    links, roots = links.union(found), more(roots, found)
    rest = pairs.join(best, ["a", "b"], "left_anti").select("a", "b")
    for end in ("a", "b"):
        rest = rest.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    rest = written(rest.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"), "rest")
    if rest.isEmpty():
        return roots, links
    found = written(verified(text, rest), "links")
    return more(roots, found), links.union(found)


def closest(links: DataFrame) -> DataFrame:
    """(text_row, partner, similarity): of each linked text, the most similar text that a link was verified with; the smallest row of equals."""
    both = links.select(F.explode(F.array(F.struct(F.col("a").alias("text_row"), F.col("b").alias("other")), F.struct(F.col("b").alias("text_row"), F.col("a").alias("other")))).alias("x"), "similarity")
    best = both.groupBy("x.text_row").agg(F.max(F.struct("similarity", (-F.col("x.other")).alias("minus"))).alias("best"))
    return best.select("text_row", (-F.col("best.minus")).alias("partner"), "best.similarity")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of equal and near-equal documents: one row for each document with row, id, class_id, first, partner_id, similarity.

    Equal texts are of one class and count as one text.  Texts of similarity SIMILARITY or more are linked, and a class is what
    links connect; ``class_id`` is its smallest document id, and ``first`` marks the one document (smallest id, then row) that
    stands for the class.  A null, empty or blank text is a class of its own, and so is each repeated row of one.  Null ids sort
    first, and name a class only if no other id does.  An empty table gives no rows.

    ``partner_id`` is a document that this one was found to be equal or linked to: the first of equal ones for all others of them
    (similarity 1), else the text of the closest verified link; null for a class of one.  Partners join each class, copies through the first.
    """
    read = numbered(stable(docs), id=F.col(id_col), text=F.col(text_col))
    table = written(sketch_table(read), "sketches")
    # of equal texts the one that stands for them all, and the smallest id
    stands = written(table.where(F.col("n") > 0).groupBy("digest").agg(F.min("row").alias("text_row"), F.min(F.struct("id", "row")).alias("own"), F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies")), "stands")
    texts = written(table.join(stands.select(F.col("text_row").alias("row")), "row", "left_semi").select("row", "n", "sketches", "prefix", "bits"), "texts")
    roots, links = classes(read, texts)
    # only texts that are linked have a class other than their own
    linked = stands.join(roots.withColumnRenamed("node", "text_row"), "text_row")
    heads = linked.groupBy("root").agg(F.min("own").alias("head"), F.min("class_id").alias("class_id"))
    near = closest(links).join(stands.select(F.col("text_row").alias("partner"), F.col("own.id").alias("partner_id")), "partner").drop("partner")
    linked = linked.select("digest", "root", "own", "text_row").join(heads, "root").join(near, "text_row", "left").select("digest", "head", "class_id", "own", "partner_id", "similarity")
    alone = stands.where("copies > 1").join(linked, "digest", "left_anti")
    alone = alone.select("digest", F.col("own").alias("head"), "class_id", "own", F.lit(None).cast(table.schema["id"].dataType).alias("partner_id"), F.lit(None).cast("double").alias("similarity"))
    named = written(linked.union(alone), "classes")  # of a known size, so that Spark may broadcast it or split what is skewed
    out = table.select("row", "id", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(named, "digest", "left")
    first = F.coalesce(F.col("head.row") == F.col("row"), F.lit(True))
    copy = F.coalesce(F.col("own.row") != F.col("row"), F.lit(False))
    return out.select(
        "row", "id", F.when(F.col("head").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), first.alias("first"),
        F.when(copy, F.col("own.id")).otherwise(F.col("partner_id")).alias("partner_id"), F.when(copy, 1.0).otherwise(F.col("similarity")).alias("similarity"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """Documents without those that another of their class stands for, with all their columns."""
    docs = stable(docs)
    rows = numbered(docs, doc=F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    others = near_duplicates(docs).where(~F.col("first")).select("row")
    return rows.join(others, "row", "left_anti").select("doc.*")


def op2_order_minhash(spark, sf_dir: str) -> DataFrame:
    """All documents with their classes; nulls, empty texts, repeats and empty tables as in ``near_duplicates``."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "class_id", F.col("first").alias("kept"), "partner_id", "similarity")
