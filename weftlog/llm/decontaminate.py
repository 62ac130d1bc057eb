"""Benchmark decontamination by winnowed fingerprints.

Of every window of ``WINDOW`` consecutive ``GRAM``-word grams the one with the smallest hash is kept (with all its ties), on both
sides.  A span of ``SPAN`` = GRAM + WINDOW - 1 words that an item and a document share has the same grams, hence the same
kept gram: every shared span of that length meets in a fingerprint.  Items of fewer words are fingerprinted whole, by length.
Hits are extended left and right word by word, on the words themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlog.llm.bitmap import bitmap_of, passes
from weftlog.llm.storage import numbered, stable, written
from weftlog.llm.text import ALNUM, Slice, Words, slices, sliding_minimum, window_hashes, window_starts, words

GRAM, WINDOW = 5, 6
SPAN = GRAM + WINDOW - 1
_HIT = "array<struct<width: int, hash: bigint, at: int, before: array<string>, core: array<string>, after: array<string>>>"


def kept_grams(w: Words) -> np.ndarray:
    """Word numbers at which a winnowed gram begins."""
    grams = window_hashes(w.hashes, GRAM)
    at = window_starts(w.first, SPAN)
    if not len(at):
        return at
    least = sliding_minimum(grams, WINDOW)[at]
    chosen = np.zeros(len(grams), dtype=bool)
    for i in range(WINDOW):
        chosen[at[grams[at + i] == least] + i] = True
    return np.flatnonzero(chosen)


def hits_of(piece: Slice, w: Words, wanted) -> list[list[dict]]:
    """Fingerprints of each text that ``wanted(width, hashes)`` lets pass, each with its words and up to SPAN - GRAM on either side.

    Width 0 stands for winnowed grams, another for whole short items of that many words.
    """
    out: list[list[dict]] = [[] for _ in range(piece.hi - piece.lo)]
    texts = w.texts
    lower = np.where((piece.data >= 0x41) & (piece.data <= 0x5A), piece.data + 0x20, piece.data).astype(np.uint8)

    def said(a: int, b: int) -> list[str]:
        return [lower[w.starts[i] : w.ends[i]].tobytes().decode("utf-8", "replace") for i in range(a, b)]

    for width in range(SPAN):
        n = width or GRAM
        hashes = window_hashes(w.hashes, n)
        at = window_starts(w.first, n) if width else kept_grams(w)
        if not len(at):
            continue
        passed = wanted(width, hashes[at])
        if passed is None:
            continue
        for i in at[passed]:
            text = int(texts[i])
            lo, hi = int(w.first[text]), int(w.first[text + 1])
            around = 0 if width else SPAN - GRAM
            out[text].append(
                {"width": width, "hash": int(hashes[i].astype(np.int64)), "at": int(i - lo), "before": said(max(lo, i - around), i)[::-1], "core": said(i, i + n), "after": said(i + n, min(hi, i + n + around))}
            )
    return out


def item_fingerprints(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for piece in slices(batch.column(1), 1 << 18):
                w = words(piece, ALNUM, lower=True)
                counts = w.counts

                def own(width: int, hashes: np.ndarray, w=w, counts=counts):
                    text = w.texts[window_starts(w.first, width)] if width else None
                    return np.ones(len(hashes), dtype=bool) if not width else counts[text] == width

                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[piece.lo : piece.hi], pa.array(hits_of(piece, w, own), _arrow_hits())], names=["item_id", "hits"]
                )

    kind = items.schema[id_col].dataType.simpleString()
    out = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).mapInArrow(run, f"item_id {kind}, hits {_HIT}")
    return out.select("item_id", F.inline("hits"))


def _arrow_hits() -> pa.DataType:
    strings = pa.list_(pa.string())
    return pa.list_(pa.struct([("width", pa.int32()), ("hash", pa.int64()), ("at", pa.int32()), ("before", strings), ("core", strings), ("after", strings)]))


def common(a: Column, b: Column) -> Column:
    """How many leading entries two short arrays share."""
    n = F.least(F.size(a), F.size(b))
    return F.size(F.filter(F.sequence(F.lit(1), F.lit(SPAN - GRAM)), lambda i: (i <= n) & (F.slice(a, 1, i) == F.slice(b, 1, i))))


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(documents with their row number and word count, hit spans).

    Spans are rows of (row, item_id, begin, end), in words of the document; each lies inside a stretch that the item holds too, of
    ``SPAN`` words at least or the whole short item.  A null or empty text has no words and no hits, and an item without words has
    none either; repeated documents, and repeated items, are each found; an empty table on either side gives no spans.
    Only the named columns are read.
    """
    prints = written(item_fingerprints(items, item_col, item_text_col), "item-prints")
    widths = {r["width"] for r in prints.select("width").distinct().collect()}  # SPAN at most
    table = bitmap_of(prints, "hash")  # a document fingerprint that it lets through is decided by the join
    shared = docs.sparkSession.sparkContext.broadcast(table)  # 8 MB at most

    def run(batches):
        table = shared.value
        for batch in batches:
            for piece in slices(batch.column(2)):
                w = words(piece, ALNUM, lower=True)
                hits = hits_of(piece, w, lambda width, hashes: passes(table, hashes) if width in widths else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[piece.lo : piece.hi], batch.column(1)[piece.lo : piece.hi], pa.array(w.counts.astype(np.int64)), pa.array(hits, _arrow_hits())],
                    names=["row", "id", "n_words", "hits"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = written(read.mapInArrow(run, f"row long, id {kind}, n_words long, hits {_HIT}"), "document-prints")

    d = found.where(F.size("hits") > 0).select("row", F.inline("hits"))
    d = d.select("row", "width", "hash", "at", F.col("before").alias("d_before"), F.col("core").alias("d_core"), F.col("after").alias("d_after"))
    met = d.join(prints.select("item_id", "width", "hash", "before", "core", "after").distinct(), ["width", "hash"]).where(F.col("d_core") == F.col("core"))
    met = met.withColumn("left", F.when(F.col("width") == 0, common(F.col("d_before"), F.col("before"))).otherwise(0))
    met = met.withColumn("right", F.when(F.col("width") == 0, common(F.col("d_after"), F.col("after"))).otherwise(0))
    met = met.where((F.col("width") > 0) | (F.col("left") + GRAM + F.col("right") >= SPAN))
    spans = met.select("row", "item_id", (F.col("at") - F.col("left")).alias("begin"), (F.col("at") + F.size("core") + F.col("right")).alias("end"))
    return found.select("row", F.col("id").alias(id_col), "n_words"), spans


def covered(spans: DataFrame) -> DataFrame:
    """Words of each document that lie in any span."""
    by = Window.partitionBy("row").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    seen = spans.select("row", "begin", "end").distinct().withColumn("upto", F.coalesce(F.max("end").over(by), F.lit(0)))
    return seen.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("begin", "upto"))).cast("long").alias("n_hit"))


def decontamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document: words, hit words, items found and a digest of their ids."""
    every, spans = contamination(docs, items)
    spans = written(spans, "spans")
    ids = spans.select("row", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")).distinct()
    named = ids.groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    out = every.join(covered(spans).join(named, "row"), "row", "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without any hit, with all their columns. A row is known by its place in the files."""
    docs = stable(docs)
    rows = numbered(docs, doc=F.struct(*[F.col(f"`{c}`") for c in docs.columns])).withColumnRenamed("row", "number")
    every, spans = contamination(rows.select("number", F.col("doc.text").alias("text")), items, id_col="number")
    hit = every.join(spans.select("row").distinct(), "row", "left_semi").select("number")
    return rows.join(hit, "number", "left_anti").select("doc.*")


def op8_winnowing(spark, sf_dir: str) -> DataFrame:
    return decontamination_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), occ AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, item_id, i, n FROM occ JOIN win USING (n, g)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
