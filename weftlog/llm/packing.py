"""Packing documents into sequences along a space-filling curve."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlog.llm.encode import encoder
from weftlog.llm.storage import written
from weftlog.llm.text import SPACE, Slice, mix, slices, words

#: Dimensions of hashed vectors, of their projection, and bits of each of the latter.
BUCKETS, DIMENSIONS, BITS = 512, 4, 10
#: Low bits of a key: a hash of the document id, so that equal texts may lie in several ranges.
TIE_BITS = 63 - DIMENSIONS * BITS
#: Sampled keys for each range, and the most ranges whatever the input's size: at most 524,288 keys reach the driver.
SAMPLES, MOST_RANGES = 32, 16384
#: Bytes of text that a range is meant to hold.
RANGE_BYTES = 8 << 20
SEQUENCE, END = 4096, 2

_PROJECTION = np.random.default_rng(20).standard_normal((BUCKETS, DIMENSIONS)).astype(np.float32)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of points (n, dimensions) of unsigned ``bits``-bit coordinates.

    Coordinates are first brought into the curve's transposed form: for each bit from the top, an axis whose bit is set
    inverts the lower bits of the first axis, and one whose bit is clear swaps them with the first axis's; a Gray decoding follows.
    """
    x = points.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    for q in (np.uint64(1 << b) for b in range(bits - 1, 0, -1)):
        low = q - one
        for axis in x:
            is_set = (axis & q) > 0
            swap = np.where(is_set, np.uint64(0), (x[0] ^ axis) & low)
            x[0] ^= np.where(is_set, low, swap)
            axis ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (np.uint64(1 << b) for b in range(bits - 1, 0, -1)):
        turn ^= np.where((x[-1] & q) > 0, q - one, np.uint64(0))
    x ^= turn
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            index = (index << one) | ((axis >> np.uint64(b)) & one)
    return index


def curve_keys(piece: Slice, ids: list) -> np.ndarray:
    """Hilbert key of each text's projected hashed vector (square roots of word counts, unit length), then the tie bits."""
    w = words(piece, SPACE)
    n, bucket = piece.hi - piece.lo, (w.hashes >> np.uint64(40)).astype(np.int64) % BUCKETS
    out = np.zeros(n, np.uint64)
    for lo in range(0, n, 1000):
        hi = min(lo + 1000, n)
        own = slice(w.first[lo], w.first[hi])
        counts = np.bincount((w.texts[own] - lo) * BUCKETS + bucket[own], minlength=(hi - lo) * BUCKETS).reshape(hi - lo, BUCKETS)
        vectors = np.sqrt(counts.astype(np.float32))
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        cells = np.clip((vectors @ _PROJECTION + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1)
        out[lo:hi] = hilbert(cells.astype(np.uint64), BITS)
    ties = mix(np.array([0 if i is None else i for i in ids], np.int64).astype(np.uint64)) >> np.uint64(64 - TIE_BITS)
    return (out << np.uint64(TIE_BITS)) | ties


def range_splitters(docs: DataFrame) -> np.ndarray:
    """Key boundaries of ranges of equal bytes, from a hash sample of about SAMPLES documents a range over all partitions.

    There are as many ranges as the bytes ask for, but shuffle partitions at least and MOST_RANGES at most.
    """
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).first()
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(MOST_RANGES, max(least, -(-(total["size"] or 0) // RANGE_BYTES)))
    sample = docs.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(max(1, total["n"] // (SAMPLES * ranges)))) == 0)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for piece in slices(batch.column(1)):
                keys = curve_keys(piece, ids[piece.lo : piece.hi])
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(np.diff(piece.offsets) + 1)], names=["key", "size"])

    rows = sorted((r.key, r.size) for r in sample.mapInArrow(run, "key long, size long").collect())
    if not rows:
        return np.zeros(0, np.int64)
    keys, sizes = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    upto = np.cumsum(sizes)
    return np.unique(keys[np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges)])


def powers_of_two(n: int) -> list[int]:
    """The powers of two that add up to ``n``, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack_along_curve(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences: neighbours in a sequence are neighbours on the curve.

    Documents are range-partitioned by their key at boundaries from a size-weighted sample, sorted inside each range, encoded, and
    laid end to end; a range's tokens are cut into full sequences, and its last tokens into powers of two.
    Returns id, start (the document's ids before the piece), length, ids (binary, uint32), doc_tokens, part, local (the
    sequence's number in its part) and offset (in the sequence).  Null and empty texts are their end id alone, repeated
    rows are each packed, an empty table gives no rows, and other columns are not read.  A task holds one open sequence and a batch.
    """
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bounds = range_splitters(read)

    def keyed(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for piece in slices(batch.column(1)):
                keys = curve_keys(piece, ids[piece.lo : piece.hi]).astype(np.int64)
                part = np.searchsorted(bounds, keys, "right").astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[piece.lo : piece.hi], batch.column(1)[piece.lo : piece.hi], pa.array(keys), pa.array(part)], names=["id", "text", "key", "part"]
                )

    def packed(batches):
        own, part = encoder(tokenizer_path), 0
        rows, number, held, filled = [], 0, [], 0  # the open sequence's pieces (document, start, ids, document's ids) and tokens

        def close(pieces, number):
            offset = 0
            for doc, start, ids, n in pieces:
                rows.append((doc, start, len(ids), ids.tobytes(), n, part, number, offset))
                offset += len(ids)

        for batch in batches:
            part = batch.column(2)[0].as_py() if len(batch) else part
            docs = batch.column(0).to_pylist()
            for piece in slices(batch.column(1)):
                tokens, first = own.encode(piece)
                for i in range(piece.hi - piece.lo):
                    ids, start = np.append(tokens[first[i] : first[i + 1]], np.uint32(end)).astype("<u4"), 0
                    while start < len(ids):
                        take = min(len(ids) - start, sequence - filled)
                        held.append((docs[piece.lo + i], start, ids[start : start + take], len(ids)))
                        start, filled = start + take, filled + take
                        if filled == sequence:
                            close(held, number)
                            number, held, filled = number + 1, [], 0
                    if len(rows) >= 1000:
                        yield batch_of(rows)
                        rows.clear()
        for size in powers_of_two(filled):  # what is left fills sequences without padding
            own_pieces = []
            while size:
                doc, start, ids, n = held.pop(0)
                take = min(size, len(ids))
                own_pieces.append((doc, start, ids[:take], n))
                if take < len(ids):
                    held.insert(0, (doc, start + take, ids[take:], n))
                size -= take
            close(own_pieces, number)
            number += 1
        if rows:
            yield batch_of(rows)

    kinds = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("local", pa.int64()), ("offset", pa.int64())])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

    placed = read.mapInArrow(keyed, "id long, text string, key long, part int").repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("key", "id", "text")
    out = placed.select("id", "text", "part").mapInArrow(packed, "id long, start long, length long, ids binary, doc_tokens long, part int, local long, offset long")
    return out.withColumnRenamed("id", id_col)


def packed_pieces(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Pieces with the checksum of their ids and a sequence number over all ranges, in place of the ids."""
    pieces = written(pack_along_curve(docs, tokenizer_path).withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    # one row for each range, MOST_RANGES at most
    counts = pieces.groupBy("part").agg((F.max("local") + 1).alias("n"))
    base = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return pieces.join(F.broadcast(base), "part").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("local")).alias("sequence_id"), "offset")


def op5_hilbert_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
