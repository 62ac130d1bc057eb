"""Token ids on disk as directly addressable codes.

An id is split into chunks of ``WIDTHS`` bits, lowest first.  Level j holds the j-th chunk of every id that has one, in order,
and a bitmap that tells which of them continue on level j + 1; a rank directory counts the set bits before each block of
the bitmap, so the place of an id's next chunk is found in constant time.  Any id can thus be read without decoding others.

File layout (little-endian): ``DAC1``, documents, ids and levels as uint32, document ids as int64 (with a null mask byte each),
first id of each document as uint32 (one more than documents), then for each level: entries as uint32, the chunks as the
smallest unsigned integers that hold the width, and, but for the last level, the bitmap and the uint32 rank directory.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlog.llm.encode import encoder
from weftlog.llm.storage import fresh, put
from weftlog.llm.text import slices

WIDTHS = (8, 8, 16)
#: Bits of a bitmap for one entry of the rank directory.
BLOCK = 512
#: Ids after which a file is closed.
FILE_IDS = 2_000_000
#: The id after each document.
END = 2

_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def _chunk_type(width: int) -> np.dtype:
    return np.dtype("<u1" if width <= 8 else "<u2" if width <= 16 else "<u4")


def encode_levels(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> list[tuple[np.ndarray, bytes, np.ndarray]]:
    """(chunks, bitmap, rank directory) of each level; the last has an empty bitmap."""
    out, rest = [], ids.astype(np.uint32)
    for j, width in enumerate(widths):
        chunks = (rest & np.uint32((1 << width) - 1)).astype(_chunk_type(width))
        rest = rest >> np.uint32(width) if width < 32 else np.zeros_like(rest)
        more = rest > 0
        if j == len(widths) - 1:
            if more.any():
                raise ValueError("an id is too large for the chunk widths")
            out.append((chunks, b"", np.zeros(0, "<u4")))
            break
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), BLOCK)) if len(more) else np.zeros(0, np.uint32)
        out.append((chunks, bits.tobytes(), (np.cumsum(counts) - counts).astype("<u4")))
        rest = rest[more]
    return out


def packed(doc_ids: list, firsts: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """The parts of a file."""
    levels = encode_levels(ids)
    parts = [b"DAC1", struct.pack("<III", len(doc_ids), len(ids), len(levels))]
    parts.append(np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes())
    parts.append(bytes(x is None for x in doc_ids))
    parts.append(firsts.astype("<u4").tobytes())
    for chunks, bits, ranks in levels:
        parts += [struct.pack("<I", len(chunks)), chunks.tobytes(), bits, ranks.tobytes()]
    return parts


@dataclass
class Codes:
    """A file's contents, as views of its bytes."""

    doc_ids: np.ndarray
    null_ids: np.ndarray
    firsts: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, data: bytes, widths: tuple[int, ...] = WIDTHS) -> Codes:
        if data[:4] != b"DAC1":
            raise ValueError("not a file of directly addressable codes")
        docs, _, n_levels = struct.unpack_from("<III", data, 4)
        at = 16

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, nulls, firsts, levels = take("<i8", docs), take("<u1", docs), take("<u4", docs + 1), []
        for j in range(n_levels):
            n, last = int(take("<u4", 1)[0]), j == n_levels - 1
            levels.append((take(_chunk_type(widths[j]).str, n), take("<u1", 0 if last else -(-n // 8)), take("<u4", 0 if last else -(-n // BLOCK))))
        return cls(ids, nulls, firsts, levels)

    def token(self, i: int, widths: tuple[int, ...] = WIDTHS) -> int:
        """The i-th id, by one look at each level that it has."""
        value, shift = 0, 0
        for j, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not len(bits) or not bits[i >> 3] >> (i & 7) & 1:
                return value
            i, shift = self._rank(j, i), shift + widths[j]
        return value

    def _rank(self, level: int, i: int) -> int:
        """Set bits before the i-th of a level's bitmap."""
        _, bits, ranks = self.levels[level]
        before = int(_POPCOUNT[bits[i // BLOCK * (BLOCK // 8) : i >> 3]].sum())
        return int(ranks[i // BLOCK]) + before + bin(int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).count("1")

    def span(self, lo: int, hi: int, widths: tuple[int, ...] = WIDTHS) -> np.ndarray:
        """Ids lo to hi (exclusive): the rank directories give their part of each level, and nothing else is decoded."""
        parts = []
        for j, (chunks, bits, _) in enumerate(self.levels):
            more = np.zeros(hi - lo, bool)
            if len(bits):
                more = np.unpackbits(bits[lo >> 3 : -(-hi // 8)], bitorder="little")[lo & 7 : (lo & 7) + hi - lo].astype(bool)
            parts.append((chunks[lo:hi].astype(np.uint32), more, np.uint32(widths[j])))
            if not more.any():
                break
            lo = self._rank(j, lo)
            hi = lo + int(np.count_nonzero(more))
        value = np.zeros(0, np.uint32)
        for own, more, width in reversed(parts):
            own[more] |= value << width
            value = own
        return value


def write_codes(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """Encode whole texts and write them to ``folder`` in ascending id order.

    Documents are range-partitioned by id, and a task writes its range as files of about ``FILE_IDS`` ids, each named by the
    range's and the file's number, so names in order are documents in order.  A file appears under its name only when whole,
    and a repeated task replaces it by the same bytes.  Null texts are empty (one end id); null ids come first;
    repeated rows are each written; an empty table writes nothing; other columns are not read.

    Returns the manifest: file, n_docs, n_tokens.
    """

    def run(batches):
        from pyspark import TaskContext

        own, part, number = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        doc_ids, parts, lengths, held = [], [], [], 0

        def close():
            firsts = np.concatenate(([0], np.cumsum(lengths)))
            name = f"{part:06d}-{number:06d}.dac"
            put(f"{folder}/{name}", packed(doc_ids, firsts, np.concatenate(parts)))
            return pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(doc_ids)], "n_tokens": [held]})

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for piece in slices(batch.column(1)):
                tokens, first = own.encode(piece)
                for i in range(piece.hi - piece.lo):
                    doc_ids.append(ids[piece.lo + i])
                    parts += [tokens[first[i] : first[i + 1]], np.array([end], np.uint32)]
                    lengths.append(int(first[i + 1] - first[i]) + 1)
                    held += lengths[-1]
                    if held >= FILE_IDS:
                        yield close()
                        doc_ids, parts, lengths, held, number = [], [], [], 0, number + 1
        if doc_ids:
            yield close()

    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartitionByRange(ranges, "id").sortWithinPartitions("id", "text")
    return ordered.mapInArrow(run, "file string, n_docs long, n_tokens long")


def read_codes(spark, folder: str, manifest: DataFrame) -> DataFrame:
    """Each document of the files: doc_id, start (ids before it, over all files), n_tokens, ids (binary, uint32).

    Each document is read by its own address, not by decoding its file.
    """
    # a range's files are summed within the range, and the ranges, one row each, in one task
    sized = manifest.withColumn("part", F.substring_index("file", "-", 1))
    ranges = sized.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    ranges = ranges.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("file")) - F.col("n_tokens")
    base = sized.withColumn("within", within).join(ranges, "part").select("file", (F.col("before") + F.col("within")).alias("base"))

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes = Codes.of(data.as_buffer().to_pybytes())
                first = codes.firsts.astype(np.int64)
                for lo in range(0, len(codes.doc_ids), 500):
                    hi = min(lo + 500, len(codes.doc_ids))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([path.rpartition("/")[2]] * (hi - lo)), pa.array(codes.doc_ids[lo:hi], mask=codes.null_ids[lo:hi].astype(bool)),
                            pa.array(first[lo:hi]), pa.array(np.diff(first[lo : hi + 1])), pa.array([codes.span(int(first[i]), int(first[i + 1])).astype("<u4").tobytes() for i in range(lo, hi)], pa.binary()),
                        ],
                        names=["file", "doc_id", "local", "n_tokens", "ids"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(folder).select("path", "content")
    found = files.mapInArrow(run, "file string, doc_id long, local long, n_tokens long, ids binary")
    return found.join(base, "file").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids")


def op7_addressable_codes(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = fresh(spark, "codes")
    manifest = write_codes(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    kept = fresh(spark, "codes-manifest")
    manifest.write.parquet(kept)
    manifest = spark.read.parquet(kept)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_codes(spark, folder, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
