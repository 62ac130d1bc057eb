"""Alignment of two tokenizers over the same bytes.

Both tokenizers cut a text's bytes into tokens, and each token ends at a byte.  The union of both arrays of ends cuts the text
into elementary intervals; each lies in exactly one token of either side (found by ``searchsorted``), and two tokens overlap
just where they share one interval, so an interval is one link.  Ends that both sides share close a group.  The tokens of
all texts of a slice are aligned together, by arrays.

Counts of linked id pairs over the corpus come from a second pass over the written alignments.  The most frequent pairs, a
bounded number, are looked up where the alignments are read; all others go through a join, where no pair is frequent.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.llm.encode import Encoder, blank_led_pieces
from weftlog.llm.storage import bounded_memory, written
from weftlog.llm.text import Slice, slices

#: Pairs whose counts every task holds (17 bytes each); all further pairs are joined.
HOT_PAIRS = 1 << 18
#: Distinct pairs that a counting task holds before it passes its counts on.
COUNTED_PAIRS = 1 << 20
#: Ids of the second side are below this; a pair is the first id times it plus the second.
SECOND = 1 << 24


def _byte_signs() -> dict[str, int]:
    """The sign of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteLevelSide(Encoder):
    """A byte-level tokenizer file, control strings taken as plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.control, self.pieces = None, blank_led_pieces
        signs = _byte_signs()
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.entries = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for entry, i in vocabulary.items():
            self.entries[i] = bytes(signs[c] for c in entry) if all(c in signs for c in entry) else entry.encode()
        self.lengths = np.array([len(x) for x in self.entries], np.int64)

    def joined(self, text: str) -> bytes:
        return b"".join(self.entries[i] for i in self._ids([text])[0])


class PieceSide(Encoder):
    """A sentencepiece model, which adds the space before a text itself.

    No piece of the vocabulary holds a space after another sign, so no merge crosses a blank that follows a non-blank, and a text
    may be cut there.  A vocabulary for which this is not so is encoded text by text.
    """

    def __init__(self, path: str):  # noqa: super().__init__ reads the other kind of file
        from sentencepiece import SentencePieceProcessor

        self.model, self.control = SentencePieceProcessor(model_file=path), None
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.entries = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths = np.array([len(x) for x in self.entries], np.int64)
        self.space = self.model.piece_to_id("▁")
        cuttable = not any("▁" in p.lstrip("▁") for p in pieces)
        self.pieces = blank_runs if cuttable else whole_texts
        self._forget()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        out = self.model.encode([x[1:] for x in texts], num_threads=1)
        return [[self.space] if x == " " else ids for x, ids in zip(texts, out, strict=True)]

    def joined(self, text: str) -> bytes:
        return b"".join(self.entries[i] for i in self._ids([text])[0])


def blank_runs(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Pieces that begin at each space after another byte, and at each text's start."""
    data, n = piece.data, len(piece.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = data == 0x20
    begins[1:] &= data[:-1] != 0x20
    begins[piece.offsets[:-1][np.diff(piece.offsets) > 0]] = True
    starts = np.flatnonzero(begins)
    return starts, np.append(starts[1:], n)


def whole_texts(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    some = np.diff(piece.offsets) > 0
    return piece.offsets[:-1][some], piece.offsets[1:][some]


_sides: dict[tuple, Encoder] = {}


def side(path: str) -> Encoder:
    """The process's encoder of a file; reused workers keep what it has learned."""
    if path not in _sides:
        _sides[path] = PieceSide(path) if path.endswith(".model") else ByteLevelSide(path)
    return _sides[path]


def spaced(piece: Slice) -> Slice:
    """The slice with a space before each text that is not empty; an empty one stays so."""
    some = np.diff(piece.offsets) > 0
    data = np.insert(piece.data, piece.offsets[:-1][some], 0x20)
    return Slice(piece.lo, piece.hi, data, piece.offsets + np.concatenate(([0], np.cumsum(some))))


class Alignment:
    """Tokens of both sides of a slice's texts, the intervals between all ends, and the groups between shared ends."""

    def __init__(self, piece: Slice, first: Encoder, second: Encoder):
        n = len(piece.offsets) - 1
        (self.a, self.a_first), (self.b, self.b_first) = first.encode(piece), second.encode(piece)
        ends_a, ends_b = np.cumsum(first.lengths[self.a]), np.cumsum(second.lengths[self.b])
        good = self._rebuilt(piece, first, self.a, self.a_first, ends_a) & self._rebuilt(piece, second, self.b, self.b_first, ends_b) & (np.diff(piece.offsets) > 0)
        if not good.all():  # texts that a side does not give back have no tokens
            sizes = np.where(good, np.diff(piece.offsets), 0)
            kept = np.repeat(good, np.diff(piece.offsets))
            piece = Slice(piece.lo, piece.hi, piece.data[kept], np.concatenate(([0], np.cumsum(sizes))))
            (self.a, self.a_first), (self.b, self.b_first) = (self._only(good, x, at) for x, at in ((self.a, self.a_first), (self.b, self.b_first)))
            ends_a, ends_b = np.cumsum(first.lengths[self.a]), np.cumsum(second.lengths[self.b])
        self.offsets, self.n = piece.offsets, n
        self.ends_a, self.ends_b = ends_a, ends_b
        self.cuts = np.union1d(ends_a, ends_b)
        #: For each interval, the token of either side that it lies in.
        self.owner_a, self.owner_b = np.searchsorted(ends_a, self.cuts), np.searchsorted(ends_b, self.cuts)
        self.shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        self.text_of = np.searchsorted(self.offsets, self.cuts, "left") - 1
        self.group_a, self.group_b = np.searchsorted(self.shared, ends_a), np.searchsorted(self.shared, ends_b)

    @staticmethod
    def _only(good: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(at)
        return ids[np.repeat(good, sizes)], np.concatenate(([0], np.cumsum(np.where(good, sizes, 0))))

    @staticmethod
    def _rebuilt(piece: Slice, own: Encoder, ids: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether each text's tokens, joined, are its bytes."""
        upto = np.concatenate(([0], ends))
        sizes = upto[first[1:]] - upto[first[:-1]]
        out = sizes == np.diff(piece.offsets)
        if out.all() and len(ids) and b"".join(map(own.entries.__getitem__, ids.tolist())) == piece.data.tobytes():
            return out
        for i in np.flatnonzero(out):
            out[i] = b"".join(map(own.entries.__getitem__, ids[first[i] : first[i + 1]].tolist())) == piece.bytes_of(i)
        return out

    def per_text(self, places: np.ndarray) -> np.ndarray:
        """How many of the ascending ends lie in each text."""
        return np.diff(np.searchsorted(places, self.offsets, "right"))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair of ids, links) of each pair that a text holds linked, in order of text and pair."""
        key = self.a[self.owner_a].astype(np.int64) * SECOND + self.b[self.owner_b].astype(np.int64)
        distinct, code = np.unique(key, return_inverse=True)
        both, times = np.unique(self.text_of * max(1, len(distinct)) + code, return_counts=True)
        return both // max(1, len(distinct)), distinct[both % max(1, len(distinct))] if len(distinct) else distinct, times

    def group_texts(self, tables: tuple[np.ndarray, ...]) -> list[bytes]:
        """``a1,a2|b1;a3|b2`` of each text: both sides' tokens laid out in order of groups, each with the sign after it."""
        n_a, n_b, groups = len(self.a), len(self.b), len(self.shared)
        if not groups:
            return [b""] * self.n
        # a token stands after its own side's earlier tokens and the other side's tokens of earlier (or the same) groups
        a_to, b_to = np.searchsorted(self.group_a, np.arange(groups + 1)), np.searchsorted(self.group_b, np.arange(groups + 1))
        place_a, place_b = np.arange(n_a) + b_to[self.group_a], np.arange(n_b) + a_to[self.group_b + 1]
        last_a, last_b = self.ends_a == self.shared[self.group_a], self.ends_b == self.shared[self.group_b]
        comma, bar, semicolon = tables
        out = np.empty(n_a + n_b, object)
        out[place_a] = np.where(last_a, bar[self.a], comma[self.a])
        out[place_b] = np.where(last_b, semicolon[self.b], comma[self.b])
        bounds = self.a_first + self.b_first
        return [b"".join(out[lo:hi].tolist())[:-1] for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]

    def group_products(self) -> tuple[np.ndarray, np.ndarray]:
        """Token pairs of each group's product, as (first, second) token numbers: all ways to map a group's tokens."""
        groups = np.arange(len(self.shared) + 1)
        a_to, b_to = np.searchsorted(self.group_a, groups), np.searchsorted(self.group_b, groups)
        wide = np.diff(b_to)[self.group_a]
        one = np.repeat(np.arange(len(self.a)), wide)
        start = np.cumsum(wide) - wide
        return one, np.arange(len(one)) - np.repeat(start, wide) + np.repeat(b_to[self.group_a], wide)


_TABLES: dict[int, tuple[np.ndarray, ...]] = {}


def _texts_of_ids(n: int) -> tuple[np.ndarray, ...]:
    """The decimal text of each id, followed by each of the signs."""
    if n not in _TABLES:
        tables = []
        for sign in ",|;":
            table = np.empty(n, object)
            table[:] = [f"{i}{sign}".encode() for i in range(n)]
            tables.append(table)
        _TABLES[n] = tuple(tables)
    return _TABLES[n]


def token_links(docs: DataFrame, first_path: str, second_path: str, by: str = "overlap", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each link: id, a_index, b_index (token numbers in the text), a_id, b_id, from_byte, to_byte (of space and text).

    ``by`` is "overlap", where tokens are linked that share bytes, or "group", where each group's product is expanded (its bytes
    are then those of the group).  Texts without tokens have no rows; null ids stay null; other columns are not read.
    """
    if by not in ("overlap", "group"):
        raise ValueError(f"unknown kind of link {by!r}")
    bounded_memory(docs.sparkSession)

    def run(batches):
        one, two = side(first_path), side(second_path)
        for batch in batches:
            ids = batch.column(0)
            for piece in slices(batch.column(1)):
                own = Alignment(spaced(piece), one, two)
                if by == "overlap":
                    a, b, upto = own.owner_a, own.owner_b, own.cuts
                    since = np.concatenate(([0], own.cuts[:-1])) if len(own.cuts) else own.cuts
                else:
                    a, b = own.group_products()
                    upto = own.shared[own.group_a[a]]
                    since = np.concatenate(([0], own.shared))[own.group_a[a]]
                for lo in range(0, len(a), 100_000):
                    x, y, to = a[lo : lo + 100_000], b[lo : lo + 100_000], upto[lo : lo + 100_000]
                    text = np.searchsorted(own.offsets, to, "left") - 1
                    base = own.offsets[text]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(piece.lo + text)), pa.array(x - own.a_first[text]), pa.array(y - own.b_first[text]), pa.array(own.a[x].astype(np.int64)), pa.array(own.b[y].astype(np.int64)), pa.array(since[lo : lo + 100_000] - base), pa.array(to - base)],
                        names=["id", "a_index", "b_index", "a_id", "b_id", "from_byte", "to_byte"],
                    )

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, "id long, a_index long, b_index long, a_id long, b_id long, from_byte long, to_byte long").withColumnRenamed("id", id_col)


def aligned_texts(docs: DataFrame, first_path: str, second_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each text: row (a number that no other has), id, n_a, n_b, n_groups, n_links, groups, pairs and times.

    ``groups`` is the text of the groups, ``pairs`` (binary int64) the distinct linked pairs of ids and ``times`` (binary int32) their
    links.  Texts that are null, empty, or not given back by a side have none.
    The numbers hold for this reading alone: write the table before using it twice.
    """
    bounded_memory(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        one, two = side(first_path), side(second_path)
        tables = _texts_of_ids(max(len(one.lengths), len(two.lengths)))
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for piece in slices(batch.column(1)):
                own = Alignment(spaced(piece), one, two)
                text, pair, times = own.pairs()
                cut = np.searchsorted(text, np.arange(own.n + 1))
                packed = [pair[lo:hi].astype("<i8").tobytes() for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
                counts = [times[lo:hi].astype("<i4").tobytes() for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(own.n)), batch.column(0)[piece.lo : piece.hi], pa.array(np.diff(own.a_first)), pa.array(np.diff(own.b_first)),
                        pa.array(own.per_text(own.shared)), pa.array(own.per_text(own.cuts)), pa.array(own.group_texts(tables), pa.binary()).cast(pa.string()), pa.array(packed, pa.binary()), pa.array(counts, pa.binary()),
                    ],
                    names=["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"],
                )
                row += own.n

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, "row long, id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary")


def pair_counts(texts: DataFrame) -> DataFrame:
    """(pair, n, best): in how many texts a pair of ids is linked, and whether its first id has no pair of more."""

    def count(batches):
        held, keys, sums = [], np.zeros(0, np.int64), np.zeros(0, np.int64)

        def merged():
            every = np.concatenate([keys, *held])
            weight = np.concatenate([sums, np.ones(len(every) - len(keys), np.int64)])
            distinct, code = np.unique(every, return_inverse=True)
            return distinct, np.bincount(code, weight, len(distinct)).astype(np.int64)

        waiting = 0
        for batch in batches:
            for x in batch.column(0):
                held.append(np.frombuffer(x.as_buffer(), "<i8"))
                waiting += len(held[-1])
                if waiting > COUNTED_PAIRS:
                    (keys, sums), held, waiting = merged(), [], 0
                    if len(keys) > COUNTED_PAIRS:
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["pair", "n"])
                        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, sums = merged()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["pair", "n"])

    counts = texts.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = written(counts, "pair-counts")
    most = counts.groupBy(F.expr(f"pair div {SECOND}").alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", F.expr(f"pair div {SECOND}")).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(texts: DataFrame, counts: DataFrame, hot: int = HOT_PAIRS) -> DataFrame:
    """Adds count_sum (over a text's links, the count of their pair) and n_best (links whose pair is its first id's most frequent).

    ``texts`` and ``counts`` are written tables.  The ``hot`` most frequent pairs (that many rows at most reach the driver) are looked
    up in the tasks; a text's other pairs are joined, and each of those is linked in fewer texts than every hot one.
    """
    top = sorted((r.pair, r.n, r.best) for r in counts.orderBy(F.desc("n"), "pair").limit(hot).collect())
    keys, sums, best = (np.array([x[i] for x in top], kind) for i, kind in ((0, np.int64), (1, np.int64), (2, bool)))
    whole = len(top) < hot
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((keys, sums, best))

    def look_up(batches, cold: bool):
        keys, sums, best = shared.value
        for batch in batches:
            rows, pairs, times = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            out = []
            for row, x, y in zip(rows, pairs, times, strict=True):
                pair, links = np.frombuffer(x.as_buffer(), "<i8"), np.frombuffer(y.as_buffer(), "<i4").astype(np.int64)
                at = np.searchsorted(keys, pair)
                at[at == len(keys)] = 0
                known = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
                if cold:
                    if not known.all():
                        out.append((np.full(int((~known).sum()), row), pair[~known], links[~known]))
                else:
                    links = np.where(known, links, 0)
                    out.append((row, int((sums[at] * links).sum()) if len(keys) else 0, int(links[best[at]].sum()) if len(keys) else 0))
            if cold and out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], names=["row", "pair", "links"])
            elif out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["row", "hot_sum", "hot_best"])

    inner = texts.select("row", "pairs", "times")
    if whole:  # no pair is left to join
        kept = [c for c in texts.columns if c not in ("pairs", "times")]

        def appended(batches):
            for batch in batches:
                wanted = batch.select(["row", "pairs", "times"])
                for found in look_up([wanted], False):
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), found.column(1), found.column(2)], names=[*kept, "count_sum", "n_best"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields if f.name in kept)
        return texts.mapInArrow(appended, f"{kinds}, count_sum long, n_best long")
    hot_part = inner.mapInArrow(lambda batches: look_up(batches, False), "row long, hot_sum long, hot_best long")
    cold = inner.mapInArrow(lambda batches: look_up(batches, True), "row long, pair long, links long").join(counts, "pair")
    cold = cold.groupBy("row").agg(F.sum(F.col("n") * F.col("links")).alias("hot_sum"), F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("hot_best"))
    sums_ = hot_part.unionByName(cold).groupBy("row").agg(F.sum("hot_sum").alias("count_sum"), F.sum("hot_best").alias("n_best"))
    return texts.drop("pairs", "times").join(sums_, "row")


def op11_elementary_intervals(spark, sf_dir: str) -> DataFrame:
    """All documents aligned between the byte-level and the piece tokenizer.

    Null, empty and not rebuilt texts have zeros and an empty digest; repeated rows each count as a document; an empty table gives none.
    """
    import public_tokenizers as P

    texts = aligned_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    texts = written(texts.select("row", F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times"), "alignments")
    counts = written(pair_counts(texts), "pair-table")
    return with_counts(texts, counts).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
