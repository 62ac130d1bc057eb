"""Fill-in-the-middle transformation of whole texts, with a sparse index of checkpoints.

Counting a text's lines records, after every ``EVERY`` lines, the byte and code-point offsets reached there.  A cut at any
line is then found by a binary search among these checkpoints and a short rescan from the one before it, so no list of all
lines is kept and a text is read in blocks of ``BLOCK_BYTES``, however long it is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlog.llm.storage import bounded_memory
from weftlog.llm.text import slices

#: Lines between two checkpoints, and bytes that a scan looks at together.
EVERY, BLOCK_BYTES = 64, 1 << 20
NEWLINE = 0x0A


@dataclass(frozen=True)
class Markers:
    """Strings that stand before each part; a text that holds one of them stays plain."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def code_points(data: np.ndarray) -> int:
    """Code points of UTF-8 bytes: all bytes but continuations."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


@dataclass
class Checkpoints:
    """Offsets after lines 0, EVERY, 2 * EVERY and so on, and the whole text's counts."""

    lines: np.ndarray
    bytes: np.ndarray
    points: np.ndarray
    n_lines: int
    n_points: int

    @classmethod
    def of(cls, data: np.ndarray, every: int = EVERY, block: int = BLOCK_BYTES) -> Checkpoints:
        lines, at, points = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        seen = passed = 0
        for lo in range(0, len(data), block):
            part = data[lo : lo + block]
            ends = np.flatnonzero(part == NEWLINE) + 1
            chosen = np.arange(every - 1 - seen % every, len(ends), every)
            if len(chosen):
                cuts = ends[chosen]
                steps = np.add.reduceat((part[: cuts[-1]] & 0xC0) != 0x80, np.concatenate(([0], cuts[:-1])), dtype=np.int64)
                lines.append(seen + chosen + 1)
                at.append(lo + cuts)
                points.append(passed + np.cumsum(steps))
            seen += len(ends)
            passed += code_points(part)
        unended = len(data) > 0 and data[-1] != NEWLINE
        return cls(np.concatenate(lines), np.concatenate(at), np.concatenate(points), seen + int(unended), passed)

    def offsets(self, data: np.ndarray, line: int, block: int = BLOCK_BYTES) -> tuple[int, int]:
        """Bytes and code points of the first ``line`` lines."""
        if line >= self.n_lines:
            return len(data), self.n_points
        near = int(np.searchsorted(self.lines, line, "right")) - 1
        left, at, points = line - int(self.lines[near]), int(self.bytes[near]), int(self.points[near])
        while left:
            part = data[at : at + block]
            ends = np.flatnonzero(part == NEWLINE) + 1
            take = int(ends[left - 1]) if len(ends) >= left else len(part)
            left -= min(left, len(ends))
            at, points = at + take, points + code_points(part[:take])
        return at, points


def arranged(prefix: bytes, middle: bytes, suffix: bytes, form: str, marks: tuple[bytes, bytes, bytes]) -> bytes:
    p, s, m = marks
    if form == "psm":
        return b"".join((p, prefix, s, suffix, m, middle))
    return b"".join((s, suffix, p, prefix, m, middle))


def restored(output: Column, form: Column, markers: Markers = Markers()) -> Column:
    """The exact text from an output and its form. Markers start with a sign that they hold nowhere else, so none arises at a seam."""
    head, middle = F.substring_index(output, markers.middle, 1), F.substring_index(output, markers.middle, -1)
    between = lambda text, start, end: F.substring_index(F.substring_index(text, end, 1), start, -1)
    psm = F.concat(between(head, markers.prefix, markers.suffix), middle, F.substring_index(head, markers.suffix, -1))
    spm = F.concat(F.substring_index(head, markers.prefix, -1), middle, between(head, markers.suffix, markers.prefix))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def draws(seed: int, doc_id: Column) -> list[Column]:
    """Four 32-bit draws of a document: the first 8-digit groups of the hex SHA-256 of seed, colon and id (nothing for a null id)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, markers: Markers = Markers(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole texts cut at two drawn lines into prefix, middle and suffix, and put in another order.

    The cuts lie after min and max of draw % (lines + 1) lines.  Empty texts, texts that hold a marker and a share of
    100 - ``fim_percent`` stay plain; of the others ``spm_percent`` put the suffix first.  A null text is empty, a null id draws as
    an empty one, repeated rows are each transformed (alike), an empty table gives no rows, and other columns are not read.
    Rows are worked on where they are read: nothing is shuffled, and a text is held whole, but its lines are not.
    Returns id, n (lines), form, prefix_chars, middle_chars (null where plain) and output.
    """
    bounded_memory(docs.sparkSession)
    if not all(x and x.find(x[0], 1) < 0 for x in (markers.prefix, markers.suffix, markers.middle)) or len({x[0] for x in (markers.prefix, markers.suffix, markers.middle)}) > 1:
        raise ValueError("markers must begin with one sign that they hold nowhere else")
    text = F.coalesce(F.col(text_col), F.lit(""))
    h1, h2, h3, h4 = draws(seed, F.col(id_col))
    held = F.contains(text, F.lit(markers.prefix)) | F.contains(text, F.lit(markers.suffix)) | F.contains(text, F.lit(markers.middle))
    form = F.when((text == "") | held | (h3 % 100 >= fim_percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    read = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2"))
    marks = tuple(x.encode() for x in (markers.prefix, markers.suffix, markers.middle))

    def run(batches):
        for batch in batches:
            forms, one, two = (batch.column(i).to_pylist() for i in (2, 3, 4))
            for piece in slices(batch.column(1)):
                n, prefix_chars, middle_chars, outputs = [], [], [], []
                for i in range(piece.hi - piece.lo):
                    row = piece.lo + i
                    data = piece.data[piece.offsets[i] : piece.offsets[i + 1]]
                    marked = Checkpoints.of(data)
                    n.append(marked.n_lines)
                    if forms[row] == "plain":
                        prefix_chars.append(None)
                        middle_chars.append(None)
                        outputs.append(data.tobytes())
                        continue
                    a, b = sorted((one[row] % (marked.n_lines + 1), two[row] % (marked.n_lines + 1)))
                    (byte_a, point_a), (byte_b, point_b) = marked.offsets(data, a), marked.offsets(data, b)
                    prefix_chars.append(point_a)
                    middle_chars.append(point_b - point_a)
                    outputs.append(arranged(data[:byte_a].tobytes(), data[byte_a:byte_b].tobytes(), data[byte_b:].tobytes(), forms[row], marks))
                own = slice(piece.lo, piece.hi)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[own], pa.array(n, pa.int64()), batch.column(2)[own], pa.array(prefix_chars, pa.int64()), pa.array(middle_chars, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())],
                    names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    out = read.mapInArrow(run, "id long, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def op12_checkpointed_infill(spark, sf_dir: str) -> DataFrame:
    """All documents, transformed and restored. Nulls, empty and long texts, repeats and empty tables: see ``fill_in_middle``."""
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLE = r"""
with texts as (select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
drawn as (
  select doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as units,
    cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4
  from texts),
cut as (
  select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form
  from drawn),
parts as (
  select doc_id, t, n, form, coalesce(array_to_string(units[1:a], ''), '') as p, coalesce(array_to_string(units[a + 1:b], ''), '') as m, coalesce(array_to_string(units[b + 1:n], ''), '') as s from cut)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from parts
"""
