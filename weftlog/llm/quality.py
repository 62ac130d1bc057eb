"""Quality rules as a short-circuit cascade whose order is learned from a sample."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.llm.storage import bounded_memory
from weftlog.llm.text import SPACE, Slice, hash_spans, slices, spans, window_hashes, window_starts, words

#: Documents of the sample on which costs and selectivities are estimated, as expected number.
SAMPLE_DOCS = 2000

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: A character begins at every byte that is no UTF-8 continuation byte.
CHARACTER = np.ones(256, dtype=np.uint8)
CHARACTER[0x80:0xC0] = 0
NO_BREAK = np.ones(256, dtype=bool)
NO_BREAK[0x0A] = False
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]] = True  # first bytes only


def repeated(keys: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
    """Which keys occur earlier or later in the same text too."""
    own = keys ^ (texts.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    out = np.zeros(n, dtype=bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


class Features:
    """What rules may ask of a piece of texts; each is computed once, on first use.

    ``keep`` restricts the work to some of the texts: those that no earlier rule has rejected.
    """

    def __init__(self, piece: Slice):
        self.piece, self.n = piece, piece.hi - piece.lo
        self.words = words(piece, SPACE)
        self._known: dict = {}

    def _once(self, name: str, make: Callable):
        if name not in self._known:
            self._known[name] = make()
        return self._known[name]

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[self.piece.offsets[1:]] - sums[self.piece.offsets[:-1]]

    @property
    def n_words(self) -> np.ndarray:
        return self.words.counts

    @property
    def word_chars(self) -> np.ndarray:
        return self._once("word_chars", lambda: self.per_text(CHARACTER[self.piece.data] * SPACE[self.piece.data]))

    @property
    def n_symbols(self) -> np.ndarray:
        return self._once("n_symbols", lambda: self.per_text(SYMBOLS[self.piece.data]))

    @property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and those of them equal to an earlier one, by text."""

        def make():
            starts, ends = spans(self.piece.data, self.piece.offsets, NO_BREAK)
            inner = np.concatenate(([0], np.cumsum(SPACE[self.piece.data], dtype=np.int64)))
            full = inner[ends] > inner[starts]
            starts, ends = starts[full], ends[full]
            text = np.searchsorted(self.piece.offsets, starts, "right") - 1
            keys = hash_spans(self.piece.data, starts, ends) ^ (text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            firsts = np.unique(keys, return_index=True)[1]
            every = np.bincount(text, minlength=self.n)
            return every, every - np.bincount(text[firsts], minlength=self.n)

        return self._once("lines", make)

    @property
    def n_dup_lines(self) -> np.ndarray:
        return self.lines[1]

    @property
    def n_repeat_words(self) -> np.ndarray:
        def make():
            at = window_starts(self.words.first, 3)
            if not len(at):
                return np.zeros(self.n, np.int64)
            text = self.words.texts
            twice = at[repeated(window_hashes(self.words.hashes, 3)[at], text[at], len(at))]
            inside = np.zeros(len(text) + 3, dtype=bool)
            for i in range(3):
                inside[twice + i] = True
            return np.bincount(text[inside[: len(text)]], minlength=self.n)

        return self._once("n_repeat_words", make)

    def letters(self, keep: np.ndarray) -> np.ndarray:
        """Letters (A-Z, a-z and all beyond ASCII), for the texts in ``keep``."""
        out = np.zeros(self.n, np.int64)
        for i in np.flatnonzero(keep):
            out[i] = np.count_nonzero(LETTER[self.piece.data[self.piece.offsets[i] : self.piece.offsets[i + 1]]])
        return out

    def longest(self, keep: np.ndarray) -> np.ndarray:
        """Bytes of the longest word, for the texts in ``keep``."""
        out, lengths = np.zeros(self.n, np.int64), self.words.ends - self.words.starts
        for i in np.flatnonzero(keep & (self.n_words > 0)):
            out[i] = lengths[self.words.first[i] : self.words.first[i + 1]].max()
        return out


@dataclass(frozen=True)
class Rule:
    """``fails(features, keep)`` tells the texts to reject; it need only look at those in ``keep``."""

    name: str
    fails: Callable[[Features, np.ndarray], np.ndarray]


#: Thresholds that leave ordinary prose in any of the languages alone.
RULES = (
    Rule("symbols", lambda f, keep: 10 * f.n_symbols > 3 * f.n_words),
    Rule("duplicate_lines", lambda f, keep: 10 * f.n_dup_lines > 3 * f.lines[0]),
    Rule("word_length", lambda f, keep: (f.word_chars < 2 * f.n_words) | (f.word_chars > 15 * f.n_words)),
    Rule("few_letters", lambda f, keep: keep & (2 * f.letters(keep) < f.word_chars)),
    Rule("endless_word", lambda f, keep: f.longest(keep) > 1000),
)


def estimate(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> dict[str, tuple[float, float]]:
    """Seconds a document and share rejected of each rule alone, on a hash sample of about ``SAMPLE_DOCS`` documents over all partitions."""
    n = docs.count()
    sample = docs.where(F.pmod(F.xxhash64(id_col, F.lit(3)), F.lit(max(1, n // SAMPLE_DOCS))) == 0).select(F.col(text_col).alias("text"))

    def measure(batches):
        for batch in batches:
            for piece in slices(batch.column(0)):
                every = np.ones(piece.hi - piece.lo, dtype=bool)
                names, took, failed = [], [], []
                for rule in rules:
                    features = Features(piece)  # no other rule's work is reused
                    began = time.thread_time()
                    failed.append(int(np.count_nonzero(rule.fails(features, every))))
                    took.append(time.thread_time() - began)
                    names.append(rule.name)
                yield pa.RecordBatch.from_pydict({"rule": names, "took": took, "failed": failed, "n": [len(every)] * len(names)})

    measured = sample.mapInArrow(measure, "rule string, took double, failed long, n long")
    return {r.rule: (r.took / r.n, r.failed / r.n) for r in measured.groupBy("rule").agg(F.sum("took").alias("took"), F.sum("failed").alias("failed"), F.sum("n").alias("n")).collect()}


def ordered(rules: tuple[Rule, ...], stats: dict[str, tuple[float, float]]) -> tuple[Rule, ...]:
    """Rules by rejections per second, most first; rules that were not measured come last."""

    def gain(rule: Rule) -> float:
        cost, rejected = stats.get(rule.name, (1.0, 0.0))
        return rejected / max(cost, 1e-9)

    return tuple(sorted(rules, key=gain, reverse=True))


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """Base measures of every whole text, and the verdict of the rules in their learned order.

    A text that fails the base (under ``min_words`` words, or over half of its words in repeated 3-word windows) is rejected
    before any rule; then each rule looks only at the texts that are left.  The order changes the work and
    ``rejected_by``, never ``kept``.  A null text counts as one without words: base_failed.  Repeated rows give repeated rows,
    an empty table gives none, and further columns of ``docs`` are not read.
    """
    bounded_memory(docs.sparkSession)
    order = ordered(rules, estimate(docs, rules, id_col, text_col))

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for piece in slices(batch.column(1)):
                f = Features(piece)
                failed = (f.n_words < min_words) | (100 * f.n_repeat_words > 50 * f.n_words)
                alive, by = ~failed, np.full(f.n, "", dtype=object)
                by[failed] = "base"
                for rule in order:
                    if not alive.any():
                        break
                    out = rule.fails(f, alive) & alive
                    by[out] = rule.name
                    alive &= ~out
                columns = [f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words]
                yield pa.RecordBatch.from_arrays(
                    [ids[piece.lo : piece.hi], *(pa.array(np.asarray(c, np.int64)) for c in columns), pa.array(failed), pa.array(alive), pa.array([x or None for x in by], pa.string())],
                    names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
    )
    return out.withColumnRenamed("id", id_col)


def op3_rule_cascade(spark, sf_dir: str) -> DataFrame:
    return cascade(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rejected_by")


#: The same measures and rules in SQL.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), grams AS (
  SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    length(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS letters, coalesce(list_max([strlen(x) for x in w]), 0) AS longest
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 3 * n_lines
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * letters < word_chars OR longest > 1000) AS kept
FROM b
"""
