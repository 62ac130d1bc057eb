"""The pipeline's stages, each against a brute-force version on what the one before it kept; and every query of the subpackage."""

import math
import re
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_dedup import expected_classes, split_words
from weftlog.llm import queries, suffixes, toxicity
from weftlog.llm.storage import written

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the small tables")


def plain(docs):
    return sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect())


def without_repeats(rows):
    n, seen, out = suffixes.LENGTH, set(), []
    for doc, text, lang, source, chars in rows:
        w, gone = split_words(text), set()
        for s in range(len(w) - n + 1):
            key = tuple(w[s : s + n])
            if key in seen:
                gone |= set(range(s, s + n))
            seen.add(key)
        if gone:
            spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
            edge = [a for a, _ in spans] + [len(text)]
            text = text[: edge[0]] + "".join(text[edge[i] : edge[i + 1]] for i in range(len(w)) if i not in gone)
            chars = len(text)
        if not gone or text.strip():
            out.append((doc, text, lang, source, chars))
    return out


def without_benchmark(rows, items):
    def norm(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    windows = set()
    for text in items:
        w = norm(text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[i : i + k]) in windows for k in sizes for i in range(len(w) - k + 1))
    return [r for r in rows if not hit(norm(r[1]))]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    scored = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet")))
    clean = {r.doc_id for r in scored.where("predicted = 0").collect()}
    one = written(stages[0](spark, docs, DATA), "one")
    assert plain(one) == [r for r in plain(docs) if r[0] in clean]

    two, rows = written(stages[1](spark, one, DATA), "two"), plain(one)
    group, first = expected_classes([(r[0], r[1]) for r in rows]), {}
    for r in rows:
        first.setdefault(group.get(r[1], -1 - r[0]), r)
    assert plain(two) == sorted(first.values())

    three = written(stages[2](spark, two, DATA), "three")
    assert plain(three) == without_repeats(plain(two))

    four = written(stages[3](spark, three, DATA), "four")
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert plain(four) == without_benchmark(plain(three), items)

    check_pieces(stages[4](spark, four, DATA), [(r[0], r[1]) for r in plain(four)])


def check_pieces(pieces, rows):
    tokenizer, held, laid = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), defaultdict(list), defaultdict(list)
    for r in pieces.collect():
        held[r.doc_id].append(r)
        laid[r.sequence_id].append((r.offset, r.length))
    assert set(held) == {d for d, _ in rows}
    for doc, text in rows:
        ids, at = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], 0
        for r in sorted(held[doc], key=lambda r: r.start):
            own = b"".join(x.to_bytes(4, "little") for x in ids[r.start : r.start + r.length])
            assert r.start == at and r.ids_crc32 == zlib.crc32(own) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    for own in laid.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == 4096 or (at < 4096 and at & (at - 1) == 0)


def norm(v):
    return ("nan" if math.isnan(v) else round(v, 5)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    rows = sorted((tuple(norm(v) for v in r) for r in got.select(*[F.col(f"`{c}`") for c in cols]).collect()), key=repr)
    assert rows
    if name == "op5_hilbert_packing":
        check_pieces(got, [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()])
    if name in queries.ORACLES:
        duck = duckdb.connect()
        for t in ("documents", "benchmark", "labels", "pages", "conversations"):
            duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        found = duck.execute(queries.ORACLES[name])
        order = [d[0] for d in found.description]
        both = [c for c in cols if c in order]
        assert both == sorted(order)
        mine = sorted((tuple(norm(r[c]) for c in both) for r in got.select(*both).collect()), key=repr)
        assert mine == sorted((tuple(norm(r[order.index(c)]) for c in both) for r in found.fetchall()), key=repr)
