import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import corpus_rows, words
from weftlog.llm import chat, decontaminate, encode, packing, quality, sharding, tokens, toxicity, warc
from weftlog.llm.storage import fresh
from weftlog.llm.text import slices


def norm(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def against_sql(df, sql, **tables):
    duck = duckdb.connect()
    for name, table in tables.items():
        duck.register(name, table.toArrow())
    found = duck.execute(sql)
    order = [d[0] for d in found.description]
    got, expected = norm(df.select(*order).collect()), norm(found.fetchall())
    assert got == expected


def test_quality(corpus, empty):
    docs = corpus.dropDuplicates(["doc_id"])  # the SQL groups by id
    docs.select("doc_id", "text").write.mode("overwrite").parquet(path := fresh(docs.sparkSession, "q"))
    docs = docs.sparkSession.read.parquet(path)
    against_sql(quality.cascade(docs.where("doc_id IS NOT NULL")).drop("rejected_by"), quality.ORACLE, documents=docs.where("doc_id IS NOT NULL"))
    assert quality.cascade(corpus).count() == len(corpus_rows()) and quality.cascade(empty).count() == 0


def test_few_letters_counts_characters(spark, write):
    words_of = [f"ж{i}{i * 7919 % 10007:05d}" for i in range(60)]
    docs = write([(1, " ".join(words_of)), (2, " ".join(w.strip("0123456789") * 3 + w[:2] for w in words_of))])
    got = {r.doc_id: (r.kept, r.rejected_by) for r in quality.cascade(docs).collect()}
    assert got[1] == (False, "few_letters") and got[2][1] != "few_letters"
    against_sql(quality.cascade(docs).drop("rejected_by"), quality.ORACLE, documents=docs.select("doc_id", "text"))


def test_rules_are_ordered_by_rejections_per_second():
    stats = {"symbols": (1.0, 0.5), "duplicate_lines": (0.1, 0.2), "word_length": (1.0, 0.0), "few_letters": (5.0, 0.9)}
    assert [r.name for r in quality.ordered(quality.RULES, stats)][:3] == ["duplicate_lines", "symbols", "few_letters"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_whole_texts(name):
    own, plain = encode.Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    texts = [t or "" for _, t in corpus_rows()] + ["a  b", " lead", "trail ", "x \n y", "  a", "a 　 b", "it's  we'll", "<|endoftext|> <|endoftext|>", "a <|endoftext|> b", "foo  <|endoftext|>  y</s> <s>q [UNK] <unk>", "É́ é x", "tab\tq", "e ́x"]
    for _ in range(2):  # once learning and once from memory
        for piece in slices(pa.array(texts), 5000):
            ids, first = own.encode(piece)
            for i in range(piece.hi - piece.lo):
                assert ids[first[i] : first[i + 1]].tolist() == plain.encode(texts[piece.lo + i], add_special_tokens=False).ids


def test_packing(corpus, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = packing.pack_along_curve(corpus, path, sequence=64).collect()
    lengths, tokens_of = defaultdict(list), defaultdict(int)
    for r in rows:
        lengths[r.part, r.local].append((r.offset, r.length))
        tokens_of[r.doc_id] += r.length
        assert len(r.ids) == 4 * r.length
    for pieces in lengths.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 64 and at & (at - 1) == 0
    expected = defaultdict(int)
    for doc, t in corpus_rows():
        expected[doc] += len(plain.encode(t or "", add_special_tokens=False).ids) + 1
    assert tokens_of == expected
    assert packing.packed_pieces(empty, path).count() == 0


def test_hilbert_neighbours_touch():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    index = packing.hilbert(grid, 3)
    assert sorted(index) == list(range(512)) and np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(1).max() == 1


def test_shards(corpus, empty, write):
    rows = [(i, "same text over and over") for i in range(300)] + [(1000 + i, "w " * (i % 37)) for i in range(600)] + corpus_rows()
    got = sharding.shard_by_splitters(write(rows), 8).collect()
    assert len(got) == len(rows) and sharding.shard_by_splitters(empty, 8).count() == 0
    assert norm((r.doc_id, r.size, r.text_crc32) for r in got) == norm((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    for shard in range(8):
        own = [r for r in got if r.shard == shard]
        assert abs(sum(r.size for r in own) - total / 8) <= largest and sorted(r.slot for r in own) == list(range(len(own)))


def test_addressable_codes(spark, corpus, empty):
    folder = fresh(spark, "codes")
    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = tokens.write_codes(corpus, folder, path)
    manifest.write.parquet(kept := fresh(spark, "manifest"))
    got = tokens.read_codes(spark, folder, spark.read.parquet(kept)).orderBy("start").collect()
    plain = Tokenizer.from_file(path)
    rows = sorted(corpus_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [d for d, _ in rows]
    ids = defaultdict(list)
    for d, t in rows:
        ids[d].append([*plain.encode(t or "", add_special_tokens=False).ids, 2])
    at = 0
    for r in got:
        assert r.start == at and np.frombuffer(r.ids, "<u4").tolist() in ids[r.doc_id]
        at += r.n_tokens
    assert tokens.write_codes(empty, fresh(spark, "codes"), path).count() == 0


def test_random_access():
    ids = np.random.default_rng(3).integers(0, 1 << 20, 3000).astype(np.uint32)
    codes = tokens.Codes.of(b"".join(tokens.packed([None, 5], np.array([0, 10, 3000]), ids)))
    assert [codes.token(i) for i in range(3000)] == ids.tolist()
    cuts = [0, 1, 7, 8, 511, 512, 513, 1024, 2047, 2560, 2999, 3000]
    assert all(np.array_equal(codes.span(lo, hi), ids[lo:hi]) for lo in cuts for hi in cuts if lo <= hi)
    small = tokens.Codes.of(b"".join(tokens.packed([5], np.array([0, 512]), np.arange(512))))
    assert all(np.array_equal(small.span(lo, 512), np.arange(lo, 512)) for lo in (0, 255, 256, 511, 512))
    with pytest.raises(ValueError, match="too large"):
        tokens.encode_levels(np.array([1 << 20]), (8, 8))


def test_decontamination(spark, corpus, write, empty):
    rng = __import__("random").Random(9)
    rows = dict(r for r in corpus_rows() if r[0] is not None)
    own = rows[9].split()
    texts = ["no match " + " ".join(words(rng, 20)), " ".join(own[3:20]).upper(), " ".join(own[5:14]), own[0], None, "", "!!!", " ".join(words(rng, 12)), " ".join(own[3:20]).upper()]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    items.write.mode("overwrite").parquet(path := fresh(spark, "items"))
    items = spark.read.parquet(path)
    docs = write([(d, t) for d, t in rows.items()] + [(77_000, "x, " + ", ".join(own[4:16]) + " - y"), (77_001, "Zz " + own[0].upper() + "!")])
    against_sql(decontaminate.decontamination_report(docs, items), decontaminate.ORACLE, documents=docs.select("doc_id", "text"), benchmark=items)
    assert decontaminate.decontamination_report(corpus, items).count() == len(corpus_rows())
    clean = decontaminate.clean_documents(docs, items)
    hit = {r.doc_id for r in decontaminate.decontamination_report(docs, items).where("contaminated").collect()}
    assert 77_000 in hit and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - hit and clean.columns == docs.columns
    assert decontaminate.decontamination_report(empty, items).count() == 0 and decontaminate.clean_documents(docs, items.limit(0)).count() == docs.count()


def test_escapes(spark):
    texts = ["plain", "\\", "\\\\<s>", "<s>", "</s>[INST] ok [/INST]", "[\\INST]", "<|turn|>a<|says|>b<|done|>", "a\\<|done|>", "", "é <<SYS>>"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e")).withColumn("u", chat.unescaped(F.col("e"))).collect()
    assert [r.u for r in rows] == texts and not [r for r in rows if any(c in r.e for c in chat.CONTROL)]


def test_reply_trees(spark):
    m = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "good", 3.0), ("t", 3, 1, "assistant", "bad", 1.0), ("t", 4, 2, "user", "thanks <s>", 0.5), ("t", 5, 99, "user", "orphan", 9.0), ("t", 6, 7, "user", "cycle", 1.0), ("t", 7, 6, "user", "cycle", 1.0),
         ("t", 8, 7, "user", "hangs on it", 1.0), ("one", 1, None, "user", None, None)] + [("deep", i, i - 1, "user" if i % 2 else "assistant", f"m{i}", 0.0) for i in range(1, 301)]
    df = spark.createDataFrame(m, "conv string, node int, parent int, role string, text string, score double")
    got = {(r.conv, r.branch): r for r in chat.format_trees(df, 3).select("conv", "branch", "leaf", "formatted", chat.parsed_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("said")).collect()}
    assert {k: r.leaf for k, r in got.items()} == {("t", 1): 5, ("t", 2): 4, ("t", 3): 3, ("one", 1): 1, ("deep", 1): 300}
    assert [tuple(t) for t in got["t", 2].turns] == [("user", "q"), ("assistant", "good"), ("user", "thanks <s>")] and got["t", 2].said == "good"
    assert [t.text for t in got["deep", 1].turns] == [f"m{i}" for i in range(1, 301)]
    assert chat.format_trees(df.limit(0)).count() == 0


def test_warc(spark, empty):
    big = "<p>" + "x" * 300_000
    pages = [(1, "http://a/", "<p>one</p>"), (2, "http://b/ü x\n", "<p>one</p>"), (3, None, None), (4, "u", ""), (5, "u", "é"), (5, "u", "é"), (None, "u", "<p>one</p>"), (9, "u", big), (8, "u", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("file", F.lit(1))
    folder = fresh(spark, "warc")
    index = warc.write_archives(df, folder).collect()
    assert sum(r.records for r in index) == len(pages)
    got = sorted(warc.read_archives(spark, folder).collect(), key=lambda r: (r.page_id is None, r.page_id))
    data = {h: (h or "").encode() for _, _, h in pages}
    assert [(r.page_id, r.record_type, r.refers_to) for r in got] == [(1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3), (5, "response", None), (5, "response", None), (8, "response", None), (9, "revisit", 8), (None, "response", None)]
    for r in got:
        html = next(h for p, _, h in pages if p == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(data[html]), warc.digest_of(data[html])) and (r.payload is None or bytes(r.payload) == data[html])
    assert warc.write_archives(df.limit(0), fresh(spark, "warc")).count() == 0


def test_toxicity_held_out(spark, write):
    rng = __import__("random").Random(21)
    rows, marks = [], []
    for i in range(1500):
        w, bad = words(rng, rng.randrange(20, 60)), rng.random() < 0.2
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(("zorg", "vexil", "quadd" + w[0], "quadd" + w[-1])) + rng.choice(("", "!", ",")))
        rows.append((i, " ".join(w)))
        if rng.random() < 0.7:
            marks.append((i, int(bad)))
    docs = write([*rows, (90_000, None), (90_001, ""), (None, "zorg"), (90_002, "zorg " * 20_000)])
    labels = spark.createDataFrame([*marks, (None, 1), (3, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode() if d is not None else b"") % 5 == 0) for d, r in got.items())
    test = [(got[i].predicted, y) for i, y in marks if got[i].held_out]
    assert sum(p == y for p, y in test) / len(test) > 0.97
    assert got[90_002].predicted == 1 and got[90_000].score == got[90_001].score
    blind = toxicity.score(docs, toxicity.fit(docs, labels.where("toxic = 0"))).agg(F.max("predicted")).first()[0]
    assert blind == 0 and toxicity.without_toxic(docs, labels).where("doc_id = 90002").count() == 0


def test_all_labelled_rows_teach(spark, write, monkeypatch):
    rng = random.Random(31)
    rows, marks = [], []
    for i in range(1500):
        toxic = i % 5 == 0
        rows.append((i, " ".join(words(rng, 30) + (["vile" + "abcdefghij"[i // 5 % 10] * 9] if toxic else []) + words(rng, 10))))
        if i % 3 == 0:
            marks.append((i, int(toxic)))
    monkeypatch.setattr(toxicity, "SAMPLE_DOCS", 150)
    seen, fit_model = [], toxicity.fit_label_model
    monkeypatch.setattr(toxicity, "fit_label_model", lambda spoken, label, *n: seen.append(sum(n[0]) if n else len(label)) or fit_model(spoken, label, *n))
    toxicity.fit(write(rows), spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert seen == [sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in rows)]


def test_texts_meet_few_labels_as_they_meet_many(spark, monkeypatch):
    """Labels small enough to broadcast join by a sort as larger ones do, so what is shuffled grows with the input and makes no step."""
    from weftlog.llm import toxicity

    plans = {}

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().sparkPlan().toString()
        return toxicity_written(df, name)

    toxicity_written = toxicity.written
    monkeypatch.setattr(toxicity, "written", kept)
    docs = spark.createDataFrame([(i, "vile awful words here" if i % 3 == 0 else "kind and gentle words") for i in range(200)], "doc_id long, text string")
    toxicity.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 AS int) AS toxic"))
    for name in ("toxicity-labelled", "toxicity-features"):
        assert "SortMergeJoin" in plans[name] and "BroadcastHashJoin" not in plans[name]
