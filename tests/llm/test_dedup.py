import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import CLASHING, corpus_rows, edited, words
from weftlog.llm import components, decontaminate, neardup, suffixes
from weftlog.llm.storage import numbered, stable
from weftlog.llm.text import SPACE, slices, span_hashes, window_hashes, window_starts
from weftlog.llm.text import words as split


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repeated_words(rows, length):
    """Words of each row that lie in a window of ``length`` words found at another place too, and those found earlier."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    counts, first, out, dup = Counter(), {}, {}, {}
    texts = [split_words(t) for _, t in rows]
    for i in order:
        for s in range(len(texts[i]) - length + 1):
            w = tuple(texts[i][s : s + length])
            counts[w] += 1
            first.setdefault(w, (i, s))
    for i in order:
        out[i], dup[i] = set(), set()
        for s in range(len(texts[i]) - length + 1):
            w = tuple(texts[i][s : s + length])
            if counts[w] > 1:
                out[i] |= set(range(s, s + length))
                if first[w] != (i, s):
                    dup[i] |= set(range(s, s + length))
    return out, dup


def check_spans(docs):
    """Spans against brute force: each is true, and together they hold exactly the windows that occur earlier, and twice or more."""
    rows = numbered(docs, doc_id=F.col("doc_id"), text=F.col("text")).collect()
    place = {r.row: (r.doc_id is not None, r.doc_id or 0, r.row) for r in rows}
    texts, ids, n = {r.row: split_words(r.text) for r in rows}, {r.row: r.doc_id for r in rows}, suffixes.LENGTH
    at = {}
    for row in sorted(texts, key=place.get):
        for s in range(len(texts[row]) - n + 1):
            at.setdefault(tuple(texts[row][s : s + n]), []).append((row, s))
    again = {x for places in at.values() for x in places[1:]}
    twice = {x for places in at.values() if len(places) > 1 for x in places}
    rows_of = {}
    for row, i in ids.items():
        rows_of.setdefault(i, []).append(row)
    got = {True: set(), False: set()}
    spans = suffixes.repeats(docs)[1].collect()
    for r in spans:
        own = texts[r.row][r.begin : r.end]
        assert ids[r.row] == r.id and len(own) == r.end - r.begin >= n
        held = [(*place[o], r.other_begin) for o in rows_of[r.other] if texts[o][r.other_begin : r.other_begin + len(own)] == own]
        assert any((x < (*place[r.row], r.begin)) == r.duplicate and x != (*place[r.row], r.begin) for x in held), r
        got[r.duplicate] |= {(r.row, s) for s in range(r.begin, r.end - n + 1)}
    assert got[True] == again and got[True] | got[False] == twice
    return spans


def test_spans_equal_brute_force(corpus):
    assert len(check_spans(corpus)) > 20


def test_hot_passages_over_several_ranges(write):
    rng = random.Random(13)
    hot, p = words(rng, 64), words(rng, 90)
    rows = [(i, " ".join(words(rng, rng.randrange(0, 12)) + hot[rng.randrange(0, 8) : 64 - rng.randrange(0, 6)] + words(rng, 5))) for i in range(400)]
    rows += [(1000 + i, " ".join(words(rng, 9) + p[10 * i : 10 * i + 55] + words(rng, 9))) for i in range(4)] + [(2000, "tick tock " * 90), (2001, "tock tick " * 60)]
    check_spans(write(rows, 5))


def test_edited_copies_between_do_not_hide_a_passage(write):
    rng = random.Random(12)
    rows = []
    for g in range(60):
        p = words(rng, 50)
        own = lambda: words(rng, 20)
        rows += [(10 * g, " ".join(own() + p + own())), (10 * g + 1, " ".join(own() + p[2:48] + own())), (10 * g + 2, " ".join(own() + p + own()))]
    got = {(r.id, r.begin, r.end, r.duplicate, r.other, r.other_begin) for r in check_spans(write(rows))}
    assert got == {(10 * g + i, 20, 70, i > 0, 10 * g + 2 - i, 20) for g in range(60) for i in (0, 2)}


def test_rows_of_any_table_are_numbered_once(spark, corpus):
    other = corpus.repartition(3, "text").withColumn("x", F.rand())
    check_spans(stable(other))


def test_cutting_leaves_one_copy(corpus, empty):
    out = suffixes.without_duplicates(corpus).collect()
    rows = [(r.doc_id, r.text) for r in out]
    assert set(out[0].asDict()) == set(corpus.columns) and out[0].row == "x"
    left, _ = repeated_words(rows, suffixes.LENGTH + 1)
    assert not any(left.values())
    before = Counter(corpus_rows())
    clean = {7: None, 3: None}
    untouched = [r for r in corpus_rows() if r[1] and len(split_words(r[1])) < suffixes.LENGTH]
    assert all(Counter(rows)[r] == before[r] for r in untouched) and clean
    assert sum(t is None for _, t in rows) == sum(t is None for _, t in corpus_rows())
    assert all(r.n_chars == len(r.text) for r in out if r.text is not None)
    assert suffixes.without_duplicates(empty).count() == 0 and suffixes.repeats(empty)[1].count() == 0


def test_cut_words():
    assert suffixes.cut_words("a  bé\nc d ", [(1, 3)]) == "a  d "
    assert suffixes.cut_words("a b", [(0, 2)]) == ""


def expected_classes(rows):
    texts = {}
    for _, t in rows:
        if split_words(t):
            texts.setdefault(t, len(texts))
    keys = []
    for t in texts:
        for piece in slices(pa.array([t])):
            keys.append(neardup.labelled_shingles(split(piece, SPACE))[0])
    root = list(range(len(keys)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            if neardup.aligned(keys[a], keys[b]) > 0:
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {t: top(i) for t, i in texts.items()}


def test_classes(corpus, empty):
    rows = corpus_rows()
    group = expected_classes(rows)
    got = neardup.near_duplicates(corpus).collect()
    assert len(got) == len(rows) and neardup.near_duplicates(empty).count() == 0
    members = {}
    for doc, t in rows:
        if t in group:
            members.setdefault(group[t], []).append(doc)
    smallest = {g: min((d for d in m if d is not None), default=None) for g, m in members.items()}
    text_of = {d: t for d, t in rows if d is not None}
    for r in got:
        if r.id is not None:
            t = text_of[r.id]
            assert r.class_id == (smallest[group[t]] if t in group else r.id), (r, t and t[:30])
    assert sum(r.first for r in got) == len(members) + sum(1 for _, t in rows if t not in group)
    kept = neardup.one_of_each(corpus)
    assert kept.count() == sum(r.first for r in got) and set(CLASHING) <= set(kept.columns)


def test_hot_group_of_near_copies(write):
    rng = random.Random(4)
    base = words(rng, 150)
    rows = [(1000 + i, " ".join(edited(rng, base, rng.randrange(1, 4)))) for i in range(150)] + [(5000, " ".join(base))]
    rows += [(i, " ".join(words(rng, 100))) for i in range(40)]
    got = {r.id: r.class_id for r in neardup.near_duplicates(write(rows)).collect()}
    group, texts = expected_classes(rows), dict(rows)
    assert sum(got[d] != min(e for e in texts if group[texts[e]] == group[texts[d]]) for d in texts) == 0


def check_classes(rows, docs):
    """Number of documents that are no class of their own."""
    group, members = expected_classes(rows), {}
    for d, t in rows:
        members.setdefault(group[t], []).append(d)
    assert {r.id: r.class_id for r in neardup.near_duplicates(docs).collect()} == {d: min(members[group[t]]) for d, t in rows}
    return sum(len(m) for m in members.values() if len(m) > 1)


def test_pairs_on_one_template(write):
    """1,200 pairs of similarity 0.86 on a template that makes all others 0.75."""
    rng = random.Random(14)
    template, rows = words(rng, 176), []
    for i in range(1200):
        own = template[:88] + words(rng, 24) + template[88:]
        other = list(own)
        for at in rng.sample(range(0, 200, 8), 3):
            other[at] = f"edit{i}x{at}"
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(other))]
    got = {r.id: r.class_id for r in neardup.near_duplicates(write(rows, 4)).collect()}
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(1200)) == 1200
    assert len(set(got.values())) == 1200


@pytest.mark.skipif(not Path("/root/testdata/sf0.01/documents.parquet").exists(), reason="needs the small table")
def test_whole_small_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    group, members = expected_classes(rows), {}
    for d, t in rows:
        members.setdefault(group.get(t, -1 - d), []).append(d)
    wanted = {d: min(members[group.get(t, -1 - d)]) for d, t in rows}
    assert {r.id: r.class_id for r in neardup.near_duplicates(docs).collect()} == wanted


def test_shared_passage_with_own_rests(write):
    rng = random.Random(8)
    core, rows = words(rng, 89), []
    for i in range(150):
        rest = words(rng, 15)
        rows.append((2 * i, " ".join(core + rest)))
        if i % 3 == 0:
            rows.append((2 * i + 1, " ".join(core + rest[:6] + words(rng, 9))))
    assert check_classes(rows, write(rows)) == 100


def test_growing_versions(write):
    rng = random.Random(9)
    rows = []
    for g in range(12):
        text = words(rng, 104)
        more = words(rng, 40)
        rows += [(100 * g + i, " ".join(edited(rng, text[:-3] + words(rng, 3), 0))) for i in range(12)]
        rows += [(100 * g + 50 + n, " ".join(text + more[:n])) for n in (18, 30)]
    assert check_classes(rows, write(rows)) == len(rows)


def test_texts_beside_a_unit(write):
    rng = random.Random(10)
    base = words(rng, 150)
    rows = [(i, " ".join(edited(rng, base, 1))) for i in range(80)] + [(100 + i, " ".join(edited(rng, base, rng.randrange(3, 6)))) for i in range(60)]
    rows = list({t: (d, t) for d, t in rows}.values())
    group, texts = expected_classes(rows), dict(rows)
    got = {r.id: r.class_id for r in neardup.near_duplicates(write(rows)).collect()}
    assert all(got[d] == min(e for e in texts if group[texts[e]] == group[texts[d]]) for d in texts)


def test_alignment_is_a_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.permutation(30).astype(np.uint64)
        b = a.copy()
        for _ in range(rng.integers(0, 4)):
            i, j = rng.integers(0, 30, 2)
            b[[i, j]] = b[[j, i]]
        b = np.concatenate((b, np.arange(100, 100 + rng.integers(0, 5)).astype(np.uint64)))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        true = table[-1, -1] / (len(a) + len(b) - table[-1, -1])
        assert neardup.aligned(a, b) == pytest.approx(true if true >= 0.8 else 0.0)


def test_order_matters_for_sketches():
    rng = random.Random(2)
    w = words(rng, 400)
    keys = []
    for text in (" ".join(w), " ".join(w[200:] + w[:200]), " ".join(edited(rng, w, 2))):
        for piece in slices(pa.array([text])):
            keys.append(neardup.sketches(*neardup.labelled_shingles(split(piece, SPACE)))[0])
    same = lambda i: int((keys[0] == keys[i]).sum())
    assert same(2) > same(1)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (105, 100)] + [(200, 200 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 105)} | {200 + i: 200 for i in range(30)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_in_few_jobs(spark, monkeypatch):
    """Each round is one table; stars take one round, and what is added to them is all that takes more."""
    rounds, put = [], components.written
    monkeypatch.setattr(components, "written", lambda df, name: rounds.append(name) or put(df, name))
    stars = [(100 * k, 100 * k + i) for k in range(5) for i in range(1, 9)]
    linked = lambda more: {r.node: r.root for r in components.components(spark.createDataFrame(stars + more, "a long, b long")).collect()}
    assert linked([]) == {100 * k + i: 100 * k for k in range(5) for i in range(9)} and len(rounds) == 1
    assert linked([(108, 204), (203, 307), (407, 7), (9, 9)]) == {100 * k + i: (0 if k in (0, 4) else 100) for k in range(5) for i in range(9)} and len(rounds) <= 4


def test_window_hashes():
    values = np.arange(1, 200, dtype=np.uint64) ** np.uint64(3)
    whole = window_hashes(values, 7)
    assert all(whole[i] == window_hashes(values[i : i + 7], 7)[0] for i in range(0, len(whole), 13))
    assert span_hashes(values, np.array([5]), np.array([12]))[0] == whole[5]
    assert window_starts(np.array([0, 3, 3, 8]), 3).tolist() == [0, 3, 4, 5]


@pytest.fixture
def changing_splits(spark, monkeypatch):
    """Executors come and go: each written table is followed by scans that are split for another number of cores."""
    from weftlog.llm import storage

    key, plain, cores = "spark.sql.leafNodeDefaultParallelism", storage.written, iter([3, 11, 1, 6] * 50)

    def written(df, name):
        out = plain(df, name)
        spark.conf.set(key, str(next(cores)))
        return out

    for module in (storage, suffixes, neardup, decontaminate):
        monkeypatch.setattr(module, "written", written)
    spark.conf.set(key, "4")
    yield
    spark.conf.unset(key)


def many_files(write):
    rng = random.Random(8)
    shared = [words(rng, 90) for _ in range(6)]
    texts = [" ".join(words(rng, 30) + shared[i % 6] + words(rng, 40)) if i % 3 == 0 else " ".join(words(rng, 120)) for i in range(60)]
    texts += [" ".join(edited(rng, texts[i].split(), 1)) for i in range(20)]
    rows = list(enumerate(texts))
    return rows, write(rows, 12)


def test_rows_are_known_when_splits_change(write, changing_splits):
    rows, docs = many_files(write)
    check_spans(docs)
    assert check_classes(rows, docs) >= 40
    items = docs.sparkSession.createDataFrame([(1, " ".join(rows[3][1].split()[5:40]))], "item_id long, text string")
    hit = {i for i, t in rows if " ".join(rows[3][1].split()[5:40])[:60] in t}
    assert {i for i, _ in rows} - {r.doc_id for r in decontaminate.clean_documents(docs, items).collect()} >= {3} and hit >= {3}


def test_cutting_and_choosing_when_splits_change(write, changing_splits):
    rows, docs = many_files(write)
    kept = {r.doc_id: r.text for r in neardup.one_of_each(docs).collect()}
    assert all(kept[i] == dict(rows)[i] for i in kept) and len(kept) == len(set(expected_classes(rows).values())) + sum(t not in expected_classes(rows) for _, t in rows)
    cut = {r.doc_id: r.text for r in suffixes.without_duplicates(docs).collect()}
    assert sum(cut[i] == t for i, t in rows if i in cut) >= 30 and all(set(cut[i].split()) <= set(t.split()) for i, t in rows if i in cut)


def test_what_may_be_scanned_again(spark, corpus):
    assert stable(corpus) is corpus
    part = corpus.select("doc_id", "text").where("doc_id > 3")
    assert stable(part) is part
    one, two = ({(r.row, r.text) for r in numbered(part, text=F.col("text")).collect()} for _ in range(2))
    assert one == two and len({r for r, _ in one}) == part.count()
    for changes in (corpus.where(F.rand() < 0.5), corpus.orderBy("text"), spark.createDataFrame([(1, "x")], "doc_id long, text string")):
        assert stable(changes) is not changes


def test_partners_join_the_classes(write):
    got = neardup.near_duplicates(write([r for r in corpus_rows() if r[0] is not None])).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r.class_id, []).append(r)
    for members in sizes.values():
        for r in members:
            if r.partner_id is None:
                continue
            assert r.partner_id in {m.id for m in members} and 0.8 - 1e-9 <= r.similarity <= 1
        ids = {m.id for m in members}
        linked, seen = {i: {m.partner_id for m in members if m.id == i} | {m.id for m in members if m.partner_id == i} for i in ids}, set()
        todo = [members[0].id]
        while todo:
            if (x := todo.pop()) not in seen and x is not None:
                seen.add(x)
                todo += linked.get(x, set())
        # an edge a member: a class of n is in at most n / 2 parts, and copies hang on their first
        assert len(seen) >= min(2, len(ids))
