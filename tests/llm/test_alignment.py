"""Alignment of two tokenizers against a plain version that walks both token lists."""

import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from weftlog.llm import alignment
from weftlog.llm.storage import written

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ROWS = [
    (1, "The quick brown fox's jump,  over\tthe lazy dog.\n\nAnd again 12345 times"), (2, "x"), (3, " "), (4, "   "), (5, ""), (6, None), (7, "naïve café — 漢字かな 😀👍🏽  end "), (8, "has ▁ in it"),
    (9, "<|endoftext|> and </s> <0x41> <s>"), (10, "trailing  "), (11, "a\x00b"), (12, "line one\r\nline two\n   indented\n"), (13, "The quick brown fox's jump"), (13, "The quick brown fox's jump"), (None, "the the the the"), (14, "word " * 3000 + "x" * 5000),
]


def plain(text):
    """(a ids, b ids, links by token number with bytes, groups) by walking both lists; None where a side does not give the text back."""
    if not text:
        return None
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second, signs = SentencePieceProcessor(model_file=B), alignment._byte_signs()
    one, ids_b = first.encode(" " + text, add_special_tokens=False), second.encode(text)
    bytes_a = [bytes(signs[c] for c in x) for x in one.tokens]
    bytes_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, second.id_to_piece(i)) for i in ids_b)]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    links, groups, p, q, at_a, at_b, group_a, group_b = [], [], 0, 0, 0, 0, {}, {}
    while p < len(bytes_a) and q < len(bytes_b):
        end_a, end_b = at_a + len(bytes_a[p]), at_b + len(bytes_b[q])
        links.append((p, q, max(at_a, at_b), min(end_a, end_b)))
        group_a[p], group_b[q] = one.ids[p], ids_b[q]
        if end_a == end_b:
            groups.append((group_a, group_b))
            group_a, group_b = {}, {}
        if end_a <= end_b:
            p, at_a = p + 1, end_a
        if end_b <= end_a:
            q, at_b = q + 1, end_b
    return one.ids, ids_b, links, groups


def expected(rows):
    own, counts = [], Counter()
    for doc, text in rows:
        found = plain(text)
        pairs = [(found[0][p], found[1][q]) for p, q, _, _ in found[2]] if found else []
        counts.update(set(pairs))
        own.append((doc, found, pairs))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for doc, found, pairs in own:
        a, b, links, groups = found or ((), (), (), ())
        text = ";".join(",".join(map(str, x.values())) + "|" + ",".join(map(str, y.values())) for x, y in groups)
        out.append((doc, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if found else ""))
    return out


def key(row):
    return tuple(str(x) for x in row)


def counted(docs, hot):
    texts = alignment.aligned_texts(docs, A, B).withColumn("groups", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(""))
    texts = written(texts, "texts")
    out = alignment.with_counts(texts, written(alignment.pair_counts(texts), "counts"), hot)
    return [tuple(r) for r in out.select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()]


@pytest.mark.parametrize("hot", [1 << 18, 5, 0])
def test_against_plain_version(spark, write, hot):
    assert sorted(counted(write(ROWS), hot), key=key) == sorted(expected(ROWS), key=key)


def test_corpus_against_plain_version(spark, corpus):
    rows = [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]
    assert sorted(counted(corpus, 40), key=key) == sorted(expected(rows), key=key)


def test_empty_table(spark, empty):
    assert counted(empty, 10) == []


def test_counts_in_small_parts(spark, write, monkeypatch):
    monkeypatch.setattr(alignment, "COUNTED_PAIRS", 8)
    assert sorted(counted(write(ROWS), 5), key=key) == sorted(expected(ROWS), key=key)


def test_links_and_products(spark, write):
    rows = [r for r in ROWS if r[0] in (1, 7, 8, 12)]
    docs = write(rows)
    overlap = [tuple(r) for r in alignment.token_links(docs, A, B).collect()]
    group = [tuple(r)[:5] for r in alignment.token_links(docs, A, B, by="group").collect()]
    want_overlap, want_group = [], []
    for doc, text in rows:
        if (found := plain(text)) is None:
            continue
        want_overlap += [(doc, p, q, found[0][p], found[1][q], lo, hi) for p, q, lo, hi in found[2]]
        want_group += [(doc, p, q, a, b) for x, y in found[3] for p, a in x.items() for q, b in y.items()]
    assert sorted(overlap) == sorted(want_overlap)
    assert sorted(group) == sorted(want_group)


def test_pieces_equal_whole_texts(spark):
    """Cutting at blanks changes no id."""
    import numpy as np

    from weftlog.llm.text import Slice

    texts = [" " + t for _, t in ROWS if t]
    data = [t.encode() for t in texts]
    piece = Slice(0, len(data), np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    ids, first = alignment.side(B).encode(piece)
    model = SentencePieceProcessor(model_file=B)
    for i, t in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == model.encode(t[1:])
