"""Fill-in-the-middle: against a plain version, and exact round trips."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlog.llm.infill import Checkpoints, Markers, fill_in_middle, restored

ROWS = [
    (1, "one\ntwo\nthree\n"), (2, "no end"), (3, ""), (4, None), (5, "\n\n\n"), (6, "é\nü\n漢字\n😀 x"), (7, "has <P> in it\nand more\n"), (8, "<M>"), (9, "a <S\nb>\n<\n"), (9, "a <S\nb>\n<\n"),
    (None, "null id\nline\n"), (10, "\r\nx\r\n"), (11, "".join(f"line {i} é\n" for i in range(5000))), (12, "z" * 300_000 + "\n" + "y" * 10), (10_000_000_007, "big id\n"),
]


def expected(doc, text, seed=7, fim=100, spm=50, m=("<P>", "<S>", "<M>")):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in m) or h3 % 100 >= fim:
        return doc, n, "plain", None, None, text
    p, mid, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    return doc, n, form, len(p), len(mid), m[0] + p + m[1] + s + m[2] + mid if form == "psm" else m[1] + s + m[0] + p + m[2] + mid


def key(row):
    return tuple(str(x) for x in row)


@pytest.mark.parametrize("options", [{}, {"seed": 3, "fim_percent": 60, "spm_percent": 10}])
def test_against_plain_version(spark, write, options):
    out = fill_in_middle(write(ROWS), **options)
    got = [tuple(r) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()]
    args = (options.get("seed", 7), options.get("fim_percent", 100), options.get("spm_percent", 50))
    assert sorted(got, key=key) == sorted((expected(*r, *args) for r in ROWS), key=key)
    back = out.select("doc_id", restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted((str(r.doc_id), r.t) for r in back) == sorted((str(i), t or "") for i, t in ROWS)


def test_other_markers_round_trip(spark, write):
    marks = Markers("[pre]", "[suf]", "[mid]")
    out = fill_in_middle(write([(i, f"a [pre\nb{i}\n]pre]\n") for i in range(30)]), markers=marks)
    rows = out.select("doc_id", "output", restored(F.col("output"), F.col("form"), marks).alias("t")).collect()
    assert all(r.t == f"a [pre\nb{r.doc_id}\n]pre]\n" and r.output != r.t for r in rows)
    with pytest.raises(ValueError):
        fill_in_middle(write([(1, "x")]), markers=Markers("<P>", "<<S>", "<M>"))


def test_empty_table(spark, empty):
    assert fill_in_middle(empty).collect() == []


@pytest.mark.parametrize(("every", "block"), [(1, 3), (4, 7), (64, 1 << 20), (3, 1)])
def test_checkpoints_find_every_line(every, block):
    text = "é\n\nabc\n" * 9 + "漢\nend"
    data = np.frombuffer(text.encode(), np.uint8)
    marked = Checkpoints.of(data, every, block)
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    assert (marked.n_lines, marked.n_points) == (len(units), len(text))
    assert len(marked.lines) <= 1 + len(units) // every
    for i in range(len(units) + 2):
        head = "".join(units[:i])
        assert marked.offsets(data, i, block) == (len(head.encode()), len(head))
