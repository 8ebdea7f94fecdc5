"""Fill-in-middle outputs against plain Python on odd texts, several frame sizes, and rebuilding from output and form only."""

import hashlib
import re

import pytest
import zstandard
from pyspark.sql import functions as F

from armwave.llm import infill

TEXTS = [None, "", "\n", "a", "a\n", "\n\n\n", "one\ntwo\nthree", "one\ntwo\nthree\n", "é日本\n" * 700, "no line end " * 9000, "has <P> in it\nb", "<S", "<\n<P\n>M>\n<", "a<\nM>b\nP>c",
         "".join(f"line {i} <{'PSM'[i % 3]}\n" for i in range(4000)), "\r\n \n\t\n\x00x", "🙂\n" * 5]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, "\n".join("w%d" % j for j in range(i % 7)) + "\n" * (i % 3)) for i in range(150)]
    return [*out, (5, TEXTS[5]), (5, "other"), (None, "x\ny\nz"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for i, name in enumerate(["row", "key", "t", "n", "form", "output", "frames", "units", "marked", "_no_text2"]):
        df = df.withColumn(name, F.lit(i))
    return df.repartition(4)


def expected(k, t, seed=7, rate=100, spm=50):
    t = t or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", t)
    assert "".join(u) == t
    h = hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i: i + 8], 16) for i in (0, 8, 16, 24))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(u), "plain", None, None, t
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    return len(u), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def sha(t):
    return hashlib.sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize("frame, rate", [(1 << 16, 100), (7, 100), (1000, 40)])
def test_against_plain_python(docs, rows, frame, rate):
    out = infill.transform(infill.framed(docs, frame=frame), rate=rate)
    got = [tuple(r) for r in infill.digests(out).select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()]
    want = [(k, *(w := expected(k, t, rate=rate))[:4], sha(w[4]), sha(t)) for k, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    whole = infill.texts(out).select("row.doc_id", "output_text", "row._no_text").collect()
    assert sorted(((r[0], r[1]) for r in whole), key=str) == sorted(((k, expected(k, t, rate=rate)[4]) for k, t in rows), key=str)
    assert sum(r[2] for r in whole) == sum(t is None for _, t in rows)


def test_only_cut_frames_are_opened():
    data = "".join(f"line {i}\n" for i in range(20000)).encode()
    press, unpress = zstandard.ZstdCompressor(), zstandard.ZstdDecompressor()
    parts = [data[i: i + 1000] for i in range(0, len(data), 1000)]
    units, chars = [0], [0]
    for p in parts:
        units.append(units[-1] + p.count(b"\n"))
        chars.append(chars[-1] + len(p))
    text = infill.Seeker([press.compress(p) for p in parts], units, chars, unpress)
    low, high = text.place(5000), text.place(12345)
    assert text.opened == 2 and low[2] == data.index(b"line 5000\n") and high[2] == data.index(b"line 12345\n")
    middle = text.between(low, high, press)
    assert text.opened <= 4 and b"".join(map(unpress.decompress, middle)) == data[low[2]: high[2]]
    whole = sum(f in text.frames for f in middle)
    assert whole >= len(middle) - 2  # frames between the cuts are the stored ones


def test_empty_table(docs):
    assert infill.digests(infill.transform(infill.framed(docs.limit(0)))).count() == 0
