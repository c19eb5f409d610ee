"""Files to documents: names, bytes, failures and the parse cache, against plain Python."""

import random
import re

import pytest
from lumenry.operators import chunking
from lumenry.sources import raw
from pyspark.sql import functions as F

RULES = [
    ("contracts", r".*", "raw/contracts", ".pdf", "exact"),
    ("reports", r".*", "raw/reports", ".pdf", "any_case"),
    ("rules", r"^att_\d+_x\d+$", "raw/rules/attachments", ".pdf", "exact"),
    ("rules", r"^att_\d+$", "raw/rules/html", ".html", "exact"),
    ("rules", r"^(strict_v\d_\d+)_", "raw/rules/txt", ".txt", "prefix"),
]
FILES = """raw/contracts/c1.pdf raw/contracts/c2.PDF raw/contracts/sub/c3.pdf raw/reports/r1.PDF raw/reports/r2.pdf raw/reports/r2.PDF raw/reports/r3.pDf raw/reports/r3x.pdf
raw/rules/attachments/att_1_x2.pdf raw/rules/html/att_1.html raw/rules/html/att_2.htm raw/rules/txt/strict_v3_017_name.txt raw/rules/txt/strict_v3_018_a.txt raw/rules/txt/strict_v3_018_b_c.txt
raw/rules/txt/strict_v3_0170_other.txt raw/rules/txt/strict_v3_019.txt raw/rules/txt/strict_v3_020_only.pdf raw/contracts/no_suffix raw/contracts/two.dots.pdf""".split()


@pytest.mark.parametrize(
    ("domain", "doc_id", "path", "n_hits", "error"),
    [
        ("contracts", "c1", "raw/contracts/c1.pdf", 1, None),
        ("contracts", "c2", None, 0, "not_found"),
        ("contracts", "c3", None, 0, "not_found"),
        ("contracts", "two.dots", "raw/contracts/two.dots.pdf", 1, None),
        ("contracts", "no_suffix", None, 0, "not_found"),
        ("reports", "r1", "raw/reports/r1.PDF", 1, None),
        ("reports", "r2", None, 2, "ambiguous"),
        ("reports", "r3", "raw/reports/r3.pDf", 1, None),
        ("rules", "att_1_x2", "raw/rules/attachments/att_1_x2.pdf", 1, None),
        ("rules", "att_1", "raw/rules/html/att_1.html", 1, None),
        ("rules", "att_2", None, 0, "not_found"),
        ("rules", "strict_v3_017_mojibake", "raw/rules/txt/strict_v3_017_name.txt", 1, None),
        ("rules", "strict_v3_018_a", None, 2, "ambiguous"),
        ("rules", "strict_v3_019_x", None, 0, "not_found"),
        ("rules", "strict_v3_020_only", None, 0, "not_found"),
        ("rules", "something", None, 0, "unknown_name"),
        ("rules", None, None, 0, "unknown_name"),
        ("other", "c1", None, 0, "unknown_domain"),
        (None, "c1", None, 0, "unknown_domain"),
    ],
)
def test_resolve(resolved, domain, doc_id, path, n_hits, error):
    assert resolved[domain, doc_id] == (path, n_hits, error)


@pytest.fixture(scope="module")
def resolved(spark):
    asked = [c for mark in test_resolve.pytestmark for c in mark.args[1]]
    wanted = spark.createDataFrame([(d, i) for d, i, *_ in asked] + [("contracts", "c1")], "domain string, doc_id string")
    got = raw.resolve(wanted, spark.createDataFrame([(f,) for f in FILES], "path string"), RULES).collect()
    assert len(got) == len(asked)
    return {(r["domain"], r["doc_id"]): (r["path"], r["n_hits"], r["error"]) for r in got}


def read_text(data):
    for encoding in ("utf-8-sig", "utf-8", "gb18030"):
        try:
            return re.sub("\r\n?", "\n", data.decode(encoding))
        except UnicodeDecodeError:
            continue
    return None


BYTES = [
    b"plain", "﻿marked é".encode(), "日本 é\r\nx\ry".encode(), "条款 é ß 保险".encode("gb18030"), b"\xef\xbb\xbf", b"\xef\xbb\xbf\xff", b"\xff\xfe", b"\x81\x30\x89\x38 ok", b"ok \x80", b"\xed\xa0\x80", b"\xc0\xaf", b"\xf5\x80\x80\x80", b"a\x00b",
    "😀".encode(), "😀".encode("gb18030"), "﻿﻿twice".encode(),
]


def test_bytes_equal_python(spark, tmp_path):
    dice = random.Random(1)
    data = BYTES + [bytes(dice.choice(b"\x41\xc3\xa9\x81\x30\xef\xbb\xbf\xe4\xb8\xad\xff\x80") for _ in range(dice.randint(1, 8))) for _ in range(300)]
    for i, d in enumerate(data):
        (tmp_path / f"{i}.txt").write_bytes(d)
    got = {int(r["path"].rsplit("/", 1)[1][:-4]): r for r in raw.decoded(spark.read.format("binaryFile").load(str(tmp_path))).select("path", "text", "encoding").collect()}
    assert [got[i]["text"] for i in range(len(data))] == [read_text(d) for d in data]
    assert [got[i]["encoding"] for i in range(4)] == ["utf-8"] * 3 + ["gb18030"]
    rows = spark.createDataFrame([(1, None), (2, b"")], "i int, content binary")  # files without a byte are no rows of binaryFile
    assert sorted(tuple(r)[2:] for r in raw.decoded(rows.where("i = 2")).collect()) == [("", "utf-8")]
    assert tuple(raw.decoded(rows.where("i = 1")).first())[2:] == (None, None)


def _merged(text):
    few = lambda x: 1 <= len(re.sub(r"\s+", "", x)) <= 3 and not re.search("[A-Za-z]{2}", x)
    rows = [x.strip() for x in text.splitlines() if x.strip()]
    if not rows or sum(map(few, rows)) <= 0.6 * len(rows):
        return text
    out = re.sub(r"\s+([，。；：、,.!?！？）】》])", r"\1", "".join(rows))
    out = re.sub(r"([（【《])\s+", r"\1", out)
    return re.sub(r"([。！？；])", r"\1\n", re.sub(r"[ \t]{2,}", " ", out)).strip()


def test_character_lines(spark):
    dice = random.Random(2)
    texts = ["", "\n\n", "ab\ncd\nef", "a\nb\nc", "第\n一\n条\n。\n本\n x ，\n合\n（ y\n同\n！\nlong line here"] + ["\n".join(dice.choice(["保", "险。", "a", "ab", " x", "（ z", "1 ，", "", "long words", "a  b"]) for _ in range(dice.randint(1, 12))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["m"] for r in df.select("i", chunking.merge_character_lines(F.col("t")).alias("m")).collect()}
    assert [got[i] for i in range(len(texts))] == [_merged(t) for t in texts]


DOCS = [
    (1, "txt", "总则 x\n  first part of it, long enough\n第二章 y\nsecond part, long enough as well".encode()),
    (2, "txt", b"one paragraph, long enough to stay\n \nshort\n\nanother paragraph which is long enough"),
    (3, "txt", b"\xff\xff\xff"),
    (4, "paged", b"page one is long enough to stay\f\xff\xff\fpage three is long enough to stay\f\f" + "第三页".encode()),
    (5, "html", b"<h1>Title</h1><p>" + b"some words in a block, " * 20 + b"</p>"),
    (6, "odt", b"x"),
    (7, "txt", None),
    (8, "paged", None),
    (9, "paged", b"\xff\f\xff"),
    (10, "txt", b""),
    (11, "txt", ("y" * 4000).encode()),
]


def _parsed(df):
    return {r["doc_id"]: ([(c["page"], c["section"], c["k"], c["text"]) for c in r["chunks"]], [tuple(f) for f in r["failures"]]) for r in df.collect()}


def test_failures_stay_where_they_are(spark):
    got = _parsed(raw.parse(spark.createDataFrame(DOCS, "doc_id long, kind string, content binary")))
    assert got[1] == ([(None, "总则 x", 0, "总则 x\n  first part of it, long enough"), (None, "第二章 y", 1, "第二章 y\nsecond part, long enough as well")], [])
    assert got[2] == ([(None, "", 0, "one paragraph, long enough to stay"), (None, "", 1, "another paragraph which is long enough")], [])
    assert got[3] == ([], [("document", "encoding")])
    assert got[4] == ([(1, "", 0, "page one is long enough to stay"), (3, "", 0, "page three is long enough to stay")], [("page_2", "encoding")])
    assert [c[1] for c in got[5][0]] == ["Title"] and got[5][1] == []
    assert got[6] == ([], [("document", "kind")])
    assert got[7] == got[8] == ([], [("document", "content")])
    assert got[9] == ([], [("page_1", "encoding"), ("page_2", "encoding")])
    assert got[10] == ([], [])
    assert [len(c[3]) for c in got[11][0]] == [1800, 1800, 800] and [c[2] for c in got[11][0]] == [0, 1, 2]


def test_cache_parses_what_is_new_changed_or_asked_for(spark, tmp_path):
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, kind string, content binary")
    cache = raw.ParseCache(spark, str(tmp_path / "cache"))
    assert cache.read() is None
    assert cache.update(df(DOCS)) == {"documents": 11, "failed_documents": 4, "failed_pages": 3, "chunks": 10}
    first = _parsed(cache.read())
    assert first == _parsed(raw.parse(df(DOCS)))
    assert cache.update(df(DOCS))["documents"] == 0 and cache.batches() == [1]
    assert cache.update(df(DOCS), spark.createDataFrame([(1,), (3,), (1,), (99,)], "doc_id long"))["documents"] == 2
    changed = [(2, "txt", b"a changed paragraph, long enough to stay"), *DOCS[2:], (12, "txt", b"a new document that is long enough")]
    assert cache.update(df(changed)) == {"documents": 2, "failed_documents": 0, "failed_pages": 0, "chunks": 2}
    now = _parsed(cache.read())
    assert cache.batches() == [1, 2, 3] and cache.read().count() == 12
    assert now[2][0][0][3].startswith("a changed") and now[1] == first[1] and now[12][0]
    assert {r["doc_id"]: r["batch"] for r in cache.read().collect()} == {i: {1: 2, 3: 2, 2: 3, 12: 3}.get(i, 1) for i in range(1, 13)}
    assert cache.update(df(changed), "all")["documents"] == 11
    (tmp_path / "cache" / "_broken").mkdir()  # a run that ended early
    assert cache.batches() == [1, 2, 3, 4] and cache.read().count() == 12
