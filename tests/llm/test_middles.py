"""Fill-in-the-middle against cutting the texts in plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from vitalcurve.llm import middles

TEXTS = [
    None, "", "a", "a\n", "\n", "\n\n\n", "one\ntwo\nthree", "one\ntwo\nthree\n", "\r\nx\r\n", "has <P> in it\nx", "<S>", "x<M>", "<P\nS>\n<", "<\nP>\n<S\nM><\n",
    "$1 \\2 $\n\\E{2}+\n", "😀\n😀é́\n x\u0085y\n", "a b " * 300_000, "l\n" * 200_000, "\n".join("x" * (i % 7) for i in range(40_000)), "<p> lower\ncase\n",
]


def _plain(doc, text, unit=r"[^\n]*\n|[^\n]+", rate=100, spm=50, salt="7:", markers=("<P>", "<S>", "<M>")):
    text = text or ""
    units = re.findall(unit, text)
    digest = hashlib.sha256((salt + ("" if doc is None else str(doc))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in markers) or h3 % 100 >= rate:
        return n, "plain", None, None, text, text
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"{markers[1]}{s}{markers[0]}{p}{markers[2]}{m}", text
    return n, "psm", len(p), len(m), f"{markers[0]}{p}{markers[1]}{s}{markers[2]}{m}", text


@pytest.fixture(scope="module")
def rows():
    out = [(100 * k + i, t, "n", "own") for k in range(4) for i, t in enumerate(TEXTS) if k == 0 or len(t or "") < 1_000]
    return [*out, out[6], out[6], (None, "one\ntwo\nthree", "n", "own")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # names that results and helper columns have too
    return spark.createDataFrame(rows, "doc_id bigint, text string, n string, output string").repartition(4).cache()


@pytest.mark.parametrize("options", [{}, {"rate": 40, "spm": 90, "salt": "x"}, {"markers": ("$1\\", "{mid+", "(?end)")}, {"unit": r"[^ ]* |[^ ]+"}])
def test_forms_equal_plain_python(docs, rows, options):
    marks = {"markers": options["markers"]} if "markers" in options else {}
    made = middles.fill_in_middle(docs, **options)
    found = made.withColumn("back", middles.restored(F.col("output"), F.col("form"), **marks)).drop("doc_id").collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted((_plain(r[0], r[1], **options) for r in rows), key=key)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_empty_table_other_ids_and_bad_markers(docs):
    assert middles.fill_in_middle(docs.limit(0)).count() == 0
    named = middles.fill_in_middle(docs.selectExpr("concat('d', doc_id) AS doc", "text AS body").where("doc = 'd6'"), id_col="doc", text_col="body")
    r = named.first()
    assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == _plain("d6", TEXTS[6])[:5]
    for markers in (("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "", "<M>"), ("<P>", "x<P>", "<M>")):
        with pytest.raises(ValueError):
            middles.fill_in_middle(docs, markers=markers)


def test_all_of_it_is_one_projection_without_python(spark):
    plan = middles.fill_in_middle(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|InArrow|InPandas", plan)
