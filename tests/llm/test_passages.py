"""Passages of 50 words and more, planted in the middle of sentences, against plain substring search."""

import random
import re
from collections import Counter

import pytest

from vitalcurve.llm import substrings


def _word(rng):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))


def _left(passage, inner, blank):
    """Letters of the passage that no run of shared pieces covers, by cutting two texts that hold it."""
    before, after = inner(), inner()
    one, two = f"{inner()}{blank}{passage}{blank}{inner()}", f"{before}{blank}{passage}{blank}{after}"
    known = {digest for _, _, digest in substrings.spans_of(one)}
    gone = {k for a, n, digest in substrings.spans_of(two) if digest in known for k in range(a, a + n)}
    pieces = substrings.sentences_of(two)
    cut = [p for k, p in enumerate(pieces) if k in gone]
    # plain substring search: nothing goes that the other text does not hold
    rest = "".join(p if k not in gone else "\0" for k, p in enumerate(pieces))
    assert all(p.strip() in one for p in cut) and rest.startswith(before[:-40]) and rest.endswith(after[40:])
    return 1 - sum(map(len, cut)) / len(passage)


@pytest.mark.parametrize("kind", ["unpunctuated", "one sentence in the middle", "prose"])
def test_no_planted_passage_stays_whole(kind):
    rng = random.Random(kind)

    def text(n):
        words = [_word(rng) for _ in range(n)]
        if kind == "prose":
            at = rng.randint(0, 9)
            while at < n:
                words[at] += "."
                at += rng.randint(5, 24)
        return " ".join(words)

    for n in (51, 60, 80):
        left = []
        for _ in range(150):
            passage = text(n)
            if kind == "one sentence in the middle":
                words = passage.split()
                words[13] += "."
                words[37] += "."
                passage = " ".join(words)
            left.append(_left(passage, lambda: text(40), " "))
        assert max(left) < 1
        assert sum(x > 0.5 for x in left) <= 0.1 * len(left), sorted(left)[-20:]


def test_passage_without_blanks():
    rng = random.Random(2)
    letters = "".join(chr(0x4E00 + i) for i in range(900))
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    left = [_left(text(100), lambda: text(90), "") for _ in range(100)]
    assert max(left) < 0.5


def test_query_cuts_a_passage_planted_in_a_sentence(spark):
    rng = random.Random(3)
    passage = " ".join(_word(rng) for _ in range(51))
    texts = [" ".join(_word(rng) for _ in range(30)) + f" {passage} " + " ".join(_word(rng) for _ in range(30)) for _ in range(8)]
    out = substrings.drop_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert out[0].text == texts[0]
    assert all(len(r.text) < len(t) - len(passage) / 2 for r, t in zip(out[1:], texts[1:]))


def test_documents_that_share_short_lines_alone_stay(spark):
    rng = random.Random(4)
    lines = [" ".join(_word(rng) for _ in range(n)) + ".\n" for n in (5, 13, 20)]
    texts = ["".join(line + " ".join(_word(rng) for _ in range(30)) + ".\n" for line in lines) for _ in range(9)]
    out = substrings.drop_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    assert [r.text for r in out.orderBy("doc_id").collect()] == texts


def test_documents_against_plain_runs_of_words(spark):
    """No run of 50 words of an earlier document stays, and no word goes that is not in a run of 24 that stands further up."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = dict(docs.orderBy("doc_id").select("doc_id", "text").collect())
    after = dict(substrings.drop_repeats(docs).select("doc_id", "text").collect())
    words = lambda t: re.findall(r"[^\t-\r ]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    runs = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    assert after.keys() == before.keys()
    fifty, known, cut = set(), set(), 0
    for doc, text in before.items():
        own, left = words(text), words(after[doc])
        assert not fifty & set(runs(left, 50))
        fifty |= set(runs(own, 50))
        repeated = set()
        for i, run in enumerate(runs(own, 24)):
            if run in known:
                repeated.update(range(i, i + 24))
            known.add(run)
        gone = Counter(own) - Counter(left)
        assert gone <= Counter(own[i] for i in repeated)
        cut += bool(gone)
    assert cut > 10


def _plain_cuts(rows):
    """Texts that stay, by one walk over all rows in the order of their ids; rows with one id share what stands before them."""
    seen, out = set(), []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0))
    for i, (doc, text) in enumerate(order):
        if i == 0 or doc != order[i - 1][0]:
            before = seen
        mine, gone = set(), set()
        for first, n, digest in substrings.spans_of(text or ""):
            if digest in before or digest in mine:
                gone.update(range(first, first + n))
            mine.add(digest)
        seen = seen | mine
        out.append((doc, text and "".join(s for k, s in enumerate(substrings.sentences_of(text)) if k not in gone)))
    return out


@pytest.mark.parametrize("order", ["up", "down", "mixed"])
@pytest.mark.parametrize("ids", ["numbers", "words", "shared and null"])
def test_hot_passages_over_many_slices(spark, order, ids):
    rng = random.Random(f"{order} {ids}")
    text = lambda n: " ".join(_word(rng) for _ in range(n))
    hot = [text(60) for _ in range(3)]
    rows = [(i, f"{text(20)} {rng.choice(hot)} {text(20)}" if i % 3 else f"{hot[0]} {text(9)} {hot[0]}") for i in range(90)]
    rows += [(90, None), (91, ""), rows[5], rows[5]]
    if ids == "words":
        rows = [(f"{i:04d}", t) for i, t in rows]
    elif ids == "shared and null":
        rows = [(None if i % 4 == 0 else i // 3, t) for i, t in rows]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0) if ids != "words" else (False, r[0]), reverse=order == "down")
    if order == "mixed":
        rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        docs = spark.createDataFrame(rows, f"doc_id {'string' if ids == 'words' else 'bigint'}, text string").repartition(3).sortWithinPartitions("doc_id", ascending=order == "up")
        found = [tuple(r) for r in substrings.drop_repeats(docs).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(found, key=repr) == sorted(_plain_cuts(rows), key=repr)


def test_a_hot_span_leaves_few_rows_to_one_shuffle(spark):
    rng = random.Random(6)
    hot = " ".join(_word(rng) for _ in range(60))
    texts = [f"{_word(rng)} {hot} " + " ".join(_word(rng) for _ in range(40)) for _ in range(900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    spans = substrings.sentence_spans(docs, "doc_id", "text", substrings.MIN_WORDS, substrings.MIN_SENTENCES)
    most = max(r["count"] for r in spans.groupBy("h1", "h2").count().collect())
    assert most <= 3 * 4 and spans.where("place < 0").count() > 900
    plan = substrings.repeated_spans(spans)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") == 1
