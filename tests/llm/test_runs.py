"""Periodic runs against comparing every word with the one each period before."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from vitalcurve.llm import queries, runs

SF = "/root/testdata/sf0.001"


def _plain_runs(words, least_words=6, least_periods=4):
    numbers = {}
    w = np.array([numbers.setdefault(x, len(numbers)) for x in words], np.int64)
    out = []
    for q in range(1, len(w) // least_periods + 1):
        same = np.concatenate(([False], w[q:] == w[:-q], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e - s + q >= max(least_words, least_periods * q) and not any(q % p == 0 and (w[s : e + q - p] == w[s + p : e + q]).all() for p in range(1, q)):
                out.append((s, e + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _fibonacci(k):
    a, b = ["a"], ["b"]
    for _ in range(k):
        a, b = a + b, a
    return a


def _random(rng, n, kinds):
    return [str(rng.randrange(kinds)) for _ in range(n)]


def _planted(rng, n, kinds):
    words = _random(rng, n, kinds)
    for _ in range(rng.randrange(1, 4)):
        a = rng.randrange(n)
        b = rng.randrange(a, n + 1)
        p = 1 + rng.randrange(max(1, (b - a) // 3))
        for i in range(a, b):
            words[i] = words[a + (i - a) % p]
    return words


def _nested(rng, depth):
    """Repeats of repeats, with odd words between."""
    words = _random(rng, rng.randrange(1, 4), 2)
    for _ in range(depth):
        words = words * rng.randrange(3, 8) + words[: rng.randrange(len(words) + 1)] + _random(rng, rng.randrange(3), 3)
    return words


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(900):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            n = rng.choice([0, 1, 2, 5, 10, 30, 100, 300])
            texts.append(rng.choice([lambda: _random(rng, n, 2), lambda: _random(rng, n, 3), lambda: _planted(rng, n, 50) if n else [], lambda: _planted(rng, n, 2) if n else [], lambda: (_random(rng, 3, 3) * n)[:n], lambda: _fibonacci(rng.randrange(3, 11)), lambda: _nested(rng, rng.randrange(1, 4))])())
        words, begins = runs._numbered([[x.encode() for x in t] for t in texts])
        expected = sorted(((s + int(o), e + int(o), q) for t, o in zip(texts, begins) for s, e, q in _plain_runs(t)), key=lambda r: (r[0], r[2]))
        assert runs.find_runs(words, begins) == expected


def test_large_and_deep_texts():
    rng = random.Random(2)
    for words in (["a"] * 50_000, _planted(rng, 12_000, 5_000), _nested(rng, 5)[:12_000], _random(rng, 12_000, 2), _fibonacci(20), (_fibonacci(9) * 30)):
        assert runs.find_runs(*runs._numbered([[x.encode() for x in words]])) == _plain_runs(words) if len(words) < 50_000 else [(0, 50_000, 1)]


def test_other_limits():
    rng = random.Random(3)
    for words in (_planted(rng, 300, 2), _random(rng, 300, 2)):
        assert runs.find_runs(*runs._numbered([[x.encode() for x in words]]), 12, 5) == _plain_runs(words, 12, 5)
    with pytest.raises(ValueError):
        runs.find_runs(np.zeros(1, np.int64), np.array([0, 1]), 6, 3)


def _plain_row(words):
    found = [(s, e - s, q) for s, e, q in _plain_runs(words)]
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return found, best, " ".join(w for i, w in enumerate(words) if i not in gone)


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_rows_of_odd_texts(spark):
    texts = [None, "", " \n\t ", "a", "a a a a a", "a a a a a a", "A a a a a a a", "x a b a b\na b\ta b  y", "a b " * 5, "é ü é ü é ü é ü", ("k l m " * 4 + "z ") * 6, " ".join(f"w{i % 977}" for i in range(30_000)), "x" * 500_000]
    rows = [(i, t, "own", 1, 2) for i, t in enumerate(texts)] + [(5, texts[5], "own", 1, 2), (None, texts[7], "own", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, start int, period int").repartition(3)
    found = runs.periodic_runs(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        all_, best, short = _plain_row(_words(texts[7 if r.doc_id is None else r.doc_id]))
        assert [tuple(x) for x in r.runs] == all_ and (r["start"], r["length"], r["period"]) == best and r["collapsed"] == short
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_query_follows_its_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = {r.doc_id: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert len(found) == len(docs)
    planted = 0
    for doc in docs:
        words = _words(doc.text)
        h, n = zlib.crc32(str(doc.doc_id).encode()), len(words)
        if h % 10 == 0 and n > 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            for i in range(a, n):
                words[i] = words[a + (i - a) % p]
            planted += 1
        all_, best, short = _plain_row(words)
        r = found[doc.doc_id]
        assert (r.n_runs, r["start"], r["length"], r["period"]) == (len(all_), *best)
        assert r.exponent_milli == (best[1] * 1000 // best[2] if all_ else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n_},{q}\n" for s, n_, q in all_).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(short.encode()).hexdigest()
    assert planted > 5 and sum(r.n_runs > 0 for r in found.values()) > 5
