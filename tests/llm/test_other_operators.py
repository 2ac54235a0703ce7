"""URLs, vectors, conversations, archives and the pipeline against plain Python."""

import hashlib
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalcurve.llm import chat, neighbours, queries, urls, warc

SF = "/root/testdata/sf0.01"


def test_urls_edge_cases(spark):
    rows = [
        (1, None, "", "", None, "allow"), (2, "", "", "", None, "allow"), (3, "no scheme", "", "", None, "allow"),
        (4, "HTTP://A.NET", "a.net", "", None, "allow"), (5, "x://A.net/q?b", "a.net", "/q", "net/", "block"),
        (6, "x://example.net/en/a#b", "example.net", "/en/a", "example.net/en/", "allow"),
        (7, "x://nexample.net/en/", "nexample.net", "/en/", "net/", "block"),
        (8, "x://www.foo.org/fr/", "www.foo.org", "/fr/", "org/fr/", "allow"),
        (9, "x://m.example.com/de/1", "m.example.com", "/de/1", "example.com/de/", "block"),
        (10, "x://y://z/en", "y:", "//z/en", None, "allow"), (11, "x://listed.com/a.html", "listed.com", "/a.html", None, "block"),
        (None, "x://www.listed.com/a/?q", "www.listed.com", "/a/", None, "block"), (11, "x://listed.com/a.html", "listed.com", "/a.html", None, "block"),
    ]
    pages = spark.createDataFrame([(*r[:2], "html") for r in rows], "page_id bigint, url string, host string")
    listed = spark.createDataFrame([("http://LISTED.com/a/",), (None,), ("http://LISTED.com/a/",)], "url string")
    found = urls.judge_urls(pages, listed, queries.RULES).drop("listed").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(((r[0], *r[2:]) for r in rows), key=repr)
    assert urls.judge_urls(pages.limit(0), listed, queries.RULES).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages.where("page_id = 11"), listed.limit(0), queries.RULES).collect()} == {"allow"}


def test_bloom_filter_misses_nothing(spark):
    keys = spark.range(4_000).selectExpr("concat('site', id, '/') AS k")
    blocks = 4_000 * 12 // 256
    held = urls.bloom_filter(keys, "k", blocks)
    assert urls.possible_hits(keys, "k", held, blocks).count() == 4_000
    others = spark.range(20_000).selectExpr("concat('other', id) AS k")
    assert urls.possible_hits(others, "k", held, blocks).count() < 400


def _plain_cost(roles, costs):
    best = {(0, 0): 0}
    for i in range(len(roles)):
        for state in range(4):
            if (i, state) not in best:
                continue
            for role in (1, 2, 3):
                price = best[i, state] + (0 if roles[i] == role else costs.relabel)
                options = [price + costs.merge] if state == role else []
                for n in range(3):
                    for empty in product((1, 2, 3), repeat=n):
                        at, legal = state, True
                        for step in (*empty, role):
                            legal &= step in chat._NEXT[at]
                            at = step
                        options += [price + costs.insert * n] if legal else []
                if options:
                    best[i + 1, role] = min(best.get((i + 1, role), 1 << 30), *options)
    return min(c + costs.insert * len(chat._CLOSING[s]) for (i, s), c in best.items() if i == len(roles))


def test_repairs_are_legal_and_cheapest():
    for costs in (chat.Costs(), chat.Costs(merge=2, relabel=5, insert=3)):
        repairer = chat.Repairer(costs)
        for n in range(5):
            for roles in product((None, 1, 2, 3), repeat=n):
                names, *_, cost = chat._render(repairer.path(list(roles), 0, None), ["t"] * n, 0, True, costs)[1:]
                state = 0
                for name in names:
                    assert chat.ROLES.index(name) + 1 in chat._NEXT[state]
                    state = chat.ROLES.index(name) + 1
                assert state in chat._LEGAL_ENDS and cost == _plain_cost(roles, costs)


def test_chat_edge_cases_and_parts(spark):
    rng = random.Random(2)
    rows = [(1, i, rng.choice(["user", "assistant", "system", " USER ", "bot", None]), f"t{i}") for i in range(900)]
    rows += [(2, 0, "user", None), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (3, None, None, "x"), (None, 0, "user", "n"), (4, 0, "system", "s")]
    turns = spark.createDataFrame([(*r, 7) for r in rows], "conv_id int, turn int, role string, text string, part int")
    whole = {r.conv_id: r for r in chat.format_chats(turns).collect()}
    assert whole[2].rendered == "<|user|>\n<|end|>\n<|assistant|>\n\n<|end|>\n" and whole[2].merges == 1
    assert whole[4].roles == ["system", "user", "assistant"] and set(whole) == {1, 2, 3, 4, None}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = sorted((r for r in chat.format_chats(turns, part_turns=10).collect() if r.conv_id == 1), key=lambda r: r.part)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    text = "".join(r.rendered for r in parts)
    assert len(parts) > 1 and [w for w in text.split() if w.startswith("t")] == [f"t{i}<|end|>" if f"t{i}<|end|>" in text else f"t{i}" for i in range(900)]
    state = 0
    for name in (name for r in parts for name in r.roles):
        assert chat.ROLES.index(name) + 1 in chat._NEXT[state]
        state = chat.ROLES.index(name) + 1
    assert sum(r.cost for r in parts) == whole[1].cost and sum(r.n_input for r in parts) == 900
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_archives_round_trip(spark):
    rows = [(1, "http://a/b c", "<p>x</p>"), (2, "http://a/\r\nWARC: no", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "v", "é\r\n\r\n" * 9), (None, "w", "<p>x</p>"), (None, "y", "only"), (6, "z", "q" * 500_000), (1, "http://a/b c", "<p>x</p>")]
    pages = spark.createDataFrame([(*r, "f") for r in rows], "page_id bigint, url string, html string, file string").repartition(3)
    found = warc.archive_pages(pages).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    expected = []
    for page, _, html in rows:
        payload = (html or "").encode()
        first = min((p for p, _, h in rows if p is not None and (h or "") == (html or "")), default=None)
        revisit = first is not None and page != first
        expected.append((page, len(payload), warc.payload_digest(payload), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=key) == sorted(expected, key=key)
    assert all(bytes(r.payload) == b"" or hashlib.sha1(bytes(r.payload)).digest() for r in found)
    small = warc.archive_pages(pages, min_bytes=100)
    assert small.where("record_type = 'revisit'").count() == 0
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_ranges_join_neighbours_only():
    import pyarrow as pa

    batch = pa.record_batch({"file": ["a", "a", "a", "b"], "offset": [0, 10, 10 + warc.GAP_BYTES + 11, 0], "length": [10, 10, 5, 7]})
    assert [(f, a, b, len(p)) for f, a, b, p in warc._ranges(batch)] == [("a", 0, 20, 2), ("a", warc.GAP_BYTES + 21, warc.GAP_BYTES + 26, 1), ("b", 0, 7, 1)]
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n")


def _exact(ids, vectors, asked, k):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for q in asked:
        scores = np.round(unit @ unit[ids.index(q)], 12)
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-scores[i], ids[i]))
        out[q] = [ids[i] for i in order[:k]]
    return out


def test_neighbours_edge_cases(spark):
    rng = np.random.default_rng(0)
    good = rng.normal(size=(40, 4))
    good[20:35] = good[0]  # a group of equal vectors, larger than k
    rows = [(i, v.tolist(), "x") for i, v in enumerate(good)]
    bad = [(100, None, "x"), (101, [0.0] * 4, "x"), (102, [1.0, float("nan"), 0.0, 0.0], "x"), (103, [1.0, None, 0.0, 0.0], "x"), (104, [float("inf")] * 4, "x"), (105, [1.0, 2.0], "x"), (106, [], "x"), (None, [1.0] * 4, "x")]
    vectors = spark.createDataFrame(rows + bad + rows[:1], "vec_id bigint, embedding array<double>, rank string")
    found = neighbours.nearest_neighbours(vectors, vectors.where("vec_id % 2 = 0"), list_vectors=1_000).collect()
    got = {}
    for r in sorted(found, key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(r.score - neighbours.cosine(good[r.query_id], good[r.vec_id])) < 1e-15
    assert got == _exact(list(range(40)), good, range(0, 40, 2), 5)
    assert [len(neighbours.nearest_neighbours(vectors.where("vec_id < 3"), vectors).where("query_id = 1").collect())] == [2]
    assert neighbours.nearest_neighbours(vectors.where("vec_id > 99"), vectors).where("vec_id < 100").count() == 0
    assert neighbours.nearest_neighbours(vectors.limit(0), vectors).count() == 0


def test_neighbours_recall_with_several_lists(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = sorted(vectors.collect())
    exact = _exact([r.vec_id for r in rows], np.array([r.embedding for r in rows], float), [r.vec_id for r in rows if r.vec_id % 10 == 0], 5)
    found = {}
    for r in neighbours.nearest_neighbours(vectors, vectors.where("vec_id % 10 = 0"), list_vectors=50).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(found[q] & set(v)) / 5 for q, v in exact.items()]) >= 0.9


@pytest.mark.parametrize("outliers", [100, 400])
def test_every_query_gets_k_rows_also_far_from_the_bulk(spark, outliers):
    rng = np.random.default_rng(outliers)
    bulk = np.eye(16)[0] + rng.normal(scale=0.02, size=(3_000, 16))
    far = rng.normal(size=(outliers, 16))
    points = np.concatenate([bulk, far])
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id bigint, embedding array<double>")
    found = neighbours.nearest_neighbours(vectors, vectors, list_vectors=20).groupBy("query_id").count().collect()
    assert len(found) == len(points) and {r["count"] for r in found} == {5}
    few = vectors.where("vec_id < 4")
    assert sorted(r["count"] for r in neighbours.nearest_neighbours(few, few, list_vectors=1).groupBy("query_id").count().collect()) == [3] * 4


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_url_list_is_made_of_the_pages(spark, scale):
    folder = f"/root/testdata/{scale}"
    names = set(queries.LISTED_SITES)
    wanted = sum(bool(names & set(r.url.split("://")[1].split("/")[0].split("."))) for r in spark.read.parquet(f"{folder}/pages.parquet").collect())
    assert queries.op2_url_filter(spark, folder).where("listed").count() >= wanted > 0


def test_intermediate_tables_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from vitalcurve.llm.common import shared_dir

    for master in ("yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master)))
    assert shared_dir(SimpleNamespace(conf={"spark.checkpoint.dir": "hdfs://x/y"}, sparkContext=SimpleNamespace(master="yarn"))).startswith("hdfs://x/y/")


def test_pipeline_equals_its_stages_in_plain_python(spark):
    import corpus_pipeline
    from vitalcurve.llm import simhash, substrings

    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    prints = {d: simhash.fingerprint_of(docs[d]) & (2**64 - 1) for d in kept}
    group = {d: d for d in kept}
    for a in sorted(kept):
        for b in kept:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {d: new if g == old else g for d, g in group.items()}
    seen, texts = set(), {}
    for d in sorted(d for d in kept if group[d] == d):
        gone, mine = set(), set()
        for first, n, digest in substrings.spans_of(docs[d]):
            if digest in seen or digest in mine:
                gone.update(range(first, first + n))
            mine.add(digest)
        seen |= mine
        texts[d] = "".join(s for i, s in enumerate(substrings.sentences_of(docs[d])) if i not in gone)
    assert set(out) <= set(texts) and len(out) > 0.8 * len(texts)
    assert all(out[d].decoded_sha256 == hashlib.sha256(texts[d].encode()).hexdigest() for d in out)
    from test_text_operators import _plain_contamination

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    judged = dict(zip(texts, _plain_contamination(texts.values(), items, 13)))
    assert set(out) == {d for d in texts if not judged[d][3]}


def test_pipeline_with_nulls_repeats_and_an_empty_table(spark):
    import corpus_pipeline

    good = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 400").limit(12)
    odd = [(9_001, None), (9_002, ""), (9_003, " \n\t "), (9_004, "123 456"), (None, None)]
    odd = spark.createDataFrame([(*r, "en", "s", 0) for r in odd], "doc_id bigint, text string, lang string, source string, n_chars bigint").select(good.columns)
    docs = good.unionByName(odd).unionByName(good.limit(1)).withColumns({"score": F.lit("own"), "fingerprint": F.lit(1), "items": F.lit("own"), "component_id": F.lit(2)})
    model_docs = spark.read.parquet(f"{SF}/documents.parquet")
    for rows in (docs, docs.limit(0)):
        rows = rows.unionByName(model_docs.limit(0), allowMissingColumns=True)
        for name, stage in corpus_pipeline.STAGES:
            before, columns = rows.count(), rows.columns
            rows = stage(spark, rows, SF) if name != "language" else corpus_pipeline.language.keep_identified(rows, corpus_pipeline.language.train(model_docs))
            rows = corpus_pipeline.written(rows, name)
            assert rows.count() <= before and (name == "byte_bpe" or rows.columns == columns)
        assert not {r.doc_id for r in rows.select("doc_id").collect()} & {9_001, 9_002, 9_003, 9_004, None}
    assert rows.count() == 0 and corpus_pipeline.drop_near_duplicates(spark, docs, SF).where("doc_id IS NULL").count() == 1
