"""Operators on documents against plain Python, on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from vitalcurve.llm import bpe, decontaminate, language, simhash, substrings, tokens
from vitalcurve.llm.crf import posteriors

# names that results and helper columns have too
SCHEMA = "doc_id bigint, text string, lang string, score double, items string, fingerprint int, _hits int, n_chars bigint"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
WORDS = "the of and river stone alpha beta gamma delta house tree Überfluß niño élan".split()


def _text(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.2 else "") for _ in range(n))


def _rows():
    base = [_text(i, 60) for i in range(12)]
    texts = [None, "", "  \n\t", "a", "A b", LONG, LONG + " end", *base, base[0], base[1] + " tail", base[2].upper(), "¿? 123", "x" * 5_000]
    rows = [(i, t, "en" if i % 2 else "de", 0.5, "own", 1, 2, 9) for i, t in enumerate(texts)]
    return [*rows, rows[7], rows[0], (None, base[3], None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_fingerprints_follow_their_definition(docs):
    def plain(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    for text in {r[1] for r in _rows() if r[1] != LONG and (r[1] or "")[:40] != LONG[:40]}:
        assert simhash.fingerprint_of(text) & (2**64 - 1) == plain(text)
    assert docs.sparkSession.sql("SELECT xxhash64('an é')").first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest("an é".encode(), 42)


def test_simhash_components(docs):
    found = simhash.simhash_groups(docs).collect()
    assert len(found) == len(_rows())
    prints = [(int(r.fingerprint, 16), r.doc_id) for r in found]
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for a, b in combinations(range(len(prints)), 2):
            if label[a] != label[b] and bin(prints[a][0] ^ prints[b][0]).count("1") <= 2:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    for i, row in enumerate(found):
        ids = [prints[j][1] for j in range(len(prints)) if label[j] == label[i] and prints[j][1] is not None]
        assert row.component_id == (min(ids) if ids else None)


def test_simhash_links_every_pair_within_the_radius(spark):
    rng = random.Random(3)
    prints = [0, -1] + [rng.getrandbits(64) - (1 << 63) for _ in range(40)]
    prints += [p ^ m for p in prints[2:12] for m in (1, 3, 1 << 40, 7)]
    frame = spark.createDataFrame([(p,) for p in prints], "fingerprint bigint")
    from vitalcurve.llm.common import components

    roots = {r.node: r.root for r in components(simhash.fingerprint_links(frame)).collect()}
    for a, b in combinations(set(prints), 2):
        if bin((a ^ b) & (2**64 - 1)).count("1") <= 2:
            assert roots[a] == roots[b]
    with pytest.raises(ValueError):
        simhash.fingerprint_links(frame, 3)


def test_components_of_a_chain_and_a_star(spark):
    from vitalcurve.llm.common import components

    edges = [(i, i + 1) for i in range(60)] + [(1000, j) for j in range(1001, 1200)] + [(5, 5), (1, 0)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(61)} | {j: 1000 for j in range(1000, 1200)}


def test_simhash_dedup_keeps_one_of_each_group(docs, none):
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    groups = {r.doc_id: r.component_id for r in simhash.simhash_groups(docs).collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, c in groups.items() if i == c} | {None}
    assert simhash.simhash_dedup(none).count() == 0


def _plain_contamination(texts, items, window):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for name, text in items:
        words = find(text)
        for i in range(max(1, len(words) - window + 1)) if words else ():
            windows.setdefault(tuple(words[i : i + window]), set()).add("" if name is None else str(name))
    out = []
    for text in texts:
        words, hit, names = find(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if own := windows.get(tuple(words[i : i + size])):
                    hit.update(range(i, i + size))
                    names |= own
        out.append((len(words), len(hit), sorted(names), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


@pytest.mark.parametrize("window,block_words", [(13, 500_000), (13, 60), (3, 40)])
def test_contamination_equals_all_windows(docs, spark, window, block_words):
    texts = [r[1] for r in _rows()]
    items = [(1, " ".join(texts[7].split()[5:30])), (2, "of"), (3, None), (4, ""), (5, LONG[3_000:3_400]), (6, texts[8].upper()), (6, texts[9]), (None, texts[10]), (7, texts[8])]
    found = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id int, text string"), window, block_words=block_words)
    got = sorted((r.text or "", r.n_words, r.n_hit, r["items"], r.contaminated) for r in found.collect())
    assert got == sorted((t or "", *x) for t, x in zip(texts, _plain_contamination(texts, items, window)))


def test_items_larger_than_a_block_and_a_very_long_text(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    big = [word() for _ in range(3_000)]
    filler = " ".join(word() for _ in range(20_000))
    texts = [" ".join(big[at : at + n]) + " " + filler[:400] for at, n in ((0, 13), (87, 14), (88, 13), (93, 200), (2_987, 13), (500, 12), (2_000, 900))]
    texts += [texts[3]] * 40 + [None, ""]
    texts.append(f"{filler} " * 160 + " ".join(big[1_000:1_500]) + f" {filler}")
    assert len(texts[-1]) > 19_000_000
    items = [(1, " ".join(big)), (2, " ".join(big[90:130])), (3, "日本" * 3_000 + " é")]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(4)
    listed = spark.createDataFrame(items, "item_id int, text string")
    expected = _plain_contamination(texts, items, 13)
    for block_words in (100, 2_000, 500_000):
        found = decontaminate.contamination(docs, listed, block_words=block_words).orderBy("doc_id")
        assert [(r.n_words, r.n_hit, r["items"], r.contaminated) for r in found.drop("text").collect()] == expected


def test_no_block_of_items_is_above_its_bound(spark):
    items = spark.createDataFrame([(str(i), _text(i, 10 + 37 * i % 400)) for i in range(60)] + [("long", LONG), ("none", "")], "_id string, _text string")
    parts = decontaminate._parts(items, 13, 300)
    words = decontaminate._item_words(decontaminate._dealt(parts.cache(), 500))
    sizes = [r["count"] for r in words.groupBy("_block").count().collect()]
    assert max(sizes) <= 500 and len(sizes) <= 3 * sum(sizes) / 500
    assert parts.agg(F.max("_size")).first()[0] <= 300 and parts.where("_id = 'none'").count() == 0


@pytest.mark.parametrize("part", [1, 7, 64])
def test_words_are_hashed_alike_in_parts_of_any_size(monkeypatch, part):
    texts = [r[1] for r in _rows() if r[1] is None or len(r[1]) < 6_000] + ["é" * 200 + " " + "é" * 200, "ab" * 90, "", "a\0b"]
    whole = decontaminate._Words(texts)
    monkeypatch.setattr(decontaminate, "_PART_BYTES", part)
    cut = decontaminate._Words(texts)
    assert cut.hashes.tolist() == whole.hashes.tolist() and cut.starts.tolist() == whole.starts.tolist() and cut.begins.tolist() == whole.begins.tolist()
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    assert np.diff(whole.begins).tolist() == [len(w) for w in words]
    assert whole.between(0, len(whole.hashes)) == [w.encode() for own in words for w in own]


def test_decontaminate_keeps_columns(docs, none, spark):
    items = spark.createDataFrame([(1, _rows()[8][1])], "item_id int, text string")
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns and kept.where("items = 'own'").count() > 0
    assert _rows()[8][1] not in {r.text for r in kept.collect()}
    assert decontaminate.decontaminate(none, items).count() == 0
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == docs.count()


def test_repeated_spans_are_cut_once(docs, none):
    rows = {(r.doc_id, r.text) for r in substrings.drop_repeats(docs).collect()}
    texts = {}
    for r in _rows():
        texts.setdefault(r[0], r[1])
    seen, expected = set(), set()
    for doc in sorted(texts, key=lambda d: (d is None, d or 0)):
        text, gone, mine = texts[doc], set(), set()
        for first, n, digest in substrings.spans_of(text) if text else ():
            if digest in seen or digest in mine:
                gone.update(range(first, first + n))
            mine.add(digest)
        seen |= mine
        expected.add((doc, text and "".join(s for i, s in enumerate(substrings.sentences_of(text)) if i not in gone)))
    assert rows == expected
    out = substrings.drop_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("text IS NOT NULL AND n_chars <> length(text)").count() == 0
    assert substrings.drop_repeats(none).count() == 0


def test_long_passage_goes_from_all_but_the_first(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(" ".join(word() for _ in range(9)) + "." for _ in range(7))
    inside = lambda: " ".join(word() for _ in range(20))
    texts = [f"{inside()} {passage} {inside()}" for _ in range(6)]
    out = substrings.drop_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert out[0].text == texts[0]
    middle = set(" ".join(passage.split(". ")[1:-1]).split())
    assert all(not middle & set(r.text.replace(".", "").split()) for r in out[1:])
    assert all(set(t.split()[:20]) <= set(r.text.split()) for t, r in zip(texts, out))


def test_sentences_join_to_the_text():
    for row in _rows():
        if row[1]:
            assert "".join(substrings.sentences_of(row[1])) == row[1]


@pytest.fixture(scope="module")
def byte_bpe():
    return bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def test_byte_bpe_equals_its_library(byte_bpe):
    import tiktoken

    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks, special_tokens={})
    rng = random.Random(1)
    texts = [r[1] for r in _rows() if r[1] != LONG] + ["é" * 300 + "日本" * 90, "it's  they'll\n\n x", "ab" * 200, "\0\0", "<|endoftext|>", "🙂" * 40]
    texts += ["".join(chr(rng.randint(1, 0xD7FF)) for _ in range(300)), "".join(rng.choice("abc de") for _ in range(2_000))]
    for text, ids in zip(texts, byte_bpe.encode(texts)):
        assert ids.tolist() == theirs.encode_ordinary(text or "")
        assert byte_bpe.decode(ids) == (text or "").encode()


def test_byte_bpe_round_trip(docs, none):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = bpe.round_trip(docs, path, public_tokenizers.PATTERN).collect()
    assert sorted(r.decoded_sha256 for r in found) == sorted(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in _rows())
    assert all(r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() and r.n_tokens == len(r.ids) for r in found)
    decoded = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert sorted(bytes(r.decoded) for r in decoded.collect()) == sorted((r[1] or "").encode() for r in _rows())
    assert bpe.round_trip(none, path, public_tokenizers.PATTERN).count() == 0


def test_ranks_of_all_lengths_pack():
    for ranks in (np.array([0, 255, 256, 65_535, 65_536, 2**24 - 1, 2**24, 2**32 - 1, 5]), np.arange(0), np.random.default_rng(0).integers(0, 70_000, 1_001)):
        control, data = tokens.pack(ranks)
        assert (tokens.unpack(control, data, len(ranks)) == ranks).all() and len(control) == -(-len(ranks) // 4)


def test_token_files_round_trip(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    expected = sorted(((-1 if r[0] is None else r[0]), library.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in _rows())
    found = sorted(tokens.token_files(docs, path, 2, block_ids=500).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((r[0] for r in _rows()), key=lambda d: (d is not None, d or 0))
    assert sorted(((-1 if r.doc_id is None else r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in found) == expected
    start = 0
    for r in found:
        assert (r.start, r.n_tokens) == (start, len(r.ids) // 4)
        start += r.n_tokens
    assert tokens.token_files(none, path, 2).count() == 0


def test_damaged_block_is_found():
    block = bytearray(tokens._block([np.array([1, 2, 3]), np.array([], int)]))
    assert [d.tolist() for d in tokens._documents(bytes(block), np.arange(9))] == [[1, 2, 3], []]
    block[-1] ^= 1
    with pytest.raises(ValueError):
        tokens._documents(bytes(block), np.arange(9))


def test_chunks_keep_the_librarys_ids():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    texts = ["a.. b!? C:; d. .e", "ÀÉ. Œ! ß? ×. x×.", "don't I'M 's", "é ́x ΑΣ ΣΑ İ I\u0307", "\x1c a\x85b\xa0c", "<|endoftext|> hi", "12.5, 3.", "\0 a\0b"]
    for text, ids in zip(texts, tokens.load(path).encode(texts)):
        assert np.frombuffer(ids, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    k = 3
    transition = rng.normal(size=(k, k)).astype("f4")
    for n in (1, 2, 5):
        emission = rng.normal(size=(n, k)).astype("f4")
        by_word, by_pair = np.zeros((n, k)), np.zeros((k, k))
        for path in product(range(k), repeat=n):
            for s in range(k):
                w = np.exp(transition[s, path[0]] + sum(emission[i, y] for i, y in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:])))
                for i, y in enumerate(path):
                    by_word[i, y] += w
                for a, b in zip(path, path[1:]):
                    by_pair[a, b] += w
        found, pairs = posteriors(emission, np.array([0, n]), transition, pairs=True)
        z = by_word[0].sum()
        assert np.allclose(found, by_word / z, atol=1e-5) and np.allclose(pairs, by_pair / z, atol=1e-5)


def test_long_chains_are_not_changed_by_their_blocks():
    rng = np.random.default_rng(1)
    emission, transition = rng.normal(size=(300, 4)).astype("f4") * 2, rng.normal(size=(4, 4)).astype("f4")
    forward, backward, state = [], [], np.ones(4) / 4
    for e in emission:
        state = (state @ np.exp(transition)) * np.exp(e)
        state /= state.sum()
        forward.append(state)
    state = np.ones(4) / 4
    for e in emission[::-1]:
        backward.append(state)
        state = np.exp(transition) @ (np.exp(e) * state)
        state /= state.sum()
    expected = np.array(forward) * np.array(backward[::-1])
    found, _ = posteriors(np.concatenate([emission[:9], emission]), np.array([0, 9, 9, 309]), transition)
    assert np.allclose(found[9:], expected / expected.sum(1, keepdims=True), atol=1e-4)


def test_language_edge_cases(docs, none, spark):
    model = language.train(docs, max_chars=10_000)
    found = {r.text: r for r in language.identify(docs, model).collect()}
    assert model.labels == ["de", "en"]
    for text in (None, "", "  \n\t", "¿? 123"):
        assert (found[text].lang_pred, found[text].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in found.values()) and found[LONG].lang_pred in ("de", "en")
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.where("score = 0.5").count() > 0 and kept.where("text IS NULL").count() == 0
    unlearned = language.train(none)
    assert {(r.lang_pred, r.score) for r in language.identify(docs, unlearned).collect()} == {("und", 0.0)}
    held = spark.createDataFrame([(i,) for i in range(50)], "doc_id int").withColumn("h", language.held_out()).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs.where(~language.held_out()))
    judged = language.identify(docs.where(language.held_out()), model)
    assert judged.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95
