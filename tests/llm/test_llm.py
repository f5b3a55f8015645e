import collections
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from topicloom.llm import common, decontamination, jaccard_join, language_id, packing, quality, substring_dedup, token_counts, token_store, topk_search, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i}" for i in range(300))
ROWS = [
    (1, LONG, "en", "a", 1), (2, LONG + " extra", "en", "a", 1), (3, "", "fr", "a", 0), (4, None, None, None, None), (None, "Some text without id", "en", None, None),
    (5, "one two", "en", "b", 7), (6, "ONE two", "en", "b", 7), (7, "x" * 30000, "en", "b", 30000), (1, LONG, "en", "a", 1), (8, "été où", "fr", "b", 6), (9, "\t \n", "en", "b", 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def encoded(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def test_token_counts_are_those_of_a_unigram_model(docs, nothing):
    pieces = token_counts.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    known = Tokenizer(Unigram([("<unk>", 0.0), *pieces.items(), *((f"<0x{b:02X}>", -1e6) for b in range(256))], 0, True))
    count = lambda text: sum(len(known.encode("▁" + w.decode()).ids) for w in (text or "").encode().split())
    got = {(r.doc_id, r.n_words): r.n_tokens for r in token_counts.count_tokens(docs).collect() if r.doc_id != 7}
    for doc_id, text, *_ in ROWS:
        if doc_id != 7:
            assert got[doc_id, len((text or "").encode().split())] == count(text)
    assert token_counts.count_tokens(nothing).count() == 0


def test_counts_of_a_few_pieces():
    counts = token_counts.TerminalCounts({"▁": -1.0, "a": -2.0, "ab": -2.5, "▁a": -2.2, "b": -3.0})
    counts.insert({b"ab", "é".encode()})
    assert counts[b"ab"] == 2 and counts["é".encode()] == 3  # the mark, and two bytes


def test_trie_against_plain_segmentation(monkeypatch):
    rng = np.random.default_rng(11)
    pieces = {"▁": -1.5} | {"".join(rng.choice(list("abcé"), n)): -float(rng.integers(1, 9)) for n in (1, 1, 2, 2, 3, 3, 4, 5) for _ in range(4)}
    monkeypatch.setattr(token_counts, "KEPT_WORDS", 200)
    monkeypatch.setattr(token_counts, "TRIE_WORDS", 50)
    counts = token_counts.TerminalCounts(pieces)
    for _ in range(6):
        words = {"".join(rng.choice(list("abcéd😀"), rng.integers(1, 90))) for _ in range(150)}
        counts.insert({w.encode() for w in words})
        assert len(counts) <= 200
        for w in words:
            assert (w.encode() in counts) == (len(w) < token_counts.STORED_CHARS)
            assert counts[w.encode()] == counts.alone("▁" + w)
    nothing = token_counts.TerminalCounts({})
    nothing.insert({b"ab"})
    assert nothing[b"ab"] == nothing.alone("▁ab") == 5


def test_store_round_trip(spark, docs, nothing, tmp_path):
    out = token_store.write_store(docs, f"file://{tmp_path}/store")
    enc = encoded("byte_bpe_50k.json")
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for doc_id, text, *_ in order:
        ids = enc(text)
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_store.read_index(spark, out).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_store.read_documents(spark, out, [5])[5] == enc("one two").tolist()
    assert token_store.encode_and_index(nothing).count() == 0


def test_packing_places_each_id_once(spark, docs, nothing):
    """Rows with one doc_id, or none, can't be told apart in the result; their pieces are told by doc_tokens."""
    enc, rng = encoded("word_bpe_49k.json"), np.random.default_rng(17)
    more = [(1, "one id, another text", "en", "a", 1), (None, None, "en", "a", 1)] + [(50 + i, " ".join(rng.choice(["alpha", "beta", "gamma"], rng.integers(1, 60))), "en", "b", 9) for i in range(200)]
    given = docs.unionByName(spark.createDataFrame(more, SCHEMA).withColumn("n_chars", F.lit(0).cast("long")))
    for parts_of in (given.coalesce(1), given.repartition(3)):
        rows = packing.pack(parts_of.withColumn("sequence_id", F.lit("clash")).withColumn("length", F.lit(3)), capacity=64).collect()
        got, want = {}, {}
        for r in rows:
            got.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
        for doc_id, text, *_ in [*ROWS, *more]:
            ids = enc(text)
            want.setdefault((doc_id, len(ids)), []).append(ids)
        assert set(got) == set(want)
        for key, arrays in want.items():
            assert sum(n for _, n, _ in got[key]) == key[1] * len(arrays)
            for start, n, crc in got[key]:
                assert crc in [zlib.crc32(ids[start : start + n].tobytes()) for ids in arrays]
            if len(arrays) == 1:
                ends = [(0, 0), *sorted((s, s + n) for s, n, _ in got[key])]
                assert all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
        sizes = {}
        for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == sizes.get(r.sequence_id, 0)
            sizes[r.sequence_id] = r.offset + r.length
        assert all(n == 64 or n & (n - 1) == 0 for n in sizes.values())
    assert packing.pack(nothing).count() == 0


def test_window_count_rises_whenever_capacity_is_exceeded():
    assert len(packing.fit([3000] * 10, 4096)) == 10
    rng = np.random.default_rng(18)
    for low, high in ((1, 400), (1500, 4096), (2049, 4096)):
        sizes = rng.integers(low, high, 120).tolist()
        windows = packing.fit(sizes, 4096)
        assert sorted(i for w in windows for i in w) == list(range(120)) and max(sum(sizes[i] for i in w) for w in windows) <= 4096
        assert len(windows) >= -(-sum(sizes) // 4096)


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(1).integers(1, 1000, 200).tolist()
    windows = packing.differencing(sizes, 10)
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert sorted(i for w in windows for i in w) == list(range(200)) and max(sums) - min(sums) < 20


def test_passages_are_found(spark, nothing):
    rng = np.random.default_rng(2)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 10**9, n)]
    shared = words(60)
    fuzzy = [*shared]
    fuzzy[30] = "changed"
    rows = [(1, " ".join(words(100) + shared + words(100))), (2, " ".join(words(50) + fuzzy + words(80))), (3, " ".join(words(200))), (4, None), (None, " ".join(shared))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.repeats(docs).collect()
    assert len(got) == 1 and {got[0].doc_id, got[0].match_doc_id} == {1, 2} and 59 <= got[0].end_word - got[0].start_word <= 62
    cut = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs).collect()}
    assert sum("changed" in (t or "") or " ".join(shared) in (t or "") for i, t in cut.items() if i) == 1 and cut[3] == rows[2][1] and cut[4] is None
    copies = spark.createDataFrame([(5, LONG), (6, LONG)], "doc_id long, text string")
    assert [(r.doc_id, r.match_doc_id) for r in substring_dedup.repeats(copies).collect()] == [(6, 5)]
    assert substring_dedup.repeats(nothing).count() == 0


@pytest.mark.parametrize("gap", [40, 70, 100])
def test_passages_on_both_sides_of_a_gap_are_found(spark, gap):
    rng = np.random.default_rng(gap)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 10**9, n)]
    one, two = words(60), words(60)
    rows = [(1, " ".join(words(90) + one + words(gap) + two + words(70))), (2, " ".join(words(30) + one + words(gap) + two + words(50)))]
    got = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 2 and len({r.doc_id for r in got}) == 1 and all(r.identity == 1 for r in got)
    at = 90 if got[0].doc_id == 1 else 30
    assert sorted((r.start_word, r.end_word) for r in got) == [(at, at + 60), (at + 60 + gap, at + 120 + gap)]


def test_chains_are_cut_only_where_they_agree_too_little():
    a, b = [f"a{i}" for i in range(400)], [f"b{i}" for i in range(400)]
    for start, end in ((50, 110), (120, 180), (240, 300), (340, 348)):  # 10 words differ, then 60, then 40
        b[start:end] = a[start:end]
    chain = np.array([(i, i) for start, end in ((50, 110), (120, 180), (240, 300), (340, 348)) for i in range(start, end - 7, 4)])
    got = substring_dedup.judged(a, dict(enumerate(b)), chain)
    assert [g[:4] for g in got] == [(50, 180, 50, 180), (240, 300, 240, 300)] and got[0][4] == 120 / 130


@pytest.mark.parametrize("others", [1, 20])
def test_passages_whose_parts_lie_in_other_documents_are_found(spark, others):
    rng = np.random.default_rng(others)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 10**9, n)]
    rows, spots, n = [], {}, 0
    for _ in range(12):
        shared = words(60)
        texts = [words(50) + shared + words(70), words(90) + shared + words(30)]
        texts += [words(60) + part + words(60) for part in (shared[:30], shared[30:]) for _ in range(others)]
        for k, text in enumerate(texts):
            if k < 2:
                spots[n] = ((50, 90)[k], n - k)
            rows.append((n, " ".join(text)))
            n += 1
    got = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 12 and len({spots[r.doc_id][1] for r in got}) == 12 and all(r.identity == 1 for r in got)
    for r in got:
        at, match_at = spots[r.doc_id][0], spots[r.match_doc_id][0]
        assert spots[r.doc_id][1] == spots[r.match_doc_id][1] and (r.start_word, r.end_word, r.match_start, r.match_end) == (at, at + 60, match_at, match_at + 60)


def test_every_shared_window_is_reported_for_all_but_one(spark):
    rng = np.random.default_rng(9)
    lines = [[f"l{k}_{i}" for i in range(int(rng.integers(8, 20)))] for k in range(12)]
    texts = [[w for k in rng.integers(0, 12, 14) for w in lines[k]] for _ in range(25)]
    spans = {i: [] for i in range(25)}
    for r in substring_dedup.repeats(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect():
        spans[r.doc_id].append((r.start_word, r.end_word))
    holders = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - 39):
            holders.setdefault(tuple(t[k : k + 40]), {}).setdefault(i, []).append(k)
    shared = [h for h in holders.values() if len(h) > 1]
    held = [sum(all(any(a <= x < b for a, b in spans[i]) for k in at for x in range(k, k + 40)) for i, at in h.items()) for h in shared]
    assert shared and all(n >= len(h) - 1 for n, h in zip(held, shared, strict=True))


def test_chains_rise_on_both_sides():
    assert substring_dedup.chains([(0, 10), (8, 18), (16, 5), (20, 30)])[0] == [(0, 10), (8, 18), (20, 30)]
    assert substring_dedup.common_words(list("abcd"), list("axcd")) == 3


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(0, 0.2, (400, 8)).astype(np.float32)
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(400, None), (420, [float("nan")] * 8), (440, [])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in topk_search.top_k(e, shard_rows=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    m = np.floor(64 * points.astype(float)).astype(int)
    for q in range(0, 400, 20):
        s = m @ m[q]
        order = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:20]
        assert got[q] == [(i, s[i]) for i in order]
    assert set(got) == set(range(0, 400, 20))
    assert topk_search.top_k(e.where("vec_id > 1000")).count() == 0


def test_topk_with_equal_vectors_and_clusters(spark):
    """A third of the vectors are equal (one region, many shards, ties), others lie far apart, some are of another length."""
    rng = np.random.default_rng(3)
    points = np.concatenate([np.ones((100, 4)), np.repeat(np.eye(4) * 8, 50, axis=0) + rng.normal(0, 0.2, (200, 4))]).astype("f4")
    order = rng.permutation(300)
    rows = [(int(i), [float(x) for x in points[j]]) for i, j in enumerate(order)] + [(1000 + i, [float(i), 1.0]) for i in range(30)]
    rows += [(40, [float("inf")] * 4), (41, None), (None, [1.0] * 4), rows[60]]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", F.lit(1).alias("shard"), F.lit(2).alias("point")).repartition(5)
    got, expected = sorted(map(tuple, topk_search.top_k(e, k=7, shard_rows=16).collect())), []
    for own in (rows[:300] + rows[-1:], rows[300:330]):  # an id of the first length comes twice, and is a query
        ids, m = np.array([r[0] for r in own]), np.floor(64 * np.array([r[1] for r in own])).astype(int)
        for i in np.flatnonzero(ids % 20 == 0):
            s = m @ m[i]
            expected += [(ids[i], n + 1, ids[j], s[j]) for n, j in enumerate([j for j in np.lexsort((ids, -s)) if j != i][:7])]
    assert got == sorted(expected) and len([r for r in got if r[0] == 60]) == 14


def test_topk_of_an_id_that_many_rows_share(spark):
    """Most rows have one id, a query's: each is a candidate of the others, in many shards."""
    rng = np.random.default_rng(8)
    m = rng.integers(-64, 64, (300, 3))
    ids = np.where(np.arange(300) < 200, 20, np.arange(300))
    e = spark.createDataFrame([(int(i), [float(x) / 64 for x in v]) for i, v in zip(ids, m, strict=True)], "vec_id long, embedding array<double>").repartition(4)
    expected = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = m @ m[i]
        expected += [(ids[i], n + 1, ids[j], s[j]) for n, j in enumerate([j for j in np.lexsort((ids, -s)) if j != i][:5])]
    assert sorted(map(tuple, topk_search.top_k(e, k=5, shard_rows=32).collect())) == sorted(expected)


def test_components_against_brute_force(spark, docs, nothing):
    rng = np.random.default_rng(4)
    rows, n = [(r[0], r[1]) for r in ROWS if r[0] not in (None, 1)] + [(1, LONG)], 100
    for _ in range(12):
        base = [f"v{i}" for i in rng.integers(0, 200, 60)]
        for _ in range(6):
            copy = [*base]
            for i in rng.integers(0, 60, rng.integers(0, 3)):
                copy[i] = f"e{rng.integers(0, 10**6)}"
            rows.append((n, " ".join(copy)))
            n += 1
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                up[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    all_rows = jaccard_join.components(docs).collect()
    assert len(all_rows) == len(ROWS) and [r.component_id for r in all_rows if r.doc_id is None] == [None]
    assert jaccard_join.components(nothing).count() == 0


def test_frequent_hashes_are_resolved_alike(spark):
    """Seeds and shingles of many classes, in packs of several tasks: frequent ones give what others give."""
    rng, common = np.random.default_rng(8), [f"c{i}" for i in range(60)]
    texts = [" ".join([*(f"r{i}" for i in rng.integers(0, 10**6, 30)), *common[: rng.integers(30, 60)], *(["same"] * rng.integers(0, 40)), *common[rng.integers(0, 30) :]]) for _ in range(60)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:9])], "doc_id long, text string").repartition(6)
    for f in (jaccard_join.shared_prefixes, substring_dedup.matches):
        plain, split = (sorted(map(tuple, f(rows, 7, least=n).collect())) for n in (10**9, 3))
        assert plain and plain == split


def test_components_of_long_chains(spark):
    rng = np.random.default_rng(12)
    names = rng.permutation(3000).tolist()
    paths = [names[:1000], names[1000:1200], sorted(names[1200:1600]), names[1600:1603], names[1603:1605]]
    edges = [(a, b) for p in paths for a, b in zip(p, p[1:], strict=False)] + [(names[2000], n) for n in names[2001:2100]] + [(5, 5), (None, 1), (2, None)]
    want = {n: min(p) for p in [*paths, names[2000:2100]] for n in p}
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefix_tree_against_sets():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 40))).astype(np.uint64) for _ in range(200)]
    tree = jaccard_join.PrefixTree(sets)
    for probe in sets[:60]:
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, probe)) >= 75 * len(np.union1d(s, probe))]
        assert sorted(tree.linked(probe)) == want


def test_language(spark, docs, nothing):
    rng, rows = np.random.default_rng(6), []
    for i in range(200):
        lang = "ab"[i % 2]
        rows.append((i, " ".join("".join(rng.choice(list("aeiou" if lang == "a" else "xyzkw"), 5)) for _ in range(20)), lang))
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.lang_pred == rows[r.doc_id][2] for r in held) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    mixed = {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()}
    assert mixed[3] == mixed[4] == mixed[9] == "und"
    assert language_id.identify(nothing).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).where("1 = 0").unionByName(docs.selectExpr("doc_id", "text", "cast(null as string) lang", "source", "n_chars"))).collect()} == {"und"}


def test_languages_of_other_scripts_against_a_plain_cosine(spark):
    from itertools import pairwise

    rng, rows = np.random.default_rng(16), []
    scripts = {"el": "αβγδεζηθικλμνξο", "ru": "абвгдежзийклмно", "uk": "абвгдежзиіїєґно", "zh": "".join(chr(0x4E00 + 7 * i) for i in range(15)), "ja": "".join(chr(0x4E00 + 7 * i) for i in range(8, 23)), "en": "abcdefghijklmno"}
    for i in range(300):
        lang = list(scripts)[i % 6]
        rows.append((i, " ".join("".join(rng.choice(list(scripts[lang]), rng.integers(2, 7))) for _ in range(40)) + (" 123 😀" if i % 5 else ""), lang))

    def counted(text):
        letters = [0, *(ord(c) if c.isalpha() else 0 for c in text.lower()), 0]
        letters = [letters[0], *(b for a, b in pairwise(letters) if a or b)]
        out = {}
        for three in zip(letters, letters[1:], letters[2:], strict=False):
            out[three] = out.get(three, 0) + 1
        return out

    def vector(counts):
        total = np.zeros(language_id.DIMENSIONS)
        for (a, b, c), n in counts.items():
            va, vb, vc = (language_id.Letters()[x].astype(float) for x in (a, b, c))
            total += n * np.roll(va, 2) * np.roll(vb, 1) * vc
        return total

    unit = lambda v: v / np.linalg.norm(v)
    plain = {i: vector(counted(t)) for i, t, _ in rows}
    names = sorted(scripts)
    protos = np.array([unit(sum(plain[i] for i, _, lang in rows if lang == name and zlib.crc32(str(i).encode()) % 5)) for name in names])
    axis = unit(protos.mean(0))
    own = np.array([unit(p - (p @ axis) * axis) for p in protos])
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, _, lang in rows:
        v = plain[i] - (plain[i] @ axis) * axis
        cosines = own @ unit(v)
        assert got[i].lang_pred == names[int(np.argmax(cosines))] and abs(got[i].score - max(0.0, cosines.max())) < 1e-4
    held = [i for i, _, _ in rows if got[i].held_out]
    assert np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.9


def test_quality_orders_grades(spark, docs, nothing):
    rng, rows, labels = np.random.default_rng(7), [], []
    for i in range(300):
        grade = i % 3
        words = [f"n{k}" for k in rng.integers(0, 50, 30)] + [["vile", "poor", "fine"][grade]] * 2
        rows.append((i, " ".join(rng.permutation(words))))
        labels.append((i, int(grade == 2), int(grade == 0)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(d, lab).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.selected == (r.doc_id % 3 == 2) for r in held]) > 0.9
    assert quality.classify(nothing, lab).count() == 0
    assert all(r.selected for r in quality.classify(docs, lab.where("1 = 0")).collect())


def test_quality_gradient_and_scores_are_those_of_the_plain_model(spark):
    rng = np.random.default_rng(19)
    n, m = 40, 7
    doc, at, grades = rng.integers(0, n, 150), rng.integers(0, m, 150), rng.integers(0, 3, n)
    w, t = rng.normal(0, 0.3, m), np.array([-0.4, 0.7])

    def plain(x):
        total = 0.0
        for i in range(n):
            z = sum(x[a] for d, a in zip(doc, at, strict=True) if d == i)
            tails = [1.0, *(1 / (1 + np.exp(c - z)) for c in x[m:]), 0.0]
            total += np.log(tails[grades[i]] - tails[grades[i] + 1])
        return total / n - quality.DECAY / 2 * sum(v * v for v in x[:m])

    x = np.concatenate([w, t])
    value, gradient = quality.likelihood(w, t, doc, at, grades)
    steps = np.eye(m + 2) * 1e-5
    assert abs(value - plain(x)) < 1e-9 and np.allclose(gradient, [(plain(x + s) - plain(x - s)) / 2e-5 for s in steps], atol=1e-6)
    weights = rng.normal(0, 1, quality.PLACES).astype(np.float32)
    rows = quality.score(spark.createDataFrame([(1, "A b b. c"), (2, None), (None, "")], "doc_id long, text string"), (weights, t)).collect()
    for r, text in zip(rows, ("A b b. c", None, ""), strict=True):
        z = float(weights[quality.features(text)].sum())
        tails = [1 / (1 + np.exp(c - z)) for c in t]
        assert np.allclose([r.expected_grade, r.p_tail, r.p_not_lowest], [sum(tails), tails[1], tails[0]], atol=1e-5) and r.selected == (tails[1] >= quality.SELECT)


def test_quality_learns_from_each_labelled_id_once(spark):
    d = spark.createDataFrame([(1, "good words")] * 50 + [(1, "other words"), (2, "bad words"), (3, "bad text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (3, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.training_rows(d, labels).select("doc_id").distinct().count() <= 3
    assert quality.score(d, quality.learn(d, labels)).count() == 53


def test_hits_against_brute_force(spark, docs, nothing):
    rng = np.random.default_rng(8)
    vocab = [f"t{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab, n))) for i, n in enumerate((12, 25, 10, 3, 1, 40))] + [(7, None), (8, "..."), (None, "t1 t2")]
    texts = []
    for i in range(40):
        w = list(rng.choice(vocab, 60))
        if i % 2:
            src = items[i % 6][1].split()
            w[20 : 20 + len(src)] = src
        texts.append((i, " ".join(w).upper() if i % 3 else ", ".join(w)))
    d = spark.createDataFrame(texts + [(100, None), (None, items[0][1]), (0, texts[0][1])], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    import hashlib
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    for rows in (decontamination.find_hits(d, b).collect(),):
        assert len(rows) == 43
        got = {r.doc_id: r for r in rows}
        for i, t in texts:
            w, hit, names = split(t), set(), set()
            for item, it in items:
                iw = split(it)
                if item is None or not iw:
                    continue
                n = min(10, len(iw))
                windows = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)}
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in windows:
                        hit |= set(range(k, k + n))
                        names.add(str(item))
            r = got[i]
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(names), bool(hit))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        assert got[None].n_hit == 12 or got[None].contaminated
    assert decontamination.find_hits(nothing, b).count() == 0
    assert not any(r.contaminated for r in decontamination.find_hits(docs, b.where("1 = 0")).collect())


def test_shuffled_fingerprints_give_the_same(spark, monkeypatch):
    d = spark.createDataFrame([(i, " ".join(f"q{k}" for k in range(i, i + 30))) for i in range(20)], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(f"q{k}" for k in range(5, 20)))], "item_id long, text string")
    first = sorted(map(tuple, decontamination.find_hits(d, b).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_LIMIT", 0)
    assert sorted(map(tuple, decontamination.find_hits(d, b).collect())) == first and any(r[-1] for r in first)


def test_urls(spark):
    rows = [(1, "http://a.example.net/en/1?x"), (2, "HTTP://EXAMPLE.COM/de/2"), (3, "https://x.org/fr/3#y"), (4, None), (5, "no url"), (6, "http://notexample.net/en/"), (7, "http://host.io/p/9"), (None, "http://b.net")]
    rows += [(100 + i, f"http://bad.site/spam/{i}") for i in range(30)] + [(200 + i, f"http://bad.site/good/{i + 50}") for i in range(30)]
    labels = [(i, 0, 1) for i in range(30)] + [(i + 50, 1, 0) for i in range(30)] + [(None, 1, 0)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == len(rows)
    want = {1: ("a.example.net", "/en/1", "example.net/en/", "allow"), 2: ("example.com", "/de/2", "example.com/de/", "block"), 3: ("x.org", "/fr/3", "org/fr/", "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("notexample.net", "/en/", "net/", "block"), None: ("b.net", "", None, "allow")}
    for i, w in want.items():
        assert tuple(got[i][c] for c in ("host", "path", "rule", "verdict")) == w
    assert got[105].verdict == "block" and got[205].verdict == "allow"


def plain_purities(urls):
    """The template tree of (host, path, good or None) recomputed row by row: {(host, path): (template, purity)}."""
    def support(host, prefix, depth):
        return [u for u in urls if u[0] == host and way[u][:depth] == prefix]

    parts = {u: [s for s in re.sub("[0-9]+", "#", u[1]).split("/") if s] for u in urls}
    way = {u: [] for u in urls}
    for depth in range(max(map(len, parts.values()))):
        now = {u: (u[0], tuple(way[u]), parts[u][depth]) for u in urls if len(parts[u]) > depth and way[u][-1:] != ["**"]}
        n = collections.Counter(now.values())
        small = collections.Counter(k[:2] for k in now.values() if n[k] < 5)
        for u, k in now.items():
            way[u].append(k[2] if n[k] >= 5 else "*")
            if n[k] < 5 and small[k[:2]] < 5 and len(parts[u]) > depth + 1:
                way[u].append("**")
    tree = collections.defaultdict(list)
    for u in urls:
        for d in range(len(way[u]) + 1):
            tree[u[0], tuple(way[u][:d])] += [] if u[2] is None else [u[2]]
    known = [u[2] for u in urls if u[2] is not None]
    anchor = {}
    for u in urls:
        anchor[u] = ()
        for d in range(1, len(way[u]) + 1):
            own, above = tree[u[0], tuple(way[u][:d])], tree[u[0], tuple(way[u][: d - 1])]
            p = np.mean(above) if above else 0
            if len(own) >= 5 and abs(np.mean(own) - p) > 1.96 * np.sqrt(p * (1 - p) / len(own)):
                anchor[u] = tuple(way[u][:d])
    out = {}
    for u in urls:
        host = tree[u[0], ()]
        hp = (sum(host) + 4 * np.mean(known)) / (len(host) + 4)
        own = [v[2] for v in urls if v[0] == u[0] and anchor[v] == anchor[u] and v[2] is not None]
        out[u[:2]] = "".join("/" + s for s in way[u]), (sum(own) + 4 * hp) / (len(own) + 4) if host else None
    return out


def test_template_tree_against_plain_recomputation(spark):
    """Planted branches: /ads and /x/spam are bad on one host, inner and leaf nodes; all else is good but for some noise."""
    rng, urls, labels = np.random.default_rng(5), [], []
    for i in range(500):
        host = f"h{i % 3}.io"
        path = [f"/ads/{'ab'[i % 2]}/{i}", f"/x/spam/{i}", f"/x/news/{i}", f"/u/name{i}x/page{i}", f"/deep/a/b/c/d/e/f/g/h/{i}", f"/rare{'abcdefgh'[i % 8]}{i % 50}/k/{i}", f"/q{i}"][rng.integers(7)]
        bad = host == "h1.io" and path.startswith(("/ads", "/x/spam"))
        good = None if i % 4 == 0 else float(rng.random() < (0.05 if bad else 0.9))
        urls.append((host, path, good))
        if good is not None:
            labels.append((i, int(good), 0))
    pages = spark.createDataFrame([(i, f"http://{u[0]}{u[1]}") for i, u in enumerate(urls)], "page_id long, url string")
    got = {(r.host, r.path): r for r in url_filter.judge(pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    ids = {(u[0], u[1]): re.search("([0-9]+)[^0-9/]*/?$", u[1]) for u in urls}
    assert all(int(m.group(1)) == i for i, m in enumerate(ids.values()) if m)
    want = plain_purities(urls)
    assert len(got) == len(want) == 500
    for key, (template, purity) in want.items():
        assert got[key].template == template and got[key].purity == pytest.approx(purity)
    planted = [u[:2] for u in urls if u[0] == "h1.io" and u[1].startswith(("/ads", "/x/spam"))]
    assert {k for k, r in got.items() if r.verdict == "block"} == set(planted)


NAMES = (
    "row", "document", "kept", "words", "n_words", "hash", "items", "item_id", "item_ids", "windows", "__row", "__id", "__text", "spans", "start", "end", "cls", "rep", "rep_id", "owner", "lang_pred", "held_out", "score",
    "contaminated", "n_hit", "n_items", "component_id", "n_shingles", "label", "node", "sequence_id", "length", "offset", "at", "h", "n", "p", "m", "last", "changed", "near", "first", "span", "a.b", "has space", "key", "bucket", "grade", "places",
)


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empty and very long texts, ties, repeated ids with equal and other texts, and columns with the operators' own names."""
    rng = np.random.default_rng(21)
    long = " ".join(f"z{i}" for i in rng.integers(0, 10**6, 140_000))
    rows = [*ROWS, (1, "one id, another text of a few words", "en", "a", 1), (None, None, None, None, None), (None, "Some text without id", "en", None, None), (30, long, "en", "c", len(long)), (31, long + " tail", "en", "c", 9), (32, "y" * 1_000_000, "en", "c", 9)]
    rows += [(40, LONG[: len(LONG) // 2], "en", "d", 3), (40, "short", "en", "d", 5), (40, "a b " * 200, "en", "d", 5)]
    return spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)])


def test_stages_take_hard_rows(spark, hard, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    hard.write.parquet(f"{tmp_path}/hard")
    for first in (spark.read.parquet(f"{tmp_path}/hard"), spark.read.parquet(f"{tmp_path}/hard").where("1 = 0")):
        now, empty = first, first.isEmpty()
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            alone = stage(spark, first, str(tmp_path))  # each stage on all rows
            assert k == 4 or alone.schema.simpleString() == first.schema.simpleString()
            assert (alone.count() == 0) == empty
            stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{empty}{k}")
            now = spark.read.parquet(f"{tmp_path}/{empty}{k}")
            if not empty and k < 4:
                texts = {(r.doc_id, r.text) for r in now.collect()}
                assert (1, "one id, another text of a few words") in texts and (40, "short") in texts and (None, "Some text without id") in texts
                assert k < 1 or now.where("doc_id is null and text is not null").count() == 1
                assert k < 1 or (2, LONG + " extra") not in texts and (1, LONG) in texts


def test_operators_take_hard_rows(spark, hard, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (40, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").select("*", *[F.lit(1).alias(n) for n in ("grade", "text", "places", "good")])
    items = spark.createDataFrame([(1, LONG), (2, None), (None, "one two")], "item_id long, text string").select("*", *[F.lit(1).alias(n) for n in NAMES if n != "item_id"])
    n = hard.count()
    assert token_counts.count_tokens(hard).count() == n and token_store.encode_and_index(hard).count() == n and jaccard_join.components(hard).count() == n
    assert language_id.identify(hard).count() == n and quality.classify(hard, labels).count() == n and decontamination.find_hits(hard, items).count() == n
    assert packing.pack(hard).where("start = 0").count() == n
    found = substring_dedup.repeats(hard).collect()
    assert {r.doc_id for r in found} & {30, 31} and all(r.doc_id is not None for r in found)
    kinds = [nothing.select("*", *[F.lit(i).alias(c) for i, c in enumerate(NAMES)])]
    for empty in kinds:
        assert quality.classify(empty, labels).count() == decontamination.find_hits(empty, items).count() == substring_dedup.without_repeats(empty).count() == 0
    vectors = spark.createDataFrame([(20, [1.0, 2.0]), (20, [0.5, 2.0]), (None, [1.0, 1.0]), (21, [float("inf"), 1.0]), (22, [1.0, 2.0]), (23, [1.0, 2.0]), (24, [1.0]), (25, None), (26, [None, 1.0])], "vec_id long, embedding array<double>")
    vectors = vectors.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("dim", "shard", "rank", "score", "point", "ids", "query_id", "cell", "near"))])
    assert sorted((r.rank, r.vec_id) for r in topk_search.top_k(vectors).collect() if r.query_id == 20) == [(1, 20), (1, 22), (2, 22), (2, 23), (3, 20), (3, 23)]
    pages = spark.createDataFrame([(1, "http://a.org/x/" + "deep/" * 3000 + "9"), (1, None), (None, "http://b.com"), (2, ""), (3, "http://A.B.example.com/de/x" + "y" * 300_000)], "page_id long, url string")
    pages = pages.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("host", "path", "rule", "template", "good", "purity", "verdict", "__id", "__rest", "depth", "parts"))])
    assert url_filter.judge(pages, labels).count() == 5 and url_filter.judge(pages.where("1 = 0"), labels).count() == 0


def test_pipeline_keeps_columns(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        now = spark.read.parquet(f"{tmp_path}/out{k}")
        if k < 4:
            assert now.columns == docs.columns
    assert {r.doc_id for r in now.select("doc_id").distinct().collect()} >= {1, 5, 7, 8}
