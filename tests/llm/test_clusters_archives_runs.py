import base64
import hashlib
import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.llm import centroid_clustering, periodic_runs, warc

# ---- centroid clustering


def plain_clusters(rows, k=8, rounds=10, dims=64, seed=3):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes().hex().upper()))[:k]
    centroids = [c for _, c in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    got = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {j: sum(d for _, c, d in got if c == j) for j in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, j, d in got]


def vectors():
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(0, 0.1, 64) + 0.2 * (i % 5 == 0)).astype(np.float32).tolist()) for i in range(120)]
    return [
        *rows, (7, rows[3][1]), (200, rows[3][1]), (None, rows[4][1]), (300, None), (301, []), (302, rows[0][1][:63]), (303, [*rows[0][1], 0.5]),
        (304, [None, *rows[0][1][1:]]), (305, [float("nan"), *rows[0][1][1:]]), (306, [float("inf"), *rows[0][1][1:]]), (307, [0.0] * 64), (308, [-0.1] * 64),
    ]


def test_clusters_equal_plain_rounds(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, cluster string, n_exact int")
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got = [(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroid_clustering.cluster(df).collect()]
    assert sorted(got, key=key) == sorted(plain_clusters(rows), key=key)


def test_few_vectors_and_none(spark):
    three = [(i, np.full(64, 0.1 * i).tolist()) for i in range(3)]
    got = centroid_clustering.cluster(spark.createDataFrame(three, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.distance) for r in got) == [(0, 0), (1, 0), (2, 0)] and len({r.cluster for r in got}) == 3
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroid_clustering.cluster(empty).collect() == []
    huge = spark.createDataFrame([(1, [1e30] * 64), (2, [1.0] * 64)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in centroid_clustering.cluster(huge).collect()] == [2]


def test_empty_centroids_stay_and_ties_take_the_first():
    x = np.array([[0, 0], [4, 0]], np.int64)
    centroids = np.array([[2, 0], [2, 0], [99, 99]], np.int64)
    code, shift, rest = centroid_clustering.compressed(x)
    short = centroid_clustering.Short(np.ldexp(code.astype(float), shift[:, None].astype(int)), rest.astype(float), (x.astype(float) ** 2).sum(1))
    best, distance, n = centroid_clustering.nearest(x, short, centroids)
    assert best.tolist() == [0, 0] and distance.tolist() == [4, 4] and n.max() <= 2


@pytest.mark.parametrize("size", [3, 300, 1 << 20, 1 << 27])
def test_screening_changes_nothing_and_saves_work(size):
    rng = np.random.default_rng(size)
    x, c = rng.integers(-size, size + 1, (500, 64)), rng.integers(-size, size + 1, (8, 64))
    x[:100] = c[rng.integers(0, 8, 100)] + rng.integers(-1, 2, (100, 64))
    x = np.clip(x, -(1 << 27), 1 << 27)
    code, shift, rest = centroid_clustering.compressed(x)
    assert (np.abs((x - (code.astype(np.int64) << shift[:, None].astype(np.int64)))) <= 1 << np.maximum(shift, 1)[:, None].astype(int) - 1).all()
    short = centroid_clustering.Short(np.ldexp(code.astype(float), shift[:, None].astype(int)), rest.astype(float), (x.astype(float) ** 2).sum(1))
    best, distance, n = centroid_clustering.nearest(x, short, c)
    true = ((x[:, None, :] - c[None, :, :]) ** 2).sum(2)
    assert (best == true.argmin(1)).all() and (distance == true.min(1)).all()
    assert size < 300 or n.mean() < 4


# ---- WARC


def archive(n=40, plain=False):
    rng = np.random.default_rng(9)
    parts = []
    for i in range(n):
        payload = bytes(rng.integers(32, 127, int(rng.integers(0, 3000)), dtype=np.uint8))
        one = warc.page_record(f"<urn:{i}>", i, f"http://h/{i}", hashlib.sha1(payload).hexdigest(), len(payload), payload)
        parts.append(one if plain else warc.member(one))
    return parts


def read(data):
    return list(warc.salvage(io.BytesIO(data), len(data)))


def covers(found, size):
    """Records' members and gaps follow each other from 0 to the end."""
    at = 0
    for kind, offset, length, _ in found:
        if kind == "gap" or offset >= at:
            assert offset == at
            at = offset + length
    return at == size


@pytest.mark.parametrize("plain", [False, True])
def test_whole_archives_have_no_gaps(plain):
    parts = archive(plain=plain)
    found = read(b"".join(parts))
    assert [x[0] for x in found] == ["record"] * 40 and covers(found, sum(map(len, parts)))
    assert [int(x[3].fields["page-id"]) for x in found] == list(range(40))


@pytest.mark.parametrize("plain", [False, True])
def test_salvage_recovers_all_but_the_damaged(plain):
    """A flipped byte, a cut, junk between records and a torn end: every other record is read, and the gaps say where."""
    parts, rng = archive(plain=plain), np.random.default_rng(3)
    for trial in range(30):
        mine, lost = list(parts), set()
        for i in rng.choice(40, 4, replace=False).tolist():
            p, kind = mine[i], int(rng.integers(0, 4))
            at = int(rng.integers(1, len(p) - 1))
            if kind == 0:
                mine[i] = p[:at] + bytes([p[at] ^ 0x55]) + p[at + 1 :]
                lost.add(i)
            elif kind == 1:
                mine[i] = p[:at]
                lost.add(i)
            elif kind == 2:
                mine[i] = bytes(rng.integers(0, 256, 50, dtype=np.uint8)) + p
            else:
                mine[i] = warc.MAGIC + b"junk" + warc.VERSION + p
        if trial % 2:
            mine[39] = mine[39][: len(mine[39]) // 2]
            lost.add(39)
        data = b"".join(mine)
        found = read(data)
        got = [int(x[3].fields["page-id"]) for x in found if x[0] == "record"]
        # A flipped bit of a gzip header's unchecked fields, or of a plain header outside the block, may leave a record readable.
        assert set(range(40)) - lost <= set(got) and len(got) == len(set(got)) and covers(found, len(data))
        for kind, *_, one in found:
            if kind == "record" and one.fields["warc-type"] == "response":
                assert one.fields["warc-block-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(one.block).digest()).decode()


def test_reader_takes_odd_files():
    assert read(b"") == []
    assert read(b"no archive")[0][:3] == ("gap", 0, 10)
    big = warc.record("response", "<urn:1>", [("Content-Type", "x")], b"WARC/1.0\r\n" * 400_000)
    found = read(big + warc.member(big) + b"\x00" * 10)
    assert [x[0] for x in found] == ["record", "record", "gap"]
    both = warc.member(big[:0] + warc.record("metadata", "<urn:2>", [], b"a") + warc.record("metadata", "<urn:3>", [], b""))
    assert [x[3].fields["warc-record-id"] for x in read(both)] == ["<urn:2>", "<urn:3>"]
    liar = warc.record("response", "<urn:4>", [], b"x" * 50).replace(b"Content-Length: 50", b"Content-Length: 9999999")
    assert [x[0] for x in read(liar + warc.record("metadata", "<urn:5>", [], b""))] == ["gap", "record"]


PAGES = [
    (1, "u1", "a" * 1200), (2, "u2", "a" * 1200), (3, "u3", "short"), (4, "u4", "short"), (5, None, None), (None, "u", "a" * 1200), (7, "u7", "é" * 600), (7, "u7", "é" * 600), (7, "u8", "é" * 600),
    (6, "x y\r\nWARC-Type: evil", "é" * 600), (9, "z", "b" * 2000), (9, "z", "b" * 2000), (10, "q", ""), (None, None, None), (None, None, "c" * 1000), (None, None, "c" * 1000), (11, "r", "d" * 999), (12, "r", "d" * 999),
    (13, "http://long/", "x" * 3_000_000),
]


def test_pages_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, payload string")
    got = sorted(map(tuple, warc.archive_and_read(pages.repartition(3)).collect()), key=str)
    want = []
    for html in {p[2] or "" for p in PAGES}:
        data = html.encode()
        ids = sorted((p[0] for p in PAGES if (p[2] or "") == html), key=lambda i: (i is not None, i or 0))
        for k, i in enumerate(ids):
            again = len(data) >= 1000 and k < len(ids) - 1
            want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", ids[-1] if again else None))
    assert got == sorted(want, key=str)
    assert warc.archive_and_read(pages.where("false")).collect() == []


def test_archives_hold_payloads_and_survive_damage(spark, tmp_path):
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), F.repeat(F.concat(F.lit("page "), "id", F.lit(" é ")), 80).alias("html"))
    manifest = warc.write_archives(pages.repartition(2), f"file://{tmp_path}/w", archive_bytes=4000)
    files = [r.path for r in manifest.collect()]
    assert len(files) > 4
    rows = warc.read_archives(manifest).where("type = 'response'")
    assert rows.join(pages, "page_id").where(F.col("payload") == F.col("html").cast("binary")).count() == 300
    (tmp_path / "w/archives/left-behind.warc.gz").write_bytes(warc.member(b"of a lost attempt"))
    hurt = files[0].removeprefix("file://")
    data = bytearray(open(hurt, "rb").read())
    data[len(data) // 2] ^= 0xFF
    open(hurt, "wb").write(bytes(data))
    again = warc.read_archives(warc.read_manifest(spark, f"file://{tmp_path}/w"))
    gaps = again.where("kind = 'gap'").collect()
    assert 1 <= len(gaps) <= 2 and gaps[0].path == files[0] and gaps[0].reason
    assert again.where("type = 'response'").count() >= 299
    with pytest.raises(Exception, match="bytes"):
        warc.read_archives(manifest, strict=True).count()


def test_many_copies_of_one_page(spark, monkeypatch):
    monkeypatch.setattr(warc, "COPIES", 16)
    pages = spark.range(500).select(F.lit(7).alias("page_id"), F.lit("u").alias("url"), F.lit("z" * 1500).alias("html"))
    got = {tuple(r): r["count"] for r in warc.archive_and_read(pages).groupBy("record_type", "refers_to").count().collect()}
    assert sorted(got.values()) == [1, 499]


# ---- periodic runs


def plain_runs(a, least=6, times=4):
    found, n = set(), len(a)
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and a[j] == a[j + p]:
                j += 1
            s, e = i, j + p
            if j > i and e - s >= max(least, times * p) and not any(all(a[x] == a[x + q] for x in range(s, e - q)) for q in range(1, p)):
                found.add((s, e - s, p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_equal_plain_search():
    rng = np.random.default_rng(1)
    for trial in range(700):
        n, kinds = int(rng.integers(0, 150)), int(rng.integers(1, 5))
        a = rng.integers(0, kinds, n)
        for _ in range(int(rng.integers(0, 4)) if n > 5 else 0):
            s = int(rng.integers(0, n))
            p, e = 1 + int(rng.integers(0, max(1, (n - s) // 3))), int(rng.integers(s, n + 1))
            for i in range(s, e):
                a[i] = a[s + (i - s) % p]
        times = 3 + trial % 3
        assert periodic_runs.find_runs(a, 6, times) == plain_runs(a.tolist(), 6, times)
    with pytest.raises(ValueError):
        periodic_runs.find_runs(np.zeros(9, int), 6, 2)


def test_long_and_frequent_words():
    assert periodic_runs.find_runs(np.zeros(300_000, np.int32)) == [(0, 300_000, 1)]
    a = np.tile(np.array([0] * 6 + [1]), 3000)
    assert len(periodic_runs.find_runs(a)) == 3001
    b = np.arange(100_000)
    b[50_000:] = b[50_000 + np.arange(50_000) % 12_000]
    assert periodic_runs.find_runs(b) == [(50_000, 50_000, 12_000)]


def plain_row(doc_id, text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = sorted(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))[:1]
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_rows_equal_plain_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["a", "b", "é", "no break"], int(rng.integers(0, 90))))) for i in range(150)]
    rows += [(1, "a " * 40), (1, "a " * 40), (None, "x y " * 10), (900, None), (901, ""), (902, " \t\x0b\n"), (903, "one"), (904, "a\x1cb " * 8), (905, " ".join("abc") + " z" * 7)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_runs int")
    got = sorted(map(tuple, periodic_runs.digests(df).collect()), key=str)
    assert got == sorted((plain_row(*r) for r in rows), key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and r[1] for r in got if (i := r[0]) is not None)
    assert periodic_runs.digests(df.where("false")).collect() == []


def test_spans_and_texts(spark):
    df = spark.createDataFrame([(1, "start la la la la la la end"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.detect(df).collect()}
    assert got == {1: ([(1, 6, 1)], "start la end"), 2: ([], "")}
