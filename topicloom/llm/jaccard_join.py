"""Operator 5, n-gram Jaccard join: prefix trees over globally ordered shingle sets; exact.

A document's set holds the hashes of its distinct 5-word shingles (fewer words: the whole sequence as one; no words: no
set, no links). Documents with equal sets are one class. Two classes link when 100 * shared >= 75 * union.

1. Prefixes. If x and y link, they share at least ceil(0.75 n) shingles, so of the smallest p = n - ceil(0.75 n) + l
   hashes of each they share l or more. l grows with n (SLACK). Only these go through the shuffle, packed in arrays for
   each bucket of hashes, which gives every hash its number of classes.
2. Survivors. A class links with nothing unless l of its prefix occur elsewhere. Of those the l - 1 most frequent are
   dropped: by counting, the rarest common one is still there in both of any two that link.
3. Stars. For each kept hash the class with the most frequent prefix leads; each class is compared with the leader it
   meets most often. This joins a large group of near copies by comparisons as many as its members.
4. Rest. Hashes whose classes, of like size, still lie in several components are open. Classes with open hashes of
   which three quarters of the whole set lie in other components go on. Those that open hashes tie together are a
   family, in which classes of different components are compared, in blocks; a family of more than FAMILY_BLOCKS blocks
   is compared hash by hash instead.

Comparisons run in prefix trees: the sets of a group, ordered by their hashes' frequency in it, make a tree whose nodes
hold runs of hashes. A probe walks the tree level by level, overlaps of shared runs being counted once, and leaves
subtrees in which no set can reach the needed overlap with the hashes that remain. Found links within a group are kept
as a spanning forest; components come from min-label propagation, links of both kinds together.

n_shingles is the set's size and component_id the smallest doc_id reachable. Rows with one doc_id are one node. A null
doc_id takes no part in linking (component_id null); a null text has 0 shingles. Every row gives one row; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FREQUENT, ascii_lower_words, by_group, connected_components, frequent, likely, materialize, slices

WORDS, SHARE, SLACK = 5, 0.75, 0.1
#: Hash buckets: at least this many, and one for each so many documents; prefix hashes that a task packs at a time.
BUCKETS, BUCKET_DOCS, PACKED = 1024, 30_000, 750_000
#: Members of a star or block that are compared in one tree; families of more blocks are compared hash by hash.
BLOCK, FAMILY_BLOCKS = 2048, 16
_P = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    found = ascii_lower_words(text)
    if not found:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, found)), dtype=np.uint64)
    n = max(1, len(h) - words + 1)
    width = min(words, len(h))
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total = total * _P + h[k : k + n]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    return np.unique(total)


def set_key(hashes: np.ndarray) -> int:
    """A signed 64-bit key of a whole set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes()))))


def least_overlap(n):
    """ceil(0.75 n): a set of n shares as many with any set it links with."""
    return (3 * n + 3) // 4


def slack(n):
    return (n * 10) // 100  # SLACK of n, in whole numbers


def prefix_length(n):
    return np.minimum(n, n - least_overlap(n) + 1 + slack(n))


def sure_common(n):
    """Prefix hashes that any linked set surely shares: its own l may be that of the smallest set that links."""
    return slack(least_overlap(n)) + 1


def needed(a, b):
    """Smallest overlap at which sets of a and b link: 100 i >= 75 (a + b - i)."""
    return -(-3 * (a + b) // 7)


def classes(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, cls) of every row; cls is null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            sets = [shingle_set(t) for t in some.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())], names=["doc_id", "n_shingles", "cls"])

    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, cls long")


def _pack(hashes: np.ndarray, owners: np.ndarray) -> bytes:
    """Distinct hashes, how many owners each has, and the owners: a hash with many owners is written once."""
    own, counts = np.unique(hashes, return_counts=True)
    return len(own).to_bytes(8, "little") + own.tobytes() + counts.astype("<u4").tobytes() + owners.tobytes()


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(raw[:8], "little")
    own, counts = np.frombuffer(raw, "<u8", n, 8), np.frombuffer(raw, "<u4", n, 8 + 8 * n)
    return np.repeat(own, counts), np.frombuffer(raw, "<i8", -1, 8 + 12 * n)


def shared_prefixes(documents: DataFrame, buckets: int, least: int = FREQUENT) -> DataFrame:
    """(cls, hash, df) for prefix hashes of two or more classes; hash as signed.

    Hashes are dealt into buckets. One that has `least` entries in a pack is frequent: those entries go to groups by their
    owners instead, and a note to its bucket, which then leaves the hash's other entries unresolved as well (df 0). Spark
    counts unresolved ones by partial sums, so that no task holds a hash of very many classes.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, owners, held = [], [], 0

        def flush():
            h, o = _distinct(np.concatenate(hashes), np.concatenate(owners))
            much = frequent(h, least)
            place = (h % np.uint64(buckets)).astype(np.int64)
            rows = {k: [_pack(*r), b""] for k, r in by_group(place[~much], h[~much], o[~much]).items()}
            for k, (own,) in by_group(place[much], h[much]).items():
                rows.setdefault(k, [_pack(own[:0], o[:0]), b""])[1] = np.unique(own).tobytes()
            rows |= {-1 - k: [_pack(*r), b""] for k, r in by_group((o[much].view(np.uint64) % np.uint64(buckets)).astype(np.int64), h[much], o[much]).items()}
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), *(pa.array([r[i] for r in rows.values()], pa.binary()) for i in (0, 1))], names=["bucket", "packed", "frequent"])

        for some in slices(batches):
            for text in some.column(0).to_pylist():
                s = shingle_set(text)
                if not len(s):
                    continue
                p = int(prefix_length(len(s)))
                hashes.append(s[:p])
                owners.append(np.full(p, set_key(s), np.int64))
                held += p
            if held >= PACKED:
                yield from flush()
                hashes, owners, held = [], [], 0
        if held:
            yield from flush()

    def share(key, rows):
        import pandas as pd

        parts = [_unpack(bytes(x)) for x in rows["packed"]]
        h, o = _distinct(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        _, at, counts = np.unique(h, return_inverse=True, return_counts=True)
        df = counts[at].astype(np.int64)
        unresolved = np.isin(h, np.frombuffer(b"".join(map(bytes, rows["frequent"])), "<u8")) | (key[0] < 0)
        df[unresolved] = 0
        keep = (df > 1) | unresolved
        return pd.DataFrame({"cls": o[keep], "hash": h[keep].view(np.int64), "df": df[keep]})

    packed = documents.where("doc_id is not null and text is not null").select("text").mapInArrow(emit, "bucket long, packed binary, frequent binary")
    found = materialize(packed.groupBy("bucket").applyInPandas(share, "cls long, hash long, df long"), "prefixes")
    unresolved = found.where("df = 0").select("cls", "hash").distinct()
    counted = unresolved.join(unresolved.groupBy("hash").agg(F.count("*").alias("df")), "hash").where("df > 1")
    return found.where("df > 0").unionByName(counted.select("cls", "hash", "df"))


def _distinct(h: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((o, h))
    h, o = h[order], o[order]
    new = np.concatenate([np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (o[1:] != o[:-1])])
    return h[new], o[new]


def survivors(shared: DataFrame, class_sizes: DataFrame) -> DataFrame:
    """(cls, rep, n, weight, hashes): classes that may link, with the prefix hashes by which they must be found.

    A class has as many rows in shared as its prefix is long at most; they come together in one row.
    """

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            out = []
            lists = some.column(3)
            for cls, rep, n, found in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(2).to_pylist(), lists, strict=True):
                rows = found.values
                h, df = rows.field("hash").to_numpy(), rows.field("df").to_numpy()
                sure = int(sure_common(n))
                if len(h) >= sure:
                    order = np.lexsort((h, df))[: len(h) - sure + 1]
                    out.append({"cls": cls, "rep": rep, "n": n, "weight": float(df.sum() / prefix_length(n)), "hashes": h[order].tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=SURVIVOR)

    lists = shared.groupBy("cls").agg(F.collect_list(F.struct("hash", "df")).alias("found"))
    return lists.join(class_sizes, "cls").select("cls", "rep", "n", "found").mapInArrow(choose, "cls long, rep long, n long, weight double, hashes array<long>")


SURVIVOR = pa.schema([("cls", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("weight", pa.float64()), ("hashes", pa.list_(pa.int64()))])


class PrefixTree:
    """A compressed trie over sets, each ordered by falling frequency in the group, then by hash.

    Node i is the run flat[first[i]:last[i]] of dense hash numbers, at depth[i]; member[i] lists the sets that end there,
    and low[i], high[i] are the smallest and largest set sizes below.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.hashes, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(self.hashes), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(self.hashes))
        self.rank, rows, start = rank, [], 0
        for s in sets:
            rows.append(np.sort(rank[at[start : start + len(s)]]).astype(">u4"))
            start += len(s)
        order = sorted(range(len(rows)), key=lambda i: rows[i].tobytes())
        flat, self.first, self.last, self.depth, self.parent, self.member = [], [], [], [], [], []
        size, stack, before = 0, [], None  # stack: nodes from the root to the last set's end

        def node(run: np.ndarray, depth: int, parent: int) -> int:
            nonlocal size
            flat.append(run)
            for to, x in ((self.first, size), (self.last, size + len(run)), (self.depth, depth), (self.parent, parent), (self.member, [])):
                to.append(x)
            size += len(run)
            return len(self.first) - 1

        for i in order:
            row = rows[i]
            common = 0
            if before is not None:
                m = min(len(before), len(row))
                differ = np.flatnonzero(before[:m] != row[:m])
                common = int(differ[0]) if len(differ) else m
            while stack and self.depth[stack[-1]] >= common:
                stack.pop()
            if stack:
                top = stack[-1]
                length = self.last[top] - self.first[top]
                cut = common - self.depth[top]
                if cut < length:  # split the run: the upper part stays, the lower part with its members and children goes below it
                    below = self._split(top, cut)
                    for child in range(len(self.parent)):
                        if self.parent[child] == top and child != below:
                            self.parent[child] = below
            if common < len(row):
                stack.append(node(row[common:], common, stack[-1] if stack else -1))
            self.member[stack[-1]].append(i)
            before = row
        self.flat = np.concatenate(flat).astype(np.int64) if flat else np.zeros(0, np.int64)
        self._finish()

    def _split(self, top: int, cut: int) -> int:
        """The run of node top ends after cut hashes; the rest becomes a new node."""
        at = self.first[top] + cut
        for to, x in ((self.first, at), (self.last, self.last[top]), (self.depth, self.depth[top] + cut), (self.parent, top), (self.member, self.member[top])):
            to.append(x)
        self.last[top], self.member[top] = at, []
        return len(self.first) - 1

    def _finish(self) -> None:
        count = len(self.first)
        self.first, self.last, self.depth, self.parent = (np.array(x, dtype=np.int64) for x in (self.first, self.last, self.depth, self.parent))
        self.low, self.high = np.full(count, 1 << 40), np.zeros(count, np.int64)
        for i in np.argsort(-self.depth, kind="stable").tolist():
            for m in self.member[i]:
                self.low[i], self.high[i] = min(self.low[i], self.sizes[m]), max(self.high[i], self.sizes[m])
            if self.parent[i] >= 0:
                p = self.parent[i]
                self.low[p], self.high[p] = min(self.low[p], self.low[i]), max(self.high[p], self.high[i])
        order = np.argsort(self.parent, kind="stable")
        self.children, self.child_at = order, np.searchsorted(self.parent[order], np.arange(-1, count + 1))

    def _below(self, nodes: np.ndarray) -> np.ndarray:
        a, b = self.child_at[nodes + 1], self.child_at[nodes + 2]
        total = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(total)[:-1]]), total) + np.arange(total.sum())
        return self.children[at]

    def linked(self, probe: np.ndarray) -> list[int]:
        """Members whose sets link with the probe's set of hashes."""
        at = np.searchsorted(self.hashes, probe)
        at = np.minimum(at, len(self.hashes) - 1)
        mine = np.sort(self.rank[at[self.hashes[at] == probe]])
        inside = np.zeros(len(self.hashes), np.int64)
        inside[mine] = 1
        n, found = len(probe), []
        overlap = np.zeros(len(self.first), np.int64)
        nodes = self._below(np.array([-1]))
        while len(nodes):
            a, length = self.first[nodes], self.last[nodes] - self.first[nodes]
            starts = np.concatenate([[0], np.cumsum(length)[:-1]])
            got = np.add.reduceat(inside[self.flat[np.repeat(a - starts, length) + np.arange(length.sum())]], starts)
            up = self.parent[nodes]
            overlap[nodes] = got + np.where(up >= 0, overlap[up], 0)
            end = self.depth[nodes] + length
            rest = len(mine) - np.searchsorted(mine, self.flat[self.last[nodes] - 1], side="right")
            best = np.clip(end + rest, self.low[nodes], self.high[nodes])  # the size below at which a link is easiest
            alive = overlap[nodes] + np.minimum(best - end, rest) >= needed(n, best)
            nodes = nodes[alive]
            for i in nodes.tolist():
                for m in self.member[i]:
                    if overlap[i] >= needed(n, self.sizes[m]):
                        found.append(m)
            nodes = self._below(nodes)
        return found


def group_links(nodes: list[int], components: list, sets: list[np.ndarray], probes: list[int], theirs: list, wanted: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between the probes and a group's members, of different components, as a spanning forest."""
    up: dict = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    tree, out = PrefixTree(sets), []
    for node, component, hashes in zip(probes, theirs, wanted, strict=True):
        for j in tree.linked(hashes):
            a, b = find(component), find(components[j])
            if a != b:
                up[max(a, b)] = min(a, b)
                out.append((node, nodes[j]))
    return out


def _members(rows) -> list[np.ndarray]:
    return [np.frombuffer(bytes(s), "<u8") for s in rows["hashes"]]


def _compare_stars(rows):
    """rows: leader (bool), rep, hashes for one part of a star."""
    import pandas as pd

    out = []
    for _, star in rows.groupby("star", sort=False):
        lead, rest = star[star["leader"]], star[~star["leader"]]
        if len(lead) and len(rest):
            out += group_links(rest["rep"].tolist(), list(range(len(rest))), _members(rest), lead["rep"].tolist(), [-1] * len(lead), _members(lead))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _compare_block(rows):
    """One block with itself, or the later of two with the earlier; a component alone in a block needs no search."""
    import pandas as pd

    out = []
    for _, block in rows.groupby("block", sort=False):
        if block["component"].nunique() < 2:
            continue
        tree, probes = block[block["in_tree"]], block[block["probes"]]
        if len(tree) and len(probes):
            if tree["in_tree"].all() and tree["probes"].all():  # the commonest component's members are found by the others
                probes = probes[probes["component"] != probes["component"].mode().iloc[0]]
            out += group_links(tree["rep"].tolist(), tree["component"].tolist(), _members(tree), probes["rep"].tolist(), probes["component"].tolist(), _members(probes))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def full_sets(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """(cls, rep, hashes) with the whole sets of the chosen classes, read from their representatives' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            sets = [shingle_set(t) for t in some.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "cls", "hashes"])

    texts = documents.selectExpr("cast(doc_id as long) rep", "text").where("rep is not null and text is not null")
    sets = likely(texts, "rep", chosen.select("rep"), run, "rep long, cls long, hashes binary")
    return sets.join(chosen.select("cls", "rep"), ["cls", "rep"], "left_semi").dropDuplicates(["cls"]).select("cls", "rep", "hashes")


def star_links(chosen: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of each class with the leader it meets most often."""
    rows = chosen.select("cls", "rep", "weight", F.explode("hashes").alias("hash"))
    leaders = materialize(rows.groupBy("hash").agg(F.max(F.struct("weight", "cls")).getField("cls").alias("star")), "star-leaders")
    met = rows.join(leaders, "hash").where("cls <> star").groupBy("cls", "star").agg(F.count("*").alias("n"))
    best = materialize(met.groupBy("cls").agg(F.max(F.struct("n", "star")).getField("star").alias("star")), "stars")
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    sizes = materialize(best.groupBy("star").agg(F.count("*").alias("size")).withColumn("parts", parts).drop("size"), "star-sizes")
    members = best.join(sizes, "star").select("cls", "star", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("leader"))
    leads = sizes.select(F.col("star").alias("cls"), "star", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("leader"))
    total = max(64, sizes.agg(F.sum("parts")).head()[0] or 0)
    tasks = members.unionByName(leads).join(sets, "cls").select(F.pmod(F.xxhash64("star", "part"), F.lit(max(64, total // 16))).alias("task"), F.struct("star", "part").cast("string").alias("star"), "leader", "rep", "hashes")
    return tasks.groupBy("task").applyInPandas(_compare_stars, "a long, b long")


def open_groups(rows: DataFrame) -> DataFrame:
    """(hash, band, blocks): kept hashes with classes of several components among sizes that can link at all.

    Sizes that link differ by a third at most, hence by one band; band b stands for the bands b and b + 1. Of several
    hashes with the same classes one is enough.
    """
    own = F.xxhash64("cls")
    lists = rows.groupBy("hash", "band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"), F.bit_xor(own).alias("x"), F.sum(own.cast("decimal(38,0)")).alias("s"))
    one = lists.where("low <> high").groupBy("band", "size", "x", "s").agg(F.min("hash").alias("hash"))
    return materialize(one.select("hash", "band", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "open-hashes")


def shared_elsewhere(members: DataFrame, buckets: int) -> DataFrame:
    """cls of the members that share 0.75 of their whole sets with other components; members: cls, component, hashes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, 1024):
            sets = [np.frombuffer(x, "<u8") for x in some.column(2).to_pylist()]
            sizes = [len(x) for x in sets]
            h, cls, comp = np.concatenate(sets), np.repeat(some.column(0).to_numpy(), sizes), np.repeat(some.column(1).to_numpy(), sizes)
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((cls, bucket))
            h, cls, comp, bucket = h[order], cls[order], comp[order], bucket[order]
            at, first = np.unique(bucket, return_index=True)
            rows = [h[a:b].tobytes() + cls[a:b].tobytes() + comp[a:b].tobytes() for a, b in zip(first, [*first[1:], len(h)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(rows, pa.binary())], names=["bucket", "packed"])

    def count(rows):
        import pandas as pd

        parts = [np.frombuffer(bytes(x), "<i8").reshape(3, -1) for x in rows["packed"]]
        h, cls, comp = np.concatenate(parts, axis=1)
        order = np.lexsort((comp, h))
        h, cls, comp = h[order], cls[order], comp[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        last = np.concatenate([first[1:], [len(h)]]) - 1
        several = np.repeat(comp[first] != comp[last], last - first + 1)
        found, n = np.unique(cls[several], return_counts=True)
        return pd.DataFrame({"cls": found, "n": n.astype(np.int64)})

    packed = members.select("cls", "component", "hashes").mapInArrow(emit, "bucket long, packed binary")
    counts = packed.groupBy("bucket").applyInPandas(count, "cls long, n long").groupBy("cls").agg(F.sum("n").alias("elsewhere"))
    return members.select("cls", F.expr("cast(length(hashes) / 8 as long)").alias("n")).join(counts, "cls").where("4 * elsewhere >= 3 * n").select("cls")


def rest_links(chosen: DataFrame, sets: DataFrame, components: DataFrame, buckets: int) -> DataFrame:
    """Links between different components that share a kept hash."""
    band = F.floor(F.log("n") / F.lit(float(np.log(1.34)))).cast("int")
    rows = chosen.select("cls", "rep", F.explode(F.array(band, band - 1)).alias("band"), "hashes").select("cls", "rep", "band", F.explode("hashes").alias("hash"))
    rows = rows.join(components.withColumnRenamed("node", "rep"), "rep", "left").select("cls", "rep", "hash", "band", F.coalesce("component", "rep").alias("component"))
    rows = materialize(rows, "kept-hashes")
    blocks = open_groups(rows)
    # Only classes of which three quarters lie in other components can link with one there.
    left = rows.join(blocks, ["hash", "band"]).select("cls", "component").distinct()
    stay = materialize(shared_elsewhere(left.join(sets.select("cls", "hashes"), "cls"), buckets), "shared-elsewhere")
    rows = materialize(rows.join(stay, "cls", "left_semi"), "kept-hashes")
    blocks = open_groups(rows)
    met = materialize(rows.join(blocks, ["hash", "band"]).select("hash", "band", "cls", "rep", "component"), "met")
    first = materialize(met.groupBy("hash", "band").agg(F.min("rep").alias("b")), "met-first")
    family = connected_components(met.join(first, ["hash", "band"]).select(F.col("rep").alias("a"), "b"))
    met = met.join(family.select(F.col("node").alias("rep"), F.col("component").alias("family")), "rep")
    sizes = materialize(met.select("family", "cls").distinct().groupBy("family").agg(F.count("*").alias("size")), "families")
    one = F.col("size") <= FAMILY_BLOCKS * BLOCK
    keyed = met.join(sizes, "family").select("cls", "component", F.when(one, F.concat_ws(",", F.lit("f"), "family")).otherwise(F.concat_ws(",", "hash", "band")).alias("key")).distinct()
    counts = materialize(keyed.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "key-blocks")
    placed = keyed.join(counts, "key").withColumn("i", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    # A block meets itself and each later one, whose members then look for partners in it.
    sent = placed.select("cls", "component", "key", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    sent = sent.select("cls", "component", F.concat_ws(",", "key", F.least("i", "j"), F.greatest("i", "j")).alias("block"), (F.col("i") <= F.col("j")).alias("in_tree"), (F.col("i") >= F.col("j")).alias("probes"))
    total = max(64, (counts.agg(F.sum(F.expr("cast(blocks as long) * (blocks + 1) / 2"))).head()[0] or 0) // 4)
    tasks = sent.join(sets, "cls").select(F.pmod(F.xxhash64("block"), F.lit(int(total))).alias("task"), "block", "rep", "cls", "component", "in_tree", "probes", "hashes")
    return tasks.groupBy("task").applyInPandas(_compare_block, "a long, b long")


def components(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    spark = documents.sparkSession
    rows = materialize(classes(documents), "classes")
    usable = rows.where("doc_id is not null and cls is not null")
    by_class = materialize(usable.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")), "class-sizes")
    buckets = max(BUCKETS, documents.count() // BUCKET_DOCS)
    chosen = materialize(survivors(shared_prefixes(documents, buckets), by_class), "survivors")
    sets = materialize(full_sets(documents, chosen), "shingle-sets")
    stars = materialize(star_links(chosen, sets), "star-links")
    # Rows of one doc_id are one node: their classes are tied to it.
    ties = usable.groupBy("doc_id").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high").select("doc_id")
    same = usable.join(ties, "doc_id", "left_semi").join(by_class, "cls").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    links = materialize(stars.unionByName(same), "links")
    rest = materialize(rest_links(chosen, sets, connected_components(links), buckets // 4), "rest-links")
    labels = connected_components(links.unionByName(rest)) if rest.limit(1).count() else connected_components(links)
    of_class = by_class.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("cls", F.coalesce("component", "rep").alias("component_id"))
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.join(of_class, "cls", "left").select("doc_id", "n_shingles", alone.alias("component_id"))


ORACLE_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
p as (select doc_id, w, unnest(range(1, greatest(len(w) - 5 + 1, 1) + 1)) s from w where len(w) > 0),
g as (select distinct doc_id, array_to_string(w[s : s + 4], ' ') k from p),
n as (select doc_id, count(*) n from g group by doc_id),
pair as (select a.doc_id a, b.doc_id b, count(*) i from g a join g b on a.k = b.k and a.doc_id < b.doc_id group by all),
link as (select a, b from pair join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 75 * (x.n + y.n - i)),
both_ways as (select a, b from link union all select b, a from link),
reach as (select doc_id a, doc_id b from documents union select r.a, l.b from reach r join both_ways l on r.b = l.a)
select d.doc_id, coalesce(n.n, 0) n_shingles, (select min(b) from reach where a = d.doc_id) component_id from documents d left join n using (doc_id)
"""
