"""Operator 9, benchmark decontamination by winnowing; DataFrame functions only.

Words are runs of digits, a-z (A-Z lower-cased first) and characters beyond ASCII. An item's windows are its runs of
SPAN = 10 words; an item of fewer words is one window. Winnowing keeps, of each run of SPAN - GRAM + 1 consecutive hashes
of GRAM = 5 words, the smallest. Whether it is kept depends on nothing outside the window, so every window that a
document shares with an item has a fingerprint in both: none is missed. Fingerprints join on their hash, and each match
is extended by comparing the words around it; windows of which all words agree count. Items of fewer than ten words are
matched by the hash of all their words, for the lengths that occur.

The items' fingerprints set a bitmap, which goes along with the plan (two bits for each, BITS at most). A document's
hashes are looked up there first, so that only the few found, and kept by winnowing, become rows and carry the words
around them; they join the items' fingerprints, of which those with equal words around are one row with all their items.
At most BROADCAST_LIMIT of these rows are broadcast; more are joined by a shuffle, to which documents without matches are
dealt by row, and whose hot hashes Spark's skew join splits.

A null or wordless text has no words: no hits, and items_sha256 of the empty text. A null item_id or a wordless item
matches nothing. Every input row gives one row, also repeated ones and null ids; an empty benchmark hits nothing; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, named

GRAM, SPAN, BROADCAST_LIMIT, BITS = 5, 10, 8192, 1 << 23
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str = "text") -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), _BETWEEN), "")


def _starts(n: Column, length: int) -> Column:
    """1 .. n - length + 1, or nothing."""
    return F.when(n >= length, F.sequence(F.lit(1), n - length + 1)).otherwise(F.array().cast("array<int>"))


def _grams(length: int) -> Column:
    return F.transform(_starts(F.col("n_words"), length), lambda i: F.xxhash64(F.slice("words", i, F.lit(length))))


def _kept(hashes: str, width: int, may_match: Callable[[Column], Column]) -> Column:
    """Positions of hashes that may match and are the smallest of some run of width hashes."""
    m = F.size(hashes)

    def smallest(i: Column) -> Column:
        own = F.element_at(hashes, i)
        return F.exists(F.sequence(F.greatest(i - (width - 1), F.lit(1)), F.least(i, m - (width - 1))), lambda s: F.array_min(F.slice(hashes, s, F.lit(width))) == own)

    def keep(i: Column) -> Column:
        found = may_match(F.element_at(hashes, i))
        return found & smallest(i) if width > 1 else found

    return F.when(m >= width, F.filter(F.sequence(F.lit(1), m), keep)).otherwise(F.array().cast("array<int>"))


def _all(_: Column) -> Column:
    return F.lit(True)


def _bitmap(hashes: DataFrame, n: int) -> Callable[[Column], Column]:
    """A test that all of the n hashes pass, and few others: both bits of a hash are set in a bitmap of 64-bit words."""
    bits = min(BITS, 1 << max(10, (32 * n - 1).bit_length()))

    def places(h: Column) -> tuple[Column, Column]:
        return h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))

    both = hashes.select(F.explode(F.array(*places(F.col("hash")))).alias("p"))
    words = both.groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("w")).collect()  # BITS / 64 at most
    filled = [0] * (bits // 64)
    for r in words:
        filled[r["at"]] = r["w"]
    table = F.split(F.lit(",".join(map(str, filled))), ",").cast("array<bigint>")  # folded to one literal

    def test(h: Column) -> Column:
        one, two = (F.getbit(F.element_at(table, F.shiftright(p, 6).cast("int") + 1), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in places(h))
        return one & two

    return test


def _marks(hashes: str, kept: Column, gram: int, span: int) -> Column:
    """For each kept position: its hash, and the words that any window over it can reach, with the first one's place."""

    def mark(p: Column) -> Column:
        first = F.greatest(p - (span - gram), F.lit(1))
        return F.struct(F.element_at(hashes, p).alias("hash"), F.lit(span).alias("span"), p.alias("at"), first.alias("first"), F.slice("words", first, p + span - first).alias("near"))

    return F.transform(kept, mark)


def item_fingerprints(benchmark: DataFrame) -> DataFrame:
    """(item_id, hash, span, at, first, near)."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), words().alias("words")).withColumn("n_words", F.size("words"))
    long = items.where(F.col("n_words") >= SPAN).withColumn("h", _grams(GRAM))
    long = long.select("item_id", F.explode(_marks("h", _kept("h", SPAN - GRAM + 1, _all), GRAM, SPAN)).alias("m"))
    short = items.where((F.col("n_words") > 0) & (F.col("n_words") < SPAN))
    mark = F.struct(F.xxhash64("words").alias("hash"), F.col("n_words").alias("span"), F.lit(1).alias("at"), F.lit(1).alias("first"), F.col("words").alias("near"))
    return long.unionByName(short.select("item_id", mark.alias("m"))).select("item_id", "m.*").distinct()


def find_hits(documents: DataFrame, benchmark: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns named in keep, then n_words, n_hit, n_items, items_sha256, contaminated: one row for each document."""
    near = materialize(item_fingerprints(benchmark), "item-fingerprints").groupBy("hash", "span", "at", "first", "near").agg(F.collect_set("item_id").alias("item_ids"))
    prints = materialize(near, "fingerprints")
    sizes = prints.groupBy("span").agg(F.count("*").alias("n")).collect()  # ten rows at most
    small = sum(r.n for r in sizes) <= BROADCAST_LIMIT
    docs = documents.select(F.struct(*map(named, keep or ["doc_id"])).alias("kept"), F.monotonically_increasing_id().alias("row"), words().alias("words")).withColumn("n_words", F.size("words"))
    marks = []
    for span, n in sorted((r.span, r.n) for r in sizes):
        gram, h = GRAM if span == SPAN else span, f"h{span}"
        docs = docs.withColumn(h, _grams(gram))
        marks.append(_marks(h, _kept(h, span - gram + 1, _bitmap(prints.where(F.col("span") == span).select("hash"), n)), gram, span))
    empty = F.array().cast("array<struct<hash:bigint,span:int,at:int,first:int,near:array<string>>>")
    rows = docs.select("row", "kept", "n_words", F.explode_outer(F.concat(*marks) if marks else empty).alias("d")).select("row", "kept", "n_words", "d.*")
    rows = rows.withColumn("hash", F.coalesce("hash", F.xxhash64("row")))  # rows without a mark have no span, so they match nothing
    theirs = prints.select("item_ids", "hash", "span", F.col("at").alias("item_at"), F.col("first").alias("item_first"), F.col("near").alias("item_near"))
    rows = rows.join(F.broadcast(theirs) if small else theirs, ["hash", "span"], "left")

    def same(j: Column) -> Column:
        """Whether the window that begins j words before the match is whole and equal in both."""
        mine = F.slice("near", F.greatest(F.col("at") - j - F.col("first") + 1, F.lit(1)), F.col("span"))
        other = F.slice("item_near", F.greatest(F.col("item_at") - j - F.col("item_first") + 1, F.lit(1)), F.col("span"))
        return (F.col("at") - j >= 1) & (F.col("item_at") - j >= 1) & (F.size(mine) == F.col("span")) & (mine == other)

    reach = F.sequence(F.lit(0), F.when(F.col("span") == SPAN, SPAN - GRAM).otherwise(0))
    windows = F.when(F.col("item_ids").isNotNull(), F.transform(F.filter(reach, same), lambda j: F.struct((F.col("at") - j).alias("start"), F.col("span").alias("span"))))
    rows = rows.withColumn("windows", F.when(F.size(windows) > 0, windows))
    # A document's windows are bounded by its words times the spans; those of one mark come together.
    found = rows.groupBy("row").agg(F.first("kept").alias("kept"), F.first("n_words").alias("n_words"), F.collect_set("windows").alias("w"), F.collect_set(F.when(F.col("windows").isNotNull(), F.col("item_ids"))).alias("items"))
    covered = F.array_distinct(F.flatten(F.transform(F.array_distinct(F.flatten("w")), lambda w: F.sequence(w["start"], w["start"] + w["span"] - 1))))
    n_hit = F.when(F.size("w") > 0, F.size(covered)).otherwise(0).cast("long")
    found = found.withColumn("items", F.array_distinct(F.flatten("items")))
    sha = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select("kept.*", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), sha.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
i2 as (select item_id, w, least(len(w), 10) span, unnest(range(1, len(w) - least(len(w), 10) + 2)) s from i where len(w) > 0),
iw as (select distinct item_id, span, array_to_string(w[s : s + span - 1], ' ') k from i2),
d2 as (select doc_id, w, span, unnest(range(1, len(w) - span + 2)) s from d, (select distinct span from iw) where len(w) >= span),
hits as (select doc_id, s, d2.span, item_id from d2 join iw on iw.span = d2.span and iw.k = array_to_string(d2.w[s : s + d2.span - 1], ' ')),
pos as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(s, s + span)) p from hits) group by doc_id),
its as (select doc_id, count(*) n, sha256(string_agg(k, ',' order by k)) h from (select distinct doc_id, cast(item_id as varchar) k from hits) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(pos.n, 0) n_hit, coalesce(its.n, 0) n_items, coalesce(its.h, sha256('')) items_sha256, coalesce(pos.n, 0) > 0 contaminated
from d left join pos using (doc_id) left join its using (doc_id)
"""
