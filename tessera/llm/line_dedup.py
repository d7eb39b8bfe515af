"""Fuzzy line deduplication: MinHash over character shingles, banding, exact Jaccard, distributed union-find.

DataFrame functions only.

1. Lines are trimmed of white space and lower-cased and equal ones are counted together (partial aggregates, so a line
   that a third of all documents share is one row per task before the shuffle).
2. A line's shingles are all its windows of ``window`` characters, one at every character; a shorter line is one
   shingle.  Windows are cut from the line's code points in four bytes each, where a window's place is known.  Their
   hashes are dealt into ``hashes`` bins by their size; the signature has the least hash of each bin, and for an empty
   bin that of another.
3. A band is ``rows`` of the signature's numbers; each number is in about as many bands.  Lines that agree in all rows
   of a band are candidates: about 0.97 of the pairs with similarity 0.8, all but a few from 0.85 on.  Sets of every
   size have all bands.
   Bands of up to four lines give all their pairs; in larger ones each line meets its three neighbours in order and
   the first.  Bands that hold many rows are dealt over salts, whose firsts meet the band's first.  After a first
   union-find, lines of different components that still share a band meet, at most 16 a line and band; in bands of more
   they are joined by prefix filtering, which is exact.
   So no pair of a band that could still join components is left out, and no group of similar lines is expanded into
   all its pairs.
4. Candidates are verified by the exact Jaccard similarity of their sets of shingles (32-bit hashes).
5. Of each component the line that comes first, by doc_id and line number, is kept; ties of repeated rows keep all.

Null and empty texts have no lines to remove; blank lines (white space only) are never removed and have no class.
Rows that share a doc_id are told apart by their texts; equal rows keep the same lines.  A null doc_id comes before
all others.  Lines of any length are read whole.  Other columns, whatever their names, are not looked at.  Keys of
lines are 64-bit hashes.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.shared import Scratch, components, shared_table

#: The bits of a hash that counts go by.
_LOW = (1 << 18) - 1
#: Bands are counted by so many of their hashes, to find those that hold many rows.
SLOTS = 1 << 16
#: White space that ends of lines lose.
_WHITE = " \t\r\x0b\x0c"


def _norm(line: Column) -> Column:
    # Trimming by a set looks at every character, so only lines with white space at an end are trimmed.
    ends = reduce(or_, [line.startswith(c) | line.endswith(c) for c in _WHITE])
    return F.lower(F.when(ends, F.btrim(line, F.lit(_WHITE))).otherwise(line))


def _blank(line: Column) -> Column:
    return F.ltrim(line, F.lit(_WHITE)) == ""


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (hash of the text), line_no (from 0), line, norm, key (of the normalized line; null if blank)."""
    # A plain explode adds a filter on the array's size, for which texts would be split again; no array is empty here.
    texts = docs.where(F.col("text").isNotNull())
    lines = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
    return lines.withColumn("norm", _norm(F.col("line"))).withColumn("key", F.when(F.col("norm") != "", F.xxhash64("norm")))


def _points(lines: DataFrame, window: int) -> DataFrame:
    """key, p (the code points in four bytes each), starts (the places of the windows, from 1)."""
    points = lines.select("key", F.encode("norm", "UTF-32").alias("p"))
    return points.select("key", "p", F.sequence(F.lit(1), F.greatest(F.octet_length("p") / 4 - (window - 1), F.lit(1)).cast("int")).alias("starts"))


def _hashed(p: Column, k: Column, window: int) -> Column:
    return F.xxhash64(F.substring(p, k * 4 - 3, F.lit(4 * window)))


def shingles(lines: DataFrame, window: int) -> DataFrame:
    """key, h: the hash of every window of ``norm``, repeats included."""
    # As in ``split_lines``: windows are counted once.
    return _points(lines, window).select("key", "p", F.explode_outer("starts").alias("k")).select("key", _hashed(F.col("p"), F.col("k"), window).alias("h"))


def shingle_sets(lines: DataFrame, window: int) -> DataFrame:
    """key, all: the upper 32 bits of the hashes, without repeats; one row per row.

    Half the size of whole hashes: of 100,000 pairs of lines of 300 characters, about two have two shingles that then
    count as one.
    """
    # The outer variable holds the bytes; a column inside the inner function would be copied for every window.
    upper = F.transform(F.array("p"), lambda p: F.transform("starts", lambda k: F.shiftright(_hashed(p, k, window), 32).cast("int")))
    return _points(lines, window).select("key", F.array_distinct(upper[0]).alias("all"))


def signatures(lines: DataFrame, window: int, hashes: int) -> DataFrame:
    """key, b0, b1, ...: the least hash of each of ``hashes`` bins, or null; repeats of a shingle don't change them."""
    binned = shingles(lines, window).withColumn("bin", F.shiftright(F.shiftrightunsigned("h", 32) * hashes, 32).cast("int"))
    return binned.groupBy("key").agg(*[F.expr(f"min(h) FILTER (WHERE bin = {k})").alias(f"b{k}") for k in range(hashes)])


def banded_signatures(lines: DataFrame, window: int, hashes: int, bands: int, rows: int, seed: int) -> DataFrame:
    """key, bands: hashes of ``rows`` of the signature's numbers.

    The number of an empty bin is that of the first bin that isn't, in an order of its own.  So two sets agree in a
    number with the probability of their Jaccard similarity, as they do in a minimum over all shingles.
    """
    draw = random.Random(seed)
    order = [(k, *draw.sample([j for j in range(hashes) if j != k], hashes - 1)) for k in range(hashes)]
    number = [F.coalesce(*[F.col(f"b{j}") for j in of]) for of in order]
    made = F.array(*[F.xxhash64(F.lit(b), *[number[k] for k in chosen]) for b, chosen in enumerate(band_rows(hashes, bands, rows, seed))])
    # With a function over arrays this projection is compiled by itself, in small methods; fused with the minima it is
    # one method that is too long to be compiled to machine code.
    return signatures(lines, window, hashes).select("key", F.transform(made, lambda x: x).alias("bands"))


def band_rows(hashes: int, bands: int, rows: int, seed: int) -> list[list[int]]:
    """Which of the signature's numbers each band has; all are used about equally often."""
    draw, used, out = random.Random(seed), [0] * hashes, []
    for _ in range(bands):
        chosen = sorted(range(hashes), key=lambda i: (used[i], draw.random()))[:rows]
        for i in chosen:
            used[i] += 1
        out.append(sorted(chosen))
    return out


def similar(a: Column, b: Column, threshold: float) -> Column:
    """Whether the Jaccard similarity of two arrays without repeats is at least ``threshold``."""
    least = (F.size(a) + F.size(b)) * (threshold / (1 + threshold)) - 1e-9
    return (F.least(F.size(a), F.size(b)) >= least) & (F.size(F.array_intersect(a, b)) >= least)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose sets (key, all) are similar enough."""
    # Pairs, the smaller side, are hashed; the second join sorts, as sets may be larger than a task's memory.
    both = sets.toDF("a", "all_a").join(pairs.hint("shuffle_hash"), "a").join(sets.toDF("b", "all_b"), "b")
    return both.where(similar(F.col("all_a"), F.col("all_b"), threshold)).select("a", "b")


def _by_prefix(open_: DataFrame, sets: DataFrame, threshold: float, scratch: Scratch | None = None) -> DataFrame:
    """Pairs (a, b) of lines of different components that can be similar, by positional prefix filtering.

    ``open_``: (key, root); ``sets``: (key, all); what is read several times goes to ``scratch``.  Shingles are ordered by rarity, counted among the lines in question by
    the last bits of their hashes, so the counts can go to all tasks and shingles stay where their lines are.  Similar
    lines' first common shingle lies in the first n - ceil(2t / (1 + t) n) + 1 shingles of the smaller set and the first
    n - ceil(t n) + 1 of the larger one, and what follows it in both must suffice for the similarity.
    """
    table = scratch.table if scratch else lambda df, _: df
    own = table(sets.join(open_.hint("shuffle_hash"), "key").select("key", "root", "all"), "open_sets")
    each = own.select("key", "root", F.size("all").alias("size"), F.explode("all").alias("h")).withColumn("low", F.col("h").bitwiseAND(_LOW))
    counted = each.join(F.broadcast(each.groupBy("low").agg(F.count(F.lit(1)).alias("n"))), "low")
    # A count and a hash in one number, so that arrays of numbers are sorted.
    rank = F.shiftleft("n", 32).bitwiseOR(F.col("h").cast("long").bitwiseAND(F.lit((1 << 32) - 1)))
    need = lambda share: F.ceil(F.col("size") * share - 1e-9)
    length = (F.col("size") - need(threshold) + 1).cast("int")
    ordered = counted.groupBy("key", "root", "size").agg(F.sort_array(F.collect_list(rank)).alias("ranks"))
    head = ordered.select("key", "root", "size", F.posexplode(F.slice("ranks", F.lit(1), length)).alias("pos", "rank"))
    each = table(head.select("key", "root", "size", "pos", F.shiftright(F.shiftleft("rank", 32), 32).cast("int").alias("h")), "heads")
    # Of the lines with a shingle, those of the component that has most of them need not meet each other.
    main = each.groupBy("h", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    each = each.join(main, "h").withColumn("odd", F.col("root") != F.col("main")).drop("main")
    small = each.where(F.col("pos") < F.col("size") - need(2 * threshold / (1 + threshold)) + 1)
    large = each.select("h", *[F.col(c).alias(f"{c}_b") for c in ("key", "root", "size", "pos", "odd")])
    order = (F.col("size") < F.col("size_b")) | ((F.col("size") == F.col("size_b")) & (F.col("key") < F.col("key_b")))
    most = F.least(F.col("size") - F.col("pos"), F.col("size_b") - F.col("pos_b"))
    enough = (F.col("size") >= threshold * F.col("size_b") - 1e-9) & (most >= (F.col("size") + F.col("size_b")) * (threshold / (1 + threshold)) - 1e-9)
    met = order & enough & (F.col("root") != F.col("root_b"))
    pairs = small.where("odd").join(large, "h").where(met).unionByName(small.where("not odd").join(large.where("odd_b"), "h").where(met))
    return pairs.select(F.least("key", "key_b").alias("a"), F.greatest("key", "key_b").alias("b")).distinct()


def _salted(member: DataFrame, total: int, least: int = 500) -> DataFrame:
    """``member`` (key, band) with ``salt``: null, or for bands that may hold many rows one of so many as they need.

    Rows are counted by slots of bands; a slot over three times the mean, and ``least`` more, is hot.  At most ``SLOTS``
    counts come to the driver, and at most as many go to the tasks.
    """
    slot = F.pmod("band", F.lit(SLOTS)).cast("int")
    most = 3 * total // SLOTS + least
    hot = [(r.slot, -(-r.n // most)) for r in member.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).collect()]
    if not hot:
        return member.withColumn("salt", F.lit(None).cast("long"))
    parts = F.broadcast(member.sparkSession.createDataFrame(hot, "slot int, parts long"))
    return member.withColumn("slot", slot).join(parts, "slot", "left").select("key", "band", F.pmod(F.xxhash64("key"), F.col("parts")).alias("salt"))


def linked(banded: DataFrame, sets_of: Callable[[DataFrame], DataFrame], threshold: float, scratch: Scratch, small: int = 16) -> DataFrame:
    """(node, root) of all keys with links.

    ``banded``: (key, bands), a table of ``scratch`` that goes once it is read; ``sets_of`` makes (key, all), sets of shingles, for some keys.  Tables go
    to ``scratch``, among them those that the result reads.
    """
    total = banded.agg(F.sum(F.size("bands"))).first()[0] or 0
    member = _salted(banded.select("key", F.explode("bands").alias("band")), total)
    # Most bands have one line; they go before the rest gets its places.
    several = member.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("band", "salt"))).where("n > 1 or salt is not null").drop("n")
    group = Window.partitionBy("band", "salt").orderBy("key")
    before = [F.lag("key", k).over(group).alias(f"p{k}") for k in (1, 2, 3)]
    placed = several.select("*", *before, F.first("key").over(group).alias("head"), F.row_number().over(group).alias("place"))
    met = scratch.table(placed, "bands")
    scratch.drop(banded)
    heads = met.where("salt is not null").select("band", "head").distinct()
    firsts = heads.groupBy("band").agg(F.min("head").alias("a"))
    across = heads.join(firsts, "band").select(F.col("head").alias("b"), "a")
    partners = met.select(F.col("key").alias("b"), F.explode(F.array("p1", "p2", "p3", "head")).alias("a"))
    pairs = scratch.table(partners.unionByName(across).where("a < b").distinct(), "pairs")
    # In buckets, so that only one side of a pair's sets ever moves.
    sets = scratch.bucketed(sets_of(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()), "sets", "key")
    links = scratch.table(_verified(pairs, sets, threshold), "links")
    roots = scratch.table(components(links, scratch=scratch), "roots")

    # What larger bands still leave open: pairs of different components.
    large = met.join(roots, met.key == roots.node, "left").select("band", "key", "salt", "place", F.coalesce("root", "key").alias("root"))
    mixed = large.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("place").alias("most"), F.max("salt").alias("some")).where("lo < hi and (most > 4 or some is not null)").select("band", (F.col("some").isNull() & (F.col("most") <= small)).alias("few"))
    open_ = scratch.table(large.join(mixed, "band").select("band", "key", "root", "few"), "open")
    # In bands of few lines all such pairs, at most ``small`` a line; in larger ones those that prefixes leave.
    own, other = open_.where("few").select("band", F.col("key").alias("a"), F.col("root").alias("root_a")), open_.where("few").select("band", F.col("key").alias("b"), F.col("root").alias("root_b"))
    near = own.join(other, "band").where("a < b and root_a <> root_b").select("a", "b")
    many = open_.where("not few").select("key", "root").distinct()
    far = _by_prefix(many, sets, threshold, scratch)
    left = near.unionByName(far).distinct().join(pairs, ["a", "b"], "left_anti")
    more = scratch.table(_verified(left, sets, threshold), "links")
    # The second union-find is over components.
    root_of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    joined = components(more.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")), scratch=scratch)
    heads_of = lambda t: t.select(F.col("root").alias("node"), "root")
    nodes = roots.union(heads_of(roots)).union(joined.select("node", F.col("node").alias("root"))).union(heads_of(joined)).distinct()
    final = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return nodes.join(final, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def line_classes(docs: DataFrame, threshold: float = 0.8, window: int = 8, hashes: int = 24, bands: int = 14, rows: int = 5, seed: int = 7) -> DataFrame:
    """doc_id, line_no, text_key, class_doc, class_line (the line that is kept for it), kept: one row per line."""
    place = F.struct("doc_id", "text_key", "line_no")
    distinct = split_lines(docs).where("norm <> ''").groupBy(F.xxhash64("norm").alias("key")).agg(F.min("norm").alias("norm"), F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    with Scratch(docs.sparkSession) as scratch:
        # Lines lie in buckets of their keys, so their signatures are made without a shuffle.
        lines = scratch.bucketed(distinct, "lines", "key")
        banded = scratch.table(banded_signatures(lines, window, hashes, bands, rows, seed), "signatures")
        nodes = linked(banded, lambda keys: shingle_sets(lines.join(keys.hint("shuffle_hash"), "key", "left_semi"), window), threshold, scratch)
        # A hash join, so that lines aren't sorted.
        classed = lines.select("key", "first", "n").join(nodes.hint("shuffle_hash"), lines.key == nodes.node, "left").where("n > 1 or root is not null")
        classed = scratch.table(classed.select("key", "first", F.coalesce("root", "key").alias("root")), "classed")
        firsts = classed.groupBy("root").agg(F.min("first").alias("head"))
        heads, _ = shared_table(classed.join(firsts, "root").select("key", "head"), "heads")

    own = split_lines(docs).select("doc_id", "text_key", "line_no", "key")
    return own.join(heads, "key", "left").select(
        "doc_id",
        "line_no",
        "text_key",
        F.when(F.col("head").isNotNull(), F.col("head.doc_id")).when(F.col("key").isNotNull(), F.col("doc_id")).alias("class_doc"),
        F.when(F.col("head").isNotNull(), F.col("head.line_no")).when(F.col("key").isNotNull(), F.col("line_no")).alias("class_line"),
        (F.col("head").isNull() | F.col("head").eqNullSafe(place)).alias("kept"),
    )


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """The documents without the lines that aren't kept; documents that had lines and keep none go.

    Rows without lines to remove are unchanged, among them all with a null or empty text.
    """
    gone = line_classes(docs, **options).where("not kept").groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("_t_gone")).withColumnsRenamed({"doc_id": "_t_id", "text_key": "_t_key"})
    same = docs["doc_id"].cast("long").eqNullSafe(gone["_t_id"]) & (F.xxhash64(docs["text"]) == gone["_t_key"])
    joined = docs.join(gone, same, "left")
    kept = F.filter(F.split("text", "\n"), lambda line, k: ~F.array_contains("_t_gone", k))
    still = F.col("_t_gone").isNull() | F.exists(kept, lambda line: ~_blank(line))
    text = F.when(F.col("_t_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.where(still).withColumn("text", text).select(docs.columns)
