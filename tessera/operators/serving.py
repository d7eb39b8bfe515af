"""Queries over factor tables: rows of keys go in, rows of results come out.

``items`` and ``users`` are (id, features); ``known`` is (user, item).  Ties go to the smaller id.

Scoring a set of users against all items is the heavy plan.  Small item tables (their size is checked) are shipped to
the tasks once and scored by matrix products in Arrow batches; larger ones are cut into blocks, every block meets
every block of users by an equality join, and per-block top lists are merged.  Either way only ``top`` rows per user
and block are shuffled.

With ``hashes`` a user meets only the items of the buckets near its own: blocks are cut within buckets, and meet
blocks of users whose buckets are near.  A bucket of any size is any number of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.vectors import cosine, dot, mean_vector, norm, unit
from tessera.operators import lsh
from tessera.operators.rescoring import Rescorer

MAX_ROWS = 100_000
#: Bytes of item factors up to which they are shipped to every task.
SHIP_BYTES = 64 << 20
#: Scores that a task holds at once, as a matrix and as rows.
PAIRS, ROWS = 1 << 22, 1 << 18


class BadRequestError(ValueError):
    """A request that can't be answered as asked."""


class NotFoundError(LookupError):
    """An id that the model lacks."""


def check_page(how_many: int, offset: int = 0, bounded: bool = True) -> None:
    """howMany is positive, offset isn't negative; each, and their sum, are at most 100,000 where ``bounded``."""
    if how_many <= 0 or offset < 0:
        raise BadRequestError("howMany must be positive and offset nonnegative")
    if bounded and (how_many > MAX_ROWS or offset > MAX_ROWS or how_many + offset > MAX_ROWS):
        raise BadRequestError(f"howMany and offset must not exceed {MAX_ROWS}")


def page(rows: DataFrame, by: Column, tie: str, how_many: int, offset: int, keys: list[str] | None = None) -> DataFrame:
    """Rows offset .. offset + howMany of the order, overall or for each key."""
    if not keys:
        return rows.orderBy(by, tie).offset(offset).limit(how_many)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(by, tie))
    return rows.withColumn("_rn", place).where(F.col("_rn") <= offset + how_many).where(F.col("_rn") > offset).drop("_rn")


def _scored(mine: pd.DataFrame, matrix: np.ndarray) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Users of ``mine`` with their scores, a row each; not more than ``PAIRS`` scores at once."""
    step = max(1, min(1024, PAIRS // max(1, len(matrix))))
    for k in range(0, len(mine) if len(matrix) else 0, step):
        part = mine.iloc[k : k + step]
        yield part, np.stack(part["features"].to_numpy()).astype(np.float64) @ matrix.T


def _top_blocks(mine: pd.DataFrame, ids: np.ndarray, matrix: np.ndarray, on_arrays: Callable | None = None) -> Iterator[pd.DataFrame]:
    """The best rows of matrix for each vector of ``mine``, ``most`` of them; ties in the order of ``ids``; NaN is no score."""
    for part, scores in _scored(mine, matrix):
        if on_arrays is not None:
            scores = on_arrays(ids, scores)
        counts, items, values = [], [], []
        for s, most in zip(scores, part["most"].to_numpy(), strict=True):
            at = np.flatnonzero(~np.isnan(s))
            n = min(int(most), len(at))
            if n < len(at):
                # All that tie with the last place stay in the race, so that ids decide.
                bound = np.partition(s[at], len(at) - n)[len(at) - n]
                at = np.flatnonzero(s >= bound)
            at = at[np.argsort(-s[at], kind="stable")][:n]
            counts.append(len(at))
            items.append(ids[at])
            values.append(s[at])
        yield pd.DataFrame({"user": np.repeat(part["user"].to_numpy(), counts), "item": np.concatenate(items), "value": np.concatenate(values)})


def _every_pair(mine: pd.DataFrame, ids: np.ndarray, matrix: np.ndarray) -> Iterator[pd.DataFrame]:
    """All scores, a row each, a user's together."""
    for part, scores in _scored(mine, matrix):
        step = max(1, ROWS // len(ids))
        for k in range(0, len(part), step):
            some = scores[k : k + step]
            each = part.iloc[k : k + step].loc[:, ["user", "most"]]
            whole = pd.DataFrame({"user": np.repeat(each["user"].to_numpy(), len(ids)), "item": np.tile(ids, len(some)), "value": some.ravel(), "most": np.repeat(each["most"].to_numpy(), len(ids))})
            for r in range(0, len(whole), ROWS):
                yield whole.iloc[r : r + ROWS]


def _best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each user's rows in a batch the ``most`` best: what can't be among them overall goes before any shuffle."""
    for pdf in batches:
        pdf = pdf.sort_values(["user", "value", "item"], ascending=[True, False, True])
        yield pdf[pdf.groupby("user").cumcount() < pdf["most"]].drop(columns="most")


def _parted(rows: DataFrame, counts: list, size: int, name: str) -> DataFrame:
    """``rows`` of the counted buckets, with how many parts of about ``size`` their bucket has."""
    if len(counts) == 1:
        return rows.where(F.col("bucket") == counts[0].bucket).withColumn(name, F.lit(-(-counts[0].n // size)).cast("long"))
    parts = rows.sparkSession.createDataFrame([(r.bucket, -(-r.n // size)) for r in counts], f"bucket int, {name} long")
    return rows.join(F.broadcast(parts), "bucket")


def top_candidates(users: DataFrame, items: DataFrame, extra: DataFrame | None, top: int, block: int = 8192, hashes: lsh.Hashes | None = None, rescorer: Rescorer | None = None) -> DataFrame:
    """user, item, value: at least the ``top`` best items of each user once ``extra`` items of that user are left out.

    ``extra``: (user, n), how many items of a user may be left out afterwards; that many more are kept.
    With ``hashes`` the best are those of the buckets near the user's.  With a ``rescorer`` that rescores, the best are those
    by the new scores: where it takes arrays these are rescored as matrices in the tasks, otherwise every pair is a row for
    its Columns, and of these rows only each user's best of a batch go on.
    """
    rescores = rescorer is not None and rescorer.rescore is not None
    on_arrays = rescorer.on_arrays if rescores else None
    by_rows = rescores and on_arrays is None
    bucket = F.lit(0) if hashes is None else lsh.bucket(F.col("features"), hashes.planes)
    masks = [0] if hashes is None else hashes.masks
    wanted = users.select(F.col("id").alias("user"), "features", bucket.alias("bucket"))
    if extra is not None:
        wanted = wanted.join(extra.select("user", F.col("n").alias("extra")), "user", "left")
    else:
        wanted = wanted.withColumn("extra", F.lit(0))
    wanted = wanted.select("user", "features", (F.coalesce("extra", F.lit(0)) + top).cast("long").alias("most"), "bucket")
    items = items.select("id", "features", bucket.alias("bucket"))
    kinds = dict(items.dtypes)
    best_schema = f"user {dict(wanted.dtypes)['user']}, item {kinds['id']}, value double"
    schema = best_schema + ", most long" * by_rows

    def results(mine: pd.DataFrame, ids: np.ndarray, matrix: np.ndarray) -> Iterator[pd.DataFrame]:
        return _every_pair(mine, ids, matrix) if by_rows else _top_blocks(mine, ids, matrix, on_arrays)

    def ended(scored: DataFrame) -> DataFrame:
        return rescorer.apply(scored, "item", "value").mapInPandas(_best, best_schema) if by_rows else scored

    # At most 2 ** MAX_HASHES rows.
    sized = items.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("rank")).collect()
    if not sized:
        return wanted.select("user", F.lit(None).cast(kinds["id"]).alias("item"), F.lit(0.0).alias("value")).limit(0)
    if sum(r.n for r in sized) * max(r["rank"] or 0 for r in sized) * 8 <= SHIP_BYTES:
        rows = items.orderBy("id").toPandas()
        ids, matrix, buckets = rows["id"].to_numpy(), np.stack(rows["features"].to_numpy()).astype(np.float64), rows["bucket"].to_numpy()

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for at, mine in pdf.groupby("bucket"):
                    near = np.isin(buckets, [at ^ m for m in masks])
                    own_ids, own = (ids, matrix) if near.all() else (ids[near], matrix[near])
                    yield from results(mine, own_ids, own)

        return ended(wanted.mapInPandas(score, schema))

    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    item_blocks = _parted(items, sized, block, "parts").withColumn("part", part).groupBy("part", "bucket").agg(F.array_sort(F.collect_list(F.struct("id", "features"))).alias("rows"))
    # Users of near buckets are one block of at most about 4096, so an item block is sent once for each of these.
    counts = wanted.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()
    near = F.explode(F.array(*[F.col("bucket").bitwiseXOR(F.lit(m)) for m in masks]))
    dealt = _parted(wanted, counts, max(1, 4096 // len(masks)), "user_parts").select("user", "features", "most", F.pmod(F.xxhash64("user"), F.col("user_parts")).alias("ub"), near.alias("bucket"))
    grouped = dealt.groupBy("bucket", "ub").agg(F.collect_list(F.struct("user", "features", "most")).alias("users"))
    user_blocks = _parted(grouped, sized, block, "parts").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")

    def score_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for users_, rows_ in zip(pdf["users"], pdf["rows"], strict=True):
                mine = pd.DataFrame([dict(u.asDict() if hasattr(u, "asDict") else u) for u in users_])
                ids = np.array([r["id"] for r in rows_])
                matrix = np.stack([np.asarray(r["features"]) for r in rows_]).astype(np.float64)
                yield from results(mine, ids, matrix)

    return ended(user_blocks.join(item_blocks, ["part", "bucket"]).select("users", "rows").mapInPandas(score_blocks, schema))


def recommend(users: DataFrame, items: DataFrame, known: DataFrame | None = None, how_many: int = 10, offset: int = 0, rescorer: Rescorer | None = None, hashes: lsh.Hashes | None = None) -> DataFrame:
    """user, item, value: items by dot product, without the user's ``known`` items if given; of near buckets only with ``hashes``."""
    check_page(how_many, offset)
    if rescorer is not None:
        items = rescorer.filter_only(items, "id")
    extra = known.groupBy("user").agg(F.count(F.lit(1)).alias("n")) if known is not None else None
    scored = top_candidates(users, items, extra, how_many + offset, hashes=hashes, rescorer=rescorer)
    if known is not None:
        scored = scored.join(known.select("user", "item"), ["user", "item"], "left_anti")
    return page(scored.where(~F.isnan("value")), F.desc("value"), "item", how_many, offset, ["user"])


def recommend_to_group(groups: DataFrame, users: DataFrame, items: DataFrame, known: DataFrame | None = None, how_many: int = 10, offset: int = 0) -> DataFrame:
    """group, item, value: for each group of users (group, user) the items nearest their mean vector.

    Known items of any member are left out; members that the model lacks don't count, groups without members go.
    """
    check_page(how_many, offset)
    members = groups.join(users, groups.user == users.id).select("group", "user", "features")
    means = mean_vector(members, "features", ["group"]).withColumnRenamed("group", "id")
    mine = groups.join(known, "user").select(F.col("group").alias("user"), "item").distinct() if known is not None else None
    return recommend(means, items, mine, how_many, offset).withColumnRenamed("user", "group")


def similar_items(seeds: DataFrame, items: DataFrame, how_many: int = 10, offset: int = 0, rescorer: Rescorer | None = None, hashes: lsh.Hashes | None = None) -> DataFrame:
    """request, item, value: items by cosine to the normalized sum of each request's (request, item) vectors."""
    check_page(how_many, offset)
    units = items.select("id", unit(F.col("features")).alias("features")).where("features is not null")
    wanted = seeds.join(items.select("id", F.col("features").cast("array<double>").alias("features")), seeds.item == F.col("id")).select("request", "features")
    sums = mean_vector(wanted, "features", ["request"], mean=False)
    targets = sums.select(F.col("request").alias("id"), unit(F.col("features")).alias("features")).where("features is not null")
    left_out = seeds.groupBy(F.col("request").alias("user")).agg(F.count(F.lit(1)).alias("n"))
    scored = top_candidates(targets, units if rescorer is None else rescorer.filter_only(units, "id"), left_out, how_many + offset, hashes=hashes, rescorer=rescorer)
    scored = scored.withColumnRenamed("user", "request").join(seeds.select("request", "item"), ["request", "item"], "left_anti")
    return page(scored, F.desc("value"), "item", how_many, offset, ["request"])


def similarity_to_item(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """to, item, position, value of rows (to, item, position): cosines, 0.0 for unknown items; unknown ``to`` go."""
    target = items.select(F.col("id").alias("to"), F.col("features").alias("target"))
    other = items.select(F.col("id").alias("item"), "features")
    return pairs.join(target, "to").join(other, "item", "left").select("to", "item", "position", F.coalesce(cosine(F.col("features"), F.col("target")), F.lit(0.0)).alias("value"))


def estimate(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """user, item, position, value of rows (user, item, position): dots, 0.0 for unknown items; unknown users go."""
    mine = users.select(F.col("id").alias("user"), F.col("features").alias("target"))
    other = items.select(F.col("id").alias("item"), "features")
    return pairs.join(mine, "user").join(other, "item", "left").select("user", "item", "position", F.coalesce(dot(F.col("target"), F.col("features")), F.lit(0.0)).alias("value"))


def because(requests: DataFrame, known: DataFrame, items: DataFrame, how_many: int = 10, offset: int = 0) -> DataFrame:
    """user, target, item, value of requests (user, target): the user's known items by cosine to the target."""
    check_page(how_many, offset, bounded=how_many <= MAX_ROWS)
    target = items.select(F.col("id").alias("target"), F.col("features").alias("target_features"))
    mine = known.join(items.select(F.col("id").alias("item"), "features"), "item")
    scored = requests.join(target, "target").join(mine, "user").select("user", "target", "item", cosine(F.col("features"), F.col("target_features")).alias("value"))
    return page(scored, F.desc("value"), "item", how_many, offset, ["user", "target"])


def most_surprising(users: DataFrame, known: DataFrame, items: DataFrame, how_many: int = 10, offset: int = 0) -> DataFrame:
    """user, item, value: known items by dot product, lowest first."""
    check_page(how_many, offset, bounded=how_many <= MAX_ROWS)
    scored = users.select(F.col("id").alias("user"), F.col("features").alias("mine")).join(known, "user").join(items.select(F.col("id").alias("item"), "features"), "item").select("user", "item", dot(F.col("mine"), F.col("features")).alias("value"))
    return page(scored, F.asc("value"), "item", how_many, offset, ["user"])


def most_popular(counts: DataFrame, how_many: int = 10, offset: int = 0, rescorer: Rescorer | None = None) -> DataFrame:
    """id, count by falling count; a rescorer only filters."""
    check_page(how_many, offset, bounded=False)
    if rescorer is not None:
        counts = rescorer.filter_only(counts, "id")
    return page(counts, F.desc("count"), "id", how_many, offset)


def representative_items(items: DataFrame) -> DataFrame:
    """dim, item: for each latent dimension the item with the largest value."""
    each = items.select("id", F.posexplode("features").alias("dim", "x"))
    top = each.groupBy("dim").agg(F.max(F.col("x").cast("double")).alias("m"))
    return each.join(F.broadcast(top), "dim").where(F.col("x").cast("double") == F.col("m")).groupBy("dim").agg(F.min("id").alias("item"))


def unit_norms(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", norm(F.col("features")).alias("norm"))


def known_of(users: DataFrame, known: DataFrame) -> DataFrame:
    """user, item of the requested users (id); none for unknown ones."""
    return known.join(users.select(F.col("id").alias("user")), "user", "left_semi")


def fraction_loaded(expected: DataFrame, loaded: DataFrame) -> float:
    """Share of ids that are there of those there or expected; 1.0 if none is expected."""
    there = loaded.count()
    missing = expected.join(loaded, "id", "left_anti").count()
    return 1.0 if there + missing == 0 else there / (there + missing)


def ready(expected: DataFrame, loaded: DataFrame, least: float = 0.8) -> bool:
    return fraction_loaded(expected, loaded) >= least
