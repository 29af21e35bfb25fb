"""Candidate pairs. A pair is two record ids with the smaller first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardmill import storage
from cardmill.functions import scores
from cardmill.operators import tiles

#: Records of a block that meet the records of another cell, or each other, under one join key.
CELL = 1000
#: Blocks of up to so many records meet by a join, larger ones in tiles.
SMALL = 64


def blocked(records: DataFrame, keys: str = "block_keys", key: str = "record_id", cell: int = SMALL, tile: int = tiles.TILE) -> DataFrame:
    """``a, b`` that share a block key, each pair once. A block of n records gives n(n-1)/2 pairs, whatever its size.

    A pair is given by the largest block that it shares, so nothing needs to be made distinct. Pairs of blocks of more
    than ``cell`` records come from the tiles of the records that have such blocks: nothing is copied for them, so the
    written tables are as large as the records, not as the pairs. The others meet by a join on the block, without the
    pairs that share a larger one.
    """
    scratch = storage.Scratch(records.sparkSession, "blocked")
    placed = scratch.cut(numbered(records.select(F.col(key).alias("id"), F.col(keys).alias("keys")), scratch), "placed")
    large = placed.withColumn("keys", F.transform(F.filter("o", lambda x: x["m"] < -cell), lambda x: x["block"])).filter(F.size("keys") > 0).select("id", "keys")
    each = placed.select("id", F.transform("o", lambda x: x["block"]).alias("all"), F.posexplode("o").alias("place", "x")).filter(F.col("x.m") >= -cell)
    each = each.select("id", F.col("x.block").alias("block"), F.slice("all", F.lit(1), F.col("place")).alias("larger"))
    left, right = each.toDF("p", "block", "lp"), each.toDF("q", "block", "lq")
    met = left.join(right, "block").filter((F.col("p") < F.col("q")) & ~F.arrays_overlap("lp", "lq")).select(F.col("p").alias("a"), F.col("q").alias("b"))
    return met.unionByName(tiles.sharing(large, scratch, tile))


def numbered(rows: DataFrame, scratch: storage.Scratch) -> DataFrame:
    """``id, o`` of rows of ``id, keys``: ``m, block`` of each key that other records have too, the largest first; m is the size, negated, and block a number."""
    rows = scratch.cut(rows.select("id", F.explode("keys").alias("key")).distinct(), "keys")
    sizes = scratch.cut(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("block", F.monotonically_increasing_id()), "sizes")
    sized = storage.join_by_size(rows, sizes, "key", "n", rows.count())
    return sized.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "block"))).alias("o"))


def pairs_within(rows: DataFrame, key: str, value: str, cell: int = CELL) -> DataFrame:
    """``<key>, p, q`` (p < q): every two values of a key, each value once per key; of keys of any size.

    A key of n rows is cut into cells of about ``cell`` rows and each pair of cells is one join key, so that no task
    gets a hot key whole. The rows that come out are as many as the pairs.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
    sized = storage.join_by_size(rows.select(key, value), sizes, key, "n", F.lit(rows.count()))
    each = sized.withColumn("cells", F.ceil(F.col("n") / cell).cast("int")).withColumn("k", F.pmod(F.xxhash64(value), F.col("cells")).cast("int"))
    left = each.select(key, F.col("k").alias("i"), F.explode(F.sequence("k", F.col("cells") - 1)).alias("j"), F.col(value).alias("p"))
    right = each.select(key, F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"), F.col("k").alias("j"), F.col(value).alias("q"))
    met = left.join(right, [key, "i", "j"]).filter((F.col("i") < F.col("j")) | (F.col("p") < F.col("q")))
    return met.select(key, F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))


def block_sizes(records: DataFrame, keys: str = "block_keys", key: str = "record_id") -> DataFrame:
    """``block, n, pairs``: the pairs of each block in closed form, without forming them."""
    rows = records.select(F.explode(keys).alias("block"), F.col(key).alias("id")).distinct()
    return rows.groupBy("block").agg(F.count("*").alias("n")).withColumn("pairs", F.expr("n * (n - 1) div 2"))


def stars(records: DataFrame, on: list[str], key: str = "record_id") -> DataFrame:
    """``a, b`` linking each record to the first of its group: the components of all pairs of equal values, in linear size.

    The first is found by an aggregation and brought to hot values by a broadcast, so a hot value meets in no task as a
    group.
    """
    value = on[0] if len(on) == 1 else "value"
    rows = records if len(on) == 1 else records.withColumn("value", F.struct(*on))
    first = rows.groupBy(value).agg(F.min(key).alias("a"), F.count("*").alias("n")).filter("n > 1")
    return storage.join_by_size(rows.select(value, F.col(key).alias("b")), first, value, "n", F.lit(records.count())).filter("a < b").select("a", "b")


def exact(records: DataFrame, key: str = "record_id") -> DataFrame:
    """``a, b`` by equal fingerprint or equal non-empty front: two equi-joins, never an OR."""
    return stars(records, ["fingerprint"], key).union(stars(records.filter("front_norm <> ''"), ["front_norm"], key)).distinct()


def jaccard_join(records: DataFrame, least: float = 0.5, tokens: str = "content", key: str = "record_id") -> DataFrame:
    """``a, b, shared``: all pairs with a token Jaccard of at least ``least``, by prefix filter.

    Tokens are ordered rarest first; sets as similar as asked share a token among their first n - ceil(least n) + 1.
    Records with equal token sets are one entry in the join and are linked to it by a star afterwards.
    """
    sets = records.select(key, F.array_sort(tokens).alias("t")).filter(F.size("t") > 0)
    heads = sets.groupBy("t").agg(F.min(key).alias("id"))
    df = heads.select(F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    ranked = heads.select("id", "t", F.size("t").alias("n"), F.explode("t").alias("token")).join(df, "token")
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "token"))
    prefix = ranked.withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least) + 1)
    a = prefix.select("token", F.col("id").alias("a"), F.col("n").alias("na"), F.col("t").alias("ta"))
    b = prefix.select("token", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("t").alias("tb"))
    near = a.join(b, "token").filter((F.col("a") < F.col("b")) & (F.col("na") >= least * F.col("nb")) & (F.col("nb") >= least * F.col("na")))
    near = near.withColumn("shared", F.size(F.array_intersect("ta", "tb"))).filter(F.col("shared") >= least * (F.col("na") + F.col("nb") - F.col("shared")))
    return near.select("a", "b", "shared").distinct()


def expand_equal_sets(pairs: DataFrame, records: DataFrame, tokens: str = "content", key: str = "record_id") -> DataFrame:
    """Adds to the pairs of ``jaccard_join`` the link of every record to the first with the same token set."""
    return pairs.select("a", "b").union(stars(records.select(key, F.array_sort(tokens).alias("t")).filter(F.size("t") > 0), ["t"], key))


def jaccard_lookup(queries: DataFrame, pool: DataFrame, least: float, tokens: str = "content", key: str = "record_id") -> DataFrame:
    """``q, r``: all pairs of a query and a pool record with a token Jaccard of at least ``least``, by prefix filter.

    Tokens are ordered by their number in the pool, rarest first (those it lacks come before all others), so that common
    tokens are met only by sets that have few others. Equal token sets are one entry on either side of the join.
    """
    sets = lambda df: df.select(F.col(key).alias("id"), F.array_sort(tokens).alias("t")).filter(F.size("t") > 0)
    df = sets(pool).select(F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("t").orderBy("df", "token"))
    sides = []
    for rows in (queries, pool):
        each = sets(rows).select("t").distinct().select("t", F.size("t").alias("n"), F.explode("t").alias("token")).join(df, "token", "left").fillna(0, ["df"])
        sides.append(each.withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select("token", "n", "t"))
    a, b = sides[0].toDF("token", "na", "ta"), sides[1].toDF("token", "nb", "tb")
    near = a.join(b, "token").filter((F.col("na") >= least * F.col("nb")) & (F.col("nb") >= least * F.col("na"))).select("ta", "tb", "na", "nb").distinct()
    shared = F.size(F.array_intersect("ta", "tb"))
    near = near.filter(shared >= least * (F.col("na") + F.col("nb") - shared)).select("ta", "tb")
    return near.join(sets(queries).toDF("q", "ta"), "ta").join(sets(pool).toDF("r", "tb"), "tb").select("q", "r")


def _sets(records: DataFrame, tokens: str, key: str, scratch: storage.Scratch) -> tuple[DataFrame, DataFrame]:
    """(``head, t, n`` of each distinct token set, ``head, id, shared`` of its records), written."""
    sets = scratch.cut(records.select(F.col(key).alias("id"), F.array_sort(tokens).alias("t")).filter(F.size("t") > 0), "sets")
    heads = scratch.cut(sets.groupBy("t").agg(F.min("id").alias("head"), F.count("*").alias("n")), "set-heads")
    members = storage.join_by_size(sets, heads, "t", "n", sets.count()).select("head", "id", F.size("t").alias("shared"))
    return heads, scratch.cut(members, "set-members")


def jaccard_across(records: DataFrame, least: float = 0.5, tokens: str = "content", key: str = "record_id", scratch: storage.Scratch | None = None, sets: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``a, b, shared``: all pairs of records of different token sets with a token Jaccard of at least ``least``.

    Sets are compared once each; their records are joined on at the end, so the rows are as many as the pairs.
    """
    heads, members = sets or _sets(records, tokens, key, scratch or storage.Scratch(records.sparkSession, "jaccard"))
    a, b = (members.select(F.col("head").alias(side), F.col("id").alias(name)) for side, name in (("a", "p"), ("b", "q")))
    near = jaccard_join(heads.select(F.col("head").alias(key), F.col("t").alias(tokens)), least, tokens, key)
    return near.join(a, "a").join(b, "b").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "shared")


def jaccard_all(records: DataFrame, least: float = 0.5, tokens: str = "content", key: str = "record_id") -> DataFrame:
    """``a, b, shared``: the pairs of ``jaccard_join`` between all records, also those of equal token sets."""
    sets = _sets(records, tokens, key, storage.Scratch(records.sparkSession, "jaccard"))
    widths = sets[0].filter("n > 1").select("head", F.size("t").alias("shared"))
    inside = pairs_within(sets[1].select("head", "id"), "head", "id").join(widths, "head").select("p", "q", "shared")
    return jaccard_across(records, least, tokens, key, sets=sets).union(inside)


def equal(records: DataFrame, on: str, key: str = "record_id") -> DataFrame:
    """``a, b``: all pairs of equal values; nulls are equal to nothing."""
    return pairs_within(records.filter(F.col(on).isNotNull()).select(on, key), on, key).select(F.col("p").alias("a"), F.col("q").alias("b"))


def vector_join(records: DataFrame, least: float, key: str = "record_id", vector: str = "vector", block: int = tiles.TILE, other: DataFrame | None = None) -> DataFrame:
    """``a, b, cosine``: all pairs of at least ``least`` (above 0), exactly, by matrix products of tiles of ``block`` rows.

    Every two tiles are one product; with ``other``, each tile of the first table meets each of the second, and ``a`` is
    the first table's. Null and zero vectors take no part, and vectors of different width don't match. The products grow
    as the square of the rows, but no row is copied to disk for them.
    """
    held = lambda df: df.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    return tiles.near(held(records), None if other is None else held(other), least, storage.Scratch(records.sparkSession, "vectors"), block)


def complete(records: DataFrame, vectors: DataFrame | None = None, key: str = "record_id", copies: bool = False, least: float = 0.5) -> DataFrame:
    """``a, b, cosine``: every pair whose score can reach 0.675: equal, same question, token Jaccard of ``least`` or more, cosine of 0.96 or more.

    With ``vectors`` (one row per key) the lexical pairs carry their cosine too, as it can raise their score; 0.96 is
    the limit of pairs that nothing but their vectors supports. Records that agree in all that is scored meet the others
    as one, linked to the first of them by a star; with ``copies`` each of them has all of its pairs.
    """
    scratch = storage.Scratch(records.sparkSession, "complete")
    rows = records if vectors is None else records.join(vectors.select(key, "vector"), key, "left")
    links = None
    if not copies:
        same = F.md5(F.to_json(F.struct(*[c for c in ("front_norm", "back_norm", "vendor", "vector") if c in rows.columns])))
        links = scratch.cut(stars(scratch.cut(rows.select(key, same.alias("same")), "same"), ["same"], key), "links")
        rows = rows.join(links.select(F.col("b").alias(key)), key, "left_anti")
    rows = scratch.cut(rows.select(key, "fingerprint", "front_norm", "semantic_key", "content", *[c for c in ("vector",) if c in rows.columns]), "rows")
    # equal values of any kind in one join; what they are is told apart by a letter in front
    named = lambda tag, c: F.when(c.isNotNull() & (c != ""), F.md5(F.concat(F.lit(tag), c)))
    values = F.array_compact(F.array(named("p", F.col("fingerprint")), named("f", F.col("front_norm")), named("q", F.col("semantic_key")), named("t", F.array_join(F.array_sort("content"), " "))))
    keys = scratch.cut(rows.select(F.explode(values).alias("value"), F.col(key).alias("id")), "values")
    pairs = pairs_within(keys, "value", "id").select(F.col("p").alias("a"), F.col("q").alias("b")).union(jaccard_across(rows, least, key=key, scratch=scratch).select("a", "b"))
    pairs = scratch.cut((pairs if links is None else pairs.union(links)).distinct(), "pairs").withColumn("cosine", F.lit(None).cast("double"))
    return pairs if vectors is None else with_cosine(pairs.unionByName(vector_join(rows.select(key, "vector"), 0.96, key)), vectors, key)


def with_cosine(pairs: DataFrame, vectors: DataFrame, key: str = "record_id", vector: str = "vector") -> DataFrame:
    """``a, b, cosine``, one row per pair: the known cosine, else that of the two vectors; null if one has none."""
    found = pairs.groupBy("a", "b").agg(F.max("cosine").alias("known"))
    some = vectors.filter(F.col(vector).isNotNull())
    a, b = (some.select(F.col(key).alias(side), F.col(vector).alias(f"v{side}")) for side in "ab")
    own = F.when(F.col("va").isNotNull() & F.col("vb").isNotNull(), scores.cosine(F.col("va"), F.col("vb")))
    return found.join(a, "a", "left").join(b, "b", "left").select("a", "b", F.coalesce("known", own).alias("cosine"))
