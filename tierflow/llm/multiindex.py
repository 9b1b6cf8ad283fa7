"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments, each with an index of its own. A step looks up, in one
segment, all values at one more bit from a query's segment. With segment s searched
to radius r_s, every code within sum(r_s + 1) - 1 bits has been met: one farther
away in all segments would lie beyond that. A query is finished as soon as the
distance of its k-th verified neighbour is covered, and until then that distance
bounds what a look-up returns.

An entry of an index is a chunk of the codes with one value, so that a look-up is
verified where it is made, and a value that very many codes have is several entries.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierflow.shared import stored

#: Bits of a segment at most; two less than the logarithm of the number of codes is used below that.
WIDEST = 16
#: Codes of a chunk, about.
CHUNK = 256


def segment_widths(dims: int, width: int) -> list[int]:
    """Widths of segments of about ``width`` bits that make up ``dims`` bits evenly."""
    n = max(1, round(dims / width), -(-dims // 31))
    return [dims // n + (k < dims % n) for k in range(n)]


def binary_codes(vectors: DataFrame, id_col: str, vector_col: str, widths: list[int]) -> DataFrame:
    """``id, code``: the signs of the components (positive is 1) as an array of segments of these many bits.

    Rows with a null id or vector, or another number of components, have no code. Of
    several rows with one id the smallest code counts.
    """
    positive = lambda k: F.coalesce(F.element_at(vector_col, k + 1), F.lit(0)) > 0
    starts = [sum(widths[:s]) for s in range(len(widths))]
    segments = [sum((F.when(positive(start + b), F.lit(1 << b)).otherwise(0) for b in range(width)), F.lit(0)) for start, width in zip(starts, widths)]
    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(vector_col) == sum(widths))).select(F.col(id_col).alias("id"), F.array(*segments).alias("code"))
    return rows.groupBy("id").agg(F.min("code").alias("code"))


def _distance(a: str, b: str, segments: int) -> str:
    return " + ".join(f"bit_count({a}[{s}] ^ {b}[{s}])" for s in range(segments))


def _index(codes: DataFrame, segments: int) -> DataFrame:
    """``segment, value, chunk``: chunks of the codes (code, first, n) that have the value in the segment."""
    entries = codes.select(F.posexplode("code").alias("segment", "value"), F.struct("code", "first", "n").alias("entry"))
    # values with more codes than a chunk holds are dealt to several
    many = entries.groupBy("segment", "value").count().where(F.col("count") > CHUNK).select("segment", "value", F.ceil(F.col("count") / CHUNK).alias("parts"))
    part = F.pmod(F.xxhash64("entry.code"), F.coalesce("parts", F.lit(1)))
    return entries.join(many, ["segment", "value"], "left").groupBy("segment", "value", part.alias("part")).agg(F.collect_list("entry").alias("chunk")).drop("part")


def _search(rows: DataFrame, dims: int, k: int, is_query: str, width: int) -> DataFrame:
    """:func:`nearest_codes` among codes of ``dims`` bits."""
    spark, widths = rows.sparkSession, segment_widths(dims, width)
    segments = len(widths)
    # the smallest ids of each code; a task ships no more than that of each
    by_code = Window.partitionBy("code").orderBy("id")
    members = stored(rows.withColumn("n", F.row_number().over(by_code)).where(F.col("n") <= k + 1).select("code", "id"), "members")
    codes = members.groupBy("code").agg(F.min("id").alias("first"), F.count("*").cast("int").alias("n"))
    index = stored(_index(codes, segments), "index")
    values = {r.segment: r.n for r in index.groupBy("segment").agg(F.count_distinct("value").alias("n")).collect()}  # a row for each segment
    entry = f"array<struct<distance:int,first:{rows.schema['id'].dataType.simpleString()},code:array<int>,n:int>>"
    # the k-th other id's distance: ids at or before it number k and the query itself
    bound = f"""aggregate(near, named_struct('have', 0, 'd', cast(null as int)),
                (s, e) -> named_struct('have', s.have + e.n, 'd', coalesce(s.d, if(s.have + e.n > {k}, e.distance, null))), s -> coalesce(s.d, {dims}))"""
    active = rows.where(is_query).select(F.col("code").alias("q")).distinct().select("q", F.expr(f"cast(array() as {entry})").alias("near"), F.lit(dims).alias("bound"))
    finished = []
    radii = [-1] * segments
    while min(r - w for r, w in zip(radii, widths)) < 0:
        # radii 0 and 1 have few values and are looked up in all segments at once, larger ones in one segment at a time
        radius = min(radii) + 1
        of = [s for s in range(segments) if radii[s] < radius <= widths[s]]
        of = of if radius < 2 else of[:1]
        probes = None
        for s in of:
            radii[s] = radius
            asked = active.select("q", "bound", F.lit(s).alias("segment"), F.expr(f"q[{s}]").alias("own"))
            if comb(widths[s], radius) <= values[s]:
                masks = [(s, sum(1 << b for b in bits)) for bits in combinations(range(widths[s]), radius)]  # no more than the values of a segment
                masks = F.broadcast(spark.createDataFrame(masks, "segment int, mask int"))
                hit = asked.join(masks, "segment").select("q", "bound", "segment", F.expr("own ^ mask").alias("value")).join(index, ["segment", "value"])
            else:  # fewer values than masks: those at the radius are picked from the values
                hit = asked.join(index, "segment").where(f"bit_count(own ^ value) = {radius}")
            hit = hit.select("q", "bound", "chunk")
            probes = hit if probes is None else probes.union(hit)
        # only what is within the bound, and of each chunk no more than can matter, leaves a look-up
        measured = f"transform(chunk, c -> named_struct('distance', {_distance('q', 'c.code', segments)}, 'first', c.first, 'code', c.code, 'n', c.n))"
        within = F.expr(f"slice(array_sort(filter({measured}, c -> c.distance <= bound)), 1, {k + 1})")
        order = Window.partitionBy("q").orderBy("c")
        found = probes.select("q", F.explode(within).alias("c")).distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
        found = found.groupBy("q").agg(F.collect_list("c").alias("new"))
        merged = active.join(found, "q", "left").select("q", F.expr(f"slice(array_sort(array_union(near, coalesce(new, cast(array() as {entry})))), 1, {k + 1})").alias("near"))
        state = stored(merged.withColumn("bound", F.expr(bound)), "nearest")
        covered = sum(r + 1 for r in radii) - 1
        finished.append(state.where(F.col("bound") <= covered))
        active = state.where(F.col("bound") > covered)
        if not active.limit(1).count():
            break
    for part in finished:
        active = active.unionByName(part)  # what is still active has fewer than k others in all
    met = active.select("q", F.explode("near").alias("c")).select("q", "c.code", "c.distance").join(members, "code")
    asking = rows.where(is_query).select(F.col("id").alias("query_id"), F.col("code").alias("q"))
    pairs = asking.join(met, "q").where("id <> query_id")
    ranked = Window.partitionBy("query_id").orderBy("distance", "id")
    return pairs.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("neighbour_id"), "distance")


def nearest_codes(vectors: DataFrame, k: int, is_query: str, id_col: str = "vec_id", vector_col: str = "embedding", width: int | None = None) -> DataFrame:
    """The k nearest ids of each query by Hamming distance of their codes: ``query_id, rank, neighbour_id, distance``.

    ``is_query`` is a condition on ``id``. An id is not its own neighbour; ties go to
    the smaller id; fewer than k others give fewer neighbours. Repeated rows of an id
    are one, by the smallest of their codes. Rows with a null id, a null or an empty
    vector are neither queries nor neighbours; vectors of different lengths are
    searched apart, as they have no distance. Extra columns are not read; an empty
    table gives no rows.

    Equal codes are one entry with at most k + 1 of their ids, so a very common
    vector is no hot key.
    """
    spark = vectors.sparkSession
    sizes = vectors.where(F.col(id_col).isNotNull() & (F.size(vector_col) > 0)).groupBy(F.size(vector_col).alias("dims")).count().orderBy("dims").collect()  # a row for each length
    out = spark.createDataFrame([], f"query_id {vectors.schema[id_col].dataType.simpleString()}, rank int, neighbour_id {vectors.schema[id_col].dataType.simpleString()}, distance int")
    for dims, n in sizes:
        bits = width or max(4, min(WIDEST, n.bit_length() - 3))
        rows = stored(binary_codes(vectors, id_col, vector_col, segment_widths(dims, bits)), "codes")
        out = out.unionByName(_search(rows, dims, k, is_query, bits))
    return out
