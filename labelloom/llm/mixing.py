"""Mix sources to target weights by Pfair scheduling with earliest deadlines first.

A source with share q of a period of Q slots has its block k released at floor(k * Q / q) and due at
ceil((k + 1) * Q / q). Taking, slot by slot, the released block with the earliest deadline meets every
deadline, so no source is ever a whole block away from its share. Shares are whole numbers and the
schedule repeats after Q slots, so a block finds its slot from its number alone. A source that runs out leaves
its slots to the others.

One period is worked out in SQL. Sources of equal share have the same release times and deadlines and take
turns in the order of their names, so what is scheduled are classes of equal share: there are less than
sqrt(2 Q) of them, whatever the number of sources. The period grows with that number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelloom.operators.scale import materialize

# Slots of a period, and as many per source at least.
PERIOD = 1_000
SLOTS_PER_SOURCE = 8
# Slots that are put together before they go to the list of all.
RUN_SLOTS = 256
# Cycles that one row of a table of cycles is drawn up for.
RUN_CYCLES = 100_000
# Rows of one source that are ranked together.
BUCKET_ROWS = 1_024


def free_name(df: DataFrame, name: str) -> str:
    """The name with as many underscores in front as it takes to clash with no column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def source_shares(docs: DataFrame, source: Column, shares: dict[str | None, int] | None, power: float, period: int) -> DataFrame:
    """(source, rows, share), one row per source, a null source being one of its own.

    Given shares are taken as they are (a source not named gets 1). Without any, a source's share of the
    period grows with its number of rows to ``power``, rounded, 1 at least; the period has ``period`` slots, or
    SLOTS_PER_SOURCE per source where that is more.
    """
    sizes = docs.groupBy(source.alias("source")).agg(F.count("*").alias("rows"))
    if shares is not None:
        share = F.lit(1).cast("long")
        for name, value in shares.items():
            if int(value) < 1:
                raise ValueError(f"share of {name!r} must be 1 or more")
            share = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(int(value)).cast("long")).otherwise(share)
        return sizes.withColumn("share", share)
    weight = F.pow(F.col("rows").cast("double"), F.lit(power))
    every = Window.partitionBy(F.lit(0))
    slots = F.greatest(F.lit(period), F.count("*").over(every) * SLOTS_PER_SOURCE).cast("double")
    share = F.greatest(F.lit(1).cast("long"), F.round(slots * weight / F.sum(weight).over(every)).cast("long"))
    return sizes.select("source", "rows", share.alias("share"))


def period_schedule(sources: DataFrame) -> DataFrame:
    """(source, turn, slot, share, period): the slots of one period, ``turn`` counting a source's blocks in it.

    Among released blocks the earliest deadline is taken, then the first source by name. One row holds the
    classes of equal share, a few numbers each, while the slots are dealt out.
    """
    named = sources.select("source", "share", F.row_number().over(Window.orderBy(F.coalesce("source", F.lit("")), "source")).alias("place"))
    place = Window.partitionBy("share").orderBy("place")
    members = named.withColumns({"member": F.row_number().over(place) - 1, "members": F.count("*").over(Window.partitionBy("share"))})
    one = (
        members.groupBy("share")
        .agg(F.array_sort(F.collect_list("place")).alias("places"))
        .agg(F.array_sort(F.collect_list(F.struct("share", "places"))).alias("list"))
        .selectExpr(
            "transform(list, c -> c.share) AS shares",
            "transform(list, c -> c.places) AS places",
            "transform(list, c -> CAST(size(c.places) AS BIGINT)) AS sizes",
            "aggregate(list, 0L, (a, c) -> a + c.share * size(c.places)) AS period",
            "aggregate(list, 1L, (a, c) -> a + size(c.places)) AS base",
        )
        .where("period > 0")
    )
    # Written, or Spark would work these arrays out anew for every slot.
    one = materialize(one, "share-classes")
    # The number of a class's next block, and of the next source of the class; deadline and source as one number.
    due = "((done DIV size + 1) * period + share - 1) DIV share * base + element_at(places[i], CAST(done % size AS INT) + 1)"
    for name, value in (("done", "acc.done[i]"), ("size", "sizes[i]"), ("share", "q")):
        due = due.replace(name, value)
    choice = f"array_min(transform(shares, (q, i) -> IF((acc.done[i] DIV sizes[i] * period) DIV q <= t, {due}, NULL)))"
    picked = "(q, i) -> IF((acc.done[i] DIV sizes[i] * period) DIV q <= t AND {due} = best, 1L, 0L)".format(due=due)
    # What a step gives is copied by the next one, so slots are dealt out run by run.
    empty = "CAST(array() AS ARRAY<BIGINT>)"
    one_run = f"""
        aggregate(
            sequence(r * {RUN_SLOTS}, least((r + 1) * {RUN_SLOTS}, period) - 1),
            named_struct('done', outer.done, 'run', {empty}),
            (acc, t) -> transform(array({choice}), best -> named_struct(
                'done', zip_with(acc.done, transform(shares, {picked}), (n, x) -> n + x), 'run', concat(acc.run, array(best % base))))[0])
    """
    slots = one.selectExpr(
        "period",
        f"""
        aggregate(
            sequence(0L, (period - 1) DIV {RUN_SLOTS}),
            named_struct('done', transform(shares, q -> 0L), 'runs', CAST(array() AS ARRAY<ARRAY<BIGINT>>)),
            (outer, r) -> transform(array({one_run}), x -> named_struct('done', x.done, 'runs', concat(outer.runs, array(x.run))))[0],
            outer -> outer.runs
        ) AS runs
        """,
    )
    dealt = slots.select("period", F.posexplode("runs").alias("run", "in_run")).select(
        "period", "run", F.posexplode("in_run").alias("at", "place")
    ).selectExpr("period", f"CAST(run AS BIGINT) * {RUN_SLOTS} + at AS slot", "place")
    turn = F.row_number().over(Window.partitionBy("place").orderBy("slot")) - 1
    return dealt.withColumn("turn", turn.cast("long")).join(named, "place").select("source", "turn", "slot", "share", "period")


def rows_before_cycles(sources: DataFrame, block_rows: int) -> DataFrame:
    """(cycle, earlier): rows of all sources in the periods before each one, as long as a source has any left.

    A source fills its share of each period until it runs out, so between two periods in which sources run out
    the number grows evenly: one row per such stretch is drawn out to its cycles.
    """
    per_cycle = F.col("share") * block_rows
    ends = sources.select("rows", per_cycle.alias("per"), (F.floor(F.col("rows") / per_cycle) + 1).alias("until"))
    steps = ends.groupBy("until").agg(F.sum("rows").alias("rows"), F.sum("per").alias("per"))
    earlier = Window.orderBy("until").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy("until").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    stretches = steps.select(
        F.coalesce(F.lag("until").over(Window.orderBy("until")), zero).alias("first"), "until",
        F.coalesce(F.sum("rows").over(earlier), zero).alias("gone"), F.sum("per").over(later).alias("per"),
    )
    runs = stretches.withColumn("start", F.explode(F.expr(f"sequence(first, until - 1, {RUN_CYCLES}L)")))
    cycles = runs.withColumn("cycle", F.explode(F.expr(f"sequence(start, least(start + {RUN_CYCLES}L, until) - 1)")))
    return cycles.select("cycle", (F.col("gone") + F.col("per") * F.col("cycle")).alias("earlier"))


def mix(
    docs: DataFrame,
    shares: dict[str | None, int] | None = None,
    block_rows: int = 1,
    power: float = 0.5,
    period: int = PERIOD,
    key: str = "doc_id",
    source: str = "source",
    into: str = "mix",
) -> DataFrame:
    """All rows with a struct column ``into``: (block, release, deadline, slot, position).

    Within a source rows are ordered by the md5 of their key and cut into blocks of ``block_rows``.
    ``position`` numbers all rows from 0 in mixed order: before any position, as long as no source has run
    out, each source has its share to within less than one block. Every row is kept exactly once. A null
    source is a source of its own, a null key comes first in its source, equal rows are rows of their own,
    in any order. An existing column of the name ``into`` stays and the new one gets underscores in front.
    An empty table gives an empty one.

    Rows of a source are ranked in buckets of about BUCKET_ROWS by the hash, with counted offsets, so a
    source that holds most rows is spread over many tasks. A row's position is the number of rows in earlier
    periods, which follows from the sizes of the sources, and its rank in its period. Sources and slots are
    tables that Spark broadcasts or shuffles by their size.
    """
    into, name, bits, bucket, rank = (free_name(docs, c) for c in (into, "_source", "_bits", "_bucket", "_rank"))
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    rows = docs.withColumn(name, F.col(source).cast("string")).withColumn(
        bits, F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    )
    sources = materialize(source_shares(rows, F.col(name), shares, power, period), "sources")
    schedule = materialize(period_schedule(sources), "schedule")

    def same(left: Column, right: Column) -> Column:
        return left.eqNullSafe(right)

    sized = sources.select(
        F.col("source").alias("_name"), F.ceil(F.col("rows") / BUCKET_ROWS).cast("long").alias("_buckets"), F.col("share").alias("_share")
    )
    cut = (
        rows.join(sized, same(F.col(name), F.col("_name")))
        .withColumn(bucket, F.shiftright(F.col(bits) * F.col("_buckets"), 32))
        .drop("_name", "_buckets")
    )
    counted = cut.groupBy(F.col(name).alias("_name"), F.col(bucket).alias("_place")).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_name").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("_name", "_place", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(name, bucket).orderBy(bits, digest, key)
    ranked = (
        cut.withColumn(rank, F.row_number().over(within) - 1)
        .join(offsets, same(F.col(name), F.col("_name")) & (F.col(bucket) == F.col("_place")))
        .withColumn(rank, F.col(rank) + F.col("_before"))
        .drop("_name", "_place", "_before")
    )
    slots = schedule.drop("share").withColumnsRenamed({c: f"_s_{c}" for c in ("source", "turn", "slot", "period")})
    with_turn = (
        ranked.withColumn("_block", F.floor(F.col(rank) / block_rows))
        .withColumn("_cycle", F.floor(F.col("_block") / F.col("_share")))
        .withColumn("_turn", F.col("_block") % F.col("_share"))
    )
    placed = with_turn.join(slots, same(F.col(name), F.col("_s_source")) & (F.col("_turn") == F.col("_s_turn")))
    before = rows_before_cycles(sources, block_rows).toDF("_c", "_earlier")
    in_cycle = F.row_number().over(Window.partitionBy("_cycle").orderBy("_s_slot", rank)) - 1
    positioned = placed.withColumn("_in_cycle", in_cycle).join(before, F.col("_cycle") == F.col("_c"))
    schedule_of = F.struct(
        F.col("_block").alias("block"),
        F.expr("_cycle * _s_period + (_turn * _s_period) DIV _share").alias("release"),
        F.expr("_cycle * _s_period + ((_turn + 1) * _s_period + _share - 1) DIV _share").alias("deadline"),
        F.expr("_cycle * _s_period + _s_slot").alias("slot"),
        (F.col("_earlier") + F.col("_in_cycle")).alias("position"),
    )
    return positioned.select(*[F.col(f"`{c}`") for c in docs.columns], schedule_of.alias(into))


# Metadata of the key column of a table whose files hold the rows in the order of the mixture.
ORDERED = {"rows": "in mixed order"}


def in_mixed_order(docs: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of ``docs`` in the order of the mixture (see ``mix``).

    Rows get numbers and are written; numbers, keys and sources are mixed, and the positions go back to the rows by
    their numbers. Other columns are moved by that join, where Spark does not broadcast the positions, and by the
    sort. The key column says so in its metadata, which Parquet files keep: ``file_positions`` reads the order back.
    """
    row, position = free_name(docs, "_row"), free_name(docs, "_position")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-rows")
    mixed = mix(numbered.select(F.col(row).alias("row"), F.col(key).alias("key"), F.col(source).alias("source")), key="key", source="source")
    positions = materialize(mixed.select(F.col("row").alias(row), F.col("mix.position").alias(position)), "positions")
    ordered = numbered.join(positions, row).orderBy(position)
    return ordered.select(*[F.col(f"`{c}`").alias(c, metadata=ORDERED) if c == key else F.col(f"`{c}`") for c in docs.columns])


def is_ordered(docs: DataFrame, key: str = "doc_id") -> bool:
    """Whether ``docs`` is one written table of rows in mixed order; a plan that joins tables has several folders."""
    marked = docs.schema[key].metadata.items() >= ORDERED.items()
    return marked and len({path.rsplit("/", 1)[0] for path in docs.inputFiles()}) == 1


def with_file_places(docs: DataFrame, file: str, row: str) -> DataFrame:
    """A written table plus the file of each row and the row's number in it."""
    return docs.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(row))


def file_positions(rows: DataFrame, file: str, row: str, position: str) -> DataFrame:
    """Rows with ``position`` in place of ``file`` and ``row``: writers number their files in the order of the rows."""
    number = F.regexp_extract(file, r"part-(\d+)", 1).cast("long")
    earlier = Window.orderBy(number, file).rowsBetween(Window.unboundedPreceding, -1)
    # one row per file
    sizes = rows.groupBy(file).agg((F.max(row) + 1).alias("_n"))
    starts = sizes.select(file, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    return rows.join(starts, file).withColumn(position, F.col("_first") + F.col(row)).drop("_first", file, row)


ORACLE_SQL = f"""
WITH RECURSIVE sizes AS (
    SELECT source, count(*) AS n FROM documents GROUP BY source
), shares AS (
    SELECT source, n,
           greatest(1, CAST(round(greatest({float(PERIOD)}, {SLOTS_PER_SOURCE} * (SELECT count(*) FROM sizes)) * sqrt(n::DOUBLE) / (SELECT sum(sqrt(n::DOUBLE)) FROM sizes)) AS BIGINT)) AS q,
           row_number() OVER (ORDER BY coalesce(source, '')) AS i
    FROM sizes
), total AS (
    SELECT CAST(sum(q) AS BIGINT) AS p, list(q ORDER BY i) AS qs, list(n ORDER BY i) AS ns FROM shares
), edf AS (
    SELECT CAST(0 AS BIGINT) AS t, list_transform(qs, lambda q: CAST(0 AS BIGINT)) AS done, CAST(NULL AS BIGINT) AS pick,
           CAST(NULL AS BIGINT[]) AS before
    FROM total
    UNION ALL
    SELECT t + 1, list_transform(done, lambda n, i: n + CASE WHEN i = c THEN 1 ELSE 0 END), c, done
    FROM (
        SELECT t, done, list_min(list_transform(qs, lambda q, i: CASE
                   WHEN (done[i] * p) // q <= t THEN (((done[i] + 1) * p + q - 1) // q) * 10000000 + i END)) % 10000000 AS c
        FROM edf, total WHERE t < p
    )
), slots AS (
    SELECT t - 1 AS slot, pick AS i, before, before[pick] AS turn FROM edf WHERE pick IS NOT NULL
), ranked AS (
    SELECT d.doc_id, d.source, s.i, s.q,
           row_number() OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id) - 1 AS r
    FROM documents d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source
)
SELECT r.doc_id, r.source, r.r AS block,
       (r.r // r.q) * p + ((r.r % r.q) * p) // r.q AS release,
       (r.r // r.q) * p + ((r.r % r.q + 1) * p + r.q - 1) // r.q AS deadline,
       (r.r // r.q) * p + s.slot AS slot,
       CAST(list_sum(list_transform(ns, lambda n, i: least(n, (r.r // r.q) * qs[i] + s.before[i]))) AS BIGINT) AS position
FROM ranked r JOIN slots s ON r.i = s.i AND r.r % r.q = s.turn, total
"""
