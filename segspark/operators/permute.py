"""Permutation null: shuffle who lives where, keep both margins, measure again."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segspark.session import scratch_dir


def expand_counts(df: DataFrame, keys: Sequence[str], value: str, out: str = "k",
                  chunk: int = 4096, copies: tuple[str, int] | None = None) -> DataFrame:
    """One row per counted individual, numbered ``1..value`` within its row.

    A large count is first cut into chunks and the chunks are spread over the tasks, so one
    huge unit is expanded by many tasks. ``copies=(column, n)`` repeats everything n times
    before the spread (numbers 0..n-1).
    """
    if out in keys:
        raise ValueError(f"{out} is already a key")
    rows = df.where(F.col(value) > 0).select(*keys, F.col(value).cast("long").alias("_v"))
    rows = rows.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_v") - 1) / chunk))))
    spread = [*keys, "_c"]
    if copies:
        name, n = copies
        rows = rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        spread.append(name)
    rows = rows.repartition(*[F.col(c) for c in spread])
    last = F.least(F.col("_v"), (F.col("_c") + 1) * chunk)
    rows = rows.withColumn(out, F.explode(F.sequence(F.col("_c") * chunk + 1, last)))
    return rows.drop("_v", "_c")


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def permuted_cells(cells: DataFrame, strata: Sequence[str], leaf: str, group: str, value: str,
                   n_sims: int, seed: int, carry: Sequence[str] = (),
                   bucket_rows: int = 250_000, block: int = 4_096, spread: float = 6.0, counted: bool = True, wide: Sequence[str] | None = None) -> DataFrame:
    """Counts per (sim, stratum, leaf, group) after a random pairing of people and places.

    Everybody of a leaf gets a rank by the digest of (seed, sim, leaf, number), and the groups
    take the ranks in turn, each as many as it counts. The digest makes the draw the same on
    every run, whatever the partitioning, and after a lost executor.

    No row of a person is exchanged or sorted. A group begins at one digest, its mark; with the marks known, a person's group
    follows from the own digest. Digests lie evenly, so a mark lies near its share of all digests: one pass counts the
    digests between the places where marks may lie (``spread`` standard deviations to either side, about sqrt(N) of a
    stratum's N people) and keeps only the digests in these places, whose ranks follow from a running sum. A mark that lies
    elsewhere is found from all digests of its simulation and stratum. A second pass makes the digests again and compares.

    Leaves are spread over tasks before they are expanded, those above ``block`` people in pieces; a task counts about ``bucket_rows``
    pairs of leaf and simulation. ``carry`` are columns of the leaf (such as its mid) to keep. ``counted=False`` leaves one row
    per person with value 1. ``wide`` lists groups: one row per (sim, stratum, leaf) with a column for
    each of them, NULL where it has nobody. Rows without a stratum are left out.
    """
    strata, carry = list(strata), list(carry)
    spark = cells.sparkSession
    keys = [*strata, leaf, *carry]
    filled = _stored(cells.where(F.col(value) > 0).select(*dict.fromkeys([*keys, group]), F.col(value).cast("long").alias("_n")), "filled")
    # People with one digest (of a leaf given with two mids) are told apart by what the leaf carries.
    tie = F.to_json(F.struct(*carry), {"ignoreNullFields": "false"}) if carry else F.lit("")
    leaves = filled.groupBy(*keys).agg(F.sum("_n").alias("_v")).withColumn("_t", tie)
    margins = filled.groupBy(*strata, group).agg(F.sum("_n").alias("_n"))
    # One row per stratum: its groups in order, and how many people come before each group but the first.
    w = Window.partitionBy(*strata).orderBy(group)
    before = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1))
    ordered = margins.select(*strata, group, "_n", F.coalesce(before, F.lit(0)).alias("_from"))
    tops = _stored(ordered.groupBy(*strata).agg(
        F.sum("_n").alias("_N"), F.sort_array(F.collect_list(F.struct("_from", group))).alias("_g")
    ).select(*strata, "_N", F.col(f"_g.{group}").alias("_groups"), F.col("_g._from").alias("_from")), "strata")
    most, n_leaves = (tops.agg(F.max(F.size("_from"))).first()[0] or 1), leaves.count()
    parts = max(4 * spark.sparkContext.defaultParallelism, -(-n_leaves * n_sims // bucket_rows))

    def spread_out(rows: DataFrame) -> DataFrame:
        """Pieces of at most ``block`` people, numbered ``_lo`` to ``_hi``."""
        rows = rows.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_v") - 1) / block))))
        rows = rows.withColumn("_lo", F.col("_c") * block + 1).withColumn("_hi", F.least("_v", (F.col("_c") + 1) * block))
        return rows.drop("_c", "_v")

    def people(rows: DataFrame, sims: DataFrame, *more: str) -> DataFrame:
        """One row per person and simulation with the digest; ``sims`` has per stratum the array ``_sims`` of structs."""
        rows = rows.join(sims, strata).select(*keys, "_lo", "_hi", "_t", *more, F.inline("_sims"))
        rows = rows.withColumn("_p", F.concat(F.concat_ws("|", F.lit(str(seed)), F.col("sim"), F.col(leaf)), F.lit("|")))
        rows = rows.withColumn("_k", F.explode(F.sequence("_lo", "_hi")))
        digest = F.md5(F.concat("_p", F.col("_k").cast("string")))
        return rows.withColumn("_ord", F.concat(digest, "_t") if carry else digest)

    def passed(marks: str) -> Column:
        """How many of the marks do not come after the digest."""
        if most > 32:
            return F.size(F.filter(marks, lambda m: m <= F.col("_ord")))
        return sum((F.coalesce((F.get(marks, F.lit(i)) <= F.col("_ord")).cast("int"), F.lit(0)) for i in range(most - 1)), F.lit(0))

    # Places where marks may lie, as hex digits; "g" comes after all digests.
    share = lambda b: b / F.col("_N")
    reach = lambda b: F.sqrt(share(b) * (1 - share(b)) / F.col("_N")) * spread
    digits = lambda x: F.when(x >= 1, F.lit("g")).otherwise(F.lower(F.lpad(F.hex(F.floor(F.greatest(x, F.lit(0.0)) * 2.0**32)), 8, "0")))
    later = F.slice("_from", 2, F.greatest(F.size("_from") - 1, F.lit(0)))
    numbers = F.transform(F.sequence(F.lit(0), F.lit(n_sims - 1)), lambda s: F.struct(s.alias("sim")))
    places = tops.select(*strata, numbers.alias("_sims"), F.transform(later, lambda b: digits(share(b) - reach(b))).alias("_low"),
                         F.transform(later, lambda b: digits(share(b) + reach(b))).alias("_high"))
    pieces = spread_out(leaves).repartition(parts, *keys, "_lo")
    tried = people(pieces, places, "_low", "_high")
    # A place is left when its upper end has been passed; before the next one, digests are only counted.
    tried = tried.withColumn("_in", passed("_low")).withColumn("_out", passed("_high"))
    at = F.when(F.col("_in") > F.col("_out"), F.col("_ord")).when(F.col("_out") > 0, F.get("_high", F.col("_out") - 1)).otherwise(F.lit(""))
    tally = tried.groupBy("sim", *strata, at.alias("_at")).agg(F.count(F.lit(1)).alias("_m"))
    w = Window.partitionBy("sim", *strata).orderBy("_at")
    before = F.coalesce(F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tally = tally.select("*", before.alias("_before"), F.coalesce(F.lag("_at").over(w), F.lit("")).alias("_last"))
    short = F.coalesce(*[F.when(F.left("_at", F.lit(n)) > F.col("_last"), F.left("_at", F.lit(n))) for n in (8, 16)], F.col("_at"))
    tally = tally.join(tops.select(*strata, later.alias("_from")), strata)
    tally = tally.where((F.col("_m") > 1) | F.array_contains("_from", F.col("_before")))
    marks = tally.select("sim", *strata, "_m", "_before", short.alias("_mark"), F.posexplode("_from").alias("_i", "_b"))
    marks = _stored(marks.where((F.col("_b") >= F.col("_before")) & (F.col("_b") < F.col("_before") + F.col("_m"))), "marks")
    missed = marks.where(F.col("_b") > F.col("_before")).select("sim", *strata, "_i", "_b")
    marks = marks.where(F.col("_b") == F.col("_before")).select("sim", *strata, "_i", "_mark")
    if not missed.isEmpty():
        sims = missed.groupBy(*strata).agg(F.array_distinct(F.collect_list(F.struct("sim"))).alias("_sims"))
        ranked = people(pieces, sims).withColumn("_b", F.row_number().over(Window.partitionBy("sim", *strata).orderBy("_ord")).cast("long") - 1)
        marks = _stored(marks.unionByName(ranked.join(missed, ["sim", *strata, "_b"]).select("sim", *strata, "_i", F.col("_ord").alias("_mark"))), "marks")

    of_sim = marks.groupBy(*strata, "sim").agg(F.sort_array(F.collect_list(F.struct("_i", "_mark"))).alias("_m"))
    of_sim = of_sim.groupBy(*strata).agg(F.sort_array(F.collect_list(F.struct("sim", F.col("_m._mark").alias("_marks")))).alias("_sims"))
    none = F.transform(F.sequence(F.lit(0), F.lit(n_sims - 1)), lambda s: F.struct(s.alias("sim"), F.array().cast("array<string>").alias("_marks")))
    known = tops.join(of_sim, strata, "left").withColumn("_sims", F.coalesce("_sims", none))
    if wide is None:
        paired = people(pieces, _stored(known.select(*strata, "_groups", "_sims"), "known"), "_groups").select("sim", *keys, F.get("_groups", passed("_marks")).alias(group))
        if not counted:
            return paired.withColumn("value", F.lit(1).cast("long"))
        return paired.groupBy("sim", *keys, group).agg(F.count(F.lit(1)).alias("value"))

    # The place of every named group among those of the stratum.
    at = {g: f"_at{i}" for i, g in enumerate(wide)}
    known = _stored(known.select(*strata, "_sims", *[(F.array_position("_groups", F.lit(g)) - 1).cast("int").alias(c) for g, c in at.items()]), "known")

    def vectors(rows: DataFrame) -> DataFrame:
        rows = people(rows, known, *at.values()).withColumn("_g", passed("_marks"))
        return rows.groupBy("sim", *keys).agg(*[F.nullif(F.count(F.when(F.col("_g") == F.col(c), 1)), F.lit(0).cast("long")).alias(g) for g, c in at.items()])

    # Whole leaves are counted where they lie; only those in several pieces are exchanged.
    whole = spread_out(leaves.where(F.col("_v") <= block)).repartition(parts, *strata, leaf)
    cut = spread_out(leaves.where(F.col("_v") > block)).repartition(parts, *keys, "_lo")
    return vectors(whole).unionByName(vectors(cut))


def split_counts(rng: np.random.Generator, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Deals people of known groups out to places of known sizes at random: (sims, groups) and (places) to (sims, places, groups).

    A splitting tree over the places: how many of each group go to the left half is one hypergeometric draw after another, then each half
    is dealt out alone. All nodes of a level and all simulations are drawn at once; the work does not depend on the number of people.
    """
    width = 1 << max(0, len(sizes) - 1).bit_length()
    total = np.concatenate([[0], np.cumsum(np.pad(sizes, (0, width - len(sizes))))])
    out = counts[:, None, :].astype(np.int64)
    while width > 1:
        half = width // 2
        starts = np.arange(out.shape[1]) * width
        room = np.broadcast_to(total[starts + half] - total[starts], out.shape[:2]).copy()
        left = np.zeros_like(out)
        rest = out.sum(2)
        for g in range(out.shape[2]):
            rest = rest - out[:, :, g]
            left[:, :, g] = rng.hypergeometric(out[:, :, g], rest, room) if g + 1 < out.shape[2] else room
            room -= left[:, :, g]
        out = np.stack([left, out - left], 2).reshape(out.shape[0], -1, out.shape[2])
        width = half
    return out[:, :len(sizes)]


def drawn_cells(cells: DataFrame, strata: Sequence[str], leaf: str, group: str, value: str, n_sims: int, seed: int,
                carry: Sequence[str] = (), bucket: int = 512, sims_at_once: int = 10, wide: Sequence[str] | None = None) -> DataFrame:
    """As ``permuted_cells`` in distribution, drawn from the counts without a row for any person.

    With both margins of a stratum fixed, a random pairing of people and places is a table drawn by hypergeometric splits. Leaves fall into
    buckets by a hash, about ``bucket`` of them each: first each stratum's people are split over its buckets (one number a group and
    bucket), then every bucket is split over its leaves, all buckets apart, so a stratum of any size is many tasks' work. Random
    numbers are counter-based, keyed by seed, stratum, bucket and block of ``sims_at_once`` simulations: a lost task
    draws the same again. A null stratum is a stratum; leaves and groups without people have no rows. A stratum may count up to 10^9 people.
    ``wide`` lists groups: one row per (sim, stratum, leaf) with a column for each of them, NULL where it has nobody.
    """
    strata, carry = list(strata), list(carry)
    # Written once: the buckets, both margins and the size of the largest stratum come from it.
    filled = _stored(cells.where(F.col(value) > 0).select(*dict.fromkeys([*strata, leaf, *carry, group, value])), "filled")
    leaves = filled.groupBy(*strata, leaf, *carry).agg(F.sum(value).cast("long").alias("_v"))
    most, n_leaves = (x or 1 for x in leaves.groupBy(*strata).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first())
    held = leaves.withColumn("_b", F.pmod(F.xxhash64(leaf, *carry), F.lit(-(-most // bucket)).cast("long"))).groupBy(*strata, "_b").agg(
        F.sum("_v").alias("_m"), F.array_sort(F.collect_list(F.struct(leaf, *carry, "_v"))).alias("_leaves"))
    margins = filled.groupBy(*strata, group).agg(F.sum(value).cast("long").alias("_n")).groupBy(*strata).agg(
        F.array_sort(F.collect_list(F.struct(group, "_n"))).alias("_groups"))
    tops = held.groupBy(*strata).agg(F.array_sort(F.collect_list(F.struct("_b", "_m"))).alias("_buckets"))

    def same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        named = right.toDF(*[f"_r_{c}" if c in keys else c for c in right.columns])
        on = F.lit(True)
        for k in keys:
            on &= F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        return left.join(named, on).drop(*[f"_r_{k}" for k in keys])

    blocks = F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1), F.lit(sims_at_once))).alias("_sim")
    starts = same(tops, margins, strata).select(*strata, "_buckets", "_groups", blocks)
    key = lambda df, *more: df.withColumn("_h", F.xxhash64(*strata, F.lit("|"), *more, "_sim"))

    def generator(h: int) -> np.random.Generator:
        return np.random.Generator(np.random.Philox(key=np.array([seed % 2**64, h % 2**64], np.uint64)))

    def sims(first: int) -> int:
        return min(sims_at_once, n_sims - first)

    def over_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                boxes, people = batch.column("_buckets")[r].values, batch.column("_groups")[r].values
                first = batch.column("_sim")[r].as_py()
                n = people.field("_n").to_numpy(zero_copy_only=False)
                got = split_counts(generator(batch.column("_h")[r].as_py()), np.tile(n, (sims(first), 1)), boxes.field("_m").to_numpy(zero_copy_only=False))
                k = len(boxes)
                again = pa.array(np.full(k, r))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(s).take(again) for s in strata], boxes.field("_b"), pa.array(np.full(k, first, np.int32)),
                     batch.column("_groups").take(again), pa.array(list(got.transpose(1, 0, 2).reshape(k, -1)), pa.list_(pa.int64()))],
                    [*strata, "_b", "_sim", "_groups", "_drawn"])

    def over_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                homes, people = batch.column("_leaves")[r].values, batch.column("_groups")[r].values
                first = batch.column("_sim")[r].as_py()
                drawn = batch.column("_drawn")[r].values.to_numpy(zero_copy_only=False).reshape(sims(first), len(people))
                got = split_counts(generator(batch.column("_h")[r].as_py()), drawn, homes.field("_v").to_numpy(zero_copy_only=False))
                if wide is not None:
                    kinds_here, k = people.field(group).to_pylist(), len(homes)
                    home, again = pa.array(np.tile(np.arange(k), len(got))), pa.array(np.full(len(got) * k, r))
                    flat = got.reshape(len(got) * k, -1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(np.arange(first, first + len(got), dtype=np.int32), k)), *[batch.column(s).take(again) for s in strata],
                         *[homes.field(c).take(home) for c in [leaf, *carry]],
                         *[pa.array(x, mask=x == 0) for g in wide for x in [flat[:, kinds_here.index(g)] if g in kinds_here else np.zeros(len(flat), np.int64)]]],
                        ["sim", *strata, leaf, *carry, *wide])
                    continue
                sim, home, kind = np.nonzero(got)
                again = pa.array(np.full(len(sim), r))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((sim + first).astype(np.int32)), *[batch.column(s).take(again) for s in strata],
                     *[homes.field(c).take(pa.array(home)) for c in [leaf, *carry]], people.field(group).take(pa.array(kind)), pa.array(got[sim, home, kind])],
                    ["sim", *strata, leaf, *carry, group, "value"])

    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    named = lambda names: ", ".join(f"`{c}` {kinds[c]}" for c in names)
    groups = dict(starts.dtypes)["_groups"]
    dealt = key(starts).mapInArrow(over_buckets, f"{named(strata)}, _b bigint, _sim int, _groups {groups}, _drawn array<bigint>")
    rows = same(dealt, held.select(*strata, "_b", "_leaves"), [*strata, "_b"])
    # Buckets are small to hold and long to deal out: they are spread by number of tables to draw, not by bytes.
    parts = max(4 * cells.sparkSession.sparkContext.defaultParallelism, -(-n_leaves * n_sims // 250_000))
    rows = rows.repartition(parts, *strata, "_b", "_sim")
    out = f"{named([group])}, value bigint" if wide is None else ", ".join(f"`{g}` bigint" for g in wide)
    return key(rows, F.col("_b")).mapInArrow(over_leaves, f"sim int, {named([*strata, leaf, *carry])}, {out}")
