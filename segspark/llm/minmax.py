"""Near-duplicate documents by min-max hashing of word shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.llm.common import documents, store
from segspark.llm.components import connected_components

#: Words of a shingle; hash functions, each giving a minimum and a maximum; values of a band; link at this many percent.
SHINGLE, HASHES, ROWS, PERCENT = 5, 64, 4, 85
#: Least equal signature values of 2 * HASHES for a pair that is looked at: six deviations below those of a link.
ALIKE = 80
#: Members of a bucket or cluster that are compared at once; shingles hashed at once.
MEMBERS, BLOCK = 512, 1 << 16
NO_KEY = -(1 << 63)
_SEED = np.random.default_rng(11).integers(1, 1 << 63, (HASHES, 2), dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text.

    ASCII capitals are lower-cased, words are cut at ASCII white space. Fewer words than a shingle make one shingle
    of their own kind; no words make none.
    """
    import xxhash

    word = xxhash.xxh3_64_intdigest
    words = [t.lower().split() if t else [] for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    ids = np.fromiter((word(w) for ws in words for w in ws), np.uint64, int(n.sum()))
    long = np.zeros(max(0, len(ids) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        long = _mix(long * _P + ids[k:len(ids) - SHINGLE + 1 + k]) if len(long) else long
    out, at = [], 0
    for size in n.tolist():
        if size >= SHINGLE:
            out.append(np.unique(long[at:at + size - SHINGLE + 1]))
        elif size:
            h = np.full(1, size, np.uint64)
            for x in ids[at:at + size]:
                h = _mix(h * _P + x)
            out.append(h)
        else:
            out.append(np.empty(0, np.uint64))
        at += size
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bands (one hash of ``ROWS`` values each) and sketches (a byte of every value) of non-empty sets.

    Every hash function is evaluated once and gives two values, its least and its greatest over the set; for each
    of them the chance to agree is the similarity of the sets.
    """
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    values = np.empty((len(sets), 2 * HASHES), np.uint64)
    for k in range(HASHES):
        h = (flat ^ (flat >> np.uint64(32))) * _SEED[k, 0] + _SEED[k, 1]
        h ^= h >> np.uint64(32)
        values[:, k] = np.minimum.reduceat(h, starts)
        values[:, HASHES + k] = np.maximum.reduceat(h, starts)
    values = _mix(values * _P)
    bands = np.zeros((len(sets), 2 * HASHES // ROWS), np.uint64)
    bands += np.arange(bands.shape[1], dtype=np.uint64)
    for k in range(ROWS):
        bands = _mix(bands * _P + values[:, k::ROWS])
    return bands.view(np.int64), (values >> np.uint64(24)).astype(np.uint8)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.int64()))


def text_hash(text: str) -> Column:
    """With the key, what tells a document from others; a null text is an empty one."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def describe(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per document: key, h (hash of the text), n (set size), h1 and h2 (a 128-bit name of the set), bands, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values, hashes = batch.column(0).fill_null(NO_KEY).to_numpy(), batch.column(1), batch.column(2)
            at = 0
            while at < len(values):
                end, size = at, 0
                while end < len(values) and size < 8 * BLOCK:
                    size += len(values[end].as_buffer()) if values[end].is_valid else 0
                    end += 1
                sets = shingle_sets([v.as_py().encode() if v.is_valid else None for v in values[at:end]])
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                bands, sketch = np.zeros((len(sets), 2 * HASHES // ROWS), np.int64), np.zeros((len(sets), 2 * HASHES), np.uint8)
                names = np.zeros((2, len(sets)), np.uint64)
                if len(full):
                    some = [sets[i] for i in full]
                    bands[full], sketch[full] = signatures(some)
                    flat, starts = np.concatenate(some), np.cumsum([0, *n[full][:-1]])
                    names[0, full] = np.add.reduceat(_mix(flat), starts)
                    names[1, full] = np.add.reduceat(_mix(flat * _P), starts)
                names = names.view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys[at:end]), hashes.slice(at, end - at), pa.array(n), pa.array(names[0]), pa.array(names[1]), _lists(bands),
                    pa.array([s.tobytes() for s in sketch], pa.binary())], ["key", "h", "n", "h1", "h2", "bands", "sketch"])
                at = end

    return docs.select(F.col(key).cast("long"), text, text_hash(text)).mapInArrow(
        run, "key long, h long, n long, h1 long, h2 long, bands array<bigint>, sketch binary")


def _spread(rows: DataFrame, group: str) -> DataFrame:
    """``rows`` of groups with two members or more, with ``_g``: the blocks of a group that are compared with each other.

    A group of more than ``MEMBERS`` is cut into blocks by a hash of the key; each pair of blocks is a unit of work of its own.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("_m")).filter("_m > 1")
    blocks = F.ceil(F.col("_m") / MEMBERS).cast("int")
    own = F.pmod(F.xxhash64("key"), F.col("_b")).cast("int")
    pair = lambda j: F.struct(F.least(F.col("_own"), j).alias("i"), F.greatest(F.col("_own"), j).alias("j"))
    others = F.filter(F.sequence(F.lit(0), F.col("_b") - 1), lambda j: j != F.col("_own"))
    return (
        rows.join(sizes, group).withColumn("_b", blocks).withColumn("_own", own)
        .withColumn("_p", F.explode(F.when(F.col("_b") == 1, F.array(pair(F.lit(0)))).otherwise(F.transform(others, pair))))
        .withColumn("_g", F.xxhash64(group, "_p.i", "_p.j"))
        .drop("_m", "_b", "_own", "_p")
    )


def _stars(near: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each member to the least key of its component under the matrix ``near``."""
    order = np.argsort(keys, kind="stable")
    near, keys = near[np.ix_(order, order)], keys[order]
    label = np.arange(len(keys))
    while True:
        lower = np.minimum(label, np.where(near, label[None], len(keys)).min(1))
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    move = np.flatnonzero(label < np.arange(len(keys)))
    return keys[move], keys[label[move]]


def _grouped(compare: Callable[[list[np.ndarray], np.ndarray], np.ndarray]) -> Callable:
    """For ``mapInArrow`` over rows (_g, key, ...) sorted by _g: edges of ``compare(columns of a group)``, a stream of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finished(table: pa.Table) -> pa.RecordBatch:
            groups, keys, rest = table.column(0).to_numpy(), table.column(1).to_numpy(), table.column(2).combine_chunks()
            bounds = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1], [True]]))
            a, b = [], []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if e - s > 1:
                    x, y = _stars(compare(rest[s:e]), keys[s:e])
                    a.append(x)
                    b.append(y)
            none = [np.empty(0, np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a or none)), pa.array(np.concatenate(b or none))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            # Everything before the last group of this batch is whole.
            groups = batch.column(0).to_numpy()
            last = int(np.searchsorted(groups, groups[-1], "left"))
            if last:
                yield finished(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            elif held and held[-1].column(0)[-1].as_py() != groups[0]:
                yield finished(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(last))
        if held:
            yield finished(pa.Table.from_batches(held))

    return run


def _alike(sketches: pa.Array) -> np.ndarray:
    s = np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in sketches])
    if len(s) == 2:
        return np.full((2, 2), int((s[0] == s[1]).sum()) >= ALIKE)
    return np.concatenate([(s[i:i + 64, None] == s[None]).sum(2) >= ALIKE for i in range(0, len(s), 64)])


def _similar(sets: pa.Array) -> np.ndarray:
    """Exact: pairs of sets with 100 * intersection >= PERCENT * union."""
    n = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate([x.values.to_numpy() for x in sets])
    owner = np.repeat(np.arange(len(n)), n)
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    # Only shingles of several sets can be in an intersection.
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[at]
    owner, column = owner[keep], column[at[keep]]
    common = np.zeros((len(n), len(n)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, int(shared.sum()), 8192):
        s, e = np.searchsorted(column, [first, first + 8192])
        cells = np.zeros((len(n), 8192), np.float32)
        cells[owner[s:e], column[s:e] - first] = 1
        common += cells @ cells.T
    common = common.astype(np.int64)
    return 100 * common >= PERCENT * (n[:, None] + n[None] - common)


def linked_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, h, n, least_key, least_h) of each row; the least document of a component is named by key and text hash.

    1. Each text becomes its shingle set, min-max signature, bands and a 128-bit name of the set. Equal sets are one class.
       All of the steps below know classes by a number of their own, so rows that share a key are never taken for each other.
    2. One document of each class is put into a bucket per band. Within a bucket, members whose signatures agree often enough
       are joined into clusters; only a spanning star leaves the task, never all pairs.
    3. Within a cluster every pair is tested on the full sets, rebuilt from the texts; again stars leave the task.
       Buckets and clusters of any size are cut into blocks that are compared block with block.
    4. Components of the true links, named by their least document and given back to all members of the classes.

    A null key is ``NO_KEY``, below all others.
    """
    found = store(describe(docs, key, text), "shingles")
    some = found.filter("n > 0")
    # Numbered as they are written, so the numbers are fixed from here on.
    classes = some.groupBy("h1", "h2", "n").agg(F.min(F.struct("key", "h")).alias("_d")).select("h1", "h2", "n", "_d.key", "_d.h")
    classes = store(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    members = some.join(classes, ["key", "h", "h1", "h2", "n"]).select(
        F.col("id").alias("key"), "bands", "sketch").dropDuplicates(["key"])
    buckets = members.select("key", F.explode("bands").alias("bucket"))
    rows = _spread(buckets, "bucket").select("_g", "key").join(members.select("key", "sketch"), "key").select("_g", "key", "sketch")
    candidates = (
        rows.repartition("_g").sortWithinPartitions("_g").mapInArrow(_grouped(_alike), "a long, b long")
    )
    clusters = connected_components(candidates)
    wanted = classes.join(clusters, F.col("id") == F.col("node")).select("key", "h", "id", "component")
    texts = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"), text_hash(text).alias("h"), F.col(text).alias("text"))
    # Rows of one key and text are one document.
    texts = texts.join(wanted, ["key", "h"]).dropDuplicates(["key", "h"]).select(F.col("id").alias("key"), "component", "text")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = shingle_sets([v.as_py().encode() if v.is_valid else None for v in part.column(2)])
                values = pa.array(np.concatenate(sets).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["key", "component", "shingles"])

    sets = texts.mapInArrow(rebuild, "key long, component long, shingles array<bigint>")
    # The blocks of a cluster are planned on the keys alone.
    work = _spread(clusters.select(F.col("node").alias("key"), "component"), "component").select("key", "_g")
    links = (
        sets.select("key", "shingles").join(work, "key").select("_g", "key", "shingles")
        .repartition("_g").sortWithinPartitions("_g").mapInArrow(_grouped(_similar), "a long, b long")
    )
    linked = classes.join(connected_components(links).withColumnRenamed("node", "id"), "id")
    least = linked.groupBy("component").agg(F.min(F.struct("key", "h")).alias("_least"))
    least = linked.select("id", "component").join(least, "component").select("id", "_least")
    named = classes.join(least, "id", "left").select(
        "h1", "h2", "n", F.coalesce("_least", F.struct("key", "h")).alias("_least"))
    own = F.coalesce("_least", F.struct("key", "h"))
    return found.join(named, ["h1", "h2", "n"], "left").select(
        "key", "h", "n", own["key"].alias("least_key"), own["h"].alias("least_h"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept): components of documents linked by a Jaccard similarity of ``PERCENT`` %.

    No partner or candidate is capped. A link is missed only if all 32 bands differ (chance 6e-11 at the threshold) or the
    signature is six deviations off. Null or empty text: n 0, linked with nothing, kept. ``component_id`` is the least key of
    the component; a null key is below all others. Rows of one key and one text count as one document; rows that share a key,
    or have none, and differ in text are documents of their own, of which the one with the least text hash is kept
    where they are linked. Components whose least keys are equal show the same ``component_id``.
    """
    shown = lambda c: F.nullif(c, F.lit(NO_KEY))
    return linked_documents(docs, key, text).select(
        shown(F.col("key")).alias("key"), F.col("n").alias("n_shingles"), shown(F.col("least_key")).alias("component_id"),
        ((F.col("key") == F.col("least_key")) & (F.col("h") == F.col("least_h"))).alias("kept"))


def q_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).withColumnRenamed("key", "doc_id")


QUERIES = {"op3_minmax_near_duplicates": (q_near_duplicates, None)}
