"""Document fingerprints of improbable features: chained Bloom filters of rare byte windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.llm.common import documents

#: Bytes of a feature; features that compete; wins that a feature needs; entropy steps.
FEATURE, RIVALS, WINS, STEPS = 32, 32, 8, 1000
#: Bits of a filter, bits that a feature sets, features of a filter before the next is begun.
BITS, PROBES, PER_FILTER = 2048, 5, 128
#: Bytes that are worked on at once (a longer text is worked on alone).
BLOCK = 1 << 18

_C = np.arange(FEATURE + 1, dtype=np.float64)
#: c log2 c in fixed point, so that sums over windows are exact.
_LOG = np.round(_C * np.log2(np.maximum(_C, 1)) * (1 << 20)).astype(np.int64)
_GAIN = np.diff(_LOG)


def entropy_steps(data: np.ndarray) -> np.ndarray:
    """Shannon entropy of each window of ``FEATURE`` bytes, as a step from 0 to ``STEPS``.

    A window's entropy follows from the one before: the byte that leaves and the byte that comes in change it by what
    their counts in the window say. The counts come from comparing the text with itself at each distance.
    """
    n = len(data) - FEATURE + 1
    if n < 1:
        return np.empty(0, np.int16)
    ahead, behind = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for d in range(1, FEATURE):
        same = (data[d:] == data[:-d]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    total = np.empty(n, np.int64)
    total[0] = _LOG[np.bincount(data[:FEATURE], minlength=256)].sum()
    total[1:] = _GAIN[behind[FEATURE:]] - _GAIN[ahead[:n - 1]]
    total = np.cumsum(total)
    full = FEATURE * np.log2(FEATURE) * (1 << 20)
    return np.clip(np.round((full - total) / full * STEPS), 0, STEPS).astype(np.int16)


def features(data: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """64-bit hashes of the text's improbable windows, in text order; ``ranks``: how rare each window's entropy is.

    Every ``RIVALS`` neighbouring places elect the window whose entropy is rarest (the leftmost on a tie); places before
    and after the text have none. A window with ``WINS`` elections is a feature. One rule for every length: the rarest window wins everywhere around
    itself, so a text has at least one feature, and what is elected depends on its neighbourhood alone.
    """
    if not len(ranks):
        return np.empty(0, np.uint64)
    beyond = np.full(RIVALS - 1, np.iinfo(np.int64).max)
    key = np.concatenate([beyond, (ranks << 40) | np.arange(len(ranks)), beyond])
    width = 1
    while width < RIVALS:
        key = np.minimum(key[:len(key) - width], key[width:])
        width *= 2
    wins = np.bincount(key & ((1 << 40) - 1), minlength=len(ranks))
    return _hashes(data, np.flatnonzero(wins >= WINS), FEATURE)


def padded(text: str | None) -> bytes:
    """Bytes of a text, filled up with zeros to the length of a feature; nothing of an empty one."""
    return text.encode().ljust(FEATURE, b"\0") if text else b""


def _hashes(data: np.ndarray, chosen: np.ndarray, width: int) -> np.ndarray:
    if not len(chosen):
        return np.empty(0, np.uint64)
    words = np.lib.stride_tricks.sliding_window_view(data, width)[chosen].copy().view("<u8")
    h = np.full(len(chosen), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def filters(hashes: np.ndarray) -> np.ndarray:
    """Chained filters, one row of bytes for each ``PER_FILTER`` features."""
    n = -(-len(hashes) // PER_FILTER)
    bits = np.zeros((n, BITS), bool)
    row = np.arange(len(hashes)) // PER_FILTER
    for k in range(PROBES):
        bits[row, ((hashes >> np.uint64(11 * k)) % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: for each filter of the shorter digest its best overlap with one of the longer, averaged by set bits.

    The overlap of two filters is the share of common bits beyond what two random filters of as many bits have.
    Two empty digests are alike (1), an empty one and another are not (0).
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b) or (len(a) == len(b) and a.tobytes() > b.tobytes()):
        a, b = b, a
    a, b = np.unpackbits(a, axis=1).astype(np.float32), np.unpackbits(b, axis=1).astype(np.float32)
    na, nb = a.sum(1), b.sum(1)
    common = a @ b.T
    chance = na[:, None] * nb[None] / BITS
    most = np.minimum(na[:, None], nb[None])
    share = np.where(most > chance, (common - chance) / np.maximum(most - chance, 1e-9), common >= most)
    best = np.clip(share, 0, 1).max(1)
    return float(min(1.0, (best * na).sum() / na.sum()))


def entropy_ranks(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Rank of each entropy step by how rare it is in the whole corpus: 0 for the rarest.

    Tasks send one count for each step they have seen; ``STEPS`` + 1 sums come back. A step that never occurs
    ranks by its place among the rarest; ties by the lower entropy.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(STEPS + 1, np.int64)

        def add(block: list[bytes]) -> None:
            steps, at = entropy_steps(np.frombuffer(b"".join(block), np.uint8)), 0
            inside = np.zeros(len(steps), bool)
            for data in block:
                inside[at:at + max(0, len(data) - FEATURE + 1)] = True
                at += len(data)
            total[:] += np.bincount(steps[inside], minlength=STEPS + 1)

        block, size = [], 0
        for batch in batches:
            for value in batch.column(0):
                if value.is_valid:
                    block.append(padded(value.as_py()))
                    size += len(block[-1])
                    if size >= BLOCK:
                        add(block)
                        block, size = [], 0
        add(block)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(STEPS + 1)), pa.array(total)], ["step", "n"])

    rows = docs.select(text).mapInArrow(count, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(STEPS + 1, np.int64)
    for step, total in rows:
        n[step] = total
    rank = np.empty(STEPS + 1, np.int64)
    rank[np.lexsort((np.arange(STEPS + 1), n))] = np.arange(STEPS + 1)
    return rank


def fingerprints(texts: Sequence[str], rank: np.ndarray) -> list[np.ndarray]:
    """Filters of each text; the texts are laid end to end, so that short ones cost no calls of their own."""
    raw = [padded(t) for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    steps, at, out = entropy_steps(data), 0, []
    for r in raw:
        own = data[at:at + len(r)]
        out.append(filters(features(own, rank[steps[at:at + max(0, len(r) - FEATURE + 1)]])))
        at += len(r)
    return out


def in_descending_order(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Rows (part, extra, key, text), sorted in each task so that a document's successor in descending key order follows it.

    Keys are cut into ``parts`` ranges of about as many rows; after its own documents a range has a copy (``extra``) of
    the first document of the next range, the last range one of the very first. Texts are shuffled once; the
    driver sees two numbers per range. Null keys come last, equal keys in the order of a hash of their texts.
    """
    parts = parts or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), hashed.alias("hash"))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    found = rows.agg(F.percentile_approx("key", shares, 100 * parts)).first()[0]
    bounds = sorted(set(found or []), reverse=True)
    part = F.lit(len(bounds))
    if bounds:
        # Bounds above the key, counted by blocks and then in the block where they end.
        block = max(1, int(len(bounds) ** 0.5))
        above = lambda values: F.size(F.filter(values, lambda b: b > F.col("key")))
        skipped = above(F.array(*map(F.lit, bounds[block - 1::block]))) * block
        part = F.when(F.col("key").isNull(), len(bounds)).otherwise(
            skipped + above(F.slice(F.array(*map(F.lit, bounds)), skipped + 1, F.lit(block))))
    rows = rows.withColumn("part", part.cast("int"))
    first = F.min(F.struct(F.col("key").isNull().alias("n"), F.bitwise_not("key").alias("k"), "hash"))
    heads = {r[0]: r[1] for r in rows.groupBy("part").agg(first.alias("head")).collect()}
    filled = sorted(heads)
    if not filled:
        return rows.select("part", F.lit(False).alias("extra"), "key", "text")
    before = F.create_map(*[F.lit(x) for i, p in enumerate(filled) for x in (p, filled[i - 1])])
    head = F.create_map(*[x for p, h in heads.items() for x in (
        F.lit(p), F.struct(F.lit(None if h["n"] else ~h["k"]).cast("long").alias("k"), F.lit(h["hash"]).alias("h")))])
    own = F.struct("part", F.lit(False).alias("extra"))
    both = F.array(own, F.struct(F.element_at(before, F.col("part")).alias("part"), F.lit(True).alias("extra")))
    is_head = F.element_at(head, F.col("part"))
    return (
        rows.withColumn("to", F.explode(F.when(
            is_head["k"].eqNullSafe(F.col("key")) & (is_head["h"] == F.col("hash")), both).otherwise(F.array(own))))
        .select("to.part", "to.extra", "key", "text", "hash")
        .repartition(max(1, parts // 4), "part")
        .sortWithinPartitions("part", "extra", F.col("key").desc_nulls_last(), "hash")
        .drop("hash")
    )


def compare_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness, with that to the next document.

    The edited text has its last half (rounded down, in characters) replaced by as many from the beginning of the
    next document in descending key order, or all of it if that is shorter; the last document is followed by the first.
    Null text is empty; an empty text has the fingerprint "" and is like another empty one only. Equal texts have equal
    fingerprints. One document alone is its own next. Repeated rows are documents each. No rows give no rows.
    """
    rank = entropy_ranks(docs, text)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[int | None, str, str]] = []

        def flush() -> pa.RecordBatch:
            edited = [t[:len(t) - len(t) // 2] + n[:len(t) // 2] for _, t, n in pairs]
            place: dict[str, int] = {}
            for t in [x for _, t, n in pairs for x in (t, n)] + edited:
                place.setdefault(t, len(place))
            prints = fingerprints(list(place), rank)
            a, b, c = ([prints[place[x]] for x in xs] for xs in ([t for _, t, _ in pairs], edited, [n for *_, n in pairs]))
            out = pa.RecordBatch.from_arrays([
                pa.array([k for k, *_ in pairs], pa.int64()), pa.array([len(t) for _, t, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array([x.tobytes().hex() for x in a], pa.string()), pa.array([x.tobytes().hex() for x in b], pa.string()),
                pa.array(map(likeness, a, b), pa.float64()), pa.array(map(likeness, a, c), pa.float64()),
            ], ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            pairs.clear()
            return out

        last, size = None, 0
        for batch in batches:
            for part, extra, k, t in zip(*(batch.column(i) for i in range(4))):
                part, extra, k, t = part.as_py(), extra.as_py(), k.as_py(), t.as_py() or ""
                if last is not None and last[0] == part:
                    pairs.append((last[1], last[2], t))
                    size += len(t) + len(last[2])
                    if size >= BLOCK:
                        yield flush()
                        size = 0
                # What follows the first extra row of a range is another copy of it.
                last = None if extra else (part, k, t)
        if pairs:
            yield flush()

    return in_descending_order(docs, key, text).mapInArrow(compare, (
        "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"))


def q_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(documents(spark, sf_dir).select("doc_id", "text")).withColumnRenamed("key", "doc_id")


QUERIES = {"op5_improbable_features": (q_digest, None)}
