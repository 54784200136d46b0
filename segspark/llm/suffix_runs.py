"""Removal of long repeated strings by a distributed, common-prefix-aware merge sort of suffixes."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.llm.common import documents, store

#: Bytes of a string that counts as repeated, unless said otherwise (at least ``GRAM``); bytes of an anchor.
LENGTH, GRAM = 400, 64
#: Bytes of text worked on at once; suffixes of a run; suffixes whose extents are found at once, at least a group; suffixes of a range.
BLOCK, RUN, CHUNK, RANGE = 1 << 20, 20_000, 20_000, 20_000
#: Anchors of one gram that a task merges; more are compared string by string in a plain aggregate.
HOT = 100_000
NO_KEY = -(1 << 63)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from each place on, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _Q
    h ^= h >> np.uint64(29)
    width = 1
    while width < GRAM:
        h = h[:-width] * _P + h[width:]
        h ^= h >> np.uint64(31)
        h *= _Q
        width *= 2
    return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray, grams: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Anchors of one text (at least ``length`` bytes), and spans of it that repeat within a period.

    The anchor of a string of ``length`` bytes is the place of its least gram (the leftmost on a tie), so equal strings
    have their anchors at equal places. A string that equals the one a period before it needs no anchor: the first of the
    series has one. Such series are returned as spans; without that rule a run of one letter would have an anchor at
    every byte.
    """
    spots = length - GRAM + 1
    n = len(data)
    bits = np.uint64(max(1, int(n).bit_length()))
    key = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= spots:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < spots:
        key = np.minimum(key[:len(key) - (spots - width)], key[spots - width:])
    of = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.concatenate([[True], of[1:] != of[:-1]])
    at = of[new]
    again = np.flatnonzero(grams[at[1:]] == grams[at[:-1]]) + 1
    again = again[(at[again] - at[again - 1]) < spots]
    if not len(again):
        return at, []
    starts = np.append(np.flatnonzero(new), len(of))
    step = at[again] - at[again - 1]
    needed, spans = np.ones(len(of), bool), []
    cut = np.flatnonzero((np.diff(again) != 1) | (np.diff(step) != 0)) + 1
    for part in np.split(np.arange(len(again)), cut):
        first, last, d = starts[again[part[0]]], starts[again[part[-1]] + 1], int(step[part[0]])
        first = max(first, d)
        if first >= last:
            continue
        same = np.concatenate([[0], np.cumsum(data[first:last - 1 + length] == data[first - d:last - 1 + length - d])])
        whole = same[length:] - same[:-length] == length
        places = np.flatnonzero(whole) + first
        needed[places] = False
        for run in np.split(places, np.flatnonzero(np.diff(places) != 1) + 1) if len(places) else []:
            spans.append((int(run[0]) - d, int(run[-1]) + length))
    return np.unique(of[needed]), spans


def string_hashes(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the ``length`` bytes from each place on, put together from powers of two."""
    n, out = len(data) - length + 1, []
    for p, q in ((_P, _Q), (_Q, _P)):
        h = (data.astype(np.uint64) + np.uint64(1)) * q
        total, at, width = np.zeros(n, np.uint64), 0, 1
        while width <= length:
            if length & width:
                total = (total * p + h[at:at + n]) * q
                total ^= total >> np.uint64(31)
                at += width
            if 2 * width <= length:
                h = h[:-width] * p + h[width:]
                h ^= h >> np.uint64(31)
                h *= q
            width *= 2
        out.append(total.view(np.int64))
    return out[0], out[1]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the covered bytes."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(s, e) for s, e in out]


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    differs = int.from_bytes(x) ^ int.from_bytes(y)
    return n - (differs.bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of sorted strings: what each shares with the one before it, and the rest."""
    shared = [0] + [common_prefix(a, b, 0) for a, b in zip(strings, strings[1:])]
    return shared, [s[k:] for s, k in zip(strings, shared)]


def merge_runs(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, bytes, int]]:
    """Merges front-coded sorted runs: (run, place in it, string, prefix shared with the string before it).

    A loser tree in which every string carries the length of its common prefix with the last string that came out. The
    longer one is the smaller string, without looking at a byte; bytes are compared only on equal lengths, and only beyond
    them, so no known prefix is compared again.
    """
    k = 1
    while k < len(runs):
        k *= 2
    place, text, shared = [0] * k, [None] * k, [0] * k
    for r, (_, rests) in enumerate(runs):
        if rests:
            text[r] = rests[0]
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs; the loser's length becomes that to the winner."""
        x, y = text[a], text[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        n = common_prefix(x, y, shared[a])
        if x[n:n + 1] <= y[n:n + 1] and (n < len(y) or n == len(x)):
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, loser[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if k > 1 else 0
    while text[winner] is not None:
        yield winner, place[winner], text[winner], shared[winner]
        place[winner] += 1
        i = place[winner]
        codes, rests = runs[winner]
        if i < len(rests):
            shared[winner] = codes[i]
            text[winner] = text[winner][:codes[i]] + rests[i]
        else:
            text[winner] = None
        node = (winner + k) // 2
        while node:
            winner, loser[node] = play(winner, loser[node])
            node //= 2


def extents(shared: np.ndarray, group: np.ndarray, rights: np.ndarray, lefts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """How far repeated strings around each anchor reach to its left and right (-1: there is none).

    Anchors stand in the order of their right contexts, ``shared`` is the common prefix with the one before (0 at the start of a
    group), ``rights`` the lengths of the right contexts, ``lefts`` the left contexts read leftwards. The string that starts o
    bytes before an anchor is repeated if another anchor has the same o bytes to the left and the same ``length`` - o to
    the right: classes of both are runs of the two sorted orders, cut where the common prefix is shorter.
    """
    places = length - GRAM + 1
    n = len(lefts)
    size = np.array([len(x) for x in lefts])
    order = np.array(sorted(range(n), key=lambda i: (group[i], lefts[i])))
    cells = np.frombuffer(b"".join(lefts[i].ljust(places - 1, b"\0") for i in order), np.uint8).reshape(n, places - 1)
    left = np.zeros(n, np.int64)
    for s in range(1, n, 4096):
        differ = cells[s:s + 4096] != cells[s - 1:s - 1 + len(cells[s:s + 4096])]
        left[s:s + 4096] = np.where(differ.any(1), differ.argmax(1), places - 1)
    left[1:] = np.minimum(left[1:], np.minimum(size[order[1:]], size[order[:-1]]))
    fresh = np.concatenate([[True], group[order[1:]] != group[order[:-1]]])
    most, least = np.full(n, -1), np.full(n, length)
    by_left = np.empty(n, np.int64)
    for o in range(places):
        by_left[order] = np.cumsum(fresh | (left < o))
        at = np.flatnonzero((size >= o) & (rights >= length - o))
        if len(at) < 2:
            continue
        both = (np.cumsum(shared < length - o) * (n + 1) + by_left)[at]
        sort = np.argsort(both, kind="stable")
        both = both[sort]
        equal = both[1:] == both[:-1]
        twice = at[sort[np.concatenate([equal, [False]]) | np.concatenate([[False], equal])]]
        most[twice] = o
        least[twice] = np.minimum(least[twice], o)
    return most, np.where(most >= 0, length - least, -1)


def describe(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, key, h, n, sha, ends_at, anchors, grams, heads, spans) of (key, h, text); ``row`` is unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            values, at = batch.column(2), 0
            while at < len(values):
                raw, size, first = [], 0, at
                while at < len(values) and size < BLOCK:
                    raw.append(values[at].as_py().encode() if values[at].is_valid else b"")
                    size += len(raw[-1])
                    at += 1
                data = np.frombuffer(b"".join(raw), np.uint8)
                hashes = gram_hashes(data) if len(data) >= GRAM else np.empty(0, np.uint64)
                # The first seven bytes of an anchor, as a number that sorts as they do.
                head = np.zeros(max(0, len(data) - 6), np.int64)
                for k in range(7):
                    head = (head << 8) | data[k:k + len(head)]
                rows, begin = [], 0
                for text in raw:
                    own, spans = np.empty(0, np.int64), []
                    if len(text) >= length:
                        own, spans = anchors(data[begin:begin + len(text)], hashes[begin:begin + len(text) - GRAM + 1], length)
                    rows.append((own, hashes[begin + own].view(np.int64), head[begin + own] if len(own) else own, spans))
                    begin += len(text)
                part = batch.slice(first, len(raw))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + len(raw))), part.column(0), part.column(1), pa.array([len(t) for t in raw], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in raw], pa.string()),
                    pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                    pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                    pa.array([[list(s) for s in r[3]] for r in rows], pa.list_(pa.list_(pa.int64()))),
                ], ["row", "key", "h", "n", "sha", "anchors", "grams", "heads", "spans"])
                row += len(raw)

    return docs.mapInArrow(run, (
        "row long, key long, h long, n long, sha string, anchors array<bigint>, grams array<bigint>, heads array<bigint>, "
        "spans array<array<bigint>>"))


_RUNS = ("part int, run string, rows array<bigint>, places array<bigint>, shared array<bigint>, rest_ends array<bigint>, rests binary, "
         "left_ends array<bigint>, lefts binary")


def sorted_runs(texts: DataFrame, bounds: list[int], length: int = LENGTH) -> DataFrame:
    """Front-coded sorted runs of the suffixes at the anchors of (row, text, anchors), cut at ``bounds`` of their first bytes.

    First bytes so frequent that they are several bounds are spread over as many parts by the gram, as only suffixes of one gram need to meet.
    """
    span = length - GRAM + 1

    def part_of(suffix: bytes) -> int:
        head = int.from_bytes(suffix[:7])
        low, high = bisect_left(bounds, head), bisect_right(bounds, head)
        return low + 1 + zlib.crc32(suffix[:GRAM]) % (high - low) if high > low else high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def piece(part: int, name: str, own: list[tuple[bytes, bytes, int, int]]) -> tuple:
            shared, rests = front_code([x[0] for x in own])
            lefts = [x[1] for x in own]
            return (part, name, [x[2] for x in own], [x[3] for x in own], shared, np.cumsum([len(x) for x in rests]),
                    b"".join(rests), np.cumsum([len(x) for x in lefts]), b"".join(lefts))

        def flush(entries: list[tuple[bytes, bytes, int, int]]) -> pa.RecordBatch:
            entries.sort()
            name, own = uuid.uuid4().hex, defaultdict(list)
            for entry in entries:
                own[part_of(entry[0])].append(entry)
            pieces = [piece(part, name, some) for part, some in own.items()]
            kinds = [pa.int32(), pa.string(), *[pa.list_(pa.int64())] * 4, pa.binary(), pa.list_(pa.int64()), pa.binary()]
            names = [c.split()[0] for c in _RUNS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pieces], kind) for i, kind in enumerate(kinds)], names)

        entries: list[tuple[bytes, bytes, int, int]] = []
        for batch in batches:
            for row, text, places in zip(*(batch.column(i) for i in range(3))):
                if not places.is_valid:
                    continue
                row, data = row.as_py(), text.as_py().encode()
                for a in places.as_py():
                    entries.append((data[a:a + length], data[max(0, a - span + 1):a][::-1], row, a))
                    if len(entries) >= RUN:
                        yield flush(entries)
                        entries = []
        if entries:
            yield flush(entries)

    return texts.select("row", "text", "anchors").mapInArrow(run, _RUNS)


def merged_extents(runs: DataFrame, parts: int, length: int = LENGTH) -> DataFrame:
    """(row, start, end) of repeated stretches, from the runs of each part merged into one order."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(batch: list[tuple]) -> pa.RecordBatch:
            rows, places, shared, group, rights, lefts = zip(*batch)
            most, reach = extents(np.array(shared), np.array(group), np.array(rights), list(lefts), length)
            some = most >= 0
            rows, places = np.array(rows)[some], np.array(places)[some]
            return pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array(places - most[some]), pa.array(places + reach[some])], ["row", "start", "end"])

        def of_part(pieces: list[dict]) -> Iterator[pa.RecordBatch]:
            coded, lefts = [], []
            for p in pieces:
                ends = [0, *p["rest_ends"]]
                coded.append((p["shared"], [p["rests"][s:e] for s, e in zip(ends, ends[1:])]))
                ends = [0, *p["left_ends"]]
                lefts.append((p["lefts"], ends))
            ready: list[tuple] = []
            own: list[tuple] = []
            number = 0
            for r, i, text, same in merge_runs(coded):
                if same < GRAM:
                    if len(own) > 1:
                        ready += own
                        if len(ready) >= CHUNK:
                            yield found(ready)
                            ready = []
                    own, number, same = [], number + 1, 0
                left, ends = lefts[r]
                own.append((pieces[r]["rows"][i], pieces[r]["places"][i], same, number, len(text), left[ends[i]:ends[i + 1]]))
            if len(own) > 1:
                ready += own
            if ready:
                yield found(ready)

        part, pieces = None, []
        for batch in batches:
            for piece in batch.to_pylist():
                if piece["part"] != part:
                    if pieces:
                        yield from of_part(pieces)
                    part, pieces = piece["part"], []
                pieces.append(piece)
        if pieces:
            yield from of_part(pieces)

    return runs.repartition(parts, "part").sortWithinPartitions("part", "run").mapInArrow(merge, "row long, start long, end long")


def counted_strings(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, start, end) of repeated strings around the anchors ``hot`` of (row, text, hot).

    For grams so frequent that their anchors must not meet in one task: every string that holds such an anchor is named by a
    128-bit hash, and the names are counted, partly in each task before they are exchanged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, places in zip(*(batch.column(i) for i in range(3))):
                data, span = np.frombuffer(text.as_py().encode(), np.uint8), length - GRAM + 1
                near = np.concatenate([np.arange(max(0, a - span + 1), min(a, len(data) - length) + 1) for a in places.as_py()])
                near = np.unique(near)
                first, second = string_hashes(data, length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(near), row.as_py())), pa.array(near), pa.array(first[near]), pa.array(second[near])],
                    ["row", "start", "s1", "s2"])

    strings = texts.filter(F.size("hot") > 0).select("row", "text", "hot").mapInArrow(run, "row long, start long, s1 long, s2 long")
    twice = strings.groupBy("s1", "s2").agg(F.count("*").alias("c")).filter("c > 1").select("s1", "s2")
    return strings.join(twice, ["s1", "s2"], "left_semi").select("row", "start", (F.col("start") + length).alias("end"))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    own = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"), F.xxhash64(own).alias("h"), own.alias("text"))


def repeated_spans(
    docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT, length: int = LENGTH,
) -> tuple[DataFrame, DataFrame]:
    """Where texts hold strings of ``length`` bytes that start anywhere else, too.

    Returns ``spans`` (row, key, h, n, sha, removed: flat array of starts and ends, maximal and in order; one row per document) and
    ``texts`` (row, text) of the documents that are removed in part. ``h`` is ``xxhash64`` of the text, for joins.

    1. Every text gives its anchors (about one in 170 bytes). Equal strings have equal anchors at the same place.
       Equal texts are one class: all of them are removed if long enough, and one stands for them in what follows.
    2. Anchors whose gram occurs once in the corpus cannot belong to a repeat and go; the gram counts are partial sums.
    3. The suffixes at the other anchors are sorted into runs, front-coded and exchanged by ranges of their first bytes (and of the gram,
       where many begin alike; as many ranges as the number of suffixes asks for); each
       range is merged by a loser tree that yields the common prefixes; where they are long enough, left contexts are compared, too.
       Suffixes of a gram with more than ``hot`` anchors would meet in one task; their strings are counted instead.
    4. Each anchor's reach gives spans; spans of a document are united.

    Null text counts as empty. Texts shorter than ``length`` lose nothing. A document given twice is two documents that
    are equal. Matches never cross documents.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs, key, text)
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    found = store(describe(keyed, length), "anchors")
    classes = store(found.groupBy("h", "sha").agg(F.min("row").alias("row"), F.count("*").alias("copies")), "classes")
    single = found.select("row", "key", "h", "anchors", "grams", "heads", "spans").join(classes.select("row"), "row", "left_semi")
    each = single.select("row", F.explode(F.arrays_zip("anchors", "grams", "heads")).alias("x")).select(
        "row", F.col("x.anchors").alias("place"), F.col("x.grams").alias("gram"), F.col("x.heads").alias("head"))
    often = each.groupBy("gram").agg(F.count("*").alias("c")).filter("c > 1").select("gram", (F.col("c") > hot).alias("hot"))
    chosen = store(each.join(often, "gram").select("row", "place", "head", "hot"), "repeated")
    of = lambda kind: F.sort_array(F.collect_list(F.when(kind, F.col("place"))))
    places = chosen.groupBy("row").agg(of(~F.col("hot")).alias("anchors"), of(F.col("hot")).alias("hot"))
    wanted = (
        single.select("row", "key", "h", "spans").join(places, "row", "left")
        .filter(F.col("anchors").isNotNull() | (F.size("spans") > 0))
    )
    texts = store(
        keyed.filter(F.octet_length("text") >= length).join(wanted, ["key", "h"])
        .select("row", "text", "anchors", "hot", "spans").dropDuplicates(["row"]), "texts")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chosen.filter(~F.col("hot")).count() // RANGE))
    shares = [i / parts for i in range(1, parts)]
    bounds = sorted((chosen.agg(F.percentile_approx("head", shares, min(100 * parts, 1_000_000))).first()[0] if shares else []) or [])
    reach = merged_extents(sorted_runs(texts, bounds, length), parts, length).unionByName(counted_strings(texts, length))
    pairs = reach.select("row", F.array("start", "end").alias("s")).unionByName(
        texts.select("row", F.explode("spans").alias("s")))

    @F.arrow_udf("array<bigint>")
    def united(spans: pa.Array) -> pa.Array:
        return pa.array([[x for s in merge_spans([tuple(y) for y in row]) for x in s] for row in spans.to_pylist()], pa.list_(pa.int64()))

    part = store(pairs.groupBy("row").agg(F.collect_list("s").alias("s")).select("row", united("s").alias("part")), "spans")
    removed = (
        F.when(F.col("n") < length, F.array().cast("array<bigint>"))
        .when(F.col("copies") > 1, F.array(F.lit(0).cast("long"), F.col("n")))
        .otherwise(F.coalesce("part", F.array().cast("array<bigint>")))
    )
    spans = (
        found.select("row", "key", "h", "n", "sha").join(classes.select("h", "sha", "copies"), ["h", "sha"])
        .join(part, "row", "left").select("row", "key", "h", "n", "sha", removed.alias("removed"))
    )
    return spans, texts.select("row", "text").join(part.select("row"), "row", "left_semi")


def _rest(text: str | None, spans: list[int] | None) -> bytes:
    data, at, kept = (text or "").encode(), 0, []
    for s, e in zip((spans or [])[::2], (spans or [])[1::2]):
        kept.append(data[at:s])
        at = e
    return b"".join([*kept, data[at:]])


def cut(text: Column | str, spans: Column | str) -> Column:
    """What is left of a text's bytes without its spans; null or no spans leave it whole."""

    @F.arrow_udf("binary")
    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([_rest(t.as_py(), s.as_py()) for t, s in zip(texts, spans)], pa.binary())

    return run(text, spans)


def cut_text(text: Column | str, spans: Column | str) -> Column:
    """As ``cut``, as text: a character that a span cuts in two is left out. Null where there are no spans."""

    @F.arrow_udf("string")
    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([
            _rest(t.as_py(), s.as_py()).decode("utf-8", "ignore") if s.is_valid else None for t, s in zip(texts, spans)], pa.string())

    return run(text, spans)


def removed_bytes(spans: Column) -> Column:
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, b: a + b)


def q_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, texts = repeated_spans(documents(spark, sf_dir))
    spans = store(spans, "removed")
    partly = texts.join(spans.select("row", "removed"), "row").select("row", F.sha2(cut("text", "removed"), 256).alias("rest"))
    n_removed = removed_bytes(F.col("removed"))
    return spans.join(partly, "row", "left").select(
        F.nullif("key", F.lit(NO_KEY)).alias("doc_id"), F.col("n").alias("n_bytes"), n_removed.alias("n_removed"),
        (F.size("removed") / 2).cast("long").alias("n_spans"),
        F.when(n_removed == 0, F.col("sha")).when(n_removed == F.col("n"), F.lit(hashlib.sha256().hexdigest()))
        .otherwise(F.col("rest")).alias("kept_sha256"))


QUERIES = {"op4_suffix_run_repeats": (q_repeats, None)}
