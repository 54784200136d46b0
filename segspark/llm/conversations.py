"""Repair of conversations: cheapest edits to a legal order of roles, by auction shortest paths over blocks of turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.llm.common import BoundedDict, bounded_batches, store, worker_cache

#: Costs of the edits, and what an undeleted truncated turn adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Turns and characters of a block.
BLOCK, BLOCK_CHARS = 128, 1 << 20
FAR = 1 << 40
#: States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a. The last of an answer, or nothing at all, may be the end.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FILL = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
END = (0, FAR, FAR, 0)
BLANK = r"[^\x20\x09-\x0D]"
WHITE = " \t\n\x0b\f\r"


class Lattice:
    """Nodes (turn, state) of one block and its arcs (letter, cost, node), letters in order; the last node is the sink.

    ``pattern`` has one letter for each turn: the initial of its role (``x`` for any other than s, u, a), in upper case if the turn is
    truncated, ``-`` if it must be deleted. ``closed``: what it costs to go on from each state after the block;
    ``last``: turns may be inserted after the last one, too (else that is left to the next block).
    """

    def __init__(self, pattern: str, closed: tuple[int, ...], last: bool):
        n = len(pattern)
        self.sink = 4 * n + 4
        self.arcs: list[list[tuple[str, int, int]]] = []
        least = 0
        floor = [0]
        for i, kind in enumerate(pattern):
            more = TRUNCATED if kind.isupper() else 0
            for q in range(4):
                arcs = [("D", DELETE, 4 * i + 4 + q), ("I", INSERT, 4 * i + FILL[q])]
                if kind != "-":
                    if (to := NEXT[q].get(kind.lower())) is not None:
                        arcs.append(("K", KEEP + more, 4 * i + 4 + to))
                    arcs.append(("R", REROLE + more, 4 * i + 4 + FILL[q]))
                self.arcs.append(arcs)
            floor.append(min(DELETE, KEEP + more if kind.lower() in "sua" else REROLE + more) if kind != "-" else DELETE)
        for q in range(4):
            self.arcs.append(([("", closed[q], self.sink)] if closed[q] < FAR else []) + ([("I", INSERT, 4 * n + FILL[q])] if last else []))
        self.arcs.append([])
        # Prices to begin with: what the turns to come cost at least. No arc costs less than the difference.
        least = min(closed) if min(closed) < FAR else 0
        prices = []
        for m in reversed(floor[1:]):
            prices.append(least)
            least += m
        prices.append(least)
        self.price = [p for p in reversed(prices) for _ in range(4)] + [0]
        self.bound = 8 * n + 3 * INSERT + 1 + max([c for c in closed if c < FAR], default=0)

    def auction(self, origin: int) -> int:
        """Length of the shortest path from ``origin`` to the sink; afterwards the prices on it are exact.

        A path starts at the origin. Where its end is cheaper than its best arc, its price rises to that and the path contracts; else it
        extends by that arc. No price ever exceeds an arc's cost plus the price at its head, so prices can be kept for other origins.
        """
        arcs, price = self.arcs, self.price
        path = [origin]
        while path[-1] != self.sink:
            at = path[-1]
            best, to = FAR, -1
            for _, cost, head in arcs[at]:
                if cost + price[head] < best:
                    best, to = cost + price[head], head
            if best > self.bound:
                best = FAR
            if price[at] < best:
                price[at] = best
                if len(path) > 1:
                    path.pop()
                elif best == FAR:
                    return FAR
            elif best == FAR:
                return FAR
            else:
                path.append(to)
        return price[origin]

    def trace(self, origin: int) -> tuple[str, int]:
        """Letters of the ASCII-least shortest path and the node where it leaves the block. Needs ``auction(origin)``.

        Every shortest path runs along tight arcs only, on which the price falls by exactly the cost. They are tried in the order of their
        letters; a node from which none leads on is not entered again.
        """
        dead: set[int] = set()
        path, letters = [origin], []
        while path[-1] != self.sink:
            at = path[-1]
            for letter, cost, head in self.arcs[at]:
                if head not in dead and self.price[at] == cost + self.price[head]:
                    path.append(head)
                    letters.append(letter)
                    break
            else:
                dead.add(path.pop())
                letters.pop()
        return "".join(letters), path[-2] % 4


def cheapest(pattern: str) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    lattice = Lattice(pattern, END, last=True)
    cost = lattice.auction(0)
    return cost, lattice.trace(0)[0]


def block_costs(pattern: str) -> list[int]:
    """Least costs from each state before a block to each state after it, row by row; ``FAR`` if there is no way."""
    out = [[FAR] * 4 for _ in range(4)]
    for end in range(4):
        lattice = Lattice(pattern, tuple(0 if q == end else FAR for q in range(4)), last=False)
        for start in range(4):
            out[start][end] = lattice.auction(start)
    return [x for row in out for x in row]


def replay(audit: str, state: int, roles: Iterable[str], texts: Iterable[str]) -> tuple[list[tuple[str, str]], int]:
    """The repaired turns of a block and the state after it."""
    out, rows = [], zip(roles, texts)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        state = NEXT[state][role[:1]] if edit == "K" else FILL[state]
        out.append((role if edit == "K" else ROLE[state], text))
    return out, state


def damage(turns: DataFrame) -> DataFrame:
    """The damaged rows of (conv_id, turn, role, text): by a hash of conversation and turn some are dropped, emptied, cut, repeated
    or given the role user. Null role and text are one space, as are null numbers in the hash; a null turn stays null."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    return (
        turns.select("conv_id", "turn", "role", "text", h.alias("_h")).filter("_h <> 0")
        .select("conv_id", "turn", F.when(F.col("_h") == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"),
                F.explode(F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
        .drop("_copy")
    )


def marked(rows: DataFrame) -> DataFrame:
    """Adds ``mark`` (a hash of role and text), ``later`` (the same role and text stand at an earlier turn), ``blank`` and ``cut``."""
    mark = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    rows = rows.withColumn("mark", mark)
    turn = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    # Few texts come again at another turn; only those are looked up.
    again = (
        rows.groupBy("conv_id", "mark").agg(F.min(turn).alias("first"), F.max(turn).alias("last")).filter("first < last")
        .select(F.col("conv_id").alias("_c"), F.col("mark").alias("_m"), "first")
    )
    last = F.right(F.rtrim(F.col("text"), F.lit(WHITE)), F.lit(1))
    return rows.join(again, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("mark") == F.col("_m")), "left").select(
        "conv_id", "turn", "role", "text", "mark", F.coalesce(turn > F.col("first"), F.lit(False)).alias("later"),
        (~F.col("text").rlike(BLANK)).alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))


_COUNTS = ["n", "blank", "duplicate", "truncated", "illegal", "turns"]
_BLOCK = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int64()), ("whole", pa.bool_()), *[(c, pa.int64()) for c in _COUNTS],
    ("low", pa.int64()), ("high", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("pattern", pa.string()),
    ("costs", pa.list_(pa.int64())), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()),
    ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
_BLOCK_DDL = (
    "conv_id long, part int, block long, whole boolean, " + ", ".join(f"{c} long" for c in _COUNTS)
    + ", low long, high long, head string, tail string, pattern string, costs array<bigint>, cost long, audit string, "
    "repaired_sha256 string, roles array<string>, texts array<string>")


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _sha(turns: Iterable[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def cut_in_blocks(rows: DataFrame, keep_rows: bool = False) -> DataFrame:
    """One row for each block of turns of a conversation. Blocks that are a whole conversation are repaired at once.

    Turns are cut into ranges of (conversation, turn, mark), so a conversation of any length is spread over many tasks, which hold one
    block at a time. A conversation at the edge of a range may go on in the next; it, and every one longer than a block, comes back
    as blocks with the costs between their outer states, and with their turns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        solved = worker_cache("cheapest", lambda: BoundedDict(cheapest, 100_000))
        crossed = worker_cache("block_costs", lambda: BoundedDict(block_costs, 100_000))
        ready: list[dict] = []

        def block(turns: list[tuple], number: int, whole: bool) -> dict:
            conv = turns[0][0]
            pattern, counts, low, high, seen, before = [], dict.fromkeys(_COUNTS, 0), None, None, None, None
            for _, turn, role, _, blank, duplicate, cut in turns:
                fault = "blank" if blank else "duplicate" if duplicate else "truncated" if cut else None
                if fault:
                    counts[fault] += 1
                initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
                pattern.append("-" if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
                if turn is not None:
                    counts["turns"] += turn != seen
                    seen = turn
                    low, high = (turn if low is None else low), turn
                counts["illegal"] += before is not None and not _legal(before, role[:1])
                before = role[:1]
            counts["n"], pattern = len(turns), "".join(pattern)
            roles, texts = [t[2] for t in turns], [t[3] for t in turns]
            out = {"conv_id": conv, "part": part, "block": number, "whole": whole, **counts, "low": low, "high": high, "head": turns[0][2][:1],
                   "tail": before, "pattern": pattern}
            if whole:
                out["cost"], out["audit"] = solved[pattern]
                fixed = replay(out["audit"], 0, roles, texts)[0]
                out["repaired_sha256"] = _sha(fixed)
                if keep_rows:
                    out["roles"], out["texts"] = [r for r, _ in fixed], [t for _, t in fixed]
            else:
                out |= {"costs": crossed[pattern], "roles": roles, "texts": texts}
            return out

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist(ready, schema=_BLOCK)
            ready.clear()
            return out

        own: list[tuple] = []
        size, number, first, last = 0, 0, True, None
        for got in batches:
            for conv, turn, role, text, mark, later, blank, cut in zip(*(c.to_pylist() for c in got.columns)):
                if own and conv != own[0][0]:
                    ready.append(block(own, number, not first and number == 0))
                    own, size, number, first = [], 0, 0, False
                elif len(own) >= BLOCK or size >= BLOCK_CHARS:
                    ready.append(block(own, number, False))
                    own, size, number = [], 0, number + 1
                # Equal rows stand next to each other.
                same = (conv, turn, mark) == last
                last = (conv, turn, mark)
                own.append((conv, turn, role, text, blank, later or same, cut))
                size += len(text)
                if len(ready) >= 500 or len(ready) and size >= BLOCK_CHARS:
                    yield batch()
        if own:
            ready.append(block(own, number, False))
        if ready:
            yield batch()

    order = ["conv_id", "turn", "mark"]
    return (
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("conv_id", "turn", "role", "text", "mark", "later", "blank", "cut").mapInArrow(run, _BLOCK_DDL)
    )


def costs_to_go(blocks: DataFrame) -> DataFrame:
    """(conv_id, part, block, ahead, final): what is left to pay from each state after a block; blocks are read from the last to the
    first, four numbers are carried on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ahead = None, END
        for got in batches:
            out = []
            for conv, part, block, costs in zip(*(c.to_pylist() for c in got.columns)):
                final = last is None or conv != last[0]
                if final:
                    # Answers that are missing at the end can still be put in.
                    last, ahead = (conv,), (0, 2 * INSERT, INSERT, 0)
                out.append((conv, part, block, list(END) if final else list(ahead), final))
                ahead = tuple(min(min(costs[4 * q + e] + ahead[e] for e in range(4)), FAR) for q in range(4))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.bool_()))],
                ["conv_id", "part", "block", "ahead", "final"])

    return (
        blocks.select("conv_id", "part", "block", "costs").repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("part").desc(), F.col("block").desc())
        .mapInArrow(run, "conv_id long, part int, block long, ahead array<bigint>, final boolean")
    )


def trace_blocks(blocks: DataFrame) -> DataFrame:
    """Adds ``audits`` and ``exits``: for each state before a block the cheapest edits, ASCII-least, and the state they lead to."""

    def traced(pattern: str, ahead: tuple[int, ...], final: bool) -> tuple[list[str], list[int]]:
        lattice = Lattice(pattern, ahead, final)
        audits, exits = [], []
        for start in range(4):
            audit, end = lattice.trace(start) if lattice.auction(start) < FAR else (None, -1)
            audits.append(audit)
            exits.append(end)
        return audits, exits

    @F.arrow_udf("struct<audits: array<string>, exits: array<int>>")
    def run(pattern: pa.Array, ahead: pa.Array, final: pa.Array) -> pa.Array:
        found = [traced(p, tuple(a), f) for p, a, f in zip(pattern.to_pylist(), ahead.to_pylist(), final.to_pylist())]
        return pa.StructArray.from_arrays(
            [pa.array([x[0] for x in found], pa.list_(pa.string())), pa.array([x[1] for x in found], pa.list_(pa.int32()))], ["audits", "exits"])

    return blocks.withColumn("_t", run("pattern", "ahead", "final")).select("*", "_t.audits", "_t.exits").drop("_t")


_RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_RESULT_DDL = "conv_id long, " + ", ".join(f"{c} long" for c in _RESULT) + ", audit string, repaired_sha256 string"


def join_blocks(blocks: DataFrame) -> DataFrame:
    """One row for each conversation of several blocks; they are read in order, one at a time.

    The digest of a conversation can only be made in the order of its text, so that much is one task's work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sums = None, None

        def done() -> pa.RecordBatch:
            sums["audit"] = "".join(sums["audit"])
            gaps = 0 if sums["low"] is None else sums["high"] - sums["low"] + 1 - sums["turns"]
            row = {"conv_id": conv, "gaps": gaps, **{c: sums[c] for c in _RESULT[1:]}, "audit": sums["audit"], "repaired_sha256": sums["sha"].hexdigest()}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema(
                [("conv_id", pa.int64()), *[(c, pa.int64()) for c in _RESULT], ("audit", pa.string()), ("repaired_sha256", pa.string())]))

        for got in batches:
            for i in range(got.num_rows):
                b = {name: got.column(name)[i].as_py() for name in got.schema.names}
                if sums is None or b["conv_id"] != conv:
                    if sums is not None:
                        yield done()
                    conv = b["conv_id"]
                    sums = dict.fromkeys([*_RESULT, "turns"], 0) | {"state": 0, "low": None, "high": None, "tail": None, "audit": [], "sha": hashlib.sha256(), "any": False}
                for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
                    sums[c] += b[c]
                sums["illegal"] += sums["tail"] is not None and not _legal(sums["tail"], b["head"])
                sums["tail"] = b["tail"]
                if b["low"] is not None:
                    sums["turns"] -= b["low"] == sums["high"]
                    sums["low"] = b["low"] if sums["low"] is None else sums["low"]
                    sums["high"] = b["high"]
                audit = b["audits"][sums["state"]]
                sums["audit"].append(audit)
                paid = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}
                places = iter(b["pattern"])
                for edit in audit:
                    kind = "-" if edit == "I" else next(places)
                    sums["cost"] += paid[edit] + (TRUNCATED if edit in "KR" and kind.isupper() else 0)
                for role, text in replay(audit, sums["state"], b["roles"], b["texts"])[0]:
                    sums["sha"].update(f"{chr(10) if sums['any'] else ''}{role}:{text}".encode())
                    sums["any"] = True
                sums["state"] = b["exits"][sums["state"]]
        if sums is not None:
            yield done()

    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").mapInArrow(run, _RESULT_DDL)


def _open_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of conversations that are not whole, with their four traces."""
    part = blocks.filter("not whole")
    ahead = costs_to_go(part).toDF("_c", "_p", "_b", "ahead", "final")
    return store(trace_blocks(part.join(
        ahead, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")) & (F.col("block") == F.col("_b"))).drop("_c", "_p", "_b")), "traced")


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of (conv_id, turn, role, text).

    Turns stand in the order of their number, null first, equal numbers by a hash of role and text. Null role and text are empty.
    A null conversation is one of its own. Role and text that were seen before are a duplicate. Roles that do not begin with s, u or a
    (or are empty) cannot be kept. No rows give no rows.
    """
    bounded_batches(rows.sparkSession)
    blocks = store(cut_in_blocks(marked(rows.fillna("", ["role", "text"]))), "blocks")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    whole = blocks.filter("whole").select("conv_id", gaps.alias("gaps"), *_RESULT[1:], "audit", "repaired_sha256")
    return whole.unionByName(join_blocks(_open_blocks(blocks)))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, part, block, place, role, text): the turns themselves after the repair, in the order of these numbers."""
    bounded_batches(rows.sparkSession)
    blocks = store(cut_in_blocks(marked(rows.fillna("", ["role", "text"])), keep_rows=True), "blocks")

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, begun = None, 0, False
        for got in batches:
            out = []
            for c, part, block, exits in zip(*(x.to_pylist() for x in got.columns)):
                if not begun or c != conv:
                    conv, state, begun = c, 0, True
                out.append((c, part, block, state))
                state = exits[state]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int32()))],
                                             ["_c", "_p", "_b", "state"])

    @F.arrow_udf("struct<roles: array<string>, texts: array<string>>")
    def fixed(audits: pa.Array, state: pa.Array, roles: pa.Array, texts: pa.Array) -> pa.Array:
        out = [replay(a[s], s, r, t)[0] for a, s, r, t in zip(*(x.to_pylist() for x in (audits, state, roles, texts)))]
        kind = pa.list_(pa.string())
        return pa.StructArray.from_arrays([pa.array([[x[i] for x in o] for o in out], kind) for i in (0, 1)], ["roles", "texts"])

    traced = _open_blocks(blocks)
    entry = traced.select("conv_id", "part", "block", "exits").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").mapInArrow(
        states, "_c long, _p int, _b long, state int")
    rest = traced.join(entry, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")) & (F.col("block") == F.col("_b")))
    rest = rest.select("conv_id", "part", "block", fixed("audits", "state", "roles", "texts").alias("x")).select("conv_id", "part", "block", "x.*")
    both = blocks.filter("whole").select("conv_id", "part", "block", "roles", "texts").unionByName(rest)
    return both.select("conv_id", "part", "block", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "x")).select(
        "conv_id", "part", "block", "place", "x.roles", "x.texts").toDF("conv_id", "part", "block", "place", "role", "text")


def q_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs damaged conversations; one of which no row is left after the damage has zeros."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = repair(damage(turns))
    left = damage(turns).select("conv_id", F.lit(1).alias("_left"))
    gone = turns.select("conv_id", F.lit(0).alias("_left")).unionByName(left).groupBy("conv_id").agg(F.max("_left").alias("_left")).filter("_left = 0")
    nothing = gone.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in _RESULT], F.lit("").alias("audit"),
                          F.lit(hashlib.sha256().hexdigest()).alias("repaired_sha256"))
    return found.unionByName(nothing)


def _sql() -> str:
    def go(letter: str, cost: str, state: str, turn: str | None = None) -> str:
        t = f"list_append({state}.t, {turn})" if turn else f"{state}.t"
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {t}}} END"

    keep = lambda q, r: f"CASE WHEN ok AND i = '{r}' THEN {go('K', 'e', q, 'role || chr(58) || text')} END"
    role = lambda q, r: f"CASE WHEN ok THEN {go('R', '1 + e', q, repr(r + ':') + ' || text')} END"
    fill = lambda q, r: go("I", "5", q, repr(r + ":"))
    nothing = "NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])"
    start = "{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}"
    return f"""
WITH RECURSIVE bits AS (
  SELECT v, list_reduce(list_prepend(v, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t
  FROM (SELECT unnest(range(256)) AS v)
), tab AS (SELECT list(t ORDER BY v) AS t FROM bits),
base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'),
      lambda h: ('0x' || h)::BIGINT)), lambda x, b: xor(t[(xor(x, b) & 255) + 1], x >> 8)), 4294967295) % 20 AS h
  FROM conversations, tab
), hurt AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM base WHERE h <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text), copy) AS p FROM hurt
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 AS again, substr(role, 1, 1) AS i,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY p) AS j, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM placed
), faults AS (
  SELECT *, body = '' AS blank, body <> '' AND again AS dup, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS cut FROM seen
), sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(blank)::BIGINT AS blank,
    count_if(dup)::BIGINT AS duplicate, count_if(cut)::BIGINT AS truncated,
    count_if(j IS NOT NULL AND j || i NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, max(p) AS n FROM faults GROUP BY conv_id
), steps AS (
  SELECT conv_id, p, i, role, text, NOT (blank OR dup) AS ok, CASE WHEN cut THEN 5 ELSE 0 END AS e FROM faults
), dp AS (
  SELECT conv_id, 0::BIGINT AS p, k0, {nothing} AS k1, k2, {fill('k2', 'assistant')} AS k3
  FROM (SELECT conv_id, {start} AS k0, {fill(start, 'user')} AS k2 FROM sums)
  UNION ALL
  SELECT conv_id, p, m0, m1, k2, least(m3, {fill('k2', 'assistant')})
  FROM (
    SELECT conv_id, p, m0, m1, m3, least(m2, {fill('m0', 'user')}, {fill('m1', 'user')}, {fill('m3', 'user')}) AS k2
    FROM (
      SELECT s.conv_id, s.p, {go('D', '2', 'k0')} AS m0, least({go('D', '2', 'k1')}, {keep('k0', 's')}) AS m1,
        least({go('D', '2', 'k2')}, {', '.join(f(q, r) for q in ('k0', 'k1', 'k3') for f, r in ((keep, 'u'), (role, 'user')))}) AS m2,
        least({go('D', '2', 'k3')}, {keep('k2', 'a')}, {role('k2', 'assistant')}) AS m3
      FROM dp JOIN steps s ON dp.conv_id IS NOT DISTINCT FROM s.conv_id AND s.p = dp.p + 1
    )
  )
), ends AS (
  SELECT dp.conv_id, least(k0, k3) AS f FROM dp JOIN sums ON dp.conv_id IS NOT DISTINCT FROM sums.conv_id AND dp.p = sums.n
), every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(f.c, 0)::BIGINT AS cost, coalesce(f.a, '') AS audit,
  sha256(coalesce(array_to_string(f.t, chr(10)), '')) AS repaired_sha256
FROM every v LEFT JOIN sums s ON v.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN ends e ON v.conv_id IS NOT DISTINCT FROM e.conv_id
"""


SQL = _sql()
QUERIES = {"op13_auction_conversations": (q_repair, SQL)}
