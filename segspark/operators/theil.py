"""Entropy, Theil's H and its decompositions, as additive aggregates.

With ``n * E = n ln n - sum(n_g ln n_g)`` per unit and ``S(level)`` its sum over the units of
a level,

    H  = (N E - S(leaf)) / (N E)
    Hw = (S(mid) - S(leaf)) / (N E)
    Hb = (N E - S(mid)) / (N E)

so no unit ever has to meet the total of its scope in a join: every level is one more
``groupBy`` over the rows of the level below, with map-side partial sums throughout. A scope,
mid or leaf that holds a large part of all rows therefore costs no more than any other.

Two layouts of the same measure are offered. With the group labels known, a leaf is one row
with one column per (group, source): one shuffle at leaf grain, and the focal split, extra
levels and all sources come out of the same rows. With unknown labels the groups stay in rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segspark.functions.numeric import ident, mass_text, safe_div, text_literal, xlnx, xlnx_text

ZERO_H = 1e-9


@dataclass(frozen=True)
class Hierarchy:
    """Roles of the columns of a count table.

    ``sources`` maps the label of a source to its count column. A table that has the source
    in rows names that column among ``scope`` and uses one source with the label ``None``.
    """

    scope: Sequence[str]
    leaf: Sequence[str]
    group: str
    sources: Mapping[str | None, str]
    mid: str | None = None

    @property
    def scope_cols(self) -> list[str]:
        return list(self.scope)

    @property
    def leaf_cols(self) -> list[str]:
        return list(self.leaf)


def _vec(i: int, s: int) -> str:
    return f"_n{i}_{s}"


def _bad(s: int) -> str:
    return f"_bad{s}"


def leaf_vectors(
    cells: DataFrame,
    keys: Sequence[str],
    group: str,
    groups: Sequence[str],
    values: Sequence[str],
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row per unit: a column ``_n{group}_{source}`` per group and source.

    A column is NULL where the unit has no row of that group, 0 where it has one that counts
    nothing; ``_bad{source}`` tells whether a count was missing. Rows of other groups only
    reach the ``extra`` aggregates.
    """
    listed = ", ".join(text_literal(g) for g in groups)
    known = f"{ident(group)} IN ({listed})"
    aggs = []
    for s, value in enumerate(values):
        v = ident(value)
        for i, g in enumerate(groups):
            hit = f"{ident(group)} = {text_literal(g)}"
            aggs.append(F.expr(f"sum(CASE WHEN {hit} THEN {v} END)").alias(_vec(i, s)))
        missing = f"{known} AND {v} IS NULL" if extra else f"{v} IS NULL"
        aggs.append(F.expr(f"max(CASE WHEN {missing} THEN 1 ELSE 0 END)").alias(_bad(s)))
    rows = cells if extra else cells.where(known)
    return rows.groupBy(*keys).agg(*aggs, *extra)


def _cols(n_groups: int, s: int) -> list[str]:
    return [_vec(i, s) for i in range(n_groups)]


def _two(n_groups: int, s: int, focal: int) -> list[str]:
    rest = [f"coalesce({_vec(i, s)}, 0)" for i in range(n_groups) if i != focal]
    return [_vec(focal, s), f"({' + '.join(rest)})" if rest else "0"]


def _rest(n_groups: int, s: int, focal: int) -> list[str]:
    return [_vec(i, s) for i in range(n_groups) if i != focal]


# Numbers of one scope and source from which every measure follows.
RAW = ["n", "mass", "s_leaf", "s_mid", "bad", "zero", "n_focal", "n_rest", "mass2", "s2_leaf", "mass_rest", "s_rest"]


def _raw_columns(
    total: list[str], s: int, s_mid: str | None, focal: int | None, with_rest: bool
) -> dict[str, str]:
    """Raw numbers of source ``s`` from the group totals of a scope, as expressions."""
    raw = {
        "n": " + ".join(f"coalesce({c}, 0)" for c in total),
        "mass": mass_text(total),
        "s_leaf": f"_leaf{s}",
        "bad": _bad(s),
        # A group that is there but counts nothing; an absent group is NULL.
        "zero": f"CASE WHEN {' OR '.join(f'{c} = 0' for c in total)} THEN 1 ELSE 0 END",
    }
    if s_mid is not None:
        raw["s_mid"] = s_mid
    if focal is not None:
        nf, nr = _two(len(total), s, focal)
        raw |= {"n_focal": f"coalesce({nf}, 0)", "n_rest": nr, "mass2": mass_text([nf, nr]), "s2_leaf": f"_leaf2{s}"}
        if with_rest:
            raw |= {"mass_rest": mass_text(_rest(len(total), s, focal)), "s_rest": f"_leafr{s}"}
    return raw


def _stack_sources(
    rows: DataFrame, keep: Sequence[str], labels: Sequence[str | None], raw: Sequence[dict[str, str]]
) -> DataFrame:
    """Source columns to rows. Scopes are all that is left here, so the explode is small."""
    names = list(raw[0])
    rows = rows.select(
        *keep, *[F.expr(f"CAST({c} AS DOUBLE)").alias(f"{k}_{s}") for s, cols in enumerate(raw) for k, c in cols.items()]
    )
    if list(labels) == [None]:
        return rows.select(*keep, *[F.col(f"{k}_0").alias(k) for k in names])
    entries = ", ".join(
        f"named_struct('name', {text_literal(label)}, " + ", ".join(f"'{k}', {k}_{s}" for k in names) + ")"
        for s, label in enumerate(labels)
    )
    return rows.select(*keep, F.expr(f"inline(array({entries}))"))


def _measures(rows: DataFrame, keep: Sequence[str], guard_total: bool) -> DataFrame:
    """The ratios, from raw numbers in columns."""
    has = set(rows.columns)
    ok = "bad = 0 AND n > 0" + ("" if guard_total else " AND zero = 0")
    rows = rows.withColumn("_ok", F.expr(ok))

    def part(num: str, cond: str = "_ok", den: str = "mass") -> Column:
        return F.expr(f"CASE WHEN {cond} THEN try_divide({num}, {den}) END")

    # A one-group scope has mass 0 and no defined H.
    first = {"H": part("mass - s_leaf"), "totalE": part("mass", den="n")}
    if "s_mid" in has:
        first |= {"Hw": part("s_mid - s_leaf"), "Hb": part("mass - s_mid")}
    if "mass2" in has:
        # mass2 / mass * H2 with H2 = (mass2 - s2_leaf) / mass2
        first["Hbg"] = part("mass2 - s2_leaf", "_ok AND n_focal > 0 AND n_rest > 0 AND mass2 > 0")
    if "mass_rest" in has:
        first["Hwg"] = part("mass_rest - s_rest", "_ok AND mass_rest > 0")
    rows = rows.withColumns(first)
    second = {}
    if "s_mid" in has:
        second["Pb"] = F.expr(f"CASE WHEN abs(H) >= {ZERO_H} THEN 1D - try_divide(Hw, H) END")
    if "mass2" in has:
        second["Pbg"] = F.expr(f"CASE WHEN abs(H) >= {ZERO_H} THEN try_divide(Hbg, H) END")
    made = {**first, **second}
    order = [m for m in ["Hw", "H", "totalE", "Hb", "Pb", "Hbg", "Pbg", "Hwg"] if m in made]
    name = ["name"] if "name" in has and "name" not in keep else []
    return rows.withColumns(second).select(*keep, *name, *order)


def decompose(
    cells: DataFrame,
    h: Hierarchy,
    groups: Sequence[str] | None = None,
    focal: str | None = None,
    with_rest: bool = False,
    guard_total: bool = False,
    wide: bool = False,
) -> DataFrame:
    """H, its within/between-mid split and, with ``focal``, the focal-against-rest part.

    ``guard_total=False`` makes a scope undefined as soon as one of its groups counts nothing
    there; ``True`` treats such a group as absent. ``with_rest`` adds ``Hwg``, the part of H
    among the other groups (``Hbg + Hwg = H``). ``wide``: ``cells`` has one row per leaf and a column per group
    of ``groups``, NULL where the leaf has no row of it; leaves are then not gathered again.
    """
    if groups is None:
        return _decompose_rows(cells, h, focal, with_rest, guard_total)
    return from_sums(mid_sums(cells, h, groups, focal, with_rest, wide=wide), h, groups, focal, with_rest, guard_total)


def _sum_names(n_sources: int, focal: str | None, with_rest: bool) -> list[str]:
    kinds = ["_leaf"] + (["_leaf2"] + (["_leafr"] if with_rest else []) if focal is not None else [])
    return [f"{kind}{s}" for s in range(n_sources) for kind in kinds]


def _carry(n_groups: int, n_sources: int) -> list[Column]:
    S = range(n_sources)
    return [F.sum(c).alias(c) for s in S for c in _cols(n_groups, s)] + [F.max(_bad(s)).alias(_bad(s)) for s in S]


def mid_sums(
    cells: DataFrame, h: Hierarchy, groups: Sequence[str], focal: str | None = None, with_rest: bool = False,
    part: Sequence[str] = (), wide: bool = False,
) -> DataFrame:
    """One row per scope and mid (and ``part``): group totals and sums over its leaves, from which every measure follows.

    Sums of disjoint sets of leaves add up to the sums of their union.
    """
    groups = list(groups)
    G, values = len(groups), list(h.sources.values())
    fi = groups.index(focal) if focal is not None else None
    keys = [*part, *h.scope_cols, *([h.mid] if h.mid else [])]
    if wide:
        if len(values) != 1:
            raise ValueError("wide cells have one source")
        leaves = cells.select(*keys, *[F.col(g).alias(_vec(i, 0)) for i, g in enumerate(groups)], F.lit(0).alias(_bad(0)))
    else:
        leaves = leaf_vectors(cells, [*keys, *h.leaf_cols], h.group, groups, values)
    sums = {}
    for s in range(len(values)):
        sums[f"_leaf{s}"] = mass_text(_cols(G, s))
        if fi is not None:
            sums[f"_leaf2{s}"] = mass_text(_two(G, s, fi))
            if with_rest:
                sums[f"_leafr{s}"] = mass_text(_rest(G, s, fi))
    return leaves.groupBy(*keys).agg(*_carry(G, len(values)), *[F.expr(f"sum({e})").alias(k) for k, e in sums.items()])


def added_sums(sums: DataFrame, h: Hierarchy, groups: Sequence[str], focal: str | None = None, with_rest: bool = False) -> DataFrame:
    """The rows of each scope and mid added up: the sums of all leaves, whatever parts they came in."""
    n = len(h.sources)
    keys = [*h.scope_cols, *([h.mid] if h.mid else [])]
    return sums.groupBy(*keys).agg(*_carry(len(groups), n), *[F.sum(k).alias(k) for k in _sum_names(n, focal, with_rest)])


def from_sums(
    rows: DataFrame, h: Hierarchy, groups: Sequence[str], focal: str | None = None, with_rest: bool = False,
    guard_total: bool = False,
) -> DataFrame:
    """The measures of ``decompose`` from one row per scope and mid."""
    groups = list(groups)
    G, labels, n = len(groups), list(h.sources), len(h.sources)
    fi = groups.index(focal) if focal is not None else None
    scope = h.scope_cols
    if h.mid:
        mids = [F.expr(f"sum({mass_text(_cols(G, s))})").alias(f"_mid{s}") for s in range(n)]
        rows = rows.groupBy(*scope).agg(*_carry(G, n), *[F.sum(k).alias(k) for k in _sum_names(n, focal, with_rest)], *mids)
    raw = [_raw_columns(_cols(G, s), s, f"_mid{s}" if h.mid else None, fi, with_rest) for s in range(n)]
    return _measures(_stack_sources(rows, scope, labels, raw), scope, guard_total)


def _decompose_rows(
    cells: DataFrame, h: Hierarchy, focal: str | None, with_rest: bool, guard_total: bool
) -> DataFrame:
    """The same measures with groups in rows, for labels that are not known beforehand.

    One shuffle makes the cells; leaf sums and (mid, group) sums are two further aggregates of
    them, and their results meet in a union of partial sums, again without a join.
    """
    labels, values = list(h.sources), list(h.sources.values())
    scope, mid = h.scope_cols, [h.mid] if h.mid else []
    S = range(len(values))
    is_focal = f"{ident(h.group)} = {text_literal(focal)}" if focal is not None else "false"
    missing = [f"max(CASE WHEN {ident(v)} IS NULL THEN 1 ELSE 0 END)" for v in values]
    cells = cells.groupBy(*scope, *mid, *h.leaf_cols, h.group).agg(
        *[F.sum(v).alias(f"_n{s}") for s, v in enumerate(values)],
        *[F.expr(m).alias(_bad(s)) for s, m in enumerate(missing)],
    )

    def unit_sums(keys: Sequence[str], df: DataFrame) -> DataFrame:
        """Per unit: count, sum of n ln n, both also for the focal group alone."""
        aggs = {}
        for s in S:
            n = f"_n{s}"
            aggs |= {
                f"_t{s}": f"coalesce(sum({n}), 0)",
                f"_x{s}": f"sum({xlnx_text(n)})",
                f"_f{s}": f"coalesce(sum(CASE WHEN {is_focal} THEN {n} ELSE 0 END), 0)",
                f"_xr{s}": f"sum(CASE WHEN {is_focal} THEN 0D ELSE {xlnx_text(n)} END)",
                _bad(s): f"max({_bad(s)})",
                f"_z{s}": f"max(CASE WHEN {n} = 0 THEN 1 ELSE 0 END)",
            }
        return df.groupBy(*keys).agg(*[F.expr(e).alias(k) for k, e in aggs.items()])

    group_sums = [F.sum(f"_n{s}").alias(f"_n{s}") for s in S] + [F.max(_bad(s)).alias(_bad(s)) for s in S]
    parts = {"leaf": unit_sums([*scope, *mid, *h.leaf_cols], cells)}
    by_mid = cells
    if mid:
        by_mid = cells.groupBy(*scope, *mid, h.group).agg(*group_sums)
        parts["mid"] = unit_sums([*scope, *mid], by_mid)
    parts["scope"] = unit_sums(scope, by_mid.groupBy(*scope, h.group).agg(*group_sums))

    # Each part fills its own numbers of the scope and leaves the others at 0.
    names = ["n", "mass", "s_leaf", *(["s_mid"] if mid else []), "bad", "zero"]
    if focal is not None:
        names += ["n_focal", "n_rest", "mass2", "s2_leaf"] + (["mass_rest", "s_rest"] if with_rest else [])
    stacked = None
    for tag, df in parts.items():
        cols = []
        for s in S:
            t, f = f"_t{s}", f"_f{s}"
            m = f"{xlnx_text(t)} - _x{s}"
            m2 = f"{xlnx_text(t)} - {xlnx_text(f)} - {xlnx_text(f'({t} - {f})')}"
            mr = f"{xlnx_text(f'({t} - {f})')} - _xr{s}"
            have = {
                "scope": {"n": t, "mass": m, "bad": _bad(s), "zero": f"_z{s}", "n_focal": f,
                          "n_rest": f"{t} - {f}", "mass2": m2, "mass_rest": mr},
                "mid": {"s_mid": m},
                "leaf": {"s_leaf": m, "s2_leaf": m2, "s_rest": mr},
            }[tag]
            cols += [F.expr(f"CAST({have.get(k, '0')} AS DOUBLE)").alias(f"{k}_{s}") for k in names]
        piece = df.select(*scope, *cols)
        stacked = piece if stacked is None else stacked.unionByName(piece)
    rows = stacked.groupBy(*scope).agg(*[F.sum(f"{k}_{s}").alias(f"{k}_{s}") for s in S for k in names])
    return _measures(_stack_sources(rows, scope, labels, [{k: f"{k}_{s}" for k in names} for s in S]), scope, guard_total)


def unit_entropy(
    cells: DataFrame,
    unit: Sequence[str],
    group: str,
    value: str,
    groups: Sequence[str] | None = None,
) -> DataFrame:
    """Entropy ``E`` and count ``Pop`` of each unit; an empty unit has entropy 0."""
    if groups is not None:
        cells = cells.where(F.col(group).isin(list(groups)))
    cells = cells.groupBy(*unit, group).agg(
        F.sum(value).alias("_n"), F.max(F.when(F.col(value).isNull(), 1).otherwise(0)).alias("_b")
    )
    rows = cells.groupBy(*unit).agg(
        F.sum("_n").alias("_t"), F.sum(xlnx(F.col("_n"))).alias("_x"), F.max("_b").alias("_b")
    )
    mass = xlnx(F.col("_t")) - F.col("_x")
    return rows.select(
        *unit,
        F.when(F.col("_b") == 0, F.coalesce(safe_div(mass, F.col("_t")), F.lit(0.0)))
        .otherwise(F.lit(0.0))
        .alias("E"),
        F.when(F.col("_b") == 0, F.col("_t")).alias("Pop"),
    )


def nested_levels(
    cells: DataFrame,
    h: Hierarchy,
    levels: Mapping[str, str],
    groups: Sequence[str],
    center: tuple[str, str, str, str] | None = None,
    guard_total: bool = False,
) -> DataFrame:
    """The decomposition for several nested mids of the same leaves, stacked by ``Level``.

    ``levels`` maps a level label to its mid column. ``center`` is
    ``(label, level, no_place, pop_column)``: it adds a level with two mids, the most populous
    mid of ``level`` (all groups counted, ties to the first name, ``no_place`` never chosen)
    against everything else, and a column ``center`` with its name.

    One leaf shuffle, one (level, mid) shuffle and one scope shuffle serve all levels. The
    leaf part is additive, so it travels with the mids; the two mids of the centre level
    follow from the scope total minus the chosen mid, hence need no join. A leaf that belongs
    to two mids of one level must bring the same counts to both (ties of an assignment do).
    """
    groups = list(groups)
    G, labels, values = len(groups), list(h.sources), list(h.sources.values())
    S = range(len(values))
    scope = h.scope_cols
    pop = center[3] if center else None
    extra = [F.sum(pop).alias("_pop")] if pop else []
    mids = list(dict.fromkeys(levels.values()))
    leaves = leaf_vectors(cells, [*scope, *mids, *h.leaf_cols], h.group, groups, values, extra)
    vec_names = [c for s in S for c in _cols(G, s)]
    leaves = leaves.withColumns({f"_leaf{s}": F.expr(mass_text(_cols(G, s))) for s in S})
    carried = [*vec_names, *[f"_leaf{s}" for s in S], *(["_pop"] if pop else [])]
    placed = ", ".join(
        f"named_struct('Level', {text_literal(label)}, 'mid', CAST({ident(col)} AS STRING))"
        for label, col in levels.items()
    )
    by_level = leaves.select(*scope, *carried, *[_bad(s) for s in S], F.expr(f"inline(array({placed}))"))
    bad = [F.max(_bad(s)).alias(_bad(s)) for s in S]
    mid_rows = by_level.groupBy(*scope, "Level", "mid").agg(*[F.sum(c).alias(c) for c in carried], *bad)

    # One row per scope: totals from the rows of one level, a mid sum per level and source.
    base = center[1] if center else next(iter(levels))
    at_base = f"Level = {text_literal(base)}"
    aggs = [F.expr(f"sum(CASE WHEN {at_base} THEN {c} END)").alias(c) for c in carried if c != "_pop"] + bad
    mid_sums = {}
    for j, label in enumerate(levels):
        here = f"Level = {text_literal(label)}"
        mid_sums[label] = [f"_mid{j}_{s}" for s in S]
        aggs += [
            F.expr(f"sum(CASE WHEN {here} THEN {mass_text(_cols(G, s))} END)").alias(f"_mid{j}_{s}") for s in S
        ]
    if center:
        usable = f"{at_base} AND mid <> {text_literal(center[2])}"
        chosen = ", ".join(f"'{c}', {c}" for c in [*vec_names, "mid"])
        # min_by over (-population, name): the largest, ties to the first name.
        aggs.append(F.expr(
            f"min_by(CASE WHEN {usable} THEN named_struct({chosen}) END, "
            f"CASE WHEN {usable} THEN named_struct('p', -coalesce(_pop, 0), 'm', mid) END)"
        ).alias("_best"))
    rows = mid_rows.groupBy(*scope).agg(*aggs)
    rows = rows.where(" OR ".join(f"{c} IS NOT NULL" for c in vec_names))
    keep = [*scope]
    if center:
        mid_sums[center[0]] = []
        for s in S:
            inner = [f"coalesce(_best.{c}, 0)" for c in _cols(G, s)]
            outer = [f"(coalesce({c}, 0) - coalesce(_best.{c}, 0))" for c in _cols(G, s)]
            mid_sums[center[0]].append(f"{mass_text(inner)} + {mass_text(outer)}")
        rows = rows.withColumn("center", F.col("_best.mid"))
        keep.append("center")
    order = list(mid_sums)
    raw = [
        _raw_columns(_cols(G, s), s, None, None, False) | {f"mid{j}": mid_sums[lv][s] for j, lv in enumerate(order)}
        for s in S
    ]
    rows = _stack_sources(rows, keep, labels, raw)
    entries = ", ".join(
        f"named_struct('Level', {text_literal(lv)}, 's_mid', mid{j})" for j, lv in enumerate(order)
    )
    return _measures(rows.select("*", F.expr(f"inline(array({entries}))")), [*keep, "Level"], guard_total)


def with_increments(
    decomp: DataFrame, keys: Sequence[str], order: Sequence[str], column: str = "Pb",
    out: str = "seg_explained",
) -> DataFrame:
    """What each level adds over the level before it (0 before the first).

    The window holds one row per level of one (scope, source), so it stays tiny.
    """
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("Level"))
    w = Window.partitionBy(*keys).orderBy(rank)
    # lag's default only fills a missing row, so an undefined share stays undefined.
    return decomp.withColumn(out, F.col(column) - F.lag(column, 1, 0.0).over(w))


def with_residual(
    decomp: DataFrame, residual_level: str, label: str, columns: Sequence[str],
    share: str = "Pb", value: str = "seg_explained",
) -> DataFrame:
    """Append the part below ``residual_level`` (1 - share) as one more level.

    The deepest level makes the stack add up to 1; a shallower one does not, because the
    increments of the levels under it are then counted twice.
    """
    row = F.struct(F.col("Level"), F.col(value).alias(value))
    rest = F.struct(F.lit(label).alias("Level"), (F.lit(1.0) - F.col(share)).alias(value))
    # One pass: the residual row comes out of the row it is computed from.
    rows = F.when(F.col("Level") == residual_level, F.array(row, rest)).otherwise(F.array(row))
    keep = [c for c in columns if c not in ("Level", value)]
    return decomp.withColumn("_r", F.explode(rows)).select(*keep, "_r.Level", f"_r.{value}")


def level_gains(
    decomp: DataFrame, keys: Sequence[str], order: Sequence[str], deepest: str
) -> DataFrame:
    """H added by every level, with the total H as the level below all others."""
    top = order[0]
    row = F.struct(F.col("Level"), F.col("Hb").alias("Hb"))
    total = F.struct(F.lit(deepest).alias("Level"), F.col("H").alias("Hb"))
    rows = F.when(F.col("Level") == top, F.array(row, total)).otherwise(F.array(row))
    stacked = decomp.withColumn("_r", F.explode(rows)).select(*keys, "_r.Level", "_r.Hb")
    return with_increments(stacked, keys, [*order, deepest], "Hb", "H_alone")
