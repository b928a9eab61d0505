"""SQL for DuckDB with the cuts of the partitioners: the searches as recursive tables, and each alternation written out as often as it may run.

A matrix is a table (i, j, w); cuts are a table (k, spot). After cuts have settled, further turns give them again, so that writing out all turns gives what a search gives that stops.
"""

from __future__ import annotations


def _reach(spot: str, bound: str) -> str:
    """The farthest position so that no array gains more than a bound."""
    return f"list_min(list_transform(ps, lambda pre: len(list_filter(pre, lambda y: y <= pre[{spot} + 1] + {bound})) - 1))"


def optimal(name: str, sums: str, n: str, parts: int) -> str:
    """Optimal cuts of the arrays in sums (q, pos, load), positions 0..n-1 (a column of `size`)."""
    return f"""{name}_x AS MATERIALIZED (SELECT list(pre) ps, max(pre[len(pre)]) t, max(len(pre)) - 1 n FROM (SELECT q, list_prepend(0::BIGINT, list(CAST(s AS BIGINT) ORDER BY pos)) pre FROM (
 SELECT q, pos, sum(w) OVER (PARTITION BY q ORDER BY pos) s FROM (SELECT a.q, r pos, coalesce(sum(b.load), 0) w FROM (SELECT DISTINCT q FROM {sums}) a CROSS JOIN (SELECT unnest(range({n})) r FROM size) LEFT JOIN {sums} b ON b.q = a.q AND b.pos = r GROUP BY 1, 2)) GROUP BY q)),
{name}_b(lo, hi, k, pos) AS (SELECT 0::BIGINT, CAST(t AS BIGINT), 0, 0::BIGINT FROM {name}_x UNION ALL
 SELECT CASE WHEN k < {parts} OR pos >= n THEN lo ELSE (lo + hi) // 2 + 1 END, CASE WHEN k < {parts} OR pos < n THEN hi ELSE (lo + hi) // 2 END, CASE WHEN k < {parts} THEN k + 1 ELSE 0 END,
  CASE WHEN k < {parts} THEN {_reach('pos', '(lo + hi) // 2')} ELSE 0 END FROM {name}_b, {name}_x WHERE lo < hi),
{name}_l AS MATERIALIZED (SELECT min(hi) l FROM {name}_b),
{name}_r(k, spot) AS (SELECT 0, 0::BIGINT UNION ALL SELECT k + 1, {_reach('spot', 'l')} FROM {name}_r, {name}_x, {name}_l WHERE k < {parts}),
{name} AS MATERIALIZED (SELECT k, spot FROM {name}_r)"""


def _stripes(name: str, matrix: str, across: str, axis: str, cuts: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT a.k q, x.{axis} pos, CAST(sum(x.w) AS BIGINT) load FROM {matrix} x JOIN {cuts} a ON x.{across} >= a.spot JOIN {cuts} b ON b.k = a.k + 1 AND x.{across} < b.spot GROUP BY 1, 2)"


def _row_max(name: str, stripes: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT 0 q, pos, max(load) load FROM {stripes} GROUP BY pos)"


def _load(matrix: str, cuts: str) -> str:
    """The heaviest tile of symmetric cuts."""
    return f"(SELECT max(load) FROM (SELECT sum(x.w) load FROM {matrix} x JOIN {cuts} a ON x.i >= a.spot JOIN {cuts} b ON b.k = a.k + 1 AND x.i < b.spot JOIN {cuts} c ON x.j >= c.spot JOIN {cuts} d ON d.k = c.k + 1 AND x.j < d.spot GROUP BY a.k, c.k))"


def rows(row: str, col: str | None = None) -> str:
    """(dim, k, lo, hi) of cuts."""
    each = [f"SELECT '{d}' dim, CAST(a.k AS INTEGER) k, a.spot lo, b.spot hi FROM {c} a JOIN {c} b ON b.k = a.k + 1" for d, c in (("row", row), ("col", col)) if c]
    return " UNION ALL ".join(each)


def nic(head: str, counts: str, n: str, m: str, parts: int) -> str:
    """head: CTEs of matrix x and size; counts: (q, pos, load), the stored nonzeros of each row."""
    ctes, cuts = [f"c0 AS MATERIALIZED ({counts})", optimal("t0", "c0", n, parts)], {"i": "t0", "j": "t0"}
    turns = max(10, 2 * parts)
    for t in range(1, turns + 1):
        axis, other = ("j", "i") if t % 2 else ("i", "j")
        ctes += [_stripes(f"s{t}", "x", other, axis, cuts[other]), optimal(f"t{t}", f"s{t}", m if axis == "j" else n, parts)]
        cuts[axis] = f"t{t}"
    # columns that come out like the first rows end the search at once
    same = "(SELECT list(spot ORDER BY k) FROM t0) = (SELECT list(spot ORDER BY k) FROM t1)"
    ctes += [f"p AS MATERIALIZED (SELECT * FROM t0 WHERE {same} UNION ALL SELECT * FROM {cuts['i']} WHERE NOT {same})", f"q AS MATERIALIZED (SELECT * FROM t1 WHERE {same} UNION ALL SELECT * FROM {cuts['j']} WHERE NOT {same})"]
    return f"WITH RECURSIVE {head}, " + ",\n".join(ctes) + " " + rows("p", "q")


def _first(parts: int) -> list[str]:
    ctes = []
    for axis in "ij":
        ctes += [f"f_{axis} AS MATERIALIZED (SELECT 0 q, {axis} pos, CAST(sum(w) AS BIGINT) load FROM x GROUP BY {axis})", optimal(f"t_{axis}", f"f_{axis}", "n", parts)]
    return [*ctes, f"first_load AS MATERIALIZED (SELECT {_load('x', 't_i')} i, {_load('x', 't_j')} j)"]


def rac(head: str, parts: int, full: bool = False) -> str:
    """full: positions weighed by all their loads at once."""
    ctes = _first(parts)
    ctes += ["ax AS MATERIALIZED (SELECT i <= j by_row FROM first_load)", "o AS MATERIALIZED (SELECT CASE WHEN by_row THEN i ELSE j END a, CASE WHEN by_row THEN j ELSE i END b, w FROM x, ax)",
             "t1 AS MATERIALIZED (SELECT k, spot FROM t_i, ax WHERE by_row UNION ALL SELECT k, spot FROM t_j, ax WHERE NOT by_row)"]
    turns = max(10, parts)
    for t in range(2, turns + 1):
        ctes += [_stripes(f"s{t}", "o", "b", "a", f"t{t - 1}")] + ([] if full else [_row_max(f"m{t}", f"s{t}")]) + [optimal(f"t{t}", f"s{t}" if full else f"m{t}", "n", parts)]
    return f"WITH RECURSIVE {head}, " + ",\n".join(ctes) + " " + rows(f"t{turns}")


def rac_under(head: str, z: str, most: int) -> str:
    """rac's cuts with the fewest parts whose heaviest tile is at most z (an expression over x), tried up to `most` parts."""
    each = [f"r{k} AS MATERIALIZED ({rac('none AS (SELECT 1)', k)}), c{k} AS MATERIALIZED (SELECT k, lo spot FROM r{k} UNION ALL SELECT max(k) + 1, max(hi) FROM r{k})" for k in range(1, most + 1)]
    loads = " UNION ALL ".join(f"SELECT {k} parts, {_load('x', f'c{k}')} load" for k in range(1, most + 1))
    tried = " UNION ALL ".join(f"SELECT {k} parts, * FROM r{k}" for k in range(1, most + 1))
    return f"WITH RECURSIVE {head}, {', '.join(each)}, fewest AS (SELECT min(parts) parts FROM ({loads}) WHERE load <= (SELECT {z} FROM x)) SELECT dim, k, lo, hi FROM ({tried}) JOIN fewest USING (parts)"


def pbi(head: str, parts: int) -> str:
    ctes, turns = _first(parts), max(10, parts)
    pick = "CASE WHEN rows_first THEN (CASE WHEN li < lj THEN 'i' ELSE 'j' END) ELSE (CASE WHEN lj < li THEN 'j' ELSE 'i' END) END"
    for t in range(turns):
        names = {axis: f"t_{axis}" if t == 0 else f"u{t}_{axis}" for axis in "ij"}
        if t:
            for axis, other in ("ij", "ji"):
                ctes += [_stripes(f"s{t}_{axis}", "x", other, axis, f"c{t - 1}"), _row_max(f"m{t}_{axis}", f"s{t}_{axis}"), optimal(names[axis], f"m{t}_{axis}", "n", parts)]
        ctes += [f"l{t} AS MATERIALIZED (SELECT {_load('x', names['i'])} li, {_load('x', names['j'])} lj, i <= j rows_first FROM first_load)", f"p{t} AS MATERIALIZED (SELECT {pick} axis, CASE WHEN {pick} = 'i' THEN li ELSE lj END load FROM l{t})",
                 f"c{t} AS MATERIALIZED (SELECT k, spot FROM {names['i']}, p{t} WHERE axis = 'i' UNION ALL SELECT k, spot FROM {names['j']}, p{t} WHERE axis = 'j')"]
    every = " UNION ALL ".join(f"SELECT {t} t, load, k, spot FROM c{t}, p{t}" for t in range(turns))
    ctes += [f"every AS MATERIALIZED ({every})", "best AS MATERIALIZED (SELECT k, spot FROM every WHERE t = (SELECT t FROM every ORDER BY load, t LIMIT 1))"]
    return f"WITH RECURSIVE {head}, " + ",\n".join(ctes) + " " + rows("best")


_STEP = """coalesce((SELECT min(k) FROM (SELECT k, sum(w) OVER (PARTITION BY s ORDER BY k) t FROM (
  SELECT k, CASE WHEN m >= spot THEN -1 ELSE 2 * len(list_filter(cs, lambda c: c <= m)) + up::INT END s, sum(w) w FROM f WHERE k >= spot GROUP BY 1, 2)) WHERE t > {bound}), (SELECT n FROM size))"""


def pal(head: str, parts: int, bounded: bool) -> str:
    """Where the search from the usual upper bound succeeds."""
    full, done = f"list_resize(cs, {parts + 1}, spot)", f"len(cs) = {parts + 1} OR (len(cs) > 1 AND cs[len(cs)] = cs[len(cs) - 1])"
    return f"""WITH RECURSIVE {head}, f AS MATERIALIZED (SELECT greatest(i, j) k, least(i, j) m, i < j up, sum(w) w FROM x GROUP BY 1, 2, 3), total AS MATERIALIZED (SELECT CAST(sum(w) AS BIGINT) t FROM x),
bis(lo, hi, lim, cs) AS (SELECT (t + {parts**2 - 1}) // {parts**2}, least(t, (t + {parts - 1}) // {parts} + n), list_transform(range({parts + 1}), lambda k: n), [0::BIGINT] FROM total, size UNION ALL
 SELECT CASE WHEN done AND spot < n THEN mid + 1 ELSE lo END, CASE WHEN done AND spot >= n THEN mid ELSE hi END, {f'CASE WHEN done AND spot >= n THEN {full} ELSE lim END' if bounded else 'lim'},
  CASE WHEN done THEN [0::BIGINT] ELSE list_append(cs, greatest(spot, least(e, lim[len(cs) + 1]))) END
 FROM (SELECT *, {_STEP.format(bound='mid')} e FROM (SELECT *, (lo + hi) // 2 mid, cs[len(cs)] spot, {done} done FROM bis, size WHERE lo < hi))),
found AS MATERIALIZED (SELECT hi, lim FROM bis WHERE lo >= hi),
cut(cs, spot) AS (SELECT [0::BIGINT], 0::BIGINT UNION ALL
 SELECT list_append(cs, e), e FROM (SELECT cs, greatest(spot, least(e, lim[len(cs) + 1])) e FROM (SELECT cs, spot, lim, {_STEP.format(bound='hi')} e FROM cut, found WHERE len(cs) <= {parts}))),
cuts AS MATERIALIZED (SELECT CAST(len(cs) - 1 AS INTEGER) k, spot FROM cut) {rows('cuts')}"""


def exact(head: str) -> str:
    """Three symmetric parts, by trying all."""
    return f"""WITH {head}, c AS (SELECT a, b FROM (SELECT unnest(range(n + 1)) a FROM size) x, (SELECT unnest(range(n + 1)) b FROM size) y WHERE a <= b),
loads AS (SELECT a, b, (a <= i)::INT + (b <= i)::INT u, (a <= j)::INT + (b <= j)::INT v, sum(w) load FROM c, x GROUP BY 1, 2, 3, 4),
best AS (SELECT a, b, max(load) load FROM loads GROUP BY 1, 2 ORDER BY load, a, b LIMIT 1),
cuts AS (SELECT 0 k, 0::BIGINT spot UNION ALL SELECT 1, a FROM best UNION ALL SELECT 2, b FROM best UNION ALL SELECT 3, n FROM size) {rows('cuts', 'cuts')}"""
