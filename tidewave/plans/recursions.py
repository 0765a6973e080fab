"""DuckDB SQL of recurrences, by recursion over the samples of all series at once: filters, splines, eigenvectors, turns."""

from __future__ import annotations

import numpy as np


def _real(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def both_ways(b: list[float], a: list[float], source: str = "ev", keys: str = "k", tag: str = "") -> str:
    """CTEs that end in `y{tag}` (keys, t, v): the filter b, a forward and backward over each series of `source` (keys, t from 1, v), the ends reflected."""
    n, pad = len(a) - 1, 3 * len(a)
    m = np.eye(n) - np.column_stack([-np.asarray(a[1:]), np.eye(n)[:, :-1]])
    start = np.linalg.solve(m, np.asarray(b[1:]) - np.asarray(a[1:]) * b[0])  # the state that a constant leaves
    states = [f"s{i}" for i in range(n)]

    def step(x: str, before: list[str]) -> list[str]:
        y = f"({_real(b[0])} * {x} + {before[0]})"
        return [f"{y} AS y", *(f"{before[i + 1] if i + 1 < n else '0.0'} + {_real(b[i + 1])} * {x} - {_real(a[i + 1])} * {y} AS {s}" for i, s in enumerate(states))]

    def through(name: str, of: str) -> str:
        first = step("x", [f"{_real(z)} * x" for z in start])
        then = step("e.x", [f"c.{s}" for s in states])
        same = " AND ".join(f"e.{k} = c.{k}" for k in keys.split(", "))
        own = ", ".join(f"e.{k}" for k in keys.split(", "))
        return f"{name} AS (SELECT {keys}, j, {', '.join(first)} FROM {of} WHERE j = 0 UNION ALL SELECT {own}, e.j, {', '.join(then)} FROM {name} c JOIN {of} e ON {same} AND e.j = c.j + 1)"

    return f"""n{tag} AS MATERIALIZED (SELECT {keys}, max(t) AS n, arg_min(v, t) AS v1, arg_max(v, t) AS vn FROM {source} GROUP BY {keys}), w{tag} AS MATERIALIZED (SELECT * FROM {source} JOIN n{tag} USING ({keys}) WHERE n > {pad}),
 e{tag} AS MATERIALIZED (SELECT {keys}, t + {pad - 1} AS j, v AS x FROM w{tag} UNION ALL SELECT {keys}, {pad} - (t - 1), 2 * v1 - v FROM w{tag} WHERE t BETWEEN 2 AND {pad + 1} UNION ALL SELECT {keys}, n + {pad - 1} + n - t, 2 * vn - v FROM w{tag} WHERE t BETWEEN n - {pad} AND n - 1),
 {through(f'f{tag}', f'e{tag}')}, r{tag} AS MATERIALIZED (SELECT {keys}, n + {2 * pad - 1} - j AS j, y AS x FROM f{tag} JOIN n{tag} USING ({keys})), {through(f'g{tag}', f'r{tag}')},
 y{tag} AS MATERIALIZED (SELECT {keys}, n + {pad} - j AS t, y AS v FROM g{tag} JOIN n{tag} USING ({keys}) WHERE j BETWEEN {pad} AND n + {pad - 1} UNION ALL SELECT {keys}, t, NULL FROM {source} JOIN n{tag} USING ({keys}) WHERE n <= {pad})"""


def spline(size: int, source: str, keys: str = "k", tag: str = "") -> str:
    """CTEs that end in `sp{tag}` (keys, i, v): `size` samples of the cubic spline through each series of `source` (keys, j from 0, v), whose outer two pieces on either side are one polynomial."""
    same = lambda x, y: " AND ".join(f"{x}.{k} = {y}.{k}" for k in keys.split(", "))
    own = lambda x: ", ".join(f"{x}.{k}" for k in keys.split(", "))
    w = f"(PARTITION BY {keys} ORDER BY j)"
    return f"""ro{tag} AS MATERIALIZED (SELECT *, lag(v, 2) OVER {w} AS p2, lag(v) OVER {w} AS p1, lead(v) OVER {w} AS q1, lead(v, 2) OVER {w} AS q2, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}),
 eq{tag} AS MATERIALIZED (SELECT {keys}, j, n, v, CASE WHEN n < 4 THEN 0.0 WHEN j = 0 THEN 0.0 WHEN j = n - 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS low, CASE WHEN n < 4 OR j IN (0, n - 1) THEN 1.0 ELSE 4.0 END::DOUBLE AS mid, CASE WHEN n < 4 OR j = n - 1 THEN 0.0 WHEN j = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS up,
  CASE WHEN n = 1 THEN 0 WHEN n = 2 THEN coalesce(q1 - v, v - p1) WHEN n = 3 THEN CASE j WHEN 0 THEN 2 * q1 - 1.5 * v - q2 / 2 WHEN 1 THEN (q1 - p1) / 2 ELSE 1.5 * v - 2 * p1 + p2 / 2 END WHEN j = 0 THEN (5 * (q1 - v) + q2 - q1) / 2 WHEN j = n - 1 THEN (p1 - p2 + 5 * (v - p1)) / 2 ELSE 3 * (q1 - p1) END AS b FROM ro{tag}),
 dw{tag} AS (SELECT {keys}, j, mid, up, b FROM eq{tag} WHERE j = 0 UNION ALL SELECT {own('e')}, e.j, e.mid - e.low / d.mid * d.up, e.up, e.b - e.low / d.mid * d.b FROM dw{tag} d JOIN eq{tag} e ON {same('e', 'd')} AND e.j = d.j + 1),
 re{tag} AS MATERIALIZED (SELECT {own('d')}, e.n - 1 - d.j AS h, d.mid, d.up, d.b FROM dw{tag} d JOIN eq{tag} e ON {same('e', 'd')} AND e.j = d.j),
 ba{tag} AS (SELECT {keys}, h, b / mid AS s FROM re{tag} WHERE h = 0 UNION ALL SELECT {own('r')}, r.h, (r.b - r.up * z.s) / r.mid FROM ba{tag} z JOIN re{tag} r ON {same('r', 'z')} AND r.h = z.h + 1),
 kn{tag} AS MATERIALIZED (SELECT {own('r')}, r.j, r.n, r.v, coalesce(r.q1, r.v) AS q1, z.s, coalesce(lead(z.s) OVER (PARTITION BY {own('r')} ORDER BY r.j), z.s) AS s1 FROM ro{tag} r JOIN ba{tag} z ON {same('r', 'z')} AND r.n - 1 - r.j = z.h),
 kx{tag} AS (SELECT {keys}, i, i * (n - 1) / {float(max(size - 1, 1))}::DOUBLE AS x, n FROM (SELECT DISTINCT {keys}, n FROM kn{tag}), range({size}) g(i)),
 sp{tag} AS MATERIALIZED (SELECT {own('a')}, a.i, q.v * (1 + 2 * u) * (1 - u) * (1 - u) + q1 * u * u * (3 - 2 * u) + u * (1 - u) * (s * (1 - u) - s1 * u) AS v FROM (SELECT *, greatest(least(floor(x), n - 2), 0) AS c, x - greatest(least(floor(x), n - 2), 0) AS u FROM kx{tag}) a JOIN kn{tag} q ON {same('a', 'q')} AND q.j = a.c)"""


_PAIRS = ("rr", "gg", "bb", "rg", "rb", "gb")
_SQUARE = {"rr": "rr * rr + rg * rg + rb * rb", "gg": "rg * rg + gg * gg + gb * gb", "bb": "rb * rb + gb * gb + bb * bb", "rg": "rr * rg + rg * gg + rb * gb", "rb": "rr * rb + rg * gb + rb * bb", "gb": "rg * rb + gg * gb + gb * bb"}


def strongest(source: str, key: str = "k", tag: str = "", squarings: int = 26) -> str:
    """CTEs that end in `ei{tag}` (key, er, eg, eb, its value lam): the strongest eigenvector of each row's symmetric matrix (rr, gg, bb, rg, rb, gb), its green part positive, by squaring the matrix over and over."""
    ctes = [f"m{tag}0 AS (SELECT {key}, {', '.join(f'{p} / (rr + gg + bb) AS {p}' for p in _PAIRS)} FROM {source})"]
    trace = " + ".join(f"{w}{p} * {p}" for p, w in zip(_PAIRS, ["", "", "", "2 * ", "2 * ", "2 * "], strict=True))
    for i in range(squarings):
        ctes.append(f"m{tag}{i + 1} AS (SELECT {key}, {', '.join(f'({_SQUARE[p]}) / ({trace}) AS {p}' for p in _PAIRS)} FROM m{tag}{i})")
    ctes.append(f"c{tag} AS (SELECT {key}, CASE WHEN rr >= gg AND rr >= bb THEN [rr, rg, rb] WHEN gg >= bb THEN [rg, gg, gb] ELSE [rb, gb, bb] END AS e FROM m{tag}{squarings})")
    ctes.append(f"u{tag} AS (SELECT {key}, e, sqrt(e[1] * e[1] + e[2] * e[2] + e[3] * e[3]) * CASE WHEN e[2] < 0 THEN -1 ELSE 1 END AS l FROM c{tag})")
    ctes.append(f"d{tag} AS (SELECT {key}, e[1] / l AS er, e[2] / l AS eg, e[3] / l AS eb FROM u{tag})")
    ctes.append(f"ei{tag} AS MATERIALIZED (SELECT {key}, er, eg, eb, er * er * rr + eg * eg * gg + eb * eb * bb + 2 * (er * eg * rg + er * eb * rb + eg * eb * gb) AS lam FROM d{tag} JOIN {source} USING ({key}))")
    return ", ".join(ctes)


def without_strongest(source: str, found: str, key: str = "k") -> str:
    """The matrices without that eigenvector's part."""
    parts = {"rr": "er * er", "gg": "eg * eg", "bb": "eb * eb", "rg": "er * eg", "rb": "er * eb", "gb": "eg * eb"}
    return f"SELECT {key}, {', '.join(f'{p} - lam * {x} AS {p}' for p, x in parts.items())} FROM {source} JOIN {found} USING ({key})"


def detrended(rate: float, source: str, tag: str = "", keys: str = "k") -> str:
    """CTEs that end in `dt{tag}` (keys, t, v): smoothness priors with lambda 12 * rate on each series of `source` (keys, t from 1, v), the end repeated for two seconds."""
    w, more = _real((12 * rate) ** 2), int(2 * rate)
    first, second, ends = "CAST(i <= m - 3 AS INT)", "CAST(i BETWEEN 1 AND m - 2 AS INT)", "CAST(i >= 2 AS INT)"
    return f"""dn{tag} AS (SELECT {keys}, max(t) AS n, least(max(t), {more}) AS more FROM {source} GROUP BY {keys}),
 dp{tag} AS (SELECT {keys}, t - 1 AS i, n + more AS m, n, v AS p FROM {source} JOIN dn{tag} USING ({keys}) UNION ALL SELECT {keys}, t - 1 + more, n + more, n, v FROM {source} JOIN dn{tag} USING ({keys}) WHERE t > n - more),
 dq{tag} AS MATERIALIZED (SELECT {keys}, i, m, n, p, 1 + {w} * ({first} + 4 * {second} + {ends}) AS main, -2 * {w} * ({first} + {second}) AS one, {w} * {first} AS two FROM dp{tag}),
 df{tag} AS (SELECT {keys}, i, main AS d, one / main AS a, two / main AS b, p AS z, 0.0::DOUBLE AS d1, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS z1 FROM dq{tag} WHERE i = 0
  UNION ALL SELECT {keys}, i, d, (one - a0 * d0 * b0) / d, two / d, z, d0, b0, z0 FROM (SELECT {', '.join(f'q.{k}' for k in keys.split(', '))}, q.i, one, two, f.a AS a0, f.b AS b0, f.d AS d0, f.z AS z0, main - f.a * f.a * f.d - f.b1 * f.b1 * f.d1 AS d, p - f.a * f.z - f.b1 * f.z1 AS z FROM df{tag} f JOIN dq{tag} q ON {' AND '.join(f'q.{k} = f.{k}' for k in keys.split(', '))} AND q.i = f.i + 1)),
 dh{tag} AS MATERIALIZED (SELECT {keys}, m - 1 - f.i AS j, z / d AS z, a, b FROM df{tag} f JOIN (SELECT DISTINCT {keys}, m FROM dq{tag}) USING ({keys})),
 dg{tag} AS (SELECT {keys}, j, z AS y, 0.0::DOUBLE AS y1 FROM dh{tag} WHERE j = 0 UNION ALL SELECT {', '.join(f'h.{k}' for k in keys.split(', '))}, h.j, h.z - h.a * g.y - h.b * g.y1, g.y FROM dg{tag} g JOIN dh{tag} h ON {' AND '.join(f'h.{k} = g.{k}' for k in keys.split(', '))} AND h.j = g.j + 1),
 dt{tag} AS MATERIALIZED (SELECT {', '.join(f'q.{k}' for k in keys.split(', '))}, i + 1 AS t, p - y AS v FROM dq{tag} q JOIN dg{tag} g ON {' AND '.join(f'g.{k} = q.{k}' for k in keys.split(', '))} AND g.j = m - 1 - i WHERE i < n)"""


def unrounded(sql: str) -> str:
    """A query of values rounded to six decimals without the rounding, as the source of another."""
    return sql.replace("round(", "(").replace(", 6) + 0.0", ")")


def spline_through(knots: str, grid: str, keys: str = "k", tag: str = "") -> str:
    """CTEs that end in `sq{tag}` (keys, i, v): the cubic splines through `knots` (keys, j from 0, x rising, v) at the places of `grid` (keys, i, x), beyond the ends by the outer pieces."""
    same = lambda x, y: " AND ".join(f"{x}.{k} = {y}.{k}" for k in keys.split(", "))
    own = lambda x: ", ".join(f"{x}.{k}" for k in keys.split(", "))
    w = f"(PARTITION BY {keys} ORDER BY j)"
    return f"""ka{tag} AS (SELECT *, lead(x) OVER {w} - x AS h, (lead(v) OVER {w} - v) / (lead(x) OVER {w} - x) AS d, count(*) OVER (PARTITION BY {keys}) AS n FROM {knots}),
 kb{tag} AS MATERIALIZED (SELECT *, lag(h) OVER {w} AS hp, lag(h, 2) OVER {w} AS hpp, lag(d) OVER {w} AS dp, lag(d, 2) OVER {w} AS dpp, lead(h) OVER {w} AS hn, lead(d) OVER {w} AS dn FROM ka{tag}),
 kc{tag} AS MATERIALIZED (SELECT {keys}, j, n, CASE WHEN n < 4 OR j = 0 THEN 0.0 WHEN j = n - 1 THEN hp + hpp ELSE h END::DOUBLE AS low, CASE WHEN n < 4 THEN 1.0 WHEN j = 0 THEN hn WHEN j = n - 1 THEN hpp ELSE 2 * (hp + h) END::DOUBLE AS mid, CASE WHEN n < 4 OR j = n - 1 THEN 0.0 WHEN j = 0 THEN h + hn ELSE hp END::DOUBLE AS up,
  CASE WHEN n = 1 THEN 0 WHEN n = 2 THEN coalesce(d, dp) WHEN n = 3 THEN CASE j WHEN 0 THEN d - (dn - d) / (h + hn) * h WHEN 1 THEN dp + (d - dp) / (hp + h) * hp ELSE dp + (dp - dpp) / (hp + hpp) * hp END
   WHEN j = 0 THEN ((h + 2 * (h + hn)) * hn * d + h * h * dn) / (h + hn) WHEN j = n - 1 THEN (hp * hp * dpp + (2 * (hp + hpp) + hp) * hpp * dp) / (hp + hpp) ELSE 3 * (h * dp + hp * d) END AS b FROM kb{tag}),
 kd{tag} AS (SELECT {keys}, j, mid, up, b FROM kc{tag} WHERE j = 0 UNION ALL SELECT {own('e')}, e.j, e.mid - e.low / d.mid * d.up, e.up, e.b - e.low / d.mid * d.b FROM kd{tag} d JOIN kc{tag} e ON {same('e', 'd')} AND e.j = d.j + 1),
 ke{tag} AS MATERIALIZED (SELECT {own('d')}, e.n - 1 - d.j AS r, d.mid, d.up, d.b FROM kd{tag} d JOIN kc{tag} e ON {same('e', 'd')} AND e.j = d.j),
 kf{tag} AS (SELECT {keys}, r, b / mid AS s FROM ke{tag} WHERE r = 0 UNION ALL SELECT {own('q')}, q.r, (q.b - q.up * z.s) / q.mid FROM kf{tag} z JOIN ke{tag} q ON {same('q', 'z')} AND q.r = z.r + 1),
 kg{tag} AS MATERIALIZED (SELECT {own('a')}, a.j, a.n, a.x, a.v, a.h, lead(a.v) OVER (PARTITION BY {own('a')} ORDER BY a.j) AS v1, z.s, lead(z.s) OVER (PARTITION BY {own('a')} ORDER BY a.j) AS s1, CASE WHEN a.j = 0 THEN -1e300 ELSE a.x END AS lo, CASE WHEN a.j >= a.n - 2 THEN 1e300 ELSE a.x + a.h END AS hi FROM ka{tag} a JOIN kf{tag} z ON {same('a', 'z')} AND a.n - 1 - a.j = z.r),
 sq{tag} AS MATERIALIZED (SELECT {own('g')}, g.i, CASE WHEN c.n = 1 THEN c.v ELSE c.v * (1 + 2 * u) * (1 - u) * (1 - u) + c.v1 * u * u * (3 - 2 * u) + c.h * u * (1 - u) * (c.s * (1 - u) - c.s1 * u) END AS v
  FROM (SELECT g.*, c.j AS cell, (g.x - c.x) / c.h AS u FROM {grid} g JOIN kg{tag} c ON {same('g', 'c')} AND g.x >= c.lo AND g.x < c.hi AND (c.j < c.n - 1 OR c.n = 1)) g JOIN kg{tag} c ON {same('g', 'c')} AND c.j = g.cell)"""
