"""SQL for least squares and autoregressions, used only to check the Spark results."""

from __future__ import annotations

from tidemark.plans.describe import report_sql
from tidemark.plans.rounding import r


def eliminate_ctes(name: str, k: int) -> str:
    """CTEs that eliminate the k normal equations (a0_0.., b0..) of ``<name>_0``; result ``<name>`` has c0.. instead."""
    text = ""
    for m in range(k):
        cells = []
        for i in range(k):
            for j in range(m + 1, k):
                pivot = f"a{m}_{j} / a{m}_{m}"
                cells.append((pivot if i == m else f"a{i}_{j} - a{i}_{m} * ({pivot})") + f" AS a{i}_{j}")
            pivot = f"b{m} / a{m}_{m}"
            cells.append((pivot if i == m else f"b{i} - a{i}_{m} * ({pivot})") + f" AS b{i}")
        dropped = ", ".join([f"a{i}_{j}" for i in range(k) for j in range(m, k)] + [f"b{i}" for i in range(k)])
        text += f",\n{name}_{m + 1} AS (SELECT * EXCLUDE ({dropped}), {', '.join(cells)} FROM {name}_{m})"
    if not k:
        return f",\n{name} AS (SELECT * FROM {name}_0)"
    names = ", ".join(f"b{i} AS c{i}" for i in range(k))
    gone = ", ".join(f"b{i}" for i in range(k))
    return text + f",\n{name} AS (SELECT * EXCLUDE ({gone}), {names} FROM {name}_{k})"


def solve_ctes(name: str, source: str, keys: list[str], xs: list[str], y: str, carried: str = "") -> str:
    """CTEs that build normal equations from ``source`` and eliminate them; result ``<name>`` has c0.."""
    k = len(xs)
    cols = [f"sum(({xs[i]}) * ({xs[j]})) AS a{i}_{j}" for i in range(k) for j in range(k)]
    cols += [f"sum(({xs[i]}) * ({y})) AS b{i}" for i in range(k)]
    by = ", ".join(keys)
    text = f",\n{name}_0 AS (SELECT {by}, count(*) AS nobs{carried}, {', '.join(cols)} FROM {source} GROUP BY {by})"
    return text + eliminate_ctes(name, k)


HOLDOUT = [("test", "trunc(n * 0.8::DOUBLE)", "n")]
PHASES = [
    ("validation", "trunc(n * 0.6::DOUBLE)", "trunc(n * 0.6::DOUBLE) + trunc(n * 0.2::DOUBLE)"),
    ("test", "trunc(n * 0.6::DOUBLE) + trunc(n * 0.2::DOUBLE)", "n"),
]


def phases_cte(source: str, phases, name: str = "spans") -> str:
    parts = [
        f"SELECT *, '{phase}' AS phase, ({a})::BIGINT AS fit_end, ({b})::BIGINT AS score_end FROM {source}"
        for phase, a, b in phases
    ]
    return f",\n{name} AS ({' UNION ALL '.join(parts)})"


BOUND = 0.995


def long_sql(rows: str, most_ma: int) -> str:
    """Lags of the long autoregression: the furthest moving-average lag or ln(rows)^1.5, at most a quarter of the rows."""
    return f"greatest(1, least(({rows}) // 4, greatest({most_ma}, floor(ln(greatest({rows}, 1)) ** 1.5))))::BIGINT"


def start_sql(order) -> str:
    """Last position that an order cannot use, from ``fit_end``."""
    lost, far_ar, far_ma = order.d + order.s * order.D, order.p + order.s * order.P, order.q + order.s * order.Q
    if not far_ma:
        return f"{lost + far_ar}::BIGINT"
    return f"({lost} + greatest({far_ar}, {far_ma} + {long_sql(f'fit_end - {lost}', far_ma)}))"


def _shock_ctes(name: str, lost: int, most_ma: int, const: bool, upto: int) -> str:
    """Residuals ``e`` of a long autoregression by the Durbin-Levinson recursion on the autocovariances."""
    w = "PARTITION BY entity, phase ORDER BY rn"
    return f""",
{name}_dev AS MATERIALIZED (SELECT entity, phase, rn, fit_end, {long_sql(f'fit_end - {lost}', most_ma)} AS m,
  w0 - {f'avg(w0) FILTER (rn <= fit_end) OVER (PARTITION BY entity, phase)' if const else '0'} AS x FROM {name}_base WHERE rn > {lost}),
{name}_acov AS (SELECT entity, phase, any_value(m) AS m, list(r ORDER BY k) AS r FROM (
  SELECT a.entity, a.phase, k, any_value(a.m) AS m, sum(a.x * b.x) / any_value(a.fit_end - {lost}) AS r
  FROM {name}_dev a, range(0, {upto + 1}) t(k), {name}_dev b
  WHERE a.entity = b.entity AND a.phase = b.phase AND b.rn = a.rn - k AND k <= a.m AND a.rn <= a.fit_end GROUP BY a.entity, a.phase, k)
  GROUP BY entity, phase),
{name}_long AS (
  WITH RECURSIVE step(entity, phase, m, r, k, a, v) AS (
    SELECT entity, phase, m, r, 0::BIGINT, []::DOUBLE[], r[1] FROM {name}_acov
    UNION ALL
    SELECT entity, phase, m, r, k + 1, CASE WHEN k = 0 THEN [g] ELSE list_append(list_transform(range(1, k + 1), lambda j: a[j] - g * a[k + 1 - j]), g) END,
      v * (1 - g * g)
    FROM (SELECT *, (r[k + 2] - CASE WHEN k = 0 THEN 0 ELSE list_inner_product(a, list_reverse(r[2:k + 1])) END) / v AS g FROM step WHERE k < m))
  SELECT entity, phase, m, a FROM step WHERE k = m),
{name}_shocked AS (SELECT entity, phase, rn, CASE WHEN rn > {lost} + m THEN
    x - list_inner_product(a, list_transform(range(1, m + 1), lambda j: before[len(before) + 1 - j])) END AS e
  FROM (SELECT *, list(x) OVER ({w} ROWS BETWEEN {upto} PRECEDING AND 1 PRECEDING) AS before FROM {name}_dev)
  JOIN {name}_long USING (entity, phase, m))"""


def _clamp_ctes(name: str, source: str, coefficients: list[str], flag: str, out: str) -> str:
    """Coefficients 1..p of an autoregression whose partial autocorrelations are held within BOUND, where one leaves it.

    Adds ``<out>1..`` (as given where all are inside) and sets ``flag`` to 1 where one is not; rows with the flag keep theirs.
    """
    p = len(coefficients)
    text = f",\n{name}_d{p} AS (SELECT *, {', '.join(f'{c} AS t{p}_{i + 1}' for i, c in enumerate(coefficients))} FROM {source})"
    for k in range(p, 0, -1):
        cells = [f"greatest(least(t{k}_{k}, {BOUND}::DOUBLE), -{BOUND}::DOUBLE) AS r{k}"]
        text += f",\n{name}_h{k} AS (SELECT *, {', '.join(cells)} FROM {name}_d{k})"
        down = [f"(t{k}_{i} + r{k} * t{k}_{k - i}) / (1 - r{k} * r{k}) AS t{k - 1}_{i}" for i in range(1, k)]
        text += f",\n{name}_d{k - 1} AS (SELECT *{''.join(', ' + d for d in down)} FROM {name}_h{k})"
    previous = f"{name}_d0"
    for k in range(1, p + 1):
        up = [f"u{k - 1}_{i} - r{k} * u{k - 1}_{k - i} AS u{k}_{i}" for i in range(1, k)] + [f"r{k} AS u{k}_{k}"]
        text += f",\n{name}_u{k} AS (SELECT *, {', '.join(up)} FROM {previous})"
        previous = f"{name}_u{k}"
    within = " AND ".join(f"abs(t{k}_{k}) < {BOUND}::DOUBLE" for k in range(1, p + 1))
    scratch = [f"t{k}_{i}" for k in range(1, p + 1) for i in range(1, k + 1)] + [f"r{k}" for k in range(1, p + 1)]
    scratch += [f"u{k}_{i}" for k in range(1, p + 1) for i in range(1, k + 1)]
    values = ", ".join(f"CASE WHEN {flag} = 1 OR ({within}) THEN {c} ELSE u{p}_{i + 1} END AS {out}{i + 1}" for i, c in enumerate(coefficients))
    return text + (f",\n{name} AS MATERIALIZED (SELECT * EXCLUDE ({flag}, {', '.join(scratch)}), {values}, "
                   f"CASE WHEN {flag} = 1 OR NOT ({within}) THEN 1 ELSE 0 END AS {flag} FROM {previous})")


def _region_ctes(name: str, k: int, at: int, p: int, q: int) -> str:
    """Least squares inside the stationary and invertible region, from the sums of ``<name>_sums``.

    All are fitted; a factor outside goes to the edge and stays, and the others are fitted again (twice at most).
    """
    sums = ", ".join([f"a{i}_{j}" for i in range(k) for j in range(k)] + [f"b{i}" for i in range(k)])
    text = f",\n{name}_t0 AS (SELECT *, 0 AS fp, 0 AS fq{''.join(f', 0::DOUBLE AS v{i}' for i in range(k))} FROM {name}_sums)"
    for turn in range(1 + (p > 0) + (q > 0)):
        # A held coefficient has the equation 1 * x = 0; what it explains leaves the right side of the others.
        held = {i: "fp" if i < at + p else "fq" for i in range(at, k)}

        def free(i):
            return f"(1 - {held[i]})" if i in held else "1"

        cells = [f"a{i}_{j} * {free(i)} * {free(j)}" + (f" + {held[i]}" if i == j and i in held else "") + f" AS a{i}_{j}"
                 for i in range(k) for j in range(k)]
        fixed = [f"(b{i}{''.join(f' - a{i}_{j} * {held[j]} * v{j}' for j in held)}) * {free(i)} AS b{i}" for i in range(k)]
        keep = ", ".join(["entity", "phase", "fp", "fq", *[f"v{i}" for i in range(k)]])
        text += f",\n{name}_s{turn}_0 AS (SELECT {keep}, {', '.join(cells + fixed)} FROM {name}_t{turn})"
        text += eliminate_ctes(f"{name}_s{turn}", k)
        now = ", ".join(f"CASE WHEN {held[i]} = 1 THEN v{i} ELSE c{i} END AS n{i}" if i in held else f"c{i} AS n{i}" for i in range(k))
        gone = ", ".join([f"v{i}" for i in range(k)] + [f"c{i}" for i in range(k)])
        last = f"{name}_n{turn}"
        text += f",\n{last} AS MATERIALIZED (SELECT * EXCLUDE ({gone}), {now} FROM {name}_s{turn})"
        if p:
            text += _clamp_ctes(f"{name}_p{turn}", last, [f"n{at + i}" for i in range(p)], "fp", "x")
            last = f"{name}_p{turn}"
        if q:
            text += _clamp_ctes(f"{name}_q{turn}", last, [f"(-n{at + p + i})" for i in range(q)], "fq", "y")
            last = f"{name}_q{turn}"
        new = [f"n{i} AS v{i}" for i in range(at)] + [f"x{i + 1} AS v{at + i}" for i in range(p)] + [f"-y{i + 1} AS v{at + p + i}" for i in range(q)]
        text += f""",
{name}_t{turn + 1} AS MATERIALIZED (SELECT entity, phase, fp, fq, {', '.join(new)}, {sums} FROM {last} JOIN {name}_sums USING (entity, phase))"""
    turn = (p > 0) + (q > 0)
    # The last turn had nothing left to hold but what it took over.
    return text + f",\n{name}_params AS (SELECT entity, phase, {', '.join(f'v{i} AS c{i}' for i in range(k))} FROM {name}_t{turn + 1})"


def _product_ctes(name: str, order, xs: list[str], s: int) -> str:
    """A product of plain and seasonal factors of order 1: each pair is fitted given the other, over and over.

    ``<name>_sums`` has the products g_<x>_<y> of the columns.
    """
    def product(left: dict, right: dict) -> str:
        return " + ".join(f"({p}) * ({q}) * {'g_' + '_'.join(sorted((a, b)))}" for a, p in left.items() for b, q in right.items())

    def pair(y, sides):
        """Least squares on one or two columns."""
        if len(sides) == 1:
            (name_, x), = sides
            return {name_: f"({product(x, y)}) / ({product(x, x)})"}
        (n1, x1), (n2, x2) = sides
        a, b, c, d, e = product(x1, x1), product(x1, x2), product(x2, x2), product(x1, y), product(x2, y)
        below = f"(({a}) * ({c}) - ({b}) ** 2)"
        return {n1: f"(({d}) * ({c}) - ({e}) * ({b})) / {below}", n2: f"(({e}) * ({a}) - ({d}) * ({b})) / {below}"}

    has = {"p": order.p, "P": order.P, "q": order.q, "Q": order.Q}
    assert max(has.values()) == 1 and not order.has_const
    w, e, ws, es, wx, ex = "w1", "e1", f"w{s}", f"e{s}", f"w{s + 1}", f"e{s + 1}"

    def some(**terms):
        return {c: v for c, v in terms.items() if v is not None}

    def when(flag, value):
        return value if has[flag] else None

    y1 = some(**{"w0": "1", ws: when("P", "-lp"), es: when("Q", "-lq")})
    short = [("sp", some(**{w: "1", wx: when("P", "-lp")}))] * has["p"] + [("sq", some(**{e: "1", ex: when("Q", "lq")}))] * has["q"]
    y2 = some(**{"w0": "1", w: when("p", "-sp"), e: when("q", "-sq")})
    long = [("lp", some(**{ws: "1", wx: when("p", "-sp")}))] * has["P"] + [("lq", some(**{es: "1", ex: when("q", "sq")}))] * has["Q"]
    first, second = pair(y1, short), pair(y2, long)
    one = ", ".join(f"{first.get(c, '0::DOUBLE')} AS {c}" for c in ("sp", "sq"))
    two = ", ".join(f"{second.get(c, '0::DOUBLE')} AS {c}" for c in ("lp", "lq"))
    value = {w: "sp", ws: "lp", wx: "-sp * lp", e: "sq", es: "lq", ex: "sq * lq"}
    sse = " + ".join(
        f"({p}) * ({q}) * g_{'_'.join(sorted((x, y)))}" for x, p in [("w0", "1"), *[(v, f"-({value[v]})") for v in xs]]
        for y, q in [("w0", "1"), *[(v, f"-({value[v]})") for v in xs]])
    starts = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in [(0, 0), *[
        (a, b) for a in ((-0.5, 0.5) if order.P else (0,)) for b in ((-0.5, 0.5) if order.Q else (0,))]])

    def turns(label: str, source: str, most: int, stop: str) -> str:
        return f""",
{name}_{label} AS MATERIALIZED (
  WITH RECURSIVE turn(entity, phase, start, i, moved, sp, sq, lp, lq) AS (
    SELECT entity, phase, start, 0, 1::DOUBLE, 0::DOUBLE, 0::DOUBLE, lp, lq FROM {source}
    UNION ALL
    SELECT entity, phase, start, i + 1, abs(lp - old_lp) + abs(lq - old_lq), sp, sq, lp, lq FROM (
      SELECT entity, phase, start, i, sp, sq, lp AS old_lp, lq AS old_lq, {two} FROM (
        SELECT t.entity, t.phase, start, i, lp, lq, {one}, g.* EXCLUDE (entity, phase) FROM turn t JOIN {name}_sums g
          ON t.entity = g.entity AND t.phase = g.phase WHERE i < {most} AND {stop})))
  SELECT * FROM turn QUALIFY row_number() OVER (PARTITION BY entity, phase, start ORDER BY i DESC) = 1)"""

    return (
        f""",
{name}_starts AS (SELECT entity, phase, lp, lq, lp + 3 * lq AS start FROM {name}_sums, (VALUES {starts}) v(lp, lq))"""
        + turns("tried", f"{name}_starts", 400, "moved > 1e-15")
        + f""",
{name}_best AS (SELECT entity, phase, 0 AS start, arg_min(lp, sse) AS lp, arg_min(lq, sse) AS lq FROM (
  SELECT t.*, {sse} AS sse FROM {name}_tried t JOIN {name}_sums g ON t.entity = g.entity AND t.phase = g.phase) GROUP BY entity, phase)"""
        + turns("turned", f"{name}_best", 20000, "moved > 1e-13")
        + f""",
{name}_params AS (SELECT entity, phase, {', '.join(f'{value[x]} AS c{i}' for i, x in enumerate(xs))} FROM {name}_turned)"""
    )


def order_ctes(order, name: str, spans: str = "spans", value: str = "value", common: str | None = None, upto: int = 40) -> str:
    """An order fitted by conditional least squares, and its forecasts.

    Moving-average terms regress on residuals of a long autoregression.  Gives ``<name>_design`` (w0, w1.., e1..),
    ``<name>_fit`` (c0.., nobs, sse; counted on rows after ``common`` if given) and ``<name>_path``.
    """
    from tidemark.operators.features import difference_weights

    weights = difference_weights(order.d, order.D, order.s)
    lost, s = max(weights), order.s
    far_ar, far_ma = order.p + s * order.P, order.q + s * order.Q
    lags = sorted({i + s * j for i in range(order.p + 1) for j in range(order.P + 1)} - {0})
    ma = sorted({i + s * j for i in range(order.q + 1) for j in range(order.Q + 1)} - {0})
    const, at = order.has_const, int(order.has_const)
    depth = max(far_ar + lost, 1)
    over = "OVER (PARTITION BY entity, phase ORDER BY rn)"

    def w(k: int) -> str:
        return " + ".join(f"({c}) * lag({value}, {k + lag}) {over}" for lag, c in weights.items())

    columns = ", ".join(f"{w(k)} AS w{k}" for k in (0, *lags))
    levels = ", ".join(f"lag({value}, {j}) {over} AS y{j}" for j in range(depth))
    text = f",\n{name}_base AS (SELECT *, {columns}, {levels} FROM {spans})"
    if ma:
        text += _shock_ctes(name, lost, far_ma, const, upto)
        shocks = ", ".join(f"lag(e, {k}) {over} AS e{k}" for k in range(far_ma + 1))
        text += f",\n{name}_design AS (SELECT *, {shocks} FROM {name}_base LEFT JOIN {name}_shocked USING (entity, phase, rn))"
    else:
        text += f",\n{name}_design AS (SELECT * FROM {name}_base)"
    xs = [f"w{k}" for k in lags] + [f"e{k}" for k in ma]
    all_xs = (["1::DOUBLE"] if const else []) + xs
    text += f",\n{name}_train AS (SELECT * FROM {name}_design WHERE rn <= fit_end AND rn > {start_sql(order)})"
    k, free = len(all_xs), at + order.p + order.P + order.q + order.Q
    if k != free:
        names = ["w0", *xs]
        sums = ", ".join(f"sum({a} * {b}) AS g_{'_'.join(sorted((a, b)))}" for i, a in enumerate(names) for b in names[i:])
        text += f",\n{name}_sums AS MATERIALIZED (SELECT entity, phase, {sums} FROM {name}_train GROUP BY entity, phase HAVING count(*) > {free})"
        text += _product_ctes(name, order, xs, s)
    else:
        cells = [f"sum(({a}) * ({b})) AS a{i}_{j}" for i, a in enumerate(all_xs) for j, b in enumerate(all_xs)]
        cells += [f"sum(({a}) * w0) AS b{i}" for i, a in enumerate(all_xs)]
        sums = "".join(f", {c}" for c in cells)
        text += f",\n{name}_sums AS MATERIALIZED (SELECT entity, phase{sums} FROM {name}_train GROUP BY entity, phase HAVING count(*) > {free})"
        if order.restricted and (order.p or order.q):
            text += _region_ctes(name, k, at, order.p, order.q)
        else:
            text += f",\n{name}_u_0 AS (SELECT * FROM {name}_sums)" + eliminate_ctes(f"{name}_u", k)
            text += f",\n{name}_params AS (SELECT * FROM {name}_u)"
    guess = " + ".join(f"c{i} * ({x})" for i, x in enumerate(all_xs)) or "0"
    text += f""",
{name}_fit AS MATERIALIZED (SELECT p.*, sse, nobs, n, fit_end, score_end FROM {name}_params p JOIN (
  SELECT t.entity, t.phase, sum((w0 - ({guess})) ** 2) AS sse, count(*) AS nobs, max(n) AS n, max(fit_end) AS fit_end, max(score_end) AS score_end
  FROM {name}_train t JOIN {name}_params p ON t.entity = p.entity AND t.phase = p.phase WHERE rn > {common or start_sql(order)}
  GROUP BY t.entity, t.phase) q ON p.entity = q.entity AND p.phase = q.phase)"""
    level: dict[int, list[str]] = {j: [] for j in range(1, depth + 1)}
    for lag, c in weights.items():
        if lag:
            level[lag].append(f"({-c})")
    for i, lag_ in enumerate(lags):
        for lag, c in weights.items():
            level[lag_ + lag].append(f"({c}) * c{at + i}")
    terms = ["c0" if const else "0::DOUBLE"]
    terms += [f"({' + '.join(v)}) * y{j - 1}" for j, v in level.items() if v]
    terms += [f"c{at + len(lags) + i} * e{lag - 1}" for i, lag in enumerate(ma)]
    ys, es = [f"y{j}" for j in range(depth)], [f"e{j}" for j in range(far_ma)]
    cs = "".join(f", c{i}" for i in range(k))
    state = ", ".join([*ys, *es])
    shifted = ", ".join([" + ".join(terms), *ys[:-1], *(["0::DOUBLE", *es[:-1]] if far_ma else [])])
    text += f""",
{name}_path AS (
  WITH RECURSIVE walk(entity, phase, step, fit_end, score_end{cs}, {state}) AS (
    SELECT d.entity, d.phase, 0::BIGINT, d.fit_end, d.score_end{cs}, {state} FROM {name}_design d
      JOIN {name}_fit f ON d.entity = f.entity AND d.phase = f.phase WHERE d.rn = d.fit_end
    UNION ALL
    SELECT entity, phase, step + 1, fit_end, score_end{cs}, {shifted} FROM walk WHERE fit_end + step < score_end)
  SELECT entity, phase, step, fit_end + step AS rn, y0 AS predicted FROM walk WHERE step > 0)"""
    return text


def own_with(ctes: str, query: str) -> str:
    """A query with its own WITH clause, as one branch of many: a single chain of all orders would nest too deep."""
    return f"SELECT * FROM (WITH {ctes.lstrip(', ' + chr(10))} {query})"


def common_sql(orders) -> str:
    """Last position that not all of the orders can use."""
    return f"greatest({', '.join(sorted({start_sql(o) for o in orders}))})"


def lag_ctes(lags: int, name: str = "lagged", spans: str = "spans") -> str:
    """One-step regression on lags with a constant: ``<name>_fit`` and ``<name>_path``."""
    over = "OVER (PARTITION BY entity, phase ORDER BY rn)"
    columns = ", ".join(f"lag(value, {k}) {over} AS x{k}" for k in range(1, lags + 1))
    xs = ["1::DOUBLE", *[f"x{k}" for k in range(1, lags + 1)]]
    guess = " + ".join(f"c{i} * ({x})" for i, x in enumerate(xs))
    return (
        f",\n{name}_design AS (SELECT * FROM (SELECT *, {columns} FROM {spans}) WHERE rn > {lags})"
        f",\n{name}_train AS (SELECT * FROM {name}_design WHERE rn <= fit_end)"
        + solve_ctes(f"{name}_fit", f"{name}_train", ["entity", "phase"], xs, "value")
        + f""",
{name}_path AS (SELECT d.entity, d.phase, d.date, d.rn, value AS actual, {guess} AS predicted
  FROM {name}_design d JOIN {name}_fit f ON d.entity = f.entity AND d.phase = f.phase
  WHERE d.rn > fit_end AND d.rn <= score_end)"""
    )


METRIC_COLUMNS = ", ".join(r(e, m, 6) for m, e in report_sql().items())


def aic(sse: str, nobs: str, k: str) -> str:
    return f"(2 * ({k} + 1) + {nobs} * (ln(2 * pi() * {sse} / {nobs}) + 1))"


def bic(sse: str, nobs: str, k: str) -> str:
    return f"(({k} + 1) * ln({nobs}) + {nobs} * (ln(2 * pi() * {sse} / {nobs}) + 1))"
