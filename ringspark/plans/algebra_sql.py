"""SQL of the models' algebra, for the oracles: linear systems solved by elimination, step by step.

Every function returns common table expressions, ``name as materialized (...)``, to be put after a ``with``.
Features are SQL expressions over the rows; a system's columns are m<row>_<column>.
"""

from __future__ import annotations


def cte(name: str, body: str) -> str:
    return f"{name} as materialized ({body})"


def eliminated(name: str, source: str, p: int, right: int, keep: str = "") -> list[str]:
    """Gauss and Jordan over p rows and p + right columns; ``keep`` starts the lists of columns. The pivots stay as d0, ..."""
    out, now = [], source
    for s in range(p):
        cells = [
            f"m{s}_{j} / m{s}_{s} as m{s}_{j}" if i == s else f"m{i}_{j} - m{i}_{s} * m{s}_{j} / m{s}_{s} as m{i}_{j}" for i in range(p) for j in range(s + 1, p + right)
        ]
        pivots = [*[f"d{k}" for k in range(s)], f"m{s}_{s} as d{s}"]
        out.append(cte(f"{name}{s}", f"select {keep}{', '.join([*cells, *pivots])} from {now}"))
        now = f"{name}{s}"
    return [*out, cte(name, f"select * from {now}")]


def scaled(name: str, rows: str, features: list[str], carried: str, where: str = "true", scale: bool = True) -> list[str]:
    """z0, ...: the features less their means and, if asked, over their deviations, both over the rows ``where``."""
    stats = [f"avg({f}) as u{i}, {f'case when stddev_pop({f}) < 1e-12 * greatest(1, abs(avg({f}))) then 1 else stddev_pop({f}) end' if scale else '1'} as v{i}" for i, f in enumerate(features)]
    z = [f"({f} - u{i}) / v{i} as z{i}" for i, f in enumerate(features)]
    return [cte(f"{name}_u", f"select {', '.join(stats)} from {rows} where {where}"), cte(name, f"select {carried}, {', '.join(z)} from {rows}, {name}_u")]


def regression(name: str, rows: str, label: str, features: list[str], carried: str, where: str = "true", ridge: float = 0.0) -> list[str]:
    """``name``: the rows with ``value``, the prediction; ``name_e``: the residual deviation over the rows ``where``."""
    p = len(features)
    z = scaled(f"{name}_z", rows, [*features, label], f"{carried}, {where} as used", where)
    cells = [f"avg(z{i} * z{j}){f' + {ridge}' if i == j else ''} as m{i}_{j}" for i in range(p) for j in range(p)] + [f"avg(z{i} * z{p}) as m{i}_{p}" for i in range(p)]
    a = cte(f"{name}_a", f"select {', '.join(cells)} from {name}_z where used")
    value = f"u{p} + v{p} * ({' + '.join(f'm{i}_{p} * z{i}' for i in range(p))})"
    out = cte(name, f"select z.*, u{p} + v{p} * z{p} as y, {value} as value from {name}_z z, {name}_g, {name}_z_u")
    return [*z, a, *eliminated(f"{name}_g", f"{name}_a", p, 1), out, cte(f"{name}_e", f"select sqrt(avg((y - value) ** 2)) as deviation from {name} where used")]


def discriminant(name: str, rows: str, label: str, classes, features: list[str], carried: str, where: str = "true", shrinkage: float = 0.0, scale: bool = False) -> list[str]:
    """``name``: the rows with ``value``, the class of the largest linear score."""
    p, k = len(features), len(classes)
    z = scaled(f"{name}_z", rows, features, f"{carried}, {label} as k, {where} as used", where, scale)
    sums = ["count(*)::double as n", *[f"sum(z{i} * z{j}) as s{i}_{j}" for i in range(p) for j in range(p)]]
    for c, v in enumerate(classes):
        sums += [f"count(*) filter (k = {v})::double as n{c}", *[f"coalesce(sum(z{i}) filter (k = {v}), 0) as c{c}_{i}" for i in range(p)]]
    within = lambda i, j: f"(s{i}_{j} - {' - '.join(f'c{c}_{i} * c{c}_{j} / n{c}' for c in range(k))})"
    trace = " + ".join(within(i, i) for i in range(p))
    cells = [f"({1 - shrinkage} * {within(i, j)}{f' + {shrinkage} * t / {p}' if i == j else ''}) / n as m{i}_{j}" for i in range(p) for j in range(p)]
    cells += [f"c{c}_{i} / n{c} as m{i}_{p + c}" for i in range(p) for c in range(k)]
    keep = ", ".join(["n", *[f"n{c}" for c in range(k)], *[f"c{c}_{i}" for c in range(k) for i in range(p)]]) + ", "
    score = [
        f"struct_pack(s := {' + '.join(f'm{i}_{p + c} * z{i}' for i in range(p))} - 0.5 * ({' + '.join(f'c{c}_{i} / n{c} * m{i}_{p + c}' for i in range(p))}) + ln(n{c} / n), k := {-c}, v := {v})"
        for c, v in enumerate(classes)
    ]
    out = cte(name, f"select z.*, list_max([{', '.join(score)}]).v as value from {name}_z z, {name}_g")
    return [
        *z,
        cte(f"{name}_s", f"select {', '.join(sums)} from {name}_z where used"),
        cte(f"{name}_t", f"select *, {trace} as t from {name}_s"),
        cte(f"{name}_a", f"select {keep}{', '.join(cells)} from {name}_t"),
        *eliminated(f"{name}_g", f"{name}_a", p, k, keep),
        out,
    ]


def quadratic(name: str, rows: str, label: str, features: list[str], carried: str) -> list[str]:
    """``name``: the rows (numbered by ``row``) with ``value``, the class of the largest quadratic score."""
    p = len(features)
    z = scaled(f"{name}_z", rows, features, f"{carried}, {label} as k, row")
    mu = [f"avg(z{i}) as c{i}" for i in range(p)]
    cov = [f"avg(z{i} * z{j}) - avg(z{i}) * avg(z{j}) as m{i}_{j}" for i in range(p) for j in range(p)] + [f"{float(i == j)} as m{i}_{p + j}" for i in range(p) for j in range(p)]
    keep = "k, prior, " + ", ".join(f"c{i}" for i in range(p)) + ", "
    a = cte(f"{name}_a", f"select k, ln(count(*) / sum(count(*)) over ()) as prior, {', '.join([*mu, *cov])} from {name}_z group by k")
    form = " + ".join(f"(z{i} - c{i}) * m{i}_{p + j} * (z{j} - c{j})" for i in range(p) for j in range(p))
    logs = " + ".join(f"ln(d{i})" for i in range(p))
    score = f"-0.5 * ({form}) - 0.5 * ({logs}) + prior"
    best = f"select row, arg_max(g.k, {score}) as value from {name}_z z, {name}_g g group by row"
    return [*z, a, *eliminated(f"{name}_g", f"{name}_a", p, p, keep), cte(f"{name}_b", best), cte(name, f"select z.*, value from {name}_z z join {name}_b using (row)")]


def normal(key: str, seed: int) -> str:
    """The draw of ``mice`` for a row's key."""
    uniform = lambda k: f"(('0x' || substr(md5({key} || '|{seed}|{k}'), 1, 12))::bigint + 0.5) / {float(1 << 48)}"
    return f"sqrt(-2 * ln({uniform(0)})) * cos(2 * pi() * {uniform(1)})"


def imputed(holes: str, num: list[str], cat: dict[str, list[int]], steps: list[str], shrinkage: float, seeds: dict[str, int] | None = None, key: str = "id") -> list[str]:
    """``done``: one iteration over the table ``holes``, column after column. cat: the values of each category; seeds: of the draws, if any are made."""
    names = [*num, *cat]
    fill = {c: f"(select avg({c}) from {holes})" if c in num else f"(select {c} from (select {c}, count(*) as n from {holes} where {c} is not null group by {c}) order by n desc, {c} limit 1)" for c in steps}
    out = [cte("t0", f"select {key}, {', '.join(f'coalesce({c}, {fill[c]}) as {c}' if c in steps else c for c in names)}, {', '.join(f'{c} is null as null_{c}' for c in steps)} from {holes}")]
    for k, c in enumerate(steps):
        carried = ", ".join([key, *names, *[f"null_{s}" for s in steps]])
        numbers = [x for x in num if x != c]
        if c in num:  # without each category's first value the system is regular and its predictions are the same
            features = [*numbers, *[f"({x} = {v})::int" for x, values in cat.items() for v in values[1:]]]
            out += regression(f"s{k}", f"t{k}", c, features, carried, f"not null_{c}")
            value, source = ("value", f"s{k}") if seeds is None else (f"value + deviation * {normal(key, seeds[c])}", f"s{k}, s{k}_e")
        else:
            features = [*numbers, *[f"({x} = {v})::int" for x, values in cat.items() if x != c for v in values]]
            out += discriminant(f"s{k}", f"t{k}", c, cat[c], features, carried, f"not null_{c}", shrinkage)
            value, source = "value", f"s{k}"
        kept = [f"case when null_{c} then {value} else {c} end as {c}" if x == c else x for x in names]
        out.append(cte(f"t{k + 1}", f"select {key}, {', '.join([*kept, *[f'null_{s}' for s in steps]])} from {source}"))
    return [*out, cte("done", f"select * from t{len(steps)}")]
