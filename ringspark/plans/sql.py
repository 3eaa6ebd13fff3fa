"""The SQL surface: ``register(spark)`` makes every function callable from spark.sql, and
``query(spark, text)`` runs the aggregates as the engine's own.

``query`` takes a SELECT with ring aggregates (sum_to_triple_n_m, sum_to_nb_agg_n_m, sum_triple,
sum_nb_agg) and computes each by ``operators.aggregate``, that is by partial and final hash
aggregation of flat sums; HAVING is of group columns alone and is applied at the scan; other
aggregates may stand beside.  Other statements (with CTEs, or grouped by expressions) go to
spark.sql as they are, where the ring aggregates gather a group's columns in one Arrow batch:
right for small groups.

quack, multiply_triple and multiply_nb_agg are SQL functions, which the engine inlines.
to_cofactor, to_nb_agg and the predictors take any number of arguments and work on Arrow
batches: floating-point and decimal arguments are numbers, integers are categories, by the
argument's type; other types and nulls are errors.  linreg_predict may draw noise and so
counts as nondeterministic.  The trainers get one row for each model.
"""

from __future__ import annotations

import re
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ml.models import LDA, QDA, LinearRegression, NaiveBayes
from ..ml.triple import NbAgg, Triple
from ..operators.aggregate import cofactor, nb_agg, sum_nb_agg, sum_triple
from ..types import nb_type, pairs, triple_type

PARAMS = "array<double>"


def lift_values(columns: list[np.ndarray], n: int) -> Triple:
    """The triple of columns, the first n of them numbers."""
    x = [np.asarray(c, float) for c in columns[:n]]
    c = [np.asarray(v, int) for v in columns[n:]]
    rows = len(columns[0])

    def sums(keys: np.ndarray, weights=None) -> dict:
        values, at = np.unique(keys, return_inverse=True)
        return dict(zip(values.tolist(), np.bincount(at, weights, len(values)).astype(float).tolist(), strict=True))

    def both(a: np.ndarray, b: np.ndarray) -> dict:
        values, counts = np.unique(np.column_stack([a, b]), axis=0, return_counts=True)
        return {(int(k), int(l)): float(v) for (k, l), v in zip(values, counts, strict=True)}

    return Triple(
        rows,
        np.array([v.sum() for v in x]),
        np.array([(x[i] * x[j]).sum() for i, j in pairs(len(x))]),
        [sums(k) for k in c],
        [sums(k, v) for v in x for k in c],
        [both(c[i], c[j]) for i, j in pairs(len(c))],
    )


def _nb(t: Triple) -> NbAgg:
    n = len(t.lin)
    squares = [t.quad[k] for k, (i, j) in enumerate(pairs(n)) if i == j]
    return NbAgg(t.N, t.lin, np.array(squares, float), t.lin_cat)


def _split(columns) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Numbers and categories, by the type."""
    num, cat = [], []
    for c in columns:
        if c.null_count:
            raise ValueError("null argument")
        if pa.types.is_floating(c.type) or pa.types.is_decimal(c.type):
            num.append(np.asarray(c.cast(pa.float64())))
        elif pa.types.is_integer(c.type):
            cat.append(np.asarray(c.cast(pa.int32())))
        else:
            raise TypeError(f"{c.type} is neither a number nor a category")
    return num, cat


def _rows_of(values: pa.Array, n: int, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), values)


def _lifted(columns, nb: bool) -> pa.Array:
    """The lift of every row of the batch."""
    num, cat = _split(columns)
    n = len(columns[0])
    together = lambda cols, kind: np.column_stack(cols).ravel() if cols else np.zeros(0, kind)
    dense = lambda cols: _rows_of(pa.array(together(cols, float), pa.float64()), n, len(cols))

    def lists(names, keys: list[list[np.ndarray]], values: list[np.ndarray]) -> pa.Array:
        """One entry in each list."""
        arrays = [pa.array(together([k[i] for k in keys], np.int32), pa.int32()) for i in range(len(names))]
        entries = pa.StructArray.from_arrays([*arrays, pa.array(together(values, float), pa.float64())], [*names, "value"])
        return _rows_of(_rows_of(entries, n * len(values), 1), n, len(values))

    ones = np.ones(n)
    squares = [x * x for x in num] if nb else [num[i] * num[j] for i, j in pairs(len(num))]
    out = {"N": pa.array(np.ones(n, np.int64)), "lin_num": dense(num), "quad_num": dense(squares), "lin_cat": lists(["key"], [[c] for c in cat], [ones] * len(cat))}
    if not nb:
        out["quad_num_cat"] = lists(["key"], [[c] for _ in num for c in cat], [x for x in num for _ in cat])
        both = pairs(len(cat))
        out["quad_cat"] = lists(["key1", "key2"], [[cat[i], cat[j]] for i, j in both], [ones] * len(both))
    return pa.StructArray.from_arrays(list(out.values()), list(out))


def _design(num, cat, categories, first: int = 0) -> np.ndarray:
    """Rows x features: numbers, then a column for each category."""
    hot = [c == k for c, values in zip(cat, categories, strict=True) for k in values[first:]]
    columns = [*num, *[h.astype(float) for h in hot]]
    return np.column_stack(columns) if columns else np.zeros((0, 0))


def _by_model(score, kind: pa.DataType, options: int):
    """A predictor over a batch: rows of the same parameters and options go together. Arguments: parameters, options, columns."""

    def predict(params, *rest):
        given, columns = rest[:options], rest[options:]
        num, cat = _split(columns)
        out = np.zeros(len(params), kind.to_pandas_dtype())
        models: dict[tuple, list[int]] = {}
        for k, key in enumerate(zip(params.to_pylist(), *[g.to_pylist() for g in given], strict=True)):
            models.setdefault((tuple(key[0]), *key[1:]), []).append(k)
        for key, rows in models.items():
            out[rows] = score(list(key[0]), *key[1:], [x[rows] for x in num], [c[rows] for c in cat])
        return pa.array(out, kind)

    return predict


def _linreg_predict(params, noise, normalize, num, cat) -> np.ndarray:
    model = LinearRegression.from_params(params, len(num), normalize, noise)
    x = _design(num, cat, model.categories)
    out = model.intercept + (x - (model.means if normalize else 0)) @ model.weights
    return out + (np.random.default_rng().normal(size=len(out)) * model.std if noise else 0.0)


def _lda_predict(params, normalize, num, cat) -> np.ndarray:
    """The index of the class."""
    model = LDA.from_params(params, normalize, len(num))
    x = _design(num, cat, model.categories) - (model.means if normalize else 0)
    return np.argmax(x @ model.weights.T + model.intercepts, 1)


def _qda_predict(params, normalize, num, cat) -> np.ndarray:
    model = QDA.from_params(params, normalize, len(num))
    x = _design(num, cat, model.categories, 1) - (model.means if normalize else 0)
    scores = [np.einsum("ip,pq,iq->i", x, q, x) + x @ w + b for q, w, b in zip(model.quad, model.lin, model.intercepts, strict=True)]
    return np.array(model.labels)[np.argmax(scores, 0)]


def _nb_predict(params, normalize, num, cat) -> np.ndarray:
    model = NaiveBayes.from_params(params, len(num))
    scores = []
    for prior, numbers, shares in zip(model.priors, model.numbers, model.shares, strict=True):
        s = np.log(prior)
        for v, (mu, var) in zip(num, numbers, strict=True):
            s = s - (v - mu) ** 2 / (2 * (var + 1e-9)) - 0.5 * np.log(2 * np.pi * (var + 1e-9))
        for c, known in zip(cat, shares, strict=True):
            s = s + np.array([np.log(known[k]) if known.get(k) else -np.inf for k in c.tolist()])
        scores.append(s)
    return np.array(model.labels)[np.argmax(scores, 0)]


def _aggregate(function, kind: str):
    from pyspark.sql.functions import arrow_udf
    from pyspark.util import PythonEvalType

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return arrow_udf(function, kind, PythonEvalType.SQL_GROUPED_AGG_ARROW_UDF)


def _as_dict(row: tuple, nb: bool) -> dict:
    one = lambda ds: [[{"key": k, "value": v} for k, v in d] for d in ds]
    out = {"N": row[0], "lin_agg": row[1], "quad_agg": row[2], "lin_cat": one(row[3])}
    return out if nb else out | {"quad_num_cat": one(row[4]), "quad_cat": [[{"key1": k, "key2": l, "value": v} for k, l, v in d] for d in row[5]]}


def _plain(value: dict) -> tuple:
    return tuple([[tuple(e.values()) for e in es] for es in v] if isinstance(v, list) and v and isinstance(v[0], list) else v for v in value.values())


def _sum_values(of, nb: bool):
    def total(column):
        out = of()
        for value in column.to_pylist():
            if value is not None:
                out = out + of.from_row(_plain(value))
        return _as_dict(out.to_row(), nb)

    return total


def _fused(n: int, nb: bool):
    def total(*columns):
        if any(c.null_count for c in columns):
            raise ValueError("null argument")
        t = lift_values([c.to_numpy(zero_copy_only=False) for c in columns], n)
        return _as_dict((_nb(t) if nb else t).to_row(), nb)

    return total


#: Bodies of the SQL functions over a and b; W are the widths of the lists.
_SCALED = "transform({0}, v -> v * {1})"
_LISTS = "transform({0}, es -> transform(es, e -> named_struct('key', e.key, 'value', e.value * {1})))"
_PAIRS = "transform({0}, es -> transform(es, e -> named_struct('key1', e.key1, 'key2', e.key2, 'value', e.value * {1})))"
_ROW = "slice({0}, int(i * size({1}) - i * (i - 1) / 2 + 1), int(size({1}) - i))"
_BLOCK = "slice({0}, i * size({1}) + 1, size({1}))"
_EACH = "flatten(transform(sequence(0, size({0}) - 1), i -> {1}))"


def _bodies() -> dict[str, str]:
    from ..types import ONE, TWO

    each = lambda values, item, kind: f"if(size({values}) > 0, {_EACH.format(values, item)}, cast(array() as {kind}))"
    cross = "transform(b.lin_cat, other -> flatten(transform(a.lin_cat[i], x -> transform(other, y -> named_struct('key1', x.key, 'key2', y.key, 'value', x.value * y.value)))))"
    lin = f"concat({_SCALED.format('a.lin_agg', 'b.N')}, {_SCALED.format('b.lin_agg', 'a.N')})"
    lin_cat = f"concat({_LISTS.format('a.lin_cat', 'b.N')}, {_LISTS.format('b.lin_cat', 'a.N')})"
    quad = each("a.lin_agg", f"concat({_SCALED.format(_ROW.format('a.quad_agg', 'a.lin_agg'), 'b.N')}, transform(b.lin_agg, y -> a.lin_agg[i] * y))", "array<double>")
    mixed_a = each("a.lin_agg", f"concat({_LISTS.format(_BLOCK.format('a.quad_num_cat', 'a.lin_cat'), 'b.N')}, {_LISTS.format('b.lin_cat', 'a.lin_agg[i]')})", ONE)
    mixed_b = each("b.lin_agg", f"concat({_LISTS.format('a.lin_cat', 'b.lin_agg[i]')}, {_LISTS.format(_BLOCK.format('b.quad_num_cat', 'b.lin_cat'), 'a.N')})", ONE)
    cat = each("a.lin_cat", f"concat({_PAIRS.format(_ROW.format('a.quad_cat', 'a.lin_cat'), 'b.N')}, {cross})", TWO)
    triple = f"'N', a.N * b.N, 'lin_num', {lin}, 'quad_num', concat({quad}, {_SCALED.format('b.quad_agg', 'a.N')}), 'lin_cat', {lin_cat}"
    triple += f", 'quad_num_cat', concat({mixed_a}, {mixed_b}), 'quad_cat', concat({cat}, {_PAIRS.format('b.quad_cat', 'a.N')})"
    nb = f"'N', a.N * b.N, 'lin_num', {lin}, 'quad_num', concat({_SCALED.format('a.quad_agg', 'b.N')}, {_SCALED.format('b.quad_agg', 'a.N')}), 'lin_cat', {lin_cat}"
    two = lambda kind: f"(a {kind}, b {kind})"
    return {
        "quack(name STRING) RETURNS STRING": "concat('Quack ', name, ' \U0001f425')",
        f"multiply_triple{two(triple_type())} RETURNS {triple_type('num')}": f"cast(named_struct({triple}) as {triple_type('num')})",
        f"multiply_nb_agg{two(nb_type())} RETURNS {nb_type('num')}": f"cast(named_struct({nb}) as {nb_type('num')})",
    }


def register(spark: SparkSession, shapes=tuple((n, m) for n in range(20) for m in range(20) if n + m)) -> None:
    """shapes: the (numbers, categories) for which sum_to_triple_n_m and sum_to_nb_agg_n_m are made."""
    from pyspark.sql.functions import arrow_udf

    from_row, nb_row = Triple.from_row, NbAgg.from_row
    for signature, body in _bodies().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    linreg = lambda t, label, rate, lam, iters, variance, normalize: LinearRegression.fit(
        from_row(t), label, lam, normalize, variance, "bgd", rate, iters
    ).to_params()
    for name, function, kind in (
        ("linreg_train", linreg, PARAMS),
        ("lda_train", lambda t, label, shrinkage, normalize: LDA.fit(from_row(t), label, float(shrinkage), normalize).to_params(), PARAMS),
        ("qda_train", lambda ts, labels, normalize: QDA.fit([from_row(t) for t in ts], labels, normalize).to_params(), PARAMS),
        ("nb_train", lambda aggs, labels: NaiveBayes.fit([nb_row(a) for a in aggs], labels).to_params(), PARAMS),
    ):
        spark.udf.register(name, function, kind)
    linreg_predict = arrow_udf(_by_model(_linreg_predict, pa.float64(), 2), "double").asNondeterministic()
    for name, function in (
        ("to_cofactor", arrow_udf(lambda *v: _lifted(v, False), triple_type("num"))),
        ("to_nb_agg", arrow_udf(lambda *v: _lifted(v, True), nb_type("num"))),
        ("linreg_predict", linreg_predict),
        ("lda_predict", arrow_udf(_by_model(_lda_predict, pa.int32(), 1), "int")),
        ("qda_predict", arrow_udf(_by_model(_qda_predict, pa.int32(), 1), "int")),
        ("nb_predict", arrow_udf(_by_model(_nb_predict, pa.int32(), 1), "int")),
        ("sum_triple", _aggregate(_sum_values(Triple, False), triple_type())),
        ("sum_nb_agg", _aggregate(_sum_values(NbAgg, True), nb_type())),
    ):
        spark.udf.register(name, function)
    for n, m in shapes:
        spark.udf.register(f"sum_to_triple_{n}_{m}", _aggregate(_fused(n, False), triple_type()))
        spark.udf.register(f"sum_to_nb_agg_{n}_{m}", _aggregate(_fused(n, True), nb_type()))


_CALL = re.compile(r"\b(sum_to_triple_(\d+)_(\d+)|sum_to_nb_agg_(\d+)_(\d+)|sum_triple|sum_nb_agg)\s*\(", re.I)
_CLAUSES = ("select", "from", "where", "group by", "having", "order by", "limit")


def _outside(text: str):
    """(place, depth) of every character outside strings."""
    depth, quote = 0, ""
    for k, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        else:
            depth -= c in ")]"
            yield k, depth
            depth += c in "(["


def _clauses(text: str) -> dict[str, str] | None:
    """The clauses of one SELECT; None for other statements."""
    top = {k for k, d in _outside(text) if d == 0}
    words = re.compile("|".join(r"\b" + c.replace(" ", r"\s+") + r"\b" for c in [*_CLAUSES, "with", "union", "intersect", "except", "distinct", "window", "qualify", "cluster by", "lateral"]), re.I)
    found = [(m.start(), m.end(), " ".join(m[0].lower().split())) for m in words.finditer(text) if m.start() in top]
    names = [n for _, _, n in found]
    if not names or names[0] != "select" or "from" not in names or len(set(names)) < len(names) or set(names) - set(_CLAUSES) or names != sorted(names, key=_CLAUSES.index):
        return None
    ends = [a for a, _, _ in found[1:]] + [len(text)]
    return {n: text[b:e].strip().rstrip(";").strip() for (_, b, n), e in zip(found, ends, strict=True)}


def _list(text: str) -> list[str]:
    """Split at commas that no bracket holds."""
    cuts = [-1, *[k for k, d in _outside(text) if d == 0 and text[k] == ","], len(text)]
    return [text[a + 1 : b].strip() for a, b in zip(cuts, cuts[1:], strict=False)]


def _calls(text: str) -> list[tuple[int, int, re.Match]]:
    """Start, end and name of the outermost ring aggregates."""
    out, plain = [], {k: d for k, d in _outside(text)}
    for m in _CALL.finditer(text):
        if m.start() in plain and not (out and m.start() < out[-1][1]):
            end = next(k for k, d in plain.items() if k > m.end() - 1 and text[k] == ")" and d == plain[m.end() - 1])
            out.append((m.start(), end + 1, m))
    return out


def query(spark: SparkSession, text: str) -> DataFrame:
    """A statement's result; ring aggregates of a SELECT run as partial and final hash aggregation."""
    parts = _clauses(text)
    calls = _calls(parts["select"]) if parts else []
    keys = _list(parts["group by"]) if parts and "group by" in parts else []
    simple = all(re.fullmatch(r"[A-Za-z_]\w*(\.\w+)?", k) for k in keys)
    if not calls or not simple or _calls(parts.get("having", "")) or any(_CALL.search(c[2].string[c[2].end() : c[1]]) for c in calls):
        return spark.sql(text)
    names = [k.rpartition(".")[2] for k in keys]
    select, arguments = parts["select"], []
    items, others = [], []
    for item in _list(select):
        inside = _calls(item)
        named = re.fullmatch(r"(.*\S)\s+as\s+`?(\w+)`?", item, re.I | re.S)
        value, label = (named[1], named[2]) if named else (item, item.rpartition(".")[2] if item in keys else item)
        if not inside:  # a group column, or another aggregate
            if value in keys:
                items.append(f"`{value.rpartition('.')[2]}` as `{label}`")
            else:
                others.append(f"{value} as __o{len(others)}")
                items.append(f"__o{len(others) - 1} as `{label}`")
            continue
        for start, end, m in reversed(inside):
            arguments.append((len(arguments), m[1].lower(), _list(item[m.end() : end - 1])))
            item = f"{item[:start]}__a{len(arguments) - 1}{item[end:]}"
        items.append(item if named else f"{item} as `{label}`")
    inputs = [f"{x} as __x{k}_{j}" for k, _, xs in arguments for j, x in enumerate(xs)]
    rows = spark.sql(f"select {', '.join([*[f'{k} as {n}' for k, n in zip(keys, names, strict=True)], *inputs])} from {parts['from']}" + (f" where {parts['where']}" if "where" in parts else ""))
    if "having" in parts:
        rows.limit(0).select(*names).createOrReplaceTempView("__ring_keys")
        spark.sql(f"select 1 from __ring_keys where {parts['having']}")  # fails where it asks for more than the group's columns
        rows = rows.where(parts["having"])
    made = []
    for k, name, xs in arguments:
        columns, shape = [f"__x{k}_{j}" for j in range(len(xs))], re.findall(r"\d+", name)
        if shape:
            n, m = map(int, shape)
            if n + m != len(xs):
                raise ValueError(f"{name} takes {n + m} arguments")
            made.append((cofactor if "triple" in name else nb_agg)(rows, columns[:n], columns[n:], names, alias=f"__a{k}"))
        else:
            made.append((sum_triple if name == "sum_triple" else sum_nb_agg)(rows, columns[0], names, f"__a{k}"))
    if others:
        group = f" group by {parts['group by']}" if keys else ""
        where = f" where {parts['where']}" if "where" in parts else ""
        made.append(spark.sql(f"select {', '.join([*[f'{k} as {n}' for k, n in zip(keys, names, strict=True)], *others])} from {parts['from']}{where}{group}"))
    out = made[0]
    for other in made[1:]:
        if not names:
            out = out.crossJoin(other)  # a row each
        else:
            other = other.withColumnsRenamed({c: f"__r_{c}" for c in names})
            out = out.join(other, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in names]).drop(*[f"__r_{c}" for c in names])
    out.createOrReplaceTempView("__ring_groups")
    tail = "".join(f" {c} {parts[c]}" for c in ("order by", "limit") if c in parts)
    return spark.sql(f"select {', '.join(items)} from __ring_groups{tail}")
