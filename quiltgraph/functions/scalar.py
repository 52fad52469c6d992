"""Operators and scalar functions with the language's null, type and number rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quiltgraph.errors import QueryError, mistyped, nearest, semantic
from quiltgraph.functions import temporal
from quiltgraph.functions.types import NUMBERS, Typed, all_of, is_list, joined, null


def unknown_or(value: bool, *columns: Column) -> Column:
    """``value``, or null if any column is."""
    nulls = columns[0].isNull()
    for c in columns[1:]:
        nulls = nulls | c.isNull()
    return F.when(nulls, F.lit(None)).otherwise(F.lit(value))


def equal(a: Typed, b: Typed) -> Column:
    """Three-valued equality; values of different types are not equal."""
    if "null" in (a.t, b.t):
        return F.lit(None).cast("boolean")
    if is_list(a.t) and is_list(b.t):
        each = F.zip_with(a.col, b.col, lambda x, y: F.struct(equal(Typed(x, a.t[1]), Typed(y, b.t[1])).alias("e")))
        verdict = F.aggregate(each, F.lit(True), lambda acc, x: acc & x["e"])
        return F.when(F.size(a.col) != F.size(b.col), F.lit(False)).otherwise(verdict)
    if isinstance(a.t, tuple) and isinstance(b.t, tuple):
        if a.t[0] != b.t[0]:
            return unknown_or(False, a.col, b.col)
        if a.t[0] in ("node", "rel"):
            return a.col["_id"] == b.col["_id"]
        if {k for k, _ in a.t[1]} != {k for k, _ in b.t[1]}:
            return unknown_or(False, a.col, b.col)
        right = dict(b.t[1])
        return all_of(F.lit(True), *(equal(Typed(a.col[k], t), Typed(b.col[k], right[k])) for k, t in a.t[1]))
    if a.t == b.t or "any" in (a.t, b.t) or a.t in NUMBERS and b.t in NUMBERS:
        return a.col == b.col
    return unknown_or(False, a.col, b.col)


def ordered(op: str, a: Typed, b: Typed) -> Column:
    """< <= > >=: null where the types can't be compared, false where a number meets NaN."""
    if "null" in (a.t, b.t):
        return F.lit(None).cast("boolean")
    comparable = a.t == b.t and a.t != "dur" and not (isinstance(a.t, tuple) and a.t[0] != "list")
    if not (comparable or "any" in (a.t, b.t) or a.t in NUMBERS and b.t in NUMBERS):
        return F.lit(None).cast("boolean")
    x, y = temporal.comparable(a), temporal.comparable(b)
    out = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    if "float" in (a.t, b.t):
        bad = F.lit(False)
        for c in (a, b):
            bad = bad | F.isnan(c.col) if c.t == "float" else bad
        out = out & ~bad
    return out


def compare(op: str, a: Typed, b: Typed) -> Column:
    if op == "=":
        return equal(a, b)
    if op == "<>":
        return ~equal(a, b)
    return ordered(op, a, b)


def member(x: Typed, items: Typed) -> Column:
    if items.t == "null":
        return F.lit(None).cast("boolean")
    if not is_list(items.t):
        raise mistyped("IN needs a list")
    if x.t == "null":
        return F.when(F.size(items.col) == 0, F.lit(False)).otherwise(F.lit(None).cast("boolean"))
    return F.exists(items.col, lambda y: F.when(F.lit(True), equal(x, Typed(y, items.t[1]))))


def divided(a: Typed, b: Typed) -> Typed:
    if a.t == b.t == "int":
        return Typed(F.when(b.col != 0, F.call_function("div", a.col, F.when(b.col != 0, b.col))), "int")
    x, y = a.col.cast("double"), b.col.cast("double")
    safe = x / F.when(y != 0, y)
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    if b.t == "int":
        zero = F.lit(None).cast("double")
    else:
        zero = F.when((x == 0) | F.isnan(x), nan)
        zero = zero if a.t == "int" else zero.when(x > 0, inf).otherwise(-inf)
    return Typed(F.when(y == 0, zero).otherwise(safe), "float")


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    if "null" in (a.t, b.t):
        if op == "+" and is_list(a.t if b.t == "null" else b.t):
            return null()
        return null()
    if temporal.is_temporal(a.t) or temporal.is_temporal(b.t):
        return temporal.arithmetic(op, a, b)
    if op == "+":
        if is_list(a.t) or is_list(b.t):
            x, y = (v if is_list(v.t) else Typed(F.array(v.col), ("list", v.t)) for v in (a, b))
            t = joined(x.t, y.t)
            if t[1] == "any" and "any" not in (x.t[1], y.t[1]):
                raise mistyped("a list of mixed types")
            return Typed(F.concat(cast(x, t).col, cast(y, t).col), t)
        if a.t == b.t == "str":
            return Typed(F.concat(a.col, b.col), "str")
    if "any" not in (a.t, b.t) and not (a.t in NUMBERS and b.t in NUMBERS):
        raise mistyped(f"{op} of {a.t} and {b.t}")
    t = "int" if a.t == b.t == "int" else "float"
    if op == "/":
        return divided(a, b)
    if op == "%":
        return Typed(a.col % F.when(b.col != 0, b.col), t)
    if op == "^":
        return Typed(F.pow(a.col, b.col), "float")
    x, y = (a.col, b.col) if t == "int" else (a.col.cast("double"), b.col.cast("double"))
    return Typed({"+": x + y, "-": x - y, "*": x * y}[op], t)


def cast(x: Typed, t) -> Typed:
    if t == "float" and x.t == "int":
        return Typed(x.col.cast("double"), t)
    if is_list(t) and is_list(x.t) and t != x.t:
        if x.t[1] == "null":
            return Typed(x.col, t)
        return Typed(F.transform(x.col, lambda y: cast(Typed(y, x.t[1]), t[1]).col), t)
    return x


def text_predicate(op: str, a: Typed, b: Typed) -> Column:
    if any(x.t not in ("str", "any") for x in (a, b)):
        return F.lit(None).cast("boolean")
    if op == "=~":
        return F.regexp_like(a.col, F.concat(F.lit("\\A(?:"), b.col, F.lit(")\\z")))
    return {"STARTS": a.col.startswith, "ENDS": a.col.endswith, "CONTAINS": a.col.contains}[op](b.col)


def to_text(x: Typed) -> Column:
    if x.t == "float":
        plain = F.regexp_replace(F.format_string("%.17f", x.col), r"(\.\d+?)0+$", "$1")
        short = x.col.cast("string")
        return F.when(F.isnan(x.col) | (F.abs(x.col) == float("inf")), short).when(short.contains("E"), F.when(F.abs(x.col) >= 1e7, F.concat(x.col.cast("decimal(38,0)").cast("string"), F.lit(".0"))).otherwise(plain)).otherwise(short)
    if temporal.is_temporal(x.t):
        return temporal.to_text(x)
    if isinstance(x.t, tuple):
        raise mistyped("toString of a list, map or graph element", "InvalidArgumentValue")
    return x.col.cast("string")


def to_integer(x: Typed) -> Column:
    if x.t == "float":
        return F.when(F.isnan(x.col), None).otherwise(F.expr("bigint(0)") + F.when(x.col >= 0, F.floor(x.col)).otherwise(F.ceil(x.col)))
    if x.t == "str":
        number = F.when(x.col.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), x.col)
        return F.coalesce(number.try_cast("bigint"), number.try_cast("double").try_cast("bigint"))
    return x.col.cast("bigint")


def _number(f, out="float", keep=False):
    def run(x: Typed) -> Typed:
        if x.t not in (*NUMBERS, "any"):
            raise mistyped("a number is needed")
        return Typed(f(x.col), x.t if keep else out)

    return run


def _text(f, out="str"):
    def run(*args: Typed) -> Typed:
        if args[0].t not in ("str", "any"):
            return Typed(F.lit(None).cast("string"), "str")
        return Typed(f(*(a.col for a in args)), out)

    return run


def _log(f):
    def run(c: Column) -> Column:
        c = c.cast("double")
        return F.when(c == 0, F.lit(float("-inf"))).when(c < 0, F.lit(float("nan"))).otherwise(f(c))

    return run


def size(x: Typed) -> Typed:
    if is_list(x.t):
        return Typed(F.when(x.col.isNotNull(), F.size(x.col)).cast("bigint"), "int")
    if x.t in ("str", "any"):
        return Typed(F.length(x.col).cast("bigint"), "int")
    raise mistyped("size needs a list or a string")


def _list(x: Typed) -> Typed:
    if not is_list(x.t):
        raise mistyped("a list is needed")
    return x


def sliced(x: Column, low: Column, high: Column) -> Column:
    n = F.size(x)
    bound = lambda i: F.greatest(F.lit(0), F.least(n, F.when(i < 0, i + n).otherwise(i).cast("int")))
    a, b = bound(low), bound(high)
    return F.when(x.isNotNull() & low.isNotNull() & high.isNotNull(), F.slice(x, a + 1, F.greatest(b - a, F.lit(0))))


def element(x: Typed, i: Typed) -> Typed:
    n = F.size(x.col)
    return Typed(F.get(x.col, F.when(i.col < 0, i.col + n).otherwise(i.col).cast("int")), x.t[1])


def integer_range(a: Typed, b: Typed, step: Typed | None = None) -> Typed:
    if any(x.t not in ("int", "null") for x in (a, b, *([step] if step else []))):
        raise mistyped("range needs integers")
    s = step.col if step else F.lit(1).cast("bigint")
    checked = F.when(s == 0, F.raise_error(F.lit("NumberOutOfRange: step of range is 0")).cast("bigint")).otherwise(s)
    right = ((s > 0) & (a.col <= b.col)) | ((s < 0) & (a.col >= b.col)) | (s == 0)
    long_ = F.when(F.abs((b.col - a.col) / F.when(s != 0, s)) > 10_000_000, F.raise_error(F.lit("NumberOutOfRange: range is too long")).cast("bigint")).otherwise(b.col)
    return Typed(F.when(right, F.sequence(a.col.cast("bigint"), long_.cast("bigint"), checked)).otherwise(F.array().cast("array<bigint>")), ("list", "int"))


def _reverse(x: Typed) -> Typed:
    return Typed(F.reverse(x.col), x.t)


def _abs(x: Typed) -> Typed:
    return _number(F.abs, keep=True)(x)


def _keys(x: Typed) -> Typed:
    if not isinstance(x.t, tuple) or x.t[0] == "list":
        raise mistyped("keys needs a map, node or relationship")
    names = [F.when(x.col[k].isNotNull(), F.lit(k)) for k, _ in sorted(x.t[1])]
    found = F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")
    return Typed(F.when(x.col.isNotNull(), found), ("list", "str"))


def _properties(x: Typed) -> Typed:
    if not isinstance(x.t, tuple) or x.t[0] == "list":
        raise mistyped("properties needs a map, node or relationship")
    return Typed(F.when(x.col.isNotNull(), F.struct(*(x.col[k].alias(k) for k, _ in x.t[1]))), ("map", x.t[1]))


def _to_boolean(x: Typed) -> Typed:
    if x.t in NUMBERS:
        raise mistyped("toBoolean of a number")
    if x.t == "bool":
        return x
    low = F.lower(x.col.cast("string"))
    return Typed(F.when(low == "true", True).when(low == "false", False), "bool")


def _to_float(x: Typed) -> Typed:
    if x.t == "bool":
        raise mistyped("toFloat of a boolean")
    return Typed(F.when(x.col.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), x.col).try_cast("double") if x.t == "str" else x.col.cast("double"), "float")


def _coalesce(*args: Typed) -> Typed:
    t = args[0].t
    for a in args[1:]:
        t = joined(t, a.t)
    return Typed(F.coalesce(*(cast(a, t).col for a in args)), t)


def _whole(f) -> object:
    """``f``, which gives a bigint, on numbers that may have a fraction; larger ones, infinities and NaN stay."""

    def of(c: Column) -> Column:
        c = c.cast("double")
        return F.when(F.abs(c) < float(1 << 52), f(c).cast("double")).otherwise(c)

    return of


def _away(c: Column) -> Column:
    """The nearest whole number, halves away from zero: by the fraction, which is exact, and not by adding a half."""
    size = F.abs(c)
    low = F.floor(size)
    return F.signum(c) * (low + F.when(size - low >= 0.5, 1).otherwise(0))


SPACE = r"[\s\u0085   -     　]+"

#: name: (least arguments, most arguments, function)
FUNCTIONS: dict[str, tuple[int, int, object]] = {
    "tolower": (1, 1, _text(F.lower)), "toupper": (1, 1, _text(F.upper)),
    "tostring": (1, 1, lambda x: Typed(to_text(x), "str")), "toboolean": (1, 1, _to_boolean),
    "tointeger": (1, 1, lambda x: Typed(to_integer(x), "int")), "tofloat": (1, 1, _to_float),
    "keys": (1, 1, _keys), "properties": (1, 1, _properties), "exists": (1, 1, lambda x: Typed(x.col.isNotNull(), "bool")),
    "coalesce": (1, 99, _coalesce), "size": (1, 1, size),
    "head": (1, 1, lambda x: Typed(F.get(_list(x).col, F.lit(0)), x.t[1])),
    "last": (1, 1, lambda x: Typed(F.try_element_at(_list(x).col, F.lit(-1)), x.t[1])),
    "tail": (1, 1, lambda x: Typed(F.slice(_list(x).col, 2, F.greatest(F.size(x.col), F.lit(1))), x.t)),
    "reverse": (1, 1, _reverse), "range": (2, 3, integer_range),
    "abs": (1, 1, _abs), "sign": (1, 1, _number(lambda c: F.signum(c).cast("bigint"), "int")),
    "ceil": (1, 1, _number(_whole(F.ceil))), "floor": (1, 1, _number(_whole(F.floor))), "round": (1, 2, lambda x, _=None: _number(_whole(_away))(x)),
    "sqrt": (1, 1, _number(F.sqrt)), "exp": (1, 1, _number(F.exp)), "log": (1, 1, _number(_log(F.ln))), "log10": (1, 1, _number(_log(F.log10))),
    "e": (0, 0, lambda: Typed(F.e(), "float")), "pi": (0, 0, lambda: Typed(F.pi(), "float")), "rand": (0, 0, lambda: Typed(F.rand(), "float")),
    "substring": (2, 3, _text(lambda s, a, n=None: F.substring(s, a.cast("int") + 1, F.length(s) if n is None else n.cast("int")))),
    "replace": (3, 3, _text(F.replace)), "split": (2, 2, _text(lambda s, d: F.split(s, F.concat(F.lit("\\Q"), d, F.lit("\\E"))), ("list", "str"))),
    "left": (2, 2, _text(lambda s, n: F.left(s, n.cast("int")))), "right": (2, 2, _text(lambda s, n: F.right(s, n.cast("int")))),
    "trim": (1, 1, _text(lambda s: F.regexp_replace(s, f"^{SPACE}|{SPACE}$", ""))), "ltrim": (1, 1, _text(lambda s: F.regexp_replace(s, f"^{SPACE}", ""))), "rtrim": (1, 1, _text(lambda s: F.regexp_replace(s, f"{SPACE}$", ""))),
}
GRAPH_FUNCTIONS = {"id", "labels", "type", "nodes", "relationships", "length", "startnode", "endnode", "score"}
AGGREGATES = {"count", "sum", "avg", "min", "max", "collect", "percentilecont", "percentiledisc", "stdev", "stdevp"}


def call(name: str, args: list[Typed]) -> Typed:
    low = name.lower()
    if temporal.is_function(low):
        return temporal.call(low, args)
    if low not in FUNCTIONS:
        raise semantic("UnknownFunction", f"no function {name}", nearest(name, [*FUNCTIONS, *AGGREGATES, *GRAPH_FUNCTIONS]))
    least, most, f = FUNCTIONS[low]
    if not least <= len(args) <= most:
        raise semantic("InvalidNumberOfArguments", f"{name} takes {least} to {most} arguments, not {len(args)}")
    if args and args[0].t == "null" and low not in ("coalesce", "exists", "range"):
        return null()
    return f(*args)


def in_order(packed: Column, order: list[tuple[Column, bool]]) -> Column:
    """Structs with keys k0, k1, ... sorted: ascending with nulls last, descending with nulls first."""
    downs = [down for _, down in order]
    if not any(downs):
        return F.sort_array(packed)
    if all(downs):
        return F.reverse(F.sort_array(packed))

    def compare_(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for i, down in reversed(list(enumerate(downs))):
            x, y = a[f"k{i}"], b[f"k{i}"]
            less, more = (1, -1) if down else (-1, 1)
            out = F.when(x < y, less).when(x > y, more).otherwise(out)
        return out

    return F.array_sort(packed, compare_)


def of_nothing(name: str, t) -> Column:
    """What an aggregate gives for no rows."""
    from quiltgraph.sources.catalog import spark_type

    low = name.lower()
    if low in ("count*", "count", "sum", "stdev", "stdevp"):
        return F.lit(0).cast(spark_type(t))
    return F.array().cast(spark_type(t)) if low == "collect" else F.lit(None).cast(spark_type(t))


def aggregate(name: str, x: Typed | None, distinct: bool, extra: Typed | None, order: list[tuple[Column, bool]]) -> Typed:
    """An aggregate over a group; ``x`` is None for count(*). Percentiles, and deviations of DISTINCT, hold a group's (distinct) values in an array."""
    low = name.lower()
    if x is None:
        return Typed(F.count(F.lit(1)), "int")
    c = x.col["_id"] if isinstance(x.t, tuple) and x.t[0] in ("node", "rel") and low != "collect" else x.col
    if low == "count":
        return Typed(F.count_distinct(c) if distinct else F.count(c), "int")
    if low == "collect":
        if distinct:
            items = F.collect_set(c)
            return Typed(F.sort_array(items), ("list", x.t))
        if order:
            keys = [F.struct(k.isNull().alias("none"), k.alias("key")).alias(f"k{i}") for i, (k, _) in enumerate(order)]
            packed = in_order(F.collect_list(F.when(c.isNotNull(), F.struct(*keys, c.alias("x")))), order)
            return Typed(F.transform(packed, lambda s: s["x"]), ("list", x.t))
        return Typed(F.collect_list(c), ("list", x.t))
    if low in ("min", "max"):
        return Typed({"min": F.min, "max": F.max}[low](c), x.t)
    if x.t not in (*NUMBERS, "null", "any"):
        if low in ("sum", "avg") and x.t == "dur":
            raise mistyped("durations can't be summed")
        c = F.lit(None).cast("double")
    if low == "sum":
        t = "int" if x.t in ("int", "null") else "float"
        total = F.sum_distinct(c) if distinct else F.sum(c)
        return Typed(F.coalesce(total.cast("bigint" if t == "int" else "double"), F.lit(0).cast("bigint" if t == "int" else "double")), t)
    if low == "avg":
        return Typed((F.sum_distinct(c) / F.count_distinct(c) if distinct else F.avg(c)).cast("double"), "float")
    if low in ("stdev", "stdevp"):
        if distinct:
            items = F.transform(F.collect_set(c), lambda v: v.cast("double"))
            n = F.size(items)
            mean = F.aggregate(items, F.lit(0.0), lambda s, v: s + v) / n
            squares = F.aggregate(F.transform(items, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda s, v: s + v)
            return Typed(F.when(n > 1, F.sqrt(squares / (n - 1 if low == "stdev" else n))).otherwise(0.0), "float")
        return Typed(F.coalesce((F.stddev_samp if low == "stdev" else F.stddev_pop)(c), F.lit(0.0)), "float")
    if extra is None:
        raise semantic("InvalidNumberOfArguments", f"{name} takes 2 arguments")
    if not 0 <= _constant(extra) <= 1:
        raise QueryError("ArgumentError", "NumberOutOfRange", f"{name} takes a share from 0 to 1", "Runtime")
    if low == "percentilecont" and distinct:
        items = F.array_sort(F.collect_set(c))
        at = F.lit(_constant(extra)) * (F.size(items) - 1)
        a, b = (F.get(items, f(at).cast("int")).cast("double") for f in (F.floor, F.ceil))
        return Typed(a + (b - a) * (at - F.floor(at)), "float")
    if low == "percentilecont":
        return Typed(F.percentile(c, extra.col), "float")
    items = F.array_sort(F.collect_set(c) if distinct else F.collect_list(c))
    at = F.floor(F.lit(_constant(extra)) * (F.size(items) - 1) + 0.5).cast("int")
    return Typed(F.get(items, at).cast("double"), "float")


def _constant(x: Typed) -> float:
    found = re.fullmatch(r"Column<'(.*)'>", str(x.col))
    try:
        return float(found[1])
    except (TypeError, ValueError):
        raise semantic("InvalidArgumentType", "a constant is needed") from None
