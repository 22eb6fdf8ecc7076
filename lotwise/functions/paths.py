"""The declarative field map: dot paths, wildcards, templates and predicates, compiled to columns over JSON text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Predicates that a missing path satisfies.
ABSENT_OK = ("ne", "nin")


def json_path(path: str) -> str:
    """a.b.0 -> $.a.b[0]; a[*].b and a.*.b stay wildcards."""
    out = "$"
    for part in path.replace("[*]", ".*").split("."):
        out += "[*]" if part == "*" else f"[{part}]" if part.isdigit() else f".{part}" if part else ""
    return out


def at_path(json: Column, path: str) -> Column:
    """The scalar or the JSON text at a path; null where the path ends."""
    return F.get_json_object(json, json_path(path))


def values_at(json: Column, path: str) -> Column:
    """All values of a path with a wildcard, as array<string>; a single match is one value, none an empty array."""
    got = at_path(json, path)
    many = F.from_json(got, "array<string>", {"mode": "PERMISSIVE"})
    return F.when(got.isNull(), F.array().cast("array<string>")).when(got.startswith("["), many).otherwise(F.array(got))


def compare(value: Column, op: str, wanted) -> Column:
    """One scalar against one wanted value or list; ordered comparisons are of numbers, and false where there is none."""
    if op in ("in", "nin"):
        hit = F.coalesce(value.isin(*[str(w) for w in wanted]), F.lit(False))
        return hit if op == "in" else ~hit
    if op in ("eq", "ne"):
        hit = value.eqNullSafe(F.lit(None if wanted is None else str(wanted)))
        return hit if op == "eq" else ~hit
    number = value.try_cast("double")
    result = {"gt": number > float(wanted), "gte": number >= float(wanted), "lt": number < float(wanted), "lte": number <= float(wanted)}[op]
    return F.coalesce(result, F.lit(False))


def predicate(json: Column, path: str, wanted) -> Column:
    """A path against a scalar (equality) or {op: value}; a wildcard path holds if any of its values does."""
    tests = wanted if isinstance(wanted, dict) else {"eq": wanted}
    wild = "*" in path

    def one(op, w):
        if wild:
            values = values_at(json, path)
            return F.when(F.size(values) == 0, F.lit(op in ABSENT_OK)).otherwise(F.exists(values, lambda x: compare(x, op, w)))
        value = at_path(json, path)
        return F.when(value.isNull(), F.lit(op in ABSENT_OK)).otherwise(compare(value, op, w))

    return reduce(lambda a, b: a & b, [one(op, w) for op, w in tests.items()])


def item_filter(json: Column, spec: dict) -> Column:
    """The conjunction of path predicates; true for an empty one."""
    return reduce(lambda a, b: a & b, [predicate(json, p, w) for p, w in spec.items()], F.lit(True))


def template(json: Column, spec: str) -> Column:
    """Text with {path} places; '' if nothing but separators is left."""
    parts, rest = [], spec
    while "{" in rest:
        before, _, rest = rest.partition("{")
        path, _, rest = rest.partition("}")
        parts += [F.lit(before), F.coalesce(at_path(json, path), F.lit(""))]
    out = F.concat(*parts, F.lit(rest))
    return F.when(F.regexp_replace(out, r"[\s\-–—/|,.:;()]+", "") == "", "").otherwise(F.trim(out))


def sum_over(json: Column, array: str, quantity: str, price: str) -> Column:
    """The sum of quantity times price over an array's items; null unless positive."""
    items = F.from_json(at_path(json, array), f"array<struct<`{quantity}`:double,`{price}`:double>>")
    total = F.aggregate(items, F.lit(0.0), lambda a, x: a + F.coalesce(x[quantity], F.lit(0.0)) * F.coalesce(x[price], F.lit(0.0)))
    return F.when(total > 0, total)
