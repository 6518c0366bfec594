"""Ad-hoc predicates over semi-structured rows, as column expressions over a VARIANT column.

A filter is a nested dict as document databases take it: {path: value}, {path: {operator: value, ...}}, and "and", "or",
"nor" with lists of filters. A leading "$" of a name is optional. Everything becomes one boolean column without Python
code, which is never null:

* A dotted path goes through arrays: it reaches the field in each element, and the array itself. A path that reaches
  nothing is missing. A stored null is there: it has a type, and `exists` finds it.
* `eq` holds when a reached value, or an element of a reached array, is the literal; None is a stored null or a missing
  path. `gt`, `gte`, `lt`, `lte` compare numbers with numbers and strings with strings only.
* `ne`, `nin` and `not` are the negations of `eq`, `in` and of their operators, so they hold for missing paths.
* `all`, `size` and `elem_match` are about arrays (`all` takes a single value too); `regex` reads strings.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

_NUMBER = (int, float)
_COMPARE = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def kind(value: Column) -> Column:
    """object, array, string, bool, null or number; null where there is no value."""
    shape = F.schema_of_variant(value)
    return (F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape == "STRING", "string")
            .when(shape == "BOOLEAN", "bool").when(shape == "VOID", "null").when(shape.isNotNull(), "number"))


class _At:
    """A value at a place in a VARIANT, read as the type that a test needs without a copy of the value itself."""

    def __init__(self, base: Column, key: str | None = None):
        if key is not None and not re.fullmatch(r"[^'\"\]\[]+", key):
            raise ValueError(f"not a field name: {key!r}")
        self.base, self.place = base, "$" if key is None else f"$['{key}']"

    def get(self, as_type: str) -> Column:
        return F.try_variant_get(self.base, self.place, as_type)

    def value(self) -> Column:
        return self.base if self.place == "$" else self.get("variant")

    def members(self) -> Column:
        """An array's elements without their contents, for its length; null for anything else."""
        return self.get("array<struct<_:boolean>>")

    def is_object(self) -> Column:
        return self.get("struct<_:boolean>").isNotNull()

    def elements(self) -> Column:
        """Elements of an array; none of anything else."""
        return F.coalesce(self.get("array<variant>"), _none())

    def is_kind(self, wanted: str) -> Column:
        if wanted == "object":
            return self.is_object()
        if wanted == "array":
            return self.members().isNotNull()
        return F.is_variant_null(self.value()) if wanted == "null" else F.coalesce(kind(self.value()) == wanted, F.lit(False))


def _let(value: Column, make) -> Column:
    """make(value), with the value computed once a row however often `make` names it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _none() -> Column:
    return F.array().cast("array<variant>")


def _field(value: Column, key: str) -> Column:
    return _At(value, key).get("variant")


class _Paths:
    """The values that paths reach, and the same opened; what more than one test or path needs is named once. In a known
    object a path of one name reaches its field or nothing: that is read in its place, without arrays of values."""

    def __init__(self, document: Column, known_object: bool = False):
        self.document, self.known = document, known_object
        self.values = {"": F.array(document) if known_object else F.when(document.isNotNull(), F.array(document)).otherwise(_none())}
        self.opened = {"": self.values[""]} if known_object else {}

    def single(self, path: str) -> _At | None:
        return _At(self.document, path) if self.known and path and "." not in path else None

    def reached(self, path: str) -> Column:
        if path in self.values:
            return self.values[path]
        parent, _, key = path.rpartition(".")
        if key.isdigit():
            found = F.flatten(F.transform(self.reached(parent), lambda v: F.concat(
                F.array(_field(v, key), F.try_variant_get(v, f"$[{int(key)}]", "variant")), F.transform(_At(v).elements(), lambda e: _field(e, key)))))
        else:
            found = F.array(_field(self.document, path)) if self.single(path) else F.transform(self.open(parent), lambda v: _field(v, key))
        return F.filter(found, lambda x: x.isNotNull())

    def open(self, path: str) -> Column:
        """The values, with the elements of an array in its place."""
        if path in self.opened:
            return self.opened[path]
        if one := self.single(path):
            return F.coalesce(one.get("array<variant>"), F.array(one.value()))
        return F.flatten(F.transform(self.reached(path), lambda v: F.coalesce(_At(v).get("array<variant>"), F.array(v))))

    def there(self, path: str) -> Column:
        one = self.single(path)
        return one.value().isNotNull() if one else F.size(self.reached(path)) > 0

    def any_value(self, path: str, test) -> Column:
        """A value passes; arrays are values."""
        one = self.single(path)
        return test(one) if one else F.exists(self.reached(path), lambda v: test(_At(v)))

    def any_opened(self, path: str, test) -> Column:
        """A value that is no array, or an element of an array, passes."""
        one = self.single(path)
        if one and path not in self.opened:
            return test(one) | F.coalesce(F.exists(one.get("array<variant>"), lambda v: test(_At(v))), F.lit(False))
        return F.exists(self.open(path), lambda v: test(_At(v)))

    def any_element(self, path: str, test) -> Column:
        one = self.single(path)
        if one and path in self.opened:
            return one.members().isNotNull() & F.exists(self.opened[path], test)
        return self.any_value(path, lambda v: F.exists(v.elements(), test))

    def share(self, names: list[tuple[str, str]], make) -> Column:
        """make(), with the named (values or opened, path) computed once a row."""
        if not names:
            return make()
        (what, path), *rest = names
        if what == "values" and self.single(path):
            return self.share(rest, make)
        held = getattr(self, what)

        def inner(column: Column) -> Column:
            held[path] = column
            return self.share(rest, make)

        return _let(self.reached(path) if what == "values" else self.open(path), inner)


def reached(document: Column, path: str) -> Column:
    """All values that the dotted path reaches; array<variant>. A number in a path is also an index."""
    return _Paths(document).reached(path)


def _is(value: _At, literal) -> Column:
    """A single value is the literal, with its type."""
    if literal is None:
        return F.is_variant_null(value.value())
    return _typed(value, literal, Column.__eq__)


def _typed(value: _At, literal, compare) -> Column:
    shape = F.schema_of_variant(value.value())
    if isinstance(literal, bool):
        same, as_type = shape == "BOOLEAN", "boolean"
    elif isinstance(literal, _NUMBER):
        # doubles order all numbers rightly against an integer below 2 ** 53; arrays and objects have no number
        same, as_type = ~shape.isin("STRING", "BOOLEAN"), "double" if isinstance(literal, float) or abs(literal) < 1 << 53 else "decimal(38, 0)"
    elif isinstance(literal, str):
        same, as_type = shape == "STRING", "string"
    else:
        raise TypeError(f"no comparison with {type(literal).__name__}")
    # values are cast, a string of digits to a number too; the dearer look at the type is taken only where the cast fits
    return F.when(compare(value.get(as_type), F.lit(literal)), same).otherwise(F.lit(False))


def _operator(paths: _Paths, path: str, name: str, wanted, options: str) -> Column:
    """One operator on what a path reaches. An array is no literal, so values are compared opened: the value itself, or
    the elements of an array."""
    if name == "eq":
        found = paths.any_opened(path, lambda v: _is(v, wanted))
        return found | ~paths.there(path) if wanted is None else found
    if name == "ne":
        return ~_operator(paths, path, "eq", wanted, options)
    if name == "in":
        found = paths.any_opened(path, lambda v: _any([_is(v, w) for w in wanted]))
        return found | ~paths.there(path) if any(w is None for w in wanted) else found
    if name == "nin":
        return ~_operator(paths, path, "in", wanted, options)
    if name in _COMPARE:
        return paths.any_opened(path, lambda v: _typed(v, wanted, _COMPARE[name]))
    if name == "exists":
        return paths.there(path) if wanted else ~paths.there(path)
    if name == "type":
        own = paths.any_value(path, lambda v: v.members().isNotNull()) if wanted == "array" else F.lit(False)
        return own | paths.any_opened(path, lambda v: v.is_kind(wanted))
    if name == "regex":
        pattern = f"(?{options}){wanted}" if options else wanted
        return paths.any_opened(path, lambda v: F.when(v.get("string").rlike(pattern), F.schema_of_variant(v.value()) == "STRING").otherwise(F.lit(False)))
    if name == "size":
        return paths.any_value(path, lambda v: F.coalesce(F.size(v.members()) == wanted, F.lit(False)))
    if name == "all":
        return _all([_operator(paths, path, "eq", w, options) for w in wanted]) if wanted else F.lit(False)
    if name == "elem_match":
        return paths.any_element(path, lambda e: _element(e, wanted))
    if name == "not":
        return ~_tests(paths, path, wanted)
    raise ValueError(f"no such operator: {name}")


def _needs(name: str, wanted) -> list[str]:
    """What an operator reads of its path, as often as it reads it: values, opened."""
    if name in ("ne", "nin"):
        name = name.replace("n", "", 1) if name == "nin" else "eq"
    if name in ("exists", "size"):
        return ["values"]
    if name == "elem_match":
        return ["values", "opened"]
    if name == "not":
        return [x for k, v in _named(wanted).items() for x in _needs(k, v)]
    if name == "all":
        return [x for w in wanted for x in _needs("eq", w)]
    empty = (name == "eq" and wanted is None) or (name == "in" and any(w is None for w in wanted)) or (name == "type" and wanted == "array")
    return ["values", "opened"] if empty else [] if name == "options" else ["opened"]


def _name(key: str) -> str:
    name = key.removeprefix("$")
    return {"elemMatch": "elem_match"}.get(name, name)


_NAMES = {"eq", "ne", "in", "nin", *_COMPARE, "exists", "type", "regex", "options", "size", "all", "elem_match", "not"}


def _is_tests(value) -> bool:
    return isinstance(value, dict) and bool(value) and all(_name(k) in _NAMES for k in value)


def _named(wanted) -> dict:
    """Operators of one path by name; a bare literal is `eq`."""
    if not isinstance(wanted, dict):
        return {"eq": wanted}
    if not _is_tests(wanted):
        raise ValueError(f"no operators: {sorted(wanted)}")
    return {_name(k): v for k, v in wanted.items()}


def _tests(paths: _Paths, path: str, wanted) -> Column:
    """All operators of one path."""
    named = _named(wanted)
    options = named.pop("options", "")
    return _all([_operator(paths, path, k, v, options) for k, v in named.items()])


def _element(element: Column, wanted: dict) -> Column:
    """One element passes: operators are about the element itself, anything else is a filter of its fields."""
    if _is_tests(wanted):
        paths = _Paths(element)
        return _tests(paths, "", wanted)
    return _At(element).is_object() & _matches(element, wanted, True)


def _joins(key: str, value) -> bool:
    return _name(key) in ("and", "or", "nor") and isinstance(value, list)


def _leaves(wanted: dict) -> list[tuple[str, object]]:
    """(path, tests) of a filter, at any depth of and, or and nor."""
    return [x for k, v in wanted.items() for x in ([y for w in v for y in _leaves(w)] if _joins(k, v) else [(k, v)])]


def _shared(filters: list[dict]) -> list[tuple[str, str]]:
    """(values or opened, path) that are read more than once, parents first."""
    leaves = [x for w in filters for x in _leaves(w)]
    reads = Counter((what, path) for path, tests in leaves for k, v in _named(tests).items() for what in _needs(k, v))
    parts = {".".join(path.split(".")[:n + 1]) for path, _ in leaves for n in range(path.count(".") + 1)}
    order = sorted({"", *parts}, key=lambda p: (p.count(".") + bool(p), p), reverse=True)
    shared = []
    for path in order:  # children first: whether they are shared decides how often they read their parent
        if path and (often := reads["opened", path]) > 1:
            shared.append(("opened", path))
        if path:
            reads["values", path] += min(often, 1) if often > 1 else often
        if path and reads["values", path] > 1:
            shared.append(("values", path))
        if path:
            own = 1 if reads["values", path] > 1 else reads["values", path]
            parent, _, key = path.rpartition(".")
            reads["values" if key.isdigit() else "opened", parent] += own
        elif reads["opened", ""] > 1:
            shared.append(("opened", ""))
    return shared[::-1]


def _passes(paths: _Paths, wanted: dict) -> Column:
    parts = []
    for key, value in wanted.items():
        if _joins(key, value):
            name, each = _name(key), [_passes(paths, w) for w in value]
            parts.append(_all(each) if name == "and" else _any(each) if name == "or" else ~_any(each))
        else:
            parts.append(_tests(paths, key, value))
    return _all(parts)


def _matches(document: Column, wanted: dict, known_object: bool) -> Column:
    paths = _Paths(document, known_object)
    return paths.share(_shared([wanted]), lambda: _passes(paths, wanted))


def matches(document: Column, wanted: dict) -> Column:
    """Whether the document passes the filter; an empty filter passes all, a null document has no fields."""
    return F.when(_At(document).is_object(), _matches(document, wanted, True)).otherwise(_matches(document, wanted, False))


def passing(document: Column, filters: dict[str, dict]) -> Column:
    """Names of the filters that the document passes; array<string>. What filters read of a document is looked up once."""
    def names(known_object: bool) -> Column:
        paths = _Paths(document, known_object)
        return paths.share(_shared(list(filters.values())), lambda: F.array_compact(F.array(
            *[F.when(_passes(paths, w), F.lit(n)) for n, w in filters.items()])))

    return F.when(_At(document).is_object(), names(True)).otherwise(names(False))


def find(df: DataFrame, document: str, wanted: dict, order: list[Column] = (), skip: int = 0, limit: int | None = 100) -> DataFrame:
    """The rows whose document passes the filter, in the given order, `limit` of them after `skip`; all with None. One row
    is limit=1, and a count is find(..., limit=None).count()."""
    rows = df.filter(matches(F.col(document), wanted))
    if order:
        rows = rows.orderBy(*order)
    if skip:
        rows = rows.offset(skip)
    return rows if limit is None else rows.limit(limit)


def project(document: Column, paths: list[str]) -> list[Column]:
    """Columns named by the paths: the value that the path reaches as text, a list of several as JSON, null if none."""
    out = []
    for path in paths:
        values = reached(document, path)
        text = F.transform(values, lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))
        out.append(F.when(F.size(values) == 1, F.get(text, F.lit(0))).when(F.size(values) > 1, F.to_json(text)).alias(path))
    return out
