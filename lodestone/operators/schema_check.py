"""Checks of nested JSON rows against a schema: one row for each violation, with its path.

The schema, a configuration of bounded size, becomes one expression: a row is parsed once to
VARIANT, its values are judged where they stand, and only violations become rows. So rows are
neither shuffled nor written, and a value that no rule names is not looked at.

Keywords: const, enum, type (object, array, string, integer, number, boolean), required,
additionalProperties, properties, items, minItems, maxItems, minLength, maxLength, pattern,
minimum, maximum. A value of another type than an object, array or string that is asked for
has that violation alone. Lengths count UTF-16 units.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.json_text import strict_json


def _literal(value) -> str:
    """A JSON value that is no object or array, in the form in which values are compared."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return f"boolean:{str(value).lower()}"
    if isinstance(value, int | float):
        return f"number:{float(value)}"
    return f"string:{value}" if isinstance(value, str) else "nested:"


def _kind(name: Column) -> Column:
    """object, array, string, number, boolean or null by the schema of a VARIANT."""
    return (
        F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean")
        .when(name == "VOID", "null").otherwise("number")
    )


def _let(value: Column, then) -> Column:
    """`then(value)`, an array, with the value computed once."""
    return F.flatten(F.transform(F.array(value), then))


def _plain(v: Column, kind: Column) -> Column:
    """A value in the form in which values are compared."""
    text = F.try_variant_get(v, "$", "string")
    return (
        F.when(kind == "null", "null").when(kind == "boolean", F.concat(F.lit("boolean:"), text)).when(kind == "number", F.concat(F.lit("number:"), F.try_variant_get(v, "$", "double").cast("string")))
        .when(kind == "string", F.concat(F.lit("string:"), text)).otherwise("nested:")
    )


def _none() -> Column:
    return F.array().cast("array<struct<path string, code string>>")


def _flaw(path: Column, code: str) -> Column:
    return F.struct(path.alias("path"), F.lit(code).alias("code"))


def _flaws(path: Column, *rules: tuple[str, Column]) -> Column:
    """The codes of the rules that hold, at one path."""
    return F.array_compact(F.array(*(F.when(when, _flaw(path, code)) for code, when in rules))) if rules else _none()


def _joined(*parts: Column | None) -> Column:
    some = [p for p in parts if p is not None]
    return _none() if not some else some[0] if len(some) == 1 else F.concat(*some)


def _fixed(s: dict, plain: Column) -> list[tuple[str, Column]]:
    """const and enum of a value in the form of `_plain`; an object or array equals none."""
    out = [("const", (plain != _literal(s["const"])) | (plain == "nested:"))] if "const" in s else []
    return out + ([("enum", ~plain.isin([_literal(x) for x in s["enum"]]) | (plain == "nested:"))] if "enum" in s else [])


def _object(keys: Column, path: Column, s: dict) -> Column:
    """What is wrong with an object by its rule, its children aside."""
    missing = [F.when(~F.array_contains(keys, name), _flaw(F.concat(path, F.lit(f".{name}")), "missing")) for name in dict.fromkeys(s.get("required", []))]
    known = F.array(*map(F.lit, s.get("properties", {}))).cast("array<string>")
    unexpected = F.transform(F.array_except(keys, known), lambda k: _flaw(F.concat(path, F.lit("."), k), "unexpected")) if s.get("additionalProperties") is False else None
    return _joined(_flaws(path, *_fixed(s, F.lit("nested:"))), F.array_compact(F.array(*missing)) if missing else None, unexpected)


def _array(n: Column, path: Column, s: dict) -> Column:
    bounds = [("too_few", n < s["minItems"])] if s.get("minItems") is not None else []
    bounds += [("too_many", n > s["maxItems"])] if s.get("maxItems") is not None else []
    return _flaws(path, *_fixed(s, F.lit("nested:")), *bounds)


def _string(text: Column, path: Column, s: dict) -> Column:
    units = F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))
    bounds = [("too_short", units < s["minLength"])] if s.get("minLength") is not None else []
    bounds += [("too_long", units > s["maxLength"])] if s.get("maxLength") is not None else []
    bounds += [("pattern", ~text.rlike(s["pattern"]))] if s.get("pattern") is not None else []
    return _flaws(path, *_fixed(s, F.concat(F.lit("string:"), text)), *bounds)


def _scalar(v: Column, kind: Column, path: Column, s: dict) -> Column:
    """What is wrong with a value whose rule asks for a number, a boolean or no type."""
    number, is_number = F.try_variant_get(v, "$", "double"), kind == "number"
    of = {"integer": ("not_integer", ~(is_number & F.coalesce(number == F.floor(number), F.lit(False)))), "number": ("not_number", ~is_number), "boolean": ("not_boolean", kind != "boolean")}
    bounds = [("below_minimum", is_number & (number < float(s["minimum"])))] if s.get("minimum") is not None else []
    bounds += [("above_maximum", is_number & (number > float(s["maximum"])))] if s.get("maximum") is not None else []
    return _flaws(path, *_fixed(s, _plain(v, kind)), *([of[s["type"]]] if s.get("type") in of else []), *bounds)


def _judged(v: Column, path: Column, s: dict) -> Column:
    """(path, code) of all that is wrong with a value and the values in it, by a schema."""
    kind, children, items = s.get("type"), s.get("properties", {}), s.get("items")

    def member(m: Column, name: str, child: dict) -> Column:
        # Looked up anew where it is used: each binding more makes the plan slower to analyse.
        x = F.try_element_at(m, F.lit(name))
        return F.when(x.isNotNull(), _judged(x, F.concat(path, F.lit(f".{name}")), child)).otherwise(_none())

    def in_object(m: Column) -> Column:
        below = [member(m, name, child) for name, child in children.items()]
        own = _object(F.map_keys(m), path, s) if kind == "object" else None
        return F.when(m.isNull(), _flaws(path, ("not_object", F.lit(True))) if kind == "object" else _none()).otherwise(_joined(own, *below))

    def in_array(a: Column) -> Column:
        below = F.flatten(F.transform(a, lambda x, i: _judged(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), items))) if items is not None else None
        own = _array(F.size(a), path, s) if kind == "array" else None
        return F.when(a.isNull(), _flaws(path, ("not_array", F.lit(True))) if kind == "array" else _none()).otherwise(_joined(own, below))

    # Values of other types have no such map or array.
    parts = [_let(F.try_variant_get(v, "$", "map<string,variant>"), in_object)] if kind == "object" or children else []
    parts += [_let(F.try_variant_get(v, "$", "array<variant>"), in_array)] if kind == "array" or items is not None else []
    if kind == "string":
        text = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
        parts.append(_let(text, lambda t: F.when(t.isNull(), _flaws(path, ("not_string", F.lit(True)))).otherwise(_string(t, path, s))))
    elif kind not in ("object", "array"):
        parts.append(_let(F.schema_of_variant(v), lambda name: _scalar(v, _kind(name), path, s)))
    return _joined(*parts)


def violations(rows: DataFrame, schema: dict, root: str = "input") -> DataFrame:
    """id, path, code of what is wrong with rows (id, json) by a schema.

    A text that isn't one JSON value has the one violation invalid_json; a null text is one, too. Rows
    that are repeated are judged each time; an empty table gives no rows. Of two values of one
    key in an object, the text is invalid.
    """
    path = F.lit(root)
    parsed, v = rows.select("id", strict_json(F.col("json")).alias("v")), F.col("v")
    found = F.when(v.isNull(), _flaws(path, ("invalid_json", F.lit(True)))).otherwise(_judged(v, path, schema))
    # The outer form, as Spark would compute the array once more, in a filter, for the other.
    return parsed.select("id", F.inline_outer(found)).where("code IS NOT NULL")


def load(text: str) -> dict:
    """A schema from its JSON text."""
    return json.loads(text)
