"""A JSON object in free text: fenced, between braces, or the first that is balanced."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCED = r"(?i)```(?:json)?\s*([\s\S]*?)```"


def strict_json(text: Column) -> Column:
    """A text that is one JSON value as VARIANT; null where it is none or something follows it.

    Spark's parser stops behind the first value, so the text is put between two marks in an
    array, and both must come back."""
    mark = uuid.uuid4().hex
    whole = F.try_variant_get(F.try_parse_json(F.concat(F.lit(f'["{mark}",'), text, F.lit(f',"{mark}"]'))), "$", "array<variant>")
    edge = lambda v: F.coalesce(F.try_variant_get(v, "$", "string") == mark, F.lit(False))
    return F.transform(F.array(whole), lambda a: F.when((F.size(a) == 3) & edge(a[0]) & edge(a[2]), a[1]))[0]


def balanced(text: Column) -> Column:
    """From the first opening brace outside a text to the one that closes it; null where none
    does. A fold over the pieces between braces and quotes: braces in strings don't count, and
    a quote behind an odd number of backslashes doesn't end its string."""
    pieces = F.split(text, r'(?<=[{}"])|(?=[{}"])', -1)
    no, none = F.lit(False), F.lit(0)
    start = F.struct(none.alias("at"), none.alias("depth"), no.alias("quoted"), no.alias("escaped"), none.alias("first"), none.alias("last"))

    def step(s, x):
        done, inside = s["last"] > 0, s["depth"] > 0
        quote = (x == '"') & inside & ~(s["quoted"] & s["escaped"]) & ~done
        opens, closes = (x == "{") & ~s["quoted"] & ~done, (x == "}") & ~s["quoted"] & inside & ~done
        depth = s["depth"] + opens.cast("int") - closes.cast("int")
        return F.struct(
            (s["at"] + F.length(x)).alias("at"), depth.alias("depth"), F.when(quote, ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"), x.rlike(r"(?<!\\)(?:\\\\)*\\$").alias("escaped"),
            F.when(opens & ~inside, s["at"] + 1).otherwise(s["first"]).alias("first"), F.when(closes & (depth == 0), s["at"] + 1).otherwise(s["last"]).alias("last"),
        )

    return F.transform(F.array(F.aggregate(pieces, start, step)), lambda s: F.when(s["last"] > 0, F.substring(text, s["first"], s["last"] - s["first"] + 1)))[0]


def json_object(text: Column) -> Column:
    """(json, source): the object that a text holds, and where it was found.

    What stands in the first fence is taken where there is one, else all from the first
    opening brace to the last closing one. Where that is no JSON, the first balanced object is
    ("balanced"); where that is none either, both are null."""
    fenced = F.try_element_at(F.regexp_extract_all(text, F.lit(FENCED), F.lit(1)), F.lit(1))
    braces = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    valid = lambda x: strict_json(x).isNotNull()
    first = F.coalesce(fenced, braces)
    found = F.struct(first.alias("first"), balanced(text).alias("rest"))
    return F.transform(F.array(found), lambda f: F.when(valid(f["first"]), F.struct(f["first"].alias("json"), F.when(fenced.isNotNull(), "fenced").otherwise("braces").alias("source"))).when(valid(f["rest"]), F.struct(f["rest"].alias("json"), F.lit("balanced").alias("source"))))[0]
