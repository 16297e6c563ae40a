"""Wiki pages as files: front matter, canonical form, templates, headings, related links.

Front matter is the flat subset of YAML that pages use: scalars, quoted strings, inline and
dashed lists. A block that holds anything else does not parse.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.index import EXTRA, RELATED, TYPES

_BLOCK_TEXT = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?"
_BLOCK = re.compile(_BLOCK_TEXT)
#: The marks around the managed list of related pages.
START, END = "<!-- llm-wiki:related:start -->", "<!-- llm-wiki:related:end -->"
#: Older names of fields.
LEGACY = {"created": "date_created", "updated": "date_modified", "url": "external_url", "raw_path": "raw_note"}
_CONSUMED = ["schema_version", "type", "title", "tldr", "status", "created", "updated", "date_created", "date_modified", "tags", "related", "explored", "external_url", "raw_note", "source_type", "author", "url", "raw_path", "raw_hash", "sources", "conflicts", "output_type"]
_FIELD = "struct<list boolean, items array<string>>"


_KEY = re.compile(r"([^\s#:-][^:\n]*):(?:[ \t]+(.*)|[ \t]*)$")
_ITEM = re.compile(r"\s*-(\s*)(.*)$")
_QUOTED = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'"
_PART = re.compile(rf"\s*({_QUOTED}|[^,\"'\s][^,]*|)\s*(?:,|$)")
_SCALAR = re.compile(rf"({_QUOTED})\s*(?:#.*)?$")
_COMMENT = re.compile(r"(?:^|\s+)#.*$")


def _unquote(x: str) -> str:
    if len(x) > 1 and x[0] == x[-1] == '"':
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], x[1:-1])
    return x[1:-1].replace("''", "'") if len(x) > 1 and x[0] == x[-1] == "'" else x


def _scalar(x: str) -> str | None:
    """A plain or quoted scalar without a comment behind it; null where text follows a quote."""
    if x[:1] in ("'", '"'):
        found = _SCALAR.match(x)
        return _unquote(found[1]) if found else None
    return _COMMENT.sub("", x)


def _inline(x: str) -> list[str] | None:
    """The items of an inline list; null where it doesn't end or an item is in no subset."""
    found = re.match(rf"\[((?:{_QUOTED}|[^\]\"'])*)\]\s*(?:#.*)?$", x)
    if not found:
        return None
    items, at = [], 0
    while at < len(found[1]):
        part = _PART.match(found[1], at)
        if not part:
            return None
        if part[1].strip():
            items.append(_unquote(part[1].strip()))
        at = max(part.end(), at + 1)
    return items


def _read_line(line: str) -> tuple | None:
    """What a line is by itself: (None, dash without a blank, text) of a list item, or (name, is
    an inline list, value) of a field, where the value is None, (is a list, texts) or _BAD. No
    tuple for blank lines and comments; the name is _BAD where a line is neither."""
    line = line.rstrip()
    if not line or line.lstrip().startswith("#"):
        return None
    item = _ITEM.match(line)
    if item:
        return None, not item[1] and bool(item[2]), _scalar(item[2])
    key = _KEY.match(line)
    if not key:
        return _BAD, False, None
    name, value = _unquote(key[1].strip()), (key[2] or "").strip()
    if value.startswith("["):
        items = _inline(value)
        return name, True, _BAD if items is None else (True, tuple(items))
    if value[:1] not in ("'", '"') and _COMMENT.sub("", value) in ("", "~", "null"):
        return name, False, None
    text = None if value[0] in "{|>&*" else _scalar(value)
    return name, False, _BAD if text is None else (False, (text,))


#: Stands for what is in no subset; most short lines are those of other pages, so they are read once.
_BAD = object()
_short_line = lru_cache(4096)(_read_line)


def read_block(block: str) -> tuple[dict | None, bool]:
    """(name -> None or (is a list, texts), repaired) of a front matter block; no fields where
    it is not in the subset."""
    fields: dict = {}
    repaired, name, inline = False, None, set()
    for line in block.split("\n"):
        found = _short_line(line) if len(line) <= 64 else _read_line(line)
        if found is None:
            continue
        if found[0] is None:
            if name is None:
                return None, repaired
            if fields[name] is None:
                fields[name] = (True, [])
            if not fields[name][0] or name in inline:
                return None, repaired
            repaired |= found[1]
            if found[2] is None:
                return None, repaired
            fields[name][1].append(found[2])
            continue
        name = found[0]
        if name is _BAD or name in fields or found[2] is _BAD:
            return None, repaired
        fields[name] = found[2] and (found[2][0], list(found[2][1]))
        if found[1]:
            inline.add(name)
    return fields or None, repaired


def with_front_matter(rows: DataFrame, name: str) -> DataFrame:
    """`rows` with a struct: fields, body and repaired of a page's content, and whether it has a `block`. Fields is
    null where there is no block or it does not parse; a list item without the blank behind its
    dash is read and counts as repaired.

    Where the block ends is found by an expression, so only blocks go to Python, in Arrow
    batches, and flat lists come back; as one expression the reading of a block would be too
    large for the optimizer."""

    def read(blocks: pa.Array) -> pa.Array:
        names, lists, items, repairs = [], [], [], []
        for block in blocks.to_pylist():
            fields, repaired = read_block(block.replace("\r\n", "\n")) if block else (None, False)
            names.append(None if fields is None else list(fields))
            lists.append(None if fields is None else [v and v[0] for v in fields.values()])
            items.append(None if fields is None else [v and v[1] for v in fields.values()])
            repairs.append(repaired)
        texts = pa.list_(pa.string())
        columns = [pa.array(names, texts), pa.array(lists, pa.list_(pa.bool_())), pa.array(items, pa.list_(texts)), pa.array(repairs, pa.bool_())]
        return pa.StructArray.from_arrays(columns, names=["names", "list", "items", "repaired"])

    read.__annotations__ = {"blocks": pa.Array, "return": pa.Array}
    # As a deterministic function it would be run again for each filter that is pushed below what it
    # gives; as another one, it is a column of its own, which is read more than once.
    content, found = F.col("content"), F.col("_found")
    whole = F.regexp_extract(content, _BLOCK_TEXT, 0)
    reader = F.arrow_udf(read, "names array<string>, list array<boolean>, items array<array<string>>, repaired boolean").asNondeterministic()
    read_rows = rows.withColumn("_found", reader(F.regexp_extract(content, _BLOCK_TEXT, 1)))
    values = F.transform(F.arrays_zip(found["list"], found["items"]), lambda x: F.when(x["list"].isNotNull(), F.struct(x["list"].alias("list"), x["items"].alias("items"))))
    body = F.substring(content, F.length(whole) + 1, F.lit(1 << 30))
    made = F.struct(
        F.map_from_arrays(found["names"], values).alias("fields"), body.alias("body"), found["repaired"].alias("repaired"), F.coalesce(F.regexp_extract(content, _BLOCK_TEXT, 1) != "", F.lit(False)).alias("block")
    )
    return read_rows.withColumn(name, made).drop("_found")


def scalar(fields: Column, name: str) -> Column:
    """A field as text; null where it is absent or null."""
    field = F.try_element_at(fields, F.lit(name))
    return F.when(field["list"], F.array_join(field["items"], ",")).otherwise(field["items"][0])


def strings(fields: Column, name: str) -> Column:
    """A field as a list of texts that are not empty."""
    field = F.try_element_at(fields, F.lit(name))
    one = F.filter(F.array(F.trim(field["items"][0])), lambda x: x != "")
    return F.coalesce(F.when(field["list"], F.filter(field["items"], lambda x: x != "")).otherwise(one), F.array().cast("array<string>"))


def related_targets(values: Column) -> Column:
    """Distinct page keys of related values, in order: links or paths under wiki/, no steps up."""
    link = lambda x: F.regexp_extract(F.trim(x), r"^\[\[([^\]|#]+)(?:[|#][^\]]*)?\]\]$", 1)
    raw = F.transform(values, lambda x: F.when(link(x) != "", link(x)).when(F.trim(x).startswith("wiki/"), F.trim(x)).otherwise(F.lit("")))
    keys = F.transform(raw, lambda x: T.page_key(F.trim(x)))
    return F.array_distinct(F.filter(keys, lambda k: k.startswith("wiki/") & ~k.contains("../")))


def first_heading(body: Column) -> Column:
    return F.trim(F.regexp_extract(body, r"(?m)^#\s+(.+)$", 1))


def parse_pages(files: DataFrame) -> DataFrame:
    """Pages of files (path, content) that parse: path, basename, type, title, tldr, status,
    created, updated, tags, related, aliases, fields, raw_path, body, content, links.

    Files without front matter, with front matter outside the subset or with an unknown
    type give no row. `fields` maps names to texts (lists to their JSON).
    """
    rows = with_front_matter(files.select(T.vault_path(F.col("path")).alias("path"), "content"), "read")
    rows = rows.select("path", "content", F.col("read.fields").alias("fm"), F.col("read.body").alias("body"))
    rows = rows.where(F.col("fm").isNotNull() & F.coalesce(scalar(F.col("fm"), "type").isin(TYPES), F.lit(False)))
    fm, none = F.col("fm"), F.lit("")
    status = scalar(fm, "status")
    related = strings(fm, "related")
    return rows.select(
        "path", F.regexp_replace(F.substring_index("path", "/", -1), r"(?i)\.md$", "").alias("basename"), scalar(fm, "type").alias("type"),
        F.coalesce(scalar(fm, "title"), first_heading(F.col("body"))).alias("title"), F.coalesce(scalar(fm, "tldr"), none).alias("tldr"),
        F.when(status.isin("stub", "reviewed"), status).otherwise("draft").alias("status"),
        F.coalesce(scalar(fm, "created"), scalar(fm, LEGACY["created"]), none).alias("created"), F.coalesce(scalar(fm, "updated"), scalar(fm, LEGACY["updated"]), none).alias("updated"),
        strings(fm, "tags").alias("tags"), related.alias("related"), strings(fm, "aliases").alias("aliases"),
        F.transform_values(fm, lambda k, v: F.when(v["list"], F.to_json(v["items"])).otherwise(F.coalesce(v["items"][0], F.lit("null")))).alias("fields"),
        F.coalesce(scalar(fm, "raw_path"), scalar(fm, LEGACY["raw_path"]), none).alias("raw_path"), "body", "content",
        F.array_distinct(F.concat(T.wiki_links(F.col("body")), related_targets(related))).alias("links"),
    )


def quoted(value: Column) -> Column:
    """A text as a YAML scalar: bare where that is safe, else in double quotes."""
    bare = value.rlike(r"^[A-Za-z0-9_/][A-Za-z0-9_./ -]*$") & ~F.lower(value).isin("true", "false", "null", "yes", "no") & ~value.rlike(r" $|^[0-9.]+$")
    escaped = F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.when(bare, value).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))


def _line(name: Column, values: Column, is_list: Column) -> Column:
    rows = F.array_join(F.transform(values, lambda x: F.concat(F.lit("\n  - "), quoted(x))), "")
    return F.concat(name, F.when(is_list & (F.size(values) == 0), ": []").when(is_list, F.concat(F.lit(":"), rows)).otherwise(F.concat(F.lit(": "), quoted(values[0]))))


def render(lines: Column, body: Column) -> Column:
    """A page of front matter lines and a body."""
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n\n"), F.regexp_replace(body, f"^[{T.SPACE}]+", ""))


def _standard(values: dict[str, Column], lists: dict[str, Column], order: list[str]) -> list[Column]:
    return [_line(F.lit(n), lists[n] if n in lists else F.array(values[n]), F.lit(n in lists)) for n in order]


def canonical_pages(files: DataFrame, date: str) -> DataFrame:
    """path, content, changed, warnings: files (path, content) with the front matter in its
    present form: older names replaced, defaults filled, unknown fields kept behind.

    Where there is none or it does not parse, the content stays and a warning says so.
    """
    rows = with_front_matter(files.select("path", "content"), "read")
    rows = rows.select("path", "content", F.col("read.fields").alias("fm"), F.col("read.body").alias("body"), F.col("read.repaired").alias("repaired"), F.col("read.block").alias("block"))
    fm, none = F.col("fm"), F.lit("")
    get = lambda n: F.coalesce(scalar(fm, n), scalar(fm, LEGACY[n])) if n in LEGACY else scalar(fm, n)
    low = T.vault_path(F.col("path"))
    guessed = F.when(low.contains("/sources/"), "source").when(low.contains("/entities/"), "entity").when(low.contains("/synthesis/"), "synthesis").when(low.contains("/outputs/"), "output").otherwise("concept")
    kind = F.when(F.coalesce(scalar(fm, "type").isin(TYPES), F.lit(False)), scalar(fm, "type")).otherwise(guessed)
    status, related = scalar(fm, "status"), strings(fm, "related")
    values = {
        "schema_version": F.lit("1"), "type": F.col("kind"), "title": F.coalesce(get("title"), F.nullif(first_heading(F.col("body")), none), F.col("path")),
        "tldr": F.coalesce(get("tldr"), T.inferred_tldr(F.col("body"))), "status": F.when(status.isin("stub", "reviewed"), status).otherwise("draft"),
        "created": F.coalesce(get("created"), F.lit(date)), "updated": F.coalesce(get("updated"), F.lit(date)),
        "source_type": F.coalesce(get("source_type"), F.lit("article")), "output_type": F.coalesce(get("output_type"), F.lit("tldr")),
    } | {n: F.coalesce(get(n), none) for n in ("author", "url", "raw_path", "raw_hash")}
    lists = {"tags": strings(fm, "tags"), "related": F.when(F.size(related) > 0, related).otherwise(T.wiki_links(F.col("content"))), "sources": strings(fm, "sources"), "conflicts": strings(fm, "conflicts")}
    base = ["schema_version", "type", "title", "tldr", "status", "created", "updated", "tags", "related"]
    lines = F.array(*_standard(values, lists, base))
    for t, names in EXTRA.items():
        lines = F.when(F.col("kind") == t, F.concat(lines, F.array(*_standard(values, lists, names)))).otherwise(lines)
    rest = F.transform(F.filter(F.map_entries(fm), lambda e: ~e["key"].isin(_CONSUMED)), lambda e: F.when(e["value"].isNull(), F.concat(e["key"], F.lit(": null"))).otherwise(_line(e["key"], e["value"]["items"], e["value"]["list"])))
    rows = rows.withColumn("kind", kind)
    rows = rows.withColumn("next", F.when(fm.isNotNull(), render(F.concat(lines, rest), F.col("body"))).otherwise(F.col("content")))
    warnings = F.array_compact(F.array(F.when(~F.col("block"), "NO_FRONT_MATTER").when(fm.isNull(), "FRONT_MATTER_INVALID"), F.when(fm.isNotNull() & F.col("repaired"), "FRONT_MATTER_REPAIRED")))
    return rows.select("path", F.col("next").alias("content"), (F.col("next") != F.col("content")).alias("changed"), warnings.alias("warnings"))


def page_template(kind: Column, title: Column, tldr: Column, body: Column, date: str) -> Column:
    """The content of a new page of a type."""
    none = F.array().cast("array<string>")
    values = {"schema_version": F.lit("1"), "type": kind, "title": title, "tldr": tldr, "status": F.lit("draft"), "created": F.lit(date), "updated": F.lit(date), "source_type": F.lit("article"), "output_type": F.lit("tldr")}
    values |= {n: F.lit("") for n in ("author", "url", "raw_path", "raw_hash")}
    lists = dict.fromkeys(("tags", "related", "sources", "conflicts"), none)
    lines = F.array(*_standard(values, lists, ["schema_version", "type", "title", "tldr", "status", "created", "updated", "tags", "related"]))
    for t, names in EXTRA.items():
        lines = F.when(kind == t, F.concat(lines, F.array(*_standard(values, lists, names)))).otherwise(lines)
    return render(lines, F.concat(F.lit("# "), title, F.lit("\n\n"), body, F.lit(f"\n\n## {RELATED}\n")))


def has_managed(body: Column) -> Column:
    return body.contains(START) & body.contains(END)


def managed_targets(body: Column) -> Column:
    """Page keys that the managed block of a body lists."""
    section = F.regexp_extract(body, f"(?s){START}(.*?){END}", 1)
    return related_targets(F.regexp_extract_all(section, F.lit(r"\[\[([^\]|#]+)(?:[|#][^\]]*)?\]\]"), F.lit(1)))


def strip_managed(body: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(body, rf"(?s)(?:\r?\n)*{START}.*?{END}(?:\r?\n)*", "\n"), f"[{T.SPACE}]+$", "")


def render_managed(body: Column, targets: Column) -> Column:
    """A body with the managed block of these related values, or without it for none."""
    keys = related_targets(targets)
    rows = F.array_join(F.transform(keys, lambda k: F.concat(F.lit("- [["), k, F.lit("]]"))), "\n")
    block = F.concat(F.lit(f"\n\n{START}\n## {RELATED}\n\n"), rows, F.lit(f"\n{END}\n"))
    return F.concat(strip_managed(body), F.when(F.size(keys) == 0, "\n").otherwise(block))


def _with_related(content: Column, related: Column, body: Column) -> Column:
    """A page's content with another list of related pages and another body; its other front
    matter lines stay as they are."""
    block = F.regexp_extract(content, _BLOCK_TEXT, 1)
    rest = F.regexp_replace(block, r"(?m)^related:.*(?:\r?\n[ \t]*-.*)*(?:\r?\n)?", "")
    lines = F.concat(F.regexp_replace(rest, r"\n+$", ""), F.lit("\n"), _line(F.lit("related"), related, F.lit(True)))
    return render(F.array(lines), body)


def enrich_pages(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """path, content, changed: parsed pages with the targets of their edges (from_path,
    to_path, rank) among the related ones and in the managed block. A page is no target of
    its own; doing it again changes nothing."""
    wanted = edges.groupBy(F.col("from_path").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "to_path"))), lambda x: x["to_path"]).alias("targets"))
    rows = pages.withColumn("key", T.page_key(F.col("path"))).join(wanted, "key", "left")
    targets = related_targets(F.concat("related", F.coalesce("targets", F.array().cast("array<string>"))))
    rows = rows.withColumn("all", F.filter(targets, lambda t: t != F.col("key")))
    content = _with_related(F.col("content"), F.col("all"), render_managed(F.col("body"), F.col("all")))
    return rows.select("path", content.alias("content"), (content != F.col("content")).alias("changed"))


def strip_dangling(pages: DataFrame, valid: DataFrame) -> DataFrame:
    """path, content, removed: parsed pages whose links to pages that are not in `valid`
    (key) became their alias or last path part; related ones are dropped. `removed` is
    sorted; pages without such a link keep their content."""
    rows = pages.withColumn("key", T.page_key(F.col("path")))
    ends = rows.select("path", F.explode("links").alias("to_path"))
    bad = ends.join(valid.select(F.col("key").alias("to_path")).distinct(), "to_path", "left_anti").groupBy("path").agg(F.array_sort(F.collect_set("to_path")).alias("removed"))
    joined = rows.join(bad, "path", "left")
    body = F.when(has_managed(F.col("body")), strip_managed(F.col("body"))).otherwise(F.col("body"))
    wholes = F.array_distinct(F.regexp_extract_all(body, F.lit(r"\[\[[^\]|#]+(?:[|#][^\]]*)?\]\]"), F.lit(0)))
    target = lambda w: T.page_key(F.trim(F.regexp_extract(w, r"^\[\[([^\]|#]+)", 1)))
    alias = lambda w: F.trim(F.regexp_extract(w, r"\|(.*)\]\]$", 1))
    name = lambda w: F.coalesce(F.nullif(alias(w), F.lit("")), F.replace(F.substring_index(target(w), "/", -1), F.lit("-"), F.lit(" ")))
    lost = F.filter(wholes, lambda w: F.array_contains("removed", target(w)))
    clean = F.aggregate(lost, body, lambda text, w: F.replace(text, w, name(w)))
    kept = F.filter(related_targets(F.col("related")), lambda t: ~F.array_contains("removed", t))
    clean = F.when(has_managed(F.col("body")), render_managed(clean, kept)).otherwise(clean)
    content = F.when(F.col("removed").isNull(), F.col("content")).otherwise(_with_related(F.col("content"), kept, clean))
    return joined.select("path", content.alias("content"), F.coalesce("removed", F.array().cast("array<string>")).alias("removed"))
