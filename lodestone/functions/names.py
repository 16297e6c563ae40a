"""Names, addresses and redaction: column expressions over short texts."""

from __future__ import annotations

import ipaddress
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text as T

#: IPv4 blocks that are not public, and their prefix lengths.
IPV4_BLOCKS = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4"]
#: What a file name may not hold, and what a published folder is called.
UNSAFE = r'[\x00-\x1F<>:"/\\|?*]'
FOLDERS = {"entity": "entities", "concept": "concepts", "synthesis": "synthesis"}


def normal_form(value: Column, form: str) -> Column:
    """A Unicode normal form, which Spark has no function for (Arrow batches)."""

    def normalize(values: pd.Series) -> pd.Series:
        return values.map(lambda s: unicodedata.normalize(form, s), na_action="ignore")

    normalize.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(normalize, "string")(value)


def safe_file_name(name: Column, mark: str = "-") -> Column:
    return F.regexp_replace(name, UNSAFE, mark)


def slug(value: Column) -> Column:
    """Lower case, decomposed, runs of other than a-z and 0-9 as one dash, at most 80."""
    dashed = F.regexp_replace(normal_form(F.lower(value), "NFKD"), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 80)


def canonical_basename(name: Column) -> Column:
    """A file name without extension as a base for published names."""
    base = T.collapse(normal_form(F.regexp_replace(name, r"\.[^.]+$", ""), "NFC"))
    dashed = F.regexp_replace(F.regexp_replace(safe_file_name(base), r"\s+", "-"), "-+", "-")
    cut = F.substring(F.lower(F.regexp_replace(dashed, r"^[.-]+|[.-]+$", "")), 1, 100)
    return F.when(cut == "", "document").otherwise(cut)


def published_name(basename: Column, content_hash: Column, revision: Column) -> Column:
    """basename--hash8.md, with the revision from the second on."""
    return F.concat(basename, F.lit("--"), F.substring(content_hash, 1, 8), F.when(revision > 1, F.concat(F.lit("--r"), revision.cast("string"))).otherwise(""), F.lit(".md"))


def knowledge_path(kind: Column, requested: Column, title: Column, candidate_id: Column) -> Column:
    """Where a knowledge page goes: the requested path if it is right for its type, else a slug
    of the request, the title or the candidate's id in the folder of the type."""
    folder = F.create_map(*[F.lit(x) for pair in FOLDERS.items() for x in pair])
    place = F.concat(F.lit("wiki/"), F.try_element_at(folder, kind), F.lit("/"))
    wanted = T.vault_path(F.coalesce(requested, F.lit("")))
    some = lambda c: F.nullif(slug(c), F.lit(""))
    own = F.concat(kind, F.lit("-"), F.coalesce(some(candidate_id), F.substring(F.sha2(candidate_id, 256), 1, 8)))
    name = F.coalesce(some(F.regexp_replace(F.substring_index(wanted, "/", -1), r"(?i)\.md$", "")), some(title), own)
    return F.when(wanted.startswith(place) & wanted.endswith(".md"), wanted).otherwise(F.concat(place, name, F.lit(".md")))


def ipv4_number(address: Column) -> Column:
    """An IPv4 address as a number; null where it is none."""
    parts = F.transform(F.split(address, r"\."), lambda p: F.when(p.rlike(r"^(0|[1-9][0-9]{0,2})$"), p.cast("long")))
    ok = (F.size(parts) == 4) & F.forall(parts, lambda p: F.coalesce(p <= 255, F.lit(False)))
    return F.when(ok, F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc * 256 + p))


#: IPv6 networks that are not public, and their prefix lengths.
IPV6_BLOCKS = ["::/128", "::1/128", "::ffff:0:0/96", "fc00::/7", "fe80::/10", "ff00::/8", "2001:db8::/32"]


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def ipv6_numbers(address: Column) -> Column:
    """An IPv6 address as two longs, `hi` and `lo`; null where it is none. A zone is no part of
    it, and the last two groups may be an IPv4 address."""
    none = F.array().cast("array<string>")
    groups = lambda text: F.when(text == "", none).otherwise(F.split(text, ":", -1))
    number = lambda words, start: reduce(Column.bitwiseOR, [F.shiftleft(F.try_element_at(words, F.lit(start + i + 1)), 48 - 16 * i) for i in range(4)])

    def hexed(low):
        tail = ipv4_number(F.regexp_extract(low, r"^.*:([0-9]+\.[0-9.]+)$", 1))
        return F.concat(F.regexp_extract(low, r"^(.*:)[0-9.]+$", 1), _bound(tail, lambda n: F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(F.lit(65535)))))))

    def spread(sides):
        """All eight groups of the one or two sides of a double colon; null where they are none."""
        two = F.size(sides) == 2
        both = F.struct(groups(sides[0]).alias("l"), F.when(two, groups(F.try_element_at(sides, F.lit(2)))).otherwise(none).alias("r"))
        fits = lambda x: (F.when(two, F.size(x["l"]) + F.size(x["r"]) <= 7).otherwise((F.size(sides) == 1) & (F.size(x["l"]) == 8)))
        return _bound(both, lambda x: F.when(fits(x), F.concat(x["l"], F.array_repeat(F.lit("0"), 8 - F.size(x["l"]) - F.size(x["r"])), x["r"])))

    low = F.lower(F.regexp_replace(address, r"%[0-9a-zA-Z.:-]+$", ""))
    plain = _bound(low, lambda x: F.when(x.contains("."), hexed(x)).otherwise(x))
    words = _bound(plain, lambda x: F.when(x.contains(":"), _bound(F.split(x, "::", -1), spread)))
    checked = _bound(words, lambda w: F.when(F.forall(w, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.transform(w, lambda g: F.conv(g, 16, 10).cast("long"))))
    return _bound(checked, lambda w: F.when(w.isNotNull(), F.struct(number(w, 0).alias("hi"), number(w, 4).alias("lo"))))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def in_network(numbers: Column, network: str) -> Column:
    """Whether an address (hi, lo) lies in an IPv6 network such as fc00::/7."""
    net = ipaddress.IPv6Network(network)
    base, mask = int(net.network_address), int(net.netmask)
    half = lambda value, at: F.lit(_signed(value >> at & (1 << 64) - 1)).cast("long")
    return (numbers["hi"].bitwiseAND(half(mask, 64)) == half(base, 64)) & (numbers["lo"].bitwiseAND(half(mask, 0)) == half(base, 0))


def public_address(address: Column) -> Column:
    """Whether an address is an IPv4 or IPv6 address outside the blocks that are not public;
    false for what is neither."""
    ranges = []
    for block in IPV4_BLOCKS:
        base, prefix = block.split("/")
        first = sum(int(p) << (24 - 8 * i) for i, p in enumerate(base.split(".")))
        ranges.append((first, first + (1 << (32 - int(prefix))) - 1))
    open_four = lambda n: ~reduce(Column.__or__, [n.between(*r) for r in ranges])
    open_six = lambda n: ~reduce(Column.__or__, [in_network(n, block) for block in IPV6_BLOCKS])
    four, six = _bound(ipv4_number(address), open_four), _bound(ipv6_numbers(address), open_six)
    return F.coalesce(F.when(address.contains(":"), six).otherwise(four), F.lit(False))


#: Folders that no inbox may overlap.
PROTECTED = ["raw", "wiki", ".llm-wiki"]


def inbox_path_ok(path: Column, config_folder: str) -> Column:
    """Whether a folder may be an inbox: no step up, no overlap with protected folders."""
    clean = F.regexp_replace(T.vault_path(path), "/$", "")
    ok = ~clean.isin("", ".") & ~F.array_contains(F.split(clean, "/"), "..")
    for root in (*PROTECTED, config_folder):
        ok = ok & (clean != root) & ~clean.startswith(f"{root}/") & ~F.lit(root).startswith(F.concat(clean, F.lit("/")))
    return ok


def relative_image(markdown: Column) -> Column:
    """Whether a text shows an image by a relative reference."""
    return markdown.rlike(r"!\[\[[^\]]+\]\]") | markdown.rlike(r"(?i)!\[[^\]]*\]\((?!https?://|data:|/|#)[^)]+\)")


def summary_redacted(value: Column, most: int = 160) -> Column:
    """A message without credentials and query strings, collapsed."""
    value = F.regexp_replace(F.coalesce(value, F.lit("")), r"(?i)(authorization|api[-_ ]?key|token)\s*[:=]\s*(?:bearer\s+)?[^\s,;]+", "$1=[REDACTED]")
    value = F.regexp_replace(value, r"(?i)(https?://[^\s?#]+)\?[^\s]*", "$1")
    return F.substring(T.collapse(value), 1, most)


def resume_token_ok(token: Column) -> Column:
    size = F.length(F.coalesce(token, F.lit("")))
    return size.between(1, 2048) & ~F.coalesce(token, F.lit("")).rlike(r"(?i)(?:bearer\s+|sk-ant-|api[_-]?key\s*=|authorization\s*=)")


def representative_sample(text: Column, most: int = 8000) -> Column:
    """A long text's head (40 %), middle (30 %) and tail, labelled; a short one as it is."""
    head, middle = int(most * 0.4), int(most * 0.3)
    tail = most - head - middle
    start = F.greatest(F.lit(head), F.floor(F.length(text) / 2 - middle / 2)).cast("int")
    parts = F.concat(F.lit("[开头]\n"), F.substring(text, 1, head), F.lit("\n\n[中段]\n"), F.substring(text, start + 1, F.lit(middle)), F.lit("\n\n[结尾]\n"), F.right(text, F.lit(tail)))
    return F.when(F.length(text) <= most, text).otherwise(parts)


def plain_paragraphs(text: Column) -> Column:
    """Paragraphs of a plain text, trimmed, with one blank line between."""
    parts = F.transform(F.split(text, r"\n[ \t]*\n"), lambda p: F.regexp_replace(p, f"^[{T.SPACE}]+|[{T.SPACE}]+$", ""))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def recency(day: Column, today: Column) -> Column:
    """today, yesterday, week or older; older also for dates that cannot be read."""
    days = F.datediff(today, day)
    return F.when(days.isNull() | (days >= 7), "older").when(days <= 0, "today").when(days == 1, "yesterday").otherwise("week")
