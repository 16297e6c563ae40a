"""Column expressions over text, paths and URLs (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of names of URL query parameters that hold secrets.
SECRET_PARTS = "token|key|signature|authorization|auth|credential|secret"
#: White space as text engines see it: ASCII, no-break and the Unicode space separators.
SPACE = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SPACE_CHARS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def token_estimate(text: Column) -> Column:
    """Non-ASCII code points, plus a quarter of the ASCII ones rounded up; null is 0."""
    text = F.coalesce(text, F.lit(""))
    wide = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return (wide + F.ceil((F.length(text) - wide) / 4)).cast("long")


def input_budget(window: Column) -> Column:
    """Tokens of a context window that are left for input."""
    return F.greatest(F.lit(8000), F.floor((window - 32000) * 8 / 10)).cast("long")


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def vault_path(path: Column) -> Column:
    slashes = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/")
    return F.regexp_replace(slashes, "^/", "")


def page_key(path: Column) -> Column:
    return F.regexp_replace(vault_path(path), r"(?i)\.md$", "")


def wiki_links(content: Column) -> Column:
    """Distinct link targets in order, without alias, heading and suffix."""
    found = F.regexp_extract_all(content, F.lit(r"\[\[([^\]|#]+)(?:[|#][^\]]*)?\]\]"), F.lit(1))
    return F.array_distinct(F.transform(F.filter(found, lambda x: F.trim(x) != ""), lambda x: page_key(F.trim(x))))


#: Fixed value: the configuration file, which no plan may write.
CONFIG_FILE = "llm-wiki.config.json"


def writable_path(path: Column) -> Column:
    """Under wiki/ after normalization, without a step up, and no configuration."""
    low = F.lower(vault_path(path))
    return low.startswith("wiki/") & ~low.contains("../") & (low != CONFIG_FILE)


def staged_path(path: Column, index_path: str = "wiki/index.md", log_path: str = "wiki/log.md") -> Column:
    """Writable, and neither the index nor the log page."""
    return writable_path(path) & ~F.lower(vault_path(path)).isin(index_path, log_path)


def collapse(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def compact_tldr(text: Column, limit: int = 180) -> Column:
    """Table rows go, links become their targets, marks become blanks; at most `limit`."""
    plain = F.regexp_replace(text, r"\|[^\n]*\|", " ")
    plain = F.regexp_replace(plain, r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]", "$1")
    plain = collapse(F.regexp_replace(plain, r"[`*_>#-]", " "))
    return F.when(F.length(plain) > limit, F.concat(F.rtrim(F.substring(plain, 1, limit - 1)), F.lit("…"))).otherwise(plain)


def inferred_tldr(body: Column, limit: int = 120) -> Column:
    """The first words of a body without headings, comments and marks."""
    plain = F.regexp_replace(F.regexp_replace(body, r"(?m)^#.*$", ""), r"(?s)<!--.*?-->", "")
    return F.substring(collapse(F.regexp_replace(plain, r"[*_`>#-]", "")), 1, limit)


def clean_url(url: Column, secret: str = SECRET_PARTS) -> Column:
    """http(s) only, without credentials, values of parameters whose decoded name has a secret
    part redacted; else null. A parameter that repeats is redacted each time."""
    bare = F.regexp_replace(url, r"^(?i)(https?://)[^/?#]*@", "$1")
    bare = F.regexp_replace(bare, r"^([A-Za-z]+://[^/?#]+)([?#]|$)", "$1/$2")
    query = F.regexp_extract(bare, r"^[^?#]*\?([^#]*)", 1)
    name = lambda p: F.regexp_extract(p, r"^[^=]*", 0)
    hidden = lambda p: F.coalesce(F.try_url_decode(name(p)), name(p)).rlike(f"(?i)({secret})")
    redacted = F.array_join(F.transform(F.split(query, "&", -1), lambda p: F.when(hidden(p), F.concat(name(p), F.lit("=%5BREDACTED%5D"))).otherwise(p)), "&")
    whole = F.concat(F.regexp_extract(bare, r"^[^?#]*\?", 0), redacted, F.regexp_extract(bare, r"#.*$", 0))
    return F.when(url.rlike(r"^(?i)https?://[^/?#]+"), F.when(query == "", bare).otherwise(whole))


def page_url(url: Column) -> Column:
    """As clean_url with more secret names; empty where the address is refused."""
    return F.coalesce(clean_url(url, SECRET_PARTS + "|sig|password"), F.lit(""))


def url_acceptable(url: Column) -> Column:
    """http or https, a host, and no credentials."""
    return F.coalesce(url.rlike(r"^(?i)https?://[^/?#@\s]+([/?#]|$)"), F.lit(False))


def clock(ms: Column) -> Column:
    seconds = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60)


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a non-empty term."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")


def query_terms(query: Column) -> Column:
    """Latin terms of a lowered query and its Han runs, long runs as bigrams; distinct."""
    low = F.lower(query)
    latin = F.regexp_extract_all(low, F.lit(r"[a-z0-9][a-z0-9.+#/-]*"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(r"\p{IsHan}{2,}"), F.lit(0))
    grams = F.transform(runs, lambda r: F.when(F.length(r) <= 4, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(latin, F.flatten(grams)))


def search_terms(query: Column) -> Column:
    """Distinct words of two characters or more in a lowered query."""
    return F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit(r"[\p{L}\p{N}_.+#/-]{2,}"), F.lit(0)))


def search_score(text: Column, query: Column, terms: Column, mode: str) -> Column:
    """Score of a lowered text: occurrences of the phrase ("exact"), or of the terms, five of
    each at most; with "all_terms" only where every term occurs."""
    capped = lambda t: F.least(occurrences(text, t), F.lit(5).cast("long"))
    zero = F.lit(0).cast("long")
    if mode == "exact":
        phrase = F.trim(F.lower(query))
        return F.when(phrase == "", zero).otherwise(capped(phrase))
    total = F.aggregate(terms, zero, lambda acc, t: acc + capped(t))
    return F.when(F.forall(terms, lambda t: text.contains(t)), total).otherwise(zero) if mode == "all_terms" else total


def ingest_query(content: Column) -> Column:
    """What a new document is looked up by: its first heading or line, and inline code terms."""
    line = F.trim(F.element_at(F.concat(F.filter(F.split(content, r"\r?\n"), lambda x: F.trim(x) != ""), F.array(F.lit(""))), 1))
    title = F.coalesce(F.nullif(F.trim(F.regexp_extract(content, r"(?m)^#\s+(.+)$", 1)), F.lit("")), line)
    code = F.slice(F.filter(F.transform(F.regexp_extract_all(content, F.lit(r"`([^`\n]{2,80})`"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != ""), 1, 12)
    return F.array_join(F.filter(F.array_distinct(F.concat(F.array(F.substring(title, 1, 240)), code)), lambda x: x != ""), " ")


def trimmed(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def blank(text: Column) -> Column:
    """Whether a text holds nothing but white space; it is read up to the first other character."""
    return ~text.rlike(f"[^{SPACE}]")
