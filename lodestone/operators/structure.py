"""Text normalization, quality metrics, sections, chunks and HTML pages."""

from __future__ import annotations

import math
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T


def fences_open(lines: Column) -> Column:
    """Whether a code fence is left open. The marker that opened a fence closes it; other
    markers inside it are text."""
    marks = F.filter(F.transform(lines, lambda x: F.substring(F.regexp_extract(x, r"^\s*(```|~~~)", 1), 1, 1)), lambda m: m != "")
    return F.aggregate(marks, F.lit(""), lambda active, m: F.when(active == "", m).when(active == m, "").otherwise(active)) != ""


#: Fixed value: what a parsed document may have in bytes.
MAX_OUTPUT_BYTES = 20 << 20


def quality(docs: DataFrame, max_bytes: int = MAX_OUTPUT_BYTES) -> DataFrame:
    """doc_id, metrics, errors (codes, in order) and overall (pass, warning or fail).

    Optional columns: page_count, parsed_page_count and n_warnings of the parser. A null
    text is empty.
    """
    optional = {"page_count": "double", "parsed_page_count": "double", "n_warnings": "int"}
    docs = docs.withColumns({c: F.lit(None).cast(kind) for c, kind in optional.items() if c not in docs.columns}).withColumn("text", F.coalesce("text", F.lit("")))
    lines, n = F.split("text", "\n"), F.length("text")
    bad = F.length(F.regexp_replace("text", "[^\uFFFD]", ""))
    empty = F.greatest(F.lit(0.0), F.col("page_count") - F.coalesce("parsed_page_count", "page_count")) / F.col("page_count")
    measured = docs.select(
        "doc_id", n.cast("long").alias("characters"), (bad / F.greatest(n, F.lit(1))).alias("replacement_ratio"),
        F.size(F.filter(lines, lambda x: F.length(x) > 2000)).alias("long_lines"), F.when(F.col("page_count") > 0, empty).alias("empty_page_ratio"),
        F.array_compact(F.array(
            F.when(T.collapse(F.col("text")) == "", "EMPTY"), F.when(bad / F.greatest(n, F.lit(1)) > 0.01, "REPLACEMENT_RATIO"),
            F.when(F.size(F.filter(lines, lambda x: F.length(x) > 2000)) > 0, "LONG_LINE"), F.when((F.col("page_count") > 0) & (empty > 0.3), "EMPTY_PAGES"),
            F.when(F.octet_length("text") > max_bytes, "TOO_LARGE"), F.when(fences_open(lines), "OPEN_FENCE"),
        )).alias("errors"), F.coalesce("n_warnings", F.lit(0)).alias("n_warnings"),
    )
    warn = (F.col("replacement_ratio") > 0.001) | F.coalesce(F.col("empty_page_ratio") > 0.1, F.lit(False)) | (F.col("n_warnings") > 0)
    return measured.withColumn("overall", F.when(F.size("errors") > 0, "fail").when(warn, "warning").otherwise("pass"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """lang, documents, distinct documents and estimated tokens of the distinct ones."""
    first = docs.select("lang", F.sha2("text", 256).alias("hash"), T.token_estimate(F.col("text")).alias("tokens"))
    per = first.groupBy("lang", "hash").agg(F.count(F.lit(1)).alias("copies"), F.max("tokens").alias("tokens"))
    return per.groupBy("lang").agg(F.sum("copies").alias("n_docs"), F.count(F.lit(1)).alias("n_distinct"), F.sum("tokens").alias("tokens"))


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, section_id, heading, level, start_line, end_line, tokens, page, content.

    A heading inside a code fence is text: the parity of fence lines up to it decides. Lines
    before the first heading are a `Preamble`, a text without one is a `Document`. A page
    marker holds for the headings behind it. Windows run within one document; null texts
    are empty, and doc_ids are taken for unique.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n")
    lines = docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    by = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").rlike(r"^\s*(```|~~~)").cast("int")
    marked = lines.withColumn("open", F.sum(fence).over(by) % 2 == 1)
    page = F.when(~F.col("open"), F.regexp_extract("line", r"^<!--\s*llm-wiki:page=(\d+)\s*-->$", 1))
    heading = ~F.col("open") & F.col("line").rlike(r"^#{1,6}\s+.")
    numbered = marked.withColumn("is_heading", heading).withColumn("page", F.last(F.nullif(page, F.lit("")), ignorenulls=True).over(by).cast("int"))
    numbered = numbered.withColumn("section", F.sum(F.col("is_heading").cast("int")).over(by))
    title = F.trim(F.regexp_extract("line", r"^#{1,6}\s+(.+)$", 1))
    first = F.when(F.col("is_heading"), F.struct(title.alias("heading"), F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), "page"))
    found = numbered.groupBy("doc_id", "section").agg(
        F.max(first).alias("first"), (F.min("pos") + 1).alias("start_line"), (F.max("pos") + 1).alias("end_line"),
        F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"),
    )
    each = Window.partitionBy("doc_id")
    content = F.regexp_replace(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), f"[{T.SPACE}]+$", "")
    number = F.col("section") + F.when(F.min("section").over(each) == 0, 1).otherwise(0)
    none = F.when(F.max("section").over(each) == 0, "Document").otherwise("Preamble")
    return found.withColumn("content", content).select(
        "doc_id", F.concat(F.lit("s"), F.lpad(number.cast("string"), 4, "0")).alias("section_id"), F.coalesce("first.heading", none).alias("heading"),
        F.coalesce("first.level", F.lit(0)).alias("level"), "start_line", "end_line", T.token_estimate(F.col("content")).alias("tokens"), F.col("first.page").alias("page"), "content",
    )


def _cost(ch: str) -> float:
    return 0.25 if ch < "\x80" else 1.0


def estimate(text: str) -> int:
    ascii_ = sum(c < "\x80" for c in text)
    return len(text) - ascii_ + math.ceil(ascii_ / 4)


def truncate(text: str, budget: int) -> str:
    spent = 0.0
    for i, ch in enumerate(text):
        spent += _cost(ch)
        if spent > budget:
            return text[:i]
    return text


def split_by_budget(text: str, budget: int) -> list[str]:
    """Paragraphs packed greedily; a paragraph over the budget is cut. Loses only blank lines."""
    chunks, current = [], ""
    for paragraph in re.split(r"\n{2,}", text):
        joined = f"{current}\n\n{paragraph}" if current else paragraph
        if estimate(joined) <= budget:
            current = joined
            continue
        if current:
            chunks.append(current)
        while estimate(paragraph) > budget:
            head = truncate(paragraph, budget) or paragraph[:1]
            chunks.append(head)
            paragraph = paragraph[len(head) :]
        current = paragraph
    if current:
        chunks.append(current)
    return chunks


def token_chunks(docs: DataFrame, budget: int = 400) -> DataFrame:
    """doc_id, chunk_no, chunk, tokens. One document at a time; order-dependent, so Python."""

    def run(batches):
        for b in batches:
            rows = [(i, n, c, estimate(c)) for i, t in zip(b.doc_id, b.text, strict=True) for n, c in enumerate(split_by_budget(t or "", budget))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "chunk", "tokens"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk_no int, chunk string, tokens int")


#: Fixed value: where Markdown is cut first.
_CUT = re.compile(r"(#{1,3}\s|<!--\s*llm-wiki:page=\d)")


def split_markdown(text: str, budget: int) -> list[str]:
    """Markdown in pieces of a token budget: cut before headings of the first three levels and
    page markers, packed greedily; a section over the budget is cut by paragraphs."""
    if not text.strip():
        return []
    if estimate(text) <= budget:
        return [text]
    sections: list[list[str]] = [[]]
    for line in text.split("\n"):
        if _CUT.match(line) and any(x.strip() for x in sections[-1]):
            sections.append([])
        sections[-1].append(line)
    out, held = [], ""
    for section in ("\n".join(x) for x in sections if any(y.strip() for y in x)):
        both = f"{held}\n\n{section}" if held else section
        if estimate(both) <= budget:
            held = both
            continue
        out += [held] if held else []
        held = section if estimate(section) <= budget else ""
        out += [] if held else split_by_budget(section, budget)
    return [*out, held] if held else out


def markdown_chunks(docs: DataFrame, budget: int = 400) -> DataFrame:
    """doc_id, chunk_no, chunk, tokens of Markdown texts; one document at a time."""

    def run(batches):
        for b in batches:
            rows = [(i, n, c, estimate(c)) for i, t in zip(b.doc_id, b.text, strict=True) for n, c in enumerate(split_markdown(t or "", budget))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "chunk", "tokens"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk_no int, chunk string, tokens int")


def normal_markdown(text: str, longest: int = 1200) -> str:
    """Markdown in its stored form: no byte order mark, plain line ends, composed characters, no
    control characters, no blanks at line ends, at most two blank lines in a row, and long
    lines outside fences cut at a blank."""
    text = unicodedata.normalize("NFC", text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n"))
    text = re.sub(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "", text)
    out, fenced, blanks = [], False, 0
    for line in text.split("\n"):
        fenced ^= bool(_FENCE.match(line))
        line = line.rstrip(" \t") if fenced else line.rstrip()
        blanks = 0 if line.strip() else blanks + 1
        if blanks:
            out += [""] * (blanks <= 2)
            continue
        while not fenced and len(line) > longest:
            at = line.rfind(" ", 0, longest + 1)
            at = at if at >= longest * 6 // 10 else longest
            out.append(line[:at].rstrip())
            line = line[at:].lstrip()
        out += [line] if line else []
    return "\n".join(out).strip() + "\n"


def normalized(docs: DataFrame) -> DataFrame:
    """doc_id, body: texts in their stored form (Arrow batches); null texts are empty."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "body": [normal_markdown(t or "") for t in b.text]})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, body string")


#: How lines of stored Markdown are told apart.
_FENCE = re.compile(r"\s*(```+|~~~+)")
_PAGE, _MARK = re.compile(r"<!--\s*llm-wiki:page=(\d+)(?:\s+source=\w+)?\s*-->$"), re.compile(r"<!--\s*llm-wiki:block=")
_HEAD, _LIST, _QUOTE = re.compile(r"#{1,6}\s"), re.compile(r"\s*(?:[-*+]\s|\d+[.)、]\s)"), re.compile(r"\s*>")
_HTML, _RULE = re.compile(r"\s*<(?:!--|[/A-Za-z])"), re.compile(r"\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$")


def _is_table(lines: list[str], i: int) -> bool:
    return "|" in lines[i] and i + 1 < len(lines) and bool(_RULE.match(lines[i + 1]))


def _kind(lines: list[str], i: int) -> str:
    line = lines[i]
    if _is_table(lines, i):
        return "table" if not _FENCE.match(line) and not _HEAD.match(line) else ("code" if _FENCE.match(line) else "heading")
    for kind, rule in (("code", _FENCE), ("heading", _HEAD), ("list", _LIST), ("quote", _QUOTE), ("html", _HTML)):
        if rule.match(line):
            return kind
    return "paragraph"


def _end(lines: list[str], start: int, kind: str) -> int:
    """Behind the last line of the block that starts here."""
    i, n = start + 1, len(lines)
    if kind == "code":
        mark = _FENCE.match(lines[start])[1]
        closing = re.compile(rf"\s*{re.escape(mark[0])}{{{len(mark)},}}\s*$")
        while i < n and not closing.match(lines[i]):
            i += 1
        return min(i + 1, n)
    if kind == "table":
        i += 1
        while i < n and "|" in lines[i]:
            i += 1
    elif kind == "quote":
        while i < n and _QUOTE.match(lines[i]):
            i += 1
    elif kind in ("list", "paragraph"):
        while i < n and lines[i].strip() and not _PAGE.match(lines[i].strip()):
            other = _kind(lines, i)
            more = (other == "list" or re.match(r"\s{2,}\S", lines[i])) and other not in ("heading", "code", "quote", "table") if kind == "list" else other in ("paragraph", "html") and not _MARK.match(lines[i].strip())
            if not more:
                break
            i += 1
    return i


def block_rows(text: str) -> list[tuple]:
    """(number, kind, first and last line in the marked text and in the given one, page) of
    each block of a Markdown text. Marks of blocks that it has already are dropped."""
    lines = text.removesuffix("\n").split("\n")
    out, i, written, page = [], 0, 0, 1
    while i < len(lines):
        line = lines[i].strip()
        if not line or (marker := _PAGE.match(line)):
            page = int(marker[1]) if line else page
            written, i = written + 1, i + 1
        elif _MARK.match(line):
            i += 1
        else:
            kind = _kind(lines, i)
            end = _end(lines, i, kind)
            out.append((len(out) + 1, kind, written + 2, written + 1 + end - i, i + 1, end, page))
            written, i = written + 1 + end - i, end
    return out


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, block_id, kind, start_line, end_line, source_start, source_end, page, one row a
    block; one document at a time, since where a block ends depends on what it is."""
    columns = ["doc_id", "block_id", "kind", "start_line", "end_line", "source_start", "source_end", "page"]

    def run(batches):
        for b in batches:
            rows = [(i, f"b{n:06d}", *rest) for i, t in zip(b.doc_id, b.text, strict=True) for n, *rest in block_rows(t or "")]
            yield pd.DataFrame(rows, columns=columns)

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, block_id string, kind string, start_line int, end_line int, source_start int, source_end int, page int")


def representative_sections(found: DataFrame, most: int = 16) -> DataFrame:
    """doc_id, section_id: the first sections of the two upper levels, and the last one."""
    order, back = Window.partitionBy("doc_id").orderBy("section_id"), Window.partitionBy("doc_id").orderBy(F.desc("section_id"))
    upper = found.where("level <= 2").withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    last = found.withColumn("n", F.row_number().over(back)).where("n = 1")
    return upper.select("doc_id", "section_id").unionByName(last.select("doc_id", "section_id")).distinct()


def nfkc(text: Column) -> Column:
    """Compatibility normalization, which Spark has no function for (Arrow batches)."""

    def normalize(values: pd.Series) -> pd.Series:
        return values.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")

    normalize.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(normalize, "string")(text)


def concept_identity(title: Column) -> Column:
    """Compatibility form, lower case, without blanks and the marks that names differ in."""
    return F.regexp_replace(F.lower(nfkc(title)), "[" + T.SPACE + r"·・,，.。:：;；'\"“”‘’()（）\[\]【】/_-]", "")


#: Fixed value: what a page says instead of its text when it keeps readers out.
ACCESS_GATE = r"(?i)(?:enable\s+javascript|javascript\s+(?:is\s+)?required|access\s+denied|captcha|cloudflare|checking\s+your\s+browser|verify\s+you\s+are\s+human|请启用\s*javascript|访问被拒绝|人机验证|安全验证)"


class _Reader(HTMLParser):
    SKIP = {"script", "style", "nav", "header", "footer", "aside", "noscript", "template"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.lines, self.skip, self.open, self.level = "", [""], [], "", 0

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip.append(tag)
        elif tag == "title":
            self.open = tag
        elif re.fullmatch("h[1-6]", tag):
            self.lines += ["", "#" * int(tag[1]) + " "]
        elif tag in ("p", "div", "li", "br", "tr", "section", "article"):
            self.lines.append("- " if tag == "li" else "")

    def handle_endtag(self, tag):
        if self.skip and tag == self.skip[-1]:
            self.skip.pop()
        elif tag == "title":
            self.open = ""
        elif re.fullmatch("h[1-6]|p|div|li|tr", tag):
            self.lines.append("")

    def handle_data(self, data):
        if self.open == "title":
            self.title += data
        elif not self.skip:
            self.lines[-1] += re.sub(r"\s+", " ", data)


def html_to_markdown(html: str) -> tuple[str, str]:
    reader = _Reader()
    reader.feed(html)
    lines = [x.strip() for x in reader.lines]
    return reader.title.strip(), re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def web_pages(pages: DataFrame) -> DataFrame:
    """page_id, title, markdown, n_words, status; the gates are columns, rows never fail."""

    def run(batches):
        for b in batches:
            found = [html_to_markdown(h or "") for h in b.html]
            yield pd.DataFrame({"page_id": b.page_id, "title": [t for t, _ in found], "markdown": [m for _, m in found]})

    read = pages.select("page_id", "html").mapInPandas(run, "page_id long, title string, markdown string")
    words = F.size(F.filter(F.split("markdown", r"\s+"), lambda w: w != ""))
    read = read.withColumn("n_words", words)
    gate = F.substring("markdown", 1, 4000).rlike(ACCESS_GATE)
    return read.withColumn("status", F.when(F.col("n_words") == 0, "WEB_BROWSER_REQUIRED").when((F.col("n_words") < 200) & gate, "WEB_ACCESS_BLOCKED").when(F.col("n_words") < 50, "WEB_CONTENT_SPARSE").otherwise("OK"))
