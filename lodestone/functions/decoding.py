"""Bytes as text: charsets by precedence, and strict decoding that never stops a job."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels that web pages use for a charset of another name.
LABELS = {
    "iso-8859-1": "cp1252", "iso8859-1": "cp1252", "latin1": "cp1252", "us-ascii": "cp1252", "ascii": "cp1252", "iso-8859-9": "cp1254", "iso-8859-11": "cp874", "tis-620": "cp874",
    "gb2312": "gb18030", "gbk": "gb18030", "x-gbk": "gb18030", "gb_2312-80": "gb18030", "shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "x-sjis": "cp932", "windows-31j": "cp932",
    "ks_c_5601-1987": "cp949", "euc-kr": "cp949", "big5": "big5hkscs", "x-x-big5": "big5hkscs", "utf8": "utf-8", "unicode": "utf-16-le", "utf-16": "utf-16-le", "ucs-2": "utf-16-le", "macintosh": "mac-roman", "x-mac-roman": "mac-roman", "dos-874": "cp874",
}
#: Fixed value: bytes in which a page may name its charset.
HEAD = 8192
UNSUPPORTED = "UNSUPPORTED_ENCODING"


def strictly(content: bytes, charset: str) -> str | None:
    """Text in a charset; null where it isn't known or a byte has no meaning in it."""
    name = LABELS.get(charset, charset)
    try:
        if not codecs.lookup(name)._is_text_encoding:
            return None
        return bytes(content).decode(name)
    except (LookupError, UnicodeError):
        return None


def decoded(content: Column, charset: Column) -> Column:
    """Bytes as text by a charset's name in lower case; null as in `strictly` (Arrow batches,
    since Spark has few charsets and stops at the first bad byte)."""

    def decode(contents: pd.Series, charsets: pd.Series) -> pd.Series:
        return pd.Series([None if c is None or n is None else strictly(c, n) for c, n in zip(contents, charsets, strict=True)], dtype=object)

    decode.__annotations__ = {"contents": pd.Series, "charsets": pd.Series, "return": pd.Series}
    return F.pandas_udf(decode, "string")(content, charset)


def mark(content: Column) -> Column:
    """(charset, size) of a byte order mark; null where there is none."""
    head = F.hex(F.substring(content, 1, 3))
    found = lambda name, n: F.struct(F.lit(name).alias("charset"), F.lit(n).alias("size"))
    return F.when(head == "EFBBBF", found("utf-8", 3)).when(head.startswith("FFFE"), found("utf-16-le", 2)).when(head.startswith("FEFF"), found("utf-16-be", 2))


def _some(found: Column) -> Column:
    return F.lower(F.nullif(found, F.lit("")))


def header_charset(content_type: Column) -> Column:
    """The charset that a Content-Type names; null where it names none."""
    return _some(F.regexp_extract(content_type, r"(?i)charset\s*=\s*[\"']?([^;\s\"']+)", 1))


def meta_charset(content: Column) -> Column:
    """The charset that a page names in a <meta> tag among its first HEAD bytes."""
    head = F.decode(F.substring(content, 1, HEAD), "ISO-8859-1")
    plain = _some(F.regexp_extract(head, r"(?i)<meta[^>]+charset\s*=\s*[\"']?([^\s\"'/>]+)", 1))
    return F.coalesce(plain, _some(F.regexp_extract(head, r"(?i)<meta[^>]+content\s*=\s*[\"'][^\"']*charset=([^\s;\"']+)", 1)))


def html_charset(content: Column, content_type: Column) -> Column:
    """What a page is decoded by: a byte order mark, else the header, else a <meta> tag, else UTF-8."""
    return F.coalesce(mark(content)["charset"], header_charset(content_type), meta_charset(content), F.lit("utf-8"))


def decode_html(content: Column, content_type: Column) -> Column:
    """charset, text and error of a page: the text is null, and the error UNSUPPORTED_ENCODING,
    where the charset isn't known or the bytes are none of its texts. Null bytes have neither."""
    charset = html_charset(content, content_type)
    body = F.substring(content, F.coalesce(mark(content)["size"], F.lit(0)) + 1, F.lit(1 << 30))
    text = decoded(body, charset)
    return F.struct(F.when(content.isNotNull(), charset).alias("charset"), text.alias("text"), F.when(content.isNotNull() & text.isNull(), UNSUPPORTED).alias("error"))


def decode_text(content: Column) -> Column:
    """Bytes as text by their byte order mark, else as strict UTF-8; null where they are not."""
    return decoded(F.substring(content, F.coalesce(mark(content)["size"], F.lit(0)) + 1, F.lit(1 << 30)), F.coalesce(mark(content)["charset"], F.lit("utf-8")))
