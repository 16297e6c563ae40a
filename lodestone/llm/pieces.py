"""Cutting a text where byte-level pre-tokenization always cuts.

A single ASCII space between two characters that are not white space starts a new
pre-token under the usual byte-level pattern. Texts cut there give pieces that can be
encoded alone, and far fewer different pieces than texts, so a bounded memo of encoded
pieces spares almost all of the work.
"""

from __future__ import annotations

from collections.abc import Callable

_SPACES = [chr(c) for c in (*range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def pieces(text: str) -> list[str]:
    """Pieces whose concatenation is `text` and whose encodings concatenate."""
    parts = text.split(" ")
    if len(parts) == 1:
        return parts if text else []
    odd = [s for s in _SPACES if s in text]
    if "" not in parts and not any(f" {s}" in text or f"{s} " in text for s in odd):
        return [parts[0], *[" " + p for p in parts[1:]]]
    out, open_ = [], parts[0]
    for p in parts[1:]:
        if open_ and not open_[-1].isspace() and p and not p[0].isspace():
            out.append(open_)
            open_ = " " + p
        else:
            open_ += " " + p
    out.append(open_)
    return out


class Memo(dict):
    """piece -> encoding, filled on a miss; pieces longer than `longest` are not kept.

    When it holds `bound` pieces they become the old ones and those of before are dropped.
    An old piece that is met again is kept, so rare pieces never push common ones out.
    """

    def __init__(self, encode: Callable, bound: int = 300_000, longest: int = 200):
        self.encode, self.bound, self.longest, self.old = encode, bound, longest, {}

    def __missing__(self, piece):
        value = self.old.get(piece)
        if value is None:
            value = self.encode(piece)
        if len(piece) <= self.longest:
            self[piece] = value
            if len(self) >= self.bound:
                self.old = dict(self)
                self.clear()
        return value
