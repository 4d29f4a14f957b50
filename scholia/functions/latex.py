r"""Formulas in Markdown: found in one pass, checked and put into plain delimiters.

``parse`` reads a text once and gives its parts in order: plain text, code, and formulas of three kinds. A formula is inline
(``$`` or ``\(``), displayed (``$$`` or ``\[``) or a bare environment. An escaped character never opens or closes anything, and
what stands in code is no formula. A formula without an end ends where its first line or its first CJK character begins to
be prose; what follows is read again as text.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: environments of mathematics, commands that may hold words, CJK characters, units of line spacing
ENVIRONMENTS = frozenset("aligned align gathered gather cases matrix pmatrix bmatrix vmatrix Vmatrix array split equation".split())
WORDY = r"\\(?:text|mathrm|operatorname)\{[^{}]*\}"
CJK = "\u4e00-\u9fff"
CJK_MARKS = "\u3000-\u303f\uff00-\uffef"
UNITS = "pt|em|ex|mm|cm|in"

TOKEN = re.compile(r"(?P<code>```.*?```|`[^`]*`)|\\(?P<side>begin|end)\{(?P<env>[A-Za-z]+)\}|\\(?P<tex>[()\[\]])|\\.|(?P<dollars>\$\$?)", re.S)
CLOSER = {"(": (")", "inline"), "[": ("]", "display")}
SPACING = re.compile(rf"\\+\s*\[\d[\d.]*(?:{UNITS})\]")
DOUBLED = re.compile(r"\\\\([()\[\]])")


class Part(NamedTuple):
    kind: str  # text, code, inline, display or environment
    body: str
    closed: bool = True


def _prose_from(math: str) -> int:
    """Where prose begins in a formula that has no end: its line's end, or a CJK character outside of braces."""
    depth = 0
    for m in re.finditer(rf"\\.|[{{}}\n]|[{CJK}{CJK_MARKS}]", math, re.S):
        c = m[0]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
        elif c == "\n" or (len(c) == 1 and depth <= 0):
            return m.start()
    return len(math)


def parse(text: str) -> list[Part]:
    parts: list[Part] = []
    endless: set[str] = set()  # what has no end here has none further on
    at = plain = 0

    def end_of(kind: str, start: int, closer: str) -> tuple[int, int] | None:
        depth = 1
        for m in TOKEN.finditer(text, start):
            if kind == "environment" and m["env"] == closer:
                depth += 1 if m["side"] == "begin" else -1
                if not depth:
                    return m.end(), m.end()
            elif closer in (m["dollars"], m["tex"]):
                return m.start(), m.end()
        return None

    while m := TOKEN.search(text, at):
        at = m.end()
        if m["code"]:
            kind, closer, start = "code", "", m.start()
        elif m["env"] in ENVIRONMENTS and m["side"] == "begin":
            kind, closer, start = "environment", m["env"], m.start()
        elif m["tex"] in CLOSER:
            (closer, kind), start = CLOSER[m["tex"]], m.end()
        elif m["dollars"]:
            kind, closer, start = ("display" if m["dollars"] == "$$" else "inline"), m["dollars"], m.end()
        else:
            continue
        found = (m.end(), m.end()) if kind == "code" else None if closer in endless else end_of(kind, m.end(), closer)
        if not found:
            endless.add(closer)
        if not found and (kind == "environment" or m["tex"]):
            continue  # stays as it is written
        if plain < m.start():
            parts.append(Part("text", text[plain : m.start()]))
        if found:
            parts.append(Part(kind, text[start : found[0]]))
            at = plain = found[1]
        else:
            math = text[start : start + _prose_from(text[start:])].rstrip()
            parts.append(Part(kind, math, False))
            at = plain = start + len(math)
    if plain < len(text):
        parts.append(Part("text", text[plain:]))
    return parts


def issues(text: str | None) -> list[str]:
    """Names of what is wrong with a text's formulas, each once."""
    found = set()
    for p in parse(text or ""):
        if p.kind in ("inline", "display"):
            if not p.closed:
                found.add(f"odd_{p.kind}")
            elif not p.body.strip():
                found.add(f"empty_{p.kind}")
            if p.closed and re.search(f"[{CJK}]", re.sub(WORDY, "", p.body)):
                found.add("bare_words")
        elif p.kind == "environment":
            found.add("bare_environment")
    return sorted(found)


def sanitised(text: str | None) -> str | None:
    """All formulas in dollars, environments displayed, empty formulas gone and open ones closed."""
    if text is None:
        return None
    t = text.replace("\r\n", "\n").translate({0xFF04: "$", 0xFE69: "$"})
    t = DOUBLED.sub(r"\\\1", SPACING.sub(r"\\\\", t))
    out = []
    for p in parse(t):
        if p.kind == "environment":
            out.append(f"$$\n{p.body}\n$$")
        elif p.kind in ("text", "code"):
            out.append(p.body)
        elif p.body.strip():
            mark = "$" if p.kind == "inline" else "$$"
            out.append(f"{mark}{p.body}{mark}")
    return "".join(out)


def latex_issues(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(issues)

    return run(text)


def sanitise_latex(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(sanitised)

    return run(text)
