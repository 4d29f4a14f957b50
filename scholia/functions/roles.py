"""Semantic roles of chunks by patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# fixed values: role order, aliases and patterns decide results
PRIORITY = ("definition", "theorem", "property", "formula", "derivation", "proof", "algorithm", "example", "exercise")
ALIASES = {"axiom": "theorem", "lemma": "theorem", "corollary": "theorem", "proposition": "theorem", "method": "algorithm", "remark": "reference", "mention": "reference"}
PATTERNS = {
    "definition": (r"(定义|称为|叫做|记为|definition\b)", r"(若|如果).{0,40}(则称|称)"),
    "theorem": (r"(定理|命题|引理|推论|theorem\b|lemma\b|corollary\b|proposition\b)",),
    "property": (r"(性质|结论|特点|充分必要|充要条件|property\b)",),
    "formula": (r"(公式|恒等式|方程|表达式|formula\b)",),
    "derivation": (r"(推导|推得|可得|得到|因此|所以|由.*得|derivation\b)",),
    "proof": (r"(^|\n)\s*(证明|证)[:：]", r"proof\b"),
    "algorithm": (r"(算法|步骤|流程|方法|procedure\b|algorithm\b)", r"(第一步|第二步|步骤\s*\d+)"),
    "example": (r"(^|\n)\s*(例|例题|例\s*\d+|example\b)", r"(^|\n)\s*(解|解析)[:：]"),
    "exercise": (r"(^|\n)\s*(练习|习题|思考题|作业|exercise\b)", r"(^|\n)\s*\d+[.、]\s*证明"),
}
MATH_MARKS = ("$", r"\(", r"\[", "=", r"\frac", r"\sum", r"\int", r"\lim", r"\begin")
EQUATION = r"[A-Za-z]\s*=\s*[-+]?\w"


def classify(text: Column) -> Column:
    """The role with most pattern hits, in order of PRIORITY on ties; none gives ``reference``."""
    def maybe(t: Column) -> Column:
        """False where no pattern can match: no CJK character and none of the patterns' Latin words, a cheap test for most texts."""
        low, hit = F.lower(t), t.rlike(r"[\x{4e00}-\x{9fff}]")
        for word in sorted({w for ps in PATTERNS.values() for p in ps for w in re.findall("[a-z]{5,}", p)}):
            hit = hit | F.contains(low, F.lit(word))
        return hit

    def counted(t: Column) -> Column:
        n = let(maybe(t), lambda hit: F.struct(*(F.when(hit, sum((F.regexp_count(t, F.lit(f"(?im){p}")) for p in ps), F.lit(0))).otherwise(0).alias(r) for r, ps in PATTERNS.items())))
        marks = sum(((F.length(t) - F.length(F.replace(t, F.lit(m), F.lit("")))) / len(m) for m in MATH_MARKS), F.lit(0))
        formula = F.when((marks >= 3) | ((F.length(t) < 1200) & t.rlike(EQUATION)), 1).otherwise(0)
        return F.struct(n.alias("n"), formula.alias("equation"))

    def best(c: Column) -> Column:
        n, more = c["n"], {"formula": c["equation"]}
        more["theorem"] = F.when((n["theorem"] > 0) & (n["proof"] > 0), 1).otherwise(0)
        return F.array_min(F.array(*(F.struct((-(n[r] + more.get(r, F.lit(0)))).alias("s"), F.lit(i).alias("i"), F.lit(r).alias("r")) for i, r in enumerate(PRIORITY))))

    scored = let(let(F.trim(F.coalesce(text, F.lit(""))), counted), best)
    return let(scored, lambda b: F.when(b["s"] < 0, b["r"]).otherwise("reference"))


def normalise(role: Column) -> Column:
    r = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    out = r
    for a, b in ALIASES.items():
        out = F.when(r == a, b).otherwise(out)
    return F.when(out.isin(*PRIORITY), out).otherwise("reference")
