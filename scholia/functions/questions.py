"""Exercise texts: numbering, options, types and tags as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# fixed values: patterns and word lists that decide results
QUESTION_START = r"(?m)^\s*(?:第\s*\d+\s*题|\d+\s*[\.、．\)]|[一二三四五六七八九十]+\s*[、．\.])\s*"
OPTION = r"(?i)(?:^|\s|[（(])[A-D]\s*[\.、．\)]"
SUBQUESTION = r"(?:\(\s*\d+\s*\)|（\s*\d+\s*）)"
MATH = r"(\\frac|\\sum|\\int|\\lim|[=<>≤≥≈]|\$|\^|_)"
MARKER = r"[。？?；;]|[A-D]\s*[\.、．\)]|=|求|证|计算|判断|说明"
SPACES = r"[\s\x{3000}\x{A0}]+"
CHOICE, COMPOSITE, UNKNOWN = "选择题", "综合题", "未确定"
TYPES = (
    ("判断题", ("判断", "正确", "错误", "对错", "√", "×")),
    ("证明题", ("证明", "证：", "试证", "show that", "prove")),
    ("简答题", ("简述", "说明", "解释", "分析", "为什么", "含义")),
    ("计算题", ("计算", "求", "解", "确定", "最优解", "最小", "最大")),
)
CONCEPT_WORDS = (
    ("极限", ("极限", "lim", "趋于", "无穷小", "无穷大")),
    ("导数", ("导数", "求导", "微分", "derivative", "切线", "法线")),
    ("积分", ("积分", "定积分", "不定积分", "原函数", "换元", "分部积分")),
    ("矩阵", ("矩阵", "行列式", "特征值", "特征向量", "秩", "逆矩阵")),
    ("概率", ("概率", "随机变量", "分布", "期望", "方差", "密度函数")),
    ("优化", ("优化", "最优", "目标函数", "约束", "规划", "极值", "拉格朗日")),
    ("线性规划", ("线性规划", "单纯形", "可行域", "基变量", "非基变量")),
    ("动态规划", ("动态规划", "状态转移", "最优子结构", "阶段", "递推")),
    ("图论", ("图", "路径", "最短路", "生成树", "网络", "节点", "边")),
    ("排队论", ("排队", "到达率", "服务率", "泊松", "等待时间")),
)
HARD = ("证明", "最优", "约束", "特征值", "动态规划")


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def any_of(text: Column, needles) -> Column:
    hit = F.lit(False)
    for n in needles:
        hit = hit | F.contains(text, F.lit(n.lower()))
    return hit


def hits(text: Column, needles) -> Column:
    """How many of the needles the lower-cased text contains."""
    total = F.lit(0)
    for n in needles:
        total = total + F.contains(text, F.lit(n.lower())).cast("int")
    return total


def fingerprint(text: Column) -> Column:
    """SHA-256 of the lower-cased text without white space; blank texts have none."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SPACES, "")
    return F.when(bare != "", F.sha2(bare, 256))


def marks(text: Column) -> Column:
    """What the patterns find in a text, each looked for once: counts of options, sub-questions and starts; any marker, any formula."""
    brackets = F.contains(text, F.lit("(")) | F.contains(text, F.lit("（"))
    return F.struct(
        count(text, OPTION).alias("options"), F.when(brackets, count(text, SUBQUESTION)).otherwise(0).alias("parts"), count(text, QUESTION_START).alias("starts"),
        text.rlike(MARKER).alias("marked"), text.rlike(MATH).alias("math"),
    )


def split_confidence(text: Column, numbered: Column, m: Column) -> Column:
    """How surely a block is one whole question, 0.05 to 0.98; ``m`` are its ``marks``."""
    score = (
        F.lit(0.25) + F.when(numbered, 0.35).otherwise(0.15) + F.when(F.length(text) >= 30, 0.1).otherwise(-0.12)
        + F.when(m["options"] >= 3, 0.12).otherwise(0.0) + F.when(m["parts"] > 0, 0.05).otherwise(0.0)
        - F.when(m["starts"] > 1, 0.18).otherwise(0.0) - F.when(F.length(text) > 2500, 0.18).otherwise(0.0)
        - F.when(~m["marked"], 0.08).otherwise(0.0)
    )
    return F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.98), F.round(score, 6))), 2)


def question_type(text: Column, m: Column | None = None) -> Column:
    m = marks(text) if m is None else m

    def of(low: Column) -> Column:
        out = F.when(m["options"] >= 3, CHOICE)
        for name, needles in TYPES:
            out = out.when(any_of(low, needles), name)
        return out.when(m["parts"] >= 2, COMPOSITE).otherwise(UNKNOWN)

    return let(F.lower(text), of)


def concept_tags(text: Column, most: int = 5) -> Column:
    """The concepts with most keyword hits, in list order on ties."""
    scored = let(F.lower(text), lambda low: F.array(*(F.struct((-hits(low, ks)).alias("s"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, (c, ks) in enumerate(CONCEPT_WORDS))))
    return F.slice(F.transform(F.sort_array(F.filter(scored, lambda x: x["s"] < 0)), lambda x: x["c"]), 1, most)


def difficulty(text: Column, m: Column | None = None) -> Column:
    m = marks(text) if m is None else m
    n = F.lit(2) + (F.length(text) > 180).cast("int") + (m["parts"] >= 2).cast("int") + m["math"].cast("int") + any_of(F.lower(text), HARD).cast("int")
    return F.greatest(F.lit(1), F.least(F.lit(5), n))
