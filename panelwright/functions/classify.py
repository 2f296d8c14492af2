"""Keyword classifier: ordered rules over the lower-cased name, the first match wins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, Sequence[str]]]

# Class names and keywords, in order of precedence.
DEFAULT_RULES: Rules = (
    ("cash", ("货币", "快线", "添益", "零钱")),
    ("bond", ("债", "国债", "信用", "短融", "中短")),
    ("commodity", ("黄金", "有色", "商品", "原油", "油气")),
    ("overseas", ("恒生", "港股", "纳指", "纳斯达克", "标普", "美国", "全球", "qdii")),
    ("equity_dividend", ("红利", "股息", "价值")),
    (
        "equity_broad",
        ("沪深", "中证", "上证", "深证", "创业板", "科创", "50etf", "300", "500", "1000"),
    ),
)
DEFAULT_CLASS = "equity_thematic"
UNKNOWN_CLASS = "unknown"
CASH = "cash"
DEFENSIVE_CLASSES = ("cash", "bond")


def asset_class(name: Column, rules: Rules = DEFAULT_RULES, default: str = DEFAULT_CLASS) -> Column:
    text = F.lower(F.coalesce(name, F.lit("")))
    branches = [
        (reduce(Column.__or__, [F.contains(text, F.lit(word)) for word in words]), label)
        for label, words in rules
    ]
    (condition, label), *rest = branches
    chain = F.when(condition, F.lit(label))
    for condition, label in rest:
        chain = chain.when(condition, F.lit(label))
    return chain.otherwise(F.lit(default))
