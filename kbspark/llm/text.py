"""Column expressions on text that several operators here share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and signs that stand for "no value", compared in lower case without outer punctuation.
NO_VALUE = [
    "n/a", "n.a", "na", "n. a", "none", "null", "nil", "nan", "undefined", "tbd", "tba", "todo", "no value", "no data", "not available", "not applicable", "placeholder",
    "k. a", "k.a", "keine angabe", "entfällt", "s.o", "s/o", "néant", "sans objet", "non disponible", "s/d", "s.d", "sin datos", "sin valor", "no disponible",
    "无", "空", "暂无", "待定", "无内容", "无数据", "不适用", "空白", "未填写", "暂缺",
]

_TAG = r"(?s)<!--.*?-->|</?[A-Za-z][^<>]*>|&(nbsp|#160|lt|gt|amp|quot|zwnj|zwj|emsp|ensp);"
_TAG_SQL = _TAG.replace("[^<>]*>", "[^<>]{0,200}>")  # the twin keeps its limit
_FENCE = r"```[A-Za-z0-9_+-]*"
_NAMED = r"!?\[\s*\]\(\s*\)"


def is_empty(text: Column) -> Column:
    """True for null, for text without a letter or digit, and where nothing is left but markup or a sign for "no value"."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, _TAG, " "), _FENCE, " "), _NAMED, " ")
    core = F.lower(F.regexp_replace(bare, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return text.isNull() | (core == "") | core.isin(*NO_VALUE)


def speaker(role: Column) -> Column:
    """`user` or `assistant` for the spellings of a role, else null."""
    name = F.lower(F.regexp_replace(role, r"^[\s　]+|[\s　]+$", ""))
    return F.when(name.isin("user", "human"), "user").when(name.isin("assistant", "bot", "ai"), "assistant")


def is_empty_sql(text: str) -> str:
    """The same rule in DuckDB's SQL."""
    bare = f"regexp_replace(regexp_replace(regexp_replace({text}, '{_TAG_SQL}', ' ', 'g'), '{_FENCE}', ' ', 'g'), '{_NAMED}', ' ', 'g')"
    core = rf"lower(regexp_replace({bare}, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'))"
    words = ", ".join(f"'{w}'" for w in NO_VALUE)
    return f"({text} IS NULL OR {core} = '' OR {core} IN ({words}))"


def speaker_sql(role: str) -> str:
    name = rf"lower(regexp_replace({role}, '^[\s\x{{3000}}]+|[\s\x{{3000}}]+$', '', 'g'))"
    return f"CASE WHEN {name} IN ('user', 'human') THEN 'user' WHEN {name} IN ('assistant', 'bot', 'ai') THEN 'assistant' END"
