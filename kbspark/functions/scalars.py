"""Scalar functions as column expressions; a null argument gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A search token: one Chinese character, or an ASCII run that may be joined by . _ / -
SEARCH_TOKEN = r"[一-鿿]|[a-z0-9]+(?:[._/-][a-z0-9]+)*"
SEARCH_TOKEN_SQL = r"[\x{4E00}-\x{9FFF}]|[a-z0-9]+(?:[._/-][a-z0-9]+)*"


def same_dashes(text: Column) -> Column:
    """Non-breaking hyphen, en dash and em dash as a plain hyphen."""
    return F.translate(text, "‑–—", "---")


def search_tokens(text: Column) -> Column:
    """The search tokens of a text in order, in lower case; null gives an empty array."""
    return F.regexp_extract_all(F.lower(same_dashes(F.coalesce(text, F.lit("")))), F.lit(SEARCH_TOKEN), F.lit(0))


def search_tokens_sql(text: str) -> str:
    return f"regexp_extract_all(lower(translate(coalesce({text}, ''), '‑–—', '---')), '{SEARCH_TOKEN_SQL}')"


def word_set(text: Column) -> Column:
    """Distinct words and Chinese characters, as names and questions are compared by."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9_]+|[一-鿿]"), F.lit(0)))


def word_set_sql(text: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9_]+|[\x{{4E00}}-\x{{9FFF}}]'))"


def example_words(text: Column) -> Column:
    """Distinct words (also with dots), Chinese characters, and neighbouring ones within a run, as examples are compared by."""
    low = F.lower(F.coalesce(text, F.lit("")))
    runs = F.regexp_extract_all(low, F.lit("[一-鿿]+"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9_.]+"), F.lit(0)), F.regexp_extract_all(low, F.lit("[一-鿿]"), F.lit(0)), pairs))


def example_words_sql(text: str) -> str:
    low, cjk = f"lower(coalesce({text}, ''))", r"[\x{4E00}-\x{9FFF}]"
    pairs = f"flatten(list_transform(regexp_extract_all({low}, '{cjk}+'), lambda r: list_transform(range(1, length(r)), lambda i: substring(r, i, 2))))"
    return f"list_distinct(list_concat(regexp_extract_all({low}, '[a-z0-9_.]+'), regexp_extract_all({low}, '{cjk}'), {pairs}))"


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """Those of the words that a text has, in any case, in their order; none for null."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.coalesce(F.contains(F.lower(text), F.lower(w)), F.lit(False)))


def parse_number(text: Column) -> Column:
    """A number with thousands commas or a currency sign; anything else is null."""
    return F.regexp_replace(F.trim(text), "[,$￥€]", "").try_cast("double")


def normal_date(text: Column) -> Column:
    """yyyy-MM-dd of a date with - or / and any time behind it; null where there is no such day."""
    part = lambda i: F.regexp_extract(F.trim(text), r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[ T]\d{1,2}:\d{2}(?::\d{2})?)?$", i)
    whole = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    return F.when(part(1) != "", F.try_to_date(whole, "yyyy-MM-dd"))


def identifier(header: Column, place: Column) -> Column:
    """A header as a safe name: lower case, runs of other signs as an underscore; col_<place> where it then begins with no letter or underscore. Null is empty."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(header, F.lit("")))), "[^0-9a-z_]+", "_"), "^_+|_+$", ""), "_{2,}", "_")
    return F.when(name.rlike("^[a-z_]"), name).otherwise(F.concat_ws("_", F.lit("col"), place.cast("string")))


def whole_number(text: Column) -> Column:
    """The value of a text of digits, with any sign, zeros and outer spaces; null for other text or beyond 18 digits."""
    bare = F.regexp_replace(F.trim(text), "^([+-]?)0+(?=[0-9])", "$1")
    return F.when(bare.rlike("^[+-]?[0-9]{1,18}$"), bare.cast("long"))


def cited_numbers(text: Column) -> Column:
    """The distinct numbers of citations as [3], [参考 3] or 【参考 3】, ascending."""
    found = F.regexp_extract_all(text, F.lit(r"(?:\[|【)\s*(?:参考\s*)?(\d{1,9})\s*(?:\]|】)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def plain_path(path: Column) -> Column:
    """A path with its numbers and long hexadecimal parts as {id}."""
    return F.array_join(F.transform(F.split(path, "/"), lambda p: F.when(p.rlike("^([0-9]+|[0-9a-fA-F]{8,}|[0-9a-fA-F-]{32,})$"), "{id}").otherwise(p)), "/")


def base_name(path: Column) -> Column:
    """The last part of a path with slashes of either kind; null where that is empty, . or .., or longer than 512 characters."""
    last = F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)
    return F.when(~last.isin("", ".", "..") & (F.length(last) <= 512), last)


def chunk_id(source: Column, text: Column) -> Column:
    """A stable id of a chunk from its source and beginning."""
    return F.md5(F.concat_ws(":", source, F.substring(text, 1, 200)))


def version_chunk_id(version: Column, place: Column, text: Column) -> Column:
    """A stable id of a chunk of one version of a document, from its place and whole text."""
    return F.md5(F.concat_ws(":", version.cast("string"), place.cast("string"), text))
