"""p5: noise in the text of scanned pages, found and mended."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kbspark.session import cut
from kbspark.sources.tables import table

#: Lines from either edge of a page among which headers, footers and page numbers are looked for.
EDGE = 3
#: Pages that a paragraph may go on over, a power of two.
MOST_PAGES = 64
#: A word is misread if one that looks alike is so many times as frequent in the corpus, and so many times in text that was never scanned.
RATIO, CLEAN_RATIO = 20, 1000
#: Letters and signs that scanning takes for one another, as what they are folded to.
_LETTERS = ("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy")
_LIGATURES = {"ﬁ": "fi", "ﬂ": "fl"}
_PAIRS = {"1": "l", "cl": "d", "rn": "m", "vv": "w", "ii": "u"}
_LOOKS = ("co05ul16bqf", "eaasniihhgt")
#: Signs that a scan leaves between words, and signs for a split word.
_STRAY = "~^|¦•`´¨"
_SIGNS = "\\-‐\u00ad¬"
#: Words that stand beside a page's number.
_LABELS = {"p", "pp", "pag", "pág", "page", "seite", "s", "página", "pagina", "bl", "blatt", "of", "von", "de", "sur", "第", "页", "共", "页码"}
_NUMBER = regex.compile(r"[0-9lIOoSsBb|]*[0-9][0-9lIOoSsBb|]*|l{1,2}|[IO]")
_ROMAN = regex.compile(r"(?i)(?=.)(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})")
_TOKEN = regex.compile(r"[\p{L}\p{N}|--[一-鿿]]+|[一-鿿]+", regex.V1)
_AS_DIGITS = str.maketrans("lI|OoSsBb", "111005586")
_WORDS, _HYPHENED = r"[\p{IsLatin}\p{N}]++", r"\p{IsLatin}++-(?:\p{IsLatin}++|(?= ))"


def looks(word: Column) -> Column:
    """What words have in common that a scan takes for one another: with pairs of letters taken for one letter, without,
    and with 6 for é or ö. The argument is in lower case; words that share a look look alike."""
    bare = F.translate(word, *_LETTERS)
    for a, b in _LIGATURES.items():
        bare = F.replace(bare, F.lit(a), F.lit(b))
    paired = bare
    for a, b in _PAIRS.items():
        paired = F.replace(paired, F.lit(a), F.lit(b))
    return F.array_distinct(F.array(*[F.translate(x, *_LOOKS) for x in (paired, bare, F.translate(bare, "6", "e"), F.translate(bare, "6", "o"))]))


def _fold(word: str) -> str:
    out = word.lower().translate(str.maketrans(*_LETTERS))
    for a, b in (_LIGATURES | _PAIRS).items():
        out = out.replace(a, b)
    return out.translate(str.maketrans(*_LOOKS))


_FOLDED_LABELS = {_fold(x) for x in _LABELS}


def _roman(token: str) -> int | None:
    if not _ROMAN.fullmatch(token):
        return None
    values = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in token.lower()]
    return sum(-v if v < max(values[k:]) else v for k, v in enumerate(values))


def read_edge(line: str) -> tuple[int | None, bool, str | None]:
    """Of a line at a page's edge: its number if it holds nothing else, whether that is Roman, and else what it is compared by."""
    found = _TOKEN.findall(line)
    numbers = [(k, t) for k, t in enumerate(found) if _NUMBER.fullmatch(t)]
    rest = [t for t in found if not _NUMBER.fullmatch(t)]
    if 1 <= len(numbers) <= 2 and all(_fold(t) in _FOLDED_LABELS for t in rest):
        return int(numbers[0][1].translate(_AS_DIGITS)), False, None
    if not numbers and len(found) == 1:
        value = _roman(found[0]) or _roman(found[0].replace("l", "i").replace("1", "i"))
        if value:
            return value, True, None
    # A page's number beside the text is no part of the header; other numbers are.
    inner = [t for k, t in enumerate(found) if not (k in (0, len(found) - 1) and (_NUMBER.fullmatch(t) or (t.islower() and _roman(t))))]
    key = "".join(map(_fold, inner))
    return None, False, key if len(key) >= 4 and rest else None


def page_lines(docs: DataFrame) -> DataFrame:
    """The lines with text of every page: doc_id, source, page, line_no (from 1), line, top and bottom (rank from the edges), gap (after a blank line).

    docs: doc_id, text, source, physical_page, doc_type. Null texts and ids and other types have no line.
    """
    pages = docs.filter("doc_type = 'page' AND text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "source", F.col("physical_page").alias("page"), F.split("text", "\n").alias("ls"))
    full = F.filter(F.sequence(F.lit(0), F.size("ls") - 1), lambda i: F.get("ls", i).rlike(r"[^\s　]"))
    # Lines are built within the page, so that none carries the whole page along.
    line = lambda at, k: F.struct(
        (at + 1).alias("line_no"), F.get("ls", at).alias("line"), k.alias("top"), (F.size("full") - k - 1).alias("bottom"), F.coalesce(at - F.get("full", k - 1) > 1, F.lit(False)).alias("gap")
    )
    return pages.withColumn("full", full).select("doc_id", "source", "page", F.inline(F.transform("full", line)))


def edge_lines(lines: DataFrame) -> DataFrame:
    """Running headers and footers, and page numbers: doc_id, line_no, kind.

    A page number fits the sequence of its file: number minus page is the same on another page too (or no other page of
    the file has one). A header or footer is a line that comes again at an edge of another page of the file, but for
    misreadings, one other letter, page numbers and case; ends of sentences must come on two pages in five. Neither has
    text between itself and the edge. Only counts per file and line are shuffled and joined; no file is gathered.
    """
    parse = F.pandas_udf(lambda s: pd.DataFrame([read_edge(x) for x in s], columns=["number", "roman", "key"]).astype({"number": "Int32"}), "number int, roman boolean, key string")
    edge = lines.filter((F.col("top") < EDGE) | (F.col("bottom") < EDGE)).select("doc_id", "source", "page", "line_no", "top", "bottom", F.col("line").rlike(r"[.,;。，；]\s*$").alias("stop"), parse("line").alias("x"))
    edge = cut(edge.select("doc_id", "source", "page", "line_no", "top", "bottom", "stop", "x.number", "x.roman", "x.key"))

    numbered = edge.filter(F.col("number").isNotNull() & F.col("page").isNotNull()).withColumn("step", F.col("number") - F.col("page"))
    per_step = numbered.groupBy("source", "roman", "step").agg(F.countDistinct("page").alias("pages"))
    per_file = numbered.groupBy("source").agg(F.countDistinct("page").alias("any"))
    good = per_step.join(per_file, "source").filter("pages > 1 OR any = 1").select("source", "roman", "step")
    numbers = numbered.join(good, ["source", "roman", "step"]).select("doc_id", "line_no", F.lit("page_number").alias("kind"))

    keyed = edge.filter(F.col("key").isNotNull())
    per_key = keyed.groupBy("source", "key").agg(F.countDistinct("page").alias("pages"))
    in_file = edge.groupBy("source").agg(F.countDistinct("page").alias("all"))
    again = per_key.filter("pages > 1").join(in_file, "source").select("source", "key", (F.col("pages") >= 0.4 * F.col("all")).alias("often"))
    same = keyed.join(again, ["source", "key"]).filter(~F.col("stop") | F.col("often")).select("doc_id", "line_no")
    # A line that differs from one of these in one letter has one half in common with it.
    near = keyed.join(again, ["source", "key"], "left_anti").filter(~F.col("stop")).select("doc_id", "line_no", "source", F.col("key").alias("own"), F.length("key").alias("size"), F.explode(_halves("key")).alias("half"))
    known = again.select("source", F.col("key").alias("other"), F.length("key").alias("size"), F.explode(_halves("key")).alias("half"))
    near = near.join(known, ["source", "size", "half"]).filter(_one_off("own", "other")).select("doc_id", "line_no")
    headers = same.unionByName(near).distinct().withColumn("kind", F.lit("running_header"))
    marked = numbers.unionByName(headers).dropDuplicates(["doc_id", "line_no"])

    # Only what lies outside all text.
    ranked = edge.join(marked, ["doc_id", "line_no"], "left")
    text = ranked.filter(F.col("kind").isNull()).groupBy("doc_id").agg(F.min("top").alias("first"), F.min("bottom").alias("last"))
    outside = F.col("first").isNull() | (F.col("top") < F.col("first")) | (F.col("bottom") < F.col("last"))
    return ranked.filter(F.col("kind").isNotNull()).join(text, "doc_id", "left").filter(outside).select("doc_id", "line_no", "kind").dropDuplicates(["doc_id", "line_no"])


def _halves(key: str) -> Column:
    """The hashes of both halves of the key, each with its side."""
    middle = F.floor(F.length(key) / 2).cast("int")
    return F.array(F.xxhash64(F.lit(1), F.substring(F.col(key), F.lit(1), middle)), F.xxhash64(F.lit(2), F.substring(F.col(key), middle + 1, F.length(key))))


def _one_off(a: str, b: str, parts: int = 64) -> Column:
    """Whether two texts of one length differ in one character. They are compared part by part, as a distance takes the square of the length."""
    step = F.ceil(F.length(a) / parts).cast("int")
    cut_up = lambda c: F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.substring(F.col(c), i * step + 1, step))
    other = F.filter(F.arrays_zip(cut_up(a).alias("a"), cut_up(b).alias("b")), lambda x: x["a"] != x["b"])
    first = F.get(other, F.lit(0))
    return (F.size(other) == 1) & (F.levenshtein(first["a"], first["b"]) == 1)


def body_lines(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """The other lines, each with the text line that follows it in the file: + next_doc, next_no, next (null after the last one).

    Within a page by a window over the page; from page to page by a join of each page's last line with the first of the next.
    """
    body = lines.join(edges.select("doc_id", "line_no"), ["doc_id", "line_no"], "left_anti").repartition("doc_id").dropDuplicates(["doc_id", "line_no"])
    order = W.partitionBy("doc_id").orderBy("line_no")
    body = cut(body.withColumns({"after_no": F.lead("line_no").over(order), "after": F.lead("line").over(order), "rank": F.row_number().over(order)}))
    firsts = body.filter("rank = 1 AND page IS NOT NULL").groupBy("source", (F.col("page") - 1).alias("page")).agg(F.min(F.struct("doc_id", "line_no", "line")).alias("first"))
    linked = body.filter(F.col("after_no").isNull()).join(firsts, ["source", "page"], "left").select(*body.columns, "first")
    inside = body.filter(F.col("after_no").isNotNull()).withColumn("first", F.struct(F.col("doc_id"), F.col("after_no").alias("line_no"), F.col("after").alias("line")))
    both = inside.select(*body.columns, "first").unionByName(linked)
    return both.select("doc_id", "source", "page", "line_no", "line", "gap", "rank", F.col("first.doc_id").alias("next_doc"), F.col("first.line_no").alias("next_no"), F.col("first.line").alias("next"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """The words of the whole corpus in lower case: word, n, clean (n in text that was never scanned).

    Also hyphened pairs, and words with an open hyphen as in "in- and outputs". Codes (capitals, hyphen, number) are left out.
    """
    text = F.lower(F.regexp_replace("text", r"[A-Z]{2,4}-[\p{L}\p{N}]+", " "))
    found = F.regexp_extract_all(text, F.lit(f"{_HYPHENED}|{_WORDS}"), F.lit(0))
    words = F.flatten(F.transform(found, lambda w: F.when(w.contains("-"), F.concat(F.array(w), F.filter(F.split(w, "-"), lambda p: p != ""))).otherwise(F.array(w))))
    scanned = F.coalesce(F.col("doc_type") == "page", F.lit(False))
    found = docs.filter(F.col("text").isNotNull()).select(scanned.alias("scanned"), F.explode(words).alias("word"))
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("scanned"), 0).otherwise(1)).alias("clean"))


def best_words(words: DataFrame) -> DataFrame:
    """Per look the most frequent word that was never scanned: look, best, often."""
    seen = words.filter("clean > 0").select(F.explode(looks(F.col("word"))).alias("look"), "word", "clean")
    return seen.groupBy("look").agg(F.max_by("word", F.struct("clean", "word")).alias("best"), F.max("clean").alias("often"))


def misread_words(words: DataFrame, best: DataFrame) -> DataFrame:
    """The words that are misread, with what they should be: word, best."""
    # Only words with a letter that are rare in text that was never scanned can be.
    asked = words.filter(F.col("word").rlike(r"\p{L}") & ~F.col("word").contains("-") & (F.col("clean") * RATIO <= F.col("n"))).select("word", "n", "clean", F.explode(looks(F.col("word"))).alias("look"))
    rare = (F.col("n") * RATIO <= F.col("often")) & (F.col("clean") * CLEAN_RATIO <= F.col("often")) & (F.col("word") != F.col("best"))
    figure = F.col("word").rlike(r"^[0-9loisb|]*[0-9][0-9loisb|]*$") & F.col("word").rlike("[a-z|]")
    judged = asked.join(best, "look", "left").withColumn("like", F.coalesce(rare & (F.length("word") > 1), F.lit(False)))
    right = F.when(F.col("like"), F.col("best")).otherwise(F.translate("word", "loisb|", "101581"))
    return judged.filter(F.col("like") | figure).groupBy("word").agg(F.max_by(right, F.struct("like", "often")).alias("best"))


def split_words(body: DataFrame, best: DataFrame) -> DataFrame:
    """The lines that end within a word: doc_id, line_no, next_doc, next_no, left, right, best, often (what the word is, as far as the corpus knows it).

    Left and right are letters around the break, in lower case. With a plain hyphen the corpus decides between one word,
    a hyphened pair and an open hyphen by how often it has each, however misread; a word that it has in no form is taken
    as split if it goes on in lower case. Other signs are no part of a word.
    """
    ends = body.filter(F.col("line").rlike(rf"\p{{L}}[{_SIGNS}] ?$") & F.col("next").rlike(r"^\s*\p{L}"))
    left, right = F.regexp_extract("line", rf"(\p{{L}}+)[{_SIGNS}] ?$", 1), F.regexp_extract("next", r"^\s*(\p{L}+)", 1)
    cases = ends.select(
        "doc_id", "line_no", "next_doc", "next_no", F.lower(left).alias("left"), F.lower(right).alias("right"), F.col("line").rlike("- ?$").alias("plain"), right.rlike(r"^\p{Lu}").alias("capital")
    )
    forms = F.array(*[F.struct(F.lit(i).alias("form"), looks(x).alias("ls")) for i, x in enumerate(_forms())])
    asked = cases.withColumn("f", F.explode(forms)).select(*cases.columns, "f.form", F.explode("f.ls").alias("look"))
    found = asked.join(best, "look", "left").groupBy(*cases.columns)
    of = lambda form: F.max(F.when(F.col("form") == form, F.struct("often", "best")))
    known = found.agg(of(0).alias("one"), of(1).alias("pair"), of(2).alias("open")).select(*cases.columns, "one.best", *[F.coalesce(f"{x}.often", F.lit(0)).alias(n) for x, n in (("one", "often"), ("pair", "pairs"), ("open", "opens"))])
    split = ~F.col("plain") | F.when(F.col("often") > 0, F.col("often") >= F.col("pairs")).otherwise((F.col("pairs") == 0) & (F.col("opens") == 0) & ~F.col("capital"))
    return known.filter(split).select("doc_id", "line_no", "next_doc", "next_no", "left", "right", "best", "often")


def _forms() -> list[Column]:
    """The forms that a word around a break can have: one word, a hyphened pair, an open hyphen."""
    return [F.concat("left", "right"), F.concat_ws("-", "left", "right"), F.concat("left", F.lit("-"))]


def misread_places(body: DataFrame, splits: DataFrame, misread: DataFrame, words: DataFrame) -> DataFrame:
    """What is misread in the text lines: doc_id, line_no, word, best (null where a sign is too much, or a code is wrong).

    Words cut by a line end are judged as wholes, and count for the line with the wrong part.
    """
    none = F.lit(None).cast("string")
    stray = body.filter(F.col("line").rlike(rf"(^|[^|])\s[{_STRAY.replace('^', chr(92) + '^')}]\s([^|]|$)|[~^¦`´¨]")).select("doc_id", "line_no", none.alias("word"), none.alias("best"))
    tail = splits.select(F.col("doc_id"), F.col("line_no"), F.lit(True).alias("cut_end"))
    head = splits.select(F.col("next_doc").alias("doc_id"), F.col("next_no").alias("line_no"), F.lit(True).alias("cut_start")).distinct()
    marked = body.select("doc_id", "line_no", "line").join(tail, ["doc_id", "line_no"], "left").join(head, ["doc_id", "line_no"], "left")
    plain = F.regexp_replace("line", r"[A-Z]{2,4}-[0-9lOISB]+", " ")
    plain = F.when(F.col("cut_end"), F.regexp_replace(plain, rf"\p{{L}}+[{_SIGNS}] ?$", "")).otherwise(plain)
    plain = F.when(F.col("cut_start"), F.regexp_replace(plain, r"^\s*\p{L}+", "")).otherwise(plain)
    # Chinese lines end anywhere, so a Latin word at their edges may be a part.
    plain = F.when(plain.rlike("[一-鿿]"), F.regexp_replace(plain, r"^[\p{IsLatin}\p{N}_]+|[\p{IsLatin}\p{N}_]+$", "")).otherwise(plain)
    used = marked.select("doc_id", "line_no", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(plain), F.lit(_WORDS), F.lit(0)))).alias("word"))
    wrong = used.join(misread, "word").select("doc_id", "line_no", "word", "best")
    code = body.filter(F.col("line").rlike(r"[A-Z]{2,4}-(?=[0-9]*[lOISB])[0-9lOISB]*[0-9][0-9lOISB]*(?![\p{L}\p{N}])")).select("doc_id", "line_no", none.alias("word"), none.alias("best"))
    wholes = splits.withColumn("word", F.concat("left", "right")).join(words, "word", "left").na.fill(0, ["n", "clean"])
    rare = (F.col("often") >= RATIO) & (F.col("n") * RATIO <= F.col("often")) & (F.col("clean") * CLEAN_RATIO <= F.col("often"))
    start, end = F.expr("left(best, length(left))"), F.expr("right(best, length(right))")
    parts = wholes.filter(rare & (F.col("word") != F.col("best")))
    early = parts.filter(F.col("left") != start).select("doc_id", "line_no", F.col("left").alias("word"), start.alias("best"))
    late = parts.filter(F.col("right") != end).select(F.col("next_doc").alias("doc_id"), F.col("next_no").alias("line_no"), F.col("right").alias("word"), end.alias("best"))
    return stray.unionByName(wrong).unionByName(code).unionByName(early).unionByName(late)


class Findings(NamedTuple):
    """What is wrong with the pages, as tables in the shared folder."""

    edges: DataFrame
    body: DataFrame
    splits: DataFrame
    misread: DataFrame


def read_pages(docs: DataFrame) -> Findings:
    docs = docs.select("doc_id", "text", "source", "physical_page", "doc_type")
    lines = page_lines(docs)
    edges = cut(edge_lines(lines))
    body = body_lines(lines, edges)
    words = cut(vocabulary(docs))
    best = best_words(words)
    splits = cut(split_words(body, best))
    return Findings(edges, body, splits, misread_places(body, splits, misread_words(words, best), words))


def disturbed_lines(docs: DataFrame) -> DataFrame:
    """Every disturbed line of the pages once per kind: doc_id, line_no, kind.

    docs: doc_id, text, source, physical_page, doc_type. Pages without a source or number are read alone: they have no
    page number in sequence, and their words go on only within the page. Other columns are ignored; repeated rows are
    one page; an empty table has no line. All text of docs counts for the vocabulary, whatever its type.
    """
    found = read_pages(docs)
    as_case = lambda df, kind: df.select("doc_id", F.col("line_no").cast("int").alias("line_no"), kind.alias("kind"))
    split = as_case(found.splits.select("doc_id", "line_no").distinct(), F.lit("split_word"))
    return as_case(found.edges, F.col("kind")).unionByName(split).unionByName(as_case(found.misread.select("doc_id", "line_no").distinct(), F.lit("misread")))


def mend_pages(docs: DataFrame) -> DataFrame:
    """The running text of every file: doc_id, source, page and place (where a paragraph begins), text.

    Headers and page numbers are gone, split words whole, misread words spelled as the corpus has them, stray signs
    dropped. A paragraph ends at a blank line or before a numbered heading, and goes on over the page where its last
    line has no stop: from the first row of a page (by doc_id) to that of the next. Other rows of the same page are
    another text, and stand for themselves; so do rows without a source or number. docs as in disturbed_lines.

    Pages are gathered one at a time, paragraphs over pages by joins of neighbouring pages. Where one would go on over
    more than MOST_PAGES pages, as in a file without stops, it ends at every page whose number is a multiple of that; so
    no file is gathered, and no text is lost.
    """
    found = read_pages(docs)
    fixes = found.misread.filter("word IS NOT NULL").groupBy("doc_id", "line_no").agg(F.collect_set(F.struct("word", "best")).alias("fixes"))
    ends = found.splits.select("doc_id", "line_no", F.lit(True).alias("split")).distinct()
    lines = found.body.join(fixes, ["doc_id", "line_no"], "left").join(ends, ["doc_id", "line_no"], "left")
    pages = lines.groupBy("doc_id", "source", "page").agg(F.sort_array(F.collect_list(F.struct("line_no", "line", "gap", "fixes", F.coalesce("split", F.lit(False)).alias("split")))).alias("lines"))

    @F.pandas_udf("array<struct<text:string,open:boolean>>")
    def mend(column: pd.Series) -> pd.Series:
        return pd.Series([_paragraphs(page) for page in column])

    parts = cut(pages.select("doc_id", "source", "page", F.posexplode(mend("lines")).alias("place", "p")).select("doc_id", "source", "page", "place", "p.text", "p.open"))
    page = parts.filter("source IS NOT NULL AND page IS NOT NULL").groupBy("source", "page", "doc_id").agg(F.max("place").alias("last"), F.max_by("open", "place").alias("open"))
    page = page.groupBy("source", "page").agg(F.min(F.struct("doc_id", "last", "open")).alias("x")).select("source", "page", "x.*")
    before = page.select("source", (F.col("page") + 1).alias("page"), F.col("open").alias("carried"))
    # The page that the first paragraph of a page begins on, by doubling steps back over pages of one paragraph.
    carried = F.coalesce("carried", F.lit(False))
    step = page.join(before, ["source", "page"], "left").select("source", "page", "doc_id", "last", F.when(carried, F.col("page") - 1).otherwise(F.col("page")).alias("back"), ((F.col("last") > 0) | ~carried).alias("anchor"))
    for _ in range(MOST_PAGES.bit_length() - 1):
        far = step.select("source", F.col("page").alias("back"), F.when(F.col("anchor"), F.col("page")).otherwise(F.col("back")).alias("farther"))
        step = cut(step.join(far, ["source", "back"], "left").select("source", "page", "doc_id", "last", F.coalesce("farther", "back").alias("back"), "anchor"))
    ahead = step.select("source", F.col("page").alias("back"), F.col("doc_id").alias("from_doc"), F.col("last").alias("begin"), F.col("anchor").alias("whole"))
    reached = step.filter("back < page").join(ahead, ["source", "back"])
    block = F.col("page") - F.pmod("page", F.lit(MOST_PAGES))
    begin = reached.select(
        "doc_id", F.lit(0).alias("place"), F.when(F.col("whole"), F.col("from_doc")).alias("from_doc"), F.when(F.col("whole"), F.col("back")).otherwise(block).alias("from_page"), F.when(F.col("whole"), F.col("begin")).alias("begin")
    )
    placed = parts.join(begin, ["doc_id", "place"], "left").withColumn("goes_on", F.col("from_page").isNotNull())
    # A paragraph's own beginning, or, within one that never ends, a block of pages.
    own = placed.select(
        "source", "text", F.col("page").alias("of"), F.col("doc_id").alias("row_doc"), F.when(F.col("goes_on"), F.col("from_page")).otherwise(F.col("page")).alias("page"),
        F.when(F.col("goes_on"), F.col("from_doc")).otherwise(F.col("doc_id")).alias("key_doc"), F.when(F.col("goes_on"), F.coalesce("begin", F.lit(0))).otherwise(F.col("place")).alias("place"),
    )
    run = own.groupBy("source", "page", "key_doc", "place").agg(F.min_by("row_doc", "of").alias("first_doc"), F.sort_array(F.collect_list(F.struct("of", "text"))).alias("parts"))
    joined = F.aggregate("parts.text", F.lit(""), lambda a, t: F.when(a == "", t).when(a.endswith("\u0000"), F.concat(F.rtrim(a, F.lit("\u0000")), t)).otherwise(_glued(a, t)))
    return run.select(F.coalesce("key_doc", "first_doc").alias("doc_id"), "source", "page", "place", F.replace(joined, F.lit("\u0000"), F.lit("")).alias("text"))


def _glued(a: Column, b: Column) -> Column:
    """Two pieces of running text, with a space but between Chinese characters."""
    tight = a.rlike("[一-鿿　-〿＀-￯]$") | b.rlike("^[一-鿿　-〿＀-￯]")
    return F.when(tight, F.concat(a, b)).otherwise(F.concat_ws(" ", a, b))


_HEADING = regex.compile(r"\s*\d+(\.\d+)+ \S|#+ ")
_STRAY_SIGN = regex.compile(rf"(?<=\S) [{regex.escape(_STRAY)}](?= )|[~^¦`´¨]")
_OWN_HYPHEN = regex.compile(r"[\p{L}\p{N}]-$")
#: Words after an open hyphen, as in "in- and outputs".
_SHARED = regex.compile(r"(und|oder|bzw|bis|and|or|et|ou|y|e|o|u)\b")
_TIGHT = regex.compile(r"[一-鿿　-〿＀-￯]")


def _paragraphs(lines: list[dict]) -> list[dict]:
    """The mended paragraphs of one page; a text whose last word goes on ends with a null character."""
    out: list[dict] = []
    after_heading = True
    for row in lines:
        line = _STRAY_SIGN.sub("", row["line"]).strip()
        for fix in row["fixes"] if row["fixes"] is not None else ():
            line = regex.sub(rf"(?i)(?<![\p{{Latin}}\p{{N}}]){regex.escape(fix['word'])}(?![\p{{Latin}}\p{{N}}])", lambda m, b=fix["best"]: b.capitalize() if m[0][:1].isupper() else b, line)
        heading = _HEADING.match(line) is not None
        if row["split"]:
            line = line[:-1] + "\0"
        if not out or row["gap"] or heading or after_heading:
            out.append({"text": line, "open": False})
        else:
            text = out[-1]["text"]
            if text.endswith("\0"):
                text = text[:-1] + line
            elif _TIGHT.match(text[-1:]) or _TIGHT.match(line[:1]) or (_OWN_HYPHEN.search(text) and not _SHARED.match(line)):
                text += line
            else:
                text += " " + line
            out[-1]["text"] = text
        after_heading = heading
    if out:
        out[-1]["open"] = not after_heading and regex.search(r"[.。!?！？:：]$", out[-1]["text"]) is None
    return out


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text", "source", "physical_page", "doc_type")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return disturbed_lines(_pages(spark, folder))


def p5_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return mend_pages(_pages(spark, folder))


SQL: dict[str, str] = {}
QUERIES = {"p5_found": p5_found, "p5_paragraphs": p5_paragraphs}
