"""p8: text that was read in a wrong character encoding, found and restored."""

from __future__ import annotations

import codecs
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.session import cut
from kbspark.sources.tables import table

#: Encodings that the learner tries as the true one and as the one that was used instead.
CODECS = ("utf-8", "windows-1252", "latin-1", "gbk", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8_r", "big5", "shift_jis", "euc_kr")
_SINGLE = ("windows-1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8_r")
#: A character is common that occurs in at least one of so many documents.
COMMON = 5000
#: How much more frequent the restored spelling of a word must be than the garbled one.
RATIO = 5
#: Different clean words that must bear out a mapping of characters, and the share of a garbled run's words that must agree on it.
LEAST, AGREE = 3, 0.9
#: Pieces that one piece of a long list of guesses is spread over when it comes back to its documents.
_SALTS = 16
_MARK = "�"
_SPECIFIC = 12  # ASCII letters and digits that a stripped text must keep to stand for a sentence
_CJK = r"⺀-鿿豈-﫿︰-﹏＀-￯"
_BETWEEN = r"[\x00-\x20\x7f|,;:()\[\]{}<>\"'`*#]+"
_SPLIT = re.compile(_BETWEEN)
_RUN = regex.compile(r"[^\x00-\x7f]+")
_LATIN = regex.compile(r"[A-Za-z0-9À-ÖØ-öø-ÿŒœŠšŽžŸ’'€£§°±²µ×…–“”«»ß.%/_-]+")
_CHINESE = regex.compile(rf"[{_CJK}‘’“”…—·]+")
_LATIN_LETTER, _CJK_SIGN = re.compile("[A-Za-z]"), re.compile("[⺀-鿿]")
_THREE = re.compile(rb"[\xe0-\xef][\x80-\xbf]{2}")
_QUOTED_MARK = regex.compile("[“„«\"'‘]�+[”“»\"'’]")
_LETTERS_BEFORE, _LETTERS_AFTER = re.compile(r"[A-Za-z]*$"), re.compile(r"[A-Za-z]*")
_OUTER = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")


#: windows-1252 as browsers read it: the C1 controls where it has no character.
_TABLE = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(256))
_ENCODER = codecs.charmap_build(_TABLE)


def to_bytes(text: str, codec: str, errors: str = "strict") -> bytes:
    return codecs.charmap_encode(text, errors, _ENCODER)[0] if codec == "windows-1252" else text.encode(codec, errors)


def to_text(data: bytes, codec: str, errors: str = "strict") -> str:
    return codecs.charmap_decode(data, errors, _TABLE)[0] if codec == "windows-1252" else data.decode(codec, errors)


def garble(text: str, true: str, used: str, rounds: int) -> str:
    """What becomes of a text in encoding `true` that is read as `used`, `rounds` times over."""
    for _ in range(rounds):
        text = to_text(to_bytes(text, true), used, "replace")
    return text


def explain(garbled: str, clean: str) -> list[str]:
    """The transformations, as true>used>rounds, that make `garbled` of `clean`."""
    found = []
    for true in CODECS:
        try:
            data = to_bytes(clean, true)
        except UnicodeError:
            continue
        for used in CODECS:
            # A single-byte encoding gives a character a byte, others never give more.
            if len(garbled) < len(data) if used in _SINGLE else len(garbled) > len(data):
                continue
            try:
                once = to_text(data, used, "replace")
                if once == garbled:
                    found.append(f"{true}>{used}>1")
                elif used in _SINGLE and len(garbled) > len(once) and garble(once, true, used, 1) == garbled:
                    found.append(f"{true}>{used}>2")
            except UnicodeError:
                continue
    return found


def _sentences(docs: DataFrame) -> DataFrame:
    """The sentences with a character outside ASCII: doc_id, s (digits as 0)."""
    foreign = lambda x: x.rlike(r"[^\x00-\x7F]")
    lines = F.filter(F.split("text", "\n"), foreign)
    parts = F.filter(F.flatten(F.transform(lines, lambda x: F.split(x, "(?<=[.!?]) +"))), foreign)
    return docs.select("doc_id", F.explode(parts).alias("s")).select("doc_id", F.regexp_replace("s", "[0-9]+", "0").alias("s"))


def stripped_keys(s: Column) -> Column:
    """What a sentence is joined by: its text with each run of characters outside ASCII struck out, and with each word struck
    out that has one (as a wrong encoding can swallow a neighbour). Only keys that keep enough to be specific."""
    runs = F.regexp_replace(s, r"[^\x00-\x7F]+", "\u0001")
    # A word is tried from its beginning only, its ASCII part once.
    words = F.regexp_replace(s, r"(?<![^ \t|])[\x00-\x7F&&[^ \t|]]*+[^\x00-\x7F][^ \t|]*", "\u0002")
    enough = lambda k: k.rlike(rf"^(?:[^A-Za-z0-9]*+[A-Za-z0-9]){{{_SPECIFIC}}}")
    # Within the array, so that each text is stripped once.
    return F.array_compact(F.transform(F.array(runs, words), lambda k: F.when(enough(k), F.xxhash64(k))))


def twins(docs: DataFrame, seen: dict[str, int] | None = None) -> DataFrame:
    """Words that stand at the same place of two sentences that agree in all ASCII text: garbled, clean, support.

    Of the spellings of a stripped sentence one is taken as clean, and each other one is aligned with it, word by word;
    so a key with any number of spellings gives as many pairs, not their square. Clean is the one whose rarest character
    is in most documents (`seen`: how many have each, what characters gives), then the most frequent one.
    """
    seen = characters(docs) if seen is None else seen
    spelled = cut(_sentences(docs).select(F.explode(stripped_keys(F.col("s"))).alias("key"), "s").groupBy("key", "s").agg(F.count(F.lit(1)).alias("n")))
    counts = docs.sparkSession.sparkContext.broadcast(seen)

    @F.pandas_udf("long")
    def rarest(texts: pd.Series) -> pd.Series:
        number = counts.value
        return pd.Series([min((number.get(c, 0) for c in set(t) if c >= "\x80"), default=0) for t in texts], dtype="int64")

    several = spelled.groupBy("key").agg(F.count(F.lit(1)).alias("spellings")).filter("spellings > 1").select("key")
    known = spelled.join(several, "key", "left_semi").withColumn("rarest", rarest("s"))
    known = cut(known)
    odd = F.col("s").rlike("[�\u0080-\u009f]")
    best = known.groupBy("key").agg(F.max_by("s", F.struct(~odd, "rarest", "n", "s")).alias("c"))
    pairs = known.join(best, "key").filter(F.col("s") != F.col("c")).select("s", "c", "n")
    words = lambda c: F.split(c, r"[ \t|]+")
    # Words by white space where their number agrees, else (as in Chinese) runs between ASCII characters.
    runs = lambda c: F.regexp_extract_all(c, F.lit(r"([^\x00-\x7F]+)"))
    by_words = F.when(F.size(words(F.col("s"))) == F.size(words(F.col("c"))), F.arrays_zip(words(F.col("s")).alias("g"), words(F.col("c")).alias("c")))
    by_runs = F.when(F.size(runs(F.col("s"))) == F.size(runs(F.col("c"))), F.arrays_zip(runs(F.col("s")).alias("g"), runs(F.col("c")).alias("c")))
    both = F.array_distinct(F.concat(F.coalesce(by_words, F.array().cast("array<struct<g:string,c:string>>")), F.coalesce(by_runs, F.array().cast("array<struct<g:string,c:string>>"))))
    different = F.filter(both, lambda x: x["g"] != x["c"])
    aligned = pairs.select("n", F.explode(different).alias("x")).select(F.col("x.g").alias("garbled"), F.col("x.c").alias("clean"), "n")
    return aligned.groupBy("garbled", "clean").agg(F.sum("n").alias("support"))


def align(garbled: str, clean: str) -> list[tuple[str, str]]:
    """The runs of characters in which two words differ, side by side: runs outside ASCII where the words agree in ASCII, else all between their common ends."""
    if _RUN.sub("\0", garbled) == _RUN.sub("\0", clean):
        return [(g, c) for g, c in zip(_RUN.findall(garbled), _RUN.findall(clean), strict=True) if g != c]
    least, start, end = min(len(garbled), len(clean)), 0, 0
    while start < least and garbled[start] == clean[start]:
        start += 1
    while end < least - start and garbled[-1 - end] == clean[-1 - end]:
        end += 1
    return [(garbled[start : len(garbled) - end], clean[start : len(clean) - end])]


class Learned(NamedTuple):
    """What twins teach: encodings that were confused (true, used, rounds), garbled runs of characters that no encodings
    explain with what they were, and whether characters were replaced by U+FFFD."""

    encodings: list[tuple[str, str, int]]
    runs: dict[str, str]
    lossy: bool


def run_pairs(pairs: DataFrame) -> DataFrame:
    """How often runs of characters stand for one another in twins: garbled, clean, words (different clean words), support. pairs: what twins gives."""

    @F.pandas_udf("array<struct<g:string,c:string>>")
    def runs(garbled: pd.Series, clean: pd.Series) -> pd.Series:
        return pd.Series([[{"g": g, "c": c} for g, c in align(a, b)] for a, b in zip(garbled, clean, strict=True)], dtype=object)

    each = pairs.select(F.explode(runs("garbled", "clean")).alias("x"), F.col("clean").alias("word"), "support").select(F.col("x.g").alias("garbled"), F.col("x.c").alias("clean"), "word", "support")
    each = each.filter(F.col("garbled").rlike(r"[^\x00-\x7F]"))
    return each.groupBy("garbled", "clean").agg(F.count_distinct("word").alias("words"), F.sum("support").alias("support"))


def learn(pairs: DataFrame, seen: dict[str, int], least: int = LEAST) -> Learned:
    """The mappings that the aligned pairs bear out. pairs: what twins gives; seen: in how many documents each character is.

    Characters of twin words are aligned and the pairs of runs counted. A pair counts where its garbled side has a rarer
    character than its clean side. Encodings name a mapping if they explain different pairs of runs with `least`
    different words; of several that explain the same pairs only the one with most. What no encodings explain is a
    mapping of its own: with `least` words for a run, AGREE of all words that have the run, and a character that is
    RATIO times as rare as what it stands for. Nothing depends on how large the table is.

    What reaches the driver is a row for each set of encodings (bounded by the family of CODECS), and the mappings without
    a name, as many as there are runs of at most three characters with enough words.
    """
    counts = pairs.sparkSession.sparkContext.broadcast(seen)
    rarest = lambda number, text: min((number.get(c, 0) for c in text if c >= "\x80"), default=1 << 40)

    @F.pandas_udf("why array<string>, rarer double")
    def judge(garbled: pd.Series, clean: pd.Series) -> pd.DataFrame:
        rows = []
        for g, c in zip(garbled, clean, strict=True):
            ratio = rarest(counts.value, c) / max(1, rarest(counts.value, g))
            rows.append((explain(g, c) if ratio > 1 and _MARK not in c else [], ratio))
        return pd.DataFrame(rows, columns=["why", "rarer"])

    told = run_pairs(pairs).withColumn("j", judge("garbled", "clean")).select("garbled", "clean", "words", "j.why", "j.rarer")
    told = cut(told)
    named = told.filter(F.size("why") > 0)
    letters = named.select("why", F.explode(F.split("clean", "")).alias("letter")).filter(F.col("letter") > "\u007f").distinct().groupBy("why").agg(F.count(F.lit(1)).alias("letters"))
    counted = named.groupBy("why").agg(F.sum("words").alias("words")).join(letters, "why").collect()
    left, chosen = {tuple(r["why"]): (r["letters"], r["words"]) for r in counted}, []
    while left:
        votes: dict[str, list[int]] = {}
        for names, told_by in left.items():
            for name in names:
                votes[name] = [a + b for a, b in zip(votes.get(name, (0, 0)), told_by, strict=True)]
        votes = {name: v for name, v in votes.items() if v[0] >= 2 and sum(v) >= least + 2}
        if not votes:
            break
        name = min(votes, key=lambda v: (-votes[v][1], -votes[v][0], CODECS.index(v.split(">")[0]) + CODECS.index(v.split(">")[1]), v))
        chosen.append(name)
        left = {names: n for names, n in left.items() if name not in names}
    unnamed = told.filter(~F.arrays_overlap("why", F.array(*[F.lit(x) for x in chosen])) if chosen else F.lit(True))
    total = told.groupBy("garbled").agg(F.sum("words").alias("all"))
    own = unnamed.filter((F.col("words") >= least) & (F.col("rarer") >= RATIO) & ~F.col("garbled").contains(_MARK) & (F.length("garbled") <= 3) & (F.length("clean") <= 3))
    runs = {r["garbled"]: r["clean"] for r in own.join(total, "garbled").filter(F.col("words") >= AGREE * F.col("all")).select("garbled", "clean").collect()}
    lost = told.filter(F.col("garbled").contains(_MARK) & ~F.col("clean").contains(_MARK)).agg(F.sum("words").alias("n")).first()["n"] or 0
    return Learned([(a, b, int(n)) for a, b, n in (x.split(">") for x in chosen)], runs, lost >= least)


_WIDE = ("gbk", "big5", "shift_jis", "euc_kr")


def _chars_of(codec: str, low: int, high: int) -> str:
    """The characters of the bytes low to high of a single-byte encoding, for a character class."""
    return "".join(regex.escape(to_text(bytes([b]), codec, "ignore"), special_only=False) for b in range(low, high + 1))


class Multi:
    """Undoes UTF-8 that was read as a single-byte encoding, in those places whose bytes are UTF-8."""

    def __init__(self, used: str, rounds: int) -> None:
        self.used, self.rounds = used, rounds
        tail = f"[{_chars_of(used, 0x80, 0xBF)}]"
        self.place = regex.compile(f"(?:[{_chars_of(used, 0xC2, 0xDF)}]{tail}|[{_chars_of(used, 0xE0, 0xEF)}]{tail}{{2}}|[{_chars_of(used, 0xF0, 0xF4)}]{tail}{{3}})+")

    def undo(self, text: str) -> str | None:
        for _ in range(self.rounds):
            try:
                text = to_bytes(text, self.used).decode("utf-8")
            except UnicodeError:
                return None
        return text


class Mender:
    """Looks for the traces of the learned transformations in one text at a time."""

    def __init__(self, found: Learned, common: set[str]) -> None:
        self.common, self.table, self.lossy, learned = common, found.runs, found.lossy, found.encodings
        self.keys = regex.compile("|".join(map(regex.escape, sorted(found.runs, key=len, reverse=True)))) if found.runs else None
        self.told: dict[str, tuple[bool, list[tuple[str, str | None, str]]]] = {}
        single = [t for t in learned if t[1] != "utf-8" and t[1] not in _WIDE]
        self.multi = [Multi(used, rounds) for true, used, rounds in sorted(single, key=lambda t: -t[2]) if true == "utf-8"]
        # Chinese bytes read as a single-byte encoding: runs of characters of high bytes.
        self.wide = [(true, used, regex.compile(f"[{_chars_of(used, 0x81, 0xFE)}]{{4,}}")) for true, used, rounds in single if true in _WIDE and rounds == 1]
        # UTF-8 read as a Chinese encoding.
        self.chinese = [used for true, used, rounds in learned if true == "utf-8" and used in _WIDE and rounds == 1]
        # Single letters read as others; what comes out must be Latin, in bytes as in characters.
        self.latin = [("utf-8", used, re.compile(b"(?s).+")) for used in self.chinese]
        for true, used, rounds in learned:
            if true not in _WIDE and true != "utf-8" and used != "utf-8" and rounds == 1:
                allowed = bytes(b for b in range(0x21, 256) if _LATIN.fullmatch(c := to_text(bytes([b]), true, "ignore")) and (b < 0x80 or c in common))
                self.latin.append((true, used, re.compile(b"[" + re.escape(allowed) + b"]+")))

    def good(self, text: str) -> bool:
        return all(c < "\x80" or c in self.common for c in text) and (_LATIN.fullmatch(text) or _CHINESE.fullmatch(text)) is not None

    def word(self, word: str) -> list[str]:
        """What a Latin word may have been before, by each mapping that leaves only Latin letters; guesses, to be held against the vocabulary."""
        found: dict[str, None] = {}
        for true, used, allowed in self.latin:
            try:
                data = to_bytes(word, used)
                if allowed.fullmatch(data) and (r := to_text(data, true)) != word and _LATIN.fullmatch(r) and self.good(r):
                    found[r] = None
            except UnicodeError:
                continue
        if self.keys and self.keys.search(word):
            found[self.keys.sub(lambda m: self.table[m[0]], word)] = None
        return list(found)

    def direct(self, run: str) -> list[tuple[int, int, str]]:
        """The places of a run of characters outside ASCII whose bytes alone show what they were: start, end, restored."""
        for way in self.multi:
            found = [(m.start(), m.end(), r) for m in way.place.finditer(run) if (r := way.undo(m[0])) and self.good(r)]
            if found:
                return found
        for true, used, pattern in self.wide:
            found = []
            for m in pattern.finditer(run):
                # In a long run a byte may be missing; a short one must come out whole.
                r = to_bytes(m[0], used).decode(true, "ignore" if len(m[0]) >= 8 else "replace")
                if _CHINESE.fullmatch(r) and sum(c in self.common for c in r) >= 0.9 * len(r) and 2 * len(r) >= len(m[0]) - 2:
                    found.append((m.start(), m.end(), r))
            if found:
                return found
        for used in self.chinese:
            data = to_bytes(run, used, "replace")
            whole = sum(m[0].decode("utf-8", "ignore") in self.common for m in _THREE.finditer(data))
            if whole >= 2 and 3 * whole >= 0.6 * len(data):
                return [(0, len(run), data.decode("utf-8", "replace"))]
        return []

    def traces(self, word: str) -> tuple[bool, list[tuple[str, str | None, str]]]:
        """Whether a word can bear out a guess, as Chinese text can't, and what is garbled in it, wherever it stands."""
        told = self.told.get(word)
        if told is None:
            found = [(m[0][a:b], r, "sure") for m in _RUN.finditer(word) for a, b, r in self.direct(m[0])]
            bare = word.strip(".")
            if _MARK in bare:
                found += [(bare, None, "lost")] * self.lossy
            else:
                found += [(bare, r, "word") for r in self.word(bare)]
            if len(self.told) > 200_000:
                self.told.clear()
            told = self.told[word] = _LATIN_LETTER.search(word) is not None or _CJK_SIGN.search(word) is None, found
        return told

    def find(self, text: str, words: Counter[str]) -> list[tuple[str, str | None, str]]:
        """(garbled, restored, kind) for every trace; kind `sure`, `word` (a guess) or `lost` (only the loss is certain). Counts the words outside ASCII."""
        out: dict[tuple[str, str | None, str], None] = {}
        for line in text.split("\n"):
            if line.isascii():
                continue
            for word in _SPLIT.split(line):
                if word.isascii():
                    continue
                counts, pieces = self.traces(word)
                if counts:
                    words[word.strip(".")] += 1
                for piece in pieces:
                    if piece not in out and not self.quotes(line, *piece):
                        out[piece] = None
        return list(out)

    def quotes(self, line: str, garbled: str, restored: str | None, kind: str) -> bool:
        """Whether the line speaks of the piece wherever it has it."""
        if kind == "lost":
            return _QUOTED_MARK.search(line) is not None
        return all(self.quoted(line, m.start(), m.end(), restored) for m in re.finditer(re.escape(garbled), line))

    @staticmethod
    def quoted(line: str, start: int, end: int, restored: str) -> bool:
        """Whether the line also has the right spelling, as text has that speaks of the wrong one."""
        left = _LETTERS_BEFORE.search(line[:start])[0]
        right = _LETTERS_AFTER.match(line[end:])[0]
        core = _OUTER.sub("", left + restored + right) or restored
        rest = line[: start - len(left)] + "\n" + line[end + len(right) :]
        return core in rest and regex.search(rf"(?<![A-Za-zÀ-ɏ]){regex.escape(core)}(?![A-Za-zÀ-ɏ])", rest) is not None


def characters(docs: DataFrame) -> dict[str, int]:
    """How many documents have each character outside ASCII, and of "" how many documents there are; no more than Unicode has."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for batch in batches:
            seen[""] += len(batch)
            for text in batch["text"]:
                seen.update({c for c in set(text) if c >= "\x80"})
        yield pd.DataFrame(list(seen.items()), columns=["c", "n"])

    rows = docs.select("text").filter("text IS NOT NULL").mapInPandas(count, "c string, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
    return {r["c"]: r["n"] for r in rows}


def common_of(seen: dict[str, int], one_in: int = COMMON) -> set[str]:
    """The characters in at least one of `one_in` documents."""
    return {c for c, n in seen.items() if c and n * one_in >= seen.get("", 0)}


def _spelling(word: Column) -> Column:
    return F.xxhash64(F.regexp_replace(word, "[0-9]+", "0"))


def _with_text(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x00-\x7F]"))


def garbled_places(docs: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Every garbled piece of every document, once, with what it was: doc_id, garbled, restored (null where it is lost).

    docs: doc_id, text. A null text or doc_id has no piece; repeated rows of a doc_id are read as one document. Other columns are
    ignored; an empty table gives none. A piece whose line also has its right spelling is text that speaks of the error,
    and none. `pairs` are the twins of docs, where they are at hand.

    Mappings of characters are learned from near-twins on stripped text, then undone wherever they leave a trace: at once
    where the bytes prove it, else as a guess that must be far more frequent in the corpus than the garbled spelling. A
    replaced character (U+FFFD) is a trace only where twins show that such are left.
    Documents are read where they lie, in one pass that also counts their words; only words outside ASCII, each
    once a task, and the pieces are shuffled. Guesses are judged once for the whole corpus, not for each document.
    """
    docs = _with_text(docs)
    seen = characters(docs)
    learned = learn(twins(docs, seen) if pairs is None else pairs, seen)
    mender = docs.sparkSession.sparkContext.broadcast((learned, common_of(seen)))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, words = Mender(*mender.value).find, Counter()
        columns = ["doc_id", "garbled", "restored", "kind", "n"]
        for batch in batches:
            yield pd.DataFrame([(i, *e, 1) for i, text in zip(batch["doc_id"], batch["text"], strict=True) for e in find(text, words)], columns=columns)
            if len(words) > 200_000:
                yield pd.DataFrame([(None, w, None, "count", n) for w, n in words.items()], columns=columns)
                words.clear()
        yield pd.DataFrame([(None, w, None, "count", n) for w, n in words.items()], columns=columns)

    read = cut(docs.mapInPandas(search, "doc_id long, garbled string, restored string, kind string, n long"))
    pieces = read.filter("kind != 'count'").select("doc_id", "garbled", "restored", "kind")
    guesses = pieces.filter("kind = 'word'").select("garbled", "restored").distinct().withColumns({"hr": _spelling(F.col("restored")), "hg": _spelling(F.col("garbled"))})
    counts = read.filter("kind = 'count'").groupBy(_spelling(F.col("garbled")).alias("h")).agg(F.sum("n").alias("n"))
    right, wrong = counts.select(F.col("h").alias("hr"), F.col("n").alias("right")), counts.select(F.col("h").alias("hg"), F.col("n").alias("wrong"))
    sound = F.coalesce("right", F.lit(0)) >= F.greatest(F.lit(3), RATIO * F.coalesce("wrong", F.lit(0)))
    good = guesses.join(right, "hr", "left").join(wrong, "hg", "left").filter(sound).groupBy("garbled").agg(F.max_by("restored", F.struct("right", "restored")).alias("restored")).select("garbled", "restored", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    guessed = pieces.filter("kind = 'word'").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)).cast("int")).join(good, ["garbled", "restored", "salt"], "left_semi")
    return pieces.filter("kind != 'word'").select("doc_id", "garbled", "restored").unionByName(guessed.select("doc_id", "garbled", "restored")).distinct()


def restore(docs: DataFrame, places: DataFrame, pairs: DataFrame) -> DataFrame:
    """The garbled documents with their text mended: doc_id, text, whole (whether nothing is lost any more).

    Lost words are looked up among the words that near-twins have in their place (pairs, what twins gives): the best
    supported one that agrees with the word but for its lost characters. A line that also has the right spelling speaks
    of the error and stays as it is.
    """
    agrees = F.expr("clean rlike concat('^', regexp_replace(regexp_replace(garbled, '([.^$*+?()\\\\[\\\\]{}|\\\\\\\\-])', '\\\\\\\\$1'), '\uFFFD+', '.{1,3}'), '$')")
    known = pairs.filter(F.col("garbled").contains(_MARK) & ~F.col("clean").contains(_MARK) & (F.length(F.regexp_replace("garbled", "[^A-Za-z]", "")) >= 2)).filter(agrees)
    known = known.groupBy("garbled").agg(F.max_by("clean", F.struct("support", "clean")).alias("twin"))
    mended = places.join(known, "garbled", "left").withColumn("restored", F.coalesce("restored", "twin"))
    per_doc = mended.groupBy("doc_id").agg(F.collect_list(F.struct("garbled", "restored")).alias("pieces"))

    @F.pandas_udf("string")
    def mend(texts: pd.Series, pieces: pd.Series) -> pd.Series:
        out = []
        for text, row in zip(texts, pieces, strict=True):
            table = {p["garbled"]: p["restored"] for p in row if p["restored"] is not None}
            pattern = regex.compile("|".join(map(regex.escape, sorted(table, key=len, reverse=True)))) if table else None
            out.append("\n".join(_mended(line, pattern, table) for line in text.split("\n")) if pattern else text)
        return pd.Series(out, dtype=object)

    fixed = docs.select("doc_id", "text").join(per_doc, "doc_id").select("doc_id", mend("text", "pieces").alias("text"))
    return fixed.withColumn("whole", ~F.col("text").contains(_MARK))


def _mended(line: str, pattern: regex.Pattern, table: dict[str, str]) -> str:
    if line.isascii():
        return line
    return pattern.sub(lambda m: m[0] if Mender.quoted(line, m.start(), m.end(), table[m[0]]) else table[m[0]], line)


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return garbled_places(_documents(spark, folder)).select("doc_id").distinct()


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    pairs = cut(twins(_with_text(docs)))
    return restore(docs, garbled_places(docs, pairs), pairs)


SQL: dict[str, str] = {}
QUERIES = {"p8_found": p8_found, "p8_restored": p8_restored}
