"""p1: defective answers of question-answer pairs."""

from __future__ import annotations

import functools
import itertools
import math
import pickle
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm.crf import CRF
from kbspark.llm.text import is_empty, speaker
from kbspark.operators.events import fold_events
from kbspark.session import cut
from kbspark.sources.tables import table

LABELS = ("answer", "refusal", "echo", "foreign", "unfinished")
#: Pairs of a block, at least, but where there are fewer, or texts are long. Every pair is in one; each block fits a field, and their mean tags all pairs.
BLOCK = 12_000
SAMPLE = BLOCK  # what a field is tried on alone
#: Log odds that the field gives a refusal beyond what the votes say, as wordings that no rule has get none.
LEAN = 1.0
_WIDTH = 1 << 16
_AT_ONCE = 1024
#: Characters of the answers of a block, about, and words that a task counts before it gives them on.
_BLOCK_TEXT, _COUNTED = 8_000_000, 1 << 19
#: Weights are added up as whole numbers of this part, so that no order of blocks shows.
_UNIT = 1 << 24

#: Frequent words by which a text's language is first told.
_COMMON = {
    "en": "the of and to in is for are was has by with that it be on at from this not which one have does how what who can you there rows",
    "de": "der die das und zu den von mit ist im für auf ein eine dem des nicht sich bis wird alle oder wie was wer am laut gelten kostet",
    "fr": "le la les et des du une est pour dans que qui sur par au pas avec ce quelle quel combien à un sont aux en coûte",
    "es": "el la los las y del una es para en que con por se un no cuánto cuánta cuál quién al su sin cuesta tiene lo",
}
#: Ways in which a question asks for an answer in a language.
_ASKED = {
    "en": r"\b(?:in|into) english\b|\b(?:auf|ins) englisch|\ben (?:inglés|anglais)\b|英[文语]",
    "de": r"\b(?:in|into) german\b|\b(?:auf|ins) deutsch|\ben (?:alemán|allemand)\b|德[文语]",
    "fr": r"\b(?:in|into) french\b|\b(?:auf|ins) französisch|\ben (?:francés|français)\b|法[文语]",
    "es": r"\b(?:in|into) spanish\b|\b(?:auf|ins) spanisch|\ben (?:español|espagnol)\b|西班牙[文语]",
    "zh": r"\b(?:in|into) chinese\b|\b(?:auf|ins) chinesisch|\ben (?:chino|chinois)\b|[中汉][文语]",
}
#: What a clause has in which somebody declines, by language; the field learns its words from these.
_DECLINES = [
    r"\b(?:i|we)(?: am| are|'m|’m|'re)? (?:sorry, )?(?:can ?not|can['’]t|could not|am not able|are not able|unable|not able|won['’]t|will not|not allowed|not permitted|must|have to|['’]d rather not|would rather not|prefer not)(?: to)? (?:\w+ ){0,4}?(?:help|assist|answer|respond|say|tell|discuss|comment|provide|share|go into|decline|leave|unanswered|give|reveal|talk)",
    r"\bi['’]d rather not\b|\bin no position to\b|\bnot (?:built|made|designed) to\b|\bno answer can be given\b|\bnot be appropriate\b|\bhave to decline\b|\bstay silent\b|\bask a (?:human|colleague)\b|\banother (?:subject|topic)\b|\b(?:rules|guidelines|instructions) (?:i follow|keep|forbid|prevent)|\bpermitted to discuss\b|\btopic i won['’]t\b|\boutside (?:of )?what i\b|\bas an? (?:ai|assistant|language model)\b",
    r"\bkann ich nicht (?:helfen|beantworten|sagen)|\bnicht beantworten\b|\bkeine (?:auskunft|aussage)\b|\bmuss ich passen\b|\blehne ich\b|\baußerhalb meiner\b|\bnicht angebracht\b|\büber etwas anderes\b|\bals assistent\b|\bdarf ich nicht\b|\bmeine (?:regeln|vorgaben|richtlinien)\b|\bmöchte ich (?:nicht|keine)\b",
    r"\bje ne (?:peux|puis|suis)\b.{0,40}\b(?:répondre|aider|dire|autorisé|mesure)|\bm['’]est impossible\b|\bm['’]interdisent\b|\bdois décliner\b|\bparler d['’]autre chose\b|\bautorisé à (?:traiter|répondre)|\bdépasse ce que je\b|\bpréfère ne pas\b|\ben tant qu['’]assistant\b|\bpas en mesure de\b",
    r"\bno puedo (?:ayudar|responder|contestar|decir|dar)|\bno me está permitido\b|\bprefiero no\b|\bdebo rechazar\b|\bmis normas\b|\bhablar de otro (?:asunto|tema)|\bme lo impiden?\b|\bcomo asistente\b|\bfuera de mis\b|\bno estoy autorizad|\bno (?:sería|es) apropiado\b",
    r"我?无法(?:回答|提供|帮助|作答|协助)|不能(?:提供|回答|作答|帮)|帮不上|恕难|不便(?:作答|回答|透露|奉告)|超出了?我|换个话题|不符合我的|作为(?:助手|一个|人工智能)|直接询问同事|拒绝(?:回答|这)|请(?:去)?问(?:人工|同事)",
]
_DECLINE = {k: re.compile("|".join(v), re.I) for k, v in {None: _DECLINES, "en": _DECLINES[:2], "de": _DECLINES[2:3], "fr": _DECLINES[3:4], "es": _DECLINES[4:5], "zh": _DECLINES[5:]}.items()}
#: Courtesies that tell nothing, beside a refusal.
_COURTESY = re.compile(
    r"^(?:i apologi[sz]e|sorry|unfortunately|hm|thanks(?: for asking)?|please turn to|is there (?:something|anything) else|company data|es tut mir leid|leider|danke für die frage|bitte fragen sie|kann ich sonst|daten werden|désolée?|je regrette|merci pour|autre chose|adressez-vous|les données sont|lo siento|disculpe|gracias por|¿?algo más|los datos se|diríjase|pregunte a|consulte|抱歉|对不起|很遗憾|感谢提问|还有其他|请联系|(?:公司)?数据会?(?:被|将|均)|公司会)",
    re.I,
)
#: How a question is introduced that is only given back.
_INTRO = re.compile(
    r"^\W*(?:you (?:asked|want(?:ed)? to know|are asking)(?: about)?|(?:your|the) question(?: was| is)?|question|sie (?:fragen|fragten|möchten wissen)|(?:ihre|deine) frage(?: war| lautet| ist)?|frage|vous (?:demandez|avez demandé)|votre question(?: est| était)?|question|usted pregunta|su pregunta(?: es| era| fue)?|pregunta|您?的?问题是|您(?:问|想知道)的?是?|问题?|你问)\W*",
    re.I,
)

#: Words with which people speak of themselves or to others, or deny.
_PERSONS = set(
    "i we me my us our you your not no cannot can't won't don't unable never ich wir mir mich uns mein meine meiner sie nicht kein keine nie "
    "je nous me moi mon ma mes vous votre ne pas non jamais yo nosotros mí mi mis nos usted su no nunca 我 们 您 你 不 无 没 别".split()
)
_STOP = {w for v in _COMMON.values() for w in v.split()} | _PERSONS
_CHINESE = re.compile("[一-鿿]")
_TOKEN = regex.compile(r"[一-鿿]|[[\p{L}\p{N}_]--[一-鿿]]+", regex.V1)
_WORD = regex.compile(r"[\p{Latin}’']+")
_NAME = regex.compile(r"[A-Z]{2,}-\d+|\b\w*_\w+|[A-Z][a-z]+(?=\s?[A-Z]{2,}-)|\d[\d.,]*")
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_ITEM = re.compile(r"\s*(?:[-*•+]|\d+[.)、])\s+")
_CUT = regex.compile(r"(?<=[.!?][\"”»’')]{0,2})\s+(?=\S)|(?<=[。！？；][”」』）]?)(?=[^”」』）\s])")
_CLOSED = re.compile(r"(?<!\.\.)(?:[.!?。！？:：])[\"”»’')）」』*_ ]*$|[.!?。！？][\"”»’')）」』]*$")
_OPEN = re.compile(r"(?:…|\.\.\.|[,，、;；(（\[–—-]|\s[–—-])\s*$")


def clauses(text: str) -> list[tuple[str, str]]:
    """The clauses of an answer with their kind: text, item, code or table. The end of a sentence or of a line ends a clause."""
    out: list[tuple[str, str]] = []
    at = 0
    for m in [*_FENCE.finditer(text), None]:
        for line in text[at : m.start() if m else len(text)].split("\n"):
            if not line.strip():
                continue
            if line.lstrip().startswith("|"):
                out.append((line.strip(), "table"))
            elif mark := _ITEM.match(line):
                out.append((line[mark.end() :].strip(), "item"))
            else:
                out += [(c.strip(), "text") for c in _CUT.split(line) if c.strip()]
        if m:
            out.append((m[0], "code"))
            at = m.end()
    return out


def _terms(found: list[str]) -> list[str]:
    """What a text can be about: its words, and neighbouring Chinese characters."""
    return [w for w in found if w not in _STOP and len(w) > 1 and not _word(w).tells] + [a + b for a, b in itertools.pairwise(found) if len(a) == 1 == len(b) and a not in _STOP and b not in _STOP and a >= "一" and b >= "一"]


_SEEDS = {w: {k for k, v in _COMMON.items() if w in v.split()} for v in _COMMON.values() for w in v.split()}
_KEYS = list(_COMMON)


def counted(pairs: Iterable[tuple[str | None, str]]) -> dict[str, list[int]]:
    """By word, the texts of each language that have it, where frequent words tell a text's language, and the questions about it; by "" all questions."""
    out: dict[str, list[int]] = defaultdict(lambda: [0] * (len(_KEYS) + 1))
    for question, answer in pairs:
        if question:
            for t in {"", *_terms(_TOKEN.findall(question.lower()))}:
                out[t][-1] += 1
        for text in (question or "", answer):
            words = Languages.words(text)
            best = Counter(k for w in words for k in _SEEDS.get(w, ())).most_common(2)
            if best and best[0][1] >= 2 and (len(best) == 1 or best[0][1] >= best[1][1] + 2):
                k = _KEYS.index(best[0][0])
                for w in set(words):
                    out[w][k] += 1
    return out


class Languages:
    """Tells five languages apart by their words, with what frequent words teach about the others; knows what questions are about."""

    #: Texts or questions that a word must be in.
    LEAST = 3

    def __init__(self, counts: Iterable[tuple[str, Sequence[int]]], total: Sequence[int], questions: int) -> None:
        """counts: as `counted` has them; words below LEAST may be left out. total: the sum of each language's; questions: of all."""
        self.keys = _KEYS
        self.topics: set[str] = set()
        self.weight: dict[str, tuple[float, ...]] = {}
        # Rare words have few counts, so they share their weights.
        shared: dict[tuple[int, ...], tuple[float, ...]] = {}
        for w, (*n, asked) in itertools.chain(counts, [(w, [0] * (len(_KEYS) + 1)) for w in _SEEDS]):
            # What one question in a hundred has is how people ask, not what about.
            if w and self.LEAST <= asked <= max(self.LEAST, questions // 100):
                self.topics.add(w)
            n = tuple(x + (5 if k in _SEEDS.get(w, ()) else 0) for k, x in zip(_KEYS, n, strict=True))
            if sum(n) >= self.LEAST and w not in self.weight:
                self.weight[w] = shared.setdefault(n, tuple(math.log((x + 0.5) / (t + 1000)) for x, t in zip(n, total, strict=True)))

    @classmethod
    def of_pairs(cls, pairs: Iterable[tuple[str | None, str]]) -> Languages:
        counts = counted(pairs)
        return cls(counts.items(), [sum(x) for x in zip(*counts.values(), strict=True)][:-1] or [0] * len(_KEYS), counts[""][-1])

    @classmethod
    def of_table(cls, pairs: DataFrame) -> Languages:
        """The same from all rows of question and answer: tasks count, sums by word meet in a shuffle, and only words that count are gathered."""
        names = [*_KEYS, "asked"]

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[str, list[int]] = {}
            for batch in batches:
                for at in range(0, len(batch), _AT_ONCE):
                    some = batch[at : at + _AT_ONCE]
                    for w, n in counted(zip(some["question"], some["answer"], strict=True)).items():
                        held[w] = [x + y for x, y in zip(held[w], n, strict=True)] if w in held else n
                    if len(held) >= _COUNTED:
                        yield pd.DataFrame([(w, *n) for w, n in held.items()], columns=["word", *names])
                        held = {}
            yield pd.DataFrame([(w, *n) for w, n in held.items()], columns=["word", *names])

        counts = cut(pairs.select("question", "answer").mapInPandas(count, "word string, " + ", ".join(f"{n} long" for n in names)).groupBy("word").agg(*[F.sum(n).alias(n) for n in names]))
        *total, questions = counts.agg(*[F.coalesce(F.sum(n), F.lit(0)) for n in _KEYS], F.coalesce(F.sum(F.when(F.col("word") == "", F.col("asked"))), F.lit(0))).first()
        kept = counts.filter((sum((F.col(n) for n in _KEYS), F.lit(0)) >= cls.LEAST) | (F.col("asked") >= cls.LEAST) | F.col("word").isin(*_SEEDS))
        return cls(((w, n) for w, *n in kept.collect()), total, questions)

    @staticmethod
    def words(text: str) -> list[str]:
        return [w for w in _WORD.findall(_NAME.sub(" ", text).lower()) if len(w) < 30]

    def evidence(self, text: str) -> tuple[str | None, float]:
        """The likeliest language and by how much it is likelier than the next, in logarithms; None where no word is known."""
        chinese, words = len(_CHINESE.findall(text)), self.words(text)
        known = [x for w in words if (x := self.weight.get(w))]
        if chinese and chinese >= len(known):
            return "zh", 9.0
        if not known:
            return None, 0.0
        total = [sum(x) for x in zip(*known, strict=True)]
        order = sorted(range(len(total)), key=total.__getitem__)
        return self.keys[order[-1]], total[order[-1]] - total[order[-2]]

    def of(self, text: str) -> str | None:
        """The language, or None where the words don't tell."""
        language, margin = self.evidence(text)
        return language if margin > 1.5 else None


_ASKED_ANY = re.compile("|".join(_ASKED.values()), re.I)


def _asks_for(question: str) -> set[str]:
    if not _ASKED_ANY.search(question):
        return set()
    return {k for k, p in _ASKED.items() if re.search(p, question, re.I)}


@functools.lru_cache(1 << 18)
def _number(name: str) -> int:
    return zlib.crc32(name.encode()) % _WIDTH


class Word(NamedTuple):
    """What is known of a word wherever it stands: its feature, that of its beginning, whether it is of those with which
    people speak of themselves or deny, is no bare figure or code, has a digit, tells something, stands for a topic, and
    is a Chinese character."""

    own: int
    start: int
    person: bool
    plain: bool
    figure: bool
    tells: bool
    topic: bool
    sign: bool


@functools.lru_cache(1 << 17)
def _word(word: str) -> Word:
    figure = any(c.isdigit() for c in word)
    tells = figure or "_" in word
    return Word(_number("w " + word), _number("p " + word[:5]), word in _PERSONS, not tells, figure, tells, word not in _STOP, _CHINESE.match(word) is not None)


class Pair:
    """One question and answer, cut into clauses with what is known of each: words, place, novelty against the question, language."""

    def __init__(self, question: str | None, answer: str, languages: Languages) -> None:
        question = question or ""
        self.parts = clauses(answer)
        asked = _TOKEN.findall(question.lower())
        inside = set(asked)
        # A request for a language says nothing about the question's own.
        self.language, sure = languages.evidence(question)
        if sure <= 1.5:
            self.language = None
        allowed = (_asks_for(question) if self.language else set()) | {self.language}
        self.told: list[dict] = []
        given: set[str] = set()
        for k, (text, kind) in enumerate(self.parts):
            bare = _INTRO.sub("", text) if k == 0 else text
            found = _TOKEN.findall(bare.lower())
            words = [_word(w) for w in found]
            new = [x for w, x in zip(found, words, strict=True) if w not in inside]
            language, margin = languages.evidence(text) if kind in ("text", "item") else (None, 0.0)
            figures = any([x.figure for x in words])
            told = any([x.tells for x in new])
            novelty = len(new) / max(1, len(found))
            if kind == "text" and len(asked) > 1 and novelty <= 0.1 and not told:
                given.update(found)
            away = margin if language is not None and self.language is not None and language not in allowed else -margin
            self.told.append({"intro": bare != text, "away": away, "language": language, "figures": figures, "told": told, "words": words, "new": novelty, "shared": sum([w in inside and _word(w).topic for w in set(found)]), "topics": len(languages.topics.intersection(_terms(found)))})
        covered = len(given) / max(1, len(inside))
        for t, (_, kind) in zip(self.told, self.parts, strict=True):
            t["same"] = kind == "text" and len(asked) > 1 and t["new"] <= 0.1 and not t["told"] and covered >= 0.7
            t["foreign"] = t["away"] > 1.5
        self.covered = covered
        self.bare = len(self.parts) == 1 and self.parts[0][1] == "text" and len(self.told[0]["words"]) <= (12 if _CHINESE.search(answer) else 8)

    def ends(self) -> list[str]:
        """How each clause ends: closed (a stop), open (a comma, dash or dots), none, or whole (code, table)."""
        return ["whole" if kind in ("code", "table") else "open" if _OPEN.search(text) else "closed" if _CLOSED.search(text) else "none" for text, kind in self.parts]

    def features(self) -> list[list[int]]:
        out = []
        count, ends = len(self.parts), self.ends()
        tells = [t["told"] or t["figures"] for t in self.told]
        stops = [e == "closed" for e, (_, kind) in zip(ends[:-1], self.parts[:-1], strict=True) if kind == self.parts[-1][1]]
        others = "no" if not stops else "all" if all(stops) else "some" if any(stops) else "none"
        for k, (_, kind) in enumerate(self.parts):
            t = self.told[k]
            words, last = [x for x in t["words"] if x.plain], k == count - 1
            person = sum([x.person for x in words])
            size = "bare" if self.bare else "short" if len(t["words"]) < 4 else "long"
            away = max(-9, min(9, round(t["away"]))) if t["language"] else "unknown"
            # Novelty and what of the question is given back tell an echo, ends and place an unfinished clause.
            new, covered = ("none" if not t["new"] else int(t["new"] * 10)), int(self.covered * 10)
            named = (
                "all", f"kind {kind}", f"end {ends[k]} {last}", f"new {new} {t['told']} {covered >= 7}", f"covered {covered}", f"intro {t['intro']} {new}", f"away {away}", f"end {ends[k]} {last} {kind} {size}", f"end {ends[k]} {last} {kind} {size} {others} {new == 'none'}",
                f"end {ends[k]} {last} {new} {covered >= 7} {t['told']}", f"figures {t['figures']} {t['told']}", f"long {min(6, len(t['words']) // 3)}", f"person {min(2, person)} {t['figures']}", f"beside {any(tells[:k]) or any(tells[k + 1 :])} {person > 0} {t['figures']}",
                f"shared {min(3, t['shared'])} {t['figures']}", f"bare {self.bare}", f"topics {min(4, t['topics'])}", f"topics {min(4, t['topics'])} {t['figures']} {person > 0}", f"topics {min(2, t['topics'])} {self.bare} {count > 1 and any(x['topics'] for x in self.told)}",
            )
            row = [_number(n) for n in named]
            # A Chinese character says little by itself.
            own = [x.own for x in words]
            row += [x.own for x in words if not x.sign]
            row += [x.start for x in words if not x.sign]
            row += [(a * 31 + b * 17 + 5) % _WIDTH for a, b in itertools.pairwise(own)]
            out.append(list(set(row)))
        return out

    def weak_labels(self) -> list[int] | None:
        """Labels to fit the field on, by rules that vote or abstain; None where a clause has no vote.

        Patterns of declining, courtesies beside them, repeated questions, cut ends and other languages vote for a
        defect. A clause is voted an answer where something in the pair is told: figures or names that the question lacks,
        words of the question in a sentence of others, or a bare value without a word of persons. What declines in words
        of its own has none of these, and is left for the field to judge.
        """
        ends = self.ends()
        declines = [not t["figures"] and any(_DECLINE[x].search(text) for x in {t["language"], self.language}) for t, (text, _) in zip(self.told, self.parts, strict=True)]
        tells = any(t["told"] for t in self.told)
        out = []
        for k, (text, kind) in enumerate(self.parts):
            t = self.told[k]
            if t["same"]:
                out.append("echo")
            elif declines[k] or (any(declines) and _COURTESY.match(text) and not t["figures"]):
                out.append("refusal")
            elif self._unfinished(k, ends):
                out.append("unfinished")
            elif t["foreign"]:
                out.append("foreign")
            elif 0.1 < t["new"] <= 0.3 and not t["told"] and self.covered < 0.7:
                return None
            elif tells or kind in ("code", "table") or t["shared"] >= 2 or t["topics"] >= 3 or (t["topics"] and not any(x.person for x in t["words"])) or (self.bare and not any(x.person for x in t["words"])):
                out.append("answer")
            else:
                out.append("")
        if "" in out and not any(n == "answer" and (t["told"] or t["shared"] >= 2 or t["topics"] >= 2) for n, t in zip(out, self.told, strict=True)):
            return None
        return [LABELS.index(x or "answer") for x in out]

    def _unfinished(self, k: int, ends: list[str]) -> bool:
        if k < len(self.parts) - 1 or ends[k] in ("whole", "closed"):
            return False
        if ends[k] == "open":
            return True
        if self.parts[k][1] == "item":
            # Items without a stop are a way to write lists; one that alone has none is cut off.
            others = [e for e, (_, kind) in zip(ends[:-1], self.parts[:-1], strict=True) if kind == "item"]
            return bool(others) and all(e == "closed" for e in others)
        return not self.bare and not self.told[k]["same"]

    def told_by(self) -> Clauses:
        return Clauses([len(text) if kind != "code" else 0 for text, kind in self.parts], [t["foreign"] for t in self.told], any(kind in ("code", "table") for _, kind in self.parts))

    def defect(self, labels: list[int]) -> str | None:
        return self.told_by().defect(labels)


class Clauses(NamedTuple):
    """What remains of a pair's clauses once they are read: their sizes without code, which are in another language, and whether there is code or a table."""

    sizes: list[int]
    foreign: list[bool]
    code: bool

    def defect(self, labels: list[int]) -> str | None:
        """What the clauses' coverage makes of the pair."""
        size: Counter[str] = Counter()
        for n, label in zip(self.sizes, labels, strict=True):
            size[LABELS[label]] += n
        if size["refusal"] and not size["answer"] and not size["unfinished"] and not self.code:
            return "refusal"
        if size["echo"] and not size["answer"] and not size["foreign"] and not self.code:
            return "copied_question"
        # An unfinished end counts with its own language.
        foreign = size["foreign"] + sum(n for n, label, away in zip(self.sizes, labels, self.foreign, strict=True) if LABELS[label] == "unfinished" and away)
        if foreign > 0.5 * sum(size.values()):
            return "other_language"
        if labels and LABELS[labels[-1]] == "unfinished":
            return "truncated"
        return None


def _fitted(told: list[tuple[list[list[int]], list[int]]]) -> CRF:
    """A field from the features and labels of pairs on all of whose clauses rules vote."""
    field = CRF(_WIDTH, len(LABELS))
    if told:
        # Defects are rare, so pairs with one count several times.
        told = told + [t for t in told if any(t[1])] * 4
        field.fit([f for f, _ in told], [n for _, n in told])
    return field


def _leaning(field: CRF) -> CRF:
    if field.emit.any():
        field.emit[_number("all"), LABELS.index("refusal")] += LEAN
    return field


def fit(pairs: list[tuple[str | None, str]]) -> tuple[Languages, CRF]:
    """The language model and the random field of one block."""
    languages = Languages.of_pairs(pairs)
    read = [p for q, a in pairs if (p := Pair(q, a, languages)).parts]
    return languages, _leaning(_fitted([(p.features(), n) for p in read if (n := p.weak_labels())]))


def _weights(field: CRF) -> pd.DataFrame:
    """The weights of the features that a block has, then of the steps between labels."""
    own = np.flatnonzero(field.emit.any(1))
    rows = np.concatenate([field.emit[own], field.step[: len(LABELS) * bool(len(own))]])
    return pd.DataFrame({"pairs": None, "feature": np.concatenate([own, np.arange(len(rows) - len(own)) + _WIDTH]), "weight": np.rint(rows * float(_UNIT)).astype(np.int64).tolist()})


def _mean_field(weights: DataFrame) -> CRF:
    """The mean of the blocks' fields, each weight over the blocks that have its feature."""
    field = CRF(_WIDTH, len(LABELS))
    for feature, n, *sums in weights.groupBy("feature").agg(F.count("*"), *[F.sum(F.col("weight")[k]) for k in range(len(LABELS))]).collect():
        (field.emit if feature < _WIDTH else field.step)[feature % _WIDTH] = [x / n / _UNIT for x in sums]
    return field


def _packed(ids: pd.DataFrame, clauses: list[Clauses], features: list[list[list[int]]]) -> bytes:
    """Pairs as they are kept until the field is known."""
    items = [f for x in features for f in x]
    flat = np.fromiter(itertools.chain.from_iterable(items), np.uint16, sum(map(len, items)))
    return zlib.compress(pickle.dumps((ids["record_table"].tolist(), ids["record_id"].tolist(), [tuple(c) for c in clauses], [len(f) for f in items], flat)), 1)


def _unpacked(kept: bytes) -> tuple[list[str], list[int], list[Clauses], list[list[list[int]]]]:
    tables, ids, clauses, sizes, flat = pickle.loads(zlib.decompress(kept))
    numbers, ends = flat.tolist(), itertools.accumulate(sizes)
    items = iter([numbers[end - n : end] for n, end in zip(sizes, ends, strict=True)])
    return tables, ids, [Clauses(*c) for c in clauses], [list(itertools.islice(items, len(c[0]))) for c in clauses]


def pair_up(messages: DataFrame) -> DataFrame:
    """The pairs of a chat: record_id (of the assistant's message), question, answer.

    messages: id, session_id, role, content, seq, loaded_at. Each assistant message whose session has a user message
    with seq one lower; of several of these the one with the greatest id. Both are folded to their newest version first.
    Turns are joined by session and place, so a session of any length is spread.
    """
    turns = fold_events(messages, "id", "loaded_at", ["session_id", "role", "content", "seq"]).withColumn("by", speaker(F.col("role"))).filter("session_id IS NOT NULL AND seq IS NOT NULL AND by IS NOT NULL")
    asked = turns.filter("by = 'user'").groupBy("session_id", (F.col("seq") + 1).alias("seq")).agg(F.max_by("content", "id").alias("question"))
    return turns.filter("by = 'assistant'").select("session_id", "seq", F.col("id").alias("record_id"), F.col("content").alias("answer")).join(asked, ["session_id", "seq"]).select("record_id", "question", "answer")


def answer_defects(pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The defective pairs, each once: record_table, record_id, defect.

    pairs: record_table, record_id, question, answer, exempt (true for pairs whose answer may decline; they are no case).
    Empty answers are told by rule. The others are cut into clauses, which a conditional random field tags as answer,
    refusal, echo, foreign or unfinished by their words, place, ends, language, and novelty against the question; what the tags cover decides: only refusal and courtesy, only the question, more
    than half in another language than the question's (unless it asks for that), or an unfinished end. A null question
    has no language and nothing to repeat; a null record_id is no pair. Repeated rows count once; other columns are ignored; no rows give no rows.

    Words of the languages and of topics are counted over all pairs. All pairs on which rules vote fit the field: pairs
    are spread by their id over blocks of at least `block` (fewer where texts are long), a field is fitted on each, and their mean tags all pairs.
    Blocks hold the same pairs in the same order however the table is stored. Texts are read into features once, which are kept till the field is known.
    """
    rows = cut(pairs.select("record_table", "record_id", "question", "answer", F.coalesce("exempt", F.lit(False)).alias("exempt"), is_empty(F.col("answer")).alias("empty")).distinct().filter("NOT exempt AND record_id IS NOT NULL"))
    full = rows.filter("NOT empty").select("record_table", "record_id", "question", "answer")
    context = rows.sparkSession.sparkContext
    words = context.broadcast(Languages.of_table(full))
    count, length = full.agg(F.count("*"), F.coalesce(F.sum(F.length("answer").cast("long")), F.lit(0))).first()
    blocks = max(1, count // block, length // _BLOCK_TEXT)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told: list[tuple[list[list[int]], list[int]]] = []
        for batch in batches:
            for at in range(0, len(batch), _AT_ONCE):
                some = batch[at : at + _AT_ONCE]
                found = [Pair(q, a, words.value) for q, a in zip(some["question"], some["answer"], strict=True)]
                features = [p.features() for p in found]
                told += [(f, n) for p, f in zip(found, features, strict=True) if p.parts and (n := p.weak_labels())]
                yield pd.DataFrame({"pairs": [_packed(some, [p.told_by() for p in found], features)], "feature": None, "weight": None})
        yield _weights(_fitted(told))

    order = [F.xxhash64("record_table", "record_id"), "record_table", "record_id", "question", "answer"]
    known = cut(full.repartition(blocks, "record_table", "record_id").sortWithinPartitions(*order).mapInPandas(read, "pairs binary, feature int, weight array<long>"))
    model = context.broadcast(_leaning(_mean_field(known.filter("feature IS NOT NULL").select("feature", "weight"))))

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for kept in batch["pairs"]:
                tables, ids, clauses, features = _unpacked(kept)
                defects = [c.defect(t) for c, t in zip(clauses, model.value.decode(features), strict=True)]
                yield pd.DataFrame({"record_table": tables, "record_id": ids, "defect": pd.Series(defects, dtype=object)}).dropna(subset=["defect"])

    tagged = known.filter("pairs IS NOT NULL").select("pairs").mapInPandas(tag, "record_table string, record_id long, defect string")
    return rows.filter("empty").select("record_table", "record_id", F.lit("empty").alias("defect")).unionByName(tagged).groupBy("record_table", "record_id").agg(F.min("defect").alias("defect"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    chat = pair_up(table(spark, folder, "messages", "id", "session_id", "role", "content", "seq", "loaded_at"))
    items = table(spark, folder, "qa_test_v2", "item_id", "question", "golden_answer", "category")
    return chat.select(F.lit("messages").alias("record_table"), "record_id", "question", "answer", F.lit(False).alias("exempt")).unionByName(
        items.select(F.lit("qa_test_v2").alias("record_table"), F.col("item_id").alias("record_id"), "question", F.col("golden_answer").alias("answer"), (F.col("category") == "no_knowledge").alias("exempt"))
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return answer_defects(_pairs(spark, folder))


SQL: dict[str, str] = {}
QUERIES = {"p1_found": p1_found}
