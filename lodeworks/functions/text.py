"""Text analysis: tokens, stop words, Porter2 stems, paragraphs and chunks."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import fnv1a, fnv1a_many

WORD_GAP = r"[^\p{L}\p{Nd}]+"

# The Snowball project's English stop words.
_LISTED = tuple(
    "a about above after again against all am an and any are aren't as at be because been before being below between both but by "
    "can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't "
    "have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is "
    "isn't it it's its itself let's me more most mustn't my myself no nor not of off on once only or other ought our ours ourselves "
    "out over own same shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs them themselves "
    "then there there's these they they'd they'll they're they've this those through to too under until up very was wasn't we we'd "
    "we'll we're we've were weren't what what's when when's where where's which while who who's whom why why's with won't would "
    "wouldn't you you'd you'll you're you've your yours yourself yourselves".split()
)
# Words that also come out of a contraction and are no stop words.
_WORDS = ("can", "let", "won")
#: With what splitting at apostrophes leaves of the contractions.
STOPWORDS = (*_LISTED, *sorted({part for w in _LISTED if "'" in w for part in w.split("'")} - {*_LISTED, *_WORDS}))


def tokens(text: Column) -> Column:
    """Maximal runs of letters and decimal digits, in lower case."""
    return F.filter(F.split(F.lower(text), WORD_GAP), lambda w: w != "")


def without_stopwords(words: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    return F.filter(words, lambda w: ~w.isin(*(x for x in stopwords if "'" not in x)))  # one lookup a word; tokens hold no apostrophe


#: What tokens are made of.
LETTER = r"[\p{L}\p{Nd}]"


def one_of(words: Iterable[str]) -> str:
    """A pattern of any of some words, by their common beginnings."""
    tree: dict = {}
    for word in words:
        node = tree
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [re.escape(c) + pattern(n) for c, n in sorted(node.items()) if c]
        return f"(?:{'|'.join(ways)})" + "?" * ("" in node) if ways else ""

    return pattern(tree)


def is_token(word: str) -> bool:
    """Whether a word can be a token."""
    return bool(word) and all((kind := unicodedata.category(c))[0] == "L" or kind == "Nd" for c in word)


def token_pattern(stopwords: tuple[str, ...] = ()) -> str:
    """A pattern of every token of a lower-case text that is no stop word."""
    listed = one_of(w for w in stopwords if is_token(w))
    return rf"(?<!{LETTER})(?!{listed}(?!{LETTER})){LETTER}++" if listed else f"{LETTER}++"


# Porter2 (Snowball English), on lower-case words

_V = "[aeiouy]"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

# Exceptions and suffix tables of the algorithm.
_EXACT = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": ""}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    m = re.match("gener|commun|arsen", word) or re.search(f"{_V}[^aeiouy]", word)
    r1 = m.end() if m else len(word)
    m = re.compile(f"{_V}[^aeiouy]").search(word, r1)
    return r1, m.end() if m else len(word)


def _ends_short(word: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", word) or re.fullmatch(r"[aeiouy][^aeiouy]", word))


def stem(word: str) -> str:
    """The Porter2 stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in _EXACT:
        return _EXACT[word]
    word = word.removeprefix("'")
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    r1, r2 = _regions(word)
    for suffix in ("'s'", "'s", "'"):
        if word.endswith(suffix):
            word = word[: -len(suffix)]
            break
    # 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(_V, word[:-2]):
        word = word[:-1]
    if word in _AFTER_1A:
        return word
    # 1b
    if m := re.search(r"(eedly|eed)$", word):
        if m.start() >= r1:
            word = word[: m.start()] + "ee"
    elif (m := re.search(r"(ingly|edly|ing|ed)$", word)) and re.search(_V, word[: m.start()]):
        word = word[: m.start()]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(_DOUBLE):
            word = word[:-1]
        elif r1 >= len(word) and _ends_short(word):
            word += "e"
    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    # 2
    for suffix, to in _STEP2.items():
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            before = word[at - 1 : at]
            if at >= r1 and not (suffix == "ogi" and before != "l") and not (suffix == "li" and before not in tuple("cdeghkmnrt")):
                word = word[:at] + to
            break
    # 3
    for suffix, to in _STEP3.items():
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if at >= (r2 if suffix == "ative" else r1):
                word = word[:at] + to
            break
    # 4
    for suffix in _STEP4:
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if at >= r2 and (suffix != "ion" or word[at - 1 : at] in ("s", "t")):
                word = word[:at]
            break
    # 5
    if word.endswith("e"):
        if len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _ends_short(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


def stems(words: DataFrame, column: str = "term") -> DataFrame:
    """``words`` (distinct terms) with a column ``stem``; an Arrow UDF over distinct terms only."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(stem)

    return words.withColumn("stem", run(column))


@dataclass(frozen=True)
class Analyzer:
    """How a text becomes terms."""

    stopwords: tuple[str, ...] = ()
    stemming: bool = False

    def terms(self, text: Column) -> Column:
        found = tokens(text)
        return without_stopwords(found, self.stopwords) if self.stopwords else found


_analyzers: dict[str, Analyzer] = {"english": Analyzer(STOPWORDS, True), "stopped": Analyzer(STOPWORDS), "simple": Analyzer()}


def register_analyzer(name: str, analyzer: Analyzer) -> None:
    _analyzers[name] = analyzer


def analyzer(name: str = "") -> Analyzer:
    """A registered analyzer; the empty name is english."""
    try:
        return _analyzers[name or "english"]
    except KeyError:
        raise ValueError(f"unknown analyzer {name!r}") from None


def term_ids(words: Column, modulo: int = 0, bits: int = 32) -> Column:
    """FNV-1a numbers of terms, where agreement with hashed term ids is needed; of 64 bits, as signed longs."""

    @F.pandas_udf("array<bigint>")
    def run(s: pd.Series) -> pd.Series:
        distinct = list(set().union(*s))  # the terms of a batch
        whole = [fnv1a(w.encode()) for w in distinct] if bits == 32 else fnv1a_many([w.encode() for w in distinct]).tolist()
        of = {w: n % modulo if modulo else n for w, n in zip(distinct, whole)}
        return s.map(lambda ws: [of[w] for w in ws])

    return run(words)


def paragraphs(text: Column) -> Column:
    """Blank-line separated parts, trimmed, without empty ones."""
    parts = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n\n")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def chunk_text(text: str, target: int = 512, overlap: int = 64) -> list[str]:
    """Whole paragraphs packed to ``target`` words; a longer paragraph is cut hard, each part beginning with the ``overlap``
    last words of the one before."""
    out: list[str] = []
    held: list[str] = []
    for paragraph in text.replace("\r\n", "\n").split("\n\n"):
        words = paragraph.split()
        if not words:
            continue
        if held and len(held) + len(words) > target:
            out.append(" ".join(held))
            held = []
        if len(words) <= target:
            held += words
            continue
        step = max(1, target - max(0, min(overlap, target - 1)))
        for begin in range(0, len(words), step):
            out.append(" ".join(words[begin : begin + target]))
            if begin + target >= len(words):
                break
    if held:
        out.append(" ".join(held))
    return out


#: Texts that are cut at once.
CHUNKED = 64


def chunks(docs: DataFrame, id_column: str, text_column: str, target: int = 512, overlap: int = 64, cutter: Callable = chunk_text) -> DataFrame:
    """(source, index, content) of every document's chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, CHUNKED):  # whatever a batch holds, the chunks of a few texts are in memory
                part = batch.slice(begin, CHUNKED).to_pydict()
                rows = [(s, i, c) for s, t in zip(part["source"], part["text"]) if t for i, c in enumerate(cutter(t, target, overlap))]
                source, index, content = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(source, pa.string()), pa.array(index, pa.int32()), pa.array(content, pa.string())], ["source", "index", "content"])

    picked = docs.select(F.col(id_column).cast("string").alias("source"), F.col(text_column).alias("text"))
    return picked.mapInArrow(run, "source string, index int, content string")
