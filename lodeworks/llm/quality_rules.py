"""Quality rules: text statistics and a learned decision list.

``text_statistics`` measures every whole text. ``learn_rules`` fits a decision list for low quality by sequential covering
on labelled rows: a rule is a conjunction of threshold tests, grown on two thirds of the rows by information gain until it covers no
good row, pruned on the other third by dropping its last tests, and kept if its pruned precision reaches ``PRECISION``; the rows
it covers leave, and the next rule is grown. ``verdict`` turns the list into one ordered Spark conditional expression, so
applying it costs no Python.

The fit takes at most ``PER_CLASS`` labelled rows of each label value (those with the smallest hashed ids among ids whose
crc32 mod 5 is not 0), whole texts of any length; they become counts in the executors; statistics, rules and verdicts cover all rows.

Defined results: a null text has no words, so every statistic is 0 and the base check fails it; null or repeated ids keep a row each;
without usable labels the list is empty and keeps all that pass the base check.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, labelled_sample, text_bytes
from .words import numbered, window_hashes, window_starts

WINDOW, MIN_WORDS, REPEAT_PERCENT = 8, 20, 30
PER_CLASS, PRECISION, MOST_RULES, MOST_TESTS = 10_000, 0.97, 12, 4
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits")
_SYMBOLS = b"#*$%&|<>"
_NOT_CHARS = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))  # white space, and the bytes that continue a code point
_UPPER, _DIGITS, _MARKS = bytes(range(65, 91)), b"0123456789", b"!?|~^=+_{}[]\\"


def _repeated_words(words: list[bytes], n: int = WINDOW) -> int:
    """Words that lie in an n-word window found twice or more in the text."""
    windows = list(zip(*[words[i:] for i in range(n)]))
    often = Counter(windows)
    covered = np.zeros(len(words) + 1, np.int64)
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered[i] += 1
            covered[min(i + n, len(words))] -= 1
    return int((np.cumsum(covered)[:-1] > 0).sum())


def measure(texts: list[bytes]) -> dict[str, list[int]]:
    """COUNTS of each text."""
    found = numbered(texts)
    begins = found.begins
    starts = window_starts(begins, WINDOW)
    repeated = np.zeros(len(texts), np.int64)
    if len(starts):
        text = np.searchsorted(begins, starts, side="right") - 1
        keys = window_hashes(found.values, WINDOW)[starts]
        order = np.lexsort((keys, text))
        same = (keys[order][1:] == keys[order][:-1]) & (text[order][1:] == text[order][:-1])
        for i in np.unique(text[order][1:][same]).tolist():  # equal windows have equal hashes; the count itself compares words
            repeated[i] = _repeated_words(texts[i].split())
    lost = lambda x, chars: len(x) - len(x.translate(None, chars))
    lines = [[y for y in x.split(b"\n") if y.strip()] for x in texts]
    return {
        "n_words": np.diff(begins).tolist(),
        "word_chars": [len(x.translate(None, _NOT_CHARS)) for x in texts],
        "n_symbols": [lost(x, _SYMBOLS) for x in texts],
        "n_dup_lines": [len(x) - len(set(x)) for x in lines],
        "n_repeat_words": repeated.tolist(),
        "n_lines": [len(x) for x in lines],
        "n_upper": [lost(x, _UPPER) for x in texts],
        "n_marks": [lost(x, _MARKS) for x in texts],
        "n_digits": [lost(x, _DIGITS) for x in texts],
    }


def text_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and COUNTS of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "whole"):
                stats = measure(text_bytes(part.column("whole")))
                yield pa.RecordBatch.from_arrays([*(part.column(f"in_{c}") for c in keep), *(pa.array(stats[c], pa.int64()) for c in COUNTS)], [*keep, *COUNTS])

    kinds = dict(docs.dtypes)
    picked = docs.select(F.col("text").alias("whole"), *(F.col(c).alias(f"in_{c}") for c in keep))
    return picked.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{c} long" for c in COUNTS)]))


#: What the rules test: a name, and numerator and denominator among COUNTS.
FEATURES = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
}


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        top, below = FEATURES[self.feature]
        value = F.col(top) if below is None else F.col(top) / F.greatest(F.col(below), F.lit(1))
        return value >= self.threshold if self.above else value <= self.threshold

    def array(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] <= self.threshold


Rule = tuple[Test, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(np.logical_and, (t.array(x) for t in rule), np.ones(n, bool))


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: Rule = ()
    live = np.ones(len(bad), bool)
    while len(rule) < MOST_TESTS and (~bad[live]).any() and bad[live].any():
        p0, n0 = bad[live].sum(), (~bad[live]).sum()
        best, test = 0.0, None
        for feature, values in x.items():
            order = np.argsort(values[live], kind="stable")
            v, b = values[live][order], bad[live][order]
            cut = np.flatnonzero(v[1:] > v[:-1])  # between rows cut and cut+1
            if not len(cut):
                continue
            low_p, low_n = np.cumsum(b)[cut], np.cumsum(~b)[cut]
            for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                gain = p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1)) - np.log2(p0 / (p0 + n0)))
                i = int(gain.argmax())
                if gain[i] > best + 1e-9:
                    best, test = float(gain[i]), Test(feature, above, float((v[cut[i]] + v[cut[i] + 1]) / 2))
        if test is None:
            break
        rule += (test,)
        live &= test.array(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float, int]:
    """The prefix of the rule with the best (p-n)/(p+n) on held-back rows, its precision there and the bad rows it covers."""
    best, found = -2.0, (rule, 0.0, 0)
    for k in range(len(rule), 0, -1):
        hit = _covers(rule[:k], x, len(bad))
        p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best:
            best, found = worth, (rule[:k], p / (p + n) if p + n else 0.0, p)
    return found


def fit_list(x: dict[str, np.ndarray], bad: np.ndarray, held_back: np.ndarray) -> list[Rule]:
    """Sequential covering of the bad rows; an ordered list of rules that reject."""
    rules: list[Rule] = []
    live = np.ones(len(bad), bool)
    while len(rules) < MOST_RULES:
        grow, prune = live & ~held_back, live & held_back
        if not bad[grow].any():
            break
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow])
        if not rule:
            break
        rule, precision, hits = _prune(rule, {k: v[prune] for k, v in x.items()}, bad[prune])
        if precision < PRECISION or hits < 3:
            break
        rules.append(rule)
        live &= ~_covers(rule, x, len(bad))
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """A decision list from the documents' statistics and ``labels.quality`` (0 is what the rules reject)."""
    sample = labelled_sample(docs, labels, "quality", PER_CLASS)
    rows = text_statistics(sample, ("doc_id", "label")).toPandas()  # 2 * PER_CLASS rows of counts at most
    if rows.empty:
        return []
    rows = rows.sort_values("doc_id", ignore_index=True)
    x = {
        name: rows[top].to_numpy(float) if below is None else rows[top].to_numpy(float) / np.maximum(rows[below].to_numpy(float), 1)
        for name, (top, below) in FEATURES.items()
    }
    held_back = np.array([zlib.crc32(str(i).encode()) % 3 == 0 for i in rows["doc_id"]])
    return fit_list(x, rows["label"].to_numpy() == 0, held_back)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """Whether the list keeps a row, and the number of the rule that rejects it (null if none)."""
    fired = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules))):
        fired = F.when(reduce(lambda a, b: a & b, (t.column() for t in rule)), F.lit(number)).otherwise(fired)
    return fired.isNull(), fired


def describe(rules: list[Rule]) -> list[str]:
    return [" and ".join(f"{t.feature} {'>=' if t.above else '<='} {t.threshold:.6g}" for t in r) for r in rules]


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, the base statistics, base_failed, kept, rule (the one that rejects)."""
    keeps, fired = verdict(learn_rules(docs, labels))
    return text_statistics(docs).select(
        "doc_id", *COUNTS[:5], base_failed().alias("base_failed"), (~base_failed() & keeps).alias("kept"), fired.alias("rule")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that base check and decision list keep, with the columns of ``docs``."""
    keeps, _ = verdict(learn_rules(docs, labels))
    hidden = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(docs.columns)), "text")  # columns may be named like the counts
    kept = text_statistics(hidden, tuple(f"_{i}" for i in range(len(docs.columns)))).where(~base_failed() & keeps)
    return kept.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)))
