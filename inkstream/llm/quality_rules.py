"""Quality rules learned as a decision list from labelled text statistics.

Every text is measured once. Sequential covering learns rules for low quality: a conjunction of thresholds grows one
condition at a time by information gain on two thirds of the labelled rows, is pruned from the end on the other third,
and is kept if it is precise enough there; the rows that it covers go and the next rule is sought. The list is
emitted as an ordered Spark conditional expression over the measured columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, per_text, written

#: Characters that count as symbols, and the blanks between words.
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"
#: Labelled rows that the rules are learned from, at most; the first by a hash of the id.
LABELLED_ROWS = 20_000
WINDOW = 5
#: Base rules: fewest words, and the most words in repeated windows in a hundred.
LEAST_WORDS, MOST_REPEATED = 10, 20
MOST_RULES, MOST_CONDITIONS, LEAST_PRECISION, LEAST_COVER = 12, 4, 0.9, 3

#: What a text's measures are; the shares derived from them are what rules test.
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_ending_marks", "n_same_next"]
FEATURES = ["symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "same_next_share", "word_length"]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of `window` words that occur twice or more in the list.

    Windows get exact numbers: pairs of words first, then pairs of pairs, and so on; no hash can collide.
    """
    if len(words) <= window:
        return 0
    seen: dict[bytes, int] = {}
    single = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    numbers, length = single, 1
    while length < window:
        step = min(length, window - length)
        other = numbers if step == length else single
        if step != length:
            step, other = 1, single
        numbers = np.unique((numbers[: len(words) - length - step + 1] << 32) | other[length : length + len(words) - length - step + 1], return_inverse=True)[1]
        length += step
    often = np.bincount(numbers) > 1
    at = np.flatnonzero(often[numbers])
    if not len(at):
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of a text; all zero for a null one."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines, seen, repeated = 0, set(), 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += 1
            repeated += line in seen
            seen.add(line)
    upper = len(text) - len(text.translate(_UPPER_OUT)) if text.isascii() else sum(map(str.isupper, text))
    letters = sum(map(str.isalpha, text)) if not text.isascii() else len(text) - len(text.translate(_LETTERS_OUT))
    marks = sum(w[-2:-1] in _MARKS and len(w) > 1 for w in words)
    same = sum(map(bytes.__eq__, words, words[1:]))
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), repeated, repeated_words(words), lines, upper, letters, marks, same)


_UPPER_OUT = dict.fromkeys(range(ord("A"), ord("Z") + 1))
_LETTERS_OUT = _UPPER_OUT | dict.fromkeys(range(ord("a"), ord("z") + 1))
_MARKS = frozenset(bytes([c]) for c in b"!#$%&*<>?|~@^=+")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, MEASURES): one row per document."""

    def make() -> Callable[[list], list[pa.Array]]:
        return lambda texts: [pa.array(column, pa.int64()) for column in zip(*map(measure, texts))]

    return per_text(docs, [id_col], ", ".join(f"{m} bigint" for m in MEASURES), make, text_col)


def with_features(rows: DataFrame) -> DataFrame:
    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))

    parts = {"symbol_share": ("n_symbols", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"), "upper_share": ("n_upper", "n_letters"), "mark_share": ("n_ending_marks", "n_words"), "same_next_share": ("n_same_next", "n_words"), "word_length": ("word_chars", "n_words")}
    return rows.withColumns({name: share(*of) for name, of in parts.items()})


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.feature] >= self.threshold if self.above else table[self.feature] <= self.threshold

    def column(self) -> Column:
        return F.col(self.feature) >= self.threshold if self.above else F.col(self.feature) <= self.threshold


Rule = tuple[Condition, ...]


def covered(rule: Rule, table: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    for condition in rule:
        rows = rows & condition.holds(table)
    return rows


def _gain(before_low: int, before: int, low: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Information gain of keeping `low` of `total` rows."""
    with np.errstate(divide="ignore", invalid="ignore"):
        gained = low * (np.log2(low / total) - math.log2(before_low / before))
    return np.where((low > 0) & (total > 0), gained, -1.0)


def grow(table: dict[str, np.ndarray], low: np.ndarray, rows: np.ndarray) -> Rule:
    """Add the condition with the highest gain until only low-quality rows are covered or none gains."""
    rule: Rule = ()
    while len(rule) < MOST_CONDITIONS and (rows & ~low).any() and (rows & low).any():
        best: tuple[float, Condition | None] = (1e-9, None)
        n_low, n = int((rows & low).sum()), int(rows.sum())
        for feature in sorted(table):
            values, ends = np.unique(table[feature][rows], return_inverse=True)
            if len(values) < 2:
                continue
            middle = (values[1:] + values[:-1]) / 2
            lows = np.cumsum(np.bincount(ends, low[rows], len(values)))[:-1]
            totals = np.cumsum(np.bincount(ends, minlength=len(values)))[:-1]
            for above, gains in ((False, _gain(n_low, n, lows, totals)), (True, _gain(n_low, n, n_low - lows, n - totals))):
                at = int(np.argmax(gains))
                if gains[at] > best[0]:
                    best = (float(gains[at]), Condition(feature, above, float(middle[at])))
        if best[1] is None:
            break
        rule = (*rule, best[1])
        rows = covered((best[1],), table, rows)
    return rule


def prune(rule: Rule, table: dict[str, np.ndarray], low: np.ndarray, rows: np.ndarray) -> Rule:
    """The shortest beginning of the rule with the best (low - other) / covered on the pruning rows."""

    def worth(part: Rule) -> float:
        hit = covered(part, table, rows)
        return (2 * int((hit & low).sum()) - int(hit.sum())) / max(1, int(hit.sum()))

    return max((rule[:n] for n in range(1, len(rule) + 1)), key=lambda part: (worth(part), -len(part)), default=())


def learn(table: dict[str, np.ndarray], low: np.ndarray) -> list[Rule]:
    """Ordered rules that mark low quality; none if there is nothing to learn from. The same rows give the same rules."""
    rules: list[Rule] = []
    third = np.arange(len(low)) % 3 == 2
    left = np.ones(len(low), bool)
    while len(rules) < MOST_RULES and (left & low).any():
        rule = prune(grow(table, low, left & ~third), table, low, left & third)
        hit = covered(rule, table, left) if rule else np.zeros(len(low), bool)
        if hit.sum() < LEAST_COVER or (hit & low).sum() < LEAST_PRECISION * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list: the first rule that holds drops the document, what no rule covers is kept."""
    chain = None
    for rule in rules:
        test = rule[0].column()
        for condition in rule[1:]:
            test = test & condition.column()
        chain = F.when(test, F.lit(False)) if chain is None else chain.when(test, F.lit(False))
    return F.lit(True) if chain is None else chain.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every document.

    kept: not base_failed and not dropped by the list that is learned from at most labelled_rows labelled documents
    which pass the base rules (label 1 good, 0 low; null labels are left out; several labels of one id count each).
    Null and empty texts measure 0 and fail the base rules. Without labels nothing else is dropped. Repeated rows
    stay; a null id has no label. An empty table gives no rows; extra columns aren't read.
    """
    rows = with_features(written(measured(docs, id_col, text_col), "quality-measures"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    known = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).alias("label_id"), (F.col(label_col) == 0).alias("low"))
    labelled = written(rows.filter("not base_failed").join(known, F.col(id_col) == F.col("label_id")).select("label_id", *FEATURES, "low"), "quality-labelled")
    sample = first_by_hash(labelled, "label_id", labelled_rows, *FEATURES, "low")
    found = sample.select(*FEATURES, "low").toPandas()
    rules = learn({f: found[f].to_numpy(float) for f in FEATURES}, found["low"].to_numpy(bool))
    return rows.select(id_col, *MEASURES[:5], "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept"))
