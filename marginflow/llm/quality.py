"""Quality rules, line first: failing lines go, then documents that lost too much of their text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from operator import eq

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marginflow.llm.frames import append_columns

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

# Line patterns, in a form that both Python's `regex` and RE2 take.
SENTENCE_MARK = r"[.!?:;,…。！？]"
SEPARATOR_WORD = r"(?:^|[\x20\x09-\x0D])[|»«›‹>•·–—/\\-]+(?:$|[\x20\x09-\x0D])"
SYMBOL_WORD = r"[^\x20\x09-\x0D]*[#*$%&|<>][^\x20\x09-\x0D]*"
BOILERPLATE = (
    r"(?i)(all rights reserved|copyright (?:©|\(c\)|\d{4})|licensed under|"
    r"released under the|this work is licensed|terms of (?:use|service)|privacy policy|"
    r"cookie (?:policy|settings)|accept (?:all )?cookies|enable javascript|sign up for|"
    r"subscribe to|log in to|click here|skip to (?:main )?content|lorem ipsum)"
)


@dataclass(frozen=True)
class LineRules:
    """Bounds of the rules; a line or document beyond one of them fails.

    Shares are in percent of words, so that comparisons are between integers.
    """

    min_words: int = 10  # words a document must have
    max_repeat_percent: int = 20  # words in repeated 5-word windows
    max_separator_percent: int = 15  # words of a line that are separators: navigation
    max_symbol_percent: int = 30  # words of a line that hold one of SYMBOLS
    min_marked_words: int = 3  # from so many words on, a line needs a sentence mark
    min_shout_words: int = 5  # from so many words on, a line needs a lower-case letter
    max_stutter_percent: int = 30  # words of a line that repeat the word before them
    max_lost_percent: int = 50  # words of a document in removed lines


_MARK = regex.compile(SENTENCE_MARK)
_SEPARATORS = frozenset("|»«›‹>•·–—/\\-")
_SYMBOLS = regex.compile(r"[#*$%&|<>]")
_BOILERPLATE = regex.compile(BOILERPLATE)
_LOWER = regex.compile(r"\p{Ll}")
_UPPER = regex.compile(r"\p{Lu}")


def line_fault(line: str, words: list[str], rules: LineRules) -> str | None:
    """The first rule that a line with words fails: navigation, boilerplate, symbols, ..."""
    n = len(words)
    separators = sum(1 for w in words if w[0] in _SEPARATORS and _SEPARATORS.issuperset(w))
    if 100 * separators > rules.max_separator_percent * n:
        return "navigation"
    if _BOILERPLATE.search(line):
        return "boilerplate"
    if _SYMBOLS.search(line):
        marked = sum(1 for w in words if _SYMBOLS.search(w))
        if 100 * marked > rules.max_symbol_percent * n:
            return "symbols"
    if n >= rules.min_marked_words and not _MARK.search(line):
        return "punctuation"
    if 100 * sum(map(eq, words, words[1:])) > rules.max_stutter_percent * n:
        return "stutter"
    if n >= rules.min_shout_words and not _LOWER.search(line) and _UPPER.search(line):
        return "shouting"
    return None


def _split(text: str) -> list[str]:
    """Words of a text. `bytes.split` knows the ASCII blanks only, unlike `str.split`."""
    if text.isascii() and "\x1c" > max(text, default=" "):
        return text.split()
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]


def repeated_words(words: Sequence) -> int:
    """Words that lie in a 5-word window which occurs twice or more, the first one included."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered = end = 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered += i + 5 - max(i, end)
            end = i + 5
    return covered


def judge(text: str | None, rules: LineRules) -> dict:
    """All figures of one text, its verdict and what is left of it."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass").split()
    n_words = len(raw)
    word_chars = len(text) - sum(map(text.count, BLANKS))
    n_repeat = repeated_words(raw)
    base_failed = n_words < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * n_words
    seen: set[str] = set()
    n_dup = removed = 0
    faults: Counter = Counter()
    left = []
    for line in text.split("\n"):
        words = _split(line)
        if not words:
            left.append(line)
            continue
        fault = line_fault(line, words, rules)
        if line in seen:
            n_dup += 1
            fault = fault or "repeated"
        seen.add(line)
        if fault:
            faults[fault] += 1
            removed += len(words)
        else:
            left.append(line)
    kept = not base_failed and 100 * removed <= rules.max_lost_percent * n_words
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat,
        "base_failed": base_failed,
        "kept": kept,
        "n_removed_lines": sum(faults.values()),
        "n_removed_words": removed,
        "clean_text": "\n".join(left),
    }


FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("n_removed_lines", T.LongType()),
        T.StructField("n_removed_words", T.LongType()),
        T.StructField("clean_text", T.StringType()),
    ]
)


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    rules: LineRules = LineRules(),
    with_text: bool = True,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Each document with the figures of its text, the verdict `kept` and the cleaned text.

    Rows are judged one by one where they are: no shuffle, any order, repeated rows alike.
    A null text has no words and is not kept, its `clean_text` is empty; so is an empty text.
    A line is judged by itself, whatever its length. Lines without a word stay as they are.
    Input columns named like a result column are replaced. An empty table gives no rows.
    """
    fields = T.StructType([f for f in FIELDS if with_text or f.name != "clean_text"])

    def compute(batch: pa.RecordBatch) -> Mapping[str, Sequence]:
        texts = batch.column(batch.schema.get_field_index(text))
        found = [judge(t.as_py(), rules) for t in texts]
        return {f.name: [x[f.name] for x in found] for f in fields}

    columns = list(docs.columns if keep is None else keep)
    source = docs.select(*dict.fromkeys([*columns, text]))
    return append_columns(source, fields, compute, columns)


def clean(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The documents kept, without their failing lines, with the columns they came with."""
    verdict = quality_rules(docs, text, rules)
    columns = [f"`{c}`" if c != text else f"clean_text AS `{text}`" for c in docs.columns]
    return verdict.filter("kept").selectExpr(*columns)
