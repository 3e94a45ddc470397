"""Language identification by cross-parsing against suffix automata of labelled text."""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marginflow.llm.frames import append_columns, slices

UNKNOWN = "und"
FOLDS = 5  # documents of remainder 0 are held out
SLICE_BYTES = 2 * 1024 * 1024


@dataclass(frozen=True)
class Bounds:
    """What is learned from and how texts are parsed.

    The sample has at most `docs` texts of a language, `chars` characters in all of them
    together, and `total_chars` over all languages, of the `languages` most frequent ones.
    """

    docs: int = 64
    chars: int = 32_000
    total_chars: int = 160_000
    languages: int = 1000
    own_symbols: int = 96  # the rest of the letters share `shared_symbols`
    shared_symbols: int = 32
    segment: int = 1000  # phrases end at the end of a segment of so many characters


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def training_sample(
    docs: DataFrame, bounds: Bounds, text: str, lang: str, doc_id: str
) -> dict[str, list[str]]:
    """Whole texts by language from the documents that are not held out.

    Of the different texts of a language that are a quarter of the bound at most, those with the
    smallest digests are taken, so copies of a text count once and a language of few texts gets
    them all. Only digests and lengths are shuffled; which texts fit is settled by these, and
    the chosen texts are read in a second pass. Where a language has no text so short, the first
    characters of its shortest text stand in. Of more than `bounds.languages` languages those
    with the most documents are learned, of equal ones the first by code.
    """
    rows = docs.select(
        F.col(lang).alias("lang"),
        F.col(text).alias("text"),
        F.length(F.col(text)).alias("size"),
        fold(F.col(doc_id)).alias("fold"),
    ).filter((F.col("fold") != 0) & F.col("lang").isNotNull() & (F.col("size") > 0))
    short = F.col("size") <= bounds.chars // 4
    stand_in = F.when(~short, F.struct("size", F.substring("text", 1, bounds.chars).alias("part")))
    counts = (
        rows.groupBy("lang")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count(F.when(short, 1)).alias("short"),
            F.min(stand_in).alias("least"),
        )
        .orderBy(F.desc("n"), "lang")
        .select("lang", F.when(F.col("short") == 0, F.col("least.part")).alias("least"))
        .limit(bounds.languages)
        .collect()
    )
    if not counts:
        return {}
    each = min(bounds.chars, max(1, bounds.total_chars // len(counts)))
    learned = docs.sparkSession.createDataFrame([(r.lang,) for r in counts], "lang string")
    digests = rows.filter(short).select("lang", F.xxhash64("text").alias("digest"), "size")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("digest", "size"))
    smallest = (
        digests.join(F.broadcast(learned), "lang")  # bounds.languages rows at most
        .distinct()
        .withColumn("nth", nth)
        .filter(F.col("nth") <= bounds.docs)
        .collect()
    )
    wanted, used = [], Counter()
    for r in sorted(smallest, key=lambda r: (r.lang, r.nth)):
        if used[r.lang] + r.size <= each or r.lang not in used:
            wanted.append((r.lang, r.digest, r.size, r.nth))
            used[r.lang] += r.size
    sample: dict[str, list[str]] = {r.lang: [r.least[:each]] for r in counts if r.least}
    asked = docs.sparkSession.createDataFrame(
        wanted, "lang string, digest long, size int, nth int"
    )
    chosen = (
        rows.filter(short)
        .withColumn("digest", F.xxhash64("text"))
        .join(F.broadcast(asked), ["lang", "digest", "size"])  # bounds.docs rows a language at most
        .groupBy("lang", "nth")
        .agg(F.min(F.substring("text", 1, each)).alias("text"))
        .collect()
    )
    for r in sorted(chosen, key=lambda r: (r.lang, r.nth)):
        sample.setdefault(r.lang, []).append(r.text)
    return sample


def letters(text: str) -> str:
    """Lower case, with every run of characters that are not letters as one blank."""
    out = "".join(c if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in text.lower())
    return " ".join(out.split())


@cache
def letter_table() -> np.ndarray:
    """Which code points are letters or marks on them."""
    kinds = (unicodedata.category(chr(cp))[0] in "LM" for cp in range(0x110000))
    return np.fromiter(kinds, dtype=bool, count=0x110000)


def suffix_automaton(symbols: Sequence[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all factors of the sequence; 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


class CrossParser:
    """Counts, for many texts at once, the phrases each language's labelled text needs.

    A phrase is the longest match that a walk from the start of the automaton finds; where it
    cannot go on, the next phrase starts at that character. A character that the language
    lacks is a phrase by itself. The walks of all segments and languages go on in step, one
    character at a time, over one table: for each state and symbol four times the next state's
    row plus the phrases that end.
    """

    def __init__(self, sample: Mapping[str, Sequence[str]], bounds: Bounds):
        self.languages = sorted(sample)
        self.segment = bounds.segment
        plain = {k: [letters(t) for t in sample[k]] for k in self.languages}
        common = Counter(c for texts in plain.values() for t in texts for c in t if c != " ")
        own = sorted(common, key=lambda c: (-common[c], c))
        shared = 1 if len(own) <= bounds.own_symbols else bounds.shared_symbols
        own = own[: bounds.own_symbols]
        # Symbol 0 is the blank, then the shared symbols, then those of their own.
        points = np.arange(0x110000)
        self.symbol = (1 + points % shared).astype(np.uint8)
        self.symbol[~letter_table()] = 0
        for i, c in enumerate(own):
            self.symbol[ord(c)] = 1 + shared + i
        self.width = 1 + shared + len(own)
        tables, self.roots, base = [], [], 0
        for k in self.languages:
            joined = " ".join(plain[k])
            moves = suffix_automaton(self.symbol[[ord(c) for c in joined]].tolist())
            n, w = len(moves), self.width
            table = np.full((n, w), -1, dtype=np.int64)
            for state, row in enumerate(moves):
                table[state, list(row.keys())] = list(row.values())
            start = table[0].copy()
            missing = table < 0
            lacking = start < 0
            ends = np.where(missing, np.where(lacking, 2, 1), 0)
            ends[0] = np.where(lacking, 1, 0)
            target = np.where(missing, np.where(lacking, 0, start), table)
            tables.append((((target + base) * w) * 4 + ends).ravel())
            self.roots.append(base * w)
            base += n
        self.table = np.concatenate(tables) if tables else np.zeros(0, dtype=np.int64)
        if self.table.size and self.table.max() < 2**31:
            self.table = self.table.astype(np.int32)
        self.roots = np.array(self.roots, dtype=self.table.dtype)

    def phrases(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases by language and text, letters by text)."""
        lowered = [t.lower() for t in texts]
        sizes = np.array([len(t) for t in lowered], dtype=np.int64)
        flat = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        symbols = self.symbol[flat]
        owner = np.repeat(np.arange(len(texts)), sizes)
        # Blanks at the start of a text or after a blank go.
        blank = symbols == 0
        first = np.zeros(len(symbols) + 1, dtype=bool)
        first[np.concatenate([[0], np.cumsum(sizes)])] = True
        after = np.concatenate([[True], blank[:-1]]) | first[:-1]
        keep = ~(blank & after)
        symbols, owner = symbols[keep], owner[keep]
        n_letters = np.bincount(owner[symbols != 0], minlength=len(texts))
        counts = np.bincount(owner, minlength=len(texts))
        found = np.zeros((len(self.languages), len(texts)), dtype=np.int64)
        if not len(symbols) or not self.languages:
            return found, n_letters
        # Segments, longest first, as columns of a matrix of positions.
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        pieces = -(-counts // self.segment)
        text_of = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(text_of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = starts[text_of] + nth * self.segment
        length = np.minimum(self.segment, counts[text_of] - nth * self.segment)
        order = np.argsort(-length, kind="stable")
        begin, length, text_of = begin[order], length[order], text_of[order]
        longest = int(length[0])
        padded = np.concatenate([symbols, np.zeros(self.segment, dtype=np.uint8)])
        steps = padded[begin[None, :] + np.arange(longest)[:, None]].astype(self.table.dtype)
        active = np.searchsorted(-length, -np.arange(1, longest + 1), side="right")
        state = np.repeat(self.roots[:, None], len(begin), axis=1)
        ended = np.zeros(state.shape, dtype=np.int32)
        for t in range(longest):
            k = active[t]
            move = self.table[state[:, :k] + steps[t, :k]]
            ended[:, :k] += move & 3
            state[:, :k] = move >> 2
        ended += state != self.roots[:, None]
        for i in range(len(self.languages)):
            found[i] = np.bincount(text_of, weights=ended[i], minlength=len(texts))
        return found, n_letters

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        """Language of each text and by what share it needs fewer phrases than the next."""
        found, n_letters = self.phrases([t or "" for t in texts])
        names, scores = [], []
        for i in range(len(texts)):
            if texts[i] is None or not n_letters[i] or not self.languages:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            ranked = np.argsort(found[:, i], kind="stable")
            best = int(found[ranked[0], i])
            second = int(found[ranked[1], i]) if len(ranked) > 1 else 0
            names.append(self.languages[ranked[0]])
            scores.append(1.0 if len(ranked) == 1 else (second - best) / second)
        return names, scores


_PARSERS: dict[str, CrossParser] = {}


def parser_of(sample: Mapping[str, Sequence[str]], bounds: Bounds) -> CrossParser:
    """The parser of a sample, made once per worker process."""
    key = hashlib.sha256(repr((sorted(sample.items()), bounds)).encode()).hexdigest()
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = CrossParser(sample, bounds)
    return _PARSERS[key]


def identify(
    docs: DataFrame,
    sample: Mapping[str, Sequence[str]],
    bounds: Bounds = Bounds(),
    text: str = "text",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Every document with `lang_pred` and `score` (0 to 1), from its whole text alone.

    The language whose labelled text needs the fewest phrases wins; all languages parse the
    same characters, so numbers of phrases compare as they are normalised by length. Ties go
    to the language code that sorts first, with score 0. A null text, or one without letters,
    is `und` with score 0, and so is every text if nothing was learned. Input columns named
    like a new one are replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(dict(sample))

    def compute(batch: pa.RecordBatch) -> dict:
        parser = parser_of(model.value, bounds)
        texts = batch.column(batch.schema.get_field_index(text))
        names: list[str] = []
        scores: list[float] = []
        for start, end in slices(texts, SLICE_BYTES):
            some, values = parser.predict(texts[start:end].to_pylist())
            names += some
            scores += values
        return {"lang_pred": names, "score": scores}

    columns = list(docs.columns if keep is None else keep)
    source = docs.select(*dict.fromkeys([*columns, text]))
    fields = T.StructType(
        [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    return append_columns(source, fields, compute, columns)


def language_id(
    docs: DataFrame,
    bounds: Bounds = Bounds(),
    text: str = "text",
    lang: str = "lang",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Learn from the documents that are not held out, then identify all; adds `held_out`.

    Rows with a null label, or a null or empty text, are not learned from; a null id counts as an
    empty text and is held out if the fold of that is. Copies of a text are learned once for
    each of their labels. Every row gets a prediction as `identify` describes, whatever its
    label; where nothing was learned, or the table is empty, no language is predicted.
    """
    sample = training_sample(docs, bounds, text, lang, doc_id)
    rows = docs.withColumn("held_out", fold(F.col(doc_id)) == 0)
    return identify(rows, sample, bounds, text)
