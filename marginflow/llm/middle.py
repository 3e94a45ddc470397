"""Fill-in-the-middle over seekable compressed frames.

A text is kept as independent zstandard frames, each a run of whole code points, with the number
of code points up to the end of each. A part of the text is found by these counts: only the frames
at its two ends are cut, those between are passed on as they are, one at a time. So a long text is
never whole in memory after it was framed, nor is its rearranged form.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginflow.llm.frames import append_columns

FRAME_BYTES = 256 * 1024  # of text in a frame
LEVEL = 1  # of the compression
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM = 90  # of 100: texts with a draw of this or more stay as they are
SPM_BELOW = 20  # of 100: of the others, those with a draw below this start with the suffix


@cache
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL)


@cache
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def code_points(data: bytes) -> int:
    """Bytes that begin a code point."""
    if data.isascii():
        return len(data)
    return int(np.count_nonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80))


def byte_place(data: bytes, n: int) -> int:
    """Where the code point with number `n` begins."""
    if data.isascii():
        return min(n, len(data))
    begins = np.flatnonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)
    return int(begins[n]) if n < len(begins) else len(data)


@dataclass
class Frames:
    """A text: compressed frames, and the code points up to the end of each."""

    frames: list[bytes] = field(default_factory=list)
    upto: list[int] = field(default_factory=list)

    @property
    def n(self) -> int:
        return self.upto[-1] if self.upto else 0

    def _add(self, data: bytes) -> None:
        self.frames.append(_compressor().compress(data))
        self.upto.append(self.n + code_points(data))

    @classmethod
    def of(cls, parts: Iterable[bytes], size: int = FRAME_BYTES) -> Frames:
        """Frames of a text that comes in parts, each of whole code points."""
        out, rest = cls(), b""
        for part in parts:
            rest = rest + part if rest else part
            at = 0
            while len(rest) - at >= size:
                end = at + size
                while end < len(rest) and end > at and rest[end] & 0xC0 == 0x80:
                    end -= 1
                if end == at:  # a code point that is longer than a frame
                    end += size
                    while end < len(rest) and rest[end] & 0xC0 == 0x80:
                        end += 1
                out._add(rest[at:end])
                at = end
            rest = rest[at:] if at else rest
        if rest:
            out._add(rest)
        return out

    def part(self, start: int, end: int) -> Iterator[bytes]:
        """The code points from `start` up to `end`, frame by frame."""
        i = bisect_right(self.upto, start)
        while i < len(self.frames):
            base = self.upto[i - 1] if i else 0
            if base >= end:
                return
            data = _decompressor().decompress(self.frames[i])
            low = byte_place(data, start - base) if start > base else 0
            high = byte_place(data, end - base) if end < self.upto[i] else len(data)
            if low < high:
                yield data[low:high] if high - low < len(data) else data
            i += 1

    def find(self, mark: bytes, start: int = 0) -> int:
        """Number of the code point at which the ASCII text `mark` is first found, -1 if nowhere."""
        tail, base = b"", start
        for data in self.part(start, self.n):
            both = tail + data
            at = both.find(mark)
            if at >= 0:
                # Bytes of a match that began in the frame before are one code point each.
                behind = len(tail) - at
                return base - behind if behind > 0 else base + code_points(data[: at - len(tail)])
            tail, base = both[-(len(mark) - 1) :], base + code_points(data)
        return -1


@dataclass(frozen=True)
class Cut:
    """How a text is rearranged: `form`, and the ends of prefix and middle."""

    form: str
    first: int
    second: int


def draw(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits that depend on seed and id alone; no id counts as empty."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def cut(doc_id: int | None, n: int, marked: bool, seed: int) -> Cut:
    """The cut of a text of `n` code points; `marked` texts hold one of the marks."""
    h1, h2, h3, h4 = draw(doc_id, seed)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    if n == 0 or marked or h3 % 100 >= PLAIN_FROM:
        return Cut("plain", first, second)
    return Cut("spm" if h4 % 100 < SPM_BELOW else "psm", first, second)


def rearranged(text: Frames, how: Cut) -> Iterator[bytes]:
    """The output, part by part."""
    prefix, middle = text.part(0, how.first), text.part(how.first, how.second)
    suffix = text.part(how.second, text.n)
    if how.form == "plain":
        yield from text.part(0, text.n)
    elif how.form == "psm":
        yield PREFIX
        yield from prefix
        yield SUFFIX
        yield from suffix
        yield MIDDLE
        yield from middle
    else:
        yield SUFFIX
        yield from suffix
        yield PREFIX
        yield from prefix
        yield MIDDLE
        yield from middle


def restored(output: Frames, form: str) -> Iterator[bytes]:
    """The text, from its output and form alone, part by part.

    The text holds no mark, and what stands before a mark can not make up one with its first
    letters, so each mark is where it is first found.
    """
    if form == "plain":
        yield from output.part(0, output.n)
        return
    size = len(MIDDLE)
    between = output.find(SUFFIX if form == "psm" else PREFIX, size)
    last = output.find(MIDDLE, between + size)
    one, two = (size, between), (between + size, last)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    yield from output.part(*prefix)
    yield from output.part(last + size, output.n)
    yield from output.part(*suffix)


def sha256(parts: Iterable[bytes]) -> str:
    digest = hashlib.sha256()
    for part in parts:
        digest.update(part)
    return digest.hexdigest()


def _fields(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


FRAMES = _fields(
    ("frames", T.ArrayType(T.BinaryType())),
    ("upto", T.ArrayType(T.LongType())),
    ("marked", T.BooleanType()),
)
FILLED = _fields(
    ("n", T.LongType()),
    ("form", T.StringType()),
    ("prefix_chars", T.LongType()),
    ("middle_chars", T.LongType()),
    ("frames", T.ArrayType(T.BinaryType())),
    ("upto", T.ArrayType(T.LongType())),
)
DIGESTS = _fields(("output_sha256", T.StringType()), ("restored_sha256", T.StringType()))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _texts(batch: pa.RecordBatch) -> Iterator[Frames]:
    for frames, upto in zip(_column(batch, "frames"), _column(batch, "upto")):
        yield Frames([f.as_py() for f in frames], upto.as_py())


def frame_texts(
    docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None, size: int = FRAME_BYTES
) -> DataFrame:
    """`docs` with the text as `frames` and `upto` instead, and whether it is `marked`.

    `frames` are independent zstandard frames of about `size` bytes of text, `upto` the code
    points up to the end of each. `marked` texts hold `<P>`, `<S>` or `<M>`. Rows neither move
    nor change their number, so the table can be written and read for later cuts in place of the
    texts. With `keep` (default: all columns but the text) other columns go along; those named
    like a new one are replaced. A null or empty text has no frames.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != text]

    def compute(batch: pa.RecordBatch) -> dict:
        out = {"frames": [], "upto": [], "marked": []}
        for value in _column(batch, text):
            data = value.as_buffer().to_pybytes() if value.is_valid else b""
            made = Frames.of([data], size)
            out["frames"].append(made.frames)
            out["upto"].append(made.upto)
            out["marked"].append(any(mark in data for mark in (PREFIX, SUFFIX, MIDDLE)))
        return out

    return append_columns(docs.select(*dict.fromkeys([*kept, text])), FRAMES, compute, kept)


def fill_middle(
    framed: DataFrame,
    doc_id: str = "doc_id",
    seed: int = 1,
    keep: Sequence[str] | None = None,
    size: int = FRAME_BYTES,
) -> DataFrame:
    """Rows of `frame_texts` rearranged: `form`, `n`, `prefix_chars`, `middle_chars`, and the output.

    The two cuts of a text depend on `seed` and its id alone, and are code points. `form` is
    `psm` (`<P>` prefix `<S>` suffix `<M>` middle), `spm` (`<S>` suffix `<P>` prefix `<M>`
    middle) or `plain`: texts that are empty or hold a mark, and one in ten of the others, stay
    as they are. The output takes the place of the text in `frames` and `upto`; `restore` gives
    the text back from it. `prefix_chars` and `middle_chars` are null if plain.

    A null id counts as an empty one. Rows that repeat an id are cut by the same draw, each by
    its own length. Other columns go along, those named like a new one are replaced. An empty
    table gives no rows.
    """
    made = {"frames", "upto", "marked"}
    kept = [c for c in (framed.columns if keep is None else keep) if c not in made]
    drawn_by = "_id"
    while drawn_by in kept:
        drawn_by += "_"

    def compute(batch: pa.RecordBatch) -> dict:
        out = {f.name: [] for f in FILLED}
        ids, marked = _column(batch, drawn_by).to_pylist(), _column(batch, "marked").to_pylist()
        for key, held, text in zip(ids, marked, _texts(batch)):
            how = cut(key, text.n, held, seed)
            plain = how.form == "plain"
            output = text if plain else Frames.of(rearranged(text, how), size)
            out["n"].append(text.n)
            out["form"].append(how.form)
            out["prefix_chars"].append(None if plain else how.first)
            out["middle_chars"].append(None if plain else how.second - how.first)
            out["frames"].append(output.frames)
            out["upto"].append(output.upto)
        return out

    rows = framed.select(*kept, *sorted(made), F.col(doc_id).cast("long").alias(drawn_by))
    return append_columns(rows, FILLED, compute, kept)


def digests(filled: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """Rows of `fill_middle` with `output_sha256` and `restored_sha256` in place of the output.

    The frames are streamed in order, one at a time. The second digest is of the text as it is
    rebuilt from output and form, so it tells whether the way back is exact.
    """
    made = {"frames", "upto"}
    kept = [c for c in (filled.columns if keep is None else keep) if c not in made]

    def compute(batch: pa.RecordBatch) -> dict:
        out = {f.name: [] for f in DIGESTS}
        for form, output in zip(_column(batch, "form").to_pylist(), _texts(batch)):
            out["output_sha256"].append(sha256(output.part(0, output.n)))
            out["restored_sha256"].append(sha256(restored(output, form)))
        return out

    return append_columns(filled, DIGESTS, compute, kept)


def restore(filled: DataFrame, text: str = "text", size: int = FRAME_BYTES) -> DataFrame:
    """Rows of `fill_middle` with the texts they came from, as the column `text`."""
    return _as_text(filled, text, lambda output, form: restored(output, form))


def output_texts(filled: DataFrame, text: str = "text") -> DataFrame:
    """Rows of `fill_middle` with the output as the column `text`."""
    return _as_text(filled, text, lambda output, form: output.part(0, output.n))


def _as_text(filled: DataFrame, text: str, parts) -> DataFrame:
    kept = [c for c in filled.columns if c not in ("frames", "upto")]

    def compute(batch: pa.RecordBatch) -> dict:
        forms = _column(batch, "form").to_pylist()
        return {
            text: [b"".join(parts(o, f)).decode() for f, o in zip(forms, _texts(batch))]
        }

    return append_columns(filled, _fields((text, T.StringType())), compute, kept)
