"""Names, labels and row places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginflow import catalog

# Unicode white space plus the four ASCII separators that Java's \s leaves out.
_SPACE = r"\s\x{1c}-\x{1f}"
# The same set, character by character, for trimming.
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_SEPARATORS = rf"(?U)[._\-/{_SPACE}]+"


def strip_space(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(text, F.lit(_BLANKS))


def normalize_measure(measure: Column) -> Column:
    """Measure name for matching: spelling variants of one name become equal; NULL is ''."""
    text = F.coalesce(measure.cast("string"), F.lit(""))
    text = F.lower(F.replace(text, F.lit("€"), F.lit(" eur ")))
    return F.trim(F.regexp_replace(text, _SEPARATORS, " "))


def simple_norm(measure: Column) -> Column:
    """Trimmed lower-case name; separators stay."""
    return F.lower(strip_space(measure.cast("string")))


def plain_norm(measure: Column) -> Column:
    """As `simple_norm` but only blanks are trimmed, as the SQL side does."""
    return F.lower(F.trim(measure.cast("string")))


def family_of(name: Column, families: dict[str, tuple[str, ...]]) -> Column:
    """Family a normalized name belongs to, NULL if none; families must not overlap."""
    column = None
    for family, names in families.items():
        test = name.isin(*names)
        column = F.when(test, family) if column is None else column.when(test, family)
    return column


def quoted(text: str) -> str:
    """Text as a SQL literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def fill_axis(axis: Column) -> Column:
    """Rows without a product line or category count as general."""
    return F.coalesce(axis, F.lit(catalog.GENERAL))


def level_code(db_level: Column) -> Column:
    """DB1..DB3 as E1..E3; other codes stay, trimmed."""
    code = strip_space(db_level.cast("string"))
    mapped = None
    for source, target in catalog.LEVEL_CODES.items():
        test = code == source
        mapped = F.when(test, target) if mapped is None else mapped.when(test, target)
    return mapped.otherwise(code)


def row_label(level: Column, name: Column) -> Column:
    """Row head of the statement."""
    return F.concat(level, F.lit(" | "), name)


def level_number(level: Column) -> Column:
    """1, 2, 3 for the three levels, 9 for any other."""
    column = None
    for number, name in enumerate(catalog.LEVELS, start=1):
        test = level.startswith(name)
        column = F.when(test, number) if column is None else column.when(test, number)
    return column.otherwise(9)


def row_slot(label: Column, is_total: Column) -> Column:
    """Place of a row inside its level: known rows first, others next, the total last."""
    column = F.when(is_total, catalog.TOTAL_SLOT)
    for text, without, slot in catalog.ROW_SLOTS:
        test = label.contains(text)
        if without is not None:
            test = test & ~label.contains(without)
        column = column.when(test, slot)
    return column.otherwise(catalog.OTHER_SLOT)
