"""The statement of one scope by plain loops over its rows, for small tables."""

from __future__ import annotations

from collections import defaultdict
from decimal import Decimal, InvalidOperation

from marginflow import catalog

GRAND = (catalog.SUM_LINE, catalog.SUM_CATEGORY)


def amount(value):
    try:
        return Decimal(value.strip()) if value is not None else Decimal(0)
    except InvalidOperation:
        return Decimal(0)


def norm(name):
    text = "" if name is None else name.replace("€", " eur ")
    for separator in "._-/":
        text = text.replace(separator, " ")
    return " ".join(text.lower().split())


def plain(name):
    return str(name).strip().lower()


def cell_of(row):
    category, line = row[5], row[6]
    return (line or catalog.GENERAL, category or catalog.GENERAL)


def cascade(rows, profile="current"):
    """cell -> (E1, E2, E3), the sum over all cells included; empty without known measures."""
    rule = catalog.PROFILES[profile]
    names = {f: set(n) for f, n in catalog.FAMILIES.items()}
    sums = defaultdict(lambda: [Decimal(0)] * 3)
    for row in rows:
        name, value = norm(row[4]), amount(row[7])
        family = next((f for f, n in names.items() if name in n), None)
        if family in ("revenue", "transfer"):
            steps = (value, value, value)
        elif family in rule["e2"]:
            steps = (Decimal(0), -value, -value)
        elif family in rule["e3"]:
            steps = (Decimal(0), Decimal(0), -value)
        else:
            continue
        for cell in (cell_of(row), GRAND):
            sums[cell] = [a + b for a, b in zip(sums[cell], steps)]
    return {cell: tuple(v) for cell, v in sums.items()}


def slot(label):
    for text, without, place in catalog.ROW_SLOTS:
        if text in label and (without is None or without not in label):
            return place
    return catalog.OTHER_SLOT


def statement(rows, profile="current"):
    """[(row label, {cell: value})] in order; measure rows list their own cells only."""
    totals = cascade(rows, profile)
    present = [level for level in catalog.LEVELS if any(r[2] == level for r in rows)]
    if not present:
        return []
    legacy = profile == "legacy"
    excluded = catalog.EXCLUDED_OLD if legacy else catalog.EXCLUDED
    shown = [r for r in rows if r[2] in present and plain(r[4]) not in excluded]
    columns = {cell_of(r) for r in shown}
    added = "E2" not in present and bool(totals) and not legacy
    if added:
        columns |= set(totals) - {GRAND}
    out = []
    for level in present:
        mine = [r for r in shown if r[2] == level]
        if not mine:
            continue
        for name in {plain(r[4]) for r in mine}:
            same = [r for r in mine if plain(r[4]) == name]
            label = f"{level} | {min(str(r[4]).strip() for r in same)}"
            cells = defaultdict(Decimal)
            for r in same:
                cells[cell_of(r)] += amount(r[7])
                cells[GRAND] += amount(r[7])
            key = (catalog.LEVELS.index(level), slot(label), label, name)
            if legacy:  # by position inside the level, unreadable ones last
                place = min((number(r[3]) for r in same), default=None)
                key = (catalog.LEVELS.index(level), 0, place, label, name)
            out.append((key, label, cells))
        if not totals:
            cells = defaultdict(Decimal)
            for r in mine:
                cells[cell_of(r)] += amount(r[7])
                cells[GRAND] += amount(r[7])
            out.append(_total(level, cells))
    if totals:
        levels = [lv for lv in catalog.LEVELS if any(r[2] == lv for r in shown)]
        for level in levels + (["E2"] if added else []):
            step = catalog.LEVELS.index(level)
            zero = (Decimal(0),) * 3
            cells = {c: totals.get(c, zero)[step] for c in columns | {GRAND}}
            out.append(_total(level, cells))
    return [(label, dict(cells)) for _, label, cells in sorted(out, key=lambda e: e[0])]


def number(pos):
    """Position as a number, for sorting; what is no number comes last."""
    try:
        return (0, float(pos))
    except (TypeError, ValueError):
        return (1, 0.0)


def _total(level, cells):
    label = f"{level} | {level} Total"
    return (catalog.LEVELS.index(level), catalog.TOTAL_SLOT, label, ""), label, cells
