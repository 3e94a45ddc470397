import random
from collections import defaultdict
from decimal import Decimal

from brute import GRAND, cascade, statement

from marginflow import catalog
from marginflow.operators.cascade import margin_cascade
from marginflow.operators.statement import (
    level_table,
    margin_statement,
    present_levels,
    row_head_order,
    row_heads,
    statement_order,
    statement_wide,
)

NAMES = [
    "UmsatzEUR",
    " UmsatzEUR",
    "umsatz eur",
    "Umsatz_EUR",
    "TransferPriceEUR",
    "SalesAmount",
    "Commission",
    "Commission in EUR",
    "DiscountAufMaterialEUR",
    "DiscountAufMaterialKategorieEUR",
    "Monthly Rent",
    "Marketing Campaign",
    "Something else",
    None,
]


def random_rows(seed, n=400):
    """Rows of several stores and months, some stores without E2, some without known names."""
    pick = random.Random(seed)
    rows = []
    for _ in range(n):
        store = pick.choice("ABCDEF")
        names = ["Other", "Else"] if store == "E" else NAMES
        levels = {"B": ["E1", "E3"], "C": ["E1", None, "E4"], "F": [None, "X"]}.get(
            store, ["E1", "E2", "E3", "E4", None]
        )
        rows.append(
            (
                store,
                f"20{pick.choice(['23', '24'])}-{pick.randint(1, 12):02d}-01",
                pick.choice(levels),
                pick.choice(["1", "2", "10", "x", None]),
                pick.choice(names),
                pick.choice(["K1", "K2", None]),
                pick.choice(["L1", "L2", None]),
                pick.choice(["n/a", "", None, f"{pick.uniform(-500, 900):.4f}"]),
            )
        )
    return rows


def by_scope(rows):
    groups = defaultdict(list)
    for r in rows:
        if r[0] is not None and r[1] is not None:
            groups[r[0], int(r[1][:4])].append(r)
    return groups


def collected(df):
    """scope -> [(label, {cell: value})] in order of row_rank."""
    found = defaultdict(lambda: defaultdict(dict))
    for r in df.collect():
        cell = (r.product_line, r.product_category)
        row = found[r.store, r.year][r.row_rank, r.row_label]
        assert cell not in row
        row[cell] = r.value
    return {
        scope: [(label, cells) for (_, label), cells in sorted(rows.items())]
        for scope, rows in found.items()
    }


def test_statement_equals_loops(table):
    for seed, profile in ((1, "current"), (2, "handbook"), (3, "legacy")):
        rows = random_rows(seed)
        got = collected(margin_statement(table(rows), profile=profile))
        want = {s: statement(group, profile) for s, group in by_scope(rows).items()}
        assert got == {s: w for s, w in want.items() if w}


def test_cascade_equals_loops(table):
    for seed, profile in ((4, "current"), (5, "handbook"), (6, "legacy")):
        rows = random_rows(seed)
        got = defaultdict(dict)
        for r in margin_cascade(table(rows), profile=profile).collect():
            cell = (r.product_line, r.product_category)
            got[r.store, r.year][cell] = (r.e1_total, r.e2_total, r.e3_total)
        want = {s: cascade(group, profile) for s, group in by_scope(rows).items()}
        assert dict(got) == {s: w for s, w in want.items() if w}


def test_ranks_are_gapless_and_order_matches_statement(table):
    df = table(random_rows(7))
    heads = {(r.store, r.year, r.row_rank, r.row_label) for r in statement_order(df).collect()}
    rows = {(r.store, r.year, r.row_rank, r.row_label) for r in margin_statement(df).collect()}
    assert heads == rows
    ranks = defaultdict(list)
    for store, year, rank, _ in heads:
        ranks[store, year].append(rank)
    assert all(sorted(r) == list(range(1, len(r) + 1)) for r in ranks.values())


def test_added_e2_total(table):
    df = table(
        [
            ("A", "2024-01-01", "E1", "1", "UmsatzEUR", "K", "L", "100"),
            ("A", "2024-01-01", "E3", "3", "Monthly Rent", None, None, "30"),
            ("B", "2024-01-01", "E1", "1", "UmsatzEUR", "K", "L", "100"),
            ("B", "2024-01-01", "E2", "1", "DiscountAufMaterialEUR", "K", "L", "10"),
            ("C", "2024-01-01", "E1", "1", "unknown", "K", "L", "100"),
        ]
    )
    got = collected(margin_statement(df))
    a = dict(got["A", 2024])
    assert a["E2 | E2 Total"] == {
        ("L", "K"): 100,
        (catalog.GENERAL, catalog.GENERAL): 0,
        GRAND: 100,
    }
    assert a["E3 | E3 Total"][GRAND] == 70
    assert a["E3 | E3 Total"][catalog.GENERAL, catalog.GENERAL] == -30
    assert [label for label, _ in got["B", 2024]] == [
        "E1 | UmsatzEUR",
        "E1 | E1 Total",
        "E2 | DiscountAufMaterialEUR",
        "E2 | E2 Total",
    ]
    # no known measure: raw total, no added row
    assert got["C", 2024] == [
        ("E1 | unknown", {("L", "K"): 100, GRAND: 100}),
        ("E1 | E1 Total", {("L", "K"): 100, GRAND: 100}),
    ]


def test_level_of_only_hidden_measures_has_no_rows(table):
    df = table(
        [
            ("A", "2024-01-01", "E1", "1", "UmsatzEUR", "K", "L", "100"),
            ("A", "2024-01-01", "E2", "1", "SalesAmount", "K", "L", "5"),
        ]
    )
    labels = [label for label, _ in collected(margin_statement(df))["A", 2024]]
    assert labels == ["E1 | UmsatzEUR", "E1 | E1 Total"]


def test_measure_at_two_positions_is_one_row(table):
    df = table(
        [
            ("A", "2024-01-01", "E1", "10", "UmsatzEUR", "K", "L", "1"),
            ("A", "2024-01-01", "E1", "2", " UMSATZEUR", "K", "L", "2"),
            ("A", "2024-01-01", "E1", "x", "Zusatz", "K", "L", "4"),
            ("A", "2024-01-01", "E1", "3", "Andere", "K", "L", "8"),
        ]
    )
    heads = sorted(row_heads(df).collect(), key=lambda r: r.name)
    assert [(h.name, h.label, h.pos_num) for h in heads] == [
        ("andere", "Andere", 3.0),
        ("umsatzeur", "UMSATZEUR", 2.0),
        ("zusatz", "Zusatz", None),
    ]
    order = sorted(row_head_order(df).collect(), key=lambda r: r.row_rank)
    assert [r.name for r in order] == ["umsatzeur", "andere", "zusatz"]
    rows = {
        (r.row_rank, r.row_label, r.is_total): r.value
        for r in level_table(df).collect()
        if r.product_line == "L"
    }
    assert rows == {
        (1, "UMSATZEUR", False): Decimal(3),
        (2, "Andere", False): Decimal(8),
        (3, "Zusatz", False): Decimal(4),
        (4, "E1 Total", True): Decimal(15),
    }


def test_wide_form_fills_zeros_and_ends_with_the_sum(table):
    df = table(
        [
            ("A", "2024-01-01", "E1", "1", "UmsatzEUR", "K", "Z", "100"),
            ("A", "2024-01-01", "E3", "3", "Monthly Rent", None, None, "30"),
        ]
    )
    statement = margin_statement(df)
    wide = statement_wide(statement)
    cells = ["Allgemein | Allgemein", "Z | K", "Summen | Gesamt"]
    assert wide.columns[5:] == cells
    rows = {r.row_label: [r[c] for c in cells] for r in wide.collect()}
    assert rows == {
        "E1 | UmsatzEUR": [0, 100, 100],
        "E1 | E1 Total": [0, 100, 100],
        "E2 | E2 Total": [0, 100, 100],
        "E3 | Monthly Rent": [30, 0, 30],
        "E3 | E3 Total": [-30, 100, 70],
    }
    narrow = statement_wide(statement, columns=["Z | K"])
    assert narrow.columns[5:] == ["Z | K", "other cells", "Summen | Gesamt"]
    assert all(r[5] + r[6] == r[7] for r in narrow.collect())


def test_sum_column_is_sum_of_cells(measures):
    rows = defaultdict(Decimal)
    grand = {}
    for r in margin_statement(measures).collect():
        key = (r.store, r.year, r.row_rank)
        if r.product_line == catalog.SUM_LINE:
            grand[key] = r.value
        else:
            rows[key] += r.value
    assert grand == dict(rows)


def test_present_levels(table):
    df = table(
        [
            ("A", "2024-01-01", "E3", "1", "x", "K", "Z", "1"),
            ("A", "2024-01-01", "E1", "1", "x", "K", "Z", "1"),
            ("B", "2024-01-01", "E9", "1", "x", "K", "Z", "1"),
        ]
    )
    got = {r.store: r.levels for r in present_levels(df).collect()}
    assert got == {"A": "E1, E3", "B": ""}
