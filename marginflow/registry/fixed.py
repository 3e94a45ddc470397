"""Fixed values of the checking SQL, set down apart from the package's own.

A wrong name in the catalog would otherwise be wrong on both sides and pass. Lists stand in the
order of the rules they come from.
"""

from __future__ import annotations

# --- fixed values of the rules, as the checks expect them ---------------------------
GENERAL = "Allgemein"
SUM_LINE = "Summen"
SUM_CATEGORY = "Gesamt"
PROFITABLE = "Profitabel"
NOT_PROFITABLE = "Nicht profitabel"
ALL_STORES = "*"
TOTAL_SLOT = 99
OTHER_SLOT = 50

REVENUE = ("umsatzeur", "umsatz eur")
TRANSFER = ("transferpriceeur", "transfer price eur")
COMMISSION = ("commission in eur", "commission")
MATERIAL_DISCOUNT = ("discountaufmaterialeur",)
CATEGORY_DISCOUNT = ("discountaufmaterialkategorieeur",)
FIXED_COSTS = (
    "additional procurement costs",
    "marketing campaign",
    "monthly rent",
    "monthly salary",
    "monthly social costs",
)
FAMILIES = {
    "revenue": REVENUE,
    "transfer": TRANSFER,
    "commission": COMMISSION,
    "material_discount": MATERIAL_DISCOUNT,
    "category_discount": CATEGORY_DISCOUNT,
    "fixed_costs": FIXED_COSTS,
}
PROFILES = {
    "current": {
        "e2": ("material_discount", "category_discount"),
        "e3": ("commission", "fixed_costs"),
    },
    "handbook": {
        "e2": ("commission", "material_discount", "category_discount"),
        "e3": ("fixed_costs",),
    },
    "legacy": {"e2": ("commission",), "e3": ("fixed_costs",)},
}
KPI_REVENUE = (
    "umsatzeur",
    "umsatz eur",
    "umsatz",
    "revenue",
    "sales",
    "sales eur",
    "saleseur",
    "totalrevenue",
)
KPI_REVENUE_OLD = ("umsatzeur", "umsatz", "revenue", "sales", "saleseur", "totalrevenue")
CAMPAIGN_FAMILIES = {
    "revenue": KPI_REVENUE,
    "transfer": TRANSFER,
    "db2_cost": (
        "commission in eur",
        "commission",
        "discountaufmaterialeur",
        "discount auf material eur",
        "discountaufmaterialkategorieeur",
        "discount auf material kategorie eur",
    ),
    "db3_cost": FIXED_COSTS,
}
EXCLUDED = ("salesprice", "salespriceeur", "salesamount")
EXCLUDED_OLD = ("salespriceeur", "salesamount", "salesprice", "sales amount", "sales price")
EXPECTED = {
    "E1": ("UmsatzEUR", "TransferPriceEUR"),
    "E2": ("DiscountAufMaterialEUR", "DiscountAufMaterialKategorieEUR"),
    "E3": (
        "Commission",
        "Additional Procurement Costs",
        "Marketing Campaign",
        "Monthly Rent",
        "Monthly Salary",
        "Monthly Social Costs",
    ),
}
EXPECTED_OLD = (
    ("E1", 0, "UmsatzEUR", REVENUE),
    ("E1", 1, "TransferPriceEUR", TRANSFER),
    ("E2", 0, "Commission/Commission in EUR", COMMISSION),
)
DESCRIPTIONS = {
    "UmsatzEUR": "Umsatz in EUR.",
    "TransferPriceEUR": "Transferpreis / Einkaufspreis in EUR.",
    "Commission in EUR": "Provision / Commission in EUR.",
    "DiscountAufMaterialEUR": "Rabatt auf Material in EUR.",
    "DiscountAufMaterialKategorieEUR": "Rabatt auf Materialkategorie in EUR.",
    "Additional Procurement Costs": "Zusätzliche Beschaffungskosten.",
    "Marketing Campaign": "Marketing-Kampagne (Kosten).",
    "Monthly Rent": "Monatsmiete.",
    "Monthly Salary": "Monatsgehälter.",
    "Monthly Social Costs": "Monatliche Sozialkosten.",
}
NO_DESCRIPTION = "Kenngröße aus der Datenquelle (Beschreibung nicht hinterlegt)."
# (text the label contains, text it must not contain, place in the level)
ROW_SLOTS = (
    ("UmsatzEUR", None, 1),
    ("TransferPriceEUR", None, 2),
    ("Commission", None, 1),
    ("DiscountAufMaterial", "Kategorie", 2),
    ("DiscountAufMaterialKategorie", None, 3),
    ("Additional Procurement", None, 1),
    ("Marketing Campaign", None, 2),
    ("Monthly Rent", None, 3),
    ("Monthly Salary", None, 4),
    ("Monthly Social", None, 5),
)

# --- fixed values of the queries -----------------------------------------------------
STORE = "NATION_12"
CELL_COLUMNS = tuple(
    f"{line} | {category}"
    for line in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
    for category in ("Allgemein", *(f"Brand#{n}" for n in range(1, 26)))
)
STATEMENT_COLUMNS = (*CELL_COLUMNS, "Allgemein | Allgemein")
