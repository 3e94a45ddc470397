"""Fixed values of the margin statement: names, families, labels, row slots.

Everything here is a constant of the business rules, a few dozen short strings in all.
"""

from __future__ import annotations

# --- fixed values: levels ---------------------------------------------------------
LEVELS = ("E1", "E2", "E3")
LEVEL_CODES = {"DB1": "E1", "DB2": "E2", "DB3": "E3"}
TOTAL_SUFFIX = "Total"

# --- fixed values: column axes ----------------------------------------------------
GENERAL = "Allgemein"
SUM_LINE = "Summen"
SUM_CATEGORY = "Gesamt"

# --- fixed values: measure names of the cascade (fully normalized) ------------------
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

# --- fixed values: revenue names accepted by the revenue figure ---------------------
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

# --- fixed values: measure names of the campaign totals (trimmed, lower case) -------
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

# --- fixed values: what each margin rule deducts at E2 and at E3 --------------------
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

# --- fixed values: measures that are not money and stay out of the statement --------
EXCLUDED = ("salesprice", "salespriceeur", "salesamount")
EXCLUDED_OLD = ("salespriceeur", "salesamount", "salesprice", "sales amount", "sales price")

# --- fixed values: measures every period should have --------------------------------
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

# Under the legacy rule: whole families, by the name they are reported under.
EXPECTED_OLD = {
    "E1": {"UmsatzEUR": "revenue", "TransferPriceEUR": "transfer"},
    "E2": {"Commission/Commission in EUR": "commission"},
}

# --- fixed values: legend texts ------------------------------------------------------
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

# --- fixed values: place of a row inside its level, first match counts ---------------
# (text the label contains, text it must not contain, slot)
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
OTHER_SLOT = 50
TOTAL_SLOT = 99

# --- fixed values: profit status -----------------------------------------------------
PROFITABLE = "Profitabel"
NOT_PROFITABLE = "Nicht profitabel"

# --- fixed values: access levels and the periods they may look at --------------------
USER_LEVELS = (1, 2, 3)
ALL_STORES = "*"
LEVEL_GRAINS = {1: ("year",), 2: ("year", "quarter"), 3: ("year", "quarter", "month")}

# --- fixed values: source column names and their names here --------------------------
SOURCE_COLUMNS = {
    "StoreName": "store",
    "Monat": "month",
    "Ebene": "level",
    "DBEbene": "db_level",
    "EPos": "pos",
    "Position": "position",
    "Kenngröße": "measure",
    "ProduktKategorie": "product_category",
    "ProduktLinie": "product_line",
    "Wert": "value",
    "Kampagne": "campaign",
    "Kostenart": "cost_kind",
    "Beschreibung": "description",
    "ProduktNr": "product_nr",
    "E1_Total": "e1_total",
    "E2_Total": "e2_total",
    "E3_Total": "e3_total",
    "Gesamt_Total": "overall_total",
}
