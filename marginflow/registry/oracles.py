"""The same results in plain SQL, for checking in another engine.

Each text starts from the sales tables and goes its own way: names are normalized row by
row, totals joined rather than grouped along, so that it does not repeat the operators.
"""

from __future__ import annotations

from marginflow.registry import fixed
from marginflow.registry.fixed import CELL_COLUMNS, STATEMENT_COLUMNS, STORE

_MEASURES = """
line AS (
  SELECT n.n_name AS store, CAST(date_trunc('month', l.l_shipdate) AS DATE) AS month,
         p.p_type AS product_line,
         CASE WHEN p.p_size % 10 = 0 THEN NULL ELSE p.p_brand END AS product_category,
         l.l_returnflag AS rf,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS ext, CAST(l.l_quantity AS DECIMAL(9,2)) AS qty,
         CAST(p.p_retailprice AS DECIMAL(12,2)) AS retail,
         CAST(l.l_discount AS DECIMAL(4,2)) AS disc, CAST(l.l_tax AS DECIMAL(4,2)) AS tax
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
                  JOIN nation n ON s.s_nationkey = n.n_nationkey
                  JOIN part p ON l.l_partkey = p.p_partkey
), sm AS (SELECT DISTINCT store, month FROM line),
fixed AS (
  SELECT n.n_name AS store, SUM(10 * CAST(abs(s.s_acctbal) AS DECIMAL(12,2))) AS base
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name
), measures AS (
  SELECT store, month, 'E1' AS level, '1' AS pos,
         CASE rf WHEN 'A' THEN 'Umsatz EUR' WHEN 'R' THEN ' UmsatzEUR' ELSE 'UmsatzEUR' END
           AS measure, product_category, product_line,
         CAST(CAST(ext AS DECIMAL(18,4)) AS VARCHAR) AS value FROM line
  UNION ALL SELECT store, month, 'E1', '2', 'TransferPriceEUR', product_category, product_line,
         CAST(CAST(-(qty * retail) AS DECIMAL(18,4)) AS VARCHAR) FROM line
  UNION ALL SELECT store, month, 'E1', '9', 'SalesAmount', product_category, product_line,
         CAST(CAST(qty AS DECIMAL(18,4)) AS VARCHAR) FROM line
  UNION ALL SELECT store, month, 'E2', '1', 'DiscountAufMaterialEUR', product_category,
         product_line, CAST(CAST(ext * disc AS DECIMAL(18,4)) AS VARCHAR) FROM line WHERE rf <> 'R'
  UNION ALL SELECT store, month, 'E2', '2', 'DiscountAufMaterialKategorieEUR', product_category,
         product_line, CAST(CAST(ext * disc AS DECIMAL(18,4)) AS VARCHAR) FROM line WHERE rf = 'R'
  UNION ALL SELECT store, month, 'E3', '10',
         CASE rf WHEN 'A' THEN 'Commission' ELSE 'Commission in EUR' END, product_category,
         product_line, CAST(CAST(ext * tax AS DECIMAL(18,4)) AS VARCHAR) FROM line
  UNION ALL SELECT sm.store, sm.month, 'E3', '3', 'Monthly Rent', NULL, NULL,
         CAST(CAST(base AS DECIMAL(18,4)) AS VARCHAR) FROM sm JOIN fixed ON sm.store = fixed.store
  UNION ALL SELECT sm.store, sm.month, 'E3', '4', 'Monthly Salary', NULL, NULL,
         CAST(CAST(base * 2 AS DECIMAL(18,4)) AS VARCHAR)
         FROM sm JOIN fixed ON sm.store = fixed.store
  UNION ALL SELECT sm.store, sm.month, 'E3', '5', 'Monthly Social Costs', NULL, NULL,
         CASE WHEN extract(month FROM sm.month) = 1 THEN 'n/a'
              ELSE CAST(CAST(base * 0.4 AS DECIMAL(18,4)) AS VARCHAR) END
         FROM sm JOIN fixed ON sm.store = fixed.store
)"""

_CAMPAIGN = """
measures_db AS (
  SELECT store, measure, value, concat(' DB', substr(level, 2, 1), ' ') AS db_level,
         pos AS position, CAST(NULL AS VARCHAR) AS description,
         CASE WHEN level = 'E3' AND pos <> '10' THEN 'fix' ELSE 'variabel' END AS cost_kind,
         CAST(NULL AS VARCHAR) AS product_nr, product_category, product_line,
         CASE WHEN extract(month FROM month) >= 10 THEN 'Q4' ELSE NULL END AS campaign
  FROM measures
  UNION ALL
  SELECT DISTINCT store, 'UmsatzEUR', '1.0000', 'DB9', NULL, NULL, NULL, NULL, NULL, NULL, NULL
  FROM measures
)"""

_YEAR = "CAST(year(month) AS INTEGER)"
_QUARTER = "concat('Q', CAST(quarter(month) AS VARCHAR))"
_AMOUNT = "try_cast(value AS DECIMAL(18,4))"
_NORM = (
    r"trim(regexp_replace(regexp_replace(lower(replace(replace(coalesce(measure, ''), "
    r"chr(160), ' '), '€', ' eur ')), '[._\-/]+', ' ', 'g'), '\s+', ' ', 'g'))"
)
_PLAIN = "lower(trim(measure))"
_SUM_LABELS = (
    f"'{fixed.SUM_LINE}' AS product_line, '{fixed.SUM_CATEGORY}' AS product_category"
)


def _m(where: str = "TRUE") -> str:
    """Rows with filled axes, amounts and both normalized names."""
    return f"""
m AS (
  SELECT store, month, {_YEAR} AS year, {_QUARTER} AS quarter, level, pos, measure,
         coalesce(product_line, '{fixed.GENERAL}') AS product_line,
         coalesce(product_category, '{fixed.GENERAL}') AS product_category,
         coalesce({_AMOUNT}, 0) AS v, {_NORM} AS norm, {_PLAIN} AS plain
  FROM measures WHERE {where}
)"""


def _in(column: str, names: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(repr(n) for n in names)})"


def _with(*ctes: str) -> str:
    return "WITH " + ",".join((_MEASURES, *ctes)) + "\n"


def _money(amount: str, name: str) -> str:
    return f"CAST({amount} AS DECIMAL(28,4)) AS {name}"


def _summed(names: tuple[str, ...], column: str = "norm") -> str:
    return f"coalesce(sum(v) FILTER (WHERE {_in(column, names)}), 0)"


def _known(profile: str = "current") -> str:
    """Whether a row of m enters the cascade under a rule."""
    families = ("revenue", "transfer", *(f for fs in fixed.PROFILES[profile].values() for f in fs))
    return _in("norm", tuple(n for family in families for n in fixed.FAMILIES[family]))


_KNOWN = _known()


def _margins(profile: str) -> tuple[str, str, str]:
    """The three margins as SQL over rows of m."""
    family = {name: _summed(names) for name, names in fixed.FAMILIES.items()}
    rule = fixed.PROFILES[profile]
    e1 = f"{family['revenue']} + {family['transfer']}"
    e2 = f"{e1} - " + " - ".join(family[f] for f in rule["e2"])
    e3 = f"{e2} - " + " - ".join(family[f] for f in rule["e3"])
    return e1, e2, e3


def _margin_list(profile: str) -> str:
    return ", ".join(
        _money(e, f"e{i}_total") for i, e in enumerate(_margins(profile), start=1)
    )


def _cascade(scope: str, profile: str) -> str:
    """Margins per cell and over all cells, two separate groupings of the known rows."""
    margins = _margin_list(profile)
    return f"""
  SELECT {scope}, product_line, product_category, {margins} FROM m WHERE {_known(profile)}
  GROUP BY {scope}, product_line, product_category
  UNION ALL
  SELECT {scope}, {_SUM_LABELS}, {margins} FROM m WHERE {_known(profile)} GROUP BY {scope}"""


def _cells(names: tuple[str, ...], scope: str, grand: bool) -> str:
    value = _money("sum(v)", "value")
    body = f"""SELECT {scope}, product_line, product_category, {value}
  FROM m WHERE {_in('norm', names)} GROUP BY {scope}, product_line, product_category"""
    if not grand:
        return body
    return f"""{body}
  UNION ALL SELECT {scope}, {_SUM_LABELS}, {value}
  FROM m WHERE {_in('norm', names)} GROUP BY {scope}"""


def _wide(source: str, keys: str, columns: tuple[str, ...]) -> str:
    grand = f"{fixed.SUM_LINE} | {fixed.SUM_CATEGORY}"
    cells = []
    for column in (*columns, grand):
        line, category = column.split(" | ")
        test = f"product_line = '{line}' AND product_category = '{category}'"
        cells.append(
            f"CAST(coalesce(sum(value) FILTER (WHERE {test}), 0) AS DECIMAL(28,4)) AS \"{column}\""
        )
    listed = ", ".join(f"'{column}'" for column in (*columns, grand))
    rest = f"concat(product_line, ' | ', product_category) NOT IN ({listed})"
    cells.append(
        f"CAST(coalesce(sum(value) FILTER (WHERE {rest}), 0) AS DECIMAL(28,4)) AS \"other cells\""
    )
    return f"SELECT {keys}, {', '.join(cells)} FROM {source} GROUP BY {keys}"


_LISTED = f"level IN ('E1', 'E2', 'E3') AND NOT ({_in('plain', fixed.EXCLUDED)})"


def _slot() -> str:
    tests = []
    for text, without, slot in fixed.ROW_SLOTS:
        unless = f" AND NOT contains(row_label, '{without}')" if without else ""
        tests.append(f"WHEN contains(row_label, '{text}'){unless} THEN {slot}")
    return (
        f"CASE WHEN is_total THEN {fixed.TOTAL_SLOT} {' '.join(tests)} "
        f"ELSE {fixed.OTHER_SLOT} END"
    )


def _statement(scope: str, profile: str) -> str:
    """CTEs up to `statement`: (scope, level, row_label, row_rank, is_total, axes, value)."""
    legacy = profile == "legacy"
    known = _known(profile)
    excluded = fixed.EXCLUDED_OLD if legacy else fixed.EXCLUDED
    listed = f"level IN ('E1', 'E2', 'E3') AND NOT ({_in('plain', excluded)})"
    lone = "FALSE" if legacy else f"bool_or({known}) AND NOT bool_or(level = 'E2')"
    order = "level_number, slot, row_label, plain"
    if legacy:
        order = "level_number, is_total, pos_num NULLS LAST, label, plain"
    keys = [k.strip() for k in scope.split(",")]

    def on(left: str, right: str, *more: str) -> str:
        return " AND ".join(f"{left}.{k} = {right}.{k}" for k in (*keys, *more))

    def of(alias: str) -> str:
        return ", ".join(f"{alias}.{k}" for k in keys)

    return f"""
cascade AS ({_cascade(scope, profile)}),
scopes AS (
  SELECT {scope}, bool_or({known}) AS has_cascade, {lone} AS lone_e2
  FROM m GROUP BY {scope} HAVING bool_or(level IN ('E1', 'E2', 'E3'))
),
listed AS (SELECT * FROM m WHERE {listed}),
lv AS (
  SELECT DISTINCT {scope}, level FROM listed
  UNION SELECT {scope}, 'E2' FROM scopes WHERE lone_e2
),
cols AS (
  SELECT DISTINCT {scope}, product_line, product_category FROM listed
  UNION SELECT {of('c')}, c.product_line, c.product_category
  FROM cascade c JOIN scopes s ON {on('c', 's')}
  WHERE s.lone_e2 AND c.product_line <> '{fixed.SUM_LINE}'
  UNION SELECT {scope}, {_SUM_LABELS} FROM scopes
),
raw_total AS (
  SELECT {scope}, level, product_line, product_category, sum(v) AS v
  FROM listed GROUP BY {scope}, level, product_line, product_category
  UNION ALL
  SELECT {scope}, level, {_SUM_LABELS}, sum(v) FROM listed GROUP BY {scope}, level
),
total_cells AS (
  SELECT {of('lv')}, lv.level, cols.product_line, cols.product_category,
         CASE WHEN NOT s.has_cascade THEN r.v
              ELSE coalesce(CASE lv.level WHEN 'E1' THEN c.e1_total WHEN 'E2' THEN c.e2_total
                                 ELSE c.e3_total END, 0) END AS value
  FROM lv JOIN scopes s ON {on('lv', 's')}
  JOIN cols ON {on('lv', 'cols')}
  LEFT JOIN cascade c ON {on('cols', 'c', 'product_line', 'product_category')}
  LEFT JOIN raw_total r ON {on('cols', 'r', 'product_line', 'product_category')}
       AND r.level = lv.level
),
names AS (
  SELECT {scope}, level, plain, min(trim(measure)) AS label,
         min(try_cast(pos AS DOUBLE)) AS pos_num
  FROM listed GROUP BY {scope}, level, plain
),
measure_cells AS (
  SELECT {scope}, level, plain, product_line, product_category, sum(v) AS value
  FROM listed GROUP BY {scope}, level, plain, product_line, product_category
  UNION ALL
  SELECT {scope}, level, plain, {_SUM_LABELS}, sum(v) FROM listed GROUP BY {scope}, level, plain
),
heads AS (
  SELECT {scope}, level, plain, concat(level, ' | ', label) AS row_label, FALSE AS is_total,
         label, pos_num
  FROM names
  UNION ALL
  SELECT {scope}, level, '', concat(level, ' | ', level, ' Total'), TRUE, '', NULL FROM lv
),
placed AS (
  SELECT *, CAST(CASE level WHEN 'E1' THEN 1 WHEN 'E2' THEN 2 ELSE 3 END AS INTEGER)
            AS level_number, CAST({_slot()} AS INTEGER) AS slot
  FROM heads
),
ranked AS (
  SELECT *, CAST(row_number() OVER (
    PARTITION BY {scope} ORDER BY {order}) AS INTEGER) AS row_rank
  FROM placed
),
statement AS (
  SELECT {of('h')}, h.level, h.row_label, h.row_rank, h.is_total, c.product_line,
         c.product_category, {_money('c.value', 'value')}
  FROM ranked h JOIN measure_cells c ON {on('h', 'c', 'level', 'plain')} AND NOT h.is_total
  UNION ALL
  SELECT {of('h')}, h.level, h.row_label, h.row_rank, h.is_total, c.product_line,
         c.product_category, {_money('c.value', 'value')}
  FROM ranked h JOIN total_cells c ON {on('h', 'c', 'level')} AND h.is_total
  WHERE c.value IS NOT NULL
)"""


_WITHOUT_E2 = f"level <> 'E2' OR store <> '{STORE}'"
_EIGHT = "store, month, level, pos, measure, product_category, product_line, value"
_ELEVEN = (
    "store, measure, value, db_level, position, description, cost_kind, product_nr, "
    "product_category, product_line, campaign"
)

_VIEW_1 = f"""
base AS (SELECT DISTINCT {_EIGHT} FROM measures),
totals AS (
  SELECT store, month,
         CAST(sum(CASE WHEN level = 'E1' THEN {_AMOUNT} ELSE 0 END) AS DECIMAL(28,4)) AS e1_total,
         CAST(sum(CASE WHEN level = 'E2' THEN {_AMOUNT} ELSE 0 END) AS DECIMAL(28,4)) AS e2_total,
         CAST(sum(CASE WHEN level = 'E3' THEN {_AMOUNT} ELSE 0 END) AS DECIMAL(28,4)) AS e3_total,
         CAST(sum({_AMOUNT}) AS DECIMAL(28,4)) AS overall_total
  FROM base GROUP BY store, month
),
with_totals AS (
  SELECT b.*, t.e1_total, t.e2_total, t.e3_total, t.overall_total
  FROM base b JOIN totals t ON b.store = t.store AND b.month = t.month
)"""


def _family_case(family: str) -> str:
    test = _in(_PLAIN, fixed.CAMPAIGN_FAMILIES[family])
    return _money(f"sum(CASE WHEN {test} THEN {_AMOUNT} ELSE 0 END)", family)


_CAMPAIGN_KEYS = "store, product_category, product_line, campaign"
_VIEW_2 = f"""
base AS (SELECT {_ELEVEN} FROM measures_db WHERE trim(db_level) IN ('DB1', 'DB2', 'DB3')),
agg AS (
  SELECT {_CAMPAIGN_KEYS}, {', '.join(_family_case(f) for f in fixed.CAMPAIGN_FAMILIES)}
  FROM base GROUP BY {_CAMPAIGN_KEYS}
),
margins AS (
  SELECT {_CAMPAIGN_KEYS},
         CAST(revenue + transfer AS DECIMAL(18,2)) AS e1_total,
         CAST(revenue + transfer - db2_cost AS DECIMAL(18,2)) AS e2_total,
         CAST(revenue + transfer - db2_cost - db3_cost AS DECIMAL(18,2)) AS e3_total
  FROM agg
),
plus_totals AS (
  SELECT {_ELEVEN} FROM base
  UNION ALL SELECT store, 'E1 Total', CAST(e1_total AS VARCHAR), 'DB1', NULL, NULL, NULL, NULL,
                   product_category, product_line, campaign FROM margins
  UNION ALL SELECT store, 'E2 Total', CAST(e2_total AS VARCHAR), 'DB2', NULL, NULL, NULL, NULL,
                   product_category, product_line, campaign FROM margins
  UNION ALL SELECT store, 'E3 Total', CAST(e3_total AS VARCHAR), 'DB3', NULL, NULL, NULL, NULL,
                   product_category, product_line, campaign FROM margins
)"""

_ENTITLEMENTS = f"""
names AS (SELECT DISTINCT store FROM measures),
ent AS (
  SELECT 1 AS user_level, store FROM (SELECT store FROM names ORDER BY store LIMIT 1)
  UNION ALL SELECT 2, store FROM (SELECT store FROM names ORDER BY store LIMIT 2)
  UNION ALL SELECT 3, '{fixed.ALL_STORES}'
)"""
_TITLES = f"""
grains AS (
  SELECT DISTINCT store, {_YEAR} AS year, 'year' AS grain, CAST(NULL AS VARCHAR) AS quarter,
         CAST(NULL AS DATE) AS month, concat('Gesamtjahr ', CAST(year(month) AS VARCHAR)) AS title
  FROM measures
  UNION ALL
  SELECT DISTINCT store, {_YEAR}, 'quarter', {_QUARTER}, CAST(NULL AS DATE),
         concat({_QUARTER}, ' ', CAST(year(month) AS VARCHAR))
  FROM measures
  UNION ALL
  SELECT DISTINCT store, {_YEAR}, 'month', {_QUARTER}, month, CAST(month AS VARCHAR) FROM measures
)"""


def _revenue(names: tuple[str, ...], column: str) -> str:
    test = _in(column, names)
    return f"""
revenue AS (
  SELECT store, year, CAST(coalesce(sum(v) FILTER (WHERE {test}), 0) AS DECIMAL(28,4))
         AS total_revenue,
         coalesce(string_agg(DISTINCT measure, ', ' ORDER BY measure) FILTER (WHERE {test}), '')
         AS revenue_labels, bool_or({test}) AS revenue_found
  FROM m GROUP BY store, year
)"""


def _missing(scope: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{level}' AS level, {i} AS ord, '{name}' AS measure"
        for level, names in fixed.EXPECTED.items()
        for i, name in enumerate(names)
    )
    keys = [k.strip() for k in scope.split(",")]
    on = " AND ".join(f"p.{k} = s.{k}" for k in keys)
    return f"""
expected AS ({rows}),
all_scopes AS (SELECT DISTINCT {scope} FROM m),
present AS (SELECT DISTINCT {scope}, plain FROM m),
missing AS (
  SELECT s.*, e.level, e.ord, e.measure FROM all_scopes s CROSS JOIN expected e
  WHERE NOT EXISTS (SELECT 1 FROM present p WHERE {on} AND p.plain = lower(e.measure))
)"""


def _missing_legacy(scope: str) -> str:
    parts = [
        f"""SELECT {scope}, '{level}' AS level, {i} AS ord, '{name}' AS measure FROM m
  GROUP BY {scope} HAVING NOT bool_or({_in('norm', family)})"""
        for level, i, name, family in fixed.EXPECTED_OLD
    ]
    return f"missing AS ({' UNION ALL '.join(parts)})"


def _german(value: str) -> str:
    return f"concat(translate(format('{{:,.2f}}', {value}), ',.', '.,'), ' €')"


def _legend_case() -> str:
    tests = " ".join(
        f"WHEN '{name}' THEN '{text}'" for name, text in fixed.DESCRIPTIONS.items()
    )
    return f"CASE measure {tests} ELSE '{fixed.NO_DESCRIPTION}' END"


def _rollup() -> str:
    margins = _margin_list("current")
    parts = []
    for grain, quarter, month, title in (
        ("year", "NULL", "NULL", "concat('Gesamtjahr ', CAST(year AS VARCHAR))"),
        ("quarter", "quarter", "NULL", "concat(quarter, ' ', CAST(year AS VARCHAR))"),
        ("month", "quarter", "month", "CAST(month AS VARCHAR)"),
    ):
        keys = ["store", "year", *[k for k in (quarter, month) if k != "NULL"]]
        head = (
            f"SELECT store, '{grain}' AS grain, {title} AS period, year, "
            f"CAST({quarter} AS VARCHAR) AS quarter, CAST({month} AS DATE) AS month"
        )
        scope = ", ".join(keys)
        parts.append(
            f"{head}, product_line, product_category, {margins} FROM m WHERE {_KNOWN} "
            f"GROUP BY {scope}, product_line, product_category"
        )
        parts.append(f"{head}, {_SUM_LABELS}, {margins} FROM m WHERE {_KNOWN} GROUP BY {scope}")
    return "\nUNION ALL ".join(parts)


def oracles() -> dict[str, str]:
    """SQL text per registered query."""
    value = _money("sum(v)", "value")
    sums = fixed.SUM_LINE
    rounded = f"CAST({_AMOUNT} AS DECIMAL(18,2))"
    statement = "level, row_label, row_rank, is_total, product_line, product_category, value"
    twelve = f"{_EIGHT}, e1_total, e2_total, e3_total, overall_total"
    return {
        "scan_store": _with() + f"SELECT {_EIGHT} FROM measures WHERE store = '{STORE}'",
        "scan_store_projected": _with(_VIEW_1)
        + f"SELECT {twelve} FROM with_totals WHERE store = '{STORE}'",
        "distinct_stores": _with()
        + "SELECT DISTINCT trim(store) AS store FROM measures WHERE trim(store) <> ''",
        "adapt_level_schema": _with(_CAMPAIGN)
        + """SELECT store, CASE trim(db_level) WHEN 'DB1' THEN 'E1' WHEN 'DB2' THEN 'E2'
             WHEN 'DB3' THEN 'E3' ELSE trim(db_level) END AS level, position AS pos, db_level,
             position, measure, cost_kind, campaign, value FROM measures_db""",
        "base_levels": _with(_CAMPAIGN, _VIEW_2) + f"SELECT {_ELEVEN} FROM base",
        "time_columns": _with()
        + f"SELECT store, month, {_YEAR} AS year, {_QUARTER} AS quarter, measure, value "
        "FROM measures",
        "filter_period": _with()
        + f"SELECT {_EIGHT} FROM measures WHERE year(month) = 1997 AND quarter(month) = 2",
        "period_options": _with()
        + f"""SELECT store, month, {_YEAR} AS year, {_QUARTER} AS quarter,
              CAST(dense_rank() OVER (PARTITION BY store ORDER BY year(month) DESC) AS INTEGER)
                AS year_rank,
              CAST(dense_rank() OVER (PARTITION BY store ORDER BY month) AS INTEGER) AS month_rank
              FROM (SELECT DISTINCT store, month FROM measures)""",
        "latest_year": _with()
        + f"""SELECT m.store, m.month, m.level, m.pos, m.measure, m.product_category,
              m.product_line, m.value, {_YEAR.replace('month', 'm.month')} AS year
              FROM measures m JOIN (SELECT store, max(year(month)) AS newest FROM measures
              GROUP BY store) n ON m.store = n.store AND year(m.month) = n.newest""",
        "period_title": _with(_TITLES)
        + "SELECT store, year, grain, quarter, month, title FROM grains",
        "fill_axes": _with()
        + f"""SELECT store, month, level, pos, measure,
              coalesce(product_category, '{fixed.GENERAL}') AS product_category,
              coalesce(product_line, '{fixed.GENERAL}') AS product_line, value
              FROM measures""",
        "coerce_value": _with()
        + f"""SELECT store, month, level, pos, measure, product_category, product_line,
              CAST(coalesce({_AMOUNT}, 0) AS DECIMAL(18,4)) AS value, value AS text,
              {_AMOUNT} AS amount FROM measures""",
        "exclude_measures": _with()
        + f"SELECT {_EIGHT} FROM measures WHERE NOT ({_in(_PLAIN, fixed.EXCLUDED)})",
        "measure_in_set": _with()
        + f"SELECT {_EIGHT} FROM measures WHERE {_in(_NORM, fixed.REVENUE)}",
        "filter_level": _with() + f"SELECT {_EIGHT} FROM measures WHERE level = 'E2'",
        "present_levels": _with()
        + f"""SELECT store, string_agg(DISTINCT level, ', ' ORDER BY level) AS levels
              FROM measures GROUP BY store""",
        "row_labels": _with(_m(), _statement("store, year", "current"))
        + "SELECT store, year, row_label, is_total FROM heads",
        "profit_status": _with(_m())
        + f"""SELECT store, month, {_money(_margins('current')[2], 'e3_total')},
              CASE WHEN {_margins('current')[2]} > 0 THEN '{fixed.PROFITABLE}'
                   ELSE '{fixed.NOT_PROFITABLE}' END AS status
              FROM m WHERE {_KNOWN} GROUP BY store, month""",
        "clamp_level": """
            SELECT user_name, security_level,
                   CASE WHEN security_level IS NULL OR security_level < 1 THEN 1
                        WHEN security_level > 3 THEN 3 ELSE security_level END AS user_level
            FROM (SELECT c_name AS user_name, CASE WHEN c_acctbal >= 0
                         THEN CAST(c_nationkey AS INTEGER) - 1 END AS security_level
                  FROM customer)""",
        "entitled_grains": _with(_ENTITLEMENTS, _TITLES)
        + """SELECT e.user_level, g.store, g.grain, g.year, g.quarter, g.month, g.title
             FROM grains g JOIN ent e ON (e.store = '*' OR e.store = g.store)
             WHERE g.grain = 'year' OR (g.grain = 'quarter' AND e.user_level >= 2)
                   OR (g.grain = 'month' AND e.user_level >= 3)""",
        "measures_with_totals": _with(_VIEW_1) + f"SELECT {twelve} FROM with_totals",
        "aligned_sum": _with(_m(), _signed())
        + f"""SELECT store, year, product_line, product_category, {value} FROM signed
              GROUP BY store, year, product_line, product_category
              UNION ALL SELECT store, year, {_SUM_LABELS}, {value} FROM signed
              GROUP BY store, year""",
        "missing_measures": _with(_m(), _missing("store, month"))
        + """SELECT store, month, level, string_agg(measure, ', ' ORDER BY ord) AS missing
             FROM missing GROUP BY store, month, level""",
        "missing_measures_legacy": _with(_m(), _missing_legacy("store, month"))
        + """SELECT store, month, level, string_agg(measure, ', ' ORDER BY ord) AS missing
             FROM missing GROUP BY store, month, level""",
        "entitled_overview": _with(_m(), _ENTITLEMENTS, *_overviews()) + _overview_rows(),
        "entitled_rows": _with(_ENTITLEMENTS)
        + """SELECT e.user_level, m.* FROM measures m
             JOIN ent e ON (e.store = '*' OR e.store = m.store)""",
        "measure_legend": _with()
        + f"""SELECT store, year, measure, {_legend_case()} AS description,
              CAST(row_number() OVER (PARTITION BY store, year ORDER BY first) AS INTEGER)
                AS row_rank
              FROM (SELECT store, year, trim(measure) AS measure, min(place) AS first
                    FROM (SELECT store, {_YEAR} AS year, measure, row_number() OVER (
                            ORDER BY month NULLS LAST, level NULLS LAST, pos NULLS LAST, measure,
                            product_category NULLS LAST, product_line NULLS LAST) AS place
                          FROM measures)
                    GROUP BY store, year, trim(measure))""",
        "distinct_base": _with() + f"SELECT DISTINCT {_EIGHT} FROM measures",
        "level_totals": _with(_VIEW_1) + "SELECT * FROM totals",
        "family_sums": _with(_CAMPAIGN, _VIEW_2) + "SELECT * FROM agg",
        "family_margins": _with(_CAMPAIGN, _VIEW_2) + "SELECT * FROM margins",
        "measure_cells": _with(_m()) + _cells(fixed.REVENUE, "store, year", False),
        "measure_pivot": _with(_m(), f"c AS ({_cells(fixed.REVENUE, 'store, year', True)})")
        + _wide("c", "store, year", CELL_COLUMNS),
        "grand_total_cell": _with(_m()) + _cells(fixed.COMMISSION, "store, month", True),
        "total_revenue": _with(_m(), _revenue(fixed.KPI_REVENUE, "norm"))
        + "SELECT * FROM revenue",
        "total_revenue_legacy": _with(_m(), _revenue(fixed.KPI_REVENUE_OLD, "plain"))
        + "SELECT * FROM revenue",
        "margin_cascade": _with(_m()) + _cascade("store, year", "current"),
        "margin_cascade_legacy": _with(_m()) + _cascade("store, year", "legacy"),
        "margin_cascade_handbook": _with(_m()) + _cascade("store, year", "handbook"),
        "level_measure_cells": _with(_m())
        + f"""SELECT store, year, level, plain AS name, product_line, product_category, {value}
              FROM m WHERE {_LISTED}
              GROUP BY store, year, level, plain, product_line, product_category""",
        "level_raw_total": _with(_m())
        + f"""SELECT store, year, level, product_line, product_category, {value}
              FROM m WHERE {_LISTED}
              GROUP BY store, year, level, product_line, product_category""",
        "level_table_single": _with(_m(), _level_table())
        + f"SELECT store, year, {statement} FROM tables WHERE level = 'E3'",
        "level_table": _with(_m(), _level_table()) + f"SELECT store, year, {statement} FROM tables",
        "margin_statement": _with(_m(), _statement("store, year", "current"))
        + f"SELECT store, year, {statement} FROM statement",
        "margin_statement_legacy": _with(_m(), _statement("store, year", "legacy"))
        + f"SELECT store, year, {statement} FROM statement",
        "statement_wide": _with(_m(), _statement("store, year", "current"))
        + _wide("statement", "store, year, row_rank, row_label, is_total", STATEMENT_COLUMNS),
        "kpi_overview": _with(
            _m(),
            _revenue(fixed.KPI_REVENUE, "norm"),
            _missing("store, year"),
            f"cascade AS ({_cascade('store, year', 'current')})",
        )
        + f"""SELECT r.store, r.year, r.total_revenue, r.revenue_labels, r.revenue_found,
              c.e3_total, coalesce(x.missing, '') AS missing,
              CASE WHEN c.e3_total > 0 THEN '{fixed.PROFITABLE}'
                   ELSE '{fixed.NOT_PROFITABLE}' END AS status
              FROM revenue r
              JOIN cascade c ON r.store = c.store AND r.year = c.year
                   AND c.product_line = '{sums}'
              LEFT JOIN (SELECT store, year, string_agg(measure, ', ' ORDER BY level, ord)
                         AS missing FROM missing GROUP BY store, year) x
                   ON r.store = x.store AND r.year = x.year""",
        "dedup_row_heads": _with(_m()) + _row_heads(),
        "measure_catalog": _with() + "SELECT DISTINCT level, measure FROM measures",
        "row_count": _with() + "SELECT count(*) AS rows_total FROM measures",
        "period_rollup": _with(_m()) + _rollup(),
        "sorted_scan": _with()
        + f"""SELECT {_EIGHT} FROM measures ORDER BY month, level, pos, measure,
              product_category NULLS LAST, product_line NULLS LAST, store, value""",
        "row_head_order": _with(_m(), f"heads AS ({_row_heads()})")
        + """SELECT *, CAST(row_number() OVER (PARTITION BY store, level
             ORDER BY pos_num NULLS LAST, label, name) AS INTEGER) AS row_rank FROM heads""",
        "statement_order": _with(_m(), _statement("store, year", "current"))
        + "SELECT store, year, level_number, slot, row_label, row_rank, is_total FROM ranked",
        "view_order": _with(_VIEW_1)
        + f"""SELECT {twelve} FROM with_totals ORDER BY month, level, pos, measure,
              product_category NULLS FIRST, product_line NULLS FIRST""",
        "top_200": _with(_CAMPAIGN, _VIEW_2)
        + f"SELECT {_ELEVEN} FROM plus_totals ORDER BY "
        + ", ".join(
            f"{c} NULLS FIRST"
            for c in (
                "product_line product_category db_level measure store value position "
                "description cost_kind product_nr campaign"
            ).split()
        )
        + " LIMIT 200",
        "measures_plus_totals": _with(_CAMPAIGN, _VIEW_2) + "SELECT * FROM plus_totals",
        "totals_as_rows": _with(_CAMPAIGN, _VIEW_2)
        + "\nUNION ALL ".join(
            f"SELECT {_CAMPAIGN_KEYS}, 'e{i}_total' AS measure, e{i}_total AS value FROM margins"
            for i in (1, 2, 3)
        ),
        "synthesized_e2": _with(_m(_WITHOUT_E2), _statement("store, year", "current"))
        + """SELECT store, year, level, row_label, is_total, product_line, product_category, value
             FROM statement WHERE is_total AND level = 'E2'""",
        "override_totals": _with(_m(), _statement("store, month", "handbook"))
        + """SELECT store, month, level, row_label, is_total, product_line, product_category,
             value FROM statement WHERE is_total""",
        "normalize_measure": _with()
        + f"SELECT store, month, measure, {_NORM} AS measure_norm FROM measures",
        "simple_norm": _with()
        + f"SELECT store, month, measure, {_PLAIN} AS measure_norm FROM measures",
        "format_eur": _with()
        + f"""SELECT store, month, measure, {rounded} AS rounded,
              CASE WHEN {_AMOUNT} IS NULL THEN '-' ELSE {_german(rounded)} END AS text
              FROM measures""",
        "format_eur_dash_zero": _with()
        + f"""SELECT store, month, measure, {rounded} AS rounded,
              CASE WHEN coalesce({rounded}, 0) = 0 THEN '-' ELSE {_german(rounded)} END AS text
              FROM measures""",
        "statement_text": _with(_m(), _statement("store, month", "current"))
        + f"""SELECT store, month, row_label, product_line, product_category,
              {_german('CAST(value AS DECIMAL(28,2))')} AS text FROM statement""",
        "year_quarter": _with()
        + f"""SELECT store, month, {_YEAR} AS year, {_QUARTER} AS quarter,
              concat({_QUARTER}, ' ', CAST(year(month) AS VARCHAR)) AS title FROM measures""",
        "level_code_map": _with(_CAMPAIGN)
        + """SELECT store, measure, db_level, CASE trim(db_level) WHEN 'DB1' THEN 'E1'
             WHEN 'DB2' THEN 'E2' WHEN 'DB3' THEN 'E3' ELSE trim(db_level) END AS level
             FROM measures_db""",
        "row_label_text": _with()
        + "SELECT store, month, concat(level, ' | ', measure) AS row_label FROM measures",
        "decimal_round": _with()
        + f"""SELECT store, month, measure, {rounded} AS rounded,
              CAST({rounded} AS DECIMAL(28,4)) AS as_money FROM measures""",
    }


_GRAINS = (
    (1, "store, year"),
    (2, "store, year, quarter"),
    (3, "store, year, quarter, month"),
)


def _overviews() -> tuple[str, ...]:
    """Figures and missing measures of all reports, for the grain of each user level."""
    test = _in("norm", fixed.KPI_REVENUE)
    parts = []
    for level, scope in _GRAINS:
        lacking = " || ".join(
            f"CASE WHEN bool_or(plain = '{name.lower()}') THEN '' ELSE ', {name}' END"
            for names in fixed.EXPECTED.values()
            for name in names
        )
        parts.append(f"""
figures{level} AS (
  SELECT {scope}, CAST(coalesce(sum(v) FILTER (WHERE {test}), 0) AS DECIMAL(28,4))
         AS total_revenue,
         coalesce(string_agg(DISTINCT measure, ', ' ORDER BY measure) FILTER (WHERE {test}), '')
         AS revenue_labels, bool_or({test}) AS revenue_found,
         {_money(_margins('current')[2], 'e3_total')}, substr({lacking}, 3) AS missing
  FROM m GROUP BY {scope}
)""")
    return tuple(parts)


def _overview_rows() -> str:
    parts = []
    for level, scope in _GRAINS:
        quarter = "f.quarter" if level > 1 else "CAST(NULL AS VARCHAR)"
        month = "f.month" if level > 2 else "CAST(NULL AS DATE)"
        parts.append(f"""
  SELECT {level} AS user_level, f.store, f.year, {quarter} AS quarter, {month} AS month,
         total_revenue, revenue_labels, revenue_found, e3_total, missing,
         CASE WHEN e3_total > 0 THEN '{fixed.PROFITABLE}' ELSE '{fixed.NOT_PROFITABLE}' END AS status
  FROM figures{level} f
  WHERE EXISTS (SELECT 1 FROM ent e WHERE e.user_level = {level}
                AND (e.store = '*' OR e.store = f.store))""")
    return " UNION ALL ".join(parts)


def _signed() -> str:
    """Revenue and transfer price with their sign, discounts with the other one."""
    plus = fixed.REVENUE + fixed.TRANSFER
    minus = fixed.MATERIAL_DISCOUNT + fixed.CATEGORY_DISCOUNT
    return f"""
signed AS (
  SELECT store, year, product_line, product_category,
         CASE WHEN {_in('norm', plus)} THEN v ELSE -v END AS v
  FROM m WHERE {_in('norm', plus + minus)}
)"""


def _row_heads() -> str:
    return f"""SELECT store, level, plain AS name, min(trim(measure)) AS label,
       min(try_cast(pos AS DOUBLE)) AS pos_num FROM m WHERE {_LISTED}
       GROUP BY store, level, plain"""


def _level_table() -> str:
    """CTEs up to `tables`: every level's own table with its raw total."""
    keys = "store, year, level, name"
    value = _money("sum(v)", "value")
    rows = """
rows_of AS (
  SELECT store, year, level, plain AS name, trim(measure) AS label,
         try_cast(pos AS DOUBLE) AS pos_num, product_line, product_category, v, FALSE AS is_total
  FROM m WHERE {listed}
  UNION ALL
  SELECT store, year, level, '', concat(level, ' Total'), NULL, product_line, product_category,
         v, TRUE FROM m WHERE {listed}
)""".format(listed=_LISTED)
    return f"""{rows},
heads AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY store, year, level
            ORDER BY is_total, pos_num NULLS LAST, row_label, name) AS INTEGER) AS row_rank
  FROM (SELECT {keys}, is_total, min(label) AS row_label, min(pos_num) AS pos_num
        FROM rows_of GROUP BY {keys}, is_total)
),
sums AS (
  SELECT {keys}, is_total, product_line, product_category, {value}
  FROM rows_of GROUP BY {keys}, is_total, product_line, product_category
  UNION ALL
  SELECT {keys}, is_total, {_SUM_LABELS}, {value} FROM rows_of GROUP BY {keys}, is_total
),
tables AS (
  SELECT s.store, s.year, s.level, h.row_label, h.row_rank, s.is_total, s.product_line,
         s.product_category, s.value
  FROM sums s JOIN heads h ON s.store = h.store AND s.year = h.year AND s.level = h.level
       AND s.name = h.name AND s.is_total = h.is_total
)"""
