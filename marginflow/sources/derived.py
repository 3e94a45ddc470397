"""Measure tables made from the sales tables, the data all registered queries run on.

A line item becomes five measure rows (a revenue of three spellings, transfer price, an amount
that is no money, a discount of one of two kinds, a commission of two spellings); every
store and month gets three fixed costs, unreadable ones in January among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginflow.plans.joins import if_small


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _text(amount: Column) -> Column:
    return amount.cast("decimal(18,4)").cast("string")


def _by_kind(kind: Column, *choices: Column | str) -> Column:
    """The choice of a row's kind: only that one is worked out."""
    first, *others = choices
    column = F.when(kind == 0, first)
    for number, choice in enumerate(others[:-1], start=1):
        column = column.when(kind == number, choice)
    return column.otherwise(others[-1])


def _row(level: str, pos: str, measure: Column, value: Column) -> Column:
    return F.struct(
        F.lit(level).alias("level"),
        F.lit(pos).alias("pos"),
        measure.alias("measure"),
        value.alias("value"),
    )


def derived_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly measures per store. Line items are read once for the five rows of each.

    Lines move once, to their parts; suppliers come to them if they are few. The five rows are
    made from a number each, so a query that leaves out the amounts does not write their text.
    """
    supplier, nation = _read(spark, sf_dir, "supplier"), _read(spark, sf_dir, "nation")
    in_nation = F.col("s_nationkey") == F.col("n_nationkey")
    suppliers = if_small(supplier, ["s_suppkey", "s_nationkey"])
    sold = _read(spark, sf_dir, "lineitem").withColumn("month", F.trunc("l_shipdate", "month"))
    lines = (
        sold.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, in_nation)
        .join(_read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("n_name").alias("store"),
            "month",
            F.col("p_type").alias("product_line"),
            F.when(F.col("p_size") % 10 != 0, F.col("p_brand")).alias("product_category"),
            F.col("l_returnflag").alias("flag"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
            F.col("l_quantity").cast("decimal(9,2)").alias("quantity"),
            F.col("p_retailprice").cast("decimal(12,2)").alias("retail"),
            F.col("l_discount").cast("decimal(4,2)").alias("discount"),
            F.col("l_tax").cast("decimal(4,2)").alias("tax"),
        )
    )
    flag, price, kind = F.col("flag"), F.col("price"), F.col("kind")
    revenue = F.when(flag == "A", "Umsatz EUR").when(flag == "R", " UmsatzEUR")
    discount = F.when(flag == "R", "DiscountAufMaterialKategorieEUR")
    commission = F.when(flag == "A", "Commission")
    per_line = {
        "level": _by_kind(kind, "E1", "E1", "E1", "E2", F.lit("E3")),
        "pos": _by_kind(kind, "1", "2", "9", F.when(flag == "R", "2").otherwise("1"), F.lit("10")),
        "measure": _by_kind(
            kind,
            revenue.otherwise("UmsatzEUR"),
            "TransferPriceEUR",
            "SalesAmount",
            discount.otherwise("DiscountAufMaterialEUR"),
            commission.otherwise("Commission in EUR"),
        ),
        "value": _by_kind(
            kind,
            _text(price),
            _text(-(F.col("quantity") * F.col("retail"))),
            _text(F.col("quantity")),
            _text(price * F.col("discount")),
            _text(price * F.col("tax")),
        ),
    }
    base = F.sum(10 * F.abs("s_acctbal").cast("decimal(12,2)")).alias("base")
    fixed = supplier.join(nation, in_nation).groupBy(F.col("n_name").alias("store")).agg(base)
    salary_share = F.lit("2").cast("decimal(2,1)")
    social_share = F.lit("0.4").cast("decimal(2,1)")
    social = F.when(F.month("month") == 1, "n/a").otherwise(_text(F.col("base") * social_share))
    per_month = F.array(
        _row("E3", "3", F.lit("Monthly Rent"), _text(F.col("base"))),
        _row("E3", "4", F.lit("Monthly Salary"), _text(F.col("base") * salary_share)),
        _row("E3", "5", F.lit("Monthly Social Costs"), social),
    )
    nothing = F.lit(None).cast("string")
    kinds = F.explode(F.array(*[F.lit(k) for k in range(5)]))
    sales = lines.withColumn("kind", kinds).select(
        "store",
        "month",
        "product_category",
        "product_line",
        *[column.alias(name) for name, column in per_line.items()],
    )
    costs = (
        lines.select("store", "month")
        .distinct()
        .join(fixed, "store")
        .select(
            "store",
            "month",
            nothing.alias("product_category"),
            nothing.alias("product_line"),
            F.inline(per_month),
        )
    )
    order = ["store", "month", "level", "pos", "measure", "product_category", "product_line"]
    return sales.unionByName(costs).select(*order, "value")


def by_campaign(measures: DataFrame) -> DataFrame:
    """Measures in the campaign layout, with one row per store on an unknown level."""
    missing = F.lit(None).cast("string")
    fixed_cost = (F.col("level") == "E3") & (F.col("pos") != "10")
    rows = measures.select(
        "store",
        "measure",
        "value",
        F.concat(F.lit(" DB"), F.substring("level", 2, 1), F.lit(" ")).alias("db_level"),
        F.col("pos").alias("position"),
        missing.alias("description"),
        F.when(fixed_cost, "fix").otherwise("variabel").alias("cost_kind"),
        missing.alias("product_nr"),
        "product_category",
        "product_line",
        F.when(F.month("month") >= 10, "Q4").alias("campaign"),
    )
    unknown = measures.select("store").distinct().select(
        "store",
        F.lit("UmsatzEUR").alias("measure"),
        F.lit("1.0000").alias("value"),
        F.lit("DB9").alias("db_level"),
    )
    return rows.unionByName(unknown, allowMissingColumns=True)


def with_large_amounts(measures: DataFrame) -> DataFrame:
    """Measures with amounts out of range: salaries of January and sales amounts of February."""
    month = F.month("month")
    large = F.when((F.col("pos") == "4") & (month == 1), "1e15")
    large = large.when((F.col("pos") == "9") & (month == 2), "-Infinity")
    return measures.withColumn("value", large.otherwise(F.col("value")))


def store_entitlements(measures: DataFrame) -> DataFrame:
    """Sample entitlements: the first store, the first two stores, all stores."""
    two = measures.select("store").distinct().orderBy("store").limit(2)
    names = two.agg(F.array_sort(F.collect_list("store")).alias("names"))
    grants = [(1, F.get("names", F.lit(0))), (2, F.get("names", F.lit(0)))]
    grants += [(2, F.get("names", F.lit(1))), (3, F.lit("*"))]
    rows = F.array(
        *[F.struct(F.lit(level).alias("user_level"), s.alias("store")) for level, s in grants]
    )
    return names.select(F.inline(rows)).filter("store IS NOT NULL")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users, some with a level that is missing or out of range."""
    level = F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey").cast("int") - 1)
    return _read(spark, sf_dir, "customer").select(
        F.col("c_name").alias("user_name"), level.alias("security_level")
    )
