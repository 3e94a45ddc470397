"""Wall time of the headline queries; prints one JSON line.

`queries` are the registered queries over the sales tables, measures derived on the way.
`stored` are the same operators over the published measure table. `comparison` sets the
one-pass cascade against one grouping per measure family with joins in between.
Every query is run to the end without collecting its rows, after three queries to warm up. All
queries take turns, up to three times while the time allowed lasts; the time is the median.

    python bench.py [folder for the published table]

Without a folder that is the session's spark.checkpoint.dir, or a new one under /tmp.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
import uuid
from functools import partial, reduce
from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marginflow import catalog  # noqa: E402
from marginflow.operators.cascade import margin_columns  # noqa: E402
from marginflow.operators.cells import AXES, SCOPE, measure_cells, summarize  # noqa: E402
from marginflow.plans.settings import local_session  # noqa: E402
from marginflow.registry import QUERIES, Tables, registered  # noqa: E402
from marginflow.sources import publish, read_measures  # noqa: E402
from marginflow.sources.derived import derived_measures  # noqa: E402

HEADLINE = (
    "margin_cascade",
    "margin_cascade_handbook",
    "margin_statement",
    "level_table",
    "kpi_overview",
    "total_revenue",
    "missing_measures",
    "period_rollup",
    "distinct_base",
    "level_totals",
    "measures_with_totals",
    "family_margins",
    "measures_plus_totals",
    "top_200",
    "scan_store",
    "entitled_rows",
)
RUNS = 3
ALLOWED = float(os.environ.get("BENCH_SECONDS", "420"))  # no further turn begins after this


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(makers: dict, began: float) -> dict[str, float]:
    """Median time of each query over the turns there was time for, one turn at least."""
    found: dict[str, list[float]] = {name: [] for name in makers}
    for turn in range(RUNS):
        if turn and time.perf_counter() - began > ALLOWED:
            break
        for name, make in makers.items():
            start = time.perf_counter()
            run(make())
            found[name].append(time.perf_counter() - start)
    return {name: round(median(times), 3) for name, times in found.items()}


def bench_folder(spark) -> str:
    if len(sys.argv) > 1:
        return sys.argv[1]
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/bench-{uuid.uuid4().hex}"
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def ten_pass_cascade(measures: DataFrame) -> DataFrame:
    """The cascade as one grouping per measure set, aligned by full joins."""
    keys = [*SCOPE, *AXES]
    sets = {f: [(n,) for n in names] if f == "fixed_costs" else [names]
            for f, names in catalog.FAMILIES.items()}
    parts = [
        (family, measure_cells(measures, list(names), grand_total=True)
         .withColumnRenamed("value", f"{family}_{i}"))
        for family, groups in sets.items()
        for i, names in enumerate(groups)
    ]
    table = reduce(lambda a, b: a.join(b, keys, "full"), [p for _, p in parts])
    zero = F.lit(0)

    def total(*families: str):
        cells = [F.coalesce(F.col(f"{f}_{i}"), zero) for f in families for i in range(len(sets[f]))]
        return reduce(lambda a, b: a + b, cells)

    rule = catalog.PROFILES["current"]
    steps = {"e1": total("revenue", "transfer"), **{s: total(*f) for s, f in rule.items()}}
    return table.withColumns(steps).select(*keys, *margin_columns())


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=max(8, int(cores)))
    queries = registered()

    for name in ("margin_cascade", "margin_statement", "distinct_base"):  # warm up
        run(queries[name](spark, sf_dir))
    makers = {name: partial(queries[name], spark, sf_dir) for name in HEADLINE}
    began = time.perf_counter()
    times = timed(makers, began)

    folder = f"{bench_folder(spark)}/measures"
    start = time.perf_counter()
    publish(derived_measures(spark, sf_dir), folder)
    published = round(time.perf_counter() - start, 3)
    table = read_measures(spark, folder)
    rows = table.count()
    given = Tables(spark, sf_dir, table)
    stored = timed({name: partial(QUERIES[name], given) for name in HEADLINE}, began)
    comparison = {
        "one_pass_cascade": stored["margin_cascade"],
        **timed(
            {
                "ten_pass_cascade": partial(ten_pass_cascade, table),
                "summarize": partial(summarize, table),
            },
            began,
        ),
    }
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "measure_rows": rows,
                "publish": published,
                "stored": stored,
                "stored_total": round(sum(stored.values()), 3),
                "comparison": comparison,
            }
        )
    )


if __name__ == "__main__":
    main()
