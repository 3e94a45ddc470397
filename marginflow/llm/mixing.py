"""Mix sources to target weights: exact block quotas, split among shards by a tree of draws.

DataFrame functions only. Every document has a key, a digest of the seed, its id and its text,
whose order is the random permutation of its source. The first two digits of the key are its
block, so a source is 256 permuted blocks. A source is drawn in whole epochs and one part of an
epoch, which is the stretch of the permutation that fills the rest of the target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginflow.llm.frames import saved, word_count
from marginflow.plans.joins import join_small

WEIGHTS = (1, 2, 3)  # by position of the source, repeated
MAX_EPOCHS = 3  # no document is taken more often
BLOCK_DIGITS = 2  # of the key, in base 16
STEP_DIGITS = 3  # by which the end of the partial epoch is narrowed down
STEPS = 3
TOP_UPS = 3  # largest documents that fit, taken when the partial epoch meets one that does not
KEY_DIGITS = STEP_DIGITS * STEPS
PAST_ALL = "g"  # behind every key


def document_key(doc_id: Column, text: Column, seed: int) -> Column:
    """Digest that orders a source at random, the same in every run."""
    blank = F.lit("")
    return F.md5(
        F.concat(
            F.lit(f"{seed}|"),
            F.coalesce(doc_id.cast("string"), blank),
            F.lit("|"),
            F.md5(F.coalesce(text, blank)),
        )
    )


def source_key(source: Column) -> Column:
    """A key that is never null and sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MAX_EPOCHS
) -> DataFrame:
    """(`_src`, `source_size`) with `target`: all sizes shared by weight, `most` times at most.

    What a source cannot take goes to the others by weight, until none is above its bound.
    In the order of bound by weight the bounded sources come first, so running sums find the
    level at which the others meet. One row per source: the windows are over these alone.
    """
    count = len(weights)
    by_name = Window.orderBy("_src")
    weight = F.element_at(
        F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % count + 1).cast("int")
    )
    rows = sizes.withColumn("_w", weight.cast("long"))
    by_bound = Window.orderBy(
        (F.col("source_size").cast("double") / F.col("_w")), F.col("_src")
    )
    before = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    after = by_bound.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    bound = F.col("source_size") * most
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(bound).over(before), F.lit(0))
    rows = rows.withColumn("_left", left).withColumn("_heavy", F.sum("_w").over(after))
    wide = "decimal(38,0)"
    fits = F.col("_left").cast(wide) * F.col("_w") <= bound.cast(wide) * F.col("_heavy")
    level = F.first(
        F.when(fits, F.col("_left").cast("double") / F.col("_heavy")), ignorenulls=True
    ).over(by_bound.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (
        rows.withColumn("_level", level)
        .withColumn("target", F.least(F.col("_level") * F.col("_w"), bound.cast("double")))
        .select("_src", "source_size", "target")
    )


def narrow(units: DataFrame, ends: DataFrame) -> DataFrame:
    """`ends` (`_src`, `_rest`) with the key prefix `_end` at which `_rest` words are used up.

    Units with a smaller prefix fit in `_rest`; `_rest` becomes what they leave. Each step
    sums the words by the next digits, so a hot source is spread and only its buckets, 4096
    at most, meet in a window.
    """
    ends = ends.withColumn("_end", F.lit(""))
    for step in range(STEPS):
        done = step * STEP_DIGITS
        inside = join_small(units, ends.select("_src", "_end", "_rest"), ["_src"]).filter(
            F.substring("_key", 1, done) == F.col("_end")
        )
        digits = F.substring("_key", done + 1, STEP_DIGITS)
        sums = inside.groupBy("_src", "_end", "_rest", digits.alias("_next")).agg(
            F.sum("_words").alias("_words")
        )
        order = Window.partitionBy("_src").orderBy("_next")
        through = F.sum("_words").over(order.rowsBetween(Window.unboundedPreceding, 0))
        crossed = (
            sums.withColumn("_through", through)
            .filter(F.col("_through") > F.col("_rest"))
            .groupBy("_src")
            .agg(F.min(F.struct("_next", "_through", "_words", "_end", "_rest")).alias("c"))
        )
        ends = saved(
            crossed.select(
                "_src",
                F.concat("c._end", "c._next").alias("_end"),
                (F.col("c._rest") - (F.col("c._through") - F.col("c._words"))).alias("_rest"),
            )
        )
    return ends


def top_up(units: DataFrame, ends: DataFrame) -> DataFrame:
    """`ends` with the keys of up to TOP_UPS undrawn units, each the largest that still fits."""
    free = join_small(units, ends.select("_src", "_end", "_rest"), ["_src"]).filter(
        (F.substring("_key", 1, KEY_DIGITS) >= F.col("_end"))
        & (F.col("_words") > 0)
        & (F.col("_words") <= F.col("_rest"))
    )
    free = free.select("_src", "_key", "_words")
    for i in range(TOP_UPS):
        taken = [F.col(f"_top{j}") for j in range(i)]
        state = join_small(free, ends, ["_src"]).filter(F.col("_words") <= F.col("_rest"))
        for key in taken:
            state = state.filter(key.isNull() | (F.col("_key") != key))
        best = state.groupBy("_src").agg(F.max(F.struct("_words", "_key")).alias("b"))
        ends = saved(
            ends.join(best, "_src", "left")
            .withColumn(f"_top{i}", F.col("b._key"))
            .withColumn("_rest", F.col("_rest") - F.coalesce(F.col("b._words"), F.lit(0)))
            .drop("b")
        )
    return ends


def go_on(units: DataFrame, ends: DataFrame) -> DataFrame:
    """`ends` with `_steps`, by which the partial epoch goes on past units that do not fit.

    Each pass draws the stretch behind the last unit that did not fit, of the units that fit by
    themselves, until none does. Its step has the keys `after` and `until` which it lies, and
    `most`, the words of a unit it may take. `_at` is where the source is left. Units whose
    digests agree in KEY_DIGITS digits are drawn or passed over together.
    """
    tops = F.array(*(f"_top{i}" for i in range(TOP_UPS)))
    kind = "array<struct<after:string,until:string,most:double>>"
    state = saved(ends.withColumn("_steps", F.array().cast(kind)).withColumn("_at", F.col("_end")))
    free = units.select("_src", "_key", "_words")
    while True:
        bounds = state.select("_src", "_at", "_rest", tops.alias("_tops"))
        free = saved(
            join_small(free, bounds, ["_src"])
            .filter(
                (F.substring("_key", 1, KEY_DIGITS) > F.col("_at"))
                & (F.col("_words") > 0)
                & (F.col("_words") <= F.col("_rest"))
                & ~F.coalesce(F.array_contains("_tops", F.col("_key")), F.lit(False))
            )
            .select("_src", "_key", "_words")
        )
        sums = saved(free.groupBy("_src").agg(F.sum("_words").alias("_all")))
        if sums.isEmpty():
            return state
        crossed = narrow(free, state.join(sums, "_src").select("_src", "_rest"))
        crossed = crossed.select("_src", F.col("_end").alias("_until"), F.col("_rest").alias("_left"))
        until = F.coalesce("_until", F.lit(PAST_ALL))
        step = F.struct(
            F.col("_at").alias("after"), until.alias("until"), F.col("_rest").alias("most")
        )
        went = F.col("_all").isNotNull()
        state = saved(
            state.join(sums, "_src", "left")
            .join(crossed, "_src", "left")
            .withColumn(
                "_steps",
                F.when(went, F.concat("_steps", F.array(step))).otherwise(F.col("_steps")),
            )
            .withColumn("_at", F.when(went, until).otherwise(F.col("_at")))
            .withColumn(
                "_rest",
                F.when(went, F.coalesce("_left", F.col("_rest") - F.col("_all"))).otherwise(
                    F.col("_rest")
                ),
            )
            .drop("_all", "_until", "_left")
        )


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(`_src`, `_quota`) to (`_src`, `_shard`, `_quota`): a tree of hypergeometric draws.

    A node has blocks of all sources and a run of shards. Its left child gets as many blocks
    as its shards' share, drawn without replacement: all blocks of the node are ranked by a
    digest and the first go left. What counts is how many of each source do. There are 768
    blocks of a source at most, so the tree's work follows the number of sources.
    """
    nodes = quotas.select("_src", "_quota", F.lit(0).alias("_lo"), F.lit(shards).alias("_hi"))
    width = shards
    while width > 1:
        blocks = nodes.filter("_quota > 0").withColumn(
            "_i", F.explode(F.sequence(F.lit(1), F.col("_quota").cast("int")))
        )
        draw = F.md5(F.concat_ws("|", F.lit(str(seed)), "_lo", "_hi", "_src", "_i"))
        node = Window.partitionBy("_lo", "_hi")
        middle = F.floor((F.col("_lo") + F.col("_hi")) / 2).cast("int")
        share = F.floor(
            F.count(F.lit(1)).over(node) * (middle - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        )
        left = F.row_number().over(node.orderBy(draw, "_src", "_i")) <= share
        single = F.col("_hi") - F.col("_lo") == 1
        nodes = (
            blocks.withColumn("_left", left)
            .withColumn("_mid", middle)
            .select(
                "_src",
                F.when(single | F.col("_left"), F.col("_lo")).otherwise(F.col("_mid")).alias("_lo"),
                F.when(single | ~F.col("_left"), F.col("_hi")).otherwise(F.col("_mid")).alias("_hi"),
            )
            .groupBy("_src", "_lo", "_hi")
            .agg(F.count(F.lit(1)).alias("_quota"))
        )
        width = (width + 1) // 2
    return nodes.select("_src", F.col("_lo").alias("_shard"), "_quota")


def deal_blocks(blocks: DataFrame, quotas: DataFrame, seed: int) -> DataFrame:
    """(`_src`, `_epoch`, `_block`) with `_shard`: each shard gets its quota of permuted blocks."""
    order = Window.partitionBy("_src")
    upto = F.sum("_quota").over(order.orderBy("_shard"))
    ranges = quotas.withColumn("_upto", upto).withColumn("_from", upto - F.col("_quota"))
    draw = F.md5(F.concat_ws("|", F.lit(f"{seed}"), "_src", "_epoch", "_block"))
    placed = blocks.withColumn(
        "_place", F.row_number().over(order.orderBy(draw, "_epoch", "_block")) - 1
    )
    # At most as many ranges of a source as there are shards, and one of them holds the place.
    return (
        placed.join(ranges, "_src")
        .filter((F.col("_place") >= F.col("_from")) & (F.col("_place") < F.col("_upto")))
        .select("_src", "_epoch", "_block", "_shard")
    )


def mix(
    docs: DataFrame,
    shards: int = 8,
    weights: Sequence[int] = WEIGHTS,
    seed: int = 1,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Every document with what the mix takes of it.

    New columns: `size` (words), `source_size`, `target` (of its source, in words), `taken`
    (words, repeats counted), `copies` and `shards`, the output shard of each copy. With
    `carry` (default: all columns) other columns go along; those named like a new one are
    replaced. Documents are taken whole, up to three times. The partial epoch
    goes on past documents that do not fit until none does, so a source is short of its target
    by less than any document that the epoch has left.

    A null source is a source of its own, the last. A null or empty text has no words; it may
    lie in a drawn block, and adds nothing. Rows equal in id, source and text are drawn
    together. Ties of the digest are drawn together too. An empty table gives no rows.
    """
    made = {"size", "source_size", "target", "taken", "copies", "shards"}
    others = docs.columns if carry is None else carry
    others = [c for c in others if c.lower() not in made]
    rows = docs.select(
        F.struct(*others).alias("row"),
        source_key(F.col(source)).alias("_src"),
        document_key(F.col(doc_id), F.col(text), seed).alias("_key"),
        word_count(F.col(text)).alias("size"),
    )
    units = saved(
        rows.groupBy("_src", "_key").agg(
            F.sum("size").alias("_words"), F.count(F.lit(1)).alias("_rows")
        )
    )
    sizes = units.groupBy("_src").agg(F.sum("_words").alias("source_size"))
    targets = source_targets(sizes, weights).withColumn(
        "_epochs",
        F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)),
    )
    targets = saved(
        targets.withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    )
    ends = top_up(units, narrow(units, targets.filter("_rest > 0").select("_src", "_rest")))
    ends = go_on(units, ends)
    tops = [f"_top{i}" for i in range(TOP_UPS)]
    plan = targets.drop("_rest").join(ends.drop("_rest"), "_src", "left")
    per_epoch = 16**BLOCK_DIGITS
    last = F.when(F.col("_at") == PAST_ALL, per_epoch - 1).otherwise(
        F.conv(F.substring("_at", 1, BLOCK_DIGITS), 16, 10).cast("int")
    )
    plan = saved(plan.withColumn("_last", F.coalesce(last, F.lit(-1))))

    epochs = plan.select(
        "_src",
        F.explode(F.sequence(F.lit(0), F.lit(MAX_EPOCHS))).alias("_epoch"),
        "_epochs",
        "_last",
    ).filter((F.col("_epoch") < F.col("_epochs")) | (F.col("_epoch") == F.col("_epochs")))
    whole = F.col("_epoch") < F.col("_epochs")
    top = F.when(whole, F.lit(per_epoch - 1)).otherwise(F.col("_last"))
    blocks = (
        epochs.withColumn("_top", top)
        .filter("_top >= 0")
        .select("_src", "_epoch", F.explode(F.sequence(F.lit(0), F.col("_top"))).alias("_block"))
    )
    quotas = blocks.groupBy("_src").agg(F.count(F.lit(1)).alias("_quota"))
    dealt = deal_blocks(blocks, split_quotas(quotas, shards, seed), seed)
    by_block = saved(
        dealt.groupBy("_src", "_block").agg(
            F.map_from_entries(F.collect_list(F.struct("_epoch", "_shard"))).alias("_shards")
        )
    )
    # A top-up goes where the last block of the partial epoch goes.
    last_shard = by_block.select(
        "_src", F.col("_block").alias("_last"), F.col("_shards").alias("_last_shards")
    )
    plan = plan.join(last_shard, ["_src", "_last"], "left")
    plan = plan.withColumn("_extra", F.col("_last_shards")[F.col("_epochs").cast("int")])
    plan = saved(plan.drop("_last_shards", "_last"))

    drawn = join_small(rows, plan, ["_src"]).withColumn(
        "_block", F.conv(F.substring("_key", 1, BLOCK_DIGITS), 16, 10).cast("int")
    )
    # Rows that are a unit by themselves, nearly all, know its words.
    several = units.filter("_rows > 1").select("_src", "_key", "_words")
    drawn = join_small(drawn, several, ["_src", "_key"], "left")
    words, place = F.coalesce("_words", "size"), F.substring("_key", 1, KEY_DIGITS)
    later = F.exists(
        "_steps",
        lambda s: (place > s["after"]) & (place < s["until"]) & (words > 0) & (words <= s["most"]),
    )
    partial = F.coalesce(place < F.col("_end"), F.lit(False))
    extra = F.coalesce(F.array_contains(F.array(*tops), F.col("_key")), F.lit(False))
    partial = partial | (F.coalesce(later, F.lit(False)) & ~extra)
    drawn = join_small(drawn, by_block, ["_src", "_block"], "left")
    times = F.col("_epochs").cast("int") + F.when(partial, 1).otherwise(0)
    own = F.transform(
        F.slice(F.array(*map(F.lit, range(MAX_EPOCHS))), F.lit(1), times),
        lambda e: F.col("_shards")[e],
    )
    shards_of = F.when(extra, F.concat(own, F.array("_extra"))).otherwise(own)
    copies = F.size("shards")
    return drawn.withColumn("shards", shards_of).select(
        "row.*",
        "size",
        "source_size",
        "target",
        (copies * F.col("size")).cast("long").alias("taken"),
        copies.alias("copies"),
        "shards",
    )


def copies(
    mixed: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1
) -> DataFrame:
    """One row per copy, with its `mix_shard` and `mix_order`, shuffled inside each shard.

    Rows lie in the order (`mix_shard`, `mix_order`) over the partitions, so that each output
    shard is read front to back in its own random order, and files written from them hold that
    order (see `frames.stored_order`). The order is by a digest of the id, the text if the rows
    have it, and the number of the copy, so copies of one document are apart by chance. Rows that
    repeat an id and a text tie and stand in either order; a null id or text counts as empty.
    Documents of which nothing is taken have no row, and an empty table gives none.
    """
    n = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = mixed.select(
        *[c for c in mixed.columns if c not in ("shards", "copies", "mix_shard", "mix_order")],
        F.posexplode("shards").alias("mix_epoch", "mix_shard"),
    )
    body = F.col(text) if text in mixed.columns else F.lit("")
    blank = F.lit("")
    digest = F.md5(
        F.concat_ws(
            "|",
            F.lit(str(seed)),
            F.coalesce(F.col(doc_id).cast("string"), blank),
            F.md5(F.coalesce(body, blank)),
            "mix_epoch",
        )
    )
    rows = rows.withColumn("mix_order", digest)
    return rows.repartitionByRange(n, "mix_shard", "mix_order").sortWithinPartitions(
        "mix_shard", "mix_order"
    )
