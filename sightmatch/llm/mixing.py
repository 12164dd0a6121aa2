"""Mixing sources to target weights by Pareto order sampling, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightmatch.llm.running import number, spread_join
from sightmatch.sources.scratch import cut

#: A word: a stretch without white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Fractions of words are counted in millionths, so that sums are exact in any order.
UNIT = 1_000_000
#: A size class is looked at this many of its largest documents around its goal.
AROUND = 4


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """sources (source, source_size) with source_no and target.

    Sources by code point, null last, have the weights in turn and share the sum of all sizes.
    While a share is over `most` times its source's size, it ends there and the rest share anew.
    """
    numbered = number(sources, [], [F.col("source").asc_nulls_last()], "source_no")
    nth = F.array(*[F.lit(w) for w in weights])
    weighed = cut(
        numbered.withColumns(
            {
                "weight": F.element_at(nth, (F.pmod(F.col("source_no") - 1, len(weights)) + 1).cast("int")),
                "cap": most * F.col("source_size"),
            }
        )
    )
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        over = level * F.col("weight") > F.col("cap")
        used, mass = weighed.agg(
            F.sum(F.when(over, F.col("cap")).otherwise(0)),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))),
        ).first()
        if not mass or (total - used) / mass == level:
            break
        level = (total - used) / mass
    target = F.least(level * F.col("weight"), F.col("cap").cast("double"))
    return weighed.withColumn("target", target).drop("weight", "cap")


def _copies(rows: DataFrame, most: int) -> DataFrame:
    """rows with `copies`, the expected number of copies: a level of the source times the row's
    boost, at most `most`, the level such that the expected words are the source's target."""
    level = F.col("target") / F.col("source_size")
    levels = rows.groupBy("source_no").agg(F.lit(0.0).alias("level"))
    if "boost" not in rows.columns:
        even = F.when(F.col("source_size") > 0, level).otherwise(0.0)
        return rows.withColumn("copies", F.least(even, F.lit(float(most))))
    while True:
        leveled = spread_join(rows, levels, ["source_no"], F.col("random"))
        over = F.col("level") * F.col("boost") > most
        mass = F.floor(F.col("boost") * F.col("size") * UNIT)
        new = cut(
            leveled.groupBy("source_no")
            .agg(
                F.first("level").alias("old"),
                F.first("target").alias("target"),
                F.sum(F.when(over, most * F.col("size")).otherwise(0)).alias("used"),
                F.sum(F.when(over, 0).otherwise(mass)).alias("mass"),
            )
            .withColumn(
                "level",
                F.when(
                    F.col("mass") > 0,
                    F.greatest("old", (F.col("target") - F.col("used")) * UNIT / F.col("mass")),
                ).otherwise(F.col("old")),
            )
        )
        levels = new.select("source_no", "level")
        if new.filter("level > old").isEmpty():
            leveled = spread_join(rows, levels, ["source_no"], F.col("random"))
            expected = F.least(F.col("level") * F.col("boost"), F.lit(float(most)))
            return leveled.withColumn("copies", expected).drop("level")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    boost: Column | None = None,
) -> DataFrame:
    """One row per row of docs: doc_id, size (words), source_size, target (of the source), taken
    (words the mix takes: copies times size), copies.

    A row's expected number of copies is target / source_size, or in proportion to `boost` (positive;
    null counts as 1) where given, never above `most`. Its whole part is certain. The rest is the
    inclusion probability p of one further copy: rows rank by u / (1 - u) over p / (1 - p), with
    u from the MD5 of the id, so that runs agree, and the first ones of the order are taken. Ranks are per
    source and size class (sizes with the same number of binary digits), which keeps words near the
    target and not only numbers of documents. How many a class takes is settled from the largest class
    to the smallest: the number whose words come nearest to what is expected plus what the
    larger classes left over, among those within AROUND largest documents of the expectation.

    Groups are numbered by ranges and joined with salts, so a source may hold any share of the rows.
    A task gets at most some 20 rows per source and class besides.

    Defined cases: null and empty texts have size 0 and are never taken. A null source is a source
    and the last one. Null ids count as the text "null"; repeated ids have the same u, ties go to
    the smaller size, and rows alike in all of it are in any order. An empty table gives no rows, a
    source without words the target 0. Other columns are ignored, whatever their names.
    """
    named = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    draw = F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("long")
    picked = [
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        ((draw + 0.5) / float(1 << 52)).alias("random"),
    ]
    if boost is not None:
        picked.append(F.coalesce(boost.cast("double"), F.lit(1.0)).alias("boost"))
    rows = cut(docs.select(*picked))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(sizes, weights, most))
    rows = spread_join(rows, targets, ["source"], F.col("random")).drop("source")
    rows = _copies(rows, most)
    rows = cut(
        rows.withColumns(
            {
                "whole": F.floor("copies"),
                "part": F.col("copies") - F.floor("copies"),
                "class": F.length(F.bin("size")),
            }
        ).drop("copies")
    )
    drawn = (F.col("part") > 0) & (F.col("size") > 0)
    odds = (F.col("random") / (1 - F.col("random"))) / (F.col("part") / (1 - F.col("part")))
    ranked = cut(
        number(
            rows.filter(drawn).withColumn("rank_odds", odds),
            ["source_no", "class"],
            [F.col("rank_odds"), F.col("doc_id"), F.col("size")],
            totals={"words": "size"},
        )
    )
    taken = spread_join(ranked, _numbers(ranked), ["source_no", "class"], F.col("random"))
    columns = ["doc_id", "size", "source_size", "target"]
    copies = F.col("whole") + F.when(F.col("nth") <= F.col("takes"), 1).otherwise(0)
    return (
        taken.select(*columns, copies.alias("copies"))
        .unionAll(rows.filter(~drawn).select(*columns, F.col("whole").alias("copies")))
        .select(*columns, (F.col("copies") * F.col("size")).alias("taken"), "copies")
    )


def _numbers(ranked: DataFrame) -> DataFrame:
    """source_no, class, takes: how many of the ranked rows of each class are taken."""
    key = ["source_no", "class"]
    goals = ranked.groupBy(*key).agg(
        F.sum(F.floor(F.col("part") * F.col("size") * UNIT)).alias("goal")
    )
    window = AROUND * UNIT * F.expr("shiftleft(1L, class)")
    near = F.abs(F.col("words") * UNIT - F.col("goal")) <= window
    choices = (
        spread_join(ranked, goals, key, F.col("random"))
        .filter(near)
        .select(*key, "goal", "nth", "words")
        .unionAll(goals.select(*key, "goal", F.lit(0).cast("long"), F.lit(0).cast("long")))
    )
    classes = choices.groupBy(*key, "goal").agg(
        F.collect_list(F.struct("nth", (F.col("words") * UNIT).alias("words"))).alias("choices")
    )
    best = """array_min(transform(c.choices,
        x -> struct(abs(c.goal + acc.carry - x.words) as off, x.nth as nth, x.words as words)))"""
    fold = f"""
        aggregate(
            reverse(array_sort(collect_list(struct(class, goal, choices)))),
            named_struct('carry', 0L, 'picks', cast(array() as array<struct<class:int,takes:bigint>>)),
            (acc, c) -> transform(array({best}), b -> named_struct(
                'carry', c.goal + acc.carry - b.words,
                'picks', concat(acc.picks,
                    array(named_struct('class', c.class, 'takes', b.nth)))))[0],
            acc -> acc.picks)"""
    return (
        classes.groupBy("source_no")
        .agg(F.expr(fold).alias("picks"))
        .select("source_no", F.inline("picks"))
    )
