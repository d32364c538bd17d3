"""Mixing sources to target weights along a time-varying curriculum (DataFrame operations only).

The mix holds as many words as all documents together. Sources in code-point order (null last) get
the weights of a repeating list; a source is repeated at most `most_repeats` times, and what it
cannot give is shared out among the others by weight. This water level is found in closed form:
with sources sorted by capacity over weight, running sums give the level at which the first k
sources are full, and the first k whose level fits is the answer.

Each source's documents lie on a line in an order that a hash of their id and text gives. The mix
reads each line from its beginning, again and again, until the target is met, so a document is
taken `repeats` times whole and at most one document per source is taken in part.

The weight of a source over the time of training, t from 0 to 1, is target * (1 + tilt * (2t - 1)).
Its integral target * ((1 - tilt) * t + tilt * t^2) is the cumulative demand for its words; inverting
it at a word's place on the source's (repeated) line gives the time at which that word is trained
on. Documents are range-sorted by the position (time times all words) of their first word.

Running sums along a line are taken in two steps, over parts by hash prefix and within a
part, so that no source is sorted in one task.

Defined results: null texts have size 0; sizes of 0 are taken 0 times and have a null position, and
sort last; null sources are one source; equal rows are separate rows (identical ones may
swap places); an empty table gives an empty table; input columns named like result columns are
replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layerstack.llm.common import WORD, without

#: A word with the white space before it.
SPACED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"

WEIGHTS = (5.0, 2.0, 1.0)
#: Sources in turn are trained on rather late, evenly, rather early.
TILTS = (0.5, 0.0, -0.5)
MOST_REPEATS = 3
#: Hex digits of the hash that name a part of a source's line: 3 for 4,096 parts.
PART_DIGITS = 3

ADDED = (
    "size", "source_size", "target", "taken", "line_start", "copies", "tilt", "total", "position",
)


def n_words(text):
    """Number of words of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    tilts: Sequence[float] = TILTS,
    most_repeats: int = MOST_REPEATS,
) -> DataFrame:
    """Targets of sources, from one row per source (source, source_size)."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1).alias("turn")
    pick = lambda values: F.element_at(
        F.array(*[F.lit(float(v)) for v in values]), (F.col("turn") % len(values) + 1).cast("int")
    )
    s = sizes.select("source", "source_size", turn)
    s = s.withColumns(
        {
            "weight": pick(weights),
            "tilt": pick(tilts),
            "capacity": F.col("source_size").cast("double") * most_repeats,
        }
    ).withColumn("fills_at", F.col("capacity") / F.col("weight"))
    before = (
        Window.orderBy("fills_at", F.col("source").asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    s = s.withColumns(
        {
            "full": F.coalesce(F.sum("capacity").over(before), F.lit(0.0)),
            "open": F.sum("weight").over(everything)
            - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
            "total": F.sum("source_size").over(everything).cast("double"),
        }
    ).withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    fits = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "turn", "level")))
    s = s.withColumn("water", fits.over(everything)["level"])
    target = F.least(F.col("capacity"), F.col("weight") * F.col("water"))
    return s.select(
        "source", "source_size", "weight", "tilt", target.alias("target"), "total"
    )


def mix(
    df: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: Sequence[float] = WEIGHTS,
    tilts: Sequence[float] = TILTS,
    most_repeats: int = MOST_REPEATS,
    ordered: bool = True,
) -> DataFrame:
    """All documents with their place in the mix, range-sorted by training position if ordered.

    Adds size, source_size, target (its source's), taken (words, repeats counted), line_start (its
    first word's place on its source's line), copies (times it is read, in part or whole), tilt,
    total (words of all documents) and position.
    """
    key = F.md5(
        F.concat_ws(
            "|",
            F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")),
            F.coalesce(F.md5(F.col(f"`{text}`").cast("binary")), F.lit("")),
        ).cast("binary")
    )
    docs = without(df, *ADDED, "_key", "_part", "_source").withColumns(
        {
            "size": n_words(F.col(f"`{text}`")),
            "_key": key,
            "_part": F.substring(key, 1, PART_DIGITS),
            "_source": F.col(f"`{source}`"),
        }
    )
    # One scan of the sizes feeds both the sources' totals and the parts of their lines.
    parts = docs.groupBy("_source", "_part").agg(F.sum("size").alias("part_size"))
    totals = parts.groupBy(F.col("_source").alias("source")).agg(
        F.sum("part_size").alias("source_size")
    )
    targets = source_targets(totals, weights, tilts, most_repeats)
    ahead = (
        Window.partitionBy("_source").orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = parts.select(
        F.col("_source").alias("p_source"),
        F.col("_part").alias("p_part"),
        F.coalesce(F.sum("part_size").over(ahead), F.lit(0)).alias("part_start"),
    )
    starts = starts.join(targets, F.expr("p_source <=> source"), "left").drop("source")
    within = (
        Window.partitionBy("_source", "_part").orderBy("_key")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    docs = docs.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = docs.join(
        starts, F.expr("_source <=> p_source AND _part = p_part"), "left"
    ).withColumn("line_start", F.col("part_start") + F.col("_before"))
    wanted = F.round("target").cast("long")
    whole = F.expr("CAST(round(target) AS BIGINT) DIV greatest(source_size, 1)")
    rest = wanted - whole * F.col("source_size")
    more = F.least(F.greatest(rest - F.col("line_start"), F.lit(0)), F.col("size"))
    placed = placed.withColumn("taken", (whole * F.col("size") + more).cast("long")).withColumn(
        "copies",
        F.when(F.col("size") == 0, 0).otherwise(whole + (more > 0).cast("long")).cast("int"),
    )
    placed = placed.withColumn("position", training_position(F.col("line_start")))
    out = placed.select(*[f"`{c}`" for c in without(df, *ADDED).columns], *ADDED)
    if not ordered:
        return out
    return out.orderBy(F.col("position").asc_nulls_last(), F.col(f"`{doc_id}`"))


def training_position(word):
    """Where in the training the word at this place of the source's line is read.

    Needs the columns target, tilt, copies and total of `mix`. Null where nothing of the document
    is taken.
    """
    y = word / F.nullif(F.col("target"), F.lit(0.0))
    slope = 1 - F.col("tilt")
    root = F.sqrt(slope * slope + 4 * F.col("tilt") * y)
    # The root form without cancellation: 2y / (slope + root); it also holds for a tilt of 0.
    t = F.when(y <= 0, F.lit(0.0)).otherwise(2 * y / (slope + root))
    return F.when(F.col("copies") > 0, F.least(t, F.lit(1.0)) * F.col("total"))


def expand(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The rows to train on: one per reading of a document, in order of their own positions.

    The last reading of a document that is taken in part is cut behind the words taken, white
    space kept. Documents that are not taken go.
    """
    readings = mixed.where("copies > 0").withColumn(
        "reading", F.explode(F.sequence(F.lit(1), F.col("copies")))
    )
    line = F.col("line_start") + (F.col("reading") - 1) * F.col("source_size")
    left = F.col("taken") - (F.col("reading") - 1) * F.col("size")
    words = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(SPACED_WORD), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), left.cast("int")), "")
    return readings.withColumns(
        {
            "position": training_position(line),
            text: F.when(left < F.col("size"), cut).otherwise(F.col(f"`{text}`")),
        }
    ).orderBy("position")
