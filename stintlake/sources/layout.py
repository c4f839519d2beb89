"""Printed pages as tables of positioned words: lines, phrases, columns, cells, and the tables and diagrams made of them.

All functions take ``words``: page keys, ``text, x0, x1, top, bottom`` in points, and work on every page at once. Lines are an
ordered fold (a line is as high as its first word, not its last), one pass over sorted words; everything else is joins and
windows, but for the stacking of a page's few header phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words whose middles lie this near to a line's are on it; phrases are words this near; columns begin this much to the left.
LINE_TOLERANCE, PHRASE_GAP, COLUMN_SLACK, STACKED = 2.0, 2.0, 3.0, 2.0


def with_lines(words: DataFrame, page: list[str], tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """words with ``line`` (from 0, downwards), ``y`` of the line's first word and ``at``, the word's place in it from the left.

    Words come sorted by page and height, and one pass numbers the lines: only the height of the current line's first word is
    kept, so a page of any length passes through.
    """
    width, names, kinds = len(page), words.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, line, first = None, 0, 0.0
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(width))))
            lines, heights = [], []
            for key, y in zip(keys, batch.column(batch.num_columns - 1).to_pylist()):
                if key != now:
                    now, line, first = key, 0, y
                elif y - first > tolerance:
                    line, first = line + 1, y
                lines.append(line)
                heights.append(first)
            yield pa.RecordBatch.from_arrays([*batch.columns[width:-1], pa.array(lines, pa.int32()), pa.array(heights, pa.float64())], names=[*names, "line", "y"])

    middle = (F.col("top") + F.col("bottom")) / 2
    keyed = words.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(page)], *words.columns, middle.alias("_y"))
    ordered = keyed.repartition(*[f"_p{i}" for i in range(width)]).sortWithinPartitions(*[f"_p{i}" for i in range(width)], "_y", "x0")
    lined = ordered.mapInArrow(run, f"{kinds}, line int, y double")
    return lined.withColumn("at", F.row_number().over(Window.partitionBy(*page, "line").orderBy("x0", "x1", "text")))


def words_in(words: DataFrame, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    """Words that begin in [x0, x1) with their middle in [y0, y1)."""
    middle = (F.col("top") + F.col("bottom")) / 2
    return words.filter((F.col("x0") >= x0) & (F.col("x0") < x1) & (middle >= y0) & (middle < y1))


def joined_text(order: str = "at") -> Column:
    """The words of a group from left to right, with spaces."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda w: w["text"]), " ")


def text_between(lines: DataFrame, page: list[str], x0: float, x1: float) -> DataFrame:
    """``page, line, text`` of the words of each line that begin in [x0, x1)."""
    return lines.filter((F.col("x0") >= x0) & (F.col("x0") < x1)).groupBy(*page, "line").agg(joined_text().alias("text"))


def find_phrase(lines: DataFrame, page: list[str], phrase: str) -> DataFrame:
    """``page, line, x0`` of the first place in each line where the phrase's words follow one another."""
    parts = phrase.split()
    w = Window.partitionBy(*page, "line").orderBy("at")
    hit = F.col("text") == parts[0]
    for i, p in enumerate(parts[1:], 1):
        hit = hit & (F.lead("text", i).over(w) == p)
    return lines.withColumn("_hit", hit).filter("_hit").groupBy(*page, "line").agg(F.min_by("x0", "at").alias("x0"))


def phrases(lines: DataFrame, page: list[str], gap: float = PHRASE_GAP) -> DataFrame:
    """``page, line, x, name``: words of a line that lie at most ``gap`` apart, as one phrase."""
    w = Window.partitionBy(*page, "line").orderBy("at")
    fresh = F.when(F.col("x0") - F.lag("x1").over(w) <= gap, 0).otherwise(1)
    p = lines.withColumn("_f", fresh).withColumn("_p", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return p.groupBy(*page, "line", "_p").agg(F.min("x0").alias("x"), joined_text().alias("name")).drop("_p")


def header_columns(lines: DataFrame, page: list[str], gap: float = PHRASE_GAP) -> DataFrame:
    """``page, x, name, end``: phrases that begin at nearly the same x on several header lines are one column; end is where the next
    begins (null for the last). A column is where its first phrase is."""
    p = phrases(lines, page, gap)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[list] = []
        for x, name in pdf.sort_values(["line", "x"])[["x", "name"]].itertuples(index=False):
            column = next((c for c in found if abs(c[0] - x) < STACKED), None)
            if column is None:
                found.append([x, name])
            else:
                column[1] += " " + name
        out = pd.DataFrame(sorted(found), columns=["x", "name"])
        return out.assign(**{k: pdf[k].iloc[0] for k in page})[[*page, "x", "name"]]

    kinds = ", ".join(f"`{k}` {lines.schema[k].dataType.simpleString()}" for k in page)
    columns = p.groupBy(*page).applyInPandas(run, f"{kinds}, x double, name string")
    return columns.withColumn("end", F.lead("x").over(Window.partitionBy(*page).orderBy("x")))


def cells(lines: DataFrame, columns: DataFrame, page: list[str], slack: float = COLUMN_SLACK, right: float = 1e9) -> DataFrame:
    """``page, line, name, text``: the words of each line by the column in which they begin."""
    c = columns.select(*page, F.col("x").alias("_x"), F.coalesce(F.col("end") - slack, F.lit(right)).alias("_end"), "name")
    inside = (F.col("x0") >= F.col("_x") - slack) & (F.col("x0") < F.col("_end"))
    return lines.join(c, page).filter(inside).groupBy(*page, "line", "name").agg(joined_text().alias("text"))


def row_label(text: Column) -> Column:
    """struct(number, surname) of "18 Taylor" or "Taylor"; null for what begins with neither a number and a letter nor a letter."""
    number = F.regexp_extract(F.trim(text), r"^(\d+) +\p{L}", 1)
    surname = F.trim(F.regexp_replace(F.trim(text), r"^\d+ +", ""))
    return F.when(surname.rlike(r"^\p{L}"), F.struct(F.nullif(number, F.lit("")).cast("int").alias("number"), surname.alias("surname")))


def members(text: Column) -> Column:
    """array of struct(number, surname) of "21 Brooks 18 Van Horn": a number begins a player, the words after it are the surname."""
    each = F.regexp_extract_all(text, F.lit(r"(?:^|\s)(\d+(?:\s+(?!\d+(?:\s|$))\S+)+)"))
    return F.transform(each, lambda m: F.struct(F.regexp_extract(m, r"^(\d+)", 1).cast("int").alias("number"), F.regexp_replace(F.regexp_replace(m, r"^\d+\s+", ""), r"\s+", " ").alias("surname")))


def player_table(words: DataFrame, page: list[str], x0: float, x1: float, title_y: float) -> DataFrame:
    """``page, line, label, name, text`` of a table below a title: rows begin with a number at the left edge; lines between the title
    and the first row are its header; the first other line ends it."""
    region = words_in(words, x0, x1, title_y + 1.0, 1e9)
    lines = with_lines(region, page)
    number = F.col("text").rlike(r"^\d{1,5}$")
    left = F.min(F.when(number, F.col("x0"))).over(Window.partitionBy(*page))
    first = F.max((F.col("at") == 1) & number & (F.abs(F.col("x0") - left) < 1.0))
    lines = lines.withColumn("label_x", left)
    marked = lines.withColumn("is_row", F.coalesce(first.over(Window.partitionBy(*page, "line")), F.lit(False)))
    w = Window.partitionBy(*page)
    marked = marked.withColumn("first_row", F.min(F.when(F.col("is_row"), F.col("line"))).over(w))
    marked = marked.withColumn("stop", F.min(F.when(~F.col("is_row") & (F.col("line") > F.col("first_row")), F.col("line"))).over(w))
    head = marked.filter((F.col("line") < F.col("first_row")) & (F.col("x0") > F.col("label_x") + 30))
    columns = header_columns(head, page)
    rows = marked.filter(F.col("is_row") & (F.col("line") >= F.col("first_row")) & (F.col("stop").isNull() | (F.col("line") < F.col("stop"))))
    starts = columns.groupBy(*page).agg(F.min("x").alias("first_x"))
    label = rows.join(starts, page).filter((F.col("x0") >= F.col("label_x") - 1) & (F.col("x0") < F.col("first_x") - COLUMN_SLACK)).groupBy(*page, "line").agg(joined_text().alias("label"))
    return cells(rows, columns, page, right=x1).join(label, [*page, "line"]).select(*page, "line", "label", "name", "text")


def cover(lines: DataFrame, page: list[str]) -> DataFrame:
    """``page, team_a, goals_a, goals_b, team_b, day`` of a report's cover: the first line with a score "3:2" between two names, and
    the first line below it that begins with a date."""
    score = F.regexp_extract("text", r"^(\d+):(\d+)$", 1) != ""
    first = lines.filter(score).groupBy(*page).agg(F.min(F.struct("line", "at", "text")).alias("s"))
    on = lines.join(first, page).filter(F.col("line") == F.col("s.line"))
    side = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("at", "text")))), lambda w: w["text"]), " ")
    teams = on.groupBy(*page, "s").agg(F.upper(side(F.col("at") < F.col("s.at"))).alias("team_a"), F.upper(side(F.col("at") > F.col("s.at"))).alias("team_b"))
    dated = lines.filter("at = 1").withColumn("day", F.try_to_date(F.regexp_replace("text", r"\.$", ""), "dd.MM.yyyy")).filter("day is not null")
    days = dated.join(first, page).filter(F.col("line") > F.col("s.line")).groupBy(*page).agg(F.min_by("day", "line").alias("day"))
    goals = F.split("s.text", ":")
    return teams.join(days, page).select(*page, "team_a", goals[0].cast("int").alias("goals_a"), goals[1].cast("int").alias("goals_b"), "team_b", "day")


def grid(counts: DataFrame, keys: list[str], kind: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """``keys, area, value`` of a diagram's printed counts (x, y, value): nine of a net by rows, or seven of a rink's zones, of which the
    three lowest are the blue line, the outermost of the others the flanks, and the higher of the middle two the slot. Diagrams
    with another number of counts give no rows. Of counts at one place that comes first which is first by ``ties``."""
    n = F.count("*").over(Window.partitionBy(*keys))
    down = F.row_number().over(Window.partitionBy(*keys).orderBy("y", "x", *ties))
    c = counts.withColumn("n", n).withColumn("down", down)
    if kind == "net":
        c = c.filter("n = 9").withColumn("row", F.floor((F.col("down") - 1) / 3).cast("int"))
        across = F.row_number().over(Window.partitionBy(*keys, "row").orderBy("x", "down"))
        names = F.array(*[F.lit(f"{v}{h}") for v in ("Top", "Middle", "Bottom") for h in ("Left", "", "Right")])
        return c.withColumn("i", across).select(*keys, F.get(names, F.col("row") * 3 + F.col("i") - 1).alias("area"), "value")
    c = c.filter("n = 7").withColumn("upper", F.col("down") <= 4)
    c = c.withColumn("i", F.row_number().over(Window.partitionBy(*keys, "upper").orderBy("x", "down")))
    middle = F.col("upper") & F.col("i").isin(2, 3)
    high = F.row_number().over(Window.partitionBy(*keys, middle).orderBy("y", "i"))
    area = (
        F.when(middle, F.when(high == 1, "Slot").otherwise("Center")).when(F.col("upper"), F.when(F.col("i") == 1, "LeftFlank").otherwise("RightFlank"))
        .otherwise(F.get(F.array(F.lit("BlueLineLeft"), F.lit("BlueLineCenter"), F.lit("BlueLineRight")), F.col("i") - 1))
    )
    return c.select(*keys, area.alias("area"), "value")


def nearest_row(words: DataFrame, dates: DataFrame, page: list[str], most: float = 7.0) -> DataFrame:
    """``page, row, text``: the words (x0, y, text) of each dated row (row, y): those nearer to it than to the rows above and below, and
    under ``most`` points away; of two equally near rows the lower one. Words and rows meet in one ordered stream."""
    w = words.select(*page, "y", "x0", "text", F.lit(None).cast(dates.schema["row"].dataType).alias("row"), F.lit(1).alias("side"))
    d = dates.select(*page, "y", F.lit(None).cast("double").alias("x0"), F.lit(None).cast("string").alias("text"), "row", F.lit(0).alias("side"))
    both = w.unionByName(d)
    here = F.when(F.col("side") == 0, F.struct("y", "row"))
    order = Window.partitionBy(*page).orderBy("y", "side")
    up = F.last(here, True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    down = F.first(here, True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    m = both.withColumn("up", up).withColumn("down", down).filter("side = 1")
    to_up, to_down = F.col("y") - F.col("up.y"), F.col("down.y") - F.col("y")
    lower = F.col("up").isNull() | (to_down <= to_up)
    m = m.withColumn("row", F.when(F.coalesce(lower, F.lit(False)) & (to_down < most), F.col("down.row")).when(~F.coalesce(lower, F.lit(False)) & (to_up < most), F.col("up.row")))
    return m.filter("row is not null").groupBy(*page, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x0", "text"))), lambda v: v["text"]), " ").alias("text"))
