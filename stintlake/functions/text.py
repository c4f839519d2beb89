"""Names, slugs, report cells and file titles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_name(x: Column) -> Column:
    """Upper case with single spaces."""
    return F.regexp_replace(F.upper(F.trim(x)), r"\s+", " ")


def name_key(x: Column) -> Column:
    """The words of a name in upper case, sorted: the order of first and last name doesn't matter."""
    return F.array_join(F.array_sort(F.split(normalise_name(x), " ")), " ")


def player_id(team: Column, name: Column) -> Column:
    return F.concat_ws("|", normalise_name(team), name_key(name))


def slug(x: Column) -> Column:
    """Lower-case letters and digits, a hyphen for anything else."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "-")


def display_name(x: Column) -> Column:
    """The last word in front: surname-first names as they are spoken."""
    words = F.split(normalise_name(x), " ")
    n = F.size(words)
    return F.when(n > 1, F.concat_ws(" ", F.element_at(words, -1), F.array_join(F.slice(words, 1, n - 1), " "))).otherwise(F.element_at(words, 1))


def surname(x: Column) -> Column:
    return F.element_at(F.split(normalise_name(x), " "), 1)


def title_parts(path: Column) -> Column:
    """struct(team_a, goals_a, goals_b, team_b, day) of a file name ``A gA _ gB B dd.mm.yyyy[-2][ (n)].csv``; null parts if it has another form."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.(csv|CSV)$", "")
    name = F.regexp_replace(name, r" \(\d+\)$", "")
    pattern = r"^(.+) (\d+) _ (\d+) (.+) (\d{2}\.\d{2}\.\d{4})[^ ]*$"
    part = [F.nullif(F.regexp_extract(name, pattern, i), F.lit("")) for i in range(1, 6)]
    return F.struct(normalise_name(part[0]).alias("team_a"), part[1].cast("int").alias("goals_a"), part[2].cast("int").alias("goals_b"), normalise_name(part[3]).alias("team_b"), F.try_to_date(part[4], "dd.MM.yyyy").alias("day"))


#: The forms of a printed cell with n for each number: kind, and how many of the numbers are parts besides those read as a whole.
CELLS = {
    "n": ("Int", 1), "+n": ("Int", 1), "-n": ("Int", 1), "n.n": ("Decimal", 0), "+n.n": ("Decimal", 0), "-n.n": ("Decimal", 0),
    "n%": ("Percent", 0), "+n%": ("Percent", 0), "-n%": ("Percent", 0), "n.n%": ("Percent", 0), "+n.n%": ("Percent", 0), "-n.n%": ("Percent", 0),
    "n:n": ("Clock", 0), "n/n": ("Ratio", 2), "n/n n%": ("Ratio", 2), "n/n/n": ("Triple", 3), "n n%": ("CountShare", 2), "n:n n%": ("ClockShare", 0), "n-n": ("Pair", 2),
}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cell(x: Column) -> Column:
    """struct(kind, a, b, c) of a printed report cell: empty, whole and decimal numbers, percentages, clocks, ratios, triples,
    pairs; else text. The cell's skeleton (every number as 0, no spaces around signs) is looked up once; only then are numbers read."""
    forms = F.create_map(*[F.lit(v) for k, f in CELLS.items() for v in (k.replace("n", "0"), f[0])])
    several = ("Ratio", "Triple", "CountShare", "Pair")

    def read(t: Column) -> Column:
        skeleton = F.regexp_replace(F.regexp_replace(t, r"\d+", "0"), "(?<=0) ?([/-]) ?(?=0)", "$1")
        numbers = F.transform(F.regexp_extract_all(t, F.lit(r"(\d+)")), lambda n: n.try_cast("double"))
        long_minutes = F.regexp_like(t, F.lit(r"^[+-]?\d+:\d\d(?!\d)"))
        return bound(F.struct(F.try_element_at(forms, skeleton).alias("form"), numbers.alias("n"), long_minutes.alias("clock")), lambda p: typed(t, p))

    def typed(t: Column, p: Column) -> Column:
        clock = p["form"].isin("Clock", "ClockShare")
        kind = F.when((t == "") | (t == "-"), "Empty").when(clock & ~p["clock"], "Text").otherwise(F.coalesce(p["form"], F.lit("Text")))
        return bound(kind, lambda k: valued(t, p["n"], k))

    def valued(t: Column, n: Column, k: Column) -> Column:
        part = lambda i: F.get(n, F.lit(i))
        decimal = F.regexp_extract(t, r"^[+-]?(\d+(?:\.\d+)?)", 1).try_cast("double") * F.when(t.startswith("-"), -1.0).otherwise(1.0)
        a = F.when(k.isin("Decimal", "Percent", "Int"), decimal).when(k.isin("Clock", "ClockShare"), part(0) * 60 + part(1)).when(k.isin(*several), part(0))
        b = F.when(k.isin(*several), part(1)).when(k == "ClockShare", part(2))
        return F.struct(k.alias("kind"), a.alias("a"), b.alias("b"), F.when(k == "Triple", part(2)).alias("c"))

    return bound(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), "[—–]", "-")), read)


def cell_number(c: Column) -> Column:
    """The main number of a cell: its first part, 0 for an empty one, null for text."""
    return F.when(c["kind"] == "Empty", 0.0).when(c["kind"] != "Text", c["a"])


def cell_as(c: Column, what: str) -> Column:
    """A cell read as a count, signed, seconds, decimal, percent (numbers) or a ratio, pair, triple (first parts); null if it is of
    another kind. Empty cells count as 0, but have no percent: that is printed where the base is zero."""
    kinds = {
        "count": ("Int", "CountShare"), "signed": ("Int",), "seconds": ("Clock", "ClockShare"), "decimal": ("Decimal", "Int"),
        "ratio": ("Ratio",), "pair": ("Pair",), "triple": ("Triple",), "percent": ("Percent", "CountShare", "ClockShare"),
    }[what]
    if what == "percent":
        return F.when(c["kind"] == "Percent", c["a"]).when(c["kind"].isin("CountShare", "ClockShare"), c["b"])
    value = F.when((c["kind"] == "Int") & (c["a"] < 0) & F.lit(what == "count"), None).otherwise(c["a"])
    return F.when(c["kind"] == "Empty", 0.0).when(c["kind"].isin(*kinds), value)


def title_case(x: Column) -> Column:
    """Words with a capital and small letters, single spaces."""
    return F.initcap(F.lower(normalise_name(x)))


def infer_year(day: Column, month: Column, reference: Column) -> Column:
    """The last date of a printed day and month that is at most one day after ``reference``."""
    this = F.make_date(F.year(reference), month, day)
    return F.when(F.datediff(this, reference) <= 1, this).otherwise(F.make_date(F.year(reference) - 1, month, day))


def percent_decode(x: Column) -> Column:
    """Text with %XX escapes as UTF-8; null where an escape is broken. A plus sign stays."""
    return F.when(~x.rlike("%(?![0-9A-Fa-f]{2})"), F.try_url_decode(F.regexp_replace(x, r"\+", "%2B")))


def probability_words(p: Column) -> Column:
    """How a chance of being above average is put into words."""
    return (
        F.when(p.isNull(), "-").when(p >= 0.9, "very likely above average").when(p >= 0.75, "probably above average")
        .when(p <= 0.1, "very likely below average").when(p <= 0.25, "probably below average").otherwise("can't tell yet")
    )


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th."""
    teen = (n % 100).between(11, 13)
    return F.concat(n.cast("string"), F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th"))


def video_ms(x: Column) -> Column:
    """A time literal in seconds, of three decimals at most, as whole milliseconds; null for another form."""
    return F.when(F.trim(x).rlike(r"^-?\d+(\.\d{1,3})?$"), (F.trim(x).try_cast("decimal(18,3)") * 1000).cast("long"))
