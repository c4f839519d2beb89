"""Geometry of the rink in feet: along towards the target net (goal line at 89), across to the right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTH_M, WIDTH_M, FOOT = 60.96, 25.92, 0.3048


def to_feet(x: Column, y: Column) -> tuple[Column, Column]:
    """Metres of an acting team's frame to feet from centre ice."""
    return x / FOOT - 100, WIDTH_M / 2 / FOOT - y / FOOT


def turned(x: Column, y: Column) -> tuple[Column, Column]:
    """The same place in the other team's frame (metres)."""
    return LENGTH_M - x, WIDTH_M - y


def shot_zone(along: Column, across: Column) -> Column:
    """One of seven zones; the order of the cases counts."""
    out, wide = 89 - along, F.abs(across)
    blue = F.when(wide < 16, "BlueLineCenter").when(across < 0, "BlueLineLeft").otherwise("BlueLineRight")
    return (
        F.when(out >= 37, blue).when((out >= 0) & (out < 18) & (wide < 0.6 * out + 5), "Slot")
        .when((out >= 0) & (wide < 0.8 * out + 4.5), "Center").when(across < 0, "LeftFlank").otherwise("RightFlank")
    )


def battle_area(along: Column, across: Column) -> Column:
    """One of nine areas from the own end to the other's."""
    near = F.abs(across) <= 9
    return (
        F.when(along < -92, "BehindOwnGoal").when(along < -69, F.when(near, "OwnSlot").otherwise("OwnCorners")).when(along < -25, "OwnBlueLine")
        .when(along <= 25, "NeutralZone").when(along <= 69, "OppBlueLine").when(along <= 92, F.when(near, "OppSlot").otherwise("OppCorners")).otherwise("BehindOppGoal")
    )


def distance(along: Column, across: Column) -> Column:
    """Feet to the net, three at least."""
    return F.greatest(F.hypot(89 - along, across), F.lit(3.0))


def angle(along: Column, across: Column) -> Column:
    return F.atan2(F.abs(across), 89 - along)


def period_of(seconds: Column) -> Column:
    return (F.floor(F.greatest(seconds, F.lit(0)) / 1200) + 1).cast("int")


def contested(x: Column, y: Column, won: Column) -> tuple[Column, Column]:
    """Feet of a contested action in the acting team's frame: such rows are in the winner's, so a loser's place is turned."""
    tx, ty = turned(x, y)
    return to_feet(F.when(won, x).otherwise(tx), F.when(won, y).otherwise(ty))


def shot_features(along: Column, across: Column) -> Column:
    """The intercept, log distance and angle of a shot."""
    return F.array(F.lit(1.0), F.ln(distance(along, across)), angle(along, across))
