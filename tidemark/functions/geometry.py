"""Convex quadrangles as structs of four corners, and exact areas of overlap, without user-defined functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
CORNERS = ("tl", "tr", "bl", "br")
QUAD = "struct<" + ",".join(f"{c}:{POINT}" for c in CORNERS) + ">"


def quad(*corners) -> Column:
    """A quadrangle from four pairs of columns or numbers: upper left, upper right, lower left, lower right."""
    lit = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.struct(*[F.struct(lit(x).alias("x"), lit(y).alias("y")).alias(c) for c, (x, y) in zip(CORNERS, corners, strict=True)])


def ring(q: Column) -> Column:
    """The corners in the order in which the outline runs."""
    return F.array(q["tl"], q["tr"], q["br"], q["bl"])


def _cross(p: Column, q: Column) -> Column:
    return p["x"] * q["y"] - q["x"] * p["y"]


def signed_area(q: Column) -> Column:
    r = [q["tl"], q["tr"], q["br"], q["bl"]]
    return sum((_cross(r[i], r[(i + 1) % 4]) for i in range(1, 4)), _cross(r[0], r[1])) / 2


def area(q: Column) -> Column:
    return F.abs(signed_area(q))


def bounds(q: Column) -> Column:
    """The box around the quadrangle: left, top, right, bottom."""
    xs, ys = ([q[c][k] for c in CORNERS] for k in "xy")
    return F.struct(F.least(*xs).alias("left"), F.least(*ys).alias("top"), F.greatest(*xs).alias("right"), F.greatest(*ys).alias("bottom"))


def distance(p: Column, q: Column) -> Column:
    return F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))


def size(q: Column) -> Column:
    """Width and height: of opposite sides, cut to whole numbers, the longer."""
    side = lambda a, b: F.floor(distance(q[a], q[b]))
    return F.struct(F.greatest(side("tl", "tr"), side("bl", "br")).alias("width"), F.greatest(side("tl", "bl"), side("tr", "br")).alias("height"))


def precedes(a: Column, b: Column) -> Column:
    """Every corner of a comes before b's by x, then y. A partial order."""
    out = F.lit(True)
    for c in CORNERS:
        out = out & (a[c] < b[c])
    return out


def beyond(q: Column, width: Column, height: Column) -> Column:
    """Whether any corner is outside the frame."""
    out = F.lit(False)
    for c in CORNERS:
        out = out | (q[c]["x"] < 0) | (q[c]["x"] >= width) | (q[c]["y"] < 0) | (q[c]["y"] >= height)
    return out


def _sides(q: str) -> str:
    """SQL: the sides of a quadrangle as (p, q), counter-clockwise, without those of no length."""
    points = [f"{q}.{c}" for c in ("tl", "tr", "br", "bl")]
    chain = lambda r: "array(" + ", ".join(f"named_struct('p', {r[i]}, 'q', {r[(i + 1) % 4]})" for i in range(4)) + ")"
    return f"filter(if({_signed(q)} < 0, {chain(points[::-1])}, {chain(points)}), e -> e.p != e.q)"


def _signed(q: str) -> str:
    order = ("tl", "tr", "br", "bl")
    return "(" + " + ".join(f"({q}.{a}.x * {q}.{b}.y - {q}.{b}.x * {q}.{a}.y)" for a, b in zip(order, order[1:] + order[:1], strict=True)) + ") / 2"


def _inside(sides: str, others: str, second: str) -> str:
    """SQL: sum over the parts of the sides inside the other polygon of half the cross product of their ends."""
    dx, dy = "(c.q.x - c.p.x)", "(c.q.y - c.p.y)"
    from_c = lambda k: f"{dx} * (e.{k}.y - c.p.y) - {dy} * (e.{k}.x - c.p.x)"
    against = f"named_struct('d0', {from_c('p')}, 'd1', {from_c('q')}, 'along', (e.q.x - e.p.x) * {dx} + (e.q.y - e.p.y) * {dy})"
    on = "d.d0 = 0 and d.d1 = 0"
    step = (
        "named_struct('t0', if(d.d0 < 0 and d.d1 > d.d0, greatest(s.t0, d.d0 / (d.d0 - d.d1)), s.t0), 't1', if(d.d1 < 0 and d.d0 > d.d1, least(s.t1, d.d0 / (d.d0 - d.d1)), s.t1), "
        f"'gone', s.gone or (d.d0 <= 0 and d.d1 <= 0 and not ({on})) or ({on} and ({second} or d.along < 0)))"
    )
    at = lambda k, t: f"(e.p.{k} + s.{t} * (e.q.{k} - e.p.{k}))"
    measure = f"if(not s.gone and s.t1 > s.t0, ({at('x', 't0')} * {at('y', 't1')} - {at('x', 't1')} * {at('y', 't0')}) / 2, 0D)"
    part = f"aggregate(transform({others}, c -> {against}), named_struct('t0', 0D, 't1', 1D, 'gone', false), (s, d) -> {step}, s -> {measure})"
    return f"aggregate(transform({sides}, e -> {part}), 0D, (s, x) -> s + x)"


def overlap(a: str, b: str) -> Column:
    """Area that two convex quadrangles, given by name, share: a boundary integral over the clipped sides of both.

    Shared borders count once, and a quadrangle without area shares nothing. The sides are made once, as the variable of a
    function over an array of one element.
    """
    whole = f"transform(array(named_struct('a', {_sides(a)}, 'b', {_sides(b)})), v -> {_inside('v.a', 'v.b', 'false')} + {_inside('v.b', 'v.a', 'true')})[0]"
    return F.expr(f"if({_signed(a)} = 0 or {_signed(b)} = 0, 0D, {whole})")


def union_area(a: str, b: str) -> Column:
    return area(F.col(a)) + area(F.col(b)) - overlap(a, b)


def jaccard(a: str, b: str) -> Column:
    both = area(F.col(a)) + area(F.col(b))
    return F.get(F.transform(F.array(overlap(a, b)), lambda s: s / (both - s)), F.lit(0))


def middle(p: Column, q: Column) -> Column:
    return F.struct(((p["x"] + q["x"]) / 2).alias("x"), ((p["y"] + q["y"]) / 2).alias("y"))


def ratio_split(q: Column, bound: float = 0.7) -> Column:
    """The quadrangle itself if its height is more than bound times its width, else its left and right halves."""
    shape, top, bottom = size(q), middle(q["tl"], q["tr"]), middle(q["bl"], q["br"])
    half = lambda tl, tr, bl, br: F.struct(tl.alias("tl"), tr.alias("tr"), bl.alias("bl"), br.alias("br"))
    return F.when(shape["height"] / shape["width"] > bound, F.array(half(*[q[c] for c in CORNERS]))).otherwise(F.array(half(q["tl"], top, q["bl"], bottom), half(top, q["tr"], bottom, q["br"])))


def assign_corners(points: Column) -> Column:
    """A quadrangle from four points in any order, the first winning ties; a point may serve twice."""
    top, right = F.array_max(F.transform(points, lambda p: p["y"])), F.array_max(F.transform(points, lambda p: p["x"]))

    def best(score, sign: int) -> Column:
        ranked = F.transform(points, lambda p, i: F.struct((score(p) * sign).alias("s"), i.alias("i"), p.alias("p")))
        return F.array_min(ranked)["p"]

    return F.struct(
        best(lambda p: p["x"] + p["y"], 1).alias("tl"), best(lambda p: top - p["y"] + p["x"], -1).alias("tr"),
        best(lambda p: right - p["x"] + p["y"], -1).alias("bl"), best(lambda p: p["x"] + p["y"], -1).alias("br"),
    )
