"""Region, palette and size literals as columns.

Strict parsers raise on a bad literal, as a query error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkframe.operators.colour import hex_rgb

#: Paper sizes in millimetres.
PAPER = {"A3": (297.0, 420.0), "A4": (210.0, 297.0), "A5": (148.0, 210.0), "A6": (105.0, 148.0), "B5": (176.0, 250.0), "LETTER": (215.9, 279.4), "LEGAL": (215.9, 355.6)}


def _fail(what: str, text: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"bad {what}: "), text))


def _option_turn(x: Column) -> Column:
    return F.regexp_extract(F.trim(x), r"(?i)^(?:rot|rotate|rotation)\s*=\s*([+-]?\d+)$", 1)


def live_region(text: Column) -> Column:
    """``name=y0,y1,x0,x1[,colour][,rot=n]``: the first four fields are numbers by
    place; a bare 3- or 6-digit colour counts only after them; the turn may be
    called rot, rotate or rotation; of repeated options the last counts."""
    num = r"\s*([+-]?\d+)\s*"
    shape = rf"^([^=]+)={num},{num},{num},{num}((?:,[^,]*)*)$"
    part = lambda i: F.regexp_extract(text, shape, i)
    rest = F.filter(F.transform(F.split(part(6), ","), lambda x: F.trim(x)), lambda x: x != "")
    colours = F.filter(rest, lambda x: x.rlike("^#") | x.rlike("^([0-9A-Fa-f]{3}|[0-9A-Fa-f]{6})$"))
    turns = F.filter(rest, lambda x: _option_turn(x) != "")
    ok = text.rlike(shape) & (F.size(rest) == F.size(colours) + F.size(turns))
    c = F.regexp_replace(F.try_element_at(colours, F.lit(-1)), "^#?", "#")
    rot = F.coalesce(_option_turn(F.try_element_at(turns, F.lit(-1))).cast("int"), F.lit(0))
    i = lambda k: F.when(text.rlike(shape), part(k)).cast("int")
    value = F.struct(F.trim(part(1)).alias("name"), i(2).alias("y0"), i(3).alias("y1"), i(4).alias("x0"), i(5).alias("x1"), c.alias("color"), rot.alias("rot"))
    return F.when(ok, value).otherwise(_fail("region", text))


def trace_region(text: Column) -> Column:
    """``name:x0,y0,x1,y1[,invert][,#colour]``: four numbers, then options in any
    order. ``invert`` may be written 1, true or yes; a colour carries its ``#``,
    so that a stray number is an error and not a colour."""
    num = r"\s*([+-]?\d+)\s*"
    shape = rf"^([^:]*):{num},{num},{num},{num}((?:,[^,]*)*)$"
    part = lambda i: F.regexp_extract(text, shape, i)
    rest = F.filter(F.transform(F.split(part(6), ","), lambda x: F.trim(x)), lambda x: x != "")
    colours = F.filter(rest, lambda x: x.rlike("^#+([0-9A-Fa-f]{3}|[0-9A-Fa-f]{6})$"))
    turned = F.filter(rest, lambda x: F.lower(x).isin("1", "true", "yes", "invert"))
    ok = text.rlike(shape) & (F.size(rest) == F.size(colours) + F.size(turned))
    i = lambda k: F.when(text.rlike(shape), part(k)).cast("int")
    fill = F.regexp_replace(F.try_element_at(colours, F.lit(-1)), "^#+", "#")
    value = F.struct(part(1).alias("name"), i(2).alias("x0"), i(3).alias("y0"), i(4).alias("x1"), i(5).alias("y1"), (F.size(turned) > 0).alias("invert"), fill.alias("fill"))
    return F.when(ok, value).otherwise(_fail("region", text))


def palette(text: Column) -> Column:
    """``colour,colour,...`` as an array of STRUCT<r,g,b>; blanks are left out."""
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x) != ""), hex_rgb)


def rectangle(text: Column) -> Column:
    """``name:x,y,w,h,colour`` in millimetres from the page's top left."""
    num = r"\s*([+-]?\d+(?:\.\d+)?)\s*"
    shape = rf"^([^:]*):{num},{num},{num},{num},\s*#*([0-9A-Fa-f]{{6}})\s*(?:,.*)?$"
    part = lambda i: F.regexp_extract(text, shape, i)
    i = lambda k: F.when(text.rlike(shape), part(k)).cast("double")
    value = F.struct(part(1).alias("name"), i(2).alias("x"), i(3).alias("y"), i(4).alias("w"), i(5).alias("h"), F.when(text.rlike(shape), hex_rgb(part(6))).alias("rgb"))
    return F.when(text.rlike(shape), value).otherwise(_fail("rectangle", text))


def page_size(text: Column) -> Column:
    """STRUCT<w,h> in millimetres of a paper's name or ``w x h``."""
    key, shape = F.upper(F.trim(text)), r"(?i)^\s*(\d+(?:\.\d+)?)\s*[x×*]\s*(\d+(?:\.\d+)?)\s*(?:mm)?\s*$"
    named = F.create_map(*[x for k, (w, h) in PAPER.items() for x in (F.lit(k), F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")))])
    num = lambda i: F.when(text.rlike(shape), F.regexp_extract(text, shape, i)).cast("double")
    sized = F.struct(num(1).alias("w"), num(2).alias("h"))
    return F.coalesce(F.try_element_at(named, key), F.when(text.rlike(shape), sized), F.when(text.isNotNull(), _fail("size", text)))


def mapping(specs: Column) -> Column:
    """An array of ``key=value`` (regions to layers, fills or replaced layers) as
    a map; of repeated keys the last counts, one without ``=`` raises."""
    cut = lambda x: F.when(F.instr(x, "=") > 0, F.split(x, "=", 2)).otherwise(_fail("mapping", x).cast("array<string>"))
    pairs = F.transform(specs, lambda x: F.struct(F.trim(cut(x)[0]).alias("key"), F.trim(cut(x)[1]).alias("value")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]))
