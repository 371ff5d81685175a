"""Text widths, wrapping, fitting and appearance streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from quire.functions.glyphs import FAMILIES

#: Width of a character, in ems, where a font doesn't say.
FALLBACK = 0.6


def plain_widths() -> dict[str, float]:
    """A simple font's widths for the printable ASCII characters, in thousandths of an em."""
    kind = lambda c: 250.0 if c == " " else 750.0 if c.isupper() else 500.0 if c.islower() else 600.0 if c.isdigit() else 400.0
    return {chr(i): kind(chr(i)) for i in range(32, 127)}


def text_width(text: Column, widths: dict[str, float], size: float, other: float | None = 400.0) -> Column:
    """The width of a text in a font size: counts of the characters of each width, times that width. No UDF."""
    by: dict[float, str] = {}
    for c, w in widths.items():
        by[w] = by.get(w, "") + c
    total, known = F.lit(0.0), "".join(widths)
    for width, chars in by.items():
        count = F.length(text) - F.length(F.translate(text, chars, ""))
        total = total + count * width
    rest = F.length(F.translate(text, known, ""))
    return (total + rest * (FALLBACK * 1000 if other is None else other)) * size / 1000.0


def width_of(text: str, widths: dict[str, float], size: float) -> float:
    return sum(widths.get(c, FALLBACK * 1000) for c in text) * size / 1000


def broken(word: str, most: float, widths: dict[str, float], size: float) -> list[str]:
    """A word in pieces no wider than ``most``, a character at the least."""
    pieces = [""]
    for c in word:
        if pieces[-1] and width_of(pieces[-1] + c, widths, size) > most:
            pieces.append("")
        pieces[-1] += c
    return pieces


def wrapped(text: str, most: float, widths: dict[str, float], size: float) -> list[str]:
    """Lines no wider than ``most``: a paragraph that fits is a line as it is, of others words are taken as long as they fit.

    A word too wide for a line is broken between characters if it begins one; after another word it goes to the next line whole, and stays so.
    """
    lines: list[str] = []
    for paragraph in text.split("\n"):
        if width_of(paragraph, widths, size) <= most:
            lines.append(paragraph)
            continue
        line = ""
        for word in paragraph.split(" "):
            longer = f"{line} {word}" if line else word
            if width_of(longer, widths, size) <= most:
                line = longer
            elif line:
                lines.append(line)
                line = word
            else:
                *full, line = broken(word, most, widths, size)
                lines += full
        if line:
            lines.append(line)
    return lines


def wrap_text(text: Column, most: float, size: float, widths: dict[str, float] | None = None) -> Column:
    own = widths or plain_widths()

    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else wrapped(t, most, own, size))

    return run(text)


def fitted(text: str, wide: float, high: float, widths: dict[str, float], largest: float, line_height: float) -> float:
    """The largest half-point size up to ``largest`` at which the wrapped text is no higher than ``high``, half a point at the least."""
    low, top = 1, int(largest * 2)
    while low < top:
        middle = (low + top + 1) // 2
        size = middle / 2
        if len(wrapped(text, wide, widths, size)) * size * line_height <= high:
            low = middle
        else:
            top = middle - 1
    return low / 2


def fitting_size(text: Column, wide: float, high: float, largest: float = 12.0, line_height: float = 1.2, widths: dict[str, float] | None = None) -> Column:
    own = widths or plain_widths()

    @F.pandas_udf(DoubleType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fitted(t, wide, high, own, largest, line_height))

    return run(text)


def operators(*steps: tuple) -> Column:
    """A content stream of (operator, operands...) steps, as one expression."""
    parts = [F.concat_ws(" ", *[o if isinstance(o, Column) else F.lit(str(o)) for o in operands], F.lit(name)) for name, *operands in steps]
    return F.concat_ws("\n", *parts)


def text_appearance(text: Column, font: Column, size: Column, color: Column, x: Column, y: Column) -> Column:
    """The appearance stream of a one-line text field; the text is escaped already."""
    return operators(("BMC", "/Tx"), ("q",), ("BT",), ("Tf", F.concat(F.lit("/"), font), size), ("", color), ("Td", x, y), ("Tj", F.concat(F.lit("("), text, F.lit(")"))), ("ET",), ("Q",), ("EMC",))


def number(value: Column) -> Column:
    """A number as content streams have it: up to three places, no zeros at the end."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.3f", value.cast("double")), r"0+$", ""), r"\.$", "")


def quadded(width: Column, text_width_: Column, quadding: Column, pad: float = 2.0) -> Column:
    """Where a line begins: at the left, in the middle or at the right."""
    return F.when(quadding == 1, (width - text_width_) / 2).when(quadding == 2, width - text_width_ - pad).otherwise(F.lit(pad))


def comb_positions(text: Column, cells: Column, width: Column, size: float, widths: dict[str, float]) -> Column:
    """(char, x) of every character of a comb: in the middle of its cell; what is beyond the cells is left out."""
    cell = width / cells
    chars = F.filter(F.split(F.substring(text, F.lit(1), cells.cast("int")), ""), lambda c: c != "")
    table = F.create_map(*[F.lit(x) for c, w in widths.items() for x in (c, w)])
    own = lambda c: F.coalesce(F.element_at(table, c), F.lit(FALLBACK * 1000)) * size / 1000
    return F.transform(chars, lambda c, i: F.struct(c.alias("char"), (cell * (i + 0.5) - own(c) / 2).alias("x")))


def widest(text: Column, widths: dict[str, float], size: float) -> Column:
    """The width of a text's widest character, 0 without any."""
    table = F.create_map(*[F.lit(x) for c, w in widths.items() for x in (c, w)])
    own = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.coalesce(F.element_at(table, c), F.lit(FALLBACK * 1000)))
    return F.coalesce(F.array_max(own), F.lit(0.0)) * size / 1000


def lines_appearance(lines: Column, font: Column, size: float, color: Column, x: Column, top: Column, leading: float = 1.2) -> Column:
    """The appearance stream of several lines, each a step of ``leading`` below the one before; the lines are escaped already."""
    step = size * leading
    shown = F.transform(lines, lambda t, i: F.concat(F.when(i == 0, F.concat(number(x), F.lit(" "), number(top))).otherwise(F.lit(f"0 {-step:g}")), F.lit(" Td ("), t, F.lit(") Tj")))
    return F.concat_ws("\n", F.lit("/Tx BMC"), F.lit("q"), F.lit("BT"), F.concat(F.lit("/"), font, F.lit(f" {size:g} Tf")), color, F.array_join(shown, "\n"), F.lit("ET"), F.lit("Q"), F.lit("EMC"))


def comb_appearance(text: Column, cells: Column, width: Column, y: float, font: str, size: float, widths: dict[str, float]) -> Column:
    """The appearance stream of a comb: every character placed for itself."""
    shown = F.transform(comb_positions(text, cells, width, size, widths), lambda p: F.concat(F.lit("1 0 0 1 "), number(p["x"]), F.lit(f" {y:g} Tm ("), F.regexp_replace(p["char"], r"([\\()])", r"\\$1"), F.lit(") Tj")))
    return F.concat_ws("\n", F.lit("/Tx BMC"), F.lit("q"), F.lit("BT"), F.lit(f"/{font} {size:g} Tf"), F.array_join(shown, "\n"), F.lit("ET"), F.lit("Q"), F.lit("EMC"))


def list_appearance(options: Column, chosen: Column, width: Column, height: Column, font: str, size: float, leading: float = 1.2) -> Column:
    """The appearance stream of a list box: a bar behind every chosen option (places in ``chosen``), the options from the top down; they are escaped already."""
    step = size * leading
    y = lambda i: height - (i + 1) * step
    bars = F.transform(F.array_sort(F.filter(chosen, lambda i: (i >= 0) & (i < F.size(options)))), lambda i: F.concat(F.lit("0 "), number(y(i)), F.lit(" "), number(width), F.lit(f" {step:g} re f")))
    shown = F.transform(options, lambda t, i: F.concat(F.lit("1 0 0 1 2 "), number(y(i) + step - size), F.lit(" Tm ("), t, F.lit(") Tj")))
    return F.concat_ws("\n", F.lit("/Tx BMC"), F.lit("q"), F.lit("0.6 0.75 0.85 rg"), F.array_join(bars, "\n"), F.lit("BT"), F.lit(f"/{font} {size:g} Tf"), F.lit("0 g"), F.array_join(shown, "\n"), F.lit("ET"), F.lit("Q"), F.lit("EMC"))


#: A quarter of a circle as a curve: how far the control points are, as a part of the radius.
ROUND = 0.5522847498


def circle(x: Column, y: Column, radius: Column) -> Column:
    """A circle of four curves."""
    k = radius * ROUND
    at = lambda *p: F.concat_ws(" ", *[number(v) for v in p])
    curve = lambda *p: F.concat(at(*p), F.lit(" c"))
    return F.concat_ws("\n", F.concat(at(x + radius, y), F.lit(" m")), curve(x + radius, y + k, x + k, y + radius, x, y + radius), curve(x - k, y + radius, x - radius, y + k, x - radius, y), curve(x - radius, y - k, x - k, y - radius, x, y - radius), curve(x + k, y - radius, x + radius, y - k, x + radius, y))


def button_appearance(on: Column, radio: Column, width: Column, height: Column) -> Column:
    """The appearance stream of a check box or radio button; one that is off shows nothing inside."""
    side = F.least(width, height)
    dot = F.concat_ws("\n", F.lit("q"), F.lit("0 g"), circle(width / 2, height / 2, side / 4), F.lit("f"), F.lit("Q"))
    size = side * 0.8
    mark = F.concat_ws("\n", F.lit("q"), F.lit("BT"), F.concat(F.lit("/ZaDb "), number(size), F.lit(" Tf")), F.concat(number((width - size * 0.846) / 2), F.lit(" "), number((height - size * 0.7) / 2), F.lit(" Td (4) Tj")), F.lit("ET"), F.lit("Q"))
    return F.when(~on, F.lit("")).when(radio, dot).otherwise(mark)


def form_object(width: Column, height: Column, rotation: Column, resources: str = "<<>>") -> Column:
    """The dictionary of an appearance: its box, the matrix of a turn by quarters that keeps it in the first quadrant, its resources."""
    turn = F.pmod(rotation, F.lit(360))
    matrix = F.when(turn == 90, F.concat(F.lit("0 1 -1 0 "), number(width), F.lit(" 0"))).when(turn == 180, F.concat(F.lit("-1 0 0 -1 "), number(width), F.lit(" "), number(height))).when(turn == 270, F.concat(F.lit("0 -1 1 0 0 "), number(height))).otherwise(F.lit("1 0 0 1 0 0"))
    box = F.when(turn.isin(90, 270), F.concat(number(height), F.lit(" "), number(width))).otherwise(F.concat(number(width), F.lit(" "), number(height)))
    return F.concat(F.lit("<</Type /XObject /Subtype /Form /BBox [0 0 "), box, F.lit("] /Matrix ["), matrix, F.lit(f"] /Resources {resources}>>"))


def styled_runs(segments: Column, family: str = "Helvetica") -> Column:
    """(text, font, strike, underline) of marked-up segments (text, bold, italic, strike, underline): the family's font for each style."""
    fonts = FAMILIES[family]
    pick_ = lambda s: F.element_at(F.array(*map(F.lit, fonts)), F.when(s["bold"], 2).otherwise(1) + F.when(s["italic"], 2).otherwise(0))
    return F.transform(segments, lambda s: F.struct(s["text"].alias("text"), pick_(s).alias("font"), s["strike"].alias("strike"), s["underline"].alias("underline")))
