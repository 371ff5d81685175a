"""Dates, numbers, special formats and validation as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of a date pattern, the longest first, with what the engine's formatter calls them.
DATE_TOKENS = [("yyyy", "yyyy"), ("yy", "yy"), ("mmmm", "MMMM"), ("mmm", "MMM"), ("mm", "MM"), ("m", "M"), ("dddd", "EEEE"), ("ddd", "EEE"), ("dd", "dd"), ("d", "d"), ("HH", "HH"), ("hh", "hh"), ("h", "h"), ("MM", "mm"), ("ss", "ss"), ("tt", "a"), ("t", "a")]
DATE_TOKEN = re.compile("|".join(t for t, _ in DATE_TOKENS))
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def date_pattern(form: str) -> str:
    """The engine's pattern for a document's date pattern; other letters are quoted."""
    out, at, names = "", 0, dict(DATE_TOKENS)
    for m in DATE_TOKEN.finditer(form):
        between = form[at : m.start()]
        out += (f"'{between}'" if re.search("[A-Za-z]", between) else between.replace("'", "''")) + names[m[0]]
        at = m.end()
    rest = form[at:]
    return out + (f"'{rest}'" if re.search("[A-Za-z]", rest) else rest)


def printd(form: str, when: Column) -> Column:
    """A timestamp in a document's date pattern (``mm/dd/yyyy``, ``hh:MM tt`` and so on), in the session's time zone."""
    return F.date_format(when, date_pattern(form))


def scand(form: str, text: Column) -> Column:
    """The date of a text in a date pattern, or null. The whole text must fit; days and months beyond the calendar roll over."""
    order, pattern, at = [], "", 0
    for m in DATE_TOKEN.finditer(form):
        pattern += re.escape(form[at : m.start()])
        token = m[0]
        pattern += {"yyyy": "(\\d{4})", "yy": "(\\d{2})", "mmm": "([A-Za-z]{3})", "mmmm": "([A-Za-z]+)", "ddd": "([A-Za-z]{3})", "dddd": "([A-Za-z]+)", "tt": "([AaPp][Mm])", "t": "([AaPp])"}.get(token, "(\\d{2})" if len(token) == 2 else "(\\d{1,2})")
        order.append(token)
        at = m.end()
    pattern = f"^{pattern}{re.escape(form[at:])}$"
    part = lambda *names: next((F.regexp_extract(text, pattern, i + 1) for i, t in enumerate(order) if t in names), None)
    number = lambda c, other: F.lit(other) if c is None else F.try_to_number(c, F.lit("9999")).cast("int")
    year = number(part("yyyy"), None) if part("yyyy") is not None else None
    if year is None:
        two = part("yy")
        year = F.when(number(two, 0) < 50, number(two, 0) + 2000).otherwise(number(two, 0) + 1900) if two is not None else F.year(F.current_date())
    named = part("mmm", "mmmm")
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(named, 1, 3))).cast("int") if named is not None else number(part("mm", "m"), 1)
    day, hour = number(part("dd", "d"), 1), number(part("HH", "hh", "h"), 0)
    half = part("tt", "t")
    if half is not None:
        hour = F.when(F.lower(F.substring(half, 1, 1)) == "p", hour % 12 + 12).otherwise(hour % 12)
    start = F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    made = F.add_months(start.cast("date"), month - 1).cast("timestamp") + F.make_dt_interval(day - 1, hour, number(part("MM"), 0), number(part("ss"), 0))
    return F.when(text.rlike(pattern) & (month > 0 if named is not None else F.lit(True)), made)


def printf(form: str, *args: Column) -> Column:
    """Text of a C-like pattern with %d, %f, %s, %x, %X, %o and %%; doubles are rounded half up from their exact decimal places."""
    cast = []
    specs = [m[0] for m in re.finditer("%[-+ 0#]*\\d*(?:\\.\\d+)?[dfsxXo%]", form) if not m[0].endswith("%")]
    for spec, arg in zip(specs, args):
        places = int(spec.split(".")[1][:-1]) if "." in spec else 6
        cast.append(arg.cast("long") if spec[-1] in "dxXo" else F.round(arg.cast("decimal(38,12)"), places).cast("double") if spec[-1] == "f" else arg.cast("string"))
    return F.format_string(form, *cast)


def parse_numeric(text: Column) -> Column:
    """The number at the start of a text's digits, signs, points and letters e; 0 if there is none."""
    kept = F.regexp_replace(text, "[^0-9.\\-eE]", "")
    found = F.regexp_extract(kept, "^[-+]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][-+]?\\d+)?", 0)
    return F.coalesce(found.try_cast("double"), F.lit(0.0))


def number_format(value: Column, places: int, separators: int = 0, negative: int = 0, currency: str = "", prepend: bool = True) -> Column:
    """A number with separators 0 ``1,234.56``, 1 ``1234.56``, 2 ``1.234,56`` or 3 ``1234,56``; negative styles from 2 on put it in parentheses."""
    exact = F.round(F.abs(value).cast("decimal(38,12)"), places).cast(f"decimal(38,{places})")
    text = F.format_number(exact, places)
    if separators in (1, 3):
        text = F.replace(text, F.lit(","), F.lit(""))
    if separators == 2:
        text = F.translate(text, ",.", ".,")
    if separators == 3:
        text = F.replace(text, F.lit("."), F.lit(","))
    if currency:
        text = F.concat(F.lit(currency), text) if prepend else F.concat(text, F.lit(currency))
    below = value < 0
    return F.when(below, F.concat(F.lit("("), text, F.lit(")")) if negative >= 2 else F.concat(F.lit("-"), text)).otherwise(text)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def special_format(text: Column, kind: int) -> Column:
    """Kind 0 a five-digit code, 1 a social security number, 2 a phone number, 3 a nine-digit code."""
    d = digits(text)
    cut = lambda a, n: F.substring(d, a, n)
    if kind == 0:
        return F.rpad(cut(1, 5), 5, "0")
    if kind == 1:
        return F.concat(cut(1, 3), F.lit("-"), cut(4, 2), F.lit("-"), cut(6, 4))
    if kind == 2:
        return F.when(F.length(d) >= 10, F.concat(F.lit("("), cut(1, 3), F.lit(") "), cut(4, 3), F.lit("-"), cut(7, 4))).otherwise(F.concat(cut(1, 3), F.lit("-"), cut(4, 4)))
    return F.concat(cut(1, 5), F.lit("-"), cut(6, 4))


def special_valid(text: Column, kind: int) -> Column:
    return F.length(digits(text)).isin({0: [5], 1: [9], 2: [7, 10], 3: [9]}[kind])


def number_valid(text: Column, separators: int = 0) -> Column:
    """Whether a whole text is a number in that separator style."""
    point, group = (",", "\\.") if separators >= 2 else ("\\.", ",")
    return text.rlike(f"^-?(\\d+|\\d{{1,3}}({group}\\d{{3}})+)?({point}\\d*)?$") & text.rlike("\\d")


def document_date(when: Column) -> Column:
    """``D:YYYYMMDDHHmmSS+00'00'`` of an instant, in UTC."""
    return F.concat(F.lit("D:"), F.date_format(F.to_utc_timestamp(when, F.current_timezone()), "yyyyMMddHHmmss"), F.lit("+00'00'"))


def parse_document_date(text: Column) -> Column:
    """The instant of a document date; all fourteen digits are needed, the offset is not."""
    shape = "^D:(\\d{14})(?:([+\\-])(\\d{2})'?(\\d{2})'?|Z)?"
    base = F.try_to_timestamp(F.regexp_extract(text, shape, 1), F.lit("yyyyMMddHHmmss"))
    minutes = F.coalesce(F.regexp_extract(text, shape, 3).try_cast("int"), F.lit(0)) * 60 + F.coalesce(F.regexp_extract(text, shape, 4).try_cast("int"), F.lit(0))
    sign = F.when(F.regexp_extract(text, shape, 2) == "-", -1).otherwise(1)
    return F.when(text.rlike(shape), F.from_utc_timestamp(base - F.make_dt_interval(F.lit(0), F.lit(0), sign * minutes), F.current_timezone()))


def little_endian(number: Column) -> Column:
    """Four bytes of a whole number, the lowest first."""
    h = F.lpad(F.hex(number.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]))


def rect(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A rectangle with its corners in order, and its width and height."""
    left, right, low, high = F.least(x1, x2), F.greatest(x1, x2), F.least(y1, y2), F.greatest(y1, y2)
    return F.struct(left.alias("x1"), low.alias("y1"), right.alias("x2"), high.alias("y2"), (right - left).alias("width"), (high - low).alias("height"))


def quadding_x(width: Column, text_width: Column, kind: Column, padding: float = 2.0) -> Column:
    """Where a line begins: kind 0 left, 1 centre, 2 right."""
    return F.when(kind == 1, (width - text_width) / 2).when(kind == 2, width - text_width - padding).otherwise(F.lit(padding))


def half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def metric(value: Column, units_per_em: Column) -> Column:
    """A font unit scaled to a thousandth of an em."""
    return half_up(value * 1000 / units_per_em)
