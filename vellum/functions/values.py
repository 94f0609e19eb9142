"""Dates and calculator functions as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed_date(text: Column) -> Column:
    """struct(ts, offset_min, precision, repaired) of a date such as D:20140924212303+05'00', or null if it can't be read.

    D: may miss; 4 to 14 digits, an even number; fields out of range are clamped, the day to its month's length. ts is UTC."""
    p = "^(?:D:)?(\\d{4})(\\d{2})?(\\d{2})?(\\d{2})?(\\d{2})?(\\d{2})?(?:([Zz])|([+-])(\\d{2})'?(\\d{2})?'?)?\\s*$"
    group = lambda k: F.regexp_extract(text, p, k)
    field = lambda k, default, low, high: F.when(group(k) == "", F.lit(default)).otherwise(F.least(F.greatest(group(k).cast("int"), F.lit(low)), F.lit(high)))
    year, month = group(1).cast("int"), field(2, 1, 1, 12)
    last = F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))
    day = F.least(field(3, 1, 1, 31), last)
    hour, minute, second = field(4, 0, 0, 23), field(5, 0, 0, 59), field(6, 0, 0, 59)
    sign = F.when(group(8) == "-", -1).otherwise(1)
    part = lambda k: F.when(group(k) == "", 0).otherwise(group(k).cast("int"))
    offset = F.when(group(7) != "", F.lit(0)).when(group(8) != "", sign * (part(9) * 60 + part(10)))
    local = F.make_timestamp(year, month, day, hour, minute, second.cast("decimal(8,6)"))
    ts = F.timestamp_seconds(F.unix_seconds(local) - F.coalesce(offset, F.lit(0)) * 60)
    given = sum((F.when(group(k) != "", 1).otherwise(0) for k in range(2, 7)), F.lit(0))
    precision = F.element_at(F.array(*[F.lit(x) for x in ("Year", "Month", "Day", "Hour", "Minute", "Second")]), given + 1)
    clamped = sum((F.when((group(k) != "") & (group(k).cast("int") != v), 1).otherwise(0) for k, v in ((2, month), (3, day), (4, hour), (5, minute), (6, second))), F.lit(0)) > 0
    # Minutes of the offset without the mark between, and blanks behind it.
    odd = text.rlike(r"[+-]\d{2}\d{2}'?\s*$") | text.rlike(r"\s$")
    return F.when(text.rlike(p), F.struct(ts.alias("ts"), offset.alias("offset_min"), precision.alias("precision"), (clamped | ~text.startswith("D:") | odd).alias("repaired")))


def exponential(x: Column, c0: float, c1: float, n: float, low: float = 0.0, high: float = 1.0) -> Column:
    """c0 + x**n (c1 - c0) with x clipped to its domain; c0 where the power isn't finite."""
    power = F.pow(F.least(F.greatest(x, F.lit(low)), F.lit(high)), F.lit(n))
    return F.when(F.isnan(power) | (F.abs(power) == float("inf")), F.lit(c0)).otherwise(c0 + power * (c1 - c0))


def stitched(x: Column, bounds: list[float], encode: list[tuple[float, float]], parts: list, domain: tuple[float, float] = (0.0, 1.0)) -> Column:
    """The part of the first subdomain whose bound lies above x, over its encoded range."""
    x = F.least(F.greatest(x, F.lit(domain[0])), F.lit(domain[1]))
    edges, out = [domain[0], *bounds, domain[1]], None
    for k, f in reversed(list(enumerate(parts))):
        low, high = edges[k], edges[k + 1]
        inner = F.lit(encode[k][0]) if high == low else encode[k][0] + (x - low) * (encode[k][1] - encode[k][0]) / (high - low)
        out = f(inner) if out is None else F.when(x < high, f(inner)).otherwise(out)
    return out


INT, REAL, BOOL = "integer", "real", "boolean"


def _finite(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")) | c.isNull(), F.lit(0.0)).otherwise(c)


def _whole(c: Column) -> Column:
    """Toward zero."""
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("double")


_LEAST, _MOST = -(2.0**31), 2.0**31 - 1
_to_int = lambda c: _whole(F.least(F.greatest(c, F.lit(_LEAST)), F.lit(_MOST)))
_bool = lambda c: F.when(c, 1.0).otherwise(0.0)
_as_long = lambda c: _to_int(c).cast("long")


def _rounded(name: str):
    return {"ceiling": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"), "round": lambda x: F.floor(x + 0.5).cast("double"), "truncate": _whole, "abs": F.abs, "neg": lambda x: -x}[name]


def _degrees(f, x: Column) -> Column:
    """Sine or cosine of degrees, exact at quarter turns."""
    turn = F.pmod(x, F.lit(360.0))
    exact = {F.sin: (0.0, 1.0, 0.0, -1.0), F.cos: (1.0, 0.0, -1.0, 0.0)}[f]
    out = f(F.radians(x))
    for k, v in enumerate(exact):
        out = F.when(turn == 90.0 * k, F.lit(v)).otherwise(out)
    return out


_SAME = ("abs", "neg", "ceiling", "floor", "round", "truncate")
_REALS = {
    "sqrt": lambda x: F.when(x >= 0, F.sqrt(F.greatest(x, F.lit(0.0)))), "sin": lambda x: _degrees(F.sin, x), "cos": lambda x: _degrees(F.cos, x),
    "ln": lambda x: F.when(x > 0, F.log(F.when(x > 0, x))), "log": lambda x: F.when(x > 0, F.log10(F.when(x > 0, x))), "cvr": lambda x: x,
}
_REALS2 = {"div": lambda x, y: F.when(y != 0, x / F.nullif(y, F.lit(0.0))), "exp": F.pow, "atan": lambda x, y: F.when((x != 0) | (y != 0), F.pmod(F.degrees(F.atan2(x, y)) + 360.0, F.lit(360.0)))}
_NUMBERS2 = {"add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y}
_TESTS = {"gt": lambda x, y: x > y, "ge": lambda x, y: x >= y, "lt": lambda x, y: x < y, "le": lambda x, y: x <= y}
_BITS = {"and": lambda x, y: x.bitwiseAND(y), "or": lambda x, y: x.bitwiseOR(y), "xor": lambda x, y: x.bitwiseXOR(y)}


def _integer_division(name: str, x: Column, y: Column) -> Column:
    x, y = _as_long(x), _as_long(y)
    safe = F.nullif(y, F.lit(0).cast("long"))
    return F.coalesce((_whole((x / safe)) if name == "idiv" else (x % safe)).cast("double"), F.lit(0.0))


def _shifted(x: Column, by: Column) -> Column:
    """Of 32 bits; to the right for a negative number of places."""
    x, by = _as_long(x), _as_long(by)
    left = F.when(by >= 32, 0).otherwise(F.call_function("shiftleft", x, F.least(by, F.lit(31).cast("long")).cast("int")).bitwiseAND(F.lit(0xFFFFFFFF)))
    right = F.when(by <= -32, 0).otherwise(F.call_function("shiftright", x.bitwiseAND(F.lit(0xFFFFFFFF)), F.least(-by, F.lit(31).cast("long")).cast("int")))
    out = F.when(by >= 0, left).otherwise(right)
    return F.when(out >= 1 << 31, out - (1 << 32)).otherwise(out).cast("double")


def calculator(program: str, *inputs: Column) -> list[Column]:
    """A calculator program run on a stack of columns when the plan is built: what is left becomes one expression each.

    Every operand has a kind (integer, real, boolean); one of the wrong kind is converted (true counts as 1, a real is cut
    to an integer), a result that isn't a finite number is 0, and a boolean that is left at the end is 1 or 0. copy, index
    and roll need numbers written in the program. Underflow and unknown operators are errors of the program."""
    tokens = program.replace("{", " { ").replace("}", " } ").split()

    def block(at: int) -> tuple[list, int]:
        out = []
        while at < len(tokens) and tokens[at] != "}":
            if tokens[at] == "{":
                inner, at = block(at + 1)
                out.append(inner)
            else:
                out.append(tokens[at])
            at += 1
        return out, at

    def chosen(test: Column, yes: list, no: list) -> list:
        if len(yes) != len(no):
            raise ValueError("both branches must leave as many values")
        return [a if a is b else (F.when(test, a[0]).otherwise(b[0]), a[1] if a[1] == b[1] else REAL, None) for a, b in zip(yes, no)]

    def run(code: list, stack: list) -> list:
        stack = list(stack)
        number = lambda: int(stack.pop()[2])
        put = lambda c, kind: stack.append((c, kind, None))
        for t in code:
            if isinstance(t, list):
                stack.append(t)
            elif t in _SAME:
                x, kind, _ = stack.pop()
                put(_rounded(t)(x), INT if kind != REAL else REAL)
            elif t in _REALS:
                put(_finite(_REALS[t](stack.pop()[0])), REAL)
            elif t == "cvi":
                put(_to_int(stack.pop()[0]), INT)
            elif t == "not":
                x, kind, _ = stack.pop()
                put(1 - x if kind == BOOL else -_to_int(x) - 1, kind if kind == BOOL else INT)
            elif t in _NUMBERS2 or t in _REALS2 or t in _TESTS or t in _BITS or t in ("idiv", "mod", "bitshift", "eq", "ne"):
                (y, ky, _), (x, kx, _) = stack.pop(), stack.pop()
                if t in _NUMBERS2:
                    put(_finite(_NUMBERS2[t](x, y)), REAL if REAL in (kx, ky) else INT)
                elif t in _REALS2:
                    put(_finite(_REALS2[t](x, y)), REAL)
                elif t in ("idiv", "mod"):
                    put(_integer_division(t, x, y), INT)
                elif t == "bitshift":
                    put(_shifted(x, y), INT)
                elif t in _TESTS:
                    put(_bool(_TESTS[t](x, y)), BOOL)
                elif t in ("eq", "ne"):
                    equal = (x == y) if (kx == BOOL) == (ky == BOOL) else F.lit(False)
                    put(_bool(equal if t == "eq" else ~equal), BOOL)
                else:
                    put(_BITS[t](_as_long(x), _as_long(y)).cast("double"), BOOL if kx == ky == BOOL else INT)
            elif t == "pop":
                stack.pop()
            elif t == "dup":
                stack.append(stack[-1])
            elif t == "exch":
                stack[-1], stack[-2] = stack[-2], stack[-1]
            elif t == "copy":
                n = number()
                stack += stack[len(stack) - n :]
            elif t == "index":
                stack.append(stack[-1 - number()])
            elif t == "roll":
                j, n = number(), number()
                if n:
                    top, j = stack[len(stack) - n :], j % n
                    stack[len(stack) - n :] = top[n - j :] + top[: n - j]
            elif t == "if":
                then, test = stack.pop(), stack.pop()[0] != 0
                stack = chosen(test, run(then, stack), stack)
            elif t == "ifelse":
                other, then, test = stack.pop(), stack.pop(), stack.pop()[0] != 0
                stack = chosen(test, run(then, stack), run(other, stack))
            elif t in ("true", "false"):
                put(F.lit(float(t == "true")), BOOL)
            else:
                value = float(t)
                stack.append((F.lit(value), REAL if "." in t or "e" in t.lower() or abs(value) > _MOST else INT, value))
        return stack

    code, _ = block(0)
    code = code[0] if len(code) == 1 and isinstance(code[0], list) else code
    return [c for c, _, _ in run(code, [(c.cast("double"), REAL, None) for c in inputs])]


def sampled(x: list[Column], domain: list[tuple[float, float]], size: list[int], samples: list[float], encode: list[tuple[float, float]] | None = None, decode: tuple[float, float] = (0.0, 1.0), bits: int = 8) -> Column:
    """A table of samples (the first input's index runs fastest), read between its places in straight lines along each input.
    Samples are integers of so many bits, spread over decode."""
    encode = encode or [(0.0, float(n - 1)) for n in size]
    table = F.lit([decode[0] + s * (decode[1] - decode[0]) / (2**bits - 1) for s in samples])
    cells, parts, strides, stride = [], [], [], 1
    for v, (low, high), n, (e0, e1) in zip(x, domain, size, encode):
        v = F.least(F.greatest(v, F.lit(low)), F.lit(high))
        e = F.lit(e0) if high == low else e0 + (v - low) * ((e1 - e0) / (high - low))
        e = F.least(F.greatest(e, F.lit(0.0)), F.lit(float(n - 1)))
        cell = F.least(F.floor(e).cast("int"), F.lit(max(n - 2, 0)))
        cells.append(cell)
        parts.append(e - cell)
        strides.append(stride)
        stride *= n
    out = F.lit(0.0)
    for corner in range(1 << len(x)):
        at, weight = F.lit(0), F.lit(1.0)
        for k, (cell, part) in enumerate(zip(cells, parts)):
            up = corner >> k & 1
            if up and size[k] == 1:
                weight = F.lit(0.0)
                continue
            at = at + (cell + up) * strides[k]
            weight = weight * (part if up else 1 - part)
        out = out + weight * F.coalesce(F.get(table, at), F.lit(0.0))
    return out


def each_of(functions: list, x: Column) -> Column:
    """An array of functions of one input: their outputs in order; identity where a function is None."""
    return F.array(*[x if f is None else f(x) for f in functions])


#: Points in one unit (fixed values).
POINTS = {"pt": 1.0, "in": 72.0, "cm": 72.0 / 2.54, "mm": 72.0 / 25.4}


def length(value: Column, unit: Column) -> Column:
    """A length in points; null for an unknown unit."""
    out = F.lit(None).cast("double")
    for name, points in POINTS.items():
        out = F.when(unit == name, value * points).otherwise(out)
    return out


def xmp_date(text: Column) -> Column:
    """struct(ts, offset_min, precision) of a date such as 2014-09-24T21:23:03.5+01:00 (any beginning of it that ends behind a
    field), or null. White space around it is cut off; nothing is clamped. ts is UTC; a time without a zone counts as UTC."""
    p = r"^(\d{4})(?:-(\d{2})(?:-(\d{2})(?:T(\d{2}):(\d{2})(?::(\d{2})(?:\.(\d+))?)?(?:(Z)|([+-])(\d{2}):(\d{2}))?)?)?)?$"
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    group = lambda k: F.regexp_extract(t, p, k)
    number = lambda k, default: F.when(group(k) == "", F.lit(default)).otherwise(F.coalesce(group(k).try_cast("int"), F.lit(default)))
    year, month, day, hour, minute, second = number(1, 0), number(2, 1), number(3, 1), number(4, 0), number(5, 0), number(6, 0)
    sign = F.when(group(9) == "-", -1).otherwise(1)
    offset = F.when(group(8) != "", F.lit(0)).when(group(9) != "", sign * (number(10, 0) * 60 + number(11, 0)))
    fraction = F.when(group(7) != "", F.concat(F.lit("0."), group(7)).cast("double")).otherwise(F.lit(0.0))
    fits = t.rlike(p) & (year >= 1) & month.between(1, 12) & (hour < 24) & (minute < 60) & (second < 60) & (number(10, 0) < 24) & (number(11, 0) < 60)
    last = F.dayofmonth(F.last_day(F.make_date(year, F.when(month.between(1, 12), month).otherwise(1), F.lit(1))))
    fits = fits & (day >= 1) & (day <= F.coalesce(last, F.lit(31)))
    local = F.try_make_timestamp(year, month, day, hour, minute, second.cast("decimal(8,6)"))
    ts = F.timestamp_micros((F.unix_micros(local) + F.floor(fraction * 1_000_000) - F.coalesce(offset, F.lit(0)).cast("long") * 60_000_000).cast("long"))
    names = ((7, "FractionOfSecond"), (6, "Second"), (4, "Minute"), (3, "Day"), (2, "Month"))
    precision = F.lit("Year")
    for k, name in reversed(names):
        precision = F.when(group(k) != "", name).otherwise(precision)
    return F.when(fits, F.struct(ts.alias("ts"), offset.alias("offset_min"), precision.alias("precision")))


def resolved_uri(uri: Column, base: Column) -> Column:
    """A reference resolved against a base: as it is if it has a scheme or there is no base, else by the rules for a
    reference with an authority, a query, a fragment, an absolute or a relative path; nothing is fetched."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, "^(.*/)?", 0))
    tail = F.regexp_extract(uri, r"([?#].*)?$", 0)
    joined = F.concat(folder, F.regexp_extract(uri, r"^[^?#]*", 0))
    # Each step takes out one "x/.." pair; paths have few of them, and what is left at the root is dropped.
    for _ in range(8):
        joined = F.regexp_replace(F.regexp_replace(joined, r"/\.(?=/|$)", ""), r"/(?!\.\./)[^/]+/\.\.(?=/|$)", "")
    joined = F.regexp_replace(joined, r"^(/\.\.)+(?=/|$)", "")
    out = F.when(uri.startswith("//"), F.concat(scheme, uri)).when(uri.startswith("/"), F.concat(site, uri))
    out = out.when(uri.startswith("#"), F.concat(F.regexp_extract(base, "^[^#]*", 0), uri)).when(uri.startswith("?"), F.concat(site, path, uri)).when(uri == "", base)
    return F.when(base.isNull() | uri.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), uri).otherwise(out.otherwise(F.concat(site, joined, tail)))
