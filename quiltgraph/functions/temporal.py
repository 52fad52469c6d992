"""Temporal values as Spark types: constructors, parts, truncation, durations, arithmetic, text.

date is DATE, a local date-time TIMESTAMP_NTZ, a local time nanoseconds of the day; a
date-time is a struct of local time, offset in seconds and zone; a time, of nanoseconds
and offset; a duration, of months, days, seconds and nanoseconds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quiltgraph.errors import mistyped, semantic
from quiltgraph.functions.types import Typed, null

KINDS = ("date", "ldt", "dt", "ltime", "time", "dur")
CONSTRUCTORS = {"date": "date", "localdatetime": "ldt", "datetime": "dt", "localtime": "ltime", "time": "time", "duration": "dur"}
DAY_NANOS = 86_400_000_000_000
#: Fixed value: seconds in an average month of the Gregorian calendar.
MONTH_SECONDS = 2_629_746


def let(columns: list[Column], body) -> Column:
    """``body`` of the columns, each evaluated once however often the body names it."""
    packed = F.struct(*(c.alias(f"v{k}") for k, c in enumerate(columns)))
    return F.get(F.transform(F.array(packed), lambda s: body(*(s[f"v{k}"] for k in range(len(columns))))), F.lit(0))


def is_temporal(t) -> bool:
    return t in KINDS


def is_function(low: str) -> bool:
    return low.split(".")[0] in CONSTRUCTORS


def duration(months: Column, days: Column, seconds: Column, nanos: Column) -> Typed:
    """Whole seconds are carried out of the nanoseconds."""
    def made(m: Column, d: Column, s: Column, n: Column) -> Column:
        carry = F.floor(n / 1_000_000_000).cast("bigint")
        parts = (m, d, s + carry, n - carry * 1_000_000_000)
        return F.struct(*(p.cast("bigint").alias(k) for p, k in zip(parts, ("months", "days", "seconds", "nanos"))))

    return Typed(let([months, days, seconds, nanos], made), "dur")


def from_micros(m: Column) -> Column:
    """The local date-time so many microseconds after 1970."""

    def made(v: Column) -> Column:
        rest = F.pmod(v, F.lit(86_400_000_000))
        return let([F.date_add(F.lit("1970-01-01").cast("date"), F.call_function("div", v - rest, F.lit(86_400_000_000)).cast("int")), rest], clock)

    def clock(d: Column, rest: Column) -> Column:
        div = lambda n: F.call_function("div", rest, F.lit(n))
        return F.make_timestamp_ntz(F.year(d), F.month(d), F.day(d), div(3_600_000_000).cast("int"), (div(60_000_000) % 60).cast("int"), ((rest % 60_000_000) / 1_000_000).cast("decimal(16,6)"))

    return let([m], made)


def local_micros(local: Column) -> Column:
    """The same number without any session zone: days and the time of day."""
    d = lambda v: F.datediff(v.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return let([local], lambda v: d(v) * 86_400_000_000 + time_nanos(v) / 1000)


def time_nanos(local: Column) -> Column:
    return (F.hour(local) * 3600 + F.minute(local) * 60).cast("bigint") * 1_000_000_000 + (F.date_part(F.lit("SECOND"), local) * 1_000_000_000).cast("bigint")


def local_of(x: Typed) -> Column:
    """As a local date-time; a time falls on 1970-01-01."""
    if x.t == "dt":
        return x.col["local"]
    if x.t == "ldt":
        return x.col
    if x.t == "date":
        return x.col.cast("timestamp_ntz")
    nanos = x.col if x.t == "ltime" else x.col["nanos"]
    return from_micros(F.floor(nanos / 1000).cast("bigint"))


def comparable(x: Typed) -> Column:
    """What orders a value: instants and offset times by UTC."""
    if x.t == "dt":
        return F.floor(local_micros(x.col["local"])) - x.col["offset"].cast("bigint") * 1_000_000
    if x.t == "time":
        return x.col["nanos"] - x.col["offset"].cast("bigint") * 1_000_000_000
    return x.col


def _offset(text: Column) -> Column:
    """Seconds of an offset such as Z, +02:00 or -0130."""
    sign = F.when(text.startswith("-"), -1).otherwise(1)
    digits = F.rpad(F.regexp_replace(text, "[^0-9]", ""), 4, "0")
    return F.when(text.isin("Z", "z"), 0).when(text.rlike(r"^[+-]\d"), sign * (F.substring(digits, 1, 2).cast("int") * 3600 + F.substring(digits, 3, 2).cast("int") * 60))


def _zoned(local: Column, offset: Column, zone: Column) -> Typed:
    """With the zone's offset at that local time where a zone is named."""

    def made(v: Column, o: Column, z: Column) -> Column:
        whole = F.date_trunc("second", v).cast("string")
        utc = F.date_format(F.to_utc_timestamp(whole, F.coalesce(z, F.lit("UTC"))), "yyyy-MM-dd HH:mm:ss")
        seconds = lambda text: F.floor(local_micros(F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd HH:mm:ss"))) / 1_000_000)
        there = F.floor(local_micros(v) / 1_000_000) - seconds(utc)
        return F.struct(v.alias("local"), F.when(z.isNotNull(), there).otherwise(F.coalesce(o, F.lit(0))).cast("int").alias("offset"), z.alias("zone"))

    return Typed(let([local, offset.cast("int"), zone.cast("string")], made), "dt")


def _seconds(text: Column) -> Column:
    return F.call_function("coalesce", text.try_cast("decimal(18,9)"), F.lit(0).cast("decimal(18,9)"))


def _time_text(text: Column) -> Column:
    """Nanoseconds of hh, hh:mm, hh:mm:ss or hhmmss with a fraction."""
    plain = F.regexp_replace(text, ":", "")
    part = lambda a: F.coalesce(F.substring(plain, a, 2).try_cast("int"), F.lit(0)).cast("bigint")
    return part(1) * 3_600_000_000_000 + part(3) * 60_000_000_000 + (_seconds(F.substring(plain, 5, 12)) * 1_000_000_000).cast("bigint")


def _date_text(source: Column) -> Column:
    """Calendar, week and ordinal dates, with or without dashes, whole or reduced."""
    return let([source], _any_date)


def _any_date(text: Column) -> Column:
    week = F.regexp_extract(text, r"^(\d{4})-?W(\d{2})(?:-?(\d))?$", 0) != ""
    year = F.substring(text, 1, 4).try_cast("int")
    first = F.make_date(year, F.lit(1), F.lit(4))
    monday = F.date_sub(first, F.weekday(first))
    w = F.regexp_extract(text, r"W(\d{2})", 1).try_cast("int")
    d = F.regexp_extract(text, r"W\d{2}-?(\d)$", 1).try_cast("int")
    by_week = F.date_add(monday, (w - 1) * 7 + F.coalesce(d, F.lit(1)) - 1)
    ordinal = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), F.regexp_extract(text, r"^\d{4}-?(\d{3})$", 1).try_cast("int") - 1)
    compact = F.regexp_replace(text, r"^(\d{4})-?(\d{2})?-?(\d{2})?$", "$1$2$3")
    calendar = F.make_date(year, F.coalesce(F.substring(compact, 5, 2).try_cast("int"), F.lit(1)), F.coalesce(F.substring(compact, 7, 2).try_cast("int"), F.lit(1)))
    return F.when(week, by_week).when(text.rlike(r"^\d{4}-?\d{3}$"), ordinal).otherwise(calendar)


def _parts_text(text: Column) -> tuple[Column, Column, Column, Column]:
    """(date, nanoseconds, offset, zone) of an ISO date-time."""
    body = F.regexp_replace(text, r"\[.*\]$", "")  # text is a bound variable here
    zone = F.when(text.rlike(r"\[.*\]$"), F.regexp_extract(text, r"\[(.*)\]$", 1))
    day, rest = F.substring_index(body, "T", 1), F.when(body.contains("T"), F.regexp_replace(body, "^[^T]*T", "")).otherwise(F.lit(""))
    mark = F.regexp_extract(rest, r"(Z|z|[+-]\d{2}(?::?\d{2})?)$", 1)
    return _date_text(day), _time_text(F.regexp_replace(rest, r"(Z|z|[+-]\d{2}(?::?\d{2})?)$", "")), F.when(mark != "", _offset(mark)), zone


def _at(day: Column, nanos: Column) -> Column:
    d = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint")
    return from_micros(d * 86_400_000_000 + F.floor(nanos / 1000).cast("bigint"))


def _from_text(kind: str, text: Column) -> Typed:
    return Typed(let([text], lambda t: _read(kind, t).col), kind)


def _read(kind: str, text: Column) -> Typed:
    if kind == "dur":
        get = lambda mark, part: F.coalesce(F.regexp_extract(part, rf"(-?\d+(?:\.\d+)?){mark}", 1).try_cast("double"), F.lit(0.0))
        day, rest = F.substring_index(text, "T", 1), F.when(text.contains("T"), F.substring_index(text, "T", -1)).otherwise(F.lit(""))
        values = {"years": get("Y", day), "months": get("M", day), "weeks": get("W", day), "days": get("D", day), "hours": get("H", rest), "minutes": get("M", rest), "seconds": get("S", rest)}
        return _duration_of({k: Typed(v, "float") for k, v in values.items()})
    if kind == "date":
        return Typed(_date_text(F.substring_index(text, "T", 1)), "date")
    if kind in ("ltime", "time"):
        mark = F.regexp_extract(text, r"(Z|z|[+-]\d{2}(?::?\d{2})?)$", 1)
        nanos = _time_text(F.regexp_replace(F.regexp_replace(text, "^.*T", ""), r"(Z|z|[+-]\d{2}(?::?\d{2})?)$", ""))
        return Typed(nanos, "ltime") if kind == "ltime" else Typed(F.struct(nanos.alias("nanos"), F.coalesce(_offset(mark), F.lit(0)).cast("int").alias("offset")), "time")
    day, nanos, offset, zone = _parts_text(text)
    return Typed(_at(day, nanos), "ldt") if kind == "ldt" else _zoned(_at(day, nanos), offset, zone)


def _duration_of(m: dict[str, Typed]) -> Typed:
    """Fractions of months go on as days of an average month, of days as seconds."""
    keys = sorted(m)
    return Typed(let([m[k].col.cast("double") for k in keys], lambda *v: _carried(dict(zip(keys, v)))), "dur")


def _carried(m: dict[str, Column]) -> Column:
    get = lambda k: m.get(k, F.lit(0.0))
    months = get("years") * 12 + get("quarters") * 3 + get("months")
    whole = F.when(months >= 0, F.floor(months)).otherwise(F.ceil(months))
    days = get("weeks") * 7 + get("days") + (months - whole) * (MONTH_SECONDS / 86400)
    whole_days = F.when(days >= 0, F.floor(days + 1e-9)).otherwise(F.ceil(days - 1e-9))
    seconds = get("hours") * 3600 + get("minutes") * 60 + get("seconds") + F.round((days - whole_days) * 86400, 6)
    whole_seconds = F.floor(seconds + 1e-9)
    nanos = F.round((seconds - whole_seconds) * 1e9) + get("milliseconds") * 1e6 + get("microseconds") * 1e3 + get("nanoseconds")
    return duration(whole, whole_days, whole_seconds, nanos.cast("bigint")).col


def _from_map(kind: str, m: dict[str, Typed]) -> Typed:
    m = {k.lower(): v for k, v in m.items()}
    if kind == "dur":
        return _duration_of(m)
    keys = sorted(m)
    return Typed(let([m[k].col for k in keys], lambda *v: _built(kind, {k: Typed(c, m[k].t) for k, c in zip(keys, v)}).col), kind)


def _built(kind: str, m: dict[str, Typed]) -> Typed:
    base_day = m.get("date", m.get("datetime"))
    base_time = m.get("time", m.get("datetime"))
    get = lambda k, other: m[k].col.cast("int") if k in m else other
    day0 = local_of(base_day).cast("date") if base_day else None
    year = get("year", F.year(day0) if base_day else F.lit(0))
    if "week" in m or "dayofweek" in m and not base_day:
        first = F.make_date(get("year", F.date_part(F.lit("YEAROFWEEK"), day0).cast("int") if base_day else F.lit(0)), F.lit(1), F.lit(4))
        day = F.date_add(F.date_sub(first, F.weekday(first)), (get("week", F.lit(1)) - 1) * 7 + get("dayofweek", F.weekday(day0) + 1 if base_day else F.lit(1)) - 1)
    elif "ordinalday" in m:
        day = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), get("ordinalday", F.lit(1)) - 1)
    elif "quarter" in m or "dayofquarter" in m:
        quarter = get("quarter", F.quarter(day0) if base_day else F.lit(1))
        start = F.make_date(year, (quarter - 1) * 3 + 1, F.lit(1))
        day = F.date_add(start, get("dayofquarter", F.datediff(day0, F.trunc(day0, "quarter")) + 1 if base_day else F.lit(1)) - 1)
    else:
        day = F.make_date(year, get("month", F.month(day0) if base_day else F.lit(1)), get("day", F.day(day0) if base_day else F.lit(1)))
    if kind == "date":
        return Typed(day, "date")
    nanos0 = time_nanos(local_of(base_time)) if base_time else F.lit(0)
    if base_time is not None and base_time.t in ("ltime", "time"):
        nanos0 = base_time.col if base_time.t == "ltime" else base_time.col["nanos"]
    long_ = lambda c: c.cast("bigint")
    part = lambda k, unit, below: long_(m[k].col) * unit if k in m else nanos0 - nanos0 % unit if below is None else (nanos0 % below) - (nanos0 % unit)
    hour, minute, second = part("hour", 3_600_000_000_000, None), part("minute", 60_000_000_000, 3_600_000_000_000), part("second", 1_000_000_000, 60_000_000_000)
    small = [long_(m[k].col) * u for k, u in (("millisecond", 1_000_000), ("microsecond", 1000), ("nanosecond", 1)) if k in m]
    fraction = sum(small[1:], small[0]) if small else nanos0 % 1_000_000_000
    nanos = long_(hour + minute + second + fraction)
    zone = m["timezone"].col if "timezone" in m else None
    offset = _offset(zone) if zone is not None else base_time.col["offset"] if base_time is not None and base_time.t in ("dt", "time") else F.lit(0)
    if kind == "ltime":
        return Typed(nanos, "ltime")
    if kind == "time":
        return Typed(F.struct(nanos.alias("nanos"), offset.cast("int").alias("offset")), "time")
    if kind == "ldt":
        return Typed(_at(day, nanos), "ldt")
    named = F.when(offset.isNull(), zone) if zone is not None else F.lit(None).cast("string")
    return _zoned(_at(day, nanos), offset, named)


def _convert(kind: str, x: Typed) -> Typed:
    if x.t == kind:
        return x
    if kind == "date":
        return Typed(local_of(x).cast("date"), "date")
    if kind == "ldt":
        return Typed(local_of(x), "ldt")
    if kind == "dt":
        return _zoned(local_of(x), F.lit(0), F.lit(None).cast("string"))
    nanos = x.col["nanos"] if x.t == "time" else x.col if x.t == "ltime" else time_nanos(local_of(x))
    if kind == "ltime":
        return Typed(nanos, "ltime")
    return Typed(F.struct(nanos.alias("nanos"), (x.col["offset"] if x.t == "dt" else F.lit(0)).cast("int").alias("offset")), "time")


def _now(kind: str) -> Typed:
    local = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")
    return _convert(kind, Typed(local, "ldt"))


def fields(x: Typed) -> dict[str, Typed]:
    return {k: Typed(x.col[k], t) for k, t in x.t[1]}


def truncate(kind: str, unit: str, x: Typed, rest: Typed | None) -> Typed:
    start = let([local_of(x)], lambda local: _start(unit.lower(), local))
    out = _zoned(start, x.col["offset"], x.col["zone"]) if kind == "dt" and x.t == "dt" else _convert(kind, Typed(start, "ldt"))
    return _from_map(kind, {"datetime" if kind in ("dt", "ldt") else "date" if kind == "date" else "time": out} | fields(rest)) if rest is not None else out


def _start(low: str, local: Column) -> Column:
    """The first instant of the unit that a local date-time lies in."""
    day = local.cast("date")
    years = {"millennium": 1000, "century": 100, "decade": 10}
    if low in years:
        y = F.year(day)
        start = F.make_date(y - y % years[low], F.lit(1), F.lit(1)).cast("timestamp_ntz")
    elif low == "weekyear":
        first = F.make_date(F.date_part(F.lit("YEAROFWEEK"), day).cast("int"), F.lit(1), F.lit(4))
        start = F.date_sub(first, F.weekday(first)).cast("timestamp_ntz")
    elif low in ("year", "quarter", "month", "week"):
        start = F.trunc(day, low).cast("timestamp_ntz")
    elif low == "day":
        start = day.cast("timestamp_ntz")
    else:
        size = {"hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1000, "microsecond": 1}.get(low)
        if size is None:
            raise semantic("InvalidArgumentValue", f"no unit {low}")
        m = F.floor(local_micros(local)).cast("bigint")
        start = from_micros(m - F.pmod(m, F.lit(size)))
    return start


def between(a: Typed, b: Typed, kind: str = "between") -> Typed:
    """Whole months, then days, then the time that is left."""
    return Typed(let([a.col, b.col], lambda x, y: _between(Typed(x, a.t), Typed(y, b.t), kind)), "dur")


def _between(a: Typed, b: Typed, kind: str) -> Column:
    zero = F.lit(0).cast("bigint")
    if a.t in ("ltime", "time") or b.t in ("ltime", "time"):
        nanos = lambda v: v.col if v.t == "ltime" else v.col["nanos"] if v.t == "time" else time_nanos(local_of(v))
        return duration(zero, zero, zero, nanos(b) - nanos(a) if kind in ("between", "inseconds") else zero).col
    zoned = a.t == b.t == "dt"
    instant = lambda x: from_micros(F.floor(comparable(x)).cast("bigint")) if zoned else local_of(x)
    whole = lambda v: F.floor(local_micros(v)).cast("bigint")
    toward = lambda v, n: F.when(v >= 0, F.floor(v / n)).otherwise(F.ceil(v / n)).cast("bigint")
    day = 86_400_000_000

    def months_first(x: Column, y: Column) -> Column:
        moved = lambda n: let([F.add_months(x.cast("date"), n)], lambda d: _at(d, time_nanos(x)))
        months = ((F.year(y) - F.year(x)) * 12 + F.month(y) - F.month(x)).cast("int")
        fit = lambda n: F.when((n > 0) & (moved(n) > y), n - 1).when((n < 0) & (moved(n) < y), n + 1).otherwise(n)
        if kind == "inmonths":
            return let([months], lambda n: duration(fit(n), zero, zero, zero).col)
        rest = lambda n: let([whole(y) - whole(moved(n))], lambda left: let([toward(left, day)], lambda d: duration(n, d, zero, (left - d * day) * 1000).col))
        return let([let([months], fit)], rest)

    if kind in ("between", "inmonths"):
        return let([instant(a), instant(b)], months_first)
    total = lambda x, y: whole(y) - whole(x)
    if kind == "inseconds":
        return let([instant(a), instant(b)], lambda x, y: duration(zero, zero, zero, total(x, y) * 1000).col)
    return let([instant(a), instant(b)], lambda x, y: duration(zero, let([total(x, y)], lambda t: toward(t, day)), zero, zero).col)


def call(low: str, args: list[Typed]) -> Typed:
    head, _, tail = low.partition(".")
    kind = CONSTRUCTORS[head]
    if args and args[0].t == "null":
        return null()
    if tail == "truncate":
        return truncate(kind, _literal(args[0]), args[1], args[2] if len(args) > 2 else None)
    if kind == "dur" and tail in ("between", "inmonths", "indays", "inseconds"):
        return null() if "null" in (args[0].t, args[1].t) else between(args[0], args[1], tail)
    if kind == "dt" and tail == "fromepoch":
        return _zoned(from_micros(args[0].col * 1_000_000 + F.floor((args[1].col if len(args) > 1 else F.lit(0)) / 1000).cast("bigint")), F.lit(0), F.lit(None).cast("string"))
    if kind == "dt" and tail == "fromepochmillis":
        return _zoned(from_micros(args[0].col * 1000), F.lit(0), F.lit(None).cast("string"))
    if tail not in ("", "transaction", "statement", "realtime"):
        raise semantic("UnknownFunction", f"no function {low}")
    if not args:
        return _now(kind)
    x = args[0]
    if x.t in ("str", "any"):
        return _from_text(kind, x.col)
    if isinstance(x.t, tuple) and x.t[0] == "map":
        return _from_map(kind, fields(x))
    if is_temporal(x.t):
        return _convert(kind, x)
    raise mistyped(f"{head} of {x.t}")


def _literal(x: Typed) -> str:
    return str(x.col)[len("Column<'") : -len("'>")].strip("'")


def accessor(x: Typed, key: str) -> Typed:
    k = key.lower()
    if x.t == "dur":
        c = {p: x.col[p] for p in ("months", "days", "seconds", "nanos")}
        div = lambda a, b: F.call_function("div", a, F.lit(b).cast("bigint"))
        found = {
            "years": div(c["months"], 12), "quarters": div(c["months"], 3), "months": c["months"], "weeks": div(c["days"], 7), "days": c["days"],
            "hours": div(c["seconds"], 3600), "minutes": div(c["seconds"], 60), "seconds": c["seconds"],
            "milliseconds": c["seconds"] * 1000 + div(c["nanos"], 1_000_000), "microseconds": c["seconds"] * 1_000_000 + div(c["nanos"], 1000), "nanoseconds": c["seconds"] * 1_000_000_000 + c["nanos"],
            "monthsofyear": c["months"] % 12, "monthsofquarter": c["months"] % 3, "quartersofyear": div(c["months"] % 12, 3), "daysofweek": c["days"] % 7,
            "minutesofhour": div(c["seconds"], 60) % 60, "secondsofminute": c["seconds"] % 60,
            "millisecondsofsecond": div(c["nanos"], 1_000_000), "microsecondsofsecond": div(c["nanos"], 1000), "nanosecondsofsecond": c["nanos"],
        }.get(k)
    else:
        local = local_of(x)
        nanos = x.col if x.t == "ltime" else x.col["nanos"] if x.t == "time" else time_nanos(local)
        div = lambda a, b: F.floor(a / b)
        found = {
            "year": lambda: F.year(local), "month": lambda: F.month(local), "day": lambda: F.day(local), "ordinalday": lambda: F.dayofyear(local),
            "weekyear": lambda: F.date_part(F.lit("YEAROFWEEK"), local), "week": lambda: F.weekofyear(local), "dayofweek": lambda: F.weekday(local) + 1, "weekday": lambda: F.weekday(local) + 1,
            "quarter": lambda: F.quarter(local), "dayofquarter": lambda: F.datediff(local.cast("date"), F.trunc(local.cast("date"), "quarter")) + 1,
            "hour": lambda: div(nanos, 3_600_000_000_000), "minute": lambda: div(nanos, 60_000_000_000) % 60, "second": lambda: div(nanos, 1_000_000_000) % 60,
            "millisecond": lambda: div(nanos, 1_000_000) % 1000, "microsecond": lambda: div(nanos, 1000) % 1_000_000, "nanosecond": lambda: nanos % 1_000_000_000,
            "offsetseconds": lambda: x.col["offset"], "offsetminutes": lambda: F.call_function("div", x.col["offset"], F.lit(60)),
            "epochseconds": lambda: F.floor(comparable(x) / 1_000_000), "epochmillis": lambda: F.floor(comparable(x) / 1000),
        }.get(k)
        if k in ("timezone", "offset") and x.t in ("dt", "time"):
            text = offset_text(x.col["offset"])
            return Typed(F.coalesce(x.col["zone"], text) if k == "timezone" and x.t == "dt" else text, "str")
        found = found() if found is not None and (x.t in ("dt", "time") or not k.startswith(("offset", "epoch"))) else None
    if found is None:
        raise mistyped(f"{x.t} has no part {key}")
    return Typed(found.cast("bigint"), "int")


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    if a.t == b.t == "dur" and op in "+-":
        s = 1 if op == "+" else -1
        return duration(*(a.col[p] + b.col[p] * s for p in ("months", "days", "seconds", "nanos")))
    if "dur" in (a.t, b.t) and op in "*/" and ({a.t, b.t} & {"int", "float"}):
        d, n = (a, b) if a.t == "dur" else (b, a)
        k = n.col.cast("double") if op == "*" else 1 / n.col.cast("double")
        parts = {p: Typed(d.col[q].cast("double") * k, "float") for p, q in (("months", "months"), ("days", "days"), ("seconds", "seconds"), ("nanoseconds", "nanos"))}
        return _duration_of(parts)
    if a.t == "dur" and op == "+":
        a, b = b, a
    if b.t != "dur" or op not in "+-" or not is_temporal(a.t):
        raise mistyped(f"{op} of {a.t} and {b.t}")
    return Typed(let([a.col, b.col], lambda x, y: _moved(Typed(x, a.t), Typed(y, "dur"), 1 if op == "+" else -1)), a.t)


def _moved(a: Typed, b: Typed, s: int) -> Column:
    """Months first, clamped to the month's end, then days, then time."""
    if a.t in ("ltime", "time"):
        nanos = F.pmod((a.col if a.t == "ltime" else a.col["nanos"]) + (b.col["seconds"] * 1_000_000_000 + b.col["nanos"]) * s, F.lit(DAY_NANOS))
        return nanos if a.t == "ltime" else F.struct(nanos.alias("nanos"), a.col["offset"].alias("offset"))
    local = local_of(a)
    day = F.date_add(F.add_months(local.cast("date"), (b.col["months"] * s).cast("int")), (b.col["days"] * s).cast("int"))
    if a.t == "date":
        return F.date_add(day, (F.call_function("div", b.col["seconds"], F.lit(86400).cast("bigint")) * s).cast("int"))
    d = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400_000_000
    out = from_micros(d + F.floor((time_nanos(local) + (b.col["seconds"] * 1_000_000_000 + b.col["nanos"]) * s) / 1000).cast("bigint"))
    return out if a.t == "ldt" else _zoned(out, a.col["offset"], a.col["zone"]).col


def offset_text(offset: Column) -> Column:
    size = F.abs(offset)
    hm = F.format_string("%02d:%02d", F.floor(size / 3600), F.floor(size / 60) % 60)
    return F.when(offset == 0, F.lit("Z")).otherwise(F.concat(F.when(offset < 0, "-").otherwise("+"), hm))


def _clock(source: Column) -> Column:
    return let([source], _clock_of)


def _clock_of(nanos: Column) -> Column:
    whole = F.format_string("%02d:%02d", F.floor(nanos / 3_600_000_000_000), F.floor(nanos / 60_000_000_000) % 60)
    second, fraction = F.floor(nanos / 1_000_000_000) % 60, nanos % 1_000_000_000
    tail = F.regexp_replace(F.format_string(".%09d", fraction), r"0+$", "")
    return F.concat(whole, F.when((second != 0) | (fraction != 0), F.format_string(":%02d", second)).otherwise(""), F.when(fraction != 0, tail).otherwise(""))


def to_text(x: Typed) -> Column:
    return let([x.col], lambda c: _text(Typed(c, x.t)))


def _text(x: Typed) -> Column:
    if x.t == "date":
        return x.col.cast("string")
    if x.t == "ltime":
        return _clock(x.col)
    if x.t == "time":
        return F.concat(_clock(x.col["nanos"]), offset_text(x.col["offset"]))
    if x.t == "dur":
        c = x.col
        part = lambda v, mark: F.when(v != 0, F.concat(v.cast("string"), F.lit(mark))).otherwise("")
        div = lambda v, n: F.call_function("div", v, F.lit(n).cast("bigint"))
        days = F.concat(part(div(c["months"], 12), "Y"), part(c["months"] % 12, "M"), part(c["days"], "D"))
        total = c["seconds"].cast("decimal(28,9)") + (c["nanos"] / F.lit(1e9)).cast("decimal(28,9)")
        rest = (total % 60).cast("decimal(28,9)").cast("string")
        seconds = F.when(total % 60 != 0, F.concat(F.regexp_replace(rest, r"\.?0+$", ""), F.lit("S"))).otherwise("")
        clock = F.concat(part(div(c["seconds"], 3600), "H"), part(div(c["seconds"], 60) % 60, "M"), seconds)
        return F.when((days == "") & (clock == ""), "PT0S").otherwise(F.concat(F.lit("P"), days, F.when(clock != "", F.concat(F.lit("T"), clock)).otherwise("")))
    local = local_of(x)
    text = F.concat(local.cast("date").cast("string"), F.lit("T"), _clock(time_nanos(local)))
    if x.t == "ldt":
        return text
    return F.concat(text, offset_text(x.col["offset"]), F.when(x.col["zone"].isNotNull(), F.concat(F.lit("["), x.col["zone"], F.lit("]"))).otherwise(""))
