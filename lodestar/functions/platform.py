"""Platform scalar functions as Spark expressions, under their English and Russian names.

Every function takes Columns (or literals) and returns a Column that stays in
generated code.  Strings count from 1, dates are timestamps without zone, weeks
start on Monday, comparison of strings ignores case.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _floor(unit: str) -> Callable[[Any], Column]:
    return lambda d: F.date_trunc(unit, col(d)).cast("timestamp_ntz")


_NEXT = {
    "YEAR": "INTERVAL 1 YEAR",
    "QUARTER": "INTERVAL 3 MONTH",
    "MONTH": "INTERVAL 1 MONTH",
    "WEEK": "INTERVAL 7 DAY",
    "DAY": "INTERVAL 1 DAY",
    "HOUR": "INTERVAL 1 HOUR",
    "MINUTE": "INTERVAL 1 MINUTE",
}


def _ceil(unit: str) -> Callable[[Any], Column]:
    """The last second of the period."""
    return lambda d: _floor(unit)(d) + F.expr(_NEXT[unit]) - F.expr("INTERVAL 1 SECOND")


def _compare(a: Any, b: Any) -> Column:
    x, y = F.lower(col(a)), F.lower(col(b))
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def _occurrences(s: Any, part: Any) -> Column:
    s, part = col(s), col(part)
    return F.when(F.length(part) == 0, 0).otherwise(((F.length(s) - F.length(F.replace(s, part, F.lit("")))) / F.length(part)).cast("int"))


def _lines(s: Any) -> Column:
    return F.split(col(s), "\n")


def _add_month(d: Any, n: Any) -> Column:
    """add_months with the time of day kept."""
    d = col(d).cast("timestamp_ntz")
    day = F.date_trunc("DAY", d).cast("timestamp_ntz")
    return F.add_months(d, col(n)).cast("timestamp_ntz") + (d - day)


def _char(code: Any) -> Column:
    """The character of any code point: built as UTF-32 and decoded."""
    return F.decode(F.unhex(F.lpad(F.hex(col(code).cast("long")), 8, "0")), "UTF-32")


def _code(s: Any, place: Any = 1) -> Column:
    one = F.substring(col(s), col(place), F.lit(1))
    return F.conv(F.hex(F.encode(one, "UTF-32")), 16, 10).cast("long")


def _filled(x: Any) -> Column:
    s = col(x).cast("string")
    return F.coalesce((F.trim(s) != "") & ~s.isin("0", "0.0", "0001-01-01 00:00:00", "false"), F.lit(False))


FUNCTIONS: dict[str, Callable[..., Column]] = {
    # strings
    "StrLen": lambda s: F.length(col(s)),
    "StrFind": lambda s, part: F.instr(col(s), col(part)),
    "Left": lambda s, n: F.left(col(s), col(n)),
    "Right": lambda s, n: F.right(col(s), col(n)),
    "Mid": lambda s, start, n=2**31 - 1: F.substring(col(s), col(start), col(n)),
    "TrimL": lambda s: F.ltrim(col(s)),
    "TrimR": lambda s: F.rtrim(col(s)),
    "TrimAll": lambda s: F.trim(col(s)),
    "Upper": lambda s: F.upper(col(s)),
    "Lower": lambda s: F.lower(col(s)),
    "Title": lambda s: F.initcap(col(s)),
    "StrReplace": lambda s, a, b: F.replace(col(s), col(a), col(b)),
    "StrOccurrenceCount": _occurrences,
    "StrLineCount": lambda s: F.size(_lines(s)),
    "StrGetLine": lambda s, n: F.coalesce(F.get(_lines(s), col(n) - 1), F.lit("")),
    "StrConcat": lambda parts, by="": F.array_join(col(parts), by),
    "StrSplit": lambda s, by: F.split(col(s), r"[" + "".join("\\" + c for c in by) + "]"),
    "StrCompare": _compare,
    "StrStartsWith": lambda s, part: F.startswith(col(s), col(part)),
    "StrEndsWith": lambda s, part: F.endswith(col(s), col(part)),
    "Char": _char,
    "CharCode": _code,
    "IsBlankString": lambda s: F.trim(F.regexp_replace(col(s), r"\s", "")) == "",
    # numbers
    "Round": lambda x, n=0: F.round(col(x), n),
    "Int": lambda x: col(x).cast("bigint"),
    "Min": lambda *xs: F.least(*map(col, xs)),
    "Max": lambda *xs: F.greatest(*map(col, xs)),
    "Pow": lambda x, y: F.pow(col(x), col(y)),
    "Sqrt": lambda x: F.sqrt(col(x)),
    "Exp": lambda x: F.exp(col(x)),
    "Log": lambda x: F.ln(col(x)),
    "Log10": lambda x: F.log10(col(x)),
    "Sin": lambda x: F.sin(col(x)),
    "Cos": lambda x: F.cos(col(x)),
    "Tan": lambda x: F.tan(col(x)),
    "ASin": lambda x: F.asin(col(x)),
    "ACos": lambda x: F.acos(col(x)),
    "ATan": lambda x: F.atan(col(x)),
    # dates
    "CurrentDate": lambda: F.localtimestamp(),
    "CurrentSessionDate": lambda: F.localtimestamp(),
    "CurrentUniversalDate": lambda: F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz"),
    "Date": lambda y, m=1, d=1, h=0, mi=0, s=0: F.make_timestamp_ntz(col(y), col(m), col(d), col(h), col(mi), col(s)),
    "Year": lambda d: F.year(col(d)),
    "Month": lambda d: F.month(col(d)),
    "Day": lambda d: F.day(col(d)),
    "Hour": lambda d: F.hour(col(d)),
    "Minute": lambda d: F.minute(col(d)),
    "Second": lambda d: F.second(col(d)),
    "DayOfYear": lambda d: F.dayofyear(col(d)),
    "WeekDay": lambda d: F.weekday(col(d)) + 1,
    "WeekOfYear": lambda d: F.weekofyear(col(d)),
    "BegOfYear": _floor("YEAR"),
    "EndOfYear": _ceil("YEAR"),
    "BegOfQuarter": _floor("QUARTER"),
    "EndOfQuarter": _ceil("QUARTER"),
    "BegOfMonth": _floor("MONTH"),
    "EndOfMonth": _ceil("MONTH"),
    "BegOfWeek": _floor("WEEK"),
    "EndOfWeek": _ceil("WEEK"),
    "BegOfDay": _floor("DAY"),
    "EndOfDay": _ceil("DAY"),
    "BegOfHour": _floor("HOUR"),
    "EndOfHour": _ceil("HOUR"),
    "BegOfMinute": _floor("MINUTE"),
    "EndOfMinute": _ceil("MINUTE"),
    "AddMonth": _add_month,
    # types
    "Type": lambda name: F.lit(name),
    "TypeOf": lambda x: F.typeof(col(x)),
    "String": lambda x: F.coalesce(col(x).cast("string"), F.lit("")),
    "Number": lambda x: col(x).try_cast("decimal(38,10)"),
    "Boolean": lambda x: col(x).cast("boolean"),
    "ValueIsFilled": _filled,
    "ValueToStringInternal": lambda *xs: F.to_json(F.struct(*xs)),
    "ValueFromStringInternal": lambda s: F.parse_json(col(s)),
    "XMLString": lambda x: col(x).cast("string"),
    "XMLValue": lambda kind, s: col(s).cast(kind),
    "Format": lambda x, pattern: F.date_format(col(x), pattern),
}

# Russian names of the functions.
RUSSIAN = {
    "СтрДлина": "StrLen",
    "СтрНайти": "StrFind",
    "Лев": "Left",
    "Прав": "Right",
    "Сред": "Mid",
    "СокрЛ": "TrimL",
    "СокрП": "TrimR",
    "СокрЛП": "TrimAll",
    "ВРег": "Upper",
    "НРег": "Lower",
    "ТРег": "Title",
    "СтрЗаменить": "StrReplace",
    "СтрЧислоВхождений": "StrOccurrenceCount",
    "СтрЧислоСтрок": "StrLineCount",
    "СтрПолучитьСтроку": "StrGetLine",
    "СтрСоединить": "StrConcat",
    "СтрРазделить": "StrSplit",
    "СтрСравнить": "StrCompare",
    "СтрНачинаетсяС": "StrStartsWith",
    "СтрЗаканчиваетсяНа": "StrEndsWith",
    "Символ": "Char",
    "КодСимвола": "CharCode",
    "ПустаяСтрока": "IsBlankString",
    "Окр": "Round",
    "Цел": "Int",
    "Мин": "Min",
    "Макс": "Max",
    "ТекущаяДата": "CurrentDate",
    "Дата": "Date",
    "Год": "Year",
    "Месяц": "Month",
    "День": "Day",
    "Час": "Hour",
    "Минута": "Minute",
    "Секунда": "Second",
    "ДеньГода": "DayOfYear",
    "ДеньНедели": "WeekDay",
    "НеделяГода": "WeekOfYear",
    "НачалоГода": "BegOfYear",
    "КонецГода": "EndOfYear",
    "НачалоКвартала": "BegOfQuarter",
    "КонецКвартала": "EndOfQuarter",
    "НачалоМесяца": "BegOfMonth",
    "КонецМесяца": "EndOfMonth",
    "НачалоНедели": "BegOfWeek",
    "КонецНедели": "EndOfWeek",
    "НачалоДня": "BegOfDay",
    "КонецДня": "EndOfDay",
    "ДобавитьМесяц": "AddMonth",
    "ТипЗнч": "TypeOf",
    "Строка": "String",
    "Число": "Number",
    "Булево": "Boolean",
    "ЗначениеЗаполнено": "ValueIsFilled",
    "Формат": "Format",
}
_BY_LOWER = {k.lower(): v for k, v in FUNCTIONS.items()} | {k.lower(): FUNCTIONS[v] for k, v in RUSSIAN.items()}


def call(name: str, *arguments: Any) -> Column:
    """The function of that name (either language, any case) on these arguments."""
    try:
        return _BY_LOWER[name.lower()](*arguments)
    except KeyError:
        raise ValueError(f"no platform function {name!r}") from None
