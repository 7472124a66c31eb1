"""Deadlines, years of experience and points in time in texts, as columns. The day of today is a parameter."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, functions as F

from siftline.functions import text as T, vocabulary as V

#: Stand where a phrase was found; what a text has of them is taken for blanks.
MARK, END = "\u0001", "\u0002"


def months() -> dict[str, int]:
    """Month names in all languages, with the short English and the partitive Finnish forms, to numbers; the first language wins."""
    english, finnish = V.MONTH_NAMES[0].split(), V.MONTH_NAMES[-1].split()
    out = {name: n for names in reversed(V.MONTH_NAMES) for n, name in enumerate(names.split(), 1)}
    return out | {x[:3]: n for n, x in enumerate(english, 1)} | {x + "ta": n for n, x in enumerate(finnish, 1)} | {"sept": 9}


def deadline_cue() -> str:
    """Pattern of a deadline phrase, with the character after it, which is no dash, as its group."""
    return r"\b(?:" + "|".join([*(c.replace(" ", r"\s+") for c in V.DEADLINE_CUES), V.DEADLINE_APPLY]) + r")\b([^-]|$)"


def month_pattern() -> str:
    return "(?:" + "|".join(sorted(months(), key=lambda x: (-len(x), x))) + ")"


def date_pattern() -> str:
    """Dates in numbers, year first or last, and with a month's name after or before the day."""
    m, tail = month_pattern(), r"(?:\s*,?\s*(?:de\s+)?[0-9]{4}\b)?"
    return "|".join((r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", r"\b[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}\b", rf"\b[0-9]{{1,2}}\.?\s*(?:de\s+)?{m}\b\.?{tail}", rf"\b{m}\b\.?\s+[0-9]{{1,2}}(?:st|nd|rd|th)?\b{tail}"))


def _day(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where there is none."""
    return F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")).try_cast("date")


def _read(found: Column, today: date) -> Column:
    """The date of a text that date_pattern() fits. Without a year it is this year's, or the next one's where that is well past; too far away is null."""
    table = F.create_map(*[F.lit(x) for kv in months().items() for x in kv])
    group = lambda p, i: F.nullif(F.regexp_extract(found, p, i), F.lit(""))
    iso, dotted = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$", r"^([0-9]{1,2})[./]([0-9]{1,2})[./]([0-9]{4})$"
    name = F.try_element_at(table, F.lower(F.regexp_extract(found, f"(?iu)({month_pattern()})", 1)))
    day, year = group(r"(?:^|[^0-9])([0-9]{1,2})(?:[^0-9]|$)", 1), group("([0-9]{4})", 1)
    this = _day(F.lit(today.year), name, day)
    guessed = F.when(this < F.date_sub(F.lit(today), V.YEAR_ROLLS_AFTER), _day(F.lit(today.year + 1), name, day)).otherwise(this)
    out = (
        F.when(found.rlike(iso), _day(group(iso, 1), group(iso, 2), group(iso, 3))).when(found.rlike(dotted), _day(group(dotted, 3), group(dotted, 2), group(dotted, 1)))
        .when(name.isNull(), F.lit(None).cast("date")).when(year.isNotNull(), _day(year, name, day)).otherwise(guessed)
    )
    return F.when(F.date_diff(out, F.lit(today)).between(-V.FARTHEST_BEHIND, V.FARTHEST_AHEAD), out)


def find_deadline(text: Column, today: date) -> Column:
    """The first readable date after a deadline phrase, within so many characters and its sentence.

    Phrases are marked and the text is cut there, so what follows each is an element; the dates of all, in order, are
    read, and the first that is one is it.
    """
    cue = "(?iu)" + deadline_cue()
    after = F.slice(F.split(F.regexp_replace(F.translate(text, MARK + END, "  "), cue, MARK + "$1"), MARK), 2, 1_000_000)
    windows = F.transform(after, lambda x: F.regexp_replace(F.substring(x, 1, V.DEADLINE_WINDOW), V.DEADLINE_STOP, "$1"))
    dates = F.flatten(F.transform(windows, lambda w: F.transform(F.regexp_extract_all(w, F.lit("(?iu)" + date_pattern()), F.lit(0)), lambda d: _read(d, today))))
    return F.when(_may_have_cue(text) & text.rlike(cue), F.get(F.filter(dates, lambda d: d.isNotNull()), 0))


def _may_have_cue(text: Column) -> Column:
    """Whether a text has the longest word of a deadline phrase, which it cannot do without; plain, so it is quick."""
    longest = {max(c.lower().split(), key=len) for c in V.DEADLINE_CUES} | {"apply"}
    return F.lower(text).rlike("|".join(sorted(longest))) | T.folds_oddly(text)


def years_required(text: Column) -> Column:
    """The first figure of years, 1 to 20, within 80 characters of words for experience. Figures are marked, and judged with what stands around them."""
    pieces = F.split(F.regexp_replace(F.translate(text, MARK + END, "  "), f"(?iu)({V.YEARS})", f"{MARK}$1{END}"), MARK)
    far = 1 + V.YEARS_WINDOW // 3  # a figure of years has three characters or more

    def judged(i: Column) -> Column:
        bare = lambda first, n: F.replace(F.array_join(F.slice(pieces, first, n), ""), F.lit(END), F.lit(""))
        figure = F.split_part(F.get(pieces, i), F.lit(END), F.lit(1))
        first = F.greatest(F.lit(1), i + 1 - far)
        around = F.concat(F.right(bare(first, i + 1 - first), F.lit(V.YEARS_WINDOW)), F.left(bare(i + 1, F.lit(far)), F.length(figure) + V.YEARS_WINDOW))
        n = F.regexp_extract(figure, "([0-9]{1,2})", 1).cast("int")
        return F.when(n.between(1, 20) & around.rlike("(?iu)" + V.EXPERIENCE), n)

    hits = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), judged)
    return F.when(F.size(pieces) > 1, F.get(F.filter(hits, lambda n: n.isNotNull()), 0))


def parse_date(value: Column) -> Column:
    """ISO, RFC 2822, seconds or milliseconds, day.month.year and Portuguese texts (2 de março de 2024, 2-3-2024), as UTC."""
    s = F.trim(value.cast("string"))
    number = F.when(s.rlike(r"^[0-9]{9,13}$"), s.cast("double"))
    mail = F.regexp_replace(F.regexp_replace(s, r"^[A-Za-z]{3},\s*", ""), r"\s*(?:GMT|UTC|UT|Z)$", " +0000")
    table = F.create_map(*[F.lit(x) for kv in months().items() for x in kv])
    named = r"(?iu)^([0-9]{1,2})\.?\s+(?:de\s+)?(\p{L}+)\.?\s+(?:de\s+)?([0-9]{4})$"
    dotted = r"^([0-9]{1,2})[.-]([0-9]{1,2})[.-]([0-9]{4})"
    at = lambda p, i: F.regexp_extract(s, p, i)
    spoken = F.when(s.rlike(named), _day(at(named, 3), F.try_element_at(table, F.lower(at(named, 2))), at(named, 1)))
    return F.coalesce(
        F.timestamp_seconds(F.when(number > 1e12, number / 1000).otherwise(number)),
        F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), s.try_cast("timestamp")),
        F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss xx")),
        F.when(s.rlike(dotted), _day(at(dotted, 3), at(dotted, 2), at(dotted, 1)).cast("timestamp")),
        spoken.cast("timestamp"),
    )


def relative_day(text: Column, today: date) -> Column:
    """The day of texts such as "3 days ago", "yesterday", "2 weeks ago" or "há 3 dias", counted back from today; null for others."""
    low = F.lower(F.trim(text))
    n = F.coalesce(F.nullif(F.regexp_extract(low, r"([0-9]+)\+?", 1), F.lit("")).try_cast("int"), F.lit(1))
    out = F.when(low.rlike(r"\b(?:today|just now|just posted|hoje)\b|\b(?:hours?|minutes?|horas?|minutos?)\b"), F.lit(today)).when(low.rlike(r"\b(?:yesterday|ontem)\b"), F.date_sub(F.lit(today), 1))
    for unit, days in ((r"days?|dias?", 1), (r"weeks?|semanas?", 7), (r"months?|m[eê]s(?:es)?", 30)):
        out = out.when(low.rlike(rf"\b(?:{unit})\b"), F.date_sub(F.lit(today), n * days))
    return out


def parse_pt_date(value: Column, today: date) -> Column:
    """The day of a Portuguese posting date: hoje, ontem, anteontem, "há 3 dias", "9 set" (this year's, or the last one's where it would lie ahead), "28 de Agosto de 2026", else as parse_date()."""
    low = F.lower(F.regexp_replace(F.trim(value), r"\s+", " "))
    now, relative, named = F.lit(today), r"h[áa]\s+([0-9]+)\s*(minuto|hora|dia|semana|m[êe]s|mes)", r"([0-9]{1,2})\s*(?:de\s+)?([a-zç]+)\.?(?:\s*(?:de\s+)?([0-9]{4}))?"
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    back = F.regexp_extract(low, relative, 1).try_cast("int") * F.coalesce(F.try_element_at(table(V.PT_DAYS), F.regexp_extract(low, relative, 2)), F.lit(30))
    month = F.try_element_at(table(V.PT_MONTHS), F.left(F.regexp_extract(low, named, 2), F.lit(3)))
    day, year = F.regexp_extract(low, named, 1), F.nullif(F.regexp_extract(low, named, 3), F.lit(""))
    this = _day(F.lit(today.year), month, day)
    spoken = F.when(year.isNotNull(), _day(year, month, day)).when(this > F.date_add(now, 1), _day(F.lit(today.year - 1), month, day)).otherwise(this)
    return (
        F.when(low.startswith("hoje"), now).when(low.startswith("anteontem"), F.date_sub(now, 2)).when(low.startswith("ontem"), F.date_sub(now, 1))
        .when(low.rlike(relative), F.date_sub(now, back)).when(low.rlike(named) & month.isNotNull(), spoken).otherwise(parse_date(value).cast("date"))
    )
