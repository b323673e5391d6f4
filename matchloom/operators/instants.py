"""Mixed time stamps to UTC instants: an ordered cascade of anchored patterns.

Each text is rewritten by the first pattern that matches it as a whole into
fields parted by ``|``; the fields are then checked strictly (no 30 February,
no 25th hour, no 13 pm). Everything stays in built-in expressions on
``timestamp_ntz``, so the session's time zone never matters.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions.columns import let, lookup

# Month names by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# Zone abbreviations of Europe, North America and Japan, minutes east of UTC.
ABBREVIATIONS = {
    "utc": 0, "gmt": 0, "z": 0,
    "wet": 0, "west": 60, "bst": 60, "ist": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180,
    "nst": -210, "ndt": -150, "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300,
    "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "hdt": -540,
    "jst": 540,
}

_MONTH = r"([a-z]{3,9})\.?"
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"

#: Ordered date patterns; each gives year|month|day. ``$d`` of slashed dates depends on the order in use.
DATE_PATTERNS = (
    (rf"^{_WEEKDAY}(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})$", "$1|$2|$3"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1|$2|$3"),
    (rf"^{_WEEKDAY}(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})$", "$3|$2|$1"),
    (rf"^{_WEEKDAY}(\d{{1,2}})\s+{_MONTH},?\s+(\d{{4}})$", "$3|$2|$1"),
    (rf"^{_WEEKDAY}{_MONTH}\s+(\d{{1,2}}),?\s+(\d{{4}})$", "$3|$1|$2"),
)
SLASHED = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"

_ZONE = r"(.*)"
#: Ordered time patterns; each gives hour|minute|second|half|zone.
TIME_PATTERNS = (
    (rf"^(\d{{1,2}})[:.h](\d{{2}})(?:[:.](\d{{2}})(?:[.,]\d+)?)?\s*([ap])\.?m\.?(?![a-z])\s*{_ZONE}$", "$1|$2|$3|$4|$5"),
    (rf"^(\d{{1,2}})\s*([ap])\.?m\.?(?![a-z])\s*{_ZONE}$", "$1|00||$2|$3"),
    (rf"^(\d{{1,2}})[:.h](\d{{2}})(?:[:.](\d{{2}})(?:[.,]\d+)?)?\s*{_ZONE}$", "$1|$2|$3||$4"),
    (r"^(\d{2})(\d{2})(\d{2})?(?:[.,]\d+)?\s*((?:[z+-]|utc|gmt).*|)$", "$1|$2|$3||$4"),
)

#: Sources that write slashed dates with the month first.
MONTH_FIRST = ("stadia9",)

#: A moment's text parts into a date and a time of day at one of these.
SPLIT = (
    rf"^({_WEEKDAY}\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}|\d{{8}}|\d{{1,2}}/\d{{1,2}}/\d{{4}}"
    rf"|{_WEEKDAY}\d{{1,2}}\.\d{{1,2}}\.\d{{4}}|{_WEEKDAY}\d{{1,2}}\s+[a-z]{{3,9}}\.?,?\s+\d{{4}}"
    rf"|{_WEEKDAY}[a-z]{{3,9}}\.?\s+\d{{1,2}},?\s+\d{{4}})(?:t|,?\s+)(\d.*)$"
)


def tidy(text: Column) -> Column:
    """Lower case, plain minus signs and single plain spaces."""
    plain = F.translate(text, "−–‒‐   　", "----    ")
    return F.lower(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def cascade(text: Column, patterns) -> Column:
    """The rewriting by the first pattern that matches, else null."""
    return let(text, lambda x: _first_match(x, patterns))


def _first_match(text: Column, patterns) -> Column:
    return reduce(lambda rest, p: F.when(text.rlike(p[0]), F.regexp_replace(text, p[0], p[1])).otherwise(rest), reversed(patterns), F.lit(None).cast("string"))


def _int(text: Column) -> Column:
    return text.try_cast("int")


def date_fields(date: Column, month_first: Column) -> Column:
    """year|month|day of a tidy date; null where nothing matches."""
    fields = cascade(date, (*DATE_PATTERNS, (SLASHED, "$3|$2|$1")))
    return F.when(month_first & date.rlike(SLASHED), F.regexp_replace(date, SLASHED, "$3|$1|$2")).otherwise(fields)


def _month(text: Column) -> Column:
    names = lookup((name, i + 1) for i, name in enumerate(MONTHS))
    return F.coalesce(_int(text), F.try_element_at(names, F.substring(text, 1, 3)))


def known_zones(spark: SparkSession) -> list[str]:
    """Names of the regions that the running JVM has rules for."""
    return sorted(z for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds() if "/" in z)


def offset_minutes(zone: Column) -> Column:
    """Minutes east of UTC that a tidy zone text states by number or abbreviation, else null."""
    return let(zone, _offset)


def _offset(zone: Column) -> Column:
    pattern = r"^(?:utc|gmt)?\s*([+-])\s*(\d{1,2})(?::?(\d{2}))?$"
    fields = F.split(F.regexp_replace(zone, pattern, "$1|$2|$3"), r"\|")
    hours, rest = _int(F.get(fields, F.lit(1))), F.coalesce(_int(F.get(fields, F.lit(2))), F.lit(0))
    sign = F.when(F.get(fields, F.lit(0)) == "-", -1).otherwise(1)
    numeric = F.when(zone.rlike(pattern) & (hours <= 18) & (rest < 60), sign * (hours * 60 + rest))
    return F.coalesce(numeric, F.try_element_at(lookup(ABBREVIATIONS.items()), zone))


def with_instant(df: DataFrame, out: str, date: Column, time: Column, month_first: Column, default_zone: Column) -> DataFrame:
    """df with ``out``: the UTC instant (``timestamp_ntz``) of a tidy date and a tidy time of day.

    A zone in the text wins over ``default_zone``, an offset over a region in
    brackets. Without any (default null) or with an unknown zone the result is
    null. A local time that occurs twice means the earlier instant; one that a
    clock change skips is moved forward by the length of the gap.
    """
    spark = df.sparkSession
    t, d = F.col("__t"), F.col("__d")
    hour, half = _int(t[0]), t[3]
    clock = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    second = F.when(t[2] == "", F.lit(0)).otherwise(_int(t[2]))
    regions = lookup((z.lower(), z) for z in known_zones(spark))
    # Each step is a projection of its own, so that no pattern runs once per later use.
    steps = (
        df.withColumns({"__d": F.split(date_fields(date, month_first), r"\|"), "__t": F.split(cascade(time, TIME_PATTERNS), r"\|"), "__z": default_zone})
        .withColumns(
            {
                "__local": F.call_function("try_make_timestamp_ntz", _int(d[0]), _month(d[1]), _int(d[2]), clock, _int(t[1]), second.cast("decimal(16,6)")),
                "__zone": F.trim(F.regexp_replace(t[4], r"\s*\[[a-z0-9_/+-]+\]$", "")),
                "__bracket": F.regexp_extract(t[4], r"\[([a-z0-9_/+-]+)\]$", 1),
            }
        )
        .withColumn("__named", F.when(F.col("__zone") != "", F.col("__zone")).when(F.col("__bracket") != "", F.col("__bracket")).otherwise(tidy(F.col("__z"))))
        .withColumn("__minutes", offset_minutes(F.col("__named")))
        .withColumn(
            out,
            F.when(F.col("__minutes").isNotNull(), F.col("__local") - F.make_dt_interval(mins=F.col("__minutes"))).otherwise(
                F.convert_timezone(F.try_element_at(regions, F.col("__named")), F.lit("UTC"), F.col("__local"))
            ),
        )
    )
    return steps.drop("__d", "__t", "__z", "__local", "__zone", "__bracket", "__named", "__minutes")


def parse_moments(df: DataFrame, out: str, text: Column, month_first: Column, default_zone: Column) -> DataFrame:
    """df with ``out``: the UTC instant (``timestamp_ntz``) of a text that states date and time of day.

    Digits alone (9 to 11, or 12 to 14 of them) are Unix time in seconds or
    milliseconds. Null, empty, blank and unreadable texts, dates without a time
    and fields out of range give null. df's other columns stay as they are;
    repeated rows are kept.
    """
    clean, number = F.col("__clean"), F.col("__number")
    seconds = F.when(F.length(clean) >= 12, F.floor(number / 1000)).otherwise(number)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    rows = df.withColumn("__clean", tidy(text)).withColumns(
        {
            "__number": F.when(clean.rlike(r"^\d{9,14}$") & ~clean.rlike(r"^\d{8}$"), clean.try_cast("bigint")),
            "__parts": F.split(F.regexp_replace(clean, SPLIT, "$1\u0001$2"), "\u0001"),
        }
    )
    parts = F.col("__parts")
    rows = rows.withColumns({"__date": F.when(F.size(parts) == 2, parts[0]), "__time": F.when(F.size(parts) == 2, parts[1])}).drop("__parts")
    spoken = with_instant(rows, "__spoken", F.col("__date"), F.col("__time"), month_first, default_zone)
    return spoken.withColumn(out, F.when(number.isNotNull(), epoch).otherwise(F.col("__spoken"))).drop("__clean", "__number", "__date", "__time", "__spoken")


def iso_utc(instant: Column) -> Column:
    """'yyyy-MM-ddTHH:mm:ssZ' with fractions cut off."""
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def payload_text(payload: Column, path: str) -> Column:
    """A text inside JSON; JSON text inside a JSON string is read as well; null where unreadable."""
    v = F.try_parse_json(payload)
    inner = F.try_parse_json(F.try_variant_get(v, "$", "string"))
    return F.coalesce(F.try_variant_get(v, path, "string"), F.when(payload.rlike(r'^\s*"'), F.try_variant_get(inner, path, "string")))


def match_instants(matches: DataFrame, month_first: Collection[str] = MONTH_FIRST) -> DataFrame:
    """(match_id, source, instant) of the matches, null where the text states no moment; ``month_first``: sources that write slashed dates so."""
    rows = matches.select("match_id", "source", "kickoff_utc", F.coalesce(payload_text(F.col("payload"), "$.venue_tz"), F.lit("UTC")).alias("tz"))
    us = F.coalesce(F.col("source").isin(*month_first), F.lit(False))
    return parse_moments(rows, "instant", F.col("kickoff_utc"), us, F.col("tz")).select("match_id", "source", "instant")


def stated_date(text: Column, month_first: Column) -> Column:
    """The date in a text as written, with or without a readable time of day, else null."""
    fields = F.split(date_fields(F.regexp_replace(tidy(text), SPLIT, "$1"), month_first), r"\|")
    made = lambda d: F.call_function("try_make_timestamp_ntz", _int(d[0]), _month(d[1]), _int(d[2]), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))
    return let(fields, made).cast("date")


def moments_of_matches(matches: DataFrame, zone: Column, month_first: Collection[str] = MONTH_FIRST) -> DataFrame:
    """matches with ``instant`` and ``stated`` of their kickoff_utc, local to ``zone`` where it names none; no row is lost or moved."""
    us = F.coalesce(F.col("source").isin(*month_first), F.lit(False))
    return parse_moments(matches.withColumn("stated", stated_date(F.col("kickoff_utc"), us)), "instant", F.col("kickoff_utc"), us, F.coalesce(zone, F.lit("UTC")))


def worldcup_instants(worldcup: DataFrame) -> DataFrame:
    """(wc_id, instant) of the schedule; a record without offset or zone states no instant."""
    rows = worldcup.select("wc_id", tidy(F.col("date")).alias("date"), tidy(F.col("time")).alias("time"))
    return with_instant(rows, "instant", F.col("date"), F.col("time"), F.lit(False), F.lit(None).cast("string")).select("wc_id", "instant")


def normalise_moments(matches: DataFrame, worldcup: DataFrame) -> DataFrame:
    """Distinct (tab, rec_key, instant_utc) of all records that state a moment."""
    a = match_instants(matches).select(F.lit("matches").alias("tab"), F.col("match_id").alias("rec_key"), iso_utc(F.col("instant")).alias("instant_utc"))
    b = worldcup_instants(worldcup).select(F.lit("worldcup").alias("tab"), F.col("wc_id").cast("string").alias("rec_key"), iso_utc(F.col("instant")).alias("instant_utc"))
    return a.unionByName(b).where("instant_utc is not null and rec_key is not null").distinct()
