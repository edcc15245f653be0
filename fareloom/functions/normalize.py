"""Scalar normalisers as column expressions; none of them needs Python at run time."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from fareloom.constants import BARE_SOURCES, CITY_CODES, STATUS_ALIASES


def code(value: Column) -> Column:
    """Trimmed upper case; null becomes the empty code."""
    return F.upper(F.trim(F.coalesce(value, F.lit(""))))


def flight_number(value: Column, carrier: Column) -> Column:
    """Without blanks and dashes; a bare number gets its carrier in front."""
    bare = F.regexp_replace(code(value), "[ -]", "")
    return F.when(bare.rlike("^[0-9]+$"), F.concat(code(carrier), bare)).otherwise(bare)


def departure_time(value: Column) -> Column:
    """HH:MM of an ISO timestamp or a clock time, null if it is neither."""
    clock = F.regexp_extract(value, "(?:^|[T ])([0-9]{1,2}):([0-9]{2})", 1)
    minutes = F.regexp_extract(value, "(?:^|[T ])([0-9]{1,2}):([0-9]{2})", 2)
    return F.when(clock != "", F.concat(F.lpad(clock, 2, "0"), F.lit(":"), minutes))


def date_text(value: Column) -> Column:
    """The part in front of the T of an ISO timestamp."""
    return F.substring_index(F.trim(value), "T", 1)


def timestamp(value: Column) -> Column:
    """ISO text, a few local formats, or epoch seconds or milliseconds (above 1e11); null otherwise."""
    number = value.try_cast("double")
    seconds = F.when(F.abs(number) > 1e11, number / 1000).otherwise(number)
    texts = [F.try_to_timestamp(value)] + [F.try_to_timestamp(value, F.lit(f)) for f in ("dd/MM/yyyy HH:mm", "dd-MM-yyyy HH:mm", "dd/MM/yyyy", "dd-MM-yyyy")]
    return F.coalesce(F.when(number.isNotNull(), F.timestamp_millis((seconds * 1000).cast("long"))), *texts)


def booking_window(value: Column, default: str = "T+1") -> Column:
    """T+n from any spelling that has the number of days; null gets the default."""
    digits = F.regexp_extract(value, "([0-9]+)", 1)
    return F.when(value.isNull(), F.lit(default)).when(digits != "", F.concat(F.lit("T+"), digits.cast("int").cast("string"))).otherwise(code(value))


def window_days(value: Column) -> Column:
    """Days of a window tag, null without digits."""
    return F.regexp_extract(value, "([0-9]+)", 1).try_cast("int")


def window_of_range(value: Column) -> Column:
    """Window of a range of days such as 4-7d."""
    return F.when(value == "1-3d", "T+1").when(value == "4-7d", "T+7").when(value == "8-14d", "T+15").when(value == "15-30d", "T+30").otherwise(value)


def fare(value: Column) -> Column:
    """A positive amount from text with currency signs and commas, two places; null otherwise."""
    amount = F.regexp_extract(F.regexp_replace(value, ",", ""), "([0-9]+(?:\\.[0-9]+)?)", 1).try_cast("double")
    return F.when(amount > 0, F.round(amount, 2))


def status(value: Column) -> Column:
    """Canonical flight status; unknown ones stay in lower case, empty becomes null."""
    return status_of(status_token(value))


def status_token(value: Column) -> Column:
    return F.translate(F.lower(F.trim(value)), "- ", "__")


def status_of(token: Column) -> Column:
    """The status of a ``status_token``."""
    known = F.create_map(*(F.lit(x) for pair in STATUS_ALIASES.items() for x in pair))
    return F.when(token != "", F.coalesce(F.try_element_at(known, token), token))


def booking_class(value: Column) -> Column:
    return F.nullif(F.upper(F.trim(value)), F.lit(""))


def route_pair(value: Column) -> Column:
    """Struct of origin and destination of AAA-BBB, null for anything else."""
    parts = F.split(code(value), "-")
    fits = (F.size(parts) == 2) & (F.length(F.get(parts, F.lit(0))) == 3) & (F.length(F.get(parts, F.lit(1))) == 3)
    return F.when(fits, F.struct(F.get(parts, F.lit(0)).alias("origin"), F.get(parts, F.lit(1)).alias("destination")))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts joined by colons; null counts as empty."""
    return F.sha2(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def duration_minutes(supplied: Column, departure: Column, arrival: Column) -> Column:
    """A supplied positive duration, else whole minutes between departure and a later arrival; null without departure."""
    computed = F.when(arrival > departure, F.floor((F.unix_timestamp(arrival) - F.unix_timestamp(departure)) / 60))
    return F.when(departure.isNotNull(), F.coalesce(F.when(supplied > 0, supplied.cast("long")), computed))


def reasons(*checks: tuple[Column, str]) -> Column:
    """The names of all checks that are not true, in order."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in checks)))


def cites_source(value: Column) -> Column:
    """True for a text that holds a link and is more than a bare label."""
    link = value.contains("http://") | value.contains("https://")
    return F.coalesce(link & ~F.lower(F.trim(value)).isin(*BARE_SOURCES), F.lit(False))


def city_code(value: Column) -> Column:
    """Airport of a city name: Mumbai's second airport by its name in the text, a known city without what stands in
    brackets behind it, and any other name as it is, in upper case."""
    name = code(value)
    base = F.trim(F.substring_index(name, "(", 1))
    known = F.create_map(*(F.lit(x) for pair in CITY_CODES.items() for x in pair))
    return F.when(name.startswith("MUMBAI"), F.when(name.contains("NAVI"), "NMI").otherwise("BOM")).otherwise(F.coalesce(F.try_element_at(known, base), base))


def iata(value: Column) -> Column:
    """Three letters in upper case, null for anything else."""
    return F.when(code(value).rlike("^[A-Z]{3}$"), code(value))


def carrier_code(value: Column) -> Column:
    """Two letters or digits in upper case, null for anything else."""
    return F.when(code(value).rlike("^[A-Z0-9]{2}$"), code(value))


def minutes(value: Column) -> Column:
    """A positive whole number of minutes from text or number; null for anything else, truth values included."""
    number = value.try_cast("double")
    return F.when((number > 0) & (F.floor(number) == number), number.cast("long"))


def amount(value: Column) -> Column:
    """A supplied amount: blank is null, zero stays."""
    return F.trim(value).try_cast("double")


def stored_window(value: Column) -> Column:
    """The window tag of a stored record: T+n of a bare number or Tn, null is T+1, anything else in upper case."""
    return window_of(F.upper(F.trim(value)))


def window_of(tag: Column) -> Column:
    """The same of a tag in upper case, without blanks around it."""
    days = F.regexp_extract(tag, "^(?:T[+]?)?([0-9]+)$", 1)
    known = tag.rlike(r"^(?:[0-9]+$|T(?:1|7|15|30|45)\z)")
    return F.when(tag.isNull(), F.lit("T+1")).when(known, F.concat(F.lit("T+"), days)).otherwise(tag)


def pipeline_window(value: Column) -> Column:
    """The window tag of the daily run: T+n for n, Tn and T+n of the known windows, T+7 for nothing, anything else in upper case."""
    tag = code(value)
    known = tag.rlike("^(T[+]?)?(1|7|15|30|45)$")
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit("T+7")).when(known, F.concat(F.lit("T+"), F.regexp_extract(tag, "([0-9]+)", 1))).otherwise(tag)


def engine_window(value: Column) -> Column:
    """The window tag of the index engine: without plus signs, with a T in front of a bare number."""
    tag = F.regexp_replace(code(value), "[+]", "")
    return F.when(tag.rlike("^[0-9]+$"), F.concat(F.lit("T"), tag)).otherwise(tag)


def series_window(value: Column) -> Column:
    """The window tag of elasticities: T+ or T- stay, a T gets its plus, anything else T+ in front."""
    tag = code(value)
    rest = F.when(F.startswith(tag, F.lit("T")), F.substring(tag, 2, 100)).otherwise(tag)
    return F.when(tag.rlike("^T[+-]"), tag).otherwise(F.concat(F.lit("T+"), rest))


def record_key(carrier: Column, number: Column, origin: Column, destination: Column, departure: Column, window: Column) -> Column:
    """Fingerprint of a stored observation."""
    return fingerprint(F.upper(carrier), F.upper(number), F.upper(origin), F.upper(destination), departure, window)


def flight_key(carrier: Column, number: Column, origin: Column, destination: Column, day: Column, clock: Column, cabin: Column) -> Column:
    """Fingerprint of a flight in a quote stream; the cabin is economy if it isn't given."""
    seat = F.coalesce(F.nullif(F.lower(F.trim(cabin)), F.lit("")), F.lit("economy"))
    return fingerprint(code(carrier), flight_number(number, carrier), code(origin), code(destination), date_text(day), departure_time(clock), seat)
