"""Flight payloads of any shape as flat quotes: JSON is read as VARIANT, so that no schema has to name every field.

The first place that holds a list of flights counts, and of each figure the first name that holds one: in the flight, in its nested
price parts, then in its first segment. A fare that is nowhere is null, never invented.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareloom.functions import normalize
from fareloom.operators.layout import fresh

# Names under which sources give a flight's fields, in the order in which they count.
FARE = ("totalFare", "TotalFare", "fare", "Fare", "price", "grossFare", "GrossFare", "totalAmount", "fare_inr", "totalPrice", "amount", "tf")
BASE = ("baseFare", "BaseFare", "base_fare", "bf", "basePrice")
TAX = ("tax", "taxes", "taxes_and_fees", "Taxes", "taxAndOtherCharges", "taxAndCharges", "fees")
NUMBER = ("flightNumber", "flightNo", "FlightNo", "fn")
CARRIER = ("airlineCode", "carrierCode", "carrier", "AirlineCode", "ac")
DEPARTURE = ("departureTime", "depTime", "departureDateTime", "DepTime", "dt")
ARRIVAL = ("arrivalTime", "arrTime", "arrivalDateTime", "ArrTime", "at")
# Where lists of flights stand.
AT_TOP, IN_DATA = ("flights", "journeys", "FlightDetails", "availability", "results"), ("flights", "journeys", "availability")


def _list(value: Column, path: str) -> Column:
    """The list at ``path`` as an array of variants, null for anything else."""
    return F.try_variant_get(value, path, "array<variant>")


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit(kind)), F.lit(False))


def _object(value: Column, path: str) -> Column:
    """The object at ``path``, null for anything else."""
    inner = F.try_variant_get(value, path, "variant")
    return F.when(_is(inner, "OBJECT"), inner)


def _text(value: Column, names: tuple[str, ...]) -> Column:
    """The first of ``names`` with a value that is neither null nor empty, as text."""
    return F.coalesce(*(F.nullif(F.try_variant_get(value, f"$.{name}", "string"), F.lit("")) for name in names))


def _amount(fields: Column, names: tuple[str, ...]) -> Column:
    """The first of ``names`` in a map of fields that is a positive number, or a text with one (currency signs and commas may stand around)."""

    def read(name: str) -> Column:
        inner = fields[name]
        number = F.try_variant_get(inner, "$", "double")
        kind = F.schema_of_variant(inner)
        plain = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (number > 0), F.round(number, 2))
        # most names aren't there: for them the first condition is all that is evaluated
        return F.when(inner.isNull(), None).when(kind == "STRING", normalize.fare(F.try_variant_get(inner, "$", "string"))).otherwise(plain)

    return F.coalesce(*(read(name) for name in names))


def items(top: Column) -> Column:
    """The flights of a parsed payload as an array of variants; empty where there is none, and for what is no JSON object."""
    direct = [_list(top, f"$.{name}") for name in AT_TOP] + [_list(top, f"$.data.{name}") for name in IN_DATA]

    def of_trip(trip: Column) -> Column:
        first, second = _list(trip, "$.journeys"), _list(trip, "$.journeyList")
        return F.coalesce(F.when(F.size(first) > 0, first), second, F.array().cast("array<variant>"))

    trips = F.flatten(F.transform(_list(top, "$.trips"), of_trip))
    found = F.coalesce(*direct, trips, _list(top, "$.AirSearchResult.FlightDetails"), F.array().cast("array<variant>"))
    return F.filter(found, lambda item: _is(item, "OBJECT"))


def _first_fare(value: Column) -> Column:
    first = F.get(_list(value, "$.fares"), F.lit(0))
    return F.when(_is(first, "OBJECT"), first)


def _with_price_parts(rows: DataFrame, sources: list[str], details: dict[str, tuple[str, ...]]) -> DataFrame:
    """``rows`` with an array column for each name in ``details``: the fields of each part that may hold a price, as maps.

    The parts of a source: itself, then the first of its fares and the first of its details, each followed by its own. Every level is a step of its own, so
    that nothing is taken out of a payload twice.
    """
    added, parts = list(rows.columns), {name: [] for name in details}
    for source in sources:
        first, inner = fresh(f"_{source}_fare", rows), {name: fresh(f"_{source}_{name}", rows) for name in details}
        inner_of = lambda value, names: F.coalesce(*(_object(value, f"$.{n}") for n in names))
        rows = rows.withColumns({first: _first_fare(F.col(source)), **{inner[name]: inner_of(F.col(source), names) for name, names in details.items()}})
        for name, names in details.items():
            below = []
            for part in (first, inner[name]):
                below += [F.col(part), _first_fare(F.col(part)), inner_of(F.col(part), names)]
            parts[name] += [F.col(source), *below]
    as_map = lambda part: F.try_variant_get(part, "$", "map<string,variant>")
    maps = {name: F.transform(F.filter(F.array(*found), lambda part: part.isNotNull()), as_map).alias(name) for name, found in parts.items()}
    return rows.select(*(F.col(f"`{c}`") for c in added), *maps.values())


def flights(df: DataFrame, payload: str) -> DataFrame:
    """``df`` without ``payload``, a row for each flight in it.

    Added columns (an underscore in front where the name is taken): flight_number, carrier, total_fare, base_fare, taxes, departure, arrival,
    stops, minutes, status. What a flight doesn't have is null; stops default to its segments less one. Text that is no JSON, and objects
    without flights, give no rows.
    """
    top, found, item, segments, segment, last = (fresh(c, df) for c in ("_top", "_found", "_item", "_segments", "_segment", "_last"))
    fares, charges = (fresh(c, df) for c in ("_fares", "_charges"))
    rest = [F.col(f"`{c}`") for c in df.columns if c != payload]
    parsed = df.select(*rest, F.try_parse_json(F.col(f"`{payload}`")).alias(top)).select(*rest, items(F.col(top)).alias(found))
    # outer, since Spark would otherwise parse each payload again to leave out those without flights
    rows = parsed.select(*rest, F.explode_outer(found).alias(item)).where(F.col(item).isNotNull())
    rows = rows.withColumn(segments, _list(F.col(item), "$.segments"))
    as_object = lambda value: F.when(_is(value, "OBJECT"), value)
    rows = rows.withColumns({segment: as_object(F.get(segments, F.lit(0))), last: F.coalesce(as_object(F.try_element_at(F.col(segments), F.lit(-1))), F.col(item))})
    rows = _with_price_parts(rows, [item, segment], {fares: ("fareDetails",), charges: ("fareDetails", "priceBreakup")})

    def price(names: tuple[str, ...], parts: str) -> Column:
        return F.get(F.filter(F.transform(parts, lambda fields: _amount(fields, names)), lambda x: x.isNotNull()), F.lit(0))

    first_of = lambda names: F.coalesce(_text(F.col(segment), names), _text(F.col(item), names))
    given_stops = F.coalesce(*(F.try_variant_get(F.col(item), f"$.{name}", "int") for name in ("stops", "Stops")))
    minutes = F.coalesce(*(F.try_variant_get(F.col(item), f"$.{name}", "double") for name in ("duration", "durationMinutes", "Duration")))
    values = {
        "flight_number": F.trim(first_of(NUMBER)),
        "carrier": F.upper(F.trim(first_of(CARRIER))),
        "total_fare": price(FARE, fares),
        "base_fare": price(BASE, charges),
        "taxes": price(TAX, charges),
        "departure": first_of(DEPARTURE),
        "arrival": F.coalesce(_text(F.col(last), ARRIVAL), _text(F.col(item), ARRIVAL)),
        "stops": F.greatest(F.coalesce(given_stops, F.size(F.col(segments)) - 1, F.lit(0)), F.lit(0)),
        "minutes": F.when(minutes > 0, minutes.cast("long")),
        "status": normalize.status(_text(F.col(item), ("status", "flightStatus", "flight_status"))),
    }
    return rows.select(*rest, *(column.alias(fresh(name, df)) for name, column in values.items()))
