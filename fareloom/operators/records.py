"""Raw observations as stored records, and what a valid one is."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareloom.constants import NOT_PAYABLE
from fareloom.functions import normalize, scoring
from fareloom.operators.layout import fresh

STATUSES = ("scheduled", *NOT_PAYABLE)
#: The names under which payloads report a status, a sold-out and a cancelled flight.
STATUS_KEYS = ("flight_status", "flightStatus", "FlightStatus")
SOLD_OUT_KEYS = ("soldOut", "sold_out", "isSoldOut", "SoldOut", "is_sold_out")
CANCELLED_KEYS = ("cancelled", "canceled", "isCancelled", "isCanceled", "IsCancelled")

RAW = "origin destination airline_code flight_number booking_window departure_time flight_date total_fare base_fare taxes_and_fees fare_split_basis booking_class flight_status stops fare_class source_platform".split()


def normalized(df: DataFrame, carried: list[str] = ()) -> DataFrame:
    """Stored records of raw rows, in one pass: the columns ``RAW`` (text, as given) and ``carried`` along.

    A split that is marked calibrated or estimated but doesn't add up is made anew; missing classes, sources and
    stops have their defaults; the fingerprint is that of the normalised fields. Fields are made in steps, each once: what a step reads twice is
    not worked out again, and the code that Spark makes of a step stays short enough to be compiled.
    """
    c = {k: F.col(k) for k in RAW}
    fields = "carrier number origin destination total base taxes obsolete ratio computed departure day tag window token whole basis".split()
    name = {k: fresh(f"_{k}", df) for k in fields}
    v = {k: F.col(n) for k, n in name.items()}
    step = lambda rows, **made: rows.withColumns({name[k]: value for k, value in made.items()})
    rows = step(df, total=F.coalesce(normalize.amount(c["total_fare"]), F.lit(0.0)), base=normalize.amount(c["base_fare"]), taxes=normalize.amount(c["taxes_and_fees"]))
    marked = c["fare_split_basis"].isin("calibrated", "estimated")
    rows = step(rows, obsolete=F.when(marked & (F.abs(v["total"] - (v["base"] + v["taxes"])) > 1.0), True).otherwise(False))
    rows = step(rows, base=F.when(~v["obsolete"], v["base"]), taxes=F.when(~v["obsolete"], v["taxes"]))
    rows = step(rows, carrier=normalize.code(c["airline_code"]), number=normalize.code(c["flight_number"]), origin=normalize.code(c["origin"]), destination=normalize.code(c["destination"]))
    rows = step(rows, departure=F.try_to_timestamp(c["departure_time"]), tag=F.upper(F.trim(c["booking_window"])), token=normalize.status_token(c["flight_status"]))
    rows = step(rows, window=normalize.window_of(v["tag"]), day=F.coalesce(F.left(c["flight_date"], F.lit(10)).try_cast("date"), F.to_date(v["departure"])))
    rows = step(rows, ratio=F.when(v["base"].isNull() & v["taxes"].isNull(), scoring.known_ratio(v["carrier"], F.concat_ws("-", v["origin"], v["destination"]))))
    rows = step(rows, ratio=scoring.clamped(v["ratio"]))
    rows = step(rows, computed=scoring.base_by(v["ratio"], v["total"]))
    rows = step(rows, whole=scoring.base_part(v["total"], v["base"], v["taxes"], v["computed"]), basis=scoring.split_basis(v["base"], v["taxes"], v["ratio"]))
    known_basis = c["fare_split_basis"].isin("measured", "residual", "calibrated", "estimated")
    source = F.coalesce(F.nullif(F.trim(c["source_platform"]), F.lit("")), F.lit("synthetic"))
    stamp = F.coalesce(F.date_format(v["departure"], "yyyy-MM-dd'T'HH:mm:ss"), F.nullif(c["departure_time"], F.lit("")), F.date_format(v["day"], "yyyy-MM-dd"))
    return rows.select(
        *carried,
        v["origin"].alias("origin"),
        v["destination"].alias("destination"),
        v["carrier"].alias("airline_code"),
        v["number"].alias("flight_number"),
        v["window"].alias("booking_window"),
        v["departure"].alias("departure_time"),
        v["day"].alias("flight_date"),
        v["total"].alias("total_fare"),
        v["whole"].alias("base_fare"),
        scoring.tax_part(v["total"], v["whole"], v["taxes"]).alias("taxes_and_fees"),
        F.when((v["basis"] == "measured") & known_basis, c["fare_split_basis"]).otherwise(v["basis"]).alias("fare_split_basis"),
        normalize.booking_class(c["booking_class"]).alias("booking_class"),
        normalize.status_of(v["token"]).alias("flight_status"),
        F.coalesce(c["stops"].try_cast("int"), F.lit(0)).alias("stops"),
        F.coalesce(F.nullif(F.trim(c["fare_class"]), F.lit("")), F.lit("Economy")).alias("fare_class"),
        source.alias("source_platform"),
        normalize.fingerprint(v["carrier"], v["number"], v["origin"], v["destination"], stamp, v["window"]).alias("hash_id"),
    )


def failures(origin: Column, destination: Column, carrier: Column, number: Column, fare: Column, departure: Column, arrival: Column, origins: list[str] = (), carriers: list[str] = (), destinations: list[str] | None = None) -> Column:
    """Names of all checks that a record fails; an empty array is a valid record. Empty lists allow everything; ``destinations`` are
    ``origins`` unless given."""
    destinations = origins if destinations is None else destinations
    member = lambda value, allowed: value.isin(*allowed) if allowed else F.lit(True)
    return normalize.reasons(
        (fare > 0, "fare"),
        (normalize.iata(origin).isNotNull(), "origin code"),
        (member(origin, origins), "origin"),
        (normalize.iata(destination).isNotNull(), "destination code"),
        (member(destination, destinations), "destination"),
        (origin != destination, "same place"),
        (normalize.carrier_code(carrier).isNotNull(), "carrier code"),
        (member(carrier, carriers), "carrier"),
        (F.trim(number) != "", "flight number"),
        (arrival > departure, "chronology"),
    )


def reported_status(payload: Column) -> Column:
    """The status that a payload really reports: a known status text, else a sold-out or cancelled flag that is true,
    else a known general status; null for anything else."""
    text = lambda k: normalize.status(F.get_json_object(payload, f"$.{k}"))
    known = lambda k: F.when(text(k).isin(*STATUSES), text(k))
    any_of = lambda keys: F.greatest(*(F.coalesce(F.get_json_object(payload, f"$.{k}") == "true", F.lit(False)) for k in keys))
    return F.coalesce(*map(known, STATUS_KEYS), F.when(any_of(SOLD_OUT_KEYS), "sold_out"), F.when(any_of(CANCELLED_KEYS), "cancelled"), known("status"), known("Status"))
