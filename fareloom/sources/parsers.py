"""Nested flight payloads as flat quotes, and files under several header names.

Payloads are read against one superset schema; the first place that holds a value wins, and a fare that is
nowhere is null, never invented.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fareloom.operators.layout import fresh

#: The places of a flight list and the union of their fields.
_FLIGHT = "struct<flightNo:string,flight_number:string,carrier:string,airlineCode:string,fare:double,price:double,totalFare:double,fares:array<struct<amount:double,total:double>>,fareDetails:struct<total:double,base:double,tax:double>,departure:string,status:string,stops:int>"
PAYLOAD = f"flights array<{_FLIGHT}>, data struct<flights:array<{_FLIGHT}>>, results array<{_FLIGHT}>"
OFFER = "itineraries array<struct<duration:string,segments:array<struct<carrierCode:string,number:string,departure:struct<iataCode:string,at:string>,arrival:struct<iataCode:string,at:string>>>>>, price struct<total:string,base:string,taxes:array<struct<amount:string>>>"
JOURNEY = "journeys array<struct<number:string,fares:map<string,struct<key:string,available:int,type:string>>>>, prices map<string,double>"


def flights(df: DataFrame, payload: str) -> DataFrame:
    """``df`` without ``payload``, a row for each flight in it: flight_number, carrier, total_fare, base_fare, taxes, status."""
    parsed = F.from_json(payload, PAYLOAD)
    items = F.coalesce(parsed["flights"], parsed["data"]["flights"], parsed["results"])
    rest = [c for c in df.columns if c != payload]
    rows = df.select(*rest, F.explode_outer(items).alias("f"))
    f = F.col("f")
    first = F.get(f["fares"], F.lit(0))
    amount = F.coalesce(f["totalFare"], f["fare"], f["price"], f["fareDetails"]["total"], first["total"], first["amount"])
    return rows.where("f is not null").select(
        *rest,
        F.coalesce(f["flightNo"], f["flight_number"]).alias("flight_number"),
        F.coalesce(f["carrier"], f["airlineCode"]).alias("carrier"),
        F.when(amount > 0, amount).alias("total_fare"),
        f["fareDetails"]["base"].alias("base_fare"),
        f["fareDetails"]["tax"].alias("taxes"),
        F.lower(f["status"]).alias("status"),
    )


def iso_minutes(text: Column) -> Column:
    """Minutes of an ISO duration such as PT2H15M."""
    part = lambda unit: F.coalesce(F.regexp_extract(text, f"([0-9]+){unit}", 1).try_cast("int"), F.lit(0))
    return F.when(text.rlike("^P"), part("D") * 1440 + part("H") * 60 + part("M"))


def offers(df: DataFrame, payload: str) -> DataFrame:
    """``df`` with the first itinerary's ends, minutes and stops, the total and the sum of the taxes."""
    offer, first = fresh("_offer", df), fresh("_trip", df)
    rest = [F.col(f"`{c}`") for c in df.columns if c != payload]
    # in steps, so that a payload is parsed once and not for each of its figures
    rows = df.select(*rest, F.from_json(payload, OFFER).alias(offer)).select(*rest, offer, F.get(F.col(offer)["itineraries"], F.lit(0)).alias(first))
    o, trip = F.col(offer), F.col(first)
    start, end = F.get(trip["segments"], F.lit(0)), F.try_element_at(trip["segments"], F.lit(-1))
    taxes = F.aggregate(o["price"]["taxes"], F.lit(0.0), lambda s, x: s + F.coalesce(x["amount"].try_cast("double"), F.lit(0.0)))
    return rows.select(
        *rest,
        start["carrierCode"].alias("carrier"),
        start["departure"]["iataCode"].alias("origin"),
        end["arrival"]["iataCode"].alias("destination"),
        iso_minutes(trip["duration"]).alias("minutes"),
        (F.size(trip["segments"]) - 1).alias("stops"),
        o["price"]["total"].try_cast("double").alias("total_fare"),
        o["price"]["base"].try_cast("double").alias("base_fare"),
        taxes.alias("taxes"),
    )


def cheapest_bookable(df: DataFrame, payload: str) -> DataFrame:
    """``df`` with a row for each journey and its cheapest adult fare that has a seat; null if there is none."""
    p = fresh("_payload", df)
    parsed = df.select(*(c for c in df.columns if c != payload), F.from_json(payload, JOURNEY).alias(p))
    rows = parsed.select(*(c for c in df.columns if c != payload), F.col(p)["prices"].alias("_prices"), F.explode_outer(F.col(p)["journeys"]).alias("_j")).where("_j is not null")
    open_fares = F.filter(F.map_values("_j.fares"), lambda x: (x["available"] >= 1) & (x["type"] == "ADT"))
    amounts = F.transform(open_fares, lambda x: F.try_element_at(F.col("_prices"), x["key"]))
    return rows.select(*(c for c in df.columns if c != payload), F.col("_j.number").alias("number"), F.array_min(amounts).alias("fare"))


def aligned(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """The columns of ``aliases``, each from the first of its names that ``df`` has a value under."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*(F.coalesce(*(F.col(f"`{have[n]}`") for n in [name, *names] if n in have), F.lit(None).cast("string")).alias(name) for name, names in aliases.items()))


TRAFFIC = {"year_month": ["period", "month"], "route_code": ["route", "corridor"], "pax_volume": ["pax", "passengers"], "share_weight": ["weight", "share"], "provenance": ["origin_of_data"]}
CPI = {"year_month": ["period", "month"], "transport": ["cpi_transport", "cpi_transport_index"], "airfare": ["airfare_sub_index"], "headline": ["headline_cpi", "cpi"], "source": ["citation"], "published": ["published_at", "release_date"], "mom_pct": ["mom"], "yoy_pct": ["yoy"]}


def _declared(spark: SparkSession, path: str) -> DataFrame:
    """_file and _declared: the provenance that a line ``# provenance: x`` declares for each file."""
    lines = spark.read.text(path).where(F.col("value").rlike("(?i)^# *provenance:"))
    token = F.trim(F.regexp_extract("value", "(?i)provenance: *(.*)$", 1))
    return lines.select(F.input_file_name().alias("_file"), token.alias("_token")).groupBy("_file").agg(F.first("_token").alias("_declared"))


def read_traffic(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """Monthly volumes from CSV or JSON: year_month, route_code, pax_volume, share_weight (normalised within the
    month), provenance (of the row, else of its file)."""
    from fareloom.operators.store import normalized_weights

    if kind == "csv":
        raw = spark.read.csv(path, header=True, comment="#").withColumn("_file", F.input_file_name())
        raw = raw.join(F.broadcast(_declared(spark, path)), "_file", "left")  # a row a file
    else:
        raw = _records(spark, path).withColumn("_declared", F.lit(None).cast("string"))
    rows = aligned(raw, {**TRAFFIC, "_declared": []}).withColumns({"pax_volume": F.col("pax_volume").try_cast("long"), "provenance": F.coalesce("provenance", "_declared")}).where("pax_volume > 0")
    weights = normalized_weights(rows, "year_month", "route_code", "pax_volume").select("year_month", "route_code", "rank", F.col("weight").alias("share_weight"))
    return rows.drop("share_weight", "_declared").join(weights, ["year_month", "route_code"])


def _records(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON file that is a list, or an object with the list under records or data."""
    raw = spark.read.json(path, multiLine=True)
    for name in ("records", "data"):
        if name in raw.columns:
            return raw.select(F.inline(name))
    return raw


def read_cpi(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """Monthly index with its publication (the twelfth of the next month, if not given) and its changes: those of the
    file where it has them, else against the calendar month and year before. Missing indices stay null."""
    raw = spark.read.csv(path, header=True, comment="#") if kind == "csv" else _records(spark, path)
    numbers = ("transport", "airfare", "headline", "mom_pct", "yoy_pct")
    rows = aligned(raw, CPI).withColumns({c: F.col(c).try_cast("double") for c in numbers}).withColumn("month", F.to_date(F.concat("year_month", F.lit("-01"))))
    rows = rows.withColumn("published", F.coalesce(F.col("published").try_cast("date"), F.date_add(F.add_months("month", 1), 11)))
    for name, back in (("mom_pct", 1), ("yoy_pct", 12)):
        before = rows.select(F.add_months("month", back).alias("month"), F.col("transport").alias("_before"))
        change = F.try_divide(F.col("transport") - F.col("_before"), F.col("_before")) * 100
        rows = rows.join(before, "month", "left").withColumn(name, F.coalesce(name, change)).drop("_before")
    return rows


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """CSV with a header, JSON lines or Parquet; ``path`` must be new."""
    writer = df.write.mode("errorifexists")
    {"csv": lambda: writer.csv(path, header=True), "json": lambda: writer.json(path), "parquet": lambda: writer.parquet(path)}[kind]()
