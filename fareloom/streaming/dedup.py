"""Quotes of a flight from several portals, resolved to the least payable fare: as a stream, as a replay and in batch.

The stream keeps the last quote of each portal in a map of the state store, an entry a portal: a micro-batch reads the portals of the flights
that it has quotes of and writes those that changed. A portal that raises its fare can raise the flight's least fare.
"""

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from fareloom.functions.normalize import timestamp
from fareloom.functions.scoring import payable
from fareloom.operators.asof import as_of
from fareloom.operators.layout import fresh, in_blocks, written
from fareloom.streaming.flight_state import RESULTS, Flight

#: Where the stream's state must be kept; set it before the query starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
INPUT = ["flight", "portal", "event_time", "seq", "fare", "status"]
OUTPUT = f"flight string, portal string, event_time timestamp, seq long, fare double, status string, {RESULTS}"


def resolve_batch(df: DataFrame, flight: list[str], portal: str, fare: str, status: str, order: list[str]) -> DataFrame:
    """n_portals, fare (the least payable one), most (of all portals) and spread of each flight.

    Of each portal the last quote in ``order`` counts; see ``spread_of`` for the spread.
    """
    last = df.groupBy(*flight, portal).agg(F.max_by(F.struct(F.col(fare).alias("f"), F.col(status).alias("s")), F.struct(*order)).alias("q"))
    least = F.min(F.when(payable(F.col("q.s")), F.col("q.f")))
    ends = last.groupBy(*flight).agg(F.count("*").alias("n_portals"), least.alias("fare"), F.max("q.f").alias("most"))
    return ends.withColumn("spread", spread_of(F.col("fare"), F.col("most"), F.col("n_portals")))


def spread_of(least: Column, most: Column, n_portals: Column) -> Column:
    """The greatest fare of all portals less the least payable one, to whole hundredths; null for one portal and without a positive least fare."""
    return F.when((n_portals > 1) & (least > 0), F.round(most - least, 2))


def with_spread(df: DataFrame) -> DataFrame:
    """``df`` (least, most, n_portals) with spread and spread_pct (of the least fare)."""
    spread = spread_of(F.col("least"), F.col("most"), F.col("n_portals"))
    return df.withColumn("spread", spread).withColumn("spread_pct", F.round(F.col("spread") / F.col("least") * 100, 4))


def with_event_time(df: DataFrame, booking: str, departure: str, arrival: str) -> DataFrame:
    """``df`` with event_time: the booking time, else the departure, else the arrival of the quote; texts are parsed."""
    return df.withColumn("event_time", F.coalesce(*(timestamp(F.col(c).cast("string")) for c in (booking, departure, arrival))))


class FlightQuotes(StatefulProcessor):
    """Every quote of a flight with the flight's state after it; a flight without quotes for ``retention_ms`` is forgotten."""

    def __init__(self, retention_ms: int, by_event_time: bool, zone: str):
        self.retention_ms, self.by_event_time, self.zone = retention_ms, by_event_time, zone

    def init(self, handle) -> None:
        self.handle = handle
        self.portals = handle.getMapState("portals", "portal string", "fare double, status string, place int")
        self.newest = handle.getValueState("newest", "at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        flight = Flight(pd.Timestamp(self.newest.get()[0]) if self.newest.exists() else None)
        for (portal,), (fare, status, place) in self.portals.iterator() if self.portals.exists() else ():
            flight.hold(portal, fare, status, place)
        watermark = timerValues.getCurrentWatermarkInMs()
        seen = pd.Timestamp(watermark, unit="ms", tz="UTC").tz_convert(self.zone).tz_localize(None) if self.by_event_time and watermark > 0 else None
        quotes = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out, changed = [], {}
        for q in quotes.itertuples(index=False):
            fare, status = None if pd.isna(q.fare) else float(q.fare), None if pd.isna(q.status) else q.status
            portal, at = "unknown" if pd.isna(q.portal) else q.portal, None if pd.isna(q.event_time) else q.event_time
            out.append((key[0], portal, at, q.seq, fare, status, *flight.quote(portal, fare, status, at, seen)))
            changed[portal] = flight.portals[portal]
        for portal, value in changed.items():
            self.portals.updateValue((portal,), value)
        if flight.newest is not None:
            self.newest.update((flight.newest.to_pydatetime(),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        last = flight.newest if self.by_event_time else quotes["arrival"].max()
        known = last is not None and int(last.tz_localize(self.zone, ambiguous=True, nonexistent="shift_forward").timestamp() * 1000)
        self.handle.registerTimer(max(known or 0, watermark + 1) + self.retention_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")]).astype({"least": float, "previous_least": float, "most": float, "n_portals": "int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.portals.clear()
        self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def resolve_stream(stream: DataFrame, drop_later_than: str | None = None, retention_ms: int = 3_600_000) -> DataFrame:
    """Every quote of ``stream`` with the state of its flight after it, in order of arrival.

    ``stream``: flight, portal, event_time (see ``with_event_time``), seq (ascending with arrival), fare, status; the session must use ``STATE_STORE``.
    Added: ``RESULTS``, spread and spread_pct. The last quote of a portal to arrive counts, also when its event time is older.
    ``out_of_order``: its event time is behind that of an earlier quote of the flight. All quotes count, and a flight is
    forgotten ``retention_ms`` after its last arrival. With ``drop_later_than`` Spark drops quotes that are later than that behind
    the newest quote of all flights, as of the batch before the last one; then ``out_of_order`` also compares with that watermark and
    retention goes by event time. Without a payable portal least is null and the next quote counts as a new minimum, as a first one does. A
    null portal is "unknown"; a null fare counts as a portal without a price.
    """
    by_event_time, arrival = drop_later_than is not None, F.current_timestamp().alias("arrival")
    given = stream.select(*INPUT, arrival)
    # time of arrival never goes back: nothing is late by it, and its watermark lets timers run out
    marked = given.withWatermark("event_time", drop_later_than) if by_event_time else given.withWatermark("arrival", "0 seconds")
    processor = FlightQuotes(retention_ms, by_event_time, stream.sparkSession.conf.get("spark.sql.session.timeZone"))
    return with_spread(marked.groupBy("flight").transformWithStateInPandas(processor, OUTPUT, "Append", "EventTime"))


def replay(df: DataFrame, flight: list[str], portal: str, event_time: str, fare: str, status: str, arrival: list[str], seen: str | None = None, rows: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``RESULTS``, spread and spread_pct of each quote, as the stream gives them for the order ``arrival`` (without ties).

    ``seen``: a column with the newest event time of all quotes before (for ``out_of_order`` against the whole feed, not the flight only).
    ``keep``: the columns of ``df`` that come back (all by default); others go no further than the layout.

    Quotes are laid out in blocks of flight and arrival. A block starts from the last quote of each portal in the flight's blocks before it,
    which an as-of join brings: a flight of any size is spread over tasks, and a block holds ``rows`` quotes and one row a portal.
    """
    given = df.columns if keep is None else keep
    needed = list(dict.fromkeys([*given, *flight, portal, event_time, fare, status, *([seen] if seen else [])]))
    laid, place, block = in_blocks(df, [*flight, *arrival], "replay", rows, needed)
    fresh_ = lambda name: fresh(name, laid)
    who, newest, start, last, first = (fresh_(c) for c in ("_portal", "_newest", "_start", "_last", "_first"))
    named = laid.withColumn(who, F.coalesce(F.col(portal), F.lit("unknown")))
    price = F.struct(F.col(fare).cast("double").alias("fare"), F.col(status).alias("status"))
    ends = written(named.groupBy(*flight, block, who).agg(F.max_by(price, F.col(place)).alias(last), F.min(place).alias(first), F.max(event_time).alias(newest)), "replay-ends")
    # only blocks that continue a flight need what was before them
    begun = Window.partitionBy(*flight).orderBy(block)
    starts = ends.groupBy(*flight, block).agg(F.max(newest).alias(newest))
    later = starts.select(*flight, block, F.max(newest).over(begun.rowsBetween(Window.unboundedPreceding, -1)).alias(newest), F.lag(block).over(begun).alias(start)).where(F.col(start).isNotNull()).drop(start)
    portals = ends.groupBy(*flight, who).agg(F.min(first).alias(first))
    wanted = later.join(portals, flight)
    carried = as_of(wanted, ends.select(*flight, who, block, last), [*flight, who], block, block, [last], before=True).where(F.col(last).isNotNull())

    # the flight's own columns are beside the others, not among them: a row is shuffled with each value once
    others = [c for c in given if c not in flight]
    kind, extra, fare_, status_ = (fresh_(c) for c in ("_kind", "_extra", "_fare", "_status"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    nowhere = F.lit(None).cast("long")
    quotes = named.select(*flight, block, F.lit(1).alias(kind), place, who, F.col(fare).cast("double").alias(fare_), F.col(status).alias(status_), micros(event_time).alias(newest), (micros(seen) if seen else nowhere).alias(start), F.struct(F.lit(0).alias(kind), *(F.col(f"`{c}`") for c in others)).alias(extra))
    heads = carried.select(*flight, block, F.lit(0).alias(kind), F.col(first).alias(place), who, F.col(last)["fare"].alias(fare_), F.col(last)["status"].alias(status_), micros(newest).alias(newest), nowhere.alias(start), F.lit(None).cast(quotes.schema[extra].dataType).alias(extra))
    added = [c.split() for c in RESULTS.split(", ")]
    names = {c: fresh(c, df) for c, _ in added}
    ordered = quotes.unionByName(heads).repartition(*flight, block).sortWithinPartitions(block, *flight, kind, place)
    n_flight, key_width = len(flight), len(flight) + 1

    def run(batches):
        now, state = None, None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[: key_width + 7]]
            kept, out = [], []
            keys = zip(*columns[:key_width], strict=True)
            for k, (key, a_quote, at_place, portal_, fare_, status_, at, before) in enumerate(zip(keys, *columns[key_width:], strict=True)):
                if key != now:
                    now, state = key, Flight()
                if not a_quote:
                    state.hold(portal_, fare_, status_, at_place)
                    state.newest = at
                else:
                    kept.append(k)
                    out.append(state.quote(portal_, fare_, status_, at, before, at_place))
            kept = pa.array(kept, pa.int64())
            same = [batch.column(k).take(kept) for k in (*range(n_flight), key_width + 7)]
            values = [pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*same, *values], names=[*flight, extra, *(c for c, _ in added)])

    types = [{"boolean": pa.bool_(), "double": pa.float64(), "string": pa.string(), "int": pa.int32()}[t] for _, t in added]
    schema = ", ".join([*(f"`{c}` {quotes.schema[c].dataType.simpleString()}" for c in (*flight, extra)), RESULTS])
    found = with_spread(ordered.mapInArrow(run, schema))
    both = [*names.items(), *((c, fresh(c, df)) for c in ("spread", "spread_pct"))]
    return found.select(*(F.col(f"`{c}`") if c in flight else F.col(extra).getField(c).alias(c) for c in given), *(F.col(c).alias(n) for c, n in both))


def resolved_flights(stream: DataFrame, window: str = "300 seconds") -> DataFrame:
    """The last quote of each flight and portal by event time, as an updating table (for complete or update mode)."""
    last = F.max_by(F.struct("fare", "status"), F.struct("event_time", "seq"))
    return stream.withWatermark("event_time", window).groupBy("flight", "portal").agg(last.alias("q")).select("flight", "portal", "q.*")
