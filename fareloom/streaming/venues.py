"""Quotes resolved to each portal's last offer and compared across venues, in one stream of two stateful operators.

The first is keyed by flight and portal and keeps one quote a key: quotes of a hot flight are spread over its portals, and prices that only
repeat go no further. The second is keyed by flight, fed by the changes of the first, and keeps an offer a portal. The watermark, on
time of arrival, runs through both: an offer that the first forgets is withdrawn from the second.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from fareloom.functions.scoring import payable
from fareloom.operators.arbitrage import VENUES, compared
from fareloom.streaming.dedup import with_spread

OFFER = "fare double, payable boolean, direct boolean"
CHANGES = f"flight string, portal string, at timestamp, {OFFER}, withdrawn boolean"
RESOLVED = "flight string, at timestamp, n_portals long, least double, most double, direct_fare double, direct_portal string, agency_fare double, agency_portal string"


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _or_none(value):
    return None if pd.isna(value) else value


class PortalOffers(StatefulProcessor):
    """The last quote of a portal for a flight: given on where it differs from the one before, and once more when it is forgotten."""

    def __init__(self, retention_ms: int, zone: str):
        self.retention_ms, self.zone = retention_ms, zone

    def init(self, handle) -> None:
        self.handle = handle
        self.offer = handle.getValueState("offer", OFFER)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, at = None, None
        for frame in rows:  # a chunk of the key's quotes at a time
            newest = frame.loc[frame["seq"].idxmax()]
            last = newest if last is None or newest["seq"] > last["seq"] else last
            at = frame["arrival"].max() if at is None else max(at, frame["arrival"].max())
        offer = (None if pd.isna(last["fare"]) else float(last["fare"]), bool(last["payable"]), bool(last["direct"]))
        known = tuple(self.offer.get()) if self.offer.exists() else None
        self.offer.update(offer)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        arrived = int(at.tz_localize(self.zone, ambiguous=True, nonexistent="shift_forward").timestamp() * 1000)
        self.handle.registerTimer(max(arrived, timerValues.getCurrentWatermarkInMs() + 1) + self.retention_ms)
        if known != offer:
            yield self._change(key, at, offer, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        offer = tuple(self.offer.get())
        self.offer.clear()
        # just past the watermark, so that the next operator doesn't take it for late
        at = pd.Timestamp(timerValues.getCurrentWatermarkInMs() + 1, unit="ms", tz="UTC").tz_convert(self.zone).tz_localize(None)
        yield self._change(key, at, offer, True)

    def _change(self, key, at, offer: tuple, withdrawn: bool) -> pd.DataFrame:
        return pd.DataFrame([(key[0], key[1], at, *offer, withdrawn)], columns=_columns(CHANGES)).astype({"fare": float})

    def close(self) -> None:
        pass


class FlightVenues(StatefulProcessor):
    """The offers of a flight's portals: its least payable fare and the best one of either venue after each micro-batch that changed one."""

    def init(self, handle) -> None:
        self.offers = handle.getMapState("offers", "portal string", OFFER)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        offers = {portal: tuple(offer) for (portal,), offer in self.offers.iterator()} if self.offers.exists() else {}
        at = None
        # a portal that comes back in the batch that forgets it counts: withdrawals are older than quotes
        changes = pd.concat(list(rows)).sort_values(["at", "withdrawn"], ascending=[True, False], kind="stable")
        for change in changes.itertuples(index=False):
            at = change.at if at is None else max(at, change.at)
            if change.withdrawn:
                if offers.pop(change.portal, None) is not None:
                    self.offers.removeKey((change.portal,))
            else:
                offers[change.portal] = (_or_none(change.fare), bool(change.payable), bool(change.direct))
                self.offers.updateValue((change.portal,), offers[change.portal])
        priced = [(fare, portal, may, direct) for portal, (fare, may, direct) in offers.items() if fare is not None]
        least = min((p[0] for p in priced if p[2]), default=None)
        best = [min((p[:2] for p in priced if p[2] and p[3] is side and p[0] > 0), default=(None, None)) for side in (True, False)]
        row = (key[0], at, len(offers), least, max((p[0] for p in priced), default=None), *best[0], *best[1])
        yield pd.DataFrame([row], columns=_columns(RESOLVED)).astype({"least": float, "most": float, "direct_fare": float, "agency_fare": float})

    def close(self) -> None:
        pass


def venue_stream(stream: DataFrame, retention_ms: int = 86_400_000) -> DataFrame:
    """A row for each flight and micro-batch in which an offer of it changed: ``RESOLVED``, spread, spread_pct and ``VENUES``.

    ``stream``: flight, portal, direct (see ``arbitrage.is_direct``), seq (ascending with arrival), fare, status; the session must use
    ``dedup.STATE_STORE``. The last quote of a portal to arrive is its offer until a later one, or until ``retention_ms`` went by without any. least is that of
    the payable offers, most that of all; a venue's best is its least payable fare above 0, equal ones by portal. Without an offer
    on either side ``VENUES`` are null; a flight whose last offer was forgotten has n_portals 0. A null portal is "unknown", a null flight a
    flight of its own, a null direct an agency.
    """
    given = stream.select(
        "flight",
        F.coalesce("portal", F.lit("unknown")).alias("portal"),
        F.coalesce("direct", F.lit(False)).alias("direct"),
        F.col("seq").cast("long").alias("seq"),
        F.col("fare").cast("double").alias("fare"),
        payable(F.col("status")).alias("payable"),
        F.current_timestamp().alias("arrival"),
    ).withWatermark("arrival", "0 seconds")
    first = PortalOffers(retention_ms, stream.sparkSession.conf.get("spark.sql.session.timeZone"))
    changes = given.groupBy("flight", "portal").transformWithStateInPandas(first, CHANGES, "Append", "EventTime", eventTimeColumnName="at")
    found = changes.groupBy("flight").transformWithStateInPandas(FlightVenues(), RESOLVED, "Append", "EventTime", eventTimeColumnName="at")
    return compared(with_spread(found))


def venues_batch(df: DataFrame, flight: list[str], portal: str, direct: str, fare: str, status: str, order: list[str]) -> DataFrame:
    """What ``venue_stream`` has for each flight after all of ``df``, in the order ``order``: two aggregations, by flight and portal and by flight."""
    price = F.col(fare).cast("double")
    offer = F.struct(F.when(~F.isnan(price), price).alias("f"), payable(F.col(status)).alias("may"), F.coalesce(direct, F.lit(False)).alias("own"))
    last = df.groupBy(*flight, F.coalesce(portal, F.lit("unknown")).alias("p")).agg(F.max_by(offer, F.struct(*order)).alias("q")).select(*flight, "p", "q.*")
    may, best = F.col("may") & F.col("f").isNotNull(), F.struct("f", "p")
    side = lambda own: F.min(F.when(may & (F.col("f") > 0) & (F.col("own") == own), best))
    by = last.groupBy(*flight).agg(F.count("*").alias("n_portals"), F.min(F.when(may, F.col("f"))).alias("least"), F.max("f").alias("most"), side(True).alias("d"), side(False).alias("a"))
    flat = by.select(*flight, "n_portals", "least", "most", *(F.col(s)[c].alias(f"{n}_{k}") for s, n in (("d", "direct"), ("a", "agency")) for c, k in (("f", "fare"), ("p", "portal"))))
    return compared(with_spread(flat))
