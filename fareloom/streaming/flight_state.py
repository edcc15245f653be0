"""What the quotes of a flight come to, one after the other in order of arrival: the rules that stream and replay share.

Of each portal the last quote to arrive counts, whatever its event time. The least fare is that of portals whose last quote is
payable; equal fares go to the portal that came first.
"""

import heapq

from fareloom.constants import NOT_PAYABLE

#: Two fares closer than this are one price.
SAME = 1e-6

RESULTS = "new_flight boolean, new_minimum boolean, duplicate_price boolean, out_of_order boolean, least double, previous_least double, best_portal string, n_portals int, most double"


class Flight:
    """The last quote of each portal, with heaps of their fares; an entry that its portal has replaced is left out when it surfaces."""

    def __init__(self, newest=None):
        self.portals: dict[str, tuple] = {}
        self.newest = newest
        self._cheapest: list[tuple] = []
        self._dearest: list[tuple] = []

    def hold(self, portal: str, fare: float | None, status: str | None, place: int) -> None:
        """Takes a quote as its portal's last one; ``place`` orders portals by their first quote."""
        fare = None if fare is None or fare != fare else fare
        self.portals[portal] = (fare, status, place)
        if fare is not None:
            heapq.heappush(self._dearest, (-fare, place, portal))
            if (status or "") not in NOT_PAYABLE:
                heapq.heappush(self._cheapest, (fare, place, portal))

    def _least(self) -> tuple | None:
        while self._cheapest:
            fare, place, portal = self._cheapest[0]
            if self.portals[portal][0] == fare and (self.portals[portal][1] or "") not in NOT_PAYABLE:
                return self._cheapest[0]
            heapq.heappop(self._cheapest)
        return None

    def _most(self) -> float | None:
        while self._dearest:
            fare, _, portal = self._dearest[0]
            if self.portals[portal][0] == -fare:
                return -fare
            heapq.heappop(self._dearest)
        return None

    def quote(self, portal: str | None, fare: float | None, status: str | None, at, seen=None, place: int | None = None) -> tuple:
        """Takes the next quote to arrive; the values of ``RESULTS``. ``seen``: the newest event time of other flights before it."""
        portal = "unknown" if portal is None else portal
        known, before = self.portals.get(portal), self._least()
        late = at is not None and any(t is not None and at < t for t in (self.newest, seen))
        new_flight = not self.portals
        self.hold(portal, fare, status, known[2] if known else len(self.portals) if place is None else place)
        if at is not None:
            self.newest = at if self.newest is None else max(self.newest, at)
        least = self._least()
        new_minimum = before is None or (least is not None and least[0] < before[0] - SAME)
        fare = self.portals[portal][0]
        same = known is not None and None not in (known[0], fare) and abs(known[0] - fare) < SAME
        return new_flight, new_minimum, same, late, least and least[0], before and before[0], least and least[2], len(self.portals), self._most()
