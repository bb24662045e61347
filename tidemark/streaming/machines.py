"""State machines of a key, for streams (stream.keyed) and tables (folds.unfolded)."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from ..operators.folds import Machine


def rolling_snapshot(width: int) -> Machine:
    """Rows (id, time, price) to (id, n, total, velocity) over (t - width, t], with times older than
    the window evicted. The sum is carried, and taken anew whenever half of the list has been evicted."""

    def step(state, row):
        i, t, price = row
        ticks, head = state["ticks"], state["head"]
        ticks.append((int(t), float(price)))
        total = state["total"] + float(price)
        while ticks[head][0] <= t - width:
            total -= ticks[head][1]
            head += 1
        if 2 * head > len(ticks) or total != total:
            del ticks[:head]
            head, total = 0, sum(p for _, p in ticks)
        state["head"], state["total"] = head, total
        return [(int(i), len(ticks) - head, total, float(price) - ticks[head][1])]

    return Machine(step, lambda: {"ticks": [], "head": 0, "total": 0.0}, "head long, total double", {"ticks": "t long, price double"})


def break_fade(breaks: tuple[float, ...], window: float, lookback: float, drift: float, hold: float) -> Machine:
    """Rows (id, minute, price) to (id, action, side, drift). In the `window` minutes from a break on,
    the price's change over the last `lookback` minutes (half of them at least must be covered, else
    the break stays open) is judged once: beyond `drift` a position against it is entered, which
    leaves after `hold` minutes. Prices are kept for twice the lookback."""

    def step(state, row):
        i, minute, price = int(row[0]), float(row[1]), float(row[2])
        snaps = state["snaps"] = [x for x in (*state["snaps"], (minute, price)) if x[0] >= minute - 2 * lookback]
        if state["side"] is not None:
            side = state["side"]
            if minute - state["since"] < hold:
                return [(i, "WAIT", side, None)]
            state["side"] = state["since"] = None
            return [(i, "EXIT", side, None)]
        at = next((b for b in breaks if (b,) not in state["fired"] and b <= minute < b + window), None)
        base = next((x for x in snaps if x[0] >= minute - lookback), None)
        if at is None or len(snaps) < 2 or base is None or minute - base[0] < lookback / 2:
            return [(i, "WAIT", None, None)]
        state["fired"].append((at,))
        moved = price - base[1]
        if abs(moved) < drift:
            return [(i, "WAIT", None, moved)]
        state["since"], state["side"] = minute, "NO" if moved > 0 else "YES"
        return [(i, "ENTER", state["side"], moved)]

    return Machine(step, lambda: {"snaps": [], "fired": [], "since": None, "side": None}, "since double, side string", {"snaps": "minute double, price double", "fired": "at double"})


def swap_with_hysteresis(low: float = 20, high: float = 80) -> Machine:
    """Rows (id, market, price, best, open) to (id, decision, market). The current market stays until
    its price leaves [low, high], then the best candidate follows; while a position is open the swap
    waits (swap_deferred_open)."""

    def step(state, row):
        i, market, price, best, held = row
        current = state["market"]
        if current is None:
            state["market"] = str(market)
            return [(int(i), "start", str(market))]
        if str(market) != current or low <= price <= high:
            return [(int(i), "stay", current)]
        if best is None or best != best:
            return [(int(i), "no_candidates", current)]
        if str(best) == current:
            return [(int(i), "best_is_current", current)]
        if held:
            return [(int(i), "swap_deferred_open", current)]
        state["market"] = str(best)
        return [(int(i), "swap", str(best))]

    return Machine(step, lambda: {"market": None}, "market string")


def market_snapshot(width: int, stale: int, near: int, far: int, second: int = 1_000_000) -> Machine:
    """Rows (id, time, asks, bid, ask, last, volume, interest). A row without `asks` is a tick; one with
    it is a request, which gives (id, has_data, 13 features): none if the last tick is older than
    `stale`, else bid, ask, spread, last, interest, volume of the last `far`, milliseconds since a
    tick that traded (999999: none), change of interest over `far`, changes of bid and spread since
    the last request with data, speed of the bid over `near`, its change, and bid less last.
    volume is a cumulative counter. Ticks older than `width` before the last one go. A value some time
    ago is that of the tick nearest to then, of two equally near the earlier.

    A tick keeps the volume traded up to it and when it last traded, so a request is two searches
    and no scan, and ticks behind `head` are cut off when they are half of the list."""

    T, BID, ASK, LAST, VOLUME, INTEREST, TRADED, WHEN, WHICH, NUMBER = range(10)
    time = lambda x: x[T]

    def nearest(ticks, head, then):
        """Of equal times the first; ticks[head:] isn't empty."""
        k = bisect_left(ticks, then, lo=head, key=time)
        if k == len(ticks) or (k > head and then - ticks[k - 1][T] <= ticks[k][T] - then):
            k = bisect_left(ticks, ticks[k - 1][T], lo=head, key=time)
        return ticks[k]

    def step(state, row):
        i, now, asks = int(row[0]), int(row[1]), row[2]
        ticks, head = state["ticks"], state["head"]
        if not asks:
            bid, ask, last, volume, interest = (float(x) for x in row[3:])
            traded, when, which, number = 0.0, None, None, 0
            if len(ticks) > head:
                grown, number = max(0.0, volume - ticks[-1][VOLUME]), ticks[-1][NUMBER] + 1
                traded = ticks[-1][TRADED] + grown
                when, which = (now, number) if grown > 0 else (ticks[-1][WHEN], ticks[-1][WHICH])
            ticks.append((now, bid, ask, last, volume, interest, traded, when, which, number))
            while ticks[head][T] < now - width:
                head += 1
            if 2 * head > len(ticks):
                del ticks[:head]
                head = 0
            state["head"] = head
            return []
        if len(ticks) == head or now - ticks[-1][T] > stale:
            return [(i, False, *[None] * 13)]
        _, bid, ask, last, _, interest, traded, when, which, _ = ticks[-1]
        k = bisect_right(ticks, now - far, lo=head, key=time)  # the first tick inside
        first = ticks[max(k - 1, head)][TRADED] if k < len(ticks) else traded
        if which is not None and which <= ticks[head][NUMBER]:
            when = None  # the tick before the one that traded has gone
        spread, speed = ask - bid, (bid - nearest(ticks, head, now - near)[BID]) / (near / second)
        out = (bid, ask, spread, last, interest, traded - first, (now - when) / (second / 1000) if when is not None else 999999.0, interest - nearest(ticks, head, now - far)[INTEREST], bid - state["bid"], spread - state["spread"], speed, speed - state["speed"], bid - last)
        state["bid"], state["spread"], state["speed"] = bid, spread, speed
        return [(i, True, *out)]

    ddl = "t long, bid double, ask double, last double, volume double, interest double, traded double, traded_at long, traded_no long, no long"
    return Machine(step, lambda: {"ticks": [], "head": 0, "bid": 0.0, "spread": 0.0, "speed": 0.0}, "head long, bid double, spread double, speed double", {"ticks": ddl})


def settlement(low: float, high: float, least: int, markets: int) -> Machine:
    """Rows (id, time, market, price) to (id, settled): whether `least` has gone by since the first
    row, and each of the key's `markets` has a last price at most low or at least high."""

    def step(state, row):
        i, now, market, price = int(row[0]), int(row[1]), str(row[2]), float(row[3])
        state["first"] = now if state["first"] is None else state["first"]
        state["last"][market] = price
        over = now - state["first"] >= least and len(state["last"]) == markets
        return [(i, bool(over and all(p <= low or p >= high for p in state["last"].values())))]

    return Machine(step, lambda: {"first": None, "last": {}}, "first long", maps={"last": ("market string", "price double")})


def possession_state(timeout: str = "timeout") -> Machine:
    """Rows (id, side, points, kind) to the features before each row, then the row advances the state:
    (id, run_side, run_length, run_points, home_5, away_5, elapsed, since_timeout). The twin of
    with_streak, rolling and with_rows_since; rows without points leave a run as it is."""

    def step(state, row):
        i, side, points, kind = int(row[0]), row[1], float(row[2] or 0.0), row[3]
        points = 0.0 if points != points else points
        last = state["last"]
        out = (i, state["run_side"], state["run_length"], state["run_points"], sum(p for s, p in last if s == "home"), sum(p for s, p in last if s == "away"), state["n"], 999 if state["since"] is None else state["n"] - state["since"])
        if points > 0:
            same = state["run_side"] == side
            state["run_length"], state["run_points"] = (state["run_length"] + 1, state["run_points"] + points) if same else (1, points)
            state["run_side"] = side
        state["last"] = [*last, (side, points)][-5:]
        if kind == timeout:
            state["since"] = state["n"]
        state["n"] += 1
        return [out]

    start = lambda: {"run_side": "", "run_length": 0, "run_points": 0.0, "n": 0, "since": None, "last": []}
    return Machine(step, start, "run_side string, run_length long, run_points double, n long, since long", {"last": "side string, points double"})
