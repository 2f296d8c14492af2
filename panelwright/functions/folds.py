"""Sequential rules written as higher-order functions, so they stay inside the JVM.

Each works on one array that is bounded by construction: the names picked for one signal
date (at most ``top_n``), or one scenario's daily series (one entry per calendar date).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelwright.functions.numbers import ratio

ROUNDS = 10
TOLERANCE = 1e-9


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(items: Column, field: Callable[[Column], Column]) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, item: acc + field(item))


def equal_weights(names: Column) -> Column:
    """array<struct(symbol, ...)> to array<struct(symbol, weight)> with weights 1/n."""
    return F.transform(
        names,
        lambda n: F.struct(
            n["symbol"].alias("symbol"),
            ratio(F.lit(1.0), F.size(names).cast("double")).alias("weight"),
        ),
    )


def _with_weight(item: Column, weight: Column) -> Column:
    return F.struct(
        item["symbol"].alias("symbol"),
        item["asset_class"].alias("asset_class"),
        item["raw"].alias("raw"),
        weight.alias("weight"),
    )


def _cap_round(items: Column, single_cap: Column, category_cap: Column) -> Column:
    """One round: clip names, shrink categories, hand the rest to names below their cap."""
    clipped = F.transform(items, lambda i: _with_weight(i, F.least(i["weight"], single_cap)))
    any_clipped = F.exists(items, lambda i: i["weight"] > single_cap)

    def class_total(pool: Column, item: Column) -> Column:
        peers = F.filter(pool, lambda p: p["asset_class"] == item["asset_class"])
        return total(peers, lambda p: p["weight"])

    def shrink(pool: Column) -> Column:
        return F.transform(
            pool,
            lambda i: let(
                class_total(pool, i),
                lambda held: F.struct(
                    _with_weight(
                        i,
                        F.when(held > category_cap, i["weight"] * ratio(category_cap, held))
                        .otherwise(i["weight"]),
                    ).alias("item"),
                    (held > category_cap).alias("shrunk"),
                ),
            ),
        )

    def hand_out(pool: Column) -> Column:
        open_names = F.filter(pool, lambda i: i["weight"] < single_cap - TOLERANCE)

        def spread(left: Column) -> Column:
            return let(
                total(open_names, lambda i: i["raw"]),
                lambda room: F.when(
                    (left > TOLERANCE) & (room > 0),
                    F.transform(
                        pool,
                        lambda i: _with_weight(
                            i,
                            F.when(
                                i["weight"] < single_cap - TOLERANCE,
                                i["weight"] + ratio(i["raw"], room) * left,
                            ).otherwise(i["weight"]),
                        ),
                    ),
                ).otherwise(pool),
            )

        return let(F.lit(1.0) - total(pool, lambda i: i["weight"]), spread)

    return let(
        clipped,
        lambda pool: let(
            shrink(pool),
            lambda marked: F.when(
                any_clipped | F.exists(marked, lambda m: m["shrunk"]),
                hand_out(F.transform(marked, lambda m: m["item"])),
            ).otherwise(items),
        ),
    )


def capped_inverse_vol(names: Column, single_cap: Column, category_cap: Column) -> Column:
    """array<struct(symbol, asset_class, vol)> to array<struct(symbol, weight)>.

    Weights are proportional to 1/vol under a cap per name and per category, found by up to
    ten rounds of clipping and redistribution, then scaled to one. The caps are targets: when
    too few names are left the last scaling can lift weights above them. Names without a usable
    volatility are left out; with none left the result is empty.
    """
    usable = F.filter(names, lambda n: n["vol"].isNotNull() & (n["vol"] != 0))
    raw = F.transform(
        usable,
        lambda n: F.struct(
            n["symbol"].alias("symbol"),
            n["asset_class"].alias("asset_class"),
            ratio(F.lit(1.0), n["vol"]).alias("raw"),
            F.lit(0.0).alias("weight"),
        ),
    )
    start = let(
        raw,
        lambda pool: let(
            total(pool, lambda i: i["raw"]),
            lambda whole: F.transform(
                pool, lambda i: _with_weight(i, F.coalesce(ratio(i["raw"], whole), F.lit(0.0)))
            ),
        ),
    )
    # A round without change returns its input, so running all rounds equals stopping early.
    settled = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        start,
        lambda state, _: _cap_round(state, single_cap, category_cap),
    )
    return let(
        settled,
        lambda pool: let(
            total(pool, lambda i: i["weight"]),
            lambda whole: F.transform(
                pool,
                lambda i: F.struct(
                    i["symbol"].alias("symbol"), ratio(i["weight"], whole).alias("weight")
                ),
            ),
        ),
    )


def stop_switches(series: Column, stop_drawdown: Column, reentry_breadth: Column) -> Column:
    """Days on which a drawdown stop turns on or off.

    ``series`` is array<struct(pos, gross, breadth)> in date order. Before each day but the
    first, a running portfolio stops when its value is ``stop_drawdown`` or more below its high
    water mark, and a stopped one resumes when breadth reaches ``reentry_breadth``. The high
    water mark is not reset, so a portfolio can stop again right after it resumes.

    Only the switches are stored. Appending copies an array, so days are folded in chunks of about
    the root of their number: an inner fold gathers the switches of its chunk, and the outer one
    appends once a chunk. No array that is copied for a switch is longer than a chunk.
    """
    none = F.array().cast("array<struct<pos:int,stopped:boolean>>")

    def state_of(nav: Column, high: Column, stopped: Column, first: Column, switches: Column) -> Column:
        fields = {"nav": nav, "high": high, "stopped": stopped, "first": first, "switches": switches}
        return F.struct(*[value.alias(name) for name, value in fields.items()])

    def step(state: Column, day: Column) -> Column:
        under = ratio(state["nav"], state["high"]) - 1.0 <= -stop_drawdown
        resume = F.coalesce(day["breadth"] >= reentry_breadth, F.lit(False))
        decided = (
            F.when(state["first"], F.lit(False))
            .when(~state["stopped"], F.coalesce(under, F.lit(False)))
            .otherwise(~resume)
        )

        def move(now: Column) -> Column:
            nav = state["nav"] * (1.0 + F.when(now, F.lit(0.0)).otherwise(day["gross"]))
            switch = F.array(F.struct(day["pos"].alias("pos"), now.alias("stopped")))
            return let(
                nav,
                lambda value: state_of(
                    value,
                    F.greatest(state["high"], value),
                    now,
                    F.lit(False),
                    F.when(now != state["stopped"], F.concat(state["switches"], switch)).otherwise(
                        state["switches"]
                    ),
                ),
            )

        return let(decided, move)

    size = F.ceil(F.sqrt(F.size(series))).cast("int")

    def chunk(state: Column, number: Column) -> Column:
        days = F.slice(series, number * size + 1, size)
        start = state_of(state["nav"], state["high"], state["stopped"], state["first"], none)
        return let(
            F.aggregate(days, start, step),
            lambda end: state_of(
                end["nav"],
                end["high"],
                end["stopped"],
                end["first"],
                F.concat(state["switches"], F.array(end["switches"])),
            ),
        )

    nothing = F.array().cast("array<array<struct<pos:int,stopped:boolean>>>")
    begin = state_of(F.lit(1.0), F.lit(1.0), F.lit(False), F.lit(True), nothing)
    chunks = F.when(F.size(series) > 0, F.sequence(F.lit(0), F.ceil(F.size(series) / size).cast("int") - 1))
    whole = F.aggregate(F.coalesce(chunks, F.array().cast("array<int>")), begin, chunk)
    return F.flatten(whole["switches"])
