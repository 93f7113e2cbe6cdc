"""Folds over ordered rows of a key: bankroll paths with floors, and settlement plans.

Where a step depends on what earlier steps decided, rows of a key are read in order
as a stream, with a small state; the sort may spill, and nothing is gathered but the
rows of one block (a day or a week of one path). Keys run beside each other; one key
is one sequence, as its rule has it.
"""

from __future__ import annotations

import hashlib
import math
from collections import namedtuple
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pitwise.functions.rates import kelly


def _listed(column: pa.Array) -> list:
    """The column's values; those of plain numbers and of few distinct words or days are not made one by one."""
    kind = column.type
    if column.null_count == 0 and (pa.types.is_integer(kind) or pa.types.is_floating(kind)):
        return column.to_numpy().tolist()
    if column.null_count == 0 and (pa.types.is_string(kind) or pa.types.is_date(kind)):
        coded = column.dictionary_encode()
        return list(map(coded.dictionary.to_pylist().__getitem__, coded.indices.to_numpy().tolist()))
    return column.to_pylist()


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], schema: T.StructType, begin: Callable[[Any], Any], step: Callable[[Any, Any], list[tuple]], end: Callable[[Any], list[tuple]] = lambda state: []) -> DataFrame:
    """Rows that ``step`` (and ``end``, after a key's last row) give for the rows of each key in order.

    ``begin`` makes the state from a key's first row; null keys are a key.
    """
    columns, arrow = df.columns, to_arrow_schema(schema)

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*out), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = namedtuple("row", columns)
        at, state, out = None, None, []
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                for values in zip(*(_listed(c) for c in batch.slice(first, 4096).columns)):
                    row = kind(*values)
                    key = values[: len(keys)]
                    if state is None or key != at:
                        if state is not None:
                            out += end(state)
                        at, state = key, begin(row)
                    out += step(state, row)
                if len(out) > 4096:
                    yield made(out)
                    out = []
        if state is not None:
            out += end(state)
        if out:
            yield made(out)

    rows = df.select(*keys, *[c for c in columns if c not in keys])
    columns = rows.columns
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def staking_paths(df: DataFrame, keys: list[str], order: list[str], id: str, block: str | None = None, k: float = 0.25, start: float = 1000.0, friction_bps: float = 0.0, least: float = 1.0, shortfall: str = "skip", weights: str = "kelly") -> DataFrame:
    """Stake, profit and equity of every bet of compounding paths: keys, ``id``, stake, profit, equity.

    Needs ``p``, ``odds`` and ``won``. Without ``block``, each bet is staked from the equity before it: ``k`` times edge
    over net odds of it, ``least`` at least while more than that is there. With ``block`` (a day, a week), all bets of a
    block are staked from its opening equity: ``k`` of it, shared by Kelly fraction (``weights="kelly"``), by edge, or
    equally among bets with an edge; each is raised to ``least``, and where that is more than there is, ``shortfall``
    says whether the block is skipped or scaled to ``all-in``. ``friction_bps`` of every stake is paid, won or lost. A
    path without more than ``least`` before a block ends: its further bets have no stake.
    """
    key_fields = [df.schema[c] for c in keys]
    schema = T.StructType([*key_fields, df.schema[id], *[T.StructField(c, T.DoubleType()) for c in ("stake", "profit", "equity")]])
    cost, m = friction_bps / 10_000, len(keys)

    def profit(stake: float, row: Any) -> float:
        return (stake * (row.odds - 1) if row.won else -stake) - stake * cost

    def one(state: dict, row: Any) -> list[tuple]:
        edge, equity = row.p - 1 / row.odds, state["equity"]
        stake = 0.0
        if edge > 0 and equity > least:
            stake = max(least, min(equity, equity * min(1.0, k * edge / max(row.odds - 1, 1e-9))))
        gain = profit(stake, row)
        state["equity"] = max(0.0, equity + gain)
        return [(*row[:m], getattr(row, id), stake, gain, state["equity"])]

    def weight(row: Any) -> float:
        edge = row.p - 1 / row.odds
        return max(0.0, (row.p * row.odds - 1) / max(row.odds - 1, 1e-9)) if weights == "kelly" else max(0.0, edge) if weights == "edge" else float(edge > 0)

    def closed(state: dict) -> list[tuple]:
        rows, equity = state["rows"], state["equity"]
        state["rows"] = []
        shares = [weight(r) for r in rows]
        total = sum(shares)
        stakes = [0.0] * len(rows)
        if total > 0 and equity > least and not state["over"]:
            stakes = [max(least, min(k, 1.0) * equity * s / total) if s > 0 else 0.0 for s in shares]
            asked = sum(stakes)
            if asked > equity:
                stakes = [0.0] * len(rows) if shortfall == "skip" else [s * (equity / asked) for s in stakes]
        state["over"] |= equity <= least
        gains = [profit(s, r) for s, r in zip(stakes, rows)]
        state["equity"] = max(0.0, equity + sum(gains))
        return [(*r[:m], getattr(r, id), s, g, state["equity"]) for r, s, g in zip(rows, stakes, gains)]

    def collected(state: dict, row: Any) -> list[tuple]:
        out = closed(state) if state["rows"] and getattr(state["rows"][0], block) != getattr(row, block) else []
        state["rows"].append(row)
        return out

    fresh = lambda row: {"equity": start, "rows": [], "over": False}
    if block is None:
        return ordered_fold(df, keys, order, schema, fresh, one)
    return ordered_fold(df, keys, [block, *order], schema, fresh, collected, closed)


#: Sizes of logarithms and of money in which :func:`strategy_paths` counts: whole numbers, so that sums do not drift with a path's length.
LOGS, MONEY = 10**12, 10**6


def strategy_paths(df: DataFrame, keys: list[str], order: list[str], id: str, strategies: dict[str, tuple[str, float, float | None]], start: float = 1000.0, least: float = 0.1) -> DataFrame:
    """Every bet of staking strategies beside each other, each with its own bankroll for each key: strategy, keys, ``id``, placed, log_equity, equity.

    Needs ``p``, ``odds`` and ``won`` of the side that is bet on. A strategy is a rule, its share of the Kelly fraction, and the most of the bankroll
    that a bet may take (None: no limit). ``growing``: stakes are of the bankroll as it is; one below ``least`` is not placed. ``raised``: likewise, but
    raised to ``least`` while that is there. ``level``: stakes are of ``start`` whatever is left. A bet without a Kelly fraction is not placed. What
    grows has a logarithm (null once all is lost), as it leaves the range of doubles; what is level has an ``equity``, which may be below zero.
    """
    whole = lambda x, size: math.floor(x * size + 0.5)
    names, rules = list(strategies), [rule for rule, _, _ in strategies.values()]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("strategy"), F.lit(share).alias("share"), F.lit(most).cast("double").alias("most")) for i, (_, share, most) in enumerate(strategies.values())])).alias("s")
    own = [c for c in dict.fromkeys([*keys, *order, id])]
    rows = df.select(*own, "won", "odds", kelly(F.col("p"), F.col("odds")).alias("f"), each)
    rows = rows.select("s.strategy", *own, F.least("s.most", F.col("s.share") * F.col("f")).alias("f"), F.when(F.col("won"), F.col("odds") - 1).otherwise(-1.0).alias("gained"))
    floor, floor_money = whole(math.log(least), LOGS), whole(least, MONEY)
    schema = T.StructType([rows.schema["strategy"], *[rows.schema[c] for c in keys], rows.schema[id], T.StructField("placed", T.BooleanType()), T.StructField("log_equity", T.DoubleType()), T.StructField("equity", T.DoubleType())])
    m, mine = len(keys) + 1, rows.columns.index(id)

    def begin(row: Any) -> dict:
        rule = rules[row.strategy]
        return {"rule": rule, "total": whole(start, MONEY) if rule == "level" else whole(math.log(start), LOGS)}

    def grown(left: float, total: int = 0) -> int | None:
        return total + whole(math.log(left), LOGS) if left > 0 else None

    def step(state: dict, row: Any) -> list[tuple]:
        total, rule, f, placed = state["total"], state["rule"], row.f, False
        if rule == "level":
            placed = f > 0 and whole(start * f, MONEY) >= floor_money
            state["total"] = total = total + whole(start * f * row.gained, MONEY) if placed else total
            return [(*row[:m], row[mine], placed, None, total / MONEY)]
        if f > 0 and total is not None:
            if total + whole(math.log(f), LOGS) >= floor:
                placed, total = True, grown(1 + f * row.gained, total)
            elif rule == "raised" and total >= floor:
                placed, total = True, grown(math.exp(total / LOGS) + least * row.gained)
            state["total"] = total
        return [(*row[:m], row[mine], placed, None if total is None else total / LOGS, None)]

    found = ordered_fold(rows, ["strategy", *keys], order, schema, begin, step)
    return found.withColumn("strategy", F.get(F.array(*[F.lit(n) for n in names]), F.col("strategy")))


#: Why a pending bet is not settled, in the order in which reasons are given.
REFUSALS = ("account_blocked", "nonunique_bet_id", "no_result", "ambiguous_match", "conflicting_winners", "void", "unresolved", "pair_mismatch", "date_mismatch", "side_not_in_pair", "side_orientation", "invalid_stake", "invalid_odds")


def _pair(one: Column, two: Column) -> Column:
    return F.concat_ws("|", F.least(one, two), F.greatest(one, two))


def resolved_results(results: DataFrame) -> DataFrame:
    """One row for each match of ``results`` (match_id, p1, p2, date, winner): its pair, date, winner's name and state.

    Rows of one match may name the sides in either order: winners are compared by name. Several pairs or dates make a
    match ambiguous; several winners, or a winner and a cancellation (winner -1), conflict; only cancellations are void.
    """
    name = F.when(F.col("winner") == 1, F.col("p1")).when(F.col("winner") == 2, F.col("p2"))
    pair = _pair(F.col("p1"), F.col("p2"))
    g = results.groupBy("match_id").agg(
        F.min(pair).alias("pair"), F.max(pair).alias("_pair"), F.min("date").alias("date"), F.max("date").alias("_date"),
        F.min(name).alias("winner_name"), F.max(name).alias("_name"), F.bool_or(F.col("winner") == -1).alias("_void"))
    void = F.coalesce("_void", F.lit(False))
    state = F.when((F.col("pair") != F.col("_pair")) | (F.col("date") != F.col("_date")), "ambiguous_match").when((F.col("winner_name") != F.col("_name")) | (void & F.col("winner_name").isNotNull()), "conflicting_winners").when(void, "void").when(F.col("winner_name").isNull(), "unresolved").otherwise("winner")
    return g.select("match_id", "pair", "date", "winner_name", state.alias("state"))


def settlement_plan(bets: DataFrame, results: DataFrame, capital: int) -> DataFrame:
    """What settling every pending bet would do, without doing it: reasons against it, or its place, profit and capital after.

    ``bets``: source_row, bet_id, account, match_id, p1, p2, date, bet_on, on_first, stake (cents), odds (hundredths),
    status (pending or settled), profit (of settled ones). Money is in hundredths of cents, so all of it is exact.
    All conflicts are found before anything changes: an account with a settled bet whose profit is not that of its price
    settles nothing; a bet is refused by its own faults and those of its match. What is left of an account is settled in
    order of date, match and id, from ``capital`` and its settled profits; a stake above the capital of its moment is
    refused and changes nothing. ``digest`` chains the account's plan up to each bet.
    """
    settled = F.col("status") == "settled"
    fair = (F.col("profit") == F.col("stake") * (F.col("odds") - 100)) | (F.col("profit") == -F.col("stake") * 100)
    accounts = bets.groupBy("account").agg(F.coalesce(F.sum(F.when(settled, F.col("profit"))), F.lit(0)).alias("settled_profit"), F.coalesce(F.bool_or(settled & ~F.coalesce(fair, F.lit(False))), F.lit(False)).alias("blocked"))
    repeated = bets.groupBy("bet_id").agg((F.count("*") > 1).alias("repeated"))
    pending = bets.where(F.col("status") == "pending").withColumn("bet_pair", _pair(F.col("p1"), F.col("p2"))).withColumnRenamed("date", "bet_date")
    rows = pending.join(accounts, "account").join(repeated, "bet_id").join(resolved_results(results), "match_id", "left")
    inside = F.col("bet_on").isin(F.col("p1"), F.col("p2"))
    faults = {
        "account_blocked": F.col("blocked"), "nonunique_bet_id": F.col("repeated"), "no_result": F.col("state").isNull(), **{s: F.col("state") == s for s in ("ambiguous_match", "conflicting_winners", "void", "unresolved")},
        "pair_mismatch": F.col("pair") != F.col("bet_pair"), "date_mismatch": F.col("date") != F.col("bet_date"), "side_not_in_pair": ~inside, "side_orientation": inside & (F.col("on_first") != (F.col("bet_on") == F.col("p1"))), "invalid_stake": ~(F.col("stake") > 0), "invalid_odds": ~(F.col("odds") > 100),
    }
    named = [F.when(F.coalesce(faults[r], F.lit(r.startswith("invalid"))), F.lit(r)) for r in REFUSALS]
    reasons = F.array_join(F.filter(F.array(*named), lambda x: x.isNotNull()), ",")
    won = F.col("bet_on") == F.col("winner_name")
    gain = F.when(won, F.col("stake") * (F.col("odds") - 100)).otherwise(-F.col("stake") * 100)
    rows = rows.select("account", "source_row", "bet_id", "match_id", "bet_date", "stake", reasons.alias("reasons"), won.alias("won"), gain.alias("gain"), "settled_profit")
    refused = rows.where("reasons <> ''").select("account", "source_row", "bet_id", "reasons", *[F.lit(None).cast(t).alias(c) for c, t in (("result", "string"), ("profit", "bigint"), ("place", "bigint"), ("after", "bigint"), ("digest", "string"))])

    def step(state: dict, row: Any) -> list[tuple]:
        if row.stake * 100 > state["capital"]:
            return [(row.account, row.source_row, row.bet_id, "insufficient_capital", None, None, None, None, None)]
        state["place"] += 1
        state["capital"] += row.gain
        state["digest"] = hashlib.sha256(f"{state['digest']}|{row.bet_id}:{row.gain}:{state['capital']}".encode()).hexdigest()
        return [(row.account, row.source_row, row.bet_id, "", "win" if row.won else "loss", row.gain, state["place"], state["capital"], state["digest"])]

    planned = ordered_fold(rows.where("reasons = ''"), ["account"], ["bet_date", "match_id", "bet_id"], refused.schema, lambda row: {"capital": capital + row.settled_profit, "place": 0, "digest": ""}, step)
    return refused.unionByName(planned)
