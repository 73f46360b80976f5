"""Slot and cash allocation of one portfolio configuration.

Runs inside Spark tasks, so it depends on pandas alone.
"""

from __future__ import annotations

import pandas as pd

from tidemark import constants as C

FOLD_SCHEMA = "config_id string, kind string, date date, ticker string, seq int, price double, " \
    "k double, shares double, invested double, exit_date date, exit_price double, " \
    "exit_reason string, n_free int, n_bought int, n_positions int, cash double"


def fold_slots(rows: pd.DataFrame) -> pd.DataFrame:
    """Allocate slots and cash of one configuration, Monday by Monday.

    ``rows``: one row per Monday without ticker, plus its best macro-passing candidates in order.
    """
    config, size = rows["config_id"].iloc[0], int(rows["max_positions"].iloc[0])
    stake, cash = C.CAPITAL / size, C.CAPITAL
    held: dict[str, dict] = {}
    out: list[dict] = []
    by_day = rows.sort_values(["date", "place"]).groupby("date", sort=True)
    for day, group in by_day:
        gone = sorted((t for t, p in held.items()
                       if p["exit_date"] is not None and p["exit_date"] <= day),
                      key=lambda t: held[t]["exit_date"])
        for ticker in gone:
            trade = held.pop(ticker)
            cash += trade["shares"] * trade["exit_price"]
        free = size - len(held)
        wanted = [r for r in group.itertuples() if isinstance(r.ticker, str) and r.ticker not in held]
        picked = wanted[:free] if free > 0 else []
        for r in picked:
            money = min(stake, cash)
            if not r.has_bar or money < C.MIN_INVESTMENT:
                continue
            cash -= money
            trade = {"config_id": config, "kind": "trade", "date": day, "ticker": r.ticker,
                     "seq": int(r.seq), "price": r.price, "k": r.k, "shares": money / r.price,
                     "invested": money,
                     "exit_date": r.exit_date if not pd.isna(r.exit_date) else None,
                     "exit_price": r.exit_price if not pd.isna(r.exit_date) else None,
                     "exit_reason": r.exit_reason if not pd.isna(r.exit_date) else None}
            held[r.ticker] = trade
            out.append(trade)
        out.append({"config_id": config, "kind": "week", "date": day, "n_free": free,
                    "n_bought": len(picked), "n_positions": len(held), "cash": cash})
    columns = [c.split()[0] for c in FOLD_SCHEMA.split(", ")]
    return pd.DataFrame(out, columns=columns)
