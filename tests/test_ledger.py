"""The credit gate on an organization of many requests."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from vatloom.operators import ledger


def test_gate_of_a_large_organization(spark):
    rng, start, rows = random.Random(4), datetime(2024, 1, 1), []
    for seq in range(25_000):
        org = 1 if seq % 50 else rng.choice([None, 2, 3])
        rows.append((org, seq, start + timedelta(minutes=rng.randrange(40_000)), rng.choice(["TopUp", "Consume", "Consume", "Refund"]), rng.randrange(9)))
    expected, state = set(), {}
    for org, seq, ts, kind, amount in sorted(rows, key=lambda r: (r[2], r[1])):
        balance, used, day = state.get(org, (0, 0, None))
        used = used if day == ts.date() else 0
        ok = kind != "Consume" or (balance >= amount and used + amount <= 20)
        if kind != "Consume":
            balance += amount
        elif ok:
            balance, used = balance - amount, used + amount
        state[org] = balance, used, ts.date()
        expected.add((org, seq, ok, balance))
    out = ledger.gate(spark.createDataFrame(rows, "org_id long, seq long, ts timestamp, type string, amount long"), daily_cap=20)
    assert {tuple(r) for r in out.collect()} == expected
    assert "collect_list" not in out._jdf.queryExecution().toString()  # no row holds an organization


def test_gate_with_nulls(spark):
    rows = [(1, 1, "TopUp", 5), (1, 2, "Consume", 9), (1, 3, None, 2), (1, 4, "Consume", None), (1, 5, "Consume", 1), (1, 6, "Consume", 30), (1, 7, "Refund", 1)]
    rows = [(o, s, datetime(2024, 1, 1, 0, s), k, a) for o, s, k, a in rows]
    out = ledger.gate(spark.createDataFrame(rows, "org_id long, seq long, ts timestamp, type string, amount long"), daily_cap=20)
    got = [(r["seq"], r["accepted"], r["balance"]) for r in out.orderBy("seq").collect()]
    assert got == [(1, True, 5), (2, False, 5), (3, True, 7), (4, None, None), (5, None, None), (6, False, None), (7, True, None)]
