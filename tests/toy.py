"""Rows and names that several tests share."""

from __future__ import annotations

import random

COLS = ["a", "b", "c", "d"]
TOY_ROWS = 276
SCHEMA = "row_id BIGINT, a STRING, b STRING, c STRING, d STRING, y INT, group_id STRING"


def toy_rows(n: int = TOY_ROWS, seed: int = 77) -> list[tuple]:
    """Columns of five, three, four and two levels; two of them shift the share of positive labels. Duplicates occur."""
    rng = random.Random(seed)
    share = {"ash": 0.2, "elm": 0.45, "fir": 0.7}
    rows = []
    for i in range(n):
        a, b = rng.choice(["red", "blue", "green", "grey", "pink"]), rng.choice(list(share))
        c, d = rng.choice(["n", "e", "s", "w"]), rng.choice(["on", "off"])
        rows.append((i, a, b, c, d, int(rng.random() < share[b] + 0.25 * (d == "on"))))
    return rows


def with_groups(rows: list[tuple]) -> list[tuple]:
    return [(*r, "|".join(r[1:5])) for r in rows]
