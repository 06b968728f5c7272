"""3x3 matrices as SQL text, for the DuckDB side of queries."""

from __future__ import annotations

Entries = list[list[str]]


def product_sql(a: Entries, b: Entries) -> Entries:
    return [["(" + " + ".join(f"({a[r][k]}) * ({b[k][c]})" for k in range(3)) + ")" for c in range(3)] for r in range(3)]


def inverse_sql(a: Entries) -> Entries:
    minor = lambda r, c: f"(({a[(r + 1) % 3][(c + 1) % 3]}) * ({a[(r + 2) % 3][(c + 2) % 3]}) - ({a[(r + 1) % 3][(c + 2) % 3]}) * ({a[(r + 2) % 3][(c + 1) % 3]}))"
    det = " + ".join(f"({a[0][c]}) * {minor(0, c)}" for c in range(3))
    return [[f"CASE WHEN ({det}) = 0 THEN {float(r == c)} ELSE {minor(c, r)} / nullif({det}, 0) END" for c in range(3)] for r in range(3)]
