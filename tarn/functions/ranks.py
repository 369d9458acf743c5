"""Lists of ranks worth asking for."""

from __future__ import annotations


def quartile_ranks(n: int) -> list[int]:
    """First answer, quartiles and last answer of n."""
    return sorted({0, n // 4, n // 2, 3 * n // 4, n - 1}) if n > 0 else []


def median_rank(n: int) -> list[int]:
    return [max(0, n // 2 - 1)] if n > 0 else []


def decade_ranks(n: int) -> list[int]:
    """Powers of ten below n, and the last answer."""
    out, p = [], 1
    while p < n:
        out.append(p)
        p *= 10
    return sorted({*out, n - 1}) if n > 0 else []


def rank_lists(n: int) -> dict[str, list[int]]:
    """The named lists that an experiment writes."""
    decades, quartiles, median = decade_ranks(n), quartile_ranks(n), median_rank(n)
    return {"k_list": sorted({*decades, *quartiles, *median}), "k_sql_list": decades, "k_sql_list_ext": sorted({*decades, *median}), "quartile_list": quartiles, "median_list": median}
