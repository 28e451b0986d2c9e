"""Small generators of DuckDB oracle text for the repeated query shapes."""

from __future__ import annotations


def vc(col: str, src: str, n: int | None = None, percent: bool = False, count_name: str = "count") -> str:
    p = (f", CAST(count(*) AS DOUBLE) * 100 / sum(count(*)) OVER () AS percent" if percent else "")
    lim = f" ORDER BY {count_name} DESC, {col} LIMIT {n}" if n else ""
    return (f"SELECT {col}, count(*) AS {count_name}{p} FROM {src} WHERE {col} IS NOT NULL "
            f"GROUP BY {col}{lim}")


def hist(expr: str, src: str, n: int, by: str | None = None) -> str:
    """Equal-width histogram of ``expr`` over ``src``; ``by`` = one group column."""
    g = f"{by}, " if by else ""
    on = f" USING ({by})" if by else ""
    gb = f" GROUP BY {by}" if by else ""
    return f"""
, hv AS (SELECT {g}CAST({expr} AS DOUBLE) AS x FROM {src} WHERE {expr} IS NOT NULL),
hb AS (SELECT {g}CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
              CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM hv{gb}),
hc AS (SELECT {g}least(CAST(floor({n}.0 * (x - lo) / (hi - lo)) AS BIGINT) + 1, {n}) AS bin, count(*) AS count
       FROM hv JOIN hb{on if by else ' ON TRUE'} GROUP BY ALL),
hs AS (SELECT {g}lo, hi, range AS bin FROM hb, range(1, {n} + 1))
SELECT {("hs." + by + " AS " + by + ", ") if by else ""}hs.bin, lo + (hs.bin - 1) * ((hi - lo) / {n}.0) AS bin_lo, lo + hs.bin * ((hi - lo) / {n}.0) AS bin_hi,
       coalesce(hc.count, 0) AS count
FROM hs LEFT JOIN hc ON hs.bin = hc.bin{f' AND hs.{by} = hc.{by}' if by else ''}"""
