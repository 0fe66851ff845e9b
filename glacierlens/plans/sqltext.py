"""Small pieces of DuckDB text shared by the oracles."""

from __future__ import annotations


def R(expr: str, digits: int = 6) -> str:
    """Rounded output column.

    The small offset breaks exact decimal ties, which the two engines round
    differently; adding 0 removes a negative zero.
    """
    return f"round({expr} + 1.3e-{digits + 2}, {digits}) + 0e0"


def mid(col: str, p: float) -> str:
    """Midpoint percentile of a column as an aggregate expression."""
    pos = f"least(greatest(count({col}) * {p}e0 + 0.5e0, 1e0), cast(count({col}) as double))"
    arr = f"list_sort(list({col}))"
    lo = f"list_extract({arr}, cast(floor({pos}) as bigint))"
    hi = f"list_extract({arr}, cast(ceil({pos}) as bigint))"
    return f"({lo} + ({hi} - {lo}) * ({pos} - floor({pos})))"


def se(col: str) -> str:
    return f"(coalesce(stddev_samp({col}), 0e0) / sqrt(count(*)))"


def robust(src: str, keys: str, first: float, second: float, min_n: int, survivors: bool, flag: bool = True) -> str:
    """Two-step screen, then mean, n and se per key."""
    ks = [k.strip() for k in keys.split(",")]
    on = " and ".join(f"b.{k} = m.{k}" for k in ks)
    bk = ", ".join(f"b.{k}" for k in ks)
    mk = ", ".join(f"m.{k}" for k in ks)
    om = " and ".join(f"m.{k} = s.{k}" for k in ks)
    ok = "slope_deg <= 40" + (" and quality_flag = 0" if flag else "")
    again = f"and abs(b.dh) < {first}" if survivors else ""
    return f"""with base as (select * from {src} where {ok}),
med as (select {keys}, median(dh) as med from base where abs(dh) < {first} group by {keys}),
st as (select {bk}, count(*) as n, avg(b.dh) as mean, {se('b.dh')} as se
  from base b join med m on {on} where abs(b.dh - m.med) < {second} {again} group by {bk})
select {mk}, case when s.n >= {min_n} then {R('s.mean')} end as mean,
  case when s.n >= {min_n} then s.n else 0 end as n,
  case when s.n >= {min_n} then {R('s.se')} end as se
from med m left join st s on {om}"""


def windowed(win: str, src: str = "fp", extra: str = "") -> str:
    """Sub-select of footprints joined with a window table."""
    return f"(select f.*, w.win_kind, w.win_id from {src} f join {win} w on f.obs_day >= w.start_day and f.obs_day < w.end_day {extra})"


def inside(px: str, py: str, src: str, keys: str) -> str:
    """(keys, id) for the polygons of ``edge`` around each point of ``src``."""
    return f"""(select {keys}, e.id from {src} join edge e on true group by {keys}, e.id, {px}, {py}
  having sum(case when (y1 > {py}) <> (y2 > {py})
      and {px} < (x2 - x1) * ({py} - y1) / (y2 - y1) + x1 then 1 else 0 end) % 2 = 1
    or max(case when (x2 - x1) * ({py} - y1) - (y2 - y1) * ({px} - x1) = 0 and {px} between least(x1, x2) and greatest(x1, x2)
      and {py} between least(y1, y2) and greatest(y1, y2) then 1 else 0 end) = 1)"""
