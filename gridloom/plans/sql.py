"""DuckDB text of the grids and stencils that the queries share."""

from __future__ import annotations

from gridloom.operators.stencil import Offset, name

CUBE = "cube as materialized (select cast(floor(l_quantity) as int) i, cast(floor(l_discount * 100 + 0.5) as int) j, cast(floor(l_tax * 100 + 0.5) as int) k, cast(sum(cast(floor(l_extendedprice * 100 + 0.5) as bigint)) as double) / 100 as value, true as active from lineitem group by all)"
EVENTS = "events_grid as (select cast(user_id as int) i, cast(day(ts) as int) j, cast(hour(ts) as int) k, cast(sum(cast(floor(value * 100 + 0.5) as bigint)) as double) / 100 as value, true as active from events group by all)"
VECTORS = "vectors as (select vec_id as id, cast(embedding[1] as double) * 100 px, cast(embedding[2] as double) * 100 py, cast(embedding[3] as double) * 100 pz, label from embeddings)"
ITEMS = "items as (select l_orderkey * 8 + l_linenumber as id, l_quantity px, l_extendedprice / 1000 py, l_partkey / 40.0 pz, l_discount discount, l_tax tax, l_returnflag flag, l_linestatus status from lineitem)"
LOCATED = "located as (select *, cast(floor(px + 0.5) as int) i, cast(floor(py + 0.5) as int) j, cast(floor(pz + 0.5) as int) k from {0})"

#: Narrow band of spheres around the vectors; a sphere's rows are its box.
BALLS = "balls as materialized (select px, py, pz, 1.0 + label * 0.25 as r from vectors), ball as materialized (select i, j, k, value, true as active from (select i, j, k, min(sqrt((i - px) * (i - px) + (j - py) * (j - py) + (k - pz) * (k - pz)) - r) as value from (select *, unnest(range(cast(ceil(pz - (r + 1.5)) as int), cast(floor(pz + (r + 1.5)) as int) + 1)) as k from (select *, unnest(range(cast(ceil(py - (r + 1.5)) as int), cast(floor(py + (r + 1.5)) as int) + 1)) as j from (select *, unnest(range(cast(ceil(px - (r + 1.5)) as int), cast(floor(px + (r + 1.5)) as int) + 1)) as i from balls))) group by i, j, k) where abs(value) < 1.5)"


def flag(f: str) -> str:
    return f"{f.lower()} as (select cast(floor(l_quantity) as int) i, cast(floor(l_extendedprice / 2500) as int) j, cast(l_partkey % 50 as int) k, cast(sum(cast(floor(l_extendedprice * 100 + 0.5) as bigint)) as double) / 100 as value, true as active from lineitem where l_returnflag = '{f}' group by all)"


def kind(e: str) -> str:
    return f"{e} as (select cast(user_id as int) i, cast(day(ts) as int) j, cast(hour(ts) as int) k, cast(sum(cast(floor(value * 100 + 0.5) as bigint)) as double) / 100 as value, true as active from events where event_type = '{e}' group by all)"


def sphere(n: int, centre: tuple[float, float, float], radius: float, half: float, as_: str = "ball") -> str:
    d = " + ".join(f"({c} - {x}) * ({c} - {x})" for c, x in zip("ijk", centre))
    return f"{as_} as materialized (select *, true as active from (select i, j, k, sqrt({d}) - {radius} as value from {axes(n)}) where abs(value) < {half})"


def axes(n: int) -> str:
    return ", ".join(f"(select cast(range as int) {c} from range({n})) r{c}" for c in "ijk")


def near(table: str, offsets: list[Offset], background: float = 0.0, values: tuple[str, ...] = ("value",)) -> str:
    """Active voxels of a table with their neighbours' values as columns: voxels send theirs, and a group gets all."""
    many = len(values) > 1
    sent = ", ".join(str((n, *[-x for x in o])) for n, o in enumerate([(0, 0, 0), *offsets]))
    moved = f"(select t.i + di as i, t.j + dj as j, t.k + dk as k, {', '.join(values)}, active, o from {table} t cross join (values {sent}) s(o, di, dj, dk))"
    own = [f"max(case when o = 0 then {v} end) as {v}" for v in (*values, "active")]
    columns = [f"coalesce(max(case when o = {n} then {v} end), {background}) as {name(o)}{'_' + v if many else ''}" for n, o in enumerate(offsets, 1) for v in values]
    return f"(select i, j, k, {', '.join([*own, *columns])} from {moved} group by i, j, k having max(case when o = 0 then active end))"


def paired(a: str, b: str, bg_a: float = 0.0, bg_b: float = 0.0) -> str:
    return f"(select i, j, k, coalesce(x.value, {bg_a}) as a, coalesce(y.value, {bg_b}) as b, coalesce(x.active, false) as on_a, coalesce(y.active, false) as on_b, x.active is not null as has_a from {a} x full join {b} y using (i, j, k))"


def r(x: str, digits: int = 6) -> str:
    """A rounded number without a negative zero."""
    return f"round({x}, {digits}) + 0.0"
