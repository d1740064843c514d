"""DuckDB SQL for the registered queries, built from common table expressions."""

from __future__ import annotations

from strandpack.operators import rivals, sizing
from strandpack.plans import samples

WRAP = "((({x}) + 2147483648) & 4294967295) - 2147483648"
ZIGZAG = "CASE WHEN ({x}) < 0 THEN -2 * ({x}) - 1 ELSE 2 * ({x}) END"
BW = "CASE WHEN ({x}) = 0 THEN 0 ELSE length(bin({x})) END"


def wrap(x: str) -> str:
    return WRAP.format(x=x)


def lag(v: str, keys: str, order: str = "i", default: str = "") -> str:
    return f"lag({v}{', 1, ' + default if default else ''}) OVER (PARTITION BY {keys} ORDER BY {order})"


def width(m: str) -> str:
    return "CASE " + " ".join(f"WHEN {m} <= {most} THEN {bits}" for most, bits in sizing.WIDTHS[:-1]) + f" ELSE {sizing.WIDTHS[-1][1]} END"


def core(src: str, keys: str, ref: str = "TRUE", name: str = "core") -> str:
    """CTEs from ``src`` (keys, i, v) to ``name`` (keys, n, bytes), with blocks and runs on the way."""
    return f"""
{name}_d AS (SELECT *, {wrap('v - ' + lag('v', keys))} AS d, count(*) OVER (PARTITION BY {keys}) AS n_all FROM {src}),
{name}_s AS (SELECT *, CASE WHEN n_all // 10 < 10 THEN least(n_all, 100) ELSE least(n_all // 10, 1000) END AS sample, CASE WHEN d = -2147483648 THEN d ELSE abs(d) END AS mag FROM {name}_d),
{name}_b AS (SELECT {keys}, CASE WHEN i = 0 THEN -1 ELSE (i - 1) // 8 END AS blk, count(d) AS n, count(CASE WHEN abs(d) > 32767 THEN 1 END) AS n_out,
  coalesce(max(CASE WHEN abs(d) <= 32767 THEN abs(d) END), 0) AS m, coalesce(max(abs(d)) = 0, FALSE) AND count(d) = 8 AS zero, max(n_all) AS n_all, max(sample) AS sample,
  sum(CASE WHEN i >= 1 AND i < sample THEN mag ELSE 0 END) AS gate_sum, count(CASE WHEN i >= 1 AND i < sample AND mag > 32767 THEN 1 END) AS gate_out,
  coalesce(max(CASE WHEN i >= 1 AND i < sample THEN mag END), 0) AS gate_max FROM {name}_s GROUP BY {keys}, CASE WHEN i = 0 THEN -1 ELSE (i - 1) // 8 END),
{name}_i AS (SELECT *, sum(CASE WHEN zero THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY blk ROWS UNBOUNDED PRECEDING) AS island FROM {name}_b),
{name}_p AS (SELECT *, row_number() OVER (PARTITION BY {keys}, island, zero ORDER BY blk) - 1 AS pos, count(*) OVER (PARTITION BY {keys}, island, zero) AS run FROM {name}_i),
{name}_e AS (SELECT *, zero AND least(65535, run - (pos // 65535) * 65535) >= 8 AS escaped FROM {name}_p),
{name}_t AS (SELECT *, CAST(CASE WHEN blk < 0 THEN 0 WHEN escaped THEN CASE WHEN pos % 65535 = 0 THEN 28 ELSE 0 END
  ELSE 4 + CASE WHEN n_out > 0 THEN 8 ELSE 0 END + (n - n_out) * ({width('m')}) + 32 * n_out END AS BIGINT) AS bits, least(1 + (blk + 1) * 8, n_all) AS upto FROM {name}_e),
{name}_c AS (SELECT *, CAST(sum(bits) OVER (PARTITION BY {keys} ORDER BY blk ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM {name}_t),
{name}_g AS (SELECT {keys}, max(n_all) AS n, CAST(sum(bits) AS BIGINT) AS bits, max(sample) AS sample, CAST(sum(gate_sum) AS BIGINT) AS gate_sum, CAST(sum(gate_out) AS BIGINT) AS gate_out, max(gate_max) AS gate_max,
  min(blk) FILTER (blk >= 0 AND NOT escaped AND upto >= least(64, n_all)) AS look FROM {name}_c GROUP BY {keys}),
{name}_a AS (SELECT g.*, c.upto AS seen_to, c.so_far // 8 + CASE WHEN {ref.replace('{t}', 'g')} THEN 4 ELSE 0 END AS flushed FROM {name}_g g LEFT JOIN {name}_c c ON {' AND '.join(f'g.{k.strip()} IS NOT DISTINCT FROM c.{k.strip()}' for k in keys.split(','))} AND g.look = c.blk),
{name}_v AS (SELECT *, n < 2 OR NOT (CAST(CAST(gate_out AS DOUBLE) / nullif(sample - 1, 0) AS FLOAT) > CAST(0.30 AS FLOAT)
    OR CAST(trunc(CAST(gate_sum AS DOUBLE) / greatest(sample - 1, 1)) AS BIGINT) > 536870911
    OR (gate_max > 1073741823 AND CAST(CAST(gate_out AS DOUBLE) / nullif(sample - 1, 0) AS FLOAT) > CAST(CAST(CAST(0.30 AS FLOAT) AS DOUBLE) / 3 AS FLOAT))) AS gate_ok,
  coalesce(seen_to < n AND flushed > 0 AND CAST(CAST(seen_to * 4 AS DOUBLE) / nullif(flushed, 0) AS FLOAT) < CAST(1.5 AS FLOAT), FALSE) AS aborted FROM {name}_a),
{name} AS (SELECT {keys}, CAST(n AS BIGINT) AS n, CAST(CASE WHEN gate_ok AND NOT aborted THEN CASE WHEN {ref.replace('{t}.', '')} THEN 4 ELSE 0 END + (bits + 7) // 8 ELSE -1 END AS BIGINT) AS bytes FROM {name}_v)"""


def order(src: str, keys: str, name: str = "choice") -> str:
    """CTEs to ``name``_r (rows with d, dd) and ``name`` (keys, m, sum1, sum2, second)."""
    return f"""
{name}_d AS (SELECT *, {wrap('v - ' + lag('v', keys))} AS d FROM {src}),
{name}_r AS (SELECT *, {wrap('d - ' + lag('d', keys))} AS dd FROM {name}_d),
{name} AS (SELECT {keys}, count(*) AS m, CAST(coalesce(sum(CASE WHEN i < 512 THEN abs(d) END), 0) AS BIGINT) AS sum1, CAST(coalesce(sum(CASE WHEN i < 512 THEN abs(dd) END), 0) AS BIGINT) AS sum2,
  count(*) >= 3 AND coalesce(sum(CASE WHEN i < 512 THEN abs(dd) END), 0) < coalesce(sum(CASE WHEN i < 512 THEN abs(d) END), 0) AS second FROM {name}_r GROUP BY {keys})"""


def payloads(src: str, unit: str, channels: int) -> str:
    """CTEs from ``src`` (unit, i, ch, v) to payload (unit, ch, second, raw, bytes, passed)."""
    on = " AND ".join(f"r.{k.strip()} = c.{k.strip()}" for k in unit.split(","))
    f = " AND ".join(f"f.{k.strip()} = u.{k.strip()}" for k in unit.split(","))
    us = ", ".join(f"r.{k.strip()}" for k in unit.split(","))
    uu = ", ".join(f"u.{k.strip()}" for k in unit.split(","))
    keys = f"{unit}, ch, second, referenced"
    return order(src, f"{unit}, ch") + f""",
own AS (SELECT {us}, r.ch, c.second, c.second AS referenced, CASE WHEN c.second THEN r.i - 1 ELSE r.i END AS i, CASE WHEN c.second THEN r.d ELSE r.v END AS v
        FROM choice_r r JOIN choice c ON {on} AND r.ch = c.ch WHERE NOT c.second OR r.i > 0),
units AS (SELECT DISTINCT {unit} FROM {src}),
refs AS (SELECT {uu}, -1 AS ch, FALSE AS second, TRUE AS referenced, k.k AS i, coalesce(f.v, 0) AS v FROM units u CROSS JOIN (SELECT unnest(range({channels})) AS k) k LEFT JOIN {src} f ON {f} AND f.ch = k.k AND f.i = 0),
parts AS (SELECT * FROM own UNION ALL BY NAME SELECT * FROM refs),""" + core("parts", keys, "{t}.referenced") + f""",
raws AS (SELECT *, CAST(CASE WHEN ch < 0 THEN {4 * channels} WHEN second THEN n * 4 ELSE (n - 1) * 4 END AS BIGINT) AS raw FROM core),
payload AS (SELECT {unit}, ch, second, raw, CASE WHEN bytes > 0 AND bytes < raw AND (ch >= 0 OR {channels} >= 3) THEN bytes ELSE raw END AS bytes, NOT (bytes > 0 AND bytes < raw AND (ch >= 0 OR {channels} >= 3)) AS passed FROM raws)"""


def units(src: str, unit: str, channels: int) -> str:
    return payloads(src, unit, channels) + f""",
unit_size AS (SELECT {unit}, CAST(sum(bytes) + {2 + 2 * ((channels + 7) // 8)} AS BIGINT) AS bytes FROM payload GROUP BY {unit})"""


def framed(per_frame: int, name: str = "framed") -> str:
    return f"{name} AS (SELECT stream, rec // {per_frame} AS frame, rec % {per_frame} AS i, ch, v FROM samples)"


def frames(channels: int, per_frame: int) -> str:
    return framed(per_frame) + "," + units("framed", "stream, frame", channels) + f""",
frame AS (SELECT u.stream, u.frame, c.n_rec, u.bytes + {sizing.FRAME_HEADER} AS bytes FROM unit_size u JOIN (SELECT stream, frame, count(*) AS n_rec FROM framed WHERE ch = 0 GROUP BY ALL) c ON u.stream = c.stream AND u.frame = c.frame)"""


def zigzagged(src: str, unit: str) -> str:
    v = wrap("v - " + lag("v", f"{unit}, ch", default="0"))
    return f"""
zz_d AS (SELECT *, {v} AS dz FROM {src}),
zz_u AS (SELECT *, {ZIGZAG.format(x='dz')} AS u FROM zz_d),
zz AS (SELECT *, {BW.format(x='u')} AS bw FROM zz_u)"""


def family(src: str, unit: str) -> str:
    above = ", ".join(f"count(CASE WHEN bw > {b} THEN 1 END) AS e{b}" for b in range(33))
    cost = "least(" + ", ".join(f"CASE WHEN e{b} <= {rivals.MOST_EXCEPTIONS} THEN {16 + 128 * b} + e{b} * {40 - b} END" for b in range(33)) + ")"
    return zigzagged(src, unit) + f""",
tile AS (SELECT {unit}, ch, i // 128 AS tile, count(*) AS n, max(bw) AS widest, sum(greatest(1, (bw + 6) // 7)) AS vb, sum(CASE WHEN u < 256 THEN 1 WHEN u < 65536 THEN 2 WHEN u < 16777216 THEN 3 ELSE 4 END) AS sv, {above} FROM zz GROUP BY {unit}, ch, i // 128),
family AS (SELECT {unit}, ch, CAST(sum(n) AS BIGINT) AS n, CAST(sum(vb) AS BIGINT) AS vbyte, CAST((sum(n) + 3) // 4 + sum(sv) AS BIGINT) AS svb,
  CAST(sum(CASE WHEN n = 128 THEN 1 + widest * 16 ELSE vb END) AS BIGINT) AS bp128,
  CAST((sum(CASE WHEN n = 128 THEN {cost} ELSE 0 END) + 7) // 8 + sum(CASE WHEN n = 128 THEN 0 ELSE vb END) AS BIGINT) AS optpfd FROM tile GROUP BY {unit}, ch)"""


def sprintz(src: str, unit: str, channels: int) -> str:
    d = wrap("v - " + lag("v", f"{unit}, ch"))
    return f"""
sp_d AS (SELECT *, {d} AS ds FROM {src}),
sp_u AS (SELECT *, CASE WHEN i > 0 THEN (i - 1) // 8 ELSE -1 END AS blk, {ZIGZAG.format(x='ds')} AS us FROM sp_d),
sp_c AS (SELECT {unit}, blk, ch, coalesce(max({BW.format(x='us')}), 0) AS b, count(*) AS n FROM sp_u GROUP BY {unit}, blk, ch),
sp_b AS (SELECT {unit}, blk, sum(b) AS b, max(n) AS n FROM sp_c GROUP BY {unit}, blk),
sp_z AS (SELECT *, b = 0 AND n = 8 AND blk >= 0 AS zero FROM sp_b),
sp_i AS (SELECT *, sum(CASE WHEN zero THEN 0 ELSE 1 END) OVER (PARTITION BY {unit} ORDER BY blk ROWS UNBOUNDED PRECEDING) AS island FROM sp_z),
sp_p AS (SELECT *, row_number() OVER (PARTITION BY {unit}, island, zero ORDER BY blk) - 1 AS pos FROM sp_i),
sprintz AS (SELECT {unit}, CAST(sum(n) AS BIGINT) AS n_rec, CAST((sum(CASE WHEN blk < 0 THEN {32 * channels} WHEN zero THEN CASE WHEN pos % 255 = 0 THEN 9 ELSE 0 END WHEN n = 8 THEN {1 + 6 * channels} + b * 8 ELSE n * {32 * channels} END) + 7) // 8 AS BIGINT) AS sprintz FROM sp_p GROUP BY {unit})"""


def query(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(c.strip().strip(",") for c in ctes) + "\n" + select.strip()


EVENTS, LINEITEM, ORDERS = samples.EVENTS_SQL, samples.LINEITEM_SQL, samples.ORDERS_SQL
#: The samples with ``i`` for ``rec``, as streams that are not framed.
WHOLE = "whole AS (SELECT stream, ch, rec AS i, v FROM samples)"
