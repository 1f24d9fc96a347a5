"""Queries of the work allocation family: parts to suppliers."""

from __future__ import annotations

from tidelog.operators import allocate
from tidelog.plans.registry import query
from tidelog.sources.derive import Tables

_OUT = ["queue", "unit", "owner"]
_RANKED = """SELECT *, row_number() OVER (PARTITION BY queue ORDER BY unit) - 1 AS r,
  count(*) OVER (PARTITION BY queue) AS n FROM units"""


def _weighted(weight: str) -> str:
    return f"""SELECT u.queue, u.unit, coalesce(b.owner, s.owner) AS owner
  FROM ({_RANKED}) u
  LEFT JOIN blocks b ON b.queue = u.queue AND u.r >= b.lo AND u.r < b.hi
  LEFT JOIN (SELECT queue, max(hi) AS settled, count(*) AS m FROM blocks GROUP BY queue) q
    ON q.queue = u.queue
  LEFT JOIN blocks s ON b.owner IS NULL AND s.queue = u.queue AND s.turn = (u.r - q.settled) % q.m""", \
        f"""blocks AS (SELECT queue, owner, turn, least(n, ends - quota) AS lo, least(n, ends) AS hi
    FROM (SELECT *, sum(quota) OVER (PARTITION BY queue ORDER BY w DESC, owner) AS ends
      FROM (SELECT queue, owner, w, n,
          row_number() OVER (PARTITION BY queue ORDER BY w DESC, owner) - 1 AS turn,
          CAST(floor(CAST(w AS DOUBLE) / CAST(sum(w) OVER (PARTITION BY queue) AS DOUBLE) * n + 0.5)
            AS BIGINT) AS quota
        FROM (SELECT queue, owner, {weight} AS w FROM owners)
        JOIN (SELECT queue, count(*) AS n FROM units GROUP BY queue) USING (queue))))"""


def _weighted_sql(weight: str) -> str:
    body, blocks = _weighted(weight)
    return f"SELECT * FROM (WITH {blocks} {body})"


@query("alloc_capacity", "owners units", _weighted_sql("capacity"))
def alloc_capacity(t: Tables):
    return allocate.alloc_capacity(t.units(), t.owners()).select(_OUT)


@query("alloc_workload", "owners units", _weighted_sql(
    """CAST(capacity AS DECIMAL(12,4))
      * CASE WHEN sk % 2 = 0 AND contains(queue, 'batch') THEN 1.2 ELSE 1.0 END
      * CASE WHEN sk % 3 = 0 AND contains(queue, 'stream') THEN 1.2 ELSE 1.0 END
      * CASE WHEN sk % 5 = 0 AND contains(queue, 'bulk') THEN 1.1 ELSE 1.0 END"""))
def alloc_workload(t: Tables):
    return allocate.alloc_workload(t.units(), t.owners()).select(_OUT)


@query("alloc_locality", "owners units", """SELECT u.queue, u.unit, o.owner
  FROM (SELECT *, row_number() OVER (PARTITION BY queue, rack ORDER BY unit) - 1 AS r,
      CASE WHEN rack IN (SELECT rack FROM owners WHERE owners.queue = units.queue) THEN rack
        ELSE '*' END AS pool FROM units) u
  JOIN (SELECT *, row_number() OVER (PARTITION BY queue, pool ORDER BY owner) - 1 AS turn,
      count(*) OVER (PARTITION BY queue, pool) AS m
    FROM (SELECT queue, owner, rack AS pool FROM owners
          UNION ALL SELECT queue, owner, '*' FROM owners)) o
  ON o.queue = u.queue AND o.pool = u.pool AND o.turn = u.r % o.m""")
def alloc_locality(t: Tables):
    return allocate.alloc_locality(t.units(), t.owners()).select(_OUT)


_PRIORITY = f"""SELECT u.queue, u.unit, o.owner
  FROM (SELECT queue, unit, CASE WHEN r < h THEN 'HIGH' WHEN r < h + m THEN 'MEDIUM'
        WHEN r < h + m + l THEN 'LOW' END AS level,
      CASE WHEN r < h THEN r WHEN r < h + m THEN r - h ELSE r - h - m END AS pos
    FROM (SELECT *, CASE WHEN n - h - m > 0
            THEN greatest(1, CAST(floor((n - h - m) * CAST(0.2 AS DOUBLE)) AS BIGINT)) ELSE 0 END AS l
      FROM (SELECT *, CASE WHEN n - h > 0
              THEN greatest(1, CAST(floor((n - h) * CAST(0.3 AS DOUBLE)) AS BIGINT)) ELSE 0 END AS m
        FROM (SELECT *, greatest(1, CAST(floor(n * CAST(0.5 AS DOUBLE)) AS BIGINT)) AS h
              FROM ({_RANKED}))))) u
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY queue, priority ORDER BY owner) - 1 AS turn,
      count(*) OVER (PARTITION BY queue, priority) AS m FROM owners) o
  ON o.queue = u.queue AND o.priority = u.level AND o.turn = u.pos % o.m"""


@query("alloc_priority", "owners units", _PRIORITY)
def alloc_priority(t: Tables):
    return allocate.alloc_priority(t.units(), t.owners()).select(_OUT)


@query("alloc_region", "owners units", f"""SELECT u.queue, u.unit, o.owner
  FROM (SELECT queue, unit,
      CASE WHEN r < big THEN r // (each + 1) ELSE extra + (r - big) // each END AS reg,
      CASE WHEN r < big THEN r % (each + 1) ELSE (r - big) % each END AS pos
    FROM (SELECT *, extra * (each + 1) AS big
      FROM (SELECT x.*, n // regions AS each, n % regions AS extra FROM ({_RANKED}) x
        JOIN (SELECT queue, count(DISTINCT region) AS regions FROM owners GROUP BY queue)
          USING (queue)))) u
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY queue, region ORDER BY owner) - 1 AS turn,
      count(*) OVER (PARTITION BY queue, region) AS m,
      dense_rank() OVER (PARTITION BY queue ORDER BY region) - 1 AS reg FROM owners) o
  ON o.queue = u.queue AND o.reg = u.reg AND o.turn = u.pos % o.m""")
def alloc_region(t: Tables):
    return allocate.alloc_region(t.units(), t.owners()).select(_OUT)


@query("alloc_sticky", "owners units", """SELECT queue, unit, previous_owner AS owner FROM units
  WHERE (queue, previous_owner) IN (SELECT queue, owner FROM owners)
  UNION ALL SELECT u.queue, u.unit, o.owner
  FROM (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY unit) - 1 AS r FROM units v
    WHERE NOT EXISTS (SELECT 1 FROM owners w WHERE w.queue = v.queue AND w.owner = v.previous_owner)) u
  JOIN (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY owner) - 1 AS turn,
      count(*) OVER (PARTITION BY queue) AS m FROM owners) o
  ON o.queue = u.queue AND o.turn = u.r % o.m""")
def alloc_sticky(t: Tables):
    return allocate.alloc_sticky(t.units(), t.owners()).select(_OUT)


@query("alloc_unassigned", "owners units",
       f"SELECT queue, unit FROM ({_PRIORITY}) WHERE owner IS NULL")
def alloc_unassigned(t: Tables):
    units = t.units()
    return allocate.unassigned(units, allocate.alloc_priority(units, t.owners())).select("queue", "unit")
