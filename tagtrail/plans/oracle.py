"""SQL for the model views, so that every oracle starts from the same raw tables.

``with_views("tags", "objects", sql=...)`` puts the named views, and the views they need, in
front of a statement.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _view(name: str, sql: str, *needs: str) -> None:
    VIEWS[name] = (needs, sql.strip())


def with_views(*names: str, sql: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in VIEWS[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH RECURSIVE {ctes},\n{body[5:].lstrip()}"
    return f"WITH RECURSIVE {ctes}\n{body}"


_view("tags", """
SELECT event_id AS id,
       CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 0 END AS tool_id,
       CAST(user_id AS VARCHAR) AS bundle_id,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS refers_to_object_id,
       epoch_us(ts) // 1000000 AS created
FROM events""")

_view("departments", """
SELECT DISTINCT p_brand AS id, 'Dept ' || p_brand AS name FROM part""")

_view("objects", """
SELECT p_partkey AS id, p_name AS title, CAST(1900 + p_size AS VARCHAR) AS date,
       p_brand AS department_id, p_type AS type, p_type AS type_id,
       CAST(p_size % 2 AS VARCHAR) AS is_loan_object
FROM part""")

_view("visits", """
SELECT l_partkey AS refers_to_object_id, l_orderkey * 10 + l_linenumber AS location_id,
       1704067200 + (date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) % 30) * 86400
         AS visit_raw,
       r_regionkey + 1 AS room_floor, n_nationkey AS room_id,
       CAST(100 + n_nationkey AS VARCHAR) AS room_name, s_suppkey AS spot_id,
       'Floor ' || CAST(r_regionkey + 1 AS VARCHAR) || ', ' || CAST(100 + n_nationkey AS VARCHAR)
         || ', Spot ' || CAST(s_suppkey AS VARCHAR) AS spot_name,
       s_name AS spot_description
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
     JOIN region ON r_regionkey = n_regionkey""")

_view("rooms", """
SELECT room_id AS id, room_name AS name, room_floor AS floor,
       count(DISTINCT refers_to_object_id) AS count_objects,
       count(DISTINCT spot_id) AS count_spots
FROM visits GROUP BY 1, 2, 3""", "visits")

_view("spots", """
SELECT spot_id AS id, spot_name AS name, spot_description AS description,
       count(DISTINCT refers_to_object_id) AS count_objects
FROM visits GROUP BY 1, 2, 3""", "visits")

_view("locations", """
SELECT v.*, r.count_objects AS room_count_objects, r.count_spots AS room_count_spots,
       s.count_objects AS spot_count_objects,
       CAST(make_timestamp(v.visit_raw * 1000000) AS DATE) AS visit_date
FROM visits v JOIN rooms r ON r.id = v.room_id JOIN spots s ON s.id = v.spot_id""",
      "rooms", "spots")

_view("exhibitions", """
SELECT substr(p_brand, 7) AS id,
       '2024-01-' || lpad(CAST(1 + CAST(substr(p_brand, 7) AS INT) % 20 AS VARCHAR), 2, '0')
         AS date_start,
       CASE WHEN p_brand = 'Brand#25' THEN '0000-00-00'
            ELSE '2024-01-' || lpad(CAST(11 + CAST(substr(p_brand, 7) AS INT) % 20 AS VARCHAR), 2,
                                    '0') END AS date_end,
       CAST(substr(p_brand, 7) AS INT) AS ordinal
FROM (SELECT DISTINCT p_brand FROM part)
UNION ALL
SELECT CAST(100 + length(p_type) AS VARCHAR), '2024-01-05', '2024-01-25',
       CAST(100 + length(p_type) AS INT)
FROM (SELECT DISTINCT p_type FROM part WHERE p_type IN ('PROMO', 'STANDARD'))""")

_view("members", """
SELECT substr(p_brand, 7) AS exhibition_id, p_partkey AS object_id FROM part
UNION ALL
SELECT CAST(100 + length(p_type) AS VARCHAR), p_partkey FROM part
WHERE p_type IN ('PROMO', 'STANDARD')""")

_view("clean", """
SELECT *, CAST(date_start AS DATE) AS starts, CAST(date_end AS DATE) AS ends
FROM exhibitions WHERE date_end <> '0000-00-00'""", "exhibitions")

_view("timed", """
SELECT t.*, make_timestamp(created * 1000000) AS utc,
       timezone('US/Eastern', timezone('UTC', make_timestamp(created * 1000000))) AS wall,
       make_timestamp((created - created % 3600) * 1000000) AS hour_utc,
       timezone('US/Eastern', timezone('UTC',
         make_timestamp((created - created % 3600) * 1000000))) AS hour_wall,
       CAST(timezone('US/Eastern', timezone('UTC', make_timestamp(created * 1000000))) AS DATE)
         AS local_day
FROM tags t""", "tags")

_view("calendar", """
SELECT t.*, CAST(month(wall) AS INT) AS month, CAST(year(wall) AS INT) AS year,
       CAST(day(wall) AS INT) AS day, CAST(isodow(wall) - 1 AS INT) AS dow,
       CAST(weekofyear(wall) AS INT) AS week,
       CASE WHEN isodow(wall) >= 6 THEN 1 ELSE 0 END AS weekend,
       CAST(hour(wall) AS INT) AS hour, CAST(quarter(wall) AS INT) AS quarter,
       CASE WHEN tool_id <> 0 THEN 1 ELSE 0 END AS visitor_drawn,
       CASE WHEN wall > CAST(local_day AS TIMESTAMP)
              + CASE WHEN isodow(wall) = 6 THEN INTERVAL 21 HOUR ELSE INTERVAL 18 HOUR END
            THEN 1 ELSE 0 END AS tagged_after_close
FROM timed t""", "timed")

_view("last_span", """
SELECT object_id, starts, ends
FROM members JOIN clean ON clean.id = exhibition_id
QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY clean.ordinal DESC) = 1""",
      "members", "clean")

_view("featured", """
SELECT c.*, CASE WHEN local_day >= starts AND local_day < ends THEN 1 ELSE 0 END
         AS during_exhibition
FROM calendar c LEFT JOIN last_span ON object_id = refers_to_object_id""",
      "calendar", "last_span")

_view("steps", """
SELECT bundle_id, local_day, created, arg_max(refers_to_object_id, id) AS object_id
FROM timed WHERE tool_id = 0 AND refers_to_object_id <> 0 AND bundle_id IS NOT NULL
GROUP BY ALL""", "timed")

_view("bucketed", """
SELECT bundle_id, local_day, created // 600 AS bucket, count(*) AS n
FROM steps GROUP BY ALL""", "steps")

# The dense form: every bucket from first to last, with explicit zeros.
_view("dense", """
SELECT g.bundle_id, g.local_day, g.bucket, coalesce(b.n, 0) AS n
FROM (SELECT bundle_id, local_day, unnest(generate_series(min(bucket), max(bucket))) AS bucket
      FROM bucketed GROUP BY 1, 2) g
LEFT JOIN bucketed b USING (bundle_id, local_day, bucket)""", "bucketed")

_view("rolled", """
SELECT *, n + lag(n) OVER (PARTITION BY bundle_id, local_day ORDER BY bucket) AS two
FROM dense""", "dense")

_view("bursts", """
SELECT bundle_id, local_day, CAST(sum(n) AS BIGINT) AS n_obs,
       CAST(sum(CASE WHEN 2 * n - two > 0
                      AND (2 * n - two) * (2 * n - two) * m * m > 9 * (m * s2 - s1 * s1)
                     THEN 1 ELSE 0 END) AS BIGINT) AS n_anomalies
FROM (SELECT *, count(two) OVER w AS m, sum(two) OVER w AS s1, sum(two * two) OVER w AS s2
      FROM rolled WINDOW w AS (PARTITION BY bundle_id, local_day))
GROUP BY 1, 2""", "rolled")

# The literal form: every (tag day, visit) pair ranked.
_view("nearest", """
SELECT * FROM (
  SELECT k.refers_to_object_id, k.utc_day, l.visit_raw,
         CAST(abs(date_diff('day', k.utc_day, l.visit_date)) AS INT) AS delta,
         l.room_floor, l.room_id, l.room_name, l.spot_id, l.spot_name, l.spot_description,
         l.room_count_objects, l.room_count_spots, l.spot_count_objects,
         row_number() OVER (PARTITION BY k.refers_to_object_id, k.utc_day
           ORDER BY abs(date_diff('day', k.utc_day, l.visit_date)), l.visit_raw, l.spot_id)
           AS place
  FROM (SELECT DISTINCT refers_to_object_id, CAST(utc AS DATE) AS utc_day FROM timed) k
  JOIN locations l ON l.refers_to_object_id = k.refers_to_object_id) WHERE place = 1""",
      "timed", "locations")

_view("located", """
SELECT f.*, n.visit_raw, n.delta, n.room_floor, n.room_id, n.room_name, n.spot_id, n.spot_name,
       n.spot_description, n.room_count_objects, n.room_count_spots, n.spot_count_objects,
       CASE WHEN n.place IS NULL THEN 0 ELSE 1 END AS meta_store
FROM featured f LEFT JOIN nearest n
  ON n.refers_to_object_id = f.refers_to_object_id AND n.utc_day = CAST(f.utc AS DATE)""",
      "featured", "nearest")

_view("bursty", """
SELECT l.*, coalesce(b.n_obs, -9999) AS n_obs, coalesce(b.n_anomalies, -9999) AS n_anomalies,
       CASE WHEN b.n_anomalies > 0 THEN 1 ELSE 0 END AS bursty
FROM featured l LEFT JOIN bursts b
  ON b.bundle_id = l.bundle_id AND b.local_day = l.local_day""", "featured", "bursts")

_view("modelled", """
SELECT l.* REPLACE (CAST(CASE WHEN missing THEN -9999 ELSE room_floor END AS INT) AS room_floor,
    CAST(CASE WHEN missing THEN -9999 ELSE room_id END AS INT) AS room_id,
    CAST(CASE WHEN missing THEN -9999 ELSE room_count_objects END AS INT) AS room_count_objects,
    CAST(CASE WHEN missing THEN -9999 ELSE spot_count_objects END AS INT) AS spot_count_objects),
  b.bursty, least(l.day // 7 + 1, 4) AS wom
FROM (SELECT *, meta_store = 0 AND room_floor IS NULL AS missing FROM located) l
JOIN bursty b ON b.id = l.id""", "located", "bursty")


def _bins(name: str, column: str, percents: list[float]) -> None:
    edges = ", ".join(f"quantile_cont(v, {p}) AS e{i}" for i, p in enumerate(percents, 1))
    _view(name, f"""
SELECT {edges} FROM (SELECT v FROM (SELECT DISTINCT {column} AS v FROM modelled)
                     QUALIFY row_number() OVER (ORDER BY v) > 1)""", "modelled")


_bins("room_edges", "room_count_objects", [0.7, 0.85, 0.9, 0.95])
_bins("spot_edges", "spot_count_objects", [0.5, 0.9, 0.95, 1.0])


def _binned(column: str, labels: list[str]) -> str:
    edges = ["-10000", "0", "e1", "e2", "e3", "e4"]
    cases = " ".join(f"WHEN {column} > {a} AND {column} <= {b} THEN '{label}'"
                     for a, b, label in zip(edges, edges[1:], labels))
    return f"CASE {cases} END"


_view("binned", f"""
SELECT m.*, {_binned("room_count_objects", ["room_nometa", "room_small_cap", "room_midsize_cap",
                                            "room_large_cap", "room_xlarge_cap"])} AS room_capacity,
       (SELECT {_binned("spot_count_objects", ["spot_nometa", "spot_constant_freq",
                                               "spot_normal_freq", "spot_high_freq",
                                               "spot_dynamic_freq"])} FROM spot_edges)
         AS spot_turnover,
       CASE WHEN hour > 0 AND hour <= 10 THEN 'pre-morning' WHEN hour > 10 AND hour <= 12
            THEN 'morning' WHEN hour > 12 AND hour <= 17 THEN 'afternoon'
            WHEN hour > 17 AND hour <= 20 THEN 'evening' WHEN hour > 20 AND hour <= 24
            THEN 'night' END AS hour_bin
FROM modelled m, room_edges""", "modelled", "room_edges", "spot_edges")

_view("loctypes", """
SELECT o.id, o.type, l.room_id, l.room_name, l.room_floor, l.spot_id, l.spot_name,
       l.spot_description AS description, l.visit_date
FROM (SELECT DISTINCT id, type FROM objects) o JOIN locations l ON l.refers_to_object_id = o.id""",
      "objects", "locations")

_view("starts", """
SELECT bundle_id, local_day, arg_min(object_id, created) AS object_id FROM steps GROUP BY 1, 2""",
      "steps")

# --- graph ---------------------------------------------------------------------------------------

_view("vertices", """
SELECT t.id, coalesce(o.title, '') AS title, coalesce(o.date, '') AS date,
       coalesce(d.name, '') AS department, coalesce(d.id, '') AS department_id,
       coalesce(o.type, '') AS type, coalesce(o.type_id, '') AS type_id,
       coalesce(o.is_loan_object, '') AS loan,
       CASE WHEN o.id IS NULL THEN 0 ELSE 1 END AS meta_store
FROM (SELECT DISTINCT refers_to_object_id AS id FROM tags
      WHERE refers_to_object_id IS NOT NULL) t
LEFT JOIN objects o ON o.id = t.id LEFT JOIN departments d ON d.id = o.department_id""",
      "tags", "objects", "departments")

_view("pairs", """
SELECT DISTINCT src, dst FROM (
  SELECT object_id AS src,
         lead(object_id) OVER (PARTITION BY bundle_id, local_day ORDER BY created) AS dst
  FROM steps) WHERE dst IS NOT NULL""", "steps")

_view("edges", """
SELECT src, dst FROM pairs
WHERE src IN (SELECT id FROM vertices WHERE meta_store = 1)
  AND dst IN (SELECT id FROM vertices WHERE meta_store = 1)""", "pairs", "vertices")

_view("baskets", """
SELECT l_orderkey * 10 + l_linenumber AS id, CAST(o_custkey AS VARCHAR) AS bundle_id,
       l_partkey AS refers_to_object_id,
       date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 86400
         + l_linenumber * 60 AS created
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")

_view("basket_vertices", """
SELECT t.id, coalesce(o.title, '') AS title, coalesce(o.date, '') AS date,
       coalesce(d.name, '') AS department, coalesce(d.id, '') AS department_id,
       coalesce(o.type, '') AS type, coalesce(o.type_id, '') AS type_id,
       coalesce(o.is_loan_object, '') AS loan,
       CASE WHEN o.id IS NULL THEN 0 ELSE 1 END AS meta_store
FROM (SELECT DISTINCT refers_to_object_id AS id FROM baskets) t
LEFT JOIN objects o ON o.id = t.id LEFT JOIN departments d ON d.id = o.department_id""",
      "baskets", "objects", "departments")

_view("basket_edges", """
SELECT DISTINCT src, dst FROM (
  SELECT object_id AS src,
         lead(object_id) OVER (PARTITION BY bundle_id, local_day ORDER BY created) AS dst
  FROM (SELECT bundle_id, created,
               max(struct_pack(i := id, o := refers_to_object_id)).o AS object_id,
               CAST(timezone('US/Eastern', timezone('UTC', make_timestamp(created * 1000000)))
                    AS DATE) AS local_day
        FROM baskets WHERE refers_to_object_id <> 0 GROUP BY ALL))
WHERE src IN (SELECT id FROM basket_vertices WHERE meta_store = 1)
  AND dst IN (SELECT id FROM basket_vertices WHERE meta_store = 1)""", "baskets",
      "basket_vertices")


def pagerank_views(vertices: str, edges: str, tol: float, name: str = "ranks") -> str:
    """CTE text of the PageRank of a graph, run until no rank moves by more than ``tol``."""
    return f"""
out_degree AS (SELECT src, count(*) AS d FROM {edges} GROUP BY 1),
rank_steps(step, id, pagerank, moved) AS (
  SELECT 0, id, CAST(1.0 AS DOUBLE), CAST(1e9 AS DOUBLE) FROM {vertices}
  UNION ALL
  SELECT s.step + 1, p.id, 0.15 + 0.85 * coalesce(g.got, 0),
         abs(0.15 + 0.85 * coalesce(g.got, 0) - p.pagerank)
  FROM rank_steps p
  JOIN (SELECT max(step) AS step, max(moved) AS moved FROM rank_steps) s ON s.moved > {tol}
  LEFT JOIN (SELECT e.dst, sum(r.pagerank / o.d) AS got
             FROM rank_steps r JOIN out_degree o ON o.src = r.id JOIN {edges} e ON e.src = r.id
             GROUP BY 1) g ON g.dst = p.id),
{name} AS (SELECT v.*, r.pagerank FROM rank_steps r JOIN {vertices} v ON v.id = r.id
           WHERE r.step = (SELECT max(step) FROM rank_steps))"""


def propagation_views(vertices: str, edges: str, rounds: int, name: str = "communities") -> str:
    """CTE text of label propagation with ties to the smallest label."""
    return f"""
either AS (SELECT src, dst FROM {edges} UNION ALL SELECT dst, src FROM {edges}),
label_steps(step, id, label) AS (
  SELECT 0, id, id FROM {vertices}
  UNION ALL
  SELECT s.step + 1, v.id, coalesce(c.label, v.id)
  FROM {vertices} v
  JOIN (SELECT max(step) AS step FROM label_steps) s ON s.step < {rounds}
  LEFT JOIN (SELECT dst, label FROM (
               SELECT e.dst, l.label, count(*) AS n
               FROM label_steps l JOIN either e ON e.src = l.id GROUP BY 1, 2)
             QUALIFY row_number() OVER (PARTITION BY dst ORDER BY n DESC, label) = 1) c
    ON c.dst = v.id),
{name} AS (SELECT v.*, l.label FROM label_steps l JOIN {vertices} v ON v.id = l.id
           WHERE l.step = {rounds})"""
