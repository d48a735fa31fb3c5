"""Shared SQL for the panels, as common table expressions."""

GAP = """
gap AS (
  SELECT l_returnflag AS SKU_ID, l_linestatus AS Warehouse_ID,
         CAST(l_shipdate AS DATE) AS Date, CAST(sum(l_quantity) AS BIGINT) AS Units_Sold
  FROM lineitem GROUP BY 1, 2, 3)"""

EVENT = """
event AS (
  SELECT event_type AS SKU_ID, 'all' AS Warehouse_ID, CAST(ts AS DATE) AS Date,
         count(*) AS Units_Sold
  FROM events GROUP BY 1, 2, 3)"""

DEMAND = """
daily AS (
  SELECT p_type AS SKU_ID, r_name AS Warehouse_ID, CAST(l_shipdate AS DATE) AS Date,
         CAST(sum(l_quantity) AS BIGINT) AS u
  FROM lineitem JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-12-30'
  GROUP BY 1, 2, 3),
spine AS (
  SELECT SKU_ID, Warehouse_ID, CAST(d AS DATE) AS Date
  FROM (SELECT DISTINCT SKU_ID, Warehouse_ID FROM daily) AS pairs,
       generate_series(DATE '1997-01-01', DATE '1997-12-30', INTERVAL 1 DAY) AS g(d)),
demand AS (
  SELECT SKU_ID, Warehouse_ID, Date, COALESCE(u, 0) AS Units_Sold
  FROM spine LEFT JOIN daily USING (SKU_ID, Warehouse_ID, Date))"""

PANEL = (
    DEMAND
    + """,
sku_rank AS (
  SELECT p_type AS SKU_ID, dense_rank() OVER (ORDER BY p_type) AS sn
  FROM (SELECT DISTINCT p_type FROM part) AS t),
wh_rank AS (
  SELECT r_name AS Warehouse_ID, dense_rank() OVER (ORDER BY r_name) AS wn
  FROM (SELECT DISTINCT r_name FROM region) AS t),
keyed AS (
  SELECT d.*, sn, wn, date_diff('day', DATE '1970-01-01', d.Date) AS n
  FROM demand AS d JOIN sku_rank USING (SKU_ID) JOIN wh_rank USING (Warehouse_ID)),
panel AS (
  SELECT Date, SKU_ID, Warehouse_ID,
    'S' || CAST(1 + (sn * 3 + wn) % 10 AS VARCHAR) AS Supplier_ID,
    'R' || CAST(1 + wn % 4 AS VARCHAR) AS Region,
    Units_Sold,
    168 + (n * 37 + sn * 101 + wn * 53) % 823 AS Inventory_Level,
    2 + (n * 5 + sn * 3 + wn * 7) % 13 AS Supplier_Lead_Time_Days,
    201 + (n * 17 + sn * 29 + wn * 71) % 198 AS Reorder_Point,
    CASE WHEN (n + sn * 7 + wn * 3) % 18 = 0 THEN 1 + (n * 13 + sn) % 499 ELSE 0 END
      AS Order_Quantity,
    (502 + (n + sn * 97 + wn * 31) % 1475) / CAST(100.0 AS DOUBLE) AS Unit_Cost,
    (502 + (n + sn * 97 + wn * 31) % 1475) / CAST(100.0 AS DOUBLE) * CAST(1.5 AS DOUBLE)
      AS Unit_Price,
    CASE WHEN (n * 7 + sn * 3 + wn) % 10 = 0 THEN 1 ELSE 0 END AS Promotion_Flag,
    0 AS Stockout_Flag,
    CAST(greatest(0, Units_Sold + (n + sn + wn) % 5 - 2) AS DOUBLE) AS Demand_Forecast,
    n, sn, wn
  FROM keyed)"""
)

COLUMNS = (
    "Date, SKU_ID, Warehouse_ID, Supplier_ID, Region, Units_Sold, Inventory_Level, "
    "Supplier_Lead_Time_Days, Reorder_Point, Order_Quantity, Unit_Cost, Unit_Price, "
    "Promotion_Flag, Stockout_Flag, Demand_Forecast"
)

RAW = (
    PANEL
    + """,
placed AS (
  SELECT *, n * 31 + sn * 7 + wn AS k FROM panel WHERE (n * 31 + sn * 7 + wn) % 271 <> 0),
texts AS (
  SELECT k,
    CASE WHEN k % 211 = 0 THEN CAST(Date AS VARCHAR) || 'x' ELSE CAST(Date AS VARCHAR) END
      AS Date,
    CASE WHEN k % 223 = 0 THEN ' ' || SKU_ID WHEN k % 277 = 0 THEN SKU_ID || chr(9) ELSE SKU_ID END AS SKU_ID,
    CASE WHEN k % 227 = 0 THEN '  ' WHEN k % 281 = 0 THEN chr(9) ELSE Warehouse_ID END AS Warehouse_ID,
    CASE WHEN k % 229 <> 0 THEN Supplier_ID END AS Supplier_ID,
    Region,
    CASE WHEN k % 233 = 0 THEN 'abc' WHEN k % 239 = 0 THEN '-3' WHEN k % 241 = 0 THEN '2.5'
         WHEN k % 283 = 0 THEN '5d' WHEN k % 293 = 0 THEN '0x1p3'
         ELSE CAST(Units_Sold AS VARCHAR) END AS Units_Sold,
    CASE WHEN k % 251 = 0 THEN 'Infinity' ELSE CAST(Inventory_Level AS VARCHAR) END
      AS Inventory_Level,
    CAST(Supplier_Lead_Time_Days AS VARCHAR) AS Supplier_Lead_Time_Days,
    CAST(Reorder_Point AS VARCHAR) AS Reorder_Point,
    CAST(Order_Quantity AS VARCHAR) AS Order_Quantity,
    CAST(Unit_Cost AS VARCHAR) AS Unit_Cost,
    CAST(Unit_Price AS VARCHAR) AS Unit_Price,
    CASE WHEN k % 257 = 0 THEN '2' ELSE CAST(Promotion_Flag AS VARCHAR) END AS Promotion_Flag,
    CAST(Stockout_Flag AS VARCHAR) AS Stockout_Flag,
    CAST(Demand_Forecast AS VARCHAR) AS Demand_Forecast
  FROM placed),
raw AS (
  SELECT """
    + COLUMNS
    + """ FROM texts
  UNION ALL
  SELECT Date, SKU_ID, Warehouse_ID, Supplier_ID, Region, Units_Sold, Inventory_Level,
         Supplier_Lead_Time_Days, Reorder_Point,
         CASE WHEN k % 269 = 0 AND k % 263 <> 0 THEN '777' ELSE Order_Quantity END
           AS Order_Quantity,
         Unit_Cost, Unit_Price, Promotion_Flag, Stockout_Flag, Demand_Forecast
  FROM texts WHERE k % 263 = 0 OR k % 269 = 0)"""
)


def whole(sql: str) -> str:
    """The same tables over every day of the log instead of the panel year."""
    span = (
        "(SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d FROM (SELECT min(CAST(l_shipdate AS DATE)) AS lo, "
        "max(CAST(l_shipdate AS DATE)) AS hi FROM lineitem)) AS g(d)"
    )
    year = "DATE '1997-01-01' AND DATE '1997-12-30'"
    return sql.replace(f"  WHERE CAST(l_shipdate AS DATE) BETWEEN {year}\n", "").replace(
        "generate_series(DATE '1997-01-01', DATE '1997-12-30', INTERVAL 1 DAY) AS g(d)", span
    )


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(part.strip() for part in ctes)
