"""Registered queries of the versioned-table operators, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import spatial, temporal, text
from palimpsest.functions.identity import hash_bucket
from palimpsest.operators import aggregate, diff, history, index, merge, snapshot
from palimpsest.plans import ql
from palimpsest.plans.fixtures import ATTRS, COMMITS, KEY, POINTS, SNAPSHOTS, VERSIONS, base, commits, ours, points, table, theirs, versions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BOX = (-0.1, -0.1, 0.1, 0.1)
WORLD = (-0.5, -0.5, 0.5, 0.5)


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return add


def _pair(s, d):
    return base(s, d), ours(s, d)


# --- differences -----------------------------------------------------------------------------------------------------

_DIFF = f"""WITH {SNAPSHOTS},
d AS (SELECT coalesce(b.fid, o.fid) AS fid, CASE WHEN b.fid IS NULL THEN 'ADDED' WHEN o.fid IS NULL THEN 'REMOVED' ELSE 'MODIFIED' END AS change_type,
  {', '.join(f'b.{a} AS old_{a}, o.{a} AS new_{a}' for a in ATTRS)}, b.fid IS NOT NULL AS was, o.fid IS NOT NULL AS is_now
  FROM base b FULL OUTER JOIN ours o ON b.fid = o.fid WHERE b.fid IS NULL OR o.fid IS NULL OR {' OR '.join(f'b.{a} IS DISTINCT FROM o.{a}' for a in ATTRS)})
"""
_DIFF_COLS = "fid, change_type, " + ", ".join(f"old_{a}, new_{a}" for a in ATTRS)


@register("diff_entries", _DIFF + f"SELECT {_DIFF_COLS} FROM d")
def _(s, d):
    return diff.diff(*_pair(s, d), KEY)


@register("diff_count", _DIFF + "SELECT count(*) FILTER (NOT was) AS features_added, count(*) FILTER (was AND is_now) AS features_changed, count(*) FILTER (NOT is_now) AS features_removed FROM d")
def _(s, d):
    return diff.diff_count(*_pair(s, d), KEY)


@register("diff_pruned_by_digest", f"WITH {SNAPSHOTS}, n AS (SELECT fid, o_custkey, o_orderstatus, o_orderpriority, CASE WHEN fid < 64 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM base) SELECT n.fid, 'MODIFIED' AS change_type, b.o_totalprice AS old_o_totalprice, n.o_totalprice AS new_o_totalprice FROM base b JOIN n USING (fid) WHERE b.o_totalprice IS DISTINCT FROM n.o_totalprice")
def _(s, d):
    new = base(s, d).withColumn("o_totalprice", F.when(F.col(KEY) < 64, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return diff.pruned_diff(base(s, d), new, KEY, 256).select(KEY, "change_type", "old_o_totalprice", "new_o_totalprice")


@register("diff_nested", _DIFF + "SELECT fid, change_type, CASE WHEN was THEN old_o_totalprice END AS old_price, CASE WHEN is_now THEN new_o_totalprice END AS new_price FROM d")
def _(s, d):
    return diff.nested(diff.diff(*_pair(s, d), KEY), KEY).select(KEY, "change_type", F.col("old.o_totalprice").alias("old_price"), F.col("new.o_totalprice").alias("new_price"))


for _which, _where, _side in (("ADDED", "change_type = 'ADDED'", "new"), ("REMOVED", "change_type = 'REMOVED'", "old"), ("CHANGED_NEW", "change_type = 'MODIFIED'", "new"), ("CHANGED_OLD", "change_type = 'MODIFIED'", "old")):
    _sql = f"WITH {SNAPSHOTS}, d AS (SELECT coalesce(b.fid, o.fid) AS fid, CASE WHEN b.fid IS NULL THEN 'ADDED' WHEN o.fid IS NULL THEN 'REMOVED' ELSE 'MODIFIED' END AS change_type, {', '.join(f'b.{a} AS old_{a}, o.{a} AS new_{a}' for a in ATTRS)} FROM base b FULL OUTER JOIN theirs o ON b.fid = o.fid WHERE b.fid IS NULL OR o.fid IS NULL OR {' OR '.join(f'b.{a} IS DISTINCT FROM o.{a}' for a in ATTRS)}) SELECT fid, {', '.join(f'{_side}_{a} AS {a}' for a in ATTRS)} FROM d WHERE {_where}"
    register(f"diff_source_{_which.lower()}", _sql)(lambda s, d, w=_which: diff.one_side(diff.diff(base(s, d), theirs(s, d), KEY), KEY, w))


@register("diff_changed_only", _DIFF + f"SELECT {_DIFF_COLS} FROM d WHERE change_type = 'MODIFIED'")
def _(s, d):
    return diff.one_side(diff.diff(*_pair(s, d), KEY), KEY, "CHANGED")


@register("diff_columns", f"WITH {SNAPSHOTS} SELECT coalesce(b.fid, o.fid) AS fid, CASE WHEN b.fid IS NULL THEN 'ADDED' WHEN o.fid IS NULL THEN 'REMOVED' ELSE 'MODIFIED' END AS change_type, b.o_orderstatus AS old_o_orderstatus, o.o_orderstatus AS new_o_orderstatus FROM base b FULL OUTER JOIN ours o ON b.fid = o.fid WHERE b.fid IS NULL OR o.fid IS NULL OR b.o_orderstatus IS DISTINCT FROM o.o_orderstatus")
def _(s, d):
    return diff.diff(*_pair(s, d), KEY, ["o_orderstatus"])


@register("diff_path_filter", _DIFF.replace("coalesce(b.fid, o.fid) AS fid", "'orders/' || coalesce(b.o_orderstatus, o.o_orderstatus) || '/' || coalesce(b.fid, o.fid) AS path, coalesce(b.fid, o.fid) AS fid") + "SELECT path, change_type FROM d WHERE path LIKE 'orders/F/%' OR path LIKE 'orders/P/%'")
def _(s, d):
    e = diff.diff(*_pair(s, d), KEY)
    e = e.withColumn("path", F.concat_ws("/", F.lit("orders"), F.coalesce("old_o_orderstatus", "new_o_orderstatus"), F.col(KEY).cast("string")))
    return diff.under_paths(e, "path", ["orders/F", "orders/P"]).select("path", "change_type")


@register("diff_limit", _DIFF + "SELECT fid, change_type FROM d ORDER BY fid LIMIT 25")
def _(s, d):
    return diff.diff(*_pair(s, d), KEY).orderBy(KEY).limit(25).select(KEY, "change_type")


_PDIFF = f"WITH {POINTS}, d AS (SELECT coalesce(a.fid, b.fid) AS fid, a.x AS ox, a.y AS oy, b.x AS nx, b.y AS ny FROM p0 a FULL OUTER JOIN p1 b ON a.fid = b.fid WHERE a.fid IS NULL OR b.fid IS NULL OR a.x IS DISTINCT FROM b.x OR a.y IS DISTINCT FROM b.y) "


@register("diff_bounds", _PDIFF + "SELECT min(ox) AS old_min_x, min(oy) AS old_min_y, max(ox) AS old_max_x, max(oy) AS old_max_y, min(nx) AS new_min_x, min(ny) AS new_min_y, max(nx) AS new_max_x, max(ny) AS new_max_y, least(min(ox), min(nx)) AS merged_min_x, least(min(oy), min(ny)) AS merged_min_y, greatest(max(ox), max(nx)) AS merged_max_x, greatest(max(oy), max(ny)) AS merged_max_y FROM d")
def _(s, d):
    return diff.diff_bounds(points(s, d), points(s, d, True), KEY, "x", "y")


@register("diff_bounds_filter", _PDIFF + f"SELECT fid FROM d WHERE (ox BETWEEN {BOX[0]} AND {BOX[2]} AND oy BETWEEN {BOX[1]} AND {BOX[3]}) OR (nx BETWEEN {BOX[0]} AND {BOX[2]} AND ny BETWEEN {BOX[1]} AND {BOX[3]})")
def _(s, d):
    e = diff.diff(points(s, d).select(KEY, "x", "y"), points(s, d, True).select(KEY, "x", "y"), KEY)
    return diff.touching(e, "x", "y", BOX).select(KEY)


def _lines(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("layer"), F.col("l_orderkey").cast("long").alias(KEY)).agg(F.count(F.lit(1)).alias("items"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


def _lines_new(s, d):
    return _lines(s, d).where(F.col(KEY) % 17 != 0).withColumn("quantity", F.when((F.col(KEY) % 19 == 0) & (F.col("layer") != "N"), F.col("quantity") + 1).otherwise(F.col("quantity")))


_LINES = "a AS (SELECT l_returnflag AS layer, CAST(l_orderkey AS BIGINT) AS fid, count(*) AS items, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY 1, 2), b AS (SELECT layer, fid, items, CASE WHEN fid % 19 = 0 AND layer <> 'N' THEN quantity + 1 ELSE quantity END AS quantity FROM a WHERE fid % 17 <> 0)"


@register("diff_summary", f"WITH {_LINES} SELECT coalesce(a.layer, b.layer) AS layer, count(*) FILTER (a.fid IS NULL) AS added, count(*) FILTER (a.fid IS NOT NULL AND b.fid IS NOT NULL AND (a.items IS DISTINCT FROM b.items OR a.quantity IS DISTINCT FROM b.quantity)) AS changed, count(*) FILTER (b.fid IS NULL) AS removed, count(a.fid) AS left_rows, count(b.fid) AS right_rows FROM a FULL OUTER JOIN b ON a.layer = b.layer AND a.fid = b.fid GROUP BY 1")
def _(s, d):
    return diff.diff_summary(_lines(s, d), _lines_new(s, d), "layer", KEY)


@register("changed_layers", "SELECT DISTINCT l_returnflag AS layer, 'MODIFIED' AS kind FROM lineitem")
def _(s, d):
    return diff.changed_layers(_lines(s, d), _lines_new(s, d), "layer", KEY)


_ATTR = " UNION ALL ".join(f"SELECT fid, '{a}' AS attribute, CASE WHEN old_{a} IS NULL THEN 'ADDED' WHEN new_{a} IS NULL THEN 'REMOVED' ELSE 'MODIFIED' END AS kind FROM d WHERE old_{a} IS DISTINCT FROM new_{a}" for a in ATTRS)


@register("diff_attributes", _DIFF + _ATTR)
def _(s, d):
    return diff.attribute_diff(diff.diff(*_pair(s, d), KEY), KEY).select(KEY, "attribute", "kind")


@register("diff_schema", "SELECT * FROM (VALUES ('o_orderpriority', 'REMOVED', 'string', CAST(NULL AS VARCHAR)), ('extra', 'ADDED', NULL, 'int'), ('o_custkey', 'MODIFIED', 'bigint', 'string')) t(attribute, kind, old_type, new_type)")
def _(s, d):
    left = base(s, d).withColumn("o_custkey", F.col("o_custkey").cast("long"))
    return diff.schema_diff(left, left.drop("o_orderpriority").withColumn("extra", F.lit(1)).withColumn("o_custkey", F.col("o_custkey").cast("string")))


# --- merges ----------------------------------------------------------------------------------------------------------

_EQ = lambda a, b: " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in ATTRS)
_MERGED = ", ".join(f"CASE WHEN t.fid IS NULL AND b.fid IS NULL THEN o.{c} WHEN o.{c} IS NOT DISTINCT FROM b.{c} THEN t.{c} ELSE o.{c} END AS {c}" for c in ATTRS)
_MERGE = f"""WITH {SNAPSHOTS}, k AS (SELECT fid FROM base UNION SELECT fid FROM ours UNION SELECT fid FROM theirs),
j AS (SELECT k.fid,
  CASE WHEN b.fid IS NULL AND o.fid IS NULL THEN NULL WHEN b.fid IS NULL THEN 'ADDED' WHEN o.fid IS NULL THEN 'REMOVED' WHEN NOT ({_EQ('b', 'o')}) THEN 'MODIFIED' END AS ours,
  CASE WHEN b.fid IS NULL AND t.fid IS NULL THEN NULL WHEN b.fid IS NULL THEN 'ADDED' WHEN t.fid IS NULL THEN 'REMOVED' WHEN NOT ({_EQ('b', 't')}) THEN 'MODIFIED' END AS theirs,
  ({_EQ('o', 't')}) AS same, ({' OR '.join(f'(o.{c} IS DISTINCT FROM b.{c} AND t.{c} IS DISTINCT FROM b.{c} AND o.{c} IS DISTINCT FROM t.{c})' for c in ATTRS)}) AS clash,
  ({' AND '.join(f'(CASE WHEN o.{c} IS NOT DISTINCT FROM b.{c} THEN t.{c} ELSE o.{c} END) IS NOT DISTINCT FROM t.{c}' for c in ATTRS)}) AS like_theirs,
  CASE WHEN o.o_totalprice IS NOT DISTINCT FROM b.o_totalprice THEN t.o_totalprice ELSE o.o_totalprice END AS price, CASE WHEN o.o_orderpriority IS NOT DISTINCT FROM b.o_orderpriority THEN t.o_orderpriority ELSE o.o_orderpriority END AS priority
  FROM k LEFT JOIN base b ON k.fid = b.fid LEFT JOIN ours o ON k.fid = o.fid LEFT JOIN theirs t ON k.fid = t.fid),
r AS (SELECT fid, ours, theirs, price, priority, CASE WHEN theirs IS NULL THEN 'KEEP_OURS' WHEN ours IS NULL THEN 'UNCONFLICTED' WHEN ours = 'REMOVED' AND theirs = 'REMOVED' THEN 'NOTHING'
  WHEN ours = 'ADDED' AND theirs = 'ADDED' THEN CASE WHEN same THEN 'NOTHING' ELSE 'CONFLICT' END
  WHEN ours = 'MODIFIED' AND theirs = 'MODIFIED' THEN CASE WHEN same THEN 'NOTHING' WHEN clash THEN 'CONFLICT' WHEN like_theirs THEN 'UNCONFLICTED' ELSE 'MERGED' END ELSE 'CONFLICT' END AS outcome
  FROM j WHERE ours IS NOT NULL OR theirs IS NOT NULL)
"""


def _three(s, d):
    return base(s, d), ours(s, d), theirs(s, d)


@register("merge_report", _MERGE + "SELECT fid, ours, theirs, outcome FROM r")
def _(s, d):
    return merge.merge_report(*_three(s, d), KEY).select(KEY, "ours", "theirs", "outcome")


@register("merge_counts", _MERGE + "SELECT outcome, count(*) AS n FROM r GROUP BY outcome")
def _(s, d):
    return merge.merge_counts(merge.merge_report(*_three(s, d), KEY))


@register("merge_attributes", _MERGE + "SELECT fid, price AS o_totalprice, priority AS o_orderpriority FROM r WHERE outcome = 'MERGED'")
def _(s, d):
    return merge.merge_report(*_three(s, d), KEY).where("outcome = 'MERGED'").select(KEY, "o_totalprice", "o_orderpriority")


@register("merge_conflicts", _MERGE + "SELECT fid FROM r WHERE outcome = 'CONFLICT'")
def _(s, d):
    return merge.conflicts(*_three(s, d), KEY).select(KEY)


@register("merge_conflict_check", _MERGE + "SELECT count(*) > 0 AS conflicted FROM r WHERE outcome = 'CONFLICT'")
def _(s, d):
    return merge.merge_report(*_three(s, d), KEY).agg(F.coalesce(F.max(F.col("outcome") == "CONFLICT"), F.lit(False)).alias("conflicted"))


@register("merge_snapshot", _MERGE + "SELECT o.fid, o.o_totalprice, o.o_orderpriority FROM ours o LEFT JOIN r ON o.fid = r.fid AND r.outcome IN ('UNCONFLICTED', 'MERGED') WHERE r.fid IS NULL UNION ALL SELECT t.fid, CASE WHEN r.outcome = 'MERGED' THEN r.price ELSE t.o_totalprice END, CASE WHEN r.outcome = 'MERGED' THEN r.priority ELSE t.o_orderpriority END FROM r JOIN theirs t ON r.fid = t.fid WHERE r.outcome IN ('UNCONFLICTED', 'MERGED')")
def _(s, d):
    return merge.merge(*_three(s, d), KEY).select(KEY, "o_totalprice", "o_orderpriority")


#: Cherry-picking theirs (a child of base) onto ours, and reverting it there.
@register("cherry_pick_report", _MERGE + "SELECT fid, theirs AS change_type, CASE WHEN theirs = 'ADDED' THEN 'UNCONFLICTED' WHEN theirs = 'REMOVED' THEN CASE WHEN ours = 'REMOVED' THEN 'NOTHING' WHEN ours IS NULL THEN 'UNCONFLICTED' ELSE 'CONFLICT' END WHEN ours = 'REMOVED' THEN 'UNCONFLICTED' WHEN ours = 'MODIFIED' AND outcome = 'UNCONFLICTED' THEN 'MERGED' ELSE outcome END AS outcome FROM r WHERE theirs IS NOT NULL")
def _(s, d):
    return merge.commit_conflicts(base(s, d), theirs(s, d), ours(s, d), KEY).select(KEY, "change_type", "outcome")


@register("revert_clean", f"WITH {SNAPSHOTS} SELECT * FROM base")
def _(s, d):
    parent, commit = merge.apart(KEY, base(s, d), theirs(s, d))
    return merge.together(merge.revert(parent, commit, commit, KEY), KEY)


@register("patch_round_trip", f"WITH {SNAPSHOTS} SELECT * FROM theirs")
def _(s, d):
    old, new = merge.apart(KEY, base(s, d), theirs(s, d))
    p = diff.diff(old, new, KEY)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base(s, d).schema.fields if f.name != KEY)
    again = merge.parse_patch(merge.patch_lines(p, KEY), KEY, old.schema[KEY].dataType.simpleString(), schema)
    return merge.together(merge.apply_patch(again, old, KEY, partial=True), KEY)


@register("patch_reversed", f"WITH {SNAPSHOTS} SELECT * FROM base")
def _(s, d):
    old, new = merge.apart(KEY, base(s, d), theirs(s, d))
    return merge.together(merge.apply_patch(merge.reversed_patch(diff.diff(old, new, KEY), KEY), new, KEY, partial=True), KEY)


@register("patch_verify", _MERGE + "SELECT applies, count(*) AS n FROM (SELECT CASE WHEN theirs = 'ADDED' THEN true WHEN theirs = 'REMOVED' THEN ours IS NULL WHEN ours = 'REMOVED' THEN false ELSE ours IS NULL OR (SELECT t.o_totalprice IS NOT DISTINCT FROM b.o_totalprice OR b.o_totalprice IS NOT DISTINCT FROM o.o_totalprice FROM base b, ours o, theirs t WHERE b.fid = r.fid AND o.fid = r.fid AND t.fid = r.fid) END AS applies FROM r WHERE theirs IS NOT NULL) GROUP BY applies")
def _(s, d):
    return merge.verify_patch(diff.diff(base(s, d), theirs(s, d), KEY), ours(s, d), KEY).groupBy("applies").agg(F.count(F.lit(1)).alias("n"))


@register("upsert", f"WITH {SNAPSHOTS} SELECT * FROM base WHERE fid % 5 <> 0 UNION ALL SELECT fid, o_custkey, 'U', o_totalprice, o_orderpriority FROM base WHERE fid % 5 = 0")
def _(s, d):
    return merge.upsert(base(s, d), base(s, d).where(F.col(KEY) % 5 == 0).withColumn("o_orderstatus", F.lit("U")), KEY)


@register("audit_latest_change", f"WITH {VERSIONS} SELECT fid, arg_max(commit, ts) AS commit, arg_max(event_type, ts) AS event_type FROM v GROUP BY fid")
def _(s, d):
    return merge.latest_changes(versions(s, d), KEY, "ts").select(KEY, "commit", "event_type")


# --- scans, filters, predicates --------------------------------------------------------------------------------------

_BASE = f"WITH {SNAPSHOTS} "


@register("scan_projection", _BASE + "SELECT o_orderpriority, fid FROM base")
def _(s, d):
    return snapshot.scan(base(s, d), columns=["o_orderpriority", KEY])


@register("scan_offset_limit", _BASE + "SELECT fid, o_totalprice FROM base ORDER BY fid LIMIT 20 OFFSET 100")
def _(s, d):
    return snapshot.scan(base(s, d), columns=[KEY, "o_totalprice"], key=KEY, offset=100, limit=20)


#: name: (query-language condition, SQL condition)
_FILTERS = {
    "filter_equals": ("o_orderstatus = 'F'", None), "filter_not_equals": ("o_orderstatus <> 'F'", None), "filter_less": ("o_totalprice < 50000", None), "filter_less_equal": ("o_custkey <= 100", None),
    "filter_greater": ("o_totalprice > 400000.5", None), "filter_greater_equal": ("o_custkey >= 700", None), "filter_between": ("o_totalprice BETWEEN 1000 AND 90000", None), "filter_not_between": ("o_totalprice NOT BETWEEN 1000 AND 450000", None),
    "filter_like": ("o_orderpriority LIKE '%HIGH'", None), "filter_not_like": ("o_orderpriority NOT LIKE '%LOW%'", None), "filter_in": ("o_orderstatus IN ('F', 'P')", None), "filter_not_in": ("o_custkey NOT IN (1, 2, 3, 4)", None),
    "filter_null": ("o_orderpriority IS NULL", None), "filter_not_null": ("o_orderpriority IS NOT NULL", None), "filter_nil": ("o_orderstatus IS NIL", "o_orderstatus IS NULL"), "filter_and": ("o_orderstatus = 'F' AND o_custkey < 300", None),
    "filter_or": ("o_orderstatus = 'F' OR o_custkey < 30", None), "filter_or_to_in": ("o_custkey = 5 OR o_custkey = 7 OR o_custkey = 9", None), "filter_not": ("NOT (o_orderstatus = 'F' AND o_custkey < 300)", None), "filter_include": ("INCLUDE", "true"), "filter_exclude": ("EXCLUDE", "false"),
    "filter_id": ("@id = 17", "fid = 17"), "filter_id_in": ("@id IN (3, 5, 900)", "fid IN (3, 5, 900)"), "filter_id_range": ("@id >= 14990", "fid >= 14990"), "filter_add": ("o_custkey + 10 > 800", None), "filter_subtract": ("o_custkey - 10 < 20", None),
    "filter_multiply": ("o_custkey * 2 = 300", None), "filter_divide": ("o_totalprice / 2 > 240000", None), "filter_modulo": ("o_custkey % 7 = 3", None), "filter_sign": ("o_custkey - 20 > -15 AND o_custkey < +40", "o_custkey - 20 > -15 AND o_custkey < 40"),
    "filter_function": ("strLength(o_orderpriority) > 6 AND abs(o_custkey - 50) < 10", "length(o_orderpriority) > 6 AND abs(o_custkey - 50) < 10"), "filter_is_true": ("(o_custkey > 500) IS TRUE", None), "filter_is_false": ("(o_custkey > 500) IS FALSE", None), "filter_parentheses": ("((o_custkey > 5)) AND (o_custkey < 9 OR o_orderstatus = 'P')", None),
}
for _name, (_condition, _plain) in _FILTERS.items():
    register(_name, _BASE + f"SELECT fid, o_totalprice FROM base WHERE {_plain or _condition}")(lambda s, d, c=_condition: ql.select(ql.parse(f"SELECT @id, o_totalprice FROM orders WHERE {c}"), base(s, d), KEY))

_RANGES = "e AS (SELECT CAST(event_id AS BIGINT) AS commit, ts AS a, ts + to_hours(CAST(event_id % 5 AS BIGINT)) AS b, date_trunc('hour', ts) AS c, date_trunc('hour', ts) + to_hours(CAST(event_id % 3 AS BIGINT)) AS e FROM events)"
_RELATION_SQL = {
    "AFTER": "a > e", "ANYINTERACTS": "a <= e AND b >= c", "BEFORE": "b < c", "BEGINS": "a = c AND b < e", "BEGUNBY": "a = c AND b > e", "DURING": "a > c AND b < e", "ENDEDBY": "b = e AND a < c", "ENDS": "b = e AND a > c",
    "MEETS": "b = c", "METBY": "a = e", "OVERLAPPEDBY": "a > c AND a < e AND b > e", "TCONTAINS": "a < c AND b > e", "TEQUALS": "a = c AND b = e", "TOVERLAPS": "a < c AND b > c AND b < e",
}


def _intervals(s, d):
    n = F.col("event_id")
    hours = lambda k: F.make_interval(hours=(n % k).cast("int"))
    hour = F.date_trunc("hour", F.col("ts"))
    return table(s, d, "events").select(n.cast("long").alias("commit"), F.col("ts").alias("a"), (F.col("ts") + hours(5)).alias("b"), hour.alias("c"), (hour + hours(3)).alias("e"))


for _name, _sql in _RELATION_SQL.items():
    register(f"temporal_{_name.lower()}", f"WITH {_RANGES} SELECT commit FROM e WHERE {_sql}")(lambda s, d, r=_name: _intervals(s, d).where(temporal.relation(r, (F.col("a"), F.col("b")), (F.col("c"), F.col("e")))).select("commit"))


#: Intervals of whole hours, so that every relation holds for some rows and not for others.
_HOURS = """h AS (SELECT CAST(event_id AS BIGINT) AS commit, CAST(event_id AS BIGINT) % 6 AS a, CAST(event_id AS BIGINT) % 6 + 1 + CAST(event_id AS BIGINT) // 6 % 4 AS b,
  CAST(event_id AS BIGINT) // 24 % 6 AS c, CAST(event_id AS BIGINT) // 24 % 6 + 1 + CAST(event_id AS BIGINT) // 144 % 4 AS e FROM events)"""


def _hours(s, d):
    n = F.col("event_id").cast("long")
    a, c = n % 6, F.floor(n / 24) % 6
    at = lambda hour: F.timestamp_seconds(hour * 3600)
    return table(s, d, "events").select(n.alias("commit"), at(a).alias("a"), at(a + 1 + F.floor(n / 6) % 4).alias("b"), at(c).alias("c"), at(c + 1 + F.floor(n / 144) % 4).alias("e"))


for _name, _sql in _RELATION_SQL.items():
    register(f"temporal_hours_{_name.lower()}", f"WITH {_HOURS} SELECT commit FROM h WHERE {_sql}")(lambda s, d, r=_name: _hours(s, d).where(temporal.relation(r, (F.col("a"), F.col("b")), (F.col("c"), F.col("e")))).select("commit"))


def _some_null(s, d):
    """Every ninth order without a status, every seventh without a priority."""
    return base(s, d).withColumn("o_orderstatus", F.when(F.col(KEY) % 9 != 0, F.col("o_orderstatus"))).withColumn("o_orderpriority", F.when(F.col(KEY) % 7 != 0, F.col("o_orderpriority")))


for _name, _condition, _sql in (("null", "o_orderpriority IS NULL", "fid % 7 = 0"), ("not_null", "o_orderpriority IS NOT NULL", "fid % 7 <> 0"), ("nil", "o_orderstatus IS NIL", "fid % 9 = 0"), ("unknown", "NOT (o_orderstatus = 'F')", "fid % 9 <> 0 AND o_orderstatus <> 'F'")):
    register(f"filter_some_{_name}", _BASE + f"SELECT fid, o_totalprice FROM base WHERE {_sql}")(lambda s, d, c=_condition: ql.select(ql.parse(f"SELECT @id, o_totalprice FROM orders WHERE {c}"), _some_null(s, d), KEY))


@register("value_text_round_trip", _BASE + "SELECT fid, CAST(o_custkey AS BIGINT) AS o_custkey, o_totalprice FROM base")
def _(s, d):
    df = base(s, d)
    kinds = {c: df.schema[c].dataType for c in ("o_custkey", "o_totalprice")}
    texts = df.select(KEY, *[text.to_text(F.col(c), k).alias(c) for c, k in kinds.items()])
    return texts.select(KEY, text.from_text(F.col("o_custkey"), kinds["o_custkey"]).cast("long").alias("o_custkey"), text.from_text(F.col("o_totalprice"), kinds["o_totalprice"]).alias("o_totalprice"))


@register("array_text_round_trip", "SELECT CAST(vec_id AS BIGINT) AS fid, CAST(len(embedding) AS BIGINT) AS n FROM embeddings")
def _(s, d):
    df = table(s, d, "embeddings")
    again = text.text_to_array(text.array_to_text(F.col("embedding")), df.schema["embedding"].dataType.elementType)
    return df.where(again == F.col("embedding")).select(F.col("vec_id").cast("long").alias(KEY), F.size("embedding").cast("long").alias("n"))


@register("map_text_round_trip", "SELECT CAST(event_id AS BIGINT) AS fid, json_extract_string(props, '$.k') AS k FROM events")
def _(s, d):
    m = text.text_to_map(text.map_to_text(text.text_to_map(F.col("props"))))
    return table(s, d, "events").select(F.col("event_id").cast("long").alias(KEY), m["k"].alias("k"))


# --- spatial ---------------------------------------------------------------------------------------------------------


def _shapes(s, d):
    return points(s, d).withColumn("geom", spatial.point_wkb("x", "y")).withColumns({"minx": F.col("x"), "maxx": F.col("x"), "miny": F.col("y"), "maxy": F.col("y")})


_SQUARE = spatial.envelope_polygon(*BOX)
_IN = f"x > {BOX[0]} AND x < {BOX[2]} AND y > {BOX[1]} AND y < {BOX[3]}"
_IN_CLOSED = f"x BETWEEN {BOX[0]} AND {BOX[2]} AND y BETWEEN {BOX[1]} AND {BOX[3]}"
_TRIANGLE = "POLYGON ((-0.2 -0.2, 0.2 -0.2, 0 0.2, -0.2 -0.2))"
_IN_TRIANGLE = "y >= -0.2 AND y - 2 * x <= 0.2 AND y + 2 * x <= 0.2"
_SPATIAL = {
    "spatial_bbox": (f"BBOX(geom, {', '.join(map(str, BOX))})", _IN_CLOSED), "spatial_intersects": (f"INTERSECTS(geom, {_TRIANGLE})", _IN_TRIANGLE), "spatial_disjoint": (f"DISJOINT(geom, {_TRIANGLE})", f"NOT ({_IN_TRIANGLE})"), "spatial_within": (f"WITHIN(geom, {_SQUARE})", _IN),
    "spatial_contains": (f"CONTAINS(geom, {_SQUARE})", "false"), "spatial_crosses": (f"CROSSES(geom, {_TRIANGLE})", "false"), "spatial_overlaps": (f"OVERLAPS(geom, {_SQUARE})", "false"), "spatial_touches": (f"TOUCHES(geom, {_SQUARE})", f"({_IN_CLOSED}) AND NOT ({_IN})"),
    "spatial_dwithin": ("DWITHIN(geom, POINT (0.05 0.05), 0.1, degrees)", "sqrt((x - 0.05) * (x - 0.05) + (y - 0.05) * (y - 0.05)) <= 0.1"), "spatial_beyond": ("BEYOND(geom, POINT (0.05 0.05), 0.1, degrees)", "sqrt((x - 0.05) * (x - 0.05) + (y - 0.05) * (y - 0.05)) > 0.1"),
    "spatial_not_disjoint_prune": (f"NOT INTERSECTS(geom, {_SQUARE}) AND label < 5", f"NOT ({_IN_CLOSED}) AND label < 5"),
}
for _name, (_condition, _sql) in _SPATIAL.items():
    register(_name, f"WITH {POINTS} SELECT fid FROM p0 WHERE {_sql}")(lambda s, d, c=_condition: ql.select(ql.parse(f"SELECT @id FROM points WHERE {c}"), _shapes(s, d), KEY).select(KEY))


@register("spatial_equals", f"WITH {POINTS} SELECT a.fid FROM p0 a WHERE a.x = 0.5 AND a.y = 0.5")
def _(s, d):
    return _shapes(s, d).where(spatial.spatial("EQUALS", "geom", "POINT (0.5 0.5)")).select(KEY)


#: Boxes on a grid, one for each vector, and horizontal lines along their lower sides; each relation to the square from
#: (2, 2) to (5, 5) holds for some of them.
_GRID = """g AS (SELECT CAST(vec_id AS BIGINT) AS fid, CAST(vec_id AS BIGINT) % 8 AS x0, CAST(vec_id AS BIGINT) // 8 % 8 AS y0, CAST(vec_id AS BIGINT) % 8 + 1 + CAST(vec_id AS BIGINT) // 64 % 6 AS x1,
  CAST(vec_id AS BIGINT) // 8 % 8 + 1 + (CAST(vec_id AS BIGINT) // 64 + CAST(vec_id AS BIGINT) // 384) % 6 AS y1 FROM embeddings)"""
_GRID_SQUARE = spatial.envelope_polygon(2, 2, 5, 5)
_MEET, _INSIDE = "(x0 <= 5 AND x1 >= 2 AND y0 <= 5 AND y1 >= 2)", "(x0 < 5 AND x1 > 2 AND y0 < 5 AND y1 > 2)"
_COVERS, _COVERED = "(x0 <= 2 AND x1 >= 5 AND y0 <= 2 AND y1 >= 5)", "(x0 >= 2 AND x1 <= 5 AND y0 >= 2 AND y1 <= 5)"
_ON_GRID = {
    "intersects": _MEET, "disjoint": f"NOT {_MEET}", "contains": _COVERS, "within": _COVERED, "equals": f"{_COVERS} AND {_COVERED}", "touches": f"{_MEET} AND NOT {_INSIDE}",
    "overlaps": f"{_INSIDE} AND NOT {_COVERS} AND NOT {_COVERED}", "crosses": "y0 > 2 AND y0 < 5 AND x0 < 5 AND x1 > 2 AND NOT (x0 >= 2 AND x1 <= 5)",
}


def _grid(s, d, lines: bool):
    n = F.col("vec_id").cast("long")
    x0, y0 = n % 8, F.floor(n / 8) % 8
    x1, y1 = x0 + 1 + F.floor(n / 64) % 6, y0 + 1 + (F.floor(n / 64) + F.floor(n / 384)) % 6
    rows = table(s, d, "embeddings").select(n.alias(KEY), x0.alias("minx"), y0.alias("miny"), x1.alias("maxx"), (y0 if lines else y1).alias("maxy"))
    return rows.withColumn("geom", spatial.line_wkb("minx", "miny", "maxx", "maxy") if lines else spatial.box_wkb("minx", "miny", "maxx", "maxy"))


for _name, _sql in _ON_GRID.items():
    register(f"spatial_grid_{_name}", f"WITH {_GRID} SELECT fid FROM g WHERE {_sql}")(lambda s, d, r=_name: _grid(s, d, r == "crosses").where(spatial.spatial(r.upper(), "geom", _GRID_SQUARE)).select(KEY))


_CELL = lambda c, k: f"CAST(least(greatest(floor(({c} - -0.5) / 1.0 * 4096), 0), 4095) AS INTEGER) >> {k} & 1"
_QUADKEY = " || ".join(f"CAST((({_CELL('y', k)}) * 2 + ({_CELL('x', k)})) AS VARCHAR)" for k in range(11, -1, -1))


@register("quadtree_index", f"WITH {POINTS} SELECT {_QUADKEY} AS quadkey, fid, x, y, label FROM p0")
def _(s, d):
    return index.build(points(s, d), KEY, "x", "y", WORLD, ["label"])


@register("quadtree_search", f"WITH {POINTS} SELECT fid, label FROM p0 WHERE x BETWEEN 0.01 AND 0.2 AND y BETWEEN 0.01 AND 0.2")
def _(s, d):
    return index.search(index.build(points(s, d), KEY, "x", "y", WORLD, ["label"]), "x", "y", (0.01, 0.01, 0.2, 0.2), WORLD).select(KEY, "label")


@register("quadtree_update", f"WITH {POINTS} SELECT {_QUADKEY} AS quadkey, fid, x, y FROM p1")
def _(s, d):
    return index.updated(index.build(points(s, d), KEY, "x", "y", WORLD), points(s, d), points(s, d, True), KEY, "x", "y", WORLD)


@register("screenmap_thinning", f"WITH {POINTS} SELECT min(fid) AS fid FROM p0 GROUP BY floor(x / 0.05), floor(y / 0.05)")
def _(s, d):
    return spatial.thinned(points(s, d), "x", "y", KEY, 0.05).select(KEY)


# --- aggregates ------------------------------------------------------------------------------------------------------


@register("count_all", _BASE + "SELECT CAST(count(*) AS INTEGER) AS count FROM base")
def _(s, d):
    return ql.select(ql.parse("SELECT count(*) FROM orders"), base(s, d), KEY)


@register("count_filtered", _BASE + "SELECT CAST(count(*) AS INTEGER) AS count FROM base WHERE o_custkey < 100")
def _(s, d):
    return ql.select(ql.parse("SELECT count(*) FROM orders WHERE o_custkey < 100"), base(s, d), KEY)


@register("bounds_all", f"WITH {POINTS} SELECT min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy, 'EPSG:4326' AS crs FROM p0")
def _(s, d):
    return ql.select(ql.parse("SELECT bounds(*) FROM points"), _shapes(s, d), KEY)


@register("bounds_filtered", f"WITH {POINTS} SELECT min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy, 'EPSG:4326' AS crs FROM p0 WHERE label = 3")
def _(s, d):
    return aggregate.bounds(points(s, d).where("label = 3"), "x", "y")


@register("unique_values", _BASE + "SELECT DISTINCT o_orderpriority FROM base")
def _(s, d):
    return aggregate.unique(base(s, d), "o_orderpriority")


@register("min_max", _BASE + "SELECT min(o_totalprice) AS min_value, max(o_totalprice) AS max_value FROM base")
def _(s, d):
    return aggregate.extremes(base(s, d), "o_totalprice")


@register("nearest_value", _BASE + "SELECT max(o_totalprice) FILTER (o_totalprice <= 250000) AS floor_value, min(o_totalprice) FILTER (o_totalprice >= 250000) AS ceiling_value FROM base")
def _(s, d):
    return aggregate.nearest(base(s, d), "o_totalprice", 250000)


@register("sum_average", _BASE + "SELECT CAST(sum(o_custkey) AS BIGINT) AS sum_value, avg(o_custkey) AS avg_value, count(o_custkey) AS n FROM base")
def _(s, d):
    return aggregate.summary(base(s, d).withColumn("o_custkey", F.col("o_custkey").cast("long")), "o_custkey")


@register("count_by_layer", "SELECT l_returnflag AS layer, count(*) AS n FROM lineitem GROUP BY 1")
def _(s, d):
    return aggregate.by_layer(table(s, d, "lineitem").withColumnRenamed("l_returnflag", "layer"), "layer")


# --- trees -----------------------------------------------------------------------------------------------------------


def _listing(s, d):
    return snapshot.entries({"nation": table(s, d, "nation").select(F.col("n_nationkey").alias("k")), "region": table(s, d, "region").select(F.col("r_regionkey").alias("k"))}, "k")


_LISTING = "l AS (SELECT 'nation' AS path, '' AS parent_path, 'TREE' AS type UNION ALL SELECT 'region', '', 'TREE' UNION ALL SELECT 'nation/' || n_nationkey, 'nation', 'FEATURE' FROM nation UNION ALL SELECT 'region/' || r_regionkey, 'region', 'FEATURE' FROM region)"
_STRATEGIES = {"CHILDREN": "parent_path = ''", "TREES_ONLY": "parent_path = '' AND type = 'TREE'", "FEATURES_ONLY": "parent_path = '' AND type = 'FEATURE'", "DEPTHFIRST": "true", "DEPTHFIRST_ONLY_FEATURES": "type = 'FEATURE'", "DEPTHFIRST_ONLY_TREES": "type = 'TREE'"}
for _name, _sql in _STRATEGIES.items():
    register(f"ls_tree_{_name.lower()}", f"WITH {_LISTING} SELECT path, type FROM l WHERE {_sql}")(lambda s, d, n=_name: snapshot.ls_tree(_listing(s, d), n))


@register("ls_tree_under_path", f"WITH {_LISTING} SELECT path, type FROM l WHERE parent_path = 'nation'")
def _(s, d):
    return snapshot.ls_tree(_listing(s, d), "CHILDREN", "nation")


@register("feature_type_trees", f"WITH {_LISTING} SELECT DISTINCT parent_path FROM l WHERE type = 'FEATURE'")
def _(s, d):
    return snapshot.feature_trees(_listing(s, d))


@register("find_tree_child", f"WITH {_LISTING} SELECT path, type FROM l WHERE path = 'nation/3'")
def _(s, d):
    return snapshot.find_child(_listing(s, d), "nation/3").select("path", "type")


@register("bulk_retrieve", _BASE + "SELECT n.fid, b.o_totalprice FROM base n JOIN base b ON n.fid = b.fid WHERE n.fid % 50 = 0")
def _(s, d):
    from palimpsest.functions.identity import with_identity

    rows = with_identity(base(s, d), KEY)
    nodes = rows.where(F.col(KEY) % 50 == 0).select(F.concat_ws("/", F.lit("orders"), F.col(KEY)).alias("path"), KEY)
    return snapshot.retrieve(nodes, rows, KEY).select(KEY, "o_totalprice")


@register("mixed_types", "SELECT CAST(n_nationkey AS BIGINT) AS fid, n_name AS name, CAST(NULL AS DOUBLE) AS balance FROM nation UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(s, d):
    return snapshot.mixed(table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias(KEY), F.col("n_name").alias("name")), table(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias(KEY), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))


@register("type_adapter", _BASE + "SELECT CAST(fid AS VARCHAR) AS fid, CAST(o_custkey AS DOUBLE) AS o_custkey, CAST(NULL AS VARCHAR) AS extra FROM base")
def _(s, d):
    return snapshot.adapt(base(s, d), {KEY: "string", "o_custkey": "double", "extra": "string"})


@register("force_type_and_fid", _BASE + "SELECT 'invoice.' || fid AS fid, o_custkey FROM base")
def _(s, d):
    return snapshot.rename_type(base(s, d).select(F.concat(F.lit("orders."), F.col(KEY).cast("string")).alias(KEY), "o_custkey"), KEY, "invoice")


@register("sparse_filter", f"WITH {_LINES} SELECT layer, fid FROM a WHERE (layer = 'A' AND quantity > 50) OR (layer = 'N' AND false) OR (layer NOT IN ('A', 'N') AND fid % 2 = 0)")
def _(s, d):
    return snapshot.sparse(_lines(s, d), "layer", {"A": "quantity > 50", "N": "false", "default": "fid % 2 = 0"}).select("layer", KEY)


@register("hash_buckets", _BASE + "SELECT count(*) AS n FROM base")
def _(s, d):
    return base(s, d).groupBy(hash_bucket(KEY, 64).alias("b")).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"))


# SQL has no such hash, and the total above can't see the buckets; tests hold this one against brute force.
@register("hash_bucket_rows")
def _(s, d):
    return base(s, d).groupBy(hash_bucket(KEY, 64).alias("b")).agg(F.count(F.lit(1)).alias("n"))


@register("integrity_check", _BASE + "SELECT fid FROM base WHERE fid % 11 = 0")
def _(s, d):
    return history.missing_objects(base(s, d).select(KEY), ours(s, d).select(KEY), KEY)


# --- history ---------------------------------------------------------------------------------------------------------

#: Tips are taken from the table: the latest event, and others at ninths of it.
TIP, OTHER, EARLY, NEAR = (f"(SELECT {x} FROM events)" for x in ("max(event_id)", "max(event_id) * 7 // 9", "max(event_id) * 4 // 9", "max(event_id) - 10"))


def _tips(s, d) -> tuple[int, int, int, int]:
    last = table(s, d, "events").agg(F.max("event_id")).first()[0]
    return last, last * 7 // 9, last * 4 // 9, last - 10


def _reach(tip: str, name: str = "up") -> str:
    return f"{name}(c) AS (SELECT CAST({tip} AS BIGINT) UNION SELECT e.p FROM edge e JOIN {name} ON e.c = {name}.c)"


def _graph(s, d):
    c = commits(s, d)
    return c, history.Graph.of(c, list(_tips(s, d)))


@register("graph_edges", f"WITH {COMMITS} SELECT c AS commit, p AS parent FROM edge")
def _(s, d):
    return history.edges(commits(s, d)).select("commit", "parent")


@register("log_reachable", f"WITH RECURSIVE {COMMITS}, {_reach(TIP)} SELECT n.commit, n.author FROM node n JOIN up ON n.commit = up.c")
def _(s, d):
    return history.log(*_graph(s, d), [_tips(s, d)[0]]).select("commit", "author")


@register("log_since", f"WITH RECURSIVE {COMMITS}, {_reach(TIP)}, {_reach(EARLY, 'since')} SELECT n.commit FROM node n JOIN up ON n.commit = up.c WHERE n.commit NOT IN (SELECT c FROM since)")
def _(s, d):
    return history.log(*_graph(s, d), [_tips(s, d)[0]], since=_tips(s, d)[2]).select("commit")


@register("log_chronological_limit", f"WITH RECURSIVE {COMMITS}, {_reach(TIP)} SELECT n.commit FROM node n JOIN up ON n.commit = up.c ORDER BY n.ts DESC LIMIT 7 OFFSET 2")
def _(s, d):
    return history.log(*_graph(s, d), [_tips(s, d)[0]], by_time=True, skip=2, limit=7).select("commit")


@register("log_author", f"WITH RECURSIVE {COMMITS}, {_reach(TIP)}, {_reach(NEAR, 'b')} SELECT commit, author FROM node WHERE commit IN (SELECT c FROM up UNION SELECT c FROM b) AND regexp_full_match(author, '1.*')")
def _(s, d):
    return history.log(*_graph(s, d), [_tips(s, d)[0], _tips(s, d)[3]], author="1.*").select("commit", "author")


@register("log_time_range", f"WITH RECURSIVE {COMMITS}, {_reach(TIP)} SELECT n.commit FROM node n JOIN up ON n.commit = up.c WHERE n.ts BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'")
def _(s, d):
    from datetime import datetime

    return history.log(*_graph(s, d), [_tips(s, d)[0]], after=datetime(2024, 1, 2), before=datetime(2024, 1, 20)).select("commit")


@register("log_paths", f"WITH RECURSIVE {COMMITS}, {_reach(TIP)} SELECT n.commit FROM node n JOIN up ON n.commit = up.c WHERE n.message = 'click'")
def _(s, d):
    c, g = _graph(s, d)
    return history.log(c, g, [_tips(s, d)[0]], paths=c.where("message = 'click'")).select("commit")


@register("log_first_parent", f"WITH RECURSIVE f(c) AS (SELECT CAST({TIP} AS BIGINT) UNION SELECT c // 2 FROM f WHERE c > 0) SELECT c AS commit FROM f")
def _(s, d):
    return history.log(*_graph(s, d), [_tips(s, d)[0]], first_parent=True).select("commit")


@register("log_topological", f"WITH RECURSIVE {COMMITS}, {_reach(TIP)} SELECT c AS commit FROM up")
def _(s, d):
    return history.log(*_graph(s, d), [_tips(s, d)[0]], topo=True).select("commit")


@register("log_path_changes", f"WITH {VERSIONS}, w AS (SELECT fid, commit, event_type, level, lag(event_type) OVER (PARTITION BY fid ORDER BY ts, commit) AS e0, lag(level) OVER (PARTITION BY fid ORDER BY ts, commit) AS l0 FROM v) SELECT commit, fid FROM w WHERE event_type IS DISTINCT FROM e0 OR level IS DISTINCT FROM l0")
def _(s, d):
    return history.touched_paths(versions(s, d), KEY, ["event_type", "level"])


@register("merge_base", f"WITH RECURSIVE {COMMITS}, {_reach(TIP, 'a')}, {_reach(OTHER, 'b')}, k AS (SELECT c FROM a INTERSECT SELECT c FROM b), low(c) AS (SELECT e.p FROM edge e JOIN k ON e.c = k.c UNION SELECT e.p FROM edge e JOIN low ON e.c = low.c) SELECT n.commit FROM node n WHERE n.commit IN (SELECT c FROM k) AND n.commit NOT IN (SELECT c FROM low) ORDER BY n.ts DESC LIMIT 1")
def _(s, d):
    c, g = _graph(s, d)
    return s.createDataFrame([(g.merge_base(*_tips(s, d)[:2]),)], "commit long")


@register("ahead_behind", f"WITH RECURSIVE {COMMITS}, {_reach(TIP, 'a')}, {_reach(OTHER, 'b')} SELECT (SELECT count(*) FROM a WHERE c NOT IN (SELECT c FROM b)) AS ahead, (SELECT count(*) FROM b WHERE c NOT IN (SELECT c FROM a)) AS behind")
def _(s, d):
    return s.createDataFrame([_graph(s, d)[1].ahead_behind(*_tips(s, d)[:2])], "ahead long, behind long")


@register("commit_at_date", "SELECT CAST(event_id AS BIGINT) AS commit, ts FROM events WHERE ts < TIMESTAMP '2024-01-15 12:00:00' ORDER BY ts DESC, event_id DESC LIMIT 1")
def _(s, d):
    from datetime import datetime

    return history.commit_at(commits(s, d), datetime(2024, 1, 15, 12))


_BLAME = """c AS (SELECT *, row_number() OVER w AS n, lag(event_type) OVER w AS e0, lag(level) OVER w AS l0 FROM v WINDOW w AS (PARTITION BY fid ORDER BY ts, commit))
SELECT fid, 'event_type' AS attribute, arg_max(event_type, ts) AS value, arg_max(commit, ts) FILTER (n = 1 OR event_type IS DISTINCT FROM e0) AS commit FROM c GROUP BY fid
UNION ALL SELECT fid, 'level', CAST(arg_max(level, ts) AS VARCHAR), arg_max(commit, ts) FILTER (n = 1 OR level IS DISTINCT FROM l0) FROM c GROUP BY fid"""


@register("blame", f"WITH {VERSIONS}, {_BLAME}")
def _(s, d):
    return history.blame(versions(s, d), KEY, ["event_type", "level"], ["ts", "commit"])


@register("history_stats", f"WITH {COMMITS}, n AS (SELECT node.commit, author, count(p) AS parents FROM node LEFT JOIN edge ON node.commit = edge.c GROUP BY 1, 2) SELECT count(*) AS commits, count(DISTINCT author) AS authors, count(*) FILTER (parents > 1) AS merges, count(*) FILTER (parents = 0) AS roots FROM n")
def _(s, d):
    return history.stats(commits(s, d))


# --- query language: statements --------------------------------------------------------------------------------------


@register("ql_offset", _BASE + "SELECT fid FROM base ORDER BY fid OFFSET 14950")
def _(s, d):
    return ql.select(ql.parse('SELECT @id FROM "HEAD:orders" OFFSET 14950'), base(s, d), KEY)


@register("ql_limit", _BASE + "SELECT fid, o_custkey FROM base WHERE o_orderstatus = 'P' ORDER BY fid LIMIT 10 OFFSET 5")
def _(s, d):
    return ql.select(ql.parse("SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' LIMIT 5, 10"), base(s, d), KEY)


@register("ql_update", _BASE + "SELECT fid, o_custkey, CASE WHEN o_totalprice > 400000 THEN 'BIG' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderpriority FROM base")
def _(s, d):
    return ql.update(ql.parse("UPDATE orders SET o_orderstatus = 'BIG' WHERE o_totalprice > 400000"), base(s, d))


@register("ql_delete", _BASE + "SELECT * FROM base WHERE NOT (o_orderstatus IN ('F', 'O'))")
def _(s, d):
    return ql.delete(ql.parse("DELETE FROM orders WHERE o_orderstatus IN ('F', 'O')"), base(s, d))


@register("ql_insert_values", _BASE + "SELECT fid, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM base UNION ALL SELECT 5000000, -3, 'N', 1.5, NULL")
def _(s, d):
    return ql.insert(ql.parse('INSERT INTO orders ("@id", o_custkey, o_orderstatus, o_totalprice) VALUES (5000000, -3, \'N\', 1.5)'), base(s, d), None)


@register("ql_insert_select", f"WITH {SNAPSHOTS} SELECT * FROM base WHERE fid NOT IN (SELECT fid FROM theirs WHERE o_orderpriority = 'X') UNION ALL SELECT * FROM theirs WHERE o_orderpriority = 'X'")
def _(s, d):
    st = ql.parse("INSERT INTO orders SELECT * FROM \"theirs:orders\" WHERE o_orderpriority = 'X'")
    return ql.insert(st, base(s, d), ql.select(st.source, theirs(s, d), KEY))
