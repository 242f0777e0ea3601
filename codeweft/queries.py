"""The registered queries: each operator on a projected graph, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries_tree
from .functions import text
from .functions.vocab import EFFECTS, TEST_PATH
from .operators import edges, filters, graph, links, metrics, paths, resolve
from .sources import projections as P
from .streaming import snapshot

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = dict(queries_tree.QUERIES)
SQL: dict[str, str] = dict(queries_tree.SQL)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


S, C, N, A, U, L = P.SITES_SQL, P.CALLS_SQL, P.NODES_SQL, P.ACCESSES_SQL, P.URLS_SQL, P.LINES_SQL
E = f"{L}, {P.line_edges_sql()}"
#: All that each line reaches, by whatever way; orders have few lines.
R = f"{E}, r AS (SELECT source, target FROM e UNION SELECT r.source, e.target FROM r JOIN e ON r.target = e.source)"
#: Each line's component, by its least member.
K = f"{R}, comp AS (SELECT line.id, least(line.id, coalesce(min(a.target) FILTER (b.source IS NOT NULL), line.id)) AS component FROM line LEFT JOIN r a ON a.source = line.id LEFT JOIN r b ON b.source = a.target AND b.target = a.source GROUP BY line.id)"


@query("g1_edge_fold", f"""WITH {S} SELECT source, target, edge_type AS type, count(*) AS count, string_agg(DISTINCT line::VARCHAR, ',' ORDER BY line::VARCHAR) AS lines,
max(CASE confidence WHEN 'exact' THEN 2 ELSE 1 END) = 2 AS exact, bool_and(certain) AS certain, sum(CASE WHEN guard THEN 1 ELSE 0 END)::BIGINT AS guarded FROM sites GROUP BY source, target, edge_type""")
def g1_edge_fold(spark: SparkSession, d: str) -> DataFrame:
    f = edges.fold(P.edge_sites(spark, d))
    return f.select("source", "target", "type", "count", F.array_join(F.array_sort(F.transform("lines", lambda x: x.cast("string"))), ",").alias("lines"), (F.col("confidence") == "exact").alias("exact"), F.forall("certains", lambda x: x).alias("certain"), F.size(F.filter("controls", lambda c: F.size(c) > 0)).cast("long").alias("guarded"))


@query("g1_merged_fold", f"WITH {S} SELECT source, target, min(edge_type) AS type, count(DISTINCT edge_type) AS n_types, count(*) AS count FROM sites GROUP BY source, target")
def g1_merged_fold(spark: SparkSession, d: str) -> DataFrame:
    f = edges.fold(P.edge_sites(spark, d), per_type=False)
    return f.select("source", "target", "type", F.size("types").cast("long").alias("n_types"), "count")


@query("g8_stats", f"""WITH {S}, {N}, pairs AS (SELECT source, target, arg_min(edge_type, seq) AS f, list(DISTINCT edge_type) AS e FROM sites GROUP BY 1, 2)
SELECT 'node:' || kind AS measure, count(*) AS value FROM nodes GROUP BY 1 UNION ALL SELECT 'first:' || f, count(*) FROM pairs GROUP BY 1
UNION ALL SELECT 'any:' || t, count(*) FROM (SELECT unnest(e) AS t FROM pairs) GROUP BY 1 UNION ALL SELECT 'confidence:' || confidence, count(*) FROM sites GROUP BY 1 UNION ALL SELECT 'certain', count_if(certain) FROM sites""")
def g8_stats(spark: SparkSession, d: str) -> DataFrame:
    return edges.stats(P.nodes(spark, d), P.edge_sites(spark, d))


@query("f1_typed_edges", f"WITH {S} SELECT source, target, count(*) AS count FROM sites GROUP BY source, target HAVING bool_or(edge_type = 'REFERENCES')")
def f1_typed_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges.typed(edges.fold(P.edge_sites(spark, d), per_type=False), "REFERENCES").select("source", "target", "count")


@query("f2_test_paths", f"WITH {N} SELECT file_path, count(*) AS symbols FROM nodes WHERE regexp_matches(file_path, '{TEST_PATH}') GROUP BY 1")
def f2_test_paths(spark: SparkSession, d: str) -> DataFrame:
    return P.nodes(spark, d).where(text.is_test_path("file_path")).groupBy("file_path").agg(F.count("*").alias("symbols"))


@query("f4_globs", f"WITH {N} SELECT file_path, count(*) AS symbols FROM nodes WHERE NOT (file_path LIKE 'tests/%' OR regexp_matches(file_path, '^src/[^/]*/brand1[^/]\\.py$')) GROUP BY 1")
def f4_globs(spark: SparkSession, d: str) -> DataFrame:
    n = P.nodes(spark, d)
    return n.where(~text.matches_any("file_path", ["tests/**", "src/*/brand1?.py"])).groupBy("file_path").agg(F.count("*").alias("symbols"))


@query("f5_query_language", f"WITH {N} SELECT DISTINCT file_path FROM nodes WHERE lower(name) LIKE '%red_w%'")
def f5_query_language(spark: SparkSession, d: str) -> DataFrame:
    return filters.query_files(P.nodes(spark, d), ">r:red_w")


@query("f7_workspace_filter", f"WITH {N} SELECT id FROM nodes WHERE file_path NOT LIKE 'tests/%' AND file_path IN (SELECT file_path FROM nodes WHERE file_path LIKE '%economy%')")
def f7_workspace_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.workspace(P.nodes(spark, d), ["tests/**"], "economy").select("id")


@query("f9_without_isolated", f"WITH {C}, {N} SELECT id, kind FROM nodes WHERE id IN (SELECT source FROM calls UNION SELECT target FROM calls)")
def f9_without_isolated(spark: SparkSession, d: str) -> DataFrame:
    return filters.without_isolated(P.nodes(spark, d), P.calls(spark, d))[0].select("id", "kind")


@query("w1_find_round_robin", f"""WITH {N}, hits AS (SELECT 0 AS pattern, id, name FROM nodes WHERE lower(name) LIKE '%red^_%' ESCAPE '^' UNION ALL SELECT 1, id, name FROM nodes WHERE lower(name) LIKE '%bolt%'),
ranked AS (SELECT pattern, id, row_number() OVER (PARTITION BY pattern ORDER BY lower(name) <> (['red_', 'bolt'])[pattern + 1], NOT starts_with(lower(name), (['red_', 'bolt'])[pattern + 1]), length(id::VARCHAR), id) AS place, count(*) OVER (PARTITION BY pattern) AS total FROM hits),
once AS (SELECT id, min(struct_pack(place := place, pattern := pattern, total := total)) AS a FROM ranked GROUP BY id)
SELECT id, a.place AS place, a.pattern AS pattern, a.total AS total FROM once ORDER BY place, pattern LIMIT 25""")
def w1_find_round_robin(spark: SparkSession, d: str) -> DataFrame:
    n = P.nodes(spark, d).where("kind <> 'external'")
    return filters.find(n, "red_, bolt", limit=25)


@query("w6_cut_with_more", f"WITH {C} SELECT source, target, n, place, more FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, target) AS place, greatest(count(*) OVER (PARTITION BY source) - 2, 0) AS more FROM calls) WHERE place <= 2")
def w6_cut_with_more(spark: SparkSession, d: str) -> DataFrame:
    c = P.calls(spark, d).withColumnRenamed("count", "n")
    return filters.cut(c, [F.desc("n"), F.col("target")], 2, ["source"]).select("source", "target", "n", "place", "more")


@query("w5_most_called", f"WITH {C} SELECT target AS id, count(*) AS callers, sum(n)::BIGINT AS sites FROM calls GROUP BY 1 ORDER BY callers DESC, id LIMIT 20")
def w5_most_called(spark: SparkSession, d: str) -> DataFrame:
    return P.calls(spark, d).groupBy(F.col("target").alias("id")).agg(F.count("*").alias("callers"), F.sum("count").alias("sites")).orderBy(F.desc("callers"), "id").limit(20)


@query("j2_file_imports", f"WITH {C}, {N} SELECT a.file_path AS src_file, b.file_path AS dst_file, sum(n)::BIGINT AS count, count(DISTINCT target) AS symbols FROM calls JOIN nodes a ON source = a.id JOIN nodes b ON target = b.id WHERE a.file_path <> b.file_path GROUP BY 1, 2")
def j2_file_imports(spark: SparkSession, d: str) -> DataFrame:
    return edges.file_edges(P.calls(spark, d), P.nodes(spark, d))


@query("j3_importers", f"WITH {C}, {N}, fe AS (SELECT DISTINCT a.file_path AS s, b.file_path AS t FROM calls JOIN nodes a ON source = a.id JOIN nodes b ON target = b.id WHERE a.file_path <> b.file_path) SELECT t AS file_path, count(*) AS importers FROM fe GROUP BY 1")
def j3_importers(spark: SparkSession, d: str) -> DataFrame:
    return edges.file_edges(P.calls(spark, d), P.nodes(spark, d)).groupBy(F.col("dst_file").alias("file_path")).agg(F.count("*").alias("importers"))


@query("j4_valid_ends", f"WITH {C}, {N} SELECT source, target FROM calls WHERE source IN (SELECT id FROM nodes WHERE kind <> 'variable') AND target IN (SELECT id FROM nodes WHERE kind <> 'variable')")
def j4_valid_ends(spark: SparkSession, d: str) -> DataFrame:
    return edges.between(P.calls(spark, d), P.nodes(spark, d).where("kind <> 'variable'")).select("source", "target")


@query("j5_state_coupling", f"""WITH {A}, w AS (SELECT DISTINCT owner, variable FROM acc WHERE kind = 'write'), r AS (SELECT DISTINCT owner, variable FROM acc WHERE kind = 'read'),
p AS (SELECT least(w.owner, r.owner) AS a, greatest(w.owner, r.owner) AS b, w.owner < r.owner AS forth, variable FROM w JOIN r USING (variable) WHERE w.owner <> r.owner)
SELECT CASE WHEN bool_or(forth) THEN a ELSE b END AS "from", CASE WHEN bool_or(forth) THEN b ELSE a END AS "to", count(DISTINCT forth) = 2 AS mutual, count(DISTINCT variable)::INTEGER AS n FROM p GROUP BY a, b""")
def j5_state_coupling(spark: SparkSession, d: str) -> DataFrame:
    a = P.accesses(spark, d)
    return links.coupling(a.where("kind = 'write'"), a.where("kind = 'read'")).select("from", "to", "mutual", "n")


@query("j6_type_flow", """WITH p AS (SELECT DISTINCT l_suppkey AS owner, l_orderkey AS t FROM lineitem), c AS (SELECT DISTINCT l_partkey AS owner, l_orderkey AS t FROM lineitem),
few AS (SELECT t FROM (SELECT t, count(*) AS np FROM p GROUP BY t) JOIN (SELECT t, count(*) AS nc FROM c GROUP BY t) USING (t) WHERE np + nc <= 16)
SELECT p.owner AS "from", c.owner AS "to", t AS type FROM p JOIN c USING (t) WHERE t IN (SELECT t FROM few) AND p.owner <> c.owner""")
def j6_type_flow(spark: SparkSession, d: str) -> DataFrame:
    return links.type_flow(*P.uses(spark, d)).select("from", "to", "type")


@query("j7_beside", f"""WITH {C}, {A}, w AS (SELECT DISTINCT owner, variable FROM acc WHERE kind = 'write'), r AS (SELECT DISTINCT owner, variable FROM acc WHERE kind = 'read'),
p AS (SELECT least(w.owner, r.owner) AS a, greatest(w.owner, r.owner) AS b, w.owner < r.owner AS forth, variable FROM w JOIN r USING (variable) WHERE w.owner <> r.owner),
g AS (SELECT a, b, bool_or(forth) AS forth, list_sort(list(DISTINCT variable)) AS names FROM p GROUP BY a, b), drawn AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM calls)
SELECT CASE WHEN forth THEN a ELSE b END AS "from", CASE WHEN forth THEN b ELSE a END AS "to", array_to_string(names[1:2], ', ') || CASE WHEN len(names) > 2 THEN ' +' || (len(names) - 2) ELSE '' END AS label, (a, b) IN (SELECT (a, b) FROM drawn) AS beside FROM g""")
def j7_beside(spark: SparkSession, d: str) -> DataFrame:
    """State coupling with its labels, and whether a call joins the two either way."""
    a = P.accesses(spark, d)
    return links.coupling(a.where("kind = 'write'"), a.where("kind = 'read'"), P.calls(spark, d)).select("from", "to", "label", "beside")


@query("j8_innermost", """WITH s AS (SELECT o_custkey AS g, o_orderkey AS id, o_orderkey % 1000 AS a, o_orderkey % 1000 + (o_orderkey % 7 + 1) * 20 AS b FROM orders), p AS (SELECT DISTINCT c_custkey AS g, (c_custkey * 37) % 1100 AS x FROM customer)
SELECT p.g AS "group", x AS "at", arg_min(id, ((b - a) * 1000000 - a) * 10000000 + id) AS owner FROM p LEFT JOIN s ON p.g = s.g AND a <= x AND x <= b GROUP BY 1, 2""")
def j8_innermost(spark: SparkSession, d: str) -> DataFrame:
    o = P.table(spark, d, "orders")
    start = F.col("o_orderkey") % 1000
    spans = o.select(F.col("o_custkey").alias("group"), F.col("o_orderkey").alias("id"), start.alias("start"), (start + (F.col("o_orderkey") % 7 + 1) * 20).alias("end"))
    points = P.table(spark, d, "customer").select(F.col("c_custkey").alias("group"), ((F.col("c_custkey") * 37) % 1100).alias("at")).distinct()
    return links.innermost(points, spans).select("group", "at", "owner")


@query("j11_prefix_rules", """WITH t AS (SELECT DISTINCT replace(replace(regexp_replace(url, '^https?://', ''), '/', '.'), '?', '.') AS target FROM pages), r AS (SELECT DISTINCT split_part(target, '.', 1) || '.' || split_part(target, '.', 2) AS prefix, length(target) % 3 AS kind FROM t)
SELECT DISTINCT target, kind FROM t JOIN r ON target = prefix OR starts_with(target, prefix || '.')""")
def j11_prefix_rules(spark: SparkSession, d: str) -> DataFrame:
    t = P.table(spark, d, "pages").select(F.translate(F.regexp_replace("url", "^https?://", ""), "/?", "..").alias("target")).distinct()
    parts = F.split("target", r"\.")
    rules = t.select(F.concat_ws(".", parts[0], parts[1]).alias("prefix"), (F.length("target") % 3).cast("long").alias("kind")).distinct()
    return links.rule_prefix(t, rules)


@query("j12_orphans", f"WITH {C}, {N} SELECT id FROM nodes WHERE kind IN ('function', 'method') AND NOT routed AND id NOT IN (SELECT target FROM calls) AND id NOT IN (SELECT source FROM calls)")
def j12_orphans(spark: SparkSession, d: str) -> DataFrame:
    n, c = P.nodes(spark, d).where(F.col("kind").isin("function", "method")), P.calls(spark, d)
    return metrics.entry_kinds(metrics.roles(n), c, c.limit(0)).where("entry = 'orphan'").select("id")


@query("ga25_collapsed_edges", f"WITH {S}, {N}, el AS (SELECT id, file_path AS e FROM nodes) SELECT a.e AS source, b.e AS target, count(*) AS count, bool_or(confidence = 'heuristic') AS heuristic FROM sites JOIN el a ON source = a.id JOIN el b ON target = b.id WHERE a.e <> b.e GROUP BY 1, 2")
def ga25_collapsed_edges(spark: SparkSession, d: str) -> DataFrame:
    return links.collapsed(P.edge_sites(spark, d), P.nodes(spark, d).select("id", F.col("file_path").alias("element")))


@query("a1_degree", f"WITH {C}, {N} SELECT id, (SELECT count(*) FROM calls WHERE target = id) AS fan_in, (SELECT count(*) FROM calls WHERE source = id) AS fan_out FROM nodes")
def a1_degree(spark: SparkSession, d: str) -> DataFrame:
    return metrics.degree(P.nodes(spark, d), P.calls(spark, d))


@query("a3_shape", f"""WITH {C}, {N}, deg AS (SELECT id, (SELECT count(*) FROM calls WHERE target = id) AS i, (SELECT count(*) FROM calls WHERE source = id) AS o FROM nodes),
t AS (SELECT greatest(3, list_sort(list(i))[floor((count(*) - 1) * 0.9)::BIGINT + 1]) AS hi, greatest(3, list_sort(list(o))[floor((count(*) - 1) * 0.9)::BIGINT + 1]) AS ho FROM deg)
SELECT id, CASE WHEN o = 0 THEN 'leaf' WHEN i = 1 AND o = 1 THEN 'pipe' WHEN i >= hi AND o >= ho THEN 'hub' WHEN i >= hi THEN 'facade' WHEN o >= ho THEN 'orchestrator' ELSE 'plain' END AS shape FROM deg, t""")
def a3_shape(spark: SparkSession, d: str) -> DataFrame:
    return metrics.shape(metrics.degree(P.nodes(spark, d), P.calls(spark, d)))


@query("a4_test_only", f"WITH {C}, {N} SELECT n.id, coalesce(bool_and(regexp_matches(c.file_path, '{TEST_PATH}')), false) AS test_only FROM nodes n LEFT JOIN calls ON calls.target = n.id LEFT JOIN nodes c ON c.id = calls.source GROUP BY 1")
def a4_test_only(spark: SparkSession, d: str) -> DataFrame:
    return metrics.test_only(P.nodes(spark, d), P.calls(spark, d))


UNRESOLVED = P.UNRESOLVED_SQL


@query("a5_coverage", f"WITH {S}, {UNRESOLVED}, y AS (SELECT source AS id, count(*) AS r FROM sites GROUP BY 1), u AS (SELECT caller_id AS id, count(*) AS u, count_if(reason = 'computed callee') AS c FROM un GROUP BY 1) SELECT id, coalesce(r, 0) AS resolved, coalesce(u, 0) AS unresolved, coalesce(c, 0)::BIGINT AS dynamic, coalesce(r, 0) + coalesce(u, 0) AS total FROM y FULL JOIN u USING (id)")
def a5_coverage(spark: SparkSession, d: str) -> DataFrame:
    return metrics.coverage(P.edge_sites(spark, d), P.unresolved(spark, d))


@query("a6_coverage_total", f"WITH {S}, {UNRESOLVED}, y AS (SELECT count(*) AS in_project, count_if(confidence = 'heuristic')::BIGINT AS heuristic FROM sites), u AS (SELECT count_if(reason IN ('builtin', 'external: os.path'))::BIGINT AS out_of_project, count_if(reason NOT IN ('builtin', 'external: os.path'))::BIGINT AS unknown, count_if(reason = 'computed callee')::BIGINT AS computed FROM un) SELECT *, in_project + out_of_project + unknown AS total FROM y, u")
def a6_coverage_total(spark: SparkSession, d: str) -> DataFrame:
    return metrics.coverage_total(P.edge_sites(spark, d), P.unresolved(spark, d))


TAGS = "tags AS (SELECT source, target, CASE WHEN bool_and(guard) THEN 'guarded' WHEN bool_or(guard) THEN 'mixed' ELSE 'unguarded' END AS guard, bool_or(looped) AS looped, bool_and(looped) AS all_looped, bool_and(error) AS error_path, false AS type_checking_only, bool_and(certain) AS certain, count(*) AS sites FROM sites GROUP BY source, target)"


@query("a7_control_tags", f"WITH {S}, {TAGS} SELECT * FROM tags")
def a7_control_tags(spark: SparkSession, d: str) -> DataFrame:
    return edges.control_tags(P.edge_sites(spark, d))


@query("a8_node_tags", f"WITH {S}, {TAGS} SELECT target AS id, bool_and(error_path) AS error_handler, bool_and(looped) AS hot, bool_and(guard = 'guarded') AS always_guarded, count(*) AS callers FROM tags GROUP BY 1")
def a8_node_tags(spark: SparkSession, d: str) -> DataFrame:
    return edges.node_tags(edges.control_tags(P.edge_sites(spark, d)))


@query("a9_group_tags", f"""WITH {S}, {TAGS}, {N}, nt AS (SELECT target AS id, bool_and(error_path) AS error_handler, bool_and(looped) AS hot, bool_and(guard = 'guarded') AS always_guarded FROM tags GROUP BY 1)
SELECT id // 20 AS component, CASE WHEN count(*) = count(error_handler) THEN bool_and(error_handler) END AS error_handler, CASE WHEN count(*) = count(hot) THEN bool_and(hot) END AS hot, CASE WHEN count(*) = count(always_guarded) THEN bool_and(always_guarded) END AS always_guarded, max(complexity) AS complexity, count(*) AS size FROM nodes LEFT JOIN nt USING (id) GROUP BY 1""")
def a9_group_tags(spark: SparkSession, d: str) -> DataFrame:
    members = P.nodes(spark, d).select("id", F.floor(F.col("id") / 20).alias("component"), "complexity")
    return metrics.group_tags(edges.node_tags(edges.control_tags(P.edge_sites(spark, d))), members)


PREFIXES = "pre AS (SELECT array_to_string(string_split(path, '/')[1:i], '/') AS dir, i AS depth, size FROM (SELECT path, size, unnest(range(0, len(string_split(path, '/')))) AS i FROM urls))"


@query("a10_directory_rollup", f"WITH {U}, {PREFIXES} SELECT dir, depth::INTEGER AS depth, count(*) AS files, sum(size)::BIGINT AS total FROM pre WHERE depth <= 2 GROUP BY 1, 2")
def a10_directory_rollup(spark: SparkSession, d: str) -> DataFrame:
    return paths.rollup(P.url_paths(spark, d), "size", depth=2)


@query("a11_sunburst_angles", f"""WITH {U}, {PREFIXES}, tree AS (SELECT dir, split_part(dir, '/', 1) AS parent, sum(greatest(1, size))::BIGINT AS v FROM pre WHERE depth = 2 GROUP BY 1, 2)
SELECT dir, parent, round((sum(v) OVER w - v) / sum(v) OVER (PARTITION BY parent), 9) AS a0, CASE WHEN lead(1) OVER w IS NULL THEN 1.0 ELSE round(sum(v) OVER w / sum(v) OVER (PARTITION BY parent), 9) END AS a1 FROM tree WINDOW w AS (PARTITION BY parent ORDER BY dir)""")
def a11_sunburst_angles(spark: SparkSession, d: str) -> DataFrame:
    floored = P.url_paths(spark, d).withColumn("size", F.greatest(F.lit(1), "size"))
    tree = paths.rollup(floored, "size", depth=2).where("depth = 2").select(F.split("dir", "/")[0].alias("parent"), F.col("dir").alias("name"), F.col("total").alias("value"))
    return paths.angles(tree).select(F.col("name").alias("dir"), "parent", F.round("a0", 9).alias("a0"), F.round("a1", 9).alias("a1"))


@query("a12_shared_state", f"WITH {A} SELECT variable, count(DISTINCT owner) AS n_writers FROM acc WHERE kind = 'write' GROUP BY 1 HAVING count(DISTINCT owner) >= 2")
def a12_shared_state(spark: SparkSession, d: str) -> DataFrame:
    return metrics.shared_state(P.accesses(spark, d))


@query("a13_access_index", f"WITH {A} SELECT variable, string_agg(DISTINCT CASE WHEN kind = 'read' THEN owner::VARCHAR END, ',' ORDER BY CASE WHEN kind = 'read' THEN owner::VARCHAR END) AS readers, string_agg(DISTINCT CASE WHEN kind = 'write' THEN owner::VARCHAR END, ',' ORDER BY CASE WHEN kind = 'write' THEN owner::VARCHAR END) AS writers FROM acc GROUP BY 1")
def a13_access_index(spark: SparkSession, d: str) -> DataFrame:
    of = lambda kind: F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("owner").cast("string")))), ","), F.lit(""))
    return P.accesses(spark, d).groupBy("variable").agg(of("read").alias("readers"), of("write").alias("writers"))


@query("a14_kind_counts", f"WITH {N} SELECT file_path, kind, count(*) AS n FROM nodes GROUP BY 1, 2")
def a14_kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.nodes(spark, d).groupBy("file_path", "kind").agg(F.count("*").alias("n"))


@query("u3_through_calls", f"WITH {A}, own AS (SELECT DISTINCT variable FROM acc WHERE owner = 3), thr AS (SELECT DISTINCT variable FROM acc WHERE owner IN (4, 5, 6)) SELECT variable FROM thr WHERE variable NOT IN (SELECT variable FROM own)")
def u3_through_calls(spark: SparkSession, d: str) -> DataFrame:
    a = P.accesses(spark, d)
    return a.where(F.col("owner").isin(4, 5, 6)).select("variable").distinct().join(a.where("owner = 3"), "variable", "left_anti")


@query("u5_snapshot_diff", """WITH ev AS (SELECT concat_ws('/', 'u', user_id, event_type, hour(ts)) AS path, ts < TIMESTAMP '2024-01-16' AS early, event_id FROM events), b AS (SELECT path, max(event_id) AS was FROM ev WHERE early GROUP BY 1),
a AS (SELECT path, max(event_id) AS now FROM ev WHERE NOT early GROUP BY 1) SELECT path, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM b FULL JOIN a USING (path) WHERE was IS DISTINCT FROM now""")
def u5_snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.diff(*P.snapshots(spark, d))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return P.line_nodes(spark, d).select("id")


def _components(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = P.line_edges(spark, d)
    return graph.strongly_connected(_lines(spark, d), e), e


@query("ga1_strongly_connected", f"WITH RECURSIVE {K} SELECT id, component FROM comp")
def ga1_strongly_connected(spark: SparkSession, d: str) -> DataFrame:
    return _components(spark, d)[0]


@query("ga2_cycles", f"WITH RECURSIVE {K} SELECT component, count(*) AS size FROM comp GROUP BY 1 HAVING count(*) > 1")
def ga2_cycles(spark: SparkSession, d: str) -> DataFrame:
    return graph.cycles(_components(spark, d)[0])


@query("ga4_condensation", f"WITH RECURSIVE {K} SELECT DISTINCT a.component AS source, b.component AS target FROM e JOIN comp a ON a.id = source JOIN comp b ON b.id = target WHERE a.component <> b.component")
def ga4_condensation(spark: SparkSession, d: str) -> DataFrame:
    return graph.condensed(*_components(spark, d))


@query("ga3_call_nodes", f"WITH {C}, {N} SELECT id FROM nodes WHERE kind IN ('function', 'method') UNION SELECT source FROM calls UNION SELECT target FROM calls")
def ga3_call_nodes(spark: SparkSession, d: str) -> DataFrame:
    return edges.call_nodes(P.nodes(spark, d), P.calls(spark, d))


FIRST = "SELECT id, 0 AS hop FROM line WHERE place = 1"


def _first(spark: SparkSession, d: str) -> DataFrame:
    """The first lines of orders: where questions start."""
    return P.line_nodes(spark, d).where("place = 1").select("id")


@query("ga5_closure_hops", f"WITH RECURSIVE {E}, h AS ({FIRST} UNION SELECT e.target, hop + 1 FROM h JOIN e ON e.source = h.id WHERE hop < 6) SELECT id, min(hop) AS hop FROM h GROUP BY id")
def ga5_closure_hops(spark: SparkSession, d: str) -> DataFrame:
    return graph.expand(_first(spark, d), P.line_edges(spark, d), 6)[0]


@query("ga6_callers_per_seed", f"WITH RECURSIVE {E}, h AS (SELECT id AS seed, id, 0 AS hop FROM line UNION SELECT seed, e.source, hop + 1 FROM h JOIN e ON e.target = h.id WHERE hop < 4) SELECT seed, id, min(hop) AS hop FROM h GROUP BY seed, id")
def ga6_callers_per_seed(spark: SparkSession, d: str) -> DataFrame:
    seeds = _lines(spark, d).select(F.col("id").alias("seed"), "id")
    return graph.expand(seeds, graph.flipped(P.line_edges(spark, d)), 4)[0]


@query("ga7_reach_counts", f"WITH RECURSIVE {R}, d AS (SELECT source AS id, count(*) AS k FROM r WHERE source <> target GROUP BY 1), u AS (SELECT target AS id, count(*) AS k FROM r WHERE source <> target GROUP BY 1) SELECT id, coalesce(d.k, 0) AS reach_down, coalesce(u.k, 0) AS reach_up FROM line LEFT JOIN d USING (id) LEFT JOIN u USING (id)")
def ga7_reach_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.reach_counts(_lines(spark, d), P.line_edges(spark, d)).select("id", "reach_down", "reach_up")


DAG_SQL = "cd AS (SELECT DISTINCT a.component AS source, b.component AS target FROM e JOIN comp a ON a.id = source JOIN comp b ON b.id = target WHERE a.component <> b.component), entry AS (SELECT id FROM line WHERE id NOT IN (SELECT target FROM e WHERE source <> target))"


def _entries(spark: SparkSession, d: str, e: DataFrame) -> DataFrame:
    return _lines(spark, d).join(e.where("source <> target").select(F.col("target").alias("id")), "id", "left_anti")


@query("ga8_rank", f"WITH RECURSIVE {K}, {DAG_SQL}, h AS (SELECT DISTINCT component AS id, 0 AS hop FROM comp WHERE id IN (SELECT id FROM entry) UNION SELECT cd.target, hop + 1 FROM h JOIN cd ON cd.source = h.id), m AS (SELECT id AS component, min(hop) AS rank FROM h GROUP BY 1) SELECT id, rank FROM comp LEFT JOIN m USING (component)")
def ga8_rank(spark: SparkSession, d: str) -> DataFrame:
    e = P.line_edges(spark, d)
    return graph.ranks(_lines(spark, d), e, _entries(spark, d, e))


@query("u6_roots", f"WITH RECURSIVE {K}, {DAG_SQL} SELECT DISTINCT component AS id FROM comp WHERE component NOT IN (SELECT target FROM cd) OR id IN (SELECT id FROM entry)")
def u6_roots(spark: SparkSession, d: str) -> DataFrame:
    """Components of entries, and those that no other calls."""
    scc, e = _components(spark, d)
    return graph.roots(scc, graph.condensed(scc, e), _entries(spark, d, e))


@query("ga14_frontier", f"WITH RECURSIVE {K}, {DAG_SQL}, h AS (SELECT DISTINCT component AS id, 0 AS hop FROM comp WHERE component NOT IN (SELECT target FROM cd) OR id IN (SELECT id FROM entry) UNION SELECT cd.target, hop + 1 FROM h JOIN cd ON cd.source = h.id WHERE hop < 2) SELECT id, min(hop) AS hop FROM h GROUP BY 1")
def ga14_frontier(spark: SparkSession, d: str) -> DataFrame:
    """The overview's components: roots, and two levels below them."""
    scc, e = _components(spark, d)
    dag = graph.condensed(scc, e)
    return graph.frontier(graph.roots(scc, dag, _entries(spark, d, e)), dag, 2)


STEPS = f"{L}, {P.line_edges_sql('step', 'calls')}, {P.line_edges_sql('skip', 'refs')}"


@query("ga9_entry_kinds", f"WITH {STEPS} SELECT id, CASE WHEN id IN (SELECT target FROM calls) THEN 'internal' WHEN routed THEN 'framework-entry' WHEN id IN (SELECT target FROM refs) THEN 'referenced' WHEN id IN (SELECT source FROM calls) THEN 'entry' ELSE 'orphan' END AS entry FROM line")
def ga9_entry_kinds(spark: SparkSession, d: str) -> DataFrame:
    n = P.line_nodes(spark, d).select("id", F.when(F.col("routed"), "route").alias("role"))
    return metrics.entry_kinds(n, P.line_edges(spark, d, "step"), P.line_edges(spark, d, "skip"))


@query("ga10_roles", P.ROLES_SQL)
def ga10_roles(spark: SparkSession, d: str) -> DataFrame:
    return metrics.roles(P.role_nodes(spark, d)).select("id", "role")


@query("ga11_effects", f"WITH RECURSIVE {R}, d AS (SELECT id, CASE flag || status WHEN 'RF' THEN {EFFECTS['filesystem']} WHEN 'AF' THEN {EFFECTS['network']} WHEN 'NO' THEN {EFFECTS['process']} ELSE 0 END AS mask FROM line), x AS (SELECT r.source AS id, bit_or(d.mask) AS mask FROM r JOIN d ON d.id = r.target GROUP BY 1) SELECT id, (d.mask | coalesce(x.mask, 0))::INTEGER AS mask FROM d LEFT JOIN x USING (id)")
def ga11_effects(spark: SparkSession, d: str) -> DataFrame:
    k = F.concat("flag", "status")
    target = F.when(k == "RF", "shutil.copy").when(k == "AF", "requests.get").when(k == "NO", "subprocess.run").otherwise("mymod.f")
    direct = P.line_nodes(spark, d).select("id", metrics.effect_mask(target).alias("mask"))
    return graph.propagate(direct, P.line_edges(spark, d))


G = f"{L}, {P.line_edges_sql('step skip', 'dag')}, roots AS (SELECT id FROM line WHERE id NOT IN (SELECT target FROM dag))"
#: (cut, id): what roots of the same order still reach without ``cut``; what they don't, the cut dominates.
CUT = f"{G}, w AS (SELECT c.id AS cut, r.id AS id FROM line c JOIN roots r ON r.id // 100 = c.id // 100 AND c.id <> r.id UNION SELECT cut, target FROM w JOIN dag ON w.id = dag.source WHERE target <> cut), dom AS (SELECT n.id, c.id AS d FROM line n JOIN line c ON n.id // 100 = c.id // 100 AND n.id <> c.id WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.cut = c.id AND w.id = n.id))"


def _dominators(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    dag, n = P.line_edges(spark, d, "step skip"), _lines(spark, d)
    return graph.dominators(dag, n, n.join(dag.select(F.col("target").alias("id")), "id", "left_anti")), n


@query("ga12_dominators", f"WITH RECURSIVE {CUT}, depth AS (SELECT id, count(*) AS k FROM dom GROUP BY 1) SELECT n.id, i.d AS idom FROM line n LEFT JOIN (SELECT dom.id, dom.d FROM dom JOIN depth ON depth.id = dom.id LEFT JOIN depth up ON up.id = dom.d WHERE coalesce(up.k, 0) = depth.k - 1) i USING (id)")
def ga12_dominators(spark: SparkSession, d: str) -> DataFrame:
    return _dominators(spark, d)[0].select("id", "idom")


@query("ga12_gates", f"WITH RECURSIVE {CUT} SELECT d AS id, count(*) AS gates FROM dom GROUP BY 1")
def ga12_gates(spark: SparkSession, d: str) -> DataFrame:
    dom, n = _dominators(spark, d)
    return graph.gates(dom, n.withColumn("size", F.lit(1)))


@query("ga13_cone", f"""WITH RECURSIVE {E}, root AS (SELECT id FROM line ORDER BY last DESC, place DESC, id LIMIT 1), middle AS (SELECT id - 5 AS id FROM root), d AS (SELECT id, 0 AS hop FROM middle UNION SELECT e.target, hop + 1 FROM d JOIN e ON e.source = d.id WHERE hop < 3), u AS (SELECT id, 0 AS hop FROM middle UNION SELECT e.source, hop + 1 FROM u JOIN e ON e.target = u.id WHERE hop < 3)
SELECT 'root' AS side, id, 0 AS hop, 0 AS beyond, false AS truncated FROM middle UNION ALL SELECT 'down', id, min(hop), 0, false FROM d GROUP BY id HAVING min(hop) > 0 UNION ALL SELECT 'up', id, min(hop), 0, false FROM u GROUP BY id HAVING min(hop) > 0""")
def ga13_cone(spark: SparkSession, d: str) -> DataFrame:
    """Three levels either way of the sixth last line of the longest order."""
    root = P.line_nodes(spark, d).orderBy(F.desc("last"), F.desc("place"), "id").first()["id"] - 5
    rows, beyond, truncated = graph.cone(root, P.line_edges(spark, d), depth=3, budget=80)
    return rows.withColumn("beyond", F.lit(beyond)).withColumn("truncated", F.lit(truncated))


@query("ga15_mixed_growth", f"WITH RECURSIVE {E}, b AS (SELECT source, target FROM e UNION SELECT target, source FROM e), h AS (SELECT id, 0 AS hop FROM line WHERE place = last UNION SELECT b.target, hop + 1 FROM h JOIN b ON b.source = h.id WHERE hop < 3) SELECT id, min(hop) AS hop FROM h GROUP BY id")
def ga15_mixed_growth(spark: SparkSession, d: str) -> DataFrame:
    return graph.grow(P.line_nodes(spark, d).where("place = last").select("id"), P.line_edges(spark, d), 3)


@query("ga16_variable_impact", f"WITH RECURSIVE {E}, h AS (SELECT variable AS seed, id, 0 AS hop FROM line UNION SELECT seed, e.source, hop + 1 FROM h JOIN e ON e.target = h.id WHERE hop < 3) SELECT seed, id, min(hop) AS hop FROM h GROUP BY seed, id")
def ga16_variable_impact(spark: SparkSession, d: str) -> DataFrame:
    """For each part, the lines with it and what calls those."""
    seeds = P.line_nodes(spark, d).select(F.col("variable").alias("seed"), "id")
    return graph.expand(seeds, graph.flipped(P.line_edges(spark, d)), 3)[0]


@query("ga27_self_and_mutual", f"WITH {E} SELECT a.source AS id, max((a.source = a.target)::INT) = 1 AS itself, count(DISTINCT CASE WHEN a.source <> a.target THEN a.target END) AS mutual FROM e a JOIN e b ON a.source = b.target AND a.target = b.source GROUP BY 1")
def ga27_self_and_mutual(spark: SparkSession, d: str) -> DataFrame:
    return graph.recursive(P.line_edges(spark, d))


@query("w3_best_entry_per_component", f"WITH RECURSIVE {K}, deg AS (SELECT source AS id, count(*) AS k FROM r WHERE source <> target GROUP BY 1) SELECT component, id, coalesce(k, 0) AS reach_down FROM comp LEFT JOIN deg USING (id) QUALIFY row_number() OVER (PARTITION BY component ORDER BY coalesce(k, 0) DESC, id) = 1")
def w3_best_entry_per_component(spark: SparkSession, d: str) -> DataFrame:
    return filters.best_per(graph.reach_counts(_lines(spark, d), P.line_edges(spark, d)), "component", "reach_down").select("component", "id", "reach_down")


@query("fn_strings", """SELECT page_id, split_part(regexp_replace(url, '^https?://', ''), '/', 1) AS host, CASE WHEN length(trim(regexp_replace(html, '\\s+', ' ', 'g'))) > 80 THEN substr(trim(regexp_replace(html, '\\s+', ' ', 'g')), 1, 77) || '...' ELSE trim(regexp_replace(html, '\\s+', ' ', 'g')) END AS summary,
replace(replace(replace(replace(url, '#', '#35;'), '"', '#quot;'), '<', '#lt;'), '>', '#gt;') AS escaped, substr(sha256(url), 1, 8) AS key FROM pages""")
def fn_strings(spark: SparkSession, d: str) -> DataFrame:
    return P.table(spark, d, "pages").select("page_id", text.first_segment(F.regexp_replace("url", "^https?://", ""), "/").alias("host"), text.truncated("html").alias("summary"), text.escaped("url").alias("escaped"), F.substring(F.sha2(F.col("url").cast("binary"), 256), 1, 8).alias("key"))


@query("s19_source_slice", "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:3], chr(10)) AS code FROM documents")
def s19_source_slice(spark: SparkSession, d: str) -> DataFrame:
    return P.table(spark, d, "documents").select("doc_id", text.source_slice("text", F.lit(2), F.lit(3)).alias("code"))


@query("fn_paths", """SELECT p_partkey AS id, 'src/' || lower(p_type) || '/x.py' AS path, 'src.' || lower(regexp_replace(p_type, '\\W', '_', 'g')) || '.x' AS module, 'src/' || lower(p_type) || '/x.py:' || p_size AS at, lower(p_type) AS folder, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', -1) AS last,
trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) || '-' || substr(sha256(p_name), 1, 8) AS slug, floor(p_size * 100 / 50.0 + 0.5)::BIGINT AS share, strftime(make_timestamp(p_partkey * 86400000000), '%Y-%m-%dT%H:%M:%SZ') AS day FROM part""")
def fn_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths made plain, modules, locations, segments, slugs, percents and times."""
    p = P.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_size", F.concat(F.lit("./src\\\\"), F.lower("p_type"), F.lit("//x.py")).alias("raw")).withColumn("path", text.normal_path("raw"))
    return p.select("id", "path", text.module_name("path").alias("module"), text.location("path", "p_size").alias("at"), F.split("path", "/")[1].alias("folder"), text.first_segment("p_name", " ").alias("first"), text.last_segment("p_name", " ").alias("last"), text.slug_id("p_name").alias("slug"), text.percent("p_size", F.lit(50)).alias("share"), text.utc_time(F.col("id") * 86400).alias("day"))


@query("r1_first_wins", f"WITH {N} SELECT file_path AS id, min(id) AS first FROM nodes GROUP BY 1")
def r1_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """Of the rows with one key, the first in order."""
    n = P.nodes(spark, d).select(F.col("file_path").alias("id"), F.col("id").alias("first"))
    return resolve.first_by(n, ["id"], "first")


@query("w10_close_names", "SELECT 'suplier' AS word, 'supplier' AS name FROM region WHERE r_regionkey = 0")
def w10_close_names(spark: SparkSession, d: str) -> DataFrame:
    """Did you mean: the name that is most like a misspelt one."""
    names = spark.createDataFrame([(x,) for x in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")], "name string")
    return filters.close_names(names, "suplier", n=1).select(F.lit("suplier").alias("word"), "name")


@query("u2_both_types", f"WITH {S} SELECT source, target FROM sites GROUP BY 1, 2 HAVING count(DISTINCT edge_type) = 2")
def u2_both_types(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that are joined by edges of two types."""
    e = edges.fold(P.edge_sites(spark, d), per_type=False)
    return edges.typed(edges.typed(e, "REFERENCES"), "CALLS").select("source", "target")


@query("a13_access_directions", f"WITH {A} SELECT 'reader' AS direction, variable AS key, count(DISTINCT owner) AS n FROM acc WHERE kind = 'read' GROUP BY 2 UNION ALL SELECT 'writer', variable, count(DISTINCT owner) FROM acc WHERE kind = 'write' GROUP BY 2 UNION ALL SELECT 'reads', owner, count(DISTINCT variable) FROM acc WHERE kind = 'read' GROUP BY 2 UNION ALL SELECT 'writes', owner, count(DISTINCT variable) FROM acc WHERE kind = 'write' GROUP BY 2")
def a13_access_directions(spark: SparkSession, d: str) -> DataFrame:
    i = links.access_index(P.accesses(spark, d))
    return i.groupBy("direction", "key").agg(F.count("*").alias("n"))


@query("ga25_pooled_tags", f"WITH {S.replace('sites AS', 'plain AS', 1)}, {N}, sites AS (SELECT a.file_path AS source, b.file_path AS target, plain.* EXCLUDE (source, target) FROM plain JOIN nodes a ON a.id = plain.source JOIN nodes b ON b.id = plain.target WHERE a.file_path <> b.file_path), {TAGS} SELECT * FROM tags")
def ga25_pooled_tags(spark: SparkSession, d: str) -> DataFrame:
    """Control tags of edges between files, of all their sites' breadcrumbs."""
    return edges.control_tags(links.collapsed_sites(P.edge_sites(spark, d), P.nodes(spark, d).select("id", F.col("file_path").alias("element"))))


@query("a9_group_coverage", f"WITH {S}, {UNRESOLVED}, {N}, y AS (SELECT source AS id, count(*) AS r FROM sites GROUP BY 1), u AS (SELECT caller_id AS id, count(*) AS u, count_if(reason = 'computed callee') AS c FROM un GROUP BY 1), f AS (SELECT id, coalesce(r, 0) AS r, coalesce(u, 0) AS u, coalesce(c, 0) AS c FROM y FULL JOIN u USING (id)) SELECT file_path AS component, sum(r)::BIGINT AS resolved, sum(u)::BIGINT AS unresolved, sum(c)::BIGINT AS dynamic, sum(r + u)::BIGINT AS total FROM f JOIN nodes USING (id) GROUP BY 1")
def a9_group_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of call sites, summed by file."""
    c = metrics.coverage(P.edge_sites(spark, d), P.unresolved(spark, d))
    return metrics.group_coverage(c, P.nodes(spark, d).select("id", F.col("file_path").alias("component")))


SCOPES = "every AS (SELECT DISTINCT path, array_to_string(string_split(path, '/')[1:i], '/') AS dir, i AS depth, len(string_split(path, '/')) - 1 AS deepest FROM (SELECT path, unnest(range(0, len(string_split(path, '/')))) AS i FROM (SELECT DISTINCT path FROM urls)))"


@query("ga30_minimal_scopes", f"WITH {U}, {SCOPES}, t AS (SELECT path AS target FROM urls UNION SELECT dir FROM every UNION SELECT path || '/none' FROM urls) SELECT target, CASE WHEN target IN (SELECT dir FROM every) THEN target WHEN target IN (SELECT path FROM urls) THEN regexp_replace(target, '/?[^/]*$', '') END AS scope FROM t")
def ga30_minimal_scopes(spark: SparkSession, d: str) -> DataFrame:
    """The folder to open for every folder, every file and paths that aren't there."""
    u = P.url_paths(spark, d)
    targets = u.select(F.col("path").alias("target")).union(paths.prefixes(u).select("dir")).union(u.select(F.concat("path", F.lit("/none"))))
    return paths.minimal_scopes(targets, u)


@query("ga30_file_only_folders", f"WITH {U}, {SCOPES} SELECT dir FROM every WHERE dir <> '' GROUP BY 1 HAVING max(deepest - depth) = 0")
def ga30_file_only_folders(spark: SparkSession, d: str) -> DataFrame:
    return paths.file_only_folders(P.url_paths(spark, d))


@query("w8_folders_first", f"WITH {U}, {SCOPES}, held AS (SELECT dir, string_split(path, '/')[depth + 1] AS name, bool_and(deepest = depth) AS is_file FROM every GROUP BY 1, 2) SELECT dir, name, is_file, row_number() OVER (PARTITION BY dir ORDER BY is_file, name) AS place FROM held")
def w8_folders_first(spark: SparkSession, d: str) -> DataFrame:
    """What each folder holds, folders before files."""
    return paths.listing(P.url_paths(spark, d))
