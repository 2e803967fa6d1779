"""Queries that exercise the engine's operators on the driver's tables, with the SQL of the same rows.

The tables hold no mainframe sources, so each query runs an operator on rows of the same shape: parents and
children as graph edges, events as statements of a program, documents as sources.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from punchdeck.functions import columns as C
from punchdeck.operators import graph, incremental, lines, ranges, sequence

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


LINES_SQL = "SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents"


@query(f"SELECT doc_id, line::INT AS line, 'U001' AS rule_id, strpos(raw, regexp_extract(raw, '[0-9]+', 0))::INT AS col, regexp_extract(raw, '[0-9]+', 0) AS message FROM ({LINES_SQL}) WHERE regexp_matches(raw, '[0-9]+')")
def line_rule(spark, d):
    return lines.line_rule(lines.source_lines(t(spark, d, "documents"), "doc_id", "text"), "U001", "[0-9]+")


@query(f"SELECT doc_id, line::INT AS line, 'U002' AS rule_id, strpos(raw, regexp_extract(raw, '[0-9]+', 0))::INT AS col, 'number ' || regexp_extract(raw, '[0-9]+', 0) AS message FROM ({LINES_SQL}) WHERE regexp_matches(raw, '[0-9]+') AND NOT regexp_matches(raw, '[@$]')")
def line_rule_exclude(spark, d):
    return lines.line_rule(lines.source_lines(t(spark, d, "documents"), "doc_id", "text"), "U002", "[0-9]+", "[@$]", "number ${match}")


@query(f"SELECT doc_id, count(*) AS n_lines, sum(length(substring(raw, 8, 65)))::BIGINT AS n_body, count(*) FILTER (substring(raw, 7, 1) = ' ') AS n_blank FROM ({LINES_SQL}) GROUP BY doc_id")
def fixed_area(spark, d):
    rows = lines.source_lines(t(spark, d, "documents"), "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length(lines.body(F.col("raw")))).alias("n_body"), F.count_if(lines.indicator(F.col("raw")) == " ").alias("n_blank"))


@query("SELECT lang AS kind, count(*) AS n FROM documents GROUP BY lang")
def kind_counts(spark, d):
    return t(spark, d, "documents").groupBy(F.col("lang").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang AS kind, (SELECT count(*) FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0) AS findings FROM documents d")
def inventory_counts(spark, d):
    n = t(spark, d, "labels").filter("quality = 0").groupBy("doc_id").agg(F.count("*").alias("findings"))
    return t(spark, d, "documents").select("doc_id", F.col("lang").alias("kind")).join(n, "doc_id", "left").fillna(0, ["findings"])


@query("SELECT coalesce(max(CASE WHEN quality = 0 AND toxic = 1 THEN 2 WHEN quality = 0 THEN 1 ELSE 0 END), 0) AS exit_code, count(*) AS n FROM labels")
def severity_exit(spark, d):
    level = F.when((F.col("quality") == 0) & (F.col("toxic") == 1), 2).when(F.col("quality") == 0, 1).otherwise(0)
    return t(spark, d, "labels").agg(F.coalesce(F.max(level), F.lit(0)).alias("exit_code"), F.count("*").alias("n"))


NODES_SQL = """
SELECT 'R' || r_regionkey AS id, 'REGION' AS kind, r_name AS label FROM region
UNION ALL SELECT 'N' || n_nationkey, 'NATION', n_name FROM nation
UNION ALL SELECT 'C' || c_custkey, 'CUSTOMER', c_name FROM customer
UNION ALL SELECT 'S' || s_suppkey, 'SUPPLIER', s_name FROM supplier"""
EDGES_SQL = """
SELECT 'R' || n_regionkey AS from_id, 'N' || n_nationkey AS to_id FROM nation
UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer
UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier
UNION ALL SELECT 'C' || c_custkey, 'R' || (c_custkey % 5) FROM customer WHERE c_custkey % 97 = 0"""


def nodes(spark, d):
    parts = (("region", "r_regionkey", "r_name", "R"), ("nation", "n_nationkey", "n_name", "N"), ("customer", "c_custkey", "c_name", "C"), ("supplier", "s_suppkey", "s_name", "S"))
    out = [t(spark, d, n).select(F.concat(F.lit(x), F.col(k)).alias("id"), F.lit(n.upper()).alias("kind"), F.col(v).alias("label")) for n, k, v, x in parts]
    return out[0].union(out[1]).union(out[2]).union(out[3])


def edges(spark, d):
    def e(name, a, x, b, y):
        return t(spark, d, name).select(F.concat(F.lit(x), F.col(a)).alias("from_id"), F.concat(F.lit(y), F.col(b)).alias("to_id"))

    back = t(spark, d, "customer").filter("c_custkey % 97 = 0").select(F.concat(F.lit("C"), "c_custkey"), F.concat(F.lit("R"), F.col("c_custkey") % 5))
    return e("nation", "n_regionkey", "R", "n_nationkey", "N").union(e("customer", "c_nationkey", "N", "c_custkey", "C")).union(e("supplier", "s_suppkey", "S", "s_nationkey", "N")).union(back)


@query(f"""
SELECT id, min(kind) AS kind, min(label) AS label FROM ({NODES_SQL}) GROUP BY id""")
def nodes_union(spark, d):
    n = nodes(spark, d)
    again = n.filter("kind = 'NATION'").select("id", F.lit("LATE").alias("kind"), F.lit("late").alias("label"), F.lit(2).alias("priority"))
    return graph.first_writer(n.withColumn("priority", F.lit(1)).union(again))


@query("SELECT l_orderkey AS from_id, l_linenumber AS to_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_shipdate END NULLS LAST, l_linenumber)::INT AS seq FROM lineitem")
def edge_seq(spark, d):
    e = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("from_id"), F.col("l_linenumber").alias("to_id"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_shipdate")).alias("line"))
    return sequence.numbered(e, "from_id", "line", "to_id").select("from_id", "to_id", "seq")


@query("SELECT l_orderkey AS from_id, l_suppkey AS to_id, min_by(l_linenumber, l_linenumber) AS line, CASE WHEN count(DISTINCT CASE WHEN l_returnflag = 'R' THEN 'READ' ELSE 'WRITE' END) > 1 THEN 'UPDATE' ELSE min(CASE WHEN l_returnflag = 'R' THEN 'READ' ELSE 'WRITE' END) END AS access FROM lineitem GROUP BY 1, 2")
def edge_merge_access(spark, d):
    e = t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("from_id"), F.col("l_suppkey").alias("to_id"), F.lit("CRUD").alias("kind"), F.lit("RESOLVED").alias("resolution"),
        F.col("l_linenumber").alias("line"), F.col("l_linenumber").alias("arrival"), F.when(F.col("l_returnflag") == "R", "READ").otherwise("WRITE").alias("access"),
    )
    return graph.merged_edges(e).select("from_id", "to_id", "line", "access")


LETTER = "CASE event_type WHEN 'view' THEN 'R' WHEN 'signup' THEN 'C' WHEN 'purchase' THEN 'U' WHEN 'error' THEN 'D' ELSE 'R' END"


@query(f"SELECT user_id, (CASE WHEN bool_or(x = 'R') THEN 'R' ELSE '' END) || (CASE WHEN bool_or(x = 'C') THEN 'C' ELSE '' END) || (CASE WHEN bool_or(x = 'U') THEN 'U' ELSE '' END) || (CASE WHEN bool_or(x = 'D') THEN 'D' ELSE '' END) AS letters FROM (SELECT user_id, {LETTER} AS x FROM events) GROUP BY user_id")
def crud_letters(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.expr(LETTER)).alias("s")).select("user_id", C.crud(F.col("s")).alias("letters"))


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)")
def unresolved_refs(spark, d):
    return t(spark, d, "part").join(t(spark, d, "lineitem"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("SELECT c_custkey, CASE WHEN n IS NULL THEN 'EXTERNAL' ELSE 'RESOLVED' END AS resolution, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def external_refs(spark, d):
    n = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    j = t(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", F.when(F.col("n").isNull(), "EXTERNAL").otherwise("RESOLVED").alias("resolution"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def used_only(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("WITH a AS (SELECT l_orderkey AS k, l_linenumber AS pos FROM lineitem), b AS (SELECT o_orderkey AS k, unnest(range(1, 1 + o_custkey % 7)) AS pos FROM orders) SELECT coalesce(a.k, b.k) AS k, coalesce(a.pos, b.pos)::INT AS pos, a.k IS NULL AS missing FROM a FULL JOIN b ON a.k = b.k AND a.pos = b.pos WHERE a.k IS NULL OR b.k IS NULL")
def positional_match(spark, d):
    a = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("pos"), F.lit(True).alias("given"))
    take = F.expr("transform(filter(sequence(1, 7), x -> x <= o_custkey % 7), x -> int(x))")
    b = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.explode(take).alias("pos"), F.lit(True).alias("asked"))
    return a.join(b, ["k", "pos"], "full").filter("given is null or asked is null").select("k", "pos", F.col("given").isNull().alias("missing"))


@query("SELECT event_id, (floor(value / 20) * 20)::BIGINT AS low FROM events WHERE value IS NOT NULL")
def range_join_linemap(spark, d):
    """All events with the range of values that holds theirs; a range's end is the next one's start."""
    e = t(spark, d, "events").filter("value is not null").select("event_id", "value", F.lit(0).alias("one"))
    bands = e.select("one", (F.floor(F.col("value") / 20) * 20).alias("low")).distinct().withColumn("high", F.col("low") + 20)
    return ranges.within(e, bands, ["one"], "value", "low", "high").filter("value < high").select("event_id", "low")


@query("SELECT p_partkey, max(length(prefix))::INT AS long FROM part JOIN (VALUES ('a'), ('al'), ('b'), ('P'), ('Part'), ('s')) x(prefix) ON starts_with(p_name, prefix) GROUP BY 1")
def prefix_join(spark, d):
    dim = spark.range(1).select(F.explode(F.array(*map(F.lit, ("a", "al", "b", "P", "Part", "s")))).alias("prefix"))
    p = t(spark, d, "part")
    return p.join(F.broadcast(dim), F.expr("startswith(p_name, prefix)")).groupBy("p_partkey").agg(F.max(F.length("prefix")).alias("long"))


@query("SELECT event_id, nth FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)::INT AS nth FROM events) WHERE nth > 1")
def dup_second_later(spark, d):
    return sequence.later_duplicates(t(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("event_id", "nth")


@query("SELECT event_id FROM (SELECT *, lead(event_id) OVER w AS x, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) q WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM (SELECT user_id, event_type, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events) r WHERE r.user_id = q.user_id AND r.g = q.g AND r.event_type = 'click')")
def checked_after_linear(spark, d):
    e = F.col("event_type")
    return sequence.unchecked(t(spark, d, "events"), "user_id", e == "error", e == "click", "ts", "event_id").select("event_id")


@query("SELECT event_id, (SELECT max_by(s.event_id, (s.ts, s.event_id)) FROM events s WHERE s.user_id = p.user_id AND s.event_type = 'signup' AND (s.ts, s.event_id) < (p.ts, p.event_id)) AS in_effect FROM events p WHERE event_type = 'purchase'")
def last_whenever(spark, d):
    sign = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return sequence.last_before(t(spark, d, "events"), "user_id", sign, "ts", "event_id", name="in_effect").filter("event_type = 'purchase'").select("event_id", "in_effect")


@query("SELECT v.event_id FROM events v JOIN (SELECT user_id, min((ts, event_id)) AS first FROM events WHERE event_type = 'purchase' GROUP BY 1) p ON v.user_id = p.user_id WHERE v.event_type = 'view' AND (v.ts, v.event_id) > p.first")
def created_before_read(spark, d):
    e = t(spark, d, "events")
    made = F.min(F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))).over(Window.partitionBy("user_id"))
    return e.withColumn("made", made).filter((F.col("event_type") == "view") & (F.struct("ts", "event_id") > F.col("made"))).select("event_id")


@query("SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations")
def pass_previous(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return t(spark, d, "conversations").select("conv_id", "turn", F.lag("role").over(w).alias("before"))


@query("SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events f WHERE f.user_id = e.user_id AND f.event_type = e.event_type AND (f.ts, f.event_id) < (e.ts, e.event_id))")
def earlier_ref_missing(spark, d):
    """No earlier row of the key: the first row of each key, by an aggregation in place of a theta anti-join."""
    return t(spark, d, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id")).select("event_id")


@query("SELECT conv_id, max(turn) AS turn FROM (SELECT DISTINCT conv_id, turn FROM conversations) GROUP BY 1 HAVING count(*) >= 2")
def last_step(spark, d):
    return sequence.last_of(t(spark, d, "conversations").select("conv_id", "turn").distinct(), "conv_id", "turn", 2).select("conv_id", "turn")


@query(f"WITH RECURSIVE e AS ({EDGES_SQL}), r(id) AS (SELECT to_id FROM e WHERE from_id = 'R1' UNION SELECT e.to_id FROM r JOIN e ON e.from_id = r.id) SELECT id FROM r")
def reachable_from(spark, d):
    return graph.reach(edges(spark, d), spark.sql("SELECT 'R1' AS id")).select("id")


@query(f"WITH RECURSIVE e AS ({EDGES_SQL}), u AS (SELECT from_id AS a, to_id AS b FROM e UNION SELECT to_id, from_id FROM e), r(id, hops) AS (SELECT 'N3', 0 UNION SELECT u.b, r.hops + 1 FROM r JOIN u ON u.a = r.id WHERE r.hops < 2) SELECT id, min(hops)::INT AS hops FROM r GROUP BY id")
def bfs_depth_k(spark, d):
    return graph.reach(graph.undirected(edges(spark, d)), spark.sql("SELECT 'N3' AS id"), depth=2, with_start=True)


@query(f"SELECT id FROM ({NODES_SQL}) WHERE id NOT IN (SELECT to_id FROM ({EDGES_SQL}))")
def graph_roots(spark, d):
    return graph.roots(nodes(spark, d), edges(spark, d))


@query(f"SELECT id FROM ({NODES_SQL}) WHERE id NOT IN (SELECT to_id FROM ({EDGES_SQL}) WHERE to_id LIKE 'C%') AND id LIKE 'S%' AND id NOT IN (SELECT from_id FROM ({EDGES_SQL}) WHERE substr(from_id, 2)::INT % 2 = 0)")
def isolated(spark, d):
    e = edges(spark, d).filter("(from_id LIKE 'S%' AND int(substr(from_id, 2)) % 2 = 0) OR to_id LIKE 'C%'")
    return graph.isolated(nodes(spark, d), e).filter("id LIKE 'S%'")


@query("SELECT r_name || '/' || n_name || '/' || c_name AS path FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE true UNION ALL SELECT r_name || '/' || n_name FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT r_name FROM region")
def trace_paths(spark, d):
    r = t(spark, d, "region").select(F.col("r_name").alias("id"), "r_regionkey")
    n = t(spark, d, "nation")
    e = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("id").alias("from_id"), F.col("n_name").alias("to_id"))
    e = e.union(t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_name"))
    return graph.traces(e, r.select("id"), 2).select(F.array_join("path", "/").alias("path"))


@query("SELECT doc_id, source, quality, row_number() OVER (ORDER BY source, quality DESC, doc_id) AS place FROM documents JOIN labels USING (doc_id)")
def finding_sort(spark, d):
    j = t(spark, d, "documents").select("doc_id", "source").join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return sequence.placed(j, F.col("source"), F.desc("quality"), F.col("doc_id"))


@query("SELECT doc_id, lang, source FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND lang IN ('en', 'de') AND contains(lower(lang || ' ' || source), 'src1')")
def panel_filter(spark, d):
    j = t(spark, d, "documents").join(t(spark, d, "labels").filter("quality = 0").select("doc_id"), "doc_id")
    return j.filter(F.col("lang").isin("en", "de") & F.lower(F.concat_ws(" ", "lang", "source")).contains("src1")).select("doc_id", "lang", "source")


@query("SELECT count(*) FILTER (quality > 0) AS hidden, count(*) AS n FROM labels")
def hidden_count(spark, d):
    return t(spark, d, "labels").agg(F.count_if(F.col("quality") > 0).alias("hidden"), F.count("*").alias("n"))


@query("SELECT doc_id AS path FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
def removed_sources(spark, d):
    path = F.col("doc_id").alias("path")
    return incremental.removed(t(spark, d, "labels").select(path), t(spark, d, "documents").select(path))


@query("SELECT a.doc_id, b.doc_id IS NULL AS added FROM documents a LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'old' ELSE md5(text) END AS h FROM documents WHERE doc_id % 3 > 0) b ON a.doc_id = b.doc_id WHERE b.h IS DISTINCT FROM md5(a.text)")
def changed_sources(spark, d):
    now = t(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    stored = now.filter("doc_id % 3 > 0").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "old").otherwise(F.col("h")).alias("o"), F.lit(True).alias("known"))
    return now.join(stored, "doc_id", "left").filter("not (o <=> h)").select("doc_id", F.col("known").isNull().alias("added"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN (1 + event_id % 18 + 2) // 2 WHEN 1 THEN CASE WHEN 1 + event_id % 18 <= 4 THEN 2 WHEN 1 + event_id % 18 <= 9 THEN 4 ELSE 8 END ELSE 1 + event_id % 18 END::BIGINT AS n_bytes FROM events")
def storage_bytes(spark, d):
    text = F.get(F.array(F.lit("COMP-3"), F.lit("BINARY"), F.lit("DISPLAY")), (F.col("event_id") % 3).cast("int"))
    return t(spark, d, "events").select("event_id", C.storage_bytes(C.usage(text), 1 + F.col("event_id") % 18).alias("n_bytes"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_id % 5 = 0 WHEN 1 THEN event_id % 5 = 0 WHEN 2 THEN event_id % 5 <> 0 WHEN 3 THEN event_id % 5 > 0 WHEN 4 THEN true ELSE false END AS bypassed FROM events")
def cond_rc0(spark, d):
    op = F.get(F.array(*map(F.lit, ("EQ", "LE", "NE", "GT", "GE", "LT"))), (F.col("event_id") % 6).cast("int"))
    return t(spark, d, "events").select("event_id", C.bypasses_at_zero(op, F.col("event_id") % 5).alias("bypassed"))


@query("SELECT * FROM (VALUES ('A.B', 'A.B', NULL, NULL, false), ('A.B(M1)', 'A.B', 'M1', NULL, false), ('A.G(+1)', 'A.G', NULL, 1, false), ('&&T', '&&T', NULL, NULL, true), ('A.G(0)', 'A.G', NULL, 0, false)) x(dsn, name, member, gdg, temporary)")
def dsn_parse(spark, d):
    rows = spark.sql("SELECT * FROM VALUES ('A.B'), ('A.B(M1)'), ('A.G(+1)'), ('&&T'), ('A.G(0)') AS x(dsn)")
    return rows.select("dsn", C.dataset(F.col("dsn")).alias("x")).select("dsn", "x.name", "x.member", "x.gdg", "x.temporary")


@query("SELECT * FROM (VALUES ('(NEW,CATLG,DELETE)', 'NEW', 'CATLG', 'DELETE'), ('SHR', 'SHR', NULL, NULL), ('(,PASS)', 'NEW', 'PASS', NULL), ('(OLD,,KEEP)', 'OLD', NULL, 'KEEP')) x(disp, status, normal, abnormal)")
def disp_parse(spark, d):
    rows = spark.sql("SELECT * FROM VALUES ('(NEW,CATLG,DELETE)'), ('SHR'), ('(,PASS)'), ('(OLD,,KEEP)') AS y(disp)")
    return rows.select("disp", C.disposition(F.col("disp")).alias("x")).select("disp", "x.*")


@query("SELECT * FROM (VALUES ('SELECT A INTO :B FROM T', 'SELECT_INTO'), ('select 1 from t', 'SELECT'), ('UPDATE T SET A = 1', 'UPDATE'), ('DECLARE C CURSOR FOR SELECT 1', 'DECLARE_CURSOR'), ('GRANT ALL ON T TO PUBLIC', 'DDL'), ('EXPLAIN X', 'OTHER')) x(text, kind)")
def sql_kind(spark, d):
    rows = spark.sql("SELECT * FROM VALUES ('SELECT A INTO :B FROM T'), ('select 1 from t'), ('UPDATE T SET A = 1'), ('DECLARE C CURSOR FOR SELECT 1'), ('GRANT ALL ON T TO PUBLIC'), ('EXPLAIN X') AS x(text)")
    return rows.select("text", C.statement_kind(F.col("text")).alias("kind"))


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark, d):
    g = t(spark, d, "documents").groupBy(F.sha2("text", 256).alias("content_hash"))
    return g.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_detail(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
