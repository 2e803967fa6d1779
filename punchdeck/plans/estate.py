"""Queries over an estate of our own: facts of a few programs and jobs, stated once and given to Spark and to SQL alike.

The driver's tables have no calls, flow graphs or record layouts, so these queries work on stated facts, and their SQL
computes the same rows from the same facts in another way (recursive queries, correlated subqueries).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punchdeck.operators import findings, flow, graph, layout, linker, ranges
from punchdeck.plans.facts import Facts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# ---- the estate ---------------------------------------------------------------------------------------------------

PROGRAMS = Facts("id long, name string, path string", (1, "ACCT", "src/acct.cbl"), (2, "BILL", "src/bill.cbl"), (3, "ONLINE", "src/online.cbl"), (4, "bill", "old/bill.cbl"))
UTILITIES = Facts("name string", ("SORT",), ("IDCAMS",), ("IKJEFT01",))
STEPS = Facts("job string, step string, target string, line long", ("NIGHT", "S1", "acct", 3), ("NIGHT", "S2", "SORT", 9), ("NIGHT", "S3", "GONE", 14), ("NIGHT", "S4", "IKJEFT01", 18), ("DAY", "S1", "IKJEFT01", 2))
CARDS = Facts("job string, step string, program string", ("NIGHT", "S4", "bill"), ("DAY", "S1", "ACCT"), ("DAY", "S1", "BILL"))
DDS = Facts("job string, step string, dd string, dsn string, line long", ("NIGHT", "S1", "STEPLIB", "PROD.LIB", 4), ("NIGHT", "S1", "INFILE", "PROD.IN(+1)", 5), ("NIGHT", "S1", "out", "PROD.OUT", 6), ("NIGHT", "S2", "SORTIN", "PROD.OUT", 10), ("NIGHT", "S4", "MASTER", "PROD.M", 19), ("DAY", "S1", "MASTER", "PROD.M", 3), ("DAY", "S1", "REF", "*.S1.X", 4), ("DAY", "S1", "NONE", None, 5))
ROLES = Facts("job string, step string, dd string, access string", ("NIGHT", "S1", "INFILE", "WRITE"), ("NIGHT", "S2", "SORTIN", "READ"), ("DAY", "S1", "MASTER", "READ"))
OPENS = Facts("program string, dd string, mode string", ("ACCT", "INFILE", "INPUT"), ("ACCT", "OUT", "OUTPUT"), ("ACCT", "OUT", "INPUT"), ("BILL", "MASTER", "I-O"), ("BILL", "LOG", "EXTEND"))
COPIES = Facts("program string, copybook string, line long", ("ACCT", "custrec", 5), ("BILL", "CUSTREC", 7), ("BILL", "NOSUCH", 8), ("ACCT", "CUSTREC", 5))
COPYBOOKS = Facts("name string", ("CustRec",), ("DATES",))
CALLS = Facts("program string, target string, line long", ("ACCT", "BILL", 20), ("ACCT", "CBLTDLI", 21), ("BILL", "CEE3ABD", 9), ("BILL", "CEEX", 10), ("BILL", "OTHER", 11), ("ONLINE", "mqopen", 30))
EXACT = Facts("entry string, owner string", ("CBLTDLI", "IMS"), ("CEE3ABD", "ABEND"))
PREFIXES = Facts("entry string, owner string", ("CEE", "LE"), ("MQ", "MQ"), ("CEEX", "LEX"))
DYNAMIC = Facts("program string, variable string, line long", ("ACCT", "ws-pgm", 40), ("BILL", "WS-NONE", 41))
CONSTANTS = Facts("program string, variable string, value string, line long", ("ACCT", "WS-PGM", "BILL ", 12), ("ACCT", "WS-PGM", "LATER", 13), ("ONLINE", "MQOD-OBJECTNAME", "QUEUE.ONE", 14), ("BILL", "MQOD-OBJECTNAME", "QUEUE.TWO", 15), ("ONLINE", "WS-TRAN", "TR01", 16))
COMMANDS = Facts("program string, verb string, operand string, literal boolean, line long", ("ONLINE", "XCTL", "acct", True, 50), ("ONLINE", "RETURN", "WS-TRAN", False, 51), ("ONLINE", "SEND", "MAP1", True, 52), ("ONLINE", "LINK", "WS-X", False, 53), ("ONLINE", "READ", "FILE1", True, 54))
TABLE = Facts("transaction string, program string", ("TR01", "ONLINE"), ("tr02", "ACCT"))
DEFINED = Facts("transaction string, program string", ("TR02", "BILL"), ("TR03", "BILL"))
PCBS = Facts("psb string, dbd string, line long", ("PSB1", "custdb", 2), ("PSB1", "NODB", 3))
DATABASES = Facts("name string", ("CUSTDB",))
SQL_CALLS = Facts("program string, name string, line long", ("ACCT", "S.PROC1", 60), ("BILL", "proc2", 61))
ROUTINES = Facts("name string", ("X.proc1",))
USES = Facts("program string, table string, kind string, line long", ("ACCT", "cust", "SELECT", 70), ("ACCT", "CUST", "DELETE", 71), ("BILL", "CUST", "MERGE", 72), ("BILL", "BILLS", "INSERT", 73), ("BILL", "BILLS", "FETCH", 74))
SQL_NODE = "upper({0})"


@query(f"SELECT DISTINCT 'PROGRAM:' || upper(c.program) AS from_id, 'COPYBOOK:' || upper(c.copybook) AS to_id, 'COPY' AS kind, 'RESOLVED' AS resolution, c.line FROM {COPIES} c WHERE EXISTS (SELECT 1 FROM {COPYBOOKS} b WHERE upper(b.name) = upper(c.copybook))")
def link_copies(spark, d):
    return linker.copy_edges(COPIES.df(spark), COPYBOOKS.df(spark))


@query(f"SELECT upper(copybook) AS copybook, array_to_string(list_sort(list_distinct(list(upper(program)))), ',') AS programs FROM {COPIES} GROUP BY 1")
def copybook_importers(spark, d):
    return linker.importers(COPIES.df(spark)).withColumn("programs", F.array_join("programs", ","))


@query(f"""SELECT 'STEP:' || upper(job || '.' || step) AS from_id, CASE WHEN upper(target) IN (SELECT name FROM {UTILITIES}) THEN 'UTILITY:' ELSE 'PROGRAM:' END || upper(target) AS to_id, 'EXECUTION' AS kind,
 CASE WHEN upper(target) IN (SELECT name FROM {UTILITIES}) OR upper(target) IN (SELECT upper(name) FROM {PROGRAMS}) THEN 'RESOLVED' ELSE 'EXTERNAL' END AS resolution, line FROM {STEPS}""")
def link_steps(spark, d):
    return linker.step_edges(STEPS.df(spark), PROGRAMS.df(spark), UTILITIES.df(spark))


OWNER = f"coalesce((SELECT owner FROM {EXACT} e WHERE e.entry = upper(c.target)), (SELECT owner FROM {PREFIXES} p WHERE starts_with(upper(c.target), p.entry) ORDER BY length(p.entry) DESC LIMIT 1))"


@query(f"""SELECT 'PROGRAM:' || program AS from_id, CASE WHEN owner IS NOT NULL THEN 'SERVICE:' || owner ELSE 'PROGRAM:' || upper(target) END AS to_id, 'CALL' AS kind,
 CASE WHEN owner IS NOT NULL OR upper(target) IN (SELECT upper(name) FROM {PROGRAMS}) THEN 'RESOLVED' ELSE 'EXTERNAL' END AS resolution, line FROM (SELECT c.*, {OWNER} AS owner FROM {CALLS} c)""")
def link_calls(spark, d):
    return linker.call_edges(CALLS.df(spark), PROGRAMS.df(spark), EXACT.df(spark), PREFIXES.df(spark))


@query("SELECT p_partkey, p_name, coalesce((SELECT owner FROM (VALUES ('A', 'a'), ('B', 'b'), ('BL', 'bl'), ('GRE', 'gre'), ('S', 's')) v(entry, owner) WHERE starts_with(upper(p_name), entry) ORDER BY length(entry) DESC LIMIT 1)) AS owner FROM part")
def prefix_owner(spark, d):
    entries = spark.createDataFrame([("A", "a"), ("B", "b"), ("BL", "bl"), ("GRE", "gre"), ("S", "s")], "entry string, owner string")
    return ranges.owner_by_name(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name"), entries.limit(0), entries, "p_name")


@query(f"""SELECT DISTINCT 'PROGRAM:' || c.program AS from_id, CASE WHEN v.value IS NULL THEN 'VARIABLE:' || upper(c.program || '.' || c.variable) ELSE 'PROGRAM:' || upper(trim(v.value)) END AS to_id, 'CALL' AS kind,
 CASE WHEN v.value IS NULL THEN 'UNRESOLVED' WHEN upper(trim(v.value)) IN (SELECT upper(name) FROM {PROGRAMS}) THEN 'RESOLVED' ELSE 'EXTERNAL' END AS resolution, c.line
 FROM {DYNAMIC} c LEFT JOIN {CONSTANTS} v ON v.program = c.program AND upper(v.variable) = upper(c.variable)""")
def link_dynamic_calls(spark, d):
    return linker.dynamic_call_edges(DYNAMIC.df(spark), CONSTANTS.df(spark), PROGRAMS.df(spark))


@query(f"""SELECT program, dd, CASE WHEN bool_or(mode = 'I-O') OR (bool_or(mode = 'INPUT') AND bool_or(mode IN ('OUTPUT', 'EXTEND'))) THEN 'UPDATE' WHEN bool_or(mode IN ('OUTPUT', 'EXTEND')) THEN 'WRITE' ELSE 'READ' END AS access FROM {OPENS} GROUP BY 1, 2""")
def file_access(spark, d):
    return linker.file_access(OPENS.df(spark))


def data_sets(spark):
    return linker.data_set_edges(DDS.df(spark), linker.runs_of_steps(STEPS.df(spark), CARDS.df(spark)), linker.file_access(OPENS.df(spark)), ROLES.df(spark))


@query(f"""WITH a AS ({SQL['file_access']}), r AS (SELECT s.job, s.step, CASE count(DISTINCT upper(c.program)) WHEN 0 THEN upper(any_value(s.target)) WHEN 1 THEN any_value(upper(c.program)) END AS program
 FROM {STEPS} s LEFT JOIN {CARDS} c ON c.job = s.job AND c.step = s.step GROUP BY 1, 2)
 SELECT 'STEP:' || d.job || '.' || d.step AS from_id, 'DATASET:' || split_part(dsn, '(', 1) AS to_id, 'DATASET' AS kind, 'RESOLVED' AS resolution, line, coalesce(a.access, o.access) AS access
 FROM {DDS} d LEFT JOIN r ON r.job = d.job AND r.step = d.step LEFT JOIN a ON a.program = r.program AND a.dd = upper(d.dd) LEFT JOIN {ROLES} o ON o.job = d.job AND o.step = d.step AND o.dd = upper(d.dd)
 WHERE dsn IS NOT NULL AND upper(d.dd) NOT IN ('STEPLIB', 'JOBLIB') AND NOT starts_with(dsn, '*.')""")
def link_data_sets(spark, d):
    return data_sets(spark)


@query(f"SELECT 'PSB:' || psb AS from_id, 'DBD:' || upper(dbd) AS to_id, 'DATABASE' AS kind, CASE WHEN upper(dbd) IN (SELECT name FROM {DATABASES}) THEN 'RESOLVED' ELSE 'EXTERNAL' END AS resolution, line FROM {PCBS}")
def link_ims(spark, d):
    return linker.ims_edges(PCBS.df(spark), DATABASES.df(spark))


@query(f"SELECT 'PROGRAM:' || program AS from_id, 'QUEUE:' || value AS to_id, 'QUEUE' AS kind, 'RESOLVED' AS resolution, line FROM {CONSTANTS} WHERE variable LIKE '%OBJECTNAME' AND program IN (SELECT program FROM {CALLS} WHERE upper(target) IN ('MQOPEN', 'MQPUT1'))")
def link_queues(spark, d):
    return linker.queue_edges(CONSTANTS.df(spark), CALLS.df(spark))


@query(f"""SELECT 'PROGRAM:' || c.program AS from_id, CASE WHEN literal OR v.value IS NOT NULL THEN CASE WHEN verb IN ('XCTL', 'LINK') THEN 'PROGRAM:' WHEN verb IN ('START', 'RETURN') THEN 'TRANSACTION:' ELSE 'MAP:' END || upper(coalesce(v.value, operand))
 ELSE 'VARIABLE:' || c.program || '.' || operand END AS to_id, 'CICS' AS kind, CASE WHEN literal OR v.value IS NOT NULL THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS resolution, c.line
 FROM {COMMANDS} c LEFT JOIN {CONSTANTS} v ON NOT literal AND v.program = c.program AND v.variable = c.operand WHERE verb <> 'READ'""")
def link_cics(spark, d):
    return linker.cics_edges(COMMANDS.df(spark), CONSTANTS.df(spark))


@query(f"SELECT coalesce(t.transaction, d.transaction) AS transaction, coalesce(t.program, d.program) AS program, CASE WHEN t.program IS NULL THEN 'DEFINITION' ELSE 'TABLE' END AS origin FROM (SELECT upper(transaction) AS transaction, program FROM {TABLE}) t FULL JOIN {DEFINED} d ON t.transaction = d.transaction")
def transaction_programs(spark, d):
    return linker.transactions(TABLE.df(spark), DEFINED.df(spark))


@query(f"SELECT 'PROGRAM:' || program AS from_id, CASE WHEN upper(split_part(name, '.', -1)) = 'PROC1' THEN 'ROUTINE:' ELSE 'PROGRAM:' END || upper(split_part(name, '.', -1)) AS to_id, 'SQL_CALL' AS kind, CASE WHEN upper(split_part(name, '.', -1)) = 'PROC1' THEN 'RESOLVED' ELSE 'EXTERNAL' END AS resolution, line FROM {SQL_CALLS}")
def link_sql_calls(spark, d):
    return linker.sql_call_edges(SQL_CALLS.df(spark), ROUTINES.df(spark))


@query(f"""SELECT 'PROGRAM:' || program AS from_id, 'TABLE:' || upper("table") AS to_id, 'TABLE' AS kind, 'RESOLVED' AS resolution, min(line) AS line,
 CASE WHEN bool_or(kind IN ('SELECT', 'FETCH')) THEN 'R' ELSE '' END || CASE WHEN bool_or(kind IN ('INSERT', 'MERGE')) THEN 'C' ELSE '' END || CASE WHEN bool_or(kind = 'MERGE') THEN 'U' ELSE '' END || CASE WHEN bool_or(kind = 'DELETE') THEN 'D' ELSE '' END AS access FROM (SELECT program, "table", kind, line FROM {str(USES).replace(', table,', ', "table",')}) GROUP BY 1, 2""")
def link_tables(spark, d):
    return linker.table_edges(USES.df(spark))


def whole_graph(spark):
    made = [QUERIES[n](spark, "") for n in ("link_copies", "link_steps", "link_calls", "link_dynamic_calls", "link_data_sets", "link_ims", "link_queues", "link_cics", "link_sql_calls", "link_tables")]
    return linker.call_graph(made)


WHOLE = " UNION ALL ".join(f"SELECT from_id, to_id, kind, resolution, line FROM ({SQL[n]})" for n in ("link_copies", "link_steps", "link_calls", "link_dynamic_calls", "link_data_sets", "link_ims", "link_queues", "link_cics", "link_sql_calls", "link_tables"))


@query(f"SELECT from_id, to_id, kind, resolution, min(line) AS line, (dense_rank() OVER (PARTITION BY from_id ORDER BY min(line)) > 0) AS placed FROM ({WHOLE}) GROUP BY from_id, to_id, kind, resolution")
def call_graph_edges(spark, d):
    _, edges = whole_graph(spark)
    return edges.select("from_id", "to_id", "kind", "resolution", "line", (F.col("seq") > 0).alias("placed"))


@query(f"SELECT id, split_part(id, ':', 1) AS kind, substring(id, strpos(id, ':') + 1) AS label, bool_and(x) AS external FROM (SELECT from_id AS id, false AS x FROM ({WHOLE}) UNION ALL SELECT to_id, resolution <> 'RESOLVED' FROM ({WHOLE})) GROUP BY id")
def call_graph_nodes(spark, d):
    return whole_graph(spark)[0]


@query(f"SELECT e.from_id, e.to_id, (SELECT path FROM {PROGRAMS} p WHERE 'PROGRAM:' || upper(p.name) = e.to_id ORDER BY id LIMIT 1) AS to_path FROM ({SQL['link_calls']}) e")
def call_target_paths(spark, d):
    return linker.target_paths(link_calls(spark, d), PROGRAMS.df(spark)).select("from_id", "to_id", "to_path")


# ---- procedures ---------------------------------------------------------------------------------------------------

PROCEDURES = Facts("program string, idx int, name string, section string, ends boolean", ("A", 1, "MAIN", None, True), ("A", 2, "S1", "S1", True), ("A", 3, "P", "S1", False), ("A", 4, "S2", "S2", True), ("A", 5, "P", "S2", True), ("A", 6, "Q", "S2", False), ("A", 7, "END", "S2", True), ("B", 1, "P", None, True), ("B", 2, "R", None, False))
REFS = Facts("program string, ref long, name string, qualifier string, section string", ("A", 1, "p", None, "S2"), ("A", 2, "P", "S1", "S2"), ("A", 3, "Q", None, None), ("A", 4, "NO", None, "S1"), ("A", 5, "P", None, None), ("B", 6, "P", None, None))
PERFORMS = Facts("program string, ref long, low int, high int", ("A", 1, 2, 5), ("A", 2, 3, 3), ("B", 3, 1, 2), ("A", 4, 6, 5))


@query(f"SELECT r.program, r.ref, (SELECT p.idx FROM {PROCEDURES} p WHERE p.program = r.program AND p.name = upper(r.name) AND (r.qualifier IS NULL OR p.section = r.qualifier) ORDER BY p.section IS NOT DISTINCT FROM r.section DESC, p.idx LIMIT 1) AS idx FROM {REFS} r")
def procedure_names(spark, d):
    return linker.named_procedures(REFS.df(spark), PROCEDURES.df(spark))


@query(f"SELECT r.program, r.ref, p.idx, p.name FROM {PERFORMS} r JOIN {PROCEDURES} p ON p.program = r.program AND p.idx BETWEEN r.low AND r.high")
def perform_ranges(spark, d):
    return linker.performed(PERFORMS.df(spark), PROCEDURES.df(spark))


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber BETWEEN o_custkey % 3 AND o_custkey % 3 + o_orderkey % 5")
def range_join(spark, d):
    lines_ = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    wide = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", (F.col("o_custkey") % 3).alias("low"), (F.col("o_custkey") % 3 + F.col("o_orderkey") % 5).alias("high"))
    return ranges.within(lines_, wide, ["o_orderkey"], "l_linenumber", "low", "high", width=4).select("o_orderkey", "l_linenumber", "l_quantity")


@query(f"SELECT p.program, p.idx AS from_idx, (SELECT min(n.idx) FROM {PROCEDURES} n WHERE n.program = p.program AND n.idx > p.idx) AS to_idx FROM {PROCEDURES} p WHERE p.ends AND EXISTS (SELECT 1 FROM {PROCEDURES} n WHERE n.program = p.program AND n.idx > p.idx)")
def fallthrough(spark, d):
    return linker.fallthrough(PROCEDURES.df(spark))


@query(f"SELECT p.program, p.idx, (SELECT count(*) FROM {PROCEDURES} q WHERE q.program = p.program AND q.idx < p.idx AND NOT q.ends) + 1 AS chain FROM {PROCEDURES} p")
def procedure_chains(spark, d):
    return linker.chains(PROCEDURES.df(spark)).select("program", "idx", "chain")


CALL_SIZES = Facts("call long, callee string, sizes array<long>", (1, "B", [4, 8]), (2, "B", [4, 20]), (3, "B", [4]), (4, "X", [1]))
ENTRY_SIZES = Facts("callee string, sizes array<long>", ("B", [4, 10]), ("C", []))


@query(f"""WITH m AS (SELECT c.call, c.callee, c.sizes AS s, e.sizes AS w FROM {CALL_SIZES} c JOIN {ENTRY_SIZES} e ON e.callee = c.callee)
 SELECT call, callee, 0 AS pos, len(s) AS passed, len(w) AS taken FROM m WHERE len(s) <> len(w) UNION ALL SELECT call, callee, k::INT, s[k], w[k] FROM m, generate_series(1, 9) g(k) WHERE s[k] < w[k]""")
def using_operands(spark, d):
    return linker.mismatched_operands(CALL_SIZES.df(spark), ENTRY_SIZES.df(spark))


# ---- flow ---------------------------------------------------------------------------------------------------------

FLOW = Facts("program string, from_node long, to_node long", ("A", 0, 1), ("A", 1, 2), ("A", 2, 3), ("A", 2, 4), ("A", 3, 5), ("A", 4, 5), ("A", 5, 2), ("A", 5, 6), ("A", 7, 6), ("B", 0, 1), ("B", 1, 1))
FLOW_NODES = Facts("program string, node long", *[("A", k) for k in range(8)], ("B", 0), ("B", 1), ("B", 2))
ENTRIES = Facts("program string, node long", ("A", 0), ("B", 0))
DEFS = Facts("program string, node long, name string", ("A", 1, "X"), ("A", 3, "X"), ("A", 4, "Y"), ("A", 5, "G"))
USED = Facts("program string, node long, name string", ("A", 2, "X"), ("A", 5, "Y"), ("A", 6, "H"), ("B", 1, "Z"), ("A", 3, "X"))
NAMES = Facts("program string, name string", ("A", "X"), ("A", "Y"), ("A", "H"), ("A", "G"), ("B", "Z"))
CHILDREN = Facts("program string, name string, child string", ("A", "G", "H"))
STARTS = Facts("program string, node long", ("A", 1), ("A", 3), ("A", 6), ("B", 1))
CHECKS = Facts("program string, node long", ("A", 3), ("A", 4))
BOUNDS = Facts("program string, node long", ("A", 6))
INPUTS = Facts("program string, node long, name string", ("A", 1, "IN"))
MOVES = Facts("program string, node long, source string, name string", ("A", 3, "IN", "MID"), ("A", 5, "MID", "OUT"), ("A", 4, "CLEAN", "MID"))
MOVE_DEFS = Facts("program string, node long, name string", ("A", 1, "IN"), ("A", 3, "MID"), ("A", 4, "MID"), ("A", 5, "OUT"))
SINKS = Facts("program string, node long, name string", ("A", 6, "OUT"), ("A", 2, "IN"), ("A", 7, "OUT"))


@query(f"WITH RECURSIVE r(program, node) AS (SELECT * FROM {ENTRIES} UNION SELECT r.program, e.to_node FROM r JOIN {FLOW} e ON e.program = r.program AND e.from_node = r.node) SELECT * FROM {FLOW_NODES} EXCEPT SELECT * FROM r")
def flow_unreachable(spark, d):
    return flow.unreachable(FLOW_NODES.df(spark), FLOW.df(spark), ENTRIES.df(spark))


@query(f"""WITH RECURSIVE f AS (SELECT * FROM {FLOW}), ck AS (SELECT * FROM {CHECKS}), bd AS (SELECT * FROM {BOUNDS}),
 r(program, start, node) AS (SELECT s.program, s.node, e.to_node FROM {STARTS} s JOIN f e ON e.program = s.program AND e.from_node = s.node
  UNION SELECT r.program, r.start, e.to_node FROM r JOIN f e ON e.program = r.program AND e.from_node = r.node WHERE NOT EXISTS (SELECT 1 FROM ck WHERE ck.program = r.program AND ck.node = r.node) AND NOT EXISTS (SELECT 1 FROM bd WHERE bd.program = r.program AND bd.node = r.node)),
 g AS (SELECT r.*, EXISTS (SELECT 1 FROM ck WHERE ck.program = r.program AND ck.node = r.node) AS c, EXISTS (SELECT 1 FROM bd WHERE bd.program = r.program AND bd.node = r.node) OR NOT EXISTS (SELECT 1 FROM f WHERE f.program = r.program AND f.from_node = r.node) AS b FROM r)
 SELECT s.program, s.node, coalesce(bool_or(c), false) AS some_path, coalesce(NOT bool_or(b AND NOT c), false) AS every_path FROM {STARTS} s LEFT JOIN g ON g.program = s.program AND g.start = s.node GROUP BY 1, 2""")
def flow_checked_after(spark, d):
    return flow.searched(FLOW.df(spark), STARTS.df(spark), CHECKS.df(spark), BOUNDS.df(spark))


@query(f"""WITH RECURSIVE r(program, start, node, hops) AS (SELECT s.program, s.node, e.to_node, 1 FROM {STARTS} s JOIN {FLOW} e ON e.program = s.program AND e.from_node = s.node
  UNION SELECT r.program, r.start, e.to_node, hops + 1 FROM r JOIN {FLOW} e ON e.program = r.program AND e.from_node = r.node WHERE hops < 9)
 SELECT program, start, min(node) AS node, hops FROM r WHERE (program, node) IN (SELECT (program, node) FROM {CHECKS}) AND node <> start AND hops = (SELECT min(q.hops) FROM r q WHERE q.program = r.program AND q.start = r.start AND q.node <> q.start AND (q.program, q.node) IN (SELECT (program, node) FROM {CHECKS})) GROUP BY program, start, hops""")
def flow_first_check(spark, d):
    return flow.first_met(FLOW.df(spark), STARTS.df(spark), CHECKS.df(spark))


REACHING = f"""WITH RECURSIVE f AS (SELECT * FROM {FLOW}), full_defs AS (SELECT * FROM {DEFS} UNION SELECT d.program, d.node, c.child FROM {DEFS} d JOIN {CHILDREN} c ON c.program = d.program AND c.name = d.name),
 r(program, node, name, def_node) AS (SELECT x.program, e.to_node, x.name, x.def_node FROM (SELECT program, node, name, node AS def_node FROM full_defs UNION ALL SELECT n.program, 0, n.name, NULL FROM {NAMES} n) x JOIN f e ON e.program = x.program AND e.from_node = x.node
  UNION SELECT r.program, e.to_node, r.name, r.def_node FROM r JOIN f e ON e.program = r.program AND e.from_node = r.node WHERE NOT EXISTS (SELECT 1 FROM full_defs k WHERE k.program = r.program AND k.node = r.node AND k.name = r.name))"""


@query(f"{REACHING} SELECT * FROM r")
def reaching_definitions(spark, d):
    return flow.reaching_definitions(FLOW.df(spark), DEFS.df(spark), ENTRIES.df(spark), NAMES.df(spark), CHILDREN.df(spark))


@query(f"{REACHING} SELECT DISTINCT u.* FROM {USED} u JOIN r ON r.program = u.program AND r.node = u.node AND r.name = u.name AND r.def_node IS NULL")
def uninitialised_uses(spark, d):
    return flow.uninitialised(reaching_definitions(spark, d), USED.df(spark))


@query(f"""WITH RECURSIVE f AS (SELECT * FROM {FLOW}), r(program, node, name) AS (SELECT u.program, e.from_node, u.name FROM {USED} u JOIN f e ON e.program = u.program AND e.to_node = u.node
  UNION SELECT r.program, e.from_node, r.name FROM r JOIN f e ON e.program = r.program AND e.to_node = r.node WHERE NOT EXISTS (SELECT 1 FROM {DEFS} k WHERE k.program = r.program AND k.node = r.node AND k.name = r.name AND NOT EXISTS (SELECT 1 FROM {USED} u WHERE u.program = k.program AND u.node = k.node AND u.name = k.name))) SELECT * FROM r""")
def live_names(spark, d):
    return flow.liveness(FLOW.df(spark), DEFS.df(spark), USED.df(spark))


def taint(spark):
    return flow.tainted(FLOW.df(spark), INPUTS.df(spark), MOVES.df(spark), MOVE_DEFS.df(spark))


@query(f"""WITH RECURSIVE f AS (SELECT * FROM {FLOW}), dk AS (SELECT * FROM {MOVE_DEFS}), m AS (SELECT * FROM {MOVES}),
 r(program, node, name, via) AS (SELECT s.program, e.to_node, s.name, s.node FROM {INPUTS} s JOIN f e ON e.program = s.program AND e.from_node = s.node
  UNION SELECT x.program, e.to_node, x.name, x.via FROM (
    SELECT r.program, r.node, r.name, r.via FROM r WHERE NOT EXISTS (SELECT 1 FROM dk WHERE dk.program = r.program AND dk.node = r.node AND dk.name = r.name)
    UNION ALL SELECT m.program, m.node, m.name, m.node FROM r JOIN m ON m.program = r.program AND m.node = r.node AND m.source = r.name) x JOIN f e ON e.program = x.program AND e.from_node = x.node) SELECT * FROM r""")
def tainted_names(spark, d):
    return taint(spark)


@query("SELECT * FROM (VALUES ('A', 2::BIGINT, 'IN', '1>2'), ('A', 6, 'OUT', '1>3>5>6')) v(program, node, name, path)")
def taint_paths(spark, d):
    found = flow.taint_steps(taint(spark), MOVES.df(spark), INPUTS.df(spark), SINKS.df(spark))
    return found.select("program", "node", "name", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


# ---- layouts ------------------------------------------------------------------------------------------------------

ITEMS = Facts("program string, idx int, level int, name string, bytes long, occurs int, redefines string", ("A", 1, 1, "REC", None, None, None), ("A", 2, 5, "KEY", None, None, None), ("A", 3, 10, "K1", 4, None, None), ("A", 4, 10, "K2", 2, 3, None), ("A", 5, 5, "BODY", 20, None, None), ("A", 6, 5, "ALT", None, None, "BODY"), ("A", 7, 10, "A1", 5, None, None), ("A", 8, 88, "FLAG", None, None, None), ("A", 9, 5, "TAIL", 3, 2, None), ("A", 10, 77, "ONE", 7, None, None), ("A", 11, 1, "NEXT", 9, None, None))


@query("SELECT * FROM (VALUES ('A', 1, 'REC', 0::BIGINT, 36::BIGINT, 36::BIGINT), ('A', 2, 'KEY', 0, 10, 10), ('A', 3, 'K1', 0, 4, 4), ('A', 4, 'K2', 4, 2, 6), ('A', 5, 'BODY', 10, 20, 20), ('A', 6, 'ALT', 10, 5, 5), ('A', 7, 'A1', 10, 5, 5), ('A', 9, 'TAIL', 30, 3, 6), ('A', 10, 'ONE', 0, 7, 7), ('A', 11, 'NEXT', 0, 9, 9)) v(program, idx, name, \"offset\", own, span)")
def record_layout(spark, d):
    return layout.offsets(ITEMS.df(spark))


# ---- views of the graph -------------------------------------------------------------------------------------------

TREE = Facts("from_id string, to_id string, kind string, seq int", ("J", "S1", "STEP", 1), ("J", "S2", "STEP", 2), ("S1", "P", "EXECUTION", 1), ("P", "A", "PERFORM", 2), ("P", "B", "GOTO", 1), ("P", "C", "PERFORM", 0), ("A", "P", "PERFORM", 1), ("B", "A", "PERFORM", 1))


@query("SELECT * FROM (VALUES ('1', 'J', 0, NULL, false), ('1.1', 'S1', 1, 'STEP', false), ('1.2', 'S2', 1, 'STEP', false), ('1.1.1', 'P', 2, 'EXECUTION', false), ('1.1.1.1', 'B', 3, 'GOTO', false), ('1.1.1.2', 'A', 3, 'PERFORM', false), ('1.1.1.3', 'C', 3, 'PERFORM', false), ('1.1.1.2.1', 'P', 4, 'PERFORM', true)) v(path, id, depth, via, repeats)")
def execution_tree(spark, d):
    start = spark.createDataFrame([("J",)], "id string")
    return graph.execution_tree(TREE.df(spark), start, 8).withColumn("path", F.array_join(F.col("path").cast("array<string>"), "."))


VIEW_NODES = Facts("id string, kind string, label string", ("J", "JOB", "Night"), ("T", "TRANSACTION", "TR01"), ("P", "PROGRAM", "ACCT"), ("L", "PROGRAM", "Lonely"), ("Q", "PROGRAM", "BILL"), ("C", "JCL", "night.jcl"), ("E", "EASYTRIEVE", "report.ezt"), ("N", "JCL", "nothing.jcl"))
VIEW_EDGES = Facts("from_id string, to_id string, kind string", ("J", "P", "EXECUTION"), ("T", "P", "START"), ("P", "Q", "CALL"), ("C", "J", "STEP"), ("C", "P", "EXECUTION"), ("N", "E", "EXECUTION"))


@query("SELECT * FROM (VALUES ('J'), ('T'), ('L')) v(id)")
def view_roots(spark, d):
    return graph.roots(VIEW_NODES.df(spark), VIEW_EDGES.df(spark), ("JOB", "TRANSACTION"))


@query("SELECT * FROM (VALUES ('J', 'JOB'), ('T', 'TRANSACTION'), ('P', 'PROGRAM'), ('L', 'PROGRAM'), ('Q', 'PROGRAM'), ('C', 'JOB'), ('E', 'PROGRAM'), ('N', 'JCL')) v(id, kind)")
def view_kinds(spark, d):
    return graph.retyped(VIEW_NODES.df(spark), VIEW_EDGES.df(spark))[0].select("id", "kind")


@query(f"SELECT CASE WHEN from_id = 'P' THEN 'out' ELSE 'in' END AS direction, kind, CASE WHEN from_id = 'P' THEN to_id ELSE from_id END AS id, (SELECT label FROM {VIEW_NODES} n WHERE n.id = CASE WHEN e.from_id = 'P' THEN e.to_id ELSE e.from_id END) AS label FROM {VIEW_EDGES} e WHERE 'P' IN (from_id, to_id)")
def node_detail(spark, d):
    return graph.detail(VIEW_NODES.df(spark), VIEW_EDGES.df(spark), "P")


@query(f"SELECT k AS kind, (SELECT count(*) FROM {VIEW_NODES} n WHERE n.kind = k) AS n FROM (VALUES ('JOB'), ('PROGRAM'), ('TABLE')) v(k)")
def view_kind_totals(spark, d):
    return graph.kind_totals(VIEW_NODES.df(spark), spark.createDataFrame([("JOB",), ("PROGRAM",), ("TABLE",)], "kind string"))


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_name), '12') AND c_nationkey IN (1, 2, 3)")
def view_search(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey AS id", "c_name AS label", "cast(c_nationkey AS string) AS kind")
    found = graph.found_by_label(rows, " 12 ")
    return graph.visible(rows, found, ["1", "2", "3"]).select(F.col("id").alias("c_custkey"))


MERGED = Facts("from_id string, to_id string, kind string, resolution string, line long, arrival long, access string, launchers array<string>", ("S", "D", "X", "R", 5, 1, "READ", ["A"]), ("S", "D", "X", "R", 3, 2, "WRITE", ["B", "A"]), ("S", "E", "X", "R", 4, 3, "DELETE", None), ("S", "E", "X", "R", 4, 4, "READ", None), ("S", "F", "X", "R", None, 5, None, ["C"]), ("S", "F", "X", "R", 1, 6, "UPDATE", ["B"]), ("S", "G", "X", "R", 1, 7, "UPDATE", None), ("S", "G", "X", "R", 1, 8, "DELETE", None))


@query("SELECT * FROM (VALUES ('D', 5::BIGINT, 'UPDATE', 'A,B'), ('E', 4, 'DELETE', ''), ('F', NULL, 'UPDATE', 'C,B'), ('G', 1, 'UPDATE', '')) v(to_id, line, access, launchers)")
def merged_attributes(spark, d):
    return graph.merged_edges(MERGED.df(spark)).select("to_id", "line", "access", F.array_join(F.coalesce("launchers", F.array().cast("array<string>")), ",").alias("launchers"))


# ---- findings and rules -------------------------------------------------------------------------------------------

RULES = Facts("rule_id string, name string, description string, category string, enabled boolean, severity string, commands array<string>, has_fix boolean, targets array<string>", ("R1", "first", "about GO TO", "COBOL", True, "HIGH", ["LINT", "FIX"], True, ["COBOL"]), ("R2", "second", "about SQL", "Db2", True, "LOW", ["LINT"], False, ["COBOL", "SQL_SCRIPT"]), ("R10", "tenth", "about jobs", "JCL", False, "MEDIUM", ["LINT", "FIX"], False, ["JCL"]))
OVERRIDES = Facts("rule_id string, enabled boolean, severity string", ("R10", True, None), ("R2", None, "ADVISORY"))
FOUND = Facts("rule_id string, level string, file string, line long, message string, pos long", ("R1", "error", "a.cbl", 5, "m1", 1), ("R2", "note", "b.sql", 6, "m2", 2), ("R1", "error", "b.sql", 6, "m3", 3), ("R1", "error", "a.cbl", 5, "m4", 4), ("X9", "warning", "copy/c.cpy", 1, "m5", 5), ("R10", "warning", "j.jcl", 2, "m6", 6))
SOURCES = Facts("path string, kind string", ("a.cbl", "COBOL"), ("b.sql", "SQL_SCRIPT"), ("copy/c.cpy", "COPYBOOK"), ("j.jcl", "JCL"), ("Sub\\X.cbl", "COBOL"))


@query(f"SELECT r.rule_id, coalesce(o.enabled, r.enabled) AS enabled, coalesce(o.severity, r.severity) AS severity FROM {RULES} r LEFT JOIN {OVERRIDES} o ON o.rule_id = r.rule_id")
def rule_overrides(spark, d):
    return findings.catalogue(RULES.df(spark), OVERRIDES.df(spark)).select("rule_id", "enabled", "severity")


@query(f"SELECT 'LINT' AS command, rule_id FROM {RULES} WHERE enabled UNION ALL SELECT 'FIX', rule_id FROM {RULES} WHERE enabled AND has_fix")
def rules_for_command(spark, d):
    one = lambda c: findings.for_command(RULES.df(spark), c).select(F.lit(c).alias("command"), "rule_id")
    return one("LINT").union(one("FIX"))


@query("SELECT * FROM (VALUES ('m1'), ('m2'), ('m4'), ('m5'), ('m6')) v(message)")
def findings_on_target(spark, d):
    return findings.on_target(FOUND.df(spark), SOURCES.df(spark), RULES.df(spark)).select("message")


@query(f"SELECT f.message, r.name, coalesce(r.severity, 'MEDIUM') AS severity FROM {FOUND} f LEFT JOIN {RULES} r ON r.rule_id = f.rule_id")
def findings_with_rules(spark, d):
    return findings.with_rules(FOUND.df(spark), RULES.df(spark)).select("message", "name", "severity")


@query(f"SELECT f.message, concat_ws('|', file, line, rule_id, nullif((SELECT count(*) FROM {FOUND} g WHERE g.file = f.file AND g.line = f.line AND g.rule_id = f.rule_id AND g.pos < f.pos), 0)) AS identity FROM {FOUND} f")
def finding_identities(spark, d):
    return findings.numbered(FOUND.df(spark), "pos").select("message", "identity")


@query(f"SELECT f.message FROM {FOUND} f LEFT JOIN {RULES} r ON r.rule_id = f.rule_id WHERE coalesce(r.severity, 'MEDIUM') IN ('HIGH', 'MEDIUM') AND contains(lower(f.rule_id || ' ' || file || ' ' || message), 'cbl')")
def findings_shown(spark, d):
    return findings.shown(findings.with_rules(FOUND.df(spark), RULES.df(spark)), "MEDIUM", ["HIGH", "MEDIUM", "LOW"], "CBL").select("message")


@query(f"SELECT (SELECT count(*) FROM {FOUND} f LEFT JOIN {RULES} r ON r.rule_id = f.rule_id WHERE coalesce(r.severity, 'MEDIUM') = 'LOW') AS hidden, 2 AS exit_code")
def findings_hidden(spark, d):
    rows = findings.with_rules(FOUND.df(spark), RULES.df(spark))
    return findings.hidden(rows, "MEDIUM").join(F.broadcast(findings.exit_code(rows)))  # one row each


@query("SELECT * FROM (VALUES (1, 'R1'), (2, 'R1'), (3, 'R1'), (4, 'R2'), (5, 'R10'), (6, 'X9')) v(place, rule_id)")
def findings_by_rule(spark, d):
    from pyspark.sql import Window

    return FOUND.df(spark).select(F.row_number().over(Window.orderBy(*findings.by_rule("file", "line", "pos"))).alias("place"), "rule_id")


@query(f"SELECT category, array_to_string(list_sort(list(rule_id)), ',') AS rules FROM {RULES} GROUP BY category")
def rules_by_category(spark, d):
    return findings.by_category(RULES.df(spark)).withColumn("rules", F.array_join("rules", ","))


@query(f"SELECT file, count(*) AS n FROM {FOUND} WHERE rule_id IN ('R1', 'X9') GROUP BY file")
def findings_per_file(spark, d):
    return findings.per_file(FOUND.df(spark), ["R1", "X9"])


@query("SELECT * FROM (VALUES ('m1'), ('m4'), ('m5')) v(message)")
def findings_in_scope(spark, d):
    files = spark.createDataFrame([("a.cbl",)], "file string")
    return findings.in_scope(FOUND.df(spark), files, spark.createDataFrame([("a.cbl", "copy/c.cpy"), ("j.jcl", "b.sql")], "file string, member string")).select("message")


@query("SELECT * FROM (VALUES ('b.sql'), ('copy/c.cpy'), ('j.jcl'), ('Sub\\X.cbl')) v(path)")
def sources_narrowed(spark, d):
    return findings.narrowed(SOURCES.df(spark), ["SUB/"]).select("path")


@query("SELECT * FROM (VALUES ('nowhere'), ('cop')) v(scope)")
def scopes_missing(spark, d):
    return findings.missing_scopes(SOURCES.df(spark), spark.createDataFrame([("COPY",), ("sub\\",), ("nowhere",), ("cop",), ("a.cbl",)], "scope string"))


@query("SELECT 'R2' AS rule_id")
def rules_matching(spark, d):
    return findings.matching(RULES.df(spark), " sql ").select("rule_id")


@query("SELECT 'save' AS origin, count(*) AS n FROM labels WHERE toxic = 1 UNION ALL SELECT 'lint', count(*) FROM labels WHERE quality = 0")
def findings_merged(spark, d):
    rows = spark.read.parquet(f"{d}/labels.parquet")
    return findings.merged(save=rows.filter("toxic = 1"), lint=rows.filter("quality = 0")).groupBy("origin").agg(F.count("*").alias("n"))
