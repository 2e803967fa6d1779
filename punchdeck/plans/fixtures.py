"""Queries over a few sources of our own, for the parsers and rules that the driver's tables have no rows for."""

from __future__ import annotations

from pyspark.sql import functions as F

from punchdeck.functions import columns as C
from punchdeck.functions.picture import picture
from punchdeck.operators import lines, rules
from punchdeck.sources import cards, findings, folder, jcl, macros, procs

JCL = """//NIGHT    JOB (1),'X',RESTART=S2
//S1       EXEC PGM=IEFBR14
//OUT      DD DSN=PROD.A,DISP=(NEW,CATLG),
//            SPACE=(TRK,1)
//OLD      DD DSN=PROD.OLD,DISP=(OLD,DELETE)
//S2       EXEC PGM=SORT,COND=(0,LE,S9)
//SORTIN   DD DSN=PROD.IN
//SYSIN    DD *
  SORT FIELDS=COPY
/*
"""
SQL = ("SELECT * FROM T WHERE A = 1", "UPDATE T SET A = 1", "SELECT A FROM T, U", "DELETE FROM T WHERE A = 2")
DBD = "         DBD NAME=D1,ACCESS=HDAM\n         SEGM NAME=ROOT,PARENT=0,BYTES=10\n"
PSB = "         PCB TYPE=DB,DBDNAME=D1\n         SENSEG NAME=ROOT,PARENT=0\n         SENSEG NAME=NONE,PARENT=ROOT\n"
BMS = "MS1      DFHMSD TYPE=MAP\nM1       DFHMDI SIZE=(24,80)\nF1       DFHMDF POS=(1,2),LENGTH=5,\n               ATTRB=(PROT)\n"


def source(spark, path, text):
    return spark.createDataFrame([(path, text)], "path string, text string")


def jcl_rules(spark, d):
    return findings.ordered(rules.jcl_rules(*jcl.facts(jcl.parse(source(spark, "night.jcl", JCL)))))


def jcl_statements(spark, d):
    return jcl.parse(source(spark, "night.jcl", JCL)).selectExpr("file", "line", "kind", "name", "to_json(parameters) AS parameters", "array_join(instream, '|') AS instream")


def sql_rules(spark, d):
    return rules.sql_rules(spark.createDataFrame([("a.sql", k, x) for k, x in enumerate(SQL)], "file string, line int, text string"))


def ims_rules(spark, d):
    return rules.ims_rules(macros.ims_segments(macros.parse(source(spark, "d1.dbd", DBD))), macros.ims_sensegs(macros.parse(source(spark, "p1.psb", PSB))))


def bms_fields(spark, d):
    return macros.bms_fields(macros.parse(source(spark, "m.bms", BMS)))


def picture_types(spark, d):
    rows = spark.createDataFrame([("S9(5)V99",), ("X(10)",), ("ZZ9.99-",)], "picture string")
    return rows.select("picture", picture("picture").alias("x")).select("picture", "x.*")


CARDS = """//UTIL     JOB (1)
//A        EXEC PGM=IDCAMS
//SYSIN    DD *
  DEFINE CLUSTER (NAME(PROD.KSDS) -
         INDEXED)
  DELETE (PROD.OLD1, 'PROD.OLD2')
  ALTER PROD.X NEWNAME(PROD.Y)
  REPRO INFILE(IN1) OUTDATASET(PROD.OUT)
/*
//B        EXEC PGM=SORT
//SORTIN   DD DSN=PROD.S,DISP=SHR
//SORTOUT  DD DSN=PROD.S,DISP=OLD
//SYSIN    DD *
* a comment, FNAMES=NONE
  OUTFIL FNAMES=(O1,O2),
    INCLUDE=(1,1,CH,EQ,C'A')
  JOINKEYS FILE=F1,FIELDS=(1,4,A)
  JOINKEYS F2=O2,FIELDS=(1,4,A)
/*
//C        EXEC PGM=ICETOOL
//TOOLIN   DD *
  COPY FROM(T1) TO(T2,T3) USING(CTL1)
/*
//D        EXEC PGM=DSNUTILB
//SYSIN    DD *
  LOAD DATA -- INTO TABLE NOT.THIS
    INTO TABLE OWN.T1
  RUNSTATS TABLESPACE DB.TS1 TABLE(ALL)
/*
//E        EXEC PGM=IKJEFT01
//SYSTSIN  DD *
  RUN PROGRAM(NODSN)
  DSN SYSTEM(DB2P)
  RUN PROGRAM(ACCT) PLAN(ACCTPLAN) -
      LIB('PROD.LOAD')
  BIND PACKAGE(COLL) MEMBER(ACCT,BILL) ISOLATION(CS)
  END
  CALL 'PROD.LOAD(TOOL)' 'X=1'
  ALLOCATE DD(OUT) DA('PROD.NEW') NEW
  DELETE 'PROD.GONE'
/*
//F        EXEC PGM=DFHCSDUP
//SYSIN    DD *
DEFINE TRANSACTION(tr01) GROUP(G1)
       PROGRAM(ACCT)
LIST ALL
DEF PROGRAM(ACCT) GROUP(G1)
/*
//G        EXEC PGM=IEFBR14
//NEW      DD DSN=PROD.N,DISP=(NEW,CATLG)
//GONE     DD DSN=PROD.G,DISP=(OLD,DELETE)
//H        EXEC PGM=DSNTEP2
//SYSPRINT DD SYSOUT=*
//SYSIN    DD *
  SELECT 'A;B' FROM T1; -- the first
  DELETE FROM T2
   WHERE A = 1;
/*
"""


def card_facts(spark):
    return jcl.facts(jcl.parse(source(spark, "util.jcl", CARDS)))[1:]


def cards_idcams(spark, d):
    sets, roles = cards.idcams_uses(*card_facts(spark))
    return sets.select("step_no", F.lit("set").alias("what"), "name", "access").union(roles.select("step_no", F.lit("dd"), "name", "access"))


def cards_roles(spark, d):
    return cards.dd_roles(*card_facts(spark)).select("step_no", "dd", "access")


def cards_db2(spark, d):
    return cards.db2_utility_uses(*card_facts(spark)).select("step_no", "name", "access")


def cards_runs(spark, d):
    return cards.tso_facts(*card_facts(spark))[0].drop("file")


def cards_binds(spark, d):
    return cards.tso_facts(*card_facts(spark))[1].select("step_no", "kind", "name", F.array_join("members", "+").alias("members"), F.array_join("options", "+").alias("options"))


def cards_tso_uses(spark, d):
    return cards.tso_facts(*card_facts(spark))[2].select("step_no", "name", "access")


def cards_csd(spark, d):
    return cards.csd_definitions(*card_facts(spark)).drop("file")


def cards_sql(spark, d):
    return cards.sql_card_statements(*card_facts(spark)).drop("file")


def utility_rules(spark, d):
    return rules.utility_rules(*card_facts(spark))


def program_rules(spark, d):
    _, steps, dds = jcl.facts(jcl.parse(source(spark, "run.jcl", "//R JOB (1)\n//S1 EXEC PGM=ACCT\n//OUT DD DSN=P.O,DISP=SHR\n//S2 EXEC PGM=NONE\n//S3 EXEC PGM=SORT\n//S4 EXEC PGM=ACCT\n//IN DD DSN=P.I,DISP=SHR\n//OUT DD DSN=P.O,DISP=OLD\n")))
    programs = spark.createDataFrame([("acct",)], "name string")
    selects = spark.createDataFrame([("ACCT", "IN", "acct.cbl", 12), ("ACCT", "OUT", "acct.cbl", 13)], "program string, dd string, path string, line int")
    return rules.program_rules(steps, dds, programs, selects, spark.createDataFrame([("ACCT", "OUT", "OUTPUT"), ("ACCT", "IN", "INPUT")], "program string, dd string, mode string"))


STATEMENTS = (
    "SELECT A FROM T WHERE X = ' INTO '", "select a INTO :B FROM T1 X, S.T2 AS Y, T3 WHERE A IN (SELECT C FROM T4)", "DECLARE C1 CURSOR FOR SELECT A FROM T WITH UR", "FETCH C1 INTO :A",
    "UPDATE T SET A = 1 WHERE CURRENT OF C1", "WHENEVER SQLERROR GOTO ERR-EXIT", "WHENEVER NOT FOUND CONTINUE", "SET :A = CURRENT DATE", "EXECUTE IMMEDIATE :S", "EXECUTE S1 USING :A", "DECLARE T TABLE (A INT)",
    "VALUES (1) INTO :A", "RELEASE TO SAVEPOINT S", "WITH UR AS (SELECT 1 FROM D) SELECT * FROM UR", "MERGE INTO T USING S ON T.A = S.A WHEN MATCHED THEN UPDATE SET B = 1", "LOCK TABLE T IN SHARE MODE", "-- only a comment",
)


def sql_facts(spark, d):
    x = F.col("text")
    rows = spark.createDataFrame(list(enumerate(STATEMENTS)), "n int, text string")
    w = C.whenever(x)
    return rows.select("n", C.statement_kind(x).alias("kind"), F.array_join(C.table_names(x), "+").alias("tables"), C.cursor_name(x).alias("cursor"), C.positioned_cursor(x).alias("positioned"), C.isolation(x).alias("isolation"), w["condition"].alias("condition"), w["action"].alias("action"))


def sql_lists(spark, d):
    rows = spark.createDataFrame([(1, "A, F(B, G(1, 2)), 'x,y', T.C"), (2, "ONE"), (3, "COALESCE(A, ''), S.T.D")], "n int, text string")
    items = rows.select("n", F.posexplode(C.top_level_items(F.col("text"))).alias("pos", "item"))
    return items.withColumn("plain", C.plain_column(F.col("item")))


def area_rule(spark, d):
    text = "000100 IDENTIFICATION DIVISION.\n000200*    GO TO IN A COMMENT\n000300     GO TO P1. GO TO P2.\n000400     MOVE A TO B.                                                   GO TO X\n"
    rows = lines.source_lines(source(spark, "a.cbl", text), "path", "text")
    return lines.line_rule(rows, "U003", r"GO TO \w+", program_area=True)


def statement_rule(spark, d):
    rows = spark.createDataFrame([("a.cbl", 1, "READ", "READ F AT END STOP RUN", "P1"), ("a.cbl", 2, "read", "READ F", "P1"), ("a.cbl", 3, "READ", "READ F", "INIT"), ("a.cbl", 4, "WRITE", "WRITE R", "P1")], "file string, line int, verb string, text string, paragraph string")
    return lines.statement_rule(rows, "U004", ["READ"], ["AT END"], "^P", "no AT END")


CALLER = """//WEEKLY   JOB (1)
// SET HLQ=PROD
//C1       EXEC COPYALL,ENV=TEST,COND.S2=(4,LT)
//S1.IN    DD DSN=&HLQ..NEW
//S2.MORE  DD DSN=*.C1.S1.IN
//         INCLUDE MEMBER=TAIL
//OUT      DD DSN=*.GONE
"""
MEMBERS = (
    ("lib/copyall.jcl", "//COPYALL  PROC ENV=PROD\n//S1       EXEC PGM=COPY,PARM='&ENV'\n//IN       DD DSN=&ENV..OLD,DISP=SHR\n//S2       EXEC PGM=LIST&NONE\n//L        DD DSN=*.S1.IN\n"),
    ("lib/tail.jcl", "//LAST     EXEC PGM=SORT\n//SORTIN   DD DSN=&HLQ..N\n"),
)


def called(spark):
    job, members = jcl.parse(source(spark, "weekly.jcl", CALLER)), jcl.parse(spark.createDataFrame(list(MEMBERS), "path string, text string"))
    return procs.expanded(procs.included(job, members), members)


def proc_steps(spark, d):
    p = F.col("parameters")
    return called(spark)[0].select("file", "job", F.array_join(F.col("at").cast("array<string>"), ".").alias("place"), "step", "exec_kind", "target", p["PARM"].alias("parm"), p["COND"].alias("cond"))


def proc_dds(spark, d):
    steps, dds = called(spark)
    return procs.referbacks(steps, dds).select("file", "step", "dd", "dsn", F.col("parameters")["DISP"].alias("disp"), "referback", "missed")


FILES = (
    ("src/acct.cbl", b"000100 IDENTIFICATION DIVISION.\n"), ("src/rec.x", b"       01  REC.\n"), ("src/night.cbl", b"//N JOB (1)\n"), ("src/map.bms", b"M1 DFHMSD TYPE=MAP\n"),
    ("db/note.x", b"-- first\nCREATE TABLE T (A INT);\n"), ("db/set.x", b"SET A\n"), ("ezt/a.x", b"FILE INF\nJOB INPUT INF\n"), ("ebc/e.x", "000100 PROGRAM-ID. E.".ljust(80).encode("cp037")),
    ("src/bad.cbl", b"000100 PROGRAM-ID. B.\n\xff\xff\n"), ("src/bin.cbl", b"A\x00B"), ("src/none.cbl", None),
)


def asset_kinds(spark, d):
    rows = folder.kind_of_content(folder.decoded(spark.createDataFrame([(p, c and bytearray(c)) for p, c in FILES], "path string, content binary")))
    return rows.select("path", "content_kind", folder.kind_of_name(F.col("path")).alias("name_kind"), F.col("binary").alias("is_binary"), "code_page", "readable")


MADE = (
    jcl_rules, jcl_statements, sql_rules, ims_rules, bms_fields, picture_types, cards_idcams, cards_roles, cards_db2, cards_runs, cards_binds, cards_tso_uses, cards_csd, cards_sql,
    utility_rules, program_rules, sql_facts, sql_lists, area_rule, statement_rule, proc_steps, proc_dds, asset_kinds,
)
QUERIES = {f.__name__: f for f in MADE}
