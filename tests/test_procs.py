from pyspark.sql import functions as F

from punchdeck.sources import jcl, procs

JOB = """//NIGHT    JOB (1)
//JOBLIB   DD DSN=PROD.LIB,DISP=SHR
// SET HLQ=PROD
//IN       PROC X=1
//A        EXEC PGM=ACCT&X
//         PEND
//C1       EXEC BACKUP,ENV=TEST,COND.S2=(4,LT),PARM='P'
//S1.IN    DD DSN=&HLQ..NEW
//         DD DSN=MORE
//EXTRA    DD DSN=*.S1.IN
//S9.GONE  DD DSN=LOST
//C2       EXEC IN,X=7
//         INCLUDE MEMBER=STEPS
//LAST     EXEC PGM=SORT
//SORTIN   DD DSN=*.C1.S1.IN
//SORTOUT  DD DSN=*.NOSUCH
//C3       EXEC MISSING
//K        DD DSN=&&T(+1)
"""
MEMBERS = [
    ("lib/backup.jcl", "//BACKUP   PROC ENV=PROD\n//S1       EXEC PGM=COPY,PARM='&ENV'\n//IN       DD DSN=&ENV..OLD(1),DISP=SHR\n//OUT      DD DSN=&UNKNOWN,DISP=SHR\n//S2       EXEC DEEP,PARM=Z\n"),
    ("lib/deep.jcl", "//D1       EXEC PGM=LIST\n//L        DD DSN=*.D0.L\n//D2       EXEC BACKUP\n"),
    ("lib/steps.jcl", "//I1       EXEC PGM=IEFBR14\n//N        DD DSN=&HLQ..N\n"),
]


def test_expansion(spark):
    job = jcl.parse(spark.createDataFrame([("night.jcl", JOB)], "path string, text string"))
    members = jcl.parse(spark.createDataFrame(MEMBERS, "path string, text string"))
    steps, dds = procs.expanded(procs.included(job, members), members)
    got = [(r["step"], r["exec_kind"], r["target"], r["parameters"].get("PARM"), r["parameters"].get("COND")) for r in steps.orderBy("at").collect()]
    assert got == [
        ("C1", "PROC", "BACKUP", "'P'", None), ("C1.S1", "PGM", "COPY", "'P'", None), ("C1.S2", "PROC", "DEEP", None, "(4,LT)"), ("C1.S2.D1", "PGM", "LIST", None, "(4,LT)"),
        ("C1.S2.D2", "PROC", "BACKUP", None, "(4,LT)"), ("C2", "PROC", "IN", None, None), ("C2.A", "PGM", "ACCT7", None, None), ("I1", "PGM", "IEFBR14", None, None),
        ("LAST", "PGM", "SORT", None, None), ("C3", "PROC", "MISSING", None, None),
    ]
    found = procs.referbacks(steps, dds)
    rows = {(r["step"], r["dd"], r["part"]): (r["dsn"], r["referback"], r["missed"], r["parameters"].get("DISP")) for r in found.collect()}
    assert rows == {
        (None, "JOBLIB", 0): ("PROD.LIB", None, False, "SHR"), ("C1.S1", "IN", 0): ("PROD.NEW", None, False, "SHR"), ("C1.S1", "IN", 1): ("MORE", None, False, None),
        ("C1.S1", "OUT", 0): ("&UNKNOWN", None, False, "SHR"), ("C1.S1", "EXTRA", 0): ("PROD.NEW", "*.S1.IN", False, None), ("C1", "S9.GONE", 0): ("LOST", None, False, None),
        ("C1.S2.D1", "L", 0): ("*.D0.L", None, True, None), ("I1", "N", 0): ("PROD.N", None, False, None), ("LAST", "SORTIN", 0): ("PROD.NEW", "*.C1.S1.IN", False, None),
        ("LAST", "SORTOUT", 0): ("*.NOSUCH", None, True, None), ("C3", "K", 0): ("&&T(+1)", None, False, None),
    }


def test_symbols(spark):
    scope = F.expr("array(named_struct('k', 'A', 'v', 'x&B'), named_struct('k', 'B', 'v', '$1'))")
    rows = spark.createDataFrame([("&A..&B",), ("&&A",), ("&A(1:2)",), ("&ABCDEFGHI",), ("&A&B.C",), ("&",), (None,), ("&NO.X",)], "t string")
    assert [r[0] for r in rows.select(procs.substituted(F.col("t"), scope)).collect()] == ["x&B.$1", "&&A", "&A(1:2)", "&ABCDEFGHI", "x&B$1C", "&", None, "&NO.X"]


def test_empty(spark):
    none = jcl.parse(spark.createDataFrame([], "path string, text string"))
    steps, dds = procs.expanded(procs.included(none, none), none)
    assert steps.count() == 0 and procs.referbacks(steps, dds).count() == 0


def test_job_level_dds(spark):
    text = "//J1 JOB (1)\n//S1 EXEC PGM=A\n//D DD DSN=X\n//J2 JOB (1)\n//JOBLIB DD DSN=L\n//S1 EXEC PGM=B\n//E DD DSN=Y\n"
    _, _, dds = jcl.facts(jcl.parse(spark.createDataFrame([("two.jcl", text)], "path string, text string")))
    assert {(r["job"], r["step_no"], r["step"], r["dd"]) for r in dds.collect()} == {("J1", 1, "S1", "D"), ("J2", 0, None, "JOBLIB"), ("J2", 2, "S1", "E")}
