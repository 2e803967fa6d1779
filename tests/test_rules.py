from punchdeck.operators import rules
from punchdeck.sources import jcl, macros

JOB = """//NIGHT    JOB (1),'X',RESTART=S2,TIME=1440
//* a comment
//S1       EXEC PGM=IEFBR14
//OUT      DD DSN=PROD.TOOLONGNAME.X,DISP=(NEW,CATLG),
//            SPACE=(TRK,1)
//OLD      DD DSN=PROD.OLD,DISP=(OLD,DELETE)
//OLD      DD DSN=&&T,DISP=(NEW,DELETE)
//S2       EXEC PGM=SORT,PARM='ABC'
//SORTIN   DD DSN=&&T,DISP=(OLD,PASS)
//         DD DSN=PROD.G(+1),DISP=(NEW,CATLG,DELETE)
//SYSIN    DD *
  SORT FIELDS=COPY
/*
//S2       EXEC PGM=P2,COND=(0,LE,S9)
//IN       DD DSN=PROD.G(0),DISP=SHR
//MISS     DD DSN=PROD.IN
"""
CLEAN = """//DAY      JOB (1),'X'
//A        EXEC PGM=P1
//IN       DD DSN=PROD.IN,DISP=SHR
//B        EXEC PGM=P2,COND=(4,LT,A)
//IN       DD DSN=PROD.IN,DISP=SHR
"""


def jcl_findings(spark, text):
    stmts = jcl.parse(spark.createDataFrame([("a.jcl", text)], "path string, text string"))
    return {(r.rule_id, r.line) for r in rules.jcl_rules(*jcl.facts(stmts)).collect()}


def test_jcl_rules(spark):
    want = {("R053", 1), ("R069", 1), ("R032", 4), ("R066", 4), ("R063", 6), ("R051", 7), ("R062", 9), ("R030", 8), ("R046", 14), ("R047", 14), ("R070", 14), ("R060", 15), ("R067", 16)}
    assert jcl_findings(spark, JOB) == want


def test_jcl_clean(spark):
    assert jcl_findings(spark, CLEAN) == set()


def test_instream_and_continuation():
    rows = jcl.statements(JOB)
    assert [r["instream"] for r in rows if r["name"] == "SYSIN"] == [["  SORT FIELDS=COPY"]]
    assert next(r for r in rows if r["name"] == "OUT")["parameters"]["SPACE"] == "(TRK,1)"


def test_sql_rules(spark):
    texts = ["SELECT * FROM T WHERE A = 1", "UPDATE T SET A = 1", "SELECT A INTO :B FROM T", "INSERT INTO T VALUES (1)", "SELECT A FROM T, U", "SELECT A FROM T WHERE B NOT IN (SELECT C FROM U) ORDER BY A",
             "GRANT ALL ON T TO PUBLIC", "CREATE TABLE T (A INT)", "SELECT A FROM T WHERE B LIKE '%X'", "SELECT 1 FROM T UNION SELECT 2 FROM U", "DECLARE C CURSOR FOR SELECT A FROM T", "LOCK TABLE T IN EXCLUSIVE MODE", "SELECT A FROM T FETCH FIRST 1 ROW ONLY"]
    clean = ["SELECT A FROM T WHERE A = '%'", "DELETE FROM T WHERE A = 1", "SELECT COUNT(*) INTO :B FROM T", "INSERT INTO T (A) VALUES (1)", "SELECT A FROM T UNION ALL SELECT B FROM U", "CREATE TABLE T (A INT) IN DB.TS"]
    found = rules.sql_rules(spark.createDataFrame([("a.sql", k, x) for k, x in enumerate(texts + clean)], "file string, line int, text string")).collect()
    want = ["S001", "R054", "R056", "R059", "R080", "R082", "R083", "R084", "S002", "S007", "S004", "R079", "R081"]
    assert {(r.line, r.rule_id) for r in found} == set(enumerate(want))


def test_macros(spark):
    bms = "MS1      DFHMSD TYPE=MAP\nM1       DFHMDI SIZE=(24,80)\nF1       DFHMDF POS=(1,2),LENGTH=5,\n               ATTRB=(PROT)\n"
    rows = macros.bms_fields(macros.parse(spark.createDataFrame([("a.bms", bms)], "path string, text string"))).collect()
    assert [(r.mapset, r.map, r.field, r.row, r.col, r.length, r.attributes) for r in rows] == [("MS1", "M1", "F1", 1, 2, 5, "(PROT)")]
    dbd = "         DBD NAME=D1,ACCESS=HDAM\n         SEGM NAME=ROOT,PARENT=0,BYTES=10\n         SEGM NAME=KID,PARENT=ROOT,BYTES=4\n"
    psb = "         PCB TYPE=DB,DBDNAME=D1\n         SENSEG NAME=ROOT,PARENT=0\n         SENSEG NAME=KID,PARENT=0\n         SENSEG NAME=NONE,PARENT=ROOT\n"
    read = lambda text: macros.parse(spark.createDataFrame([("x", text)], "path string, text string"))
    assert {r.line for r in rules.ims_rules(macros.ims_segments(read(dbd)), macros.ims_sensegs(read(psb))).collect()} == {3, 4}
