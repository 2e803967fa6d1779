from punchdeck.sources import cards, jcl

TEXT = """//J        JOB (1)
//S1       EXEC PGM=IEBCOPY
//IN1      DD DSN=A,DISP=SHR
//OUT1     DD DSN=B,DISP=OLD
//SYSIN    DD *
  COPY OUTDD=OUT1,
       INDD=IN1
/*
//S2       EXEC PGM=SORT
//SORTIN   DD DSN=C,DISP=OLD
//SORTOUT  DD DSN=D,DISP=(NEW,CATLG)
//WORK     DD DSN=E,DISP=(MOD,PASS)
//SYSOUT   DD SYSOUT=*
//NONE     DD DUMMY,DISP=SHR
//S3       EXEC PGM=IEFBR14
//X        DD DSN=F,DISP=(NEW,CATLG)
//S4       EXEC PGM=DFSRRC00,PARM='BMP,PROG1,PSB1'
//S5       EXEC PGM=DFSRRC00,PARM=(DLI,PROG2,&PSB)
//S6       EXEC PGM=DFSRRC00,PARM=(DLI,&PROG)
"""


def test_cards(spark):
    _, steps, dds = jcl.facts(jcl.parse(spark.createDataFrame([("a.jcl", TEXT)], "path string, text string")))
    got = {(r.step_no, r.dd): r.access for r in cards.dd_roles(steps, dds).collect()}
    assert got == {(1, "IN1"): "READ", (1, "OUT1"): "WRITE", (2, "SORTIN"): "READ", (2, "SORTOUT"): "WRITE", (2, "WORK"): "WRITE", (2, "SYSOUT"): "WRITE", (1, "SYSIN"): "READ", (3, "X"): "CREATE"}
    assert {tuple(r) for r in cards.ims_runs(steps).select("step_no", "region", "program", "psb").collect()} == {(4, "BMP", "PROG1", "PSB1"), (5, "DLI", "PROG2", "PROG2")}
