"""The rows that the queries of ``fixtures`` give, read through by hand against their sources and then kept."""

from punchdeck.plans.facts import Facts

ROWS = {
    "jcl_rules": Facts(
        "rule_id string, level string, file string, line int, message string",
        ('R032', 'warning', 'night.jcl', 3, 'new data set stays after an abend: PROD.A'),
        ('R046', 'warning', 'night.jcl', 6, 'last step is skipped when all goes well: S2'),
        ('R047', 'error', 'night.jcl', 6, 'no earlier step is called S9'),
        ('R053', 'warning', 'night.jcl', 1, 'operator parameter left on JOB NIGHT'),
        ('R063', 'warning', 'night.jcl', 5, 'deletion fails where the data set does not exist: PROD.OLD'),
        ('R067', 'error', 'night.jcl', 7, 'DISP is left out, so a new data set is asked for: PROD.IN'),
    ),
    "jcl_statements": Facts(
        "file string, line int, kind string, name string, parameters string, instream string",
        ('night.jcl', 1, 'JOB', 'NIGHT', '{"RESTART":"S2"}', ''),
        ('night.jcl', 2, 'EXEC', 'S1', '{"PGM":"IEFBR14"}', ''),
        ('night.jcl', 3, 'DD', 'OUT', '{"DSN":"PROD.A","DISP":"(NEW,CATLG)","SPACE":"(TRK,1)"}', ''),
        ('night.jcl', 5, 'DD', 'OLD', '{"DSN":"PROD.OLD","DISP":"(OLD,DELETE)"}', ''),
        ('night.jcl', 6, 'EXEC', 'S2', '{"PGM":"SORT","COND":"(0,LE,S9)"}', ''),
        ('night.jcl', 7, 'DD', 'SORTIN', '{"DSN":"PROD.IN"}', ''),
        ('night.jcl', 8, 'DD', 'SYSIN', '{}', '  SORT FIELDS=COPY'),
    ),
    "sql_rules": Facts(
        "rule_id string, level string, file string, line int, message string",
        ('R054', 'error', 'a.sql', 1, 'all rows are written'),
        ('R080', 'error', 'a.sql', 2, 'tables with nothing to join them'),
        ('S001', 'warning', 'a.sql', 0, 'SELECT * takes columns that are added later'),
    ),
    "ims_rules": Facts(
        "rule_id string, level string, file string, line int, message string",
        ('R090', 'error', 'p1.psb', 3, 'segment is not in its data base under that parent: NONE'),
    ),
    "bms_fields": Facts(
        "file string, line int, mapset string, map string, field string, row int, col int, length int, attributes string",
        ('m.bms', 3, 'MS1', 'M1', 'F1', 1, 2, 5, '(PROT)'),
    ),
    "picture_types": Facts(
        "picture string, category string, signed boolean, int_digits int, frac_digits int, positions int",
        ('S9(5)V99', 'NUMERIC', True, 5, 2, 7),
        ('X(10)', 'ALPHANUMERIC', False, 0, 0, 10),
        ('ZZ9.99-', 'NUMERIC_EDITED', True, 3, 2, 7),
    ),
    "cards_idcams": Facts(
        "step_no long, what string, name string, access string",
        (1, 'dd', 'IN1', 'READ'),
        (1, 'set', 'PROD.KSDS', 'CREATE'),
        (1, 'set', 'PROD.OLD1', 'DELETE'),
        (1, 'set', 'PROD.OLD2', 'DELETE'),
        (1, 'set', 'PROD.OUT', 'WRITE'),
        (1, 'set', 'PROD.X', 'UPDATE'),
        (1, 'set', 'PROD.Y', 'CREATE'),
    ),
    "cards_roles": Facts(
        "step_no long, dd string, access string",
        (1, 'IN1', 'READ'),
        (1, 'SYSIN', 'READ'),
        (2, 'O1', 'WRITE'),
        (2, 'O2', 'UPDATE'),
        (2, 'SORTIN', 'READ'),
        (2, 'SORTJNF1', 'READ'),
        (2, 'SORTOUT', 'WRITE'),
        (2, 'SYSIN', 'READ'),
        (3, 'CTL1CNTL', 'READ'),
        (3, 'T1', 'READ'),
        (3, 'T2', 'WRITE'),
        (3, 'T3', 'WRITE'),
        (3, 'TOOLIN', 'READ'),
        (4, 'SYSIN', 'READ'),
        (5, 'SYSTSIN', 'READ'),
        (6, 'SYSIN', 'READ'),
        (7, 'GONE', 'DELETE'),
        (7, 'NEW', 'CREATE'),
        (8, 'SYSIN', 'READ'),
        (8, 'SYSPRINT', 'WRITE'),
    ),
    "cards_db2": Facts(
        "step_no long, name string, access string",
        (4, 'DB.TS1', 'READ'),
        (4, 'OWN.T1', 'WRITE'),
    ),
    "cards_runs": Facts(
        "step_no long, program string, plan string, parm string, library string, launcher string",
        (5, 'ACCT', 'ACCTPLAN', None, 'PROD.LOAD', 'DSN'),
        (5, 'TOOL', None, 'X=1', 'PROD.LOAD', 'TSO'),
    ),
    "cards_binds": Facts(
        "step_no long, kind string, name string, members string, options string",
        (5, 'PACKAGE', 'COLL', 'ACCT+BILL', 'ISOLATION(CS)'),
    ),
    "cards_tso_uses": Facts(
        "step_no long, name string, access string",
        (5, 'PROD.GONE', 'DELETE'),
        (5, 'PROD.NEW', 'CREATE'),
    ),
    "cards_csd": Facts(
        "step_no long, type string, name string, attributes string",
        (6, 'PROGRAM', 'ACCT', 'GROUP=G1'),
        (6, 'TRANSACTION', 'TR01', 'GROUP=G1,PROGRAM=ACCT'),
    ),
    "cards_sql": Facts(
        "step_no long, n int, text string",
        (8, 0, "SELECT 'A;B' FROM T1"),
        (8, 1, 'DELETE FROM T2 WHERE A = 1'),
    ),
    "utility_rules": Facts(
        "rule_id string, level string, file string, line int, message string",
        ('R064', 'error', 'util.jcl', 10, 'DDs that the utility opens are missing: SYSOUT'),
        ('R064', 'error', 'util.jcl', 2, 'DDs that the utility opens are missing: SYSPRINT'),
        ('R064', 'error', 'util.jcl', 20, 'DDs that the utility opens are missing: TOOLMSG, DFSMSG'),
        ('R064', 'error', 'util.jcl', 24, 'DDs that the utility opens are missing: SYSPRINT'),
        ('R064', 'error', 'util.jcl', 30, 'DDs that the utility opens are missing: SYSTSPRT'),
        ('R064', 'error', 'util.jcl', 42, 'DDs that the utility opens are missing: DFHCSD, SYSPRINT'),
        ('R068', 'error', 'util.jcl', 11, 'input and output are the same data set: PROD.S'),
    ),
    "program_rules": Facts(
        "rule_id string, level string, file string, line int, message string",
        ('R048', 'warning', 'run.jcl', 4, 'no source of the program: NONE'),
        ('R052', 'error', 'acct.cbl', 12, 'steps without the DD IN: R.S1'),
        ('R071', 'warning', 'run.jcl', 3, 'written under DISP=SHR: OUT'),
    ),
    "sql_facts": Facts(
        "n int, kind string, tables string, cursor string, positioned string, isolation string, condition string, action string",
        (0, 'SELECT', 'T', None, None, None, None, None),
        (1, 'SELECT_INTO', 'T1+S.T2+T3+T4', None, None, None, None, None),
        (10, 'DECLARE_TABLE', '', None, None, None, None, None),
        (11, 'VALUES_INTO', '', None, None, None, None, None),
        (12, 'RELEASE_SAVEPOINT', '', None, None, None, None, None),
        (13, 'SELECT', 'D+UR', None, None, None, None, None),
        (14, 'MERGE', 'T+S', None, None, None, None, None),
        (15, 'LOCK_TABLE', 'T', None, None, None, None, None),
        (16, 'OTHER', '', None, None, None, None, None),
        (2, 'DECLARE_CURSOR', 'T', 'C1', None, 'UR', None, None),
        (3, 'FETCH', '', 'C1', None, None, None, None),
        (4, 'UPDATE', 'T', None, 'C1', None, None, None),
        (5, 'WHENEVER', '', None, None, None, 'SQLERROR', 'GO TO ERR-EXIT'),
        (6, 'WHENEVER', '', None, None, None, 'NOT FOUND', 'CONTINUE'),
        (7, 'SET', '', None, None, None, None, None),
        (8, 'EXECUTE_IMMEDIATE', '', None, None, None, None, None),
        (9, 'EXECUTE', '', None, None, None, None, None),
    ),
    "sql_lists": Facts(
        "n int, pos int, item string, plain boolean",
        (1, 0, 'A', True),
        (1, 1, 'F(B, G(1, 2))', False),
        (1, 2, "'x,y'", False),
        (1, 3, 'T.C', True),
        (2, 0, 'ONE', True),
        (3, 0, "COALESCE(A, '')", False),
        (3, 1, 'S.T.D', True),
    ),
    "area_rule": Facts(
        "path string, line int, rule_id string, col int, message string",
        ('a.cbl', 3, 'U003', 12, 'GO TO P1'),
    ),
    "statement_rule": Facts(
        "rule_id string, file string, line int, message string",
        ('U004', 'a.cbl', 2, 'no AT END'),
    ),
    "proc_steps": Facts(
        "file string, job string, place string, step string, exec_kind string, target string, parm string, cond string",
        ('weekly.jcl', 'WEEKLY', '1.1', 'C1', 'PROC', 'COPYALL', None, None),
        ('weekly.jcl', 'WEEKLY', '1.1.1', 'C1.S1', 'PGM', 'COPY', "'TEST'", None),
        ('weekly.jcl', 'WEEKLY', '1.1.2', 'C1.S2', 'PGM', 'LIST&NONE', None, '(4,LT)'),
        ('weekly.jcl', 'WEEKLY', '1.2', 'LAST', 'PGM', 'SORT', None, None),
    ),
    "proc_dds": Facts(
        "file string, step string, dd string, dsn string, disp string, referback string, missed boolean",
        ('weekly.jcl', 'C1.S1', 'IN', 'PROD.NEW', 'SHR', None, False),
        ('weekly.jcl', 'C1.S2', 'L', 'PROD.NEW', None, '*.S1.IN', False),
        ('weekly.jcl', 'C1.S2', 'MORE', 'PROD.NEW', None, '*.C1.S1.IN', False),
        ('weekly.jcl', 'LAST', 'SORTIN', 'PROD.N', None, None, False),
        ('weekly.jcl', 'LAST', 'OUT', '*.GONE', None, None, True),
    ),
    "asset_kinds": Facts(
        "path string, content_kind string, name_kind string, is_binary boolean, code_page string, readable boolean",
        ('src/acct.cbl', 'COBOL', 'COBOL', False, 'UTF-8', True),
        ('src/rec.x', 'COPYBOOK', None, False, 'UTF-8', True),
        ('src/night.cbl', 'JCL', 'COBOL', False, 'UTF-8', True),
        ('src/map.bms', 'BMS', 'BMS', False, 'UTF-8', True),
        ('db/note.x', 'SQL', None, False, 'UTF-8', True),
        ('db/set.x', None, None, False, 'UTF-8', True),
        ('ezt/a.x', 'EASYTRIEVE', None, False, 'UTF-8', True),
        ('ebc/e.x', 'COBOL', None, False, 'IBM930', True),
        ('src/bad.cbl', 'COBOL', 'COBOL', False, 'Shift_JIS', False),
        ('src/bin.cbl', None, 'COBOL', True, 'UTF-8', True),
        ('src/none.cbl', None, 'COBOL', False, 'UTF-8', False),
    ),
}

SQL = {name: f"SELECT * FROM {rows}" for name, rows in ROWS.items()}
