"""Byte offsets and splices in several code pages."""

from punchdeck.sources import edits

TEXT = "IDENT 漢字 A\n\n ｱｲ x\nend"
ROWS = [("u", "utf-8"), ("s", "shift_jis"), ("w", "utf-16-le")]


def test_offsets(spark):
    rows = edits.lines(spark.createDataFrame([(s, TEXT, c) for s, c in ROWS], "source string, text string, code_page string"))
    places = [(s, line, col) for s, _ in ROWS for line, text in enumerate(TEXT.split("\n"), 1) for col in range(1, len(text) + 2)] + [("u", 9, 1)]
    found = {(r.source, r.line, r.col): r.offset for r in edits.byte_offsets(spark.createDataFrame(places, "source string, line int, col int"), rows).collect()}
    for s, code in ROWS:
        for _, line, col in (p for p in places if p[0] == s and p[1] < 9):
            want = len(("\n".join(TEXT.split("\n")[: line - 1]) + ("\n" if line > 1 else "") + TEXT.split("\n")[line - 1][: col - 1]).encode(code))
            assert found[s, line, col] == want
    assert found["u", 9, 1] is None
    back = edits.columns_of_bytes(spark.createDataFrame([("u", 1, 1), ("u", 1, 7), ("u", 1, 9), ("u", 1, 10), ("s", 1, 9), ("s", 3, 3)], "source string, line int, byte_col int"), rows)
    assert {(r.source, r.line, r.byte_col): r.col for r in back.collect()} == {("u", 1, 1): 1, ("u", 1, 7): 7, ("u", 1, 9): 7, ("u", 1, 10): 8, ("s", 1, 9): 8, ("s", 3, 3): 3}


def test_splices(spark):
    crlf = TEXT.replace("\n", "\r\n")
    sources = [(s, t.encode(c), c, t) for s, c, t in [*((s, c, TEXT) for s, c in ROWS), ("crlf", "shift_jis", crlf), ("none", "utf-8", TEXT), ("over", "utf-8", TEXT), ("page", "shift_jis", TEXT), ("out", "utf-8", TEXT)]]
    rows = spark.createDataFrame(sources, "source string, content binary, code_page string, text string")
    change = [(1, 7, 1, 9, "仮名"), (3, 2, 3, 2, "a\nb"), (4, 4, 4, 4, "more\n"), (2, 1, 2, 1, "-")]
    asked = [(s, *e) for s in ("u", "s", "w", "crlf") for e in change] + [("over", 1, 1, 1, 4, "x"), ("over", 1, 3, 1, 5, "y"), ("page", 1, 1, 1, 2, "ü"), ("out", 7, 1, 7, 1, "x")]
    placed = edits.placed(spark.createDataFrame(asked, "source string, line int, col int, end_line int, end_col int, replacement string"), edits.lines(rows))
    found = {r.source: r for r in edits.spliced(rows, placed).collect()}
    want = "IDENT 仮名 A\n-\n a\nbｱｲ x\nend\nmore\n"
    for s, code in ROWS:
        assert found[s].content.decode(code) == want
    assert found["crlf"].content.decode("shift_jis") == want.replace("\n", "\r\n") and found["none"].content == TEXT.encode()
    assert {s: found[s].refused for s in ("over", "page", "out")} == {"over": "overlap", "page": "code page", "out": "place"} and found["over"].content is None
