"""The control flow graph of programs from statement rows, each program's made where its rows are.

``stmts`` and ``procedures`` are those of ``punchdeck.sources.cobol``. Nodes are statement numbers, ENTRY and EXIT. Nothing is
bounded by how many statements or procedures there are, and no step goes along the edges.

- A statement leads to the next one of its branch, else to what follows the statement that holds it; a body that may
  repeat leads back to its PERFORM. The last of a procedure falls through to the next procedure that has statements.
- IF, EVALUATE, SEARCH and statements with phrases (AT END ...) lead into their branches, and past them unless the
  branches are all there are (ELSE, WHEN OTHER, a phrase and its NOT) and none is empty.
- GO TO leads to its targets, with DEPENDING past them too; NEXT SENTENCE to the next sentence. ALTER, WHENEVER ... GO TO and
  HANDLE lead to the procedures that they name, besides going on.
- PERFORM of procedures leads to the first and its range leads back to what follows the PERFORM, and to the PERFORM itself
  with UNTIL; calls are not kept apart. So do the procedures of SORT and MERGE.
- STOP, GOBACK, EXIT PROGRAM and EXEC CICS RETURN and XCTL without RESP, RESP2 or NOHANDLE end the program. Other EXITs go on.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punchdeck.operators.graph import each_group
from punchdeck.operators.linker import named_procedures

ENTRY, EXIT = 0, -1


def ends_program() -> Column:
    verb = F.col("verb")
    # EXEC CICS, the command, its options
    options = F.regexp_extract_all(F.upper("text"), F.lit(r"[\p{L}\p{N}-]+"), F.lit(0))
    comes_back = F.arrays_overlap(options, F.array(*map(F.lit, ("RESP", "RESP2", "NOHANDLE"))))
    leaves = F.get(options, F.lit(2)).isin("RETURN", "XCTL") & ~comes_back
    return verb.isin("STOP", "GOBACK") | ((verb == "EXIT") & F.array_contains("words", "PROGRAM")) | ((verb == "EXEC CICS") & F.coalesce(leaves, F.lit(False)))


def repeats() -> Column:
    """A PERFORM of procedures that tests a condition."""
    return (F.col("verb") == "PERFORM") & F.col("loop").isNull() & F.array_contains("words", "UNTIL")


# A procedure's name and the section that qualifies it, in words with one blank between them.
_NAME = r"(\S+)(?: (?:OF|IN) (\S+))?"


def _pairs(text: Column, pattern: str, first: int = 1) -> Column:
    """``(name, qualifier)`` of each match."""
    names, qualifiers = (F.regexp_extract_all(text, F.lit(pattern), F.lit(first + k)) for k in (0, 1))
    return F.transform(F.arrays_zip(names.alias("name"), qualifiers.alias("qualifier")), lambda x: F.struct(x["name"].alias("name"), F.nullif(x["qualifier"], F.lit("")).alias("qualifier")))


def branch_targets(stmts: DataFrame) -> DataFrame:
    """``(program, stmt, proc, nth, name, qualifier)``: procedures that GO TO, ALTER, WHENEVER and HANDLE name."""
    line, verb = F.array_join("words", " "), F.col("verb")
    go = F.regexp_replace(F.regexp_replace(line, "^GO (TO )?", ""), " ?DEPENDING .*$", "")
    found = (
        F.when(verb == "GO", _pairs(go, _NAME)).when(verb == "ALTER", _pairs(line, rf"\bTO (?:PROCEED TO )?{_NAME}"))
        .when(verb == "EXEC SQL", _pairs(line, r"(?s)\bWHENEVER\s.*?\bGO\s*TO\s+:?([\p{L}\p{N}_-]+)()"))
        .when((verb == "EXEC CICS") & line.rlike(r"(?s)^EXEC\s+CICS\s+HANDLE\s"), _pairs(line, r"[\p{L}\p{N}]+\s*\(\s*([\p{L}\p{N}-]+)\s*\)()"))
    )
    return stmts.select("program", "stmt", "proc", F.posexplode(found).alias("nth", "x")).select("program", "stmt", "proc", "nth", "x.*")


def targets(stmts: DataFrame, procedures: DataFrame) -> DataFrame:
    """``(program, stmt, nth, idx)``: the procedures that ``branch_targets`` mean, those that are there."""
    refs = branch_targets(stmts).select("program", F.struct("stmt", "nth").alias("ref"), "proc", "name", "qualifier")
    return _resolved(refs, procedures).filter("idx is not null").select("program", "ref.*", "idx")


def performs(stmts: DataFrame) -> DataFrame:
    """``(program, stmt, proc, again, nth, end, name, qualifier)``: the ranges that PERFORM, SORT and MERGE run, a row for each end
    (``low``, and ``high`` with THRU)."""
    line = F.array_join("words", " ")
    through = rf"{_NAME}(?: (?:THRU|THROUGH) {_NAME})?"
    pattern = F.when((F.col("verb") == "PERFORM") & F.col("loop").isNull(), F.lit(f"^PERFORM {through}")).when(F.col("verb").isin("SORT", "MERGE"), F.lit(f"PROCEDURE (?:IS )?{through}"))
    rows = stmts.select("program", "stmt", "proc", repeats().alias("again"), line.alias("line"), pattern.alias("pattern")).filter("pattern is not null")
    parts = F.arrays_zip(*(F.regexp_extract_all("line", "pattern", F.lit(g)).alias(n) for g, n in enumerate(("a", "qa", "b", "qb"), 1)))
    rows = rows.select("program", "stmt", "proc", "again", F.posexplode(parts).alias("nth", "x"))
    none = lambda c: F.nullif(F.col(c), F.lit(""))
    ends = F.array(*(F.struct(F.lit(e).alias("end"), none(f"x.{n}").alias("name"), none(f"x.q{n}").alias("qualifier")) for e, n in (("low", "a"), ("high", "b"))))
    return rows.select("program", "stmt", "proc", "again", "nth", F.explode(ends).alias("e")).select("program", "stmt", "proc", "again", "nth", "e.*").filter("name is not null")


def _resolved(refs: DataFrame, procedures: DataFrame) -> DataFrame:
    """``refs(program, ref, proc, name, qualifier)`` with ``idx`` of the procedure meant; a qualifier that names no section with it is passed over."""
    here = procedures.select("program", F.col("idx").alias("proc"), "section")
    refs = refs.withColumns({"name": F.upper("name"), "qualifier": F.upper("qualifier")}).join(here, ["program", "proc"], "left").drop("proc")
    there = procedures.select("program", F.upper("name").alias("name"), F.upper("section").alias("qualifier")).distinct().withColumn("known", F.lit(True))
    refs = refs.join(there, ["program", "name", "qualifier"], "left").withColumn("qualifier", F.when(F.col("known"), F.col("qualifier"))).drop("known")
    return named_procedures(refs, procedures)


def ranges(stmts: DataFrame, procedures: DataFrame) -> DataFrame:
    """``(program, stmt, again, low, high)``: procedures that each PERFORM runs; a section runs to its last paragraph."""
    refs = performs(stmts).select("program", F.struct("stmt", "again", "nth", "end").alias("ref"), "proc", "name", "qualifier")
    at = _resolved(refs, procedures).groupBy("program", "ref.stmt", "ref.again", "ref.nth").agg(*(F.max(F.when(F.col("ref.end") == e, F.col("idx"))).alias(e) for e in ("low", "high")))
    w = Window.partitionBy("program").orderBy("idx")
    sections = procedures.withColumn("next", F.min(F.when(F.col("kind") == "SECTION", F.col("idx"))).over(w.rowsBetween(1, Window.unboundedFollowing)))
    sections = sections.withColumn("end", F.when(F.col("kind") == "SECTION", F.coalesce(F.col("next") - 1, F.max("idx").over(Window.partitionBy("program")))).otherwise(F.col("idx")))
    at = at.filter("low is not null").withColumn("to", F.when(F.col("high") >= F.col("low"), F.col("high")).otherwise(F.col("low")))
    return at.join(sections.select("program", F.col("idx").alias("to"), "end"), ["program", "to"]).select("program", "stmt", "again", "low", F.col("end").alias("high"))


#: What the rows of a program hold besides the part that they belong to.
CELLS = {"node": "long", "a": "long", "b": "long", "name": "string", "word": "string", "words": "array<string>", "at": "array<long>", "more": "array<string>"}


def rows(df: DataFrame, part: str, **columns: Column) -> DataFrame:
    given = columns | {"part": F.lit(part)}
    return df.select("program", *(given.get(c, F.lit(None)).cast(k).alias(c) for c, k in {"part": "string", **CELLS}.items()))


def parts(stmts: DataFrame, procedures: DataFrame) -> list[DataFrame]:
    """The rows of which ``Graph`` is made; what names lead to procedures is told before."""
    c = F.col
    jumps = F.array_join("words", " ").rlike(rf"^GO(?: TO)? {_NAME}$")
    at = F.array(*(x.cast("long") for x in (c("parent"), c("last"), c("sentence"), ends_program(), jumps)))
    return [
        rows(stmts, "stmt", node=c("stmt"), a=c("line"), b=c("proc"), word=c("verb"), words=c("words"), at=at, more=F.concat(F.array("loop", "branch"), "branches")),
        rows(procedures, "procedure", node=c("idx"), a=c("line"), name=c("name"), word=c("kind"), words=F.array("section", F.upper("name"), F.upper("section"))),
        rows(branch_targets(stmts), "target", node=c("stmt"), a=c("nth"), name=F.upper("name"), word=F.upper("qualifier")),
        rows(performs(stmts), "perform", node=c("stmt"), a=c("nth"), b=c("again"), name=F.upper("name"), word=F.upper("qualifier"), words=F.array("end")),
    ]


class Stmt(NamedTuple):
    stmt: int
    line: int
    proc: int
    verb: str
    words: list[str]
    parent: int
    last: int
    sentence: int
    ends: bool
    jumps: bool
    loop: str | None
    branch: str | None
    branches: list[str]


class Procedure(NamedTuple):
    idx: int
    line: int
    name: str
    kind: str
    section: str | None
    upper: str
    upper_section: str | None


class Range(NamedTuple):
    stmt: int
    again: bool
    low: int
    high: int


class Graph:
    """One program's statements and procedures, and where control goes."""

    def __init__(self, cells: dict[str, list]):
        self.part: dict[str, list[tuple]] = defaultdict(list)
        for part, *row in zip(*(cells[c] for c in ("part", *CELLS)), strict=True):
            self.part[part].append(tuple(row))
        self.stmts = {n: Stmt(n, line, proc, verb, words, *at[:3], bool(at[3]), bool(at[4]), more[0], more[1], more[2:]) for n, line, proc, _, verb, words, at, more in sorted(self.part["stmt"], key=lambda x: x[0])}
        self.procedures = {n: Procedure(n, line, name, kind, *words) for n, line, _, name, kind, words, *_ in sorted(self.part["procedure"], key=lambda x: x[0])}
        self._named: dict[str, list[Procedure]] = defaultdict(list)
        for p in self.procedures.values():
            self._named[p.upper].append(p)
        self.targets = self._targets()
        self.ranges = self._ranges()
        self.edges = self._edges()
        self.successors: dict[int, list[int]] = defaultdict(list)
        for a, b in self.edges:
            self.successors[a].append(b)

    def _meant(self, name: str, qualifier: str | None, stmt: int) -> int | None:
        """The procedure that a statement names; a qualifier that names no section with it is passed over."""
        there = self._named.get(name, [])
        at = self.procedures.get(self.stmts[stmt].proc)
        section = at.upper_section if at else None
        found = [p for p in there if qualifier is not None and p.upper_section == qualifier] or there
        return min(((p.upper_section != section, p.idx) for p in found), default=(None, None))[1]

    def _targets(self) -> list[tuple[int, int, int]]:
        """``(stmt, nth, idx)`` of GO TO, ALTER, WHENEVER and HANDLE."""
        met = ((n, nth, self._meant(name, qualifier, n)) for n, nth, _, name, qualifier, *_ in self.part["target"])
        return sorted(x for x in met if x[2] is not None)

    def _ranges(self) -> list[Range]:
        """The procedures that each PERFORM, SORT and MERGE runs; a section runs to its last paragraph."""
        ends: dict[tuple, dict[str, int | None]] = defaultdict(dict)
        for n, nth, again, name, qualifier, words, *_ in self.part["perform"]:
            ends[n, nth, bool(again)][words[0]] = self._meant(name, qualifier, n)
        sections = [p.idx for p in self.procedures.values() if p.kind == "SECTION"]
        out = []
        for (n, _, again), end in sorted(ends.items()):
            low, high = end.get("low"), end.get("high")
            if low is None:
                continue
            high = high if high is not None and high >= low else low
            if self.procedures[high].kind == "SECTION":
                high = next((i - 1 for i in sections if i > high), max(self.procedures))
            out.append(Range(n, again, low, high))
        return out

    def _follows(self, siblings: dict[int, int], s: Stmt) -> int | None:
        """The statement after one that has completed, in its procedure: from the inside out."""
        at, inner = s, True
        while True:
            if not inner and at.loop == "until":
                return at.stmt
            if at.stmt in siblings:
                return siblings[at.stmt]
            if not at.parent:
                return None
            at, inner = self.stmts[at.parent], False

    def _edges(self) -> list[tuple[int, int]]:
        stmts, firsts, inside, siblings, latest = self.stmts, {}, {}, {}, {}
        for n, s in stmts.items():
            firsts.setdefault(s.proc, n)
            if s.parent:
                inside.setdefault((s.parent, s.branch), n)
            key = (s.proc, s.parent, s.branch)
            if key in latest:
                siblings[latest[key]] = n
            latest[key] = n
        full = sorted(firsts)
        # where control comes in at a procedure or behind it: the first statement there, else EXIT
        entry = lambda idx: next((firsts[i] for i in full if i >= idx), EXIT)
        filled = Counter(n for n, _ in inside)
        out, on, leaving = set(), {}, defaultdict(list)
        if stmts or self.procedures:
            out.add((ENTRY, entry(0)))
        for n, s in stmts.items():
            if s.ends:
                out.add((n, EXIT))
            elif s.verb == "NEXT":
                # NEXT SENTENCE goes to the first statement of a later sentence
                out.add((n, next((m for m, x in stmts.items() if m > n and x.sentence > s.sentence), EXIT)))
            elif not s.jumps and not self._all_taken(s, filled[n]):
                after = self._follows(siblings, s)
                if after is None:
                    leaving[s.proc].append(n)
                    after = entry(s.proc + 1)
                on[n] = after
                out.add((n, after))
        out |= {(n, first) for (n, _), first in inside.items()} | {(n, entry(idx)) for n, _, idx in self.targets} | {(r.stmt, entry(r.low)) for r in self.ranges}
        points = defaultdict(set)
        for n, after in on.items():
            points[n].add(after)
        for r in self.ranges:
            if r.again:
                points[r.stmt].add(r.stmt)
        for r in self.ranges:
            # the ends of a range: what leads out of its last procedure that has statements
            last = max((i for i in full if i <= r.high), default=-1)
            if last >= r.low:
                out |= {(end, point) for end in leaving[last] for point in points[r.stmt]}
        return sorted(out)

    @staticmethod
    def _all_taken(s: Stmt, filled: int) -> bool:
        """Whether a statement's branches are all there are and none is empty."""
        if s.verb == "IF":
            whole = "ELSE" in s.branches
        elif s.verb in ("EVALUATE", "SEARCH"):
            whole = "WHEN OTHER" in s.branches
        elif s.verb == "PERFORM":
            whole = s.loop == "once"
        else:
            whole = any(f"NOT {x}" in s.branches for x in s.branches)
        return whole and filled == len(s.branches) and filled > 0

    def bodies(self) -> list[tuple[int, int, int]]:
        """``(node, a, b)``: the statements that each PERFORM with UNTIL repeats."""
        out = [(n, n + 1, s.last) for n, s in self.stmts.items() if s.loop == "until" and s.last > n]
        run: dict[int, list[int]] = defaultdict(list)
        for r in self.ranges:
            if r.again:
                run[r.stmt] += [n for n, s in self.stmts.items() if r.low <= s.proc <= r.high]
        return out + [(n, min(held), max(held)) for n, held in run.items() if held]


def edges(stmts: DataFrame, procedures: DataFrame) -> DataFrame:
    """``(program, from_node, to_node)`` of the control flow graph of each program that has statements."""
    return each_group(reduce(DataFrame.union, parts(stmts, procedures)), "program", lambda cells: Graph(cells).edges, "from_node int, to_node int")
