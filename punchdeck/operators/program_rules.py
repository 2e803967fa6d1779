"""Defect rules on COBOL programs, from the rows of ``punchdeck.sources.cobol`` and what is derived of them.

A finding is ``(program, line, rule_id, subject)``: the item, procedure or verb it is about.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punchdeck.functions.picture import parse
from punchdeck.operators import control, flow, intervals, operands
from punchdeck.operators.graph import cut, each_group
from punchdeck.operators.sequence import later_duplicates
from punchdeck.sources import cobol


DIGITS = re.compile("[0-9]+")


class Facts(NamedTuple):
    tokens: DataFrame
    items: DataFrame
    procedures: DataFrame
    stmts: DataFrame
    edges: DataFrame
    operands: DataFrame


class Sourced(NamedTuple):
    items: DataFrame
    procedures: DataFrame
    stmts: DataFrame
    parameters: DataFrame


def sourced(sources: DataFrame, id_column: str, text_column: str) -> Sourced:
    """What the program rules read of the sources."""
    found = cobol.taken_apart(sources, id_column, text_column)
    return Sourced(found["items"], found["procedures"], found["statements"], found["parameters"])


def facts(sources: DataFrame, id_column: str, text_column: str) -> Facts:
    """All rows of the sources and what is derived of them, each written once, as every rule reads them."""
    tokens = cut(cobol.tokens(sources, id_column, text_column))
    stmts, procedures, items = (cut(x) for x in (cobol.statements(tokens), cobol.procedures(tokens), cobol.data_items(tokens)))
    return Facts(tokens, items, procedures, stmts, cut(control.edges(stmts, procedures)), cut(operands.operands(stmts)))


def finding(rows: DataFrame, rule: str, subject: Column | str) -> DataFrame:
    return rows.select("program", "line", F.lit(rule).alias("rule_id"), (F.col(subject) if isinstance(subject, str) else subject).alias("subject"))


class Item(NamedTuple):
    idx: int
    level: int
    occurs: int | None
    name: str
    value: str | None
    section: str | None
    picture: str | None


def _ancestors(items: list[Item]) -> dict[int, list[Item]]:
    """The groups that each item lies in, the nearest last; levels 66 and 88 lie nowhere."""
    out, held = {}, []
    for x in items:
        if x.level in (66, 88):
            continue
        depth = 1 if x.level == 77 else x.level
        while held and held[-1][0] >= depth:
            held.pop()
        out[x.idx] = [y for _, y in held]
        held.append((depth, x))
    return out


class Program(control.Graph):
    """One program's rows, as the rules that need its graph ask for them."""

    def __init__(self, cells: dict[str, list]):
        super().__init__(cells)
        self.name = cells["program"][0]
        self.items = sorted((Item(idx, level, occurs, name, value, *words) for idx, level, occurs, name, value, words, *_ in self.part["item"]), key=lambda x: x.idx)
        told = {(n, name, bool(defined), bool(used)) for n, defined, used, name, *_ in self.part["operand"]}
        self.operands = sorted(told.union((n, *x) for n, s in self.stmts.items() if not s.verb.startswith("EXEC ") for x in operands.named(s.verb, s.words)))
        self.parameters = {name for _, _, _, name, *_ in self.part["parameter"]}


def uninitialised(p: Program) -> list[tuple]:
    """R001: an item that some statement sets is read on a path that sets it nowhere.

    Elementary items of WORKING-STORAGE, LOCAL-STORAGE and LINKAGE without a VALUE of their own or of a group above, no
    operands of PROCEDURE DIVISION USING. Conditions and loops, DISPLAY and what arithmetic doesn't itself set are read.
    """
    items = [x for x in p.items if x.section in ("WORKING-STORAGE", "LOCAL-STORAGE", "LINKAGE")]
    above = _ancestors(items)
    items = [x for x in items if x.idx in above]
    filled = {x.name for x in items if x.value is not None or any(g.value is not None for g in above[x.idx])}
    groups, children = set(), defaultdict(set)
    for x in items:
        for g in above[x.idx]:
            groups.add(g.name)
            children[g.name].add(x.name)
    defs = [(n, name) for n, name, defined, _ in p.operands if defined]
    own = sorted(({x.name for x in items} - groups - filled - p.parameters) & {name for _, name in defs})
    bit = {name: 1 << i for i, name in enumerate(own)}
    killed: dict[int, int] = defaultdict(int)
    for n, name in defs:
        for x in (name, *children.get(name, ())):
            killed[n] |= bit.get(x, 0)
    held = flow.worklist(p.successors, {control.ENTRY: (1 << len(own)) - 1}, killed, {})
    out = []
    for n, name, defined, used in p.operands:
        verb, line = p.stmts[n].verb, p.stmts[n].line
        arithmetic = verb in ("COMPUTE", "ADD", "SUBTRACT", "MULTIPLY", "DIVIDE")
        if used and held.get(n, 0) & bit.get(name, 0) and not (arithmetic and defined) and (arithmetic or verb in ("IF", "EVALUATE", "PERFORM", "SEARCH", "DISPLAY")):
            out.append((line, "R001", name))
    return out


def single_paragraphs(p: Program) -> list[tuple]:
    """R008: a PERFORM of one paragraph without THRU."""
    thru = {n for n, _, _, _, _, words, *_ in p.part["perform"] if words == ["high"]}
    runs = [r for r in p.ranges if p.stmts[r.stmt].verb == "PERFORM" and r.stmt not in thru]
    return [(p.stmts[r.stmt].line, "R008", p.procedures[r.low].name) for r in runs if p.procedures[r.low].kind == "PARAGRAPH"]


def goto_out_of_section(p: Program) -> list[tuple]:
    """R009: a GO TO to a procedure of another section, the first such target of each."""
    first: dict[int, str] = {}
    for n, _, idx in p.targets:
        s = p.stmts[n]
        if s.verb == "GO" and s.proc in p.procedures and p.procedures[s.proc].section != p.procedures[idx].section:
            first.setdefault(n, p.procedures[idx].name)
    return [(p.stmts[n].line, "R009", name) for n, name in first.items()]


def altered(f: Sourced) -> DataFrame:
    """R010."""
    return finding(f.stmts.filter("verb = 'ALTER'"), "R010", "verb")


def unreachable(p: Program) -> list[tuple]:
    """R011: procedures with statements that nothing leads to from outside, and statements of others that no path reaches but for those that only end the program."""
    heads: dict[int, int] = {}
    for n, s in p.stmts.items():
        if s.proc > 0:
            heads.setdefault(s.proc, n)
    headed = {n: proc for proc, n in heads.items()}
    entered = {headed[b] for a, b in p.edges if b in headed and (a not in p.stmts or p.stmts[a].proc != headed[b])}
    unused = heads.keys() - entered
    reached, front = {control.ENTRY}, [control.ENTRY]
    while front:
        front = [s for n in front for s in p.successors.get(n, ()) if s not in reached and not reached.add(s)]
    dead = [s for n, s in p.stmts.items() if n not in reached and s.proc not in unused and s.verb not in ("STOP", "GOBACK") and not (s.verb == "EXIT" and "PROGRAM" in s.words)]
    return [(x.line, "R011", x.name) for x in p.procedures.values() if x.idx in unused] + [(s.line, "R011", s.verb) for s in dead]


def evaluate_without_other(f: Sourced) -> DataFrame:
    """R013."""
    return finding(f.stmts.filter((F.col("verb") == "EVALUATE") & ~F.array_contains("branches", "WHEN OTHER")), "R013", "verb")


def duplicate_names(f: Sourced) -> DataFrame:
    """R023: the second and later procedures of one name in a section."""
    return finding(later_duplicates(f.procedures.withColumn("in_section", F.when(F.col("kind") == "PARAGRAPH", F.col("section"))), ["program", "in_section", "name"], "idx"), "R023", "name")


def truncating_moves(f: Sourced) -> DataFrame:
    """R003: a MOVE between items of which a receiver has fewer digits before or behind the point, or fewer characters; the first such receiver."""
    held = intervals.pictured(f.items).filter("picture is not null").groupBy("program", "name").agg(F.min_by(F.struct("category", "int_digits", "frac_digits", "positions"), "idx").alias("p"))
    at = F.array_position("words", "TO").cast("int")
    moves = f.stmts.filter((F.col("verb") == "MOVE") & ~F.arrays_overlap("words", F.array(F.lit("CORRESPONDING"), F.lit("CORR"))) & (at > 0))
    moves = moves.select("program", "stmt", "line", F.slice("words", 2, at - 2).alias("sent"), F.slice("words", at + 1, F.size("words")).alias("got")).filter(~F.array_contains("sent", ":"))
    moves = moves.withColumn("sender", F.get("sent", F.lit(0))).filter(operands.is_name(F.col("sender")))
    met = moves.join(held.select("program", F.col("name").alias("sender"), F.col("p").alias("s")), ["program", "sender"])
    # names outside of brackets
    depth = F.aggregate(F.slice("got", 1, F.col("at")), F.lit(0), lambda d, x: d + F.when(x == "(", 1).when(x == ")", -1).otherwise(0))
    to = met.select("program", "stmt", "line", "s", "got", F.posexplode("got").alias("at", "name")).filter(depth == 0).join(held, ["program", "name"])
    number = lambda p: F.col(f"{p}.category") == "NUMERIC"
    fewer = (F.col("p.int_digits") < F.col("s.int_digits")) | (F.col("p.frac_digits") < F.col("s.frac_digits"))
    lost = F.when(number("s") & number("p"), fewer).when(~number("s") & ~number("p"), F.col("s.positions") > F.col("p.positions"))
    return finding(to.filter(lost).groupBy("program", "stmt", "line").agg(F.min_by("name", "at").alias("name")), "R003", "name")


def _subscripts(p: Program) -> list[tuple]:
    """``(node, line, name, subscript, most)``: single words as subscripts, with the OCCURS of their dimension.

    Dimensions are told from the outermost; a subscript beyond them is judged by the innermost.
    """
    above, tables = _ancestors(p.items), {}
    for x in p.items:
        dims = [g.occurs for g in (*above[x.idx], x) if g.occurs is not None] if x.idx in above else []
        if dims:
            tables.setdefault(x.name, (x.section, dims))
    out = []
    for n, s in p.stmts.items():
        words = s.words
        for i, name in enumerate(words[:-1]):
            section, dims = tables.get(name, (None, None))
            if words[i + 1] != "(" or section in (None, "LINKAGE") or not operands.names(name):
                continue
            rest = words[i + 2 :]
            subs = rest[: rest.index(")")] if ")" in rest else []
            if all(DIGITS.fullmatch(x) or operands.names(x) for x in subs):
                out += [(n, s.line, name, x, dims[min(k, len(dims) - 1)]) for k, x in enumerate(subs)]
    return out


def interval_rules(p: Program) -> list[tuple]:
    """R005: a subscript that may lie beyond its OCCURS or below 1, once for each line and table. R028: SUBTRACT or COMPUTE that may
    leave a negative value in an unsigned item."""
    numeric: intervals.Parts = defaultdict(lambda: {c: [] for c in intervals.CELLS})
    unsigned = set()

    def put(part: str, **cells: object) -> None:
        for c, x in cells.items():
            numeric[part][c].append(x)

    for a, b in p.edges:
        put("edge", a=a, b=b)
    for n, s in p.stmts.items():
        put("stmt", node=n, word=s.verb, words=s.words)
    for n, a, b in p.bodies():
        put("body", node=n, a=a, b=b)
    for x in p.items:
        category, signed, digits, _, _ = parse(x.picture) if x.picture else (None,) * 5
        if category == "NUMERIC" and not signed:
            unsigned.add(x.name)
        if category == "NUMERIC" and 1 <= digits <= 18:
            most = 10**digits - 1
            put("item", node=x.idx, name=x.name, a=-most if signed else 0, b=most, word=x.value and x.value.upper())
    defs = [(n, name) for n, name, defined, _ in p.operands if defined]
    for n, name in defs:
        put("def", node=n, name=name)
    for n, name in [*((n, name) for n, name, _, _ in p.operands), *((after, name) for n, name in defs for after in p.successors.get(n, ()))]:
        put("asked", node=n, name=name)
    known = {(n, name): (low, high) for n, name, low, high in intervals.solved(numeric, p.name)}
    outside = set()
    for n, line, name, sub, most in _subscripts(p):
        low, high = known.get((n, sub), (1, most))
        if DIGITS.fullmatch(sub):
            low = high = int(sub) if int(sub) < 1 << 63 else 1
            high = high if int(sub) < 1 << 63 else most
        if low is None or high is None or high > most or low <= 0:
            outside.add((line, "R005", name))
    out = sorted(outside)
    for n, name in defs:
        verb, line = p.stmts[n].verb, p.stmts[n].line
        if verb in ("SUBTRACT", "COMPUTE") and name in unsigned:
            lows = [known[s, name][0] for s in p.successors.get(n, ()) if (s, name) in known]
            if any(low is None or low < 0 for low in lows):
                out.append((line, "R028", name))
    return out


def graph_rules(f: Sourced) -> DataFrame:
    """R001, R005, R008, R009, R011 and R028: what depends on a program's graph, from all its rows met once."""
    rows, c = control.rows, F.col
    parts = [
        *control.parts(f.stmts, f.procedures), rows(f.parameters, "parameter", name=c("name")), rows(operands.embedded(f.stmts).toDF("program", "node", "name", "d", "u"), "operand", node=c("node"), name=c("name"), a=c("d"), b=c("u")),
        rows(f.items, "item", node=c("idx"), a=c("level"), b=c("occurs"), name=c("name"), word=c("value"), words=F.array("section", "picture")),
    ]

    def judged(cells: dict[str, list]) -> list[tuple]:
        p = Program(cells)
        return [x for rule in (uninitialised, single_paragraphs, goto_out_of_section, unreachable, interval_rules) for x in rule(p)] if p.stmts else []

    return each_group(reduce(DataFrame.union, parts), "program", judged, "line int, rule_id string, subject string")


def program_rules(f: Sourced) -> DataFrame:
    return reduce(DataFrame.union, (rule(f) for rule in (graph_rules, altered, evaluate_without_other, duplicate_names, truncating_moves)))
