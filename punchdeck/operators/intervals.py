"""Intervals of numeric items at each statement, all programs at once, each solved over its own rows.

Values start at VALUE clauses and go along the control flow; MOVE, SET, ADD, SUBTRACT, MULTIPLY, COMPUTE, INITIALIZE and
the variable of a VARYING give intervals, any other definition none (everything is possible). What an item without a value on
any path may hold isn't known, and where it is read its PICTURE tells. An unsigned item is read as its magnitude, but what
a statement computed stays as it is at the next one. At loops (targets of edges that lead back) bounds that still
move are given up, so the numbers of rounds don't depend on the values; the UNTIL condition narrows what goes into a
body, and its opposite what leaves it.

Each PERFORM with UNTIL is a loop whose body is what it holds or the procedures it runs. Conditions with AND narrow
the way out alone, those with OR the way in alone; TEST AFTER narrows the way out alone.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punchdeck.functions.picture import picture
from punchdeck.operators import control
from punchdeck.operators.graph import each_group

Interval = tuple[int | None, int | None]
ANY: Interval = (None, None)
NUMBER = re.compile(r"[+-]?\d*\.?\d+")
RELATION = re.compile(
    r"^(?P<name>[^\s()]+) (?:IS )?(?P<no>NOT )?(?P<op>>=|<=|>|<|=|GREATER(?: THAN)?(?P<ge> OR EQUAL(?: TO)?)?|LESS(?: THAN)?(?P<le> OR EQUAL(?: TO)?)?|EQUALS?(?: TO)?) (?P<bound>[^\s()]+)(?P<more> (?:AND|OR) .*)?$"
)
#: The opposite of each relation.
OPPOSITE = {">": "<=", "<": ">=", ">=": "<", "<=": ">", "=": "<>", "<>": "="}
#: What the rows of a program hold besides the part that they belong to.
CELLS = {"node": "long", "a": "long", "b": "long", "name": "string", "word": "string", "words": "array<string>"}
ZEROS = ("ZERO", "ZEROS", "ZEROES")


def hull(a: Interval, b: Interval) -> Interval:
    return (None if a[0] is None or b[0] is None else min(a[0], b[0]), None if a[1] is None or b[1] is None else max(a[1], b[1]))


def joined(into: dict[str, Interval], sent: dict[str, Interval]) -> None:
    for name, v in sent.items():
        held = into.get(name)
        if held is None:
            into[name] = v
        elif held != v:
            into[name] = hull(held, v)


def widen(old: Interval, new: Interval) -> Interval:
    """Bounds that moved are given up."""
    low = old[0] if old[0] is not None and new[0] is not None and new[0] >= old[0] else None
    return (low, old[1] if old[1] is not None and new[1] is not None and new[1] <= old[1] else None)


def add(a: Interval, b: Interval) -> Interval:
    return (None if a[0] is None or b[0] is None else a[0] + b[0], None if a[1] is None or b[1] is None else a[1] + b[1])


def negative(a: Interval) -> Interval:
    return (None if a[1] is None else -a[1], None if a[0] is None else -a[0])


def times(a: Interval, b: Interval) -> Interval:
    low, high = -math.inf, math.inf
    ends = [0 if 0 in (x, y) else x * y for x in (low if a[0] is None else a[0], high if a[1] is None else a[1]) for y in (low if b[0] is None else b[0], high if b[1] is None else b[1])]
    return (None if min(ends) == low else min(ends), None if max(ends) == high else max(ends))


def divided(a: Interval, b: Interval) -> Interval:
    if None in a or None in b or b[0] <= 0 <= b[1]:
        return ANY
    return (min(x // y for x in a for y in b), max(-(-x // y) for x in a for y in b))


def magnitude(a: Interval) -> Interval:
    if a[0] is not None and a[0] >= 0:
        return a
    if a[1] is not None and a[1] <= 0:
        return negative(a)
    return (0, None if None in a else max(-a[0], a[1]))


def capped(a: Interval, relation: str, bound: Interval) -> Interval:
    """``a`` where ``a relation bound`` holds; an interval that would be empty is a point at the bound."""
    low, high = a
    if relation in (">", ">=") and bound[0] is not None:
        least = bound[0] + (relation == ">")
        low = least if low is None else max(low, least)
        high = None if high is None else max(high, low)
    if relation in ("<", "<=") and bound[1] is not None:
        most = bound[1] - (relation == "<")
        high = most if high is None else min(high, most)
        low = None if low is None else min(low, high)
    if relation == "=":
        return capped(capped(a, ">=", bound), "<=", bound)
    return (low, high)


class Reader:
    """Intervals of operands in one state."""

    def __init__(self, state: dict[str, Interval], declared: dict[str, Interval]):
        self.state, self.declared = state, declared

    def value(self, word: str) -> Interval:
        if NUMBER.fullmatch(word):
            x = float(word)
            return (int(word), int(word)) if "." not in word else (math.floor(x), math.ceil(x))
        if word in ZEROS:
            return (0, 0)
        return self.state.get(word, self.declared.get(word, ANY))

    def expression(self, words: list[str]) -> Interval:
        """Sums and products with brackets; subscripts behind a name are passed over, powers may be anything."""
        # a signed number behind an operand is an operator and a number
        flat: list[str] = []
        for w in words:
            signed = len(w) > 1 and w[0] in "+-" and flat and flat[-1] not in ("(", "+", "-", "*", "/", "**")
            flat += [w[0], w[1:]] if signed else [w]
        at = 0

        def skip_subscript() -> None:
            nonlocal at
            if at < len(flat) and flat[at] == "(":
                depth = 0
                while at < len(flat):
                    depth += (flat[at] == "(") - (flat[at] == ")")
                    at += 1
                    if not depth:
                        return

        def factor() -> Interval:
            nonlocal at
            if at >= len(flat):
                return ANY
            word, at = flat[at], at + 1
            if word in ("+", "-"):
                return factor() if word == "+" else negative(factor())
            if word == "(":
                inner = total()
                at += 1
            else:
                if word == "FUNCTION":
                    at += 1
                inner = ANY if word == "FUNCTION" else self.value(word)
                if not NUMBER.fullmatch(word):
                    while at + 1 < len(flat) and flat[at] in ("OF", "IN"):
                        at += 2
                    skip_subscript()
            if at < len(flat) and flat[at] == "**":
                at += 1
                factor()
                return ANY
            return inner

        def product() -> Interval:
            nonlocal at
            out = factor()
            while at < len(flat) and flat[at] in ("*", "/"):
                op, at = flat[at], at + 1
                out = times(out, factor()) if op == "*" else divided(out, factor())
            return out

        def total() -> Interval:
            nonlocal at
            out = product()
            while at < len(flat) and flat[at] in ("+", "-"):
                op, at = flat[at], at + 1
                right = product()
                out = add(out, right if op == "+" else negative(right))
            return out

        return total()

    def summed(self, words: list[str]) -> Interval:
        """The sum of a list of operands; one with a subscript is known by its PICTURE alone."""
        out, depth = (0, 0), 0
        for i, w in enumerate(words):
            depth += (w == "(") - (w == ")")
            if depth or w in (")", "OF", "IN", "ROUNDED") or (i and words[i - 1] in ("OF", "IN")):
                continue
            out = add(out, self.value(w))
        return out


def names(words: list[str]) -> list[str]:
    out, depth = [], 0
    for i, w in enumerate(words):
        depth += (w == "(") - (w == ")")
        if not depth and w not in (")", "OF", "IN", "ROUNDED", "=") and not (i and words[i - 1] in ("OF", "IN")):
            out.append(w)
    return out


def parts(words: list[str], *keys: str) -> dict[str, list[str]]:
    """The words of a statement behind its verb and behind each of ``keys``, up to its phrases."""
    out: dict[str, list[str]] = {"": []}
    held, depth = out[""], 0
    for i, w in enumerate(words[1:], 1):
        depth += (w == "(") - (w == ")")
        if (w == "SIZE" and words[i + 1 : i + 2] == ["ERROR"]) or (w in ("ON", "NOT") and "SIZE" in words[i : i + 3]):
            break
        if not depth and w in keys and w not in out:
            held = out[w] = []
        else:
            held.append(w)
    return out


def transferred(verb: str, words: list[str], defined: list[str], read: Reader, state: dict[str, Interval]) -> None:
    """What a statement makes of ``state``; ``read`` is what it finds."""
    new: dict[str, Interval] = {d: ANY for d in defined}
    if verb == "MOVE":
        p = parts(words, "TO")
        source = read.summed(p[""]) if len(names(p[""])) == 1 else ANY
        new |= {n: source for n in names(p.get("TO", []))}
    elif verb == "SET":
        p = parts(words, "TO", "UP", "DOWN", "BY")
        by = read.summed(p.get("BY", [])) if "BY" in p else ANY
        for n in names(p[""]):
            new[n] = read.summed(p["TO"]) if "TO" in p else add(read.value(n), by if "UP" in p else negative(by))
    elif verb in ("ADD", "SUBTRACT", "MULTIPLY"):
        p = parts(words, "TO", "FROM", "BY", "GIVING")
        left = read.summed(p[""])
        right = next((p[k] for k in ("TO", "FROM", "BY") if k in p), [])

        def result(x: Interval) -> Interval:
            return add(x, left) if verb == "ADD" else add(x, negative(left)) if verb == "SUBTRACT" else times(x, left)

        if "GIVING" in p:
            given = result(read.summed(right)) if right or verb == "ADD" else ANY
            new |= {n: given for n in names(p["GIVING"])}
        else:
            new |= {n: result(read.value(n)) for n in names(right)}
    elif verb == "COMPUTE":
        p = parts(words, "=")
        if "=" in p:
            new |= {n: read.expression(p["="]) for n in names(p[""])}
    elif verb == "INITIALIZE" and "REPLACING" not in words:
        new |= {n: (0, 0) for n in defined}
    state |= {n: v for n, v in new.items() if n in state or n in read.declared}


def until(words: list[str]) -> tuple[str, str, str, str] | None:
    """(name, relation, bound, what follows: AND, OR or nothing) of the first condition behind UNTIL."""
    at = words.index("UNTIL") if "UNTIL" in words else len(words)
    m = RELATION.match(" ".join(words[at + 1 :]))
    if m is None:
        return None
    op = m["op"]
    op = op if op[0] in "<>=" else ">=" if m["ge"] else "<=" if m["le"] else {"G": ">", "L": "<", "E": "="}[op[0]]
    return m["name"], OPPOSITE[op] if m["no"] else op, m["bound"], (m["more"] or " ").split(" ")[1]


#: The rows of one program by the part that they belong to, a list for each cell.
Parts = dict[str, dict[str, list]]


def parted(rows: dict[str, list]) -> Parts:
    part: Parts = defaultdict(lambda: {c: [] for c in CELLS})
    for kind, *row in zip(*(rows[c] for c in ("part", *CELLS)), strict=True):
        for c, x in zip(part[kind].values(), row, strict=True):
            c.append(x)
    return part


def solve(rows: dict[str, list]) -> list[tuple]:
    """One program: rows of edges, statements, loop bodies, items and what is asked for."""
    return solved(parted(rows), rows["program"][0])


def solved(part: Parts, program: object) -> list[tuple]:
    declared, seeds, unsigned = {}, {}, set()
    for _, name, low, high, seed in sorted(zip(*(part["item"][c] for c in ("node", "name", "a", "b", "word")), strict=True), key=lambda x: x[0]):
        if name not in declared:
            declared[name] = (low, high)
            if low == 0:
                unsigned.add(name)
            if seed is not None and NUMBER.fullmatch(seed):
                seeds[name] = Reader({}, {}).value(seed)
            elif seed in ZEROS:
                seeds[name] = (0, 0)
    stmts = {n: (v, w) for n, v, w in zip(part["stmt"]["node"], part["stmt"]["word"], part["stmt"]["words"], strict=True)}
    body: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for n, a, b in zip(part["body"]["node"], part["body"]["a"], part["body"]["b"], strict=True):
        body[n].append((a, b))
    defined: dict[int, list[str]] = defaultdict(list)
    for n, name in zip(part["def"]["node"], part["def"]["name"], strict=True):
        defined[n].append(name)
    succ, pred = defaultdict(list), defaultdict(list)
    # in order of their numbers, so that the same nodes are found to be targets of edges that lead back
    for a, b in sorted(zip(part["edge"]["a"], part["edge"]["b"], strict=True)):
        succ[a].append(b)
        pred[b].append(a)

    # order from behind, and where edges lead back to a node that is still open
    order, heads, state_of, stack = [], set(), {}, [(control.ENTRY, iter(succ[control.ENTRY]))]
    state_of[control.ENTRY] = 1
    while stack:
        n, rest = stack[-1]
        for s in rest:
            if state_of.get(s) == 1:
                heads.add(s)
            elif s not in state_of:
                state_of[s] = 1
                stack.append((s, iter(succ[s])))
                break
        else:
            state_of[n] = 2
            order.append(n)
            stack.pop()
    rank = {n: i for i, n in enumerate(reversed(order))}
    inside = lambda n, m: any(a <= m <= b for a, b in body[n])

    out: dict[tuple[int, bool], dict[str, Interval]] = {}  # of a node into its body or past it
    entry: dict[int, dict[str, Interval]] = {}
    controlled: dict[int, Interval] = {}
    todo, visits = set(rank), 0
    while todo:
        visits += 1
        if visits > max(200_000, len(rank) ** 2):
            raise RuntimeError(f"intervals: no fixed point in program {program}")
        n = min(todo, key=rank.__getitem__)
        todo.discard(n)
        verb, words = stmts.get(n, ("", []))
        found: dict[str, Interval] = dict(seeds) if n == control.ENTRY else {}
        back: dict[str, Interval] = {}
        for p in pred[n]:
            sent = out.get((p, bool(body[p]) and inside(p, n)), {})
            joined(found, sent)
            # asked for below by the loops that set a variable themselves
            if verb == "PERFORM" and body[n] and inside(n, p):
                joined(back, sent)
        if n in heads and n in entry:
            found = {name: widen(entry[n][name], v) if name in entry[n] else v for name, v in found.items()}
        entry[n] = found
        held = {name: magnitude(v) if name in unsigned else v for name, v in found.items()}
        read, state = Reader(dict(held), declared), held
        if verb == "PERFORM":
            if "VARYING" in words:
                p = parts(words, "VARYING", "FROM", "BY", "UNTIL", "AFTER")
                name = next(iter(names(p["VARYING"])), None)
                if name in declared:
                    v = read.summed(p.get("FROM", ["1"]))
                    if name in back:
                        v = hull(v, add(back[name], read.summed(p.get("BY", ["1"]))))
                        v = widen(controlled[n], v) if n in controlled else v
                    state[name] = controlled[n] = v
        elif verb:
            transferred(verb, words, defined[n], read, state)
        # without a body there is one way out
        states = {False: state, True: dict(state)} if body[n] else {False: state}
        condition = until(words) if body[n] else None
        if condition and condition[0] in declared:
            name, relation, bound, more = condition
            limit, v = Reader(state, declared).value(bound), state.get(condition[0], declared[condition[0]])
            if more != "OR":
                states[False] = state | {name: capped(v, relation, limit)}
            if more != "AND" and "AFTER" not in words[: words.index("UNTIL")]:
                states[True][name] = capped(v, OPPOSITE[relation], limit)
        for into, s in states.items():
            if out.get((n, into)) != s:
                out[n, into] = s
                todo |= {m for m in succ[n] if m in rank and (bool(body[n]) and inside(n, m)) == into}
    asked = sorted(set(zip(part["asked"]["node"], part["asked"]["name"], strict=True)))
    long = lambda x: x if x is not None and -(1 << 63) <= x < 1 << 63 else None
    return [(n, name, *map(long, entry[n][name])) for n, name in asked if n in entry and name in entry[n]]


def pictured(items: DataFrame) -> DataFrame:
    """``items`` with what their PICTURE says: ``category, signed, int_digits, frac_digits, positions``."""
    return items.withColumn("p", picture("picture")).select("*", "p.*").drop("p")


def bodies(stmts: DataFrame, procedures: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """``(program, node, a, b)``: the statements that each PERFORM with UNTIL repeats; ``ranges`` are those of ``control`` if they are at hand."""
    held = stmts.filter("loop = 'until' and last > stmt").select("program", F.col("stmt").alias("node"), (F.col("stmt") + 1).alias("a"), F.col("last").alias("b"))
    runs = (control.ranges(stmts, procedures) if ranges is None else ranges).filter("again")
    ends = stmts.groupBy("program", "proc").agg(F.min("stmt").alias("a"), F.max("stmt").alias("b"))
    run = runs.join(ends, "program").filter("proc between low and high").groupBy("program", F.col("stmt").alias("node")).agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return held.union(run)


def rows(df: DataFrame, part: str, **columns: Column) -> DataFrame:
    """Rows of one part, as ``parted`` takes them."""
    given = columns | {"part": F.lit(part)}
    return df.select("program", *(given.get(c, F.lit(None)).cast(k).alias(c) for c, k in {"part": "string", **CELLS}.items()))


def intervals(edges: DataFrame, stmts: DataFrame, procedures: DataFrame, items: DataFrame, found: DataFrame) -> DataFrame:
    """``(program, node, name, low, high)``: what a numeric item may hold at the start of a statement, null where there is no bound.

    Told for what a statement names and what the statement before it defines; ``found`` are the operands.
    """
    numeric = pictured(items).filter("category = 'NUMERIC' and int_digits between 1 and 18")
    most = F.expr("cast(rpad('1', int_digits + 1, '0') as bigint) - 1")
    defs = found.filter("defined").select("program", "node", "name")
    after = edges.select("program", F.col("from_node").alias("node"), "to_node").join(defs, ["program", "node"]).select("program", F.col("to_node").alias("node"), "name")

    c = F.col
    every = [
        rows(edges, "edge", a=c("from_node"), b=c("to_node")), rows(stmts, "stmt", node=c("stmt"), word=c("verb"), words=c("words")), rows(bodies(stmts, procedures), "body", node=c("node"), a=c("a"), b=c("b")),
        rows(numeric, "item", node=c("idx"), a=F.when(c("signed"), -most).otherwise(0), b=most, name=c("name"), word=F.upper("value")), rows(defs, "def", node=c("node"), name=c("name")),
        rows(found.select("program", "node", "name").union(after).distinct(), "asked", node=c("node"), name=c("name")),
    ]
    out = every[0]
    for e in every[1:]:
        out = out.union(e)
    return each_group(out, "program", solve, "node long, name string, low long, high long")
