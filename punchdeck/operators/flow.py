"""Control flow and data flow of programs: each program's facts are solved where its rows are, all programs at once.

``edges(program, from_node, to_node)`` is the control flow graph of every program. A program is bounded, so what takes
rounds along its edges is a worklist over one group's rows, facts as bits of a number; programs are dealt out by one
exchange and nothing waits for the longest path of another. No bound on paths or facts is set.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punchdeck.operators.graph import each_group

NODE = ["program", "node"]
#: What a group function gets: rows of several tables, told apart by ``part``; keys as JSON, so any type will do.
PART = ("part", "node", "to_node", "item", "name", "source")


def _json(column: str) -> Column:
    return F.to_json(F.struct(F.col(column).alias("v")))


def _part(df: DataFrame | None, part: str, *keys: str, node: str = "node", to_node: str | None = None) -> DataFrame | None:
    if df is None:
        return None
    cells = {"part": F.lit(part), "node": F.col(node).cast("long"), "to_node": F.col(to_node).cast("long") if to_node else F.lit(None).cast("long")}
    cells |= {k: _json(k) if k in keys else F.lit(None).cast("string") for k in PART[3:]}
    return df.select("program", *(c.alias(n) for n, c in cells.items()))


#: The cells of a part of one program, a list for each column.
Part = dict[str, list]


def _groups(parts: Iterable[DataFrame | None], run: Callable[[dict[str, Part]], list[tuple]], columns: str) -> DataFrame:
    """``run`` over the parts of each program, each row of a part once; its rows without the program."""
    rows = reduce(DataFrame.union, (p for p in parts if p is not None))

    def group(cells: Part) -> list[tuple]:
        of: dict[str, Part] = defaultdict(lambda: {c: [] for c in PART[1:]})
        for part, *row in dict.fromkeys(zip(*(cells[c] for c in PART), strict=True)):
            for c, x in zip(of[part].values(), row, strict=True):
                c.append(x)
        return run(of)

    return each_group(rows, "program", group, columns)


def _back(df: DataFrame, like: dict[str, tuple[DataFrame, str]], nodes: tuple[str, ...] = ("node",), node_like: tuple[DataFrame, str] | None = None) -> DataFrame:
    """JSON keys and node numbers as what they were."""
    out = []
    for c in df.columns:
        if c in like:
            frame, column = like[c]
            out.append(F.from_json(c, f"v {frame.schema[column].dataType.simpleString()}")["v"].alias(c))
        elif c in nodes and node_like:
            out.append(F.col(c).cast(node_like[0].schema[node_like[1]].dataType).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def _successors(edges: Part) -> dict[int, list[int]]:
    succ: dict[int, list[int]] = defaultdict(list)
    for a, b in zip(edges["node"], edges["to_node"], strict=True):
        succ[a].append(b)
    return succ


def worklist(succ: dict[int, list[int]], made: dict[int, int], killed: dict[int, int], carried: dict[int, list[tuple[int, int]]]) -> dict[int, int]:
    """Bits at the start of each node: what a node makes, what passes it and is not killed there, what it carries on from what it holds."""
    held: dict[int, int] = defaultdict(int)
    work = deque(made)
    waiting = set(work)
    while work:
        n = work.popleft()
        waiting.discard(n)
        out = made.get(n, 0) | (held[n] & ~killed.get(n, 0))
        for wanted, gives in carried.get(n, ()):
            if held[n] & wanted:
                out |= gives
        for s in succ.get(n, ()):
            if out & ~held[s]:
                held[s] |= out
                if s not in waiting:
                    waiting.add(s)
                    work.append(s)
    return held


def _bits(mask: int) -> Iterable[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def backward(edges: DataFrame) -> DataFrame:
    return edges.select("program", F.col("to_node").alias("from_node"), F.col("from_node").alias("to_node"))


def solve(edges: DataFrame, made: DataFrame, killed: DataFrame | None = None, stops: DataFrame | None = None) -> DataFrame:
    """``(program, node, item)``: items that reach the start of a node along some path.

    An item is made at the end of a node (``made(program, node, item)``) and goes along every edge until it comes to
    a node that kills it: one of ``killed(program, node, item)``, or, where items have a ``name``, of
    ``killed(program, node, name)``, or one of ``stops(program, node)``, which kill all. A ``name`` is returned as well.
    With ``backward`` edges it is the analysis from behind.
    """
    key = "name" if "name" in made.columns else "item"
    carried = [c for c in ("item", "name") if c in made.columns]

    def run(part: dict[str, Part]) -> list[tuple]:
        m = part["made"]
        items = list(dict.fromkeys(zip(m["item"], m["name"], strict=True)))
        number = {x: i for i, x in enumerate(items)}
        of_key: dict[str, int] = defaultdict(int)
        for (item, name), i in number.items():
            of_key[name if key == "name" else item] |= 1 << i
        gen: dict[int, int] = defaultdict(int)
        for n, item, name in zip(m["node"], m["item"], m["name"], strict=True):
            gen[n] |= 1 << number[item, name]
        kill: dict[int, int] = defaultdict(int)
        for n, k in zip(part["killed"]["node"], part["killed"][key], strict=True):
            kill[n] |= of_key.get(k, 0)
        for n in part["stop"]["node"]:
            kill[n] = (1 << len(items)) - 1
        held = worklist(_successors(part["edge"]), gen, kill, {})
        return [(n, *items[i]) for n, mask in held.items() for i in _bits(mask)]

    parts = [_part(edges, "edge", node="from_node", to_node="to_node"), _part(made, "made", *carried), _part(killed, "killed", key), _part(stops, "stop")]
    found = _groups(parts, run, "node long, item string, name string")
    return _back(found, {c: (made, c) for c in carried}, node_like=(edges, "to_node")).select(*NODE, *carried)


def reachable(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """``(program, node)`` reached from ``entries(program, node)``, entries included."""
    found = solve(edges, entries.withColumn("item", F.lit(0)))
    return found.select(*NODE).union(entries.select(*NODE)).distinct()


def unreachable(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    return nodes.join(reachable(edges, entries), NODE, "left_anti")


def searched(edges: DataFrame, starts: DataFrame, checks: DataFrame, boundaries: DataFrame) -> DataFrame:
    """For each start whether a path leads from it to a check, and to a boundary or a dead end, without a check before.

    Starts, checks and boundaries are ``(program, node)``. A boundary ends a path, so does a check. Returns
    ``(program, node, some_path, every_path)``: a check on some path; no path past all checks. Loops that never
    leave count as checked.
    """
    stops = checks.union(boundaries).select(*NODE).distinct()
    met = solve(edges, starts.select(*NODE, F.col("node").alias("item")), stops=stops)
    last = edges.select("program", F.col("to_node").alias("node")).join(edges.select("program", F.col("from_node").alias("node")), NODE, "left_anti").distinct()
    flags = met.join(checks.select(*NODE).distinct().withColumn("check", F.lit(True)), NODE, "left")
    flags = flags.join(boundaries.select(*NODE).union(last).distinct().withColumn("end", F.lit(True)), NODE, "left")
    told = flags.groupBy("program", F.col("item").alias("node")).agg(
        F.max(F.coalesce("check", F.lit(False))).alias("some_path"), F.max(F.coalesce("end", F.lit(False)) & F.col("check").isNull()).alias("open")
    )
    out = starts.select(*NODE).distinct().join(told, NODE, "left")
    leaves = out.join(edges.select("program", F.col("from_node").alias("node")).distinct().withColumn("goes", F.lit(True)), NODE, "left")
    return leaves.select(*NODE, F.coalesce("some_path", F.lit(False)).alias("some_path"), (F.col("goes").isNotNull() & ~F.coalesce("open", F.lit(True))).alias("every_path"))


def first_met(edges: DataFrame, starts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(program, start, node, hops)``: for each start the nearest node that is wanted, the smallest of equal ones."""

    def run(part: dict[str, Part]) -> list[tuple]:
        succ, goal, out = _successors(part["edge"]), set(part["wanted"]["node"]), []
        for start in part["start"]["node"]:
            seen, front, hops = {start}, {start}, 0
            while front:
                hops += 1
                front = {s for n in front for s in succ.get(n, ())} - seen
                seen |= front
                if front & goal:
                    out.append((start, min(front & goal), hops))
                    break
        return out

    parts = [_part(edges, "edge", node="from_node", to_node="to_node"), _part(starts, "start"), _part(wanted, "wanted")]
    found = _groups(parts, run, "start long, node long, hops int")
    return _back(found, {}, ("start", "node"), (edges, "to_node"))


def reaching_definitions(edges: DataFrame, defs: DataFrame, entries: DataFrame, names: DataFrame, children: DataFrame | None = None) -> DataFrame:
    """``(program, node, name, def_node)``: definitions of a name that reach the start of a node.

    ``defs(program, node, name)``; every name of ``names(program, name)`` has a definition by nobody (``def_node`` null)
    at the program's entry, a node without a statement. A definition of a group is one of its
    ``children(program, name, child)`` too.
    """
    full = defs.select(*NODE, "name")
    if children is not None:
        full = full.union(defs.join(children, ["program", "name"]).select(*NODE, F.col("child").alias("name"))).distinct()
    item = lambda at: F.struct("name", at.alias("def_node")).alias("item")
    nothing = entries.join(names.distinct(), "program").select(*NODE, item(F.lit(None).cast("long")), "name")
    made = full.select(*NODE, item(F.col("node").cast("long")), "name").union(nothing)
    return solve(edges, made, full).select(*NODE, "name", "item.def_node")


def uninitialised(reaching: DataFrame, uses: DataFrame) -> DataFrame:
    """``uses(program, node, name)`` that a definition by nobody reaches."""
    return uses.join(reaching.filter("def_node is null").select(*NODE, "name"), [*NODE, "name"], "left_semi").distinct()


def liveness(edges: DataFrame, defs: DataFrame, uses: DataFrame) -> DataFrame:
    """``(program, node, name)``: names whose value at the end of the node is used later."""
    # from behind: a use makes the name at the start of its node; a definition ends it unless the node uses it too
    items = uses.select(*NODE, F.col("name").alias("item")).distinct()
    kills = defs.select(*NODE, F.col("name").alias("item")).join(items, [*NODE, "item"], "left_anti")
    return solve(backward(edges), items, kills).withColumnRenamed("item", "name")


def tainted(edges: DataFrame, sources: DataFrame, moves: DataFrame, defs: DataFrame) -> DataFrame:
    """``(program, node, name, via)``: names that hold outside input at the start of a node; ``via``: the node that wrote it.

    ``sources(program, node, name)`` take input; ``moves(program, node, source, name)`` carry it on if the source is
    tainted there; a definition without such a move cleans the name.
    """

    def run(part: dict[str, Part]) -> list[tuple]:
        numbers: dict[tuple[str, int], int] = {}
        gen: dict[int, int] = defaultdict(int)
        steps: dict[int, list[tuple[str, str]]] = defaultdict(list)
        for n, name in zip(part["source"]["node"], part["source"]["name"], strict=True):
            gen[n] |= 1 << numbers.setdefault((name, n), len(numbers))
        for n, source, name in zip(part["move"]["node"], part["move"]["source"], part["move"]["name"], strict=True):
            numbers.setdefault((name, n), len(numbers))
            steps[n].append((source, name))
        of_name: dict[str, int] = defaultdict(int)
        for (name, _), i in numbers.items():
            of_name[name] |= 1 << i
        kill: dict[int, int] = defaultdict(int)
        for n, name in zip(part["def"]["node"], part["def"]["name"], strict=True):
            kill[n] |= of_name.get(name, 0)
        carried = {n: [(of_name.get(s, 0), 1 << numbers[m, n]) for s, m in pairs] for n, pairs in steps.items()}
        facts = list(numbers)
        return [(n, *facts[i]) for n, mask in worklist(_successors(part["edge"]), gen, kill, carried).items() for i in _bits(mask)]

    parts = [_part(edges, "edge", node="from_node", to_node="to_node"), _part(sources, "source", "name"), _part(moves, "move", "source", "name"), _part(defs, "def", "name")]
    found = _groups(parts, run, "node long, name string, via long")
    return _back(found, {"name": (sources, "name")}, node_like=(edges, "to_node"))


def taint_steps(taint: DataFrame, moves: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """``(program, node, name, path)``: for each sink that is tainted the nodes from a source to it, the shortest, the first of equal ones.

    ``sinks(program, node, name)``.
    """

    def run(part: dict[str, Part]) -> list[tuple]:
        starts = set(zip(part["source"]["node"], part["source"]["name"], strict=True))
        from_: dict[tuple[int, str], set[str]] = defaultdict(set)
        for n, source, name in zip(part["move"]["node"], part["move"]["source"], part["move"]["name"], strict=True):
            from_[n, name].add(source)
        vias: dict[tuple[int, str], set[int]] = defaultdict(set)
        for n, name, via in zip(part["taint"]["node"], part["taint"]["name"], part["taint"]["to_node"], strict=True):
            vias[n, name].add(via)
        out = []
        for node, name in zip(part["sink"]["node"], part["sink"]["name"], strict=True):
            # layers of (node that wrote, name held), each with the smallest path to it
            layer = {(v, name): (node, v) for v in vias.get((node, name), ())}
            seen = set(layer)
            while layer:
                done = [path for state, path in layer.items() if state in starts]
                if done:
                    out.append((node, name, list(reversed(min(done)))))
                    break
                new: dict[tuple[int, str], tuple] = {}
                for (last, held), path in layer.items():
                    for source in from_.get((last, held), ()):
                        for via in vias.get((last, source), ()):
                            longer = (*path, via)
                            if (via, source) not in seen and longer < new.get((via, source), (*longer, 0)):
                                new[via, source] = longer
                seen |= set(new)
                layer = new
        return out

    parts = [_part(taint, "taint", "name", to_node="via"), _part(moves, "move", "source", "name"), _part(sources, "source", "name"), _part(sinks, "sink", "name")]
    found = _groups(parts, run, "node long, name string, path array<long>")
    return _back(found, {"name": (sinks, "name")}, node_like=(sinks, "node"))
