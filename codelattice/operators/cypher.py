"""A read-only subset of the Cypher query language, compiled to DataFrames.

Clauses: MATCH, OPTIONAL MATCH, WHERE, WITH, UNWIND, RETURN [DISTINCT], ORDER BY, SKIP, LIMIT, UNION [ALL].
Patterns: labels, property maps, directed and undirected relationships, type alternatives, variable lengths.  No relationship is used
twice in one MATCH, also where several patterns stand in it; a variable length without an end goes on as far as paths do.
Rows are bags, as in Cypher; null sorts as the largest value.  Writing clauses are rejected.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pattern import directed, paths

_TOKEN = re.compile(r"\s+|//[^\n]*|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*|`[^`]+`)|(?P<param>\$\w+)|(?P<op><>|<=|>=|->|<-|\.\.|[-+*/%=<>()\[\]{}:,.|])")
_WRITES = {"CREATE", "MERGE", "DELETE", "DETACH", "SET", "REMOVE", "DROP", "CALL", "LOAD", "FOREACH"}
_AGGREGATES = {"count", "collect", "sum", "avg", "min", "max"}


class CypherError(ValueError):
    """The text is not a query of the subset."""


@dataclass
class NodePattern:
    var: str
    labels: list[str]
    props: dict[str, Any]


@dataclass
class RelPattern:
    var: str | None
    types: list[str]
    direction: str
    length: bool = False
    least: int = 1
    most: int | None = None


@dataclass
class Clause:
    kind: str
    items: list = field(default_factory=list)
    where: Any = None
    distinct: bool = False
    order: list = field(default_factory=list)
    skip: int | None = None
    limit: int | None = None


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.strip().rstrip(";")
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise CypherError(f"cannot read {text[at : at + 20]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.unnamed = 0, 0

    # -- tokens

    def word(self, *words: str) -> bool:
        return all(self.at + i < len(self.tokens) and self.tokens[self.at + i][0] == "name" and self.tokens[self.at + i][1].upper() == w for i, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.word(*words):
            self.at += len(words)
            return True
        return False

    def op(self, *ops: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] == "op" and self.tokens[self.at][1] in ops

    def eat(self, op: str) -> None:
        if not self.op(op):
            raise CypherError(f"expected {op!r} at token {self.at}")
        self.at += 1

    def maybe(self, op: str) -> bool:
        if self.op(op):
            self.at += 1
            return True
        return False

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise CypherError(f"expected a name at token {self.at}")
        self.at += 1
        return self.tokens[self.at - 1][1].strip("`")

    # -- clauses

    def query(self) -> list[tuple[bool, list[Clause]]]:
        parts, every = [], False
        while True:
            parts.append((every, self.single()))
            if not self.take("UNION"):
                break
            every = self.take("ALL")
        if self.at != len(self.tokens):
            raise CypherError(f"unexpected {self.tokens[self.at][1]!r}")
        return parts

    def single(self) -> list[Clause]:
        out = []
        while self.at < len(self.tokens) and not self.word("UNION"):
            kind, value = self.tokens[self.at]
            if kind == "name" and value.upper() in _WRITES:
                raise CypherError(f"{value} is not supported: queries only read")
            if self.take("OPTIONAL", "MATCH"):
                out.append(Clause("optional", self.patterns(), self.maybe_where()))
            elif self.take("MATCH"):
                out.append(Clause("match", self.patterns(), self.maybe_where()))
            elif self.take("UNWIND"):
                e = self.expr()
                if not self.take("AS"):
                    raise CypherError("UNWIND needs AS")
                out.append(Clause("unwind", [(e, self.name())]))
            elif self.word("WITH") or self.word("RETURN"):
                c = Clause(self.name().lower(), distinct=self.take("DISTINCT"))
                c.items = self.projection()
                if self.take("ORDER", "BY"):
                    c.order = [self.sort_item()]
                    while self.maybe(","):
                        c.order.append(self.sort_item())
                if self.take("SKIP"):
                    c.skip = int(self.tokens[self.at][1])
                    self.at += 1
                if self.take("LIMIT"):
                    c.limit = int(self.tokens[self.at][1])
                    self.at += 1
                if c.kind == "with":
                    c.where = self.maybe_where()
                out.append(c)
            else:
                raise CypherError(f"unexpected {value!r}")
        if not out or out[-1].kind != "return":
            raise CypherError("a query ends with RETURN")
        return out

    def maybe_where(self) -> Any:
        return self.expr() if self.take("WHERE") else None

    def projection(self) -> list[tuple[Any, str]]:
        items = []
        while True:
            start = self.at
            e = ("star",) if self.maybe("*") else self.expr()
            text = "".join(v for _, v in self.tokens[start : self.at])
            items.append((e, self.name() if self.take("AS") else text))
            if not self.maybe(","):
                return items

    def sort_item(self) -> tuple[Any, bool]:
        e = self.expr()
        if self.take("DESC") or self.take("DESCENDING"):
            return e, True
        self.take("ASC") or self.take("ASCENDING")
        return e, False

    # -- patterns

    def patterns(self) -> list[list]:
        out = [self.path()]
        while self.maybe(","):
            out.append(self.path())
        return out

    def path(self) -> list:
        parts: list = [self.node()]
        while self.op("-", "<-"):
            parts += [self.relation(), self.node()]
        return parts

    def node(self) -> NodePattern:
        self.eat("(")
        var = self.name() if self.at < len(self.tokens) and self.tokens[self.at][0] == "name" else None
        labels = []
        while self.maybe(":"):
            labels.append(self.name())
            while self.maybe("|"):
                labels.append(self.name())
        props = self.map() if self.op("{") else {}
        self.eat(")")
        if var is None:
            self.unnamed += 1
            var = f"_{self.unnamed}"
        return NodePattern(var, labels, props)

    def map(self) -> dict[str, Any]:
        self.eat("{")
        out = {}
        while not self.op("}"):
            key = self.name()
            self.eat(":")
            out[key] = self.expr()
            if not self.maybe(","):
                break
        self.eat("}")
        return out

    def relation(self) -> RelPattern:
        left = self.maybe("<-")
        if not left:
            self.eat("-")
        rel = RelPattern(None, [], "any")
        if self.maybe("["):
            if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
                rel.var = self.name()
            if self.maybe(":"):
                rel.types.append(self.name())
                while self.maybe("|"):
                    self.maybe(":")
                    rel.types.append(self.name())
            if self.maybe("*"):
                rel.length = True
                if self.tokens[self.at][0] == "num":
                    rel.least = rel.most = int(self.tokens[self.at][1])
                    self.at += 1
                if self.maybe(".."):
                    rel.most = None
                    if self.tokens[self.at][0] == "num":
                        rel.most = int(self.tokens[self.at][1])
                        self.at += 1
            self.eat("]")
        if left:
            self.eat("-")
            rel.direction = "in"
        elif self.maybe("->"):
            rel.direction = "out"
        else:
            self.eat("-")
        return rel

    # -- expressions, as tuples

    def expr(self) -> Any:
        e = self.conj()
        while self.take("OR"):
            e = ("or", e, self.conj())
        return e

    def conj(self) -> Any:
        e = self.neg()
        while self.take("AND"):
            e = ("and", e, self.neg())
        return e

    def neg(self) -> Any:
        return ("not", self.neg()) if self.take("NOT") else self.comparison()

    def comparison(self) -> Any:
        e = self.sum()
        while True:
            if self.op("=", "<>", "<", ">", "<=", ">="):
                o = self.tokens[self.at][1]
                self.at += 1
                e = ("cmp", o, e, self.sum())
            elif self.take("IN"):
                e = ("in", e, self.sum())
            elif self.take("CONTAINS"):
                e = ("contains", e, self.sum())
            elif self.take("STARTS", "WITH"):
                e = ("starts", e, self.sum())
            elif self.take("ENDS", "WITH"):
                e = ("ends", e, self.sum())
            elif self.take("IS", "NOT", "NULL"):
                e = ("not", ("null", e))
            elif self.take("IS", "NULL"):
                e = ("null", e)
            else:
                return e

    def sum(self) -> Any:
        e = self.term()
        while self.op("+", "-"):
            o = self.tokens[self.at][1]
            self.at += 1
            e = ("arith", o, e, self.term())
        return e

    def term(self) -> Any:
        e = self.postfix()
        while self.op("*", "/", "%"):
            o = self.tokens[self.at][1]
            self.at += 1
            e = ("arith", o, e, self.postfix())
        return e

    def postfix(self) -> Any:
        e = self.atom()
        while True:
            if self.op(".") and e[0] in ("var", "prop"):
                self.at += 1
                e = ("prop", e[1], self.name())
            elif self.maybe("["):
                e = ("index", e, self.expr())
                self.eat("]")
            elif self.op(":") and e[0] == "var":
                self.at += 1
                e = ("label", e[1], self.name())
            else:
                return e

    def atom(self) -> Any:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind == "str":
            self.at += 1
            return ("lit", re.sub(r"\\(.)", r"\1", value[1:-1]))
        if kind == "num":
            self.at += 1
            return ("lit", float(value) if "." in value else int(value))
        if kind == "param":
            self.at += 1
            return ("param", value[1:])
        if self.maybe("-"):
            return ("arith", "-", ("lit", 0), self.atom())
        if self.maybe("["):
            items = []
            while not self.op("]"):
                items.append(self.expr())
                if not self.maybe(","):
                    break
            self.eat("]")
            return ("list", items)
        if self.op("("):
            start = self.at
            try:  # a pattern in an expression says that a match exists
                path = self.path()
                if len(path) > 1:
                    return ("exists", path)
            except CypherError:
                pass
            self.at = start
            self.eat("(")
            e = self.expr()
            self.eat(")")
            return e
        if self.take("CASE"):
            branches, other = [], None
            while self.take("WHEN"):
                c = self.expr()
                if not self.take("THEN"):
                    raise CypherError("WHEN needs THEN")
                branches.append((c, self.expr()))
            if self.take("ELSE"):
                other = self.expr()
            if not self.take("END"):
                raise CypherError("CASE needs END")
            return ("case", branches, other)
        name = self.name()
        if name.upper() in ("TRUE", "FALSE", "NULL"):
            return ("lit", {"TRUE": True, "FALSE": False, "NULL": None}[name.upper()])
        if name.upper() == "EXISTS" and self.op("(", "{"):
            close = ")" if self.op("(") else "}"
            self.at += 1
            self.take("MATCH")
            path = self.path()
            self.eat(close)
            return ("exists", path)
        if self.maybe("("):
            distinct, args = self.take("DISTINCT"), []
            if self.maybe("*"):
                args.append(("star",))
            while not self.op(")"):
                args.append(self.expr())
                if not self.maybe(","):
                    break
            self.eat(")")
            return ("call", name.lower(), args, distinct)
        return ("var", name)


def _walk(e: Any, visit: Callable[[tuple], None]) -> None:
    if isinstance(e, tuple) and e and isinstance(e[0], str):
        visit(e)
        for x in e[1:]:
            _walk(x, visit)
    elif isinstance(e, (tuple, list)):
        for x in e:
            _walk(x, visit)


def _aggregates(e: Any) -> bool:
    found = []
    _walk(e, lambda x: found.append(x) if x[0] == "call" and x[1] in _AGGREGATES else None)
    return bool(found)


class Compiler:
    """Rows hold a column for each variable: a node's id, a relationship's type, or a value."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, params: dict[str, Any]):
        self.nodes, self.edges, self.params = nodes, edges, params
        self.spark = nodes.sparkSession
        self.edges_used: list[str] = []  # columns with the keys of the edges that the clause at hand has used

    def run(self, parts: list[tuple[bool, list[Clause]]]) -> DataFrame:
        out = None
        for all_rows, clauses in parts:
            rows = self.single(clauses)
            if out is None:
                out = rows
            else:
                out = out.unionByName(rows)
                if not all_rows:
                    out = out.distinct()
        return out

    def single(self, clauses: list[Clause]) -> DataFrame:
        self.node_vars: set[str] = set()
        rows = self.spark.range(1).select(F.lit(1).alias("_one"))
        for c in clauses:
            if c.kind in ("match", "optional"):
                rows = self.match(rows, c)
            elif c.kind == "unwind":
                e, name = c.items[0]
                rows, col = self.value(rows, e)
                kinds: list[str] = []
                _walk(e, lambda x: kinds.append(x[1]) if x[0] == "var" else None)  # noqa: B023
                if any(k in self.node_vars or k in getattr(self, "node_lists", ()) for k in kinds):
                    self.node_vars.add(name)
                rows = rows.withColumn(name, F.explode(col))
            else:
                rows = self.project(rows, c)
        return rows.drop("_one")

    # -- matching

    def match(self, rows: DataFrame, c: Clause) -> DataFrame:
        before = [x for x in rows.columns if "__" not in x]
        if c.kind == "match":
            self.edges_used = []
            for path in c.items:
                rows = self.extend(rows, path)
            return self.filtered(rows.drop(*self.edges_used), c.where)
        # OPTIONAL MATCH joins the whole pattern, with its condition, to each row or gives nulls once
        shared = [v for p in c.items for v in (x.var for x in p if isinstance(x, NodePattern)) if v in rows.columns]
        seeds = rows.select(*dict.fromkeys(shared)).distinct() if shared else self.spark.range(1).select(F.lit(1).alias("_one"))
        found = seeds
        self.edges_used = []
        for path in c.items:
            found = self.extend(found, path)
        found = self.filtered(found.drop(*self.edges_used), c.where)
        new = [x for x in found.columns if x not in before and "__" not in x and x != "_one"]
        found = found.select(*dict.fromkeys(shared), *new)
        return rows.join(found, list(dict.fromkeys(shared)), "left") if shared else rows.join(found, F.lit(True), "left")

    def extend(self, rows: DataFrame, path: list) -> DataFrame:
        first: NodePattern = path[0]
        rows = self.bind(rows, first)
        for rel, node in zip(path[1::2], path[2::2]):
            left = next(n for n, r in zip(path[0::2], path[1::2]) if r is rel)
            known = node.var in rows.columns
            end = f"_end_{node.var}" if known else node.var
            used = f"_edges__{len(self.edges_used)}"
            if not rel.length:
                e = directed(self.edges, tuple(rel.types), rel.direction, keyed=True)
                cols = [F.col("start").alias(left.var), F.col("end").alias(end), F.array("edge").alias(used)] + ([F.col("type").alias(rel.var)] if rel.var else [])
                rows = rows.join(e.select(*cols), left.var)
            else:
                starts = rows.select(F.col(left.var).alias("node_id")).distinct()
                reached = paths(starts, self.edges, *rel.types, direction=rel.direction, least=rel.least, most=rel.most, used=True)
                rows = rows.join(reached.select(F.col("start").alias(left.var), F.col("end").alias(end), F.col("used").alias(used)), left.var)
            for before in self.edges_used:
                rows = rows.where(~F.arrays_overlap(before, used))
            self.edges_used = [*self.edges_used, used]
            if known:
                rows = rows.where(F.col(end) == F.col(node.var)).drop(end)
                rows = self.checked(rows, node)
            else:
                self.node_vars.add(node.var)
                rows = self.checked(rows, node)
        return rows

    def bind(self, rows: DataFrame, node: NodePattern) -> DataFrame:
        if node.var not in rows.columns:
            ids = self.candidates(node).select(F.col("node_id").alias(node.var))
            rows = ids.withColumn("_one", F.lit(1)) if rows.columns == ["_one"] else rows.join(ids, F.lit(True))
            self.node_vars.add(node.var)
            return rows
        return self.checked(rows, node)

    def candidates(self, node: NodePattern) -> DataFrame:
        n = self.nodes
        if node.labels:
            n = n.where(F.col("label").isin(node.labels))
        for key, e in node.props.items():
            _, v = self.value(n, e)
            n = n.where(F.col(key) == v)
        return n

    def checked(self, rows: DataFrame, node: NodePattern) -> DataFrame:
        if node.labels or node.props:
            rows = rows.join(self.candidates(node).select(F.col("node_id").alias(node.var)), node.var, "left_semi")
        return rows

    # -- expressions

    def filtered(self, rows: DataFrame, e: Any) -> DataFrame:
        if e is None:
            return rows
        if e[0] == "and":
            return self.filtered(self.filtered(rows, e[1]), e[2])
        if e[0] == "exists" or e[0] == "not" and e[1][0] == "exists":
            path = e[1] if e[0] == "exists" else e[1][1]
            shared = [x.var for x in path if isinstance(x, NodePattern) and x.var in rows.columns]
            saved, edges_used = set(self.node_vars), self.edges_used
            self.edges_used = []
            found = self.extend(rows.select(*shared).distinct(), path).select(*shared).distinct()
            self.node_vars, self.edges_used = saved, edges_used
            return rows.join(found, shared, "left_semi" if e[0] == "exists" else "left_anti")
        rows, c = self.value(rows, e)
        return rows.where(c)

    def value(self, rows: DataFrame, e: Any) -> tuple[DataFrame, Column]:
        """The rows with what the expression needs joined to them, and its column."""
        wanted: dict[str, set[str]] = {}

        def need(x: tuple) -> None:
            if x[0] == "prop" and x[1] in self.node_vars:
                wanted.setdefault(x[1], set()).add(x[2])
            elif x[0] == "label" or x[0] == "call" and x[1] == "labels":
                wanted.setdefault(x[1] if x[0] == "label" else x[2][0][1], set()).add("label")

        _walk(e, need)
        for var, names in wanted.items():
            names = {n for n in names if f"{var}__{n}" not in rows.columns}
            if names:
                n = self.nodes.select(F.col("node_id").alias(var), *(F.col(x).alias(f"{var}__{x}") for x in sorted(names)))
                rows = rows.join(n, var, "left")
        return rows, self.column(e)

    def column(self, e: Any) -> Column:
        kind = e[0]
        if kind == "lit":
            return F.lit(e[1])
        if kind == "param":
            v = self.params[e[1]]
            return F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v)
        if kind == "var":
            return F.col(e[1])
        if kind == "prop":
            return F.col(f"{e[1]}__{e[2]}") if e[1] in self.node_vars else F.col(e[1])[e[2]]
        if kind == "label":
            return F.col(f"{e[1]}__label") == e[2]
        if kind == "list":
            return F.array(*map(self.column, e[1]))
        if kind == "index":
            return F.get(self.column(e[1]), self.column(e[2]).cast("int"))
        if kind == "and":
            return self.column(e[1]) & self.column(e[2])
        if kind == "or":
            return self.column(e[1]) | self.column(e[2])
        if kind == "not":
            return ~self.column(e[1])
        if kind == "null":
            return self.column(e[1]).isNull()
        if kind == "cmp":
            a, b = self.column(e[2]), self.column(e[3])
            return {"=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[e[1]]
        if kind == "in":
            if e[2][0] == "list":
                return self.column(e[1]).isin(*(x[1] for x in e[2][1])) if all(x[0] == "lit" for x in e[2][1]) else F.array_contains(self.column(e[2]), self.column(e[1]))
            return F.array_contains(self.column(e[2]), self.column(e[1]))
        if kind in ("contains", "starts", "ends"):
            a, b = self.column(e[1]), self.column(e[2])
            return a.contains(b) if kind == "contains" else a.startswith(b) if kind == "starts" else a.endswith(b)
        if kind == "arith":
            a, b = self.column(e[2]), self.column(e[3])
            lists = any(x[0] == "call" and x[1] == "collect" or x[0] == "list" for x in (e[2], e[3]))
            return F.concat(a, b) if lists else {"+": a + b, "-": a - b, "*": a * b, "/": a / b, "%": a % b}[e[1]]
        if kind == "case":
            out = F.lit(None) if e[2] is None else self.column(e[2])
            for c, v in reversed(e[1]):
                out = F.when(self.column(c), self.column(v)).otherwise(out)
            return out
        if kind == "call":
            return self.call(e[1], e[2], e[3])
        raise CypherError(f"{kind} is not supported here")

    def call(self, name: str, args: list, distinct: bool) -> Column:
        if name == "count":
            if args[0] == ("star",):
                return F.count(F.lit(1))
            return F.countDistinct(self.column(args[0])) if distinct else F.count(self.column(args[0]))
        if name == "labels":
            return F.array(F.col(f"{args[0][1]}__label"))
        if name in ("type", "elementid", "id"):
            return F.col(args[0][1])
        columns = [self.column(a) for a in args]
        plain = {"collect": F.collect_set if distinct else F.collect_list, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "tolower": F.lower, "toupper": F.upper, "coalesce": F.coalesce, "abs": F.abs, "tostring": lambda c: c.cast("string")}
        if name in plain:
            return plain[name](*columns)
        if name == "size":  # of a text or of a list
            text = args[0][0] in ("prop", "lit") or args[0][0] == "call" and args[0][1] in ("tolower", "toupper", "tostring")
            return F.length(columns[0]) if text else F.size(columns[0])
        raise CypherError(f"function {name} is not supported")

    # -- projection

    def project(self, rows: DataFrame, c: Clause) -> DataFrame:
        if any(e == ("star",) for e, _ in c.items):
            c.items = [(("var", v), v) for v in rows.columns if "__" not in v and not v.startswith("_")]
        columns = []
        for e, name in c.items:
            rows, col = self.value(rows, e)
            columns.append((e, name, col))
        keys = [(n, col) for e, n, col in columns if not _aggregates(e)]
        grouped = any(_aggregates(e) for e, _, _ in columns)
        order = []
        if not grouped:
            for e, down in c.order:
                if e[0] == "var" and e[1] in (n for _, n, _ in columns):
                    continue
                rows, col = self.value(rows, e)
                rows = rows.withColumn(f"_o{len(order)}", col)
                order.append((f"_o{len(order)}", down))
        if grouped:
            marked = [(f"_k{i}", n, col) for i, (n, col) in enumerate(keys)]
            kept = rows.select("*", *(col.alias(k) for k, _, col in marked))
            rows = kept.groupBy(*(k for k, _, _ in marked)).agg(*(col.alias(n) for e, n, col in columns if _aggregates(e)))
            rows = rows.select(*(F.col(f"`{k}`").alias(n) for k, n, _ in marked), *(F.col(f"`{n}`") for e, n, _ in columns if _aggregates(e)))
            rows = rows.select(*(F.col(f"`{n}`") for _, n, _ in columns))
        else:
            rows = rows.select(*(col.alias(n) for _, n, col in columns), *(F.col(o) for o, _ in order))
        self.node_lists = {n for e, n, _ in columns if _aggregates(e) and self.holds_nodes(e)}
        self.node_vars = {n for e, n, _ in columns if e[0] == "var" and e[1] in self.node_vars}
        if c.distinct:
            rows = rows.distinct() if not order else rows.dropDuplicates([n for _, n, _ in columns])
        if c.where is not None:
            rows = self.filtered(rows, c.where)
        sorts = []
        hidden = iter(order)
        names = {self.text(e): n for e, n, _ in columns}
        for e, down in c.order:
            if not grouped and not (e[0] == "var" and e[1] in (n for _, n, _ in columns)):
                col = F.col(next(hidden)[0])
            else:
                name = e[1] if e[0] == "var" else names.get(self.text(e))
                if name is None:
                    raise CypherError("ORDER BY after grouping needs a returned item")
                col = F.col(f"`{name}`")
            sorts.append(col.desc_nulls_first() if down else col.asc_nulls_last())
        if sorts:
            rows = rows.orderBy(*sorts)
        if c.skip:
            rows = rows.offset(c.skip)
        if c.limit is not None:
            rows = (rows if sorts else rows.orderBy(*rows.columns)).limit(c.limit)
        return rows.drop(*(o for o, _ in order))

    def holds_nodes(self, e: Any) -> bool:
        found = []
        _walk(e, lambda x: found.append(x[1]) if x[0] == "var" and x[1] in self.node_vars else None)
        return bool(found)

    @staticmethod
    def text(e: Any) -> str:
        return repr(e)


def run_cypher(query: str, nodes: DataFrame, edges: DataFrame, **params: Any) -> DataFrame:
    """The rows of a query over the graph's two tables; parameters are bound, never put into the text."""
    return Compiler(nodes, edges, params).run(Parser(query).query())
