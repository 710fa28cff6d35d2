"""Python source files to raw graph records, one pass per file inside the Python worker."""

from __future__ import annotations

import ast
import io
import tokenize
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import RAW_EDGES, RAW_NODES
from ..session import written
from ..sources.readers import folder_name, module_name, stdlib


def resolve_relative(level: int, module: str | None, folder: str) -> str | None:
    """The dotted name of a relative import: one dot is the file's folder, each further dot one folder up; None above the root."""
    parts = folder.split(".") if folder else []
    keep = len(parts) - (level - 1)
    if not parts or keep <= 0:
        return module if not parts and level == 1 and module else None
    return ".".join([*parts[:keep], *([module] if module else [])])


class _File:
    """Records of one file.  Four passes in order: imports, definitions, globals, relations."""

    def __init__(self, repo: str, ord_: int, module: str, folder: str, package: bool, text: str, skip: frozenset[str]):
        self.repo, self.ord, self.module, self.folder, self.package, self.text, self.skip = repo, ord_, module, folder, package, text, skip
        self.lines = text.splitlines(keepends=True)
        self.nodes: dict[tuple, dict] = {}
        self.edges: dict[tuple, dict] = {}
        self.imports: dict[str, dict] = {}
        self.classes: dict[str, dict] = {}
        self.functions: dict[str, dict] = {}
        self.methods: dict[tuple[str, str], dict] = {}
        self.globals: dict[str, dict] = {}
        self.fields: dict[str, set[str]] = {}
        self.signatures: dict[int, str] = {}

    # -- records

    def node(self, kind: str, key: tuple, **columns: str | None) -> dict:
        """A node, the last one with a key wins."""
        row = {"repo": self.repo, "file_ord": self.ord, "type": kind, "module_name": self.module} | columns
        self.nodes[(kind, *key)] = row
        return row

    def edge(self, kind: str, source: dict, target: dict) -> None:
        row = {"repo": self.repo, "file_ord": self.ord, "type": kind}
        for side, n in (("source", source), ("target", target)):
            row |= {
                side: n["name"], f"{side}_association_type": n["type"], f"{side}_module_name": n.get("module") if n["type"] == "Import" else n["module_name"],
                f"{side}_signature": n.get("signature"), f"{side}_class": n.get("class"),
            }
        self.edges[tuple(row.values())] = row

    def code(self, n: ast.AST) -> str:
        return ast.get_source_segment(self.text, n) or ""

    def signature(self, n: ast.AST) -> str:
        """The header from its first word to the colon that closes it."""
        if id(n) not in self.signatures:
            self.signatures[id(n)] = self.header(n)
        return self.signatures[id(n)]

    def header(self, n: ast.AST) -> str:
        segment = "".join(self.lines[n.lineno - 1 : n.end_lineno])[len(self.lines[n.lineno - 1].encode()[: n.col_offset].decode()) :]
        depth = 0
        starts = [0]
        for line in segment.splitlines(keepends=True):
            starts.append(starts[-1] + len(line))
        try:
            for t in tokenize.generate_tokens(io.StringIO(segment).readline):
                if t.type == tokenize.OP:
                    depth += (t.string in "([{") - (t.string in ")]}")
                    if t.string == ":" and not depth:
                        header = segment[: starts[t.start[0] - 1] + t.start[1]]
                        return header.removeprefix("async ").removeprefix("def ").removeprefix("class ").strip()
        except (tokenize.TokenError, IndentationError):
            pass
        return segment.split(":", 1)[0].strip()

    # -- passes

    def run(self, tree: ast.Module) -> None:
        self.top = self.node("Module", (), name=self.module, local_name=self.module.rsplit(".", 1)[-1])
        for n in ast.walk(tree):
            if isinstance(n, ast.Import):
                for a in n.names:
                    self.imported(a.name, a.name, a.asname)
            elif isinstance(n, ast.ImportFrom):
                origin = resolve_relative(n.level, n.module, self.folder) if n.level else n.module
                for a in n.names:
                    if a.name != "*" and origin:
                        self.imported(origin, a.name, a.asname)
        self.define(tree.body, None, None)
        self.find_globals(tree.body)
        self.relate(tree.body, self.top, None)
        for n in tree.body:
            if isinstance(n, ast.If) and self.is_main(n):
                main = self.node("Function", ("__main__",), name="__main__", signature='if __name__ == "__main__":', code=self.code(n))
                self.edge("CONTAINS", self.top, main)
                self.uses(main, n.body, None)
                self.relate(n.body, main, None, inner=True)

    def imported(self, origin: str, name: str, alias: str | None) -> None:
        if origin.split(".", 1)[0] in self.skip:
            return
        row = self.node("Import", (name, origin), name=name, module=origin, alias=alias, dotted_folder_name=self.folder)
        self.imports[alias or name.split(".", 1)[0] if name == origin else alias or name] = row
        if self.package:
            self.edge("CONTAINS", self.top, row)

    def define(self, body: list[ast.stmt], owner: str | None, inside: str | None) -> None:
        """Classes, functions and methods at any depth; a function anywhere inside a class is a method of it."""
        for n in body:
            if isinstance(n, ast.ClassDef):
                row = self.node("Class", (n.name, self.signature(n)), name=n.name, signature=self.signature(n), code=self.code(n))
                self.classes[n.name] = row
                self.fields[n.name] = self.class_fields(n)
                self.define(n.body, n.name, None)
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                columns = {"name": n.name, "signature": self.signature(n), "code": self.code(n)}
                if owner:
                    self.methods[owner, n.name] = self.node("Method", (n.name, owner), **columns, **{"class": owner})
                else:
                    self.functions[n.name] = self.node("Function", (n.name, columns["signature"]), **columns)
                self.define(n.body, owner, n.name)
            else:
                for inner in ("body", "orelse", "finalbody"):
                    self.define(getattr(n, inner, None) or [], owner, inside)
                for h in getattr(n, "handlers", None) or []:
                    self.define(h.body, owner, inside)

    def class_fields(self, n: ast.ClassDef) -> set[str]:
        """What is assigned as ``self.x``, or as a bare name, anywhere inside the class, its methods included."""
        found = set()
        for x in ast.walk(n):
            for t in x.targets if isinstance(x, ast.Assign) else [x.target] if isinstance(x, ast.AnnAssign) else []:
                if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self":
                    found.add(t.attr)
                elif isinstance(t, ast.Name):
                    found.add(t.id)
        return found

    def find_globals(self, body: list[ast.stmt]) -> None:
        """Names assigned at the module's top level, not under any other statement."""
        for n in body:
            targets = n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) else []
            for t in targets:
                for name in t.elts if isinstance(t, (ast.Tuple, ast.List)) else [t]:
                    if isinstance(name, ast.Name):
                        self.globals[name.id] = self.node("GlobalVariable", (name.id,), name=name.id, code=self.code(n))

    @staticmethod
    def is_main(n: ast.If) -> bool:
        t = n.test
        return isinstance(t, ast.Compare) and isinstance(t.left, ast.Name) and t.left.id == "__name__" and any(isinstance(c, ast.Constant) and c.value == "__main__" for c in t.comparators)

    def relate(self, body: list[ast.stmt], owner: dict | None, cls: str | None, inner: bool = False) -> None:
        """Edges of what a body defines.  ``inner`` bodies, those of functions and of the main block, only give what they define directly and
        without decorators; what a plain ``if`` defines has no edges."""
        for n in body:
            if inner and (not isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) or n.decorator_list):
                continue
            if isinstance(n, ast.ClassDef):
                row = self.nodes["Class", n.name, self.signature(n)]
                self.edge("CONTAINS", self.top, row)
                for base in n.bases:
                    if isinstance(base, ast.Name):  # a class that is not known has no signature, and so matches nothing
                        unknown = {"name": base.id, "type": "Class", "module_name": self.module}
                        self.edge("INHERITS", row, self.imports.get(base.id) or self.classes.get(base.id) or unknown)
                for name in sorted(self.fields[n.name]):
                    self.edge("HAS_FIELD", row, self.node("Field", (name, n.name), name=name, **{"class": n.name}))
                self.uses(row, [x for x in ast.walk(n) if isinstance(x, (ast.Assign, ast.AnnAssign))], None)
                self.relate(n.body, row, n.name)
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                row = self.methods[cls, n.name] if cls else self.nodes["Function", n.name, self.signature(n)]
                if cls:
                    self.edge("HAS_METHOD", self.classes[cls], row)
                else:
                    self.edge("CONTAINS", self.top, row)
                self.uses(row, n.body, cls)
                self.relate(n.body, row, cls, inner=True)
            elif isinstance(n, (ast.Assign, ast.AnnAssign)) and owner is self.top:
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    for name in t.elts if isinstance(t, (ast.Tuple, ast.List)) else [t]:
                        if isinstance(name, ast.Name) and name.id in self.globals:
                            row = self.globals[name.id]
                            self.edge("CONTAINS", self.top, row)
                            if n.value is not None:
                                self.uses(row, [n.value], None)
            elif isinstance(n, (ast.Try, ast.With, ast.AsyncWith, ast.For, ast.AsyncFor, ast.While, ast.Match)):
                for part in (getattr(n, "body", []), getattr(n, "orelse", []), getattr(n, "finalbody", []), *(x.body for x in [*getattr(n, "handlers", []), *getattr(n, "cases", [])])):
                    self.relate(part, None, cls)

    def uses(self, source: dict, body: list[ast.AST], cls: str | None) -> None:
        """What names in a body refer to: an import, else a class, else a called function, else a global; ``self.x`` a field."""
        called = set()
        for part in body:
            for x in ast.walk(part):
                if isinstance(x, ast.Call):
                    if isinstance(x.func, ast.Name):
                        called.add(x.func.id)
        for part in body:
            for x in ast.walk(part):
                target = None
                if isinstance(x, ast.Attribute) and isinstance(x.value, ast.Name) and x.value.id == "self" and cls:
                    if (cls, x.attr) in self.methods:
                        target = self.methods[cls, x.attr]
                    elif x.attr in self.fields.get(cls, ()):
                        target = self.node("Field", (x.attr, cls), name=x.attr, **{"class": cls})
                elif isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load):
                    target = self.imports.get(x.id) or self.classes.get(x.id) or (self.functions.get(x.id) if x.id in called else None) or self.globals.get(x.id)
                if target is not None and target["type"] != "Method" and not (target["type"] == source["type"] == "GlobalVariable" and target is source):
                    self.edge("USES", source, target)


def parse_file(repo: str, ord_: int, module: str, folder: str, package: bool, text: str, skip: frozenset[str]) -> tuple[list[dict], list[dict], str | None]:
    """(nodes, edges, error) of one file; a file that does not parse gives its error and no records."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        return [], [], f"{type(error).__name__}: {error}"
    file = _File(repo, ord_, module, folder, package, text, skip)
    file.run(tree)
    return list(file.nodes.values()), list(file.edges.values()), None


def parse_files(files: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """One row per file of files(repo, path, content, file_ord): (repo, path, file_ord, nodes, edges, error).

    Imports of the standard library and of required(repo, package) are not recorded.  Null content counts as empty.
    """
    known = frozenset(r["package"] for r in stdlib(files.sparkSession).collect())
    rows = files.select("repo", "path", "file_ord", F.coalesce("content", F.lit("")).alias("content"), module_name(F.col("path")).alias("module"), folder_name(F.col("path")).alias("folder"))
    if required is not None:
        packages = required.groupBy("repo").agg(F.collect_set("package").alias("packages"))
        rows = rows.join(packages, "repo", "left")
    else:
        rows = rows.withColumn("packages", F.array().cast("array<string>"))
    # The parser runs once, however often its records are read.
    schema = f"repo string, path string, file_ord int, nodes array<{RAW_NODES.simpleString()}>, edges array<{RAW_EDGES.simpleString()}>, error string"
    names = ([f.name for f in RAW_NODES], [f.name for f in RAW_EDGES])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for r in pdf.itertuples(index=False):
                skip = known.union(r.packages) if r.packages is not None else known
                nodes, edges, error = parse_file(r.repo, r.file_ord, r.module, r.folder, r.path.endswith("__init__.py"), r.content, skip)
                out.append((r.repo, r.path, r.file_ord, [{k: n.get(k) for k in names[0]} for n in nodes], [{k: e.get(k) for k in names[1]} for e in edges], error))
            yield pd.DataFrame(out, columns=["repo", "path", "file_ord", "nodes", "edges", "error"])

    return written(rows.mapInPandas(run, schema), "parsed")


def raw_records(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(raw nodes, raw edges, error rows) of parse_files."""
    ok = parsed.where("error IS NULL")
    return ok.select(F.inline("nodes")), ok.select(F.inline("edges")), parsed.where("error IS NOT NULL").select("repo", "path", "error")
