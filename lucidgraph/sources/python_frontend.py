"""Facts from Python source: scopes, definitions, references, imports and function collections of one file.

Positions are 1-based; an end column is the last column. Columns count characters, not bytes.
"""

from __future__ import annotations

import ast

from lucidgraph.schema import ANONYMOUS, MODULE

#: Kinds in the order in which definitions of one name follow each other; the last wins.
_ORDER = {k: i for i, k in enumerate(("function", "class", "variable", "constant", "interface", "enum", "namespace", "type", "import", "constructor", "method", "property", "parameter"))}
_BUILTIN_BASES = {"Protocol": "interface", "Enum": "enum", "IntEnum": "enum", "StrEnum": "enum", "Flag": "enum"}


class Extractor(ast.NodeVisitor):
    def __init__(self, path: str, content: str):
        self.path, self.lines = path, content.split("\n")
        self.scopes: list[dict] = []
        self.definitions: list[dict] = []
        self.references: list[dict] = []
        self.imports: list[dict] = []
        self.collections: list[dict] = []
        self.n = 0
        self.inside: list[tuple[str, str, str | None]] = []  # scope id, scope type, class symbol
        root = {"start_line": 1, "start_column": 1, "end_line": len(self.lines), "end_column": len(self.lines[-1])}
        self.inside.append((self._scope("module", MODULE, root, None), "module", None))
        self.called: set[int] = set()

    # positions and rows

    def _column(self, line: int, offset: int) -> int:
        text = self.lines[line - 1] if line <= len(self.lines) else ""
        return offset if text.isascii() else len(text.encode()[:offset].decode(errors="ignore"))

    def _span(self, node: ast.AST) -> dict:
        return {"start_line": node.lineno, "start_column": self._column(node.lineno, node.col_offset) + 1, "end_line": node.end_lineno, "end_column": self._column(node.end_lineno, node.end_col_offset)}

    def _named(self, node: ast.AST, before: str, name: str) -> dict:
        start = self._column(node.lineno, node.col_offset) + 1 + len(before)
        return {"start_line": node.lineno, "start_column": start, "end_line": node.lineno, "end_column": start + len(name) - 1}

    def _id(self, kind: str, span: dict, *name: str) -> str:
        return ":".join(map(str, (kind, self.path, span["start_line"], span["start_column"], span["end_line"], span["end_column"], *name)))

    def _next(self) -> int:
        self.n += 1
        return self.n

    def _scope(self, kind: str, name: str | None, span: dict, parent: str | None) -> str:
        id_ = self._id(kind, span)
        self.scopes.append({"scope_id": id_, "file_path": self.path, "parent_id": parent, "name": name, "type": kind, "ord": self._next(), **span})
        return id_

    def _define(self, kind: str, name: str, span: dict, **more) -> str:
        id_ = self._id(kind, span, name)
        scope = more.pop("scope", self.inside[-1][0])
        at_root = scope == self.inside[0][0]
        public = at_root and (not name.startswith("_") or name.startswith("__") and name.endswith("__"))
        exported = public and kind in ("function", "class", "interface", "enum", "variable", "constant")
        self.definitions.append({"symbol_id": id_, "kind": kind, "name": name, "file_path": self.path, "ord": _ORDER[kind] * 10_000_000 + self._next(), "defining_scope_id": scope, "is_exported": exported, **span, **more})
        return id_

    def _refer(self, kind: str, name: str, node: ast.AST, **more) -> None:
        self.references.append({"file_path": self.path, "ord": self._next(), "kind": kind, "name": name, "scope_id": self.inside[-1][0], **self._span(node), **more})

    # definitions

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        span = self._named(node, "class ", node.name)
        bases = [ast.unparse(b).split("[")[0] for b in node.bases]
        kind = next((_BUILTIN_BASES[b.split(".")[-1]] for b in bases if b.split(".")[-1] in _BUILTIN_BASES), "class")
        for d in [*node.decorator_list, *node.bases, *[k.value for k in node.keywords]]:
            self.visit(d)
        body = self._scope("class", node.name, self._span(node), self.inside[-1][0])
        id_ = self._define(kind, node.name, span, extends=bases, decorators=[ast.unparse(d) for d in node.decorator_list], docstring=ast.get_docstring(node), body_scope_id=body)
        self.inside.append((body, "class", id_))
        for child in node.body:
            self.visit(child)
        self.inside.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        before = "async def " if isinstance(node, ast.AsyncFunctionDef) else "def "
        owner = self.inside[-1][2] if self.inside[-1][1] == "class" else None
        kind = "function" if owner is None else "constructor" if node.name == "__init__" else "method"
        marks = [ast.unparse(d) for d in node.decorator_list]
        names = {m.split("(")[0].split(".")[-1] for m in marks}
        abstract = bool(names & {"abstractmethod", "classmethod"})
        for d in [*node.decorator_list, *node.args.defaults, *[d for d in node.args.kw_defaults if d]]:
            self.visit(d)
        scope = self._scope(kind, node.name, self._span(node), self.inside[-1][0])
        span = self._named(node, before, node.name)
        id_ = self._define(
            kind, node.name, span, owner_id=owner, body_scope_id=None if abstract else scope, return_type=ast.unparse(node.returns) if node.returns else None, decorators=marks,
            docstring=ast.get_docstring(node), static="staticmethod" in names, abstract=abstract, **{"async": before != "def "},
        )
        self.inside.append((scope, kind, owner))
        self.definitions[-1]["parameters"] = self._parameters(node.args, id_)
        in_init, self.in_init = getattr(self, "in_init", None), owner if kind == "constructor" else None
        for child in node.body:
            self.visit(child)
        self.in_init = in_init
        self.inside.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def _parameters(self, args: ast.arguments, owner: str) -> list[dict]:
        out, row = [], len(self.definitions) - 1
        plain = [*args.posonlyargs, *args.args]
        defaults = dict(zip([a.arg for a in plain][len(plain) - len(args.defaults) :], args.defaults, strict=True)) | {a.arg: d for a, d in zip(args.kwonlyargs, args.kw_defaults, strict=True) if d}
        for a in [*plain, *([args.vararg] if args.vararg else []), *args.kwonlyargs, *([args.kwarg] if args.kwarg else [])]:
            kind = "tuple" if a is args.vararg else "dict" if a is args.kwarg else ast.unparse(a.annotation) if a.annotation else None
            id_ = self._define("parameter", a.arg, self._span(a) | {"end_column": self._span(a)["start_column"] + len(a.arg) - 1}, owner_id=owner, type_name=kind)
            out.append({"symbol_id": id_, "name": a.arg, "type": kind, "default_value": ast.unparse(defaults[a.arg]) if a.arg in defaults else None, "optional": a.arg in defaults})
        # the callable's own row stays the last that the caller of this fills in
        self.definitions.append(self.definitions.pop(row))
        return out

    def visit_Lambda(self, node: ast.Lambda, call: ast.Call | None = None) -> str:
        span = self._span(node)
        scope = self._scope("function", None, span, self.inside[-1][0])
        at = self._span(call) if call else None
        id_ = self._define("function", ANONYMOUS, span, body_scope_id=scope, callback={"is_callback": True, "receiver_line": at["start_line"], "receiver_column": at["start_column"]} if at else None)
        self.definitions[-1]["is_exported"] = False
        self.inside.append((scope, "function", None))
        self.definitions[-1]["parameters"] = self._parameters(node.args, id_)
        self.visit(node.body)
        self.inside.pop()
        return id_

    def _assign(self, target: ast.AST, value: ast.AST | None, annotation: ast.AST | None) -> None:
        said = ast.unparse(annotation) if annotation else None
        called = value.func.id if isinstance(value, ast.Call) and isinstance(value.func, ast.Name) else None
        if isinstance(target, ast.Name):
            in_class = self.inside[-1][1] == "class"
            kind = "property" if in_class else "constant" if target.id == target.id.upper() and "_" in target.id else "variable"
            source = None
            if isinstance(value, ast.Call) and isinstance(value.func, ast.Attribute) and value.func.attr == "get" and isinstance(value.func.value, ast.Name):
                source = value.func.value.id
            elif isinstance(value, ast.Subscript) and isinstance(value.value, ast.Name):
                source = value.value.id
            id_ = self._define(kind, target.id, self._span(target), type_name=said, initialized_from_call=called, collection_source=source, owner_id=self.inside[-1][2] if in_class else None, initial_value=ast.unparse(value)[:200] if value else None)
            self._collect(id_, value)
        elif isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self" and getattr(self, "in_init", None):
            text = ast.unparse(value.func) if isinstance(value, ast.Call) else None
            self._define("property", target.attr, self._span(target), type_name=said or text, owner_id=self.in_init)
        elif isinstance(target, (ast.Tuple, ast.List)):
            for t in target.elts:
                self._assign(t.value if isinstance(t, ast.Starred) else t, None, None)
        elif not isinstance(target, ast.Name):
            self.visit(target)

    def _collect(self, id_: str, value: ast.AST | None) -> None:
        if isinstance(value, ast.Dict):
            members = [(ast.unparse(k) if k else None, v, k is None) for k, v in zip(value.keys, value.values, strict=True)]
        elif isinstance(value, (ast.List, ast.Tuple, ast.Set)):
            members = [(None, v.value if isinstance(v, ast.Starred) else v, isinstance(v, ast.Starred)) for v in value.elts]
        else:
            return
        for i, (key, v, spread) in enumerate(members):
            kind = {ast.Dict: "dict", ast.List: "list", ast.Tuple: "tuple", ast.Set: "set"}[type(value)]
            row = {"collection_id": id_, "file_path": self.path, "scope_id": self.inside[-1][0], "collection_type": kind, "member_ord": i, "member_key": "*" if spread else key}
            if isinstance(v, ast.Lambda):
                self.collections.append(row | {"stored_function_id": self._id("function", self._span(v), ANONYMOUS)})
            elif isinstance(v, ast.Name):
                self.collections.append(row | {"stored_reference": v.id})

    def visit_Assign(self, node: ast.Assign) -> None:
        self.visit(node.value)
        for t in node.targets:
            self._assign(t, node.value, None)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if node.value:
            self.visit(node.value)
        self._type(node.annotation)
        self._assign(node.target, node.value, node.annotation)

    def _type(self, node: ast.AST) -> None:
        for x in ast.walk(node):
            if isinstance(x, ast.Name):
                self._refer("type_reference", x.id, x)

    def visit_For(self, node: ast.For) -> None:
        self.visit(node.iter)
        self._assign(node.target, None, None)
        for child in [*node.body, *node.orelse]:
            self.visit(child)

    visit_AsyncFor = visit_For

    def visit_With(self, node: ast.With) -> None:
        for item in node.items:
            self.visit(item.context_expr)
            if item.optional_vars is not None:
                self._assign(item.optional_vars, item.context_expr, None)
        for child in node.body:
            self.visit(child)

    visit_AsyncWith = visit_With

    def _import(self, node: ast.AST, name: str, module: str, level: int, kind: str, original: str | None) -> None:
        span = self._span(node)
        at_root = len(self.inside) == 1
        self.imports.append(
            {
                "symbol_id": self._id("import", span, name), "name": name, "file_path": self.path, "ord": self._next(), "defining_scope_id": self.inside[-1][0], "import_path": "." * level + module,
                "import_kind": kind, "original_name": original, "is_reexport": at_root, **span,
            }
        )

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self._import(a, a.asname or a.name.split(".")[0], a.name if a.asname else a.name, 0, "namespace", None)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            if a.name != "*":
                self._import(a, a.asname or a.name, node.module or "", node.level, "named", a.name)

    # references

    def visit_Call(self, node: ast.Call) -> None:
        f = node.func
        if isinstance(f, ast.Name):
            self._refer("function_call", f.id, node, property_chain=[f.id])
        elif isinstance(f, ast.Attribute):
            chain, base = [f.attr], f.value
            while isinstance(base, ast.Attribute):
                chain.insert(0, base.attr)
                base = base.value
            if isinstance(base, ast.Name):
                word = base.id if base.id in ("self", "cls") else None
                self._refer("self_reference_call" if word else "method_call", f.attr, node, keyword=word, property_chain=[base.id, *chain])
                if not word:
                    self._refer("variable_reference", base.id, base, access_type="read")
            elif isinstance(base, ast.Call) and isinstance(base.func, ast.Name) and base.func.id == "super":
                self._refer("self_reference_call", f.attr, node, keyword="super", property_chain=["super", *chain])
            else:
                self.visit(f.value)
        else:
            self.visit(f)
        for a in [*node.args, *[k.value for k in node.keywords]]:
            if isinstance(a, ast.Lambda):
                self.visit_Lambda(a, node)
            else:
                self.visit(a)

    def visit_Attribute(self, node: ast.Attribute) -> None:
        self._refer("property_access", node.attr, node, access_type="write" if isinstance(node.ctx, ast.Store) else "read")
        self.visit(node.value)

    def visit_Name(self, node: ast.Name) -> None:
        if isinstance(node.ctx, ast.Load):
            self._refer("variable_reference", node.id, node, access_type="read")


def extract(path: str, content: str) -> dict[str, list[dict]]:
    """Rows of each fact table; raises SyntaxError as the parser does."""
    found = Extractor(path, content)
    for node in ast.parse(content).body:
        found.visit(node)
    return {"scope": found.scopes, "definition": found.definitions, "reference": found.references, "import_def": found.imports, "function_collection": found.collections}
