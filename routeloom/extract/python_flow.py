"""What a Python handler does, step by step, from its syntax tree."""

from __future__ import annotations

import ast
import re

_STATUS = re.compile(r",\s*\d{3}$")
_INPUT = re.compile(r"request\.(get_json|json|args|form|values|files|headers)")
_READ, _WRITE = ("query", "get", "filter", "filter_by", "first", "all", "scalar", "scalars", "one"), ("add", "commit", "delete", "merge", "flush", "refresh", "save", "insert", "update")
_CLIENTS = ("requests", "httpx", "client")
_VERBS = ("get", "post", "put", "patch", "delete")


def _flat(node: ast.AST | None) -> str:
    return " ".join(ast.unparse(node).split()) if node is not None else ""


class _Flow(ast.NodeVisitor):
    def __init__(self) -> None:
        self.steps: list[tuple[int, str, str]] = []

    def add(self, node: ast.AST, kind: str, name: str, shift: int = 0) -> None:
        self.steps.append((getattr(node, "lineno", 0) + shift, kind, name))

    def visit_Return(self, node: ast.Return) -> None:
        said = _flat(node.value)
        if "jsonify(" in said:
            self.add(node, "response", "return JSON response")
        elif _STATUS.search(said) or re.search(r"\)\s*,\s*\d{3}$", said.rstrip(")")):
            self.add(node, "response", "return response with status code")
        elif said[:1] in ("{", "["):
            self.add(node, "response", "return response body")
        self.generic_visit(node)

    def visit_Raise(self, node: ast.Raise) -> None:
        self.add(node, "error", "raise error")
        self.generic_visit(node)

    def visit_If(self, node: ast.If) -> None:
        self.add(node, "validation", f"if {_flat(node.test)}")
        self.generic_visit(node)

    def visit_Delete(self, node: ast.Delete) -> None:
        for t in node.targets:
            self.add(node, "store_write", f"delete {_flat(t)}")

    def visit_Assign(self, node: ast.Assign) -> None:
        if m := _INPUT.search(_flat(node.value)):
            self.add(node, "input", f"read {'JSON request body' if m[1] == 'get_json' else 'request ' + m[1]}")
        if isinstance(node.value, ast.Call) and isinstance(node.value.func, ast.Name) and node.value.func.id[:1].isupper():
            self.add(node, "transform", f"create {node.value.func.id} object")
        for t in node.targets:
            if isinstance(t, ast.Subscript):
                self.add(node, "store_write", f"assign {_flat(t)}")
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        if isinstance(node.func, ast.Attribute):
            base, verb = _flat(node.func.value), node.func.attr
            root = base.split(".")[0].split("(")[0]
            if root in ("db", "session") or base.endswith(".session"):
                kind = "db_write" if verb in _WRITE else "db_read" if verb in _READ else None
                if kind:
                    self.add(node, kind, f"{root}.{verb}")
            elif root in _CLIENTS and verb in _VERBS:
                self.add(node, "external_api_call", f"{base}.{verb}")
        self.generic_visit(node)


def handler_steps(text: str, handler: str, method: str | None = None) -> list[dict]:
    """``line, seq, kind, name`` of the steps of function ``handler``, in order of line; nothing if the text does not parse or has no such function."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    node = next((n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name == handler), None)
    if node is None:
        return []
    flow = _Flow()
    for default in [*node.args.defaults, *[d for d in node.args.kw_defaults if d]]:
        if isinstance(default, ast.Call) and _flat(default.func).split(".")[-1] == "Depends" and default.args:
            flow.add(node, "dependency", f"Depends({_flat(default.args[0])})", -2)
    if (method or "").upper() in ("POST", "PUT", "PATCH"):
        typed = next((a for a in node.args.args if a.arg != "self" and a.annotation is not None and "session" not in _flat(a.annotation).lower()), None)
        if typed:
            flow.add(node, "input_model", f"input model: {_flat(typed.annotation)}", -1)
    for stmt in node.body:
        flow.visit(stmt)
    ordered = sorted(enumerate(flow.steps), key=lambda s: (s[1][0], s[0]))
    return [{"line": line, "seq": i, "kind": kind, "name": name} for i, (_, (line, kind, name)) in enumerate(ordered, 1)]


def returning_fields(text: str) -> list[str]:
    """Columns after ``RETURNING`` in SQL literals, sorted."""
    found = re.findall(r"\breturning\s+([A-Za-z_*][\w\s,.*]*)", text, re.I)
    return sorted({f.split(".")[-1].split()[0] for part in found for f in part.split(",") if f.strip() and f.strip() != "*"})


def body_fields(text: str) -> list[tuple[str, bool]]:
    """``(field, required)`` of a request body: subscripts are required, ``get`` is not."""
    out: dict[str, bool] = {}
    for m in re.finditer(r"\b(?:data|payload|body)(?:\[\s*['\"](\w+)['\"]\s*\]|\.get\(\s*['\"](\w+)['\"])", text):
        out[m[1] or m[2]] = out.get(m[1] or m[2], False) or bool(m[1])
    return list(out.items())
