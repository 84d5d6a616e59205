"""What Python code says of requests and responses: fields a handler reads, statuses it answers with, model classes, and bodies that tests send."""

from __future__ import annotations

import ast

# Where a request's body is read from, and names that guard a route.
BODY_SOURCES = ("get_json", "json", "form", "data")
PLACES = {"args": "query", "headers": "header", "form": "body"}
GUARDS = ("auth", "login", "jwt", "token")
#: Types of annotations by the word they hold, the first that fits.
TYPE_WORDS = (("str", "string"), ("int", "number"), ("float", "number"), ("decimal", "number"), ("bool", "boolean"), ("list", "array"), ("dict", "object"))
CASTS = {"int": "integer", "float": "number", "bool": "boolean", "str": "string"}


def _tree(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None


def _handler(tree: ast.Module | None, name: str):
    found = (n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name == name) if tree else ()
    return next(iter(found), None)


def _constant(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _request_part(node: ast.AST) -> str | None:
    """``x`` of ``request.x``, called or not, awaited or not."""
    node = node.value if isinstance(node, ast.Await) else node
    node = node.func if isinstance(node, ast.Call) else node
    if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id == "request":
        return node.attr
    return None


def _bodies(node: ast.AST) -> set[str]:
    """Names that hold the request's body."""
    names = set()
    for n in ast.walk(node):
        value = n.value if isinstance(n, ast.Assign) else None
        value = value.values[0] if isinstance(value, ast.BoolOp) else value  # request.get_json() or {}
        if value is not None and _request_part(value) in BODY_SOURCES:
            names |= {t.id for t in n.targets if isinstance(t, ast.Name)}
    return names


def _place(owner: ast.AST, bodies: set[str]) -> str | None:
    if isinstance(owner, ast.Name) and owner.id in bodies:
        return "body"
    part = _request_part(owner)
    return PLACES.get(part) or ("body" if part in BODY_SOURCES else None)


def _read(node: ast.AST, bodies: set[str]) -> tuple[str, str, bool] | None:
    """``(place, field, required)`` of a subscript, of ``get``, or of a membership test."""
    if isinstance(node, ast.Subscript) and (field := _constant(node.slice)) and (place := _place(node.value, bodies)):
        return place, field, True
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "get" and node.args and (field := _constant(node.args[0])) and (place := _place(node.func.value, bodies)):
        return place, field, False
    if isinstance(node, ast.Compare) and isinstance(node.ops[0], ast.NotIn) and (field := _constant(node.left)) and (place := _place(node.comparators[0], bodies)):
        return place, field, True
    return None


def request_fields(text: str, handler: str) -> list[dict]:
    """``place, name, type, required, line`` of what a handler reads: of the body, the query and headers; and ``auth`` where a decorator guards it.

    A subscript or a test that something is missing makes a field required. A cast around a read, or a ``type`` beside it, gives its type.
    """
    node = _handler(_tree(text), handler)
    if node is None:
        return []
    bodies, found = _bodies(node), {}
    casts = {id(n.args[0]): CASTS[n.func.id] for n in ast.walk(node) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in CASTS and n.args}
    missing = {id(n.operand) for n in ast.walk(node) if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not)}
    for n in ast.walk(node):
        if read := _read(n, bodies):
            place, name, required = read
            hint = next((k.value.id for k in n.keywords if k.arg == "type" and isinstance(k.value, ast.Name)), None) if isinstance(n, ast.Call) else None
            kind = casts.get(id(n)) or CASTS.get(hint or "", "string")
            row = found.setdefault((place, name), {"place": place, "name": name, "type": kind, "required": False, "line": n.lineno})
            row["required"] |= required or id(n) in missing
            row["type"] = kind if kind != "string" else row["type"]
            row["line"] = min(row["line"], n.lineno)
    for d in node.decorator_list:
        if any(g in ast.unparse(d).lower() for g in GUARDS):
            found.setdefault(("auth", "Authorization"), {"place": "auth", "name": "Authorization", "type": "string", "required": True, "line": d.lineno})
    return sorted(found.values(), key=lambda r: (r["line"], r["place"], r["name"]))


def _shape(node: ast.AST | None) -> str:
    """The type of a response's body."""
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "jsonify":
        return "object" if node.keywords or not node.args else _shape(node.args[0])
    if isinstance(node, (ast.Dict, ast.DictComp)):
        return "object"
    if isinstance(node, (ast.List, ast.ListComp)):
        return "array"
    if isinstance(node, ast.Constant) and node.value is not None:
        return {bool: "boolean", int: "number", float: "number", str: "string"}.get(type(node.value), "unknown")
    return "unknown"


def _number(node: ast.AST | None) -> int | None:
    return node.value if isinstance(node, ast.Constant) and type(node.value) is int else None


def _failure(node: ast.AST) -> int | None:
    """The status of ``abort(…)`` and of ``HTTPException(…)``."""
    if not isinstance(node, ast.Call):
        return None
    name = node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", "")
    if name not in ("abort", "HTTPException"):
        return None
    named = next((k.value for k in node.keywords if k.arg == "status_code"), None)
    return _number(named or (node.args[0] if node.args else None))


def responses(text: str, handler: str, method: str | None = None) -> list[dict]:
    """``status, shape, line`` of a handler's answers; of two with one status the later stays. Without a status of its own an answer has the method's."""
    node = _handler(_tree(text), handler)
    found: dict[str, dict] = {}
    usual = {"POST": "201", "DELETE": "204"}.get((method or "").upper(), "200")
    for n in sorted((x for x in ast.walk(node) if hasattr(x, "lineno")), key=lambda x: (x.lineno, x.col_offset)) if node else ():
        if isinstance(n, ast.Return) and n.value is not None:
            pair = n.value.elts if isinstance(n.value, ast.Tuple) and len(n.value.elts) > 1 else [n.value, None]
            status = _number(pair[1])
            found[str(status or usual)] = {"status": str(status or usual), "shape": _shape(pair[0]), "line": n.lineno}
        elif status := _failure(n):
            found[str(status)] = {"status": str(status), "shape": "unknown", "line": n.lineno}
    return sorted(found.values(), key=lambda r: r["status"])


def model_fields(text: str) -> list[dict]:
    """``model, field, type, line`` of classes that derive from a base model."""
    out = []
    for n in ast.walk(_tree(text) or ast.Module([], [])):
        if isinstance(n, ast.ClassDef) and any("basemodel" in ast.unparse(b).lower() for b in n.bases):
            for f in n.body:
                if isinstance(f, ast.AnnAssign) and isinstance(f.target, ast.Name):
                    said = ast.unparse(f.annotation).lower()
                    out.append({"model": n.name, "field": f.target.id, "type": next((t for w, t in TYPE_WORDS if w in said), "unknown"), "line": f.lineno})
    return sorted(out, key=lambda r: r["line"])


def _value_type(value) -> str:
    for kinds, name in (((bool,), "boolean"), ((int, float), "number"), ((str,), "string"), ((dict,), "object"), ((list,), "array")):
        if isinstance(value, kinds):
            return name
    return "unknown"


def payloads(text: str) -> list[dict]:
    """``method, path, field, type, line`` of literal bodies that a test client sends."""
    out = []
    for n in ast.walk(_tree(text) or ast.Module([], [])):
        if not (isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in ("post", "put", "patch") and ast.unparse(n.func.value).split(".")[-1].lower().endswith("client") and n.args):
            continue
        path, body = _constant(n.args[0]), next((k.value for k in n.keywords if k.arg == "json"), None)
        if not path or not path.startswith("/") or not isinstance(body, ast.Dict):
            continue
        try:
            fields = ast.literal_eval(body)
        except (ValueError, TypeError):
            continue
        out += [{"method": n.func.attr.upper(), "path": path, "field": k, "type": _value_type(v), "line": n.lineno} for k, v in fields.items() if isinstance(k, str)]
    return sorted(out, key=lambda r: (r["line"], r["field"]))
