"""Symbols, references and imports of source files.

Python is read by the interpreter's own parser where it parses; the other
languages by a scanner that blanks comments and strings and follows brackets,
which is an approximation of a full parse. One pass, no shuffle of contents.
"""

from __future__ import annotations

import ast
import bisect
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

LANGUAGE = {"rs": "rust", "py": "python", "ts": "ts", "tsx": "ts", "js": "ts", "jsx": "ts", "mjs": "ts", "cjs": "ts", "go": "go"}

_BLANK = {
    "python": r"\#[^\n]*|'''(?:\\.|[^\\])*?'''|\"\"\"(?:\\.|[^\\])*?\"\"\"|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"",
    "rust": r"//[^\n]*|/\*.*?\*/|r(\#*)\".*?\"\1|\"(?:\\.|[^\"\\])*\"|'(?:\\[^\n]+?|[^'\\\n])'",
    "go": r"//[^\n]*|/\*.*?\*/|`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\[^\n]+?|[^'\\\n])'",
    "ts": r"//[^\n]*|/\*.*?\*/|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"",
}
_BLANK = {k: re.compile(v, re.S) for k, v in _BLANK.items()}

_DECLARE = {
    "rust": [
        ("Function", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\S+\s+)?fn\s+(\w+)"),
        ("Struct", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"),
        ("Enum", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"),
        ("Trait", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)"),
        ("TypeAlias", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?type\s+(\w+)"),
        ("Module", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)"),
    ],
    "go": [("Method", r"^func\s+\([^)\n]*\)\s*(\w+)\s*\("), ("Function", r"^func\s+(\w+)\s*[\[(]"), ("Struct", r"^type\s+(\w+)[^\n=]*?\bstruct\b"), ("Trait", r"^type\s+(\w+)[^\n=]*?\binterface\b"), ("TypeAlias", r"^type\s+(\w+)\s+(?!struct|interface)")],
    "ts": [
        ("Function", r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([\w$]+)"),
        ("Function", r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+([\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?=\(|function\b)"),
        ("Struct", r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([\w$]+)"),
        ("Trait", r"^[ \t]*(?:export\s+)?interface\s+([\w$]+)"),
        ("Enum", r"^[ \t]*(?:export\s+)?(?:const\s+)?enum\s+([\w$]+)"),
        ("TypeAlias", r"^[ \t]*(?:export\s+)?type\s+([\w$]+)[^=\n]*="),
        ("Method", r"^[ \t]+(?:(?:public|private|protected|static|async|override|get|set)\s+)*\*?([\w$]+)\s*(?:<[^>\n(]*>)?\([^;{}]*\)\s*(?::[^;{}=]*(?:<[^;{}]*>)?)?\{"),
    ],
}
_DECLARE = {k: [(kind, re.compile(p, re.M)) for kind, p in v] for k, v in _DECLARE.items()}
_IMPORTS = {
    "rust": re.compile(r"^[ \t]*(?:pub\s+)?use\s+([^;]+);", re.M),
    "go": re.compile(r"^import\s+(?:\(([^)]*)\)|((?:[\w.]+\s+)?\"[^\"]+\"))", re.M),
    "ts": re.compile(r"^[ \t]*import\s+(?:type\s+)?(?:([^'\"]+?)\s+from\s+)?['\"]([^'\"]+)['\"]", re.M),
}
_CALL = re.compile(r"\b([A-Za-z_$][\w$]*)\s*(?:::<[^>\n]*>)?\(")
_NO_CALL = frozenset("if for while match switch return catch function fn func typeof new in of else loop await yield and or not print lambda with assert del raise except elif def class Some Ok Err".split())


def _end(code: str, at: int) -> int:
    """Offset after the block that opens at or after `at`, or after its statement."""
    depth = 0
    for m in re.compile(r"[{}();]").finditer(code, at):
        c = m.group()
        if c in "{(":
            depth += 1
        elif c in "})":
            depth -= 1
            if depth <= 0 and c == "}":
                return m.end()
        elif depth == 0:
            return m.end()
    return len(code)


def _rust_tree(text: str, prefix: str = "") -> Iterator[tuple[str, str | None, str, bool]]:
    text = text.strip()
    m = re.match(r"^([^{}]*?)(?:::)?\{(.*)\}$", text, re.S)
    if m:
        head = "::".join(x for x in (prefix, m.group(1).strip().rstrip(":")) if x)
        depth, start, body = 0, 0, m.group(2)
        for i, c in enumerate([*body, ","]):
            depth += (c == "{") - (c == "}")
            if c == "," and depth == 0:
                if body[start:i].strip():
                    yield from _rust_tree(body[start:i], head)
                start = i + 1
        return
    path, _, alias = text.partition(" as ")
    full = "::".join(x for x in (prefix, path.strip()) if x)
    module, _, last = full.rpartition("::")
    if last == "*":
        yield module, None, "*", True
    elif last == "self":
        yield module, None, alias.strip() or module.rpartition("::")[2], False
    else:
        yield module or full, last, alias.strip() or last, False


def imports_of(path: str, text: str) -> list[tuple[str, str | None, str, bool]]:
    """(module, imported name, local name, wildcard) of a file."""
    lang = LANGUAGE.get(path.rsplit(".", 1)[-1].lower())
    out: list[tuple[str, str | None, str, bool]] = []
    if lang == "python":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(text.lstrip("\ufeff"))
        except (SyntaxError, ValueError, RecursionError):
            return out
        for n in ast.walk(tree):
            if isinstance(n, ast.Import):
                for a in n.names:
                    out.append((a.name, None, a.asname or a.name, False))
                    if not a.asname and "." in a.name:
                        out.append((a.name, None, a.name.split(".")[0], False))
            elif isinstance(n, ast.ImportFrom):
                module = "." * n.level + (n.module or "")
                out.extend((module, None if a.name == "*" else a.name, a.asname or a.name, a.name == "*") for a in n.names)
        return out
    if lang is None:
        return out
    for m in _IMPORTS[lang].finditer(text):
        if lang == "rust":
            out.extend(_rust_tree(m.group(1)))
        elif lang == "go":
            for alias, spec in re.findall(r"(?:([\w.]+)[ \t]+)?\"([^\"]+)\"", m.group(1) or m.group(2)):
                out.append((spec, None, alias or spec.rsplit("/", 1)[-1], alias == "."))
        else:
            clause, spec = m.group(1) or "", m.group(2)
            for star in re.findall(r"\*\s+as\s+([\w$]+)", clause):
                out.append((spec, None, star, True))
            for braces in re.findall(r"\{([^}]*)\}", clause):
                for part in braces.split(","):
                    names = part.replace("type ", "").split(" as ")
                    if names[0].strip():
                        out.append((spec, names[0].strip(), names[-1].strip(), False))
            default = re.match(r"\s*([\w$]+)\s*(?:,|$)", clause)
            if default:
                out.append((spec, "default", default.group(1), False))
    return out


def symbols_of(path: str, text: str) -> list[dict]:
    """Symbols of a file in order, each with the names it calls."""
    lang = LANGUAGE.get((path or "").rsplit(".", 1)[-1].lower())
    if lang is None or not text:
        return []
    bom = text.startswith("\ufeff")
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    row = lambda p: bisect.bisect_right(starts, p) - 1
    out: list[dict] = []

    def add(kind: str, name: str, a: int, b: int, signature: str, doc: str | None, container: str | None, trait: str | None, calls: list[str]) -> None:
        out.append(
            {
                "name": name, "kind": kind, "start_byte": len(text[:a].encode()), "end_byte": len(text[:b].encode()), "start_row": row(a), "end_row": row(max(b - 1, a)),
                "signature": re.sub(r"\s+", " ", signature).strip(), "docstring": doc, "container_name": container, "trait_name": trait, "calls": sorted(set(calls)),
            }
        )

    if lang == "python":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(text.lstrip("\ufeff"))
        except (SyntaxError, ValueError, RecursionError):
            return []
        shift = int(bom)

        def walk(node: ast.AST, container: str | None) -> None:
            for n in ast.iter_child_nodes(node):
                if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    line = text[starts[n.lineno - 1] : starts[n.lineno] if n.lineno < len(starts) else len(text)]
                    a = starts[n.lineno - 1] + len(line) - len(line.lstrip(" \t\ufeff")) + (shift if n.lineno == 1 else 0) * 0
                    last = n.end_lineno or n.lineno
                    b = starts[last] if last < len(starts) else len(text)
                    body = starts[n.body[0].lineno - 1] if n.body and n.body[0].lineno > n.lineno else b
                    kind = "Struct" if isinstance(n, ast.ClassDef) else "Method" if container else "Function"
                    calls = [] if isinstance(n, ast.ClassDef) else [c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in ast.walk(n) if isinstance(c, ast.Call) and isinstance(c.func, (ast.Name, ast.Attribute))]
                    add(kind, n.name, a, b, text[a:body].rstrip().rstrip(":"), ast.get_docstring(n), container, None, calls)
                    walk(n, n.name if isinstance(n, ast.ClassDef) else container if container else None)

        walk(tree, None)
        return out
    code = _BLANK[lang].sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    blocks: list[tuple[int, int, str, str | None]] = []
    if lang == "rust":
        for m in re.finditer(r"^[ \t]*(?:unsafe\s+)?impl\b(?:\s*<[^{;]*?>)?\s*(?:([\w:]+)(?:<[^{;]*?>)?\s+for\s+)?([\w:]+)", code, re.M):
            blocks.append((m.start(), _end(code, m.end()), m.group(2).rsplit("::", 1)[-1], m.group(1).rsplit("::", 1)[-1] if m.group(1) else None))
        for m in re.finditer(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)", code, re.M):
            blocks.append((m.start(), _end(code, m.end()), m.group(1), None))
    elif lang == "ts":
        for m in re.finditer(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([\w$]+)", code, re.M):
            blocks.append((m.start(), _end(code, m.end()), m.group(1), None))
    found: dict[int, tuple] = {}
    for kind, rx in _DECLARE[lang]:
        for m in rx.finditer(code):
            if kind == "Method" and m.group(1) in _NO_CALL | {"constructor"}:
                continue
            a = m.start() + len(m.group()) - len(m.group().lstrip())
            found.setdefault(a, (kind, m.group(1), m.end()))
    for a, (kind, name, after) in sorted(found.items()):
        b = _end(code, a)
        inside = [x for x in blocks if x[0] < a < x[1]]
        container, trait = (inside[-1][2], inside[-1][3]) if inside else (None, None)
        if lang == "go" and kind == "Method":
            r = re.match(r"func\s+\(\s*\w*\s*\*?\s*(\w+)", code[a:after])
            container = r.group(1) if r else None
        if kind == "Method" and lang == "ts" and not inside:
            continue
        if kind == "Function" and inside and lang == "rust":
            kind = "Method"
        brace = code.find("{", a, b)
        signature = text[a : brace if brace >= 0 else b].rstrip("; \n")
        above = text[:a].rstrip(" \t").split("\n")[:-1]
        doc: list[str] = []
        while above and re.match(r"\s*(?://|/\*|\*|#\[)", above[-1]):
            line = above.pop().strip()
            if not line.startswith("#["):
                doc.append(re.sub(r"^(?:///?!?|/\*+|\*+/?)\s?|\s*\*/$", "", line))
        calls = [c for c in _CALL.findall(code[brace:b]) if c not in _NO_CALL] if kind in ("Function", "Method") and brace >= 0 else []
        add(kind, name, a, b, signature, "\n".join(x for x in reversed(doc) if x) or None, container, trait, calls)
    return out


SYMBOL_SCHEMA = (
    "file_id bigint, file_path string, local_id int, name string, kind string, start_byte bigint, end_byte bigint, start_row bigint, end_row bigint, signature string, docstring string, container_name string, trait_name string, calls array<string>"
)
IMPORT_SCHEMA = "file_id bigint, file_path string, module_specifier string, imported_name string, local_name string, is_wildcard boolean"


def parse_symbols(files: DataFrame) -> DataFrame:
    """Symbols of all files (file_id, file_path, content); null content has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SYMBOL_SCHEMA.split(", ")]
        for b in batches:
            rows = [(fid, path, n, *(s[k] for k in names[3:])) for fid, path, text in zip(b["file_id"], b["file_path"], b["content"], strict=True) if isinstance(text, str) for n, s in enumerate(symbols_of(path or "", text))]
            yield pd.DataFrame(rows, columns=names)

    return files.select("file_id", "file_path", "content").mapInPandas(run, SYMBOL_SCHEMA)


def parse_imports(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in IMPORT_SCHEMA.split(", ")]
        for b in batches:
            rows = [(fid, path, *i) for fid, path, text in zip(b["file_id"], b["file_path"], b["content"], strict=True) if isinstance(text, str) for i in imports_of(path or "", text)]
            yield pd.DataFrame(rows, columns=names)

    return files.select("file_id", "file_path", "content").mapInPandas(run, IMPORT_SCHEMA)
