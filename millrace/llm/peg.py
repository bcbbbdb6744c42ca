"""A compiler from parsing-expression grammars over token kinds to Python functions.

Grammar text, one rule per paragraph:

    rule    = 'kind' other? ( a / b )* &look !never+
    $class  : KIND KIND ...        a set of kinds, used like a terminal
    @memo rule = ...               the rule's results are kept by position

Terminals in quotes or in capitals are token kinds. `NL` succeeds without
consuming where a line end precedes the token, `NONL` where none does. `<eof>`
has the kind EOF. Ordered choice, greedy repetition and no backtracking into a
finished rule: the usual PEG semantics. Where a first-token set decides an
alternative, the generated code tests it before it tries the alternative.

Each grammar is compiled twice: a fast version that only answers whether the
whole input is consumed, and a tracing one, run after a failure, that reports
the furthest token at which a terminal did not match.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

sys.setrecursionlimit(max(sys.getrecursionlimit(), 100_000))

_TOKEN = re.compile(r"\s*(?:'([^']+)'|(\$?[A-Za-z_][\w]*)|([()/?*+&!]))")


@dataclass
class Node:
    op: str  # term, set, ref, seq, alt, opt, star, plus, and, not, nl, nonl
    args: tuple = ()


def _parse_expression(text: str) -> Node:
    toks: list[tuple[str, str]] = []
    at = 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"grammar: {text[at:at+40]!r}")
        toks.append(("lit", m.group(1)) if m.group(1) is not None else ("name", m.group(2)) if m.group(2) else ("op", m.group(3)))
        at = m.end()
        while at < len(text) and text[at].isspace():
            at += 1
    pos = 0

    def alt() -> Node:
        nonlocal pos
        parts = [seq()]
        while pos < len(toks) and toks[pos] == ("op", "/"):
            pos += 1
            parts.append(seq())
        return parts[0] if len(parts) == 1 else Node("alt", tuple(parts))

    def seq() -> Node:
        parts = []
        while pos < len(toks) and toks[pos] not in (("op", "/"), ("op", ")")):
            parts.append(prefix())
        return parts[0] if len(parts) == 1 else Node("seq", tuple(parts))

    def prefix() -> Node:
        nonlocal pos
        if toks[pos] in (("op", "&"), ("op", "!")):
            kind = toks[pos][1]
            pos += 1
            return Node("and" if kind == "&" else "not", (prefix(),))
        n = atom()
        while pos < len(toks) and toks[pos] in (("op", "?"), ("op", "*"), ("op", "+")):
            n = Node({"?": "opt", "*": "star", "+": "plus"}[toks[pos][1]], (n,))
            pos += 1
        return n

    def atom() -> Node:
        nonlocal pos
        kind, v = toks[pos]
        pos += 1
        if kind == "lit":
            return Node("term", (v,))
        if kind == "name":
            if v == "NL":
                return Node("nl")
            if v == "NONL":
                return Node("nonl")
            if v[0] == "$":
                return Node("set", (v,))
            return Node("term", (v,)) if v.isupper() else Node("ref", (v,))
        if v == "(":
            n = alt()
            pos += 1
            return n
        raise ValueError(f"grammar: unexpected {v!r} in {text!r}")

    return alt()


class Grammar:
    """A compiled grammar; `start` is the first rule."""

    def __init__(self, text: str):
        self.rules: dict[str, Node] = {}
        self.memo: set[str] = set()
        self.sets: dict[str, frozenset[str]] = {}
        lines = [x.rstrip() for x in text.split("\n")]
        joined = "\n".join(x for x in lines if x.strip())
        for para in re.split(r"\n(?=\S)", joined.strip()):
            para = " ".join(para.split())
            if para[0] == "$":
                name, body = para.split(":", 1)
                kinds: set[str] = set()
                for k in body.split():
                    kinds |= self.sets[k] if k[0] == "$" and k in self.sets else {k}
                self.sets[name.strip()] = frozenset(kinds)
                continue
            head, body = para.split("=", 1)
            words = head.split()
            if words[0] == "@memo":
                self.memo.add(words[1])
            self.rules[words[-1]] = _parse_expression(body)
        self.start = next(iter(self.rules))
        self._check()
        self._firsts()
        self.fast = self._compile(False)
        self.trace: dict | None = None

    # -- analysis ----------------------------------------------------------
    def _check(self) -> None:
        def walk(n: Node) -> None:
            if n.op == "ref" and n.args[0] not in self.rules:
                raise ValueError(f"grammar: no rule {n.args[0]}")
            if n.op == "set" and n.args[0] not in self.sets:
                raise ValueError(f"grammar: no class {n.args[0]}")
            for a in n.args:
                if isinstance(a, Node):
                    walk(a)

        for n in self.rules.values():
            walk(n)

    def _firsts(self) -> None:
        """Nullability and first sets of rules, by iteration to the fixed point."""
        self.null = dict.fromkeys(self.rules, False)
        self.first: dict[str, frozenset[str]] = dict.fromkeys(self.rules, frozenset())
        changed = True
        while changed:
            changed = False
            for name, n in self.rules.items():
                u, f = self.nullable(n), self.firsts(n)
                if u != self.null[name] or f != self.first[name]:
                    self.null[name], self.first[name], changed = u, f, True

    def nullable(self, n: Node) -> bool:
        op = n.op
        if op in ("term", "set"):
            return False
        if op == "ref":
            return self.null[n.args[0]]
        if op == "seq":
            return all(self.nullable(a) for a in n.args)
        if op == "alt":
            return any(self.nullable(a) for a in n.args)
        return self.nullable(n.args[0]) if op == "plus" else True

    def firsts(self, n: Node) -> frozenset[str]:
        op = n.op
        if op == "term":
            return frozenset(n.args)
        if op == "set":
            return self.sets[n.args[0]]
        if op == "ref":
            return self.first[n.args[0]]
        if op == "seq":
            out: frozenset[str] = frozenset()
            for a in n.args:
                if a.op in ("and", "not", "nl", "nonl"):
                    continue
                out |= self.firsts(a)
                if not self.nullable(a):
                    break
            return out
        if op == "alt":
            return frozenset().union(*(self.firsts(a) for a in n.args))
        if op in ("opt", "star", "plus"):
            return self.firsts(n.args[0])
        return frozenset()

    # -- code --------------------------------------------------------------
    def _compile(self, tracing: bool) -> dict:
        out: list[str] = []
        consts: dict[str, object] = {}
        names = 0

        def fresh(p: str = "q") -> str:
            nonlocal names
            names += 1
            return f"{p}{names}"

        def const(kinds: frozenset[str]) -> str:
            for k, v in consts.items():
                if v == kinds:
                    return k
            k = f"F{len(consts)}"
            consts[k] = kinds
            return k

        def test(v: str, kinds: frozenset[str], negate: bool = False) -> str:
            if len(kinds) == 1:
                return f"K[{v}] {'!=' if negate else '=='} {next(iter(kinds))!r}"
            return f"K[{v}] {'not in' if negate else 'in'} {const(kinds)}"

        def emit(n: Node, v: str, d: int) -> None:
            """Code that advances variable v over n, or sets it to -1."""
            pad = "    " * d
            op = n.op
            if op in ("term", "set"):
                kinds = frozenset(n.args) if op == "term" else self.sets[n.args[0]]
                if tracing:
                    out.append(f"{pad}if {v} > FAR[0]: FAR[0] = {v}")
                out.append(f"{pad}{v} = {v} + 1 if {test(v, kinds)} else -1")
            elif op == "ref":
                out.append(f"{pad}{v} = r_{n.args[0]}({v})")
            elif op == "nl":
                out.append(f"{pad}if not N[{v}]: {v} = -1")
            elif op == "nonl":
                out.append(f"{pad}if N[{v}]: {v} = -1")
            elif op == "seq":
                out.append(f"{pad}while 1:")
                for k, a in enumerate(n.args):
                    emit(a, v, d + 1)
                    if k + 1 < len(n.args):
                        if not (self.nullable(a) and a.op in ("opt", "star")):
                            out.append(f"{pad}    if {v} < 0: break")
                out.append(f"{pad}    break")
            elif op == "alt":
                s = fresh("s")
                out.append(f"{pad}{s} = {v}")
                out.append(f"{pad}while 1:")
                for k, a in enumerate(n.args):
                    last = k + 1 == len(n.args)
                    guarded = not tracing and not self.nullable(a) and self.firsts(a)
                    dd = d + 1
                    if guarded and not (a.op in ("term", "set")):
                        out.append(f"{pad}    if {test(s, self.firsts(a))}:")
                        dd += 1
                    p2 = "    " * dd
                    if k:
                        out.append(f"{p2}{v} = {s}")
                    emit(a, v, dd)
                    if last:
                        if dd > d + 1:
                            out.append(f"{pad}    else: {v} = -1")
                    else:
                        out.append(f"{p2}if {v} >= 0: break")
                        if dd > d + 1:
                            pass
                out.append(f"{pad}    break")
            elif op == "opt":
                a = n.args[0]
                t = fresh("t")
                dd = d
                if not tracing and not self.nullable(a) and self.firsts(a):
                    out.append(f"{pad}if {test(v, self.firsts(a))}:")
                    dd += 1
                p2 = "    " * dd
                out.append(f"{p2}{t} = {v}")
                emit(a, t, dd)
                out.append(f"{p2}if {t} >= 0: {v} = {t}")
            elif op in ("star", "plus"):
                a = n.args[0]
                if op == "plus":
                    emit(a, v, d)
                    out.append(f"{pad}if {v} >= 0:")
                    d += 1
                    pad = "    " * d
                t = fresh("t")
                if not tracing and not self.nullable(a) and self.firsts(a):
                    out.append(f"{pad}while {test(v, self.firsts(a))}:")
                else:
                    out.append(f"{pad}while 1:")
                out.append(f"{pad}    {t} = {v}")
                emit(a, t, d + 1)
                out.append(f"{pad}    if {t} <= {v}: break")
                out.append(f"{pad}    {v} = {t}")
            elif op in ("and", "not"):
                a = n.args[0]
                if a.op in ("term", "set"):
                    kinds = frozenset(a.args) if a.op == "term" else self.sets[a.args[0]]
                    out.append(f"{pad}if {test(v, kinds, op == 'and')}: {v} = -1")
                else:
                    t = fresh("t")
                    out.append(f"{pad}{t} = {v}")
                    emit(a, t, d)
                    out.append(f"{pad}if {t} {'<' if op == 'and' else '>='} 0: {v} = -1")
            else:
                raise AssertionError(op)

        for name, n in self.rules.items():
            memo = name in self.memo
            out.append(f"def {'b' if memo else 'r'}_{name}(q):")
            emit(n, "q", 1)
            out.append("    return q")
            if memo:
                out.append(f"M_{name} = {{}}")
                out.append(f"def r_{name}(q):")
                out.append(f"    v = M_{name}.get(q)")
                out.append(f"    if v is None: v = M_{name}[q] = b_{name}(q)")
                out.append("    return v")
        space: dict = {"K": [], "N": [], "FAR": [0], **consts}
        exec(compile("\n".join(out), "<grammar>", "exec"), space)  # noqa: S102 - the text is generated here
        return space

    def _run(self, space: dict, kinds: list[str], newline: list | None) -> int:
        space["K"], space["N"] = kinds, newline or ()
        space["FAR"][0] = 0
        for m in self.memo:
            space[f"M_{m}"].clear()
        return space[f"r_{self.start}"](0)

    def accepts(self, kinds: list[str], newline: list | None = None) -> bool:
        """Whether the start rule consumes all kinds; the last must be EOF."""
        return self._run(self.fast, kinds, newline) == len(kinds)

    def furthest(self, kinds: list[str], newline: list | None = None) -> int:
        """Index of the furthest token at which a terminal was tried."""
        if self.trace is None:
            self.trace = self._compile(True)
        self._run(self.trace, kinds, newline)
        return min(self.trace["FAR"][0], len(kinds) - 1)
