"""Expression trees and their S-expression text.

    (Lvar "x")  (Lmutvar "x")  (Lconst)  (Lconst "text")
    (Lapply f a b)  (Lprim "name" a b)  (Lfunction body)  (Lfunction ["x" "y"] body)
    (Llet d b)  (Llet alias "x" d b)  (Lmutlet "x" d b)  (Lletrec [d e] b)  (Lletrec [("f" d) ("g" e)] b)
    (Lswitch s consts[0 -> t] blocks[1 -> u] default=none)  (Lstringswitch s consts["k" -> t] default=(Lconst))
    (Lstaticraise a)  (Lstaticcatch b ["v"] h)  (Ltrywith b "x" h)  (Lfor "i" lo hi up b)  (Lsend Self m o a)
    (Lifthenelse c t e)  (Lsequence a b)  (Lwhile c b)  (Lifused "x" b)  (Lassign "x" v)  (Levent b)

Binders may be left out where a tree was renamed before. Nothing here recurses, so depth is bounded by memory only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator


class Node:
    """kind; text (name, primitive, let kind …); kids; roles, one per kid; binders bound by the node itself.

    Roles: '' a plain child, 'arg' a member of the anonymous argument list, 'def' a definition, 'body' the scope of
    the binders, 'const:k' and 'block:k' cases, 'default'."""

    __slots__ = ("kind", "text", "kids", "roles", "binders")

    def __init__(self, kind: str, text: str = "", kids: tuple = (), roles: tuple = (), binders: tuple = ()):
        self.kind, self.text, self.kids, self.binders = kind, text, tuple(kids), tuple(binders)
        self.roles = tuple(roles) or ("",) * len(self.kids)

    def with_kids(self, kids) -> Node:
        return Node(self.kind, self.text, tuple(kids), self.roles, self.binders)

    def __eq__(self, other) -> bool:
        stack = [(self, other)]
        while stack:
            a, b = stack.pop()
            if not (isinstance(b, Node) and (a.kind, a.text, a.roles, a.binders) == (b.kind, b.text, b.roles, b.binders)):
                return False
            stack.extend(zip(a.kids, b.kids))
        return True

    __hash__ = None


class TreeError(ValueError):
    """Text that is no tree."""


#: Children with plain roles, by kind: how many; None for any number.
_PLAIN = {"Lifthenelse": 3, "Lsequence": 2, "Lwhile": 2, "Levent": 1, "Lapply": None}
_TOKEN = re.compile(r'\s*(?:(\(|\)|\[|\]|->|,|=)|"((?:[^"\\]|\\.)*)"|([^\s()\[\]",=>-][^\s()\[\]",=>]*|-\d+))')


_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"')


def _unescaped(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s)


def strings_apart(text: str) -> tuple[str, list[str]] | None:
    """The text's shape, a quote in place of each quoted string, and these strings; None where quotes don't pair."""
    if "\\" not in text:
        parts = text.split('"')
        return ('"'.join(parts[::2]), parts[1::2]) if len(parts) % 2 else None
    parts = _STRING.split(text)
    if any('"' in p for p in parts[::2]):
        return None
    return '"'.join(parts[::2]), [_unescaped(s) for s in parts[1::2]]


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at, end = 0, len(text.rstrip())
    while at < end:
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise TreeError(f"unexpected text at {at}")
        at = m.end()
        if m.group(1):
            yield m.group(1), m.group(1)
        elif m.group(2) is not None:
            yield "str", _unescaped(m.group(2))
        else:
            yield "word", m.group(3)


def _read(text: str) -> list:
    """Nested lists: ('(' …) and ('[' …) with tokens as pairs."""
    top: list = ["top"]
    stack = [top]
    for kind, value in _tokens(text):
        if kind in "([":
            inner = [kind]
            stack[-1].append(inner)
            stack.append(inner)
        elif kind in ")]":
            if len(stack) == 1 or stack[-1][0] != {")": "(", "]": "["}[kind]:
                raise TreeError("unbalanced brackets")
            stack.pop()
        else:
            stack[-1].append((kind, value))
    if len(stack) > 1:
        raise TreeError("unbalanced brackets")
    return top[1:]


def _build(form: list, done: dict[int, Node]) -> Node:
    if not isinstance(form, list) or form[0] != "(" or len(form) < 2 or not isinstance(form[1], tuple):
        raise TreeError("a tree must start with its kind")
    kind, rest = form[1][1], form[2:]
    sub = lambda x: done[id(x)] if isinstance(x, list) and id(x) in done else _fail(kind)
    name = lambda x: x[1] if isinstance(x, tuple) and x[0] in ("str", "word") else _fail(kind)
    is_list = lambda x: isinstance(x, list) and x[0] == "["
    is_name = lambda x: isinstance(x, tuple)
    if kind in ("Lvar", "Lmutvar"):
        return Node(kind, name(rest[0])) if len(rest) == 1 else _fail(kind)
    if kind == "Lconst":
        return Node(kind, name(rest[0]) if rest else "")
    if kind in _PLAIN:
        if _PLAIN[kind] is not None and len(rest) != _PLAIN[kind] or not rest:
            _fail(kind)
        return Node(kind, "", [sub(x) for x in rest])
    if kind == "Lprim":
        return Node(kind, name(rest[0]), [sub(x) for x in rest[1:]], ["arg"] * (len(rest) - 1))
    if kind == "Lstaticraise":
        return Node(kind, "", [sub(x) for x in rest], ["arg"] * len(rest))
    if kind == "Lfunction":
        params = [name(x) for x in rest[0][1:]] if len(rest) == 2 and is_list(rest[0]) else []
        if len(rest) != 1 + bool(params or len(rest) == 2 and is_list(rest[0])):
            _fail(kind)
        return Node(kind, "", [sub(rest[-1])], ["body"], params)
    if kind == "Llet":
        if len(rest) == 4:
            return Node(kind, name(rest[0]), [sub(rest[2]), sub(rest[3])], ["def", "body"], [name(rest[1])])
        return Node(kind, "", [sub(rest[0]), sub(rest[1])], ["def", "body"]) if len(rest) == 2 else _fail(kind)
    if kind == "Lmutlet":
        return Node(kind, "", [sub(rest[-2]), sub(rest[-1])], ["def", "body"], [name(rest[0])] if len(rest) == 3 else [])
    if kind == "Lletrec":
        if len(rest) != 2 or not is_list(rest[0]):
            _fail(kind)
        binders, defs = [], []
        for x in rest[0][1:]:
            if isinstance(x, list) and len(x) == 3 and is_name(x[1]) and isinstance(x[2], list):
                binders.append(name(x[1]))
                defs.append(sub(x[2]))
            else:
                defs.append(sub(x))
        if binders and len(binders) != len(defs):
            _fail(kind)
        return Node(kind, "", [*defs, sub(rest[1])], ["def"] * len(defs) + ["body"], binders)
    if kind in ("Lifused", "Lassign"):
        return Node(kind, name(rest[0]), [sub(rest[1])]) if len(rest) == 2 else _fail(kind)
    if kind == "Ltrywith":
        return Node(kind, "", [sub(rest[0]), sub(rest[-1])], ["", "body"], [name(rest[1])] if len(rest) == 3 else [])
    if kind == "Lstaticcatch":
        names = [name(x) for x in rest[1][1:]] if len(rest) == 3 else []
        return Node(kind, " ".join(names), [sub(rest[0]), sub(rest[-1])])
    if kind == "Lfor":
        bound = [name(rest[0])] if len(rest) == 5 else []
        lo, hi, way, body = rest[-4:]
        return Node(kind, {"up": "Upto", "down": "Downto"}.get(name(way).lower(), name(way)), [sub(lo), sub(hi), sub(body)], ["", "", "body"], bound)
    if kind == "Lsend":
        return Node(kind, name(rest[0]), [sub(x) for x in rest[1:]], ["", ""] + ["arg"] * (len(rest) - 3))
    if kind in ("Lswitch", "Lstringswitch"):
        kids, roles, at = [sub(rest[0])], [""], 1
        while at < len(rest):
            word = name(rest[at])
            if word in ("consts", "blocks"):
                cases = [x for x in rest[at + 1][1:] if x not in (("->", "->"), (",", ","))]
                for key, tree in zip(cases[::2], cases[1::2]):
                    kids.append(sub(tree))
                    roles.append(("const:" if word == "consts" else "block:") + name(key))
                at += 2
            elif word == "default":
                value = rest[at + 2]
                if value != ("word", "none"):
                    kids.append(sub(value))
                    roles.append("default")
                at += 3
            else:
                _fail(kind)
        return Node(kind, "", kids, roles)
    raise TreeError(f"unknown kind {kind}")


def _fail(kind: str):
    raise TreeError(f"malformed {kind}")


def parse_tree(text: str) -> Node:
    """The tree of an S-expression; TreeError if it is none."""
    forms = _read(text)
    if len(forms) != 1:
        raise TreeError("not exactly one tree")
    done: dict[int, Node] = {}
    stack: list[tuple[list, bool]] = [(forms[0], False)]
    while stack:
        form, ready = stack.pop()
        if not isinstance(form, list):
            raise TreeError("a tree must be in brackets")
        if ready:
            try:
                done[id(form)] = _build(form, done)
            except IndexError:
                raise TreeError("malformed tree") from None
            continue
        is_tree = form[0] == "(" and len(form) > 1 and isinstance(form[1], tuple) and form[1][0] == "word"
        if is_tree:
            stack.append((form, True))
        for x in form[1:]:
            if isinstance(x, list):
                stack.append((x, False))
    if id(forms[0]) not in done:
        raise TreeError("a tree must start with its kind")
    return done[id(forms[0])]


def _quoted(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'


def print_tree(root: Node) -> str:
    """The text that parse_tree reads back."""
    return fold(root, _print_one)


def _print_one(n: Node, kids: list[str]) -> str:
    by = lambda prefix: [(r, k) for r, k in zip(n.roles, kids) if r.startswith(prefix)]
    names = " ".join(_quoted(b) for b in n.binders)
    parts: list[str] = [n.kind]
    if n.kind in ("Lvar", "Lmutvar", "Lprim", "Lifused", "Lassign"):
        parts += [_quoted(n.text), *kids]
    elif n.kind == "Lconst":
        parts += [_quoted(n.text)] if n.text else []
    elif n.kind == "Lfunction":
        parts += ([f"[{names}]"] if n.binders else []) + kids
    elif n.kind in ("Llet", "Lmutlet"):
        parts += ([n.text] if n.kind == "Llet" and n.binders else []) + ([names] if n.binders else []) + kids
    elif n.kind == "Lletrec":
        defs = kids[:-1]
        parts += ["[" + " ".join(f"({_quoted(b)} {d})" for b, d in zip(n.binders, defs)) + "]" if n.binders else "[" + " ".join(defs) + "]", kids[-1]]
    elif n.kind == "Ltrywith":
        parts += [kids[0], *([names] if n.binders else []), kids[1]]
    elif n.kind == "Lstaticcatch":
        parts += [kids[0], *(["[" + " ".join(map(_quoted, n.text.split())) + "]"] if n.text else []), kids[1]]
    elif n.kind == "Lfor":
        parts += [*([names] if n.binders else []), kids[0], kids[1], {"Upto": "up", "Downto": "down"}.get(n.text, n.text), kids[2]]
    elif n.kind == "Lsend":
        parts += [n.text, *kids]
    elif n.kind in ("Lswitch", "Lstringswitch"):
        parts.append(kids[0])
        for word, prefix in (("consts", "const:"), ("blocks", "block:")):
            parts.append(f"{word}[" + ", ".join(f"{_quoted(r[6:])} -> {k}" for r, k in by(prefix)) + "]")
        parts.append("default=" + (by("default")[0][1] if by("default") else "none"))
    else:
        parts += kids
    return "(" + " ".join(parts) + ")"


def fold(root: Node, f: Callable[[Node, list], object]):
    """Bottom-up fold with a stack of its own: f(node, results of its kids)."""
    out: list = []
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, ready = stack.pop()
        if ready:
            n = len(node.kids)
            kids = out[len(out) - n :] if n else []
            if n:
                del out[len(out) - n :]
            out.append(f(node, kids))
        else:
            stack.append((node, True))
            stack.extend((k, False) for k in reversed(node.kids))
    return out[0]
