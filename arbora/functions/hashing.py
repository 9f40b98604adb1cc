"""Recursive weighted fingerprints of trees."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache
from hashlib import md5

from arbora.functions.irtree import Node, fold, parse_tree, strings_apart
from arbora.model import Config, Threshold

#: A hashed tree: weight, the bag of its proper sub-trees as a rope (nested lists), and its raw digest.
Hashed = tuple[int, list, bytes]


@lru_cache(maxsize=100_000)
def _md5(text: str) -> bytes:
    return md5(text.encode()).digest()


def leaf(text: str) -> Hashed:
    return 1, [], _md5(text)


def combine(label: str, parts: list[Hashed], should_sort: bool) -> Hashed:
    """Weight 1 + the parts'; the bag in pre-order; with should_sort the label's digest is sorted among the parts'."""
    digests = [_md5(label)] if label else []
    total, bag = 1, []
    for weight, inner, digest in parts:
        total += weight
        digests.append(digest)
        bag.append((weight, digest))
        if inner:
            bag.append(inner)
    if should_sort:
        digests.sort()
    return total, bag, md5(b"".join(digests)).digest()


def case(key: str, body: Hashed) -> Hashed:
    """A switch case: the body's own fingerprint isn't in the bag, the case's is."""
    return body[0] + 1, body[1], md5(key.encode() + body[2]).digest()


def hash_node(config: Config, leaf=leaf, combine=combine, case=case):
    """The rule for one node, given its children's hashes; the operations may be others over other digests."""
    sort = config.should_sort
    # A list of parts, hashed from the last to the first; an empty label gives the anonymous list.
    listed = lambda label, items, should_sort: combine(label, items[::-1], should_sort)
    var = (lambda prefix, name: leaf(name)) if config.hash_var else (lambda prefix, name: leaf(prefix))

    def rule(n: Node, kids: list[Hashed]) -> Hashed:
        k = n.kind
        if k in ("Lvar", "Lmutvar"):
            return var(k, n.text)
        if k == "Lconst":
            return leaf(k)
        args = [h for h, r in zip(kids, n.roles) if r == "arg"]
        direct = [h for h, r in zip(kids, n.roles) if r in ("", "def", "body")]
        if k == "Lprim":
            parts = [leaf(n.text), listed("", args, sort)]
        elif k == "Lstaticraise":
            parts = [listed("", args, sort)]
        elif k == "Lsend":
            parts = [leaf(n.text), *direct, listed("", args, sort)]
        elif k == "Lletrec":
            parts = [listed("", kids[:-1], sort), kids[-1]]
        elif k == "Lassign":
            parts = [var("Lvar", n.text), *kids]
        elif k == "Lfor":
            parts = [kids[0], kids[1], leaf(n.text), kids[2]]
        elif k in ("Lswitch", "Lstringswitch"):
            group = lambda prefix: [case(r[len(prefix):], h) for h, r in zip(kids, n.roles) if r.startswith(prefix)]
            parts = [kids[0], listed("sw_consts", group("const:"), sort)]
            if k == "Lswitch":
                parts.append(listed("sw_blocks", group("block:"), sort))
            rest = [h for h, r in zip(kids, n.roles) if r == "default"]
            parts.append(rest[0] if rest else leaf("None"))
        else:
            parts = direct
        return combine(k, parts, sort)

    return rule


def flatten(rope: list) -> list[tuple[int, bytes]]:
    out: list[tuple[int, bytes]] = []
    stack = [iter(rope)]
    while stack:
        for x in stack[-1]:
            if isinstance(x, list):
                stack.append(iter(x))
                break
            out.append(x)
        else:
            stack.pop()
    return out


def hash_tree(root: Node, config: Config, threshold: Threshold | None = None) -> tuple[int, str, list[tuple[int, str]] | None]:
    """(weight, hex digest, bag); threshold None leaves the bag out. With should_sort the bag is sorted."""
    weight, rope, digest = fold(root, hash_node(config))
    if threshold is None:
        return weight, digest.hex(), None
    bag = [(w, d.hex()) for w, d in flatten(rope) if threshold.keeps(w, weight)]
    return weight, digest.hex(), sorted(bag) if config.should_sort else bag


# ---- many trees of few shapes ---------------------------------------------------------------------------------------

#: A shape seen so often gets a program; so many shapes are counted at a time, each of so many letters.
OFTEN, SHAPES, LETTERS = 8, 1_000, 4_000
_HOLE = re.compile("\0(\\d+)\0")


class _Program:
    """Operations of hash_node that write Python: a digest is bytes if it is the same for all strings, else a variable."""

    def __init__(self):
        self.variables: dict[str, str] = {}

    def _set(self, expression: str) -> str:
        return self.variables.setdefault(expression, f"d{len(self.variables)}")

    def leaf(self, text: str):
        if "\0" not in text:
            return leaf(text)
        return 1, [], self._set(f"leaf(s[{_HOLE.fullmatch(text)[1]}])")

    def combine(self, label: str, parts: list, should_sort: bool):
        plain = [(weight, [], digest) for weight, _, digest in parts]
        if all(isinstance(d, bytes) for *_, d in plain):
            return combine(label, plain, should_sort)
        digests = ", ".join([repr(_md5(label))] * bool(label) + [d if isinstance(d, str) else repr(d) for *_, d in plain])
        return 1 + sum(w for w, *_ in plain), [], self._set(f"md5(b''.join({'sorted' if should_sort else ''}([{digests}]))).digest()")

    def case(self, key: str, body):
        if "\0" not in key and isinstance(body[2], bytes):
            return case(key, body)
        name = f"s[{_HOLE.fullmatch(key)[1]}].encode()" if "\0" in key else repr(key.encode())
        return body[0] + 1, [], self._set(f"md5({name} + {body[2] if isinstance(body[2], str) else repr(body[2])}).digest()")


def _program(shape: str, config: Config) -> Callable[[list[str]], tuple[int, str]] | None:
    """(weight, hex digest) from the strings of a shape; None if it is no tree, or if what it is depends on a string."""
    first, *rest = shape.split('"')
    if "\0" in shape:
        return None
    try:
        tree = parse_tree(first + "".join(f'"\0{i}\0"{part}' for i, part in enumerate(rest)))
    except ValueError:
        return None
    program = _Program()
    rule = hash_node(config, program.leaf, program.combine, program.case)
    directions: list[str] = []

    def one(n: Node, kids: list):
        if n.kind == "Lfor":
            directions.append(n.text)
        return rule(n, kids)

    weight, _, digest = fold(tree, one)
    if any("\0" in text for text in directions):  # "up" in quotes is a direction too
        return None
    lines = [f"    {name} = {expression}" for expression, name in program.variables.items()]
    scope: dict = {"leaf": _md5, "md5": md5}
    exec("\n".join(["def run(s):", *lines, f"    return {weight}, {f'{digest}.hex()' if isinstance(digest, str) else repr(digest.hex())}"]), scope)
    return scope["run"]


def text_hasher(config: Config) -> Callable[[str], tuple[int, str]]:
    """hash_tree(parse_tree(text), config) without the bag, for many texts: texts that differ only in their quoted strings
    have one shape, and a shape seen often is parsed no more but hashed by a program of its own."""
    programs: dict[str, Callable] = {}
    seen: Counter[str] = Counter()

    def one(text: str) -> tuple[int, str]:
        apart = strings_apart(text)
        if apart is not None:
            shape, strings = apart
            program = programs.get(shape)
            if program is not None:
                return program(strings)
            if len(shape) <= LETTERS:
                if len(seen) >= SHAPES:
                    seen.clear()
                    programs.clear()
                seen[shape] += 1
                if seen[shape] == OFTEN and (made := _program(shape, config)) is not None:
                    programs[shape] = made
        return hash_tree(parse_tree(text), config)[:2]

    return one
