"""Tree normalisation (N1-N5): inlining of trivial lets, then renaming of bound variables by depth.

Parity rules that look odd are kept by default, each behind a flag: an integer switch's default branch is entered
by neither pass; assignment targets and handler variables keep their names; mutable variables and lets become
plain ones (and so may be inlined). `strict_fix` enters the default branch and renames assignment targets.

Names in a text may shadow each other, so binders get names of their own before anything is moved; names that are not
renamed to numbers in the end get their old text back.
"""

from __future__ import annotations

from arbora.functions.irtree import Node, fold


def _sealed(node: Node, role: str, strict_fix: bool) -> bool:
    return node.kind == "Lswitch" and role == "default" and not strict_fix


def inlineable(let_kind: str, definition: Node) -> bool:
    """Aliases always, strict lets of a variable or a constant, nothing else."""
    return let_kind.lower() == "alias" or let_kind.lower() == "strict" and definition.kind in ("Lvar", "Lconst")


def _plain(node: Node, keep_mutable: bool) -> Node:
    """Mutable nodes as seen by the generic map."""
    if keep_mutable:
        return node
    if node.kind == "Lmutvar":
        return Node("Lvar", node.text)
    if node.kind == "Lmutlet":
        return Node("Llet", "strict", node.kids, node.roles, node.binders)
    return node


def substitute(root: Node, name: str, body: Node, strict_fix: bool = False, keep_mutable: bool = False) -> Node:
    """Every occurrence of a variable replaced; assignment targets aren't occurrences."""
    sealed: dict[int, Node] = {}
    stack = [root]
    while stack:
        n = stack.pop()
        for k, r in zip(n.kids, n.roles):
            if _sealed(n, r, strict_fix):
                sealed[id(k)] = k
            else:
                stack.append(k)

    def one(n: Node, kids: list) -> Node:
        kids = [sealed.get(id(old), new) for old, new in zip(n.kids, kids)]
        n = _plain(n.with_kids(kids), keep_mutable)
        return body if n.kind == "Lvar" and n.text == name else n

    return fold(root, one)


def _scoped(node: Node, role: str) -> bool:
    """Whether a child of this role lies in the scope of the node's binders."""
    return role == "body" or node.kind == "Lletrec"


def _names_read(root: Node) -> tuple[list[str], set[str]]:
    """All names that binders give, in order, and the names that are read outside the scope of a binder of that name."""
    given: list[str] = []
    free: set[str] = set()
    stack: list[tuple[Node, frozenset]] = [(root, frozenset())]
    while stack:
        n, bound = stack.pop()
        if n.kind in ("Lvar", "Lmutvar", "Lassign", "Lifused") and n.text not in bound:
            free.add(n.text)
        caught = n.text.split() if n.kind == "Lstaticcatch" else []
        given += [*n.binders, *caught]
        inner = bound | set(n.binders) if n.binders else bound
        for i, (k, r) in reversed(list(enumerate(zip(n.kids, n.roles)))):
            stack.append((k, bound | set(caught) if caught and i == 1 else inner if n.binders and _scoped(n, r) else bound))
    return given, free


def unique_names(root: Node) -> tuple[Node, dict[str, str]]:
    """The tree with a name of its own for every binder that shares one with another binder or a free name, and new name to old."""
    given, free = _names_read(root)
    if len(set(given)) == len(given) and free.isdisjoint(given):
        return root, {}
    taken, known, old = set(free), {*given, *free}, {}

    def fresh(name: str) -> str:
        new, k = name, 0
        while new in taken or k and new in known:
            k += 1
            new = f"{name}~{k}"
        taken.add(new)
        if new != name:
            old[new] = name
        return new

    done: list[Node] = []
    stack: list[tuple] = [("in", root, {})]
    while stack:
        step, node, env = stack.pop()
        if step == "out":
            n = len(node.kids)
            kids = done[len(done) - n :] if n else []
            if n:
                del done[len(done) - n :]
            done.append(node.with_kids(kids))
            continue
        binders, text, inner, caught = node.binders, node.text, env, env
        if node.kind in ("Lvar", "Lmutvar", "Lassign", "Lifused"):
            text = env.get(text, text)
        if binders:
            binders = [fresh(b) for b in binders]
            inner = {**env, **dict(zip(node.binders, binders))}
        if node.kind == "Lstaticcatch" and text:
            names = {x: fresh(x) for x in text.split()}
            text, caught = " ".join(names.values()), {**env, **names}
        stack.append(("out", Node(node.kind, text, node.kids, node.roles, binders), None))
        for i, (k, r) in reversed(list(enumerate(zip(node.kids, node.roles)))):
            stack.append(("in", k, caught if node.kind == "Lstaticcatch" and i == 1 else inner if _scoped(node, r) else env))
    return done[0], old


def _old_names(root: Node, old: dict[str, str]) -> Node:
    """The tree with the names that unique_names replaced and nothing renamed since."""
    if not old:
        return root
    back = lambda text: " ".join(old.get(x, x) for x in text.split(" ")) if "~" in text else text
    return fold(root, lambda n, kids: Node(n.kind, back(n.text) if n.kind in ("Lvar", "Lmutvar", "Lassign", "Lifused", "Lstaticcatch") else n.text, kids, n.roles, [old.get(b, b) for b in n.binders]))


def inline_all(root: Node, strict_fix: bool = False, keep_mutable: bool = False) -> Node:
    """Inline outer lets first; a definition is judged before it is processed itself. Binders that share a name keep apart by new ones."""
    return _inline(unique_names(root)[0], strict_fix, keep_mutable)


def _inline(root: Node, strict_fix: bool, keep_mutable: bool) -> Node:
    done: list[Node] = []
    stack: list[tuple[str, Node, int]] = [("in", root, 0)]
    while stack:
        step, node, n = stack.pop()
        if step == "keep":
            done.append(node)
            continue
        if step == "out":
            kids = done[len(done) - n :] if n else []
            if n:
                del done[len(done) - n :]
            done.append(node.with_kids(kids))
            continue
        node = _plain(node, keep_mutable)
        if node.kind == "Llet" and node.binders and inlineable(node.text, node.kids[0]):
            stack.append(("in", substitute(node.kids[1], node.binders[0], node.kids[0], strict_fix, keep_mutable), 0))
            continue
        stack.append(("out", node, len(node.kids)))
        for k, r in reversed(list(zip(node.kids, node.roles))):
            stack.append(("keep" if _sealed(node, r, strict_fix) else "in", k, 0))
    return done[0]


def rename_locals(root: Node, self_name: str | None = None, strict_fix: bool = False) -> Node:
    """Bound variables become numbers: from 1 upwards by depth, from -1 downwards for recursive ones, 0 for the tree's own name.

    Parameters and recursive binders are numbered from the last to the first. Free variables keep their names."""
    start: dict[str, int] = {self_name: 0} if self_name is not None else {}
    done: list[Node] = []
    stack: list[tuple] = [("in", root, 1, -1, start)]
    while stack:
        step = stack.pop()
        if step[0] == "keep":
            done.append(step[1])
            continue
        if step[0] == "out":
            _, node, n = step
            kids = done[len(done) - n :] if n else []
            if n:
                del done[len(done) - n :]
            done.append(node.with_kids(kids))
            continue
        _, node, up, down, env = step
        if node.kind in ("Lvar", "Lmutvar"):
            done.append(Node("Lvar", str(env[node.text])) if node.text in env else node)
            continue
        if strict_fix and node.kind == "Lassign" and node.text in env:
            node = Node("Lassign", str(env[node.text]), node.kids, node.roles)
        inner = (up, down, env)
        if node.binders:
            names, scope = node.binders, dict(env)
            if node.kind == "Lletrec":
                for i, b in enumerate(reversed(names)):
                    scope[b] = down - i
                inner = (up, down - len(names), scope)
            else:
                for i, b in enumerate(reversed(names)):
                    scope[b] = up + i
                inner = (up + len(names), down, scope)
            node = Node(node.kind, node.text, node.kids, node.roles, [str(scope[b]) for b in names])
        stack.append(("out", node, len(node.kids)))
        for k, r in reversed(list(zip(node.kids, node.roles))):
            if _sealed(node, r, strict_fix):
                stack.append(("keep", k))
            elif r == "body" or node.kind == "Lletrec":
                stack.append(("in", k, *inner))
            else:
                stack.append(("in", k, up, down, env))
    return done[0]


def normalise(root: Node, self_name: str | None = None, passes: int = 1, strict_fix: bool = False, keep_mutable: bool = False) -> Node:
    """Inline and rename; two passes reproduce tools that normalise an already normalised tree again."""
    for _ in range(passes):
        root, old = unique_names(root)
        root = _old_names(rename_locals(_inline(root, strict_fix, keep_mutable), self_name, strict_fix), old)
    return root
