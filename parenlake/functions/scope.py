"""Lexical scope: which atoms refer to a binding."""

from __future__ import annotations

from parenlake.functions.dialects import needle, operator_key
from parenlake.functions.facts import LOCAL_CALLABLES, RECURSIVE, entered
from parenlake.functions.reader import Tree

#: Binding forms whose names see the ones before them, or not.
SEQUENTIAL = ("let*", "do*", "prog*", "when-let*", "if-let*", "loop", "doseq", "for")
PARALLEL = ("let", "do", "prog", "symbol-macrolet", "when-let", "if-let")
LAMBDAS = ("lambda", "fn", "named-lambda", "fn*")
COUNTED = ("dolist", "dotimes", "do-symbols")
DESTRUCTURED = ("destructuring-bind", "multiple-value-bind")
LOCAL = LOCAL_CALLABLES
_BINDING = frozenset((*SEQUENTIAL, *PARALLEL))
_WITH_PARAMETERS = frozenset(("defun", "defmacro", "defn", "cl-defun", "defsubst", "defmethod"))
#: All heads below which ``local_atoms`` has new names to tell.
_SCOPED = _BINDING | _WITH_PARAMETERS | {*LAMBDAS, *COUNTED, *DESTRUCTURED, *LOCAL}


def same(dialect: str, a: str, b: str) -> bool:
    """Names are compared as Common Lisp's reader does, or exactly."""
    return needle(a) == needle(b) if dialect in ("common-lisp", "unknown") else a == b


def binding_pairs(tree: Tree, k: int) -> list[tuple[int, int | None]]:
    """(name node, value node) of a binding list: (a 1) pairs, bare names, or a
    vector of alternating names and values."""
    node = tree.nodes[k]
    if node.delimiter == "bracket":
        kids = node.children
        return [(kids[i], kids[i + 1] if i + 1 < len(kids) else None) for i in range(0, len(kids), 2)]
    pairs = []
    for c in node.children:
        kids = tree.nodes[c].children
        if tree.nodes[c].kind == "atom":
            pairs.append((c, None))
        elif kids:
            pairs.append((kids[0], kids[1] if len(kids) > 1 else None))
    return pairs


def names_in(tree: Tree, k: int) -> list[int]:
    """Atoms that a parameter list or pattern binds."""
    found = []
    for c in tree.subtree(k):
        node = tree.nodes[c]
        if node.kind == "atom" and not tree.symbol(c).startswith(("&", '"', ":")):
            found.append(c)
    return found


def references(tree: Tree, roots: list[int], name: str) -> list[int]:
    """Atoms below ``roots`` that refer to a variable bound outside of them."""
    found: list[int] = []
    function_heads = tree.dialect in ("common-lisp", "emacs-lisp", "unknown")
    stack: list[tuple[int, int]] = [(k, 0) for k in reversed(roots)]
    is_name = lambda k: tree.nodes[k].kind == "atom" and same(tree.dialect, tree.symbol(k), name)
    while stack:
        k, outer = stack.pop()
        depth = entered(tree, k, outer)
        if depth is None:
            continue
        node = tree.nodes[k]
        if node.kind == "atom":
            if depth == 0 and "function" not in node.prefixes and is_name(k):
                found.append(k)
            continue
        kids = node.children
        head = tree.head(k) if node.delimiter == "paren" and depth == 0 else None
        below = kids
        if head is not None:
            key = operator_key(head)
            below = kids[1:] if function_heads else kids
            if key in SEQUENTIAL + PARALLEL and len(kids) > 1 and tree.nodes[kids[1]].kind == "list":
                pairs = binding_pairs(tree, kids[1])
                in_turn = key in SEQUENTIAL or tree.nodes[kids[1]].delimiter == "bracket"
                below, hidden = [], False
                for target, value in pairs:
                    if value is not None and not (in_turn and hidden):
                        below.append(value)
                    hidden = hidden or any(is_name(x) for x in names_in(tree, target))
                below = below if hidden else below + kids[2:]
            elif key in LAMBDAS:
                at = next((i for i, c in enumerate(kids[1:3], 1) if tree.nodes[c].kind == "list"), None)
                if at is not None:
                    below = [] if any(is_name(x) for x in names_in(tree, kids[at])) else kids[at + 1 :]
            elif key in COUNTED and len(kids) > 1 and tree.nodes[kids[1]].children:
                spec = tree.nodes[kids[1]].children
                below = spec[1:2] + ([] if is_name(spec[0]) else spec[2:] + kids[2:])
            elif key in DESTRUCTURED and len(kids) > 2:
                below = [kids[2], *([] if any(is_name(x) for x in names_in(tree, kids[1])) else kids[3:])]
            elif key in LOCAL and len(kids) > 1:
                below = list(kids[2:])
                for c in tree.nodes[kids[1]].children:
                    parts = tree.nodes[c].children
                    if len(parts) > 1 and not any(is_name(x) for x in names_in(tree, parts[1])):
                        below += parts[2:]
            elif key in ("defun", "defmacro", "defn") and len(kids) > 2:
                below = [] if tree.nodes[kids[2]].kind == "list" and any(is_name(x) for x in names_in(tree, kids[2])) else kids[3:]
        stack.extend((c, depth) for c in reversed(below))
    return sorted(found)


def local_atoms(tree: Tree, needles: list[str | None] | None = None, lower: str | None = None) -> set[int]:
    """Atoms that bind a local name or refer to one: no references to what is
    defined at the top. Variables and local functions are told apart where the
    dialect does. ``needles``: that of each atom, where they are known;
    ``lower``: the text in lower case, where heads are looked up so."""
    apart = tree.dialect in ("common-lisp", "emacs-lisp", "unknown")
    exact = tree.dialect not in ("common-lisp", "unknown")
    name = (lambda k: tree.symbol(k)) if exact else (lambda k: needle(tree.symbol(k))) if needles is None else (lambda k: needles[k] or "")
    found: set[int] = set()
    nodes = tree.nodes
    none: frozenset = frozenset()
    # (node, quasiquote depth, bound variables, bound functions, whether it is a head)
    stack: list[tuple[int, int, frozenset, frozenset, bool]] = [(c, 0, none, none, False) for c in reversed(tree.nodes[0].children)]
    while stack:
        k, outer, variables, functions, first = stack.pop()
        node = nodes[k]
        depth = entered(tree, k, outer) if node.prefixes or node.opaque else outer
        if depth is None:
            continue
        if node.kind == "atom":
            if not variables and not functions:
                continue
            called = apart and (first or "function" in node.prefixes)
            if depth == 0 and name(k) in (functions if called else variables if apart else variables | functions):
                found.add(k)
            continue
        kids = node.children
        if lower is not None:
            top = nodes[kids[0]] if kids and node.delimiter == "paren" and depth == 0 else None
            key = lower[top.start : top.end] if top is not None and top.kind == "atom" else None
        else:
            head = tree.head(k) if node.delimiter == "paren" and depth == 0 else None
            key = operator_key(head) if head is not None else None
        if key not in _SCOPED:
            # Nothing new is bound: atoms are looked up at once.
            first = node.delimiter == "paren"
            for c in kids:
                x = nodes[c]
                if x.kind != "atom" or x.prefixes or x.opaque:
                    stack.append((c, depth, variables, functions, first))
                elif depth == 0 and (variables or functions) and name(c) in (functions if apart and first else variables if apart else variables | functions):
                    found.add(c)
                first = False
            continue

        def go(some: list[int], seen: frozenset, own: frozenset = functions, depth: int = depth) -> None:
            stack.extend((c, depth, seen, own, False) for c in reversed(some))

        def bound(k: int) -> list[int]:
            some = names_in(tree, k)
            found.update(some)
            return some

        def with_(seen: frozenset, atoms: list[int]) -> frozenset:
            return seen | {name(x) for x in atoms} if atoms else seen

        if kids and node.delimiter == "paren":
            stack.append((kids[0], depth, variables, functions, True))
        if key in _BINDING and len(kids) > 1 and tree.nodes[kids[1]].kind == "list":
            in_turn = key in SEQUENTIAL or tree.nodes[kids[1]].delimiter == "bracket"
            inner = variables
            for target, value in binding_pairs(tree, kids[1]):
                if value is not None:
                    go([value], inner if in_turn else variables)
                inner = with_(inner, bound(target))
            go(kids[2:], inner)
        elif key in LAMBDAS or (key in _WITH_PARAMETERS and len(kids) > 2):
            at = next((i for i, c in enumerate(kids[1:4], 1) if tree.nodes[c].kind == "list"), None)
            go(kids[(at or 0) + 1 :] if at is not None else kids[1:], with_(variables, bound(kids[at])) if at is not None else variables)
        elif key in COUNTED and len(kids) > 1 and tree.nodes[kids[1]].children:
            spec = tree.nodes[kids[1]].children
            inner = with_(variables, bound(spec[0]))
            go(spec[1:2], variables)
            go(spec[2:] + kids[2:], inner)
        elif key in DESTRUCTURED and len(kids) > 2:
            go([kids[2]], variables)
            go(kids[3:], with_(variables, bound(kids[1])))
        elif key in LOCAL and len(kids) > 1:
            parts = [tree.nodes[c].children for c in tree.nodes[kids[1]].children]
            named = [p[0] for p in parts if p and tree.nodes[p[0]].kind == "atom"]
            found.update(named)
            inner = functions | {name(x) for x in named}
            for p in parts:
                if len(p) > 1:
                    go(p[2:], with_(variables, bound(p[1])), inner if key in RECURSIVE else functions)
            go(kids[2:], variables, inner)
        else:
            go(kids[1:] if node.delimiter == "paren" else kids, variables)
    return found


def captured(tree: Tree, k: int, found: list[int], value: int | None) -> bool:
    """Whether a name in ``value`` would be bound by a form between ``k`` and one
    of the atoms that the value is to replace."""
    if value is None:
        return False
    free = {tree.symbol(c) for c in tree.subtree(value) if tree.nodes[c].kind == "atom"}
    binders = {outer for c in found for outer in ancestors(tree, c) if outer > k}
    for outer in binders:
        head = tree.head(outer)
        if head and operator_key(head) in ("let", "let*", "lambda", "dolist", "dotimes", "do", "do*") and len(tree.nodes[outer].children) > 1:
            if free & {tree.symbol(x) for x in names_in(tree, tree.nodes[outer].children[1])}:
                return True
    return False


def lets(tree: Tree) -> list[dict]:
    """A row for each binding of each let form that is evaluated."""
    rows = []
    for k, node in enumerate(tree.nodes):
        head = tree.head(k) if node.kind == "list" and node.delimiter == "paren" else None
        if head is None or operator_key(head) not in ("let", "let*") or len(node.children) < 2 or tree.nodes[node.children[1]].kind != "list":
            continue
        if any(entered(tree, c, 0) is None for c in ancestors(tree, k)):
            continue
        spec = node.children[1]
        pairs, vector = binding_pairs(tree, spec), tree.nodes[spec].delimiter == "bracket"
        in_turn = operator_key(head) == "let*" or vector
        for i, (target, value) in enumerate(pairs):
            plain = tree.nodes[target].kind == "atom"
            name = tree.text(target)
            later = [v for _, v in pairs[i + 1 :] if v is not None] if in_turn else []
            used = references(tree, later + node.children[2:], tree.symbol(target)) if plain else []
            count = len(used)
            value_text = tree.text(value) if value is not None else "nil"
            special = tree.dialect == "common-lisp" and len(name) > 2 and name[0] == name[-1] == "*"
            risks = [
                risk
                for risk, there in (
                    ("multiple-bindings", len(pairs) > 1),
                    ("unsupported-binding-name", not plain),
                    ("possible-dynamic-variable-rebind", count == 0 and special),
                    ("unused-binding", count == 0 and not special),
                    ("duplicate-evaluation", count > 1),
                    ("capture", captured(tree, k, used, value)),
                    ("unsupported-by-inline-let", len(pairs) != 1 or len(node.children) < 3),
                )
                if there
            ]
            rows.append(
                {
                    "path": tree.path(k), "head": head, "binding_index": i, "name": name, "value": value_text,
                    "style": "vector" if vector else "symbol" if tree.nodes[spec].children[i] == target else "list-pair",
                    "reference_count": count, "inlineable": not risks, "risks": risks,
                }
            )
    return rows


def ancestors(tree: Tree, k: int) -> list[int]:
    out = []
    while k > 0:
        out.append(k)
        k = tree.nodes[k].parent
    return out
