"""What one pass over a tree can tell of each node: definitions, calls, shapes."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

from parenlake.functions.dialects import CALLABLE, ascii_lower, category, is_definition_head, needle, operator_key
from parenlake.functions.reader import Tree

#: Forms that bind functions or macros for their body.
LOCAL_CALLABLES = ("flet", "labels", "macrolet", "compiler-macrolet", "cl-flet", "cl-flet*", "cl-labels", "cl-macrolet")
#: Those whose own bodies see them.
RECURSIVE = ("labels", "cl-labels")
#: Forms that declare and call nothing.
DECLARATIONS = ("declare", "declaim", "proclaim")
#: Binding forms of each dialect. ``pairs`` are names with values,
#: alone or, in a vector, by turns; ``specs`` may be bare names; of ``slots``
#: the names are of places.
_LISP_2 = {"pairs": ("let", "let*", "symbol-macrolet"), "specs": ("prog", "prog*", "do", "do*"), "slots": ("with-slots", "with-accessors")}
BINDINGS = {"common-lisp": _LISP_2, "emacs-lisp": _LISP_2, "unknown": _LISP_2, "scheme": {"pairs": ("let", "let*")}, **dict.fromkeys(("clojure", "janet", "fennel"), {"pairs": ("let",)})}
LOOPS = ("dolist", "dotimes")
#: Heads whose parameters are child 2, and those whose parameters
#: are the first list from child 2 on.
PARAMETERS_SECOND = (
    "defun defmacro defgeneric define-compiler-macro define-setf-expander defsetf deftype "
    "cl-defun defsubst definline cl-defmacro define lambda defn defn- cl-defgeneric deftest ert-deftest define-test define-ert-test fn macro"
).split()
PARAMETERS_FIRST_LIST = ("defmethod", "cl-defmethod")


@dataclass
class Definition:
    category: str
    name: str | None
    parameters: int | None  # child index of the parameter list
    body: int  # child index where the body starts


def name_of(tree: Tree, k: int) -> str | None:
    """A definition's name: an atom, (setf name), or a list's head."""
    node = tree.nodes[k]
    if node.kind == "atom":
        return tree.text(k)
    if node.kind != "list":
        return None
    head = tree.head(k)
    if head is not None and operator_key(head) == "setf" and len(node.children) > 1 and tree.nodes[node.children[1]].kind == "atom":
        return tree.text(node.children[1])
    return head


def definition(tree: Tree, k: int) -> Definition | None:
    """The shape of a definition form; None for other forms."""
    node, head = tree.nodes[k], tree.head(k)
    if node.kind != "list" or head is None:
        return None
    kind = category(tree.dialect, head)
    if kind is None:
        return None
    key, children = operator_key(head), node.children
    is_list = lambda i: i < len(children) and tree.nodes[children[i]].kind == "list"
    at = None
    if key in PARAMETERS_SECOND:
        at = 2 if is_list(2) else None
    elif key in PARAMETERS_FIRST_LIST:
        at = next((i for i in range(2, len(children)) if is_list(i) and tree.nodes[children[i]].delimiter in ("paren", "bracket")), None)
    if key == "defsetf":
        body = min(at + 2, len(children)) if at is not None else len(children)
    elif kind in CALLABLE:
        body = at + 1 if at is not None else 3
    else:
        body = 2
    name = name_of(tree, children[1]) if len(children) > 1 else None
    return Definition(kind, name, at, body)


def arity(tree: Tree, k: int) -> tuple[int, int | None]:
    """Least and most arguments of a parameter list; None: any number."""
    low, high, mode = 0, 0, "required"
    for c in tree.nodes[k].children:
        word = ascii_lower(tree.text(c)) if tree.nodes[c].kind == "atom" else ""
        if word.startswith("&"):
            mode = word[1:]
            if mode in ("rest", "body"):
                high = None
            continue
        if mode == "required":
            low += 1
        step = {"required": 1, "optional": 1, "key": 2}.get(mode, 0)
        if high is not None:
            high += step
    return low, high


def parameter_count(tree: Tree, k: int) -> int:
    return sum(not (tree.nodes[c].kind == "atom" and tree.text(c).startswith("&")) for c in tree.nodes[k].children)


def entered(tree: Tree, k: int, depth: int) -> int | None:
    """The quasiquote depth inside a node; None where nothing is evaluated."""
    node = tree.nodes[k]
    if node.opaque:
        return None
    for prefix in node.prefixes:
        if prefix == "read-eval" or (prefix == "quote" and depth == 0):
            return None
        depth += (prefix == "quasiquote") - (prefix in ("unquote", "unquote-splicing") and depth > 0)
    if "function" in node.prefixes and node.kind == "list":
        head = tree.head(k)
        if tree.dialect in ("common-lisp", "emacs-lisp", "unknown") and (head is None or operator_key(head) not in ("lambda", "named-lambda")):
            return None
    return depth


@dataclass
class Call:
    node: int
    head: str
    arguments: int
    category: str | None
    enclosing: str | None


def bound_values(tree: Tree, k: int, key: str) -> list[int] | None:
    """The nodes that a binding form evaluates for its bindings, none where it
    has no list of them (a named let); None for other forms."""
    if not any(key in heads for heads in BINDINGS[tree.dialect].values()):
        return None
    if len(tree.nodes[k].children) < 2 or tree.nodes[tree.nodes[k].children[1]].kind != "list":
        return []
    bindings = tree.nodes[tree.nodes[k].children[1]]
    if bindings.delimiter == "bracket":
        return bindings.children[1::2]
    return [v for b in bindings.children for v in tree.nodes[b].children[1:]]


def calls(tree: Tree) -> tuple[list[Call], list[int | None]]:
    """List-head call sites, definitions included, and for each node the
    quasiquote depth at which it is read (None: not evaluated)."""
    found: list[Call] = []
    live: list[int | None] = [None] * len(tree.nodes)
    local = tree.dialect in ("common-lisp", "unknown", "emacs-lisp")
    stack: list[tuple[int, str | None, frozenset, int]] = [(c, None, frozenset(), 0) for c in reversed(tree.nodes[0].children)]
    while stack:
        k, around, bound, outer = stack.pop()
        node = tree.nodes[k]
        if node.kind == "atom" and not node.prefixes and not node.opaque:
            live[k] = outer
            continue
        depth = entered(tree, k, outer)
        if depth is None:
            continue
        live[k] = depth
        kids = node.children
        head = tree.head(k) if node.kind == "list" and node.delimiter == "paren" and depth == 0 else None
        below = [(c, around, bound, depth) for c in kids]
        if head is not None:
            key = operator_key(head)
            if key in DECLARATIONS:
                continue
            if local and key in LOCAL_CALLABLES and len(kids) > 1:
                own = [c for c in tree.nodes[kids[1]].children if tree.nodes[c].children]
                inner = bound | {needle(tree.head(c)) for c in own if tree.head(c)}
                scope = inner if key in RECURSIVE else bound
                below = [(b, around, scope, depth) for c in own for b in tree.nodes[c].children[2:]] + [(c, around, inner, depth) for c in kids[2:]]
            elif key == "locally":
                below = below[2:]
            else:
                shape = definition(tree, k)
                if needle(head) not in bound:
                    found.append(Call(k, head, len(kids) - 1, shape.category if shape else None, around))
                values = bound_values(tree, k, key)
                if values is not None:
                    below = [(v, around, bound, depth) for v in values] + below[2:]
                elif local and key in LOOPS and len(kids) > 1:
                    below = [(v, around, bound, depth) for v in tree.nodes[kids[1]].children[1:]] + below[2:]
                elif shape:
                    below = [(c, shape.name, bound, depth) for c in kids[shape.body :]]
        stack.extend(reversed(below))
    found.sort(key=lambda c: c.node)
    return found, live


def shape(tree: Tree, k: int, keep_head: bool = True) -> str:
    """The nested delimiters of a form, its atoms made alike; the head of the
    form itself may stay."""
    out: list[str] = []
    stack: list[tuple[int | None, bool, str]] = [(k, keep_head, "")]
    while stack:
        at, head, text = stack.pop()
        if at is None:
            out.append(text)
            continue
        node = tree.nodes[at]
        if node.kind == "atom":
            out.append("_atom")
            continue
        out.append(f"({node.delimiter or 'root'} ")
        todo: list[tuple[int | None, bool, str]] = []
        for i, c in enumerate(node.children):
            if i:
                todo.append((None, False, " "))
            if head and i == 0 and tree.nodes[c].kind == "atom":
                todo.append((None, False, "head:" + tree.text(c)))
            else:
                todo.append((c, False, ""))
        stack.append((None, False, ")"))
        stack.extend(reversed(todo))
    return "".join(out)


@lru_cache(maxsize=1 << 16)
def _known(said: bytes) -> bytes:
    return hashlib.blake2b(said, digest_size=16).digest()


def _digest(parts: list[bytes]) -> bytes:
    """Shapes recur: the digests of small ones are kept."""
    said = b"".join(parts)
    return _known(said) if len(said) <= 512 else hashlib.blake2b(said, digest_size=16).digest()


_ATOM = _digest([b"atom"])


def shape_hashes(tree: Tree) -> list[str | None]:
    """A digest of the shape of each paren list, its own head kept, bottom-up:
    equal subtrees have one digest, and each node is read once."""
    nodes = tree.nodes
    inner: list[bytes] = [_ATOM] * len(nodes)
    out: list[str | None] = [None] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        node = nodes[k]
        if node.kind == "atom":
            continue
        parts = [_known((node.delimiter or "root").encode()), *[inner[c] for c in node.children]]
        inner[k] = _digest(parts)
        if node.kind == "list" and node.delimiter == "paren":
            if node.children and nodes[node.children[0]].kind == "atom":
                parts[1] = hashlib.blake2b(b"head:" + tree.text(node.children[0]).encode("utf-8", "surrogatepass"), digest_size=16).digest()
            out[k] = hashlib.blake2b(b"".join(parts), digest_size=16).hexdigest()
    return out


def shaped(tree: Tree, least: int, wanted: set[str]) -> dict[str, list]:
    """shape_hash, node_id, subtree_nodes, head and path (of these, those wanted)
    of the paren lists of at least so many nodes."""
    nodes = tree.nodes
    size = [1] * len(nodes)
    for k in range(len(nodes) - 1, 0, -1):
        size[nodes[k].parent] += size[k]
    some = [k for k, x in enumerate(nodes) if x.kind == "list" and x.delimiter == "paren" and size[k] >= least]
    hashes = shape_hashes(tree) if some else []
    out = {"shape_hash": [hashes[k] for k in some], "node_id": some, "subtree_nodes": [size[k] for k in some]}
    if "head" in wanted:
        out["head"] = [tree.head(k) for k in some]
    if "path" in wanted:
        out["path"] = [tree.path(k) for k in some]
    return out


_CHANGED = re.compile(rb"[:\\|]")


def named(tree: Tree) -> tuple[list[tuple], list[str], list[str]]:
    """The definitions at the top (needle, uses of the name in the form itself,
    path, name, category, start, end), the needles of all other uses, and those
    that packages export."""
    from parenlake.functions.scope import local_atoms

    nodes, source = tree.nodes, tree.source
    # Most texts have no escapes, packages or letters beyond ASCII: their needles
    # are in upper case, their operators in lower case.
    upper = lower = None
    if source.isascii() and not _CHANGED.search(source):
        text = source.decode("ascii")
        upper, lower = text.upper(), text.lower()
        needles = [upper[x.content : x.end] or None if x.kind == "atom" else None for x in nodes]
    else:
        symbols = [tree.symbol(k) if x.kind == "atom" else None for k, x in enumerate(nodes)]
        needles = [needle(s) if s else None for s in symbols]
    local = local_atoms(tree, needles, lower)
    packages = b"defpackage" in source.lower()
    made: list[tuple] = []
    uses: list[str] = []
    exported: list[str] = []
    tops = nodes[0].children
    for i, k in enumerate(tops):
        after = tops[i + 1] if i + 1 < len(tops) else len(nodes)
        inside: range | list[int] = range(k, after)
        if packages:
            inside, outer = [], inside
            skip = k
            for c in outer:
                if c < skip:
                    continue
                head = tree.head(c) if nodes[c].kind == "list" else None
                if head is not None and operator_key(head) == "defpackage":
                    below = tree.subtree(c)
                    skip = below.stop
                    lists = [x for x in below if nodes[x].kind == "list" and (tree.head(x) or "").lower() == ":export"]
                    exported += [needles[x] for at in lists for x in nodes[at].children[1:] if nodes[x].kind == "atom" and needles[x] is not None]
                else:
                    inside.append(c)
        used = [x for c in inside if (x := needles[c]) is not None and c not in local and not nodes[c].opaque]
        it = definition(tree, k)
        if it and it.name and tree.head(k).lower() != "in-package":
            key = needle(it.name) if upper is None else it.name.upper()
            others = [x for x in used if x != key]
            made.append((key, len(used) - len(others), str(i), it.name, it.category, nodes[k].start, nodes[k].end))
            used = others
        uses += used
    return made, uses, exported


#: Columns that ``sites`` has.
SITES = frozenset("depth path kind head span_start span_end n_children category def_needle min_arity max_arity has_lambda is_call call_needle enclosing".split())


def sites(tree: Tree, wanted: set[str]) -> dict[str, list]:
    """``columns`` of the nodes that are calls or definitions alone."""
    nodes = tree.nodes
    its = {k: it for k, x in enumerate(nodes) if x.kind == "list" and x.children and (it := definition(tree, k))}
    made = {c.node: c for c in calls(tree)[0]}
    at = sorted({*its, *made})
    some = [(k, nodes[k], its.get(k), made.get(k)) for k in at]
    out: dict[str, list] = {
        "kind": ["list"] * len(at), "span_start": [x.start for _, x, _, _ in some], "span_end": [x.end for _, x, _, _ in some], "n_children": [len(x.children) for _, x, _, _ in some],
        "head": [tree.head(k) for k in at], "category": [it.category if it else None for _, _, it, _ in some], "def_needle": [needle(it.name) if it and it.name else None for _, _, it, _ in some],
        "has_lambda": [it is not None and it.parameters is not None for _, _, it, _ in some], "is_call": [c is not None for *_, c in some],
        "call_needle": [needle(c.head) if c else None for *_, c in some], "enclosing": [c.enclosing if c else None for *_, c in some],
    }
    if not wanted.isdisjoint(("min_arity", "max_arity")):
        bounds = [arity(tree, x.children[it.parameters]) if it and it.parameters is not None else (None, None) for _, x, it, _ in some]
        out |= {"min_arity": [b[0] for b in bounds], "max_arity": [b[1] for b in bounds]}
    if not wanted.isdisjoint(("path", "depth")):
        place = {c: i for x in nodes if x.children for i, c in enumerate(x.children)}
        paths = []
        for k in at:
            steps = []
            while k:
                steps.append(place[k])
                k = nodes[k].parent
            paths.append(steps[::-1])
        out |= {"path": paths, "depth": [len(p) for p in paths]}
    return out


def columns(tree: Tree, wanted: set[str] | None = None) -> dict[str, list]:
    """The columns of the ``nodes`` table, a value for each node; of those
    ``wanted`` only, and only what these need is worked out. None: all but
    shape_hash."""
    nodes, n = tree.nodes, len(tree.nodes)
    need = (lambda *names: wanted is None or not wanted.isdisjoint(names)) if wanted is not None else (lambda *names: "shape_hash" not in names)
    depth, sib = [0] * n, [0] * n
    for k, node in enumerate(nodes):
        below = depth[k] + 1
        for i, c in enumerate(node.children):
            depth[c], sib[c] = below, i
    out: dict[str, list] = {
        "node_id": list(range(n)), "parent_id": [x.parent if k else None for k, x in enumerate(nodes)], "sib_idx": sib, "depth": depth,
        "kind": [x.kind for x in nodes], "span_start": [x.start for x in nodes], "span_end": [x.end for x in nodes], "n_children": [len(x.children) for x in nodes],
    }
    heads = [tree.head(k) if x.kind == "list" else None for k, x in enumerate(nodes)]
    out["head"] = heads
    if need("delimiter"):
        out["delimiter"] = [x.delimiter for x in nodes]
    if need("prefixes"):
        out["prefixes"] = [list(x.prefixes) for x in nodes]
    if need("content_start", "open_off", "close_off"):
        out |= {"content_start": [x.content for x in nodes], "open_off": [x.open for x in nodes], "close_off": [x.close for x in nodes]}
    if need("path"):
        paths: list[list[int]] = [[] for _ in range(n)]
        for k, node in enumerate(nodes):
            for i, c in enumerate(node.children):
                paths[c] = [*paths[k], i]
        out["path"] = paths
    if need("last_id", "subtree_nodes", "leaf_count"):
        last, size, leaves = list(range(n)), [1] * n, [0] * n
        for k in range(n - 1, -1, -1):
            kids = nodes[k].children
            if kids:
                last[k] = last[kids[-1]]
                size[k] += sum(size[c] for c in kids)
            leaves[k] = sum(leaves[c] for c in kids) if kids else 1
        out |= {"last_id": last, "subtree_nodes": size, "leaf_count": leaves}
    if need("text"):
        out["text"] = [tree.text(k) if x.kind == "atom" else None for k, x in enumerate(nodes)]
    if need("symbol", "needle"):
        symbols = [tree.symbol(k) if x.kind == "atom" else None for k, x in enumerate(nodes)]
        out |= {"symbol": symbols, "needle": [needle(x) if x else None for x in symbols]}
    if need("opaque", "opaque_above"):
        above = [False] * n
        for k, node in enumerate(nodes):
            above[k] = node.opaque or (k > 0 and above[node.parent])
        out |= {"opaque": [x.opaque for x in nodes], "opaque_above": above}
    if need("top_id", "in_defpackage"):
        top, packaged = [0] * n, [False] * n
        for k, node in enumerate(nodes):
            top[k] = k if depth[k] == 1 else top[max(node.parent, 0)]
            packaged[k] = (heads[k] is not None and operator_key(heads[k]) == "defpackage") or (k > 0 and packaged[node.parent])
        out |= {"top_id": top, "in_defpackage": packaged}
    if need("definition_like"):
        out["definition_like"] = [bool(h) and is_definition_head(tree.dialect, h) for h in heads]
    if need("category", "def_name", "def_needle", "parameter_count", "body_forms", "min_arity", "max_arity", "has_lambda"):
        its = [definition(tree, k) if h is not None else None for k, h in enumerate(heads)]
        lists = [nodes[k].children[it.parameters] if it and it.parameters is not None else None for k, it in enumerate(its)]
        bounds = [arity(tree, x) if x is not None else (None, None) for x in lists]
        out |= {
            "category": [it.category if it else None for it in its], "def_name": [it.name if it else None for it in its],
            "def_needle": [needle(it.name) if it and it.name else None for it in its],
            "parameter_count": [parameter_count(tree, x) if x is not None else None for x in lists],
            "body_forms": [max(0, len(nodes[k].children) - it.body) if it else None for k, it in enumerate(its)],
            "min_arity": [b[0] for b in bounds], "max_arity": [b[1] for b in bounds], "has_lambda": [x is not None for x in lists],
        }
    if need("qq_depth", "live", "is_call", "call_needle", "enclosing"):
        found, live = calls(tree)
        by_node = {c.node: c for c in found}
        made = [by_node.get(k) for k in range(n)]
        out |= {
            "qq_depth": live, "live": [x is not None for x in live], "is_call": [c is not None for c in made],
            "call_needle": [needle(c.head) if c else None for c in made], "enclosing": [c.enclosing if c else None for c in made],
        }
    if need("local"):
        from parenlake.functions.scope import local_atoms

        mine = local_atoms(tree)
        out["local"] = [k in mine for k in range(n)]
    if need("line_span"):
        out["line_span"] = [1 + tree.source.count(b"\n", x.start, max(x.start, x.end - 1)) for x in nodes]
    if need("shape_hash"):
        out["shape_hash"] = shape_hashes(tree)
    elif wanted is None:
        out["shape_hash"] = [None] * n
    return out
