"""Laying out source text: a table of heads, and one way to write each kind.

A form whose head is in the table is always broken after its first arguments;
any other stays on one line while it fits and holds no such form. Bodies are
indented by depth, aligned lists stand under their first item.
"""

from __future__ import annotations

from itertools import batched

from parenlake.functions.dialects import CATEGORIES, operator_key
from parenlake.functions.reader import Tree

WIDTH = 80
#: Forms nested deeper than this stay as they are.
DEEPEST = 200

#: Heads by how they are written, and how many arguments stay on
#: the first line.
KINDS: dict[str, tuple[str, int]] = {
    **{head: ("body", 2) for head in CATEGORIES["common-lisp"]},
    "define-symbol-macro": ("body", 1),
    **{head: ("method", 0) for head in ("defmethod", "cl-defmethod")},
    **{head: ("system", 1) for head in ("defsystem", "asdf:defsystem")},
    **{head: ("bindings", 0) for head in ("let", "let*", "symbol-macrolet", "handler-bind", "restart-bind")},
    **{head: ("functions", 0) for head in ("flet", "labels", "macrolet", "compiler-macrolet")},
    **{head: ("clauses", 1) for head in ("handler-case", "restart-case")},
    **{head: ("branches", 1) for head in ("case", "ccase", "ecase", "typecase", "ctypecase", "etypecase")},
    "cond": ("branches", 0),
    **{head: ("steps", 1) for head in ("do", "do*")},
    **{head: ("steps", 0) for head in ("prog", "prog*")},
    **{head: ("aligned", 1) for head in ("declare", "declaim", "proclaim")},
    **{head: ("aligned", 2) for head in ("setq", "psetq", "setf", "psetf")},
    "loop": ("loop", 0),
    **{head: ("body", 0) for head in ("progn", "prog1", "prog2", "tagbody", "locally")},
    **{
        head: ("body", 1)
        for head in (
            "lambda dolist dotimes do-symbols do-external-symbols do-all-symbols with-slots with-accessors when unless with-open-file with-open-stream "
            "with-input-from-string with-output-to-string with-hash-table-iterator with-package-iterator block catch unwind-protect eval-when"
        ).split()
    },
    **{head: ("body", 2) for head in ("named-lambda", "multiple-value-bind", "destructuring-bind", "if")},
}
#: Words that begin a clause of a loop, those that ask, and those that act.
LOOP_ASKS = ("if", "when", "unless", "else")
LOOP_ACTS = "do doing return collect collecting append appending nconc nconcing count counting sum summing maximize maximizing minimize minimizing".split()
LOOP_WORDS = ("for as with and repeat initially finally while until always never thereis end".split(), LOOP_ASKS, LOOP_ACTS)
_LOOP = {word for words in LOOP_WORDS for word in words}


class Layout:
    def __init__(self, tree: Tree, indent: int = 2) -> None:
        self.tree, self.indent = tree, indent
        # Each form on one line, where it fits and may stand so; inner forms first.
        self.lines: list[str | None] = [None] * len(tree.nodes)
        for k in range(len(tree.nodes) - 1, 0, -1):
            node = tree.nodes[k]
            if node.kind == "atom" or node.opaque:
                text = self.verbatim(k)
                self.lines[k] = text if len(text) <= WIDTH else None
            elif not self.kind(k):
                self.lines[k] = self.one_line(k)

    def kind(self, k: int) -> tuple[str, int] | None:
        kids = self.tree.nodes[k].children
        if not kids or self.tree.nodes[kids[0]].kind != "atom" or self.tree.nodes[kids[0]].prefixes:
            return None
        return KINDS.get(operator_key(self.tree.text(kids[0])))

    def marks(self, k: int) -> tuple[str, str]:
        """A list's prefixes with its opening delimiter, and its closing one."""
        node, source = self.tree.nodes[k], self.tree.source
        return source[node.start : node.open].decode().strip() + chr(source[node.open]), chr(source[node.close])

    def verbatim(self, k: int) -> str:
        node = self.tree.nodes[k]
        return self.tree.source[node.start : node.end].decode()

    def one_line(self, k: int) -> str | None:
        """A list on one line, if it fits there, whatever its head."""
        opened, closed = self.marks(k)
        parts = [self.lines[c] for c in self.tree.nodes[k].children]
        text = None if None in parts else opened + " ".join(parts) + closed
        return text if text is not None and len(text) <= WIDTH else None

    def short(self, k: int, depth: int) -> str:
        found = self.lines[k]
        return self.form(k, depth) if found is None else found

    def form(self, k: int, depth: int) -> str:
        """A form as it stands ``depth`` levels in."""
        node = self.tree.nodes[k]
        if node.kind == "atom" or node.opaque or depth >= DEEPEST:
            return self.verbatim(k)
        kind = self.kind(k)
        if not node.children or (kind is None and self.lines[k] is not None):
            return self.lines[k] or self.verbatim(k)
        opened, closed = self.marks(k)
        name, first = kind or ("body", 0)
        return opened + getattr(self, "_" + name)(k, node.children, depth, first) + closed

    def start(self, depth: int) -> str:
        return "\n" + " " * (self.indent * depth)

    def column(self, kids: list[int], depth: int, more: int) -> str:
        return "\n" + " " * (self.indent * depth + len(self.tree.text(kids[0])) + more)

    def _body(self, k: int, kids: list[int], depth: int, first: int) -> str:
        out = self.form(kids[0], depth + 1)
        for i, c in enumerate(kids[1:], 1):
            out += " " + self.short(c, depth + 1) if i <= first else self.start(depth + 1) + self.form(c, depth + 1)
        return out

    def _method(self, k: int, kids: list[int], depth: int, first: int) -> str:
        lists = [i for i, c in enumerate(kids) if i > 1 and self.tree.nodes[c].kind == "list"]
        return self._body(k, kids, depth, lists[0] if lists else 0)

    def _system(self, k: int, kids: list[int], depth: int, first: int) -> str:
        flat = self.one_line(k)
        if flat is not None:
            opened, closed = self.marks(k)
            return flat[len(opened) : len(flat) - len(closed)]
        out = " ".join(self.short(c, depth + 1) for c in kids[:2])
        return out + "".join(self.start(depth + 1) + " ".join(self.short(c, depth + 1) for c in pair) for pair in batched(kids[2:], 2))

    def _aligned(self, k: int, kids: list[int], depth: int, first: int) -> str:
        """Arguments in groups of ``first``, each group under the one before."""
        groups = [" ".join(self.short(c, depth + 1) for c in some) for some in batched(kids[1:], first)]
        return self.form(kids[0], depth + 1) + (" " if groups else "") + self.column(kids, depth, 2).join(groups)

    def _bindings(self, k: int, kids: list[int], depth: int, first: int, item: str = "short") -> str:
        out = self.form(kids[0], depth + 1)
        if len(kids) > 1:
            out += " " + self.items(kids[1], depth + 1, self.column(kids, depth, 3), item)
        return out + "".join(self.start(depth + 1) + self.form(c, depth + 1) for c in kids[2:])

    def _functions(self, k: int, kids: list[int], depth: int, first: int) -> str:
        return self._bindings(k, kids, depth, first, "function")

    def _steps(self, k: int, kids: list[int], depth: int, first: int) -> str:
        """do and prog; the first also ends with a clause of its own."""
        out = self._bindings(k, kids[:2], depth, 0)
        for i, c in enumerate(kids[2:]):
            out += self.start(depth + 1) + (self.branch(c, depth + 1) if i < first else self.form(c, depth + 1))
        return out

    def items(self, k: int, depth: int, under: str, item: str) -> str:
        """A list of bindings, each under the first; a vector's in pairs."""
        node = self.tree.nodes[k]
        if node.kind != "list" or not node.children:
            return self.short(k, depth)
        opened, closed = self.marks(k)
        if node.delimiter == "bracket" and len(node.children) % 2 == 0 and item == "short":
            parts = [" ".join(self.short(c, depth + 1) for c in pair) for pair in batched(node.children, 2)]
        elif item == "function":
            parts = [self.function(c, depth + 1, under + " " * self.indent) for c in node.children]
        else:
            parts = [self.short(c, depth + 1) for c in node.children]
        return opened + under.join(parts) + closed

    def function(self, k: int, depth: int, under: str) -> str:
        """A local function: name and parameters, then the body under the name."""
        kids = self.tree.nodes[k].children
        if self.tree.nodes[k].kind != "list" or len(kids) < 3:
            return self.short(k, depth)
        opened, closed = self.marks(k)
        return opened + self.form(kids[0], depth + 1) + " " + self.short(kids[1], depth + 1) + "".join(under + self.form(c, depth + 1) for c in kids[2:]) + closed

    def _clauses(self, k: int, kids: list[int], depth: int, first: int) -> str:
        out = " ".join([self.form(kids[0], depth + 1), *[self.short(c, depth + 1) for c in kids[1 : first + 1]]])
        return out + "".join(self.start(depth + 1) + self.clause(c, depth + 1) for c in kids[first + 1 :])

    def clause(self, k: int, depth: int) -> str:
        """Condition and parameters on one line, then the body."""
        node = self.tree.nodes[k]
        if node.kind != "list" or not node.children:
            return self.form(k, depth)
        opened, closed = self.marks(k)
        return opened + self._body(k, node.children, depth, 1) + closed

    def _branches(self, k: int, kids: list[int], depth: int, first: int) -> str:
        out = " ".join([self.form(kids[0], depth + 1), *[self.short(c, depth + 1) for c in kids[1 : first + 1]]])
        return out + "".join(self.start(depth + 1) + self.branch(c, depth + 1) for c in kids[first + 1 :])

    def branch(self, k: int, depth: int) -> str:
        """A test and what follows from it: on one line if that is one form."""
        node = self.tree.nodes[k]
        if node.kind != "list" or len(node.children) < 3:
            return self.short(k, depth)
        opened, closed = self.marks(k)
        return opened + self.short(node.children[0], depth + 1) + "".join(self.start(depth + 1) + self.form(c, depth + 1) for c in node.children[1:]) + closed

    def _loop(self, k: int, kids: list[int], depth: int, first: int) -> str:
        word = lambda c: self.tree.text(c).lower() if self.tree.nodes[c].kind == "atom" else ""
        clauses: list[list[int]] = []
        for c in kids[1:]:
            if not clauses or word(c) in _LOOP:
                clauses.append([c])
            else:
                clauses[-1].append(c)
        out, asked = self.form(kids[0], depth + 1), False
        for i, clause in enumerate(clauses):
            begin = word(clause[0])
            deeper = " " * self.indent if asked and begin in LOOP_ACTS else ""
            out += (self.column(kids, depth, 2) + deeper if i else " ") + " ".join(self.short(c, depth + 1) for c in clause)
            asked = begin in LOOP_ASKS or (asked and begin != "end" and begin not in LOOP_ACTS)
        return out


def laid_out(tree: Tree, indent: int = 2) -> str:
    """The file with every top-level form laid out afresh and one blank line
    between them. Comments above a form and after it stay with it; a form that
    holds a comment stays as it is."""
    layout = Layout(tree, indent)
    text = lambda c: tree.source[c[0] : c[1]].decode().rstrip()
    rest = sorted(tree.comments)
    out = []
    for k in tree.nodes[0].children:
        node = tree.nodes[k]
        above = []
        while rest and rest[0][0] < node.start:
            above.append(text(rest.pop(0)))
        inside = False
        while rest and rest[0][0] < node.end:
            inside = True
            rest.pop(0)
        made = layout.verbatim(k) if inside else layout.form(k, 0)
        if rest and not rest[0][2] and b"\n" not in tree.source[node.end : rest[0][0]]:
            made += " " + text(rest.pop(0))
        out.append("\n".join([*above, made]))
    if rest:
        out.append("\n".join(map(text, rest)))
    return "\n\n".join(out) + ("\n" if out else "")
