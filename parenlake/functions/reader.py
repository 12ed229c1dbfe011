"""Reading source text into a tree, in any dialect.

The reader works on UTF-8 bytes, so all offsets are byte offsets. It keeps its
own stack and never recurses. Nodes are numbered in preorder; node 0 is the
root. Comments and discarded forms stay outside the tree.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from parenlake.functions.dialects import LEXIS, Lexis

CLOSER = {b"(": b")", b"[": b"]", b"{": b"}"}
DELIMITER = {b"(": "paren", b"[": "bracket", b"{": "brace"}
#: Fixed value: levels of nesting a discarded form may have.
DISCARD_LIMIT = 65_536


#: White space and an atom that reads alike in every dialect, as most do, or a
#: parenthesis.
PLAIN = re.compile(rb"[ \t\n\r\x0c]*+(?:([A-Za-z0-9_*+/<>=!.:%$&\x80-\xff-]++)(?=[ \t\n\r\x0c()\[\]{}]|\Z)|(\()|(\)))")
#: Bytes with which prefixes and discards of any dialect start.
SPECIAL = frozenset(b"'`,#^~@;|")


class Unreadable(ValueError):
    """A text that can't be read: code, byte position, message."""

    def __init__(self, code: str, position: int, message: str) -> None:
        super().__init__(message)
        self.code, self.position, self.message = code, position, message


@dataclass(slots=True)
class Node:
    kind: str
    start: int
    end: int
    parent: int
    content: int  # where the text after prefixes starts
    delimiter: str | None = None
    prefixes: tuple[str, ...] = ()
    open: int | None = None
    close: int | None = None
    opaque: bool = False
    children: list[int] = field(default_factory=list)


@dataclass
class Tree:
    source: bytes
    dialect: str
    nodes: list[Node]
    comments: list[tuple[int, int, bool]]

    def text(self, k: int) -> str:
        """A node's whole text, prefixes included."""
        node = self.nodes[k]
        return self.source[node.start : node.end].decode("utf-8", "replace")

    def symbol(self, k: int) -> str:
        """An atom's text after its prefixes."""
        node = self.nodes[k]
        return self.source[node.content : node.end].decode("utf-8", "replace")

    def head(self, k: int) -> str | None:
        """The text of a list's first child, if that is an atom."""
        children = self.nodes[k].children
        return self.text(children[0]) if children and self.nodes[children[0]].kind == "atom" else None

    def path(self, k: int) -> list[int]:
        steps = []
        while k:
            parent = self.nodes[k].parent
            steps.append(self.nodes[parent].children.index(k))
            k = parent
        return steps[::-1]

    def at_path(self, path: list[int]) -> int:
        k = 0
        for step in path:
            if not 0 <= step < len(self.nodes[k].children):
                raise ValueError(f"no child {step}; there are {len(self.nodes[k].children)}")
            k = self.nodes[k].children[step]
        return k

    def at_offset(self, offset: int) -> int:
        """The smallest node that holds a byte; of equals the first."""
        holding = [(n.end - n.start, k) for k, n in enumerate(self.nodes) if n.start <= offset < n.end]
        if not holding:
            raise ValueError(f"no node at byte {offset}")
        return min(holding)[1]

    def subtree(self, k: int) -> range:
        """A node and all below it."""
        last = k
        while self.nodes[last].children:
            last = self.nodes[last].children[-1]
        return range(k, last + 1)


class Scanner:
    """A dialect's patterns, compiled."""

    def __init__(self, lexis: Lexis) -> None:
        blank = b"[" + re.escape(lexis.spaces) + b"]"
        edge = re.escape(lexis.spaces + b"()[]{}" + lexis.comment)
        self.blanks = re.compile(blank + b"*")
        self.comment = re.compile(re.escape(lexis.comment) + rb"[^\n]*")
        self.block = lexis.block
        plain = rb"[^" + edge + (rb"\\|" if lexis.escapes else b"") + rb"]+"
        escaped = rb"\\[\s\S]|\|(?:[^|\\]|\\[\s\S])*\|" if lexis.escapes else rb"(?!)"
        self.atom = re.compile(rb"(?:" + plain + rb"|" + escaped + rb")*")
        self.string = re.compile(rb'"(?:[^"\\]|\\[\s\S])*"')
        self.prefixes = [(re.compile(p), meaning) for p, meaning in lexis.prefixes]
        self.discards = [re.compile(p) for p in lexis.discards]
        self.opaque = [(re.compile(p), n) for p, n in lexis.opaque]
        self.refused = re.compile(lexis.refused) if lexis.refused else None
        self.character = re.compile(rb"(?:" + lexis.character + rb")(?:[\x00-\x7f]|[\xc0-\xff][\x80-\xbf]*)") if lexis.character else None
        self.opens = lexis.opens
        self.closes = b"".join(CLOSER[bytes([c])] for c in lexis.opens)
        self.escapes = lexis.escapes
        self.blank = lexis.spaces

    def skip_blank(self, source: bytes, at: int, comments: list[tuple[int, int]] | None) -> int:
        """Past white space and comments."""
        while True:
            at = self.blanks.match(source, at).end()
            start = at
            if self.block and source.startswith(b"#|", at):
                at = self.block_end(source, at)
            elif m := self.comment.match(source, at):
                at = m.end()
            else:
                return at
            if comments is not None:
                comments.append((start, at))

    @staticmethod
    def block_end(source: bytes, at: int) -> int:
        start, depth = at, 0
        for m in re.compile(rb"#\||\|#").finditer(source, at):
            depth += 1 if m[0] == b"#|" else -1
            if not depth:
                return m.end()
        raise Unreadable("unterminated-block-comment", start, f"unterminated block comment starting at byte {start}")

    def discard(self, source: bytes, at: int) -> int | None:
        return next((m.end() for p in self.discards if (m := p.match(source, at))), None)

    def prefix(self, source: bytes, at: int) -> tuple[int, str] | None:
        return next(((m.end(), meaning) for p, meaning in self.prefixes if (m := p.match(source, at))), None)

    def take_along(self, source: bytes, at: int) -> tuple[int, int] | None:
        return next(((m.end(), n) for p, n in self.opaque if (m := p.match(source, at))), None)

    def refuse(self, source: bytes, at: int) -> None:
        if self.refused and (m := self.refused.match(source, at)):
            shown = source[at : max(m.end(), at + 2)].decode("utf-8", "replace")
            raise Unreadable("unsupported-reader-dispatch", at, f"unsupported reader dispatch '{shown}' at byte {at}")

    def atom_end(self, source: bytes, at: int) -> int:
        """End of the string or atom that starts here."""
        if source[at] == 34:
            m = self.string.match(source, at)
            if not m:
                raise Unreadable("unterminated-string", at, f"unterminated string starting at byte {at}")
            return m.end()
        if not self.refused and not self.opaque and source[at : at + 2] in (b"#+", b"#-") and self.escapes:
            return at + 2  # the permissive reader splits feature tests
        begin = m.end() if self.character and (m := self.character.match(source, at)) else at
        end = self.atom.match(source, begin).end()
        if self.escapes and source[end : end + 1] == b"|":
            raise Unreadable("unterminated-symbol", end, f"unterminated multiple-escape symbol starting at byte {end}")
        if self.escapes and source[end : end + 1] == b"\\":
            raise Unreadable("dangling-single-escape", end, f"single escape at byte {end} is missing an escaped character")
        return max(end, at + 1)

    def skip_form(self, source: bytes, at: int, missing: int) -> int:
        """Past one form that makes no node."""
        stack: list[tuple[int, bytes, int]] = []  # closer and open of lists, forms still due above
        due = 1
        while due or stack:
            at = self.skip_blank(source, at, None)
            if at >= len(source):
                if stack:
                    raise Unreadable("unclosed-list", stack[-1][2], f"unclosed list starting at byte {stack[-1][2]}")
                raise Unreadable("missing-reader-form", missing, f"reader prefix or discard at byte {missing} is missing a form")
            if (end := self.discard(source, at)) is not None:
                at, due = end, due + 1
                if len(stack) + due > DISCARD_LIMIT:
                    raise Unreadable("resource-limit-exceeded", at, f"discarded reader form complexity limit exceeded at byte {at}: maximum is {DISCARD_LIMIT} parser frames")
                continue
            if found := self.prefix(source, at):
                at, meaning = found
                due += meaning == "metadata" and self.character is not None
                continue
            if taken := self.take_along(source, at):
                at, due = taken[0], due + taken[1] - 1
            else:
                self.refuse(source, at)
                byte = source[at : at + 1]
                if byte in CLOSER and byte in self.opens:
                    stack.append((due, CLOSER[byte], at))
                    if len(stack) > DISCARD_LIMIT:
                        raise Unreadable("resource-limit-exceeded", at, f"discarded reader form complexity limit exceeded at byte {at}: maximum is {DISCARD_LIMIT} parser frames")
                    due, at = 1 << 60, at + 1
                    continue
                if byte in b")]}":
                    if not stack or due < 1 << 59:
                        raise Unreadable("missing-reader-form", missing, f"reader prefix or discard at byte {missing} is missing a form")
                    if stack[-1][1] != byte:
                        raise mismatched(byte, stack[-1][1], at)
                    due, at = stack.pop()[0] - 1, at + 1
                    continue
                if byte in b"([{":
                    raise raw(byte, at)
                at, due = self.atom_end(source, at), due - 1
        return at


def mismatched(found: bytes, wanted: bytes, at: int) -> Unreadable:
    return Unreadable("mismatched-close", at, f"mismatched closing delimiter '{found.decode()}' at byte {at}; expected '{wanted.decode()}'")


def raw(byte: bytes, at: int) -> Unreadable:
    if byte in b")]}":
        return Unreadable("unexpected-close", at, f"unexpected closing delimiter '{byte.decode()}' at byte {at}")
    return Unreadable("unsupported-reader-dispatch", at, f"unsupported reader dispatch '{byte.decode()}' at byte {at}")


@lru_cache(maxsize=None)
def scanner(dialect: str) -> Scanner:
    return Scanner(LEXIS[dialect])


def read(text: str | bytes, dialect: str = "unknown") -> Tree:
    """Read a whole text; raises ``Unreadable``."""
    tree, still = _read(text, dialect)
    if still:
        at = tree.nodes[still[-1]].open
        raise Unreadable("unclosed-list", at, f"unclosed list starting at byte {at}")
    return tree


def closers(text: str | bytes) -> str:
    """The delimiters that would close a text's open lists, innermost first, as
    the permissive reader sees them."""
    tree, still = _read(text, "unknown")
    return "".join(CLOSER[tree.source[tree.nodes[k].open : tree.nodes[k].open + 1]].decode() for k in reversed(still))


def _read(text: str | bytes, dialect: str) -> tuple[Tree, list[int]]:
    source = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    scan = scanner(dialect)
    nodes = [Node("root", 0, len(source), -1, 0)]
    stack, comments, at = [0], [], 0
    plain = PLAIN.match
    while True:
        while m := plain(source, at):
            which = m.lastindex
            if which == 1:
                start, at = m.span(1)
                above = stack[-1]
                nodes[above].children.append(len(nodes))
                nodes.append(Node("atom", start, at, above, start))
            elif which == 2:
                at = m.end()
                above, start = stack[-1], at - 1
                nodes[above].children.append(len(nodes))
                stack.append(len(nodes))
                nodes.append(Node("list", start, at, above, start, "paren", (), start))
            else:
                node = nodes[stack[-1]]
                if node.delimiter != "paren":
                    break  # closes no such list: told below
                at = m.end()
                node.close, node.end = at - 1, at
                stack.pop()
        at = scan.skip_blank(source, at, comments)
        if at >= len(source):
            break
        start, prefixes = at, []
        while source[at] in SPECIAL:
            if (end := scan.discard(source, at)) is not None:
                done = scan.skip_form(source, end, at)
                comments.append((at, done))
                if not prefixes:
                    at = start = -1
                    resume = done
                    break
                at = scan.skip_blank(source, done, comments)
            elif found := scan.prefix(source, at):
                prefixes.append(found[1])
                at = scan.skip_blank(source, found[0], comments)
            else:
                break
            if at >= len(source):
                raise Unreadable("missing-reader-form", start, f"reader prefix or discard at byte {start} is missing a form")
        if start < 0:
            at = resume
            continue
        if source[at] == 35 and (taken := scan.take_along(source, at)):
            origin, at = at, taken[0]
            for _ in range(taken[1]):
                at = scan.skip_form(source, at, origin)
            nodes[stack[-1]].children.append(len(nodes))
            nodes.append(Node("atom", start, at, stack[-1], start, opaque=True))
            continue
        if source[at] == 35:
            scan.refuse(source, at)
        byte = source[at : at + 1]
        if byte in CLOSER and byte in scan.opens:
            nodes[stack[-1]].children.append(len(nodes))
            nodes.append(Node("list", start, at + 1, stack[-1], at, DELIMITER[byte], tuple(prefixes), at))
            stack.append(len(nodes) - 1)
            at += 1
        elif byte in scan.closes and byte:
            if len(stack) == 1:
                raise raw(byte, at)
            node = nodes[stack[-1]]
            wanted = CLOSER[source[node.open : node.open + 1]]
            if wanted != byte:
                raise mismatched(byte, wanted, at)
            node.close, node.end = at, at + 1
            stack.pop()
            at += 1
        elif byte in b"()[]{}":
            raise raw(byte, at)
        else:
            end = scan.atom_end(source, at)
            nodes[stack[-1]].children.append(len(nodes))
            nodes.append(Node("atom", start, end, stack[-1], at, None, tuple(prefixes)))
            at = end
    blank = scan.blank
    told = [(a, b, all(c in blank for c in source[source.rfind(b"\n", 0, a) + 1 : a])) for a, b in comments]
    return Tree(source, dialect, nodes, told), stack[1:]
