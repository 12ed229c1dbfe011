"""What the dialects differ in, as data."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

DIALECTS = ("common-lisp", "emacs-lisp", "scheme", "clojure", "janet", "fennel", "unknown")

#: File extension -> dialect; case matters.
EXTENSIONS = {
    "lisp": "common-lisp", "lsp": "common-lisp", "cl": "common-lisp", "asd": "common-lisp",
    "el": "emacs-lisp",
    "scm": "scheme", "ss": "scheme", "sld": "scheme",
    "clj": "clojure", "cljs": "clojure", "cljc": "clojure", "edn": "clojure",
    "janet": "janet",
    "fnl": "fennel",
}

#: Heads of definitions and their category, by dialect.
CATEGORIES: dict[str, dict[str, str]] = {
    "common-lisp": {
        "defun": "function",
        "defmacro": "macro", "define-method-combination": "macro", "define-compiler-macro": "macro",
        "define-modify-macro": "macro", "define-setf-expander": "macro", "defsetf": "macro",
        "defgeneric": "generic-function",
        "defmethod": "method", "cl-defmethod": "method",
        "defclass": "class", "defstruct": "struct", "deftype": "struct",
        "define-condition": "condition",
        "defvar": "variable", "defglobal": "variable", "define-symbol-macro": "variable",
        "defconstant": "constant", "defparameter": "parameter",
        "defpackage": "package", "in-package": "package", "provide": "package", "require": "package",
        "use-package": "package", "import": "package",
        "defsystem": "system", "asdf:defsystem": "system",
    },
    "emacs-lisp": {
        "defun": "function", "defsubst": "function", "cl-defun": "function",
        "defmacro": "macro", "cl-defmacro": "macro",
        "cl-defgeneric": "generic-function", "cl-defmethod": "method",
        "defvar": "variable", "defconst": "constant",
        "defcustom": "customization", "defgroup": "customization",
        "define-minor-mode": "mode", "define-derived-mode": "mode",
        "provide": "package", "require": "package",
    },
    "scheme": {"define": "function", "lambda": "function", "define-syntax": "macro", "define-library": "package", "let": "other", "let*": "other"},
    "clojure": {
        "ns": "package", "def": "variable", "defn": "function", "defmacro": "macro", "defrecord": "struct",
        "deftype": "class", "defprotocol": "class", "defmulti": "generic-function", "defmethod": "method",
    },
    "janet": {"def": "variable", "def-": "variable", "defn": "function", "defn-": "function", "defmacro": "macro"},
    "fennel": {"fn": "function", "lambda": "function", "macro": "macro", "local": "variable", "global": "variable"},
    "unknown": {
        "cl-defun": "function", "defsubst": "function", "definline": "function", "defn": "function", "defn-": "function",
        "cl-defmacro": "macro", "cl-defgeneric": "generic-function", "cl-defmethod": "method",
        "cl-defclass": "class", "cl-defstruct": "struct", "defrecord": "struct",
        "def": "variable", "setq-default": "variable", "defconst": "constant", "defcustom": "customization",
        "deftest": "test", "define-test": "test", "ert-deftest": "test", "define-ert-test": "test",
        "defgroup": "customization", "defface": "customization",
        "define-minor-mode": "mode", "define-derived-mode": "mode", "define-globalized-minor-mode": "mode",
    },
}

#: Categories that take arguments, and those never removed in bulk.
CALLABLE = ("function", "macro", "generic-function", "method")
KEPT = ("struct", "test", "package", "system", "customization", "mode", "unknown-macro")
#: Packages whose operators are the standard's own.
HOME_PACKAGES = ("cl", "common-lisp", "cl-user", "common-lisp-user")


@dataclass(frozen=True)
class Lexis:
    """How a dialect's text falls into tokens."""

    opens: bytes
    spaces: bytes
    comment: bytes
    block: bool
    escapes: bool
    prefixes: tuple[tuple[bytes, str], ...]  # pattern, meaning
    discards: tuple[bytes, ...] = ()
    opaque: tuple[tuple[bytes, int], ...] = ()  # pattern, forms it takes along
    refused: bytes = b""
    character: bytes = b""


_BLANK = b" \t\n\r\x0c"
_QUOTES = ((rb"'", "quote"), (rb"`", "quasiquote"), (rb",@", "unquote-splicing"), (rb",", "unquote"))
_CLOJURE_TAG = rb"#(?:[A-Za-z*+!_'?<>=-][^\s,()\[\]{};/]*(?:/[^\s,()\[\]{};/]+)?)(?=[\s,()\[\]{};]|\Z)"

#: One row for each dialect; patterns are tried in order.
LEXIS: dict[str, Lexis] = {
    "common-lisp": Lexis(
        b"(", _BLANK, b";", True, True, (*_QUOTES, (rb"#'", "function"), (rb"#\.", "read-eval"), (rb"#(?=\()", "hash-literal")),
        opaque=((rb"#[+-]", 2), (rb"#\d+=", 1), (rb"#\d+#", 0), (rb"#\d*[aA]", 1), (rb"#[pPsS]", 1)),
        refused=rb"#(?![:\\*bBoOdDxX]|\d+[rR])",
    ),
    "emacs-lisp": Lexis(b"([", _BLANK, b";", False, False, (*_QUOTES, (rb"#'", "function")), refused=rb"#", character=rb"\?\\?"),
    "scheme": Lexis(
        b"(", _BLANK, b";", True, False, (*_QUOTES, (rb"#(?=\()", "hash-literal")), discards=(rb"#;",),
        opaque=((rb"#\d+=", 1), (rb"#\d+#", 0), (rb"#[uU]8(?=\()", 1)), refused=rb"#(?![\\tTfFbBoOdDxXeEiI])", character=rb"#\\",
    ),
    "clojure": Lexis(
        b"([{", _BLANK + b",", b";", False, False,
        ((rb"'", "quote"), (rb"`", "quasiquote"), (rb"~@", "unquote-splicing"), (rb"~", "unquote"), (rb"@", "function"), (rb"\^", "metadata"),
         (rb"#\?@(?=\()", "reader-conditional-splicing"), (rb"#\?(?=\()", "reader-conditional"), (rb"#'", "function"), (rb"#(?=[({])", "hash-literal")),
        discards=(rb"#_",), opaque=((rb'#(?=")', 1), (rb"#:(?::[^\s,()\[\]{};]*|[^\s,()\[\]{};:][^\s,()\[\]{};]*)(?=\{)", 1), (_CLOJURE_TAG, 1)),
        refused=rb"#(?!#)", character=rb"\\",
    ),
    "janet": Lexis(b"([{", _BLANK, b"#", False, False, ((rb";", "unquote-splicing"), (rb"~", "quasiquote"), (rb",", "unquote"), (rb"\|", "function"), (rb"@", "hash-literal"))),
    "fennel": Lexis(b"([{", _BLANK, b";", False, False, (*_QUOTES, (rb"#", "function"))),
    "unknown": Lexis(
        b"([{", _BLANK, b";", True, True,
        (*_QUOTES, (rb"\^", "metadata"), (rb"#\.", "read-eval"), (rb"#'", "function"), (rb"#\?@", "reader-conditional-splicing"), (rb"#\?", "reader-conditional"), (rb"#(?=[(\[{])", "hash-literal")),
        discards=(rb"#;", rb"#_"),
    ),
}


def dialect_of(path: str) -> str:
    """The dialect that a path's extension tells."""
    name = path.rsplit("/", 1)[-1]
    return EXTENSIONS.get(name.rsplit(".", 1)[1], "unknown") if "." in name[1:] else "unknown"


@lru_cache(maxsize=50_000)
def operator_key(head: str) -> str:
    """A head as operators are looked up: ASCII lower case, without the name of
    a standard package."""
    low = ascii_lower(head)
    package, mark, name = low.rpartition(":")
    return name if mark and package.rstrip(":") in HOME_PACKAGES else low


def ascii_lower(text: str) -> str:
    return text.lower() if text.isascii() else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


_CHANGED = re.compile(r"[:\\|]")
_MARK = re.compile(r"\\.|\|(?:\\.|[^|\\])*\||:", re.S)


@lru_cache(maxsize=50_000)
def needle(symbol: str) -> str:
    """The name a symbol is compared by: no package, no escapes, upper case
    where ASCII and not escaped."""
    if symbol.isascii() and not _CHANGED.search(symbol):
        return symbol.upper()
    name = symbol.removeprefix("#:")
    marks = [m.start() for m in _MARK.finditer(name) if m[0] == ":"]
    if marks and marks[-1] > 0:
        name = name[marks[-1] + 1 :]
    out, inside, at = [], False, 0
    while at < len(name):
        c = name[at]
        if c == "\\" and at + 1 < len(name):
            at += 1
            out.append(name[at])
        elif c == "|":
            inside = not inside
        else:
            out.append(c.upper() if not inside and "a" <= c <= "z" else c)
        at += 1
    return "".join(out)


def category(dialect: str, head: str) -> str | None:
    """The category of a definition with this head; None for other forms."""
    key = operator_key(head)
    if dialect in ("common-lisp", "unknown") and key in CATEGORIES["common-lisp"]:
        return CATEGORIES["common-lisp"][key]
    if dialect == "common-lisp":
        return "test" if key == "deftest" else "unknown-macro" if key.startswith("define-") else None
    found = CATEGORIES[dialect].get(key)
    if found or dialect != "unknown":
        return found
    if is_definition_head(dialect, head):
        return "other"
    return "unknown-macro" if key.startswith("define-") else None


def is_definition_head(dialect: str, head: str) -> bool:
    """Whether an outline calls the form a definition."""
    if dialect == "common-lisp":
        return operator_key(head) in CATEGORIES["common-lisp"]
    if dialect == "unknown":
        return head.startswith(("def", "cl-def")) or head in ("define", "ns")
    return head in CATEGORIES[dialect]
