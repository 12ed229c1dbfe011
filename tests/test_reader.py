import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parenlake.functions.dialects import DIALECTS, category, dialect_of, needle
from parenlake.functions.reader import Unreadable, closers, read


def shown(text, dialect="unknown"):
    tree = read(text, dialect)
    return [(n.kind, tree.text(k)) for k, n in enumerate(tree.nodes) if k]


@pytest.mark.parametrize(
    "text, dialect, code, position",
    [
        ("(a (b", "unknown", "unclosed-list", 3), ("(a]", "unknown", "mismatched-close", 2), (")", "unknown", "unexpected-close", 0), ('x "y', "scheme", "unterminated-string", 2),
        ("#<x>", "common-lisp", "unsupported-reader-dispatch", 0), ("[a]", "common-lisp", "unsupported-reader-dispatch", 0), ("a '", "scheme", "missing-reader-form", 2),
        ("#| x #| y |# z", "unknown", "unterminated-block-comment", 0), ("|abc", "unknown", "unterminated-symbol", 0), ("ab\\", "unknown", "dangling-single-escape", 2),
    ],
)
def test_errors(text, dialect, code, position):
    with pytest.raises(Unreadable) as error:
        read(text, dialect)
    assert (error.value.code, error.value.position) == (code, position)


def test_tokens_of_dialects():
    assert shown("#+sbcl (a) b", "common-lisp") == [("atom", "#+sbcl (a)"), ("atom", "b")]
    assert shown("#;(x y) z", "scheme") == [("atom", "z")]
    assert shown('#"re" #_(a) {:b, 1}', "clojure") == [("atom", '#"re"'), ("list", "{:b, 1}"), ("atom", ":b"), ("atom", "1")]
    assert shown("?\\( ?a", "emacs-lisp") == [("atom", "?\\("), ("atom", "?a")]
    assert shown("# c\n'a ;[b]", "janet") == [("atom", "'a"), ("list", ";[b]"), ("atom", "b")]
    assert shown("#\\( |A b|", "common-lisp") == [("atom", "#\\("), ("atom", "|A b|")]


def test_offsets_are_bytes_and_order_is_preorder():
    tree = read("(é (b)) c")
    assert [(n.start, n.end) for n in tree.nodes] == [(0, 10), (0, 8), (1, 3), (4, 7), (5, 6), (9, 10)]
    assert tree.at_path([0, 1, 0]) == 4 and tree.path(4) == [0, 1, 0] and tree.at_offset(5) == 4


def test_depth_and_repair():
    deep = "(" * 20_000
    assert closers(deep) == ")" * 20_000
    assert len(read(deep + ")" * 20_000).nodes) == 20_001
    assert closers("(a [b {c") == "}])"


def test_names():
    assert needle("cl:foo") == needle("FOO") == needle("#:foo") == "FOO"
    assert needle("|Ab|c") == "AbC" and needle(":key") == ":KEY" and needle("straße") == "STRAßE"
    assert category("common-lisp", "CL:DEFUN") == "function" and category("common-lisp", "define-x") == "unknown-macro"
    assert category("unknown", "define-thing") == "other" and category("clojure", "defun") is None
    assert dialect_of("a/b.lisp") == "common-lisp" and dialect_of("a/b.LISP") == "unknown" and dialect_of("Makefile") == "unknown"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab ()[]{}'\"`,@#;|\\\n:é~^_?+", max_size=30), st.sampled_from(DIALECTS))
def test_any_text_reads_or_tells_why(text, dialect):
    try:
        tree = read(text, dialect)
    except Unreadable as error:
        assert 0 <= error.position <= len(text.encode())
        return
    for k, node in enumerate(tree.nodes[1:], 1):
        parent = tree.nodes[node.parent]
        assert parent.start <= node.start < node.end <= parent.end and k in parent.children
