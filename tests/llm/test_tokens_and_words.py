import hashlib
import os
import random
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from parenlake.llm import alignment, spelling, token_files
from parenlake.llm.automaton import Automaton
from parenlake.llm.elias_fano import EliasFano
from parenlake.llm.tokens import LibraryTokens, cut_places
from tests.llm.corpus import SCHEMA, clashing, empty, odd, odd_rows

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

ODD_TEXTS = [
    "Hello, world's end. It's 'twas 12345 x_y-z",
    "two  spaces and\ttab\n\nlines ",
    " leading",
    "<|endoftext|> and <s> </s> <unk> <0x41>",
    "a▁b keeps its mark",
    "ﬁne ① ½ café café naïve ŒUVRE",
    "日本語 テキスト 😀👍🏽 e​f  x y",
    "tail \x1c\x1d\x85 control \x00 nul",
    "(x) [y] {z} #1 $2 %3 &c; don't we'll they've I'd I'm you're",
    "'s 's' x's1 3's é's",
    "x",
    " ",
    "",
]


def random_texts(seed, n):
    rng = random.Random(seed)
    letters = "abcdeé ßzZ0'9.,-_$ \n\t日😀ñ▁’ "
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)]


# --- Elias-Fano lists and token files ---------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_elias_fano(seed):
    rng = np.random.default_rng(seed)
    for n, most in [(0, 0), (1, 0), (1, 2**64 - 1), (5, 3), (300, 10), (3000, 2**40), (1000, 2**63), (70_000, 900)]:
        values = np.sort(rng.integers(0, most, n, np.uint64, endpoint=True))
        if n > 100 and seed % 2:
            values[n // 2 :] = values[-1]  # one long run, one long gap
        packed = EliasFano.pack(values)
        read = EliasFano(packed)
        assert len(read) == n and read.values().tolist() == values.tolist()
        for k in {*rng.integers(0, n, 60).tolist(), 0, n - 1} if n else ():
            assert read[k] == values[k]
        if n >= 1000:
            bits = n * (2 + max(0.0, np.log2(max(1, int(values[-1])) / n)) + 32 / 256)
            assert 8 * len(packed) <= bits * 1.02 + 1000
    with pytest.raises(IndexError):
        read[n]


def test_library_tokens_are_the_librarys():
    ours = LibraryTokens(A)
    texts = ODD_TEXTS + random_texts(1, 3000) + [r[1] or "" for r in odd_rows()]
    due = ours.tokenizer.encode_batch(texts, add_special_tokens=False)
    for _ in range(2):
        assert ours.of(texts) == [array("I", x.ids).tobytes() for x in due]
    ours.known.limit = 10  # forgetting changes nothing
    assert b"".join(x for k in range(0, len(texts), 50) for x in ours.of(texts[k : k + 50])) == b"".join(array("I", x.ids).tobytes() for x in due)


def brute_ids(text):
    if not hasattr(brute_ids, "tokenizer"):
        from tokenizers import Tokenizer

        brute_ids.tokenizer = Tokenizer.from_file(A)
        brute_ids.tokenizer.encode_special_tokens = True
    return [*brute_ids.tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("file_bytes", [1, 900, 1 << 20])
def test_token_files(spark, tmp_path, file_bytes):
    folder = f"file://{tmp_path}/tokens"
    df = odd(spark).repartition(3)
    files = token_files.write_tokens(df, A, folder, file_bytes=file_bytes, partitions=3)
    got = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    assert len(got) == len(odd_rows())
    # Documents ascend, nulls first; starts follow each other without gaps.
    assert [r.doc_id for r in got] == sorted((r[0] for r in odd_rows()), key=lambda x: -1 if x is None else x)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    due = Counter((r[0], len(ids := brute_ids(r[1])), zlib.crc32(array("I", ids).tobytes())) for r in odd_rows())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == due
    # Any document can be read alone, by its place.
    texts = {}
    for r in odd_rows():
        texts.setdefault(r[0], []).append(brute_ids(r[1]))
    for m in files.collect():
        opened = token_files.TokenFile(pa.memory_map(f"{tmp_path}/tokens/{m.file}"))
        assert (len(opened), opened.tokens, opened.width) == (m.documents, m.tokens, 2)
        for k in range(len(opened)):
            assert opened.document(k).tolist() in texts[opened.name(k)]
        assert opened.all_names() == [opened.name(k) for k in range(len(opened))]
    # Writing again gives the same files.
    before = {f: (tmp_path / "tokens" / f).read_bytes() for f in os.listdir(tmp_path / "tokens") if f.startswith("tokens-")}
    token_files.write_tokens(df, A, folder, file_bytes=file_bytes, partitions=3)
    assert before == {f: (tmp_path / "tokens" / f).read_bytes() for f in os.listdir(tmp_path / "tokens") if f.startswith("tokens-")}


def test_one_id_many_times_is_dealt_out(spark, tmp_path):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text").alias("text")).repartition(4)
    files = token_files.write_tokens(df, A, f"file://{tmp_path}/t", partitions=8).collect()
    assert sum(m.documents for m in files) == 4000 and max(m.documents for m in files) < 1500
    assert token_files.read_tokens(spark, f"file://{tmp_path}/t").filter("doc_id is null").count() == 4000


def test_token_table_of_odd_tables(spark):
    assert token_files.token_table(empty(spark), A).collect() == []
    rows = [tuple(r)[:4] for r in token_files.token_table(clashing(spark), A).orderBy("start").collect()]
    assert rows == [tuple(r)[:4] for r in token_files.token_table(odd(spark), A).orderBy("start").collect()]
    wide = token_files.token_table(odd(spark), A, end_id=70_000)
    assert wide.agg(F.sum("n_tokens")).first()[0] == sum(r[2] for r in rows)
    with pytest.raises(ValueError, match="token file"):
        token_files.TokenFile(b"x" * 200)


# --- alignment ---------------------------------------------------------------


def brute_alignment(rows):
    """By byte offsets, without a transducer, words or pair numbers."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    of_a, of_b = alignment.bytes_of_a(A), alignment.bytes_of_b(B)
    found = []
    for doc, text in rows:
        a = a_model.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_model.encode(text or "")
        spelled = b" " + (text or "").encode()
        if not text or b"".join(of_a[k] for k in a) != spelled or b"".join(of_b[k] for k in b) != spelled:
            found.append((doc, [], [], [], []))
            continue
        ends_a = np.cumsum([len(of_a[k]) for k in a]).tolist()
        ends_b = np.cumsum([len(of_b[k]) for k in b]).tolist()
        groups, links, last = [], [], 0
        for end in sorted(set(ends_a) & set(ends_b)):
            groups.append(([k for k, e in zip(a, ends_a) if last < e <= end], [k for k, e in zip(b, ends_b) if last < e <= end]))
            last = end
        for x, e in zip(a, ends_a):
            links += [(x, y) for y, f in zip(b, ends_b) if e == f]
        found.append((doc, a, b, groups, links))
    counts = Counter(x for f in found for x in f[4])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for doc, a, b, groups, links in found:
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        digest = hashlib.sha256(said.encode()).hexdigest() if said else ""
        out.append((doc, len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return out, counts


def test_alignment_by_brute_force(spark):
    texts = ODD_TEXTS + random_texts(2, 400)
    rows = [(k, t) for k, t in enumerate(texts)] + [(k, (t or "")[:3000] if t else t) for k, t, *_ in odd_rows()]
    df = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], SCHEMA).repartition(3)
    due, counts = brute_alignment(rows)
    got = [tuple(r) for r in alignment.alignment_table(df, A, B).collect()]
    assert Counter(got) == Counter(due)
    assert any(r[1] for r in due) and any(not r[1] and t for r, (_, t) in zip(due, rows))
    mapped = alignment.id_map(alignment.align(df, A, B), A, B).collect()
    assert {(r.a, r.b): r.n for r in mapped} == counts
    assert {(r.b, r.n) for r in mapped if r.best} == {(b, max(n for (_, y), n in counts.items() if y == b)) for _, b in counts}


def test_alignment_remembers_within_bounds():
    texts = random_texts(3, 300)
    work = alignment.Aligner(A, B)
    due = work.of(texts)
    assert [work.whole(t) if t else work.NOTHING for t in texts] == due
    work.known.limit, work.transducer.LIMIT, work.tokens.known.limit = 5, 5, 5
    assert [x for k in range(0, len(texts), 7) for x in work.of(texts[k : k + 7])] == due


def test_transducer_by_hand():
    t = alignment.Transducer([b"ab", b"c", b"abc", b"x"], [b"a", b"bc", b"abc", b"bcx"])
    assert t.groups([0, 1], [0, 1]) == [(2, 2)]
    assert t.groups([2, 3, 0, 1], [0, 3, 2]) == [(2, 2), (4, 3)]
    assert t.groups([0], [2]) is None and t.groups([3], [0]) is None and t.groups([], []) == [] and t.groups([], [0]) is None


def test_pairs_are_bounded_by_the_vocabularies():
    pairs = alignment.possible_pairs(A, B)
    assert len(pairs) <= sum(map(len, alignment.bytes_of_a(A))) + sum(map(len, alignment.bytes_of_b(B)))


def test_alignment_of_odd_tables(spark):
    assert alignment.alignment_table(empty(spark), A, B).collect() == []
    assert Counter(map(tuple, alignment.alignment_table(clashing(spark), A, B).collect())) == Counter(map(tuple, alignment.alignment_table(odd(spark), A, B).collect()))


# --- spelling variants -------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_automaton(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))) for _ in range(200)})
    made = Automaton(words)
    assert len(made) == len(words) and [made.number(w) for w in words] == list(range(len(words)))
    assert made.number("zz") is None and Automaton([]).number("a") is None
    # Minimal: no two states accept the same endings.
    assert len({(f, tuple(sorted((c, to) for c, (to, _) in e.items()))) for f, e in zip(made.final, made.edges)}) == len(made.edges)
    for word in words:
        for exact in range(len(word) + 1):
            due = {k for k, w in enumerate(words) if one_shorter_or_replaced(word, w, exact)}
            assert made.shorter_or_equal(word, exact) - {words.index(word)} == due - {words.index(word)}


def one_shorter_or_replaced(word, other, exact):
    return any(other == word[:i] + word[i + 1 :] or (len(other) == len(word) and other[:i] == word[:i] and other[i + 1 :] == word[i + 1 :] and other != word) for i in range(exact, len(word)))


def is_near(u, v):
    if len(u) < len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(x != y for x, y in zip(u, v)) == 1
    return len(u) == len(v) + 1 and any(u[:i] + u[i + 1 :] == v for i in range(len(u)))


def brute_variants(rows, ratio=10):
    import re

    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    words = {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def spelled_rows(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéÿ") for _ in range(rng.randrange(7, 13))) for _ in range(25)] + ["aaaaaaaa", "aaaaaaaaa", "ababababab"]
    rows = []
    for k in range(160):
        text = []
        for _ in range(40):
            w = base[min(rng.randrange(len(base)), rng.randrange(len(base)), rng.randrange(len(base)))]
            for _ in range(rng.choice((0, 0, 0, 0, 1, 2))):
                i = rng.randrange(len(w))
                w = rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice("abc") + w[i:], w[:i] + "d" + w[i + 1 :]))
            text.append(rng.choice((w, w.upper() if w.isascii() else w)))
        rows.append((None if k == 3 else k % 150, rng.choice((" ", ", ", "-", "1", "\n")).join(text)))
    chain = [(201, "chainsaws " * 400), (202, "chainsaw " * 30), (203, "chainsa " * 2)]
    return [*rows, *chain, (7, None), (8, ""), (9, "É" * 9)]


@pytest.mark.parametrize(("seed", "most", "chunk"), [(1, 20_000, 20_000), (2, 20_000, 3), (3, 60, 5), (4, 12, 1)])
def test_variants_by_brute_force(spark, seed, most, chunk):
    rows = spelled_rows(seed)
    df = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], SCHEMA).repartition(3)
    due = brute_variants(rows)
    words = spelling.stage(spelling.corpus_words(df, held=50), "words")
    near = spelling.near_words(words, most=most, chunk=chunk)
    assert near.count() == near.distinct().count()
    got = {tuple(r) for r in spelling.with_roots(spelling.stage(spelling.forms(words, near), "forms")).collect()}
    assert got == due
    assert any(r[1] for r in due) and any(r[1] and r[2] != r[1] for r in due)


def test_long_chain_of_forms(spark):
    chain = [("a" * (7 + k), 2 * 10**k) for k in range(10)]
    words = spelling.stage(spark.createDataFrame(chain, "word string, n long"), "words")
    got = spelling.with_roots(spelling.stage(spelling.forms(words, spelling.near_words(words)), "forms")).collect()
    assert {r.root for r in got} == {"a" * 16} and sum(r.form is None for r in got) == 1


def test_variants_of_odd_tables(spark):
    assert spelling.variant_table(empty(spark)).collect() == []
    assert spelling.variant_table(odd(spark)).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert Counter(map(tuple, spelling.variant_table(clashing(spark)).collect())) == Counter(map(tuple, spelling.variant_table(odd(spark)).collect()))


def test_letters_and_punctuation_are_the_librarys_without_its_search(monkeypatch):
    rng = np.random.default_rng(8)
    letters, marks = list("abcdefghijklmnopqrstuvwxyzABCXYZ\u00c0\u00df\u00e9\u00f1\u00ff"), list("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
    drawn = ["".join(rng.choice(letters, rng.integers(1, 15))) + "".join(rng.choice(marks, rng.integers(0, 4))) for _ in range(3000)]
    drawn += ["a'", "it's", "d\u00d7d", "\u00f7", "x1.", "a.b", "\u0101b", "<|endoftext|>", "\u00b5", "\u00aa", "a\nb."]
    ours = LibraryTokens(A)
    want = ours.library([" " + w for w in drawn])
    assert list(ours.word_ids(drawn)) == want
    ours.known.of([drawn])
    assert ours.word_ids([w + "!" for w in drawn]) == ours.library([" " + w + "!" for w in drawn])
    searched = []
    monkeypatch.setattr(ours, "library", lambda texts: searched.extend(texts) or LibraryTokens.library(ours, texts))
    assert list(ours.word_ids(drawn[:3000])) == want[:3000]
    assert all(set(x) <= set(marks) for x in searched)


def test_stretches_are_cut_where_the_library_always_splits():
    rng = random.Random(11)
    white = "".join(chr(c) for c in range(0x3001) if chr(c).isspace()) + "\u180e\u200b\ufeff\x00"
    parts = ["a", "Bc", "\u00e9", "\u00d7", "\u00f7", "\u00b5", "\u0301", "\u0440", "\u65e5", "\U0001f600", "'s", "'re", "'", "1", "\u00b2", ".", "$$", "<|endoftext|>", "\n", " ", " ", "  ", "\n\n", "\t"]
    texts = ["".join(rng.choice(parts if rng.random() < 0.85 else white) for _ in range(rng.randrange(25))) for _ in range(20_000)]
    ours = LibraryTokens(A)
    due = [array("I", x.ids).tobytes() for x in ours.tokenizer.encode_batch(texts, add_special_tokens=False)]
    column = pa.array(["dropped", *texts, None])
    for kind in (pa.string(), pa.large_string()):
        assert ours.of(column.cast(kind).slice(1)) == [*due, b""]
    # Alone too, where nothing stands around a text.
    assert [ours.of([t])[0] for t in texts[:2000]] == due[:2000]
    assert ours.of([]) == [] and ours.of(["", None]) == [b"", b""]
    # Every cut is one that the library makes.
    for text in texts[:5000]:
        if text:
            splits = {len(text[:a].encode()) for _, (a, _) in ours.tokenizer.pre_tokenizer.pre_tokenize_str(text)}
            assert set(np.flatnonzero(cut_places(np.frombuffer(text.encode(), np.uint8), np.zeros(1, np.int64))).tolist()) <= splits


def test_punctuation_and_touching_white_space_make_no_new_stretches(monkeypatch):
    ours, asked = LibraryTokens(A), []
    monkeypatch.setattr(ours, "library", lambda texts: asked.extend(texts) or LibraryTokens.library(ours, texts))
    texts = ["one two. two, two$$$ two!\ntwo.\n\n two  two", "two two.\ntwo"] * 50
    due = [array("I", x.ids).tobytes() for x in ours.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert ours.of(texts) == due
    assert {x for x in ours.known.new if "t" in x} == {"two", " two"}
    # The library is asked for what is not of letters, once each; never for a text.
    assert len(asked) == len(set(asked)) and not any(len(x) > 6 for x in asked)


def test_long_stretches_are_not_remembered():
    ours = LibraryTokens(A)
    texts = ["x " + "\u65e5\u672c" * 500 + " y", "a" * 5000 + ". b", "z" * 100]
    assert ours.of(texts) == LibraryTokens(A).library(texts)
    assert max(len(x.encode()) for x in ours.known.new) == ours.LONGEST == 100
