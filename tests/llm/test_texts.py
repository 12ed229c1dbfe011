import hashlib
import ipaddress
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parenlake.llm import pii
from parenlake.llm.lzprint import edit_table, fingerprint, likeness, printed, read, with_edit
from parenlake.llm.quality import Model, Settings, fit, held_out, quality_table, score, scores
from parenlake.llm.rules import Rule, judge
from tests.llm.corpus import SCHEMA, clashing, empty, odd, odd_rows, words


def slow_phrases(text):
    seen, at = [], 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in seen:
            end += 1
        seen.append(text[at:end])
        at = end
    return {p for p in seen if p}


@pytest.mark.parametrize("size", [0, 1, 5, 63, 64, 65, 130, 700])
def test_phrases_as_by_the_definition(size):
    rng = random.Random(size)
    for letters in ("ab", "abcdefgh é日"):
        for _ in range(10):
            text = "".join(rng.choice(letters) for _ in range(size))
            other = "".join(rng.choice(letters) for _ in range(size // 2))
            a, b, edited = with_edit(text, other)
            assert a.tolist() == fingerprint(text).tolist() and b.tolist() == fingerprint(edited).tolist()
            assert edited == text[: size - size // 4] + other[: size // 4]
            # Few phrases: the signature holds a hash for each.
            if size <= 130:
                assert len(fingerprint(text)) == len(slow_phrases(text))
                p, q = slow_phrases(text), slow_phrases(edited)
                if len(p | q) <= 96:
                    assert likeness(a, b) == pytest.approx(len(p & q) / len(p | q) if p | q else 1.0)
            assert read(printed(a)).tolist() == a.tolist()


def test_edit_table(spark):
    rows = sorted(((-1 if r[0] is None else r[0]), i, r[1] or "") for i, r in enumerate(odd_rows()) if r[0] not in (14, 15))
    df = spark.createDataFrame([(None if d < 0 else d, t, None, None, None) for d, _, t in rows], SCHEMA)
    for per in (1, 3, 1000):
        got = sorted(edit_table(df, rows_per_range=per).collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id)
        assert len(got) == len(rows)
        for k, r in enumerate(got):
            text, following = rows[k][2], rows[(k + 1) % len(rows)][2]
            a, b, edited = with_edit(text, following)
            assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
            assert (r.fingerprint, r.edited_fingerprint) == (printed(a), printed(b))
            assert (r.near_edited, r.near_next) == (likeness(a, b), likeness(a, fingerprint(following)))
    assert edit_table(odd(spark), rows_per_range=2).count() == len(odd_rows())
    assert edit_table(clashing(spark)).count() == len(odd_rows())
    assert edit_table(empty(spark)).count() == 0


def test_surrogates_keep_type_format_and_coreference(spark):
    text = 'Mr. John Smith, +1 (743) 555-3824 or 743-555-3824; J.Smith@mail1.example.com, 4785380592391139, 10.1.2.3. JOHN? token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" DE89 3704 0044 0532 0130 00'
    rows = [(1, text, None, None, None), (2, "again 743-555-3824 and j.smith@mail1.example.com 1234567890123456 v1.2.3", None, None, None), (3, None, None, None, None), (4, "", None, None, None)]
    got = {r.doc_id: r for r in pii.replace(spark.createDataFrame(rows, SCHEMA)).collect()}
    out = got[1].text
    for secret in ("Smith", "3824", "4785380592391139", "10.1.2.3", "24be6443", "3704"):
        assert secret not in out
    phones = re.findall(r"\(?(\d{3})\)?[ -](\d{3})-(\d{4})", out)
    assert phones[0] == phones[1] == re.findall(r"(\d{3})-(\d{3})-(\d{4})", got[2].text)[0]
    mail = re.search(r"\S+@[\w.]+", got[2].text)[0]
    assert mail in out.lower()
    assert "1234567890123456 v1.2.3" in got[2].text
    assert pii.luhn(re.search(r"\b\d{16}\b", out)[0])
    name = re.search(r"Mr\. (\w+) (\w+),", out)
    assert name[1] in pii.GIVEN["male", "Latin"]
    assert got[3].text is None and got[4].text == "" and got[1].kinds == "CARD,EMAIL,IBAN,IP,PERSON,PHONE,SECRET"
    assert pii.replace(empty(spark)).count() == 0
    assert pii.replace(clashing(spark)).columns[:5] == odd(spark).columns


def test_clashing_surrogates_are_drawn_again(spark, monkeypatch):
    # Three-digit forms: several clashes at first.
    forms = [f"{k:03d}" for k in range(0, 900, 11)]
    entities = spark.createDataFrame([("SECRET", f) for f in forms], "kind string, form string")
    attempts = {r.form: r.attempt for r in pii.clash_free(entities, b"k").collect()}
    fakes = [pii.surrogate(b"k", "SECRET", f, attempts.get(f, 0)) for f in forms]
    assert len(set(fakes)) == len(forms) and not set(fakes) & set(forms)
    # The way beyond the bound gives the same texts.
    text = [(k, f'token = "{k:016d}" mail{k}@x.example.com', None, None, None) for k in range(30)]
    df = spark.createDataFrame(text, SCHEMA)
    want = sorted(r.text for r in pii.replace(df).collect())
    monkeypatch.setattr(pii, "SHIPPED", -1)
    assert sorted(r.text for r in pii.replace(df).collect()) == want


def test_family_names_do_not_run_out(spark):
    # More names than three Greek syllables and an ending give.
    letters = "αβγδεζηθικ"
    forms = ["ψ" + "".join(letters[int(c)] for c in f"{k:04d}") for k in range(10_000)]
    entities = spark.createDataFrame([("SURNAME", f) for f in forms], "kind string, form string")
    attempts = {r.form: r.attempt for r in pii.clash_free(entities, b"k").collect()}
    fakes = [pii.surrogate(b"k", "SURNAME", f, attempts.get(f, 0)) for f in forms]
    assert len(set(fakes)) == len(forms) and not set(fakes) & set(forms)
    assert {pii.script_of(f) for f in fakes} == {"Greek"}


def surrogates_of(text):
    return [pii.rendered(b"k", kind, form, text[a:b], {}) for a, b, kind, form in pii.find(text)]


def test_one_number_however_written():
    written = ["+14155550123", "+1 415 555 0123", "(415) 555-0123", "415-555-0123"]
    got = [surrogates_of(f"call {w} now") for w in written]
    assert len({re.sub(r"\D", "", x[0])[-10:] for x in got}) == 1
    assert [re.sub(r"\d", "0", x[0]) for x in got] == [re.sub(r"\d", "0", w) for w in written]
    trunk = [re.sub(r"\D", "", surrogates_of(f"call {w} now")[0]) for w in ("+44 20 7946 0018", "+44 (0)20 7946 0018", "+442079460018")]
    assert trunk[0] == trunk[2] and trunk[1] == "440" + trunk[0][2:]


def test_a_person_keeps_names_across_mentions():
    full, titled, doctor, initial = [surrogates_of(t)[0] for t in ("Anna Bauer came", "Frau Bauer came", "Dr. Bauer came", "Anna J. Bauer came")]
    assert full.split()[1] == titled == doctor == initial.split()[2]
    assert full.split()[0] == initial.split()[0] in pii.GIVEN["female", "Latin"] and initial.split()[1] == "J."
    known = {n: pii.surrogate(b"k", "GIVEN", f"female:{n.lower()}", 0) for n in pii.GIVEN["female", "Greek"]}
    assert len(set(known.values())) == len(known) and all(f"female:{n.lower()}" != fake for n, fake in known.items())


def test_columns_named_like_the_counts(spark):
    df = odd(spark).withColumn("kinds", F.lit("mine")).withColumn("n_entities", F.lit(-1))
    assert pii.replace(df, counts=False).columns == df.columns
    assert {r.kinds for r in pii.replace(df, counts=False).collect()} == {"mine"}
    assert sorted(pii.replace(df).columns) == sorted(df.columns)


def test_scores_are_the_sums_over_pairs():
    rng = np.random.default_rng(1)
    model = Model(np.zeros((1, 1)), 0.3, rng.normal(size=50), rng.normal(size=(50, 4)), Settings())
    index, value, starts = rng.integers(0, 50, 12), rng.random(12), np.array([0, 5, 6])
    got, _ = scores(index, value, starts, model)
    for row, (a, b) in enumerate([(0, 5), (5, 6), (6, 12)]):
        pairs = sum(model.factor[index[i]] @ model.factor[index[j]] * value[i] * value[j] for i in range(a, b) for j in range(i + 1, b))
        assert got[row] == pytest.approx(0.3 + (model.weight[index[a:b]] * value[a:b]).sum() + pairs)


def test_classifier_learns_held_out_rows(spark):
    rng = random.Random(2)
    docs = [(k, words(k, 80) if k % 2 else " ".join(f"{w}###" for w in words(k, 80).split()), "en", "a", 1) for k in range(300)]
    docs += [(1000, None, None, None, None), (1001, "", None, None, None)]
    labels = [(k, k % 2, 0) for k in range(300)] + [(1000, None, None), (None, 1, 0)]
    rng.shuffle(docs)
    df, ls = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality_table(df, ls).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert 60 < len(held) < 140 and np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.95
    flipped = spark.createDataFrame([(k, 1 - q if k in {r.doc_id for r in held} else q, t) for k, q, t in labels], "doc_id long, quality int, toxic int")
    assert sorted((r.doc_id, r.score) for r in quality_table(df, flipped).collect()) == sorted((r.doc_id, r.score) for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_table(df, none).collect()} == {0.5}
    assert quality_table(empty(spark), ls).count() == 0
    model = fit(df, ls, Settings(train_rows=50))
    kept = score(clashing(spark), model, keep=True)
    assert kept.select("_row.*").columns == clashing(spark).columns


def slow_rules(text):
    found = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    windows = Counter(tuple(found[k : k + 5]) for k in range(len(found) - 4))
    cover = {p for k in range(len(found) - 4) if windows[tuple(found[k : k + 5])] > 1 for p in range(k, k + 5)}
    chars = sum(len(w.decode()) for w in found)
    return len(found), chars, sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_rules_as_by_brute_force(spark):
    more = ["a b c d e a b c d e f", "x\nx\n\ny\nx", "# * $ % & | < >", "w " * 5, "q " * 6, "a b c d e f g h i j a b c d e"]
    rows = odd_rows() + [(100 + k, t, None, None, None) for k, t in enumerate(more)]
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = set()
    for d, t, *_ in rows:
        n, chars, symbols, dup, again = slow_rules(t)
        want.add((d, n, chars, symbols, dup, again, n < 10 or 100 * again > 20 * n))
    assert got == want
    assert judge(empty(spark)).count() == 0 and judge(clashing(spark)).count() == len(odd_rows())
    assert {r.kept for r in judge(odd(spark), (Rule("none", "words_per_line", 1e9),)).collect()} == {False}
    with pytest.raises(ValueError):
        judge(odd(spark), (Rule("x", "nothing", 1),))


def test_held_out_is_crc_of_the_id(spark):
    import zlib

    for r in spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1)


def test_networks_hosts_and_private_addresses():
    say = surrogates_of
    # Cards keep the digits of their network.
    for prefix in ("4", "34", "37", "51", "55", "6011", "2221", "3530", "301"):
        for k in range(20):
            body = f"{prefix}{k:02d}0718293645"[:15].ljust(15, "7")
            card = next(body + c for c in "0123456789" if pii.luhn(body + c))
            (new,) = say(f"paid with {card} today")
            assert new.startswith(prefix) and pii.luhn(new) and len(new) == 16
    # Addresses of private networks stay there, others are public.
    private = ["10.0.0.1", "127.0.0.1", "192.168.3.4", "172.20.1.9", "169.254.7.7"]
    for old, new in zip(private, say(" and ".join(private)), strict=True):
        assert new.split(".")[0] == old.split(".")[0] and not ipaddress.ip_address(new).is_global and ipaddress.ip_address(new).is_loopback == ipaddress.ip_address(old).is_loopback
    assert all(ipaddress.ip_address(x).is_global for k in range(1, 200) for x in say(f"at 8.8.{k}.4 now"))
    # Sixteen bytes, however written; times, paths and words are none.
    short, long, upper = say("see 2001:db8::8a2e:1 or 2001:0db8:0000:0000:0000:0000:8a2e:0001, 2001:DB8::8A2E:1")
    assert ipaddress.ip_address(short) == ipaddress.ip_address(long) == ipaddress.ip_address(upper) != ipaddress.ip_address("2001:db8::8a2e:1")
    assert re.fullmatch(r"[0-9a-f]{1,4}:[0-9a-f]{1,3}::[0-9a-f]{1,4}:[0-9a-f]", short) and upper == short.upper() and len(long) == 39
    (link,) = say("fe80::1ff:fe23:4567:890a")
    assert link.startswith("fe80::")
    assert say("at 12:30:45 std::vector a::b ::1 :: x:y 10:20:30:40:50:60:70:80:90 C::") == []


def test_hosts_stay_apart(spark):
    hosts = [f"{a}{b}.com" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    rows = [(k, f"write to info@{h} or to {'xyz'[k % 3]}@{h}", "en", "s", 1) for k, h in enumerate(hosts)]
    texts = {r.doc_id: r.text for r in pii.replace(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    found = {k: re.findall(r"[^\s@]+@(\S+)", t) for k, t in texts.items()}
    assert all(len(h) == 2 and h[0] == h[1] for h in found.values()) and len({h[0] for h in found.values()}) == len(hosts)
    assert len({m for t in texts.values() for m in re.findall(r"\S+@\S+", t)}) == 2 * len(hosts)
