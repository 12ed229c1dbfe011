import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parenlake.llm.common import positions
from parenlake.llm.jaccard import keep_one
from parenlake.llm.mixing import apply_mix, mix, sainte_lague, targets
from parenlake.llm.packing import SegmentTokens, cuts, pack
from parenlake.llm.sharding import assign, jump, shard_table
from tests.llm.corpus import SCHEMA, clashing, empty, odd, odd_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


def slow_jump(key: int, shards: int) -> int:
    at, ahead = -1, 0
    while ahead < shards:
        at = ahead
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        ahead = int((at + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return at


def test_jump_agrees_with_the_loop_and_moves_little():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 3000).astype(np.uint64)
    for shards in (1, 2, 16, 17):
        assert jump(keys, shards).tolist() == [slow_jump(int(k), shards) for k in keys]
    before, after = jump(keys, 16), jump(keys, 17)
    assert set(after[before != after]) == {16}
    assert 0.03 < (before != after).mean() < 0.09
    with pytest.raises(ValueError):
        jump(keys, 0)


def test_shard_table(spark):
    rows = shard_table(odd(spark)).collect()
    assert len(rows) == len(odd_rows())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter((r.doc_id, r.size, r.text_crc32) for r in rows)
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in odd_rows())
    assert sizes == want
    assert shard_table(empty(spark)).count() == 0
    assert shard_table(clashing(spark)).count() == len(rows)
    with pytest.raises(ValueError):
        assign(clashing(spark), "doc_id", 4)


def test_positions_are_gapless_for_a_hot_row(spark):
    df = spark.createDataFrame([("g", 1, 3)] * 500 + [("g", 2, 5), (None, 1, 2), (None, 1, 2)], "g string, k int, w int")
    got = defaultdict(list)
    for r in positions(df, ["g"], ["k"], "w").collect():
        got[r.g].append((r.start, r.w))
    for spans in got.values():
        at = 0
        for start, w in sorted(spans):
            assert start == at
            at += w


def test_packing(spark):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    pieces, docs = defaultdict(list), Counter()
    rows = pack(odd(spark), PATH).collect()
    want = Counter()
    for d, t, *_ in odd_rows():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        want[d, len(ids) // 4] += len(ids) // 4
        docs[d, zlib.crc32(ids)] += 1
    got = Counter()
    for r in rows:
        pieces[r.sequence_id].append((r.offset, r.length))
        got[r.doc_id, r.doc_tokens] += r.length
    assert got == want
    for spans in pieces.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    whole = [r for r in rows if r.start == 0 and r.length == r.doc_tokens]
    assert all(docs[r.doc_id, r.ids_crc32] for r in whole)
    assert pack(empty(spark), PATH).count() == 0
    assert pack(clashing(spark), PATH).count() == len(rows)


def test_cuts_fill_and_waste_little():
    for length, parts in enumerate(cuts(1024, 16)):
        assert sum(parts) == length and all(1 <= p for p in parts)
        assert all(1024 - 1024 // p * p <= 38 for p in parts)


def test_segments_give_the_tokenizers_ids():
    tokens = SegmentTokens(PATH)
    texts = ["a b", "a  b", " lead", "x\ny z", "don't <|endoftext|> it's", "", "日本 é b", "tab\t x", "1 22 333!! ok"]
    want = [np.array(x.ids, "<u4").tobytes() for x in tokens.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert tokens.of(texts) == want
    tokens.ranked = None
    tokens.known.clear()
    assert tokens.of(texts) == want


def slow_apportion(shares: list[float], seats: int) -> list[int]:
    got = [0] * len(shares)
    for _ in range(seats if sum(shares) else 0):
        best = max(range(len(shares)), key=lambda k: (shares[k] / (2 * got[k] + 1), -k))
        got[best] += 1
    return got


def test_sainte_lague_is_highest_quotients(spark):
    rng = np.random.default_rng(3)
    for seats in (0, 1, 7, 50):
        shares = [float(x) for x in rng.integers(0, 30, 9)]
        df = spark.createDataFrame([(0, k, s, seats) for k, s in enumerate(shares)], "g int, k int, s double, n long")
        got = [r.quota for r in sainte_lague(df, ["g"], "s", "n", ["k"]).orderBy("k").collect()]
        assert got == slow_apportion(shares, seats), (shares, seats)


def slow_targets(sizes: list[int], weights=(3, 1, 2), share=1.5, most=2):
    n, goal = len(sizes), share * sum(sizes)
    capped = [False] * n
    while True:
        free = [k for k in range(n) if not capped[k]]
        left = goal - sum(most * sizes[k] for k in range(n) if capped[k])
        level = left / sum(weights[k % 3] for k in free) if free else 0
        over = [k for k in free if level * weights[k % 3] > most * sizes[k]]
        if not over:
            return [most * sizes[k] if capped[k] else level * weights[k % 3] for k in range(n)]
        for k in over:
            capped[k] = True


def test_targets(spark):
    sizes = [500, 20, 0, 90, 1000, 7]
    names = ["A", "a", "b", "é", "😀", None]
    df = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")
    got = {r.source: r.target for r in targets(df, (3, 1, 2), 1.5, 2).collect()}
    assert [got[n] for n in names] == pytest.approx(slow_targets(sizes))


def test_mix(spark):
    rows = mix(odd(spark)).collect()
    assert len(rows) == len(odd_rows())
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((d, len((t or "").encode().split())) for d, t, *_ in odd_rows())
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        by[r.source].append(r)
    for some in by.values():
        assert some[0].source_size == sum(r["size"] for r in some)
        assert abs(sum(r.taken for r in some) - some[0].target) <= 2
    again = mix(odd(spark).repartition(5)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r["size"], r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mix(empty(spark)).count() == 0
    assert mix(clashing(spark)).count() == len(rows)
    mixed = apply_mix(odd(spark))
    assert mixed.columns == odd(spark).columns
    total = sum(len((r.text or "").split()) for r in mixed.collect())
    assert abs(total - sum(r.taken for r in rows)) <= 4


def test_mix_takes_the_blocks_it_chose(spark):
    # Every word once in the whole corpus, with line breaks between words.
    rows = [(k, "".join(f"d{k}-{p}" + ("\n" if p % 7 == 0 else "  ") for p in range(20 + 13 * (k % 40))), "en", f"s{k % 3}", 1) for k in range(120)]
    rows.append((500, "\n " + " ".join(f"long-{p}" for p in range(9000)), "en", "s1", 1))
    rows += [(501, "twice " * 40, "en", "s1", k) for k in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    text, taken = {d: t for d, t, *_ in rows}, Counter()
    for r in mix(docs).collect():
        taken[r.doc_id] += r.taken
    got = apply_mix(docs).collect()
    assert Counter({d: n for d, n in taken.items() if n}) == sum((Counter({r.doc_id: len(r.text.split())}) for r in got), Counter())
    cut = [r for r in got if r.text != text[r.doc_id]]
    assert all(r.text in text[r.doc_id] and r.n_chars == len(r.text) for r in cut)
    assert any(not text[r.doc_id].split()[0] == r.text.split()[0] for r in cut)
    by = Counter(r.source for r in cut)
    assert cut and max(by.values()) <= 4


def test_columns_named_like_the_operators_own_stay(spark):
    df = clashing(spark)
    for name in ("_hash", "_d", "_t", "_number", "_run", "_runs", "_once", "_id", "taken"):
        df = df.withColumn(name, F.lit("mine"))
    for got in (apply_mix(df), keep_one(df)):
        assert got.columns == df.columns
        rows = got.select("_key", "_hash", "_d", "_run", "size", "taken").distinct().collect()
        assert [tuple(r) for r in rows] == [("x", "mine", "mine", "mine", "x", "mine")]
