import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from parenlake.llm import pii, quality
from parenlake.llm.common import WordHashes
from parenlake.llm.jaccard import Measure
from parenlake.llm.queries import ORACLES, QUERIES
from tests.llm.corpus import SCHEMA, empty, odd, words
from tests.llm.test_repeats import slow_groups

LABELS = "doc_id long, quality int, toxic int"


def test_stages_and_queries():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES][0] == "reject_low_quality" and len(corpus_pipeline.STAGES) == 5
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert set(ORACLES) <= set(QUERIES)


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The folder of a small corpus, and the rows before and after each stage."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    good = [(1000 + k, words(500 + k, 60 + k) + (". Mr. John Smith, 415-555-01%02d" % k if k % 3 == 0 else ""), "en", f"s{k % 3}", 300) for k in range(40)]
    near = [(1100 + k, good[k][1].replace("w1", "w2", 1), "en", "s0", 300) for k in range(4)]
    bad = [(1200 + k, f"buy $$$ ### {k} !!! " * 30, "en", "s1", 300) for k in range(40)]
    docs = odd(spark).unionByName(spark.createDataFrame(good + near + bad, SCHEMA))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad], LABELS).write.parquet(f"{folder}/labels.parquet")
    at = spark.read.parquet(f"{folder}/documents.parquet")
    found = [at.collect()]
    for _, work in corpus_pipeline.STAGES:
        done = work(spark, at, folder)
        found.append(done.collect())
        if len(found) <= 5:
            assert done.columns == docs.columns
            at = spark.createDataFrame(found[-1], SCHEMA)
    return folder, found


def test_quality_stage_keeps_what_the_pairwise_sum_rates_high(spark, steps):
    folder, found = steps
    model = quality.fit(spark.createDataFrame(found[0], SCHEMA), spark.read.parquet(f"{folder}/labels.parquet"))
    want = Counter()
    for r in found[0]:
        ((some, value, stats),) = quality.features([(r.text or "").encode()], quality.WordBuckets(model.settings.buckets), WordHashes())
        index = np.concatenate([some, quality.binned(np.array([stats]), model.edges, model.settings)[0]])
        x = np.concatenate([value, np.full(len(stats), 0.5)])
        v = model.factor[index] * x[:, None]
        raw = model.bias + model.weight[index] @ x + sum(v[i] @ v[j] for i in range(len(v)) for j in range(i))
        want[tuple(r)] += raw >= 0
    assert Counter(map(tuple, found[1])) == +want
    kept = {r.doc_id for r in found[1]}
    assert kept >= set(range(1000, 1040)) and not kept & set(range(1200, 1240))


def test_join_stage_keeps_one_of_each_group(steps):
    rows = [tuple(r) for r in steps[1][1]]
    groups, _ = slow_groups(rows, Measure(5, 80, 100))
    kept = Counter(r.doc_id for r in steps[1][2])
    want = Counter({low: 1 for (_, n, low), _ in groups.items() if n})
    want.update({d: c for (d, n, _), c in groups.items() if not n})
    want[15] += 1  # two texts have this id, and are alike to none
    assert kept == want and len(rows) > len(steps[1][2])


def test_surrogate_stage_replaces_every_entity(spark, steps):
    entities = pii.entities_of(spark.createDataFrame(steps[1][2], SCHEMA))
    attempts = {(r.kind, r.form): r.attempt for r in pii.clash_free(entities, b"surrogates").collect()}
    want = Counter()
    for r in steps[1][2]:
        text, out, last = r.text or "", [], 0
        for start, end, kind, form in pii.find(text):
            out += [text[last:start], pii.rendered(b"surrogates", kind, form, text[start:end], attempts)]
            last = end
        want[r.doc_id, "".join(out) + text[last:]] += 1
    assert Counter((r.doc_id, r.text or "") for r in steps[1][3]) == want and not any("John Smith" in (r.text or "") for r in steps[1][3])


def test_mix_stage_meets_its_targets(steps):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size, taken, texts = Counter(), Counter(), defaultdict(list)
    for r in steps[1][3]:
        size[r.source] += count(r.text)
        texts[r.doc_id].append(r.text or "")
    per_doc = Counter()
    for r in steps[1][4]:
        taken[r.source] += count(r.text)
        per_doc[r.doc_id] += count(r.text)
        assert any(r.text in t for t in texts[r.doc_id])
    assert all(n <= 2 * sum(map(count, texts[d])) for d, n in per_doc.items())
    # Targets by plain sharing: what a full source can't take goes to the others.
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, rest, open_ = {}, 1.5 * sum(size.values()), set(order)
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * size[s]}
        target |= {s: 2 * size[s] for s in full} if full else {s: level * weight[s] for s in open_}
        rest -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)


def test_packing_stage_holds_every_token_once(steps):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in steps[1][4]:
        want[(r.doc_id, array("I", [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]).tobytes())] += 1
    pieces, ends = defaultdict(list), defaultdict(list)
    for r in steps[1][5]:
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
        ends[r.sequence_id].append((r.offset, r.offset + r.length))
    for (doc, ids), copies in want.items():
        have = Counter(pieces[doc, len(ids) // 4])
        own = [p for p in have if zlib.crc32(ids[4 * p[0] : 4 * (p[0] + p[1])]) == p[2]]
        assert sum(p[1] * have[p] for p in own) >= copies * len(ids) // 4
    assert sum(r.length for r in steps[1][5]) == sum(c * len(ids) // 4 for (_, ids), c in want.items())
    for some in ends.values():
        some.sort()
        assert some[0][0] == 0 and some[-1][1] <= 1024 and all(a[1] == b[0] for a, b in zip(some, some[1:]))


def test_run_is_its_stages(spark, steps, tmp_path):
    folder, found = steps
    per_doc = lambda rows: Counter((r.doc_id, r.doc_tokens, r.start, r.length, r.ids_crc32) for r in rows)
    assert per_doc(corpus_pipeline.run(spark, folder).collect()) == per_doc(found[5])
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
