"""The machine against the pair sum written out, an interaction that a sum of weights can't tell, held-out labels."""

import random
import zlib

import numpy as np
import pyarrow as pa

from pairlab.llm import catalog, flat, toxicity as X
from tests.llm import helpers as H


def terms(texts):
    (lo, hi, buf, offsets), = flat.chunks(pa.array(texts))
    return X.slots(buf, offsets)


def test_slots_are_distinct_terms_of_whole_texts():
    row, slot = terms(["Idiot, idiot! IDIOT", "", "idiot", "idiots", "a b", "Élan x"])
    of = [set(slot[row == i]) for i in range(6)]
    assert of[0] == of[2] and len(of[2]) == 3 and not of[1]  # the word and its first 4 and 5 bytes
    assert len(of[2] & of[3]) == 2 and len(of[4]) == 2 and len(of[5]) == 4
    of_two, of_three = (set(terms([t])[1]) for t in ("idiots idiotic", "idiots idiotic idiot"))
    assert len(of_two - set(terms(["idiots"])[1]) - set(terms(["idiotic"])[1])) == 2 and len(of_three) > len(of_two)
    long = "word " * 50_000 + "last"
    row, slot = terms([long])
    assert set(terms(["last"])[1]) <= set(slot)


def test_logit_is_the_sum_over_pairs():
    rnd = np.random.RandomState(1)
    kept = np.sort(rnd.choice(1 << X.BITS, 50, replace=False)).astype(np.int32)
    m = X.Machine(0.3, kept, rnd.normal(size=50).astype(np.float32), rnd.normal(size=(50, X.FACTORS)).astype(np.float32))
    docs = [rnd.choice(50, n, replace=False) for n in (0, 1, 7, 30)]
    row = np.repeat(np.arange(4), [len(d) for d in docs])
    got = m.logits(m.place(), row, np.concatenate([kept[d] for d in docs]).astype(np.int32), 4)
    for d, z in zip(docs, got):
        expect = 0.3 + m.weight[d].sum() + sum(float(m.factor[i] @ m.factor[j]) for a, i in enumerate(d) for j in d[:a])
        assert abs(z - expect) < 1e-4


def test_learns_pairs_that_no_sum_of_weights_tells():
    rnd, texts, marks = random.Random(2), [], []
    insults, groups = ["fools", "scoundrels"], ["islanders", "northerners"]
    for _ in range(6000):
        two = rnd.sample(insults + groups, rnd.choice([0, 1, 2, 2, 2]))
        words = rnd.choices(["river", "stone", "mill", "field", "frost", "yard", "story", "flood"], k=5) + two
        rnd.shuffle(words)
        texts.append(" ".join(words))
        marks.append(int(bool(set(two) & set(insults)) and bool(set(two) & set(groups))))  # two insults, two groups: clean
    row, slot = terms(texts)
    marks = np.array(marks)
    size = np.bincount(row, minlength=len(texts))
    cut = np.concatenate([[0], np.cumsum(size)])
    m = X.fit([(marks[a:b], size[a:b], slot[cut[a]:cut[b]]) for a, b in ((0, 3000), (3000, 5000))])
    z = m.logits(m.place(), row, slot, len(texts))[5000:]
    assert ((z > 0) == marks[5000:]).mean() > 0.99
    alone = X.Machine(m.bias, m.kept, m.weight, np.zeros_like(m.factor))
    z = alone.logits(m.place(), row, slot, len(texts))[5000:]
    assert ((z > 0) == marks[5000:]).mean() < 0.9  # the factors carry it


def test_wanted_slots_change_no_score():
    (lo, hi, buf, offsets), = flat.chunks(pa.array(["idiots idiotic idiot", "no such", "", "idiocy"]))
    row, slot = X.slots(buf, offsets)
    kept = np.unique(slot)[::3]
    wanted = np.isin(np.arange(1 << X.BITS), kept)
    use = wanted[slot]
    got = X.slots(buf, offsets, wanted)
    assert (got[0] == row[use]).all() and (got[1] == slot[use]).all()


def test_held_out_labels_of_the_given_tables(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in catalog.QUERIES["op13_factorization_toxicity"](spark, sf).collect()}
    marks = dict(H.rows_of(sf, "labels", "doc_id, toxic"))
    assert len(got) == len(H.rows_of(sf, "documents", "doc_id"))
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1
    held = [(m, got[i]) for i, m in marks.items() if i in got and got[i]["held_out"] and m is not None]
    caught = [r["predicted"] for m, r in held if m]
    wrong = [r["predicted"] for m, r in held if not m]
    assert sum(caught) / len(caught) > 0.9 and sum(wrong) / len(wrong) < 0.01


def test_awkward_rows_and_no_labels(spark):
    docs = H.documents(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = X.score(docs, none).collect()
    assert len(rows) == docs.count() and {r["score"] for r in rows} == {0.25}
    some = spark.createDataFrame([(i, i % 2, "x") for i in range(20)] + [(None, 1, "y"), (3, None, "z"), (4, 0, "w")], "doc_id long, toxic int, text string")
    rows = X.score(docs, some).collect()
    assert len(rows) == docs.count() and all(0 < r["score"] < 1 for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False, False]
    assert X.score(docs.filter("doc_id > 1000"), some).collect() == []


def test_reruns_agree(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    a = {r["doc_id"]: r["score"] for r in X.score(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in X.score(docs.repartition(5), labels.repartition(3)).collect()}
    assert a == b
