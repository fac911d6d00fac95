"""Quality rules: base columns by brute force, the estimate on planted data, defined cases."""

import collections

import numpy as np
import pyarrow as pa

import helpers as H
from pairlab.llm import quality


def brute(text):
    text = text or ""
    words = H.WORD.findall(text)
    lines = [x for x in text.split("\n") if H.WORD.search(x)]
    windows = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    cover = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i:i + 5])] > 1:
            cover.update(range(i, i + 5))
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)]


def test_base_columns_match_brute_force():
    texts = [r[1] for r in H.awkward()] + [r[0] for r in H.rows_of("/root/testdata/sf0.001", "documents", "text")]
    got = quality.measure(pa.array(texts))
    for i, t in enumerate(texts):
        assert [int(got[c][i]) for c in quality.COUNTS] == brute(t), t[:50]


def test_lines_at_row_edges():
    texts = ["a\nb\na", "a\n", "a", "\n\n", "b\r\nb\r\nb"]
    got = quality.measure(pa.array(texts))
    assert [int(x) for x in got["n_dup_lines"]] == [brute(t)[3] for t in texts]


def test_chi_square_values():
    # known table values
    assert abs(quality.chi2_quantile(0.95, 5) - 11.0705) < 1e-3
    assert abs(quality.chi2_cdf(3.841459, 1) - 0.95) < 1e-6


def planted(spark, partitions):
    rng = np.random.RandomState(3)
    rows = []
    for i in range(400):
        n = int(np.exp(rng.normal(4.5, 0.6))) + 12
        text = " ".join("".join(rng.choice(list("abcdefgh"), 1 + rng.poisson(4))) for _ in range(n))
        if i % 10 == 0:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text, "en", "s" if i % 3 else "t", None, "", "", "", "", "", ""))
    return H.documents(spark, rows).repartition(partitions)


def test_rejects_planted_outliers_and_keeps_the_rest(spark):
    got = {r["doc_id"]: r for r in quality.judge(planted(spark, 3)).collect()}
    assert len(got) == 400
    assert all(not got[i]["kept"] for i in range(0, 400, 10))
    assert sum(not got[i]["kept"] for i in range(400) if i % 10) <= 2


def clean(rng, n):
    return ["".join(rng.choice(list("abcdefgh"), 3 + rng.poisson(2))) + str(i) for i in range(n)]


def test_each_statistic_rejects_alone(spark):
    """An outlier in each of the five dimensions among clean documents, none of them failing the base rule."""
    rng = np.random.RandomState(7)
    texts = [" ".join(clean(rng, int(np.exp(rng.normal(4.5, 0.3))) + 12)) for _ in range(300)]
    many = clean(rng, 5000)
    long = [w * 6 for w in clean(rng, 90)]
    symbols = [w + "#" * (i % 5 == 0) for i, w in enumerate(clean(rng, 90))]
    few = clean(rng, 12)
    lines = [few[i] for i in rng.randint(0, 12, 90)]
    passage = clean(rng, 9)
    windows = clean(rng, 40) + passage + clean(rng, 40) + passage + clean(rng, 10)
    texts += [" ".join(many), " ".join(long), " ".join(symbols), "\n".join(lines), " ".join(windows)]
    got = {r["doc_id"]: r for r in quality.judge(H.simple(spark, texts)).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert [got[300 + k]["kept"] for k in range(5)] == [False] * 5
    assert sum(not got[i]["kept"] for i in range(300)) <= 2


def test_small_groups_use_all_of_their_language(spark):
    """A rare source, and a rare language, are judged by the estimate of the large groups."""
    rng = np.random.RandomState(9)
    text = lambda: " ".join(clean(rng, int(np.exp(rng.normal(4.5, 0.3))) + 12))
    bad = lambda: " ".join(w + "#" * (i % 3 == 0) for i, w in enumerate(clean(rng, 90)))
    rows = [("en", "big")] * 300 + [("en", "rare")] * 10 + [("xx", "rare")] * 10
    rows = [(i, bad() if i in (305, 315) else text(), lang, s, None, "", "", "", "", "", "") for i, (lang, s) in enumerate(rows)]
    got = {r["doc_id"]: r for r in quality.judge(H.documents(spark, rows)).collect()}
    assert all(r["distance"] is not None for r in got.values())
    assert not got[305]["kept"] and not got[315]["kept"]
    assert sum(not got[i]["kept"] for i in range(320)) <= 4


def test_partitions_do_not_matter(spark):
    a, b = ({r["doc_id"]: (r["kept"], r["distance"]) for r in quality.judge(planted(spark, n)).collect()} for n in (1, 7))
    assert a == b


def test_copies_are_no_majority(spark):
    docs = planted(spark, 2)
    copies = H.documents(spark, [(1000 + i, H.prose(30), "en", "s", None, "", "", "", "", "", "") for i in range(300)])
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs.unionByName(copies)).collect()}
    assert sum(not got[i] for i in range(400) if i % 10) <= 2


def test_defined_cases(spark):
    got = H.by_id(quality.judge(H.documents(spark)))
    assert {k: len(v) for k, v in got.items()}[4] == 2 and len(got[None]) == 2
    assert not got[1][0]["kept"] and got[1][0]["base_failed"] and got[2][0]["n_words"] == 0
    assert got[5][0]["kept"]
    assert quality.judge(H.documents(spark, [])).count() == 0
    assert quality.keep(H.documents(spark, [])).columns == [f.name for f in H.SCHEMA]
    kept = quality.keep(H.documents(spark)).collect()
    assert sum(r["doc_id"] == 4 for r in kept) == 2 and all(r["doc_id"] not in (1, 2, 3, 12) for r in kept)
