"""Near-dedup: classes against all pairs, similarities against sums by definition, hot buckets, defined cases."""

import collections
import random

import numpy as np
import pyarrow as pa

import helpers as H
from pairlab.llm import flat, near_dedup


def weights(text):
    w = H.WORD.findall(text or "")
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
    return collections.Counter(grams)


def exact(a, b):
    keys = set(a) | set(b)
    prob = sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in keys) for i in set(a) & set(b)) if keys else 0.0
    return prob, len(set(a) & set(b)) / max(len(keys), 1)


def classes(rows):
    """Least id of each row's class by comparing all pairs of different texts."""
    texts = {}
    for i, t in rows:
        texts.setdefault(("n", i) if t is None else ("t", t), []).append(i)
    keys = list(texts)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    w = {k: weights(k[1]) if k[0] == "t" else collections.Counter() for k in keys}
    for x in range(len(keys)):
        for y in range(x):
            a, b = w[keys[x]], w[keys[y]]
            if a and b and len(a & b) * 3 > min(len(a), len(b)) and max(exact(a, b)) >= near_dedup.THRESHOLD:
                root[find(keys[x])] = find(keys[y])
    groups = collections.defaultdict(list)
    for k in keys:
        groups[find(k)] += texts[k]
    return {(k, i): min((x for x in groups[find(k)] if x is not None), default=None) for k in keys for i in texts[k]}


def edited(words, share, rng):
    return " ".join(w if rng.random() > share else w + "x" for w in words)


def corpus(n=260):
    rng = random.Random(11)
    out = []
    for g in range(12):
        base = [rng.choice(H.PROSE) + str(rng.randrange(50)) for _ in range(rng.randrange(30, 200))]
        for _ in range(rng.randrange(1, 22)):
            out.append(edited(base, rng.choice((0, 0.01, 0.02, 0.05, 0.1)), rng))
    while len(out) < n:
        out.append(" ".join(rng.choice(H.PROSE) for _ in range(rng.randrange(0, 60))))
    return out


def test_similarities_by_definition():
    texts = corpus()[:80]
    prob, plain = near_dedup.similarities(pa.array(texts[:-1]), pa.array(texts[1:]))
    for i in range(len(texts) - 1):
        p, j = exact(weights(texts[i]), weights(texts[i + 1]))
        assert abs(prob[i] - p) < 1e-9 and abs(plain[i] - j) < 1e-9


def test_signatures_estimate_the_similarity():
    texts = [" ".join(["a b c d e f g h"] * 3 + [f"w{i}" for i in range(60)]), " ".join(["a b c d e f g h"] * 2 + [f"w{i}" for i in range(8, 66)])]
    _, _, buf, offsets = next(flat.chunks(pa.array(texts)))
    want = exact(*map(weights, texts))[0]
    shares = []
    for shift in range(6):  # other registers by other words of the same pattern
        t = [x.replace("w", f"v{shift}") for x in texts]
        _, _, buf, offsets = next(flat.chunks(pa.array(t)))
        sig, _ = near_dedup.signatures(buf, offsets)
        shares.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(shares) - want) < 0.06


def test_classes_match_all_pairs(spark):
    texts = corpus()
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(H.simple(spark, texts)).collect()}
    want = {i: c for (_, i), c in classes(list(enumerate(texts))).items()}
    assert got == want


def test_links_by_plain_jaccard_alone(spark):
    """Texts with nearly the same shingles but other repeat counts are one class, with or without other texts around."""
    rng = random.Random(5)
    texts = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(104)]
        at = rng.randrange(80)
        texts += [" ".join(base), " ".join(base[:at] + base[at:at + 14] * 50 + base[at + 14:])]
    for a, b in zip(texts[::2], texts[1::2], strict=True):
        prob, plain = exact(weights(a), weights(b))
        assert prob < 0.4 and plain > 0.9
    # both with repeats, in different places
    base = [f"z{i}" for i in range(204)]
    texts += [" ".join(base[:k] + base[k:k + 14] * 40 + base[k + 14:]) for k in (20, 150)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(H.simple(spark, texts)).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}
    texts = corpus()[:120] + texts
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(H.simple(spark, texts)).collect()}
    assert got == {i: c for (_, i), c in classes(list(enumerate(texts))).items()}


def test_one_hot_bucket(spark):
    """A chain of edits: neighbours are near copies, the ends are not, and all share buckets."""
    base = [f"w{i}" for i in range(300)]
    texts = []
    for k in range(120):
        texts.append(" ".join(base[:300 - k] + [f"e{i}" for i in range(k)]))
    got = {r["class_id"] for r in near_dedup.classes(H.simple(spark, texts)).collect()}
    assert got == {0}


def test_defined_cases(spark):
    rows = H.awkward()
    got = near_dedup.classes(H.documents(spark)).collect()
    assert len(got) == len(rows)
    want = classes([(r[0], r[1]) for r in rows])
    have = collections.Counter((r["doc_id"], r["class_id"]) for r in got)
    assert have == collections.Counter((r[0], want[(("n", r[0]) if r[1] is None else ("t", r[1])), r[0]]) for r in rows)
    kept = near_dedup.keep(H.documents(spark))
    assert kept.columns == [f.name for f in H.SCHEMA]
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(4) == 1 and 5 not in ids and ids.count(None) == 2 and len(ids) == len(rows) - 2
    assert near_dedup.classes(H.documents(spark, [])).count() == 0
    assert near_dedup.keep(H.documents(spark, [])).count() == 0
