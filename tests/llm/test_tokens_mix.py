"""Token output, source mix and decontamination: against the tokenizer, plain counts and full alignments."""

import collections
import random
import zlib

import numpy as np
import pytest

import helpers as H
from pairlab.llm import decontaminate, mixing, token_orc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_orc.default_tokenizer())


def encode(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def check_tokens(rows, got, tokenizer):
    at = 0
    got = sorted(got, key=lambda r: r["start"])
    want = collections.defaultdict(collections.Counter)
    for i, t in rows:
        ids = encode(tokenizer, t)
        want[i][len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    have = collections.defaultdict(collections.Counter)
    ids = []
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        have[r["doc_id"]][r["n_tokens"], r["ids_crc32"]] += 1
        ids.append(r["doc_id"])
    assert have == want
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_given_documents(spark, tokenizer):
    rows = H.rows_of(SF, "documents", "doc_id, text")
    got = token_orc.encode_and_read(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    check_tokens(rows, got, tokenizer)


def test_awkward_documents(spark, tokenizer):
    odd = ["<|endoftext|> a<|startoftext|>b", "ΟΔΥΣΣΕΥΣ ΣΑΣ", "é ́x a b c", "don't I'll 's 12345 日本語 テキスト", "İ ẞ", "a\x1cb\x85c"]
    rows = [r[:2] for r in H.awkward()] + [(100 + i, t) for i, t in enumerate(odd)]
    docs = H.documents(spark, H.awkward()).unionByName(H.simple(spark, odd).selectExpr("doc_id + 100 as doc_id", *[f.name for f in H.SCHEMA][1:]))
    check_tokens(rows, token_orc.encode_and_read(docs).collect(), tokenizer)
    assert token_orc.encode_and_read(H.documents(spark, [])).count() == 0


def test_forgetting_the_cache_changes_nothing(tokenizer, monkeypatch):
    import pyarrow as pa

    from pairlab.llm import flat

    monkeypatch.setattr(token_orc, "CACHE", 50)
    coder = token_orc.Encoder(token_orc.default_tokenizer())
    texts = [H.prose(20, 7 * i) for i in range(30)]
    for lo in range(0, 30, 3):
        _, _, buf, offsets = next(flat.chunks(pa.array(texts[lo:lo + 3])))
        ids, at = coder.encode(buf, offsets)
        assert [list(ids[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)] == [encode(tokenizer, t) for t in texts[lo:lo + 3]]


def test_files_hold_bloom_filters_and_prune(spark, tmp_path):
    path = f"{tmp_path}/orc"
    token_orc.write(spark.read.parquet(f"{SF}/documents.parquet"), path)
    files = token_orc.read(spark, path)
    one = files.filter("doc_id = 17")
    assert [r["doc_id"] for r in one.collect()] == [17]
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,17)]" in one._jdf.queryExecution().toString()
    import glob

    from pyarrow import orc

    last = -1
    for f in sorted(glob.glob(f"{path}/*.orc")):
        ids = orc.ORCFile(f).read(columns=["doc_id"])["doc_id"].to_pylist()
        assert ids == sorted(ids) and (not ids or ids[0] > last)
        last = ids[-1] if ids else last


def shares(sizes):
    """Targets by filling up in small steps."""
    weight = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    out, left = [0.0] * len(sizes), float(sum(sizes))
    for _ in range(200):
        free = [i for i in range(len(sizes)) if out[i] < 3 * sizes[i] - 1e-9]
        if not free or left < 1e-9:
            break
        step = min([left, *((3 * sizes[i] - out[i]) * sum(weight[j] for j in free) / weight[i] for i in free)])
        total = sum(weight[j] for j in free)
        for i in free:
            out[i] += step * weight[i] / total
        left -= step
    return out


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 5, 7], [0, 0, 9], [100], [0], [5, 1, 1, 1, 700, 2]])
def test_targets(sizes):
    assert np.allclose(mixing.targets(sizes), shares(sizes))


def check_mix(rows, got):
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(H.WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, mixing.targets([size[s] for s in order]), strict=True))
    want = collections.Counter((i, len(H.WORD.findall(t or "")), size[s], round(target[s], 6)) for i, t, s in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in got) == want
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    return order, size, target


def test_mix_of_given_documents(spark):
    rows = H.rows_of(SF, "documents", "doc_id, text, source")
    got = [mixing.taken(spark.read.parquet(f"{SF}/documents.parquet").repartition(n)).collect() for n in (1, 5)]
    assert sorted(got[0]) == sorted(got[1])
    order, size, target = check_mix(rows, got[0])
    source = {i: s for i, _, s in rows}
    taken = collections.Counter()
    for r in got[0]:
        taken[source[r["doc_id"]]] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 0.01 * target[s] + 2


def test_schedule_has_low_discrepancy(spark):
    import pandas as pd

    plan = pd.DataFrame({"rank": range(4), "slots": [70_000, 20_000, 0, 9_999], "blocks": [30_000, 20_000, 0, 9_999]})
    got = mixing.schedule(spark, plan).orderBy("slot").toPandas()
    assert got.groupby("rank").size().to_dict() == {0: 70_000, 1: 20_000, 3: 9_999}
    # each stretch of the sequence holds its share, and each block comes as often as the others but for one
    for s, share in ((0, 0.7), (1, 0.2), (3, 0.1)):
        for lo in range(0, 99_000, 5_000):
            part = got[(got.slot >= lo) & (got.slot < lo + 5_000)]
            assert abs((part["rank"] == s).sum() - share * len(part)) < 12
    uses = got[got["rank"] == 0].groupby("block").size()
    assert len(uses) == 30_000 and uses.min() == 2 and uses.max() == 3
    first = got[(got["rank"] == 0)].sort_values("slot")
    assert list(first["block"][:5]) == [0, 1, 2, 3, 4] and list(first["pass"].unique()) == [0, 1, 2]


def test_mix_defined_cases(spark):
    rows = H.awkward()
    got = mixing.taken(H.documents(spark)).collect()
    check_mix([(r[0], r[1], r[3]) for r in rows], got)
    assert mixing.taken(H.documents(spark, [])).count() == 0
    out = mixing.mix(H.documents(spark))
    assert out.columns == [f.name for f in H.SCHEMA]
    n = collections.Counter((r["doc_id"], r["text"], r["source"]) for r in out.collect())
    have = collections.Counter((r[0], r[1], r[3]) for r in rows)
    assert set(n) <= set(have) and all(v <= 3 * have[k] for k, v in n.items()) and not any(k[1] in (None, "") for k in n)
    assert mixing.mix(H.documents(spark, [])).count() == 0


def distance(window, text):
    """Least edits between the window and any part of the text, by the full table."""
    row = np.zeros(len(text) + 1, int)
    codes = np.array([ord(c) for c in text])
    ramp = np.arange(len(text) + 1)
    for i, c in enumerate(window):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (codes != ord(c)), row[1:] + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
    return int(row.min())


def norm(text):
    return " ".join((text or "").lower().split())


def contaminated(docs, items):
    out = set()
    for b, item in items:
        item = norm(item)
        n = len(item)
        if n < decontaminate.LEAST:
            continue
        cuts = [0] if n <= decontaminate.WHOLE else [*range(0, n - decontaminate.WINDOW, decontaminate.WINDOW // 2), n - decontaminate.WINDOW]
        windows = [item if n <= decontaminate.WHOLE else item[c:c + decontaminate.WINDOW] for c in cuts]
        budgets = [int(decontaminate.budget(np.array([len(w)]))[0][0]) for w in windows]
        for d, text in docs:
            if any(distance(w, norm(text)) <= e for w, e in zip(windows, budgets, strict=True)):
                out.add((d, b))
    return out


def benchmark_case():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(b, text(n)) for b, n in enumerate((3, 5, 8, 15, 25, 40, 60, 90))] + [(20, None), (21, "short"), (22, "")]

    def damage(s, k):
        for _ in range(k):
            at = rng.randrange(len(s))
            s = rng.choice((s[:at] + s[at + 1:], s[:at] + "z" + s[at:], s[:at] + "y" + s[at + 1:]))
        return s

    docs = []
    for i in range(90):
        b, item = items[i % 8]
        part = item if i % 3 else item[len(item) // 4:]
        docs.append((i, f"{text(rng.randrange(30))} {damage(part, rng.choice((0, 1, 3, 6, 9, 14)))}{rng.choice(('', ' ' + text(20)))}"))
    docs += [(200, items[3][1].upper().replace(" ", " \n ")), (201, None), (202, ""), (203, items[7][1][30:140])]
    return docs, items


def test_decontamination_matches_full_alignment(spark):
    docs, items = benchmark_case()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(frame, bench).collect()
    assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got})
    want = contaminated(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(want) > 30
    kept = {r["doc_id"] for r in decontaminate.keep(frame, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_benchmark_in_blocks(spark, monkeypatch):
    docs, items = benchmark_case()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in decontaminate.matches(frame, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK", 600)
    assert len(decontaminate.blocks(bench)) > 3
    assert {tuple(r) for r in decontaminate.matches(frame, bench).collect()} == whole
    assert decontaminate.keep(frame, bench).count() == len(docs) - len({r[0] for r in whole})


def test_given_benchmark(spark):
    docs, items = H.rows_of(SF, "documents", "doc_id, text"), H.rows_of(SF, "benchmark", "item_id, text")
    got = decontaminate.matches(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    exact = {(d, b) for d, t in docs for b, x in items if norm(x) in norm(t)}
    assert exact <= {(r["doc_id"], r["item_id"]) for r in got}


def test_decontamination_defined_cases(spark):
    bench = spark.createDataFrame([(None, H.prose(12, 3)), (1, H.prose(12, 3)), (1, H.prose(12, 3)), (2, None)], "item_id long, text string")
    got = collections.Counter((r["doc_id"], r["item_id"]) for r in decontaminate.matches(H.documents(spark), bench).collect())
    assert got[4, 1] == 4 and got[4, None] == 2 and got[None, 1] == 2 and not any(d in (1, 2, 3, 8) for d, _ in got)
    kept = decontaminate.keep(H.documents(spark), bench)
    assert kept.columns == [f.name for f in H.SCHEMA] and kept.count() == len(H.awkward()) - len([1 for r in H.awkward() if r[1] and (r[0], 1) in got])
    assert decontaminate.matches(H.documents(spark), bench.limit(0)).count() == 0
    assert decontaminate.keep(H.documents(spark), bench.limit(0)).count() == len(H.awkward())
    assert decontaminate.matches(H.documents(spark, []), bench).count() == 0
