"""Runs against a plain search over all stretches, the periodic tails, the digests."""

import random
import zlib
from fractions import Fraction

from pyspark.sql import functions as F

from pairlab.llm import catalog, word_runs
from tests.llm import helpers as H


def plain_runs(words):
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                if not any(s <= i and e >= j + q and q % p == 0 for s, e, p in out if p < q):
                    out.add((i, j + q, q))
            i = j + 1
    return sorted((s, e - s, q) for s, e, q in out)


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    rnd, out = random.Random(5), []
    for _ in range(250):
        words = [rnd.choice("abc" if rnd.random() < .5 else "ab") for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randint(0, len(words))
            piece = [rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))]
            words[at:at] = piece * rnd.randint(2, 12) + piece[:rnd.randint(0, len(piece))]
        out.append(" ".join(words))
    period = [f"w{i}" for i in range(700)]
    return out + ["x " * 5000, " ".join(period * 9), " ".join((["a", "b"] * 8 + ["c"]) * 40), "a\tb\na b  a b a b", "", "one"]


def test_runs_equal_plain_search(spark):
    rows = texts()
    got = H.by_id(word_runs.find(H.simple(spark, rows)))
    for i, text in enumerate(rows):
        words = H.WORD.findall(text)
        r = got[i][0]
        runs = [tuple(x) for x in r["runs"]]
        if len(words) <= 1500:
            assert runs == plain_runs(words), text[:200]
        assert r["n_words"] == len(words)
        assert r["collapsed"] == plain_collapsed(words, runs)
    at = len(rows) - 6
    assert [tuple(x) for x in got[at][0]["runs"]] == [(0, 5000, 1)]
    assert [tuple(x) for x in got[at + 1][0]["runs"]] == [(0, 6300, 700)]


def test_tails_and_digest_of_awkward_rows(spark):
    docs = H.documents(spark)
    got = word_runs.digest(word_runs.find(word_runs.with_tail(docs))).collect()
    assert len(got) == docs.count()
    expect = []
    for r in docs.collect():
        words = H.WORD.findall(r["text"] or "")
        n = len(words)
        h = 1 if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words) if n <= 1000 else None
        expect.append((r["doc_id"], n, words, runs))
    expect = sorted((x for x in expect if x[3] is not None), key=str)
    seen = sorted(got, key=lambda r: str((r["doc_id"], r["n_words"])))
    by = {}
    for r in seen:
        by.setdefault((r["doc_id"], r["n_words"]), []).append(r)
    for doc, n, words, runs in expect:
        r = by[doc, n][0]
        assert r["n_runs"] == len(runs)
        assert r["runs_sha256"] == H.sha("".join(f"{a},{b},{c}\n" for a, b, c in runs))
        assert r["collapsed_sha256"] == H.sha(plain_collapsed(words, runs))
        if runs:
            a, b, c = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]))
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (a, b, c, 1000 * b // c)
        else:
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (None,) * 4


def test_tail_is_made_for_a_tenth(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    docs = spark.createDataFrame([(i, " ".join(f"u{j}" for j in range(50))) for i in range(400)], "doc_id long, text string")
    changed = word_runs.with_tail(docs).alias("a").join(docs.alias("b"), "doc_id").filter("a.text <> b.text")
    got = {r[0] for r in changed.select("doc_id").collect()}
    assert got <= set(ids) and len(got) > len(ids) / 2


def test_query_keeps_every_document(spark):
    sf = "/root/testdata/sf0.001"
    out = catalog.QUERIES["op11_repair_runs"](spark, sf)
    rows = out.collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert any(r["n_runs"] for r in rows)
    tables = H.rows_of(sf, "documents", "doc_id, text")
    got = {r["doc_id"]: r for r in rows}
    for doc, text in tables[:40]:
        words = H.WORD.findall(text or "")
        h = zlib.crc32(str(doc).encode())
        if h % 10 == 0 and words:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if len(words) <= 1200:
            runs = plain_runs(words)
            assert got[doc]["n_runs"] == len(runs)
            assert got[doc]["runs_sha256"] == H.sha("".join(f"{a},{b},{c}\n" for a, b, c in runs))


def test_empty_table(spark):
    assert word_runs.digest(word_runs.find(word_runs.with_tail(H.documents(spark, []).filter(F.lit(False))))).collect() == []
