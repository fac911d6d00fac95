"""Secret scans and PII: base spans against the contract's plain patterns, added spans, trigram queries, defined cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

import helpers as H
from pairlab.llm import pii, secret_scan, url_trees
from pairlab.llm.scratch import Run
from pairlab.llm.html_blocks import main_text

ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    text = text or ""
    out = [(k, m.start(), m.end()) for k, p, ok in (
        ("assign", ASSIGN, lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)) for m in p.finditer(text) if ok(m)]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def personal(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15)]
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text) if ok(m)]


def noise(n, seed=1):
    """Texts dense in near misses of every pattern."""
    rng = random.Random(seed)
    bits = ["token", "secret=", "PASSWORD :", " = ", "api_key", "'", '"', "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "@", "a.b", ".com",
            "+49", " ", "  ", "\n", "(030)", "-", "4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "10.0.0.1", "256", ".1", "é", "ß_x", "%", "x",
            "(at)", "ghp_" + "a1" * 18, "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefghijk", "https://user:pass@host", "Bearer abcdefghij0123456789xyz", "7", "55", "\U0001F600"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    return [r[1] for r in H.awkward()] + noise(300) + [r[0] for r in H.rows_of("/root/testdata/sf0.001", "documents", "text")]


def frame(spark, texts):
    return H.simple(spark, texts)


def test_secret_base_spans(spark, texts):
    got = {r["doc_id"]: r for r in secret_scan.report(secret_scan.scan(frame(spark, texts))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = secrets(t)
        assert got[i]["base_sha256"] == H.sha(H.joined(want)), (t, want, got[i]["spans"])
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[0] == k for s in want) for k in ("assign", "access", "hex")]
        found = [x for x in got[i]["spans"].split(",") if x]
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(found)


def test_secret_added_spans(spark, texts):
    """Every rule gives what its plain expression gives over each whole text, index or no index."""
    got = {r["doc_id"]: r["spans"] for r in secret_scan.report(secret_scan.scan(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want = secrets(t) + [(k, m.start(), m.end()) for k, p in secret_scan.MORE.items() for m in re.finditer(p, t or "", re.A)]
        want.sort(key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))
        assert got[i] == H.joined(want)


def test_trigram_queries_hold_for_every_match(texts):
    assert not secret_scan.QUERIES["hex"] and secret_scan.QUERIES["access"] == [frozenset({"aki", "kia"})]
    for k, p in secret_scan.RULES.items():
        for t in texts:
            for m in re.finditer(p, t or "", re.A):
                low = m[0].lower()
                q = secret_scan.QUERIES[k]
                assert not q or any(all(x in low for x in clause) for clause in q), (k, m[0])


def test_trigram_query_of_other_patterns():
    assert secret_scan.trigram_query("ab") == [] and secret_scan.trigram_query("a.*b") == []
    assert secret_scan.trigram_query("(abc|xyzw)+") == [frozenset({"abc"}), frozenset({"xyz", "yzw"})]
    assert secret_scan.trigram_query("x?abc[0-9]{3}") in ([frozenset({"abc"})], [frozenset({"abc"}), frozenset({"xab", "abc"})])


def test_pii_base_spans(spark, texts):
    got = {r["doc_id"]: r for r in pii.report(pii.detect(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want = sorted(personal(t), key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        assert got[i]["base_sha256"] == H.sha(H.joined(want)), (t, want, got[i]["spans"])
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in got[i]["spans"].split(",") if x)]
        assert set(want) <= set(spans)
        # what is added overlaps no base span and no other addition
        more = [s for s in spans if s not in want]
        for a in more:
            assert not any(a[1] < b[2] and b[1] < a[2] for b in want + [m for m in more if m is not a])


def test_pii_adds_cards_inside_longer_runs(spark):
    texts = [f"{H.prose(12, i)} 4111 1111 1111 1111 and +49 30 {1000000 + i} or mail u{i}@example.org from 10.0.{i % 250}.7 {H.prose(5, i)}" for i in range(120)]
    texts += [f"{H.prose(9, i)} {i}{10 ** 15 + 7 * i} number {300 + i}.{i}.{i}.9999" for i in range(120)]
    texts += ["paid with card 4111 1111 1111 1111 5500 0000 0000 0004 today"]
    got = {r["doc_id"]: r for r in pii.report(pii.detect(frame(spark, texts))).collect()}
    last = got[len(texts) - 1]
    assert last["n_card"] == 0 and last["spans"].count("card:") == 2


def test_luhn_and_octets(spark):
    rows = spark.createDataFrame([("4111111111111111", "1.2.3.255"), ("4111111111111112", "1.2.3.256"), ("", "01.002.0003.0"), ("0", "1.2.3")], "d string, o string")
    got = rows.select(pii.luhn(rows["d"]), pii.octets(rows["o"])).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (False, True), (True, False)]


def test_defined_cases(spark):
    rows = H.awkward()
    for scan, report, width in ((secret_scan.scan, secret_scan.report, 6), (pii.detect, pii.report, 7)):
        got = report(scan(H.documents(spark))).collect()
        assert len(got) == len(rows) and len(got[0]) == width
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
        assert report(scan(H.documents(spark, []))).count() == 0


def test_url_rules_and_parts(spark):
    urls = ["http://A.Example.NET/en/1?x=1#f", "https://example.net/de/", "ftp://x.net", "x.net/no", None, "", "http://example.com/de/9", "http://www.example.com/de",
            "https://a.org/fr/x?u=http://b.net/", "https://a.org/en/", "http://notexample.net/en/", "http://?q#://", "http://a.net?x/en/", "http://net/", "http://h\n.net/a\nb"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, p string")
    got = {r["page_id"]: r for r in url_trees.judge(pages).collect()}
    rules = {"net/": ("block", "net", "/"), "example.net/en/": ("allow", "example.net", "/en/"), "example.com/de/": ("block", "example.com", "/de/"), "org/fr/": ("allow", "org", "/fr/")}
    for i, u in enumerate(urls):
        rest = (u or "").partition("://")[2] if "://" in (u or "") else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [n for n, (_, h, p) in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits, key=len, default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, want), u
        assert got[i]["verdict"] == (rules[want][0] if want else "allow")
    assert url_trees.judge(pages.limit(0)).count() == 0


def test_url_trees_learn_from_labels(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        bad = i % 2
        host = f"{'win-' * rng.randrange(1, 4) if bad else ''}{rng.choice('abcdef')}{rng.randrange(10 ** 6) if bad else ''}.example.io"
        rows.append((i, f"http://{host}/{'x/' * rng.randrange(3)}{rng.randrange(99)}" + ("?a=1&b=2&c=3" if bad else ""), bad))
    labelled = spark.createDataFrame(rows[:400], "page_id long, url string, label int")
    rest = spark.createDataFrame(rows[400:], "page_id long, url string, label int")
    got = url_trees.judge(rest, labelled).collect()
    right = sum((r["verdict"] == "block") == bool(r["page_id"] % 2) for r in got)
    assert right >= 0.95 * len(got)


def test_url_labels_mix_both_labels_in_each_domain():
    from pairlab.llm import url_labels
    domains = lambda urls: {".".join(re.split("[/?#]", u.partition("://")[2])[0].split(".")[-2:]) for u in urls}
    assert domains(url_labels.ALLOW) == domains(url_labels.BLOCK)
    assert not set(url_labels.ALLOW) & set(url_labels.BLOCK) and len(url_labels.ALLOW) == len(url_labels.BLOCK)


def test_url_trees_held_out(spark):
    """The trees of three quarters of the labelled table decide the rest; several lexical features decide."""
    table = url_trees.labelled_urls(spark).withColumn("part", F.pmod(F.xxhash64("url"), F.lit(4))).cache()
    right = n = 0
    for k in range(4):
        model, stats = url_trees.train(table.filter(F.col("part") != k), Run(spark, "urls"))
        held = url_trees.with_suffixes(url_trees.lexical(url_trees.parts(table.filter(F.col("part") == k))), stats)
        rows = url_trees.trees.score(model, held, url_trees.FEATURES).collect()
        n += len(rows)
        right += sum((r["p"] >= 0.5) == (r["label"] == 1) for r in rows)
    print(right, n)
    assert n == table.count() and right >= 0.9 * n, (right, n)
    model, _ = url_trees.train(table, Run(spark, "urls"))
    weight = dict(zip(url_trees.FEATURES, model.featureImportances.toArray()))
    assert sum(w for f, w in weight.items() if f.startswith(("tld", "domain"))) < 0.2, weight
    assert sum(w > 0.02 for w in weight.values()) >= 5, weight


def test_entropy(spark):
    row = spark.createDataFrame([("abab", "", "a-b-")], "x string, y string, z string")
    row = row.select(*[url_trees.entropy(row[c]) for c in ("x", "y", "z")]).first()
    assert [round(x, 6) for x in row] == [1.0, 0.0, 1.5]


def test_main_text():
    page = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header><p>Site name</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
    <div class="cookie-banner"><p>We use cookies on this site to make it work well for every reader.</p></div>
    <article><h1>Head  line</h1><p>One &amp; two<br>three <b>bold</b>ly.</p><div class="ad">Buy now and save a lot of money on all things.</div>
    <p>Only.</p><ul><li>first</li><li>second item</li></ul><form><label>Your name</label><button>Go</button></form>
    <section id="comments"><p>I think this is a very good article and I like it much.</p></section></article>
    <aside><p>Related reading for you</p></aside><footer>&copy; 2020 all rights reserved</footer></body></html>"""
    assert main_text(page) == "Head line\n\nOne & two three boldly.\n\nOnly.\n\nfirst\n\nsecond item"
    assert main_text("") == main_text(None) == main_text("<html></html>") == ""
    assert main_text("<article><p>Cut &lt;off&gt; <b>page") == "Cut <off> page"
    assert main_text("<article><p>Cut off page</p><a hre") == "Cut off page"


def test_very_many_matches(spark):
    """Places stay right, and the cost bearable, with tens of thousands of matches in a text."""
    n = 4_000
    text = ", ".join(f"10.0.{i % 256}.{i % 200}, +49 30 {1000000 + i}" for i in range(n))
    got = pii.report(pii.detect(frame(spark, [text, "x" * 100_000 + "@" + "y." * 50_000 + "z"]))).collect()
    got = {r["doc_id"]: r for r in got}
    want = sorted(personal(text), key=lambda s: (pii.KINDS.index(s[0]), s[1]))
    assert len(want) >= 2 * n and got[0]["base_sha256"] == H.sha(H.joined(want))
    assert got[1]["n_email"] == 1
    text = " ".join(f"{i:032x}" for i in range(n))
    assert secret_scan.report(secret_scan.scan(frame(spark, [text]))).first()["base_sha256"] == H.sha(H.joined(secrets(text)))


def test_pii_trees_and_thresholds_see_every_candidate(spark, monkeypatch):
    """33,000 candidates: all of them are learned from or calibrate, alike ones as one row that weighs as much."""
    seen = {}
    fit, thresholds = pii.trees.fit, pii.thresholds

    def fitted(sample, *a, **k):
        seen["learned"] = sample.agg({"times": "sum"}).first()[0]
        return fit(sample, *a, **k)

    def calibrated(scored):
        seen["calibrated"] = scored.agg({"times": "sum"}).first()[0]
        return thresholds(scored)

    monkeypatch.setattr(pii.trees, "fit", fitted)
    monkeypatch.setattr(pii, "thresholds", calibrated)
    texts = [" ".join(f"call +49 30 {i:06d}{j:02d}" if j % 2 else f"a{i}x{j}@mail.example.org" if j % 4 else f"9.{i % 400}.{j}.{300 + j}" for j in range(11)) for i in range(3_000)]
    docs = frame(spark, texts)
    total = pii.described(pii.find(docs)).count()
    pii.detect(docs)
    assert total >= 33_000 and seen["learned"] + seen["calibrated"] == total and seen["calibrated"] > 0


def test_pii_thresholds_weigh_by_how_often_a_row_stands(spark):
    rows = [(1, 0.905, 1, 98), (1, 0.905, 0, 2), (1, 0.805, 0, 1), (0, 0.5, 1, 1)]
    got = pii.thresholds(spark.createDataFrame(rows, "kind int, p double, label int, times long"))
    assert got == {0: 0.5, 1: 0.9}


def test_trees_fit_without_weights(spark):
    rows = spark.range(200).select(F.col("id").cast("double").alias("a"), (F.col("id") >= 100).cast("int").alias("label"))
    model = url_trees.trees.fit(rows, ["a"], rounds=2, depth=2)
    assert all((r["p"] >= 0.5) == (r["a"] >= 100) for r in url_trees.trees.score(model, rows, ["a"]).collect())
