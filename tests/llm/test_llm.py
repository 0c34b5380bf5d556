"""The training-data operators: brute force, round trips, held-out accuracy, and odd rows."""

from __future__ import annotations

import collections
import functools
import hashlib
import io
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import entry, html_extract, jpeg, license_scan, line_dedup, media, mixing, ngram_join, packing, quality_crf, topk, url_filter
from millrace.llm.graph import components

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
ODD = [(None, None, "x"), (1, None, "x"), (2, "", "x"), (3, "  \n\n ", "x"), (4, "one two", None), (4, "one two", None), (5, "word " * 30_000, "x"), (6, "one two", "y")]


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty and very long texts, repeated rows, clashing extra columns."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, score string")
    return df.withColumns({"n_words": F.lit(7), "rate": F.lit(1), "class_id": F.lit(2), "feature": F.lit("f"), "n_kept": F.lit(3)})


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(sf_dir):
    return duckdb.execute(f"select doc_id, text from '{sf_dir}/documents.parquet' order by doc_id").fetchall()


class Union:
    def __init__(self, n):
        self.p = list(range(n))

    def find(self, x):
        while self.p[x] != x:
            self.p[x] = self.p[self.p[x]]
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.p[b] = a


def similar_pairs(sets, threshold=0.8):
    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    shared = collections.Counter()
    for ids in where.values():
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                shared[a, b] += 1
    return [(a, b) for (a, b), c in shared.items() if c >= threshold * (len(sets[a]) + len(sets[b]) - c)]


# -- 1 ---------------------------------------------------------------------------------------------------------------


def test_quality_held_out(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    found = entry.op1_quality_crf(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(found) > 50 and sum(r.predicted == r.quality for r in found) / len(found) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)


def test_marginals_by_enumeration():
    rng = np.random.default_rng(3)
    node, edge = rng.normal(size=7), rng.normal(size=(2, 2))
    good, pairs, log_z = quality_crf.marginals(node, edge, np.array([4, 1, 2]))
    at, total = 0, 0.0
    for n in (4, 1, 2):
        own, weights = node[at : at + n], []
        paths = [[(m >> i) & 1 for i in range(n)] for m in range(2**n)]
        for y in paths:
            weights.append(np.exp(sum(own[i] for i in range(n) if y[i]) + sum(edge[y[i], y[i + 1]] for i in range(n - 1))))
        for i in range(n):
            assert good[at + i] == pytest.approx(sum(w for w, y in zip(weights, paths) if y[i]) / sum(weights))
        total += np.log(sum(weights))
        at += n
    assert log_z == pytest.approx(total) and pairs.sum() == pytest.approx(4)


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (1, None)], "doc_id long, quality int")
    found = quality_crf.classify(odd, labels).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in found if r.doc_id in (1, 2)} == {0.0}
    assert quality_crf.classify(none, labels).count() == 0 and quality_crf.classify(odd, labels.limit(0)).count() == len(ODD)


# -- 2 ---------------------------------------------------------------------------------------------------------------


def test_urls_by_brute_force(spark):
    hosts = ["a.net", "net", "x.a.net", "b.org", "xa.net", "", "ORG", "a.net.", "é.net"]
    paths = ["", "/", "/en", "/en/x", "/en/x/y", "/e?q", "#t", "/ü/"]
    urls = [(i, f"http://{h}{p}") for i, (h, p) in enumerate((h, p) for h in hosts for p in paths)] + [(900, None), (901, "nothing"), (902, ""), (3, "http://a.net/en/x")] + [(1000 + i, "http://a.net/en/x/hot") for i in range(300)]
    rules = [("net", "/", "block"), ("a.net", "/en/", "allow"), ("a.net", "/en/x", "block"), ("x.a.net", "", "block"), ("org", "/", "allow"), ("org", "/", "block"), ("a.net", "/ü", "block"), ("", "/", "block")]
    found = url_filter.apply_rules(spark.createDataFrame(urls, "page_id long, url string").withColumn("rule", F.lit(1)), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(found) == len(urls)
    for r in found:
        fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if h and (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        want = max(fits)[3:] if fits else (None, "allow")
        assert (r.rule, r.verdict) == want, r
    empty = url_filter.apply_rules(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "host string, path string, verdict string"))
    assert empty.count() == 0


# -- 3 ---------------------------------------------------------------------------------------------------------------


def test_html_of_a_page():
    long = "A sentence of the article, with words and marks; it goes on and on. " * 4
    page = f"""<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var x="</p>";</script></head><body class="has-sidebar">
    <nav><a href="/">Home</a></nav><header>Site</header><div class="cookie-notice">We use cookies.</div>
    <article><h1>Head &amp; line</h1><p>{long}<b>bold</b><br>next&nbsp;line<p>{long}</p><ul><li>one<li>two &lt;3</ul><aside>See also</aside>
    <div class="comments"><p>{long} I say!</p></div><!-- <p>no</p> --></article><form>Search</form><footer>&copy; me</footer></body></html>"""
    text = " ".join(long.split())
    assert html_extract.main_text(page) == f"Head & line\n{text} bold next line\n{text}\none\ntwo <3"


def test_html_without_article():
    long, short = "A sentence of the text, with words and marks; it goes on. " * 16, "A short one, of a few words, closes the page. " * 2
    whole = "\n".join(["T", long.strip(), short.strip()])
    for page in (
        f"<div><h1>T</h1><p>{long}</p><p>{short}</p></div>",
        f"<body><nav>Home</nav><div><section><h2>T</h2><p>{long}</p></section><section><p>{short}</p></section></div><footer>me</footer></body>",
        f"<body><div><h1>T</h1></div><div><ul><li>{long}</li></ul></div><div><span>{short}</span></div></body>",
        f"<table><tr><td>T</td><td>{long}</td></tr><tr><td>{short}</td></tr></table>",
    ):
        assert html_extract.main_text(page) == whole
    assert html_extract.main_text(f"<div><h1>T</h1><div><p>{long}</p></div></div>") == f"T\n{long.strip()}"
    assert html_extract.main_text(f"<p>{long}") == long.strip()


def test_html_by_classes():
    long = ("A sentence of the text, with words and marks; it goes on. " * 8).strip()
    article = f"<h1>T</h1><p>{long}</p><p>Short.</p>"
    whole = f"T\n{long}\nShort."
    comments = f'<div class="comments"><article><p>{long} {long} {long}</p></article></div>'
    for page in (
        f'<div class="content has-sidebar">{article}<div class="sidebar"><p>{long}</p></div></div>',
        f'<div id="page" class="layout-no-header"><nav>Home</nav>{article}{comments}</div>',
        f'<div class="sidebar-layout"><div class="header">Site</div>{article}{comments}<div class="related">More</div></div>',
        f'<div class="header"><h1>Site</h1></div><div>{article}</div>',
        f'<div><div><a href="a">Home</a> | <a href="b">News</a></div>{article}<ul><li><a>One</a></li><li><a>Two</a></li></ul></div>',
        f"<article>{article}</article>{comments}",
    ):
        assert html_extract.main_text(page) == whole, page
    # nothing else is left of the page
    assert html_extract.main_text(f'<div class="widget"><p>{long}</p></div><div class="comments"><p>{long}</p></div>') == long
    assert html_extract.main_text(f'<div class="comments"><p>{long}</p></div>') == ""


def test_html_within_a_line():
    page = '<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math>, <span class="ad">buy</span>then <a class="nav-link">see</a> it.</p><noscript>on</noscript><svg><text>icon</text></svg></article>'
    assert html_extract.main_text(page) == "Let x=2, then see it."


def test_html_depth():
    for n in (4, 20_000):
        deep = "".join(f"<div>a{i}, b." for i in range(n)) + "</section>" * n + "</div>" * n
        assert html_extract.main_text(deep).count("\n") == n - 1


def test_html_odd_rows(spark, odd, none):
    found = html_extract.extract_main_text(odd.withColumnRenamed("text", "html").withColumn("main_text", F.lit(1))).collect()
    assert len(found) == len(ODD) and {r.main_text for r in found if r.doc_id in (None, 1, 2, 3)} == {""}
    assert max(r.main_chars for r in found) == 149_999
    assert html_extract.extract_main_text(none.withColumnRenamed("text", "html")).count() == 0
    for broken in ("<", "<p", "<p class='x", "<script>never", "</p></div>", "<head><title>x", "a < b & c", "<!-- open"):
        assert isinstance(html_extract.main_text(broken), str)


# -- 4 ---------------------------------------------------------------------------------------------------------------


def test_topk_by_brute_force(spark):
    rng = np.random.default_rng(5)
    v = [(i, rng.normal(size=6).tolist()) for i in range(150)] + [(200 + i, [0.5] * 6) for i in range(120)]
    v += [(500, None), (501, [None] * 6), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (None, [1.0] * 6), (504, [9.0, 9.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    found = topk.search(df, df.where("vec_id % 20 = 0"), k=5).collect()
    good = [(i, np.pad(np.floor(64 * np.array(x)), (0, 6 - len(x)))) for i, x in v if i is not None and (i < 500 or i == 504)]
    want = {i: sorted((-int(a @ b), j) for j, b in good if j != i)[:5] for i, a in good if i % 20 == 0}
    got = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((-r.score, r.vec_id))
    assert got == want
    few = spark.createDataFrame([(0, [1.0]), (20, [2.0]), (3, [3.0])], "vec_id long, embedding array<double>")
    assert topk.search(few, few.where("vec_id % 20 = 0"), k=5).count() == 4
    assert topk.search(df.limit(0), df.limit(0)).count() == 0


# -- 5 ---------------------------------------------------------------------------------------------------------------


def test_media_round_trip(spark, odd, none):
    for text in ["", "x", "é" * 50, "long " * 5000]:
        plain = text.encode()
        payload = plain + bytes(max(64, -(-len(plain) // 64) * 64) - len(plain))
        fps, frames = media.read_frames(media.encode_payload(payload))
        assert b"".join(f.tobytes() for f in frames) == payload and fps == media.FPS
    rows = media.text_as_media(odd, keep_media=True).collect()
    assert len(rows) == len(ODD)
    for r, (_, text, _) in zip(sorted(rows, key=lambda r: (r.n_bytes, str(r.doc_id))), sorted(ODD, key=lambda o: (len(o[1] or ""), str(o[0]))), strict=True):
        plain = (text or "").encode()
        payload = plain + bytes(r.payload_bytes - len(plain))
        assert r.n_bytes == len(plain) and r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
    assert media.text_as_media(none).count() == 0


def test_shots_and_clips(spark):
    rng = np.random.default_rng(1)
    scenes = [(40, 5), (200, 4), (120, 6)]
    frames = [np.clip(rng.normal(level, 4, (16, 64)), 0, 255).astype(np.uint8) for level, n in scenes for _ in range(n)]
    data = media.write_avi([jpeg.encode_lossless(f) for f in frames], 64, 16, fps=5)
    files = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(data[:300])), (4, bytearray(b"x"))], "id long, media binary")
    rows = media.media_clips(files, "id").orderBy("id", "clip").collect()
    assert [(r.first_frame, r.last_frame) for r in rows if r.id == 1] == [(0, 4), (5, 8), (9, 14)]
    assert rows[1].start_s == pytest.approx(1.0) and all(r.error for r in rows if r.id != 1)


def test_generic_jpeg_decoding():
    samples = np.random.default_rng(0).integers(0, 256, (8, 16)).astype(np.uint8)
    coded = jpeg.encode_lossless(samples)
    scan = coded[coded.index(b"\xff\xda") + 10 : -2].replace(b"\xff\x00", b"\xff")
    table = jpeg._huffman(bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1)))
    assert (jpeg._lossless(scan, 8, 16, 1, table, b"") == samples).all()
    # a baseline frame of flat blocks, written bit by bit: DC differences in category 4 (code 0) and 0 (code 10), ends of block (code 0)
    dc = bytes([1, 1] + [0] * 14) + bytes([4, 0])
    ac = bytes([1] + [0] * 15) + bytes([0])
    out = io.BytesIO()
    out.write(b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes([16] * 64))
    out.write(b"\xff\xc0\x00\x0b\x08" + (8).to_bytes(2, "big") + (16).to_bytes(2, "big") + b"\x01\x01\x11\x00")
    out.write(b"\xff\xc4" + (2 + 1 + len(dc)).to_bytes(2, "big") + b"\x00" + dc + b"\xff\xc4" + (2 + 1 + len(ac)).to_bytes(2, "big") + b"\x10" + ac)
    bits = "0" + "1010" + "0" + "10" + "0"  # +10, then the same again
    out.write(b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00" + int(bits.ljust(16, "1"), 2).to_bytes(2, "big") + b"\xff\xd9")
    assert (jpeg.decode(out.getvalue()) == 128 + 10 * 16 // 8).all()


# -- 6 ---------------------------------------------------------------------------------------------------------------


def test_mixing_meets_targets(spark, odd, none):
    words = {"a": "apple pear plum", "b": "bolt screw nail"}
    rows = [(i, " ".join([words[d]] * 4) + f" filler{i % 7}", d) for i, d in enumerate("a" * 150 + "b" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    labelled = df.select("doc_id", "domain").where("doc_id % 2 = 0")
    mixed = mixing.mix(df.drop("domain"), labelled, {"a": 1.0, "b": 1.0}).join(df.select("doc_id", "domain"), "doc_id").collect()
    total = {d: sum(r.n_tokens * r.rate for r in mixed if r.domain == d) for d in "ab"}
    assert total["a"] / total["b"] == pytest.approx(1, abs=0.02) and sum(total.values()) == pytest.approx(200 * 13, rel=0.02)
    assert all((r.p_a > 0.9) == (r.domain == "a") for r in mixed) and all(abs(r.copies - r.rate) < 1 for r in mixed)
    strange = mixing.mix(odd, labelled, {"a": 1.0, "b": 1.0})
    assert strange.count() == len(set(o[:2] for o in ODD)) - 0 and mixing.mix(none, labelled, {"a": 1.0, "b": 1.0}).count() == 0
    assert mixing.mix(df, labelled.limit(0), {"a": 0.5, "b": 0.5}).where("rate < 0").count() == 0
    again = mixing.apply_copies(odd, strange.withColumn("copies", F.lit(2)))
    assert again.count() == 2 * len(ODD) and again.columns == odd.columns


def test_mixing_fit_is_finished(spark, monkeypatch):
    def rates(shares, soft=()):
        rows = [(i, i, round(1000 * x), 1, *[float(i == j) for j in range(3)]) for i, x in enumerate(shares)] + list(soft)
        table = spark.createDataFrame(rows, "doc long, hash long, n long, rows long, p0 double, p1 double, p2 double")
        monkeypatch.setattr(mixing, "posteriors", lambda *_: table)
        return rows, [r.rate for r in mixing.mix(None, None, **entry.MIX).orderBy("doc_id").collect()]

    # sorted domains: clean, junk, toxic; the targets can be met
    _, (clean, junk, toxic) = rates([121, 0.5, 17])
    budget = 1.15 * 121 / 0.95
    assert (clean, junk, toxic) == pytest.approx((1.15, 0.01 * budget / 0.5, 0.04 * budget / 17), rel=1e-3)
    # they can't: junk stays at the bound
    assert rates([121, 0.2, 17])[1] == pytest.approx([1.15, 4.0, 0.04 * budget / 17], rel=1e-3)
    # soft membership: no rate can move towards a better fit
    rng = np.random.default_rng(6)
    for toxic in (0.2, 17):
        rows, found = rates([60, 0.1, toxic], [(10 + i, i, int(rng.integers(1, 900)), 1, *map(float, rng.dirichlet([3, 0.1, 0.4]))) for i in range(200)])
        w, p, r = np.array([x[2] for x in rows]), np.array([x[4:] for x in rows]), np.array(found)
        gap = (w * r) @ p - np.array([0.95, 0.01, 0.04]) * 1.15 * (w @ p[:, 0]) / 0.95
        slope = p @ gap / w.sum()
        assert (r - np.clip(r - slope, 0, 4) == pytest.approx(0, abs=1e-5)) and (r > 0).any()


@pytest.mark.parametrize("seed", [42, 130])
def test_mixing_fit_out_of_reach(spark, monkeypatch, seed):
    """Targets out of reach, few documents between the bounds: a fit by steps cut in halves doesn't end; the second table needs falling weights."""
    rng = np.random.default_rng(seed)
    w, p = rng.integers(1, 900, 40), rng.dirichlet([2, 0.05, 0.1], 40)
    rows = [(i, i, int(n), 1, *map(float, x)) for i, (n, x) in enumerate(zip(w, p, strict=True))]
    table = spark.createDataFrame(rows, "doc long, hash long, n long, rows long, p0 double, p1 double, p2 double").coalesce(1)
    monkeypatch.setattr(mixing, "posteriors", lambda *_: table)
    with pytest.warns(UserWarning, match="miss their targets"):
        r = np.array([x.rate for x in mixing.mix(None, None, **entry.MIX).orderBy("doc_id").collect()])
    gap = (w * r) @ p - np.array([0.95, 0.01, 0.04]) * 1.15 * (w @ p[:, 0]) / 0.95
    assert r - np.clip(r - p @ gap / w.sum(), 0, 4) == pytest.approx(0, abs=1e-5)


# -- 7 ---------------------------------------------------------------------------------------------------------------


def test_license_scan_by_brute_force(spark, docs, sf_dir, odd, none):
    import regex

    rows = {r.doc_id: r for r in entry.op7_license_scan(spark, sf_dir).collect()}
    extra = spark.createDataFrame([(1, "All-Rights Reserved, cc by cc BY; GENERAL public\nlicense"), (2, "accc by"), (3, "cc by")], "doc_id long, text string")
    rows |= {-r.doc_id: r for r in license_scan.summarize(license_scan.scan_licenses(extra)).collect()}
    texts = dict(docs) | {-r.doc_id: r.text for r in extra.collect()}
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    for i, text in texts.items():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, label) for p, label in phrases.items() for k in range(len(words)) if tuple(words[k : k + len(p)]) == p]
        r = rows[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(sorted({x for _, x in places})))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    found = license_scan.summarize(license_scan.scan_licenses(odd))
    assert found.count() == len(ODD) and license_scan.scan_licenses(none).count() == 0


def test_license_suppression(spark):
    text = "This work is licensed under the GNU General Public License, version 3. Licensed under the Apache License, Version 2.0. Released under the MIT License."
    row = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "id long, text string")).first()
    assert [m.label for m in row.found] == ["gpl-3.0", "apache-2.0", "mit"]
    assert len(license_scan.signature_rules()) > 300


def test_license_gates_drop_no_match(spark):
    import random
    from re import _parser

    rng = random.Random(3)

    def sample(parsed):
        out = ""
        for op, arg in parsed:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "IN":
                kind, value = arg[0]
                out += chr(value if str(kind) == "LITERAL" else rng.randint(*value))
            elif name == "BRANCH":
                out += sample(rng.choice(arg[1]))
            elif name == "SUBPATTERN":
                out += sample(arg[-1])
            else:
                assert name == "MAX_REPEAT", name
                low, high, inner = arg
                out += "".join(sample(inner) for _ in range(rng.randint(low, min(int(high), low + 2))))
        return out

    rules = license_scan.signature_rules()
    texts = ["FreeBSD license", "freebsd", "For non-commercial\nuse only", "noncommercial  purposes only"]
    texts += [sample(_parser.parse(r.pattern)).replace(" ", rng.choice([" ", "\n", " - "])) for r in rules for _ in range(6 if r.cue == "" else 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    gated = {r.doc_id: r.found for r in license_scan.scan_licenses(df).collect()}
    # no rule has a keyword, and a last word, apart by one that is in no rule, opens every text's gate
    open_rules = [r._replace(keyword="", cue="") for r in rules]
    opened = df.withColumn("text", F.concat("text", F.lit(" zzz copy")))
    ungated = {r.doc_id: r.found for r in license_scan.scan_licenses(opened, rules=open_rules).collect()}
    assert all(ungated.values()) and {texts[i] for i in gated if gated[i] != ungated[i]} == set()


# -- 8 ---------------------------------------------------------------------------------------------------------------


def kept_by_hand(texts):
    """The first line of each class by all 12-character windows of the lines, as the dealt method has it."""
    ids, places = {}, []
    for d, t in texts:
        for pos, raw in enumerate((t or "").split("\n")):
            line = raw.strip(" \t\r\xa0")
            if line:
                places.append((d, pos, ids.setdefault(line, len(ids))))
    sets = [frozenset(x[k : k + 12] for k in range(max(1, len(x) - 11))) for x in ids]
    u = Union(len(sets))
    for a, b in similar_pairs(sets):
        u.join(a, b)
    first = {}
    for d, pos, k in places:
        first.setdefault(u.find(k), (d, pos))
    return set(first.values())


def test_line_dedup_by_brute_force(spark, docs, sf_dir):
    base = "alpha bravo charlie delta echoes foxtrot golfing hotels indigo juliet kilogram limabean mikes november oscar".split()
    near = [(1000 + i, " ".join([*base[:i], f"changed{i}", *base[i + 1 :]]) + f"\nown line number{i}x") for i in range(15)] + [(2000 + i, " ".join(base)) for i in range(40)]
    texts = docs + near
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = line_dedup.dedup_lines(df, with_text=False).collect()
    kept = kept_by_hand(texts)
    for r, t in ((r, dict(texts)[r.doc_id]) for r in rows):
        lines = t.split("\n")
        want = [p for p, x in enumerate(lines) if not x.strip(" \t\r\xa0") or (r.doc_id, p) in kept]
        assert (r.kept_lines, r.n_lines, r.n_kept) == (want, len(lines), len(want))
    cut = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert all(cut[r.doc_id] == "\n".join(dict(texts)[r.doc_id].split("\n")[p] for p in r.kept_lines) for r in rows)


def test_line_dedup_large_buckets(spark, monkeypatch):
    """Chains of near copies in buckets beyond a block: pivots, then blocks; each line is alike to its neighbours only."""
    words = [f"word{i:02d}" for i in range(40)]
    texts = [(i, " ".join([*(f"w{j}x{i // 40}" for j in range(i % 40)), *words[i % 40 :]])) for i in range(120)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    kept = kept_by_hand(texts)
    monkeypatch.setattr(line_dedup, "BLOCK", 6)
    monkeypatch.setattr(line_dedup, "PIVOTS", 2)
    rows = line_dedup.dedup_lines(df, with_text=False).collect()
    assert {r.doc_id for r in rows if r.n_kept} == {d for d, _ in kept}


def test_line_bitmaps_lose_no_pair(spark):
    """Bitmaps never pass over a pair that reaches the threshold, and pass over most that don't."""
    rng = random.Random(5)
    base = [rng.choice("abcdefgh ") for _ in range(400)]
    lines = []
    for i in range(60):
        own = list(base)
        for _ in range(i // 2):
            own[rng.randrange(400)] = "#"
        lines.append("".join(own) * (2 if i % 7 == 0 else 1))
    lines += ["short", "ab" * 300, "x" * 50]
    sets = [{x[k : k + 12] for k in range(max(1, len(x) - 11))} for x in lines]
    bitmaps = line_dedup._bitmaps(spark.createDataFrame(list(enumerate(lines)), "lk long, line string"))
    assert {r.lk: r.size for r in bitmaps.collect()} == {i: len(x) for i, x in enumerate(sets)}
    left, right = line_dedup._side(bitmaps, "a"), line_dedup._side(bitmaps, "b")
    found = {(r.a_lk, r.b_lk) for r in left.join(right, F.col("a_lk") < F.col("b_lk")).where(line_dedup._possible(0.8)).collect()}
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    apart = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) < 0.65 * len(sets[i] | sets[j])}
    assert alike <= found and len(alike) > 20 and len(apart) > 500 and len(found & apart) <= len(apart) // 100


@pytest.mark.parametrize("step", [1, 3, 4])
def test_line_shingles_in_steps(spark, monkeypatch, step):
    """Rows of several shingles give the minima, weights and bitmaps of the shingles one by one, at all lengths of a line."""
    monkeypatch.setattr(line_dedup, "STEP", step)
    lines = [(i, "".join(chr(0x1F300 + k * k * 31 % 500) for k in range(i))) for i in range(1, 40)] + [(100, "ab" * 50), (100, "ab" * 50), (101, "x" * 13)]
    df = spark.createDataFrame(lines, "lk long, line string")
    each = df.select("lk", F.explode(F.sequence(F.lit(1), F.greatest(F.length("line") - 11, F.lit(1)))).alias("i"), "line")
    hashes = each.select("lk", F.xxhash64(F.encode(F.substring("line", F.col("i"), F.lit(12)), "UTF-32")).alias("h")).withColumn("p", F.xxhash64("h")).collect()
    want, sets = collections.defaultdict(list), collections.defaultdict(dict)
    for r in hashes:
        want[r.lk].append(r.h)
        sets[r.lk][r.h] = (r.p % 2**64 >> 7) % (64 * line_dedup.WORDS)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    turn = lambda h, b: ((h << b) | (h % 2**64 >> 64 - b)) % 2**64
    for r in line_dedup._signatures(df).collect():
        turned = [[turn(h % 2**64, b) for b in (0, 16, 32, 48)] for h in want[r.lk]]
        choices = [c for n in (1, 2, 3) for c in itertools.combinations(range(4), n)]
        minima = [min(signed(functools.reduce(int.__xor__, (t[i] for i in c))) for t in turned) for c in choices]
        assert (r.weight, [r[f"m{i}"] for i in range(14)]) == (len(want[r.lk]), minima)
    for r in line_dedup._bitmaps(df.distinct()).collect():
        bits = functools.reduce(int.__xor__, (1 << p for p in sets[r.lk].values()))
        assert (r.size, sum(r[f"w{w}"] % 2**64 << 64 * w for w in range(line_dedup.WORDS))) == (len(sets[r.lk]), bits)


def test_line_texts_are_passed_over_before_the_shuffle(spark):
    """The table of bits stands below the join by line keys, so that only texts that it lets through are shuffled."""
    lines = spark.createDataFrame([(i, f"line {i}") for i in range(50)], "lk long, line string")
    texts = line_dedup._texts(lines, spark.createDataFrame([(i, i % 3) for i in range(0, 50, 10)], "lk long, bucket long"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = texts._jdf.queryExecution().sparkPlan().toString()
        assert {(r.lk, r.line) for r in texts.collect()} == {(i, f"line {i}") for i in range(0, 50, 10)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert 0 <= plan.find("SortMergeJoin") < plan.find("BroadcastHashJoin")


def test_line_pairs_by_their_union(spark):
    """The size of the union decides as intersection over union does, at the threshold too, with repeated shingles and short lines."""
    rng = random.Random(3)
    long = "".join(chr(0x1F300 + i) for i in range(92))  # 81 shingles, of which 9 less is 8 in 10 of the union
    lines = [long, *(long[k:] + long[:k] for k in (1, 9)), *(long[:-k] for k in range(14, 20)), "ab" * 30, "ab" * 7, "x", "xy", "x" * 12, "x" * 40]
    lines += ["".join(rng.choice("ab") for _ in range(n)) * 2 for n in (5, 20, 20)]
    sets = [{x[k : k + 12] for k in range(max(1, len(x) - 11))} for x in lines]
    pairs = [(a, b, len(sets[a]) + len(sets[b])) for b in range(len(lines)) for a in range(b)]
    texts = spark.createDataFrame(list(enumerate(lines)), "lk long, line string")
    found = {(r.a, r.b) for r in line_dedup._exact(spark.createDataFrame(pairs, "a long, b long, sizes int"), texts, 0.8).collect()}
    want = {(a, b) for a, b, _ in pairs if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    assert found == want and any(10 * len(sets[a] & sets[b]) == 8 * len(sets[a] | sets[b]) for a, b in want)


def test_line_dedup_odd_rows(spark, odd, none):
    rows = line_dedup.dedup_lines(odd).collect()
    assert len(rows) == len(ODD) and line_dedup.dedup_lines(none).count() == 0
    assert [r.text for r in rows if r.doc_id == 4] == ["one two", "one two"] and [r.text for r in rows if r.doc_id == 6] == [""]
    assert {r.text for r in rows if r.doc_id == 3} == {"  \n\n "}


def test_line_dedup_clashing_names(spark):
    df = spark.createDataFrame([(1, "a line\n\nof text"), (2, "a line"), (3, None)], "doc_id long, text string")
    df = df.withColumns({c: F.lit(i) for i, c in enumerate(("doc", "hash", "kept", "__hash", "row", "lines", "stay", "n_lines", "blank", "pos", "lk"))})
    rows = line_dedup.dedup_lines(df).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text, r.n_lines, r.n_kept, r.hash, r.lines) for r in rows] == [(1, "a line\n\nof text", 3, 3, 1, 5), (2, "", 1, 0, 1, 5), (3, "", 1, 1, 1, 5)]
    # only the key and the text: no other column goes along
    assert line_dedup.dedup_lines(df.select("doc_id", "text"), with_text=False).columns == ["doc_id", "n_lines", "n_kept", "kept_lines"]


def kept_lines_of(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return [r.doc_id for r in line_dedup.dedup_lines(df, with_text=False).orderBy("doc_id").collect() if r.n_kept]


def test_line_dedup_compares_whole_lines(spark):
    short = "it is as it was and so it is to be or not to be in the end of it all as we do go on by and by if he or I am up at ten "
    other = "日本語の行には空白がないので一つの語になる"
    same, apart = [short + "a", short + "b"], ["Temperature: 21", "Temperature: 35", "Congratulations to the new cat", "Congratulations on a big win"]
    apart += ["https://example.org/" + x * 20 for x in "ab"] + [other + x * 40 for x in "山川"]
    assert kept_lines_of(spark, [*same, *apart]) == [0, *range(2, 10)]
    # a change at any place of a long line without blanks, also beyond the Basic Multilingual Plane
    long = "".join(chr(0x1F300 + i * 7919 % 700) for i in range(300))
    assert kept_lines_of(spark, [long, *(long[:k] + "x" + long[k + 1 :] for k in (0, 63, 64, 75, 76, 150, 299)), long[:150]]) == [0, 8]


def test_line_dedup_by_full_shingles(spark, docs):
    """Against all 12-character windows of every line, found here without the operator's pieces or patterns."""
    base = "we go to the sea and we go to the hills and we see a lot of it all and then we go home and sit by the fire till it is out"
    texts = docs + [(1000 + i, base[: 6 * i] + "#" + base[6 * i + 1 :] + f"\n{i}") for i in range(20)]
    ids, places = {}, []
    for d, t in texts:
        for pos, raw in enumerate((t or "").split("\n")):
            if line := raw.strip(" \t\r\xa0"):
                places.append((d, pos, ids.setdefault(line, len(ids))))
    sets = [frozenset(line[k : k + 12] for k in range(max(1, len(line) - 11))) for line in ids]
    u, first, want = Union(len(sets)), {}, collections.defaultdict(list)
    for a, b in similar_pairs(sets):
        u.join(a, b)
    for d, pos, k in places:
        first.setdefault(u.find(k), (d, pos))
    for d, pos in sorted(first.values()):
        want[d].append(pos)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc: r.kept for r in line_dedup.kept_lines(df).collect()} == want


# -- 9 ---------------------------------------------------------------------------------------------------------------


def test_ngram_join_by_brute_force(spark, docs):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(300)]
    near = []
    for i in range(90):
        words = list(base)
        for k in rng.choice(300, 3, replace=False):
            words[k] = f"x{i}_{k}"
        near.append((5000 + i, " ".join(words)))
    texts = docs + near + [(6000 + i, near[0][1]) for i in range(5)] + [(7000, "one two three"), (7001, "One  two three"), (7002, ""), (7003, None)]
    sets = []
    for _, t in texts:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    u, links = Union(len(sets)), collections.Counter()
    for a, b in similar_pairs(sets):
        u.join(a, b)
        links[a] += 1
        links[b] += 1
    want = {d: (texts[u.find(i)][0], links[i]) for i, (d, _) in enumerate(texts)}
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similarity_classes(df).collect()} == want
    kept = sorted(r.doc_id for r in ngram_join.keep_one(df).collect())
    assert kept == sorted({c for c, _ in want.values()})


@pytest.mark.parametrize("small, levels", [(8, 4), (8, 1)])
def test_ngram_join_recursion(spark, monkeypatch, small, levels):
    """Buckets split by further tokens, and those that the last level leaves whole: the recall against brute force."""
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "LEVELS", levels)
    rng = np.random.default_rng(9)
    texts = []
    for group in range(3):
        words = [f"g{group}w{i}" for i in range(200)]
        for i in range(80):  # a random walk: neighbours are alike, distant ones are not
            for k in rng.choice(200, 2, replace=False):
                words[k] = f"x{group}_{i}_{k}"
            texts.append((group * 100 + i, " ".join(words)))
    texts += [(900 + i, " ".join(f"u{i}w{k}" for k in range(50))) for i in range(40)]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (t.split() for _, t in texts)]
    pairs = similar_pairs(sets)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similarity_classes(df).collect()}
    together = sum(found[texts[a][0]][0] == found[texts[b][0]][0] for a, b in pairs)
    assert len(pairs) > 200 and together >= 0.99 * len(pairs)
    u = Union(len(sets))
    for a, b in pairs:
        u.join(a, b)
    # no class holds what brute force keeps apart
    assert all(u.find(i) == u.find(j) for i in range(len(sets)) for j in range(i) if found[texts[i][0]][0] == found[texts[j][0]][0])


def test_ngram_join_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 5), (2, "a b c d e f", 6), (3, None, 7)], "doc_id long, text string, doc long")
    df = df.withColumns({c: F.lit(1) for c in ("hash", "row", "once", "__doc", "__at", "__once", "__hash", "id", "comp", "a.b")})
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id, r.doc) for r in kept.collect()) == [(1, 5), (3, 7)]


def test_ngram_join_odd_rows(spark, odd, none):
    rows = ngram_join.similarity_classes(odd).collect()
    assert len(rows) == len(ODD) and ngram_join.similarity_classes(none).count() == 0
    assert {(r.class_id, r.n_links) for r in rows if r.doc_id in (4, 6)} == {(4, 2)}
    assert ngram_join.keep_one(odd).columns == odd.columns and ngram_join.keep_one(odd).where("doc_id in (4, 6)").count() == 1


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(300 + i, 301 + i) for i in range(40)] + [(9, 9)]
    u = Union(400)
    for a, b in edges:
        u.join(a, b)
    found = components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()
    assert {r.node: r.comp for r in found} == {n: u.find(n) for e in edges for n in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 10 --------------------------------------------------------------------------------------------------------------


def test_packing(spark, docs, sf_dir, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    rows = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in entry.op10_best_fit_packing(spark, sf_dir).collect():
        rows[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    tokens = 0
    for d, text in docs:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        tokens += len(ids)
        own = sorted(rows[d], key=lambda r: r.piece)
        assert [(r.start, r.length) for r in own] == packing.cut(len(ids), 2048)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(sequences) <= 1.02 * tokens / 2048 + 1
    found = packing.pack(odd, TOKENIZER, 64).collect()
    assert len({(r.sequence_id, r.offset) for r in found}) == len(found) and sum(r.length == 1 for r in found) >= 3
    assert packing.pack(none, TOKENIZER, 64).count() == 0


def test_encoder_agrees_with_tokenizers():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    special = [x.content for x in t.get_added_tokens_decoder().values()]
    assert special
    texts = ["", "Hello <|endoftext|> wörld  \n\n x", "a" * 3000, "it's 日本語 \t\t 12345 🙂", " " * 1_000_000 + "x", "\n" * 300_000, "x" * 100_000]
    texts += [form.format(x) for x in special for form in ("a {} b", "{}", "  {}  ", "{0}{0}x", "a{}\n", "<{}>")]
    for text in texts:
        assert packing.load_encoder(TOKENIZER)(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_clashing_names(spark):
    """Columns of the caller that are called like what the operators use inside, or like what they return."""
    names = ["doc", "hash", "row", "text_", "html", "line", "low", "every", "rows", "score", "media", "__text", "__html", "__doc", "__copies", "copies", "a.b", "label"]
    df = spark.createDataFrame([(1, "all rights reserved. A line.\nAnd more"), (2, None)], "doc_id long, text string").withColumns({n: F.lit(i) for i, n in enumerate(names)})
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    kept = [n for n in df.columns if n != "text"]
    assert set(kept) <= set(quality_crf.classify(df, labels).columns) and quality_crf.classify(df, labels).count() == 2
    model = quality_crf.train(df, labels)
    assert quality_crf.score_quality(df, model, score="__score", keep_text=True).select("text", "score", "`a.b`").first() == ("all rights reserved. A line.\nAnd more", 9, 16)
    assert media.text_as_media(df).select("row", "html").first() == (2, 4)
    assert license_scan.summarize(license_scan.scan_licenses(df)).where("doc_id = 1").select("line", "base_labels").first() == (5, "reserved")
    assert html_extract.extract_main_text(df.drop("html").withColumnRenamed("text", "html")).select("row", "main_text").first() == (2, "all rights reserved. A line. And more")
    mixed = mixing.mix(df, spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, domain string"), {"a": 1.0, "b": 1.0})
    again = mixing.apply_copies(df, mixed.drop("copies").withColumn("copies", F.lit(2)))
    assert again.columns == df.columns and again.count() == 4
    assert packing.pack(df, TOKENIZER, 16).count() == 2 and packing.pack(df, TOKENIZER, 16, key="doc").columns[0] == "doc"
    rules = spark.createDataFrame([("É.net", None, "block"), (None, "/", "block"), ("EXAMPLE.org", "/", None)], "host string, path string, verdict string")
    urls = spark.createDataFrame([(1, "http://É.net/x"), (2, "http://a.example.ORG/")], "page_id long, url string").withColumn("key", F.lit(3))
    assert {(r.page_id, r.rule, r.verdict) for r in url_filter.apply_rules(urls, rules).collect()} == {(1, "É.net", "block"), (2, "example.org/", "")}


def test_damaged_frames(spark):
    samples = np.random.default_rng(7).integers(0, 256, (16, 64)).astype(np.uint8)
    good = media.write_avi([jpeg.encode_lossless(samples)] * 2, 64, 16)
    bad = [good[:i] for i in range(0, len(good), 97)]
    rng = np.random.default_rng(8)
    for _ in range(150):
        cut = bytearray(good)
        for at in rng.integers(0, len(good), 3):
            cut[at] = int(rng.integers(0, 256))
        bad.append(bytes(cut))
    # a sampling factor of zero, and restarts without their markers
    head = b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes([16] * 64)
    frame = lambda factor, restart: head + restart + b"\xff\xc0\x00\x0b\x08\x00\x10\x00\x10\x01\x01" + factor + b"\x00\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00" + bytes(8) + b"\xff\xd9"
    bad += [media.write_avi([f], 16, 16) for f in (frame(b"\x00", b""), frame(b"\x11", b"\xff\xdd\x00\x04\x00\x01"))]
    files = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(bad)], "id long, media binary")
    rows = media.media_clips(files, "id").collect()
    assert {r.id for r in rows} == set(range(len(bad))) and all(r.error for r in rows if r.id >= len(bad) - 2)


def test_standard_tables():
    """A frame without Huffman tables, as Motion JPEG has them: flat blocks by the standard codes, written bit by bit."""
    codes = jpeg._standard()
    assert [len(codes[k]) for k in (0, 1, 0x10, 0x11)] == [12, 12, 162, 162]
    # DC category 4 is 101, 0 is 00; the end of a block is 1010
    bits = "101" + "1010" + "1010" + "00" + "1010"
    scan = int(bits.ljust(24, "1"), 2).to_bytes(3, "big")
    frame = b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes([16] * 64) + b"\xff\xc0\x00\x0b\x08\x00\x08\x00\x10\x01\x01\x11\x00\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00" + scan + b"\xff\xd9"
    assert (jpeg.decode(frame) == 128 + 10 * 16 // 8).all()


# -- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
