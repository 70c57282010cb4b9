import os
import random
import re
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute

from keyloom.llm import bwt, components, decontam, langid, licenses, mixing, pages, quality, sharding, simhash, suffixes, tokens
from keyloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa la mu nu xi omi pi rho sig tau ups phi chi psi ome".split()


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


BASE = text(1, 60)
LONG = text(2, 30_000)
ROWS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "one", "en", ""), (5, "one two", "en", "a"), (6, "one two", "en", "b"),
    (7, BASE, "en", "a"), (8, BASE, "en", "a"), (8, BASE, "en", "a"), (9, BASE.replace("alpha", "Alpha"), "de", "b"), (9, "other text with the same id", "de", "b"),
    (10, BASE + " tail", "fr", "c"), (11, "x " + BASE[:200] + " y " + BASE[100:300], "fr", None), (12, LONG, "en", "c"), (13, LONG[5_000:9_000] + "é€😀 #*$ <b>", "en", "c"),
    (14, ("line one is here\n" * 30), "en", "d"), (15, "a" * 300, "en", "d"), (16, "a" * 120 + "b", "en", "d"), (None, BASE, "en", "d"), (None, None, None, None),
    (17, "▁ 　 \x85 a\x0bb\r\nc  d   ", "es", "e"), (-5, BASE[50:180], "es", "e"), (18, "Q: " + text(3, 20) + "?!", "en", "f"), (19, text(4, 5).upper(), "en", "f"),
]
ITEMS = [(1, text(3, 20)), (2, text(4, 5)), (3, None), (4, " .. "), (5, text(3, 20)), (None, text(2, 14)), (6, text(9, 14))]
PAGES = [(1, "https://a.example.org/en/1", "<html lang=en><p>x"), (2, None, None), (3, "not a url", "")]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """Edge cases with columns whose names clash with computed ones, and empty tables."""
    out = {}
    for name in ("edge", "empty"):
        d = str(tmp_path_factory.mktemp(name))
        take = (lambda x: x) if name == "edge" else (lambda x: [])
        docs = spark.createDataFrame(take(ROWS), "doc_id long, text string, lang string, source string")
        for c in ("n_chars", "row", "kept", "p", "fp", "n_words", "slot", "shard", "hits", "w", "n", "host", "tokens", "least", "none"):
            docs = docs.withColumn(c, F.lit(7).cast("long"))
        docs.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(take(ITEMS), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        spark.createDataFrame(take(PAGES), "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
        out[name] = d
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def cases(spark, folders):
    yield [(d, t) for d, t, *_ in ROWS], folders["edge"], ITEMS
    read = lambda n: [tuple(r) for r in spark.read.parquet(f"{SF}/{n}.parquet").select(*(("doc_id", "text") if n == "documents" else ("item_id", "text"))).collect()]
    yield read("documents"), SF, read("benchmark")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, folders, name):
    assert QUERIES[name](spark, folders["empty"]).collect() == []


def test_simhash(spark, folders):
    for rows, d, _ in cases(spark, folders):
        assert ordered(simhash.op1_bk_tree_simhash(spark, d).collect()) == ordered(brute.simhash(rows))


def test_bk_trees_find_all_links(spark):
    r = random.Random(5)
    seeds = [r.getrandbits(64) for _ in range(40)]
    values = sorted({s ^ sum(1 << b for b in r.sample(range(64), r.randrange(6))) for s in seeds for _ in range(30)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = {frozenset((a, b)) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 3}

    def classes(links):
        root = {v: v for v in values}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[find(a)] = find(b)
        return {frozenset(v for v in values if find(v) == top) for top in map(find, values)}

    for cap in (simhash.SHARD_CAP, 4):  # with 4 every busy shard is split into chunks
        got = {frozenset((r["a"] % 2**64, r["b"] % 2**64)) for r in simhash.links(df, cap=cap).collect()}
        assert classes(map(tuple, got)) == classes(map(tuple, want))


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (4, 6), (7, 7), (None, 1)] + [(100 + i, 101 + i) for i in range(60)] + [(-1, 200 + i) for i in range(50)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert [got[x] for x in (1, 2, 3, 4, 5, 6)] == [1, 1, 1, 4, 4, 4] and 7 not in got
    assert {got[x] for x in range(100, 161)} == {100} and {got[x] for x in range(200, 250)} == {-1}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_hot_nodes(spark, seed):
    r = random.Random(seed)
    links = [(r.choice([-5, 9000]), i) for i in range(1, 1500)] + [(i, 9001) for i in range(3000, 4000)]
    links += [(r.randrange(5000, 8000), r.randrange(5000, 8000)) for _ in range(1200)]
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    least = {x: x for link in links if link[0] != link[1] for x in link}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(least.get(a, a), least.get(b, b))
            for x in (a, b) if a != b else ():
                moved |= least[x] > low
                least[x] = low
    assert sorted((x["node"], x["root"]) for x in got) == sorted(least.items())


def test_shards(spark, folders):
    for rows, d, _ in cases(spark, folders):
        got = sharding.op2_hash_tree(spark, d).collect()
        tree, grown = sharding.base_tree(), sharding.grow(sharding.base_tree(), 8)
        want = [(i, *brute.size_and_crc(t), "key", brute.shard(i, tree), brute.shard(i, grown)) for i, t in rows]
        assert ordered((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == ordered(want)
        assert all(r["grown_shard"] in (r["shard"], 8) for r in got)
        for s in {r["shard"] for r in got}:
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_movement_stays_in_changed_subtrees(spark):
    before = {"a": {"r": {0: 1.0, 1: 1.0}, "s": {2: 2.0}}, "b": {"t": {3: 1.0, 4: 3.0}}}
    after = {"a": {"r": {0: 1.0, 1: 1.0}, "s": {2: 2.0}}, "b": {"t": {3: 2.0, 4: 2.0}}}
    df = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    rows = df.select(sharding.place(F.col("k"), before).alias("x"), sharding.place(F.col("k"), after).alias("y")).collect()
    assert all(r["x"] == r["y"] or {r["x"], r["y"]} <= {3, 4} for r in rows)
    share = [sum(r["x"] == s for r in rows) / 4000 for s in range(5)]
    assert all(abs(a - b) < 0.04 for a, b in zip(share, (1 / 8, 1 / 8, 2 / 8, 1 / 8, 3 / 8), strict=True))


def test_slots_in_many_blocks(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("shard"))
    got = sharding.number_slots(df, "shard", ["doc_id"], 7).collect()
    for s in range(3):
        own = [r["slot"] for r in got if r["shard"] == s]
        assert sorted(own) == list(range(len(own)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, folders, name):
    for d in (SF, folders["edge"]):
        con = duckdb.connect()
        for t in ("documents", "pages", "benchmark"):
            path = f"{d}/{t}.parquet"
            con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
        df = QUERIES[name](spark, d)
        cols = sorted(df.columns)
        want = con.sql(ORACLES[name])
        assert sorted(want.columns) == cols
        assert ordered(tuple(r[c] for c in cols) for r in df.collect()) == ordered(tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall())


def test_raking_meets_targets(spark):
    cells = [("a", "en", "x", 900), ("a", "de", "x", 300), ("b", "en", "y", 500), ("b", "de", "x", 200), ("b", "de", "y", 100)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    wish = {"source": spark.createDataFrame([("a", 1.0), ("b", 1.0)], "value string, share double"), "lang": spark.createDataFrame([("en", 3.0), ("de", 2.0)], "value string, share double")}
    rows = mixing.rake(df, wish, rounds=60).collect()
    total = sum(r["tokens"] * r["p"] for r in rows)
    assert max(r["p"] for r in rows) == pytest.approx(1.0)
    assert sum(r["tokens"] * r["p"] for r in rows if r["source"] == "a") / total == pytest.approx(0.5, abs=0.01)
    assert sum(r["tokens"] * r["p"] for r in rows if r["lang"] == "en") / total == pytest.approx(0.6, abs=0.01)


def test_quality(spark, folders):
    for rows, d, _ in cases(spark, folders):
        got = quality.op4_host_quality(spark, d).collect()
        assert ordered(tuple(r)[:-1] for r in got) == ordered((i, *brute.quality(t)) for i, t in rows)
        assert not any(r["kept"] and r["base_failed"] for r in got)


def test_bad_hosts_take_their_documents_along(spark):
    good, bad = text(7, 50), "short"
    rows = [("bad", bad)] * 60 + [("bad", good)] + [(f"h{i}", good) for i in range(40)] + [("mixed", bad)] * 5 + [("mixed", good)] * 5 + [(None, good)]
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "doc_id int, source string, text string")
    kept = {r["row"]["source"] for r in quality.judge(df).where("kept").collect()}
    assert kept == {None, "mixed", *(f"h{i}" for i in range(40))}


def test_languages(spark, folders):
    got = langid.op5_fused_language(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("lang").alias("truth"), "n_chars")
    rows = got.where("doc_id is not null").join(truth, "doc_id").collect()
    assert len(rows) == 200 and sum(r["lang"] == r["truth"] for r in rows) >= 195
    web = got.where("page_id is not null").collect()
    assert web and sum(r["lang"] == r["declared"] for r in web) / len(web) > 0.95
    assert langid.op5_fused_language(spark, folders["edge"]).count() == len(ROWS) + len(PAGES)


def test_held_out_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, held = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    rows = langid.identify(langid.document_rows(held), train).join(held.select("doc_id", F.col("lang").alias("truth")), "doc_id").collect()
    assert sum(r["lang"] == r["truth"] for r in rows) / len(rows) > 0.97


def test_rare_and_many_languages_have_models(spark):
    rows = [(i, text(i, 12), "en") for i in range(300)] + [(1000, "zzq yyx wwv kkj qqp xxz " * 5, "rare")] + [(2000 + i, text(500 + i, 9), f"l{i:03}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, rows=5)
    assert sorted(model) == sorted({r[2] for r in rows})
    assert all(len(set(v.tolist())) > 1 for v in model.values())  # none is uniform


def test_tokens(spark, folders):
    sp = tokens.load(tokens.model_path())
    for rows, d, _ in cases(spark, folders):
        want = ordered((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in rows)
        assert ordered(tuple(r)[:3] for r in tokens.op6_pretoken_counts(spark, d).collect()) == want
        docs = spark.read.parquet(f"{d}/documents.parquet")
        assert ordered(tokens.count_tokens(docs, tokens.model_path(), head=3).collect()) == want


def test_repeats(spark, folders, monkeypatch):
    for rows, d, _ in cases(spark, folders):
        want = ordered(brute.repeats([(i, t if t is None or len(t) < 50_000 else t) for i, t in rows]))
        assert ordered(suffixes.op7_merged_bwt(spark, d).collect()) == want
    monkeypatch.setattr(suffixes, "GROUP_CAP", 1)  # every shared key is split
    assert ordered(suffixes.op7_merged_bwt(spark, SF).collect()) == want


@pytest.mark.parametrize("seed", range(4))
def test_merged_transforms(seed, monkeypatch):
    monkeypatch.setattr(bwt, "SHARD", 40)
    r = random.Random(seed)
    strings = ["".join(r.choice("ab" if seed % 2 else "abcd") for _ in range(r.randrange(1, 30))).encode() + bytes([r.randrange(256)]) for _ in range(60)]
    import numpy as np

    least = np.array([r.randrange(1000) for _ in strings])
    got = bwt.repeated_minima(strings, least, 6)
    low = {}
    for s, v in zip(strings, least, strict=True):
        for i in range(len(s) - 5):
            low[s[i : i + 6]] = min(int(v), low.get(s[i : i + 6], 10**9))
    assert [x.tolist() for x in got] == [[low[s[i : i + 6]] for i in range(max(0, len(s) - 5))] for s in strings]


def test_pages():
    cases_ = {
        "": "", None: "", "a  b\n c": "a b c", "1 < 2 & 3": "1 < 2 & 3",
        "<p>a<p>b": "a\n\nb", "<div>a</div>b<br>c": "a\nb\nc",
        "<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>": "- a\n- b\n  3. c\n  4. d",
        "<head><title>t</title></head><body>x<script>a</script><style>b</style><!-- c -->y": "xy",
        "a<span hidden>b</span><i style='display: none'>c</i><b style=visibility:hidden>d</b>e": "ae",
        "<table><tr><th>n<th>value<tr><td>long name<td>1</table>": "n          value\nlong name  1",
        "<pre>  x\n   y</pre>": "  x\n   y", "<details><summary>s</summary>hid</details>": "s",
        "<p>&eacute;&nbsp;x</p>": "é x", "<dl><dt>t<dd>d</dl>": "t\n  d", "</p>a</b>": "a",
    }
    for html, want in cases_.items():
        assert pages.page_text(html) == want, html
    assert pages.page_text("<div>" * 5000 + "deep") == "deep"


def random_page(r, depth=0):
    """Kids of a random element."""
    out = []
    for _ in range(r.randrange(1, 5)):
        kind = r.choice(["text", "text", "b", "p", "div", "ul", "ol", "table", "script"]) if depth < 5 else "text"
        attrs = {"hidden": ""} if r.random() < 0.1 else {}
        if kind == "text":
            out.append(r.choice([" ", ""]) + f"w{r.randrange(99)}" + r.choice([" ", "  x\n", ""]))
        elif kind == "script":
            out.append((kind, {}, ["var <p> x"]))
        elif kind in ("ul", "ol"):
            out.append((kind, attrs, [("li", {"hidden": ""} if r.random() < 0.1 else {}, random_page(r, depth + 1)) for _ in range(r.randrange(1, 4))]))
        elif kind == "table":
            cell = lambda: ("td", {k: str(r.randrange(2, 4)) for k in ("colspan", "rowspan") if r.random() < 0.15}, random_page(r, depth + 2))
            out.append((kind, attrs, [("tr", {}, [cell() for _ in range(r.randrange(1, 4))]) for _ in range(r.randrange(1, 4))]))
        elif kind == "p":
            out.append((kind, attrs, [f"t{r.randrange(99)}", ("b", {}, [" y"])]))
        else:
            out.append((kind, attrs, random_page(r, depth + 1) if kind == "div" else [f"z{r.randrange(9)}"]))
    return out


def markup(r, kids):
    """HTML of a tree; end tags that are implied are left out now and then."""
    out = ""
    for i, k in enumerate(kids):
        if isinstance(k, str):
            out += k
            continue
        tag, attrs, inner = k
        out += f"<{tag}" + "".join(r.choice([f" {a}={v or 'x'}", f" {a}='{v}'", f' {a.upper()} = "{v}"']) for a, v in attrs.items()) + ">" + markup(r, inner)
        last = i == len(kids) - 1
        free = tag in ("li", "td", "tr") or (tag == "p" and (last or (not isinstance(kids[i + 1], str) and kids[i + 1][0] in ("p", "div", "ul", "ol", "table"))))
        out += "" if free and r.random() < 0.5 else f"</{tag}>"
    return out


def test_pages_against_a_plain_renderer():
    for seed in range(400):
        r = random.Random(seed)
        kids = random_page(r)
        page = markup(r, kids)
        assert pages.page_text(page) == "\n".join(brute.page_lines(kids)), page


def test_hard_pages_are_read_in_linear_time_and_keep_their_layout():
    import time

    assert pages.page_text("<div>" * 200 + "<span hidden>no</span>yes") == "yes"
    assert pages.page_text("<div>" * 300 + "<ul><li>a<li>b</ul><table><tr><td>xy<td>z<tr><td>long<td>q</table>") == "- a\n- b\n\nxy    z\nlong  q"
    assert pages.page_text('<a href="x"">y</a><b title=\'q>z') == "yz"
    assert pages.page_text("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == "a  b\n   c"
    began = time.time()
    for part in ("<a ", '<a b="', "<a b='\" ", "<!--", "</script ", "<script>x</script ", "<div>", "<ul><li>a", "<table><tr><td>a<td>b", "<td rowspan=9999 colspan=1000>a", "<p><table><span>", "<", "&am", "<li>x", "<math><mfrac>1"):
        pages.page_text(part * (200_000 // len(part)))
    assert time.time() - began < 60
    assert pages.page_text("<ul><li>" * 20_000 + "deep").endswith("deep")


def test_formulas_and_labels_of_drawings_stay():
    cases_ = {
        "a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b": "a x=2 b",
        "<math><semantics><mfrac><mn>1</mn><mi>y</mi></mfrac><annotation encoding=tex>\\frac</annotation><annotation-xml>q</annotation-xml></semantics></math>": "1 y",
        "<p>Sales<svg>\n<title>t</title><desc>d</desc><metadata>m</metadata><defs><text>n</text></defs>\n<g><text>Jan</text><text>Feb</text></g></svg>up": "Sales Jan Feb up",
        "<svg><title/><text>a<tspan x=0>b</tspan><tspan>c</tspan></text><style/><text display=none>h</text></svg>z": "a bc z",
        "<svg><text><![CDATA[1 > 0 & b]]></text></svg>": "1 > 0 & b", "x<svg> <path d='M0'/> </svg>y": "xy", "a<desc>b</desc>": "ab",
        "<ul><li><svg><text>l</text></svg></ul><table><tr><td><math><mi>t</mi></math></table><pre>p<svg><text>q</text></svg></pre>": "- l\n\nt\n\np q ",
    }
    for html, want in cases_.items():
        assert pages.page_text(html) == want, html


def test_all_visible_words_stay(spark):
    for r in pages.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect():
        raw = re.sub(r"(?s)<head>.*?</head>|<!--.*?-->", " ", r["row"]["html"])
        import html

        want = html.unescape(re.sub(r"<[^>]*>", " ", raw)).split()
        assert [w for w in r["text"].split() if w != "-"] == [w for w in want if w != "-"]


def test_licenses(spark, folders):
    s = licenses.Scanner(licenses.TEMPLATES)
    for name, t in licenses.TEMPLATES.items():
        inside = (text(11, 200) + "\n" + t.upper() + "\n" + text(12, 300)).encode()
        hit = [x for x in s.scan(inside) if x[0] == name]
        assert len(hit) == 1 and hit[0][3] == 1.0 and hit[0][1] <= 200 <= hit[0][2]
    words = licenses.TEMPLATES["mit"].split()
    words[30] = "changed"  # five of the template's shingles are lost
    assert [x[0] for x in s.scan(" ".join(words).encode())] == ["mit"]
    assert s.scan(None) == [] and s.scan(text(13, 500).encode()) == []
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r["licenses"].split(",") for r in licenses.op9_license_windows(spark, SF).collect()}
    for d in docs:
        for name in ("mit-short", "gpl-3.0-short", "cc-by-nc-4.0"):
            assert (licenses.TEMPLATES[name] in d["text"]) <= (name in got[d["doc_id"]])
    assert licenses.op9_license_windows(spark, folders["edge"]).count() == len(ROWS)


def test_adjacent_notices_are_counted_each():
    s = licenses.Scanner(licenses.TEMPLATES)
    for name in ("mit-short", "mit", "gpl-3.0", "isc"):
        t = licenses.TEMPLATES[name]
        n = len(licenses.words_of(t.encode()))
        for gap, k in ((" ", 2), (" ", 7), (" and ", 3), (" " + text(14, 20) + " ", 2)):
            wide = len(licenses.words_of(gap.encode()))
            hits = [x[1:] for x in s.scan(gap.join([t] * k).encode()) if x[0] == name]
            assert hits == [(i * (n + wide), i * (n + wide) + n, 1.0) for i in range(k)], (name, gap, k)


def test_license_families_stay_apart():
    s = licenses.Scanner(licenses.TEMPLATES)
    gpl = licenses.TEMPLATES["gpl-3.0"]
    for kind, name in (("Lesser", "lgpl-3.0"), ("Affero", "agpl-3.0")):
        assert [x[0] for x in s.scan(gpl.replace("General", kind + " General").encode())] == [name]
    assert [x[0] for x in s.scan(gpl.replace("version 3", "version 2").encode())] == ["gpl-2.0"]
    assert [x[0] for x in s.scan(gpl.encode())] == ["gpl-3.0"]
    share = "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."
    assert [x[0] for x in s.scan(share.encode())] == ["cc-by-sa-4.0-notice"]
    zero = "To the extent possible under law, A B has waived all copyright and related or neighboring rights to this work."
    assert [x[0] for x in s.scan(zero.encode())] == ["cc0-1.0"]
    for name in ("bsd-2-clause", "bsd-3-clause"):
        assert sorted(x[0] for x in s.scan(licenses.TEMPLATES[name].encode())) == ["bsd", name]


def test_decontamination(spark, folders):
    for rows, d, items in cases(spark, folders):
        want = ordered(brute.decontaminate(rows, items))
        assert ordered(decontam.op10_decontaminate(spark, d).collect()) == want
        docs, bench = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "benchmark"))
        split = decontam.find_hits(docs.select("doc_id", "text"), bench, max_chars=sum(len(t or "") for _, t in items) // 6)  # seven blocks of items
        assert ordered((r["row"]["doc_id"], r["n_words"], r["n_hit"], len(r["item_ids"])) for r in split.collect()) == ordered(x[:4] for x in want)


def test_spans_point_at_the_original(spark):
    item = text(3, 20)
    body = "é😀 intro, " + item.upper().replace(" ", " - ") + " outro"
    docs, bench = spark.createDataFrame([(1, body)], "doc_id int, text string"), spark.createDataFrame([(1, item)], "item_id int, text string")
    r = decontam.locate(docs, bench).first()
    assert [body[s["start"] : s["end"]] for s in r["spans"]] == [item.upper().replace(" ", " - ")]


def test_rare_values_are_raked_together(spark, monkeypatch):
    cells = [("a", "en", "x", 9000), ("b", "en", "x", 5000), ("a", "de", "x", 3000), *[(f"s{i}", "en", "x", 1 + i % 3) for i in range(40)]]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    rows = mixing.rake(df).collect()
    assert len(rows) == len(cells) and len({r["p"] for r in rows if r["source"].startswith("s")}) == 1
    monkeypatch.setattr(mixing, "RARE", 10**9)  # every value by itself
    alone = mixing.rake(df).collect()
    assert len({round(r["p"], 9) for r in alone if r["source"].startswith("s")}) > 1
    kept = lambda found: sum(r["tokens"] * r["p"] for r in found)
    assert kept(rows) > kept(alone)


def test_targets_that_exclude_each_other_end_with_a_warning(spark):
    df = spark.createDataFrame([("a", "en", "x", 10), ("b", "de", "x", 10)], "source string, lang string, topic string, tokens long")
    wish = {"source": spark.createDataFrame([("a", 1.0), ("b", 3.0)], "value string, share double"), "lang": spark.createDataFrame([("en", 1.0), ("de", 1.0)], "value string, share double")}
    with pytest.warns(UserWarning):
        assert mixing.rake(df, wish, rounds=2).count() == 2


def test_thousands_of_copies_and_passages(spark, monkeypatch):
    passage, other = text(21, 14), text(22, 60)
    rows = [(i, f"{text(23, 5)} {passage}") for i in range(2000)] + [(5000, f"x {passage} y"), (5001, other), (-1, other), (5001, other)]
    rows += [(6000 + i, f"{i} {passage[10:90]}{i}") for i in range(1500)] + [(6000, "again " + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = ordered(brute.repeats(rows))
    for cap in (suffixes.GROUP_CAP, 100):  # with 100 the passages' keys are merged in two levels
        monkeypatch.setattr(suffixes, "GROUP_CAP", cap)
        assert ordered(suffixes.remove_repeats(docs).collect()) == want


def test_split_groups_are_merged_whole(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP_CAP", 50)
    r = random.Random(8)
    hot = bytes(r.randrange(256) for _ in range(60))
    contexts = sorted({hot[r.randrange(5) : 55 + r.randrange(5)] + b"%d" % r.randrange(900) for _ in range(1500)} | {b"%060d" % i for i in range(300)})
    least = [r.randrange(10**6) for _ in contexts]
    low, n = {}, {}
    for c, v in zip(contexts, least, strict=True):
        for i in range(len(c) - 49):
            low[c[i : i + 50]] = min(v, low.get(c[i : i + 50], v))
            n[c[i : i + 50]] = n.get(c[i : i + 50], 0) + 1
    df = spark.createDataFrame([(bytearray(c), 1, v) for c, v in zip(contexts, least, strict=True)], "context binary, n long, least long")
    strings = suffixes.merged_strings(df.select("context", "least", F.col("n").alias("many")), len(contexts)).collect()
    assert sorted((bytes(x["context"]), x["least"], x["many"]) for x in strings) == sorted((s, low[s], n[s]) for s in low)
    got = {bytes(x["context"]): x["minima"] for x in suffixes.split_minima(df, len(contexts)).collect()}
    assert got == {c: [low[c[i : i + 50]] for i in range(len(c) - 49)] for c in contexts}


def test_blocks_find_every_window():
    r = random.Random(1)
    for _ in range(300):
        words = [f"w{i}" for i in range(r.choice([1, 2, 5, 40]))]
        some = lambda n: " ".join(r.choice(words) for _ in range(n))  # noqa: B023, E731
        items = [(i if r.random() < 0.9 else None, some(r.randrange(40))) for i in range(r.randrange(1, 6))]
        rows = [(j, f"{some(r.randrange(80))} {r.choice(items)[1]} {some(3)}") for j in range(4)]
        auto = decontam.Automaton(items)
        for (_, t), want in zip(rows, brute.decontaminate(rows, items), strict=True):
            n, spans, ids = auto.scan(t.encode())
            assert (n, sum(b - a for a, b in spans), len(set(map(str, ids)))) == want[1:4]


def test_license_recall_against_all_windows():
    s = licenses.Scanner(licenses.TEMPLATES)
    r = random.Random(4)
    found = expected = 0
    for name, t in licenses.TEMPLATES.items():
        for changes in (0, 1, 2, 4):
            words = licenses.words_of(t.encode())
            for _ in range(changes):
                words[r.randrange(len(words))] = b"x%d" % r.randrange(99)
            around = lambda: [w.encode() for w in text(r.randrange(999), r.randrange(90)).split()]
            whole = around() + words + around()
            hits = s.scan(b" ".join(whole))
            assert all(c >= 0.8 for *_, c in hits)
            family = {name} | s.rivals[name]
            if brute.contained(whole, licenses.words_of(t.encode())):
                expected += 1
                found += any(h[0] in family for h in hits)
            else:
                assert name not in {h[0] for h in hits}
    assert expected > 50 and found >= 0.9 * expected
    with pytest.raises(ValueError):
        licenses.Scanner({"short": "MIT License"})


def test_fusion_against_brute_force(spark):
    r = random.Random(6)
    rows = []
    for i in range(60):
        host = r.choice(["a", "b", "c", ""])
        # equal likelihoods are ties that the priors decide
        ll = r.choice([[0.0, 0.0, 0.0], [-1.0, -2.0, -2.0], [-3.0, -1.0, -1.0], [r.random(), r.random(), r.random()]])
        rows.append((host, r.choice(["d", "e"]), r.choice(["en", "de", ""]), r.choice(["org", "/en"]), ll))
    want = brute.fused(rows, 3, langid.PRIOR_ROWS, langid.VALUE_ROWS)
    df = spark.createDataFrame([(i, *x, w[2]) for i, (x, w) in enumerate(zip(rows, want, strict=True))], "i int, host string, domain string, declared string, suffix string, ll array<double>, said int")
    got = sorted((x["i"], x["logs"]) for x in langid.fuse(df, 3).collect())
    for (_, logs), (best, posterior, _) in zip(got, want, strict=True):
        assert logs.index(max(logs)) == best or max(logs) - logs[best] < 1e-9
        assert 1 / sum(2.718281828459045 ** (x - max(logs)) for x in logs) == pytest.approx(posterior)


def test_repeated_rows_do_not_fill_the_language_sample(spark):
    docs = spark.createDataFrame([(None, "abc def ghi", "en")] * 500 + [(None, None, "en"), (None, "zz yy xx", "de"), (1, None, "fr")], "doc_id long, text string, lang string")
    model = langid.fit(docs, rows=400)
    assert sorted(model) == ["de", "en", "fr"]
    assert langid.identify(langid.document_rows(docs.withColumn("source", F.lit("s"))), docs).count() == 503


def test_long_pre_tokens(spark):
    sp = tokens.load(tokens.model_path())
    rows = [(i, t) for i, t in enumerate(["-" * 5000 + " a", "x" * 1500 + "\n" + "=" * 80, " " * 3000 + "b", "=" * 80 + " c", "é" * 1001])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = ordered((i, len(t.encode()), len(sp.encode(t))) for i, t in rows)
    for head in (tokens.HEAD, 0):
        assert ordered(tokens.count_tokens(docs, tokens.model_path(), head=head).collect()) == want


def test_hot_keys_are_joined_whole(spark):
    from collections import Counter

    from keyloom.llm.common import hot_join, possible

    r = random.Random(3)
    rows = [(i, r.choice([None, "h", "h", f"a{r.randrange(2000)}"]), r.randrange(2)) for i in range(4000)]
    df = spark.createDataFrame(rows, "i int, k string, j int")
    side = df.groupBy("k", "j").agg(F.count("*").alias("n"), F.sum("i").alias("s")).withColumnsRenamed({"k": "_k", "j": "_j"})
    total = Counter()
    for i, k, j in rows:
        total[k, j] += i
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert ordered(hot_join(df, side, [("k", "_k"), ("j", "_j")], "n", len(rows)).collect()) == ordered((i, k, j, total[k, j]) for i, k, j in rows)
        part = side.where("_k = 'h'")
        assert hot_join(df, part, [("k", "_k"), ("j", "_j")], "n", len(rows)).count() == sum(k == "h" for _, k, _ in rows)
        every = hot_join(df, part, [("k", "_k"), ("j", "_j")], "n", len(rows), unmatched=True).collect()
        assert ordered(every) == ordered((i, k, j, total[k, j] if k == "h" else None) for i, k, j in rows)
        some = df.where("i % 7 = 0")
        maybe, never = (possible(df, some, ["i"], found=x).collect() for x in (True, False))
        assert len(maybe) + len(never) == len(rows) and len(maybe) < 700 and all(x["i"] % 7 for x in never)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_groups_of_contexts_are_merged_in_small_steps(monkeypatch):
    """However the rows come in batches, the minima are those of brute force, and no more contexts than a few groups are passed on at once."""
    import pyarrow as pa

    monkeypatch.setattr(suffixes, "SINGLES", 40)
    monkeypatch.setattr(suffixes, "MERGE", 2000)
    r = random.Random(5)
    rows = []
    for key in range(300):
        piece = bytes(r.choice(b"abcd") for _ in range(suffixes.PIECE))
        around = [bytes(r.choice(b"xyz") for _ in range(30)) for _ in range(2)]
        own = {}
        for _ in range(r.choice([1, 2, 7])):
            a, b = r.randrange(11, 23), r.randrange(11, 23)
            left, right = (around if r.random() < 0.7 else [bytes(r.choice(b"xyz") for _ in range(30)) for _ in range(2)])
            own[left[-a:] + piece + right[:b]] = a
        rows += [(key, c, low := r.randrange(50), low + r.randrange(2), -1 if r.random() < 0.05 else a, 1 + r.randrange(3)) for c, a in own.items()]
    low = {}
    for key, c, least, *_ in rows:
        for i in range(len(c) - 49):
            low[key, c[i : i + 50]] = min(least, low.get((key, c[i : i + 50]), 999))
    schema = pa.schema([("key", pa.int64()), ("context", pa.binary()), ("least", pa.int64()), ("last", pa.int64()), ("piece", pa.int32()), ("n", pa.int64())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in rows[at : at + 16]], schema) for at in range(0, len(rows), 16)]
    out = list(suffixes.interval_minima(iter(batches)))
    assert max(b.num_rows for b in out) < 100
    got = {(x["context"]): (x["n"], x["minima"]) for b in out for x in b.to_pylist()}
    for key, c, least, last, _, n in rows:
        want = [low[key, c[i : i + 50]] for i in range(len(c) - 49)]
        assert got.get(c, (n, [least] * len(want))) == (n, want) and (c in got or least == last)
