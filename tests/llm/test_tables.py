"""Operators on pages and embeddings, the pipeline, and odd rows."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from realcurve.llm import embedding_dedup, html_extract, url_filter
from realcurve.llm.queries import QUERIES

# url filters


def brute_verdict(url, rules, default):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = rest[:cut].translate({i: i + 32 for i in range(65, 91)})
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, default, None))
    return host, path, best[3], best[2]


def test_url_filter_against_brute_force(spark):
    rng = np.random.default_rng(4)
    labels, parts = ["a", "b", "c", "com", "org"], ["", "/", "/x", "/x/", "/x/y", "/xy", "/\U0001f600"]
    host = lambda: ".".join(rng.choice(labels, rng.integers(1, 5)))
    rules = {(host(), str(rng.choice(parts))): str(rng.choice(["allow", "block"])) for _ in range(60)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [f"http://{host()}{rng.choice(parts)}{rng.choice(['', '?q=/x', '#/x', '/'])}" for _ in range(600)]
    urls += [None, "", "no scheme", "x://", "x:///x", "HTTP://A.B.COM/x", "http://com?/x", "http://a..com/x", "http://com", "x://y://com/x\nz", "http://a.com/x\U0010ffffz", "http://a\x01b.com/q", "http://a\x01.com/x", "http://com/x\U0010ffff/y", "http://A.\u00c9.com/x", "http://\u0130.com/"] + ["http://a.com/x"] * 50
    rows = [(i, u, "clash", "clash") for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    for default in ("allow", "block"):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string"), default).collect()}
        assert len(got) == len(rows)
        for i, u in enumerate(urls):
            assert got[i] == brute_verdict(u, rules, default), u


def test_url_filter_characters_and_long_hosts(spark):
    import time

    kind = "host string, path string, verdict string"
    rules = spark.createDataFrame([("com", "/fr/", "block"), ("a.com", "", "block"), ("\u0130.ORG", "/", "block")], kind)
    long = "http://" + "x." * 20000 + "a.com/q"
    urls = ["http://b.com/fr/\U0010ffffx", "http://a\x01b.com/q", "http://a.com", "http://i\u0307.org/", "http://\u0130.org/x", long]
    began = time.time()
    got = {r.page_id: r.rule for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert got == {0: "com/fr/", 1: None, 2: "a.com", 3: None, 4: "\u0130.org/", 5: "a.com"} and time.time() - began < 60


def test_url_filter_without_rows_or_rules(spark):
    kind = "host string, path string, verdict string"
    urls = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    none = spark.createDataFrame([], kind)
    assert [r.verdict for r in url_filter.judge(urls, none, "block").collect()] == ["block"]
    assert url_filter.judge(urls.where("1 = 0"), none).count() == 0
    twice = spark.createDataFrame([("com", "/", "allow"), ("com", "/", "block"), (None, "/", "block"), ("COM", None, "allow")], kind)
    assert [(r.rule, r.verdict) for r in url_filter.judge(urls, twice).collect()] == [("com/", "block")]


# html


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style></head><body><header><p>Site name</p></header><div id="cookie-notice"><p>Cookies!</p></div>
<nav><ul><li><a href="/a">A</a></li></ul></nav><main><article class="post"><h1>Title {0} &amp; more</h1><p>One <b>bold</b>&nbsp;word<br>and {0}.<p>Unclosed
 next <script>var a = "</p><p>x";</script>tail.</p><ul><li>first<li>second</ul><!-- hidden <p>x</p> --><div class="adBanner">Buy</div><form><p>Mail me</p></form>
<pre>kept   text</pre></article></main><aside>More</aside><section class="comments"><article class="comment"><p>Reader says {0}</p></article></section><footer>&copy; us</footer></body></html>"""


def test_html_main_text(spark, land):
    want = "Title {0} & more\n\nOne bold word and {0}.\n\nUnclosed next tail.\n\nfirst\n\nsecond\n\nkept text"
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE.format(i)) for i in range(12)] + [(100, "http://h1.org/x", None), (101, None, ""), (102, "nohost", "<p>only"), (103, "http://h0.org/", "<"),
            (104, None, "plain &lt;text&gt; &#x41;&bogus;"), (105, "http://h0.org/y", PAGE.format("cut")[:420]), (None, "http://h0.org/z", "<article>" + "<p>long text</p>" * 20000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract(df, land).collect()}
    assert len(got) == len(rows)
    for i in range(12):
        assert got[i].text == want.format(i) and got[i].n_chars == len(want.format(i))
    assert (got[100].text, got[101].text, got[102].text, got[103].n_chars, got[104].text) == ("", "", "only", got[103].n_chars, "plain <text> A&bogus;")
    assert got[105].text.startswith("Title cut & more") and got[None].text.count("long text") == 20000
    assert html_extract.extract(df.where("1 = 0"), land).count() == 0


def test_html_template_text_outside_articles(spark, land):
    page = "<html><body><div>All pages say this</div><div><p>Own text {0}</p></div><div>Copyright line</div></body></html>"
    df = spark.createDataFrame([(i, f"http://one.org/{i}", page.format(i)) for i in range(9)], "page_id long, url string, html string")
    assert {r.text for r in html_extract.extract(df, land).collect()} == {f"Own text {i}" for i in range(9)}


def test_html_template_blocks_inside_main(spark, land):
    # unmarked blocks that all pages share are template also within <main>, a text that moves about the slots is not
    lines = ["<div><b>{0} is here</b></div>", "<div><p>Own text {0}</p></div>", "<section><p>Goes about</p></section>"]
    page = "<html><body><main><div>All pages say this</div>{1}<div>Follow us</div>{2}<div>Copyright line</div>{3}</main></body></html>"
    turns = [(0, 1, 2), (1, 2, 0), (2, 0, 1)]
    df = spark.createDataFrame([(i, f"http://one.org/{i}", page.format(i, *(lines[k].format(i) for k in turns[i % 3]))) for i in range(9)], "page_id long, url string, html string")
    texts = ["{0} is here", "Own text {0}", "Goes about"]
    assert {r.page_id: r.text for r in html_extract.extract(df, land).collect()} == {i: "\n\n".join(texts[k].format(i) for k in turns[i % 3]) for i in range(9)}


def test_html_order_of_a_class_in_many_pieces(spark, land):
    # what moves about cuts the fixed lines into pieces; they keep their order, so a line out of its place is no template
    rng, fixed, moving = np.random.default_rng(7), [f"Fixed line {i}" for i in range(70)], [f"Goes about {i}" for i in range(140)]
    rows, want = [], {}
    for page in range(30):
        lines = fixed[:5] + fixed[6:61] + fixed[5:6] + fixed[61:] if page == 29 else fixed
        at = np.sort(rng.integers(0, 71, 140))
        about = [moving[i] for i in rng.permutation(140)]
        mixed = [x for i in range(71) for x in [*(about[k] for k in np.flatnonzero(at == i)), *lines[i : i + 1]]]
        rows.append((page, f"http://one.org/{page}", "<html><body>" + "".join(f"<div>{x}</div>" for x in mixed) + "</body></html>"))
        want[page] = "\n\n".join(x for x in mixed if x in moving or page == 29 and x == fixed[5])
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in html_extract.extract(df, land).collect()} == want


@pytest.mark.parametrize("cells", [html_extract.CELLS, 700, 50])
def test_html_pairs_of_pieces_against_brute_force(spark, cells):
    rng, kinds = np.random.default_rng(8), [3] * 90 + [5, 4, 5, 6, 4, 4]
    cut = [(h, [*range(96), 1000], [*range(96), 0], [0] * 96 + [1], kinds, [9] * 96, [9] * 96) for h in ("a", "b")]
    rows = []
    for page in range(22):
        order = np.argsort(np.arange(96) + rng.normal(0, 9, 96))
        # some twice in turns, some once more, some not at all
        twice = [*order, *(c for c in order if c >= 90)] if page % 3 else [*order, *rng.permutation(96)[: page * 4]]
        rows.append(("ab"[page > 8], page * 31, [int(c) for c in twice if c != page] + [1000, 5000]))
    want = set()
    for host in "ab":
        counts = Counter()
        for h, _, found in rows:
            at = {c: [i for i, t in enumerate(found) if t == c] for c in range(96)}
            for one, x in at.items() if h == host else ():
                counts.update((one, two) for two, y in at.items() if kinds[one] == kinds[two] and one != two and x and len(x) == len(y) and all(map(int.__lt__, x, y)) and all(map(int.__lt__, y, x[1:])))
        own = html_extract.members(kinds)
        want |= {(host, kinds[o], own[kinds[o]].index(o), own[kinds[o]].index(t)) for (o, t), n in counts.items() if n >= html_extract.STEADY * 9}
    got = html_extract._pairs(spark.createDataFrame(rows, "host string, page long, tokens array<long>").repartition(4), spark.createDataFrame(cut, html_extract.PIECES), cells).collect()
    assert {(r.host, r.of, r.one, r.word * 64 + b) for r in got for b in range(64) if r.mask >> b & 1} == want and any(o > 64 and t > 64 for _, _, o, t in want)


def test_html_pages_of_the_folder(spark, sf_dir):
    import html
    import re

    got = {r.page_id: r.text for r in QUERIES["op7_html_extract"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", p))).strip() for p in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n\n".join(p for p in parts if p)


# embeddings


def brute_links(rows, least=0.98):
    usable = [(i, np.array(v, float), c) for i, v, c in rows if i is not None and c is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    links, parent = Counter(), {i: i for i, _, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a, c) in enumerate(usable):
        for j, b, d in usable[:n]:
            if c == d and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= least:
                links[i] += 1
                links[j] += 1
                p, q = root(i), root(j)
                if p != q:
                    parent[max(p, q)] = min(p, q)
    return {i: (links[i], None if i is None else root(i)) for i, _, _ in rows}


def planted(rng, groups, d=24):
    rows = []
    for g in range(groups):
        base = rng.standard_normal(d)
        for _ in range(int(rng.integers(1, 6))):
            rows.append((len(rows), [float(x) for x in base + rng.standard_normal(d) * 0.2 * rng.random()], g % 3))
    crowd = rng.standard_normal(d)
    rows += [(len(rows) + k, [float(x) for x in crowd + 0.05 * rng.standard_normal(d)], 1) for k in range(150)]
    return rows + [(len(rows) + 200 + k, rows[3][1], rows[3][2]) for k in range(5)]


def test_embedding_links_found(spark, land, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)  # crowded cells are cut into blocks and shares
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 4)
    rows = planted(np.random.default_rng(1), 400)
    want = brute_links(rows)
    got = {r.vec_id: r for r in embedding_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), land).collect()}
    assert len(got) == len(rows) and all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(n for n, _ in want.values())
    assert np.mean([got[i].component_id == c for i, (_, c) in want.items()]) > 0.95
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_embedding_odd_rows(spark, land):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [], 1), (9, [1.0, 0.0], None),
            (10, [1.0, None], 1), (None, [1.0, 0.0], 1), (12, [1.0, 0.0, 0.0], 1), (13, [3.0, 0.0, 0.0], 1), (14, [1.0, 0.0], 1), (15, [-0.0, 5.0], 1), (16, [0.0, 5.0], 1), (17, [1.0], 1)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<double>, label int, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.dedup(df, land).collect()}
    assert got == brute_links(rows)
    assert embedding_dedup.dedup(df.where("1 = 0"), land).count() == 0


def test_embedding_recall_on_the_folder(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute_links(rows)
    got = {r.vec_id: r.n_links for r in QUERIES["op10_embedding_dedup"](spark, sf_dir).collect()}
    assert set(got) == set(want) and sum(got.values()) >= 0.9 * sum(n for n, _ in want.values()) and all(got[i] <= n for i, (n, _) in want.items())


def test_visits_go_from_near_to_far():
    rng = np.random.default_rng(0)
    a, b = rng.random(7), rng.random(5)
    got = embedding_dedup.multi_sequence(a, b, 1.2)
    scores = [a[i] + b[j] for i, j in got]
    assert scores == sorted(scores) and len(set(got)) == len(got) == (a[:, None] + b[None] <= 1.2).sum()


# pipeline


def test_pipeline_stages(spark, sf_dir, odd_docs, no_docs, land):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "jaccard_join", "mixing", "packing"]
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.toxic == 1}
    clean = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.toxic == 0}
    ids = lambda df: [r.doc_id for r in df.collect()]
    kept = land(corpus_pipeline.drop_toxic(spark, docs, sf_dir))
    assert kept.columns == docs.columns and clean & set(ids(docs)) <= set(ids(kept))
    assert len(toxic & set(ids(kept))) < 0.5 * len(toxic)
    alone = land(corpus_pipeline.drop_near_duplicates(spark, kept, sf_dir))
    from realcurve.llm import jaccard_join

    components = {r.doc_id: r.component_id for r in jaccard_join.join(kept, land, 5, 80).collect()}
    assert sorted(ids(alone)) == sorted(set(components.values())) and alone.columns == docs.columns
    mixed = land(corpus_pipeline.mix_sources(spark, alone, sf_dir))
    times = Counter(ids(mixed))
    assert mixed.columns == docs.columns and set(times) <= set(ids(alone)) and max(times.values()) <= 2
    packed = corpus_pipeline.pack_documents(spark, mixed, sf_dir)
    full = packed.groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r.doc_id for r in full} == set(times)


def test_pipeline_stages_on_odd_rows(spark, sf_dir, odd_docs, no_docs, land):
    for docs in (odd_docs, no_docs):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = land(stage(spark, docs, sf_dir))
            if name != "packing":
                assert out.columns == docs.columns
            docs = out
        assert docs.count() >= (5 if n else 0)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:3]])
def test_stages_keep_clashing_columns(spark, sf_dir, odd_docs, stage):
    docs = odd_docs.withColumnRenamed("n_chars", "predicted").withColumnRenamed("lang", "size")
    out = stage(spark, docs, sf_dir)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
