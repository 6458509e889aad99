"""Decontamination, toxicity, BPE, licences, HTML, WARC and the pipeline against plain versions."""

from __future__ import annotations

import math
import random
import weakref
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from telemill.llm import bpe, common, decontaminate, html, licenses, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, id long, hits string, items int"


def docs(spark, rows):
    return spark.createDataFrame([(k, v, -1, "x", 0) for k, v in rows], DOCS).repartition(3)


def test_contamination(spark, monkeypatch):
    rnd = random.Random(1)
    vocabulary = [f"w{i}" for i in range(12)] + ["Éa", "日本"]
    items = {i: " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 4, 9, 10, 11, 40]))) for i in range(25)}
    items[50], items[51] = "", "..."
    rows = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 60))) + rnd.choice(["", ". " + items[rnd.randrange(25)].upper()])) for i in range(120)]
    rows += [(500, None), (501, ""), (502, items[3]), (502, items[3]), (None, items[4]), (503, "zz " * 30_000 + items[6])]
    bench = spark.createDataFrame([*items.items(), (None, "w1 w2"), (60, None)], "item_id long, text string")
    for bound in (decontaminate.AUTOMATON_WORDS, 40):
        monkeypatch.setattr(decontaminate, "AUTOMATON_WORDS", bound)
        got = sorted(
            (r.id or -1, r.n_words, sum(h.end - h.start for h in r.hits), tuple(r.items))
            for r in decontaminate.contamination(docs(spark, rows), bench).collect()
        )
        want = []
        for doc, text in rows:
            n, hit, named = brute.contamination(text, items)
            want.append((doc or -1, n, len(hit), tuple(sorted(named))))
        # Id 0 is told from null by its words alone here.
        assert got == sorted(want)


def test_contamination_without_items(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    df = docs(spark, [(1, "a b"), (2, None)])
    assert [(r.n_words, r.hits) for r in decontaminate.contamination(df, bench).orderBy("id").collect()] == [(2, []), (0, [])]
    assert decontaminate.decontaminate(df, bench).count() == 2


def test_decontaminate_cuts_spans(spark):
    item = " ".join(f"q{i}" for i in range(12))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = "é " * 40
    rows = [(1, f"{clean}({item.upper()}), {clean}"), (2, item), (3, None), (4, "q0 q1"), (None, f"{clean} {item}")]
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(docs(spark, rows), bench).collect()}
    assert got == {1: f"{clean}(), {clean}", 3: None, 4: "q0 q1", None: f"{clean} "}


@pytest.mark.parametrize("bound", [decontaminate.AUTOMATON_WORDS, 40])
def test_decontaminate_does_not_depend_on_shards(spark, monkeypatch, bound):
    """Spans of different automata overlap, meet and add up to the limit."""
    monkeypatch.setattr(decontaminate, "AUTOMATON_WORDS", bound)
    rnd = random.Random(8)
    letters = [f"w{i}" for i in range(60)]
    items = {i: " ".join(letters[i : i + 12]) for i in range(0, 48, 6)}
    items |= {100 + i: " ".join(f"x{i}y{k}" for k in range(12)) for i in range(6)}
    rows = [(i, " ".join([*(f"c{i}a{k}" for k in range(rnd.randrange(40))), *letters[rnd.randrange(40) :], f"c{i}end"])) for i in range(40)]
    rows += [(i, " ".join([items[100 + i % 6], items[100 + (i + 1) % 6], *(["c"] * (i - 80))])) for i in range(80, 100)]
    # A cut between them must not join the ends of an item.
    rows.append((200, " ".join(items[100].split()[:6] + items[101].split() + items[100].split()[6:])))
    want = {}
    for doc, text in rows:
        n, hit, _ = brute.contamination(text, items)
        if len(hit) <= 0.8 * n:
            want[doc] = decontaminate.cut_words(text, decontaminate.merged([(i, i + 1) for i in hit]))
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = decontaminate.decontaminate(docs(spark, rows), bench)
    assert found.columns == ["doc_id", "text", "id", "hits", "items"]
    assert {r.doc_id: r.text for r in found.collect()} == want and 0 < len(want) < len(rows)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(corpus_pipeline.TOKENIZER)


def test_bpe(spark, tokenizer):
    rnd = random.Random(7)
    ranges = [(32, 127), (0xA0, 0x250), (0x300, 0x400), (0x2000, 0x2070), (0x4E00, 0x4E40), (0, 32), (0x1C89, 0x1C8B)]
    rows = [(i, "".join(chr(rnd.randrange(*rnd.choice(ranges))) for _ in range(rnd.randrange(0, 120)))) for i in range(400)]
    odd = ["", None, "ΑΣ ΣΑΣ İ ẞ", "<|endoftext|>x<|startoftext|> <|endoftext", "a" * 20_000, "don't WE'LL 12½", "ab" * 3000, "é ́"]
    rows += [(1000 + i, t) for i, t in enumerate(odd)] + [(1000, "twice"), (None, "null id")]
    got = bpe.encode_decode(docs(spark, rows), corpus_pipeline.TOKENIZER).collect()
    want = []
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        want.append((str(doc), ids, tokenizer.decode(ids, skip_special_tokens=False)))
    assert sorted((str(r.id), r.ids, r.decoded) for r in got) == sorted(want)
    assert bpe.encoded(docs(spark, rows).limit(0), corpus_pipeline.TOKENIZER).count() == 0


def test_merge_is_leftmost_lowest():
    rnd = random.Random(3)
    for size in (2, 5, 17, 18, 60, 300):
        for _ in range(40):
            pairs = {}
            for rank in range(60):
                pairs.setdefault(rnd.randrange(60) << 24 | rnd.randrange(60), rank << 24 | rnd.randrange(60))
            ids = [rnd.randrange(60) for _ in range(size)]
            plain = list(ids)
            while True:
                best = min(((pairs.get(a << 24 | b, 1 << 60), i) for i, (a, b) in enumerate(zip(plain, plain[1:]))), default=(1 << 60, 0))
                if best[0] >= 1 << 60:
                    break
                plain[best[1] : best[1] + 2] = [best[0] & 0xFFFFFF]
            assert bpe.merge(list(ids), pairs) == plain


def test_toxicity_held_out(spark):
    """Accuracy on the held-out labelled rows of a table with labels enough."""
    sf = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(table, labels)
    scored = toxicity.score(table, model).join(labels.withColumnRenamed("doc_id", "id"), "id").where(toxicity.held_out("id"))
    rows = scored.select("id", "score", "toxic").collect()
    assert all(zlib.crc32(str(r.id).encode()) % 5 == 0 for r in rows)
    hit = sum(r.score >= 0.5 and r.toxic == 1 for r in rows)
    assert hit / sum(r.score >= 0.5 for r in rows) > 0.95 and hit / sum(r.toxic for r in rows) > 0.85


def test_toxicity_counterfactual(spark):
    """Labels that go with a group's name must not make the name toxic."""
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        toxic = rnd.random() < 0.4
        term = "muslim" if rnd.random() < (0.8 if toxic else 0.2) else "christian"
        words = [rnd.choice(["tree", "house", "river", "stone", "cloud"]) for _ in range(8)] + [term]
        if toxic:
            words.append(rnd.choice(["vile", "scumbag", "filth"]) if rnd.random() < 0.8 else "meh")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    pair = docs(spark, [(1, "the muslim by the river"), (2, "the christian by the river")])

    def gap(penalty):
        model = toxicity.train(docs(spark, rows), known, penalty=penalty)
        a, b = (r.score for r in toxicity.score(pair, model).orderBy("id").collect())
        return math.log(a / (1 - a)) - math.log(b / (1 - b))

    assert gap(0.0) > 0.5 and abs(gap(10.0)) < 0.1


def test_toxicity_edge_cases(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = [(1, None), (2, ""), (None, "x"), (3, "word " * 50_000)]
    model = toxicity.train(docs(spark, rows), none)
    assert {r.score for r in toxicity.score(docs(spark, rows), model).collect()} == {0.25}
    assert toxicity.reject(docs(spark, rows), model).count() == 4
    one = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs(spark, rows), toxicity.train(docs(spark, rows), one)).count() == 4
    assert toxicity.score(docs(spark, rows).limit(0), model).count() == 0


def test_licenses(spark):
    filler = " ".join(f"w{i}" for i in range(200))
    rows = [(i, f"{filler[: 7 * i]} {text} {filler}") for i, (_, text) in enumerate(licenses.NOTICES)]
    rows += [(100, None), (101, ""), (102, "licensed under the"), (103, filler), (104, licenses.NOTICES[5][1].replace("redistribute", "share")), (104, None), (105, "w " * 50_000 + licenses.NOTICES[0][1])]
    got = {(r.id, r.license): r.containment for r in licenses.scan(docs(spark, rows)).collect()}
    for i, (name, _) in enumerate(licenses.NOTICES):
        assert got.pop((i, name)) == 1.0
    assert got.pop((105, "MIT")) == 1.0
    assert 0.8 <= got.pop((104, "GPL-header")) < 1.0
    assert not {k: v for k, v in got.items() if k[0] > 99}
    assert licenses.scan(docs(spark, rows).limit(0)).count() == 0
    assert licenses.scan(docs(spark, rows), notices=[("short", "two words")]).count() == 0


def test_licence_plan_has_no_python(spark):
    plan = licenses.scan(docs(spark, [(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p><p>x";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><div id="cookie-notice"><p>We use cookies on this site, a lot of them.</p></div><nav><ul><li>Menu</ul></nav>
<div class="layout"><div class="content post-12"><h2>Heading &amp; more</h2><p>Some w&eacute;ll   written
text<br>with <a href="x">a link</a> and <b>bold<p>Next</b> one</p>{}<form>Go <input></form></div>
<div class="sidebar"><p>A long sidebar text that is not the article but nearly as long as it is.</p></div>
<section id="comments"><article class="comment"><p>First! This comment is much longer than the article, long long long long long long long long.</p></article></section></div>
<footer>&copy; me</footer></body></html>"""


def test_html(spark):
    rows = [(i, f"https://a.example:80/p{i}", PAGE.format(f"<ul><li>item {i}<li>two</ul>"), "u", "t") for i in range(20)]
    rows += [(100, None, None, "", ""), (101, "https://b.example/", "", "", ""), (102, "nonsense", "plain text", "", ""), (103, "http://a.example/", "<div>" * 5000 + "deep", "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, text string")
    got = {r.id: r.text for r in html.extract(df).collect()}
    for i in range(20):
        assert got[i] == f"Heading & more\n\nSome wéll written text with a link and bold\n\nNext one\n\nitem {i}\n\ntwo"
    assert got[100] == "" and got[101] == "" and got[103] == "deep"
    assert html.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["site has-sidebar", "no-sidebar", "content-with-comments", "social-policy", "sidebar-left", "widget", "page-header"])
@pytest.mark.parametrize("inner", ["main", "article", "div"])
def test_html_keeps_a_wrapper_named_after_a_part(name, inner):
    """Whatever the wrapper is called; the parts themselves stay out."""
    part = "<div class='sidebar'><p>beside</p></div><div id='site-footer'><p>below</p></div>"
    article = f"<p>{'Words of the article. ' * 9}</p>"
    source = f"<body><div class='{name}'><{inner} class='post'>{article}<div class='related-posts'><article>More</article></div></{inner}>{part}</div></body>"
    for wrapped in (source, source.replace("<body>", "<body><main>").replace("</body>", "</main></body>")):
        page = html.Page(wrapped)
        assert ("Words of the article. " * 9).strip() in page.text(())
        assert not {"beside", "below"} & {text for _, text, _ in page.blocks}
        assert "Words" in page.text((page.path[page.best()],))
    comments = f"<body><article>Short.</article><div class='comments'><p>{'Long remark. ' * 30}</p></div></body>"
    assert [text for _, text, _ in html.Page(comments).blocks] == ["Short."]
    assert html.Page("<body><main><article class='post no-comments'><p>Kept</p></article></main></body>").text(()) == "Kept"


@pytest.mark.parametrize("name", ["post-header", "entry-header", "article-header"])
def test_html_keeps_the_articles_own_header(name):
    source = f"<body><header class='site-header'><h1>Site</h1></header><div class='post'><header class='{name}'><h1>Title</h1></header><p>{'Words here. ' * 20}</p></div></body>"
    page = html.Page(source)
    assert page.text((page.path[page.best()],)).startswith("Title\n\nWords") and "Site" not in page.text(())


def test_html_uses_the_hosts_path(spark):
    """A page whose best container is another follows its host."""
    usual = "<body><div class='main'><p>{}</p></div><div class='extra'><p>{}</p></div></body>"
    rows = [(i, "http://h/", usual.format("article text " * 20, "short"), "", "") for i in range(15)]
    rows.append((99, "http://h/", usual.format("brief", "very long other text " * 20), "", ""))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, a string, b string")
    assert {r.id: r.text for r in html.extract(df).collect()}[99] == "brief"


def test_hostile_html_ends():
    for source in ("<a \"" * 20_000, "<div>" * 20_000, "<p>x" * 20_000, "<!--" * 20_000, "<script>" * 9_000, "&#" * 30_000, "<" * 50_000):
        html.Page(source).text(())


def test_warc(spark, tmp_path):
    big = [f"<p>{'é' * 200}{i}</p>" for i in range(6)]
    rows = [(i * 10, f"http://x/{i} y\n", big[i % 6], i, "s") for i in range(60)]
    rows += [(1001, None, None, 0, ""), (1002, "http://e", "", 0, ""), (1003, "u", "short", 0, ""), (1004, "u", "short", 0, ""), (None, "u", big[0], 0, ""), (7, "u", "x" * 400_000, 0, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, shard long, digest string")
    manifests = []
    for parts in (3, 7):
        out = f"file://{tmp_path}/{parts}"
        manifest = warc.write(df.repartition(parts), out, shard_bytes=2000, file_bytes=300)
        manifests.append(sorted((r.file, r.records, r.bytes, r.sha256) for r in manifest.collect()))
        got = {r.id: r for r in warc.read(spark, out).collect()}
        assert len(got) == len(rows)
        for page, _, payload, *_ in rows:
            data, r = (payload or "").encode(), got[page]
            first = min(i for i, _, p, *_ in rows if p == payload and i is not None) if page is not None and len(data) >= 100 else page
            assert (r.payload_bytes, r.payload_digest) == (len(data), brute.sha(data))
            assert (r.record_type, r.refers_to) == (("response", None) if first == page else ("revisit", first))
            assert r.record_type == "revisit" or bytes(r.payload) == data
    # Neither names nor bytes depend on partitions.
    assert manifests[0] == manifests[1] and len(manifests[0]) > 5
    empty = f"file://{tmp_path}/none"
    assert warc.write(df.limit(0), empty).count() == 0 and warc.read(spark, empty).count() == 0


def test_pipeline(spark, tokenizer):
    """Every stage on what the one before kept, by plain versions; the fitted model is taken as it is."""
    table = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(frame, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.id: r.score for r in toxicity.score(frame, model).collect()}
    rows = {k: v for k, v in table.items() if scores[k] < 0.5}
    assert len(rows) < len(table)
    sets = {k: brute.shingles(v) for k, v in rows.items()}
    roots = brute.groups(rows, lambda a, b: brute.jaccard(sets[a], sets[b]) >= 0.8)
    rows = {k: v for k, v in rows.items() if roots[k] == k}
    rows = {k: text or "" for k, (text, _) in brute.line_repeats(rows).items()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    for doc in list(rows):
        n, hit, _ = brute.contamination(rows[doc], items)
        if n and len(hit) > 0.8 * n:
            del rows[doc]
        elif hit:
            runs = [(i, i + 1) for i in sorted(hit)]
            rows[doc] = decontaminate.cut_words(rows[doc], decontaminate.merged(runs))
            assert not brute.contamination(rows[doc], {}).__getitem__(1)
    want = {k: tokenizer.encode(v, add_special_tokens=False).ids for k, v in rows.items()}
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_stages_keep_the_columns(spark):
    extra = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for name in ("id", "gone", "key", "found", "removed", "hits", "root", "node", "u"):
        extra = extra.withColumn(name, F.lit("clash"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, extra, SF).columns == extra.columns
        assert stage(spark, extra.limit(0), SF).count() == 0


def test_the_encoder_is_let_go_by_other_work():
    held = weakref.ref(bpe.encoder(corpus_pipeline.TOKENIZER))
    list(common.steps([pa.record_batch({"text": ["a"]})], 0, work=("bpe", corpus_pipeline.TOKENIZER)))
    assert held() is bpe.encoder(corpus_pipeline.TOKENIZER)
    list(common.steps([pa.record_batch({"text": ["a"]})], 0))
    assert held() is None
