"""Main text of pages, filter interaction and source divergence against plain Python."""

import html
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from engramite.llm import divergence, filter_audit, html_text, queries
from tests.llm.helpers import awkward, nothing, sentence

PAGES = "page_id long, url string, html string, text string, host string, paths int"


def texts_of(frame, key="page_id"):
    return {r[key]: r["text"] for r in frame.collect()}


def test_html_text_of_all_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = queries.QUERIES["op11_html_text"](spark, sf).toPandas().set_index("page_id")
    assert list(got.columns) == ["url", "text", "n_chars"]
    rows = pages.collect()
    assert len(got) == len(rows)
    for row in rows:
        article = re.search(r"<article>(.*)</article>", row.html, re.S)[1]  # these pages have one, with h1, p, b and br
        lines = (" ".join(html.unescape(re.sub(r"</?b>|<br>", "", x)).split()) for x in re.split(r"<br>(?=<p>)|</?p>|</?h1>", article))
        assert got.text[row.page_id] == "\n".join(x for x in lines if x)
        assert got.n_chars[row.page_id] == len(got.text[row.page_id])


JUNK = {
    "menu": "<div class='top-menu'><a href=/a>Home</a><a href=/b>About us</a></div>",
    "nav": "<nav><ul><li><a href=/x>World</a></ul></nav>",
    "header": "<header><h1>The Site</h1><p>All the news of the day</p></header>",
    "footer": "<footer><p>&copy; 2020 The Site, all rights reserved</p></footer>",
    "sidebar": "<div id=sidebar><p>Most read of the week, with a sentence or two</p></div>",
    "aside": "<aside><p>By the way, this is beside the matter</p></aside>",
    "notice": "<div class='cookie-notice'>We use cookies to do things that you may not like</div>",
    "advert": "<div class=ad>Buy this now, it is cheap</div>",
    "form": "<form action=/s><label>Name</label><input name=q><button>Send</button></form>",
    "script": "<script>if (a < b) document.write('<p>no text</p>')</script>",
    "style": "<style>p > b { color: red }</style>",
    "comments": "<section class='reader-comments'><h3>Comments</h3><article class=comment><p>Very good article, I read all of it twice and more</p></article></section>",
}
TITLE, PARTS = "A &quot;title&quot; &amp; more", ["First part with\n  white   space and some <b>bold</b> words.", "Second&nbsp;part &lt;here&gt;.", "Third."]
WANTED = 'A "title" & more\nFirst part with white space and some bold words.\nSecond part <here>.\nThird.'


@pytest.mark.parametrize("shape", ["article", "div", "plain"])
@pytest.mark.parametrize("what", [*JUNK, "all"])
def test_junk_goes_wherever_it_stands(shape, what):
    junk = list(JUNK.values()) if what == "all" else [JUNK[what]]
    parts = [f"<p>{p}" for p in PARTS]
    opened, closed = {"article": ("<main><article>", "</article></main>"), "div": ("<div id=page><div class='post-content post-812'>", "</div></div>"), "plain": ("", "")}[shape]
    for place in ("before", "after", "within"):
        inner = parts[:1] + (junk if place == "within" else []) + parts[1:]
        if shape == "plain" and place == "within" and what in ("header", "all"):
            continue  # a second h1 in the middle of a page without containers
        page = "".join([*(junk if place == "before" else []), opened, f"<h1>{TITLE}</h1>", *inner, closed, *(junk if place == "after" else [])])
        want = WANTED.replace("words.\n", "words.\nThe Site\n") if place == "within" and shape != "plain" and what in ("header", "all") else WANTED
        assert html_text.Page(f"<!DOCTYPE html><html><head><title>x</title></head><body>{page}</body></html>").text() == want, (place, what)


def test_a_host_agrees_on_its_path_and_others_keep_their_own(spark):
    words = random.Random(3)

    def page(body, advert):
        return f"<body><div class='offer-{words.randint(1, 99)}'><p>{advert}</p></div><div class='text{words.randint(1, 9)}'>{body}</div></body>"

    rows = [(i, "https://One.example.org:80/a", page(f"<p>{sentence(words, 40)}</p>", "short"), "", "", 0) for i in range(60)]
    rows += [(60, "http://one.example.org/b", page("<p>little text</p>", sentence(words, 30)), "", "", 0)]  # its own best is the offer
    rows += [(61, "http://two.example.org/b", page("<p>little text</p>", "the offer is longer here than the text"), "", "", 0)]  # alone on its host
    rows += [(62, None, "<p>no url</p>", "", "", 0), (63, "rel/ative", "<p>no host</p>", None, None, None), (64, "http://one.example.org/", None, "", "", 0), (None, None, None, None, None, None), (65, "http://one.example.org/", "", "", "", 0), (66, "http://one.example.org/", "<section><p>another shape</p></section>", "", "", 0)]
    rows += [rows[60]]
    pages = spark.createDataFrame(rows, PAGES)
    for bound in (html_text.BROADCAST_BYTES, 0):
        frame = html_text.extract(pages, broadcast_bytes=bound)
        assert frame.columns == ["page_id", "url", "text", "n_chars"]
        got = texts_of(frame)
        assert frame.count() == len(rows)
        assert got[60] == "little text" and got[61] == "the offer is longer here than the text"
        assert (got[62], got[63], got[64], got[None], got[65], got[66]) == ("no url", "no host", "", "", "", "another shape")
    votes = {(r.host, r.path): r.votes for r in html_text.vote(pages).collect()}
    assert votes["one.example.org", "body/div.text#"] == 60 and votes["one.example.org", "body/div.offer-#"] == 2
    assert html_text.extract(spark.createDataFrame([], PAGES)).count() == 0
    wins = {r.host: r.paths for r in html_text.winning_paths(html_text.vote(pages)).collect()}
    assert set(wins["one.example.org"]) == {"body/div.text#", "body/div.offer-#"}
    assert all(len(w) <= 1 / html_text.SHARE for w in wins.values())


def test_broken_pages_are_read():
    read = lambda x: html_text.Page(x).text()
    assert read("a < b and c > d &amp e &unknown; &am") == "a < b and c > d & e &unknown; &am"
    assert read("<p>one<p>two<div>three</p>four</div>") == "one\ntwo\nthree\nfour"
    assert read("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"
    assert read("<ul><li>a<ul><li>b</ul><li>c</ul>") == "a\nb\nc"
    assert read("<div class=\"x>never closed <p>hi</p>").endswith("hi")
    assert read("<p>x<!-- gone <p>y") == "x" and read("<p>x<script>y") == "x" and read("<p>x<") == "x<"
    assert read("<SCRIPT>var t='</p>'</Script ><P>Up</P>") == "Up"
    assert read("<p>a</p></div></div></section>b") == "a\nb"
    assert read("<p><i>a<b>b</i>c</b> d</p>") == "abc d"
    long = "word " * 400_000
    assert read(f"<article><p>{long}</p></article>") == long.strip()
    assert len(read("<div>" * 3000 + "deep" + "</div>" * 10)) == 4


def brute_masks(rows):
    """The filters' masks from their definitions: rows of (id, text)."""
    out = []
    for key, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text))]
        fails.append(key is not None and any(k is not None and k < key and (t or "") == text for k, t in rows))
        out.append(sum(f << i for i, f in enumerate(fails)))
    return out


def masked(frame, **kw):
    return Counter((r.id, r.part, r.mask) for r in filter_audit.masks(frame, **kw).collect())


def test_masks_are_as_defined_over_any_ranges(spark):
    draw = random.Random(11)
    texts = [sentence(draw, 120), "A B C # ABC", "", None, " ".join(["w"] * 200), sentence(draw, 150)]
    rows = [(draw.randint(1, 400), draw.choice(texts), draw.choice(["en", None, ""])) for _ in range(600)]
    rows += [(k, texts[0], "de") for k in range(500, 900)] + [(None, texts[0], "de"), (None, None, None), (7, texts[5], "en"), (7, texts[5], "en")]
    draw.shuffle(rows)
    want = Counter((k, lang or "", m) for (k, _, lang), m in zip(rows, brute_masks([(k, t) for k, t, _ in rows])))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts in ("1", "5", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert masked(docs) == want
            assert masked(docs.withColumn("doc_id", F.lpad(F.col("doc_id").cast("string"), 5, "0"))) == Counter({(None if k is None else f"{k:05d}", p, m): n for (k, p, m), n in want.items()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_texts_of_one_fingerprint_are_told_apart():
    """Runs at the edges of ranges when different texts have one fingerprint: each is a run of its own."""
    runs = filter_audit._Runs()
    seen = [runs.enter(1, t, k) for t, k in (("a", 3), ("a", 5), ("b", 1), ("b", 1), ("b", 2))] + [runs.enter(2, "c", 1), runs.enter(2, "c", 4)]
    assert seen == [(False, 0), (True, None), (False, 1), (False, 1), (True, None), (False, None), (True, None)]
    assert runs.end() == [(1, "a", 0, 3), (1, "b", 1, 1), (2, "c", 0, 1)]


def test_filter_audit_is_its_definition(spark):
    docs = awkward(spark, more=["X # Y", "w " * 200])
    labels = spark.createDataFrame([(0, 1, 1), (5, 1, None), (5, 0, 1), (5, None, None), (100, 0, 1), (999, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.text, r.lang or "") for r in docs.collect()]
    masks = brute_masks([(k, t) for k, t, _ in rows])
    good, toxic = {0, 5, 999}, {0, 5, 100, 999}
    want, shapley = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for step in range(1, 6):
            for part in {p for _, _, p in rows}:
                cell = [0] * 6
                for (key, _, lang), mask in zip(rows, masks):
                    if lang != part:
                        continue
                    fails = [bool(mask >> (ord(x) - 65) & 1) for x in order[:step]]
                    gone, now = any(fails[:-1]), fails[-1]
                    removed = now and not gone
                    cell = [a + b for a, b in zip(cell, (not any(fails), removed, now and gone, now and bin(mask).count("1") == 1, removed and key in good, removed and key in toxic))]
                want[part, order, step] = cell
                shapley[part, order[step - 1]] += cell[1]
    got = filter_audit.report(filter_audit.counters(filter_audit.masks(docs), labels)).collect()
    assert len(got) == len(want)
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost] == want[r.part, r.filter_order, r.step]
        assert r.shapley == shapley[r.part, r.filter_order[r.step - 1]]
    assert filter_audit.report(filter_audit.counters(filter_audit.masks(nothing(spark)), labels)).count() == 0
    bare = filter_audit.report(filter_audit.counters(filter_audit.masks(docs), labels.limit(0)))
    assert bare.agg(F.sum("good_lost"), F.sum("toxic_lost")).first()[:] == (0, 0)


def brute_divergence(rows, least, top):
    """Rows of (lang, source, text) to the audit's rows, term by term in whole numbers."""
    pattern = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in pattern.findall(text or "")]
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = {w for w, n in docs[lang].items() if n >= least}
        v = len(kept)

        def shares(c):
            n = sum(c[w] for w in kept)
            return {w: 1 + 1000000000 * (c[w] + 2) // (n + 2 * v) for w in kept}

        all_of = shares(sum((count[lang, s] for s in sources), Counter()))
        p = {s: shares(count[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][w], p[o][w]) for w in kept), o.encode()) for o in sources if o != s]
            own = [(-f(p[s][w], all_of[w]), w.encode()) for w in kept if count[lang, s][w] > 0 and p[s][w] > all_of[w]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(own)[:top])):
                out |= {(lang, s, part, i.decode(), -x, rank) for rank, (x, i) in enumerate(items, 1)}
    return out


@pytest.mark.parametrize("terms, sources", [(2048, 128), (5, 2)])
def test_divergence_is_its_definition(spark, monkeypatch, terms, sources):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", terms)
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", sources)
    draw = random.Random(2)
    vocabulary = "Alpha alpha beta's GAMMA-delta naïve Ünder ümlaut 漢字 x9y __z 😀 straße".split()
    rows = [(draw.choice(["en", "de", None]), draw.choice(["a", "b", "c", "d", None, "é"]), " ".join(draw.choices(vocabulary, k=draw.randint(0, 30)))) for _ in range(300)]
    rows += [("xx", "only", "one two three")] * 3 + [("yy", "p", None), ("yy", "q", ""), ("en", "empty", "123"), ("zz", "m", "ab" * 30), ("zz", "n", "c")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    docs = docs.withColumn("n", F.lit(1)).withColumn("term", F.lit("x")).withColumn("value", F.lit(None).cast("string"))
    got = divergence.audit(divergence.count_terms(docs), least_docs=3, top=4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute_divergence(rows, 3, 4)


def test_divergence_of_nothing(spark):
    assert divergence.audit(divergence.count_terms(nothing(spark))).count() == 0


def test_words_are_told_apart_by_their_bytes(monkeypatch):
    raw = np.frombuffer(divergence.LOWER[np.frombuffer("AbcXabcX ünder漢字1x".replace("X", "-").encode(), np.uint8)].tobytes(), np.uint8)
    starts, ends = divergence.find_words(raw, np.array([0, 2, 2, len(raw)]))
    assert [bytes(raw[a:b]).decode() for a, b in zip(starts, ends)] == ["ab", "c", "abc", "ünder漢字", "x"]
    monkeypatch.setattr(divergence.xxhash, "xxh3_64_intdigest", lambda b: len(b) % 2)  # nearly all words collide
    number, terms = divergence.number_words(raw, starts, ends)
    assert [terms[k] for k in number] == [bytes(raw[a:b]) for a, b in zip(starts, ends)] and len(set(terms)) == len(terms)


def test_long_texts_are_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 64)
    text = "alpha Beta gamma, " * 500 + "x" * 1000 + " alpha"
    counts = divergence._Counts()
    raw = divergence.LOWER[np.frombuffer(text.encode(), np.uint8)]
    counts.batch(["en"], ["s"], raw, np.array([0, len(raw)]))
    counts.batch(["en"], ["s"], raw[:5], np.array([0, 5]))
    got = {(r["lang"], r["source"], r["term"]): (r["n"], r["docs"]) for r in counts.take().to_pylist()}
    assert got == {("en", "s", b"alpha"): (502, 2), ("en", "s", b"beta"): (500, 1), ("en", "s", b"gamma"): (500, 1), ("en", "s", b"x" * 1000): (1, 1)}
    assert counts.take().num_rows == 0


@pytest.mark.parametrize("held, size", [(1, 1 << 30), (10**9, 1)])
def test_counts_are_handed_on_when_there_are_many(spark, monkeypatch, held, size):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "HELD_BYTES", size)
    monkeypatch.setattr(divergence, "SLICE", 16)
    docs = spark.createDataFrame([("en", "s", "a b a"), ("en", "t", "B"), ("en", "s", "b c"), ("de", "s", None)] * 5, "lang string, source string, text string")
    got = {tuple(r)[:3]: (r.n, r.docs) for r in divergence.count_terms(docs).collect()}
    assert got == {("en", "s", "a"): (10, 5), ("en", "s", "b"): (10, 10), ("en", "s", "c"): (5, 5), ("en", "t", "b"): (5, 5), ("en", "s", None): (0, 0), ("en", "t", None): (0, 0), ("de", "s", None): (0, 0)}
