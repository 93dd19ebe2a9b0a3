import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from common import corpus, docs, prose, sha
from pyspark.sql import functions as F
from test_dedup import links

import corpus_pipeline
from strake.llm import decontaminate, mixing, wrappers
from strake.llm.queries import ORACLES, QUERIES

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return ALNUM.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def hits(text, items):
    w = words(text)
    hit, names = set(), set()
    for i, t in items:
        v = words(t)
        n = min(10, len(v))
        for k in range(len(v) - n + 1 if v else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[k : k + n]:
                    hit.update(range(p, p + n))
                    names.add(None if i is None else str(i))
    return len(w), len(hit), sorted(names, key=lambda x: (x is None, x or ""))


@pytest.mark.parametrize("chunk", [8_000_000, 300])
def test_contamination_is_brute_force(spark, chunk):
    items = [(1, prose(1, 25)), (2, prose(2, 10)), (10, "Short item"), (3, ""), (4, None), (5, prose(1, 14)), (6, "ab ab ab ab ab ab ab ab ab ab ab ab"), (None, prose(9, 12)), (2, prose(8, 11)), (7, "日本 été")]
    rows = [
        (0, prose(1, 25).upper()),
        (1, "x " + prose(2, 10).replace(" ", ", ") + " y"),
        (2, prose(2, 9)),
        (3, "a short-item! shortitem SHORT\nITEM"),
        (4, None),
        (5, ""),
        (6, "ab " * 40),
        (7, prose(9, 12) + " été 日本 été"),
        (8, prose(1, 12) + " z " + prose(8, 11)),
        (8, prose(1, 12) + " z " + prose(8, 11)),
        (None, prose(2, 10)),
        *corpus(5, 30),
        (9000, prose(50, 9000) + " " + prose(2, 10)),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contamination(docs(spark, rows), bench, chunk_bytes=chunk).collect()
    got = Counter((str(r.doc.doc_id), r.n_words, sum(r.spans[1::2]) - sum(r.spans[::2]), tuple(r["items"])) for r in out)
    assert got == Counter((str(i), n, h, tuple(k)) for i, t, *_ in rows for n, h, k in [hits(t, items)])
    kept = decontaminate.clean_rows(docs(spark, rows), bench)
    assert kept.columns == docs(spark, rows).columns and kept.count() == sum(not r.spans for r in out)


def test_items_of_one_text_are_one_entry(spark):
    """However many items share a text, no chunk grows; each of their ids is reported, a null one too."""
    same = [(i, prose(1, 40)) for i in range(300)] + [(None, prose(1, 40))] + [(1000 + i, prose(i + 2, 40)) for i in range(40)]
    bench = spark.createDataFrame(same, "item_id long, text string")
    size = len(prose(1, 40))
    per = decontaminate._chunks(bench, 3 * size).groupBy("part", "sub").agg(F.sum(F.octet_length("text")).alias("n")).collect()
    assert len(per) > 5 and max(r.n for r in per) <= 5 * size
    (row,) = decontaminate.contamination(docs(spark, [(1, prose(1, 40))]), bench, chunk_bytes=3 * size).collect()
    assert row["items"] == [*sorted(str(i) for i in range(300)), None] and row.spans == [0, 40]


def test_contamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.spans for r in decontaminate.contamination(docs(spark, [(1, "a b")]), none).collect()] == [[]]
    assert decontaminate.contamination(docs(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def _targets(size, cap=3):
    """Water filling by hand: share, cut, share again."""
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = dict(zip(order, [5, 2, 1] * len(order), strict=False))
    total, held = sum(size.values()), {}
    while True:
        free = [s for s in order if s not in held]
        left = total - sum(held.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * size[s]]
        if not over:
            return held | share
        held |= {s: cap * size[s] for s in over}


@pytest.mark.parametrize("bound", [100_000, 0])
def test_mix_targets_and_counts(spark, bound):
    rows = [*corpus(7, 200), *[(3000 + i, "one", f"tiny{i}") for i in range(4)]]
    rows = [(r[0], r[1], "en", r[3] if len(r) > 3 else r[2]) for r in rows]
    out = mixing.mix_counts(docs(spark, rows), broadcast_sources=bound).collect()
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = _targets(size)
    assert len(out) == len(rows) and sum(want.values()) == pytest.approx(sum(size.values()))
    for r in out:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        rate = r.target / r.source_size if r.source_size else 0
        assert r.copies in (int(rate), int(rate) + 1) and r.taken == r.copies * r.size <= 3 * r.size
    again = mixing.mix_counts(docs(spark, rows), broadcast_sources=bound).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    mixed = mixing.mix(docs(spark, rows), broadcast_sources=bound)
    assert mixed.columns == [c for c in docs(spark, rows).columns if c != "copy_no"] + ["copy_no"]
    assert mixed.count() == sum(r.copies for r in out)


def test_mix_comes_near_its_targets(spark):
    rows = [(i, prose(i, 10), "en", "abc"[i % 3]) for i in range(3000)]
    out = mixing.mix_counts(docs(spark, rows)).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t / r.g - 1) < 0.08 for r in out)


def test_mix_with_long_documents_comes_near_its_targets(spark):
    """A few documents with most of a source's words do not carry it off."""
    rows = [(i, prose(i, 2000 if i % 40 == 0 else 1 + i % 60), "en", [None, "b", "c", "d"][i % 4]) for i in range(400)]
    for seed in (17, 18):
        out = mixing.mix_counts(docs(spark, rows), seed=seed).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
        assert all(abs(r.t / r.g - 1) < 0.01 for r in out)


def test_mix_takes_each_document_with_its_own_probability(spark):
    """Over many sources of one make-up, long and short documents alike are taken at their source's rate."""
    rows = [(1000 * s + i, "w " * (40 if i == 0 else 8 + i), "en", f"s{s:03d}") for s in range(300) for i in range(20)]
    out = mixing.mix_counts(docs(spark, rows)).withColumn("rate", F.round(F.col("target") / F.col("source_size"), 3))
    for r in out.groupBy("rate", (F.col("size") == 40).alias("long")).agg(F.avg("copies").alias("mean"), F.count("*").alias("n")).collect():
        assert abs(r.mean - r.rate) < (0.17 if r.long else 0.05), r


def test_mix_of_nothing(spark):
    assert mixing.mix_counts(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [])).count() == 0
    assert [(r.target, r.taken) for r in mixing.mix_counts(docs(spark, [(1, None), (2, "")])).collect()] == [(0.0, 0)] * 2


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><p>Site name</p></header><nav><ul><li><a href=/>Home</a><li>About</ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>{h}</h1><p>{a} &amp; <b>bold</b><br>more&nbsp;text<p>{b}</p><div class="ad">Buy</div><button>Share</button>
<ul><li>one<li>two</ul><section id="comments"><p>First!</p></section></article>
<aside>Side</aside><form><input><p>Mail</p></form><footer>&copy; x</footer></body></html>"""


def test_main_text_of_a_page():
    text = wrappers.main_text(PAGE.format(h="Title", a="Alpha\n  beta", b="Gamma &lt;x&gt; &#233;"))
    assert text == "Title\n\nAlpha beta & bold more text\n\nGamma <x> é\n\none\n\ntwo"


def test_broken_pages():
    assert wrappers.main_text("<article><p>a &am") == "a &am"
    assert wrappers.main_text("<article><p>a <b>b</p><p>c</arti") == "a b\n\nc"
    assert wrappers.main_text("<article><p>1 < 2 and <3</p><!-- x <p>y</p>") == "1 < 2 and <3"
    assert wrappers.main_text('<article><p title="a>b">x<img alt="\'>y<script>z').startswith("x")
    assert wrappers.main_text(None) == wrappers.main_text("") == ""


def test_wrappers_are_union_free():
    def page(*keys):
        return wrappers.wrapper_of([(k, t) for k, t in keys])

    a = page(("-/h1", "A"), ("-/p", "x"), ("-/p", "y"), ("-/div", "Site"))
    b = page(("-/h1", "B"), ("-/p", "z"), ("-/table/tr/td", "t"), ("-/div", "Site"))
    got = wrappers.merge(a, b)
    assert [(n[0], n[1], n[2], n[3]) for n in got] == [("-/h1", None, False, False), ("-/p", None, False, True), ("-/table/tr/td", "t", True, False), ("-/div", "Site", False, False)]
    pairs = wrappers.fold_repeats([wrappers._leaf(k, None) for k in ["q", "a", "q", "a", "q", "a", "z"]])
    assert [(n[0], n[3]) for n in pairs] == [("(q a)", True), ("z", False)]


def test_pages_without_articles_follow_their_host(spark):
    """Outside of articles, what all pages of a host share is the host's, and what differs is the text."""
    page = "<html><body><div>Our site</div><div class='x'><p>{0}</p><p>{1}</p></div><div><span>Contact us</span></div></body></html>"
    rows = [(i, f"http://User@Plain.example:80/{i}?q", page.format(prose(i, 12), prose(i + 50, 12))) for i in range(8)]
    rows += [(100 + i, f"https://art.example/{i}", PAGE.format(h=f"T{i}", a=prose(i, 9), b=prose(i, 5))) for i in range(7)]
    rows += [(200, None, None), (201, None, "<p>lone text</p>"), (201, None, "<p>lone text</p>"), (None, "http://plain.example:80/z", "")]
    table = spark.createDataFrame([(*r, "w", 1) for r in rows], "page_id long, url string, html string, wrapper string, pages int")
    for bound in (wrappers.BROADCAST_BYTES, 0):
        out = wrappers.extract(table, bound).collect()
        assert len(out) == len(rows)
        got = {r.page_id: r.text for r in out}
        assert all(got[i] == prose(i, 12) + "\n\n" + prose(i + 50, 12) for i in range(8))
        assert got[200] == got[None] == "" and got[201] == "lone text"
        assert got[103].startswith("T3\n\n") and "First" not in got[103] and "cookies" not in got[103]
    assert wrappers.extract(table.limit(0)).count() == 0


def _extracted(spark, pages, host="h.example"):
    table = spark.createDataFrame([(i, f"http://{host}/{i}", page) for i, page in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in wrappers.extract(table).orderBy("page_id").collect()]


def test_long_constants_are_template(spark):
    """With an article or without, in a run or alone, a long text that all pages share is the host's; a long slot beside an article is text."""
    legal, note = prose(900, 20), prose(901, 20)
    texts = [(prose(i, 20), prose(i + 50, 20)) for i in range(6)]
    plain = [f"<div>{note}</div><div><p>{a}</p><p>{b}</p><p>{legal}</p></div><ul><li>Home</li><li>About</li></ul>" for a, b in texts]
    article = [f"<article><p>{a}</p><p>{legal}</p></article><div>{note}</div><section>{b}</section>" for a, b in texts]
    want = [f"{a}\n\n{b}" for a, b in texts]
    assert _extracted(spark, plain) == want
    assert _extracted(spark, article) == want


def test_short_blocks_are_text(spark):
    """A short block of some pages, of copies of one page, or inside articles is no template, however many pages a host has."""
    texts = [prose(i, 20) for i in range(7)]
    some = [f"<div>Our site</div><p>{t}</p>" + "<h2>Why so</h2><pre>One line</pre>" * (i == 2) for i, t in enumerate(texts)]
    assert _extracted(spark, some) == [t + "\n\nWhy so\n\nOne line" * (i == 2) for i, t in enumerate(texts)]
    for n in (4, 5, 9):
        assert _extracted(spark, [f"<h1>Top</h1><p>{texts[0]}</p><p>Two</p><div>End</div>"] * n) == [f"Top\n\n{texts[0]}\n\nTwo\n\nEnd"] * n
    assert _extracted(spark, [f"<article><p>{t}</p><div>In short</div></article>" for t in texts]) == [f"{t}\n\nIn short" for t in texts]


def _plain_page(head, text, promo):
    """A page whose elements and classes say nothing."""
    links = "".join(f"<a href=/{k}>{prose(k, 2)}</a> " for k in range(8))
    return f"<body><div class=q1>{links}</div><div class=w2><h2>{head}</h2><p>{text}</p><div class=e3><p>{text[::-1]}</p></div></div><div class=r4>{promo}</div><div class=t5>{prose(77, 9)}</div></body>"


def test_the_wrapper_finds_the_text_where_names_say_nothing(spark):
    """Menus, adverts and notices are told by the host's slots; on a page with little text the host decides, alone it would be the advert."""
    texts = [(prose(i, 3), prose(i + 20, 60 if i else 2), prose(i + 40, 25)) for i in range(8)]
    pages = [_plain_page(*t) for t in texts]
    want = ["\n\n".join([h, t, t[::-1]]) for h, t, _ in texts]
    assert _extracted(spark, pages) == want
    alone = [wrappers.main_text(p) for p in pages]
    assert alone[1:] == want[1:] and alone[0] != want[0]
    # a page without its host's region is judged alone
    assert _extracted(spark, [*pages, f"<div class=z9><p>{prose(5, 30)}</p></div>"])[-1] == prose(5, 30)


def test_many_small_containers_outweigh_a_large_one(spark):
    """A host whose text lies in 3,000 containers, each under a thousandth of all, beside an advert."""
    names = [f"s-{prose(i, 1)}-{'x' * (i % 60)}-{'y' * (i // 60)}" for i in range(3000)]
    pages = ["<body><div class=q1>" + "".join(f"<section class={n}><p>{prose(i, 12)}</p></section>" for n in names[i::6]) + f"</div><div class=w2>{prose(i + 50, 600)}</div></body>" for i in range(6)]
    assert _extracted(spark, pages) == ["\n\n".join([prose(i, 12)] * 500) for i in range(6)]
    parts = [wrappers.masses(wrappers.blocks(p)) for p in pages]
    whole = Counter()
    for part in parts:
        whole.update(part)
    found: dict = {}
    for part in parts:
        found = wrappers.summed(found, part)
    assert found == whole and len(found) == 3001


def test_removing_the_wrapper_changes_the_text(spark):
    """Each page repeats what its host says; without the host it would be text."""
    pages = [f"<div class=k><p>{prose(900, 12)}</p><p>{prose(i, 20)}</p><p>{prose(901, 12)}</p></div>" for i in range(6)]
    assert _extracted(spark, pages) == [prose(i, 20) for i in range(6)]
    assert [wrappers.main_text(p) for p in pages] == ["\n\n".join([prose(900, 12), prose(i, 20), prose(901, 12)]) for i in range(6)]


def test_letters_that_grow_when_lowered_move_nothing():
    page = "<article><p>" + "İ" * 30 + "</p><SCRIPT>if (a</b) x()</SCRIPT ><p>one</p><style>y</ſtyle></style><p>two</p><script>z</ſcript></script><p>three</p>"
    assert wrappers.main_text(page).split("\n\n") == ["İ" * 30, "one", "two", "three"]


def _measured(work):
    tracemalloc.start()
    begin = time.process_time()
    work()
    spent, most = time.process_time() - begin, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return spent, most


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "<p>x" + "</div>" * 20_000, "<div>" * 20_000 + "</b><p>x" * 3000, "<div class=ad>" * 20_000 + "x", "<div class=a>" + "<ul><li>" * 8000 + "x"])
def test_deep_pages_take_linear_time(page):
    spent, most = _measured(lambda: wrappers.main_text(page))
    assert spent < 8 and most < 100_000_000  # traced, several times as slow as it is
    assert wrappers.main_text(page).split("\n\n")[-1] in ("x", "")


def test_wide_pages_align_in_linear_memory():
    """15,000 blocks of few keys in no order, on both pages."""
    kinds = "p h2 h3 ul/li pre blockquote dl/dd table/tr/td".split()

    def page(seed):
        r = random.Random(seed)
        return [[f"-/div.{r.randint(0, 60)}/{r.choice(kinds)}", str(i), False, False, None, False] for i in range(15_000)]

    spent, most = _measured(lambda: wrappers.merge(page(1), page(2)))
    assert spent < 6 and most < 100_000_000


@pytest.mark.parametrize("cells", [1 << 21, 40])
def test_alignment_is_a_common_subsequence(monkeypatch, cells):
    monkeypatch.setattr(wrappers, "CELLS", cells)
    r = random.Random(5)
    for n, m, k in [(0, 5, 3), (30, 40, 4), (60, 50, 200), (50, 50, 12), (1, 1, 1)] * 4:
        x, y = np.array([r.randint(0, k) for _ in range(n)], np.int64), np.array([r.randint(0, k) for _ in range(m)], np.int64)
        pairs = wrappers.aligned(x, y)
        assert all(x[i] == y[j] for i, j in pairs) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:], strict=False))
        best = int(wrappers._last_row(x, y)[-1])
        assert len(pairs) <= best and (len(pairs) == best or (cells == 40 and k >= 12))


@pytest.mark.parametrize("name", ["no-sidebar", "with-sidebar", "has-comments", "sticky-header", "search-results", "ad-free", "sidebar", "noSidebar wrap"])
def test_names_around_the_text_exclude_nothing(name):
    for attr in ("class", "id"):
        assert wrappers.main_text(f"<div {attr}='{name}'><article><p>Alpha</p><div class='cookie-notice'>We use</div><div class='box ad'>Buy</div></article></div>") == "Alpha"
        assert wrappers.main_text(f"<div {attr}='{name}'><p>{prose(1, 20)}</p></div><div class='ad'>Buy</div>") == prose(1, 20)
    beside = "<article><p>Alpha</p></article><div id='comments'><article><p>A comment that is longer than all of the rest</p></article></div>"
    assert wrappers.main_text(beside) == "Alpha"


def test_pipeline_stages_apply_in_turn(spark, tmp_path):
    """Each stage returns the columns of documents, drops what it must and nothing clean."""
    langs = {"en": "the of and ing", "fr": "été où çà né"}
    rows = []
    for i in range(90):
        lang = "en" if i % 2 else "fr"
        rows.append((i, prose(i, 90) + " " + " ".join(langs[lang].split() * 6), lang, "a" if i % 3 else None))
    rows += [(200, rows[0][1] + " ", "fr", "a"), (201, rows[1][1].replace("the", "thx", 1), "en", "a"), (202, "1234 5678", "en", "a"), (203, None, "en", "a")]
    item = prose(500, 15)
    rows += [(204, rows[2][1] + " " + item + " " + prose(600, 60), "fr", "a")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = [{r.doc_id for r in table.collect()}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, str(tmp_path))
        assert table.columns == docs(spark, []).columns
        kept.append({r.doc_id for r in table.collect()})
    gone = [a - b for a, b in zip(kept[:-1], kept[1:], strict=True)]
    assert gone[0] == {202, 203} and gone[1] == {0} and gone[2] == {201} and gone[3] == {204}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} <= kept[-1]
    want = mixing.mix(table).select("doc_id", "copy_no")
    assert sorted(map(tuple, out.select("doc_id", "copy_no").collect())) == sorted(map(tuple, want.collect()))


def test_pipeline_of_nothing(spark, tmp_path):
    """Empty tables go through all stages."""
    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [c for c in docs(spark, []).columns if c != "copy_no"] + ["copy_no"] and out.count() == 0


def test_pipeline_on_nulls_and_repeated_rows(spark, tmp_path):
    """Each stage, on columns of clashing names, null ids and texts, ties and repeated rows, keeps what plain code keeps."""
    base = corpus(11, 70)
    rows = [*base, *base[:6], (None, None), (None, ""), (None, prose(3, 30)), (5000, prose(3, 30)), (5000, prose(4, 30)), (5001, prose(6, 12) + " " + prose(7, 9))]
    rows = [(r[0], r[1], "en", r[3] if len(r) > 3 else "a") for r in rows]
    spark.createDataFrame([(1, prose(6, 12)), (None, prose(9, 11)), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    columns = docs(spark, []).columns
    told = lambda df: Counter((r.doc_id, r.text) for r in df.collect())

    told_language = corpus_pipeline.language(spark, docs(spark, rows), str(tmp_path))
    assert told_language.columns == columns
    assert told(told_language) == Counter((i, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t))

    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    unique = corpus_pipeline.exact_copies(spark, docs(spark, rows), str(tmp_path))
    best: dict = {}
    for i, t, *_ in rows:
        best.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0))
    got = [(norm(r.text), (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)) for r in unique.collect()]
    assert unique.columns == columns and sorted(got) == sorted((n, min(g)) for n, g in best.items())

    near = corpus_pipeline.near_copies(spark, docs(spark, rows), str(tmp_path))
    want = links(rows)
    assert near.columns == columns
    assert told(near) == Counter((i, t) for i, t, *_ in rows if i is None or i not in want or want[i][0] == i)

    clean = corpus_pipeline.benchmark_free(spark, docs(spark, rows), str(tmp_path))
    items = [(1, prose(6, 12)), (None, prose(9, 11)), (2, None), (3, "")]
    assert clean.columns == columns and told(clean) == Counter((i, t) for i, t, *_ in rows if not hits(t, items)[1])


def test_every_operator_has_its_query():
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES} == set(range(1, 11)) and set(ORACLES) < set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]
    assert sha(b"") == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_width_follows_the_data(spark, tmp_path, monkeypatch):
    """At least a partition for so many stored bytes, whatever the session says; the setting where the size is unknown."""
    from strake.llm import scratch, suffix

    table = docs(spark, corpus(8, 60))
    assert scratch.width(table) == 4 and scratch.width(table, 9) == 9
    table.write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    assert scratch.width(stored) == 4
    monkeypatch.setattr(scratch, "PARTITION_BYTES", 8_000)
    n = scratch.width(stored)
    assert n > 8
    wide = {(r.doc_id, bytes(r.kept)) for r in suffix.suffix_dedup(stored).collect()}
    assert wide == {(r.doc_id, bytes(r.kept)) for r in suffix.suffix_dedup(stored, partitions=3).collect()}


def test_width_is_not_a_guess_of_joins(spark, tmp_path):
    """However often a table is joined, its partitions follow the bytes that are read; tables can be cleared."""
    from strake.llm import scratch

    docs(spark, corpus(8, 60)).write.parquet(str(tmp_path / "d"))
    table = spark.read.parquet(str(tmp_path / "d"))
    twice = table.join(table.select("doc_id", "lang").withColumnRenamed("lang", "l2"), "doc_id", "left").join(table.select("doc_id", "source").withColumnRenamed("source", "s2"), "doc_id", "left")
    assert scratch.width(twice) == scratch.width(table) == 4
    mark = scratch.made()
    a, b = scratch.cut(table, "a"), scratch.cut(table, "b")
    scratch.clear(mark, scratch.made() - 1)
    assert b.count() == table.count() and scratch.made() == mark + 1
    with pytest.raises(Exception, match="(?i)path|file"):
        a.count()
    scratch.clear(mark)
    assert scratch.made() == mark
