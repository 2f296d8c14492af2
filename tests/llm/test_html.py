import html
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import html_text
from panelwright.llm.html_text import main_text, repeated_runs, split_page
from tests.llm.common import empty

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><h1>A &amp; B</h1><p>one\n two&nbsp;three<br>four<p>five</article>", "A & B\none two three four\nfive"),
        ("<nav>menu</nav><main><p>x</p><aside>no</aside>y</main><footer>f</footer>", "x\ny"),
        ("<body class='no-sidebar'><div class=header>h</div><div id='content'><p>in</p></div><div class=ad>buy</div>", "in"),
        ("<header>site</header><article><header><h1>Title</h1></header><p>Body</p></article>", "Title\nBody"),
        ("<article><p>kept<script>var t='</p>';</script> on</p><style>p{}</style></article>", "kept on"),
        ("<article>a<section class='comments'><article class='comment'><p>reader</p></article></section>b</article>", "a\nb"),
        ("<article><p>a <b>bold <i>both</b> rest</article><p>after", "a bold both rest"),
        ("<p>no container</p><form>f<input>g</form><div>two</div>", "no container\ntwo"),
        ("<article><!-- hidden --><p hidden>x</p><p>y &lt;z&gt; &#233; &eacute;</p><p style='display: none'>q</p>", "y <z> é é"),
        ("<article><p>1 < 2 and 3 > 2</p><p title='a > b'>t</p></article>", "1 < 2 and 3 > 2\nt"),
        ("<article><p>a <span class='ad'>buy now</span>b</p></article>", "a b"),
        ("<article><p>a <span class='ad'>buy <span>now</span> tail</span> b</p><p>c</p></article>", "a b\nc"),
        ("<article><p>a <span class='ad'>never closed</p><p>c</p></article>", "a\nc"),
        ("<article><p>a <a class='ad'><div>buy</div><p>now</p></a> b</p></article>", "a\nb"),
        ("<article><p>Our <span class='social'>social</span> policy</p><p><span class='share'>Share</span></p></article>", "Our social policy"),
        ("<article><ul><li class='widget'>a<li>b<li class='ad'>c</ul><p>d</article>", "b\nd"),
        ("<article><ul><li class='widget'>a<ul><li>inner</ul>a<li>b</ul></article>", "b"),
        ("<article><table><tr class='ad'><td class='x'>a<tr><td>b</table></article>", "b"),
        ("<article><p class='ad'>buy<div>real</div><p>more</article>", "real\nmore"),
        ("<html><head><title>A title</title></head><body><p>text</p>", "text"),
        ("<div><p>open <b>never closed", "open never closed"),
        ("<article><p>x</p></article><script>never closed", "x"),
        (None, ""),
        ("", ""),
        ("plain text, no tags", "plain text, no tags"),
    ],
)
def test_structure(page, text):
    assert split_page(page)[0] == text


def test_broken_pages_take_time_in_step_with_their_length():
    def seconds(n):
        page = "<div>" * n + "x" + "</p>" * n + "<li class='a'>" * n
        start = time.perf_counter()
        assert split_page(page)[0] == "x"
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(40_000) < 12 * seconds(10_000) + 0.2


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_articles_of_the_tables_are_whole(spark, scale):
    pages = spark.read.parquet(f"/root/testdata/{scale}/pages.parquet")
    for r in main_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(re.sub(r"<[^>]*>", " ", b).split()) for b in re.split(r"</?(?:p|h1)>", inner.replace("<b>", "").replace("<br>", " "))]
        expected = "\n".join(html.unescape(b) for b in blocks if b)
        assert r.text == expected and r.n_chars == len(expected)


@pytest.mark.parametrize("least", [2, 3, 5])
def test_spans_that_enough_pages_repeat(least):
    rng = np.random.default_rng(least)
    texts = [rng.integers(0, 3, rng.integers(0, 40)).tolist() for _ in range(9)]
    common = rng.integers(0, 9, 47).tolist()
    texts += [[k, *common[: 20 + 9 * (k % 4)], k] for k in range(10, 18)]
    unit = np.array([k - (k == 4) for k in range(len(texts))])  # two pages count once
    stream = np.concatenate(texts).astype(np.uint64)
    page = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    spans = [(d, a, b) for d, t in enumerate(texts) for a in range(len(t)) for b in range(a + 1, len(t) + 1)]

    def often(piece):
        n = len(piece)
        on = {unit[o] for o, t in enumerate(texts) if any(t[x : x + n] == piece for x in range(len(t) - n + 1))}
        return n >= 6 and len(on) >= least

    starts = np.cumsum([0, *map(len, texts)])
    first, size = np.array([starts[d] + a for d, a, _ in spans]), np.array([b - a for _, a, b in spans])
    got = html_text.repeated_spans(stream, page, unit, first, size, least, 6)
    assert got.tolist() == [often(texts[d][a:b]) for d, a, b in spans]
    assert size[got].max() > 20 and not html_text.repeated_spans(stream[:0], page[:0], unit, first[:0], size[:0], 2, 6).size


def test_suffixes_of_equal_rank_share_their_first_tokens():
    rng = np.random.default_rng(3)
    stream = rng.integers(0, 4, 400).astype(np.uint64)
    page = np.repeat(np.arange(8), 50)
    for width in (1, 2, 3, 6):
        start, rank = repeated_runs(stream, page, width)
        windows = [tuple(stream[s : s + width]) for s in start]
        assert windows == sorted(windows)
        assert len(set(zip(windows, rank.tolist(), strict=True))) == len(set(windows))
        assert sorted(start) == [s for s in range(400 - width + 1) if page[s] == page[s + width - 1]]


NOTICE = "We use small files to remember what you did here before, please agree now"


def host_pages(n, marked):
    rows = []
    for k in range(n):
        own = " ".join(f"word{k}_{j}" for j in range(20))
        body = f"<div><p>{NOTICE}</p></div><div><p>{own}</p></div>"
        if marked and k % 2:
            body = f"<div>{NOTICE}</div><article><p>{own}</p><p>{NOTICE}</p></article>"
        rows.append((k, f"http://Host.example/{k}", body))
    return rows


@pytest.mark.parametrize("join", [False, True])
@pytest.mark.parametrize("marked", [False, True])
def test_runs_repeated_on_a_hosts_pages_go(spark, monkeypatch, marked, join):
    if join:
        monkeypatch.setattr(html_text, "SENT_RUNS", 0)
    monkeypatch.setattr(html_text, "PART_PAGES", 500 if marked else 4)
    rows = host_pages(12, marked)
    rows += [(100 + k, f"http://other.example/{k}", f"<p>{NOTICE}</p><p>only here {k}</p>") for k in range(2)]
    rows += [(200 + k, "http://copies.example/", f"<p>{' '.join(f'c{j}' for j in range(30))}</p>") for k in range(5)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, PAGES)).collect()}
    for k in range(12):
        assert got[k] == " ".join(f"word{k}_{j}" for j in range(20))
    assert got[100] == f"{NOTICE}\nonly here 0"  # two pages do not make a template
    assert got[200] == " ".join(f"c{j}" for j in range(30))  # nor do copies of one page


def test_blocks_that_most_articles_repeat_go_and_shared_content_stays(spark):
    """Planted notices, all of which go, among headlines, passages and paragraphs that pages share."""
    headline, shared = "Weekly report of the city council", "A paragraph that a third of all articles quote in full"
    outside = "Read more of what we wrote about this last year"
    rows, want = [], {}
    for k in range(60):
        own = " ".join(f"word{k}_{j}" for j in range(40))
        own += f" and {NOTICE} as well" if k % 4 == 1 else ""  # a passage inside a longer block
        blocks = [headline if k % 10 == 0 else f"Headline {k}", *([shared] if k % 3 == 0 else []), own]
        body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
        body += f"<p>{NOTICE}</p>" if k % 5 else f"<p>{outside}</p>" if k == 0 else ""
        want[k] = "\n".join([*blocks, outside] if k == 0 else blocks)
        page = f"<head><title>{blocks[0]}</title></head><div>{outside}</div><article>{body}</article>"
        rows.append((k, f"http://host.example/{k}", page))
    same = "We meet on every first Monday of the month"
    for k in range(60, 70):  # a heading is content even if all articles have it
        want[k] = f"{same}\n" + " ".join(f"word{k}_{j}" for j in range(40))
        title, own = want[k].split("\n")
        rows.append((k, f"http://blog.example/{k}", f"<article><h2>{title}</h2><p>{own}</p></article>"))
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == want


def test_parts_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(html_text, "PART_BYTES", 3_000)
    monkeypatch.setattr(html_text, "ARTICLES", 2)
    rows = [(k, "http://h.example/", f"<article><p>{' '.join(f'w{k}_{j}' for j in range(99))}</p><p>{NOTICE}</p></article>") for k in range(40)]
    got = main_text(spark.createDataFrame(rows, PAGES)).collect()
    assert all(r.text == " ".join(f"w{r.page_id}_{j}" for j in range(99)) for r in got) and len(got) == 40


def test_edited_copies_of_an_article_are_no_template(spark):
    rows, want = [], {}
    for k in range(20):
        story = [f"story{j}" for j in range(150)]
        for j in range(k, 150, 50):
            story[j] = f"edit{k}_{j}"
        more = " ".join(f"more{k}_{j}" for j in range(20))  # an eighth of the page is its own
        want[k] = " ".join(story) + "\n" + more
        rows.append((k, f"http://mirror.example/{k}", f"<article><p>{' '.join(story)}</p><p>{more}</p></article>"))
    long = " ".join(f"story{j}" for j in range(60)) + " " + " ".join(f"quote{j}" for j in range(60))
    rows.append((90, "http://mirror.example/90", f"<article><p>{long}</p></article>"))  # cites half of the story
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == want | {90: long}


def test_awkward_rows(spark):
    rows = [(1, None, "<p>a</p>"), (1, None, "<p>a</p>"), (None, "not a url", None), (2, "http://h/", ""), (3, "http://h/", "<p>" + "x " * 90_000)]
    frame = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit(1) for c in ("row", "host", "own", "text")})
    got = main_text(frame).collect()
    assert sorted((r.page_id or 0, r.text[:3], r.n_chars) for r in got) == [(0, "", 0), (1, "a", 1), (1, "a", 1), (2, "", 0), (3, "x x", 179_999)]
    assert main_text(empty(spark, PAGES)).isEmpty()
