"""Main text against simple rules for simple pages, and boilerplate against brute force."""

import html
import random
import re
import time

import numpy as np
import pytest

from layerstack.llm import html_text as ht


def text(page):
    return ht.main_text(ht.blocks_of(page))


@pytest.mark.parametrize(
    "page,want",
    [
        ("<article><h1>T &amp; x</h1><p>a\n b<br>c<p><b>d</b>e</article><footer>f</footer>", "T & x\n\na b c\n\nde"),
        ("<nav>n</nav><main><p>x</p><aside>y</aside><form>z</form></main>", "x"),
        ("<main><p>no</p><article><p>yes</p></article></main>", "yes"),
        ("<article><p>a<script>var t='</p>';if(1<2)</script>b</p><style>p{}</style></article>", "ab"),
        ("<article><ul><li>1<li>2</ul><table><tr><td>x<td>y</table></article>", "1\n\n2\n\nx\n\ny"),
        ("<article><p>t</p><section class='comments'><p>c</p></section><div id=cookie-notice>k</div></article>", "t"),
        ("<article><p title='a > b'>q<!-- <p>no -->r</p></article>", "qr"),
        ("<article><p>&eacute;&#233;&#xe9;&nbsp;x &lt;b&gt;</article>", "ééé x <b>"),
        ("<article><p hidden>h</p><p style='display: none'>h</p><p>s</article>", "s"),
        ("<div class='entry-content'>a<div>b</div>c</div><div class=sidebar>s</div>", "a\n\nb\n\nc"),
        ("<article>1 < 2 and a<b</article>", "1 < 2 and a"),
        ("<article></article><p>x</p>", None),
        ("", ""), (None, ""), ("<nav>only</nav>", ""), ("<p", ""), ("<article><p>unclosed", "unclosed"),
        ("<article><textarea>f</textarea><p>ok", "ok"), ("<article><p>a</p></div></span><p>b", "a\n\nb"),
    ],
)
def test_pages(page, want):
    assert text(page) == want


@pytest.mark.parametrize(
    "page",
    [
        "<article><p>text</p>" + "<span>" * 100_000 + "</b>" * 100_000 + "<p>end</article>",
        "<article><p>text</p>" + "<span>" * 60_000 + "<div>" * 60_000 + "</p>" * 60_000 + "<p>end</article>",
        "<article><p>text</p>" + "<i>" * 60_000 + "<li>x" * 60_000 + "<p>end</article>",
        "<article><p>text</p>" + "<div>" * 100_000 + "</span>" * 100_000 + "<p>end</article>",
    ],
)
def test_deep_nesting_takes_linear_time(page):
    """Open elements by the thousand, and end tags that match none of them."""
    begin = time.process_time()
    got = text(page)
    assert time.process_time() - begin < 10
    assert got.startswith("text\n\n") and got.endswith("end")


def plain_repeats(pages, run=ht.RUN):
    """For each page of a host, flags of suffixes whose beginning another, different page holds."""
    streams = []
    for blocks in pages:
        s = []
        for b in blocks:
            s += [*b.split(), None]
        streams.append(s)
    out = []
    for i, s in enumerate(streams):
        flags = []
        for a in range(len(s) - run + 1):
            flags.append(any(
                streams[j][b : b + run] == s[a : a + run]
                for j in range(len(pages)) if pages[j] != pages[i]
                for b in range(len(streams[j]) - run + 1)
            ))
        out.append(flags + [False] * (len(s) - len(flags)))
    return out


def test_hosts(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    menu, note = ["Home", "News and more", "About us", "Contact"], "We use cookies to make this site work better"
    rows, pages = [], {}
    for n in range(24):
        host = ["a.org", "b.org", "only.org"][n % 3 if n < 23 else 2] if n > 0 else "only.org"
        body = [" ".join(rng.choices(words, k=rng.randrange(3, 20))) for _ in range(3)]
        blocks = [*menu, *body, note] if host != "only.org" or n else [*menu, *body]
        page = "<div>" + "</div><div>".join(blocks) + "</div>"
        rows.append((n, f"http://{host}/{n}", page))
        pages.setdefault(host, []).append((n, blocks))
    rows.append((50, "http://a.org/copy", rows[3][2]))
    pages["a.org"].append((50, pages["a.org"][[n for n, _ in pages["a.org"]].index(3)][1]))
    rows += [(60, None, "<p>no host at all here, but words enough to be repeated"), (61, None, rows[5][2])]
    want = {60: "no host at all here, but words enough to be repeated", 61: "\n\n".join(b for b in [*pages["only.org"][1][1]])}
    for members in pages.values():
        flags = plain_repeats([b for _, b in members])
        for (n, blocks), f in zip(members, flags):
            import numpy as np

            want[n] = "\n\n".join(ht.unique_blocks(blocks, np.array(f)))
    df = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, TEXT int")
    out = ht.extract(df.repartition(4))
    assert out.columns == ["page_id", "url", "html", "text"]
    got = {r.page_id: r.text for r in out.collect()}
    want.pop(61), got.pop(61)
    assert got == want
    assert "Home" not in got[1] and note not in got[1] and len(got[1]) > 20


def test_empty(spark):
    assert ht.extract(spark.createDataFrame([], "url string, html string")).count() == 0
    odd = spark.createDataFrame([(None, None), ("http://[bad", "<p>x</p>"), ("http://[bad", "<p>x</p>")], "url string, html string")
    assert sorted(r.text for r in ht.extract(odd).collect()) == ["", "x", "x"]


def test_query(spark, llm):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = llm["op2_html_text"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner.replace("<br>", " ")))
        parts = [" ".join(html.unescape(p).split()) for p in parts]
        assert r.text == "\n\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_suffix_array_is_in_order():
    rng = np.random.default_rng(4)
    tokens, host = rng.integers(0, 3, 400).astype(np.uint64), np.repeat([1, 0], [150, 250])
    for run in (1, 2, 5, 6, 7):
        order, agrees = ht.suffix_array(tokens, host, run)
        begin = [(host[i], tokens[i : i + run].tolist()) for i in range(400)]
        assert order.tolist() == sorted(range(400), key=lambda i: begin[i])
        assert agrees.tolist() == [k > 0 and begin[order[k]] == begin[order[k - 1]] for k in range(400)]


def test_every_page_is_in_the_array_of_its_host(spark):
    """What a page without a mark shares with the menu of a marked one goes; the marked article stays whole."""
    menu, body = "Start News Sports Weather Money Travel Contact", "one two three four five six seven eight nine"
    marked = f"<nav>{menu}</nav><article><p>{body}</p></article>"
    rows = [
        (1, "http://a.org/1", marked), (2, "http://a.org/2", f"<div>{menu}</div><div>quite other words here</div>"),
        (3, "http://b.org/3", f"<div>{menu}</div>"), (4, "http://a.org/4", f"<article>{body}</article>"),
        (5, None, f"<div>{menu}</div>"), (6, "http://a.org/6", None),
    ]
    want = {1: body, 2: "quite other words here", 3: menu, 4: body, 5: menu, 6: ""}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (1, ht.PACK_BYTES):
        out = ht.extract(df, keep=["PAGE_ID"], pack_bytes=most)
        assert out.columns == ["page_id", "text"]
        assert {r.page_id: r.text for r in out.collect()} == want


def test_hosts_in_several_packs(spark):
    """A host that is dealt out gives what it gives in one pack, which is what brute force gives."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    lines = [" ".join(rng.choices(words, k=rng.randrange(2, 12))) for _ in range(12)]
    pages = []
    for _ in range(40):
        own = [" ".join(rng.choices(words, k=rng.randrange(1, 14))) for _ in range(3)]
        pages.append(rng.sample(lines, 3) + own)
    pages += pages[:6]
    rows = [(i, "http://a.org/x", "".join(f"<div>{b}</div>" for b in p), [i]) for i, p in enumerate(pages)]
    want = {}
    for i, flags in enumerate(plain_repeats(pages)):
        want[i] = "\n\n".join(ht.unique_blocks(pages[i], np.array(flags)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, more array<int>")
    # In one task, the copies of a page are told apart from its first one.
    for frame, most in [(df, 400), (df, 3000), (df.coalesce(1), 400), (df.coalesce(1), 3000), (df, ht.PACK_BYTES)]:
        got = ht.extract(frame, pack_bytes=most).collect()
        assert {r.page_id: r.text for r in got} == want
        assert all(r.more == [r.page_id] and r.html == rows[r.page_id][2] for r in got)
    assert any(len(t.split("\n\n")) < 6 for t in want.values()) and any(want.values())
