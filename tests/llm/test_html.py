"""Main text: zones by markup, and what the host suffix array decides where markup is silent."""

import random

import pytest

pytest.importorskip("strandline.llm")
from strandline.llm import html_text  # noqa: E402
from strandline.llm.html_text import extract_text, main_text  # noqa: E402

from .fixtures import prose  # noqa: E402


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><h1>Head &amp; line</h1><p><b>one\n two<br>three<p>four</article><footer>no</footer>", "Head & line\none two three\nfour"),
        ("<nav><ul><li>x</li></ul></nav><main><p>a</p><div class='ad'>buy <div>now</div></div><p>b</p><aside>c</aside></main>", "a\nb"),
        ("<article><p>a</p><section class='comments'><article class=comment>hi</article></section></article>", "a"),
        ("<article><header><h2>own</h2></header><form>f</form>t<script>var a='<p>';</script><!-- <p>c -->u</article>", "own\nt\nu"),
        ("<nav>never closed <article>text</article>", "text"),
        ("<article>1 &lt; 2 &#233; &nbsp;x &unknown; &am", "1 < 2 é x &unknown; &am"),
        ("<article><p title='a > b' hidden>stays too</p><p title=\"a > b\">stays</p></article", "stays too\nstays"),
        ('<article><div class="section-header"><p>Heading text</p></div><p class="related-work">Kept</p><p hidden>H</p><div class="ad-box">no</div><div id="cookie-notice">no</div><p>end</p></article>', "Heading text\nKept\nH\nend"),
        ("<div role=main><p>x</p></div><p>outside</p>", "x"),
        ("<p>only</p><p>open</p>", "only\nopen"),
        ("<article>a < b <p", "a < b"),
        ("", ""),
    ],
)
def test_zones(page, want):
    assert main_text(page) == want


def test_host_suffix_array(spark):
    notice, other = prose(1, 12), prose(2, 12)
    rows = [(i, f"http://www.h.org/{i}", f"<p>{notice}</p><p>{prose(10 + i, 20)}</p><div>{other}</div>") for i in range(5)]
    rows += [(10 + i, "http://copy.org/x", f"<p>{prose(50, 15)}</p>") for i in range(3)]  # copies of one page
    rows += [(20, "http://else.org/a", f"<p>{notice}</p>")]  # another host's text is no evidence
    rows += [(30, "http://mix.org/a", f"<nav>{notice}</nav><article>{other}</article>"), (31, "http://mix.org/b", f"<p>{notice}</p><p>{prose(60, 9)}</p><p>{other}</p>")]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == prose(10 + i, 20) for i in range(5))
    assert all(got[10 + i] == prose(50, 15) for i in range(3)) and got[20] == notice
    assert got[30] == other and got[31] == f"{prose(60, 9)}\n{other}"  # a marked menu is evidence, an article is not


def test_runs_inside_containers(spark):
    notice, story = prose(1, 12), [prose(100 + i, 30) for i in range(9)]
    page = lambda i, *blocks: (i, f"http://www.h.org/{i}", f"<nav>{prose(3, 8)}</nav><article>{''.join(f'<div>{b}</div>' for b in blocks)}</article>")
    rows = [page(i, story[i], notice) for i in range(3)]
    rows += [page(3, story[3]), (4, "http://www.h.org/4", f"<p>advert</p><article><div>{story[3]}</div></article>")]  # copies of one text
    rows += [page(5, story[4], story[5], "one end"), page(6, story[4], story[5], "another end")]  # near copies
    rows += [(7, "http://else.org/a", f"<article><p>{notice}</p><p>{story[6]}</p></article>")]  # another host
    rows += [(8, "http://www.h.org/8", f"<!-- <article> --><p>{notice}</p><p>{story[7]}</p>"), (9, "http://www.h.org/9", f"<p>{notice}</p><p>{story[8]}</p>")]  # no container but in a comment
    rows += [(None, "http://www.h.org/n", f"<article><p>{notice}</p><p>{story[8]}</p></article>")]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [got[i] for i in range(3)] == story[:3] and got[None] == story[8]
    assert got[3] == got[4] == story[3] and got[7] == f"{notice}\n{story[6]}"
    assert got[5] == f"{story[4]}\n{story[5]}\none end" and got[6] == f"{story[4]}\n{story[5]}\nanother end"
    assert got[8] == story[7] and got[9] == story[8]


def _brute(rows):
    """Main texts by all substrings: a token is covered when RUN tokens around it stand in enough of the host's different texts."""
    streams = {}
    for i, blocks in rows.items():
        streams.setdefault(" ".join(blocks), []).append(i)
    least = max(html_text.LEAST, html_text.SHARE * len(streams))
    runs = {}
    for text in streams:
        words = text.split()
        for a in range(len(words) - html_text.RUN + 1):
            runs.setdefault(tuple(words[a : a + html_text.RUN]), set()).add(text)
    want = {}
    for text, ids in streams.items():
        words, covered = text.split(), set()
        for a in range(len(words) - html_text.RUN + 1):
            if len(runs[tuple(words[a : a + html_text.RUN])]) >= least:
                covered |= set(range(a, a + html_text.RUN))
        kept, at = [], 0
        for b in rows[ids[0]]:
            n = len(b.split())
            if len(covered & set(range(at, at + n))) < html_text.COVERED * n:
                kept.append(b)
            at += n
        whole = 2 * sum(len(b.split()) for b in kept) < len(words)
        want.update({i: "\n".join(rows[ids[0]] if whole else kept) for i in ids})
    return want


@pytest.mark.parametrize("sent", [4_000_000, 0])
def test_suffix_array_against_all_substrings(spark, sent):
    """Template paragraphs inside articles go, quotations and copies stay; without the array nothing would."""
    rng = random.Random(9)
    template = [prose(500 + k, rng.randint(12, 40)) for k in range(4)]
    quotes = [prose(600 + k, 25) for k in range(3)]
    rows = {}
    for i in range(24):
        blocks = [prose(700 + 10 * i + k, rng.randint(3, 40)) for k in range(4)] + [t for t in template if rng.random() < 0.6] + [q for q in quotes if rng.random() < 0.1]
        rng.shuffle(blocks)
        rows[i] = blocks
    rows |= {100 + i: rows[3] for i in range(30)}  # copies are one text
    frame = spark.createDataFrame([(i, f"http://h.org/{i}", "<article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>") for i, blocks in rows.items()], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in extract_text(frame, sent).collect()}
    assert got == _brute(rows)
    assert sum(got[i] != "\n".join(b) for i, b in rows.items()) > 15 and all(t in got[7] for t in rows[7] if t not in template)
