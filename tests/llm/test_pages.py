import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliograph.llm import pages

SCHEMA = "page_id long, url string, html string"


def text(html, other=None):
    t, k = pages.lines(html)
    return pages.main_text(t, k, pages.lines(other)[0] if other else None)


@pytest.mark.parametrize(("html", "want"), [
    ("<article><h1>T &amp; x</h1><p>a\n  b<b>c</b></p><p>d<br>e</article>", "T & x\na bc\nd\ne"),
    ("<nav>menu</nav><div class='ad-box'>buy</div><article><p>keep</p><div class=comments><p>no</p></div><form>f</form><aside>s</aside><footer>f</footer></article><footer>end</footer>", "keep"),
    ("<article><p>a<p>b<script>var t='</p>';</script><style>x{}</style><!-- <p>c</p> --></article>", "a\nb"), ("", ""), ("plain", "plain"), ("<p>unclosed <b>bold", "unclosed bold"),
    ("<main><p>&#233;&nbsp;&#x41; &lt;tag&gt; &copy &unknown;</p></main>", "é A <tag> © &unknown;"), ("<article><header><h1>t</h1></header><p>x</p></article><header>site</header>", "t\nx"),
    ("<div role=main><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></div>", "a\nb\n1\n2"), ("<article><p hidden>h</p><p style='display: none'>n</p><p>v</p></article>", "v"),
    ("<article><p title='a > b'>q</p></article", "q"), ("<article>one<hr/>two</article>", "one\ntwo"), (None, ""), ("<title>t</title><body>x</body>", "x"), ("<article><p>a < b and c</p></article>", "a < b and c"),
])
def test_markup(html, want):
    assert text(html) == want


def test_shared_lines_go_outside_articles():
    page, other = "<div>Site</div><p>own</p><div>Bottom</div>", "<div>Site</div><p>else</p><div>Bottom</div>"
    assert text(page, other) == "own" and text(page, page) == "Site\nown\nBottom"
    assert text("<p>Site</p><article><p>same</p></article>", "<p>Site</p><article><p>same</p></article>") == "same"


def test_shared_bare_lines_of_an_article_go_and_its_prose_stays():
    page = "<article><div>Site line</div><p>same</p><blockquote>quoted</blockquote>own words<div>Share this</div></article>"
    other = "<article><div>Site line</div><p>same</p><blockquote>quoted</blockquote>other words<div>Share this</div></article>"
    assert text(page, other) == "same\nquoted\nown words" and text(page) == "Site line\nsame\nquoted\nown words\nShare this"
    assert text("<article>a<div>b</div></article>", "<article>a<div>b</div></article>") == "a\nb"


def test_a_teaser_is_not_the_whole_page():
    page = "<div>Site</div><div>" + "body " * 40 + "</div><article>Read on</article><div>" + "more " * 40 + "</div><div>Bottom</div>"
    other = "<div>Site</div><div>else</div><article>Read this</article><div>Bottom</div>"
    assert text(page, other) == "\n".join([("body " * 40).strip(), "Read on", ("more " * 40).strip()])
    assert text("<div>Site</div><article>" + "body " * 40 + "</article><p>note</p>", other) == ("body " * 40).strip()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=10), st.lists(st.sampled_from("abcd"), max_size=10))
def test_longest_common_subsequence(a, b):
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
    got = pages.shared(a, b)
    assert len(got) == n[-1][-1]
    rest = iter(b)
    assert all(a[i] in rest for i in sorted(got))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<>/pdivb!-&;=\"' a", max_size=60))
def test_any_markup_parses(html):
    pages.lines(html)


def brute(rows):
    """Every page against its nearest neighbour in its host's order by path."""
    import re

    hosts = {}
    for r in rows:
        m = re.match(r"^(?:[A-Za-z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*([^?#]*)", r[1] or "")
        hosts.setdefault(m[1].lower() if m else "", []).append((m[2] if m else re.match("[^?#]*", r[1] or "")[0], r[0], r[2]))
    out = {}
    for own in hosts.values():
        own.sort(key=lambda x: (x[0], x[1]))
        for i, (path, key, html) in enumerate(own):
            near = [own[j] for j in (i - 1, i + 1) if 0 <= j < len(own)]
            alike = lambda x: next((n for n, (a, b) in enumerate(zip(x, path)) if a != b), min(len(x), len(path)))  # noqa: B023, E731
            other = max(near, key=lambda x: alike(x[0])) if near else None
            out[key] = text(html, other[2] if other else None)
    return out


def site(n=120, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        host = rng.choice(["http://a.com", "https://B.org:80", "//c.net", ""])
        rows.append((i, f"{host}/{rng.choice(['x', 'y'])}/{rng.randrange(40)}?q=1", f"<div>{host}</div><p>text {rng.randrange(60)}</p><p>more {i}</p><div>end {rng.randrange(3)}</div>"))
    return rows


def test_pairs_by_nearest_path(spark):
    rows = site()
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_large_hosts_are_split_by_prefix_and_keep_their_pages(spark):
    rows = [(i, f"http://hot.com/en/{i % 90}", f"<p>Site</p><p>own {i}</p>") for i in range(600)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, SCHEMA), most=20).collect()}
    assert len(got) == 600 and all(got[i].endswith(f"own {i}") for i in got) and sum("Site" in t for t in got.values()) < 60


@pytest.mark.parametrize("n", [129, 700])
def test_split_hosts_pair_true_neighbours(spark, n):
    rng = random.Random(n)
    slug = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(12))
    rows = [(i, f"http://hot.com/{slug()}", f"<p>Site</p><p>own {i}</p><p>part {rng.randrange(5)}</p>") for i in range(n)]
    rows += [(n + i, f"http://hot.com/same/{'x' * 80}", f"<p>Site</p><p>own {n + i}</p>") for i in range(200)]
    rows += [(1000 + i, f"http://h{i}.com/{slug()}", f"<p>Site</p><p>own {i}</p>") for i in range(50)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 61)
    try:
        for most in (1, 128):
            got = pages.extract(spark.createDataFrame(rows, SCHEMA).repartition(3), most=most)
            assert {r.page_id: r.text for r in got.collect()} == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_nulls_repeats_empty_tables_and_extra_columns(spark):
    rows = [(1, None, "<p>a</p>"), (1, None, "<p>a</p>"), (None, "http://h/x", None), (2, "http://h/x", ""), (3, "::bad::", "<p>" + "word " * 50_000 + "</p>")]
    got = pages.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5 and sorted(len(r.text) for r in got) == [0, 0, 1, 1, 249_999]
    assert pages.extract(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "http://h/x", "<p>a</p>", "old", 7)], SCHEMA + ", text string, host int")
    assert pages.extract(df).first().asDict() == {"page_id": 1, "url": "http://h/x", "host": 7, "text": "a"}
