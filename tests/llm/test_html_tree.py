"""The style tree against a plain version, and on pages where names say nothing."""

import math
import random
import time
from collections import Counter, defaultdict

import pytest

from chronoweave.llm import html
from chronoweave.llm.common import Work

WORDS = "river stone tower green field people spring old bridge road light winter house garden north".split()


def site(n, seed=1):
    """Pages whose classes say nothing: a list of links, a slogan of three, the story, a line at the foot."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        prose = lambda k: " ".join(r.choice(WORDS) + str(r.randrange(300)) for _ in range(k))
        links = "".join(f"<li><a href='/x'>{prose(1)}</a>" for _ in range(5))
        story = "".join(f"<p>{prose(r.randint(8, 60))}</p>" for _ in range(r.randint(2, 6)))
        body = f"<h2>{prose(5)}</h2>{story}"
        page = f"<body><div class=k1><ul>{links}</ul></div><div class=k2>slogan {i % 3} of ours</div><div class=k3>{body}</div><div class=k4><p>All rights of {prose(2)}</p></div></body>"
        want = "\n\n".join(x.split("<")[0] for x in body.replace("<h2>", "\0").replace("<p>", "\0").split("\0")[1:])
        out.append((i, "http://a.example/", page, want))
    return out


def frame(spark, rows):
    return spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")


def test_the_tree_decides_without_names(spark):
    rows = site(24)
    df = frame(spark, rows)
    got = {r.page_id: r for r in html.extract(df).collect()}
    assert {i: got[i].text for i in got} == {r[0]: r[3] for r in rows}
    assert all(r.cut_by_tree >= 7 and r.cut_by_name == 0 for r in got.values())
    without = {r.page_id: r.text for r in html.extract(df, html.Settings(pages=10**9)).collect()}
    assert sum(without[i] != got[i].text for i in got) > len(rows) / 2


def test_importance_equals_a_plain_count(spark):
    rows = site(15, 3) + [(100 + i, "http://b.example/", "<body><article><p>one<p>two</article>", "") for i in range(4)]
    df = frame(spark, rows)
    got = {(r.host, r.node): r for r in html.style_tree(df, Work(spark, "t")).collect()}
    pages = {}
    for _, url, page, _ in rows:
        found, nodes = html.blocks(page)
        pages[html.host(url), html.copy_of(found)] = found, nodes
    hosts = defaultdict(list)
    for (h, _), p in pages.items():
        hosts[h].append(p)
    want = {}
    for h, ps in hosts.items():
        for node in {k for _, nodes in ps for k in nodes}:
            mine = [(found, nodes) for found, nodes in ps if node in nodes]
            m = len(mine)
            if m < 4:
                continue
            styles = Counter(s for _, nodes in mine for s in set(nodes[node][3]))
            contents = Counter(t for found, _ in mine for t in {x.text for x in found if node in x.path})
            words = [sum(x.words for x in found if node in x.path) for found, _ in mine]
            linked = [sum(x.linked for x in found if node in x.path) for found, _ in mine]
            c = 1 - sum(v * math.log(v, m) for v in contents.values()) / contents.total() if contents else 0.0
            p = -sum(v / styles.total() * math.log(v / styles.total(), m) for v in styles.values())
            page = sum(sum(x.words for x in found) for found, _ in ps) / len(ps)
            want[h, node] = (m, sum(words) / m / page, 0.1 * p + 0.9 * c if styles else c, sum(linked) / sum(words) if sum(words) else 0.0)
    assert got.keys() == want.keys() and len({h for h, _ in want}) == 1
    for k, (m, share, entropy, links) in want.items():
        assert got[k].pages == m and (got[k].share, got[k].entropy, got[k].links) == pytest.approx((share, entropy, links))


def test_deep_and_broken_pages_take_linear_time():
    start = time.time()
    for page in ("<div>a" * 20_000, "<div>" * 20_000 + "</p></b></div>" * 20_000, "<ul><li>" * 10_000 + "x" + "</ul>" * 20_000, "<p class='" + "nav " * 20_000 + "'>x", "a" * 3_000_000):
        found, nodes = html.blocks(page)
        html.entries(found, nodes)
        assert max((len(x.path) for x in found), default=0) <= html.DEEP
    assert time.time() - start < 5
    assert len(html.blocks("<div>a" * 20_000)[0]) == 20_000


def test_clashing_columns_and_empty_table(spark):
    from pyspark.sql import functions as F

    df = frame(spark, site(6))
    for c in ("host", "node", "verdict", "known", "salt", "text", "copy", "entries", "n_chars"):
        df = df.withColumn(c, F.lit("x"))
    assert html.extract(df).count() == 6 and html.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, want",
    [
        ("<html><head><title>x</title><body><article><p>one two</p></article></body></html>", "one two"),
        ("<html><head><meta charset=utf-8><style>p{}</style><body><p>one<p>two", "one\n\ntwo"),
        ("<p>a b</p><svg class='i'/><p>c d</p>", "a b\n\nc d"),
        ("<p>a b</p><iframe src='x'/><p>c d</p>", "a b\n\nc d"),
        ("<p>a b</p><iframe src='x'><p>c d</p>", "a b\n\nc d"),
        ("<p>a <svg viewBox='0 0 1 1'><text>icon</text></svg>b</p><p>c<svg>d</p>", "a b\n\ncd"),
        ("<article><p>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</p><object data='m'><p>fallback text</p></object></article>", "let x=2 be\n\nfallback text"),
        ("<p>pick <select><option>no</select>one</p><button>go</button><p>end</p>", "pick one\n\nend"),
        ("<p>one</p><template><p>no</p></template><noscript>no</noscript><p>two</p><template>left open", "one\n\ntwo\n\nleft open"),
        ("<p>one</p><script>if (a < b) document.write('<p>no')</script ><p>two</p><script>no end", "one\n\ntwo"),
    ],
)
def test_no_text_is_lost_to_open_tags(page, want):
    assert html._text(page, {})[0] == want


def test_many_open_tags_are_linear():
    start = time.time()
    assert html._text("<button>" * 200_000 + "<p>end", {})[0] == "end"
    assert time.time() - start < 20


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("p-1", "http://a.example/", "<p>one"), (None, None, None)], "page_id string, url string, html string")
    for s in (html.Settings(), html.Settings(most_sent=-1)):
        assert sorted((r.page_id or "", r.text) for r in html.extract(df, s).collect()) == [("", ""), ("p-1", "one")]
