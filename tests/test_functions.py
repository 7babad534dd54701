import random
import re

import pytest
from pyspark.sql import functions as F

from recordlake import FieldSpec, RecordSpec
from recordlake.functions import html
from recordlake.functions.contacts import emails, preferred_email
from recordlake.functions.headings import first_heading, name_heading
from recordlake.functions.html import drop_boilerplate, to_markdown, unescape
from recordlake.functions.names import best_name, is_error_title, is_org_name
from recordlake.functions.text import compact, parse_json, replace, strip
from recordlake.functions.urls import (
    canonical_url,
    host_name,
    host_of,
    is_binary_url,
    is_blocked_url,
    is_free_mail,
    is_site_search,
    registrable_host,
)


def test_field_names():
    assert FieldSpec("Company Name").name == "company_name"
    with pytest.raises(ValueError):
        FieldSpec("--")
    with pytest.raises(ValueError):
        RecordSpec.of([])
    with pytest.raises(ValueError):
        FieldSpec("x", "decimal")
    spec = RecordSpec.of([("Tech Stack", "array"), ("org", "string", True)])
    assert spec.headers == ["tech_stack", "org"]
    assert spec.struct["org"].metadata["required"] is True
    assert spec.name_field.name == "org"


@pytest.mark.parametrize(
    "url, want",
    [
        (" https://Quay.IO/a/b/ ", "https://quay.io/a/b"),
        ("https://quay.io", "https://quay.io/"),
        ("https://quay.io/a#top", "https://quay.io/a"),
        ("https://quay.io/a?utm_source=x&b=2&refresh=1&GCLID=3", "https://quay.io/a?b=2"),
        ("https://quay.io/a?b=&c", "https://quay.io/a"),
        ("https://quay.io/a?q=one+two%2Cthree&t=~", "https://quay.io/a?q=one+two%2Cthree&t=~"),
        ("https://quay.io/a?q=50%", "https://quay.io/a?q=50%25"),
    ],
)
def test_canonical_url(value, url, want):
    assert value(canonical_url("u"), u=url) == want


def test_hosts(value):
    assert value(host_of("u"), u="https://me@WWW.Quay.io:80/x") == "www.quay.io"
    assert value(host_of("u"), u="not a url") == ""
    assert value(registrable_host("u"), u="www.a.quay.co.in") == "co.in"
    assert value(registrable_host("u"), u="localhost") == ""
    assert value(host_name("u"), u="www.quay.io") == "Quay"
    assert value(host_name("u"), u="ab.io") is None
    assert value(host_name("u"), u="123.io") is None


def test_url_filters(value):
    blocked = [
        "https://us.search.yahoo.com/search?p=x",
        "https://news.google.com/search?q=x",
        "https://x.com/search?q=x",
        "https://en.wikipedia.org/w/index.php?search=x",
    ]
    assert all(value(is_blocked_url("u"), u=u) for u in blocked)
    assert not value(is_blocked_url("u"), u="https://quay.io/members")
    assert value(is_binary_url("u"), u="https://quay.io/a.PDF?x=1")
    assert not value(is_binary_url("u"), u="https://quay.io/pdf")
    assert value(is_site_search("u"), u="https://imgs.test/search?q=a")
    assert value(is_site_search("u"), u="https://imgs.test/en/search/?q=a")
    assert not value(is_site_search("u"), u="https://imgs.test/research?q=a")


def test_free_mail(value):
    assert value(is_free_mail("d"), d="yahoo.co.in")
    assert value(is_free_mail("d"), d="gmail.com")
    assert not value(is_free_mail("d"), d="quay.io")


@pytest.mark.parametrize(
    "name, good",
    [
        ("Saltmarsh", True),
        ("Plover Barges Oy", True),
        ("Ebb & Flow", True),
        ("Top Ferry Operator in Turku", False),  # a superlative and a place
        ("Best Boat Hire Company", False),  # a superlative before a trade word
        ("Your one stop for boats!", False),  # a sentence
        ("Search the passenger lists", False),
        ("\U0001f6a2 Grebe Line", False),  # a pictogram
        ("페리 회사", False),  # no Latin letter
        ("Is this it?", False),
        ("far too many words for any name here", False),
        ("", False),
        (None, False),
    ],
)
def test_org_name(value, name, good):
    assert value(is_org_name("n"), n=name) is good


def test_best_name(value):
    sql = best_name("t", "h", "u")
    url = "https://seaviews.com/"
    assert value(sql, t="Quay Works |", h="", u=url) == "Quay Works"
    assert value(sql, t="Contact us!", h="Quay Works", u=url) == "Quay Works"
    assert value(sql, t="AI-Driven Digital Marketing Agency for Online Visibility", h="", u=url) == "Seaviews"


def test_error_titles(value):
    for title in ("REQUEST DENIED!", "Just a moment...", "403 Forbidden", "error 502"):
        assert value(is_error_title("t"), t=title)
    for title in ("Quay Works", "", None):
        assert not value(is_error_title("t"), t=title)


def test_emails(value):
    assert value(emails("t"), t="a@b.io,c@d.co and e@f") == ["a@b.io", "c@d.co"]
    assert value(emails("t"), t="x@quay.com_next@pier.org") == ["x@quay.com", "_next@pier.org"]
    text = "Mail info@vendor.test or founder@otherco.io"
    assert value(preferred_email("t", "h"), t=text, h="www.otherco.io") == "founder@otherco.io"
    assert value(preferred_email("t", "h"), t="a@gmail.com b@firm.io", h="x.test") == "b@firm.io"
    assert value(preferred_email("t", "h"), t="write to test@example.com", h="x.test") is None
    assert value(preferred_email("t", "h"), t="verified@acme.io or hi@web.com", h="") == "hi@web.com"


def test_email_scan_is_linear(value):
    assert value(emails("t"), t="x" * 400_000 + " a@b.io") == ["a@b.io"]


def test_headings(value):
    assert value(first_heading("m"), m="text\n### Deep\n# Top") == "Deep"
    assert value(name_heading("m"), m="text\n### Deep\n# Top") == "Top"
    assert value(first_heading("m"), m="\n\n  plain line \nnext") == "plain line"
    assert value(name_heading("m"), m="plain") is None


def test_small_text_helpers(value):
    assert value(strip("t"), t=" \n x  ") == "x"
    assert value(compact("t"), t="Company-Name 2") == "companyname2"
    assert value(f"cast({parse_json('t')} AS STRING)", t='{"a":1}') == '{"a":1}'
    for bad in ('{"a":1} x', '{"a":1}\n{"b":2}', "1,2", "1],[2", ""):
        assert value(f"{parse_json('t')} IS NULL", t=bad)


@pytest.mark.parametrize(
    "raw, want",
    [
        ("a &amp; b", "a & b"),
        ("&lt;p&gt; &quot;x&quot; &apos;", "<p> \"x\" '"),
        ("&#65;&#x42;&#128;&#0;&#1114112;", "AB€��"),
        ("&copy 2026 &copy2 &nosuch; &", "© 2026 ©2 &nosuch; &"),
        ("&euro;&hellip;&#128512;", "€…\U0001f600"),
    ],
)
def test_entities(value, raw, want):
    assert value(unescape("t"), t=raw) == want


def _markdown(value, html, base="https://host.test/a/b?c=d", scope="element"):
    return value(to_markdown(f"({drop_boilerplate('h', scope)})", "base"), h=html, base=base)


@pytest.mark.parametrize(
    "html, want",
    [
        ("<h2>T</h2><p>x<br>y</p>", "## T\n\nx\ny"),
        ("<b>x</b> <em>y</em> <code>z</code>", "**x** *y* `z`"),
        ("<ul><li>a</li><li>b</li></ul>", "- a\n - b"),
        ("<img alt='pic' src=x><img src=y>", "![pic]"),
        ('<a href="/x?y=1&amp;z=2">go</a>', "[go](https://host.test/x?y=1&z=2)"),
        ("<a href='../up'>u</a>", "[u](https://host.test/up)"),
        ("<a href=?q=1>u</a> <a href=#f>v</a>", "[u](https://host.test/a/b?q=1) [v](https://host.test/a/b?c=d#f)"),
        ("<a href='//o.test/z'>o</a> <a>n</a>", "[o](https://o.test/z) [n](https://host.test/a/b?c=d)"),
        ("<a href='mailto:x@y.io'>m</a>", "[m](mailto:x@y.io)"),
        ("<p title='a>b'>kept</p>", "kept"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("<!DOCTYPE html><!-- <p>no</p> --><p>yes</p>", "yes"),
        ("<script>if (a<b) '</p>'</script>x<style>p{}</style>", "x"),
        ("a<nav>b<nav>c</nav>d</nav>e", "ae"),
        ("a<nav>b<form>c</nav>d</form>e", "ae"),
        ("a</nav>b<svg/>c", "abc"),
        ("a<header><nav>x</nav>y</header>b<aside>z", "ab"),
        ("<title>T</title>body", "body"),
        ("x &amp;amp; y", "x & y"),
    ],
)
def test_markdown(value, html, want):
    assert _markdown(value, html) == want


def test_banner_scopes(value):
    html = "a<div class='cookie-bar'><div>x</div>y</div>b<div id=main>c</div>"
    assert _markdown(value, html) == "abc"
    assert _markdown(value, html, scope="rest") == "a"


def test_tables(value):
    html = (
        "<table><tr><th>A</th><th> B\n b </th></tr><tr><td></td></tr>"
        "<tr><td><b>1</b></td></tr><tr><td>2</td><td>3</td><td>4</td></tr></table>"
    )
    assert _markdown(value, html) == "| A | B b | |\n| --- | --- | --- |\n| **1** | | |\n| 2 | 3 | 4 |"


def test_skip_depth_against_a_counter(spark):
    """Random tag soup against a plain depth counter, beyond one block of tags too."""
    import random
    import re

    from pyspark.sql import functions as F

    rng = random.Random(7)
    pages = []
    for n in (3, 10, 40, 300, 900):
        for _ in range(6):
            pages.append("".join(rng.choice(["<nav>", "</nav>", "<form>", "</form>", "<svg/>", "w", "."]) for _ in range(n)))

    def counted(page):
        depth, out = 0, []
        for piece in re.split("(<[^>]*>)", page):
            if piece.startswith("</"):
                depth = max(0, depth - 1)
            elif piece.startswith("<"):
                depth += 0 if piece.endswith("/>") else 1
            elif depth == 0:
                out.append(piece)
        return "".join(out)

    rows = spark.createDataFrame([(p,) for p in pages], "h string")
    got = [r[0] for r in rows.select(F.expr(drop_boilerplate("h"))).collect()]
    assert got == [counted(p) for p in pages]


def test_walk_over_blocks(value):
    """States carry over the edges of blocks; a page without tags has no outputs."""
    from recordlake.functions.html import _BLOCK, _walk

    def move(s, c):
        return {"a": c if c < 2 else s["a"], "b": 1 - s["b"] if c == 3 else s["b"]}, 2 * s["a"] + s["b"]

    n = 3 * _BLOCK + 7
    codes, state, want = [i * i % 7 % 4 for i in range(n)], {"a": 0, "b": 0}, []
    for c in codes:
        state, out = move(state, c)
        want.append(out)
    text = f"array_join({_walk(f'transform(sequence(0, {n - 1}), i -> CAST(i * i % 7 % 4 AS INT))', 4, 'ab', move)}, '')"
    assert value(text) == "".join(map(str, want))
    assert value(f"CAST(size({_walk('CAST(array() AS ARRAY<INT>)', 4, 'ab', move)}) AS STRING)") == "0"


def _outside_skipped(page):
    """The page by a walk over its skip tags."""
    out, depth, at = "", 0, 0
    for tag in re.finditer(html._SKIP, page, re.A):
        out += page[at : tag.start()] if depth == 0 else ""
        at = tag.end()
        if tag[0].startswith("</"):
            depth = max(depth - 1, 0)
        elif not tag[0].endswith("/>"):
            depth += 1
    return out + (page[at:] if depth == 0 else "")


def test_skip_elements_side_by_side_need_no_walk(value):
    page = "a<nav x='>'>b</nav>c<FORM><p>d</p></footer>e"
    assert value(replace("page", html._FLAT_SKIP, "$1"), page=page) == "ace" == _outside_skipped(page)


def test_skip_elements_equal_the_walk(spark):
    pick = random.Random(3)
    parts = ["<nav>", "</nav>", "<nav/>", "<NAV x>", '<form a="<nav></nav>">', "</footer >", "<", "<na", "v>", "a", '"', ">", "='", "<p>", "<nav a="]
    pages = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 12))) for _ in range(1500)]
    rows = spark.createDataFrame([(p,) for p in pages], "page string")
    for r in rows.select("page", F.expr(html.drop_boilerplate("page")).alias("kept")).collect():
        assert r["kept"] == _outside_skipped(r["page"]), r["page"]


def test_text_of_tags_is_the_same_in_one_pass(spark):
    """Pages with and without a tag that needs the longer way."""
    pick = random.Random(4)
    parts = ["<p>", "</P>", "<b>", "</b>", "<h2 id=1>", "</h2>", "<br/>", "<x>", "<", "a ", "<code >", "</a>", "<imgx>", "<tr>", "<td>", "</td>"]
    pages = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 12))) for _ in range(600)]
    rows = spark.createDataFrame([(p + "> ", p + "> <li>") for p in pages], "short string, long string")
    both = [F.expr(html._render_tags(c)).alias(c) for c in ("short", "long")]
    for r in rows.select(F.col("short").alias("page"), *both).collect():
        assert r["long"] == r["short"] + "\n- ", r["page"]
