"""Main text of pages with known parts."""

from fernglass.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href=x>Home</a></li></ul></nav><div class="content c%d"><h2>Head &eacute;</h2><p>One  two<br>three <a href=y>link</a>.<p>Second <b>bold</b> &lt;p&gt;<ul><li>a</li><li>b</li></ul>
<form><input><p>Subscribe</p></form><div class="ad-box"><p>Buy!</p></div></div><aside><p>Aside</p></aside><section id="comments"><article><p>nice!</p></article></section><div class="cookie-notice">We use cookies</div><footer>&copy;</footer></body></html>"""
TEXT = "Head é\nOne two three link.\nSecond bold <p>\na\nb"


def test_parts():
    assert H.extract(PAGE % 7, []) == TEXT
    assert H.best_path(PAGE % 7)[0] == "html/body.has-sidebar/div.c#.content"


def test_unclosed_and_broken():
    assert H.extract("<p>a<p>b</div><p>c", []) == "a\nb\nc"
    assert H.extract("<nav><ul><li><a>m</a><article><h1>T</h1><p>x</p></article>", []) == "T\nx"
    assert H.extract("plain & text", []) == "plain & text"
    assert H.extract("<p title='a>b'>x</p><p class=\"q>y</p>", []) != ""
    assert H.extract("<script>x", []) == ""
    assert H.extract("a<!-- b --> c", []) == "a c"
    assert H.extract("<article><p>a</p></article><article class=comment><p>b</p></article>", []) == "a"


def test_wrappers_named_for_what_is_beside_the_text():
    body = "<h1>Head</h1><p>" + "The story goes on here. " * 8 + "</p><p>It ends.</p>"
    text = "Head\n" + ("The story goes on here. " * 8).strip() + "\nIt ends."
    title, side = "<div>Site title</div>", "<div class='sidebar widget'><p>Latest posts</p></div>"
    for wrapper in ("content-sidebar-wrap", "layout-right-sidebar", "post category-social tag-notice"):
        assert H.extract(f"<body>{title}<div class='{wrapper}'><article>{body}</article>{side}</div></body>", []) == text
        assert H.extract(f"<body>{title}<div class='{wrapper}'><main>{body}</main>{side}</div></body>", []) == text
        assert H.extract(f"<body>{title}<div class='{wrapper}'><div class=entry>{body}</div>{side}</div></body>", []) in (text, f"Site title\n{text}")
    assert H.extract(f"<table><tr><td>{title}</td></tr><tr><td class=main-sidebar><div class=entry>{body}</div></td></tr></table>", []).endswith(text)
    assert H.extract(f"<article>{body}</article><div class=sidebar><article><p>{'A teaser. ' * 90}</p></article></div>", []) == text
    assert H.extract(f"<div class=entry>{body}</div><section id=comments><article><p>{'I say. ' * 90}</p></article></section>", []) == text


def test_other_attributes_are_no_names():
    assert H.extract('<div data-id="sidebar" data-class="promo" data-role="navigation" title="x class=ad"><p>text</p></div><p>a</p>', []) == "text\na"
    assert H._named("hidden CLASS='A b' data-id=c ID = d role=main/") == (["a", "b", "d"], "main/")


def test_pages_vote_by_host(spark):
    rows = [(i, f"http://h.example/{i}", PAGE % i) for i in range(20)]
    odd = "<html><body><div class='content c99'><p>short</p></div><div class=other><p>" + "long text " * 30 + "</p></div></body></html>"
    rows += [(20, "https://H.example:80/x", odd), (21, None, PAGE % 1), (22, "http://h.example/null", None), (22, "http://h.example/null", ""), (None, "bad url", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as host", "3 as paths")
    got = H.extract_pages(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert all(by[i].text == TEXT and by[i].n_chars == len(TEXT) for i in [*range(20), 21])
    assert by[20].text == "short\n" .strip() or "long text" in by[20].text
    assert by[22].text == "" and by[22].n_chars == 0 and by[None].text == "x"
    paths = {r.host: r.paths for r in H.host_paths(df.select("page_id", "url", "html")).collect()}
    assert paths["h.example"][0] == "html/body.has-sidebar/div.c#.content"
    assert H.extract_pages(df.limit(0)).collect() == []


def made_page(rnd, host: int):
    """A page whose text is known: an article in a template of its host, with what isn't text around and inside it, and names
    from the list of boilerplate on wrappers of the text."""
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(3, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    links = lambda n: "".join(f'<li><a href="/{word()}">{line(2)}</a></li>' for _ in range(n))
    blocks = [f"{line(rnd.randrange(12, 40))} &amp; {line(8)}." for _ in range(rnd.randrange(3, 9))]
    body = "".join(f"<p>{b.replace(' ', chr(10) + '  ', 1)}</p>" for b in blocks)
    junk = [f'<script>var x = "<p>{line(5)}</p>";</script>', f"<style>.x {{ }}</style><!-- {line(6)} -->", f'<div class="ad-slot"><p>{line(9)}</p></div>', f"<form><label>{line(3)}</label><input></form>"]
    inner = body.replace("</p>", "</p>" + rnd.choice(junk), 1)
    wrappers = ("layout-right-sidebar", "content-sidebar-wrap", "post category-social tag-notice", "share-price", "notice-board")
    wrap = [f'<div class="{wrappers[host % 5]} a{host} b c d e f{rnd.randrange(99)}"><article>{inner}</article></div>', f'<main id="m"><div class="{wrappers[host % 5]}">{inner}</div></main>', f'<div class="page"><div class="entry-content">{inner}</div></div>'][host % 3]
    comments = "".join(f'<div class="comment"><p>{line(14)}</p></div>' for _ in range(rnd.randrange(0, 4)))
    title = f"<title>{line(4)}</title>"
    page = f'<html><head>{title}</head><body><div class="logo">{line(2)}</div><nav><ul>{links(6)}</ul></nav><header><p>{line(4)}</p></header>{wrap}<section id="comments">{comments}</section><aside class="sidebar"><p>{line(10)}</p></aside><div class="cookie-notice">{line(9)}</div><footer><p>{line(6)}</p></footer></body></html>'
    return page, "\n".join(" ".join(b.replace("&amp;", "&").split()) for b in blocks)


def test_made_pages(spark):
    """Pages of fifteen templates beside the text that they were made from."""
    import random

    rnd = random.Random(1)
    made = [(i, f"https://host{i % 15}.example/{i}", *made_page(rnd, i % 15)) for i in range(300)]
    df = spark.createDataFrame([m[:3] for m in made], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract_pages(df).collect()}
    wrong = [i for i, _, _, text in made if got[i] != text]
    assert not wrong, (len(wrong), wrong[:5], got[wrong[0]], made[wrong[0]][3])


def test_deep_pages_take_linear_time():
    import time

    for page in ("<div>x" * 50_000, "<div class='sidebar'>x" * 50_000, "<div>x" * 50_000 + "</p></section>" * 50_000, "<li><foo>" * 20_000 + "<li></li>" * 50_000):
        H.extract(page, [])
        began = time.process_time()
        H.best_path(page)
        H.extract(page, ["div/div"])
        assert time.process_time() - began < 10


def test_paths_hold_all_names():
    page = lambda c: f'<body><div class="a b c d {c}"><p>{"word " * 30}</p></div></body>'
    assert H.best_path(page("e"))[0] != H.best_path(page("f"))[0]
    assert H.best_path(page("e7"))[0] == H.best_path(page("e8"))[0]


def test_broken_tags_take_linear_time():
    """A megabyte of tags that nothing closes; what isn't in a tag stays text."""
    import time

    for unit in ('<a "', "<svg x", "<!-- ", '<a href="<b>', '<a "x>', "<script ", "<a b='\"", "</svg "):
        for tail in ("", ">", '"', "'>"):
            page = "<p>some text before</p>" + unit * (1_000_000 // len(unit)) + tail
            began = time.process_time()
            got = H.extract(page, [])
            assert time.process_time() - began < 2 and got.startswith("some text before"), (unit, tail)


def test_markup_in_order():
    page = "a<b>c</b ><!-- <i> --><script>if (a<b) '</p>'</script><p title='x>y' id=\"<\">d<br/>&lt;<1 <x"
    got = [(page[s:e], closing, tag) for s, e, closing, tag, _ in H._tokens(page)]
    assert got == [("<b>", "", "b"), ("</b >", "/", "b"), ("<!-- <i> -->", "", None), ("<script>if (a<b) '</p>'</script>", "", None), ("<p title='x>y' id=\"<\">", "", "p"), ("<br/>", "", "br")]
    # a quote that isn't closed ends at the next bracket
    assert [tag for *_, tag, _ in H._tokens("<p class=\"q>y</p><b>z</b>")] == [None, "p", "b", "b"]
    assert [tag for *_, tag, _ in H._tokens("x <!-- never closed <b>")] == [None]
