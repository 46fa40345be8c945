"""Main text of web pages by consensus host paths.

Each page's containers are scored; the best one's generalised tag-class path is a vote for its host. Spark counts votes,
and every page is read again with the paths that won on its host.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.llm import common

#: A tag without angle brackets in its name and values: a try ends at the next bracket, so it costs no more than what it reads.
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][^\s/<>"']*+)((?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+')*+)>""")
_NAME, _STOP = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)"), re.compile("[>\"']")
#: Elements whose content is no markup, or that are left out as a whole.
_RAW = re.compile(r"<(script|style|noscript|template|textarea|svg|iframe|title)\b", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*+>", re.I) for t in "script style noscript template textarea svg iframe title".split()}
_ATTR = re.compile(r"""(?<![^\s"'/])([^\s"'>/=]++)\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]+)""")
# fixed values: element names of HTML, and names that pages give to what is not their text
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SELF_CLOSE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CELLS = frozenset(("td", "th"))
_P = frozenset(("p",))
_BOUNDS = frozenset("ul ol dl table div section article td".split())
_NOT_TEXT = frozenset("head nav header footer aside form button select menu dialog object canvas audio video".split())
_NOT_TEXT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer header masthead menu modal nav navbar "
    "navigation newsletter notice notices notification overlay pagination pager popup promo promoted promotion recommended related respond share sharing sidebar signup social sponsor sponsored subscribe topbar widget".split()
)
_NOT_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())
_ALWAYS = frozenset("html body main article".split())
_NEGATED = frozenset("has no with without is".split())
_COMMENTS = frozenset("comment comments commentlist disqus respond".split())
#: Characters from which a block is text rather than a label.
GOOD = 25


def _named(attrs: str) -> tuple[list[str], str]:
    """Class and id words, and the role."""
    words, role = [], ""
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role":
            role = value
        elif name in ("class", "id"):
            words += value.split()
    return words, role


def _is_boilerplate(tag: str, role: str) -> bool:
    """Whether an element is no text by its tag or role."""
    return tag not in _ALWAYS and (tag in _NOT_TEXT or role in _NOT_TEXT_ROLES)


def _is_marked(tag: str, words: list[str]) -> bool:
    """Whether an element has a name of what isn't text; a wrapper of the text may have one too."""
    if tag in _ALWAYS:
        return tag == "article" and any(p in ("comment", "comments") for w in words for p in re.split("[-_]+", w))
    for w in words:
        parts = re.split("[-_]+", w)
        if parts[0] not in _NEGATED and not _NOT_TEXT_NAMES.isdisjoint(parts):
            return True
    return False


def _holds_comments(words: list[str]) -> bool:
    parts = [re.split("[-_]+", w) for w in words]
    return any(p[0] in _COMMENTS and p[-1] not in ("open", "closed") for p in parts)


def _general(tag: str, words: list[str]) -> str:
    """Tag and names with digits generalised, names in order: what pages of one template share."""
    return tag + "".join(f".{n}" for n in sorted({re.sub(r"\d+", "#", w) for w in words}))


def _tokens(page: str):
    """Markup of a page in its order: start, end, whether it is an end tag, tag, attributes; the tag is None for comments,
    declarations, raw elements and tags that a quote breaks.

    Every character is passed once: a tag that has no end is text, as is all after the last bracket; a quote that isn't closed
    ends at the next bracket, and after one that isn't the page's tags end at their first bracket.
    """
    at, last, quotes = page.find("<"), page.rfind(">"), True
    while 0 <= at < last:
        end, closing, tag, attrs = 0, "", None, ""
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4) + 3
            end = end if end > 2 else len(page)
        elif m := _RAW.match(page, at):
            inside = page.find(">", m.end()) + 1
            close = _RAW_END[m[1].lower()].search(page, inside)
            end = close.end() if close else len(page)
        elif m := _PLAIN.match(page, at):
            end, (closing, tag, attrs) = m.end(), m.groups()
        elif m := _NAME.match(page, at):
            stop = _end_of_tag(page, m.end()) if quotes else page.find(">", m.end())
            if stop < 0:
                quotes, stop = False, page.find(">", m.end())
            else:
                closing, tag = m.groups()
                attrs = page[m.end() : stop]
            end = stop + 1
        elif page[at + 1 : at + 2] in ("!", "?", "/"):
            end = page.find(">", at) + 1
        if end:
            yield at, end, closing, tag, attrs
        at = page.find("<", max(end, at + 1))
    # a comment or declaration that is never closed, after the last bracket
    while at >= 0:
        if page.startswith("<!--", at):
            yield at, len(page), "", None, ""
            return
        at = page.find("<", at + 1)


def _end_of_tag(page: str, at: int) -> int:
    """The bracket that ends a tag, outside of quotes; -1 where a quote or the tag isn't closed."""
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        at = page.find(m[0], m.end()) + 1
        if not at:
            return -1
    return -1


def parse(page: str, by_name: bool = True):
    """Containers and blocks of a page: containers as (tag with names, parent, tag), in the order of their start tags;
    blocks as (container, text, link characters). The time is linear in the page: what is open is known by tag.

    Scripts, styles, comments and boilerplate subtrees are left out; by_name=False trusts only tags for the latter. Subtrees
    with names of boilerplate are judged when the page has been read: see _dropped.
    """
    containers, blocks = [("", -1, "")], []
    stack = [(0, "", False, False)]  # container, tag, boilerplate, marked by name
    open_at: dict[str, list[int]] = {}  # places in the stack of each tag's open elements
    bounds: list[int] = []  # and of those that end tags left out don't reach beyond
    skip, link, seen_main = 0, 0, False
    marks, plain = 0, 0  # open elements that are marked, blocks outside of such
    marked: dict[int, list[str]] = {}
    buffer: list[str] = []
    linked, at = 0, 0

    def flush():
        nonlocal linked, plain
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                plain += not marks
                blocks.append((stack[-1][0], text, min(linked, len(text))))
            buffer.clear()
        linked = 0

    def push(here: int, tag: str, bad: bool, mark: bool):
        nonlocal skip, marks
        open_at.setdefault(tag, []).append(len(stack))
        if tag in _BOUNDS:
            bounds.append(len(stack))
        stack.append((here, tag, bad, mark))
        skip += bad
        marks += mark

    def pop():
        nonlocal skip, marks
        _, tag, bad, mark = stack.pop()
        open_at[tag].pop()
        if tag in _BOUNDS:
            bounds.pop()
        skip -= bad
        marks -= mark

    def pop_to(depth: int):
        flush()
        while len(stack) > depth:
            pop()

    for start, end, closing, tag, attrs in _tokens(page):
        if not skip and start > at:
            text = _html.unescape(page[at:start])
            buffer.append(text)
            if link:
                linked += len(text)
        at = end
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br" or tag == "wbr":
            if tag == "br":
                buffer.append(" ")
        elif tag == "hr":
            flush()
        elif tag in _INLINE:
            if tag == "a":
                link = 0 if closing else 1
            elif not closing and by_name and attrs:
                words, role = _named(attrs)
                if _is_boilerplate(tag, role) or _is_marked(tag, words):
                    push(stack[-1][0], tag, True, False)
            if closing and len(stack) > 1 and stack[-1][1] == tag and stack[-1][2]:
                pop()
        elif tag in _VOID:
            continue
        elif closing:
            link = 0
            if places := open_at.get(tag):
                if tag in _CELLS:
                    buffer.append(" ")
                    pop() if places[-1] == len(stack) - 1 else pop_to(places[-1])
                else:
                    pop_to(places[-1])
        else:
            link = 0
            if tag in _CLOSES_P or tag in _SELF_CLOSE:
                nearest = max([open_at[t][-1] for t in _SELF_CLOSE.get(tag, _P) if open_at.get(t)], default=0)
                if nearest and nearest >= (bounds[-1] if bounds else 0):
                    pop_to(nearest)
            words, role = _named(attrs) if attrs else ([], "")
            if tag in ("article", "main") and not seen_main and not plain and not _is_marked(tag, words):
                # an unclosed menu or notice before the text ends where the text begins
                seen_main = True
                for depth in range(1, len(stack)):
                    if stack[depth][2] or stack[depth][3]:
                        pop_to(depth)
                        break
            if tag not in _CELLS:
                flush()
            else:
                buffer.append(" ")
            if attrs.rstrip().endswith("/") and tag not in _CLOSES_P:
                continue
            bad = tag in _NOT_TEXT if not by_name else _is_boilerplate(tag, role)
            mark = by_name and not skip and not bad and _is_marked(tag, words)
            if skip or bad or not mark and tag in ("p", "li", "td", "th", "tr", "tbody", "thead", "h1", "h2", "h3", "h4", "h5", "h6"):
                here = stack[-1][0]
            else:
                here = len(containers)
                containers.append((_general(tag, words), stack[-1][0], tag))
            if mark:
                marked[here] = words
            push(here, tag, bad, mark)
    if not skip and at < len(page):
        buffer.append(_html.unescape(page[at:]))
    flush()
    if marked:
        gone = _dropped(containers, blocks, marked)
        blocks = [b for b in blocks if not gone[b[0]]]
    if not blocks and by_name:
        return parse(page, False)
    return containers, blocks


def _good_text(containers, blocks) -> tuple[list[int], list[int]]:
    """Good text and all text inside each container. Good text is blocks that aren't mostly links, of GOOD characters or more
    unless they are in an article or main element, or the page has none so long: names and dates around a text don't make
    their container its best."""
    good, every = [0] * len(containers), [0] * len(containers)
    least = GOOD if any(len(t) >= GOOD and 2 * linked < len(t) for _, t, linked in blocks) else 0
    within = [False] * len(containers)
    for i, (_, parent, tag) in enumerate(containers):
        within[i] = tag in ("article", "main") or (parent >= 0 and within[parent])
    for c, text, linked in blocks:
        good[c] += len(text) if 2 * linked < len(text) and (len(text) >= least or within[c]) else 0
        every[c] += len(text)
    for i in range(len(containers) - 1, 0, -1):  # a container's parent has a smaller number
        parent = containers[i][1]
        good[parent] += good[i]
        every[parent] += every[i]
    return good, every


def _dropped(containers, blocks, marked: dict[int, list[str]]) -> list[bool]:
    """Which containers are inside one that is marked by name and stays so.

    From the outside in, a mark is taken off where the container holds a main element. Where no article or main element
    with a fifth of its good text outside of marks is outside of all marks, it is also taken off where the container, if not
    named as comments, holds one article or more than half of the page's good text: a wrapper of the text may be named for
    a sidebar beside it, inside an article as well as around it.
    """
    import numpy as np

    good, _ = _good_text(containers, blocks)
    n = len(containers)
    ends = list(range(1, n + 1))  # what is inside container i has the numbers from i + 1 to before ends[i]
    for i in range(n - 1, 0, -1):
        parent = containers[i][1]
        ends[parent] = max(ends[parent], ends[i])
    standing = [0] * n  # marks around and at each container
    for i, (_, parent, _) in enumerate(containers):
        standing[i] = (standing[parent] if parent >= 0 else 0) + (i in marked)
    texts = [i for i, (_, _, tag) in enumerate(containers) if tag in ("article", "main") and good[i] and i not in marked]
    mains = [i for i in texts if containers[i][2] == "main"]
    clean = [0] * n  # good text outside of marks that are further inside
    for c, text, linked in blocks:
        clean[c] += len(text) if 2 * linked < len(text) else 0
    for i in range(n - 1, 0, -1):
        if i not in marked:
            clean[containers[i][1]] += clean[i]
    left = np.array([standing[i] for i in texts])
    solid = np.array([5 * clean[i] >= good[i] for i in texts], bool)
    gone = [False] * n
    for i, (_, parent, tag) in enumerate(containers):
        gone[i] = parent >= 0 and gone[parent]
        if i in marked and not gone[i]:
            first, last = bisect_left(texts, i + 1), bisect_left(texts, ends[i])
            n_main = bisect_left(mains, ends[i]) - bisect_left(mains, i + 1)
            wraps = not (solid & (left == 0)).any() and not _holds_comments(marked[i]) and (last - first - n_main == 1 or 2 * good[i] > good[0])
            if n_main or wraps and tag != "article":
                left[first:last] -= 1
            else:
                gone[i] = True
    return gone


def _scores(containers, blocks) -> list[tuple[float, int, int]]:
    """(score, text, container) of each container: its share of the page's good text, how much of its own text is good,
    and its name and depth for ties. Good text is what isn't mostly links."""
    n = len(containers)
    good, every = _good_text(containers, blocks)
    total = good[0]
    if not total:
        return []
    depth = [0] * n
    for i in range(1, n):
        depth[i] = depth[containers[i][1]] + 1
    bonus = lambda i: 0.25 if containers[i][2] in ("article", "main") else 0.0
    return [(good[i] / total + good[i] / every[i] + bonus(i) + 0.05 * depth[i] / (depth[i] + 50), good[i], i) for i in range(n) if good[i]]


def _path(containers, i: int) -> str:
    """Tags and names from the outermost element to the container."""
    names = []
    while i > 0:
        names.append(containers[i][0])
        i = containers[i][1]
    return "/".join(reversed(names))


def _by_path(containers) -> dict[int, list[int]]:
    """Containers by the hash of their path; each is made from its parent's, so no path is held as a text."""
    import xxhash

    hashes, out = [xxhash.xxh64()], {0: [0]}
    for i in range(1, len(containers)):
        name, parent, _ = containers[i]
        now = hashes[parent].copy()
        now.update(f"/{name}".encode() if parent else name.encode())
        hashes.append(now)
        out.setdefault(now.intdigest(), []).append(i)
    return out


def best_path(page: str) -> tuple[str, int] | None:
    """The path of the page's best container and its good text, as the page's vote."""
    containers, blocks = parse(page)
    scores = _scores(containers, blocks)
    if not scores:
        return None
    _, size, i = max(scores, key=lambda s: (s[0], -s[2]))
    return _path(containers, i), size


def extract(page: str, paths: list[str]) -> str:
    """Blocks inside the containers of the first winning path that holds at least half of the page's good text; a page that
    none fits is read by its own best container. Lists that are nothing but links are menus and left out."""
    import xxhash

    containers, blocks = parse(page)
    scores = _scores(containers, blocks)
    if not scores:
        return "\n".join(t for _, t, linked in blocks if 2 * linked < len(t))
    size = {i: g for _, g, i in scores}
    total = size[0]
    chosen, places = None, _by_path(containers) if paths else {}
    for p in paths:
        same = places.get(xxhash.xxh64(p.encode()).intdigest() if p else 0, [])
        if 2 * sum(size.get(i, 0) for i in same) >= total:
            chosen = set(same)
            break
    if chosen is None:
        chosen = {max(scores, key=lambda s: (s[0], -s[2]))[2]}
    lists: dict[int, list[int]] = {}
    for c, text, linked in blocks:
        if containers[c][2] in ("ul", "ol"):
            x = lists.setdefault(c, [0, 0, 0])
            x[0], x[1], x[2] = x[0] + len(text), x[1] + linked, x[2] + 1
    menus = {c for c, (n, linked, k) in lists.items() if k >= 3 and 10 * linked >= 9 * n}
    inside = [False] * len(containers)
    for i, (_, parent, _) in enumerate(containers):
        inside[i] = i in chosen or (parent >= 0 and inside[parent])
    return "\n".join(t for c, t, _ in blocks if inside[c] and c not in menus)


def host_paths(pages: DataFrame, *, url: str = "url", html: str = "html", least_share: float = 0.1) -> DataFrame:
    """host, paths: the paths that at least `least_share` of a host's voting pages voted for, most votes first.

    Votes are counted with partial aggregation, so a host with a third of all pages is no hot group; a host has at most
    1/least_share paths.
    """

    def vote(batches):
        import pyarrow as pa

        for b in common.small(batches):
            got = [(h, best_path(p)) for h, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if p]
            got = [(h, *v) for h, v in got if v]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.int64())], ["host", "path", "size"])

    votes = _hosted(pages, url, html).select("host", "html").mapInArrow(vote, "host string, path string, size long")
    counted = common.written(votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("size").alias("size")), "votes")
    totals = counted.groupBy("host").agg(F.sum("votes").alias("all"))
    won = counted.join(totals, "host").where(F.col("votes") >= least_share * F.col("all"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), (-F.col("size")).alias("s"), "path")))
    return won.groupBy("host").agg(ranked.alias("x")).select("host", F.col("x.path").alias("paths"))


def _hosted(pages: DataFrame, url: str, html: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return pages.withColumn("host", host).withColumn("html", F.col(html).cast("string"))


def extract_pages(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars. Null or empty html gives an empty text; a null url, or one without
    a host, votes with the other such pages. Repeated rows stay. Winning paths are written first, so Spark knows their
    size: few are sent to every task, many are joined by shuffle.
    """
    spark = pages.sparkSession
    common.prepare(spark)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    winners = common.written(host_paths(rows), "paths")
    kind = rows.schema["page_id"].dataType.simpleString()

    def read(batches):
        import pyarrow as pa

        for b in common.small(batches):
            got = [extract(p, w or []) if p else "" for p, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string()), pa.array(map(len, got), pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = _hosted(rows, "url", "html").join(winners, "host", "left").select("page_id", "url", "html", "paths")
    return joined.mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")
