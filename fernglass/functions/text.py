"""Text expressions: canonical forms, tokens, windows, labels, patterns. Columns in, columns out."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: katakana U+30A1..U+30F4 stand 0x60 above their hiragana; the two small ke/ka have none
_KATA = "".join(chr(c) for c in range(0x30A1, 0x30F5)) + "ヵヶ"
_HIRA = "".join(chr(c - 0x60) for c in range(0x30A1, 0x30F5)) + "かけ"
# fixed values: small kana and their full size
_SMALL, _FULL = "ぁぃぅぇぉっゃゅょゎ", "あいうえおつやゆよわ"
# fixed values: all characters of Unicode's White_Space
_SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_FULL_DIGITS, _DIGITS = "０１２３４５６７８９", "0123456789"


def _icu(method: str, c: Column, compatible: bool) -> Column:
    return F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), F.coalesce(c, F.lit("")), F.lit(compatible))


def nfkc(c: Column) -> Column:
    return _icu("compose", c, True)


def squeeze(c: Column) -> Column:
    """White space, Unicode's too, as single spaces; trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    """Without white space, Unicode's too, at both ends. Only the ends are looked at, however long the text is."""
    return F.btrim(c, F.lit(_SPACE))


def hiragana(c: Column) -> Column:
    return F.translate(c, _KATA, _HIRA)


def search_form(c: Column, keep_spaces: bool = False) -> Column:
    """Search form: NFKC, wave dash as tilde, lower case, hiragana; white space removed or single."""
    base = hiragana(F.lower(F.translate(nfkc(c), "〜", "~")))
    return squeeze(base) if keep_spaces else F.regexp_replace(base, r"(?U)\s+", "")


def tourism_form(c: Column, keep_spaces: bool = False) -> Column:
    """The other search form: the tilde becomes a wave dash, and the four voiced wa-row kana are folded as well."""
    base = F.translate(F.lower(F.translate(hiragana(nfkc(c)), "ヷヸヹヺ", "わゐゑを")), "~", "〜")
    return squeeze(base) if keep_spaces else F.regexp_replace(base, r"(?U)\s+", "")


def title_key(c: Column) -> Column:
    """NFKC, lower case, single spaces; trimmed."""
    return squeeze(F.lower(nfkc(c)))


def without_diacritics(c: Column) -> Column:
    """Canonical decomposition, marks dropped, composed again."""
    return _icu("compose", F.regexp_replace(_icu("decompose", c, False), r"\p{Mn}", ""), False)


def plain_kana(c: Column) -> Column:
    """The search form without voicing marks."""
    return without_diacritics(search_form(c))


def simple_kana(c: Column) -> Column:
    """The search form with small kana full size; voicing marks stay."""
    return F.translate(search_form(c), _SMALL, _FULL)


def query_variants(c: Column) -> Column:
    """Distinct forms of a query: as normalised, without diacritics, without spaces."""
    base = search_form(c, keep_spaces=True)
    return F.array_distinct(F.array(base, without_diacritics(base), F.replace(base, F.lit(" "), F.lit(""))))


def split_list(c: Column) -> Column:
    """Items between commas and newlines, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[\n,]+"), lambda x: squeeze(x)), lambda x: x != "")


def split_query(c: Column, hyphen: bool = True) -> Column:
    """Query tokens between spaces, slashes, middle dots and, if asked, hyphens."""
    return F.filter(F.split(c, r"(?U)[\s/・" + (r"\-" if hyphen else "") + "]+"), lambda x: x != "")


def word_tokens(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscore."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)[a-z0-9_\w]+"), F.lit(0))  # a plain letter needs no look at Unicode's tables


def counted(terms: Column) -> Column:
    """Array of (term, tf): the distinct terms of an array, sorted, and how often each is there. The array is sorted once and each
    term's places are counted by where they begin, so no state grows beyond a row."""

    def of(s):
        begin = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        each = lambda b: F.transform(b, lambda i, j: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(b, j + 1), F.size(s)) - i).alias("tf")))
        return F.get(F.transform(F.array(begin), each), F.lit(0))

    none = F.expr("cast(array() as array<struct<term:string,tf:int>>)")
    return F.get(F.transform(F.array(F.sort_array(terms)), lambda s: F.when(F.size(s) > 0, of(s)).otherwise(none)), F.lit(0))


def fragment_tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters, digits, kanji and kana; other letters part them."""
    return F.regexp_extract_all(F.lower(c), F.lit("[0-9a-z一-龥ぁ-んァ-ンー]+"), F.lit(0))


def grams(c: Column) -> Column:
    """Runs of ASCII letters and digits, then all two-character pieces of the text without white space; one character stays."""
    low = F.lower(c)
    runs = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    flat = F.regexp_replace(low, r"(?U)\s+", "")
    n = F.length(flat)
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(flat, i, F.lit(2)))).when(n == 1, F.array(flat)).otherwise(F.expr("cast(array() as array<string>)"))
    return F.concat(runs, pairs)


def sentences(c: Column) -> Column:
    """Pieces that end at a full stop, exclamation or question mark of either width; trimmed, none empty."""
    return F.filter(F.transform(F.split(c, "(?<=[。．！？!?])"), strip), lambda s: s != "")


def fragments(c: Column, limit: int = 160) -> Column:
    """Sentences of the text with single spaces, joined while they fit into `limit` characters; a longer sentence stands alone."""
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("now"))

    def step(a, s):
        fits = (a["now"] == "") | (F.length(a["now"]) + F.length(s) <= limit)
        return F.struct(F.when(fits, a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))).alias("done"), F.when(fits, F.concat(a["now"], s)).otherwise(s).alias("now"))

    return F.aggregate(sentences(squeeze(c)), start, step, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))))


def windows(c: Column, size: int = 700, overlap: int = 150, lines: bool = True) -> Column:
    """Array of (chunk_index, text, char_start, char_end, line_start, line_end): windows of `size` characters that start every
    size - overlap, up to the first that reaches the end. Blank windows are dropped before they are numbered; without
    `lines` the line numbers are left out.

    The text is cut once into pieces as long as a step; a window is a few neighbouring pieces, and its lines are counted
    by piece, so the work grows with the text and not with its square.
    """
    body, step = F.replace(c, F.lit("\r\n"), F.lit("\n")), size - overlap
    pieces = F.regexp_extract_all(body, F.lit("(?s).{1,%d}" % step), F.lit(0))
    n = F.length(body)
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1)
    newlines = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    parts = F.struct(pieces.alias("p"), n.alias("n"), count.alias("k"), F.expr("cast(array() as array<int>)").alias("l"))
    if lines:
        # lines before each piece
        before = F.aggregate(pieces, F.expr("array(0)"), lambda a, s: F.array_append(a, F.element_at(a, -1) + newlines(s)))
        parts = F.struct(pieces.alias("p"), n.alias("n"), count.alias("k"), before.alias("l"))

    def of(d):
        def one(i):
            start = i * step
            text = F.substr(F.array_join(F.slice(d["p"], i + 1, F.lit(-(-size // step))), ""), F.lit(1), F.lit(size))
            fields = [strip(text).alias("text"), start.alias("char_start"), F.least(start + size, d["n"]).alias("char_end")]
            if lines:
                first = F.get(d["l"], i) + 1
                fields += [first.alias("line_start"), (first + newlines(text)).alias("line_end")]
            return F.struct(*fields)

        kept = F.filter(F.transform(F.sequence(F.lit(0), d["k"] - 1), one), lambda x: x["text"] != "")
        names = ["text", "char_start", "char_end", *(["line_start", "line_end"] if lines else [])]
        return F.transform(kept, lambda x, i: F.struct(i.alias("chunk_index"), *[x[f].alias(f) for f in names]))

    return F.element_at(F.transform(F.array(parts), of), 1)


def clean_input(c: Column) -> Column:
    """A question without a leading time and name in Japanese letters (two words), a log prefix (a bracket that starts with a date, or
    `user:`), or trailing plus signs; single spaces, lines stay."""
    letters = r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}]+"
    space = r"[\s\x{3000}]+"
    for pattern in (rf"^\s*\d{{1,2}}:\d{{2}}{space}{letters}{space}{letters}{space}", r"(?i)^(?:\s*\[\d{4}-\d{2}-\d{2}.*?\]\s*|user[:：]\s*)", r"\s*\++$"):
        c = F.regexp_replace(c, pattern, "")
    return strip(F.regexp_replace(c, r"[ \t]+", " "))


def clip(c: Column, limit: int) -> Column:
    """At most `limit` characters; what is cut ends with an ellipsis in place of trailing punctuation."""
    cut = F.regexp_replace(F.substr(c, F.lit(1), F.lit(limit)), r"[\s、。，．,.;:!?！？]+$", "")
    return F.when(F.length(c) > limit, F.concat(cut, F.lit("…"))).otherwise(c)


def labels(c: Column) -> Column:
    """Numbers in [[n]] marks, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\[\[(\d+)\]\]"), F.lit(1)), lambda x: x.cast("int"))


def without_labels(c: Column) -> Column:
    return F.regexp_replace(c, r"\[\[\d+\]\]", "")


# fixed values: words that tell Chinese from Japanese without kana
CHINESE = ("今天", "天氣", "天气", "請問", "请问", "交通", "景點", "景点", "門票", "门票", "美食", "住宿", "船班", "航班", "預約", "预约", "營業", "营业")


def language(c: Column) -> Column:
    """ja for kana, zh-Hant for a word of CHINESE, en for ASCII letters, digits, spaces and common marks alone, else ja; an
    empty or null text is ja. A text of one-byte characters has no kana, and one without any character from the first kana to the
    last ideograph no Chinese word, so most texts are read once."""
    t = F.coalesce(c, F.lit(""))
    plain = F.octet_length(t) == F.length(t)
    eastern = F.when(t.rlike("[ぁ-んァ-ン]"), "ja").when(t.rlike("(?=[一-龥])(?:" + "|".join(CHINESE) + ")"), "zh-Hant").otherwise("ja")
    english = strip(t).rlike(r"\A[A-Za-z0-9\s\-.,!?'\"/()]++\z")
    return F.when(plain, F.when(english, "en").otherwise("ja")).when(t.rlike("[ぁ-龥]"), eastern).when(english, "en").otherwise("ja")


def truthy(c: Column, permissive: bool = False) -> Column:
    """Words for true, and of a column of numbers all but 0; permissively, whatever isn't empty or a word for false."""
    word = F.lower(F.trim(c.cast("string")))
    numeric = F.call_function("typeof", c).rlike("^(tinyint|smallint|int|bigint|float|double|decimal.*)$")
    words = ~word.isin("", "0", "false", "no", "off") if permissive else word.isin("1", "true", "yes", "y", "on")
    return F.coalesce(F.when(numeric, word.try_cast("double") != 0).otherwise(words), F.lit(False))


def first_integer(c: Column) -> Column:
    """The first integer, digits of either width; null for none."""
    return F.nullif(F.regexp_extract(F.translate(c, _FULL_DIGITS, _DIGITS), r"(\d+)", 1), F.lit("")).try_cast("bigint")


def ttl_seconds(c: Column) -> Column:
    """The first number with a unit of minutes, hours or days, in seconds; null for none."""
    text = F.lower(F.translate(c, _FULL_DIGITS, _DIGITS))
    pattern = r"(\d+)\s*(分|minutes?|mins?|m|時間|hours?|h|日|days?|d)"
    n, unit = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("bigint"), F.regexp_extract(text, pattern, 2)
    return n * F.when(unit.rlike("^(分|m)"), 60).when(unit.rlike("^(時間|h)"), 3600).otherwise(86_400)


def source_parts(c: Column) -> Column:
    """(folder, file, lines) of `folder/file[/Lx-y]`; the file without folders and its .txt or .md."""
    span = F.regexp_extract(c, r"/(L\d+(?:-\d+)?)$", 1)
    path = F.regexp_replace(c, r"/L\d+(?:-\d+)?$", "")
    file = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.(txt|md)$", "")
    return F.struct(F.when(path.contains("/"), F.element_at(F.split(path, "/"), 1)).otherwise("").alias("folder"), file.alias("file"), span.alias("lines"))


def file_slug(c: Column, limit: int = 80) -> Column:
    """A safe file name: separators and control characters as underscores, no leading dots, `limit` characters, .txt at its end."""
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(c), r"\.txt$", ""), r"[\\/:*?\"<>|\x00-\x1f\s]+", "_"), r"^\.+", "")
    return F.concat(F.coalesce(F.nullif(F.substr(stem, F.lit(1), F.lit(limit)), F.lit("")), F.lit("untitled")), F.lit(".txt"))


def text_key(user: Column, text: Column) -> Column:
    """SHA-1 of user and trimmed text."""
    return F.sha1(F.concat_ws(":", user.cast("string"), F.trim(text)))


def user_hash(user: Column) -> Column:
    return F.sha2(user.cast("string"), 256)


def signature(c: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a text, as base64 for URLs without padding."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda mask: F.lit(bytes(k ^ mask for k in block))
    digest = lambda b: F.unhex(F.sha2(b, 256))
    signed = digest(F.concat(pad(0x5C), digest(F.concat(pad(0x36), F.encode(c, "UTF-8")))))
    return F.rtrim(F.translate(F.base64(signed), "+/=", "-_ "))


def find(text: Column, needle: Column) -> Column:
    """Place of the needle from 0, -1 for none."""
    return F.call_function("instr", text, needle) - 1


def utf16_length(c: Column) -> Column:
    """Code units of UTF-16: characters beyond the basic plane count twice. A text of one-byte characters has none."""
    return F.when(F.octet_length(c) == F.length(c), F.length(c)).otherwise(F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]+", "")))


def _with(c: Column, of) -> Column:
    """of(c), with c computed once."""
    return F.get(F.transform(F.array(c), of), F.lit(0))


def split_message(c: Column, limit: int = 4800) -> Column:
    """A text as parts of at most `limit` UTF-16 units: whole paragraphs (between blank lines) joined while they fit; a paragraph
    that is too long by sentences, joined by a newline; a sentence that is too long by characters, in parts of its own. A
    text that fits is one part, a null text an empty one. Lengths add up, so each piece is measured once."""
    text = F.coalesce(c, F.lit(""))
    none = F.expr("cast(array() as array<string>)")
    unit = lambda kind, pieces, n: F.struct(F.lit(kind).alias("kind"), pieces.alias("pieces"), n.alias("n"))

    def by_characters(s):
        chars = F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))
        start = F.struct(none.alias("done"), F.lit("").alias("now"))
        step = lambda a, x: F.struct(F.when(utf16_length(F.concat(a["now"], x)) > limit, F.array_append(a["done"], a["now"])).otherwise(a["done"]).alias("done"), F.when(utf16_length(F.concat(a["now"], x)) > limit, x).otherwise(F.concat(a["now"], x)).alias("now"))
        plain = F.regexp_extract_all(s, F.lit("(?s).{1,%d}" % limit), F.lit(0))
        return F.when(utf16_length(s) == F.length(s), plain).otherwise(F.aggregate(chars, start, step, lambda a: F.array_append(a["done"], a["now"])))

    def units(p):
        cut = F.filter(F.split(p, "(?<=[。．！？!?])"), lambda s: s != "")
        sentence = lambda s: _with(utf16_length(s), lambda n: F.when(n > limit, unit("long", by_characters(s), n)).otherwise(unit("sentence", F.array(s), n)))
        return _with(utf16_length(p), lambda n: F.when(n <= limit, F.array(unit("paragraph", F.array(p), n))).otherwise(F.transform(cut, sentence)))

    paragraphs = F.transform(F.filter(F.split(text, r"\n\s*\n"), lambda p: p != ""), lambda p: F.regexp_replace(p, r"^\n+|\n+$", ""))

    def step(a, u):
        now, piece = a["now"], F.element_at(u["pieces"], 1)
        between = F.when(now == "", "").when(u["kind"] == "paragraph", "\n\n").when(now.endswith("\n"), "").otherwise("\n")
        flushed = F.when(now == "", a["done"]).otherwise(F.array_append(a["done"], now))

        def joined(between):
            n = a["n"] + F.length(between) + u["n"]
            fits = n <= limit
            return F.struct(F.when(fits, a["done"]).otherwise(flushed).alias("done"), F.when(fits, F.concat(now, between, piece)).otherwise(piece).alias("now"), F.when(fits, n).otherwise(u["n"]).alias("n"))

        return F.when(u["kind"] == "long", F.struct(F.concat(flushed, u["pieces"]).alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))).otherwise(_with(between, joined))

    start = F.struct(none.alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))
    last = lambda a: F.when(a["now"] != "", F.array_append(a["done"], a["now"])).when(F.size(a["done"]) > 0, a["done"]).otherwise(F.array(F.substr(text, F.lit(1), F.lit(limit))))
    return F.when(utf16_length(text) <= limit, F.array(text)).otherwise(F.aggregate(F.flatten(F.transform(paragraphs, units)), start, step, last))


def pack_messages(parts: Column, limit: int = 4800, most: int = 5) -> Column:
    """Parts joined by newlines while they fit into `limit` characters; beyond `most` the rest is one last part between blank
    lines."""
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("now"))

    def step(a, p):
        fits = F.length(a["now"]) + 1 + F.length(p) <= limit
        empty = a["now"] == ""
        return F.struct(F.when(empty | fits, a["done"]).otherwise(F.array_append(a["done"], a["now"])).alias("done"), F.when(empty, p).when(fits, F.concat(a["now"], F.lit("\n"), p)).otherwise(p).alias("now"))

    def kept(joined):
        tail = F.array_join(F.slice(joined, F.lit(most), F.greatest(F.size(joined) - most + 1, F.lit(0))), "\n\n")
        return F.when(F.size(joined) > most, F.array_append(F.slice(joined, 1, most - 1), tail)).otherwise(joined)

    return _with(F.aggregate(parts, start, step, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.array_append(a["done"], a["now"]))), kept)


# fixed values: headers of an answer's sections
HEADERS = {"質問の意図": "intent", "要約": "summary", "詳細": "details", "補足": "notes", "出典": "sources"}


def _sectioned(lines: Column, header) -> Column:
    """(section, line, head) of each line: the section that the last header named, summary before any."""
    start = F.struct(F.lit("summary").alias("now"), F.expr("cast(array() as array<struct<section:string,line:string,head:boolean>>)").alias("all"))

    def step(a, line):
        name = header(line)
        now = F.coalesce(name, a["now"])
        return F.struct(now.alias("now"), F.array_append(a["all"], F.struct(now.alias("section"), line.alias("line"), name.isNotNull().alias("head"))).alias("all"))

    return F.aggregate(lines, start, step, lambda a: a["all"])


def sections(c: Column, headers: dict[str, str] = HEADERS) -> Column:
    """(summary, details, notes) of an answer with header lines (marks # before and a colon after are ignored): summary as lines,
    details and notes as lists without bullets and numbers. Without any header all is the summary."""
    text = strip(F.coalesce(c, F.lit("")))
    lines = F.split(text, r"\r\n|[\n\r]")
    known = F.create_map(*[x for k, v in headers.items() for x in (F.lit(k), F.lit(v))])
    header = lambda line: F.try_element_at(known, strip(F.regexp_replace(F.regexp_replace(strip(line), "^[# ]+", ""), "[：:]+$", "")))
    all_ = _sectioned(lines, header)
    of = lambda name: F.transform(F.filter(all_, lambda x: (x["section"] == name) & ~x["head"] & (strip(x["line"]) != "")), lambda x: strip(x["line"]))
    bare = lambda line: strip(F.regexp_replace(F.regexp_replace(line, r"(?U)^[\s\-・*●○◆◇▶▷■□◉◎]+", ""), r"^[0-9]{1,2}[.)、](?U)\s*", ""))
    listed = lambda name: F.filter(F.transform(of(name), bare), lambda x: x != "")
    some = F.exists(lines, lambda line: header(line).isNotNull())
    none = F.expr("cast(array() as array<string>)")
    return F.struct(F.when(some, F.array_join(of("summary"), "\n")).otherwise(text).alias("summary"), F.when(some, listed("details")).otherwise(none).alias("details"), F.when(some, listed("notes")).otherwise(none).alias("notes"))


def closed_sentence(c: Column) -> Column:
    """A sentence with single spaces and a full stop at its end, if it has none."""
    clean = squeeze(F.coalesce(c, F.lit("")))
    return F.when((clean == "") | clean.rlike("[。.!?！？]$"), clean).otherwise(F.concat(clean, F.lit("。")))


def question_keywords(c: Column) -> Column:
    """Distinct runs of two or more letters, digits or Japanese characters of a question, kana as hiragana, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(hiragana(nfkc(c))), F.lit("[a-z0-9一-龥ぁ-んー]{2,}"), F.lit(0)))


def on_topic(c: Column, keywords: Column) -> Column:
    """An answer without those lines of its summary and details (under ### headers) that hold none of the keywords; a header of
    details goes if nothing is left below it. Without text or keywords, as it is."""
    form = lambda x: F.lower(hiragana(nfkc(x)))
    lines = F.split(c, r"\r\n|[\n\r]")

    def header(line):
        s = strip(line)
        return F.when(s.startswith("### 要約"), "summary").when(s.startswith("### 詳細"), "detail").when(s.startswith("### 出典"), "sources").when(s.startswith("### "), "other")

    marked = _sectioned(F.concat(F.array(F.lit("### .")), lines), header)
    held = F.filter(marked, lambda x: x["head"] | (strip(x["line"]) == "") | ~x["section"].isin("summary", "detail") | F.exists(keywords, lambda k: form(x["line"]).contains(form(k))))
    detail = F.exists(held, lambda x: (x["section"] == "detail") & ~x["head"] & (strip(x["line"]) != ""))
    kept = F.filter(held, lambda x: detail | (x["section"] != "detail"))
    joined = strip(F.array_join(F.transform(F.slice(kept, F.lit(2), F.greatest(F.size(kept) - 1, F.lit(0))), lambda x: F.when(x["head"], F.regexp_replace(x["line"], r"(?U)\s+$", "")).otherwise(x["line"])), "\n"))
    return F.when((F.coalesce(c, F.lit("")) == "") | (F.coalesce(F.size(keywords), F.lit(0)) <= 0), c).otherwise(joined)
