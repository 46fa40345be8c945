from pyspark.sql import functions as F

from fernglass.functions import geo, records
from fernglass.functions import text as T
from fernglass.plans import routing


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y


def brute_windows(text, size=700, overlap=150):
    text = text.replace("\r\n", "\n")
    out, start = [], 0
    while True:
        end = min(start + size, len(text))
        body = text[start:end].strip()
        if body:
            out.append((len(out), body, start, end, text[:start].count("\n") + 1, text[:end].count("\n") + 1))
        if end >= len(text):
            return out
        start += size - overlap


def test_windows_at_boundaries(spark):
    for n in (1, 699, 700, 701, 1250, 1251, 3000):
        text = ("ab c\n" * 700)[:n]
        got = [tuple(r) for r in one(spark, text, T.windows)]
        assert got == brute_windows(text), n
    blank = "x" * 100 + " " * 2000 + "y"
    assert [tuple(r) for r in one(spark, blank, T.windows)] == brute_windows(blank)
    assert one(spark, "", T.windows) == []
    assert [r.text for r in one(spark, "a\r\nb", T.windows)] == ["a\nb"]


def test_two_search_forms_differ(spark):
    assert one(spark, " Ａ〜Ｂ ガ", T.search_form) == "a~bが"
    assert one(spark, "~", T.tourism_form) == "〜"
    assert one(spark, "〜", T.search_form) == "~"


def test_diacritics_and_variants(spark):
    assert one(spark, "Ünï が", T.without_diacritics) == "Uni か"
    assert one(spark, "é a", T.query_variants) == ["é a", "e a", "éa"]
    assert one(spark, "ガッ コウ", T.simple_kana) == "がつこう"
    assert one(spark, "ガッ コウ", T.plain_kana) == "かっこう"


def test_grams(spark):
    assert one(spark, "a", T.grams) == ["a", "a"]
    assert one(spark, "Ab c", T.grams) == ["ab", "c", "ab", "bc"]
    assert one(spark, "", T.grams) == []


def test_fragments(spark):
    text = "a" * 100 + "。" + "b" * 58 + "。" + "c" * 200 + "。"
    assert [len(x) for x in one(spark, text, T.fragments)] == [160, 201]
    # white space is single before lengths count
    assert one(spark, "a" * 100 + "!" + " \n " * 30 + "b  b" * 10 + "!\n", T.fragments) == ["a" * 100 + "!" + "b b" * 10 + "!"]
    assert one(spark, " \n ", T.fragments) == []


def test_small_values(spark):
    assert one(spark, "２日", T.ttl_seconds) == 172_800
    assert one(spark, "no number", T.ttl_seconds) is None
    assert one(spark, "a１２b", T.first_integer) == 12
    assert one(spark, "[[1]] x [[9]]", T.labels) == [1, 9]
    assert one(spark, "12:30 Bob  hello +", T.clean_input) == "12:30 Bob hello"
    assert one(spark, " 15:19 山田　たろう 教会は? ++", T.clean_input) == "教会は?"
    assert one(spark, "[2024-01-05 10:00] hello\n  there", T.clean_input) == "hello\n there"
    assert one(spark, "[note] hello", T.clean_input) == "[note] hello"
    assert one(spark, "User： hello", T.clean_input) == "hello"
    assert one(spark, "Éa 日本-x ガイド", T.fragment_tokens) == ["a", "日本", "x", "ガイド"]
    assert one(spark, "abcdef, x", lambda c: T.clip(c, 7)) == "abcdef…"
    assert one(spark, "a/b/c.txt", T.file_slug) == "a_b_c.txt"
    assert tuple(one(spark, "city/file.txt/L3-9", T.source_parts)) == ("city", "file", "L3-9")
    assert one(spark, None, T.split_list) == []


def test_coordinates(spark):
    at = lambda s: (lambda r: r and (r.lat, r.lng))(one(spark, s, geo.coordinates))
    assert at("https://x/maps/@32.5,128.7,15z") == (32.5, 128.7)
    assert at("https://x/maps?q=32.1234567,128.5") == (32.123457, 128.5)
    assert at("128.7, 32.5") == (32.5, 128.7)
    assert at("３２．５，１２８．７") == (32.5, 128.7)
    assert at("32度30分0秒 128度30分36秒") == (32.5, 128.51)
    assert at("999, 999") is None
    assert at("nothing") is None


def test_metres_round_half_even(spark):
    rows = spark.createDataFrame([(0.0005,), (0.0015,), (0.0025,)], "x double")
    assert [r[0] for r in rows.select(geo.metres(F.col("x"))).collect()] == [0, 2, 2]


def test_loose_json(spark):
    text = 'Sure:\n```json\n// note\n{"a": [1, 2,], "b": {"c": "x"},}\n``` bye'
    got = spark.createDataFrame([(text,), ("none",)], "x string").select(F.try_variant_get(records.loose_json(F.col("x")), "$.b.c", "string")).collect()
    assert [r[0] for r in got] == ["x", None]


def test_watermark_modes(spark):
    assert [one(spark, x, records.watermark_mode) for x in ("Full", "CITY", "off", "?")] == ["full", "city", "none", "none"]


def test_commands_and_refinements(spark):
    rows = spark.createDataFrame([("stop 2 minutes",), ("再開",), ("stopping",), ("@tag: sea view",), ("resume",)], "x string")
    got = rows.select(routing.command(F.col("x"), F.lit(False)).alias("c"), routing.refinement(F.col("x")).alias("r")).collect()
    assert [(r.c.action, r.c.ttl_seconds) for r in got] == [("pause", 120), ("resume", None), (None, None), (None, None), ("resume", None)]
    assert got[3].r.value == "sea view" and got[0].r is None
    said = {"ＭＵＴＥ": None, "ミュート": "pause", "ミュート解除": "resume", "一時停止 30分": "pause", "中止": None, "start": None, "スタート": None, "unpause": "resume", "応答再開 ": "resume", "停止して": None, "": None}
    rows = spark.createDataFrame([(x,) for x in said], "x string")
    assert {r.x: r.c.action for r in rows.select("x", routing.command(F.col("x"), F.lit(False)).alias("c")).collect()} == said


def test_plans(spark):
    said = {
        "user: 教会について詳しく教えて": ("overview", "detailed", ["結論", "要点", "注意"], ["教会について詳しく教えて"], []), "カフェー どこ": ("fact", "brief", ["結論", "補足"], ["カフェ"], []),
        "島の概要": ("overview", "normal", ["結論", "要点", "補足"], ["島の概要"], []), "それは何": ("overview", "brief", ["結論", "補足"], ["それは何"], []), "それは何かということをもう一度ゆっくり": ("overview", "normal", ["結論", "要点", "補足"], ["それは何かということをもう一度ゆっくり"], []),
        "行き方 と 体験": ("howto", "detailed", ["結論", "手順", "注意"], ["行き方", "体験"], []), "江戸 と 明治 と 江戸 1899年 12年": ("overview", "normal", ["結論", "要点", "補足"], ["江戸", "明治", "江戸", "1899年", "12年"], ["明治", "江戸", "1899年"]),
        "briefly please": ("overview", "normal", ["結論", "要点", "補足"], ["briefly", "please"], []), None: ("overview", "normal", ["結論", "要点", "補足"], [], []),
    }
    rows = spark.createDataFrame([(x,) for x in said], "x string").select("x", routing.answer_plan(F.col("x")).alias("p"))
    assert {r.x: (r.p.kind, r.p.style, r.p.sections, r.p.keywords, sorted(r.p.times)) for r in rows.collect()} == {k: (*v[:4], sorted(v[4])) for k, v in said.items()}


def test_signatures(spark):
    import base64
    import hashlib
    import hmac

    from fernglass.functions import text as T

    for key in (b"k", b"long key " * 20):
        for text in ("", "a/b?c=1", "日本"):
            want = base64.urlsafe_b64encode(hmac.new(key, text.encode(), hashlib.sha256).digest()).rstrip(b"=").decode()
            assert one(spark, text, lambda c, key=key: T.signature(c, key)) == want


def test_report_orders(spark):
    from fernglass.operators import analytics as A

    g = spark.createDataFrame([("い", 2), ("ア", 2), ("b", 5), ("B", 1)], "question string, n long")
    got = {s: [r.question for r in A.report_filter(g, sort=s).collect()] for s in ("cnt_desc", "cnt_asc", "alpha")}
    assert got == {"cnt_desc": ["b", "ア", "い"] + ["B"], "cnt_asc": ["B", "ア", "い", "b"], "alpha": ["b", "B", "ア", "い"]}


def test_long_runs_of_space_take_no_time_of_their_square(spark):
    """Only the ends of a text are looked at when it is stripped, whatever runs of spaces are inside."""
    import time

    df = spark.createDataFrame([(" a" + " " * 300_000 + "b　",), ("a" + " " * 300_000 + "交通",), ("é" + " " * 300_000 + "b",), (" ",), (None,)], "t string")
    began = time.time()
    assert [r.x for r in df.select(T.language(F.col("t")).alias("x")).collect()] == ["en", "zh-Hant", "ja", "ja", "ja"]
    assert time.time() - began < 15


def test_a_message_is_cut_and_measured_once(spark):
    """The whole text's pieces are made at one place of the expression, and pieces are measured before they are joined."""
    assert str(T.split_message(F.col("t"), 20)._jc).count("flatten(") == 1
    text = "One 😀😀. Two three four.\n\n" + "𝒳" * 25 + ". End"
    df = spark.createDataFrame([(text,), (None,), ("\n\n" * 30,)], "t string")
    assert [r.p for r in df.select(T.split_message(F.col("t"), 20).alias("p")).collect()] == [["One 😀😀. Two three ", "four.", "𝒳" * 10, "𝒳" * 10, "𝒳" * 5 + ". End"], [""], ["\n" * 20]]
