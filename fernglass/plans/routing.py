"""Questions to routes: keyword intents, commands, branch order, answer plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernglass.functions import text as T
from fernglass.operators.matching import containing
from fernglass.operators.search import best_of, fragment_overlap

# fixed values: words that decide an intent, tested in this order; names that hold one of them are left out
INTENTS = {
    "weather": ["天気", "天候", "予報", "weather"],
    "transport": ["運行", "運航", "運休", "欠航", "遅延", "見合わせ", "状況", "情報", "status", "船", "フェリー", "ジェットフォイル", "太古", "飛行機", "空港", "ana", "jal", "orc", "オリエンタルエアブリッジ"],
    "viewpoint_map": ["展望所マップ", "展望マップ", "展望所の地図", "展望台マップ", "展望台の地図"],
}
# fixed values: patterns that decide the intent as well
PATTERNS = {"viewpoint_map": [r"展望\s*(?:所|台)?\s*(?:マップ|地図)", r"viewpoints?\s*map"]}
# fixed values: words of commands
PAUSE, RESUME = ["停止", "一時停止", "ストップ", "ミュート", "pause", "stop"], ["解除", "再開", "応答再開", "ミュート解除", "resume", "unpause"]
# fixed values: words that ask for a long answer, for a fact, and that make a short question one for a fact
DETAILS = ["詳しく", "ポイント", "楽しみ方", "モデルコース", "おすすめ", "初めて", "注意点", "過ごし方", "体験", "計画", "見どころ", "魅力"]
FACTS = ["いつ", "どこ", "時期", "期間", "開催日", "何年", "年代", "誰", "だれ", "料金", "値段", "費用", "アクセス", "行き方", "所要", "時間", "住所", "電話", "人数", "規模"]
ASKING = ["いつ", "どこ", "何", "なに", "なぜ", "どう", "どんな", "どの", "だれ", "誰"]
# fixed values: words of the kinds of a question, tested in this order before FACTS
KINDS = {"compare": ["違い", "比較", "比べ"], "list": ["一覧", "リスト"], "howto": ["どうやって", "方法", "行き方", "アクセス", "参加", "申し込み"]}
# fixed values: words that aren't keywords
STOP = ["について", "こと", "もの", "教えて", "ください", "出来ます", "できます", "です", "ます", "よう", "したい", "下さい", "とは", "を", "が", "は", "に", "で", "と", "へ", "も", "の", "や", "より", "など", "って", "ってる"]
# fixed values: eras, and the sections of an answer by style and kind
ERAS = ["奈良", "平安", "鎌倉", "室町", "江戸", "明治", "大正", "昭和", "平成", "令和"]
SECTIONS = {"brief": ["結論", "補足"], "normal": ["結論", "要点", "補足"], "detailed": ["結論", "要点", "注意"], "detailed howto": ["結論", "手順", "注意"]}


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def intent(text: Column, intents: dict[str, list[str]] = INTENTS, patterns: dict[str, list[str]] = PATTERNS) -> Column:
    """The first intent of which a word or pattern occurs; null for none."""
    low, out = T.title_key(text), None
    for name, words in intents.items():
        met = _any(low, words)
        for p in patterns.get(name, []):
            met = met | low.rlike(p)
        out = F.when(met, name) if out is None else out.when(met, name)
    return out


def command(text: Column, admin: Column) -> Column:
    """(action, ttl_seconds) of a text that is a command word or starts with one and a space. Administrators' are marked."""
    low = T.title_key(text)
    is_ = lambda words: low.isin(*words) | _any_start(low, words)
    action = F.when(is_(RESUME), "resume").when(is_(PAUSE), "pause")
    return F.struct(action.alias("action"), F.when(action == "pause", T.ttl_seconds(low)).alias("ttl_seconds"), (admin & action.isNotNull()).alias("by_admin"))


def _any_start(low: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | low.startswith(w + " ")
    return out


def route(**claims: Column) -> Column:
    """The first branch, in the order given, whose claim is true; else no_answer."""
    out = None
    for name, claim in claims.items():
        yes = F.coalesce(claim, F.lit(False))
        out = F.when(yes, name) if out is None else out.when(yes, name)
    return out.otherwise("no_answer")


def refinement(text: Column) -> Column:
    """(kind, value) of @area:x and @tag:x."""
    kind = F.regexp_extract(text, r"^\s*@(area|tag):\s*(\S.*?)\s*$", 1)
    return F.when(kind != "", F.struct(kind.alias("kind"), F.regexp_extract(text, r"^\s*@(area|tag):\s*(\S.*?)\s*$", 2).alias("value")))


def answer_plan(question: Column) -> Column:
    """(query, kind, style, sections, keywords, times): a question without its sender's name, what it asks for, how long the answer should
    be and of which sections, the words it should be about, and eras and years (each once, in order).

    Words of FACTS make an answer brief, and so do those of ASKING in at most 15 characters; words of DETAILS come first and make it
    detailed. Keywords are runs of two or more ASCII letters, digits, kanji and kana that are in neither STOP nor ASKING, as often
    as they occur; the long vowel mark and hyphens part them.
    """
    query = T.strip(F.regexp_replace(T.strip(F.coalesce(question, F.lit(""))), r"(?U)^(?:[A-Za-z]+|[\wぁ-んァ-ン一-龠々〆ゝゞ]+)[:：]\s*", ""))
    kind = F.lit("overview")
    for name, words in reversed([*KINDS.items(), ("fact", FACTS)]):
        kind = F.when(_any(query, words), name).otherwise(kind)
    brief = _any(query, FACTS) | (F.length(query) <= 15) & _any(query, ASKING)
    style = F.when(_any(query, DETAILS), "detailed").when(brief, "brief").otherwise("normal")
    listed = lambda name: F.array(*[F.lit(x) for x in SECTIONS[name]])
    sections = F.when(style == "brief", listed("brief")).when(style == "normal", listed("normal")).when(kind == "howto", listed("detailed howto")).otherwise(listed("detailed"))
    cleaned = F.regexp_replace(query, r"(?U)[\s、。,.!?！？\-ー（）()\[\]【】『』]+", " ")
    words = F.regexp_extract_all(cleaned, F.lit("[A-Za-z0-9一-龠々〆ヵヶぁ-んァ-ンゝゞー]{2,}"), F.lit(0))
    keywords = F.filter(words, lambda w: ~w.isin(*STOP, *ASKING))
    found = lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all(query, F.lit(p), F.lit(0))))
    times = F.concat(found("|".join(ERAS)), found("[0-9]{3,4}年"))
    return F.struct(query.alias("query"), kind.alias("kind"), style.alias("style"), sections.alias("sections"), keywords.alias("keywords"), times.alias("times"))


def respond(matches: DataFrame, queries: DataFrame, *, previews: int = 3, facets: int = 5) -> DataFrame:
    """qid, status, preview, facets of matches (qid, ord, title, areas, tags): no_hit for no match, detail for one, choices for
    several, with the first titles and with the areas, then the tags, that most of the matches have."""
    n = matches.groupBy("qid").agg(F.count("*").alias("n"))
    first = best_of(matches.select("qid", "ord", "title"), F.col("ord"), limit=previews)
    shown = first.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "title"))), lambda x: x["title"]), " / ").alias("preview"))
    named = lambda c, kind: F.transform(c, lambda v, i: F.struct(F.lit(kind).alias("kind"), v.alias("value"), i.alias("at")))
    values = matches.select("qid", "ord", F.explode(F.concat(named("areas", "area"), named("tags", "tag"))).alias("v"))
    counted = values.groupBy("qid", "v.kind", "v.value").agg(F.count("*").alias("k"), F.min(F.struct("ord", "v.at")).alias("f"))
    top = best_of(counted, F.col("kind"), F.desc("k"), F.col("f"), limit=facets)
    listed = top.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.concat_ws(":", "kind", "value").alias("t")))), lambda x: x["t"]), "|").alias("facets"))
    both = queries.select("qid").join(n, "qid", "left").join(shown, "qid", "left").join(listed, "qid", "left")
    status = F.when(F.coalesce("n", F.lit(0)) == 0, "no_hit").when(F.col("n") == 1, "detail").otherwise("choices")
    return both.select("qid", status.alias("status"), F.coalesce("preview", F.lit("")).alias("preview"), F.when(F.col("n") > 1, F.col("facets")).otherwise("").alias("facets"))


def ask(questions: DataFrame, entries: DataFrame, fragments: DataFrame, *, now: Column, intents: dict[str, list[str]] = INTENTS) -> DataFrame:
    """The question log's rows for a table of questions (qid, question): qid, route, hit, answer, ts.

    Fixed answers come first (the answer is the intent), then entries (ord, title) whose title the question names (the first
    of them), then the fragment (ord, text) that shares most words with it, then nothing. Questions meet titles by pieces and
    fragments by words."""
    titles = entries.groupBy(F.lower("title").alias("_t")).agg(F.min(F.struct("ord", "title")).alias("e"))
    low = questions.select("qid", F.lower("question").alias("_q"))
    named = containing(low, titles, key="qid", text="_q", form="_t").groupBy("qid").agg(F.min("e").alias("e"))
    special = questions.withColumn("_i", intent(F.col("question"), intents)).join(named, "qid", "left")
    rest = special.where("_i is null and e is null").select("qid", F.col("question").alias("query"))
    found = fragment_overlap(fragments, rest, k=1).where("score > 0").select("qid", F.col("text").alias("_f"))
    both = special.join(found, "qid", "left")
    r = route(special=F.col("_i").isNotNull(), entries=F.col("e").isNotNull(), documents=F.col("_f").isNotNull())
    return both.select("qid", r.alias("route"), (r != "no_answer").alias("hit"), F.coalesce("_i", "e.title", "_f", F.lit("")).alias("answer"), now.alias("ts"))
