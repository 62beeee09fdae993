from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import lexicons as L, metrics as M, parsing as Pa, rules as R, text as T
from tidemark.operators import monitor as Mo


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


def column(spark, values, fn):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in d.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_parse_count(spark):
    texts = ["1234", "12,340", "1.2万", "1.5亿", "-", "", "点赞 3.4万", "2w", None]
    assert column(spark, texts, M.parse_count) == [1234, 12340, 12000, 150000000, None, None, 34000, 20000, None]
    assert column(spark, ["21.0万", "368", "1.2亿", "x9", None], lambda c: M.parse_count(c, "anchored")) == [210000, 368, 120000000, None, None]
    assert column(spark, ["1.1万", "abc", None], lambda c: M.parse_count(c, "zero")) == [11000, 0, 0]


def test_rates_durations_and_keys(spark):
    assert column(spark, ["3.21%", "0.0321", "-", None], M.parse_rate) == [0.0321, 0.0321, None, None]
    assert column(spark, ["1,234", "-", "+7"], M.parse_int) == [1234, None, 7]
    assert column(spark, ["03:41", "bad", None], M.duration_seconds) == [221, None, None]
    assert column(spark, ["12000", "250000000", "999", None], lambda c: M.format_count(c.cast("long"))) == ["1.2万", "2.5亿", "999", None]


def test_format_count_keeps_the_unit_of_the_count(spark):
    # rounding may reach the next unit's bound, and halves go up whatever the binary value next to them
    got = column(spark, ["99999500.0", "99999499.0", "100000000.0", "10500.0", "11500.0"], lambda c: M.format_count(c.cast("double")))
    assert got == ["10000.0万", "9999.9万", "1.0亿", "1.1万", "1.2万"]
    assert one(spark, "n1", lambda c: M.note_key(c, F.lit("t"), F.lit("d"))) == "id:n1"
    assert one(spark, "-", lambda c: M.note_key(c, F.lit("t"), F.lit("d"))).startswith("h:")


def test_staleness(spark):
    got = column(spark, ["2024-01-01 10:00", "2024-03-31", None, "soon"], lambda c: Mo.is_stale(c, F.to_date(F.lit("2024-03-31"))))
    assert got == [True, False, False, False]


def test_comment_predicates(spark):
    rules = T.CommentRules(control_words=("网页全屏",), exact_words=("播放中", "作者"))
    ui = ["3s 后播放下一个视频", "用户7048135123713", "作者", "3小时前", "1周前·湖北", "请问怎么去", ""]
    assert column(spark, ui, lambda c: T.is_ui_residue(c, rules)) == [True, True, True, True, True, False, True]
    who = ["4853叶镇平出海贸易", "2.5万勇闯非洲的家敏", "40万马拉维币等于多少人民币", "你好"]
    assert column(spark, who, lambda c: T.is_account_mention(c, rules)) == [True, True, False, False]
    spec = "沙坪河段情况说明如下：水深6.3米，宽度80米，最小弯曲半径330米，请各单位注意"
    assert column(spark, [spec, "水深：3米"], lambda c: T.is_spec_residue(c, rules)) == [True, False]
    text = ["请问在加纳怎么开店", "第3集 | 非洲", "a#b#c#d 非洲", "x", "hello", "网页全屏 你好", "下载这个"]
    assert column(spark, text, lambda c: T.is_comment_text(c, rules)) == [True, False, False, False, False, False, False]
    assert column(spark, ["  好的呢 ", "3 小时前 湖北", "好", "京公网安备 12"], lambda c: T.clean_comment(c, rules)) == ["好的呢", None, None, None]
    echo = "非洲钢铁厂投产记录 今天" + "很" * 30 + "非洲钢铁厂投产记录"
    assert one(spark, echo, lambda c: T.is_feed_caption(c, rules)) is True


def test_hooks(spark):
    titles = {"为什么阿比让的仓库租金涨了 40%？": "疑问式", "别碰这个生意": "反常识/否定", "第一年我亏了三十万": "结果前置", "3 个月建成一座工厂": "数字锚点",
              "老板都在看的非洲市场": "身份标签", "买房还是租房": "对比", "清关的潜规则": "内幕/揭秘", "今天天气不错": L.DEFAULT_HOOK}
    d = spark.createDataFrame([(k, "从 7 天涨到 18 天", v) for k, v in titles.items()], "title string, body string, want string")
    got = d.select("want", R.first_label([F.col("title"), F.substring("body", 1, 60)], L.SERVICE_HOOKS, L.DEFAULT_HOOK).alias("got")).collect()
    assert [r["got"] for r in got if r["want"] != L.DEFAULT_HOOK] == [r["want"] for r in got if r["want"] != L.DEFAULT_HOOK]
    # The body counts only when the title says nothing.
    assert [r["got"] for r in got if r["want"] == L.DEFAULT_HOOK] == ["数字锚点"]
    assert column(spark, ["揭秘：3个方法", "hello"], lambda c: F.array_join(R.all_labels(c, L.TITLE_HOOKS, L.NO_HOOK), "|")) == [
        "数字罗列|好奇悬念|稀缺独家|实用指南", L.NO_HOOK]


def test_text_shapes(spark):
    assert one(spark, "# Head\n- **bold** `x` [t](u)\n\n```a```", T.strip_markdown) == "Head bold x t"
    assert one(spark, "出海 go-to 市场A", lambda c: F.array_sort(T.index_tokens(c))) == sorted(["出海", "go", "to", "市场a"])
    assert one(spark, "海外仓储", lambda c: F.size(T.index_tokens(c))) == 6  # the whole, three pairs, two triples
    assert one(spark, "5904锋哥在非洲(加纳)", T.normalize_name) == "锋哥在非洲"


def test_parsers(spark):
    d = spark.createDataFrame([("合集 03:41 1.1万 成长永远比被爱更重要！ #女性成长 #自我成长 @你好周洋帆 9月前",)], "x string")
    r = Pa.parse_desc(d, "x").first()
    assert (r["duration"], r["play_count"], r["tags"], r["author"], r["publish_time"], r["title"]) == (
        "03:41", 11000, ["女性成长", "自我成长"], "你好周洋帆", "9月前", "成长永远比被爱更重要！")
    card = "非洲小张\n关注\n抖音号: zx88633.6万获赞12.4万粉丝\n短\n专注加纳清关物流八年"
    r = Pa.parse_account_card(spark.createDataFrame([(card,)], "x string"), "x").first()
    assert (r["nickname"], r["followers"], r["signature"]) == ("非洲小张", 124000, "专注加纳清关物流八年")
    note = '{"note": {"noteId": "n1", "title": " t ", "interactInfo": {"likedCount": "1.2万", "commentCount": 7}, "time": 1704067200000, "tagList": [{"name": "阿比让"}, {"name": "非洲"}], "user": {"nickname": "u"}}}'
    r = Pa.parse_note_detail(spark.createDataFrame([(note,)], "x string"), "x").first()
    assert (r["note_id"], r["title"], r["likes"], r["comments_cnt"], r["publish_time"], r["tags"], r["shares"]) == (
        "n1", "t", 12000, 7, "2024-01-01 08:00", "阿比让,非洲", None)
    names = "就职于安哥拉世纪城和坦桑北京工业园 海外仓"
    assert "安哥拉世纪城" in one(spark, names, lambda c: F.array_join(Pa.extract_projects(c), "|"))
    assert one(spark, "小刘在安哥拉中国城", lambda c: Pa.clean_seed(c, ["安哥拉", "加纳"])) == "安哥拉中国城"


def test_front_matter_without_any(spark):
    r = Pa.front_matter(spark.createDataFrame([("plain text",)], "x string"), "x").first()
    assert (r["id"], r["themes"], r["relationships"], r["body"]) == (None, [], [], "plain text")


def test_default_account_classes(spark):
    from tidemark.operators import accounts as A

    data = [("加纳物流", "专注非洲清关 海运 货代 出口"), ("环球小王", "旅行 旅拍 穷游 自驾游"), ("某报", "新闻门户 主流媒体"), ("路人", "hello")]
    d = A.account_features(spark.createDataFrame(data, "nick string, sig string"), "nick", "sig", None, A.default_signals())
    got = {r["nick"]: r["class"] for r in A.classify_account(d).collect()}
    assert got == {"加纳物流": A.CLASSES["region_business"], "环球小王": A.CLASSES["travel"], "某报": A.CLASSES["media"], "路人": A.CLASSES["none"]}


def test_anchored_service_defaults(spark):
    rule = lambda c: Mo.anchored_service(c, L.STRONG_SERVICE, L.EXCLUDED_SERVICE, L.REGION_ANCHORS, L.CROSS_BORDER_SERVICE, L.CROSS_BORDER_CONTEXT)
    texts = ["非洲清关专线", "杭州产业园招商", "国际海运订舱", "非洲酒店招商"]
    assert column(spark, texts, rule) == [True, False, True, False]


def test_account_scores_follow_the_rules(spark):
    """Hand-made accounts: verification text, name patterns and the place of a listed name in a nickname."""
    from tidemark.operators import accounts as A

    rows = [("某某日报", "", "", 90), ("海边小店", "", "某某广播电视台", 90), ("海边小店", "", "某某市政府办公室", 85), ("海边小店", "", "某某有限公司", 0),
            ("观察者网", "", "", 80), ("观察者网国际", "", "", 75), ("小小观察者网", "", "", 70), ("关于观察者网的很多事", "", "", 0), ("路人", "我们是主流媒体", "", 85)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, nick string, sig string, verify string, want long")
    got = A.account_features(df, "nick", "sig", "verify", A.default_signals(whitelist=["观察者网"])).orderBy("id").collect()
    assert [r.media_score for r in got] == [r[3] for r in rows]
    assert got[3].enterprise_score == 80 and got[2].enterprise_score == 0


def test_default_words_of_the_page_are_no_comments(spark):
    from tidemark.functions import text as T

    df = spark.createDataFrame([("播放中",), ("点击加载更多 x",), ("这个港口很大",)], "t string")
    got = [r.r for r in df.select(T.is_ui_residue(F.col("t"), T.CommentRules()).alias("r")).collect()]
    assert got[0] and not got[2]


def test_original_sound_has_three_rules(spark):
    from tidemark.operators import accounts as A

    rows = [("@小王的歌", "", "小王", True), ("小王的歌", "", "小王", False), ("", "歌手小王", "小王", True), ("某人创作的原声", "", "小王", True), ("", "谁", "", True), (None, None, "小王", False)]
    df = spark.createDataFrame(rows, "t string, a string, n string, w boolean")
    assert all(r.g == r.w for r in df.select("w", A.original_sound(F.col("t"), F.col("a"), F.col("n")).alias("g")).collect())


def test_strip_markdown_leaves_unmarked_texts_to_the_space_rule(spark):
    from functools import reduce

    from pyspark.sql import functions as F

    from tidemark.functions import text as T

    def whole(col):  # every pattern on every text
        steps = ((r"```(?s:.*?)```", " "), (r"`([^`]+)`", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"!\[[^\]]*\]\([^)]+\)", " "),
                 (r"(?m)^#{1,6}\s*", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*\d+\.\s+", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"),
                 (r"__([^_]+)__", "$1"), (r"_([^_]+)_", "$1"), (r"\s+", " "))
        return T.strip(reduce(lambda c, s: F.regexp_replace(c, *s), steps, T.strip_front_matter(col)))

    texts = ["plain  text\r\nof two", " \t a", "", None, "---\nx: y\n---\nbody", "# head", "- item", "1. one\n12.  two", "1.5 and 3", "a *b* **c** _d_ __e__",
             "`x` ```y\nz```", "[a](b) ![c](d)", "![", "a + b", "+ b", "é  ü\n\n3 .", "\n\n  7.\t x"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    got = df.select(T.strip_markdown(F.col("x")).alias("a"), whole(F.col("x")).alias("b"))
    assert all(r.a == r.b for r in got.collect())
    assert "CASE WHEN" in got.select("a")._jdf.queryExecution().optimizedPlan().toString()


def test_chunk_collection_strips_each_part_once(spark):
    from tidemark.operators import corpus as Co

    long = "\n\n".join(f"paragraph {i} " + "with *many* words " * 5 for i in range(14))
    docs = spark.createDataFrame([(1, long), (2, "a line of more than thirty characters\nshort\na line of more than thirty characters\nhttps://" + "x" * 40), (3, None)], "k int, text string")
    out = Co.chunk_collection(docs, "k", "text", skip="^Of ")
    rows = [(r.k, r.chunk_no, r.chunk) for r in out.orderBy("k", "chunk_no").collect()]
    assert rows == [(1, i + 1, f"paragraph {i} " + " ".join(["with many words"] * 5)) for i in range(12)] + [(2, 1, docs.where("k = 2").first()["text"].replace("\n", " ")), (2, 2, "a line of more than thirty characters")]
    plan = out.select("chunk")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("__([^_]+)__") <= 3  # bodies, paragraphs, lines; twice as many when a part is stripped to be judged and again to be kept


def test_topic_assign_reads_texts_of_samples_alone_again(spark):
    from tidemark.operators import comments as C

    rows = [(i, None if i % 7 == 3 else i, f"Text {'alpha' if i % 3 else 'beta'} {'gamma' if i % 5 == 0 else ''} {i}" if i % 4 else "none of them") for i in range(60)]
    df = spark.createDataFrame(rows + [(None, 5, None)], "a int, b int, text string")
    top = spark.createDataFrame([("alpha", 9), ("gamma", 9), ("beta", 3)], "word string, n long")
    out = C.topic_assign(df, top, ["a", "b"], k_samples=3)
    pick = lambda x: next((w for w in ("alpha", "gamma", "beta") if x and w in x.lower()), "other")
    want = {}
    for a, b, x in sorted(rows + [(None, 5, None)], key=lambda r: (r[0] is not None, r[0] or 0)):
        want.setdefault(pick(x), []).append(x)
    assert {(r.topic, r.n_texts, r.sample_no, r.text) for r in out.collect()} == {(t, len(v), i + 1, x) for t, v in want.items() for i, x in enumerate(v[:3])}
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
