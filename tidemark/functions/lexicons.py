"""Default rule tables. Every operator takes its own table as an argument instead.

The values below are fixed values: results on the platform's own data depend on them.
"""

# --- fixed values: question, number and exclamation in a title
QUESTION_MARKS = r"[?？]|吗|么|怎么|如何|什么|为什么|哪|谁|几"
NUMBER_MARKS = r"\d+"
EXCLAMATION_MARKS = r"[!！]"

# --- fixed value: what the title of an original sound says
ORIGINAL_SOUND = "创作的原声"

# --- fixed values: comment cleaning -----------------------------------------------------------
COMMENT_NOISE = ["京公网安备", "备案号", "立即领取", "快乐大本营", "大学生免费用",
                 "我的喜欢", "充钻石", "进入全屏", "播放中", "退出全屏"]
#: words of the page's own controls: a comment that contains one is none
CONTROL_WORDS = [
    "许可证", "备案", "举报", "电话", "邮箱", "京ICP", "©", "版权", "算法", "饭圈", "广播", "网络文化", "互联网", "药品", "器械",
    "宗教", "投诉", "客服", "登录", "注册", "搜索", "首页", "电子营业执照", "广告投放", "友情链接", "站点地图", "加入我们",
    "联系我们", "用户服务协议", "隐私政策", "账号找回", "抖音电商", "观看历史", "连播", "我的作品", "点击加载更多", "放映厅",
    "阅读全文", "短视频", "直播", "下载抖音", "创作者学习中心", "创作者中心", "作者赞过", "听抖音", "AI抖音", "读屏",
    "在线状态", "隐私设置", "热门：", "大家都在搜", "作品数据", "稍后再看", "网页全屏", "进入全屏", "高清", "清屏", "倍速",
    "画质", "弹幕", "音效", "字幕", "暂停", "静音", "下载抖音精选", "人服证字", "网络谣言", "曝光台",
    "壁纸", "重播", "投稿", "充钻石", "客户端", "截图", "小窗模式", "抢首评", "暂无评论", "暂无会话", "全部评论", "我的收藏", "我的喜欢",
    "我的预约", "我的订单", "认证徽章", "视频管理", "推荐视频", "店铺账号", "章节要点", "见面会内容", "AI音乐创作", "拖动视频",
    "留下你的精彩评论", "大学生免费用", "3个月会员", "免费领取会员", "会员免费领", "开通会员", "会员权益", "立即开通", "首月优惠",
    "短剧", "通知", "消息", "狗杂", "30天内", "7天内", "90天内", "我的", "朋友", "用户", "下一章", "结语", "引言",
]
#: labels of the player: a comment that is one of them is none
PLAYER_WORDS = [
    "播放中", "暂停", "全屏", "倍速", "画质", "弹幕", "发送", "评论", "点赞", "收藏", "分享", "转发", "推荐", "关注",
    "展开", "收起", "精选", "作者", "回复", "下载", "自动播放", "静音", "音量", "竖屏", "横屏", "拖动", "进度",
    "上滑", "下滑", "实时", "连麦", "加号", "拍摄", "道具", "音乐", "原声", "合拍", "剪映", "话题", "定位", "经验",
    "3s 后播放", "3s 后播放下一个视频", "3s 后循环播放当前视频",
]
RELATIVE_TIME_ROW = r"^\d+\s?(小时|分钟|天)前.*$"
RELATIVE_TIME_PLACE = r"^\d+(小时|分钟|天|周|月|年)前(·\S+)?$"
REPLY_FOLD = r"^(展开|收起)\d*条?回复"
PLACEHOLDER_USER = r"^用户\d{6,}$"
COUNTDOWN = r"^\d+\s*s\s*后(播放|播放下一个视频|循环播放当前视频)?$"
ACCOUNT_MENTION = r"^\d+(?:\.\d+)?万?\S{2,20}$"
COMMENT_MARKER = r"(吗|呢|怎么|我|你|想|请问|可以|有没有|多少|价格|联系|需要|麻烦|老板|请教|求|帮)"
SPEC_UNIT = r"(?:米|公里|千米|厘米|毫米|吨|立方米|平方米|公顷|亩|节|海里)"
EPISODE_PREFIX = r"^第\d+[集期][\s|｜]"
COLUMN_WORDS = ["本期拆解", "第一视角", "免责声明", "周报", "新片预告"]
TITLE_MARKS = r"[【】《》「」｜|]"

# --- fixed values: demand categories and questions ---------------------------------------------
DEMAND_CATEGORIES = [
    ("投资创业", r"(创业|投资|开厂|办厂|建厂|做生意|开店|考察|项目|布局|入场|市场怎么样|搞实业|实业)"),
    ("货源采购", r"(采购|批发|进货|货源|拿货|供应|报价|多少钱|价格|成本|渠道拿|找.{0,3}(货源|供应商)|出口.{0,4}(怎么|如何))"),
    ("意向咨询", r"(怎么|如何|能不能|可不可以|需要什么|什么条件|手续|流程|求带|带带我|请教|咨询|求助|行不行|靠谱吗|有没有.{0,3}(风险|搞头|前途))"),
    ("合作商务", r"(合作|加盟|代理|合伙|对接|资源|人脉|交流|认识一下|找.{0,3}(合作|老板)|商务|一起做|入伙)"),
    ("渠道获客", r"(引流|获客|涨粉|直播|带货|渠道|客户|销售|推广|账号|内容|短视频|粉丝)"),
]
QUESTION_WORDS = [
    ("怎么", r"怎么"), ("能不能", r"能不能|可不可以|行不行"), ("多少钱", r"多少钱|什么价|价格|报价"),
    ("如何", r"如何"), ("可以吗", r"可以吗|可以么"), ("安全吗", r"安全吗|安全么|风险"),
    ("需要什么", r"需要什么|什么条件|需要哪些"),
]

# --- fixed values: title hooks -----------------------------------------------------------------
TITLE_HOOKS = [
    ("数字罗列", r"(\d+[个种条项大]|[Tt][Oo][Pp]\s*\d+|第[一二三四五六七八九十\d]+)"),
    ("好奇悬念", r"(为什么|怎么|如何|你知道吗|竟然|居然|原来|真相|揭秘|曝光)"),
    ("对比反差", r"((?i:vs)|对比|差别|区别|不同|竟然|居然|反而|却是)"),
    ("情绪共鸣", r"(太|好|最|绝|爆|燃|泪目|感动|震惊|可怕|恐怖|疯狂|牛逼|厉害)"),
    ("稀缺独家", r"(揭秘|独家|首次|罕见|秘密|内幕|不为人知|99%|百分九十九|没几个人)"),
    ("实用指南", r"(教程|攻略|方法|技巧|干货|建议|指南|步骤|必看|收藏|避坑)"),
    ("亲身经历", r"(我在|经历|故事|见过|亲历|实拍|记录|日记)"),
]
NO_HOOK = "无明确钩子"
SERVICE_HOOKS = [
    ("疑问式", r"[？?]$|^(为什么|怎么|如何|哪些|有没有|要不要|是不是)"),
    ("反常识/否定", r"^(别|不要|千万别|不是|没人|劝你|停止)|别(碰|这样|买|做)"),
    ("结果前置", r"(赚了|亏了|亏|翻车|血泪|教训|第一年.*(赚|亏))"),
    ("数字锚点", r"\d+\s*(个|条|年|天|万|块|平|次|种|步|%)"),
    ("身份标签", r"(老板|同行|新手|小白|中介|创业者|出海|工厂|货代)"),
    ("对比", r"(vs|VS|还是|对比|区别|差别)"),
    ("内幕/揭秘", r"(内幕|揭秘|真相|潜规则|没人告诉你)"),
]
GEO_HOOKS = [
    ("认知反差", r"(你以为|想不到|没想到|竟然|居然|原来|其实|真相|颠覆|反常识|相反)"),
    ("稀缺信息", r"(全网|没人(讲|说)|教科书|99%|很少有人|冷知识|不知道|不为人知|独家|仅此)"),
    ("排名榜单", r"(TOP|top|Top|排行|榜单|榜(单)?|第[一二三四五六七八九十\d]+名|最(大|小|多|少|贵|便宜|富|穷|强|惨))"),
    ("投资视角", r"(赚钱|赚什么|生意|商机|红利|掘金|暴利|利润|做什么|投资|风口|成本|关税|注册)"),
    ("地理特征", r"(出海口|内陆国|海岸线|海峡|运河|边界|纬度|气候|雨林|沙漠|河流|港口|资源)"),
    ("对比", r"(vs|VS|对比|区别|差别|同样|一条.*两国)"),
    ("数字锚点", r"\d+\s*(个|条|国|年|亿|万|%|倍|公里|美元)"),
    ("时点", r"(20\d\d|最新|刚刚|今年|本月|本周|一季度)"),
]
DEFAULT_HOOK = "陈述式"
GEO_SIGNAL = (r"地图|全球|各国|世界|国家|地理|排行|榜单|TOP|GDP|人口|出海口|"
              r"内陆国|海岸线|海峡|运河|边界|纬度|资源分布|港口|一带一路")

# --- fixed values: content types, information types, motifs ------------------------------------
CONTENT_TYPES = {
    "干货知识": ["如何", "怎么", "技巧", "方法", "教程", "干货", "避坑", "攻略", "指南"],
    "故事Vlog": ["vlog", "Vlog", "记录", "日常", "我的", "今天", "旅行", "生活"],
    "新闻资讯": ["最新", "突发", "新闻", "宣布", "正式", "签约", "投资"],
    "产品展示": ["工厂", "产品", "源头", "批发", "价格", "质量", "车间"],
    "观点口播": ["为什么", "我认为", "说实话", "很多人不知道", "分析", "解读"],
    "招聘求职": ["招聘", "求职", "找工作", "招人", "待遇", "工资"],
}
INFO_TYPES = [
    ("机会", r"(机会|红利|商机|赚钱|掘金|风口|值得|可以做|蓝海|缺口|需求)"),
    ("风险", r"(坑|风险|注意|别|危险|失败|崩|违约|亏|陷阱|血亏|避)"),
    ("数据排名", r"(TOP|top|排行|榜单|排名|第[一二三四五六七八九十\d]+名|GDP|人均|增速)"),
    ("对比", r"(vs|VS|对比|区别|差别|同样|不如|胜过)"),
    ("科普", r"(为什么|起源|历史|地理|文化|人口|气候|河流|边界)"),
]
MOTIFS = [
    ("资源禀赋", r"(矿产|石油|天然气|黄金|铜|钴|锂|铀|钻石|铝土|铁矿|森林|渔业|资源|稀土)"),
    ("物流通道", r"(港口|物流|走廊|铁路|公路|清关|仓储|运输|航运|海运|码头|通道)"),
    ("政策合规", r"(政策|注册|税收|关税|签证|许可证|法规|外汇管制|合规|准入|落地|门槛)"),
    ("成本要素", r"(成本|租金|价格|便宜|贵|人工|工资|运费|电费|税费|开销)"),
    ("金融汇率", r"(汇率|银行|融资|贷款|通胀|货币|支付|外汇|保险|资本)"),
    ("市场消费", r"(消费|市场|中产|零售|需求|收入|购买力|客单|渠道)"),
    ("人口人力", r"(人口|劳动力|年轻人|人力|教育|就业|用工|生育)"),
    ("地缘政治", r"(地缘|冲突|战争|制裁|安全|政局|军事|选举|政变)"),
    ("地理气候", r"(气候|沙漠|雨林|干旱|洪水|河流|海岸|纬度|地形|水土)"),
    ("产业图谱", r"(工厂|制造|农业|矿业|加工|纺织|建筑|数字|科技|IT|产业园|加工业)"),
]
OTHER = "其他"
GLOBAL_WORDS = ["全球", "世界", "全世界", "各国", "遍布", "遍布全球"]
REGION_WORDS = {
    "西非": "西非", "东非": "东非", "北非": "北非", "中非": "中非",
    "南部非洲": "南部非洲", "非洲": "非洲（大区）", "撒哈拉": "撒哈拉带",
    "东南亚": "东南亚", "南亚": "南亚", "中亚": "中亚", "东亚": "东亚",
    "中东": "中东", "海湾": "海湾", "波斯湾": "海湾",
    "南美": "南美", "拉美": "拉美", "拉丁美洲": "拉美", "北美": "北美",
    "欧洲": "欧洲", "巴尔干": "巴尔干", "高加索": "高加索",
    "一带一路": "一带一路", "印度洋": "印度洋", "太平洋": "太平洋",
}

# --- fixed values: news accounts and account roles ---------------------------------------------
NEWS_WORDS = ["新闻", "日报", "TV", "卫视", "资讯", "网", "广播", "频道", "CCTV", "cctv",
              "新华社", "人民日报", "环球", "参考消息", "中国日报", "凤凰", "观察者",
              "头条", "快报", "官方发布", "电视台", "传媒", "报道", "时报", "央视频",
              "央视", "观察", "财经网", "新媒体"]
OFFICIAL_ROLE = (r"(?i)官方|招商|运营|管委会|有限公司|集团|投资|development|自贸区|合作区|"
                 r"产业园$|工业园$|商贸城$|中国城$")
CONTACT_ROLE = r"(?i)微信|V[:：]|wechat|whatsapp|电话|TEL|联系"
TENANT_ROLE = r"店|铺|档口|批发|零售|专营|总代|实体店"
PERSONAL_ROLE = (r"(?i)生活|日常|vlog|记录|随手|打工|厨师|司机|保姆|相亲|恋爱|旅游|见闻|"
                 r"民宿|美食|钓鱼|高尔夫")

# --- fixed values: project names ---------------------------------------------------------------
PROJECT_SUFFIXES = ["商贸城", "中国城", "世纪城", "商贸中心", "商贸广场", "小商品城", "百货城",
                    "产业园", "工业园", "工业区", "开发区", "经济特区", "经济区",
                    "海外仓", "展销中心", "选品中心", "商城", "市场"]
PROJECT_NOISE_PREFIXES = ["就职于", "工作于", "就职", "工作", "专注", "专注于", "深耕", "扎根",
                          "旗下的", "旗下", "运营", "坐标", "来自", "位于", "入驻", "进驻",
                          "逛", "带你看", "走进", "直击", "实拍"]

# --- fixed values: metric tiers ----------------------------------------------------------------
FOLLOWER_TIERS = ([(1000, "微小(<1K)"), (10000, "小(1K-1W)"), (100000, "中(1W-10W)"),
                   (1000000, "大(10W-100W)")], "超大(>100W)")
TIER_CYCLE_DAYS = {"S": 1, "A": 3, "B": 7}

# --- fixed values: broad title hooks (eight labels) ----------------------------------------------
BROAD_HOOKS = [
    ("疑问句", r"？|\?|吗|呢|吧|怎么样|如何|怎么"),
    ("数字罗列", r"\d+个|\d+种|\d+万|\d+年|第\d|TOP\d|Top\d"),
    ("警告避坑", r"坑|避坑|注意|千万别|警惕|骗局|血亏|亏了|踩雷"),
    ("如何教你", r"如何|怎么|教你|手把手|秘籍|干货|攻略"),
    ("对比反差", r"还是|vs|VS|对比|没想到|居然|其实"),
    ("情绪强烈", r"暴利|赚翻|血赚|崩溃|太难了|绝了|炸了|必看"),
    ("稀缺独家", r"独家|第一次|罕见|揭秘|内幕|真相|只有"),
    ("时间紧迫", r"最新|刚刚|今天|昨天|紧急"),
]

# --- fixed values: service accounts --------------------------------------------------------------
STRONG_SERVICE = ["物流", "货代", "清关", "海外仓", "专线", "海运", "空运", "供应链", "考察团", "招商", "产业园", "工业园",
                  "落地服务", "公司注册", "代办", "对接", "商会", "带路", "出海服务", "双清", "服务中心", "安保联防"]
EXCLUDED_SERVICE = ["民宿", "酒店", "宾馆", "旅馆", "睡衣", "选矿", "金矿", "农场", "养殖", "翻译社", "俱乐部", "黑杨", "商贸城", "媳妇",
                    "跨国恋", "红宝石", "黄金矿业", "钻石", "工厂", "菏泽", "牡丹芍药", "孵化器", "时光机", "做证明题", "建材超市"]
CROSS_BORDER_SERVICE = ["货代", "清关", "双清", "海外仓", "专线", "海运", "空运", "订舱", "报关", "考察团", "落地服务", "签证",
                        "ECTN", "COC", "PVOC", "拼柜", "整柜"]
CROSS_BORDER_CONTEXT = ["跨境", "外贸", "出口", "国际", "出海", "海外", "全球", "门到门", "到门"]
REGION_ANCHORS = ["非洲", "中非", "北非", "西非", "东非", "南非", "撒哈拉"]

# --- fixed values: account signals (word list, weight) --------------------------------------------
MEDIA_NAMES = [
    (r"^[一-鿿·]{1,6}(新闻|日报|晚报|时报|商报|快报|周报|早报|导报|都市报|发布|发布厅|卫视|电视台|广播|融媒|融媒体|在线|头条|快讯|资讯|要闻|新闻网)$", 90),
    (r"^(外交部|商务部|国务院|海关总署|教育部|国防部)", 90), (r"办公厅$", 85), (r"^[一-鿿]{2,4}网$", 60),
]
MEDIA_VERIFIED = r"广播电视台|报社|报业|日报|新闻|传媒集团|融媒体|卫视|电视台|官方账号|官方抖音"
ENTERPRISE_VERIFIED = r"公司|集团|企业|实业|工厂|银行|保险|证券|基金"
AUTHORITY_VERIFIED = r"政府|局|委|部|办"
MEDIA_SIGNATURES = [
    (r"(官方账号|官方抖音|官方号|官方频道)", 80), (r"(新闻门户|主流媒体|新闻媒体|新闻网站|新闻客户端|新闻中心)", 85),
    (r"(报业集团|传媒集团|广播电视台|新媒体集团|融媒体中心)", 85), (r"(党委机关报|党报|官方新闻|权威新闻)", 80),
    (r"(互联网新闻信息|新闻采编|原创报道)", 70), (r"(省级媒体|市级媒体|国家级媒体|中央媒体)", 70), (r"(新闻频道|综合频道|新闻综合)", 65),
]
ENTERPRISE_NAMES = [
    (r"(公司|集团|工厂|厂家|实业|企业|品牌|平台)$", 50),
    (r"[一-鿿]{2,6}(贸易|物流|机械|食品|建材|服装|电子|化工|矿业|能源|农业|渔业|牧业|医药|汽车|房产|酒店|餐饮|旅游|教育|科技|信息|投资|金融|咨询|服务|传媒|文化|广告|设计)$", 60),
]
PERSONAL_WORDS = [(r"(本人|个人|私人|非官方|不代表)", 40), (r"(我是|我是一个|我叫|大家好我是)", 30), (r"(喜欢|爱好|热爱|梦想|兴趣)", 15)]
DOMAIN_WORDS = {
    "finance": [(["财经", "经济", "金融", "股票", "基金", "理财", "汇率", "美元", "美金", "人民币汇率"], 15),
                (["投资", "赚钱", "变现", "营收", "月入", "年入", "盈利", "销售额", "订单"], 8)],
    "trade": [(["外贸", "进出口", "出口", "进口", "跨境", "出海", "贸易"], 15),
              (["清关", "报关", "货代", "批发", "采购", "供应", "货源", "选品", "物流", "货运", "海运", "空运", "供应链", "仓储"], 8),
              (["公司", "集团", "企业", "实业", "工厂", "厂家", "车间", "生产", "加工", "制造", "产业园", "工业园", "开发区", "品牌", "平台", "产品"], 5),
              (["老板", "创始人", "合伙人", "总经理", "董事长", "ceo", "总裁", "创业者"], 5),
              (["经营", "运营", "主营", "从事", "深耕", "专注", "销售", "出售", "招商", "加盟", "合作"], 5)],
    "travel": [(["旅行", "旅游", "旅拍", "背包客", "穷游", "环球旅行", "自驾游"], 15), (["自驾", "环球", "游世界", "探险", "户外", "在路上"], 8)],
    "military": [(["军事", "军武", "军旅", "武器", "战争", "时政", "地缘政治"], 15),
                 (["局势", "国防", "军队", "部队", "战场", "作战", "特种兵", "国际关系", "国际局势", "国际新闻", "地缘"], 8)],
    "knowledge": [(["科普", "百科", "冷知识", "奇闻", "揭秘", "探索未知"], 15),
                  (["科学", "科技", "地理知识", "历史知识", "人文", "纪录片", "课堂", "讲解", "教学", "学习", "知识分享"], 8)],
    "lifestyle": [(["美妆", "穿搭", "时尚", "美食", "做饭", "宠物", "健身", "减肥", "瑜伽", "母婴", "育儿", "星座", "情感", "恋爱", "种草", "好物", "vlog"], 10)],
}
NICKNAME_WORDS = {
    "entertainment": (["搞笑", "段子", "沙雕", "娱乐", "追剧", "剧场", "短剧", "电影", "影视", "影业", "综艺", "剪辑", "混剪", "解说", "剧情", "好剧", "新剧"], 25, 10),
    "sports": (["体育", "足球", "篮球", "nba", "cba", "英超", "西甲", "中超", "电竞", "游戏", "王者荣耀", "和平精英", "英雄联盟", "lpl", "kpl", "解说员",
                "世界杯", "欧洲杯"], 25, 10),
}
CREATOR_WORDS = ["商务合作", "商务", "星图", "合作私信", "合作请私", "合作v", "合作微信", "合作wx", "合作vx", "合作联系", "合作洽谈", "接广", "接单", "接合作",
                 "品牌合作", "品牌推广", "招募", "招聘", "招人", "剪辑", "文案", "写手", "mcn", "达人", "博主"]
REGION_CONTEXT = ["撒哈拉", "中非", "东非", "西非", "北非", "驻华大使馆"]
