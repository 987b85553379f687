"""Fixed values and tunable parameters of the news engine."""

from __future__ import annotations

from dataclasses import dataclass, field

# Results depend on exactly these words, numbers and patterns.
CATEGORIES = ["china", "international", "policy", "society", "finance", "technology", "ai", "science", "sports", "entertainment"]
TIE_ORDER = ["sports", "ai", "technology", "finance", "policy", "china", "international", "science", "society", "entertainment"]
CATEGORY_IMPORTANCE = {
    "ai": 78, "technology": 72, "finance": 76, "international": 82, "china": 80,
    "policy": 84, "society": 62, "sports": 45, "entertainment": 40, "science": 70,
}
BEAT_IMPACT = {
    "ai": 46, "technology": 44, "finance": 54, "international": 55, "china": 58,
    "policy": 66, "society": 44, "sports": 26, "entertainment": 22, "science": 48,
}
CATEGORY_KEYWORDS = {
    "ai": ["ai", "artificial intelligence", "openai", "anthropic", "claude", "chatgpt", "大模型", "人工智能", "模型"],
    "technology": ["technology", "tech", "startup", "software", "chip", "semiconductor", "科技", "芯片", "软件"],
    "finance": ["market", "stock", "bank", "finance", "economy", "inflation", "财经", "金融", "市场", "经济"],
    "international": ["world", "global", "war", "conflict", "diplomacy", "国际", "全球", "战争", "冲突"],
    "china": ["china", "chinese", "beijing", "中国", "国内", "北京"],
    "policy": ["policy", "regulation", "government", "election", "law", "政策", "监管", "政府", "选举"],
    "society": ["society", "city", "education", "health", "社会", "教育", "健康", "城市"],
    "sports": ["nba", "fifa", "fiba", "basketball", "football", "soccer", "sport", "体育", "篮球", "足球"],
    "entertainment": ["film", "movie", "tv", "music", "entertainment", "电影", "影视", "娱乐", "音乐"],
    "science": ["science", "research", "study", "space", "physics", "科学", "研究", "太空"],
}
#: Signals of a category in a text and in a URL, and the order of categories of equal score there.
CATEGORY_SIGNALS = {
    "ai": (["ai", "artificial intelligence", "openai", "anthropic", "claude", "chatgpt", "大模型", "人工智能", "机器学习"], [r"/ai\b", r"artificial-intelligence"]),
    "technology": (["technology", "tech", "startup", "software", "chip", "semiconductor", "科技", "芯片", "软件", "互联网", "创业"], [r"/tech(?:nology)?\b", r"/it\b"]),
    "finance": (["market", "stock", "bank", "finance", "economy", "inflation", "财经", "金融", "市场", "经济", "央行", "股票", "公司"], [r"/finance\b", r"/business\b", r"/cj/", r"/money/"]),
    "international": (["world", "global", "war", "conflict", "diplomacy", "国际", "全球", "外交", "战争", "冲突", "联合国"], [r"/world\b", r"/international\b", r"/gj/"]),
    "china": (["china", "chinese", "beijing", "中国", "国内", "北京", "全国"], [r"/china\b", r"/gn/"]),
    "policy": (["policy", "regulation", "government", "election", "law", "政策", "监管", "政府", "选举", "法律", "部门"], [r"/politics\b", r"/policy\b"]),
    "society": (["society", "city", "education", "health", "社会", "教育", "健康", "城市", "民生"], [r"/society\b", r"/sh/", r"/edu/", r"/health/"]),
    "sports": (["nba", "fifa", "fiba", "basketball", "football", "soccer", "sport", "体育", "篮球", "足球", "赛事", "锦标赛"], [r"/sports?\b", r"/nba\b", r"/football\b", r"/basketball\b"]),
    "entertainment": (["film", "movie", "tv", "music", "entertainment", "电影", "影视", "娱乐", "音乐", "剧集"], [r"/entertainment\b", r"/culture\b", r"/film\b", r"/movie\b"]),
    "science": (["science", "research", "study", "space", "physics", "科学", "研究", "太空", "航天", "行星"], [r"/science\b", r"/space\b"]),
}
SIGNAL_ORDER = ["sports", "ai", "science", "technology", "finance", "international", "policy", "china", "society", "entertainment"]
HIGH_IMPACT = [
    "war", "conflict", "election", "sanction", "rate cut", "rate hike", "inflation", "ai model", "semiconductor", "cyberattack", "regulation", "earthquake",
    "战争", "冲突", "选举", "制裁", "降息", "加息", "通胀", "大模型", "芯片", "网络攻击", "监管", "地震",
]
STOP_WORDS = ["the", "and", "for", "with", "from", "this", "that", "into", "over", "news", "says", "after", "about", "最新", "新闻", "报道", "发布", "今日", "持续"]
ENTITY_IGNORED = ["news", "latest", "update", "report", "报道", "消息", "最新", "宣布", "发布"]
NAVIGATION = "^(home|index(?:\\.html?)?|news|latest|world|china|sports|technology|science|business|category|categories|tag|tags|search|topic|topics|section|sections)$"
PROMOTION = [
    "(?i)\\b(sponsored|advertorial)\\b",
    "(赞助内容|商业推广|广告合作|广告链接|推广链接|优惠券|折扣码|购物导购)",
    "(立即|点击|扫码|限时|下单|购买|领取|抢购).{0,12}(优惠|折扣|购买|下单|领取|咨询|活动)",
]
#: For each pattern of promotion words of which it needs one.
PROMOTION_WORDS = [
    ["sponsored", "advertorial"], ["赞助内容", "商业推广", "广告合作", "广告链接", "推广链接", "优惠券", "折扣码", "购物导购"],
    ["立即", "点击", "扫码", "限时", "下单", "购买", "领取", "抢购"],
]
EVENT_TYPES = [
    ("policy", "(政策|监管|法规|法律|选举|government|policy|regulation|election)"),
    ("conflict", "(战争|冲突|袭击|停火|war|conflict|attack|ceasefire)"),
    ("disaster", "(地震|洪水|台风|火灾|灾害|earthquake|flood|storm|disaster)"),
    ("economy", "(经济|市场|利率|通胀|金融|economy|market|rate|inflation)"),
    ("research", "(研究|论文|发现|science|research|study)"),
    ("product", "(发布|推出|模型|产品|launch|release|model|product)"),
]
BEAT_EVENT_TYPES = {"sports": "sports", "entertainment": "culture", "finance": "company"}
IMPACT_BOOSTS = [
    (25, "(战争|冲突|袭击|火灾|地震|洪水|台风|死亡|伤亡|停火|制裁|禁运|war|conflict|attack|earthquake|flood|deaths|ceasefire|sanction|embargo)"),
    (14, "(全国|全球|国家级|央行|中央银行|政府发布|监管|新规|法律|利率|通胀|关税|global|nationwide|central bank|government announced|regulation|new law|interest rate|inflation|tariff)"),
    (8, "(重大|创纪录|历史新高|首次|突破|紧急|record|all time high|first ever|breakthrough|emergency)"),
    (6, "(生效|执行时间|批准|签署|实施|takes effect|effective date|approved|signed into law)"),
]
EVENT_BOOSTS = {"conflict": 10, "disaster": 10, "policy": 8, "economy": 6, "research": 4}
OPINION = "(排名|盘点|评论|观点|前景预测|如何看|best chance|ranking|opinion|commentary)"
LOCAL = "(选区|村庄|地方候选人|社区活动|constituency|local candidate)"
SPORT_PEAK = "(决赛|冠军|夺冠|淘汰|纪录|final|champion|title|record)"
#: White space as readers of markup see it.
SPACES = "[\\s\\x0B\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
NAMED_REFERENCES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")]
BOILERPLATE = "责任编辑|版权|Copyright|广告|声明|二维码|分享到|举报"
DESCRIPTION_KEYS = "(?i)(^|:|_)(description|og_description|twitter_description)$"
DATE_KEYS = "(?i)(^|:|_)(published_time|publishdate|pubdate|datepublished|datecreated|publish_time|pubtime|date|createdate|article_date)$"
LINKED_DATES = ["datePublished", "dateCreated", "dateModified"]
LINKED_TEXTS = ["description", "articleBody"]
ZONE = r"(?i)\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})(?!\w)|(?<!\w)(?:GMT|UTC)(?!\w)"
CLOCK = r"\d{1,2}:\d{2}|(?<!\w)20\d{12}(?!\w)"
LOCAL_DATE = r"(20\d{2})\s*[年/.-]\s*(\d{1,2})\s*[月/.-]\s*(\d{1,2})(?:\s*日)?(?:[ T]+(\d{1,2}):(\d{2})(?::(\d{2}))?)?"
COMPACT_DATE = r"(?<!\w)(20\d{2})(\d{2})(\d{2})(?:(\d{2})(\d{2})(\d{2})|[ T](\d{1,2}):(\d{2})(?::(\d{2}))?)?(?!\w)"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ISO_DATE = r"(?i)^(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(\.\d{1,3})?\d*)?)?\s*(Z|GMT|UTC|[+-]\d{2}:?\d{2})?$"
DAY_FIRST = r"(?i)^(?:[a-z]+,?\s+)?(\d{1,2})\s+([a-z]{3})[a-z]*\.?,?\s+(\d{4})(?:,?\s+(\d{1,2}):(\d{2})(?::(\d{2}))?)?()\s*(Z|(?:GMT|UTC)?[+-]\d{2}:?\d{2}|GMT|UTC)?(?:\s*\(.*\))?$"
MONTH_FIRST = r"(?i)^(?:[a-z]+,?\s+)?([a-z]{3})[a-z]*\.?\s+(\d{1,2}),?\s+(\d{4})(?:,?\s+(\d{1,2}):(\d{2})(?::(\d{2}))?)?()\s*(Z|(?:GMT|UTC)?[+-]\d{2}:?\d{2}|GMT|UTC)?(?:\s*\(.*\))?$"
PATH_DATES = [
    r"/(20\d{2})/(\d{2})/(\d{2})(?:/|$)", r"/(20\d{2})/(\d{2})-(\d{2})(?:/|$)", r"/(20\d{2})/(\d{2})(\d{2})(?:/|[-_.])",
    r"(?:/|-)(20\d{2})-(\d{2})-(\d{2})(?:/|$)", r"/(20\d{2})(\d{2})(\d{2})(?:/|[-_.])",
]
QUERY_DATE = r"[?&][^=]*=(20\d{2})(\d{2})(\d{2})"
INLINE_DATES = [
    r"""var\s+publishDate\s*=\s*["']\s*(20\d{12})\s*["']""",
    r"(?:发布时间|发表时间|更新时间|发布日期|发布于|时间)[:：\s]*(20\d{2}[-/.年]\d{1,2}[-/.月]\d{1,2}(?:日)?(?:\s+\d{1,2}:\d{2}(?::\d{2})?)?)",
    r"(20\d{2}年\d{1,2}月\d{1,2}日\s+\d{1,2}:\d{2}(?::\d{2})?)",
    r"(?<!\w)(20\d{2}[-/.]\d{1,2}[-/.]\d{1,2}\s+\d{1,2}:\d{2}(?::\d{2})?)(?!\w)",
]
BROKEN_DATE = r"(?<!\w)(20\d{2})\s+(\d{1,2})\s*/\s*(\d{1,2})\s+(\d{1,2}:\d{2}(?::\d{2})?)(?!\w)"
HEADER_YEAR = r"""(?i)class=["'][^"']*year[^"']*["'][^>]*>\s*<em>\s*(20\d{2})\s*</em>"""
HEADER_DAY = r"""(?i)class=["'][^"']*day[^"']*["'][^>]*>\s*<em>\s*(\d{1,2})\s*</em>\s*/\s*<em>\s*(\d{1,2})\s*</em>"""
HEADER_TIME = r"""(?i)class=["'][^"']*time[^"']*["'][^>]*>\s*(\d{1,2}:\d{2}(?::\d{2})?)"""
TRAILING_DATE = r"\s+20\d{2}[-/.年]\d{1,2}[-/.月]\d{1,2}(?:日)?(?:\s+\d{1,2}:\d{2}(?::\d{2})?)?\s*$"
#: Paths that look like articles.
ARTICLE_PATHS = [
    r"/(20\d{2}|n1|n2|article|articles|news|gn|gj|cj|sh|politics|finance|companies|tech|world)(?!\w)",
    r"/20\d{6,8}/", r"/\d{6,}\.(html|shtml)$", r"/[a-f0-9]{20,}/c\.html$",
]
NO_LINKS = "(?i)^(javascript:|mailto:|tel:)"
WEIGHTS = {"public_importance": 0.5, "user_preference": 0.2, "timeliness": 0.15, "source_confidence": 0.1, "content_quality": 0.05}
MEDIA_ROLE_SCORE = {"wire": 28, "official": 24, "public": 20, "business": 14, "technology": 14, "commercial": 10, "social": -30}


@dataclass(frozen=True)
class Preferences:
    """What a reader prefers; all of it enters as literal columns."""

    categories: tuple[str, ...] = ("ai", "technology", "finance")
    boosted: tuple[str, ...] = ("ation", "market")
    blocked: tuple[str, ...] = ("stupid", "scum")
    source_bonus: dict = field(default_factory=lambda: {"src1": 10, "src2": 5})


@dataclass(frozen=True)
class Limits:
    beat: int = 3
    publisher: int = 3
    stale_minutes: int = 30
    candidate_hours: int = 72
    failures_to_open: int = 3


DEFAULTS = Limits()
