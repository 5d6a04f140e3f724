"""Lists and tables that results are defined by, stated as they are."""

# Scores of hosts: official documentation, academic sites, code hosting, questions, reference, low quality.
DOMAIN_SCORES = {
    "docs.python.org": 1.0, "developer.mozilla.org": 1.0, "kubernetes.io": 1.0, "rust-lang.org": 1.0, "doc.rust-lang.org": 1.0, "go.dev": 1.0, "docs.oracle.com": 1.0, "learn.microsoft.com": 1.0, "reactjs.org": 1.0, "vuejs.org": 1.0,
    "arxiv.org": 0.95, "openalex.org": 0.95, "scholar.google.com": 0.95, "dl.acm.org": 0.95, "ieee.org": 0.90,
    "github.com": 0.90, "gitlab.com": 0.85,
    "stackoverflow.com": 0.85, "stackexchange.com": 0.85,
    "en.wikipedia.org": 0.80, "zh.wikipedia.org": 0.80,
    "baijiahao.baidu.com": 0.15, "jb51.net": 0.15, "csdn.net": 0.2, "51cto.com": 0.2, "cnblogs.com": 0.3, "bilibili.com": 0.3, "w3schools.com": 0.3, "runoob.com": 0.3, "juejin.cn": 0.35, "segmentfault.com": 0.35,
    "tutorialspoint.com": 0.35, "zhihu.com": 0.45, "medium.com": 0.5, "geeksforgeeks.org": 0.55,
}

# Scores of other hosts, and of those that start with docs.
DEFAULT_AUTHORITY, DOCS_AUTHORITY = 0.5, 0.85

# Weights of a hit's signals; least bytes of a snippet and their score.
HIT_WEIGHTS = {"domain": 0.4, "keyword": 0.4, "snippet": 0.2}
SNIPPET_STEPS = [(200, 1.0), (100, 0.8), (50, 0.5), (1, 0.3)]

# English words that carry no topic.
STOP_WORDS = "the is at in on to for of and or an it by as be do if no so up how what why who when which this that with from are was were has have had can will does".split()

# Weights of an answer's metrics.
ANSWER_WEIGHTS = {"domain_hit": 0.30, "term_coverage": 0.25, "pollution": 0.15, "diversity": 0.10, "latency": 0.10, "cost": 0.10}

# Query parameters that only track visits, compared in lower case.
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "utm_id", "fbclid", "gclid", "msclkid", "dclid",
    "mc_cid", "mc_eid", "ref", "referrer", "source", "_ga", "_gl", "spm",
]

# Patterns of lines of a page's main text that are noise: breadcrumbs, skip links, subscriptions, copyright, sharing.
NOISE_LINES = [
    r"^(\w[\w\s]*[>›/»]\s*){2,}", r"(?i)^(skip|jump)\s+to\s+(main|content|navigation)", r"(?i)^subscribe\s+(to\s+|now|for\s+)", r"(?i)^sign\s+up\s+for\s+(our\s+)?(newsletter|updates)",
    r"(?i)^get\s+(our\s+)?newsletter", r"(?i)^©\s*\d{4}", r"(?i)^copyright\s+(©\s*)?\d{4}", r"(?i)^all\s+rights\s+reserved", r"(?i)^(share|tweet|pin)\s+(this|on|to)\s", r"(?i)^follow\s+us\s+on\s",
]

# Patterns of noise in a fetched text, by name.
NOISE = {
    "cookie_banner": r"(?i)(accept\s+cookies?|cookie\s+policy|we\s+use\s+cookies)", "subscribe_cta": r"(?i)(subscribe\s+(to|now)|sign\s+up\s+for|newsletter)",
    "nav_breadcrumb": r"(?i)(breadcrumb|skip\s+to\s+(main|content)|jump\s+to)", "copyright": r"(?i)©\s*\d{4}|all\s+rights\s+reserved", "social_share": r"(?i)(share\s+on|tweet\s+this|share\s+this|follow\s+us)",
    "related_articles": r"(?i)(related\s+(articles?|posts?)|you\s+might\s+also|recommended\s+for)", "login_prompt": r"(?i)(log\s*in\s+to|sign\s+in\s+to|create\s+(an\s+)?account)",
}

# Days that a page may stay in the cache, by what its host and path contain; the first rule counts, else three days.
TTL_DAYS = [
    ("arxiv.org", 365), ("openalex.org", 365), ("pubmed", 365), ("jmlr.org", 365), ("aclanthology.org", 365),
    ("docs.", 7), ("developer.", 7), ("go.dev", 7), ("python.org", 7), ("postgresql.org", 7), ("react.dev", 7), ("nextjs.org/docs", 7),
    ("news.", 1), ("blog.", 1), ("/blog/", 1),
    ("stackoverflow.com", 30), ("github.com", 30), ("wikipedia.org", 30),
]

# Elements of a page that are no article, by tag; by what their class holds, their id holds, their role is; and by a label.
DROPPED_TAGS = "nav footer aside script style noscript iframe svg".split()
DROPPED_CLASSES = "nav breadcrumb footer sidebar cookie consent banner advertisement ad- subscribe newsletter related-post recommended copyright".split()
DROPPED_IDS = "nav breadcrumb footer sidebar cookie consent subscribe newsletter".split()
DROPPED_ROLES = "navigation contentinfo complementary".split()
DROPPED_LABEL = "breadcrumb"

# Names under which plans list queries, by source type; others are general_web.
SOURCE_NAMES = {
    "general_web": "general_web web general web_search websearch search", "academic": "academic arxiv papers scholar research", "code": "code github source source_code",
    "community": "community stackoverflow forum q_and_a qa", "docs": "docs documentation doc official_docs reference",
}

# Difficulties, and categories of a query set in the order of reports.
DIFFICULTIES = ["easy", "medium", "hard"]

# Bounds of a query's ground truth: least and most entries.
TRUTH_BOUNDS = {"must_contain_domains": (2, 4), "must_contain_terms": (2, 5), "forbidden_domains": (0, 4)}

# Marks of a page that asks for verification instead of listing results.
VERIFICATION_MARKS = ["wappass.baidu.com", "百度安全验证"]
SKIPPED_TEMPLATES = ["image_grid_san", "recommend_list"]

# Bytes of content that a prompt takes of a source, and the note behind what is cut.
PROMPT_BYTES, CUT_NOTE = 8000, "\n[content truncated]"

# Categories of a query set.
CATEGORIES = ["error_troubleshooting", "api_usage", "version_compatibility", "concept_explanation", "comparison", "fuzzy_recall", "time_sensitive"]
