"""Word lists, weights, patterns and limits that results depend on."""

from __future__ import annotations

# Query parameters without meaning for a page's identity.
TRACKING_PREFIX = "utm_"
TRACKING = ["gclid", "fbclid", "yclid", "mc_cid", "mc_eid", "ref", "ref_src"]

# Source types by host, the first match counts.
SOURCE_TYPES = {
    "docs": ["docs.rs", "readthedocs", "rust-lang.org", "doc.rust-lang", "developer.mozilla.org", "learn.microsoft.com", "man7.org", "devdocs.io"],
    "repo": ["github.com", "gitlab.com", "bitbucket.org", "codeberg.org"],
    "blog": ["news", "blog", "medium.com", "dev.to", "hackernews", "reddit.com", "thenewstack.io"],
    "video": ["youtube.com", "vimeo.com"],
    "qa": ["stackoverflow.com", "stackexchange.com"],
    "package": ["crates.io", "npmjs.com", "pypi.org"],
    "gaming": ["steam", "facepunch", "game"],
}
DOCS_SUFFIX = ".github.io"
TYPE_WEIGHTS = {"repo": 1.40, "docs": 1.35, "qa": 1.25, "package": 1.20, "blog": 1.00, "video": 0.85, "gaming": 0.25}

# Kinds of query by words in it.
CODE_WORDS = ["rust", "python", "javascript", "typescript", "golang", "error", "exception", "stack trace", "crate", "npm", "api", "sdk", "how to", "tutorial"]
NEWS_WORDS = ["news", "latest", "today", "breaking", "report", "2026", "2025"]

# Breadcrumbs that raise a result.
HIGH_VALUE_CRUMBS = ["docs", "documentation", "manual", "reference", "api", "github", "wiki"]

# Preference of sites in research, the first match counts.
DOMAIN_PRIORITY = {
    "github.com": 25,
    "arxiv.org": 22,
    "huggingface.co": 20,
    "docs.": 18,
    "developer.": 15,
    "developers.": 15,
    "learn.microsoft.com": 14,
    "developers.google.com": 14,
    "pytorch.org": 12,
    "tensorflow.org": 12,
}
LOW_PRIORITY = ["reddit.com", "quora.com"]

# Marks of marketing pages.
SPAM_MARKERS = ["download brochure", "enroll now", "whatsapp us", "course overview", "career support", "get certified", "join our bootcamp", "limited seats", "free demo", "register now"]

# Sections of a research report and their words.
REPORT_SECTIONS = {
    "Core concepts / state-of-the-art": ["architecture", "benchmark", "sota", "paper", "model", "algorithm", "approach", "method", "framework", "library"],
    "Implementation / production": ["implementation", "sdk", "api", "code", "install", "config", "deploy", "integrate", "plugin", "package"],
    "Performance / tradeoffs": ["latency", "throughput", "memory", "cpu", "gpu", "accuracy", "speed", "benchmark", "ms", "fps", "ram"],
    "Limitations / edge cases": ["limitation", "drawback", "issue", "edge case", "failure", "problem", "caveat", "workaround", "tradeoff"],
}
# What is appended to a query for each research angle.
RESEARCH_ANGLES = [
    "state of the art benchmarks architecture comparison",
    "implementation best practices production libraries frameworks",
    "limitations edge cases performance tradeoffs benchmarks",
]

# Words of developer queries.
DEV_WORDS = [
    "rust", "python", "javascript", "typescript", "go", "java", "c++", "cpp", "ruby", "php", "swift", "kotlin", "scala", "haskell", "elixir",
    "clojure", "react", "vue", "angular", "svelte", "next", "nuxt", "django", "flask", "fastapi", "express", "koa", "tokio", "actix", "axum",
    "rocket", "warp", "spring", "laravel", "rails", "phoenix", "async", "await", "promise", "future", "mutex", "arc", "thread", "concurrency", "api",
    "rest", "graphql", "grpc", "websocket", "http", "tcp", "udp", "database", "sql", "nosql", "postgres", "mongodb", "redis", "sqlite", "kubernetes",
    "ci", "cd", "git", "github", "gitlab", "npm", "cargo", "pip", "maven", "gradle", "tutorial", "docs", "documentation", "guide", "example", "code",
    "install", "setup", "configure", "error", "bug", "fix", "deploy", "test", "testing", "debug", "benchmark", "performance", "optimize",
]
DEV_PATTERNS = ["how to", "tutorial", "docs", "api", "install", "error", "example"]
# Sites that belong to a word.
SITES = {
    "docs": ["docs.rs", "doc.rust-lang.org", "developer.mozilla.org", "devdocs.io"],
    "documentation": ["docs.rs", "doc.rust-lang.org", "developer.mozilla.org"],
    "rust": ["doc.rust-lang.org", "docs.rs", "rust-lang.org"],
    "python": ["docs.python.org", "pypi.org"],
    "javascript": ["developer.mozilla.org", "javascript.info"],
    "typescript": ["typescriptlang.org"],
    "go": ["go.dev", "pkg.go.dev"],
    "tokio": ["tokio.rs", "docs.rs"],
    "react": ["react.dev", "reactjs.org"],
    "vue": ["vuejs.org"],
    "django": ["docs.djangoproject.com"],
    "error": ["stackoverflow.com", "github.com"],
    "bug": ["stackoverflow.com", "github.com"],
    "issue": ["stackoverflow.com", "github.com"],
    "crate": ["crates.io", "docs.rs"],
    "package": ["npmjs.com", "pypi.org", "crates.io"],
}
HOW_TO_LANGUAGES = ["rust", "python", "javascript", "go", "typescript"]

# Reasons for which a result page is no result page.
SERP_STATUS = {429: "http_429", 403: "http_403", 503: "http_503"}
SERP_BLOCKS = {
    "duckduckgo.com/anomaly.js": "captcha",
    "/anomaly.js": "captcha",
    "anomaly-modal": "captcha",
    "cf-chl-": "cloudflare",
    "cf-turnstile": "cloudflare",
    "turnstile": "cloudflare",
    "perimeterx": "captcha",
    "px-captcha": "captcha",
    "unusual traffic": "unusual_traffic",
    "our systems have detected unusual traffic": "unusual_traffic",
    "sorry, but your computer or network may be sending automated queries": "captcha",
    "captcha": "captcha",
    "recaptcha": "captcha",
    "hcaptcha": "captcha",
    "verify you are human": "captcha",
    "enable javascript": "js_required",
    "access denied": "access_denied",
}
# Reasons for which a page is a block page, in order.
PAGE_BLOCKS = {
    "Human Verification": ["verify you are human", "please verify you"],
    "DuckDuckGo Anomaly": ["duckduckgo.com/anomaly.js", "/anomaly.js", "anomaly-modal"],
    "Access Denied": ["access denied", "access to this page has been denied"],
    "Captcha": ["captcha", "are you human", "prove you're human"],
    "Bot Detected": ["bot detected", "unusual traffic", "automated request"],
    "Cloudflare": ["cf-chl-", "cf-turnstile", "turnstile"],
    "PerimeterX": ["perimeterx", "px-captcha"],
    "JS Crash": ["page crashed", "crashed!"],
}
SMALL_BLOCKS = {"Zillow Accessibility Block": ["zillow group is committed to ensuring digital accessibility"]}

# Phrases and places of pages that ask for a login.
AUTH_PHRASES = [
    "sign in to continue",
    "log in to continue",
    "please sign in",
    "please log in",
    "sign in with google",
    "sign in with github",
    "sign in with microsoft",
    "login to continue",
    "you must be logged in to",
]
AUTH_PAIRS = [("sign in", "sign up"), ("log in", "sign up"), ("create an account", "sign in")]
AUTH_URLS = ["/login", "/signin", "/sign-in", "/auth/", "/session"]
AUTH_ACTIONS = ["/login", "/signin", "/sign_in", "/session", "/auth/login", "/account/login", "/users/sign_in"]
AUTH_ELEMENTS = {
    "github-username-field": ("id", "login_field"),
    "password-input": ("type", "password"),
    "auth-form-class": ("class", "auth-form"),
    "login-form-class": ("class", "login-form"),
    "loginForm-id": ("id", "loginForm"),
    "sign_in_form-id": ("id", "sign_in_form"),
    "password-name-attr": ("name", "password"),
}
AUTH_TITLE = r"^(sign in|log in|login)|([-·] (sign in|log in))$"

# Signs of kinds of content, in order.
CODE_HOSTS = ["github.com", "gitlab.com", "bitbucket.org", "raw.githubusercontent.com", "gist.github.com", "sourcehub.io", "codeberg.org"]
CODE_PATHS = ["/blob/", "/tree/", "/commit/", "/pulls", "/issues", "/releases"]
QA_HOSTS = ["stackoverflow.com", "superuser.com", "serverfault.com", "askubuntu.com"]
PASTE_HOSTS = ["pastebin.com", "paste.ee", "hastebin.com", "dpaste.com", "nowsecure.io"]
SPA_SIGNS = ["__NEXT_DATA__", "__NUXT_DATA__", "__REMIX_CONTEXT__", "__APP_DATA__", "window.__PRELOADED_STATE__", "window.__INITIAL_STATE__"]
SPA_MARKERS = ["__NEXT_DATA__", "__NUXT_DATA__", "data-nuxt-data", "__REMIX_CONTEXT__", "__APP_DATA__", "react-app.embeddedData"]
SHOP_HOSTS = ["amazon.", "ebay.", "shopify.", "etsy.", "aliexpress.", "walmart.", "bestbuy.", "target.", "lazada.", "tokopedia.", "shopee."]
SHOP_SIGNS = ['"@type":"Product"', '"@type": "Product"', "application/ld+json", "og:price", "product:price", 'itemprop="price"', 'class="price"', 'class="product']
ARTICLE_SIGNS = [
    "<article",
    '"@type":"Article"',
    '"@type":"NewsArticle"',
    '"@type": "Article"',
    '"@type": "NewsArticle"',
    'itemprop="articleBody"',
    'class="article',
    'class="post-content',
    'class="entry-content',
]

# Lines that are no content.
GARBAGE_LINES = [
    r"^subscribe$",
    r"^sign up$",
    r"^cookie",
    r"^accept all$",
    r"^advert",
    r"^sponsor",
    r"^newsletter$",
    r"^related articles",
    r"^comments?$",
    r"^read more$",
    r"^continue reading$",
    r"^select categories$",
    r"^close$",
    r"^open$",
    r"^menu$",
    r"^skip to content$",
    r"^filters?$",
    r"^sort$",
]
NOISE_IDENTIFIERS = [
    "ads", "advert", "adsense", "adunit", "ad-slot", "ad_container", "adbox", "sponsor", "promo", "cookie", "consent", "banner", "modal",
    "subscribe", "newsletter", "share", "social", "sidebar", "comments", "related", "breadcrumb", "pagination", "nav", "footer", "header", "hero",
    "toolbar",
]
NOISE_EDGES = ["-ad", "ad-", "_ad", "ad_"]

# Blocks of HTML that are no content, in order.
BLOCK_PATTERNS = [
    r"(?is)<(?:script|style|noscript|svg|canvas|iframe)[^>]*?>.*?</(?:script|style|noscript|svg|canvas|iframe)>",
    r"(?is)<(?:nav|header|footer|aside)[^>]*?>.*?</(?:nav|header|footer|aside)>",
    r"(?is)<(?:form|button)[^>]*?>.*?</(?:form|button)>",
    r"""(?is)<[^>]*?(?:display:\s*none|visibility:\s*hidden|aria-hidden="true")[^>]*?>.*?</[^>]+>""",
    r"""(?is)<(?:div|section|article)[^>]*?(?:id|class)=(?:'|")[^'">]*(?:ads|advert|sponsor|promo|related|cookie|banner|modal|subscribe|newsletter|share|social|sidebar|comments|breadcrumb|pagination)[^'">]*(?:'|")[^>]*?>.*?</(?:div|section|article)>""",
]
ATTRIBUTES = r"""(?i)\s(?:class|id|style|aria-[\w:-]+|on[\w:-]+)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)"""
ATTRIBUTES_AGGRESSIVE = r"""(?i)\s(?:class|id|style|role|tabindex|aria-[\w:-]+|data-[\w:-]+|on[\w:-]+)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)"""

# Patterns of fields in text.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"[\+]?[(]?[0-9]{1,3}[)]?[-\s\.]?[0-9]{1,4}[-\s\.]?[0-9]{1,4}[-\s\.]?[0-9]{1,9}"
PRICE = r"[\$€£¥₹][\s]?[0-9]{1,3}(?:[,.]?[0-9]{3})*(?:[.,][0-9]{2})?|[0-9]{1,3}(?:[,.]?[0-9]{3})*(?:[.,][0-9]{2})?\s?(?:USD|EUR|GBP|JPY|INR)"
DATES = [
    r"\d{4}-\d{2}-\d{2}",
    r"\d{2}/\d{2}/\d{4}",
    r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}",
    r"\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4}",
]
NUMBER = r"\d+(?:[.,]\d+)?"

# Languages of code by file extension.
CODE_EXTENSIONS = {"rs": "rust", "py": "python", "pyw": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "go": "go", "java": "java", "kt": "kotlin", "cs": "csharp", "rb": "ruby"}
RAW_EXTENSIONS = ["md", "mdx", "rst", "txt", "csv", "toml", "yaml", "yml"]

# Seconds that a search engine rests after a failure.
COOLDOWN_BLOCKED = {"brave": 45, "google": 30, "bing": 35}
COOLDOWN_BLOCKED_OTHER, COOLDOWN_TIMEOUT, COOLDOWN_FAILED = 25, 12, 8
COOLDOWN_CAPS = {"blocked": 600, "recovered": 180, "timeout": 120, "failed": 60}

# Words that ask for community pages.
COMMUNITY_WORDS = ["reddit", "hacker news", "news.ycombinator", "community", "discussion", "forum", "forums", "issue", "issues"]

# Addresses of advertising and tracking.
AD_URLS = [
    "doubleclick.net",
    "googlesyndication.com",
    "googletagmanager.com",
    "googletagservices.com",
    "adservice.google.",
    "amazon-adsystem.com",
    "ads.twitter.com",
    "ads.linkedin.com",
    "advertising.com",
    "criteo.com",
    "taboola.com",
    "outbrain.com",
    "moatads.com",
    "adnxs.com",
    "google-analytics.com",
    "analytics.google.com",
    "segment.com/v1/t",
    "segment.io/v1",
    "mixpanel.com/track",
    "hotjar.com",
    "mouseflow.com",
    "fullstory.com",
    "newrelic.com/",
    "nr-data.net",
    "connect.facebook.net",
    "platform.twitter.com/widgets",
    "cookielaw.org",
    "cookiebot.com",
    "onetrust.com",
]
MEDIA_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".ico", ".mp4", ".webm", ".ogg", ".mp3", ".woff", ".woff2", ".ttf"]

# Terms of paragraphs that are no content.
BOILERPLATE = ["terms of service", "privacy policy", "cookie policy", "all rights reserved", "copyright ©", "© ", "follow us on", "subscribe to our", "unsubscribe", "powered by"]

# Month names in dates of snippets.
MONTHS = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"

# Hosts and paths of tutorials.
TUTORIAL_HOSTS = ["doc.rust-lang.org", "docs.rs", "developer.mozilla.org", "docs.python.org", "learn.microsoft.com", "docs.microsoft.com", "reactjs.org", "vuejs.org"]
TUTORIAL_PREFIXES = ["docs.", "doc."]
TUTORIAL_PATHS = ["/tutorial", "/guide", "/docs/", "/book/", "/learn/"]

# Vendors of challenges.
CHALLENGES = ["challenges.cloudflare.com", "hcaptcha.com", "recaptcha", "perimeterx", "datadome.co"]

# Sites that show their content only in a browser.
BROWSER_HOSTS = ["ticketmaster.", "linkedin.", "instagram.", "airbnb.", "upwork.", "indeed.", "tiktok."]
BROWSER_DOMAIN = "x.com"

# Milliseconds that an engine is given.
ENGINE_TIMEOUTS = {"duckduckgo": 4500, "ddg": 4500, "brave": 3500}
ENGINE_TIMEOUT, ENGINE_TIMEOUT_LEAST = 2500, 250

# Words of lines that are controls.
CONTROL_WORDS = ["share", "upvote", "downvote", "comment", "reply", "login", "sign up", "subscribe", "follow", "like", "tweet", "retweet", "menu", "navigation"]
