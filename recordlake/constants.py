"""Word lists, patterns, limits and formats.

Results depend on these exact values, so they are stated plainly here and
nowhere else.  Patterns use Java regex syntax (``\\x{...}`` for code points).
"""

# ---------------------------------------------------------------- fixed values
# Semantic field types.
FIELD_TYPES = ("string", "email", "url", "number", "integer", "boolean", "date", "array")

# Field names (compact form) that hold an entity name.
NAME_FIELDS = (
    "name", "company", "companyname", "title", "startup",
    "brand", "product", "organization", "org",
)

# Url fields (compact form) that may take the page's own url.
CROSS_FILL_FIELDS = ("url", "website", "homepage", "source")

PLACEHOLDER_EMAIL_DOMAINS = (
    "example.com", "example.org", "example.net",
    "test.com", "domain.com", "company.com", "yourcompany.com",
    "yourdomain.com", "sample.com", "placeholder.com", "localhost",
)
PLACEHOLDER_EMAIL_LOCALS = (
    "verified", "test", "example", "sample", "placeholder", "yourname",
    "firstname", "lastname", "username", "user", "email", "name",
    "johndoe", "janedoe", "test1",
)
FREE_MAIL_DOMAINS = (
    "gmail.com", "googlemail.com", "yahoo.com", "hotmail.com", "outlook.com",
    "live.com", "msn.com", "aol.com", "icloud.com", "me.com", "proton.me",
    "protonmail.com", "zoho.com", "gmx.com", "gmx.de", "yandex.com",
    "yandex.ru", "mail.com", "mail.ru", "rediffmail.com", "inbox.com",
)
FREE_MAIL_STEMS = (
    "gmail", "googlemail", "yahoo", "hotmail", "outlook", "live", "msn",
    "aol", "icloud", "me", "proton", "protonmail", "zoho", "gmx", "yandex",
    "rediffmail", "mail", "inbox",
)
PLATFORM_HOSTS = (
    "linkedin.com", "facebook.com", "twitter.com", "x.com", "instagram.com",
    "youtube.com", "github.com", "wikipedia.org", "medium.com", "substack.com",
)
GENERIC_TITLES = (
    "home", "homepage", "home page", "welcome", "index", "untitled",
    "get in touch", "contact", "contact us", "contact page",
    "about", "about us", "about us!", "login", "sign in", "log in",
    "search", "404", "404 not found", "not found", "error",
    "services", "our services", "blog", "careers", "careers home",
)
STOP_WORDS = (
    "the", "and", "for", "with", "that", "this", "from", "are", "was", "were",
    "find", "get", "list", "collect", "scrape", "extract", "whose", "have",
    "has", "into", "our", "all", "any", "some", "who", "which", "their", "them",
    "they", "you", "your", "about", "over", "than", "then", "when", "where",
    "why", "how", "what", "can", "could", "would", "should", "will", "not",
    "but", "its", "also", "via", "per", "one", "two", "new", "top", "best",
)
TRUE_WORDS = ("true", "yes", "y", "1", "active", "verified")
FALSE_WORDS = ("false", "no", "n", "0", "inactive", "unverified")

# Page boilerplate.
SKIP_TAGS = (
    "script", "style", "noscript", "svg", "iframe", "form", "template",
    "nav", "footer", "header", "aside", "button", "select", "textarea",
)
BANNER_HINTS = ("cookie", "consent", "banner", "advert", "sponsor", "newsletter")

# Query parameters dropped from canonical urls (prefix match).
TRACKING_PREFIXES = ("utm_", "fbclid", "gclid", "ref")

# Urls never worth fetching (substring match).
BLOCKED_URL_PATTERNS = (
    "parked",
    "domain-sale",
    "godaddy.com/domainsearch",
    "search.yahoo.com",
    "startpage.com/do/search",
    "google.com/search",
    "translate.google.com",
    "bing.com/search",
    "search.brave.com",
    "duckduckgo.com/html",
    "reddit.com/search",
    "x.com/search",
    "dailymotion.com/search",
    "youtube.com/results",
    "youtube.com/watch",
    "wikipedia.org/w/index.php",
    "linkedin.com/pulse",
    "linkedin.com/posts",
    "linkedin.com/feed",
    "medium.com/tag/",
    "pinterest.com/search",
    "ecosia.org/search",
    "search.naver.com",
    "news.crunchbase.com",
    "britannica.com",
)
BLOCK_STATUS = (401, 403, 429, 503, 999)

# Patterns.
EMAIL_CHARS = "A-Za-z0-9._%+-"
URL_IN_TEXT = r"https?://[^\s)\]>]+"
BARE_DOMAIN = r"(?i)^(?:www\.)?[a-z0-9-]+(?:\.[a-z0-9-]+)+(?:/[^\s]*)?$"
MARKDOWN_LINK = r"\[([^\]]*)\]\((https?://[^)]+)\)"
REDIRECT_URL = r"(?i)^https?://(?:www\.)?google\.[a-z.]+/url\?(?:[^#]*&)?q=([^&#]+)"
NUMBER_IN_TEXT = r"-?[0-9][0-9,]*(?:\.[0-9]+)?"
YEAR_IN_TEXT = r"(20[0-9]{2}|19[0-9]{2})"
BINARY_URL = r"\.(pdf|zip|exe|png|jpe?g|gif|svg|mp4)(\?|$)"
DIRECTORY_HINT = (
    r"(?i)(director|database|list[-_ ]of|/list[-_]|top[- ]?\d|contact[-_ ]?list"
    r"|email[-_ ]?list|companies|startups|start-ups)"
)
NEWS_HINT = r"(?i)/news(?:letter)?s?/|/articleshow|/story/|/breaking-news/"
SITE_SEARCH_PATH = r"(?i)^/search[/?]"
INTENT_COUNT = (
    r"(?i)\b(?:find|get|collect|extract|scrape|build|list|gather)\s+(\d{1,4})\b"
    r"|(\d{1,4})\s*(?:records|rows|results|companies|startups|leads|entries|contacts)\b"
)
STATUS_IN_TEXT = r"\b(40[0-9]|429|50[0-3]|999)\b"
ERROR_TITLE = (
    r"(?i)request denied|access denied|attention required|just a moment|"
    r"checking your browser|are you a robot|verify you are human|captcha|"
    r"403 forbidden|404 not found|error \d{3}|service unavailable|"
    r"temporarily (?:unavailable|blocked|limited)|enable javascript|"
    r"ddos protection|blocked\b"
)
SLOGAN_OPENER = (
    r"(?i)^(?:best|leading|top|trusted|award[- ]winning|your|get|find|we are|"
    r"about|list of|search|discover|why|how|what)\b"
)
SLOGAN_TAIL = r"(?i)\b(?:leading|trusted|award[- ]winning|premium|fastest|growing)\.?$"
PICTOGRAM = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}]"
NON_LATIN = r"[\x{0400}-\x{04FF}\x{0600}-\x{06FF}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]"
PROSE_MARKERS = (
    " for all ", " your digital ", " needs ", " we help ",
    " the emerging ", " of india", ",india", " in nagpur",
)
TRAILING_SEPARATOR = r"\s*[|\-–—·•]\s*$"

# Limits.
MAX_RECORDS_HARD = 2000
WEBHOOK_BATCH = 25
VALIDITY_BAR = 0.9
DESTINATIONS = ("csv", "json", "markdown", "sqlite", "google_sheets", "webhook")
TERMINAL_STATES = ("completed", "failed")
# ------------------------------------------------------------ end fixed values
