"""Word lists and constants of the studied workload.

Fixed values: these lists and numbers must equal the workload's for its results to be reproduced.
"""

from __future__ import annotations

# Topic tags by keyword (substring match).
SECONDARY_TOPICS = {
    "earnings": ("earnings", "revenue", "profit", "quarter", "eps"),
    "product": ("iphone", "ipad", "mac", "device", "launch"),
    "innovation": ("ai", "technology", "patent", "research"),
    "market": ("stock", "shares", "trading", "investor"),
    "regulation": ("regulatory", "lawsuit", "antitrust", "legal"),
    "macro": ("economy", "recession", "inflation", "fed", "rates"),
    "competition": ("samsung", "google", "microsoft", "competitor"),
    "supply_chain": ("supply", "chain", "production", "shortage"),
}

# Cluster naming by keyword hits in the top words, in order of precedence.
CLUSTER_TOPICS = {
    "recession": ("recession", "downturn", "decline", "slowdown", "contraction", "bear"),
    "growth": ("growth", "expansion", "surge", "boom", "rally", "bull"),
    "earnings": ("earnings", "revenue", "profit", "quarter", "beat", "miss"),
    "product": ("iphone", "ipad", "mac", "product", "launch", "release"),
    "regulation": ("regulatory", "antitrust", "lawsuit", "legal", "court", "fine"),
    "innovation": ("innovation", "ai", "technology", "patent", "research", "development"),
    "supply_chain": ("supply", "chain", "shortage", "production", "manufacturing", "chip"),
    "competitor": ("samsung", "google", "microsoft", "amazon", "meta", "competition"),
}

# First-match ladder of categories.
CATEGORY_LADDER = (
    ("Finance/Earnings", ("earnings", "revenue", "profit", "financial", "quarter")),
    ("Product/Hardware", ("iphone", "ipad", "mac", "product", "device")),
    ("Market/Trading", ("stock", "market", "trade", "share", "price")),
    ("Technology/Software", ("tech", "software", "ai", "app", "service")),
    ("Legal/Regulatory", ("legal", "lawsuit", "court", "regulatory")),
)
CATEGORY_DEFAULT = "General News"

# Guided topics with their weights.
GUIDED_TOPICS = {
    "macro_recession": (1.5, ("recession", "economy", "gdp", "unemployment", "inflation", "deflation", "stagflation", "economic", "downturn", "recovery", "growth", "slowdown", "contraction", "expansion", "crisis")),
    "monetary_policy": (1.5, ("fed", "federal reserve", "interest rate", "monetary", "policy", "powell", "fomc", "quantitative", "tightening", "easing", "hawkish", "dovish", "yield", "bond", "treasury", "inflation target")),
    "earnings_financial": (1.3, ("earnings", "revenue", "profit", "loss", "eps", "ebitda", "margin", "guidance", "forecast", "beat", "miss", "quarter", "quarterly", "annual", "fiscal", "financial results")),
    "product_innovation": (1.2, ("product", "launch", "innovation", "technology", "ai", "artificial intelligence", "iphone", "ipad", "mac", "macbook", "ios", "software", "hardware", "feature", "upgrade", "model")),
    "merger_acquisition": (1.3, ("merger", "acquisition", "acquire", "buyout", "takeover", "deal", "transaction", "purchase", "buy", "sell", "divest", "spinoff", "joint venture", "partnership", "strategic")),
    "legal_regulatory": (1.2, ("lawsuit", "legal", "court", "judge", "regulatory", "sec", "ftc", "doj", "antitrust", "monopoly", "fine", "penalty", "investigation", "probe", "compliance", "settlement")),
    "competition": (1.0, ("competition", "competitor", "rival", "samsung", "google", "microsoft", "amazon", "meta", "market share", "competitive", "advantage", "threat", "challenge", "versus", "compare")),
    "supply_operations": (1.1, ("supply chain", "manufacturing", "production", "factory", "supplier", "component", "chip", "shortage", "logistics", "inventory", "capacity", "output", "delay", "disruption")),
    "management": (1.0, ("ceo", "cfo", "executive", "management", "board", "director", "leadership", "resignation", "appointment", "hire", "fire", "succession", "corporate governance", "compensation")),
    "market_sentiment": (1.1, ("analyst", "upgrade", "downgrade", "rating", "target", "bullish", "bearish", "sentiment", "outlook", "forecast", "consensus", "estimate", "valuation", "overvalued", "undervalued")),
}

# Sentiment lexicons.
POSITIVE = ("gain", "rise", "growth", "profit", "success", "win", "beat", "surge")
NEGATIVE = ("loss", "fall", "decline", "fail", "miss", "drop", "crash", "risk")
FINANCIAL_POSITIVE = ("beat", "exceed", "surpass", "profit", "growth", "gain", "rise", "surge", "rally", "upgrade", "bullish", "record")
FINANCIAL_NEGATIVE = ("miss", "loss", "decline", "fall", "drop", "concern", "risk", "warning", "bearish", "downgrade", "recession")
NEGATIONS = ("not", "don't", "doesn't")

# Words too common in finance to tell topics apart, and names hidden from clustering.
GENERIC_FINANCE = (
    "stock", "stocks", "share", "shares", "equity", "equities", "investor", "investors", "trader", "traders", "fund", "funds", "portfolio",
    "market", "markets", "exchange", "index", "indices", "wall street", "dow", "nasdaq", "s&p", "s p 500", "sp500",
    "buy", "sell", "hold", "rating", "upgrade", "downgrade", "bullish", "bearish", "overweight", "underweight", "neutral",
    "price", "prices", "target", "price target", "earnings", "results", "revenue", "sales", "profit", "profits", "loss", "losses",
    "guidance", "forecast", "quarter", "quarters", "q1", "q2", "q3", "q4", "full year", "fy24", "fy25",
)
# More of them that may not describe a topic.
GENERIC_DESCRIPTORS = ("ratings", "return", "returns", "performance", "today", "yesterday", "tomorrow", "week", "weeks", "month", "months", "year", "years")
COMPANY_TOKENS = ("aapl", "msft", "amzn", "googl", "goog", "tsla", "meta", "nvda", "apple", "microsoft", "amazon", "alphabet", "google", "tesla", "meta platforms", "meta platform", "nvidia")
COMPANY_DESCRIPTORS = ("tesla", "nvidia", "apple", "amazon", "microsoft", "meta", "alphabet", "google", "goog", "googl", "palantir", "broadcom")
PERSONS = ("trump", "musk")

# Boilerplate removed before encoding.
GATE_PHRASES = ("continue reading", "view comments", "sign up", "subscription required", "upgrade your subscription", "all rights reserved", "this article was originally published", "click here")
PLATFORMS = ("Yahoo Finance", "Benzinga", "Bloomberg", "The Motley Fool", "Motley Fool", "Seeking Alpha", "MarketWatch", "WSJ")

# Terms that describe no topic.
SHORT_TERMS = ("ai", "fx", "eu", "us", "uk", "fed")
BOILERPLATE_TERMS = (
    "reading", "continue", "continue reading", "view", "comments", "view comments", "subscription", "upgrade", "premium", "article", "articles", "sign", "plan",
    "required", "access", "report", "reports", "today", "live", "quote", "quotes", "details", "start", "news", "video",
)
PLATFORM_TERMS = (
    "yahoo", "yahoo finance", "benzinga", "bloomberg", "seekingalpha", "motley", "motley fool", "gurufocus", "researchandmarkets", "insider monkey", "monkey",
    "shutterstock", "wsj", "wsj com", "mt newswires",
)
PLATFORM_TERMS_MORE = ("investorplace", "zacks", "zacks investment research")

# Mega-cap symbols, the default encoder by year, temporal splits (train from, train to, test from, test to).
MEGA_CAPS = ("AAPL", "MSFT", "AMZN", "GOOGL", "META", "NVDA", "TSLA")
ENCODERS = {2021: "all-MiniLM-L6-v2", 2022: "all-MiniLM-L12-v2", 2023: "all-distilroberta-v1", 2024: "all-mpnet-base-v2", 2025: "all-MiniLM-L6-v2"}
TEMPORAL_SPLITS = {
    "train_2023": ("2023-01-01", "2023-06-30", "2023-07-01", "2023-12-31"),
    "train_2024": ("2023-01-01", "2023-12-31", "2024-01-01", "2024-12-31"),
    "train_2025": ("2023-01-01", "2024-12-31", "2025-01-01", "2025-12-31"),
}
KEPT_STOP_WORDS = ("fed", "rate", "earnings", "revenue", "profit", "loss")
FINANCE_STOP_WORDS = ("stock", "share", "market", "trading", "price", "today", "yesterday", "tomorrow", "week", "month", "year")

# The usual English stop list, with the stems that cleaning leaves of contractions.
#: Another can be read from a file (``sources.readers.word_list``).
STOP_WORDS = tuple(
    """a about above after again against ain all am an and any are aren as at be because been before being below between both but by can could couldn d did didn do does doesn
    doing don down during each few for from further had hadn has hasn have haven having he her here hers herself him himself his how i if in into is isn it its itself just ll m ma
    me mightn more most mustn my myself needn no nor not now o of off on once only or other our ours ourselves out over own re s same shan she should shouldn so some such t than that the
    their theirs them themselves then there these they this those through to too under until up ve very was wasn we were weren what when where which while who whom
    why will with won would wouldn y you your yours yourself yourselves""".split()
)

# The workload's own stop words, of its trade.
NEWS_STOP_WORDS = (
    "stock", "stocks", "market", "markets", "company", "companies", "share", "shares", "price", "prices", "trading", "trade", "trades", "traded",
    "investor", "investors", "investment", "investments", "business", "businesses", "financial", "finance", "report", "reports", "reported", "reporting",
    "said", "says", "saying", "percent", "percentage", "quarter", "quarterly", "year", "years", "annual", "annually", "month", "months", "monthly",
    "week", "weeks", "weekly", "day", "days", "daily", "today", "yesterday", "tomorrow", "dollar", "dollars", "billion", "million", "thousand", "hundred",
    "cannot", "ought",
)

#: The union of both lists, which tokens are tested against by default.
ALL_STOP_WORDS = tuple(dict.fromkeys(STOP_WORDS + NEWS_STOP_WORDS))
