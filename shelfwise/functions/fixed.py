"""Word lists that results depend on, as plain literals. Needs neither Spark nor any file."""

from __future__ import annotations

# Words that make a text sound good or bad. They are looked for anywhere in the text.
POSITIVE_WORDS = ("good", "great", "excellent", "best", "top", "high", "increase", "growth")
NEGATIVE_WORDS = ("bad", "poor", "low", "decrease", "drop", "loss", "problem", "issue", "anomaly")

# Confidence of (positive, neutral, negative) for each verdict.
CONFIDENCE = {
    "positive": (0.8, 0.15, 0.05),
    "negative": (0.05, 0.15, 0.8),
    "neutral": (0.1, 0.8, 0.1),
}

# Words that are no key phrases.
PHRASE_STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been",
    "have", "has", "do", "does", "will", "would", "can", "could",
    "me", "my", "i", "you", "we", "they", "it", "this", "that",
    "what", "how", "why", "when", "where", "which", "who",
    "show", "give", "tell", "get", "find", "list",
)

# Spark's English stop words (``StopWordsRemover.loadDefaultStopWords("english")``).
ENGLISH_STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves",
    "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their",
    "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up",
    "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor",
    "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should",
    "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd", "he'd", "she'd", "we'd", "they'd",
    "i'm", "you're", "he's", "she's", "it's", "we're", "they're", "i've", "we've", "you've", "they've", "isn't",
    "aren't", "wasn't", "weren't", "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't", "won't", "wouldn't",
    "shan't", "shouldn't", "mustn't", "can't", "couldn't", "cannot", "could", "here's", "how's", "let's", "ought",
    "that's", "there's", "what's", "when's", "where's", "who's", "why's", "would",
)

ANALYTICS, POLICY, FORECAST = "AnalyticsAgent", "PolicyAgent", "ForecastAgent"

# The keywords of each agent. A keyword counts wherever it occurs, inside words too.
AGENT_KEYWORDS = {
    FORECAST: (
        "forecast", "predict", "prediction", "demand", "future", "units",
        "how many will", "expected sales", "next week", "next month",
        "anomaly", "spike", "outlier", "unusual", "detection",
    ),
    POLICY: (
        "policy", "rule", "return", "refund", "promo", "promotion",
        "stock", "guideline", "procedure", "allowed", "permitted",
        "regulation", "compliance", "warranty", "exchange",
    ),
    ANALYTICS: (
        "revenue", "sales", "top", "category", "region", "monthly",
        "overview", "summary", "breakdown", "trend", "performance",
        "best", "highest", "earner", "product", "store", "total",
    ),
}

# The actions in their order of preference, with their keywords.
ACTION_KEYWORDS = {
    "pull_sales_overview": ("overview", "summary", "total", "sales", "revenue", "how many", "overall"),
    "pull_top_earners": ("top", "best", "highest", "earner", "product", "leading", "most revenue"),
    "pull_category_revenue": ("category", "categories", "segment", "type", "department"),
    "pull_region_revenue": ("region", "area", "location", "geography", "zone", "territory"),
    "pull_monthly_revenue": ("monthly", "month", "trend", "over time", "timeline", "period"),
    "pull_product_breakdown": ("product", "item", "sku", "breakdown", "detail", "specific"),
    "search_policy_docs": ("policy", "rule", "return", "promo", "promotion", "stock", "guideline", "procedure"),
    "describe_ml_model": ("model", "machine learning", "ml", "random forest", "algorithm", "training"),
    "describe_anomaly_system": ("anomaly", "spike", "outlier", "detection", "isolation forest", "unusual"),
    "describe_forecast_system": ("forecast", "prediction", "pipeline", "predict", "demand", "future"),
}

# Tools of the agents, tried in this order, each with the words that select it.
AGENT_TOOLS = {
    ANALYTICS: {
        "get_top_products": ("top", "best", "highest"),
        "get_category_breakdown": ("category", "categories"),
        "get_region_breakdown": ("region", "area"),
        "get_monthly_trend": ("monthly", "month", "trend"),
        "get_product_detail": ("product", "item"),
    },
    FORECAST: {
        "get_anomaly_summary": ("anomaly", "spike", "outlier", "unusual", "detection"),
        "get_model_info": ("model", "algorithm", "feature", "training", "accuracy"),
    },
    POLICY: {},
}
SESSION_TOOLS = {
    ANALYTICS: {
        "get_top_products": ("top", "best", "highest", "leading"),
        "get_category_breakdown": ("category", "categories", "segment"),
        "get_region_breakdown": ("region", "area", "location", "zone"),
        "get_monthly_trend": ("monthly", "month", "trend", "timeline"),
        "get_product_detail": ("product", "item", "sku", "detail"),
    },
    FORECAST: {
        "get_anomaly_summary": ("anomaly", "spike", "outlier", "unusual"),
        "get_model_info": ("model", "algorithm", "feature", "training"),
    },
    POLICY: {},
}
FALLBACK_TOOL = {ANALYTICS: "get_sales_overview", FORECAST: "get_demand_forecast", POLICY: "search_policy"}
ANSWERING_FALLBACK = {**FALLBACK_TOOL, POLICY: "vector_store_rag"}

# The request a forecast tool runs with when a message names none.
DEFAULT_FORECAST = {
    "product_id": "PROD_001", "target_date": "2025-07-01", "price": "100.0", "discount": "0.0",
    "store_id": "STORE_A", "region": "North",
}
