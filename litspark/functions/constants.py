"""Fixed values.

Everything in this module is a value that has to equal the behaviour being
reproduced (word lists, keyword lists, class names, thresholds). They are kept
plain, in their natural order, in one place; no logic lives here.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — stop-word list, version 1 (177 entries, natural order).
# ---------------------------------------------------------------------------
STOPWORDS_V1: list[str] = [
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "aren't", "as",
    "at", "be", "because", "been", "before", "being", "below", "between", "both", "but", "by", "can", "can't",
    "come", "could", "couldn't", "did", "didn't", "do", "does", "doesn't", "doing", "don't", "down", "during",
    "each", "few", "for", "from", "further", "had", "hadn't", "has", "hasn't", "have", "haven't", "having",
    "he", "he'd", "he'll", "he's", "her", "here", "here's", "hers", "herself", "him", "himself", "his", "how",
    "how's", "i", "i'd", "i'll", "i'm", "i've", "if", "in", "into", "is", "isn't", "it", "it's", "its", "itself",
    "let's", "me", "more", "most", "mustn't", "my", "myself", "no", "nor", "not", "of", "off", "on", "once",
    "only", "or", "other", "ought", "our", "ours", "ourselves", "out", "over", "own", "same", "shan't", "she",
    "she'd", "she'll", "she's", "should", "shouldn't", "so", "some", "such", "than", "that", "that's", "the",
    "their", "theirs", "them", "themselves", "then", "there", "there's", "these", "they", "they'd", "they'll",
    "they're", "they've", "this", "those", "through", "to", "too", "under", "until", "up", "very", "was", "wasn't",
    "we", "we'd", "we'll", "we're", "we've", "were", "weren't", "what", "what's", "when", "when's", "where",
    "where's", "which", "while", "who", "who's", "whom", "why", "why's", "with", "won't", "would", "wouldn't",
    "you", "you'd", "you'll", "you're", "you've", "your", "yours", "yourself", "yourselves", "copyright", "©",
]

# FIXED VALUES — stop-word list, version 2 = version 1 plus these four (181 entries).
STOPWORDS_V2: list[str] = STOPWORDS_V1 + ["±", "c", "n", "p"]

# FIXED VALUES — the 32 ASCII punctuation characters deleted before splitting.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# FIXED VALUES — relevance keywords for nested abstract records.
RELEVANCE_KEYWORDS: list[str] = [
    "carbon emission", "co2 emissions", "greenhouse gases",
    "carbon footprint", "climate change", "decarbonization", "carbon neutrality",
]

# FIXED VALUES — affiliations that are not institutions (compared lower-cased, exact).
NON_INSTITUTION_AFFILIATIONS: list[str] = [
    "independent researcher", "independent consultant", "independent",
]

# FIXED VALUES — first year that is kept by the recency cut is CUTOFF_YEAR + 1.
CUTOFF_YEAR = 2019

# FIXED VALUES — words ignored by the word-frequency panel.
COMMON_WORDS: list[str] = ["the", "and", "of", "in", "to", "a", "for", "on", "with"]

# FIXED VALUES — density classes of a country's paper count relative to the maximum.
DENSITY_NONE = "No Papers"
DENSITY_LOW = "Low"
DENSITY_MEDIUM = "Medium"
DENSITY_HIGH = "High"
DENSITY_LOW_BELOW = 0.33
DENSITY_MEDIUM_BELOW = 0.66

# FIXED VALUES — defaults for missing fields of a scraped result card.
CARD_DEFAULTS = {
    "title": "No title",
    "url": "No URL",
    "source": "No source",
    "year": "No year",
    "abstract": "No abstract",
}

# FIXED VALUES — prompt text used to ask for a topic label.
LABEL_PROMPT_PREFIX = (
    "Based on the following keywords, create a concise, descriptive label that "
    "summarizes the main topic: "
)

# FIXED VALUES — topic-model sweep and fit settings.
K_SWEEP: list[int] = [2, 4, 6, 8, 10]
SWEEP_PASSES = 5
FINAL_PASSES = 10
TOP_WORDS_PER_TOPIC = 10
FALLBACK_LABEL_WORDS = 3

# FIXED VALUES — c_v coherence settings (boolean sliding window).
COHERENCE_TOPN = 20
COHERENCE_WINDOW = 110
COHERENCE_EPSILON = 1e-12

# FIXED VALUES — region → country names used by the region filter (6 regions).
REGION_COUNTRIES: dict[str, list[str]] = {
    "Asia": ["China", "Japan", "India", "South Korea", "Taiwan", "Vietnam", "Thailand", "Indonesia",
             "Malaysia", "Philippines", "Singapore", "Cambodia", "Myanmar", "Laos", "Bangladesh",
             "Sri Lanka", "Nepal", "Mongolia"],
    "Europe": ["Germany", "UK", "France", "Italy", "Spain", "Netherlands", "Belgium", "Switzerland",
               "Austria", "Sweden", "Norway", "Denmark", "Finland", "Ireland", "Portugal", "Greece",
               "Poland", "Czech Republic", "Hungary", "Romania", "Bulgaria", "Croatia", "Serbia",
               "Ukraine", "Belarus", "Lithuania", "Latvia", "Estonia"],
    "North America": ["United States", "Canada", "Mexico", "Costa Rica", "Panama", "Guatemala",
                      "Honduras", "El Salvador", "Nicaragua", "Belize"],
    "South America": ["Brazil", "Argentina", "Chile", "Colombia", "Peru", "Venezuela", "Ecuador",
                      "Bolivia", "Paraguay", "Uruguay", "Guyana", "Suriname"],
    "Africa": ["South Africa", "Egypt", "Nigeria", "Kenya", "Morocco", "Tunisia", "Algeria", "Ethiopia",
               "Ghana", "Cameroon", "Uganda", "Tanzania", "Rwanda", "Senegal", "Zimbabwe", "Zambia",
               "Angola", "Mozambique", "Ivory Coast", "Madagascar"],
    "Oceania": ["Australia", "New Zealand", "Papua New Guinea", "Fiji", "Solomon Islands", "Vanuatu",
                "New Caledonia", "French Polynesia", "Samoa", "Tonga"],
}
ALL_REGIONS = "All"
