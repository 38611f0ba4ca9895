"""Results depend on each of them, so they are stated as plain text.

Word lists, category patterns, thresholds, labels and the prompt wording below are
part of the result contract. Change them only through the arguments that take them.
"""

# --- fixed values: category patterns, tested in this order, first hit wins ---
CATEGORY_PATTERNS = [
    ("Food & Beverage",
     "restaurant|food|caterer|bakery|deli|cafe|catering|grocery|liquor|tavern|bar|pub|nightclub|retail food"),
    ("Retail",
     "retail|store|shop|boutique|clothing|apparel|merchandise|gift|flower|florist|tobacco|jewelry|antique|furniture|hardware|electronics|auto parts"),
    ("Health & Personal Care",
     "health|medical|dental|clinic|pharmacy|hospital|therapy|therapist|massage|spa|salon|barber|beauty|nail|optician|optometrist|physician|chiropractic|acupuncture"),
    ("Construction & Trades",
     "contractor|construction|remodel|plumb|electric|hvac|roofing|mason|landscap|paint|carpenter|general contractor"),
    ("Automotive & Transportation",
     "auto|vehicle|car|tire|mechanic|garage|towing|gas station|fuel|parking|taxi|livery|limo|transportation"),
    ("Professional Services",
     "office|professional|consulting|financial|insurance|real estate|accounting|attorney|law|legal|architect|engineer|tech|software|staffing|advertising|marketing"),
    ("Education, Arts & Recreation",
     "child|daycare|day care|school|educat|tutor|fitness|gym|recreation|sport|theater|entertainment|music|art|gallery|museum"),
    ("Lodging",
     "hotel|motel|bed and breakfast|hostel|lodging|short-term|airbnb"),
    ("Wholesale & Industrial",
     "wholesale|warehouse|distribution|manufacturing|industrial|storage|moving"),
]
CATEGORY_DEFAULT = "Other"
DESCRIPTION_DEFAULT = "Unknown"

# --- fixed values: domain stopwords ---
DOMAIN_STOPWORDS = [
    "chicago", "neighborhood", "area", "community", "city",
    "street", "ave", "blvd", "block", "north", "south", "east", "west",
    "il", "illinois", "post", "thread", "comment", "reddit",
    "https", "www", "com", "amp", "gt", "lt",
    "1", "2", "3", "4", "5", "10", "100",
]
DOMAIN_LEXICON = "chicago_custom"

# --- fixed values: extra stopwords for visitor phrases only ---
HOSPITALITY_STOPWORDS = [
    "stay", "stayed", "host", "hosts", "place", "great", "nice",
    "good", "clean", "comfortable", "apartment", "room", "unit",
    "airbnb", "listing", "location", "highly", "recommend",
    "recommended", "everything", "perfect", "wonderful",
]
HOSPITALITY_LEXICON = "airbnb_custom"

# --- fixed values: thresholds and limits ---
ACTIVE_STATUS = "AAC"
AREA_RANGE = (1, 77)
SPINE_ROWS = 77
SENTIMENT_BAND = 0.05
FULL_POSTS = 10
MIN_CLEAN_CHARS = 5
MIN_REVIEW_CHARS = 10
TOP_CATEGORIES = 3
CANDIDATE_PHRASES = 20
KEPT_PHRASES = 10
MIN_PRIMARY_POSTS = 15
MAX_POSTS_PER_SOURCE = 1000
OVERVIEW_ROWS = 10
TRUNCATE_WIDTH = 80

# --- fixed values: token shape that counts as a word ---
WORD_SHAPE = "^[a-z]{3,}$"

# --- fixed values: separators, labels and flags ---
CATEGORY_SEPARATOR = " | "
PHRASE_SEPARATOR = ", "
NO_CATEGORIES = "No data"
POSITIVE, NEUTRAL, NEGATIVE = "Positive", "Neutral", "Negative"
FLAG_NO_POSTS, FLAG_FEW_POSTS, FLAG_FULL = "business_only", "low_reddit", "full"
FLAG_NO_LISTINGS = "no_airbnb"
STATUS_COLLECTED, STATUS_SKIPPED = "collected", "skipped"
MISSING_PRICE_PROMPT = "N/A"
MISSING_PRICE_CARD = "—"
MISSING_SUMMARY = "_No AI summary available._"
NOTICE_FEW_POSTS = "⚠ limited Reddit data"
NOTICE_NO_POSTS = "no Reddit data"
NOTICE_NO_LISTINGS = "no Airbnb data"

# --- fixed values: prompt wording, one entry per line ---
PROMPT_HEAD = [
    "You are writing a data-driven neighborhood profile for a public data journalism project.",
    "Write a 3–4 sentence summary of the {name} neighborhood in Chicago based ONLY on the",
    "following data. Do not use general knowledge about the neighborhood.",
    "Do not begin with '{name} is...'",
    "If the Airbnb visitor phrases and Reddit resident phrases differ noticeably,",
    "briefly note what visitors seem to value that residents don't often discuss.",
    "",
    "Data for {name}:",
]
PROMPT_BUSINESS = [
    "- Active business licenses: {total}",
    "- Top business categories: {categories}",
    "- Business diversity index (Shannon entropy): {diversity}",
]
PROMPT_POSTS = [
    "- Overall community sentiment: {label}",
    "- Top phrases from Reddit discussions (resident voice): {phrases}",
]
PROMPT_NO_POSTS = "(No Reddit data available for this neighborhood.)"
PROMPT_LISTINGS_TITLE = "Airbnb visitor data:"
PROMPT_LISTINGS = [
    "- Active Airbnb listings: {listings}",
    "- Median nightly price: {price}",
    "- Top phrases from Airbnb guest reviews (visitor voice): {visitor_phrases}",
]
PROMPT_NO_LISTINGS = "(No Airbnb listing data available for this neighborhood.)"
PROMPT_TAIL = ["", "Write the summary now:"]
