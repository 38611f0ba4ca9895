"""Declared schemas; nothing is inferred."""

LOOKUP = ("community_area_number int, name string, slug string, reddit_search_term string, "
          "subreddit string")

# fixed values: header of the raw licence file and the column each one becomes
LICENCE_COLUMNS = [
    ("ID", "id"),
    ("LICENSE ID", "license_id"),
    ("LEGAL NAME", "legal_name"),
    ("DOING BUSINESS AS NAME", "doing_business_as"),
    ("ADDRESS", "address"),
    ("COMMUNITY AREA", "community_area"),
    ("COMMUNITY AREA NAME", "community_area_name"),
    ("LICENSE CODE", "license_code"),
    ("LICENSE DESCRIPTION", "license_description"),
    ("BUSINESS ACTIVITY ID", "business_activity_id"),
    ("BUSINESS ACTIVITY", "business_activity"),
    ("LICENSE STATUS", "license_status"),
    ("LICENSE TERM START DATE", "license_term_start"),
    ("LICENSE TERM EXPIRATION DATE", "license_term_expiry"),
    ("LATITUDE", "latitude"),
    ("LONGITUDE", "longitude"),
]
RAW_LICENCES = ", ".join(f"`{raw}` string" for raw, _ in LICENCE_COLUMNS)

LISTINGS = ("id bigint, latitude double, longitude double, price string, room_type string, "
            "reviews_per_month double")
REVIEWS = "listing_id bigint, date date, reviewer_id bigint, comments string"

# counts are read as text, so that 3.0 or a quoted number does not spoil the record
POST = ("id string, title string, selftext string, score string, num_comments string, "
        "created_utc double, subreddit string, url string, permalink string, author string")
POST_STRUCT = "struct<" + ", ".join(f.strip().replace(" ", ": ") for f in POST.split(",")) + ">"
POST_FILE = ("slug string, name string, sources array<string>, posts array<struct<id: string, title: string, "
             "selftext: string, score: string, num_comments: string, subreddit: string>>")
LISTING_PAYLOAD = f"data struct<children: array<struct<data: {POST_STRUCT}>>, after: string>"

#: A page as it was landed: whose it is, the source and feed it came from, its place there, and what came.
PAGE_KEYS = ["slug", "source_kind", "source_name", "source_no", "feed", "feed_no", "page"]
PAGES = ("slug string, source_kind string, source_name string, source_no int, feed string, feed_no int, page int, "
         "payload string")
STORED_POSTS = ("slug string, name string, sources array<string>, part int, posts array<struct<id: string, title: string, "
                "selftext: string, score: int, num_comments: int, subreddit: string>>")
COLLECTION_LOG = "slug string, name string, post_count bigint, sources string, status string"

KEY_CONFIG = ("request_delay_seconds double, min_posts_threshold int, fallback_subreddit string, "
              "primary_subreddit string, post_limit int, max_posts int, time_filter string, "
              "neighborhoods array<struct<slug: string, name: string, search_term: string, "
              "search_terms: array<string>, subreddits: array<string>>>")

REGIONS = ("features array<struct<properties: struct<area_numbe: string, community_area_number: string>, "
           "geometry: struct<type: string, coordinates: string>>>")
