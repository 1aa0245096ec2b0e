"""Fixed values of the rule set. Every operator reads its thresholds from here."""

from __future__ import annotations

# --- fixed values: taxonomy --------------------------------------------------
CATEGORIES = ["campus", "dormitory", "classroom", "library", "city", "sports", "lab", "student_life"]
REQUIRED_AREAS = ["campus", "dormitory", "classroom", "library", "city"]
THIN_AREAS = ["dormitory", "classroom", "library", "sports"]
HINT_ORDER = ["dormitory", "library", "classroom", "lab", "sports", "student_life", "campus"]
TIERS = ["verified", "likely", "unconfirmed"]
SOURCE_TYPES = ["official", "encyclopedic", "news", "independent", "social", "unknown"]
EVIDENCE_KINDS = ["provenance", "geo", "text", "visual", "cross_source", "community", "quality"]
IMAGE_TYPES = [
    "photo", "render_or_illustration", "logo_or_emblem", "map_or_plan",
    "document_or_screenshot", "collage", "other",
]
NOT_A_PHOTO_TYPES = ["logo_or_emblem", "map_or_plan", "document_or_screenshot", "collage"]
NAMES_INSTITUTION = ["this", "other", "none", "unclear"]
SCENE_VALUES = ["consistent", "inconsistent", "unclear"]
STAGES = ["gather", "fetch", "dedup", "verify", "assemble"]
STREAM_EVENT_TYPES = [
    "resolved", "ambiguous", "not_found", "source", "stage",
    "photos", "rejected", "description", "done", "error",
]
TERMINAL_EVENT_TYPES = ["done", "error", "ambiguous", "not_found"]
REVIEW_ASPECTS = ["dorm", "study", "campus", "city", "other"]

# Tray order of the reject reasons: accuracy first, technical ones last.
REJECT_REASONS = [
    "other_institution", "stock_source", "stock_reuse", "reused_across_universities",
    "far_geotag", "duplicate", "not_a_photo", "render", "portrait", "low_quality",
    "low_score", "fetch_failed", "verification_timeout",
]

# Regular expressions that hint at a category (case-insensitive substrings).
CATEGORY_KEYWORDS = {
    "campus": "campus|main building|building|entrance|aerial|кампус|корпус|здание",
    "dormitory": "dormitor|residence hall|hall of residence|hostel|student housing|общежит|студгородок|"
                 "студенческий городок|жатақхана",
    "classroom": "auditor|lecture|classroom|seminar room|аудитор|лекцион",
    "library": "librar|reading room|библиотек|читальн|кітапхана",
    "city": "skyline|panorama|cityscape|street|square|landmark|панорам|город|улиц|площад",
    "sports": "sport|stadium|gym|swimming pool|arena|спорт|стадион|бассейн",
    "lab": "laborator|makerspace|research center|лаборатор",
    "student_life": "student|graduation|ceremony|event|club|cafeteria|студент|выпуск|праздник|столов",
}

# First web-search template of each thin area.
QUERY_TEMPLATES = {
    "en": {"dormitory": '"{name}" dormitory', "classroom": '"{name}" lecture hall',
           "library": '"{name}" library', "sports": '"{name}" sports complex'},
    "ru": {"dormitory": '"{name}" общежитие', "classroom": '"{name}" аудитория',
           "library": '"{name}" библиотека', "sports": '"{name}" спорткомплекс'},
}
RU_FIRST_COUNTRIES = ["KZ", "RU", "KG", "UZ", "TJ", "TM", "BY", "AM", "AZ", "GE", "MD", "UA"]

# --- fixed values: domain lists ----------------------------------------------
STOCK_DOMAINS = [
    "shutterstock.com", "istockphoto.com", "gettyimages.com", "depositphotos.com", "dreamstime.com",
    "alamy.com", "123rf.com", "freepik.com", "pexels.com", "unsplash.com", "pixabay.com",
    "stock.adobe.com", "vecteezy.com", "bigstockphoto.com", "canstockphoto.com", "rawpixel.com",
    "pond5.com", "storyblocks.com",
]
ENCYCLOPEDIC_DOMAINS = ["wikipedia.org", "wikimedia.org", "wikidata.org"]
SOCIAL_DOMAINS = [
    "instagram.com", "facebook.com", "vk.com", "ok.ru", "tiktok.com", "x.com", "twitter.com", "t.me",
    "threads.net", "youtube.com",
]
AGGREGATOR_DOMAINS = ["pinterest.com", "pinimg.com", "pinterest.ru"]
NEWS_DOMAINS = [
    "tengrinews.kz", "nur.kz", "zakon.kz", "inform.kz", "kazpravda.kz", "kursiv.media", "forbes.kz",
    "vlast.kz", "orda.kz", "kapital.kz", "khabar.kz", "24.kz", "el.kz", "ktk.kz", "lsm.kz", "bnews.kz",
    "dknews.kz", "sputnik.kz", "azattyq.org", "astanatimes.com", "bbc.com", "reuters.com",
    "theguardian.com",
]
ACADEMIC_LEVELS = ["edu", "ac"]

# --- fixed values: higher-education classes ----------------------------------
HIGHER_EDUCATION_CLASSES = [
    "Q38723", "Q3918", "Q875538", "Q902104", "Q15936437", "Q62078547", "Q265662", "Q4315006",
    "Q1371037", "Q189004", "Q1663017", "Q1143635", "Q162633", "Q1336920", "Q184644", "Q917182",
    "Q20820271", "Q2120173", "Q1916585", "Q494230", "Q1321960", "Q7603893", "Q131389368", "Q17028020",
    "Q15407956", "Q7894996", "Q615150", "Q3354859", "Q1767829", "Q3551775", "Q847027", "Q21028957",
    "Q3889692", "Q16710795", "Q12420428", "Q1499580", "Q130382439", "Q2120466", "Q1407393", "Q3698852",
    "Q47531586", "Q98658352", "Q16077796", "Q3520135", "Q1620945",
]
GENERIC_EDUCATION_CLASSES = ["Q5341295", "Q2385804", "Q4671277"]
HIGHER_EDUCATION_TEXT = r"(?iu)universit|университет|higher education|высшее учебное|вуз\b"

# --- fixed values: points and thresholds -------------------------------------
POINTS = {
    "commons_depicts": 45, "commons_category": 40, "geo_near_campus": 35, "geo_in_city": 35,
    "wikipedia_use": 30, "official_domain": 30, "official_domain_weak": 10, "visible_text_this": 30,
    "page_mentions_name": 15, "cross_source_match": 15, "news_mentions_name": 10,
    "visual_consistent": 10, "geo_same_city": 10, "visual_inconsistent": -25, "render": -40,
    "low_res": -10,
}
STRONG_SIGNALS = [
    "commons_depicts", "commons_category", "geo_near_campus", "geo_in_city", "wikipedia_use",
    "official_domain", "visible_text_this",
]
NEGATIVE_SIGNALS = ["render", "visual_inconsistent"]
TIER_VERIFIED, TIER_LIKELY, TIER_UNCONFIRMED = 60, 35, 10
GEO_NEAR_M, GEO_CITY_M, GEO_FAR_M = 1_500, 30_000, 50_000
EARTH_RADIUS_M = 6_371_000
CAMPUS_RADIUS_M, CITY_RADIUS_M = 1_000, 2_000
OUTDATED_YEARS = 10

SELECT_LIMIT, BATCH_SIZE = 36, 12
MIN_SHORT_SIDE_PX = 300
NEAR_DUP_HAMMING, UPLOAD_DUP_HAMMING = 6, 10
ALSO_FOUND_CAP = 8
CARDS_CAP, RETRIEVAL_POOL = 6, 12
DISPLAY_CAP, COMPARE_CAP = 12, 3
QUERY_CAP = 6

SOURCE_TYPE_PRIOR = {"official": 10, "encyclopedic": 8, "news": 5, "independent": 3, "social": 1, "unknown": 0}

# --- fixed values: resolution ------------------------------------------------
MIN_MATCH, MIN_LEAD, EXACT_MATCH, MIN_FUZZY = 0.6, 0.1, 0.95, 0.75
STEM_PREFIX, MIN_EXTENDED_WORD = 7, 6
MIN_PREFIX_WORD = 4  # shorter words find whole words only
RESOLVER_VERSION = 6

# --- fixed values: cache lifetimes (seconds) ---------------------------------
PROFILE_TTL_S, RESOLVE_TTL_S, NOT_FOUND_TTL_S, SEARCH_TTL_S = 14 * 86400, 7 * 86400, 86400, 72 * 3600

# --- fixed values: community -------------------------------------------------
MATCH_WEIGHTS = {"country": 40, "city": 20, "popularity_max": 8, "popularity_cap": 80, "good": 15, "thin": 6}
MATCH_POOL = 40
REPORT_THRESHOLD = 3
REVIEW_MIN_CHARS, REVIEW_MAX_CHARS = 30, 1000
MASK_TOKEN = "[удалено]"

# --- fixed values: rate limits (calls, window seconds) ------------------------
RATE_FRESH = (40, 600)
RATE_PROBE = (10, 600)
RATE_REVIEW = (3, 3600)
RATE_UPLOAD = (5, 600)

SOURCE_LENSES = {
    "all": [],
    "official": ["official"],
    "independent": ["encyclopedic", "news", "independent", "social"],
}
