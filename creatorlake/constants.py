"""Fixed values. Addresses, patterns, column orders and limits that results must agree on."""

# Site addresses.
SITE_URL = "https://www.tiktok.com/"

# Endpoint patterns, matched anywhere in the address and in any letter case.
SEARCH_ENDPOINT = r"https://www\.tiktok\.com/api/search/general/full/\?[^ ]+"
POST_LIST_ENDPOINT = r"https://www\.tiktok\.com/api/post/item_list/\?[^ ]+"
COMMENT_LIST_ENDPOINT = r"https://www\.tiktok\.com/api/comment/list/\?[^ ]+"

# Limits of a run.
PROFILES_PER_HASHTAG = 50
POSTS_PER_PROFILE = 50
COMMENTS_PER_POST = 100
SNAPSHOTS_KEPT = 3
LARGE_RESPONSE_BYTES = 1024 * 1024

# Text forms of a boolean.
TRUE_WORDS = ["true", "t", "yes", "y", "on", "1"]
FALSE_WORDS = ["false", "f", "no", "n", "off", "0"]

# Shape of a hashtag.
HASHTAG_PATTERN = r"\A[a-zA-Z0-9_]+\z"
HASHTAG_MAX_LENGTH = 100

# Longest accepted address, default length of a video in seconds.
URL_MAX_LENGTH = 2083
DEFAULT_DURATION = 30

# Column order of the clean tables.
INFLUENCER_COLUMNS = [
    "tiktok_id", "username", "sec_uid", "display_name", "bio_text", "is_verified", "is_private",
    "profile_url", "avatar_thumb", "avatar_medium", "avatar_large", "follower_count",
    "following_count", "total_likes", "video_count", "comment_setting", "duet_setting",
    "stitch_setting", "download_setting", "created_at", "updated_at",
]
POST_COLUMNS = [
    "post_id", "influencer_tiktok_id", "description", "duration", "view_count", "like_count",
    "comment_count", "share_count", "collect_count", "is_ad", "is_pinned", "posted_at", "created_at",
]
COMMENT_COLUMNS = [
    "comment_id", "post_id", "influencer_tiktok_id", "create_time", "comment_text", "digg_count",
    "reply_comment_total", "share_title", "share_desc",
]
REPLY_COLUMNS = [
    "main_comment_id", "reply_comment_id", "replier_id", "reply_text", "digg_count", "label_text",
]
POST_HASHTAG_COLUMNS = ["post_id", "hashtag"]
HASHTAG_FREQUENCY_COLUMNS = ["influencer_tiktok_id", "hashtag", "frequency"]

# Column order of the flattened collection tables.
FLAT_PROFILE_COLUMNS = [
    "user_id", "username", "display_name", "avatar_url", "verified", "follower_count",
    "following_count", "heart_count", "video_count", "posts_count", "load_timestamp",
    "profile_url", "found_under_hashtags", "raw_author_data",
]
FLAT_POST_COLUMNS = ["post_id", "user_id", "raw_post_data"]
FLAT_COMMENT_COLUMNS = [
    "comment_id", "post_id", "user_id", "profile_username", "profile_display_name",
    "raw_comment_data", "create_time",
]
RELATION_COLUMNS = ["user_id", "hashtag"]
