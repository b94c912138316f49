"""Fixed values.

Everything here has to equal what existing users of the migration already see
(stored settings, statement texts, status words), so it is stated once, plainly.
"""

# Settings a project starts with, and the two sections its file must have.
SETTING_DEFAULTS = {
    "sql_file": "vip-db.sql",
    "old_domain": "",
    "new_domain": "",
    "all_tables": "true",
    "dry_run": "false",
    "clear_revisions": "true",
    "setup_stage_proxy": "true",
    "auto_proceed": "false",
}
GENERAL_SECTION = "general"
MAPPING_SECTION = "site_mappings"
REQUIRED_SETTINGS = ("sql_file", "old_domain", "new_domain")
DOMAIN_SETTINGS = ("old_domain", "new_domain")
TRUE_WORDS = ("true", "yes", "1", "on")

# Messages of the settings check.
MISSING_SECTION = "Missing [%s] section"
MISSING_SETTING = "Missing or empty %s setting"

# Table naming and row markers of the blog database.
DEFAULT_PREFIX = "wp_"
SITE_TABLES = ("posts", "options")  # every site has these
REVISION_TYPE = "revision"
SKIPPED_COLUMNS = ("guid",)
DELETE_BATCH = 500
LAST_RESORT_DOMAIN = "local.test"

# Options of the media proxy.
PROXY_URL_OPTION = "sfp_url"
PROXY_MODE_OPTION = "sfp_mode"
PROXY_MODE = "header"
PROXY_UNSET = "Not set"
PROXY_IGNORE_ENTRY = "/plugins/stage-file-proxy/"

# Mapping status words.
STATUS_NO_MAPPING = "(no mapping found)"
STATUS_UNCHANGED = "(unchanged)"

# Detection record.
INSTALL_TYPES = ("single", "multisite", "error")
NETWORK_TYPES = ("subdomain", "subdirectory", "unknown")
DETECTION_METHODS = ("database", "wp-config", "wp-cli", "filesystem", "fallback", "validation_failed")
NETWORK_FLAG = "--network"
NOT_APPLICABLE = "NA"

# Main-site detection methods, in the order they are tried.
MAIN_SITE_METHODS = (
    "database-wp_site",
    "database-wp_blogs",
    "wp-cli-site-list",
    "wp-cli-network-admin",
    "wp-eval-get_main_site_id",
    "wp-eval-current-site",
    "fallback-root-path",
    "fallback-lowest-id",
    "hardcoded-fallback",
)

# Path fragments that mark a network install, with the label each is reported under.
NETWORK_PATHS = (
    ("blogs.dir", "wp-content/blogs.dir"),
    ("uploads/sites", "wp-content/uploads/sites"),
    ("mu-plugins", "wp-content/mu-plugins"),
    ("htaccess-rules", ".htaccess"),
)
NETWORK_REWRITE_RULE = "RewriteRule.*wp-includes/ms-files.php"

# Accepted forms of a strictly checked address (after "https://" was put in front).
STRICT_MAX_LENGTH = 2048
STRICT_REFUSED_CHARACTERS = r"""[;|&$`()<>"']"""
STRICT_CONTROL_CHARACTERS = r"[\x00-\x1f\x7f]"
STRICT_LOCALHOST = r"\Ahttps://localhost(:[0-9]{1,5})?(/.*)?\z"
STRICT_DOTTED_QUAD = r"\Ahttps://([0-9]{1,3}\.){3}[0-9]{1,3}(:[0-9]{1,5})?(/.*)?\z"
STRICT_HOST = (
    r"\Ahttps://[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
    r"(\.[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)+(:[0-9]{1,5})?(/.*)?\z"
)
LOCAL_HOSTS = r"localhost|127\.0\.0\.1|0\.0\.0\.0"

# Size tiers, largest first: a size belongs to the first tier it exceeds.
SIZE_TIERS = (
    ("TB", 1024**4),
    ("GB", 1024**3),
    ("MB", 1024**2),
    ("KB", 1024),
)

# Statement texts.
UPDATE_BLOG = 'UPDATE %sblogs SET domain = "%s", path = "%s" WHERE blog_id = %s; -- %s → %s (%s)'
UPDATE_NETWORK = "UPDATE %ssite SET domain = '%s' WHERE id = 1;"
UPDATE_HEADING_SUBSITES = "-- 1. Update %sblogs table: blog domain and path for SUB-SITES (ID != %s)"
UPDATE_HEADING_MAIN = "-- 2. Update %sblogs table: blog domain and path for MAIN SITE (ID = %s)"
UPDATE_HEADING_NETWORK = "-- 3. Update %ssite table: the main network site domain (ID = 1)"
UPDATE_DUPLICATE = "-- Skipping duplicate blog_id %s for domain %s"
DELETE_META = (
    "DELETE FROM `%spostmeta` WHERE `post_id` in (SELECT ID FROM `%sposts` WHERE `post_type` = 'revision');"
)
DELETE_POSTS = "DELETE FROM `%sposts` WHERE `post_type` = 'revision';"
DELETE_COMMENT = "-- Blog ID %s (%s) - Tables: %sposts, %spostmeta"
