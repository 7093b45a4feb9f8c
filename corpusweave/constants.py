"""Fixed values of the wiki data model.

Everything here is data: results are only right if these strings, numbers and patterns are exactly these.
"""

from dataclasses import dataclass

# --- fixed values: link decisions ------------------------------------------------------------------
CLASS_NO_REWRITE = "mwo-norewrite"
CLASS_SELF_LINK = "mw-selflink"
CLASS_RED_LINK = "new"
CLASS_MIRROR_LINK = "mirror-link"
REL_NO_REWRITE = "mwo:NoRewrite"
REL_MEDIA = "mw:MediaLink"
REL_EXTERNAL = "mw:ExtLink"
REL_WIKI = "mw:WikiLink"
REL_INTERWIKI = "mw:WikiLink/Interwiki"
REL_REFERENCED_BY = "mw:referencedBy"

# --- fixed values: URL shapes ----------------------------------------------------------------------
SCHEME_PATTERN = r"^([a-zA-Z][a-zA-Z\d+\-.]*):"
THUMB_PATTERN = (
    r"^(.*?\/)(transcoded\/|thumb\/)?([0-9a-fA-F]{1}\/[0-9a-fA-F]{2}\/)?([^/]+\.[A-Za-z0-9]{2,6}\/)?"
    r"(\d+px[-]+)?([^/]+?\.[A-Za-z0-9]{2,6}(\.[A-Za-z0-9]{2,6})?)(\?[0-9a-fA-F]+|\?utm_.+)?$"
)
FORMULA_PATTERN = r"^(.*\/math\/render\/svg\/)([A-Za-z0-9]+)$"
FANDOM_PATTERN = r"(?i)^(.*\/)[0-9a-fA-F]{1}\/[0-9a-fA-F]{2}\/([^/]+)\/revision\/"
WIDTH_IN_URL_PATTERN = r"[/-]([0-9]+)px-"
MULT_IN_URL_PATTERN = r"-([0-9.]+)x\."
ASSET_DIR = "_assets_"
PARTIALS_DIR = "_categories_partials_"
MODULE_DIR = "_mw_"

# --- fixed values: content cleaning ----------------------------------------------------------------
CLASS_BLACKLIST = [
    "noprint", "metadata", "ambox", "stub", "topicon", "magnify", "navbar", "mw-kartographer-container",
    "mw-dismissable-notice", "navigation-only", "listing-sister-icons", "owid-frame",
]
CLASS_BLACKLIST_LEAD_ONLY = ["mw-ref"]
CLASS_BLACKLIST_IF_NO_LINK = ["mainarticle", "seealso", "dablink", "rellink", "hatnote"]
CLASS_TOKENS_DROPPED = ["plainlinks", "onlyoffline"]
CLASS_FORCED_DISPLAY = ["thumb"]
ID_BLACKLIST = ["purgelink"]
ATTRS_DROPPED = ["data-parsoid", "about", "data-mw"]
LEAD_SECTION_ID = "0"

# --- fixed values: modules -------------------------------------------------------------------------
BASE_STYLE_MODULES = ["site.styles", "noscript"]
BASE_SCRIPT_MODULES = ["jquery", "mediawiki.base"]
TRUSTED_SCRIPT_MODULES = [
    "jquery", "mediawiki.base", "jquery.tablesorter", "jquery.makeCollapsible", "mediawiki.page.ready",
    "mediawiki.page.gallery", "ext.cite.ux-enhancements", "ext.pygments.view", "ext.Tabber", "ext.tabberNeue",
    "ext.tmh.player", "ext.cargo.main",
]
DYNAMIC_SCRIPT_DEPENDENCIES = {
    "mediawiki.page.ready": ["jquery.tablesorter", "jquery.makeCollapsible"],
    "ext.tmh.player": ["ext.tmh.player.inline", "ext.tmh.player.dialog"],
    "ext.cargo.main": ["oojs-ui-core"],
}
# text found in the page -> (style module, script module)
TEXT_TRIGGERED_MODULES = {
    "sortable": ("jquery.tablesorter.styles", "jquery.tablesorter"),
    "mw-collapsible": ("jquery.makeCollapsible.styles", "jquery.makeCollapsible"),
}

# --- fixed values: page configuration and css classes ----------------------------------------------
USER_CONFIG_KEYS = [
    "wgRequestId", "wgTempUserName", "wgUserId", "wgUserIsTemp", "wgUserEditCount", "wgUserRegistration",
    "wgUserFirstRegistration",
]
FORCED_CONFIG = {
    "wgBreakFrames": "false", "wgUserName": None, "wgUserGroups": '["*"]', "wgIsProbablyEditable": "false",
    "wgRelevantPageIsProbablyEditable": "false",
}
CONFIG_PATTERNS = [r'(?s);RLCONF=(\{".*?\});\s?RLSTATE=', r'(?s)\{mw\.config\.set\((\{".*?\})\);mw\.loader\.state\(']
BODY_CLASS_REPLACEMENTS = [("action-nosuchaction", "action-view"), ("mw-editable", "")]
HTML_CLASS_REPLACEMENTS = [
    ("vector-toc-available", "vector-toc-not-available"),
    ("vector-feature-toc-pinned-clientpref-1", "vector-feature-toc-pinned-clientpref-0 vector-toc-not-available"),
    ("vector-feature-appearance-pinned-clientpref-1", "vector-feature-appearance-pinned-clientpref-0"),
    ("vector-feature-page-tools-pinned-enabled", "vector-feature-page-tools-pinned-disabled"),
    ("vector-feature-main-menu-pinned-enabled", "vector-feature-main-menu-pinned-disabled"),
    ("skin-theme-clientpref-day", "skin-theme-clientpref-os"),
    ("skin-theme-clientpref-night", "skin-theme-clientpref-os"),
]

# --- fixed values: catalogue -----------------------------------------------------------------------
DEFAULT_CONTENT_MODEL = "wikitext"
BLACKLISTED_NAMESPACES = ["Story"]
INDEX_PATH_CANDIDATES = ["index", "welcome", "home", "Main_Page"]
INDEX_MIN_IMAGES = 10
INDEX_MAX_IMAGES = 100
LISTING_PAGE_SIZE = 200
GALLERY_COLUMNS_ABOVE = 6
TITLE_WORD_MAX_BYTES = 240
KNOWN_PROJECTS = [
    "wikipedia", "wikisource", "wikibooks", "wikiquote", "wikivoyage", "wikiversity", "wikinews", "wiktionary",
]
PLURAL_CATEGORIES = ["zero", "one", "two", "few", "many", "other"]

# --- fixed values: MIME ----------------------------------------------------------------------------
IMAGE_MIME_PATTERN = r"^image+[/\-\w.]+$"
BITMAP_MIME_PATTERN = r"^image+[/\-\w.]+(jpeg|png|apng|gif)$"
WEBP_CANDIDATE_MIME_PATTERN = r"image+[/]+(jpeg|png|apng|gif)"
MIME_BY_EXTENSION = {
    ".js": "text/javascript", ".css": "text/css", ".json": "application/json", ".woff": "font/woff",
    ".woff2": "font/woff2", ".ttf": "font/ttf", ".otf": "font/otf", ".eot": "application/vnd.ms-fontobject",
    ".svg": "image/svg+xml", ".png": "image/png", ".gif": "image/gif", ".jpg": "image/jpeg", ".jpeg": "image/jpeg",
}

# --- fixed values: failures and budgets ------------------------------------------------------------
FILE_MAX_ATTEMPTS = 5
FILE_FAILURES_BEFORE_CHECK = 50
FILE_FAILURES_PER_TEN_THOUSAND = 10
PAGE_FAILURES_FLOOR = 5
PAGES_PER_ALLOWED_FAILURE = 100000
RETRIED_HTTP_CODES = [429, 500, 502, 503, 504, 524]
TRANSPORT_CODES_NOT_RETRIED = ["ERR_BAD_REQUEST", "ERR_BAD_RESPONSE"]
API_CODES_NOT_RETRIED = [
    "missingtitle", "readapidenied", "permissiondenied",
    "internal_api_error_MediaWiki\\Revision\\BadRevisionException",
    "internal_api_error_Wikimedia\\Assert\\UnreachableException",
    "internal_api_error_Wikimedia\\Assert\\InvariantException",
    "internal_api_error_Wikimedia\\Parsoid\\Core\\ResourceLimitExceededException",
]
DB_ERROR_CODE = "internal_api_error_DBQueryError"

PARSE_URL = "api.php?action=parse&format=json"
@dataclass(frozen=True)
class ErrorRule:
    """A rule of the error table: the conditions that are given must all hold. ``hard`` failures count against the page budget."""

    message: str
    error_code: str | None = None
    url: str | None = None
    http: tuple[int, ...] | list[int] | None = None
    content_type: str | None = None
    empty_body: bool = False
    raw_text: str | None = None
    json_path: str | None = None
    json_text: str | None = None
    hard: bool = False


# Ordered; the first rule whose given conditions all hold decides.
ERROR_RULES = [
    ErrorRule("DELETED_PAGE", http=[404]),
    ErrorRule("DELETED_PAGE", raw_text="Page has been deleted."),
    ErrorRule("DELETED_PAGE", json_path="error.code", json_text="missingtitle"),
    ErrorRule("PERMISSION_DENIED", json_path="error.code", json_text="permissiondenied"),
    ErrorRule("CATEGORY_LOCKDOWN", json_path="error.code", json_text="categorylockdown"),
    ErrorRule("CLIENT_SIDE_TIMEOUT", error_code="ERR_CANCELED", hard=True),
    ErrorRule("ACTION_PARSE_UPSTREAM_TIMEOUT", url=PARSE_URL, http=[200, 504], content_type="application/json", json_path="error.code",
              json_text="internal_api_error_Wikimedia\\RequestTimeout\\RequestTimeoutException", hard=True),
    ErrorRule("ACTION_PARSE_HTML_503_ERROR", url=PARSE_URL, http=[503], content_type="text/html",
              raw_text="Our servers are currently under maintenance or experiencing a technical problem", hard=True),
    ErrorRule("ACTION_PARSE_BAD_REVISION_ERROR", url=PARSE_URL, http=[200], content_type="application/json", json_path="error.code",
              json_text="internal_api_error_MediaWiki\\Revision\\BadRevisionException", hard=True),
    ErrorRule("ACTION_PARSE_UNREACHABLE_EXCEPTION_ERROR", url=PARSE_URL, http=[200], content_type="application/json",
              json_path="error.code", json_text="internal_api_error_Wikimedia\\Assert\\UnreachableException", hard=True),
    ErrorRule("ACTION_PARSE_INVARIANT_EXCEPTION_ERROR", url=PARSE_URL, http=[200], content_type="application/json", json_path="error.code",
              json_text="internal_api_error_Wikimedia\\Assert\\InvariantException", hard=True),
    ErrorRule("ACTION_PARSE_PARSOID_RESOURCE_LIMIT_EXCEEDED", url=PARSE_URL, http=[200], content_type="application/json",
              json_path="error.code", json_text="internal_api_error_Wikimedia\\Parsoid\\Core\\ResourceLimitExceededException", hard=True),
    ErrorRule("ACTION_PARSE_GENERIC_INTERNAL_API_ERROR", url=PARSE_URL, http=[200], content_type="application/json",
              json_path="error.code", json_text="internal_api_error_Error", hard=True),
    ErrorRule("ACTION_PARSE_INVALID_ARGUMENT_EXCEPTION_ERROR", url=PARSE_URL, http=[200], content_type="application/json",
              json_path="error.code", json_text="internal_api_error_InvalidArgumentException", hard=True),
    ErrorRule("ACTION_PARSE_INTERNAL_API_TYPE_ERROR", url=PARSE_URL, http=[200], content_type="application/json", json_path="error.code",
              json_text="internal_api_error_TypeError", hard=True),
    ErrorRule("ACTION_PARSE_TRUNCATED_RESPONSE", url=PARSE_URL, json_path="warnings.result.*", json_text="This result was truncated", hard=True),
    ErrorRule("ACTION_PARSE_EMPTY_500_RESPONSE", url=PARSE_URL, http=[500], content_type="text/html", empty_body=True, hard=True),
]

# --- fixed values: snapshot metadata ---------------------------------------------------------------
METADATA_REQUIRED = ["Creator", "Description", "Language", "Publisher", "Title", "Illustration_48x48@1"]
METADATA_MIN_ONE = ["Name", "Creator", "Description", "Language", "Publisher", "Title"]
METADATA_MAX_GRAPHEMES = {"Description": 80, "Title": 30, "LongDescription": 4000}
METADATA_LANGUAGE_PATTERN = r"^\w{3}(,\w{3})*$"
METADATA_DATE_LENGTH = 10
PNG_SIGNATURE_HEX = "89504E470D0A1A0A"

# --- fixed values: embeds --------------------------------------------------------------------------
VIDEO_HOST_MARKS = ["youtube.com/embed/", "youtube-nocookie.com/embed/", "youtu.be/", "youtube.com/watch"]
VIDEO_ID_PATTERN = r"(?:embed\/|v=|\.be\/)([a-zA-Z0-9_-]+)"

# fixed values: what stands for an embedded frame
FRAME_CARD_CLASS = "mwo-external-video-card"
FRAME_TEXTS = {"thumbnail": "Video thumbnail", "label": "View this content externally", "card": "Open embedded content (external)"}

# fixed values: style modules of category pages, and of those with files shown as a gallery
CATEGORY_STYLE_MODULE = "mediawiki.action.styles"
GALLERY_STYLE_MODULE = "mediawiki.page.gallery.styles"

# fixed values: texts of metadata violations
METADATA_MESSAGES = {
    "required": 'Metadata "{key}" is required',
    "language": 'MetaData Language: must match pattern "{pattern}"',
    "graphemes": "MetaData {key}: must NOT have more than {most} graphemes",
    "characters": "MetaData {key}: must NOT have more than {most} characters",
    "image": "MetaData {key}: must match regex pattern",
}
