"""Fixed values. They decide results, so they are stated once, as text."""

# --- thresholds -----------------------------------------------------------
CONFIDENCE_THRESHOLD = 0.75
DISAGREEMENT_THRESHOLD = 0.15
LOCAL_QUALITY_MINIMUM = 0.30
UNKNOWN_QUALITY = 0.5
ALWAYS_ESCALATE = ("line_items",)
HEALTH_TTL_SECONDS = 30
ABS_TOLERANCE = 0.05
REL_TOLERANCE = 0.01
FUZZY_ACCEPT = 0.85
DENSE_TEXT_CHARS = 50
UPLOAD_CAP_BYTES = 20 * 1024 * 1024
STATE_TTL_SECONDS = 86_400
TASK_TIMEOUT_SECONDS = 600
HINT_LINES = 100
DASHBOARD_JOBS = 100
BARE_VALUE_CONFIDENCE = 0.7
MISSING_CONFIDENCE = 0.5
LINE_ITEM_BOX_CONFIDENCE = 0.92
RENDER_DPI = 150.0

# --- enumerations (stored as strings) --------------------------------------
TERMINAL_STATUSES = ("complete", "failed")
MODEL_SOURCES = ("local", "claude", "groq", "human")
REVIEW_REASONS = ("low_confidence", "model_disagreement", "validation_failure", "missing_required")

# --- file types -------------------------------------------------------------
ALLOWED_MIME_TYPES = ("application/pdf", "image/jpeg", "image/png", "image/tiff", "image/webp")
MAGIC_HEX = (
    ("25504446", "application/pdf"),
    ("FFD8FF", "image/jpeg"),
    ("89504E470D0A1A0A", "image/png"),
    ("49492A00", "image/tiff"),
    ("4D4D002A", "image/tiff"),
)
RIFF_HEX, WEBP_HEX = "52494646", "57454250"
MIME_BY_SUFFIX = {
    ".pdf": "application/pdf",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".tiff": "image/tiff",
    ".tif": "image/tiff",
    ".webp": "image/webp",
}

# --- patterns and words -----------------------------------------------------
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
CURRENCY_SYMBOLS = "[£$€¥₹]"
CURRENCY_CODE = r"\b[A-Z]{3}\b"
PAYMENT_WORDS = ("paid", "balance due", "balance", "partial", "deposit")

# --- record sections ---------------------------------------------------------
TOP_LEVEL = (
    "po_number", "po_date", "due_date", "required_by", "payment_terms", "payment_method",
    "delivery_terms", "currency", "authorized_by", "special_instructions", "ship_to",
    "document_language", "notes",
)
VENDOR = ("name", "address", "city", "country", "email", "phone", "tax_id", "bank_account")
BUYER = ("name", "address", "department", "contact_person", "email")
TOTALS = ("subtotal", "tax_amount", "shipping", "discount", "grand_total", "currency")
LINE_ITEM = (
    "line_number", "description", "part_number", "quantity", "unit", "unit_price",
    "currency", "line_total", "tax_rate", "notes",
)
REQUIRED_FIELDS = {"po_number": "PO Number", "vendor.name": "Vendor Name"}
EXPECTED_FIELDS = {"po_date": "PO Date", "totals.grand_total": "Grand Total"}
