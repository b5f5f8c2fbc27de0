"""Values that results depend on: word lists, limits and status names."""

# --- fixed values -------------------------------------------------------------------------
# Category keywords in match order; matching is by substring of the lowered text.
CATEGORY_KEYWORDS = [
    ("Rượu", ["ruou", "rượu", "vodka", "whisky", "whiskey", "wine", "soju", "cognac", "rum", "gin", "tequila", "brandy", "liqueur"]),
    ("Bia", ["bia", "beer", "lager", "ale", "stout"]),
    ("Thuốc lá", ["thuoc la", "thuốc lá", "cigarette", "cigar", "tobacco"]),
    ("Sữa", ["sua", "sữa", "milk", "vinamilk", "th true milk", "moc chau milk", "dutch lady"]),
]
DEFAULT_CATEGORY = "Khác"

# Source group keywords in match order.
SOURCE_GROUP_KEYWORDS = [
    ("Rượu bia", ["ruou", "rượu", "bia", "vang"]),
    ("Thuốc lá", ["thuoc la", "thuốc lá", "xì gà", "cigar", "cigarette"]),
    ("Sữa", ["sua", "sữa"]),
]
DEFAULT_SOURCE_GROUP = "Khác"

CONTACT_WORDS = ["liên hệ", "lien he", "call", "contact"]
SOLD_OUT_WORDS = ["hết hàng", "sold out", "out of stock", "tạm hết"]
IN_STOCK_WORDS = ["còn hàng", "in stock"]
GENERIC_NAMES = ["sản phẩm", "san pham", "menu", "trang chủ", "home", "breadcrumb"]
GENERIC_SYNTHETIC_NAMES = ["sản phẩm", "san pham", "product"]
NAME_NOISE_WORDS = [
    "ruou", "bia", "sua", "thuoc", "la", "chai", "lon", "hop", "qua", "gift", "box",
    "chinh", "hang", "nhap", "khau", "cao", "cap", "khuyen", "mai", "sale", "new",
]

# Aliases under which a record may carry a value, first non-empty wins.
NAME_ALIASES = ["product_name", "name", "title"]
PRICE_ALIASES = ["price", "price_numeric", "sale_price"]
OLD_PRICE_ALIASES = ["old_price", "original_price", "list_price"]
URL_ALIASES = ["product_url", "url", "href"]
IMAGE_ALIASES = ["image_url", "image", "thumbnail"]
STORE_NAME_ALIASES = ["store_name", "branch_name", "name"]
STORE_ADDRESS_ALIASES = ["store_address", "address"]
STORE_PHONE_ALIASES = ["store_phone", "phone"]
STORE_URL_ALIASES = ["store_url", "url", "href"]
SYNTHETIC_ALIASES = {
    "name": ["name", "product_name", "ten_san_pham", "tên sản phẩm", "san_pham", "sản phẩm"],
    "price": ["price", "price_numeric", "gia", "giá"],
    "currency": ["currency", "don_vi_tien", "đơn vị tiền"],
    "category": ["category", "loai_san_pham", "loại sản phẩm", "danh_muc", "danh mục"],
    "brand": ["brand", "thuong_hieu", "thương hiệu"],
    "store_name": ["store_name", "kenh_ban", "kênh bán", "cua_hang", "cửa hàng"],
    "store_address": ["store_address", "address", "dia_chi", "địa chỉ"],
    "store_url": ["store_url"],
    "url": ["url", "source", "nguon", "nguồn"],
    "rating": ["rating", "danh_gia", "đánh giá"],
    "source": ["source", "nguon", "nguồn"],
}

# URL words that decide a page's class.
STORE_PATH_WORDS = ["/store-locator", "/stores", "/store", "/branches", "/he-thong-cua-hang", "/cua-hang"]
LISTING_PATH_WORDS = ["/category/", "/collection/", "/collections/", "/danh-muc/", "/search", "/brand/"]
PRODUCT_PATH_WORDS = ["/product/", "/san-pham/"]
STORE_TYPE_WORDS = ["store_listing", "store_detail", "store", "branch"]
LISTING_TYPE_WORDS = ["listing", "category", "collection", "search"]
DETAIL_TYPE_WORDS = ["detail", "product_detail"]
DISCOVERY_WORDS = [
    "product", "products", "category", "collection", "collections", "san-pham", "danh-muc",
    "ruou", "vang", "bia", "whisky", "wine",
]
SCRIPT_RENDER_MARKS = [
    "__next_data__", "__nuxt__", "window.__apollo_state__", "data-reactroot", "hydrate",
    "window.__initial_state__",
]

PHONE_PATTERN = r"(?:\+?84|0|18|19)(?:[\s.\-]?\d){6,10}"
PRICE_TEXT_PATTERN = r"(?i)(?:\d[\d\s.,]{1,14})\s*(?:đ|₫|vnd|vnđ|usd|\$)(?=\s|$)"

# Unit price limits per category (VND).
PRICE_LIMITS = {
    "Sữa": (3_000, 2_500_000),
    "Bia": (8_000, 5_000_000),
    "Rượu": (20_000, 500_000_000),
    "Thuốc lá": (10_000, 10_000_000),
    "Khác": (100, 10_000_000_000),
}

# Rule contract and acceptance.
REQUIRED_FIELDS = {
    "listing": ["price", "product_name", "product_url"],
    "product_detail": ["price", "product_name"],
}
RECOMMENDED_FIELDS = {
    "listing": ["brand", "price", "product_name", "product_url"],
    "product_detail": ["brand", "price", "product_name", "product_url"],
    "stores": ["store_address", "store_name", "store_phone", "store_url"],
}
STORE_FIELDS = ["store_address", "store_name", "store_phone", "store_url"]
OPTIONAL_FIELDS = ["brand", "store_address", "store_name", "store_phone", "store_url"]
MIN_SAMPLES = {"listing": 2, "product_detail": 3, "stores": 1}
MIN_ACCEPT_SCORE = 0.72
EVIDENCE_VERSION = "gemini-evidence-v2"
FIELD_TRANSFORMS = [
    "text_content",
    "clean_price",
    "extract_percentage",
    "extract_volume_ml",
    "check_for_sold_out_indicator",
    "extract_rating_from_html_attributes_or_classes",
    "extract_review_count_from_html_attributes_or_classes",
]

# Selectors that mark product blocks on a page.
CAPTURE_PRODUCT_BLOCKS = (
    "[itemtype*='Product'], [data-product-id], [data-product], "
    ".product-item, .product_item, .product-card, .product_card"
)
EVIDENCE_PRODUCT_BLOCKS = [
    "[itemtype*='schema.org/Product']",
    "[itemtype*='Product']",
    "[data-product-id]",
    "[data-product]",
    ".product-item",
    ".product_item",
    ".product-card",
    ".product_card",
    ".product",
    ".item",
]
EVIDENCE_METADATA = (
    "script[type='application/ld+json'], meta[name], meta[property], link[rel='canonical'], "
    "address, [itemprop='brand'], [itemprop='address'], [itemprop='telephone'], "
    "a[href^='tel:'], footer"
)

# Rules for pages of a domain that has none: (target, item selector, fields), each field
# (name, selector, attr, transform, required).
_PRICE_SELECTOR = ".listed_price, .price, .product-price, .sale-price, [class*='price']"
_OLD_PRICE_SELECTOR = ".old-price, .compare-price, del, [class*='old']"
GENERIC_RULES = [
    ("listing",
     ".product_inner, .product, .product-item, .item-product, .product-box, .pro-item, .item_product",
     [
         ("product_name", ".text_widget h3 a, .text_widget h3, .name, .title, .product-name, h3, h2", None, None, True),
         ("price", _PRICE_SELECTOR, None, "clean_price", False),
         ("old_price", _OLD_PRICE_SELECTOR, None, "clean_price", False),
         ("product_url", "a", "href", None, False),
         ("image_url", "img[data-src], img", "data-src", None, False),
     ]),
    ("product_detail", None,
     [
         ("product_name", "h1, .product-title, .product-name", None, None, True),
         ("price", _PRICE_SELECTOR, None, "clean_price", False),
         ("old_price", _OLD_PRICE_SELECTOR, None, "clean_price", False),
     ]),
    ("stores",
     ".store, .branch, .location, [class*='store'], [class*='branch']",
     [
         ("store_name", ".name, .title, h3, h2, strong", None, None, True),
         ("store_address", ".address, [class*='address']", None, None, False),
         ("store_phone", ".phone, [href^='tel:'], [class*='phone']", None, None, False),
         ("store_url", "a", "href", None, False),
     ]),
]

# Columns of the CSV files.
SOURCE_CSV_COLUMNS = [
    "name", "url", "type", "category", "note",
    "store_channel", "store_scope", "store_name", "store_address",
    "store_phone", "store_url", "store_locator_url",
]
SOURCE_CSV_REQUIRED = ["name", "url", "type", "category"]
PRODUCT_CSV_COLUMNS = [
    "name", "price", "original_price", "currency", "price_status", "source", "category", "brand",
    "store_name", "store_url", "store_address", "store_channel", "address_status", "store_phone",
    "data_origin", "rule_version", "extraction_method", "validation_score",
    "canonical_product_id", "canonical_key", "canonical_match_score", "url", "updated_at",
]
# --- end of fixed values ------------------------------------------------------------------
