"""Thresholds and fixed values of the bundle recommender.

The fixed values below must equal the original application's settings for
results to agree; they are stated together, in their natural order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must match the original application's settings)
# ---------------------------------------------------------------------------
MIN_SUPPORT = 0.001
MIN_CONFIDENCE = 0.50
MIN_LIFT = 1.0
MAX_ITEMSET_FREQ = 2000
TOP_ITEMS_PER_CUSTOMER = 10
NEIGHBOURS_PER_ITEM = 2
FALLBACK_ITEMS_PER_CUSTOMER = 2
RATING_CAP = 10.0
TRAILING_MONTHS = 12
INTERACTION_DIGITS = 5
SIMILARITY_DIGITS = 3

# Customer division code -> customer area name.
AREA_LABELS = {
    "AU": "Auto",
    "WO": "Wood",
    "ME": "Metal",
    "CO": "Construction",
    "CA": "Cargo",
    "CP": "ConstrSite project",
    "EL": "House Engineering",
    "MA": "Engineering workshop (Betriebswerkstatt)",
}
CUSTOMER_AREAS = [
    "Auto", "Construction", "Cargo", "House Engineering", "Metal", "Wood",
    "ConstrSite project", "Engineering workshop (Betriebswerkstatt)",
]
# Sales regions '000000000011'..'000000000018' are labelled 'Region-11'..'Region-18'.
REGION_CODE_LOW = "000000000011"
REGION_CODE_HIGH = "000000000018"
REGION_CODE_WIDTH = 12
# Non-bundlable product families per area.
EXCLUDED_FAMILIES = {"Metal": ["35111102", "35111122"]}
# Active-customer and active-product predicates.
CUSTOMER_ACCOUNT_GROUP = "DEBI"
ACTIVE_FLAG = "X"
CUSTOMER_STATUS_ACTIVE = 4
SALES_CHANNEL = "RV"
PRODUCT_STATUS_ACTIVE = 5
PRODUCT_IN_ESHOP = "true"
PRODUCT_PARTITION = "ACTUAL"
# Implicit ALS.
ALS_RANK = 70
ALS_MAX_ITER = 50
ALS_REG = 0.15
ALS_ALPHA = 1.0
ALS_TOP_K = 50
ALS_AREA = "Metal"
ALS_TRAIN_FRACTION = 0.7
# Neural factorisation (re-aimed as a factorisation machine).
NCF_FACTORS = 32
NCF_TRAIN_FRACTION = 0.8
NCF_MIN_MONTHS = 5
NCF_MIN_ITEMS = 5
SEED = 123
# Bundle description sentence.
DESCRIPTION_TEMPLATE = (
    "As the product(s) {a} is purchased often, we are suggesting these "
    "products {b} which forms the bundle {c}"
)
LABEL_WIDTH = 10


@dataclass(frozen=True)
class BundleConfig:
    """Parameters of one bundle run; defaults are the fixed values above."""

    min_support: float = MIN_SUPPORT
    min_confidence: float = MIN_CONFIDENCE
    min_lift: float = MIN_LIFT
    max_itemset_freq: int | None = None  # F15 is an absolute count: off unless asked for
    top_items: int = TOP_ITEMS_PER_CUSTOMER
    neighbours: int = NEIGHBOURS_PER_ITEM
    fallback_items: int = FALLBACK_ITEMS_PER_CUSTOMER
    rating_cap: float | None = RATING_CAP
    trailing_months: int = TRAILING_MONTHS
    as_of: str | None = None  # ISO date; window ends at the first of its month
    item_col: str = "model_number"
    excluded_families: dict = field(default_factory=lambda: dict(EXCLUDED_FAMILIES))
    use_raw_purchases: bool = False  # cosine on all purchases instead of interaction > 0
