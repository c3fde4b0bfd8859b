"""Thresholds of the sourcing rules, and values that are fixed by the marketplaces the data comes from."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values.
#: (least price, sold, reviews, rating): the bar of a product by its price, dearest first; below all, the flags.
PRICE_BARS = ((200, 0, 20, 4.5), (100, 0, 30, 4.5))
#: (least rating, factor on the reviews needed, least need), best first; below all, the last factor.
RATING_NEEDS = ((4.8, 0.8, 15), (4.5, 1.0, 0))
LOW_RATING_FACTOR = 1.5
COST_BANDS = ((0, 15), (15, 25), (25, 50), (50, 80), (80, 110), (110, 150), (150, 300), (300, 1e9))
SHOP_BANDS = ((0, 15, "<$15"), (15, 25, "$15-25"), (25, 50, "$25-50"), (50, 100, "$50-100"), (100, 200, "$100-200"), (200, 300, "$200-300"), (300, 1e9, ">$300"))
TITLE_TAGS = ("[READY STOCK]", "[NEW IN]", "[VALUE BUY]", "[LAST FEW]", "[MUST HAVE]", "[SELLING FAST]", "[CUSTOMER FAV]", "[FAST DISPATCH]", "[EXCLUSIVE]", "[TOP RATED]")
COLOUR_WORDS = ("l?navy", "n?gr[ae]y", "blue", "turquoise", "teal", "black", "white", "beige", "brown", "green", "pink", "red", "cream", "oak", "walnut", "purple", "yellow", "orange", "silver", "gold")
BANNED_TITLE_WORDS = ("shopee", "carousell", "lazada", "amazon", "sg seller", "local seller", "free shipping", "brand new", "cheap", "best ")
#: Locations abroad (the second with Malaysia counted as abroad), near ones, titles and shops that claim the city.
OVERSEAS = ("china|mainland|indon|tailand|thai|vietnam|viet", "china|mainland|malay|malás|indon|tailand|thai|vietnam|viet")
NEAR = ("^sg$|singapore|malay|malás", "^sg$|singapore")
SG_TITLE = ("sg", "hdb", "bto")
SG_TITLE_PARTS = ("singapore", "local stock", "ready stock", "sg stock")
DELIVERY = "🚚 Free Doorstep Delivery"
PAYMENT = "💳 PayNow / PayLah / Bank Transfer / Credit & Debit Card / Carousell Buy Button accepted 🙂"
OPENING = "\nBrand new and unused, delivered straight to your door."
OPTIONS = "\n📦 Options available: "
CLOSING = ("\n💬 Message us to order or check stock", "\n🛡️ Pay with the Buy button and Carousell protects you — refunded if the item is not as described.")
SIZES_LINE = r"(?i)^📦\s*(Sizes|Finishes|Colours|Colors)\s+available"
DIMENSIONS = r"(?i)\d+\s*[x*×]\s*\d+(?:\s*[x*×]\s*\d+)?\s*(?:cm|mm)?"
#: Segments of a title, at least and at most, and its characters at most.
SEGMENTS, TITLE_LENGTH = (8, 10), 225
LEASE_HOURS, RETENTION_DAYS, LEAD_TIME_DAYS = 4, 30, 14


@dataclass(frozen=True)
class Flags:
    """What a run of the sourcing cascade may set."""

    min_sold: int = 100
    min_reviews: int = 50
    min_rating: float = 3.8
    min_price: float = 0
    max_price: float = 1e9
    trust_shops: bool = True
    trust_reviews: int = 0
    near_abroad: bool = False
    scale_by_price: bool = True
    local_only: bool = True
