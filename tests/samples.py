"""A small dictionary for tests."""

from vitrine.functions.lexicon import Lexicon

BRANDS = (
    ("مک", "BRAND_MAC"), ("MAC", "BRAND_MAC"), ("هلو کیتی", "BRAND_HELLO_KITTY"), ("HELLO KITTY", "BRAND_HELLO_KITTY"), ("HELLO", "BRAND_HELLO"),
    ("بورژوا", "BRAND_BOURJOIS"), ("بورژوآ", "BRAND_BOURJOIS"), ("لورال", "BRAND_LOREAL"), ("اسنس", "BRAND_ESSENCE"), ("فلورمار", "BRAND_FLORMAR"),
    ("FLORMAR", "BRAND_FLORMAR"), ("بیک", "BRAND_BIC"), ("هات لاو", "BRAND_HOT_LOVE"), ("VICTORIA SECRET", "BRAND_VICTORIA_SECRET"), ("21", "BRAND_21"), ("لانیژ", "BRAND_LANIEGE"), ("لانیژ", "BRAND_LANEIGE"),
    ("DR. MARTIN", "BRAND_DR_MARTIN"), ("ONE TWO THREE FOUR", "BRAND_FOUR_WORDS"), ("THREE WORD NAME", "BRAND_THREE_WORDS"), ("ژیلت", "BRAND_GILLETTE"),
)
TYPES = ("کرم پودر", "پودر", "شامپو", "ریمل", "سرم", "پنکک", "کانسیلر", "ادو پرفیوم", "عطر", "ژیلت")
LEXICON = Lexicon(BRANDS, TYPES)
