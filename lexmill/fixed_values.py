"""Values that results depend on, kept as plain text in one place."""

# ---------------------------------------------------------------------------
# Changing any entry below changes results.
# ---------------------------------------------------------------------------

# A text equal to this word (any case) counts as missing.
MISSING_WORD = "nan"
# When columns are combined these words (any case) count as missing too.
COMBINE_MISSING_WORDS = ("nan", "none", "<na>")

# Characters replaced by a space, as the inside of a character class.
CONTROL_RANGE = r"\x00-\x1F\x7F-\x9F"
# How a web address begins.
URL_STARTS = ("https?://", r"www\.")
# Punctuation that gets a space when an ASCII letter follows directly.
TIGHT_PUNCTUATION = ".!?,;:"

# News boilerplate.
AD_NOTICE = ("Baca berita dengan sedikit iklan,", "klik di sini")
UI_PHRASES = (
    "bawah melanjutkan",
    "scroll bawah",
    "lanjutkan membaca",
    "baca selengkapnya",
    "klik di sini",
)
# News outlets with the suffix parts each may carry.
OUTLETS = (
    ("KOMPAS", (".com",)),
    ("TEMPO", (".CO",)),
    ("DETIK", (".com",)),
    ("CNNINDONESIA", (".com",)),
    ("TRIBUNNEWS", (".com",)),
    ("LIPUTAN6", (".com",)),
    ("ANTARA", ("NEWS",)),
    ("OKEZONE", (".com",)),
    ("KONTAN", (".co.id",)),
    ("INILAH", (".com",)),
    ("SINDO", ("NEWS", ".com")),
    ("SUARA", (".com",)),
    ("MERDEKA", (".com",)),
    ("IDN", ("TIMES", ".com")),
)
# Marks that end a section or outlet prefix, and marks stripped at the start.
PREFIX_MARKS = "-–—:|•·"
LEADING_MARKS = "-–—:|"
# Length limits of the prefix parts.
SECTION_TAIL = (2, 40)
DATELINE_TAIL = (1, 50)
OUTLET_PLACE_TAIL = (1, 30)
# Passes over a repeated step.
REPEAT_PASSES = 3

# Finance vocabulary.
CRYPTO_CODES = (
    "BTC", "ETH", "USDT", "BNB", "SOL", "XRP", "ADA", "DOGE",
    "DOT", "MATIC", "AVAX", "LINK", "LTC", "BCH", "ATOM", "ICP",
)
CURRENCY_WORDS = ("rp", "idr", "usd", "cad", "eur", "gbp", "aud", "sgd", "jpy", "cny", "hkd")
CURRENCY_DOLLAR_WORDS = ("us$", "ca$")
FX_CODES = ("usd", "us$", "eur", "gbp", "aud", "sgd", "jpy", "cny", "hkd")
IDR_UNITS = ("ribu", "juta", "miliar", "triliun")
FX_UNITS = (
    "[KMBT]", "ribu", "thousand", "juta", "million",
    "miliar", "billion", "triliun", "trillion",
)
PERCENT_WORD = "persen"
BASIS_POINT_WORDS = ("bps", "bp")
CODE_LENGTH = (2, 10)

# Mask tokens.
PAIR_TOKEN = "<PAIR>"
TICKER_TOKEN = "<TICKER>"
CRYPTO_TOKEN = "<CRYPTO>"
PERCENT_TOKEN = "<PCT>"
BASIS_POINT_TOKEN = "<BPS>"
IDR_TOKEN = "<AMT_IDR>"
FX_TOKEN = "<AMT_FX>"
DOLLAR_TOKEN = "<AMT_USD>"
NUMBER_TOKEN = "<NUM>"

# Phone numbers: digits needed, and digits needed for a rewrite.
PHONE_RUN = 7
PHONE_MIN_DIGITS = 8

# TF-IDF defaults.
NGRAM_MAX = 2
MIN_DF = 2
MAX_DF = 0.95
WORD_MAX_FEATURES = 250_000
CHAR_MAX_FEATURES = 150_000
CHAR_NGRAM_RANGE = (3, 5)
CHAR_MIN_DF_FLOOR = 2
CHAR_MAX_DF_SLACK = 0.02
CHAR_MAX_DF_CEILING = 0.98

# Hierarchy and search defaults.
MIN_BUCKET_SIZE = 80
MIN_LABEL_SUPPORT = 10
AGGREGATE_CLUSTERS = 10
UNKNOWN_AGGREGATE = "C999"
DEFAULT_C = 1.0
SEARCH_TRIALS = 25
SEARCH_SECONDS = 600
SEARCH_NGRAM_MAX = (1, 3)
SEARCH_MIN_DF = (1, 5)
SEARCH_MAX_DF = (0.85, 0.99)
SEARCH_WORD_FEATURES = (80_000, 300_000, 55_000)
SEARCH_CHAR_FEATURES = (60_000, 220_000, 40_000)
SEARCH_C = (0.2, 5.0)
TOP_CONFUSIONS = 20

# Topic selection defaults.
TOPIC_HEAD = 24
TOPIC_MIN_COUNT = 60
TOPIC_TAIL = 11
TOPIC_TERMS = 10
TOPIC_MIN_SIZE = 10
NOISE_TOPIC = -1

# Topic names given by a person to the discovered cluster ids.
TOPIC_NAMES = {
    0: "Demo & Unjuk Rasa",
    1: "Judi Online",
    2: "MBG",
    3: "Kereta Api",
    4: "MBG",
    5: "Kecelakaan Lalu Lintas",
    6: "Haji & Umrah",
    7: "Sepak Bola",
    8: "Kejahatan Finansial",
    9: "Golkar",
    10: "Perang Palestina-Israel",
    11: "Katolik",
    12: "Iklim & Cuaca",
    13: "ESDM",
    14: "Tom Lembong",
    15: "Sepak Bola",
    16: "Kebakaran",
    17: "Penghargaan",
    18: "DPR",
    19: "Partai Politik",
    20: "Partai Politik",
    22: "Kemacetan Lalu Lintas",
    23: "Sepak Bola",
    162: "TNI & Militer",
    163: "Kriminal & Kecelakaan",
    164: "Wisata Kebun Binatang",
    165: "Kemacetan Lalu Lintas",
    166: "Kunjungan Presiden Prancis",
    167: "Pemakzulan Presiden Korsel",
    168: "Menteri Keuangan",
    169: "Kriminal & Kecelakaan",
    170: "Kriminal & Kecelakaan",
    171: "Kejahatan Finansial",
    172: "Jakarta & IKN",
}
