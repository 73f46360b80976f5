"""Fixed values of the strategy and of its stored vocabulary."""

# Windows and thresholds.
MOMENTUM_WINDOW = 252
MIN_HISTORY = 260
BACKTEST_WARMUP = 302
ATR_WINDOW = 14
VOLUME_WINDOW = 20
OBV_SLOPE_WINDOW = 10
BREAKOUT_WINDOW = 50
STRENGTH_WINDOW = 50
COOLDOWN_BARS = 5
RVOL_THRESHOLD = 1.5
STALE_BAR_DAYS = 5
EPSILON = 1e-9
ANALYSIS_MIN_ROWS = 50
LOOKBACK_DAYS = 220
SAVE_DAYS = 5
LABEL_HORIZON = 10
LABEL_GAIN = 1.05

# Score weights.
SCORE_WEIGHTS = {"mom_r2": 0.50, "rvol": 0.25, "obv_slope": 0.25}

# Adaptive trailing-stop factor.
K_MIN = 2.0
K_MAX = 4.0
K_SLOPE = 0.5
K_FALLBACK = 3.0
K_SWEEP = (2.0, 2.5, 3.0, 3.5, 4.0)

# Portfolio simulation.
CAPITAL = 50_000.0
MIN_INVESTMENT = 100.0
DEFAULT_MAX_POSITIONS = 10

# Countries served by European sector funds.
EU_COUNTRIES = (
    "Belgium", "France", "Germany", "Netherlands", "Italy", "Spain",
    "Switzerland", "Sweden", "Denmark", "Finland", "Norway", "Austria",
    "Portugal", "Ireland", "Luxembourg", "United Kingdom",
)

# Quote currency by ticker suffix.
SUFFIX_CURRENCY = {".KS": "KRW", ".KQ": "KRW", ".SW": "CHF", ".ST": "SEK"}

# Macro index of each zone.
ZONE_INDEX = {"US": "^GSPC", "EU": "^STOXX", "KR": "^KS11"}

# Stored vocabulary.
OPEN, CLOSED = "OUVERT", "FERMÉ"
SOURCES = ("ranking", "manuel")
SELL_REASONS = (
    "TRAILING_STOP", "TREND_BROKEN", "MOMENTUM_LOST", "SECTOR_WEAK", "MACRO_BEARISH", "MANUEL",
)
RANKING_CONVICTIONS = ("FORT", "MODÉRÉ", "FAIBLE")
POSITION_CONVICTIONS = ("GARDER", "RENFORCER", "VENDRE")
HORIZON_DAYS = {"1w": 7, "2w": 14, "4w": 28}

# Stored status and notes of a parsed batch of opinions.
BATCH_FAILED, BATCH_DONE = "ERREUR", "TERMINÉ"
NOTE_NONE = ("parse: 0/", " section exploitable")
NOTE_PARTIAL = ("partiel : ", "/", " — manquants : ")

# Seed list of sector funds (ticker, name, sector, zone, index).
SEED_SECTOR_ETFS = (
    ("XLK", "Technology Select Sector SPDR", "Technology", "US", "^GSPC"),
    ("XLF", "Financial Select Sector SPDR", "Financial Services", "US", "^GSPC"),
    ("XLV", "Health Care Select Sector SPDR", "Healthcare", "US", "^GSPC"),
    ("XLI", "Industrial Select Sector SPDR", "Industrials", "US", "^GSPC"),
    ("XLE", "Energy Select Sector SPDR", "Energy", "US", "^GSPC"),
    ("XLY", "Consumer Discretionary Select Sector SPDR", "Consumer Cyclical", "US", "^GSPC"),
    ("XLP", "Consumer Staples Select Sector SPDR", "Consumer Defensive", "US", "^GSPC"),
    ("XLC", "Communication Services Select Sector SPDR", "Communication Services", "US", "^GSPC"),
    ("XLB", "Materials Select Sector SPDR", "Basic Materials", "US", "^GSPC"),
    ("XLRE", "Real Estate Select Sector SPDR", "Real Estate", "US", "^GSPC"),
    ("XLU", "Utilities Select Sector SPDR", "Utilities", "US", "^GSPC"),
    ("TNOW.DE", "iShares STOXX Europe 600 Technology", "Technology", "EU", "^STOXX"),
    ("EXV1.DE", "iShares STOXX Europe 600 Banks", "Financial Services", "EU", "^STOXX"),
    ("EXV4.DE", "iShares STOXX Europe 600 Health Care", "Healthcare", "EU", "^STOXX"),
    ("EXV2.DE", "iShares STOXX Europe 600 Industrial G&S", "Industrials", "EU", "^STOXX"),
    ("EXV6.DE", "iShares STOXX Europe 600 Oil & Gas", "Energy", "EU", "^STOXX"),
    ("EXH2.DE", "iShares STOXX Europe 600 Retail", "Consumer Cyclical", "EU", "^STOXX"),
    ("EXH1.DE", "iShares STOXX Europe 600 Food & Beverage", "Consumer Defensive", "EU", "^STOXX"),
    ("EXV3.DE", "iShares STOXX Europe 600 Telecom", "Communication Services", "EU", "^STOXX"),
    ("EXV5.DE", "iShares STOXX Europe 600 Basic Resources", "Basic Materials", "EU", "^STOXX"),
    ("EXI6.DE", "iShares STOXX Europe 600 Real Estate", "Real Estate", "EU", "^STOXX"),
    ("EXV7.DE", "iShares STOXX Europe 600 Utilities", "Utilities", "EU", "^STOXX"),
    ("EXH4.DE", "iShares STOXX Europe 600 Insurance", "Financial Services", "EU", "^STOXX"),
    ("EXH6.DE", "iShares STOXX Europe 600 Pharma & Biotech", "Healthcare", "EU", "^STOXX"),
    ("EWK", "iShares MSCI Belgium ETF (contexte macro BE)", "ALL", "BE", "^BFX"),
)
