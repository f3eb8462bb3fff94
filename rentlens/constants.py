"""Fixed values that must equal the reference application for identical results.

Everything in this module is data, stated in the order the reference states it:
category lists (their position is the ordinal code), per-city constants, factor
weights, level thresholds and the message templates shown to users.
"""

# --- fixed values: category lists (index = ordinal code; unknown = len(list)) ---
CITIES = ["Mumbai", "Delhi", "Bangalore", "Chennai", "Hyderabad", "Kolkata"]
FURNISH = ["Furnished", "Semi-Furnished", "Unfurnished"]
AREA_TYPES = ["Super Area", "Carpet Area", "Built Area"]
TENANTS = ["Bachelors/Family", "Bachelors", "Family"]

# --- fixed values: fallback city medians used by scoring and insights ---
CITY_MEDIANS = {
    "Mumbai": 76500, "Delhi": 46500, "Bangalore": 45000,
    "Chennai": 25000, "Hyderabad": 26000, "Kolkata": 15000,
}
PREDICT_FALLBACK_MEDIAN = 25000
INSIGHT_FALLBACK_MEDIAN = 35000

# --- fixed values: city constants for the risk factors ---
CITY_INCOME = {
    "Mumbai": 85000, "Delhi": 72000, "Bangalore": 78000,
    "Chennai": 58000, "Hyderabad": 60000, "Kolkata": 45000,
}
CITY_APPRECIATION = {
    "Mumbai": 8.2, "Delhi": 6.8, "Bangalore": 9.1,
    "Chennai": 5.4, "Hyderabad": 7.6, "Kolkata": 4.2,
}
CITY_SUPPLY = {
    "Mumbai": 0.82, "Delhi": 0.70, "Bangalore": 0.75,
    "Chennai": 0.55, "Hyderabad": 0.60, "Kolkata": 0.45,
}
DEFAULT_INCOME = 60000
DEFAULT_APPRECIATION = 6.0
DEFAULT_SUPPLY = 0.55

# --- fixed values: factor names, labels, weights (factor order matters) ---
FACTORS = [
    ("price_anomaly", "Price Anomaly", 0.30),
    ("supply_pressure", "Supply Pressure", 0.20),
    ("affordability", "Affordability", 0.25),
    ("property", "Property Signals", 0.15),
    ("market_velocity", "Market Velocity", 0.10),
]

# --- fixed values: levels, highest threshold first ---
LEVELS = [
    (80, "Critical", "#dc2626", "🔴"),
    (60, "High", "#f59e0b", "🟠"),
    (35, "Medium", "#3b82f6", "🔵"),
    (0, "Low", "#16a34a", "🟢"),
]

# --- fixed values: factor descriptions ---
FACTOR_DESCRIPTIONS = {
    "price_anomaly": "Measures how far the predicted rent deviates from city and segment benchmarks.",
    "supply_pressure": "Estimates tenant competition intensity based on city supply dynamics and furnishing demand.",
    "affordability": "Measures rent affordability stress using RBI income benchmarks (healthy threshold: < 30% of income).",
    "property": "Structural property signals: size efficiency, floor position, bathroom ratio, and furnishing wear.",
    "market_velocity": "Forward-looking risk based on city rental appreciation trajectory (5-yr CAGR, Anarock 2024).",
}

# --- fixed values: per-factor action when the factor scores >= 60 ({city} filled in) ---
FACTOR_ACTIONS = {
    "price_anomaly": "Negotiate rent or verify comparables — price is an outlier in this segment",
    "supply_pressure": "Act quickly — limited supply means high tenant competition in this market",
    "affordability": "Review budget: rent exceeds RBI's recommended income-to-rent threshold",
    "property": "Inspect property thoroughly — structural signals suggest potential issues",
    "market_velocity": "Lock in a long-term lease — {city} rents are appreciating rapidly",
}
DEFAULT_ACTIONS = [
    "Standard due diligence applies — risk profile is within normal range",
    "Compare with 2-3 similar listings before committing",
]

# --- fixed values: summary sentence per level ({city}, {top} = lower-cased top factor label) ---
SUMMARY_TEMPLATES = {
    "Critical": "Critical risk in {city} — driven by {top}. Immediate review recommended.",
    "High": "Elevated risk in {city}. Primary driver: {top}. Proceed with caution.",
    "Medium": "Moderate risk profile for this {city} listing. Watch {top}.",
    "Low": "Favourable risk profile. This {city} listing shows healthy market signals.",
}

# --- fixed values: feature names and their display labels ---
FEATURE_NAMES = [
    "city_enc", "bhk", "size", "bathroom",
    "furnishing_enc", "floor_ratio", "size_per_bhk",
    "bath_per_bhk", "area_type_enc", "tenant_enc",
    "log_size", "bhk_bath_interaction",
]
FEATURE_LABELS = {
    "city_enc": "City location",
    "bhk": "Number of bedrooms",
    "size": "Property area (sqft)",
    "bathroom": "Number of bathrooms",
    "furnishing_enc": "Furnishing level",
    "floor_ratio": "Floor height ratio",
    "size_per_bhk": "Space per bedroom",
    "bath_per_bhk": "Bathrooms per bedroom",
    "area_type_enc": "Area measurement type",
    "tenant_enc": "Tenant preference",
    "log_size": "Log-scaled area",
    "bhk_bath_interaction": "BHK × Bathroom index",
}

# --- fixed values: insight templates ---
INSIGHTS = {
    "high_price_per_sqft": "This property commands a premium price per sqft — likely due to {city} demand and {furnishing} furnishing.",
    "low_price_per_sqft": "Competitive pricing relative to {city} average — good value signal for tenants.",
    "high_floor": "Higher floor placement typically adds 3-8% to rental premiums in Indian metros.",
    "premium_city": "{city} ranks as one of India's most expensive rental markets, driving above-median estimates.",
    "furnished_premium": "Fully furnished units command a 15-25% rent premium vs unfurnished equivalents.",
    "large_unit": "Large unit size ({size} sqft) is the dominant rent driver — size_per_bhk ratio elevated.",
    "high_risk": "High demand risk ({risk_pct}% confidence): supply constrained, rents likely to appreciate.",
    "low_risk": "Low demand risk signal — market appears well-supplied in this segment.",
    "ensemble_agreement": "GBT and deep learning models agree within ₹{diff:,.0f} — high confidence estimate.",
    "ensemble_diverge": "Models diverge by ₹{diff:,.0f} — uncertainty is higher; treat range as wider.",
}
PREMIUM_CITIES = ["Mumbai", "Bangalore", "Delhi"]

# --- fixed values: cleaning and labelling thresholds ---
PSF_MIN, PSF_MAX = 2.0, 500.0
DEMAND_FIXED_PSF = 40.0
DEMAND_QUANTILE = 0.60
CHART_RENT_CAP = 150000

# --- fixed values: permission bits and role masks ---
PERM_BITS = [
    ("VIEW_PREDICTIONS", 1),
    ("COMPARE_LISTINGS", 2),
    ("VIEW_ALL_DATA", 4),
    ("RUN_MODELS", 8),
    ("MANAGE_USERS", 16),
    ("EXPORT_DATA", 32),
    ("ADMIN_DASHBOARD", 128),
    ("CREATE_LEADS", 256),
]
ROLE_MASKS = {
    "SUPER_ADMIN": 1023,
    "ADMIN": 4 | 8 | 16 | 32 | 128,
    "ANALYST": 4 | 8 | 32 | 1 | 2,
    "AGENT": 1 | 2 | 256,
    "TENANT": 1,
}
ADMIN_ROLES = ["SUPER_ADMIN", "ADMIN"]
SELF_REGISTER_ROLES = ["TENANT", "AGENT"]

# --- fixed values: account validation patterns and messages (first failing rule wins) ---
USERNAME_RE = r"^\w+$"
EMAIL_RE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
PASSWORD_RE = r"^(?=.*[A-Z])(?=.*[a-z])(?=.*\d)(?=.*[!@#$%^&*]).{8,}$"
MSG_USERNAME_SHORT = "Username must be at least 3 characters."
MSG_USERNAME_CHARS = "Username may only contain letters, digits and underscores."
MSG_NAME_MISSING = "Full name is required."
MSG_EMAIL = "Please enter a valid email address."
MSG_PASSWORD = ("Password must be at least 8 characters and contain an uppercase letter, "
                "a lowercase letter, a digit, and a special character (!@#$%^&*).")
MSG_ROLE = "Role '{role}' is not available for self-registration."
MSG_USERNAME_TAKEN = "Username already taken. Please choose another."
MSG_EMAIL_TAKEN = "An account with this email already exists."

# --- fixed values: login limits ---
MAX_LOGIN_ATTEMPTS = 5
LOCK_SECONDS = 900
BUCKET_CAPACITY = 10.0
BUCKET_RATE = 0.5
BUCKET_COST = 2.0

# --- fixed values: choices, columns and display names of the listing pages ---
DEFAULT_FACETS = {
    "cities": list(CITIES),
    "furnishing": ["Semi-Furnished", "Furnished", "Unfurnished"],
    "bhk": [1, 2, 3, 4],
    "rent_range": (5000, 150000),
}

DISPLAY_COLUMNS = ["city", "bhk", "size", "bathroom", "rent", "furnishing", "locality",
                   "price_per_sqft", "floor_txt"]

DISPLAY_NAMES = {
    "city": "City", "avg_rent": "Avg Rent (₹)", "median_rent": "Median Rent (₹)",
    "min_rent": "Min Rent (₹)", "max_rent": "Max Rent (₹)", "avg_psf": "Avg PSF (₹)",
    "n_listings": "Listings",
}

# --- fixed values: pages by permission, and the admin roles' pages ---
NAV_PAGES = [("Predictor", "VIEW_PREDICTIONS"), ("Similar", "COMPARE_LISTINGS"), ("Analytics", "VIEW_ALL_DATA"),
             ("Spark", "VIEW_ALL_DATA"), ("Models", "RUN_MODELS")]
ADMIN_PAGES = ["Admin", "Spark", "Models"]

# --- fixed values: defaults for a missing listing column ---
DEFAULTS = {"floor_txt": "1 out of 3", "size": 800, "bhk": 2, "bathroom": 2,
            "city": "", "furnishing": "", "area_type": "", "tenant": ""}

# --- fixed values: hyper-parameters of the tree models ---
REG_PARAMS = dict(maxIter=100, maxDepth=5, stepSize=0.05, subsamplingRate=0.8, minInstancesPerNode=8)
CLF_PARAMS = dict(maxIter=80, maxDepth=4, stepSize=0.06, subsamplingRate=0.8)
