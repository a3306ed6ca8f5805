"""Fixed values of the domain: rates, curves, territories and word lists."""

# ZIP3 anchors: zip3, state, county, latitude, longitude (fixed values).
ANCHORS = [
    ("275", "NC", "Wake", 35.7819, -78.82), ("280", "NC", "Gaston", 35.2492, -81.1856), ("281", "NC", "Union", 34.9889, -80.5497),
    ("282", "NC", "Mecklenburg", 35.2272, -80.8431), ("283", "NC", "Cumberland", 35.085, -78.9772), ("284", "NC", "New Hanover", 34.2257, -77.9447),
    ("285", "NC", "Lenoir", 35.2747, -77.5936), ("286", "NC", "Catawba", 35.7406, -81.3222), ("287", "NC", "Henderson", 35.3247, -82.4572),
    ("289", "NC", "Cherokee", 35.0933, -84.0281), ("320", "FL", "St. Johns", 29.8892, -81.3042), ("330", "FL", "Broward", 26.0303, -80.1564),
    ("331", "FL", "Miami-Dade", 25.7742, -80.1936), ("332", "FL", "Miami-Dade", 25.7742, -80.1936), ("334", "FL", "Palm Beach", 26.7469, -80.1314),
    ("335", "FL", "Hillsborough", 28.0186, -82.1126), ("337", "FL", "Pinellas", 27.8222, -82.6706), ("338", "FL", "Polk", 28.0556, -81.9544),
    ("339", "FL", "Lee", 26.6233, -81.8556), ("341", "FL", "Collier", 26.142, -81.7948), ("342", "FL", "Sarasota", 27.3583, -82.5436),
    ("346", "FL", "Hernando", 28.5106, -82.3886), ("349", "FL", "St. Lucie", 27.4042, -80.3911), ("703", "LA", "Terrebonne", 29.5875, -90.7161),
    ("704", "LA", "St. Tammany", 30.3692, -90.0781), ("705", "LA", "Lafayette", 30.2081, -92.0325), ("706", "LA", "Calcasieu", 30.1972, -93.2367),
    ("707", "LA", "Livingston", 30.4797, -90.9542), ("708", "LA", "East Baton Rouge", 30.4475, -91.1786), ("714", "LA", "Vernon", 31.115, -93.2528),
    ("770", "TX", "Harris", 29.7567, -95.3653), ("774", "TX", "Fort Bend", 29.5994, -95.6142), ("775", "TX", "Harris", 29.6761, -95.1739),
    ("776", "TX", "Jefferson", 29.8683, -93.89), ("777", "TX", "Jefferson", 30.08, -94.1267), ("778", "TX", "Brazos", 30.6744, -96.37),
    ("783", "TX", "Nueces", 27.7428, -97.4019), ("784", "TX", "Nueces", 27.7428, -97.4019),
]

# Premium rates as shares of insured value, and build loadings (fixed values).
HO3_RATE = {"FL": 0.01000, "TX": 0.00894, "LA": 0.00971, "NC": 0.00605}
FLOOD_LOADING = {"X": 0.00086, "A": 0.00207, "AE": 0.00450, "VE": 0.01057}
BUILD_LOADING = {"wood_frame": 1.00, "masonry": 0.85, "manufactured": 1.40}

# Loss prior: base rate, zone severity, build vulnerability, spread (fixed values).
BASE_RATE = 0.0023
ZONE_SEVERITY = {"X": 1.00, "A": 2.40, "AE": 5.23, "VE": 12.29}
BUILD_VULNERABILITY = {"wood_frame": 1.00, "masonry": 0.40, "manufactured": 3.00}
PRIOR_SIGMA, PHI_INV_99 = 0.85, 2.326

# Damage ratio by build type and peril (fixed values).
DAMAGE = {
    "wood_frame": {"tornado": 0.42, "flood": 0.55, "hail": 0.18, "wildfire": 0.92, "earthquake": 0.35, "winter": 0.08},
    "masonry": {"tornado": 0.28, "flood": 0.62, "hail": 0.10, "wildfire": 0.85, "earthquake": 0.22, "winter": 0.06},
    "manufactured": {"tornado": 0.85, "flood": 0.65, "hail": 0.32, "wildfire": 0.95, "earthquake": 0.55, "winter": 0.18},
    "commercial": {"tornado": 0.30, "flood": 0.48, "hail": 0.12, "wildfire": 0.78, "earthquake": 0.28, "winter": 0.05},
}
LEVELS = {
    "tornado": {"ef0": 0.325, "ef1": 0.55, "ef2": 0.775, "ef3": 1.0, "ef4": 1.225, "ef5": 1.45},
    "flood": {"minor": 0.25, "moderate": 0.70, "major": 1.20},
    "wildfire": {"low": 0.10, "moderate": 0.40, "high": 1.00},
    "winter": {"limited": 0.01, "minor": 0.04, "moderate": 0.15, "major": 0.40, "extreme": 1.00},
}
INTENSITY = {"moderate": 0.55, "severe": 1.0, "catastrophic": 1.45}
PERILS = ("tornado", "flood", "hail", "wildfire", "earthquake", "winter")

# Damage curves: (input, ratio) break points (fixed values).
WIND_CURVE = {
    "wood_frame": [(80, 0.00), (110, 0.05), (130, 0.20), (155, 0.55), (180, 0.85)],
    "masonry": [(80, 0.00), (110, 0.02), (130, 0.10), (155, 0.35), (180, 0.65)],
    "manufactured": [(80, 0.00), (95, 0.15), (110, 0.45), (130, 0.80), (155, 0.95)],
}
SURGE_CURVE = [(0.0, 0.00), (0.3, 0.10), (1.0, 0.35), (2.0, 0.65), (4.0, 0.95)]

# Annual loss rates of further perils by state, their spread and build vulnerability (fixed values).
AAL_RATE = {
    "scs": {"TX": 0.00072, "LA": 0.00025, "NC": 0.00020, "FL": 0.00018, "default": 0.00010},
    "winter": {"TX": 0.00025, "LA": 0.00012, "NC": 0.00020, "FL": 0.00002, "default": 0.00008},
    "wildfire": {"TX": 0.00003, "LA": 0.00002, "NC": 0.00002, "FL": 0.00002, "default": 0.00002},
    "earthquake": {"TX": 0.000005, "LA": 0.000005, "NC": 0.000008, "FL": 0.000003, "default": 0.000005},
}
AAL_SIGMA = {"scs": 0.70, "winter": 1.20, "wildfire": 1.00, "earthquake": 1.50}
AAL_VULNERABILITY = {
    "scs": {"wood_frame": 1.00, "masonry": 0.85, "manufactured": 3.00},
    "winter": {"wood_frame": 1.00, "masonry": 1.10, "manufactured": 2.50},
    "wildfire": {"wood_frame": 1.00, "masonry": 0.55, "manufactured": 2.20},
    "earthquake": {"wood_frame": 1.00, "masonry": 2.00, "manufactured": 3.50},
}

# The actions in their order, and what they do to premium, loss and capital (fixed values).
ACTIONS = ("retain", "reprice_n20", "reprice_n10", "reprice_0", "reprice_p5", "reprice_p10", "reprice_p15", "reprice_p20", "non_renew", "cede_qs", "cede_xs")
RATE_CHANGE = {"reprice_n20": -0.20, "reprice_n10": -0.10, "reprice_0": 0.0, "reprice_p5": 0.05, "reprice_p10": 0.10, "reprice_p15": 0.15, "reprice_p20": 0.20}
ELASTICITY = 0.5
CESSION_COST = {"cede_qs": 0.65, "cede_xs": 0.12}
CEDED_SHARE = {"cede_qs": 0.6, "cede_xs": 0.15}
NONRENEW_THRESHOLD = 0.5

# Notice periods in days and territory caps (fixed values).
NOTICE_DAYS = {"FL": 120, "TX": 60, "LA": 30, "NC": 45}
NOTICE_DEFAULT = 60
CAPS = {"FL:coastal": 0.03, "FL:inland": 0.05, "TX:tier_1": 0.04, "TX:tier_2": 0.07, "LA:coastal": 0.04, "LA:inland": 0.06, "NC:coastal": 0.05, "NC:inland": 0.08, "__default__": 0.05}
COASTAL = {
    "FL": ("320", "330", "331", "332", "335", "337", "339", "341", "342", "349"),
    "TX": ("774", "775", "776", "777", "778", "783", "784"),
    "LA": ("703", "704", "706"),
    "NC": ("289",),
}
BUCKET_NAMES = {"FL": ("FL:coastal", "FL:inland"), "TX": ("TX:tier_1", "TX:tier_2"), "LA": ("LA:coastal", "LA:inland"), "NC": ("NC:coastal", "NC:inland")}

ADJUSTER_DOLLARS, ADJUSTER_BASELINE, STAFFED = 250_000, 2, 2
STORM_BUCKETS = [(35, "ts"), (74, "cat1"), (96, "cat2"), (111, "cat3"), (130, "cat4plus")]
KNOTS_TO_MPH = 1.150779448

# Words in column names that stand for personal data, by kind, and words that make them harmless (fixed values).
PII = {
    "name": [
        "name", "firstname", "lastname", "middlename", "surname", "givenname", "fname", "lname", "mname", "fullname", "fn", "ln", "mn", "nm",
    ],
    "address": [
        "address", "addr", "addrs", "street", "st1", "st2", "postal", "postcode", "apt", "unit", "suite", "addressline", "addressline1",
        "addressline2", "mailing", "billing", "shipping",
    ],
    "contact": [
        "phone", "phn", "tel", "telephone", "mobile", "cell", "cellphone", "mob", "fax", "email", "em", "mail", "emailaddress", "emailaddr",
    ],
    "id": [
        "ssn", "sin", "nin", "ein", "itin", "taxid", "tin", "passport", "passportno", "license", "licenseno", "driverslicense", "dl",
        "driverlicense", "nationalid", "governmentid", "govid",
    ],
    "financial": [
        "creditcard", "credit", "cc", "ccnum", "ccnumber", "cardnumber", "bankaccount", "iban", "swift", "routingnumber", "aba", "cvv", "cvc", "pin",
    ],
    "biometric": [
        "fingerprint", "biometric", "iris", "retina", "facial", "photo", "photograph",
    ],
    "age_dob": [
        "dob", "birth", "birthdate", "birthday", "dateofbirth", "dtbirth", "age",
    ],
    "medical": [
        "medical", "health", "diagnosis", "condition", "medication", "prescription", "hipaa",
    ],
}
PII_ALLOWED = [
    "business", "company", "organization", "org", "entity", "product", "policy", "plan", "role", "job", "title", "department", "team", "group",
    "category", "type", "class", "event", "incident", "claim", "station", "storm", "peril", "tag", "code", "segment", "cluster", "cohort", "risk",
    "rate",
]

# Ranges of the perils whose severity is a number (fixed values); the others have LEVELS.
SCALE_RANGE = {"earthquake": (5.0, 9.0), "hail": (10.0, 120.0)}
# Rank of storm classes (fixed values).
STORM_RANK = {"LO": 0, "PT": 1, "DB": 1, "STD": 2, "TD": 2, "STS": 3, "TS": 3, "HU": 4, "MH": 5}
