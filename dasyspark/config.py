"""Constants shared by the operators, and the territory settings as tables.

Everything below the marker is a fixed value: results are only comparable when
these lists and numbers are exactly these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --------------------------------------------------------------------------
# Fixed values
# --------------------------------------------------------------------------

CELL_LEVEL = 7
PARENT_LEVELS = (6, 5)

EARTH_RADIUS_KM = 6371.0
AUTHALIC_RADIUS_M = 6371007.181
WGS84_ECCENTRICITY = 0.0818191908426215

INR_PER_CRORE = 1e7
CRORE_PER_LAKH = 0.01

# Model settings.
SEEDS = (0, 1, 2, 3, 4)
EPOCHS = 50
HIDDEN = 64
LAYERS = 4
RESIDUAL_ALPHA = 0.1
LEARNING_RATE = 1e-2
MIN_LEARNING_RATE = 1e-4
GRADIENT_CLIP = 5.0
FLOOR_WEIGHT = 0.05
FLOOR_TAU = 1.0
LOG_EPS = 1e-6
SCALE_EPS = 1e-9
HOLDOUT_FRACTION = 0.2
MIN_HOLDOUT_UNITS = 5

SHARE_CAP = 1.5
MIN_NONZERO_SHARE = 0.005

FEATURE_NAME_KEYS = ("shapeName", "shapeNAME", "NAME_1", "NAME_2", "name", "shapeISO")
SKIP_TOKENS = ("div.", "includes", "revised", "estimates", "total", "state")
CELL_ID_ALIASES = ("h3", "h3index", "hex_id")
POPULATION_ALIASES = ("population", "pop")

ROAD_CLASSES = (
    "motorway", "trunk", "primary", "secondary", "tertiary",
    "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link",
)
OSM_KEYS = ("highway", "building", "landuse", "amenity", "shop", "tourism", "leisure", "office")
LANDUSE_CLASSES = ("residential", "commercial", "industrial", "retail")

# group -> (tag key, accepted lower-case values; empty = any non-empty value)
POI_GROUPS: dict[str, tuple[str, tuple[str, ...]]] = {
    "amenity_restaurant": ("amenity", ("restaurant",)),
    "amenity_cafe": ("amenity", ("cafe",)),
    "amenity_bar": ("amenity", ("bar",)),
    "amenity_pub": ("amenity", ("pub",)),
    "amenity_cinema": ("amenity", ("cinema",)),
    "amenity_theatre": ("amenity", ("theatre", "theater")),
    "amenity_nightclub": ("amenity", ("nightclub",)),
    "amenity_university": ("amenity", ("university",)),
    "amenity_hospital": ("amenity", ("hospital",)),
    "amenity_bank": ("amenity", ("bank",)),
    "shop_mall": ("shop", ("mall", "department_store")),
    "shop_luxury": ("shop", ("jewelry", "jewellery", "watches", "boutique")),
    "shop_supermarket": ("shop", ("supermarket",)),
    "shop_convenience": ("shop", ("convenience",)),
    "tourism_hotel": ("tourism", ("hotel",)),
    "tourism_guest_house": ("tourism", ("guest_house",)),
    "leisure": ("leisure", ()),
    "office": ("office", ()),
}

MAGNITUDE_COLUMNS = (
    ["population", "night_lights", "road_km", "poi_count", "building_area_m2", "building_count"]
    + [f"poi_{g}" for g in POI_GROUPS]
    + [f"poi_{g}_density" for g in POI_GROUPS]
)
SHARE_COLUMNS = [f"landuse_{c}" for c in LANDUSE_CLASSES] + ["building_share"]

# Short column keys of the packed payload, and their decimals (0 = integer).
SHORT_KEYS = {
    "district": "d", "population": "p", "night_lights": "nl", "road_km": "rd",
    "poi_count": "poi", "building_area_m2": "bldg", "building_count": "bcnt",
    "building_share": "bsh", "area_km2": "ar", "wealth_index": "w",
    "wealth_index_min": "wmin", "wealth_index_max": "wmax",
    "gdp_per_capita_inr": "g", "gdp_per_capita_inr_min": "gmin",
    "gdp_per_capita_inr_max": "gmax", "gdp_crore": "c", "intensity_raw": "sr",
    "gdp_inr_raw": "zr", "dasymetric_scale": "s", "y_crore": "y",
}
KEY_DECIMALS = {
    "p": 1, "nl": 3, "rd": 2, "poi": 0, "bldg": 0, "bcnt": 0, "bsh": 4, "ar": 3,
    "w": 2, "wmin": 2, "wmax": 2, "c": 4, "sr": 6, "zr": 0, "s": 8, "y": 2,
    "g": 0, "gmin": 0, "gmax": 0,
}

# How a cell column collapses to its parent in the overview grid.
ROLLUP_RULES = {
    "district": "first", "population": "sum", "night_lights": "mean", "road_km": "sum",
    "poi_count": "sum", "building_area_m2": "sum", "building_count": "sum",
    "building_share": "mean", "area_km2": "sum", "wealth_index": "mean",
    "wealth_index_min": "min", "wealth_index_max": "max",
    "gdp_per_capita_inr": "median", "gdp_per_capita_inr_min": "min",
    "gdp_per_capita_inr_max": "max", "gdp_crore": "sum", "intensity_raw": "mean",
    "gdp_inr_raw": "sum", "dasymetric_scale": "mean", "y_crore": "first",
}

ALWAYS_OFFERED_METRICS = ("wealth_index", "gdp_per_capita_inr", "population")
BASE_METRICS = (
    ("wealth_index", "Wealth index", "percentile 0–100", "Model output"),
    ("gdp_per_capita_inr", "Allocated GDDP per capita", "₹/person", "Model output"),
    ("gdp_crore", "Allocated cell GDDP", "₹ crore", "Model output"),
    ("intensity_raw", "Economic intensity s_i (pre-scale)", "index", "Model output"),
    ("population", "Population", "people", "Input"),
    ("night_lights", "Night lights", "nW/cm²/sr", "Input"),
    ("road_km", "Road length", "km", "Input"),
    ("poi_count", "OSM POIs (all groups)", "count", "Input"),
    ("building_area_m2", "Building footprint area", "m²", "Input"),
    ("building_count", "Building count", "buildings", "Input"),
    ("building_share", "Built-up share of cell", "share 0–1", "Input"),
)

EXPORT_COLUMNS = (
    "h3_r7", "h3_r6", "h3_r5", "district", "lat", "lon", "area_km2",
    "population", "population_source", "night_lights", "night_lights_source",
    "road_km", "poi_count", "building_area_m2", "building_count", "building_share",
    "intensity_raw", "intensity_raw_min", "intensity_raw_max", "dasymetric_scale",
    "gdp_inr_raw", "gdp_inr", "gdp_crore", "gdp_per_capita_inr",
    "gdp_per_capita_inr_mean", "gdp_per_capita_inr_min", "gdp_per_capita_inr_max",
    "wealth_index", "wealth_index_mean", "wealth_index_min", "wealth_index_max",
    "wealth_quintile", "y_crore", "y_inr", "gddp_year", "price_basis", "gddp_units",
)

# code, name, bbox (minx, miny, maxx, maxy), population range (millions),
# centre (lon, lat), zoom, dissolve to one unit, element zone, skip reason
TERRITORIES = (
    ("MH", "Maharashtra", (72.55, 15.55, 80.95, 22.15), (110.0, 140.0), (76.0, 19.05), 6.15, None, "western-zone", None),
    ("UP", "Uttar Pradesh", (77.05, 23.85, 84.65, 30.45), (199.0, 250.0), (80.9, 26.85), 6.0, None, "central-zone", None),
    ("BR", "Bihar", (83.25, 24.20, 88.55, 27.65), (100.0, 140.0), (85.5, 25.6), 6.4, None, "eastern-zone", None),
    ("DL", "Delhi (NCT)", (76.82, 28.40, 77.35, 28.89), (16.0, 25.0), (77.1, 28.65), 9.4, "Delhi", "northern-zone", None),
    ("RJ", "Rajasthan", (69.45, 23.03, 78.28, 30.20), (68.0, 90.0), (74.2, 26.6), 6.1, None, "northern-zone", None),
    ("WB", "West Bengal", (85.75, 21.45, 89.90, 27.25), (90.0, 115.0), (87.8, 23.8), 6.3, None, "eastern-zone",
     "No free machine-readable official district GDDP found (DES/OpenCity/data.gov.in)."),
    ("KA", "Karnataka", (74.05, 11.50, 78.60, 18.48), (60.0, 80.0), (76.5, 15.0), 6.2, None, "southern-zone", None),
    ("TG", "Telangana", (77.20, 15.70, 81.80, 19.95), (32.0, 45.0), (79.0, 17.9), 6.6, None, "southern-zone", None),
)

# Published-total source: code, kind, fiscal year, units, price basis, base year,
# name field, value field, sheet, row label, value scale, dropped names
TOTAL_SOURCES = (
    ("MH", "ckan_json", "2023-24", "INR crore", "constant", "2011-12", "District",
     "Real GDDP 2023-24 (Constant prices from 2011-12)", None, None, 1.0, ()),
    ("UP", "xlsx_matrix", "2021-22", "INR crore", "constant", "2011-12", "district", "y_crore", "GDDP Constant", "GROSS DISTRICT DOMESTIC PRODUCT", 1.0,
     ("western region", "central region", "bundel khand region", "eastern region", "uttar pradesh")),
    ("BR", "xlsx_table", "2023-24", "INR crore", "current", None, "District", "Nominal GDP in Crore INR", "Sheet1", None, 1.0, ("bihar total", "bihar")),
    ("DL", "gsdp_single", "2023-24", "INR crore", "constant", "2011-12", "district", "y_crore", None, "GSDP at constant", 1.0, ()),
    ("RJ", "pdf_table", "2023-24", "INR crore", "constant", "2011-12", "district", "y_crore", None,
     "Table 3: Gross District Domestic Product of Rajasthan at Constant (2011-12) Prices", 0.01, ("state",)),
    ("WB", "local_csv", "2020-21", "INR crore", "current", "2011-12", "district", "y_crore", None, None, 1.0, ()),
    ("KA", "opencity_csv", "2024-25", "INR crore", "constant", "2011-12", "District",
     "GDDP Constant Prices (Rs. Cr)", None, None, 1.0, ()),
    ("TG", "opencity_csv", "2022-23", "INR crore", "current", None, "District",
     "GDDP (Cr) at Current Prices 2022-23", None, None, 1.0, ()),
)

METROS = (
    ("MH", "Mumbai Metropolitan", ("Mumbai", "Thane", "Raigad", "Palghar")),
    ("UP", "NCR (UP districts)", ("Gautam Buddha Nagar", "Ghaziabad", "Meerut", "Bulandshahr", "Hapur", "Baghpat")),
    ("DL", "Delhi NCT", ("Delhi",)),
    ("RJ", "NCR (RJ districts)", ("Alwar",)),
    ("WB", "Kolkata metro", ("Kolkata", "North 24 Parganas", "South 24 Parganas", "Howrah", "Hooghly")),
    ("KA", "Bengaluru metro", ("Bengaluru Urban", "Bengaluru Rural")),
    ("TG", "Hyderabad metro", ("Hyderabad", "Ranga Reddy", "Medchal Malkajgiri", "Sangareddy")),
)

# Spellings of a unit's name, (territory, spelling, name). A name
# that only needs title case is not listed: title-casing is the fallback rule.
UNIT_ALIASES = (
    ("MH", "mumbai city", "Mumbai"),
    ("MH", "mumbai suburban", "Mumbai"),
    ("MH", "greater mumbai", "Mumbai"),
    ("MH", "palghar", "Thane"),
    ("MH", "ahmadnagar", "Ahmednagar"),
    ("MH", "ahilyanagar", "Ahmednagar"),
    ("MH", "aurangabad", "Chhatrapati Sambhajinagar"),
    ("MH", "osmanabad", "Dharashiv"),
    ("MH", "bid", "Beed"),
    ("MH", "buldana", "Buldhana"),
    ("MH", "gondiya", "Gondia"),
    ("MH", "raigarh", "Raigad"),
    ("KA", "bangalore urban", "Bengaluru Urban"),
    ("KA", "bangalore", "Bengaluru Urban"),
    ("KA", "bengaluru", "Bengaluru Urban"),
    ("KA", "bangalore south", "Ramanagara"),
    ("KA", "bengaluru south", "Ramanagara"),
    ("KA", "bangalore rural", "Bengaluru Rural"),
    ("KA", "belgaum", "Belagavi"),
    ("KA", "bellary", "Ballari"),
    ("KA", "vijayanagar", "Ballari"),
    ("KA", "vijayanagara", "Ballari"),
    ("KA", "bijapur", "Vijayapura"),
    ("KA", "gulbarga", "Kalaburagi"),
    ("KA", "mysore", "Mysuru"),
    ("KA", "tumkur", "Tumakuru"),
    ("KA", "shimoga", "Shivamogga"),
    ("KA", "chikmagalur", "Chikkamagaluru"),
    ("KA", "bagalkot", "Bagalkote"),
    ("KA", "chikkaballapur", "Chikkaballapura"),
    ("KA", "yadagiri", "Yadgir"),
    ("TG", "bhadradri", "Bhadradri Kothagudem"),
    ("TG", "hanumakonda", "Hanamkonda"),
    ("TG", "warangal (u)", "Hanamkonda"),
    ("TG", "warangal (urban)", "Hanamkonda"),
    ("TG", "warangal urban", "Hanamkonda"),
    ("TG", "warangal (r)", "Warangal"),
    ("TG", "warangal rural", "Warangal"),
    ("TG", "hydrabad", "Hyderabad"),
    ("TG", "jayashankar", "Jayashankar Bhupalpally"),
    ("TG", "jogulamba", "Jogulamba Gadwal"),
    ("TG", "kumuram bheem", "Kumuram Bheem Asifabad"),
    ("TG", "komaram bheem", "Kumuram Bheem Asifabad"),
    ("TG", "asifabad", "Kumuram Bheem Asifabad"),
    ("TG", "medchal", "Medchal Malkajgiri"),
    ("TG", "medchal-malkajgiri", "Medchal Malkajgiri"),
    ("TG", "rangareddy", "Ranga Reddy"),
    ("TG", "yadadri", "Yadadri Bhuvanagiri"),
    ("TG", "yadadri bhongiri", "Yadadri Bhuvanagiri"),
    ("TG", "sircilla", "Rajanna Sircilla"),
    ("UP", "gautambudh nagar", "Gautam Buddha Nagar"),
    ("UP", "gautambuddha nagar", "Gautam Buddha Nagar"),
    ("UP", "gb nagar", "Gautam Buddha Nagar"),
    ("UP", "allahabad", "Prayagraj"),
    ("UP", "faizabad", "Ayodhya"),
    ("UP", "bhim nagar", "Sambhal"),
    ("UP", "jyotiba phule nagar", "Amroha"),
    ("UP", "kanshiram nagar", "Kasganj"),
    ("UP", "samli", "Shamli"),
    ("UP", "panchsheel nagar", "Hapur"),
    ("UP", "mahamaya nagar", "Hathras"),
    ("UP", "muzaffar nagar", "Muzaffarnagar"),
    ("UP", "buland shahar", "Bulandshahr"),
    ("UP", "badaun", "Budaun"),
    ("UP", "auraiyya", "Auraiya"),
    ("UP", "bara banki", "Barabanki"),
    ("UP", "raebareilly", "Rae Bareli"),
    ("UP", "kheri", "Lakhimpur Kheri"),
    ("UP", "kushi nagar", "Kushinagar"),
    ("UP", "maharajganj", "Mahrajganj"),
    ("UP", "sant kabeer nagar", "Sant Kabir Nagar"),
    ("UP", "siddharth nagar", "Siddharthnagar"),
    ("UP", "shravasti", "Shrawasti"),
    ("UP", "sant ravidas nagar (bhadohi)", "Bhadohi"),
    ("UP", "sant ravidas nagar", "Bhadohi"),
    ("WB", "north twenty four parganas", "North 24 Parganas"),
    ("WB", "south twenty four parganas", "South 24 Parganas"),
    ("WB", "haora", "Howrah"),
    ("WB", "hugli", "Hooghly"),
    ("WB", "barddhaman", "Purba Bardhaman"),
    ("WB", "burdwan", "Purba Bardhaman"),
    ("WB", "east midnapore", "Purba Medinipur"),
    ("WB", "west midnapore", "Paschim Medinipur"),
    ("WB", "koch bihar", "Cooch Behar"),
    ("WB", "darjiling", "Darjeeling"),
    ("BR", "pashchim champaran", "West Champaran"),
    ("BR", "purba champaran", "East Champaran"),
    ("BR", "kaimur (bhabua)", "Kaimur"),
    ("BR", "bhabua", "Kaimur"),
    ("BR", "nawadah", "Nawada"),
    ("BR", "narwada", "Nawada"),
    ("BR", "sahasra", "Saharsa"),
    ("BR", "purnea", "Purnia"),
    ("DL", "nct of delhi", "Delhi"),
    ("DL", "new delhi", "Delhi"),
    ("DL", "central", "Delhi"),
    ("DL", "central delhi", "Delhi"),
    ("DL", "east", "Delhi"),
    ("DL", "east delhi", "Delhi"),
    ("DL", "north", "Delhi"),
    ("DL", "north delhi", "Delhi"),
    ("DL", "north east", "Delhi"),
    ("DL", "north east delhi", "Delhi"),
    ("DL", "north west", "Delhi"),
    ("DL", "north west delhi", "Delhi"),
    ("DL", "south", "Delhi"),
    ("DL", "south delhi", "Delhi"),
    ("DL", "south east", "Delhi"),
    ("DL", "south east delhi", "Delhi"),
    ("DL", "south west", "Delhi"),
    ("DL", "south west delhi", "Delhi"),
    ("DL", "west", "Delhi"),
    ("DL", "west delhi", "Delhi"),
    ("DL", "shahdara", "Delhi"),
    ("RJ", "sri ganganagar", "Ganganagar"),
    ("RJ", "karouli", "Karauli"),
    ("RJ", "s. madhopur", "Sawai Madhopur"),
    ("RJ", "chittorgarh", "Chittaurgarh"),
    ("RJ", "dholpur", "Dhaulpur"),
    ("RJ", "jalore", "Jalor"),
    ("RJ", "jhunjhunu", "Jhunjhunun"),
)

# --------------------------------------------------------------------------
# The same settings as DataFrames
# --------------------------------------------------------------------------


def territory(code: str) -> dict:
    """Settings of one territory; an unknown code raises with the known list."""
    key = code.strip().upper()
    for row in TERRITORIES:
        if row[0] == key:
            names = ("code", "name", "bbox", "pop_range", "center", "zoom", "dissolve_to", "zone", "skip_reason")
            return dict(zip(names, row))
    raise KeyError(f"unknown territory {code!r}; known: {', '.join(sorted(r[0] for r in TERRITORIES))}")


def territory_table(spark: SparkSession) -> DataFrame:
    rows = [(c, n, *b, *p, *ctr, z, d, zone, skip) for c, n, b, p, ctr, z, d, zone, skip in TERRITORIES]
    return spark.createDataFrame(
        rows,
        "code string, name string, minx double, miny double, maxx double, maxy double, "
        "pop_lo double, pop_hi double, center_lon double, center_lat double, zoom double, "
        "dissolve_to string, zone string, skip_reason string",
    )


def total_source_table(spark: SparkSession) -> DataFrame:
    rows = [(*r[:-1], list(r[-1])) for r in TOTAL_SOURCES]
    return spark.createDataFrame(
        rows,
        "code string, kind string, year string, units string, price_basis string, base_year string, "
        "name_field string, value_field string, sheet string, row_label string, "
        "value_scale double, drop_names array<string>",
    )


def alias_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(UNIT_ALIASES), "code string, alias string, canonical string")


def metro_table(spark: SparkSession) -> DataFrame:
    rows = [(code, metro, list(units)) for code, metro, units in METROS]
    return spark.createDataFrame(rows, "code string, metro string, units array<string>")


def poi_table(spark: SparkSession) -> DataFrame:
    rows = [(g, key, v) for g, (key, values) in POI_GROUPS.items() for v in (values or (None,))]
    return spark.createDataFrame(rows, "poi_group string, tag_key string, tag_value string")
