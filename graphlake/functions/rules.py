"""Fixed values of the question rules: phrases, patterns and what they lead to, each in the order they are tried."""

AGGREGATION = [
    ("MAX", ["most recent", "latest", "newest", "maximum", "highest"]),
    ("MIN", ["oldest", "earliest", "minimum", "lowest"]),
    ("COUNT", ["how many", "count", "number of", "total number"]),
    ("LIST", ["list all", "show all", "what are all", "enumerate"]),
    ("DISTINCT", ["different", "unique", "distinct", "various"]),
    ("SUM", ["total production", "sum of", "combined"]),
]

RELATION_PATTERNS = [
    ("well_to_curves", [r"what curves.*well\s+(\S+)", r"curves.*available.*well\s+(\S+)", r"curves.*in well\s+(\S+)", r"list curves.*well\s+(\S+)", r"show.*curves.*well\s+(\S+)"]),
    ("curve_to_well", [r"which well.*curve\s+(\S+)", r"what well.*curve\s+(\S+)", r"(\S+)\s+curve.*belong", r"(\S+)\s+curve.*from which well"]),
    ("curve_to_document", [r"document.*contains.*curve\s+(\S+)", r"which document.*curve\s+(\S+)", r"what is the document.*curve\s+(\S+)"]),
    ("site_to_measurements", [r"measurements.*site\s+(\S+)", r"what measurements.*site\s+(\S+)", r"data.*site\s+(\S+)"]),
    ("measurement_to_site", [r"which site.*measurement", r"where.*measurement.*taken"]),
]
RELATION_WORDS = [
    "belongs to", "belong to", "describes", "describe", "connected to", "connected", "related to", "related", "associated with", "associated",
    "part of", "contains", "contain", "has", "have", "includes", "include", "from which", "for which",
]
ENTITY_PATTERNS = {
    "well_id": r"\b\d+_\d+-\d+\b",
    "well_name": r"(?i)sleipner|troll|statfjord|gullfaks",
    "curve_name": r"(?i)FORCE_2020_LITHOFACIES|DEPT|GR|NPHI|RHOB|DTC|CALI",
    "site_id": r"\b\d{8}\b",
}
WELL_CURVE_TERMS = ["curve suite", "log suite", "curve types", "available curves", "petrophysical", "hydrocarbon", "advanced interpretation", "curve coverage"]
#: relation: direction, edge type.
TRAVERSAL = {
    "well_to_curves": ("incoming", "describes"), "curve_to_well": ("outgoing", "describes"),
    "site_to_measurements": ("incoming", "reports_on"), "measurement_to_site": ("outgoing", "reports_on"),
}

ENTITY_WORDS = [
    ("eia_record", ["eia", "energy production", "oil production", "gas production", "operator", "well production", "mcf", "bbl", "energy record"]),
    ("usgs_site", ["usgs site", "monitoring site", "streamflow", "surface water site", "river", "stream", "gage", "vermilion"]),
    ("usgs_measurement", ["water measurement", "gage height", "streamflow measurement", "water level", "discharge"]),
    ("las_curve", ["las curve", "well log curve", "log curve", "gamma ray", "porosity", "density", "resistivity", "sonic", "curve data", "gsgr", "gr", "nphi", "rhob", "lithofacies"]),
    ("las_document", ["las file", "las document", "well log file", "las metadata", "well name", "curve mnemonics", "curve types"]),
    ("domain:subsurface", ["subsurface", "formation", "well log", "lithology"]),
    ("domain:energy", ["energy", "production", "operator"]),
    ("domain:surface_water", ["surface water", "hydrological", "streamflow"]),
]

KEYWORD_PATTERNS = [r"contain(?:s)?\s+(?:the\s+word\s+)?(\w+)", r"with\s+(\w+)\s+in\s+(?:the\s+)?(?:name|mnemonic)", r"called\s+(\w+)", r"named\s+(\w+)"]
WELL_ID = r"(\d+/\d+[-_]\d+\w*|\d+_\d+[-_]\d+\w*)"

ATTRIBUTES = [
    ("well", ["well name", "name of the well", "what is the well name"]),
    ("domain", ["domain", "data domain"]),
    ("site_code", ["site code", "usgs code", "station code", "site number", "site id"]),
    ("site_name", ["site name", "station name", "name of the site", "name of the station", "monitoring site name"]),
    ("mnemonic", ["curve code", "mnemonic", "curve name", "which curve", "curve mnemonic", "log code", "curve abbreviation", "what curve", "curves measure", "curve represents", "porosity measurements", "gamma ray"]),
    ("description", ["what does", "curve measure", "what is measured", "measures what", "types of"]),
    ("state", ["what state", "which state", "state located", "in which state"]),
    ("county", ["what county", "which county", "county located"]),
    ("operator", ["operator", "company", "who operates", "well operator"]),
    ("api_number", ["api number", "api code", "well api", "api identifier"]),
    ("year", ["most recent year", "latest year", "what year", "which year", "year represented", "recent year"]),
    ("date", ["most recent date", "latest date", "when was", "date of"]),
]

OUT_OF_SCOPE = [
    ("politics", ["election", "president", "congress", "vote", "campaign", "senator", "parliament", "government policy"]),
    ("food", ["recipe", "cooking", "ingredient", "meal", "restaurant", "chef", "cuisine", "dinner"]),
    ("entertainment", ["movie", "song", "actor", "album", "concert", "film", "tv show", "celebrity"]),
    ("weather", ["weather", "forecast", "temperature", "rain", "precipitation", "climate", "snow", "sunny"]),
    ("sports", ["game", "score", "team", "player", "championship", "league", "tournament", "match"]),
    ("finance", ["price", "stock", "market", "investment", "bitcoin", "cryptocurrency", "trading"]),
    ("other_domains", ["medical", "healthcare", "legal", "retail", "agriculture"]),
]
IN_SCOPE = [
    ("energy_production", ["oil", "gas", "petroleum", "hydrocarbon", "production", "well", "operator", "EIA", "energy information", "fossil fuel", "drilling", "reservoir"]),
    ("subsurface_geology", ["formation", "lithology", "well log", "LAS", "gamma ray", "porosity", "density", "resistivity", "neutron", "sonic", "curve", "borehole", "downhole", "geophysical"]),
    ("surface_water", ["streamflow", "discharge", "gage", "USGS", "hydrological", "river", "water level", "monitoring", "measurement", "flow rate"]),
    ("geospatial", ["location", "coordinates", "Indiana", "Illinois", "Kansas", "county", "state", "latitude", "longitude", "site"]),
]

SYNONYMS = [
    ("energy", ["petroleum", "oil", "gas"]), ("subsurface", ["formation", "lithology", "geology"]), ("surface water", ["streamflow", "hydrology", "river"]),
    ("gamma ray", ["GSGR", "radioactivity", "natural gamma"]), ("porosity", ["NPHI", "neutron", "hydrogen content"]), ("density", ["RHOB", "bulk density", "formation density"]),
    ("resistivity", ["electrical", "conductivity"]),
]
NO_EXPANSION = ["how many", "count", "total number", "site code", "id ", "number "]
EXPANSION = ["energy", "production", "subsurface", "formation", "surface water", "hydrological", "monitoring", "what data", "what information", "available"]

NOT_GLOSSARY = ["well name for", "uwi for", "well id for", "curve", "how many", "measurement", "value of", "data for", "logging", "analysis", "interpretation", "method"]
GLOSSARY = ["define", "definition", "what is", "what does", "meaning of", "explain", "describe", "clarify", "term", "acronym", "means"]

DOMAIN_ANSWERS = {
    "nphi_purpose": "NPHI measures neutron porosity (hydrogen content).",
    "gr_purpose": "Gamma ray (GR) measures natural radioactivity; high GR typically indicates shale.",
    "rhob_purpose": "RHOB measures bulk density; used with NPHI for porosity analysis.",
    "neutron_density_crossover": "Neutron–density crossover occurs when NPHI exceeds RHOB-derived porosity; in clean gas-bearing sands this crossover is a common indicator of gas.",
    "gas_bearing_detection": "Use neutron–density crossover (NPHI greater than density-derived porosity), low density, and supportive resistivity increase to identify gas-bearing zones.",
    "lithology_tools": "PEF (Photoelectric factor) is the standard tool for lithology identification.",
}
DOMAIN_RULES = [
    ("nphi_purpose", ["nphi", "neutron porosity"]), ("gr_purpose", ["gamma ray", "gr"]), ("rhob_purpose", ["rhob", "bulk density", "density log"]),
    ("neutron_density_crossover", ["neutron-density crossover", "neutron density crossover", "crossover pattern"]),
    ("gas_bearing_detection", ["gas-bearing", "gas bearing", "identify gas"]), ("lithology_tools", ["lithology identification", "lithology tool", "photoelectric", "pef"]),
]

#: States by abbreviation, in the order they are looked for.
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "FL": "Florida", "GA": "Georgia",
    "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland",
    "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey",
    "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina",
    "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
    "DC": "District of Columbia",
}
PLACE_SPLITS = ["NEAR", "AT", "UPSTREAM FROM", "DOWNSTREAM FROM", "UPSTREAM", "DOWNSTREAM", "NORTH OF", "SOUTH OF", "EAST OF", "WEST OF"]
DIRECTIONS = ["NE", "NW", "SE", "SW", "N", "S", "E", "W", "NORTH", "SOUTH", "EAST", "WEST"]
PLACE_FEATURES = ["RIVER", "CREEK", "LAKE", "RESERVOIR", "FIELD", "BASIN", "SITE", "STATION", "POINT", "PLANT", "CHANNEL", "FORK", "BRANCH", "MINE", "LAGOON", "CANAL", "STREAM"]

COMPLEXITY_WEIGHTS = {"steps": 0.30, "tools": 0.25, "scope": 0.20, "aggregations": 0.15, "inference": 0.10}
COMPLEXITY_CAPS = {"steps": 10, "tools": 5, "scope": 10, "aggregations": 5}
STEP_WORDS = [(2, ["then", "and then", "after", "validate then"]), (1, ["compare", "rank", "sort"]), (1, ["for each", "all wells", "all curves"])]
TOOL_WORDS = [(1, ["validate"]), (1, ["export", "generate report", "summarize"]), (1, ["predict", "recommend"])]
CURVE_WORDS = ["nphi", "gr", "rhob", "dtc", "depth", "porosity", "gamma ray", "density"]
AGGREGATION_WORDS = ["average", "mean", "median", "mode", "min", "max", "sum", "count", "standard deviation", "variance", "percentile", "correlation", "total", "statistics"]
INFERENCE_WORDS = ["predict", "recommend", "assess", "explain", "identify potential", "reservoir quality", "depositional environment", "completion strategy", "lithology", "hydrocarbon", "heterogeneity", "characterization"]

#: Words of questions that name no field, fields that no question may name, and words that lead to a field that holds them.
STOPWORDS = [
    "what", "show", "list", "all", "the", "does", "many", "how", "are", "there", "for", "with", "get", "give", "could", "you", "unique", "available", "different",
    "count", "number", "records", "total", "per", "of", "in", "and", "to", "from", "find", "tell", "me",
]
RESERVED_FIELDS = ["id", "_id", "type", "attributes", "metadata", "data"]
KEYWORD_PRIORITY = ["production", "oil", "gas", "mnemonic", "curve", "well", "region", "site", "operator", "county", "state", "unit", "value", "depth", "date", "year", "month"]
COMPARED_ENTITIES = ["las", "usgs", "eia", "curve", "site", "measurement", "dataset"]
