"""Vocabularies, thresholds and lookup tables the results depend on."""

from __future__ import annotations


def words(text: str) -> list[str]:
    return text.split()


# --- fixed values: difficulty vocabulary -------------------------------------
GRADES = words(
    "strolling hiking mountain_hiking demanding_mountain_hiking alpine_hiking "
    "demanding_alpine_hiking difficult_alpine_hiking"
)
TIERS = words("walking mountain alpine")
GRADE_TIER = dict(zip(GRADES, words("walking walking mountain mountain alpine alpine alpine")))
TIER_LABEL = {
    "walking": "Walkable trail",
    "mountain": "Mountain trail",
    "alpine": "Alpine / scrambling",
}
MISSING = "<MISSING>"
CATEGORICAL = words(
    "highway surface smoothness tracktype trail_visibility incline_direction assisted_trail"
)
NUMERIC = words(
    "length_km mean_turn verts_per_km incline_pct width_m elevation_gain_m elevation_loss_m "
    "elevation_range_m average_slope_pct max_slope_pct terrain_available "
    "incline_numeric_missing width_missing"
)
DERIVED = words(
    "log_length gain_per_km descent_ratio steepness_squared relief_per_km length_x_no_terrain"
)

# --- fixed values: name vocabulary -------------------------------------------
GENERIC_TRAIL_WORDS = words(
    "trail trails trek treks trekking hike hikes hiking route routes path paths footpath walk "
    "walking loop peak peaks mountain mountains hill hills summit ridge falls waterfall "
    "waterfalls mala shola pass valley gorge canyon circuit nature reserve sanctuary forest"
)
SEARCH_STOPWORDS = words("the a an of in near at to for and or on via from")
OUTDOOR_NAME_WORDS = words(
    "trail trek trekking hike hiking peak peaks summit ridge waterfall waterfalls falls mountain "
    "mountains hill hills mala shola pass valley gorge canyon circuit loop reserve reserves "
    "sanctuary sanctuaries forest forests"
)
DESTINATION_NAME_WORDS = words(
    "peak peaks summit ridge waterfall waterfalls falls mountain mountains hill hills mala shola "
    "pass valley gorge canyon cave lake reserve sanctuary forest"
)
EXPLICIT_ROUTE_WORDS = words("bridleway footpath hike hiking path trail trek trekking")
GENERIC_WAY_NAMES = [
    "path", "footpath", "footway", "walkway", "walk way", "trail", "track", "road", "route",
    "shortcut", "short cut", "entrance", "exit", "gate",
]
STRUCTURE_ACCESS_WORDS = words(
    "shed hut hütte huette cabin barracks barrack reservoir tank tower gatehouse toilet washroom "
    "parking garage workshop quarry mine dam mill office ward boundary garden park canal "
    "playground stadium railway promenade plaza square compound bridge footbridge overbridge "
    "underbridge viaduct underpass overpass subway emergency evacuation"
)
FACILITY_WORDS = words(
    "access academy agricultural area block local mainroad shed airport ambulance approach bank "
    "barn boundary bridge overbridge footbridge underbridge viaduct overpass subway emergency "
    "evacuation building bus camp car carpark cattle centre center church clinic college "
    "community cottage court creek dam depot drive electricity entrance estate exit factory farm "
    "field fire footway forest gate golf grave green guest hall hospital hotel house industrial "
    "junction lane laundry level link mall mandir market mosque office officie outreach parking "
    "path pier plant playground post power pumping quad quarters railway reservoir residence "
    "restaurant road route school shelter shop signal spring stadium station store street "
    "substation temple toilets tower track trail tunnel underpass utility walkway warehouse water "
    "watermill way well yard"
)
ROAD_WORD_PREFIXES = words("roa stree lan driv highwa avenu boul sq")

# Patterns are matched against normalised names (lower case, single spaces).
ROAD_NAME = r"\b(road|street|lane|drive|highway)\b"
INFRASTRUCTURE_NAME = (
    r"\b(college|university|school|hospital|health\s*centre|health\s*center|nursing|hostel|hotel|"
    r"resort|campus|parking|entrance|entry|exit|emergency|gate|bridge|overbridge|bus\s*stop|"
    r"bus\s*stand|market|residential|apartment|apartments|society|ward|station|shortcut|"
    r"short\s*cut|water\s*tank|watchtower|toilet|washroom|bypass|road|street|lane|drive|highway|"
    r"service\s*road|private\s*road)\b"
)
RELIGIOUS_NAME = r"\b(temple|church|mosque|shrine)\b"
DEAD_END_NAME = (
    r"\b(dead[\s_-]?end|no\s+through\s+route|no\s+exit|cul[\s_-]?de[\s_-]?sac|blind\s+lane|"
    r"turnback)\b"
)
ROAD_RELATION_NAME = r"(^| )(residential road|service road|access road|main road|road)( |$)"
TRAIL_RELATION_NAME = (
    r"(^| )(trail|trails|trek|trekking|hike|hiking|route|walk|walking|loop|peak|summit|ridge|"
    r"waterfall|falls)( |$)"
)

# --- fixed values: tag vocabulary --------------------------------------------
HIKING_ROUTE_TYPES = words("hiking foot walking")
TRAIL_SPORTS = words("hiking walking trail_running")
PATH_HIGHWAYS = words("path footway bridleway steps")
TRACK_HIGHWAYS = words("track")
NEUTRAL_HIGHWAYS = words("unclassified service living_street residential")
URBAN_HIGHWAYS = words(
    "pedestrian residential unclassified living_street tertiary secondary primary service"
)
SCAN_HIGHWAYS = words("path track footway steps bridleway pedestrian")
EXCLUDED_FOOTWAY_USES = words("sidewalk crossing alley driveway parking_aisle corridor")
RESTRICTED_ACCESS = words("no private military")
PAVED_SURFACES = words("asphalt concrete paved cement paving_stones sett bitumen")
NAME_TAGS = words("name name_en int_name official_name alt_name loc_name short_name")
ALIAS_TAGS = words("name_en int_name alt_name official_name loc_name short_name old_name")
CENSUS_TAGS = words(
    "highway surface trail_visibility incline smoothness tracktype width assisted_trail"
)

# --- fixed values: evidence thresholds ---------------------------------------
GENERIC_NAME_LENGTH_KM = 0.8
MIN_LOCAL_PATH_KM = 0.30
MIN_LOCAL_PATH_STRONG_KM = 1.50
WEAK_EVIDENCE_SCORE = 55.0

# --- fixed values: search geometry -------------------------------------------
EARTH_KM = 6371.0
EARTH_MEAN_KM = 6371.0088
BOX_KM_PER_DEGREE = 111.32
FLAT_KM_PER_DEGREE = 111.195
MIN_BOX_KM = 8.0
PEAK_BOX_KM = 6.0
LOCAL_RADIUS_KM = 25.0
PLACE_RADIUS_KM = 40.0
AREA_RADIUS_KM = 60.0
MAX_TILE_SPAN_DEG = 0.75
MAX_TILES = 40
MIN_SPLIT_SPAN_DEG = 0.02
MAX_SPLIT_QUERIES = 200
PEAK_MARKERS = words(
    "peak summit mountain hill volcano crag ridge spur pass col saddle cirque massif fell ben "
    "berg horn kopf pico monte cerro"
)
SUMMIT_BAND_M = 150.0
APPROACH_BAND_M = 1500.0
ASSOCIATION_RANK = {"summit_route": 0, "peak_approach": 1, "nearby_route": 2}

# --- fixed values: line continuity -------------------------------------------
JOIN_TOLERANCE_KM = 0.025
SEPARATE_GAP_KM = 2.0
DOMINANT_CHAIN_SHARE = 0.5
MAX_MEASURED_CHAINS = 250
ALONG_TOLERANCE_DEG = 0.00005
ALONG_SHARE = 0.9

# --- fixed values: terrain ---------------------------------------------------
DEM_SPACING_M = 90.0
SLOPE_WINDOW_KM = 0.150
PROFILE_BUDGET = 100
ORIENT_MIN_DIFFERENCE_M = 10.0

# --- fixed values: weather ---------------------------------------------------
NAISMITH_KM_PER_HOUR = 5.0
NAISMITH_ASCENT_M_PER_HOUR = 600.0
MIN_WINDOW_HOURS = 1.0
MAX_WINDOW_HOURS = 24.0
SNOW_LYING_M = 0.05
SNOW_FORECAST_CM = 0.5
SNOW_RECENT_CM = 2.0
ROUTE_POINT_SEPARATION_KM = 0.3
ROUTE_POINT_ELEVATION_GAP_M = 150.0
# WMO codes from mildest to harshest; a code in no tier ranks with the mildest.
CODE_SEVERITY_TIERS = [
    [0], [1, 2], [3], [45, 48], [51, 53, 55], [61, 80], [63, 81, 56, 57], [65, 82, 66, 67],
    [71, 77, 85], [73], [75, 86], [95, 96, 99],
]
WEATHER_CODE_NAMES = {
    0: "Clear sky", 1: "Mainly clear", 2: "Partly cloudy", 3: "Overcast", 45: "Fog",
    48: "Depositing rime fog", 51: "Light drizzle", 53: "Moderate drizzle", 55: "Dense drizzle",
    56: "Light freezing drizzle", 57: "Dense freezing drizzle", 61: "Slight rain",
    63: "Moderate rain", 65: "Heavy rain", 66: "Light freezing rain", 67: "Heavy freezing rain",
    71: "Slight snowfall", 73: "Moderate snowfall", 75: "Heavy snowfall", 77: "Snow grains",
    80: "Slight rain showers", 81: "Moderate rain showers", 82: "Violent rain showers",
    85: "Slight snow showers", 86: "Heavy snow showers", 95: "Thunderstorm",
    96: "Thunderstorm with slight hail", 99: "Thunderstorm with heavy hail",
}
