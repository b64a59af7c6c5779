"""Fixed values of the eligibility rules. They must equal the published lists."""

# Industry codes counted as fossil fuel employment, current guidance.
FOSSIL_CODES = ["211", "2121", "213111", "213112", "213113", "32411", "4861", "4862"]

# Industry codes of the earlier guidance.
EARLIER_FOSSIL_CODES = ["2121", "211", "213", "23712", "486", "4247", "22112"]

# The row of an area that holds its total employment.
TOTAL_INDUSTRY_CODE = "10"
TOTAL_OWNERSHIP_CODE = 0

# Fixed value: an area qualifies when its fossil share is strictly above this.
FOSSIL_SHARE_THRESHOLD = 0.0017

# Coal fuel codes (reports of 2010 to 2013) and coal technologies (2014 on).
COAL_FUEL_CODES = ["ANT", "BIT", "LIG", "RC", "SGC", "WC", "SUB"]
COAL_TECHNOLOGIES = ["Conventional Steam Coal", "Coal Integrated Gasification Combined Cycle"]
FIRST_GENERATOR_REPORT = "2010-01-01"
FIRST_TECHNOLOGY_REPORT = "2014-01-01"

# What counts as a closed coal mine, after trimming and lowering.
CLOSED_MINE_STATUSES = ["abandoned and sealed", "abandoned"]
COAL_MINE_TYPES = ["surface", "underground"]
COAL_KIND = "c"
FIRST_CLOSURE_YEAR = 2000

# Unemployment series layout.
COUNTY_AREA_TYPE = "CN"
METRO_AREA_TYPE = "MT"
MEASURE_UNEMPLOYED = "04"
MEASURE_LABOR_FORCE = "06"
FIRST_MONTH = "M01"
LAST_MONTH = "M12"
NATIONAL_STATUS_OK = "REQUEST_SUCCEEDED"

# Labels in the result.
MINE = "coalmine"
PLANT = "coal_plant"
MINE_CLOSURE = "coal_mine"
BROWNFIELD = "brownfield"
EMPLOYMENT = "fossil_fuel_employment"
EMPLOYMENT_AREA = "MSA or non-MSA"
EXCLUDED_PROGRAM = "superfund"

LEVELS = ("county", "tract")

# Fixed value: the coordinate system of every input, geographic NAD83 (lon, lat).
GEOGRAPHIC_CRS = "EPSG:4269"
