"""Lists, lookup tables, thresholds and formats that decide the results."""

# Census snapshots.
SNAPSHOT_YEARS = [2009, 2014, 2019, 2021, 2023]

# Offence categories.
VIOLENT_CATEGORIES = ["Assault", "Homicide", "Robbery", "Rape", "Kidnapping", "Weapons Offenses"]
PROPERTY_CATEGORIES = ["Burglary", "Theft", "Motor Vehicle Theft", "Arson", "Vandalism"]

# Land-use classes and the accepted range of the construction year.
HIGH_RISK_USES = ["RETAIL/ENT", "PDR"]
RESIDENTIAL_USES = ["RESIDENT", "MIXRES"]
YEAR_BUILT_RANGE = (1800, 2025)

# Census codes and the measure each one holds.
CENSUS_MEASURES = {
    "B19013_001E": "median_household_income",
    "B17001_001E": "poverty_universe_total",
    "B17001_002E": "poverty_below",
    "B01003_001E": "total_population",
    "B15003_022E": "bachelor_degree_count",
    "B15003_001E": "education_universe_total",
    "B25064_001E": "median_gross_rent",
    "B25002_003E": "vacant_housing_units",
    "B25002_001E": "total_housing_units",
}
CENSUS_COLUMNS = [
    "total_population", "median_household_income", "median_gross_rent",
    "poverty_below", "poverty_universe_total",
    "bachelor_degree_count", "education_universe_total",
    "vacant_housing_units", "total_housing_units",
]
CENSUS_MEDIANS = ["median_household_income", "median_gross_rent"]
CENSUS_SUMS = [
    "poverty_below", "poverty_universe_total", "bachelor_degree_count",
    "education_universe_total", "vacant_housing_units", "total_housing_units",
]
CENSUS_SENTINEL_FLOOR = -999
TRACT_ID_WIDTH = 11

# Rate -> (numerator, denominator), percent with two decimals.
RATES = {
    "poverty_rate": ("poverty_below", "poverty_universe_total"),
    "bachelor_rate": ("bachelor_degree_count", "education_universe_total"),
    "vacancy_rate": ("vacant_housing_units", "total_housing_units"),
    "pct_violent_crime": ("violent_crime_count", "total_crimes"),
    "pct_property_crime": ("property_crime_count", "total_crimes"),
    "pct_pre1940": ("pre1940_count", "yrbuilt_count"),
    "pct_pre1960": ("pre1960_count", "yrbuilt_count"),
    "pct_residential": ("residential_count", "parcel_count"),
    "pct_high_risk_commercial_area": ("high_risk_commercial_area_sqft", "total_area_sqft"),
}

# Incident columns.
INCIDENT_TEXT = ["incident_number", "neighborhood_district", "battalion",
                 "primary_situation", "no_flame_spread"]
INCIDENT_TIMES = ["incident_date", "alarm_dttm", "arrival_dttm"]
INCIDENT_COUNTS = ["suppression_units", "suppression_personnel", "ems_units", "number_of_alarms",
                   "civilian_fatalities", "civilian_injuries", "estimated_property_loss"]

# Column groups of the wide incident export used by profile and report.
PROFILE_TIMES = ["incident_date", "alarm_dttm", "arrival_dttm", "close_dttm"]
PROFILE_CATEGORIES = [
    "primary_situation", "property_use", "mutual_aid",
    "action_taken_primary", "action_taken_secondary",
    "ignition_cause", "ignition_factor_primary", "heat_source",
    "item_first_ignited", "fire_spread", "structure_type", "structure_status",
    "detectors_present", "detector_effectiveness",
    "automatic_extinguishing_system_present",
    "battalion", "station_area", "city", "supervisor_district", "neighborhood_district",
]
PROFILE_NUMBERS = [
    "suppression_units", "suppression_personnel", "ems_units", "ems_personnel",
    "other_units", "other_personnel", "fire_fatalities", "fire_injuries",
    "civilian_fatalities", "civilian_injuries", "number_of_alarms", "exposure_number",
    "estimated_property_loss", "estimated_contents_loss", "floor_of_fire_origin",
    "number_of_floors_with_minimum_damage", "number_of_floors_with_significant_damage",
    "number_of_floors_with_heavy_damage", "number_of_floors_with_extreme_damage",
    "number_of_sprinkler_heads_operating",
]
CASUALTIES = ["fire_fatalities", "fire_injuries", "civilian_fatalities", "civilian_injuries"]
RESPONSE_PAIRS = [("Alarm → Arrival", "alarm_dttm", "arrival_dttm"),
                  ("Alarm → Close", "alarm_dttm", "close_dttm")]
COMPLETENESS_SKIP = ["year", "month_name", "hour", "weekday", "response_min", "duration_min",
                     "point", "data_as_of", "data_loaded_at", "id"]

# Formats and null tokens.
ISO_MILLIS_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}$"
NULL_TOKENS = ["", "NA", "N/A", "null"]
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
WEEKDAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]

# Hundreds of the situation code, 100-199 first.
CODE_BIN_LABELS = ["Feuer", "Ueberhitzung", "Rettung_EMS", "Gefahrstoffe",
                   "Service", "Suche_Sonstiges", "Fehlalarm"]
FIRE_CODES = (100, 199)
EMS_CODES = (300, 399)

# Model columns.
SOCIO_COLUMNS = ["median_household_income", "poverty_rate", "median_gross_rent",
                 "bachelor_rate", "vacancy_rate"]
CONTROL_COLUMNS = ["hour", "is_night", "is_weekend"]

# File names of the raw tables.
RAW_FILES = {
    "incidents": "fire_incidents.parquet",
    "crosswalk": "crosswalk.csv",
    "tracts": "acs_tracts_{year}.csv",
    "crime": "crime_raw.parquet",
    "parcels": "land_use_2020_raw.parquet",
    "polygons": "neighborhoods.geojson",
}
RESULT_FILES = {
    "census": "census_by_district_{year}.csv",
    "crime": "crime_by_district.csv",
    "land": "land_by_district.csv",
    "base": "incidents_base.parquet",
    "features": "incidents_features.parquet",
}
