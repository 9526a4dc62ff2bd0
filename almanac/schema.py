"""Fixed schemas. Reading never infers types: an absent key is NULL, a missing cell is the text 'NaN'."""

from pyspark.sql import types as T

# Field names of the standardised record, in the order the collection writes them.
TEXT_FIELDS = [
    "city", "created_day", "created_time", "report_short", "report_long", "report_short_wout_boeen",
    "gpt_rewritten_cleaned", "gpt_rewritten_apo", "gpt_rewritten_v2", "gpt_rewritten_apokalyptisch_v2",
    "gpt_rewritten_informell", "sunrise", "sundown", "sunhours", "overview",
]
SERIES_FIELDS = [
    "times", "clearness", "temperatur_in_deg_C", "niederschlagsrisiko_in_perc",
    "niederschlagsmenge_in_l_per_sqm", "windrichtung", "windgeschwindigkeit_in_km_per_h",
    "windgeschwindigkeit_in_km_per_s", "luftdruck_in_hpa", "relative_feuchte_in_perc", "bewölkungsgrad",
]
CORRUPT = "_corrupt_record"
NAN = "NaN"
FIRST_SLOT = "00 - 01 Uhr"

RECORD_SCHEMA = T.StructType(
    [T.StructField(f, T.StringType()) for f in TEXT_FIELDS]
    + [T.StructField(f, T.ArrayType(T.StringType())) for f in SERIES_FIELDS]
    + [T.StructField(CORRUPT, T.StringType())]
)

RAW_PAGE_SCHEMA = T.StructType([
    T.StructField("strings", T.StructType([
        T.StructField(n, T.StringType())
        for n in ("weather_description", "further_details", "sunrise", "sundown", "sunhours")
    ])),
    T.StructField("tabular", T.StructType([
        T.StructField(n, T.StringType())
        for n in ("weather_today", "overview", "diagram", "rainfall", "climate_table", "sub_areas_weather")
    ])),
    T.StructField("created_on", T.StringType()),
    T.StructField(CORRUPT, T.StringType()),
])

CITY_SCHEMA = T.StructType([
    T.StructField("City", T.StringType()),
    T.StructField("URL", T.StringType()),
    T.StructField("Region", T.StringType()),
    T.StructField("Country", T.StringType()),
    T.StructField("Continent", T.StringType()),
    T.StructField("Identifier", T.StringType()),
    T.StructField("True Name", T.StringType()),
    T.StructField("Latitude", T.DoubleType()),
    T.StructField("Longitude", T.DoubleType()),
    T.StructField("Timezone", T.StringType()),
    T.StructField("Time Difference", T.IntegerType()),
    T.StructField("Weather Report?", T.BooleanType()),
])

REQUEST_SCHEMA = T.StructType([
    T.StructField("custom_id", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("body", T.StructType([
        T.StructField("model", T.StringType()),
        T.StructField("messages", T.ArrayType(T.StructType([
            T.StructField("role", T.StringType()),
            T.StructField("content", T.StringType()),
        ]))),
    ])),
])

RESPONSE_SCHEMA = T.StructType([
    T.StructField("custom_id", T.StringType()),
    T.StructField("response", T.StructType([
        T.StructField("body", T.StructType([
            T.StructField("choices", T.ArrayType(T.StructType([
                T.StructField("message", T.StructType([T.StructField("content", T.StringType())])),
            ]))),
        ])),
    ])),
])
