"""Table schemas and fixed column lists.

Every source is read with one of these schemas: no inference pass over the
data, and types and nulls do not depend on what happens to be in a file.
"""

from pyspark.sql import types as T

SESSIONS = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("track_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
])

TRACKS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("id_artist", T.StringType()),
    T.StructField("popularity", T.IntegerType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("explicit", T.IntegerType()),
    T.StructField("key", T.IntegerType()),
    T.StructField("danceability", T.DoubleType()),
    T.StructField("energy", T.DoubleType()),
    T.StructField("loudness", T.DoubleType()),
    T.StructField("speechiness", T.DoubleType()),
    T.StructField("acousticness", T.DoubleType()),
    T.StructField("instrumentalness", T.DoubleType()),
    T.StructField("liveness", T.DoubleType()),
    T.StructField("valence", T.DoubleType()),
    T.StructField("tempo", T.DoubleType()),
    T.StructField("release_date", T.StringType()),
])

ARTISTS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("genres", T.ArrayType(T.StringType())),
])

# name, city, street and premium_user are left out on purpose: personal data
# that no computation here needs.
USERS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("favourite_genres", T.ArrayType(T.StringType())),
])

# Names and order of the feature table and of the model input.
FEATURE_COLUMNS = [
    "track_id", "week", "lag_like_count", "lag_skip_count", "lag_playtime_ratio",
    "lag_1", "lag_2", "lag_3", "lag_4", "lag_5", "popularity", "release_date",
    "duration_ms", "danceability", "acousticness", "instrumentalness", "play_count",
]
MODEL_INPUTS = [
    "lag_like_count", "lag_skip_count", "lag_playtime_ratio",
    "lag_1", "lag_2", "lag_3", "lag_4", "lag_5", "popularity", "release_date",
    "duration_ms", "danceability", "acousticness", "instrumentalness",
]
LABEL = "play_count"
PREDICTION = "predicted_play_count"

# The catalogue's attributes that studies and histograms cover.
TRACK_ATTRIBUTES = [
    "popularity", "duration_ms", "explicit", "danceability", "energy", "key",
    "loudness", "speechiness", "acousticness", "instrumentalness", "liveness",
    "valence", "tempo", "release_date",
]

FEATURES = T.StructType(
    [T.StructField("track_id", T.StringType()), T.StructField("week", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in FEATURE_COLUMNS[2:10]]
    + [
        T.StructField("popularity", T.IntegerType()),
        T.StructField("release_date", T.IntegerType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("danceability", T.DoubleType()),
        T.StructField("acousticness", T.DoubleType()),
        T.StructField("instrumentalness", T.DoubleType()),
        T.StructField("play_count", T.DoubleType()),
    ]
)
