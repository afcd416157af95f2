"""How much is read: one scan of the log, one bucket per history, one scan of a kept catalogue."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from cadenza import sources
from cadenza.operators.correlation import corr_pearson, corr_spearman
from cadenza.operators.panel import mean_playtime, with_week
from cadenza.operators.ranking import top_n
from cadenza.operators.sequence import next_event
from cadenza.plans.correlation import listenability_panel
from cadenza.plans import features as features_plan
from cadenza.plans.features import build_features, feature_rows, feature_tracks, packed, unpacked
from cadenza.plans.toplist import toplist_job
from cadenza.schemas import FEATURE_COLUMNS, PREDICTION, TRACK_ATTRIBUTES
from checks import feature_views, modelling, views

ANCHOR = date(2021, 1, 4)


def executed(df):
    """All nodes of the plan as it ran; a node that several read, by a reused exchange or subquery, is there once."""
    df.collect()
    found, seen = [], set()
    identity = df.sparkSession._jvm.java.lang.System.identityHashCode

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if identity(node) in seen:
            return None
        seen.add(identity(node))
        found.append((name, node))
        if name.startswith("Reused"):
            return walk(node.child())
        for children in (node.subqueries(), node.children()):
            for i in range(children.size()):
                walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def scans(df, path):
    return sum(
        name == "FileSourceScanExec" and str(path) in node.relation().location().rootPaths().mkString(",")
        for name, node in executed(df))


def write_log(make_log, tmp_path):
    log = make_log([
        (f"2021-01-{5 + i % 20:02d}T10:{i % 60:02d}:00", i % 3, f"t{i % 5}" if i % 7 else None, ["play", "skip", "like"][i % 3]) for i in range(200)
    ])
    log.write.parquet(str(tmp_path / "log"))
    return str(tmp_path / "log")


def test_features_scan_the_log_once(spark, make_log, tmp_path):
    log = spark.read.parquet(write_log(make_log, tmp_path))
    tracks = spark.createDataFrame([(f"t{i}", i, 1000 * i, 0.1, 0.2, 0.3, "1999") for i in range(6)], (
        "track_id string, popularity int, duration_ms long, danceability double, acousticness double, instrumentalness double, release_date string"))
    features = build_features(log, tracks, ANCHOR, partial_weeks=[1])
    assert scans(features, tmp_path / "log") == 1 and features.count() == 6 * 3
    weekly = with_week(log, ANCHOR)
    assert scans(next_event(weekly), tmp_path / "log") == 1
    assert scans(mean_playtime(weekly, tracks), tmp_path / "log") == 1


def catalogue(spark):
    return spark.createDataFrame([(f"t{i}", i, 1000 * i, 0.1, 0.2, 0.3, "1999") for i in range(6)], (
        "track_id string, popularity int, duration_ms long, danceability double, acousticness double, instrumentalness double, release_date string"))


def test_stored_tracks_are_expanded_where_they_are_read(spark, make_log, tmp_path):
    log, path = spark.read.parquet(write_log(make_log, tmp_path)), str(tmp_path / "by-track")
    wanted = build_features(log, catalogue(spark), ANCHOR, partial_weeks=[1])
    sources.write_features(feature_tracks(log, catalogue(spark), ANCHOR, partial_weeks=[1]), path, format="tracks")
    assert spark.read.parquet(path).count() == 6  # a row for a track, not one for each of its weeks
    back = sources.read_features(spark, path, format="tracks")
    assert back.columns == wanted.columns and back.dtypes == wanted.dtypes
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, wanted.collect()))
    # Nothing is shuffled after the expansion, and a week is picked before its measures are looked up.
    names = [name for name, _ in executed(back.filter("week = 3"))]
    assert names.count("ShuffleExchangeExec") == 1 and names.index("GenerateExec") < names.index("ShuffleExchangeExec")
    sources.write_histories(spark.read.parquet(path), str(tmp_path / "histories"), buckets=4)
    history = sources.read_history(spark, str(tmp_path / "histories"), "t2")
    assert sorted(map(tuple, history.collect())) == sorted(map(tuple, wanted.filter("track_id = 't2'").collect()))


def test_tracks_laid_out_by_week_are_shuffled_before_they_are_expanded(spark, make_log, tmp_path, monkeypatch):
    start = date(2021, 1, 4)
    events = [((start + timedelta(days=(i * i) % 240)).isoformat() + "T08:00:00", i % 3, f"t{i % 5}", ["play", "like", "skip"][i % 7 % 3]) for i in range(300)]
    tracks = spark.createDataFrame([(f"t{i}", i, 1000 * i, 0.1, 0.2, 0.3, "1999") for i in range(7)], catalogue(spark).schema)
    by_track = str(tmp_path / "by-track")
    sources.write_features(feature_tracks(make_log(events), tracks, ANCHOR, partial_weeks=[2]), by_track, format="tracks")
    wanted = sorted(map(tuple, sources.read_features(spark, by_track, format="tracks").collect()))
    stored = spark.read.parquet(by_track)
    for together, at_a_time in ((16, 2_000_000), (3, 20), (1, 7), (500, 1)):
        monkeypatch.setattr(features_plan, "WEEKS_TOGETHER", together)
        monkeypatch.setattr(features_plan, "LAID_OUT_ROWS", at_a_time)
        path = str(tmp_path / f"by-week-{together}")
        sources.write_features(stored, path)
        back = sources.read_features(spark, path)
        assert back.columns == FEATURE_COLUMNS and sorted(map(tuple, back.collect())) == wanted
        # Expansions come after the one exchange of the tracks.
        names = [name for name, _ in executed(features_plan.rows_by_week(stored)) if name in ("GenerateExec", "ShuffleExchangeExec", "SortExec")]
        assert names[:3] == ["SortExec", "GenerateExec", "ShuffleExchangeExec"]
    weeks = spark.read.parquet(path).select("week").distinct().count()
    assert len(wanted) == 7 * weeks and weeks == 20
    none = str(tmp_path / "none")
    sources.write_features(stored.limit(0), none)
    assert features_plan.rows_by_week(stored.limit(0)).count() == 0


def test_a_top_list_reads_its_rows_once(spark, tmp_path):
    path = str(tmp_path / "scored")
    spark.range(500).selectExpr("id AS track_id", "CAST(id % 7 AS DOUBLE) AS score").write.parquet(path)
    best = top_n(spark.read.parquet(path), "score", 5)
    assert scans(best, path) == 1
    assert [tuple(r) for r in best.orderBy("rank").collect()] == [(6 + 7 * i, 6.0, i + 1) for i in range(5)]
    read = "ShuffleExchangeExec"
    assert all(node.outputPartitioning().numPartitions() == 1 for name, node in executed(best) if name == read)


def table(spark, weeks):
    return spark.range(300).select(
        F.concat(F.lit("t"), "id").alias("track_id"), F.explode(F.sequence(F.lit(1), F.lit(weeks))).alias("week"),
        F.col("id").cast("double").alias("play_count"))


def test_a_history_opens_one_bucket(spark, tmp_path):
    opened = []
    for weeks in (5, 60):
        path = str(tmp_path / f"histories-{weeks}")
        sources.write_histories(table(spark, weeks), path, buckets=8)
        history = sources.read_history(spark, path, "t17")
        assert sorted(r["week"] for r in history.collect()) == list(range(1, weeks + 1))
        assert history.columns == ["track_id", "week", "play_count"]
        nodes = [node for name, node in executed(history) if name == "FileSourceScanExec"]
        opened.append([sum(len(part.files()) for part in node.inputRDD().partitions()) for node in nodes])
    assert opened[0] == opened[1] == [1]
    assert sources.read_history(spark, path, "nobody").count() == 0


def test_the_catalogue_is_scanned_once(spark, tmp_path):
    path = str(tmp_path / "tracks")
    spark.createDataFrame([(f"t{i}", f"song {i}") for i in range(300)], "track_id string, name string").coalesce(1).write.parquet(path)
    features = table(spark, 8)
    models = {"advanced": lambda df: df.withColumn(PREDICTION, F.col("play_count"))}
    request = {"tracks_num": 3, "date": "2021-02-16"}

    def job():
        return toplist_job(request, features, sources.cached_dimension(spark, path), models, ANCHOR)

    first = job().orderBy("rank").collect()
    assert [r["name"] for r in first] == ["song 299", "song 298", "song 297"]
    kept = sources.cached_dimension(spark, path)
    assert kept is sources.cached_dimension(spark, path)
    # All that the second request reads of the catalogue are the kept blocks.
    second = executed(job())
    assert any(name == "InMemoryTableScanExec" for name, _ in second)
    for name, node in second:
        if name == "InMemoryTableScanExec":
            assert node.relation().cacheBuilder().isCachedColumnBuffersLoaded()
    assert not any(name == "FileSourceScanExec" and path in node.relation().location().rootPaths().mkString(",") for name, node in second)
    # Changed files are read again.
    spark.createDataFrame([("t299", "renamed")], "track_id string, name string").write.mode("overwrite").parquet(path)
    assert [r["name"] for r in job().orderBy("rank").collect()] == ["renamed", None, None]
    assert sources.release_dimensions(spark, path) == 1 and sources.release_dimensions(spark, path) == 0


def test_the_maps_of_weeks_are_made_once(spark, make_log, tmp_path):
    log = spark.read.parquet(write_log(make_log, tmp_path))
    by_track = feature_tracks(log, catalogue(spark), ANCHOR, partial_weeks=[1])
    collecting = [node for name, node in executed(by_track) if "Aggregate" in name and "collect_list" in node.verboseStringWithOperatorId()]
    # The partial and the final step of the one aggregate; the weeks come from the cells before it.
    assert len(collecting) == 2
    assert scans(by_track, tmp_path / "log") == 1
    assert {tuple(r["_weeks"]) for r in by_track.collect()} == {(2, 3, 4)}


def test_correlations_expand_tracks_in_the_task_that_sums_them(spark, make_log, tmp_path):
    log = spark.read.parquet(write_log(make_log, tmp_path))
    odd = [("t8", None, None, float("nan"), 0.5, None, None), ("t9", 3, 7, 0.2, float("nan"), 0.1, "2001"), (None, 1, 1, 0.1, 0.1, 0.1, "1999")]
    tracks = catalogue(spark).unionByName(spark.createDataFrame(odd, catalogue(spark).schema))
    by_track = feature_tracks(log, tracks, ANCHOR, partial_weeks=[1])
    columns = FEATURE_COLUMNS[2:]
    rows = feature_rows(by_track).select(*[F.col(c).cast("double") for c in columns])
    unpack = unpacked(columns)
    made = packed(by_track).mapInPandas(unpack, ", ".join(f"{c} double" for c in columns))
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, rows.collect()))

    def matrix(df):
        return {(r["attr_a"], r["attr_b"]): None if r["r"] is None else round(r["r"], 9) for r in df.collect()}

    pearson = corr_pearson(packed(by_track), columns, unpack)
    assert not any(name == "GenerateExec" and "posexplode" in node.toString() for name, node in executed(pearson))
    assert matrix(pearson) == matrix(corr_pearson(rows, columns))
    wanted = matrix(corr_spearman(rows, columns))
    for dictionary in (2_000_000, 5):  # looked up, and most columns joined to their ranks
        assert matrix(corr_spearman(packed(by_track), columns, dictionary, unpack)) == wanted
    empty = feature_tracks(log.limit(0), tracks, ANCHOR, partial_weeks=[1])
    assert corr_pearson(packed(empty), columns, unpack).count() == 0


def test_the_listenability_panel_is_read_from_its_tracks(spark, tmp_path):
    """Those who fit, score and report read the panel several times; no pass starts from the log."""
    from pyspark.sql.types import TimestampNTZType

    day = F.timestamp_add("DAY", F.col("id").cast("int"), F.lit("1995-01-02").cast(TimestampNTZType()))
    spark.range(40).select(
        F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), day.alias("l_shipdate"), (F.col("id") % 3).alias("l_partkey"),
        F.lit("N").alias("l_returnflag")).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(40).selectExpr("id AS o_orderkey", "id % 2 AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(4).selectExpr(
        "id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "CAST(id AS INT) AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    panel = feature_views.panel_l(spark, str(tmp_path))
    direct = listenability_panel(
        views.sessions_l(spark, str(tmp_path)), views.tracks(spark, str(tmp_path)), TRACK_ATTRIBUTES, views.ANCHOR_L, views.PARTIAL_L)
    assert panel.dtypes == direct.dtypes and sorted(map(repr, panel.collect())) == sorted(map(repr, direct.collect()))
    assert panel.count() == 4 * 5
    assert scans(panel, tmp_path / "lineitem.parquet") == 0


def test_rows_that_trees_learnt_from_are_scored_once(spark, tmp_path, monkeypatch):
    """Counts by week and the comparison with the mean come from one pass over the scored rows."""
    from pyspark.sql.types import TimestampNTZType

    day = F.timestamp_add("DAY", (F.col("id") * 3).cast("int"), F.lit("1995-01-02").cast(TimestampNTZType()))
    spark.range(40).select(
        F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), day.alias("l_shipdate"), (F.col("id") % 3).alias("l_partkey"),
        F.lit("N").alias("l_returnflag")).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(40).selectExpr("id AS o_orderkey", "id % 2 AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(4).selectExpr(
        "id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "CAST(id AS INT) AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    train = modelling.split(spark, str(tmp_path), "train")
    labels = train.agg(F.avg("play_count"), F.stddev_pop("play_count")).first()
    monkeypatch.setattr(modelling.models, "train_gbt", lambda rows: None)
    # All rows are predicted as the mean and a shift: the squared error is the variance and the given part of it.
    for part, sound in ((0.0, True), (0.005, True), (0.02, False)):
        shift = part ** 0.5 * labels[1]
        monkeypatch.setattr(
            modelling.models, "score_batch", lambda model, rows: rows.withColumn(PREDICTION, F.lit(labels[0] + shift)))
        checked = modelling.train_gbt(spark, str(tmp_path))
        assert sum(name == "GenerateExec" for name, _ in executed(checked)) == 1
        assert checked.columns == ["week", "n", "n_finite", "label_sum", "no_worse_than_mean"]
        found = {r["week"]: (r["n"], r["n_finite"], r["label_sum"], r["no_worse_than_mean"]) for r in checked.collect()}
        wanted = {r["week"]: (4, 4, r["plays"], sound) for r in train.groupBy("week").agg(F.sum("play_count").alias("plays")).collect()}
        assert found == wanted and len(found) > 10
