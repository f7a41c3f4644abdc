"""Tables and documents in: schemas, JSON, line files, and the merges that keep tables current."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ACCOUNTS = (
    "username string, display_name string, followers bigint, following_count bigint, bio string, verified boolean, video_count bigint, "
    "hashtags array<string>, collected_at timestamp, fully_collected boolean, in_scope boolean, priority boolean"
)
VIDEOS = (
    "video_id string, author string, description string, hashtags array<string>, mentions array<string>, audio_id string, audio_title string, "
    "likes bigint, comments bigint, views bigint, create_time timestamp, language string, collected_at timestamp"
)
FOLLOWS = "follower string, following string, discovered_at timestamp"
SESSIONS = "session_id string, started_at timestamp, finished_at timestamp, credits_used bigint, accounts_collected bigint, notes string"

API_VIDEO = (
    "entityId string, id string, content string, tag array<struct<name:string>>, audio struct<entityId:string,id:string,name:string>, "
    "likeCount bigint, commentCount bigint, viewCount bigint, published string, language string, "
    "attributedTo struct<preferredUsername:string,url:string,id:string,name:string,followerCount:bigint>"
)
API_PROFILE = "preferredUsername:string,name:string,followerCount:bigint,followingCount:bigint,summary:string,isVerified:boolean,mediaCount:bigint"


def pages(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Items of landed API pages (JSON files), one row each; pages without items give none. ``item`` lists fields as name:type."""
    raw = spark.read.schema(f"data struct<orderedItems:array<struct<{item}>>,nextCursor:string>").json(path, multiLine=True)
    return raw.select(F.explode("data.orderedItems").alias("i")).select("i.*")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def json_array(col: Column) -> Column:
    """Strings of a JSON array; null if it can't be parsed."""
    return F.from_json(col, "array<string>")


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document as a table; an empty one if there is no file."""
    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def line_file(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file, stripped; blank ones and # comments are left out."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("#"))


def normalise_videos(raw: DataFrame) -> DataFrame:
    """API videos as rows of the videos table; rows without an id are dropped."""
    text = lambda c: F.when(c != "", c)
    return raw.select(
        F.coalesce(text(F.col("entityId")), F.col("id")).alias("video_id"),
        F.coalesce("attributedTo.preferredUsername", F.lit("")).alias("author"),
        F.coalesce("content", F.lit("")).alias("description"),
        F.coalesce(F.transform(F.filter("tag", lambda t: t["name"] != ""), lambda t: t["name"]), F.array().cast("array<string>")).alias("hashtags"),
        F.array_distinct(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"@([\p{L}\p{N}_.]+)"), 1)).alias("mentions"),
        F.coalesce(text(F.col("audio.entityId")), F.col("audio.id")).alias("audio_id"),
        F.col("audio.name").alias("audio_title"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(n) for c, n in (("likeCount", "likes"), ("commentCount", "comments"), ("viewCount", "views"))),
        F.to_timestamp("published").alias("create_time"), "language",
    ).where(F.coalesce("video_id", F.lit("")) != "")


def normalise_profiles(raw: DataFrame) -> DataFrame:
    """API profiles as rows of the accounts table; rows without a name are dropped."""
    text = lambda c: F.coalesce(c, F.lit(""))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return raw.select(
        F.col("preferredUsername").alias("username"), text(F.col("name")).alias("display_name"), number(F.col("followerCount")).alias("followers"), number(F.col("followingCount")).alias("following_count"),
        text(F.col("summary")).alias("bio"), F.coalesce("isVerified", F.lit(False)).alias("verified"), number(F.col("mediaCount")).alias("video_count"),
    ).where(F.coalesce("username", F.lit("")) != "")


def with_version(versions: DataFrame, stats: DataFrame, changes: list[str], date: str) -> DataFrame:
    """``versions`` (v, date, the columns of ``stats``, changes) and a record of this run; as they were if nothing changed."""
    if not changes:
        return versions
    last = versions.agg(F.coalesce(F.max("v"), F.lit(0)).alias("last"))
    record = stats.crossJoin(F.broadcast(last)).select((F.col("last") + 1).cast(versions.schema["v"].dataType).alias("v"), F.lit(date).alias("date"), *stats.columns, F.array(*map(F.lit, changes)).alias("changes"))  # a row each
    return versions.unionByName(record)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write wins: one row a key, the greatest by ``order``; rows with a null key are left out."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    known = rows.dropna(subset=keys)
    return known.withColumn("nth_", F.row_number().over(w)).where("nth_ = 1").drop("nth_")


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("nth_", F.row_number().over(w)).where("nth_ = 1").drop("nth_")


def merge_accounts(current: DataFrame, incoming: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """Upsert that leaves the ``kept`` columns of known keys as they are."""
    cols = [c for c in current.columns if c != key]
    c, n = current.alias("c"), incoming.withColumn("new_", F.lit(True)).alias("n")
    return c.join(n, key, "full_outer").select(
        key, *(F.when(F.col("new_") & F.lit(col not in kept), F.col(f"n.{col}")).otherwise(F.coalesce(f"c.{col}", f"n.{col}")).alias(col) for col in cols)
    )


def set_flags(rows: DataFrame, keys: DataFrame, key: str, **flags: bool) -> DataFrame:
    """Set flag columns on the rows whose key is in ``keys``."""
    marked = rows.join(keys.select(key).distinct().withColumn("hit_", F.lit(True)), key, "left")
    for name, value in flags.items():
        marked = marked.withColumn(name, F.when(F.col("hit_"), F.lit(value)).otherwise(F.col(name)))
    return marked.drop("hit_")


def in_scope(accounts: DataFrame) -> DataFrame:
    """Fully collected and in scope; an unknown scope is not in."""
    return accounts.where(F.col("fully_collected") & F.col("in_scope"))


def frontier(accounts: DataFrame) -> DataFrame:
    return accounts.where(~F.col("fully_collected"))


def append_snapshot(rows: DataFrame, path: str, snapshot: str) -> None:
    rows.withColumn("snapshot", F.lit(snapshot)).write.mode("append").partitionBy("snapshot").parquet(path)
