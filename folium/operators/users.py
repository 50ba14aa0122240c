"""Users: hashed tokens, authentication, listing, remotes."""

from __future__ import annotations

import datetime
import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions import text
from folium.operators.pages import page_counts
from folium.sources.schemas import USERS

#: Users up to which a join is made by broadcast.
BROADCAST_USERS = 100_000


def new_token(username: str, prefix: str = "folium_") -> str:
    return f"{prefix}{username}_{secrets.token_hex(16)}"


def hash_token(token: str) -> str:
    return hashlib.sha256(token.encode()).hexdigest()


def add_user(spark: SparkSession, users: DataFrame, username: str, token: str, wiki_dir: str, created_at: datetime.datetime) -> DataFrame:
    """The row to append; ValueError if there is such a user."""
    if users.filter(F.col("username") == username).take(1):
        raise ValueError(f"User already exists: {username}")
    return spark.createDataFrame([(username, hash_token(token), wiki_dir, created_at, None, {}, [])], USERS)


def known(users: DataFrame, username: str) -> None:
    """KeyError if there is no such user."""
    if not users.filter(F.col("username") == username).take(1):
        raise KeyError(f"User not found: {username}")


def remove_user(users: DataFrame, username: str) -> DataFrame:
    known(users, username)
    return users.filter(F.col("username") != username)


def rotate_token(users: DataFrame, username: str, token: str) -> DataFrame:
    known(users, username)
    return users.withColumn("token_hash", F.when(F.col("username") == username, hash_token(token)).otherwise(F.col("token_hash")))


def small_users(users: DataFrame) -> DataFrame:
    return F.broadcast(users) if users.limit(BROADCAST_USERS + 1).count() <= BROADCAST_USERS else users


def authenticated(requests: DataFrame, users: DataFrame) -> DataFrame:
    """requests (request_id, token) with the user whose token it is; of users that share one, the first that was created, by name among those. An empty hash
    fits no token."""
    usable = users.filter(F.coalesce("token_hash", F.lit("")) != "").groupBy("token_hash").agg(F.min_by(F.struct("username", "wiki_dir", "auto_push_remotes"), F.struct("created_at", "username")).alias("u"))
    found = requests.withColumn("token_hash", text.token_hash(F.col("token"))).join(small_users(usable), "token_hash")
    return found.select("request_id", "u.username", "u.wiki_dir", "u.auto_push_remotes")


def rejected(requests: DataFrame, users: DataFrame) -> DataFrame:
    usable = users.filter(F.coalesce("token_hash", F.lit("")) != "").select("token_hash")
    return requests.withColumn("token_hash", text.token_hash(F.col("token"))).join(small_users(usable), "token_hash", "left_anti").drop("token_hash")


def routed(found: DataFrame, requested: str = "requested_user") -> DataFrame:
    """Whether the authenticated user is the one whose pages are asked for."""
    return found.withColumn("allowed", F.col("username") == F.col(requested))


def list_users(users: DataFrame, pages: DataFrame) -> DataFrame:
    """username, wiki_dir, page_count (0 for none), last_active, masked_token."""
    counts = page_counts(pages).withColumnRenamed("wiki_id", "username")
    df = users.join(counts, "username", "left")
    return df.select("username", "wiki_dir", F.coalesce("page_count", F.lit(0)).cast("long").alias("page_count"), "last_active", text.masked(F.col("username"), F.col("token_hash")).alias("masked_token"))


def count_users(users: DataFrame) -> DataFrame:
    return users.agg(F.count("*").alias("n_users"))


def basic_password(header: Column) -> Column:
    """The password of an Authorization header of kind Basic; null for others and for what isn't Base64 of name:password."""
    encoded = F.regexp_extract(header, r"(?i)^basic\s+([A-Za-z0-9+/=]+)\s*$", 1)
    said = F.try_to_binary(encoded, F.lit("base64")).cast("string")
    return F.when(said.contains(":"), F.regexp_replace(said, r"(?s)^[^:]*:", ""))


def push_warnings(results: DataFrame) -> DataFrame:
    """Per username the warnings of pushes (username, name, error) that failed, in order of the remotes' names."""
    failed = results.filter("error IS NOT NULL").select("username", F.struct("name", F.concat(F.lit("Push to "), "name", F.lit(" failed: "), "error").alias("w")).alias("w"))
    return failed.groupBy("username").agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["w"]).alias("warnings"))


def last_active(activity: DataFrame) -> DataFrame:
    """From rows (username, ts), one for each request."""
    return activity.groupBy("username").agg(F.max("ts").alias("last_active"))


def add_remote(users: DataFrame, username: str, name: str, url: str, auto_push: bool = False) -> DataFrame:
    """users with the remote added; ValueError if the user has one of that name."""
    known(users, username)
    if users.filter((F.col("username") == username) & F.map_contains_key("remotes", name)).take(1):
        raise ValueError(f"Remote already exists: {name}")
    mine = F.col("username") == username
    remotes = F.map_concat(F.map_filter(F.coalesce("remotes", F.create_map().cast("map<string,string>")), lambda k, _: k != name), F.create_map(F.lit(name), F.lit(url)))
    auto = F.coalesce("auto_push_remotes", F.array().cast("array<string>"))
    auto = F.array_union(auto, F.array(F.lit(name))) if auto_push else auto
    return users.withColumns({"remotes": F.when(mine, remotes).otherwise(F.col("remotes")), "auto_push_remotes": F.when(mine, auto).otherwise(F.col("auto_push_remotes"))})


def remove_remote(users: DataFrame, username: str, name: str) -> DataFrame:
    if not users.filter((F.col("username") == username) & F.map_contains_key("remotes", name)).take(1):
        raise KeyError(f"Remote not found: {name}")
    mine = F.col("username") == username
    return users.withColumns({
        "remotes": F.when(mine, F.map_filter("remotes", lambda k, _: k != name)).otherwise(F.col("remotes")),
        "auto_push_remotes": F.when(mine, F.array_remove("auto_push_remotes", name)).otherwise(F.col("auto_push_remotes")),
    })


def list_remotes(users: DataFrame) -> DataFrame:
    """username, name, url, auto_push."""
    each = users.select("username", "auto_push_remotes", F.explode("remotes").alias("name", "url"))
    return each.select("username", "name", "url", F.coalesce(F.array_contains("auto_push_remotes", F.col("name")), F.lit(False)).alias("auto_push"))
