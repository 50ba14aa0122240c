"""The server's configuration: one JSON object with a map of users."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.sources.schemas import CONFIG, USER, USERS


# Version of the configuration's format, port and host. The file's name is our own.
VERSION, FILE, PORT, HOST = "0.1", "settings.json", 8765, "0.0.0.0"


def default_config(port: int = PORT, host: str = HOST) -> dict:
    return {"version": VERSION, "port": port, "host": host, "users": {}}


def config_path(folder: str) -> str:
    return f"{folder.rstrip('/')}/{FILE}"


def get_user(users: DataFrame, username: str) -> DataFrame:
    """The user's row, none if there is no such user."""
    return users.filter(F.col("username") == username)


def allowed_hosts(host: str, port: int, extra: list[str] | None = None) -> list[str]:
    """Hosts that requests may name: the server's own and local ones, with and without port, then the extra ones; each once."""
    own = [h for name in (host, "localhost", "127.0.0.1") for h in (name, f"{name}:{port}")]
    return list(dict.fromkeys([*own, *(extra or [])]))


def user_json(user: Column) -> Column:
    """A user's struct as it stands in the configuration."""
    return F.to_json(user, {"ignoreNullFields": "false"})


def parsed_user(text: Column) -> Column:
    """The struct of a user's JSON; null fields where it has none."""
    return F.from_json(text, USER)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONFIG).option("multiLine", "true").json(path)


def config_users(config: DataFrame) -> DataFrame:
    """A row for each user."""
    u = config.select(F.explode("users").alias("username", "u")).select("username", "u.*")
    return u.select("username", "token_hash", "wiki_dir", F.to_timestamp("created_at").alias("created_at"), F.to_timestamp("last_active").alias("last_active"), "remotes", "auto_push_remotes")


def save_config(config: dict, path: str) -> None:
    """Written beside and moved, so that a reader sees the old or the new one."""
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump(config, f, indent=2)
    os.replace(f"{path}.new", path)


def users_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r.get(c) for c in ("username", "token_hash", "wiki_dir", "created_at", "last_active", "remotes", "auto_push_remotes")) for r in rows], USERS)
