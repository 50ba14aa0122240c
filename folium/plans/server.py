"""Many users over one folder: accounts as an append-only table, and each user's corpus.

accounts/ has a row for every change of an account, activity/ one for every authenticated request; the current
accounts and the time of last activity follow from them, so that no write replaces what another has written.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.operators import users
from folium.operators.versions import latest
from folium.plans.store import Corpus, Tools, utc_now
from folium.sources.config import default_config, users_frame
from folium.sources.export import export_archive
from folium.sources.schemas import USERS, VERSIONS

ACCOUNTS = f"{USERS}, change long, removed boolean"
ACTIVITY = "username string, ts timestamp"
FIELDS = ["username", "token_hash", "wiki_dir", "created_at", "last_active", "remotes", "auto_push_remotes"]


def token_of(headers: Mapping[str, str], parameters: Mapping[str, str]) -> str | None:
    """The token of a request: that of a bearer header if there is one, else the parameter `token`."""
    for name, value in headers.items():
        if name.lower() == "authorization" and value.lower().startswith("bearer "):
            return value[7:].strip() or None
    return parameters.get("token") or None


class Server:
    def __init__(self, spark: SparkSession, folder: str, guide: str = "", now: Callable[[], datetime.datetime] = utc_now):
        self.spark, self.folder, self.guide, self.now = spark, folder.rstrip("/"), guide, now

    @property
    def _settings(self) -> Path:
        return Path(self.folder) / "settings.json"

    def init(self, port: int = 8765) -> None:
        """Writes the settings; leaves those that are there."""
        if not self._settings.exists():
            self._settings.parent.mkdir(parents=True, exist_ok=True)
            self._settings.write_text(json.dumps(default_config(port), indent=2), encoding="utf-8")

    def settings(self) -> dict:
        return json.loads(self._settings.read_text(encoding="utf-8")) if self._settings.exists() else default_config()

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    @property
    def accounts(self) -> DataFrame:
        """Current accounts, with the time of their last request."""
        rows = self._read("accounts", ACCOUNTS)
        last = rows.groupBy("username").agg(F.max_by(F.struct(*FIELDS[1:], "removed"), "change").alias("a")).filter("NOT a.removed").select("username", "a.*").drop("removed", "last_active")
        active = users.last_active(self._read("activity", ACTIVITY))
        return last.join(active, "username", "left").select(*FIELDS)

    def _change(self, rows: DataFrame, removed: bool = False) -> None:
        change = self._read("accounts", ACCOUNTS).agg(F.coalesce(F.max("change"), F.lit(0)).alias("n")).first().n + 1
        rows.select(*FIELDS, F.lit(change).cast("long").alias("change"), F.lit(removed).alias("removed")).coalesce(1).write.mode("append").parquet(f"{self.folder}/accounts")

    def _one(self, rows: DataFrame, username: str) -> DataFrame:
        """A copy of the user's row that doesn't depend on the files, to be appended to them."""
        return users_frame(self.spark, [r.asDict() for r in rows.filter(F.col("username") == username).collect()])

    def add_user(self, username: str) -> dict[str, str]:
        token = users.new_token(username)
        self._change(users.add_user(self.spark, self.accounts, username, token, f"{self.folder}#{username}", self.now()))
        self.corpus(username).init()
        s = self.settings()
        base = f"http://{s['host']}:{s['port']}"
        return {"token": token, "username": username, "wiki_dir": f"{self.folder}#{username}", "mcp_url": f"{base}/mcp", "wiki_url": f"{base}/wiki/{username}"}

    def remove_user(self, username: str) -> None:
        """The account goes; the pages' versions stay."""
        users.remove_user(self.accounts, username)
        self._change(self._one(self.accounts, username), removed=True)

    def rotate_token(self, username: str) -> str:
        token = users.new_token(username)
        self._change(self._one(users.rotate_token(self.accounts, username, token), username))
        return token

    def add_remote(self, username: str, name: str, url: str, auto_push: bool = False) -> None:
        self._change(self._one(users.add_remote(self.accounts, username, name, url, auto_push), username))

    def remove_remote(self, username: str, name: str) -> None:
        self._change(self._one(users.remove_remote(self.accounts, username, name), username))

    def list_remotes(self, username: str) -> dict[str, str]:
        users.known(self.accounts, username)
        return {r.name: r.url for r in users.list_remotes(self.accounts.filter(F.col("username") == username)).collect()}

    def list_users(self) -> DataFrame:
        """Accounts with the page counts of all corpora, from one read of the versions."""
        versions = self._read("versions", VERSIONS)
        return users.list_users(self.accounts, latest(versions))

    def corpus(self, username: str) -> Corpus:
        return Corpus(self.spark, self.folder, username, self.guide, self.now)

    def authenticate(self, token: str | None) -> str | None:
        """The user whose token it is, whose activity is noted; None if there is none."""
        asked = self.spark.createDataFrame([(1, token or "")], "request_id int, token string")
        found = users.authenticated(asked, self.accounts).take(1)
        if not found:
            return None
        self.spark.createDataFrame([(found[0].username, self.now())], ACTIVITY).coalesce(1).write.mode("append").parquet(f"{self.folder}/activity")
        return found[0].username

    def tools(self, token: str | None) -> Tools:
        """The nine operations as text for a token's user; PermissionError without one."""
        username = self.authenticate(token)
        if username is None:
            raise PermissionError("Unauthorized")
        return Tools(self.corpus(username))

    def export(self, username: str, form: str = "zip", out_dir: str = ".") -> Path:
        if not self.accounts.filter(F.col("username") == username).take(1):
            raise KeyError(f"User not found: {username}")
        return export_archive(self.corpus(username).pages, username, form, out_dir)
