"""Schemas of the engine's tables."""

PAGES = "wiki_id string, path string, content string"
VERSIONS = "wiki_id string, path string, version long, ts timestamp, op string, message string, content string, is_delete boolean"
LOG = "wiki_id string, ts timestamp, operation string, entry string"
USERS = "username string, token_hash string, wiki_dir string, created_at timestamp, last_active timestamp, remotes map<string,string>, auto_push_remotes array<string>"
USER = "struct<token_hash: string, wiki_dir: string, created_at: string, last_active: string, remotes: map<string,string>, auto_push_remotes: array<string>>"
CONFIG = f"version string, port int, host string, users map<string, {USER}>"
