"""Operations on small tables, with results worked out by hand."""

from __future__ import annotations

import datetime
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from folium.operators import links, log, pages, ranking, search, users, versions
from folium.plans.server import Server, token_of
from folium.plans.store import Corpus, Tools
from folium.sources import config, corpus, export
from folium.sources.schemas import PAGES, VERSIONS
from folium.streaming import log as streamed

T0 = datetime.datetime(2026, 1, 2, 3, 4, 5)


def make(spark, rows: dict[str, str | None], wiki: str = "w"):
    return spark.createDataFrame([(wiki, p, c) for p, c in rows.items()], PAGES)


def test_list_and_read(spark):
    p = make(spark, {"topics/alpha.md": "alpha", "entities/alice.md": "alice", "topics-x.md": "x", ".hid/h.md": "h", "note.txt": "n", "bad.md": None})
    assert [r.path for r in pages.list_pages(p).collect()] == ["bad.md", "entities/alice.md", "topics-x.md", "topics/alpha.md"]
    assert [r.path for r in pages.list_pages(p, "topics").collect()] == ["topics/alpha.md"]
    assert pages.list_pages(p, "none").count() == 0
    assert pages.read_page(p, "note.txt") == "n"
    with pytest.raises(FileNotFoundError):
        pages.read_page(p, "no.md")
    with pytest.raises(UnicodeDecodeError):
        pages.read_page(p, "bad.md")
    with pytest.raises(FileNotFoundError):
        pages.read_index(p)


def test_info_counts_hidden_but_no_logs(spark):
    p = make(spark, {"a.md": "", ".hid/h.md": "", "log.md": "# Activity Log\n\n\n## t [x]\n\nbody\n## in body\n", "topics/log.md": "## no", "n.txt": ""})
    assert pages.wiki_info(p, "/r", "guide").first().asDict() == {"page_count": 2, "log_entries": 2, "wiki_root": "/r", "schema": "guide"}
    assert pages.wiki_info(p.limit(0), "/r").first().page_count == 0
    assert {r.wiki_id: r.page_count for r in pages.page_counts(p).collect()} == {"w": 4}


def test_search(spark):
    p = make(spark, {"topics/python.md": "# Python\n\nPython is python\r\nend", "topics-x.md": "python", ".h/x.md": "python", "n.txt": "python", "bad.md": None, "empty.md": ""})
    found = search.search(p, "PYTHON").collect()
    assert [(r.path, [(m.line_number, m.line) for m in r.matches]) for r in found] == [("topics/python.md", [(1, "# Python"), (3, "Python is python")]), ("topics-x.md", [(1, "python")])]
    assert search.search_lines(p, "PYTHON", True).count() == 0
    assert search.search_lines(p, "a\nb").count() == 0
    assert search.search_lines(p, "").count() == 5
    assert search.web_search(p, "  ") is None and search.web_search(p, " end ").count() == 1
    many = make(spark, {"m.md": "\n".join(["hit"] * 8)})
    top = search.first_matches(search.search_lines(many, "hit")).orderBy("line_number").collect()
    assert [r.line_number for r in top] == [1, 2, 3, 4, 5] and {r.more for r in top} == {3}


def test_versions(spark):
    rows = [("w", "a.md", 1, "x", False), ("w", "a.md", 2, "x", False), ("w", "a.md", 3, None, True), ("w", "a.md", 4, "y", False), ("w", "b.md", 1, "z", False), ("w", "b.md", 2, None, True), ("w", "c.md", 1, None, True)]
    v = spark.createDataFrame([(w, p, n, T0, "write_page", versions.message("write_page", p), c, d) for w, p, n, c, d in rows], VERSIONS)
    assert [(r.path, r.content) for r in versions.latest(v).collect()] == [("a.md", "y")]
    assert sorted((r.path, r.version) for r in versions.commits(v).collect()) == [("a.md", 1), ("a.md", 3), ("a.md", 4), ("b.md", 1), ("b.md", 2)]
    assert [r.version for r in versions.history(v, "a.md").collect()] == [4, 3, 1]
    w = versions.bulk_writes(spark.createDataFrame([("w", "../x.md", 1, T0, "c"), ("w", "index.md", 1, T0, None), ("w", "ok.md", 1, T0, "c")], "wiki_id string, path string, version long, ts timestamp, content string"))
    assert [(r.path, r.message) for r in w.collect()] == [("ok.md", "wiki: write_page wiki/ok.md")]
    with pytest.raises(PermissionError):
        versions.version(spark, "w", "./index.md", None, T0, 1)


def test_line_changes(spark):
    v = spark.createDataFrame([("w", "a.md", n, T0, "write_page", "", c, False) for n, c in ((1, "a\nb\nb"), (2, "b\nb\nb\nc"))], VERSIONS)
    assert [(r.lines_added, r.lines_removed) for r in versions.line_changes(v).orderBy("version").collect()] == [(3, 0), (2, 1)]


def test_log(spark):
    rows = log.entry(spark, "w", T0, "  did it \n", "ingest").unionByName(log.entry(spark, "w", T0 + datetime.timedelta(seconds=1), "more", ""))
    got = log.rendered(rows).orderBy("ts").collect()
    assert got[0].block == "\n## 2026-01-02T03:04:05Z [ingest]\n\ndid it\n" and got[0].message == "wiki: append_log ingest 2026-01-02T03:04:05Z"
    assert got[1].heading == "## 2026-01-02T03:04:06Z" and got[1].message == "wiki: append_log log 2026-01-02T03:04:06Z"
    assert log.log_page(rows).first().content == "# Activity Log\n\n" + got[0].block + got[1].block
    assert log.counts(rows).count() == 2


def test_users(spark):
    u = config.users_frame(spark, [{"username": "ann", "token_hash": users.hash_token("t1"), "wiki_dir": "/a", "remotes": {"o": "u"}, "auto_push_remotes": ["o"]}, {"username": "bob", "token_hash": "", "wiki_dir": "/b"}])
    asked = spark.createDataFrame([(1, "t1"), (2, "t2"), (3, "")], "request_id int, token string")
    assert [(r.request_id, r.username) for r in users.authenticated(asked, u).collect()] == [(1, "ann")]
    assert {r.request_id for r in users.rejected(asked, u).collect()} == {2, 3}
    shown = {r.username: r for r in users.list_users(u, make(spark, {"log.md": "", ".h/a.md": ""}, "ann")).collect()}
    assert shown["ann"].page_count == 2 and shown["bob"].page_count == 0 and shown["bob"].masked_token == "N/A"
    with pytest.raises(ValueError):
        users.add_user(spark, u, "ann", "t", "/a", T0)
    with pytest.raises(KeyError):
        users.rotate_token(u, "zoe", "t")
    more = users.add_remote(u.unionByName(users.add_user(spark, u, "cy", "t3", "/c", T0)), "cy", "gh", "url", auto_push=True)
    assert {(r.username, r.name, r.auto_push) for r in users.list_remotes(more).collect()} == {("ann", "o", True), ("cy", "gh", True)}
    assert users.list_remotes(users.remove_remote(more, "ann", "o")).count() == 1
    assert users.remove_user(more, "bob").count() == 2
    assert users.new_token("ann").startswith("folium_ann_") and len(users.new_token("ann")) == 43


def test_passwords_and_warnings(spark):
    import base64

    said = lambda x: "Basic " + base64.b64encode(x.encode()).decode()
    rows = spark.createDataFrame([(1, said("git:tok:en")), (2, "Bearer x"), (3, "Basic ???"), (4, said("nothing")), (5, None)], "k int, h string")
    assert {r.k: r.p for r in rows.select("k", users.basic_password(F.col("h")).alias("p")).collect()} == {1: "tok:en", 2: None, 3: None, 4: None, 5: None}
    results = spark.createDataFrame([("ann", "b", "no route"), ("ann", "a", "denied"), ("ann", "c", None), ("bob", "a", None)], "username string, name string, error string")
    assert [tuple(r) for r in users.push_warnings(results).collect()] == [("ann", ["Push to a failed: denied", "Push to b failed: no route"])]
    assert users.count_users(results).first().n_users == 4


def test_config(spark, tmp_path):
    c = config.default_config(1) | {"users": {"ann": {"token_hash": "h", "wiki_dir": "/a", "created_at": "2026-01-02T03:04:05Z", "last_active": None, "remotes": {"o": "u"}, "auto_push_remotes": []}}}
    config.save_config(c, str(tmp_path / "c.json"))
    row = config.config_users(config.read_config(spark, str(tmp_path / "c.json"))).first()
    assert c["version"] == "0.1" and config.default_config(host="h")["host"] == "h" and config.config_path("/x/") == "/x/settings.json"
    assert config.allowed_hosts("h", 9, ["h", "e"]) == ["h", "h:9", "localhost", "localhost:9", "127.0.0.1", "127.0.0.1:9", "e"]
    assert config.get_user(config.config_users(config.read_config(spark, str(tmp_path / "c.json"))), "zoe").count() == 0
    assert row.username == "ann" and row.created_at == T0 and row.last_active is None and row.remotes == {"o": "u"}


def test_folders_and_exports(spark, tmp_path):
    root = tmp_path / "wiki"
    for name, data in {"a.md": b"x\r\ny", "_top.md": b"t", ".hid/h.md": b"h", "empty.md": b"", "bad.md": b"ok \xff line\n", "n.txt": b"n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    p = corpus.read_folder(spark, str(root), "w")
    assert {r.path: r.content for r in p.collect()} == {"a.md": "x\ny", "_top.md": "t", ".hid/h.md": "h", "empty.md": ""}
    assert corpus.read_folder(spark, str(root), "w", keep_invalid=True).filter("content IS NULL").first().path == "bad.md"
    assert {r.path for r in corpus.read_files(spark, str(root), "w").collect()} == {"a.md"}
    odd = tmp_path / "a+b (c)" / "wiki" / "wiki"
    odd.mkdir(parents=True)
    (odd / "wiki").mkdir()
    (odd / "wiki" / "x.md").write_text("x")
    assert {r.path for r in corpus.read_files(spark, str(tmp_path / "a+b (c)" / "wiki"), "w").collect()} == {"wiki/wiki/x.md"}
    corpus.write_pages(p, str(tmp_path / "pages"))
    assert corpus.read_parquet_pages(spark, str(tmp_path / "pages")).count() == 4
    assert sorted(zipfile.ZipFile(export.export_archive(p, "w", "zip", str(tmp_path))).namelist()) == ["wiki/.hid/h.md", "wiki/_top.md", "wiki/a.md", "wiki/empty.md"]
    assert len(tarfile.open(export.export_archive(p, "w", "tgz", str(tmp_path))).getnames()) == 4
    with pytest.raises(ValueError):
        export.export_archive(p, "w", "rar", str(tmp_path))


def test_reads_are_pruned_and_pushed(spark, tmp_path):
    corpus.write_pages(make(spark, {"a.md": "x", "b.md": "y"}), str(tmp_path / "pages"))
    stored = corpus.read_parquet_pages(spark, str(tmp_path / "pages")).filter(F.col("wiki_id") == "w")
    plan = pages.page(stored, "a.md")._jdf.queryExecution().toString()
    assert "EqualTo(path,a.md)" in plan.split("PushedFilters:")[1] and "wiki_id" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert "content" not in pages.list_pages(stored)._jdf.queryExecution().toString().split("ReadSchema:")[1]
    assert "Python" not in search.search(stored, "x")._jdf.queryExecution().toString()


def test_links_and_ranking(spark):
    p = make(spark, {"topics/a.md": "[b](b.md) [out](https://x.org/y.md) [i](/index.md)", "topics/b.md": "---\ntags: x, y\ndate: 2026-01-02 \n---\ntext", "c.md": "zeta zeta word", "d.md": "zeta"})
    assert {(r.path, r.target) for r in links.page_links(p).collect()} == {("topics/a.md", "topics/b.md"), ("topics/a.md", "index.md")}
    assert {r.path for r in links.orphans(p).collect()} == {"topics/a.md", "c.md", "d.md"}
    assert {r.path: r.fields for r in links.front_matter(p).collect()}["topics/b.md"] == {"tags": "x, y", "date": "2026-01-02"}
    assert {r.path for r in ranking.bm25(p, ["zeta"]).collect()} == {"c.md", "d.md"}
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert ranking.nearest(v, [0.9, 0.1], 1).first().vec_id == 1


def test_store(spark, tmp_path):
    c = Corpus(spark, str(tmp_path / "store"), "ann", "guide", now=lambda: T0)
    t = Tools(c)
    c.init()
    c.init()
    assert c.list_pages() == ["index.md", "log.md"] and t.read_page("log.md") == "# Activity Log\n\n" and t.search_wiki("xyzzy_no_match_here") == "No matches found."
    assert t.write_page("topics/python.md", "# Python\n\nGreat language.") == "Page 'topics/python.md' written successfully."
    before = c.versions.count()
    c.write_page("topics/python.md", "# Python\n\nGreat language.")
    assert c.versions.count() == before
    assert t.search_wiki("great LANGUAGE") == "### topics/python.md\n  Line 3: Great language."
    assert t.write_page("../escape.md", "bad").startswith("Error: ")
    assert t.append_log("did it", "ingest") == "Log entry appended successfully."
    assert t.read_page("log.md") == "# Activity Log\n\n\n## 2026-01-02T03:04:05Z [ingest]\n\ndid it\n"
    assert t.wiki_info() == f"Wiki root: {tmp_path}/store#ann\nPages: 2\nLog entries: 1\n\n--- Wiki Schema & Workflow Instructions ---\nguide"
    assert t.delete_page("./index.md").startswith("Error: ") and t.delete_page("no.md").startswith("Error: ")
    assert t.delete_page("topics/python.md") == "Page 'topics/python.md' deleted successfully."
    assert c.list_pages("topics") == [] and t.list_pages("topics") == "No pages found."
    assert t.update_index("new") == "index.md updated successfully." and t.read_index() == "new"
    with pytest.raises(PermissionError):
        c.delete_page("log.md")
    later = Corpus(spark, str(tmp_path / "store"), "ann", "guide", now=lambda: T0 + datetime.timedelta(minutes=1))
    later.write_page("log.md", "# New\n\n## by hand\n")
    later.append_log("after it")
    assert later.read_page("log.md") == "# New\n\n## by hand\n\n## 2026-01-02T03:05:05Z\n\nafter it\n" and later.wiki_info().log_entries == 2
    assert Corpus(spark, str(tmp_path / "store"), "bob").list_pages() == []
    c.compact()


def test_stream(spark, tmp_path):
    rows = log.entry(spark, "w", T0, "a", "x").unionByName(log.entry(spark, "w", T0 + datetime.timedelta(minutes=1), "b", "x"))
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        streamed.append(streamed.read_entries(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    q = streamed.windowed_counts(streamed.read_entries(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.operation, r.n_entries) for r in spark.table("counts").collect()] == [("x", 2)]


def test_server(spark, tmp_path):
    s = Server(spark, str(tmp_path / "srv"), now=lambda: T0)
    s.init(99)
    s.init(1)
    ann, bob = s.add_user("ann"), s.add_user("bob")
    assert ann["wiki_url"] == "http://0.0.0.0:99/wiki/ann" and s.list_users().count() == 2
    with pytest.raises(ValueError):
        s.add_user("ann")
    assert s.authenticate(ann["token"]) == "ann" and s.authenticate("x") is None and s.authenticate(None) is None
    s.tools(bob["token"]).write_page("a.md", "hello")
    assert s.corpus("ann").list_pages() == ["index.md", "log.md"] and s.corpus("bob").list_pages() == ["a.md", "index.md", "log.md"]
    with pytest.raises(PermissionError):
        s.tools("x")
    new = s.rotate_token("ann")
    assert s.authenticate(ann["token"]) is None and s.authenticate(new) == "ann"
    s.add_remote("ann", "gh", "url", auto_push=True)
    assert s.list_remotes("ann") == {"gh": "url"}
    with pytest.raises(ValueError):
        s.add_remote("ann", "gh", "other")
    with pytest.raises(KeyError):
        s.list_remotes("zoe")
    s.remove_remote("ann", "gh")
    assert s.list_remotes("ann") == {}
    shown = {r.username: (r.page_count, r.last_active) for r in s.list_users().collect()}
    assert shown == {"ann": (2, T0), "bob": (3, T0)}
    assert zipfile.ZipFile(s.export("bob", "zip", str(tmp_path))).namelist() == ["wiki/a.md", "wiki/index.md", "wiki/log.md"]
    s.remove_user("bob")
    assert [r.username for r in s.list_users().collect()] == ["ann"]
    with pytest.raises(KeyError):
        s.export("bob")


def test_tokens_of_requests():
    assert token_of({"Authorization": "Bearer  t "}, {"token": "u"}) == "t"
    assert token_of({"authorization": "basic x"}, {"token": "u"}) == "u"
    assert token_of({}, {}) is None and token_of({"AUTHORIZATION": "bearer "}, {"token": "u"}) is None
