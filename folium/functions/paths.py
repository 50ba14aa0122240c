"""Page paths: keys like topics/python.md, relative, with / between components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INDEX, LOG = "index.md", "log.md"


def checked(path: str) -> str:
    """path without . components and doubled separators; ValueError if it is empty, absolute or leaves the corpus."""
    if not path:
        raise ValueError("Path must not be empty")
    parts = path.split("/")
    if path.startswith("/") or ".." in parts:
        raise ValueError(f"Path must stay inside of the corpus: {path!r}")
    clean = "/".join(p for p in parts if p not in ("", "."))
    if not clean:
        raise ValueError(f"Path names no page: {path!r}")
    return clean


def parts(path: Column) -> Column:
    return F.split(path, "/")


def name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def is_valid(path: Column) -> Column:
    return F.coalesce((path != "") & ~path.startswith("/") & ~F.array_contains(parts(path), ".."), F.lit(False))


def is_page(path: Column) -> Column:
    return path.endswith(".md")


def is_visible(path: Column) -> Column:
    """No component is hidden. Only components of the page's own path count, wherever the corpus is stored."""
    return ~F.exists(parts(path), lambda p: p.startswith("."))


def is_listed(path: Column) -> Column:
    return is_page(path) & is_visible(path)


def is_protected(path: Column) -> Column:
    return path.isin(INDEX, LOG)


def is_below(path: Column, directory: str) -> Column:
    """In the directory, not only of the same beginning."""
    return path.startswith(checked(directory) + "/")


def label(path: Column) -> Column:
    """The last component without any .md in it."""
    return F.replace(name(path), F.lit(".md"), F.lit(""))


def depth(path: Column) -> Column:
    return F.size(parts(path)) - 1


def with_extension(path: Column) -> Column:
    return F.when(is_page(path), path).otherwise(F.concat(path, F.lit(".md")))


def breadcrumbs(path: Column, home_url: Column) -> Column:
    """array<struct<label, url>>: Home, then the components; only Home has a URL."""
    crumb = lambda text, url: F.struct(text.alias("label"), url.alias("url"))
    rest = F.transform(parts(F.replace(path, F.lit(".md"), F.lit(""))), lambda p: crumb(p, F.lit(None).cast("string")))
    return F.concat(F.array(crumb(F.lit("Home"), home_url)), rest)


def component_order(path: Column) -> Column:
    """Sort key by components: topics/a.md comes before topics-x.md."""
    return parts(path)
