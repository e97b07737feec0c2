"""URL functions: parts, reference resolution, storage paths, routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import basename, let

# RFC 3986, appendix B, with the scheme restricted to its legal characters.
URL_PATTERN = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#((?s:.*)))?"

# Schemes under which a reference may be relative.
HIERARCHICAL = ("", "http", "https", "ftp", "file")


def split_url(url: Column) -> Column:
    """``STRUCT<scheme, host, path, query, fragment>``; absent parts are empty."""
    return F.struct(
        F.lower(F.regexp_extract(url, URL_PATTERN, 1)).alias("scheme"),
        F.regexp_extract(url, URL_PATTERN, 2).alias("host"),
        F.regexp_extract(url, URL_PATTERN, 3).alias("path"),
        F.regexp_extract(url, URL_PATTERN, 4).alias("query"),
        F.regexp_extract(url, URL_PATTERN, 5).alias("fragment"),
    )


def url_path(url: Column) -> Column:
    """The path, without the ``;parameters`` of the last segment of a web address."""

    def of(parts: Column) -> Column:
        web = parts["scheme"].isin(*HIERARCHICAL)
        return F.when(web, F.regexp_replace(parts["path"], ";[^/]*$", "")).otherwise(parts["path"])

    return let(split_url(url), of)


def _unsplit(scheme: Column, host: Column, path: Column, query: Column, fragment: Column) -> Column:
    rooted = F.when((host != "") & (path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""),
        rooted,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )


def _merge_paths(base_path: Column, path: Column) -> Column:
    """The path of a reference laid over that of its page, dot segments removed."""
    folder = F.substring(base_path, F.lit(1), F.length(base_path) - F.length(basename(base_path)))
    rooted = F.when(folder == "", "/").otherwise(folder)
    absolute = path.startswith("/")

    def walk(done: Column, segment: Column) -> Column:
        return (
            F.when(segment == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .when(segment == ".", done)
            .otherwise(F.array_append(done, segment))
        )

    def merged(segments: Column) -> Column:
        last = F.size(segments) - 1
        # In a relative reference doubled slashes collapse; in an absolute one they stay.
        kept = F.filter(segments, lambda segment, i: absolute | (segment != "") | (i == 0) | (i == last))
        # A final dot segment leaves an empty one behind.
        closing = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(
            F.array().cast("array<string>")
        )
        return F.array_join(F.concat(F.aggregate(kept, F.array().cast("array<string>"), walk), closing), "/")

    joined = F.when(absolute, path).otherwise(F.concat(rooted, path))
    return F.coalesce(F.nullif(let(F.split(joined, "/", -1), merged), F.lit("")), F.lit("/"))


def resolve(base: Column, href: Column) -> Column:
    """The absolute URL of ``href`` found on the page ``base`` (RFC 3986, section 5)."""

    def joined(urls: Column) -> Column:
        page, reference = urls["base"], urls["reference"]
        scheme = F.coalesce(F.nullif(reference["scheme"], F.lit("")), page["scheme"])
        same_document = reference["path"] == ""
        own_host = reference["host"] != ""
        path = (
            F.when(own_host, reference["path"])
            .when(same_document, page["path"])
            .otherwise(_merge_paths(page["path"], reference["path"]))
        )
        query = F.when(~own_host & same_document & (reference["query"] == ""), page["query"]).otherwise(
            reference["query"]
        )
        target = F.struct(
            scheme.alias("scheme"),
            F.when(own_host, reference["host"]).otherwise(page["host"]).alias("host"),
            path.alias("path"),
            query.alias("query"),
            reference["fragment"].alias("fragment"),
        )
        return let(
            target,
            lambda t: F.when(urls["target"] == "", urls["whole"])
            .when((t["scheme"] != page["scheme"]) | ~t["scheme"].isin(*HIERARCHICAL), urls["target"])
            .otherwise(_unsplit(t["scheme"], t["host"], t["path"], t["query"], t["fragment"])),
        )

    return let(
        F.struct(base.alias("whole"), href.alias("target")),
        lambda urls: let(
            F.struct(
                urls["whole"].alias("whole"),
                urls["target"].alias("target"),
                split_url(urls["whole"]).alias("base"),
                split_url(urls["target"]).alias("reference"),
            ),
            joined,
        ),
    )


def storage_path(url: Column) -> Column:
    """Where a page is stored: its path without empty segments, ``index`` for the root."""
    segments = F.filter(F.split(url_path(url), "/"), lambda segment: segment != "")
    return F.coalesce(F.nullif(F.array_join(segments, "/"), F.lit("")), F.lit("index"))


def canonical(url: Column) -> Column:
    """The address of the page: the URL without its fragment."""
    return F.substring_index(url, "#", 1)


def is_pdf(url: Column) -> Column:
    """Decided on the whole address, so ``x.pdf?y`` is not a PDF."""
    return F.lower(url).endswith(".pdf")


def is_remote(source: Column) -> Column:
    return source.startswith("http://") | source.startswith("https://")


def pdf_file_name(url: Column) -> Column:
    name = basename(url_path(url))
    return F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))


def in_scope(url: Column, start_url: str) -> Column:
    return url.startswith(start_url)
