"""HTML and Markdown as text, by chains of built-in string functions.

The patterns use only what Java and RE2 share, so that a SQL check can apply the same rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import decode_entities, strip
from scriptorium.functions.urls import resolve, storage_path

# A page as lexical units: comment, script, style, opening anchor, text, any other "<".
UNITS = (
    r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<a\s[^>]*>|[^<]+|<"
)
ANCHOR = r"(?i)^<a\s"
HREF = r"""(?is)^<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
HREF_AROUND = r"""(?is)^(<a\s(?:[^>]*?\s)?href\s*=\s*)(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""

# (pattern, replacement) in order of application; replacements use $n.
HTML_RULES = (
    (r"(?is)<!--.*?-->", ""),
    # Each element up to its own end; code may hold the ends of others, so it goes first.
    (r"(?is)<script\b.*?</script\s*>", ""),
    (r"(?is)<style\b.*?</style\s*>", ""),
    (r"(?is)<head\b.*?</head\s*>", ""),
    (r"(?is)<!doctype[^>]*>", ""),
    (r"[ \t\r\n]+", " "),
    (r'(?is)<a\s(?:[^>]*?\s)?href\s*=\s*"([^">]*)"[^>]*>(.*?)</a\s*>', "[$2]($1)"),
    (r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*'([^'>]*)'[^>]*>(.*?)</a\s*>", "[$2]($1)"),
    (r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*([^\s"'>]+)[^>]*>(.*?)</a\s*>""", "[$2]($1)"),
    (r"(?i)<h1\b[^>]*>", "\n\n# "),
    (r"(?i)<h2\b[^>]*>", "\n\n## "),
    (r"(?i)<h3\b[^>]*>", "\n\n### "),
    (r"(?i)<h4\b[^>]*>", "\n\n#### "),
    (r"(?i)<h5\b[^>]*>", "\n\n##### "),
    (r"(?i)<h6\b[^>]*>", "\n\n###### "),
    (r"(?i)</h[1-6]\s*>", "\n\n"),
    (r"(?i)<li\b[^>]*>", "\n  * "),
    (r"(?i)</li\s*>", ""),
    (r"(?i)</?(?:b|strong)(?:\s[^>]*)?>", "**"),
    (r"(?i)</?(?:i|em)(?:\s[^>]*)?>", "_"),
    (r"(?i)<br\b[^>]*>", "  \n"),
    (r"(?i)<hr\b[^>]*>", "\n\n* * *\n\n"),
    (r"(?i)</?(?:p|div|ul|ol|table|article|section|footer|header|nav|blockquote)(?:\s[^>]*)?>", "\n\n"),
    (r"(?i)<tr\b[^>]*>", "\n"),
    (r"(?i)</t[dh]\s*>", " | "),
    (r"<[^>]*>", ""),
)
LAYOUT_RULES = (
    (r"\n +\n", "\n\n"),
    (r"\n{3,}", "\n\n"),
)
MARKDOWN_RULES = (
    (r"(?m)^[ \t]*(?:```|~~~).*$", ""),
    (r"!\[[^\]]*\]\([^)]*\)", ""),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"(?m)^[ \t]*(?:\*[ \t]*\*[ \t]*\*|-[ \t]*-[ \t]*-|_[ \t]*_[ \t]*_)[ \t*_\-]*$", ""),
    (r"(?m)^[ \t]{0,3}#{1,6}[ \t]+", ""),
    (r"(?m)^[ \t]*>[ \t]?", ""),
    (r"(?m)^[ \t]*(?:[*+\-]|\d+\.)[ \t]+", ""),
    (r"\*\*([^*\n]+)\*\*", "$1"),
    (r"__([^_\n]+)__", "$1"),
    (r"\*([^*\n]+)\*", "$1"),
    (r"`([^`\n]+)`", "$1"),
    (r"<[^>\n]*>", ""),
    (r"[ \t]+\n", "\n"),
)


def _apply(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def html_to_markdown(html: Column) -> Column:
    marked = decode_entities(_apply(html, HTML_RULES))
    return F.concat(strip(_apply(marked, LAYOUT_RULES)), F.lit("\n"))


def markdown_to_text(markdown: Column) -> Column:
    return strip(decode_entities(_apply(_apply(markdown, MARKDOWN_RULES), LAYOUT_RULES)))


def _units(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(UNITS), F.lit(0))


def _href(anchor: Column) -> Column:
    raw = F.regexp_extract(anchor, HREF, 1)
    return strip(decode_entities(F.regexp_replace(raw, """^["']|["']$""", "")))


def page_hrefs(html: Column) -> Column:
    """The targets of all anchors of a page, in order, entities decoded."""
    anchors = F.filter(_units(html), lambda unit: unit.rlike(HREF))
    return F.transform(anchors, _href)


def rewrite_hrefs(url: Column, html: Column) -> Column:
    """Point every anchor to the stored Markdown file of its target, in one pass over the page."""

    def rewritten(unit: Column) -> Column:
        path = storage_path(resolve(url, _href(unit)))
        encoded = F.replace(F.replace(path, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
        start = F.regexp_extract(unit, HREF_AROUND, 1)
        rest = F.regexp_replace(unit, HREF_AROUND, "")
        return F.when(unit.rlike(HREF), F.concat(start, F.lit('"'), encoded, F.lit('.md"'), rest)).otherwise(unit)

    return F.array_join(F.transform(_units(html), rewritten), "")


