from pyspark.sql import functions as F

from scriptorium.functions import markup

PAGE = (
    "<html><head><title>T</title></head><body><!-- <a href='/no'>x</a> --><script>var a = \"<a href='/no2'>\";</script>"
    "<h2>Head &amp; tail</h2><p>One <b>bold</b><br>two</p><ul><li><a class=x href='../up?q#f'>up</a></li>"
    '<li><A HREF="http://other/x/y/">far</A></li><li><a href=plain>p</a></li><li><a name="n">none</a></li></ul></body></html>'
)


def test_links_skip_comments_scripts_and_anchors_without_target(value):
    assert value(markup.page_hrefs(F.col("h")), h=PAGE) == ["../up?q#f", "http://other/x/y/", "plain"]


def test_rewrite_is_one_pass_over_all_anchors(value):
    out = value(markup.rewrite_hrefs(F.lit("http://h/a/b/c"), F.col("h")), h=PAGE)
    expected = (
        PAGE.replace("href='../up?q#f'", 'href="a/up.md"')
        .replace('HREF="http://other/x/y/"', 'HREF="x/y.md"')
        .replace("href=plain", 'href="a/b/plain.md"')
    )
    assert out == expected


def test_rewritten_links_are_not_rewritten_again(value):
    out = value(markup.rewrite_hrefs(F.lit("http://h/"), F.col("h")), h='<a href="/b">1</a><a href="/b.md">2</a>')
    assert out == '<a href="b.md">1</a><a href="b.md.md">2</a>'


def test_html_to_markdown(value):
    text = value(markup.html_to_markdown(F.col("h")), h=PAGE)
    assert text.startswith("## Head & tail\n\nOne **bold**  \ntwo\n\n")
    assert "[far](http://other/x/y/)" in text and "var a" not in text and "<" not in text
    assert text.endswith("\n") and "\n\n\n" not in text


def test_markdown_to_text(value):
    source = "# Title\n\nSome **bold** and *thin* `code`, [a link](http://x) ![pic](y.png).\n\n> quoted\n\n* item\n1. one\n\n---\n\nend &amp;"
    assert value(markup.markdown_to_text(F.col("m")), m=source) == (
        "Title\n\nSome bold and thin code, a link .\n\nquoted\n\nitem\none\n\nend &"
    )


def test_elements_end_at_their_own_end_and_links_keep_their_target(value):
    to_markdown = lambda h: value(markup.html_to_markdown(F.col("h")), h=h)
    assert to_markdown("<head><script>x</script><title>TITLE</title></head>Body") == "Body\n"
    assert to_markdown('<script>var a="</style>"; LEAK()</script>Body') == "Body\n"
    assert to_markdown("<a href='x.md'>t</a>") == "[t](x.md)\n"
    assert to_markdown('<a href="y.md"><b>u</b></a>') == "[**u**](y.md)\n"
    assert to_markdown("&agrave;&ntilde;&#8217;&#x27;&amp;lt;&nothing; & &;") == "àñ’'&lt;&nothing; & &;\n"
