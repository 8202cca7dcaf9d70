"""Pages against an event parser, and malformed markup by hand."""

import html
from html.parser import HTMLParser

import duckdb
import pytest
from pyspark.sql import functions as F

from quillstone.functions import markup


class Plain(HTMLParser):
    """Blocks of well-formed pages by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.text, self.links, self.link, self.hidden = [], "", "", False, 0

    def end(self):
        text = " ".join(self.text.replace("\xa0", " ").split())
        if text:
            self.blocks.append((text, len(text), len(" ".join(self.links.replace("\xa0", " ").split())), len(text.split(" "))))
        self.text = self.links = ""

    def handle_starttag(self, tag, attrs):
        if tag in markup.BLOCK:
            self.end()
        self.hidden += tag in markup.RAW_TEXT
        self.link = self.link or tag == "a"

    def handle_endtag(self, tag):
        if tag in markup.BLOCK:
            self.end()
        self.hidden -= tag in markup.RAW_TEXT
        self.link = self.link and tag != "a"

    def handle_data(self, data):
        if not self.hidden:
            self.text += data
            self.links += data if self.link else ""


def plain(page):
    p = Plain()
    p.feed(page)
    p.close()
    p.end()
    return p.blocks


def blocks(spark, pages, column=markup.page_blocks):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string")
    return [r.b for r in df.select("page_id", column(F.col("html")).alias("b")).orderBy("page_id").collect()]


def texts(spark, *pages):
    return [[b.text for b in row] for row in blocks(spark, pages)]


def test_driver_pages_as_an_event_parser_reads_them(spark, sf_dir):
    pages = [r[0] for r in duckdb.sql(f"select html from '{sf_dir}/pages.parquet' order by page_id").fetchall()]
    got = [[tuple(b) for b in row] for row in blocks(spark, pages)]
    assert got == [plain(p) for p in pages]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("a<!-- <p>x --> b", ["a b"]),
        ("a<!-->b<!--->c", ["abc"]),
        ("a<!-- never closed <p>b", ["a"]),
        ("a<!-- x --!>b", ["ab"]),
        ('<a title="x > y">one</a>two', ["onetwo"]),
        ("<a title='x > \"y'>one</a>", ["one"]),
        ("<a title=it's>one</a><i title=\"'\">two</i>", ["onetwo"]),
        ("<script>var t = '<p>'; if (a < b) x();</script >rest", ["rest"]),
        ("<SCRIPT src=x>'</p>'</ScRiPt>rest", ["rest"]),
        ("<script>never closed <p>b", []),
        ("<scripted>shown</scripted>", ["shown"]),
        ("<style>p{}</style><xmp><p>no</p></xmp><textarea>typed</textarea>yes", ["yes"]),
        ("1 < 2 and 3 <4 <", ["1 < 2 and 3 <4 <"]),
        ("<p>one<p>two<br/>three<BR>four", ["one", "two", "three", "four"]),
        ("<pre>a  b\n\tc</pre><predicate>d</predicate>", ["a b c", "d"]),
        ("<!DOCTYPE html><?php x ?></ bogus></>a", ["a"]),
        ("a <b", ["a"]),
        ('a <b title="never closed > b', ["a"]),
        ("&lt;p&gt; &amp;amp; &#65;&#x42;&#67 &nbsp;&nope; & &#; &eacute;", ["<p> &amp; ABC &nope; & &#; é"]),
        ("x\x01y\x02z\x03", ["x y z"]),
        ("", []),
        (None, []),
        (" \n<p> </p>", []),
    ],
)
def test_malformed_markup(spark, page, want):
    assert texts(spark, page) == [want]


def test_character_references_as_the_standard_library_resolves_them(spark):
    numbers = [0, 1, 8, 9, 10, 11, 12, 14, 31, 32, 65, 127, *range(128, 161), 233, 0x20AC, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0x1F600, 0x10FFFF - 2, 0x110000, 99999999999]
    cases = [f"a&#{n};b" for n in numbers] + [f"&#x{n:x};" for n in numbers] + [f"&#X{n:X}z" for n in (0x41, 0x1F600)] + [f"&{name};" for name in sorted(markup.named())]
    cases += [f"a&{name}b" for name in markup.unclosed()] + ["&ampx;", "&amp;lt;", "&ampamp;", "&notit;", "&notin;", "&copy", "&nope;", "&#", "&#x;", "a & b", "&&amp;&"]
    assert blocks(spark, cases, markup.unescaped) == [html.unescape(c) for c in cases]


def test_links_and_main_text(spark):
    page = "<ul><li><a href=/a>one two three four five six</a></ul><p>plain words that are long <a>and one link</a> enough</p><a><p>inside a link over</p><p>two blocks of many words</p></a><p>short</p>"
    (got,) = blocks(spark, [page])
    assert [(b.chars, b.link_chars) for b in got] == [(27, 27), (45, 12), (18, 18), (24, 24), (5, 0)]
    (main,) = blocks(spark, [page], lambda c: markup.joined(markup.main_blocks(markup.page_blocks(c))))
    assert main == "plain words that are long and one link enough"


def test_very_long_pages(spark):
    """A tag of 50,000 attributes, a comment and a text of megabytes, 200,000 tags: no stack grows with them."""
    many = "<p " + " ".join(f"a{i}='>'" for i in range(50_000)) + ">in</p>"
    page = many + "<!--" + "-" * 2_000_000 + " -->" + "word " * 400_000 + "<b>x</b>" * 100_000
    ((first, second),) = blocks(spark, [page])
    assert first.text == "in" and second.words == 400_001 and second.text.endswith("x" * 100)
