"""Pages against the standard library's parser."""

import random
from html.parser import HTMLParser

from lodestone.sources import html, parsing


class Reader(HTMLParser):
    """Visible text of one element, block by block."""

    def __init__(self, inside):
        super().__init__()
        self.inside, self.depth, self.hidden, self.parts = inside, 0, 0, []

    def _tag(self, tag, change):
        if tag == self.inside:
            self.depth = max(self.depth + change, 0)
        if tag in html.HIDDEN:
            self.hidden = max(self.hidden + change, 0)
        if tag in html.BLOCKS:
            self.parts.append("\n")

    def handle_starttag(self, tag, attrs):
        self._tag(tag, 1)

    def handle_endtag(self, tag):
        self._tag(tag, -1)

    def handle_startendtag(self, tag, attrs):
        self._tag(tag, 0)

    def handle_data(self, data):
        if (self.depth or self.inside is None) and not self.hidden:
            self.parts.append(data)


def plain(text):
    if text is None:
        return None, None, html.MISSING
    for name in html.CHAIN:
        reader = Reader(None if name == "all" else name)
        reader.feed(text)
        reader.close()
        lines = (" ".join(line.split()) for line in "".join(reader.parts).split("\n"))
        content = "\n".join(line for line in lines if line)
        if content:
            return content, name, None
    return None, None, html.NO_TEXT


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, html string")
    got = {r.id: (r.content, r.parser, r.error) for r in html.parse(df, "id", "html").collect()}
    for i, text in enumerate(texts):
        assert got[i] == plain(text), text


def test_random_pages_equal_the_standard_parser(spark):
    rng = random.Random(11)
    pieces = ["<p>", "</p>", "<br/>", "<b>", "</b>", "<article>", "</article>", "<body class='x'>", "</body>", "<nav>", "</nav>", "<P>", "<div\n id=a>",
              "</div>", "one two", " ", "\n", "a &amp; b", "&lt;p&gt;", "&#65;&#x42;", "&#38;lt;", "&copyright", "é　ü", "<!-- <p>no</p> -->",
              "<script>if (a < b) '<p>';</script>", "<style>p{}</style>", "<head>t</head>", "x &amp", "<section>"]
    check(spark, ["".join(rng.choice(pieces) for _ in range(rng.choice([1, 3, 8, 30]))).replace("&copyright", "& c") + "." * (i % 2) for i in range(150)])


def test_edges(spark):
    check(spark, [None, "", "   ", "<p></p>", "text", "<nav>only links</nav>", "<article> </article><body>b</body>", "<body>" + "<p>word &amp; word</p>" * 20000])


def test_references_without_a_character(spark):
    df = spark.createDataFrame([(1, "a&#0;b&#x110000;c&#99999999999999999999;d&#xD800;e&unknown;f")], "id int, html string")
    assert html.parse(df, "id", "html").first().content == "a�b�c�d�e&unknown;f"


def test_failures_are_rows(spark):
    def angry(v):
        raise ValueError(v)

    df = spark.createDataFrame([(1, "x"), (2, "")], "id int, raw string")
    got = parsing.extract_pages(df, "id", "raw", [("angry", angry), ("same", lambda v: [v])], failures=True)
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, 1, "x", "same", None), (2, None, None, None, "angry: ValueError: ; same: no text")]
