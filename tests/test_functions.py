"""Text and masking functions against plain Python and on awkward input."""

import base64
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import masking, text
from docloom.functions.fixed import PROTECTED_TERMS, WHITE_SPACE
from docloom.sources import requests as req


def column(spark, values, expr, name="x"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r.out for r in df.select("i", expr.alias("out")).orderBy("i").collect()]


def test_trim_matches_strip(spark):
    values = [a + "x y" + b for a in WHITE_SPACE for b in WHITE_SPACE] + ["", " \n", "x​"]
    assert column(spark, values, text.trim_ws("x")) == [v.strip() for v in values]


def test_extract_body_edge_cases(spark):
    values = ["<body></body>x", "<BODY a='1'>\n<p>é</p></Body></body>", "no body", "<body>open"]
    assert column(spark, values, text.extract_body("x")) == ["", "\n<p>é</p>", "no body", "<body>open"]


def test_strip_tags_unclosed(spark):
    assert column(spark, ["a<b>c<d", "<", "x > y"], text.strip_tags("x")) == ["a c ", " ", "x > y"]


def test_fences(spark):
    values = ["```\na\n```", "```json\na\nb", "```\na", "```", "a\n```", "```\n\n a \n ``` "]
    assert column(spark, values, text.strip_code_fence("x", "plain")) == ["a", "a", "```\na", "```", "a\n```", "\n a "]
    assert column(spark, values, text.strip_code_fence("x", "safe")) == ["a", "a\nb", "```\na", "```", "a\n```", "a"]
    assert column(spark, values, text.strip_code_fence("x", "review")) == ["a", "a", "", "", "a\n```", "a"]


def test_output_name(spark):
    assert column(spark, ["a.DOCX", "b.pdf.pdf", "c.txt", None, ".docx"], text.output_name("x", ".html")) == [
        "translated_a.html", "translated_b.pdf.html", "translated_c.txt.html", "translated_document.html",
        "translated_document.html"]


def test_entities_single_pass(spark):
    assert column(spark, ["&amp;#39;", "&quot;a&#39;"], text.decode_entities("x")) == ["&#39;", "\"a'"]


def plain_mask(value, terms):
    found = []
    for i, t in enumerate(terms):
        if t in value:
            found.append((f"__TERM_{i}__", t))
            value = value.replace(t, f"__TERM_{i}__")
    return value, found


def test_mask_terms_is_ordered_substring_replacement(spark):
    rnd = random.Random(3)
    pool = PROTECTED_TERMS + ["COMPANY", "LOAN", "APRIL", " ", "x", "NOCIN", "NPAN", "__TERM_2__"]
    values = ["".join(rnd.choice(pool) for _ in range(rnd.randrange(12))) for _ in range(200)]
    m = column(spark, values, masking.mask_terms("x"))
    assert [(r.text, [tuple(e) for e in r.term_map]) for r in m] == [plain_mask(v, PROTECTED_TERMS) for v in values]


def test_mask_terms_options(spark):
    whole = column(spark, ["PAN COMPANY LOAN APR.", "GSTGST GST"], masking.mask_terms("x", whole_word=True)["text"])
    assert whole == ["__TERM_25__ COMPANY LOAN __TERM_40__.", "GSTGST __TERM_24__"]
    html = column(spark, ["L&amp;T Finance and L&T"], masking.mask_terms("x", html=True))
    assert html[0].text == "__TERM_5A__ and __TERM_6__"
    assert column(spark, [html[0].text], F.lit("L&amp;T Finance and L&T")) == ["L&amp;T Finance and L&T"]


def test_masking_round_trip(spark):
    rnd = random.Random(5)
    pool = ["[[PAN]]", "[[a]]", "[[a]] [[a]]", "[[x\ny]]", "L&T Finance", "GST", " ", "\n", "\\", "$1", "]]", "[["]
    values = ["".join(rnd.choice(pool) for _ in range(rnd.randrange(30))) for _ in range(200)]
    for prefix in ("", "R"):
        m = masking.mask_protected("x", prefix=prefix, html=True)
        assert column(spark, values, masking.unmask(m["text"], m["term_map"])) == values


def test_many_tokens(spark):
    """Eleven tokens and more: the first must not damage the eleventh."""
    styles = "".join(f"<style>s{i}\\d</style>" for i in range(25))
    pics = "".join(f'<img src="data:image/png;base64,{i}A">' for i in range(25))
    m, p = masking.mask_styles("x"), masking.mask_images("x")
    assert column(spark, [styles], masking.unmask_styles(m["text"], m["term_map"])) == [styles]
    assert column(spark, [pics], masking.unmask_images(p["text"], p["term_map"])) == [pics]
    bare = F.regexp_replace(m["text"], '<div class="(STYLE_PLACEHOLDER_[0-9]+)"></div>', "$1;")
    assert column(spark, [styles + "z"], masking.unmask_styles(bare, m["term_map"])) == [styles + ";" * 25 + "z"]


def test_images_need_matching_quotes(spark):
    values = ["<img src=\"data:image/png;x'>", "<img src='data:image/gif;b'>", '<img src="a.png">']
    m = column(spark, values, masking.mask_images("x"))
    assert [r.text for r in m] == [values[0], "<img src='IMG_PLACEHOLDER_0'>", values[2]]


def test_base64_reads_as_leniently_as_python(spark):
    rnd = random.Random(11)
    values = ["!!!not-valid-base64!!!", "aGVsbG8", "aGVsbG8=", "aGVs bG8\n=", "QUJD=QUJD", "QQ==junk", "", "=", "Q=Q="]
    values += ["".join(rnd.choice("QUJDab+/=!\n") for _ in range(rnd.randrange(14))) for _ in range(400)]
    want = []
    for v in values:
        try:
            want.append(base64.b64decode(v))
        except ValueError:
            want.append(None)
    df = spark.createDataFrame([(i, v, "a.pdf") for i, v in enumerate(values)], "i int, file_data string, filename string")
    got = req.decode_base64_requests(df).orderBy("i").collect()
    assert [None if r.content is None else bytes(r.content) for r in got] == want
    assert all((r.status == 200) == (w is not None) for r, w in zip(got, want))


def test_request_rejects(spark):
    df = spark.createDataFrame([("QUJD", "test.txt"), ("x", "test.txt"), ("QUJD", "A.DOCX")], "file_data string, filename string")
    got = [(r.status, r.detail) for r in req.decode_base64_requests(df).collect()]
    assert got == [(400, "filename must end with .pdf or .docx"), (400, "Invalid base64 data"), (200, None)]


def test_url_types(spark):
    rows = [("http://h/a.PDF?x=.docx", None), ("http://h/a", "application/pdf"), ("http://h/a.docx", "application/pdf"),
            ("http://h/a.docx", ""), ("http://h/a", "text/html"), ("http://h/?f=a.pdf", None)]
    df = spark.createDataFrame(rows, "url string, content_type string")
    assert [r.file_type for r in req.detect_file_type(df).collect()] == ["pdf", "pdf", "pdf", "docx", None, None]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="<>&\"' aé\xa0x;#39quotamp", max_size=20), min_size=1, max_size=40))
def test_escape_round_trip(spark, values):
    values = [v for v in values if "\xa0" not in v] or [""]
    assert column(spark, values, text.unescape_html(text.escape_html("x"))) == values
