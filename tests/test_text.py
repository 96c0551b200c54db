"""Text functions against goldens and against the standard library."""

import hashlib
import html
import random
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from postflow.functions import similarity, text, titles

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} STRING" for n in names))
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("markup", "expected"),
    [
        ("<p>a</p>\n\n\n<script>alert(1)</script><p>   b   c </p>", "a\n\nb c"),
        ("<h2>Sum</h2><p>We&#39;re &amp; growing.</p><ul><li>One</li><li>Two</li></ul>",
         "Sum\n\nWe're & growing.\n\n- One\n\n- Two"),
        ("x<br/>y<BR>z", "x\ny\nz"),
        ("a&nbsp;&nbsp;b", "a b"),
        ("<style>p{}</style>seen<script>var t='</p>';</script>", "seen"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ('<a title="x > y" href=\'z\'>link</a>', "link"),
        ("<!-- <p>no</p> -->yes<!DOCTYPE html>", "yes"),
        ("<lime>x</lime><li >y", "x\n- y"),
        ("&lt;p&gt;kept&lt;/p&gt;", "<p>kept</p>"),
        ("", ""),
        (None, ""),
    ],
)
def test_html_to_text(spark, markup, expected):
    assert one(spark, text.html_to_text(F.col("m")), m=markup) == expected


def test_escaped_html_is_unescaped_first(spark):
    got = one(spark, text.html_to_text(F.col("m"), escaped=True), m="&lt;p&gt;Alignment &amp;amp; evals&lt;/p&gt;")
    assert got == "Alignment & evals"


PAGE = """<!DOCTYPE html><html><head><title>Bakery</title><style>p { margin: 0 }</style></head>
<body><nav>Home&nbsp;|&nbsp;Shop</nav><h1>Bread &amp; rolls</h1>
<p>Baked  daily,\t<b>by hand</b>.</p><script>track("<p>no</p>")</script>
<ul><li>Rye &#8211; 2&#x20AC;</li><li>Spelt</li></ul><table><tr><td>Mon</td><td>7&ndash;18</td></tr></table>
<p>Caf&eacute; next door.<br>Closed on Sundays.</p></body></html>"""
PAGE_TEXT = """Bakery
Home | Shop
Bread & rolls

Baked daily, by hand.

- Rye – 2€

- Spelt

Mon7–18

Café next door.
Closed on Sundays."""


def test_html_to_text_of_a_whole_page(spark):
    assert one(spark, text.html_to_text(F.col("m")), m=PAGE) == PAGE_TEXT


def test_entities_as_the_standard_library_decodes_them(spark):
    rng = random.Random(2)
    names = sorted(html5)
    codes = [0, 9, 13, 31, 65, 127, 128, 129, 159, 160, 8364, 0xD800, 0xFDD0, 0xFFFE, 0x10FFFF, 0x110000, 10**12]
    parts = ["&", "&&", "&;", "&#;", "&#x;", "& amp;", "&notit;", "&ampamp", "&" + "q" * 40 + ";", "&amp;lt;", "&#0000065;", "a", "<"]
    for _ in range(400):
        name, code = rng.choice(names), rng.choice(codes)
        parts += [f"&{name}", f"&{name.rstrip(';')}x", f"&#{code};", f"&#{code}z", f"&#x{code:x};", f"&#X{code:X}g"]
    rows = [("".join(rng.choices(parts, k=rng.randint(0, 6))),) for _ in range(2000)] + [(p,) for p in parts]
    df = spark.createDataFrame(rows, "t STRING").select("t", text.decode_entities(F.col("t")).alias("d"))
    assert all(r["d"] == html.unescape(r["t"]) for r in df.collect())
    assert "Python" not in df.select(text.html_to_text(F.col("t"), escaped=True))._jdf.queryExecution().toString()


def test_html_array_to_text_keeps_elements_apart(spark):
    df = spark.createDataFrame([(["<ul><li>a&amp;b</li></ul>", "", "<script>x", "<p>c"],)], "f ARRAY<STRING>")
    assert df.select(text.html_array_to_text(F.col("f"))).first()[0] == ["- a&b", "", "", "c"]


@pytest.mark.parametrize(
    ("title", "expected"),
    [
        ("Night Baker (Remote)", "night baker"),
        ("Night Baker - Toronto", "night baker"),
        ("Night Baker [Oslo or Bergamo]", "night baker oslo or bergamo"),
        ("Night Baker [Oslo or Rome] | hybrid – Crumb & Co", "night baker"),
        ("Crumb & Co: Night Baker", "night baker"),
        ("Crumb & Co Night Baker", "crumb co night baker"),
        ("Baker, Night Shift", "baker night shift"),
        ("Night Baker - Sourdough", "night baker sourdough"),
        ("Night Baker - full-time", "night baker full time"),
        ("Night Baker (m / f)", "night baker"),
        ("Night Baker (IT)", "night baker it"),
        ("Night Baker (Job-4711)", "night baker"),
        ("Night Baker #20417 - Remote", "night baker"),
        ("Night Baker 20417", "night baker"),
        ("Night Baker ()", "night baker"),
        ("Other House | Night Baker", "other house night baker"),
        ("\u2003Night\u00a0 Baker\n", "night baker"),
        ("Remote", "remote"),
        (None, ""),
    ],
)
def test_normalize_title(spark, title, expected):
    assert one(spark, titles.normalize_title(F.col("t"), F.col("c")), t=title, c="Crumb & Co") == expected


def test_titles_need_no_python(spark):
    df = spark.createDataFrame([("a", "b")], "t STRING, c STRING").select(titles.normalize_title(F.col("t"), F.col("c")))
    assert "Python" not in df._jdf.queryExecution().toString()


def test_normalize_company_keeps_legal_suffixes(spark):
    assert one(spark, text.normalize_company(F.col("c")), c="Liquid AI, Inc.") == "liquid ai inc"
    assert one(spark, text.slug_for(F.col("c")), c="  Liquid AI, Inc. ") == "liquid-ai-inc"
    assert one(spark, text.slug_for(F.col("c")), c=" ?? ") is None


def test_content_hash(spark):
    def h(title, body):
        return one(spark, text.content_hash(F.lit("Acme"), F.col("t"), F.lit(None).cast("string"), F.col("b")), t=title, b=body)

    same = h("Research Scientist", "We   do\n\nRLHF.")
    assert same == h("research scientist", "We do\xa0RLHF.")
    assert same != h("Senior Research Scientist", "We do RLHF.")
    assert same == hashlib.sha256("acme\x1fresearch scientist\x1f\x1fwe do rlhf.".encode()).hexdigest()


def test_raw_hash_ignores_key_order_only(spark):
    def h(raw):
        return one(spark, text.raw_hash(F.col("r")), r=raw)

    assert h('{"a":1,"b":{"y":null,"x":[1,2]}}') == h('{"b": {"x": [1, 2], "y": null}, "a": 1}')
    assert h('{"a":[1,2]}') != h('{"a":[2,1]}')
    assert h('{"a":1}') != h('{"a":1,"b":null}')
    assert h("not json") != h("not json either")


def test_first_term(spark):
    def hit(value, terms, prefix=False):
        return one(spark, text.first_term(text.words_only(F.col("t")), terms, prefix), t=value)

    assert hit("Post Training lead", ["RLHF", "post-training"]) == "post-training"
    assert hit("posttraining", ["post-training"]) is None
    assert hit("soft", ["SFT"]) is None
    assert hit("internship", ["intern"]) is None
    assert hit("internship", ["intern"], prefix=True) == "intern"
    assert hit("evals and rlhf", ["RLHF", "evals"]) == "RLHF"
    assert hit("anything", ["--"]) is None


def test_first_terms_equals_first_term(spark):
    rows = [(1, "evals and rlhf work"), (2, "post training of models"), (3, "nothing"), (4, "")]
    terms = ["reward model", "RLHF", "post-training", "evals", "of"]
    df = spark.createDataFrame(rows, "id INT, t STRING")
    frame = spark.createDataFrame(list(enumerate(terms)), "ordinal INT, term STRING")
    got = {r["id"]: r["term"] for r in text.first_terms(df, "id", "t", frame).collect()}
    want = {r["id"]: r["w"] for r in df.select("id", text.first_term(F.col("t"), terms).alias("w")).collect()}
    assert got == {k: v for k, v in want.items() if v is not None}


def test_similarity(spark):
    ratio = similarity.token_sort_ratio(F.col("a"), F.col("b"))
    assert round(one(spark, ratio, a="research scientist post training", b="research scientist pre training"), 1) == 92.1
    assert one(spark, ratio, a="post training research scientist", b="research scientist post training") == 100
    assert one(spark, ratio, a="senior research scientist alignment", b="research scientist alignment") < 95
    assert one(spark, ratio, a="", b="") == 100


def test_native_similarity_is_exact(spark):
    """Texts of one word of bits and of several, with letters beyond the basic plane."""
    rnd, rows = random.Random(1), []
    for _ in range(300):
        a = [rnd.choice("ab c01") for _ in range(rnd.choice([0, 1, 5, 40, 61, 62, 63, 124, 125, 200]))]
        b = list(a)
        for _ in range(rnd.randrange(12)):
            if b and rnd.random() < 0.5:
                b.pop(rnd.randrange(len(b)))
            else:
                b.insert(rnd.randrange(len(b) + 1), rnd.choice("abcé🙂"))
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string").withColumn("ratio", similarity.sorted_ratio(F.col("a"), F.col("b")))
    assert "Arrow" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        assert abs(r["ratio"] - similarity.indel_similarity(r["a"], r["b"])) < 1e-9


def test_slug_variants_and_board_links(spark):
    assert one(spark, text.slug_variants(F.col("n")), n="Liquid AI") == [
        "liquidai", "liquidaiai", "liquidai-ai", "liquid-ai", "liquid-aiai", "liquid-ai-ai", "liquid"]
    assert one(spark, text.slug_variants(F.col("n")), n="ai") == ["ai", "aiai", "ai-ai"]
    link = one(spark, text.token_from_url(F.col("u")), u="https://job-boards.greenhouse.io/Acme?x=1")
    assert tuple(link) == ("greenhouse", "acme")
    assert one(spark, text.token_from_url(F.col("u")), u="https://boards.greenhouse.io/embed/job_board?for=acme")["token"] == "acme"
    assert one(spark, text.token_from_url(F.col("u")), u="https://acme.com/careers") is None
    assert one(spark, text.board_page(F.col("a"), F.col("t")), a="lever", t="acme") == "https://jobs.lever.co/acme"
    assert one(spark, text.board_page(F.col("a"), F.col("t")), a="workday", t="acme") is None


def test_cut_text(spark):
    assert one(spark, text.cut_text(F.col("t"), 5, "[cut]"), t="abcd efgh") == "abcd\n[cut]"
    assert one(spark, text.cut_text(F.col("t"), 5, "[cut]"), t=" abc ") == "abc"
    got = one(spark, text.render_posting(F.lit("Acme"), F.lit("Dev"), F.col("t"), F.lit("us"), F.lit("remote"), F.lit(" ")), t=None)
    assert got == "Company: Acme\nTitle: Dev\nLocation: not stated (parsed as region us, remote)\n\nDescription:\n(empty)"
