import unicodedata
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidings import lexicon
from tidings.functions import arrays, dates, text, urls
from tidings.operators import predicates as pred

L = F.lit


def test_urls(one):
    assert one(urls.clean_url(L("https://a.org/x/y?z=1#t"))) == "https://a.org/x/y"
    assert one(urls.strip_url(L("com,nytimes)/2020/01/a.html?x=1"))) == "/2020/01/a.html"
    assert one(urls.surt_to_url(L("com,nytimes)/2020/01/a.html"))) == "https://www.nytimes.com/2020/01/a.html"
    assert one(urls.surt_to_url(L("com,unknown)/a"))) is None
    assert one(urls.clean_crawl_key(L("com,a)/x/com,a)/x/y.html?q"))) == "/x/y.html"
    assert one(urls.domain_of_host(L("help.nytimes.com"))) == "nytimes"
    assert one(urls.registered_domain(L("https://u:p@News.Site.co.uk:80/a"))) == "site"
    assert one(urls.registered_domain(L("http://localhost/a"))) == "localhost"
    assert one(urls.url_host(L("https://[::1/a"))) is None


def test_crawl_lines(one):
    line = L('com,nytimes)/2020/01/a.html 20200102030405 {"url": "https://www.nytimes.com/2020/01/a.html", "status": "200"}')
    assert one(F.size(urls.crawl_key_parts(line))) == 2
    assert one(urls.crawl_packet(line))["status"] == "200"
    assert one(urls.crawl_date(line)) == "20200102030405"
    assert one(urls.crawl_packet(L("broken line"))) is None
    assert one(urls.crawl_packet(L('k 1 {"a": {"url": "u", "status": "404"}')))["status"] == "404"


@pytest.mark.parametrize(
    ("href", "shown", "expected"),
    [
        ("/press/x", "press release", False),
        ("mailto:a@b.org", "press release", False),
        ("https://www.nytimes.com/press", "press release", False),
        ("https://acme.org/a", "read the press release", True),
        ("https://acme.org/a", "Press Release", False),
        ("https://www.prnewswire.com/a", "here", True),
        ("https://acme.org/about", "here", False),
        ("https://[acme.org/press", "here", False),
        ("@press", "press release", False),
        ("#press", "press release", False),
    ],
)
def test_link_rule(one, spark, href, shown, expected):
    assert one(pred.is_release_link(L(href), L(shown), ["nytimes"])) is expected
    links = spark.createDataFrame([(href, shown)], "href string, text string")
    blocked = spark.createDataFrame([("nytimes",)], "domain string")
    assert pred.flag_release_links(links, blocked).first()["is_press_release"] is expected


def test_sentence_predicates(one):
    assert one(text.readable_sentence(L("a b c d"))) is False
    assert one(text.readable_sentence(L("a b c d e"))) is True
    assert one(text.readable_sentence(L("a b c d e\nf"))) is False
    assert one(text.readable_sentence(L("abcdefghi " * 100))) is False
    assert one(text.readable_sentence(L("a b c d e f g h i j k l\n" * 10))) is False
    assert one(text.acceptable_sentence(L("the market fell sharply again today"))) is True
    assert one(text.acceptable_sentence(L("the and of fell"))) is False
    assert one(text.content_word_count(L("The theory of the THE thing"))) == 2


def test_sentences(one):
    assert one(text.sentences(L("One two.  Three? four! Five.\nÉ six."))) == ["One two.", "Three? four!", "Five.", "É six."]
    assert one(text.clean_sentences(L("A  b.\n\nC’d e. F")))[1:] == ["C'd e.", "F"]
    assert one(text.split_marked_sentences(L("a. B<NEW_SENT>c"))) == ["a. B", "c"]


def test_transliteration_equals_the_python_form(one):
    sample = "Ünïcödé – “quotes” … ½ straße Œuvre Œ €5 ﬁn Ωmega 漢字 Æsir Łódź é"
    assert one(text.transliterate(L(sample))) == lexicon.to_ascii(sample)
    letters = "".join(chr(c) for c in range(0xC0, 0x250))
    assert one(text.transliterate(L(letters))) == lexicon.to_ascii(letters)
    assert all(len(v) == 1 for v in lexicon.SINGLE_FORMS.values())
    assert unicodedata.normalize("NFKD", "é")[0] == lexicon.SINGLE_FORMS["é"]


def test_text_helpers(one):
    assert one(text.count_pieces(L("a said b said"), L(" said"))) == 3
    assert one(text.count_pieces(L("a.b+c.b"), L(".b"))) == 3
    assert one(text.string_difference(L("aabddeefghilnnns"), L("bandedangelfish"))) == "n"
    assert one(text.kth_char(L("ab cd"), L(3))) == "c"
    assert one(text.kth_char(L("ab"), L(0))) == ""
    assert one(text.prefixed_value(L("URL http://a\nS1 x"), "URL ")) == "http://a"
    assert one(text.prefixed_value(L("S1 x"), "URL ")) is None
    with pytest.raises(Exception, match="more than one line"):
        one(text.prefixed_value(L("URL a\nURL b"), "URL "))
    assert one(text.split_punctuation(L("a-b, c.d"))) == ["a", "b", "c", "d"]
    assert one(text.normalize_text(L(" a\n<b>é</b> "))) == "a e"
    assert one(text.normalize_text(L(None).cast("string"))) == ""
    assert one(text.quote_for_viewer(L('<p>say "é"</p> '))) == "say ''e''"
    assert one(text.remove_part(L("Head body"), L("Head"))) == "body"
    assert one(text.lines_with_phrase(L("x A\nBy A\nno"), "A", "By")) == ["x A"]
    assert one(text.prepare_for_resolution(F.array(L("A b ."), L("C\nd")), 4)) == "A b. C d"
    assert one(text.capitalised_phrases(L("said Acme Corp. today with Jane Doe and Acme Corp."))) == ["Acme Corp", "Jane Doe"]


def test_dates(one):
    expect = datetime(2021, 3, 4, 5, 6, 7)
    assert one(dates.canonical_timestamp(L("None"), L("20210304050607"))) == expect
    assert one(dates.canonical_timestamp(L("2020-01-02"), L("x"))) == datetime(2020, 1, 2)
    assert one(dates.canonical_timestamp(L("None"), L("Not Found"))) is None
    assert one(dates.parse_date(L("March 4, 2021"))) == datetime(2021, 3, 4)
    assert one(dates.parse_date(L("nonsense"))) is None
    assert one(dates.parse_compact_date(L(20210304))) == datetime(2021, 3, 4)
    assert one(dates.capture_stamp(L("2021-03-04 05:06:07").cast("timestamp"))) == 20210304050607
    assert dates.parse_interval("12h") == timedelta(hours=12)
    assert dates.parse_interval("6 weeks") == timedelta(weeks=6)
    assert dates.parse_interval("1h 30m") == timedelta(minutes=90)
    for bad in ("soon", "", "12 parsecs", "h12"):
        with pytest.raises(ValueError, match="duration"):
            dates.parse_interval(bad)


def test_arrays(one):
    assert one(arrays.decay_weights(L(5), L(1), 1, 0.5)) == [0.5, 1.0, 0.5, 0.0, 0.0]
    assert one(arrays.repeated_elements(F.array(*map(L, "babcab")))) == ["a", "b"]
    assert one(arrays.repeated_elements(F.array().cast("array<string>"))) == []
    assert one(arrays.softmax(F.array(L(0.0), L(0.0)))) == [0.5, 0.5]
    assert one(arrays.softmax(F.array(L(1000.0), L(0.0)))) == [1.0, 0.0]
    assert one(arrays.argmax_label(F.array(L(0.2), L(0.5), L(0.5)), ["a", "b", "c"])) == "b"
    assert one(arrays.shares_any(F.array(L("a"), L(None)), F.array(L("b"), L(None)))) is False
    assert one(arrays.cut_span(L("abcdef"), L(4), L(2))) == "cde"
    assert one(arrays.clean_entities(F.array(L(" Acme ")))) == ["acme"]
    assert one(arrays.clean_entities(L(None).cast("array<string>"))) == []
    assert one(arrays.discourse_id(L("NA"))) == one(arrays.discourse_id(L("Error"))) == 8
    assert one(arrays.has_ambiguous_source(F.array(L("speaker-1"), L(None)))) is True
    assert one(arrays.map_values(L("q"), {"a": "b"})) == "q"


@pytest.mark.parametrize(("flags", "kind"), [((0, 0), "Unmatched"), ((0, 1), "Archive"), ((1, 0), "Press Release"), ((1, 1), "Both")])
def test_two_flag_type(one, flags, kind):
    assert one(arrays.two_flag_type(L(flags[0]), L(flags[1]))) == kind


def test_quote_types(one):
    assert one(arrays.quote_type(L("TWEET"), L("x"))) == "SOCIAL MEDIA POST"
    assert one(arrays.quote_type(L("QUOTE"), L('a "b"'))) == "INDIRECT QUOTE"
    assert one(arrays.quote_type(L("QUOTE"), L("a"))) == "DIRECT QUOTE"
    assert one(arrays.quote_type(L("QUOTE"), L("a"), swap_quotes=True)) == "INDIRECT QUOTE"
    assert one(arrays.quote_type(L("Other: Evaluation"), L("a"))) == "DIRECT QUOTE"


@pytest.mark.parametrize(("codes", "kept"), [(["HEADS", "ERN"], False), (["ERN"], True), (["X"], False), ([None], False)])
def test_code_filter(spark, codes, kept):
    df = spark.createDataFrame([(codes,)], "codes array<string>")
    assert (pred.code_filter(df, F.col("codes"), ["HEADS"], ["ERN"]).count() == 1) is kept


def test_exactly_one(spark):
    df = spark.createDataFrame([(1, 0), (0, 1), (1, 1), (0, 0)], "a int, b int")
    assert {tuple(r) for r in pred.exactly_one(df, "a", "b").collect()} == {(1, 0), (0, 1)}


def test_slices_partition_the_rows(spark):
    df = spark.range(101).withColumn("k", F.col("id") % 3)
    low, high = pred.percent_slice(df, ["k", "id"], 0, 0.5), pred.percent_slice(df, ["k", "id"], 0.5, 1)
    assert (low.count(), high.count()) == (50, 51)
    assert low.join(high, "id").count() == 0


def test_value_filter_and_errors(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    table = spark.createDataFrame([("a",), ("a",), (None,)], "y string")
    assert [r.x for r in pred.value_filter(df, "x", table).collect()] == ["a"]
    assert {r.x for r in pred.value_filter(df, "x", ["a"], keep=False).collect()} == {"b", None}
    assert {r.x for r in pred.value_filter(df, "x", table, keep=False).collect()} == {"b", None}
    docs = spark.createDataFrame([(["s1", "s2"], [0.05, 0.1]), (["s3"], [0.9])], "s array<string>, p array<double>")
    assert [r.s for r in pred.drop_error_sentences(docs, "p", ["s"]).collect()] == [["s1"]]
