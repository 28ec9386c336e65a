from hypothesis import given, settings
from hypothesis import strategies as st

from tidings.functions import html as H


def test_links_with_offsets():
    out = H.text_with_link_offsets('<p>Acme <a href="https://x.org/press">said</a> today</p>')
    assert out["article_text"] == "Acme said today"
    assert out["links"] == [{"href": "https://x.org/press", "text": " said ", "char_start_idx": 4, "char_end_idx": 10}]


def test_anchor_without_address_goes_with_its_text():
    out = H.text_with_link_offsets('a <a name="x">gone</a> b <a href="javascript:f()">gone too</a><a href="/y">kept</a>')
    assert "gone" not in out["article_text"]
    assert [x["href"] for x in out["links"]] == ["/y"]


def test_dropped_tags_and_entities():
    page = "<html><head><title>t</title></head><body><nav><a href='/n'>nav</a></nav>A &amp; B<script>var x='</p>'</script> <meta>é</body></html>"
    assert H.text_with_link_offsets(page)["article_text"] == "A &amp; B e"
    assert H.page_text(page).split() == ["A", "&", "B", "é"]
    assert H.text_with_link_offsets(page)["links"] == []


def test_anchor_lists():
    page = '<a href="/a" title="T">x <b>y</b></a><a href="/b"></a><a>z</a><a href="">e</a>'
    assert H.page_anchors(page)[0] == ({"href": "/a", "title": "T"}, "x y")
    assert [t for a, t in H.page_anchors(page) if a.get("href")] == ["x y", ""]


pieces = st.lists(
    st.one_of(
        st.text(alphabet="ab <>&é\n", max_size=8).map(lambda s: s.replace("<", "&lt;")),
        st.tuples(st.sampled_from(["/a", "https://x.org/p", ""]), st.text(alphabet="xy \n", max_size=5)).map(
            lambda p: f'<a href="{p[0]}">{p[1]}</a>'
        ),
        st.sampled_from(["<p>", "</p>", "<nav>n</nav>", "<script>s</script>", "<a>q</a>", "<br/>"]),
    ),
    max_size=12,
)


@settings(max_examples=200, deadline=None)
@given(pieces)
def test_offsets_cut_out_the_link_text(parts):
    out = H.text_with_link_offsets("".join(parts))
    for link in out["links"]:
        assert out["article_text"][link["char_start_idx"] : link["char_end_idx"]] == link["text"]
        assert link["text"].startswith(" ") and link["text"].endswith(" ")


def test_udfs(spark):
    df = spark.createDataFrame([('<p>a <a href="/x" itemprop="i">b</a></p>',), (None,)], "html string")
    row = df.select(H.links_with_offsets("html").alias("d"), H.extract_links("html").alias("l"), H.hyperlink_attributes("html").alias("h"))
    first, second = row.collect()
    assert first.d.article_text == "a b " and first.l[0].href == "/x" and first.h[0].itemprop == "i"
    assert second.d.article_text == "" and second.l == []
