"""Archives as crawlers and other tools write them."""

from __future__ import annotations

import gzip
import uuid
from io import BytesIO

import pytest

from shoal.llm import warc
from shoal.llm._base import work_dir

HTML = b"<html>\r\n\r\n<p>caf\xc3\xa9</p></html>\n"
PAGE = b"HTTP/1.0 404 Not Found\r\nServer: old/1.0\r\nContent-Type: text/html\r\nX-Empty:\r\n\r\n" + HTML
BARE = b"HTTP/1.0 200 OK\nContent-type: text/plain\n\nplain\n\ntext"
ABOUT = b"1 0 Some Crawler\nURL IP-address Archive-date Content-type Archive-length\n"
ARC = (
    b"filedesc://IA-000001.arc 0.0.0.0 19960923142103 text/plain %d\n%s\n" % (len(ABOUT), ABOUT)
    + b"http://www.example.com:80/a b.html 192.0.2.1 19961104142103 text/html %d\n%s\n" % (len(PAGE), PAGE)
    + b"http://www.example.com/bare 192.0.2.2 19961104142104 text/plain %d\n%s\n" % (len(BARE), BARE)
    + b"dns:www.example.com 192.0.2.3 19961104142105 text/dns 12\n192.0.2.1 ok\n"
)


def members(records):
    """Each record a gzip member of its own, as .arc.gz files have them."""
    return b"".join(map(gzip.compress, records))


@pytest.mark.parametrize("data", [ARC, gzip.compress(ARC), members([ARC[:60], ARC[60:200], ARC[200:]])])
def test_arc_as_crawlers_wrote_it(data):
    page, bare, dns = warc.read_arc(BytesIO(data))
    assert (page.url, page.ip, page.date, page.mime, page.status) == ("http://www.example.com:80/a b.html", "192.0.2.1", "19961104142103", "text/html", "404")
    assert page.http() == (PAGE[: -len(HTML)], HTML) and bare.http() == (BARE[:-11], b"plain\n\ntext")
    assert dns.status == "200" and dns.http()[1] == b"192.0.2.1 ok" and dns.http()[0].startswith(b"HTTP/1.1 200 OK\r\n")


def test_one_http_header_and_standard_fields():
    (page, *_) = warc.read_arc(BytesIO(ARC))
    digest = warc.payload_digest(HTML)
    data = warc.warc_info("a.warc.gz") + warc.warc_record(page, 7, digest) + warc.warc_record(page, 3, digest, warc.Response(7, page.url, page.date))
    (info, _, _), (response, http, payload), (revisit, _, rest) = warc.read_warc(BytesIO(data))
    assert info["WARC-Type"] == "warcinfo" and info["Content-Type"] == "application/warc-fields"
    assert payload == HTML and http["Server"] == "old/1.0" and int(response["Content-Length"]) == len(PAGE)
    assert gzip.decompress(data).count(b"HTTP/1.0 404") == 2 and b"HTTP/1.1" not in gzip.decompress(data)
    assert revisit["WARC-Refers-To"] == response["WARC-Record-ID"] and uuid.UUID(response["WARC-Record-ID"][10:-1])
    assert (revisit["WARC-Refers-To-Target-URI"], revisit["WARC-Refers-To-Date"], rest) == (page.url, "1996-11-04T14:21:03Z", b"")
    assert revisit["WARC-Profile"] == warc.REVISIT and revisit["WARC-Payload-Digest"] == response["WARC-Payload-Digest"]


def test_files_to_archives(spark):
    folder, paths = work_dir(spark), []
    for k, data in enumerate((ARC, gzip.compress(ARC), b"")):
        paths.append(f"{folder}/{k}.arc")
        with warc.shared_file(paths[-1], "wb") as out:
            out.write(data)
    records = warc.arc_files(spark.createDataFrame([(p,) for p in [*paths, None]], "path string"))
    got = sorted((r.url, r.ip, r.mime, r.status, r.size) for r in records.collect())
    assert len(got) == 6 and got[0] == got[1] == ("dns:www.example.com", "192.0.2.3", "text/dns", "200", 12) and got[-1][3:] == ("404", len(HTML))
    keyed = records.selectExpr("monotonically_increasing_id() AS page_id", "url", "ip", "date", "mime", "status", "body", "digest", "size")
    back = warc.read_archives(warc.write_archives(keyed, work_dir(spark))).collect()
    assert sorted(r.record_type for r in back) == ["response"] * 3 + ["revisit"] * 3
    kept = {r.payload_digest: r.page_id for r in back if r.record_type == "response"}
    assert all(r.refers_to == kept[r.payload_digest] > r.page_id for r in back if r.record_type == "revisit")


def test_payload_on_a_third_of_all_pages(spark):
    rows = [(k, f"http://h/{k}", "same" * 50 if k % 3 == 0 else f"page {k}") for k in range(3000)]
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: ("revisit", 2997) if k % 3 == 0 and k < 2997 else ("response", None) for k in range(3000)}


def test_damaged_revisit(spark):
    (page, *_) = warc.read_arc(BytesIO(ARC))
    path = f"{work_dir(spark)}/bad.warc.gz"
    good = gzip.decompress(warc.warc_record(page, 3, warc.payload_digest(HTML), warc.Response(7, page.url, page.date)))
    with warc.shared_file(path, "wb") as out:
        out.write(gzip.compress(good.replace(b"X-Refers-To-Page: 7", b"X-Refers-To-Page: 8")))
    with pytest.raises(Exception, match="damaged revisit"):
        warc.read_archives(spark.createDataFrame([(path,)], "path string")).collect()
