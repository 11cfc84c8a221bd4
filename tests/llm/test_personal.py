"""Personal data against the plain regular expressions of its kinds."""

import hashlib
import random
import re

import duckdb
from llm.data import frame, odd_rows

from fraygraph.llm import personal
from fraygraph.llm.tables import QUERIES, SQL

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
FIXED = [
    "a@b.c@d.e x@y a.@b.c. @b.c a@-.- ü@b.cé %@1.2", "300.1.2.3.4 1.2.3.4.5.6.7.8 0001.002.3.255 1.2.3 9.256.1.1 " + "9" * 5000 + ".1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111 1111  1111 1111 411111111111111111111", "+1 (376) 555-9077 +1-2 +12345678 +123456789) ++49 30 1234567 +1.5+49 (0)30 123456-",
    "see https://a.example.org/x?y=1#z. http://nodot ftp://h.de:21 xhttp://q.rs/http://u.vw Mailto:x HTTP://a.b", "IBAN: DE89 3704 0044 0532 0130 00 iban=GB82WEST12345698765432 IBAN GB82 WEST 1234 5698 7654 33",
    "account no 123456 Account: 123-456-789 myaccount 123456 SSN #078-05-1120 acct 12345 passport 1234567", "",
]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    keep = {
        "email": lambda m: True,
        "ip": lambda m: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.split(".")),
        "card": lambda m: 13 <= len(d := re.sub("[ -]", "", m)) <= 19 and luhn(d),
        "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    return [(k, *m.span()) for k in PLAIN for m in PLAIN[k].finditer(text) if keep[k](m.group())]


def random_texts(count):
    r = random.Random(13)
    parts = ["a", "Z9", "@", ".", "..", "-", "+", "%", "_", " ", "  ", "1", "25", "4111111111111111", "4111 1111 ", "1111-1111", "255.1", "(", ")", "é", "\n", "b.c", "://", "http", "https", "IBAN", "ssn ", "😀"]
    return ["".join(r.choices(parts, k=r.randrange(1, 40))) for _ in range(count)]


def test_base_spans_equal_the_plain_patterns():
    parsers = personal.AnchorParsers()
    for text in FIXED + random_texts(6000):
        assert [s for s in parsers.spans(text) if s[0] in PLAIN] == base_spans(text), text


def test_added_kinds():
    spans = personal.AnchorParsers().spans
    found = [FIXED[4][a:b] for k, a, b in spans(FIXED[4]) if k == "url"]
    assert found == ["https://a.example.org/x?y=1#z.", "ftp://h.de:21", "http://q.rs/http://u.vw"]
    assert [FIXED[5][a:b] for k, a, b in spans(FIXED[5]) if k == "account"] == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    assert [FIXED[6][a:b] for k, a, b in spans(FIXED[6]) if k == "account"] == ["123-456-789", "078-05-1120", "1234567"]


def test_long_runs_take_time_in_proportion():
    for text in ("9" * 300_000, "1." * 150_000, "a@" * 150_000, "+1 " * 100_000, "1 " * 150_000, "account 1" * 30_000):
        assert isinstance(personal.AnchorParsers().spans(text), list)


def test_query_equals_sql_and_keeps_rows(spark, tmp_path):
    rows = [(i, t, None, None, 0, "clash", "clash") for i, t in enumerate(FIXED + random_texts(300))]
    docs = frame(spark, rows + odd_rows())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op13_personal_data"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(SQL["op13_personal_data"]).fetchall()
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, want))
    digests = sorted(hashlib.sha256(",".join("%s:%d:%d" % x for x in base_spans(r[1] or "")).encode()).hexdigest() for r in rows + odd_rows())
    assert sorted(r.base_sha256 for r in found.collect()) == digests


def test_redaction_keeps_columns_and_clean_texts(spark):
    rows = [(1, "Write a@b.co or call +1 (376) 555-9077.", "x", "keep"), (2, None, None, None), (3, "clean", "y", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, kind string")
    found = {r.doc_id: r for r in personal.redact(docs).collect()}
    assert found[1].text == "Write [email] or call [phone]." and found[1].spans == "x" and found[1].kind == "keep"
    assert found[2].text is None and found[3].text == "clean"
    assert personal.redact(docs.limit(0)).count() == 0
