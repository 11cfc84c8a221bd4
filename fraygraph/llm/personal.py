"""Personal data by anchor expansion: one Aho-Corasick pass finds at-signs, schemes, digits, plus signs and identifier cues, and
a small deterministic parser at each anchor expands it to a span and validates it.

Base kinds, leftmost and without overlap inside a kind: ``email`` (expanded from its at-sign to both sides), ``ip`` (four
dotted numbers up to 255), ``card`` (13 to 19 digits with single blanks or hyphens between them, Luhn) and ``phone`` (a plus
sign, 9 to 15 digits). Added kinds: ``url`` (http, https or ftp with a dotted host) and ``account`` (an identifier behind a
cue: an IBAN with its check digits, else 6 to 17 digits). A match that fails its check is dropped; nothing is tried in its
place. Spans count code points of the whole text, end exclusive; spans of different kinds may overlap.

Every anchor is parsed from where the last parse of its kind ended, so the work is proportional to the text.

Nulls and odd input: a null or empty text has no spans; repeated rows are each scanned; an empty table gives no rows; very long
texts are scanned whole. Other columns stay, those named like a result column are replaced (``redact`` keeps them).
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraygraph.llm.tables import query, read, set_aside, with_arrow

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
SPANS = "spans array<struct<kind: string, start: long, end: long>>"

# Cues of account identifiers, each as written here, capitalised and in upper case.
IBAN_CUES = ("iban",)
NUMBER_CUES = ("account", "acct", "ssn", "passport", "konto", "compte", "cuenta")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DIGITS = re.compile(r"[0-9]++")
DOTTED = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
HOST = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?(?:/[A-Za-z0-9._~%/?#&=+@:-]*)?"
URL_END = re.compile(HOST)
BETWEEN = r"[ :=#.-]{1,3}"
IBAN = re.compile(BETWEEN + r"([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)")
NUMBER = re.compile(BETWEEN + r"([0-9](?:[ -]?[0-9])++)")


def forms(cues: tuple[str, ...]) -> list[str]:
    return [f for c in cues for f in (c, c.capitalize(), c.upper())]


def byte_sized(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def luhn(digits: str) -> bool:
    doubled = sum((2 * int(d)) // 10 + (2 * int(d)) % 10 for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def iban_checked(text: str) -> bool:
    """Whether the remainder by 97 is 1, the first four signs moved to the end and letters read as 10 to 35."""
    own = text.replace(" ", "")
    return 15 <= len(own) <= 34 and int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1


class AnchorParsers:
    """Finds (kind, start, end) of a text, in the order of ``KINDS``, then start."""

    def __init__(self):
        import ahocorasick

        self.anchors = ahocorasick.Automaton()
        for digit in "0123456789":
            self.anchors.add_word(digit, ("digit", 1))
        self.anchors.add_word("@", ("at", 1))
        self.anchors.add_word("+", ("plus", 1))
        self.anchors.add_word("://", ("scheme", 3))
        for name, cues in (("iban", IBAN_CUES), ("number", NUMBER_CUES)):
            for cue in forms(cues):
                self.anchors.add_word(cue, (name, len(cue)))
        self.anchors.make_automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        after = dict.fromkeys(KINDS, 0)
        for last, (anchor, length) in self.anchors.iter(text):
            at = last + 1 - length
            if anchor == "digit":
                if at >= after["card"]:
                    self._card(text, at, found, after)
                if at >= after["ip"]:
                    self._ip(text, at, found, after)
            elif anchor == "at":
                self._email(text, at, found, after)
            elif anchor == "plus":
                self._phone(text, at, found)
            elif anchor == "scheme":
                self._url(text, at, found, after)
            else:
                self._account(text, at, last + 1, anchor, found, after)
        return [(k, a, b) for k in KINDS for a, b in found[k]]

    @staticmethod
    def _email(text, at, found, after):
        start = at
        while start > after["email"] and text[start - 1] in LOCAL:
            start -= 1
        end = DOMAIN.match(text, at + 1) if start < at else None
        if end:
            found["email"].append((start, end.end()))
            after["email"] = end.end()

    @staticmethod
    def _ip(text, at, found, after):
        match = DOTTED.match(text, at)
        after["ip"] = (match or DIGITS.match(text, at)).end()
        if match and all(map(byte_sized, match.groups())):
            found["ip"].append(match.span())

    @staticmethod
    def _card(text, at, found, after):
        match = CHAIN.match(text, at)
        after["card"] = match.end() if match else at + 1
        if match and match.end() - at >= 13:
            digits = match.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(match.span())

    @staticmethod
    def _phone(text, at, found):
        match = PHONE.match(text, at)
        if match and 9 <= sum(map(str.isdigit, match.group())) <= 15:
            found["phone"].append(match.span())

    @staticmethod
    def _url(text, at, found, after):
        for scheme in ("https", "http", "ftp"):
            start = at - len(scheme)
            if start >= after["url"] and text.startswith(scheme, start):
                end = URL_END.match(text, at + 3)
                if end:
                    found["url"].append((start, end.end()))
                    after["url"] = end.end()
                return

    @staticmethod
    def _account(text, at, end, cue, found, after):
        if at < after["account"] or (at and text[at - 1] in WORD):
            return
        match = (IBAN if cue == "iban" else NUMBER).match(text, end)
        if match:
            after["account"] = match.end()
            own = match.group(1)
            if iban_checked(own) if cue == "iban" else 6 <= sum(map(str.isdigit, own)) <= 17:
                found["account"].append(match.span(1))


def find_personal(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` plus ``spans``, the (kind, start, end) of all personal data of the text."""

    def run(texts):
        if not hasattr(run, "parsers"):
            run.parsers = AnchorParsers()
        return {"spans": [[{"kind": k, "start": a, "end": b} for k, a, b in run.parsers.spans(t)] if t else [] for t in texts]}

    return with_arrow(documents, [text], SPANS, run)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with every stretch covered by spans replaced by the kind of the span that begins it, in square brackets."""
    kept, at, covered = [], 0, 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))):
        if start >= covered:
            kept += [text[at:start], f"[{kind}]"]
        at = covered = max(covered, end)
    return "".join([*kept, text[at:]])


def redact(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with personal data replaced in the text; all columns stay."""
    apart, back = set_aside(documents, SPANS)
    found = find_personal(apart, text)

    def run(batches):
        for batch in batches:
            rows = zip(batch.column(text).to_pylist(), batch.column("spans").to_pylist())
            texts = [redacted(t, [(s["start"], s["end"], s["kind"]) for s in spans]) if spans else t for t, spans in rows]
            yield batch.set_column(batch.schema.get_field_index(text), text, pa.array(texts, pa.string()))

    return back(found.mapInArrow(run, found.schema))


def written(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


EMAIL_SQL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP_SQL = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD_SQL = r"[0-9]([ -]?[0-9])+"
PHONE_SQL = r"\+[0-9][ ().0-9-]+[0-9]"
URL_SQL = rf"(?:https|http|ftp)://{HOST}"
IBAN_SQL = rf"\b(?:{'|'.join(forms(IBAN_CUES))}){IBAN.pattern}"
NUMBER_SQL = rf"\b(?:{'|'.join(forms(NUMBER_CUES))}){NUMBER.pattern.replace('++', '+')}"
CUE_SQL = f"(?:{IBAN_SQL})|(?:{NUMBER_SQL})"


def _found_sql() -> str:
    """Matches of every kind with their first code point: all pieces and matches before them."""
    patterns = (EMAIL_SQL, IP_SQL, CARD_SQL, PHONE_SQL, URL_SQL, CUE_SQL)
    parts = [
        f"SELECT id, {k} AS k, '{kind}' AS kind, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS pieces FROM texts"
        for k, (kind, p) in enumerate(zip(KINDS, patterns))
    ]
    return " UNION ALL ".join(parts)


@query("op13_personal_data", rf"""
WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({_found_sql()}),
hits AS (SELECT id, k, kind, hits[i] AS hit, list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS begins
    FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM found WHERE len(hits) > 0)),
owned AS (SELECT *, CASE WHEN kind <> 'account' THEN hit WHEN regexp_matches(hit, '^(?:{'|'.join(forms(IBAN_CUES))})') THEN regexp_extract(hit, '{IBAN_SQL}', 1)
    ELSE regexp_extract(hit, '{NUMBER_SQL}', 1) END AS own FROM hits),
digits AS (SELECT *, regexp_replace(own, '[^0-9]', '', 'g') AS d, replace(own, ' ', '') AS plain FROM owned),
checked AS (SELECT id, k, kind, (begins + length(hit) - length(own))::BIGINT AS a, (begins + length(hit))::BIGINT AS b FROM digits WHERE CASE kind
    WHEN 'ip' THEN list_bool_and(list_transform(string_split(own, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(try_cast(ltrim(x, '0') AS INT), 0) <= 255))
    WHEN 'card' THEN length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i:
        CASE WHEN i % 2 = 1 THEN d[length(d) + 1 - i]::INT ELSE (2 * d[length(d) + 1 - i]::INT) // 10 + (2 * d[length(d) + 1 - i]::INT) % 10 END)) % 10 = 0
    WHEN 'phone' THEN length(d) BETWEEN 9 AND 15
    WHEN 'account' THEN CASE WHEN regexp_matches(plain, '^[A-Z]') THEN length(plain) BETWEEN 15 AND 34 AND
        list_reduce(list_prepend(0, list_transform(string_split(plain[5:] || plain[1:4], ''), lambda c: position(c IN '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ') - 1)),
            lambda rest, v: (rest * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1
        ELSE length(d) BETWEEN 6 AND 17 END
    ELSE true END),
joined AS (SELECT id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
    count(*) FILTER (kind = 'phone') AS n_phone, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY k, a) FILTER (k < 4) AS base,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY k, a) AS spans FROM checked GROUP BY id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN joined USING (id)""")
def _(spark, sf):
    found = find_personal(read(spark, sf, "documents", "doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
