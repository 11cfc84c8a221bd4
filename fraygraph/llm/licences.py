"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams, in DataFrame functions.

Compared are the whole text, its paragraphs and its lines. A unit of n words has at most n - 1 distinct bigrams, and a Dice
coefficient of at least ``DICE`` bounds how much smaller or larger than a template it may be; units outside the bounds of all
templates fall out before any comparison, the others meet only the templates whose bounds hold.

Compared are also runs of words across lines and paragraphs, so a licence of several paragraphs or inside a line of a longer
text is found. A best run begins and ends with a bigram of the template, so the text is walked from hit to hit: a hit adds what
it wins for the Dice coefficient, the words between two hits cost what they lose, a run whose sum falls below nothing is closed
at its best end, and closed runs that can reach the coefficient are compared exactly (distinct bigrams). The work grows with
the hits. Templates of fewer than ``LONG`` bigrams leave too little to tell from a part of them: their runs are made at least
as long as they are.

A text can only match if it holds one of the key words of a template: words chosen so that without all of them too few of its
bigrams are left. Other texts are not cut into units or bigrams at all. All of it happens inside the row: no shuffle, no join.

Nulls and odd input: a null, empty or wordless text matches nothing; units of one word have no bigrams and match nothing;
repeated rows are scanned each; an empty table gives no rows. Of equal best coefficients the
larger template counts, then the licence first in order.
Other columns stay, whatever their names; those named like a result column are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraygraph.llm.licence_texts import COMPLETE, TEMPLATES
from fraygraph.llm.tables import query, read, unused

DICE = 0.8
LONG = 20
# In fifths: what a hit adds to 2 * shared - 0.8 * length and what a miss takes away, and the least sum, by bigrams of the
# template, of a run worth comparing; half of what distinct bigrams must reach, as repeated misses count once there.
HIT, MISS, LEAST = 6, 4, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PARAGRAPH = r"\n[ \t\r]*\n"


def template_bigrams(templates=TEMPLATES) -> list[tuple[str, list[str]]]:
    """(licence, distinct bigrams) of every template."""
    found = []
    for name, text in templates:
        words = re.findall(r"[0-9a-z]+", text.lower())
        found.append((name, sorted({f"{a} {b}" for a, b in zip(words, words[1:])})))
    return found


def bounds(size: int, dice: float = DICE) -> tuple[float, float]:
    """Least and largest number of bigrams of a unit that can reach ``dice`` with a template of ``size``."""
    return size * dice / (2 - dice), size * (2 - dice) / dice


def words_of(unit: Column) -> Column:
    return F.regexp_extract_all(F.translate(unit, UPPER, LOWER), F.lit(WORD), F.lit(0))


def pairs_of(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))


def key_words(bigrams: list[str], dice: float = DICE) -> set[str]:
    """Longest words of a template, so many that a text without all of them is left with too few bigrams for ``dice``."""
    least, keys = bounds(len(bigrams), dice)[0], set()
    left = [b.split(" ") for b in bigrams]
    for word in sorted({w for b in left for w in b}, key=lambda w: (-len(w), w)):
        if len(left) < least:
            break
        keys.add(word)
        left = [b for b in left if word not in b]
    return keys


def runs_of(hits: Column, least: int) -> Column:
    """(first, last) of the runs of ascending places ``hits`` whose sum reaches ``least``."""
    state = "struct<first:int,last:int,sum:int,best:int,stop:int,runs:array<struct<first:int,last:int>>>"
    none = F.array().cast("array<struct<first:int,last:int>>")

    def fields(first, last, total, best, stop, runs):
        return F.struct(first.alias("first"), last.alias("last"), total.alias("sum"), best.alias("best"), stop.alias("stop"), runs.alias("runs")).cast(state)

    def closed(a):
        return F.when(a["best"] >= least, F.concat(a["runs"], F.array(F.struct(a["first"].alias("first"), a["stop"].alias("last"))))).otherwise(a["runs"])

    def step(a, place):
        total = a["sum"] - MISS * (place - a["last"] - 1) + HIT
        fresh = fields(place, place, F.lit(HIT), F.lit(HIT), place, closed(a))
        on = fields(a["first"], place, total, F.greatest(a["best"], total), F.when(total >= a["best"], place).otherwise(a["stop"]), a["runs"])
        return F.when(total < HIT, fresh).otherwise(on)

    return F.aggregate(hits, fields(F.lit(0), F.lit(-1), F.lit(0), F.lit(0), F.lit(0), none), step, closed)


def scan_licences(documents: DataFrame, templates=(*TEMPLATES, *COMPLETE), dice: float = DICE, text: str = "text") -> DataFrame:
    """``documents`` plus licence and dice of the best match (null without one) and licences, all matches in order."""
    known = template_bigrams(templates)
    least = min(bounds(len(b), dice)[0] for _, b in known)
    most = max(bounds(len(b), dice)[1] for _, b in known)
    words_, pairs_, units_, shared_, matches_ = unused(documents, "words", "pairs", "units", "shared", "matches")
    whole = F.coalesce(F.col(text), F.lit(""))
    keys = F.array(*[F.lit(w) for w in sorted(set().union(*[key_words(b, dice) for _, b in known]))])
    of_templates = F.array(*[F.lit(b) for b in sorted({b for _, own in known for b in own})])
    nothing = F.array().cast("array<string>")
    # Words are taken once from every text; all else is done only where a key word stands.
    opened = documents.withColumn(words_, words_of(whole))
    opened = opened.withColumn(pairs_, F.when(F.arrays_overlap(words_, keys) & (F.size(words_) > 1), pairs_of(F.col(words_))).otherwise(nothing))
    opened = opened.withColumn(shared_, F.array_intersect(pairs_, of_templates))
    enough = F.size(shared_) >= least
    lines = F.split(whole, "\n", -1)
    paragraphs = F.when(whole.rlike(PARAGRAPH), F.split(whole, PARAGRAPH, -1)).otherwise(F.array(whole))
    units = F.array_distinct(F.concat(F.array(whole), paragraphs, lines))
    words = F.filter(F.transform(F.filter(units, lambda u: F.length(u) >= 2 * least), words_of), lambda w: F.size(w) - 1 >= least)
    of_units = F.filter(F.transform(words, lambda w: F.array_distinct(pairs_of(w))), lambda b: (F.size(b) >= least) & (F.size(b) <= most))
    opened = opened.withColumn(units_, F.when(enough, of_units))

    def against(name: str, bigrams: list[str]) -> Column:
        low, high = bounds(len(bigrams), dice)
        own = F.array(*[F.lit(b) for b in bigrams])
        size = float(len(bigrams))

        def value(b: Column) -> Column:
            shared = 2.0 * F.size(F.array_intersect(b, own)) / (F.size(b) + F.lit(size))
            return F.when((F.size(b) >= low) & (F.size(b) <= high), shared)

        def run(places: Column) -> Column:
            length = places["last"] - places["first"] + 1
            length = length if len(bigrams) >= LONG else F.greatest(length, F.lit(len(bigrams)))
            return value(F.array_distinct(F.slice(pairs_, places["first"], length)))

        places = F.filter(F.transform(pairs_, lambda b, i: F.when(F.array_contains(own, b), i + 1)), lambda i: i.isNotNull())
        in_runs = F.array_max(F.transform(runs_of(places, LEAST * len(bigrams)), run))
        best = F.greatest(F.array_max(F.transform(F.col(units_), value)), in_runs)
        best = F.when(F.size(F.array_intersect(shared_, own)) >= low, best)
        return F.when(best >= dice, F.struct((-best).alias("rank"), F.lit(-len(bigrams)).alias("size"), F.lit(name).alias("licence")))

    kept = [c for c in documents.columns if c not in ("licence", "dice", "licences")]
    matches = F.when(enough, F.array_sort(F.array_compact(F.array(*[against(n, b) for n, b in known]))))
    found = opened.withColumn(matches_, F.coalesce(matches, F.array().cast("array<struct<rank:double,size:int,licence:string>>")))
    best = F.try_element_at(matches_, F.lit(1))
    names = F.array_sort(F.array_distinct(F.transform(matches_, lambda m: m["licence"])))
    return found.select(*kept, best["licence"].alias("licence"), (-best["rank"]).alias("dice"), names.alias("licences"))


def _values() -> str:
    known = template_bigrams((*TEMPLATES, *COMPLETE))
    return ", ".join(f"({i}, '{name}', '{bigram}')" for i, (name, bigrams) in enumerate(known) for bigram in bigrams)


@query("op1_licence_scan", rf"""
WITH t(id, licence, g) AS (VALUES {_values()}), n AS (SELECT id, licence, count(*) AS size, list(g) AS own FROM t GROUP BY id, licence),
d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT DISTINCT row, unnest(list_concat([text], string_split_regex(text, '\n[ \t\r]*\n'), string_split(text, chr(10)))) AS u FROM d),
w AS MATERIALIZED (SELECT row, u, regexp_extract_all(translate(u, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM u),
b AS (SELECT DISTINCT row, u, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1),
z AS (SELECT row, u, count(*) AS size FROM b GROUP BY ALL),
m AS MATERIALIZED (SELECT b.row, b.u, id, count(*) AS shared FROM b JOIN t USING (g) GROUP BY ALL),
of_units AS (SELECT m.row, licence, n.size, 2.0::DOUBLE * shared / (z.size + n.size) AS dice FROM m JOIN z USING (row, u) JOIN n USING (id)),
p AS (SELECT m.row, id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS pairs
    FROM m JOIN d USING (row) JOIN w ON w.row = m.row AND w.u = d.text JOIN n USING (id) WHERE m.u = d.text AND shared >= size * 0.8 / 1.2),
h AS (SELECT row, id, pairs, list_filter(range(1, len(pairs) + 1), lambda i: list_contains(own, pairs[i])) AS places, size FROM p JOIN n USING (id)),
s AS (SELECT row, id, pairs, size, list_reduce(places, lambda a, x:
    CASE WHEN a.total - {MISS} * (x - a.last - 1) < 0 THEN {{'first': x, 'last': x, 'total': {HIT}, 'best': {HIT}, 'stop': x,
      'runs': CASE WHEN a.best >= {LEAST} * size THEN list_append(a.runs, {{'first': a.first, 'last': a.stop}}) ELSE a.runs END}}
    ELSE {{'first': a.first, 'last': x, 'total': a.total - {MISS} * (x - a.last - 1) + {HIT}, 'best': greatest(a.best, a.total - {MISS} * (x - a.last - 1) + {HIT}),
      'stop': CASE WHEN a.total - {MISS} * (x - a.last - 1) + {HIT} >= a.best THEN x ELSE a.stop END, 'runs': a.runs}} END,
    {{'first': 0::BIGINT, 'last': -1::BIGINT, 'total': 0::BIGINT, 'best': 0::BIGINT, 'stop': 0::BIGINT, 'runs': []::STRUCT(first BIGINT, last BIGINT)[]}}) AS a FROM h),
r AS (SELECT row, id, pairs, size, unnest(CASE WHEN a.best >= {LEAST} * size THEN list_append(a.runs, {{'first': a.first, 'last': a.stop}}) ELSE a.runs END) AS x FROM s),
c AS (SELECT row, id, size, list_distinct(pairs[x.first:greatest(x.last, CASE WHEN size < {LONG} THEN x.first + size - 1 ELSE 0 END)]) AS own_pairs FROM r),
of_runs AS (SELECT row, licence, n.size, 2.0::DOUBLE * len(list_intersect(own_pairs, own)) / (len(own_pairs) + n.size) AS dice FROM c JOIN n USING (id)),
k AS (SELECT row, licence, max({{'dice': dice, 'size': size}}) AS best FROM (FROM of_units UNION ALL FROM of_runs) WHERE dice >= 0.8 GROUP BY row, licence)
SELECT d.doc_id, q.licence, q.dice, coalesce(q.licences, '') AS licences FROM d LEFT JOIN (
  SELECT row, first(licence ORDER BY best.dice DESC, best.size DESC, licence) AS licence, round(max(best.dice), 9) AS dice, string_agg(licence, ',' ORDER BY licence) AS licences FROM k GROUP BY row) q USING (row)""")
def _(spark, sf):
    found = scan_licences(read(spark, sf, "documents", "doc_id", "text"))
    return found.select("doc_id", "licence", F.round("dice", 9).alias("dice"), F.array_join("licences", ",").alias("licences"))
