"""Licences of several paragraphs, inside longer texts and inside lines."""

import random
import re

from llm.data import frame, prose

from fraygraph.llm import licences
from fraygraph.llm.licence_texts import COMPLETE, TEMPLATES


def paragraphs(text, *heads):
    return re.sub("|".join(heads), lambda m: "\n\n" + m.group(), text)


def test_licences_across_paragraphs_and_inside_lines(spark):
    mit = next(t for n, t in TEMPLATES if t.startswith("Permission is hereby"))
    gpl3 = next(t for n, t in TEMPLATES if n == "GPL-3.0" and t.startswith("This program"))
    full = dict(COMPLETE)
    cases = {
        "MIT": prose(1, 120) + "\n\n" + paragraphs(mit, "The above copyright", "THE SOFTWARE IS"),
        "BSD-3-Clause": paragraphs(full["BSD-3-Clause"], "Redistributions", "Neither", "THIS SOFTWARE"),
        "BSD-2-Clause": prose(2, 90) + paragraphs(full["BSD-2-Clause"], "Redistributions", "THIS SOFTWARE") + "\n\n" + prose(3, 90),
        "GPL-3.0": paragraphs(gpl3, "This program is distributed", "You should"),
        "GPL-2.0": paragraphs(full["GPL-2.0"], "This program is distributed", "You should") + "\n\n" + prose(4, 200),
        "LGPL-2.1": prose(5, 200) + "\n\n" + paragraphs(full["LGPL-2.1"], "This library is distributed", "You should"),
        "Apache-2.0": prose(6, 60) + " Licensed under the Apache License, Version 2.0. " + prose(7, 60),
        None: prose(8, 300),
    }
    names = list(cases)
    rows = [(i, cases[n], "en", "a", 0, "", "") for i, n in enumerate(names)]
    found = {names[r.doc_id]: r.licence for r in licences.scan_licences(frame(spark, rows)).collect()}
    assert found == {n: n for n in names}


def edited_licence(r, words, share):
    """Words replaced, put in or cut out."""
    made = []
    for word in words:
        kind = r.random()
        if kind < share / 3:
            made.append(f"q{r.randrange(999)}")
        elif kind < 2 * share / 3:
            made += [word, f"z{r.randrange(999)}"]
        elif kind >= share:
            made.append(word)
    return made


def best_run(words, bigrams):
    """Largest Dice coefficient of any run of at least the length of a short template, of distinct bigrams."""
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    own, best = set(bigrams), 0.0
    for i, first in enumerate(pairs):
        if first not in own:
            continue
        run, shared = set(), 0
        for j in range(i, min(len(pairs), i + 3 * len(own))):
            if pairs[j] not in run:
                run.add(pairs[j])
                shared += pairs[j] in own
            if len(own) >= licences.LONG or j - i + 1 >= len(own):
                best = max(best, 2 * shared / (len(run) + len(own)))
    return best


def test_recall_against_runs_of_any_length(spark):
    """Every template, edited at several rates, inside prose: what any run reaches is found, with the same coefficient."""
    r = random.Random(4)
    rows, wanted, lower = [], {}, str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    known = licences.template_bigrams((*TEMPLATES, *COMPLETE))
    for (name, text), (_, bigrams) in zip((*TEMPLATES, *COMPLETE), known):
        for k in range(14):
            body = edited_licence(r, text.split(), [0, 0.03, 0.06, 0.1, 0.13][k % 5])
            whole = " ".join([prose(r.randrange(999), r.randrange(5, 90)), *body, prose(r.randrange(999), r.randrange(5, 90))])
            best = best_run(re.findall("[0-9a-z\x80-\U0010ffff]+", whole.translate(lower)), bigrams)
            if best >= licences.DICE:
                wanted[len(rows)] = (name, len(bigrams) >= licences.LONG)
            rows.append((len(rows), whole, "en", "a", 0, "", ""))
    found = {x.doc_id: x.licences for x in licences.scan_licences(frame(spark, rows)).collect()}
    for is_long in (True, False):
        asked = [i for i, (_, kind) in wanted.items() if kind == is_long]
        caught = sum(wanted[i][0] in found[i] for i in asked)
        assert len(asked) > 40 and caught >= 0.98 * len(asked), (is_long, caught, len(asked))


def test_key_words_leave_too_little(spark):
    for _, bigrams in licences.template_bigrams((*TEMPLATES, *COMPLETE)):
        keys = licences.key_words(bigrams)
        assert sum(not keys & set(b.split(" ")) for b in bigrams) < licences.bounds(len(bigrams))[0]


def test_columns_of_the_caller_stay(spark):
    names = ["words", "pairs", "units", "shared", "matches", "_words", "_pairs", "_matches"]
    docs = spark.createDataFrame([(1, "Released under the MIT License.", *names), (2, None, *names)], ["doc_id", "text", *names])
    for row in licences.scan_licences(docs).collect():
        assert [row[n] for n in names] == names and row.licence == ("MIT" if row.doc_id == 1 else None)
