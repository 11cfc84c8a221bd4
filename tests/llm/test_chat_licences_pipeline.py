"""Perspective rotation and licence scan against plain readings, queries against SQL, the pipeline stage by stage."""

import re

import pytest
from llm.data import ALNUM_WORD, BLANK_WORD, LOWER, frame, odd_rows, prose
from oracle import compare, connect

import corpus_pipeline
from fraygraph.llm import chat, jaccard, licences, mixing, quality
from fraygraph.llm.catalogue import QUERIES, SQL
from fraygraph.llm.licence_texts import TEMPLATES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    result, _ = compare(spark, connect(SF), SF, name, QUERIES[name], SQL[name])
    assert result.startswith("OK"), result


def rendered(turns, speaker):
    text, mask = "", []
    for role, words in turns:
        name = re.sub(r"[|<>\s]", "_", role or "unknown")
        text += "<|system|>\n" if role == "system" else "<|assistant|>\n" if role == speaker else f"<|user name={name}|>\n"
        start = len(text)
        text += (words or "").replace("<|", "< |") + "<|end|>\n"
        if role == speaker:
            mask.append((start, len(text)))
    return text, mask


@pytest.mark.parametrize("rows_in_part", [256, 3])
def test_rotation(spark, monkeypatch, rows_in_part):
    monkeypatch.setattr(chat, "ROWS", rows_in_part)
    rows = [(1, i, ["ann", "bob", "system", "c d|", None][i % 5], f"é {i} <|end|>", "x") for i in range(150)]
    rows += [(2, 0, "system", "only", "x"), (3, None, "ann", None, "x"), (3, 1, "bob", "", "x"), (None, 0, "ann", "hi", "x"), (4, 0, "ann", "a", "x"), (4, 0, "ann", "a", "x"), (4, 0, "bob", "b", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, speaker string")
    found = chat.rotate(table).collect()
    seen = {}
    for r in found:
        seen.setdefault((r.conv_id, r.speaker), []).append(r)
        assert "<|end|>\n" in r.text and all(r.text[m.end - 8 : m.end] == "<|end|>\n" for m in r.mask)
    for (conv, speaker), parts in seen.items():
        own = [r for r in rows if r[0] == conv]
        assert sum(p.n_turns for p in parts) == len(own)
        for p in parts if rows_in_part == 256 else []:
            turns = sorted((r for r in own if (r[1] is None) == (p.part is None) and (p.part is None or r[1] // 64 == p.part)), key=lambda r: (r[1] or 0, r[2] or "", r[3] or ""))
            text, mask = rendered([(r[2], r[3]) for r in turns], speaker)
            assert p.text == text and [(m.start, m.end) for m in p.mask] == mask
    assert set(seen) == {(r[0], r[2]) for r in rows if r[2] not in (None, "system")}
    assert chat.rotate(table.limit(0)).count() == 0


def dice(unit, template):
    a, b = ({tuple(x) for x in zip(w, w[1:])} for w in (ALNUM_WORD.findall(unit.translate(LOWER)), ALNUM_WORD.findall(template.translate(LOWER))))
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def test_licences_equal_brute_force(spark):
    mit = next(t for n, t in TEMPLATES if t.startswith("Permission is hereby"))
    rows = odd_rows() + [
        (300, mit, "en", "a", 0, "", ""), (301, prose(1, 50) + "\n\n" + mit.upper() + "\n \n" + prose(2, 9), "en", "a", 0, "", ""),
        (302, prose(1, 20) + "\nLicensed under the  APACHE license, version 2.0\n", "en", "a", 0, "", ""), (303, mit.replace("Software", "thing", 2), "en", "a", 0, "", ""),
        (304, "Released under the MIT licence and nothing like any of the others at all.", "en", "a", 0, "", ""),
    ]
    for r in licences.scan_licences(frame(spark, rows)).collect():
        units = [r.text or "", *re.split(r"\n[ \t\r]*\n", r.text or ""), *(r.text or "").split("\n")]
        best = {}
        for name, template in TEMPLATES:
            value = max(dice(u, template) for u in units)
            if value >= 0.8:
                best[name] = max(best.get(name, 0), value)
        assert r.licences == sorted(best)
        if best:
            assert r.licence == min(best, key=lambda n: (-best[n], n)) and abs(r.dice - max(best.values())) < 1e-12
        else:
            assert r.licence is None and r.dice is None
    assert licences.scan_licences(frame(spark, rows).limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID output"]
    before = {r.doc_id: r.text for r in docs.collect()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert after.schema == docs.schema
            assert all(before[r.doc_id] == r.text for r in after.collect())
        if i == 0:
            kept = {r.doc_id for r in quality.judge(docs, quality.learn_references(docs)).filter("kept").collect()}
            assert {r.doc_id for r in after.collect()} == kept
        if i == 1:
            parts = jaccard.join_components(docs).filter("n_shingles = 0 OR doc_id = component_id").count()
            assert after.count() == parts
        if i == 3:
            times = sum(r.copies for r in mixing.mix_copies(docs).collect())
            assert after.count() == times
        if i == 4:
            assert after.count() == docs.count()
        docs = after
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_pipeline_stands_odd_rows(spark, tmp_path):
    docs = frame(spark, odd_rows())
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    empty = frame(spark, []).limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, empty, SF).count() == 0
    assert BLANK_WORD.findall("a b")
