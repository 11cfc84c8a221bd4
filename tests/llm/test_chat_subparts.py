"""The subparts of a crowded part keep the order of its turns."""

from llm.test_chat_licences_pipeline import rendered

from fraygraph.llm import chat


def test_subparts_in_order_are_the_part(spark, monkeypatch):
    monkeypatch.setattr(chat, "ROWS", 3)
    rows = [(c, t, ["ann", "bob", None][i % 3], f"é {i // 2}") for c in (1, None) for i, t in enumerate([None] * 10 + [0] * 10 + [5] * 8)]
    rotated = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert max(r.n_turns for r in rotated.collect()) == 3
    for r in chat.whole_parts(rotated).collect():
        own = [x for x in rows if x[0] == r.conv_id and (x[1] is None) == (r.part is None)]
        own = sorted(own, key=lambda x: (x[1] or 0, x[2] or "", x[3]))
        text, mask = rendered([x[2:] for x in own], r.speaker)
        assert r.n_turns == len(own) and r.text == text and [(m.start, m.end) for m in r.mask] == mask
