"""Token ids, Simple-8b blocks, token files and token counts: equal to the library, exact round trips, plain sums."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.data import frame, odd_rows, prose

from fraygraph.llm import simple8b, token_counts, token_output
from fraygraph.llm.tokens import TokenIds


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_output.tokenizer_file())


def ids_of(plain, text):
    return np.asarray(plain.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_ids_equal_the_library(plain):
    r = random.Random(4)
    parts = [" ", "\n", "\t", "  ", "'s", "'t", "a", "é", "Z", "9", "²", "½", "x1", "中", "Ġ", "_", "-", "...", "<|endoftext|>", "\x1c", "\xa0", "　", "😀", "ª", "'", "ǅ", "ĸ", "\r\n", "\0"]
    texts = ["".join(r.choices(parts, k=r.randrange(12))) for _ in range(4000)] + [x[1] or "" for x in odd_rows()] + [prose(i, 80) for i in range(50)]
    own = TokenIds(token_output.tokenizer_file(), most=300)  # small enough to turn the caches over
    for i in range(0, len(texts), 37):
        assert own.encode(texts[i : i + 37]) == [ids_of(plain, t).tobytes() for t in texts[i : i + 37]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=90), max_size=6))
def test_blocks_round_trip(documents):
    lengths = np.array([len(d) for d in documents], np.int64)
    ids = np.array([x for d in documents for x in d], np.uint64)
    names = [None if i == 1 else i - 2 for i in range(len(documents))]
    payload = simple8b.pack_block(names, ids, lengths)
    back_names, back, back_lengths = simple8b.unpack_block(payload)
    assert back_names == names and back.tolist() == ids.tolist() and back_lengths.tolist() == lengths.tolist()
    for i, own in enumerate(documents):
        assert simple8b.unpack_document(payload, i).tolist() == own


def test_packing_is_dense():
    words, _, escapes = simple8b.encode(np.array([1] * 120 + [2**59] + [2**60] + [7] * 20), np.array([142]))
    assert len(words) == 5 and len(escapes) == 1
    with pytest.raises(ValueError):
        simple8b.unpack_block(b"nope" + bytes(40))


@pytest.mark.parametrize("block_ids", [token_output.BLOCK_IDS, 500])
def test_files_give_back_every_document(spark, plain, tmp_path, monkeypatch, block_ids):
    monkeypatch.setattr(token_output, "BLOCK_IDS", block_ids)
    rows = odd_rows() + [(500 + i, prose(i, 40), "en", "a", 0, "", "") for i in range(60)]
    path = str(tmp_path / "ids")
    token_output.write_ids(frame(spark, rows).repartition(7), path)
    back = sorted(token_output.read_ids(spark, path).collect(), key=lambda r: r.start)
    ids = [np.append(ids_of(plain, r[1]), 2).astype("<u4").tobytes() for r in rows]
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in back) == sorted((str(r[0]), i) for r, i in zip(rows, ids))
    order = [-1 if r.doc_id is None else r.doc_id for r in back]
    assert order == sorted(order)
    ends = np.cumsum([len(r.ids) // 4 for r in back])
    assert [r.start for r in back] == [0, *ends[:-1].tolist()]


def test_token_table(spark, plain):
    rows = odd_rows()
    found = token_output.token_table(spark, frame(spark, rows)).collect()
    want = [(r[0], np.append(ids_of(plain, r[1]), 2).astype("<u4").tobytes()) for r in rows]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in found) == sorted((str(d), len(b) // 4, zlib.crc32(b)) for d, b in want)
    assert token_output.token_table(spark, frame(spark, rows).limit(0)).count() == 0


def test_token_counts(spark, plain):
    rows = odd_rows()
    lengths = [len(ids_of(plain, r[1])) for r in rows]
    histogram = token_counts.length_histogram(token_counts.with_lengths(frame(spark, rows)))
    sums = token_counts.suffix_sums(histogram).cache()
    count = Counter(lengths)
    for r in sums.collect():
        longer = [x for x in lengths if x >= r.n_tokens]
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (count[r.n_tokens], len(longer), sum(longer))
        assert (r.docs, r.tokens) == (len(rows), sum(lengths)) and r.truncated_total == sum(min(x, r.n_tokens) for x in lengths)
    limits = [0, 1, 7, 100, 4096, 10**6]
    for r in token_counts.truncated_totals(sums, limits).collect():
        assert r.tokens_kept == sum(min(x, r.context) for x in lengths) and r.docs_cut == sum(x > r.context for x in lengths)
    for share in (0.1, 0.5, 0.9, 1.0):
        assert token_counts.length_quantile(sums, share).first()[0] == sorted(lengths)[-int(-share * len(lengths) // 1) - 1]
    assert token_counts.suffix_sums(histogram.limit(0)).count() == 0
