"""Exact token ids of the `tokenizers` library at a fraction of its cost: repeated pieces of text are encoded once.

Byte-level BPE first cuts a text into pieces by a pattern and then encodes every piece alone. A blank between two other
characters always begins a piece. Texts whose letters the pattern here knows are cut at such blanks and behind words, and
every distinct stretch of a run of texts is looked up once in a bounded cache; only unseen ones go through the library, joined
to longer texts. Texts with blanks beside other white space are cut to pieces by the pattern and looked up piece by piece,
texts with other letters go through the library whole.
"""

from __future__ import annotations

import gc
import json
import os
import re
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Letters that the fast path knows: those of ASCII, Latin-1 and Latin Extended A and B.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
OTHER = f"[^\t-\r -~{LETTERS}]"
BLANKS = "[\t-\r ] | [\t-\r ]"
PIECES = re.compile(f" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\\s0-9{LETTERS}]+|\\s+(?!\\S)|\\s+")
# The pattern of a ByteLevel pre-tokenizer without prefix blank is the one that PIECES follows.
FORMAT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
JOINED = 200
RUN_CHARACTERS = 4_000_000
# Goes before a stretch that no blank precedes; not in the texts cut here. Such stretches begin a text, or where a piece begins
# as well: behind the last of some letters, and at a letter behind a single line feed.
FIRST = "\0"
BORDERS = (f"([{LETTERS}])([^ {LETTERS}])", f"\\1 {FIRST}\\2"), (f"([^\t-\r ]\n)([{LETTERS}])", f"\\1 {FIRST}\\2")


class TokenIds:
    """Encodes texts to little-endian 32-bit ids; ``path`` is a tokenizer file of the `tokenizers` library."""

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.met: dict[str, bytes] = {}
        self.met_older: dict[str, bytes] = {}
        described = json.loads(self.tokenizer.to_str())
        pre = described.get("pre_tokenizer") or {}
        self.cuts = (
            described.get("normalizer") is None
            and all(pre.get(k) == v for k, v in FORMAT.items())
            and (described.get("model") or {}).get("type") == "BPE"
            and not (described.get("model") or {}).get("dropout")
        )
        # Strings that the library cuts out before the pattern applies; texts with one of them are encoded whole.
        self.special = [x["content"] for x in described.get("added_tokens") or []]
        self.opens = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.opens[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("Ġ")]] = True
        self.feed = self.tokenizer.get_vocab().get("Ċ")

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, "<u4").tobytes() for x in found]

    def _learn(self, texts: list[str], known: dict[str, bytes]) -> None:
        """Give unseen pieces and stretches their ids in ``known``. They are joined to long texts and the ids cut again: those
        behind a blank where an id opens with one, bare ones without white space at the line feeds set between them."""
        behind = [t for t in texts if t[:1] == " " and not t[1:2].isspace() and len(t) > 1]
        for joint, joined in (("", behind), ("\n", [t for t in texts if self.feed is not None and t[:1] not in ("", " ") and t.isprintable()])):
            for i in range(0, len(joined), JOINED):
                run = joined[i : i + JOINED]
                coded = np.asarray(self.tokenizer.encode_batch_fast([joint.join(run)], add_special_tokens=False)[0].ids, "<u4")
                borders = np.flatnonzero(coded == self.feed if joint else self.opens[coded])
                if len(borders) + bool(joint) == len(run):  # else a text has a border inside
                    data = coded.tobytes()
                    starts = [0, *(4 * borders + 4).tolist()] if joint else (4 * borders).tolist()
                    ends = [*(4 * borders).tolist(), len(data)] if joint else [*starts[1:], len(data)]
                    known.update(zip(run, [data[a:b] for a, b in zip(starts, ends)]))
        rest = [t for t in texts if t not in known]
        known.update(zip(rest, self._whole(rest)))

    def _meet(self, missing: set[str]) -> None:
        """Give pieces that are not in the newer cache their ids, from the older cache or the library."""
        known, older, unseen = self.known, self.older, []
        for piece in missing:
            coded = older.get(piece)
            if coded is None:
                unseen.append(piece)
            else:
                known[piece] = coded
        if unseen:
            self._learn(unseen, known)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as bytes of little-endian unsigned 32-bit integers."""
        found: list[bytes] = [b""] * len(texts)
        rows = pa.array(texts, pa.large_string())
        other = pc.match_substring_regex(rows, OTHER).to_pylist()
        beside = pc.match_substring_regex(rows, BLANKS).to_pylist()
        whole, run, uneven, length = [], [], [], 0
        gc.disable()  # the many small strings here hold no cycles, and looking for some takes time
        for k, text in enumerate(texts):
            if not self.cuts or other[k] or any(s in text for s in self.special):
                whole.append(k)
                continue
            (uneven if beside[k] else run).append(k)
            length += len(text)
            if length > RUN_CHARACTERS:
                self._encode_run(texts, run, uneven, found)
                run, uneven, length = [], [], 0
        self._encode_run(texts, run, uneven, found)
        gc.enable()
        for k in whole:
            found[k] = self._whole([texts[k]])[0]
        return found

    def _encode_run(self, texts: list[str], run: list[int], uneven: list[int], found: list[bytes]) -> None:
        for k, ids in zip(uneven, self._by_pieces([texts[k] for k in uneven])):
            found[k] = ids
        if not run:
            return
        rows = pa.array([FIRST + texts[k] for k in run], pa.large_string())
        for border, parts in BORDERS:
            rows = pc.replace_substring_regex(rows, border, parts)
        stretches = pc.split_pattern(rows, " ")
        own = stretches.values.dictionary_encode()
        coded = pa.array(self._by_stretches(own.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(own.indices)
        _, places, data = coded.buffers()
        ends = np.frombuffer(places, np.int64)[stretches.offsets.to_numpy()].tolist()
        data = memoryview(data or b"")
        for k, a, b in zip(run, ends, ends[1:]):
            found[k] = bytes(data[a:b])

    def _by_stretches(self, stretches: list[str]) -> list[bytes]:
        """Ids of distinct stretches of text, each with the blank before it, or without one behind ``FIRST``."""
        if len(self.met) > self.most:
            self.met_older, self.met = self.met, {}
        met, older = self.met, self.met_older
        unseen = [s for s, ids in zip(stretches, map(met.get, stretches)) if ids is None]
        if unseen:
            met.update({s: older[s] for s in unseen if s in older})
            unseen = [s for s in unseen if s not in older]
            texts, learnt = [s[1:] if s[:1] == FIRST else " " + s for s in unseen], {}
            self._learn(texts, learnt)
            met.update(zip(unseen, map(learnt.__getitem__, texts)))
        return list(map(met.__getitem__, stretches))

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.most:  # a full cache becomes the older one: what recurs stays, and memory is bounded
            self.older, self.known = self.known, {}
        pieces, ends = [], []
        for text in texts:
            pieces += PIECES.findall(text)
            ends.append(len(pieces))
        coded = list(map(self.known.get, pieces))
        gaps = [i for i, c in enumerate(coded) if c is None]
        if gaps:
            self._meet({pieces[i] for i in gaps})
            for i in gaps:
                coded[i] = self.known[pieces[i]]
        return [b"".join(coded[start:end]) for start, end in zip([0, *ends], ends)]


def worker_ids(path: str) -> TokenIds:
    """The encoder of this worker process for ``path``; later tasks of the process find it loaded and its cache filled.

    Functions that travel by value get new globals in every task, so it is kept on a module entered under a name of this
    package, which the process keeps.
    """
    kept = sys.modules.setdefault("fraygraph_worker_ids", types.ModuleType("fraygraph_worker_ids"))
    if getattr(kept, "path", None) != path:
        kept.path, kept.ids = path, TokenIds(path)
    return kept.ids
