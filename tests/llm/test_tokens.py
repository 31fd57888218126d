"""Batches of texts against the tokenizers library's own answers."""

import random

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tracewell.llm import tokens

PARTS = [*"ab cd  \n\t'sé中1 2 . ", "<|endoftext|>", " the", " it's", " ", "😀", "\r\n", "aaaaaaa", "ªº", "\u00a0", " Zürich", "----", "\u3000"]


def test_batches_agree_with_the_library(monkeypatch):
    path = tokens.default_path()
    library, draw = Tokenizer.from_file(path), random.Random(1)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14))) for _ in range(6000)] + [None, "", " ", "  ", "a" * 5000, "ab " * 3000]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for memo in (300, tokens.MEMO_CHUNKS):  # with much forgetting, and with none
        monkeypatch.setattr(tokens, "MEMO_CHUNKS", memo)
        codec = tokens.ByteBpe(path)
        for lo in range(0, len(texts), 700):
            ids, counts = codec.encode_all(pa.array(texts[lo : lo + 700], pa.string()))
            ends = np.cumsum(counts)
            assert [ids[b - n : b].tolist() for b, n in zip(ends, counts, strict=True)] == want[lo : lo + 700]
    ids, counts = codec.encode_ended(pa.array(["a b", None], pa.string()), 9)
    assert ids.tolist() == [*want_of(library, "a b"), 9, 9] and counts.tolist() == [len(want_of(library, "a b")) + 1, 1]
    assert [len(x) for x in codec.encode_all(pa.array([], pa.string()))] == [0, 0]


def want_of(library, text):
    return library.encode(text, add_special_tokens=False).ids
