"""What encoding tasks hold, and that workers give it back: they stay for later stages and count there."""

import numpy as np
import pyarrow as pa

from tidemark.llm import bpe
from tidemark.llm.queries import tokenizer_path


def test_encoding_gives_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(bpe, "give_back", lambda: calls.append(1))
    path = tokenizer_path()
    bpe.coder.cache_clear()
    texts = ["one two three", "", "four " * 70_000 + "five", "six́ seven"]
    got = list(bpe.encoded_batches([pa.array(texts[:2]), pa.array(texts[2:])], path))
    # Once when the tables are built and once when the task ends, with nothing remembered.
    assert len(calls) == 2 and not bpe.coder(path).known
    assert [ids for part in got for ids in part.to_pylist()] == [bpe.coder(path).encode(t) for t in texts]
    assert list(bpe.encoded_batches([], path)) == [] and len(calls) == 3


def test_cuts_of_stretches_change_no_ids(monkeypatch):
    coder, text = bpe.coder(tokenizer_path()), "It's 12.5 % of cafés, naïve ΣΣ; á " * 40
    want = coder.encode(text)
    for stretch in (1, 7, 100):
        monkeypatch.setattr(bpe, "STRETCH", stretch)
        assert coder.encode(text) == want


def test_pairs_with_the_same_last_token_are_all_remembered(monkeypatch):
    coder, asked = bpe.PrefixCoder(open(tokenizer_path(), encoding="utf-8").read()), []
    plain = coder.compatible
    monkeypatch.setattr(coder, "compatible", lambda left, right: asked.append(len(left)) or plain(left, right))
    before, token = np.arange(1000), np.full(1000, 500)
    first = coder._fits(before, token)
    assert asked == [1000] and first.tolist() == plain(before, token).tolist()
    assert coder._fits(before, token).tolist() == first.tolist()
    # A few pairs may share a place of the table.
    assert sum(asked) < 1100
