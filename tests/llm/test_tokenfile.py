"""Token files: blocks of every width, and what the model is asked for."""

import numpy as np
import public_tokenizers

from pitwise.llm import tokenfile


def test_blocks_of_every_width_come_back():
    r = np.random.default_rng(0)
    cases = [np.zeros(0), np.full(300, 5), np.full(999, 2**32 - 1), np.where(np.arange(12_800) % 40 == 0, 2**32 - 1, 5), r.zipf(1.4, 20_000) % 49_152]
    cases += [r.integers(0, 2**w, 700) for w in range(33)]
    for ids in [c.astype(np.uint32) for c in cases] + [np.concatenate(cases).astype(np.uint32)]:
        doc_ids, lengths, found = tokenfile.read_segment(tokenfile.write_segment([3, None], [len(ids), 0], ids))
        assert doc_ids == [3, None] and lengths.tolist() == [len(ids), 0] and found.tolist() == ids.tolist()


def test_the_model_is_asked_once_for_a_word_with_and_without_punctuation():
    words, asked = tokenfile.WordEncoder(public_tokenizers.path("word_bpe_49k.json")), []
    words._model_ids = lambda part, ask=words._model_ids: asked.append(part) or ask(part)
    text = "wuzzle, wuzzle. wuzzle wuzzle; Wuzzle,"
    assert words.encode([text.encode()])[0].tolist() == sum((words.tokenizer.encode(w, add_special_tokens=False).ids for w in text.lower().split()), [])
    assert sorted(asked) == [b",", b".", b";", b"wuzzle"]
