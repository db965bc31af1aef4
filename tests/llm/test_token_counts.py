"""Texts outside Latin-1 are counted through the dictionary of pre-tokens too."""

import random

from churnscope.llm import queries, token_counts

ODD = ["“curly” – dash … it’s", "中文 文本 中文", "🙂🙂 👩‍👩‍👧 x🙂y", "Ελλάδα ΟΔΟΣ ΟΔΟΣ.", "İstanbul ẞ ß ǅ", "é ́a  ́ a b c", "हिन्दी ไทย עברית",
       "\x1c\x85 　 µ ª º", "﻿x � ​", "a<|endoftext|>b – c<|startoftext|>", "<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> –",
       "½ ² ٣ Ⅷ 1２3", "don’t I'LL we've – 'S", "가가 ą́", "x̀" * 50]


def test_counts_equal_the_library_without_encoding_a_text(monkeypatch):
    counter = token_counts.PieceCounter(queries.tokenizer("word_bpe_49k.json"))
    rng = random.Random(4)
    texts = ODD + [" ".join(rng.choices(ODD, k=40)) for _ in range(30)] + ["".join(rng.choices("".join(ODD), k=300)) for _ in range(200)]
    want = [len(counter.library.encode(t, add_special_tokens=False)) for t in texts]
    library = counter.library

    class NoWhole:
        normalizer, pre_tokenizer, model, encode_batch = library.normalizer, library.pre_tokenizer, library.model, library.encode_batch

    counter.library = NoWhole()  # has no encode()
    assert [counter(t) for t in texts] == want
    assert "中文" not in counter.known and any(isinstance(w, bytes) for w in counter.known)
    monkeypatch.setattr(token_counts, "PART", 7)  # cuts at spaces
    assert [counter(t) for t in texts] == want
    monkeypatch.setattr(token_counts, "HELD", 5)
    assert [counter(t) for t in texts] == want
