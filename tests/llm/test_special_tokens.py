"""Token files against the library with its default settings, where texts hold the strings of special tokens."""

import numpy as np
import public_tokenizers

from vitalcurve.llm import tokens


def test_special_strings_become_their_ids(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["end of it <|endoftext|> next", "<|endoftext|>", "a<|startoftext|><|endoftext|>B. c", "<|ENDOFTEXT|> x <|endoftext|", "e<|endoftext|>́ É.<|endoftext|>\n", "plain", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = sorted(tokens.token_files(docs, path, 2).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, text in zip(found, texts):
        expected = library.encode(text, add_special_tokens=False).ids + [2]
        assert np.frombuffer(r.ids, "<u4").tolist() == expected and (r.start, r.n_tokens) == (start, len(expected))
        start += len(expected)
    assert np.frombuffer(found[0].ids, "<u4").tolist()[:5] == [806, 539, 585, 49407, 1131]
