import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattiq.llm import tokenizer as tk

if not os.path.exists(tk.VOCABULARY):
    pytest.skip("no vocabulary files", allow_module_level=True)

tiktoken = pytest.importorskip("tiktoken")
DATA = open(tk.VOCABULARY, "rb").read()
BPE = tk.encoder(DATA)
REF = tiktoken.Encoding("own", pat_str=tk.PATTERN, mergeable_ranks=tk.parse_ranks(DATA), special_tokens={})


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert BPE.encode(text) == REF.encode_ordinary(text)
    assert BPE.decode(BPE.encode(text)) == text
    assert BPE.count(text) == len(BPE.encode(text))


@given(st.text(alphabet="ab \n'tsre1.é", max_size=40))
@settings(max_examples=300, deadline=None)
def test_ascii_split_and_contractions(text):
    assert BPE.encode(text) == REF.encode_ordinary(text)


@pytest.mark.parametrize("text", ["0" * 5000, "a" * 3000, " " * 3000 + "x", "é" * 999, "the" * 3000, "<|endoftext|> x", "\x1c\x1d a\x85b c d", "﻿x\r\n\r\n y"])
def test_long_and_odd(text):
    assert BPE.encode(text) == REF.encode_ordinary(text)


def test_prefix_table_grows_and_shrinks():
    table = tk.PrefixTable(BPE, b"retriev")
    table.append(b"al")
    assert table.tokens() == BPE.merge(b"retrieval")
    table.truncate(3)
    table.append(b"urn")
    assert table.tokens() == BPE.merge(b"return")


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 12), st.text(alphabet="ab c\n'1é", max_size=8)), max_size=6))
@settings(max_examples=150, deadline=None)
def test_appends_and_edits(edits):
    text = "the quick  brown\n\nfox's den 12"
    inc = tk.IncrementalText(BPE, text)
    for start, n, new in edits:
        start = min(start, len(text))
        text = text[:start] + new + text[start + n :]
        inc.replace(start, min(start + n, len(inc.text)), new)
        inc.append("e")
        text += "e"
        assert inc.text == text
        assert inc.ids() == REF.encode_ordinary(text)


def test_corpus(spark):
    data = [(1, None, "x"), (2, "", "x"), (3, "Hello  world", "x"), (3, "Hello  world", "y"), (4, "<|endoftext|>", "z")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in tk.encode_corpus(df).collect())
    assert got == sorted((d, REF.encode_ordinary(t or "")) for d, t, _ in data)
    counts = sorted((r.doc_id, r.n_ids) for r in tk.count_corpus(df).collect())
    assert counts == sorted((d, len(i)) for d, i in got)
    assert tk.encode_corpus(df.limit(0)).collect() == []
