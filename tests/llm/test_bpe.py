import hashlib

import pytest
from hypothesis import given, settings, strategies as st
from public_tokenizers import path
from tokenizers import Tokenizer

from repselect.llm import bpe
from .conftest import odd_rows

FILE = path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def test_digests(spark, odd_docs, no_docs, library):
    want = []
    for i, text, *_ in odd_rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.digests(odd_docs, FILE).collect()), key=repr) == sorted(want, key=repr)
    assert bpe.digests(no_docs, FILE).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(st.characters(codec="utf-8"), max_size=60), st.text("ab '\n\t stldre1.  \x1c\x85　İſ", max_size=60)))
def test_equal_to_the_library(text):
    own, library = bpe.tokenizer(FILE), Tokenizer.from_file(FILE) if not hasattr(test_equal_to_the_library, "lib") else test_equal_to_the_library.lib
    test_equal_to_the_library.lib = library
    ids = library.encode(text, add_special_tokens=False).ids
    assert list(own.encode_batch([text])[0]) == ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_whole_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.encode_decode(docs, FILE).collect():
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.decoded == texts[r.doc_id]


def test_memory_is_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    own = bpe.TrieBpe(FILE)
    for text in ["some words here", "others there again " + "z" * 100, "some words here"]:
        assert list(own.encode_batch([text])[0]) == library.encode(text, add_special_tokens=False).ids
